"""Subjects on made-up documents, some labels wrong."""

import random

import pytest

from groundwork.llm.subjects import found_subjects, sentences, subject_shares

SUBJECTS = {"music": "violin piano sonata chorus rhythm melody organ concert".split(), "farming": "tractor barley harvest plough sheep orchard hay silo".split(), "sailing": "anchor rudder mast harbour jib keel tide buoy".split()}
PLAIN = "Nobody at the office has checked the figure since then.|The page was last changed some years ago.|More details follow in another section.".split("|")


def corpus(n, rng):
    docs, truth = [], {}
    for d in range(n):
        topics = rng.sample(sorted(SUBJECTS), rng.choice([0, 1, 1, 1, 2]))
        lines = [rng.choice(PLAIN) for _ in range(3)]
        for t in topics:
            for _ in range(4):
                a, b = rng.sample(SUBJECTS[t], 2)
                lines.append(f"The {rng.choice(['quiet', 'broad', 'early'])} {a} of {rng.choice('ABCDEFGHIJ')}name{rng.randint(0, 400)} follows each {b} for {rng.randint(1, 99)} days.")
        rng.shuffle(lines)
        docs.append((d, " ".join(lines), "x"))
        truth[d] = set(topics)
    return docs, truth


def test_held_out_accuracy(spark):
    rng = random.Random(4)
    docs, truth = corpus(900, rng)
    labels = []
    for d in range(0, 900, 4):
        for t in truth[d]:
            wrong = rng.random() < 0.08
            labels.append((d, rng.choice(sorted(SUBJECTS)) if wrong else rng.choice([t, t.upper(), f" {t}"])))
    labels += [(0, None), (None, "music"), (5000, "music"), (4, "cooking"), labels[0]]
    docs += [(900, None, "x"), (901, "", "x"), (902, " \n ", "x")]
    got = {}
    shares = subject_shares(spark.createDataFrame(docs, "doc_id long, text string, subject string").repartition(3), "doc_id", "text", sorted(SUBJECTS), spark.createDataFrame(labels, "doc_id long, subject string"), "doc_id", "subject")
    for r in found_subjects(shares).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    assert sum(got.get(d, set()) == t for d, t in truth.items()) / len(truth) > 0.97
    assert not set(got) & {900, 901, 902}


def test_without_labels_or_documents(spark):
    docs = spark.createDataFrame([(1, "A violin plays.")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, subject string")
    some = spark.createDataFrame([(1, "music")], "doc_id long, subject string")
    for d, labels in ((docs, none), (docs.limit(0), some), (docs, some)):
        assert subject_shares(d, "doc_id", "text", ["music", "law"], labels, "doc_id", "subject").columns == ["doc_id", "subject", "sentences", "share"]
        assert subject_shares(d, "doc_id", "text", ["music", "law"], labels, "doc_id", "subject").count() == 0


def test_sentences():
    assert [" ".join(s) for s in sentences("One two. Three <b>four</b> [1]. Five-\nsix\n\nSeven")] == ["one two", "three four", "fivesix", "seven"]


def sized(names, weights, n, rng, none=0.2):
    """Documents on one subject each, drawn by weight, or on none."""
    docs, truth = [], {}
    for d in range(n):
        topic = None if rng.random() < none else rng.choices(names, weights)[0]
        lines = [rng.choice(PLAIN) for _ in range(3)]
        for _ in range(4 if topic else 0):
            a, b = rng.sample(SUBJECTS[topic], 2)
            lines.append(f"The {rng.choice(['quiet', 'broad', 'early'])} {a} of {rng.choice('ABCDEFGHIJ')}name{rng.randint(0, 400)} follows each {b} for {rng.randint(1, 99)} days.")
        rng.shuffle(lines)
        docs.append((d, " ".join(lines)))
        truth[d] = {topic} - {None}
    return docs, truth


def accuracy(spark, docs, truth, labels, names):
    shares = subject_shares(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", names, spark.createDataFrame(labels, "doc_id long, subject string"), "doc_id", "subject")
    got = {}
    for r in found_subjects(shares).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    return sum(got.get(d, set()) == t for d, t in truth.items()) / len(truth)


@pytest.mark.parametrize(
    "names, weights, none",
    [(["farming", "music", "sailing"], [8, 1, 1], 0.2), (["farming", "music"], [1, 1], 0.2), (["farming", "music"], [9, 1], 0.2), (["music"], [1], 0.5), (["music"], [1], 0.2)],
)
def test_large_few_and_lone_subjects(spark, names, weights, none):
    rng = random.Random(7)
    docs, truth = sized(names, weights, 900, rng, none)
    labels = [(d, rng.choice(names) if rng.random() < 0.05 else t) for d in range(0, 900, 3) for t in truth[d]]
    assert accuracy(spark, docs, truth, labels, names) > 0.95


def test_terms_and_sentences_of_other_scripts():
    ordered = lambda text: [sorted(s) for s in sentences(text)]
    assert ordered("我喜欢音乐。他种田！是吗？好") == [["喜欢", "我喜", "欢音", "音乐"], ["他种", "种田"], ["是吗"], ["好"]]
    assert ordered("「海へ行く。」と言った。終わり") == [["へ行", "海へ", "行く"], sorted(["と言", "言っ", "った"]), sorted(["終わ", "わり"])]
    assert ordered("हिन्दी में किताब है। संगीत सुनो।") == [sorted(["हिन्दी", "में", "किताब", "है"]), sorted(["संगीत", "सुनो"])]
    assert len(sentences("ฉันชอบดนตรี เขาทำนา")) == 2
    assert ordered("AI技术 works. Next") == [sorted(["ai", "技术", "works"]), ["next"]]
    assert ordered("Ça va bien… Où est-il? Là-bas.") == [["bien", "va", "ça"], ["est", "il", "où"], ["bas", "là"]]


OTHERS = {
    "zh": ("。", ["小提琴 钢琴 奏鸣曲 合唱 旋律 风琴", "拖拉机 大麦 收获 犁地 绵羊 果园", "船锚 船舵 桅杆 港口 龙骨 潮汐"], "办公室里没有人看过这个数字", "今天{}和{}都很重要"),
    "th": (" ", ["ไวโอลิน เปียโน โซนาตา ประสานเสียง ทำนอง ออร์แกน", "รถไถ ข้าวบาร์เลย์ เก็บเกี่ยว คันไถ แกะ สวนผลไม้", "สมอเรือ หางเสือ เสากระโดง ท่าเรือ กระดูกงู น้ำขึ้น"], "ไม่มีใครตรวจสอบตัวเลขนี้", "วันนี้{}และ{}สำคัญมาก"),
    "hi": ("। ", ["वायलिन पियानो सोनाटा गायन धुन बांसुरी", "ट्रैक्टर जौ फसल हल भेड़ बगीचा", "लंगर पतवार मस्तूल बंदरगाह नाव ज्वार"], "दफ्तर में किसी ने यह संख्या नहीं देखी", "आज {} और {} बहुत जरूरी हैं"),
}


@pytest.mark.parametrize("language", sorted(OTHERS))
def test_subjects_of_other_scripts(spark, language):
    end, words, plain, line = OTHERS[language]
    rng, names = random.Random(3), ["farming", "music", "sailing"]
    by_name = dict(zip(["music", "farming", "sailing"], words, strict=True))
    docs, truth = [], {}
    for d in range(600):
        topic = rng.choice([None, *names])
        lines = [plain] * 2 + [line.format(*rng.sample(by_name[topic].split(), 2)) for _ in range(4 if topic else 0)]
        rng.shuffle(lines)
        docs.append((d, end.join([*lines, ""]).strip()))
        truth[d] = {topic} - {None}
    labels = [(d, t) for d in range(0, 600, 3) for t in truth[d]]
    assert accuracy(spark, docs, truth, labels, names) > 0.95


def test_any_number_of_terms(spark, monkeypatch):
    rng, names = random.Random(5), sorted(SUBJECTS)
    docs, truth = sized(names, [1, 1, 1], 400, rng)
    docs += [docs[0], (400, docs[1][1]), (401, None), (402, "")]
    labels = [(d, t) for d in range(0, 400, 3) for t in truth[d]]

    def rows():
        got = subject_shares(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", names, spark.createDataFrame(labels, "doc_id long, subject string"), "doc_id", "subject")
        return sorted((r.doc_id, r.subject, r.sentences, round(r.share, 9)) for r in got.collect())

    free = rows()
    monkeypatch.setattr("groundwork.llm.subjects.MOST_TERMS", 5)
    assert rows() == free and len({r[1] for r in free}) == 3


def test_the_divergence_falls_until_it_stops(spark, monkeypatch):
    from groundwork.llm import subjects

    made = []
    start = subjects.Factorisation.__init__
    monkeypatch.setattr(subjects.Factorisation, "__init__", lambda self, *a: made.append(self) or start(self, *a))
    monkeypatch.setattr(subjects, "TOLERANCE", 1e-4)
    rng, names = random.Random(6), sorted(SUBJECTS)
    docs, truth = sized(names, [3, 2, 1], 600, rng)
    labels = [(d, rng.choice(names) if rng.random() < 0.1 else t) for d in range(0, 600, 3) for t in truth[d]]
    assert accuracy(spark, docs, truth, labels, names) > 0.95
    found = made[0].divergences
    assert len(found) > 1 and all(b <= a * (1 + 1e-3) for a, b in zip(found, found[1:], strict=False))
