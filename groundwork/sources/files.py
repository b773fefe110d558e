"""Sources and sinks of files: collections in JSON, logs by lines, event streams, uploads, gold sets and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# Kinds of uploads by extension, then by media type.
KINDS = {"pdf": "pdf", "md": "markdown", "markdown": "markdown", "txt": "text", "text": "text", "html": "html", "htm": "html"}
MEDIA = {"application/pdf": "pdf", "text/markdown": "markdown", "text/plain": "text", "text/html": "html"}


def collection(spark: SparkSession, path: str, schema: StructType, key: str = "id") -> DataFrame:
    """A collection of JSON documents, whole files or lines: of one id the last stands, and damaged documents are left out.

    Order is that of files by name and of documents within. ``damaged`` finds what was left out.
    """
    with_bad = StructType([*schema.fields, StructField("_corrupt_record", StringType())])
    rows = spark.read.schema(with_bad).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    placed = rows.withColumn("_at", F.struct(F.input_file_name(), F.monotonically_increasing_id())).where("_corrupt_record is null").drop("_corrupt_record")
    others = [f.name for f in schema.fields if f.name != key]
    return placed.groupBy(key).agg(F.max_by(F.struct(*others), "_at").alias("_r")).select(key, "_r.*")


def damaged(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a collection that don't read as JSON, with their files."""
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.input_file_name().alias("file"))
    return lines.where("trim(line) != '' and try_parse_json(line) is null")


def gold(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A gold set by lines, which fails at a bad line rather than being silently smaller."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def replace_table(df: DataFrame, path: str) -> None:
    """The commit protocol makes readers see the old files or the new."""
    df.write.mode("overwrite").parquet(path)


def upsert_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """new, and the rows of old with other keys."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """Uploaded files with their kind; content stays unread until it's selected."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.expr(kind("path", "cast(null as string)")).alias("kind"), "length", F.col("modificationTime").alias("modified_at"), "content")


def newest(spark: SparkSession, path: str) -> DataFrame:
    """The report file that was modified last."""
    return spark.read.format("binaryFile").load(path).select("path", "modificationTime").groupBy().agg(F.max_by("path", "modificationTime").alias("path"))


def kind(filename: str, media: str) -> str:
    """SQL: the kind of an upload by extension, else by media type; null if unsupported."""
    extension = f"lower(regexp_extract({filename}, '\\\\.([A-Za-z0-9]+)$', 1))"
    by_extension = " ".join(f"when {extension} = '{e}' then '{k}'" for e, k in KINDS.items())
    by_media = " ".join(f"when lower({media}) like '{m}%' then '{k}'" for m, k in MEDIA.items())
    return f"case {by_extension} {by_media} end"


def export_runs(df: DataFrame, path: str, ended: str) -> None:
    """Runs by population (done, cap or error), so that a reader of one prunes the others."""
    df.withColumn("population", F.col(ended)).write.mode("overwrite").partitionBy("population").parquet(path)


def event_frames(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, seq, event, data) of server-sent event text: frames end at a blank line, comments are passed over, data lines join."""
    plain = f"replace(replace({text}, '\\r\\n', '\\n'), '\\r', '\\n')"
    frames = df.select(key, F.posexplode(F.expr(f"split({plain}, '\\n\\n+')")).alias("seq", "frame"))
    lines = "filter(split(frame, '\\n'), l -> l != '' and not startswith(l, ':'))"
    field = lambda n: f"transform(filter(ls, l -> startswith(l, '{n}:')), l -> regexp_replace(substr(l, {len(n) + 2}), '^ ', ''))"
    parsed = frames.withColumn("ls", F.expr(lines)).where("size(ls) > 0")
    return parsed.select(
        key,
        F.expr("seq + 1").alias("seq"),
        F.expr(f"coalesce(try_element_at({field('event')}, -1), 'message')").alias("event"),
        F.expr(f"array_join({field('data')}, '\\n')").alias("data"),
    )


def event_text(df: DataFrame, key: str, seq: str, event: str, data: str) -> DataFrame:
    """(key, text): the reverse, frames in order of seq."""
    frame = F.concat(F.lit("id: "), F.col(seq).cast("string"), F.lit("\nevent: "), F.col(event), F.lit("\ndata: "), F.replace(F.col(data), F.lit("\n"), F.lit("\ndata: ")), F.lit("\n\n"))
    frames = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), frame.alias("f")))).alias("fs"))
    return frames.select(key, F.array_join(F.transform("fs", lambda x: x["f"]), "").alias("text"))
