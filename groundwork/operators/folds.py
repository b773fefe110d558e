"""Stateful logic as folds over each key's rows in order.

Rows are hashed by key and sorted within partitions, which spills, and pass through Python as a stream: of a key no more than
its state is held, whatever its number of rows. A step sees one row and the key's state, and gives the row's result. What a
step does is inherently sequential, so a key is one task's work; different keys are spread.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Step = Callable[[dict, tuple], tuple]


def fold_by_key(df: DataFrame, key: str, order: list[str], inputs: list[str], step: Step, outputs: str, carry: list[str] | None = None) -> DataFrame:
    """key, carry columns and outputs, one row for each of df, in order of the given columns within a key.

    step(state, inputs) changes state, which is empty at a key's first row, and gives a tuple of outputs. A null key is a key.
    Equal order values are a tie that the caller should break by another column. An empty table gives an empty one.
    """
    carry = carry or []
    picked = [key, *carry, *inputs]
    names = [f"c{i}" for i in range(len(picked))]
    schema = ", ".join(f"{n} {df.schema[c].dataType.simpleString()}" for n, c in zip(names[: 1 + len(carry)], picked, strict=False)) + ", " + outputs
    kept = 1 + len(carry)
    out_names = [o.split()[0] for o in outputs.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nothing = object()
        current, state = nothing, {}
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False, name=None):
                k = None if pd.isna(row[0]) else row[0]
                if k != current or current is nothing:
                    current, state = k, {}
                rows.append(row[:kept] + step(state, row[kept:]))
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in range(kept + len(out_names))]
            frame = {n: batch[n].to_numpy() for n in names[:kept]}
            frame |= {n: pd.Series(list(c), dtype=object) for n, c in zip(out_names, columns[kept:], strict=True)}
            yield pd.DataFrame(frame)

    placed = df.repartition(F.col(key)).sortWithinPartitions(key, *order)
    out = placed.select(*[F.col(c).alias(n) for c, n in zip(picked, names, strict=True)]).mapInPandas(run, schema)
    return out.select(*[F.col(n).alias(c) for n, c in zip(names[:kept], picked, strict=False)], *out_names)


def token_bucket(capacity: float, per_second: float, cost: float = 1.0) -> Step:
    """inputs (us,): allowed, tokens left, seconds to wait. A bucket starts full, refills by time and never above capacity."""

    def step(state: dict, row: tuple) -> tuple:
        (us,) = row
        tokens = min(capacity, state["tokens"] + (us - state["us"]) / 1e6 * per_second) if state else capacity
        allowed = tokens >= cost
        wait = 0 if allowed else int(-(-(cost - tokens) // per_second))
        tokens -= cost if allowed else 0
        state.update(tokens=tokens, us=us)
        return bool(allowed), float(tokens), wait

    return step


def ttl_cache(ttl_s: float) -> Step:
    """inputs (us,): hit. A miss writes; an entry lives ttl_s after its write, however often it's read."""

    def step(state: dict, row: tuple) -> tuple:
        (us,) = row
        hit = bool(state) and us < state["until"]
        if not hit:
            state["until"] = us + int(ttl_s * 1e6)
        return (hit,)

    return step


def circuit_breaker(threshold: int, cooldown_s: float) -> Step:
    """inputs (us, failed, counts): state met, rejected. Opens at the threshold of failures that count, lets one probe through
    after the cooldown, closes by a success."""

    def step(state: dict, row: tuple) -> tuple:
        us, failed, counts = row
        state.setdefault("failures", 0)
        state.setdefault("opened", None)
        opened = state["opened"]
        met = "closed" if opened is None else "open" if us < opened + int(cooldown_s * 1e6) else "half_open"
        if met == "open":
            return met, True
        if not failed:
            state.update(failures=0, opened=None)
        elif counts:
            state["failures"] += 1
            if met == "half_open" or state["failures"] >= threshold:
                state["opened"] = us
        return met, False

    return step


def budget_gate(calls: int, searches: int, fetches: int, refunds: int = 3) -> Step:
    """inputs (kind, failed): allowed, used so far. Once capped always capped; a failed search or fetch is refunded, a few times."""

    def step(state: dict, row: tuple) -> tuple:
        kind, failed = row
        if not state:
            state.update(calls=0, search=0, fetch=0, refunded=0, capped=False)
        limits = {"search": searches, "fetch": fetches}
        over = state["calls"] >= calls or (kind in limits and state[kind] >= limits[kind])
        state["capped"] = state["capped"] or over
        if state["capped"]:
            return False, state["calls"]
        state["calls"] += 1
        if kind in limits:
            state[kind] += 1
            if failed and state["refunded"] < refunds:
                state["refunded"] += 1
                state[kind] -= 1
                state["calls"] -= 1
        return True, state["calls"]

    return step


def job_lease(lease_s: float, attempts: int) -> Step:
    """inputs (us, event): status, attempts used. Events claim, renew, complete and fail; a claim of a running job counts only
    once its lease has lapsed, and a failed job is queued again until its attempts are used up."""

    def step(state: dict, row: tuple) -> tuple:
        us, event = row
        if not state:
            state.update(status="queued", tries=0, until=0)
        s = state
        if event == "claim" and (s["status"] == "queued" or (s["status"] == "running" and us >= s["until"])):
            if s["status"] == "queued":
                s["tries"] += 1
            s.update(status="running", until=us + int(lease_s * 1e6))
        elif s["status"] == "running" and event == "renew":
            s["until"] = us + int(lease_s * 1e6)
        elif s["status"] == "running" and event == "complete":
            s["status"] = "done"
        elif s["status"] == "running" and event == "fail":
            s["status"] = "queued" if s["tries"] < attempts else "failed"
        return s["status"], s["tries"]

    return step


def memory_upsert(most: int = 200, near: float | None = None) -> Step:
    """inputs (text, us), with near also (places, weights) of a sparse unit vector: inserted, hits. A text is known by its
    trimmed form in lower case, or, with near, by a vector whose cosine is above it: the nearest is hit. A new one begins
    without hits. Beyond most memories the least hit and then the longest unseen go, the new one as well as others. A blank
    text is none: not inserted, no hits."""

    def step(state: dict, row: tuple) -> tuple:
        text, us, *vector = row
        known = state.setdefault("known", {})
        plain = (text or "").strip().lower()
        if not plain:
            return False, None
        digest = hashlib.sha256(plain.encode()).hexdigest()
        own = dict(zip(vector[0], vector[1], strict=True)) if near is not None and vector[0] is not None else {}
        hit = digest if digest in known else None
        if hit is None and own:
            scored = [(sum(w * own.get(i, 0.0) for i, w in other.items()), d) for d, (_, _, other) in known.items() if other]
            best = max(scored, key=lambda x: x[0], default=(0.0, None))
            hit = best[1] if best[0] > near else None
        if hit is not None:
            hits, _, other = known[hit]
            known[hit] = (hits + 1, us, other)
            return False, hits + 1
        known[digest] = (0, us, own)
        while len(known) > most:
            del known[min(known, key=lambda d: known[d][:2])]
        return True, 0

    return step


def slot_borrowing(total: int, allocations: dict, reserve: int) -> Step:
    """inputs (branch,): granted, borrowed. Every branch of allocations is registered and active from the start. A branch takes
    its own slots first; beyond them it may borrow what the pool leaves once all that is still owed to the other branches,
    begun or not, and the reserve are kept back."""

    def step(state: dict, row: tuple) -> tuple:
        (branch,) = row
        used = state.setdefault("used", dict.fromkeys(allocations, 0))
        claimed, own = sum(used.values()), allocations.get(branch, 0)
        mine = used.setdefault(branch, 0)
        owed = sum(max(0, n - used[b]) for b, n in allocations.items() if b != branch)
        within = mine < own and claimed < total
        granted = within or total - claimed - owed - reserve > 0
        used[branch] += int(granted)
        return granted, granted and not within

    return step


def lru_cache(ttl_s: float, most: int) -> Step:
    """inputs (us, entry): hit, evicted. An entry lives ttl_s after its write; a read makes it the newest; beyond most entries
    the one that was touched longest ago goes."""

    def step(state: dict, row: tuple) -> tuple:
        us, entry = row
        held = state.setdefault("held", {})
        until = held.pop(entry, None)
        hit = until is not None and us < until
        held[entry] = until if hit else us + int(ttl_s * 1e6)
        evicted = len(held) > most
        if evicted:
            del held[next(iter(held))]
        return hit, evicted

    return step


def job_queue(lease_s: float, attempts: int) -> Step:
    """inputs (us, event, job): claimed job, status. Of one queue: ``add`` queues a job, ``claim`` takes the oldest that is queued
    or whose lease has lapsed, ``complete`` and ``fail`` end the job they name if it runs; a failed one is queued again until
    its attempts are used up. A claim of a lapsed job does not use another attempt."""

    def step(state: dict, row: tuple) -> tuple:
        us, event, job = row
        jobs = state.setdefault("jobs", {})
        if event == "add" and job not in jobs:
            jobs[job] = {"status": "queued", "tries": 0, "until": 0}
        elif event == "claim":
            job = next((j for j, s in jobs.items() if s["status"] == "queued" or (s["status"] == "running" and s["until"] <= us)), None)
            if job is None:
                return None, None
            s = jobs[job]
            s.update(status="running", until=us + int(lease_s * 1e6), tries=s["tries"] + (s["status"] == "queued"))
            return job, "running"
        elif event in ("complete", "fail") and jobs.get(job, {}).get("status") == "running":
            s = jobs[job]
            s["status"] = "completed" if event == "complete" else "queued" if s["tries"] < attempts else "failed"
        status = jobs[job]["status"] if job in jobs else None
        if status in ("completed", "failed"):
            jobs[job]["until"] = 0
        return None, status

    return step


def deep_allocation(total: int, branches: int, most: int) -> tuple[int, int]:
    """(slots per branch, reserve) of a pool."""
    reserve = max(4, total - branches * most)
    each = max(1, min(most, (total - reserve) // max(1, branches)))
    return each, total - each * branches


def termination(max_tokens: str, refused: str, capped: str) -> str:
    """SQL: why a loop ended, by precedence."""
    return f"case when {max_tokens} then 'max_tokens' when {refused} then 'refused' when {capped} then 'capped' else 'completed' end"
