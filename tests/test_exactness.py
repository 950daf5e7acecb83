"""Bounded top-k and hour-wise skew against brute force on random rows."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from slotledger.functions.topk import best_per_text, newest_distinct
from slotledger.operators.skew import timeline_tail

EPOCH = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def newest_first(rows, k):
    present = {r for r in rows if r[0] is not None}
    ranked = sorted(present, key=lambda r: (-r[0], r[1]))
    missing = sorted((r for r in set(rows) if r[0] is None), key=lambda r: r[1])
    return (ranked + missing)[:k]


@pytest.mark.parametrize("seed", range(6))
def test_newest_distinct(spark, seed):
    rnd = random.Random(seed)
    pool = [None, *range(rnd.choice([2, 8, 40]))] if seed % 2 else list(range(30))
    rows = [(rnd.choice(pool), rnd.choice("abc")) for _ in range(120)]
    df = spark.createDataFrame(rows, "t bigint, v string")
    for k, buckets in ((1, 1), (5, 1), (5, 7), (12, 3), (200, 1), (7, 256)):
        found = newest_distinct(df, "t", k, F.col("v"), buckets=buckets)
        assert [tuple(r) for r in found.collect()] == newest_first(rows, k)


@pytest.mark.parametrize("seed", range(6))
def test_best_per_text(spark, seed):
    rnd = random.Random(seed)
    texts = [f"q{i}" for i in range(rnd.choice([2, 12, 60]))]
    rows = [
        # A third of all rows share one text.
        (i, texts[0] if i % 3 == 0 else rnd.choice(texts), rnd.choice([None, *range(20)]))
        for i in range(150)
    ]
    best: dict[str, tuple] = {}
    for i, text, value in rows:
        rank = (value is None, -(value or 0), i)
        if text not in best or rank < best[text][0]:
            best[text] = (rank, i, text, value)
    ordered = sorted(best.values(), key=lambda b: (b[0][:2], b[2]))
    df = spark.createDataFrame(rows, "i bigint, q string, v bigint")
    for k, buckets in ((1, 1 << 16), (10, 1 << 16), (10, 12), (3, 2), (100, 1 << 16)):
        found = best_per_text(df, "q", "v", k, F.col("i"), buckets)
        assert [tuple(r) for r in found.collect()] == [b[1:] for b in ordered][:k]


def test_timeline_tail_with_one_job_holding_most_rows(frame):
    rnd = random.Random(7)
    rows = []
    for n in range(3000):
        job = "hot" if n % 3 == 0 else f"j{rnd.randrange(40)}"
        rows.append((job, n * 61, rnd.choice([0, 5, 90, 900, 1000, None])))
    rows += [("no_start", None, 10), ("no_start", 1, 1000), ("nothing", 5, None)]
    timeline = frame("jobs_timeline", [
        {"job_id": j, "period_slot_ms": ms,
         "period_start": None if at is None else EPOCH + dt.timedelta(seconds=at)}
        for j, at, ms in rows])
    wanted = {}
    for job in {r[0] for r in rows}:
        slots = [r[2] if r[2] is None else r[2] / 1000.0 for r in rows if r[0] == job]
        known = [s for s in slots if s is not None]
        peak = max(known) if known else None
        low = sum(s < peak * 0.1 for s in known)
        wanted[job] = (peak, low / len(slots))
    got = {r.job_id: (r.peak_slots, r.tail_ratio) for r in timeline_tail(timeline).collect()}
    assert got == wanted
