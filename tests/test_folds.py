"""Folds against plain loops, with small blocks and small components."""

import random

from pyspark.sql import functions as F

from turnwise.plans.blocks import by_time
from turnwise.plans import folds
from turnwise.plans.folds import fold_kept, suppress


def test_fold_kept(spark):
    rnd = random.Random(3)
    rows = [(rnd.randrange(2), i, float(rnd.randint(0, 150)), rnd.choice("ab"), rnd.choice([.5, .7, .9]))
            for i in range(150)]
    df = spark.createDataFrame(rows, "s long, pos long, t double, kind string, conf double")
    want = []
    for s in (0, 1):
        kept = []
        for r in sorted((r for r in rows if r[0] == s), key=lambda r: (r[2], r[1])):
            if kept and kept[-1][3] == r[3] and abs(r[2] - kept[-1][2]) < 5:
                if r[4] > kept[-1][4]:
                    kept[-1] = r
            else:
                kept.append(r)
        want += [r[1] for r in kept]
    for width in (7, 10_000):
        got = fold_kept(
            df, ["s"], ["t", "pos"], by_time("t", width),
            row={c: F.col(c) for c in ("pos", "t", "kind", "conf")},
            absorbs=lambda k, c: (k["kind"] == c["kind"]) & (c["t"] - k["t"] < 5),
            merge=lambda k, c: {f: F.when(c["conf"] > k["conf"], c[f]).otherwise(k[f])
                                for f in ("pos", "t", "kind", "conf")})
        assert sorted(r.pos for r in got.collect()) == sorted(want)


def test_suppress(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(120):
        start = float(rnd.randint(0, 300))
        segs = [(start, start + rnd.choice([0, 3, 10, 40]))]
        if rnd.random() < .3:
            segs.append((start + 50, start + 60))
        rows.append((rnd.randrange(2), i, float(rnd.randint(1, 9)), segs))
    df = spark.createDataFrame(
        rows, "s long, id long, score double, segs array<struct<start:double,end:double>>")
    want = []
    for s in (0, 1):
        kept = []
        for r in sorted((r for r in rows if r[0] == s), key=lambda r: (-r[2], r[1])):
            if not any(min(a[1], b[1]) - max(a[0], b[0]) > (a[1] - a[0]) * .3
                       and min(a[1], b[1]) - max(a[0], b[0]) >= 0
                       for k in kept for a in r[3] for b in k[3]):
                kept.append(r)
        want += [r[1] for r in kept]
    for largest in (1000, 4):
        got = suppress(df, ["s"], segments=F.col("segs"), score=F.col("score"), tie="id",
                       largest=largest, width=20.0, block_seconds=30.0)
        assert sorted(r.id for r in got.collect()) == sorted(want)


def test_a_long_staircase_takes_as_many_rounds_as_blocks(spark, monkeypatch):
    """100,000 steps, each covering a third of the next: every other one stays. Ranks fall along the stairs, so each step depends on all
    before it."""
    n, calls = 100_000, []
    steps = spark.range(n).selectExpr("id % 1 as s", "id", "id * 1.0d as start", "id + 1.5d as end", "1e6d - id as score")
    steps = steps.withColumn("segs", F.array(F.struct("start", "end")))
    real = folds._round
    monkeypatch.setattr(folds, "_round", lambda *a: calls.append(1) or real(*a))
    got = suppress(steps, ["s"], segments=F.col("segs"), score=F.col("score"), tie="id", width=10_000.0, largest=100)
    assert sorted(r.id for r in got.select("id").collect()) == list(range(0, n, 2))
    assert len(calls) <= 14
