"""Plan helpers against plain loops on random rows."""

import random

from pyspark.sql import functions as F

from turnwise.plans.asof import nearest
from turnwise.plans.bands import band_join
from turnwise.plans.blocks import Agg, around, balanced, by_time, neighbours, ranked, running, runs


def _rows(seed, n=200, streams=3):
    rnd = random.Random(seed)
    rows = []
    for pos in range(n):
        start = rnd.choice([rnd.randint(0, 60), rnd.randint(0, 60) + .5])
        rows.append((rnd.randrange(streams), pos, float(start),
                     float(start + rnd.choice([0, 1, 2, 5, 17])), rnd.choice(["a", "b", None])))
    return rows


def _frame(spark, rows):
    return spark.createDataFrame(rows, "s long, pos long, start double, end double, who string")


def _streams(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        out.setdefault(r[0], []).append(r)
    return out


def test_neighbours_and_running(spark):
    rows = _rows(1)
    df = _frame(spark, rows)
    got = neighbours(df, ["s"], ["start", "pos"], by_time("start", 5),
                     before={"pe": F.col("end")}, after={"ns": F.col("start")})
    got = {r.pos: (r.pe, r.ns) for r in got.collect()}
    want = {}
    for rs in _streams(rows).values():
        for i, r in enumerate(rs):
            want[r[1]] = (rs[i - 1][3] if i else None, rs[i + 1][2] if i + 1 < len(rs) else None)
    assert got == want

    got = running(df, ["s"], ["start", "pos"], by_time("start", 5), sums={"n": F.lit(1)},
                  peaks={"top": F.col("end")}, fill={"lw": F.col("who")},
                  fill_back={"nw": F.col("who")})
    got = {r.pos: (r.n, r.top, r.lw, r.nw) for r in got.collect()}
    want = {}
    for rs in _streams(rows).values():
        for i, r in enumerate(rs):
            want[r[1]] = (i + 1, max((x[3] for x in rs[:i]), default=None),
                          next((x[4] for x in reversed(rs[:i + 1]) if x[4]), None),
                          next((x[4] for x in rs[i:] if x[4]), None))
    assert got == want


def test_runs(spark):
    for seed, width in ((2, 5), (3, 1), (4, 1000)):
        rows = _rows(seed)
        df = _frame(spark, rows)
        got = runs(df, ["s"], ["start", "pos"], by_time("start", width),
                   look={"who": F.col("who"), "start": F.col("start"), "end": F.col("end")},
                   opens=lambda p, c: ~p["who"].eqNullSafe(c["who"]) | (c["start"] - p["end"] > .5),
                   aggs={"who": Agg("first", F.col("who")), "start": Agg("first", F.col("start")),
                         "end": Agg("last", F.col("end")), "n": Agg("count", F.lit(1)),
                         "at": Agg("list", F.col("pos"))})
        got = sorted((r.s, r.who or "", r.start, r.end, r.n, tuple(r["at"])) for r in got.collect())
        want = []
        for rs in _streams(rows).values():
            cur = []
            for r in rs:
                if cur and (r[4] != cur[-1][4] or r[2] - cur[-1][3] > .5):
                    want.append(cur)
                    cur = []
                cur.append(r)
            want.append(cur)
        want = sorted((c[0][0], c[0][4] or "", c[0][2], c[-1][3], len(c), tuple(r[1] for r in c))
                      for c in want)
        assert got == want


def test_band_join(spark):
    rows = _rows(5, 120) + [(0, 900, 9.0, 4.0, "a")]
    other = _rows(6, 120)
    left = _frame(spark, rows)
    right = _frame(spark, other).selectExpr("s", "pos as rpos", "start as rs", "end as re")
    want = sorted((a[1], b[1]) for a in rows for b in other
                  if a[0] == b[0] and a[2] <= a[3] and a[2] <= b[3] and b[2] <= a[3])
    for width, salts in ((3, 1), (40, 4)):
        got = band_join(left, right, ["s"], width, left_range=(F.col("start"), F.col("end")),
                        right_range=(F.col("rs"), F.col("re")), salts=salts)
        assert sorted((r.pos, r.rpos) for r in got.collect()) == want


def test_nearest(spark):
    rows, other = _rows(7, 100), _rows(8, 60)
    left = _frame(spark, rows).select("s", "pos", "start")
    right = _frame(spark, other).selectExpr("s", "pos as rpos", "start as rs")
    for width in (3, 1000):
        got = nearest(left, right, ["s"], left_time=F.col("start"), right_time=F.col("rs"),
                      left_id=["pos"], right_tie=["rpos"], max_distance=2.0, block_seconds=width)
        got = {r.pos: (r.found.rpos, r.distance) if r.found else None for r in got.collect()}
        for s, pos, start, *_ in rows:
            best = min(((abs(o[2] - start), o[2], o[1]) for o in other if o[0] == s), default=None)
            assert got[pos] == ((best[2], best[0]) if best and best[0] <= 2 else None)


def test_balanced_cuts_a_crowded_stream(spark):
    # A third of all rows in one stream, most of them in its first minute.
    rows = [(0, i, (i % 6000) / 100.0 if i % 10 else float(i)) for i in range(30_000)]
    rows += [(1 + i % 600, i, float(i)) for i in range(60_000)]
    df = spark.createDataFrame(rows, "s long, pos long, start double")
    cut = balanced(df, ["s"], "start", rows=1000)
    assert cut.count() == len(rows)
    assert cut.groupBy("s", "_cut").count().agg(F.max("count")).first()[0] <= 1000 + 600
    spans = cut.groupBy("s", "_cut").agg(F.min("start").alias("a"), F.max("start").alias("b")).collect()
    by = {}
    for r in spans:
        by.setdefault(r.s, []).append((r._cut, r.a, r.b))
    for parts in by.values():
        parts.sort()
        assert all(x[2] < y[1] for x, y in zip(parts, parts[1:]))


def test_around_and_ranked(spark):
    df = spark.range(40).selectExpr("id % 2 as s", "id div 2 as pos", "cast(id * 7 % 11 as double) as v")
    got = around(df, ["s"], "pos", {"near": F.col("pos")}, before=2, after=1, block_rows=3)
    for r in got.collect():
        assert r.near == [p for p in range(r.pos - 2, r.pos + 2) if 0 <= p < 20]
    assert got.count() == 40
    rank = {(r.s, r.pos): r["rank"] for r in ranked(df, ["s"], -F.col("v"), ["pos"], 2.0).collect()}
    rows = [(r.s, r.pos, r.v) for r in df.collect()]
    for s in (0, 1):
        for i, r in enumerate(sorted((r for r in rows if r[0] == s), key=lambda r: (-r[2], r[1]))):
            assert rank[(r[0], r[1])] == i + 1


def test_empty_input(spark):
    df = _frame(spark, [])
    right = df.selectExpr("s", "pos as rpos", "start as rs", "end as re")
    block = by_time("start", 10)
    assert neighbours(df, ["s"], ["start", "pos"], block, before={"p": F.col("end")}).count() == 0
    assert running(df, ["s"], ["start", "pos"], block, sums={"n": F.lit(1)}).count() == 0
    assert runs(df, ["s"], ["start", "pos"], block, look={"w": F.col("who")}, opens=lambda p, c: p["w"] != c["w"],
                aggs={"n": Agg("count", F.lit(1))}).count() == 0
    assert band_join(df, right, ["s"], 5, left_range=(F.col("start"), F.col("end")),
                     right_range=(F.col("rs"), F.col("re"))).count() == 0


def test_running_totals_over_rows_without_a_time(spark):
    """They come before all others and count for them."""
    rows = [(1, i, None if i % 4 == 0 else float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "stream_id long, id long, t double")
    got = {r.id: r.n for r in running(df, ["stream_id"], ["t", "id"], by_time("t", 5.0), sums={"n": F.lit(1).cast("long")}).collect()}
    order = sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0.0, r[1]))
    assert got == {r[1]: i + 1 for i, r in enumerate(order)}
