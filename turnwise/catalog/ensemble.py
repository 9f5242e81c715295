"""Vote, rank and confidence queries."""

from pyspark.sql import functions as F

from turnwise.catalog import query
from turnwise.catalog.bridges import SIGNALS, ITEM_WORDS, item_words, signals, table
from turnwise.operators import ensemble as ops
from turnwise.plans.blocks import ranked

R = F.round

VOTES = ITEM_WORDS + """,
votes AS (SELECT stream_id AS item, pos + 1 AS run, speaker AS value FROM item_words),
val AS (SELECT item, value, count(*) AS n, min(run) AS first FROM votes GROUP BY ALL),
maj AS (SELECT item, value AS winner, n / sum(n) OVER (PARTITION BY item) AS agreement, first AS representative,
          CAST(sum(n) OVER (PARTITION BY item) AS BIGINT) AS votes
        FROM val QUALIFY row_number() OVER (PARTITION BY item ORDER BY n DESC, first) = 1)"""


def _votes(spark, sf):
    return item_words(spark, sf).select(F.col("stream_id").alias("item"), (F.col("pos") + 1).alias("run"),
                                        F.col("speaker").alias("value"))


@query("scr11_majority", f"""
WITH {VOTES}
SELECT item, winner, round(agreement, 6) AS agreement, representative, votes, agreement >= 0.67 AS confident FROM maj""")
def scr11(spark, sf):
    return ops.majority(_votes(spark, sf), keys=["item"]).withColumn("agreement", R("agreement", 6))


@query("scr12_agreement_confidence", f"""
WITH {VOTES}
SELECT item, round(least(1, greatest(0, agreement - CASE WHEN agreement < 0.5 THEN (0.5 - agreement) * 0.5 ELSE 0 END
   + least(0.1, (votes - 2) * 0.02))), 6) AS confidence FROM maj""")
def scr12(spark, sf):
    m = ops.majority(_votes(spark, sf), keys=["item"])
    return m.select("item", R(ops.agreement_confidence(F.col("agreement"), F.col("votes")), 6).alias("confidence"))


@query("scr13_two_pass", """
SELECT doc_id AS item, quality = toxic AS agree, CASE WHEN quality = toxic THEN 0.9::DOUBLE ELSE 0.4::DOUBLE END AS confidence FROM labels""")
def scr13(spark, sf):
    rows = table(spark, sf, "labels").select(F.col("doc_id").alias("item"), F.posexplode(F.array("quality", "toxic")).alias("i", "value"))
    return ops.two_pass(rows.withColumn("run", F.col("i") + 1), keys=["item"]).select("item", "agree", "confidence")


PASSES = """
passes AS (SELECT stream_id, pos // 3 AS pair_no, pos AS run, value > 5 AS detected, speaker AS change_type FROM signals),
seen AS (SELECT stream_id, pair_no, avg(CASE WHEN detected THEN 1.0 ELSE 0.0 END) AS ca FROM passes GROUP BY ALL),
tv AS (SELECT stream_id, pair_no, change_type, count(*) AS n FROM passes GROUP BY ALL),
ta AS (SELECT stream_id, pair_no, max(n) / sum(n) AS ta FROM tv GROUP BY ALL),
checks AS (SELECT stream_id, pair_no, ca, ta, ca >= 0.67 AS ok FROM seen JOIN ta USING (stream_id, pair_no))"""


def _passes(spark, sf):
    return signals(spark, sf).select("stream_id", F.floor(F.col("pos") / 3).alias("pair_no"), F.col("pos").alias("run"),
                                     (F.col("value") > 5).alias("detected"), F.col("speaker").alias("change_type"))


@query("scr14_verify", f"""
WITH {SIGNALS}, {PASSES}
SELECT stream_id, pair_no, round(ca, 6) AS change_agreement, round(ta, 6) AS type_agreement, ok AS verified FROM checks""")
def scr14(spark, sf):
    out = ops.verify(_passes(spark, sf), keys=["stream_id", "pair_no"])
    return out.withColumn("change_agreement", R("change_agreement", 6)).withColumn("type_agreement", R("type_agreement", 6))


@query("scr15_change_events", f"""
WITH {SIGNALS}, {PASSES},
cmp AS (SELECT stream_id, pos // 3 AS pair_no, start + 30 AS t, (user_id % 10) / 10.3e0 AS conf, user_id % 5 AS u,
   CASE user_id % 4 WHEN 0 THEN 'New_Person' WHEN 1 THEN 'PERSON_LEFT' WHEN 2 THEN 'layout_change' ELSE 'NO_CHANGE' END AS kind
  FROM signals WHERE pos % 3 = 0 AND value > 2)
SELECT c.stream_id, c.pair_no, round(t, 4) AS time, lower(kind) AS event_type,
  CASE lower(kind) WHEN 'new_person' THEN CASE WHEN u = 0 THEN 'New person' ELSE 'Guest ' || u END || ' appeared'
    WHEN 'person_left' THEN CASE WHEN u = 0 THEN 'Someone' ELSE 'Guest ' || u END || ' left' ELSE 'Layout changed' END AS description,
  round(CASE WHEN ok IS NULL THEN conf WHEN ok THEN least(1, conf + (ca + ta) / 2 * 0.2) ELSE conf * 0.7 END * 0.9, 3) AS confidence
FROM cmp c LEFT JOIN (SELECT * FROM checks WHERE pair_no % 4 <> 0) k USING (stream_id, pair_no) WHERE kind <> 'NO_CHANGE'""")
def scr15(spark, sf):
    keys = ["stream_id", "pair_no"]
    checks = ops.verify(_passes(spark, sf), keys=keys).filter(F.col("pair_no") % 4 != 0)
    m = F.col("user_id") % 4
    cmp = signals(spark, sf).filter(F.col("pos") % 3 == 0).select(
        "stream_id", F.floor(F.col("pos") / 3).alias("pair_no"), (F.col("start") + 30).alias("later_time"),
        (F.col("user_id") % 10 / 10.3).alias("confidence"), (F.col("value") > 2).alias("detected"),
        F.when(m == 0, "New_Person").when(m == 1, "PERSON_LEFT").when(m == 2, "layout_change").otherwise("NO_CHANGE").alias("change_type"),
        F.when(F.col("user_id") % 5 != 0, F.concat(F.lit("Guest "), (F.col("user_id") % 5).cast("string"))).alias("who"))
    return ops.change_events(cmp, checks, keys=keys).withColumn("time", R("time", 4))


RANKS = """
ranks AS (
  SELECT o_custkey AS list_id, 'price' AS method, o_orderkey AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders
  UNION ALL SELECT o_custkey, 'date', o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) FROM orders
  UNION ALL SELECT o_custkey, 'number', o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) FROM orders WHERE o_orderkey % 3 <> 0)"""
WEIGHTS = {"price": 2.0, "date": 0.5}


def _ranks(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("list_id"), F.col("o_orderkey").alias("item"), F.col("o_totalprice").alias("price"),
        F.unix_date(F.col("o_orderdate").cast("date")).alias("day"))
    parts = [ranked(o, ["list_id"], -F.col("price"), ["item"], 50_000.0).withColumn("method", F.lit("price")),
             ranked(o, ["list_id"], F.col("day"), ["item"], 365.0).withColumn("method", F.lit("date")),
             ranked(o.filter("item % 3 <> 0"), ["list_id"], F.col("item"), ["item"], 100_000.0).withColumn("method", F.lit("number"))]
    cols = ["list_id", "method", "item", "rank"]
    return parts[0].select(*cols).unionByName(parts[1].select(*cols)).unionByName(parts[2].select(*cols))


@query("win10_method_ranks", f"""
WITH {RANKS}
SELECT * FROM ranks""")
def win10(spark, sf):
    return _ranks(spark, sf)


BORDA = RANKS + """,
sized AS (SELECT *, count(*) OVER (PARTITION BY list_id, method) AS size FROM ranks),
bor AS (SELECT list_id, item, sum((size - rank + 1) * CASE method WHEN 'price' THEN 2e0 WHEN 'date' THEN 5e-1 ELSE 1e0 END) AS borda,
   var_pop(rank) AS v, count(*) AS n, string_agg(method || '=' || rank, ',' ORDER BY method) AS method_ranks FROM sized GROUP BY ALL)"""


@query("scr16_borda", f"""
WITH {BORDA}
SELECT list_id, item, borda, row_number() OVER (PARTITION BY list_id ORDER BY borda DESC, item) AS final_rank, method_ranks FROM bor""")
def scr16(spark, sf):
    out = ops.borda(_ranks(spark, sf), WEIGHTS, keys=["list_id"], width=10.0)
    pairs = F.transform(F.map_entries("method_ranks"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return out.withColumn("method_ranks", F.array_join(pairs, ",")).select("list_id", "item", "borda", "final_rank", "method_ranks")


@query("scr17_rank_confidence", f"""
WITH {BORDA}
SELECT list_id, item, round(greatest(0, least(1, borda / max(borda) OVER (PARTITION BY list_id)
   - CASE WHEN n > 1 THEN least(0.3, v * 0.05) ELSE 0 END)), 6) AS confidence FROM bor""")
def scr17(spark, sf):
    out = ops.borda(_ranks(spark, sf), WEIGHTS, keys=["list_id"], width=10.0)
    return out.select("list_id", "item", R("confidence", 6).alias("confidence"))


@query("scr18_method_agreement", f"""
WITH {RANKS},
m AS (SELECT DISTINCT list_id, method FROM ranks),
c AS (SELECT a.list_id, a.method AS m1, b.method AS m2, count(*)::DOUBLE AS n, sum((a.rank - b.rank) * (a.rank - b.rank))::DOUBLE AS d2
      FROM ranks a JOIN ranks b ON a.list_id = b.list_id AND a.item = b.item AND a.method < b.method GROUP BY ALL),
p AS (SELECT x.list_id, CASE WHEN n > 1 THEN (1 - 6 * d2 / (n * (n * n - 1)) + 1) / 2 ELSE 0.5 END AS v
      FROM m x JOIN m y ON x.list_id = y.list_id AND x.method < y.method
      LEFT JOIN c ON c.list_id = x.list_id AND c.m1 = x.method AND c.m2 = y.method)
SELECT list_id, round(avg(v), 6) AS agreement FROM p GROUP BY list_id""")
def scr18(spark, sf):
    return ops.method_agreement(_ranks(spark, sf), keys=["list_id"]).withColumn("agreement", R("agreement", 6))


CALIBRATED = """
cal AS (SELECT stream_id, pos, (value % 10) / 10.07e0 AS raw, user_id % 5 AS n, (user_id % 11) / 1e1 AS a FROM signals),
cal2 AS (SELECT *, raw * 0.85::DOUBLE + CASE WHEN n > 1 THEN least(0.1::DOUBLE, (n - 1) * 0.03::DOUBLE) ELSE 0 END AS v FROM cal),
cal3 AS (SELECT *, greatest(0, least(1, CASE WHEN a >= 0.8 THEN least(1, v + 0.1::DOUBLE) WHEN a < 0.5 THEN greatest(0, v - 0.2::DOUBLE) ELSE v END)) AS c FROM cal2)"""


def _calibrated(spark, sf):
    value = ops.calibrate(F.col("value") % 10 / 10.07, F.col("user_id") % 5, F.col("user_id") % 11 / 10)
    return signals(spark, sf).select("stream_id", "pos", value.alias("confidence"))


@query("scr19_calibrate", f"""
WITH {SIGNALS}, {CALIBRATED}
SELECT stream_id, pos, round(c, 6) AS confidence FROM cal3""")
def scr19(spark, sf):
    return _calibrated(spark, sf).withColumn("confidence", R("confidence", 6))


@query("win12_rescale", f"""
WITH {SIGNALS}, {CALIBRATED},
b AS (SELECT *, min(c) OVER (PARTITION BY stream_id) AS lo, max(c) OVER (PARTITION BY stream_id) AS hi FROM cal3)
SELECT stream_id, pos, round(CASE WHEN hi > lo THEN 0.3e0 + 0.6e0 * ((c - lo) / (hi - lo)) ELSE c END, 3) AS confidence FROM b""")
def win12(spark, sf):
    return ops.rescale(_calibrated(spark, sf), keys=["stream_id"], value="confidence")


@query("agg14_usage_cost", """
SELECT user_id, count(*) AS calls, CAST(sum(event_id % 5000) AS BIGINT) AS input_tokens, CAST(sum(event_id % 700) AS BIGINT) AS output_tokens,
  round(sum(event_id % 5000) / 1e6 * 3.137e0 + sum(event_id % 700) / 1e6 * 15.913e0, 4) AS cost
FROM events GROUP BY ROLLUP (user_id)""")
def agg14(spark, sf):
    usage = table(spark, sf, "events").select("user_id", (F.col("event_id") % 5000).alias("input_tokens"),
                                              (F.col("event_id") % 700).alias("output_tokens"))
    return ops.usage_cost(usage, key="user_id", per_million_in=3.137, per_million_out=15.913)


@query("udf4_method_weights", f"""
WITH {RANKS},
wt AS (SELECT method, count(*) FILTER (WHERE rank = 1) * 1e0 AS weight FROM ranks WHERE method <> 'date' GROUP BY method),
sized AS (SELECT r.*, count(*) OVER (PARTITION BY list_id, r.method) AS size, coalesce(weight, 1) AS weight FROM ranks r LEFT JOIN wt USING (method)),
bor AS (SELECT list_id, item, sum((size - rank + 1) * weight) AS borda FROM sized GROUP BY ALL)
SELECT list_id, item, borda, row_number() OVER (PARTITION BY list_id ORDER BY borda DESC, item) AS final_rank FROM bor""")
def udf4(spark, sf):
    """Weights as a table: a method counts as much as it has lists."""
    ranks = _ranks(spark, sf)
    weights = ranks.filter("rank = 1 and method <> 'date'").groupBy("method").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return ops.borda(ranks, weights, keys=["list_id"], width=10_000.0).select("list_id", "item", "borda", "final_rank")
