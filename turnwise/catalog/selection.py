"""Selection queries."""

from pyspark.sql import functions as F

from turnwise.catalog import query
from turnwise.catalog.bridges import (CANDIDATES, CHAT_WORDS, ITEM_WORDS, SIGNALS, TURNS, candidates,
                                      chat_words, item_words, signals, table, turns)
from turnwise.catalog.scratch import folder
from turnwise.functions.text import tokens
from turnwise.operators import quotes as quote_ops
from turnwise.operators import selection as ops
from turnwise.operators import turns as talk
from turnwise.plans.blocks import by_time

R = F.round

QUOTES = r"""
quotes AS (SELECT stream_id, idx AS quote_id, CASE WHEN len(w) < 12 THEN CASE WHEN idx % 2 = 0 THEN w[2] ELSE right(w[2], 2) || ' ' || left(w[3], 2) END
    WHEN (stream_id + idx) % 3 = 0 THEN w[3] || ' zzz ' || w[6] WHEN (stream_id + idx) % 3 = 1 THEN array_to_string(w[3:10], '  ')
    ELSE substr(array_to_string(w[3:9], ' '), 2) END AS quote
  FROM (SELECT stream_id, idx, regexp_extract_all(text, '\S+') AS w FROM turns) WHERE len(w) >= 3)"""


def _quotes(spark, sf):
    """A quote from every turn: a word or parts of two of a short one, else a stretch, some of which occur nowhere."""
    m = (F.col("stream_id") + F.col("idx")) % 3
    t = turns(spark, sf).withColumn("w", tokens(F.col("text"))).filter(F.size("w") >= 3)
    second, third = F.col("w")[1], F.col("w")[2]
    short = F.when(F.col("idx") % 2 == 0, second).otherwise(F.concat(F.right(second, F.lit(2)), F.lit(" "), F.left(third, F.lit(2))))
    return t.select("stream_id", F.col("idx").alias("quote_id"), F.when(F.size("w") < 12, short)
                    .when(m == 0, F.concat(third, F.lit(" zzz "), F.get("w", F.lit(5))))
                    .when(m == 1, F.array_join(F.slice("w", 3, 8), "  "))
                    .otherwise(F.expr("substr(array_join(slice(w, 3, 7), ' '), 2)")).alias("quote"))


ANCHORS = rf"""
WITH {CHAT_WORDS}, {QUOTES},
qn AS (SELECT *, lower(trim(regexp_replace(quote, '\s+', ' ', 'g'))) AS q FROM quotes),
txt AS (SELECT stream_id, pos, start, lower(string_agg(text, ' ') OVER w) AS win5,
          sum(length(text) + 1) OVER (PARTITION BY stream_id ORDER BY pos) - length(text) - 1 AS off,
          count(*) OVER (PARTITION BY stream_id) AS n
        FROM words WINDOW w AS (PARTITION BY stream_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
full_text AS (SELECT stream_id, lower(string_agg(text, ' ' ORDER BY pos)) AS body FROM words GROUP BY stream_id),
ex AS (SELECT q.stream_id, q.quote_id, min(t.pos) AS pos FROM qn q JOIN full_text f USING (stream_id)
       JOIN txt t ON t.stream_id = q.stream_id AND t.off >= instr(f.body, q.q) - 1 WHERE instr(f.body, q.q) > 0 GROUP BY ALL),
lo AS (SELECT q.stream_id, q.quote_id, min(t.pos) AS pos FROM qn q JOIN txt t ON t.stream_id = q.stream_id AND t.pos <= t.n - 3
         AND contains(t.win5, split_part(q.q, ' ', 1)) AND contains(t.win5, split_part(q.q, ' ', -1))
       WHERE len(string_split(q.q, ' ')) >= 3 AND NOT EXISTS (SELECT 1 FROM ex WHERE ex.stream_id = q.stream_id AND ex.quote_id = q.quote_id) GROUP BY ALL),
both_ways AS (SELECT *, 'exact' AS how FROM ex UNION ALL SELECT *, 'loose' FROM lo)
SELECT q.stream_id, q.quote_id, how, round(t.start, 4) AS time FROM qn q
LEFT JOIN both_ways b USING (stream_id, quote_id) LEFT JOIN txt t ON t.stream_id = b.stream_id AND t.pos = b.pos"""


@query("join14_anchor_quotes", ANCHORS)
def join14(spark, sf):
    return (quote_ops.anchor_quotes(_quotes(spark, sf), chat_words(spark, sf))
            .select("stream_id", "quote_id", "how", R("time", 4).alias("time")))


@query("join14_indexed_quotes", ANCHORS)
def join14_indexed(spark, sf):
    """The same from an index of the texts that is written once; quotes are asked for in two batches."""
    index = quote_ops.QuoteIndex.build(chat_words(spark, sf), folder(spark, "join14"))
    quotes = _quotes(spark, sf)
    odd = F.pmod(F.col("quote_id"), F.lit(2)) == 1
    out = index.anchor(quotes.filter(odd)).unionByName(index.anchor(quotes.filter(~odd)))
    return out.select("stream_id", "quote_id", "how", R("time", 4).alias("time"))


@query("join14_quotes_in_documents", r"""
WITH d AS (SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS body FROM documents),
q AS (SELECT item_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS q FROM benchmark)
SELECT item_id, doc_id, instr(body, q) - 1 AS "offset" FROM q JOIN d ON contains(body, q)""")
def join14_docs(spark, sf):
    return quote_ops.quotes_in_documents(table(spark, sf, "benchmark"), table(spark, sf, "documents"))


@query("join15_overlap_pairs", f"""
WITH {CANDIDATES}
SELECT a.stream_id, a.cand_id AS a_id, b.cand_id AS b_id, least(a."end", b."end") - greatest(a.start, b.start) AS overlap
FROM candidates a JOIN candidates b ON a.stream_id = b.stream_id AND a.cand_id <> b.cand_id
 AND least(a."end", b."end") - greatest(a.start, b.start) > (a."end" - a.start) * 0.3""")
def join15(spark, sf):
    return ops.overlap_pairs(candidates(spark, sf), clip_id="cand_id", width=5000.0)


def _suppress_sql(key, share):
    return f"""
n AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, cand_id) AS k FROM pool),
walk AS (
  SELECT {key} AS grp, k, [{{'s': start, 'e': "end", 'id': cand_id}}] AS kept FROM n WHERE k = 1
  UNION ALL
  SELECT w.grp, x.k, CASE WHEN len(list_filter(w.kept, lambda o: least(o.e, x."end") - greatest(o.s, x.start) > (x."end" - x.start) * {share})) > 0
     THEN w.kept ELSE list_append(w.kept, {{'s': x.start, 'e': x."end", 'id': x.cand_id}}) END
  FROM walk w JOIN n x ON x.{key} = w.grp AND x.k = w.k + 1),
kept AS (SELECT unnest(max_by(kept, k)).id AS cand_id FROM walk GROUP BY grp)"""


@query("seq6_drop_overlaps", f"""
WITH RECURSIVE {CANDIDATES}, pool AS (SELECT * FROM candidates), {_suppress_sql('stream_id', 0.3)}
SELECT c.stream_id, c.cand_id FROM candidates c JOIN kept USING (cand_id)""")
def seq6(spark, sf):
    return ops.drop_overlaps(candidates(spark, sf), clip_id="cand_id", block_seconds=86_400.0).select("stream_id", "cand_id")


@query("seq6_drop_overlaps_by_half", f"""
WITH RECURSIVE {CANDIDATES}, pool AS (SELECT *, stream_id % 50 AS g FROM candidates), {_suppress_sql('g', 0.5)}
SELECT c.stream_id % 50 AS grp, c.cand_id FROM candidates c JOIN kept USING (cand_id)""")
def seq6_half(spark, sf):
    pool = candidates(spark, sf).withColumn("grp", F.col("stream_id") % 50)
    return ops.drop_overlaps(pool, clip_id="cand_id", keys=["grp"], share=0.5, block_seconds=86_400.0,
                             width=3000.0).select("grp", "cand_id")


@query("seq6_drop_overlapping_parts", f"""
WITH RECURSIVE {CANDIDATES},
parts AS (SELECT *, [{{'s': start, 'e': "end"}}, {{'s': start + 2880 + "end" - start, 'e': start + 2880 + ("end" - start) * 1.5e0}}] AS segs FROM candidates),
n AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY score DESC, cand_id) AS k FROM parts),
walk AS (
  SELECT stream_id, k, segs AS kept, true AS stays FROM n WHERE k = 1
  UNION ALL
  SELECT stream_id, k, CASE WHEN hit THEN kept ELSE list_concat(kept, segs) END, NOT hit FROM (
    SELECT x.stream_id, x.k, w.kept, x.segs, len(list_filter(w.kept, lambda o: least(o.e, x.segs[1].e) - greatest(o.s, x.segs[1].s) > (x.segs[1].e - x.segs[1].s) * 0.3
       OR least(o.e, x.segs[2].e) - greatest(o.s, x.segs[2].s) > (x.segs[2].e - x.segs[2].s) * 0.3)) > 0 AS hit
    FROM walk w JOIN n x ON x.stream_id = w.stream_id AND x.k = w.k + 1))
SELECT stream_id, cand_id FROM n JOIN walk USING (stream_id, k) WHERE stays""")
def seq6_parts(spark, sf):
    """Clips of two parts: order and, two days later, half of it again."""
    part = F.struct(F.col("start").alias("start"), F.col("end").alias("end"))
    again = F.struct((F.col("start") + 2880 + F.col("end") - F.col("start")).alias("start"),
                     (F.col("start") + 2880 + (F.col("end") - F.col("start")) * 1.5).alias("end"))
    return ops.drop_overlaps(candidates(spark, sf), clip_id="cand_id", segments=F.array(part, again),
                             block_seconds=86_400.0).select("stream_id", "cand_id")


@query("seq7_merge_events", f"""
WITH RECURSIVE {SIGNALS},
ev AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY start, pos) AS k, user_id % 2 AS kind,
         ['red coat tall', 'red hat', 'grey coat', 'tall man grey'][user_id % 4 + 1] AS description, (value % 10) / 10 AS conf FROM signals),
walk AS (
  SELECT stream_id, k, pos, start, kind, description, conf, 1 AS merged, false AS opened, NULL::BIGINT AS done_pos, NULL::DOUBLE AS done_conf, NULL::INTEGER AS done_n
  FROM ev WHERE k = 1
  UNION ALL
  SELECT e.stream_id, e.k, CASE WHEN eats THEN w.pos ELSE e.pos END, CASE WHEN eats THEN w.start ELSE e.start END,
    CASE WHEN eats THEN w.kind ELSE e.kind END, CASE WHEN eats THEN w.description ELSE e.description END,
    CASE WHEN eats THEN greatest(w.conf, e.conf) ELSE e.conf END, CASE WHEN eats THEN w.merged + 1 ELSE 1 END, NOT eats,
    CASE WHEN NOT eats THEN w.pos END, CASE WHEN NOT eats THEN w.conf END, CASE WHEN NOT eats THEN w.merged END
  FROM (SELECT w.*, x.k AS xk, w.kind = x.kind AND x.start - w.start <= 1200 AND
          len(list_intersect(string_split(w.description, ' '), string_split(x.description, ' ')))
            / least(len(string_split(w.description, ' ')), len(string_split(x.description, ' '))) >= 0.5 AS eats
        FROM walk w JOIN ev x ON x.stream_id = w.stream_id AND x.k = w.k + 1) w
  JOIN ev e ON e.stream_id = w.stream_id AND e.k = w.xk),
fin AS (SELECT stream_id, done_pos AS pos, done_conf AS conf, done_n AS merged FROM walk WHERE done_pos IS NOT NULL
  UNION ALL SELECT stream_id, max_by(pos, k), max_by(conf, k), max_by(merged, k) FROM walk GROUP BY stream_id)
SELECT stream_id, pos, round(conf, 6) AS confidence, CAST(merged AS BIGINT) AS merged FROM fin""")
def seq7(spark, sf):
    words = F.array(*[F.lit(d) for d in ("red coat tall", "red hat", "grey coat", "tall man grey")])
    ev = signals(spark, sf).select(
        "stream_id", "pos", F.col("start").alias("time"), (F.col("user_id") % 2).cast("string").alias("event_type"),
        F.element_at(words, (F.col("user_id") % 4 + 1).cast("int")).alias("description"), (F.col("value") % 10 / 10).alias("confidence"))
    out = ops.merge_events(ev, within=1200.0)
    return out.select("stream_id", "pos", R("confidence", 6).alias("confidence"), "merged")


@query("seq10_natural_ends", f"""
WITH {CHAT_WORDS},
lw AS (SELECT *, max("end") OVER (PARTITION BY stream_id) AS last_end FROM (SELECT *, start + CASE WHEN pos % 37 > 30 THEN 1.5e0 ELSE 0 END AS s2 FROM words)),
ww AS (SELECT stream_id, pos, start + floor(pos / 40) * 3 AS s, "end" + floor(pos / 40) * 3 AS e, speaker FROM words),
li AS (SELECT *, lag(speaker) OVER w AS pw, lag(s) OVER w AS ps, lead(speaker) OVER w AS nw, lead(s) OVER w AS ns FROM ww WINDOW w AS (PARTITION BY stream_id ORDER BY pos)),
clips AS (SELECT stream_id, idx AS clip_id, start + 20 AS cs, start + 60 AS ce, start + 30 AS anchor FROM turns),
f AS (SELECT c.stream_id, c.clip_id, max(CASE WHEN s < cs AND ps >= cs - 30 AND pw IS DISTINCT FROM speaker THEN s END) AS ns2,
        arg_min(CASE WHEN s >= greatest(anchor + 20, ce - 10) AND ns <= ce + 30 AND (ns - e > 1 OR nw IS DISTINCT FROM speaker) THEN e END,
                CASE WHEN s >= greatest(anchor + 20, ce - 10) AND ns <= ce + 30 AND (ns - e > 1 OR nw IS DISTINCT FROM speaker) THEN pos END) AS ne2, 1 AS near
      FROM clips c JOIN li ON li.stream_id = c.stream_id AND li.s BETWEEN cs - 30 AND ce + 30 GROUP BY ALL),
z AS (SELECT c.*, near, coalesce(ns2, cs) AS a, coalesce(ne2 + 0.5, ce) AS b, (SELECT max(e) FROM ww WHERE ww.stream_id = c.stream_id) AS last
      FROM clips c LEFT JOIN f USING (stream_id, clip_id))
SELECT stream_id, clip_id, round(a, 4) AS new_start,
  round(CASE WHEN near IS NULL THEN ce ELSE least(CASE WHEN b - a < 45 THEN a + 60 ELSE b END, last) END, 4) AS new_end FROM z""")
def seq10(spark, sf):
    w = chat_words(spark, sf)
    late = F.floor(F.col("pos") / 40) * 3
    w = w.withColumn("start", F.col("start") + late).withColumn("end", F.col("end") + late)
    clips = turns(spark, sf).select("stream_id", F.col("idx").alias("clip_id"), (F.col("start") + 20).alias("s"),
                                    (F.col("start") + 60).alias("end"), (F.col("start") + 30).alias("anchor"))
    out = ops.natural_ends(clips.withColumnRenamed("s", "start"), w, clip_id="clip_id", block=by_time("start", 60))
    return out.select("stream_id", "clip_id", R("new_start", 4).alias("new_start"), R("new_end", 4).alias("new_end"))


@query("top5_time_order", f"""
WITH {ITEM_WORDS}
SELECT stream_id, pos, start FROM item_words ORDER BY stream_id, start, pos""")
def top5(spark, sf):
    return item_words(spark, sf).select("stream_id", "pos", "start").orderBy("stream_id", "start", "pos")


@query("top6_variety_cap", f"""
WITH {CANDIDATES}
SELECT stream_id, priority, cand_id, row_number() OVER (PARTITION BY stream_id, priority ORDER BY score DESC, cand_id) AS rank
FROM candidates QUALIFY rank <= 3""")
def top6(spark, sf):
    return (talk.top_per_stream(candidates(spark, sf), [F.desc("score"), F.asc("cand_id")], 3, keys=["stream_id", "priority"])
            .select("stream_id", "priority", "cand_id", "rank"))


@query("top1_best_clips", f"""
WITH {CANDIDATES}
SELECT stream_id, cand_id, row_number() OVER (PARTITION BY stream_id ORDER BY score DESC, cand_id) AS rank
FROM candidates QUALIFY rank <= 5""")
def top1_clips(spark, sf):
    return (talk.top_per_stream(candidates(spark, sf), [F.desc("score"), F.asc("cand_id")], 5)
            .select("stream_id", "cand_id", "rank"))


@query("agg9_clip_summary", f"""
WITH {CANDIDATES}
SELECT stream_id, priority, count(*) AS clips, round(avg(score), 6) AS mean_score
FROM candidates WHERE score >= 40 GROUP BY GROUPING SETS ((), (stream_id), (priority))""")
def agg9(spark, sf):
    out = ops.clip_summary(candidates(spark, sf).filter("score >= 40"), conv="stream_id", kind="priority", score="score")
    return out.withColumn("mean_score", R("mean_score", 6))


@query("agg18_cut_summary", f"""
WITH {CANDIDATES}
SELECT stream_id, count(*) AS total, count(*) FILTER (WHERE status <> 'P') AS successful, count(*) FILTER (WHERE status = 'P') AS failed,
       CAST(sum("end" - start) AS DOUBLE) AS size_mb FROM candidates GROUP BY stream_id""")
def agg18(spark, sf):
    cuts = candidates(spark, sf).select("stream_id", F.when(F.col("status") == "P", "failed").otherwise("success").alias("status"),
                                        (F.col("end") - F.col("start")).alias("size_mb"))
    return ops.cut_summary(cuts)
