"""Topic and word-set queries."""

from pyspark.sql import functions as F

from turnwise.catalog import query
from turnwise.catalog.bridges import SIGNALS, TOPIC_BLOCKS, TURNS, signals, table, topic_blocks, turns
from turnwise.catalog.windows import STAMP
from turnwise.functions import vectors
from turnwise.functions.text import overlap_coefficient, tokens, topic_words, word_set
from turnwise.operators import topics as ops
from turnwise.operators.selection import distinct_values

R = F.round
CONV = ["stream_id", "conv_id"]

WORDS_OF = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '[_\\s-]+'), lambda w: w NOT IN ('', 'the', 'a', 'an', 'of', 'in', 'on', 'and', 'or')))"
OVERLAP = "CASE WHEN len({0}) = 0 OR len({1}) = 0 THEN 0 ELSE len(list_intersect({0}, {1})) / least(len({0}), len({1})) END"
PAIRS = TOPIC_BLOCKS + f""",
topics AS (SELECT stream_id, conv_id, topic_id, arg_min(topic_name, (t_start, block_no)) AS topic_name,
             row_number() OVER (PARTITION BY stream_id, conv_id ORDER BY min((t_start, block_no))) AS ord
           FROM blocks GROUP BY stream_id, conv_id, topic_id),
worded AS (SELECT *, {WORDS_OF.format('topic_name')} AS n, {WORDS_OF.format('topic_id')} AS i FROM topics),
pairs AS (SELECT a.stream_id, a.conv_id, a.topic_id AS a_id, b.topic_id AS b_id, a.ord AS a_ord, b.ord AS b_ord,
            greatest({OVERLAP.format('a.n', 'b.n')}, {OVERLAP.format('a.i', 'b.i')}) AS similarity
          FROM worded a JOIN worded b ON a.stream_id = b.stream_id AND a.conv_id = b.conv_id AND a.ord < b.ord)"""


@query("join16_similar_topics", f"""
WITH {PAIRS}
SELECT stream_id, conv_id, a_id, b_id, round(similarity, 6) AS similarity FROM pairs WHERE similarity >= 0.7""")
def join16(spark, sf):
    pairs = ops.similar_topics(ops.distinct_topics(topic_blocks(spark, sf)))
    return pairs.select(*CONV, "a_id", "b_id", R("similarity", 6).alias("similarity"))


@query("seq9_merge_topics", f"""
WITH RECURSIVE {PAIRS},
walk AS (
  SELECT stream_id, conv_id, 0::BIGINT AS ord, [0]::BIGINT[] AS leads, NULL::BIGINT AS me FROM topics WHERE ord = 1
  UNION ALL
  SELECT w.stream_id, w.conv_id, t.ord,
    CASE WHEN f.lead IS NULL THEN list_append(w.leads, t.ord) ELSE w.leads END, coalesce(f.lead, t.ord)
  FROM walk w JOIN topics t ON t.stream_id = w.stream_id AND t.conv_id = w.conv_id AND t.ord = w.ord + 1
  LEFT JOIN LATERAL (SELECT min(p.a_ord) AS lead FROM pairs p WHERE p.stream_id = t.stream_id AND p.conv_id = t.conv_id
     AND p.b_ord = t.ord AND p.similarity >= 0.7 AND list_contains(w.leads, p.a_ord)) f ON true)
SELECT w.stream_id, w.conv_id, t.topic_id, l.topic_id AS canonical_id
FROM walk w JOIN topics t ON t.stream_id = w.stream_id AND t.conv_id = w.conv_id AND t.ord = w.ord
JOIN topics l ON l.stream_id = w.stream_id AND l.conv_id = w.conv_id AND l.ord = w.me""")
def seq9(spark, sf):
    topics = ops.distinct_topics(topic_blocks(spark, sf))
    return ops.merge_topics(topics, ops.similar_topics(topics))


@query("agg10_continuity", f"""
WITH {TOPIC_BLOCKS}
SELECT stream_id, conv_id, topic_id, count(*) AS occurrences, round(min(t_start), 4) AS first_start,
       round(max(t_end), 4) AS last_end, count(*) >= 2 AS recurring FROM blocks GROUP BY ALL""")
def agg10(spark, sf):
    return (ops.continuity(topic_blocks(spark, sf)).drop("recurrence")
            .withColumn("first_start", R("first_start", 4)).withColumn("last_end", R("last_end", 4)))


@query("agg21_recurrence", f"""
WITH {TOPIC_BLOCKS}
SELECT stream_id, conv_id, topic_id, CASE WHEN bool_or(sentiment IN ('heated', 'confrontational'))
   THEN 'escalation' ELSE 'returning' END AS recurrence
FROM blocks GROUP BY stream_id, conv_id, topic_id HAVING count(*) >= 2""")
def agg21(spark, sf):
    return (ops.continuity(topic_blocks(spark, sf)).filter("recurring")
            .select(*CONV, "topic_id", "recurrence"))


@query("agg11_topic_summary", f"""
WITH {TOPIC_BLOCKS},
n AS (SELECT stream_id, conv_id, topic_name, row_number() OVER (PARTITION BY stream_id, conv_id ORDER BY min((t_start, block_no))) AS r
      FROM blocks GROUP BY stream_id, conv_id, topic_name)
SELECT stream_id, conv_id, string_agg(topic_name, ', ' ORDER BY r) FILTER (WHERE r <= 3)
   || CASE WHEN count(*) > 3 THEN ', and ' || (count(*) - 3) || ' more' ELSE '' END AS summary
FROM n GROUP BY ALL""")
def agg11(spark, sf):
    return ops.topic_summary(topic_blocks(spark, sf), names=3)


@query("agg12_distinct_topics", f"""
WITH {TOPIC_BLOCKS}
SELECT stream_id, count(DISTINCT topic_id) AS topics FROM blocks GROUP BY stream_id""")
def agg12t(spark, sf):
    return distinct_values(topic_blocks(spark, sf), F.col("topic_id")).withColumnRenamed("n", "topics")


CLIP_SEGS = """
csegs AS (SELECT stream_id, user_id % 3 AS conv_id, pos // 4 AS clip_id, pos AS seg_no, start FROM signals WHERE speaker = 'view')"""


@query("join8_topics_of_segments", f"""
WITH {TOPIC_BLOCKS}, {CLIP_SEGS},
m AS (SELECT s.stream_id, s.conv_id, s.clip_id, b.topic_id, min((s.seg_no, b.t_start, b.block_no)) AS place
      FROM csegs s JOIN blocks b ON s.stream_id = b.stream_id AND s.conv_id = b.conv_id AND s.start >= b.t_start AND s.start < b.t_end
      WHERE s.clip_id % 5 <> 0 GROUP BY ALL)
SELECT stream_id, conv_id, clip_id, string_agg(topic_id, ',' ORDER BY place) AS topic_ids FROM m GROUP BY ALL""")
def join8(spark, sf):
    segs = signals(spark, sf).filter("speaker = 'view'").select(
        "stream_id", (F.col("user_id") % 3).alias("conv_id"), F.floor(F.col("pos") / 4).alias("clip_id"),
        F.col("pos").alias("seg_no"), "start")
    named = F.when(F.col("clip_id") % 5 == 0, F.array(F.lit("known"))).otherwise(F.array().cast("array<string>"))
    out = ops.topics_of_segments(segs.withColumn("topic_ids", named), topic_blocks(spark, sf))
    return out.withColumn("topic_ids", F.array_join("topic_ids", ","))


@query("join9_topic_references", f"""
WITH {TOPIC_BLOCKS},
clips AS (SELECT stream_id, conv_id, block_no AS clip_id, topic_id, t_start - 30 AS s, t_end + 30 AS e FROM blocks)
SELECT c.stream_id, c.conv_id, c.clip_id, b.topic_id, b.block_no,
  '[' || {STAMP.format('b.t_start')} || '-' || {STAMP.format('b.t_end')} || ']' AS time_range,
  '[' || {STAMP.format('greatest(0, b.t_start - 30)')} || '-' || {STAMP.format('(b.t_end + 30)')} || ']' AS lookup_range,
  CASE WHEN b.t_start > c.s THEN CASE WHEN sentiment IN ('heated', 'confrontational') THEN 'escalation' ELSE 'continuation' END
       ELSE CASE WHEN sentiment IN ('heated', 'confrontational') THEN 'prior_confrontation' ELSE 'prior_mention' END END AS relation
FROM clips c JOIN blocks b ON c.stream_id = b.stream_id AND c.conv_id = b.conv_id AND c.topic_id = b.topic_id
WHERE NOT (b.t_start >= c.s - 5 AND b.t_end <= c.e + 5)""")
def join9(spark, sf):
    blocks = topic_blocks(spark, sf)
    clips = blocks.select(
        *CONV, F.col("block_no").alias("clip_id"), "topic_id", (F.col("t_start") - 30).alias("start"),
        (F.col("t_end") + 30).alias("end"))
    return ops.topic_references(clips, blocks)


@query("join9_reference_totals", f"""
WITH {TOPIC_BLOCKS},
clips AS (SELECT stream_id, conv_id, block_no AS clip_id, topic_id, t_start - 30 AS s, t_end + 30 AS e FROM blocks),
refs AS (SELECT c.*, b.t_start > c.s AS later, sentiment IN ('heated', 'confrontational') AS hot, b.block_no IS NOT NULL AS found
         FROM clips c LEFT JOIN blocks b ON c.stream_id = b.stream_id AND c.conv_id = b.conv_id AND c.topic_id = b.topic_id
          AND NOT (b.t_start >= c.s - 5 AND b.t_end <= c.e + 5))
SELECT stream_id, conv_id, topic_id, clip_id, count(*) FILTER (found AND later AND hot) AS escalation, count(*) FILTER (found AND later AND NOT hot) AS continuation,
  count(*) FILTER (found AND NOT later AND hot) AS prior_confrontation, count(*) FILTER (found AND NOT later AND NOT hot) AS prior_mention
FROM refs GROUP BY ALL""")
def join9_totals(spark, sf):
    blocks = topic_blocks(spark, sf)
    clips = blocks.select(
        *CONV, F.col("block_no").alias("clip_id"), "topic_id", (F.col("t_start") - 30).alias("start"),
        (F.col("t_end") + 30).alias("end"))
    return ops.topic_reference_totals(clips, blocks, block_seconds=86_400.0)


@query("join10_conversation_members", f"""
WITH {TOPIC_BLOCKS},
t AS (SELECT stream_id, conv_id, count(DISTINCT topic_id) AS topics FROM blocks GROUP BY ALL)
SELECT s.stream_id, s.pos, user_id % 3 AS conv_id, coalesce(topics, 0) AS topics
FROM signals s LEFT JOIN t ON s.stream_id = t.stream_id AND s.user_id % 3 = t.conv_id""")
def join10(spark, sf):
    known = topic_blocks(spark, sf).groupBy(*CONV).agg(F.count_distinct("topic_id").alias("topics"))
    members = signals(spark, sf).select("stream_id", "pos", (F.col("user_id") % 3).alias("conv_id"))
    return (members.join(known, CONV, "left").withColumn("topics", F.coalesce("topics", F.lit(0))))


@query("fn7_overlap_coefficient", f"""
WITH {TURNS},
w AS (SELECT stream_id, idx, list_distinct(regexp_extract_all(lower(text), '\\S+')) AS a,
        lead(list_distinct(regexp_extract_all(lower(text), '\\S+'))) OVER (PARTITION BY stream_id ORDER BY idx) AS b FROM turns)
SELECT stream_id, idx, round({OVERLAP.format('a', 'b')}, 6) AS overlap FROM w WHERE b IS NOT NULL""")
def fn7(spark, sf):
    from turnwise.plans.blocks import by_position, neighbours
    rows = neighbours(turns(spark, sf).withColumn("a", word_set(F.col("text"))), ["stream_id"], ["idx"],
                      by_position("idx", 10_000), after={"b": F.col("a")})
    return rows.filter(F.col("b").isNotNull()).select(
        "stream_id", "idx", R(overlap_coefficient(F.col("a"), F.col("b")), 6).alias("overlap"))


# Vectors stand for topics; eight of them in a row make a conversation.
VECTORS = """
vec AS (SELECT vec_id // 8 AS conv_id, vec_id AS ord, embedding::DOUBLE[] AS v FROM embeddings)"""


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(
        F.lit(0).cast("long").alias("stream_id"), F.floor(F.col("vec_id") / 8).alias("conv_id"),
        F.col("vec_id").cast("string").alias("topic_id"), F.col("vec_id").alias("ord"),
        F.col("embedding").alias("vector"), "label")


@query("fn8_cosine_pairs", f"""
WITH {VECTORS}
SELECT a.conv_id, CAST(a.ord AS VARCHAR) AS a_id, CAST(b.ord AS VARCHAR) AS b_id,
  round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)) + 1e-9), 6) AS similarity
FROM vec a JOIN vec b ON a.conv_id = b.conv_id AND a.ord < b.ord
WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)) + 1e-9) >= 0.15""")
def fn8(spark, sf):
    pairs = ops.similar_vectors(_vectors(spark, sf), threshold=0.15)
    return pairs.select("conv_id", "a_id", "b_id", R("similarity", 6).alias("similarity"))


@query("fn9_similarity_choice", f"""
WITH vec AS (SELECT vec_id, label, CASE WHEN vec_id % 3 <> 0 THEN embedding::DOUBLE[] END AS v FROM embeddings),
p AS (SELECT a.vec_id, a.v AS va, b.v AS vb, a.label AS la, b.label AS lb FROM vec a JOIN vec b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(coalesce(list_dot_product(va, vb) / (sqrt(list_dot_product(va, va)) * sqrt(list_dot_product(vb, vb)) + 1e-9),
   CASE WHEN la = lb THEN 1 ELSE 0.5 END), 6) AS similarity FROM p""")
def fn9(spark, sf):
    base = table(spark, sf, "embeddings").withColumn("v", F.when(F.col("vec_id") % 3 != 0, F.col("embedding")))
    name = F.concat(F.lit("topic "), F.col("label").cast("string"))
    a = base.select("vec_id", F.col("v").alias("va"), name.alias("na"))
    b = base.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("vb"), name.alias("nb"))
    words = overlap_coefficient(topic_words(F.col("na"), ops.FILLERS), topic_words(F.col("nb"), ops.FILLERS))
    return a.join(b, "vec_id").select(
        "vec_id", R(vectors.similarity(F.col("va"), F.col("vb"), words), 6).alias("similarity"))


@query("set1_union_tabs", """
SELECT o_orderkey AS row_no, 'orders' AS sheet, o_orderstatus AS status, NULL AS owner, o_totalprice AS amount FROM orders
UNION ALL BY NAME SELECT c_custkey AS row_no, 'customers' AS sheet, c_mktsegment AS owner FROM customer""")
def set1(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_no"), F.lit("orders").alias("sheet"),
                                          F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("amount"))
    b = table(spark, sf, "customer").select(F.col("c_custkey").alias("row_no"), F.lit("customers").alias("sheet"),
                                            F.col("c_mktsegment").alias("owner"))
    return a.unionByName(b, allowMissingColumns=True)


ASKED = ["the", "and", "la", "und", "which", "des"]


@query("set2_word_hits", f"""
WITH {TURNS},
t AS (SELECT DISTINCT stream_id, unnest(regexp_extract_all(lower(text), '\\S+')) AS term FROM turns)
SELECT stream_id, count(*) AS overlap FROM t WHERE term IN ({', '.join(repr(a) for a in ASKED)}) GROUP BY stream_id""")
def set2(spark, sf):
    rows = turns(spark, sf).select("stream_id", F.explode(tokens(F.lower("text"))).alias("term"))
    asked = spark.createDataFrame([(a,) for a in ASKED], "term string")
    return ops.word_hits(rows, asked, keys=["stream_id"])


@query("set3_ordered_distinct", f"""
WITH {TOPIC_BLOCKS},
n AS (SELECT stream_id, topic_name, min((t_start, block_no)) AS place FROM blocks GROUP BY ALL)
SELECT stream_id, string_agg(topic_name, '|' ORDER BY place) AS names FROM n GROUP BY stream_id""")
def set3(spark, sf):
    firsts = topic_blocks(spark, sf).groupBy("stream_id", "topic_name").agg(
        F.min(F.struct("t_start", "block_no")).alias("at"))
    rows = F.array_sort(F.collect_list(F.struct("at", "topic_name")))
    return firsts.groupBy("stream_id").agg(
        F.array_join(F.transform(rows, lambda x: x["topic_name"]), "|").alias("names"))


@query("set4_without_stop_words", f"""
WITH {TURNS}
SELECT stream_id, idx, len(list_filter(list_distinct(regexp_extract_all(lower(text), '\\S+')),
   lambda w: w NOT IN ({', '.join(repr(a) for a in ASKED)}))) AS words FROM turns""")
def set4(spark, sf):
    stop = F.array(*[F.lit(a) for a in ASKED])
    return turns(spark, sf).select(
        "stream_id", "idx", F.size(F.array_except(word_set(F.col("text")), stop)).cast("long").alias("words"))
