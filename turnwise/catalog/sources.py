"""Source and sink queries: write with Spark what a reader expects, and read it back."""

from pyspark.sql import functions as F

from turnwise.catalog import query
from turnwise.catalog.bridges import (CANDIDATES, CHAT_WORDS, SEGMENTS, TOPIC_BLOCKS, TURNS, candidates, chat_words,
                                      segments, table, topic_blocks, turns)
from turnwise.catalog.conversations import CONVS, event_conversations
from turnwise.catalog.scratch import folder
from turnwise.catalog.windows import LINE, STAMP
from turnwise.operators.scoring import composite
from turnwise.sinks import documents as sinks
from turnwise.sources import jobs, stages, transcripts

R = F.round


@query("src1_read_words", f"""
WITH {CHAT_WORDS}
SELECT stream_id, pos, text AS word, round(start, 4) AS start, round("end", 4) AS "end",
       CASE stream_id % 3 WHEN 2 THEN speaker ELSE CAST(idx % 2 AS VARCHAR) END AS speaker FROM words""")
def src1(spark, sf):
    words = chat_words(spark, sf)
    word = F.struct(F.col("text").alias("word"), "start", "end", (F.col("idx") % 2).alias("speaker"))
    def listed(df):
        rows = F.array_sort(F.collect_list(F.struct("pos", word.alias("w"))))
        return df.agg(F.transform(rows, lambda r: r["w"]).alias("words"))
    root = folder(spark, "src1")
    m = F.col("stream_id") % 3
    listed(words.filter(m == 0).groupBy("stream_id")).write.json(f"{root}/flat")
    (listed(words.filter(m == 1).groupBy("stream_id"))
     .select("stream_id", F.struct(F.array(F.struct(F.array(F.struct("words")).alias("alternatives"))).alias("channels")).alias("results"))
     .write.json(f"{root}/nested"))
    (listed(words.filter(m == 2).groupBy("stream_id", "idx", "speaker")).groupBy("stream_id")
     .agg(F.array_sort(F.collect_list(F.struct("idx", "speaker", "words"))).alias("utterances")).write.json(f"{root}/spoken"))
    out = transcripts.read_words(spark, [f"{root}/{d}" for d in ("flat", "nested", "spoken")])
    return out.select("stream_id", "pos", "word", R("start", 4).alias("start"), R("end", 4).alias("end"), "speaker")


@query("src2_normalize_words", f"""
WITH {CHAT_WORDS}
SELECT stream_id, pos, CASE WHEN pos % 3 = 0 THEN text || '.' ELSE text END AS text, round(start, 4) AS start,
  CASE WHEN pos % 5 = 0 THEN 0 ELSE round("end", 4) END AS "end", CAST(0 AS DOUBLE) AS confidence, speaker FROM words""")
def src2(spark, sf):
    raw = chat_words(spark, sf).select(
        "stream_id", "pos", F.when(F.col("pos") % 3 == 0, F.concat("text", F.lit("."))).alias("punctuated_word"), F.col("text").alias("word"),
        F.col("start").cast("string").alias("start"), F.when(F.col("pos") % 5 != 0, F.col("end").cast("string")).alias("end"),
        F.lit("n/a").alias("confidence"), "speaker")
    out = transcripts.normalize_words(raw)
    return out.withColumn("start", R("start", 4)).withColumn("end", R("end", 4))


@query("src3_read_text_turns", f"""
WITH {TURNS}
SELECT stream_id, idx, speaker, floor(start) AS start, round(floor(start) + word_count * 3e-1, 4) AS "end",
       trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g')) AS text, word_count FROM turns""")
def src3(spark, sf):
    path = folder(spark, "src3")
    sinks.write_transcript(turns(spark, sf), path)
    out, _ = transcripts.read_text_turns(spark, path)
    return out.withColumn("end", R("end", 4))


@query("src3_rejected_lines", f"""
WITH {TURNS}
SELECT stream_id, '[' || idx || ' broken' AS line FROM turns WHERE idx % 3 = 1""")
def src3_rejects(spark, sf):
    lines = turns(spark, sf).select("stream_id", "idx", F.when(F.col("idx") % 3 == 1, F.format_string("[%d broken", "idx"))
                                    .when(F.col("idx") % 3 == 2, F.lit("a note")).otherwise(F.lit("[0:00:10] host: well then")).alias("value"))
    return transcripts.parse_turn_lines(lines, ["idx"], F.floor(F.col("idx") / 1000))[1]


@query("src4_read_segments", f"""
WITH {SEGMENTS}
SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY seg_start, seg_pos) - 1 AS seg_pos, seg_speaker,
   round(seg_start, 4) AS seg_start, round(seg_end, 4) AS seg_end, CAST(CASE seg_pos % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 0.25 ELSE 1 END AS DOUBLE) AS confidence FROM segs""")
def src4(spark, sf):
    m = F.col("seg_pos") % 3
    keys = F.struct("seg_pos", *[F.when(m == i, F.col(c)).alias(k) for i, c, k in (
        (0, "seg_start", "start"), (1, "seg_start", "startTime"), (2, "seg_start", "begin"), (0, "seg_end", "end"), (1, "seg_end", "endTime"),
        (2, "seg_end", "stop"), (0, "seg_speaker", "speaker"))], F.when(m > 0, F.col("seg_speaker")).alias("label"),
        F.when(m == 0, 0.5).alias("confidence"), F.when(m == 1, 0.25).alias("score"))
    path = folder(spark, "src4")
    (segments(spark, sf).groupBy("stream_id").agg(F.array_sort(F.collect_list(keys)).alias("segments")).write.json(path))
    out = transcripts.read_segments(spark, path)
    return out.withColumn("seg_start", R("seg_start", 4)).withColumn("seg_end", R("seg_end", 4))


@query("src5_turns_from_chat", f"""
WITH {TURNS}
SELECT stream_id, idx, speaker, round(start, 4) AS start, round("end", 4) AS "end", word_count FROM turns""")
def src5(spark, sf):
    return turns(spark, sf).select("stream_id", "idx", "speaker", R("start", 4).alias("start"), R("end", 4).alias("end"), "word_count")


@query("src6_stage_round_trip", f"""
WITH {TOPIC_BLOCKS}
SELECT stream_id, conv_id, block_no, topic_id, topic_name, round(t_start, 4) AS t_start, sentiment FROM blocks""")
def src6(spark, sf):
    root = folder(spark, "src6")
    stages.save_stage(topic_blocks(spark, sf), root, "topic_blocks")
    out = stages.load_stage(spark, root, "topic_blocks")
    return out.select("stream_id", "conv_id", "block_no", "topic_id", "topic_name", R("t_start", 4).alias("t_start"), "sentiment")


LAYOUT = stages.Layout(buckets=8, by=("idx",), era_seconds=60.0)


def _turn_stages(spark, sf):
    """Turns and figures of them as two stages of one layout."""
    root = folder(spark, "src6")
    rows = turns(spark, sf)
    stages.save_stage(rows.select("stream_id", "idx", "start", "end", "speaker"), root, "turns", layout=LAYOUT)
    stages.save_stage(rows.select("stream_id", "idx", "start", F.length("text").alias("chars")), root, "figures", layout=LAYOUT)
    return [stages.load_stage(spark, root, name, layout=True) for name in ("turns", "figures")]


@query("src6_stage_slice", f"""
WITH {TURNS}
SELECT stream_id, idx, 'closed' AS kind FROM turns WHERE start BETWEEN 30 AND 90
UNION ALL SELECT stream_id, idx, 'half open' FROM turns WHERE start >= 60 AND start < 120
UNION ALL SELECT stream_id, idx, 'slack' FROM turns WHERE start >= 30 AND "end" <= 92 AND start <= 90""")
def src6_slice(spark, sf):
    """Slices of a laid-out stage: only folders of the asked minutes are read."""
    stage, _ = _turn_stages(spark, sf)
    parts = [("closed", stages.slice_stage(stage, LAYOUT, 30, 90)), ("half open", stages.slice_stage(stage, LAYOUT, 60, 120, half_open=True)),
             ("slack", stages.slice_stage(stage, LAYOUT, 30, 90, slack=2))]
    kinds = [df.select("stream_id", "idx", F.lit(kind).alias("kind")) for kind, df in parts]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2])


@query("src6_stage_join", f"""
WITH {TURNS}
SELECT stream_id, idx, speaker, length(text) AS chars FROM turns""")
def src6_join(spark, sf):
    """Two stages of one layout, joined where they lie."""
    left, right = _turn_stages(spark, sf)
    return stages.join_stages(left, right.drop("start"), LAYOUT).select("stream_id", "idx", "speaker", "chars")


@query("src7_profile_scores", f"""
WITH {CANDIDATES}, r AS (SELECT r_name, length(r_name) AS n, r_regionkey AS k FROM region)
SELECT cand_id, round((SELECT sum(n * (cand_id % 10 + k % 2)) / sum(n) * 10 FROM r) + CASE WHEN "end" - start BETWEEN 100 AND 2000 THEN 3 WHEN "end" - start > 4000 THEN -10 ELSE 0 END, 4) AS composite
FROM candidates""")
def src7(spark, sf):
    path = folder(spark, "src7")
    entry = F.struct("r_name", F.struct(F.length("r_name").alias("weight"), F.lit(2).alias("dealbreaker_threshold")).alias("v"))
    lengths = F.struct(F.lit(25).alias("min_seconds"), F.lit(4000).alias("max_seconds"), F.lit(100).alias("sweet_spot_min"), F.lit(2000).alias("sweet_spot_max"))
    (table(spark, sf, "region").agg(F.map_from_entries(F.collect_list(entry)).alias("scoring_weights"))
     .select(F.struct(lengths.alias("duration"), "scoring_weights").alias("profile")).write.json(path))
    criteria, best = transcripts.read_profile(spark, path, "profile")
    # The region number, for scores that differ by criterion: regions are numbered in name order.
    place = {c.name: i % 2 for i, c in enumerate(sorted(criteria, key=lambda c: c.name))}
    scores = F.create_map(*[x for c in criteria for x in (F.lit(c.name), (F.col("cand_id") % 10 + place[c.name]).cast("double"))])
    return candidates(spark, sf).select("cand_id", R(composite(scores, F.col("end") - F.col("start"), F.lit(False), F.lit(0.0), criteria, best), 4).alias("composite"))


@query("snk1_documents", f"""
WITH {TURNS},
sp AS (SELECT stream_id, speaker, sum(word_count) AS w, count(*) AS n FROM turns GROUP BY ALL)
SELECT stream_id, idx, speaker, word_count, (SELECT CAST(sum(n) AS BIGINT) FROM sp WHERE sp.stream_id = t.stream_id) AS total_utterances,
  (SELECT CAST(sum(w) AS BIGINT) FROM sp WHERE sp.stream_id = t.stream_id) AS total_words,
  (SELECT string_agg(speaker || ':' || w || ':' || n, ',' ORDER BY speaker) FROM sp WHERE sp.stream_id = t.stream_id) AS speakers
FROM turns t""")
def snk1(spark, sf):
    path = folder(spark, "snk1")
    sinks.write_documents(turns(spark, sf), path)
    figure = "struct<total_words:long,total_utterances:long>"
    docs = spark.read.schema(
        "stream_id long, utterances array<struct<idx:long,speaker:string,word_count:int>>, "
        f"summary struct<total_utterances:long,total_words:long,speakers:map<string,{figure}>>").json(path)
    who = F.array_sort(F.transform(F.map_entries("summary.speakers"), lambda e: F.concat_ws(
        ":", e["key"], e["value"]["total_words"].cast("string"), e["value"]["total_utterances"].cast("string"))))
    return docs.select("stream_id", F.inline("utterances"), "summary").select(
        "stream_id", "idx", "speaker", "word_count", "summary.total_utterances", "summary.total_words", F.array_join(who, ",").alias("speakers"))


@query("snk2_transcript", f"""
WITH {TURNS}
SELECT stream_id, idx // 4 AS part, string_agg({LINE}, chr(10) ORDER BY idx) AS text FROM turns GROUP BY ALL""")
def snk2(spark, sf):
    return sinks.render_transcript(turns(spark, sf), part_turns=4)


@query("snk3_clip_report", f"""
WITH {CANDIDATES},
c AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY score DESC, cand_id) AS rank FROM candidates QUALIFY rank <= 3)
SELECT stream_id, 0 AS rank, 'Clips: ' || count(*) || ' (' || count(*) FILTER (WHERE status <> 'F') || ' continuous, ' || count(*) FILTER (WHERE status = 'F') || ' composite)' AS text FROM c GROUP BY stream_id
UNION ALL
SELECT stream_id, rank, concat_ws(chr(10), 'Clip ' || rank || ': Order ' || cand_id, 'Assembly: ' || CASE WHEN status = 'F' THEN 'composite' ELSE 'continuous' END,
  'Score: ' || format('{{:.1f}}', floor(score)), 'Segments:', '1. SETUP [' || {STAMP.format('start')} || ' - ' || {STAMP.format('"end"')} || '] (' || CAST("end" - start AS BIGINT) || 's)',
  CASE WHEN status = 'F' THEN '2. KNOCKOUT [' || {STAMP.format('("end" + 60)')} || ' - ' || {STAMP.format('("end" + 90)')} || '] (30s)' END) FROM c""")
def snk3(spark, sf):
    from turnwise.operators.turns import top_per_stream
    top = top_per_stream(candidates(spark, sf), [F.desc("score"), F.asc("cand_id")], 3)
    two = F.col("status") == "F"
    clips = top.select("stream_id", F.col("cand_id").alias("clip_id"), "rank", F.concat(F.lit("Order "), F.col("cand_id").cast("string")).alias("title"),
                       F.floor("score").alias("score"), F.when(two, "composite").otherwise("continuous").alias("assembly"))
    first = F.struct(F.lit(1).alias("seg_no"), F.lit("setup").alias("purpose"), F.col("start").alias("start"), F.col("end").alias("end"))
    second = F.struct(F.lit(2).alias("seg_no"), F.lit("knockout").alias("purpose"), (F.col("end") + 60).alias("start"), (F.col("end") + 90).alias("end"))
    segs = top.select("stream_id", F.col("cand_id").alias("clip_id"), F.inline(F.when(two, F.array(first, second)).otherwise(F.array(first))))
    return sinks.clip_report(clips, segs)


@query("snk4_timeline", f"""
{CONVS},
blocks AS (SELECT * FROM (WITH {TOPIC_BLOCKS} SELECT * FROM blocks)), {CANDIDATES}
SELECT stream_id, 'conversation' AS track, CAST(conv_no AS VARCHAR) AS item, dominant AS label, round(start, 4) AS start, round("end", 4) AS "end" FROM convs
UNION ALL SELECT stream_id, 'topic', CAST(block_no AS VARCHAR), topic_name, round(t_start, 4), round(t_end, 4) FROM blocks
UNION ALL SELECT stream_id, 'clip', CAST(cand_id AS VARCHAR), status, round(start, 4), round("end", 4) FROM candidates""")
def snk4(spark, sf):
    out = sinks.timeline(event_conversations(spark, sf), topic_blocks(spark, sf), candidates(spark, sf))
    return out.withColumn("start", R("start", 4)).withColumn("end", R("end", 4))


@query("flt14_pending_jobs", """
SELECT 'orders' AS sheet, o_orderkey AS row_no, 'https://v.example.com/' || o_custkey AS url,
  CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END AS query,
  CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 20 = 0 THEN 10 ELSE CAST(o_orderkey % 20 AS INTEGER) END AS max_clips FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 5 <> 0
UNION ALL
SELECT 'customers', c_custkey, 'https://v.example.com/c' || c_custkey, NULL, 10 FROM customer WHERE c_mktsegment = 'MACHINERY'""")
def flt14(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, "  ").otherwise(F.concat(F.lit(" https://v.example.com/"), F.col("o_custkey").cast("string"))).alias("Video URL "),
        F.when(F.col("o_orderstatus") == "P", " ").otherwise("done").alias("STATUS"),
        F.when(F.col("o_orderkey") % 4 == 0, "  ").otherwise(F.col("o_orderpriority")).alias("Search Query"),
        F.when(F.col("o_orderkey") % 3 == 0, "many").otherwise((F.col("o_orderkey") % 20).cast("string")).alias("Max Clips"))
    c = table(spark, sf, "customer").select(
        "c_custkey", F.concat(F.lit("https://v.example.com/c"), F.col("c_custkey").cast("string")).alias("video url"),
        F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment")).alias("status"))
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    return jobs.all_pending({"orders": (o, "o_orderkey"), "customers": (c, "c_custkey"), "nations": (n, "n_nationkey")})


JOB_LOG = """
log AS (SELECT 'orders' AS source, o_custkey AS row_no, 'link' || o_custkey AS url, o_orderkey % 7 AS seq FROM orders),
ends AS (SELECT 'orders' AS source, o_custkey AS row_no, o_orderkey % 7 AS seq, bool_or(o_orderstatus = 'F') AS ok FROM orders
         WHERE o_orderkey % 3 <> 0 GROUP BY ALL),
tries AS (SELECT source, row_no, any_value(url) AS url, max(seq) AS seq, count(DISTINCT seq) AS attempts FROM log GROUP BY source, row_no),
states AS (SELECT t.*, CASE WHEN e.ok IS NULL THEN CASE WHEN t.seq = (SELECT max(seq) FROM log) THEN 'processing' ELSE 'lost' END
             WHEN e.ok THEN 'complete' ELSE 'failed' END AS status
           FROM tries t LEFT JOIN ends e USING (source, row_no, seq))"""


def _job_states(spark, sf):
    o = table(spark, sf, "orders").withColumns({"source": F.lit("orders"), "row_no": F.col("o_custkey"), "seq": F.col("o_orderkey") % 7})
    log = o.select("source", "row_no", F.concat(F.lit("link"), "row_no").alias("url"), "seq")
    outcomes = o.filter("o_orderkey % 3 <> 0").select(
        "source", "row_no", "seq", (F.col("o_orderstatus") == "F").alias("ok"), F.lit("folder").alias("link"), F.repeat(F.lit("no "), F.lit(300)).alias("error"))
    return jobs.job_states(log, outcomes)


@query("flt14_job_states", f"""
WITH {JOB_LOG}
SELECT source, row_no, url, attempts, status, CASE WHEN status = 'complete' THEN 'folder' END AS link,
  CASE WHEN status = 'failed' THEN left(repeat('no ', 300), 500) END AS error FROM states""")
def flt14_states(spark, sf):
    """Orders as attempts of jobs, customers as jobs: complete, failed, under way or lost."""
    return _job_states(spark, sf)


@query("flt14_jobs_to_retry", f"""
WITH {JOB_LOG}
SELECT source, row_no, url FROM states WHERE status = 'lost' AND attempts < 6""")
def flt14_retry(spark, sf):
    return jobs.jobs_to_retry(_job_states(spark, sf), most=6)
