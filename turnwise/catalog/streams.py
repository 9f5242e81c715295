"""Streaming queries: the events table as a stream, run to its end, results read back from files.

Only what the watermark has passed comes out, so the SQL twins leave out what lies behind the last
event minus the delay.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.catalog import query
from turnwise.catalog.scratch import folder
from turnwise.streaming import live

R = F.round
DAY = 86_400


def _events(spark: SparkSession, sf: str) -> DataFrame:
    """events.parquet as a stream: key = user, time = ts."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    # in braces the name is a pattern, which a stream reads both as one file and as a folder of files
    raw = spark.readStream.schema(schema).parquet(f"{sf}/{{events.parquet}}")
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("at", F.unix_micros("ts") / 1e6)


def _finish(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    root = folder(spark, name)
    q = (stream.writeStream.format("parquet").outputMode("append").option("path", f"{root}/out")
         .option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


MARK = """
ev AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS us FROM events),
mark AS (SELECT max(us) // 1000 * 1000 AS top FROM ev)"""


@query("str1_live_turns", f"""
WITH {MARK},
f AS (SELECT *, user_id AS s, us / 1e6 AS tm, us / 1e6 + value AS until, CASE WHEN event_type IN ('click', 'view') THEN 'host' ELSE 'guest' END AS who FROM ev),
g AS (SELECT *, CASE WHEN lag(who) OVER w IS DISTINCT FROM who OR tm - lag(until) OVER w > 600 THEN 1 ELSE 0 END AS new FROM f
      WHERE us <= (SELECT top FROM mark) - 3600000000 WINDOW w AS (PARTITION BY s ORDER BY tm, event_id)),
h AS (SELECT *, sum(new) OVER (PARTITION BY s ORDER BY tm, event_id) AS run FROM g),
t AS (SELECT s AS stream_id, run, any_value(who) AS speaker, min(tm) AS start, max_by(until, (tm, event_id)) AS "end", count(*) AS word_count FROM h GROUP BY s, run)
SELECT stream_id, speaker, start, "end", word_count FROM t
WHERE run < (SELECT max(run) FROM t x WHERE x.stream_id = t.stream_id) OR "end" + 600 < ((SELECT top FROM mark) - 3600000000) / 1e6""")
def str1(spark, sf):
    e = _events(spark, sf)
    words = e.select(F.col("user_id").alias("stream_id"), "ts", "at", F.col("event_id").alias("pos"), (F.col("at") + F.col("value")).alias("until"),
                     F.when(F.col("event_type").isin("click", "view"), "host").otherwise("guest").alias("speaker"), F.col("event_type").alias("text"))
    out = _finish(spark, live.live_turns(words, max_pause=600.0, delay="1 hour"), "str1")
    return out.drop("text")


def _windowed(hop_us, size_us, delay_us):
    return f"""
WITH {MARK},
g AS (SELECT user_id AS stream_id, (us // {hop_us} - k) * {hop_us} AS w FROM ev, range(0, {-(-size_us // hop_us)}) r(k) WHERE (us // {hop_us} - k) * {hop_us} + {size_us} > us)
SELECT stream_id, w // 1000000 AS w_start, count(*) AS rows FROM g WHERE w + {size_us} <= (SELECT top FROM mark) - {delay_us} GROUP BY ALL"""


@query("str2_sliding_windows", _windowed(1_800_000_000, 3_000_000_000, 600_000_000))
def str2_sliding(spark, sf):
    e = _events(spark, sf).withColumn("stream_id", F.col("user_id"))
    out = _finish(spark, live.window_counts(e, size="3000 seconds", hop="1800 seconds", delay="10 minutes"), "str2a")
    return out.select("stream_id", F.unix_seconds("w_start").alias("w_start"), "rows")


@query("str2_tumbling_windows", _windowed(300_000_000, 300_000_000, 600_000_000))
def str2_tumbling(spark, sf):
    e = _events(spark, sf).withColumn("stream_id", F.col("user_id"))
    out = _finish(spark, live.window_counts(e, size="300 seconds", delay="10 minutes"), "str2b")
    return out.select("stream_id", F.unix_seconds("w_start").alias("w_start"), "rows")


@query("str2_sessions", f"""
WITH {MARK},
f AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id, event_type ORDER BY us) < 7200000000 THEN 0 ELSE 1 END AS new FROM ev),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id, event_type ORDER BY us ROWS UNBOUNDED PRECEDING) AS run FROM f)
SELECT user_id AS stream_id, event_type AS speaker, min(us) AS s_start, count(*) AS rows FROM g GROUP BY user_id, event_type, run
HAVING max(us) + 7200000000 <= (SELECT top FROM mark) - 600000000""")
def str2_sessions(spark, sf):
    e = _events(spark, sf).select(F.col("user_id").alias("stream_id"), F.col("event_type").alias("speaker"), "ts")
    out = _finish(spark, live.sessions(e, gap="2 hours", delay="10 minutes"), "str2c")
    return out.select("stream_id", "speaker", F.unix_micros("s_start").alias("s_start"), "rows")


@query("str3_first_appearances", f"""
WITH {MARK}
SELECT user_id AS stream_id, event_type AS speaker, min(us) / 1e6 AS at FROM ev
GROUP BY ALL HAVING min(us) <= (SELECT top FROM mark) - 3600000000""")
def str3(spark, sf):
    e = _events(spark, sf).select(F.col("user_id").alias("stream_id"), F.col("event_type").alias("speaker"), "ts", "at")
    return _finish(spark, live.first_appearances(e, delay="1 hour", life=90.0 * DAY), "str3")


@query("str4_live_correlation", f"""
WITH {MARK},
v AS (SELECT user_id AS s, event_id, us FROM ev WHERE event_type = 'signup'),
k AS (SELECT user_id AS s, event_id AS s_pos, us AS s_us FROM ev WHERE event_type = 'click'),
j AS (SELECT v.s, v.event_id, v.us, min(s_pos) AS s_pos, arg_min(s_us, s_pos) AS s_us FROM v LEFT JOIN k ON v.s = k.s AND abs(s_us - us) <= 600000000 GROUP BY ALL)
SELECT s AS stream_id, event_id, s_pos, round(1 - abs(s_us - us) / 1e6 / 600, 6) AS correlation FROM j""")
def str4(spark, sf):
    e = _events(spark, sf).withColumn("stream_id", F.col("user_id"))
    # One more row far ahead moves both watermarks past all events.
    ahead = F.expr("ts + INTERVAL 400 DAYS")
    def with_end(df: DataFrame, keep: list[str]) -> DataFrame:
        last = F.array(F.struct(*keep), F.struct(*[F.lit(-1).cast("long").alias("stream_id") if c == "stream_id" else
                                                   ahead.alias("ts") if c == "ts" else F.col(c) for c in keep]))
        return df.select(F.inline(F.when(F.col("event_id") % 500 == 0, last).otherwise(F.slice(last, 1, 1))))
    v = with_end(e.filter("event_type = 'signup' or event_id % 500 = 0"), ["stream_id", "ts", "event_id", "event_type"]) \
        .filter("event_type = 'signup' or stream_id = -1").drop("event_type")
    k = with_end(e.filter("event_type = 'click' or event_id % 500 = 0"), ["stream_id", "ts", "event_id", "event_type"]) \
        .filter("event_type = 'click' or stream_id = -1").drop("event_type").withColumnsRenamed({"ts": "s_ts", "event_id": "s_pos"})
    out = _finish(spark, live.live_correlation(v, k, window=600), "str4")
    return out.filter("stream_id >= 0").select("stream_id", "event_id", "s_pos", R("correlation", 6).alias("correlation"))


@query("str5_live_cues", f"""
WITH RECURSIVE {MARK},
c AS (SELECT user_id AS s, us / 1e6 AS tm, CAST(event_id AS VARCHAR) AS cue_id, event_type AS t, (value % 10) / 10 AS conf,
        row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS k FROM ev WHERE us <= (SELECT top FROM mark) - 3600000000),
walk AS (SELECT s, k, k AS cur, tm, t, conf, NULL::BIGINT AS closed FROM c WHERE k = 1
  UNION ALL
  SELECT w.s, c.k, CASE WHEN near AND c.conf <= w.conf THEN w.cur ELSE c.k END, CASE WHEN near AND c.conf <= w.conf THEN w.tm ELSE c.tm END,
    CASE WHEN near AND c.conf <= w.conf THEN w.t ELSE c.t END, CASE WHEN near AND c.conf <= w.conf THEN w.conf ELSE c.conf END, CASE WHEN NOT near THEN w.cur END
  FROM (SELECT w.*, x.k AS xk, x.t = w.t AND x.tm - w.tm < 3000 AS near FROM walk w JOIN c x ON x.s = w.s AND x.k = w.k + 1) w JOIN c ON c.s = w.s AND c.k = w.xk),
won AS (SELECT s, closed AS k FROM walk WHERE closed IS NOT NULL
  UNION ALL SELECT s, max_by(cur, k) FROM walk GROUP BY s HAVING max_by(tm, k) + 3000 < ((SELECT top FROM mark) - 3600000000) / 1e6)
SELECT c.s AS stream_id, cue_id, t AS cue_type, tm AS at, round(conf, 6) AS confidence FROM c JOIN won USING (s, k)""")
def str5(spark, sf):
    e = _events(spark, sf).select(F.col("user_id").alias("stream_id"), "ts", "at", F.col("event_id").cast("string").alias("cue_id"),
                                  F.col("event_type").alias("cue_type"), (F.col("value") % 10 / 10).alias("confidence"))
    out = _finish(spark, live.live_cues(e, apart=3000.0, delay="1 hour"), "str5")
    return out.withColumn("confidence", R("confidence", 6))


@query("str6_usage_per_minute", f"""
WITH {MARK},
g AS (SELECT (us // 10000000 - k) * 10000000 AS w, event_id % 900 AS tok FROM ev, range(0, 6) r(k))
SELECT w // 1000000 AS w_start, count(*) AS requests, CAST(sum(tok) AS BIGINT) AS tokens FROM g
WHERE w + 60000000 <= (SELECT top FROM mark) - 60000000 GROUP BY ALL""")
def str6(spark, sf):
    e = _events(spark, sf).select("ts", (F.col("event_id") % 900).alias("tokens"))
    return _finish(spark, live.usage_per_minute(e), "str6").select(F.unix_seconds("w_start").alias("w_start"), "requests", "tokens")


@query("str7_job_intake", """
SELECT 'events' AS source, event_id AS row_no, 'processing' AS status, 1::BIGINT AS entries FROM events WHERE event_type = 'purchase' AND event_id % 4 <> 0""")
def str7(spark, sf):
    e = _events(spark, sf)
    jobs = e.select(F.lit("events").alias("source"), F.col("event_id").alias("row_no"), F.when(F.col("event_id") % 4 == 0, " ").otherwise("link").alias("url"),
                    F.when(F.col("event_type") != "purchase", "done").alias("status"))
    root = folder(spark, "str7")
    live.record_jobs(jobs, f"{root}/log", f"{root}/state").awaitTermination()
    return live.latest_status(spark.read.parquet(f"{root}/log"))


@query("str8_late_rows", f"""
WITH {MARK}
SELECT CAST(count(*) AS BIGINT) AS kept, true AS some_dropped FROM ev, (SELECT max(event_id) // 2 AS half FROM ev)
WHERE event_id > half AND (us // 3600000000 + 1) * 3600000000 <= (SELECT top FROM mark) - 3600000000""")
def str8(spark, sf):
    """The later half of the events comes first, then the earlier half, which is late and dropped.
    One row: rows kept, and whether the progress reports show dropped ones."""
    root = folder(spark, "str8")
    rows = spark.read.parquet(f"{sf}/events.parquet")
    limit = rows.agg(F.max("event_id")).first()[0] // 2
    late = 0
    for half in (F.col("event_id") > limit, F.col("event_id") <= limit):
        rows.filter(half).write.mode("append").parquet(f"{root}/in")
        e = (spark.readStream.schema(rows.schema).parquet(f"{root}/in")
             .withColumn("ts", F.col("ts").cast("timestamp")).withColumn("stream_id", F.lit(0).cast("long")))
        q = (live.window_counts(e, size="1 hour", delay="1 hour").writeStream.format("parquet").option("path", f"{root}/out")
             .option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start())
        q.awaitTermination()
        late += live.dropped_late_rows(q)
    return spark.read.parquet(f"{root}/out").agg(F.sum("rows").alias("kept"), F.lit(late > 0).alias("some_dropped"))
