"""How the test tables stand in for words, turns, segments and candidates.

Every Spark bridge has a SQL twin, a list of CTEs to start an oracle with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.plans.blocks import running
from turnwise.sources.chat import turns_from_chat, words_from_turns

DAY_MILLIS = 86_400_000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A test table."""
    return spark.read.parquet(f"{sf}/{name}.parquet")


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """Chat turns: stream = conversation, assistant = host, user = guest."""
    role = (F.when(F.col("role") == "assistant", "host")
            .when(F.col("role") == "user", "guest").otherwise(F.col("role")))
    return turns_from_chat(table(spark, sf, "conversations"), speaker=role)


TURNS = r"""
turns0 AS (
  SELECT conv_id AS stream_id, turn AS idx,
         CASE role WHEN 'assistant' THEN 'host' WHEN 'user' THEN 'guest' ELSE role END AS speaker,
         text, CAST(len(regexp_extract_all(text, '\S+')) AS INTEGER) AS word_count
  FROM conversations),
turns AS (
  SELECT *, coalesce(sum(word_count) OVER (PARTITION BY stream_id ORDER BY idx
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 3e-1 AS start,
         sum(word_count) OVER (PARTITION BY stream_id ORDER BY idx) * 3e-1 AS "end"
  FROM turns0)"""


def chat_words(spark: SparkSession, sf: str) -> DataFrame:
    """Every word of every chat turn, 0.3 s apart."""
    return words_from_turns(turns(spark, sf))


CHAT_WORDS = TURNS + r""",
said AS (
  SELECT stream_id, idx, speaker, unnest(regexp_extract_all(text, '\S+')) AS text,
         unnest(range(len(regexp_extract_all(text, '\S+')))) AS i
  FROM turns),
words AS (
  SELECT stream_id, idx, speaker, text, pos, pos * 3e-1 AS start, (pos + 1) * 3e-1 AS "end"
  FROM (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY idx, i) - 1 AS pos FROM said))"""


def signals(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a timeline: stream = day, start = second of the day (whole milliseconds, so that
    rounding in results never meets a tie), end = start + value."""
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    return (table(spark, sf, "events")
            .select(F.floor(millis / DAY_MILLIS).cast("long").alias("stream_id"),
                    F.col("event_id").alias("pos"), F.col("event_type").alias("speaker"),
                    (F.pmod(millis, F.lit(DAY_MILLIS)) / 1e3).alias("start"), "user_id", "value")
            .withColumn("end", F.col("start") + F.col("value")))


SIGNALS = """
signals AS (
  SELECT stream_id, pos, speaker, start, start + value AS "end", user_id, value
  FROM (SELECT epoch_us(ts) // 1000 // 86400000 AS stream_id, event_id AS pos, event_type AS speaker,
               (epoch_us(ts) // 1000 % 86400000) / 1e3 AS start, user_id, value FROM events))"""


def segments(spark: SparkSession, sf: str) -> DataFrame:
    """Speaker segments: views and purchases, made twenty times as long; speaker = user group."""
    return (signals(spark, sf).filter(F.col("speaker").isin("view", "purchase"))
            .select("stream_id", F.col("pos").alias("seg_pos"),
                    F.concat(F.lit("voice_"), (F.col("user_id") % 5).cast("string")).alias("seg_speaker"),
                    F.col("start").alias("seg_start"),
                    (F.col("start") + F.col("value") * 20).alias("seg_end")))


SEGMENTS = SIGNALS + """,
segs AS (
  SELECT stream_id, pos AS seg_pos, 'voice_' || CAST(user_id % 5 AS VARCHAR) AS seg_speaker,
         start AS seg_start, start + value * 20 AS seg_end
  FROM signals WHERE speaker IN ('view', 'purchase'))"""


def item_words(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as words at scale: stream = order, speaker = return flag, a line lasts as
    many seconds as its quantity, lines follow each other. Orders are cut every thousand line
    numbers, so one huge order is no single group and an ordinary one is one block."""
    tie = ["l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity",
           "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    rows = (table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "stream_id"))
    rows = running(rows, ["stream_id"], tie, F.floor(F.col("l_linenumber") / 1000),
                   sums={"pos": F.lit(1).cast("long"), "end": F.col("l_quantity")})
    return rows.select("stream_id", (F.col("pos") - 1).alias("pos"),
                       F.col("l_returnflag").alias("speaker"),
                       (F.col("end") - F.col("l_quantity")).alias("start"), "end",
                       F.col("l_partkey").cast("string").alias("text"), "l_discount")


ITEM_WORDS = """
item_words AS (
  SELECT l_orderkey AS stream_id, row_number() OVER w - 1 AS pos, l_returnflag AS speaker,
         sum(l_quantity) OVER w - l_quantity AS start, sum(l_quantity) OVER w AS "end",
         CAST(l_partkey AS VARCHAR) AS text, l_discount
  FROM lineitem
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey, l_suppkey,
    l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as scored clip candidates: stream = customer, one day = one minute."""
    day = F.unix_date(F.col("o_orderdate").cast("date"))
    return (table(spark, sf, "orders")
            .select(F.col("o_custkey").alias("stream_id"), F.col("o_orderkey").alias("cand_id"),
                    ((day - 8000) * 60.0).alias("start"),
                    ((day - 8000) * 60.0 + 30 + F.floor(F.col("o_totalprice") / 100)).alias("end"),
                    (F.col("o_totalprice") / 4973).alias("score"),
                    F.col("o_orderstatus").alias("status"),
                    F.col("o_orderpriority").alias("priority")))


CANDIDATES = """
candidates AS (
  SELECT o_custkey AS stream_id, o_orderkey AS cand_id,
         (CAST(o_orderdate AS DATE) - DATE '1970-01-01' - 8000) * 6e1 AS start,
         (CAST(o_orderdate AS DATE) - DATE '1970-01-01' - 8000) * 6e1 + 30
            + floor(o_totalprice / 100) AS "end",
         o_totalprice / 4973e0 AS score, o_orderstatus AS status, o_orderpriority AS priority
  FROM orders)"""


def frames(spark: SparkSession, sf: str, interval: int = 600) -> DataFrame:
    """Frames every ten minutes: who did something in that time stands in the picture."""
    slot = (F.floor(F.col("start") / interval) * interval).cast("double")
    person = F.struct("pos", F.concat(F.lit(" Guest "), (F.col("user_id") % 20).cast("string"))
                      .alias("description"), F.col("speaker").alias("position"))
    return (signals(spark, sf).groupBy("stream_id", slot.alias("time"))
            .agg(F.array_sort(F.collect_list(person)).alias("people")))


FRAMES = SIGNALS + """,
people AS (
  SELECT stream_id, floor(start / 600) * 6e2 AS time, pos, ' Guest ' || user_id % 20 AS description,
         speaker AS position,
         row_number() OVER (PARTITION BY stream_id, floor(start / 600) ORDER BY pos) - 1 AS i
  FROM signals)"""


def topic_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases and sign-ups as topic blocks: the name is put together from the user number."""
    k = F.col("user_id") % 24
    kind = F.element_at(F.array(*[F.lit(w) for w in ("market", "harbor", "river", "garden")]), (k % 4 + 1).cast("int"))
    thing = F.element_at(F.array(*[F.lit(w) for w in ("tax", "law", "trade")]), (k % 3 + 1).cast("int"))
    name = F.when(k % 2 == 0, F.concat(F.lit("The "), kind, F.lit(" "), thing)).otherwise(
        F.concat(kind, F.lit(" "), thing, F.lit(" of new "), F.lit("days")))
    mood = F.when(F.col("user_id") % 5 == 0, "heated").when(F.col("user_id") % 7 == 0, "confrontational").otherwise("calm")
    return (signals(spark, sf).filter(F.col("speaker").isin("purchase", "signup"))
            .select("stream_id", (F.col("user_id") % 3).alias("conv_id"), F.col("pos").alias("block_no"),
                    name.alias("topic_name"), F.concat_ws("-", kind, thing, (k % 2).cast("string")).alias("topic_id"),
                    F.col("start").alias("t_start"), (F.col("end") + 60).alias("t_end"), mood.alias("sentiment")))


TOPIC_BLOCKS = SIGNALS + """,
blocks AS (
  SELECT stream_id, user_id % 3 AS conv_id, pos AS block_no,
    CASE WHEN k % 2 = 0 THEN 'The ' || kind || ' ' || thing ELSE kind || ' ' || thing || ' of new days' END AS topic_name,
    kind || '-' || thing || '-' || (k % 2) AS topic_id, start AS t_start, "end" + 60 AS t_end,
    CASE WHEN user_id % 5 = 0 THEN 'heated' WHEN user_id % 7 = 0 THEN 'confrontational' ELSE 'calm' END AS sentiment
  FROM (SELECT *, user_id % 24 AS k, ['market', 'harbor', 'river', 'garden'][user_id % 24 % 4 + 1] AS kind,
          ['tax', 'law', 'trade'][user_id % 24 % 3 + 1] AS thing FROM signals WHERE speaker IN ('purchase', 'signup')))"""
