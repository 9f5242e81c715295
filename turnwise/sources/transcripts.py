"""Read words, turns, segments and profiles from documents and text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.functions.clock import strict_stamp
from turnwise.functions.text import word_count
from turnwise.operators.scoring import Criterion, Lengths
from turnwise.plans.blocks import running
from turnwise.schema import KEY, SECONDS_PER_WORD

WORD = ("struct<word:string,punctuated_word:string,text:string,start:double,end:double,"
        "confidence:double,speaker:string>")
# Every key any of the three layouts uses; what a document lacks is null.
DOCUMENT = (f"stream_id long, words array<{WORD}>, "
            f"results struct<channels:array<struct<alternatives:array<struct<words:array<{WORD}>>>>>>, "
            f"utterances array<struct<speaker:string,words:array<{WORD}>>>, "
            "metadata struct<duration:double>")
SEGMENT = ("struct<start:double,startTime:double,begin:double,end:double,endTime:double,stop:double,"
           "speaker:string,label:string,confidence:double,score:double>")


def _stream() -> Column:
    """The document's own id, else one made of its file name."""
    return F.coalesce("stream_id", F.xxhash64(F.col("_metadata.file_path")))


def read_words(spark: SparkSession, path: str | list[str], *, multi_line: bool = False) -> DataFrame:
    """Transcript documents -> words. Three layouts are known: `words` at the top, words under the
    first alternative of the first channel, and utterances with words, which get the speaker of
    their utterance. The first layout that is there counts.
    """
    docs = spark.read.schema(DOCUMENT).option("multiLine", multi_line).json(path)
    spoken = F.flatten(F.transform("utterances", lambda u: F.transform(
        F.coalesce(u["words"], F.array().cast(f"array<{WORD}>")),
        lambda w: w.withField("speaker", F.coalesce(u["speaker"], F.lit("0"))))))
    nested = F.get(F.get(F.col("results.channels"), 0)["alternatives"], 0)["words"]
    return (docs.select(_stream().alias("stream_id"), F.col("metadata.duration").alias("meta_duration"),
                        F.posexplode(F.coalesce("words", nested, spoken)).alias("_i", "_w"))
            .select("stream_id", F.col("_i").cast("long").alias("pos"), "_w.*", "meta_duration"))


def normalize_words(raw: DataFrame) -> DataFrame:
    """Punctuated form over plain one, 0.0 for missing numbers."""
    return raw.select(*KEY, "pos", F.coalesce("punctuated_word", "word", F.lit("")).alias("text"),
                      *[F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)).alias(c) for c in ("start", "end", "confidence")],
                      F.col("speaker").cast("string").alias("speaker"))


def parse_turn_lines(lines: DataFrame, order: list[str], block: Column) -> tuple[DataFrame, DataFrame]:
    """Lines `[H:MM:SS] speaker: text` -> (turns, rejected lines). Lines that do not open with a
    bracket are no turns; those that do but have another form are rejected. A turn is taken to last
    0.3 s per word."""
    bare = F.trim("value")
    form = r"^\[([^\]]*)\].([^:]*):(.*)$"
    rows = (lines.withColumn("_line", bare).filter(F.col("_line").startswith("["))
            .withColumn("start", strict_stamp(F.regexp_extract("_line", form, 1))))
    good = F.col("_line").rlike(form) & F.col("start").isNotNull()
    rejects = rows.filter(~good).select(*KEY, F.col("_line").alias("line"))
    text = F.trim(F.regexp_extract("_line", form, 3))
    turns = (rows.filter(good)
             .withColumn("speaker", F.trim(F.regexp_extract("_line", form, 2))).withColumn("text", text)
             .withColumn("word_count", word_count(F.col("text")))
             .withColumn("end", F.col("start") + F.col("word_count") * SECONDS_PER_WORD))
    turns = running(turns, KEY, order, block, sums={"idx": F.lit(1).cast("long")})
    return (turns.select(*KEY, (F.col("idx") - 1).alias("idx"), "speaker", "start", "end", "text", "word_count"), rejects)


def read_text_turns(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Readable transcripts -> (turns, rejected lines). A line may carry its stream before a tab, as
    `write_transcript` leaves it; else the file stands for the stream. Line order is kept: by folder,
    by the first number in the file name (part-100000 follows part-99999), by name, by split of the file, then by line."""
    lines = spark.read.text(path)
    tag = F.regexp_extract("value", r"^(-?\d+)\t", 1)
    lines = lines.select(F.coalesce(tag.try_cast("long"), F.xxhash64(F.col("_metadata.file_path"))).alias("stream_id"),
                         F.regexp_replace("value", r"^-?\d+\t", "").alias("value"),
                         F.struct(F.regexp_replace(F.col("_metadata.file_path"), "[^/]*$", "").alias("folder"),
                                  F.regexp_extract(F.col("_metadata.file_name"), r"\d+", 0).try_cast("decimal(38,0)").alias("number"),
                                  F.col("_metadata.file_name").alias("name")).alias("_file"),
                         F.col("_metadata.file_block_start").alias("_split"),
                         F.monotonically_increasing_id().alias("_line_no"))
    block = F.struct("_file", "_split")
    return parse_turn_lines(lines, ["_file", "_split", "_line_no"], block)


def read_segments(spark: SparkSession, path: str | list[str], *, multi_line: bool = False) -> DataFrame:
    """Speaker segments under any of the known keys, numbered in order of their start."""
    docs = spark.read.schema(f"stream_id long, segments array<{SEGMENT}>").option("multiLine", multi_line).json(path)
    s = "_s."
    rows = (docs.select(_stream().alias("stream_id"), F.posexplode("segments").alias("_i", "_s"))
            .select("stream_id", "_i",
                    F.coalesce(s + "speaker", s + "label", F.lit("UNKNOWN")).alias("seg_speaker"),
                    F.coalesce(s + "start", s + "startTime", s + "begin", F.lit(0.0)).alias("seg_start"),
                    F.coalesce(s + "end", s + "endTime", s + "stop", F.lit(0.0)).alias("seg_end"),
                    F.coalesce(s + "confidence", s + "score", F.lit(1.0)).alias("confidence")))
    rows = running(rows, KEY, ["seg_start", "_i"], F.floor(F.col("seg_start") / 3600),
                   sums={"seg_pos": F.lit(1).cast("long")})
    return rows.withColumn("seg_pos", F.col("seg_pos") - 1).drop("_i")


def read_profile(spark: SparkSession, path: str, root: str) -> tuple[list[Criterion], Lengths]:
    """Scoring profile: criteria in file order with weight and threshold, and clip lengths. It is
    one small document, so it ends up in the plan as literals."""
    schema = (f"{root} struct<duration:struct<min_seconds:double,max_seconds:double,sweet_spot_min:double,"
              "sweet_spot_max:double>,scoring_weights:map<string,struct<weight:double,dealbreaker_threshold:double>>>")
    doc = (spark.read.schema(schema).option("multiLine", True).json(path)
           .select(f"{root}.duration", F.map_entries(f"{root}.scoring_weights").alias("weights")).first())
    d = doc["duration"]
    criteria = [Criterion(e["key"], e["value"]["weight"], e["value"]["dealbreaker_threshold"]) for e in doc["weights"]]
    return criteria, Lengths(d["min_seconds"], d["max_seconds"], d["sweet_spot_min"], d["sweet_spot_max"])
