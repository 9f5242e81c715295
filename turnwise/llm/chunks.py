"""Exact duplicates by recipes of content-defined chunks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from turnwise.llm.tables import columns, small_batches
from turnwise.plans.cut import cut

#: Bounds of a chunk in bytes; cuts fall on one byte in MEAN between them.
SHORTEST, MEAN, LONGEST = 256, 1024, 8192
BATCH = 4 << 20
_ROLL = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32)


def normalised(text: bytes) -> bytes:
    """Every run of blank, tab, line feed, vertical tab, form feed and return becomes one blank."""
    words = text.split()
    if not words:
        return b" " if text else b""
    return (b" " if text[:1].isspace() else b"") + b" ".join(words) + (b" " if text[-1:].isspace() else b"")


def cut_points(data: bytes) -> list[int]:
    """Ends of the chunks of `data`: where a rolling hash of the last 16 bytes has its ten top bits clear, so the cuts
    of a passage are the same in every text that holds it."""
    if len(data) <= SHORTEST:
        return [len(data)] if data else []
    rolled = _ROLL[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8):  # doubles the window
        rolled[step:] += rolled[:-step] << np.uint32(step)
    ends, start = [], 0
    for end in (np.flatnonzero(rolled < 2 ** 32 // MEAN) + 1).tolist() + [len(data)]:
        while end - start > LONGEST:
            start += LONGEST
            ends.append(start)
        if end - start >= SHORTEST or end == len(data):
            if end > start:
                ends.append(end)
            start = end
    return ends


def chunks(data: bytes) -> list[bytes]:
    ends = cut_points(data)
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def digest(chunk: bytes, width: int) -> bytes:
    return hashlib.blake2b(chunk, digest_size=width).digest()


def _recipes(width: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in small_batches(frames, "text", BATCH):
            whole = [normalised(t) for t in frame.text]
            yield pd.DataFrame({"doc_id": frame.doc_id, "text_hash": frame.text_hash, "sha": [hashlib.sha256(t).digest() for t in whole],
                                "recipe": [b"".join(digest(c, width) for c in chunks(t)) for t in whole]})
    return run


def _pieces(width: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in small_batches(frames, "text", BATCH):
            distinct = {c for t in frame.text for c in chunks(normalised(t))}
            yield pd.DataFrame({"digest": [digest(c, width) for c in distinct], "chunk": list(distinct)})
    return run


def _placed(width: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in small_batches(frames, "text", BATCH):
            rows = [(i, hashlib.sha256(w).digest(), k, digest(c, width), c)
                    for i, w in zip(frame.doc_id, map(normalised, frame.text)) for k, c in enumerate(chunks(w))]
            yield pd.DataFrame(rows, columns=["doc_id", "sha", "at", "digest", "chunk"])
    return run


def recipes(docs: DataFrame, width: int = 16) -> DataFrame:
    """Every row's (doc_id, text_hash, sha, recipe, told): a hash of the text as it is, the SHA-256 of its normalised text and the list of its chunks.

    A chunk's identifier is a digest of `width` bytes, verified over all documents: the distinct chunks are grouped
    once, and a digest that stands for several is found there. In such a case, which 16 bytes make improbable but not
    impossible, the chunks of that digest are numbered and `told` lists the numbers by place; else it is empty. So
    (recipe, told) are equal exactly if the normalised texts are. Only distinct chunks are shuffled, never documents.
    """
    rows = columns(docs, doc_id="bigint", text="string").select(
        "doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    made = cut(rows.withColumn("text_hash", F.xxhash64(F.col("text").cast("string")))
               .mapInPandas(_recipes(width), "doc_id bigint, text_hash bigint, sha binary, recipe binary"))
    pieces = rows.mapInPandas(_pieces(width), "digest binary, chunk binary").distinct()
    clash = cut(pieces.groupBy("digest").count().filter("count > 1").select("digest"))
    if clash.isEmpty():
        return made.withColumn("told", F.lit(""))
    number = F.row_number().over(Window.partitionBy("digest").orderBy("chunk"))
    numbers = pieces.join(clash, "digest", "left_semi").withColumn("number", number)
    told = (rows.mapInPandas(_placed(width), "doc_id bigint, sha binary, at int, digest binary, chunk binary")
            .join(numbers, ["digest", "chunk"])
            .groupBy("doc_id", "sha", "at").agg(F.first("number").alias("number"))
            .groupBy("doc_id", "sha").agg(F.array_join(F.transform(
                F.array_sort(F.collect_list(F.struct("at", "number"))),
                lambda x: F.concat_ws(":", x["at"], x["number"])), " ").alias("told")))
    a, b = made.alias("a"), told.alias("b")
    return (a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.sha") == F.col("b.sha")), "left")
            .select("a.doc_id", "text_hash", "a.sha", "recipe", F.coalesce("told", F.lit("")).alias("told")))


def duplicates(docs: DataFrame, width: int = 16) -> DataFrame:
    """Equal texts of `docs` (doc_id, text): one row per row, with doc_id, keep_id, group_size, kept, text_sha256 and
    text_hash, the 64-bit hash of the text as it is.

    Texts are equal if they are after `normalised`; null is empty, and empty texts are equal. Of equal ones the least
    doc_id stays, null being the greatest; of rows that repeat that doc_id one stays. An empty table gives no rows.
    """
    rows = cut(recipes(docs, width).withColumn("row", F.monotonically_increasing_id()))  # fixed once it is written
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row").alias("stays")))
    groups = cut(rows.groupBy("recipe", "told").agg(F.count("*").alias("size"), first.alias("first"))
                 .filter("size > 1").select("recipe", "told", "size", "first.stays", F.col("first.doc_id").alias("least")))
    return rows.join(groups, ["recipe", "told"], "left").select(
        "doc_id", F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("stays") == F.col("row"), F.lit(True)).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "text_hash")
