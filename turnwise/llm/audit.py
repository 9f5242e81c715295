"""How filters interact: every order of them counted at once in wide packed counters."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.lookup import lookup
from turnwise.llm.tables import columns, small_batches, word_pieces
from turnwise.plans.cut import cut

COUNTERS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
FIELD = np.dtype("<u8")  # a counter; rows number less than 2 ** 63, so no sum runs over into the next
HELD = 256  # sums that a task holds at once
FAN = 64  # partial sums of a part are added in so many heaps first
BATCH = 4 << 20
CAPITALS, SIGNS = bytes(range(65, 91)), b"#$%&*|"


@cache
def orders(filters: str) -> list[str]:
    return ["".join(p) for p in permutations(filters)]


@cache
def counter(filters: str, mask: int, good: bool, toxic: bool) -> int:
    """One integer with a field for every order, step and counter: what a row that fails the filters in `mask` adds."""
    every = orders(filters)
    place = np.array([[filters.index(f) for f in order] for order in every])
    fails = (mask >> place & 1).astype(bool)
    step = np.arange(len(filters))
    first = np.where(fails.any(axis=1), fails.argmax(axis=1), len(filters))[:, None]
    removed = first == step
    out = np.stack([first > step, removed, fails & (first < step), fails & (mask.bit_count() == 1), removed & good, removed & toxic], axis=-1)
    return int.from_bytes(out.astype(FIELD).tobytes(), "little")


def unpacked(filters: str, total: int) -> np.ndarray:
    """The fields of a sum: orders x steps x counters."""
    shape = (len(orders(filters)), len(filters), len(COUNTERS))
    return np.frombuffer(total.to_bytes(int(np.prod(shape)) * FIELD.itemsize, "little"), FIELD).reshape(shape)


def _bytes(total: int) -> bytes:
    return total.to_bytes(-(-total.bit_length() // 8), "little")


def audit(rows: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """What every filter does at every place of every order, from `rows` (part, mask, good, toxic).

    Bit i of `mask` says that the row fails the i-th of `filters`, one letter each. Returns for every part, order
    (filter_order) and step, 1 for the first filter: kept (rows after it), removed (here), redundant (fail its filter
    but went before), unique_fails (fail no other filter), good_lost and toxic_lost (removed here, good or toxic), shapley
    (removed by its filter, summed over all orders).

    Each mask stands for one big integer that holds all these outcomes as 64-bit fields, so that a row is one addition.
    Tasks add up what they read, sums of a part are added in FAN heaps and then together, each as a running sum: a part
    may hold most rows, and no task holds more than one sum and a batch. Null masks fail nothing, null good or toxic are false,
    a null part is the empty string. An empty table gives no rows.
    """
    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, int] = {}
        for frame in frames:
            for part, mask, good, toxic in zip(frame.part.tolist(), frame["mask"].tolist(), frame.good.tolist(), frame.toxic.tolist()):
                if part not in sums and len(sums) == HELD:
                    yield pd.DataFrame({"part": list(sums), "total": [_bytes(t) for t in sums.values()]})
                    sums = {}
                sums[part] = sums.get(part, 0) + counter(filters, mask, good, toxic)
        if sums:
            yield pd.DataFrame({"part": list(sums), "total": [_bytes(t) for t in sums.values()]})

    def merged(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[str, int]]:
        part, total = None, 0
        for frame in frames:
            for name, more in zip(frame.part, frame.total):
                if name != part:
                    if part is not None:
                        yield part, total
                    part, total = name, 0
                total += int.from_bytes(more, "little")
        if part is not None:
            yield part, total

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, total in merged(frames):
            yield pd.DataFrame({"part": [part], "total": [_bytes(total)]})

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every, steps = orders(filters), len(filters)
        place = np.array([[filters.index(f) for f in order] for order in every]).ravel()
        for part, total in merged(frames):
            values = unpacked(filters, total).astype(np.int64).reshape(-1, len(COUNTERS))
            by_filter = np.zeros(steps, np.int64)
            np.add.at(by_filter, place, values[:, COUNTERS.index("removed")])
            yield pd.DataFrame({"part": part, "filter_order": np.repeat(every, steps), "step": np.tile(np.arange(1, steps + 1, dtype=np.int32), len(every))}
                               | {c: values[:, i] for i, c in enumerate(COUNTERS)} | {"shapley": by_filter[place]})

    own = rows.select(F.coalesce("part", F.lit("")).alias("part"), F.coalesce(F.col("mask").cast("int"), F.lit(0)).alias("mask"),
                      *[F.coalesce(F.col(c).cast("boolean"), F.lit(False)).alias(c) for c in ("good", "toxic")])
    partial = "part string, total binary"
    sums = own.mapInPandas(add, partial).withColumn("heap", F.pmod(F.spark_partition_id(), F.lit(FAN)))
    heaps = sums.repartition("part", "heap").sortWithinPartitions("part").select("part", "total").mapInPandas(merge, partial)
    return (heaps.repartition("part").sortWithinPartitions("part")
            .mapInPandas(unpack, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in (*COUNTERS, "shapley"))))


def word_counts(text: bytes) -> tuple[int, int]:
    """Words and distinct words of a text."""
    n, seen = 0, set()
    for words in word_pieces(text):
        n += len(words)
        seen.update(words)
    return n, len(seen)


def text_mask(text: str) -> tuple[int, bytes]:
    """Which of A to D a text fails, as bits, and a digest of it."""
    data = text.encode()
    n, distinct = word_counts(data)
    capitals = len(data) - len(data.translate(None, CAPITALS))
    signs = len(data) - len(data.translate(None, SIGNS))
    mask = (n < 200) | (100 * distinct < 50 * n) << 1 | (100 * capitals > 3 * len(text)) << 2 | (signs > 0) << 3
    return mask, hashlib.blake2b(data, digest_size=16).digest()


def quality_failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic) of every row of `docs` (doc_id, text, lang), for `audit`.

    A: under 200 words. B: fewer than half of the words distinct. C: more than 3 % of the code points are A-Z. D: holds
    one of `#$%&*|`. E: a smaller doc_id has the identical text, by a 128-bit digest. Words are runs of what is not
    ASCII white space. Null text is empty, null lang the empty part. A null doc_id is not smaller than any and has none
    smaller, so such rows never fail E and make none fail; rows that repeat a doc_id are rows of their own. good: quality = 1 in
    `labels` (doc_id, quality, toxic), toxic: toxic = 1 there, in any row if an id repeats; a null doc_id has no label.

    Texts are read once; what is shuffled is a digest and an id a row. Groups of copies of any size only send their least id
    per task, and copies in very large groups get it by a broadcast.
    """
    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in small_batches(frames, "text", BATCH):
            found = [text_mask(t) for t in frame.text]
            yield frame.drop(columns="text").assign(part=frame.part.astype(object), mask=np.array([m for m, _ in found], np.int32), digest=[d for _, d in found])

    own = columns(docs, doc_id="bigint", text="string", lang="string").select(
        "doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    named = own.withColumns({"unnamed": F.col("doc_id").isNull(), "doc_id": F.coalesce("doc_id", F.lit(0))})  # no nulls for pandas
    rows = named.mapInPandas(judge, "doc_id bigint, part string, unnamed boolean, mask int, digest binary")
    rows = cut(rows.select(F.when(~F.col("unnamed"), F.col("doc_id")).alias("doc_id"), "part", "mask", "digest"))
    copied = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).filter("n > 1").select("digest", "least")
    label = (columns(labels, "quality", "toxic", doc_id="bigint").filter(F.col("doc_id").isNotNull()).groupBy("doc_id")
             .agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")))
    rows = lookup(rows, copied, "digest")
    repeated = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)).cast("int")
    rows = cut(rows.select("doc_id", "part", F.col("mask").bitwiseOR(F.shiftleft(repeated, 4)).alias("mask")))
    return lookup(rows, label, "doc_id").select("part", "mask", "good", "toxic")
