"""Lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the checkpoint folder of the session and go on from there.

    The folder is the one the cluster names in `spark.checkpoint.dir`. Only a local session
    that names none gets a temporary one.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="turnwise-"))
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """A narrow table, written and counted: marked for broadcast if it has at most `rows` rows, else joined by a
    shuffle."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= rows else df


def join_per_key(df: DataFrame, other: DataFrame, keys: list[str], spread: list[str], rows: int = 1_000_000) -> DataFrame:
    """Join a table with one row per key, without leaving all rows of a key in one task.

    The table is written and counted. Up to `rows` rows it is broadcast; beyond, the rows are dealt out by `spread`
    after the join, so that what comes next is not planned on top of the join's partitioning.
    """
    other = small(other, rows)
    met = df.join(other, keys)
    return met if other.count() <= rows else met.repartition(*spread)


def asked_for(rows: DataFrame, asked: DataFrame, on: list[str], keys: int = 10_000_000) -> DataFrame:
    """`rows` without most of those that have no equal in `asked` on the columns `on`; none that has one is left out, so an inner join
    with `asked` gives the same.

    For many rows that few are asked of: what is left out is not shuffled. `asked` is a written table. Its keys set bits of words of 64, eight to a
    block and two bits to a key, some 16 bits to a key; the blocks are sent to all tasks, 2.5 bytes of them for a key. Beyond `keys` of them,
    and where the columns are of other types on the two sides, so that equal keys may have other hashes, all rows pass.
    """
    kinds = [[dict(df.dtypes)[c] for c in on] for df in (rows, asked)]
    n = asked.count()
    if n > keys or kinds[0] != kinds[1]:
        return rows
    blocks, own = max(1, -(-n // 32)), F.xxhash64(*on)
    word = lambda h, at: F.shiftrightunsigned(h, at).bitwiseAND(F.lit(7))
    bit = lambda h, at: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, at).bitwiseAND(F.lit(63)).cast("int"))
    h = F.col("_h")
    # the block comes from a hash of the hash: its own bits say which bits are set
    block = F.pmod(F.xxhash64(h, F.lit("block")), F.lit(blocks)).alias("_cell")
    marks = (asked.select(own.alias("_h")).select(block, F.inline(F.array(*[F.struct(word(h, at).cast("int").alias("_word"), bit(h, at + 3).alias("_bit"))
                                                                             for at in (0, 16)])))
             .groupBy("_cell", "_word").agg(F.bit_or("_bit").alias("_bits")))
    filled = F.broadcast(marks.groupBy("_cell").agg(*[F.coalesce(F.max(F.when(F.col("_word") == i, F.col("_bits"))), F.lit(0).cast("long")).alias(f"_w{i}")
                                                      for i in range(8)]))
    words = F.array(*[F.col(f"_w{i}") for i in range(8)])
    hit = [F.get(words, word(h, at).cast("int")).bitwiseAND(bit(h, at + 3)) != 0 for at in (0, 16)]
    return (rows.withColumn("_h", own).withColumn("_cell", F.pmod(F.xxhash64(h, F.lit("block")), F.lit(blocks)))
            .join(filled, "_cell").filter(hit[0] & hit[1]).select(*rows.columns))
