"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from turnwise.llm.jaccard import shared
from turnwise.llm.tables import WORD, columns, unit
from turnwise.plans.cut import cut

#: Sources of a plan that may be broadcast.
PLAN_ROWS = 200_000


def numbered(df: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """`df` with its place in `order`, counted from 0 range by range, so no task sorts the whole table."""
    ranges = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (ranges.groupBy("_range").count()
              .select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start")))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return (ranges.withColumn("_within", within).join(starts, "_range")
            .withColumn(name, F.col("_start") + F.col("_within") - 1).drop("_range", "_start", "_within"))


def water_fill(sources: DataFrame, share: float, epochs: float) -> DataFrame:
    """Targets of `sources` (source, weight, source_size): `share` of all sizes by weight, capped at `epochs` sizes.

    A source whose part is above its cap is clamped there, and what it leaves goes to the others by weight, until no
    part is above a cap; if all are clamped, the targets are the caps. Each round brings four sums to the driver.
    Adds target.
    """
    cap, level = F.col("source_size") * epochs, 0.0
    total, clamped = None, -1
    while True:
        full = cap <= F.col("weight") * level
        row = sources.agg(F.sum("source_size").alias("size"), F.count(F.when(full, 1)).alias("n"),
                          F.sum(F.when(full, cap).otherwise(0.0)).alias("caps"),
                          F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("weights")).first()
        total = share * (row.size or 0)
        if row.n == clamped or not row.weights:
            break
        clamped, level = row.n, (total - row.caps) / row.weights
    full = cap <= F.col("weight") * level
    return sources.withColumn("target", F.when(full | F.lit(not row.weights), cap).otherwise(F.col("weight") * level))


def drawn(seed: int) -> Column:
    """The seeded place of a row (doc_id, hash, number), above 0 and below 1."""
    return unit(F.xxhash64(F.lit(seed), "doc_id", "hash", "number"))


def told_apart(rows: DataFrame) -> DataFrame:
    """`rows` (doc_id, source, hash and others) with their number, from 1, among the rows equal in these three.

    Only rows that repeat are moved to be numbered; those equal in all three stand in one task."""
    group = F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("source").isNull(), "source", "hash")
    keyed = rows.withColumn("_group", group)
    repeated = cut(keyed.groupBy("_group").count().filter("count > 1").select("_group"))
    if repeated.isEmpty():
        return rows.withColumn("number", F.lit(1))
    repeated = shared(repeated)
    number = F.row_number().over(Window.partitionBy("_group").orderBy("doc_id", "source", "hash"))
    once = keyed.join(repeated, "_group", "left_anti").withColumn("number", F.lit(1))
    return once.unionByName(keyed.join(repeated, "_group", "left_semi").withColumn("number", number)).drop("_group")


def mixing_plan(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, epochs: float = 2.0,
                seed: int = 7, block_rows: int = 4096) -> DataFrame:
    """What to take of each source of `docs` (doc_id, source, size, hash, number; see `sized`): source, source_size, target, whole, edge, added.

    A source with target t and size s gives every row whole = floor(t / s) times, and once more the rows drawn at or
    below `edge`, which in seeded order fill the rest of t as far as whole rows fit, and the row drawn at `added`, the
    one of the others whose size comes nearest to what is left. Sums run in hash ranges of a source, so a source of
    any size is spread over tasks.
    """
    sources = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = numbered(sources, F.col("source").asc_nulls_last())
    sources = sources.withColumn("weight", F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    sources = cut(null_safe(water_fill(cut(sources), share, epochs).withColumn("whole", whole))
                  .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
                  .select("source", "named", "source_size", "target", "whole", "rest"))
    blocks = max(1, math.ceil(docs.count() / block_rows))
    rows = null_safe(docs).withColumn("draw", drawn(seed)).withColumn("block", F.floor(F.col("draw") * blocks))
    before = Window.partitionBy("source", "named").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    spans = (rows.groupBy("source", "named", "block").agg(F.sum("size").alias("words"))
             .withColumn("start", F.coalesce(F.sum("words").over(before), F.lit(0)))
             .join(sources, ["source", "named"]).select("source", "named", "block", "start", "rest"))
    within = (Window.partitionBy("source", "named", "block").orderBy("draw", "doc_id", "size")
              .rowsBetween(Window.unboundedPreceding, 0))
    edges = (rows.withColumn("upto", F.sum("size").over(within)).join(spans, ["source", "named", "block"])
             .filter(F.col("start") + F.col("upto") <= F.col("rest"))
             .groupBy("source", "named").agg(F.max("draw").alias("edge"), F.sum("size").alias("filled")))
    plan = cut(sources.join(edges, ["source", "named"], "left").withColumn("edge", F.coalesce("edge", F.lit(0.0)))
               .withColumn("gap", F.col("rest") - F.coalesce("filled", F.lit(0))))
    off = F.abs(F.col("gap") - F.col("size"))
    best = (rows.join(bounded(plan.filter("gap > 0")), ["source", "named"])
            .filter((F.col("draw") > F.col("edge")) & (off < F.col("gap")))
            .groupBy("source", "named").agg(F.min(F.struct(off.alias("off"), "draw"))["draw"].alias("added")))
    return cut(plan.join(best, ["source", "named"], "left")
               .select("source", "named", "source_size", "target", "whole", "edge", "added"))


def bounded(plan: DataFrame) -> DataFrame:
    """A plan, marked for broadcast if it has been counted and has no more than PLAN_ROWS sources."""
    return F.broadcast(plan) if plan.count() <= PLAN_ROWS else plan


def null_safe(df: DataFrame) -> DataFrame:
    """`df` with null sources made a source of their own that joins can compare: empty and not `named`."""
    return df.withColumn("named", F.col("source").isNotNull()).withColumn("source", F.coalesce("source", F.lit("")))


def times_taken(docs: DataFrame, plan: DataFrame, seed: int = 7) -> DataFrame:
    """`docs` (doc_id, source, size, hash, number and others) with source_size, target and times. A row without words is
    taken `whole` times only, so not at all from a source without words."""
    draw = drawn(seed)
    extra = ((F.col("size") > 0) & ((draw <= F.col("edge")) | F.coalesce(draw == F.col("added"), F.lit(False)))).cast("long")
    kept = [c for c in docs.columns if c != "source"]
    return (null_safe(docs).join(bounded(plan), ["source", "named"])
            .select(*kept, F.when(F.col("named"), F.col("source")).alias("source"), "source_size", "target",
                    (F.col("whole") + extra).cast("long").alias("times")))


def words_of(text: Column) -> Column:
    """The number of words of a text (null: 0)."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, the number of words of the text (null: 0), its hash, and the row's number among equal ones."""
    text = F.coalesce("text", F.lit(""))
    return told_apart(cut(columns(docs, doc_id="bigint", source="string", text="string").select(
        "doc_id", "source", words_of(text).alias("size"), F.xxhash64(text).alias("hash"))))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, epochs: float = 2.0,
        seed: int = 7) -> DataFrame:
    """How often the mix takes every row of `docs` (doc_id, source, text).

    Sources in code point order, null last, weigh `weights`, repeating, and share `share` of all words up to `epochs`
    times their own. Returns one row per row: doc_id, size, source_size, target (its source's), taken (words, repeats
    counted), times. The draw is a hash of seed, doc_id, text and the number of the row among equal ones, so
    reruns agree and rows that repeat a doc_id, or have none, are taken one by one. An empty table gives no rows; a source without words has target 0 and gives nothing.
    """
    rows = sized(docs)
    taken = times_taken(rows, mixing_plan(rows, weights, share, epochs, seed), seed)
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "times")
