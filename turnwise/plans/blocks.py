"""Ordered per-stream work that never needs a whole stream in one task.

A stream is cut into blocks (a monotone function of the order columns, e.g. ten minutes or
50,000 positions). Windows run inside (stream, block); what a block hands to the next one is a
single small row, and only those rows meet in a per-stream window. A stream that holds a third
of all rows is therefore spread over as many tasks as it has blocks.

`order` is a list of column names that order a stream totally, ascending.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = "_block"


def by_time(column: str, seconds: float = 600.0) -> Column:
    return F.floor(F.col(column) / seconds).cast("long")


def by_position(column: str, rows: int = 50_000) -> Column:
    return F.floor(F.col(column) / rows).cast("long")


def balanced(df: DataFrame, keys: list[str], column: str, *, rows: int = 50_000,
             cell: float = 1.0, name: str = "_cut") -> DataFrame:
    """Add a block number that follows how crowded the time axis is: a block ends with the cell (of
    `cell` units) in which it has collected `rows` rows. For streams whose rows bunch up, where
    blocks of a fixed length would not be of a fixed size. Costs a count per cell and a join on it.
    """
    at = F.floor(F.col(column) / cell).cast("long")
    counts = df.groupBy(*keys, at.alias("_cell")).agg(F.count(F.lit(1)).alias("_n"))
    # Cells of one stream are numbered block by block too: a long stream has many of them.
    sums = running(counts, keys, ["_cell"], by_time("_cell", 10_000), sums={"_upto": F.col("_n")})
    cuts = sums.select(*keys, "_cell", F.floor((F.col("_upto") - F.col("_n")) / rows).alias(name))
    return df.withColumn("_cell", at).join(cuts, [*keys, "_cell"], "left").drop("_cell")


def neighbours(df: DataFrame, keys: list[str], order: list[str], block: Column, *,
               before: dict[str, Column] | None = None,
               after: dict[str, Column] | None = None) -> DataFrame:
    """Add values of the previous row (`before`) and of the next row (`after`) of the stream.

    Rows inside a block see each other in the block's window. The first and last row of every
    block also pass through a per-stream window that holds those edge rows only.
    """
    before, after = before or {}, after or {}
    inner = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    whole = Window.partitionBy(*keys).orderBy(BLOCK, *order)
    seen_b = F.struct(*[v.alias(k) for k, v in before.items()], F.lit(1).alias("_here"))
    seen_a = F.struct(*[v.alias(k) for k, v in after.items()], F.lit(1).alias("_here"))
    local = (df.withColumn(BLOCK, block)
             .withColumn("_b", F.lag(seen_b).over(inner))
             .withColumn("_a", F.lead(seen_a).over(inner)))
    first, last = F.col("_b").isNull(), F.col("_a").isNull()
    edges = (local.filter(first | last)
             .withColumn("_eb", F.lag(seen_b).over(whole))
             .withColumn("_ea", F.lead(seen_a).over(whole))
             .withColumn("_b", F.coalesce("_b", "_eb"))
             .withColumn("_a", F.coalesce("_a", "_ea"))
             .drop("_eb", "_ea"))
    rows = local.filter(~(first | last)).unionByName(edges)
    for name in before:
        rows = rows.withColumn(name, F.col("_b")[name])
    for name in after:
        rows = rows.withColumn(name, F.col("_a")[name])
    return rows.drop("_b", "_a", BLOCK)


def _known(df: DataFrame, block: Column) -> Column:
    """A numbered block without nulls, which would not meet what is carried to them."""
    numbered = dict(df.select(block.alias(BLOCK)).dtypes)[BLOCK] == "bigint"
    return F.coalesce(block, F.lit(-(1 << 63))) if numbered else block


def running(df: DataFrame, keys: list[str], order: list[str], block: Column, *,
            sums: dict[str, Column] | None = None,
            peaks: dict[str, Column] | None = None,
            fill: dict[str, Column] | None = None,
            fill_back: dict[str, Column] | None = None) -> DataFrame:
    """Running values over a stream.

    sums       total up to and with the row
    peaks      largest value of the rows before
    fill       last value that is not null, up to and with the row
    fill_back  first value that is not null, from the row on

    Rows whose block is null, as those without a time have, are a block before all others.
    """
    sums, peaks, fill, fill_back = sums or {}, peaks or {}, fill or {}, fill_back or {}
    ordering = F.struct(*order)
    cut = df.withColumn(BLOCK, _known(df, block))
    inner = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    upto = inner.rowsBetween(Window.unboundedPreceding, 0)
    earlier = inner.rowsBetween(Window.unboundedPreceding, -1)
    back = (Window.partitionBy(*keys, BLOCK).orderBy(*[F.desc(c) for c in order])
            .rowsBetween(Window.unboundedPreceding, 0))

    local, parts, carried = {}, [], {}
    blocks_before = (Window.partitionBy(*keys).orderBy(BLOCK)
                     .rowsBetween(Window.unboundedPreceding, -1))
    blocks_after = (Window.partitionBy(*keys).orderBy(F.desc(BLOCK))
                    .rowsBetween(Window.unboundedPreceding, -1))
    for name, value in sums.items():
        local[name] = F.sum(value).over(upto)
        parts.append(F.sum(value).alias(f"_p_{name}"))
        carried[f"_c_{name}"] = F.sum(f"_p_{name}").over(blocks_before)
    for name, value in peaks.items():
        local[name] = F.max(value).over(earlier)
        parts.append(F.max(value).alias(f"_p_{name}"))
        carried[f"_c_{name}"] = F.max(f"_p_{name}").over(blocks_before)
    for name, value in fill.items():
        local[name] = F.last(value, ignorenulls=True).over(upto)
        parts.append(F.max_by(value, F.when(value.isNotNull(), ordering)).alias(f"_p_{name}"))
        carried[f"_c_{name}"] = F.last(f"_p_{name}", ignorenulls=True).over(blocks_before)
    for name, value in fill_back.items():
        local[name] = F.last(value, ignorenulls=True).over(back)
        parts.append(F.min_by(value, F.when(value.isNotNull(), ordering)).alias(f"_p_{name}"))
        carried[f"_c_{name}"] = F.last(f"_p_{name}", ignorenulls=True).over(blocks_after)

    carry = (cut.groupBy(*keys, BLOCK).agg(*parts)
             .select(*keys, BLOCK, *[c.alias(n) for n, c in carried.items()]))
    rows = cut.withColumns(local).join(carry, [*keys, BLOCK], "left")
    out = {}
    for name in sums:
        out[name] = F.col(name) + F.coalesce(F.col(f"_c_{name}"), F.lit(0))
    for name in peaks:
        out[name] = F.greatest(name, f"_c_{name}")
    for name in [*fill, *fill_back]:
        out[name] = F.coalesce(name, f"_c_{name}")
    return rows.withColumns(out).drop(BLOCK, *carried)


def around(df: DataFrame, keys: list[str], position: str, values: dict[str, Column], *,
           before: int = 0, after: int = 0, block_rows: int = 50_000) -> DataFrame:
    """Add arrays of the values of the rows next to each row (itself included).

    `position` numbers the rows of a stream. The rows at the rim of a block are lent to its
    neighbour, so the windows stay inside blocks.
    """
    own = F.floor(F.col(position) / block_rows)
    lent = [F.floor((F.col(position) - after) / block_rows), F.floor((F.col(position) + before) / block_rows)]
    cells = (df.withColumn("_own", own)
             .withColumn(BLOCK, F.explode(F.array_distinct(F.array("_own", *lent)))))
    near = Window.partitionBy(*keys, BLOCK).orderBy(position).rowsBetween(-before, after)
    for name, value in values.items():
        cells = cells.withColumn(name, F.collect_list(value).over(near))
    return cells.filter(F.col("_own") == F.col(BLOCK)).drop("_own", BLOCK)


def ranked(df: DataFrame, keys: list[str], by: Column, tie: list[str], width: float, *,
           name: str = "rank", tie_width: float | None = None) -> DataFrame:
    """1-based rank in a group, by a number ascending (negate it for descending), then `tie`.

    Values are cut into ranges of `width`, so a group of any size is numbered range by range. Where values are whole
    multiples of `width`, many rows may share one: `tie_width` then cuts each value by ranges of the first tie column,
    which is a number.
    """
    rows = df.withColumn("_by", by.cast("double"))
    block = by_time("_by", width)
    if tie_width is not None:
        block = F.struct(block.alias("value"), by_time(tie[0], tie_width).alias("tie"))
    return running(rows, keys, ["_by", *tie], block,
                   sums={name: F.lit(1).cast("long")}).drop("_by")


class Agg:
    """One output column of `runs`: how rows are folded, and how parts of a run are."""

    def __init__(self, kind: str, value: Column):
        self.kind, self.value = kind, value

    def over_rows(self, order: list[str]) -> Column:
        at = F.struct(*order)
        if self.kind == "list":
            return F.array_sort(F.collect_list(F.struct(*order, self.value.alias("_v"))))
        if self.kind == "set":
            return F.array_sort(F.collect_set(self.value))
        return _reduce(self.kind, self.value, at)

    def over_parts(self, name: str) -> Column:
        at, part = F.struct(BLOCK, "_run"), F.col(name)
        if self.kind == "list":
            lists = F.array_sort(F.collect_list(F.struct(BLOCK, "_run", part.alias("_l"))))
            return F.transform(F.flatten(F.transform(lists, lambda x: x["_l"])),
                               lambda x: x["_v"])
        if self.kind == "set":
            return F.array_sort(F.array_distinct(F.flatten(F.collect_list(part))))
        return _reduce("sum" if self.kind == "count" else self.kind, part, at)


def _reduce(kind: str, value: Column, at: Column) -> Column:
    return {"first": lambda: F.min_by(value, at), "last": lambda: F.max_by(value, at),
            "sum": lambda: F.sum(value), "min": lambda: F.min(value),
            "max": lambda: F.max(value), "count": lambda: F.count(value),
            "last_known": lambda: F.max_by(value, F.when(value.isNotNull(), at))}[kind]()


def runs(df: DataFrame, keys: list[str], order: list[str], block: Column, *,
         look: dict[str, Column], opens: Callable[[Column, Column], Column],
         aggs: dict[str, Agg]) -> DataFrame:
    """Gaps and islands: one row per maximal run of consecutive rows.

    `look` names the row values the rule reads; `opens(previous, current)` says from those two
    structs whether the current row opens a new run. Runs are built per block, then the first
    and last run of each block are stitched: the stitch sees two rows per block at most.
    """
    inner = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    view = F.struct(*[v.alias(k) for k, v in look.items()])
    opened = F.coalesce(opens(F.col("_prev"), F.col("_view")), F.lit(True))
    at = F.struct(*order)
    parts = (df.withColumn(BLOCK, block)
             .withColumn("_view", view)
             .withColumn("_prev", F.lag("_view").over(inner))
             .withColumn("_ends", F.lead(F.lit(1)).over(inner).isNull())
             .withColumn("_new", F.when(F.col("_prev").isNull() | opened, 1).otherwise(0))
             .withColumn("_run", F.sum("_new").over(
                 inner.rowsBetween(Window.unboundedPreceding, 0)))
             .groupBy(*keys, BLOCK, "_run")
             .agg(F.min_by("_view", at).alias("_head"), F.max_by("_view", at).alias("_tail"),
                  F.max("_ends").alias("_ends"), *[a.over_rows(order).alias(n) for n, a in aggs.items()]))
    parts = parts.withColumn("_edge", (F.col("_run") == 1) | F.col("_ends"))
    chain = Window.partitionBy(*keys).orderBy(BLOCK, "_run")
    joins = ((F.col("_run") == 1) & F.col("_before").isNotNull()
             & ~F.coalesce(opens(F.col("_before"), F.col("_head")), F.lit(True)))
    stitched = (parts.filter("_edge")
                .withColumn("_before", F.lag("_tail").over(chain))
                .withColumn("_starts", F.when(joins, 0).otherwise(1))
                .withColumn("_chain", F.sum("_starts").over(
                    chain.rowsBetween(Window.unboundedPreceding, 0)))
                .groupBy(*keys, "_chain")
                .agg(*[a.over_parts(n).alias(n) for n, a in aggs.items()])
                .drop("_chain"))
    single = parts.filter(~F.col("_edge"))
    for name, agg in aggs.items():
        if agg.kind == "list":
            single = single.withColumn(name, F.transform(name, lambda x: x["_v"]))
    return stitched.unionByName(single.select(*keys, *aggs))
