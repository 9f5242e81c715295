"""Order-dependent reductions whose next decision reads the previous output."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.plans.blocks import BLOCK, balanced, by_time, running
from turnwise.plans.cut import cut


def fold_kept(df: DataFrame, keys: list[str], order: list[str], block: Column | None = None, *,
              rows_per_block: int = 1_000, row: dict[str, Column], absorbs: Callable[[Column, Column], Column],
              merge: Callable[[Column, Column], dict[str, Column]]) -> DataFrame:
    """Walk a stream in order, comparing each row with the last kept one.

    `absorbs(kept, current)` says whether the current row melts into the last kept row, which
    then becomes `merge(kept, current)`; otherwise the current row is kept as the next one.

    Each block is folded by itself, starting from what the block before it left behind. That is
    not known at first, so blocks start from nothing and are folded again for as long as the
    row handed over changes. A block whose outcome does not depend on its entry settles at
    once, so there are as many rounds as the longest chain of blocks that do depend on it.
    Without a `block` the stream is cut every `rows_per_block` rows, however they bunch up.
    """
    fields = list(row)
    body = F.struct(*[v.alias(k) for k, v in row.items()])
    if block is None:
        df = balanced(cut(df), keys, order[0], rows=rows_per_block)
        block = F.col("_cut")
    cells = (df.withColumn(BLOCK, block)
             .groupBy(*keys, BLOCK)
             .agg(F.array_sort(F.collect_list(F.struct(*order, body.alias("_r")))).alias("_sorted"))
             .select(*keys, BLOCK, F.transform("_sorted", lambda x: x["_r"]).alias("_rows")))
    cells = cut(cells)

    def step(acc: Column, cur: Column) -> Column:
        last = acc["last"]
        merged = merge(last, cur)
        melted = F.struct(*[merged.get(f, last[f]).alias(f) for f in fields])
        eats = last.isNotNull() & F.coalesce(absorbs(last, cur), F.lit(False))
        return F.struct(
            F.when(eats | last.isNull(), acc["done"])
            .otherwise(F.concat(acc["done"], F.array(last))).alias("done"),
            F.when(eats, melted).otherwise(cur).alias("last"))

    def folded(cells: DataFrame) -> DataFrame:
        start = F.struct(F.filter("_rows", lambda _: F.lit(False)).alias("done"),
                         F.col("_entry").alias("last"))
        return cells.withColumn("_out", F.aggregate("_rows", start, step))

    def exits(cells: DataFrame) -> DataFrame:
        return folded(cells).select(*keys, BLOCK, "_entry", F.col("_out.last").alias("_exit"))

    # What each block starts from and ends with: one small row a block. Only blocks whose start has moved are folded
    # again. At first nothing is known: a null of the rows' type.
    chain = Window.partitionBy(*keys).orderBy(BLOCK)
    state = cut(exits(cells.withColumn("_entry", F.when(F.lit(False), F.col("_rows")[0]))))
    while True:
        given = state.withColumn("_given", F.lag("_exit").over(chain))
        moved = cut(given.filter(~F.col("_given").eqNullSafe(F.col("_entry"))).select(*keys, BLOCK, F.col("_given").alias("_entry")))
        if moved.isEmpty():
            break
        again = exits(cells.join(moved, [*keys, BLOCK])).select(*keys, BLOCK, F.struct("_entry", "_exit").alias("_new"))
        new = F.col("_new").isNotNull()
        state = cut(state.join(again, [*keys, BLOCK], "left").select(
            *keys, BLOCK, F.when(new, F.col("_new._entry")).otherwise(F.col("_entry")).alias("_entry"),
            F.when(new, F.col("_new._exit")).otherwise(F.col("_exit")).alias("_exit")))
    ends = state.select(*keys, BLOCK, "_entry", F.lead(F.lit(1)).over(chain).isNull().alias("_final"))
    kept = F.when(F.col("_final"), F.concat(F.col("_out.done"), F.array("_out.last"))) \
        .otherwise(F.col("_out.done"))
    return (folded(cells.join(ends, [*keys, BLOCK])).select(*keys, F.explode(kept).alias("_k")).select(*keys, "_k.*"))


def _overlap(a: Column, b: Column) -> Column:
    return F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"])


def suppress(df: DataFrame, keys: list[str], *, segments: Column, score: Column, tie: str,
             share: float = 0.3, block_seconds: float = 3600.0, largest: int = 2_000,
             width: float = 600.0) -> DataFrame:
    """Greedy overlap suppression: best score first (ties by `tie`), a row is dropped if one of
    its segments overlaps a segment of a kept row by more than `share` of its own length.

    `segments` is an array<struct<start,end>>; `tie` is unique within the keys. Rows are first
    put into components, outside of which nothing can overlap. Components of up to `largest`
    rows are folded in one array each. A larger one is settled in blocks of `width` seconds that tell each other about the rows
    they share (`_in_rounds`).
    """
    base = (df.withColumn("_segs", segments).withColumn("_score", score.cast("double"))
            .withColumn("_lo", F.array_min(F.transform("_segs", lambda s: s["start"])))
            .withColumn("_hi", F.array_max(F.transform("_segs", lambda s: s["end"]))))
    base = cut(base)
    slim = base.select(*keys, tie, "_lo", "_hi")
    order = ["_lo", tie]
    peaks = running(slim, keys, order, by_time("_lo", block_seconds), peaks={"_top": F.col("_hi")})
    peaks = peaks.withColumn("_opens", F.when(F.col("_top").isNull()
                                              | (F.col("_lo") >= F.col("_top")), 1).otherwise(0))
    parts = running(peaks, keys, order, by_time("_lo", block_seconds),
                    sums={"_part": F.col("_opens")}).select(*keys, tie, "_part")
    sizes = parts.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    named = cut(base.join(parts, [*keys, tie]).join(sizes, [*keys, "_part"]))

    def step(acc: Column, cur: Column) -> Column:
        hit = F.exists(acc, lambda kept: F.exists(cur["segs"], lambda a: F.exists(
            kept["segs"], lambda b: _overlap(a, b) > (a["end"] - a["start"]) * share)))
        return F.when(hit, acc).otherwise(F.concat(acc, F.array(cur)))

    item = F.struct((-F.col("_score")).alias("neg"), F.col(tie).alias("id"),
                    F.col("_segs").alias("segs"))
    small = (named.filter(F.col("_n") <= largest).groupBy(*keys, "_part")
             .agg(F.array_sort(F.collect_list(item)).alias("_all"))
             .withColumn("_kept", F.aggregate(
                 "_all", F.filter("_all", lambda _: F.lit(False)), step))
             .select(*keys, F.explode("_kept.id").alias(tie)))
    rest = named.filter(F.col("_n") > largest).select(*keys, tie, "_score", "_segs", "_lo", "_hi")
    kept = small if rest.isEmpty() else small.unionByName(
        _in_rounds(rest, keys, tie, share, width))
    return base.join(kept, [*keys, tie], "left_semi").drop("_segs", "_score", "_lo", "_hi")


def _in_rounds(rest: DataFrame, keys: list[str], tie: str, share: float, width: float) -> DataFrame:
    """Greedy suppression block by block of `width` seconds. Each block settles its rows as far as it can, best first; what it
    cannot know is the fate of rows that other blocks share. Only these rim rows are told from round to round, so there
    are as many rounds as a chain of rows that depend on each other crosses blocks, however many rows it has in them."""
    ident = [*keys, tie]
    rest, rounds = cut(rest), []
    told = rest.limit(0)
    while not rest.isEmpty():
        verdicts = cut(_round(rest, told, keys, tie, share, width))
        rounds.append(verdicts.filter("_v >= 1").select(*ident))
        told = rest.join(verdicts.filter("_v = 1").select(*ident), ident, "left_semi")
        rest = cut(rest.join(verdicts.filter("_v = 0").select(*ident), ident, "left_semi"))
    return reduce(DataFrame.unionByName, rounds)


def _round(rest: DataFrame, told: DataFrame, keys: list[str], tie: str, share: float, width: float) -> DataFrame:
    """Verdicts on the rows of `rest`, `_v`: -1 dropped, 0 open, 1 kept and shared by several blocks, 2 kept. `told` are shared rows
    kept in the last round; what those of earlier rounds cover is gone already."""
    ident = [*keys, tie]
    first, last = F.floor(F.col("_lo") / width), F.floor(F.col("_hi") / width)
    rows = rest.withColumn("_kept", F.lit(False)).unionByName(told.withColumn("_kept", F.lit(True)))
    cells = rows.select(*ident, "_score", "_segs", "_kept", (first != last).alias("_rim"), F.explode(F.sequence(first, last)).alias("_block"))

    def settle(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["_kept", "_score", tie], ascending=[False, False, True], kind="stable")
        segs = [np.array([(s["start"], s["end"]) for s in x], float).reshape(-1, 2) for x in group["_segs"]]
        starts, ends, held = np.empty(64), np.empty(64), 0  # segments of rows that stay or may
        final = np.empty(64, bool)
        verdicts = []
        for own, kept, rim in zip(segs, group["_kept"], group["_rim"]):
            verdict = 2
            if not kept:
                for start, end in own:
                    hits = np.minimum(ends[:held], end) - np.maximum(starts[:held], start) > (end - start) * share
                    if (hits & final[:held]).any():
                        verdict = -1
                        break
                    if hits.any():
                        verdict = 0
                if verdict == 2 and rim:
                    verdict = 1
            verdicts.append(verdict)
            if verdict >= 0:
                while held + len(own) > len(starts):
                    starts, ends, final = (np.concatenate([x, np.empty_like(x)]) for x in (starts, ends, final))
                span = slice(held, held + len(own))
                starts[span], ends[span], final[span] = own[:, 0], own[:, 1], verdict == 2
                held += len(own)
        return group[ident].assign(_v=np.array(verdicts, np.int32))[~group["_kept"].to_numpy()]
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.select(*ident).schema)
    return (cells.groupBy(*keys, "_block").applyInPandas(settle, f"{shape}, _v int")
            .groupBy(*ident).agg(F.min("_v").alias("_v")))
