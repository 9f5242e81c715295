"""Votes, ranks and confidences of several runs, passes or methods.

Items are rows of a long table, so every figure is a grouped aggregate that combines map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.plans.blocks import ranked
from turnwise.plans.cut import join_per_key


def majority(votes: DataFrame, *, keys: list[str], value: str = "value", run: str = "run",
             confident_from: float = 0.67) -> DataFrame:
    """Modal value (on a tie the one of the earliest run), its share, the run that stands for it."""
    per_value = votes.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"), F.min(run).alias("_first"))
    return (per_value.groupBy(*keys)
            .agg(F.max_by(F.struct(F.col(value).alias("v"), "_n", "_first"),
                          F.struct(F.col("_n"), -F.col("_first"))).alias("_w"), F.sum("_n").alias("votes"))
            .select(*keys, F.col("_w.v").alias("winner"), (F.col("_w._n") / F.col("votes")).alias("agreement"),
                    F.col("_w._first").alias("representative"), "votes")
            .withColumn("confident", F.col("agreement") >= confident_from))


def agreement_confidence(agreement: Column, samples: Column) -> Column:
    """Share of the majority, a little more for many samples, less below one half; 0..1."""
    bonus = F.least(F.lit(0.1), (samples - 2) * 0.02)
    short = F.when(agreement < 0.5, (0.5 - agreement) * 0.5).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), agreement - short + bonus))


def two_pass(votes: DataFrame, *, keys: list[str], value: str = "value", run: str = "run") -> DataFrame:
    """First against second pass: 0.9 if they say the same, else 0.4."""
    sides = votes.filter(F.col(run).isin(1, 2)).groupBy(*keys).agg(
        F.max(F.when(F.col(run) == 1, F.col(value))).alias("first"),
        F.max(F.when(F.col(run) == 2, F.col(value))).alias("second"))
    same = F.col("first").eqNullSafe(F.col("second"))
    return sides.withColumn("agree", same).withColumn("confidence", F.when(same, 0.9).otherwise(0.4))


def verify(passes: DataFrame, *, keys: list[str], at_least: float = 0.67) -> DataFrame:
    """Share of passes that saw the change, share of the modal type, and whether that is enough.
    passes: keys, run, detected, change_type"""
    types = majority(passes, keys=keys, value="change_type").select(*keys, F.col("agreement").alias("type_agreement"))
    seen = passes.groupBy(*keys).agg(F.avg(F.col("detected").cast("double")).alias("change_agreement"))
    return seen.join(types, keys).withColumn("verified", F.col("change_agreement") >= at_least)


def change_events(comparisons: DataFrame, checks: DataFrame, *, keys: list[str]) -> DataFrame:
    """Changes seen between two frames as events at the later frame's time.

    Types are compared without regard to case; `no_change` gives no event. A confirmed change gains
    a fifth of the mean agreement, one that failed its check is kept at x 0.7, and all confidences
    are then taken down by a tenth.
    """
    kind = F.lower("change_type")
    rows = comparisons.filter(F.col("detected") & (kind != "no_change")).join(checks, keys, "left")
    raised = F.least(F.lit(1.0), F.col("confidence") + (F.col("change_agreement") + F.col("type_agreement")) / 2 * 0.2)
    base = F.when(F.col("verified").isNull(), F.col("confidence")).when(F.col("verified"), raised).otherwise(F.col("confidence") * 0.7)
    text = (F.when(kind == "new_person", F.concat(F.coalesce("who", F.lit("New person")), F.lit(" appeared")))
            .when(kind == "person_left", F.concat(F.coalesce("who", F.lit("Someone")), F.lit(" left")))
            .when(kind == "layout_change", F.lit("Layout changed")).otherwise("Unknown change"))
    return rows.select(*keys, F.col("later_time").alias("time"), kind.alias("event_type"), text.alias("description"),
                       F.round(base * 0.9, 3).alias("confidence"))


def borda(ranks: DataFrame, weights: dict[str, float] | DataFrame, *, keys: list[str], item: str = "item",
          width: float = 1.0) -> DataFrame:
    """Weighted Borda count over ranks 1, 2, ... per method: score, rank by score, map of ranks.

    ranks: keys, method, item, rank. Weights are a dict or a table (method, weight); methods without
    one count 1. `width` is the score range
    numbered in one go when a list is long.
    """
    sizes = ranks.groupBy(*keys, "method").agg(F.count(F.lit(1)).alias("_size"))
    if isinstance(weights, DataFrame):
        sizes = sizes.join(weights.select("method", F.col("weight").alias("_weight")), "method", "left")
        weight = F.coalesce("_weight", F.lit(1.0))
    else:
        weight = F.lit(1.0)
        for method, value in weights.items():
            weight = F.when(F.col("method") == method, value).otherwise(weight)
    points = (F.col("_size") - F.col("rank") + 1) * weight
    scored = (ranks.join(sizes, [*keys, "method"]).groupBy(*keys, item)
              .agg(F.sum(points).alias("borda"), F.var_pop("rank").alias("_var"), F.count(F.lit(1)).alias("_n"),
                   F.map_from_entries(F.array_sort(F.collect_list(F.struct("method", "rank")))).alias("method_ranks")))
    best = scored.groupBy(*keys).agg(F.max("borda").alias("_best"))
    sure = F.when(F.col("_best") > 0, F.col("borda") / F.col("_best")).otherwise(0.5) \
        - F.when(F.col("_n") > 1, F.least(F.lit(0.3), F.col("_var") * 0.05)).otherwise(0.0)
    scored = (join_per_key(scored, best, keys, [*keys, item])
              .withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure)))
              .drop("_var", "_n", "_best"))
    return ranked(scored, keys, -F.col("borda"), [item], width, name="final_rank")


def method_agreement(ranks: DataFrame, *, keys: list[str], item: str = "item") -> DataFrame:
    """Mean over pairs of methods of (rho + 1) / 2; 0.5 for a pair with at most one common item,
    1 for a single method."""
    a = ranks.select(*keys, item, F.col("method").alias("m1"), F.col("rank").alias("r1"))
    b = ranks.select(*keys, item, F.col("method").alias("m2"), F.col("rank").alias("r2"))
    gap = (F.col("r1") - F.col("r2")).cast("double")
    common = (a.join(b, [*keys, item]).filter(F.col("m1") < F.col("m2")).groupBy(*keys, "m1", "m2")
              .agg(F.count(F.lit(1)).alias("_n"), F.sum(gap * gap).alias("_d2")))
    methods = ranks.select(*keys, "method").distinct()
    pairs = (methods.withColumnRenamed("method", "m1").join(methods.withColumnRenamed("method", "m2"), keys)
             .filter(F.col("m1") < F.col("m2")).join(common, [*keys, "m1", "m2"], "left"))
    n = F.col("_n").cast("double")
    rho = 1 - 6 * F.col("_d2") / (n * (n * n - 1))
    value = F.when(F.col("_n") > 1, (rho + 1) / 2).otherwise(0.5)
    mean = pairs.groupBy(*keys).agg(F.avg(value).alias("_mean"))
    return (methods.select(*keys).distinct().join(mean, keys, "left")
            .select(*keys, F.coalesce("_mean", F.lit(1.0)).alias("agreement")))


def calibrate(raw: Column, signals: Column, agreement: Column | None = None) -> Column:
    """x 0.85, up to +0.1 for several signals, +0.1 for high agreement, -0.2 for low; 0..1."""
    value = raw * 0.85 + F.when(signals > 1, F.least(F.lit(0.1), (signals - 1) * 0.03)).otherwise(0.0)
    if agreement is not None:
        value = (F.when(agreement >= 0.8, F.least(F.lit(1.0), value + 0.1))
                 .when(agreement < 0.5, F.greatest(F.lit(0.0), value - 0.2)).otherwise(value))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def rescale(rows: DataFrame, *, keys: list[str], value: str, low: float = 0.3, high: float = 0.9) -> DataFrame:
    """Spread the values of a batch over [low, high] unless they are all the same; round to 3."""
    ends = rows.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    spread = F.when(F.col("_hi") > F.col("_lo"), low + (high - low) * ((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))))
    return (rows.join(ends, keys).withColumn(value, F.round(spread.otherwise(F.col(value)), 3)).drop("_lo", "_hi"))


def usage_cost(usage: DataFrame, *, key: str, per_million_in: float, per_million_out: float) -> DataFrame:
    """Calls, tokens and cost per key, and in the row without a key in all."""
    cost = (F.sum("input_tokens") / 1e6 * per_million_in + F.sum("output_tokens") / 1e6 * per_million_out)
    return (usage.rollup(key).agg(F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"),
                                  F.sum("output_tokens").alias("output_tokens"), F.round(cost, 4).alias("cost")))


def minutes_cost(seconds: Column, per_minute: float) -> Column:
    return F.round(seconds / 60 * per_minute, 4)
