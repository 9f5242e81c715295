"""Left joins of many narrow rows to a table with one row per key, whatever few keys most rows have."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.plans.cut import cut

HEAVY = 2000  # a key with more than one in so many rows is heavy; so there are fewer heavy keys than this


def lookup(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """`rows`, a written table, left-joined to `table` on `key`, which is unique there.

    Rows of heavy keys meet their entries by a broadcast of fewer than HEAVY entries. All others are shuffled, so a
    task gets a HEAVY-th of the rows for any one key. Rows without a key match nothing and are dealt out evenly.
    """
    named = F.col(key).isNotNull()
    heavy = cut(rows.filter(named).groupBy(key).count().filter(F.col("count") * HEAVY > rows.count()).select(key))
    more = [c for c in table.columns if c != key]
    dealt = F.when(named, F.lit(0).cast("long")).otherwise(F.monotonically_increasing_id())
    keyed = table.withColumn("dealt_", F.lit(0).cast("long"))
    if heavy.isEmpty():
        return rows.withColumn("dealt_", dealt).join(keyed, [key, "dealt_"], "left").select(*rows.columns, *more)
    known = heavy.join(table, key, "left").withColumn("heavy_", F.lit(True))
    met = rows.join(F.broadcast(known), key, "left")
    rest = met.filter(F.col("heavy_").isNull()).select(*rows.columns).withColumn("dealt_", dealt)
    return (met.filter("heavy_").select(*rows.columns, *more)
            .unionByName(rest.join(keyed, [key, "dealt_"], "left").select(*rows.columns, *more)))
