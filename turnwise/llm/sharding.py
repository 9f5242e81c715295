"""Shards by weighted hash draws down a tree of regions, racks and shards."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from turnwise.llm.tables import columns, unit
from turnwise.plans.cut import cut

Tree = dict[str, dict[str, dict[int, float]]]


def even_tree(shards: int, regions: int = 4, racks: int = 2) -> Tree:
    """A tree of equal shards, dealt out to `regions` x `racks`; the first ones get what does not divide."""
    tree: Tree = {}
    for shard in range(shards):
        place = shard * regions * racks // shards if shards >= regions * racks else shard
        tree.setdefault(f"region{place // racks}", {}).setdefault(f"rack{place % racks}", {})[shard] = 1.0
    return tree


def grown_tree(tree: Tree, shard: int, weight: float = 1.0) -> Tree:
    """`tree` with one more shard in a region of its own, so no weight of an old region, rack or shard changes."""
    return {**tree, f"region_of_{shard}": {"rack0": {shard: weight}}}


def _weight(node) -> float:
    return sum(map(_weight, node.values())) if isinstance(node, dict) else node


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard of `key`.

    On every level each child draws -ln(u) / weight with a hash u of key and child, and the least draw wins, so a
    child wins in proportion to its weight. A child whose weight rises can only win keys, one whose weight falls can
    only lose keys, and all other children keep theirs; below, only racks and shards of changed weight win or lose.
    """
    def descend(node, path: str) -> Column:
        kids = {k: w for k, w in node.items() if _weight(w) > 0}
        if len(kids) == 1:
            (k, w), = kids.items()
            return descend(w, f"{path}/{k}") if isinstance(w, dict) else F.lit(k)
        draws = [-F.log(unit(F.xxhash64(key, F.lit(f"{path}/{k}")))) / _weight(w) for k, w in kids.items()]
        least = F.least(*draws)
        chosen = None
        for (k, w), draw in zip(kids.items(), draws):
            below = descend(w, f"{path}/{k}") if isinstance(w, dict) else F.lit(k)
            chosen = F.when(draw == least, below) if chosen is None else chosen.when(draw == least, below)
        return chosen
    return descend(tree, "").cast("int")


def assign_shards(docs: DataFrame, tree: Tree, block_rows: int = 4096) -> DataFrame:
    """Every row with the shard of its doc_id and a place in it.

    Returns doc_id, size (UTF-8 bytes of text plus 1, null text counts 0 bytes), text_crc32, law `key`, shard,
    slot (0, 1, ... without gaps in each shard), grown_shard (with one more shard, numbered next).

    Shards depend on doc_id and the tree alone. Slots number a shard block by block, a block being a hash range of
    about `block_rows` rows, so no task holds a shard. Rows of one doc_id share its shard and follow each other by
    size and checksum; a null doc_id is a key like any other. An empty table gives no rows.
    """
    more = grown_tree(tree, 1 + max(s for region in tree.values() for rack in region.values() for s in rack))
    text = F.coalesce("text", F.lit(""))
    rows = cut(columns(docs, doc_id="bigint", text="string").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        shard_of(F.col("doc_id"), tree).alias("shard"), shard_of(F.col("doc_id"), more).alias("grown_shard")))
    shards = sum(len(rack) for region in tree.values() for rack in region.values())
    blocks = max(1, math.ceil(rows.count() / shards / block_rows))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit("block")), F.lit(blocks)).cast("int"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "block").count().select(
        "shard", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "size", "text_crc32"))
    return (rows.withColumn("place", place).join(starts, ["shard", "block"])
            .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                    (F.col("start") + F.col("place") - 1).cast("long").alias("slot"), "grown_shard"))
