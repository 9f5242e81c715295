"""URL filters: a blocked Bloom filter of listed URLs before an exact join."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.llm.tables import columns

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = 8  # 64-bit words of a block, one bit of a key in each
FILTER_LIMIT = 32 << 20  # bytes of a filter that may be broadcast


def host_of(url: Column) -> Column:
    """What stands between the first `://` and `/`, `?`, `#` or the end, A-Z in lower case; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """Host without port and a leading `www.` or `m.`, path without a last `/` or `.html`. Scheme, query and fragment
    are gone already."""
    return F.concat(F.regexp_replace(host, r"^(www|m)\.(?=.*\.)|:[0-9]*$", ""),
                    F.regexp_replace(path, r"(/|\.html)$", ""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, nulls if none does. `rules` is a short list of (verdict, host,
    path prefix) and goes into the plan as literals."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, at, prefix in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(prefix)
        rule, verdict = F.when(fits, at + prefix).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _bits(key: Column) -> list[Column]:
    """One bit for each word of the block, six bits of a second hash each."""
    second = F.xxhash64(key, F.lit("bits"))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(second, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
            for i in range(WORDS)]


def bloom_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """The filter of the column `key`: one row (block, w0 .. w7) for each block of 512 bits in which a key lies."""
    return (listed.select(F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"),
                          *[b.alias(f"w{i}") for i, b in enumerate(_bits(F.col("key")))])
            .groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)]))


def listed_urls(urls: DataFrame, listed: DataFrame, bits_per_key: int = 16) -> DataFrame:
    """`urls` (row, key) with `hit`: does its key occur in `listed` (key)?

    A blocked Bloom filter of the list passes all keys that occur and about one other in a thousand; only those meet
    the list in a hash join on the key itself, which removes the false ones. The filter has `bits_per_key` bits a
    key; its size is known before it is used, and only up to FILTER_LIMIT it is broadcast. A larger one is joined by
    block. Null keys and an empty list give false. The list may repeat keys.
    """
    listed = listed.select("key").filter(F.col("key").isNotNull()).distinct()
    blocks = max(1, math.ceil(listed.count() * bits_per_key / (64 * WORDS)))
    bloom = bloom_filter(listed, blocks)
    if blocks * (WORDS + 1) * 8 <= FILTER_LIMIT:
        bloom = F.broadcast(bloom)
    passes = F.lit(True)
    for i, bit in enumerate(_bits(F.col("key"))):
        passes = passes & (F.col(f"w{i}").bitwiseAND(bit) != 0)
    tested = (urls.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks))).join(bloom, "block", "left")
              .withColumn("passes", F.coalesce(F.col("key").isNotNull() & passes, F.lit(False))))
    kept = urls.columns
    hits = (tested.filter("passes").select(*kept)
            .join(listed.withColumn("hit", F.lit(True)), "key", "left")
            .select(*kept, F.coalesce("hit", F.lit(False)).alias("hit")))
    return hits.unionByName(tested.filter(~F.col("passes")).select(*kept, F.lit(False).alias("hit")))


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """The verdict on every url of `pages` (page_id, url): the longest fitting rule's, else block if the canonical url
    is in `listed` (url), else allow.

    Returns page_id, host, path, rule, verdict, canonical. A null url, or one without `://`, has empty host and path,
    fits no rule and is in no list, so it is allowed. Repeated rows come out as often as they go in.
    """
    def split(df: DataFrame, *more: str) -> DataFrame:
        own = columns(df, *more, url="string")
        own = own.select(*more, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
        return own.withColumn("key", F.when(F.col("host") != "", canonical(F.col("host"), F.col("path"))))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    judged = listed_urls(split(pages, "page_id"), split(listed))
    return judged.select("page_id", "host", "path", rule.alias("rule"),
                         F.coalesce(says, F.when(F.col("hit"), "block").otherwise("allow")).alias("verdict"),
                         F.col("key").alias("canonical"))
