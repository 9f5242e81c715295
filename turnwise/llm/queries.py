"""The queries of this package over the test tables, with SQL where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm import (audit, bpe, chunks, fingerprints, html, jaccard, language, mixing, secret_scan, sharding, spelling, unigram,
                          urls)
from turnwise.llm.tables import short_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Words of a host name whose pages make the list of blocked urls.
LISTED_WORDS = ("ads", "spam", "casino", "pills", "adult", "bets")
LISTED = r"(^|[.-])(" + "|".join(LISTED_WORDS) + r")([.-]|$)"
TREE = sharding.even_tree(16)


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run
    return register


def documents(spark: SparkSession, sf: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{sf}/documents.parquet")


def pages(spark: SparkSession, sf: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{sf}/pages.parquet")


@query("op1_fingerprints")
def op1(spark, sf):
    """Sketches of every document, of its edited text and of the next document."""
    return fingerprints.compare_edited(documents(spark, sf))


@query("op3_url_filter", r"""
WITH split AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages),
named AS (
  SELECT *, CASE WHEN host <> '' THEN
      CASE WHEN regexp_matches(host, '^(www|m)\..*\.') THEN regexp_replace(host, '^(www|m)\.', '') ELSE host END
      || regexp_replace(path, '(/|\.html)$', '') END AS canonical,
    (host = 'org' OR ends_with(host, '.org')) AS org, (host = 'com' OR ends_with(host, '.com')) AS com,
    (host = 'example.org' OR ends_with(host, '.example.org')) AS example
  FROM split),
listed AS (SELECT DISTINCT canonical AS c FROM named WHERE canonical IS NOT NULL
           AND regexp_matches(host, '""" + LISTED + r"""')),
ruled AS (
  SELECT *, CASE WHEN example AND starts_with(path, '/en/1') THEN 'example.org/en/1'
      WHEN example AND starts_with(path, '/es/') THEN 'example.org/es/'
      WHEN com AND starts_with(path, '/fr/') THEN 'com/fr/' WHEN com AND starts_with(path, '/de/') THEN 'com/de/'
      WHEN org AND starts_with(path, '/') THEN 'org/' END AS rule FROM named)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN c IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, canonical
FROM ruled LEFT JOIN listed ON canonical = c""")
def op3(spark, sf):
    """Every page url against the rules and against the list of urls seen on hosts with a listed word."""
    rows = pages(spark, sf)
    return urls.judge(rows, rows.filter(urls.host_of(F.col("url")).rlike(LISTED)), RULES)


@query("op6_mixing")
def op6(spark, sf):
    """All documents mixed at weights 5, 2, 1 by source."""
    return mixing.mix(documents(spark, sf))


@query("op10_sharding")
def op10(spark, sf):
    """Every document's shard of 16, its place there, and its shard of 17."""
    return sharding.assign_shards(documents(spark, sf), TREE)


@query("op4_bpe")
def op4(spark, sf):
    """Ids of every document under a public byte-level tokenizer, and the text they give back."""
    import public_tokenizers
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = bpe.encode(documents(spark, sf), path, decoded=True)
    return coded.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op5_token_counts")
def op5(spark, sf):
    """Pieces of every document under a unigram vocabulary."""
    import public_tokenizers
    return unigram.count_tokens(documents(spark, sf), public_tokenizers.path("piece_bpe_32k.model"))


@query("op8_exact_dedup", r"""
WITH texts AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept,
       sha256(t) AS text_sha256
FROM texts WINDOW w AS (PARTITION BY t)""")
def op8(spark, sf):
    """Equal texts of the documents."""
    return chunks.duplicates(documents(spark, sf)).drop("text_hash")


@query("op7_language")
def op7(spark, sf):
    """Language of every page, from its text, its html tag, its address and its host."""
    labelled = documents(spark, sf)
    model = language.train(labelled)
    rows = pages(spark, sf)
    host = urls.host_of(F.col("url"))
    tag = F.regexp_extract("html", r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1)
    rows = rows.select("page_id", F.col("html").alias("text"), host.alias("host"),
                       F.regexp_extract(host, r"\.([a-z]+)(:[0-9]*)?$", 1).alias("suffix"), F.lower(tag).alias("declared"))
    return language.identify(rows, model, markup=True, reach=language.floors(labelled, model))


@query("op2_html_extraction")
def op2(spark, sf):
    """Main text of every page."""
    return html.extract(pages(spark, sf)).withColumn("n_chars", F.char_length("text").cast("long"))


@query("op9_ngram_jaccard")
def op9(spark, sf):
    """Groups of near copies among the documents."""
    return jaccard.near_groups(documents(spark, sf))


@query("op11_filter_audit", r"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
split AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM texts),
label AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
failing AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, CASE WHEN len(w) < 200 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
  FROM split LEFT JOIN label USING (doc_id)),
masks AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM failing GROUP BY part, mask),
letter AS (SELECT unnest([1, 2, 4, 8, 16]) AS bit, unnest(['A', 'B', 'C', 'D', 'E']) AS name),
orders AS (
  SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letter a, letter b, letter c, letter d, letter e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (SELECT filter_order, step, bits[step] AS bit, list_sum(bits[1:step - 1])::INT AS before FROM orders, range(1, 6) r(step)),
counted AS (
  SELECT part, filter_order, step, any_value(bit) AS bit, coalesce(sum(n) FILTER (mask & (coalesce(before, 0) | bit) = 0), 0) AS kept,
    coalesce(sum(n) FILTER (mask & bit > 0 AND mask & coalesce(before, 0) = 0), 0) AS removed,
    coalesce(sum(n) FILTER (mask & bit > 0 AND mask & coalesce(before, 0) > 0), 0) AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
    coalesce(sum(good) FILTER (mask & bit > 0 AND mask & coalesce(before, 0) = 0), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (mask & bit > 0 AND mask & coalesce(before, 0) = 0), 0) AS toxic_lost
  FROM masks, steps GROUP BY part, filter_order, step)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM counted""")
def op11(spark, sf):
    """What five filters remove from the documents of each language, in every order."""
    return audit.audit(audit.quality_failures(documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")))


@query("op12_spelling_variants")
def op12(spark, sf):
    """Words of the documents with their near words, forms and roots."""
    return spelling.variants(documents(spark, sf)).select("word", "form", "root", "n", "n_near", "form_n")


@query("op13_secret_scan")
def op13(spark, sf):
    """Secrets in every document."""
    return secret_scan.digests(secret_scan.scan(documents(spark, sf)))
