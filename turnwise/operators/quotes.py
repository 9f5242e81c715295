"""Find quotes in running text."""

from __future__ import annotations

import posixpath
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.functions.text import normalize
from turnwise.plans.blocks import around
from turnwise.plans.cut import asked_for, cut, small
from turnwise.schema import KEY

SHINGLE = 3


def _inner(parts: Column) -> Column:
    """Up to three words from the second on. They stand between blanks in a quote, so they are
    whole words of the text too, while its first and last word may be cut out of longer ones."""
    return F.array_join(F.slice(parts, 2, F.least(F.size(parts) - 2, F.lit(SHINGLE))), " ")


def _prepared(quotes: DataFrame) -> DataFrame:
    return (quotes.withColumn("_q", normalize(F.col("quote")))
            .withColumn("_parts", F.split("_q", " ")).withColumn("_n", F.size("_parts")))


def _keyed(prepared: DataFrame) -> DataFrame:
    """A quote's `_kind` and `_key`, which every text that contains the quote has as well:

    w1-w3  its inner words, for three words and more
    pNM    the end of the first and the start of the second word, N and M letters, for two
    c1-c3  its first letters, for one
    """
    a, b = F.col("_parts")[0], F.get("_parts", F.lit(1))
    size = F.least(F.col("_n") - 2, F.lit(SHINGLE))
    n, m = F.least(F.length(a), F.lit(2)), F.least(F.length(b), F.lit(2))
    c = F.least(F.length(a), F.lit(3))
    kind = (F.when(F.col("_n") >= 3, F.concat(F.lit("w"), size.cast("string")))
            .when(F.col("_n") == 2, F.concat(F.lit("p"), n.cast("string"), m.cast("string")))
            .otherwise(F.concat(F.lit("c"), c.cast("string"))))
    key = (F.when(F.col("_n") >= 3, _inner(F.col("_parts")))
           .when(F.col("_n") == 2, F.concat(F.right(a, n), F.lit(" "), F.left(b, m))).otherwise(F.left(a, c)))
    return prepared.withColumn("_kind", kind).withColumn("_key", key)


def _kinds(keyed: DataFrame) -> list[str]:
    """Kinds in use, ten at most, so that texts are cut only into what is asked for."""
    return sorted(r[0] for r in keyed.select("_kind").distinct().collect())


def _letters(word: Column, n: int) -> Column:
    """Runs of n letters of a word."""
    size = F.length(word)
    cuts = F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substring(word, i, F.lit(n)))
    return F.when(size >= n, cuts).otherwise(F.array().cast("array<string>"))


def _border(a: Column, b: Column, kind: str) -> Column:
    """Key of two neighbouring words, null if one is too short for the kind."""
    n, m = int(kind[1]), int(kind[2])
    return F.when((F.length(a) >= n) & (F.length(b) >= m),
                  F.concat(F.right(a, F.lit(n)), F.lit(" "), F.left(b, F.lit(m))))


def exact_anchors(quotes: DataFrame, words: DataFrame, *, block_rows: int = 50_000) -> DataFrame:
    """First place of a quote in the words of its stream: stream_id, quote_id, pos.

    Texts and quotes are compared in lower case with single blanks. A quote is found anywhere in the running text,
    also from inside a word; then the place is the next word, and in the last word there is none. Candidates meet on
    a key that both must have, the rest is compared afterwards.
    """
    # Sizes foreseen from files tell little of running text: without the hint a whole text may be sent to the driver for a broadcast.
    q = cut(_keyed(_prepared(quotes))).hint("merge")
    kinds = _kinds(q)
    inner_sizes = [int(k[1]) for k in kinds if k[0] == "w"] or [SHINGLE]
    low = words.select(*KEY, "pos", F.lower("text").alias("_w")).hint("merge")
    near = around(low, KEY, "pos", {"_near": F.col("_w")}, after=SHINGLE, block_rows=block_rows)
    long_q = q.filter("_n >= 3").withColumn("_size", F.least(F.col("_n") - 2, F.lit(SHINGLE)))
    # Keys of words and letters are several times as many as the words; those that no quote has are left out where they are made.
    keyed = near.withColumn("_size", F.explode(F.array(*[F.lit(i) for i in inner_sizes]))) \
        .filter(F.size("_near") > F.col("_size")) \
        .withColumn("_key", F.array_join(F.slice("_near", 2, F.col("_size")), " "))
    keyed = asked_for(keyed.select(*KEY, "pos", "_size", "_key", F.col("_w").alias("_first")), long_q, [*KEY, "_size", "_key"])
    met = (keyed.join(long_q.select(*KEY, "quote_id", "_parts", "_n", "_q", "_size", "_key"), [*KEY, "_size", "_key"])
           .filter(F.col("_first").endswith(F.col("_parts")[0])))
    # The candidates are few; compare each with as many words as its quote has.
    spots = met.select(*KEY, "quote_id", F.col("pos").alias("_at"), "_first", "_parts", "_n",
                       F.posexplode("_parts").alias("_i", "_part")) \
        .withColumn("pos", F.col("_at") + F.col("_i"))
    fits = (F.when(F.col("_i") == 0, F.col("_w").endswith(F.col("_part")))
            .when(F.col("_i") == F.col("_n") - 1, F.col("_w").startswith(F.col("_part")))
            .otherwise(F.col("_w") == F.col("_part")))
    whole = (spots.join(low, [*KEY, "pos"]).filter(fits)
             .groupBy(*KEY, "quote_id", "_at")
             .agg(F.count(F.lit(1)).alias("_got"), F.first("_n").alias("_n"),
                  F.first(F.col("_first") == F.col("_parts")[0]).alias("_clean"))
             .filter(F.col("_got") == F.col("_n"))
             .select(*KEY, "quote_id", F.when(F.col("_clean"), F.col("_at")).otherwise(F.col("_at") + 1).alias("pos")))
    found = [whole]
    borders = [k for k in kinds if k[0] == "p"]
    if borders:
        pair = around(low, KEY, "pos", {"_near": F.col("_w")}, after=1, block_rows=block_rows).filter(F.size("_near") == 2)
        a, b = F.col("_w"), F.col("_near")[1]
        keys = F.array(*[F.struct(F.lit(k).alias("_kind"), _border(a, b, k).alias("_key")) for k in borders])
        two = q.filter("_n = 2")
        found.append(asked_for(pair.select(*KEY, "pos", a.alias("_a"), b.alias("_b"), F.inline(keys)), two, [*KEY, "_kind", "_key"])
                     .join(two.select(*KEY, "quote_id", "_parts", "_kind", "_key"), [*KEY, "_kind", "_key"])
                     .filter(F.col("_a").endswith(F.col("_parts")[0]) & F.col("_b").startswith(F.col("_parts")[1]))
                     .select(*KEY, "quote_id", F.when(F.col("_a") == F.col("_parts")[0], F.col("pos"))
                             .otherwise(F.col("pos") + 1).alias("pos")))
    singles = [k for k in kinds if k[0] == "c"]
    if singles:
        grams = F.array_distinct(F.flatten(F.array(*[_letters(F.col("_w"), int(k[1])) for k in singles])))
        asked = q.filter("_n = 1 AND _q <> ''").select(*KEY, "quote_id", "_q", "_key")
        # Only the vocabulary of a stream is taken apart; its words then lead to their places.
        vocabulary = (asked_for(low.select(*KEY, "_w").distinct().select(*KEY, "_w", F.explode(grams).alias("_key")), asked, [*KEY, "_key"])
                      .join(asked, [*KEY, "_key"]).filter(F.col("_w").contains(F.col("_q")))
                      .select(*KEY, "quote_id", "_w", F.col("_w").startswith(F.col("_q")).alias("_clean")))
        last = low.groupBy(*KEY).agg(F.max("pos").alias("_last"))
        found.append(low.join(vocabulary, [*KEY, "_w"])
                     .select(*KEY, "quote_id", F.when(F.col("_clean"), F.col("pos")).otherwise(F.col("pos") + 1).alias("pos"))
                     .groupBy(*KEY, "quote_id").agg(F.min("pos").alias("pos"))
                     .join(last, KEY).filter(F.col("pos") <= F.col("_last")).drop("_last"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.groupBy(*KEY, "quote_id").agg(F.min("pos").alias("pos"))


def loose_anchors(quotes: DataFrame, words: DataFrame, *, span: int = 5) -> DataFrame:
    """First stretch of `span` words that contains the first and the last word of a quote (of three
    words and more), both also inside longer words.

    Of the two words the one that is rarer in the stream leads: only its places are looked at.
    """
    low = words.select(*KEY, "pos", F.lower("text").alias("_w")).hint("merge")
    last = low.groupBy(*KEY).agg(F.max("pos").alias("_last"))
    return _loose(quotes, low.select(*KEY, "_w").distinct(), lambda asked: low.join(asked, [*KEY, "_w"]), last, span)


def _loose(quotes: DataFrame, vocabulary: DataFrame, places: Callable[[DataFrame], DataFrame], last: DataFrame, span: int) -> DataFrame:
    """Loose anchors from the words of every stream, what gives their places, and the last place of every stream."""
    q = _prepared(quotes).filter("_n >= 3").select(
        *KEY, "quote_id", F.col("_parts")[0].alias("_a"), F.element_at("_parts", -1).alias("_b"))
    terms = cut(q.select(*KEY, F.explode(F.array("_a", "_b")).alias("_term")).distinct()
                .withColumn("_gram", F.substring("_term", 1, 3))).hint("merge")
    grams = F.array_distinct(F.flatten(F.array(*[_letters(F.col("_w"), n) for n in (1, 2, 3)])))
    # Only the vocabulary of a stream is taken apart; its words then lead to their places.
    asked = (asked_for(vocabulary.select(*KEY, "_w", F.explode(grams).alias("_gram")), terms, [*KEY, "_gram"])
             .join(terms, [*KEY, "_gram"]).filter(F.col("_w").contains(F.col("_term"))).select(*KEY, "_term", "_w"))
    # sizes foreseen from files say nothing of hits; without the hint they are sent to the driver for a broadcast
    hits = cut(places(asked).select(*KEY, "_term", "pos")).hint("merge")
    counts = hits.groupBy(*KEY, "_term").agg(F.count(F.lit(1)).alias("_c"))
    both = (q.join(counts.withColumnsRenamed({"_term": "_a", "_c": "_ca"}), [*KEY, "_a"])
            .join(counts.withColumnsRenamed({"_term": "_b", "_c": "_cb"}), [*KEY, "_b"])
            .withColumn("_term", F.when(F.col("_ca") <= F.col("_cb"), F.col("_a")).otherwise(F.col("_b")))
            .withColumn("_other", F.when(F.col("_ca") <= F.col("_cb"), F.col("_b")).otherwise(F.col("_a"))))
    leads = both.select(*KEY, "quote_id", "_term", "_other").join(hits, [*KEY, "_term"])
    # The other word must lie within the same stretch: look it up at the places around the lead.
    reach = span - 1
    asked = leads.select(*KEY, "quote_id", F.col("_other").alias("_term"), F.col("pos").alias("_lead"),
                         F.explode(F.sequence(F.greatest(F.col("pos") - reach, F.lit(0)), F.col("pos") + reach)).alias("pos"))
    first = F.greatest(F.lit(0), F.greatest("_lead", "pos") - reach)
    return (asked.join(hits, [*KEY, "_term", "pos"]).withColumn("_at", first)
            .groupBy(*KEY, "quote_id").agg(F.min("_at").alias("pos"))
            .join(last, KEY).filter(F.col("pos") <= F.col("_last") - 2).drop("_last"))


def _request(asked: DataFrame, rows: int = 100_000) -> DataFrame:
    """What is asked of an index, written and counted: sent to all tasks up to `rows` rows, else joined by shuffles. The index
    itself is never sent."""
    asked = cut(asked)
    return F.broadcast(asked) if asked.limit(rows + 1).count() <= rows else asked.hint("merge")


class QuoteIndex:
    """Where every word of the running texts stands, on disk, for many requests.

    places      stream_id, word, block, offsets: the places of a word in a block of the text, counted from the start of the block
    vocabulary  stream_id, word, n: how often a word occurs
    blocks      stream_id, block, words, times: the text in blocks, read only where a quote's rarest word stands
    streams     stream_id, last: the last place of a stream

    A word that holds much of a stream has a row for each block. Places and vocabulary lie in folders by a hash of the word, blocks by
    one of stream and block, each sorted, so a request reads the folders and row groups of the words it asks for.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.places, self.vocabulary, self.blocks, self.streams = (
            spark.read.parquet(posixpath.join(root, name)) for name in ("places", "vocabulary", "blocks", "streams"))
        self.parts, self.rows = self.streams.select("parts", "block_words").first() or (1, 1)

    @staticmethod
    def build(words: DataFrame, root: str, *, block_words: int = 1024, parts: int = 64) -> QuoteIndex:
        """Write the index of `words` (stream_id, pos, text, start), numbered from 0 without gaps."""
        block = F.floor(F.col("pos") / block_words).alias("block")
        low = cut(words.select(*KEY, "pos", F.lower("text").alias("word"), "start", block))
        by_word = F.pmod(F.xxhash64("word"), F.lit(parts)).alias("part")
        offset = (F.col("pos") - F.col("block") * block_words).cast("int")
        places = (low.groupBy(*KEY, "word", "block").agg(F.array_sort(F.collect_list(offset)).alias("offsets"))
                  .select(*KEY, "word", "block", "offsets", by_word))
        item = F.array_sort(F.collect_list(F.struct("pos", "word", "start")))
        blocks = (low.groupBy(*KEY, "block").agg(item.alias("_all"))
                  .select(*KEY, "block", F.col("_all.word").alias("words"), F.col("_all.start").alias("times"),
                          F.pmod(F.xxhash64(*KEY, "block"), F.lit(parts)).alias("part")))
        vocabulary = low.groupBy(*KEY, "word").agg(F.count(F.lit(1)).alias("n")).withColumn("part", by_word)
        streams = low.groupBy(*KEY).agg(F.max("pos").alias("last")).select("*", F.lit(parts).alias("parts"), F.lit(block_words).alias("block_words"))
        for name, table, order in (("places", places, ["word", *KEY, "block"]), ("vocabulary", vocabulary, ["word", *KEY]), ("blocks", blocks, [*KEY, "block"])):
            # a folder's rows come from several tasks, so that a hot word or stream is not one
            (table.repartition("part", F.pmod(F.xxhash64(*order), F.lit(8))).sortWithinPartitions("part", *order)
             .write.mode("overwrite").partitionBy("part").parquet(posixpath.join(root, name)))
        streams.write.mode("overwrite").parquet(posixpath.join(root, "streams"))
        return QuoteIndex(words.sparkSession, root)

    def places_of(self, asked: DataFrame) -> DataFrame:
        """`asked` (stream_id, _w, ...) with every `pos` of its word."""
        keyed = _request(asked).withColumn("part", F.pmod(F.xxhash64("_w"), F.lit(self.parts)))
        found = keyed.join(self.places.withColumnRenamed("word", "_w"), [*KEY, "_w", "part"])
        at = F.transform("offsets", lambda o: F.col("block") * self.rows + o)
        return found.withColumn("pos", F.explode(at)).drop("part", "block", "offsets")

    def words_at(self, spots: DataFrame) -> DataFrame:
        """`spots` (stream_id, _at, _n, ...) with `_said` and `_times`, the words of the places _at .. _at + _n - 1 and when they are said.
        Only the blocks that hold them are met."""
        others = [c for c in spots.columns if c not in KEY]
        rows = F.lit(self.rows)
        cells = _request(spots).withColumn("block", F.explode(F.sequence(F.floor(F.col("_at") / rows), F.floor((F.col("_at") + F.col("_n") - 1) / rows))))
        cells = cells.withColumn("part", F.pmod(F.xxhash64(*KEY, "block"), F.lit(self.parts)))
        low = F.greatest(F.col("_at") - F.col("block") * rows, F.lit(0)).cast("int")
        high = F.least(F.col("_at") + F.col("_n") - F.col("block") * rows, rows).cast("int")
        met = cells.join(self.blocks, [*KEY, "block", "part"]).select(
            *KEY, *others, "block", F.slice("words", low + 1, high - low).alias("_w"), F.slice("times", low + 1, high - low).alias("_t"))
        ids = [*KEY, "quote_id", "_at"]
        parts = F.array_sort(F.collect_list(F.struct("block", "_w", "_t")))
        return (met.groupBy(*ids).agg(parts.alias("_all"), *[F.first(c).alias(c) for c in others if c not in ids])
                .withColumns({"_said": F.flatten("_all._w"), "_times": F.flatten("_all._t")}).drop("_all"))

    def exact(self, quotes: DataFrame) -> DataFrame:
        """`exact_anchors` from the index: stream_id, quote_id, pos."""
        q = cut(_prepared(quotes).filter("_q <> ''").select(*KEY, "quote_id", "_parts", "_n", "_q")).hint("merge")
        words = self.vocabulary.withColumnRenamed("word", "_w").withColumnRenamed("part", "_part")
        # three words and more: the rarest inner word leads
        inner = q.filter("_n >= 3").select(*KEY, "quote_id", "_parts", "_n", F.posexplode(F.expr("slice(_parts, 2, _n - 2)")).alias("_i", "_w")) \
            .withColumn("_part", F.pmod(F.xxhash64("_w"), F.lit(self.parts)))
        lead = (inner.join(words, [*KEY, "_w", "_part"]).groupBy(*KEY, "quote_id")
                .agg(F.min(F.struct("n", "_i", "_w")).alias("_lead"), F.count(F.lit(1)).alias("_known"), F.first("_parts").alias("_parts"), F.first("_n").alias("_n"))
                .filter(F.col("_known") == F.col("_n") - 2)
                .select(*KEY, "quote_id", "_parts", "_n", (F.col("_lead._i") + 1).alias("_i"), F.col("_lead._w").alias("_w")))
        # two words: the vocabulary gives words that end like the first and words that begin like the second; the rarer side leads
        pairs = q.filter("_n = 2")
        ends, begins = ((pairs.withColumn("_i", F.lit(i)).withColumn("_part_", F.col("_parts")[i]).withColumn("_key", cut_(F.col("_part_"), F.least(F.length("_part_"), F.lit(2))))
                         .transform(lambda side, cut_=cut_: side.join(asked_for(
                             words.select(*KEY, "_w", "n", F.explode(F.array_distinct(F.array(*[cut_(F.col("_w"), F.lit(k)) for k in (1, 2)]))).alias("_key")),
                             side, [*KEY, "_key"]), [*KEY, "_key"]))
                         .filter(F.col("_w").endswith(F.col("_part_")) if i == 0 else F.col("_w").startswith(F.col("_part_"))))
                        for i, cut_ in ((0, F.right), (1, F.left)))
        sides = cut(ends.unionByName(begins).select(*KEY, "quote_id", "_parts", "_n", "_i", "_w", "n")).hint("merge")
        total = sides.groupBy(*KEY, "quote_id", "_i").agg(F.sum("n").alias("_c")).groupBy(*KEY, "quote_id").agg(
            F.min(F.struct("_c", "_i"))["_i"].alias("_i"), F.count(F.lit(1)).alias("_sides")).filter("_sides = 2").drop("_sides")
        two = sides.join(total, [*KEY, "quote_id", "_i"]).select(*KEY, "quote_id", "_parts", "_n", F.col("_i").cast("int").alias("_i"), "_w")
        spots = self.places_of(lead.unionByName(two)).withColumn("_at", F.col("pos") - F.col("_i")).filter("_at >= 0") \
            .select(*KEY, "quote_id", "_parts", "_n", "_at")
        said = F.col("_said")
        fits = ((F.size(said) == F.col("_n")) & said[0].endswith(F.col("_parts")[0]) & F.element_at(said, -1).startswith(F.element_at("_parts", -1))
                & (F.expr("slice(_said, 2, _n - 2)") == F.expr("slice(_parts, 2, _n - 2)")))
        clean = said[0] == F.col("_parts")[0]
        many = self.words_at(spots).filter(fits).select(*KEY, "quote_id", F.when(clean, F.col("_at")).otherwise(F.col("_at") + 1).alias("pos"))
        # one word: the words of the vocabulary that hold it
        one = q.filter("_n = 1").withColumn("_key", F.left("_q", F.lit(3)))
        grams = F.array_distinct(F.flatten(F.array(*[_letters(F.col("_w"), k) for k in (1, 2, 3)])))
        holding = (asked_for(words.select(*KEY, "_w", F.explode(grams).alias("_key")), one, [*KEY, "_key"]).join(one, [*KEY, "_key"]).filter(F.col("_w").contains(F.col("_q")))
                   .select(*KEY, "quote_id", "_w", F.col("_w").startswith(F.col("_q")).alias("_clean")))
        single = (self.places_of(holding).select(*KEY, "quote_id", F.when(F.col("_clean"), F.col("pos")).otherwise(F.col("pos") + 1).alias("pos"))
                  .groupBy(*KEY, "quote_id").agg(F.min("pos").alias("pos"))
                  .join(self.streams.select(*KEY, "last").hint("merge"), KEY).filter(F.col("pos") <= F.col("last")).drop("last"))
        return many.unionByName(single).groupBy(*KEY, "quote_id").agg(F.min("pos").alias("pos"))

    def anchor(self, quotes: DataFrame) -> DataFrame:
        """`anchor_quotes` from the index: quotes with pos, how and time. No word of a text is read but those where a quote's
        rarest word stands."""
        keys = [*KEY, "quote_id"]
        quotes = cut(quotes).hint("merge")
        exact = cut(self.exact(quotes).withColumn("how", F.lit("exact")))
        open_ = cut(quotes.join(exact.select(*keys), keys, "left_anti"))
        vocabulary = self.vocabulary.select(*KEY, F.col("word").alias("_w")).hint("merge")
        last = self.streams.select(*KEY, F.col("last").alias("_last")).hint("merge")
        loose = _loose(open_, vocabulary, self.places_of, last, 5)
        found = cut(exact.unionByName(loose.withColumn("how", F.lit("loose")))).hint("merge")
        said = self.words_at(found.select(*keys, F.col("pos").alias("_at"), F.lit(1).alias("_n")))
        timed = found.join(said.select(*keys, F.col("_times")[0].alias("time")), keys, "left")
        return quotes.join(timed.select(*keys, "pos", "how", "time"), keys, "left")


def anchor_quotes(quotes: DataFrame, words: DataFrame) -> DataFrame:
    """Time at which a quote is said: exact place, else the loose one, else null.

    quotes: stream_id, quote_id, quote. Words are numbered from 0 without gaps (`pos`).
    """
    keys = [*KEY, "quote_id"]
    # Both searches read the words several times; what made them is not run again.
    words = cut(words.select(*KEY, "pos", "text", "start")).hint("merge")
    quotes = cut(quotes).hint("merge")
    exact = exact_anchors(quotes, words).withColumn("how", F.lit("exact"))
    exact = cut(exact)
    open_ = cut(quotes.join(exact.select(*keys), keys, "left_anti"))
    found = exact.unionByName(loose_anchors(open_, words).withColumn("how", F.lit("loose")))
    timed = found.join(words.select(*KEY, "pos", F.col("start").alias("time")), [*KEY, "pos"], "left")
    return quotes.join(timed, keys, "left")


def quotes_in_documents(quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """All documents a quote occurs in: item_id, doc_id, offset in the normalized text. A quote of any length is found
    anywhere, also from inside a word.

    Texts are cut into keys where they lie. The quotes, and then the pairs of document and quote that share a key,
    are counted: up to a million rows they are broadcast, so no text is shuffled; beyond, they are joined by shuffles.
    """
    q = _keyed(_prepared(quotes.withColumnRenamed("text", "quote")).filter("_q <> ''")).select("item_id", "_q", "_kind", "_key")
    kinds = _kinds(q)
    texts = docs.select("doc_id", normalize(F.col("text")).alias("_text")).withColumn("_w", F.split("_text", " "))
    w = F.col("_w")

    def keys(kind: str) -> Column:
        if kind[0] == "w":
            n = int(kind[1])
            runs = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
            found = F.when(F.size(w) >= n, runs)
        elif kind[0] == "p":
            found = F.when(F.size(w) >= 2, F.transform(F.sequence(F.lit(0), F.size(w) - 2),
                                                       lambda i: _border(F.get(w, i), F.get(w, i + 1), kind)))
        else:
            found = F.flatten(F.transform(F.array_distinct(w), lambda x: _letters(x, int(kind[1]))))
        found = F.array_distinct(F.coalesce(found, F.array().cast("array<string>")))
        return F.transform(found, lambda k: F.struct(F.lit(kind).alias("_kind"), k.alias("_key")))
    if not kinds:
        return q.select("item_id", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("offset"))
    cut_up = texts.select("doc_id", F.inline(F.flatten(F.array(*[keys(k) for k in kinds]))))
    met = cut_up.join(small(q), ["_kind", "_key"]).select("doc_id", "item_id", "_q").distinct()
    return (texts.select("doc_id", "_text").join(small(met), "doc_id")
            .withColumn("offset", F.expr("locate(_q, _text)")).filter("offset > 0")
            .select("item_id", "doc_id", (F.col("offset") - 1).cast("long").alias("offset")))
