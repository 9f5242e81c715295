"""Document fingerprints: threshold-scaled sketches of word shingles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from turnwise.llm.mixing import numbered
from turnwise.llm.tables import BLANKS, SPACES, texts
from turnwise.plans.cut import cut

LEAST, MOST = -(1 << 63), (1 << 63) - 1


def threshold(fraction: float) -> int:
    """Hashes below it are `fraction` of all signed 64-bit hashes."""
    return LEAST + int(fraction * (1 << 64))


def sketched(df: DataFrame, text: str, out: str, words: int = 5, fraction: float = 1 / 8, floor: int = 32,
             probe: str | None = None) -> DataFrame:
    """`df` with the sketch `out` of column `text`: struct(cover, hashes).

    A shingle is `words` words in a row (a shorter text is one shingle), hashed from the 64-bit hashes of its words.
    The sketch keeps every distinct hash below `fraction` of the range, so it grows with the text and sketches of any
    two texts can be merged and compared. A text with fewer than `floor` such hashes keeps its `floor` least ones.
    `cover` is the hash up to which nothing is left out. Without words the sketch is empty and covers everything.
    With `probe`, a column of hashes, `out`_met is how many of them are among all shingles of the text.
    """
    limit = threshold(fraction)
    w, h, s, low, few = (f"_{out}_{x}" for x in ("words", "hashed", "shingles", "low", "few"))
    bare = F.btrim(F.col(text), F.lit(BLANKS))
    df = df.withColumn(w, F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACES)))
    df = df.withColumn(h, F.transform(w, lambda x: F.xxhash64(x)))
    rest = [F.col(h)]
    df = df.withColumn(s, F.when(F.size(h) >= words, F.transform(
        F.slice(rest[0], F.lit(1), F.size(h) - (words - 1)),
        lambda x, i: F.xxhash64(x, *[F.get(rest[0], i + k) for k in range(1, words)])))
        .when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn(low, F.sort_array(F.array_distinct(F.filter(s, lambda x: x < limit))))
    df = df.withColumn(few, F.when(F.size(low) >= floor, F.col(low)).otherwise(
        F.slice(F.sort_array(F.array_distinct(s)), 1, floor)))
    if probe is not None:
        df = df.withColumn(f"{out}_met", F.size(F.array_intersect(F.col(probe), F.col(s))))
    cover = (F.when(F.size(low) >= floor, limit - 1).when(F.size(few) < floor, MOST)
             .otherwise(F.element_at(few, -1)))
    return df.withColumn(out, F.struct(cover.alias("cover"), F.col(few).alias("hashes"))).drop(w, h, s, low, few)


def _common(a: Column, b: Column) -> tuple[Column, Column, Column]:
    reach = F.least(a["cover"], b["cover"])
    own, other = F.filter(a["hashes"], lambda x: x <= reach), F.filter(b["hashes"], lambda x: x <= reach)
    return own, other, F.size(F.array_intersect(own, other))


def jaccard(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of two sketches from the hashes that both cover; 1 for two empty ones."""
    own, other, both = _common(a, b)
    either = F.size(own) + F.size(other) - both
    return F.when(either == 0, 1.0).otherwise(both / either)


def containment(a: Column, b: Column) -> Column:
    """Estimated part of a's shingles that b has, from the hashes that both cover; 1 if a has none, null (no estimate)
    if it has some but none that both cover, as a short text often has beside a long one."""
    own, _, both = _common(a, b)
    return F.when(F.size(a["hashes"]) == 0, 1.0).when(F.size(own) > 0, both / F.size(own))


def probed(a: Column, fraction: float = 1 / 8) -> Column:
    """The hashes of sketch a that are to be looked up in the whole other text: those of a text that keeps all of its
    shingles, or has none below `fraction` of the range; else null, as two sketches then say enough."""
    whole = (a["cover"] == MOST) | (F.get(a["hashes"], F.lit(0)) >= threshold(fraction))
    return F.when((F.size(a["hashes"]) > 0) & whole, a["hashes"])


def merged(a: Column, b: Column) -> Column:
    """The sketch of two texts taken together: all hashes that both cover."""
    reach = F.least(a["cover"], b["cover"])
    return F.struct(reach.alias("cover"), F.sort_array(F.filter(
        F.array_union(a["hashes"], b["hashes"]), lambda x: x <= reach)).alias("hashes"))


def as_text(sketch: Column) -> Column:
    """The cover and the hashes in hexadecimal, 16 digits each."""
    return F.array_join(F.transform(F.concat(F.array(sketch["cover"]), sketch["hashes"]),
                                    lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def predecessors(keys: DataFrame) -> DataFrame:
    """For every distinct row of `keys` (id, h, n_chars, probe) the one before it in descending id, then h: prev_id,
    prev_h, prev_chars, prev_probe. The row before the first is the last."""
    line = cut(numbered(keys.distinct(), F.col("id").desc(), F.col("h")))
    n = line.count()
    before = line.select(F.col("id").alias("prev_id"), F.col("h").alias("prev_h"), F.col("n_chars").alias("prev_chars"),
                         F.col("probe").alias("prev_probe"), ((F.col("place") + 1) % max(n, 1)).alias("place"))
    return cut(line.join(before, "place").select("id", "h", "prev_id", "prev_h", "prev_chars", "prev_probe"))


def compare_edited(docs: DataFrame, words: int = 5, fraction: float = 1 / 8, floor: int = 32) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The edited text is the text with its last floor(n_chars / 3) code points replaced by the first as many (or all) of
    the next document in descending doc_id; after the last comes the first, and a single document is its own next.
    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next (Jaccard estimates)
    and contained_edited, contained_next (the part of the text's shingles that the other one has: exact for a text of
    fewer than `floor` shingles, whose hashes are looked up among all of the other one, else an estimate).

    Null text is empty; without words a fingerprint is empty and alike to an empty one only. Null doc_ids come last.
    Rows that repeat a doc_id follow each other by a hash of their text, exact repeats count once in that order and
    each comes out. Ids and lengths alone are ordered; texts move once by key, and once their starts.
    """
    # a null doc_id is a key of its own, told apart by the hash
    rows = texts(docs).select(F.coalesce("doc_id", F.lit(LEAST)).alias("id"),
                              F.xxhash64("text", F.col("doc_id").isNull()).alias("h"), "text")
    keys = sketched(rows, "text", "own", words, fraction, floor)
    before = predecessors(keys.select("id", "h", F.char_length("text").alias("n_chars"), probed(F.col("own"), fraction).alias("probe")))
    once = F.row_number().over(Window.partitionBy("id", "h").orderBy("prev_chars"))
    starts = rows.join(before, ["id", "h"]).withColumn("once", once).filter("once = 1")
    starts = sketched(starts, "text", "next", words, fraction, floor, "prev_probe").select(
        F.col("prev_id").alias("id"), F.col("prev_h").alias("h"), "next", "next_met",
        F.substring("text", F.lit(1), F.floor(F.col("prev_chars") / 3).cast("int")).alias("start"))
    both = sketched(rows.join(starts, ["id", "h"]), "text", "own", words, fraction, floor)
    n = F.char_length("text")
    edited = F.concat(F.substring("text", F.lit(1), n - F.floor(n / 3).cast("int")), F.col("start"))
    both = both.select("id", "text", "own", "next", "next_met", probed(F.col("own"), fraction).alias("probe"), edited.alias("edited"))
    both = sketched(both, "edited", "changed", words, fraction, floor, "probe")
    own, changed, following = F.col("own"), F.col("changed"), F.col("next")

    def contained(other: Column, met: str) -> Column:
        return F.when(F.col("probe").isNotNull(), F.col(met) / F.size("probe")).otherwise(containment(own, other))
    return both.select(F.nullif("id", F.lit(LEAST)).alias("doc_id"), F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
                       as_text(own).alias("fingerprint"), as_text(changed).alias("edited_fingerprint"),
                       jaccard(own, changed).alias("near_edited"), jaccard(own, following).alias("near_next"),
                       contained(changed, "changed_met").alias("contained_edited"), contained(following, "next_met").alias("contained_next"))
