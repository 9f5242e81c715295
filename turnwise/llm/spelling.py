"""Spelling variants: words one edit apart, found by probing Bloom filters with generated edits."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.lookup import lookup
from turnwise.llm.tables import columns, small_batches, word_pieces
from turnwise.plans.cut import cut

BATCH = 4 << 20
HELD = 200_000  # distinct words that a task counts before it passes them on
POOL = 1 << 20  # bytes of words of one length that are probed together
PROBES = 1 << 18  # probes made at once
LANES = 8  # 64-bit words of a Bloom block, one bit of a word in each
BITS_PER_WORD = 24  # at least; sizes are powers of two
FILTER_BYTES = 32 << 20  # of all filters that are broadcast at once; more words take more passes
LONGEST_SHARD = 64  # words of this length and beyond share a filter
_FACTOR = np.uint64(0xD6E8FEB86659FD93)

#: One byte for each code point up to U+00FF: A-Z in lower case, all that is no letter of a word to blanks.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def runs(text: str) -> Counter[bytes]:
    """How often each maximal run of A-Z, a-z and U+00C0 to U+00FF stands in a text, A-Z in lower case, as Latin-1."""
    found: Counter[bytes] = Counter()
    for words in word_pieces(text.encode("latin-1", "replace").translate(_LETTERS)):
        found.update(words)
    return found


def mangled(run: bytes, prefix: int) -> bytes:
    """`run`, for one checksum in 97 without one of its letters. `prefix` is the crc32 of what stands before it."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), prefix)
    return run if h % 97 else run[:h % len(run)] + run[h % len(run) + 1:]


def vocabulary(docs: DataFrame, least_length: int = 5, least: int = 3) -> DataFrame:
    """(word, n): words of at least `least_length` letters that occur `least` times or more in `docs` (doc_id, text).

    A word is a run of letters, lower-cased in A-Z, that loses one letter if the crc32 of `<doc_id>:<run>` is divisible
    by 97; a null doc_id is written as nothing there. Null texts have no words.
    """
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter[bytes] = Counter()

        def out() -> pd.DataFrame:
            return pd.DataFrame({"word": [w.decode("latin-1") for w in total], "n": list(total.values())}).astype({"n": "int64"})
        for frame in small_batches(frames, "text", BATCH):
            for name, text in zip(frame.name, frame.text):
                prefix = zlib.crc32(f"{name}:".encode())
                for run, n in runs(text).items():
                    word = mangled(run, prefix)
                    if len(word) >= least_length:
                        total[word] += n
            if len(total) > HELD:
                yield out()
                total.clear()
        if total:
            yield out()
    own = columns(docs, doc_id="bigint", text="string").select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    return own.mapInPandas(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _marks(places: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """A 64-bit random number for each place of a word and letter there."""
    x = (places.astype(np.uint64) << np.uint64(8) | letters.astype(np.uint64)) + np.uint64(0x9E3779B97F4A7C15)
    for _ in range(3):
        x = (x ^ x >> np.uint64(32)) * _FACTOR
    return x ^ x >> np.uint64(29)


def sums(letters: np.ndarray) -> np.ndarray:
    """The hash of each row of letters: the sum of its marks. An edit changes it by few terms."""
    return _marks(np.arange(letters.shape[1])[None, :], letters).sum(axis=1, dtype=np.uint64)


def _lane(h: np.ndarray, lane: int) -> np.ndarray:
    """The bit of a word in one of the lanes of its block."""
    return np.uint64(1) << ((h * _FACTOR) >> np.uint64(58 - 6 * lane) & np.uint64(63))


def _pass_of(h: np.ndarray, passes: int) -> np.ndarray:
    return (h >> np.uint64(40)) % np.uint64(passes)


class Filters:
    """A blocked Bloom filter for each length, for the words of one pass."""

    def __init__(self, blocks: dict[int, np.ndarray], turn: int, passes: int):
        self.blocks, self.turn, self.passes = blocks, turn, passes

    def may_hold(self, length: int, h: np.ndarray) -> np.ndarray:
        """Places in the flat `h` of hashes that words of this length may have."""
        table = self.blocks.get(min(length, LONGEST_SHARD))
        if table is None:
            return np.empty(0, np.int64)
        at = np.flatnonzero(_pass_of(h, self.passes) == self.turn) if self.passes > 1 else None
        left = h if at is None else h[at]
        for lane in range(LANES):  # most fail in the first lane
            hit = np.flatnonzero(table[left & np.uint64(len(table) - 1), lane] & _lane(left, lane))
            left, at = left[hit], hit if at is None else at[hit]
        return at


def hashed(words: DataFrame) -> DataFrame:
    """(shard, h) of every word: its length, up to LONGEST_SHARD, and hash."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for length, letters, _ in pools([frame], 1 << 40):
                yield pd.DataFrame({"shard": np.full(len(letters), min(length, LONGEST_SHARD), np.int32), "h": sums(letters).view(np.int64)})
    return words.mapInPandas(run, "shard int, h bigint")


def pools(frames: Iterator[pd.DataFrame], limit: int = POOL) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, letters as a matrix, n) of words of one length, about `limit` bytes at a time."""
    held: dict[int, list[tuple[bytes, int]]] = {}

    def matrix(length: int, rows: list[tuple[bytes, int]]):
        return length, np.frombuffer(b"".join(w for w, _ in rows), np.uint8).reshape(-1, length), np.array([n for _, n in rows], np.int64)
    for frame in frames:
        for word, n in zip(frame.word, frame.n.tolist()):
            rows = held.setdefault(len(word), [])
            rows.append((word.encode("latin-1"), n))
            if len(rows) * len(word) >= limit:
                yield matrix(len(word), held.pop(len(word)))
        if sum(length * len(rows) for length, rows in held.items()) > 8 * limit:
            yield from (matrix(*item) for item in held.items())
            held = {}
    yield from (matrix(*item) for item in held.items())


def filters(words: DataFrame, filter_bytes: int = FILTER_BYTES) -> Iterator[Filters]:
    """Blocked Bloom filters of the written `words` (word, n), sharded by length, in as many passes as it takes to keep what is
    broadcast at once below `filter_bytes`: a pass has the words of some of the hashes, and only probes of these ask it."""
    keys = hashed(words)
    counts = {r.shard: r["count"] for r in keys.groupBy("shard").count().collect()}  # LONGEST_SHARD rows at most
    width = LANES * 64
    passes = 1
    while True:
        sizes = {s: 1 << max(0, (-(-c * BITS_PER_WORD // (width * passes)) - 1).bit_length()) for s, c in counts.items()}
        if sum(sizes.values()) * width // 8 <= filter_bytes or max(sizes.values(), default=1) == 1:
            break
        passes *= 2
    size = F.create_map(*[F.lit(x) for s, n in sizes.items() for x in (s, n)])[F.col("shard")] if sizes else F.lit(1)

    def lanes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            h = frame.h.to_numpy().view(np.uint64)
            yield pd.DataFrame({"shard": frame.shard, "block": (h & (frame["size"].to_numpy().astype(np.uint64) - np.uint64(1))).astype(np.int32),
                                "turn": _pass_of(h, passes).astype(np.int32)} | {f"w{i}": _lane(h, i).view(np.int64) for i in range(LANES)})
    bits = [f"w{i}" for i in range(LANES)]
    blocks = cut(keys.withColumn("size", size).mapInPandas(lanes, "shard int, block int, turn int, " + ", ".join(f"{b} bigint" for b in bits))
                 .groupBy("turn", "shard", "block").agg(*[F.bit_or(b).alias(b) for b in bits]))
    for turn in range(passes):
        found = blocks.filter(F.col("turn") == turn).drop("turn").toArrow()  # at most `filter_bytes` and the keys of blocks
        tables = {s: np.zeros((n, LANES), np.uint64) for s, n in sizes.items()}
        shard, block = found["shard"].to_numpy(), found["block"].to_numpy()
        values = np.stack([found[b].to_numpy().view(np.uint64) for b in bits], axis=1)
        for s, table in tables.items():
            table[block[shard == s]] = values[shard == s]
        yield Filters(tables, turn, passes)


def edits(length: int, letters: np.ndarray, alphabet: np.ndarray, held: Filters) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(rows, edited words) of the edits of words of one length that the filters may hold.

    Edits are all deletions, once for each result, and all replacements by a letter that comes later in the order. An
    insertion is the deletion of the longer word and a replacement by an earlier letter that of the other word.
    """
    h = sums(letters)
    step = max(1, PROBES // len(alphabet))
    for first in range(0, len(letters), step):
        part, whole = letters[first:first + step], h[first:first + step]
        for i in range(length):
            own = part[:, i]
            base = whole - _marks(np.array([i]), own)
            probes = base[:, None] + _marks(np.array([i]), alphabet)[None, :]
            later = np.flatnonzero((alphabet[None, :] > own[:, None]).ravel())
            hit = later[held.may_hold(length, probes.ravel()[later])]
            if len(hit):
                yield first + hit // len(alphabet), _written(part[hit // len(alphabet)], i, alphabet[hit % len(alphabet)])
    if min(length - 1, LONGEST_SHARD) in held.blocks and length > 1:
        step = max(1, PROBES // length)
        for first in range(0, len(letters), step):
            part = letters[first:first + step]
            place = np.arange(length)[None, :]
            here = _marks(place, part)
            moved = np.zeros_like(here)
            moved[:, 1:] = _marks(place[:, :-1], part[:, 1:])  # what a letter counts one place earlier
            before = np.cumsum(here, axis=1, dtype=np.uint64) - here
            after = np.cumsum(moved[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1] - moved
            fresh = np.ones(part.shape, bool)
            fresh[:, 1:] = part[:, 1:] != part[:, :-1]
            asked = np.flatnonzero(fresh.ravel())
            hit = asked[held.may_hold(length - 1, (before + after).ravel()[asked])]
            row, at = hit // length, hit % length
            for i in np.unique(at):
                rows = row[at == i]
                yield first + rows, _written(np.delete(part[rows], i, axis=1))


def _written(letters: np.ndarray, at: int | None = None, by: np.ndarray | None = None) -> list[str]:
    if at is not None:
        letters = letters.copy()
        letters[:, at] = by
    return [row.tobytes().decode("latin-1") for row in letters]


def near_words(words: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(word, near, n): both ways, every pair of the written `words` (word, n) that differ by exactly one inserted, deleted or
    replaced letter; n is how often `near` occurs.

    Edits of every word are generated and probed against broadcast Bloom filters of the words of each length. Only those
    that pass are shuffled to an exact join with the words, which removes false ones.
    """
    def alphabets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"letter": sorted(set("".join(frame.word)))})
    letters = np.array(sorted(ord(r.letter) for r in words.mapInPandas(alphabets, "letter string").distinct().collect()), np.uint8)  # 90 at most
    context = words.sparkSession.sparkContext

    def written(rows: np.ndarray, n: np.ndarray, at: list[np.ndarray], near: list[str]) -> pd.DataFrame:
        index = np.concatenate(at)
        return pd.DataFrame({"word": _written(rows[index]), "n": n[index], "near": near})
    found = None
    for part in filters(words, filter_bytes):
        shared = context.broadcast((part.blocks, part.turn, part.passes, letters))

        def probe(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            blocks, turn, passes, alphabet = shared.value
            held = Filters(blocks, turn, passes)
            for length, rows, n in pools(frames):
                at, near = [], []
                for some, edited in edits(length, rows, alphabet, held):
                    at.append(some)
                    near += edited
                    if len(near) * length > POOL:
                        yield written(rows, n, at, near)
                        at, near = [], []
                if near:
                    yield written(rows, n, at, near)
        passed = cut(words.mapInPandas(probe, "word string, n bigint, near string"))
        shared.destroy()
        found = passed if found is None else found.unionByName(passed)
    if found is None:
        return words.select("word", F.col("word").alias("near"), "n").limit(0)
    pairs = found.join(words.select(F.col("word").alias("near"), F.col("n").alias("n_near")), "near")
    both = F.explode(F.array(F.struct("word", "near", F.col("n_near").alias("n")), F.struct(F.col("near").alias("word"), F.col("word").alias("near"), "n")))
    return pairs.select(both.alias("pair")).select("pair.*")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from the written `forms` (word, form): where following forms ends. Each round doubles how far every word has
    got, so rounds grow with the logarithm of the longest chain."""
    started = forms.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("at"))
    ahead = started.select(F.col("word").alias("at"), F.lit(True).alias("goes_on"))
    steps = cut(lookup(cut(started), ahead, "at").withColumn("goes_on", F.coalesce("goes_on", F.lit(False))))
    while not steps.filter("goes_on").isEmpty():
        jump = steps.select(F.col("word").alias("at"), F.col("at").alias("next"), F.col("goes_on").alias("further"))
        open_, done = steps.filter("goes_on"), steps.filter("not goes_on")
        moved = lookup(cut(open_), jump, "at").select("word", F.col("next").alias("at"), F.col("further").alias("goes_on"))
        steps = cut(done.unionByName(moved))
    return steps.select("word", F.col("at").alias("root"))


def variants(docs: DataFrame, least_length: int = 5, least: int = 3, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """Spelling variants among the words of `docs` (doc_id, text): word, form, root, n, n_near, form_n.

    Words are those of `vocabulary`; n is how often a word occurs, n_near how many words are one edit away. Its form is the
    near word of largest n, of least text if several have it, if that is at least twice the word's n; else null. Its root is
    where forms end, the word itself if it has none. form_n is the form's n.

    A word of at most 90 letters' alphabet has a bounded number of near words for its length, so no word gathers many rows; counts
    are summed per task first. Null and empty texts and texts without letters have no words; rows that repeat a document
    count again. A word of any length is probed, in pieces of bounded size. An empty table gives no rows.
    """
    words = cut(vocabulary(docs, least_length, least))
    near = near_words(words, filter_bytes).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("rank"), "near")).alias("best"))
    twice = -F.col("best.rank") >= 2 * F.col("n")
    forms = cut(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(twice, F.col("best.near")).alias("form"),
        F.when(twice, -F.col("best.rank")).alias("form_n")))
    return (forms.join(roots(forms), "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
