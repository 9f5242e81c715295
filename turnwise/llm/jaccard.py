"""Near copies: Jaccard join of shingle sets under several global token orders."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.components import components
from turnwise.llm.tables import columns, small_batches
from turnwise.plans.cut import cut

BATCH = 1 << 20
ORDERS = 3  # global token orders
BITS = 1024  # of the parity bitmap of a set, at least
BLOCK = 512  # sets of a block; a larger bucket is compared block by block
HOT_BLOCK = 1024  # postings of a block of a frequent token
SAMPLE = 16  # one document in so many is counted to find frequent tokens
FREQUENT = 4  # times in that sample
MOST_FREQUENT = 200_000  # tokens that are put last in the order
SHARED_IDS = 500_000  # narrow rows that may be broadcast at once
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
LONG_WORD = 64  # bytes; longer words are hashed one by one
_SEEDS = [np.uint64(0xD6E8FEB86659FD93 * (i + 1) & (1 << 64) - 1) for i in range(ORDERS)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed mixing of 64-bit numbers, one to one."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: Odd and without a pattern among them, so that the same words in other places give another sum.
_FACTORS = list(mixed(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1))


#: The first 0 to 8 bytes of a number.
_HEADS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of every word, A-Z in lower case.

    Eight bytes at a time are mixed into the hash, one to one for each state, so words of up to eight bytes and equal
    length never share one, and no pattern of letters is favoured: two longer words do with a chance of 2 ** -64.
    """
    low = text.lower()
    data = np.frombuffer(low, np.uint8)
    solid = ~_BLANK[data]
    edges = np.flatnonzero(np.diff(solid, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    lengths = ends - starts
    eight = np.ndarray((len(data),), "<u8", low + b"\0" * 8, strides=(1,))  # the eight bytes from each place on
    out = mixed(lengths.astype(np.uint64) * _FACTORS[9])
    left, at = np.arange(len(starts)), 0
    while len(left):
        rest = np.minimum(lengths[left] - at, 8)
        out[left] = mixed((out[left] ^ (eight[starts[left] + at] & _HEADS[rest])) + _FACTORS[at // 8 % len(_FACTORS)])
        at += 8
        left = left[lengths[left] > at]
        if at == LONG_WORD:
            break
    for i in left.tolist():  # longer words are rare
        out[i] = np.frombuffer(hashlib.blake2b(low[starts[i]:ends[i]], digest_size=8).digest(), np.uint64)[0]
    return out


def shingles(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `words` words; a shorter text is one run."""
    hashed = word_hashes(text)
    if not len(hashed):
        return hashed
    size = min(words, len(hashed))
    n = len(hashed) - size + 1
    total = np.full(n, size, np.uint64)
    for i in range(size):
        total += hashed[i:i + n] * _FACTORS[i]
    total = np.sort(mixed(total))
    return total[np.append(True, total[1:] != total[:-1])]


def ranked(tokens: np.ndarray, order: int) -> np.ndarray:
    """Rank of every token in a global order. Tokens are mixed already, so flipping bits is enough for an order."""
    return tokens ^ _SEEDS[order]


def prefix_length(n: int, percent: int) -> int:
    """So many first tokens of a set of n must meet those of any set that is alike to `percent`."""
    return n - -(-percent * n // 100) + 1


def prefix(tokens: np.ndarray, order: int, percent: int, frequent: np.ndarray | None = None) -> np.ndarray:
    """The first tokens in an order, `frequent` ones (sorted) after all others."""
    size = prefix_length(len(tokens), percent)
    if frequent is not None and len(frequent):
        last = frequent[np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)] == tokens
        if last.any():
            rare = tokens[~last]
            return _first(rare, order, size) if len(rare) >= size else np.concatenate([rare, _first(tokens[last], order, size - len(rare))])
    return _first(tokens, order, size)


def _first(tokens: np.ndarray, order: int, size: int) -> np.ndarray:
    return tokens[np.argpartition(ranked(tokens, order), size - 1)[:size]] if 0 < size < len(tokens) else tokens[:size]


def parity(tokens: np.ndarray) -> bytes:
    """A bitmap in which a bit is set if an odd number of tokens fall on it, of twice as many bits as tokens or more.
    Two sets differ in as many tokens at least as their bitmaps differ in bits."""
    bits = max(BITS, 1 << int(2 * len(tokens) - 1).bit_length()) if len(tokens) else BITS
    counts = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def unlike(a: bytes, b: bytes) -> int:
    """In how many bits two bitmaps differ, the longer one folded to the length of the other."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    return int(np.bitwise_count(x ^ y).sum())


def _described(words: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in small_batches(frames, "text", BATCH):
            sets = [shingles(t, words) for t in frame.text]
            heads = [[s[np.argmin(ranked(s, k))] if len(s) else 0 for s in sets] for k in range(ORDERS)]
            yield pd.DataFrame({"id": frame.id, "unnamed": frame.unnamed, "doc_id": frame.doc_id, "hash": frame.hash, "n": [len(s) for s in sets],
                                "digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets],
                                "bits": [parity(s) for s in sets]}
                               | {f"head{k}": np.array(h, np.uint64).view(np.int64) for k, h in enumerate(heads)})
    return run


def _alike(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Matrix of which of the sets are alike, from the sizes of all intersections."""
    sizes = np.array([len(s) for s in sets])
    tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, column, times = np.unique(tokens, return_inverse=True, return_counts=True)
    shared = times[column] > 1  # a token of one set meets nothing
    place = np.cumsum(times > 1) - 1
    owner, column = owner[shared], place[column[shared]]
    both = np.zeros((len(sets), len(sets)), np.float32)
    by_column = np.argsort(column, kind="stable")
    owner, column = owner[by_column], column[by_column]
    width = 1024
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (first, first + width))
        part = np.zeros((len(sets), width), np.float32)
        part[owner[a:b], column[a:b] - first] = 1
        both += part @ part.T
    both = both.astype(np.int64)
    return 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)


def _linked(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links enough to join what is alike: (least id, other id) for each group of sets joined by likeness."""
    if len(ids) == 2:
        a, b = sets
        if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
            return []
        for order in range(1, ORDERS):  # the pair comes from one order and must meet in the others
            if not np.isin(prefix(a, order, percent), prefix(b, order, percent)).any():
                return []
        both = len(np.intersect1d(a, b, assume_unique=True))
        return [(min(ids), max(ids))] if 100 * both >= percent * (len(a) + len(b) - both) else []
    alike = _alike(sets, percent)
    left, links = np.ones(len(ids), bool), []
    for start in np.argsort(ids):
        if left[start]:
            group, edge = np.zeros(len(ids), bool), np.zeros(len(ids), bool)
            group[start] = edge[start] = True
            while edge.any():
                reached = alike[edge].any(axis=0) & ~group
                group |= reached
                edge = reached
            left &= ~group
            links += [(ids[start], other) for other in ids[group] if other != ids[start]]
    return links


def sorted_runs(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Runs of rows with equal keys out of sorted batches, also across batches."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        values = [frame[k].to_numpy() for k in keys]
        change = np.zeros(len(frame) - 1, bool)
        for v in values:
            change |= v[1:] != v[:-1]
        ends = np.append(np.flatnonzero(change) + 1, len(frame))
        start = 0
        for end in ends.tolist():
            part = frame.iloc[start:end]
            if held and any(held[-1][k].iat[-1] != part[k].iat[0] for k in keys):
                yield held[0] if len(held) == 1 else pd.concat(held)
                held = []
            held.append(part)
            start = end
    if held:
        yield held[0] if len(held) == 1 else pd.concat(held)


def shared(df: DataFrame, limit: int | None = None) -> DataFrame:
    """A written narrow table, marked for broadcast if it has been counted and is small enough; else joins shuffle."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= (SHARED_IDS if limit is None else limit) else df


def compared(docs: DataFrame, asked: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) between the sets that `asked` (bucket, i, j, id) puts into the same bucket and pair of blocks.

    `docs` is (id, text). Texts meet their ids by broadcasts of counted size, one after another: beyond SHARED_IDS rows the
    buckets are dealt out to several passes over the texts, so the driver never holds more and no text is shuffled that
    is not compared. A pass has the rows of a bucket and pair of blocks together; each task holds those of one. Passes but the last are
    written when this is called.
    """
    def sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in small_batches(frames, "text", BATCH):
            yield frame.drop(columns="text").assign(tokens=[shingles(t, words).tobytes() for t in frame.text])

    def links(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: list[tuple[int, int]] = []
        for run in sorted_runs(frames, ["bucket", "i", "j"]):
            run = run.drop_duplicates("id")  # rows that repeat a document
            if len(run) > 1:
                found += _linked(run.id.to_numpy(), [np.frombuffer(t, np.uint64) for t in run.tokens], percent)
            if len(found) > 10_000:
                yield pd.DataFrame(found, columns=["a", "b"])
                found = []
        yield pd.DataFrame(found, columns=["a", "b"]).astype("int64")
    def one_pass(part: DataFrame) -> DataFrame:
        rows = docs.join(part, "id").select("id", "text", "bucket", "i", "j").mapInPandas(sets, "id bigint, bucket bigint, i bigint, j bigint, tokens binary")
        return rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInPandas(links, "a bigint, b bigint")
    asked = cut(asked)
    passes = -(-asked.count() // SHARED_IDS)
    if passes <= 1:
        return one_pass(F.broadcast(asked))
    # a little more than needed, so that uneven passes are rarely over the bound; `shared` counts them all the same
    passes += -(-passes // 8)
    turn = F.pmod(F.xxhash64("bucket", "i", "j", F.lit("pass")), F.lit(passes))
    done = [cut(one_pass(shared(asked.filter(turn == k)))) for k in range(passes - 1)]
    done.append(one_pass(shared(asked.filter(turn == passes - 1))))
    return reduce(DataFrame.unionByName, done)


def in_blocks(rows: DataFrame, size: str, block: int) -> DataFrame:
    """`rows` (id, size column) once for each pair of blocks (i, j) that has them; buckets of up to `block` rows have
    one block."""
    rows = rows.withColumn("blocks", F.ceil(F.col(size) / block)).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    return (rows.withColumn("other", other).withColumn("i", F.least("own", "other"))
            .withColumn("j", F.greatest("own", "other")).drop("blocks", "other", "own"))


def frequent_tokens(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent tokens, sorted, and about how many documents have each, MOST_FREQUENT of them at most.

    They only shape the order of tokens, which may be any as long as all documents share it; so a sample does, and
    what it misses costs time, not results.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in small_batches(frames, "text", BATCH):
            sets = [shingles(t, words) for t in frame.text]
            yield pd.DataFrame({"token": np.concatenate(sets).view(np.int64)})
    some = docs.filter(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(SAMPLE)) == 0)
    # as columns: a row object for each token would take the driver a hundred times as much
    rows = (some.mapInPandas(run, "token bigint").groupBy("token").count().filter(F.col("count") >= FREQUENT)
            .orderBy(F.desc("count"), "token").limit(MOST_FREQUENT).toArrow())
    tokens = rows["token"].to_numpy().astype(np.int64).view(np.uint64)
    counts = rows["count"].to_numpy().astype(np.int64) * SAMPLE
    order = np.argsort(tokens)
    return tokens[order], counts[order]


def _pairs(ids: np.ndarray, a: list[np.ndarray], b: list[np.ndarray]) -> pd.DataFrame:
    x, y = (ids[np.concatenate(v).astype(np.int64)] if v else np.empty(0, np.int64) for v in (a, b))
    return pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)}).drop_duplicates()


def candidates(docs: DataFrame, words: int, percent: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Pairs (a, b) of sets of different components that share a prefix token and may be alike by size.

    `docs` is (id, comp, text), one row for each set. Every set sends its prefix tokens; frequent tokens stand last in
    the order, and those that are a prefix token all the same are compared block by block. There, pairs that met in a
    bucket of first tokens are settled already and left out. Rows of a token whose sets are all of one component, as
    they are in groups of near copies, give nothing.
    """
    tokens_often, counts_often = frequent
    bucket = docs.sparkSession.sparkContext.broadcast((tokens_often, -(-counts_often // HOT_BLOCK)))

    def post(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        often, blocks = bucket.value
        for frame in small_batches(frames, "text", BATCH):
            parts = []
            for id_, comp, text in zip(frame.id.to_numpy(), frame.comp.to_numpy(), frame.text):
                s = shingles(text, words)
                if not len(s):
                    continue
                first = prefix(s, 0, percent, often)
                n = len(first)
                parts.append((first, np.zeros(n, np.int64), np.full(n, id_), np.full(n, comp), np.full(n, len(s)), None))
                if len(often):
                    at = np.minimum(np.searchsorted(often, first), len(often) - 1)
                    many = np.where(often[at] == first, blocks[at], 1)
                    hot = many > 1
                    if hot.any():
                        heads = np.array([s[np.argmin(ranked(s, k))] for k in range(ORDERS)], np.uint64).tobytes()
                        own = int(mixed(np.array([id_]).view(np.uint64))[0])
                        token, nb = first[hot], many[hot]
                        parts[-1] = (first[~hot], *(x[~hot] for x in parts[-1][1:5]), None)
                        for t, m in zip(token, nb.tolist()):
                            block = np.arange(m)
                            mine = own % m
                            pair = (np.minimum(block, mine) << 24 | np.maximum(block, mine)) + 1
                            parts.append((np.full(m, t), pair.astype(np.int64), np.full(m, id_), np.full(m, comp), np.full(m, len(s)),
                                          heads + int(mine).to_bytes(8, "little")))
            if parts:
                cols = [np.concatenate([p[k] for p in parts]) for k in range(5)]
                heads = [h for p in parts for h in [p[5]] * len(p[0])]
                yield pd.DataFrame({"token": cols[0].view(np.int64), "pair": cols[1], "id": cols[2], "comp": cols[3],
                                    "n": cols[4].astype(np.int32), "heads": heads})

    def met(token, pair, ids, comp, n, heads) -> Iterator[pd.DataFrame]:
        """Pairs inside each run of equal (token, pair)."""
        starts = np.flatnonzero(np.append(True, (token[1:] != token[:-1]) | (pair[1:] != pair[:-1])))
        ends = np.append(starts[1:], len(token))
        mixed_runs = np.minimum.reduceat(comp, starts) < np.maximum.reduceat(comp, starts)
        found_a, found_b, held = [], [], 0

        def fits(a, b):
            small, large = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
            return (ids[a] != ids[b]) & (comp[a] != comp[b]) & (100 * small >= percent * large)
        twos = starts[mixed_runs & (ends - starts == 2) & (pair[starts] == 0)]
        twos = twos[fits(twos, twos + 1)]
        found_a.append(twos)
        found_b.append(twos + 1)
        for start, end in zip(*(x[mixed_runs & ((ends - starts > 2) | (pair[starts] > 0))].tolist() for x in (starts, ends))):
            code = int(pair[start]) - 1
            extra = np.stack([np.frombuffer(h, np.uint64) for h in heads[start:end]]) if code >= 0 else None
            for first in range(start, end, 512):
                rows = np.arange(first, min(end, first + 512))
                others = np.arange(first, end)
                meets = fits(rows[:, None], others[None, :]) & (rows[:, None] < others[None, :])
                if extra is not None:
                    x, y = extra[rows - start], extra[others - start]
                    for k in range(ORDERS):
                        meets &= x[:, None, k] != y[None, :, k]
                    if code >> 24 != code & 0xFFFFFF:  # pairs inside a block are met where it stands alone
                        meets &= x[:, None, ORDERS] != y[None, :, ORDERS]
                a, b = np.nonzero(meets)
                found_a.append(rows[a])
                found_b.append(others[b])
                held += len(a)
                if held > 200_000:
                    yield _pairs(ids, found_a, found_b)
                    found_a, found_b, held = [], [], 0
        yield _pairs(ids, found_a, found_b)

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[np.ndarray] = []  # the last run of a batch may go on in the next
        for frame in frames:
            cols = [frame[c].to_numpy() for c in ("token", "pair", "id", "comp", "n", "heads")]
            if not len(cols[0]):
                continue
            if kept:
                cols = [np.concatenate(p) for p in zip(kept, cols)]
            token, pair = cols[:2]
            same = (token == token[-1]) & (pair == pair[-1])
            last = len(token) - int(same.sum())
            if last:
                yield from met(*[c[:last] for c in cols])
            kept = [c[last:] for c in cols]
        if kept:
            yield from met(*kept)
    postings = docs.mapInPandas(post, "token bigint, pair bigint, id bigint, comp bigint, n int, heads binary")
    return (postings.repartition("token", "pair").sortWithinPartitions("token", "pair")
            .mapInPandas(meet, "a bigint, b bigint").distinct())


def _texts(docs: DataFrame, seed: int) -> DataFrame:
    """`docs` as (id, unnamed, doc_id, hash, text in bytes); hash is that of the text, id a number for each doc_id and text."""
    own = columns(docs, doc_id="bigint", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    own = own.withColumn("hash", F.xxhash64("text"))
    own = own.withColumns({"unnamed": F.col("doc_id").isNull(), "doc_id": F.coalesce("doc_id", F.lit(0))})  # no nulls for pandas
    return own.select(F.xxhash64(F.lit(seed), "unnamed", "doc_id", "text").alias("id"), "unnamed", "doc_id", "hash",
                      F.col("text").cast("binary").alias("text"))


def near_groups(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Groups of near copies of `docs` (doc_id, text): doc_id, n_shingles, component_id for every row.

    component_id is the least doc_id of the documents that links reach, null if none of them has one. Groups that have
    the same component_id because a doc_id repeats or is null are told apart by `near_documents`, which says how links
    are found. Rows that repeat a document come out as often as they go in. An empty table gives no rows.
    """
    out = near_documents(docs, words, percent).withColumn("again", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return out.select("doc_id", "n_shingles", "component_id")


def near_documents(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Every document of `docs` (doc_id, text) once: doc_id, hash, times, n_shingles, component_id, kept.

    Two documents link if 100 * |A and B| >= percent * |A or B| over their sets of distinct `words`-word shingles;
    component_id is the least doc_id that links reach, null ones last. Words and shingles stand for themselves by 64-bit hashes
    (`word_hashes`): two different ones of a pair of documents are taken for one with a chance of 2 ** -64. Nothing else is
    approximate, and no document is compared with more than may be alike:

    1. Equal sets become one, found by a digest of the set.
    2. Sets with the same first token in one of three global orders are compared in full, block by block, and joined;
       near copies meet there mostly, and a large group needs no pair rows. Orders follow one another, and sets that
       are joined already are not fetched again for each other.
    3. Under prefix filtering, sets that are alike must share a prefix token in every order. Sets of different
       components that share one in the first order, fit in size and may be alike by their bitmaps are candidates;
       they must share one in the other orders too, and only then are whole sets compared.

    Null text is empty; empty texts link with nothing. A document is a doc_id, null or not, and a text: `times` rows of
    equal doc_id and text are one, rows that repeat a doc_id with other texts, or have none, are documents of their own.
    `hash` is the xxhash64 of the text. Of each group of documents joined by links the one of least doc_id, then hash,
    is `kept`. Inside, a document goes by a 64-bit number hashed from both; should two share one, all are drawn anew.
    """
    heads = [f"head{k}" for k in range(ORDERS)]
    for seed in count():
        texts = _texts(docs, seed)
        made = texts.mapInPandas(_described(words), "id bigint, unnamed boolean, doc_id bigint, hash bigint, n int, digest binary, bits binary, "
                                 + ", ".join(f"{h} bigint" for h in heads))
        described = F.struct("unnamed", "doc_id", "hash", "digest", "n", "bits", *heads)
        rows = cut(made.groupBy("id").agg(F.min(described).alias("set"), F.max(described).alias("other"), F.count("*").cast("int").alias("times"))
                   .select("id", "times", "set.*", (~F.col("set").eqNullSafe(F.col("other"))).alias("clash")))
        if rows.filter("clash").isEmpty():
            break
    rows = rows.drop("clash")
    classes = cut(rows.filter("n > 0").groupBy("digest", "n").agg(
        F.min("id").alias("id"), F.min(F.struct("unnamed", "doc_id", "hash")).alias("first"), *[F.first(c).alias(c) for c in ("bits", *heads)]))

    # sets of the same first token, order by order: a bucket of one component is settled and fetches no texts
    first_links = joined = None
    for k, head in enumerate(heads):
        met = classes.select("id", F.xxhash64(head, F.lit(k)).alias("bucket"))
        if joined is None:
            met = met.withColumn("comp", F.col("id"))
        else:
            met = met.join(joined.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("label", "id")).drop("label")
        met = cut(met)
        sizes = cut(met.groupBy("bucket").agg(F.count("*").alias("count"), F.min("comp").alias("least"), F.max("comp").alias("most"))
                    .filter("least <> most").select("bucket", "count"))
        asked = in_blocks(met.drop("comp").join(sizes, "bucket"), "count", BLOCK).select("bucket", "i", "j", "id")
        links = cut(compared(texts, asked, words, percent))
        first_links = links if first_links is None else first_links.unionByName(links)
        joined = cut(components(first_links))

    # candidates between components
    named = cut(classes.select("id").join(joined.withColumnRenamed("node", "id"), "id", "left")
                .select("id", F.coalesce("label", "id").alias("comp")))
    copies = (rows.select("id").join(classes.select("id"), "id", "left_anti")
              .withColumn("comp", F.lit(None).cast("bigint")))
    changed = named.filter("id <> comp").unionByName(copies).withColumn("found", F.lit(True))
    distinct_sets = (texts.join(shared(changed), "id", "left")
                     .filter(F.col("found").isNull() | F.col("comp").isNotNull())
                     .select("id", F.coalesce("comp", "id").alias("comp"), "text"))
    pairs = cut(candidates(distinct_sets, words, percent, frequent_tokens(texts, words)))
    a = classes.select(F.col("id").alias("a"), F.col("bits").alias("bits_a"), F.col("n").alias("n_a"))
    b = classes.select(F.col("id").alias("b"), F.col("bits").alias("bits_b"), F.col("n").alias("n_b"))

    @F.pandas_udf("long")
    def differing(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([unlike(p, q) for p, q in zip(x, y)], dtype="int64")
    most = (F.col("n_a") + F.col("n_b") - differing("bits_a", "bits_b")) / 2  # of tokens in common
    possible = (pairs.join(a, "a").join(b, "b").withColumn("most", most)
                .filter(100 * F.col("most") >= percent * (F.col("n_a") + F.col("n_b") - F.col("most"))))
    asked = possible.select(F.col("a").alias("bucket"), F.col("b").alias("i"), F.lit(0).cast("long").alias("j"),
                            F.explode(F.array("a", "b")).alias("id"))
    links = first_links.unionByName(compared(texts, asked, words, percent))

    labels = components(links)
    member = classes.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    least = cut(member.groupBy("label").agg(F.min("first").alias("least")))
    found = cut(member.join(least, "label").select("digest", "n", "least"))
    out = rows.join(found, ["digest", "n"], "left").withColumn("least", F.coalesce("least", F.struct("unnamed", "doc_id", "hash")))
    named = lambda of: F.when(~F.col(f"{of}unnamed"), F.col(f"{of}doc_id"))
    return out.select(named("").alias("doc_id"), "hash", "times", F.col("n").cast("long").alias("n_shingles"), named("least.").alias("component_id"),
                      F.struct("unnamed", "doc_id", "hash").eqNullSafe(F.col("least")).alias("kept"))
