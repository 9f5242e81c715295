"""Fingerprints against a plain version with the public xxhash library."""

import hashlib
import re
import struct

import xxhash
from tests.llm.conftest import EDGE

from turnwise.llm import fingerprints as fp

MASK = (1 << 64) - 1
LIMIT = -(1 << 63) + (1 << 61)


def shingles(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    hashed = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]

    def chain(values):
        seed = 42
        for v in values:
            seed = xxhash.xxh64_intdigest(struct.pack("<Q", v), seed)
        return seed - (1 << 64) if seed >> 63 else seed
    return {chain(hashed[i:i + 5]) for i in range(max(1, len(hashed) - 4))} if hashed else set()


def sketch(text):
    found = sorted(shingles(text))
    low = [x for x in found if x < LIMIT]
    if len(low) >= 32:
        return LIMIT - 1, low
    return ((1 << 63) - 1 if len(found) < 32 else found[31]), found[:32]


def written(s):
    return "".join(f"{x & MASK:016x}" for x in (s[0], *s[1]))


def near(a, b):
    reach = min(a[0], b[0])
    x, y = {v for v in a[1] if v <= reach}, {v for v in b[1] if v <= reach}
    return len(x & y) / len(x | y) if x | y else 1.0


def check(rows, got):
    rows = sorted(rows, key=lambda r: -r[0])
    by_id = {r.doc_id: r for r in got}
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        n = len(text) // 3
        edited = text[:len(text) - n] + following[:n]
        a, b, c, r = sketch(text), sketch(edited), sketch(following), by_id[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (written(a), written(b))
        assert abs(r.near_edited - near(a, b)) < 1e-12 and abs(r.near_next - near(a, c)) < 1e-12


def test_like_the_plain_version(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = fp.compare_edited(docs).collect()
    assert len(got) == len(rows)
    check(rows, got)


def test_estimates_are_near_the_truth(docs):
    got = fp.compare_edited(docs).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(text, reverse=True)
    off = []
    for k, i in enumerate(ids):
        a, b = shingles(text[i]), shingles(text[ids[(k + 1) % len(ids)]])
        off.append(abs(next(r.near_next for r in got if r.doc_id == i) - len(a & b) / len(a | b)))
    assert sum(off) / len(off) < 0.03


def test_edge_rows(spark, edge, none):
    got = fp.compare_edited(edge).collect()
    assert len(got) == len(EDGE)
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in EDGE)
    blank = {r.fingerprint for r in got if r.doc_id in (2, 3, 4)}
    assert len(blank) == 1 and len({r.fingerprint for r in got if r.doc_id in (1, 5)}) == 1
    assert all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next, r.contained_edited, r.contained_next))
    assert len({(r.fingerprint, r.edited_sha256) for r in got if r.doc_id == 5}) == 1  # the repeated row
    assert fp.compare_edited(none).collect() == []


def test_a_single_document_is_its_own_next(spark):
    (r,) = fp.compare_edited(spark.createDataFrame([(4, "abcdef")], "doc_id long, text string")).collect()
    assert r.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and r.near_next == 1.0


def test_containment_of_unequal_texts_and_merging(spark):
    from pyspark.sql import functions as F
    words = [f"w{i}" for i in range(4000)]
    rows = spark.createDataFrame([(" ".join(words[:400]), " ".join(words), " ".join(words[2000:]))], "a string, b string, c string")
    for name in "abc":
        rows = fp.sketched(rows, name, f"s{name}")
    r = rows.select(fp.containment(F.col("sa"), F.col("sb")).alias("in_b"), fp.jaccard(F.col("sa"), F.col("sb")).alias("near"),
                    fp.containment(F.col("sa"), F.col("sc")).alias("in_c"),
                    fp.containment(F.col("sa"), fp.merged(F.col("sc"), F.col("sa"))).alias("in_both")).first()
    assert r.in_b == 1.0 and r.in_both == 1.0 and r.in_c < 0.1 and r.near < 0.2


def test_short_texts_are_not_contained_in_long_strangers(spark):
    """1 to 30 shingles against long texts, unrelated ones and ones that hold the short text."""
    long = " ".join(f"w{i}" for i in range(4000))
    short = {n: " ".join(f"s{n}x{i}" for i in range(n + 4)) for n in range(1, 31)}
    rows = [(2 * n, t) for n, t in short.items()] + [(2 * n - 1, f"{n} {long}") for n in short]
    rows += [(1000 + 2 * n, t) for n, t in short.items()] + [(999 + 2 * n, f"{n} {long} {t} end") for n, t in short.items()]
    got = {r.doc_id: r for r in fp.compare_edited(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[2 * n].contained_next for n in short} == {0.0} and {got[1000 + 2 * n].contained_next for n in short} == {1.0}
    text = dict(rows)
    for i in (*range(2, 61, 2), *range(1002, 1061, 2)):
        n = len(text[i]) // 3
        a, b = shingles(text[i]), shingles(text[i][:len(text[i]) - n] + text[i - 1][:n])
        assert abs(got[i].contained_edited - len(a & b) / len(a)) < 1e-12
    pair = spark.createDataFrame([(t, long) for t in short.values()] + [("", long)], "a string, b string")
    pair = fp.sketched(fp.sketched(pair, "a", "sa"), "b", "sb")
    said = [r[0] for r in pair.select(fp.containment(pair.sa, pair.sb)).collect()]
    assert set(said[:-1]) == {0.0, None} and said[-1] == 1.0
