"""Exact and near copies against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F
from tests.llm.conftest import EDGE, frame

from turnwise.llm import chunks, jaccard
from turnwise.llm.components import components


def norm(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


def check_exact(rows, got):
    groups = defaultdict(list)
    for i, text in rows:
        groups[norm(text)].append(i)
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    assert len(got) == len(rows)
    kept = defaultdict(int)
    for r in got:
        ids = by_hash[r.text_sha256]
        known = [i for i in ids if i is not None]
        assert r.keep_id == (min(known) if known else None) and r.group_size == len(ids)
        kept[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) <= {1}


def test_exact_copies(docs, edge, none):
    check_exact([(r.doc_id, r.text) for r in docs.collect()], chunks.duplicates(docs).collect())
    check_exact(EDGE, chunks.duplicates(edge).collect())
    assert chunks.duplicates(none).collect() == []


def test_digests_that_clash_are_told_apart(docs):
    """With digests of one byte nearly every chunk shares its digest with others."""
    check_exact([(r.doc_id, r.text) for r in docs.collect()], chunks.duplicates(docs, width=1).collect())


def test_chunks_join_to_the_text_and_cut_where_the_content_says():
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    body = " ".join(word() for _ in range(6000)).encode()
    for text in (b"", b"x", b" ", body, b"a" * 50_000):
        parts = chunks.chunks(text)
        assert b"".join(parts) == text and all(len(p) <= chunks.LONGEST for p in parts)
        assert all(len(p) >= chunks.SHORTEST for p in parts[:-1])
    moved = chunks.chunks(b"something else in front " + body)
    assert len(set(moved) & set(chunks.chunks(body))) > 0.8 * len(moved)


def tokens(text, words=5):
    found = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(found[i:i + words]) for i in range(max(1, len(found) - words + 1))) if found else frozenset()


def plain_groups(rows):
    sets = {i: tokens(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in sets}


def check_near(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_groups(df).collect()}
    assert got == plain_groups(rows)


def test_near_copies_of_the_table(spark, docs):
    check_near(spark, [(r.doc_id, r.text) for r in docs.collect()])


def edited(rnd, words, changes):
    words = list(words)
    for _ in range(changes):
        words[rnd.randrange(len(words))] = f"x{rnd.random()}"
    return " ".join(words)


def test_a_large_group_chains_and_shared_passages(spark, monkeypatch):
    """Small blocks and low bounds, so that the paths for large groups and frequent tokens all run."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "HOT_BLOCK", 16)
    monkeypatch.setattr(jaccard, "SAMPLE", 2)
    monkeypatch.setattr(jaccard, "FREQUENT", 2)
    rnd = random.Random(3)
    fresh = lambda n: [f"w{rnd.randrange(10 ** 9)}" for _ in range(n)]
    base, passage, rows = fresh(150), fresh(60), []
    rows += [edited(rnd, base, rnd.randint(0, 6)) for _ in range(120)]  # near copies, many of which do not link
    rows += [" ".join(fresh(20) + passage + fresh(10)) for _ in range(40)]  # strangers that share a passage
    chain = fresh(100)
    for _ in range(12):  # neighbours link, the ends do not
        rows.append(" ".join(chain))
        chain = chain[8:] + fresh(8)
    short = fresh(4)
    rows += [" ".join(short), " ".join(short).upper(), " ".join(short[:3]), "a", "A", "", " ", rows[0], rows[0] + " end"]
    rnd.shuffle(rows)
    check_near(spark, list(enumerate(rows)))
    check_near(spark, [(1000 - i, t) for i, t in enumerate(rows)])


def test_joins_without_broadcast_give_the_same(spark, docs, monkeypatch):
    shared = jaccard.shared
    monkeypatch.setattr(jaccard, "shared", lambda df, limit=0: shared(df, 0))
    check_near(spark, [(r.doc_id, r.text) for r in docs.collect()])


def test_edge_rows(edge, none):
    got = jaccard.near_groups(edge).collect()
    assert len(got) == len(EDGE)
    seen = {(r.doc_id, r.component_id) for r in got}
    assert {(1, 1), (2, 2), (3, 3), (4, 4), (5, 1), (6, 6), (7, 7), (8, 8), (None, None)} == seen
    assert [r.n_shingles for r in got if r.doc_id == 6] == [59_996]
    assert jaccard.near_groups(none).collect() == []


def test_hashes_of_words_and_shingles_tell_words_apart():
    rnd = random.Random(1)
    for _ in range(1500):
        text = "".join(rnd.choice("aAbZ \n\t\x0b\xa0é") for _ in range(rnd.randint(0, 40)))
        words = text.encode().lower().split()
        hashed = jaccard.word_hashes(text.encode()).tolist()
        assert len(hashed) == len(words) and len(set(zip(words, hashed))) == len(set(words)) == len(set(hashed))
        assert len(jaccard.shingles(text.encode(), 5)) == len(tokens(text))
    assert len(jaccard.word_hashes(b"x" * 100_000 + b" y")) == 2


def test_parity_bitmaps_never_overstate_the_difference():
    rnd = np.random.default_rng(4)
    for n in (3, 50, 5000):
        a = np.unique(rnd.integers(0, 2 ** 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], rnd.integers(0, 2 ** 63, n // 3).astype(np.uint64)]))
        for other in (b, b[: n // 9 + 1]):  # also bitmaps of another length
            differ = jaccard.unlike(jaccard.parity(a), jaccard.parity(other))
            assert 0 < differ <= len(np.setxor1d(a, other)) and jaccard.unlike(jaccard.parity(a), jaccard.parity(a)) == 0


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, j) for j in range(1001, 1100)] + [(5000, 5000), (6000, 6001), (6001, 6000)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(201)}) == 1 and len({got[i] for i in range(1000, 1100)}) == 1
    assert got[6000] == got[6001] and len(set(got.values())) == 3 and 5000 not in got
    assert components(spark.createDataFrame([], "a long, b long")).filter(F.lit(True)).collect() == []


def test_near_copies_among_rows_of_null_and_repeated_ids(spark):
    """Every text of a doc_id counts, also of a null one, and none is dropped for another."""
    import corpus_pipeline as pipe
    rnd = random.Random(9)
    one, two, three, four = ([f"w{rnd.randrange(10 ** 9)}" for _ in range(100)] for _ in range(4))
    rows = [(None, " ".join(one)), (None, " ".join(one) + " end"), (None, " ".join(two)), (5, " ".join(two) + " end"),
            (7, " ".join(three)), (7, " ".join(four)), (9, " ".join(four) + " end"), (None, "alone here"), (None, None),
            ((1 << 62) + 1, "a large number")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.near_groups(df).collect())
    assert got == sorted([("None", 96, "None"), ("None", 97, "None"), ("None", 96, "5"), ("5", 97, "5"), ("7", 96, "7"), ("7", 96, "7"),
                          ("9", 97, "7"), ("None", 1, "None"), ("None", 0, "None"), (str((1 << 62) + 1), 1, str((1 << 62) + 1))])
    kept = Counter((r.doc_id, r.text) for r in pipe.drop_near_copies(spark, df, "").collect())
    either = [k for k in rows[:2] if k in kept]
    assert len(either) == 1 and kept == Counter(either + [rows[k] for k in (3, 4, 5, 7, 8, 9)])


def test_documents_whose_numbers_clash_are_told_apart(spark, monkeypatch):
    real, seeds = jaccard._texts, []

    def clashing(docs, seed):
        seeds.append(seed)
        return real(docs, seed).withColumn("id", F.lit(1).cast("long")) if seed == 0 else real(docs, seed)
    monkeypatch.setattr(jaccard, "_texts", clashing)
    check_near(spark, [(1, "a b c d e f"), (2, "u v w x y z"), (3, "A b c d e f")])
    assert seeds == [0, 1]


def test_patterned_words_do_not_share_a_hash():
    """Thue-Morse words and their complements are taken for one by any polynomial modulo 2 ** 64."""
    seen = set()
    for n in range(1, 15):
        word = "".join("ab"[bin(i).count("1") % 2] for i in range(1 << n))
        for w in (word, word.translate(str.maketrans("ab", "ba"))):
            one, = jaccard.word_hashes(w.encode())
            two = jaccard.word_hashes(f"x {w.upper()} {w}\t{w}y".encode())
            assert one == two[1] == two[2] != two[3]
            assert one not in seen
            seen.add(one)
    rng = random.Random(1)
    words = {"".join(rng.choice("ab\0é") for _ in range(rng.randint(1, 90))) for _ in range(20_000)}
    assert len(set(jaccard.word_hashes(" ".join(sorted(words)).encode()).tolist())) == len(words)


def test_unlike_patterned_documents_stay_apart(spark):
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
    df = frame(spark, [(1, word), (2, word.translate(str.maketrans("ab", "ba"))), (3, word)])
    assert sorted((r.doc_id, r.component_id) for r in jaccard.near_groups(df).collect()) == [(1, 1), (2, 2), (3, 1)]


def test_a_broadcast_has_so_many_rows_at_most(spark, docs, monkeypatch):
    """Beyond the bound, sets are compared in several passes over the texts, each with a broadcast within it; links are the same."""
    want = sorted(map(tuple, jaccard.near_documents(docs).select("doc_id", "hash", "component_id", "kept").collect()))
    sent = []

    def watched(df, f=F.broadcast):
        sent.append(df.count())
        return f(df)
    monkeypatch.setattr(jaccard.F, "broadcast", watched)
    monkeypatch.setattr(jaccard, "SHARED_IDS", 40)
    got = sorted(map(tuple, jaccard.near_documents(docs).select("doc_id", "hash", "component_id", "kept").collect()))
    assert got == want
    assert sum(sent) > 40 and max(sent) <= 40, sent


def test_frequent_tokens_come_as_columns(spark, monkeypatch):
    """As many as the bound allows, sorted, without a row object for each."""
    rows = [(i, f"tok{i % 3} " * 5) for i in range(600)]
    texts = jaccard._texts(frame(spark, rows, extra=False), 0).select("id", "text")
    monkeypatch.setattr(type(texts), "collect", lambda self: 1 / 0)
    tokens, counts = jaccard.frequent_tokens(texts, 5)
    assert len(tokens) == len(counts) == 3 and tokens.dtype == np.uint64 and list(tokens) == sorted(tokens)
    assert 300 < counts.sum() < 1000
