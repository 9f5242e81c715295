"""Spelling variants against plain loops."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import EDGE, frame
from turnwise.llm import spelling


def words_of(rows, least_length, least):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= least_length and c >= least}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(n):
    by_length = {}
    for w in n:
        by_length.setdefault(len(w), []).append(w)
    out, form = {}, {}
    for w in n:
        near = [v for k in (-1, 0, 1) for v in by_length.get(len(w) + k, ()) if v != w and one_apart(w, v)]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
        out[w] = len(near)

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return {w: (form[w], root(w), n[w], out[w], n.get(form[w])) for w in n}


def found(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.fixture(scope="module")
def some(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def test_whole_table(spark, docs, some):
    want = plain(words_of(some, 5, 3))
    assert found(spelling.variants(docs)) == want
    assert sum(w[0] is not None for w in want.values()) > 100


def test_shorter_words_in_several_passes(spark, docs, some):
    """Filters that may take a kilobyte only are probed in several passes; the words are the same."""
    got = found(spelling.variants(docs, 2, 2, filter_bytes=2048))
    assert got == plain(words_of(some, 2, 2))


def test_edge_rows(spark, edge, none):
    long = "abcde" * 3000
    rows = EDGE + [(20, f"Hällo hÄllo hallo HALLO hallo hällo {long} {long} {long} x{long} x{long} x{long}"), (21, "aabbb " * 5 + "aabb " * 5 + "aaabbb " * 20),
                   (22, "×÷ÿßà " * 4 + "×÷ÿß " * 9), (None, "wordx " * 9), (None, "wordy " * 4), (23, "wordĀword word一words"),
                   (24, " ".join(["chain"] * 4 + ["chains"] * 8 + ["cheins"] * 16 + ["cheinsa"] * 40))]
    table = frame(spark, rows)
    want = plain(words_of(rows, 4, 3))
    assert found(spelling.variants(table, 4, 3)) == want
    assert want["chain"][1] != want["chain"][0]
    assert found(spelling.variants(none)) == {}


def test_ties_take_the_smallest_word(spark):
    rows = [(1, "house " * 3 + "mouse " * 9 + "éouse " * 9 + "louse " * 9)]
    n = words_of(rows, 5, 3)
    assert found(spelling.variants(frame(spark, rows))) == plain(n)
    assert spelling.variants(frame(spark, rows)).filter("word = 'house'").head().form == "louse"


def test_hashes_of_edits_equal_those_of_the_edited_words():
    words = ["letters", "llämmer", "aaaaaaa"]
    letters = np.array([list(w.encode("latin-1")) for w in words], np.uint8)
    alphabet = np.array([97, 101, 255], np.uint8)

    class All:
        blocks = {6: None, 7: None}
        asked = []

        def may_hold(self, length, h):
            self.asked.append((length, h))
            return np.arange(len(h))
    for at, near in spelling.edits(7, letters, alphabet, All()):
        length, h = All.asked[-1]
        same = spelling.sums(np.array([list(w.encode("latin-1")) for w in near], np.uint8))
        assert set(same) <= set(h) and len(near[0]) == length
        assert all(one_apart(words[i], w) for i, w in zip(at, near))


def test_bloom_filters_hold_all_words_and_few_others(spark):
    words = spark.range(5000).selectExpr("concat('word', translate(cast(id as string), '0123456789', 'abcdefghij')) word", "5L n").checkpoint()
    hold = [r.word for r in words.collect()]
    parts = list(spelling.filters(words, 4096))
    assert len(parts) > 1
    other = ["abcdefg"[i % 7] + w[1:] for i, w in enumerate(hold)]
    for length in {len(w) for w in hold}:
        own = np.array([list(w.encode()) for w in hold if len(w) == length], np.uint8)
        hit = np.concatenate([p.may_hold(length, spelling.sums(own)) for p in parts])
        assert sorted(hit) == list(range(len(own)))
        foreign = np.array([list(w.encode()) for w in other if len(w) == length], np.uint8)
        assert sum(len(p.may_hold(length, spelling.sums(foreign))) for p in parts) <= 0.02 * len(foreign) + 2
