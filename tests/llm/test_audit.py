"""Filter audit against a plain walk through all orders."""

import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest

from tests.llm.conftest import EDGE, SF, frame
from turnwise.llm import audit, lookup
from turnwise.llm.tables import word_pieces


def plain(rows, labels):
    """rows: (doc_id, text, lang); labels: (doc_id, quality, toxic). Rows of the audit, by (part, order, step)."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    ids = defaultdict(list)
    for i, t, _ in rows:
        if i is not None:
            ids[t or ""].append(i)
    out, shapley = defaultdict(Counter), Counter()
    for i, t, lang in rows:
        t, part = t or "", lang or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
                 "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
                 "E": i is not None and bool(ids[t]) and min(ids[t]) < i}
        for order in permutations("ABCDE"):
            gone = False
            for step, f in enumerate(order, 1):
                c = out[part, "".join(order), step]
                c["removed"] += not gone and fails[f]
                c["redundant"] += gone and fails[f]
                c["unique_fails"] += fails[f] and sum(fails.values()) == 1
                c["good_lost"] += not gone and fails[f] and i in good
                c["toxic_lost"] += not gone and fails[f] and i in toxic
                shapley[part, f] += not gone and fails[f]
                gone = gone or fails[f]
                c["kept"] += not gone
    return {(p, o, s): tuple(c[k] for k in audit.COUNTERS) + (shapley[p, o[s - 1]],) for (p, o, s), c in out.items()}


def found(rows):
    out = {}
    for r in rows.collect():
        assert (r.part, r.filter_order, r.step) not in out
        out[r.part, r.filter_order, r.step] = tuple(r[c] for c in (*audit.COUNTERS, "shapley"))
    return out


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, Quality string")


def test_whole_tables(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    want = plain([(r.doc_id, r.text, r.lang) for r in docs.collect()], [(r.doc_id, r.quality, r.toxic) for r in labels.collect()])
    assert found(audit.audit(audit.quality_failures(docs, labels))) == want


def test_edge_rows(spark, edge):
    """Nulls everywhere, repeated ids and rows, labels given twice, clashing names."""
    more = [(None, "x"), (9, "x"), (9, "x"), (10, "A# B"), (11, " ".join(["a b"] * 150)), (12, None), (13, "AB" * 400_000)]
    rows = EDGE + more
    labels = [(2, 1, 0, "?"), (2, 0, 1, "?"), (None, 1, 1, "?"), (5, 1, None, "?"), (10, None, 1, "?"), (77, 1, 1, "?")]
    table = frame(spark, rows)
    want = plain([(i, t, "en") for i, t in rows], [x[:3] for x in labels])
    got = found(audit.audit(audit.quality_failures(table, labelled(spark, labels))))
    assert got == want and len(got) == 600


def test_null_parts_and_empty_tables(spark, none):
    labels = labelled(spark, [])
    assert audit.audit(audit.quality_failures(none, labels)).collect() == []
    rows = spark.createDataFrame([(None, None, None, None), ("", 1, True, None), ("x", 31, None, True)],
                                 "part string, mask int, good boolean, toxic boolean")
    got = found(audit.audit(rows))
    assert len(got) == 1200
    assert got["", "ABCDE", 1] == (1, 1, 0, 1, 1, 0, 120)
    assert got["x", "EDCBA", 2] == (0, 0, 1, 0, 0, 0, 24)


def test_counts_near_the_width_of_a_field_do_not_run_over():
    one = audit.counter("AB", 1, True, False)
    many = (1 << 63) - 1
    values = audit.unpacked("AB", one * many)
    assert values.max() == many
    assert (values == audit.unpacked("AB", one).astype("u8") * many).all()


def test_many_parts_are_passed_on_early(spark, monkeypatch):
    rows = spark.range(3000).selectExpr("cast(id % 700 as string) part", "cast(id % 4 as int) mask", "id % 2 = 0 good", "false toxic").coalesce(2)
    got = found(audit.audit(rows, "AB"))
    assert len(got) == 700 * 4
    assert sum(v[0] + v[1] for (p, o, s), v in got.items() if o == "AB" and s == 1) == 3000


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64])
def test_words_in_pieces(size):
    for text in (b"", b" ", b"a", b"ab cd", b"  ab\tcd\n", b"abcdefgh i jklm  nopq ", b"x" * 50):
        assert [w for p in word_pieces(text, size) for w in p] == text.split()


def test_lookup_of_heavy_keys(spark, monkeypatch):
    monkeypatch.setattr(lookup, "HEAVY", 5)
    rows = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 50 + [2] * 30 + [None] * 40 + list(range(3, 40)))], "k int, i int")
    table = spark.createDataFrame([(1, "one"), (7, "seven")], "k int, v string")
    got = sorted((r.i, r.k, r.v) for r in lookup.lookup(rows, table, "k").collect())
    assert got == sorted((r.i, r.k, {1: "one", 7: "seven"}.get(r.k)) for r in rows.collect())
