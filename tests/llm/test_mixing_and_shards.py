"""The mix against a plain water-filling; shards against plain weighted draws."""

import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import xxhash
from tests.llm.conftest import EDGE, frame

from turnwise.llm import mixing, sharding


def targets(sizes, weights=(5, 2, 1), share=1.5, epochs=2):
    order = sorted([s for s in sizes if s is not None]) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, total = set(), share * sum(sizes.values())
    while True:
        rest = total - sum(epochs * sizes[s] for s in full)
        open_ = [s for s in order if s not in full]
        level = rest / sum(weight[s] for s in open_) if open_ else 0
        over = {s for s in open_ if weight[s] * level >= epochs * sizes[s]}
        if not over:
            return {s: epochs * sizes[s] if s in full else weight[s] * level for s in order}
        full |= over


def check_mix(rows, got, near=True):
    size = Counter()
    for i, source, text in rows:
        size[source] += len(re.findall("[^\x20\x09-\x0d]+", text or ""))
    want, taken = targets(size), Counter()
    assert len(got) == len(rows)
    source_of = {i: s for i, s, _ in rows}
    for r in got:
        s = source_of[r.doc_id]
        taken[s] += r.taken
        assert r.source_size == size[s] and math.isclose(r.target, want[s], rel_tol=1e-9)
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.size * r.times
    if near:
        for s in size:
            largest = max(len((t or "").split()) for _, x, t in rows if x == s)
            assert abs(taken[s] - want[s]) <= largest / 2 + 1
    assert sum(want.values()) <= 1.5 * sum(size.values()) * (1 + 1e-9)


def test_targets_are_met_and_reruns_agree(spark, docs):
    rows = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    got = mixing.mix(docs).collect()
    check_mix(rows, got)
    assert sorted(map(tuple, mixing.mix(docs.repartition(7)).collect())) == sorted(map(tuple, got))
    assert sorted(map(tuple, mixing.mix(docs, seed=8).collect())) != sorted(map(tuple, got))


def test_blocks_of_a_hot_source_give_the_same_mix(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice(["hot", "hot", "hot", "b", None, "ä", "Z"]), "w " * rnd.randint(0, 30)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    sized = mixing.sized(df)
    one = mixing.times_taken(sized, mixing.mixing_plan(sized, block_rows=10_000)).select("doc_id", "times").collect()
    many = mixing.times_taken(sized, mixing.mixing_plan(sized, block_rows=50)).select("doc_id", "times").collect()
    assert sorted(one) == sorted(many)
    check_mix(rows, mixing.mix(df).collect())


def test_mix_of_edge_rows(spark, edge, none):
    got = mixing.mix(edge).collect()
    assert len(got) == len(EDGE) and all(r.taken <= 2 * r.size for r in got)
    assert mixing.mix(none).collect() == []
    empty = mixing.mix(frame(spark, [(1, ""), (2, None)])).collect()
    assert {(r.size, r.target, r.taken) for r in empty} == {(0, 0.0, 0)}


def draw(key, path):
    h = 42 if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
    return ((xxhash.xxh64_intdigest(path.encode(), h) >> 11) + .5) * 2.0 ** -53


def shard(key, node, path=""):
    if not isinstance(node, dict):
        return None
    weigh = lambda n: sum(map(weigh, n.values())) if isinstance(n, dict) else n
    k = min(node, key=lambda k: -math.log(draw(key, f"{path}/{k}")) / weigh(node[k])) if len(node) > 1 else next(iter(node))
    return shard(key, node[k], f"{path}/{k}") if isinstance(node[k], dict) else k


def check_shards(rows, got, tree, grown):
    assert len(got) == len(rows)
    slots = defaultdict(list)
    text = dict(rows)
    for r in got:
        slots[r.shard].append(r.slot)
        data = (text[r.doc_id] or "").encode()
        assert r.shard == shard(r.doc_id, tree) and r.grown_shard == shard(r.doc_id, grown)
        assert r.grown_shard in (r.shard, 16) and r.law == "key"
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))
    for s, found in slots.items():
        assert sorted(found) == list(range(len(found)))


def test_shards_like_plain_draws(spark, docs):
    tree = sharding.even_tree(16)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for block_rows in (4096, 3):
        check_shards(rows, sharding.assign_shards(docs, tree, block_rows).collect(), tree, sharding.grown_tree(tree, 16))


def test_shards_of_edge_rows(edge, none):
    got = sharding.assign_shards(edge, sharding.even_tree(16)).collect()
    assert len(got) == len(EDGE) and all(0 <= r.shard < 16 for r in got)
    assert len({r.shard for r in got if r.doc_id is None}) == 1
    assert sharding.assign_shards(none, sharding.even_tree(16)).collect() == []


def test_weights_are_kept_and_movement_stays_in_changed_subtrees(spark):
    tree = {"east": {"a": {0: 1.0, 1: 3.0}, "b": {2: 2.0}}, "west": {"a": {3: 4.0}, "b": {4: 0.0, 5: 2.0}}}
    heavier = {"east": tree["east"], "west": {"a": {3: 4.0}, "b": {4: 3.0, 5: 2.0}}}
    rows = spark.range(20_000)
    both = rows.select(sharding.shard_of(rows.id, tree).alias("old"), sharding.shard_of(rows.id, heavier).alias("new")).collect()
    share = Counter(r.old for r in both)
    assert 4 not in share
    for s, w in {0: 1, 1: 3, 2: 2, 3: 4, 5: 2}.items():
        assert abs(share[s] / 20_000 - w / 12) < 0.015
    moved = [(r.old, r.new) for r in both if r.old != r.new]
    assert moved and all(new in (3, 4, 5) for _, new in moved)  # nothing moves into the region that stayed as it was
    assert all(not (old in (0, 1, 2) and new in (0, 1, 2)) for old, new in moved)


def test_rows_of_null_and_repeated_ids_are_taken_one_by_one(spark):
    """A null and a repeated doc_id hold much of a source each, with different texts and with equal ones."""
    rnd = random.Random(8)
    rows = [(None, "a", f"{k} " + "w " * rnd.randint(0, 9)) for k in range(300)] + [(i, "a", "w " * 5) for i in range(1, 300)]
    rows += [(-1, "b", f"{k} " + "w " * rnd.randint(0, 9)) for k in range(200)] + [(1000 + i, "b", "w " * 5) for i in range(100)]
    rows += [(-2, None, "the same text")] * 200 + [(2000 + i, None, "w " * 5) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(df).collect()
    check_mix(rows, got)
    assert sorted(map(str, mixing.mix(df.repartition(7)).collect())) == sorted(map(str, got))
    assert all(len({r.times for r in got if r.doc_id == i}) == 2 for i in (None, -1))

    import corpus_pipeline as pipe
    assert sum(len(r.text.split()) for r in pipe.mix_sources(spark, df, "").collect()) == sum(r.taken for r in got)


def test_rows_without_words_are_not_repeated(spark):
    """A source without words gives no row; elsewhere such rows come as often as every row does, also at whole = epochs."""
    rows = [(i, "a", "one two three" if i % 3 else "") for i in range(30)] + [(100 + i, "b", [None, "", " \t"][i % 3]) for i in range(9)] + [(200, "c", "w " * 4)]
    df = spark.createDataFrame([(i, t, s) for i, s, t in rows], "doc_id long, text string, source string")
    for share, epochs in ((1.5, 2.0), (9.0, 2.0), (0.3, 2.0), (1.0, 1.0)):
        got = {r.doc_id: r for r in mixing.mix(df, share=share, epochs=epochs).collect()}
        assert len(got) == len(rows) and all(got[i].times == 0 for i in got if 100 <= i < 109)
        whole = {s: int(got[i].target // got[i].source_size) for i, s in ((0, "a"), (200, "c"))}
        for i, s, t in rows:
            if s != "b":
                assert got[i].times == whole[s] if got[i].size == 0 else whole[s] <= got[i].times <= min(whole[s] + 1, epochs), (i, share)
