"""Operators on small hand-made or random rows, against values worked out by hand or plain loops."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from turnwise.operators import conversations as conv
from turnwise.operators import cues as cue_ops
from turnwise.operators import quotes as quote_ops
from turnwise.operators import responses, scoring, selection, speakers, topics
from turnwise.operators import turns as talk
from turnwise.operators import windows as win
from turnwise.plans import cut as cut_ops
from turnwise.plans.blocks import by_position, by_time

WORD = "stream_id long, pos long, text string, start double, end double, speaker string"
SEG = "stream_id long, seg_pos long, seg_speaker string, seg_start double, seg_end double"
TURN = "stream_id long, idx long, speaker string, start double, end double, text string, word_count int"


def test_assign_speaker_ties_gaps_and_points(spark):
    words = spark.createDataFrame([
        (1, 0, "a", 0.0, 2.0, "7"),    # 1 s in x, 1 s in y: the earlier segment
        (1, 1, "b", 2.5, 2.5, "7"),    # no length: fallback
        (1, 2, "c", 9.0, 9.5, None),   # nothing there, no speaker
        (1, 3, "d", 3.0, None, "7"),   # no end: lasts 0.1 s
        (2, 0, "e", 0.0, 1.0, "7"),    # another stream
        (1, 4, "f", 4.0, 6.0, "7"),    # touches y, lies in z
    ], WORD)
    segs = spark.createDataFrame([(1, 0, "x", -1.0, 1.0), (1, 1, "y", 1.0, 4.0), (1, 2, "z", 4.0, 40.0),
                                  (1, 3, "back", 8.0, 7.0), (1, 4, "z2", 50.0, 60.0)], SEG)
    got = {(r.stream_id, r.pos): (r.speaker_name, r.matched)
           for r in speakers.assign_speaker(words, segs, width=5.0).collect()}
    assert got == {(1, 0): ("x", True), (1, 1): ("fallback_7", False), (1, 2): ("z", True), (1, 3): ("y", True),
                   (2, 0): ("fallback_7", False), (1, 4): ("z", True)}
    moved = speakers.assign_speaker(words, segs, offset=100.0).collect()
    assert all(r.speaker_name in ("fallback_7", "fallback_unknown") for r in moved)


def test_speakers_of_crowded_segments(spark):
    """Against a plain loop, and without a join that lists which segments a word meets."""
    rng = random.Random(3)
    for size, span in ((8, 40), (60, 9), (60, 40)):
        segs, words = [], []
        for s in range(3):
            for i in range(size):
                at = rng.randrange(0, 60) / 2
                segs.append((s, i, rng.choice("abc"), at, at + rng.randrange(-1, 12) / 2))
                at = rng.randrange(-10, 70) / 2
                words.append((s, i, "w", at, at + rng.randrange(0, span) / 2, "7"))
        at, named = {}, {}
        for s, i, _, lo, hi, _ in words:
            own = sorted((x[3], x[1], x[4], x[2]) for x in segs if x[0] == s and x[3] <= x[4])
            at[s, i] = next((x[3] for x in own if x[0] <= lo <= x[2]), None)
            most = max(own, key=lambda x: min(hi, x[2]) - max(lo, x[0]))
            named[s, i] = most[3] if min(hi, most[2]) > max(lo, most[0]) else "fallback_7"
        w, g = spark.createDataFrame(words, WORD), spark.createDataFrame(segs, SEG)
        assert {(r.stream_id, r.pos): r.speaker_at for r in
                speakers.speaker_at(w, g, point_id="pos", time="start", width=7.0).collect()} == at
        assert {(r.stream_id, r.pos): r.speaker_name for r in speakers.assign_speaker(w, g, width=7.0).collect()} == named
    n = 4_000
    many = spark.range(n).select(F.lit(1).cast("long").alias("stream_id"), F.col("id").alias("seg_pos"), F.lit("a").alias("seg_speaker"),
                                 (F.col("id") / 100).alias("seg_start"), (F.col("id") / 100 + 50).alias("seg_end"))
    asks = many.select("stream_id", F.col("seg_pos").alias("p"), F.col("seg_start").alias("t"))
    out = speakers.speaker_at(asks, many, point_id="p", time="t")
    assert out.filter("speaker_at = 'a'").count() == n
    assert "_bucket" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_speaker_at_counts_both_ends(spark):
    segs = spark.createDataFrame([(1, 0, "x", 0.0, 5.0), (1, 1, "y", 5.0, 8.0)], SEG)
    points = spark.createDataFrame([(1, i, t) for i, t in enumerate([0.0, 5.0, 8.0, 8.1])], "stream_id long, p long, t double")
    got = {r.p: r.speaker_at for r in speakers.speaker_at(points, segs, point_id="p", time="t").collect()}
    assert got == {0: "x", 1: "x", 2: "y", 3: None}


def test_story_length_does_not_depend_on_order(spark):
    lengths = [243.2, 128.3, 183.7, 31.7, 13.1]  # as floats 600 in one order, 600.0000000000001 in the other
    rows = [(1, x) for x in lengths] + [(2, x) for x in sorted(lengths)]
    segs = spark.createDataFrame(rows, "stream_id long, end double").withColumn("start", F.lit(0.0)).coalesce(1)
    got = {r.stream_id: (r.segments, r.total_duration) for r in scoring.valid_stories(segs, keys=["stream_id"]).collect()}
    assert got == {1: (5, 600.0), 2: (5, 600.0)}


def test_sliding_windows_at_the_end_of_a_float(spark):
    """(1854.947 - 54.947) / 1800 is 1, but the window begins at 54.947 + 1800 = 1854.9470000000001."""
    turns = spark.createDataFrame([(1, i, "a", t, t + 5000.0, "x", 1) for i, t in enumerate([54.947, 1854.947])]
                                  + [(2, i, "a", t, t + 5000.0, "x", 1) for i, t in enumerate([16.562, 35416.562])], TURN)
    got = {(r.stream_id, r.w_start, r.turns) for r in win.sliding_windows(turns, size=3000.0, hop=1800.0).collect()}
    want = set()
    for s, s0, starts in ((1, 54.947, [54.947, 1854.947]), (2, 16.562, [16.562, 35416.562])):
        for k in range(40):
            lo = s0 + k * 1800.0
            n = sum(lo <= t < lo + 3000.0 for t in starts)
            if n and lo < starts[-1] + 5000.0:
                want.add((s, lo, n))
    assert got == want


def test_topic_references_of_small_tables_are_dealt_out(spark):
    """A table of one file part comes in one task; its pairs must not all be made there."""
    blocks = spark.range(0, 300, 1, 1).select(
        F.lit(1).cast("long").alias("stream_id"), F.lit(0).cast("long").alias("conv_id"), F.lit("t").alias("topic_id"), F.col("id").alias("block_no"),
        (F.col("id") * 100.0).alias("t_start"), (F.col("id") * 100.0 + 10).alias("t_end"), F.lit("calm").alias("sentiment"))
    clips = blocks.select("stream_id", "conv_id", "topic_id", F.col("block_no").alias("clip_id"), F.col("t_start").alias("start"), F.col("t_end").alias("end"))
    made = topics.topic_references(clips, blocks).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in made) == 300 * 299 and len(made) > 1


def test_build_turns_pause_and_missing_values(spark):
    words = spark.createDataFrame([
        (1, 0, "a", 0.0, 1.0, "A"), (1, 1, "b", 3.0, 3.5, "A"),      # a pause of exactly 2 s joins
        (1, 2, "c", 5.6, None, "A"),                                 # 2.1 s parts; no end: 0.1 s
        (1, 3, "d", 5.7, 6.0, None), (1, 4, "e", 6.0, 6.5, None),    # no speaker is one speaker
        (1, 5, "f", 6.5, 7.0, "A")], WORD)
    for rows in (1, 2, 1000):
        got = talk.build_turns(words, block=by_position("pos", rows)).orderBy("start").collect()
        assert [(r.speaker, r.start, round(r.end, 3), r.word_count, r.text) for r in got] == [
            ("A", 0.0, 3.5, 2, "a b"), ("A", 5.6, 5.7, 1, "c"), ("unknown", 5.7, 6.5, 2, "d e"), ("A", 6.5, 7.0, 1, "f")]


def _conversations(rows, hosts, half, need, least):
    """The rule in words, on one stream of (idx, speaker, start, end, words)."""
    lead = []
    for r in rows:
        near = Counter(x[1] for x in rows if abs(x[2] - r[2]) <= half and x[1] not in hosts)
        top = near.most_common(1)
        lead.append(top[0][0] if top and top[0][1] >= need else None)
    stretches = []
    for r, who in zip(rows, lead):
        if who is None:
            if stretches:
                stretches[-1][1].append(r)
        elif stretches and stretches[-1][0] == who:
            stretches[-1][1].append(r)
        else:
            stretches.append((who, [r]))
    joined = []
    for who, rs in stretches:
        if rs[-1][3] - rs[0][2] < least:
            continue
        if joined and joined[-1][0] == who:
            joined[-1][1].extend(rs)
        else:
            joined.append((who, list(rs)))
    return [(w, rs[0][2], rs[-1][3], sum(r[4] for r in rs if r[1] in hosts), sum(r[4] for r in rs if r[1] not in hosts),
             sum(r[1] not in hosts for r in rs), sorted({r[1] for r in rs} - set(hosts))) for w, rs in joined]


def test_segment_conversations(spark):
    rnd = random.Random(11)
    streams = {}
    for s in range(3):
        t, rows = 0.0, []
        for i in range(150):
            t += rnd.choice([0, 1, 3, 20])
            guest = "abc"[(i // 25) % 3] if rnd.random() < .8 else rnd.choice("abc")
            rows.append((i, "host" if rnd.random() < .4 or s == 2 else guest, t, t + rnd.choice([1, 2]), rnd.randint(1, 9)))
        streams[s] = rows
    df = spark.createDataFrame([(s, r[0], r[1], float(r[2]), float(r[3]), "", r[4]) for s, rs in streams.items() for r in rs], TURN)
    for width in (50.0, 10_000.0):
        got = conv.segment_conversations(df, F.col("speaker") == "host", half_window=30.0, need=3, min_duration=40.0,
                                         block_seconds=width).orderBy("stream_id", "conv_no").collect()
        got = {s: [(r.dominant, r.start, r.end, r.host_words, r.guest_words, r.turn_count, r.guests) for r in got
                   if r.stream_id == s] for s in streams}
        assert got == {s: _conversations(rs, ["host"], 30, 3, 40) for s, rs in streams.items()}
        assert got[2] == []   # a stream with only the host


def test_match_cues_like_finditer(spark):
    rnd = random.Random(5)
    vocabulary = ["good", "to", "be", "here", "see", "you", "later,", "(good", "Good", "bye", "goodbye", "été", "to."]
    texts = {s: [rnd.choice(vocabulary) for _ in range(300)] for s in (1, 2)}
    words = spark.createDataFrame([(s, i, w, i * .3, i * .3 + .2, "A") for s, ws in texts.items() for i, w in enumerate(ws)], WORD)
    patterns = [cue_ops.Pattern("good_to", "intro", r"good\s+to(?:\s+be)?"), cue_ops.Pattern("bye", "exit", r"bye|see\s+you"),
                cue_ops.Pattern("x_x", "exit", r"to\s+\S+\s+to")]
    got = Counter((r.stream_id, r.pattern, r.first_pos, r.last_pos, r.phrase)
                  for r in cue_ops.match_cues(words, patterns, block_rows=50).collect())
    in_blocks = cue_ops.match_cues(words, patterns, block_rows=50, spot_words=0).collect()
    assert got == Counter((r.stream_id, r.pattern, r.first_pos, r.last_pos, r.phrase) for r in in_blocks)
    assert all(r.end == pytest.approx(r.last_pos * .3 + .2) for r in in_blocks)
    any_start = [*patterns, cue_ops.Pattern("any_bye", "exit", r"\S+\s+bye")]
    more = cue_ops.match_cues(words, any_start, block_rows=50).collect()
    assert got == Counter((r.stream_id, r.pattern, r.first_pos, r.last_pos, r.phrase) for r in more if r.pattern != "any_bye")
    assert any(r.pattern == "any_bye" for r in more)
    want = Counter()
    for s, ws in texts.items():
        text, starts, at = " ".join(ws), [], 0
        for w in ws:
            starts.append(at)
            at += len(w) + 1
        for p in patterns:
            for m in re.finditer(r"(?<![^\W_])(" + p.regex + r")(?![^\W_])", text, re.I):
                first = max(i for i, x in enumerate(starts) if x <= m.start())
                last = max(i for i, x in enumerate(starts) if x < m.end())
                want[(s, p.name, first, last, m.group(1))] += 1
    assert got == want


def test_sentence_boundary(spark):
    words = spark.createDataFrame([(1, 0, "Hi", 0.5, 1.0, "A"), (1, 1, "there.", 1.0, 2.0, "A"), (1, 2, "So", 3.0, 3.5, "A"),
                                   (1, 3, "what?", 3.5, 4.0, "A"), (1, 4, "well", 5.0, 6.0, "A")], WORD)
    points = spark.createDataFrame([(1, i, t) for i, t in enumerate([0.0, 2.0, 3.9, 9.0])] + [(2, 9, 1.0)],
                                   "stream_id long, p long, t double")
    for width in (1.0, 3600.0):
        before = {r.p: r.boundary for r in win.sentence_boundary(points, words, point_id="p", time="t", block_seconds=width).collect()}
        after = {r.p: r.boundary for r in win.sentence_boundary(points, words, point_id="p", time="t", direction="after",
                                                                 block_seconds=width).collect()}
        assert before == {0: 0.5, 1: 2.0, 2: 2.0, 3: 4.0, 9: 0.0}
        assert after == {0: 2.0, 1: 4.0, 2: 6.0, 3: 6.0, 9: 0.0}


def _place(quote, words):
    """Exact place in the joined text, else the loose one."""
    text, starts, at = " ".join(w.lower() for w in words), [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    q = " ".join(quote.lower().split())
    i = text.find(q)
    if i >= 0:
        return next((n for n, x in enumerate(starts) if x >= i), None)
    parts = q.split()
    for n in range(len(words) - 2) if len(parts) >= 3 else ():
        near = " ".join(w.lower() for w in words[n:n + 5])
        if parts[0] in near and parts[-1] in near:
            return n
    return None


def test_anchor_quotes(spark):
    rnd = random.Random(9)
    vocabulary = ["the", "cat", "scat", "on", "a", "mat.", "The", "then", "dog", "bathe"]
    texts = {s: [rnd.choice(vocabulary) for _ in range(120)] for s in (1, 2)}
    quotes = []
    for i in range(120):
        s = rnd.choice((1, 2))
        at, n = rnd.randrange(100), rnd.choice([3, 4, 5, 8])
        q = " ".join(texts[s][at:at + n])
        if i % 3 == 1:
            q = q[1:-1].strip()          # begins and ends inside words
        if i % 3 == 2:
            q = q.split()[0] + "  zebra " + q.split()[-1]
        if len(q.split()) >= 3:
            quotes.append((s, i, q))
    words = spark.createDataFrame([(s, i, w, float(i), i + 1.0, "A") for s, ws in texts.items() for i, w in enumerate(ws)], WORD)
    q = spark.createDataFrame(quotes, "stream_id long, quote_id long, quote string")
    got = {r.quote_id: None if r.time is None else int(r.time) for r in quote_ops.anchor_quotes(q, words).collect()}
    assert got == {i: _place(text, texts[s]) for s, i, text in quotes}


def test_merge_topics_folds_and_rounds_agree(spark):
    rnd = random.Random(2)
    rows = [(0, c, f"t{i}", i) for c in range(3) for i in range(20)]
    pairs = [(0, c, f"t{i}", f"t{j}", i, j) for c in range(3) for i in range(20) for j in range(i + 1, 20) if rnd.random() < .15]
    t = spark.createDataFrame(rows, "stream_id long, conv_id long, topic_id string, ord long")
    p = spark.createDataFrame(pairs, "stream_id long, conv_id long, a_id string, b_id string, a_ord long, b_ord long")
    want = {}
    for c in range(3):
        like = {(a, b) for _, cc, _, _, a, b in pairs if cc == c}
        lead = []
        for j in range(20):
            first = next((i for i in lead if (i, j) in like), None)
            if first is None:
                lead.append(j)
            want[(c, f"t{j}")] = f"t{j if first is None else first}"
    for largest in (100, 1):
        got = {(r.conv_id, r.topic_id): r.canonical_id for r in topics.merge_topics(t, p, largest=largest).collect()}
        assert got == want


def test_hard_filter_first_reason(spark):
    rows = [("a", 0, None, None, 0.0, 0, 0, ""), ("b", 1, 5.0, None, 0.0, 9, 99, "x"), ("c", 1, 0.0, 29.0, .9, 1, 0, ""),
            ("d", 1, 0.0, 60.0, .9, 1, 0, ""), ("e", 1, 0.0, 60.0, .85, 3, 0, ""), ("f", 1, 0.0, 60.0, .5, 4, 19, ""),
            ("g", 1, 0.0, 60.0, .5, 4, 20, None), ("h", 1, 0.0, 30.0, .5, 4, 20, "x")]
    df = spark.createDataFrame(rows, "id string, segments int, start double, end double, host_ratio double, turns int, guest_words int, claim string")
    got = {r.id: r.reason for r in scoring.hard_filter(df).collect()}
    assert got == {"a": "no segments", "b": "invalid timestamps", "c": "too short", "d": "monologue",
                   "e": "not enough back-and-forth", "f": "guest barely spoke", "g": "no claim", "h": "passed"}


def test_unscored_candidates_fail_a_high_threshold(spark):
    profile = [scoring.Criterion("finish", 25, 7), scoring.Criterion("hook", 20, 4)]
    row = spark.range(1).select(F.lit(None).cast("map<string,double>").alias("s"))
    got = row.select(scoring.first_failure(F.col("s"), F.array().cast("array<string>"), F.lit(True), profile).alias("f")).first().f
    assert got == "dealbreaker: finish"


def test_inverted_clips_are_turned_down(spark):
    df = spark.createDataFrame([(1, 1, 10.0, 0.0, 9.0), (1, 2, 0.0, 10.0, 5.0)], "stream_id long, id long, start double, end double, score double")
    assert [r.id for r in selection.drop_overlaps(df, clip_id="id").collect()] == [2]


def test_suppression_of_parts_like_a_loop(spark):
    rnd = random.Random(8)
    rows = []
    for i in range(80):
        at = float(rnd.randint(0, 200))
        rows.append((1, i, float(rnd.randint(0, 9)), [(at, at + 10), (at + 30, at + 30 + rnd.choice([5, 40]))]))
    df = spark.createDataFrame(rows, "stream_id long, id long, score double, segs array<struct<start:double,end:double>>")
    kept = []
    for r in sorted(rows, key=lambda r: (-r[2], r[1])):
        if not any(max(0, min(a[1], b[1]) - max(a[0], b[0])) > (a[1] - a[0]) * .3 for k in kept for a in r[3] for b in k[3]):
            kept.append(r)
    for largest in (1000, 5):
        got = selection.drop_overlaps(df, clip_id="id", segments=F.col("segs"), largest=largest, width=30.0)
        assert sorted(r.id for r in got.collect()) == sorted(r[1] for r in kept)


def test_natural_ends(spark):
    rnd = random.Random(4)
    words, t = [], 0.0
    for i in range(300):
        t += rnd.choice([.3, .3, .3, 1.6])
        words.append((1, i, "w", t, t + .3, rnd.choice("AAAAB")))
    df = spark.createDataFrame(words, WORD)
    clips = [(1, i, float(s), float(s) + 50, float(s) + 15) for i, s in enumerate(range(0, 260, 13))]
    c = spark.createDataFrame(clips, "stream_id long, id long, start double, end double, anchor double")
    got = {r.id: (round(r.new_start, 6), round(r.new_end, 6)) for r in selection.natural_ends(c, df, clip_id="id", block=by_time("start", 20)).collect()}
    for _, i, start, end, anchor in clips:
        near = [w for w in words if start - 30 <= w[3] <= end + 30]
        a, b = start, end
        if near:
            for p, w in zip(near, near[1:]):
                if w[3] < start and p[5] != w[5]:
                    a = w[3]
            for w, n in zip(near, near[1:]):
                if w[3] >= max(anchor + 20, end - 10) and (n[3] - w[4] > 1 or n[5] != w[5]):
                    b = w[4] + .5
                    break
            if b - a < 45:
                b = a + 60
            b = min(b, words[-1][4])
        assert got[i] == (round(a, 6), round(b, 6))


def test_quotes_in_documents_of_any_length(spark):
    texts = {1: "The cat  sat on\nthe mat.", 2: "a scat saturday", 3: "", 4: "the start is near, so art is new",
             5: " ".join(f"w{i}" for i in range(40))}
    asked = ["cat", "the mat.", "HE cat sat o", "cat sat", "", "cat sat on the ma", "art is ne", "art is", "t i", "s", "ar", "is n",
             " ".join(f"w{i}" for i in range(7, 27))[1:], "zzz", "w3 w4"]
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    quotes = spark.createDataFrame(list(enumerate(asked)), "item_id long, text string")
    want = []
    for i, quote in enumerate(asked):
        low = " ".join(quote.lower().split())
        for d, text in texts.items():
            at = " ".join(text.lower().split()).find(low)
            if low and at >= 0:
                want.append((i, d, at))
    got = sorted(map(tuple, quote_ops.quotes_in_documents(quotes, docs).collect()))
    assert got == sorted(want)


def test_exact_anchors_like_substring_search(spark, tmp_path):
    said = "so the start is near and art is new today".split()
    asked = ["art is ne", "art is", "art", "t i", "oday", "today", "tod", "so", "near and", "the start is near and art is new", "zz", "is zz"]
    words = spark.createDataFrame([(1, i, w, float(i)) for i, w in enumerate(said)], "stream_id long, pos long, text string, start double")
    quotes = spark.createDataFrame([(1, i, q) for i, q in enumerate(asked)], "stream_id long, quote_id long, quote string")
    text, offsets, at = " ".join(said), [], 0
    for w in said:
        offsets.append(at)
        at += len(w) + 1
    want = {}
    for i, q in enumerate(asked):
        if (found := text.find(q)) >= 0 and (later := [k for k, o in enumerate(offsets) if o >= found]):
            want[i] = later[0]
    got = {r.quote_id: r.pos for r in quote_ops.exact_anchors(quotes, words).collect()}
    assert got == want
    for size in (3, 1000):
        index = quote_ops.QuoteIndex.build(words, str(tmp_path / str(size)), block_words=size, parts=4)
        assert {r.quote_id: r.pos for r in index.exact(quotes).collect()} == want


def test_indexed_quotes_like_a_search_of_the_words(spark, tmp_path):
    """Three streams, one of them most of the text with a few common words; two batches of quotes ask one index."""
    rnd = random.Random(9)
    vocabulary = ["the", "of", "a", "an", "Other", "there", "often", "rare", "than", "hand", "x"]
    words, quotes = [], []
    for s, n in ((1, 900), (2, 60), (3, 2)):
        said = rnd.choices(vocabulary, [30, 20, 20, 10, 3, 3, 3, 1, 3, 3, 3], k=n)
        words += [(s, i, w, i * .3) for i, w in enumerate(said)]
        for i in range(60):
            at, size = rnd.randrange(n), rnd.choice([1, 1, 2, 2, 3, 4, 5, 8, 30])
            text = "  ".join(said[at:at + size])
            text = text[rnd.randint(0, 2):len(text) - rnd.randint(0, 1)]
            quotes.append((s, i, text.replace("rare", "none") if i % 7 == 0 else text))
    words = spark.createDataFrame(words, "stream_id long, pos long, text string, start double")
    quotes = spark.createDataFrame(quotes, "stream_id long, quote_id long, quote string")
    index = quote_ops.QuoteIndex.build(words, str(tmp_path / "index"), block_words=50, parts=4)
    want = sorted(map(tuple, quote_ops.anchor_quotes(quotes, words).select("stream_id", "quote_id", "how", "pos", "time").collect()), key=str)
    early = F.col("quote_id") < 30
    got = [r for part in (quotes.filter(early), quotes.filter(~early)) for r in index.anchor(part).select("stream_id", "quote_id", "how", "pos", "time").collect()]
    assert sorted(map(tuple, got), key=str) == want
    assert {h for _, _, h, _, _ in want} == {"exact", "loose", None}
    hot = spark.read.parquet(str(tmp_path / "index" / "places")).filter("stream_id = 1 and word = 'the'")
    assert hot.count() > 10 and hot.agg(F.max(F.size("offsets"))).first()[0] <= 50


def test_cue_matches_of_any_length(spark):
    said = ["Hello"] + [f"w{i}" for i in range(40)] + ["guest", "bye"]
    words = spark.createDataFrame([(1, i, float(i), i + 1.0, "a", w) for i, w in enumerate(said)],
                                  "stream_id long, pos long, start double, end double, speaker string, text string")
    long = cue_ops.Pattern("long", "intro", r"hello(?:\s+\w+){1,60}\s+guest")
    got = cue_ops.match_cues(words, [long]).collect()
    assert [(r.first_pos, r.last_pos) for r in got] == [(0, 41)]
    with pytest.raises(ValueError, match="no most number"):
        cue_ops.match_cues(words, [cue_ops.Pattern("open", "intro", r"hello\s.*guest")])
    assert cue_ops.reach(cue_ops.Pattern("open", "intro", r"hello\s.*guest", span=50)) == 50


@pytest.mark.parametrize("regex, pieces", [
    (r"good\s+to(?:\s+be)?", {("good", True)}), (r"bye|see\s+you", {("bye", False), ("see", True)}), (r"(?:in|by)\s+the", {("in", True), ("by", True)}),
    (r"hello(?:\s+\w+){1,60}\s+guest", {("hello", True)}), (r"hello(?:\s+\w+){0,3}", {("hello", True), ("hello", False)}), (r"good-?bye", {("goodbye", False), ("good-bye", False)}),
    (r"(?:ha)+\s+x", {("ha", False)}), (r"[hH]i\b", {("hi", False), ("Hi", False)}), (r"\w+ing", None), (r"(?:please\s+)?\w+", None), (r"x*y", {("x", False), ("y", False)}),
    (r"(?:the\s+\S+|an?)\s+x", {("the", True), ("a", True), ("an", True)}), (r"(?<n>a", None)])
def test_how_patterns_begin(regex, pieces):
    assert cue_ops.first_pieces(cue_ops.Pattern("p", "intro", regex)) == pieces


def test_no_answer_is_lost(spark):
    texts = ["5", '"x"', "null", "[1,2]", "[]", "no {json", None, '[1, {"a": "p"}, {"a": "q"}]', 'so\n```json\n{"a": "r"}\n```\n', '{"a": 7}']
    answers = spark.createDataFrame(list(enumerate(texts)), "id long, answer string")
    rows, rejects = responses.parse_responses(answers, "a:string")
    assert sorted(tuple(r) for r in rows.select("id", "item_no", "a").collect()) == [(7, 1, "p"), (7, 2, "q"), (8, 0, "r"), (9, 0, "7")]
    assert {r.id: (r.answer, r.reason) for r in rejects.collect()} == {
        i: (texts[i], "no JSON" if i in (5, 6) else "no object") for i in range(7)}


def test_trim_falls_back(spark):
    cands = spark.createDataFrame([(1, 1, 1, 0.0, 40.0, "a", 8.0), (1, 2, 1, 0.0, 40.0, "a", 8.0), (1, 3, 1, 0.0, 9.0, "a", None),
                                   (1, 4, 1, 5.0, 60.0, "a", 6.0), (1, 4, 2, 90.0, 95.0, "b", 6.0)],
                                  "stream_id long, c long, seg_no long, start double, end double, purpose string, preliminary double")
    answers = spark.createDataFrame([(1, 1, "reject", None), (1, 2, None, 7.04)], "stream_id long, c long, verdict string, final_score double")
    segs = spark.createDataFrame([(1, 2, 1, 0.0, 20.0, "x"), (1, 2, 2, 39.0, 60.0, "loud"), (1, 2, 3, 90.0, 120.0, "y")],
                                 "stream_id long, c long, seg_no long, start double, end double, purpose string")
    got = scoring.trim(cands, answers, segs, cand_id="c", overriding=["loud"]).orderBy("c", "seg_no").collect()
    assert [tuple(r)[1:] for r in got] == [
        (2, 1, 0.0, 60.0, "loud", 60.0, "composite", 7.0), (2, 3, 90.0, 120.0, "y", 30.0, "composite", 7.0),
        (3, 1, 0.0, 30.0, "full_clip", 30.0, "continuous", 3.5), (4, 1, 5.0, 60.0, "a", 55.0, "continuous", 4.2)]


def test_talk_time_within(spark):
    segs = spark.createDataFrame([(1, 0, "A", 0.0, 10.0), (1, 1, "B", 5.0, 20.0), (1, 2, "A", 9.0, 9.0), (1, 3, "A", 30.0, 25.0),
                                  (1, 4, "A", 100.0, 400.0), (2, 0, "A", 0.0, 50.0)], SEG)
    spans = spark.createDataFrame([(1, 0, 0.0, 20.0), (1, 1, 10.0, 10.0), (1, 2, 8.0, 9.5), (1, 3, 20.0, 30.0), (1, 4, 150.0, 350.0),
                                   (3, 5, 0.0, 9.0)], "stream_id long, i long, start double, end double")
    for width in (7.0, 1000.0):
        out = speakers.talk_time_within(spans, segs, interval_id="i", label=F.col("seg_speaker"), labels=["A", "B"], block_seconds=width)
        got = {r.i: (round(r.A_time, 6), round(r.B_time, 6)) for r in out.collect()}
        assert got == {0: (10.0, 15.0), 1: (0.0, 0.0), 2: (1.5, 1.5), 3: (0.0, 0.0), 4: (200.0, 0.0), 5: (0.0, 0.0)}


def test_leading_labels_with_many_labels():
    import time

    import numpy as np
    rnd = random.Random(8)
    for trial in range(30):
        n, half, need = rnd.randint(1, 60), rnd.choice([0.0, 3.0, 10.0]), rnd.choice([1, 2, 3])
        start = np.sort(np.array([float(rnd.randint(0, 40)) for _ in range(n)]))
        code = np.array([rnd.randint(-1, 5) for _ in range(n)])
        own = np.array([rnd.random() < .7 for _ in range(n)])
        names = np.array(list("abcdef"), dtype=object)
        want = []
        for i in np.flatnonzero(own):
            near = [int(c) for c, t in zip(code, start) if abs(t - start[i]) <= half and c >= 0]
            top = max(((near.count(c), -near.index(c), c) for c in set(near)), default=(0, 0, -1))
            want.append(names[top[2]] if top[0] >= need else None)
        assert conv._leading_labels(start, code, names, own, half, need) == want
    began, n = time.time(), 200_000
    start, code = np.arange(n, dtype=float), np.arange(n) % 50_000
    assert conv._leading_labels(start, code, np.arange(50_000).astype(object), np.ones(n, bool), 60.0, 1)[0] == 0
    assert time.time() - began < 20


def test_similar_vectors_in_parts(spark):
    rnd = random.Random(9)
    rows = [(1, 1, f"t{i}", (float(i), i), [rnd.gauss(0, 1) for _ in range(3)]) for i in range(60)]
    df = spark.createDataFrame(rows, "stream_id long, conv_id long, topic_id string, ord struct<t:double,n:int>, vector array<double>")
    one, many = (sorted((r.a_id, r.b_id) for r in topics.similar_vectors(df, part_rows=p).collect()) for p in (1000, 7))
    assert one == many and len(set(many)) == len(many) > 20


def _vectors(spark, vectors):
    rows = [(1, i % 2, str(i), i, v) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "stream_id long, conv_id long, topic_id string, ord long, vector array<double>")


def _cosines(vectors, threshold):
    out = set()
    for j, b in enumerate(vectors):
        for i in range(j % 2, j, 2):
            a = vectors[i]
            if a is None or b is None or len(a) != len(b):
                continue
            dot, norms = sum(x * y for x, y in zip(a, b)), math.hypot(*a) * math.hypot(*b)
            if dot / (norms + 1e-9) >= threshold:
                out.add((str(i), str(j)))
    return out


@pytest.mark.parametrize("threshold", [0.95, 0.7, 0.0, -0.2])
def test_similar_vectors_are_all_found(spark, threshold):
    rnd = random.Random(4)
    vectors = [[rnd.gauss(0, 1) for _ in range(3)] for _ in range(90)] + [[0.0, 0.0, 0.0], None, [1.0, 2.0], [2.0, 4.1], [1.0, 1.0, 1.0], [2e-6, 1e-6, 1e-6]] * 2
    got = topics.similar_vectors(_vectors(spark, vectors), threshold=threshold, part_rows=6).collect()
    assert {(r.a_id, r.b_id) for r in got} == _cosines(vectors, threshold)
    assert len(got) == len({(r.a_id, r.b_id) for r in got})


def test_fewer_vectors_are_compared_as_they_spread(spark):
    """Twelve bundles of vectors: the wider they stand apart, the smaller the share of pairs that is compared."""
    shares = []
    for width in (0.05, 0.2, 5.0):
        rnd = random.Random(7)
        centres = [[1.0] + [width * rnd.gauss(0, 1) for _ in range(5)] for _ in range(12)]
        vectors = [[x + 0.02 * rnd.gauss(0, 1) for x in centres[i % 12]] for i in range(360)]
        df = _vectors(spark, vectors)
        counts = topics.compared_pairs(df, threshold=0.97, part_rows=15).collect()
        assert {(r.a_id, r.b_id) for r in topics.similar_vectors(df, threshold=0.97, part_rows=15).collect()} == _cosines(vectors, 0.97)
        assert sum(r.pairs for r in counts) == 2 * 180 * 179 // 2
        shares.append(sum(r.compared for r in counts) / sum(r.pairs for r in counts))
    assert shares[0] > shares[1] >= shares[2] and shares[2] < 0.25, shares


def test_turns_in_parts(spark):
    """A monologue of 4,000 words between short turns: no row has more than a part's words, and glued they are the turns."""
    rnd = random.Random(3)
    rows, t = [], 0.0
    for i in range(6000):
        who = "A" if 1000 <= i < 5000 else rnd.choice(["A", "B", None])
        t += rnd.choice([.3, .3, .3, 3.0]) if not 1000 <= i < 5000 else .3
        rows.append((i % 2, i // 2, f"w{i}", round(t, 1), None if rnd.random() < .1 else round(t + .2, 1), who))
    words = spark.createDataFrame(rows, WORD)
    parts = talk.turn_parts(words, part_words=100, block_rows=170).collect()
    want = talk.build_turns(words).orderBy("stream_id", "start").collect()
    assert max(p.word_count for p in parts) <= 100
    glued = {}
    for p in sorted(parts, key=lambda p: (p.stream_id, p.turn, p.part)):
        glued.setdefault((p.stream_id, p.turn), []).append(p)
    assert all([p.part for p in ps] == list(range(len(ps))) for ps in glued.values())
    assert [(s, ps[0].speaker, ps[0].start, ps[-1].end, sum(p.word_count for p in ps), " ".join(p.text for p in ps)) for (s, _), ps in sorted(glued.items())] == \
        [(r.stream_id, r.speaker, r.start, r.end, r.word_count, r.text) for r in want]
    whole = talk.turns_of_parts(spark.createDataFrame(parts)).orderBy("stream_id", "idx").collect()
    assert [(r.stream_id, r.speaker, r.start, r.end, r.word_count) for r in whole] == [(r.stream_id, r.speaker, r.start, r.end, r.word_count) for r in want]
    assert max(r.parts for r in whole) > 15


def test_reference_totals_count_the_list(spark):
    """One topic with most occurrences, ties of time, clips that hold several and clips of topics that never come up."""
    rnd = random.Random(6)
    blocks = [(1, i % 2, rnd.choice(["t", "t", "t", "u"]), i, float(rnd.randint(0, 400)), rnd.choice(["calm", "heated", "confrontational", None])) for i in range(300)]
    blocks = spark.createDataFrame([(*b[:4], b[4], b[4] + rnd.randint(0, 30), b[5]) for b in blocks],
                                   "stream_id long, conv_id long, topic_id string, block_no long, t_start double, t_end double, sentiment string")
    clips = spark.createDataFrame([(1, i % 2, rnd.choice("tuv"), i, float(s := rnd.randint(0, 400)), float(s + rnd.randint(0, 90))) for i in range(80)],
                                  "stream_id long, conv_id long, topic_id string, clip_id long, start double, end double")
    want = Counter((r.clip_id, r.relation) for r in topics.topic_references(clips, blocks).collect())
    got = topics.topic_reference_totals(clips, blocks, block_seconds=50.0, width=40.0).collect()
    assert len(got) == 80
    names = ("escalation", "continuation", "prior_confrontation", "prior_mention")
    assert Counter({(r.clip_id, n): r[n] for r in got for n in names if r[n]}) == want


def test_dominance_in_a_crowded_hour(spark):
    """Most turns in one hour, in cells of any size, like a plain count; a turn without a start leads nowhere."""
    rnd = random.Random(8)
    rows = [(i % 2, rnd.choice("hABC"), float(rnd.randint(3600, 5400)) if i % 10 else float(rnd.randint(0, 20_000)), i) for i in range(2000)]
    df = spark.createDataFrame([*rows, (1, "A", None, 5000)], "stream_id long, speaker string, start double, idx long")
    want = {(1, 5000): None}
    for s, _, t, i in rows:
        near = [(u, k, w) for z, w, u, k in rows if z == s and w != "h" and abs(u - t) <= 30]
        counts = Counter(w for *_, w in near)
        best = max(counts.values(), default=0)
        want[s, i] = min((u, k, w) for u, k, w in near if counts[w] == best)[2] if best >= 3 else None
    for size in (20_000, 40, 7):
        got = conv.rolling_dominance(df, F.col("speaker") == "h", half_window=30.0, need=3, cell_rows=size).collect()
        assert {(r.stream_id, r.idx): r.dominant for r in got} == want and len(got) == len(want)


def test_anchors_send_no_hits_to_the_driver(spark):
    words = spark.createDataFrame([(1, i, w, float(i)) for i, w in enumerate("the cat sat on the mat and the cat ran".split())],
                                  "stream_id long, pos long, text string, start double")
    asked = spark.createDataFrame([(1, 1, "cat zzz the"), (1, 2, "sat on")], "stream_id long, quote_id long, quote string")
    for out in (quote_ops.loose_anchors(asked, words), quote_ops.anchor_quotes(asked, words)):
        out.collect()
        assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert {(r.quote_id, r.how, r.pos) for r in quote_ops.anchor_quotes(asked, words).collect()} == {(1, "loose", 0), (2, "exact", 2)}


def test_an_index_is_not_sent_when_much_is_asked(spark):
    asked = spark.range(10)
    plans = [quote_ops._request(asked, rows).join(spark.range(20), "id")._jdf.queryExecution().executedPlan().toString() for rows in (9, 10)]
    assert "SortMergeJoin" in plans[0] and "BroadcastHashJoin" in plans[1]


def test_answers_are_not_parsed_again_by_a_filter(spark):
    answers = spark.createDataFrame([(1, '{"title": "a"}'), (2, "none"), (3, None), (4, 'so\n```json\n[{"title": "b"}, 1]\n```\n{x}')], "pos long, answer string")
    rows, rejects = responses.parse_responses(answers, "title string")
    assert {(r.pos, r.item_no, r.title) for r in rows.collect()} == {(1, 0, "a"), (4, 0, "b")}
    assert {(r.pos, r.reason) for r in rejects.collect()} == {(2, "no JSON"), (3, "no JSON")}
    for out in (rows, rejects):
        plan = out._jdf.queryExecution().optimizedPlan().toString().lower()
        assert not [x for x in plan.splitlines() if "filter" in x.split("(")[0] and "parse_json" in x.replace("parsejson", "parse_json")], plan


def test_topic_references_move_each_side_once(spark):
    """No row of a table is shuffled twice, and a topic in many cells has the same references."""
    rnd = random.Random(9)
    rows = [(1, i % 2, rnd.choice(["t", "t", "t", "u", None]), i, float(s := rnd.randint(0, 400)), float(s + rnd.randint(0, 40)),
             rnd.choice(["calm", "heated", None])) for i in range(120)]
    blocks = spark.createDataFrame(rows, "stream_id long, conv_id long, topic_id string, block_no long, t_start double, t_end double, sentiment string")
    clips = blocks.select("stream_id", "conv_id", "topic_id", F.col("block_no").alias("clip_id"), F.col("t_start").alias("start"), F.col("t_end").alias("end"))
    want = Counter()
    for _, c, t, i, lo, hi, _ in rows:
        for _, d, u, k, a, b, mood in rows:
            if c == d and t == u and t is not None and not (a >= lo - 5 and b <= hi + 5):
                hot = mood == "heated"
                want[c, t, i, k, ("escalation" if hot else "continuation") if a > lo else "prior_confrontation" if hot else "prior_mention"] += 1
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for cell in (4096, 7, 1):
            out = topics.topic_references(clips, blocks, cell_clips=cell)
            assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
            assert Counter((r.conv_id, r.topic_id, r.clip_id, r.block_no, r.relation) for r in out.collect()) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_turn_parts_move_words_once(spark):
    """Streams of one block need no row but the words themselves; a stream without a name and rows without a place are kept."""
    rows = [(s, i, f"w{i}", i * 1.0, i + .5, "AB"[i // 3 % 2]) for s in (1, 2, None) for i in range(12)]
    words = spark.createDataFrame(rows, WORD)
    out = talk.turn_parts(words, part_words=2)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    for size in (50_000, 3, 1):
        got = talk.turn_parts(words, part_words=2, block_rows=size).collect()
        assert Counter((p.stream_id, p.turn, p.part, p.speaker, p.start, p.end, p.text) for p in got) == Counter(
            (s, t, q, "AB"[t % 2], min(ps) * 1.0, max(ps) + .5, " ".join(f"w{i}" for i in ps))
            for s in (1, 2, None) for t in range(4) for q in range(2)
            if (ps := [i for i in range(3 * t, 3 * t + 3) if i // 2 - 3 * t // 2 == q]))
    lost = spark.createDataFrame([*rows, (1, None, "x", 99.0, 99.5, "A")], WORD)
    assert sum(p.word_count for p in talk.turn_parts(lost, part_words=2).collect()) == 37


def test_rows_that_are_asked_for(spark):
    """Every row that has an equal passes, few others do; keys of other types are not told apart by their hashes."""
    asked = spark.range(0, 40_000, 10).select((F.col("id") % 7).alias("stream_id"), F.col("id").cast("string").alias("key")).localCheckpoint()
    rows = spark.range(40_000).select((F.col("id") % 7).alias("stream_id"), F.col("id").cast("string").alias("key"), (F.col("id") * 2).alias("more"))
    got = cut_ops.asked_for(rows, asked, ["stream_id", "key"])
    assert got.columns == rows.columns
    kept = {r.more // 2 for r in got.collect()}
    assert kept >= set(range(0, 40_000, 10)) and len(kept) < 6_000
    assert cut_ops.asked_for(rows, asked, ["stream_id", "key"], keys=3999).count() == 40_000
    narrow = asked.withColumn("stream_id", F.col("stream_id").cast("int"))
    assert cut_ops.asked_for(rows, narrow, ["stream_id", "key"]).count() == 40_000
    assert cut_ops.asked_for(rows, asked.limit(0), ["stream_id", "key"]).count() == 0


@pytest.mark.parametrize("indexed", [False, True])
def test_letters_that_no_quote_has_are_left_out(spark, tmp_path, monkeypatch, indexed):
    """Words fall apart into many keys; those that are shuffled to meet the quotes are few."""
    rnd = random.Random(4)
    said = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(600)]
    words = spark.createDataFrame([(i % 2, i // 2, w, i // 2 * 0.3) for i, w in enumerate(said)], "stream_id long, pos long, text string, start double")
    own = [said[i::2] for i in (0, 1)]
    quotes = spark.createDataFrame([(0, 1, " ".join(own[0][5:11])[2:]), (0, 2, own[0][40][1:]), (1, 3, own[1][7][-2:] + " " + own[1][8][:2]),
                                    (1, 4, f"{own[1][9]} zzz {own[1][12]}"), (1, 5, own[0][3])], "stream_id long, quote_id long, quote string")
    met = []

    def watched(rows, *more, f=cut_ops.asked_for):
        out = f(rows, *more)
        met.append((rows.count(), out.count()))
        return out
    monkeypatch.setattr(quote_ops, "asked_for", watched)
    made = quote_ops.QuoteIndex.build(words, str(tmp_path / "index"), block_words=64, parts=4).anchor(quotes) if indexed else quote_ops.anchor_quotes(quotes, words)
    assert {r.quote_id: (r.how, r.pos) for r in made.collect()} == {1: ("exact", 6), 2: ("exact", 41), 3: ("exact", 8), 4: ("loose", 8), 5: (None, None)}
    assert len(met) >= 4 and max(n for n, _ in met) > 5_000 and all(k <= 0.2 * n for n, k in met if n > 500), met
