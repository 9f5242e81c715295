"""Live jobs fed with shuffled micro-batches give what the batch operators give."""

import random

from pyspark.sql import functions as F

from turnwise.operators import cues as cue_ops
from turnwise.operators import turns as talk
from turnwise.streaming import live
from turnwise.streaming.ordered import untimed

END = 10_000.0


def _replay(spark, tmp_path, rows, schema, make):
    """Each list of rows is one micro-batch; a last row far ahead lets the watermark pass all others."""
    out, state, folder = (str(tmp_path / d) for d in ("out", "state", "in"))
    result = None
    for batch in rows:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.timestamp_seconds("at"))
        result = make(stream)
        q = (result.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
             .trigger(availableNow=True).start())
        q.awaitTermination()
    return spark.read.schema(result.schema).parquet(out)


def _batches(rows, rnd, parts, jitter, last):
    """Rows in batches by time, each moved by up to `jitter` seconds, so that some come late."""
    rows = sorted(rows, key=lambda r: r[1] + rnd.random() * jitter)
    size = len(rows) // parts + 1
    return [rows[i:i + size] for i in range(0, len(rows), size)] + [[last]]


def test_live_turns(spark, tmp_path):
    rnd = random.Random(1)
    rows, t = [], 0.0
    for i in range(240):
        t = round(t + rnd.choice([.5, .5, 1.0, 4.0]), 1)
        rows.append((i % 2 + 1, t, i, t + .4, rnd.choice("AAB"), f"w{i}"))
    schema = "stream_id long, at double, pos long, until double, speaker string, text string"
    got = _replay(spark, tmp_path, _batches(rows, rnd, 4, 8.0, (9, END, 0, END, "Z", "end")), schema,
                  lambda s: live.live_turns(s, delay="10 seconds"))
    words = spark.createDataFrame(rows, schema).selectExpr("stream_id", "pos", "text", "at as start", "until as end", "speaker")
    want = talk.build_turns(words)
    cols = ["stream_id", "speaker", "start", "end", "word_count", "text"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))


def test_live_cues(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(i % 2 + 1, float(rnd.randint(1, 400)), f"c{i:03d}", rnd.choice(["intro", "exit"]), rnd.choice([.5, .7, .9])) for i in range(160)]
    schema = "stream_id long, at double, cue_id string, cue_type string, confidence double"
    got = _replay(spark, tmp_path, _batches(rows, rnd, 3, 8.0, (9, END, "z", "intro", .1)), schema,
                  lambda s: live.live_cues(s, delay="10 seconds"))
    batch = spark.createDataFrame(rows, schema).withColumnRenamed("at", "start")
    want = cue_ops.dedup_cues(batch)
    assert sorted((r.stream_id, r.cue_id) for r in got.collect()) == sorted((r.stream_id, r.cue_id) for r in want.collect())


def test_first_appearances(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(i % 2 + 1, i + 1.0, rnd.choice("ABCDEF")) for i in range(100)]
    got = _replay(spark, tmp_path, _batches(rows, rnd, 3, 8.0, (9, END, "Z")), "stream_id long, at double, speaker string",
                  lambda s: live.first_appearances(s, life=86_400.0, delay="10 seconds"))
    want = {}
    for s, at, who in rows:
        want[(s, who)] = min(at, want.get((s, who), at))
    assert {(r.stream_id, r.speaker): r.at for r in got.collect()} == want
    assert got.count() == len(want)


def test_job_intake_replaces_a_repeated_batch(spark, tmp_path):
    folder, log, state = (str(tmp_path / d) for d in ("in", "log", "state"))
    schema = "source string, row_no long, url string, status string"
    spark.createDataFrame([("a", 1, "u", ""), ("a", 1, "u", ""), ("a", 2, " ", ""), ("b", 1, "u", "done")], schema).write.parquet(folder)
    for _ in range(2):
        live.record_jobs(spark.readStream.schema(schema).parquet(folder), log, state).awaitTermination()
    # The same batch once more, as after a failure before its commit.
    live.record_jobs(spark.readStream.schema(schema).parquet(folder), log, state + "2").awaitTermination()
    got = live.latest_status(spark.read.parquet(log)).collect()
    assert [(r.source, r.row_no, r.status, r.entries) for r in got] == [("a", 1, "processing", 1)]


def test_streams_read_a_file_and_a_folder_alike(spark, tmp_path):
    from turnwise.catalog.streams import str2_tumbling
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    one, many = tmp_path / "one", tmp_path / "many"
    events.repartition(3).write.parquet(str(many / "events.parquet"))
    one.mkdir()
    (one / "events.parquet").symlink_to("/root/testdata/sf0.001/events.parquet")
    a, b = (sorted(map(tuple, str2_tumbling(spark, str(d)).collect())) for d in (one, many))
    assert a and a == b


WORDS = "stream_id long, at double, pos long, until double, speaker string, text string"


def test_rows_without_time_speaker_or_text(spark, tmp_path):
    """They do not end the query: no time is turned away, no speaker is `unknown`, no text adds no word to the text."""
    rows = [[(1, 1.0, 0, 1.2, None, "a"), (1, None, 1, 1.4, "B", "lost"), (1, 1.5, None, None, None, None), (None, 2.0, 0, 2.2, "C", "c")],
            [(1, 1.5, 2, 1.7, None, "b"), (1, 1.5, 2, 1.7, "A", "x"), (1, float("nan"), 3, 1.0, "B", "lost")], [(9, END, 0, END, "Z", "end")]]
    got = _replay(spark, tmp_path, rows, WORDS, lambda s: live.live_turns(s, delay="10 seconds"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [(1, "unknown", 1.0, 1.2, 1, "a"), (1, "A", 1.5, 1.7, 1, "x"), (1, "unknown", 1.5, 1.6, 2, "b"), (None, "C", 2.0, 2.2, 1, "c")], key=str)
    table = spark.createDataFrame(sum(rows, []), WORDS).withColumn("ts", F.timestamp_seconds("at"))
    assert [r.reason for r in untimed(table).collect()] == ["no time"] * 2


def test_a_long_turn_is_kept_in_pieces(spark, tmp_path):
    """One turn over three batches: its words are in a list state, each once; the open record holds four values."""
    batches = [[(1, float(t), t, t + .5, "A", f"w{t}") for t in range(n, n + 20)] for n in (1, 21, 41)]
    folder, state = str(tmp_path / "in"), str(tmp_path / "state")
    for batch in batches:
        spark.createDataFrame(batch, WORDS).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(WORDS).parquet(folder).withColumn("ts", F.timestamp_seconds("at"))
        q = (live.live_turns(stream, delay="5 seconds").writeStream.format("noop").option("checkpointLocation", state).trigger(availableNow=True).start())
        q.awaitTermination()
    kept = {name: spark.read.format("statestore").option("stateVarName", name).load(state).collect() for name in ("waiting", "pieces", "record")}
    assert [tuple(r.value) for r in kept["record"]] == [("A", 1.0, 55.5, 55)]
    assert sorted(r.list_element.text for r in kept["pieces"]) == sorted(f"w{t}" for t in range(1, 56))
    assert len(kept["waiting"]) <= 2 * 5 + 20


def test_a_first_time_is_forgotten_after_its_life(spark, tmp_path):
    rows = [[(1, 10.0, "A"), (1, 12.0, "A")], [(1, 100.0, "B")], [(1, 130.0, "A")], [(1, 400.0, "A")], [(9, END, "Z")]]
    got = _replay(spark, tmp_path, rows, "stream_id long, at double, speaker string", lambda s: live.first_appearances(s, life=200.0, delay="10 seconds"))
    assert sorted((r.speaker, r.at) for r in got.collect()) == [("A", 10.0), ("A", 400.0), ("B", 100.0)]
