"""Readers, writers and answer parsing on hand-made files."""

import json

from pyspark.sql import functions as F

from turnwise.functions import clock, urls
from turnwise.operators import responses
from turnwise.sinks import documents as sinks
from turnwise.sources import jobs, stages, transcripts

TURN = "stream_id long, idx long, speaker string, start double, end double, text string, word_count int"


def test_read_words_takes_the_first_layout(spark, tmp_path):
    word = {"word": "hi", "punctuated_word": "Hi.", "start": 1, "end": 1.5, "speaker": 2}
    docs = [{"stream_id": 1, "words": [word, {"word": "yo"}], "metadata": {"duration": 9}},
            {"stream_id": 2, "results": {"channels": [{"alternatives": [{"words": [word]}, {"words": [word, word]}]}, {"alternatives": []}]}},
            {"stream_id": 3, "utterances": [{"speaker": "S1", "words": [word]}, {"speaker": "S2"}, {"words": [word]}]},
            {"stream_id": 4}]
    for i, d in enumerate(docs):
        (tmp_path / f"{i}.json").write_text(json.dumps(d, indent=1))
    raw = transcripts.read_words(spark, str(tmp_path), multi_line=True)
    got = [tuple(r) for r in transcripts.normalize_words(raw).orderBy("stream_id", "pos").collect()]
    assert got == [(1, 0, "Hi.", 1.0, 1.5, 0.0, "2"), (1, 1, "yo", 0.0, 0.0, 0.0, None), (2, 0, "Hi.", 1.0, 1.5, 0.0, "2"),
                   (3, 0, "Hi.", 1.0, 1.5, 0.0, "S1"), (3, 1, "Hi.", 1.0, 1.5, 0.0, "0")]
    assert raw.filter("stream_id = 1").first().meta_duration == 9


def test_read_segments_under_other_keys(spark, tmp_path):
    doc = {"stream_id": 1, "segments": [{"label": "B", "startTime": 5, "endTime": 6, "score": 0.5},
                                        {"speaker": "A", "start": 1, "end": 2, "confidence": 0.9}, {"begin": 7, "stop": 8}]}
    (tmp_path / "s.json").write_text(json.dumps(doc))
    got = [(r.seg_pos, r.seg_speaker, r.seg_start, r.seg_end, r.confidence)
           for r in transcripts.read_segments(spark, str(tmp_path)).orderBy("seg_pos").collect()]
    assert got == [(0, "A", 1.0, 2.0, 0.9), (1, "B", 5.0, 6.0, 0.5), (2, "UNKNOWN", 7.0, 8.0, 1.0)]


def test_text_turns_and_rejects(spark, tmp_path):
    (tmp_path / "talk.txt").write_text(
        "# notes\n[0:00:05] host: what is it: a test?\n\n[0:01:00]  guest :  yes \n[00:10] guest: short\n[nonsense] guest: no\n[0:00:01 guest no\n")
    turns, rejects = transcripts.read_text_turns(spark, str(tmp_path))
    got = [(r.idx, r.speaker, r.start, round(r.end, 3), r.text, r.word_count) for r in turns.orderBy("idx").collect()]
    assert got == [(0, "host", 5.0, 6.5, "what is it: a test?", 5), (1, "guest", 60.0, 60.3, "yes", 1), (2, "guest", 10.0, 10.3, "short", 1)]
    assert sorted(r.line for r in rejects.collect()) == ["[0:00:01 guest no", "[nonsense] guest: no"]


def test_transcript_round_trip_keeps_the_order(spark, tmp_path):
    rows = [(s, i, "host" if i % 2 else "guest", float(i * 7), 0.0, f"word {i}\nnext", 3) for s in (5, 12) for i in range(200)]
    df = spark.createDataFrame(rows, TURN)
    sinks.write_transcript(df, str(tmp_path / "t"))
    got = transcripts.read_text_turns(spark, str(tmp_path / "t"))[0].orderBy("stream_id", "idx").collect()
    assert [(r.stream_id, r.idx, r.speaker, r.start, r.text) for r in got] == [
        (s, i, who, at, f"word {i} next") for s, i, who, at, *_ in rows]


def test_documents_in_parts(spark):
    rows = [(1, i, "host" if i % 2 else "guest", float(i), i + .5, "a b", 2) for i in range(7)]
    got = sinks.documents(spark.createDataFrame(rows, TURN), part_turns=3).orderBy("part").collect()
    assert [[u.idx for u in r.utterances] for r in got] == [[0, 1, 2], [3, 4, 5], [6]]
    s = got[0].summary
    assert (s.total_utterances, s.total_words, s.duration_seconds, s.speakers["host"].total_words) == (7, 14, 6.5, 6)
    assert got[1].summary is None


def test_profile(spark, tmp_path):
    path = tmp_path / "p.json"
    path.write_text(json.dumps({"mine": {"duration": {"min_seconds": 20, "max_seconds": 200, "sweet_spot_min": 50, "sweet_spot_max": 90},
                                         "scoring_weights": {"b": {"weight": 3, "dealbreaker_threshold": 1}, "a": {"weight": 1, "dealbreaker_threshold": 7}}}}))
    criteria, lengths = transcripts.read_profile(spark, str(path), "mine")
    assert [(c.name, c.weight, c.min_score) for c in criteria] == [("b", 3, 1), ("a", 1, 7)]
    assert (lengths.shortest, lengths.longest, lengths.best_from, lengths.best_to) == (20, 200, 50, 90)


def test_stage_round_trip(spark, tmp_path):
    df = spark.range(5).withColumn("x", F.array("id"))
    stages.save_stage(df, str(tmp_path), "s")
    assert sorted(map(tuple, stages.load_stage(spark, str(tmp_path), "s").collect())) == sorted(map(tuple, df.collect()))


def test_pending_jobs_header_variants(spark):
    a = spark.createDataFrame([(2, " u1 ", "", " what ", "5"), (3, "u2", "done", "", "5"), (4, " ", None, "", "x"), (5, "u3", None, " ", "x"), (6, "u4", " ", None, "0")],
                              ["row", "VIDEO URL", " Status", "Query", "Max Clips"])
    b = spark.createDataFrame([(2, "x")], ["row", "note"])
    got = sorted(map(tuple, jobs.all_pending({"a": (a, "row"), "b": (b, "row")}).collect()))
    assert got == [("a", 2, "u1", "what", 5), ("a", 5, "u3", None, 10), ("a", 6, "u4", None, 10)]


def test_answers(spark):
    texts = ['{"a": 1}', ' [ {"a": 1}, {"a": 2} ] ', 'see\n```json\n{"a": 1}\n```', '```\nno\n```\n```\n{"a": 3}\n```', 'so {"a": 1} it is',
             'list [{"a": 1}] here', 'two [{"a": 1}, {"a": 2}] here', "nothing", "{broken", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, answer string")
    rows, rejects = responses.parse_responses(df, "a:long")
    got = {}
    for r in rows.orderBy("id", "item_no").collect():
        got.setdefault(r.id, []).append(r.a)
    assert got == {0: [1], 1: [1, 2], 2: [1], 3: [3], 4: [1], 5: [1], 6: [1, 2]}
    assert sorted(r.id for r in rejects.collect()) == [7, 8, 9]


def test_clock(spark):
    df = spark.createDataFrame([("[1:02:03]",), ("02:03",), ("1:02:03,5",), ("x 1:02:03 y",), ("",), ("1:2:3:4",)], "t string")
    got = [tuple(r) for r in df.select(clock.strict_stamp(F.col("t")), clock.parse_hms(F.col("t")), clock.find_stamp(F.col("t"))).collect()]
    assert got == [(3723.0, None, 3723.0), (123.0, None, None), (None, 3723.5, 3723.0), (None, None, 3723.0), (None, None, None), (None, None, 3723.0)]
    secs = spark.createDataFrame([(0.0,), (59.99,), (3599.5,), (36000.0,)], "s double")
    assert [tuple(r) for r in secs.select(clock.hms(F.col("s")), clock.hms(F.col("s"), False)).collect()] == [
        ("00:00:00", "0:00:00"), ("00:00:59", "0:00:59"), ("00:59:59", "0:59:59"), ("10:00:00", "10:00:00")]


def test_links(spark):
    links = ["https://www.youtube.com/watch?v=abcdefghijk&t=1", "youtu.be/abcdefghijk", "https://youtube.com/live/abcdefghijk", "https://example.com/v=short",
             "https://drive.google.com/drive/folders/F_1-x?usp=1"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(links)], "i int, u string").orderBy("i")
    got = [tuple(r) for r in df.select(urls.video_id(F.col("u")), urls.file_id(F.col("u")), urls.link_class(F.col("u")), urls.is_video_link(F.col("u"))).collect()]
    assert got == [("abcdefghijk", None, "video", True), ("abcdefghijk", None, "video", True), ("abcdefghijk", None, "video", True),
                   (None, None, "other", False), (None, "F_1-x", "drive", False)]


def test_import_stage_from_json_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"video": "v1",\n "cues": [{"at": 1.5, "kind": "intro"}, {"at": 2, "more": 1}]}')
    (tmp_path / "b.json").write_text('{"video": "v2", "cues": []}')
    (tmp_path / "c.json").write_text('not json')
    rows, bad = stages.import_stage(spark, str(tmp_path), "cues", "at double, kind string", document="video string")
    assert sorted(tuple(r) for r in rows.select("video", "item_no", "at", "kind").collect()) == [("v1", 0, 1.5, "intro"), ("v1", 1, 2.0, None)]
    assert [r.file.rsplit("/", 1)[1] for r in bad.collect()] == ["c.json"]


def test_lines_of_many_files_keep_their_order(spark, tmp_path):
    for name, minute in (("part-99999.txt", 1), ("part-100000.txt", 2), ("part-7.txt", 0)):
        (tmp_path / name).write_text(f"9\t[0:0{minute}:00] A: turn {minute}\n")
    turns, bad = transcripts.read_text_turns(spark, str(tmp_path))
    assert [r.text for r in turns.orderBy("idx").collect()] == ["turn 0", "turn 1", "turn 2"] and bad.count() == 0


def test_distinct_values(spark):
    from turnwise.operators.selection import distinct_values
    rows = spark.range(30_000).selectExpr("id % 2 AS stream_id", "id % 5000 AS v").unionByName(
        spark.createDataFrame([(0, None), (7, None)], "stream_id long, v long"))
    assert {r.stream_id: r.n for r in distinct_values(rows, rows.v).collect()} == {0: 2500, 1: 2500, 7: 0}
    about = {r.stream_id: r.n for r in distinct_values(rows, rows.v, approximate=0.02).collect()}
    assert abs(about[0] - 2500) < 250 and about[7] == 0


def _stage_rows(spark):
    """Two hours of four streams; stream 1 has two thirds of all rows; a few rows have no time."""
    return spark.range(6000).selectExpr("if(id % 3 = 0, id % 4, 1L) stream_id", "id idx", "if(id % 1000 = 7, null, id * 1.2d) start", "id * 1.2d + 1 end", "concat('t', id) text")


def test_stage_layout_prunes_slices(spark, tmp_path):
    layout = stages.Layout(buckets=4, era_seconds=600.0, block_seconds=60.0)
    rows = _stage_rows(spark)
    path = stages.save_stage(rows, str(tmp_path), "turns", layout=layout)
    stage = stages.load_stage(spark, str(tmp_path), "turns", layout=True)
    assert sorted(map(tuple, stage.select(*rows.columns).collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    every = len(stage.inputFiles())
    plain = rows.select("stream_id", "idx", "start", "end").collect()
    for low, high, options, keep in (
            (1000, 1300, {}, lambda r: 1000 <= r.start <= 1300), (1200, 1800, {"half_open": True}, lambda r: 1200 <= r.start < 1800),
            (1000, 1300, {"slack": 2.0}, lambda r: 1000 <= r.start <= 1300 and r.end <= 1302), (0, 7200, {"streams": [2]}, lambda r: r.stream_id == 2)):
        part = stages.slice_stage(stage, layout, low, high, **options)
        assert sorted(r.idx for r in part.collect()) == sorted(r.idx for r in plain if r.start is not None and keep(r))
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(era" in plan and "PushedFilters: [IsNotNull(start)" in plan
        if high - low < 1000:
            assert 0 < len(part.inputFiles()) < every / 2
    # another session knows the layout from what lies beside the files
    spark.sql(f"DROP TABLE {stages._table(path)}")
    assert stages.stage_layout(spark, str(tmp_path), "turns")[0] == layout
    again = stages.load_stage(spark, str(tmp_path), "turns", layout=True)
    assert again.count() == 6000 and stages.slice_stage(again, layout, 1000, 1300).count() == sum(r.start is not None and 1000 <= r.start <= 1300 for r in plain)


def test_stages_of_one_layout_join_where_they_lie(spark, tmp_path):
    layout = stages.Layout(buckets=4, by=("idx",), era_seconds=600.0)
    rows = _stage_rows(spark)
    stages.save_stage(rows, str(tmp_path), "turns", layout=layout)
    stages.save_stage(rows.selectExpr("stream_id", "idx", "start", "length(text) chars"), str(tmp_path), "figures", layout=layout)
    left, right = (stages.load_stage(spark, str(tmp_path), n, layout=True) for n in ("turns", "figures"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = stages.join_stages(left, right.drop("start"), layout)
        got = joined.select("idx", "text", "chars").collect()
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert sorted(r.idx for r in got) == list(range(6000)) and all(r.chars == len(r.text) for r in got)
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    # the crowded stream lies in all buckets
    from pyspark.sql import functions as F
    shares = [r["count"] for r in left.filter("stream_id = 1").groupBy(F.regexp_extract(F.input_file_name(), r"_(\d{5})\.c", 1)).count().collect()]
    assert len(shares) == 4 and max(shares) < 2 * min(shares)


def test_a_stage_is_replaced(spark, tmp_path):
    layout = stages.Layout(buckets=2)
    for n in (500, 40):
        stages.save_stage(_stage_rows(spark).limit(n), str(tmp_path), "turns", layout=layout)
        assert stages.load_stage(spark, str(tmp_path), "turns", layout=True).count() == n
    assert stages.load_stage(spark, str(tmp_path), "turns").count() == 40


def test_job_states(spark):
    log = spark.createDataFrame([("a", 1, "u", 0), ("a", 1, "u", 2), ("a", 2, "v", 0), ("a", 3, "w", 2), ("b", 1, "x", 1), ("b", 2, "y", 1), ("b", 3, "z", 0), ("b", 3, "z", 1)],
                                "source string, row_no long, url string, seq long")
    ends = spark.createDataFrame([("a", 1, 0, False, None, "e"), ("a", 1, 2, True, "l", None), ("a", 2, 0, False, None, "x" * 900), ("b", 1, 1, None, None, None),
                                  ("b", 1, 1, True, "m", None), ("c", 9, 0, True, "?", None)], "source string, row_no long, seq long, ok boolean, link string, error string")
    got = jobs.job_states(log, ends)
    assert sorted((r.source, r.row_no, r.attempts, r.status, r.link, len(r.error or "")) for r in got.collect()) == [
        ("a", 1, 2, "complete", "l", 0), ("a", 2, 1, "failed", None, 500), ("a", 3, 1, "processing", None, 0),
        ("b", 1, 1, "complete", "m", 0), ("b", 2, 1, "lost", None, 0), ("b", 3, 2, "lost", None, 0)]
    assert sorted(tuple(r) for r in jobs.jobs_to_retry(got, most=2).collect()) == [("b", 2, "y")]
    assert jobs.job_states(log.limit(0), ends).count() == 0


def test_job_states_cut_errors_before_they_are_grouped(spark):
    log = spark.createDataFrame([("s", 1, "u", 1), ("s", 2, "v", 2)], "source string, row_no long, url string, seq long")
    ends = spark.createDataFrame([("s", 1, 1, False, "a", "x" * 30), ("s", 1, 1, False, "b", "y" * 30), ("s", 2, 2, True, "l", "z"), ("s", 2, 2, False, "m", "w")],
                                 "source string, row_no long, seq long, ok boolean, link string, error string")
    out = jobs.job_states(log, ends, error_chars=7)
    assert {(r.row_no, r.status, r.link, r.error) for r in out.collect()} == {(1, "failed", None, "y" * 7), (2, "complete", "l", None)}
    grouped = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate [source" in x and "error" in x]
    assert grouped and all("substring" in x for x in grouped)
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
