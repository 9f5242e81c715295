"""Column functions, answers and scorers."""

import pandas as pd
from pyspark.sql import functions as F

from turnwise.catalog import query
from turnwise.catalog.bridges import SIGNALS, TURNS, signals, table, turns
from turnwise.catalog.bridges import chat_words
from turnwise.catalog.cues import LONE, PATTERNS, hits_sql
from turnwise.functions import clock, urls
from turnwise.functions.text import normalize, word_count
from turnwise.operators import cues
from turnwise.operators import ensemble
from turnwise.operators import responses as ops

R = F.round
HMS = "lpad((floor({0} / 3600)::BIGINT)::VARCHAR, 2, '0') || ':' || lpad((floor({0} / 60)::BIGINT % 60)::VARCHAR, 2, '0') || ':' || lpad((floor({0})::BIGINT % 60)::VARCHAR, 2, '0')"


@query("fn1_clock", f"""
WITH {SIGNALS}
SELECT pos, {HMS.format('start')} AS padded, CAST(floor(start / 3600)::BIGINT AS VARCHAR) || substr({HMS.format('start')}, 3) AS short FROM signals""")
def fn1(spark, sf):
    return signals(spark, sf).select("pos", clock.hms(F.col("start")).alias("padded"), clock.hms(F.col("start"), False).alias("short"))


@query("fn2_parse_clock", f"""
WITH {SIGNALS}
SELECT pos, round(floor(start) + (pos % 1000) / 1e3, 4) AS seconds FROM signals""")
def fn2(spark, sf):
    mark = F.when(F.col("pos") % 2 == 0, ".").otherwise(",")
    text = F.concat(clock.hms(F.col("start")), mark, F.lpad((F.col("pos") % 1000).cast("string"), 3, "0"))
    return signals(spark, sf).select("pos", R(clock.parse_hms(text), 4).alias("seconds"))


@query("fn3_find_stamp", f"""
WITH {SIGNALS}
SELECT pos, CASE WHEN pos % 3 > 0 THEN floor(start) END AS seconds FROM signals""")
def fn3(spark, sf):
    text = F.when(F.col("pos") % 3 == 0, "no time: 12:34").otherwise(F.concat(F.lit("at ["), clock.hms(F.col("start"), False), F.lit("] they say")))
    return signals(spark, sf).select("pos", clock.find_stamp(text).alias("seconds"))


@query("fn4_strict_stamp", f"""
WITH {SIGNALS}
SELECT pos, CASE pos % 4 WHEN 0 THEN floor(start) WHEN 1 THEN floor(start) % 3600 END AS seconds FROM signals""")
def fn4(spark, sf):
    t = clock.hms(F.col("start"))
    m = F.col("pos") % 4
    text = (F.when(m == 0, F.concat(F.lit(" ["), t, F.lit("]"))).when(m == 1, F.substring(t, 4, 5))
            .when(m == 2, F.concat(t, F.lit("x"))).otherwise(F.lit("7")))
    return signals(spark, sf).select("pos", clock.strict_stamp(text).alias("seconds"))


@query("fn5_word_count", r"""
SELECT doc_id, CAST(len(regexp_extract_all(text, '\S+')) AS INTEGER) AS words FROM documents""")
def fn5(spark, sf):
    return table(spark, sf, "documents").select("doc_id", word_count(F.col("text")).alias("words"))


@query("fn6_normalize", r"""
SELECT doc_id, trim(regexp_replace(lower(text), '[ \t\n\r\f\x0b]+', ' ', 'g')) AS text FROM documents""")
def fn6(spark, sf):
    return table(spark, sf, "documents").select("doc_id", normalize(F.col("text")).alias("text"))


ANSWERS = SIGNALS + """,
ans AS (SELECT *, pos % 12 AS m FROM signals)"""


def _answers(spark, sf):
    """Answers of twelve forms: objects and lists with text and fences around them, and what holds no object."""
    one = F.format_string('{"title": "a%d", "score": %d, "more": [1, {"x": 2}]}', "pos", "user_id")
    two = F.concat(F.lit("["), one, F.lit(', {"title": "b"}]'))
    m = F.col("pos") % 12
    text = (F.when(m == 0, F.concat(F.lit("\n "), one)).when(m == 1, two)
            .when(m == 2, F.concat(F.lit("Here it is:\n```json\n"), one, F.lit("\n```\nbye")))
            .when(m == 3, F.concat(F.lit("I think "), one, F.lit(" is right.")))
            .when(m == 4, F.concat(F.lit("```\nnot json\n```\n```json\n"), two, F.lit("\n```")))
            .when(m == 5, F.concat(F.lit("so ["), one, F.lit("] then"))).when(m == 6, "no {json here]")
            .when(m == 7, "5").when(m == 8, '"x"').when(m == 9, "null").when(m == 10, "[1,2]").otherwise("[]"))
    return signals(spark, sf).select("pos", text.alias("answer"))


@query("fn10_parse_responses", f"""
WITH {ANSWERS}
SELECT pos, 0 AS item_no, 'a' || pos AS title, CAST(user_id AS DOUBLE) AS score FROM ans WHERE m < 6
UNION ALL SELECT pos, 1, 'b', NULL FROM ans WHERE m IN (1, 4)""")
def fn10(spark, sf):
    return ops.parse_responses(_answers(spark, sf), "title:string,score:double")[0].select("pos", "item_no", "title", "score")


@query("fn10_rejected_responses", f"""
WITH {ANSWERS}
SELECT pos, CASE m WHEN 6 THEN 'no {{json here]' WHEN 7 THEN '5' WHEN 8 THEN '"x"' WHEN 9 THEN 'null' WHEN 10 THEN '[1,2]' ELSE '[]' END AS answer,
  CASE WHEN m = 6 THEN 'no JSON' ELSE 'no object' END AS reason FROM ans WHERE m >= 6""")
def fn10_rejects(spark, sf):
    return ops.parse_responses(_answers(spark, sf), "title:string,score:double")[1].select("pos", "answer", "reason")


LINK = """
link AS (SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'https://www.youtube.com/watch?v=' || substr(md5(url), 1, 11)
  WHEN 1 THEN 'youtu.be/' || substr(md5(url), 1, 11) WHEN 2 THEN 'https://youtube.com/shorts/' || substr(md5(url), 1, 11) || '?x=1'
  WHEN 3 THEN 'https://drive.google.com/file/d/' || md5(url) || '/view' WHEN 4 THEN 'https://drive.google.com/open?id=' || md5(url)
  ELSE url END AS link, md5(url) AS h FROM pages)"""


@query("fn11_link_ids", f"""
WITH {LINK}
SELECT page_id, CASE WHEN page_id % 7 < 3 THEN 'video' WHEN page_id % 7 < 5 THEN 'drive' ELSE 'other' END AS class,
  CASE WHEN page_id % 7 < 3 THEN substr(h, 1, 11) END AS video, CASE WHEN page_id % 7 IN (3, 4) THEN h END AS file, page_id % 7 < 3 AS playable FROM link""")
def fn11(spark, sf):
    h = F.md5("url")
    m = F.col("page_id") % 7
    link = (F.when(m == 0, F.concat(F.lit("https://www.youtube.com/watch?v="), F.substring(h, 1, 11)))
            .when(m == 1, F.concat(F.lit("youtu.be/"), F.substring(h, 1, 11)))
            .when(m == 2, F.concat(F.lit("https://youtube.com/shorts/"), F.substring(h, 1, 11), F.lit("?x=1")))
            .when(m == 3, F.concat(F.lit("https://drive.google.com/file/d/"), h, F.lit("/view")))
            .when(m == 4, F.concat(F.lit("https://drive.google.com/open?id="), h)).otherwise(F.col("url")))
    p = table(spark, sf, "pages").select("page_id", link.alias("link"))
    return p.select("page_id", urls.link_class(F.col("link")).alias("class"), urls.video_id(F.col("link")).alias("video"),
                    urls.file_id(F.col("link")).alias("file"), urls.is_video_link(F.col("link")).alias("playable"))


@query("udf1_vote_by_key", """
WITH v AS (SELECT user_id, event_id, upper(substr(event_type, 1, 1)) AS k FROM events),
n AS (SELECT user_id, k, count(*) AS n, min(event_id) AS f FROM v GROUP BY ALL)
SELECT user_id, k AS winner FROM n QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) = 1""")
def udf1(spark, sf):
    """The key function of a vote is a column expression."""
    votes = table(spark, sf, "events").withColumn("key", F.upper(F.substring("event_type", 1, 1)))
    return ensemble.majority(votes, keys=["user_id"], value="key", run="event_id").select("user_id", "winner")


OWN = [cues.Pattern("of_the", "exit", r"of\s+(?:the|that)", 0.6), cues.Pattern("with_or", "welcome", r"with|avec", 0.75)]


@query("udf2_own_patterns", f"""
WITH RECURSIVE {hits_sql(cues.merge_patterns(PATTERNS, OWN))}
SELECT stream_id, pattern, cue_type, first_pos, phrase, confidence FROM hits""")
def udf2(spark, sf):
    """A user's pattern replaces one of the known and adds another."""
    hits = cues.match_cues(chat_words(spark, sf), cues.merge_patterns(PATTERNS, OWN))
    return hits.withColumn("confidence", cues.cue_confidence(F.col("phrase"), F.col("base"), LONE)).select(
        "stream_id", "pattern", "cue_type", "first_pos", "phrase", "confidence")


def _letters(pdf: pd.DataFrame) -> pd.DataFrame:
    """A stand-in for a user's scorer: letters per word."""
    words = pdf["text"].str.count(r"[^ \t\n\r\f\v]+")
    return pd.DataFrame({"stream_id": pdf["stream_id"], "idx": pdf["idx"], "score": pdf["text"].str.count(r"[a-z]") / words.clip(lower=1)})


@query("udf3_score_windows", rf"""
WITH {TURNS}
SELECT stream_id, idx, round(len(regexp_extract_all(text, '[a-z]')) / greatest(word_count, 1), 6) AS score FROM turns""")
def udf3(spark, sf):
    out = ops.score_windows(turns(spark, sf).select("stream_id", "idx", "text"), _letters, "stream_id long, idx long, score double")
    return out.withColumn("score", R("score", 6))
