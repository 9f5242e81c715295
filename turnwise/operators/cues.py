"""Spoken cues: phrases that announce that somebody comes or goes."""

from __future__ import annotations

import re
import re._constants as kinds
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions.text import word_count
from turnwise.operators.windows import word_context
from turnwise.plans.asof import nearest
from turnwise.plans.blocks import around, by_position
from turnwise.plans.folds import fold_kept
from turnwise.schema import KEY

ARRIVALS = ("intro", "welcome")
DEPARTURES = ("exit", "farewell")
LEAD = r"(?i)^(?:\S*?[^\p{L}\p{N}\s])??"  # what may stand before a phrase in its first word
SPOT_WORDS = 500_000  # places of words, two numbers each, that may be broadcast


@dataclass(frozen=True)
class Pattern:
    """A phrase to look for: a regular expression, case ignored. `span` is the most words it can match; it is worked
    out from the expression where that is possible, see `reach`."""

    name: str
    cue_type: str
    regex: str
    base: float = 0.7
    span: int | None = None


def merge_patterns(known: list[Pattern], own: list[Pattern]) -> list[Pattern]:
    """Add a user's patterns; one with a known name replaces it."""
    return list({p.name: p for p in [*known, *own]}.values())


def anchored(regex: str) -> str:
    """The phrase must begin in the first token, after nothing or after punctuation, and must
    not go on with a letter or digit."""
    return LEAD + "(" + regex + r")(?:[^\p{L}\p{N}]|$)"


SPACE_SETS = (kinds.CATEGORY_SPACE, kinds.CATEGORY_NOT_WORD, kinds.CATEGORY_NOT_DIGIT)


def _in_set(members: list) -> bool:
    """Does a character set hold the blank?"""
    found = any(op is kinds.LITERAL and arg == ord(" ") or op is kinds.CATEGORY and arg in SPACE_SETS
                or op is kinds.RANGE and arg[0] <= ord(" ") <= arg[1] for op, arg in members)
    return not found if members[0][0] is kinds.NEGATE else found


def _blanks(tree, name: str) -> int:
    """The most blanks a parsed expression can match."""
    total = 0
    for op, arg in tree:
        if op in (kinds.MAX_REPEAT, kinds.MIN_REPEAT, kinds.POSSESSIVE_REPEAT):
            once, most = _blanks(arg[2], name), arg[1]
            if once and arg[2].getwidth()[1] == 1 and all(
                    o is kinds.LITERAL or o is kinds.IN and a == [(kinds.CATEGORY, kinds.CATEGORY_SPACE)] for o, a in arg[2]):
                most = 1  # nothing but white space, and words stand one blank apart
            if once and most == kinds.MAXREPEAT:
                raise ValueError(f"pattern {name!r} has no most number of words: give it a bound or a span")
            total += once * most if once else 0
        elif op is kinds.BRANCH:
            total += max(_blanks(b, name) for b in arg[1])
        elif op is kinds.SUBPATTERN:
            total += _blanks(arg[3], name)
        elif op is kinds.IN:
            total += _in_set(arg)
        elif op is kinds.LITERAL:
            total += arg == ord(" ")
        elif op in (kinds.ANY, kinds.NOT_LITERAL):
            total += 1
        elif op not in (kinds.AT, kinds.ASSERT, kinds.ASSERT_NOT):
            raise ValueError(f"pattern {name!r} needs a span")
    return total


def reach(pattern: Pattern) -> int:
    """The most words a match can have: one more than the blanks it can hold. Raises if the expression sets no bound
    (`.*` does not) or cannot be read, and the pattern names none."""
    if pattern.span is not None:
        return pattern.span
    try:
        tree = parser.parse(pattern.regex)
    except re.error as unread:
        raise ValueError(f"pattern {pattern.name!r} needs a span: {unread}") from unread
    return _blanks(tree, pattern.name) + 1


Heads = tuple[set[tuple[str, bool]], set[str]]


def _heads(tree) -> Heads:
    """How matches of a parsed expression begin, up to the first blank: pieces that end there, with whether the blank
    follows or anything may, and pieces that the expression ends with."""
    done: set[tuple[str, bool]] = set()
    heads = {""}
    for op, arg in tree:
        found, whole = _head(op, arg)
        done |= {(h + f, closed) for h in heads for f, closed in found}
        heads = {h + w for h in heads for w in whole}
        done |= {(h[:h.index(" ")], True) for h in heads if " " in h}
        heads = {h for h in heads if " " not in h}
        if len(heads) > 64:
            return done | {(h, False) for h in heads}, set()
    return done, heads


def _head(op, arg) -> Heads:
    anything: Heads = ({("", False)}, set())
    if op is kinds.LITERAL:
        return set(), {chr(arg)}
    if op in (kinds.AT, kinds.ASSERT, kinds.ASSERT_NOT):
        return set(), {""}
    if op is kinds.IN:
        if arg == [(kinds.CATEGORY, kinds.CATEGORY_SPACE)]:
            return set(), {" "}
        return (set(), {chr(c) for _, c in arg}) if all(o is kinds.LITERAL for o, _ in arg) else anything
    if op is kinds.SUBPATTERN:
        return _heads(arg[3])
    if op is kinds.BRANCH:
        every = [_heads(b) for b in arg[1]]
        return set().union(*(d for d, _ in every)), set().union(*(w for _, w in every))
    if op in (kinds.MAX_REPEAT, kinds.MIN_REPEAT, kinds.POSSESSIVE_REPEAT):
        least, most, inner = arg
        found, whole = _heads(inner)
        none = {""} if least == 0 else set()
        return (found, whole | none) if most == 1 else (found | {(w, False) for w in whole}, none)
    return anything


def first_pieces(pattern: Pattern) -> set[tuple[str, bool]] | None:
    """Literals of which one stands in the first word of every match, at its start there; with True the match leaves the word
    right after it. None if some match may begin with anything."""
    try:
        done, heads = _heads(parser.parse(pattern.regex))
    except re.error:  # not an expression that Python can read
        return None
    pieces = done | {(h, False) for h in heads}
    return None if any(not p for p, _ in pieces) else pieces


def match_cues(words: DataFrame, patterns: list[Pattern], *, block_rows: int = 50_000, spot_words: int = SPOT_WORDS) -> DataFrame:
    """Matches of every pattern in the running text of a stream, however long they are.

    A match starts at the word it begins in. Matches of one pattern do not overlap: one that starts before the kept one before
    it ends is dropped.

    A pattern that begins with literals is looked for only at words that hold one of them in the right place, which is seen from
    the word alone. If these are few, the words that follow them are fetched by a broadcast of their places, and no word
    is shuffled; else, and for patterns that may begin with anything, words are read in blocks with as many after
    them as the longest pattern can match.
    """
    words = words.select(*KEY, "pos", "text", "start", "end", "speaker")
    told = {p: first_pieces(p) for p in patterns}
    literal, open_ = [p for p in patterns if told[p]], [p for p in patterns if not told[p]]
    found = []
    if literal:
        span = max(map(reach, literal))
        pieces = sorted(set().union(*(told[p] for p in literal)))
        begins = F.col("text").rlike(LEAD + "(?:" + "|".join(re.escape(p) + ("$" if closed else "") for p, closed in pieces) + ")")
        spots = words.filter(begins)
        if spots.count() * span <= spot_words:
            found.append(_tested(_fetched(words, spots, span), literal))
        else:
            found.append(_tested(_followed(words, begins, span, block_rows), literal))
    if open_:
        found.append(_tested(_followed(words, F.lit(True), max(map(reach, open_)), block_rows), open_))
    hits = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    kept = fold_kept(hits, [*KEY, "pattern"], ["pos"], by_position("pos", block_rows // 10),
                     row={c: F.col(c) for c in ("pos", "start", "speaker", "cue_type", "base", "phrase", "last_pos", "end")},
                     absorbs=lambda k, c: c["pos"] <= k["last_pos"], merge=lambda k, c: {})
    return kept.withColumnRenamed("pos", "first_pos")


def _fetched(words: DataFrame, spots: DataFrame, span: int) -> DataFrame:
    """`spots` with `_near`, the word itself and the ones after it; their places are few enough for a broadcast."""
    places = spots.select(*KEY, F.col("pos").alias("_at"), F.explode(F.sequence(F.col("pos"), F.col("pos") + span - 1)).alias("pos"))
    item = F.struct("pos", "text", "end", "start", "speaker")
    return (words.join(F.broadcast(places), [*KEY, "pos"]).groupBy(*KEY, F.col("_at").alias("pos"))
            .agg(F.array_sort(F.collect_list(item)).alias("_near"))
            .withColumns({c: F.col("_near")[0][c] for c in ("start", "speaker")}))


def _followed(words: DataFrame, begins: Column, span: int, block_rows: int) -> DataFrame:
    """The words that `begins` picks with `_near`, read in blocks."""
    near = around(words, KEY, "pos", {"_near": F.struct("text", "end")}, after=span - 1, block_rows=block_rows)
    return near.filter(begins)


def _tested(rows: DataFrame, patterns: list[Pattern]) -> DataFrame:
    rows = rows.withColumn("_shingle", F.array_join(F.transform("_near", lambda w: w["text"]), " "))
    any_of = anchored("|".join(f"(?:{p.regex})" for p in patterns))
    found = F.array(*[F.struct(F.lit(p.name).alias("pattern"), F.lit(p.cue_type).alias("cue_type"), F.lit(p.base).alias("base"),
                               F.regexp_extract("_shingle", anchored(p.regex), 1).alias("phrase"))
                      for p in patterns])
    size = word_count(F.col("phrase"))
    return (rows.filter(F.col("_shingle").rlike(any_of))
            .withColumn("_c", F.explode(F.filter(found, lambda c: c["phrase"] != "")))
            .select(*KEY, "pos", "start", "speaker", "_c.*", "_near")
            .select(*KEY, "pos", "start", "speaker", "pattern", "cue_type", "base", "phrase", (F.col("pos") + size - 1).alias("last_pos"),
                    F.get("_near", size - 1)["end"].alias("end")))


def cue_confidence(phrase: Column, base: Column, lone: list[str]) -> Column:
    """Base value, more for three words and up, less for a lone greeting word."""
    raised = F.when(word_count(phrase) >= 3, F.least(F.lit(1.0), base + 0.1)).otherwise(base)
    return F.round(F.when(F.lower(F.trim(phrase)).isin(lone), raised * 0.7).otherwise(raised), 3)


def detect_cues(words: DataFrame, patterns: list[Pattern], *, lone: list[str], context: int = 30,
                min_confidence: float = 0.5, apart: float = 5.0) -> DataFrame:
    """Matches with confidence and context, weak ones left out, then near repeats removed."""
    cues = (match_cues(words, patterns)
            .withColumn("confidence", cue_confidence(F.col("phrase"), F.col("base"), lone))
            .withColumn("cue_id", F.concat_ws("/", F.col("pattern"), F.col("first_pos"))))
    cues = dedup_cues(cues.filter(F.col("confidence") >= min_confidence), apart=apart)
    return word_context(words, cues, spot_id="cue_id", size=context)


def dedup_cues(cues: DataFrame, *, apart: float = 5.0) -> DataFrame:
    """Compare each cue with the last kept one: of two of one type less than `apart` seconds
    from each other the surer stays (on a tie the first)."""
    fields = [c for c in cues.columns if c not in KEY]
    def surer(kept: Column, cur: Column) -> dict[str, Column]:
        better = cur["confidence"] > kept["confidence"]
        return {f: F.when(better, cur[f]).otherwise(kept[f]) for f in fields}
    return fold_kept(cues, KEY, ["start", "cue_id"], row={f: F.col(f) for f in fields},
                     absorbs=lambda k, c: (k["cue_type"] == c["cue_type"])
                     & (F.abs(c["start"] - k["start"]) < apart), merge=surer)


def validate_cues(cues: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers to 'is this cue real?': a false positive counts nothing, an unreadable answer
    (`readable` false) x 0.8, a failed call (no row) x 0.7.

    answers: stream_id, cue_id, readable, verdict, genuine, sure
    """
    rows = cues.join(answers, [*KEY, "cue_id"], "left")
    failed, unreadable = F.col("readable").isNull(), ~F.col("readable")
    false_alarm = F.upper(F.coalesce("verdict", "cue_type")) == "FALSE_POSITIVE"
    genuine = F.when(failed | unreadable, True).otherwise(
        F.coalesce("genuine", F.lit(True)) & ~false_alarm)
    return (rows.withColumn("is_genuine", genuine)
            .withColumn("final_confidence",
                        F.when(failed, F.col("confidence") * 0.7)
                        .when(unreadable, F.col("confidence") * 0.8)
                        .when(F.col("is_genuine"), F.coalesce("sure", "confidence"))
                        .otherwise(0.0))
            .drop("readable", "verdict", "genuine", "sure"))


def cue_counts(cues: DataFrame) -> DataFrame:
    return cues.groupBy(*KEY).agg(F.count_if(F.col("cue_type").isin(*ARRIVALS)).alias("arrivals"),
                                  F.count_if(F.col("cue_type").isin(*DEPARTURES)).alias("departures"))


def correlate(cues: DataFrame, events: DataFrame, *, window: float = 30.0) -> DataFrame:
    """Arrival cues with the voice event nearest in time, if one lies within the window.

    events: stream_id, v_pos, v_time, v_speaker
    """
    asked = cues.filter(F.col("cue_type").isin(*ARRIVALS)).select(*KEY, "cue_id", "cue_type", "start")
    near = nearest(asked, events, KEY, left_time=F.col("start"), right_time=F.col("v_time"),
                   left_id=["cue_id"], right_tie=["v_pos"], max_distance=window)
    return (near.filter(F.col("found").isNotNull())
            .select(*KEY, "cue_id", "cue_type", F.col("found.v_time").alias("voice_time"),
                    F.col("found.v_speaker").alias("voice_speaker"), "distance",
                    (1 - F.col("distance") / window).alias("strength")))
