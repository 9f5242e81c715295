"""Language of texts: text likelihood, declared language, address suffix and host priors put together by Bayes."""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.llm.tables import columns, small_batches, unit
from turnwise.plans.cut import cut

LANGUAGES = ("en", "de", "fr", "es")
NONE = "und"
BUCKETS = 1 << 14
BATCH = 4 << 20
#: Address suffixes that speak for a language; others say nothing by themselves but have a prior of their own.
SUFFIXES = {"uk": "en", "us": "en", "au": "en", "de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es"}
#: Language codes that declare no other language than the known ones.
NO_OTHER = ("", "und", "mul", "mis", "zxx", "eng", "deu", "ger", "fra", "fre", "spa")
_LETTERS = re.compile(r"[^\W\d_]+")


def trigrams(text: str) -> np.ndarray:
    """Buckets of the byte trigrams of the text's words in lower case, each word between blanks."""
    data = np.frombuffer((" " + " ".join(_LETTERS.findall(text.lower())) + " ").encode(), np.uint8).astype(np.uint32)
    if len(data) < 3:
        return np.empty(0, np.int64)
    mixed = (data[:-2] << np.uint32(16) | data[1:-1] << np.uint32(8) | data[2:]) * np.uint32(0x9E3779B1)
    return (mixed >> np.uint32(32 - 14)).astype(np.int64)


def _chosen(labelled: DataFrame, languages: tuple[str, ...], rows: int | None, turn: int = 0) -> DataFrame:
    """All texts of `labelled` in a known language; with `rows` about so many of each, others for every turn, all of a language with too few."""
    if rows is None:
        return columns(labelled, text="string", lang="string").filter(F.col("text").isNotNull() & F.col("lang").isin(*languages))
    own = columns(labelled, doc_id="bigint", text="string", lang="string").filter(
        F.col("text").isNotNull() & F.col("lang").isin(*languages))
    numbers = {r.lang: r["count"] for r in own.groupBy("lang").count().collect()}
    low, high = F.lit(0.0), F.lit(0.0)
    for lang, n in sorted(numbers.items()):
        first = turn * rows / n if (turn + 1) * rows <= n else 0.0
        low = F.when(F.col("lang") == lang, first).otherwise(low)
        high = F.when(F.col("lang") == lang, first + rows / n if (turn + 1) * rows <= n or turn == 0 else 1.0).otherwise(high)
    draw = unit(F.xxhash64("doc_id"))
    return own.filter((draw >= low) & (draw < high))


def train(labelled: DataFrame, languages: tuple[str, ...] = LANGUAGES, rows: int | None = None) -> np.ndarray:
    """Log likelihood of every trigram bucket in each language, with add-one smoothing.

    `labelled` is (doc_id, text, lang). All its texts are counted in full where they lie; only a caller that gives `rows` has
    about so many texts of each language counted, chosen by a hash of doc_id. Buckets x languages sums come to the
    driver, however large the table is. A language without rows gets even likelihoods.
    """
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(languages), BUCKETS), np.int64)
        for frame in small_batches(frames, "text", BATCH):
            for text, lang in zip(frame.text, frame.lang):
                found = trigrams(text)
                if len(found) < BUCKETS:
                    np.add.at(total[languages.index(lang)], found, 1)
                else:
                    total[languages.index(lang)] += np.bincount(found, minlength=BUCKETS)
        at = np.nonzero(total)
        yield pd.DataFrame({"lang": at[0], "bucket": at[1], "n": total[at]})
    sums = (_chosen(labelled, languages, rows).mapInPandas(count, "lang int, bucket int, n bigint")
            .groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    table = np.ones((len(languages), BUCKETS))
    for row in sums.collect():
        table[row.lang, row.bucket] += row.n
    return np.log(table / table.sum(axis=1, keepdims=True))


def floors(labelled: DataFrame, model: np.ndarray, languages: tuple[str, ...] = LANGUAGES, rows: int | None = None) -> list[tuple | None]:
    """For each language (usual, floor, spread): what labelled texts reach under `model` as a mean log likelihood of
    their trigrams, all but one in twenty; half way from there to even likelihood, below which a text is not of the
    language; and the standard deviation of a trigram. None for a language without labelled texts.

    All texts of `labelled` are read; only a caller that gives `rows` has about so many of each language read, that `train` with
    as many has not seen. They are counted by their mean in steps of a thousandth, downwards, and these counts
    come to the driver: some ten thousand at most, however many texts there are.
    """
    def reached(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in small_batches(frames, "text", BATCH):
            found = []
            for text, lang in zip(frame.text, frame.lang):
                at = languages.index(lang)
                said = model[at, trigrams(text)]
                if len(said):
                    # whole numbers, so that sums do not depend on the order of rows
                    found.append((at, math.floor(said.mean() * 1000), round(said.var() * 1e6)))
            yield pd.DataFrame(found, columns=["lang", "step", "var"]).astype({"lang": "int32", "step": "int64", "var": "int64"})
    steps = (_chosen(labelled, languages, rows, 1).mapInPandas(reached, "lang int, step bigint, var bigint")
             .groupBy("lang", "step").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("var").cast("decimal(28,0)")).alias("var")))
    got = sorted((r.lang, r.step, r.n, int(r["var"])) for r in steps.collect())
    out: list[tuple | None] = []
    for at in range(len(languages)):
        own = [x for x in got if x[0] == at]
        if own:
            texts = sum(n for _, _, n, _ in own)
            rank, below = (texts - 1) // 20, 0
            for _, step, n, _ in own:
                below += n
                if below > rank:
                    break
            usual = step / 1000
            out.append((usual, min(usual, (usual - math.log(BUCKETS)) / 2), math.sqrt(sum(v for *_, v in own) / 1e6 / texts)))
        else:
            out.append(None)
    return out


def text_evidence(rows: DataFrame, model: np.ndarray, longest: int = 60, markup: bool = False) -> DataFrame:
    """`rows` with its column text replaced by `said` and `grams`.

    `said` has, for each language, the mean log likelihood of all trigrams of the whole text times their number, that
    number counting `longest` at most: trigrams of running text are not independent, and a long text would silence
    all other evidence. `grams` is how many trigrams there are. With `markup`, tags, scripts and styles are left out.
    """
    # what is not closed ends with the page, so a page is read once
    tags = re.compile(r"(?is)<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|<[a-z/!?][^>]*(?:>|\Z)")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in small_batches(frames, "text", BATCH):
            said, grams = [], []
            for text in frame.text:
                found = trigrams(html.unescape(tags.sub(" ", text)) if markup else text)
                n = len(found)
                counts = np.bincount(found, minlength=BUCKETS) if n > BUCKETS else None
                total = model[:, found].sum(axis=1) if counts is None else model @ counts
                said.append((total / max(n, 1) * min(n, longest)).tolist())
                grams.append(n)
            yield frame.drop(columns="text").assign(said=said, grams=grams)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInPandas(run, f"{kept}, said array<double>, grams bigint")


def best(scores: list[Column], languages: tuple[str, ...]) -> Column:
    """The language of the highest score, the first of equals."""
    top = F.greatest(*scores)
    choice = F.lit(languages[-1])
    for lang, score in list(zip(languages, scores))[-2::-1]:
        choice = F.when(score == top, lang).otherwise(choice)
    return choice


def noisy(seen: Column, languages: tuple[str, ...], error: float) -> list[Column]:
    """Log likelihood of a sign of language: right but for `error`; nothing if it names no known language."""
    known = F.coalesce(seen.isin(*languages), F.lit(False))
    other = math.log(error / max(1, len(languages) - 1))
    return [F.when(~known, 0.0).when(seen == lang, math.log(1 - error)).otherwise(other) for lang in languages]


def identify(rows: DataFrame, model: np.ndarray, languages: tuple[str, ...] = LANGUAGES, declared_error: float = 0.1,
             suffix_error: float = 0.2, strength: float = 20.0, markup: bool = False, least: float = 0.5,
             reach: list[tuple | None] | None = None) -> DataFrame:
    """The language of `rows` (text, host, suffix, declared and any key columns).

    Posterior of a language = text likelihood x likelihood of the declared language x likelihood of the address
    suffix x prior of the host. Priors are counted over all rows by the language that text and declaration alone give,
    and smoothed down the levels: host counts by `strength` rows of its suffix's prior, suffix counts by `strength`
    rows of the overall prior, that by one row for each language.

    With `reach` (see `floors`), a text is of none of the languages if its trigrams are less likely in the language that
    text and declaration give than its floor, by more than four standard errors, or, if another language is declared
    than the known ones, less likely than is usual. It then counts for no prior.

    Returns the key columns, whatever their names, and lang, confidence and text_lang. `und` is the language of rows without a letter, whatever is
    declared, of texts of none of the languages, both at confidence 0, and of rows whose best posterior is below `least`. Null text, host, suffix and declared say nothing; null hosts
    share a prior. Counts are whole numbers, so results do not depend on the order of rows.
    """
    used = ("text", "host", "suffix", "declared")
    names = rows.columns
    rows = rows.toDF(*[n if n in used else f"key{i}_" for i, n in enumerate(names)])
    keys = [F.col(f"key{i}_").alias(n) for i, n in enumerate(names) if n not in (*used, "lang", "confidence", "text_lang")]
    rows = rows.withColumns({"text": F.coalesce("text", F.lit("")), "host": F.coalesce("host", F.lit("")),
                             "suffix": F.coalesce("suffix", F.lit(""))})
    longest = 60
    rows = text_evidence(rows, model, longest, markup)
    said = [F.element_at("said", i + 1) for i in range(len(languages))]
    declared = noisy(F.col("declared"), languages, declared_error)
    alone = best([a + b for a, b in zip(said, declared)], languages)
    strange = F.lit(False)
    code = F.lower(F.regexp_extract("declared", r"^\s*([A-Za-z]{2,3})([-_].*)?$", 1))
    foreign = F.coalesce(~code.isin(*languages, *NO_OTHER), F.lit(False))
    for i, lang in enumerate(languages):
        if reach and reach[i]:
            usual, floor, spread = reach[i]
            mean = said[i] / F.least("grams", F.lit(longest))
            under = (mean < floor - 4 * spread / F.sqrt("grams")) | (foreign & (mean < usual))
            strange = F.when(F.col("by_text") == lang, under).otherwise(strange)
    rows = rows.withColumn("by_text", alone)
    rows = cut(rows.withColumn("text_lang", F.when((F.col("grams") == 0) | strange, NONE).otherwise(F.col("by_text"))).drop("by_text"))

    counts = [F.count(F.when(F.col("text_lang") == lang, 1)).alias(f"n{i}") for i, lang in enumerate(languages)]
    sums = [F.sum(f"n{i}").alias(f"n{i}") for i in range(len(languages))]
    hosts = cut(rows.groupBy("suffix", "host").agg(*counts))
    suffixes = hosts.groupBy("suffix").agg(*sums)
    total = hosts.agg(*sums).first()
    overall = [((total[i] or 0) + 1) / (sum(x or 0 for x in total) + len(languages)) for i in range(len(languages))]

    def smoothed(df: DataFrame, above: list[Column], name: str) -> DataFrame:
        n = sum(F.col(f"n{i}") for i in range(len(languages)))
        return df.withColumns({f"{name}{i}": (F.col(f"n{i}") + strength * above[i]) / (n + strength) for i in range(len(languages))})
    levels = range(len(languages))
    suffixes = smoothed(suffixes, [F.lit(x) for x in overall], "s").select("suffix", *[f"s{i}" for i in levels])
    hosts = cut(smoothed(hosts.join(suffixes, "suffix"), [F.col(f"s{i}") for i in levels], "p")
                .select("suffix", "host", *[f"p{i}" for i in levels]))

    pointed = F.lit(None).cast("string")
    for suffix, lang in SUFFIXES.items():
        pointed = F.when(F.col("suffix") == suffix, lang).otherwise(pointed)
    suffix_says = noisy(pointed, languages, suffix_error)
    judged = rows.join(hosts, ["suffix", "host"])
    scores = [a + b + c + F.log(F.col(f"p{i}")) for i, (a, b, c) in enumerate(zip(said, declared, suffix_says))]
    judged = judged.withColumns({f"score{i}": s for i, s in enumerate(scores)})
    scores = [F.col(f"score{i}") for i in levels]
    confidence = 1 / sum(F.exp(s - F.greatest(*scores)) for s in scores)
    judged = judged.withColumn("confidence", F.when(F.col("text_lang") == NONE, 0.0).otherwise(F.round(confidence, 6)))
    lang = F.when((F.col("text_lang") == NONE) | (F.col("confidence") < least), NONE).otherwise(best(scores, languages))
    return judged.select(*keys, lang.alias("lang"), "confidence", "text_lang")
