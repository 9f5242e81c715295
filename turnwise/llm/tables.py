"""Reading columns by exact name, sharing files with Python workers, cutting narrow tables."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the words and of text comparison: blank, tab, line feed, vertical tab, form feed, return.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def columns(df: DataFrame, *names: str, **casts: str) -> DataFrame:
    """The named columns alone. Names are taken exactly, also beside columns that differ in case only."""
    own = df.toDF(*[f"c{i}_" for i in range(len(df.columns))])
    at = {n: f"c{df.columns.index(n)}_" for n in (*names, *casts)}
    return own.select(*[F.col(at[n]).cast(casts[n]).alias(n) if n in casts else F.col(at[n]).alias(n) for n in at])


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text, null taken as empty, and the columns in `more`."""
    return columns(docs, *more, doc_id="bigint", text="string").withColumn("text", F.coalesce("text", F.lit("")))


def unit(hashed: Column) -> Column:
    """A 64-bit hash as a number above 0 and below 1."""
    return (F.shiftrightunsigned(hashed, 11).cast("double") + 0.5) * 2.0 ** -53


def small_batches(frames: Iterator, column: str, limit: int) -> Iterator:
    """Arrow batches cut so that one holds about `limit` characters of `column`, a longer text alone."""
    for frame in frames:
        sizes = frame[column].str.len().cumsum().to_numpy()
        start, base = 0, 0
        while start < len(frame):
            stop = max(start + 1, int(sizes.searchsorted(base + limit, side="right")))
            yield frame.iloc[start:stop]
            start, base = stop, sizes[stop - 1]


def word_pieces(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text in bytes, cut at ASCII white space, from about `size` bytes of it at a time."""
    rest: list[bytes] = []
    for start in range(0, len(data), size):
        piece = data[start:start + size]
        words = piece.split()
        if rest and not piece[:1].isspace():
            words[0] = b"".join([*rest, words[0]])
            rest = []
            if len(words) == 1 and not piece[-1:].isspace():
                rest = words
                continue
        elif rest:
            words, rest = [b"".join(rest), *words], []
        if words and not piece[-1:].isspace():
            rest = [words.pop()]
        yield words
    if rest:
        yield [b"".join(rest)]


def short_batches(spark: SparkSession, rows: int = 500) -> None:
    """Let Python workers get `rows` texts at a time. Spark's default of 10,000 suits narrow rows, not texts of any
    length; a number that the user has set stays. Results do not depend on it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))
