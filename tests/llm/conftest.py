import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i}" for i in range(60_000))
#: (doc_id, text): nulls, empty and blank texts, ties, a repeated row, one doc_id with two texts, a very long text.
EDGE = [(1, "a b c d e f g"), (2, None), (3, ""), (4, " \t\n "), (5, "a  b c\td e f g"), (5, "a  b c\td e f g"), (None, "x"),
        (None, None), (6, LONG), (7, "Grüße, ça va? naïve \U0001f600 <|endoftext|> 漢字"), (8, "one"), (8, "two words")]
#: Names that operators use inside, and names that differ from theirs in case only.
CLASHES = ["TEXT", "Doc_Id", "id", "h", "hash", "size", "block", "shard", "times", "draw", "n", "tokens", "row", "place", "key", "host"]


def frame(spark, rows, extra=True, **more):
    """`rows` (doc_id, text) as a table of documents, with columns of clashing names."""
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
              T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    names = CLASHES if extra else []
    fields += [T.StructField(n, T.StringType()) for n in names]
    sources = [None, "b", "a", "b", "c"]
    data = [(i, t, "en", sources[k % 5], None if t is None else len(t), *["?"] * len(names)) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, T.StructType(fields))


@pytest.fixture(scope="session")
def edge(spark):
    return frame(spark, EDGE)


@pytest.fixture(scope="session")
def none(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def pages(spark):
    return spark.read.parquet(f"{SF}/pages.parquet")
