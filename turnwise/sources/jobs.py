"""Job tables: requests to process a link."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _variant(df: DataFrame, *names: str) -> Column | None:
    """First column whose trimmed name is one of `names`, case ignored."""
    wanted = [n.lower() for n in names]
    hits = [c for c in df.columns if c.strip().lower() in wanted]
    return F.col(f"`{hits[0]}`") if hits else None


def pending_jobs(table: DataFrame, *, sheet: str, row: str, query_names: tuple[str, ...] = ("query", "search query")) -> DataFrame:
    """Rows with a link and no status yet. `max clips` is read as a number, else 10; a blank query
    is none. A table without a link column has no jobs."""
    url = _variant(table, "video url")
    if url is None:
        return table.select(F.lit(sheet).alias("sheet"), F.col(row).alias("row_no"), F.lit("").alias("url"),
                            F.lit(None).cast("string").alias("query"), F.lit(10).alias("max_clips")).filter(F.lit(False))
    def text(*names: str) -> Column:
        c = _variant(table, *names)
        return F.lit(None).cast("string") if c is None else F.trim(c.cast("string"))
    count = text("max clips").try_cast("int")
    return (table.select(F.lit(sheet).alias("sheet"), F.col(row).alias("row_no"), F.trim(url).alias("url"),
                         F.nullif(text(*query_names), F.lit("")).alias("query"),
                         F.coalesce(F.nullif(count, F.lit(0)), F.lit(10)).alias("max_clips"),
                         F.coalesce(text("status"), F.lit("")).alias("_status"))
            .filter((F.col("_status") == "") & (F.col("url") != "")).drop("_status"))


def all_pending(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Pending jobs of all tabs: name -> (table, row column)."""
    return reduce(DataFrame.unionByName, [pending_jobs(t, sheet=n, row=r) for n, (t, r) in tables.items()])


def job_states(log: DataFrame, outcomes: DataFrame, *, error_chars: int = 500) -> DataFrame:
    """Where every job stands: source, row_no, url, attempts, status, link, error.

    `log` (source, row_no, url, seq) has a row for each time a job was taken up, seq counting the batches; `outcomes`
    (source, row_no, seq, ok, link, error) a row for each attempt that came to an end. Of the last attempt, one that ended is
    `complete` with its link or `failed` with the first `error_chars` of its error; without an outcome it is `processing` if
    it is of the latest batch, else `lost`: a batch begins when the one before it is over, so its worker died. A second outcome of an
    attempt counts only if it is the better one.
    """
    # The order among outcomes is theirs cut short too: of errors that begin alike either gives the same row. One that is complete
    # shows no error, so none is carried along.
    good = F.coalesce("ok", F.lit(False))
    ends = outcomes.groupBy("source", "row_no", "seq").agg(
        F.max(F.struct(good.alias("ok"), "link", F.when(~good, F.substring("error", 1, error_chars)).alias("error"))).alias("_end"))
    tries = log.groupBy("source", "row_no").agg(F.max_by("url", "seq").alias("url"), F.max("seq").alias("seq"), F.count_distinct("seq").alias("attempts"))
    latest = log.agg(F.max("seq")).first()[0]
    rows = tries.join(ends.hint("merge"), ["source", "row_no", "seq"], "left")
    ok = F.coalesce(F.col("_end.ok"), F.lit(False))
    status = (F.when(F.col("_end").isNull(), F.when(F.col("seq") == F.lit(latest), "processing").otherwise("lost"))
              .otherwise(F.when(ok, "complete").otherwise("failed")))
    return rows.select("source", "row_no", "url", "attempts", status.alias("status"), F.when(ok, F.col("_end.link")).alias("link"),
                       F.when(~ok, F.col("_end.error")).alias("error"))


def jobs_to_retry(states: DataFrame, *, most: int = 3) -> DataFrame:
    """Lost jobs that have been tried less than `most` times; failed ones wait for their user."""
    return states.filter((F.col("status") == "lost") & (F.col("attempts") < most)).select("source", "row_no", "url")
