"""Stage tables: results of one job that the next one reads."""

from __future__ import annotations

import posixpath
from dataclasses import asdict, dataclass
from hashlib import blake2b

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.schema import KEY

#: Columns that a layout adds: a long and a short block of time.
ERA, BLOCK = "era", "block"
NOTE = "time string, buckets int, by array<string>, era_seconds double, block_seconds double, columns string"


@dataclass(frozen=True)
class Layout:
    """How a stage table of timed rows lies on disk.

    Folders are eras of `era_seconds` of the time column, so a slice of time reads the folders it touches. Inside, rows are
    dealt to `buckets` files by stream and the columns `by`, and sorted by stream and time, so row groups of other streams
    and times are passed over, and two stages of equal buckets and `by` join on these columns where they lie. `by` holds a number
    of the row, or `block`, its block of `block_seconds`, so a stream that holds most rows is spread over the buckets.
    """

    time: str = "start"
    buckets: int = 64
    by: tuple[str, ...] = (BLOCK,)
    era_seconds: float = 3600.0
    block_seconds: float = 300.0

    @property
    def keys(self) -> list[str]:
        return [*KEY, *self.by]

    def blocks(self) -> dict[str, Column]:
        """Rows without a time lie in era and block -1."""
        def part(seconds: float) -> Column:
            return F.coalesce(F.floor(F.col(self.time) / seconds), F.lit(-1)).cast("long")
        return {ERA: part(self.era_seconds)} | ({BLOCK: part(self.block_seconds)} if BLOCK in self.by else {})


def save_stage(df: DataFrame, root: str, name: str, *, mode: str = "overwrite", layout: Layout | None = None) -> str:
    """Write a stage. With a layout its tables can be sliced and joined by `load_stage` without reading or moving all of it."""
    path = posixpath.join(root, name)
    if layout is None:
        df.write.mode(mode).parquet(path)
        return path
    spark = df.sparkSession
    table = _table(path)
    if mode == "overwrite":
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    rows = df.withColumns(layout.blocks())
    # the hash of a repartition is that of the buckets, so each task writes the files of its own buckets
    rows = rows.repartition(layout.buckets, *layout.keys)
    (rows.write.mode(mode).format("parquet").option("path", path).partitionBy(ERA).bucketBy(layout.buckets, *layout.keys)
     .sortBy(*KEY, layout.time).saveAsTable(table))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    note = spark.createDataFrame([(*asdict(layout).values(), schema)], NOTE)
    note.coalesce(1).write.mode("overwrite").json(f"{path}.layout")
    return path


def _table(path: str) -> str:
    return f"stage_{blake2b(path.encode(), digest_size=8).hexdigest()}"


def stage_layout(spark: SparkSession, root: str, name: str) -> tuple[Layout, str]:
    """The layout of a stage and its columns, as they were written beside it."""
    *own, columns = spark.read.schema(NOTE).json(f"{posixpath.join(root, name)}.layout").first()
    return Layout(*(tuple(v) if isinstance(v, list) else v for v in own)), columns


def load_stage(spark: SparkSession, root: str, name: str, *, layout: bool = False) -> DataFrame:
    """A stage. With `layout`, as a table that knows its folders, buckets and order, also in another session than the one that
    wrote it; it then has the columns of `Layout.blocks` too."""
    path = posixpath.join(root, name)
    if not layout:
        return spark.read.parquet(path)
    table = _table(path)
    if not spark.catalog.tableExists(table):
        own, columns = stage_layout(spark, root, name)
        keys = ", ".join(f"`{k}`" for k in KEY)
        spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet PARTITIONED BY ({ERA}) CLUSTERED BY ({', '.join(f'`{k}`' for k in own.keys)}) "
                  f"SORTED BY ({keys}, `{own.time}`) INTO {own.buckets} BUCKETS LOCATION '{path}'")
        spark.sql(f"MSCK REPAIR TABLE {table}")
    return spark.table(table)


def slice_stage(stage: DataFrame, layout: Layout, low: float, high: float, *, streams: list[int] | None = None, half_open: bool = False,
                slack: float | None = None, end: str = "end") -> DataFrame:
    """Rows of a stage with a layout whose time lies in [low, high], or [low, high), of all streams or the named ones. With `slack`
    they must also end by high + slack. Only the folders of these eras are read, and of their files the row groups that may hold
    such rows."""
    at = F.col(layout.time)
    inside = (at >= low) & ((at < high) if half_open else (at <= high))
    if slack is not None:
        inside &= F.col(end) <= high + slack
    if streams is not None:
        inside &= F.col("stream_id").isin(streams)
    eras = F.col(ERA).between(int(low // layout.era_seconds), int(high // layout.era_seconds))
    return stage.filter(eras & inside)


def join_stages(left: DataFrame, right: DataFrame, layout: Layout) -> DataFrame:
    """Rows of two stages of one layout that agree on its keys, joined bucket by bucket: nothing is shuffled."""
    return left.join(right.drop(ERA), layout.keys)


def import_stage(spark: SparkSession, path: str | list[str], rows: str, schema: str, *, document: str = "") -> tuple[DataFrame, DataFrame]:
    """A stage written elsewhere as JSON documents, one file each: (rows, files without such a list).

    Every document holds a list of objects under `rows` and may have fields of its own (`document`, a schema), which
    come out on each of its rows. The place in the list is item_no, the file is named in `file`.
    """
    shape = ", ".join(x for x in (f"{rows} array<struct<{schema}>>", document) if x)
    docs = (spark.read.schema(shape).option("multiLine", True).json(path)
            .select("*", F.col("_metadata.file_path").alias("file")))
    own = [c for c in docs.columns if c != rows]
    found = docs.select(*own, F.posexplode(rows).alias("item_no", "_row")).select("*", "_row.*").drop("_row")
    return found, docs.filter(F.col(rows).isNull()).select("file")
