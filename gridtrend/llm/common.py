"""Helpers that the training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridtrend.session import ensure_checkpoint_dir

#: A word is a run of characters other than these white-space characters.
SPACE = r"[\x20\x09-\x0D]+"
#: Rows and bytes up to which a counted table may be broadcast.
SMALL_ROWS = 100_000
SMALL_BYTES = 8 << 20
#: Cells of a running sum: about so many rows each, and so many cells a group at most.
CELL_ROWS = 1_000
MOST_CELLS = 100_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return (F.crc32(text.cast("binary")) % F.lit(modulus)).cast("int")


def uniform_key(seed: str, *columns: str) -> Column:
    """32 hex digits that depend on the seed and the columns only."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.md5(F.concat_ws("|", F.lit(seed), *parts).cast("binary"))


def small(df: DataFrame, row_bytes: int = 64) -> bool:
    """Whether a table is proved small enough to broadcast: its rows are counted,
    up to the limit only, at ``row_bytes`` each."""
    limit = min(SMALL_ROWS, SMALL_BYTES // row_bytes)
    return df.limit(limit + 1).count() <= limit


_SCRATCH: list[tuple[SparkSession, str]] = []


def keep(df: DataFrame) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back, like ``cut``;
    ``release`` removes what was written so."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_folder(spark: SparkSession, released: bool = True) -> str:
    """A new path in the shared checkpoint folder, which ``release`` removes or not."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/llm-{uuid.uuid4().hex}"
    if released:
        _SCRATCH.append((spark, path))
    return path


def release(spark: SparkSession) -> None:
    """Remove the tables that ``keep`` has written in this session. Call it only
    when every result that reads them has been written."""
    for owner, path in [x for x in _SCRATCH if x[0] is spark]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        _SCRATCH.remove((owner, path))


def running_sums(
    df: DataFrame, group: Sequence[str], key: str, ties: Sequence[str], sums: dict[str, str]
) -> DataFrame:
    """Add, for each ``name: value`` of ``sums``, the sum of ``value`` over the rows
    before this one in its group, in the order of ``key`` and then ``ties``.

    ``key`` is a hexadecimal hash. A group is cut into cells of equal key ranges;
    only one row of sums per cell meets in a window of the whole group, and the rows
    are windowed within their cell, so a group with a third of all rows is spread
    over many tasks. ``df`` is read three times and its rows are shuffled once.
    """
    cells = max(1, min(MOST_CELLS, -(-df.count() // CELL_ROWS)))
    place = F.conv(F.substring(key, 1, 8), 16, 10).cast("long") * F.lit(cells)
    parts = [F.coalesce(F.concat(F.lit("+"), F.col(g).cast("string")), F.lit("-")) for g in group]
    rows = df.withColumns({"__group": F.concat_ws("|", *parts), "__cell": F.shiftright(place, 32)})
    totals = rows.groupBy("__group", "__cell").agg(*[F.sum(v).alias(f"__all_{n}") for n, v in sums.items()])
    earlier = Window.partitionBy("__group").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(
        "__group",
        "__cell",
        *[F.coalesce(F.sum(f"__all_{n}").over(earlier), F.lit(0)).alias(f"__before_{n}") for n in sums],
    )
    order = Window.partitionBy("__group", "__cell").orderBy(key, *[F.col(t).asc_nulls_first() for t in ties])
    within = order.rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(before, ["__group", "__cell"]).select(
        *df.columns,
        *[
            (F.col(f"__before_{n}") + F.coalesce(F.sum(v).over(within), F.lit(0))).alias(n)
            for n, v in sums.items()
        ],
    )
