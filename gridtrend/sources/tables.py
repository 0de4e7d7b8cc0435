"""Readers and the writer. Schemas are always given, never inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridtrend.schemas import DAILY_CLIMATE, SEASON_FLAGS, SURVEY_EXTRACT, ZONE_FLAGS


def read_table(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    schema: StructType | str | None = None,
) -> DataFrame:
    """Saved frame or exported table (Parquet), pruned to ``columns``."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.parquet(path)
    return df.select(*columns) if columns else df


def read_relation(
    spark: SparkSession, url: str, table: str, columns: Sequence[str], **options: str
) -> DataFrame:
    """Table of a relational database through JDBC (the driver jar is the caller's)."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, **options)
        .load()
        .select(*columns)
    )


#: What becomes of a row whose fields do not have the types of the schema: its bad fields
#: are null, the row goes, or reading fails.
DAMAGED = {"null": "PERMISSIVE", "drop": "DROPMALFORMED", "raise": "FAILFAST"}


def read_csv(spark: SparkSession, path: str, schema: StructType | str, damaged: str = "null") -> DataFrame:
    """Typed text with a header line; "NA" and empty fields are null, a field in quotes may
    hold separators, and doubled quotes."""
    return spark.read.schema(schema).csv(
        path, header=True, nullValue="NA", quote='"', escape='"', mode=DAMAGED[damaged]
    )


def write_csv(df: DataFrame, path: str) -> None:
    """Text that ``read_csv`` reads back: nulls as "NA", quotes doubled."""
    df.write.mode("overwrite").csv(path, header=True, nullValue="NA", quote='"', escape='"')


def read_daily_climate(spark: SparkSession, path: str, damaged: str = "null") -> DataFrame:
    return read_csv(spark, path, DAILY_CLIMATE, damaged)


def zero_flags(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """0/1 flags whose missing values arrive as the text "NA": those become 0."""
    return df.withColumns(
        {f: F.coalesce(F.col(f).try_cast("int"), F.lit(0)) for f in flags}
    )


def read_survey_extract(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(SURVEY_EXTRACT).csv(path, header=True)
    return zero_flags(raw, SEASON_FLAGS + ZONE_FLAGS)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
