"""Typed and raw table readers, and ordered writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weftline.session import literal_rows, written


def read_table(
    spark: SparkSession, path: str, schema: StructType, fmt: str = "csv", mode: str = "FAILFAST"
) -> DataFrame:
    """Read a header CSV or a Parquet table with the types of its contract; nothing is inferred."""
    if fmt == "csv":
        return (
            spark.read.schema(schema)
            .options(header=True, mode=mode, enforceSchema=False)
            .csv(path)
        )
    if fmt != "parquet":
        raise ValueError(f"unknown table format: {fmt}")
    return cast_to_contract(spark.read.parquet(path), schema)


def cast_to_contract(df: DataFrame, schema: StructType) -> DataFrame:
    """Keep the contract's columns, in its order and with its types."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Read CSV files as strings with a row number that counts lines from 2, after the header.

    Part files are numbered through in path order. A row's number is the rows before its block
    plus its place in the block, so rows keep their place: a first job counts the rows of each block of the listing,
    and these counts are summed up over ranges of blocks and written. Spark joins them back by their measured size. Records must not
    span lines. An empty or absent field is an empty text, so that the checks see it.
    """
    raw = (
        spark.read.options(header=True, inferSchema=False)
        .csv(path)
        .withColumn("_file", F.col("_metadata.file_path"))
        .withColumn("_start", F.col("_metadata.file_block_start"))
        .withColumn("_at", F.monotonically_increasing_id())
    )
    blocks = raw.groupBy("_file", "_start").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first")
    )
    before = running_totals(blocks, ["_file", "_start"], "_rows", "_before")
    placed = written(before.select("_file", "_start", (F.col("_before") - F.col("_first") + 2).alias("_offset")), "blocks")
    data = [c for c in raw.columns if c not in ("_file", "_start", "_at")]
    texts = [F.coalesce(c, F.lit("")).alias(c) for c in data]
    numbered = raw.join(placed, ["_file", "_start"])
    return numbered.select((F.col("_at") + F.col("_offset")).alias("row_number"), *texts)


def running_totals(rows: DataFrame, order: Sequence[str], value: str, name: str) -> DataFrame:
    """The rows with the sum of ``value`` over all rows before them in a unique order.

    Rows are dealt out by ranges of the order and written; a window sums within each range, and the driver gathers one
    sum for each range, so neither holds all rows.
    """
    dealt = rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    dealt = written(dealt, "ranges")
    offsets, before = [], 0
    for part in sorted(dealt.groupBy("_range").agg(F.sum(value).alias("total")).collect()):
        offsets.append((part["_range"], before))
        before += part["total"]
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    starts = literal_rows(rows.sparkSession, offsets, "_range int, _base bigint")
    summed = dealt.withColumn("_own", F.coalesce(F.sum(value).over(within), F.lit(0))).join(starts, "_range")
    return summed.withColumn(name, F.col("_own") + F.col("_base")).drop("_range", "_own", "_base")


def write_sorted(
    df: DataFrame, path: str, columns: Sequence[str], keys: Sequence[str], fmt: str = "csv"
) -> None:
    """Write fixed columns in key order; the sort is a range shuffle, one file per range."""
    writer = df.select(*columns).sort(*keys).write.mode("errorifexists")
    if fmt == "csv":
        writer.options(header=True, lineSep="\n").csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown table format: {fmt}")
