"""Rows that can be told apart, whatever their columns hold."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import scratch_path

ROWS_IN_FILE = 200_000


def unused(docs: DataFrame, name: str) -> str:
    """The name, with underscores in front until no column has it in any case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def in_few_files(df: DataFrame, rows: int) -> DataFrame:
    """A small frame of a known size in as many partitions as its rows fill, before it is written over and over."""
    return df.coalesce(1 + rows // ROWS_IN_FILE)


def keyed(docs: DataFrame) -> tuple[DataFrame, tuple[str, ...]]:
    """``docs`` with two columns that tell its rows apart in every read, and the names of these.

    Rows read from Parquet files are told apart by their file and their place in it. Other rows are
    written to the shared folder and numbered there. A frame that repeats rows of the files it reads must be
    written by its caller first.
    """
    file, row = unused(docs, "file"), unused(docs, "row")
    try:
        placed = docs.select("*", F.xxhash64("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row))
    except AnalysisException:
        path = scratch_path(docs.sparkSession, "rows")
        docs.select("*", F.lit(0).cast("long").alias(file), F.monotonically_increasing_id().alias(row)).write.parquet(path)
        placed = docs.sparkSession.read.parquet(path)
    return placed, (file, row)
