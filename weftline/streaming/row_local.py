"""Running the row-local operators over a stream of files.

Value lookup, rules, typed predicates, row-level quality checks, line scans and the column
functions hold no aggregate and no sort, so a streaming frame goes through them unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from weftline.session import scratch_path


def read_files(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet") -> DataFrame:
    """A stream of the files that arrive in a folder; the schema is given, never inferred."""
    reader = spark.readStream.schema(schema).format(fmt)
    return (reader.option("header", True) if fmt == "csv" else reader).load(path)


def run_available(
    stream: DataFrame, transform: Callable[[DataFrame], DataFrame], target: str, state: str | None = None
) -> DataFrame:
    """Apply a row-local transform to everything available now and append it to a Parquet table.

    The state folder remembers which files are done: a rerun adds only new ones, and a failed
    run is repeated without duplicates.
    """
    spark = stream.sparkSession
    query = (
        transform(stream)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", target)
        .option("checkpointLocation", state or scratch_path(spark, "stream"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(target)
