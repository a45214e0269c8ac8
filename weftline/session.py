"""Session helpers: checkpoint folder, lineage cuts and literal tables."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Up to so many bytes a measured join side is broadcast.
BROADCAST_BYTES = 8 << 20
#: Rows of wide texts, such as triples, that one task is given.
TASK_ROWS = 1 << 18


def local_session(cores: int | str = 8, app: str = "weftline", **conf: str) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own settings."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the session names; a temporary one only in local mode."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder for a table written by one job."""
    return f"{checkpoint_folder(spark)}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the checkpoint folder, so a lost executor costs no replay."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: computed once, with a size that Spark knows in later joins."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Rows dealt by their keys to tasks of about TASK_ROWS rows, ``rows`` in all; a few rows stay where they are.

    Spark sizes tasks by packed bytes, which texts that repeat have few of, and does not merge these.
    """
    tasks = -(-rows // TASK_ROWS)
    return df.repartition(tasks, *keys) if tasks > 1 else df


def ranged(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Distinct rows sorted by their keys, in ranges of about TASK_ROWS rows, ``rows`` in all; a few rows are left to Spark.

    The keys tell the rows apart, so that equal rows share a range and move once.
    """
    tasks = -(-rows // TASK_ROWS)
    if tasks <= 1:
        return df.distinct().sort(*keys)
    return df.repartitionByRange(tasks, *keys).distinct().sortWithinPartitions(*keys)


def measured_side(df: DataFrame) -> DataFrame:
    """A join side, written and measured in bytes: marked for broadcast up to BROADCAST_BYTES, else left to Spark."""
    written = cut_lineage(df)
    size = written.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(written) if size <= BROADCAST_BYTES else written


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table written in code. Spark keeps it in the plan and knows its size."""
    names = to_arrow_schema(StructType.fromDDL(schema))
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    arrays = [pa.array(_plain(c), type=f.type) for c, f in zip(columns, names, strict=True)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=names), schema=StructType.fromDDL(schema))


def _plain(values: tuple) -> list:
    return [list(v) if isinstance(v, tuple) else v for v in values]
