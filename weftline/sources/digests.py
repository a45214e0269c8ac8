"""Content manifests and order-free digests that never pass a whole table through one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Levels above the leaves. Leaves group by eight hex digits: 256 a group at a trillion lines.
LEVELS = 4


def file_contents(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Files as (path, content); each file is read whole by one task.

    Spark refuses files of 2 GB and more here; split those before they are listed.
    """
    found = spark.read.format("binaryFile").load(paths)
    return found.select("path", "content")


def content_manifest(contents: DataFrame) -> DataFrame:
    """Path, SHA-256 and byte length of every content."""
    return contents.select(
        "path",
        F.sha2(F.col("content"), 256).alias("sha256"),
        F.octet_length(F.col("content")).cast("bigint").alias("byte_length"),
    )


def manifest_line() -> Column:
    """The line a manifest entry adds to the manifest digest."""
    return F.concat_ws(
        "\x00", F.col("path"), F.col("sha256"), F.col("byte_length").cast("string")
    )


def manifest_changes(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """Paths that were added, removed or changed between two manifests."""
    old = recorded.select(
        "path", F.col("sha256").alias("old_sha"), F.col("byte_length").alias("old_length")
    )
    new = current.select(
        "path", F.col("sha256").alias("new_sha"), F.col("byte_length").alias("new_length")
    )
    change = (
        F.when(F.col("old_sha").isNull(), "added")
        .when(F.col("new_sha").isNull(), "removed")
        .when(
            (F.col("old_sha") != F.col("new_sha")) | (F.col("old_length") != F.col("new_length")),
            "changed",
        )
    )
    joined = old.join(new, "path", "full_outer").select("path", change.alias("change"))
    return joined.where(F.col("change").isNotNull())


def tree_digest(lines: DataFrame, column: str, levels: int = LEVELS) -> DataFrame:
    """One digest of a set of lines, as a hash tree.

    Lines are hashed, then hashed again in groups that share a hash prefix, two hex digits
    shorter at each level, so no group above the leaves has more than 256 entries, and hashes
    spread the leaves evenly over 256 ** levels groups. The number of levels is part of the
    digest's definition and the same for tables of every size.
    """
    leaves = lines.select(F.unhex(F.sha2(F.col(column), 256)).alias("h")).distinct()
    # Moved once more, by the first two levels, leaves and the levels below meet where they are.
    kept = min(levels, 2)
    dealt = leaves.withColumn("top", F.substring("h", 1, kept)).repartition("top")
    text = F.lower(F.hex("h"))
    nodes = dealt.select("top", text.alias("k"), text.alias("h"))
    joined = F.array_join(F.array_sort(F.collect_list("h")), "")
    for level in range(levels, 0, -1):
        prefix = F.substring("k", 1, 2 * level).alias("prefix")
        grouped = nodes.groupBy("top", prefix) if level >= kept else nodes.groupBy(prefix)
        nodes = grouped.agg(F.sha2(joined, 256).alias("h"))
        nodes = nodes.select(*["top"][: level >= kept], F.col("prefix").alias("k"), "h")
        joined = F.array_join(F.array_sort(F.collect_list(F.struct("k", "h")))["h"], "")
    return nodes.agg(F.sha2(joined, 256).alias("digest"))


def flat_digest(lines: DataFrame, column: str) -> DataFrame:
    """SHA-256 over the sorted distinct lines, each ended by a newline.

    The exact sequential form, for catalogues: SHA-256 cannot be split, so all lines meet in
    one row. Tables use tree_digest.
    """
    distinct = lines.select(F.col(column).alias("line")).distinct()
    joined = F.array_join(F.array_sort(F.collect_list("line")), "\n")
    return distinct.agg(F.sha2(F.concat(joined, F.lit("\n")), 256).alias("digest"))
