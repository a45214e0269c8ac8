"""Result digests and verification of hash-chained ledgers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import row_digest
from weftline.session import spread
from weftline.sources.digests import LEVELS, tree_digest

# The hash before the first row.
GENESIS = "0" * 64


def result_digest(result: DataFrame, keys: Sequence[str], levels: int = LEVELS) -> DataFrame:
    """Row count and digest of a result whose key columns identify its rows.

    The key is part of every hashed row, so the digest does not depend on row order and no
    task sees the whole result.
    """
    hashed = result.select(
        F.concat_ws("|", *keys, row_digest(result.columns)).alias("line")
    )
    counts = result.agg(F.lit(None).cast("string").alias("digest"), F.count(F.lit(1)).alias("row_count"))
    digest = tree_digest(hashed, "line", levels).select("digest", F.lit(None).cast("bigint").alias("row_count"))
    return digest.unionByName(counts).agg(
        F.max("digest").alias("digest"), F.max("row_count").alias("row_count")
    )


def chain_hash() -> Column:
    """Hash of a ledger row over its own content and the previous hash."""
    fields = ("query_id", "document", "signature", "sequence", "previous_hash")
    return row_digest(fields)


def ledger_violations(ledger: DataFrame, checkpoints: DataFrame, genesis: str = GENESIS, rows: int = 0) -> DataFrame:
    """Everything wrong with the chains, as rows (chain_id, sequence, violation).

    ledger: chain_id, query_id, document, signature, sequence, previous_hash, row_hash;
    checkpoints: chain_id, sequence, row_hash. Rows meet their predecessor by an equi join on
    (chain_id, sequence), so one long chain spreads over all tasks; with the most rows there may be, the number of
    tasks follows it. An unknown head reports as sequence null.
    """
    place = ("chain_id", "sequence")
    following = ledger.select("chain_id", (F.col("sequence") + 1).alias("sequence"), F.col("row_hash").alias("_before"))
    before = spread(following, rows, *place).groupBy(*place).agg(F.min("_before").alias("_before"))
    # What a row says of itself is checked before it moves.
    own = ledger.select(
        *place, "previous_hash",
        (~F.col("row_hash").eqNullSafe(chain_hash())).alias("_altered"),
        (~F.get_json_object("document", "$.query_id").eqNullSafe(F.col("query_id"))).alias("_foreign"),
    )
    linked = spread(own, rows, *place).join(before, [*place], "left")
    expected = F.when(F.col("sequence") == 1, F.lit(genesis)).otherwise(F.col("_before"))
    row_checks = F.array_compact(
        F.array(
            F.when(expected.isNull(), "SEQUENCE_GAP"),
            F.when(expected.isNotNull() & (F.col("previous_hash") != expected), "PREVIOUS_HASH"),
            F.when(F.col("_altered"), "ROW_HASH"),
            F.when(F.col("_foreign"), "DOCUMENT_ID"),
            F.when(F.col("sequence") < 1, "SEQUENCE_RANGE"),
        )
    )
    unlinked = linked.select("chain_id", "sequence", F.explode(row_checks).alias("violation"))
    # Rows of a place are one before chains are, so that no task sorts a whole file for the heads.
    taken = spread(ledger.select(*place, "row_hash"), rows, *place).groupBy(*place).agg(
        F.count(F.lit(1)).alias("_taken"), F.max("row_hash").alias("_last")
    )
    repeated = taken.where("_taken > 1").select(*place, F.lit("SEQUENCE_REPEATED").alias("violation"))
    heads = taken.groupBy("chain_id").agg(
        F.sum("_taken").alias("_rows"), F.max_by("_last", "sequence").alias("_head")
    )
    marks = checkpoints.select(
        "chain_id", F.col("sequence").alias("_marked"), F.col("row_hash").alias("_mark")
    )
    compared = heads.join(marks, "chain_id", "full_outer")
    head_checks = F.array_compact(
        F.array(
            F.when(F.col("_marked").isNull(), "CHECKPOINT_MISSING"),
            F.when(
                F.col("_marked").isNotNull() & (F.col("_marked") != F.coalesce("_rows", F.lit(0))),
                "CHECKPOINT_SEQUENCE",
            ),
            F.when(
                F.col("_marked").isNotNull() & (F.col("_mark") != F.coalesce("_head", F.lit(genesis))),
                "CHECKPOINT_HASH",
            ),
        )
    )
    ends = compared.select(
        "chain_id", F.lit(None).cast("bigint").alias("sequence"), F.explode(head_checks).alias("violation")
    )
    return unlinked.select("chain_id", F.col("sequence").cast("bigint"), "violation").unionByName(
        repeated.select("chain_id", F.col("sequence").cast("bigint"), "violation")
    ).unionByName(ends)


def provenance_lookup(ledger: DataFrame, checkpoints: DataFrame, query_id: str, rows: int = 0) -> DataFrame:
    """The record of one id, refused if the chain does not verify or the id is unknown."""
    if not ledger_violations(ledger, checkpoints, rows=rows).isEmpty():
        raise ValueError("ledger integrity is invalid")
    records = ledger.where(F.col("query_id") == query_id)
    return records.select("chain_id", "query_id", "document", "signature")


def trusted_records(ledger: DataFrame, checkpoints: DataFrame, rows: int = 0) -> DataFrame:
    """Records of the chains that verify; a chain with any violation yields none."""
    broken = ledger_violations(ledger, checkpoints, rows=rows).select("chain_id").distinct()
    return ledger.join(broken, "chain_id", "left_anti").select(
        "chain_id", "query_id", "document", "signature"
    )
