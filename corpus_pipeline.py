"""From documents to training tokens: rules, near duplicates, secrets, mixing, encoding.

Every stage takes the documents its predecessor kept, written as Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import balance, bpe, hosts, keyscan, near_texts
from weftline.llm.frames import unused
from weftline.session import scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule, and those of hosts that fail, go.

    Null and empty texts have no words and go; rows without a source are a host of their own; repeated rows and null ids
    are judged row by row. Texts of any length are read whole. An empty table stays empty; columns stay as they are.
    """
    return hosts.kept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays; five-word shingles link at a Jaccard similarity of 0.8 or more, all of them.

    The row with the smallest id stays; null ids come after all others, and of rows that tie in id one stays. Texts without a
    word (null, empty, blank) are one group. Texts of any length are read whole. An empty table stays empty; columns stay as they are.
    """
    return near_texts.representatives(docs, words=5)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are taken out of the texts; n_chars follows the new text.

    Every row stays; null and empty texts stay as they are, without spans; equal texts come out equal. Texts of any length are
    scanned whole. An empty table stays empty; other columns stay as they are, and without an n_chars column none is made.
    """
    out = docs.withColumn("text", keyscan.redacted(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the balanced mix of their sources takes them.

    Null and empty texts have no words, null sources are a source of their own, rows are told apart whatever their ids, so repeated
    rows are mixed each. An empty table stays empty; columns stay as they are.
    """
    return balance.mixed(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of ids and of the text decoded from them.

    A row for each row, with its id and source, which may be null or repeated; null and empty texts have no ids. Texts of any
    length are encoded whole. An empty table stays empty; other columns go.
    """
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = unused(docs, "coded")
    made = docs.withColumn(coded, bpe.coded(docs, F.col("text"), path, public_tokenizers.PATTERN))
    return made.select("doc_id", "source", f"{coded}.*")


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("mixing", mixing),
    ("encoding", encoding),
]

#: Fingerprints and merges have no SQL form; the tests hold the rows against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
