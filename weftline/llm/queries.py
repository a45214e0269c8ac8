"""One query for each operator, with production parameters over whole tables."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import (
    balance, bpe, hosts, keyscan, languages, licenses, middle, pagetext, resample, simhash, sketch, sql, subword, warc,
)
from weftline.llm.registry import QUERIES, SQL, Query, register, table


@register("op1_simhash_vantage_forest")
def near_duplicate_classes(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"), words=4, radius=4)
    return found.select(
        "doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id")
    )


@register("op2_byte_bpe")
def encoded(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    made = bpe.coded(docs, F.col("text"), path, public_tokenizers.PATTERN, with_ids=False)
    return docs.select("doc_id", made.alias("c")).select("doc_id", "c.*")


@register("op3_host_quality_rules", sql.HOST_RULES)
def host_quality(spark: SparkSession, folder: str) -> DataFrame:
    judged = hosts.judge(table(spark, folder, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@register("op4_license_set_join", sql.licenses())
def license_statements(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan(table(spark, folder, "documents"))
    at = F.transform("places", lambda p: p["at"])
    base = F.array_distinct(F.transform("places", lambda p: p["label"]))
    more = F.transform("matches", lambda m: m["label"])
    best = F.coalesce(F.array_max(F.transform("matches", lambda m: m["contained"])), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(at).cast("long").alias("first_word"), F.array_max(at).cast("long").alias("last_word"),
        F.array_join(F.sort_array(base), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_distinct(F.concat(base, more))), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(best).alias("score"),
    )


@register("op5_capture_index", sql.CAPTURES)
def captured(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archived(table(spark, folder, "pages"))


@register("op6_subword_quality")
def quality_scores(spark: SparkSession, folder: str) -> DataFrame:
    return subword.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@register("op7_lookup_sketch")
def document_versions(spark: SparkSession, folder: str) -> DataFrame:
    return sketch.versions(table(spark, folder, "documents"))


@register("op8_structural_secrets")
def secrets(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", keyscan.spans(F.col("text")).alias("spans"))
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    written = lambda spans: F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    ), ",")
    return docs.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"),
    )


@register("op9_language_filters")
def document_languages(spark: SparkSession, folder: str) -> DataFrame:
    return languages.identify(table(spark, folder, "documents"))


@register("op10_entropy_balance")
def balanced_mix(spark: SparkSession, folder: str) -> DataFrame:
    mixed = balance.mix(table(spark, folder, "documents"))
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


@register("op11_prefix_crc_resampling", sql.resampled())
def resampled(spark: SparkSession, folder: str) -> DataFrame:
    found = resample.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


@register("op12_host_path_text", sql.PAGE_TEXTS)
def page_texts(spark: SparkSession, folder: str) -> DataFrame:
    found = pagetext.extracted(table(spark, folder, "pages"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


@register("op13_swar_infilling", sql.INFILLED)
def infilled(spark: SparkSession, folder: str) -> DataFrame:
    return middle.infilled(table(spark, folder, "documents"), with_output=False)


@register("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
