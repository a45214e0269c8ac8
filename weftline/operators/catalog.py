"""Catalogue checks and lookups over concept, product, mapping, metric and rule tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import fold_case


@dataclass(frozen=True)
class Reference:
    """A column of one table that must hold identifiers of another."""

    name: str
    child: DataFrame
    column: str
    parent: DataFrame
    parent_column: str = "id"


def dangling(references: Sequence[Reference]) -> DataFrame:
    """Referenced values without a target: (reference, value, uses).

    Values are counted before they are matched, so one value on a third of the child rows
    is one row of the join.
    """
    found: DataFrame | None = None
    for ref in references:
        used = (
            ref.child.where(F.col(ref.column).isNotNull())
            .groupBy(F.col(ref.column).cast("string").alias("value"))
            .agg(F.count(F.lit(1)).alias("uses"))
        )
        known = ref.parent.select(F.col(ref.parent_column).cast("string").alias("value"))
        missing = used.join(known, "value", "left_anti").select(
            F.lit(ref.name).alias("reference"), "value", "uses"
        )
        found = missing if found is None else found.unionByName(missing)
    if found is None:
        raise ValueError("no references to check")
    return found


def catalog_references(catalog: Mapping[str, DataFrame]) -> list[Reference]:
    """Every reference between the catalogue tables (arrays and maps are exploded)."""
    concepts, products, metrics, rules = (
        catalog[name] for name in ("concepts", "products", "metrics", "rules")
    )
    mappings, fields, values = (catalog[n] for n in ("mappings", "mapping_fields", "value_map"))
    targets = concepts.select(F.explode("relationships.target").alias("target"))
    product_concepts = products.select(F.explode("concepts").alias("concept"))
    mapped_products = mappings.select(F.explode("data_products").alias("product"))
    sources = metrics.select(F.explode("source_products").alias("product"))
    dependencies = metrics.select(F.explode("dependencies").alias("metric"))
    normalised = values.where(F.col("kind") == "products")
    return [
        Reference("concept.relationship", targets, "target", concepts),
        Reference("product.concept", product_concepts, "concept", concepts),
        Reference("mapping.product", mapped_products, "product", products),
        Reference("mapping.concept", fields, "concept", concepts),
        Reference("mapping.subset", fields, "canonical_subset", concepts),
        Reference("mapping.normalization", normalised, "canonical_value", concepts),
        Reference("metric.product", sources, "product", products),
        Reference("metric.concept", metrics, "concept", concepts),
        Reference("metric.rule", metrics, "filter_rule", rules),
        Reference("metric.dependency", dependencies, "metric", metrics),
        Reference("rule.concept", rules, "applies_to", concepts),
    ]


def explode_relationships(concepts: DataFrame) -> DataFrame:
    """Concept relationships as rows (source, pos, predicate, target)."""
    return concepts.select(
        F.col("id").alias("source"), F.posexplode("relationships").alias("pos", "r")
    ).select("source", "pos", "r.predicate", "r.target")


def edge_lookup(requests: DataFrame, relationships: DataFrame) -> DataFrame:
    """The first governed predicate from source to target per request; null where none exists."""
    first = relationships.groupBy("source", "target").agg(
        F.min_by("predicate", "pos").alias("predicate")
    )
    return requests.join(first, ["source", "target"], "left")


def certified(products: DataFrame) -> DataFrame:
    """Products whose certification and quality are both CERTIFIED."""
    return products.where(
        (F.col("certification_status") == "CERTIFIED") & (F.col("quality_status") == "CERTIFIED")
    )


def certified_products_for(products: DataFrame, concept_id: str) -> DataFrame:
    return certified(products).where(F.array_contains("concepts", concept_id))


def product_for_entity(concepts: DataFrame, products: DataFrame) -> DataFrame:
    """Per concept, the one certified product whose grain is "one row per <concept name>".

    Concepts without exactly one get status ERROR and no product.
    """
    grain = F.concat(F.lit("one row per "), fold_case(F.col("name")))
    wanted = concepts.select(F.col("id").alias("concept_id"), grain.alias("grain"))
    offered = certified(products).select(
        F.col("id").alias("product_id"), fold_case(F.col("grain")).alias("grain"), "concepts"
    )
    exposed = offered.select("product_id", "grain", F.explode("concepts").alias("concept_id"))
    candidates = (
        exposed.groupBy("concept_id", "grain")
        .agg(F.count_distinct("product_id").alias("candidates"), F.min("product_id").alias("product_id"))
    )
    joined = wanted.join(candidates, ["concept_id", "grain"], "left")
    count = F.coalesce(F.col("candidates"), F.lit(0).cast("bigint"))
    return joined.select(
        "concept_id",
        F.when(count == 1, F.col("product_id")).alias("product_id"),
        count.alias("candidates"),
        F.when(count == 1, "OK").otherwise("ERROR").alias("status"),
    )


def products_for_request(
    entities: DataFrame, metrics: DataFrame, entity_products: DataFrame, metric_products: DataFrame
) -> DataFrame:
    """Products a request needs: its entities' first, then its metrics', in first-seen order.

    entities (request_id, pos, concept_id); metrics (request_id, pos, metric_id);
    entity_products (concept_id, product_id); metric_products (metric_id, pos, product_id).
    The first position of a product is a partial aggregate; the rank within a request follows.
    """
    by_entity = entities.join(entity_products, "concept_id").select(
        "request_id", F.array(F.lit(0), F.col("pos"), F.lit(0)).cast("array<bigint>").alias("at"),
        "product_id",
    )
    sources = metric_products.withColumnRenamed("pos", "_source_pos")
    by_metric = metrics.join(sources, "metric_id").select(
        "request_id",
        F.array(F.lit(1), F.col("pos"), F.col("_source_pos")).cast("array<bigint>").alias("at"),
        "product_id",
    )
    return by_entity.unionByName(by_metric).groupBy("request_id", "product_id").agg(
        F.min("at").alias("first_seen")
    )


def name_lookup(
    requests: DataFrame,
    assets: DataFrame,
    aliases: DataFrame | None = None,
) -> DataFrame:
    """Case-folded lookup of requests (request_id, name) in assets (id, name, synonyms, ordinal).

    An alias (alias, name) is resolved first; the earliest asset in order wins; an unknown
    name keeps its row with status UNKNOWN.
    """
    wanted = requests.withColumn("_name", fold_case(F.col("name")))
    if aliases is not None:
        alias_rows = aliases.select(
            fold_case(F.col("alias")).alias("_name"), fold_case(F.col("name")).alias("_target")
        )
        wanted = (
            wanted.join(alias_rows, "_name", "left")
            .withColumn("_name", F.coalesce("_target", "_name"))
            .drop("_target")
        )
    names = F.array_append(F.coalesce("synonyms", F.array().cast("array<string>")), F.col("name"))
    surfaces = (
        assets.select("id", "ordinal", F.explode(names).alias("_surface"))
        .groupBy(fold_case(F.col("_surface")).alias("_name"))
        .agg(F.min_by("id", "ordinal").alias("id"))
    )
    return wanted.join(surfaces, "_name", "left").select(
        "request_id", "name", "id",
        F.when(F.col("id").isNull(), "UNKNOWN").otherwise("OK").alias("status"),
    )
