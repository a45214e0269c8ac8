"""Batch policy decisions, lineage and field evidence for metric requests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.session import literal_rows

# Classification ranks and the denial codes in the order they are tried.
CLASSIFICATION_RANK = {"Public": 0, "Internal": 1, "Confidential": 2, "Restricted": 3}
DECISIONS = (
    "ROLE_DENIED", "CALLER_CONTEXT_MISMATCH", "PRODUCT_DENIED", "CLASSIFICATION_DENIED",
    "PRODUCT_QUALITY_DENIED", "COUNTRY_SCOPE_DENIED", "PII_FIELD_DENIED", "ALLOWED",
)


@dataclass(frozen=True)
class RolePolicy:
    """What one role may read."""

    role: str
    products: Sequence[str]
    max_classification: str
    country_lock: str | None = None
    pii_blocked: bool = False
    ranks: Mapping[str, int] = field(default_factory=lambda: CLASSIFICATION_RANK)


_CLAIM_PRODUCTS = ("BusinessPartners", "SalesOrders", "ACDOCAFinancials")

# The role table.
ROLES = (
    RolePolicy("ClaimsAnalystFR", _CLAIM_PRODUCTS, "Restricted", "FR"),
    RolePolicy("ClaimsManagerGroup", _CLAIM_PRODUCTS, "Restricted"),
    RolePolicy("FinancialControllerFR", _CLAIM_PRODUCTS, "Restricted", "FR"),
    RolePolicy("FinancialControllerGroup", _CLAIM_PRODUCTS, "Restricted"),
    RolePolicy("FinanceAnalyst", ("BillingAnalytics",), "Confidential", pii_blocked=True),
)


def classification_rank(value: Column) -> Column:
    """Rank of a classification; null for an unknown one."""
    ranked = F.lit(None).cast("int")
    for name, rank in CLASSIFICATION_RANK.items():
        ranked = F.when(value == name, rank).otherwise(ranked)
    return ranked


def over_ceiling(classification: Column, ceiling: Column) -> Column:
    """Above the role's ceiling, or of unknown classification."""
    rank = classification_rank(classification)
    return rank.isNull() | (rank > classification_rank(ceiling))


def role_table(spark, roles: Sequence[RolePolicy] = ROLES) -> DataFrame:
    rows = [
        (r.role, list(r.products), r.max_classification, r.country_lock, r.pii_blocked) for r in roles
    ]
    return literal_rows(spark, 
        rows,
        "role string, allowed_products array<string>, max_classification string, "
        "country_lock string, pii_blocked boolean",
    )


def decide(
    requests: DataFrame, roles: DataFrame, products: DataFrame, pii_concepts: DataFrame
) -> DataFrame:
    """One decision per request: the first rule that fails, else ALLOWED.

    requests: request_id, role, plan_role, caller_country, plan_country, country (the filter),
    products and projected arrays. products: id, classification, quality_status.
    pii_concepts: location, concept (from mapping fields marked as PII). A request's products
    and concepts are exploded, looked up in the small catalogue and folded back by a partial
    aggregate, so requests never meet each other.
    """
    known = products.select(F.col("id").alias("_product"), "classification", "quality_status")
    judged = requests.join(roles, "role", "left")
    per_product = (
        judged.select("request_id", "max_classification", F.explode("products").alias("_product"))
        .join(known, "_product", "left")
        .groupBy("request_id")
        .agg(
            F.bool_or(
                F.col("quality_status").isNotNull()
                & over_ceiling(F.col("classification"), F.col("max_classification"))
            ).alias("_over"),
            F.bool_or(~F.coalesce(F.col("quality_status") == "CERTIFIED", F.lit(False))).alias("_unsafe"),
        )
    )
    # A concept that is PII in some country: match any country where the request names none.
    marked = pii_concepts.select("location", "concept").distinct()
    anywhere = marked.select(F.lit(None).cast("string").alias("location"), "concept").distinct()
    marked = marked.unionByName(anywhere).withColumnRenamed("location", "_location")
    projected = judged.where("pii_blocked").select(
        "request_id", F.col("country").alias("_country"), F.explode("projected").alias("concept")
    )
    per_concept = (
        projected.join(
            marked,
            (projected["concept"] == marked["concept"])
            & projected["_country"].eqNullSafe(marked["_location"]),
            "left_semi",
        )
        .select("request_id")
        .distinct()
        .withColumn("_pii", F.lit(True))
    )
    joined = judged.join(per_product, "request_id", "left").join(per_concept, "request_id", "left")

    def flag(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False))

    scope_differs = F.col("caller_country").isNotNull() & ~F.coalesce(
        F.col("country") == F.col("caller_country"), F.lit(False)
    )
    lock_broken = F.col("country_lock").isNotNull() & ~F.coalesce(
        F.col("country") == F.col("country_lock"), F.lit(False)
    )
    same_caller = (F.col("role") == F.col("plan_role")) & F.col("caller_country").eqNullSafe(
        F.col("plan_country")
    )
    outside = F.size(F.array_except("products", "allowed_products")) > 0
    failures = (
        F.col("allowed_products").isNull(), ~same_caller, outside, flag("_over"),
        flag("_unsafe"), scope_differs | lock_broken, flag("_pii"),
    )
    decision = F.lit(DECISIONS[-1])
    for code, failed in reversed(list(zip(DECISIONS, failures, strict=False))):
        decision = F.when(failed, code).otherwise(decision)
    return joined.select("request_id", decision.alias("decision"))


def granted_scopes(requests: DataFrame, decisions: DataFrame) -> DataFrame:
    """(request_id, country, product) of allowed requests; requests has those columns.

    Results are computed once for each distinct (country, product); requests point to theirs, so
    neither is multiplied by the other. A denied request has no scope.
    """
    allowed = decisions.where(F.col("decision") == "ALLOWED").select("request_id").distinct()
    return requests.select("request_id", "country", "product").join(allowed, "request_id", "left_semi")


def static_lineage(
    requests: DataFrame, mappings: DataFrame, metrics: DataFrame, vocabulary_version: str = "1.0.0"
) -> DataFrame:
    """Per request: the mapping of its country, physical sources, metric and asset versions.

    requests: request_id, country, products, metric_ids. mappings: mapping_id, version,
    location, data_products, physical_sources. Without one mapping for the country, or with a
    product outside it, the status says so and nothing is invented.
    """
    unique = mappings.groupBy(F.col("location").alias("country")).agg(
        F.count(F.lit(1)).alias("_mappings"),
        *[F.min(c).alias(c) for c in ("mapping_id", "version")],
        F.min("data_products").alias("data_products"),
        F.min("physical_sources").alias("physical_sources"),
    )
    joined = requests.join(unique, "country", "left")
    one = F.coalesce(F.col("_mappings") == 1, F.lit(False))
    inside = F.size(F.array_except("products", "data_products")) == 0
    status = F.when(~one, "NO_UNIQUE_MAPPING").when(~inside, "PRODUCT_OUTSIDE_MAPPING").otherwise("OK")
    versions = (
        requests.select("request_id", F.explode(F.array_distinct("metric_ids")).alias("metric_id"))
        .join(metrics.select(F.col("id").alias("metric_id"), F.col("version").alias("_v")), "metric_id")
        .groupBy("request_id")
        .agg(
            F.array_sort(F.collect_list(F.concat(F.lit("metric:"), "metric_id", F.lit("@"), "_v"))).alias("_metrics")
        )
    )
    asset_versions = F.concat(
        F.array(F.concat(F.lit("mapping@"), F.col("version")), F.lit(f"vocabulary@{vocabulary_version}")),
        F.coalesce("_metrics", F.array().cast("array<string>")),
    )
    ok = F.col("status") == "OK"
    return (
        joined.withColumn("status", status)
        .join(versions, "request_id", "left")
        .select(
            "request_id", "status", "products", "metric_ids",
            F.when(ok, F.col("mapping_id")).alias("mapping_id"),
            F.when(ok, F.col("physical_sources")).alias("physical_sources"),
            F.when(ok, F.array_sort(asset_versions)).alias("asset_versions"),
        )
    )


def request_concepts(
    mentions: DataFrame, metric_mentions: DataFrame, metrics: DataFrame, rules: DataFrame, concepts: DataFrame
) -> DataFrame:
    """Concepts each request touches, as distinct rows (request_id, concept_id).

    mentions (request_id, concept_id): root, dimensions, filter concepts and values, both ends
    of relationships. metric_mentions (request_id, metric_id) add the metric, its concept and
    its rule's target. Identifiers that are not concepts are dropped.
    """
    details = metrics.select(
        F.col("id").alias("metric_id"), F.col("concept").alias("_concept"), "filter_rule"
    ).join(
        rules.select(F.col("id").alias("filter_rule"), "applies_to"), "filter_rule", "left"
    )
    by_metric = metric_mentions.join(details, "metric_id", "left").select(
        "request_id", F.explode(F.array("metric_id", "_concept", "applies_to")).alias("concept_id")
    )
    reached = mentions.select("request_id", "concept_id").unionByName(by_metric).distinct()
    return reached.join(concepts.select(F.col("id").alias("concept_id")), "concept_id", "left_semi")


def field_evidence(requests: DataFrame, mapping_fields: DataFrame) -> DataFrame:
    """Source columns behind each canonical field a request uses, as distinct rows.

    requests: request_id, country, fields array; mapping_fields: location, canonical,
    source_table, physical_name.
    """
    used = requests.select("request_id", F.col("country").alias("location"), F.explode("fields").alias("canonical"))
    sources = mapping_fields.select(
        "location", "canonical", F.concat_ws(":", "source_table", "physical_name").alias("source")
    )
    return used.join(sources, ["location", "canonical"]).select(
        "request_id", F.concat(F.lit("field:"), "canonical").alias("field"), "source"
    ).distinct()
