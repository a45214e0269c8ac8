"""Policy decisions, lineage, result digests and ledger checks over orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators import ledger, metrics, policy
from weftline.plans.business import _QUALIFIED as QUALIFIED
from weftline.plans.business import _SQL_JOINED, _joined
from weftline.plans.conforming import SQL_TREE_LEVELS
from weftline.plans.registry import register
from weftline.plans.tables import AS_OF, SQL_ORDERS, SQL_PARTNERS, SQL_POSTINGS, Tables, with_tables
from weftline.session import literal_rows

_CLAIMS = ("BusinessPartners", "SalesOrders", "ACDOCAFinancials")
_ROLES = (
    policy.RolePolicy("ClaimsAnalystFR", (*_CLAIMS, "Vault"), "Restricted", "FR"),
    policy.RolePolicy("ClaimsManagerGroup", (*_CLAIMS, "Vault", "Draft", "BillingAnalytics"), "Confidential"),
    policy.RolePolicy("FinanceAnalyst", ("BillingAnalytics", "Missing"), "Confidential", pii_blocked=True),
    policy.RolePolicy("FinancialControllerFR", (*_CLAIMS, "Draft"), "Restricted", "FR"),
)
_PRODUCTS = [
    ("BusinessPartners", "Restricted", "CERTIFIED"), ("SalesOrders", "Internal", "CERTIFIED"), ("ACDOCAFinancials", "Confidential", "CERTIFIED"),
    ("BillingAnalytics", "Confidential", "CERTIFIED"), ("Vault", "Secret", "CERTIFIED"), ("Draft", "Internal", "DEGRADED"),
]
_ASKED = {
    "AUTOMOBILE": ["SalesOrders", "ACDOCAFinancials"], "BUILDING": ["BillingAnalytics"], "FURNITURE": ["SalesOrders", "Vault"],
    "MACHINERY": ["BusinessPartners", "Draft"], "HOUSEHOLD": ["BillingAnalytics", "Missing"],
}


def _words(values: list[str]):
    return F.array(*[F.lit(v) for v in values])


def policy_requests(t: Tables) -> DataFrame:
    """One request per order: priority is the role, region the country, segment the products."""
    pri, st = F.col("o_orderpriority"), F.col("o_orderstatus")
    role = (
        F.when(pri == "1-URGENT", "ClaimsAnalystFR").when(pri == "2-HIGH", "ClaimsManagerGroup")
        .when(pri == "3-MEDIUM", "FinanceAnalyst").when(pri == "4-NOT SPECIFIED", "Intern").otherwise("FinancialControllerFR")
    )
    country = F.element_at(F.array(*[F.lit(c) for c in ("FR", "GB", "DE", "FR")]), F.col("n_regionkey") + 1)
    products = F.lit(None).cast("array<string>")
    for segment, values in _ASKED.items():
        products = F.when(F.col("c_mktsegment") == segment, _words(values)).otherwise(products)
    nations = t.nation.select("n_nationkey", "n_regionkey")
    customers = t.customer.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = t.orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("request_id"), role.alias("role"),
        F.when(F.col("o_totalprice") > 450_000, "Other").otherwise(role).alias("plan_role"),
        F.when(F.col("n_regionkey") < 4, country).alias("country"), st.alias("st"), products.alias("products"),
        F.when(st == "O", _words(["BusinessPartner"])).otherwise(_words(["CompanyCode"])).alias("projected"),
    )
    caller = F.when(F.col("st") == "O", F.col("country")).when(F.col("st") == "P", "FR")
    return rows.withColumn("caller_country", caller).withColumn("plan_country", caller)


def _decisions(t: Tables, requests: DataFrame) -> DataFrame:
    products = literal_rows(t.spark, _PRODUCTS, "id string, classification string, quality_status string")
    pii = literal_rows(t.spark, [("FR", "BusinessPartner"), ("GB", "BusinessPartner")], "location string, concept string")
    return policy.decide(requests, policy.role_table(t.spark, _ROLES), products, pii)


_SQL_POLICY = """req AS (SELECT o_orderkey AS request_id, o_orderpriority AS pri, o_orderstatus AS st, o_totalprice AS price, c_mktsegment AS seg, n_regionkey AS region,
   ['FR', 'GB', 'DE', 'FR', NULL][n_regionkey + 1] AS country FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey),
 dec AS (SELECT *, CASE
   WHEN pri = '4-NOT SPECIFIED' THEN 'ROLE_DENIED'
   WHEN price > 450000 THEN 'CALLER_CONTEXT_MISMATCH'
   WHEN (pri = '1-URGENT' AND seg NOT IN ('AUTOMOBILE', 'FURNITURE')) OR (pri = '2-HIGH' AND seg = 'HOUSEHOLD')
     OR (pri = '3-MEDIUM' AND seg NOT IN ('BUILDING', 'HOUSEHOLD')) OR (pri = '5-LOW' AND seg NOT IN ('AUTOMOBILE', 'MACHINERY')) THEN 'PRODUCT_DENIED'
   WHEN seg = 'FURNITURE' OR (pri = '2-HIGH' AND seg = 'MACHINERY') THEN 'CLASSIFICATION_DENIED'
   WHEN seg IN ('MACHINERY', 'HOUSEHOLD') THEN 'PRODUCT_QUALITY_DENIED'
   WHEN st = 'P' AND (country IS NULL OR country <> 'FR') THEN 'COUNTRY_SCOPE_DENIED'
   WHEN pri IN ('1-URGENT', '5-LOW') AND (country IS NULL OR country <> 'FR') THEN 'COUNTRY_SCOPE_DENIED'
   WHEN pri = '3-MEDIUM' AND st = 'O' AND (country IS NULL OR country IN ('FR', 'GB')) THEN 'PII_FIELD_DENIED'
   ELSE 'ALLOWED' END AS decision FROM req)"""


@register("l01_policy_decisions", with_tables(_SQL_POLICY) + "SELECT request_id, decision FROM dec")
def l01(t: Tables) -> DataFrame:
    return _decisions(t, policy_requests(t))


@register(
    "l02_classification_ceiling",
    """SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN true WHEN 'LARGE' THEN true WHEN 'MEDIUM' THEN true ELSE false END AS denied FROM part""",
)
def l02(t: Tables) -> DataFrame:
    """Unknown classes and classes above Internal are denied."""
    classes = {"PROMO": "Secret", "LARGE": "Restricted", "MEDIUM": "Confidential", "SMALL": "Internal", "ECONOMY": "Public", "STANDARD": "Public"}
    named = F.lit(None).cast("string")
    for kind, name in classes.items():
        named = F.when(F.col("p_type") == kind, name).otherwise(named)
    return t.part.select("p_partkey", policy.over_ceiling(named, F.lit("Internal")).alias("denied"))


def _scopes(t: Tables) -> DataFrame:
    """Allowed requests with the country and segment they ask for."""
    requests = policy_requests(t)
    asked = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("request_id"), F.col("c_mktsegment").alias("product")
    )
    return policy.granted_scopes(requests.join(asked, "request_id"), _decisions(t, requests))


def _scoped_result(t: Tables) -> DataFrame:
    """The flagship metric of every allowed scope; countries are codes of regions."""
    code = F.element_at(F.array(*[F.lit(c) for c in ("FR", "GB", "DE", "FR")]), F.col("country") + 1)
    partners = t.partners().withColumn("country", F.when(F.col("country") < 4, code))
    scoped = partners.select("partner_id", "country", "product")
    orders = t.sales_orders().join(scoped, "partner_id")
    postings = t.postings().join(orders.select("sales_order_id", "country", "product"), "sales_order_id")
    return metrics.scoped_metric(partners, orders, postings, _scopes(t), as_of=AS_OF)


_SQL_SCOPES = with_tables(_SQL_POLICY, SQL_PARTNERS, SQL_ORDERS, SQL_POSTINGS) + f""", scopes AS (
  SELECT request_id, country, seg AS product FROM dec WHERE decision = 'ALLOWED'),
 res AS (SELECT ['FR', 'GB', 'DE', 'FR', NULL][p.country + 1] AS country, p.product, partner_id, COUNT(DISTINCT journal_entry_id) AS posting_count,
    CAST(SUM(amount) AS DOUBLE) AS total_debit_loss_eur FROM partners p JOIN sales_orders USING (partner_id) JOIN postings USING (sales_order_id)
  WHERE {QUALIFIED} GROUP BY ALL HAVING COUNT(DISTINCT journal_entry_id) >= 3 AND SUM(amount) > 20000)
"""


@register(
    "l03_policy_scoped_read",
    _SQL_SCOPES + """SELECT country, product, partner_id, posting_count, total_debit_loss_eur, n AS requests
FROM res JOIN (SELECT country, product, COUNT(*) AS n FROM scopes GROUP BY ALL) USING (country, product)""",
)
def l03(t: Tables) -> DataFrame:
    """Every scope's rows once, with how many allowed requests read them."""
    asked = _scopes(t).groupBy("country", "product").agg(F.count(F.lit(1)).alias("requests"))
    return _scoped_result(t).join(asked, ["country", "product"]).withColumn(
        "total_debit_loss_eur", F.col("total_debit_loss_eur").cast("double")
    )


@register("l03_request_scopes", _SQL_SCOPES + "SELECT request_id, country, product FROM scopes")
def l03_requests(t: Tables) -> DataFrame:
    return _scopes(t)


_MAPPINGS = [
    ("FranceMap", "1.0.0", "FR", ["SalesOrders", "ACDOCAFinancials", "BillingAnalytics"], ["fr.orders", "fr.postings"]),
    ("GermanyMap", "2.1.0", "DE", ["SalesOrders", "ACDOCAFinancials"], ["de.ledger"]),
    ("BritainMap", "1.0.0", "GB", ["SalesOrders"], ["gb.a"]), ("BritainMapB", "1.0.0", "GB", ["SalesOrders"], ["gb.b"]),
]
_METRICS = [
    ("m:PostingCount", "1.0.0", "k:Posting", "r:Qualifying"), ("m:TotalLoss", "1.1.0", "k:Loss", "r:Qualifying"), ("m:Active", "2.0.0", "k:Order", None),
]


def _metric_table(t: Tables) -> DataFrame:
    return literal_rows(t.spark, _METRICS, "id string, version string, concept string, filter_rule string")


def _metric_requests(t: Tables) -> DataFrame:
    ids = F.when(F.col("st") == "O", _words(["m:TotalLoss", "m:PostingCount"])).otherwise(_words(["m:Active"]))
    return policy_requests(t).withColumn("metric_ids", ids)


@register(
    "l04_static_lineage",
    with_tables(_SQL_POLICY) + """, j AS (SELECT *, CASE WHEN country IS NULL OR country = 'GB' THEN 'NO_UNIQUE_MAPPING'
   WHEN seg = 'AUTOMOBILE' OR (seg = 'BUILDING' AND country = 'FR') THEN 'OK' ELSE 'PRODUCT_OUTSIDE_MAPPING' END AS status FROM req)
SELECT request_id, status, CASE WHEN status = 'OK' THEN CASE country WHEN 'FR' THEN 'FranceMap' ELSE 'GermanyMap' END ELSE '-' END AS mapping_id,
 CASE WHEN status = 'OK' THEN CASE country WHEN 'FR' THEN 'fr.orders,fr.postings' ELSE 'de.ledger' END ELSE '-' END AS sources,
 CASE WHEN status = 'OK' THEN CASE country WHEN 'FR' THEN 'mapping@1.0.0' ELSE 'mapping@2.1.0' END ||
   CASE WHEN st = 'O' THEN ',metric:m:PostingCount@1.0.0,metric:m:TotalLoss@1.1.0' ELSE ',metric:m:Active@2.0.0' END || ',vocabulary@1.0.0' ELSE '-' END AS versions FROM j""",
)
def l04(t: Tables) -> DataFrame:
    mappings = literal_rows(
        t.spark, _MAPPINGS, "mapping_id string, version string, location string, data_products array<string>, physical_sources array<string>"
    )
    lineage = policy.static_lineage(_metric_requests(t), mappings, _metric_table(t))
    return lineage.select(
        "request_id", "status", F.coalesce("mapping_id", F.lit("-")).alias("mapping_id"),
        F.coalesce(F.array_join("physical_sources", ","), F.lit("-")).alias("sources"),
        F.coalesce(F.array_join("asset_versions", ","), F.lit("-")).alias("versions"),
    )


@register(
    "l05_request_concepts",
    """WITH m AS (SELECT DISTINCT l_orderkey AS request_id, p_type AS concept_id FROM lineitem JOIN part ON p_partkey = l_partkey),
 k AS (SELECT o_orderkey AS request_id, unnest(CASE WHEN o_orderstatus = 'O' THEN ['k:Loss', 'k:Posting', 'm:TotalLoss'] ELSE ['k:Order'] END) AS concept_id FROM orders)
SELECT request_id, concept_id FROM m WHERE concept_id <> 'PROMO' UNION SELECT request_id, concept_id FROM k""",
)
def l05(t: Tables) -> DataFrame:
    """An order mentions the types of its parts; PROMO and two of the metrics are no concepts."""
    part = t.part.select("p_partkey", F.col("p_type").alias("concept_id"))
    mentions = t.lineitem.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("request_id"), "concept_id")
    asked = t.orders.select(
        F.col("o_orderkey").alias("request_id"),
        F.explode(F.when(F.col("o_orderstatus") == "O", _words(["m:TotalLoss", "m:PostingCount"])).otherwise(_words(["m:Active"]))).alias("metric_id"),
    )
    rules = literal_rows(t.spark, [("r:Qualifying", "k:Posting")], "id string, applies_to string")
    extra = literal_rows(t.spark, [("k:Loss",), ("k:Posting",), ("k:Order",), ("m:TotalLoss",)], "id string")
    concepts = t.part.where("p_type <> 'PROMO'").select(F.col("p_type").alias("id")).distinct().union(extra)
    return policy.request_concepts(mentions, asked, _metric_table(t), rules, concepts)


_FIELDS = [
    ("FR", "amount", "postings", "montant"), ("FR", "partner_id", "orders", "client"), ("FR", "partner_id", "partners", "client_id"),
    ("DE", "amount", "ledger", "betrag"), ("GB", "status", "orders", "state"),
]


@register(
    "l06_field_evidence",
    with_tables(_SQL_POLICY) + """SELECT request_id, 'field:amount' AS field, CASE country WHEN 'FR' THEN 'postings:montant' ELSE 'ledger:betrag' END AS source FROM req WHERE country IN ('FR', 'DE')
UNION ALL SELECT request_id, 'field:partner_id', unnest(['orders:client', 'partners:client_id']) FROM req WHERE country = 'FR' AND st = 'O'""",
)
def l06(t: Tables) -> DataFrame:
    fields = F.when(F.col("st") == "O", _words(["amount", "partner_id"])).otherwise(_words(["amount"]))
    catalog = literal_rows(t.spark, _FIELDS, "location string, canonical string, source_table string, physical_name string")
    return policy.field_evidence(policy_requests(t).withColumn("fields", fields), catalog)


@register(
    "n01_result_digest",
    _SQL_JOINED + """, res AS (SELECT partner_id, COUNT(DISTINCT journal_entry_id) AS posting_count FROM joined GROUP BY 1),
 leaves AS (SELECT sha256(partner_id || '|' || sha256('{"partner_id":' || partner_id || ',"posting_count":' || posting_count || '}')) AS h FROM res),
""" + SQL_TREE_LEVELS + ", (SELECT COUNT(*) FROM res) AS row_count FROM l1",
)
def n01(t: Tables) -> DataFrame:
    result = _joined(t).groupBy("partner_id").agg(metrics.posting_count())
    return ledger.result_digest(result, ["partner_id"])


def _honest_ledger(t: Tables) -> tuple[DataFrame, DataFrame]:
    """First and second records of the chains, one chain per order."""
    def record(name: str, value: str):
        ident = F.concat(F.col("chain_id"), F.lit(f"-{name}"))
        return ident, F.to_json(F.struct(ident.alias("query_id"), F.col(value).alias("value")))

    base = t.orders.select(
        F.col("o_orderkey").cast("string").alias("chain_id"), "o_totalprice", "o_orderstatus", F.col("o_orderpriority").alias("pri")
    )

    def entry(rows: DataFrame, name: str, value: str, sequence: int, previous) -> DataFrame:
        ident, document = record(name, value)
        return rows.select(
            "chain_id", "o_totalprice", "o_orderstatus", "pri", ident.alias("query_id"), document.alias("document"),
            F.lit("signed").alias("signature"), F.lit(sequence).cast("bigint").alias("sequence"), previous.alias("previous_hash"),
        ).withColumn("row_hash", ledger.chain_hash())

    first = entry(base, "open", "o_totalprice", 1, F.lit(ledger.GENESIS))
    second = entry(first, "close", "o_orderstatus", 2, F.col("row_hash"))
    return first, second


_LEDGER = ["chain_id", "query_id", "document", "signature", "sequence", "previous_hash", "row_hash"]


def _ledger_rows(t: Tables) -> int:
    """Two records of every order."""
    return 2 * t.rows("orders")


def order_ledger(t: Tables) -> tuple[DataFrame, DataFrame]:
    """A chain of two records per order, honestly hashed, then damaged by status and priority."""
    first, second = _honest_ledger(t)
    altered = F.when(F.col("o_orderstatus") == "P", F.concat("document", F.lit(" "))).otherwise(F.col("document"))
    moved = F.when((F.col("pri") == "2-HIGH") & (F.col("o_orderstatus") == "O"), F.lit(3)).otherwise(F.col("sequence")).cast("bigint")
    damaged = second.withColumn("document", altered).withColumn("sequence", moved)
    marks = second.where("NOT (pri = '5-LOW' AND o_orderstatus = 'F')").select("chain_id", F.lit(2).cast("bigint").alias("sequence"), "row_hash")
    return first.select(*_LEDGER).unionByName(damaged.select(*_LEDGER)), marks


_SQL_LEDGER = """v AS (SELECT CAST(o_orderkey AS VARCHAR) AS chain_id, CAST(2 AS VARCHAR) AS sequence, 'ROW_HASH' AS violation FROM orders WHERE o_orderstatus = 'P'
  UNION ALL SELECT CAST(o_orderkey AS VARCHAR), '3', unnest(['ROW_HASH', 'SEQUENCE_GAP']) FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '2-HIGH'
  UNION ALL SELECT CAST(o_orderkey AS VARCHAR), '-', 'CHECKPOINT_MISSING' FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '5-LOW')"""


@register("n02_ledger_verification", with_tables(_SQL_LEDGER) + "SELECT chain_id, sequence, violation FROM v")
def n02(t: Tables) -> DataFrame:
    found = ledger.ledger_violations(*order_ledger(t), rows=_ledger_rows(t))
    return found.withColumn("sequence", F.coalesce(F.col("sequence").cast("string"), F.lit("-")))


@register(
    "n03_trusted_records",
    with_tables(_SQL_LEDGER) + """SELECT CAST(o_orderkey AS VARCHAR) AS chain_id, o_orderkey || '-' || n AS query_id FROM orders, (VALUES ('open'), ('close')) AS x(n)
WHERE CAST(o_orderkey AS VARCHAR) NOT IN (SELECT chain_id FROM v)""",
)
def n03(t: Tables) -> DataFrame:
    return ledger.trusted_records(*order_ledger(t), _ledger_rows(t)).select("chain_id", "query_id")


@register(
    "n03_provenance_lookup",
    "SELECT CAST(o_orderkey AS VARCHAR) AS chain_id, o_orderkey || '-close' AS query_id, 'signed' AS signature FROM orders WHERE o_orderkey = 7",
)
def n03_lookup(t: Tables) -> DataFrame:
    """One record by its id, after every chain of the ledger has verified."""
    first, second = _honest_ledger(t)
    whole = first.select(*_LEDGER).unionByName(second.select(*_LEDGER))
    marks = second.select("chain_id", F.lit(2).cast("bigint").alias("sequence"), "row_hash")
    return ledger.provenance_lookup(whole, marks, "7-close", _ledger_rows(t)).select("chain_id", "query_id", "signature")
