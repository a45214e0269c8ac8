"""The given tables, and the business roles they play, in Spark and in SQL.

customer is the partner, orders the sales order and the billing document, lineitem the
posting; the region is the country and the market segment the product.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.metrics import AMOUNT
from weftline.schemas import MONEY
from weftline.session import spread

# The as-of date and the thresholds used by the registered metric queries.
AS_OF = date(2001, 6, 30)
COUNTRY, PRODUCT = 1, "AUTOMOBILE"

ORDER_STATUS = {"O": "RELEASED", "F": "CLOSED", "P": "CANCELLED"}
POSTING_STATUS = {"N": "POSTED", "A": "CLEARED", "R": "REVERSED"}


def recode(value: Column, codes: dict[str, str]) -> Column:
    result = F.lit(None).cast("string")
    for code, name in codes.items():
        result = F.when(value == code, name).otherwise(result)
    return result


def _case(column: str, codes: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in codes.items()) + " END"


class Tables:
    """Lazily read tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        self.__dict__[name] = table
        return table

    def rows(self, name: str) -> int:
        """How many rows a table has, which Parquet files state."""
        return getattr(self, name).count()

    def partners(self) -> DataFrame:
        nations = self.nation.select("n_nationkey", F.col("n_regionkey").alias("country"))
        return self.customer.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
            F.col("c_custkey").alias("partner_id"),
            F.col("c_name").alias("partner_name"),
            "country",
            F.col("c_mktsegment").alias("product"),
        )

    def sales_orders(self) -> DataFrame:
        return self.orders.select(
            F.col("o_orderkey").alias("sales_order_id"),
            F.col("o_custkey").alias("partner_id"),
            recode(F.col("o_orderstatus"), ORDER_STATUS).alias("order_status"),
            F.col("o_orderdate").cast("date").alias("effective_date"),
            F.col("o_totalprice").cast(MONEY).alias("net_value_eur"),
        )

    def postings(self) -> DataFrame:
        return self.lineitem.select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("journal_entry_id"),
            F.col("l_orderkey").alias("sales_order_id"),
            recode(F.col("l_returnflag"), POSTING_STATUS).alias("posting_status"),
            F.col("l_shipdate").cast("date").alias("posting_date"),
            F.col("l_extendedprice").cast(MONEY).alias(AMOUNT),
        )

    def billing(self) -> DataFrame:
        return self.orders.select(
            F.col("o_orderkey").alias("billing_doc_id"),
            F.col("o_orderkey").alias("sales_order_id"),
            F.col("o_custkey").alias("partner_id"),
            F.col("o_orderdate").cast("date").alias("billing_date"),
            F.col("o_totalprice").cast(MONEY).alias("billed_amount_eur"),
        )

    def note_components(self) -> DataFrame:
        """Part p is sold by supplier s: note p affects component s."""
        pairs = self.lineitem.select(F.col("l_partkey").alias("note"), F.col("l_suppkey").alias("component"))
        return spread(pairs, self.rows("lineitem"), "note", "component").distinct()

    def prerequisite_edges(self) -> DataFrame:
        """Each line of an order to the order's next line number."""
        lines = self.lineitem.select("l_orderkey", "l_linenumber").distinct()
        following = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"))
        key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
        return lines.join(following, ["l_orderkey", "l_linenumber"]).select(
            key.alias("src"), (key + 1).alias("dst")
        )


SQL_PARTNERS = """partners AS (
  SELECT c_custkey AS partner_id, c_name AS partner_name, n_regionkey AS country, c_mktsegment AS product
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
SQL_ORDERS = f"""sales_orders AS (
  SELECT o_orderkey AS sales_order_id, o_custkey AS partner_id,
         {_case('o_orderstatus', ORDER_STATUS)} AS order_status,
         CAST(o_orderdate AS DATE) AS effective_date, CAST(o_totalprice AS DECIMAL(18,2)) AS net_value_eur
  FROM orders)"""
SQL_POSTINGS = f"""postings AS (
  SELECT l_orderkey * 10 + l_linenumber AS journal_entry_id, l_orderkey AS sales_order_id,
         {_case('l_returnflag', POSTING_STATUS)} AS posting_status,
         CAST(l_shipdate AS DATE) AS posting_date, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount
  FROM lineitem)"""
SQL_BILLING = """billing AS (
  SELECT o_orderkey AS billing_doc_id, o_orderkey AS sales_order_id, o_custkey AS partner_id,
         CAST(o_orderdate AS DATE) AS billing_date, CAST(o_totalprice AS DECIMAL(18,2)) AS billed_amount_eur
  FROM orders)"""
SQL_EDGES = """edges AS (
  SELECT DISTINCT a.l_orderkey * 10 + a.l_linenumber AS src, b.l_orderkey * 10 + b.l_linenumber AS dst
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber)"""


def with_tables(*parts: str) -> str:
    """A WITH clause from the given definitions."""
    return "WITH " + ",\n".join(parts) + "\n"
