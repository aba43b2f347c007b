"""How the test tables stand for units, rosters, predictions, documents and claims; and the same bindings in SQL.

A unit is a nation, an entity a customer. Orders before CUTOFF give the prediction and its band, later ones the truth; the
nation's earlier orders give the naive rule. Orders are documents and their lines the claims that cite them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodeframe.session import table

CUTOFF, Z = "1998-07-01", 1.645


def items(spark: SparkSession, sf: str, key: str):
    """The passage that a row is paired with: all of them in turn."""
    return F.col(key) % table(spark, sf, "benchmark").count()


class Registry:
    """Queries and their SQL, collected by decorator."""

    def __init__(self):
        self.queries, self.oracles = {}, {}

    def __call__(self, sql: str | None = None):
        def keep(function):
            self.queries[function.__name__] = function
            if sql:
                self.oracles[function.__name__] = sql
            return function

        return keep


def history(spark: SparkSession, sf: str) -> DataFrame:
    """unit_id, entity_id, prediction, band and truth of each customer with later orders; nulls where there were none before."""
    customer = table(spark, sf, "customer").select(F.col("c_custkey").alias("entity_id"), F.col("c_nationkey").alias("unit_id"))
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("entity_id"), "o_totalprice", (F.col("o_orderdate") < F.lit(CUTOFF).cast("timestamp")).alias("early"))
    early = F.when(F.col("early"), F.col("o_totalprice"))
    each = orders.groupBy("entity_id").agg(F.avg(early).alias("point"), F.stddev_samp(early).alias("sd"), F.avg(F.when(~F.col("early"), F.col("o_totalprice"))).alias("y"))
    rows = customer.join(each, "entity_id")
    naive = orders.filter("early").join(customer, "entity_id").groupBy("unit_id").agg(F.avg("o_totalprice").alias("naive"), F.stddev_samp("o_totalprice").alias("naive_sd"))
    return rows.join(naive, "unit_id").filter("y is not null").select("unit_id", "entity_id", "point", "naive", "y", (F.col("point") - Z * F.col("sd")).alias("low"), (F.col("point") + Z * F.col("sd")).alias("high"), (F.col("naive") - Z * F.col("naive_sd")).alias("naive_low"), (F.col("naive") + Z * F.col("naive_sd")).alias("naive_high"))


HISTORY = f"""
early AS (SELECT o_custkey AS entity_id, o_totalprice, o_orderdate < TIMESTAMP '{CUTOFF}' AS early FROM orders),
per AS (SELECT entity_id, avg(o_totalprice) FILTER (early) AS point, stddev_samp(o_totalprice) FILTER (early) AS sd, avg(o_totalprice) FILTER (NOT early) AS y FROM early GROUP BY entity_id),
rule AS (SELECT c_nationkey AS unit_id, avg(o_totalprice) AS naive, stddev_samp(o_totalprice) AS naive_sd FROM early JOIN customer ON c_custkey = entity_id WHERE early GROUP BY 1),
history AS (
  SELECT c_nationkey AS unit_id, entity_id, point, naive, y, point - {Z} * sd AS low, point + {Z} * sd AS high, naive - {Z} * naive_sd AS naive_low, naive + {Z} * naive_sd AS naive_high
  FROM customer JOIN per ON entity_id = c_custkey JOIN rule ON unit_id = c_nationkey WHERE y IS NOT NULL
)"""


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as documents: one in three isn't in the corpus, one in five has no date, one in seven is shared."""
    o = table(spark, sf, "orders")
    key = F.col("o_orderkey")
    return o.filter(key % 3 != 0).select(F.concat(F.lit("ORD-"), key.cast("string")).alias("doc_id"), F.when(key % 5 != 0, F.col("o_orderdate").cast("date")).alias("doc_date"), (key % 7 == 0).alias("shared"), F.when(key % 2 == 0, F.array(F.col("o_custkey"))).alias("entity_ids"), F.concat(F.lit("Order priority "), F.col("o_orderpriority"), F.lit(" at "), F.col("o_totalprice").cast("string")).alias("text"))


def claims(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as claims: a supplier cites the line's order, by the ship date as cutoff; one in eleven ids is hostile."""
    line = table(spark, sf, "lineitem")
    key = F.col("l_orderkey")
    doc = F.when(key % 11 == 0, F.concat(F.lit("../ORD-"), key.cast("string"))).otherwise(F.concat(F.lit("ORD-"), key.cast("string")))
    return line.select(F.col("l_suppkey").alias("entity_id"), doc.alias("doc_id"), F.col("l_shipdate").cast("date").alias("cutoff"), F.col("l_linenumber").alias("pos"), key.alias("order_key"), "l_returnflag", "l_partkey")


CLAIMS = """
docs AS (SELECT 'ORD-' || o_orderkey AS doc_id, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate::DATE END AS doc_date, o_orderkey % 7 = 0 AS shared,
  CASE WHEN o_orderkey % 2 = 0 THEN [o_custkey] END AS entity_ids, 'Order priority ' || o_orderpriority || ' at ' || o_totalprice AS text FROM orders WHERE o_orderkey % 3 <> 0),
claims AS (SELECT l_suppkey AS entity_id, CASE WHEN l_orderkey % 11 = 0 THEN '../' ELSE '' END || 'ORD-' || l_orderkey AS doc_id, l_shipdate::DATE AS cutoff, l_linenumber AS pos, l_orderkey AS order_key, l_returnflag, l_partkey FROM lineitem)"""


def place(keys: list[str], order: str):
    return F.row_number().over(W.partitionBy(*keys).orderBy(order)) - 1
