"""The engine's canonical tables, built from the star-schema inputs; projections push down to the scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.strategies import TAGS as STATEMENT_TAGS

# fixed values: which fact each order priority stands for
TAGS = {"1-URGENT": "NetIncomeLoss", "2-HIGH": "StockholdersEquity", "3-MEDIUM": "Revenues", "4-NOT SPECIFIED": "GrossProfit", "5-LOW": "CommonStockSharesOutstanding"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars: ticker, event_date, open, high, low, close, adjclose, volume. Trades are ordered by their keys."""
    px = F.col("l_extendedprice") / F.col("l_quantity")
    at = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    rows = read(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("ticker"), F.col("l_shipdate").cast("date").alias("event_date"))
    return rows.agg(F.min_by(px, at).alias("open"), F.max(px).alias("high"), F.min(px).alias("low"), F.max_by(px, at).alias("close"), F.max_by(px, at).alias("adjclose"), F.sum("l_quantity").alias("volume"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bitemporal facts: cik, tag, event_date, knowledge_date, val, accn, fp."""
    tag = F.lit(None).cast("string")
    for priority, name in TAGS.items():
        tag = F.when(F.col("o_orderpriority") == priority, name).otherwise(tag)
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate", "o_orderstatus")
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(F.col("l_suppkey").alias("cik"), tag.alias("tag"), F.col("o_orderdate").cast("date").alias("event_date"), F.col("l_shipdate").cast("date").alias("knowledge_date"), F.col("l_extendedprice").alias("val"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")).alias("accn"), F.when(F.col("o_orderstatus") == "F", "FY").otherwise("Q").alias("fp"), F.when(F.col("o_orderstatus") == "F", "10-K").otherwise("10-Q").alias("form"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index membership intervals: ticker, added_date, removed_date; null is unbounded."""
    k = F.col("s_suppkey")
    added = F.when(k % 7 != 0, F.date_add(F.lit("1995-01-01").cast("date"), (k * 37 % 900).cast("int")))
    removed = F.when(k % 3 == 0, F.date_add(F.lit("1999-01-01").cast("date"), (k * 53 % 900).cast("int")))
    return read(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), k.cast("string")).alias("ticker"), added.alias("added_date"), removed.alias("removed_date"))


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id, event_date, knowledge_date (a fixed lag after the event), val: one value a series and day."""
    rows = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("series_id"), F.col("ts").cast("date").alias("event_date")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("val"))
    return rows.withColumn("knowledge_date", F.date_add("event_date", F.length("series_id") % 4))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("ticker"), "ts", "event_id", F.col("value").alias("price"), (F.col("event_id") % 10).alias("volume"))


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of the full set of statement tags: cik, tag, event_date, knowledge_date, val, accn."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    tag = F.element_at(F.array(*[F.lit(t) for t in STATEMENT_TAGS]), (F.col("l_partkey") % len(STATEMENT_TAGS) + 1).cast("int"))
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(F.col("l_suppkey").alias("cik"), tag.alias("tag"), F.col("o_orderdate").cast("date").alias("event_date"), F.col("l_shipdate").cast("date").alias("knowledge_date"), F.col("l_extendedprice").alias("val"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")).alias("accn"))


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corporate actions: ticker, event_date, type, action_value (text)."""
    kind = F.when(F.col("l_linenumber") == 1, "split").otherwise("dividend")
    return read(spark, sf_dir, "lineitem").select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("ticker"), F.col("l_shipdate").cast("date").alias("event_date"), kind.alias("type"), F.col("l_tax").cast("string").alias("action_value"))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regulatory events: cik, event_date, kind (catalyst, rejection, hold)."""
    kind = F.when(F.col("l_linenumber") < 6, "catalyst").when(F.col("l_linenumber") == 6, "rejection").otherwise("hold")
    return read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("cik"), F.col("l_shipdate").cast("date").alias("event_date"), kind.alias("kind"))


# The same tables for DuckDB.
SQL = {
    "bars": """SELECT 'S' || l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS event_date,
  arg_min(l_extendedprice / l_quantity, row(l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS open,
  max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
  arg_max(l_extendedprice / l_quantity, row(l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS close,
  arg_max(l_extendedprice / l_quantity, row(l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS adjclose,
  sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2""",
    "facts": """SELECT l_suppkey AS cik, CASE o_orderpriority WHEN '1-URGENT' THEN 'NetIncomeLoss' WHEN '2-HIGH' THEN 'StockholdersEquity'
  WHEN '3-MEDIUM' THEN 'Revenues' WHEN '4-NOT SPECIFIED' THEN 'GrossProfit' WHEN '5-LOW' THEN 'CommonStockSharesOutstanding' END AS tag,
  CAST(o_orderdate AS DATE) AS event_date, CAST(l_shipdate AS DATE) AS knowledge_date, l_extendedprice AS val,
  concat_ws('-', l_orderkey, l_linenumber, l_partkey) AS accn, CASE WHEN o_orderstatus = 'F' THEN 'FY' ELSE 'Q' END AS fp,
  CASE WHEN o_orderstatus = 'F' THEN '10-K' ELSE '10-Q' END AS form
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "members": """SELECT 'S' || s_suppkey AS ticker,
  CASE WHEN s_suppkey % 7 <> 0 THEN DATE '1995-01-01' + CAST(s_suppkey * 37 % 900 AS INTEGER) END AS added_date,
  CASE WHEN s_suppkey % 3 = 0 THEN DATE '1999-01-01' + CAST(s_suppkey * 53 % 900 AS INTEGER) END AS removed_date FROM supplier""",
    "macro": """SELECT event_type AS series_id, CAST(ts AS DATE) AS event_date, arg_max(value, row(ts, event_id)) AS val,
  CAST(ts AS DATE) + CAST(length(event_type) % 4 AS INTEGER) AS knowledge_date FROM events GROUP BY event_type, CAST(ts AS DATE)""",
    "statements": f"""SELECT l_suppkey AS cik, [{', '.join(repr(t) for t in STATEMENT_TAGS)}][CAST(l_partkey % {len(STATEMENT_TAGS)} + 1 AS INTEGER)] AS tag,
  CAST(o_orderdate AS DATE) AS event_date, CAST(l_shipdate AS DATE) AS knowledge_date, l_extendedprice AS val,
  concat_ws('-', l_orderkey, l_linenumber, l_partkey) AS accn FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "actions": "SELECT 'S' || l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS event_date, CASE WHEN l_linenumber = 1 THEN 'split' ELSE 'dividend' END AS type, CAST(l_tax AS VARCHAR) AS action_value FROM lineitem",
    "decisions": "SELECT l_suppkey AS cik, CAST(l_shipdate AS DATE) AS event_date, CASE WHEN l_linenumber < 6 THEN 'catalyst' WHEN l_linenumber = 6 THEN 'rejection' ELSE 'hold' END AS kind FROM lineitem",
    "ticks": "SELECT 'U' || user_id AS ticker, ts, event_id, value AS price, event_id % 10 AS volume FROM events",
}
