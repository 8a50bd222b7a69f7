"""Landing: keyed merge of batches, and flattening of vendor JSON. Paths are read by Spark only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def scan_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines under an explicit schema: columns that a file lacks are null."""
    return spark.read.schema(schema).json(path)


def merge(old: DataFrame, new: DataFrame, key: str | Column | Sequence[str | Column], order: str) -> DataFrame:
    """Both batches, one row a key: the new batch wins, and the last row within a batch. key: a column or expression, or several."""
    key = [key] if isinstance(key, str | Column) else list(key)
    rows = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)), allowMissingColumns=True)
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("_batch"), F.desc(order)))
    return rows.withColumn("_rn", rank).filter("_rn = 1").drop("_rn", "_batch")


def flatten_company_facts(docs: DataFrame) -> DataFrame:
    """Nested facts {taxonomy {tag {units {unit [points]}}}} as rows; points without value or end are dropped."""
    rows = docs.select("cik", "entity", F.explode("facts").alias("taxonomy", "tags")).select("cik", "entity", "taxonomy", F.explode("tags").alias("tag", "body"))
    rows = rows.select("cik", "entity", "taxonomy", "tag", F.explode("body.units").alias("unit", "points")).select("cik", "entity", "taxonomy", "tag", "unit", F.explode("points").alias("p"))
    return rows.filter("p.val is not null and p.end is not null and p.end <> ''").select("cik", "entity", "taxonomy", "tag", "unit", F.expr("try_cast(p.end as date)").alias("event_date"), F.expr("try_cast(p.filed as date)").alias("knowledge_date"), F.col("p.val").cast("double").alias("val"), "p.accn")


FACTS_SCHEMA = "cik long, entity string, facts map<string, map<string, struct<units: map<string, array<struct<val: double, end: string, filed: string, accn: string>>>>>>"


CHART_SCHEMA = "ticker string, ts array<long>, open array<double>, high array<double>, low array<double>, close array<double>, adjclose array<double>, volume array<long>, dividends map<string, struct<date: long, amount: double>>, splits map<string, struct<date: long, numerator: string, denominator: string>>"


def flatten_chart(docs: DataFrame) -> DataFrame:
    """Price charts of parallel arrays (CHART_SCHEMA) as bars; null closes are dropped, and what an array lacks is null."""
    arrays = [c for c in ("ts", "open", "high", "low", "close", "adjclose", "volume") if c in docs.columns]
    rows = docs.select("ticker", F.explode(F.arrays_zip(*[F.coalesce(c, F.array().cast(docs.schema[c].dataType)).alias(c) for c in arrays])).alias("x"))
    columns = [F.col(f"x.{c}") for c in arrays if c != "ts"]
    return rows.filter("x.close is not null").select(F.upper("ticker").alias("ticker"), F.to_date(F.timestamp_seconds("x.ts")).alias("event_date"), *columns)


def chart_actions(docs: DataFrame) -> DataFrame:
    """(ticker, event_date, type, value) of the dividends and splits in price charts; a split is numerator/denominator."""
    day = lambda x: F.to_date(F.timestamp_seconds(f"{x}.date")).alias("event_date")
    paid = docs.select(F.upper("ticker").alias("ticker"), F.explode(F.map_values("dividends")).alias("d")).select("ticker", day("d"), F.lit("dividend").alias("type"), F.col("d.amount").cast("string").alias("value"))
    split = docs.select(F.upper("ticker").alias("ticker"), F.explode(F.map_values("splits")).alias("s")).select("ticker", day("s"), F.lit("split").alias("type"), F.concat_ws("/", "s.numerator", "s.denominator").alias("value"))
    return paid.unionByName(split)
