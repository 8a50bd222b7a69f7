"""Vendor payloads as canonical rows: macro observations, analyst estimates, drug submissions and trials.

Input is what the vendor served, landed as files and read under the schemas here; nothing is fetched. Missing fields are
null, rows without their key fields are dropped, and empty inputs give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import names

# fixed values: days from an observation's date until it is known, where not 0
LAG_DAYS = {"BAMLH0A0HYM2": 1, "USREC": 180, "UNRATE": 1, "CPIAUCSL": 2}

OBSERVATIONS_SCHEMA = "series_id string, observations array<struct<date: string, value: string>>"
_RAW = "struct<raw: double>"
_TREND = f"struct<period: string, growth: {_RAW}, earningsEstimate: struct<avg: {_RAW}, numberOfAnalysts: {_RAW}>, epsTrend: struct<current: {_RAW}, `7daysAgo`: {_RAW}, `30daysAgo`: {_RAW}, `60daysAgo`: {_RAW}, `90daysAgo`: {_RAW}>, epsRevisions: map<string, {_RAW}>>"
ESTIMATES_SCHEMA = f"ticker string, fetched_date date, quoteSummary struct<result: array<struct<earningsTrend: struct<trend: array<{_TREND}>>>>>"
DRUGS_SCHEMA = "results array<struct<application_number: string, sponsor_name: string, products: array<struct<brand_name: string, active_ingredients: array<string>>>, submissions: array<struct<submission_type: string, submission_number: string, submission_status: string, submission_status_date: string, review_priority: string>>>>"


def _known(rows: DataFrame, lags: dict[str, int] | None) -> DataFrame:
    lag = F.lit(0)
    for series, days in (LAG_DAYS if lags is None else lags).items():
        lag = F.when(F.col("series_id") == series, days).otherwise(lag)
    rows = rows.select("series_id", F.expr("try_cast(day as date)").alias("event_date"), F.expr("try_cast(trim(value) as double)").alias("val"))
    return rows.filter("val is not null and event_date is not null").withColumn("knowledge_date", F.date_add("event_date", lag))


def macro_observations(docs: DataFrame, lags: dict[str, int] | None = None) -> DataFrame:
    """series_id, event_date, val, knowledge_date from API answers (OBSERVATIONS_SCHEMA); values that are no numbers are dropped."""
    return _known(docs.select("series_id", F.explode("observations").alias("o")).select("series_id", F.col("o.date").alias("day"), F.col("o.value").alias("value")), lags)


def macro_csv(rows: DataFrame, series_id: str, lags: dict[str, int] | None = None) -> DataFrame:
    """The same from a series' CSV, read with its header: the first column is the day, the second the value."""
    day, value = rows.columns[:2]
    return _known(rows.select(F.lit(series_id).alias("series_id"), F.col(day).cast("string").alias("day"), F.col(value).cast("string").alias("value")), lags)


def estimates(docs: DataFrame) -> DataFrame:
    """A row for each ticker, period and day of fetching (ESTIMATES_SCHEMA); periods without a name are dropped."""
    trend = docs.select(F.upper("ticker").alias("ticker"), "fetched_date", F.explode(F.get(F.col("quoteSummary.result"), F.lit(0))["earningsTrend"]["trend"]).alias("p")).filter("p.period <> ''")
    raw = lambda path: F.col(f"p.{path}.raw")
    revised = lambda *spelt: F.coalesce(*[F.col("p.epsRevisions")[s]["raw"] for s in spelt]).cast("int")
    ago = [raw(f"epsTrend.`{n}daysAgo`").alias(f"eps_trend_{n}d_ago") for n in (7, 30, 60, 90)]
    revisions = [revised("upLast7days").alias("revisions_up_7d"), revised("downLast7days", "downLast7Days").alias("revisions_down_7d"), revised("upLast30days").alias("revisions_up_30d"), revised("downLast30days", "downLast30Days").alias("revisions_down_30d")]
    return trend.select("ticker", F.col("p.period").alias("period"), "fetched_date", raw("earningsEstimate.avg").alias("avg_estimate"), raw("earningsEstimate.numberOfAnalysts").cast("int").alias("num_analysts"), raw("growth").alias("growth"), raw("epsTrend.current").alias("eps_trend_current"), *ago, *revisions)


def _listed(items: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.filter(items, lambda x: x.isNotNull() & (x != "")))), "; ")


def drug_events(docs: DataFrame) -> DataFrame:
    """A row for each submission (DRUGS_SCHEMA). Ingredients are names, or objects (read as JSON text) with a name; days are YYYYMMDD, else null."""
    r = docs.select(F.explode("results").alias("r")).select("r.*")
    parts = F.flatten(F.transform(F.coalesce("products", F.array()), lambda p: F.coalesce(p["active_ingredients"], F.array().cast("array<string>"))))
    plain = _listed(F.filter(parts, lambda x: ~x.startswith("{")))
    within = _listed(F.transform(F.filter(parts, lambda x: x.startswith("{")), lambda x: F.get_json_object(x, "$.name")))
    brand = _listed(F.transform("products", lambda p: p["brand_name"]))
    rows = r.select("application_number", "sponsor_name", F.coalesce(brand, F.lit("")).alias("brand"), F.when(plain != "", plain).otherwise(within).alias("substance"), F.explode("submissions").alias("s"))
    day = F.expr("case when length(s.submission_status_date) = 8 then cast(try_to_timestamp(s.submission_status_date, 'yyyyMMdd') as date) end")
    return rows.select("application_number", "sponsor_name", "brand", "substance", "s.submission_type", "s.submission_number", "s.submission_status", day.alias("event_date"), "s.review_priority")


def trials(studies: DataFrame, companies: DataFrame) -> DataFrame:
    """studies (nct_id, lead_sponsor, ...) of the companies (ticker, cik, name) that their sponsors resolve to, last row a (ticker, nct_id)."""
    sponsors = studies.filter("lead_sponsor is not null").select(F.col("lead_sponsor").alias("sponsor")).distinct()
    found = names.resolve(sponsors, companies.select("name", "cik")).join(companies.select("cik", "ticker").distinct(), "cik")
    return studies.join(found.withColumnRenamed("sponsor", "lead_sponsor"), "lead_sponsor").dropDuplicates(["ticker", "nct_id"])
