"""Point-in-time operators over bitemporal facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Knowledge first, then the newer event, then the accession number, so no tie is left open.
LATEST = ("knowledge_date", "event_date", "accn")


def _finite(x: str) -> Column:
    return ~F.isnan(x) & (F.abs(F.col(x)) != float("inf"))


def gate(facts: DataFrame) -> DataFrame:
    """facts with reject_reason (null: accepted); reasons in order of precedence."""
    c = F.col
    return facts.withColumn("reject_reason", F.when(c("knowledge_date").isNull(), "null_knowledge_date").when(c("event_date").isNull(), "null_event_date").when(c("knowledge_date") < c("event_date"), "lookahead").when(c("val").isNull(), "null_value").when(~_finite("val"), "non_finite_value"))


def gate_macro(macro: DataFrame) -> DataFrame:
    """macro with reject_reason; a series may be known ahead of its day."""
    c = F.col
    return macro.withColumn("reject_reason", F.when(c("knowledge_date").isNull(), "null_knowledge_date").when(c("event_date").isNull(), "null_event_date").when(c("val").isNull(), "null_value").when(~_finite("val"), "non_finite_value"))


def gate_prices(bars: DataFrame) -> DataFrame:
    """bars with reject_reason."""
    c = F.col
    return bars.withColumn("reject_reason", F.when(c("event_date").isNull(), "null_event_date").when(c("close").isNull(), "null_close").when(~_finite("close"), "non_finite_close").when(c("close") <= 0, "nonpositive_close").when(c("volume") < 0, "negative_volume").when(c("high") < c("low"), "corrupt_ohlc"))


def live(gated: DataFrame) -> DataFrame:
    return gated.filter("reject_reason is null").drop("reject_reason")


def as_of(facts: DataFrame, cik, tag: str, asof: str) -> DataFrame:
    """Per event date the value known last on the date; the filters reach the scan."""
    seen = facts.filter((F.col("cik") == cik) & (F.col("tag") == tag) & (F.col("knowledge_date") <= F.lit(asof).cast("date")))
    rank = F.row_number().over(Window.partitionBy("event_date").orderBy(F.desc("knowledge_date"), F.desc("accn")))
    return seen.withColumn("rn", rank).filter("rn = 1").select("event_date", "val", "knowledge_date", *[c for c in ("form",) if c in facts.columns], "accn")


def latest_per_tag(facts: DataFrame, asof: Column) -> DataFrame:
    """(cik, tag, val): the newest known value, not older than three years; one aggregation for all tags."""
    seen = facts.filter((F.col("knowledge_date") <= asof) & (F.col("event_date") >= F.add_months(asof, -36)))
    return seen.groupBy("cik", "tag").agg(F.max_by("val", F.struct(*LATEST)).alias("val"))


def latest_by_month(facts: DataFrame, months: DataFrame) -> DataFrame:
    """(month, cik, tag, val): latest_per_tag for each first of a month of months (month), in one plan.

    Knowledge comes first in the order, so a fact holds from the first month that knows it until the next known one: facts
    are cut down to one a (cik, tag, month first known), and only the months they hold are made. Where the fact that holds
    is older than three years, another one known before may not be; those few months are looked up among all facts.
    """
    first = F.when(F.dayofmonth("knowledge_date") == 1, F.col("knowledge_date")).otherwise(F.add_months(F.trunc("knowledge_date", "MM"), 1))
    known = facts.groupBy("cik", "tag", first.alias("since")).agg(F.max_by(F.struct("val", "event_date"), F.struct(*LATEST)).alias("x"))
    until = F.lead("since").over(Window.partitionBy("cik", "tag").orderBy("since"))
    last = F.broadcast(months.agg(F.max("month").alias("last")))  # one row
    held = known.select("cik", "tag", "since", "x.*", until.alias("until")).crossJoin(last)
    end = F.least(F.add_months("until", -1), F.col("last"))
    held = held.filter(F.col("since") <= end).withColumn("month", F.explode(F.sequence("since", end, F.expr("interval 1 month")))).join(F.broadcast(months), "month", "left_semi")  # months: bounded by the calendar
    fresh = F.col("event_date") >= F.add_months("month", -36)
    stale = held.filter(~fresh).select("month", "cik", "tag")
    older = stale.join(facts, ["cik", "tag"]).filter((F.col("knowledge_date") <= F.col("month")) & fresh)
    older = older.groupBy("month", "cik", "tag").agg(F.max_by("val", F.struct(*LATEST)).alias("val"))
    return held.filter(fresh).select("month", "cik", "tag", "val").unionByName(older)


def members_at(members: DataFrame, day: Column) -> Column:
    """Whether a membership row holds on the day."""
    return (F.col("added_date").isNull() | (F.col("added_date") <= day)) & (F.col("removed_date").isNull() | (F.col("removed_date") > day))


def as_of_join(probes: DataFrame, facts: DataFrame, key: str, at: str = "day") -> DataFrame:
    """probes (key, at) with the value known last on that day: a union and a running last value, so neither side is broadcast."""
    line = probes.select(key, F.col(at).alias("t"), F.lit(1).alias("kind"), F.lit(None).cast("date").alias("e"), F.lit(None).cast("double").alias("val"))
    known = facts.select(key, F.col("knowledge_date").alias("t"), F.lit(0).alias("kind"), F.col("event_date").alias("e"), F.col("val").cast("double").alias("val"))
    w = Window.partitionBy(key).orderBy("t", "kind", "e").rowsBetween(Window.unboundedPreceding, 0)
    return line.unionByName(known).withColumn("val", F.last("val", ignorenulls=True).over(w)).filter("kind = 1").select(key, F.col("t").alias(at), "val")
