"""Macro series as known on a day, and the regime they make."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pit import as_of_join

SERIES = ("fed", "curve", "hys", "vix", "rec")
LIMITS = {"rec": 0.5, "vix_high": 25.0, "hys_high": 6.0, "curve": 0.0, "hys_low": 4.0, "vix_low": 20.0}


# fixed values: the labels as shown
DISPLAY = {"recession": "📉 RECESSION", "risk_off": "⚠️  RISK-OFF", "late_cycle": "🕐 LATE-CYCLE", "expansion": "🟢 EXPANSION", "recovery": "🔄 RECOVERY", "unknown": "❓ UNKNOWN (no macro data)"}


def classify(limits: dict | None = None) -> Column:
    """The label by strict priority; comparisons with null don't hold."""
    t = LIMITS | (limits or {})
    c = F.col
    yes = lambda x: F.coalesce(x, F.lit(False))
    missing = c(SERIES[0]).isNull()
    for s in SERIES[1:]:
        missing = missing | c(s).isNull()
    return F.when(yes(c("rec") >= t["rec"]), "recession").when(yes(c("vix") > t["vix_high"]) | yes(c("hys") > t["hys_high"]), "risk_off").when(yes(c("curve") < t["curve"]), "late_cycle").when(yes((c("curve") > t["curve"]) & (c("hys") < t["hys_low"]) & (c("vix") < t["vix_low"])), "expansion").when(missing, "unknown").otherwise("recovery")


def regime_series(macro: DataFrame, days: DataFrame, names: dict[str, str], limits: dict | None = None) -> DataFrame:
    """(day, five values, label) for each day; all series in one as-of join. names: series_id -> role."""
    ids = days.sparkSession.createDataFrame(list(names.items()), "series_id string, role string")
    probes = days.select("day").crossJoin(F.broadcast(ids))  # five rows
    known = as_of_join(probes.select("series_id", "day"), macro, "series_id")
    wide = known.join(F.broadcast(ids), "series_id").groupBy("day").pivot("role", list(SERIES)).agg(F.first("val"))
    return wide.withColumn("label", classify(limits))


def latest_with_date(macro: DataFrame, series_id: str) -> tuple[float, date]:
    """The newest value of a series and its day; raises LookupError if there is none."""
    found = macro.filter((F.col("series_id") == series_id) & F.col("val").isNotNull()).agg(F.max_by(F.struct("val", "event_date"), "event_date").alias("x")).first()["x"]
    if found is None:
        raise LookupError(f"no value of {series_id}")
    return found["val"], found["event_date"]


def snapshot(macro: DataFrame, ids: list[str]) -> DataFrame:
    """(series_id, value, event_date): the newest of each requested series; null where there is none."""
    wanted = macro.sparkSession.createDataFrame([(i,) for i in ids], "series_id string")
    last = macro.groupBy("series_id").agg(F.max_by(F.struct("val", "event_date"), "event_date").alias("x"))
    return wanted.join(last, "series_id", "left").select("series_id", F.col("x.val").alias("value"), F.col("x.event_date").alias("event_date"))
