"""The warehouse: landed JSON lines become canonical Parquet tables; rejected rows go to <table>_rejected with their reason.

A landing root holds raw/<source>/*.jsonl. All paths are read and written by Spark, so they may lie on any shared store.
Sources that haven't landed give empty tables. Landing one batch is a keyed merge: the new batch wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pit
from . import landing

#: table: source folder, schema of the landed rows, projection, landing key. A column that a file lacks is null.
TABLES: dict[str, tuple[str, str, list[str], list[str]]] = {
    "fundamentals": ("edgar", "cik long, entity string, taxonomy string, tag string, unit string, start string, end string, filed string, val double, accn string, fy string, fp string, form string, frame string", ["cik", "entity", "taxonomy", "tag", "unit", "try_cast(start as date) as start_date", "try_cast(`end` as date) as event_date", "try_cast(filed as date) as knowledge_date", "val", "accn", "fy", "fp", "form", "frame"], ["cik", "taxonomy", "tag", "unit", "start", "end", "accn"]),
    "prices": ("prices", "ticker string, date string, open double, high double, low double, close double, adjclose double, volume long, fetched_at string", ["ticker", "try_cast(date as date) as event_date", "open", "high", "low", "close", "adjclose", "volume", "try_cast(fetched_at as timestamp) as knowledge_ts"], ["ticker", "date"]),
    "corporate_actions": ("corporate_actions", "ticker string, date string, type string, value string", ["ticker", "try_cast(date as date) as event_date", "type", "value as action_value"], ["ticker", "date", "type"]),
    "pipeline": ("pipeline", "ticker string, cik long, nct_id string, trial_title string, status string, phases string, conditions string, interventions string, start_date string, completion_date string, lead_sponsor string", ["*"], ["ticker", "nct_id"]),
    "index_membership": ("sp500_membership", "index_name string, ticker string, added_date string, removed_date string", ["index_name", "ticker", "try_cast(added_date as date) as added_date", "try_cast(removed_date as date) as removed_date"], ["index_name", "ticker", "added_date", "removed_date"]),
    "security_master": ("security_master", "cik long, ticker string, name string, name_norm string, fetched_at string", ["cik", "ticker", "name", "name_norm", "try_cast(fetched_at as timestamp) as fetched_at"], ["cik", "ticker"]),
    "macro": ("fred", "series_id string, event_date string, knowledge_date string, val double, fetched_at string", ["series_id", "try_cast(event_date as date) as event_date", "try_cast(knowledge_date as date) as knowledge_date", "val", "try_cast(fetched_at as timestamp) as knowledge_ts"], ["series_id", "event_date"]),
    "estimates": ("estimates", "ticker string, period string, fetched_date string, avg_estimate double, num_analysts int, growth double, eps_trend_current double, eps_trend_7d_ago double, eps_trend_30d_ago double, eps_trend_60d_ago double, eps_trend_90d_ago double, revisions_up_7d int, revisions_down_7d int, revisions_up_30d int, revisions_down_30d int, fetched_at string", ["* except (fetched_date, fetched_at)", "try_cast(fetched_date as date) as fetched_date", "try_cast(fetched_at as timestamp) as knowledge_ts"], ["ticker", "period", "fetched_date"]),
    "drug_events": ("openfda", "application_number string, sponsor_name string, brand string, substance string, submission_type string, submission_number string, submission_status string, event_date string, review_priority string", ["* except (event_date)", "try_cast(event_date as date) as event_date"], ["application_number", "submission_type", "submission_number"]),
}
GATES = {"fundamentals": pit.gate, "prices": pit.gate_prices, "macro": pit.gate_macro}


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or pattern matches anything, on whatever store it lies."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(found.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(found))


def move(spark: SparkSession, old: str, new: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(new).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(path(new), True)
    if not fs.rename(path(old), path(new)):
        raise OSError(f"can't move {old} to {new}")


def landed(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The landed rows of a table's source, as they are."""
    folder, schema, _, _ = TABLES[table]
    path = f"{root}/raw/{folder}/*.jsonl"
    return landing.scan_json(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def land(spark: SparkSession, root: str, table: str, batch: DataFrame) -> int:
    """Merges a batch into a table's landed rows, last row a key within the batch; returns the number of new keys."""
    folder, schema, _, key = TABLES[table]
    old = landed(spark, root, table)
    named = batch.select([c for c in batch.columns if c in old.columns])
    new = spark.createDataFrame([], schema).unionByName(named, allowMissingColumns=True)
    order = F.monotonically_increasing_id()
    match = lambda a, b: [F.expr(f"a.`{k}` <=> b.`{k}`") for k in key]
    added = new.dropDuplicates(key).alias("a").join(old.alias("b"), match("a", "b"), "left_anti").count()
    merged = landing.merge(old.withColumn("_seq", order), new.withColumn("_seq", order), key, "_seq").drop("_seq")
    target = f"{root}/raw/{folder}/merged.jsonl"
    merged.write.mode("overwrite").json(target + ".next")
    stale = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/raw/{folder}/*.jsonl")
    fs = stale.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.globStatus(stale) or []:  # all their rows are in the merged ones
        if not status.getPath().toString().endswith("merged.jsonl"):
            fs.delete(status.getPath(), True)
    move(spark, target + ".next", target)
    return added


def build(spark: SparkSession, root: str) -> dict[str, int]:
    """All tables from landing, gated once, to <root>/warehouse; returns live rows by table."""
    counts = {}
    for table, (_, _, projection, _) in TABLES.items():
        rows = landed(spark, root, table).selectExpr(*projection)
        target = f"{root}/warehouse/{table}"
        if table in GATES:
            gated = GATES[table](rows)
            pit.live(gated).write.mode("overwrite").parquet(target)
            gated.filter("reject_reason is not null").withColumn("rejected_at", F.current_timestamp()).write.mode("overwrite").parquet(target + "_rejected")
        else:
            rows.write.mode("overwrite").parquet(target)
        counts[table] = spark.read.parquet(target).count()  # from the files' footers
    return counts


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/warehouse/{name}")
