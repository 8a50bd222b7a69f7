"""Ticks: the store they are appended to, latest, recent and expiring ones, as batch operators and as a stream."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import warehouse

#: Rows of the tick store.
SCHEMA = "ticker string, price double, change double, volume long, ts timestamp, event_id long, source string"


def latest(ticks: DataFrame) -> DataFrame:
    """(ticker, price, change, volume, ts) of each ticker's last tick; a missing change or volume is 0."""
    has = [c for c in ("change", "volume") if c in ticks.columns]
    last = ticks.groupBy("ticker").agg(F.max_by(F.struct("price", *has), F.struct("ts", "event_id")).alias("x"), F.max("ts").alias("ts"))
    value = {c: F.coalesce(F.col(f"x.{c}"), F.lit(0)) if c in has else F.lit(0) for c in ("change", "volume")}
    return last.select("ticker", "x.price", value["change"].cast("double").alias("change"), value["volume"].cast("long").alias("volume"), "ts")


def recent(ticks: DataFrame, n: int = 20) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("ts"), F.desc("event_id")))
    return ticks.withColumn("rn", rank).filter(F.col("rn") <= n)


def unexpired(ticks: DataFrame, hours: int = 24) -> DataFrame:
    """Ticks of the last hours before the newest one."""
    newest = ticks.agg(F.max("ts").alias("newest"))
    return ticks.join(F.broadcast(newest), F.col("ts") >= F.col("newest") - F.expr(f"interval {hours} hours")).drop("newest")  # one row


def percent_change(ticks: DataFrame) -> DataFrame:
    """Change against the ticker's tick before, in percent; 0 for the first and after a price of 0."""
    before = F.lag("price").over(Window.partitionBy("ticker").orderBy("ts", "event_id"))
    return ticks.withColumn("p", before).select("ticker", "ts", "event_id", F.when(F.col("p") != 0, (F.col("price") - F.col("p")) / F.col("p") * 100).otherwise(0.0).alias("change"))


def watched(touches: DataFrame, most: int = 500) -> DataFrame:
    """The watch list: the symbols touched last (symbol, at, op), upper case; removed ones leave."""
    last = touches.groupBy(F.upper("symbol").alias("symbol")).agg(F.max_by("op", "at").alias("op"), F.max("at").alias("at"))
    return last.filter("op = 'add'").orderBy(F.desc("at"), "symbol").limit(most).select("symbol", "at")


# the store: Parquet by day, so that old days go without a rewrite
def stored(spark: SparkSession, root: str) -> DataFrame:
    path = f"{root}/ticks"
    return spark.read.schema(f"{SCHEMA}, day date").parquet(path).drop("day") if warehouse.exists(spark, f"{path}/day=*") else spark.createDataFrame([], SCHEMA)


def append(ticks: DataFrame, root: str) -> None:
    """Adds ticks to the store; columns that are missing are null."""
    rows = ticks.sparkSession.createDataFrame([], SCHEMA).unionByName(ticks, allowMissingColumns=True)
    rows.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(f"{root}/ticks")


def expire(spark: SparkSession, root: str, now: datetime, hours: int = 24) -> int:
    """Deletes the ticks that are over some hours old; returns how many. Whole days go as folders, the day of the limit is written anew."""
    limit = F.lit(now).cast("timestamp") - F.expr(f"interval {hours} hours")
    rows = stored(spark, root).withColumn("day", F.to_date("ts"))
    old = rows.filter(F.col("ts") < limit).groupBy("day").agg(F.count("*").alias("n")).collect()  # a row a day
    if not old:
        return 0
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    for x in old:
        folder = f"{root}/ticks/day={x['day']}"
        left = spark.read.schema(SCHEMA).parquet(folder).filter(F.col("ts") >= limit)
        if left.isEmpty():
            fs_path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).delete(fs_path(folder), True)
        else:
            left.write.mode("overwrite").parquet(f"{root}/ticks-next")
            warehouse.move(spark, f"{root}/ticks-next", folder)
    return sum(x["n"] for x in old)


def poll(spark: SparkSession, root: str, symbols: list[str], fetch: Callable[[str], dict | None], source: str = "poll", pace: float = 0.05, sleep: Callable[[float], None] = time.sleep) -> dict[str, dict]:
    """One round over the watched symbols (500 at most): what fetch gives for each (price, change, volume; None: nothing) is stored and returned."""
    found = {}
    for s in symbols:
        tick = fetch(s)
        if tick:
            found[s] = tick
        sleep(pace)
    if found:
        now = datetime.now(UTC)
        rows = [(s, float(t["price"]), float(t.get("change") or 0), int(t.get("volume") or 0), now, k, source) for k, (s, t) in enumerate(found.items())]
        append(spark.createDataFrame(rows, SCHEMA), root)
    return found


def watch(spark: SparkSession, root: str, symbols: Callable[[], list[str]], fetch: Callable[[str], dict | None], interval: float = 60.0, rounds: int | None = None, sleep: Callable[[float], None] = time.sleep) -> int:
    """Polls round after round, with the symbols as they are then; a round that fails doesn't end the loop. Returns the ticks stored."""
    n, done = 0, 0
    while rounds is None or done < rounds:
        try:
            n += len(poll(spark, root, symbols(), fetch, sleep=sleep))
        except OSError as e:  # the source or the store; the next round may do better
            print(f"poll failed: {e}")
        done += 1
        sleep(interval)
    return n


def percent_of_two(closes: list[float], volume: int | None = None) -> dict | None:
    """A tick from the last two closes of a chart: price, its change in percent and the volume."""
    if not closes:
        return None
    before = closes[-2] if len(closes) > 1 else closes[-1]
    return {"price": closes[-1], "change": (closes[-1] - before) / before * 100 if before else 0.0, "volume": int(volume or 0)}


def stream_latest(spark: SparkSession, folder: str, pattern: str, schema, sink: str | None = None, late: str = "24 hours") -> DataFrame:
    """Latest tick per ticker as a stream over the Parquet files of a folder, run until all files are read.

    A repeated event counts once within the watermark, and its state is dropped after it. Each batch appends its tickers'
    latest ticks to the sink, as Parquet; the answer is the latest of these. State stays on the executors.
    """
    if sink is None:
        sink = f"{spark.conf.get('spark.checkpoint.dir', None) or 'file://' + tempfile.mkdtemp(prefix='pitspark-')}/pitspark-ticks-{uuid.uuid4().hex}"
    rows = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
    rows = rows.select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("ticker"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("value").alias("price"))
    once = rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])

    def keep(batch: DataFrame, number: int) -> None:
        batch.groupBy("ticker").agg(F.max_by("price", F.struct("ts", "event_id")).alias("price"), F.max(F.struct("ts", "event_id")).alias("at")).write.mode("overwrite").parquet(f"{sink}/rows/batch={number}")  # a batch that is run again replaces itself

    query = once.writeStream.foreachBatch(keep).option("checkpointLocation", f"{sink}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    kept = "ticker string, price double, at struct<ts: timestamp, event_id: long>"
    parts = spark.read.schema(kept).parquet(f"{sink}/rows/*") if warehouse.exists(spark, f"{sink}/rows/*") else spark.createDataFrame([], kept)
    return parts.groupBy("ticker").agg(F.max_by("price", "at").alias("price"), F.max("at.ts").alias("ts"))
