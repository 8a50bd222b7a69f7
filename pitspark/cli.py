"""Commands over a warehouse root: python -m pitspark --root ROOT COMMAND. Vendor commands land files already fetched."""

from __future__ import annotations

import argparse
import sys
from datetime import UTC, date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .facade import MIN_EQUITY, SERIES, Reads, serve
from .operators import macro as mac
from .operators import names
from .operators import panel as pan
from .sources import html_tables, landing, vendors, warehouse
from .streaming import ticks


def _facts(spark: SparkSession, path: str) -> DataFrame:
    rows = landing.flatten_company_facts(landing.scan_json(spark, path, landing.FACTS_SCHEMA))
    return rows.select("cik", "entity", "taxonomy", "tag", "unit", F.col("event_date").cast("string").alias("end"), F.col("knowledge_date").cast("string").alias("filed"), "val", "accn")


def _prices(spark: SparkSession, path: str) -> DataFrame:
    return landing.flatten_chart(landing.scan_json(spark, path, landing.CHART_SCHEMA)).withColumn("date", F.col("event_date").cast("string"))


def _actions(spark: SparkSession, path: str) -> DataFrame:
    return landing.chart_actions(landing.scan_json(spark, path, landing.CHART_SCHEMA)).withColumn("date", F.col("event_date").cast("string"))


def _macro(spark: SparkSession, path: str) -> DataFrame:
    return vendors.macro_observations(landing.scan_json(spark, path, vendors.OBSERVATIONS_SCHEMA))


def _estimates(spark: SparkSession, path: str) -> DataFrame:
    return vendors.estimates(landing.scan_json(spark, path, vendors.ESTIMATES_SCHEMA))


def _drugs(spark: SparkSession, path: str) -> DataFrame:
    return vendors.drug_events(landing.scan_json(spark, path, vendors.DRUGS_SCHEMA))


def _master(spark: SparkSession, path: str) -> DataFrame:
    return landing.scan_json(spark, path, "cik long, ticker string, name string, fetched_at string").withColumns({"ticker": F.upper("ticker"), "name_norm": names.normalize(F.col("name"))})


def _trials(spark: SparkSession, path: str) -> DataFrame:
    return landing.scan_json(spark, path, "nct_id string, trial_title string, status string, phases string, conditions string, interventions string, start_date string, completion_date string, lead_sponsor string")


#: command: table it lands in, reader of the fetched file
LANDS = {"ingest": ("fundamentals", _facts), "prices": ("prices", _prices), "crypto": ("prices", _prices), "fred": ("macro", _macro), "estimates": ("estimates", _estimates), "fda": ("drug_events", _drugs), "secmaster": ("security_master", _master), "pipeline": ("pipeline", _trials)}
#: A list of files is what a universe is here; these names stay for those used to them.
ALSO = {"ingest-universe": "ingest", "prices-universe": "prices", "pipeline-universe": "pipeline", "fda-universe": "fda", "estimates-universe": "estimates"}


def membership(spark: SparkSession, path: str) -> DataFrame:
    """Index membership from a page of two tables, constituents then changes, given as one HTML file a page.

    Constituents: ticker in the first cell, the day it was added in the sixth (null if unreadable). Changes: day, added
    ticker, its name, removed ticker. Tickers of another shape are dropped.
    """
    pages = spark.read.text(path, wholetext=True).select(F.lit(0).alias("page_id"), F.col("value").alias("html"))
    cells = html_tables.tables(pages).filter("row_no > 0")
    cell = lambda i: F.get("cells", F.lit(i))
    iso = lambda x: F.expr(f"try_cast(nullif(regexp_extract({x}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}', 0), '') as date)")  # noqa: E731  wherever it stands in the cell
    day = lambda x: F.coalesce(*[F.expr(f"cast(try_to_timestamp({{}}, '{f}') as date)".format(x)) for f in ("yyyy-MM-dd", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy")], iso(x))
    shape = F.col("ticker").rlike(r"^[A-Z][A-Z0-9]*([.\-][A-Z0-9]+)?$") & (F.length("ticker") <= 6)
    current = cells.filter("table_no = 0").select(names.norm_ticker(cell(0)).alias("ticker"), day("get(cells, 5)").alias("added")).filter(shape).dropDuplicates(["ticker"])
    log = cells.filter("table_no = 1").select(day("get(cells, 0)").alias("day"), F.explode(F.create_map(F.lit("added"), names.norm_ticker(cell(1)), F.lit("removed"), names.norm_ticker(cell(3)))).alias("kind", "ticker")).filter(shape)
    rows = names.reconstruct_membership(current, log)
    return rows.select(F.lit("SP500").alias("index_name"), "ticker", F.col("added").cast("string").alias("added_date"), F.col("removed").cast("string").alias("removed_date"))


def _backtest(reads: Reads) -> None:
    prices, facts, members = reads.table("prices"), reads.table("fundamentals"), reads.members()
    panel = pan.month_end(prices)
    covered, n = pan.coverage(prices.select("ticker").distinct(), facts, reads.tickers()).first()
    print(f"{covered} of {n} tickers have facts")
    rows = pan.eligible(panel, members).persist()
    for title, scored in (("momentum", rows.withColumn("score", F.col("mom"))), ("multifactor", pan.multifactor_scores(rows, facts, MIN_EQUITY, reads.tickers()))):
        returns = pan.backtest_rows(scored)
        for column in ("net", "bench"):
            print(title, column, pan.metrics(returns, column).first().asDict())
        labels = mac.regime_series(reads.table("macro"), returns.select(F.col("month").alias("day")), SERIES).select(F.col("day").alias("month"), "label")
        for x in pan.regime_breakdown(returns, labels).orderBy("label").collect():  # six labels
            print(f"  {x.label:<12} ({x.n:>3}m): strategy {x.strategy_year:+.1%} a year, bench {x.bench_year:+.1%}, alpha {x.alpha:+.1%}, Sharpe {x.sharpe:.2f}")
    rows.unpersist()


def _touch(spark: SparkSession, root: str, symbols: list[str], op: str) -> None:
    now = datetime.now(UTC).isoformat()
    spark.createDataFrame([(s.upper(), now, op) for s in symbols], "symbol string, at string, op string").write.mode("append").json(f"{root}/watch")


def _watched(spark: SparkSession, root: str) -> list[str]:
    if not warehouse.exists(spark, f"{root}/watch"):
        return []
    return [x["symbol"] for x in ticks.watched(spark.read.schema("symbol string, at string, op string").json(f"{root}/watch")).collect()]  # 500 at most


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="pitspark", description=__doc__)
    top.add_argument("--root", required=True, help="folder of raw/ and warehouse/, on any store Spark reads")
    sub = top.add_subparsers(dest="command", required=True)
    for name in [*LANDS, *ALSO, "sp500"]:
        sub.add_parser(name, help="land fetched files and rebuild").add_argument("files", nargs="+")
    for name in ("build", "backtest", "validate", "watched"):
        sub.add_parser(name)
    p = sub.add_parser("pit", help="a tag as known on a date")
    for name in ("ticker", "tag", "asof"):
        p.add_argument(name)
    p.add_argument("unit", nargs="?", default="USD")
    p = sub.add_parser("signals", help="members by composite score")
    p.add_argument("top", nargs="?", type=int, default=40)
    p.add_argument("--asof", default=date.today().isoformat())
    for name in ("watch", "unwatch", "realtime-latest"):
        sub.add_parser(name).add_argument("symbols", nargs="*" if name == "realtime-latest" else "+")
    p = sub.add_parser("serve", help="the reads over HTTP")
    p.add_argument("--port", type=int, default=8000)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(sys.argv[1:] if argv is None else argv)
    spark = spark or SparkSession.builder.appName("pitspark").getOrCreate()
    reads = Reads(spark, a.root)
    command = ALSO.get(a.command, a.command)
    if command in LANDS or command == "sp500":
        table, read = LANDS.get(command, ("index_membership", membership))
        for path in a.files:
            rows = read(spark, path)
            if command == "pipeline":  # sponsors resolve against the companies landed so far
                rows = vendors.trials(rows, warehouse.landed(spark, a.root, "security_master"))
            print(f"{table}: {warehouse.land(spark, a.root, table, rows)} new rows from {path}")
            if table == "prices":
                print(f"corporate_actions: {warehouse.land(spark, a.root, 'corporate_actions', _actions(spark, path))} new rows from {path}")
        print(warehouse.build(spark, a.root))
    elif command == "build":
        print(warehouse.build(spark, a.root))
    elif command == "pit":
        rows = reads.pit(a.ticker, a.tag, a.asof, a.unit)
        print(f"{a.ticker} {a.tag} as known on {a.asof}: {rows.count()} periods")
        for x in reversed(rows.orderBy(F.desc("event_date")).limit(8).collect()):
            print(f"  {x.event_date}  {x.val:>18,.0f}  (known {x.knowledge_date})")
    elif command == "signals":
        regime = reads.regime(a.asof)
        if regime["label"] != "unknown":
            print(regime["display"], *(f"{k}={regime[k]:.2f}" for k in mac.SERIES if regime[k] is not None))
        for i, x in enumerate(reads.signals(a.top, a.asof)["signals"], 1):
            print(i, x["ticker"], f"{x['composite']:+.3f}", *(f"{c}={'—' if x[c] is None else format(x[c], '.4g')}" for c in pan.FACTORS))
    elif command == "backtest":
        _backtest(reads)
    elif command == "validate":
        print(reads.validate())
    elif command in ("watch", "unwatch"):
        _touch(spark, a.root, a.symbols, "add" if command == "watch" else "remove")
    elif command == "watched":
        print(*_watched(spark, a.root), sep="\n")
    elif command == "realtime-latest":
        wanted = [s.upper() for s in a.symbols] or _watched(spark, a.root)
        ticks.latest(ticks.stored(spark, a.root).filter(F.col("ticker").isin(wanted))).orderBy("ticker").show(len(wanted) or 1, False)
    elif command == "serve":
        server = serve(reads, port=a.port)
        print(f"serving on port {server.server_port}")
        server.serve_forever()
