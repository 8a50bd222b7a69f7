"""Reads over a built warehouse, as plain Python values of bounded size, kept for some seconds; and the same over HTTP."""

from __future__ import annotations

import functools
import json
import time
from datetime import date
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qsl, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import macro as mac
from .operators import panel as pan
from .operators import pit
from .sources import warehouse

# fixed values: the curated universes
UNIVERSES = {
    "general": ["AAPL", "MSFT", "GOOGL", "AMZN", "NVDA", "META", "JPM", "XOM", "WMT", "KO", "PG", "HD", "DIS", "INTC", "CSCO"],
    "pharma_biotech": ["JNJ", "PFE", "MRK", "ABBV", "LLY", "GILD", "AMGN", "MRNA", "BIIB", "REGN", "VRTX", "BMY"],
    "crypto": ["BTC-USD", "ETH-USD", "SOL-USD", "BNB-USD", "XRP-USD", "ADA-USD", "DOGE-USD", "AVAX-USD", "LINK-USD", "DOT-USD"],
}
UNIVERSES["default"] = UNIVERSES["general"] + UNIVERSES["pharma_biotech"]
# fixed values: the series behind the regime
SERIES = {"DFF": "fed", "T10Y2Y": "curve", "BAMLH0A0HYM2": "hys", "VIXCLS": "vix", "USREC": "rec"}
#: Equity below this doesn't make a return on it.
MIN_EQUITY = 1e6


class NotFound(LookupError):
    """There is no data for the request."""


def cached(seconds: float):
    """Keeps a read's answer by name and arguments, for its object."""

    def wrap(f):
        @functools.wraps(f)
        def call(self, *args, **kwargs):
            key, now = (f.__name__, args, tuple(sorted(kwargs.items()))), self.clock()
            hit = self.kept.get(key)
            if hit is None or hit[0] <= now:
                hit = self.kept[key] = (now + seconds, f(self, *args, **kwargs))
                self.kept = {k: x for k, x in self.kept.items() if x[0] > now}
            return hit[1]

        return call

    return wrap


def _bounded(name: str, value: int, most: int) -> int:
    if not 1 <= int(value) <= most:
        raise ValueError(f"{name} must be from 1 to {most}")
    return int(value)


class Reads:
    """Reads of one warehouse root. Dates are ISO text, today by default."""

    def __init__(self, spark: SparkSession, root: str, clock=time.monotonic) -> None:
        self.spark, self.root, self.clock, self.kept = spark, root, clock, {}

    def table(self, name: str) -> DataFrame:
        return warehouse.table(self.spark, self.root, name)

    def tickers(self) -> DataFrame:
        """(cik, ticker): one cik a ticker, the one that landed first."""
        return self.table("security_master").filter("cik is not null").groupBy(F.upper("ticker").alias("ticker")).agg(F.min_by("cik", F.struct("fetched_at", "cik")).alias("cik"))

    def members(self, index: str = "SP500") -> DataFrame:
        return self.table("index_membership").filter(F.col("index_name") == index).select("ticker", "added_date", "removed_date")

    def pit(self, ticker: str, tag: str, asof: str, unit: str = "USD") -> DataFrame:
        """Values of a company's tag as known on a date, by event date."""
        cik = self.tickers().filter(F.col("ticker") == ticker.upper()).first()
        if cik is None:
            raise NotFound(f"unknown ticker {ticker}")
        return pit.as_of(self.table("fundamentals").filter(F.col("unit") == unit), cik["cik"], tag, asof).orderBy("event_date")

    def ranked(self, asof: str) -> DataFrame:
        """Members by composite score; all listed names where no membership has landed."""
        members = self.members()
        prices = self.table("prices")
        if members.isEmpty():
            members = prices.select("ticker").distinct().select("ticker", F.lit(None).cast("date").alias("added_date"), F.lit(None).cast("date").alias("removed_date"))
        rows = pan.rank(prices, self.table("fundamentals"), members.dropDuplicates(), asof, min_equity=MIN_EQUITY, tickers=self.tickers())
        return rows.orderBy(F.desc("composite"), "ticker")

    @cached(60)
    def health(self) -> dict:
        return {"status": "ok", "prices_count": self.table("prices").count(), "fundamentals_count": self.table("fundamentals").count(), "fred_loaded": not self.table("macro").isEmpty()}

    @cached(30)
    def signals(self, top: int = 40, asof: str | None = None, universe: str | None = None) -> dict:
        top, asof = _bounded("top", top, 200), asof or date.today().isoformat()
        rows = self.ranked(asof)
        if rows.isEmpty():
            raise NotFound("no signal data")
        if universe:
            rows = rows.filter(F.col("ticker").isin(self.universe(universe)["tickers"]))
        found = [x.asDict() for x in rows.limit(top).collect()]
        return {"asof": asof, "count": len(found), "signals": found}

    @cached(300)
    def factors(self, ticker: str, asof: str | None = None) -> dict:
        asof, ticker = asof or date.today().isoformat(), ticker.upper()
        own = self.tickers().filter(F.col("ticker") == ticker)
        facts = self.table("fundamentals").join(F.broadcast(own.select("cik")), "cik", "left_semi")  # one row
        found = pan.factor_profile(self.table("prices").filter(F.col("ticker") == ticker), facts, asof, own).first()
        if found is None:
            raise NotFound(f"no prices of {ticker}")
        return {"asof": asof, **found.asDict()}

    @cached(300)
    def regime(self, asof: str | None = None) -> dict:
        asof = asof or date.today().isoformat()
        days = self.spark.range(1).select(F.lit(asof).cast("date").alias("day"))
        found = mac.regime_series(self.table("macro"), days, SERIES).first().asDict()
        return found | {"asof": asof, "display": mac.DISPLAY[found["label"]]}

    @cached(60)
    def prices(self, ticker: str, days: int = 252, asof: str | None = None) -> dict:
        asof, ticker = asof or date.today().isoformat(), ticker.upper()
        rows = self.table("prices").filter((F.col("ticker") == ticker) & (F.col("event_date") <= F.lit(asof).cast("date")))
        found = [x.asDict() for x in rows.select(F.col("event_date").alias("date"), "open", "high", "low", "close", "adjclose", "volume").orderBy(F.desc("date")).limit(_bounded("days", days, 2520)).collect()]
        if not found:
            raise NotFound(f"no prices of {ticker}")
        return {"ticker": ticker, "asof": asof, "count": len(found), "prices": found}

    def universe(self, name: str | None = None) -> dict:
        if name is None:
            return UNIVERSES | {"total_tickers": len(UNIVERSES["default"])}
        key = name.lower().replace("-", "_")
        if key not in UNIVERSES:
            raise NotFound(f"unknown universe {name}")
        return {"universe": name, "count": len(UNIVERSES[key]), "tickers": UNIVERSES[key]}

    def validate(self) -> dict:
        """Counts over the live facts, and of the rejected rows by reason."""
        f = self.table("fundamentals")
        checks = f.agg(F.count("*").alias("observations"), F.count_distinct("cik").alias("companies"), F.count_if(F.col("knowledge_date").isNull()).alias("null_knowledge_date"), F.count_if(F.col("event_date").isNull()).alias("null_event_date"), F.count_if(F.col("knowledge_date") < F.col("event_date")).alias("lookahead_filed_before_event")).first().asDict()
        checks["restated_period_facts"] = f.groupBy("cik", "tag", "unit", "event_date").agg(F.count_distinct("knowledge_date").alias("n")).filter("n > 1").count()
        rejected = [self.table(f"{t}_rejected").select("reject_reason") for t in warehouse.GATES]
        reasons = {x["reject_reason"]: x["count"] for x in functools.reduce(DataFrame.union, rejected).groupBy("reject_reason").count().collect()}  # some ten reasons
        ok = checks["null_knowledge_date"] + checks["null_event_date"] + checks["lookahead_filed_before_event"] == 0
        return {"ok": ok, "checks": checks, "quarantined": sum(reasons.values()), "quarantine_reasons": reasons}

    def answer(self, path: str) -> tuple[int, dict]:
        """A path with its query to a status and a body."""
        parts = urlsplit(path)
        name, *args = [p for p in parts.path.split("/") if p] or [""]
        options = dict(parse_qsl(parts.query))
        if name not in ("health", "signals", "factors", "regime", "universe", "prices"):
            return 404, {"detail": f"unknown path {parts.path}"}
        try:
            return 200, getattr(self, name)(*args, **{k: int(x) if k in ("top", "days") else x for k, x in options.items()})
        except NotFound as missing:
            return 404, {"detail": str(missing)}
        except (TypeError, ValueError) as wrong:
            return 422, {"detail": str(wrong)}


def serve(reads: Reads, host: str = "127.0.0.1", port: int = 8000) -> HTTPServer:
    """A server of the reads as JSON; the caller runs serve_forever()."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            status, body = reads.answer(self.path)
            data = json.dumps(body, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

    return HTTPServer((host, port), Handler)
