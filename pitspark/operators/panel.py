"""Price panels, momentum, factors, rankings and backtests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pit import latest_by_month, latest_per_tag, members_at

FACTORS = ("ey", "bp", "roe", "gm", "mom")


def month_end(bars: DataFrame) -> DataFrame:
    """(ticker, month, px): the month's last adjusted close."""
    return bars.filter("adjclose is not null").groupBy("ticker", F.trunc("event_date", "MM").alias("month")).agg(F.max_by("adjclose", "event_date").alias("px"))


def last_price(bars: DataFrame, asof: Column, column: str = "adjclose") -> DataFrame:
    return bars.filter((F.col("event_date") <= asof) & (F.col(column) > 0)).groupBy("ticker").agg(F.max_by(column, "event_date").alias("px"))


def momentum_calendar(panel: DataFrame, asof: Column) -> DataFrame:
    """(ticker, mom): from 13 months to one month before the date's month; one conditional aggregation instead of a self-join."""
    m = F.trunc(asof, "MM")
    at = lambda k: F.max(F.when(F.col("month") == F.add_months(m, -k), F.col("px")))
    both = panel.filter(F.col("month").isin(F.add_months(m, -1), F.add_months(m, -13))).groupBy("ticker").agg(at(1).alias("p1"), at(13).alias("p13"))
    return both.filter((F.col("p1") != 0) & (F.col("p13") != 0)).select("ticker", (F.col("p1") / F.col("p13") - 1).alias("mom"))


def indexed(panel: DataFrame) -> DataFrame:
    """panel with the month's position; months are few, so numbering them in one task is bounded by the calendar."""
    months = panel.select("month").distinct().withColumn("i", F.row_number().over(Window.orderBy("month")) - 1)
    return panel.join(F.broadcast(months), "month")


def momentum_positional(panel: DataFrame) -> DataFrame:
    """(ticker, month, i, px, mom, fwd): prices one and 13 panel months back and one ahead, by range frames over the position."""
    at = lambda k: F.max("px").over(Window.partitionBy("ticker").orderBy("i").rangeBetween(k, k))
    rows = indexed(panel).select("*", at(-1).alias("p1"), at(-13).alias("p13"), at(1).alias("n1"))
    ok = (F.col("px") != 0) & (F.col("p1") != 0) & (F.col("p13") != 0) & F.col("n1").isNotNull()
    return rows.filter(ok).select("ticker", "month", "i", "px", (F.col("p1") / F.col("p13") - 1).alias("mom"), (F.col("n1") / F.col("px") - 1).alias("fwd"))


def ratios(wide: DataFrame, min_equity: float) -> DataFrame:
    """Value and quality factors from the five tags and px; null where a denominator doesn't serve."""
    ni, eq, rev, gp, sh = (F.col(t) for t in ("NetIncomeLoss", "StockholdersEquity", "Revenues", "GrossProfit", "CommonStockSharesOutstanding"))
    cap = F.when(sh > 0, F.col("px") * sh)
    return wide.withColumns({"ey": F.when(cap > 0, ni / cap), "bp": F.when(cap > 0, eq / cap), "roe": F.when(F.abs(eq) > min_equity, ni / eq), "gm": F.when(rev > 0, gp / rev)})


TAGS = ["NetIncomeLoss", "StockholdersEquity", "Revenues", "GrossProfit", "CommonStockSharesOutstanding"]


def factors(facts: DataFrame, prices: DataFrame, asof: Column, min_equity: float = 1000.0, tickers: DataFrame | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """(ticker, px, ey, bp, roe, gm, more) on a date: one pivoted aggregation for all tags, then one join. tickers: (cik, ticker), else S and the cik; more: columns of prices to carry."""
    wide = latest_per_tag(facts, asof).groupBy("cik").pivot("tag", TAGS).agg(F.first("val"))
    wide = (wide.withColumn("ticker", F.concat(F.lit("S"), F.col("cik").cast("string"))) if tickers is None else wide.join(tickers, "cik")).drop("cik")
    return ratios(prices.join(wide, "ticker", "left"), min_equity).select("ticker", "px", "ey", "bp", "roe", "gm", *more)


def finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def zscore(x: Column, *by: str) -> Column:
    """Cross-sectional z-score: 0 for missing values and for groups with fewer than two; deviation 0 counts as 1."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    v = finite(x)
    sd = F.stddev_samp(v).over(w)
    return F.when(F.count(v).over(w) < 2, 0.0).otherwise(F.coalesce((v - F.avg(v).over(w)) / F.when(sd == 0, 1.0).otherwise(sd), F.lit(0.0)))


def zscored(rows: DataFrame, columns: tuple[str, ...], by: str | None = None) -> DataFrame:
    """rows with z_<column>: moments by aggregation and a small join, so a cross-section is never gathered in one task."""
    moments = [f(finite(F.col(c))).alias(f"{n}_{c}") for c in columns for n, f in (("n", F.count), ("mean", F.avg), ("sd", F.stddev_samp))]
    stats = rows.groupBy(by).agg(*moments) if by else rows.agg(*moments)
    out = rows.join(stats, by) if by else rows.join(F.broadcast(stats))  # one row
    for c in columns:
        sd = F.when(F.col(f"sd_{c}") == 0, 1.0).otherwise(F.col(f"sd_{c}"))
        out = out.withColumn(f"z_{c}", F.when(F.col(f"n_{c}") < 2, 0.0).otherwise(F.coalesce((finite(F.col(c)) - F.col(f"mean_{c}")) / sd, F.lit(0.0))))
    return out.drop(*[f"{n}_{c}" for c in columns for n in ("n", "mean", "sd")])


def composite(rows: DataFrame, by: str | None = None) -> DataFrame:
    out = zscored(rows, FACTORS, by)
    n = sum((finite(F.col(c)).isNotNull().cast("int") for c in FACTORS), F.lit(0))
    return out.withColumn("composite", sum((F.col(f"z_{c}") for c in FACTORS), F.lit(0.0))).withColumn("n_factors", n)


def rank(bars: DataFrame, facts: DataFrame, members: DataFrame, asof: str, latest_price: bool = False, min_equity: float = 1000.0, tickers: DataFrame | None = None) -> DataFrame:
    """Members on the date that have momentum, by the sum of five z-scores: value, quality and momentum. Missing ratios are neutral.

    px, the last adjusted close, makes the ratios; price is the last close. latest_price uses prices after the date too.
    """
    day = F.lit(asof).cast("date")
    here = bars.join(members.filter(members_at(members, day)).select("ticker"), "ticker", "left_semi")
    # one pass over the bars: the last prices and the two months of momentum
    seen = here.filter("adjclose is not null") if latest_price else here.filter((F.col("event_date") <= day) & F.col("adjclose").isNotNull())
    m = F.trunc("event_date", "MM")
    month = lambda k: F.max_by("adjclose", F.when((m == F.add_months(F.trunc(day, "MM"), -k)), F.col("event_date")))
    rows = seen.groupBy("ticker").agg(F.max_by("adjclose", "event_date").alias("px"), F.max_by("close", "event_date").alias("price"), month(1).alias("p1"), month(13).alias("p13"))
    rows = rows.filter("px > 0 and price <> 0 and p1 <> 0 and p13 > 0").select("ticker", "px", "price", (F.col("p1") / F.col("p13") - 1).alias("mom"))
    return composite(factors(facts, rows, day, min_equity, tickers, ("price", "mom")))


def factor_profile(bars: DataFrame, facts: DataFrame, asof: str, tickers: DataFrame | None = None) -> DataFrame:
    """(ticker, px, four ratios, mom) as known on a date, for the tickers of bars, at their last close; without facts the ratios are null."""
    day = F.lit(asof).cast("date")
    return factors(facts, last_price(bars, day, "close"), day, tickers=tickers).join(momentum_calendar(month_end(bars), day), "ticker", "left").select("ticker", "px", "ey", "bp", "roe", "gm", "mom")


#: Months of prices without which there is no backtest.
MIN_MONTHS = 26


def eligible(panel: DataFrame, members: DataFrame) -> DataFrame:
    """(ticker, month, i, px, mom, fwd) of the members of each month that can be traded into the next; empty under MIN_MONTHS months."""
    enough = panel.agg(F.count_distinct("month").alias("n_months")).filter(F.col("n_months") >= MIN_MONTHS).select("n_months")
    rows = momentum_positional(panel).join(members, "ticker").filter(members_at(members, F.col("month"))).drop("added_date", "removed_date")
    return rows.crossJoin(F.broadcast(enough)).drop("n_months")  # one row, or none


def backtest(panel: DataFrame, members: DataFrame, score: DataFrame | None = None, top: float = 0.2, cost_bps: float = 10.0, least: int = 5) -> DataFrame:
    """(month, i, n_elig, k, gross, bench, turnover, net) for all months at once. score: (ticker, month, score), else momentum."""
    rows = eligible(panel, members)
    rows = rows.join(score, ["ticker", "month"]) if score is not None else rows.withColumn("score", F.col("mom"))
    return backtest_rows(rows, top, cost_bps, least)


def backtest_rows(rows: DataFrame, top: float = 0.2, cost_bps: float = 10.0, least: int = 5) -> DataFrame:
    """The backtest of eligible rows with a score."""
    w = Window.partitionBy("month")
    rows = rows.select("ticker", "month", "i", "fwd", "score").withColumn("n", F.count("*").over(w)).filter(F.col("n") >= least)
    rows = rows.withColumn("rn", F.row_number().over(w.orderBy(F.desc("score"), "ticker"))).withColumn("k", F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(top))))
    held = F.col("rn") <= F.col("k")
    # each month with the names it holds, so turnover needs no second pass: a name set a month
    months = rows.groupBy("month", "i").agg(F.max("n").alias("n_elig"), F.max("k").alias("k"), F.avg(F.when(held, F.col("fwd"))).alias("gross"), F.avg("fwd").alias("bench"), F.collect_set(F.when(held, F.col("ticker"))).alias("names"))
    by_time = Window.orderBy("i")  # a row a month
    before = F.coalesce(F.lag("names").over(by_time), F.array().cast("array<string>"))
    kept = F.size(F.array_intersect("names", before))
    out = months.withColumn("turnover", (F.col("k") + F.size(before) - 2 * kept) / F.col("k"))
    return out.select("month", "i", "n_elig", "k", "gross", "bench", "turnover", (F.col("gross") - F.col("turnover") * cost_bps / 10000).alias("net"))


def multifactor_scores(rows: DataFrame, facts: DataFrame, min_equity: float = 1000.0, tickers: DataFrame | None = None) -> DataFrame:
    """Eligible rows with a score: the sum of five z-scores, by set-based point-in-time factors on the first day of each month."""
    wide = latest_by_month(facts, rows.select("month").distinct()).groupBy("cik", "month").pivot("tag", TAGS).agg(F.first("val"))
    wide = (wide.withColumn("ticker", F.concat(F.lit("S"), F.col("cik").cast("string"))) if tickers is None else wide.join(tickers, "cik")).drop("cik")
    return composite(ratios(rows.join(wide, ["ticker", "month"], "left"), min_equity), "month").withColumnRenamed("composite", "score")


def multifactor_backtest(bars: DataFrame, facts: DataFrame, members: DataFrame, min_equity: float = 1000.0, tickers: DataFrame | None = None, top: float = 0.2, cost_bps: float = 10.0, least: int = 5) -> DataFrame:
    """The backtest by the multifactor score."""
    return backtest_rows(multifactor_scores(eligible(month_end(bars), members), facts, min_equity, tickers), top, cost_bps, least)


def coverage(universe: DataFrame, facts: DataFrame, tickers: DataFrame | None = None) -> DataFrame:
    """One row (n_covered, n_tickers): how many tickers of the universe have any fact; each ticker is looked for, facts aren't counted."""
    names = facts.select("cik").distinct()
    names = names.select(F.concat(F.lit("S"), F.col("cik").cast("string")).alias("ticker")) if tickers is None else names.join(tickers, "cik").select("ticker").distinct()
    rows = universe.select("ticker").distinct().join(names.withColumn("has", F.lit(1)), "ticker", "left")
    return rows.agg(F.count("has").alias("n_covered"), F.count("*").alias("n_tickers"))


def regime_breakdown(returns: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, n, mean, bench, sd, sharpe, strategy_year, bench_year, alpha) of monthly net returns by the macro regime of their month; labels: (month, label), without one it is unknown."""
    rows = returns.join(labels, "month", "left").withColumn("label", F.coalesce("label", F.lit("unknown")))
    g = rows.groupBy("label").agg(F.count("*").alias("n"), F.avg("net").alias("mean"), F.avg("bench").alias("bench"), F.coalesce(F.stddev_samp("net"), F.lit(0.0)).alias("sd"))
    year = lambda c: F.pow(1 + F.col(c), F.lit(12.0)) - 1
    sharpe = F.when(F.col("sd") > 0, F.col("mean") / F.col("sd") * F.sqrt(F.lit(12.0))).otherwise(0.0)
    return g.withColumns({"sharpe": sharpe, "strategy_year": year("mean"), "bench_year": year("bench")}).withColumn("alpha", F.col("strategy_year") - F.col("bench_year"))


def equity(returns: DataFrame, column: str = "net", order: str = "i") -> DataFrame:
    """Running growth, its peak and the drawdown; a row a month, so one ordered task is bounded by the calendar."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = returns.withColumn("equity", F.product(1 + F.col(column)).over(w))
    return rows.withColumn("peak", F.max("equity").over(w)).withColumn("drawdown", F.col("equity") / F.col("peak") - 1)


def metrics(returns: DataFrame, column: str) -> DataFrame:
    r = F.col(column)
    agg = equity(returns, column).agg(F.count("*").alias("n"), F.product(1 + r).alias("growth"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("sd"), F.min("drawdown").alias("max_drawdown"))
    sd = F.coalesce("sd", F.lit(0.0))
    return agg.select("n", (F.col("n") / 12).alias("years"), (F.col("growth") - 1).alias("total_return"), (F.pow("growth", 12 / F.col("n")) - 1).alias("cagr"), F.when(sd > 0, F.col("mean") / sd * F.sqrt(F.lit(12.0))).otherwise(0.0).alias("sharpe"), "max_drawdown", sd.alias("volatility"))
