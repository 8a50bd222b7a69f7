"""Rule-based strategies over bitemporal statements, each for all companies of a date in one plan.

Inputs are live facts (cik, tag, event_date, knowledge_date, val, accn). Only what was known on the date counts, and values
older than three years don't. A test on a missing value fails; a company without any of the tags has no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pit import LATEST

NI, OCF, ASSETS, EQUITY, REV, GP = "NetIncomeLoss", "NetCashProvidedByOperatingActivities", "Assets", "StockholdersEquity", "Revenues", "GrossProfit"
SHARES, DEBT, CUR_ASSETS, CUR_LIAB, LIAB = "CommonStockSharesOutstanding", "LongTermDebt", "AssetsCurrent", "LiabilitiesCurrent", "Liabilities"
CAPEX, CASH, RND, SGA = "CapitalExpenditures", "Cash", "ResearchAndDevelopmentExpense", "SellingGeneralAndAdministrativeExpense"
TAGS = [NI, OCF, ASSETS, EQUITY, REV, GP, SHARES, DEBT, CUR_ASSETS, CUR_LIAB, LIAB, CAPEX, CASH, RND, SGA]

yes = lambda x: F.coalesce(x, F.lit(False))
per = lambda a, b: F.when(b > 0, a / b)


def snapshots(facts: DataFrame, asof: Column, tags: list[str]) -> DataFrame:
    """(cik, each tag, each tag with _0): newest values known on the date and a year before; one aggregation for all."""
    order = F.struct(*LATEST)
    seen = lambda tag, day: (F.col("tag") == tag) & (F.col("knowledge_date") <= day) & (F.col("event_date") >= F.add_months(day, -36))
    values = [F.max_by("val", F.when(seen(t, day), order)).alias(t + end) for t in tags for day, end in ((asof, ""), (F.add_months(asof, -12), "_0"))]
    known = facts.filter(F.col("tag").isin(tags) & (F.col("knowledge_date") <= asof) & (F.col("event_date") >= F.add_months(asof, -48)))
    return known.groupBy("cik").agg(*values)


def quarters(facts: DataFrame, asof: Column, tag: str) -> DataFrame:
    """(cik, q, val): a tag's newest known value in each quarter; q counts quarters, so gaps stay visible."""
    q = F.year("event_date") * 4 + F.quarter("event_date")
    known = facts.filter((F.col("tag") == tag) & (F.col("knowledge_date") <= asof))
    return known.groupBy("cik", q.alias("q")).agg(F.max_by("val", F.struct(*LATEST)).alias("val"))


def _back(column: str, n: int) -> Column:
    return F.max(column).over(Window.partitionBy("cik").orderBy("q").rangeBetween(-n, -n))


def _run(test: Column, n: int) -> Column:
    """Whether the test holds in each of the last n quarters."""
    return F.count_if(test).over(Window.partitionBy("cik").orderBy("q").rangeBetween(1 - n, 0)) == n


def growth(facts: DataFrame, asof: Column) -> DataFrame:
    """(cik, q, val, growth, rises, speeds_up, slows_down) of revenue on the newest quarter: growth against the quarter a year before, and runs of three (slowing: two) quarters."""
    rows = quarters(facts, asof, REV).withColumn("before", _back("val", 4)).withColumn("last", _back("val", 1))
    rows = rows.withColumn("growth", per(F.col("val") - F.col("before"), F.col("before"))).withColumn("g", _back("growth", 1))
    rows = rows.select("cik", "q", "val", "growth", yes(_run(yes(F.col("val") > F.col("last")), 3)).alias("rises"), _run(yes(F.col("growth") > F.col("g")), 3).alias("speeds_up"), _run(yes(F.col("growth") < F.col("g")), 2).alias("slows_down"))
    newest = rows.groupBy("cik").agg(F.max_by(F.struct("q", "val", "growth", "rises", "speeds_up", "slows_down"), "q").alias("x"))
    return newest.select("cik", "x.*")


def piotroski(facts: DataFrame, asof: Column, enter: int = 7, leave: int = 5) -> DataFrame:
    """(cik, f_score, enters, leaves): nine yes-or-no tests against the year before."""
    c = F.col
    then = lambda f: (f(""), f("_0"))
    roa, roa0 = then(lambda e: per(c(NI + e), c(ASSETS + e)))
    debt, debt0 = then(lambda e: per(c(DEBT + e), c(ASSETS + e)))
    current, current0 = then(lambda e: per(c(CUR_ASSETS + e), c(CUR_LIAB + e)))
    margin, margin0 = then(lambda e: per(c(GP + e), c(REV + e)))
    turnover, turnover0 = then(lambda e: per(c(REV + e), c(ASSETS + e)))
    tests = [roa > 0, c(OCF) > 0, roa > roa0, c(OCF) > c(NI), debt < debt0, current > current0, c(SHARES) <= c(SHARES + "_0"), margin > margin0, turnover > turnover0]
    score = sum((yes(t).cast("int") for t in tests), F.lit(0))
    return snapshots(facts, asof, [NI, OCF, ASSETS, DEBT, CUR_ASSETS, CUR_LIAB, SHARES, GP, REV]).select("cik", score.alias("f_score")).select("*", (c("f_score") >= enter).alias("enters"), (c("f_score") < leave).alias("leaves"))


def net_net(facts: DataFrame, prices: DataFrame, asof: Column, enter: float = 1.0, leave: float = 0.8, least: int = 3, most: float = 0.15) -> DataFrame:
    """(cik, ratio, enters, leaves, weight): current assets less liabilities against market value; prices: (cik, px). Under `least` entries all weight is cash."""
    c = F.col
    rows = snapshots(facts, asof, [CUR_ASSETS, LIAB, SHARES]).join(prices, "cik").select("cik", per(c(CUR_ASSETS) - c(LIAB), c("px") * c(SHARES)).alias("ratio")).filter("ratio is not null")
    rows = rows.select("*", (c("ratio") > enter).alias("enters"), (c("ratio") < leave).alias("leaves"))
    n = rows.agg(F.count_if("enters").alias("n"))
    weight = F.when(c("enters") & (c("n") >= least), F.least(F.lit(most), 1 / c("n"))).otherwise(0.0)
    return rows.join(F.broadcast(n)).withColumn("weight", weight).drop("n")  # one row


def _best(rows: DataFrame, order: Column, parts: int) -> DataFrame:
    """rows with part, from 1 for the best; a row a company, so one ordered task is bounded by their number."""
    return rows.withColumn("part", F.ntile(parts).over(Window.orderBy(order, "cik")))


def earnings_quality(facts: DataFrame, asof: Column) -> DataFrame:
    """(cik, accruals, part): income not backed by cash, over assets; the first third enters."""
    rows = snapshots(facts, asof, [NI, OCF, ASSETS]).select("cik", per(F.col(NI) - F.col(OCF), F.col(ASSETS)).alias("accruals")).filter("accruals is not null")
    return _best(rows, F.asc("accruals"), 3)


def buyback_yield(facts: DataFrame, asof: Column) -> DataFrame:
    """(cik, buyback, part): shares taken back within a year, of companies whose operations pay for more than their investments; the first fifth enters."""
    c = F.col
    rows = snapshots(facts, asof, [SHARES, OCF, CAPEX]).filter(c(OCF) > c(CAPEX))
    return _best(rows.select("cik", per(c(SHARES + "_0") - c(SHARES), c(SHARES + "_0")).alias("buyback")).filter("buyback is not null"), F.desc("buyback"), 5)


def quality_momentum(facts: DataFrame, asof: Column, roe: float = 0.15, debt: float = 0.5) -> DataFrame:
    """(cik, roe, debt, rising, enters): profitable, lightly indebted, and revenue above the year before after three rises in a row."""
    c = F.col
    now = snapshots(facts, asof, [NI, EQUITY, DEBT]).select("cik", per(c(NI), c(EQUITY)).alias("roe"), per(c(DEBT), c(EQUITY)).alias("debt"))
    rows = now.join(growth(facts, asof), "cik", "left").withColumn("rising", yes(c("growth") > 0) & yes(c("rises")))
    return rows.select("cik", "roe", "debt", "rising", (yes(c("roe") > roe) & yes(c("debt") < debt) & c("rising")).alias("enters"))


def earnings_revision(facts: DataFrame, asof: Column) -> DataFrame:
    """(cik, growth, enters, leaves): revenue growth that rose three quarters in a row, or fell two."""
    return growth(facts, asof).select("cik", "growth", F.col("speeds_up").alias("enters"), F.col("slows_down").alias("leaves"))


def dividend_leaders(actions: DataFrame, prices: DataFrame, asof: Column, most: int = 10) -> DataFrame:
    """(ticker, dividends, px, dividend_yield): the highest twelve-month dividends against price. actions: (ticker, event_date, type, action_value)."""
    paid = actions.filter((F.col("type") == "dividend") & (F.col("event_date") <= asof) & (F.col("event_date") > F.add_months(asof, -12)))
    rows = paid.groupBy("ticker").agg(F.sum(F.expr("try_cast(action_value as double)")).alias("dividends")).join(prices, "ticker")
    rows = rows.select("ticker", "dividends", "px", per(F.col("dividends"), F.col("px")).alias("dividend_yield"))
    return rows.filter("dividend_yield is not null").orderBy(F.desc("dividend_yield"), "ticker").limit(most)


def catalysts(facts: DataFrame, events: DataFrame, asof: Column, within: int = 3, runway: float = 18.0, short: float = 12.0) -> DataFrame:
    """(cik, runway, next_event, halted, enters, avoids): months of cash at the quarterly spending on research and overhead, against due decisions.

    events: (cik, event_date, kind), kind one of catalyst, rejection, hold. The latter two halt a company for a year.
    """
    c = F.col
    burn = (F.coalesce(c(RND), F.lit(0.0)) + F.coalesce(c(SGA), F.lit(0.0))) / 3
    cash = snapshots(facts, asof, [CASH, RND, SGA]).select("cik", per(c(CASH), burn).alias("runway"))
    due = (c("kind") == "catalyst") & (c("event_date") >= asof) & (c("event_date") <= F.add_months(asof, within))
    bad = c("kind").isin("rejection", "hold") & (c("event_date") <= asof) & (c("event_date") > F.add_months(asof, -12))
    near = events.filter(due | bad).groupBy("cik").agg(F.min(F.when(due, c("event_date"))).alias("next_event"), F.count_if(bad).alias("n_bad"))
    rows = cash.join(near, "cik", "left").withColumn("halted", yes(c("n_bad") > 0))
    enters = c("next_event").isNotNull() & yes(c("runway") > runway) & ~c("halted")
    return rows.select("cik", "runway", "next_event", "halted", enters.alias("enters"), (c("halted") | (c("next_event").isNull() & yes(c("runway") < short))).alias("avoids"))
