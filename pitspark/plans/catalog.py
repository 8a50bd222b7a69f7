"""The engine's queries over the star-schema inputs, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import macro as mac
from ..operators import names as nam
from ..operators import panel as pan
from ..operators import pit
from ..operators import portfolio as por
from ..operators import strategies as stg
from ..sources import html_tables, landing
from ..sources import views as v
from ..streaming import ticks as tk

D, M_DAY = "2000-06-15", "2024-01-20"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def w(*names: str, more: str = "") -> str:
    return "WITH " + ", ".join(f"{n} AS ({v.SQL[n]})" for n in names) + (", " + more if more else "")


def r(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Rounded, as the last digits of sums depend on their order."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


day = lambda: F.lit(D).cast("date")
live_facts = lambda s, d: pit.live(pit.gate(v.facts(s, d)))
LIVE = "lf AS (SELECT * FROM facts WHERE knowledge_date >= event_date)"


# point in time
@query(w("facts") + f"SELECT event_date, val, knowledge_date, form, accn FROM facts WHERE cik = 1 AND tag = 'Revenues' AND knowledge_date >= event_date AND knowledge_date <= DATE '{D}' QUALIFY row_number() OVER (PARTITION BY event_date ORDER BY knowledge_date DESC, accn DESC) = 1")
def pit_as_of(s, d):
    return pit.as_of(live_facts(s, d), 1, "Revenues", D)


LATEST = f"lt AS (SELECT cik, tag, val FROM lf WHERE knowledge_date <= DATE '{D}' AND event_date >= CAST(DATE '{D}' - INTERVAL 36 MONTH AS DATE) QUALIFY row_number() OVER (PARTITION BY cik, tag ORDER BY knowledge_date DESC, event_date DESC, accn DESC) = 1)"


@query(w("facts", more=f"{LIVE}, {LATEST}") + "SELECT * FROM lt")
def pit_latest_per_tag(s, d):
    return pit.latest_per_tag(live_facts(s, d), day())


MONTHS = "mo AS (SELECT DISTINCT CAST(date_trunc('month', event_date) AS DATE) AS month FROM bars)"
BY_MONTH = "bm AS (SELECT month, cik, tag, val FROM mo JOIN lf ON knowledge_date <= month AND event_date >= CAST(month - INTERVAL 36 MONTH AS DATE) QUALIFY row_number() OVER (PARTITION BY month, cik, tag ORDER BY knowledge_date DESC, event_date DESC, accn DESC) = 1)"


@query(w("bars", "facts", more=f"{LIVE}, {MONTHS}, {BY_MONTH}") + "SELECT * FROM bm")
def pit_by_month(s, d):
    months = v.bars(s, d).select(F.trunc("event_date", "MM").alias("month")).distinct()
    return pit.latest_by_month(live_facts(s, d), months)


@query(w("facts", more=LIVE) + "SELECT cik, tag, event_date, count(DISTINCT knowledge_date) AS n_knowledge FROM lf GROUP BY ALL HAVING count(DISTINCT knowledge_date) > 1")
def restated_periods(s, d):
    return live_facts(s, d).groupBy("cik", "tag", "event_date").agg(F.count_distinct("knowledge_date").alias("n_knowledge")).filter("n_knowledge > 1")


@query(w("facts") + "SELECT CASE WHEN knowledge_date IS NULL THEN 'null_knowledge_date' WHEN event_date IS NULL THEN 'null_event_date' WHEN knowledge_date < event_date THEN 'lookahead' END AS reject_reason, count(*) AS n FROM facts GROUP BY 1")
def gate_facts_reasons(s, d):
    return pit.gate(v.facts(s, d)).groupBy("reject_reason").agg(F.count("*").alias("n"))


@query(w("bars", more="b AS (SELECT * REPLACE (CASE WHEN dayofmonth(event_date) = 7 THEN -close ELSE close END AS close, CASE WHEN dayofmonth(event_date) = 9 THEN low - 1 ELSE high END AS high, CASE WHEN dayofmonth(event_date) = 11 THEN -volume ELSE volume END AS volume) FROM bars)") + "SELECT CASE WHEN close <= 0 THEN 'nonpositive_close' WHEN volume < 0 THEN 'negative_volume' WHEN high < low THEN 'corrupt_ohlc' END AS reject_reason, count(*) AS n FROM b GROUP BY 1")
def gate_prices_reasons(s, d):
    dom = F.dayofmonth("event_date")
    b = v.bars(s, d).withColumns({"close": F.when(dom == 7, -F.col("close")).otherwise(F.col("close")), "high": F.when(dom == 9, F.col("low") - 1).otherwise(F.col("high")), "volume": F.when(dom == 11, -F.col("volume")).otherwise(F.col("volume"))})
    return pit.gate_prices(b).groupBy("reject_reason").agg(F.count("*").alias("n"))


@query(w("facts") + "SELECT count(*) AS n_rows, count(DISTINCT cik) AS n_cik, count(DISTINCT tag) AS n_tag, count(*) FILTER (knowledge_date IS NULL) AS n_null, count(*) FILTER (knowledge_date < event_date) AS n_lookahead, min(event_date) AS first_event, max(knowledge_date) AS last_known FROM facts")
def validate_report(s, d):
    f = v.facts(s, d)
    return f.agg(F.count("*").alias("n_rows"), F.count_distinct("cik").alias("n_cik"), F.count_distinct("tag").alias("n_tag"), F.count_if(F.col("knowledge_date").isNull()).alias("n_null"), F.count_if(F.col("knowledge_date") < F.col("event_date")).alias("n_lookahead"), F.min("event_date").alias("first_event"), F.max("knowledge_date").alias("last_known"))


HOLDS = "(added_date IS NULL OR added_date <= {0}) AND (removed_date IS NULL OR removed_date > {0})"


@query(w("members") + f"SELECT ticker FROM members WHERE {HOLDS.format(chr(68) + 'ATE ' + repr(D))}")
def members_as_of(s, d):
    m = v.members(s, d)
    return m.filter(pit.members_at(m, day())).select("ticker").orderBy("ticker")


@query(w("bars", "members", more=MONTHS) + f"SELECT month, count(*) AS n_members FROM mo JOIN members ON {HOLDS.format('month')} GROUP BY month")
def members_by_month(s, d):
    months = v.bars(s, d).select(F.trunc("event_date", "MM").alias("month")).distinct()
    m = v.members(s, d)
    return m.join(F.broadcast(months), pit.members_at(m, F.col("month"))).groupBy("month").agg(F.count("*").alias("n_members"))  # months: bounded by the calendar


# prices
@query(w("bars") + f"SELECT ticker, arg_max(adjclose, event_date) AS px FROM bars WHERE event_date <= DATE '{D}' AND adjclose > 0 GROUP BY 1")
def last_price(s, d):
    return pan.last_price(v.bars(s, d), day())


@query(w("bars") + "SELECT ticker, event_date, open, high, low, close, volume FROM bars QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY event_date DESC) <= 252")
def price_history_topn(s, d):
    rank = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("event_date")))
    return v.bars(s, d).withColumn("rn", rank).filter("rn <= 252").select("ticker", "event_date", "open", "high", "low", "close", "volume")


PANEL = "pan AS (SELECT ticker, CAST(date_trunc('month', event_date) AS DATE) AS month, arg_max(adjclose, event_date) AS px FROM bars GROUP BY 1, 2)"
MOMC = f"mc AS (SELECT a.ticker, a.px / b.px - 1 AS mom FROM pan a JOIN pan b USING (ticker) WHERE a.month = CAST(date_trunc('month', DATE '{D}') - INTERVAL 1 MONTH AS DATE) AND b.month = CAST(date_trunc('month', DATE '{D}') - INTERVAL 13 MONTH AS DATE) AND a.px <> 0 AND b.px > 0)"
MOMP = "ix AS (SELECT month, row_number() OVER (ORDER BY month) - 1 AS i FROM (SELECT DISTINCT month FROM pan)), pi AS (SELECT * FROM pan JOIN ix USING (month)), mp AS (SELECT a.ticker, a.month, a.i, a.px, b.px / c.px - 1 AS mom, n.px / a.px - 1 AS fwd FROM pi a JOIN pi b ON a.ticker = b.ticker AND b.i = a.i - 1 JOIN pi c ON a.ticker = c.ticker AND c.i = a.i - 13 JOIN pi n ON a.ticker = n.ticker AND n.i = a.i + 1 WHERE a.px <> 0 AND b.px <> 0 AND c.px <> 0)"


@query(w("bars", more=PANEL) + "SELECT * FROM pan")
def month_end_panel(s, d):
    return pan.month_end(v.bars(s, d))


@query(w("bars", more=f"{PANEL}, {MOMC}") + "SELECT * FROM mc")
def momentum_12_1_calendar(s, d):
    return pan.momentum_calendar(pan.month_end(v.bars(s, d)), day())


@query(w("bars", more=f"{PANEL}, {MOMP}") + "SELECT * FROM mp")
def momentum_12_1_positional(s, d):
    return pan.momentum_positional(pan.month_end(v.bars(s, d)))


WIDE = "{0} AS (SELECT 'S' || cik AS ticker{1}, " + ", ".join(f"max(val) FILTER (tag = '{t}') AS {a}" for t, a in zip(pan.TAGS, ("ni", "eq", "rev", "gp", "sh"), strict=True)) + " FROM {2} GROUP BY ALL)"
RATIOS = "CASE WHEN px * sh > 0 AND sh > 0 THEN ni / (px * sh) END AS ey, CASE WHEN px * sh > 0 AND sh > 0 THEN eq / (px * sh) END AS bp, CASE WHEN abs(eq) > 1000 THEN ni / eq END AS roe, CASE WHEN rev > 0 THEN gp / rev END AS gm"
PRICE = f"lp AS (SELECT ticker, arg_max(adjclose, event_date) AS px FROM bars WHERE event_date <= DATE '{D}' AND adjclose > 0 GROUP BY 1)"
FACT = f"{WIDE.format('wd', '', 'lt')}, fa AS (SELECT lp.ticker, px, {RATIOS} FROM lp LEFT JOIN wd USING (ticker))"


@query(w("bars", "facts", more=f"{LIVE}, {LATEST}, {PRICE}, {FACT}") + "SELECT ticker, px, round(ey, 6) AS ey, round(bp, 6) AS bp, round(roe, 6) AS roe, round(gm, 6) AS gm FROM fa")
def factors_pit(s, d):
    return r(pan.factors(live_facts(s, d), pan.last_price(v.bars(s, d), day()), day()), "ey", "bp", "roe", "gm")


def zsql(c: str, by: str = "") -> str:
    p = f"({by})"
    return f"CASE WHEN count({c}) OVER {p} < 2 THEN 0.0 ELSE coalesce(({c} - avg({c}) OVER {p}) / CASE WHEN stddev_samp({c}) OVER {p} = 0 THEN 1.0 ELSE stddev_samp({c}) OVER {p} END, 0.0) END"


@query(w("bars", more=f"{PANEL}, {MOMC}") + f"SELECT ticker, round({zsql('mom')}, 6) AS z_mom FROM mc")
def zscore_cross_section(s, d):
    return r(pan.zscored(pan.momentum_calendar(pan.month_end(v.bars(s, d)), day()), ("mom",)).select("ticker", "z_mom"), "z_mom")


# the last prices of all names, then only members with momentum: the moments of the z-scores are theirs
LASTS = f"rp AS (SELECT ticker, arg_max(adjclose, event_date) AS px, arg_max(close, event_date) AS price FROM bars WHERE adjclose IS NOT NULL AND event_date <= DATE '{D}' GROUP BY 1)"
RANK = f"{LIVE}, {LATEST}, {LASTS}, {WIDE.format('wd', '', 'lt')}, {PANEL}, {MOMC}, rk AS (SELECT rp.ticker, px, price, mom, {RATIOS} FROM rp JOIN mc USING (ticker) LEFT JOIN wd USING (ticker) WHERE px > 0 AND price <> 0 AND ticker IN (SELECT ticker FROM members WHERE {HOLDS.format('DATE ' + repr(D))})), rz AS (SELECT *, " + ", ".join(f"{zsql(c)} AS z_{c}" for c in pan.FACTORS) + " FROM rk), ranked AS (SELECT *, z_ey + z_bp + z_roe + z_gm + z_mom AS composite, 1 + " + " + ".join(f"CAST({c} IS NOT NULL AS INTEGER)" for c in pan.FACTORS if c != "mom") + " AS n_factors FROM rz)"
_ROUND = ["ey", "bp", "roe", "gm", "mom", "z_ey", "z_bp", "z_roe", "z_gm", "z_mom", "composite"]


def ranked(s, d):
    return pan.rank(v.bars(s, d), live_facts(s, d), v.members(s, d), D)


@query(w("bars", "facts", "members", more=RANK) + "SELECT ticker, px, price, n_factors, " + ", ".join(f"round({c}, 5) AS {c}" for c in _ROUND) + " FROM ranked")
def composite_rank(s, d):
    return r(ranked(s, d), *_ROUND, digits=5).orderBy(F.desc("composite"), "ticker")


@query(w("bars", "facts", "members", more=RANK) + "SELECT count(*) FILTER (n_factors = 5) AS n_full, count(*) FILTER (n_factors < 5 AND n_factors > 1) AS n_partial, count(*) FILTER (n_factors = 1 AND mom IS NOT NULL) AS n_mom_only FROM ranked")
def factor_coverage(s, d):
    n = F.col("n_factors")
    return ranked(s, d).agg(F.count_if(n == 5).alias("n_full"), F.count_if((n < 5) & (n > 1)).alias("n_partial"), F.count_if((n == 1) & F.col("mom").isNotNull()).alias("n_mom_only"))


# backtests
def back_sql(score: str) -> str:
    return f"bt0 AS ({score}), bt1 AS (SELECT *, count(*) OVER (PARTITION BY month) AS n FROM bt0 WHERE (SELECT count(*) FROM ix) >= 26), bt2 AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY score DESC, ticker) AS rn, greatest(1, CAST(floor(n * 0.2::DOUBLE) AS BIGINT)) AS k FROM bt1 WHERE n >= 5), bt3 AS (SELECT month, i, max(n) AS n_elig, max(k) AS k, avg(fwd) FILTER (rn <= k) AS gross, avg(fwd) AS bench, row_number() OVER (ORDER BY i) AS seq FROM bt2 GROUP BY month, i), held AS (SELECT ticker, month, seq FROM bt2 JOIN bt3 USING (month) WHERE rn <= bt2.k), kept AS (SELECT a.month, count(b.ticker) AS kept FROM held a LEFT JOIN held b ON a.ticker = b.ticker AND b.seq = a.seq - 1 GROUP BY 1), bt AS (SELECT month, i, n_elig, k, gross, bench, (k + coalesce(lag(k) OVER (ORDER BY seq), 0) - 2 * kept) / CAST(k AS DOUBLE) AS turnover FROM bt3 JOIN kept USING (month)), btn AS (SELECT *, gross - turnover * 10.0 / 10000 AS net FROM bt)"


MOMBACK = f"{PANEL}, {MOMP}, " + back_sql(f"SELECT mp.*, mom AS score FROM mp JOIN members USING (ticker) WHERE {HOLDS.format('month')}")
_BT = "SELECT month, i, n_elig, k, round(gross, 6) AS gross, round(bench, 6) AS bench, round(turnover, 6) AS turnover, round(net, 6) AS net FROM btn"


def momentum_backtest(s, d):
    return pan.backtest(pan.month_end(v.bars(s, d)), v.members(s, d))


@query(w("bars", "members", more=MOMBACK) + _BT)
def backtest_momentum_monthly(s, d):
    return r(momentum_backtest(s, d), "gross", "bench", "turnover", "net")


MULTI = f"{LIVE}, {PANEL}, {MOMP}, {MONTHS}, {BY_MONTH}, {WIDE.format('wm', ', month', 'bm')}, ms AS (SELECT mp.ticker, mp.month, mp.i, mp.fwd, mom, {RATIOS} FROM mp JOIN members USING (ticker) LEFT JOIN wm USING (ticker, month) WHERE {HOLDS.format('month')}), " + back_sql("SELECT ticker, month, i, fwd, " + " + ".join(zsql(c, "PARTITION BY month") for c in pan.FACTORS) + " AS score FROM ms")


@query(w("bars", "facts", "members", more=MULTI) + _BT)
def backtest_multifactor_monthly(s, d):
    return r(pan.multifactor_backtest(v.bars(s, d), live_facts(s, d), v.members(s, d)), "gross", "bench", "turnover", "net")


CURVE = "eq AS (SELECT *, product(1 + net) OVER (ORDER BY i) AS equity FROM btn), cu AS (SELECT *, max(equity) OVER (ORDER BY i) AS peak FROM eq)"


@query(w("bars", "members", more=f"{MOMBACK}, {CURVE}") + "SELECT month, i, round(ln(equity), 6) AS log_equity, round(ln(peak), 6) AS log_peak, round(equity / peak - 1, 6) AS drawdown FROM cu")
def equity_curve_drawdown(s, d):
    return r(pan.equity(momentum_backtest(s, d)).select("month", "i", F.ln("equity").alias("log_equity"), F.ln("peak").alias("log_peak"), "drawdown"), "log_equity", "log_peak", "drawdown")


@query(w("bars", "members", more=f"{MOMBACK}, {CURVE}") + "SELECT count(*) AS n, count(*) / 12.0::DOUBLE AS years, round(product(1 + net) - 1, 6) AS total_return, round(pow(product(1 + net), 12.0 / count(*)) - 1, 6) AS cagr, round(avg(net) / stddev_samp(net) * sqrt(12.0), 6) AS sharpe, round(min(equity / peak - 1), 6) AS max_drawdown, round(stddev_samp(net), 6) AS volatility FROM cu")
def backtest_metrics(s, d):
    return r(pan.metrics(momentum_backtest(s, d), "net"), "total_return", "cagr", "sharpe", "max_drawdown", "volatility")


@query(w("bars", "members", more=MOMBACK + ", ps AS (SELECT *, (row_number() OVER (ORDER BY i) - 1) // 60 AS chunk FROM btn)") + "SELECT chunk, count(*) AS n, round(pow(product(1 + net), 12.0 / count(*)) - 1, 6) AS cagr, round(avg(net) / stddev_samp(net) * sqrt(12.0), 6) AS sharpe FROM ps GROUP BY chunk HAVING count(*) >= 12")
def period_breakdown(s, d):
    pos = F.row_number().over(Window.orderBy("i")) - 1
    g = momentum_backtest(s, d).withColumn("chunk", F.floor(pos / 60)).groupBy("chunk").agg(F.count("*").alias("n"), F.product(1 + F.col("net")).alias("g"), F.avg("net").alias("m"), F.stddev_samp("net").alias("sd")).filter("n >= 12")
    return r(g.select("chunk", "n", (F.pow("g", 12 / F.col("n")) - 1).alias("cagr"), (F.col("m") / F.col("sd") * F.sqrt(F.lit(12.0))).alias("sharpe")), "cagr", "sharpe")


# macro
_T = {"rec": 150.0, "vix_high": 90.0, "hys_high": 95.0, "curve": 20.0, "hys_low": 60.0, "vix_low": 60.0}
_REG = "days AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events), ty AS (SELECT event_type, row_number() OVER (ORDER BY event_type) AS k FROM (SELECT DISTINCT event_type FROM events)), kn AS (SELECT day, k, arg_max(val, row(knowledge_date, macro.event_date)) AS val FROM days JOIN macro ON knowledge_date <= day JOIN ty ON ty.event_type = series_id GROUP BY 1, 2), wi AS (SELECT day, " + ", ".join(f"max(val) FILTER (k = {i + 1}) AS {n}" for i, n in enumerate(mac.SERIES)) + " FROM days LEFT JOIN kn USING (day) GROUP BY day)"
_LABEL = f"CASE WHEN rec >= {_T['rec']} THEN 'recession' WHEN vix > {_T['vix_high']} OR hys > {_T['hys_high']} THEN 'risk_off' WHEN curve < {_T['curve']} THEN 'late_cycle' WHEN curve > {_T['curve']} AND hys < {_T['hys_low']} AND vix < {_T['vix_low']} THEN 'expansion' WHEN fed IS NULL OR curve IS NULL OR hys IS NULL OR vix IS NULL OR rec IS NULL THEN 'unknown' ELSE 'recovery' END"


def regimes(s, d):
    m = v.macro(s, d)
    types = [x[0] for x in m.select("series_id").distinct().orderBy("series_id").limit(len(mac.SERIES)).collect()]  # the table has as many event types as there are series
    days = v.read(s, d, "events").select(F.col("ts").cast("date").alias("day")).distinct()
    return mac.regime_series(m, days, dict(zip(types, mac.SERIES, strict=False)), _T)


@query(w("macro", more=_REG) + f"SELECT day, fed, curve, hys, vix, rec, {_LABEL} AS label FROM wi")
def regime_series(s, d):
    return regimes(s, d)


# the events lie in a later year than the prices: day k of the macro series stands for the k-th month of the backtest's calendar
_SHIFT = f"lb AS (SELECT CAST(DATE '1996-01-01' + to_months(CAST(dayofyear(day) - 1 AS INTEGER)) AS DATE) AS month, label FROM (SELECT *, {_LABEL} AS label FROM wi))"
_YEAR = "pow(1 + avg({0}), 12.0) - 1"


@query(w("macro", "bars", "members", more=f"{_REG}, {_SHIFT}, {MOMBACK}") + f"SELECT coalesce(label, 'unknown') AS label, count(*) AS n, round(avg(net), 6) AS mean, round(avg(bench), 6) AS bench, round(coalesce(stddev_samp(net), 0), 6) AS sd, round(CASE WHEN stddev_samp(net) > 0 THEN avg(net) / stddev_samp(net) * sqrt(12.0) ELSE 0.0 END, 6) AS sharpe, round(ln(1 + {_YEAR.format('net')}), 6) AS log_strategy_year, round(ln(1 + {_YEAR.format('bench')}), 6) AS log_bench_year FROM btn LEFT JOIN lb USING (month) GROUP BY 1")
def regime_breakdown(s, d):
    labels = regimes(s, d).select(F.add_months(F.lit("1996-01-01").cast("date"), F.dayofyear("day") - 1).alias("month"), "label")
    out = pan.regime_breakdown(momentum_backtest(s, d), labels)
    logs = [F.ln(1 + F.col(c)).alias(f"log_{c}") for c in ("strategy_year", "bench_year")]
    return r(out.select("label", "n", "mean", "bench", "sd", "sharpe", *logs), "mean", "bench", "sd", "sharpe", "log_strategy_year", "log_bench_year")


@query(w("macro") + "SELECT i.id AS series_id, arg_max(val, event_date) AS value, max(event_date) AS event_date FROM (VALUES ('click'), ('view'), ('nothing')) i(id) LEFT JOIN macro ON i.id = series_id GROUP BY 1")
def macro_snapshot(s, d):
    return mac.snapshot(v.macro(s, d), ["click", "view", "nothing"])


# portfolio
RET = "rt AS (SELECT ticker, event_date, close, close / lag(close) OVER (PARTITION BY ticker ORDER BY event_date) - 1 AS ret FROM bars WHERE close > 0)"
COV = "c1 AS (SELECT * FROM bars WHERE close > 0 AND ticker IN (SELECT DISTINCT ticker FROM bars ORDER BY ticker LIMIT 200) QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY event_date DESC) <= 253), c2 AS (SELECT ticker, event_date, close / lag(close) OVER (PARTITION BY ticker ORDER BY event_date) - 1 AS ret FROM c1), c3 AS (SELECT ticker, ret, row_number() OVER (PARTITION BY ticker ORDER BY event_date) AS pos, count(*) OVER (PARTITION BY ticker) AS n FROM c2 WHERE ret IS NOT NULL), cov AS (SELECT a.ticker AS sym_a, b.ticker AS sym_b, round(covar_samp(a.ret, b.ret), 8) AS cov FROM c3 a JOIN c3 b USING (pos) WHERE a.n >= 20 AND b.n >= 20 AND (SELECT count(DISTINCT ticker) FROM c3 WHERE n >= 20) > 1 GROUP BY 1, 2)"
RC = "rc AS (SELECT sym_a AS sym, sum(cov) / pow((SELECT count(DISTINCT sym_a) FROM cov), 2) AS rc FROM cov GROUP BY 1)"


@query(w("bars", more=RET) + "SELECT ticker, event_date, round(ret, 8) AS ret FROM rt WHERE ret IS NOT NULL")
def daily_returns(s, d):
    return r(por.daily_returns(v.bars(s, d)).select("ticker", "event_date", "ret"), "ret", digits=8)


def cov(s, d):
    return por.covariance(v.bars(s, d))


@query(w("bars", more=COV) + "SELECT sym_a, sym_b, round(cov, 5) AS cov FROM cov")
def cov_matrix(s, d):
    return r(cov(s, d), "cov", digits=5)


@query(w("bars", more=f"{COV}, {RC}") + "SELECT sym, round(rc, 6) AS rc FROM rc")
def risk_contribution(s, d):
    c = cov(s, d)
    return r(por.risk_contribution(c, por.equal_weights(c)), "rc")


@query(w("bars", more=f"{COV}, {RC}") + "SELECT round(sum(rc), 6) AS variance FROM rc")
def portfolio_variance(s, d):
    c = cov(s, d)
    return r(por.risk_contribution(c, por.equal_weights(c)).agg(F.sum("rc").alias("variance")), "variance")


# expected returns: the mean daily return, a year
ER = "er AS (SELECT ticker AS sym, avg(ret) * 252 AS er FROM rt WHERE ret IS NOT NULL GROUP BY 1)"


def greedy_sql(base: float, slope: float) -> str:
    """Names with both an expected return and covariances, in order; each takes its part of what is left, the last one the rest."""
    part = f"CASE WHEN sy.i = n - 1 THEN rem ELSE greatest(0, least(0.10::DOUBLE, rem * ({base} + {slope} * (sy.i / n::DOUBLE)))) END"
    return w("bars", more=f"{RET}, {ER}, {COV}, sy AS (SELECT sym, er, row_number() OVER (ORDER BY sym) - 1 AS i, count(*) OVER () AS n FROM er WHERE sym IN (SELECT sym_a FROM cov)), g(i, sym, w, rem) AS (SELECT -1::BIGINT, NULL::VARCHAR, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL SELECT sy.i, sy.sym, {part}, rem - {part} FROM g JOIN sy ON sy.i = g.i + 1), pw AS (SELECT g.sym, w, er, n FROM g JOIN sy USING (sym)), pf AS (SELECT (SELECT sum(w * er) FROM pw) AS ret, (SELECT sum(a.w * b.w * cov) FROM cov JOIN pw a ON a.sym = sym_a JOIN pw b ON b.sym = sym_b) AS var), ow AS (SELECT sym, CASE WHEN n > 1 AND var > 0 THEN w ELSE 1.0 / n END AS w, ret, CASE WHEN n > 1 AND var > 0 THEN sqrt(var) END AS vol FROM pw, pf)").replace("WITH ", "WITH RECURSIVE ", 1)


def expected(s, d):
    return por.daily_returns(v.bars(s, d)).groupBy(F.col("ticker").alias("sym")).agg((F.avg("ret") * 252).alias("er"))


@query(greedy_sql(0.5, 0.5) + "SELECT sym, round(w, 8) AS w, round(ln(ret), 5) AS log_ret, round(ln(vol), 5) AS log_vol FROM ow")
def mean_variance_weights(s, d):
    out = por.mean_variance(expected(s, d), cov(s, d))
    return r(r(out.select("sym", "w", F.ln("ret").alias("log_ret"), F.ln("vol").alias("log_vol")), "w", digits=8), "log_ret", "log_vol", digits=5)


@query(greedy_sql(0.1, 0.9) + "SELECT sym, round(w, 8) AS w FROM ow")
def efficient_frontier_weights(s, d):
    return r(por.mean_variance(expected(s, d), cov(s, d), base=0.1, slope=0.9).select("sym", "w"), "w", digits=8)


@query(greedy_sql(0.1, 0.9) + "SELECT CAST(point AS INTEGER) AS point, round(ln(ret), 4) AS log_ret, round(ln(vol), 4) AS log_vol, round((ret - 0.05) / vol, 4) AS sharpe, n_names FROM (SELECT any_value(ret) AS ret, any_value(vol) AS vol, count(*) AS n_names FROM ow), range(20) AS x(point) WHERE vol IS NOT NULL")
def efficient_frontier(s, d):
    out = por.efficient_frontier(expected(s, d), cov(s, d))
    return r(out.select("point", F.ln("ret").alias("log_ret"), F.ln("vol").alias("log_vol"), "sharpe", F.size("weights").cast("long").alias("n_names")), "log_ret", "log_vol", digits=4)


_RP_STEP = """SELECT it.k + 1 AS k,
  list_transform(w1, lambda x: CASE WHEN list_sum(w1) > 0 THEN x / list_sum(w1) ELSE 1.0 / n END) AS w, list_aggregate(list_transform(gap, lambda x: abs(x)), 'max') < 0.01 AS done
  FROM (SELECT k, n, gap, list_transform(range(1, n + 1), lambda i: least(0.10, greatest(0, w[i] * (1 + 0.05 * gap[i])))) AS w1
    FROM (SELECT k, n, w, list_transform(rc, lambda x: 1.0 / n - x / list_sum(rc)) AS gap
      FROM (SELECT k, n, w, list_transform(range(1, n + 1), lambda i: w[i] * list_dot_product(m[i], w)) AS rc FROM it, mx WHERE k < 100 AND NOT done AND n > 1)
      WHERE list_sum(rc) > 0)) it"""


@query(w("bars", more=f"{COV}, mr AS (SELECT sym_a, list(cov ORDER BY sym_b) AS row FROM cov GROUP BY 1), mx AS (SELECT list(sym_a ORDER BY sym_a) AS syms, list(row ORDER BY sym_a) AS m, count(*) AS n FROM mr), it(k, w, done) AS (SELECT 0::BIGINT, list_transform(syms, lambda x: 1.0::DOUBLE / n), false FROM mx UNION ALL {_RP_STEP}), lw AS (SELECT w FROM it ORDER BY k DESC LIMIT 1)").replace("WITH ", "WITH RECURSIVE ", 1) + "SELECT unnest(syms) AS sym, round(unnest(w), 10) AS w FROM mx, lw")
def risk_parity_weights(s, d):
    return r(por.risk_parity(cov(s, d)), "w", digits=10)


@query("WITH b AS (SELECT DISTINCT (event_id % 97) / 97.0::DOUBLE AS p, (event_id % 7) / 2.0::DOUBLE AS odds, 1000.0::DOUBLE AS bankroll FROM events), k AS (SELECT *, greatest(0.0, least(1.0, CASE WHEN odds > 1 THEN (p * odds - 1) / (odds - 1) ELSE 0.0 END)) AS k FROM b) SELECT p, odds, bankroll, round(bankroll * k * 0.25, 2) AS recommended_bet, round(k * 0.25, 4) AS fraction_of_bankroll, round(k, 4) AS kelly_percentage, CASE WHEN k <= 0 THEN 'no bet' ELSE '25% Kelly' END AS message, CASE WHEN k > 0.1 THEN 'high' WHEN k <= 0 THEN 'low' ELSE 'medium' END AS confidence FROM k")
def kelly(s, d):
    e = F.col("event_id")
    return por.kelly(v.read(s, d, "events").select((e % 97 / 97.0).alias("p"), (e % 7 / 2.0).alias("odds"), F.lit(1000.0).alias("bankroll")).distinct())


PAIR = "pr AS (SELECT row_number() OVER (ORDER BY a.event_date) - 1 AS pos, a.ret AS ra, b.ret AS rb FROM rt a JOIN rt b USING (event_date) WHERE a.ticker = 'S1' AND b.ticker = 'S2' AND a.ret IS NOT NULL AND b.ret IS NOT NULL)"


def pairs(s, d):
    rt = por.daily_returns(v.bars(s, d))
    one = lambda t, n: rt.filter(F.col("ticker") == t).select("event_date", F.col("ret").alias(n))
    return one("S1", "ra").join(one("S2", "rb"), "event_date").select((F.row_number().over(Window.orderBy("event_date")) - 1).alias("pos"), "ra", "rb")


@query(w("bars", more=f"{RET}, {PAIR}, x AS (SELECT pos, covar_samp(ra, rb) OVER q AS c, var_samp(ra) OVER q AS va, var_samp(rb) OVER q AS vb, avg(ra) OVER q AS ma, avg(rb) OVER q AS mb, count(*) OVER q AS n FROM pr WINDOW q AS (ORDER BY pos ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING))") + "SELECT pos AS date_idx, round((ma - c / vb * mb) * 252, 4) + 0.0 AS alpha, round(c / vb, 5) + 0.0 AS beta, round(least(1.0, c / vb * c / va), 5) + 0.0 AS r2 FROM x WHERE n = 63 AND vb > 0")
def rolling_alpha(s, d):
    out = r(r(por.rolling_alpha(pairs(s, d)), "beta", "r2", digits=5), "alpha", digits=4)
    return out.withColumns({c: F.col(c) + 0.0 for c in ("alpha", "beta", "r2")})  # no negative zero


@query(w("bars", more=f"{RET}, {PAIR}, m AS (SELECT *, max(1.0) OVER () AS one FROM pr)") + "SELECT 'S2' AS factor, round(covar_samp(ra, rb) / var_samp(rb), 6) AS beta, round(covar_samp(ra, rb), 6) AS cov, round((avg(ra) - covar_samp(ra, rb) / var_samp(rb) * avg(rb)) * 252, 4) AS alpha FROM m HAVING count(*) > 1")
def factor_regression(s, d):
    g = por.factor_betas(pairs(s, d).select(F.lit("S2").alias("factor"), F.col("ra").alias("excess"), F.col("rb").alias("f")))
    return r(r(g, "beta", "cov"), "alpha", digits=4)


# monthly returns of the first names: S1 is explained by the others, the last of which has no value in some months
_MONTHLY = f"{PANEL}, mr AS (SELECT ticker, month, px / lag(px) OVER (PARTITION BY ticker ORDER BY month) - 1 AS ret FROM pan), fx AS (SELECT month, ret - 0.001 AS x FROM mr WHERE ticker = 'S1' AND ret IS NOT NULL), ff AS (SELECT ticker AS factor, month, ret AS f, x FROM mr JOIN fx USING (month) WHERE ticker IN ('S2', 'S3', 'S4') AND ret IS NOT NULL AND (ticker <> 'S4' OR month(month) <> 7)), fn AS (SELECT * FROM ff WHERE factor IN (SELECT factor FROM ff GROUP BY 1 HAVING count(*) >= (SELECT count(*) FROM fx))), fb AS (SELECT factor, CASE WHEN var_samp(f) > 0 THEN covar_samp(x, f) / var_samp(f) ELSE 0.0 END AS beta, covar_samp(x, f) AS cov FROM fn GROUP BY 1), rs AS (SELECT fx.month, x - coalesce((SELECT sum(beta * f) FROM fn JOIN fb USING (factor) WHERE fn.month = fx.month), 0) AS e FROM fx)"


@query(w("bars", more=_MONTHLY) + "SELECT round((SELECT avg(e) FROM rs) * 252, 4) AS alpha, round(least(1.0, (SELECT sum(greatest(0, beta * cov)) FROM fb) / (SELECT var_samp(x) FROM fx)), 4) AS r_squared, round((SELECT stddev_samp(e) FROM rs) * sqrt(252.0), 4) AS tracking_error, (SELECT count(*) FROM fx) AS n_periods, (SELECT string_agg(factor, ',' ORDER BY factor) FROM fb) AS factors, (SELECT round(sum(beta), 3) FROM fb) AS sum_beta")
def factor_attribution(s, d):
    before = F.lag("px").over(Window.partitionBy("ticker").orderBy("month"))
    monthly = pan.month_end(v.bars(s, d)).withColumn("ret", F.col("px") / before - 1).filter("ret is not null")
    others = monthly.filter("ticker in ('S2', 'S3', 'S4') and (ticker <> 'S4' or month(month) <> 7)").select(F.col("ticker").alias("factor"), F.col("month").alias("pos"), F.col("ret").alias("f"))
    out = por.factor_returns(monthly.filter("ticker = 'S1'").select(F.col("month").alias("pos"), "ret"), others, 0.001)
    betas = F.aggregate(F.map_values("loadings"), F.lit(0.0), lambda a, b: a + b)
    return out.select("alpha", "r_squared", "tracking_error", "n_periods", F.array_join(F.map_keys("loadings"), ",").alias("factors"), F.round(betas, 3).alias("sum_beta"))


@query(w("bars", "members", more=f"{MOMBACK}, e1 AS (SELECT *, product(1 + net) OVER (ORDER BY i) AS eq FROM btn), e2 AS (SELECT *, greatest(1.0, max(eq) OVER (ORDER BY i)) AS pk, net - 0.002 AS x FROM e1), s AS (SELECT count(*) AS n, product(1 + net) AS g, avg(x) AS m, stddev_samp(net) AS sd, stddev_samp(x) AS sx, coalesce(stddev_samp(x) FILTER (x < 0), 0) AS dn, least(0.0, min((eq - pk) / pk)) AS dd FROM e2)") + "SELECT round(ln(g), 6) AS log_growth, round(pow(g, 12.0 / n) - 1, 6) AS annualized_return, round(sd * sqrt(12.0), 6) AS volatility, round(CASE WHEN sx > 0 THEN m / sx * sqrt(12.0) ELSE 0.0 END, 5) AS sharpe, round(CASE WHEN dn > 0 THEN m * 12 / (dn * sqrt(12.0)) ELSE 0.0 END, 5) AS sortino, round(dd, 6) AS max_drawdown, round(CASE WHEN dd < 0 THEN (pow(g, 12.0 / n) - 1) / abs(dd) ELSE 0.0 END, 5) AS calmar, n FROM s WHERE n > 0")
def return_statistics(s, d):
    out = por.return_statistics(momentum_backtest(s, d), "net", "i", 12, 0.002)
    out = out.withColumn("log_growth", F.ln(1 + F.col("total_return"))).drop("total_return")
    return r(r(out, "log_growth", "annualized_return", "volatility", "max_drawdown"), "sharpe", "sortino", "calmar", digits=5)


BOOKS = "cu0 AS (SELECT 'C' || c_custkey AS ticker, c_mktsegment AS sector, c_acctbal, c_nationkey FROM customer), bk AS (SELECT ticker, 1.0::DOUBLE / count(*) OVER () AS w, c_acctbal / 100000 AS r FROM cu0 WHERE c_nationkey % 2 = 0), bn AS (SELECT ticker, 1.0::DOUBLE / count(*) OVER () AS w, c_acctbal / 120000 AS r FROM cu0 WHERE c_nationkey % 3 = 0), ba AS (SELECT ticker, coalesce(bk.w, 0) AS pw, coalesce(bk.r, 0) AS pr, coalesce(bn.w, 0) AS bw, coalesce(bn.r, 0) AS br FROM bk FULL JOIN bn USING (ticker))"
EFFECTS = "round(sum((pw - bw) * br), 8) AS allocation, round(sum(bw * (pr - br)), 8) AS selection, round(sum((pw - bw) * (pr - br)), 8) AS interaction"


def effects(s, d):
    c = v.read(s, d, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("ticker"), "c_acctbal", "c_nationkey")
    book = lambda k, scale: (x := c.filter(F.col("c_nationkey") % k == 0)).crossJoin(F.broadcast(x.agg(F.count("*").alias("n")))).select("ticker", (1.0 / F.col("n")).alias("w"), (F.col("c_acctbal") / scale).alias("r"))  # noqa: E731  n is one row
    return por.brinson(book(2, 100000), book(3, 120000))


_EFF = ["allocation", "selection", "interaction"]


@query(f"WITH {BOOKS} SELECT {EFFECTS} FROM ba")
def brinson_total(s, d):
    return r(effects(s, d).agg(*[F.sum(c).alias(c) for c in _EFF]), *_EFF, digits=8)


@query(f"WITH {BOOKS} SELECT sector, {EFFECTS} FROM ba JOIN cu0 USING (ticker) GROUP BY sector")
def brinson_sector(s, d):
    sectors = v.read(s, d, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("ticker"), F.col("c_mktsegment").alias("sector"))
    return r(effects(s, d).join(sectors, "ticker", "left").groupBy(F.coalesce("sector", F.lit("Other")).alias("sector")).agg(*[F.sum(c).alias(c) for c in _EFF]), *_EFF, digits=8)


_SL = "sl{0} AS (SELECT {0} AS v, row_number() OVER (ORDER BY {0}, ticker) AS rn, count(*) OVER () AS n FROM ranked WHERE {0} IS NOT NULL)"


_ANOMALIES = w("bars", "facts", "members", more=f"{RANK}, {_SL.format('ey')}, {_SL.format('roe')}, sp AS (SELECT max(n) AS n, sum(v) FILTER (rn > n - ceil(n / 5.0)) / greatest(max(n) // 5, 1) - sum(v) FILTER (rn <= n // 5) / greatest(max(n) // 5, 1) AS sp FROM slroe), cr AS (SELECT abs(composite) AS a, row_number() OVER (ORDER BY composite DESC, ticker) AS rn FROM ranked)") + "SELECT 'momentum_dispersion' AS name, round(CASE WHEN count(mom) < 10 THEN 0.0 ELSE least(1.0, stddev_samp(mom) / 0.5) END, 5) AS score FROM ranked UNION ALL SELECT 'value_spread', round(CASE WHEN max(n) < 20 THEN 0.0 ELSE least(1.0, abs(sum(v) FILTER (rn > n - ceil(n / 10.0)) - sum(v) FILTER (rn <= n // 10)) / greatest(max(n) // 10, 1) * 100) END, 5) FROM sley UNION ALL SELECT 'quality_premium', round(CASE WHEN n < 20 OR sp <= 0 THEN 0.0 ELSE least(1.0, 1 - sp / 0.5) END, 5) FROM sp UNION ALL SELECT 'factor_crowding', round(CASE WHEN count(*) < 20 OR sum(a) <= 0 THEN 0.0 ELSE least(1.0, sum(a) FILTER (rn <= 10) / sum(a) * 2) END, 5) FROM cr"


@query(_ANOMALIES)
def anomalies(s, d):
    return r(por.anomalies(ranked(s, d)), "score", digits=5)


@query(w("bars", "facts", "members", more=f"{RANK}, q AS (SELECT count(*) FILTER (n_factors >= 4) / greatest(count(*), 1)::DOUBLE AS q FROM (SELECT * FROM ranked ORDER BY composite DESC, ticker LIMIT 20))") + "SELECT round(0.3 + q * 0.8, 2) AS sharpe, round(-0.15 - (1 - q) * 0.15, 3) AS max_drawdown, round(0.03 + q * 0.12, 3) AS cagr, round(least(1.0, q + 0.2), 2) AS regime_stability, 0.3 + q * 0.8 >= 0.5 AS passed FROM q")
def strategy_score(s, d):
    return por.strategy_score(ranked(s, d))


_ROTATION = "SELECT 'sector_rotation' AS name, round(CASE WHEN count(*) < 3 THEN 0.0 ELSE least(1.0, stddev_samp(m) / 0.3) END, 5) AS score FROM (SELECT coalesce('N' || s_nationkey % 5, 'other') AS sector, avg(mom) AS m FROM ranked LEFT JOIN supplier ON ticker = 'S' || s_suppkey WHERE mom IS NOT NULL GROUP BY 1)"


@query(w("bars", "facts", "members", more=RANK) + _ROTATION)
def anomaly_sector_rotation(s, d):
    sectors = v.read(s, d, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker"), F.concat(F.lit("N"), (F.col("s_nationkey") % 5).cast("string")).alias("sector"))
    return r(por.sector_rotation(ranked(s, d), sectors), "score", digits=5)


@query(f"WITH an AS ({_ANOMALIES}), pr(name, least_score, strategy, universe, ranking, sizing, max_positions, rebalance) AS (VALUES {', '.join(map(str, por.PROPOSALS))}) SELECT name, round(score, 3) AS severity, strategy, universe, ranking, sizing, max_positions, rebalance FROM an JOIN pr USING (name) WHERE score > least_score")
def strategy_proposals(s, d):
    return por.proposals(anomalies(s, d))


@query(w("bars", "facts", more=f"{LIVE}, {LATEST}, {PRICE.replace('adjclose', 'close')}, {FACT}, {PANEL}, {MOMC}") + "SELECT ticker, px, round(ey, 6) AS ey, round(bp, 6) AS bp, round(roe, 6) AS roe, round(gm, 6) AS gm, round(mom, 6) AS mom FROM fa LEFT JOIN mc USING (ticker) WHERE ticker = 'S1'")
def factor_profile(s, d):
    bars, facts = v.bars(s, d).filter("ticker = 'S1'"), live_facts(s, d).filter("cik = 1")
    return r(pan.factor_profile(bars, facts, D), "ey", "bp", "roe", "gm", "mom")


# names, landing, ticks
_NORM = "array_to_string(list_filter(string_split_regex(regexp_replace(lower({0}), '[^a-z0-9 ]', ' ', 'g'), ' +'), lambda x: x <> '' AND NOT list_contains([" + ", ".join(f"'{x}'" for x in nam.FORMS) + "], x)), ' ')"
_NAME = "'The ' || p_name || ', Inc.'"


@query(f"SELECT p_partkey, {_NORM.format(_NAME)} AS norm FROM part")
def name_normalize(s, d):
    return v.read(s, d, "part").select("p_partkey", nam.normalize(F.concat(F.lit("The "), F.col("p_name"), F.lit(", Inc."))).alias("norm"))


@query(f"WITH c AS (SELECT {_NORM.format('p_name')} AS c, min(p_partkey) AS cik FROM part WHERE p_partkey % 3 = 0 GROUP BY 1), s AS (SELECT DISTINCT p_name || CASE WHEN p_partkey % 2 = 0 THEN ' Research' ELSE 'US' END AS sponsor FROM part), n AS (SELECT sponsor, {_NORM.format('sponsor')} AS s FROM s), m AS (SELECT sponsor, c, cik FROM n, c WHERE s = c OR (length(s) <= length(c) AND ((length(s) >= 4 AND starts_with(c, s || ' ')) OR (length(s) >= 5 AND starts_with(c, s) AND length(c) - length(s) <= 3))) OR (length(s) > length(c) AND ((length(c) >= 4 AND starts_with(s, c || ' ')) OR (length(c) >= 5 AND starts_with(s, c) AND length(s) - length(c) <= 3)))) SELECT sponsor, arg_max(cik, row(length(c), -cik)) AS cik FROM m GROUP BY 1")
def name_resolve_fuzzy(s, d):
    p = v.read(s, d, "part")
    companies = p.filter("p_partkey % 3 = 0").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("cik"))
    sponsors = p.select(F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, " Research").otherwise("US")).alias("sponsor"))
    return nam.resolve(sponsors, companies)


_LOG = "lg AS (SELECT CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderkey % 2 = 0 THEN 'added' ELSE 'removed' END AS kind, 'C' || o_custkey AS ticker FROM orders), cm AS (SELECT 'C' || c_custkey AS ticker, CASE WHEN c_custkey % 4 = 0 THEN DATE '1994-01-01' END AS added FROM customer WHERE c_custkey % 2 = 0)"


@query(f"WITH {_LOG}, fa AS (SELECT ticker, min(day) AS first_added FROM lg WHERE kind = 'added' GROUP BY 1), gn AS (SELECT ticker, min(day) AS removed FROM lg WHERE kind = 'removed' AND ticker NOT IN (SELECT ticker FROM cm) GROUP BY 1), al AS (SELECT ticker, added, NULL::DATE AS removed FROM cm UNION ALL SELECT ticker, NULL, removed FROM gn) SELECT ticker, coalesce(added, first_added) AS added, removed FROM al LEFT JOIN fa USING (ticker)")
def membership_reconstruct(s, d):
    log = v.read(s, d, "orders").select(F.col("o_orderdate").cast("date").alias("day"), F.when(F.col("o_orderkey") % 2 == 0, "added").otherwise("removed").alias("kind"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("ticker"))
    now = v.read(s, d, "customer").filter("c_custkey % 2 = 0").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("ticker"), F.when(F.col("c_custkey") % 4 == 0, F.lit("1994-01-01").cast("date")).alias("added"))
    return nam.reconstruct_membership(now, log)


@query("SELECT event_id, arg_max(value, batch) AS value FROM (SELECT event_id, value, 0 AS batch FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, value + 1, 1 FROM events WHERE event_id % 3 = 0) GROUP BY 1")
def landing_merge(s, d):
    e = v.read(s, d, "events")
    return landing.merge(e.filter("event_id % 2 = 0").select("event_id", "value"), e.filter("event_id % 3 = 0").select("event_id", (F.col("value") + 1).alias("value")), ["event_id"], "value")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props_flatten(s, d):
    return v.read(s, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT n_nationkey AS key, n_name AS name, n_regionkey AS region FROM nation UNION ALL SELECT r_regionkey, r_name, NULL FROM region")
def union_by_name(s, d):
    a = v.read(s, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    return a.unionByName(v.read(s, d, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("key")), allowMissingColumns=True)


_LT = "SELECT ticker, arg_max(price, row(ts, event_id)) AS price, 0.0::DOUBLE AS change, coalesce(arg_max(volume, row(ts, event_id)), 0) AS volume, max(ts) AS ts FROM ticks GROUP BY 1"


@query(w("ticks") + _LT)
def latest_tick(s, d):
    return tk.latest(v.ticks(s, d))


@query(w("ticks") + "SELECT ticker, ts, event_id, price, volume, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC, event_id DESC) AS rn FROM ticks QUALIFY rn <= 20")
def recent_ticks(s, d):
    return tk.recent(v.ticks(s, d))


@query(w("ticks") + "SELECT * FROM ticks WHERE ts >= (SELECT max(ts) FROM ticks) - INTERVAL 24 HOUR")
def tick_ttl(s, d):
    return tk.unexpired(v.ticks(s, d))


@query(w("ticks") + "SELECT ticker, ts, event_id, round(CASE WHEN lag(price) OVER q <> 0 THEN (price - lag(price) OVER q) / lag(price) OVER q * 100 ELSE 0.0 END, 6) AS change FROM ticks WINDOW q AS (PARTITION BY ticker ORDER BY ts, event_id)")
def tick_percent_change(s, d):
    return r(tk.percent_change(v.ticks(s, d)), "change")


@query(w("ticks") + "SELECT ticker, price, CAST(ts AS TIMESTAMP) AS ts FROM (" + _LT + ")")
def stream_latest_tick(s, d):
    return tk.stream_latest(s, d, "events.parquet", v.read(s, d, "events").schema)


@query("WITH c AS (SELECT n_regionkey AS page_id, n_name, n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS row_no FROM nation) SELECT page_id, 0 AS table_no, CAST(row_no AS INTEGER) AS row_no, n_name || '|' || n_nationkey AS cells FROM c UNION ALL SELECT r_regionkey, 0, 0, 'name|key' FROM region UNION ALL SELECT r_regionkey, 1, 0, 'About ' || r_name || '|inner cell' FROM region")
def page_tables(s, d):
    # a page a region: a table of its nations, with cells and rows that don't all end, and a table with one inside
    row = F.concat(F.lit("<tr><td> "), F.col("n_name"), F.lit("<td>"), F.col("n_nationkey").cast("string"), F.when(F.col("n_nationkey") % 2 == 0, "</td></tr>").otherwise(""))
    rows = v.read(s, d, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("row")))), lambda x: x["row"]), "").alias("rows"))
    html = F.concat(F.lit("<p>x<table><tr><th>name</th><th>key</th></tr>"), "rows", F.lit("</table><table><tr><td>About\n "), "r_name", F.lit("</td><td><table><tr><td>inner</td></tr></table> cell</td></tr></table>"))
    pages = v.read(s, d, "region").join(rows, "r_regionkey").select(F.col("r_regionkey").alias("page_id"), html.alias("html"))
    return html_tables.tables(pages).withColumn("cells", F.array_join("cells", "|"))


@query(w("bars", "facts", more=LIVE) + "SELECT count(*) FILTER (EXISTS (SELECT 1 FROM lf WHERE 'S' || cik = ticker AND tag = 'Revenues' AND event_date >= DATE '2001-06-01')) AS n_covered, count(*) AS n_tickers FROM (SELECT DISTINCT ticker FROM bars)")
def fact_coverage(s, d):
    return pan.coverage(v.bars(s, d), live_facts(s, d).filter("tag = 'Revenues' and event_date >= date'2001-06-01'"))


@query("SELECT p_partkey, list_filter(string_split_regex(regexp_replace(lower('The ' || p_type || ' Co.'), '[^a-z0-9 ]', ' ', 'g'), ' +'), lambda x: length(x) > 2 AND NOT list_contains([" + ", ".join(f"'{x}'" for x in nam.COMMON) + "], x))[1] AS token FROM part")
def name_match_token(s, d):
    return v.read(s, d, "part").select("p_partkey", nam.match_token(F.concat(F.lit("The "), F.col("p_type"), F.lit(" Co."))).alias("token"))

# strategies
_SEEN = "knowledge_date <= {0} AND event_date >= CAST({0} - INTERVAL 36 MONTH AS DATE)"
_NOW, _YEAR_AGO = f"DATE '{D}'", f"CAST(DATE '{D}' - INTERVAL 12 MONTH AS DATE)"


def snapsql(*tags: str) -> str:
    order = "arg_max(val, row(knowledge_date, event_date, accn))"
    return "sn AS (SELECT cik, " + ", ".join(f"{order} FILTER (tag = '{t}' AND {_SEEN.format(at)}) AS {t}{end}" for t in tags for at, end in ((_NOW, ""), (_YEAR_AGO, "_0"))) + f" FROM ls WHERE tag IN ({', '.join(repr(t) for t in tags)}) AND knowledge_date <= {_NOW} AND event_date >= CAST({_NOW} - INTERVAL 48 MONTH AS DATE) GROUP BY cik)"


def strategy_sql(tags: tuple[str, ...], more: str = "", views: tuple[str, ...] = ()) -> str:
    return w("statements", *views, more="ls AS (SELECT * FROM statements WHERE knowledge_date >= event_date), " + snapsql(*tags) + more)


def ratio_sql(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN {a} / ({b}) END"


statements = lambda s, d: pit.live(pit.gate(v.statements(s, d)))
_GROWTH = f""", qs AS (SELECT cik, CAST(year(event_date) * 4 + quarter(event_date) AS INTEGER) AS q, arg_max(val, row(knowledge_date, event_date, accn)) AS val FROM ls WHERE tag = '{stg.REV}' AND knowledge_date <= {_NOW} GROUP BY 1, 2),
 q4 AS (SELECT a.*, l.val AS before1, {ratio_sql('(a.val - b.val)', 'b.val')} AS growth FROM qs a LEFT JOIN qs b ON a.cik = b.cik AND b.q = a.q - 4 LEFT JOIN qs l ON a.cik = l.cik AND l.q = a.q - 1),
 q1 AS (SELECT a.*, CAST(coalesce(a.val > a.before1, false) AS INTEGER) AS up, CAST(coalesce(a.growth > b.growth, false) AS INTEGER) AS faster, CAST(coalesce(a.growth < b.growth, false) AS INTEGER) AS slower FROM q4 a LEFT JOIN q4 b ON a.cik = b.cik AND b.q = a.q - 1),
 gr AS (SELECT cik, q, growth, sum(up) OVER z = 3 AS rises, sum(faster) OVER z = 3 AS speeds_up, sum(slower) OVER y = 2 AS slows_down FROM q1 WINDOW z AS (PARTITION BY cik ORDER BY q RANGE BETWEEN 2 PRECEDING AND CURRENT ROW), y AS (PARTITION BY cik ORDER BY q RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) QUALIFY row_number() OVER (PARTITION BY cik ORDER BY q DESC) = 1)"""


def _tests_sql() -> str:
    def pair(a: str, b: str) -> list[str]:
        return [ratio_sql(a + e, b + e) for e in ("", "_0")]

    roa, debt, current, margin, turnover = pair(stg.NI, stg.ASSETS), pair(stg.DEBT, stg.ASSETS), pair(stg.CUR_ASSETS, stg.CUR_LIAB), pair(stg.GP, stg.REV), pair(stg.REV, stg.ASSETS)
    tests = [f"{roa[0]} > 0", f"{stg.OCF} > 0", f"{roa[0]} > {roa[1]}", f"{stg.OCF} > {stg.NI}", f"{debt[0]} < {debt[1]}", f"{current[0]} > {current[1]}", f"{stg.SHARES} <= {stg.SHARES}_0", f"{margin[0]} > {margin[1]}", f"{turnover[0]} > {turnover[1]}"]
    return " + ".join(f"CAST(coalesce({t}, false) AS INTEGER)" for t in tests)


@query(strategy_sql((stg.NI, stg.OCF, stg.ASSETS, stg.DEBT, stg.CUR_ASSETS, stg.CUR_LIAB, stg.SHARES, stg.GP, stg.REV), f", fs AS (SELECT cik, {_tests_sql()} AS f_score FROM sn)") + "SELECT *, f_score >= 7 AS enters, f_score < 5 AS leaves FROM fs")
def strategy_piotroski(s, d):
    return stg.piotroski(statements(s, d), day())


def cik_prices(s, d):
    return pan.last_price(v.bars(s, d), day()).select(F.substring("ticker", 2, 20).cast("long").alias("cik"), "px")


@query(strategy_sql((stg.CUR_ASSETS, stg.LIAB, stg.SHARES), f", {PRICE}, rt AS (SELECT cik, {ratio_sql(f'({stg.CUR_ASSETS} - {stg.LIAB})', f'px * {stg.SHARES}')} AS ratio FROM sn JOIN lp ON ticker = 'S' || cik), en AS (SELECT *, ratio > 1e-4 AS enters, ratio < 0.8e-4 AS leaves FROM rt WHERE ratio IS NOT NULL)", ("bars",)) + "SELECT cik, round(ratio, 9) AS ratio, enters, leaves, round(CASE WHEN enters AND (SELECT count(*) FROM en WHERE enters) >= 3 THEN least(0.15, 1.0 / (SELECT count(*) FROM en WHERE enters)) ELSE 0 END, 6)::DOUBLE AS weight FROM en")
def strategy_net_net(s, d):
    return r(r(stg.net_net(statements(s, d), cik_prices(s, d), day(), 1e-4, 0.8e-4), "ratio", digits=9), "weight")


@query(strategy_sql((stg.NI, stg.OCF, stg.ASSETS), f", ac AS (SELECT cik, {ratio_sql(f'({stg.NI} - {stg.OCF})', stg.ASSETS)} AS accruals FROM sn)") + "SELECT cik, round(accruals, 6) AS accruals, CAST(ntile(3) OVER (ORDER BY accruals, cik) AS INTEGER) AS part FROM ac WHERE accruals IS NOT NULL")
def strategy_earnings_quality(s, d):
    return r(stg.earnings_quality(statements(s, d), day()), "accruals")


@query(strategy_sql((stg.SHARES, stg.OCF, stg.CAPEX), f", bb AS (SELECT cik, {ratio_sql(f'({stg.SHARES}_0 - {stg.SHARES})', stg.SHARES + '_0')} AS buyback FROM sn WHERE {stg.OCF} > {stg.CAPEX})") + "SELECT cik, round(buyback, 6) AS buyback, CAST(ntile(5) OVER (ORDER BY buyback DESC, cik) AS INTEGER) AS part FROM bb WHERE buyback IS NOT NULL")
def strategy_buyback_yield(s, d):
    return r(stg.buyback_yield(statements(s, d), day()), "buyback")


@query(strategy_sql((stg.NI, stg.EQUITY, stg.DEBT), _GROWTH + f", qm AS (SELECT cik, {ratio_sql(stg.NI, stg.EQUITY)} AS roe, {ratio_sql(stg.DEBT, stg.EQUITY)} AS debt, coalesce(growth > 0, false) AND coalesce(rises, false) AS rising FROM sn LEFT JOIN gr USING (cik))") + "SELECT cik, round(roe, 6) AS roe, round(debt, 6) AS debt, rising, coalesce(roe > 0.15, false) AND coalesce(debt < 0.5, false) AND rising AS enters FROM qm")
def strategy_quality_momentum(s, d):
    return r(stg.quality_momentum(statements(s, d), day()), "roe", "debt")


@query(strategy_sql((stg.REV,), _GROWTH) + "SELECT cik, round(growth, 6) AS growth, speeds_up AS enters, slows_down AS leaves FROM gr")
def strategy_earnings_revision(s, d):
    return r(stg.earnings_revision(statements(s, d), day()), "growth")


_DIVIDENDS = f"dv AS (SELECT ticker, sum(CAST(action_value AS DOUBLE)) AS dividends FROM actions WHERE type = 'dividend' AND event_date <= {_NOW} AND event_date > {_YEAR_AGO} GROUP BY 1)"


@query(w("bars", "actions", more=f"{PRICE}, {_DIVIDENDS}") + f"SELECT ticker, round(dividends, 6) AS dividends, px, round({ratio_sql('dividends', 'px')}, 6) AS dividend_yield FROM dv JOIN lp USING (ticker) ORDER BY dividends / px DESC, ticker LIMIT 10")
def strategy_dividend_leaders(s, d):
    return r(stg.dividend_leaders(v.actions(s, d), pan.last_price(v.bars(s, d), day()), day()), "dividends", "dividend_yield")


_DUE = f"kind = 'catalyst' AND event_date >= {_NOW} AND event_date <= CAST({_NOW} + INTERVAL 3 MONTH AS DATE)"
_BAD = f"kind IN ('rejection', 'hold') AND event_date <= {_NOW} AND event_date > {_YEAR_AGO}"


@query(strategy_sql((stg.CASH, stg.RND, stg.SGA), f", nr AS (SELECT cik, min(event_date) FILTER ({_DUE}) AS next_event, count(*) FILTER ({_BAD}) AS n_bad FROM decisions GROUP BY cik), ru AS (SELECT cik, {ratio_sql(stg.CASH, f'((coalesce({stg.RND}, 0) + coalesce({stg.SGA}, 0)) / 3)')} AS runway, next_event, coalesce(n_bad > 0, false) AS halted FROM sn LEFT JOIN nr USING (cik))", ("decisions",)) + "SELECT cik, round(runway, 6) AS runway, next_event, halted, next_event IS NOT NULL AND coalesce(runway > 1.8, false) AND NOT halted AS enters, halted OR (next_event IS NULL AND coalesce(runway < 1.2, false)) AS avoids FROM ru")
def strategy_catalysts(s, d):
    return r(stg.catalysts(statements(s, d), v.decisions(s, d), day(), runway=1.8, short=1.2), "runway")
