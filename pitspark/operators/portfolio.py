"""Covariance, risk, portfolio weights, attribution and anomaly scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def daily_returns(bars: DataFrame) -> DataFrame:
    """(ticker, event_date, close, ret) against the bar before, where that is positive."""
    before = F.lag("close").over(Window.partitionBy("ticker").orderBy("event_date"))
    return bars.filter("close > 0").select("ticker", "event_date", "close", before.alias("p")).filter("p > 0").select("ticker", "event_date", "close", (F.col("close") / F.col("p") - 1).alias("ret"))


def covariance(bars: DataFrame, symbols: int | list[str] = 200, lookback: int = 252, least: int = 20, asof: str | None = None) -> DataFrame:
    """(sym_a, sym_b, cov) over the last closes on a date; series are aligned by position from the oldest.

    symbols: names, or how many of the first by name. Names with under `least` returns are left out; fewer than two names
    give no matrix.
    """
    chosen = bars.sparkSession.createDataFrame([(x,) for x in symbols], "ticker string") if isinstance(symbols, list) else bars.select("ticker").distinct().orderBy("ticker").limit(symbols)
    bars = bars if asof is None else bars.filter(F.col("event_date") <= F.lit(asof).cast("date"))
    w = Window.partitionBy("ticker")
    tail = bars.filter("close > 0").join(F.broadcast(chosen), "ticker", "left_semi").withColumn("back", F.row_number().over(w.orderBy(F.desc("event_date")))).filter(F.col("back") <= lookback + 1)
    series = daily_returns(tail).withColumn("pos", F.row_number().over(w.orderBy("event_date"))).withColumn("n", F.count("*").over(w)).filter(F.col("n") >= least).select("ticker", "pos", "ret")
    a, b = series.select(F.col("ticker").alias("sym_a"), "pos", F.col("ret").alias("ra")), series.select(F.col("ticker").alias("sym_b"), "pos", F.col("ret").alias("rb"))
    half = a.join(b, "pos").filter("sym_a <= sym_b").groupBy("sym_a", "sym_b").agg(F.round(F.covar_samp("ra", "rb"), 8).alias("cov"))
    both = half.withColumn("side", F.explode(F.when(F.col("sym_a") < F.col("sym_b"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    out = both.select(F.when(F.col("side") == 0, F.col("sym_a")).otherwise(F.col("sym_b")).alias("sym_a"), F.when(F.col("side") == 0, F.col("sym_b")).otherwise(F.col("sym_a")).alias("sym_b"), "cov")
    return out.withColumn("n", F.count("*").over(Window.partitionBy("sym_a"))).filter("n > 1").drop("n")


def equal_weights(cov: DataFrame) -> DataFrame:
    n = cov.agg(F.count_distinct("sym_a").alias("n"))
    return cov.select(F.col("sym_a").alias("sym")).distinct().crossJoin(F.broadcast(n)).select("sym", (1 / F.col("n")).alias("w"))  # n is one row


def risk_contribution(cov: DataFrame, weights: DataFrame) -> DataFrame:
    """(sym, rc): w_a * sum over b of cov_ab * w_b; their sum is the portfolio's variance."""
    a, b = weights.select(F.col("sym").alias("sym_a"), F.col("w").alias("wa")), weights.select(F.col("sym").alias("sym_b"), F.col("w").alias("wb"))
    return cov.join(a, "sym_a").join(b, "sym_b").groupBy(F.col("sym_a").alias("sym")).agg(F.sum(F.col("wa") * F.col("wb") * F.col("cov")).alias("rc"))


def greedy_weights(symbols: DataFrame, max_weight: float = 0.10, base: float = 0.5, slope: float = 0.5) -> DataFrame:
    """(sym, w): in the order of the names each takes base + slope * i / n of what is left, at most max_weight; the last takes the rest.

    The recurrence is an aggregate over the sorted names, at most a few hundred.
    """
    names = symbols.agg(F.sort_array(F.collect_set("sym")).alias("names"))
    n = F.size("names")

    def step(s: Column, i: Column) -> Column:
        w = F.when(i == n - 1, s["left"]).otherwise(F.least(F.lit(max_weight), s["left"] * (F.lit(base) + F.lit(slope) * (i / n))))
        return F.struct((s["left"] - w).alias("left"), F.concat(s["w"], F.array(w)).alias("w"))

    start = F.struct(F.lit(1.0).alias("left"), F.array().cast("array<double>").alias("w"))
    ran = names.select("names", F.aggregate(F.sequence(F.lit(0), n - 1), start, step)["w"].alias("w"))
    return ran.select(F.explode(F.arrays_zip("names", "w")).alias("x")).select(F.col("x.names").alias("sym"), F.col("x.w").alias("w"))


def mean_variance(returns: DataFrame, cov: DataFrame, max_weight: float = 0.10, base: float = 0.5, slope: float = 0.5) -> DataFrame:
    """(sym, w, ret, vol): the greedy portfolio of the names that have both an expected return (sym, er) and covariances, with its return and volatility.

    Under two names, or where the variance isn't positive, the weights are equal. The specified search scores the same
    portfolio again and again, so neither a risk-free rate nor a target volatility changes the choice.
    """
    names = returns.join(cov.select(F.col("sym_a").alias("sym")).distinct(), "sym", "left_semi")
    w = greedy_weights(names, max_weight, base, slope).join(names.groupBy("sym").agg(F.first("er").alias("er")), "sym")
    total = w.agg(F.sum(F.col("w") * F.col("er")).alias("ret"), F.count("*").alias("n"))
    stats = total.crossJoin(risk_contribution(cov, w.select("sym", "w")).agg(F.sum("rc").alias("var")))  # a row each
    out = w.crossJoin(F.broadcast(stats))
    fine = (F.col("n") > 1) & (F.col("var") > 0)
    return out.select("sym", F.when(fine, F.col("w")).otherwise(1 / F.col("n")).alias("w"), F.when(fine, F.col("ret")).alias("ret"), F.when(fine, F.sqrt("var")).alias("vol"))


def efficient_frontier(returns: DataFrame, cov: DataFrame, points: int = 20, max_weight: float = 0.10, risk_free: float = 0.05) -> DataFrame:
    """(point, ret, vol, sharpe, weights): the sampled portfolios by volatility, thinned out to about the given points; weights: name to weight. Empty under two names."""
    w = mean_variance(returns, cov, max_weight, 0.1, 0.9).filter("vol is not null")
    one = w.groupBy("ret", "vol").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("sym", "w")))).alias("weights"))
    sampled = one.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points * 10 - 1))))
    by_vol = Window.orderBy("vol", "k")  # some hundred samples
    rows = sampled.withColumn("at", F.row_number().over(by_vol) - 1).withColumn("n", F.count("*").over(Window.partitionBy(F.lit(0))))
    step = F.greatest(F.lit(1), F.floor(F.col("n") / points))
    sharpe = F.when(F.col("vol") > 0, (F.col("ret") - risk_free) / F.col("vol")).otherwise(0.0)
    return rows.filter(F.col("at") % step == 0).select((F.col("at") / step).cast("int").alias("point"), F.round("ret", 4).alias("ret"), F.round("vol", 4).alias("vol"), F.round(sharpe, 4).alias("sharpe"), "weights")


def risk_parity(cov: DataFrame, max_weight: float = 0.10, max_iter: int = 100) -> DataFrame:
    """(sym, w): weights move by a twentieth of the gap to an equal risk share until no gap reaches 0.01. One group of a few hundred names."""
    import numpy as np
    import pandas as pd

    def solve(df: pd.DataFrame) -> pd.DataFrame:
        m = df.pivot(index="sym_a", columns="sym_b", values="cov").fillna(0.0).sort_index().sort_index(axis=1)
        c, n = m.to_numpy(), len(m)
        w = np.full(n, 1 / n)
        for _ in range(max_iter if n > 1 else 0):
            rc = w * (c @ w)
            if rc.sum() <= 0:
                break
            gap = 1 / n - rc / rc.sum()
            w = np.minimum(max_weight, np.maximum(0, w * (1 + 0.05 * gap)))
            w = w / w.sum() if w.sum() > 0 else np.full(n, 1 / n)
            if np.abs(gap).max() < 0.01:
                break
        return pd.DataFrame({"sym": m.index, "w": w})

    return cov.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(solve, "sym string, w double")


def kelly(bets: DataFrame, fraction: float = 0.25) -> DataFrame:
    """bets (p, odds, bankroll) with the recommended bet; plain column expressions."""
    raw = F.when(F.col("odds") > 1, (F.col("p") * F.col("odds") - 1) / F.when(F.col("odds") > 1, F.col("odds") - 1)).otherwise(0.0)
    out = bets.withColumn("k", F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))
    k = F.col("k")
    message = F.when(k <= 0, "no bet").otherwise("full Kelly" if fraction >= 1 else f"{fraction * 100:.0f}% Kelly")
    return out.select("p", "odds", "bankroll", F.round(F.col("bankroll") * k * fraction, 2).alias("recommended_bet"), F.round(k * fraction, 4).alias("fraction_of_bankroll"), F.round(k, 4).alias("kelly_percentage"), message.alias("message"), F.when(k > 0.1, "high").when(k <= 0, "low").otherwise("medium").alias("confidence"))


def rolling_alpha(pairs: DataFrame, window: int = 63) -> DataFrame:
    """(date_idx, alpha, beta, r2) of ra on rb over the window before each position, which it leaves out; one series."""
    w = Window.orderBy("pos").rowsBetween(-window, -1)
    cov, va, vb = F.covar_samp("ra", "rb").over(w), F.var_samp("ra").over(w), F.var_samp("rb").over(w)
    rows = pairs.select("pos", cov.alias("cov"), va.alias("va"), vb.alias("vb"), F.avg("ra").over(w).alias("ma"), F.avg("rb").over(w).alias("mb"), F.count("*").over(w).alias("n"))
    rows = rows.filter((F.col("n") == window) & (F.col("vb") > 0)).withColumn("beta", F.col("cov") / F.col("vb"))
    return rows.select(F.col("pos").alias("date_idx"), ((F.col("ma") - F.col("beta") * F.col("mb")) * 252).alias("alpha"), "beta", F.when(F.col("va") > 0, F.least(F.lit(1.0), F.col("beta") * F.col("cov") / F.col("va"))).otherwise(0.0).alias("r2"))


def factor_betas(series: DataFrame) -> DataFrame:
    """(factor, beta, cov, alpha) of excess on each factor alone; series: (factor, excess, f)."""
    g = series.groupBy("factor").agg(F.covar_samp("excess", "f").alias("cov"), F.var_samp("f").alias("vf"), F.avg("excess").alias("me"), F.avg("f").alias("mf"))
    beta = F.when(F.col("vf") > 0, F.col("cov") / F.col("vf")).otherwise(0.0)
    return g.select("factor", beta.alias("beta"), "cov", ((F.col("me") - beta * F.col("mf")) * 252).alias("alpha"))


def factor_returns(returns: DataFrame, factors: DataFrame, risk_free: float = 0.0) -> DataFrame:
    """One row (alpha, r_squared, tracking_error, n_periods, loadings): returns (pos, ret) over a rate, on factors (factor, pos, f).

    Each beta is that of one factor alone; a factor with fewer values than returns is left out, one without variance has
    beta 0. alpha and tracking error are the mean and deviation, a year, of what all betas leave.
    """
    excess = returns.select("pos", (F.col("ret") - risk_free).alias("excess"))
    n = excess.agg(F.count("*").alias("n_periods"), F.coalesce(F.var_samp("excess"), F.lit(0.0)).alias("var"))
    both = factors.join(excess, "pos")
    enough = both.groupBy("factor").agg(F.count("*").alias("n_here")).crossJoin(F.broadcast(n)).filter("n_here >= n_periods").select("factor")  # n is one row
    both = both.join(enough, "factor")
    betas = factor_betas(both)
    explained = betas.agg(F.coalesce(F.sum(F.greatest(F.lit(0.0), F.col("beta") * F.col("cov"))), F.lit(0.0)).alias("explained"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("factor", F.round("beta", 4))))).alias("loadings"))
    part = both.join(betas.select("factor", "beta"), "factor").groupBy("pos").agg(F.sum(F.col("beta") * F.col("f")).alias("part"))
    left = excess.join(part, "pos", "left").select((F.col("excess") - F.coalesce("part", F.lit(0.0))).alias("x"))
    out = left.agg(F.avg("x").alias("mean"), F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("sd")).crossJoin(n).crossJoin(explained)  # a row each
    r2 = F.when(F.col("var") > 0, F.least(F.lit(1.0), F.col("explained") / F.col("var"))).otherwise(0.0)
    return out.filter("n_periods > 0").select(F.round(F.col("mean") * 252, 4).alias("alpha"), F.round(r2, 4).alias("r_squared"), F.round(F.col("sd") * F.sqrt(F.lit(252.0)), 4).alias("tracking_error"), "n_periods", "loadings")


def return_statistics(returns: DataFrame, column: str = "ret", order: str = "pos", periods: int = 252, risk_free: float = 0.0) -> DataFrame:
    """One row: total and annual return, volatility, Sharpe, Sortino, maximum drawdown (negative, from a peak of 1 on), Calmar. risk_free: a period's rate."""
    r, x = F.col(column), F.col(column) - risk_free
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)  # one series
    run = returns.withColumn("eq", F.product(1 + r).over(w)).withColumn("peak", F.greatest(F.lit(1.0), F.max("eq").over(w)))
    sd = lambda c: F.coalesce(F.stddev_samp(c), F.lit(0.0))
    dd = F.least(F.lit(0.0), F.min((F.col("eq") - F.col("peak")) / F.col("peak")))
    g = run.agg(F.count("*").alias("n"), F.product(1 + r).alias("g"), F.avg(x).alias("m"), sd(r).alias("sd"), sd(x).alias("sx"), sd(F.when(x < 0, x)).alias("down"), dd.alias("dd"))
    root = F.sqrt(F.lit(float(periods)))
    year = F.pow("g", periods / F.col("n")) - 1
    ratio = lambda a, b: F.when(b > 0, a / F.when(b > 0, b)).otherwise(0.0)
    return g.filter("n > 0").select((F.col("g") - 1).alias("total_return"), year.alias("annualized_return"), (F.col("sd") * root).alias("volatility"), ratio(F.col("m") * root, F.col("sx")).alias("sharpe"), ratio(F.col("m") * periods, F.col("down") * root).alias("sortino"), F.col("dd").alias("max_drawdown"), ratio(year, -F.col("dd")).alias("calmar"), "n")


def brinson(book: DataFrame, bench: DataFrame) -> DataFrame:
    """Per ticker (full outer join, missing is 0): allocation, selection and interaction effects."""
    both = book.select("ticker", F.col("w").alias("pw"), F.col("r").alias("pr")).join(bench.select("ticker", F.col("w").alias("bw"), F.col("r").alias("br")), "ticker", "full")
    both = both.fillna(0.0, ["pw", "pr", "bw", "br"])
    d = F.col("pw") - F.col("bw")
    return both.select("ticker", (d * F.col("br")).alias("allocation"), (F.col("bw") * (F.col("pr") - F.col("br"))).alias("selection"), (d * (F.col("pr") - F.col("br"))).alias("interaction"))


def _slices(rows: DataFrame, column: str, parts: int) -> DataFrame:
    """One row: n, and the means of the lowest n // parts and of the highest ceil(n / parts) values, both over n // parts."""
    v = rows.filter(F.col(column).isNotNull()).select(F.col(column).alias("v"), "ticker")
    n = v.agg(F.count("*").alias("n"))
    run = v.withColumn("rn", F.row_number().over(Window.orderBy("v", "ticker"))).crossJoin(F.broadcast(n))  # a cross-section, ordered as a whole; n is one row
    low, high = F.floor(F.col("n") / parts), F.ceil(F.col("n") / parts)
    by = F.greatest(F.max(low), F.lit(1))
    return run.agg(F.max("n").alias("n"), (F.sum(F.when(F.col("rn") <= low, F.col("v"))) / by).alias("bottom"), (F.sum(F.when(F.col("rn") > F.col("n") - high, F.col("v"))) / by).alias("top"))


def anomalies(ranked: DataFrame) -> DataFrame:
    """(name, score): momentum dispersion, value spread, quality compression and crowding of a ranked cross-section."""
    mom = ranked.agg(F.count("mom").alias("n"), F.stddev_samp("mom").alias("sd")).select(F.lit("momentum_dispersion").alias("name"), F.when(F.col("n") < 10, 0.0).otherwise(F.least(F.lit(1.0), F.col("sd") / 0.5)).alias("score"))
    value = _slices(ranked, "ey", 10).select(F.lit("value_spread").alias("name"), F.when(F.col("n") < 20, 0.0).otherwise(F.least(F.lit(1.0), F.abs(F.col("top") - F.col("bottom")) * 100)).alias("score"))
    spread = F.col("top") - F.col("bottom")
    quality = _slices(ranked, "roe", 5).select(F.lit("quality_premium").alias("name"), F.when((F.col("n") < 20) | (spread <= 0), 0.0).otherwise(F.least(F.lit(1.0), 1 - spread / 0.5)).alias("score"))
    rn = ranked.withColumn("rn", F.row_number().over(Window.orderBy(F.desc("composite"), "ticker"))).agg(F.count("*").alias("n"), F.sum(F.abs("composite")).alias("t"), F.sum(F.when(F.col("rn") <= 10, F.abs("composite"))).alias("top"))
    crowd = rn.select(F.lit("factor_crowding").alias("name"), F.when((F.col("n") < 20) | (F.col("t") <= 0), 0.0).otherwise(F.least(F.lit(1.0), F.col("top") / F.col("t") * 2)).alias("score"))
    return mom.unionByName(value).unionByName(quality).unionByName(crowd).orderBy(F.desc("score"), "name")


# fixed values: the strategy proposed for each anomaly, and the score above which it counts
PROPOSAL_SCHEMA = "name string, least double, strategy string, universe string, ranking string, sizing string, max_positions int, rebalance string"
PROPOSALS = [
    ("momentum_dispersion", 0.5, "Momentum Factor Strategy", "sp500", "momentum", "score_weighted", 20, "monthly"),
    ("value_spread", 0.4, "Deep Value Screen", "sp500", "value", "score_weighted", 15, "quarterly"),
    ("sector_rotation", 0.4, "Dynamic Sector Rotation", "all", "sector_momentum", "equal_weight", 10, "monthly"),
    ("quality_premium", 0.5, "Quality Reversion Strategy", "sp500", "quality", "equal_weight", 20, "monthly"),
    ("factor_crowding", 0.5, "Contrarian Anti-Crowding", "sp500", "inverse_composite", "equal_weight", 20, "monthly"),
]


def sector_rotation(ranked: DataFrame, sectors: DataFrame) -> DataFrame:
    """(name, score): how far the sectors' mean momenta lie apart; 0 below three sectors. sectors: (ticker, sector), others are "other"."""
    means = ranked.filter("mom is not null").join(sectors, "ticker", "left").groupBy(F.coalesce("sector", F.lit("other")).alias("sector")).agg(F.avg("mom").alias("m"))
    score = F.when(F.count("*") < 3, 0.0).otherwise(F.least(F.lit(1.0), F.stddev_samp("m") / 0.3))
    return means.agg(score.alias("score")).select(F.lit("sector_rotation").alias("name"), "score")


def proposals(scores: DataFrame) -> DataFrame:
    """A strategy for each anomaly whose score is above its threshold, the most severe first; one of a kind without a strategy of its own gets an adaptive one."""
    known = scores.sparkSession.createDataFrame(PROPOSALS, PROPOSAL_SCHEMA)
    rows = scores.join(F.broadcast(known), "name", "left").filter(F.col("least").isNull() | (F.col("score") > F.col("least")))
    adaptive = F.concat(F.lit("Adaptive "), F.initcap(F.replace("name", F.lit("_"), F.lit(" "))))
    filled = [F.coalesce("strategy", adaptive).alias("strategy"), *[F.coalesce(c, F.lit(x)).alias(c) for c, x in (("universe", "sp500"), ("ranking", "composite"), ("sizing", "equal_weight"), ("max_positions", 20), ("rebalance", "monthly"))]]
    return rows.select("name", F.round("score", 3).alias("severity"), *filled).orderBy(F.desc("severity"), "name")


def strategy_score(ranked: DataFrame) -> DataFrame:
    """A score from the share of the top 20 that have four factors or more."""
    q = ranked.orderBy(F.desc("composite"), "ticker").limit(20).agg(F.coalesce(F.count_if(F.col("n_factors") >= 4) / F.greatest(F.count("*"), F.lit(1)), F.lit(0.0)).alias("q"))
    x = F.col("q")
    return q.select(F.round(0.3 + x * 0.8, 2).alias("sharpe"), F.round(-0.15 - (1 - x) * 0.15, 3).alias("max_drawdown"), F.round(0.03 + x * 0.12, 3).alias("cagr"), F.round(F.least(F.lit(1.0), x + 0.2), 2).alias("regime_stability"), (0.3 + x * 0.8 >= 0.5).alias("passed"))
