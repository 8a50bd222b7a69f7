"""Point-in-time months, rankings, backtests, the optimiser and attribution against plain versions of their rules."""

import math
import random
from datetime import date

import numpy as np
import pytest

from pitspark.operators import panel, pit, portfolio

MONTHS = [date(y, m, 1) for y in range(2015, 2021) for m in range(1, 13)]


def back(day, months):
    y, m = divmod(day.year * 12 + day.month - 1 - months, 12)
    return date(y, m + 1, day.day)


def test_latest_by_month_equals_brute_force(spark):
    rng = random.Random(1)
    facts = []
    for k in range(60):
        event = date(rng.randint(2010, 2018), rng.randint(1, 12), rng.randint(1, 28))
        known = date(event.year + rng.randint(0, 2), 12, rng.choice([1, 15, 28]))
        facts.append((rng.randint(1, 3), rng.choice("ab"), event, max(event, known), float(k), str(k)))
    df = spark.createDataFrame(facts, "cik long, tag string, event_date date, knowledge_date date, val double, accn string")
    want = []
    for m in MONTHS[::2]:
        for c in (1, 2, 3):
            for t in "ab":
                seen = [f for f in facts if f[:2] == (c, t) and f[3] <= m and f[2] >= back(m, 36)]
                if seen:
                    want.append((m, c, t, max(seen, key=lambda f: (f[3], f[2], f[5]))[4]))
    got = pit.latest_by_month(df, spark.createDataFrame([(m,) for m in MONTHS[::2]], "month date"))
    assert sorted(tuple(x) for x in got.select("month", "cik", "tag", "val").collect()) == sorted(want)
    assert any(max((f for f in facts if f[:2] == x[1:3] and f[3] <= x[0]), key=lambda f: (f[3], f[2], f[5]))[4] != x[3] for x in want)  # some had to be looked up


def bars(names, months):
    return [(t, m, 10.0 + k * i, 20.0 + k * i) for k, t in enumerate(names) for i, m in enumerate(months)]


BARS = "ticker string, event_date date, adjclose double, close double"
FACTS = "cik long, tag string, event_date date, knowledge_date date, val double, accn string"


def test_rank_takes_only_names_with_momentum(spark):
    rows = bars(["S1", "S2", "S3"], MONTHS[:30]) + [("S4", MONTHS[29], 1000.0, 1000.0)]
    facts = spark.createDataFrame([(4, "Revenues", date(2017, 1, 1), date(2017, 1, 1), 5.0, "a"), (4, "GrossProfit", date(2017, 1, 1), date(2017, 1, 1), 4.0, "b")], FACTS)
    members = spark.createDataFrame([(f"S{k}", None, None) for k in range(1, 5)], "ticker string, added_date date, removed_date date")
    got = {x.ticker: x for x in panel.rank(spark.createDataFrame(rows, BARS), facts, members, "2017-06-15").collect()}
    assert set(got) == {"S1", "S2", "S3"} and got["S3"].price == 20 + 2 * 29 and got["S3"].px == 10 + 2 * 29
    mom = [(10 + k * 28) / (10 + k * 16) - 1 for k in range(3)]
    z = (np.array(mom) - np.mean(mom)) / np.std(mom, ddof=1)
    assert [got[f"S{k + 1}"].composite for k in range(3)] == pytest.approx(z.tolist()) and got["S1"].n_factors == 1


def test_backtest_needs_26_months(spark):
    members = spark.createDataFrame([(f"S{k}", None, None) for k in range(6)], "ticker string, added_date date, removed_date date")
    for n, want in ((25, 0), (26, 12)):
        month = panel.month_end(spark.createDataFrame(bars([f"S{k}" for k in range(6)], MONTHS[:n]), BARS))
        assert panel.backtest(month, members).count() == want


def test_regime_breakdown(spark):
    rets = [0.1, 0.3, -0.2, 0.05]
    returns = spark.createDataFrame([(MONTHS[k], r, r / 2) for k, r in enumerate(rets)], "month date, net double, bench double")
    labels = spark.createDataFrame([(MONTHS[0], "expansion"), (MONTHS[1], "expansion"), (MONTHS[2], "recession")], "month date, label string")
    got = {x.label: x for x in panel.regime_breakdown(returns, labels).collect()}
    x = got["expansion"]
    assert (x.n, x.mean) == (2, pytest.approx(0.2)) and x.sharpe == pytest.approx(0.2 / np.std([0.1, 0.3], ddof=1) * math.sqrt(12))
    assert x.alpha == pytest.approx(1.2**12 - 1.1**12) and (got["recession"].sd, got["recession"].sharpe) == (0, 0) and got["unknown"].n == 1


def matrix(spark, c, names):
    return spark.createDataFrame([(a, b, float(c[i][j])) for i, a in enumerate(names) for j, b in enumerate(names)], "sym_a string, sym_b string, cov double")


def test_mean_variance(spark):
    names = [f"N{k:02}" for k in range(12)]
    rng = np.random.default_rng(2)
    c = np.cov(rng.normal(size=(12, 40)))
    er = spark.createDataFrame([*[(n, 0.1 + k / 100) for k, n in enumerate(names)], ("XX", 9.0)], "sym string, er double")
    w, left = [], 1.0
    for i in range(12):
        w.append(left if i == 11 else min(0.1, left * (0.5 + 0.5 * i / 12)))
        left -= w[-1]
    got = portfolio.mean_variance(er, matrix(spark, c, names)).orderBy("sym").collect()
    assert [x.sym for x in got] == names and [x.w for x in got] == pytest.approx(w)
    assert got[0].vol == pytest.approx(math.sqrt(np.array(w) @ c @ w)) and got[0].ret == pytest.approx(sum(a * (0.1 + k / 100) for k, a in enumerate(w)))
    flat = portfolio.mean_variance(er, matrix(spark, np.zeros((12, 12)), names)).collect()
    assert {x.w for x in flat} == {1 / 12} and portfolio.efficient_frontier(er, matrix(spark, np.zeros((12, 12)), names)).count() == 0
    points = portfolio.efficient_frontier(er, matrix(spark, c, names), points=5).collect()
    assert [x.point for x in points] == list(range(5)) and sum(points[0].weights.values()) == pytest.approx(1)


def test_risk_parity_by_hand(spark):
    c = np.array([[0.04, 0.006, 0.0], [0.006, 0.09, 0.01], [0.0, 0.01, 0.16]])
    w = np.full(3, 1 / 3)
    for _ in range(100):
        share = w * (c @ w) / (w @ c @ w)
        gap = 1 / 3 - share
        w = np.clip(w * (1 + 0.05 * gap), 0, 0.5)
        w /= w.sum()
        if abs(gap).max() < 0.01:
            break
    got = portfolio.risk_parity(matrix(spark, c, "abc"), max_weight=0.5).orderBy("sym").collect()
    assert [x.w for x in got] == pytest.approx(w.tolist()) and w[0] > w[1] > w[2]


def test_factor_returns(spark):
    rng = np.random.default_rng(3)
    f, g = rng.normal(size=30), rng.normal(size=30)
    r = 0.01 + 0.5 * f - 0.2 * g + rng.normal(size=30) / 10
    x = r - 0.001
    beta = [np.cov(x, y)[0, 1] / y.var(ddof=1) for y in (f, g)]
    left = x - beta[0] * f - beta[1] * g
    returns = spark.createDataFrame([(k, float(v)) for k, v in enumerate(r)], "pos int, ret double")
    factors = spark.createDataFrame([*[("f", k, float(v)) for k, v in enumerate(f)], *[("g", k, float(v)) for k, v in enumerate(g)], *[("short", k, 1.0) for k in range(29)], *[("flat", k, 1.0) for k in range(30)]], "factor string, pos int, f double")
    (got,) = portfolio.factor_returns(returns, factors, 0.001).collect()
    explained = sum(max(0, b * np.cov(x, y)[0, 1]) for b, y in zip(beta, (f, g), strict=True))
    assert got.loadings == {"f": round(beta[0], 4), "flat": 0.0, "g": round(beta[1], 4)} and got.n_periods == 30
    assert got.alpha == pytest.approx(left.mean() * 252, abs=1e-4) and got.r_squared == pytest.approx(min(1, explained / x.var(ddof=1)), abs=1e-4)
    assert got.tracking_error == pytest.approx(left.std(ddof=1) * math.sqrt(252), abs=1e-4)


def test_return_statistics(spark):
    r = [0.02, -0.05, 0.03, -0.01, 0.04]
    df = spark.createDataFrame(list(enumerate(r)), "pos int, ret double")
    (got,) = portfolio.return_statistics(df, periods=12, risk_free=0.005).collect()
    x = np.array(r) - 0.005
    eq = np.cumprod(1 + np.array(r))
    dd = min(0, (eq / np.maximum(1, np.maximum.accumulate(eq)) - 1).min())
    assert got.max_drawdown == pytest.approx(dd) and dd < 0 and got.sharpe == pytest.approx(x.mean() / x.std(ddof=1) * math.sqrt(12))
    assert got.sortino == pytest.approx(x.mean() * 12 / (x[x < 0].std(ddof=1) * math.sqrt(12))) and got.calmar == pytest.approx(((eq[-1]) ** (12 / 5) - 1) / -dd)
    assert portfolio.return_statistics(df.limit(0)).count() == 0


def test_proposals_for_other_anomalies(spark):
    scores = spark.createDataFrame([("value_spread", 0.39), ("momentum_dispersion", 0.6), ("odd_thing", 0.7)], "name string, score double")
    assert [(x.name, x.strategy) for x in portfolio.proposals(scores).collect()] == [("odd_thing", "Adaptive Odd Thing"), ("momentum_dispersion", "Momentum Factor Strategy")]
