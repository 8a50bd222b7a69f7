import itertools
import random
from datetime import date, timedelta

import numpy as np
from pyspark.sql import functions as F

from pitspark.operators import names, panel, pit, portfolio
from pitspark.sources import html_tables, landing
from pitspark.streaming import ticks


def z(spark, values):
    df = spark.createDataFrame([(str(i), v) for i, v in enumerate(values)], "ticker string, x double")
    return [x["z_x"] for x in panel.zscored(df, ("x",)).orderBy("ticker").collect()]


def test_zscore(spark):
    assert z(spark, [10.0, 20.0, 30.0]) == [-1, 0, 1]
    assert z(spark, [5.0, None, float("nan")]) == [0, 0, 0]
    assert z(spark, [7.0, 7.0, 7.0]) == [0, 0, 0]


def test_gate_and_as_of(spark):
    d = date
    f = spark.createDataFrame([(1, "t", d(2020, 1, 1), d(2020, 2, 1), 1.0, "a"), (1, "t", d(2020, 1, 1), d(2020, 6, 1), 2.0, "b"), (1, "t", d(2020, 1, 1), None, 3.0, "c"), (1, "t", d(2020, 1, 1), d(2019, 1, 1), 4.0, "d")], "cik long, tag string, event_date date, knowledge_date date, val double, accn string")
    gated = pit.gate(f)
    assert {x["accn"]: x["reject_reason"] for x in gated.collect()} == {"a": None, "b": None, "c": "null_knowledge_date", "d": "lookahead"}
    seen = lambda day: [x["val"] for x in pit.as_of(pit.live(gated), 1, "t", day).collect()]
    assert seen("2020-03-01") == [1.0] and seen("2020-07-01") == [2.0] and seen("2020-01-15") == []


def test_resolver_rules(spark):
    c = spark.createDataFrame([("AbbVie Inc.", 1), ("Moderna, Inc.", 2), ("Vertex Pharmaceuticals", 3)], "name string, cik long")
    s = spark.createDataFrame([("AbbVie",), ("ModernaTX",), ("Vertex",), ("Mod",), ("",), (None,)], "sponsor string")
    assert {x["sponsor"]: x["cik"] for x in names.resolve(s, c).collect()} == {"AbbVie": 1, "ModernaTX": 2, "Vertex": 3}


def test_resolver_equals_brute_force(spark):
    words = ["blue", "blues", "bluest", "sky", "a", "skyline", "bio", "biotech"]
    made = [" ".join(x) for n in (1, 2, 3) for x in itertools.product(words[: 9 - n], repeat=n)]
    sponsors, companies = made[::2] + [m + "us" for m in made[::3]], made[1::2] + made[::7]
    c = {}
    for k, m in enumerate(companies):
        c.setdefault(m, k)

    def loose(a, b):
        a, b = sorted((a, b), key=len)
        return len(a) >= 4 and b.startswith(a + " ") or len(a) >= 5 and b.startswith(a) and len(b) - len(a) <= 3

    want = {}
    for s in set(sponsors):
        found = [s] if s in c else sorted((x for x in c if loose(s, x)), key=lambda x: (-len(x), x))
        if found:
            want[s] = c[found[0]]
    got = names.resolve(spark.createDataFrame([(s,) for s in sponsors], "sponsor string"), spark.createDataFrame(list(zip(companies, range(len(companies)), strict=True)), "name string, cik long"))
    assert sorted((x["sponsor"], x["cik"]) for x in got.collect()) == sorted(want.items())


def test_every_part_is_resolved(spark, tmp_path):
    from pitspark.plans import catalog

    parts = [(k, f"{'forest' if k % 2 else 'azure'} item{k // 3 * 3}") for k in range(399, 600)]
    spark.createDataFrame(parts, "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    got = {x["sponsor"] for x in catalog.name_resolve_fuzzy(spark, str(tmp_path)).collect()}
    assert any(s.startswith(("forest item597", "azure item597")) for s in got)


def test_covariance_takes_the_first_200_symbols(spark):
    rng = random.Random(1)
    bars = [(f"T{k:03}", date(2020, 1, 1) + timedelta(days=j), 10 + rng.random()) for k in range(205) for j in range(25)]
    got = {(x["sym_a"], x["sym_b"]): x["cov"] for x in portfolio.covariance(spark.createDataFrame(bars, "ticker string, event_date date, close double")).collect()}
    assert len(got) == 200 * 200 and max(got)[0] == "T199"
    price = np.array([p for *_, p in bars]).reshape(205, 25)
    want = np.cov(price[[30, 150], 1:] / price[[30, 150], :-1] - 1)
    assert abs(got["T030", "T150"] - want[0, 1]) < 1e-7 and abs(got["T150", "T150"] - want[1, 1]) < 1e-7


def test_merge_last_wins(spark):
    a = spark.createDataFrame([(1, "x", 1), (2, "y", 2)], "k long, v string, seq long")
    b = spark.createDataFrame([(2, "z", 1), (3, "q", 1), (3, "r", 2)], "k long, v string, seq long")
    assert {x["k"]: x["v"] for x in landing.merge(a, b, ["k"], "seq").collect()} == {1: "x", 2: "z", 3: "r"}


def test_company_facts(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"cik": 5, "entity": "E", "facts": {"us-gaap": {"NI": {"units": {"USD": [{"val": 1, "end": "2020-01-01", "filed": "2020-02-01", "accn": "x"}, {"val": null, "end": "2020-01-01"}, {"val": 2, "end": ""}]}}}}}')
    got = landing.flatten_company_facts(landing.scan_json(spark, str(tmp_path), landing.FACTS_SCHEMA)).collect()
    assert [(x["tag"], x["val"], x["event_date"]) for x in got] == [("NI", 1.0, date(2020, 1, 1))]


def test_html_tables(spark):
    p = spark.createDataFrame([(1, "<table><tr><th>A</th><td>b  c</td></tr></table>"), (2, None)], "page_id long, html string")
    assert [(x["page_id"], x["cells"]) for x in html_tables.tables(p).collect()] == [(1, ["A", "b c"])]


def test_watch_list(spark):
    t = spark.createDataFrame([("a", 1, "add"), ("B", 2, "add"), ("a", 3, "remove"), ("c", 4, "add")], "symbol string, at long, op string")
    assert [x["symbol"] for x in ticks.watched(t, 1).collect()] == ["C"]


def test_as_of_join_prefers_the_newest_event(spark):
    d = date
    m = spark.createDataFrame([("s", d(2020, 1, 1), d(2020, 2, 1), 1.0), ("s", d(2020, 1, 2), d(2020, 2, 1), 2.0)], "series_id string, event_date date, knowledge_date date, val double")
    p = spark.createDataFrame([("s", d(2020, 1, 31)), ("s", d(2020, 2, 1))], "series_id string, day date")
    assert {x["day"]: x["val"] for x in pit.as_of_join(p, m, "series_id").collect()} == {d(2020, 1, 31): None, d(2020, 2, 1): 2.0}


def test_entry_lists_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert F is not None
