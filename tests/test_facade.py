"""The warehouse from landed files, its reads and the commands, end to end on a small root; and planted strategy cases."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from pitspark import cli
from pitspark.facade import NotFound, Reads
from pitspark.operators import strategies as stg
from pitspark.sources import warehouse


def put(root, folder, name, rows):
    path = root / "raw" / folder
    path.mkdir(parents=True, exist_ok=True)
    (path / name).write_text("\n".join(json.dumps(x) for x in rows))


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("root")
    months = [f"{y}-{m:02d}-01" for y in (2020, 2021, 2022) for m in range(1, 13)]
    for k, t in enumerate("ABCDEF"):
        put(root, "prices", f"{t}.jsonl", [{"ticker": t, "date": d, "open": 1, "high": 2, "low": 1, "close": 10 + k * i, "adjclose": 10 + k * i, "volume": 5} for i, d in enumerate(months)] + [{"ticker": t, "date": "2022-12-02", "close": -1}, {"ticker": t, "date": "2022-12-03"}])
    put(root, "security_master", "s.jsonl", [{"cik": i, "ticker": t, "name": t} for i, t in enumerate("ABCDEF")])
    put(root, "sp500_membership", "m.jsonl", [{"index_name": "SP500", "ticker": t} for t in "ABCDE"])
    put(root, "edgar", "e.jsonl", [{"cik": 1, "tag": "Revenues", "unit": "USD", "end": "2021-03-31", "filed": f"2021-0{m}-01", "val": m, "accn": str(m)} for m in (5, 6)] + [{"cik": 1, "tag": "Revenues", "unit": "USD", "end": "2021-03-31", "filed": "2021-01-01", "val": 1, "accn": "x"}, {"cik": 1, "tag": "Revenues", "unit": "USD", "end": "2021-03-31", "filed": "2021-07-01", "accn": "y"}])
    return root


def test_build_and_reads(spark, root, capsys):
    counts = warehouse.build(spark, str(root))
    assert counts["prices"] == 216 and counts["fundamentals"] == 2 and counts["macro"] == 0
    now = [0.0]
    reads = Reads(spark, str(root), clock=lambda: now[0])
    report = reads.validate()
    assert report["ok"] and report["checks"]["restated_period_facts"] == 1
    assert report["quarantine_reasons"] == {"nonpositive_close": 6, "null_close": 6, "lookahead": 1, "null_value": 1}
    assert [x.val for x in reads.pit("b", "Revenues", "2021-05-15").collect()] == [5.0]
    with pytest.raises(NotFound):
        reads.pit("ZZ", "Revenues", "2021-05-15")
    found = reads.signals(3, "2022-06-15")
    assert found["count"] == 3 and found["signals"][0]["ticker"] == "E"
    assert reads.signals(3, "2022-06-15") is found
    now[0] = 31.0
    assert reads.signals(3, "2022-06-15") is not found
    assert reads.prices("c", 2, "2020-03-15")["prices"][0]["date"] == date(2020, 3, 1)
    assert reads.factors("b", "2022-06-15")["px"] == 10 + 29
    assert reads.answer("/universe/pharma-biotech")[1]["count"] == 12
    assert reads.answer("/health")[1]["prices_count"] == 216
    assert reads.answer("/prices/ZZ")[0] == 404 and reads.answer("/prices/A?days=0")[0] == 422 and reads.answer("/nothing")[0] == 404
    assert reads.answer("/regime?asof=2022-01-01")[0] == 200
    for command in (["pit", "B", "Revenues", "2021-07-15"], ["watch", "aa", "bb"], ["unwatch", "aa"], ["watched"], ["signals", "2", "--asof", "2022-06-15"], ["backtest"]):
        cli.main(["--root", str(root), *command], spark)
    out = capsys.readouterr().out
    assert "1 periods" in out and "\nBB\n" in out and "AA" not in out and "multifactor net" in out


def test_land_merges(spark, tmp_path):
    batch = lambda *rows: spark.createDataFrame(list(rows), "cik long, ticker string, name string")
    assert warehouse.land(spark, str(tmp_path), "security_master", batch((1, "A", "old"), (2, "B", "b"))) == 2
    assert warehouse.land(spark, str(tmp_path), "security_master", batch((1, "A", "new"), (None, "C", "c"))) == 1
    assert warehouse.land(spark, str(tmp_path), "security_master", batch((None, "C", "c"))) == 0
    rows = warehouse.landed(spark, str(tmp_path), "security_master").collect()
    assert sorted((x.ticker, x.name) for x in rows) == [("A", "new"), ("B", "b"), ("C", "c")]


def test_membership_from_page(spark, tmp_path):
    page = tmp_path / "p.html"
    page.write_text("<table><tr><th>T</th></tr><tr><td>BRK.B</td><td/><td/><td/><td/><td>2010-02-16</td></tr><tr><td>NEW</td></tr></table><table><tr><th>D</th></tr><tr><td>March 5, 2020</td><td>NEW</td><td>n</td><td>OLD</td></tr></table>")
    rows = {x.ticker: (x.added_date, x.removed_date) for x in cli.membership(spark, str(page)).collect()}
    assert rows == {"BRK-B": ("2010-02-16", None), "NEW": ("2020-03-05", None), "OLD": (None, "2020-03-05")}


def test_revenue_runs(spark):
    rows = [(1, "Revenues", date(y, m, 1), date(y, m, 1), float(x), f"{y}{m}") for (y, m), x in zip([(y, m) for y in (2019, 2020) for m in (1, 4, 7, 10)], [10, 10, 10, 10, 11, 12, 14, 17], strict=True)]
    facts = spark.createDataFrame(rows, "cik long, tag string, event_date date, knowledge_date date, val double, accn string")
    day = F.lit("2020-12-01").cast("date")
    (x,) = stg.earnings_revision(facts, day).collect()
    assert (x.growth, x.enters, x.leaves) == (0.7, True, False)
    more = spark.createDataFrame([(1, "NetIncomeLoss", date(2020, 9, 1), date(2020, 9, 2), 20.0, "a"), (1, "StockholdersEquity", date(2020, 9, 1), date(2020, 9, 2), 100.0, "b"), (1, "LongTermDebt", date(2020, 9, 1), date(2020, 9, 2), 40.0, "c")], facts.schema)
    assert [(x.rising, x.enters) for x in stg.quality_momentum(facts.union(more), day).collect()] == [(True, True)]
    assert stg.earnings_revision(facts.limit(0), day).count() == 0
