"""Fetching, charts, nested tables, keys of any kind and the tick store."""

import gzip
import io
import urllib.error
from datetime import UTC, date, datetime, timedelta
from email.message import Message

import pytest
from pyspark.sql import functions as F

from pitspark import cli
from pitspark.operators import macro, names
from pitspark.sources import html_tables, landing
from pitspark.sources.http import Fetcher, FetchError, HostPaused
from pitspark.streaming import ticks


class Answer(io.BytesIO):
    def __init__(self, body, packed=""):
        super().__init__(body)
        self.headers = {"Content-Encoding": packed}


def fetcher(*answers, **more):
    todo, slept = list(answers), []

    def open_url(request, timeout):
        x = todo.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    return Fetcher(open_url=open_url, clock=lambda: sum(slept), sleep=slept.append, **more), slept, todo


def status(code, after=None):
    headers = Message()
    if after:
        headers["Retry-After"] = after
    return urllib.error.HTTPError("u", code, "x", headers, None)


def test_fetcher_retries_and_unpacks():
    f, slept, _ = fetcher(status(503), status(429, "7"), Answer(gzip.compress(b'{"a": 1}'), "gzip"))
    assert f.json("http://h/x") == {"a": 1} and 0.5 <= slept[0] <= 1 and 7 in slept
    f, slept, todo = fetcher(status(404), Answer(b"x"))
    with pytest.raises(FetchError) as e:
        f.get("http://h/x")
    assert e.value.status == 404 and not slept and len(todo) == 1


def test_fetcher_paces_and_pauses_hosts():
    f, slept, _ = fetcher(Answer(b"a"), Answer(b"b"), Answer(b"c"), pace={"h": 0.5})
    assert (f.get("http://h/1"), f.get("http://i/1"), f.get("http://h/2")) == (b"a", b"b", b"c") and slept == [0.5]
    f, slept, _ = fetcher(*[OSError("down")] * 5, attempts=1)
    for _ in range(5):
        with pytest.raises(FetchError):
            f.get("http://h/")
    with pytest.raises(HostPaused):
        f.get("http://h/")
    slept.append(31.0)
    f.open_url = lambda request, timeout: Answer(b"up")
    assert f.get("http://h/") == b"up"


def test_charts(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"ticker":"abc","ts":[1577836800,1577923200],"open":[1,2],"high":[3,4],"low":[0.5,1],"close":[2,null],"volume":[7,8],"dividends":{"1":{"date":1577836800,"amount":0.25}},"splits":{"2":{"date":1577923200,"numerator":4,"denominator":1}}}\n{"ticker":"x"}')
    docs = landing.scan_json(spark, str(tmp_path), landing.CHART_SCHEMA)
    (bar,) = landing.flatten_chart(docs).collect()
    assert (bar.ticker, bar.event_date, bar.open, bar.high, bar.low, bar.close, bar.adjclose, bar.volume) == ("ABC", date(2020, 1, 1), 1, 3, 0.5, 2, None, 7)
    assert sorted(tuple(x) for x in landing.chart_actions(docs).collect()) == [("ABC", date(2020, 1, 1), "dividend", "0.25"), ("ABC", date(2020, 1, 2), "split", "4/1")]


def test_prices_command_lands_actions(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"ticker":"abc","ts":[1577836800],"close":[2],"splits":{"2":{"date":1577836800,"numerator":4,"denominator":1}}}')
    cli.main(["--root", str(tmp_path / "root"), "prices", str(tmp_path / "c.json")], spark)
    assert spark.read.parquet(str(tmp_path / "root/warehouse/corporate_actions")).first().action_value == "4/1"


def test_nested_and_open_tables(spark):
    page = "<table><tr><td>a<td>b <table><tr><td>in</td></tr></table> c<tr><td>d</table><table><td>e"
    rows = html_tables.tables(spark.createDataFrame([(1, page)], "page_id long, html string")).collect()
    assert [(x.table_no, x.row_no, x.cells) for x in rows] == [(0, 0, ["a", "b in c"]), (0, 1, ["d"]), (1, 0, ["e"])]


def test_dates_within_text(spark, tmp_path):
    page = tmp_path / "p.html"
    page.write_text("<table><tr><th>T</th></tr><tr><td>AAA<td><td><td><td><td>since 2011-02-03 (x)</table><table></table>")
    assert cli.membership(spark, str(page)).first().added_date == "2011-02-03"


def test_merge_by_an_expression(spark):
    a = spark.createDataFrame([("x", 1, 1)], "k string, v long, seq long")
    b = spark.createDataFrame([("X", 2, 1), ("y", 3, 1)], "k string, v long, seq long")
    for key in (F.lower("k"), [F.lower("k")]):
        assert sorted((x.k, x.v) for x in landing.merge(a, b, key, "seq").collect()) == [("X", 2), ("y", 3)]
    assert landing.merge(a, b, "k", "seq").count() == 3


def test_match_token(spark):
    df = spark.createDataFrame([("The AbbVie Inc.",), ("Co of X",), (None,), ("Pharma Sciences Ltd",)], "t string")
    assert [x[0] for x in df.select(names.match_token(F.col("t"))).collect()] == ["abbvie", None, None, None]


def test_latest_with_date(spark):
    m = spark.createDataFrame([("s", date(2020, 1, 1), 1.0), ("s", date(2020, 2, 1), 2.0), ("s", date(2020, 3, 1), None)], "series_id string, event_date date, val double")
    assert macro.latest_with_date(m, "s") == (2.0, date(2020, 2, 1))
    with pytest.raises(LookupError):
        macro.latest_with_date(m, "t")


def test_tick_store(spark, tmp_path):
    root, now = str(tmp_path), datetime(2024, 5, 3, 12, tzinfo=UTC)
    assert ticks.stored(spark, root).count() == 0 and ticks.expire(spark, root, now) == 0
    rows = [("A", float(k), now - timedelta(hours=10 * k), k) for k in range(6)]
    ticks.append(spark.createDataFrame(rows, "ticker string, price double, ts timestamp, event_id long"), root)
    assert [tuple(x)[:4] for x in ticks.latest(ticks.stored(spark, root)).collect()] == [("A", 0.0, 0.0, 0)]
    assert ticks.expire(spark, root, now) == 3 and ticks.expire(spark, root, now) == 0
    assert sorted(x.price for x in ticks.stored(spark, root).collect()) == [0, 1, 2]


def test_polling(spark, tmp_path):
    rounds, slept = iter([["A", "B"], ["B"]]), []
    fetch = lambda s: {"price": 2.0, "change": None, "volume": 3} if s == "B" else None
    assert ticks.watch(spark, str(tmp_path), lambda: next(rounds), fetch, 60.0, 2, slept.append) == 2
    assert slept == [0.05, 0.05, 60.0, 0.05, 60.0]
    assert [(x.ticker, x.price, x.volume, x.source) for x in ticks.stored(spark, str(tmp_path)).collect()] == [("B", 2.0, 3, "poll")] * 2
    assert ticks.percent_of_two([4.0, 5.0], 9) == {"price": 5.0, "change": 25.0, "volume": 9} and ticks.percent_of_two([]) is None


def test_stream_counts_a_repeated_event_once(spark, tmp_path):
    schema = "event_id long, ts timestamp, user_id long, value double"
    at = datetime(2024, 5, 3, 12)
    for k, rows in enumerate([[(1, at, 7, 1.0)], [(1, at, 7, 1.0), (2, at + timedelta(hours=1), 7, 5.0)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/f{k}")
    got = ticks.stream_latest(spark, f"{tmp_path}/in/*", "*.parquet", spark.createDataFrame([], schema).schema, f"{tmp_path}/sink")
    assert [(x.ticker, x.price) for x in got.collect()] == [("U7", 5.0)]
