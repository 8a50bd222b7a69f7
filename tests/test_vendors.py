from datetime import date

from pitspark.sources import vendors


def rows(spark, text, schema):
    return spark.read.schema(schema).json(spark.sparkContext.parallelize([text]))


def test_macro_observations(spark):
    text = '{"series_id":"USREC","observations":[{"date":"2020-01-01","value":"1"},{"date":"2020-02-01","value":"."},{"date":"2020-03-01","value":""},{"date":"2020-04-01"}]}'
    assert [tuple(x) for x in vendors.macro_observations(rows(spark, text, vendors.OBSERVATIONS_SCHEMA)).collect()] == [("USREC", date(2020, 1, 1), 1.0, date(2020, 6, 29))]
    csv = spark.createDataFrame([("2020-01-01", "1.5"), ("2020-01-02", "."), ("2020-01-03", None)], "DATE string, DFF string")
    assert [tuple(x) for x in vendors.macro_csv(csv, "DFF").collect()] == [("DFF", date(2020, 1, 1), 1.5, date(2020, 1, 1))]


def test_estimates(spark):
    text = '{"ticker":"abc","fetched_date":"2024-01-02","quoteSummary":{"result":[{"earningsTrend":{"trend":[{"period":"0q","growth":{"raw":0.1},"earningsEstimate":{"avg":{"raw":2.5},"numberOfAnalysts":{"raw":7}},"epsTrend":{"7daysAgo":{"raw":2.4}},"epsRevisions":{"downLast7Days":{"raw":3}}},{"growth":{"raw":1}}]}}]}}'
    (x,) = vendors.estimates(rows(spark, text, vendors.ESTIMATES_SCHEMA)).collect()
    assert (x.ticker, x.period, x.avg_estimate, x.num_analysts, x.growth, x.eps_trend_7d_ago, x.revisions_down_7d, x.revisions_up_7d) == ("ABC", "0q", 2.5, 7, 0.1, 2.4, 3, None)
    assert vendors.estimates(rows(spark, '{"ticker":"abc","quoteSummary":{"result":[]}}', vendors.ESTIMATES_SCHEMA)).count() == 0


def test_drug_events(spark):
    text = '{"results":[{"application_number":"N1","sponsor_name":"X","products":[{"brand_name":"B","active_ingredients":[{"name":"Q"},{"name":"P"}]},{"brand_name":"A"}],"submissions":[{"submission_type":"ORIG","submission_number":"1","submission_status_date":"20200131"},{"submission_status_date":"2020"}]},{"application_number":"N2"}]}'
    found = vendors.drug_events(rows(spark, text, vendors.DRUGS_SCHEMA)).collect()
    assert [(x.application_number, x.brand, x.substance, x.event_date) for x in found] == [("N1", "A; B", "P; Q", date(2020, 1, 31)), ("N1", "A; B", "P; Q", None)]


def test_trials(spark):
    studies = spark.createDataFrame([("T1", "Acme Therapeutics, Inc."), ("T1", "Acme Therapeutics, Inc."), ("T2", "Other"), ("T3", None)], "nct_id string, lead_sponsor string")
    companies = spark.createDataFrame([("ACM", 5, "ACME THERAPEUTICS INC")], "ticker string, cik int, name string")
    assert [(x.ticker, x.cik, x.nct_id) for x in vendors.trials(studies, companies).collect()] == [("ACM", 5, "T1")]
