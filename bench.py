"""Times the headline queries; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from pitspark.plans import catalog

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ["pit_as_of", "pit_latest_per_tag", "pit_by_month", "restated_periods", "gate_facts_reasons", "members_by_month", "month_end_panel", "momentum_12_1_positional", "factors_pit", "composite_rank", "backtest_momentum_monthly", "backtest_multifactor_monthly", "regime_series", "cov_matrix", "name_resolve_fuzzy", "landing_merge", "latest_tick", "recent_ticks"]


def main() -> None:
    spark = SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["last_price"](spark, SF).write.format("noop").mode("overwrite").save()  # starts the engine
    took = {}
    for name in HEADLINE:
        began = time.time()
        catalog.QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF.rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
