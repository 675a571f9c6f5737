"""The summary sentence of scores that nearly cancel."""

from datetime import datetime

import duckdb

from murmur.plans.catalog import ORACLE, QUERIES


def test_a_small_negative_average_keeps_its_sign(spark, tmp_path):
    # two articles of opposite scores; the negative one is a little hotter, or the positive one
    rows = [(event_id, datetime(2024, 1, 1), user, "click", value, "{}") for user, first, second in ((1, 1000.0001, 1000.0), (2, 1000.0, 1000.0001))
            for event_id, value in ((201 + 56_280_000 * user, first), (401 + 56_280_000 * user, second))]
    kinds = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, kinds).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(tuple(r) for r in QUERIES["M5_summary_sentence"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert got == sorted(con.sql(ORACLE["M5_summary_sentence"]).fetchall())
    assert [text.endswith("加权平均分-0.000。") for _event, text in got] == [True, False]
