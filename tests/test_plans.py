"""Queries against their SQL where the tables have little or nothing for them."""

import datetime
import math

import duckdb
import pytest

from orrery.plans import analysis

HOURS = {"none": [], "calm": [("click", 0, 40.0), ("click", 5, 200.0), ("view", 2, 250.0)], "one": [("click", 0, 40.0), ("click", 3, 260.0), ("view", 2, 160.0)]}
OVERALL = {"none": (None, 0, 0, None, None), "calm": (None, 0, 0, None, None), "one": (None, 1, 1, 1.0, 0.0)}


def plain(rows):
    """Rows sorted, with a text for NaN, which equals nothing."""
    return sorted((tuple("nan" if isinstance(x, float) and math.isnan(x) else x for x in r) for r in rows), key=str)


@pytest.mark.parametrize("name", HOURS)
def test_recall_overall_is_there_without_truth(spark, tmp_path, name):
    rows = [(c, datetime.datetime(2024, 1, 1, h), v) for c, h, v in HOURS[name]]
    spark.createDataFrame(rows, "event_type string, ts timestamp_ntz, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = analysis.bench_rollup(spark, str(tmp_path))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = plain(db.execute(analysis.SQL["bench_rollup"]).fetchall())
    assert plain(got.collect()) == want and got.dtypes == [("channel", "string"), ("n_truth", "bigint"), ("n_hit", "bigint"), ("recall", "double"), ("median_error", "double")]
    assert [tuple(None if x == "nan" else x for x in r) for r in want if r[0] is None] == [OVERALL[name]]
