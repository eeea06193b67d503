"""Queries whose shifts stay as wide as the split table, and reports that write their few stations first."""

from catalog import describe, evaluate
from catalog import fixtures as fx
from tidemark.operators import series

KEYS = ["station", "feature"]
DATA = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lags_shift_rows_of_all_features_at_once(spark):
    plan = plan_of(evaluate._lags(spark, DATA))
    assert "REPARTITION_BY_NUM" in plan and plan.index("Generate inline") < plan.index("Window")  # made long above the window
    rows, want = evaluate.lags(spark, DATA), fx.long_series(spark, DATA)
    shifted = series.lagged(want.select(*KEYS, "obs_time", "split", "pos", "n", "value"), KEYS, {f"l{k}": ("value", k) for k in range(1, 6)})
    assert rows.columns == shifted.columns and rows.exceptAll(shifted).isEmpty() and shifted.exceptAll(rows).isEmpty()


def test_report_reads_the_long_series_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(describe, "_with_lines", lambda long: seen.append(long) or long)
    describe.station_series_report(spark, DATA)
    plan = plan_of(seen[0])
    assert "Join" not in plan and plan.count("Scan parquet") == 1  # the stations' rows are written before they are read again
