import pytest

import __spark_entry__  # noqa: F401  (sets the path)
from catalog import fixtures as fx, forecasting, prepare

SF = "/root/testdata/sf0.001"


class Seen(Exception):
    pass


def test_saved_models_take_all_stations_and_features(spark, monkeypatch):
    def stop(splits, layout, names, **kw):
        raise Seen(splits.select("station").distinct().count(), kw["top_n"], kw["features"])

    monkeypatch.setattr(forecasting.forecast, "forecast", stop)
    with pytest.raises(Seen) as seen:
        forecasting.saved_models_agree(spark, SF)
    stations = fx.splits(spark, SF).select("station").distinct().count()
    assert stations > 2 and seen.value.args == (stations, None, fx.FEATURES)


def test_ratio_frames_of_all_features(spark):
    got = prepare.supervised_frame_ratios_features(spark, SF)
    assert {r["feature"] for r in got.select("feature").distinct().collect()} == set(fx.FEATURES)
