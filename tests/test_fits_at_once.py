"""Fits side by side: no more than memory holds samples of."""

import random
import threading
import time

import pyarrow.parquet as pq

from tidemark.operators import learners
from tidemark.scratch import cache_bytes

KEYS = ["station", "feature"]


def _long(spark, features, n=200):
    rng = random.Random(5)
    rows = [("s", f, pos, n, "train" if pos < n * 8 // 10 else "val" if pos < n * 9 // 10 else "test", rng.gauss(0, 1))
            for f in features for pos in range(n)]
    return spark.createDataFrame(rows, "station string, feature string, pos long, n long, split string, value double")


def test_fits_follow_memory(spark):
    memory = cache_bytes(spark)
    assert memory > 0
    assert learners.fits_at_once(spark, 0) == learners.fits_at_once(spark, 1000) == learners.PARALLEL_FITS
    assert learners.fits_at_once(spark, memory // learners.POINT_BYTES) == 1
    assert learners.fits_at_once(spark, int(memory * learners.CACHE_SHARE / learners.POINT_BYTES / 2.5)) == 2


def test_large_fits_run_one_after_the_other(spark, monkeypatch):
    running, most, lock = [0], [0], threading.Lock()

    def fit(samples, regressor, feature, target="y1"):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        time.sleep(0.2)
        with lock:
            running[0] -= 1
        return feature

    monkeypatch.setattr(learners, "fit_pooled", fit)
    samples = learners.scaled_samples(_long(spark, "abc"), KEYS, "cnn_lstm")
    assert learners.fit_features(samples, learners.forest()) == {"y1": {f: f for f in "abc"}}
    assert most[0] > 1
    most[0] = 0
    monkeypatch.setattr(learners, "POINT_BYTES", cache_bytes(spark))
    learners.fit_features(samples, learners.forest())
    assert most[0] == 1


def test_one_step_from_packed_samples(spark, monkeypatch):
    written, plain = [], learners.scaled_samples

    def seen(*args, **kw):
        written.append(plain(*args, **kw))
        return written[-1]

    monkeypatch.setattr(learners, "scaled_samples", seen)
    out, _ = learners.one_step(_long(spark, "ab"), KEYS, "cnn_lstm", learners.forest().setNumTrees(2), packed=True)
    assert out.count() == 2 * (20 - 12) and out.where("forecast IS NULL OR actual IS NULL").isEmpty()
    files = [f.removeprefix("file:") for f in written[0].inputFiles()]
    assert not any("x12" in pq.ParquetFile(f).schema_arrow.names for f in files)
