"""Learned forecasters: one model per feature, pooled over all stations.

Inputs are the last twelve values of a series, scaled by the mean and spread of
its train split, so that one Spark ML model serves every station.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.linear import one_step_errors
from tidemark.operators.series import LOOKBACK, WHOLE, floors, supervised_frame
from tidemark.scratch import cache_bytes, materialize, scratch_path

SEED = 17
INPUTS = [f"x{k}" for k in range(1, LOOKBACK + 1)]
PARALLEL_FITS = 4
POINT_BYTES = 240  # what Spark ML keeps of a sample while it grows trees
CACHE_SHARE = 0.5
MAX_TREE_DEPTH = 30  # Spark ML builds none deeper


def boosted() -> GBTRegressor:
    """Depth 5, up to 100 trees, rate 0.1; the validation split decides when to stop."""
    return GBTRegressor(
        maxDepth=5, maxIter=100, stepSize=0.1, seed=SEED, validationIndicatorCol="held_out", validationTol=1e-4)


def forest() -> RandomForestRegressor:
    return RandomForestRegressor(numTrees=20, maxDepth=5, seed=SEED)


def ridge() -> LinearRegression:
    return LinearRegression(regParam=1e-4, elasticNetParam=0.0, solver="normal")


def scaling(long: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Per series: points per split, train mean (``center``) and spread (``scale``)."""
    train = F.when(F.col("split") == "train", F.col(value))
    return long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if((F.col("split") == s) & F.col(value).isNotNull()).alias(f"n_{s}") for s in ("train", "val", "test")],
        *[F.count_if(F.col("split") == s).alias(f"rows_{s}") for s in ("train", "val")],
        F.avg(train).alias("center"), F.nullif(F.stddev_samp(train), F.lit(0.0)).alias("scale"))


def long_enough(model: str, horizon: int = 1):
    train, val, test = floors(model, horizon)
    return (F.col("n_train") >= train) & (F.col("n_val") >= val) & (F.col("n_test") >= test)


def series_status(long: DataFrame, keys: list[str], model: str, horizon: int = 1) -> DataFrame:
    return scaling(long, keys).select(
        *keys, F.when(~long_enough(model, horizon), "too short").when(F.col("scale").isNull(), "constant")
        .otherwise("ok").alias("status"))


def scaled_samples(
    long: DataFrame, keys: list[str], model: str, *, horizon: int = 1, value: str = "value",
    group_rows: int | None = None, packed: bool = False,
) -> DataFrame:
    """Scaled samples of the eligible series, written once and partitioned by feature.

    ``packed`` writes the readings of a segment as one row and looks the inputs up in each
    pass: a fraction of the bytes, more work per pass. The samples are the same, but the
    draws of tree learners follow the way the files are cut.
    """
    stats = scaling(long, keys, value)
    usable = stats.where(long_enough(model, horizon) & F.col("scale").isNotNull())
    frame = supervised_frame(
        long, keys, horizon=horizon, value=value, group_rows=group_rows, attach=usable,
        label="samples" if packed else None, partition_by=["feature"])
    targets = [f"y{k}" for k in range(1, horizon + 1)]
    complete = frame.where(WHOLE).drop(WHOLE) if packed else frame.na.drop(subset=[*INPUTS, *targets])
    scaled = complete.withColumns({
        f"{c}": (F.col(c) - F.col("center")) / F.col("scale") for c in [*INPUTS, *targets]})
    marked = scaled.withColumn("held_out", F.col("split") == "val")
    return marked if packed else materialize(marked, "samples", ["feature"])


def fit_pooled(samples: DataFrame, regressor, feature: str, target: str = "y1") -> PipelineModel:
    """Fit one feature's model on its train rows (and held-out rows if the learner uses them)."""
    validates = regressor.hasParam("validationIndicatorCol") and regressor.isSet("validationIndicatorCol")
    splits = ["train", "val"] if validates else ["train"]
    mine = samples.where((F.col("feature") == feature) & F.col("split").isin(splits))
    assembler = VectorAssembler(inputCols=INPUTS, outputCol="inputs")
    learner = regressor.copy()
    learner.setFeaturesCol("inputs").setLabelCol(target).setPredictionCol("scaled")
    rows = assembler.transform(mine.select(*INPUTS, target, "held_out"))
    return PipelineModel(stages=[assembler, learner.fit(rows)])


def fit_features(
    samples: DataFrame, regressor, targets: tuple[str, ...] = ("y1",), *, failed: dict[str, str] | None = None
) -> dict[str, dict[str, PipelineModel]]:
    """One pooled model per target and feature, a few fits at a time.

    The number of features is a property of the schema. Learners of trees keep their samples
    between passes, so no more fits run side by side than memory holds samples of. A fit that
    fails raises; with a dict ``failed`` the reason goes there by feature, the feature is left
    out, and only if all fail does this raise.
    """
    counts = dict(samples.groupBy("feature").count().orderBy("feature").collect())
    features = list(counts)
    jobs = [(t, f) for t in targets for f in features]

    def fit(job):
        target, feature = job
        try:
            return fit_pooled(samples, regressor, feature, target)
        except Exception as e:  # the other features go on
            return e

    with ThreadPoolExecutor(fits_at_once(samples.sparkSession, max(counts.values(), default=0))) as pool:
        models = list(pool.map(inheritable_thread_target(samples.sparkSession)(fit), jobs))
    broken = {f: m for (_, f), m in zip(jobs, models) if isinstance(m, Exception)}
    if broken and (failed is None or all(isinstance(m, Exception) for m in models)):
        raise next(iter(broken.values()))
    if broken:
        failed.update({f: str(e)[:500] for f, e in broken.items()})
    fitted = [(job, m) for job, m in zip(jobs, models) if not isinstance(m, Exception)]
    return {t: {f: m for (u, f), m in fitted if u == t} for t in targets}


def fits_at_once(spark: SparkSession, rows: int) -> int:
    """How many fits over ``rows`` samples each run side by side without sending their samples to disk."""
    return int(max(1, min(PARALLEL_FITS, CACHE_SHARE * cache_bytes(spark) // (POINT_BYTES * max(rows, 1)))))


def predict_features(samples: DataFrame, models: dict[str, PipelineModel], *, split: str = "test") -> DataFrame:
    """Unscaled predictions for one split."""
    def one(feature: str, model: PipelineModel) -> DataFrame:
        rows = samples.where((F.col("feature") == feature) & (F.col("split") == split))
        return model.transform(rows).withColumn("forecast", F.col("center") + F.col("scale") * F.col("scaled"))

    parts = [one(f, m) for f, m in models.items()]
    if not parts:  # no series was long enough
        return samples.limit(0).withColumn("forecast", F.lit(None).cast("double"))
    return reduce(lambda a, b: a.unionByName(b), parts).drop("inputs", "scaled")


def _actual(rows: DataFrame, target: str = "y1"):
    return F.col("center") + F.col("scale") * F.col(target)


def one_step(
    long: DataFrame, keys: list[str], model: str, regressor, *, group_rows: int | None = None, failed: dict[str, str] | None = None,
    packed: bool = False
) -> tuple[DataFrame, dict[str, PipelineModel]]:
    """Twelve points to the next one: (test forecasts, fitted models). ``failed`` as in ``fit_features``, ``packed`` as in ``scaled_samples``."""
    samples = scaled_samples(long, keys, model, group_rows=group_rows, packed=packed)
    fitted = fit_features(samples, regressor, failed=failed)["y1"]
    out = predict_features(samples, fitted)
    ids = [c for c in ("obs_time", "pos") if c in out.columns]
    return out.select(*keys, *ids, _actual(out).alias("actual"), "forecast"), fitted


def multi_step(
    long: DataFrame, keys: list[str], model: str, regressor, horizon: int, *, group_rows: int | None = None
) -> tuple[DataFrame, dict[int, dict[str, PipelineModel]]]:
    """Twelve points to the next ``horizon``, one pooled model per step."""
    samples = scaled_samples(long, keys, model, horizon=horizon, group_rows=group_rows)
    by_target = fit_features(samples, regressor, tuple(f"y{k}" for k in range(1, horizon + 1)))
    fitted, parts = {int(t[1:]): models for t, models in by_target.items()}, []
    for step in range(1, horizon + 1):
        target = f"y{step}"
        out = predict_features(samples, fitted[step])
        ids = [c for c in ("obs_time", "pos") if c in out.columns]
        parts.append(out.select(
            *keys, *ids, F.lit(step).alias("step"), _actual(out, target).alias("actual"), "forecast"))
    return reduce(lambda a, b: a.unionByName(b), parts), fitted


@dataclass(frozen=True)
class Ridge:
    """Linear least squares with a penalty on the coefficients of standardised inputs."""

    penalty: float = 1e-4


def fit_ridge_steps(samples: DataFrame, horizon: int, learner: Ridge) -> DataFrame:
    """One row per (feature, step): ``intercept`` and ``coefficients`` of the twelve inputs.

    All steps of all features come from one scan: each task sums the cross products of
    inputs and targets per feature, and the small systems are solved from the sums.
    """
    targets = [f"y{k}" for k in range(1, horizon + 1)]
    columns = [*INPUTS, *targets]
    width = len(columns)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {}
        for batch in batches:
            values = np.column_stack([batch[c].to_numpy(zero_copy_only=False) for c in columns])
            owner = batch["feature"].dictionary_encode()
            codes = owner.indices.to_numpy(zero_copy_only=False)
            for code, feature in enumerate(owner.dictionary.to_pylist()):
                own = values[codes == code]
                n, s, c = sums.get(feature, (0, 0.0, 0.0))
                sums[feature] = n + len(own), s + own.sum(0), c + own.T @ own
        yield pa.record_batch([
            pa.array(list(sums), pa.string()), pa.array([n for n, _, _ in sums.values()], pa.int64()),
            pa.array([s.tolist() for _, s, _ in sums.values()], pa.list_(pa.float64())),
            pa.array([c.ravel().tolist() for _, _, c in sums.values()], pa.list_(pa.float64()))], ["feature", "n", "s", "c"])

    parts = samples.where("split = 'train'").select("feature", *columns).mapInArrow(
        products, "feature string, n long, s array<double>, c array<double>")
    sums = parts.groupBy("feature").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(width)]).alias("s"),
        F.array(*[F.sum(F.col("c")[i]) for i in range(width * width)]).alias("c"))
    rows = []
    for r in sums.collect():  # one row per feature of the schema
        mean = np.array(r["s"]) / r["n"]
        second = np.array(r["c"]).reshape(width, width) / r["n"]
        at = {c: i for i, c in enumerate(columns)}

        def covariance(a: str, b: str) -> float:
            return second[at[a], at[b]] - mean[at[a]] * mean[at[b]]

        xx = np.array([[covariance(a, b) for b in INPUTS] for a in INPUTS])
        xx += learner.penalty * np.diag(np.maximum(np.diag(xx), 1e-12))
        for step, target in enumerate(targets, start=1):
            coef = np.linalg.lstsq(xx, np.array([covariance(a, target) for a in INPUTS]), rcond=None)[0]
            rows.append((r["feature"], step, float(mean[at[target]] - coef @ mean[:LOOKBACK]), coef.tolist()))
    return samples.sparkSession.createDataFrame(
        rows, "feature string, step int, intercept double, coefficients array<double>")


def predict_ridge_steps(samples: DataFrame, table: DataFrame, *, split: str = "test") -> DataFrame:
    """One output row per sample and step, from one scan of the samples."""
    # At most features x horizon rows.
    found = table.groupBy("feature").agg(F.collect_list(F.struct("step", "intercept", "coefficients")).alias("_steps"))
    joined = samples.where(F.col("split") == split).join(F.broadcast(found), "feature")
    each = joined.withColumn("_m", F.explode("_steps")).drop("_steps")
    scaled = F.col("_m.intercept") + reduce(add, [F.col("_m.coefficients")[i] * F.col(x) for i, x in enumerate(INPUTS)])
    target = F.coalesce(*[F.when(F.col("_m.step") == int(c[1:]), F.col(c)) for c in _targets(samples)])
    return each.withColumns({
        "step": F.col("_m.step"), "actual": F.col("center") + F.col("scale") * target,
        "forecast": F.col("center") + F.col("scale") * scaled}).drop("_m")


def _targets(samples: DataFrame) -> list[str]:
    return [c for c in samples.columns if c[0] == "y" and c[1:].isdigit()]


def ridge_steps(
    long: DataFrame, keys: list[str], model: str, horizon: int, learner: Ridge = Ridge(), *, group_rows: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Twelve points to the next ``horizon``: (test forecasts, coefficient table)."""
    samples = scaled_samples(long, keys, model, horizon=horizon, group_rows=group_rows, packed=True)
    table = fit_ridge_steps(samples, horizon, learner)
    out = predict_ridge_steps(samples, table)
    ids = [c for c in ("obs_time", "pos") if c in out.columns]
    return out.select(*keys, *ids, "step", "actual", "forecast"), table


# Depth and rate of the boosted trees that tuning compares.
TUNING_GRID = [(3, 0.1), (5, 0.1), (5, 0.3)]


def tuned_boosted(samples: DataFrame, grid: list[tuple[int, float]] | None = None) -> tuple[dict[str, PipelineModel], DataFrame]:
    """Fit every setting, keep the one of least error on the validation split, per feature.

    Returns the models and a table (feature, depth, rate, val_rmse, chosen).
    """
    grid, scores, fitted = grid or TUNING_GRID, [], {}
    for depth, rate in grid:
        learner = boosted().setMaxDepth(depth).setStepSize(rate)
        models = fit_features(samples, learner)["y1"]
        errors = predict_features(samples, models, split="val").groupBy("feature").agg(
            F.sqrt(F.avg((F.col("forecast") - _actual(samples)) ** 2)).alias("rmse"))
        for r in errors.collect():  # one row per feature
            scores.append((r["rmse"], depth, rate, r["feature"]))
            fitted[r["feature"], depth, rate] = models[r["feature"]]
    best = {}
    for rmse, depth, rate, feature in sorted(scores):
        best.setdefault(feature, (depth, rate))
    table = samples.sparkSession.createDataFrame(
        [(f, d, float(r), float(e), best[f] == (d, r)) for e, d, r, f in scores],
        "feature string, depth int, rate double, val_rmse double, chosen boolean")
    return {f: fitted[f, *setting] for f, setting in best.items()}, table


def _residual_samples(long, keys, linear_models, group_rows, packed=False) -> DataFrame:
    errors = materialize(one_step_errors(long, linear_models, keys, group_rows=group_rows), "residuals")
    return scaled_samples(errors, keys, "arima_ann", value="error", group_rows=group_rows, packed=packed)


def _hybrid_rows(samples: DataFrame, fitted: dict[str, PipelineModel], keys: list[str]) -> DataFrame:
    out = predict_features(samples, fitted).withColumnRenamed("forecast", "residual")
    ids = [c for c in ("obs_time", "pos") if c in out.columns]
    return out.select(
        *keys, *ids, F.col("value").alias("actual"), (F.col("linear") + F.col("residual")).alias("forecast"),
        "linear", "residual")


def hybrid(
    long: DataFrame, keys: list[str], linear_models: DataFrame, regressor, *, group_rows: int | None = None,
    failed: dict[str, str] | None = None, packed: bool = False
) -> tuple[DataFrame, dict[str, PipelineModel]]:
    """Linear one-step prediction plus a learner on its residuals; both parts are returned. ``packed`` as in ``scaled_samples``."""
    samples = _residual_samples(long, keys, linear_models, group_rows, packed)
    fitted = fit_features(samples, regressor, failed=failed)["y1"]
    return _hybrid_rows(samples, fitted, keys), fitted


def apply_hybrid(
    long: DataFrame, keys: list[str], linear_models: DataFrame, fitted: dict[str, PipelineModel], *, group_rows: int | None = None
) -> DataFrame:
    """The same from models fitted before."""
    return _hybrid_rows(_residual_samples(long, keys, linear_models, group_rows, packed=True), fitted, keys)


def importances(spark, fitted: dict[str, PipelineModel]) -> DataFrame:
    """Importance of each lag per feature, for tree models."""
    rows = [
        (feature, lag, float(weight))
        for feature, model in fitted.items()
        for lag, weight in enumerate(model.stages[-1].featureImportances.toArray(), start=1)]
    return spark.createDataFrame(rows, "feature string, lag int, importance double")


# ---- ensembles as tables ----------------------------------------------------------------------------

MAX_BROADCAST_NODES = 200_000


def saved_tree_table(spark, features: list[str], path: str) -> DataFrame:
    """Node rows of the tree ensembles that ``save_models`` wrote, one per (feature, tree, node).

    ``input`` is the lag that a node splits on, left if its scaled value is at most
    ``threshold``; leaves have null there and in ``left`` and ``right``. A
    prediction is the sum over trees of ``weight`` times the leaf's ``value``.
    ``rows`` counts the training rows at the node.
    """
    parts = []
    for feature in features:
        stage = PipelineModel.load(f"{path}/{feature}").stages[-1]
        folder = _stage_folder(spark, f"{path}/{feature}")
        weights = spark.read.parquet(f"{folder}/treesMetadata").select(F.col("_1").alias("tree"), F.col("_3").alias("_w"))
        share = 1.0 if isinstance(stage, GBTRegressionModel) else 1.0 / stage.getNumTrees
        node, leaf = F.col("nodeData"), F.col("nodeData.leftChild") < 0
        nodes = spark.read.parquet(f"{folder}/data").select(F.col("treeID").alias("tree"), "nodeData")
        parts.append(nodes.join(weights, "tree").select(
            F.lit(feature).alias("feature"), "tree", (F.col("_w") * share).alias("weight"), node["id"].alias("node"),
            F.when(~leaf, node["split"]["featureIndex"] + 1).alias("input"),
            F.when(~leaf, node["split"]["leftCategoriesOrThreshold"][0]).alias("threshold"),
            F.when(~leaf, node["leftChild"]).alias("left"), F.when(~leaf, node["rightChild"]).alias("right"),
            node["prediction"].alias("value"), node["rawCount"].alias("rows")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def _stage_folder(spark, path: str) -> str:
    """Folder of a saved pipeline's last stage."""
    jvm = spark.sparkContext._jvm
    stages = jvm.org.apache.hadoop.fs.Path(f"{path}/stages")
    found = stages.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(stages)
    return max((str(f.getPath()) for f in found), key=lambda p: int(p.rsplit("/", 1)[1].split("_")[0]))


def tree_table(samples: DataFrame, fitted: dict[str, PipelineModel]) -> DataFrame:
    """The same for fitted ensembles, through the shared folder."""
    path = scratch_path(samples.sparkSession, "trees")
    save_models(fitted, path)
    return saved_tree_table(samples.sparkSession, list(fitted), path)


def predict_trees(samples: DataFrame, table: DataFrame, *, split: str = "test") -> DataFrame:
    """Unscaled predictions from node rows alone: every sample walks every tree of its feature.

    The walk is a fold over the levels, inside one projection. ``table`` has at most
    trees x 2^(depth + 1) rows a feature; it is broadcast up to a size, joined beyond.
    """
    node = F.struct("node", "input", "threshold", "left", "right", "value")
    trees = table.groupBy("feature", "tree", "weight").agg(F.array_sort(F.collect_list(node)).alias("nodes"))
    # Nodes come in preorder: an index is a node's number, and no path is longer than the splits.
    levels = table.where("input IS NOT NULL").groupBy("feature", "tree").count().agg(F.max("count")).first()[0] or 0
    depth = min(levels, MAX_TREE_DEPTH)
    ensembles = trees.groupBy("feature").agg(F.collect_list(F.struct("tree", "weight", "nodes")).alias("_trees"))
    small = table.count() <= MAX_BROADCAST_NODES
    rows = samples.where(F.col("split") == split).join(F.broadcast(ensembles) if small else ensembles, "feature")
    rows = rows.withColumn("_x", F.array(*INPUTS))

    def walk(nodes):
        def step(at, _):
            here = F.get(nodes, at)
            down = F.when(F.get(F.col("_x"), here["input"] - 1) <= here["threshold"], here["left"]).otherwise(here["right"])
            return F.when(here["input"].isNull(), at).otherwise(down)

        return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step) if depth else F.lit(0)

    total = F.aggregate(
        F.transform(F.array_sort("_trees"), lambda t: t["weight"] * F.get(t["nodes"], walk(t["nodes"]))["value"]),
        F.lit(0.0), lambda acc, v: acc + v)
    return rows.withColumn("forecast", F.col("center") + F.col("scale") * total).drop("_trees", "_x")


def save_models(fitted: dict[str, PipelineModel], path: str) -> None:
    for feature, model in fitted.items():
        model.write().overwrite().save(f"{path}/{feature}")


def load_models(features: list[str], path: str) -> dict[str, PipelineModel]:
    return {f: PipelineModel.load(f"{path}/{f}") for f in features}
