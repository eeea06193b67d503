"""Allow or block urls: rules first, else gradient-boosted trees on lexical features."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower
from tidemark.scratch import materialize

MAX_TRAINING_ROWS = 20_000
FOLDS = 5  # a training url does not see the statistics of its own fold
TREES, DEPTH, SEED = 20, 4, 7
FEATURES = ["length", "host_length", "labels", "depth", "digit_ratio", "entropy", "params", "hyphens",
            "suffix_rate", "suffix_rows", "domain_rate", "domain_rows"]


@dataclass(frozen=True)
class Rule:
    """A verdict for a host, its subdomains, and paths that start with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def longest_rule(rules: list[Rule]) -> Column:
    """(rule, verdict) of the longest rule that fits host and path, else null.

    Rules are a short literal list; the first that fits, longest first, wins.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        own = (F.col("host") == r.host) | F.endswith(F.col("host"), F.lit("." + r.host))
        fits = own & F.startswith(F.col("path"), F.lit(r.path))
        found = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def lexical_features(urls: DataFrame) -> DataFrame:
    """Add the features that a url has by itself; a null url counts as empty."""
    url = F.coalesce(F.col("url"), F.lit(""))
    size = F.char_length(url).cast("double")
    per_char = F.transform(
        F.array_distinct(F.split(url, "")),
        lambda c: (size - F.char_length(F.replace(url, c, F.lit("")))) / size)
    entropy = F.aggregate(per_char, F.lit(0.0), lambda acc, p: acc - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    labels = F.split("host", r"\.")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    return urls.withColumns({
        "length": size, "host_length": F.char_length("host").cast("double"),
        "labels": F.size(labels).cast("double"),
        "depth": (F.char_length("path") - F.char_length(F.replace("path", F.lit("/")))).cast("double"),
        "digit_ratio": F.when(size > 0, F.char_length(F.regexp_replace(url, "[^0-9]+", "")) / size).otherwise(0.0),
        "entropy": F.when(size > 0, entropy).otherwise(0.0),
        "params": F.when(query == "", 0.0).otherwise(F.size(F.split(query, "[&;]")).cast("double")),
        "hyphens": (F.char_length(url) - F.char_length(F.replace(url, F.lit("-")))).cast("double"),
        "suffix": F.element_at(labels, -1),
        "domain": F.array_join(F.slice(labels, -F.least(F.size(labels), F.lit(2)), 2), ".")})


def _fold() -> Column:
    return F.pmod(F.xxhash64("url", F.lit(SEED + 1)), F.lit(FOLDS)).cast("int")


def _statistics(labelled: DataFrame, key: str) -> DataFrame:
    """Rows and blocked rows per key over all labelled rows, in whole and per fold of urls."""
    fold = _fold()
    folds = [F.count_if(fold == i) for i in range(FOLDS)]
    blocked = [F.coalesce(F.sum(F.when(fold == i, F.col("label"))), F.lit(0.0)) for i in range(FOLDS)]
    found = labelled.groupBy(key).agg(
        F.count(F.lit(1)).alias(f"{key}_n"), F.sum("label").alias(f"{key}_blocked"),
        F.array(*folds).alias(f"{key}_fold_n"), F.array(*blocked).alias(f"{key}_fold_blocked"))
    return materialize(found, f"{key}-statistics")


@dataclass
class UrlModel:
    statistics: dict[str, DataFrame]
    trees: GBTClassificationModel | None
    default: str

    def _vectors(self, urls: DataFrame, training: bool = False) -> DataFrame:
        """Add the feature vector, with smoothed shares of blocked rows.

        ``training`` leaves out the rows of the url's own fold.
        """
        for key, found in self.statistics.items():
            # As many rows as there are keys: no hint, so Spark goes by the size written.
            urls = urls.join(found, key, "left")
            n, blocked = F.col(f"{key}_n"), F.col(f"{key}_blocked")
            if training:
                n = n - F.get(f"{key}_fold_n", _fold())
                blocked = blocked - F.get(f"{key}_fold_blocked", _fold())
            n, blocked = F.coalesce(n, F.lit(0)), F.coalesce(blocked, F.lit(0.0))
            urls = urls.withColumns({f"{key}_rate": (blocked + 1) / (n + 2), f"{key}_rows": F.log1p(n.cast("double"))})
            urls = urls.drop(*[f"{key}_{c}" for c in ("n", "blocked", "fold_n", "fold_blocked")])
        return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(urls)

    def score(self, urls: DataFrame) -> DataFrame:
        """Add ``score``, the probability of a block."""
        if self.trees is None:
            return urls.withColumn("score", F.lit(1.0 if self.default == "block" else 0.0))
        scored = self.trees.transform(self._vectors(urls))
        return scored.withColumn("score", vector_to_array("probability")[1])


def _drawn(labelled: DataFrame, max_rows: int) -> DataFrame:
    """At most ``max_rows`` distinct (url, label), those of the smallest url hashes of each class.

    ``weight`` is the url's number of rows, scaled so that each class keeps its share of all rows.
    """
    distinct = materialize(labelled.groupBy("url", "label").agg(
        F.count(F.lit(1)).alias("n"), F.first("host").alias("host"), F.first("path").alias("path")), "labelled-urls")
    classes = {r["label"]: r for r in distinct.groupBy("label").agg(
        F.count(F.lit(1)).alias("urls"), F.sum("n").alias("rows")).collect()}
    half, drawn = max_rows // 2, None
    for label, r in sorted(classes.items()):
        others = sum(o["urls"] for k, o in classes.items() if k != label)
        quota = max(half, max_rows - others)  # what the other class leaves
        part = distinct.where(F.col("label") == label).orderBy(F.xxhash64("url", F.lit(SEED)), "url").limit(quota)
        part = part.withColumn("_rows", F.lit(float(r["rows"])))
        drawn = part if drawn is None else drawn.unionByName(part)
    if drawn is None:
        return distinct.withColumn("weight", F.lit(1.0))
    drawn = materialize(drawn, "drawn-urls")
    held = {r["label"]: float(r["n"]) for r in drawn.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    share = F.create_map(*[F.lit(x) for k, n in held.items() for x in (k, n)])[F.col("label")]
    return drawn.withColumn("weight", F.col("n") * F.col("_rows") / share).drop("_rows")


def train(labelled: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> UrlModel:
    """Fit on at most ``max_rows`` distinct labelled urls, half of each class if there are enough.

    ``labelled`` has url, host, path and label (1: block). Urls weigh as many
    rows as they have; suffix and domain statistics are of all rows. With one
    class only, or no row, the model gives that class (allow when empty) to every url.
    """
    labelled = labelled.select("url", "host", "path", F.col("label").cast("double").alias("label"))
    drawn = _drawn(labelled, max_rows)
    seen = {r["label"] for r in drawn.select("label").distinct().collect()}
    if len(seen) < 2:
        return UrlModel({}, None, "block" if seen == {1.0} else "allow")
    every = lexical_features(labelled)
    model = UrlModel({k: _statistics(every, k) for k in ("suffix", "domain")}, None, "allow")
    vectors = model._vectors(lexical_features(drawn), training=True).select("features", "label", "weight")
    vectors = materialize(vectors.coalesce(8), "url-vectors")
    model.trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=SEED, weightCol="weight").fit(vectors)
    return model


def judge(pages: DataFrame, rules: list[Rule], *, max_rows: int = MAX_TRAINING_ROWS, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, score for every row.

    The longest fitting rule decides; the trees, trained from the urls that a
    rule has labelled, decide the others. Null urls and urls without ``://``
    have empty host and path and go to the trees. Repeated rows stay.
    """
    parts = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = parts.withColumn("_found", longest_rule(rules))
    labelled = ruled.where("_found IS NOT NULL").withColumn(
        "label", (F.col("_found.verdict") == "block").cast("int"))
    scored = train(labelled, max_rows).score(lexical_features(ruled))
    by_trees = F.when(F.col("score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(
        "page_id", "host", "path", F.col("_found.rule").alias("rule"),
        F.coalesce("_found.verdict", by_trees).alias("verdict"), "score")
