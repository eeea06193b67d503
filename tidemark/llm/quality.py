"""Quality rules: base rules on word statistics, then robust multivariate outliers."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm.common import WORD_BREAKS, words
from tidemark.scratch import materialize

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

# Transformed statistics, and the spread below which differences do not count.
FLOORS = {"log_words": 1.0, "log_word_length": 0.15, "symbols": 0.06, "dup_lines": 0.25, "repeats": 0.25, "capitals": 0.1}
NAMES = list(FLOORS)
P = len(NAMES)
COVERED = 0.75
# Fixed value: makes the covariance of the inner 75 % consistent for normal data in six dimensions.
CONSISTENCY = 1.36
CUTOFF = 20.0
HALF_WEIGHT_ROWS = 100  # rows at which a group's own estimate weighs as much as the one it is blended with
PRIOR_SPREAD = 3.0  # floors; spread of the estimate that the one over all rows is blended with
STEPS = 3
SALTS = 16
QUANTILE_BINS = 100  # per unit of a transformed statistic
DISTANCE_BINS = 16  # per unit of the logarithm of a squared distance


def word_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Replace the text by its counts: n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, and n_lines and n_capitals for the outlier rule.

    Words are runs of characters other than ASCII white space. Null text has none.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WORD_BREAKS)) != "")
    base = docs.withColumns({"_words": words(F.col(text_col)), "_lines": lines})
    counted = base.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.char_length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.char_length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_capitals": F.char_length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_hashes": F.when(F.size("_words") >= WINDOW, F.transform(
            F.sequence(F.lit(0), F.size("_words") - WINDOW),
            lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(WINDOW)])))})
    return _repeated_words(counted).drop(text_col, "_words", "_lines", "_hashes")


def _repeated_words(df: DataFrame) -> DataFrame:
    """Add n_repeat_words: sort a text's window hashes, only if two are equal, mark
    the equal neighbours, and add up what their windows cover.

    Every step is a column of its own, so that nothing is worked out once per element.
    """
    twice = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    placed = F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    ordered = df.withColumn("_sorted", F.when(twice, F.array_sort(placed)))
    marked = ordered.withColumn("_marked", F.transform("_sorted", lambda s, j: F.when(
        (s["h"] == F.get("_sorted", j - 1)["h"]) | (s["h"] == F.get("_sorted", j + 1)["h"]), s["i"])))
    starts = marked.withColumn("_starts", F.array_sort(F.filter("_marked", lambda i: i.isNotNull())))
    covered = F.transform("_starts", lambda p, k: F.least(
        F.lit(WINDOW), F.coalesce(F.get("_starts", k + 1) - p, F.lit(WINDOW))))
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda acc, x: acc + x)
    return starts.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("long"))).drop(
        "_sorted", "_marked", "_starts")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def transformed() -> dict[str, Column]:
    """The statistic vector: logarithms of sizes, arcsine roots of shares."""
    def share(part: str, whole: str) -> Column:
        ratio = F.col(part) / F.greatest(F.col(whole), F.lit(1))
        return F.asin(F.sqrt(F.least(ratio, F.lit(1.0))))

    return {
        "log_words": F.log1p(F.col("n_words").cast("double")),
        "log_word_length": F.log((F.col("word_chars") + 1.0) / (F.col("n_words") + 1.0)),
        "symbols": share("n_symbols", "word_chars"), "dup_lines": share("n_dup_lines", "n_lines"),
        "repeats": share("n_repeat_words", "n_words"), "capitals": share("n_capitals", "word_chars")}


def _keyed(value: Column) -> Column:
    """A null value is a group of its own, apart from every text."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("~"))


def _levels(lang: str, source: str) -> dict[str, Column]:
    own = _keyed(F.col(lang))
    return {"source": F.concat(F.lit("s"), own, F.lit("\x00"), _keyed(F.col(source))),
            "lang": F.concat(F.lit("l"), own), "all": F.lit("a")}


def _total(columns) -> Column:
    return reduce(add, columns)


def _estimate_rows(stats: DataFrame, lang: str, source: str) -> DataFrame:
    """A row per level of grouping: by language and source, by language, all."""
    keys = F.array(*_levels(lang, source).values())
    salt = F.pmod(F.xxhash64(*NAMES, lang, source, "doc_no"), F.lit(SALTS)).cast("int")
    return stats.select(F.explode(keys).alias("group"), salt.alias("salt"), *NAMES)


def _first_fits(rows: DataFrame) -> DataFrame:
    """Two diagonal starts per group: quartiles, and mean with variance.

    Quartiles come from counts per narrow bin, so equal rows cost nothing and the
    result does not depend on how the rows are dealt out.
    """
    measured = rows.select("group", F.posexplode(F.array(*NAMES)).alias("dim", "x"))
    binned = measured.groupBy("group", "dim", F.floor(F.col("x") * QUANTILE_BINS).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("ss"))
    series = W.partitionBy("group", "dim")
    upto = F.sum("n").over(series.orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
    ranked = binned.withColumns({"upto": upto, "total": F.sum("n").over(series)})
    centre = (F.col("bin") + 0.5) / QUANTILE_BINS

    def quantile(q: float) -> Column:
        return F.min(F.when(F.col("upto") >= q * F.col("total"), centre))

    per_dim = ranked.groupBy("group", "dim").agg(
        quantile(0.25).alias("q1"), quantile(0.5).alias("q2"), quantile(0.75).alias("q3"),
        (F.sum("s") / F.sum("n")).alias("mean"), (F.sum("ss") / F.sum("n")).alias("square"))
    floor = F.element_at(F.array(*[F.lit(v) for v in FLOORS.values()]), F.col("dim") + 1)
    robust = F.greatest((F.col("q3") - F.col("q1")) / 1.349, floor)
    spread = F.greatest(F.sqrt(F.greatest(F.col("square") - F.col("mean") * F.col("mean"), F.lit(0.0))), floor)
    starts = per_dim.select("group", "dim", F.explode(F.array(
        F.struct(F.lit(0).alias("start"), F.col("q2").alias("m"), (robust * robust).alias("v")),
        F.struct(F.lit(1).alias("start"), F.col("mean").alias("m"), (spread * spread).alias("v")))).alias("f"))
    found = starts.groupBy("group", "f.start").agg(
        *[F.max(F.when(F.col("dim") == i, F.col("f.m"))).alias(f"m{i}") for i in range(P)],
        *[F.max(F.when(F.col("dim") == i, F.col("f.v"))).alias(f"d{i}") for i in range(P)])
    return found.withColumns({f"l{i}_{j}": F.lit(0.0) for i in range(P) for j in range(i)})


FIT = [*(f"m{i}" for i in range(P)), *(f"d{i}" for i in range(P)), *(f"l{i}_{j}" for i in range(P) for j in range(i))]


def with_distance(rows: DataFrame) -> DataFrame:
    """Add the squared Mahalanobis distance ``d2`` under the fit on the row.

    The fit is a mean and the factors of its covariance (unit lower triangle,
    diagonal); the distance comes from forward substitution.
    """
    for i, name in enumerate(NAMES):
        known = [F.col(f"l{i}_{j}") * F.col(f"_y{j}") for j in range(i)]
        value = F.col(name) - F.col(f"m{i}")
        rows = rows.withColumn(f"_y{i}", value - _total(known) if known else value)
    d2 = _total(F.col(f"_y{i}") * F.col(f"_y{i}") / F.col(f"d{i}") for i in range(P))
    return rows.withColumn("d2", d2).drop(*[f"_y{i}" for i in range(P)])


def _salted(fits: DataFrame) -> DataFrame:
    return fits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _concentrate(rows: DataFrame, fits: DataFrame) -> DataFrame:
    """One C-step: the mean and covariance of the ``COVERED`` nearest rows of each group.

    Moments are summed per narrow bin of the distance, so one pass gives both the
    bin that completes the share and the moments within it. A bin is kept whole.
    """
    near = with_distance(rows.join(_salted(fits), ["group", "salt"]))
    step = F.floor(F.log(F.col("d2") + 1e-9) * DISTANCE_BINS).alias("bin")
    sums = [F.sum(c).alias(f"s_{c}") for c in NAMES]
    cross = [F.sum(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"c{i}_{j}") for i in range(P) for j in range(i + 1)]
    binned = near.groupBy("group", "start", step).agg(F.count(F.lit(1)).alias("n"), *sums, *cross)
    series = W.partitionBy("group", "start")
    before = F.coalesce(F.sum("n").over(series.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = binned.withColumns({"before": before, "total": F.sum("n").over(series)}).where(
        F.col("before") < COVERED * F.col("total"))
    moments = inside.groupBy("group", "start").agg(
        F.sum("n").alias("n"), F.max("total").alias("total"), *[F.sum(f"s_{c}").alias(f"s_{c}") for c in NAMES],
        *[F.sum(f"c{i}_{j}").alias(f"c{i}_{j}") for i in range(P) for j in range(i + 1)])
    means = moments.withColumns({f"m{i}": F.col(f"s_{c}") / F.col("n") for i, c in enumerate(NAMES)})
    floors = list(FLOORS.values())
    covariance = means.withColumns({
        f"a{i}_{j}": CONSISTENCY * (F.col(f"c{i}_{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}"))
        + (floors[i] ** 2 if i == j else 0.0) for i in range(P) for j in range(i + 1)})
    return _factor(covariance).select("group", "start", "total", *FIT)


def _factor(df: DataFrame) -> DataFrame:
    """Factor the covariance a into unit lower triangle l and diagonal d."""
    for k in range(P):
        own = [F.col(f"l{k}_{j}") * F.col(f"l{k}_{j}") * F.col(f"d{j}") for j in range(k)]
        pivot = F.col(f"a{k}_{k}") - _total(own) if own else F.col(f"a{k}_{k}")
        df = df.withColumn(f"d{k}", F.greatest(pivot, F.lit(1e-6)))
        below = {}
        for i in range(k + 1, P):
            known = [F.col(f"l{i}_{j}") * F.col(f"l{k}_{j}") * F.col(f"d{j}") for j in range(k)]
            rest = F.col(f"a{i}_{k}") - _total(known) if known else F.col(f"a{i}_{k}")
            below[f"l{i}_{k}"] = rest / F.col(f"d{k}")
        df = df.withColumns(below) if below else df
    return df


def fit_groups(stats: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Minimum-covariance-determinant fit per (language, source), language, and over all.

    Deterministic: both starts go through ``STEPS`` concentration steps, and the
    one whose covariance has the smaller determinant stays.
    """
    rows = _estimate_rows(stats, lang, source)
    fits = materialize(_first_fits(rows), "first-fits")
    for _ in range(STEPS):
        fits = materialize(_concentrate(rows, fits), "fits")
    size = _total(F.log(f"d{i}") for i in range(P))
    best = fits.groupBy("group").agg(F.min_by(F.struct("total", *FIT), F.struct(size, F.col("start"))).alias("f"))
    return best.select("group", "f.*")


def _unfactored(fits: DataFrame) -> DataFrame:
    """Write the covariance a of each fit from its factors l and d."""
    def lower(i: int, j: int) -> Column:
        return F.lit(1.0) if i == j else F.col(f"l{i}_{j}")

    return fits.withColumns({
        f"a{i}_{j}": _total(lower(i, k) * lower(j, k) * F.col(f"d{k}") for k in range(j + 1))
        for i in range(P) for j in range(i + 1)})


MOMENTS = [*(f"m{i}" for i in range(P)), *(f"a{i}_{j}" for i in range(P) for j in range(i + 1))]


def _blended(fits: DataFrame, parent: str, half_rows: float) -> DataFrame:
    """Mix each fit with the one in the struct ``parent`` by weights n / (n + half_rows) and the rest.

    The covariance is that of the mixture: the distance between both means
    counts too, so a style of its own widens a small group's estimate
    instead of rejecting the group.
    """
    own = F.col("total") / (F.col("total") + F.lit(float(half_rows)))
    rest = F.lit(float(half_rows)) / (F.col("total") + F.lit(float(half_rows)))
    apart = [F.col(f"m{i}") - F.col(f"{parent}.m{i}") for i in range(P)]
    mixed = {f"m{i}": F.col(f"{parent}.m{i}") + own * apart[i] for i in range(P)}
    mixed |= {
        f"a{i}_{j}": own * F.col(f"a{i}_{j}") + rest * F.col(f"{parent}.a{i}_{j}") + own * rest * apart[i] * apart[j]
        for i in range(P) for j in range(i + 1)}
    return fits.withColumns(mixed)


def _chosen(stats: DataFrame, fits: DataFrame, lang: str, source: str, half_rows: float) -> DataFrame:
    """The fit of each (language, source) that occurs.

    A group's own fit is blended with its language's, that with the fit over all
    rows, and that with a diagonal of wide spreads, each by its number of rows.
    A group without a row in ``fits`` has the coarser fit alone.
    """
    levels = _levels(lang, source)
    names = list(levels)
    found = stats.select(*[c.alias(f"_{name}") for name, c in levels.items()]).distinct()
    moments = materialize(_unfactored(fits).select("group", "total", *MOMENTS), "moments")
    prior = [F.col(f"m{i}") for i in range(P)] + [
        F.lit((PRIOR_SPREAD * floor) ** 2 if i == j else 0.0) for i, floor in enumerate(FLOORS.values()) for j in range(i + 1)]
    top = moments.where("group = 'a'").withColumn("_p", F.struct(*[c.alias(n) for c, n in zip(prior, MOMENTS)]))
    parent = _blended(top, "_p", half_rows).select(F.col("group").alias("_all"), F.struct(*MOMENTS).alias("_p"))
    for name, above in (("lang", "all"), ("source", "lang")):
        keys = [f"_{n}" for n in names[names.index(name):]]
        here = found.select(*keys).distinct().join(parent, f"_{above}").join(
            moments.withColumnRenamed("group", f"_{name}"), f"_{name}", "left")
        none = {c: F.coalesce(F.col(c), F.col(f"_p.{c}")) for c in MOMENTS} | {"total": F.coalesce("total", F.lit(0))}
        mixed = _blended(here.withColumns(none), "_p", half_rows)
        parent = materialize(mixed.select(f"_{name}", F.struct(*MOMENTS).alias("_p")), "blended")
    return _factor(parent.select(F.col("_source").alias("group"), "_p.*")).select("group", *FIT)


def quality_rules(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang: str = "lang", source: str = "source",
    cutoff: float = CUTOFF, min_rows: float = HALF_WEIGHT_ROWS
) -> DataFrame:
    """One row per document: id, the counts, ``base_failed``, ``distance``, ``kept``.

    A document that passes the base rules is kept unless its squared robust
    distance from its (language, source) exceeds ``cutoff``. Estimates use the
    documents that pass the base rules. Every group is judged by its own
    estimate, blended with its language's, that of all and a wide one; an
    estimate of ``min_rows`` documents weighs as much as what it is blended
    with, and no count switches between them. Distance is null, and nothing
    kept, only where no document passes the base rules. Null
    language and source are groups of their own; null and empty texts have no
    word and fail. Repeated rows each count. Extra columns are ignored.
    """
    here = docs.select(
        F.col(id_col).alias("doc_no"), F.col(text_col).alias("_text"), F.col(lang).alias("lang"), F.col(source).alias("source"))
    counted = word_statistics(here, "_text").withColumn("base_failed", base_failed())
    stats = materialize(counted.withColumns(transformed()), "statistics")
    fits = materialize(fit_groups(stats.where(~F.col("base_failed"))), "group-fits")
    chosen = materialize(_chosen(stats, fits, "lang", "source", min_rows), "chosen-fits")
    salt = F.pmod(F.xxhash64("doc_no", *NAMES), F.lit(SALTS)).cast("int")
    keyed = stats.withColumns({"group": _levels("lang", "source")["source"], "salt": salt})
    judged = with_distance(keyed.join(_salted(chosen), ["group", "salt"], "left"))
    kept = ~F.col("base_failed") & F.coalesce(F.col("d2") <= cutoff, F.lit(True))
    return judged.select(
        F.col("doc_no").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", kept.alias("kept"), F.col("d2").alias("distance"))
