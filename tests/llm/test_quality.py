import re
from collections import Counter

import numpy as np
import pytest

from tests.llm import data
from tidemark.llm import quality


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    seen, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered.update(range(i, i + 5))
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_counts_equal_brute_force(spark):
    repeated = "a b c d e f " * 7 + "tail a b c d e"
    df = data.documents(spark, [repeated, "| * & <x> #1 %", "p\nq\np\n \n \nq"])
    got = quality.quality_rules(df, min_rows=5)
    texts = sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    want = sorted(((i, *counts(t)) for i, t in texts), key=str)
    rows = got.collect()
    assert sorted(((r["doc_id"], *r[1:6]) for r in rows), key=str) == want
    for r in rows:
        failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        assert r["base_failed"] == failed and (not failed or not r["kept"])


def test_empty_table(spark):
    assert quality.quality_rules(data.empty(spark)).count() == 0


@pytest.fixture(scope="module")
def planted(spark):
    """Ordinary texts of two groups, one of them large, and a few shouted or symbol-ridden ones."""
    rnd = np.random.default_rng(5)
    words = ["".join(rnd.choice(list("abcdefghij"), rnd.integers(2, 8))) for _ in range(400)]
    rows = []
    for i in range(900):
        text = " ".join(rnd.choice(words, rnd.integers(40, 200)))
        if i % 30 == 7:
            text = text.upper()
        if i % 30 == 11:
            text = " ".join(w + "***" for w in text.split())
        rows.append((i, text, "en" if i < 600 else "de", "s0"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_outliers_go_and_others_stay(planted):
    rows = quality.quality_rules(planted).collect()
    for r in rows:
        assert r["kept"] == (r["doc_id"] % 30 not in (7, 11)), r


def test_distance_is_mahalanobis(planted):
    """The factored form equals the quadratic form with the inverse covariance."""
    stats = quality.word_statistics(planted).withColumns(quality.transformed())
    fit = quality.fit_groups(stats.withColumnRenamed("doc_id", "doc_no")).where("group = 'a'").first()
    lower = np.eye(quality.P)
    for i in range(quality.P):
        for j in range(i):
            lower[i, j] = fit[f"l{i}_{j}"]
    cov = lower @ np.diag([fit[f"d{i}"] for i in range(quality.P)]) @ lower.T
    mean = np.array([fit[f"m{i}"] for i in range(quality.P)])
    from pyspark.sql import functions as F

    placed = stats.withColumns({c: F.lit(float(fit[c])) for c in quality.FIT})
    for r in quality.with_distance(placed).limit(40).collect():
        x = np.array([r[c] for c in quality.NAMES]) - mean
        assert r["d2"] == pytest.approx(x @ np.linalg.solve(cov, x), rel=1e-9)


def styled(rnd, i, kind):
    """Ordinary prose, symbol-ridden prose, or shouting with symbols."""
    words = ["".join(rnd.choice(list("abcdefghij"), rnd.integers(2, 8))) for _ in range(rnd.integers(60, 160))]
    if kind == "code":
        words = [w + "##" if k % 3 == 0 else w for k, w in enumerate(words)]
    if kind == "shout":
        words = [w.upper() for w in words]
    return " ".join(words)


@pytest.fixture(scope="module")
def sources(spark):
    """A large plain source and a small one full of symbols, with an outlier in each."""
    def make(n):
        rnd = np.random.default_rng(8)
        rows = [(i, styled(rnd, i, "shout" if i == 7 else "plain"), "en", "large") for i in range(600)]
        rows += [(1000 + i, styled(rnd, i, "shout" if i == 3 else "code"), "en", "small") for i in range(n)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")

    return make


def test_small_source_with_a_style_of_its_own(sources):
    rows = quality.quality_rules(sources(40)).collect()
    assert {r["doc_id"] for r in rows if not r["kept"]} == {7, 1003}


def test_no_count_flips_the_verdict(sources):
    """The distance moves little from 99 to 100 rows of a whole table."""
    def judged(n):
        return {r["doc_id"]: (r["distance"], r["kept"]) for r in quality.quality_rules(sources(n).where("source = 'small'")).collect()}

    fewer, more = judged(99), judged(100)
    assert not fewer[1003][1] and sum(kept for _, kept in fewer.values()) == 98
    for i, (distance, kept) in fewer.items():
        assert kept == more[i][1] and distance == pytest.approx(more[i][0], rel=0.25, abs=0.5)
