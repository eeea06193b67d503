import zlib

import numpy as np
import pytest

from tests.llm import data
from tidemark.llm import langid, toxicity

LETTERS = {"en": "etaoinshr", "de": "enisrüäöß", "fr": "eéèsaitnç"}


@pytest.fixture(scope="module")
def labelled(spark):
    rnd = np.random.default_rng(9)
    rows = []
    for i in range(600):
        lang = ["en", "de", "fr"][i % 3]
        words = ["".join(rnd.choice(list(LETTERS[lang]), rnd.integers(2, 7))) for _ in range(rnd.integers(5, 60))]
        toxic = int(i % 5 == 0)
        if toxic:
            words.insert(int(rnd.integers(0, len(words))), ["vilestuff", "rotterly", "mudheads"][i % 3])
        rows.append((i, " ".join(words), lang, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")


def crc(i):
    return zlib.crc32(str(i).encode())


def test_language(spark, labelled):
    out = labelled.join(langid.identify(labelled).drop("text"), "doc_id").collect()
    assert all(r["held_out"] == (crc(r["doc_id"]) % 4 == 2) for r in out)
    held = [r for r in out if r["held_out"]]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in out)


def test_language_edges(spark):
    df = data.documents(spark)
    out = langid.identify(df).collect()
    assert len(out) == df.count()
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    for r in out:
        letters = any(c.isalpha() for c in texts[r["doc_id"]] or "") if r["doc_id"] is not None else True
        assert (r["lang_pred"] == "und") <= (not letters or r["doc_id"] is None) and (letters or r["lang_pred"] == "und")
    unlabelled = df.withColumn("lang", df.lang.substr(1, 0)).where("doc_id < 0")
    assert langid.identify(unlabelled).count() == 0
    none = df.selectExpr("doc_id", "text", "cast(null as string) lang")
    assert {r["lang_pred"] for r in langid.identify(none).collect()} == {"und"}


def test_bundle_is_the_sum_of_bound_vectors():
    text = "Abc abé.  12 zz"
    own, _ = langid._letters(64)
    symbols = langid._symbols()[[ord(c) for c in " abc abé zz "]]
    total = sum(np.roll(own[a], 2) * np.roll(own[b], 1) * own[c] for a, b, c in zip(symbols, symbols[1:], symbols[2:]))
    assert np.allclose(langid.bundle(text, 64), total / np.linalg.norm(total), atol=1e-6)
    assert langid.bundle("12 ..", 64) is None


def test_toxicity(spark, labelled):
    labels = labelled.select("doc_id", "toxic")
    out = labelled.join(toxicity.classify(labelled.drop("toxic"), labels), "doc_id").collect()
    held = [r for r in out if r["held_out"]]
    assert all(r["held_out"] == (crc(r["doc_id"]) % 3 == 1) for r in out)
    assert np.mean([r["predicted"] for r in held if r["toxic"]]) > 0.9
    assert np.mean([r["predicted"] for r in held if not r["toxic"]]) < 0.03
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in out)


def test_toxicity_edges(spark, labelled):
    df = data.documents(spark)
    labels = labelled.selectExpr("doc_id", "toxic").unionByName(spark.createDataFrame([(None, 1), (3, None)], "doc_id long, toxic int"))
    out = toxicity.classify(df, labels)
    assert out.count() == df.count()
    assert toxicity.classify(data.empty(spark), labels).count() == 0
    no_labels = toxicity.classify(df, labels.where("toxic = 7")).collect()
    assert {(r["score"], r["predicted"]) for r in no_labels} == {(0.0, 0)}


def test_segments_do_not_change_the_pooled_response(monkeypatch):
    rnd = np.random.default_rng(3)
    net = toxicity._initial(rnd)
    words = toxicity.buckets(" ".join(f"w{rnd.integers(500)}" for _ in range(700)))
    whole = net.pooled(words)
    monkeypatch.setattr(toxicity, "SEGMENT", 13)
    assert np.allclose(whole, net.pooled(words), atol=1e-5)
    assert len(toxicity.buckets(None)) == len(toxicity.buckets("")) == 3


def test_gradient_step_lowers_the_loss():
    rnd = np.random.default_rng(6)
    texts = [toxicity.buckets(" ".join(["good", "fine"] * 3 + (["bad"] if i % 2 else []))) for i in range(64)]
    labels = np.array([i % 2 for i in range(64)])
    net = toxicity.train(texts, labels, epochs=30)
    p = np.array([net.probability(t) for t in texts])
    assert p[labels == 1].min() > 0.8 and p[labels == 0].max() < 0.2
    assert toxicity.best_threshold(p, labels) == pytest.approx((p[labels == 1].min() + p[labels == 0].max()) / 2)
    assert rnd is not None


def test_repeated_ids_are_learned_from_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, toxic: seen.append(len(texts)))
    monkeypatch.setattr(toxicity, "learn_languages", lambda *a: seen.append(len(a[1])))
    monkeypatch.setattr(toxicity, "calibrate", lambda net, texts, toxic: seen.append(len(texts)))
    rows = [(i, f"text {i}", "en", i % 2) for i in range(20)]
    docs = spark.createDataFrame(rows + [rows[3]] * 200, "doc_id long, text string, lang string, toxic int")
    toxicity.learn(docs, docs.select("doc_id", "toxic"))
    assert seen[0] == seen[1] and seen[0] + seen[2] in (20, 40)


class Fixed:
    """A network whose probabilities and languages are given."""

    def __init__(self, scores, owner):
        self.scores, self.owner, self.languages, self.thresholds = scores, owner, ("a", "b"), None

    def probability(self, i):
        return float(self.scores[i])

    def language(self, i):
        return int(self.owner[i])


def test_thresholds_move_with_the_number_of_toxic_texts():
    """No count switches: one more toxic text of a language moves its threshold a little."""
    found = []
    for n in (13, 14, 15, 16):
        owner = np.r_[np.zeros(400, int), np.ones(n + 40, int)]
        labels = np.r_[np.arange(400) % 2, np.ones(n, int), np.zeros(40, int)]
        scores = np.where(labels == 1, np.where(owner == 1, 0.6, 0.9), np.where(owner == 1, 0.1, 0.5))
        net = Fixed(scores, owner)
        toxicity.calibrate(net, list(range(len(labels))), labels)
        own, overall = 0.35, toxicity.best_threshold(scores, labels)
        assert net.thresholds[1] == pytest.approx(overall + n / (n + 15) * (own - overall))
        found.append(net.thresholds[1])
    assert max(np.abs(np.diff(found))) < 0.02


def test_texts_apart_hold_both_classes():
    for toxic in ([1, 0, 0], [1, 1, 0, 0, 0], [0] * 40 + [1] * 3, [1, 0]):
        toxic = np.array(toxic)
        apart = toxicity.held_apart(list(range(len(toxic))), toxic)
        for label in (0, 1):
            own = apart[toxic == label]
            assert not own.all() and own.any() == (len(own) > 1)


def test_driver_receives_no_more_than_its_bounds(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(toxicity, "train", lambda texts, labels: taken.extend(texts) or toxicity._initial(np.random.default_rng(0)))
    docs = spark.createDataFrame([(i, f"w{i} " * (5 + 30 * (i % 7)), "en") for i in range(60)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    toxicity.learn(docs, labels, max_words=1500, max_text_words=100)
    assert taken and sum(map(len, taken)) <= 1500 + 4 * len(taken) and max(map(len, taken)) <= 104


def test_thresholds_come_from_all_labelled_rows(spark):
    """Rows beyond the drawn ones move the thresholds, those that training saw do not; counts equal the direct search."""
    rnd = np.random.default_rng(4)
    rows = [(i, round(float(rnd.random()), 3), i % 2, int(rnd.random() < (0.3 if i % 2 else 0.6))) for i in range(800)]
    found = spark.createDataFrame([r[:3] for r in rows] + [rows[7][:3]] * 50, "doc_id long, p double, language int")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    net = Fixed([], [])
    net.fitted = tuple(range(0, 800, 5))
    toxicity.calibrate_all(net, found, labels)
    rest = [r for r in rows if r[0] % 5]
    direct = Fixed([r[1] for r in rest], [r[2] for r in rest])
    toxicity.calibrate(direct, list(range(len(rest))), np.array([r[3] for r in rest]))
    assert np.allclose(net.thresholds, direct.thresholds, atol=1e-12)


def test_no_row_count_limits_the_thresholds(spark, labelled, monkeypatch):
    taken = []
    counts = toxicity.best_threshold_of_counts
    monkeypatch.setattr(
        toxicity, "best_threshold_of_counts", lambda *a: taken.append(a[2].sum() + a[3].sum()) or counts(*a))
    out = toxicity.classify(labelled.drop("toxic"), labelled.select("doc_id", "toxic"), max_rows=100)
    assert out.count() == 600
    learned = sum(crc(i) % 3 != 1 for i in range(600))
    assert learned - 100 <= max(taken) < learned
