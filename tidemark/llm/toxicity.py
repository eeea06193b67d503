"""Toxicity: a small convolutional text classifier trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.langid import remainder
from tidemark.scratch import materialize

BUCKETS = 1 << 15
DIMENSIONS = 16
WIDTHS = (1, 2, 3)
FEATURES = 4
FILTERS = 16
EPOCHS = 8
BATCH = 32
RATE = 0.004
DECAY = 1e-4
DROPOUT = 0.3
SEED = 11
MIN_BUCKET_DOCS = 4
MAX_TRAINING_ROWS = 6000
MAX_TEXT_WORDS = 20_000
MAX_TRAINING_WORDS = 8_000_000
SEGMENT = 100_000
THRESHOLD = 0.7  # scores are calibrated so that this is every language's threshold
CELLS = 10_000  # of probability, in which labelled rows are counted
HALF_WEIGHT_TOXIC = 15  # toxic texts at which a language's own threshold weighs as much as that of all

# Lower-case letters, digits and bytes above ASCII stay; all else ends a word.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))


class Vocabulary:
    """Feature buckets of words: the word itself and its first four, five and six bytes,
    which inflected words share. Words seen are kept up to a bound."""

    def __init__(self, limit: int = 200_000):
        self.limit, self.numbers, self.rows = limit, {}, np.zeros((1024, FEATURES), np.int32)

    def _add(self, word: bytes) -> int:
        at = len(self.numbers) + 1  # number 0 is padding, all its buckets 0
        if at >= len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        parts = (word, *(b"<" * n + word[:n + 3] for n in range(1, FEATURES)))
        self.rows[at] = [1 + xxhash.xxh3_64_intdigest(p) % (BUCKETS - 1) for p in parts]
        self.numbers[word] = at
        return at

    def features(self, words: list[bytes], padding: int) -> np.ndarray:
        if len(self.numbers) > self.limit:
            self.__init__(self.limit)
        get, add = self.numbers.get, self._add
        numbers = [get(w) or add(w) for w in words]
        return self.rows[np.array(numbers + [0] * padding, np.int64)]


@lru_cache(maxsize=1)
def _vocabulary() -> Vocabulary:
    return Vocabulary()


def buckets(text: str | None) -> np.ndarray:
    """Feature buckets of a whole text's words, padded so that every width has a window."""
    found = (text or "").lower().encode("utf-8", "replace").translate(WORD_BYTES).split()
    return _vocabulary().features(found, max(WIDTHS[-1] - 1, WIDTHS[-1] - len(found)))


@dataclass
class Network:
    """Embeddings, filters per width (width x dimensions x filters), output layer."""

    embedding: np.ndarray
    filters: dict[int, np.ndarray]
    bias: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: float
    languages: tuple[str, ...] = ()
    word_odds: np.ndarray | None = None  # bucket x language
    thresholds: np.ndarray = field(default_factory=lambda: np.array([0.5]))
    fitted: tuple[int, ...] = ()  # ids of the rows that training saw

    def responses(self, words: np.ndarray) -> dict[int, np.ndarray]:
        """Response of every filter in every window, per width."""
        kernel = np.concatenate([self.filters[w][j] for w in WIDTHS for j in range(w)], axis=1)
        each = self.embedding[words].sum(1) @ kernel
        out, column = {}, 0
        for w in WIDTHS:
            n = len(words) - w + 1
            total = self.bias[w]
            for j in range(w):
                total = total + each[j:n + j, column:column + FILTERS]
                column += FILTERS
            out[w] = total
        return out

    def pooled(self, words: np.ndarray) -> np.ndarray:
        """Largest response of every filter over all windows, segment by segment."""
        best = np.zeros(FILTERS * len(WIDTHS), np.float32)
        for i in range(0, max(1, len(words) - WIDTHS[-1] + 1), SEGMENT):
            found = self.responses(words[i:i + SEGMENT + WIDTHS[-1] - 1])
            np.maximum(best, np.concatenate([found[w].max(0) for w in WIDTHS]), out=best)
        return best

    def probability(self, words: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-(self.pooled(words) @ self.out + self.out_bias))))

    def language(self, words: np.ndarray) -> int:
        """Which threshold to use, from the words alone."""
        if self.word_odds is None or len(self.languages) < 2:
            return 0
        return int(np.argmax(self.word_odds[words[:, 0]].sum(0)))

    def score(self, text: str | None) -> float:
        words = buckets(text)
        p, t = self.probability(words), float(self.thresholds[self.language(words)])
        return THRESHOLD * p / t if p < t else THRESHOLD + (1 - THRESHOLD) * (p - t) / max(1 - t, 1e-9)


def _initial(rng: np.random.Generator) -> Network:
    scale = 1 / np.sqrt(DIMENSIONS)
    return Network(
        rng.normal(0, 0.3, (BUCKETS, DIMENSIONS)).astype(np.float32),
        {w: rng.normal(0, scale / np.sqrt(w), (w, DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS},
        {w: np.zeros(FILTERS, np.float32) for w in WIDTHS},
        rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32), 0.0)


class Adam:
    def __init__(self):
        self.moments: dict = {}

    def step(self, name, values: np.ndarray, gradient: np.ndarray, rows=slice(None)) -> None:
        """Update ``values[rows]`` in place; rows without a gradient stay as they are."""
        m, v, t = self.moments.setdefault(name, [np.zeros_like(values), np.zeros_like(values), 0])
        self.moments[name][2] = t = t + 1
        m[rows] = 0.9 * m[rows] + 0.1 * gradient
        v[rows] = 0.999 * v[rows] + 0.001 * gradient * gradient
        values[rows] -= RATE * (m[rows] / (1 - 0.9 ** t)) / (np.sqrt(v[rows] / (1 - 0.999 ** t)) + 1e-8)


def train(texts: list[np.ndarray], labels: np.ndarray, *, seed: int = SEED, epochs: int = EPOCHS) -> Network:
    """Minimise the class-balanced logistic loss. Buckets in few texts are held at zero:
    a word that hardly recurs can say nothing about other texts."""
    rng, adam = np.random.default_rng(seed), Adam()
    net = _initial(rng)
    seen = np.zeros(BUCKETS, np.int64)
    for words in texts:
        seen[np.unique(words)] += 1
    rare = seen < MIN_BUCKET_DOCS
    rare[0] = True
    net.embedding[rare] = 0
    weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-6), 0.5 / max(1 - labels.mean(), 1e-6))
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            _update(net, adam, [texts[i] for i in order[at:at + BATCH]], labels[order[at:at + BATCH]],
                    weight[order[at:at + BATCH]], rng, rare)
    return net


def _update(net, adam, texts, labels, weight, rng, rare) -> None:
    words = np.concatenate(texts)
    starts = np.cumsum([0, *map(len, texts)])
    vectors = net.embedding[words].sum(1)
    responses = net.responses(words)
    pooled, peaks = [], {}
    for w in WIDTHS:
        response = responses[w]
        peaks[w] = np.stack([response[a:b - w + 1].argmax(0) + a for a, b in zip(starts[:-1], starts[1:])])
        pooled.append(response[peaks[w], np.arange(FILTERS)])
    raw = np.concatenate(pooled, 1)
    keep = (rng.random(raw.shape) >= DROPOUT) / (1 - DROPOUT)
    active = np.maximum(raw, 0) * keep
    p = 1 / (1 + np.exp(-(active @ net.out + net.out_bias)))
    delta = ((p - labels) * weight / len(texts)).astype(np.float32)
    back = (delta[:, None] * net.out * keep * (raw > 0)).astype(np.float32)
    adam.step("out", net.out, active.T.astype(np.float32) @ delta + DECAY * net.out)
    bias = np.array([net.out_bias], np.float32)
    adam.step("out_bias", bias, np.array([delta.sum()], np.float32))
    net.out_bias = float(bias[0])
    touched, gradients = [], []
    for n, w in enumerate(WIDTHS):
        own = back[:, n * FILTERS:(n + 1) * FILTERS]
        filters, change = net.filters[w], np.empty_like(net.filters[w])
        for j in range(w):
            at = peaks[w] + j
            change[j] = np.einsum("bfd,bf->df", vectors[at], own)
            touched.append(words[at].reshape(-1))
            gradients.append(np.repeat((own[:, :, None] * filters[j].T[None]).reshape(-1, DIMENSIONS), FEATURES, axis=0))
        adam.step(("filter", w), filters, change + DECAY * filters)
        adam.step(("bias", w), net.bias[w], own.sum(0))
    where, slot = np.unique(np.concatenate(touched), return_inverse=True)
    total = np.zeros((len(where), DIMENSIONS), np.float32)
    np.add.at(total, slot, np.concatenate(gradients))
    free = ~rare[where]
    adam.step("embedding", net.embedding, total[free] + DECAY * net.embedding[where[free]], where[free])


def learn_languages(net: Network, texts: list[np.ndarray], langs: list[str | None]) -> None:
    """Word frequencies per language, to pick a text's threshold from its words."""
    names = tuple(sorted({x for x in langs if x}))
    counts = np.ones((BUCKETS, len(names)))
    for words, lang in zip(texts, langs):
        if lang:
            np.add.at(counts[:, names.index(lang)], words[:, 0], 1)
    counts[0] = 1
    net.languages, net.word_odds = names, np.log(counts / counts.sum(0)).astype(np.float32)


def best_threshold(scores: np.ndarray, labels: np.ndarray) -> float:
    """Threshold of the best F1, half way to the next lower score."""
    order = np.argsort(-scores, kind="stable")
    hits = np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + max(1, labels.sum()))
    f1[:-1][np.diff(scores[order]) == 0] = -1  # equal scores cannot be told apart
    at = int(np.argmax(f1))
    lower = scores[order[at + 1]] if at + 1 < len(order) else 0.0
    return float(np.clip((scores[order[at]] + lower) / 2, 0.02, 0.98))


def calibrate(net: Network, texts: list[np.ndarray], labels: np.ndarray, half_weight: float = HALF_WEIGHT_TOXIC) -> None:
    """A threshold per language from texts that training did not see.

    A language of n toxic texts has its own threshold with weight n / (n + half_weight)
    and that of all with the rest. Without texts of both classes that of all is 0.5.
    """
    scores = np.array([net.probability(w) for w in texts])
    owner = np.array([net.language(w) for w in texts], int)
    overall = best_threshold(scores, labels) if 0 < labels.sum() < len(labels) else 0.5
    net.thresholds = np.full(max(1, len(net.languages)), overall)
    for k in range(len(net.languages)):
        n = int(labels[owner == k].sum())
        if n:
            net.thresholds[k] += n / (n + half_weight) * (best_threshold(scores[owner == k], labels[owner == k]) - overall)


def best_threshold_of_counts(low: np.ndarray, high: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> float:
    """``best_threshold`` of ``toxic`` and ``clean`` rows in cells of scores from ``low`` to ``high``; no cell is cut."""
    order = np.argsort(-low)
    hits, taken = np.cumsum(toxic[order]), np.cumsum((toxic + clean)[order])
    at = int(np.argmax(2 * hits / (taken + max(1, toxic.sum()))))
    lower = high[order[at + 1]] if at + 1 < len(order) else 0.0
    return float(np.clip((low[order[at]] + lower) / 2, 0.02, 0.98))


def calibrate_all(
    net: Network, found: DataFrame, labels: DataFrame, half_weight: float = HALF_WEIGHT_TOXIC, cells: int = CELLS
) -> None:
    """``calibrate`` on every labelled row that training did not see, from counts per language and cell of probability.

    ``found`` is the result of ``probabilities``. A row that repeats an id counts once. The driver
    receives a row per language and cell that is met.
    """
    spark = found.sparkSession
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)").distinct()
    seen = spark.createDataFrame([(int(i),) for i in net.fitted], "doc_id long")  # bounded by the rows of training
    rows = found.join(F.broadcast(seen), "doc_id", "left_anti").join(known, "doc_id").groupBy("doc_id", "toxic").agg(
        F.min(F.struct("p", "language")).alias("d"))
    counts = rows.groupBy(F.col("d.language").alias("language"), F.floor(F.col("d.p") * cells).alias("cell")).agg(
        F.min("d.p").alias("low"), F.max("d.p").alias("high"),
        F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("toxic") == 0).alias("clean")).collect()
    owner, cell, low, high, toxic, clean = (
        np.array([r[c] for r in counts]) for c in ("language", "cell", "low", "high", "toxic", "clean"))

    def best(own: np.ndarray) -> float:
        met, slot = np.unique(cell[own], return_inverse=True)
        least, most = np.ones(len(met)), np.zeros(len(met))
        np.minimum.at(least, slot, low[own])
        np.maximum.at(most, slot, high[own])
        return best_threshold_of_counts(least, most, np.bincount(slot, toxic[own]), np.bincount(slot, clean[own]))

    if not counts or not toxic.sum() or not clean.sum():
        return  # the thresholds of the drawn rows stay
    overall = best(owner >= 0)
    net.thresholds = np.full(max(1, len(net.languages)), overall)
    for k in range(len(net.languages)):
        n = int(toxic[owner == k].sum())
        if n:
            net.thresholds[k] += n / (n + half_weight) * (best(owner == k) - overall)


def held_apart(ids: list, toxic: np.ndarray) -> np.ndarray:
    """A fifth of each class, by a hash of the id, for the thresholds; of two or more rows at least one, and not all."""
    order = np.array([xxhash.xxh3_64_intdigest(str(i), SEED) for i in ids], np.uint64)
    apart = order % np.uint64(5) == 0
    for label in (0, 1):
        own = np.flatnonzero(toxic == label)
        own = own[np.argsort(order[own], kind="stable")]
        if len(own) > 1:
            apart[own[0]], apart[own[-1]] = True, False
        else:
            apart[own] = False
    return apart


def learn(
    docs: DataFrame, labels: DataFrame, *, max_rows: int = MAX_TRAINING_ROWS, max_text_words: int = MAX_TEXT_WORDS,
    max_words: int = MAX_TRAINING_WORDS
) -> Network | None:
    """Fit on at most ``max_rows`` labelled documents, half of them toxic if there are enough.

    Rows are drawn by a hash of their id, of each class until their words reach half of
    ``max_words``; documents of more than ``max_text_words`` words are not trained on.
    The driver receives eight bytes a word, 64 MB by these bounds. None if a class is missing.
    """
    order = F.xxhash64("doc_id", F.lit(SEED))
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL").distinct()
    drawn = None
    for label in (0, 1):
        part = known.where(F.col("toxic") == label).orderBy(order).limit(max_rows // 2)
        drawn = part if drawn is None else drawn.unionByName(part)
    matched = docs.select("doc_id", "text", "lang").join(F.broadcast(drawn), "doc_id")  # max_rows labels at most
    # Documents may repeat an id: one row of each label, so max_rows rows at most.
    texts = matched.groupBy("doc_id", "toxic").agg(F.min(F.struct("text", "lang")).alias("d")).select("doc_id", "d.*", "toxic")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [buckets(t.as_py()) for t in batch["text"]]
            size = pa.array([len(w) for w in words], pa.int64())
            made = pa.record_batch([
                batch["doc_id"], batch["lang"], batch["toxic"], size,
                pa.array([w.astype(np.uint16).tobytes() for w in words], pa.binary())], ["doc_id", "lang", "toxic", "n", "words"])
            yield made.filter(pc.less_equal(size, max_text_words))

    found = materialize(texts.mapInArrow(hashed, "doc_id long, lang string, toxic int, n long, words binary"), "training-texts")
    so_far = F.sum("n").over(W.partitionBy("toxic").orderBy(order, "doc_id").rowsBetween(W.unboundedPreceding, 0))
    within = found.select("doc_id", "toxic", so_far.alias("so_far")).where(F.col("so_far") <= max_words // 2)  # max_rows rows at most
    rows = found.join(within, ["doc_id", "toxic"]).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["toxic"], r["lang"] or "", bytes(r["words"])))
    words = [np.frombuffer(bytes(r["words"]), np.uint16).astype(np.int32).reshape(-1, FEATURES) for r in rows]
    toxic = np.array([r["toxic"] for r in rows], np.int64)
    if len(set(toxic.tolist())) < 2:
        return None
    apart = held_apart([r["doc_id"] for r in rows], toxic)
    fit, test = np.flatnonzero(~apart), np.flatnonzero(apart)
    net = train([words[i] for i in fit], toxic[fit])
    learn_languages(net, [words[i] for i in fit], [rows[i]["lang"] for i in fit])
    calibrate(net, [words[i] for i in test], toxic[test])
    if net is not None:
        net.fitted = tuple(sorted({rows[i]["doc_id"] for i in fit}))
    return net


def score(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, score, predicted for every row, from the whole text alone.

    Null and empty texts have a score like any other. Without a network
    (a class was missing in training) every score is 0.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.array([0.0 if net is None else net.score(t.as_py()) for t in batch["_text"]], np.float64)
            yield pa.record_batch(
                [batch["doc_id"], pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))],
                ["doc_id", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int")


def probabilities(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, p and language (a number) for every row, from the whole text alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [buckets(t.as_py()) for t in batch["_text"]]
            yield pa.record_batch([
                batch["doc_id"], pa.array([net.probability(w) for w in words], pa.float64()),
                pa.array([net.language(w) for w in words], pa.int32())], ["doc_id", "p", "language"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_text"))
    return rows.mapInArrow(run, "doc_id long, p double, language int")


def scored(found: DataFrame, thresholds: np.ndarray) -> DataFrame:
    """doc_id, score, predicted from ``probabilities``; a score is ``THRESHOLD`` where p is its language's threshold."""
    p, t = F.col("p"), F.get(F.array(*[F.lit(float(t)) for t in thresholds]), F.col("language"))
    above = THRESHOLD + (1 - THRESHOLD) * (p - t) / F.greatest(1 - t, F.lit(1e-9))
    each = found.withColumn("score", F.when(p < t, THRESHOLD * p / t).otherwise(above))
    return each.select("doc_id", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, *, folds: int = 3, held_out: int = 1, **options) -> DataFrame:
    """doc_id, held_out, score, predicted; learned from labels of the other folds.

    The network is fit on rows that ``learn`` draws; the thresholds come from all other
    labelled rows of its folds. Every text is read once for its probability, which is written,
    so that thresholds and scores start there. A row with a null doc_id is not learned from and not held out.
    """
    own = labels.where(remainder("doc_id", folds) != held_out)
    net = learn(docs, own, **options)
    fold = F.coalesce(remainder("doc_id", folds) == held_out, F.lit(False))
    if net is None:
        out = score(docs, net)
    else:
        found = materialize(probabilities(docs, net), "probabilities")
        calibrate_all(net, found, own)
        out = scored(found, net.thresholds)
    return out.select("doc_id", fold.alias("held_out"), "score", "predicted")
