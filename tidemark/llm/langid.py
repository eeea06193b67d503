"""Language identification by hyperdimensional letter n-gram profiles."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMENSIONS = 512
ALPHABET = 64  # 0: anything that is no letter; 1-26: a-z; the rest share other letters by code point
SEED = 20
MAX_TRAINING_ROWS = 4000  # per language
UNKNOWN = "und"
UNIT = 1 << 24  # sums of whole numbers do not depend on their order
# Trigrams at which the chance part of a text's centred vector is as long as its language's.
# Fixed value: from first-n-words cuts of 3 to 3,000 words at 512 dimensions.
NOISE_TRIGRAMS = 290
# Share of the gap expected of a text wholly in another language: for long texts, and how much less for short ones.
SURE_SHARE, SHORT_ALLOWANCE = 0.75, 0.25


@lru_cache(maxsize=1)
def _symbols() -> np.ndarray:
    """Symbol of every code point, letters lower-cased."""
    table = np.zeros(0x110000, np.int32)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = ord(c.lower()[0])
            table[cp] = low - 96 if 97 <= low <= 122 else 27 + low % (ALPHABET - 27)
    return table


@lru_cache(maxsize=2)
def _letters(dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Random sign vectors of the letters, and of all letter pairs bound in order.

    A trigram abc is bound as p(p(a)) * p(b) * c, p being a rotation by one.
    """
    own = np.random.default_rng(SEED).choice(np.array([-1, 1], np.float32), (ALPHABET, dimensions))
    pairs = np.roll(own, 2, axis=1)[:, None] * np.roll(own, 1, axis=1)[None]
    return own, pairs.reshape(-1, dimensions)


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of a text with counts; runs of other characters count as one space.

    The text is put between spaces. Without a letter there is none.
    """
    symbols = _symbols()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    symbols = np.concatenate(([0], symbols, [0]))
    keep = np.ones(len(symbols), bool)
    keep[1:] = (symbols[1:] != 0) | (symbols[:-1] != 0)
    symbols = symbols[keep]
    if len(symbols) < 3:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    return np.unique((symbols[:-2] * ALPHABET + symbols[1:-1]) * ALPHABET + symbols[2:], return_counts=True)


def bundle(text: str, dimensions: int = DIMENSIONS) -> np.ndarray | None:
    """Unit vector of a whole text: the sum of its bound trigrams. None without a letter."""
    return _bundled(*trigrams(text), dimensions)


def _bundled(grams: np.ndarray, counts: np.ndarray, dimensions: int) -> np.ndarray | None:
    own, pairs = _letters(dimensions)
    if not len(grams):
        return None
    total = np.zeros(dimensions, np.float32)
    for i in range(0, len(grams), 4096):
        g = grams[i:i + 4096]
        total += counts[i:i + 4096].astype(np.float32) @ (pairs[g // ALPHABET] * own[g % ALPHABET])
    return total / max(float(np.linalg.norm(total)), 1e-9)


@dataclass(frozen=True)
class Profiles:
    """Language prototypes: unit vectors, less what all languages have in common."""

    languages: tuple[str, ...]
    vectors: np.ndarray  # languages x dimensions, unit length
    common: np.ndarray

    def _cosines(self, text: str | None) -> tuple[np.ndarray | None, int]:
        """Cosine with each prototype (None without a letter or a language), number of trigrams."""
        if not text or not self.languages:
            return None, 0
        grams, counts = trigrams(text)
        vector = _bundled(grams, counts, len(self.common))
        if vector is None:
            return None, 0
        vector = vector - self.common
        return self.vectors @ vector / max(float(np.linalg.norm(vector)), 1e-9), int(counts.sum())

    def _named(self, cosines: np.ndarray | None) -> tuple[str, float]:
        if cosines is None:
            return UNKNOWN, 0.0
        best = int(np.argmax(cosines))
        return self.languages[best], min(1.0, max(0.0, float(cosines[best])))

    def classify(self, text: str | None) -> tuple[str, float]:
        """(language, score): the cosine with the nearest prototype, from 0 to 1."""
        return self._named(self._cosines(text)[0])

    def judge(self, text: str | None, declared: str | None) -> tuple[str, float, bool]:
        """(language, score, contradicted): whether the text is surely not in the learned language ``declared``.

        A text wholly in another language is expected to be nearer to that one
        by 1 less the prototypes' cosine, shrunk by the chance part of so few
        trigrams. A text in both is near both. The decision is on the share of
        the expected gap that is there; a null or unlearned ``declared`` is
        never contradicted.
        """
        cosines, n = self._cosines(text)
        name, score = self._named(cosines)
        if cosines is None or declared not in self.languages or declared == name:
            return name, score, False
        best, own = self.languages.index(name), self.languages.index(declared)
        chance = NOISE_TRIGRAMS / (n + NOISE_TRIGRAMS)
        expected = (1 - float(self.vectors[best] @ self.vectors[own])) * np.sqrt(1 - chance)
        least = (SURE_SHARE - SHORT_ALLOWANCE * np.sqrt(chance)) * expected
        return name, score, bool(cosines[best] - cosines[own] >= least)


def learn(labelled: DataFrame, *, max_rows: int = MAX_TRAINING_ROWS, dimensions: int = DIMENSIONS) -> Profiles:
    """Bundle the texts of each language of ``labelled`` (text, lang, doc_id) into its prototype.

    Uses about ``max_rows`` rows a language, drawn by a hash of id and language; languages
    are expected to be as few as languages are. Rows with a null stay out. Tasks
    return one partial sum per language, in whole numbers.
    """
    rows = labelled.select("doc_id", "text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Profiles((), np.zeros((0, dimensions)), np.zeros(dimensions))
    spread = 1_000_000
    quota = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(spread, spread * max_rows // n + 1))])
    drawn = rows.where(F.pmod(F.xxhash64("doc_id", "lang", F.lit(SEED)), F.lit(spread)) < quota[F.col("lang")])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"].to_pylist()):
                vector = bundle(text.as_py(), dimensions)
                if vector is not None:
                    total = sums.setdefault(lang, np.zeros(dimensions, np.int64))
                    total += np.rint(vector * UNIT).astype(np.int64)
        yield pa.record_batch([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))],
                              ["lang", "sums"])

    parts = drawn.select("text", "lang").mapInArrow(partial, "lang string, sums array<long>")
    summed = parts.select("lang", F.posexplode("sums").alias("i", "v")).groupBy("lang", "i").agg(F.sum("v").alias("v"))
    vectors = {k: np.zeros(dimensions) for k in counts}
    for r in summed.collect():  # languages x dimensions
        vectors[r["lang"]][r["i"]] = r["v"] / UNIT
    names = sorted(k for k, v in vectors.items() if v.any())
    stacked = np.array([vectors[k] / np.linalg.norm(vectors[k]) for k in names]).reshape(len(names), dimensions)
    common = stacked.mean(0) if len(names) > 1 else np.zeros(dimensions)
    centred = stacked - common
    centred /= np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-9)
    return Profiles(tuple(names), centred.astype(np.float32), common.astype(np.float32))


def predict(docs: DataFrame, profiles: Profiles, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score for every row, from the whole text alone.

    Null texts and texts without a letter are ``und`` with score 0, as is every
    text when no language was learned. Repeated rows and null ids pass through.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profiles.classify(t.as_py()) for t in batch["_text"]]
            yield pa.record_batch([
                batch["_id"], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                [id_col, "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"{id_col} {kind}, lang_pred string, score double")


def annotate(docs: DataFrame, profiles: Profiles, *, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """All columns of ``docs`` with ``_lang_pred``, ``_lang_score`` and ``_lang_contradicted``, row by row, without a join.

    The last says whether the text is surely in another language than the row declares.
    A column of one of these names is replaced.
    """
    added = {"_lang_pred": T.StringType(), "_lang_score": T.DoubleType(), "_lang_contradicted": T.BooleanType()}
    rows = docs.drop(*added)
    kinds = [pa.string(), pa.float64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profiles.judge(t.as_py(), d.as_py()) for t, d in zip(batch[text_col], batch[lang_col])]
            made = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)]
            yield pa.record_batch([*batch.columns, *made], [*batch.schema.names, *added])

    schema = T.StructType([*rows.schema.fields, *[T.StructField(k, v) for k, v in added.items()]])
    return rows.mapInArrow(run, schema)


def remainder(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(parts))


def identify(docs: DataFrame, *, folds: int = 4, held_out: int = 2, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from rows of the other folds.

    A row with a null doc_id belongs to no fold: it is neither learned from nor held out.
    """
    profiles = learn(docs.where(remainder("doc_id", folds) != held_out), **options)
    fold = F.coalesce(remainder("doc_id", folds) == held_out, F.lit(False))
    return predict(docs, profiles).select("doc_id", fold.alias("held_out"), "lang_pred", "score")
