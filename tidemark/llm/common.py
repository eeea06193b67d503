"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD_BREAKS = " \t\n\x0b\f\r"
# Bytes A-Z to a-z, all others as they are: safe on UTF-8.
ASCII_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; the built-in ``lower`` says the same for pure ASCII and is faster."""
    pure = F.octet_length(text) == F.char_length(text)
    return F.when(pure, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def words(text: Column) -> Column:
    """Array of runs of characters other than ASCII white space; empty for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WORD_BREAKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \t-\r]+"))


def partitions_for(spark: SparkSession, rows: int, per_task: int) -> int:
    """Shuffle width from a row count: never narrower than the session's setting."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Texts cut at each blank: (where each text's parts begin, number of each part, the distinct parts)."""
    parts = pc.split_pattern(texts, " ")
    found = parts.values.dictionary_encode()
    return parts.offsets.to_numpy(), found.indices.to_numpy(zero_copy_only=False), found.dictionary.to_pylist()


def in_slices(texts: pa.Array, characters: int) -> Iterator[pa.Array]:
    """Consecutive texts of about so many bytes together, at least one at a time."""
    size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) if len(texts) else np.zeros(0)
    first = 0
    while first < len(texts):
        reached = (size[first - 1] if first else 0) + characters
        last = max(first + 1, int(np.searchsorted(size, reached, side="right")))
        yield texts.slice(first, last - first)
        first = last


class Recent(dict):
    """A bounded cache in two generations: at ``limit`` entries the younger one becomes the older.

    What is used stays; what nobody has asked for since the last turn goes. What
    neither holds is made by ``make``, and not kept if its key is longer than ``longest``.
    """

    def __init__(self, make: Callable, limit: int, longest: int = 256):
        super().__init__()
        self.make, self.limit, self.longest, self.before = make, limit, longest, {}

    def __missing__(self, key):
        if len(key) > self.longest:
            return self.make(key)
        if len(self) >= self.limit:
            self.turn()
        value = self.before.pop(key, None)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def turn(self) -> None:
        self.before = dict(self)
        self.clear()
