"""Periodic runs of words: tiles per octave of periods, boundary Z-functions, stitched fragments."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.scratch import materialize, width

MIN_LENGTH = 12
BOUNDARIES = 16  # of a tile
LONG_WORDS = 8192
CHUNK_WORDS = 1_000_000
MAX_KNOWN = 300_000
SCAN = ("kind int, row long, id {id}, n long, plain string, text binary, "
        "octave int, at long, bounds binary, words binary, period long, s long, e long")
DOCUMENT, FRAGMENT, TILE = range(3)

BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
UNBASE = pow(BASE, -1, 1 << 64)


def block_of(octave: int) -> int:
    """Distance of the boundaries for periods from 2^octave to 2^(octave+1).

    A run repeats at least max(period, 12 - period) words at its period; so many
    hold two block starts less one, hence a whole block that begins at a boundary.
    """
    return 4 if octave < 2 else 1 << (octave - 1)


def z_function(x: list) -> list[int]:
    """Length of the longest common prefix of ``x`` and each of its suffixes."""
    n = len(x)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and x[k] == x[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def tile_fragments(x: list, octave: int, bounds: list[int]) -> list[tuple[int, int, int]]:
    """(period, s, e): stretches with x[i] == x[i + period] around the given boundaries of a tile.

    From a boundary a stretch is followed two blocks onwards and one back; where it
    goes on, the next boundary goes on with it.
    """
    block, low, high = block_of(octave), 1 << octave, 2 << octave
    out = []
    for m in bounds:
        ahead = z_function(x[m:m + high + 2 * block])
        periods = [q for q in range(low, min(high, len(ahead))) if ahead[q] >= block]
        if not periods:
            continue
        before = x[max(0, m - block):m][::-1]
        top = min(len(x), m + high - 1)
        # None is no word, so no match runs over it.
        behind = z_function([*before, None, *x[max(0, m - block):top][::-1]])
        for q in periods:
            out.append((q, m - behind[len(before) + 1 + top - m - q], m + ahead[q]))
    return out


def merged(fragments: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Fragments of one document, those of a period that touch each other as one."""
    out: list[tuple[int, int, int]] = []
    for q, s, e in sorted(set(fragments)):
        if out and out[-1][0] == q and s <= out[-1][2]:
            out[-1] = (q, out[-1][1], max(e, out[-1][2]))
        else:
            out.append((q, s, e))
    return out


class Blocks:
    """Which boundaries of concatenated documents have their block again within an octave's periods.

    Only a filter: blocks are compared by polynomial hashes, so none that recurs is missed.
    """

    def __init__(self, words: np.ndarray):
        powers = np.ones(len(words) + 1, np.uint64)
        powers[1:] = np.uint64(BASE)
        self.down = np.ones(len(words) + 1, np.uint64)
        self.down[1:] = np.uint64(UNBASE)
        np.multiply.accumulate(powers, out=powers)
        np.multiply.accumulate(self.down, out=self.down)
        value = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        value ^= value >> np.uint64(29)
        self.sums = np.r_[np.uint64(0), np.cumsum(value * powers[:-1], dtype=np.uint64)]

    def recurring(self, octave: int, size: int) -> np.ndarray:
        """Boundaries, as places among the first ``size`` words."""
        block, low, high = block_of(octave), 1 << octave, 2 << octave
        hashes = (self.sums[block:size + 1] - self.sums[:size + 1 - block]) * self.down[:size + 1 - block]
        if octave < 2:
            found = np.zeros(-(-len(hashes) // block), bool)
            for q in range(low, high):
                here = hashes[q::block] == hashes[:len(hashes) - q:block]
                found[:len(here)] |= here
        else:
            rows = -(-len(hashes) // block)
            table = np.zeros(rows * block, np.uint64)
            table[:len(hashes)] = hashes
            table = table.reshape(rows, block)
            found = np.zeros(rows, bool)
            for c in range(low // block, high // block):
                found[:rows - c] |= (table[c:] == table[:rows - c, :1]).any(1)
        return np.flatnonzero(found) * block


def explode(words: list[np.ndarray]) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """Tiles of documents: (document, octave, place of the tile, its boundaries within it, its words).

    Words are numbers. A tile holds up to sixteen boundaries with a block before the
    first and, after the last, an octave's greatest period and two blocks. Tiles in
    which no boundary's block comes again at a distance of the octave hold no run of it.
    """
    order = sorted(range(len(words)), key=lambda i: -len(words[i]))
    order = [i for i in order if len(words[i]) >= MIN_LENGTH]
    if not order:
        return
    size = np.array([len(words[i]) for i in order])
    start = np.r_[0, np.cumsum(size + 1)[:-1]]
    # A number of its own ends each document: nothing matches across it.
    top = 1 + max(int(words[i].max()) for i in order)
    joined = np.concatenate([np.append(words[i].astype(np.int64), top + j) for j, i in enumerate(order)])
    blocks = Blocks(joined)
    octave = 0
    while 2 << octave <= size[0]:
        long_enough = int(np.searchsorted(-size, -(2 << octave), side="right"))
        block, high = block_of(octave), 2 << octave
        at = blocks.recurring(octave, int(start[long_enough - 1] + size[long_enough - 1] + 1))
        owner = np.searchsorted(start, at, side="right") - 1
        tile = (at - start[owner]) // (BOUNDARIES * block)
        edges = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (tile[1:] != tile[:-1]), True]) if len(at) else np.zeros(1, int)
        for a, b in zip(edges[:-1], edges[1:]):
            own = words[order[owner[a]]]
            place = at[a:b] - start[owner[a]]
            first = max(0, int(place[0]) - block)
            yield order[owner[a]], octave, first, place - first, own[first:int(place[-1]) + high + 2 * block]
        octave += 1


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _scanned(docs: DataFrame, long_words: int) -> DataFrame:
    """Documents, fragments of the short ones, and tiles of the long ones."""
    schema = SCAN.format(id=docs.schema["id"].dataType.simpleString())
    kinds = {"octave": pa.int32(), "at": pa.int64(), "bounds": pa.binary(), "words": pa.binary(),
             "period": pa.int64(), "s": pa.int64(), "e": pa.int64()}

    def batch_of(kind: int, count: int, ids: pa.DataType, **columns) -> pa.RecordBatch:
        columns["kind"] = [kind] * count
        full = {"kind": pa.int32(), "row": pa.int64(), "id": ids, "n": pa.int64(), "plain": pa.string(), "text": pa.binary()} | kinds
        arrays = [pa.nulls(count, k) if name not in columns else columns[name] if name == "id" else pa.array(columns[name], k) for name, k in full.items()]
        return pa.record_batch(arrays, list(full))

    def chunk(rows: list[int], ids: pa.Array, texts: list[list[bytes]], numbers: _Numbers) -> Iterator[pa.RecordBatch]:
        words = [np.fromiter(map(numbers.__getitem__, t), np.int32, len(t)) for t in texts]
        found: list[list] = [[] for _ in texts]
        tiles, dealt = [], set()
        for doc, octave, at, bounds, part in explode(words):
            if len(words[doc]) > long_words:
                tiles.append((rows[doc], octave, at, bounds.astype(np.int32).tobytes(), part.astype(np.int32).tobytes()))
                if len(tiles) == 256:
                    yield batch_of(TILE, 256, ids.type, **dict(zip(("row", "octave", "at", "bounds", "words"), zip(*tiles))))
                    tiles = []
                dealt.add(doc)
            else:
                found[doc] += [(q, s + at, e + at) for q, s, e in tile_fragments(part.tolist(), octave, bounds.tolist())]
        if tiles:
            yield batch_of(TILE, len(tiles), ids.type, **dict(zip(("row", "octave", "at", "bounds", "words"), zip(*tiles))))
        fragments = []
        plain, text = [], []
        for doc, own in enumerate(found):
            # A document solved whole has whole stretches: those too short for a run stay here.
            own = [f for f in merged(own) if f[2] - f[1] >= max(f[0], MIN_LENGTH - f[0])]
            joined = b" ".join(texts[doc])
            plain.append(hashlib.sha256(joined).hexdigest())
            text.append(joined if own or doc in dealt else None)
            fragments += [(rows[doc], *f) for f in own]
        yield batch_of(DOCUMENT, len(rows), ids.type, row=rows, id=ids, n=[len(t) for t in texts], plain=plain, text=text)
        if fragments:
            yield batch_of(FRAGMENT, len(fragments), ids.type, **dict(zip(("row", "period", "s", "e"), zip(*fragments))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _Numbers()
        for batch in batches:
            texts, first, size = [], 0, 0
            rows = batch["row"].to_pylist()
            for i, text in enumerate(batch["text"]):
                texts.append((text.as_py() or "").encode("utf-8", "replace").split())
                size += len(texts[-1])
                if size >= CHUNK_WORDS or i + 1 == len(rows):
                    yield from chunk(rows[first:i + 1], batch["id"][first:i + 1], texts, numbers)
                    texts, first, size = [], i + 1, 0
                    if len(numbers) > MAX_KNOWN:
                        numbers = _Numbers()

    return docs.mapInArrow(run, schema)


def _solved(tiles: DataFrame) -> DataFrame:
    """Fragments of dealt-out tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, octave, at, bounds, words in zip(*(batch[c].to_pylist() for c in ("row", "octave", "at", "bounds", "words"))):
                found = tile_fragments(np.frombuffer(words, np.int32).tolist(), octave, np.frombuffer(bounds, np.int32).tolist())
                out += [(row, q, s + at, e + at) for q, s, e in merged(found)]
            columns = list(zip(*out)) if out else [()] * 4
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["row", "period", "s", "e"])

    return tiles.mapInArrow(run, "row long, period long, s long, e long")


def _stitched(fragments: DataFrame) -> DataFrame:
    """(row, runs): fragments of a document and period joined into runs, in order of start and period."""
    order = Window.partitionBy("row", "period").orderBy("s")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("s") <= F.col("reach"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    whole = fragments.withColumn("reach", reach).withColumn("island", island).groupBy("row", "period", "island").agg(
        F.min("s").alias("start"), F.max("e").alias("e"))
    repeats = F.col("e") - F.col("start")
    long_enough = whole.where(repeats >= F.greatest(F.col("period"), MIN_LENGTH - F.col("period")))
    # A multiple of a run's period gives the same stretch: the smallest period names it.
    runs = long_enough.groupBy("row", "start", (repeats + F.col("period")).alias("length")).agg(F.min("period").alias("period"))
    return runs.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))


def collapsed_digest(text: bytes, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> str:
    """SHA-256 of the words that no run holds after its first period, joined by one space."""
    words = text.split(b" ")
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
    return hashlib.sha256(b" ".join([words[i] for i in kept.tolist()])).hexdigest()


def _collapsed(found: DataFrame) -> DataFrame:
    columns = [c for c in found.columns if c != "text"]
    schema = ", ".join(f"{c} {found.schema[c].dataType.simpleString()}" for c in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, digests = batch["runs"], batch["plain"].to_pylist()
            for i, text in enumerate(batch["text"]):
                if runs[i].is_valid:
                    own = runs[i].values
                    digests[i] = collapsed_digest(text.as_py(), *(own.field(c).to_numpy() for c in ("start", "length", "period")))
            arrays = [pa.array(digests, pa.string()) if c == "plain" else batch[c] for c in columns]
            yield pa.record_batch(arrays, columns)

    return found.mapInArrow(run, schema)


def periodic_runs(docs: DataFrame, *, long_words: int = LONG_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256, runs for every row of ``docs``.

    Words are cut at ASCII white space and compared as they are. A run is a stretch
    of words with smallest period q, of 12 words and 2 q at least, that no
    neighbouring word extends at that period. ``start``, ``length`` and ``period`` are
    those of the longest run (then the earliest, then of the smallest period), null
    without a run; ``runs`` lists all by start and period, null without any.

    1. Per octave of periods, documents are cut into overlapping tiles around
       boundaries a block apart. Tiles in which no boundary's block recurs at a
       distance of the octave are left out; every run repeats such a block.
    2. Each tile alone takes Z-functions forwards and backwards from its boundaries,
       which give the stretches that repeat at each period. Tiles of documents above
       ``long_words`` words are dealt to all tasks first, so that no task has a long
       document's work.
    3. Fragments are shuffled by document and period and stitched where they touch.

    A document's runs, fewer than its words, meet in one row. Null and empty texts have
    no run. Every row is judged for itself, also if its id repeats or is null. An
    empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    scan = materialize(_scanned(rows, long_words), "scan")
    tiles = scan.where(F.col("kind") == TILE).select("row", "octave", "at", "bounds", "words")
    fragments = scan.where(F.col("kind") == FRAGMENT).select("row", "period", "s", "e").unionByName(
        _solved(tiles.repartition(width(docs.sparkSession), "row", "octave", "at")))
    runs = materialize(_stitched(fragments), "runs")
    documents = scan.where(F.col("kind") == DOCUMENT).select("row", "id", "n", "plain", "text")
    found = _collapsed(documents.join(runs, "row", "left").select("id", "plain", "text", "runs"))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("minus"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform(F.coalesce("runs", F.array().cast("array<struct<start:bigint,period:bigint,length:bigint>>")),
                        lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")
    return found.withColumn("_best", best).select(
        F.col("id").alias(id_col), F.coalesce(F.size("runs"), F.lit(0)).cast("long").alias("n_runs"),
        F.col("_best.start").alias("start"), (-F.col("_best.minus")).alias("length"), F.col("_best.period").alias("period"),
        F.expr("1000 * -_best.minus div _best.period").alias("exponent_milli"),
        F.sha2(text, 256).alias("runs_sha256"), F.col("plain").alias("collapsed_sha256"), "runs")
