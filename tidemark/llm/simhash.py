"""SimHash near duplicates: candidates by pigeonring chains of fingerprint segments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ASCII_LOWER, partitions_for
from tidemark.llm.components import components
from tidemark.scratch import materialize

BITS = 64
SEGMENTS = 5
DISTANCE = 2
EXACT_CHAIN = 2  # segments of a viable chain that may not differ at all: 2 * 2 < 5
NEAR_CHAIN = 4  # segments of a viable chain that differ in one bit at most: 2 * 4 < 2 * 5
BUCKET = 2048
ROWS_PER_TASK = 1_000_000
SUM_ROWS = 255

EDGES = [round(i * BITS / SEGMENTS) for i in range(SEGMENTS + 1)]
WIDTHS = [b - a for a, b in zip(EDGES[:-1], EDGES[1:])]


# ---- fingerprints -----------------------------------------------------------------------------------

def shingle_hashes(text: str | None, width: int, seed: int) -> list[int]:
    """XXH64 of every word shingle of a text, repeats included; of all words if they are fewer."""
    words = (text or "").encode("utf-8", "replace").translate(ASCII_LOWER).split()
    data = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return [digest(data, seed)] if words else []
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    return [digest(data[a:b], seed) for a, b in zip((end - size).tolist(), end[width - 1:].tolist())]


def fingerprint(hashes: np.ndarray) -> int:
    """Each bit that more than half of the hashes have; 0 without hashes."""
    total = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), SUM_ROWS * 256):
        bits = np.unpackbits(hashes[i:i + SUM_ROWS * 256].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        # Sums of so few ones fit a byte.
        total += np.add.reduceat(bits, np.arange(0, len(bits), SUM_ROWS), axis=0, dtype=np.uint8).sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(rows: DataFrame, width: int, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(np.array(shingle_hashes(t.as_py(), width, seed), np.uint64)) for t in batch["text"]]
            yield pa.record_batch([batch["id"], pa.array(np.array(prints, np.uint64).view(np.int64))], ["id", "print"])

    return rows.mapInArrow(run, "id long, print long")


# ---- the ring of segments ---------------------------------------------------------------------------

def rotated(prints: np.ndarray, start: int) -> np.ndarray:
    """Fingerprints turned so that segment ``start`` comes first, in the highest bits."""
    turn = np.uint64(EDGES[start])
    return prints if start == 0 else (prints << turn) | (prints >> (np.uint64(BITS) - turn))


def _ring(start: int) -> list[int]:
    """Places, from the highest bit, where the segments end that follow each other from ``start``."""
    return np.cumsum([WIDTHS[(start + j) % SEGMENTS] for j in range(SEGMENTS)]).tolist()


def viable(difference: np.ndarray, start: int, distance: int = DISTANCE) -> np.ndarray:
    """Whether each prefix of the chain of segments from the highest bit keeps within its share of the distance.

    A chain of l of the m segments may differ in l * distance / m bits. Of two
    fingerprints within the distance at least one start has a chain whose
    prefixes all keep to that; the last prefix is the whole Hamming check.
    """
    alive = np.ones(len(difference), bool)
    for length, end in enumerate(_ring(start), 1):
        part = np.bitwise_count(difference[alive] >> np.uint64(BITS - end))
        alive[alive] = part <= distance * length // SEGMENTS
    return alive


class Forest:
    """Union-find over the places of an array; keeps only links that join two trees."""

    def __init__(self, size: int):
        self.root = np.arange(size)
        self.links: list[tuple[int, int]] = []

    def _find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Pairs not yet known to be in one tree."""
        return self.root[a] != self.root[b]

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        new = False
        for i, j in zip(a.tolist(), b.tolist()):
            x, y = self._find(i), self._find(j)
            if x != y:
                self.root[max(x, y)] = min(x, y)
                self.links.append((i, j))
                new = True
        while new:
            flat = self.root[self.root]
            new = bool((flat != self.root).any())
            self.root = flat


def bucket_links(key: np.ndarray, prints: np.ndarray) -> list[tuple[int, int]]:
    """Links within runs of equal keys (start and leading segments), enough to connect what links there.

    Neighbours at growing distance in the sorted rows are compared; pairs that are
    connected already are not looked at again.
    """
    forest = Forest(len(key))
    end = np.searchsorted(key, key, side="right")
    start = (key >> np.int64(32)).astype(np.int64)
    at, step = np.arange(len(key)), 1
    while True:
        at = at[at + step < end[at]]
        if not len(at):
            return forest.links
        a = at[forest.apart(at, at + step)]
        for s in np.unique(start[a]):
            own = a[start[a] == s]
            own = own[viable(rotated(prints[own] ^ prints[own + step], int(s)), int(s))]
            forest.join(own, own + step)
        step += 1


def lookup_links(start: int, homes: np.ndarray, home_of: np.ndarray, probes: np.ndarray, probe_of: np.ndarray, size: int) -> Forest:
    """Links of full buckets by lookup: all that a last segment may add to a viable chain is looked up among the homes.

    ``homes`` are sorted rotated fingerprints, ``probes`` such with one bit set that
    their owners do not have; ``*_of`` are the places of the owners.
    """
    forest = Forest(size)
    last = WIDTHS[(start + NEAR_CHAIN) % SEGMENTS]
    one = [1 << i for i in range(last)]
    two = [x | y for i, x in enumerate(one) for y in one[:i]]
    for values, owner, masks in ((homes, home_of, [*one, *two]), (probes, probe_of, [0, *one])):
        for mask in masks:
            wanted = values ^ np.uint64(mask)
            place = np.minimum(np.searchsorted(homes, wanted), len(homes) - 1)
            found = homes[place] == wanted
            a, b = owner[found], home_of[place[found]]
            new = forest.apart(a, b)
            forest.join(a[new], b[new])
    return forest


# ---- distributed ------------------------------------------------------------------------------------

def _runs(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[list[np.ndarray]]:
    """Sorted rows in chunks that never cut a run of the first column."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        new = [batch[c].to_numpy(zero_copy_only=False) for c in columns]
        held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
        cut = int(np.searchsorted(held[0], held[0][-1], side="left")) if len(held[0]) else 0
        if cut > ROWS_PER_TASK // 10:
            yield [x[:cut] for x in held]
            held = [x[cut:] for x in held]
    if held is not None and len(held[0]):
        yield held


def _link_batch(prints: np.ndarray, links: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.array(links, np.int64).reshape(-1, 2)
    return pa.record_batch([pa.array(prints.view(np.int64)[pairs[:, 0]]), pa.array(prints.view(np.int64)[pairs[:, 1]])], ["u", "v"])


def _postings(prints: DataFrame) -> DataFrame:
    """(key, print): every fingerprint under the first two segments from each start of the ring."""
    value = F.col("print")

    def key(start: int) -> F.Column:
        turned = value if start == 0 else F.shiftleft(value, EDGES[start]).bitwiseOR(F.shiftrightunsigned(value, BITS - EDGES[start]))
        return F.shiftrightunsigned(turned, BITS - _ring(start)[EXACT_CHAIN - 1]).bitwiseOR(F.lit(start << 32))

    return prints.select(F.explode(F.array(*(key(s) for s in range(SEGMENTS)))).alias("key"), "print")


def _small_buckets(postings: DataFrame, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, prints in _runs(batches, ["key", "print"]):
            unsigned = prints.view(np.uint64)
            yield _link_batch(unsigned, bucket_links(key, unsigned))

    return postings.repartition(parts, "key").sortWithinPartitions("key", "print").mapInArrow(run, "u long, v long")


def _full_buckets(postings: DataFrame, parts: int) -> DataFrame:
    """Links of buckets of any size: dealt anew under four segments, where 2^13 fingerprints differ at most.

    A viable chain differs in one bit at most within four segments, the first two
    excepted. Each fingerprint goes home, and as a probe to every home that has one
    bit more there.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, prints = batch["key"].to_numpy(), batch["print"].to_numpy().view(np.uint64)
            for s in np.unique(key >> np.int64(32)).tolist():
                own = prints[(key >> np.int64(32)) == s]
                turned, ends = rotated(own, s), _ring(s)
                low = np.uint64(BITS - ends[NEAR_CHAIN - 1])
                out = [(turned >> low, own, turned, np.zeros(len(own), bool))]
                for bit in range(BITS - ends[NEAR_CHAIN - 1], BITS - ends[EXACT_CHAIN - 1]):
                    mask = np.uint64(1) << np.uint64(bit)
                    lacks = turned & mask == 0
                    probe = turned[lacks] | mask
                    out.append((probe >> low, own[lacks], probe, np.ones(len(probe), bool)))
                home, owner, value, is_probe = (np.concatenate(x) for x in zip(*out))
                yield pa.record_batch([
                    pa.array(home.view(np.int64) | np.int64(s << 56)), pa.array(owner.view(np.int64)), pa.array(value.view(np.int64)),
                    pa.array(is_probe)], ["key", "print", "value", "probe"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, prints, value, probe in _runs(batches, ["key", "print", "value", "probe"]):
            probe = probe.astype(bool)
            for s in np.unique(key >> np.int64(56)).tolist():
                own = (key >> np.int64(56)) == s
                home, ask = np.flatnonzero(own & ~probe), np.flatnonzero(own & probe)
                home = home[np.argsort(value.view(np.uint64)[home], kind="stable")]
                if len(home):
                    unsigned = value.view(np.uint64)
                    yield _link_batch(prints.view(np.uint64), lookup_links(
                        s, unsigned[home], home, unsigned[ask], ask, len(key)).links)

    dealt = postings.mapInArrow(deal, "key long, print long, value long, probe boolean")
    return dealt.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(run, "u long, v long")


def near_duplicates(
    docs: DataFrame, *, width: int = 3, seed: int = 42, bucket: int = BUCKET, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id, ``fingerprint`` (16 hex digits), ``component_id`` for every row of ``docs``.

    Texts are lower-cased in A-Z and cut into words at ASCII white space; a bit of
    the fingerprint is set if it is in over half of the XXH64 of the word shingles.
    Fingerprints link at two differing bits or fewer; component_id is the smallest
    id reachable by links.

    1. Equal fingerprints are one class, named by the smallest id.
    2. The 64 bits are a ring of five segments. Pigeonring: two linked fingerprints
       have a start from which every chain of l segments differs in 2 l / 5 bits at
       most, so the first two segments are equal. Every fingerprint is posted under
       these, from each start.
    3. Within a bucket, pairs whose chains keep to their budgets are checked in full.
       Pairs already connected are passed over, and only links that connect go out:
       fewer than a bucket has fingerprints.
    4. Buckets above ``bucket`` fingerprints go on to four segments and lookups, with
       a bounded number of fingerprints a key and no comparison of pairs.

    Null and empty texts have the fingerprint zero, which links like any other. A
    null id gets its fingerprint and a null component, and links with nothing.
    Repeated rows link with each other. An empty table gives an empty result. Other
    columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    prints = materialize(_fingerprints(rows, width, seed), "fingerprints")
    classes = materialize(prints.where("id IS NOT NULL").groupBy("print").agg(F.min("id").alias("rep")), "print-classes")
    parts = partitions_for(spark, SEGMENTS * classes.count(), ROWS_PER_TASK)
    postings = _postings(classes.select("print"))
    full = materialize(postings.groupBy("key").count().where(F.col("count") > bucket).select("key"), "full-buckets")
    links = _small_buckets(postings.join(full, "key", "left_anti"), parts)
    if not full.isEmpty():
        links = links.unionByName(_full_buckets(postings.join(full, "key", "left_semi"), parts))
    labels = components(materialize(links, "print-links"))
    named = classes.join(labels.withColumnRenamed("id", "print"), "print", "left").select(
        "print", "rep", F.coalesce("label", "print").alias("label"))
    named = materialize(named, "print-labels")
    least = named.groupBy("label").agg(F.min("rep").alias("component"))
    by_print = materialize(named.join(least, "label").select("print", "component"), "print-components")
    found = prints.join(by_print, "print", "left")
    return found.select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"),
        F.when(F.col("id").isNotNull(), F.col("component")).alias("component_id"))
