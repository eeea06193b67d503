"""Best-fit packing of token pieces by exact complements."""

from __future__ import annotations

import os
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm.common import in_slices, split_words
from tidemark.scratch import materialize

CAPACITY = 4096
SLICE_BYTES = 12_000_000
STEMS_PER_CALL = 5000
MARKS = (".", ",", ";", ":", "!", "?")
ROWS_PER_BUCKET = 100_000
MIN_BUCKETS = 64


class ChunkEncoder:
    """Token ids of whole texts, every distinct white-space-free chunk of a slice encoded once.

    The tokenizer drops white space and never joins characters across it, so a
    text's ids are those of its chunks, one after another. Nor does it join a
    letter or digit and the mark after it, so a chunk's last mark is encoded apart.
    Lower-casing A-Z first is what its own normaliser does; texts of a slice that
    may hold a special token's string are left as they are.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def _chunk_ids(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk as native 32-bit integers, stems encoded some thousands a call."""
        places: dict[str, int] = {}
        stems, marks = [], []
        for chunk in chunks:
            stem, mark = chunk[:-1], chunk[-1:]
            # Some letters end in an accent when lower-cased, which joins the mark.
            if mark not in MARKS or not (stem.isascii() or stem[-1:].lower()[-1:].isalnum()) or not stem[-1:].isalnum():
                stem, mark = chunk, ""
            stems.append(places.setdefault(stem, len(places)))
            marks.append(mark)
        wanted, ids = [*places, *MARKS], []
        for at in range(0, len(wanted), STEMS_PER_CALL):  # what a call returns is many times larger than the ids
            found = self.tokenizer.encode_batch_fast(wanted[at:at + STEMS_PER_CALL], add_special_tokens=False)
            ids += [array("I", e.ids).tobytes() for e in found]
        after = dict(zip(MARKS, ids[len(places):])) | {"": b""}
        return [ids[i] + after[m] for i, m in zip(stems, marks)]

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text as native 32-bit integers."""
        for part in in_slices(texts, SLICE_BYTES):
            special = pc.any(pc.match_substring(part, "<|")).as_py()
            starts, number, chunks = split_words(pc.replace_substring(part if special else pc.ascii_lower(part), "\n", " "))
            ids = self._chunk_ids(chunks)
            place = np.r_[0, np.cumsum(np.array(list(map(len, ids)), np.int64)[number])][starts].tolist()
            data = pa.array(ids, pa.large_binary()).take(pa.array(number)).buffers()[2] or b""
            for a, b in zip(place[:-1], place[1:]):
                yield bytes(data[a:b])

    def encode(self, text: str) -> bytes:
        """Ids of one text."""
        return next(self.encode_all(pa.array([text], pa.string())))


@lru_cache(maxsize=2)
def _encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def token_pieces(
    docs: DataFrame, tokenizer_path: str, *, end_id: int = 1, capacity: int = CAPACITY, with_ids: bool = False,
    id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Cut every document's ids, ``end_id`` last, into pieces of ``capacity`` at most.

    Columns: id, piece, start, length, ids_crc32 and, when asked for, ids.
    Null and empty texts are the end id alone; repeated rows and null ids give
    pieces like any other.
    """
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    end = np.array([end_id], "<u4").tobytes()
    fields = [(id_col, pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    to = pa.schema(fields + [("ids", pa.list_(pa.int64()))] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for key, ids in zip(batch[id_col].to_pylist(), _encoder(tokenizer_path).encode_all(batch["_text"])):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at:at + 4 * capacity]
                    row = (key, piece, at // 4, len(own) // 4, zlib.crc32(own))
                    found.append((*row, np.frombuffer(own, "<u4").tolist()) if with_ids else row)
            columns = zip(*found) if found else [()] * len(to)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, to)], schema=to)

    return rows.mapInArrow(run, f"{id_col} long, piece int, start long, length long, ids_crc32 long"
                                + (", ids array<long>" if with_ids else ""))


class Supply:
    """How many pieces of each length are left, with the combinations that sum to a gap.

    ``exact`` looks a gap up among single lengths, then pair sums, then triple
    sums. ``sums`` marks the pair sums there were when it was last built; as
    supplies only shrink, a sum that it lacks stays impossible, and a gap found
    empty stays empty.
    """

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype(np.int64).copy()
        self.empty: set[int] = set()
        self._index()

    def _index(self) -> None:
        bits = int.from_bytes(np.packbits(self.left > 0, bitorder="little").tobytes(), "little")
        reach = 0
        for x in np.flatnonzero(self.left).tolist():
            reach |= bits << x
        size = len(self.left)
        raw = (reach & ((1 << size) - 1)).to_bytes(-(-size // 8), "little")
        self.sums = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")[:size].astype(bool)

    def _pair(self, gap: int, least: int = 1) -> tuple[int, int] | None:
        """Most even pair of lengths, each ``least`` or more, summing to ``gap``."""
        if gap < 2 * least or not self.sums[gap]:
            return None
        low = self.left[least:gap // 2 + 1] > 0
        high = self.left[gap - gap // 2:gap - least + 1][::-1] > 0
        ok = low & high
        if gap % 2 == 0 and self.left[gap // 2] < 2:
            ok[-1] = False
        at = np.flatnonzero(ok)
        if not len(at):
            return None
        small = int(at[-1]) + least
        return gap - small, small

    def _triple(self, gap: int) -> tuple[int, int, int] | None:
        top = gap // 3
        maybe = np.flatnonzero((self.left[1:top + 1] > 0) & self.sums[gap - top:gap][::-1]) + 1
        for tries, small in enumerate(maybe[::-1].tolist()):
            if tries == 16:
                self._index()
            self.left[small] -= 1
            pair = self._pair(gap - small, small)
            self.left[small] += 1
            if pair:
                return *pair, small
        return None

    def exact(self, gap: int) -> tuple[int, ...] | None:
        if gap in self.empty:
            return None
        if self.left[gap] > 0:
            return (gap,)
        found = self._pair(gap) or self._triple(gap)
        if found is None:
            self.empty.add(gap)
        return found

    def largest(self, limit: int) -> int:
        """Largest length left of at most ``limit``; 0 if there is none."""
        at = np.flatnonzero(self.left[1:limit + 1])
        return int(at[-1]) + 1 if len(at) else 0

    def take(self, lengths: tuple[int, ...]) -> int:
        """Consume a combination as often as the supply allows."""
        need = Counter(lengths)
        times = min(int(self.left[x]) // n for x, n in need.items())
        for x, n in need.items():
            self.left[x] -= n * times
        return times


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of one sequence, how many such sequences) using up ``counts``.

    First every length, longest first, with combinations of one to three others
    that fill its sequence to the last token. Then best fit for what is left:
    the longest piece, then again and again an exact complement of the gap or
    else the longest piece that fits. Work and result depend on the number of
    different lengths, not on the number of pieces.
    """
    supply, patterns = Supply(counts), []

    def use(lengths: tuple[int, ...]) -> bool:
        times = supply.take(lengths)
        if times:
            patterns.append((lengths, times))
        return times > 0

    if supply.left[capacity]:
        use((capacity,))
    for length in range(capacity - 1, 0, -1):
        while supply.left[length]:
            supply.left[length] -= 1
            rest = supply.exact(capacity - length)
            supply.left[length] += 1
            if rest is None or not use((length, *rest)):
                break
    while length := supply.largest(capacity):
        held, gap = [], capacity
        while length:
            held.append(length)
            supply.left[length] -= 1
            gap -= length
            rest = supply.exact(gap) if gap else None
            if rest:
                held += rest
                break
            length = supply.largest(gap) if gap else 0
        for x in held[:len(held) - len(rest or ())]:
            supply.left[x] += 1
        use(tuple(held))
    return patterns


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Per length, which of its pieces go where: sorted ranges for a binary search."""
    used: Counter = Counter()
    rows, sequence = [], 0
    for lengths, times in patterns:
        offset = 0
        for x in lengths:
            rows.append((x, used[x], sequence, offset))
            used[x] += times
            offset += x
        sequence += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    return dict(zip(("length", "first", "sequence", "offset"), table.T.copy()))


def _unused(name: str, columns: list[str]) -> str:
    while name in columns:
        name = "_" + name
    return name


def pack(pieces: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces that have a ``length``.

    The driver sees one count per length, never a piece. Every piece gets a number
    of its own when it is written; pieces are counted within their length over
    buckets of these, so a length that a third of all pieces share, or one piece that
    repeats as often, is spread over many tasks. Columns named ``sequence_id`` or
    ``offset`` are replaced, all others stay. An empty table gives an empty one.
    """
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    row, number = _unused("_row", names), _unused("_number", names)
    stored = materialize(pieces.select(*names, F.monotonically_increasing_id().alias(row)), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for found in stored.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():  # capacity rows at most
        counts[found["length"]] = found["n"]
    table = slots(plan(counts, capacity))
    buckets = max(MIN_BUCKETS, -(-int(counts.sum()) // ROWS_PER_BUCKET))
    placed = _numbered(stored, row, number, buckets)
    key = (table["length"] << 42) + table["first"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, at_length = (batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", number))
            at = np.searchsorted(key, (length << 42) + at_length, "right") - 1
            yield pa.record_batch(
                [*(batch[c] for c in names), pa.array(table["sequence"][at] + at_length - table["first"][at]),
                 pa.array(table["offset"][at])], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stored.schema if f.name != row)
    return placed.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def _numbered(pieces: DataFrame, row: str, number: str, buckets: int) -> DataFrame:
    """``number`` from 0 within each length, in no particular order."""
    columns = [c for c in pieces.columns if c != row]
    bucket, n, first, local = (_unused(c, pieces.columns) for c in ("_bucket", "_n", "_first", "_local"))
    keyed = pieces.withColumn(bucket, F.pmod(F.xxhash64(row), F.lit(buckets)).cast("int"))
    counts = keyed.groupBy("length", bucket).agg(F.count(F.lit(1)).alias(n))
    before = W.partitionBy("length").orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    firsts = counts.select("length", bucket, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(first))
    numbered = keyed.withColumn(local, F.row_number().over(W.partitionBy("length", bucket).orderBy(row)) - 1)
    return numbered.join(firsts, ["length", bucket]).select(
        *columns, (F.col(first) + F.col(local)).cast("long").alias(number))


def pack_documents(docs: DataFrame, tokenizer_path: str, *, capacity: int = CAPACITY, **options) -> DataFrame:
    """Token pieces of documents with their places in packed sequences."""
    return pack(token_pieces(docs, tokenizer_path, capacity=capacity, **options), capacity=capacity)
