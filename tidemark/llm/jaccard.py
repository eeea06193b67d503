"""N-gram Jaccard join: blocked sparse products of the document by n-gram incidence."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ASCII_LOWER, partitions_for
from tidemark.llm.components import components
from tidemark.scratch import materialize

ENTRIES_PER_BLOCK = 2_000_000
SETS_PER_BUCKET = 20_000
TILE = 256
LOCAL_BITS = 48
LEAD_PERCENT = 15
SHARE_GROWTH = 8
MAX_CACHED = 300_000
TILE_SCHEMA = "block int, sigs binary, sizes binary, counts binary, low binary, high binary, freq binary"


class Shingler:
    """Distinct word shingles of a text as sorted 64-bit hashes."""

    # One multiplier per place in the shingle: odd, without small whole-number relations between them.
    FACTORS = np.array([xxhash.xxh3_64_intdigest(b"place %d" % i) | 1 for i in range(64)], np.uint64)

    def __init__(self, width: int):
        self.width, self.seen = width, {}

    def _word(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self.seen) < MAX_CACHED:
            self.seen[word] = value
        return value

    def shingles(self, text: str | None) -> np.ndarray:
        """Empty without words; one shingle of all words if they are fewer than the width."""
        words = (text or "").encode("utf-8", "replace").translate(ASCII_LOWER).split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(words) < self.width:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), len(words))], np.uint64)
        get, make = self.seen.get, self._word
        each = np.array([get(w) or make(w) for w in words], np.uint64)
        n = len(words) - self.width + 1
        mixed = each[:n] * self.FACTORS[0]
        for j in range(1, self.width):
            mixed += each[j:n + j] * self.FACTORS[j]
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        return np.unique(mixed)


def signature(shingles: np.ndarray) -> bytes:
    """128 bits that name the set; all zero for the empty one."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else bytes(16)


def spare(size: np.ndarray, percent: int) -> np.ndarray:
    """How many of a set's columns a partner may lack: size - ceil(percent of size)."""
    return size - -(-percent * size // 100)


def in_common(size: np.ndarray) -> np.ndarray:
    """How many leading columns two sets must share, by the size of the smaller one."""
    return np.maximum(1, LEAD_PERCENT * size // 100)


def _bytes(column) -> bytes:
    return b"".join(column.to_pylist())


def _number(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(_bytes(table[name]), kind)


# ---- incidence in blocks of columns (n-grams) -----------------------------------------------------

def _tiles(sets: list[tuple[bytes, int, np.ndarray]], blocks: int) -> pa.RecordBatch:
    """Cut the incidence rows of a batch into one tile per block of columns.

    A column is its block number and ``LOCAL_BITS`` more bits of its hash.
    """
    counts = np.array([len(s) for _, _, s in sets], np.int64)
    hashes = np.concatenate([s for _, _, s in sets]) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), counts)
    # Mixed first: leading columns are those of small hashes.
    mixed = hashes * np.uint64(0x9E3779B97F4A7C15)
    block = ((mixed >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(block, kind="stable")
    block, owner = block[order], owner[order]
    local = hashes[order] & np.uint64((1 << LOCAL_BITS) - 1)
    sigs = np.frombuffer(b"".join(s for s, _, _ in sets), "V16")
    sizes = np.array([n for _, n, _ in sets], np.int32)
    out = []
    edges = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True]) if len(block) else np.zeros(1, int)
    for a, b in zip(edges[:-1], edges[1:]):
        starts = np.flatnonzero(np.r_[True, owner[a + 1:b] != owner[a:b - 1]])
        rows = owner[a:b][starts]
        out.append((int(block[a]), sigs[rows].tobytes(), sizes[rows].tobytes(),
                    np.diff(np.r_[starts, b - a]).astype(np.int32).tobytes(),
                    (local[a:b] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(),
                    (local[a:b] >> np.uint64(32)).astype(np.uint16).tobytes(), b""))
    return _tile_batch(out)


def _tile_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 7
    kinds = [pa.int32(), *[pa.binary()] * 6]
    names = ["block", "sigs", "sizes", "counts", "low", "high", "freq"]
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _rows_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(signatures, sizes, row of each entry, column bits, frequency class) of joined tiles.

    Tiles of the same set in the same block are equal; one stays.
    """
    sigs, sizes = _number(table, "sigs", "V16"), _number(table, "sizes", np.int32)
    counts, low = _number(table, "counts", np.int32), _number(table, "low", np.uint32)
    local = low.astype(np.uint64) | _number(table, "high", np.uint16).astype(np.uint64) << np.uint64(32)
    freq = _number(table, "freq", np.uint8)
    return sigs, sizes, np.repeat(np.arange(len(sigs)), counts), local, freq


def _names(sigs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number each distinct signature: (number of each, place where each number first occurs)."""
    halves = np.frombuffer(sigs.tobytes(), np.uint64).reshape(-1, 2)
    order = np.lexsort((np.arange(len(halves)), halves[:, 1], halves[:, 0]))
    ordered = halves[order]
    new = np.r_[True, (ordered[1:] != ordered[:-1]).any(1)] if len(halves) else np.zeros(0, bool)
    number = np.empty(len(halves), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, order[new]


def _shared_columns(buckets: int, with_columns: bool):
    """Per block of columns: drop columns of one row only, deal the rest to buckets of rows.

    Without columns, only their number per row goes on.
    """

    def run(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        sigs, sizes, row, local, _ = _rows_of(table)
        _, firsts = _names(sigs)
        once = np.zeros(len(sigs), bool)
        once[firsts] = True
        here = once[row]
        row, local = row[here], local[here]
        order = np.argsort(local, kind="stable")
        ordered = local[order]
        edge = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1], True])
        count = np.diff(edge)
        freq = np.empty(len(local), np.int64)
        freq[order] = np.repeat(count, count)
        kept = freq > 1
        row, local = row[kept], local[kept]
        # A column's class of frequency: any function of the column will do for the order of columns.
        level = np.minimum(8 * np.log2(np.maximum(freq[kept], 1)), 255).astype(np.uint8)
        bucket = (np.frombuffer(sigs.tobytes(), np.uint64).reshape(-1, 2)[:, 0] % np.uint64(buckets)).astype(np.int64)[row]
        order = np.lexsort((row, bucket))
        row, local, level, bucket = row[order], local[order], level[order], bucket[order]
        out = []
        edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(row) else np.zeros(1, int)
        for a, b in zip(edges[:-1], edges[1:]):
            starts = np.flatnonzero(np.r_[True, row[a + 1:b] != row[a:b - 1]])
            rows = row[a:b][starts]
            out.append((block, int(bucket[a]), sigs[rows].tobytes(), sizes[rows].tobytes(),
                        np.diff(np.r_[starts, b - a]).astype(np.int32).tobytes(), *(
                            ((local[a:b] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(),
                             (local[a:b] >> np.uint64(32)).astype(np.uint16).tobytes(), level[a:b].tobytes())
                            if with_columns else (b"", b"", b""))))
        columns = list(zip(*out)) if out else [()] * 8
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 6]
        names = ["block", "bucket", "sigs", "sizes", "counts", "low", "high", "freq"]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return run


def _joinable_rows(percent: int):
    """Per bucket of rows: keep the sets that share enough columns to link with anything.

    A partner holds at least ``percent`` of the set, so that many of its columns
    must occur elsewhere. Columns come back rarest first.
    """

    def run(table: pa.Table) -> pa.Table:
        sigs, sizes, row, local, freq = _rows_of(table)
        counts = _number(table, "counts", np.int32)
        tile = np.repeat(table["block"].to_numpy(), [len(x) // 4 for x in table["counts"].to_pylist()])
        column = (np.repeat(tile, counts).astype(np.int64) << LOCAL_BITS) | local.astype(np.int64)
        number, firsts = _names(sigs)
        owner = number[row]
        shared = np.bincount(owner, minlength=len(firsts))
        size = sizes[firsts].astype(np.int64)
        alive = 100 * shared >= percent * size
        order = np.lexsort((column, freq, owner))
        order = order[alive[owner[order]]]
        held = np.flatnonzero(alive)
        lists = pa.ListArray.from_arrays(
            pa.array(np.r_[0, np.cumsum(shared[held])].astype(np.int32)), pa.array(column[order]))
        return pa.table([
            pa.array([s.tobytes() for s in sigs[firsts[held]]], pa.binary()), pa.array(size[held]), lists],
            ["sig", "size", "columns"])

    return run


def _led_rows(percent: int):
    """Per bucket of rows: signatures of the sets whose leading columns are shared often enough.

    A partner has at least ``percent`` of the set's size; what it must share
    follows from the smaller of the two sizes.
    """

    def run(table: pa.Table) -> pa.Table:
        sigs, sizes = _number(table, "sigs", "V16"), _number(table, "sizes", np.int32).astype(np.int64)
        counts = _number(table, "counts", np.int32)
        number, firsts = _names(sigs)
        shared = np.bincount(number, counts, minlength=len(firsts))
        least = -(-percent * sizes[firsts] // 100)
        alive = firsts[shared >= in_common(least)]
        return pa.table([pa.array([x.tobytes() for x in sigs[alive]], pa.binary())], ["sig"])

    return run


TILE_ROWS = "block int, bucket int, sigs binary, sizes binary, counts binary, low binary, high binary, freq binary"


def _well_led(tiles: DataFrame, sets: int, percent: int) -> DataFrame:
    """Signatures of the sets that may link with another, judged by their leading columns."""
    buckets = partitions_for(tiles.sparkSession, sets, SETS_PER_BUCKET)
    shared = tiles.groupBy("block").applyInArrow(_shared_columns(buckets, False), TILE_ROWS)
    return shared.groupBy("bucket").applyInArrow(_led_rows(percent), "sig binary")


def _joinable(tiles: DataFrame, sets: int, percent: int) -> DataFrame:
    """Sets that may link with another: (sig, size, columns that others hold too, rarest first)."""
    buckets = partitions_for(tiles.sparkSession, sets, SETS_PER_BUCKET)
    shared = tiles.groupBy("block").applyInArrow(_shared_columns(buckets, True), TILE_ROWS)
    rows = shared.groupBy("bucket").applyInArrow(_joinable_rows(percent), "sig binary, size long, columns array<long>")
    return materialize(rows, "joinable")


def _document_tiles(docs: DataFrame, width: int, blocks: int, lead: int | None = None) -> DataFrame:
    """Tiles of all documents; a set already sent by the same task is not sent again.

    With ``lead`` (a percentage a partner must hold) only the leading columns
    go out: by order of their hash, as many as a partner may lack and as many
    again as two sets must then share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, sent = Shingler(width), set()
        held, size = [], 0
        for batch in batches:
            for text in batch["_text"]:
                shingles = shingler.shingles(text.as_py())
                sig = signature(shingles)
                if not len(shingles) or sig in sent:
                    continue
                if len(sent) < MAX_CACHED:
                    sent.add(sig)
                n = len(shingles)
                if lead is not None:
                    shingles = shingles[:int(spare(np.int64(n), lead) + in_common(np.int64(n)))]
                held.append((sig, n, shingles))
                size += len(shingles)
                if size > ENTRIES_PER_BLOCK:
                    yield _tiles(held, blocks)
                    held, size = [], 0
        yield _tiles(held, blocks)

    return docs.select("_text").mapInArrow(run, TILE_SCHEMA)


# ---- products of the rows that are left ---------------------------------------------------------

def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sparse product of two row blocks: how many columns each pair of rows shares."""
    columns, place = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    left = sum(map(len, a))
    row_a = np.repeat(np.arange(len(a)), [len(x) for x in a])
    row_b = np.repeat(np.arange(len(b)), [len(x) for x in b])
    both = np.intersect1d(place[:left], place[left:])
    counts = np.zeros((len(a), len(b)), np.float32)
    number = np.full(len(columns), -1, np.int64)
    number[both] = np.arange(len(both))
    ca, cb = number[place[:left]], number[place[left:]]
    for i in range(0, len(both), 4096):  # blocks of columns, accumulated
        width = min(4096, len(both) - i)
        x, y = np.zeros((len(a), width), np.float32), np.zeros((len(b), width), np.float32)
        own = (ca >= i) & (ca < i + width)
        x[row_a[own], ca[own] - i] = 1
        own = (cb >= i) & (cb < i + width)
        y[row_b[own], cb[own] - i] = 1
        counts += x @ y.T
    return counts.astype(np.int64)


def linked(a: list, b: list, size_a: np.ndarray, size_b: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs reach the similarity: 100 * overlap >= percent * union."""
    both = overlaps(a, b)
    return 100 * both >= percent * (size_a[:, None] + size_b[None] - both)


def _star_links(percent: int):
    """One pivot times its candidates: the candidates that link with it."""

    def run(table: pa.Table) -> pa.Table:
        ids, sizes = table["id"].to_numpy(), table["size"].to_numpy()
        pivot = table["pivot"][0].as_py()
        rows = [x.values.to_numpy() for x in table["columns"]]
        at = int(np.flatnonzero(ids == pivot)[0])
        found = linked([rows[at]], rows, sizes[at:at + 1], sizes, percent)[0] & (ids != pivot)
        return pa.table([pa.array(ids[found]), pa.array(np.full(found.sum(), pivot, np.int64))], ["u", "v"])

    return run


class _Trees:
    """Union-find over the labels of a product."""

    def __init__(self, labels: np.ndarray):
        self.names, self.at = np.unique(labels, return_inverse=True)
        self.root = np.arange(len(self.names))

    def roots(self) -> np.ndarray:
        """Tree of each row."""
        return self.root[self.at]

    def join(self, x: np.ndarray, y: np.ndarray) -> list[int]:
        """Add links between rows; the places of those that joined two trees."""
        root, used = self.root, []

        def find(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for n, (i, j) in enumerate(zip(self.at[x].tolist(), self.at[y].tolist())):
            p, q = find(i), find(j)
            if p != q:
                root[max(p, q)] = min(p, q)
                used.append(n)
        for i in range(len(root)):  # every root is smaller than what it roots
            root[i] = root[root[i]]
        return used


def _tile_links(percent: int):
    """Product of two row blocks; as many links as join its labels, fewer than it has rows."""

    def run(table: pa.Table) -> pa.Table:
        ids, sizes = table["id"].to_numpy(), table["size"].to_numpy()
        trees = _Trees(table["label"].to_numpy())
        rows, first = [x.values.to_numpy() for x in table["columns"]], table["first"].to_numpy(zero_copy_only=False)
        second = table["second"].to_numpy(zero_copy_only=False)
        a, b = np.flatnonzero(first), np.flatnonzero(second)
        out = []
        for i in range(0, len(a), TILE):
            for j in range(0, len(b), TILE):
                x, y = a[i:i + TILE], b[j:j + TILE]
                tree = trees.roots()
                # Rows in one tree already need no product with each other.
                one = tree[x[0]] if len(x) and (tree[x] == tree[x[0]]).all() else -1
                y = y[tree[y] != one]
                if not len(x) or not len(y):
                    continue
                found = linked([rows[k] for k in x], [rows[k] for k in y], sizes[x], sizes[y], percent)
                p, q = np.nonzero(found & (tree[x][:, None] != tree[y][None]))
                used = trees.join(x[p], y[q])
                out += [(ids[x[p[k]]], ids[y[q[k]]]) for k in used]
        u, v = zip(*out) if out else ((), ())
        return pa.table([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def _neighbourhoods(rows: DataFrame, percent: int) -> DataFrame:
    """(pivot, id, votes): sets that share one of their leading columns, by the smallest id there.

    Two sets that link share a column among the leading size - ceil(share * size) + 1
    of each, in any common order of all columns; columns that no other set holds
    come first and are spent. Rarest first keeps the lists short.
    """
    need = F.ceil(F.col("size") * percent / 100.0 - 1e-9)
    lead = F.greatest(F.lit(0), F.size("columns") - need + 1).cast("int")
    entries = rows.select("id", F.explode(F.slice("columns", 1, lead)).alias("column"))
    entries = materialize(entries, "leading")
    lists = entries.groupBy("column").agg(F.min("id").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1")
    lists = materialize(lists.select("column", "pivot"), "pivots")  # for a plain join, whose hot columns Spark can split
    return entries.join(lists, "column").groupBy("pivot", "id").agg(F.count(F.lit(1)).alias("votes"))


def _chunk(column: str, chunks) -> F.Column:
    return F.pmod(F.xxhash64(column), chunks).cast("int")


def _star_round(rows: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Links of every set with the pivot it shares most leading columns with."""
    best = members.where("id <> pivot").groupBy("id").agg(F.max_by("pivot", F.struct("votes", -F.col("pivot"))).alias("pivot"))
    chunks = best.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(TILE))).alias("chunks"))
    placed = best.join(chunks, "pivot").select("pivot", "id", _chunk("id", F.col("chunks")).alias("chunk"))
    pivots = chunks.select("pivot", F.col("pivot").alias("id"), F.explode(F.sequence(F.lit(0), (F.col("chunks") - 1).cast("int"))).alias("chunk"))
    jobs = placed.unionByName(pivots).join(rows, "id")
    return jobs.groupBy("pivot", "chunk").applyInArrow(_star_links(percent), "u long, v long")


def _cross_round(rows: DataFrame, members: DataFrame, labels: DataFrame, percent: int, share: int) -> tuple[DataFrame, bool]:
    """Links between sets of one neighbourhood that carry different labels, and whether all pairs were looked at.

    A neighbourhood's members are cut into blocks of rows, large labels apart from
    the rest; a pair of blocks with two labels is one product. Of a neighbourhood of
    n blocks a hash chooses the part ``share`` / n of the pairs.
    """
    named = members.select("pivot", "id").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    per_label = named.groupBy("pivot", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = per_label.groupBy("pivot").agg(
        F.count(F.lit(1)).alias("labels"), F.sum(F.when(F.col("n") < TILE, F.col("n"))).alias("small")).where("labels > 1")
    sized = materialize(per_label.join(mixed, "pivot"), "labels")
    large = F.col("n") >= TILE
    pooled = F.ceil(F.coalesce("small", F.lit(0)) / F.lit(float(TILE))).cast("long")
    blocks = sized.select(
        "pivot", "label", F.when(large, F.col("label")).otherwise(F.lit(-1)).alias("owner"),
        F.when(large, F.ceil(F.col("n") / F.lit(float(TILE)))).otherwise(F.greatest(pooled, F.lit(1))).cast("long").alias("blocks"))
    placed = named.join(blocks, ["pivot", "label"]).withColumn(
        "block", F.when(F.col("owner") == -1, F.pmod(F.xxhash64("label"), F.col("blocks")))
        .otherwise(F.pmod(F.xxhash64("id"), F.col("blocks"))))
    placed = materialize(placed.select("pivot", "id", "label", "owner", "block"), "members")
    each = placed.select("pivot", "owner", "block").distinct()
    counted = materialize(each.groupBy("pivot").agg(F.count(F.lit(1)).alias("n")), "block-counts")
    most = counted.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first()["n"]
    a, b = (each.select("pivot", F.struct("owner", "block").alias(n)) for n in ("a", "b"))
    pairs = a.join(b, "pivot").where((F.col("a") <= F.col("b")) & ((F.col("a.owner") != F.col("b.owner")) | (F.col("a.owner") == -1)))
    if most > share:
        chosen = F.pmod(F.xxhash64("pivot", "a", "b"), F.lit(1 << 20)) * F.col("n") < (share << 20)
        pairs = pairs.join(counted, "pivot").where(chosen).drop("n")
    jobs = pairs.select("pivot", "a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("own"))
    own = placed.withColumn("own", F.struct("owner", "block")).drop("owner", "block")
    filled = jobs.join(own, ["pivot", "own"]).withColumns(
        {"first": F.col("own") == F.col("a"), "second": F.col("own") == F.col("b")}).join(rows, "id")
    links = filled.select("pivot", "a", "b", "id", "label", "size", "columns", "first", "second").groupBy(
        "pivot", "a", "b").applyInArrow(_tile_links(percent), "u long, v long")
    return materialize(links, "cross-links"), most <= share


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (id, label) after further links between ids."""
    def label_of(side: str) -> DataFrame:
        return labels.select(F.col("id").alias(side), F.col("label").alias(f"{side}_label"))

    ends = links.join(label_of("u"), "u", "left").join(label_of("v"), "v", "left")
    between = ends.select(F.coalesce("u_label", "u").alias("u"), F.coalesce("v_label", "v").alias("v"))
    merged = materialize(components(materialize(between, "label-links")).select(
        F.col("id").alias("label"), F.col("label").alias("_root")), "merged-labels")
    known = labels.join(merged, "label", "left").select("id", F.coalesce("_root", "label").alias("label"))
    new = merged.join(labels.select(F.col("id").alias("label")), "label", "left_anti").select(
        F.col("label").alias("id"), F.col("_root").alias("label"))
    return materialize(known.unionByName(new), "labels")


def shingle_sets(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(id, size, sig) of every document; equal signatures name equal sets."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            sets = [shingler.shingles(t.as_py()) for t in batch["_text"]]
            yield pa.record_batch([
                batch["id"], pa.array([len(s) for s in sets], pa.int64()), pa.array([signature(s) for s in sets], pa.binary())],
                ["id", "size", "sig"])

    return rows.mapInArrow(run, "id long, size long, sig binary")


def jaccard_join(
    docs: DataFrame, *, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id, ``n_shingles``, ``component_id`` for every row of ``docs``.

    Texts are lower-cased in A-Z and cut into words at ASCII white space; a
    document is the set of its ``width``-word shingles. Two documents link when
    100 * intersection >= ``percent`` * union; component_id is the smallest id
    reachable by links. Null and empty texts have no shingle and link with
    nothing. A null id gets its size, a null component, and links with nothing.
    Repeated rows link with each other. An empty table gives an empty result.

    1. Documents of equal sets are one class, named by the smallest id.
    2. The leading columns of every class (by hash, twice what a partner may
       lack) go into blocks of columns, which count them. Two sets that link
       share a known number of these; classes that share fewer with others go.
    3. All columns of what is left go into such blocks. A block drops columns that
       one class alone holds; blocks of rows then drop classes with fewer columns
       left than a partner of the least size must share.
    4. Classes that share a rare leading column meet around a pivot: first each class
       is multiplied with one pivot, then, block by block, with all classes of
       its neighbourhoods that are not yet in its component. Large neighbourhoods
       go through rounds over growing random parts of their block pairs, the last
       of which takes all; a product gives only links that join components, and
       pairs of one component are not looked at again. No link between two is missed.
    """
    spark = docs.sparkSession
    sets = materialize(shingle_sets(docs, width, id_col, text_col), "sets")
    known = sets.where("size > 0 AND id IS NOT NULL")
    classes = materialize(known.groupBy("sig", "size").agg(F.min("id").alias("rep")), "set-classes")
    total = classes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("entries"), F.count(F.lit(1)).alias("n")).first()
    labels = _links(spark, docs, classes, total["entries"], total["n"], width, percent, id_col, text_col)
    named = classes.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select(
        "sig", F.coalesce("label", "rep").alias("_component"))
    named = materialize(named, "class-components")
    found = sets.join(named, "sig", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("_component", "id"))
    return found.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), component.alias("component_id"))


def _links(spark, docs, classes, entries, n, width, percent, id_col, text_col) -> DataFrame:
    """(id, label) of the classes that link with another, by the smallest id of their component."""
    def blocks(of: int) -> int:
        return max(1, -(-of // ENTRIES_PER_BLOCK))

    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    led = (100 - percent + LEAD_PERCENT) * entries // 100
    some = _well_led(_document_tiles(texts, width, blocks(led), percent), n, percent)
    some = materialize(classes.join(some, "sig").select(F.col("rep").alias("_id"), "size"), "well-led")
    again = some.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("entries"), F.count(F.lit(1)).alias("n")).first()
    # A sorted merge at every size: the texts are moved once whatever the number of sets left.
    chosen = texts.join(some.select("_id").hint("merge"), "_id", "left_semi")
    left = _joinable(_document_tiles(chosen, width, blocks(again["entries"])), again["n"], percent)
    rows = materialize(left.join(classes.drop("size"), "sig").select(F.col("rep").alias("id"), "size", "columns"), "rows")
    members = materialize(_neighbourhoods(rows, percent), "neighbourhoods")
    labels = materialize(components(materialize(_star_round(rows, members, percent), "star-links")), "labels")
    # Ever larger random parts of the block pairs: what a part has connected the next one leaves
    # out, so a neighbourhood of n sets gives some multiple of n links a round, however many link.
    share, done = 1, False
    while not done:
        cross, done = _cross_round(rows, members, labels, percent, share)
        if not cross.isEmpty():
            labels = _relabelled(labels, cross)
        share *= SHARE_GROWTH
    return labels
