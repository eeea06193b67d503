"""Phrase collocations, counted in vertically partitioned, depth-truncated suffix subtrees."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ASCII_LOWER
from tidemark.scratch import materialize

DEPTH = 4
GROUP_WINDOWS = 1_000_000
CHUNK_WORDS = 1_000_000
ROW_WORDS = 4096
MAX_HEAVY = 1_000_000
MAX_CELLS = 1 << 20
HEAD_WORDS = 65_534
MAX_FILTER_BITS = 1 << 27
MAX_KNOWN = 300_000
SALTS = 64

MARK = b"\xff"  # no byte of UTF-8
PIECE_BREAKS = b".,;:!?\n\x0b\x0c\r"
FOLD = bytes(255 if b in PIECE_BREAKS else ASCII_LOWER[b] for b in range(256))
TAIL = 65_535
GRAMS = "lang string, w1 long, w2 long, w3 long, w4 long, n long"


def pieces(text: str | None) -> list[bytes]:
    """Lower-cased words of a text, with a mark wherever a piece ends."""
    return (text or "").encode("utf-8", "replace").translate(FOLD).replace(MARK, b" \xff ").split()


def code_of(word: bytes) -> int:
    """The 64 bits that name a word: Spark's ``xxhash64``; 0 is kept for none."""
    return xxhash.xxh64_intdigest(word, 42) or 1


# ---- words ------------------------------------------------------------------------------------------

def _word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) as each task has counted; a null word carries the number of all words."""

    def rows(counts: dict[str, Counter]) -> pa.RecordBatch:
        langs, words, n = [], [], []
        for lang, counter in counts.items():
            counter.pop(MARK, None)
            langs += [lang] * (len(counter) + 1)
            words += [*counter, None]
            n += [*counter.values(), sum(counter.values())]
        return pa.record_batch([pa.array(langs, pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())],
                               ["lang", "word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"]):
                counts.setdefault(lang, Counter()).update(pieces(text.as_py()))
                if sum(map(len, counts.values())) > MAX_KNOWN:
                    yield rows(counts)
                    counts = {}
        yield rows(counts)

    return docs.mapInArrow(run, "lang string, word string, n long")


class Vocabulary:
    """Which words are frequent in which language, and short codes for the most frequent.

    The filter is a bitmap of bounded size: a frequent word always passes, a rare
    one that passes costs space and changes no result.
    """

    def __init__(self, head: np.ndarray, bits: int, slots: np.ndarray, filled: np.ndarray):
        self.head = np.concatenate([np.zeros(1, np.uint64), head.astype(np.uint64), np.zeros(TAIL - len(head), np.uint64)])
        self.short = {int(c): i + 1 for i, c in enumerate(head)}
        self.bits, self.filled = bits, np.zeros(max(1, bits // 64), np.uint64)
        self.filled[slots] = filled

    def frequent(self, lang: bytes, word: bytes) -> bool:
        slot = xxhash.xxh64_intdigest(lang + b"\x00" + word, 42) & (self.bits - 1)
        return bool(int(self.filled[slot >> 6]) >> (slot & 63) & 1)


def _vocabulary(words: DataFrame, total: int) -> Vocabulary:
    bits = 1 << min(MAX_FILTER_BITS.bit_length() - 1, max(10, (16 * total).bit_length()))
    slot = F.xxhash64(F.concat_ws("\0", "lang", "word")).bitwiseAND(F.lit(bits - 1))
    held = words.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("filled")).toArrow()
    head = words.orderBy(F.desc("n"), "code").select("code").limit(HEAD_WORDS).toArrow()["code"].to_numpy()
    return Vocabulary(np.unique(head.view(np.uint64)), bits, held["at"].to_numpy(), held["filled"].to_numpy().view(np.uint64))


class _Local(dict):
    """Words of one language as small numbers; 0 for marks and rare words."""

    def __init__(self, lang: str, vocabulary: Vocabulary):
        super().__init__({MARK: 0})
        self.lang, self.vocabulary = lang.encode("utf-8", "replace"), vocabulary
        self.code, self.short = [0], [0]

    def __missing__(self, word: bytes) -> int:
        number = 0
        if self.vocabulary.frequent(self.lang, word):
            number, code = len(self.code), code_of(word)
            self.code.append(code)
            self.short.append(self.vocabulary.short.get(code, TAIL))
        self[word] = number
        return number


def _encoded(docs: DataFrame, vocabulary: Broadcast) -> DataFrame:
    """Stretches of frequent words, as (lang, starts, short codes, codes of the others).

    A break stands where a piece, a text or a stretch of frequent words ends.
    ``starts`` words of a row begin windows; up to three more only end them.
    """

    def rows(lang: str, known: _Local, texts: list[np.ndarray]) -> Iterator[tuple]:
        x = np.concatenate(texts)
        word = x > 0
        beside = np.r_[word[1:], False] | np.r_[False, word[:-1]]
        kept = word & beside  # a word alone begins no phrase
        kept |= ~word & np.r_[kept[1:], False]
        x = x[kept]
        code, short = np.array(known.code, np.uint64), np.array(known.short, np.uint16)
        for i in range(0, len(x), ROW_WORDS):
            part = x[i:i + ROW_WORDS + DEPTH - 1]
            wire = short[part]
            yield lang, min(ROW_WORDS, len(x) - i), wire.tobytes(), code[part[wire == TAIL]].tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, _Local] = {}
        for batch in batches:
            texts: dict[str, list] = {}
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"]):
                if lang not in known:
                    known[lang] = _Local(lang, vocabulary.value)
                found = pieces(text.as_py())
                number = np.fromiter(map(known[lang].__getitem__, found), np.int32, len(found))
                texts.setdefault(lang, []).extend([np.zeros(1, np.int32), number])
            out = [row for lang, held in texts.items() for row in rows(lang, known[lang], held)]
            columns = list(zip(*out)) if out else [()] * 4
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.binary(), pa.binary()))],
                                  ["lang", "starts", "short", "tail"])
            if sum(map(len, known.values())) > MAX_KNOWN:
                known = {}

    return docs.mapInArrow(run, "lang string, starts int, short binary, tail binary")


# ---- windows: suffixes cut at the greatest depth ----------------------------------------------------

def _mixed(value: np.ndarray) -> np.ndarray:
    value = (value ^ (value >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    value = (value ^ (value >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return value ^ (value >> np.uint64(31))


def prefix_hashes(lang: str, words: list[np.ndarray]) -> list[np.ndarray]:
    """Hash of each prefix of the given word columns within a language, shortest first."""
    out, h = [], np.uint64(xxhash.xxh64_intdigest(lang.encode("utf-8", "replace"), 7))
    for column in words:
        h = _mixed((column ^ h) + np.uint64(0x9E3779B97F4A7C15))
        out.append(h)
    return out


def _codes(vocabulary: Vocabulary, short: bytes, tail: bytes) -> np.ndarray:
    wire = np.frombuffer(short, np.uint16)
    code = vocabulary.head[wire]
    code[wire == TAIL] = np.frombuffer(tail, np.uint64)
    return code


def _chunks(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(language, codes, which of them begin a window), some ``CHUNK_WORDS`` at a time."""
    held: dict[str, list] = {}
    size: Counter = Counter()

    def chunk(lang: str):
        codes, begins = zip(*held.pop(lang))
        size.pop(lang)
        return lang, np.concatenate(codes), np.concatenate(begins)

    for batch in batches:
        for lang, starts, short, tail in zip(*(batch[c].to_pylist() for c in ("lang", "starts", "short", "tail"))):
            code = np.r_[_codes(vocabulary, short, tail), np.uint64(0)]
            held.setdefault(lang, []).append((code, np.arange(len(code)) < starts))
            size[lang] += len(code)
            if size[lang] >= CHUNK_WORDS:
                yield chunk(lang)
    yield from map(chunk, list(held))


def windows(code: np.ndarray, begins: np.ndarray) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Distinct windows of two to four words, as columns of codes (0: none), with their counts, in order."""
    names, number = np.unique(np.r_[np.uint64(0), code], return_inverse=True)
    if len(names) > TAIL:  # too many words to pack a window into 64 bits
        half = len(code) // 2
        yield from windows(code[:half + DEPTH - 1], np.r_[begins[:half], np.zeros(min(DEPTH - 1, len(code) - half), bool)])
        yield from windows(code[half:], begins[half:])
        return
    n = len(code)
    padded = np.r_[number[1:].astype(np.uint64), np.zeros(DEPTH, np.uint64)]
    packed, alive = np.zeros(n, np.uint64), np.ones(n, bool)
    for j in range(DEPTH):
        alive &= padded[j:n + j] > 0
        packed = packed << np.uint64(16) | np.where(alive, padded[j:n + j], np.uint64(0))
    packed = packed[begins & (packed >> np.uint64(32) & np.uint64(0xFFFF) > 0)]
    distinct, counts = np.unique(packed, return_counts=True)
    yield [names[(distinct >> np.uint64(16 * (DEPTH - 1 - j)) & np.uint64(0xFFFF)).astype(np.int64)] for j in range(DEPTH)], counts


def _grams(lang: str, words: list[np.ndarray], n: np.ndarray) -> pa.RecordBatch:
    columns = [*words, *[np.zeros(len(n), np.uint64)] * (DEPTH - len(words))]
    return pa.record_batch([pa.array([lang] * len(n), pa.string()), *(pa.array(c.view(np.int64)) for c in columns),
                            pa.array(n.astype(np.int64))], ["lang", "w1", "w2", "w3", "w4", "n"])


# ---- vertical partitioning --------------------------------------------------------------------------

def _extended(encoded: DataFrame, vocabulary: Broadcast, heavy: list[np.ndarray]) -> DataFrame:
    """Counts of the prefixes one word longer than the heavy ones of the last depth."""
    depth = len(heavy) + 1
    last = heavy[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, code, begins in _chunks(batches, vocabulary.value):
            for words, counts in windows(code, begins):
                wanted = np.isin(prefix_hashes(lang, words[:depth - 1])[-1], last) & (words[depth - 1] > 0)
                own, counts = [w[wanted] for w in words[:depth]], counts[wanted]
                if len(counts):  # windows are in order, so equal prefixes are neighbours
                    new = np.flatnonzero(np.r_[True, np.any([w[1:] != w[:-1] for w in own], axis=0)])
                    yield _grams(lang, [w[new] for w in own], np.add.reduceat(counts, new))

    counted = encoded.mapInArrow(run, GRAMS).groupBy("lang", "w1", "w2", "w3", "w4").agg(F.sum("n").alias("n"))
    return materialize(counted, f"prefixes-{depth}")


def _hashes(rows: pa.Table | pa.RecordBatch, depth: int) -> np.ndarray:
    """Hash of the prefix in each row."""
    out = np.zeros(rows.num_rows, np.uint64)
    langs = np.array(rows["lang"].to_pylist(), object)
    words = [rows[f"w{j + 1}"].to_numpy().view(np.uint64) for j in range(depth)]
    for lang in set(langs):
        here = langs == lang
        out[here] = prefix_hashes(lang, [w[here] for w in words])[-1]
    return out


def _heavy(prefixes: DataFrame, depth: int, budget: int) -> np.ndarray:
    """Hashes of the prefixes of more windows than a group may hold; ``budget`` bounds their number."""
    return np.unique(_hashes(prefixes.where(F.col("n") > budget).toArrow(), depth))


def _cell_loads(prefixes: DataFrame, depth: int, budget: int, cells: int) -> DataFrame:
    """(cell, windows) of the prefixes that fit a group; a cell is a range of prefix hashes."""
    shift = np.uint64(64 - (cells.bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = (_hashes(batch, depth) >> shift).astype(np.int64)
            yield pa.record_batch([pa.array(cell), batch["n"]], ["cell", "n"])

    return prefixes.where(F.col("n") <= budget).select("lang", "w1", "w2", "w3", "w4", "n").mapInArrow(run, "cell long, n long")


def group_cells(loads: np.ndarray, budget: int) -> np.ndarray:
    """Group of each cell: the largest cell left opens a group, smaller ones fill it up to the budget."""
    order = np.argsort(-loads, kind="stable")
    group = np.zeros(len(loads), np.int32)
    low, high, number = 0, len(loads) - 1, 0
    while low <= high:
        group[order[low]], room = number, budget - loads[order[low]]
        low += 1
        while low <= high and loads[order[high]] <= room:
            group[order[high]] = number
            room -= loads[order[high]]
            high -= 1
        number += 1
    return group


def _dealt(encoded: DataFrame, vocabulary: Broadcast, plan: Broadcast) -> DataFrame:
    """Every window, counted within its chunk, with the group of its shortest prefix that is not heavy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, groups, cells = plan.value
        shift = np.uint64(64 - (cells.bit_length() - 1))
        short = vocabulary.value.short
        for lang, code, begins in _chunks(batches, vocabulary.value):
            for words, counts in windows(code, begins):
                hashes = prefix_hashes(lang, words)
                owner, undecided = hashes[0].copy(), np.ones(len(counts), bool)
                for depth in range(1, DEPTH):
                    known = heavy[depth - 1] if depth <= len(heavy) else np.zeros(0, np.uint64)
                    undecided &= np.isin(hashes[depth - 1], known)
                    owner[undecided] = hashes[depth][undecided]
                    # A window that ends with its heavy prefix adds to no node below it.
                    ended = undecided & (words[depth] == 0)
                    owner[ended], undecided[ended] = 0, False
                    counts = np.where(ended, 0, counts)
                counts = np.where(undecided, 0, counts)  # whole windows below three heavy words are counted already
                kept = counts > 0
                own, counts, group = [w[kept] for w in words], counts[kept], groups[(owner[kept] >> shift).astype(np.int64)]
                order = np.argsort(group, kind="stable")
                own, counts, group = [w[order] for w in own], counts[order], group[order]
                names, number = np.unique(np.concatenate(own), return_inverse=True)
                wire = np.array([short.get(int(c), TAIL) if c else 0 for c in names], np.uint16)[number].reshape(DEPTH, -1)
                edges = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True]) if len(group) else np.zeros(1, int)
                out = []
                for a, b in zip(edges[:-1], edges[1:]):
                    codes, part = np.concatenate([w[a:b] for w in own]), np.ascontiguousarray(wire[:, a:b])
                    out.append((int(group[a]), lang, part.tobytes(), codes[part.ravel() == TAIL].tobytes(), counts[a:b].astype(np.uint32).tobytes()))
                columns = list(zip(*out)) if out else [()] * 5
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.string(), *[pa.binary()] * 3))],
                                      ["part", "lang", "short", "tail", "counts"])

    return encoded.mapInArrow(run, "part int, lang string, short binary, tail binary, counts binary")


# ---- one group: its subtrees ------------------------------------------------------------------------

def subtree_nodes(words: list[np.ndarray], counts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(depth, row of each node, its total) of the tree of the given windows, from two words down.

    Sorted windows are the leaves in order; a node is a stretch of leaves with a
    common prefix, and its count the total of theirs.
    """
    names, number = np.unique(np.concatenate(words), return_inverse=True)
    w1, w2, w3, w4 = number.reshape(DEPTH, -1).astype(np.uint64)
    front, back = w1 << np.uint64(32) | w2, w3 << np.uint64(32) | w4
    order = np.lexsort((back, front))
    changed, counts = np.r_[True, front[order][1:] != front[order][:-1]], counts[order]
    for depth, column in ((2, None), (3, w3), (4, w4)):
        if column is not None:
            changed = changed | np.r_[True, column[order][1:] != column[order][:-1]]
        starts = np.flatnonzero(changed)
        totals = np.add.reduceat(counts, starts)
        there = words[depth - 1][order[starts]] > 0
        yield depth, order[starts[there]], totals[there]


def _counted(dealt: DataFrame, vocabulary: Broadcast, plan: Broadcast, least: int) -> DataFrame:
    """Frequent phrases of every group, from the totals of its subtrees."""

    def run(table: pa.Table) -> pa.Table:
        heavy, out = plan.value[0], []
        langs = table["lang"].to_pylist()
        for lang in sorted(set(langs)):
            own = table.filter(pa.array([x == lang for x in langs]))
            blocks = [_codes(vocabulary.value, s, t).reshape(DEPTH, -1) for s, t in zip(own["short"].to_pylist(), own["tail"].to_pylist())]
            words = list(np.concatenate(blocks, axis=1))
            counts = np.frombuffer(b"".join(own["counts"].to_pylist()), np.uint32).astype(np.int64)
            for depth, rows, totals in subtree_nodes(words, counts):
                rows, totals = rows[totals >= least], totals[totals >= least]
                node = [w[rows] for w in words[:depth]]
                if depth <= len(heavy):  # leaves of a heavy node lie in several groups; its total is known
                    light = ~np.isin(prefix_hashes(lang, node)[-1], heavy[depth - 1])
                    node, totals = [w[light] for w in node], totals[light]
                out.append(_grams(lang, node, totals))
        return pa.Table.from_batches(out)

    return dealt.groupBy("part").applyInArrow(run, GRAMS)


# ---- scores -----------------------------------------------------------------------------------------

def _scored(grams: DataFrame) -> DataFrame:
    """Candidates with the counts and score of their weakest cut."""
    phrases = grams.where(F.size("gram") > 1)
    cuts = F.transform(F.sequence(F.lit(1), F.size("gram") - 1), lambda k: F.array(
        F.struct(k.alias("k"), F.lit(0).alias("side"), F.slice("gram", F.lit(1), k).alias("part")),
        F.struct(k.alias("k"), F.lit(1).alias("side"), F.slice("gram", k + 1, F.size("gram") - k).alias("part"))))
    wanted = phrases.select("lang", "gram", F.col("n").alias("a"), F.explode(F.flatten(cuts)).alias("cut")).select(
        "lang", "gram", "a", "cut.k", "cut.side", "cut.part")
    known = grams.select("lang", F.col("gram").alias("part"), "n")

    def count(k: int, side: int) -> F.Column:
        return F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("n"))).alias(f"c{k}{side}")

    each = wanted.join(known, ["lang", "part"]).groupBy("lang", "gram", "a").agg(
        *(count(k, side) for k in range(1, DEPTH) for side in (0, 1)))
    # Exact beyond 64 bits: the product is a decimal, the quotient whole.
    options = [F.when(F.col(f"c{k}0").isNotNull(), F.struct(
        F.expr(f"cast(2000000 as decimal(38,0)) * cast(a as decimal(19,0)) div cast(c{k}0 + c{k}1 as decimal(38,0))").alias("score"),
        F.lit(k).alias("k"), F.col(f"c{k}0").alias("l"), F.col(f"c{k}1").alias("r"))) for k in range(1, DEPTH)]
    weakest = F.array_min(F.filter(F.array(*options), lambda o: o.isNotNull()))
    return each.select("lang", "gram", "a", weakest.alias("cut")).select("lang", "gram", "a", "cut.score", "cut.l", "cut.r")


def _covered(grams: DataFrame) -> DataFrame:
    """(lang, gram, longest): the largest count of a longer phrase around each phrase."""
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("gram") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.size("gram") - m + 1), lambda i: F.slice("gram", i, m))))
    longer = grams.where(F.size("gram") > 2).select("lang", "n", F.explode(inner).alias("gram"))
    return longer.groupBy("lang", "gram").agg(F.max("n").alias("longest"))


def _spelled(found: DataFrame, words: DataFrame) -> DataFrame:
    """Phrases as text, their words joined by one space."""
    each = found.select("lang", "gram", F.posexplode("gram").alias("at", "code"))
    named = each.join(words.select("lang", "code", "word"), ["lang", "code"])
    phrases = named.groupBy("lang", "gram").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    return found.join(phrases, ["lang", "gram"])


def collocations(
    docs: DataFrame, *, top: int = 2000, min_count: int = 30, budget: int = GROUP_WINDOWS, text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """The ``top`` phrases of two to four words of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased in A-Z, cut into pieces at ``.,;:!?`` and line breaks and
    into words at blanks; a phrase is counted wherever its words follow each other
    within a piece. Candidates occur ``min_count`` times; the score of a cut is
    2,000,000 * a / (l + r), rounded down, and the lowest cut counts. A candidate within
    a longer one that is at least 80 % as frequent goes. Counts are per language,
    exact and over all texts; words are told apart by 64-bit hashes.

    1. Words are counted; each language's total and frequent words are kept, and the
       texts are written as stretches of codes of frequent words.
    2. Vertical partitioning: a word prefix with more windows than ``budget`` is
       extended by a word, counted, and so on. Prefixes within the budget are put
       together into groups of about that many windows.
    3. Each group alone sorts its windows, which are suffixes cut after four words,
       into subtrees and reads the counts of their nodes from the totals of leaves.
    4. Joins of the frequent phrases give scores and containment.

    ``budget`` grows to a millionth of all words at least, which bounds the table
    of heavy prefixes. Null text counts as empty, a null language as ``und``.
    Repeated rows count each time; empty texts add nothing; an empty table gives an
    empty result. A language without candidates has no row. Other columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    counted = materialize(_word_counts(texts).groupBy("lang", "word").agg(F.sum("n").alias("n"))
                          .where(F.col("word").isNull() | (F.col("n") >= min_count)), "words")
    words = counted.where("word IS NOT NULL").select("lang", "word", F.xxhash64("word").alias("code"), "n")
    totals = counted.where("word IS NULL").select("lang", F.col("n").alias("total"))
    size = words.agg(F.count(F.lit(1)).alias("words"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    budget = max(budget, size["n"] // MAX_HEAVY)
    vocabulary = spark.sparkContext.broadcast(_vocabulary(words, size["words"]))
    encoded = materialize(_encoded(texts, vocabulary), "encoded")

    none = [F.lit(0).cast("long").alias(f"w{j}") for j in range(2, DEPTH + 1)]
    by_depth = [words.select("lang", F.col("code").alias("w1"), *none, "n")]
    heavy = [_heavy(by_depth[0], 1, budget)]
    while len(heavy[-1]) and len(by_depth) < DEPTH:
        by_depth.append(_extended(encoded, vocabulary, heavy))
        heavy.append(_heavy(by_depth[-1], len(by_depth), budget) if len(by_depth) < DEPTH else np.zeros(0, np.uint64))
    cells = 1 << min(MAX_CELLS.bit_length() - 1, max(10, (4 * size["n"] // budget).bit_length()))
    light = by_depth[:DEPTH - 1]
    loads = _cell_loads(light[0], 1, budget, cells)
    for depth, prefixes in enumerate(light[1:], 2):
        loads = loads.unionByName(_cell_loads(prefixes, depth, budget, cells))
    held = loads.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    load = np.zeros(cells, np.int64)
    load[held["cell"].to_numpy()] = held["n"].to_numpy()
    plan = spark.sparkContext.broadcast((heavy[:DEPTH - 1], group_cells(load, budget), cells))
    nodes = _counted(_dealt(encoded, vocabulary, plan), vocabulary, plan, min_count)
    for depth, prefixes in enumerate(by_depth[1:], 2):
        # Heavy prefixes have their counts from here; so have whole windows below heavy ones.
        nodes = nodes.unionByName(prefixes.where(F.col("n") > (budget if depth < DEPTH else 0)).where(F.col("n") >= min_count))
    filled = F.filter(F.array("w1", "w2", "w3", "w4"), lambda w: w != 0)
    grams = materialize(nodes.unionByName(by_depth[0]).select("lang", filled.alias("gram"), "n"), "grams")

    kept = _scored(grams).join(_covered(grams), ["lang", "gram"], "left").where(
        "longest IS NULL OR cast(100 as decimal(38,0)) * longest < cast(80 as decimal(38,0)) * a")
    # The first of each salt, then the first of all: no task holds a language's candidates.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = _spelled(materialize(kept.drop("longest"), "kept"), words).withColumn("_salt", F.pmod(F.xxhash64("gram"), F.lit(SALTS)))
    first = salted.withColumn("_place", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_place") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
