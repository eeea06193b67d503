"""Byte-level BPE: encoding by a lazily determinised transducer, streaming decoding."""

from __future__ import annotations

import base64
import itertools
import re
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Recent, in_slices, split_words

MAX_STATES = 150_000
MAX_PAIRS = 400_000
MAX_CACHED = 250_000
SLICE_BYTES = 8_000_000
MARKS = ".,;:!?"
NEVER = 1 << 60


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Merges:
    """What the ranks say about tokens next to each other.

    Merging is by lowest rank first, leftmost on a tie. A text's encoding is the
    one sequence of tokens whose concatenation is the text and in which no merge
    ever crosses the border between neighbours. Whether one crosses depends on
    the two neighbours alone.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self._sides: dict[bytes, tuple] = {}
        self._meets: dict[tuple[bytes, bytes], bool] = {}

    def merge(self, piece: bytes, stop: int = 1) -> list[bytes]:
        """Parts of ``piece`` by plain merging, until ``stop`` parts are left."""
        parts = [piece[i:i + 1] for i in range(len(piece))]
        while len(parts) > stop:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
            if rank == NEVER:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def sides(self, token: bytes) -> tuple | None:
        """(left edge, right edge) of a token's merge history; None if merging never makes it.

        An edge lists the pieces that touch that end: (piece, born, merged away).
        """
        found = self._sides.get(token, 0)
        if found == 0:
            found = self._sides[token] = self._history(token)
        return found

    def _history(self, token: bytes) -> tuple | None:
        if len(token) == 1:
            edge = [(token, -1, NEVER)]
            return edge, edge
        parts = self.merge(token, 2)
        if len(parts) != 2:
            return None
        left, right = self.sides(parts[0]), self.sides(parts[1])
        if left is None or right is None:
            return None
        born = self.ranks[token]

        def grown(edge):
            return [(token, born, NEVER), (*edge[0][:2], born), *edge[1:]]

        return grown(left[0]), grown(right[1])

    def separate(self, a: bytes, b: bytes) -> bool:
        """No merge crosses the border between ``a`` and ``b``."""
        found = self._meets.get((a, b))
        if found is None:
            if len(self._meets) > MAX_PAIRS:
                self._meets.clear()
            found = self._meets[a, b] = not self._crossed(self.sides(a)[1], self.sides(b)[0])
        return found

    def _crossed(self, right_edge: list, left_edge: list) -> bool:
        """At equal rank the merge further left goes first: the left piece's own
        before this one, this one before the right piece's."""
        rank_of = self.ranks.get
        for left, born_l, gone_l in right_edge:
            for right, born_r, gone_r in left_edge:
                rank = rank_of(left + right)
                if rank is not None and rank < gone_l and rank <= gone_r and born_r < gone_l and born_l < gone_r:
                    return True
        return False


class Transducer:
    """Reads bytes; every step says which token ends there and what stays open.

    A reading is (last whole token, part of the next token). A state of the
    determinised machine is the set of readings still possible after a prefix;
    states and steps are made when a text first needs them. The encoding of
    each prefix is unique, so one reading at most completes a token on a byte.
    A reading dies at the latest when its open part outgrows the longest token,
    which bounds how far back the borders of open readings lie: what precedes
    the last border that all of them share is written.
    """

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.merges, self.max_states = Merges(ranks), max_states
        self.length = {rank: len(token) for token, rank in ranks.items()}
        self.inner = {token[:n] for token in ranks for n in range(1, len(token))}
        self.lookahead = max(map(len, ranks))
        self._reset()

    def _reset(self) -> None:
        start = ((b"", b""),)
        self.ids, self.states, self.steps, self.ends = {start: 0}, [start], {}, {}

    def _end(self, at: int, byte: int) -> int:
        """The token that ends with a piece's last byte; what would stay open after it is not worked out."""
        key = at << 8 | byte
        token = self.ends.get(key)
        if token is None:
            letter, merges = bytes((byte,)), self.merges
            for last, part in self.states[at]:
                rank = merges.ranks.get(part + letter)
                if rank is not None and merges.sides(part + letter) and (not last or merges.separate(last, part + letter)):
                    token = self.ends[key] = rank
                    break
        return token

    def _step(self, at: int, byte: int) -> tuple[int, int]:
        readings, letter, done = [], bytes((byte,)), None
        inner, merges, ranks = self.inner, self.merges, self.merges.ranks
        for last, part in self.states[at]:
            longer = part + letter
            if longer in inner:
                readings.append((last, longer))
            if done is None and longer in ranks and merges.sides(longer) and (not last or merges.separate(last, longer)):
                done = longer
        readings.append((done, b""))
        state = tuple(readings)
        number = self.ids.get(state)
        if number is None:
            number = self.ids[state] = len(self.states)
            self.states.append(state)
        step = self.steps[at << 8 | byte] = ranks[done], number
        return step

    def _back(self, ends: list[int], i: int, base: int) -> list[int]:
        """Tokens of the prefix of length ``i``, walking back to ``base``."""
        out = []
        while i > base:
            token = ends[i - 1 - base]
            out.append(token)
            i -= self.length[token]
        out.reverse()
        return out

    def _shared_border(self, ends: list[int], at: int, n: int, base: int) -> int:
        """Last border that every open reading's tokens pass through."""
        def borders(i):
            found = {i}
            while i > base:
                i -= self.length[ends[i - 1 - base]]
                found.add(i)
            return found

        return max(set.intersection(*(borders(n - len(part)) for _, part in self.states[at])))

    def encode(self, piece: bytes) -> list[int]:
        """Token ids of one pre-split piece."""
        if len(self.states) > self.max_states:
            self._reset()
        out, ends, at, base, steps, step_of = [], [], 0, 0, self.steps, self._step
        flush, inside = 8 * self.lookahead, len(piece) - 1
        for i in range(0, inside, flush):
            if len(ends) > flush:
                border = self._shared_border(ends, at, i, base)
                out += self._back(ends, border, base)
                del ends[:border - base]
                base = border
            for byte in piece[i:min(i + flush, inside)]:
                token, at = steps.get(at << 8 | byte) or step_of(at, byte)
                ends.append(token)
        ends.append(self._end(at, piece[inside]))
        return out + self._back(ends, len(piece), base)


class Encoder:
    """Whole texts to ids: pattern, transducer, and bounded caches of frequent chunks.

    A text may be cut before a space between two other characters that are not
    white space: no match of the pattern reaches over that place.
    """

    NEAR_SPACE = re.compile(r" \s|\s ")
    CUT = re.compile(r"(?<=\S)(?= \S)")

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.machine = ranks, Transducer(ranks)
        self.find = regex.compile(pattern).findall
        self.pieces = Recent(self._piece, MAX_CACHED)

    def _piece(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode()
        whole = self.ranks.get(raw)
        return (whole,) if whole is not None else tuple(self.machine.encode(raw))

    def chunk(self, chunk: str) -> tuple[int, ...]:
        """Ids of a chunk."""
        return tuple(itertools.chain.from_iterable(map(self.pieces.__getitem__, self.find(chunk))))

    def chunks(self, text: str) -> tuple[list[str], list[str]]:
        """Chunks that are encoded each by itself: some as they are, then some without the space before them."""
        if self.NEAR_SPACE.search(text):
            return [p for p in self.CUT.split(text) if p], []
        head, *rest = text.split(" ")
        return [head] if head else [], rest

    def encode(self, text: str) -> list[int]:
        whole, spaced = self.chunks(text)
        return list(itertools.chain.from_iterable(map(self.chunk, [*whole, *map(" ".__add__, spaced)])))


class Utf8Machine:
    """Incremental UTF-8: a state is the bytes of an unfinished code point.

    ``feed`` is memoised per (state, token), so a stream costs one lookup a
    token. Bytes that cannot continue a code point become U+FFFD.
    """

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of = bytes_of
        self.whole = {}
        for i, token in bytes_of.items():
            text, rest = self._read(b"", token)
            self.whole[i] = text if not rest and "�" not in text else None
        self.memo: dict[tuple[bytes, int], tuple[str, bytes]] = {}

    @staticmethod
    def _range(pending: bytes) -> tuple[int, int]:
        """Bytes that may come after ``pending``."""
        if len(pending) == 1:
            return {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(
                pending[0], (0x80, 0xBF))
        return 0x80, 0xBF

    @staticmethod
    def _length(lead: int) -> int:
        return 1 if lead < 0x80 else 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 0

    def _read(self, pending: bytes, data: bytes) -> tuple[str, bytes]:
        out = []
        for byte in data:
            if pending:
                low, high = self._range(pending)
                if low <= byte <= high:
                    pending += bytes((byte,))
                    if len(pending) == self._length(pending[0]):
                        out.append(pending.decode())
                        pending = b""
                    continue
                out.append("�")
                pending = b""
            need = self._length(byte)
            if need == 1:
                out.append(chr(byte))
            elif need:
                pending = bytes((byte,))
            else:
                out.append("�")
        return "".join(out), pending

    def feed(self, pending: bytes, token: int) -> tuple[str, bytes]:
        found = self.memo.get((pending, token))
        if found is None:
            if len(self.memo) > MAX_CACHED:
                self.memo.clear()
            found = self.memo[pending, token] = self._read(pending, self.bytes_of[token])
        return found

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as it becomes complete, one piece a token."""
        pending = b""
        for token in ids:
            text, pending = self.feed(pending, token)
            yield text
        if pending:
            yield "�"

    def decode(self, ids: Sequence[int]) -> str:
        """The stream's text. Runs of tokens that are whole by themselves are joined at once;
        the machine steps through the others until no code point is open."""
        whole = [self.whole[i] for i in ids]
        if None not in whole:
            return "".join(whole)
        out, at, n = [], 0, len(ids)
        pending = b""
        while at < n:
            try:
                stop = whole.index(None, at)
            except ValueError:
                stop = n
            out += whole[at:stop]
            at, pending = stop, b""
            while at < n and (pending or whole[at] is None):
                text, pending = self.feed(pending, ids[at])
                out.append(text)
                at += 1
        if pending:
            out.append("�")
        return "".join(out)


class Codec:
    """Encoder and decoder, and what they say of each distinct chunk.

    A chunk is whole code points, so the decoder is at rest where one ends: a text's
    ids, and what they decode to, are those of its chunks, one after another. A word
    of letters alone is one piece, and so is the mark after it.
    """

    def __init__(self, path: str, pattern: str):
        ranks = load_ranks(path)
        self.encoder, self.machine = Encoder(ranks, pattern), Utf8Machine({i: t for t, i in ranks.items()})
        self.letters = self.encoder.find(" a\u00e9\u00df") == [" a\u00e9\u00df"] and self.encoder.find(" a,") == [" a", ","]
        self.marks = {m: self._said(self.encoder.chunk(m)) for m in MARKS}
        self.said = Recent(lambda chunk: self._said(self.encoder.chunk(chunk)), MAX_CACHED)
        self.spaced = Recent(self._spaced, MAX_CACHED)

    def _said(self, ids: Sequence[int]) -> tuple[int, str, str]:
        """Number of ids, the ids as decimal text, and the text they decode to."""
        return len(ids), " ".join(map(str, ids)), self.machine.decode(ids)

    def _spaced(self, word: str) -> tuple[int, str, str]:
        """The same for a word after one blank, which the decoded text leaves out."""
        if self.letters and word.isalpha():
            raw = b" " + word.encode()
            whole = self.encoder.ranks.get(raw)
            n, ids, text = self._said((whole,) if whole is not None else self.encoder.machine.encode(raw))
        elif self.letters and word[-1:] in self.marks and word[:-1].isalpha():
            n, ids, text = self.spaced[word[:-1]]
            more, id, mark = self.marks[word[-1]]
            return n + more, f"{ids} {id}", text + mark
        else:
            n, ids, text = self._said(self.encoder.chunk(" " + word))
        return n, ids, word if text[1:] == word else text[1:]

    def round_trip(self, text: str) -> tuple[int, str, str]:
        """Number of ids, ids and decoded text of a whole text."""
        whole, spaced = self.encoder.chunks(text)
        found = [self.said[c] for c in whole]
        after = [self.spaced[w] for w in spaced]
        decoded = "".join([f[2] for f in found]) + "".join([" " + f[2] for f in after])
        found += after
        return sum([f[0] for f in found]), " ".join([f[1] for f in found]), decoded

    def round_trips(self, texts: pa.Array) -> Iterator[tuple[int, object, object]]:
        """The same for many texts, their words numbered together; ids and decoded text as UTF-8 buffers."""
        for part in in_slices(texts, SLICE_BYTES):
            if len(part) == 1 or pc.any(pc.match_substring_regex(part, r"( \s)|(\s )|\x1c|\x1d|\x1e|\x1f|\x85|\p{Z} | \p{Z}")).as_py():
                for text in part:
                    n, ids, decoded = self.round_trip(text.as_py())
                    yield n, ids.encode(), decoded.encode()
                continue
            starts, number, words = split_words(part)
            heads = starts[:-1]
            first = [words[i] for i in number[heads].tolist()]
            said = [self.spaced[w] for w in words] + [self.said[w] if w else (0, "", "") for w in first]
            number = number.astype(np.int64)
            number[heads] = len(words) + np.arange(len(first))
            counts, ids, decoded = zip(*said)
            total = np.r_[0, np.cumsum(np.array(counts, np.int64)[number])]
            # An empty first part has no ids, but a blank follows it in the text.
            kept = np.ones(len(number), bool)
            kept[heads] = [bool(w) for w in first]
            places = np.r_[0, np.cumsum(kept)][starts].astype(np.int32)
            ids = pc.binary_join(pa.ListArray.from_arrays(places, pa.array(ids, pa.string()).take(pa.array(number[kept]))), " ")
            decoded = pc.binary_join(pa.ListArray.from_arrays(starts.astype(np.int32), pa.array(decoded, pa.string()).take(pa.array(number))), " ")
            for n, i, d in zip((total[starts[1:]] - total[starts[:-1]]).tolist(), ids, decoded):
                yield n, i.as_buffer(), d.as_buffer()


@lru_cache(maxsize=2)
def _codec(path: str, pattern: str) -> Codec:
    """One per Python worker."""
    return Codec(path, pattern)


def encode_column(df: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``ids``): token ids of every whole text; null and empty texts give an empty list.

    Row by row and without a shuffle; repeated rows and null ids pass through.
    """
    rows = df.select(F.col(id_col).cast("long").alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            encoder = _codec(ranks_path, pattern).encoder
            ids = pa.array([encoder.encode(t.as_py()) for t in batch["_text"]], pa.list_(pa.int32()))
            yield pa.record_batch([batch[id_col], ids], [id_col, "ids"])

    return rows.mapInArrow(run, f"{id_col} long, ids array<int>")


def decode_column(df: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id") -> DataFrame:
    """(id, ``text``) from (id, ``ids``); null ids lists give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            machine = _codec(ranks_path, pattern).machine
            texts = [None if not x.is_valid else machine.decode(x.as_py()) for x in batch["ids"]]
            yield pa.record_batch([batch[id_col], pa.array(texts, pa.string())], [id_col, "text"])

    return df.select(id_col, "ids").mapInArrow(run, f"{id_col} long, text string")


def round_trip(df: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256: encode every text, decode its ids.

    The same encoder and decoder as above in one pass, so that ids need not
    leave the worker. Null text counts as empty.
    """
    import hashlib

    rows = df.select(F.col(id_col).cast("long").alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]

    def digest(text) -> str:
        return hashlib.sha256(text).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(n, digest(said), digest(decoded)) for n, said, decoded in _codec(ranks_path, pattern).round_trips(batch["_text"])]
            n, said, decoded = zip(*found) if found else ((), (), ())
            yield pa.record_batch(
                [batch[id_col], pa.array(n, pa.int64()), pa.array(said, pa.string()), pa.array(decoded, pa.string())], names)

    return rows.mapInArrow(run, f"{id_col} long, n_tokens long, ids_sha256 string, decoded_sha256 string")
