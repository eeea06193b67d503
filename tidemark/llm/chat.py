"""Chat formatting with loss masks aligned to token offsets."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)
CONVERSATIONS_PER_CALL = 128

FORMATTED = ("conv_id long, n_turns long, formatted string, ids array<int>, starts array<int>, ends array<int>, "
             "loss_mask array<boolean>, loss_starts array<int>, loss_ends array<int>")


def escape(text: str) -> str:
    """One more backslash between ``<`` and ``|``: no control string survives in a text."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def escape_role(role: str) -> str:
    """A role stays on its line."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The whole conversation and the span of each turn's text in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END + "\n"]
        at = spans[-1][1] + len(END) + 1
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """Read the turns back; the inverse of ``render``."""
    turns, at = [], 0
    for m in TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError(f"no turn at character {at}")
        turns.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"text left over at character {at}")
    return turns


def align(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, list, list]:
    """Token mask and character intervals of the tokens inside ``spans``.

    Both lists are sorted, so each span finds its tokens by binary search.
    A token that reaches over a span's edge counts, cut at the edge; tokens that
    share a character (parts of one code point) give it once.
    """
    mask, lo, hi = np.zeros(len(starts), bool), [], []
    for s, e in spans:
        first, last = np.searchsorted(ends, s, "right"), np.searchsorted(starts, e, "left")
        if first >= last:
            continue
        mask[first:last] = True
        a, b = np.maximum(starts[first:last], s), np.minimum(ends[first:last], e)
        reach = np.maximum.accumulate(b)
        cut = np.flatnonzero(np.r_[True, a[1:] > reach[:-1]])
        lo += a[cut].tolist()
        hi += reach[np.r_[cut[1:] - 1, len(a) - 1]].tolist()
    return mask, lo, hi


def _tokenizer(path: str):
    from tokenizers import AddedToken, Tokenizer, processors

    tok = Tokenizer.from_file(path)
    tok.post_processor = processors.ByteLevel(trim_offsets=False)
    tok.add_special_tokens([AddedToken(s, special=True, normalized=False) for s in (START, END)])
    return tok


def format_conversations(turns: DataFrame, tokenizer_path: str, *, trained_role: str = "assistant") -> DataFrame:
    """One row per conversation, columns of ``FORMATTED``.

    ``turns`` has conv_id, turn, role, text. Rows are ordered by turn, then role
    and text, nulls first; null role and text are empty, and null conv_id is a
    conversation of its own. Each conversation is rendered whole, encoded once
    with offsets, and its ``trained_role`` spans are cut against the tokens.
    Repeated rows stay. An empty table gives no row; other columns are ignored.

    A conversation is the unit of encoding: a task holds one batch of
    conversations, however many its partition has.
    """
    rows = turns.select(
        F.col("conv_id").cast("long"), "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"))
    placed = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")
    to = pa.schema([
        ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("ids", pa.list_(pa.int32())),
        ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("loss_mask", pa.list_(pa.bool_())),
        ("loss_starts", pa.list_(pa.int32())), ("loss_ends", pa.list_(pa.int32()))])

    def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[tuple[str, str]]]]:
        current, held = None, []
        for batch in batches:
            for conv, role, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "role", "text"))):
                if held and conv != current:
                    yield current, held
                    held = []
                current = conv
                held.append((role, text))
        if held:
            yield current, held

    def encode(tok, group: list) -> pa.RecordBatch:
        rendered = [render(turns) for _, turns in group]
        found = []
        for (conv, own), (text, spans), enc in zip(
                group, rendered, tok.encode_batch([t for t, _ in rendered], add_special_tokens=False)):
            at = np.array(enc.offsets, np.int64).reshape(-1, 2)
            trained = [s for s, (role, _) in zip(spans, own) if role == trained_role]
            mask, lo, hi = align(at[:, 0], at[:, 1], trained)
            found.append({
                "conv_id": conv, "n_turns": len(own), "formatted": text, "ids": enc.ids, "starts": at[:, 0].tolist(),
                "ends": at[:, 1].tolist(), "loss_mask": mask.tolist(), "loss_starts": lo, "loss_ends": hi})
        return pa.RecordBatch.from_pylist(found, to)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, group, size = None, [], 0
        for conversation in conversations(batches):
            tok = tok or _tokenizer(tokenizer_path)
            group.append(conversation)
            size += sum(len(t) for _, t in conversation[1])
            if len(group) == CONVERSATIONS_PER_CALL or size > 1_000_000:
                yield encode(tok, group)
                group, size = [], 0
        if group:
            yield encode(tok, group)

    return placed.mapInArrow(run, FORMATTED)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted text and the loss mask say, per conversation."""
    to = pa.schema([
        ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                turns, text = parse(r["formatted"]), r["formatted"]
                said = "".join(f"{role}\n{body}\n" for role, body in turns)
                loss = "".join(unescape(text[a:b]) for a, b in zip(r["loss_starts"], r["loss_ends"]))
                found.append({
                    "conv_id": r["conv_id"], "n_turns": len(turns),
                    "turns_sha256": hashlib.sha256(said.encode()).hexdigest(), "loss_chars": len(loss),
                    "loss_sha256": hashlib.sha256(loss.encode()).hexdigest(), "formatted_chars": len(text)})
            yield pa.RecordBatch.from_pylist(found, to)

    return formatted.select("conv_id", "formatted", "loss_starts", "loss_ends").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
