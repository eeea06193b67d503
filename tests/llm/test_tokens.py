import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm import data
from tidemark.llm import bpe, chat, packing
from tidemark.llm.common import Recent

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "  a", "a  b", "a \n b", "\n\n\nfoo", "don't I'll 'sx", "\x1c a\x1c", "é́ñ 漢字 🙂🙂", "a" * 700,
       " " * 300 + "x", "   x 1234567 १२", "<|endoftext|>", "\u3000a\u3000 b"]


@pytest.fixture(scope="module")
def codec():
    ranks = bpe.load_ranks(RANKS)
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    both = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    return both, both.machine, reference, ranks


def test_encoding_equals_the_library(codec, monkeypatch):
    wanted = []
    both, machine, reference, ranks = codec
    rnd = random.Random(1)
    pieces = [t.decode("utf8", "ignore") for t in ranks]
    texts = ODD + ["".join(rnd.choice(pieces if rnd.random() < .5 else "aeésntr oi'.,\n 12ßü漢🙂\t") for _ in range(rnd.randint(1, 30)))
                   for _ in range(1500)]
    for text in texts:
        ids = both.encoder.encode(text)
        assert ids == reference.encode_ordinary(text)
        assert both.round_trip(text) == (len(ids), " ".join(map(str, ids)), text)
        wanted.append((len(ids), " ".join(map(str, ids)).encode(), text.encode()))
    plain = [" ".join(rnd.choice(["word", "Wörter,", "a1", "", "é.", "x'y", "don't", "漢字!", "12", "...", "ab\n", "\x85"]) for _ in range(rnd.randrange(9)))
             for _ in range(800)]
    for text in plain:
        ids = reference.encode_ordinary(text)
        wanted.append((len(ids), " ".join(map(str, ids)).encode(), text.encode()))
    for size in (50, 5000, 10 ** 7):
        monkeypatch.setattr(bpe, "SLICE_BYTES", size)
        got = [(n, bytes(i), bytes(d)) for n, i, d in both.round_trips(pa.array(texts + plain))]
        assert got == wanted
        assert machine.decode(ids) == text and "".join(machine.stream(ids)) == text


def test_states_may_be_forgotten(codec):
    _, _, reference, ranks = codec
    small = bpe.Transducer(ranks, max_states=50)
    for word in [" tokenization", " unbelievably", "éàü", "x" * 3000, "ab" * 900]:
        whole = ranks.get(word.encode())
        assert ([whole] if whole is not None else small.encode(word.encode())) == reference.encode_ordinary(word)


def test_small_caches(codec):
    """Caches that turn over all the time give the same ids."""
    _, _, reference, ranks = codec
    own = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    own.encoder.pieces.limit = own.said.limit = own.spaced.limit = 3
    text = " ".join(t.decode("utf8", "ignore") for t in list(ranks)[5000:5400])
    ids = reference.encode_ordinary(text)
    assert own.round_trip(text) == (len(ids), " ".join(map(str, ids)), text)
    assert max(map(len, (own.encoder.pieces, own.said, own.spaced))) <= 3


def test_recent_keeps_what_is_used():
    made = []
    cache = Recent(lambda k: made.append(k) or k.upper(), 4, 3)
    for i in range(40):
        assert cache[f"a{i}"] == f"A{i}" and cache["x"] == "X" and cache["long"] == "LONG"
    assert made.count("x") == 1 and len(cache) <= 4 and made.count("a39") == 1 and made.count("long") == 40


def test_decoding_of_broken_bytes():
    machine = bpe.Utf8Machine({i: bytes((i,)) for i in range(256)})
    rnd = random.Random(4)
    for _ in range(300):
        raw = bytes(rnd.choice([0x41, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0xED, 0xA0, 0xFF]) for _ in range(12))
        assert machine.decode(list(raw)) == raw.decode("utf-8", "replace")


def test_columns_round_trip(spark):
    df = data.documents(spark)
    ids = bpe.encode_column(df, RANKS, public_tokenizers.PATTERN)
    back = bpe.decode_column(ids, RANKS, public_tokenizers.PATTERN)
    texts = sorted((str(r["doc_id"]), r["text"] or "") for r in df.collect())
    assert sorted((str(r["doc_id"]), r["text"]) for r in back.collect()) == texts
    for r in bpe.round_trip(df, RANKS, public_tokenizers.PATTERN).collect():
        assert (r["n_tokens"] > 0) or r["ids_sha256"] == r["decoded_sha256"]
    assert bpe.round_trip(data.empty(spark), RANKS, public_tokenizers.PATTERN).count() == 0


def test_word_ids_equal_the_library(monkeypatch):
    tokenizer, own = Tokenizer.from_file(WORDS), packing.ChunkEncoder(WORDS)
    for text in ODD + ["É É K İ ǅ ΑΣ ΑΣ. ", "<|endoftext|> a <|ENDOFTEXT|>", "a\x1cb \x85 c"]:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    rnd = random.Random(6)
    parts = ["don't", "It's.", "a1", "9", "..", ".", "?!", "ß", "É", "x\u0301", "漢字", "'", "'s", "\n", " ", "²", "Ⅷ", "<", "|", "wörter", "İ", "_"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 40))) for _ in range(1500)]
    for size in (30, 10 ** 7):
        monkeypatch.setattr(packing, "SLICE_BYTES", size)
        for text, ids in zip(texts, own.encode_all(pa.array(texts))):
            assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("capacity", [16, 64, 4096])
def test_packing(spark, capacity):
    long = " ".join(f"word{i}" for i in range(3000))
    df = data.documents(spark, [long, long])
    rows = packing.pack_documents(df, WORDS, capacity=capacity, with_ids=True).collect()
    tokenizer = Tokenizer.from_file(WORDS)
    want = sorted((str(r["doc_id"]), tuple(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + (1,)) for r in df.collect())
    whole = {}
    for r in sorted(rows, key=lambda r: (str(r["doc_id"]), r["piece"])):
        ids = np.array(r["ids"], "<u4")
        assert len(ids) == r["length"] <= capacity and zlib.crc32(ids.tobytes()) == r["ids_crc32"]
        if r["doc_id"] is not None and r["doc_id"] != 5:  # these repeat
            whole[str(r["doc_id"])] = whole.get(str(r["doc_id"]), ()) + tuple(r["ids"])
    assert whole.items() <= dict(want).items() and sum(map(len, (i for _, i in want))) == sum(r["length"] for r in rows)
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in places.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:i]) for i in range(len(held))]
        assert sum(n for _, n in held) <= capacity


def test_plan_uses_everything_and_is_tight():
    rnd = np.random.default_rng(2)
    for shape in ("flat", "small", "one", "none"):
        counts = np.zeros(1025, np.int64)
        if shape == "flat":
            np.add.at(counts, rnd.integers(1, 1025, 5000), 1)
        elif shape == "small":
            np.add.at(counts, rnd.integers(1, 60, 5000), 1)
        elif shape == "one":
            counts[700] = 10**9
        patterns = packing.plan(counts, 1024)
        used = np.zeros_like(counts)
        for lengths, times in patterns:
            assert sum(lengths) <= 1024 and times > 0
            np.add.at(used, list(lengths), times)
        assert (used == counts).all()
        total, bins = int(counts @ np.arange(1025)), sum(t for _, t in patterns)
        if shape in ("flat", "small"):
            assert bins <= -(-total // 1024) * 1.03 + 1


def test_packing_of_nothing(spark):
    assert packing.pack_documents(data.empty(spark), WORDS).count() == 0


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "hi <|im_end|>"), (1, 1, "assistant", "<|im_start|>assistant\n<\\|x|> <|"), (1, 2, "user", "\n\n a"),
            (1, 3, "assistant", "\n漢🙂 é\n\n "), (2, None, None, None), (2, 1, "assistant", ""), (3, 0, "sys\\tem\nrole", "<"),
            (3, 1, "assistant", "|ends with <"), (3, 1, "assistant", "|ends with <"), (None, 0, "assistant", "x" * 5000)]
    df = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, n_turns long")
    path = public_tokenizers.path("byte_bpe_50k.json")
    found = {r["conv_id"]: r for r in chat.format_conversations(df, path).collect()}
    tok = chat._tokenizer(path)
    control = {tok.token_to_id(chat.START), tok.token_to_id(chat.END)}
    for conv, r in found.items():
        own = sorted(((t[1] is not None, t[1] or 0, t[2] or "", t[3] or "") for t in rows if t[0] == conv))
        assert chat.parse(r["formatted"]) == [(role, text) for *_, role, text in own]
        loss = [chat.unescape(r["formatted"][a:b]) for a, b in zip(r["loss_starts"], r["loss_ends"])]
        assert loss == [text for *_, role, text in own if role == "assistant" and text]
        assert sum(i in control for i in r["ids"]) == 2 * len(own)
        for token, s, e, inside in zip(r["ids"], r["starts"], r["ends"], r["loss_mask"]):
            assert inside == any(s < b and e > a for a, b in zip(r["loss_starts"], r["loss_ends"])) and not (inside and token in control)
    assert chat.read_back(chat.format_conversations(df, path)).count() == 4
    assert chat.format_conversations(df.where("turn > 99"), path).count() == 0


def test_packing_of_one_piece_that_repeats(spark, monkeypatch):
    """Identical rows are numbered by many buckets; columns that clash with internal names stay."""
    monkeypatch.setattr(packing, "ROWS_PER_BUCKET", 10)
    rows = [(7, 3, "x", 1, 2, 3)] * 400 + [(8, 5, "y", 1, 2, 3)] * 7
    df = spark.createDataFrame(rows, "doc_id long, length long, _bucket string, _number long, _row long, offset long").repartition(3)
    seen = packing._numbered(df.drop("offset", "_row").withColumn("_row", F.monotonically_increasing_id()), "_row", "__number", 40)
    assert sorted(r["__number"] for r in seen.where("length = 3").collect()) == list(range(400))
    got = packing.pack(df, capacity=13).collect()
    assert len(got) == 407 and {(r["_bucket"], r["_number"], r["_row"]) for r in got} == {("x", 1, 2), ("y", 1, 2)}
    held = {}
    for r in got:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in held.values():
        places.sort()
        assert [o for o, _ in places] == np.cumsum([0, *[n for _, n in places]])[:-1].tolist() and sum(n for _, n in places) <= 13
    assert len(held) <= 104
