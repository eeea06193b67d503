import hashlib
import random
import re
import zlib

import pytest

from tests.llm import data
from tidemark.llm import periodic, queries

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_runs(words):
    """Every maximal stretch, by its definition."""
    n, best = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(12, 2 * q):
                best.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, q, length) for (s, length), q in best.items())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(doc_id, words):
    runs = brute_runs(words)
    dropped = {i for s, q, length in runs for i in range(s + q, s + length)}
    first = min(((-length, s, q) for s, q, length in runs), default=None)
    best = (None,) * 4 if first is None else (first[1], -first[0], first[2], 1000 * -first[0] // first[2])
    return (doc_id, len(runs), *best, sha("".join(f"{s},{length},{q}\n" for s, q, length in runs)),
            sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def texts(seed=1):
    rnd = random.Random(seed)
    out = ["x " * 11, "x " * 12, "x " * 300, "a b " * 6, "a b " * 5 + "a", "a b c d e f " * 2, "a b c d e f g " * 2 + "a"]
    for _ in range(30):
        words = [rnd.choice("abcdefgh") for _ in range(rnd.randrange(5, 400))]
        for _ in range(rnd.randrange(4)):
            p, at = rnd.randrange(1, 60), rnd.randrange(len(words))
            words[at:at] = (words[at:at + p] or ["z"]) * rnd.randrange(2, 9)
        out.append(" ".join(words))
    out += [" ".join(rnd.choice("ab") for _ in range(500)), " ".join((["a", "a", "b"] * 9 + ["c"]) * 12), " ".join(map(str, range(2000)))]
    fib = ["a", "ab"]
    while len(fib[-1]) < 700:
        fib.append(fib[-1] + fib[-2])
    return [*out, " ".join(fib[-1])]


@pytest.mark.parametrize("long_words,chunk", [(8192, 1_000_000), (40, 500)])
def test_equals_brute_force(spark, monkeypatch, long_words, chunk):
    """Documents solved whole, and tile by tile."""
    monkeypatch.setattr(periodic, "CHUNK_WORDS", chunk)
    df = data.documents(spark, extra=texts())
    got = periodic.periodic_runs(df, long_words=long_words).drop("runs").collect()
    want = [expected(r["doc_id"], WORD.findall(r["text"] or "")) for r in df.collect()]
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)


def test_empty(spark):
    assert periodic.periodic_runs(data.empty(spark)).count() == 0


def test_z_function():
    rnd = random.Random(4)
    for _ in range(50):
        x = [rnd.choice("ab") for _ in range(rnd.randrange(0, 40))]
        direct = [0] * len(x)
        for i in range(1, len(x)):
            while i + direct[i] < len(x) and x[direct[i]] == x[i + direct[i]]:
                direct[i] += 1
        assert periodic.z_function(x) == direct


def test_query_with_planted_runs(spark, tmp_path):
    df = data.documents(spark, extra=texts(2))
    df.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op12_periodic_runs(spark, str(tmp_path)).collect()
    want = []
    for r in df.collect():
        words = WORD.findall(r["text"] or "")
        n = len(words)
        if r["doc_id"] is not None and n:
            h = zlib.crc32(str(r["doc_id"]).encode())
            g = h // 10
            if h % 10 == 0:
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        want.append(expected(r["doc_id"], words))
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
