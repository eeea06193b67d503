import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm import data
from tests.llm.test_jaccard import LOWER
from tidemark.llm import simhash


def direct(text, width=3):
    words = (text or "").translate(LOWER).replace("\x0b", " ").replace("\x0c", " ")
    words = [w for w in words.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    shingles = [" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, distance=2):
    known = [(i, p) for i, p in rows if i is not None]
    prints = sorted({p for _, p in known})
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for n, a in enumerate(prints):
        for b in prints[:n]:
            if (a ^ b).bit_count() <= distance:
                root[find(a)] = find(b)
    least = {}
    for i, p in known:
        least[find(p)] = min(least.get(find(p), i), i)
    return sorted(((i, f"{p:016x}", None if i is None else least[find(p)]) for i, p in rows), key=str)


def test_equals_brute_force(spark):
    rnd = random.Random(9)
    base = [f"w{rnd.randrange(500)}" for _ in range(900)]
    near = []
    for _ in range(60):
        base = list(base)
        base[rnd.randrange(900)] = f"v{rnd.randrange(500)}"
        near.append(" ".join(base))
    df = data.documents(spark, extra=near)
    rows = [(r["doc_id"], direct(r["text"])) for r in df.collect()]
    want = brute(rows)
    assert len({c for _, _, c in want}) < len({p for _, p, _ in want})
    got = simhash.near_duplicates(df)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert simhash.near_duplicates(data.empty(spark)).count() == 0


def clustered(seed, centres=6, size=250):
    """Fingerprints within few bits of some centres, far more than chance has."""
    rnd = random.Random(seed)
    out = {0, 1, (1 << 64) - 1}
    for _ in range(centres):
        p = rnd.getrandbits(64)
        for _ in range(size):
            q = p
            for _ in range(rnd.randrange(4)):
                q ^= 1 << rnd.randrange(64)
            out.add(q)
            p = q if rnd.random() < 0.3 else p
    return sorted(out)


@pytest.mark.parametrize("bucket", [1, 20, 2048])
def test_dense_groups(spark, monkeypatch, bucket):
    """Full buckets go through four segments and lookups: the same components."""
    prints = clustered(3)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    monkeypatch.setattr(simhash, "_fingerprints", lambda rows, width, seed: rows.select("id", F.col("text").cast("long").alias("print")))
    df = spark.createDataFrame([(i, str(p)) for i, p in enumerate(signed)], "doc_id long, text string").repartition(3)
    got = simhash.near_duplicates(df, bucket=bucket).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(list(enumerate(prints)))


def test_every_close_pair_has_a_viable_chain():
    rnd = random.Random(5)
    for _ in range(300):
        x = 0
        for _ in range(rnd.randrange(4)):
            x ^= 1 << rnd.randrange(64)
        starts = [s for s in range(simhash.SEGMENTS) if simhash.viable(simhash.rotated(np.array([x], np.uint64), s), s)[0]]
        assert bool(starts) == (x.bit_count() <= 2)


def test_links_are_fewer_than_fingerprints():
    prints = np.array(clustered(8, 1, 400), np.uint64)
    assert len(simhash.bucket_links(np.zeros(len(prints), np.int64), prints)) < len(prints)


def test_fingerprint_of_long_text():
    words = [f"w{i % 977}" for i in range(70_000)]
    hashes = np.array(simhash.shingle_hashes(" ".join(words), 3, 42), np.uint64)
    want = sum(1 << b for b in range(64) if 2 * int((hashes >> np.uint64(b) & np.uint64(1)).sum()) > len(hashes))
    assert simhash.fingerprint(hashes) == want
