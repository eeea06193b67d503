import random

import numpy as np
import pytest

from tests.llm import data
from tidemark.llm import jaccard
from tidemark.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    words = (text or "").translate(LOWER).replace("\x0b", " ").replace("\x0c", " ")
    words = [w for w in words.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    if len(words) < width:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i:i + width]) for i in range(len(words) - width + 1))


def brute(rows, width, percent):
    sets = [(i, shingles(t, width)) for i, t in rows]
    label = {i: i for i, _ in sets if i is not None}
    known = [(i, s) for i, s in sets if i is not None and s]

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for n, (i, s) in enumerate(known):
        for j, t in known[:n]:
            both = len(s & t)
            if 100 * both >= percent * (len(s) + len(t) - both):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return sorted(((i, len(s), root(i) if i is not None else None) for i, s in sets), key=str)


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80), (2, 50)])
def test_equals_brute_force(spark, width, percent):
    df = data.documents(spark)
    got = jaccard.jaccard_join(df, width=width, percent=percent).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute([(r["doc_id"], r["text"]) for r in df.collect()], width, percent)


def test_chains_and_shared_passages(spark, monkeypatch):
    """Long chains of near copies, one group larger than a tile, and a passage in every text."""
    monkeypatch.setattr(jaccard, "TILE", 8)
    monkeypatch.setattr(jaccard, "ENTRIES_PER_BLOCK", 500)
    rnd = random.Random(2)
    passage = [f"p{i}" for i in range(25)]
    texts = []
    for c in range(6):
        words = [f"c{c}w{rnd.randrange(50)}" for _ in range(40)] + passage
        for _ in range(30 if c == 0 else 5):
            words = list(words)
            words[rnd.randrange(40)] = f"e{rnd.randrange(1000)}"
            texts.append(" ".join(words))
    texts += [" ".join(passage + [f"u{i}"]) for i in range(20)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for width, percent in ((4, 85), (3, 70)):
        got = jaccard.jaccard_join(df, width=width, percent=percent).collect()
        assert sorted((tuple(r) for r in got), key=str) == brute(rows, width, percent)


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80)])
def test_dense_groups_give_links_in_proportion(spark, monkeypatch, width, percent):
    """Groups of many blocks of rows, in which most pairs link: a few links a set, and the same components."""
    monkeypatch.setattr(jaccard, "TILE", 8)
    made = []
    write = jaccard.materialize

    def counted(df, label, *rest):
        out = write(df, label, *rest)
        if label in ("cross-links", "star-links"):
            made.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "materialize", counted)
    ratios = []
    for n in (120, 360):
        rnd = random.Random(n)
        base = [f"b{i}" for i in range(100)]
        rows = []
        for i in range(n):
            words = list(base)
            for _ in range(rnd.randrange(3)):
                words[rnd.randrange(100)] = f"e{rnd.randrange(10 ** 6)}"
            rows.append((i, " ".join(words)))
        made.clear()
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = jaccard.jaccard_join(df, width=width, percent=percent).collect()
        assert sorted((tuple(r) for r in got), key=str) == brute(rows, width, percent)
        ratios.append(sum(made) / n)
    assert max(ratios) < 4 and ratios[1] < 1.5 * ratios[0] + 0.5, ratios


def test_empty_table(spark):
    assert jaccard.jaccard_join(data.empty(spark)).count() == 0


def test_product_counts_overlaps():
    rnd = np.random.default_rng(1)
    a = [np.unique(rnd.integers(0, 9000, 700)) for _ in range(5)]
    b = [np.unique(rnd.integers(0, 9000, 900)) for _ in range(4)]
    assert jaccard.overlaps(a, b).tolist() == [[len(np.intersect1d(x, y)) for y in b] for x in a]


def test_shingle_hashes_do_not_collide():
    """Words in every order: no two different shingles may share a hash."""
    rnd = random.Random(4)
    words = [rnd.choice("abcd") for _ in range(3000)]
    assert len(jaccard.Shingler(4).shingles(" ".join(words))) == len(shingles(" ".join(words), 4))


def test_components(spark):
    rnd = random.Random(8)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rnd.randrange(90), rnd.randrange(90)) for _ in range(60)]
    found = {r["id"]: r["label"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    label = {}
    for u, v in edges:
        label.setdefault(u, u), label.setdefault(v, v)
    for _ in edges:
        for u, v in edges:
            label[u] = label[v] = min(label[u], label[v])
    assert found == {k: v for k, v in label.items() if any(k in e and e[0] != e[1] for e in edges)}
