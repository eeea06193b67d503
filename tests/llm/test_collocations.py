import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm import data
from tidemark.llm import collocations, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top):
    by_lang = {}
    for lang, text in rows:
        counts = by_lang.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            for k in range(1, 5):
                counts.update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in by_lang.items():
        total = sum(n for g, n in counts.items() if len(g) == 1)
        candidates = {g: n for g, n in counts.items() if len(g) > 1 and n >= least}
        covered = set()
        for g, n in candidates.items():
            for m in range(2, len(g)):
                covered |= {s for i in range(len(g) - m + 1) if 100 * n >= 80 * counts[s := g[i:i + m]]}
        found = []
        for g, a in candidates.items():
            if g not in covered:
                score, k = min((2_000_000 * a // (counts[g[:k]] + counts[g[k:]]), k) for k in range(1, len(g)))
                found.append((-score, -a, " ".join(g).encode(), counts[g[:k]], counts[g[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, total, -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def corpus(seed=5):
    rnd = random.Random(seed)
    hot = "the quick, Brown fox jumps over the lazy dog; the quick Brown fox".split(" ")
    rows = []
    for i in range(160):
        words = []
        while len(words) < 60:
            words += hot[:rnd.randrange(2, 9)] if rnd.random() < 0.4 else [rnd.choice("a b c Dé e. f g's 漢字 h\n i".split(" "))]
        rows.append((rnd.choice(["en", "de", None]), " ".join(words)))
    rows += [("en", "x " * 500), ("en", None), (None, ""), ("zz", "alone"), ("de", " .,; \t\n")]
    return rows


@pytest.mark.parametrize("budget", [5, 60, 10_000])
def test_equals_brute_force(spark, budget, monkeypatch):
    """Groups of few windows extend common prefixes to every depth."""
    monkeypatch.setattr(collocations, "CHUNK_WORDS", 700)
    monkeypatch.setattr(collocations, "ROW_WORDS", 50)
    monkeypatch.setattr(collocations, "HEAD_WORDS", 9)
    rows = corpus()
    df = spark.createDataFrame([(i, lang, text, i, i) for i, (lang, text) in enumerate(rows)], "doc_id long, lang string, text string, n long, rank long")
    for least, top in ((5, 1000), (8, 7)):
        got = collocations.collocations(df, min_count=least, top=top, budget=budget)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(tuple(r) for r in got.collect()) == brute(rows, least, top)


def test_edges(spark):
    df = data.documents(spark)
    rows = [(r["lang"], r["text"]) for r in df.collect()]
    assert sorted(tuple(r) for r in collocations.collocations(df, min_count=2).collect()) == brute(rows, 2, 2000)
    assert collocations.collocations(data.empty(spark)).count() == 0


def test_windows_in_halves(monkeypatch):
    """More words than 16 bits can number: the chunk is cut, no window is lost."""
    rnd = np.random.default_rng(1)
    code = rnd.integers(0, 40, 300).astype(np.uint64)
    begins = np.arange(300) < 290

    def counted():
        out = Counter()
        for words, counts in collocations.windows(code, begins):
            for *w, n in zip(*words, counts):
                out[tuple(map(int, w))] += int(n)
        return out

    whole = counted()
    monkeypatch.setattr(collocations, "TAIL", 38)
    assert counted() == whole


def test_scores_beyond_64_bits(spark):
    big = 4_000_000_000_000_000
    grams = spark.createDataFrame([("en", [1], big + 3), ("en", [2], big + 11), ("en", [1, 2], big)], "lang string, gram array<long>, n long")
    row = collocations._scored(grams).first()
    assert (row["score"], row["l"], row["r"]) == (2_000_000 * big // (2 * big + 14), big + 3, big + 11)


def test_groups_keep_to_the_budget():
    loads = np.array([7, 1, 9, 3, 3, 0, 12, 2])
    group = collocations.group_cells(loads, 10)
    sums = np.bincount(group, loads)
    assert sums.sum() == loads.sum() and all(s <= 10 or (group == g).sum() == 1 for g, s in enumerate(sums))


def test_query_is_registered():
    assert "op11_collocations" in queries.QUERIES and "op11_collocations" in queries.ORACLES
