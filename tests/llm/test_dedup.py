import hashlib
from collections import defaultdict

from tests.llm import data
from tidemark.llm import exact_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, keep, len(ids), i == keep, sha) for i in ids]
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    # É and é are equal in Unicode but not in A-Z: one digest, two classes.
    df = data.documents(spark, ["École A", "école a", "ÉCOLE A", "éCOLE a", "İ i"])
    got = exact_dedup.exact_dedup(df.repartition(5), salts=2).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute([(r["doc_id"], r["text"]) for r in df.collect()])


def test_hot_group_and_empty_table(spark):
    rows = [(i, "Same Text" if i % 3 else f"text {i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = exact_dedup.exact_dedup(df).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)
    assert exact_dedup.exact_dedup(data.empty(spark)).count() == 0
