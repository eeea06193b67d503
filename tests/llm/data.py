"""Small awkward tables shared by the tests."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, label string, size long, keep_id long"
EDGES = [None, "", "   \n\t ", "a", "One two three", "x" * 3000, "é\x0bü\x1cß 漢字 🙂", "A\nA\n\nb\nA", "1 2 3 ... !!"]


def documents(spark, extra=(), seed=3):
    """Edge texts, copies, near copies, repeated rows, nulls in every column; columns that clash with internal names."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = list(EDGES)
    for _ in range(12):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randint(30, 90))]
        texts.append(" ".join(base))
        for _ in range(rnd.randint(0, 3)):
            other = list(base)
            other[rnd.randrange(len(other))] = "changed"
            texts.append(" ".join(other))
        texts.append(" ".join(base).upper())
    texts += list(extra)
    rows = [(i, t, rnd.choice(["en", "de", None]), rnd.choice(["s0", None]), "x", 1, 2) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, "One two three", None, None, None, None, None), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
