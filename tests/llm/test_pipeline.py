from tests.llm import data

import corpus_pipeline


def texts(n):
    import random

    rnd = random.Random(n)
    return [" ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta"]) + str(rnd.randrange(9)) for _ in range(60))
            for _ in range(n)]


def test_stages(spark, tmp_path):
    base = texts(40)
    near = [t.replace(t.split()[30], "other", 1) for t in base[:6]]
    copy = " ".join(w.upper() if i in (20, 40) else w for i, w in enumerate(base[7].split()))
    rows = [(i, t, "en", "s") for i, t in enumerate(base + [copy] + near + ["short text", "1 2 3 " * 9, None, base[9].upper()])]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], columns)
    kept = docs
    names = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
        names.append((name, {r["doc_id"] for r in kept.collect()}))
    stages = dict(names)
    # Too short, of one letter class, empty, and shouted: the last is far from its group in capitals.
    assert stages["quality_rules"] >= set(range(41)) and not stages["quality_rules"] & {47, 48, 49, 50}
    assert 7 not in stages["exact_dedup"] and 40 in stages["exact_dedup"]
    assert not stages["ngram_jaccard_join"] & set(range(41, 47)) and stages["ngram_jaccard_join"] >= set(range(40)) - {7}
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == stages["ngram_jaccard_join"]


def test_awkward_and_empty_tables(spark, tmp_path):
    for df in (data.documents(spark), data.empty(spark)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, df, str(tmp_path)).count() <= df.count()


def test_rows_that_repeat_an_id(spark, tmp_path):
    """Rows of one id are judged apart by the quality rules; of identical rows one is packed."""
    base = texts(30)
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(base)]
    rows += [(3, "short text", "en", "s", 1), rows[5], rows[5], rows[5], (5, base[5].upper().lower(), "en", "t", 2), (None, base[8] + " x", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    passed = corpus_pipeline.pass_quality_rules(spark, docs, str(tmp_path))
    assert "short text" not in {r["text"] for r in passed.collect()} and passed.where("doc_id = 3").count() == 1
    assert passed.where("doc_id = 5").count() == 5
    exact = corpus_pipeline.drop_exact_copies(spark, passed, str(tmp_path))
    assert exact.columns == docs.columns and exact.where("doc_id = 5").count() == 1 and exact.count() == 31
