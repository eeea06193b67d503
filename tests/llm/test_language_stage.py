import random

import pytest

import corpus_pipeline

WORDS = {
    "en": "the of and to in that is was for with his they this have from which one were all there would their what about when make "
          "people water house through night between should because always another country children nothing morning thought".split(),
    "de": "der die und das nicht sich mit auch werden einer nach wird noch einem durch zwischen schon immer wieder gegen wasser "
          "haus nacht menschen kinder zeit heute jahr müssen können möchte während straße große kleine arbeit leben gesicht".split(),
    "fr": "le les des est dans pour que qui une sur avec pas plus nous vous être cette mais comme leur tout deux aussi autre eau "
          "maison nuit enfants temps toujours jamais pendant travail vie visage pays encore quelque chose après beaucoup".split(),
    "es": "el los de en que y una por con para como más pero sus este entre cuando muy sin sobre también hasta donde quien agua "
          "casa noche niños tiempo siempre nunca durante trabajo vida rostro país todavía alguna cosa después mucho".split()}
NAMES = sorted(WORDS)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rnd, lang, n):
    return " ".join(rnd.choice(WORDS[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def kept_of(spark):
    """Ids kept of 400 rightly declared texts and what a test adds, from id 1000 on."""
    def run(added):
        rnd = random.Random(11)
        rows = [(i, prose(rnd, NAMES[i % 4], rnd.randint(40, 200)), NAMES[i % 4]) for i in range(400)]
        rows += [(1000 + i, text, lang) for i, (text, lang) in enumerate(added)]
        docs = spark.createDataFrame([(*r, "s", len(r[1])) for r in rows], SCHEMA)
        kept = {r["doc_id"] for r in corpus_pipeline.know_language(spark, docs, "").collect()}
        assert kept >= set(range(400))
        return {i - 1000 for i in kept if i >= 1000}

    return run


@pytest.mark.parametrize("words", [15, 50, 150])
def test_wrong_languages_go_and_two_languages_stay(kept_of, words):
    rnd = random.Random(words)
    pairs = [(a, b) for a in NAMES for b in NAMES if a != b]
    wrong = [(prose(rnd, a, words), b) for a, b in pairs]
    right = [(prose(rnd, a, words), a) for a, _ in pairs]
    both = [(f"{prose(rnd, a, words // 2)} {prose(rnd, b, words - words // 2)}", b) for a, b in pairs]
    other = [(text, None) for text, _ in wrong]
    kept = kept_of(wrong + right + both + other)
    n = len(pairs)
    assert len(kept & set(range(n))) <= 1
    assert kept >= set(range(n, 2 * n))
    assert len(kept & set(range(2 * n, 3 * n))) >= n - 1
    assert kept >= set(range(3 * n, 4 * n))
