"""Registered queries of the training-data operators, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, chat, collocations, exact_dedup, jaccard, langid, packing, periodic, quality, simhash, toxicity, url_filter, warc
from tidemark.llm.common import table, words

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_quality_rules")
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


@query("op2_ngram_jaccard_join", """
    WITH RECURSIVE w AS (
      SELECT doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\x09-\\x0D]+'), lambda x: x <> '') AS w
      FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
    l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 85 * (a.n + b.n - o)),
    e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
    r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.c = e.x)
    SELECT r.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(c) AS component_id
    FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id""")
def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"), width=4, percent=85)


@query("op3_exact_dedup", """
    WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS s
               FROM documents),
         g AS (SELECT s, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY s)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(s) AS text_sha256 FROM t JOIN g USING (s)""")
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_language_id")
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


PROBE = "<|im_end|><|im_start|>assistant ok"


@query("op6_chat_formatting", rf"""
    WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'),
         e AS (SELECT *, regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') AS body,
                      regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\1\\|', 'g') AS head FROM t)
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
           sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
           CAST(sum(length(head) + length(body) + 24) AS BIGINT) AS formatted_chars
    FROM e GROUP BY conv_id""")
def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"), F.lit(PROBE).alias("text"))
    formatted = chat.format_conversations(turns.unionByName(probe), public_tokenizers.path("byte_bpe_50k.json"))
    return chat.read_back(formatted)


@query("op7_byte_bpe")
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


@query("op8_best_fit_packing")
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op9_warc", """
    WITH t AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
                      sha256(coalesce(html, '')) AS payload_digest FROM pages),
         f AS (SELECT payload_digest, min(page_id) AS first FROM t WHERE payload_bytes >= 100 GROUP BY 1),
         r AS (SELECT t.*, CASE WHEN first <> page_id THEN first END AS refers_to FROM t
               LEFT JOIN f ON t.payload_digest = f.payload_digest AND payload_bytes >= 100)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM r""")
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    crawled = pages.withColumn("captured_at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id")))
    return warc.capture_histories(crawled).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


RULES = [
    url_filter.Rule("allow", "org", "/"), url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"), url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/")]


@query("op10_url_filter")
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), RULES)


@query("op11_collocations", r"""
    WITH t AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
                      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS s FROM documents),
    p AS (SELECT lang, doc, unnest(regexp_split_to_array(s, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
    w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \x09]+'), lambda x: x <> '') AS w FROM p),
    n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
    g AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
    c AS (SELECT lang, w[i:i + k - 1] AS g, k, count(*) AS f FROM g, (SELECT unnest([1, 2, 3, 4]) AS k)
          WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 30),
    cuts AS (SELECT lang, g, k, f, unnest(range(1, k)) AS j FROM c WHERE k > 1),
    each AS (SELECT x.lang, x.g, x.k, x.f AS a, x.j, l.f AS l, r.f AS r,
                    CAST((2000000::HUGEINT * x.f) // (l.f + r.f) AS BIGINT) AS score
             FROM cuts x JOIN c l ON l.lang = x.lang AND l.g = x.g[1:x.j] JOIN c r ON r.lang = x.lang AND r.g = x.g[x.j + 1:x.k]),
    low AS (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, j) AS o FROM each),
    inner_parts AS (SELECT lang, g, k, f, unnest(range(2, k)) AS m FROM c WHERE k > 2),
    parts AS (SELECT lang, g, f, m, unnest(range(1, k - m + 2)) AS i FROM inner_parts),
    cover AS (SELECT lang, g[i:i + m - 1] AS g, max(f) AS f FROM parts GROUP BY ALL),
    kept AS (SELECT low.*, array_to_string(low.g, ' ') AS phrase FROM low LEFT JOIN cover USING (lang, g)
             WHERE o = 1 AND (cover.f IS NULL OR 100 * cover.f < 80 * a)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
    SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000""")
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """The contract's input: a tenth of the documents repeat p of their words from word a on."""
    word, h = words(F.col("text")), F.crc32(F.col("doc_id").cast("string"))
    planted = docs.withColumn("_w", F.when(h % 10 == 0, word)).withColumn("_g", F.floor(h / 10)).withColumn("_n", F.size("_w").cast("long"))
    planted = planted.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.greatest(F.col("_n"), F.lit(1))))
    planted = planted.withColumn("_p", 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8)))
    repeated = F.expr("array_join(transform(sequence(0L, _n - 1), i -> _w[cast(if(i < _a, i, _a + (i - _a) % _p) as int)]), ' ')")
    return planted.select("doc_id", F.when(F.col("_n") > 0, repeated).otherwise(F.col("text")).alias("text"))


@query("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


@query("op13_simhash")
def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))
