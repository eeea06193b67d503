"""A corpus pipeline of the training-data operators, one stage after another.

Each stage works on all that the one before has kept. The filtering stages
return the columns of documents; the last returns packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, jaccard, langid, packing, quality
from tidemark.llm.common import ascii_lower
from tidemark.scratch import materialize


def _with_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is among ``ids``; a null id matches a null id."""
    wanted = ids.select(F.col("doc_id").alias("_wanted"))
    return docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("_wanted")), "left_semi")


def _row_key() -> Column:
    """Names a row by its id, text, language and source; rows equal in these are judged alike."""
    parts = [p for c in ("text", "lang", "source") for p in (F.col(c).isNull(), F.coalesce(F.col(c), F.lit("")))]
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("~")), F.xxhash64(*parts))


def pass_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie far from their language and source go.

    Each row is judged for itself, also if its doc_id repeats.
    """
    keyed = docs.withColumn("_row_key", _row_key())
    kept = quality.quality_rules(keyed, id_col="_row_key").where("kept").select("_row_key")
    return keyed.join(kept, "_row_key", "left_semi").select(*docs.columns)


def know_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those surely in another learned language than they declare.

    Sure is a gap between the two languages' cosines that fits the text's length.
    A null declared language is no contradiction.
    """
    profiles = langid.learn(docs.where(langid.remainder("doc_id", 4) != 2))
    known = (F.col("_lang_pred") != langid.UNKNOWN) & ~F.col("_lang_contradicted")
    return langid.annotate(docs, profiles).where(known).select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays; of rows that repeat it with the text, one."""
    keyed = docs.withColumn("_sha", F.sha2(ascii_lower(F.coalesce("text", F.lit(""))), 256))
    found = materialize(exact_dedup.exact_dedup(docs).where("kept").select("doc_id", "text_sha256"), "kept-copies")
    wanted = found.select(F.col("doc_id").alias("_wanted"), F.col("text_sha256").alias("_text"))
    same = F.col("doc_id").eqNullSafe(F.col("_wanted")) & (F.col("_sha") == F.col("_text"))
    again = materialize(wanted.groupBy("_wanted", "_text").count().where("count > 1").drop("count"), "repeated-rows")
    if again.isEmpty():
        return keyed.join(wanted, same, "left_semi").select(*docs.columns)
    once = keyed.join(wanted, same, "left_semi").join(again, same, "left_anti").select(*docs.columns)
    one = keyed.join(again, same, "left_semi").groupBy("doc_id", "_sha").agg(F.min(F.struct(*docs.columns)).alias("d"))
    return once.unionByName(one.select("d.*"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8, the one with the smallest doc_id stays.

    Rows of one doc_id with different texts stay or go together.
    """
    found = jaccard.jaccard_join(docs, width=5, percent=80)
    return _with_ids(docs, found.where(F.col("component_id").eqNullSafe(F.col("doc_id"))))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all remaining documents with their places in sequences of 4096 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", pass_quality_rules), ("language_id", know_language), ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard_join", drop_near_copies), ("best_fit_packing", pack_sequences)]

# The robust estimates, the learned language profiles and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
