"""Exact duplicates by skew-safe combining."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower
from tidemark.scratch import materialize

SALTS = 16


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when identical after lower-casing A-Z; the row with the
    largest id stays. Three combining steps group by digest *and* whole text:

    1. within a task (partial aggregation: a task sends a text once at most),
    2. per (digest, salt), the salt being the task's number modulo ``salts``,
    3. per digest over the salts' winners.

    The digest is of the Unicode-lower-cased text, cheaper to take and never
    finer than the equality. Rows then meet the classes on the digest alone;
    digests that hold more than one class are matched on the whole text.

    Null text counts as empty. A null id never wins over another; a group of
    null ids only keeps each of its rows. Rows that repeat the largest id all
    stay. An empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_raw"))
    rows = rows.withColumn("_digest", F.sha2(F.lower("_raw"), 256))
    classes = _classes(rows, salts)
    # Written, so that rows meet it in a plain join whose hot partitions Spark can split.
    per_digest = materialize(classes.groupBy("_digest").agg(
        F.count(F.lit(1)).alias("_classes"), F.first("_keep").alias("_keep"),
        F.first("_n").alias("_n"), F.first("_sha").alias("_sha")), "digests")
    single = per_digest.where("_classes = 1").drop("_classes")
    found = rows.select("_id", "_digest").join(single, "_digest")
    mixed = classes.join(per_digest.where("_classes > 1").select("_digest"), "_digest", "left_semi")
    if not mixed.isEmpty():
        found = found.unionByName(_match_on_text(rows, mixed))
    return found.select(
        F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"), F.col("_n").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"), F.col("_sha").alias("text_sha256"))


def _classes(rows: DataFrame, salts: int) -> DataFrame:
    """One row per distinct normalised text, without the text."""
    salted = rows.select(
        "_digest", (F.spark_partition_id() % salts).alias("_salt"), ascii_lower(F.col("_raw")).alias("_text"), "_id")
    by_salt = salted.groupBy("_digest", "_salt", "_text").agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
    whole = by_salt.groupBy("_digest", "_text").agg(F.max("_keep").alias("_keep"), F.sum("_n").alias("_n"))
    return materialize(whole.select("_digest", "_keep", "_n", F.sha2("_text", 256).alias("_sha")), "classes")


def _match_on_text(rows: DataFrame, mixed: DataFrame) -> DataFrame:
    """Rows of digests with several classes, matched on the SHA-256 of the normalised text.

    Every class of such a digest is a different text with its own SHA-256.
    """
    here = rows.join(mixed.select("_digest").distinct(), "_digest", "left_semi")
    keyed = here.select("_id", "_digest", F.sha2(ascii_lower(F.col("_raw")), 256).alias("_sha"))
    return keyed.join(mixed, ["_digest", "_sha"])
