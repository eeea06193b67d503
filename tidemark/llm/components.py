"""Connected components of an edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.scratch import materialize


def components(edges: DataFrame) -> DataFrame:
    """(id, label): every vertex of ``edges`` (u, v) with the smallest id of its component.

    Alternating star contractions: each vertex points its larger neighbours, then
    its smaller ones, at the smallest vertex it knows, until nothing moves. Minima
    are aggregated before they meet the edges, so a vertex of many neighbours is
    a skewed plain join at most. Every round is written to the shared folder.
    """
    held = materialize(_oriented(edges), "edges")
    state = _state(held)
    while True:
        both = held.unionByName(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = materialize(_oriented(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))), "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        held = materialize(_oriented(
            small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))), "edges")
        now = _state(held)
        if now == state:
            break
        state = now
    roots = held.select(F.col("v").alias("id")).distinct()
    return held.select(F.col("u").alias("id"), F.col("v").alias("label")).unionByName(roots.select("id", F.col("id").alias("label")))


def _oriented(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger vertex to the smaller, without loops."""
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _state(edges: DataFrame) -> tuple:
    """Tells whether a round changed the edges: their number and a sum of their hashes."""
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]
