"""Queries of the per-key counts (problem 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import hot_keys, keyed_counts
from ..session import table


def p6_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed_counts(table(spark, sf_dir, "note_names"), "canonical", {"notes": "chunk_id", "sources": "source_id"})


def p6_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed_counts(table(spark, sf_dir, "note_names"), "chunk_id", {"names": "canonical"})


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys with at least 2 % of all rows, out of the per-key counts of both columns."""
    rows = table(spark, sf_dir, "note_names")
    total = rows.agg(F.count(F.lit(1)).alias("n"))
    counts = p6_names(spark, sf_dir).select(F.lit("canonical").alias("key_column"), F.col("canonical").alias("key_value"), "mentions").unionByName(
        p6_notes(spark, sf_dir).select(F.lit("chunk_id").alias("key_column"), F.col("chunk_id").alias("key_value"), "mentions")
    )
    return counts.filter(F.col("mentions") * 50 >= total.scalar()).select("key_column", "key_value")


def p6_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hot_keys(table(spark, sf_dir, "note_names"), ["canonical", "chunk_id", "source_id"])


QUERIES = {"p6_found": p6_found, "p6_names": p6_names, "p6_notes": p6_notes, "p6_hot": p6_hot}

_HOT = "SELECT '{0}' AS key_column, {0} AS key_value FROM note_names WHERE {0} IS NOT NULL GROUP BY {0} HAVING count(*) * 50 >= (SELECT count(*) FROM note_names)"

SQL = {
    "p6_found": " UNION ALL ".join(_HOT.format(k) for k in ("canonical", "chunk_id")),
    "p6_hot": " UNION ALL ".join(_HOT.format(k) for k in ("canonical", "chunk_id", "source_id")),
    "p6_names": "SELECT canonical, count(*) AS mentions, count(DISTINCT chunk_id) AS notes, count(DISTINCT source_id) AS sources FROM note_names WHERE canonical IS NOT NULL GROUP BY canonical",
    "p6_notes": "SELECT chunk_id, count(*) AS mentions, count(DISTINCT canonical) AS names FROM note_names WHERE chunk_id IS NOT NULL GROUP BY chunk_id",
}
