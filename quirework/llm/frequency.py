"""Problem 2: how often every distinct term occurs, in how many records and groups, and marks.

Per-record counts are emitted first and combined in each task before the shuffle; the per-record
counts are then summed per term. A term with a third of all rows is spread by its records in the
first step and is one partial state per task in the second.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table


@dataclass(frozen=True)
class Bounds:
    """rare: in at most rare_records records and rare_groups groups. common: at least common_share of all groups."""

    rare_records: int = 2
    rare_groups: int = 1
    common_share: tuple[int, int] = (1, 4)


def term_frequencies(df: DataFrame, term: str, record: str, group: str, bounds: Bounds = Bounds()) -> DataFrame:
    """(term, mentions, records, groups, rare, common) of every distinct non-null term.

    Rows that repeat count as mentions only. A null record or group is counted in no distinct
    number; with no non-null group at all nothing is common. Terms compare exactly, the empty
    string is a term. An empty table gives no rows. Other columns are ignored.
    """
    src = df.select(F.col(f"`{term}`").alias("term"), F.col(f"`{record}`").cast("string").alias("record"), F.col(f"`{group}`").cast("string").alias("grp"))
    emitted = src.filter("term IS NOT NULL").select("term", F.explode(F.array(F.struct(F.lit(0).alias("tag"), F.col("record").alias("id")), F.struct(F.lit(1).alias("tag"), F.col("grp").alias("id")))).alias("e")).select("term", "e.tag", "e.id")
    per_record = emitted.groupBy("term", "tag", "id").agg(F.count(F.lit(1)).alias("tf"))
    held = F.col("id").isNotNull()
    summed = per_record.groupBy("term").agg(
        F.sum(F.when(F.col("tag") == 0, F.col("tf")).otherwise(0)).alias("mentions"),
        F.count(F.when((F.col("tag") == 0) & held, 1)).alias("records"),
        F.count(F.when((F.col("tag") == 1) & held, 1)).alias("groups"),
    )
    all_groups = src.filter("grp IS NOT NULL").select("grp").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    part, whole = bounds.common_share
    return summed.select(
        "*",
        ((F.col("records") <= bounds.rare_records) & (F.col("groups") <= bounds.rare_groups)).alias("rare"),
        ((F.col("groups") * whole >= F.lit(part) * all_groups) & (F.col("groups") > 0)).alias("common"),
    )


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_frequencies(table(spark, sf_dir, "note_names"), "canonical", "chunk_id", "source_id")


def p2_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mentions(spark, sf_dir).withColumnsRenamed({"term": "canonical", "records": "notes", "groups": "sources"})


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = F.array_compact(F.array(F.when(F.col("rare"), "rare"), F.when(F.col("common"), "common")))
    return _mentions(spark, sf_dir).select(F.col("term").alias("canonical"), F.explode(marks).alias("mark"))


QUERIES = {"p2_found": p2_found, "p2_frequencies": p2_frequencies}

_SQL = """
SELECT canonical, mentions, notes, sources, notes <= 2 AND sources <= 1 AS rare,
       sources > 0 AND sources * 4 >= (SELECT count(DISTINCT source_id) FROM note_names) AS common
FROM (SELECT canonical, count(*) AS mentions, count(DISTINCT chunk_id) AS notes, count(DISTINCT source_id) AS sources
      FROM note_names WHERE canonical IS NOT NULL GROUP BY canonical)"""

SQL = {
    "p2_frequencies": _SQL,
    "p2_found": f"WITH f AS ({_SQL}) SELECT canonical, 'rare' AS mark FROM f WHERE rare UNION ALL SELECT canonical, 'common' AS mark FROM f WHERE common",
}
