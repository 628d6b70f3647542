"""Joins over the store: names, their notes, sources, citations and opposition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import covering, rotate


def members(note_names: DataFrame, notes: DataFrame, sources: DataFrame) -> DataFrame:
    """(canonical, chunk_id, source_id, author, title, year) of each name's notes that are evidence, each once."""
    held = notes.filter("NOT back_matter").select("chunk_id", "source_id")
    met = note_names.select("canonical", "chunk_id").distinct().join(held, "chunk_id")
    return met.join(sources.select("source_id", "author", "title", "year"), "source_id", "left").select("canonical", "chunk_id", "source_id", "author", "title", "year")


def doors(names: DataFrame, note_names: DataFrame, notes: DataFrame) -> DataFrame:
    """(canonical, kind, member_count, source_count); a name whose notes are all back matter stays, at 0."""
    held = notes.filter("NOT back_matter").select("chunk_id", F.col("source_id").alias("src"))
    met = note_names.select("canonical", "chunk_id").distinct().join(held, "chunk_id")
    counts = met.groupBy("canonical").agg(F.count(F.lit(1)).alias("member_count"), F.count_distinct("src").alias("source_count"))
    return names.select("canonical", "kind").join(counts, "canonical", "left").fillna(0, ["member_count", "source_count"])


def concept_sources(note_names: DataFrame, notes: DataFrame, sources: DataFrame) -> DataFrame:
    """(canonical, source_id, author, year, note_count)."""
    m = members(note_names, notes, sources)
    return m.groupBy("canonical", "source_id").agg(F.first("author").alias("author"), F.first("year").alias("year"), F.count(F.lit(1)).alias("note_count"))


def find_notes(about: str, note_names: DataFrame, notes: DataFrame, sources: DataFrame, against: DataFrame | None = None, opposing: str | None = None, after: int | None = None, before: int | None = None, limit: int = 20) -> DataFrame:
    """Notes about a name in rotation over their sources, with the turn and the total before the limit.

    opposing keeps the sources that argue against that name anywhere; after and before are strict
    bounds of the source's year. The window holds one note of every source at least.
    """
    held = notes.filter("NOT back_matter").select("chunk_id", "source_id", "claim", "position")
    out = note_names.filter(F.col("canonical") == about).select("chunk_id").distinct().join(held, "chunk_id").join(sources.select("source_id", "author", "year"), "source_id", "left")
    if opposing is not None:
        foes = against.filter(F.col("resolved_canonical") == opposing).select("source_id").distinct()
        out = out.join(foes, "source_id", "left_semi")
    if after is not None:
        out = out.filter(F.col("year") > after)
    if before is not None:
        out = out.filter(F.col("year") < before)
    turned = rotate(out.withColumn("about", F.lit(about)), ["about"], "source_id", ["chunk_id"])
    turned = turned.withColumn("total", F.count(F.lit(1)).over(_all("about")))
    return covering(turned, ["about"], "source_id", limit).drop("about")


def _all(*cols: str):
    from pyspark.sql import Window as W

    return W.partitionBy(*cols)


def against_names(against: DataFrame, note_names: DataFrame) -> DataFrame:
    """(target, canonical, kind, note_count, source_count): names in the notes that oppose a target, itself left out."""
    a = against.filter("resolved_canonical IS NOT NULL").select("chunk_id", F.col("resolved_canonical").alias("target")).distinct()
    met = a.join(note_names, "chunk_id").filter("canonical <> target")
    return met.groupBy("target", "canonical").agg(F.min("kind").alias("kind"), F.count_distinct("chunk_id").alias("note_count"), F.count_distinct("source_id").alias("source_count"))


def opposition_pairs(against: DataFrame, note_names: DataFrame, notes: DataFrame, canonical: str | None = None) -> DataFrame:
    """(canonical, opposing_chunk, opposing_source, target, about_chunk, about_source): both ends evidence, sources differ."""
    evidence = notes.filter("NOT back_matter").select("chunk_id")
    a = against.filter("resolved_canonical IS NOT NULL AND source_id IS NOT NULL")
    if canonical is not None:
        a = a.filter(F.col("resolved_canonical") == canonical)
    a = a.join(evidence, "chunk_id", "left_semi").select(F.col("resolved_canonical").alias("canonical"), F.col("chunk_id").alias("opposing_chunk"), F.col("source_id").alias("opposing_source"), "target").distinct()
    n = note_names.select("canonical", F.col("chunk_id").alias("about_chunk"), F.col("source_id").alias("mention_source"))
    held = notes.filter("NOT back_matter").select(F.col("chunk_id").alias("about_chunk"), F.col("source_id").alias("about_source"))
    met = a.join(n, "canonical").filter("mention_source <> opposing_source").join(held, "about_chunk")
    return met.select("canonical", "opposing_chunk", "opposing_source", "target", "about_chunk", "about_source").distinct()


def opposition_sizes(against: DataFrame, note_names: DataFrame, notes: DataFrame) -> DataFrame:
    """(canonical, pairs) of every opposed name, from counts by source; no pair is made."""
    evidence = notes.filter("NOT back_matter").select("chunk_id")
    a = against.filter("resolved_canonical IS NOT NULL AND source_id IS NOT NULL").join(evidence, "chunk_id", "left_semi").select(F.col("resolved_canonical").alias("canonical"), "chunk_id", "source_id", "target").distinct()
    mine = a.groupBy("canonical", "source_id").agg(F.count(F.lit(1)).alias("opposing"))
    m = note_names.filter("source_id IS NOT NULL").select("canonical", "chunk_id", "source_id").distinct().join(evidence, "chunk_id", "left_semi").groupBy("canonical", "source_id").agg(F.count(F.lit(1)).alias("about"))
    whole = m.groupBy("canonical").agg(F.sum("about").alias("all_about"))
    met = mine.join(whole, "canonical").join(m, ["canonical", "source_id"], "left")
    return met.groupBy("canonical").agg(F.sum(F.col("opposing") * (F.col("all_about") - F.coalesce("about", F.lit(0)))).alias("pairs")).filter("pairs > 0")


def meet(note_names: DataFrame, one: str, other: str) -> DataFrame:
    """(chunk_id, source_id) of the notes that name both; back matter counts here."""
    a = note_names.filter(F.col("canonical") == one).groupBy("chunk_id").agg(F.min("source_id").alias("source_id"))
    return a.join(note_names.filter(F.col("canonical") == other).select("chunk_id"), "chunk_id", "left_semi")


def word_grams(df: DataFrame, text: str, least: int, most: int, as_col: str = "gram") -> DataFrame:
    """Every run of `least` to `most` words of a folded text: containment becomes an equal join."""
    toks = F.filter(F.split(F.col(text), " "), lambda w: w != "")
    grams = F.flatten(
        F.transform(
            F.sequence(F.lit(least), F.lit(most)),
            lambda k: F.when(F.size("_t") >= k, F.transform(F.sequence(F.lit(1), F.size("_t") - k + 1), lambda i: F.array_join(F.slice("_t", i, k), " "))).otherwise(F.array().cast("array<string>")),
        )
    )
    return df.withColumn("_t", toks).withColumn(as_col, F.explode(F.array_distinct(grams))).drop("_t")


def components(edges: DataFrame, cut, most_rounds: int = 60) -> DataFrame:
    """(id, root) of the connected components, root the least id; edges: (a, b).

    In each round every node goes to the neighbour of the least hash, or stays where it has the least, twice over, and edges inside what is
    then one node are gone; so the tables shrink, and rounds grow as the logarithm of the longest path. cut writes an
    intermediate table.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = None
    for turn in range(most_rounds):
        ranked = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("id"))  # noqa: B023, E731
        step = cut(both.groupBy("a").agg(F.min(ranked("b")).alias("m")).select(F.col("a").alias("id"), F.least(ranked("a"), "m")["id"].alias("to")))
        to = cut(step.join(step.select(F.col("id").alias("to"), F.col("to").alias("far")), "to").select("id", F.col("far").alias("to")))
        labels = to if labels is None else labels.join(to.select(F.col("id").alias("to"), F.col("to").alias("far")), "to", "left").select("id", F.coalesce("far", "to").alias("to"))
        x, y = to.select(F.col("id").alias("a"), F.col("to").alias("x")), to.select(F.col("id").alias("b"), F.col("to").alias("y"))
        both = cut(both.filter("a <> b").join(x, "a").join(y, "b").filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        if both.isEmpty():
            break
    labels = cut(labels)
    return cut(labels.join(labels.groupBy("to").agg(F.min("id").alias("root")), "to").select("id", "root"))
