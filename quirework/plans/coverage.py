"""Coverage and confidence, gates and spend: audit figures as tables.

A source stands for a run: its notes with a claim are the claims, the notes it cites from are the
grounds, the names it argues against are the names it retrieved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.shapes import ABSTENTION
from ..operators.skew import asked_keys, union_counts
from ..session import cut, table

#: Notes from which a name is covered moderately, and densely.
MODERATE, DENSE = 20, 100
BANDS = ("thin", "moderate", "dense")


def _t(spark: SparkSession, d: str, *names: str) -> list[DataFrame]:
    return [table(spark, d, n) for n in names]


def _claims(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "notes")
    return n.filter("NOT back_matter AND claim IS NOT NULL").filter(F.lower(F.trim("claim")) != ABSTENTION).select("chunk_id", "source_id")


def _touched(spark: SparkSession, d: str) -> DataFrame:
    """(source_id, chunk_id, canonical): names that the notes of each claim mention."""
    return _claims(spark, d).join(table(spark, d, "note_names").select("chunk_id", "canonical").dropna().distinct(), "chunk_id").select("source_id", "chunk_id", "canonical")


def _retrieved(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "note_arguing_against").select("source_id", F.col("resolved_canonical").alias("canonical")).dropna().distinct()


def _members(spark: SparkSession, d: str) -> DataFrame:
    nn, n = _t(spark, d, "note_names", "notes")
    return nn.select("canonical", "chunk_id").dropna().distinct().join(n.filter("NOT back_matter").select("chunk_id", F.col("source_id").alias("src")), "chunk_id")


def agg04_name_sources(spark: SparkSession, d: str) -> DataFrame:
    """Distinct sources of the members of each name."""
    return _members(spark, d).groupBy("canonical").agg(F.count_distinct("src").alias("sources"))


def agg07_coverage_scope(spark: SparkSession, d: str) -> DataFrame:
    """Names that a source retrieved and that a claim of it touches."""
    return _touched(spark, d).select("source_id", "canonical").distinct().join(_retrieved(spark, d), ["source_id", "canonical"], "left_semi")


def agg08_touched_names(spark: SparkSession, d: str) -> DataFrame:
    """Names touched by the claims of each source: how many, and by how many claims."""
    return _touched(spark, d).groupBy("source_id").agg(F.count_distinct("canonical").alias("names"), F.count_distinct("chunk_id").alias("claims"))


def agg09_evidence_counts(spark: SparkSession, d: str) -> DataFrame:
    """Of each source's grounds, how many notes are members of each name in its scope; 0 stays."""
    grounds = table(spark, d, "note_citations").select("source_id", "chunk_id").dropna().distinct()
    met = grounds.join(_members(spark, d).select("chunk_id", "canonical"), "chunk_id").groupBy("source_id", "canonical").agg(F.count(F.lit(1)).alias("k"))
    return agg07_coverage_scope(spark, d).join(met, ["source_id", "canonical"], "left").select("source_id", "canonical", F.coalesce("k", F.lit(0)).alias("evidence_notes"))


def agg10_coverage_map(spark: SparkSession, d: str) -> DataFrame:
    """Every name in scope with its notes in the corpus, the source's evidence and its band; a name without notes is thin, its count null."""
    corpus = _members(spark, d).groupBy("canonical").agg(F.count(F.lit(1)).alias("corpus_notes"))
    band = F.when(F.col("corpus_notes") >= DENSE, "dense").when(F.col("corpus_notes") >= MODERATE, "moderate").otherwise("thin")
    return agg09_evidence_counts(spark, d).join(corpus, "canonical", "left").select("source_id", "canonical", "corpus_notes", "evidence_notes", band.alias("band"))


def agg12_claim_ceilings(spark: SparkSession, d: str) -> DataFrame:
    """The highest confidence of each claim: that of the worst band among the covered names it touches, else not measured."""
    rank = F.when(F.col("band") == "thin", 0).when(F.col("band") == "moderate", 1).otherwise(2)
    cover = agg10_coverage_map(spark, d).select("source_id", "canonical", rank.alias("rank"))
    worst = _touched(spark, d).join(cover, ["source_id", "canonical"]).groupBy("chunk_id").agg(F.min("rank").alias("rank"))
    said = F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.col("rank") + 1)
    return _claims(spark, d).join(worst, "chunk_id", "left").select("chunk_id", F.coalesce(F.when(F.col("rank").isNotNull(), said), F.lit("not_measured")).alias("ceiling"))


def agg13_release_gate(spark: SparkSession, d: str) -> DataFrame:
    """Per source: names in scope, names of the map without evidence, claims without a covered name; it passes with none of either."""
    cover = agg10_coverage_map(spark, d).groupBy("source_id").agg(F.count(F.lit(1)).alias("scope"), F.count_if(F.col("evidence_notes") == 0).alias("unsupported"))
    loose = agg12_claim_ceilings(spark, d).join(_claims(spark, d), "chunk_id").groupBy("source_id").agg(F.count_if(F.col("ceiling") == "not_measured").alias("unmeasured"))
    out = loose.join(cover, "source_id", "left").fillna(0, ["scope", "unsupported"])
    return out.select("source_id", "scope", "unsupported", "unmeasured", ((F.col("unsupported") == 0) & (F.col("unmeasured") == 0) & (F.col("scope") > 0)).alias("passes"))


def agg17_corpus_notes(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "notes")
    return n.agg(F.count(F.lit(1)).alias("notes"), F.count_if(~F.col("back_matter")).alias("evidence"))


def agg23_attribution(spark: SparkSession, d: str) -> DataFrame:
    """The share of each source's claims whose note cites somebody."""
    cites = table(spark, d, "note_citations").filter("cited IS NOT NULL").select("chunk_id").distinct().withColumn("hit", F.lit(1.0))
    return _claims(spark, d).join(cites, "chunk_id", "left").groupBy("source_id").agg(F.count(F.lit(1)).alias("claims"), F.round(F.avg(F.coalesce("hit", F.lit(0.0))), 9).alias("attributed"))


def agg30_retrieval_precision(spark: SparkSession, d: str) -> DataFrame:
    """Of the notes in which each source's retrieved names occur, the share that it cites from."""
    grounds = table(spark, d, "note_citations").select("source_id", "chunk_id").dropna().distinct().withColumn("hit", F.lit(1.0))
    seen = _retrieved(spark, d).join(_members(spark, d).select("canonical", "chunk_id", F.col("src").alias("source_id")), ["canonical", "source_id"]).select("source_id", "chunk_id").distinct()
    return seen.join(grounds, ["source_id", "chunk_id"], "left").groupBy("source_id").agg(F.count(F.lit(1)).alias("composed"), F.round(F.avg(F.coalesce("hit", F.lit(0.0))), 9).alias("precision"))


def agg32_band_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Names in scope by band, for each source."""
    return agg10_coverage_map(spark, d).groupBy("source_id").agg(*[F.count_if(F.col("band") == b).alias(b) for b in BANDS])


def _asked_notes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """((source_id, o, ks), (chunk_id, ks, srcs)): sources with the numbers of their retrieved names, and the notes that are evidence and mention one, with those and their sources (a null one is one)."""
    nn, n = _t(spark, d, "note_names", "notes")
    owners, keys = asked_keys(_retrieved(spark, d), "source_id", "canonical")
    srcs = n.filter("NOT back_matter AND chunk_id IS NOT NULL").groupBy("chunk_id").agg(F.collect_set(F.struct("source_id")).alias("srcs"))
    met = nn.select("canonical", "chunk_id").join(keys, "canonical").select("chunk_id", "k").join(srcs, "chunk_id")
    return owners, met.groupBy("chunk_id").agg(F.collect_set("k").alias("ks"), F.any_value("srcs").alias("srcs"))


def agg33_available_notes(spark: SparkSession, d: str) -> DataFrame:
    """Per source: the notes of its retrieved names, each counted once, and the sum over names."""
    owners, notes = _asked_notes(spark, d)
    found = union_counts(owners, notes.select(F.xxhash64("chunk_id").alias("h"), "ks", F.size("srcs").alias("w")))
    return owners.join(found, "o").select("source_id", F.col("items").alias("available"), F.col("weight").alias("by_name"))


def agg35_grounds_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Distinct cited-from notes of each source, and those that are evidence."""
    c, n = _t(spark, d, "note_citations", "notes")
    g = c.select("source_id", "chunk_id").dropna().distinct().join(n.filter("NOT back_matter").select("chunk_id", F.lit(1).alias("e")), "chunk_id", "left")
    return g.groupBy("source_id").agg(F.count(F.lit(1)).alias("grounds"), F.count("e").alias("evidence"))


def agg36_names_queried(spark: SparkSession, d: str) -> DataFrame:
    """The names each source retrieved in the order of their first note."""
    a = table(spark, d, "note_arguing_against").filter("source_id IS NOT NULL AND resolved_canonical IS NOT NULL AND chunk_id IS NOT NULL")
    first = a.groupBy("source_id", F.col("resolved_canonical").alias("canonical")).agg(F.min("chunk_id").alias("first"))
    return first.select("source_id", "canonical", F.row_number().over(W.partitionBy("source_id").orderBy("first", "canonical")).alias("turn"))


def agg40_usage_by_pass(spark: SparkSession, d: str) -> DataFrame:
    """Tokens and cost by pass and model; an unpriced model has no cost."""
    r = table(spark, d, "run_log").distinct()
    return r.groupBy("pass_name", "model").agg(F.sum("tokens").alias("tokens"), F.round(F.sum("usd"), 6).alias("usd"))


def agg58_seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    """Fifty notes by a seeded hash, the same every time: a sample is the feature."""
    n = table(spark, d, "notes").select("chunk_id", F.md5(F.concat(F.lit("7|"), "chunk_id")).alias("h"))
    return n.orderBy("h", "chunk_id").limit(50).select("chunk_id")


def agg67_overall_confidence(spark: SparkSession, d: str) -> DataFrame:
    """The confidence of works by several sources of one title: that of the weakest; sources without a measure hold it low."""
    rank = F.when(F.col("dense") + F.col("moderate") + F.col("thin") == 0, 0).when(F.col("thin") > 0, 0).when(F.col("moderate") > 0, 1).otherwise(2)
    per = agg32_band_histogram(spark, d).select("source_id", rank.alias("rank"))
    s = table(spark, d, "sources").filter("title IS NOT NULL").select("source_id", "title").join(per, "source_id", "left")
    out = s.groupBy("title").agg(F.count(F.lit(1)).alias("sources"), F.min(F.coalesce("rank", F.lit(0))).alias("rank"))
    return out.select("title", "sources", F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.col("rank") + 1).alias("confidence"))


def agg68_composition(spark: SparkSession, d: str) -> DataFrame:
    """A sentence for each source: of how many notes and sources the evidence of its names is made."""
    owners, notes = _asked_notes(spark, d)
    notes = cut(notes.select(F.xxhash64("chunk_id").alias("h"), "ks", "srcs", F.lit(1).alias("w")))
    each = notes.select(F.explode("srcs.source_id").alias("src"), "ks").select("src", F.explode("ks").alias("k"))
    n = union_counts(owners, notes).select("o", F.col("items").alias("n"))
    srcs = each.filter("src IS NOT NULL").groupBy("src").agg(F.collect_set("k").alias("ks")).select(F.xxhash64("src").alias("h"), "ks", F.lit(1).alias("w"))
    k = union_counts(owners, srcs).select("o", F.col("items").alias("k"))
    met = owners.join(n, "o").join(k, "o", "left").select("source_id", "n", F.coalesce("k", F.lit(0)).alias("k"))
    return met.select("source_id", F.concat(F.col("n").cast("string"), F.when(F.col("n") == 1, " note").otherwise(" notes"), F.lit(" from "), F.col("k").cast("string"), F.when(F.col("k") == 1, " source").otherwise(" sources")).alias("composition"))


def agg72_pass_rows(spark: SparkSession, d: str) -> DataFrame:
    """Per pass: sources settled, still open (their last row is no end), and all; the total is never below both."""
    r = table(spark, d, "run_log").filter("source_id IS NOT NULL").distinct()
    last = r.groupBy("pass_name", "source_id").agg(F.max_by("status", F.struct("logged_at", "arrived_at", "status")).alias("status"))
    return last.groupBy("pass_name").agg(F.count_if(F.col("status").isin("done", "skipped")).alias("settled"), F.count_if(~F.col("status").isin("done", "skipped")).alias("open"), F.count(F.lit(1)).alias("total"))


def agg73_spend(spark: SparkSession, d: str) -> DataFrame:
    """Spend per source; partial where a row that used tokens has no price."""
    r = table(spark, d, "run_log").filter("source_id IS NOT NULL").distinct()
    return r.groupBy("source_id").agg(F.round(F.sum("usd"), 6).alias("usd"), F.coalesce(F.bool_or(F.col("usd").isNull() & (F.col("tokens") > 0)), F.lit(False)).alias("partial"))


def agg77_source_set_keys(spark: SparkSession, d: str) -> DataFrame:
    """Names whose notes stand in the same set of sources: how many share it, by two sums of hashes, which need no list."""
    m = _members(spark, d).filter("src IS NOT NULL").select("canonical", "src").distinct()
    half = lambda seed: F.sum(F.xxhash64("src", F.lit(seed)).cast("decimal(20,0)"))
    g = m.groupBy("canonical").agg(F.count(F.lit(1)).alias("sources"), half(1).alias("h"), half(2).alias("k"))
    same = g.groupBy("sources", "h", "k").agg(F.min("canonical").alias("first"), F.count(F.lit(1)).alias("names"))
    return g.join(same, ["sources", "h", "k"]).select("canonical", "first", "names", "sources")


QUERIES = {k: v for k, v in list(globals().items()) if k[:3] == "agg" and getattr(v, "__module__", "") == __name__}

_A = f"'{ABSTENTION}'"
_CL = f"cl AS (SELECT chunk_id, source_id FROM notes WHERE NOT back_matter AND claim IS NOT NULL AND lower(trim(claim)) <> {_A})"
_TO = "tn AS (SELECT DISTINCT source_id, chunk_id, canonical FROM cl JOIN (SELECT chunk_id, canonical FROM note_names WHERE canonical IS NOT NULL) USING (chunk_id))"
_RE = "re AS (SELECT DISTINCT source_id, resolved_canonical AS canonical FROM note_arguing_against WHERE source_id IS NOT NULL AND resolved_canonical IS NOT NULL)"
_ME = "me AS (SELECT DISTINCT nn.canonical, n.chunk_id, n.source_id AS src FROM note_names nn JOIN notes n ON n.chunk_id = nn.chunk_id AND NOT n.back_matter WHERE nn.canonical IS NOT NULL)"
_SC = "sc AS (SELECT DISTINCT source_id, canonical FROM tn JOIN re USING (source_id, canonical))"
_GR = "gr AS (SELECT DISTINCT source_id, chunk_id FROM note_citations WHERE source_id IS NOT NULL AND chunk_id IS NOT NULL)"
_EV = "ev AS (SELECT sc.source_id, sc.canonical, count(k.chunk_id) AS evidence_notes FROM sc LEFT JOIN (SELECT gr.source_id, me.canonical, gr.chunk_id FROM gr JOIN me USING (chunk_id)) k USING (source_id, canonical) GROUP BY ALL)"
_MAP = f"mp AS (SELECT source_id, canonical, c.n AS corpus_notes, evidence_notes, CASE WHEN c.n >= {DENSE} THEN 'dense' WHEN c.n >= {MODERATE} THEN 'moderate' ELSE 'thin' END AS band FROM ev LEFT JOIN (SELECT canonical, count(*) AS n FROM me GROUP BY 1) c USING (canonical))"
_ALL = f"WITH {_CL}, {_TO}, {_RE}, {_ME}, {_SC}, {_GR}, {_EV}, {_MAP}"
_CE = "ce AS (SELECT cl.chunk_id, cl.source_id, coalesce(CASE min(CASE band WHEN 'thin' THEN 0 WHEN 'moderate' THEN 1 WHEN 'dense' THEN 2 END) WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' END, 'not_measured') AS ceiling FROM cl LEFT JOIN tn USING (source_id, chunk_id) LEFT JOIN mp ON mp.source_id = tn.source_id AND mp.canonical = tn.canonical GROUP BY ALL)"

SQL = {
    "agg04_name_sources": f"WITH {_ME} SELECT canonical, count(DISTINCT src) AS sources FROM me GROUP BY 1",
    "agg07_coverage_scope": f"{_ALL} SELECT source_id, canonical FROM sc",
    "agg08_touched_names": f"{_ALL} SELECT source_id, count(DISTINCT canonical) AS names, count(DISTINCT chunk_id) AS claims FROM tn GROUP BY 1",
    "agg09_evidence_counts": f"{_ALL} SELECT * FROM ev",
    "agg10_coverage_map": f"{_ALL} SELECT * FROM mp",
    "agg12_claim_ceilings": f"{_ALL}, {_CE} SELECT chunk_id, ceiling FROM ce",
    "agg13_release_gate": f"{_ALL}, {_CE}, l AS (SELECT source_id, count(*) FILTER (ceiling = 'not_measured') AS unmeasured FROM ce GROUP BY 1), m AS (SELECT source_id, count(*) AS scope, count(*) FILTER (evidence_notes = 0) AS unsupported FROM mp GROUP BY 1) SELECT source_id, coalesce(scope, 0) AS scope, coalesce(unsupported, 0) AS unsupported, unmeasured, coalesce(unsupported, 0) = 0 AND unmeasured = 0 AND coalesce(scope, 0) > 0 AS passes FROM l LEFT JOIN m USING (source_id)",
    "agg17_corpus_notes": "SELECT count(*) AS notes, count(*) FILTER (NOT back_matter) AS evidence FROM notes",
    "agg23_attribution": f"WITH {_CL} SELECT source_id, count(*) AS claims, round(avg(CASE WHEN chunk_id IN (SELECT chunk_id FROM note_citations WHERE cited IS NOT NULL) THEN 1.0 ELSE 0.0 END), 9) AS attributed FROM cl GROUP BY 1",
    "agg30_retrieval_precision": f"WITH {_RE}, {_ME}, {_GR}, s AS (SELECT DISTINCT re.source_id, me.chunk_id FROM re JOIN me ON me.canonical = re.canonical AND me.src = re.source_id) SELECT s.source_id, count(*) AS composed, round(avg(CASE WHEN gr.chunk_id IS NULL THEN 0.0 ELSE 1.0 END), 9) AS precision FROM s LEFT JOIN gr USING (source_id, chunk_id) GROUP BY 1",
    "agg32_band_histogram": f"{_ALL} SELECT source_id, count(*) FILTER (band = 'thin') AS thin, count(*) FILTER (band = 'moderate') AS moderate, count(*) FILTER (band = 'dense') AS dense FROM mp GROUP BY 1",
    "agg33_available_notes": f"WITH {_RE}, {_ME} SELECT source_id, count(DISTINCT chunk_id) AS available, count(*) AS by_name FROM re JOIN me USING (canonical) GROUP BY 1",
    "agg35_grounds_by_source": f"WITH {_GR} SELECT gr.source_id, count(*) AS grounds, count(n.chunk_id) AS evidence FROM gr LEFT JOIN notes n ON n.chunk_id = gr.chunk_id AND NOT n.back_matter GROUP BY 1",
    "agg36_names_queried": "SELECT source_id, canonical, row_number() OVER (PARTITION BY source_id ORDER BY first, canonical) AS turn FROM (SELECT source_id, resolved_canonical AS canonical, min(chunk_id) AS first FROM note_arguing_against WHERE source_id IS NOT NULL AND resolved_canonical IS NOT NULL AND chunk_id IS NOT NULL GROUP BY 1, 2)",
    "agg40_usage_by_pass": "SELECT pass_name, model, sum(tokens)::BIGINT AS tokens, round(sum(usd), 6) AS usd FROM (SELECT DISTINCT * FROM run_log) GROUP BY 1, 2",
    "agg58_seeded_sample": "SELECT chunk_id FROM notes ORDER BY md5('7|' || chunk_id), chunk_id LIMIT 50",
    "agg67_overall_confidence": f"{_ALL}, h AS (SELECT source_id, min(CASE band WHEN 'thin' THEN 0 WHEN 'moderate' THEN 1 ELSE 2 END) AS rank FROM mp GROUP BY 1) SELECT title, count(*) AS sources, CASE min(coalesce(rank, 0)) WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS confidence FROM sources LEFT JOIN h USING (source_id) WHERE title IS NOT NULL GROUP BY 1",
    "agg68_composition": f"WITH {_RE}, {_ME} SELECT source_id, count(DISTINCT chunk_id) || CASE WHEN count(DISTINCT chunk_id) = 1 THEN ' note' ELSE ' notes' END || ' from ' || count(DISTINCT src) || CASE WHEN count(DISTINCT src) = 1 THEN ' source' ELSE ' sources' END AS composition FROM re JOIN me USING (canonical) GROUP BY 1",
    "agg72_pass_rows": "WITH l AS (SELECT pass_name, source_id, arg_max(status, (logged_at, arrived_at, status)) AS status FROM run_log WHERE source_id IS NOT NULL GROUP BY 1, 2) SELECT pass_name, count(*) FILTER (status IN ('done', 'skipped')) AS settled, count(*) FILTER (status NOT IN ('done', 'skipped')) AS open, count(*) AS total FROM l GROUP BY 1",
    "agg73_spend": "SELECT source_id, round(sum(usd), 6) AS usd, coalesce(bool_or(usd IS NULL AND tokens > 0), false) AS partial FROM (SELECT DISTINCT * FROM run_log WHERE source_id IS NOT NULL) GROUP BY 1",
    "agg77_source_set_keys": f"WITH {_ME}, g AS (SELECT canonical, string_agg(DISTINCT src, '|' ORDER BY src) AS key, count(DISTINCT src) AS sources FROM me WHERE src IS NOT NULL GROUP BY 1) SELECT canonical, first, names, sources FROM g JOIN (SELECT key, min(canonical) AS first, count(*) AS names FROM g GROUP BY 1) USING (key)",
}
