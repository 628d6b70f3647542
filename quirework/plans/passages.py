"""More queries over passages: positions, packets, links, ranks, families and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.shapes import ABSTENTION, LOCATOR, folded
from ..operators.ordered import first_of_each, rotate
from ..session import table

KINDS = ("person", "institution/group", "country/state/place", "event", "work", "movement/religion", "period", "concept")
LANDED = ("sovereignty", "nationalism", "taxation")


def _t(spark: SparkSession, d: str, *names: str) -> list[DataFrame]:
    return [table(spark, d, n) for n in names]


def _positions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "notes").filter("position IS NOT NULL AND NOT back_matter").filter(F.lower(F.trim("position")) != ABSTENTION)


def flt02_key_presence(spark: SparkSession, d: str) -> DataFrame:
    """Whether an event's properties hold the key, by presence, and its value."""
    e = table(spark, d, "events")
    v = F.get_json_object("props", "$.k")
    return e.select("event_id", F.coalesce(F.array_contains(F.json_object_keys("props"), "k"), F.lit(False)).alias("has"), v.cast("bigint").alias("k"))


def flt20_routes(spark: SparkSession, d: str) -> DataFrame:
    """Kinds to routes; what is unknown falls open to prose."""
    nn = table(spark, d, "note_names")
    route = F.when(F.col("kind").isin("table", "figure"), "artifact").when(F.col("kind").isin("period", "concept"), "apparatus").otherwise("prose")
    return nn.groupBy(route.alias("route")).agg(F.count(F.lit(1)).alias("mentions"))


def flt33_answer_fields(spark: SparkSession, d: str) -> DataFrame:
    """The fields of a note that are answers, in fixed order."""
    n = table(spark, d, "notes")
    held = F.map_filter(F.create_map(F.lit("claim"), F.col("claim"), F.lit("position"), F.col("position"), F.lit("section"), F.col("section")), lambda k, v: v.isNotNull() & (F.lower(F.trim(v)) != ABSTENTION))
    return n.select("chunk_id", F.array_join(F.map_keys(held), ",").alias("fields"))


def flt38_bad_kinds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "note_names").filter(F.col("kind").isNull() | ~F.col("kind").isin(*KINDS)).groupBy("kind").agg(F.count(F.lit(1)).alias("mentions"))


def flt39_dangling_citations(spark: SparkSession, d: str) -> DataFrame:
    c, n = _t(spark, d, "note_citations", "notes")
    return c.filter("chunk_id IS NOT NULL").join(n.select("chunk_id"), "chunk_id", "left_anti").select("chunk_id", "cited").distinct()


def flt40_balanced_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources that name an opponent somewhere or state no position at all."""
    n, a = _t(spark, d, "notes", "note_arguing_against")
    foe = a.select("chunk_id").distinct().withColumn("foe", F.lit(True))
    g = n.join(foe, "chunk_id", "left").groupBy("source_id").agg(F.bool_or(F.coalesce("foe", F.lit(False))).alias("opposes"), F.bool_and(F.col("position").isNull()).alias("silent"))
    return g.select("source_id", "opposes", "silent", (F.col("opposes") | F.col("silent")).alias("valid"))


def joi05_opposing_notes(spark: SparkSession, d: str) -> DataFrame:
    a, n = _t(spark, d, "note_arguing_against", "notes")
    return a.filter(F.col("resolved_canonical").isin(*LANDED)).join(n.filter("NOT back_matter").select("chunk_id", "section"), "chunk_id").select("resolved_canonical", "chunk_id", "section").distinct()


def joi15_positions_on(spark: SparkSession, d: str) -> DataFrame:
    """Positions stated in notes about a name, by how many of these."""
    nn = table(spark, d, "note_names")
    ids = nn.filter(F.col("canonical") == LANDED[0]).select("chunk_id").distinct()
    return _positions(spark, d).join(ids, "chunk_id", "left_semi").groupBy("position").agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("source_id").alias("sources"))


def joi16_corridor(spark: SparkSession, d: str) -> DataFrame:
    """Oppositions that touch a landed name at one end only, both ways round."""
    a, nn = _t(spark, d, "note_arguing_against", "note_names")
    e = a.filter("resolved_canonical IS NOT NULL").join(nn.select("chunk_id", "canonical"), "chunk_id").select(F.col("resolved_canonical").alias("x"), F.col("canonical").alias("y")).filter("x <> y").distinct()
    both = e.unionAll(e.select("y", "x").toDF("x", "y"))
    return both.filter(F.col("x").isin(*LANDED) & ~F.col("y").isin(*LANDED)).select(F.col("x").alias("near"), F.col("y").alias("far")).distinct()


def joi20_merged_stances(spark: SparkSession, d: str) -> DataFrame:
    """Stances of a citing note to a work merged, lower case, with whether the work is its own source's title."""
    c, s = _t(spark, d, "note_citations", "sources")
    g = c.filter("stance IS NOT NULL AND cited IS NOT NULL").groupBy("chunk_id", "cited").agg(F.array_join(F.array_sort(F.collect_set(F.lower("stance"))), "+").alias("stances"), F.max("source_id").alias("source_id"))
    return g.join(s.select("source_id", "title"), "source_id", "left").select("chunk_id", "cited", "stances", F.coalesce(F.col("title") == F.col("cited"), F.lit(False)).alias("self"))


def joi23_chapter_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections without a chapter to the most frequent chapter of that section (ties: least)."""
    n = table(spark, d, "notes")
    known = n.filter("chapter IS NOT NULL").groupBy("section", "chapter").agg(F.count(F.lit(1)).alias("k")).groupBy("section").agg(F.min_by("chapter", F.struct(-F.col("k"), F.col("chapter"))).alias("guess"))
    return n.filter("chapter IS NULL").join(known, "section", "left").select("chunk_id", "section", "guess")


def joi24_links(spark: SparkSession, d: str) -> DataFrame:
    """Names in a note that have a row, the opposed one left out, in order."""
    a, nn, names = _t(spark, d, "note_arguing_against", "note_names", "names")
    m = a.filter("resolved_canonical IS NOT NULL").select("chunk_id", "resolved_canonical").distinct().join(nn.select("chunk_id", "canonical").distinct(), "chunk_id").filter("canonical <> resolved_canonical").join(names.select("canonical"), "canonical", "left_semi")
    return m.groupBy("chunk_id", "resolved_canonical").agg(F.array_join(F.array_sort(F.collect_set("canonical")), "|").alias("links"))


def joi25_packets(spark: SparkSession, d: str) -> DataFrame:
    """Notes about a name with their answers, author and year."""
    nn, n, s = _t(spark, d, "note_names", "notes", "sources")
    m = nn.filter(F.col("canonical") == LANDED[1]).select("chunk_id").distinct()
    return n.join(m, "chunk_id", "left_semi").join(s.select("source_id", "author", "year"), "source_id", "left").select("chunk_id", "author", "year", F.coalesce("position", "claim").alias("said"))


def joi29_opposed_notes(spark: SparkSession, d: str) -> DataFrame:
    """Names both opposed and mentioned in notes of different sources: how many notes stand on each side."""
    a, nn = _t(spark, d, "note_arguing_against", "note_names")
    foes = a.filter("resolved_canonical IS NOT NULL").groupBy(F.col("resolved_canonical").alias("canonical")).agg(F.count_distinct("chunk_id").alias("against"), F.count_distinct("source_id").alias("foes"))
    about = nn.groupBy("canonical").agg(F.count_distinct("chunk_id").alias("about"))
    return foes.join(about, "canonical")


def joi30_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Notes that may state a counter-position, from four places in order; the first place wins, 20 at most."""
    nn, n, a, c = _t(spark, d, "note_names", "notes", "note_arguing_against", "note_citations")
    places = [
        a.filter(F.col("resolved_canonical") == LANDED[0]).select("chunk_id"),
        c.filter(F.lower("stance") == "foil").join(nn.filter(F.col("canonical") == LANDED[0]).select("chunk_id"), "chunk_id", "left_semi").select("chunk_id"),
        a.join(nn.filter(F.col("canonical") == LANDED[0]).select("chunk_id"), "chunk_id", "left_semi").select("chunk_id"),
        n.join(nn.filter(F.col("canonical") == LANDED[0]).select("chunk_id"), "chunk_id", "left_semi").filter("position IS NOT NULL").select("chunk_id"),
    ]
    out = None
    for i, p in enumerate(places, 1):
        one = p.distinct().withColumn("place", F.lit(i))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("chunk_id").agg(F.min("place").alias("place")).orderBy("place", "chunk_id").limit(20)


def joi32_same_members(spark: SparkSession, d: str) -> DataFrame:
    """Notes with exactly the same names as another, however many, and the least such note.

    The key of a set is its size and two sums of 64-bit hashes of its members, which need no list and no order.
    """
    nn = table(spark, d, "note_names").select("chunk_id", "canonical").dropna().distinct()
    half = lambda seed: F.sum(F.xxhash64("canonical", F.lit(seed)).cast("decimal(20,0)"))
    g = nn.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("names"), half(1).alias("h"), half(2).alias("k"))
    same = g.groupBy("names", "h", "k").agg(F.min("chunk_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return g.join(same, ["names", "h", "k"]).select("chunk_id", "first", "names")


def joi33_reusable_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims of later sources whose text an earlier source already holds."""
    n, s = _t(spark, d, "notes", "sources")
    k = n.filter("claim IS NOT NULL").filter(F.lower(F.trim("claim")) != ABSTENTION).join(s.select("source_id", "year"), "source_id").filter("year IS NOT NULL").select("chunk_id", "year", F.md5("claim").alias("key"))
    old = k.groupBy("key").agg(F.min("year").alias("first"))
    return k.join(old, "key").filter("year > first").select("chunk_id", "key")


def joi39_bibliography(spark: SparkSession, d: str) -> DataFrame:
    """Works cited with support, with their count and number by first letter and title."""
    c = table(spark, d, "note_citations").filter("lower(stance) = 'support' AND cited IS NOT NULL")
    g = c.groupBy("cited").agg(F.count_distinct("chunk_id").alias("notes"))
    return g.select("cited", "notes", F.row_number().over(W.partitionBy(F.substring("cited", 1, 1)).orderBy("cited")).alias("n"))


def agg27_stance_mix(spark: SparkSession, d: str) -> DataFrame:
    """Citations per source by stance: a pivot over fixed stances."""
    c = table(spark, d, "note_citations").filter("source_id IS NOT NULL").withColumn("s", F.lower("stance"))
    return c.groupBy("source_id").pivot("s", ["support", "foil", "authority"]).agg(F.count(F.lit(1))).fillna(0)


def agg28_cross_source_rate(spark: SparkSession, d: str) -> DataFrame:
    """The share of cited works that two sources or more cite."""
    c = table(spark, d, "note_citations").filter("cited IS NOT NULL").groupBy("cited").agg(F.count_distinct("source_id").alias("k"))
    return c.agg(F.count(F.lit(1)).alias("works"), F.round(F.avg((F.col("k") >= 2).cast("double")), 9).alias("rate"))


def agg29_grounds(spark: SparkSession, d: str) -> DataFrame:
    """Citations per note: mean, median and the share with two or more."""
    g = table(spark, d, "note_citations").groupBy("chunk_id").agg(F.count(F.lit(1)).alias("k"))
    return g.agg(F.round(F.avg("k"), 9).alias("mean"), F.percentile("k", 0.5).alias("median"), F.round(F.avg((F.col("k") >= 2).cast("double")), 9).alias("several"))


def agg57_stratified(spark: SparkSession, d: str) -> DataFrame:
    """Five names of each kind, by a seeded hash: a sample that is the same every time."""
    n = table(spark, d, "names").filter("kind IS NOT NULL")
    w = W.partitionBy("kind").orderBy(F.md5(F.concat(F.lit("7|"), "canonical")), "canonical")
    return n.withColumn("r", F.row_number().over(w)).filter("r <= 5").select("kind", "canonical", "r")


def agg71_canary(spark: SparkSession, d: str) -> DataFrame:
    """Passes that fail where a fifth of their runs did not end or the longest is above 60 s."""
    r = table(spark, d, "run_log").distinct().groupBy("pass_name").agg(F.avg((F.col("status") != "done").cast("double")).alias("bad"), F.max("duration_sec").alias("longest"))
    return r.select("pass_name", F.round("bad", 9).alias("bad"), "longest", ((F.col("bad") >= 0.2) | (F.col("longest") > 60)).alias("fails"))


def win06_author_spread(spark: SparkSession, d: str) -> DataFrame:
    """Notes of a chapter in rotation over authors, the first 50."""
    n, s = _t(spark, d, "notes", "sources")
    j = n.filter("chapter IS NOT NULL").join(s.select("source_id", "author"), "source_id", "left").select("chapter", "chunk_id", "author")
    return rotate(j, ["chapter"], "author", ["chunk_id"]).filter("turn <= 50")


def win10_first_tier(spark: SparkSession, d: str) -> DataFrame:
    """Names that hold a word: as their first word, as another, or inside one; the first tier wins."""
    n = table(spark, d, "names").select(F.col("canonical"), F.lower("canonical").alias("l")).distinct()
    tier = F.when(F.col("l").startswith("the "), 1).when(F.concat(F.lit(" "), "l", F.lit(" ")).contains(" of "), 2).when(F.col("l").contains("re"), 3)
    return n.select("canonical", tier.alias("tier")).filter("tier IS NOT NULL")


def win22_section_ids(spark: SparkSession, d: str) -> DataFrame:
    """Notes numbered inside their section."""
    n = table(spark, d, "notes")
    r = F.row_number().over(W.partitionBy("source_id", "section").orderBy("chunk_id"))
    return n.select("chunk_id", F.format_string("%s_%03d", F.col("source_id"), r).alias("section_id"))


def top03_blocked(spark: SparkSession, d: str) -> DataFrame:
    """For each section the three most frequent opposed names of its notes (ties: least)."""
    a, n = _t(spark, d, "note_arguing_against", "notes")
    c = a.filter("resolved_canonical IS NOT NULL").join(n.select("chunk_id", "section"), "chunk_id").filter("section IS NOT NULL").groupBy("section", "resolved_canonical").agg(F.count(F.lit(1)).alias("k"))
    return c.withColumn("place", F.row_number().over(W.partitionBy("section").orderBy(F.desc("k"), "resolved_canonical"))).filter("place <= 3")


def top08_best_name(spark: SparkSession, d: str) -> DataFrame:
    """Of the names that begin alike in twelve letters the one with the most mentions."""
    nn = table(spark, d, "note_names").filter("length(canonical) >= 12").groupBy("canonical").agg(F.count(F.lit(1)).alias("n"))
    return nn.groupBy(F.substring("canonical", 1, 12).alias("head")).agg(F.min_by("canonical", F.struct(-F.col("n"), F.col("canonical"))).alias("best"))


def set03_both_ends(spark: SparkSession, d: str) -> DataFrame:
    """Names both mentioned and opposed, but not cited as works: an intersection and a difference."""
    nn, a, c = _t(spark, d, "note_names", "note_arguing_against", "note_citations")
    return nn.select("canonical").intersect(a.select("resolved_canonical")).subtract(c.select("cited")).filter("canonical IS NOT NULL")


def set08_candidate_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of spellings by fold or by fold without blanks, each set once."""
    n = table(spark, d, "names").select("canonical").distinct().withColumn("f", folded(F.col("canonical")))
    two = n.select("canonical", "f").unionAll(n.select("canonical", F.replace("f", F.lit(" "), F.lit("")).alias("f")))
    g = two.groupBy("f").agg(F.array_sort(F.collect_set("canonical")).alias("m")).filter(F.size("m") > 1)
    return g.select(F.array_join("m", "|").alias("members")).distinct()


def set10_legs(spark: SparkSession, d: str) -> DataFrame:
    """Sources as alternatives of a leg: a title that several share is one leg."""
    s = table(spark, d, "sources").filter("title IS NOT NULL")
    return s.groupBy("title").agg(F.array_join(F.array_sort(F.collect_set("source_id")), "|").alias("any_of"), F.count_distinct("source_id").alias("n"))


def sca05_scoped_locators(spark: SparkSession, d: str) -> DataFrame:
    """Surfaces that point into their own book, scoped by it."""
    nn = table(spark, d, "note_names").filter("canonical IS NOT NULL").select("canonical", "source_id").distinct()
    return nn.filter(F.col("canonical").rlike(LOCATOR) & F.col("source_id").isNotNull()).select("canonical", "source_id", F.concat("canonical", F.lit(" ["), "source_id", F.lit("]")).alias("scoped"))


def sca42_canonical_places(spark: SparkSession, d: str) -> DataFrame:
    """Cited places split at `and`, each part looked up: mapped, leak or candidate."""
    c, n = _t(spark, d, "note_arguing_against", "names")
    p = c.filter("resolved_canonical IS NOT NULL").select(F.col("resolved_canonical").alias("v")).distinct()
    parts = p.select("v", F.explode(F.split("v", r"\s+and\s+")).alias("part"))
    hit = parts.join(n.select(F.col("canonical").alias("part"), F.lit(1).alias("hit")).distinct(), "part", "left").groupBy("v").agg(F.count(F.lit(1)).alias("parts"), F.count("hit").alias("hits"))
    return hit.select("v", F.when((F.col("parts") == 1) & (F.col("hits") == 1), "mapped").when((F.col("parts") > 1) & (F.col("hits") == F.col("parts")), "leak").otherwise("candidate").alias("state"))


def sca61_estimated_cost(spark: SparkSession, d: str) -> DataFrame:
    """Cost by the model's dearest known price per token; null where it has none."""
    r = table(spark, d, "run_log").distinct()
    price = r.filter("usd > 0 AND tokens > 0").groupBy("model").agg(F.round(F.max(F.col("usd") / F.col("tokens")), 9).alias("price"))
    return r.groupBy("model").agg(F.sum("tokens").alias("tokens")).join(price, "model", "left").select("model", "tokens", F.round(F.col("tokens") * F.col("price"), 4).alias("usd"))


def vec21_bare_surnames(spark: SparkSession, d: str) -> DataFrame:
    """A surname alone to the one full person name that ends in it."""
    n = table(spark, d, "names").select("canonical", "kind").distinct()
    bare = n.filter("canonical NOT LIKE '% %'").select(F.col("canonical").alias("bare"))
    full = n.filter("kind = 'person'").filter(F.col("canonical").rlike("^[A-Z][a-z]+ [A-Z][a-z]+$")).select(F.col("canonical").alias("full"), F.substring_index("canonical", " ", -1).alias("bare")).distinct()
    return bare.distinct().join(full, "bare").groupBy("bare").agg(F.count(F.lit(1)).alias("k"), F.min("full").alias("full")).filter("k = 1").select("bare", "full")


def vec24_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Of each name its sources, counted, with the first in order."""
    nn = table(spark, d, "note_names").filter("source_id IS NOT NULL AND canonical IS NOT NULL")
    return nn.groupBy("canonical").agg(F.count_distinct("source_id").alias("sources"), F.min("source_id").alias("first"))


def vec30_contested(spark: SparkSession, d: str) -> DataFrame:
    """Names by the first of three signs of dispute that holds."""
    nn, a, c = _t(spark, d, "note_names", "note_arguing_against", "note_citations")
    foe = a.filter("resolved_canonical IS NOT NULL").select(F.col("resolved_canonical").alias("canonical")).distinct().withColumn("foe", F.lit(1))
    foil = c.filter("lower(stance) = 'foil'").select("chunk_id").distinct().withColumn("foil", F.lit(1))
    back = a.select("chunk_id").distinct().withColumn("back", F.lit(1))
    g = nn.select("chunk_id", "canonical").distinct().join(foil, "chunk_id", "left").join(back, "chunk_id", "left").groupBy("canonical").agg(F.max("foil").alias("foil"), F.max("back").alias("back"))
    s = g.join(foe, "canonical", "left")
    return s.select("canonical", F.when(F.col("foe") == 1, "opposed").when(F.col("foil") == 1, "foil").when(F.col("back") == 1, "in dispute").alias("sign")).filter("sign IS NOT NULL")


def str13_outstanding(spark: SparkSession, d: str) -> DataFrame:
    """Sources and passes that have no done run: what a resumed pass would do."""
    s, r = _t(spark, d, "sources", "run_log")
    passes = r.select("pass_name").distinct()
    want = s.select("source_id").distinct().withColumn("pass_name", F.explode(F.lit(sorted(x[0] for x in passes.collect()))))
    return want.join(r.filter("status = 'done'").select("source_id", "pass_name").distinct(), ["source_id", "pass_name"], "left_anti")


def str05_first_done(spark: SparkSession, d: str) -> DataFrame:
    """The run that completes each source and pass: the first done one by time."""
    r = table(spark, d, "run_log").filter("status = 'done'").distinct().withColumn("k", F.concat_ws("|", "source_id", "pass_name"))
    return first_of_each(r, "k", ["logged_at", "arrived_at", "tokens"]).select("source_id", "pass_name", "logged_at")


QUERIES = {k: v for k, v in list(globals().items()) if k[:3] in ("flt", "joi", "agg", "win", "top", "set", "sca", "vec", "str") and getattr(v, "__module__", "") == __name__}

_A = f"'{ABSTENTION}'"
_K = ", ".join(f"'{k}'" for k in KINDS)
_L = ", ".join(f"'{x}'" for x in LANDED)
_FOLD = r"regexp_replace(lower(trim(regexp_replace(regexp_replace(regexp_replace(canonical, '[-‐‑‒–—]', ' ', 'g'), '[^\p{L}\p{N}\p{M}_\s]|\p{Lm}', '', 'g'), '[\s\x{00A0}]+', ' ', 'g'))), 'aa+', 'a', 'g')"

SQL = {
    "flt02_key_presence": "SELECT event_id, coalesce(list_contains(json_keys(props), 'k'), false) AS has, json_extract_string(props, '$.k')::BIGINT AS k FROM events",
    "flt20_routes": "SELECT CASE WHEN kind IN ('table', 'figure') THEN 'artifact' WHEN kind IN ('period', 'concept') THEN 'apparatus' ELSE 'prose' END AS route, count(*) AS mentions FROM note_names GROUP BY 1",
    "flt33_answer_fields": f"SELECT chunk_id, coalesce(concat_ws(',', CASE WHEN lower(trim(claim)) <> {_A} THEN 'claim' END, CASE WHEN lower(trim(position)) <> {_A} THEN 'position' END, CASE WHEN lower(trim(section)) <> {_A} THEN 'section' END), '') AS fields FROM notes",
    "flt38_bad_kinds": f"SELECT kind, count(*) AS mentions FROM note_names WHERE kind IS NULL OR kind NOT IN ({_K}) GROUP BY kind",
    "flt39_dangling_citations": "SELECT DISTINCT chunk_id, cited FROM note_citations WHERE chunk_id IS NOT NULL AND chunk_id NOT IN (SELECT chunk_id FROM notes)",
    "flt40_balanced_sources": "WITH n AS (SELECT source_id, chunk_id IN (SELECT chunk_id FROM note_arguing_against) AS foe, position IS NULL AS s FROM notes) SELECT source_id, bool_or(foe) AS opposes, bool_and(s) AS silent, bool_or(foe) OR bool_and(s) AS valid FROM n GROUP BY source_id",
    "joi05_opposing_notes": f"SELECT DISTINCT resolved_canonical, chunk_id, section FROM note_arguing_against JOIN notes n USING (chunk_id) WHERE NOT back_matter AND resolved_canonical IN ({_L})",
    "joi15_positions_on": f"SELECT position, count(*) AS hits, count(DISTINCT source_id) AS sources FROM notes WHERE position IS NOT NULL AND NOT back_matter AND lower(trim(position)) <> {_A} AND chunk_id IN (SELECT chunk_id FROM note_names WHERE canonical = '{LANDED[0]}') GROUP BY position",
    "joi16_corridor": f"WITH e AS (SELECT DISTINCT a.resolved_canonical AS x, nn.canonical AS y FROM note_arguing_against a JOIN note_names nn USING (chunk_id) WHERE a.resolved_canonical <> nn.canonical), b AS (SELECT x, y FROM e UNION SELECT y, x FROM e) SELECT x AS near, y AS far FROM b WHERE x IN ({_L}) AND y NOT IN ({_L})",
    "joi20_merged_stances": "WITH g AS (SELECT chunk_id, cited, string_agg(DISTINCT lower(stance), '+' ORDER BY lower(stance)) AS stances, max(source_id) AS source_id FROM note_citations WHERE stance IS NOT NULL AND cited IS NOT NULL GROUP BY 1, 2) SELECT chunk_id, cited, stances, coalesce(title = cited, false) AS self FROM g LEFT JOIN sources USING (source_id)",
    "joi23_chapter_sections": "WITH k AS (SELECT section, arg_min(chapter, (-k, chapter)) AS guess FROM (SELECT section, chapter, count(*) AS k FROM notes WHERE chapter IS NOT NULL GROUP BY 1, 2) GROUP BY section) SELECT chunk_id, n.section, guess FROM notes n LEFT JOIN k ON k.section = n.section WHERE chapter IS NULL",
    "joi24_links": "SELECT chunk_id, resolved_canonical, string_agg(DISTINCT canonical, '|' ORDER BY canonical) AS links FROM note_arguing_against a JOIN note_names nn USING (chunk_id) WHERE canonical <> resolved_canonical AND canonical IN (SELECT canonical FROM names) GROUP BY 1, 2",
    "joi25_packets": f"SELECT chunk_id, author, year, coalesce(position, claim) AS said FROM notes LEFT JOIN sources USING (source_id) WHERE chunk_id IN (SELECT chunk_id FROM note_names WHERE canonical = '{LANDED[1]}')",
    "joi29_opposed_notes": "SELECT canonical, against, foes, about FROM (SELECT resolved_canonical AS canonical, count(DISTINCT chunk_id) AS against, count(DISTINCT source_id) AS foes FROM note_arguing_against WHERE resolved_canonical IS NOT NULL GROUP BY 1) JOIN (SELECT canonical, count(DISTINCT chunk_id) AS about FROM note_names GROUP BY 1) USING (canonical)",
    "joi30_candidates": f"""WITH m AS (SELECT chunk_id FROM note_names WHERE canonical = '{LANDED[0]}'), u AS (SELECT chunk_id, 1 AS place FROM note_arguing_against WHERE resolved_canonical = '{LANDED[0]}' UNION ALL SELECT chunk_id, 2 FROM note_citations WHERE lower(stance) = 'foil' AND chunk_id IN (SELECT * FROM m)
        UNION ALL SELECT chunk_id, 3 FROM note_arguing_against WHERE chunk_id IN (SELECT * FROM m) UNION ALL SELECT chunk_id, 4 FROM notes WHERE position IS NOT NULL AND chunk_id IN (SELECT * FROM m)) SELECT chunk_id, min(place) AS place FROM u GROUP BY chunk_id ORDER BY 2, 1 LIMIT 20""",
    "joi32_same_members": "WITH g AS (SELECT chunk_id, md5(string_agg(DISTINCT canonical, '|' ORDER BY canonical)) AS key, count(DISTINCT canonical) AS names FROM note_names WHERE canonical IS NOT NULL AND chunk_id IS NOT NULL GROUP BY chunk_id) SELECT chunk_id, first, names FROM g JOIN (SELECT key, min(chunk_id) AS first FROM g GROUP BY key HAVING count(*) > 1) USING (key)",
    "joi33_reusable_claims": f"WITH k AS (SELECT chunk_id, year, md5(claim) AS key FROM notes JOIN sources USING (source_id) WHERE claim IS NOT NULL AND lower(trim(claim)) <> {_A} AND year IS NOT NULL) SELECT chunk_id, key FROM k JOIN (SELECT key, min(year) AS first FROM k GROUP BY key) USING (key) WHERE year > first",
    "joi39_bibliography": "SELECT cited, notes, row_number() OVER (PARTITION BY left(cited, 1) ORDER BY cited) AS n FROM (SELECT cited, count(DISTINCT chunk_id) AS notes FROM note_citations WHERE lower(stance) = 'support' AND cited IS NOT NULL GROUP BY 1)",
    "agg27_stance_mix": "SELECT source_id, count(*) FILTER (lower(stance) = 'support') AS support, count(*) FILTER (lower(stance) = 'foil') AS foil, count(*) FILTER (lower(stance) = 'authority') AS authority FROM note_citations WHERE source_id IS NOT NULL GROUP BY source_id",
    "agg28_cross_source_rate": "SELECT count(*) AS works, round(avg((k >= 2)::INT), 9) AS rate FROM (SELECT cited, count(DISTINCT source_id) AS k FROM note_citations WHERE cited IS NOT NULL GROUP BY 1)",
    "agg29_grounds": "SELECT round(avg(k), 9) AS mean, quantile_cont(k, 0.5) AS median, round(avg((k >= 2)::INT), 9) AS several FROM (SELECT chunk_id, count(*) AS k FROM note_citations GROUP BY 1)",
    "agg57_stratified": "SELECT kind, canonical, r FROM (SELECT kind, canonical, row_number() OVER (PARTITION BY kind ORDER BY md5('7|' || canonical), canonical) AS r FROM names WHERE kind IS NOT NULL) WHERE r <= 5",
    "agg71_canary": "SELECT pass_name, round(avg((status <> 'done')::INT), 9) AS bad, max(duration_sec) AS longest, avg((status <> 'done')::INT) >= 0.2 OR max(duration_sec) > 60 AS fails FROM (SELECT DISTINCT * FROM run_log) GROUP BY pass_name",
    "win06_author_spread": "WITH j AS (SELECT chapter, chunk_id, author FROM notes LEFT JOIN sources USING (source_id) WHERE chapter IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY chapter, coalesce(author, '') ORDER BY chunk_id) AS k FROM j), t AS (SELECT *, row_number() OVER (PARTITION BY chapter ORDER BY k, coalesce(author, '')) AS turn FROM r) SELECT chapter, chunk_id, author, turn FROM t WHERE turn <= 50",
    "win10_first_tier": "SELECT * FROM (SELECT DISTINCT canonical, CASE WHEN starts_with(lower(canonical), 'the ') THEN 1 WHEN contains(' ' || lower(canonical) || ' ', ' of ') THEN 2 WHEN contains(lower(canonical), 're') THEN 3 END AS tier FROM names) WHERE tier IS NOT NULL",
    "win22_section_ids": "SELECT chunk_id, printf('%s_%03d', source_id, row_number() OVER (PARTITION BY source_id, section ORDER BY chunk_id)) AS section_id FROM notes",
    "top03_blocked": "SELECT * FROM (SELECT section, resolved_canonical, count(*) AS k, row_number() OVER (PARTITION BY section ORDER BY count(*) DESC, resolved_canonical) AS place FROM note_arguing_against JOIN notes USING (chunk_id) WHERE resolved_canonical IS NOT NULL AND section IS NOT NULL GROUP BY 1, 2) WHERE place <= 3",
    "top08_best_name": "SELECT left(canonical, 12) AS head, arg_min(canonical, (-n, canonical)) AS best FROM (SELECT canonical, count(*) AS n FROM note_names WHERE length(canonical) >= 12 GROUP BY 1) GROUP BY 1",
    "set03_both_ends": "SELECT canonical FROM (SELECT canonical FROM note_names INTERSECT SELECT resolved_canonical FROM note_arguing_against EXCEPT SELECT cited FROM note_citations) WHERE canonical IS NOT NULL",
    "set08_candidate_groups": f"WITH n AS (SELECT DISTINCT canonical, {_FOLD} AS f FROM names), t AS (SELECT canonical, f FROM n UNION ALL SELECT canonical, replace(f, ' ', '') FROM n) SELECT DISTINCT members FROM (SELECT string_agg(DISTINCT canonical, '|' ORDER BY canonical) AS members FROM t GROUP BY f HAVING count(DISTINCT canonical) > 1)",
    "set10_legs": "SELECT title, string_agg(DISTINCT source_id, '|' ORDER BY source_id) AS any_of, count(DISTINCT source_id) AS n FROM sources WHERE title IS NOT NULL GROUP BY title",
    "sca05_scoped_locators": f"SELECT DISTINCT canonical, source_id, canonical || ' [' || source_id || ']' AS scoped FROM note_names WHERE regexp_matches(canonical, '{LOCATOR}') AND source_id IS NOT NULL",
    "sca42_canonical_places": r"WITH p AS (SELECT DISTINCT resolved_canonical AS v FROM note_arguing_against WHERE resolved_canonical IS NOT NULL), q AS (SELECT v, unnest(regexp_split_to_array(v, '\s+and\s+')) AS part FROM p), h AS (SELECT v, count(*) AS parts, count(*) FILTER (part IN (SELECT canonical FROM names)) AS hits FROM q GROUP BY v) SELECT v, CASE WHEN parts = 1 AND hits = 1 THEN 'mapped' WHEN parts > 1 AND hits = parts THEN 'leak' ELSE 'candidate' END AS state FROM h",
    "sca61_estimated_cost": "WITH r AS (SELECT DISTINCT * FROM run_log), p AS (SELECT model, round(max(usd / tokens), 9) AS price FROM r WHERE usd > 0 AND tokens > 0 GROUP BY 1) SELECT t.model, tokens::BIGINT AS tokens, round(tokens * price, 4) AS usd FROM (SELECT model, sum(tokens) AS tokens FROM r GROUP BY 1) t LEFT JOIN p USING (model)",
    "vec21_bare_surnames": "WITH n AS (SELECT DISTINCT canonical, kind FROM names), f AS (SELECT DISTINCT canonical AS full_name, split_part(canonical, ' ', 2) AS bare FROM n WHERE kind = 'person' AND regexp_matches(canonical, '^[A-Z][a-z]+ [A-Z][a-z]+$')) SELECT bare, min(full_name) AS \"full\" FROM f WHERE bare IN (SELECT canonical FROM n WHERE NOT contains(canonical, ' ')) GROUP BY bare HAVING count(*) = 1",
    "vec24_evidence": "SELECT canonical, count(DISTINCT source_id) AS sources, min(source_id) AS first FROM note_names WHERE source_id IS NOT NULL AND canonical IS NOT NULL GROUP BY canonical",
    "vec30_contested": "SELECT * FROM (SELECT canonical, CASE WHEN canonical IN (SELECT resolved_canonical FROM note_arguing_against WHERE resolved_canonical IS NOT NULL) THEN 'opposed' WHEN bool_or(chunk_id IN (SELECT chunk_id FROM note_citations WHERE lower(stance) = 'foil')) THEN 'foil' WHEN bool_or(chunk_id IN (SELECT chunk_id FROM note_arguing_against)) THEN 'in dispute' END AS sign FROM note_names GROUP BY canonical) WHERE sign IS NOT NULL",
    "str13_outstanding": "SELECT s.source_id, p.pass_name FROM (SELECT DISTINCT source_id FROM sources) s, (SELECT DISTINCT pass_name FROM run_log) p WHERE NOT EXISTS (SELECT 1 FROM run_log r WHERE r.status = 'done' AND r.source_id = s.source_id AND r.pass_name = p.pass_name)",
    "str05_first_done": "SELECT source_id, pass_name, min(logged_at) AS logged_at FROM run_log WHERE status = 'done' GROUP BY 1, 2",
}
