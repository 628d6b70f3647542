"""Audit queries: run log, costs, rates, gates, events, and the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.shapes import ABSTENTION
from ..operators.ordered import batches, first_of_each, within_budget
from ..session import table


def _log(spark: SparkSession, d: str) -> DataFrame:
    """The run log without repeated rows."""
    return table(spark, d, "run_log").distinct()


def agg14_chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    """Per collection: texts, least, greatest, mean and median length, texts outside the band 3 500 - 9 000."""
    t = table(spark, d, "documents").filter("text IS NOT NULL").withColumn("n", F.length("text"))
    return t.groupBy("source").agg(F.count(F.lit(1)).alias("texts"), F.min("n").alias("least"), F.max("n").alias("greatest"), F.round(F.avg("n"), 6).alias("mean"), F.percentile("n", 0.5).alias("median"), F.count_if(F.col("n") < 3500).alias("below"), F.count_if(F.col("n") > 9000).alias("above"))


def agg15_abstention_rates(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "notes")
    u = n.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("v")) for c in ("claim", "position")])).alias("x")).select("x.*").filter("v IS NOT NULL")
    return u.groupBy("field").agg(F.count(F.lit(1)).alias("records"), F.bround(F.avg((F.lower(F.trim("v")) == ABSTENTION).cast("double")), 4).alias("rate"))


def agg16_collapse_rates(spark: SparkSession, d: str) -> DataFrame:
    """The share of positions that are one of the ten most frequent ones (ties: least)."""
    p = table(spark, d, "notes").filter("position IS NOT NULL").select(F.lower(F.trim("position")).alias("p"))
    top = p.groupBy("p").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "p").limit(10)
    return p.join(F.broadcast(top.select("p", F.lit(1).alias("hit"))), "p", "left").agg(F.count(F.lit(1)).alias("records"), F.round(F.avg(F.coalesce("hit", F.lit(0)).cast("double")), 6).alias("rate"))


def agg18_cost_report(spark: SparkSession, d: str) -> DataFrame:
    """Dollars per done run of a pass, carried to all sources; null where no run is priced."""
    g = _log(spark, d).filter("status = 'done'").groupBy("pass_name").agg(F.count("usd").alias("priced"), F.sum("usd").alias("usd"))
    n = table(spark, d, "sources").agg(F.count(F.lit(1)).alias("n")).scalar()
    return g.select("pass_name", "priced", F.round(F.try_divide("usd", "priced"), 9).alias("each"), F.round(F.try_divide("usd", "priced") * n, 6).alias("corpus"))


def agg20_latency(spark: SparkSession, d: str) -> DataFrame:
    """Seconds by pass with the total: a rollup."""
    r = _log(spark, d).rollup("pass_name").agg(F.grouping("pass_name").alias("total"), F.round(F.sum("duration_sec"), 3).alias("seconds"), F.count(F.lit(1)).alias("runs"))
    return r.select(F.when(F.col("total") == 1, "all").otherwise(F.col("pass_name")).alias("pass_name"), "seconds", "runs")


def agg37_pooled_usage(spark: SparkSession, d: str) -> DataFrame:
    """Mean tokens by model over the sources whose most frequent model it is (ties: least)."""
    r = _log(spark, d).filter("source_id IS NOT NULL AND model IS NOT NULL")
    mode = r.groupBy("source_id", "model").agg(F.count(F.lit(1)).alias("n")).groupBy("source_id").agg(F.min_by("model", F.struct(-F.col("n"), F.col("model"))).alias("model"))
    t = r.filter("tokens IS NOT NULL").groupBy("source_id").agg(F.sum("tokens").alias("tokens"))
    return mode.join(t, "source_id", "left").groupBy("model").agg(F.count(F.lit(1)).alias("sources"), F.round(F.avg("tokens"), 4).alias("tokens"))


def agg38_quorum(spark: SparkSession, d: str) -> DataFrame:
    """Per source the share of runs with the most frequent status."""
    c = _log(spark, d).groupBy("source_id", "status").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("source_id").agg(F.round(F.max("n") / F.sum("n"), 9).alias("quorum"), F.sum("n").alias("runs"))


def agg39_cost_by_pass(spark: SparkSession, d: str) -> DataFrame:
    """Dollars per pass, null where any done run is unpriced."""
    r = _log(spark, d).filter("status = 'done'").groupBy("pass_name").agg(F.sum("usd").alias("usd"), F.bool_and(F.col("usd").isNotNull()).alias("whole"))
    return r.select("pass_name", F.when(F.col("whole"), F.round("usd", 6)).alias("usd"), "whole")


def agg41_spend_since(spark: SparkSession, d: str) -> DataFrame:
    """Per model the spend, tokens and runs of each day; a sum of nothing is null."""
    r = _log(spark, d).withColumn("day", F.date_trunc("DAY", "logged_at"))
    return r.groupBy("model", "day").agg(F.round(F.sum("usd"), 6).alias("usd"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("runs"))


def agg44_rate_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Per pass the share of done runs against 0.8, within 1e-9; three-valued pass."""
    r = _log(spark, d).groupBy("pass_name").agg(F.count_if(F.col("status") == "done").alias("numerator"), F.count(F.lit(1)).alias("n"))
    v = F.try_divide("numerator", "n")
    return r.select("pass_name", "numerator", "n", F.round(v, 9).alias("value"), F.when(F.col("n") > 0, v >= 0.8 - 1e-9).alias("passed"))


def agg45_calibration(spark: SparkSession, d: str) -> DataFrame:
    """By true level: labels, observed mean, and whether the means rise."""
    l = table(spark, d, "reading_labels").filter("level IS NOT NULL")
    m = l.groupBy("doc_id").agg(F.min("level").alias("band"), F.avg("level").alias("level"))
    g = m.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("level"), 9).alias("observed"))
    return g.withColumn("rises", F.coalesce(F.col("observed") > F.lag("observed").over(W.orderBy("band")), F.lit(True)))


def agg54_panel(spark: SparkSession, d: str) -> DataFrame:
    """Per document the lower median level and the spread of its raters."""
    l = table(spark, d, "reading_labels").filter("level IS NOT NULL")
    return l.groupBy("doc_id").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY level)").alias("median"), (F.max("level") - F.min("level")).alias("spread"), F.count(F.lit(1)).alias("raters"))


def agg59_size_bands(spark: SparkSession, d: str) -> DataFrame:
    nn = table(spark, d, "note_names").groupBy("canonical").agg(F.count(F.lit(1)).alias("n"))
    band = F.when(F.col("n") < 10, "small").when(F.col("n") < 30, "medium").otherwise("large")
    return nn.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("names"), F.sum("n").alias("mentions"))


def agg65_repetition(spark: SparkSession, d: str) -> DataFrame:
    """Five-word shingles of claims that stand in two sections or more, over all distinct ones."""
    n = table(spark, d, "notes").filter("claim IS NOT NULL AND section IS NOT NULL")
    w = n.select("section", F.filter(F.split(F.regexp_replace(F.lower("claim"), "[^a-z0-9]+", " "), " "), lambda x: x != "").alias("w")).filter(F.size("w") >= 5)
    g = w.select("section", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 4), lambda i: F.array_join(F.slice("w", i, 5), " "))).alias("g")).distinct().groupBy("g").agg(F.count(F.lit(1)).alias("k"))
    return g.agg(F.count(F.lit(1)).alias("shingles"), F.count_if(F.col("k") >= 2).alias("shared"))


def agg69_run_report(spark: SparkSession, d: str) -> DataFrame:
    """Per pass: runs, the median, runs slower than twice it, failures."""
    r = _log(spark, d)
    r = r.join(r.groupBy("pass_name").agg(F.percentile("duration_sec", 0.5).alias("median")), "pass_name")
    return r.groupBy("pass_name").agg(F.count(F.lit(1)).alias("runs"), F.round(F.first("median"), 6).alias("median"), F.count_if(F.col("duration_sec") > 2 * F.col("median")).alias("slow"), F.count_if(F.col("status") != "done").alias("not_done"))


def agg70_stage_counts(spark: SparkSession, d: str) -> DataFrame:
    """Runs by pass and status as a pivot over the statuses at hand."""
    r = _log(spark, d)
    return r.groupBy("pass_name").agg(*[F.count_if(F.col("status") == s).alias(f"{s}_runs") for s in ("done", "failed", "skipped")], F.count(F.lit(1)).alias("runs"))


def agg76_corpus_pin(spark: SparkSession, d: str) -> DataFrame:
    """One hash for the whole set of source ids: of the pins of its parts by hash, in order; no list of all ids is made."""
    s = table(spark, d, "sources").select("source_id").distinct().withColumn("part", F.substring(F.md5("source_id"), 1, 3))
    parts = s.groupBy("part").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("source_id")), "\n"), 256).alias("pin"), F.count(F.lit(1)).alias("n"))
    return parts.agg(F.substring(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "pin"))), lambda p: p["pin"]), "\n"), 256), 1, 16).alias("pin"), F.sum("n").alias("sources"))


def win16_budget_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Per source the notes whose claims fit 2 000 characters together, stopping at the first that does not."""
    n = table(spark, d, "notes").filter("claim IS NOT NULL").withColumn("size", F.length("claim"))
    return within_budget(n, ["source_id"], ["chunk_id"], "size", 2000).select("source_id", "chunk_id", "used")


def win17_greedy_batches(spark: SparkSession, d: str) -> DataFrame:
    """Per source the claims in greedy batches of 1 000 characters."""
    n = table(spark, d, "notes").filter("claim IS NOT NULL").withColumn("size", F.length("claim"))
    return batches(n, ["source_id"], "chunk_id", "size", 1000)


def win19_slices(spark: SparkSession, d: str) -> DataFrame:
    """Notes of a chapter in slices of 55."""
    n = table(spark, d, "notes").filter("chapter IS NOT NULL")
    return n.withColumn("slice", F.floor((F.row_number().over(W.partitionBy("chapter", "source_id").orderBy("chunk_id")) - 1) / 55)).select("chapter", "chunk_id", "slice")


def win25_event_numbers(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", "user_id", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("seq"))


def win26_quiet_users(spark: SparkSession, d: str) -> DataFrame:
    """Users whose last gap is longer than their mean one."""
    e = table(spark, d, "events")
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    g = e.withColumn("gap", F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))).withColumn("r", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))))
    u = g.groupBy("user_id").agg(F.avg("gap").alias("mean"), F.max(F.when(F.col("r") == 1, F.col("gap"))).alias("last"))
    return u.filter("last > mean").select("user_id")


def top06_latest_runs(spark: SparkSession, d: str) -> DataFrame:
    """The five latest runs of each model."""
    r = _log(spark, d)
    w = W.partitionBy("model").orderBy(F.desc("logged_at"), "source_id", "pass_name")
    return r.withColumn("place", F.row_number().over(w)).filter("place <= 5").select("model", "source_id", "pass_name", "logged_at", "place")


def joi22_preceding_purchase(spark: SparkSession, d: str) -> DataFrame:
    """As-of: every error event with the user's latest purchase at or before it."""
    e = table(spark, d, "events").filter("event_type IN ('error', 'purchase')")
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    return e.withColumn("purchase", F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w)).filter("event_type = 'error'").select("event_id", "user_id", "purchase")


def str04_stale_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of a user ended by six hours of silence."""
    e = table(spark, d, "events")
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    s = e.withColumn("new", (F.coalesce(us - F.lag(us).over(w), F.lit(10**15)) > 6 * 3600 * 10**6).cast("int")).withColumn("session", F.sum("new").over(w))
    return s.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("events"), F.min("ts").alias("started"), F.max("ts").alias("ended"))


def str09_daily_quota(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user by UTC day and whether they pass three."""
    e = table(spark, d, "events")
    return e.groupBy("user_id", F.date_trunc("DAY", "ts").alias("day")).agg(F.count(F.lit(1)).alias("events")).withColumn("over", F.col("events") > 3)


def str17_first_writer(spark: SparkSession, d: str) -> DataFrame:
    """The first row of each source and pass by arrival stays."""
    r = _log(spark, d).withColumn("k", F.concat_ws("|", "source_id", "pass_name"))
    return first_of_each(r, "k", ["arrived_at", "logged_at", "status", "tokens"]).select("source_id", "pass_name", "arrived_at")


def str19_filled_nulls(spark: SparkSession, d: str) -> DataFrame:
    """usd filled where null by the mean price per token of the pass."""
    r = _log(spark, d)
    p = r.filter("usd IS NOT NULL AND tokens > 0").groupBy("pass_name").agg((F.sum("usd") / F.sum("tokens")).alias("price"))
    return r.join(F.broadcast(p), "pass_name", "left").select("source_id", "pass_name", "logged_at", "arrived_at", F.round(F.coalesce("usd", F.col("tokens") * F.col("price")), 7).alias("usd"))


def set04_reachable(spark: SparkSession, d: str) -> DataFrame:
    """Regions, nations and customers of each region by a recursive walk: how many of each depth."""
    for t in ("region", "nation", "customer"):
        table(spark, d, t).createOrReplaceTempView(f"walk_{t}")
    return spark.sql("""
        WITH RECURSIVE edges AS (SELECT concat('r', n_regionkey) AS parent, concat('n', n_nationkey) AS child FROM walk_nation UNION ALL SELECT concat('n', c_nationkey), concat('c', c_custkey) FROM walk_customer),
        walk(root, node, depth) AS (SELECT concat('r', r_regionkey), concat('r', r_regionkey), 0 FROM walk_region UNION ALL SELECT w.root, e.child, w.depth + 1 FROM walk w JOIN edges e ON e.parent = w.node)
        SELECT root, depth, count(*) AS nodes FROM walk GROUP BY root, depth""")


def tpc01_pricing(spark: SparkSession, d: str) -> DataFrame:
    """Line items by flag and status: sums and means."""
    l = table(spark, d, "lineitem").filter("l_shipdate <= timestamp_ntz'1998-09-02'")
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("revenue"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.count(F.lit(1)).alias("n"))


def tpc05_region_revenue(spark: SparkSession, d: str) -> DataFrame:
    """Revenue by nation of customers; the fixed dimensions are broadcast by their size."""
    l, o, c, n, r = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "nation", "region"))
    j = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


QUERIES = {k: v for k, v in list(globals().items()) if k[:3] in ("agg", "win", "top", "joi", "str", "set", "tpc") and getattr(v, "__module__", "") == __name__}

_L = "(SELECT DISTINCT * FROM run_log)"
_STATED = f"lower(trim(v)) = '{ABSTENTION}'"

SQL = {
    "agg14_chunk_stats": "SELECT source, count(*) AS texts, min(length(text)) AS least, max(length(text)) AS greatest, round(avg(length(text)), 6) AS mean, quantile_cont(length(text), 0.5) AS median, count(*) FILTER (length(text) < 3500) AS below, count(*) FILTER (length(text) > 9000) AS above FROM documents WHERE text IS NOT NULL GROUP BY source",
    "agg15_abstention_rates": f"SELECT field, count(*) AS records, round_even(avg(({_STATED})::INT), 4) AS rate FROM (SELECT 'claim' AS field, claim AS v FROM notes UNION ALL SELECT 'position', position FROM notes) WHERE v IS NOT NULL GROUP BY field",
    "agg16_collapse_rates": "WITH p AS (SELECT lower(trim(position)) AS p FROM notes WHERE position IS NOT NULL), t AS (SELECT p FROM p GROUP BY p ORDER BY count(*) DESC, p LIMIT 10) SELECT count(*) AS records, round(avg((p IN (SELECT p FROM t))::INT), 6) AS rate FROM p",
    "agg18_cost_report": f"SELECT pass_name, count(usd) AS priced, round(CASE WHEN count(usd) > 0 THEN sum(usd) / count(usd) END, 9) AS each, round(CASE WHEN count(usd) > 0 THEN sum(usd) / count(usd) END * (SELECT count(*) FROM sources), 6) AS corpus FROM {_L} WHERE status = 'done' GROUP BY pass_name",
    "agg20_latency": f"SELECT CASE WHEN grouping(pass_name) = 1 THEN 'all' ELSE pass_name END AS pass_name, round(sum(duration_sec), 3) AS seconds, count(*) AS runs FROM {_L} GROUP BY ROLLUP (pass_name)",
    "agg37_pooled_usage": f"WITH r AS (SELECT * FROM {_L} WHERE source_id IS NOT NULL AND model IS NOT NULL), m AS (SELECT source_id, arg_min(model, (-n, model)) AS model FROM (SELECT source_id, model, count(*) AS n FROM r GROUP BY ALL) GROUP BY 1), t AS (SELECT source_id, sum(tokens) AS tokens FROM r WHERE tokens IS NOT NULL GROUP BY 1) SELECT model, count(*) AS sources, round(avg(tokens), 4) AS tokens FROM m LEFT JOIN t USING (source_id) GROUP BY model",
    "agg38_quorum": f"SELECT source_id, round(max(n) / sum(n), 9) AS quorum, sum(n)::BIGINT AS runs FROM (SELECT source_id, status, count(*) AS n FROM {_L} GROUP BY ALL) GROUP BY source_id",
    "agg39_cost_by_pass": f"SELECT pass_name, CASE WHEN bool_and(usd IS NOT NULL) THEN round(sum(usd), 6) END AS usd, bool_and(usd IS NOT NULL) AS whole FROM {_L} WHERE status = 'done' GROUP BY pass_name",
    "agg41_spend_since": f"SELECT model, date_trunc('day', logged_at)::TIMESTAMP AS day, round(sum(usd), 6) AS usd, sum(tokens)::BIGINT AS tokens, count(*) AS runs FROM {_L} GROUP BY ALL",
    "agg44_rate_metrics": f"SELECT pass_name, count(*) FILTER (status = 'done') AS numerator, count(*) AS n, round(count(*) FILTER (status = 'done') / count(*), 9) AS value, count(*) FILTER (status = 'done') / count(*) >= 0.8 - 1e-9 AS passed FROM {_L} GROUP BY pass_name",
    "agg45_calibration": "WITH m AS (SELECT doc_id, min(level) AS band, avg(level) AS level FROM reading_labels WHERE level IS NOT NULL GROUP BY 1), g AS (SELECT band, count(*) AS n, round(avg(level), 9) AS observed FROM m GROUP BY 1) SELECT *, coalesce(observed > lag(observed) OVER (ORDER BY band), true) AS rises FROM g",
    "agg54_panel": "SELECT doc_id, quantile_disc(level, 0.5) AS median, max(level) - min(level) AS spread, count(*) AS raters FROM reading_labels WHERE level IS NOT NULL GROUP BY doc_id",
    "agg59_size_bands": "SELECT CASE WHEN n < 10 THEN 'small' WHEN n < 30 THEN 'medium' ELSE 'large' END AS band, count(*) AS names, sum(n)::BIGINT AS mentions FROM (SELECT canonical, count(*) AS n FROM note_names GROUP BY 1) GROUP BY 1",
    "agg65_repetition": "WITH w AS (SELECT section, list_filter(string_split(regexp_replace(lower(claim), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM notes WHERE claim IS NOT NULL AND section IS NOT NULL), g AS (SELECT DISTINCT section, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM w WHERE len(w) >= 5), k AS (SELECT g, count(*) AS k FROM g GROUP BY g) SELECT count(*) AS shingles, count(*) FILTER (k >= 2) AS shared FROM k",
    "agg69_run_report": f"SELECT r.pass_name, count(*) AS runs, round(any_value(m.median), 6) AS median, count(*) FILTER (duration_sec > 2 * m.median) AS slow, count(*) FILTER (status <> 'done') AS not_done FROM {_L} r JOIN (SELECT pass_name, quantile_cont(duration_sec, 0.5) AS median FROM {_L} GROUP BY 1) m USING (pass_name) GROUP BY r.pass_name",
    "agg70_stage_counts": f"SELECT pass_name, count(*) FILTER (status = 'done') AS done_runs, count(*) FILTER (status = 'failed') AS failed_runs, count(*) FILTER (status = 'skipped') AS skipped_runs, count(*) AS runs FROM {_L} GROUP BY pass_name",
    "agg76_corpus_pin": "SELECT left(sha256(string_agg(pin, chr(10) ORDER BY part)), 16) AS pin, sum(n)::BIGINT AS sources FROM (SELECT left(md5(source_id), 3) AS part, sha256(string_agg(source_id, chr(10) ORDER BY source_id)) AS pin, count(*) AS n FROM (SELECT DISTINCT source_id FROM sources) GROUP BY 1)",
    "win16_budget_prefix": "SELECT source_id, chunk_id, used::BIGINT AS used FROM (SELECT source_id, chunk_id, sum(length(claim)) OVER (PARTITION BY source_id ORDER BY chunk_id ROWS UNBOUNDED PRECEDING) AS used FROM notes WHERE claim IS NOT NULL) WHERE used <= 2000",
    "win17_greedy_batches": """WITH RECURSIVE n AS (SELECT source_id, chunk_id, length(claim) AS s, row_number() OVER (PARTITION BY source_id ORDER BY chunk_id) AS r FROM notes WHERE claim IS NOT NULL),
        b AS (SELECT source_id, chunk_id, r, 0 AS batch, s AS used FROM n WHERE r = 1 UNION ALL SELECT n.source_id, n.chunk_id, n.r, b.batch + CASE WHEN b.used + n.s > 1000 THEN 1 ELSE 0 END, CASE WHEN b.used + n.s > 1000 THEN n.s ELSE b.used + n.s END FROM b JOIN n ON n.source_id = b.source_id AND n.r = b.r + 1) SELECT source_id, chunk_id, batch FROM b""",
    "win19_slices": "SELECT chapter, chunk_id, (row_number() OVER (PARTITION BY chapter, source_id ORDER BY chunk_id) - 1) // 55 AS slice FROM notes WHERE chapter IS NOT NULL",
    "win25_event_numbers": "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events",
    "win26_quiet_users": "WITH g AS (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) SELECT user_id FROM g GROUP BY user_id HAVING max(gap) FILTER (r = 1) > avg(gap)",
    "top06_latest_runs": f"SELECT model, source_id, pass_name, logged_at, place FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY logged_at DESC, source_id, pass_name) AS place FROM {_L}) WHERE place <= 5",
    "joi22_preceding_purchase": "SELECT event_id, user_id, purchase FROM (SELECT *, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS purchase FROM events WHERE event_type IN ('error', 'purchase')) WHERE event_type = 'error'",
    "str04_stale_sessions": "WITH g AS (SELECT *, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 21600000000, true)::INT AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, session::BIGINT AS session, count(*) AS events, min(ts) AS started, max(ts) AS ended FROM s GROUP BY user_id, session",
    "str09_daily_quota": "SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS events, count(*) > 3 AS over FROM events GROUP BY ALL",
    "str17_first_writer": f"SELECT source_id, pass_name, arrived_at FROM (SELECT *, row_number() OVER (PARTITION BY source_id, pass_name ORDER BY arrived_at, logged_at, status, tokens) AS r FROM {_L}) WHERE r = 1",
    "str19_filled_nulls": f"WITH p AS (SELECT pass_name, sum(usd) / sum(tokens) AS price FROM {_L} WHERE usd IS NOT NULL AND tokens > 0 GROUP BY 1) SELECT source_id, r.pass_name, logged_at, arrived_at, round(coalesce(usd, tokens * price), 7) AS usd FROM {_L} r LEFT JOIN p USING (pass_name)",
    "set04_reachable": "WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer), w AS (SELECT 'r' || r_regionkey AS root, 'r' || r_regionkey AS node, 0 AS depth FROM region UNION ALL SELECT w.root, e.child, w.depth + 1 FROM w JOIN e ON e.parent = w.node) SELECT root, depth, count(*) AS nodes FROM w GROUP BY ALL",
    "tpc01_pricing": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_quantity), 6) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL",
    "tpc05_region_revenue": "SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL",
}
