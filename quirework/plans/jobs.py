"""Jobs as tables over the run log, and the name layer: alias nodes and surfaces by tier."""

from __future__ import annotations

from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.shapes import folded
from ..operators import vectors as V
from ..session import table

#: Seconds of silence after which a job is taken for dead.
ALIVE = 20


def _log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "run_log").filter("source_id IS NOT NULL").distinct()


def _last(spark: SparkSession, d: str) -> DataFrame:
    """(pass_name, source_id, logged_at, arrived_at, status, error): the last row of each job."""
    row = F.struct("logged_at", "arrived_at", F.coalesce("status", F.lit("")).alias("status"), F.coalesce("error", F.lit("")).alias("error"))
    return _log(spark, d).groupBy("pass_name", "source_id").agg(F.max(row).alias("r")).select("pass_name", "source_id", "r.*")


def str01_queue(spark: SparkSession, d: str) -> DataFrame:
    """The jobs of each pass in the order they came in."""
    first = _log(spark, d).groupBy("pass_name", "source_id").agg(F.min("logged_at").alias("since"))
    return first.select("pass_name", "source_id", F.row_number().over(W.partitionBy("pass_name").orderBy("since", "source_id")).alias("seq"))


def str02_claim(spark: SparkSession, d: str) -> DataFrame:
    """Of each pass the job to be claimed next: of those not ended the one that has waited longest; exactly one."""
    open_ = _last(spark, d).filter(~F.col("status").isin("done", "skipped"))
    return open_.groupBy("pass_name").agg(F.min_by("source_id", F.struct("logged_at", "source_id")).alias("source_id"))


def str03_heartbeats(spark: SparkSession, d: str) -> DataFrame:
    """The last sign of every job, and how many it gave."""
    return _log(spark, d).groupBy("pass_name", "source_id").agg(F.max("arrived_at").alias("seen"), F.count(F.lit(1)).alias("signs"))


def str06_failed(spark: SparkSession, d: str) -> DataFrame:
    """Jobs whose last word is a failure, with its error."""
    return _last(spark, d).filter("status = 'failed'").select("pass_name", "source_id", "error")


def str07_events_since(spark: SparkSession, d: str) -> DataFrame:
    """Events of every user after the tenth, replayed in order."""
    e = table(spark, d, "events")
    n = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select("user_id", "event_id", n.alias("seq")).filter("seq > 10")


def str12_alive(spark: SparkSession, d: str) -> DataFrame:
    """Of each pass: jobs not ended, and those seen within ALIVE seconds of the pass's last sign."""
    last = _last(spark, d)
    end = last.groupBy("pass_name").agg(F.max("arrived_at").alias("now"))
    live = ~F.col("status").isin("done", "skipped")
    near = F.col("arrived_at") >= F.col("now") - F.expr(f"INTERVAL {ALIVE} SECONDS")
    return last.join(end, "pass_name").groupBy("pass_name").agg(F.count_if(live).alias("open"), F.count_if(live & near).alias("alive"))


def str18_first_writer(spark: SparkSession, d: str) -> DataFrame:
    """The model whose end of a job came in first keeps it, however late the others were logged."""
    done = _log(spark, d).filter("status = 'done'")
    return done.groupBy("pass_name", "source_id").agg(F.min(F.struct("arrived_at", "logged_at", "model")).alias("r"), F.count(F.lit(1)).alias("writes")).select("pass_name", "source_id", "r.model", "writes")


def str20_to_do(spark: SparkSession, d: str) -> DataFrame:
    """A sweep over all sources and passes leaves out what is done: the pairs still to be run, by pass."""
    done = _log(spark, d).filter("status = 'done'").select("pass_name", "source_id").distinct()
    passes = table(spark, d, "run_log").select("pass_name").dropna().distinct()
    sources = table(spark, d, "sources").select("source_id").distinct().agg(F.count(F.lit(1)).alias("n"))
    known = done.join(table(spark, d, "sources").select("source_id").distinct(), "source_id", "left_semi").groupBy("pass_name").agg(F.count(F.lit(1)).alias("done"))
    return passes.join(known, "pass_name", "left").select("pass_name", F.coalesce("done", F.lit(0)).alias("done"), (sources.scalar() - F.coalesce("done", F.lit(0))).alias("to_do"))


def vec17_alias_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of spellings that fold alike: the most mentioned one (ties: least) is canonical, the others its aliases."""
    names = table(spark, d, "names").select("canonical").dropna().distinct()
    n = table(spark, d, "note_names").groupBy("canonical").agg(F.count(F.lit(1)).alias("n"))
    s = names.join(n, "canonical", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("f", folded(F.col("canonical")))
    node = s.groupBy("f").agg(F.min_by("canonical", F.struct(-F.col("n"), "canonical")).alias("node"), F.sum("n").alias("mentions"), F.array_sort(F.collect_list("canonical")).alias("all"))
    return node.select("node", "mentions", F.array_join(F.filter("all", lambda a: a != F.col("node")), "|").alias("aliases"))


def vec25_name_layer(spark: SparkSession, d: str) -> DataFrame:
    """(surface, canonical, tier): every surface in use with the node it stands for: its own name, or one that folds alike."""
    names = table(spark, d, "names").select("canonical").dropna().distinct()
    n = table(spark, d, "note_names").filter("canonical IS NOT NULL").groupBy("canonical").agg(F.count(F.lit(1)).alias("n"))
    elected = names.join(n, "canonical", "left").groupBy(folded(F.col("canonical")).alias("f")).agg(F.min_by("canonical", F.struct(-F.coalesce("n", F.lit(0)), "canonical")).alias("node"))
    used = n.select(F.col("canonical").alias("surface"), folded(F.col("canonical")).alias("f"))
    met = used.join(elected, "f")
    return met.select("surface", F.col("node").alias("canonical"), F.when(F.col("surface") == F.col("node"), 1).otherwise(2).alias("tier"))


def vec05_predicted(spark: SparkSession, d: str) -> DataFrame:
    """The label that a clustering fitted on even ids gives to odd ones: that of the nearest mean, however far."""
    e = V.unit(table(spark, d, "embeddings"), "embedding")
    c = V.centroids(e.filter("vec_id % 2 = 0"), "label", "embedding").select("label", "centroid")
    return V.assign(e.filter("vec_id % 2 = 1"), c, "vec_id", "embedding", "label", float("inf")).select("vec_id", "label")


def vec10_by_count(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of all vectors to a wanted number, by bisection under cosine distance: their sizes."""
    e = V.unit(table(spark, d, "embeddings").select("vec_id", "embedding"), "embedding").select("vec_id", array_to_vector("embedding").alias("v"))
    model = BisectingKMeans(k=12, featuresCol="v", distanceMeasure="cosine", seed=7).fit(e)
    return model.transform(e).groupBy(F.col("prediction").alias("cluster")).agg(F.count(F.lit(1)).alias("size"))


QUERIES = {k: v for k, v in list(globals().items()) if k[:3] in ("str", "vec") and k[3:5].isdigit() and getattr(v, "__module__", "") == __name__}

_L = "(SELECT DISTINCT * FROM run_log WHERE source_id IS NOT NULL)"
_LAST = f"la AS (SELECT pass_name, source_id, arg_max(struct_pack(l := logged_at, a := arrived_at, s := coalesce(status, ''), e := coalesce(error, '')), (logged_at, arrived_at, coalesce(status, ''), coalesce(error, ''))) AS r FROM {_L} GROUP BY 1, 2)"


def _sql() -> dict[str, str]:
    from .store import _FOLD
    from .vectors import _C, _U

    fold = _FOLD.format("canonical")
    mentions = "(SELECT canonical, count(*) AS n FROM note_names WHERE canonical IS NOT NULL GROUP BY 1)"
    spelt = f"s AS (SELECT canonical, coalesce(n, 0) AS n, {fold} AS f FROM (SELECT DISTINCT canonical FROM names WHERE canonical IS NOT NULL) LEFT JOIN {mentions} USING (canonical))"
    return {
        "str01_queue": f"SELECT pass_name, source_id, row_number() OVER (PARTITION BY pass_name ORDER BY since, source_id) AS seq FROM (SELECT pass_name, source_id, min(logged_at) AS since FROM {_L} GROUP BY 1, 2)",
        "str02_claim": f"WITH {_LAST} SELECT pass_name, arg_min(source_id, (r.l, source_id)) AS source_id FROM la WHERE r.s NOT IN ('done', 'skipped') GROUP BY 1",
        "str03_heartbeats": f"SELECT pass_name, source_id, max(arrived_at) AS seen, count(*) AS signs FROM {_L} GROUP BY 1, 2",
        "str06_failed": f"WITH {_LAST} SELECT pass_name, source_id, r.e AS error FROM la WHERE r.s = 'failed'",
        "str07_events_since": "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events QUALIFY seq > 10",
        "str12_alive": f"WITH {_LAST} SELECT pass_name, count(*) FILTER (r.s NOT IN ('done', 'skipped')) AS open, count(*) FILTER (r.s NOT IN ('done', 'skipped') AND r.a >= n - INTERVAL {ALIVE} SECONDS) AS alive FROM la JOIN (SELECT pass_name, max(r.a) AS n FROM la GROUP BY 1) USING (pass_name) GROUP BY 1",
        "str18_first_writer": f"SELECT pass_name, source_id, arg_min(model, (arrived_at, logged_at, model)) AS model, count(*) AS writes FROM {_L} WHERE status = 'done' GROUP BY 1, 2",
        "str20_to_do": f"WITH p AS (SELECT DISTINCT pass_name FROM run_log WHERE pass_name IS NOT NULL), k AS (SELECT pass_name, count(DISTINCT source_id) AS done FROM {_L} WHERE status = 'done' AND source_id IN (SELECT source_id FROM sources) GROUP BY 1) SELECT pass_name, coalesce(done, 0) AS done, (SELECT count(DISTINCT source_id) FROM sources) - coalesce(done, 0) AS to_do FROM p LEFT JOIN k USING (pass_name)",
        "vec17_alias_nodes": f"WITH {spelt}, g AS (SELECT f, arg_min(canonical, (-n, canonical)) AS node, sum(n)::BIGINT AS mentions FROM s GROUP BY f) SELECT node, mentions, coalesce(string_agg(canonical, '|' ORDER BY canonical) FILTER (canonical <> node), '') AS aliases FROM g JOIN s USING (f) GROUP BY f, node, mentions",
        "vec25_name_layer": f"WITH {spelt}, g AS (SELECT f, arg_min(canonical, (-n, canonical)) AS node FROM s GROUP BY f), u AS (SELECT canonical AS surface, {fold} AS f FROM {mentions}) SELECT surface, node AS canonical, CASE WHEN surface = node THEN 1 ELSE 2 END AS tier FROM u JOIN g USING (f)",
        "vec05_predicted": f"{_U}{_C.format('l', 'WHERE vec_id % 2 = 0')} SELECT vec_id, arg_min(c.label, (round(1 - list_dot_product(v, c) / l, 12), c.label)) AS label FROM u, c WHERE vec_id % 2 = 1 GROUP BY vec_id",
    }


SQL = _sql()
