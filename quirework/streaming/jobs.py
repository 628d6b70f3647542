"""Streams over arriving files: windows, first writers and keyed state, with event-time watermarks."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder, table


def stream(spark: SparkSession, sf_dir: str, name: str, event_time: str) -> DataFrame:
    """A table's files as a stream; event_time becomes an instant (watermarks need one) read as UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    schema = table(spark, sf_dir, name).schema
    path = f"{sf_dir}/{name}.parquet"
    reader = spark.readStream.schema(schema)
    # a single file is watched by its name in the folder, a folder of parts as a whole
    src = reader.parquet(path) if os.path.isdir(path) else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return src.withColumn(event_time, F.col(event_time).cast("timestamp"))


def drained(df: DataFrame, mode: str, key: list[str] | None = None) -> DataFrame:
    """Run a stream over what is there and return its result as a table in the shared folder.

    append: the appended rows. complete: the last whole result. update: the last row of each key.
    Each micro-batch is written under its number, so a batch that is run again replaces itself.
    """
    spark = df.sparkSession
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    q = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    schema = df.withColumn("_batch", F.lit(0)).schema
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{at}/out")
    if mode == "complete":
        last = rows.agg(F.max("_batch")).first()[0]
        return rows.filter(F.col("_batch") == (last if last is not None else -1)).drop("_batch")
    if mode == "update":
        rest = [c for c in df.columns if c not in key]
        return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "_batch").alias("r")).select(*key, "r.*")
    return rows.drop("_batch")


def hourly_counts(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Events and sum of values by hour and type."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("value")).select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "events", "value")


def first_writers(log: DataFrame, late: str = "30 days") -> DataFrame:
    """Each run once, however often its row arrives within the watermark."""
    cols = [c for c in log.columns if c not in ("arrived_at", "logged_at")]
    return log.withWatermark("arrived_at", late).dropDuplicatesWithinWatermark(["source_id", "pass_name", "logged_at"]).select(*cols, F.col("logged_at").cast("timestamp_ntz").alias("logged_at"))


def user_totals(events: DataFrame) -> DataFrame:
    """Per user events and purchases so far, in keyed state of two numbers."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, bought = state.get if state.exists else (0, 0)
        for pdf in batches:
            n += len(pdf)
            bought += int((pdf.event_type == "purchase").sum())
        state.update((n, bought))
        yield pd.DataFrame({"user_id": [key[0]], "events": [n], "purchases": [bought]})

    return events.select("user_id", "event_type").groupBy("user_id").applyInPandasWithState(step, "user_id bigint, events bigint, purchases bigint", "events bigint, purchases bigint", "update", "NoTimeout")


def str30_hourly_counts(spark: SparkSession, d: str) -> DataFrame:
    return drained(hourly_counts(stream(spark, d, "events", "ts")), "complete")


def str31_first_writers(spark: SparkSession, d: str) -> DataFrame:
    log = stream(spark, d, "run_log", "arrived_at")
    return drained(first_writers(log), "append").select("source_id", "pass_name", "logged_at")


def str32_user_totals(spark: SparkSession, d: str) -> DataFrame:
    return drained(user_totals(stream(spark, d, "events", "ts")), "update", ["user_id"])


QUERIES = {"str30_hourly_counts": str30_hourly_counts, "str31_first_writers": str31_first_writers, "str32_user_totals": str32_user_totals}

SQL = {
    "str30_hourly_counts": "SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY ALL",
    "str31_first_writers": "SELECT DISTINCT source_id, pass_name, logged_at FROM run_log",
    "str32_user_totals": "SELECT user_id, count(*) AS events, count(*) FILTER (event_type = 'purchase') AS purchases FROM events GROUP BY user_id",
}
