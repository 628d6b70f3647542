"""Readers of folders, append logs, notes and decision logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import last_of_each

ARTIFACTS = ("tree", "chunks", "answers", "envelope")


def scan_folder(spark: SparkSession, folder: str, ledger: DataFrame, artifacts: DataFrame, kinds: tuple[str, ...] = ("pdf", "docx")) -> DataFrame:
    """(path, source_id, hash, status, missing) of every file.

    ledger: (source_id, hash); artifacts: (source_id, artifact). rejected: another kind of file;
    new: no ledger row; changed: another hash; partial: a hash that matches but artifacts missing;
    done. The content is hashed where it lies; only the hash travels.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.sha2("content", 256).alias("hash"))
    files = files.withColumn("stem", F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1)).withColumn("kind", F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)))
    files = files.withColumn("source_id", F.concat_ws("-", "stem", F.substring("hash", 1, 12)))
    known = last_of_each(ledger.select(F.col("source_id").alias("known"), F.col("hash").alias("was")).withColumn("stem", F.regexp_replace("known", "-[0-9a-f]{12}$", "")).select("stem", "known", "was"), ["stem"], ["known"])
    have = artifacts.groupBy("source_id").agg(F.collect_set("artifact").alias("have"))
    out = files.join(known, "stem", "left").join(have, "source_id", "left")
    missing = F.array_except(F.array(*[F.lit(a) for a in ARTIFACTS]), F.coalesce("have", F.array().cast("array<string>")))
    status = F.when(~F.col("kind").isin(*kinds), "rejected").when(F.col("known").isNull(), "new").when(F.col("was") != F.col("hash"), "changed").when(F.size(missing) > 0, "partial").otherwise("done")
    return out.select("path", "source_id", "hash", status.alias("status"), F.when(status == "partial", F.array_join(missing, ",")).alias("missing"))


def append_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of an append log; a torn last line is dropped, an earlier corrupt line is an error on reading."""
    lines = spark.read.text(path).withColumn("_n", F.monotonically_increasing_id())
    told = lines.filter(F.trim("value") != "").withColumn("_r", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    last = told.agg(F.max("_n")).scalar()
    ok = F.col("_r._bad").isNull()
    checked = told.filter(ok | (F.col("_n") < last)).withColumn("_ok", F.when(ok, True).otherwise(F.raise_error(F.concat(F.lit("corrupt line: "), F.substring("value", 1, 80)))))
    names = [f.split()[0] for f in schema.split(",")]
    return checked.filter("_ok").select(*[F.col(f"_r.{n}").alias(n) for n in names])


def decisions(log: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last decision of each content key."""
    return last_of_each(log, key, [order])


def notes_with_front_matter(spark: SparkSession, folder: str) -> DataFrame:
    """(path, front, body) of markdown notes; a note without a closed front matter has a null front."""
    raw = spark.read.option("recursiveFileLookup", "true").text(folder, wholetext=True).withColumn("path", F.input_file_name())
    front = F.regexp_extract("value", r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n?(.*)\z", 1)
    has = F.col("value").rlike(r"(?s)\A---\r?\n.*?\r?\n---")
    return raw.select("path", F.when(has, front).alias("front"), F.when(has, F.regexp_extract("value", r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n?(.*)\z", 2)).otherwise(F.col("value")).alias("body"))


def records_with(spark: SparkSession, folder: str, key: str, schema: str) -> DataFrame:
    """JSON objects under a folder that carry a key; an unreadable file is a row of nulls with its path."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    told = raw.select(F.input_file_name().alias("path"), F.from_json("value", schema).alias("r"), F.get_json_object("value", f"$.{key}").alias("has"), F.try_parse_json("value").isNull().alias("broken"))
    return told.filter(F.col("has").isNotNull() | F.col("broken")).select("path", "r.*")


def unseen(listing: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a listing whose change key is not in the saved state."""
    return listing.join(state.select(*keys).distinct(), keys, "left_anti")
