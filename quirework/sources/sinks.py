"""Writers: versioned stores, content diffs and append logs. Files are committed as a whole or not at all."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_store(tables: dict[str, DataFrame], folder: str, version: str) -> dict[str, int]:
    """Write the tables under folder/version and return their row counts; an existing version is never overwritten.

    The manifest is written last: a version without one is no version.
    """
    at = f"{folder}/{version}"
    if os.path.exists(f"{at}/manifest.json"):
        raise FileExistsError(at)
    counts = {}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{at}/{name}.parquet")
        counts[name] = df.sparkSession.read.parquet(f"{at}/{name}.parquet").count()
    tmp = f"{at}/.manifest.json"
    with open(tmp, "w") as f:
        json.dump({"version": version, "rows": counts}, f, sort_keys=True)
    os.replace(tmp, f"{at}/manifest.json")
    return counts


def read_store(spark: SparkSession, folder: str, version: str) -> dict[str, DataFrame]:
    with open(f"{folder}/{version}/manifest.json") as f:
        return {name: spark.read.parquet(f"{folder}/{version}/{name}.parquet") for name in json.load(f)["rows"]}


def changes(new: DataFrame, old: DataFrame, key: str, content: str) -> DataFrame:
    """(key, change): insert, update or delete, by the hash of the content; unchanged keys are left out."""
    n = new.select(key, F.sha2(F.col(content).cast("string"), 256).alias("hn"), F.lit(True).alias("n"))
    o = old.select(key, F.sha2(F.col(content).cast("string"), 256).alias("ho"), F.lit(True).alias("o"))
    both = n.join(o, key, "full")
    what = F.when(F.col("o").isNull(), "insert").when(F.col("n").isNull(), "delete").when(~F.col("hn").eqNullSafe(F.col("ho")), "update")
    return both.select(key, what.alias("change")).filter("change IS NOT NULL")


def purge(log: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The log without exactly these keys."""
    return log.join(keys.select(*on).distinct(), on, "left_anti")


def append_rows(df: DataFrame, path: str, sep: str = "\t") -> None:
    """Append rows to a ledger of separated values."""
    df.write.mode("append").option("header", "true").option("sep", sep).csv(path)


def upsert_section(text: str, heading: str, body: str):
    """A page with its section of that heading replaced, or appended where there is none; columns by name."""
    page, head, new = F.col(text), F.lit(heading), F.col(body)
    block = F.concat(F.lit("## "), head, F.lit("\n\n"), new, F.lit("\n"))
    pattern = F.concat(F.lit(r"(?s)## \Q"), head, F.lit(r"\E\n.*?(?=\n## |\z)"))
    has = F.instr(page, f"## {heading}\n") > 0
    return F.when(has, F.regexp_replace(page, pattern, F.regexp_replace(F.rtrim(block, F.lit("\n")), r"([\\$])", r"\\$1"))).otherwise(F.concat(F.rtrim(page, F.lit("\n")), F.lit("\n\n"), block))
