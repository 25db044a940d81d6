"""Contracts that a table must keep before anything is computed from it."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relational import ContractError


def select_codes(df: DataFrame, codes: DataFrame) -> DataFrame:
    """Rows of the codes; all columns and repeated rows stay."""
    return df.join(codes.select("code").distinct(), "code", "left_semi").select(*df.columns)


def window_digest(df: DataFrame, date: str = "trade_date") -> DataFrame:
    """One row (first, last, n_dates, n_rows, digest): the dates a table covers. The digest is over its dates, in order."""
    per = df.where(F.col(date).isNotNull()).groupBy(date).agg(F.count(F.lit(1)).alias("n"))  # a row a date
    days = F.concat_ws(",", F.sort_array(F.collect_list(date)))
    return per.agg(F.min(date).alias("first"), F.max(date).alias("last"), F.count(F.lit(1)).alias("n_dates"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.sha2(days, 256).alias("digest"))


def require_window(df: DataFrame, expected: dict, date: str = "trade_date") -> DataFrame:
    """df, if its window is the frozen one: the entries of ``expected`` (first, last, n_dates, n_rows, digest) must agree."""
    got = window_digest(df, date).first().asDict()
    off = {k: (v, got.get(k)) for k, v in expected.items() if got.get(k) != v}
    if off:
        raise ContractError(f"the window isn't the frozen one, expected and found: {off}")
    return df


def select_curve(curves: DataFrame, keys: dict, date: str = "t") -> DataFrame:
    """The one curve with the given key values (None: NULL), refused where it's absent or a date repeats."""
    one = curves
    for c, v in keys.items():
        one = one.where(F.col(c).isNull() if v is None else F.col(c) == v)
    most = one.groupBy(date).count().agg(F.max("count").alias("m")).first()["m"]
    if most != 1:
        raise ContractError(f"no curve {keys}" if most is None else f"{keys} is not one curve")
    return one


def complete_cases(df: DataFrame, cols: list[str], key: str) -> DataFrame:
    """Rows in which no column of ``cols`` is NULL, with ``source_key``, by which they are found again in the source."""
    return df.dropna(subset=cols).withColumn("source_key", F.col(key))


def derived_mismatch(df: DataFrame, stated: str, derived, tolerance: float, by: list[str]) -> DataFrame:
    """(by, n, n_off, worst): rows with both values, those further apart than the tolerance, the largest distance."""
    x = df.withColumn("_d", F.abs(F.col(stated) - derived))
    return x.groupBy(*by).agg(F.count("_d").alias("n"), F.count_if(F.col("_d") > tolerance).alias("n_off"), F.max("_d").alias("worst"))


def require_derived(df: DataFrame, stated: str, derived, tolerance: float, share: float = 0.0) -> DataFrame:
    """df, if at most ``share`` of the rows are further off than the tolerance."""
    r = derived_mismatch(df, stated, derived, tolerance, []).first()
    if r["n"] and r["n_off"] > share * r["n"]:
        raise ContractError(f"{stated}: {r['n_off']} of {r['n']} rows differ from what it derives from, by up to {r['worst']}")
    return df


def unadjusted(panel: DataFrame) -> DataFrame:
    """Cells that have a price but no factor to adjust it."""
    return panel.where(F.col("close").isNotNull() & F.col("adj").isNull())


def require_adjusted(panel: DataFrame) -> DataFrame:
    bad = unadjusted(panel).limit(1).collect()
    if bad:
        raise ContractError(f"a price without a factor: {bad[0]['code']} on {bad[0]['trade_date']}")
    return panel


def write_snapshot(df: DataFrame, path: str, lineage: dict, bucket: str = "code", parts: int = 64) -> None:
    """A panel as files clustered by code, and beside them what it was made of and the dates it covers."""
    df.withColumn("part", F.pmod(F.xxhash64(bucket), F.lit(parts)).cast("int")).repartition(parts, "part").sortWithinPartitions("part", bucket, "t").write.mode("overwrite").partitionBy("part").parquet(os.path.join(path, "rows"))
    window = window_digest(df).first().asDict()
    text = json.dumps({"schema": json.loads(df.schema.json()), "window": window, "lineage": lineage})
    df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(os.path.join(path, "lineage"))


def read_snapshot(spark, path: str, lineage: dict | None = None) -> DataFrame:
    """The snapshot, refused where its schema or dates aren't the recorded ones or its lineage isn't the one asked for."""
    from pyspark.sql.types import StructType

    meta = json.loads(spark.read.text(os.path.join(path, "lineage")).first()["value"])
    wrong = {k: (v, meta["lineage"].get(k)) for k, v in (lineage or {}).items() if meta["lineage"].get(k) != v}
    if wrong:
        raise ContractError(f"the snapshot has another lineage, expected and found: {wrong}")
    df = spark.read.parquet(os.path.join(path, "rows")).drop("part")
    kinds = lambda s: [(f.name, f.dataType) for f in s]
    if kinds(df.schema) != kinds(StructType.fromJson(meta["schema"])):
        raise ContractError("the snapshot's columns aren't the recorded ones")
    return require_window(df, meta["window"])
