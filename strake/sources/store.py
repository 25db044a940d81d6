"""A partitioned parquet store with declared schemas and idempotent writes."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ..functions.expr import OUTCOMES


@dataclass(frozen=True)
class TableSpec:
    """A table's columns in order; those in ``numeric`` are doubles, all others texts. Dated tables lie by date."""

    name: str
    columns: tuple[str, ...]
    numeric: frozenset[str] = frozenset()
    date: str | None = None

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c, T.DoubleType() if c in self.numeric else T.StringType()) for c in self.columns])


def conform(df: DataFrame, spec: TableSpec) -> DataFrame:
    """The declared columns in order, numbers read leniently: what is no finite number becomes NULL. A missing column is an
    error, others are dropped."""
    missing = [c for c in spec.columns if c not in df.columns]
    if missing:
        raise ValueError(f"{spec.name} lacks {missing}")

    def as_declared(c: str) -> Column:
        x = F.col(f"`{c}`")
        if c not in spec.numeric:
            return x.cast("string").alias(c)
        v = x.try_cast("double")
        return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v).alias(c)

    return df.select(*[as_declared(c) for c in spec.columns])


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def path(self, spec: TableSpec) -> str:
        return os.path.join(self.root, spec.name)

    def _read(self, spec: TableSpec) -> DataFrame:
        try:
            return self.spark.read.schema(spec.schema).parquet(self.path(spec))
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], spec.schema)

    def read_static(self, spec: TableSpec) -> DataFrame:
        """The table, empty with its columns where it was never written."""
        return self._read(spec).select(*spec.columns)

    def write_static(self, spec: TableSpec, df: DataFrame) -> None:
        conform(df, spec).write.mode("overwrite").option("compression", "zstd").parquet(self.path(spec))

    def read_dated(self, spec: TableSpec, start: str, end: str) -> DataFrame:
        """Rows of start..end (YYYYMMDD, both included); only their dates' files are read."""
        return self._read(spec).where(F.col(spec.date).between(start, end)).select(*spec.columns)

    def existing_dates(self, spec: TableSpec) -> DataFrame:
        return self._read(spec).select(spec.date).distinct()

    def missing_dates(self, spec: TableSpec, wanted: DataFrame) -> DataFrame:
        """The wanted dates that are not stored."""
        return wanted.select(spec.date).distinct().join(self.existing_dates(spec), spec.date, "left_anti")

    def append_dated(self, spec: TableSpec, df: DataFrame, order: tuple[str, ...] = ()) -> None:
        """Replaces the dates that df delivers and keeps the others: writing twice changes nothing. Rows without a date are an
        error of the caller and left out. Every row is written once, old ones aren't read; the delivered dates' folders are
        exchanged when all tasks are done. A date of many rows is split over tasks."""
        new = conform(df, spec).where(F.col(spec.date).isNotNull())
        new = new.hint("rebalance", spec.date).sortWithinPartitions(spec.date, *order)
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(spec.date).option("compression", "zstd").parquet(self.path(spec))


def feature_columns(df: DataFrame, meta: tuple[str, ...] = (), outcomes: tuple[str, ...] = OUTCOMES, audits: tuple[str, ...] = ("_source_date", "_as_of_time", "_price_basis", "_adj_factor_version")) -> list[str]:
    """Numeric columns that may be features: no keys, outcomes or audit columns. Only the schema is read."""
    kinds = (T.NumericType,)
    return [f.name for f in df.schema if isinstance(f.dataType, kinds) and f.name not in meta and not f.name.lower().startswith(outcomes) and not f.name.endswith(audits)]


def rank_shaped(columns: list[str]) -> list[str]:
    """Columns that still need a rank: without such a suffix, and without a sibling that has one."""
    names = set(columns)
    return [c for c in columns if not c.endswith(("_rank", "_pctl")) and not {f"{c}_rank", f"{c}_pctl"} & names]


def read_calendar(spark: SparkSession, path: str, date: str = "cal_date", is_open: str = "is_open") -> list[str]:
    """``load_calendar`` of a parquet table or, by its name's ending, a csv file with a header; dates must rise in the file."""
    if not path.endswith(".csv"):
        return load_calendar(spark.read.parquet(path), date, is_open)
    rows = spark.read.option("header", True).csv(path).coalesce(1).withColumn("_i", F.monotonically_increasing_id())  # a row a day
    before = F.lag(date).over(W.orderBy("_i"))
    if rows.withColumn("_b", before).where(F.col(date) <= F.col("_b")).limit(1).collect():
        raise ValueError("the calendar's dates don't rise")
    return load_calendar(rows.withColumn(is_open, F.col(is_open).try_cast("int")), date, is_open)


def load_calendar(df: DataFrame, date: str = "cal_date", is_open: str = "is_open") -> list[str]:
    """The open days, in order. Refuses repeated or malformed dates and flags other than 0 and 1. One row a day."""
    bad = df.where(F.col(date).isNull() | ~F.col(date).rlike(r"\A[0-9]{8}\z") | F.try_to_date(F.col(date), "yyyyMMdd").isNull() | F.col(is_open).isNull() | ~F.col(is_open).isin(0, 1)).limit(1).collect()
    if bad:
        raise ValueError(f"bad calendar row {bad[0].asDict()}")
    if df.groupBy(date).count().where("count > 1").limit(1).collect():
        raise ValueError("a calendar date repeats")
    return [r[0] for r in df.where(F.col(is_open) == 1).select(date).orderBy(date).collect()]


def write_report(df: DataFrame, path: str, kind: str) -> None:
    """Result tables as csv (with header), json or parquet."""
    writer = df.write.mode("overwrite")
    {"csv": lambda: writer.option("header", True).csv(path), "json": lambda: writer.json(path), "parquet": lambda: writer.option("compression", "zstd").parquet(path)}[kind]()
