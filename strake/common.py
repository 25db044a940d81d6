"""Small shared helpers: code spelling, finiteness, integer clocks, checkpoints."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def norm_code(c: Column | str) -> Column:
    """Codes compare after trimming blanks and upper-casing."""
    return F.upper(F.trim(F.col(c) if isinstance(c, str) else c))


def plain_date(c: Column | str) -> Column:
    """YYYYMMDD from YYYYMMDD or YYYY-MM-DD; other texts keep their characters."""
    return F.translate(F.col(c) if isinstance(c, str) else c, "-", "")


def finite(c: Column | str) -> Column:
    """The value, or NULL where it is NULL, NaN or infinite."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def micros(c: Column | str) -> Column:
    """Microseconds from 1970 to the clock reading of a timestamp with or without zone."""
    c = F.col(c) if isinstance(c, str) else c
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c.cast("timestamp_ntz"))


def day_number(c: Column | str) -> Column:
    """Days since 1970 of a YYYYMMDD text; NULL where the text is no date."""
    c = F.col(c) if isinstance(c, str) else c
    return F.unix_date(F.try_to_date(c, "yyyyMMdd"))


def day_text(c: Column) -> Column:
    return F.date_format(F.date_from_unix_date(c), "yyyyMMdd")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors share.

    Where none is named, a folder of this machine will do for local masters only; on a cluster executors couldn't share it.
    """
    sc = spark.sparkContext
    at = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not at:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="strake-checkpoint-")
        atexit.register(shutil.rmtree, at, True)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(at)
    return at


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager)
