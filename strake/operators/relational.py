"""Point-in-time and shape operators: deduplication, guards, interval and calendar joins, slots, upserts, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class ContractError(ValueError):
    """Data that breaks a stated contract."""


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is last in ``order``, by one aggregation without a sort."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*").select(*df.columns)


def conflicts(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, versions) of keys whose rows differ; NULL and NaN equal themselves."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.countDistinct(F.xxhash64(*rest)).alias("versions")).where("versions > 1")


def dedup_or_fail(df: DataFrame, keys: list[str]) -> DataFrame:
    """Identical repeats collapse; differing rows of a key are an error."""
    bad = conflicts(df, keys).limit(1).collect()
    if bad:
        raise ContractError(f"rows of {bad[0].asDict()} differ")
    return df.dropDuplicates(keys)


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """df, if no key repeats: the guard of a one-to-one or many-to-one join's right side."""
    bad = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if bad:
        raise ContractError(f"key {bad[0].asDict()} repeats")
    return df


def join_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join whose right side may hold a key once only."""
    return left.join(assert_unique(right, keys), keys, how)


def interval_any(df: DataFrame, intervals: DataFrame, *, key: str, at: str, start: str, end: str, flag: Column, name: str, current: DataFrame | None = None) -> DataFrame:
    """Adds whether any interval of the key in effect at ``at`` (start <= at <= end, open where end is NULL) has the flag;
    false without one. The flag is reduced before the join, so that only flagged intervals are joined. ``current`` (key and a
    boolean of the given name) stands in for keys that have no interval at all."""
    on = intervals.where(flag).select(F.col(key).alias("_k"), F.col(start).alias("_s"), F.col(end).alias("_e"))
    inside = (F.col(key) == F.col("_k")) & (F.col(at) >= F.col("_s")) & (F.col("_e").isNull() | (F.col(at) <= F.col("_e")))
    pairs = df.select(key, at).distinct().join(on, inside, "left_semi").withColumn(name, F.lit(True))
    out = df.join(pairs, [key, at], "left")
    if current is not None:
        alone = current.where(name).select(key).distinct().join(intervals.select(key), key, "left_anti").withColumn("_alone", F.lit(True))
        out = out.join(alone, key, "left").withColumn(name, F.coalesce(name, "_alone")).drop("_alone").select(*df.columns, name)
    return out.fillna(False, [name])


def interval_one(df: DataFrame, intervals: DataFrame, *, key: str, at: str, start: str, end: str, value: str) -> DataFrame:
    """Adds the value of the interval in effect and ``n_active``; NULL unless exactly one is."""
    iv = intervals.select(F.col(key).alias("_k"), F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(value).alias("_v"))
    inside = (F.col(key) == F.col("_k")) & (F.col(at) >= F.col("_s")) & (F.col("_e").isNull() | (F.col(at) <= F.col("_e")))
    cells = df.select(key, at).distinct().join(iv, inside).groupBy(key, at).agg(F.count(F.lit(1)).alias("n_active"), F.min("_v").alias("_v"))
    return df.join(cells, [key, at], "left").withColumns({value: F.when(F.col("n_active") == 1, F.col("_v")), "n_active": F.coalesce("n_active", F.lit(0))}).drop("_v")


def in_listing(df: DataFrame, listings: DataFrame, cal: DataFrame, *, start: str, end: str, days: int, name: str = "listed") -> DataFrame:
    """Adds whether t is at least ``days`` sessions after the first session on or after the listing's start and its date before
    the end (open where NULL); false for codes without a listing or a start. listings: a row a code; cal: (t, trade_date)."""
    dates = cal.select(F.col("trade_date").alias("_d"), F.col("t").alias("_t0"))
    first = W.orderBy("_d").rowsBetween(0, W.unboundedFollowing)
    # the first session on or after each day that is some listing's start
    starts = listings.where(F.col(start).isNotNull()).select(F.col(start).alias("_d")).distinct().join(dates, "_d", "left").unionByName(dates).distinct()
    starts = starts.withColumn("_t0", F.first("_t0", ignorenulls=True).over(first)).dropDuplicates(["_d"])  # a row a day of the calendar
    own = listings.select("code", F.col(start).alias("_d"), F.col(end).alias("_e")).join(starts, "_d").select("code", "_t0", "_e")
    mask = F.coalesce((F.col("t") >= F.col("_t0") + days) & (F.col("_e").isNull() | (F.col("trade_date") < F.col("_e"))), F.lit(False))
    return df.join(own, "code", "left").withColumn(name, mask).select(*[F.col(f"`{c}`") for c in df.columns], name)


def at_offset(df: DataFrame, lookup: DataFrame, h: Column, cols: list[str]) -> DataFrame:
    """Looks ``cols`` up h sessions after t, by (code, t + h); the names get the suffix ``_h``."""
    right = lookup.select("code", F.col("t").alias("_t"), *[F.col(c).alias(f"{c}_at") for c in cols])
    return df.withColumn("_t", F.col("t") + h).join(right, ["code", "_t"], "left").drop("_t")


def zero_filled(series: DataFrame, cal: DataFrame, cols: list[str]) -> DataFrame:
    """The series on every date of the calendar, 0 where it has none."""
    return cal.join(series, "t", "left").fillna(0, cols)


def slots(df: DataFrame) -> DataFrame:
    """Adds the place of each row in its date, by code from 0."""
    return df.withColumn("slot", F.row_number().over(W.partitionBy("t").orderBy("code")) - 1)


def one_hot(df: DataFrame, col: str, most: int = 32) -> DataFrame:
    """A 0/1 column a level; refuses columns of one level or of more than ``most``."""
    levels = [r[0] for r in df.select(col).where(F.col(col).isNotNull()).distinct().limit(most + 1).collect()]
    if not 2 <= len(levels) <= most:
        raise ContractError(f"{col} has {'more than ' + str(most) if len(levels) > most else len(levels)} levels")
    return df.withColumns({f"{col}={v}": F.coalesce((F.col(col) == v).cast("int"), F.lit(0)) for v in sorted(levels)})


def upsert(existing: DataFrame, incoming: DataFrame, by: str) -> DataFrame:
    """existing, with every delivered value of ``by`` replaced by the delivery's rows."""
    return existing.join(incoming.select(by).distinct(), by, "left_anti").select(*existing.columns).unionByName(incoming)


def fingerprint(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, rows, digest): of a group's rows whatever their order. Rows are hashed (sha256), the hashes' eight words summed
    and the sums hashed, so that partial sums are all that leaves a task and no group is gathered."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in sorted(df.columns)])
    h = df.withColumn("_h", F.sha2(text, 256))
    words = [F.sum(F.conv(F.substring("_h", 1 + 8 * i, 8), 16, 10).cast("bigint")) for i in range(8)]
    return h.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.concat_ws(",", *[w.cast("string") for w in words]), 256).alias("digest"))


def top_liquid(df: DataFrame, amount: str, n: int) -> DataFrame:
    """The n codes of the largest median amount, ties by code."""
    return df.groupBy("code").agg(F.median(amount).alias("amount")).orderBy(F.desc_nulls_last("amount"), "code").limit(n)
