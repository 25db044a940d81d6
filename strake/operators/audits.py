"""Residuals, permutation nulls, bootstraps and other checks of a score."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ops as o
from .metrics import daily_gini, daily_ic, pearson, ratio, summarize_ic

#: Fixed values of the integer hash: a multiplicative congruence followed by two squarings, exact in 64 bits.
PRIME, A_KEY, A_PERM, A_DATE = 2147483647, 48271, 69621, 16807


def residualize(df: DataFrame, y: str, xs: list[str], name: str = "residual", by: tuple[str, ...] = ("t",)) -> DataFrame:
    """Adds each date's (or group's, ``by``) least-squares residual of y on an intercept and xs, over complete rows; NULL elsewhere, and where
    the xs explain a date's y wholly.

    Only the sums of products leave the rows: a date's small normal equations are solved by pseudo-inverse, and the
    coefficients come back with the date, so that no task holds a date's rows.
    """
    cols = ["_1", *xs]
    full = df.withColumn("_1", F.lit(1.0)).withColumn("_ok", F.lit(True))
    for c in (y, *xs):
        full = full.withColumn("_ok", F.col("_ok") & F.col(f"`{c}`").isNotNull())
    v = {c: F.when(F.col("_ok"), F.col(f"`{c}`").cast("double")) for c in (*cols, y)}
    gram = F.array(*[F.coalesce(F.sum(v[a] * v[b]), F.lit(0.0)) for a in cols for b in cols])
    right = F.array(*[F.coalesce(F.sum(v[a] * v[y]), F.lit(0.0)) for a in cols])
    sums = full.groupBy(*by).agg(gram.alias("g"), right.alias("r"), F.coalesce(F.sum(v[y] * v[y]), F.lit(0.0)).alias("yy"))
    k = len(cols)

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            coef, left = [], []
            for g, r, yy in zip(f["g"], f["r"], f["yy"]):
                g, r = np.array(g).reshape(k, k), np.array(r)
                scale = np.sqrt(np.where(np.diag(g) > 0, np.diag(g), 1))
                c = np.linalg.pinv(g / np.outer(scale, scale), rcond=1e-12, hermitian=True) @ (r / scale) / scale
                coef.append(c.tolist())
                left.append(bool(yy - c @ r > 1e-12 * yy))
            yield f[list(by)].assign(_c=coef, _left=left)

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    solved = sums.mapInPandas(solve, f"{kinds}, _c array<double>, _left boolean")
    fit = sum((F.col("_c")[i] * F.col(f"`{c}`") for i, c in enumerate(cols)), F.lit(0.0))
    return full.join(solved, list(by)).withColumn(name, F.when(F.col("_ok") & F.col("_left"), F.col(y) - fit)).select(*[F.col(f"`{c}`") for c in df.columns], name)


def style_design(df: DataFrame, styles: list[str], category: str | None = None, most: int = 64) -> tuple[DataFrame, list[str]]:
    """df with the design's columns, and their names: standardized styles, and a 0/1 column for all levels of the category
    but the first. The columns are NULL in rows that lack a style or the category."""
    names = [f"z_{c}" for c in styles]
    out = df.withColumns({n: o.cs_zscore(F.col(c), 1) for n, c in zip(names, styles)})
    if category:
        levels = sorted(r[0] for r in df.select(category).where(F.col(category).isNotNull()).distinct().limit(most + 1).collect())
        if len(levels) > most:
            raise ValueError(f"{category} has more than {most} levels")
        for v in levels[1:]:
            names.append(f"{category}={v}")
            out = out.withColumn(names[-1], (F.col(category) == v).cast("double"))
    return out, names


def rank_residual(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """Residual in the space of the dates' ordinal ranks."""
    r = df.withColumns({f"_r{i}": o.cs_rank(F.col(c)) for i, c in enumerate([y, *xs])})
    return residualize(r, "_r0", [f"_r{i + 1}" for i in range(len(xs))]).select(*df.columns, "residual")


def exposure(df: DataFrame, residual: str, xs: list[str]) -> DataFrame:
    """(x, worst): the largest absolute correlation on any date of a residual and what it was cleaned of."""
    day = df.where(F.col(residual).isNotNull()).groupBy("t").agg(*[pearson(F.col(residual), F.col(c), 5).alias(c) for c in xs])
    return day.agg(*[F.max(F.abs(c)).alias(c) for c in xs]).select(F.inline(F.array(*[F.struct(F.lit(c).alias("x"), F.col(c).alias("worst")) for c in xs])))


def shuffle_hash(key: Column, perm: Column) -> Column:
    """A number that orders a date's rows at random for each permutation, from integers only."""
    h = F.pmod(key.cast("bigint") * A_KEY + perm.cast("bigint") * A_PERM + F.col("t").cast("bigint") * A_DATE, F.lit(PRIME))
    for _ in range(2):
        h = F.pmod(h * h + 11, F.lit(PRIME))
    return h


def permuted(df: DataFrame, y: str, key: str, perms: int) -> DataFrame:
    """``perms`` copies of the labelled rows with the labels shuffled within each date: the dates' class counts stay."""
    rows = df.where(F.col(y).isNotNull()).withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(perms - 1))))
    part = W.partitionBy("perm", "t")
    place = F.row_number().over(part.orderBy(shuffle_hash(F.col(key), F.col("perm")), key))
    return rows.withColumn("y_perm", (place <= F.sum(y).over(part)).cast("double"))


def _null_of_date(t: int, code: np.ndarray, key: np.ndarray, y: np.ndarray, x: np.ndarray, perms: int, least: int, cells: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Rank IC and gini (perms, factors) of a date's labels y (0, 1) as ``permuted`` shuffles them; x is (rows, factors).

    Labels of two values need no sort a factor: only the places of the ones, in the order of the codes, are handled.
    """
    by = np.argsort(code, kind="stable")
    key, y, x = key[by], y[by], x[by]
    rows, n_one = len(y), int(y.sum())
    order = np.argsort(key, kind="stable")  # ties of the hash go by key
    base = ((key[order] % PRIME) * A_KEY + t * A_DATE) % PRIME
    ones = np.empty((perms, n_one), dtype=np.int64)
    for lo in range(0, perms if n_one else 0, step := max(1, cells // rows)):
        h = (base + np.arange(lo, min(lo + step, perms))[:, None] * A_PERM) % PRIME
        for _ in range(2):
            h = (h * h + 11) % PRIME
        h = (h << 32) | np.arange(rows)
        if n_one < rows:
            h.partition(n_one - 1, axis=1)
        ones[lo : lo + step] = np.sort(order[h[:, :n_one] & 0xFFFFFFFF], axis=1)
    ic, gini = np.full((perms, x.shape[1]), np.nan), np.full((perms, x.shape[1]), np.nan)
    for f in range(x.shape[1]):
        ok = ~np.isnan(x[:, f])
        n = int(ok.sum())
        if n < least:
            continue
        a, place = np.zeros(rows), np.cumsum(ok) * ok  # ranks of the factor and of the code
        a[np.nonzero(ok)[0][np.argsort(x[ok, f], kind="stable")]] = np.arange(1, n + 1)
        after = np.cumsum(a[::-1])[::-1]
        hit = ok[ones]
        nth, pos = np.cumsum(hit, axis=1), hit.sum(axis=1)
        a_one = a[ones]
        # rank of a label: zeros before it and itself; for ones all zeros and the ones up to it
        ab = a @ place - (after[ones] * hit).sum(axis=1) - (a_one * place[ones]).sum(axis=1) + 2 * (a_one * nth).sum(axis=1) + (n - pos) * (s1 := a_one.sum(axis=1))
        ic[:, f] = (ab - n * (n + 1) ** 2 / 4) / ((n**3 - n) / 12)
        both = (pos > 0) & (pos < n)
        gini[:, f] = np.where(both, 2 * (s1 - pos * (pos + 1) / 2) / np.where(both, pos * (n - pos), 1) - 1, np.nan)
    return ic, gini


def placebo_null(df: DataFrame, factors: list[str], y: str, key: str, perms: int, least: int = 5) -> DataFrame:
    """(perm, ic_mean, icir, gini): the largest absolute value over the factors for each shuffle, shared by all factors.

    A date's rows are handled in one task, its shuffles in blocks; a date has at most a row a code.
    """
    k = len(factors)

    def of_date(keys: tuple, f: pd.DataFrame) -> pd.DataFrame:
        ic, gini = _null_of_date(int(keys[0]), f["code"].to_numpy().astype(str), f[key].to_numpy(np.int64), f[y].to_numpy(float), f[factors].to_numpy(float), perms, max(least, 2))
        return pd.DataFrame({"perm": np.repeat(np.arange(perms, dtype=np.int32), k), "factor": np.tile(np.arange(k, dtype=np.int32), perms), "ic": ic.ravel(), "gini": gini.ravel()})

    rows = df.where(F.col(y).isNotNull()).select("t", "code", F.col(key).cast("bigint").alias(key), F.col(y).cast("double").alias(y), *[F.col(c).cast("double").alias(c) for c in factors])
    daily = rows.groupBy("t").applyInPandas(of_date, "perm int, factor int, ic double, gini double").select("perm", "factor", F.nanvl("ic", F.lit(None)).alias("ic"), F.nanvl("gini", F.lit(None)).alias("gini"))
    per = daily.groupBy("perm", "factor").agg(F.abs(F.avg("ic")).alias("ic_mean"), F.abs(ratio(F.avg("ic"), F.stddev_samp("ic"))).alias("icir"), F.abs(F.avg("gini")).alias("gini"))
    return per.groupBy("perm").agg(*[F.max(c).alias(c) for c in ("ic_mean", "icir", "gini")])


def factor_metrics(df: DataFrame, factors: list[str], y: str) -> DataFrame:
    """(factor, ic_mean, icir, gini): each factor's metrics over the dates, signed."""
    long = df.select("t", "code", F.col(y).alias("y"), F.inline(F.array(*[F.struct(F.lit(c).alias("factor"), F.col(c).alias("x")) for c in factors])))
    ic = summarize_ic(daily_ic(long, "x", "y", by=("factor",)), by=("factor",)).select("factor", "ic_mean", "icir")
    return ic.join(daily_gini(long, "x", by=("factor",)).groupBy("factor").agg(F.avg("gini").alias("gini")), "factor")


def null_quantiles(null: DataFrame) -> DataFrame:
    """(metric, p95, p99, p999) of a null distribution, linear between its values."""
    one = lambda c: F.struct(F.lit(c).alias("metric"), *[F.percentile(c, p).alias(n) for n, p in (("p95", 0.95), ("p99", 0.99), ("p999", 0.999))])
    return null.agg(*[one(c).alias(c) for c in ("ic_mean", "icir", "gini")]).select(F.inline(F.array("ic_mean", "icir", "gini")))


def grade(metrics: DataFrame, quantiles: DataFrame, formal: list[str] | None = None) -> DataFrame:
    """Adds level (0..3: thresholds passed by the weakest of the factor's metrics) and eligible (all above p99).

    ``formal`` are the factors that the thresholds were made from; others are graded but never eligible. None: all are formal.
    """
    long = metrics.select("factor", F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.abs(c).alias("v")) for c in ("ic_mean", "icir", "gini")])))
    level = F.when(F.col("v") > F.col("p999"), 3).when(F.col("v") > F.col("p99"), 2).when(F.col("v") > F.col("p95"), 1).otherwise(0)
    g = long.join(F.broadcast(quantiles), "metric").groupBy("factor").agg(F.min(level).alias("level"))  # three rows
    named = F.lit(True) if formal is None else F.col("factor").isin(formal)
    return metrics.join(g, "factor").withColumn("eligible", (F.col("level") >= 2) & named)


def block_index(spark, n: int, block: int, reps: int, seed: int = 7) -> DataFrame:
    """(rep, pos, i): circular block bootstrap of n positions; block starts from the integer hash, wrapping around."""
    blocks = -(-n // block)
    base = spark.range(reps).withColumnRenamed("id", "rep").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("t", F.lit(seed))
    start = base.withColumn("s", F.pmod(shuffle_hash(F.col("b"), F.col("rep")), F.lit(n)))
    each = start.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(block - 1))))
    pos = F.col("b") * block + F.col("k")
    return each.select(F.col("rep").cast("int").alias("rep"), pos.cast("int").alias("pos"), F.pmod(F.col("s") + F.col("k"), F.lit(n)).cast("int").alias("i")).where(F.col("pos") < n)


def bootstrap_means(series: DataFrame, value: str, block: int, reps: int) -> DataFrame:
    """(rep, mean): of resampled dates, each as often as drawn. The series has one row a date."""
    ok = series.where(F.col(value).isNotNull()).withColumn("i", F.row_number().over(W.orderBy("t")) - 1)
    return block_index(series.sparkSession, ok.count(), block, reps).join(ok, "i").groupBy("rep").agg(F.avg(value).alias("mean"))


def horizon_returns(events: DataFrame, panel: DataFrame, most: int = 10) -> DataFrame:
    """events with ``h`` 1..most and ``fwd``: the return from the close of t to that h sessions later."""
    from .relational import at_offset

    near = at_offset(events, panel, F.lit(0), ["close_h"]).withColumnRenamed("close_h_at", "_c0")
    far = at_offset(near.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(most)))), panel, F.col("h"), ["close_h"])
    return far.withColumn("fwd", o.div(F.col("close_h_at"), F.col("_c0")) - 1).drop("close_h_at", "_c0")


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    f = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + num * d), 1 + num / c
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


def correlation_p(r: float, n: int) -> float:
    """Two-sided p-value of a correlation of n pairs."""
    if n < 3 or abs(r) >= 1:
        return 0.0 if n >= 3 else math.nan
    return incomplete_beta((n - 2) / 2, 0.5, 1 - r * r)
