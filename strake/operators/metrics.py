"""Ranking metrics, always per date (t) and then over dates, and their summaries.

Ranks are ordinal, ties broken by code. A date without enough pairs or without variation gives NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

YEAR = 252.0


def _rank(x: Column, ok: Column) -> Column:
    w = W.partitionBy("t").orderBy(F.when(ok, x).asc_nulls_last(), "code")
    return F.when(ok, F.row_number().over(w).cast("double"))


def pearson(x: Column, y: Column, least: int) -> Column:
    """Correlation of a group as an aggregate of sums."""
    n = F.count(F.when(x.isNotNull() & y.isNotNull(), 1))
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    cov = F.sum(x * y) - F.sum(x) * F.sum(y) / n
    vx, vy = F.sum(x * x) - F.sum(x) * F.sum(x) / n, F.sum(y * y) - F.sum(y) * F.sum(y) / n
    return F.when((n >= least) & (vx > 1e-12) & (vy > 1e-12), cov / F.sqrt(F.when((vx > 1e-12) & (vy > 1e-12), vx * vy)))


def daily_ic(df: DataFrame, factor: str, target: str, least: int = 5, method: str = "spearman", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, t, ic, n): correlation of factor and target over the cells where both are there, by their ordinal ranks."""
    ok = F.col(factor).isNotNull() & F.col(target).isNotNull()
    if method == "spearman":
        part = [*by, "t"]
        rank = lambda c: F.when(ok, F.row_number().over(W.partitionBy(*part).orderBy(F.when(ok, F.col(c)).asc_nulls_last(), "code")).cast("double"))
        df = df.withColumns({"_x": rank(factor), "_y": rank(target)})
    else:
        df = df.withColumns({"_x": F.when(ok, F.col(factor)), "_y": F.when(ok, F.col(target))})
    return df.groupBy(*by, "t").agg(pearson(F.col("_x"), F.col("_y"), least).alias("ic"), F.count("_x").alias("n"))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / F.when(b > 0, b))


def summarize_ic(ic: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    v, n = F.col("ic"), F.count("ic")
    ir = ratio(F.avg(v), F.stddev_samp(v))
    return ic.groupBy(*by).agg(F.avg(v).alias("ic_mean"), F.stddev_samp(v).alias("ic_std"), ir.alias("icir"), (ir * YEAR**0.5).alias("icir_ann"), (ir * F.sqrt(n)).alias("t_stat"), F.avg((v > 0).cast("double")).alias("positive_rate"), n.alias("n_days"), (n / F.count(F.lit(1))).alias("coverage"))


def ic_report(df: DataFrame, factor: str, targets: list[str], least: int = 5) -> DataFrame:
    """A summary row a target, in one pass over the unpivoted targets."""
    long = df.select("t", "code", F.col(factor).alias("_f"), F.explode(F.array(*[F.struct(F.lit(c).alias("target"), F.col(c).cast("double").alias("_v")) for c in targets])).alias("s")).select("t", "code", "_f", "s.*")
    return summarize_ic(daily_ic(long, "_f", "_v", least, by=("target",)), by=("target",))


def daily_auc(df: DataFrame, score: str, y: str = "y", least: int = 5, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, t, auc): rank-sum form over the cells with score and label; NULL unless both classes are there."""
    ok = F.col(score).isNotNull() & F.col(y).isNotNull()
    w = W.partitionBy(*by, "t").orderBy(F.when(ok, F.col(score)).asc_nulls_last(), "code")
    df = df.withColumns({"_r": F.when(ok, F.row_number().over(w).cast("double")), "_y": F.when(ok, F.col(y))})
    n, p = F.count("_r"), F.sum("_y")
    both = (n >= least) & (p > 0) & (p < n)
    auc = F.when(both, (F.sum(F.col("_r") * F.col("_y")) - p * (p + 1) / 2) / F.when(both, p * (n - p)))
    return df.groupBy(*by, "t").agg(auc.alias("auc"))


def daily_gini(df: DataFrame, score: str, y: str = "y", least: int = 5, by: tuple[str, ...] = ()) -> DataFrame:
    return daily_auc(df, score, y, least, by).select(*by, "t", (2 * F.col("auc") - 1).alias("gini"))


def summarize_daily(df: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    v = F.col(value)
    return df.groupBy(*by).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), ratio(F.avg(v), F.stddev_samp(v)).alias("ir"), F.count(v).alias("n_days"), (F.count(v) / F.count(F.lit(1))).alias("coverage"))


def ranked(df: DataFrame, score: str, name: str = "rank") -> DataFrame:
    """Adds the place of each scored cell of a date, best first, ties by code; NULL scores have none."""
    w = W.partitionBy("t").orderBy(F.col(score).desc_nulls_last(), "code")
    return df.withColumn(name, F.when(F.col(score).isNotNull(), F.row_number().over(w)))


def precision_at_k(df: DataFrame, score: str, k: int, y: str = "y") -> DataFrame:
    """(t, precision, base): the picks are made before outcomes are known, and any unobserved one makes the date NULL."""
    picked = F.when(F.col("rank") <= k, F.col(y))
    return ranked(df, score).groupBy("t").agg(F.when(F.count(picked) == k, F.avg(picked)).alias("precision"), F.avg(y).alias("base"))


def lift_at_k(df: DataFrame, score: str, k: int, y: str = "y") -> DataFrame:
    p = precision_at_k(df, score, k, y)
    return p.agg(F.avg(ratio(F.col("precision"), F.col("base"))).alias("lift"), F.count_if(F.col("precision").isNotNull() & (F.col("base") > 0)).alias("n_days"))


def top_k_hit(df: DataFrame, score: str, k: int, y: str = "y") -> DataFrame:
    """Hit rate of the daily top k with an unobserved outcome as no hit, the pooled base rate, and lift."""
    day = ranked(df, score).groupBy("t").agg(F.count(score).alias("n"), F.sum(F.when(F.col("rank") <= k, F.coalesce(F.col(y), F.lit(0.0)))).alias("hits"), F.sum(y).alias("s"), F.count(y).alias("c"))
    enough = F.col("n") >= k
    hit = ratio(F.sum(F.when(enough, F.col("hits"))), F.count_if(enough) * k)
    base = ratio(F.sum("s"), F.sum("c"))
    return day.agg(hit.alias("hit_rate"), base.alias("base_rate"), ratio(hit, base).alias("lift"), F.avg(enough.cast("double")).alias("coverage"))


def factor_correlation(df: DataFrame, factors: list[str], least: int = 100) -> DataFrame:
    """(a, b, corr): of the date-wise ordinal ranks of each pair of factors, over all cells with both, in one pass."""
    rk = df.withColumns({f"_r{i}": F.when(F.col(c).isNotNull(), F.row_number().over(W.partitionBy("t").orderBy(F.col(c).asc_nulls_last(), "code")) / F.count(c).over(W.partitionBy("t"))) for i, c in enumerate(factors)})
    pairs = [(i, j) for i in range(len(factors)) for j in range(i + 1, len(factors))]
    wide = rk.agg(*[pearson(F.col(f"_r{i}"), F.col(f"_r{j}"), least).alias(f"c{i}_{j}") for i, j in pairs])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(factors[i]).alias("a"), F.lit(factors[j]).alias("b"), F.col(f"c{i}_{j}").alias("corr")) for i, j in pairs])))


def screen_features(df: DataFrame, features: list[str], target: str, least: int = 5, min_coverage: float = 0.2) -> DataFrame:
    """(feature, ic_mean, abs_ic, coverage) by falling |IC|; features defined in too few cells are left out."""
    long = df.select("t", "code", F.col(target).alias("_y"), F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("_x")) for c in features])))
    ic = daily_ic(long, "_x", "_y", least, by=("feature",)).groupBy("feature").agg(F.avg("ic").alias("ic_mean"))
    cov = df.agg(*[(F.count(c) / F.count(F.lit(1))).alias(c) for c in features]).select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("coverage")) for c in features])))
    return ic.join(cov, "feature").where(F.col("coverage") >= min_coverage).select("feature", "ic_mean", F.abs("ic_mean").alias("abs_ic"), "coverage")


def select_features(scores: list[tuple[str, float]], corr: dict[tuple[str, str], float | None], n_keep: int, max_corr: float = 0.7, floor: float = 0.005) -> list[str]:
    """Greedy choice by falling |IC| of features not too correlated with those kept; ends below the floor."""
    kept: list[str] = []
    for name, ic in sorted(scores, key=lambda s: (-abs(s[1]), s[0])):
        if len(kept) == n_keep or abs(ic) < floor:
            break
        if all(abs(corr.get((name, k), corr.get((k, name))) or 0) <= max_corr for k in kept):
            kept.append(name)
    return kept


def quantile_table(df: DataFrame, score: str, outcomes: list[str], bins: int = 5) -> DataFrame:
    """(bin, n, n_dates, n_{o}, mean_{o}...): equal-count bins of each date's scores."""
    from ..functions.ops import quantile_bin

    aggs = [F.count(F.lit(1)).alias("n"), F.countDistinct("t").alias("n_dates")]
    aggs += [a for o in outcomes for a in (F.count(o).alias(f"n_{o}"), F.avg(o).alias(f"mean_{o}"))]
    return df.withColumn("bin", quantile_bin(F.col(score), bins)).where("bin is not null").groupBy("bin").agg(*aggs)


def quantile_monotonicity(tab: DataFrame, value: str, bins: int = 5) -> DataFrame:
    """(spread, rank_corr) of the bins' means: last minus first, and the correlation of bin and rank of the mean."""
    r = tab.withColumn("_r", F.row_number().over(W.orderBy(F.col(value).asc_nulls_last(), "bin")).cast("double"))  # a row a bin
    spread = F.max(F.when(F.col("bin") == bins, F.col(value))) - F.max(F.when(F.col("bin") == 1, F.col(value)))
    return r.agg(spread.alias("spread"), pearson(F.col("bin").cast("double"), F.col("_r"), 3).alias("rank_corr"))
