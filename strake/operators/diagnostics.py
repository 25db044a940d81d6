"""Diagnostics of a score: per date, per window of dates, per factor; audits of what the picks could have traded."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..common import finite
from ..functions import ops as o
from ..functions.expr import compile_text
from .audits import correlation_p, shuffle_hash
from .metrics import pearson
from .portfolio import net_return, over_time
from .relational import ContractError


def _place(x: Column, ok: Column) -> Column:
    return F.when(ok, F.row_number().over(W.partitionBy("t").orderBy(F.when(ok, x).asc_nulls_last(), "code")).cast("double"))


def daily_diagnostics(df: DataFrame, score: str, ret: str, y: str, k: int, wide: int = 10, cost: float = 0.0, least: int = 5) -> DataFrame:
    """(t, hit_ic, close_ic, gini, top_gross, top_net, wide_gross, wide_hit, pool_mean, execution_rate, turnover), in one pass.

    top_ is the mean of the k best-scored names and wide_ that of the ``wide`` best, a missing outcome counting 0; NULL on
    dates with fewer scored names. cost is a rate a side. turnover: share of the k picks that are new.
    """
    x, r, hit = F.col(score), F.col(ret), F.col(y)
    with_y, with_r = x.isNotNull() & hit.isNotNull(), x.isNotNull() & r.isNotNull()
    best = F.when(x.isNotNull(), F.row_number().over(W.partitionBy("t").orderBy(x.desc_nulls_last(), "code")))
    day = df.withColumns({"_a": _place(x, with_y), "_b": _place(hit, with_y), "_c": _place(x, with_r), "_d": _place(r, with_r), "_p": best})
    n, pos = F.count("_a"), F.sum(F.when(F.col("_a").isNotNull(), hit))
    both = (n >= least) & (pos > 0) & (pos < n)
    auc = F.when(both, (F.sum(F.col("_a") * hit) - pos * (pos + 1) / 2) / F.when(both, pos * (n - pos)))
    top = lambda c, m: F.when(F.count(x) >= m, F.coalesce(F.sum(F.when(F.col("_p") <= m, c)), F.lit(0.0)) / m)
    out = day.groupBy("t").agg(
        pearson(F.col("_a"), F.col("_b"), least).alias("hit_ic"), pearson(F.col("_c"), F.col("_d"), least).alias("close_ic"), (2 * auc - 1).alias("gini"),
        top(r, k).alias("top_gross"), top(net_return(r, cost, cost), k).alias("top_net"), top(r, wide).alias("wide_gross"), top(hit, wide).alias("wide_hit"),
        F.avg(r).alias("pool_mean"), F.when(F.count(x) >= k, F.count(F.when(F.col("_p") <= k, r)) / k).alias("execution_rate"),
        F.collect_list(F.when(F.col("_p") <= k, F.col("code"))).alias("_s"),
    )
    fresh = 1 - F.size(F.array_intersect("_s", F.lag("_s").over(over_time()))) / F.size("_s")  # k codes a date
    return out.withColumn("turnover", F.when(F.size("_s") > 0, fresh)).drop("_s")


def monitors(days: DataFrame, windows: dict[str, tuple[int, int]]) -> DataFrame:
    """(window, objective, wide_hit, hit_ic, close_ic, gini, n_days): daily diagnostics averaged over spans [lo, hi) of dates."""
    member = [F.when((F.col("t") >= lo) & (F.col("t") < hi), F.lit(name)) for name, (lo, hi) in windows.items()]
    each = days.withColumn("window", F.explode(F.array_compact(F.array(*member))))
    means = [F.avg(c).alias(n) for c, n in (("top_net", "objective"), ("wide_hit", "wide_hit"), ("hit_ic", "hit_ic"), ("close_ic", "close_ic"), ("gini", "gini"))]
    return each.groupBy("window").agg(*means, F.count("top_net").alias("n_days"))


def library_alignment(df: DataFrame, factors: dict[str, str], ret: str, k: int, fit: tuple[int, int], selection: tuple[int, int], cost: float = 0.0) -> DataFrame:
    """(factor, fit_net, selection_net, n_fit, n_selection): each expression's mean daily top-k return in both spans."""
    wide = df.select("t", "code", ret, *[finite(compile_text(e, df.columns, "event")).alias(n) for n, e in factors.items()])
    long = wide.select("t", "code", ret, F.inline(F.array(*[F.struct(F.lit(n).alias("factor"), F.col(n).alias("x")) for n in factors])))
    w = W.partitionBy("factor", "t").orderBy(F.col("x").desc_nulls_last(), "code")
    picked = F.when((F.row_number().over(w) <= k) & F.col("x").isNotNull(), net_return(F.col(ret), cost, cost))
    day = long.withColumn("_v", picked).groupBy("factor", "t").agg(F.when(F.count("x") >= k, F.coalesce(F.sum("_v"), F.lit(0.0)) / k).alias("v"))
    part = lambda span: F.when((F.col("t") >= span[0]) & (F.col("t") < span[1]), F.col("v"))
    return day.groupBy("factor").agg(F.avg(part(fit)).alias("fit_net"), F.avg(part(selection)).alias("selection_net"), F.count(part(fit)).alias("n_fit"), F.count(part(selection)).alias("n_selection"))


def average_tie_ic(df: DataFrame, score: str, target: str, least: int = 5) -> DataFrame:
    """(t, ic): rank correlation with tied values at their mean rank."""
    ok = F.col(score).isNotNull() & F.col(target).isNotNull()

    def rank(c: str) -> Column:
        v = F.when(ok, F.col(c))
        return F.when(ok, F.rank().over(W.partitionBy("t").orderBy(v.asc_nulls_last())) + (F.count(v).over(W.partitionBy("t", v)) - 1) / 2)

    return df.withColumns({"_x": rank(score), "_y": rank(target)}).groupBy("t").agg(pearson(F.col("_x"), F.col("_y"), least).alias("ic"))


def correlation_test(df: DataFrame, x: str, y: str, by: str) -> DataFrame:
    """(by, n, r, p): Pearson correlation of the rows with both and its two-sided p-value; NULL without three or variation."""
    n = F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1))
    sums = df.groupBy(by).agg(n.alias("n"), pearson(F.col(x), F.col(y), 3).alias("r"))  # only a row a group goes to Python

    def test(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(p=[None if pd.isna(r) else correlation_p(r, n) for r, n in zip(f["r"], f["n"])])

    return sums.mapInPandas(test, f"`{by}` {sums.schema[by].dataType.simpleString()}, n bigint, r double, p double")


def feasibility(picks: DataFrame, outcome: str, entry: str, liquidity: str) -> DataFrame:
    """One row: number of picks, shares without an outcome, without an entry price, in the bottom decile of liquidity (a
    percentile from 0 to 1), and the median of it."""
    share = lambda c: F.avg(c.cast("double"))
    return picks.agg(
        F.count(F.lit(1)).alias("picks"), share(F.col(outcome).isNull()).alias("no_outcome"), share(F.col(entry).isNull()).alias("no_entry"),
        share(F.col(liquidity) <= 0.1).alias("bottom_decile"), F.median(liquidity).alias("median_liquidity"),
    )


def bin_profile(df: DataFrame, score: str, hit: str, peak: str, close: str, liquidity: str, bins: int = 5) -> DataFrame:
    """(bin, n, hit_rate, peak, close, giveback, median_liquidity, bottom_decile, turnover) of each date's equal-count bins."""
    x = df.withColumn("bin", o.quantile_bin(F.col(score), bins)).where("bin is not null")
    tab = x.groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(hit).alias("hit_rate"), F.avg(peak).alias("peak"), F.avg(close).alias("close"), (F.avg(peak) - F.avg(close)).alias("giveback"),
        F.median(liquidity).alias("median_liquidity"), F.avg((F.col(liquidity) <= 0.1).cast("double")).alias("bottom_decile"),
    )
    # a name is kept where the code's bin is the same on the session's predecessor among the bin's dates
    dates = x.select("bin", "t").distinct().withColumn("_before", F.lag("t").over(W.partitionBy("bin").orderBy("t")))  # a row a bin and date
    now = x.select("bin", "t", "code").join(dates, ["bin", "t"]).where("_before is not null")
    old = x.select("bin", F.col("t").alias("_before"), "code", F.lit(1).alias("_kept"))
    daily = now.join(old, ["bin", "_before", "code"], "left").groupBy("bin", "t").agg((1 - F.count("_kept") / F.count(F.lit(1))).alias("_v"))
    return tab.join(daily.groupBy("bin").agg(F.avg("_v").alias("turnover")), "bin", "left")


def offset_profile(marks: DataFrame, cells: DataFrame, flag: str, lo: int, hi: int) -> DataFrame:
    """(offset, n, hits): for marked cells (t, code), how many have the flag ``offset`` sessions off, over those that exist."""
    each = marks.select("code", F.col("t").alias("_at"), F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("offset")).withColumn("t", F.col("_at") + F.col("offset"))
    met = each.join(cells.select("t", "code", F.col(flag).alias("_f")), ["t", "code"])
    return met.groupBy("offset").agg(F.count(F.lit(1)).alias("n"), F.count_if("_f").alias("hits"))


def require_control(profile: DataFrame, offset: int = 0) -> DataFrame:
    """profile, if the control offset has hits: an audit whose control finds nothing proves nothing."""
    if not profile.where((F.col("offset") == offset) & (F.col("hits") > 0)).limit(1).collect():
        raise ContractError(f"no hit at the control offset {offset}")
    return profile


def shuffled_rows(df: DataFrame, cols: list[str], key: str, seed: int = 0) -> DataFrame:
    """df with ``cols`` exchanged within each date by one permutation that all of them share; the others stay."""
    place = lambda *order: F.row_number().over(W.partitionBy("t").orderBy(*order))
    keep = df.select(*[c for c in df.columns if c not in cols]).withColumn("_i", place("code", key))
    moved = df.select("t", "code", key, *cols).withColumn("_i", place(shuffle_hash(F.col(key), F.lit(seed)), key)).drop("code", key)
    return keep.join(moved, ["t", "_i"]).select(*df.columns)


def seed_delta(runs: DataFrame, arm: str, value: str, base: str) -> DataFrame:
    """(arm, mean, std, n, delta): each arm's mean over seeds, their spread, and the difference from the base arm's mean."""
    s = runs.groupBy(arm).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.count(value).alias("n"))
    b = s.where(F.col(arm) == base).select(F.col("mean").alias("_b"))
    return s.join(F.broadcast(b), how="cross").withColumn("delta", F.col("mean") - F.col("_b")).drop("_b")  # one row on the right


