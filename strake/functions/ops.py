"""Panel operators as Column builders, and their registry.

A panel is a long DataFrame with ``t`` (ordinal of the date), ``code`` and value columns, dense over dates x codes, so
that row frames are calendar frames. Missing is NULL and propagates; NaN and infinities become NULL at the scan.
Trailing operators look back only and need a full window of values. Ranks break ties by code.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EPS = 1e-9
T, CODE = "t", "code"


def along(d: int | None = None):
    """Window over a code's dates; the last d of them."""
    w = W.partitionBy(CODE).orderBy(T)
    return w if d is None else w.rowsBetween(1 - d, 0)


def across():
    """Window over a date's codes."""
    return W.partitionBy(T)


def _positive(d: int) -> int:
    if int(d) != d or d < 1:
        raise ValueError(f"a window must be a positive whole number, not {d}")
    return int(d)


def full(x: Column, d: int, e: Column) -> Column:
    """e where all of the last d values of x are there."""
    return F.when(F.count(x).over(along(d)) == d, e)


# element-wise


def div(x: Column, y: Column) -> Column:
    return F.when(F.abs(y) >= EPS, x / F.when(F.abs(y) >= EPS, y))


def log_abs(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def sqrt_abs(x: Column) -> Column:
    return F.signum(x) * F.sqrt(F.abs(x))


def log_floor(x: Column) -> Column:
    return F.when(x.isNotNull(), F.ln(F.greatest(x, F.lit(EPS))))


def both(f: Callable, x: Column, y: Column) -> Column:
    """greatest or least, NULL where either is."""
    return F.when(x.isNotNull() & y.isNotNull(), f(x, y))


# across a date


def cs_rank_ordinal(x: Column) -> Column:
    w = across().orderBy(x.asc_nulls_last(), F.col(CODE))
    return F.when(x.isNotNull(), F.row_number().over(w)).otherwise(0)


def cs_rank(x: Column) -> Column:
    w = across().orderBy(x.asc_nulls_last(), F.col(CODE))
    return F.when(x.isNotNull(), F.row_number().over(w) / F.count(x).over(across()))


def cs_pct_rank(x: Column) -> Column:
    """Share of the rank among the date's values, ties sharing their mean rank."""
    w = across().orderBy(x.asc_nulls_last())
    ties = F.count(x).over(W.partitionBy(T, x))
    return F.when(x.isNotNull(), (F.rank().over(w) + (ties - 1) / 2) / F.count(x).over(across()))


def cs_zscore(x: Column, ddof: int = 0) -> Column:
    std = (F.stddev_samp if ddof else F.stddev_pop)(x).over(across())
    if ddof:
        return F.when(x.isNotNull(), F.when(std > 0, (x - F.avg(x).over(across())) / std).otherwise(0.0))
    return F.when(std >= EPS, (x - F.avg(x).over(across())) / std)


def cs_demean(x: Column) -> Column:
    return x - F.avg(x).over(across())


def clip_sigma(x: Column, n: float = 3.0) -> Column:
    mean, std = F.avg(x).over(across()), F.stddev_pop(x).over(across())
    return F.when(x.isNotNull(), F.least(F.greatest(x, mean - n * std), mean + n * std))


def normalize(x: Column, mask: Column, n: float = 3.0) -> Column:
    """Z-score of the masked cells, clipped; NULL elsewhere."""
    return clip_sigma(cs_zscore(F.when(mask, x)), n)


def robust_z(x: Column) -> Column:
    med = F.median(x).over(across())
    scale = 1.4826 * F.median(F.abs(x - med)).over(across())
    return F.when(scale > 1e-12, (x - med) / scale)


def quantile_bin(x: Column, n: int = 5) -> Column:
    """Bin 1..n of equal counts by ordinal rank, edges as linear quantiles of the ranks."""
    r = F.row_number().over(across().orderBy(x.asc_nulls_last(), F.col(CODE)))
    m = F.count(x).over(across())
    return F.when(x.isNotNull() & (m > 1), F.greatest(F.lit(1), F.floor((n * (r - 1) + m - 2) / (m - 1)))).cast("int")


# along a code's dates


def delay(x: Column, d: int) -> Column:
    return F.lag(x, _positive(d)).over(along())


def lead(x: Column, d: int) -> Column:
    """Looks ahead: for outcomes only, and not in the registry."""
    return F.lead(x, _positive(d)).over(along())


def ts_mean(x: Column, d: int) -> Column:
    return full(x, _positive(d), F.avg(x).over(along(d)))


def ts_sum(x: Column, d: int) -> Column:
    return full(x, _positive(d), F.sum(x).over(along(d)))


def ts_std(x: Column, d: int) -> Column:
    return full(x, _positive(d), F.stddev_samp(x).over(along(d)))


def ts_max(x: Column, d: int) -> Column:
    return full(x, _positive(d), F.max(x).over(along(d)))


def ts_min(x: Column, d: int) -> Column:
    return full(x, _positive(d), F.min(x).over(along(d)))


def ts_rank(x: Column, d: int) -> Column:
    seen = F.collect_list(x).over(along(_positive(d)))
    below, ties = F.size(F.filter(seen, lambda v: v < x)), F.size(F.filter(seen, lambda v: v == x))
    return full(x, d, (below + (ties + 1) / 2) / d)


def _since(x: Column, d: int, pick: Column) -> Column:
    return full(x, d, (F.col(T) - pick) / (d - 1)) if d > 1 else full(x, d, F.lit(0.0))


def ts_argmax(x: Column, d: int) -> Column:
    """Share of the window passed since its first maximum."""
    return _since(x, _positive(d), -F.max(F.when(x.isNotNull(), F.struct(x.alias("x"), (-F.col(T)).alias("t")))).over(along(d))["t"])


def ts_argmin(x: Column, d: int) -> Column:
    return _since(x, _positive(d), F.min(F.when(x.isNotNull(), F.struct(x.alias("x"), F.col(T).alias("t")))).over(along(d))["t"])


def ts_delta(x: Column, d: int) -> Column:
    return x - delay(x, d)


def ts_pct(x: Column, d: int) -> Column:
    return div(x - delay(x, d), F.abs(delay(x, d)))


def ts_zscore(x: Column, d: int) -> Column:
    return div(x - ts_mean(x, d), ts_std(x, d))


def _pairs(x: Column, y: Column) -> tuple[Column, Column]:
    return F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)


def ts_cov(x: Column, y: Column, d: int) -> Column:
    x, y = _pairs(x, y)
    return full(x, _positive(d), F.covar_samp(x, y).over(along(d)))


def ts_corr(x: Column, y: Column, d: int) -> Column:
    """Pearson correlation; NULL where either side does not vary."""
    x, y = _pairs(x, y)
    w = along(_positive(d))
    sx, sy = F.stddev_samp(x).over(w), F.stddev_samp(y).over(w)
    return full(x, d, F.when((sx > EPS) & (sy > EPS), F.covar_samp(x, y).over(w) / F.when((sx > EPS) & (sy > EPS), sx * sy)))


def ts_decay(x: Column, d: int) -> Column:
    """Mean weighted 1..d, the newest heaviest."""
    seen = F.collect_list(x).over(along(_positive(d)))
    weighted = F.aggregate(F.transform(seen, lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return full(x, d, weighted / (d * (d + 1) / 2))


@dataclass(frozen=True)
class Operator:
    """columns: how many expressions it takes; windowed: whether a window length follows; event: whether it may be used
    where a row's neighbours in time are other entities."""

    name: str
    build: Callable[..., Column]
    columns: int
    windowed: bool = False
    event: bool = True


REGISTRY: dict[str, Operator] = {}


def register(name: str, build: Callable[..., Column], columns: int, windowed: bool = False) -> None:
    """Adds an operator to the expression language."""
    REGISTRY[name] = Operator(name, build, columns, windowed, event=not windowed)


for _name, _build in {"add": lambda x, y: x + y, "sub": lambda x, y: x - y, "mul": lambda x, y: x * y, "div": div}.items():
    register(_name, _build, 2)
for _name, _build in {"neg": lambda x: -x, "abs": F.abs, "sign": F.signum, "log": log_abs, "sqrt": sqrt_abs, "cs_rank": cs_rank, "cs_zscore": cs_zscore, "cs_demean": cs_demean}.items():
    register(_name, _build, 1)
for _name, _build in {"ts_delay": delay, "ts_delta": ts_delta, "ts_pct": ts_pct, "ts_mean": ts_mean, "ts_std": ts_std, "ts_sum": ts_sum, "ts_max": ts_max, "ts_min": ts_min, "ts_rank": ts_rank, "ts_argmax": ts_argmax, "ts_argmin": ts_argmin, "ts_zscore": ts_zscore, "ts_decay": ts_decay}.items():
    register(_name, _build, 1, True)
for _name, _build in {"ts_corr": ts_corr, "ts_cov": ts_cov}.items():
    register(_name, _build, 2, True)
