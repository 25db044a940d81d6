"""Outcomes, and the splits of dates that keep them out of training."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ops as o


def touch_label(panel: DataFrame, ratio: float, entry: int = 1, touch: int = 2, mask: str | None = None) -> DataFrame:
    """Adds entry_price, target_price, exit_price, valid and y: whether the high of date t + touch reaches ratio times the
    open of t + entry. y is NULL where that can't be observed: no trading on either date, a missing price, or the cell
    outside the mask. Only here a later date is looked at."""
    at = lambda c, d: o.lead(F.col(c), d)
    price = at("open_h", entry)
    target = price * ratio
    seen = F.coalesce(at("is_trading", entry), F.lit(False)) & F.coalesce(at("is_trading", touch), F.lit(False)) & (price > 0) & at("high_h", touch).isNotNull()
    valid = F.coalesce(seen & (F.col(mask) if mask else F.lit(True)), F.lit(False))
    return panel.withColumns({"entry_price": price, "target_price": target, "exit_price": at("close_h", touch), "valid": valid, "y": F.when(valid, (at("high_h", touch) >= target).cast("double"))})


@dataclass(frozen=True)
class Fold:
    index: int
    train: tuple[int, int]
    valid: tuple[int, int]
    test: tuple[int, int]


def walk_forward(n: int, train: int, valid: int, test: int, gap: int, step: int | None = None) -> list[Fold]:
    """Folds of date ordinals [lo, hi): train, gap, valid, gap, test, each ``step`` later than the one before."""
    block = train + gap + valid + gap + test
    if n < block:
        raise ValueError(f"{n} dates are too few for a fold of {block}")
    out = []
    for k, lo in enumerate(range(0, n - block + 1, step or test)):
        v = lo + train + gap
        s = v + valid + gap
        out.append(Fold(k, (lo, lo + train), (v, v + valid), (s, s + test)))
    return out


def folds_table(spark: SparkSession, folds: list[Fold]) -> DataFrame:
    rows = [(f.index, role, *getattr(f, role)) for f in folds for role in ("train", "valid", "test")]
    return spark.createDataFrame(rows, "fold int, role string, t_lo int, t_hi int")


def in_folds(df: DataFrame, folds: list[Fold]) -> DataFrame:
    """A copy of each row for every fold and role its date is in. The folds are few and known beforehand."""
    f = F.broadcast(folds_table(df.sparkSession, folds))
    return df.join(f, (F.col("t") >= F.col("t_lo")) & (F.col("t") < F.col("t_hi"))).drop("t_lo", "t_hi")


def outcome_complete(lo: int, hi: int, horizon: int) -> tuple[int, int]:
    """Dates [lo, hi) without the last ones, whose outcome lies beyond."""
    return lo, max(lo, hi - horizon)


def exit_before(df: DataFrame, cal: DataFrame, horizon: int, end: str) -> DataFrame:
    """df's rows whose exit, ``horizon`` sessions after t, is on the calendar (t, trade_date) and not after ``end``, with
    exit_date."""
    days = cal.select((F.col("t") - horizon).alias("t"), F.col("trade_date").alias("exit_date"))
    return df.join(F.broadcast(days), "t").where(F.col("exit_date") <= end)


def search_window(n: int, days: int) -> tuple[int, int]:
    """The first ``days`` of n dates, which a search may look at."""
    if days < 1:
        raise ValueError("a search needs a date")
    return 0, min(n, days)


def fit_selection(lo: int, hi: int, share: float = 0.8, embargo: int = 2, least: int = 20) -> tuple[tuple[int, int], tuple[int, int]]:
    """The earlier dates to fit on and, after an embargo, the later ones to select on."""
    cut = lo + int(share * (hi - lo))
    fit, sel = (lo, cut), (cut + embargo, hi)
    if fit[1] - fit[0] < least or sel[1] - sel[0] < least:
        raise ValueError("too few dates to fit and select on")
    return fit, sel


def positive_weight(df: DataFrame, y: str = "y", most: float = 20.0) -> DataFrame:
    """Negatives per positive, at most ``most``; 1 without positives."""
    pos, n = F.sum(y), F.count(y)
    return df.agg(F.when(pos > 0, F.least((n - pos) / F.when(pos > 0, pos), F.lit(most))).otherwise(1.0).alias("weight"))


def sequences(panel: DataFrame, fields: list[str], length: int) -> DataFrame:
    """(t, code, steps): the last ``length`` dates' fields, oldest first, NULL as 0, with whether the date was traded; only
    cells with a full look-back."""
    step = F.struct("t", *[F.coalesce(F.col(c).cast("float"), F.lit(0.0).cast("float")).alias(c) for c in fields], F.col("is_trading").cast("float").alias("traded"))
    seq = F.collect_list(step).over(o.along(length))
    return panel.select("t", "code", seq.alias("steps")).where(F.size("steps") == length)
