"""Top-K portfolios and their accounting. A pick is made on the score alone; a failed one stays in cash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .metrics import YEAR, ranked, ratio


def over_time():
    """Window over a series of one row a date, which a single task may run over."""
    return W.orderBy("t")


def top_k_portfolio(df: DataFrame, score: str, ret: str, k: int, overlap: int = 1) -> DataFrame:
    """(t, portfolio_return, executed): sum of the k best-scored names' returns / k / overlap, a missing return counting 0;
    NULL and 0 on dates with fewer than k scored names."""
    pick = F.when(F.col("rank") <= k, F.col(ret))
    enough = F.count("rank") >= k
    return ranked(df, score).groupBy("t").agg(F.when(enough, F.coalesce(F.sum(pick), F.lit(0.0)) / k / overlap).alias("portfolio_return"), F.when(enough, F.count(pick)).otherwise(0).alias("executed"))


def summarize_objective(port: DataFrame, k: int) -> DataFrame:
    v, n = F.col("portfolio_return"), F.count("portfolio_return")
    return port.agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), ratio(F.avg(v), F.stddev_samp(v)).alias("ir"), F.avg((v > 0).cast("double")).alias("positive_rate"), ratio(F.sum(F.when(v.isNotNull(), F.col("executed"))), n * k).alias("execution_rate"), (n / F.count(F.lit(1))).alias("coverage"), n.alias("n_days"))


def net_return(gross: Column, buy: float | Column, sell: float | Column) -> Column:
    """Multiplicative costs of a round trip, as rates."""
    return (1 + gross) * (1 - sell) / (1 + buy) - 1


def backtest(df: DataFrame, score: str, ret: str, y: str, k: int, buy: float = 0.0, sell: float = 0.0, overlap: int = 1, target: float | None = None) -> DataFrame:
    """(t, n_available, n_executed, hit_rate, base_rate, gross_return, net_return, portfolio_return) of dates with k names.

    Whether a pick is executed (its return is there) is known only after the pick. With ``target`` a pick that hit (y > 0) was
    sold at that gain, any other at the close.
    """
    done = (F.col("rank") <= k) & F.col(ret).isNotNull()
    gross = F.col(ret) if target is None else F.when(F.col(y) > 0, F.lit(target)).otherwise(F.col(ret))
    net = net_return(gross, buy, sell)
    day = ranked(df, score).groupBy("t").agg(
        F.count("rank").alias("n_available"), F.count_if(done).alias("n_executed"), F.avg(F.when(done, F.col(y))).alias("hit_rate"), F.avg(F.when(F.col("rank").isNotNull(), F.col(y))).alias("base_rate"),
        F.avg(F.when(done, gross)).alias("gross_return"), F.avg(F.when(done, net)).alias("net_return"), (F.coalesce(F.sum(F.when(done, net)), F.lit(0.0)) / k / overlap).alias("portfolio_return"),
    )
    return day.where(F.col("n_available") >= k)


def summarize_backtest(day: DataFrame, k: int) -> DataFrame:
    p = F.col("portfolio_return")
    vol = F.stddev_samp(p)
    trades = F.sum(F.col("net_return") * F.col("n_executed"))
    return day.agg(
        F.count(F.lit(1)).alias("n_days"), F.avg("n_executed").alias("avg_executed"), (F.sum("n_executed") / (F.count(F.lit(1)) * k)).alias("fill_rate"), F.avg("hit_rate").alias("hit_rate"), F.avg("base_rate").alias("base_rate"),
        ratio(F.avg("hit_rate"), F.avg("base_rate")).alias("lift"), ratio(trades, F.sum("n_executed")).alias("mean_trade_return_net"), (F.avg(p) * YEAR).alias("ann_return"), (vol * YEAR**0.5).alias("ann_vol"), (ratio(F.avg(p), vol) * YEAR**0.5).alias("sharpe"),
    )


def equity_curve(day: DataFrame, value: str = "portfolio_return") -> DataFrame:
    """(t, value, equity, drawdown, drawdown_start): the drawdown from the highest equity so far, without and with the
    starting equity 1 as a peak. One row a date, so that one task may run over it."""
    ok = day.where(F.col(value).isNotNull()).select("t", value)
    eq = ok.withColumn("equity", F.product(1 + F.col(value)).over(over_time().rowsBetween(W.unboundedPreceding, 0)))
    peak = F.max("equity").over(over_time().rowsBetween(W.unboundedPreceding, 0))
    return eq.withColumns({"drawdown": F.col("equity") / peak - 1, "drawdown_start": F.col("equity") / F.greatest(peak, F.lit(1.0)) - 1})


def loss_streaks(day: DataFrame, value: str = "portfolio_return") -> DataFrame:
    """(first_t, last_t, days) of every run of losing dates."""
    n = day.where(F.col(value).isNotNull()).withColumns({"_i": F.row_number().over(over_time()), "_loss": F.col(value) < 0})
    run = n.withColumn("_g", F.col("_i") - F.row_number().over(W.partitionBy("_loss").orderBy("t")))
    return run.where("_loss").groupBy("_g").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count(F.lit(1)).alias("days")).drop("_g")


def performance(day: DataFrame, value: str = "portfolio_return") -> DataFrame:
    """One row: cagr, win rate, profit/loss ratio, longest loss streak, annual return and volatility, Sharpe ratio, worst
    drawdown with the starting equity as a peak, final equity."""
    v = F.col(value)
    curve = equity_curve(day, value)
    n, final = F.count(F.lit(1)), F.max_by("equity", "t")
    stats = curve.agg(
        F.when(final > 0, F.pow(final, YEAR / n) - 1).otherwise(-1.0).alias("cagr"), F.avg((v > 0).cast("double")).alias("day_win_rate"), ratio(F.avg(F.when(v > 0, v)), F.abs(F.avg(F.when(v < 0, v)))).alias("profit_loss_ratio"),
        (F.avg(v) * YEAR).alias("ann_return"), (F.stddev_samp(v) * YEAR**0.5).alias("ann_vol"), (ratio(F.avg(v), F.stddev_samp(v)) * YEAR**0.5).alias("sharpe"), F.least(F.min("drawdown_start"), F.lit(0.0)).alias("max_drawdown"), final.alias("final_equity"),
    )
    longest = loss_streaks(day, value).agg(F.coalesce(F.max("days"), F.lit(0)).alias("max_consecutive_losses"))
    return stats.crossJoin(longest)  # one row each


def rolling_windows(day: DataFrame, length: int, value: str = "portfolio_return") -> DataFrame:
    """(start_t, compounded, positive_rate, max_drawdown) of every run of ``length`` dates, from its own start at 1."""
    ok = day.where(F.col(value).isNotNull())
    w = over_time().rowsBetween(0, length - 1)
    lists = ok.select("t", F.collect_list(value).over(w).alias("r")).where(F.size("r") == length)
    step = F.aggregate("r", F.struct(F.lit(1.0).alias("e"), F.lit(1.0).alias("p"), F.lit(0.0).alias("d")), lambda a, x: F.struct((a["e"] * (1 + x)).alias("e"), F.greatest(a["p"], a["e"] * (1 + x)).alias("p"), F.least(a["d"], a["e"] * (1 + x) / F.greatest(a["p"], a["e"] * (1 + x)) - 1).alias("d")))
    return lists.withColumn("s", step).select(F.col("t").alias("start_t"), (F.col("s.e") - 1).alias("compounded"), (F.size(F.filter("r", lambda x: x > 0)) / length).alias("positive_rate"), F.col("s.d").alias("max_drawdown"))


def turnover(df: DataFrame, score: str, k: int) -> DataFrame:
    """(t, turnover): share of the date's k picks that were not among those of the date before; NULL on the first."""
    sets = ranked(df, score).where(F.col("rank") <= k).groupBy("t").agg(F.collect_set("code").alias("s"))
    return sets.select("t", (1 - F.size(F.array_intersect("s", F.lag("s").over(over_time()))) / k).alias("turnover"))


def event_book(df: DataFrame, score: str, ret: str, fillable: str, signal_k: int, hold_k: int, least_score: float | None = None) -> DataFrame:
    """(t, held, depth, portfolio_return): of the signal_k best-scored names the first hold_k that can be filled; depth is
    the place of the last of them. Slots that stay empty are cash; a date without any is flat, not dropped."""
    if least_score is not None:
        df = df.withColumn(score, F.when(F.col(score) >= least_score, F.col(score)))
    short = ranked(df, score).withColumn("_ok", F.col("rank").isNotNull() & (F.col("rank") <= signal_k) & F.col(fillable))
    place = F.when(F.col("_ok"), F.row_number().over(W.partitionBy("t", "_ok").orderBy("rank")))
    held = F.col("_place") <= hold_k
    return short.withColumn("_place", place).groupBy("t").agg(F.count_if(held).alias("held"), F.max(F.when(held, F.col("rank"))).alias("depth"), (F.coalesce(F.sum(F.when(held, F.col(ret))), F.lit(0.0)) / hold_k).alias("portfolio_return"))


def deferred_exit(panel: DataFrame, touch: int = 2, eps: float = 0.005) -> DataFrame:
    """Adds exit_t, exit_price, exit_kind, touch_sealed, met_suspension, met_missing_limit for an entry decided on each cell.

    The panel is dense, with is_trading, down_limit, limit_observed and raw and adjusted open, high, close. On the touch
    date the position is sold at the close unless the bar is sealed at the lower limit; after it, on the first live date
    whose open, else close, is above the limit. No such date: exit_t is NULL. No recursion: each date's possible sale is a
    flag, and the exit the first one ahead.
    """
    w = W.partitionBy("code").orderBy("t")
    live = F.col("is_trading") & F.coalesce(F.col("limit_observed"), F.lit(False)) & F.col("down_limit").isNotNull()
    near = lambda c: F.coalesce(F.abs(F.col(c) - F.col("down_limit")) <= eps, F.lit(False))
    sealed = live & near("high") & near("close")
    above = lambda c: F.coalesce(F.col(c) > F.col("down_limit") + eps, F.lit(False)) & F.col(f"{c}_h").isNotNull()
    sale = lambda c, kind: F.struct(F.col("t").alias("t"), F.col(f"{c}_h").alias("price"), F.lit(kind).alias("kind"))
    at_touch = F.when(live & ~sealed & F.col("high").isNotNull() & F.col("close").isNotNull() & F.col("close_h").isNotNull(), sale("close", "touch_close"))
    later = F.when(live & above("open"), sale("open", "open")).when(live & above("close"), sale("close", "close"))
    flags = panel.withColumns({"_touch": at_touch, "_later": later, "_sealed": sealed, "_halt": F.sum((~F.col("is_trading")).cast("int")).over(w), "_blind": F.sum((F.col("is_trading") & ~live).cast("int")).over(w), "_end": F.max("t").over(W.partitionBy("code"))})
    ex = F.coalesce(F.lead("_touch", touch).over(w), F.first("_later", ignorenulls=True).over(w.rowsBetween(touch + 1, W.unboundedFollowing)))
    out = flags.withColumns({"_exit": ex, "touch_sealed": F.coalesce(F.lead("_sealed", touch).over(w), F.lit(False)), "_h1": F.lead("_halt", touch - 1).over(w), "_b1": F.lead("_blind", touch - 1).over(w)})
    last = out.select("code", F.col("t").alias("_xt"), F.col("_halt").alias("_hx"), F.col("_blind").alias("_bx"))
    out = out.withColumn("_xt", F.when(F.col("t") + touch <= F.col("_end"), F.coalesce(F.col("_exit.t"), F.col("_end"))))
    out = out.join(last, ["code", "_xt"], "left")
    return out.select(*[F.col(f"`{c}`") for c in panel.columns], F.col("_exit.t").alias("exit_t"), F.col("_exit.price").alias("exit_price"), F.col("_exit.kind").alias("exit_kind"), "touch_sealed", F.coalesce(F.col("_hx") > F.col("_h1"), F.lit(False)).alias("met_suspension"), F.coalesce(F.col("_bx") > F.col("_b1"), F.lit(False)).alias("met_missing_limit"))
