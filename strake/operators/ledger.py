"""Books whose selection is frozen before any outcome is looked at, and what became of every pick."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .audits import horizon_returns
from .metrics import ranked, ratio
from .portfolio import deferred_exit, net_return
from .relational import ContractError


def collapse_duplicates(df: DataFrame, score: str, key: str, same: tuple[str, ...] = ()) -> DataFrame:
    """One row a date and code: the best score, ties by the smallest ``key``; a NULL score is the last choice.

    Rows of a date and code that differ in a column of ``same`` (a price, say) are an error: no choice could be right.
    """
    if same:
        differ = df.groupBy("t", "code").agg(F.countDistinct(F.xxhash64(*same)).alias("n")).where("n > 1").limit(1).collect()
        if differ:
            raise ContractError(f"rows of {differ[0].asDict()} differ in {', '.join(same)}")
    rest = [c for c in df.columns if c not in ("t", "code")]
    best = F.max_by(F.struct(*rest), F.struct(F.col(score), -F.col(key)))
    return df.groupBy("t", "code").agg(best.alias("_r")).select("t", "code", "_r.*").select(*df.columns)


def ledger(df: DataFrame, score: str, k: int, panel: DataFrame, entry: int = 1, touch: int = 2) -> DataFrame:
    """(t, code, rank, status, entry_price, close_price, exit_t, exit_price, exit_kind, baseline, realistic): a row a pick.

    The k best-scored names of each date that has as many are bought at the open of t + entry. baseline sells them at the
    close of t + touch, realistic as ``deferred_exit`` says; both are gross returns. status: 'no_entry' (no trade or price on
    the entry date), 'open' (never sold: its slot stays in cash), 'sold'.
    """
    w = W.partitionBy("code").orderBy("t")
    bought = F.when(F.lead("is_trading", entry).over(w) & (F.lead("open_h", entry).over(w) > 0), F.lead("open_h", entry).over(w))
    market = deferred_exit(panel.withColumns({"entry_price": bought, "close_price": F.lead("close_h", touch).over(w)}), touch)
    market = market.select("t", "code", "entry_price", "close_price", "exit_t", "exit_price", "exit_kind")
    enough = F.count(score).over(W.partitionBy("t")) >= k
    picks = ranked(df.withColumn("_enough", enough), score).where((F.col("rank") <= k) & F.col("_enough")).select("t", "code", "rank")
    status = F.when(F.col("entry_price").isNull(), "no_entry").when(F.col("exit_t").isNull(), "open").otherwise("sold")
    back = lambda c: F.col(c) / F.col("entry_price") - 1
    return picks.join(market, ["t", "code"], "left").withColumns({"status": status, "baseline": back("close_price"), "realistic": F.when(status == "sold", back("exit_price"))})


def ledger_daily(rows: DataFrame, k: int, buy: float = 0.0, sell: float = 0.0, overlap: int = 1) -> DataFrame:
    """(t, n_sold, n_open, n_no_entry, baseline, realistic): net returns of the date's book; slots without one are cash."""
    slot = lambda c: F.coalesce(F.sum(net_return(F.col(c), buy, sell)), F.lit(0.0)) / k / overlap
    counts = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("sold", "open", "no_entry")]
    return rows.groupBy("t").agg(*counts, slot("baseline").alias("baseline"), slot("realistic").alias("realistic"))


def ledger_audit(rows: DataFrame, touch: int = 2) -> DataFrame:
    """(status, exit_kind, n, mean_delay, mean_error): how late the sales were and what that changed."""
    return rows.groupBy("status", "exit_kind").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("exit_t") - F.col("t") - touch).alias("mean_delay"), F.avg(F.col("realistic") - F.col("baseline")).alias("mean_error")
    )


def paired_books(df: DataFrame, panel: DataFrame, scores: list[str], costs: list[float], k: int, most: int = 10) -> DataFrame:
    """(score, cost, h, mean, std, ir, execution_rate, n_days): the same dates' books by several scores, costs and horizons.

    Names are picked once by score; only the picks, k a date, are looked up 1..most sessions on, and only they are repeated
    for each cost (a rate a side).
    """
    long = df.select("t", "code", F.inline(F.array(*[F.struct(F.lit(c).alias("score"), F.col(c).alias("x")) for c in scores])))
    date = W.partitionBy("score", "t")
    place = F.row_number().over(date.orderBy(F.col("x").desc_nulls_last(), "code"))
    picks = long.withColumns({"_n": F.count("x").over(date), "_p": place}).where((F.col("_n") >= k) & (F.col("_p") <= k))
    arms = horizon_returns(picks.select("t", "code", "score"), panel, most).withColumn("cost", F.explode(F.array(*[F.lit(c) for c in costs])))
    net = net_return(F.col("fwd"), F.col("cost"), F.col("cost"))
    day = arms.groupBy("score", "cost", "h", "t").agg((F.coalesce(F.sum(net), F.lit(0.0)) / k / F.col("h")).alias("v"), F.count("fwd").alias("done"))
    v = F.col("v")
    return day.groupBy("score", "cost", "h").agg(
        F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), ratio(F.avg(v), F.stddev_samp(v)).alias("ir"), (F.avg("done") / k).alias("execution_rate"), F.count(v).alias("n_days")
    )
