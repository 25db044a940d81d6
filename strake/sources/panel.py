"""The two inputs of the panel queries: a dense panel of daily bars, and the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..common import finite, norm_code, plain_date, table

BAR_FIELDS = ("open", "high", "low", "close", "pre_close", "pct_chg", "vol", "amount", "turnover", "total_mv")
RAW = {"open": "raw_open", "high": "raw_high", "low": "raw_low", "close": "raw_close", "turnover": "turnover_rate_f"}
PRICES = ("open", "high", "low", "close")


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, trade_date): the open days in order, t from 0. A calendar has one row a day, so one task may number it."""
    days = table(spark, sf_dir, "trade_cal").where("is_open = 1").select(F.col("cal_date").alias("trade_date")).distinct()
    return days.select((F.row_number().over(W.orderBy("trade_date")) - 1).cast("int").alias("t"), "trade_date")


def bars(spark: SparkSession, sf_dir: str, fields: tuple[str, ...] = BAR_FIELDS) -> DataFrame:
    """(t, trade_date, code, fields): one bar a code and session, the latest delivery; not dense. Only the fields are read."""
    raw = table(spark, sf_dir, "daily")
    values = F.struct(*[finite(RAW.get(n, n)).alias(n) for n in BAR_FIELDS if n in fields])
    cal = F.broadcast(calendar(spark, sf_dir))
    return (
        raw.join(cal, "trade_date").groupBy("t", "trade_date", norm_code("ts_code").alias("code"))
        .agg(F.max_by(values, F.struct("loaded_at", "bar_id")).alias("b")).select("t", "trade_date", "code", "b.*")
    )


def densify(df: DataFrame, cal: DataFrame) -> DataFrame:
    """All dates for all codes of df; values are NULL where df has no row."""
    n = cal.agg(F.max("t").alias("n"))
    grid = df.select("code").distinct().join(F.broadcast(n), how="cross").select("code", F.explode(F.sequence(F.lit(0), "n")).alias("t"))  # one row on the right
    return grid.join(F.broadcast(cal), "t").join(df.drop("trade_date"), ["t", "code"], "left")


def adjustment(spark: SparkSession, sf_dir: str, hindsight: bool = False) -> DataFrame:
    """(code, at, record): the valid factor records and the day from whose close on they are in force and known."""
    a = table(spark, sf_dir, "adj_factor").where("adj_factor > 0 and not isnan(adj_factor) and as_of_time is not null")
    known = F.date_format(F.expr("as_of_time + interval '8:59:59.999999' hour to second"), "yyyyMMdd")  # after 15:00 it's the next day
    at = F.col("trade_date") if hindsight else F.greatest("trade_date", known)
    return a.select(norm_code("ts_code").alias("code"), at.alias("at"), F.struct("trade_date", "as_of_time", "adj_id", F.col("adj_factor").alias("adj")).alias("record"))


def bar_panel(spark: SparkSession, sf_dir: str, hindsight: bool = False, fields: tuple[str, ...] | None = None) -> DataFrame:
    """The dense panel with the adjustment factor (adj), adjusted prices (``_h``), NULL without a factor, and is_trading.

    ``fields`` names what is needed of these; no other column of the bars is read, and no factor where none is.

    A cell's factor is the one in force on its date as known at its close, so that later records change nothing earlier:
    what features may use. With ``hindsight`` it is the one known in the end, whose prices are comparable over the dates of
    a holding period: what outcomes need. Both thresholds rise along a code's dates, so that the right record is the
    greatest (date, time known, id) so far; no join and no second shuffle.
    """
    adjusted = [c for c in PRICES if fields is None or f"{c}_h" in fields]
    raw = BAR_FIELDS if fields is None else {*fields, *adjusted, *(("close", "vol") if "is_trading" in fields else ())}
    dense = densify(bars(spark, sf_dir, tuple(c for c in BAR_FIELDS if c in raw)), calendar(spark, sf_dir))
    if fields is None or "is_trading" in fields:
        dense = dense.withColumn("is_trading", F.col("close").isNotNull() & (F.coalesce("vol", F.lit(0.0)) > 0))
    if fields is not None and not adjusted and "adj" not in fields:
        return dense
    records = adjustment(spark, sf_dir, hindsight)
    w = W.partitionBy("code").orderBy("at", "is_bar").rowsBetween(W.unboundedPreceding, 0)
    both = dense.withColumns({"at": F.col("trade_date"), "record": F.lit(None).cast(records.schema["record"].dataType), "is_bar": F.lit(1)}).unionByName(records.withColumn("is_bar", F.lit(0)), allowMissingColumns=True)
    filled = both.withColumn("adj", F.max("record").over(w)["adj"]).where("is_bar = 1").drop("is_bar", "at", "record")
    return filled.withColumns({f"{c}_h": F.col(c) * F.col("adj") for c in adjusted})


EVENT_FIELDS = ("score", "feat_a", "feat_b", "feat_c", "feat_d", "feat_e", "feat_f")


def event_table(spark: SparkSession, sf_dir: str, *fields: str) -> DataFrame:
    """(t, trade_date, code, event_id, strategy_name, fields, y, ret): the last row of each code and session (latest
    load, then largest id); y is 0, 1 or NULL, ret the outcome's return. Of the columns after code only ``fields`` are read,
    if any are named."""
    raw = table(spark, sf_dir, "event_rows").withColumns({"trade_date": plain_date("trade_date"), "code": norm_code("stock_code")}).where("code is not null")
    hit = F.when(F.col("label_hit").isin(0.0, 1.0), F.col("label_hit") + 0.0)
    each = {"event_id": F.col("event_id"), "strategy_name": F.col("strategy_name"), **{c: finite(c) for c in EVENT_FIELDS}, "y": hit, "ret": finite("label_d2_return")}
    values = F.struct(*[x.alias(c) for c, x in each.items() if not fields or c in fields])
    cal = F.broadcast(calendar(spark, sf_dir))
    return (
        raw.join(cal, "trade_date").groupBy("t", "trade_date", "code")
        .agg(F.max_by(values, F.struct("loaded_at", "event_id")).alias("e")).select("t", "trade_date", "code", "e.*")
    )


_PANEL_SQL = """
with cal as (select cast(row_number() over (order by trade_date) - 1 as int) as t, trade_date from (select distinct cal_date as trade_date from trade_cal where is_open = 1)),
bars as (select t, trade_date, code, unnest(v) from (select t, d.trade_date, upper(trim(ts_code)) as code, arg_max({'open': raw_open, 'high': raw_high, 'low': raw_low, 'close': raw_close, 'pre_close': d.pre_close,
  'pct_chg': d.pct_chg, 'vol': d.vol, 'amount': d.amount, 'turnover': turnover_rate_f, 'total_mv': d.total_mv}, (loaded_at, bar_id)) as v from daily d join cal using (trade_date) group by 1, 2, 3)),
grid as (select code, t, trade_date from (select distinct code from bars) cross join cal),
adjs as (select g.code, g.t, arg_max(a.adj_factor, (a.trade_date, a.as_of_time, a.adj_id)) as adj from grid g join adj_factor a on g.code = upper(trim(a.ts_code)) and a.trade_date <= g.trade_date and a.as_of_time KNOWN where a.adj_factor > 0 and not isnan(a.adj_factor) group by 1, 2),
dense as (select g.code, g.t, g.trade_date, b.* exclude (t, trade_date, code) from grid g left join bars b using (t, code)),
panel as (select d.*, a.adj, open * a.adj as open_h, high * a.adj as high_h, low * a.adj as low_h, close * a.adj as close_h, close is not null and coalesce(vol, 0) > 0 as is_trading
  from dense d left join adjs a using (code, t))
"""
PANEL_SQL = _PANEL_SQL.replace("KNOWN", "<= strptime(g.trade_date, '%Y%m%d') + interval 15 hour")
FINAL_SQL = _PANEL_SQL.replace("KNOWN", "is not null")  # with hindsight
EVENT_SQL = """
with cal as (select cast(row_number() over (order by trade_date) - 1 as int) as t, trade_date from (select distinct cal_date as trade_date from trade_cal where is_open = 1)),
e as (select t, trade_date, code, unnest(v) from (select t, trade_date, code, arg_max({'event_id': event_id, 'strategy_name': strategy_name, %s,
  'y': case when label_hit in (0, 1) then label_hit + 0.0 end, 'ret': case when isfinite(label_d2_return) then label_d2_return end}, (loaded_at, event_id)) as v
  from (select * replace (replace(trade_date, '-', '') as trade_date), upper(trim(stock_code)) as code from event_rows where stock_code is not null) join cal using (trade_date) group by 1, 2, 3))
""" % ", ".join(f"'{c}': case when isfinite({c}) then {c} end" for c in EVENT_FIELDS)
