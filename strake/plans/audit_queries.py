"""Queries of point-in-time joins, labels, splits, residuals, permutation nulls and other audits, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..common import finite, norm_code, plain_date, shared_folder, table
from ..functions import ops as o
from ..operators import audits as a
from ..operators import labels as lb
from ..operators import metrics as m
from ..operators import portfolio as p
from ..operators import relational as r
from ..operators.search import mine, search
from ..sources.lineage import Audit, violations
from ..sources.panel import EVENT_FIELDS, EVENT_SQL, FINAL_SQL, PANEL_SQL, bar_panel, bars, calendar, event_table
from ..sources.store import Store, TableSpec
from .panel_queries import _BT, FRAMES, _book, ic_sql, pdiv, r6, ranked_sql, rounded

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# point-in-time joins

_NAMES = "n as (select name_id, upper(trim(ts_code)) as code, stock_name, start_date, end_date from namechange)"


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "namechange").withColumn("code", norm_code("ts_code"))


@query(EVENT_SQL + f", {_NAMES} select trade_date, code, exists (select 1 from n where n.code = e.code and stock_name like 'ST %' and e.trade_date >= start_date and (end_date is null or e.trade_date <= end_date)) as flagged from e")
def interval_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether any marked name of the code was in effect on the date."""
    e = event_table(spark, sf_dir, "event_id").select("trade_date", "code")
    return r.interval_any(e, _names(spark, sf_dir), key="code", at="trade_date", start="start_date", end="end_date", flag=F.col("stock_name").startswith("ST "), name="flagged")


@query(EVENT_SQL + f", {_NAMES} select e.trade_date, e.code, count(n.code) as n_active, case when count(n.code) = 1 then min(n.stock_name) end as stock_name from e left join n on n.code = e.code and e.trade_date >= start_date and (end_date is null or e.trade_date <= end_date) group by 1, 2")
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one name in effect, and how many are."""
    e = event_table(spark, sf_dir, "event_id").select("trade_date", "code")
    return r.interval_one(e, _names(spark, sf_dir), key="code", at="trade_date", start="start_date", end="end_date", value="stock_name")


@query(EVENT_SQL + """, z as (select upper(trim(ts_code)) as code, max((loaded_at, coalesce(list_date, ''), coalesce(delist_date, '99999999'))) as m from stock_basic group by 1), s as (select code, nullif(m[2], '') as l, m[3] as d from z),
x as (select s.code, min(cal.t) as t0, min(d) as d from s join cal on cal.trade_date >= s.l group by s.code)
select e.trade_date, e.code, coalesce(e.t >= x.t0 + 20 and e.trade_date < x.d, false) as listed from e left join x using (code)""")
def listing_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the code had been listed for twenty sessions and not delisted."""
    last = F.max(F.struct("loaded_at", F.coalesce("list_date", F.lit("")).alias("l"), F.coalesce("delist_date", F.lit("99999999")).alias("d")))
    s = table(spark, sf_dir, "stock_basic").groupBy(norm_code("ts_code").alias("code")).agg(last.alias("m")).select("code", F.nullif("m.l", F.lit("")).alias("start"), F.col("m.d").alias("end"))
    e = event_table(spark, sf_dir, "event_id").select("t", "trade_date", "code")
    return r.in_listing(e, s, calendar(spark, sf_dir), start="start", end="end", days=20).drop("t")


@query(PANEL_SQL + "select b.trade_date, b.code, " + r6("b.close", "close") + ", " + r6("x.close", "close_at") + " from bars b left join bars x on x.code = b.code and x.t = b.t + 3")
def calendar_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The close three sessions later."""
    b = bars(spark, sf_dir, ("close",))
    return rounded(r.at_offset(b.select("t", "trade_date", "code", "close"), b, F.lit(3), ["close"]).drop("t"), ["trade_date", "code"])


@query(EVENT_SQL + ", d as (select t, count(*) as n_hits from e where y = 1 and strategy_name = 'turn_spike' group by t) select t, coalesce(n_hits, 0) as n_hits from cal left join d using (t)")
def calendar_zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A daily count on every session, 0 where there is none."""
    d = event_table(spark, sf_dir, "y", "strategy_name").where("y = 1 and strategy_name = 'turn_spike'").groupBy("t").agg(F.count(F.lit(1)).alias("n_hits"))
    return r.zero_filled(d, calendar(spark, sf_dir).select("t"), ["n_hits"])


# deduplication and shapes


@query("select bar_id, upper(trim(ts_code)) as code, trade_date, raw_close from daily qualify row_number() over (partition by upper(trim(ts_code)), trade_date order by loaded_at desc, bar_id desc) = 1")
def dedup_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last delivery of every code and date."""
    d = table(spark, sf_dir, "daily").select("bar_id", norm_code("ts_code").alias("code"), "trade_date", "raw_close", "loaded_at")
    return r.keep_last(d, ["code", "trade_date"], ["loaded_at", "bar_id"]).drop("loaded_at")


@query("select upper(trim(ts_code)) as code, trade_date, count(distinct (raw_close, vol)) as versions from daily group by 1, 2 having count(distinct (raw_close, vol)) > 1")
def dedup_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and dates whose deliveries differ in close or volume."""
    return r.conflicts(table(spark, sf_dir, "daily").select(norm_code("ts_code").alias("code"), "trade_date", "raw_close", "vol"), ["code", "trade_date"])


@query("with i as (select * replace (raw_close + 1 as raw_close) from daily where trade_date >= '20221201' and trade_date < '20230201') select * from daily where trade_date is null or trade_date not in (select trade_date from i) union all select * from i")
def upsert_all_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole daily table after a delivery of two months has replaced their rows."""
    d = table(spark, sf_dir, "daily")
    new = d.where("trade_date >= '20221201' and trade_date < '20230201'").withColumn("raw_close", F.col("raw_close") + 1)
    return r.upsert(d, new, "trade_date")


@query("with i as (select * replace (raw_close + 1 as raw_close) from daily where trade_date >= '20221201' and trade_date < '20230201'), u as (select * from daily where trade_date not in (select trade_date from i) union all select * from i) select trade_date, count(*) as n, count(*) filter (where isfinite(vol)) as n_vol, " + r6("sum(raw_close) filter (where isfinite(raw_close))", "total", 3) + " from u where trade_date is not null group by 1")
def store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily table in a store of its own, a delivery of two months written into it twice, read back by date."""
    store = Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    spec = TableSpec("daily", ("bar_id", "ts_code", "trade_date", "raw_close", "vol"), frozenset({"raw_close", "vol"}), "trade_date")
    d = table(spark, sf_dir, "daily").select(*spec.columns)
    new = d.where("trade_date >= '20221201' and trade_date < '20230201'").withColumn("raw_close", F.col("raw_close") + 1)
    for delivery in (d, new, new):
        store.append_dated(spec, delivery)
    x = store.read_dated(spec, "00000000", "99999999").groupBy("trade_date").agg(F.count(F.lit(1)).alias("n"), F.count("vol").alias("n_vol"), F.sum("raw_close").alias("total"))
    return rounded(x, ["trade_date", "n", "n_vol"], 3)


@query(EVENT_SQL + "select t, code, row_number() over (partition by t order by code) - 1 as slot from e")
def event_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every row in its date."""
    return r.slots(event_table(spark, sf_dir, "event_id")).select("t", "code", F.col("slot").cast("bigint").alias("slot"))


@query(EVENT_SQL + "select field, count(*) as cells, count(v) as filled, " + r6("avg(v)", "mean") + " from (" + " union all ".join(f"select '{c}' as field, {c} as v from e" for c in EVENT_FIELDS) + ") group by 1")
def event_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide to long: a row a cell and field, summarized."""
    long = event_table(spark, sf_dir).unpivot(["t", "code"], list(EVENT_FIELDS), "field", "v")
    return rounded(long.groupBy("field").agg(F.count(F.lit(1)).alias("cells"), F.count("v").alias("filled"), F.avg("v").alias("mean")), ["field", "cells", "filled"])


_LEVELS = ("base_break", "calm_drift", "gap_follow", "late_surge", "limit_echo", "thin_float", "turn_spike", "wide_range")


@query(EVENT_SQL + "select t, " + ", ".join(f"cast(sum(case when strategy_name = '{v}' then 1 else 0 end) as bigint) as {v}" for v in _LEVELS) + " from e group by t")
def onehot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 0/1 column a strategy, summed by date."""
    h = r.one_hot(event_table(spark, sf_dir, "strategy_name").select("t", "strategy_name"), "strategy_name")
    return h.groupBy("t").agg(*[F.sum(f"strategy_name={v}").cast("bigint").alias(v) for v in _LEVELS])


@query(PANEL_SQL + """, h as (select trade_date, sha256(concat_ws('|', code, trade_date, cast(cast(vol as bigint) as varchar))) as h from bars where vol is not null)
select trade_date, count(*) as rows, sha256(concat_ws(',', """ + ", ".join(f"cast(sum(('0x' || substr(h, {1 + 8 * i}, 8))::bigint) as varchar)" for i in range(8)) + ")) as digest from h group by 1")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of every date's bars, whatever the order of the rows."""
    b = bars(spark, sf_dir, ("vol",)).where("vol is not null").select("code", "trade_date", F.col("vol").cast("bigint").alias("vol"))
    return r.fingerprint(b, ["trade_date"])


@query(PANEL_SQL + "select code, " + r6("median(amount)", "amount", 4) + " from bars group by code order by median(amount) desc nulls last, code limit 10")
def liquid_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten codes of the largest median amount."""
    return rounded(r.top_liquid(bars(spark, sf_dir, ("amount",)), "amount", 10), ["code"], 4)


@query("""with a as (select distinct upper(trim(stock_code)) as code from event_rows), b as (select distinct upper(trim(ts_code)) as code from daily)
select 'both' as side, count(*) as n from (select * from a intersect select * from b) union all select 'events', count(*) from (select * from a except select * from b) union all select 'bars', count(*) from (select * from b except select * from a) union all select 'all', count(*) from (select * from a union select * from b)""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes in both tables, in one only, in either."""
    x = table(spark, sf_dir, "event_rows").select(norm_code("stock_code").alias("code")).where("code is not null").distinct()
    y = table(spark, sf_dir, "daily").select(norm_code("ts_code").alias("code")).where("code is not null").distinct()
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("side"), "n")
    return one(x.intersect(y), "both").unionByName(one(x.exceptAll(y), "events")).unionByName(one(y.exceptAll(x), "bars")).unionByName(one(x.unionByName(y).distinct(), "all"))


@query("""select length(trade_date) as n_chars, strftime(try_strptime(replace(trade_date, '-', ''), '%Y%m%d'), '%Y-%m') as month, split_part(upper(trim(stock_code)), '.', 2) as exch, count(*) as n,
cast(sum(case when regexp_full_match(upper(trim(stock_code)), '[0-9]{6}[.]X[A-C]') then 1 else 0 end) as bigint) as well_formed from event_rows group by 1, 2, 3""")
def text_and_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of two formats and codes of odd spelling, parsed; an impossible date has no month."""
    code = norm_code("stock_code")
    month = F.date_format(F.try_to_date(plain_date("trade_date"), "yyyyMMdd"), "yyyy-MM")
    x = table(spark, sf_dir, "event_rows").select(F.length("trade_date").cast("bigint").alias("n_chars"), month.alias("month"), F.split_part(code, F.lit("."), F.lit(2)).alias("exch"), code.rlike(r"\A[0-9]{6}[.]X[A-C]\z").alias("ok"))
    return x.groupBy("n_chars", "month", "exch").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("well_formed"))


@query("""with cal as (select distinct cal_date as d from trade_cal where is_open = 1), x as (select replace(trade_date, '-', '') as d, feature_source_date as s, feature_adj_factor_version as v from event_rows)
select coalesce(violation, 'none') as violation, count(*) as n from (select case when d is null or d not in (select d from cal) then 'date' when s is null or not regexp_full_match(s, '[0-9]{8}|[0-9]{4}-[0-9]{2}-[0-9]{2}') then 'source' when replace(s, '-', '') <> d then 'calendar' when not coalesce(regexp_full_match(v, 'raw-times-same-day-adj-v1:[0-9a-f]{64}'), false) then 'version' end as violation from x) group by 1""")
def lineage_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by the first lineage rule they break."""
    v = violations(table(spark, sf_dir, "event_rows"), Audit("feature_source_date", "feature_adj_factor_version"), calendar(spark, sf_dir))
    return v.groupBy(F.coalesce("violation", F.lit("none")).alias("violation")).agg(F.count(F.lit(1)).alias("n"))


# labels and splits

_TOUCH = FINAL_SQL + f""", l as (select *, lead(open_h) over wt as entry, lead(high_h, 2) over wt as high2, lead(close_h, 2) over wt as exit, coalesce(lead(is_trading) over wt, false) and coalesce(lead(is_trading, 2) over wt, false) and coalesce(lead(open_h) over wt > 0, false) and lead(high_h, 2) over wt is not null as valid from panel {FRAMES})"""


@query(_TOUCH + "select trade_date, code, valid, " + r6("entry", "entry_price") + ", " + r6("exit", "exit_price") + ", cast(case when valid then case when high2 >= entry * 1.03 then 1 else 0 end end as double) as y from l")
def touch_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the high two sessions on reaches the next open plus three per cent; NULL where unobservable."""
    return rounded(lb.touch_label(bar_panel(spark, sf_dir, hindsight=True, fields=("open_h", "high_h", "close_h", "is_trading")), 1.03).select("trade_date", "code", "valid", "entry_price", "exit_price", "y"), ["trade_date", "code", "valid"])


@query(_TOUCH + "select substr(trade_date, 1, 6) as month, count(*) as cells, count(*) filter (where valid) as n_valid, round(avg(case when valid then case when high2 >= entry * 1.03 then 1.0 else 0.0 end end), 6) + 0.0 as base_rate from l group by 1")
def base_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of touches among the observable cells, by month."""
    x = lb.touch_label(bar_panel(spark, sf_dir, hindsight=True, fields=("open_h", "high_h", "close_h", "is_trading")), 1.03).groupBy(F.substring("trade_date", 1, 6).alias("month"))
    return rounded(x.agg(F.count(F.lit(1)).alias("cells"), F.count_if("valid").alias("n_valid"), F.avg("y").alias("base_rate")), ["month", "cells", "n_valid"])


def _folds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list]:
    cal = calendar(spark, sf_dir)
    return cal, lb.walk_forward(cal.count(), 120, 40, 40, 2)


_FOLDS_SQL = """, n as (select count(*) as n from cal), f as (select row_number() over (order by lo) - 1 as fold, lo from (select unnest(generate_series(0, (select n from n) - 244, 40)) as lo)),
roles as (select fold, 'train' as role, lo as t_lo, lo + 120 as t_hi from f union all select fold, 'valid', lo + 122, lo + 162 from f union all select fold, 'test', lo + 164, lo + 204 from f)""".replace("- 244", "- 204")


@query(EVENT_SQL + _FOLDS_SQL + "select cast(fold as int) as fold, role, count(*) as n_rows, count(distinct t) as n_dates, round(avg(y), 6) + 0.0 as base_rate from e join roles on t >= t_lo and t < t_hi group by 1, 2")
def walk_forward_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each fold and role of a walk-forward split with gaps."""
    _, folds = _folds(spark, sf_dir)
    x = lb.in_folds(event_table(spark, sf_dir, "y"), folds).groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("t").alias("n_dates"), F.avg("y").alias("base_rate"))
    return rounded(x, ["fold", "role", "n_rows", "n_dates"])


@query(EVENT_SQL + """, b as (select 0 as lo, max(t) + 1 - 2 as hi from cal), s as (select lo, lo + cast(floor(0.8 * (hi - lo)) as int) as cut, hi from b)
select part, count(*) as n_rows, min(t) as first_t, max(t) as last_t from (select case when t < cut then 'fit' when t >= cut + 2 and t < hi then 'selection' end as part, t from e, s) where part is not null group by 1""")
def fit_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dates to fit on and to select on, without those whose outcome isn't complete."""
    lo, hi = lb.outcome_complete(0, calendar(spark, sf_dir).count(), 2)
    fit, sel = lb.fit_selection(lo, hi)
    part = F.when((F.col("t") >= fit[0]) & (F.col("t") < fit[1]), "fit").when((F.col("t") >= sel[0]) & (F.col("t") < sel[1]), "selection")
    x = event_table(spark, sf_dir, "event_id").withColumn("part", part).where("part is not null")
    return x.groupBy("part").agg(F.count(F.lit(1)).alias("n_rows"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


@query(EVENT_SQL + "select round(least((count(y) - sum(y)) / sum(y), 20.0), 6) + 0.0 as weight from e")
def positive_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives per positive."""
    return rounded(lb.positive_weight(event_table(spark, sf_dir, "y")), [])


@query(PANEL_SQL + """, s as (select t, trade_date, code, list(cast(coalesce(turnover, 0) as float)) over w5 as q, count(*) over w5 as n, list(cast(case when is_trading then 1 else 0 end as float)) over w5 as tr from panel """ + FRAMES + ") select trade_date, code, round(cast(q[1] as double), 4) + 0.0 as first_turnover, round(cast(q[5] as double), 4) + 0.0 as last_turnover, cast(list_sum(tr) as int) as traded from s where n = 5")
def sequence_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five dates' values before and on every cell, as arrays; here their ends and traded days."""
    s = lb.sequences(bar_panel(spark, sf_dir, fields=("turnover", "is_trading")), ["turnover"], 5).join(F.broadcast(calendar(spark, sf_dir)), "t")
    traded = F.aggregate("steps", F.lit(0.0).cast("float"), lambda z, x: (z + x["traded"]).cast("float")).cast("int")
    return s.select("trade_date", "code", (F.round(F.col("steps")[0]["turnover"].cast("double"), 4) + 0.0).alias("first_turnover"), (F.round(F.col("steps")[4]["turnover"].cast("double"), 4) + 0.0).alias("last_turnover"), traded.alias("traded"))


# trailing styles, regimes, adjustment


def _ln(c: str) -> str:
    return f"ln(1 + {c} / 100)"


@query(PANEL_SQL + f"select trade_date, code, round(case when count(pct_chg) over w20 = 20 then exp(sum({_ln('pct_chg')}) over w20) - 1 end, 6) + 0.0 as momentum_20d, round(case when count(pct_chg) over w20 = 20 then stddev_samp(pct_chg / 100) over w20 end, 6) + 0.0 as volatility_20d, round(case when count(turnover) over w20 = 20 then avg(turnover) over w20 end, 6) + 0.0 as turnover_mean_20d, round(case when total_mv > 0 then ln(total_mv) end, 6) + 0.0 as log_total_mv from panel {FRAMES}")
def trailing_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Momentum, volatility, mean turnover of twenty sessions, size."""
    return rounded(_styles(bar_panel(spark, sf_dir, fields=("pct_chg", "turnover", "total_mv"))).select("trade_date", "code", "momentum_20d", "volatility_20d", "turnover_mean_20d", "log_total_mv"), ["trade_date", "code"])


def _styles(x: DataFrame) -> DataFrame:
    ret = F.col("pct_chg") / 100
    return x.withColumns({"momentum_20d": F.expm1(o.ts_sum(F.log1p(ret), 20)), "volatility_20d": o.ts_std(ret, 20), "turnover_mean_20d": o.ts_mean(F.col("turnover"), 20), "log_total_mv": F.when(F.col("total_mv") > 0, F.ln("total_mv"))})


_REGIME = PANEL_SQL + ", d as (select t, avg(pct_chg) / 100 as mkt from bars group by t), g as (select t, mkt, case when count(mkt) over (order by t rows 19 preceding) = 20 then avg(mkt) over (order by t rows 19 preceding) end as m20 from d), rg as (select t, case when m20 > 0.001 then 'bull' when m20 < -0.001 then 'bear' when m20 is null then 'unavailable' else 'neutral' end as regime from g)"


def _regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = bars(spark, sf_dir, ("pct_chg",)).groupBy("t").agg((F.avg("pct_chg") / 100).alias("mkt"))
    w = W.orderBy("t").rowsBetween(-19, 0)  # one row a date
    m20 = F.when(F.count("mkt").over(w) == 20, F.avg("mkt").over(w))
    return d.select("t", F.when(m20 > 0.001, "bull").when(m20 < -0.001, "bear").when(m20.isNull(), "unavailable").otherwise("neutral").alias("regime"))


@query(_REGIME + "select regime, count(*) as n_dates from rg group by 1")
def market_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates by the market's mean return over twenty sessions."""
    return _regimes(spark, sf_dir).groupBy("regime").agg(F.count(F.lit(1)).alias("n_dates"))


@query(_BT + ", b as (select t, avg(p) / 100 as mkt from (select t, arg_max(d.pct_chg, (loaded_at, bar_id)) as p from daily d join cal using (trade_date) group by t, upper(trim(ts_code))) group by t), g as (select t, case when count(mkt) over (order by t rows 19 preceding) = 20 then avg(mkt) over (order by t rows 19 preceding) end as m20 from b), rg as (select t, case when m20 > 0.001 then 'bull' when m20 < -0.001 then 'bear' when m20 is null then 'unavailable' else 'neutral' end as regime from g) select regime, count(*) as n_dates, round(avg(portfolio_return), 8) + 0.0 as mean_return, round(avg(hit_rate), 6) + 0.0 as hit_rate from d join rg using (t) group by 1")
def regime_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The book's returns by market regime."""
    x = _book(spark, sf_dir).join(F.broadcast(_regimes(spark, sf_dir)), "t").groupBy("regime")  # one row a date
    return x.agg(F.count(F.lit(1)).alias("n_dates"), F.avg("portfolio_return").alias("mean_return"), F.avg("hit_rate").alias("hit_rate")).select("regime", "n_dates", (F.round("mean_return", 8) + 0.0).alias("mean_return"), (F.round("hit_rate", 6) + 0.0).alias("hit_rate"))


@query(PANEL_SQL + "select trade_date, code, " + r6("100 * exp(sum(coalesce(ln(1 + pct_chg / 100), 0)) over (partition by code order by t))", "close_index", 8) + ", " + r6("100 * exp(sum(coalesce(ln(1 + pct_chg / 100), 0)) over (partition by code order by t)) * case when abs(close) >= 1e-9 then open / close end", "open_index", 8) + " from panel")
def cumulative_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A price index from daily changes, missing ones as none; the open scaled by open over close."""
    run = o.along().rowsBetween(W.unboundedPreceding, 0)
    c = 100 * F.exp(F.sum(F.coalesce(F.log1p(F.col("pct_chg") / 100), F.lit(0.0))).over(run))
    return rounded(bar_panel(spark, sf_dir, fields=("pct_chg", "open", "close")).select("trade_date", "code", c.alias("close_index"), (c * o.div(F.col("open"), F.col("close"))).alias("open_index")), ["trade_date", "code"], 8)


@query(EVENT_SQL + "select t, code, " + r6("score - lag(score) over (partition by code order by t)", "jump") + " from e")
def event_jump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change of the score since the code's event row before, however long ago."""
    e = event_table(spark, sf_dir, "score")
    return rounded(e.select("t", "code", (F.col("score") - F.lag("score").over(o.along())).alias("jump")), ["t", "code"])


_EXR = FINAL_SQL + ", x as (select *, case when adj is not null and lag(adj) over (partition by code order by t) is not null then abs(adj - lag(adj) over (partition by code order by t)) > 1e-12 end as ex_right from panel), h as (select *, bool_or(ex_right) over (partition by code order by t rows between 1 following and 2 following) as in_window, lead(close, 2) over (partition by code order by t) / lead(open) over (partition by code order by t) - 1 as raw, lead(close_h, 2) over (partition by code order by t) / lead(open_h) over (partition by code order by t) - 1 as hfq from x)"


def _ex_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    prev = o.delay(F.col("adj"), 1)
    x = bar_panel(spark, sf_dir, hindsight=True, fields=("open", "close", "open_h", "close_h", "adj")).withColumn("ex_right", F.when(F.col("adj").isNotNull() & prev.isNotNull(), F.abs(F.col("adj") - prev) > 1e-12))
    ret = lambda c, e: o.div(o.lead(F.col(c), 2), o.lead(F.col(e), 1)) - 1
    return x.withColumns({"in_window": F.bool_or("ex_right").over(o.along().rowsBetween(1, 2)), "raw": ret("close", "open"), "hfq": ret("close_h", "open_h")})


@query(_EXR + "select coalesce(cast(in_window as varchar), 'unknown') as in_window, count(*) as cells, count(raw) as n_raw, count(hfq) as n_hfq, round(avg(raw), 6) + 0.0 as mean_raw, round(avg(hfq), 6) + 0.0 as mean_hfq, round(quantile_cont(abs(raw - hfq), 0.95), 6) + 0.0 as p95_error, count(*) filter (where (raw >= 0.03) <> (hfq >= 0.03)) as n_flips from h group by 1")
def exright_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw against adjusted returns with and without a factor change in the holding window."""
    x = _ex_right(spark, sf_dir).groupBy(F.coalesce(F.col("in_window").cast("string"), F.lit("unknown")).alias("in_window"))
    x = x.agg(F.count(F.lit(1)).alias("cells"), F.count("raw").alias("n_raw"), F.count("hfq").alias("n_hfq"), F.avg("raw").alias("mean_raw"), F.avg("hfq").alias("mean_hfq"), F.percentile(F.abs(F.col("raw") - F.col("hfq")), 0.95).alias("p95_error"), F.count_if((F.col("raw") >= 0.03) != (F.col("hfq") >= 0.03)).alias("n_flips"))
    return rounded(x, ["in_window", "cells", "n_raw", "n_hfq", "n_flips"])


# deferred exits

_DOWN = "round_even(pre_close * 90, 0) / 100"
_EXIT_SQL = FINAL_SQL + f""", f as (select *, {_DOWN} as dl, is_trading and pre_close is not null as live from panel),
g as (select *, live and coalesce(abs(high - dl) <= 0.005, false) and coalesce(abs(close - dl) <= 0.005, false) as sealed from f),
s as (select *, case when live and not sealed and high is not null and close is not null and close_h is not null then {{'t': t, 'price': close_h, 'kind': 'touch_close'}} end as at_touch,
  case when live and coalesce(open > dl + 0.005, false) and open_h is not null then {{'t': t, 'price': open_h, 'kind': 'open'}} when live and coalesce(close > dl + 0.005, false) and close_h is not null then {{'t': t, 'price': close_h, 'kind': 'close'}} end as later,
  sum(case when is_trading then 0 else 1 end) over wt as halts, sum(case when is_trading and not live then 1 else 0 end) over wt as blinds, max(t) over (partition by code) as last from g window wt as (partition by code order by t)),
x as (select t, trade_date, code, last, coalesce(lead(at_touch, 2) over wt, first_value(later ignore nulls) over (partition by code order by t rows between 3 following and unbounded following)) as ex, coalesce(lead(sealed, 2) over wt, false) as touch_sealed, lead(halts) over wt as h1, lead(blinds) over wt as b1 from s window wt as (partition by code order by t))
"""


@query(_EXIT_SQL + "select x.trade_date, x.code, ex.t as exit_t, round(ex.price, 6) + 0.0 as exit_price, ex.kind as exit_kind, touch_sealed, coalesce(z.halts > h1, false) as met_suspension, coalesce(z.blinds > b1, false) as met_missing_limit from x left join s z on z.code = x.code and z.t = case when x.t + 2 <= x.last then coalesce(ex.t, x.last) end")
def realistic_exit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sale of a position bought next session: two sessions on, or later if sealed at the limit or halted."""
    x = bar_panel(spark, sf_dir, hindsight=True, fields=("pre_close", "open", "high", "close", "open_h", "close_h", "is_trading")).withColumns({"down_limit": F.rint(F.col("pre_close") * 90) / 100, "limit_observed": F.col("pre_close").isNotNull()})
    return rounded(p.deferred_exit(x).select("trade_date", "code", "exit_t", "exit_price", "exit_kind", "touch_sealed", "met_suspension", "met_missing_limit"), ["trade_date", "code", "exit_t", "exit_kind", "touch_sealed", "met_suspension", "met_missing_limit"])


# series of the book


@query(_BT + "select substr(trade_date, 1, 6) as month, count(*) as n_dates, round(exp(sum(ln(1 + portfolio_return))) - 1, 8) + 0.0 as compounded, round(avg(hit_rate), 6) + 0.0 as hit_rate, round(case when count(hit_rate) >= 3 and stddev_pop(hit_rate) > 1e-6 and stddev_pop(portfolio_return) > 1e-6 then corr(hit_rate, portfolio_return) end, 5) + 0.0 as within_corr from d join cal using (t) group by 1")
def monthly_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The book by month: compounded return, hits, correlation within the month."""
    b = _book(spark, sf_dir).join(F.broadcast(calendar(spark, sf_dir)), "t").groupBy(F.substring("trade_date", 1, 6).alias("month"))
    x = b.agg(F.count(F.lit(1)).alias("n_dates"), (F.product(1 + F.col("portfolio_return")) - 1).alias("compounded"), F.avg("hit_rate").alias("hit_rate"), m.pearson(F.col("hit_rate"), F.col("portfolio_return"), 3).alias("within_corr"))
    return x.select("month", "n_dates", (F.round("compounded", 8) + 0.0).alias("compounded"), (F.round("hit_rate", 6) + 0.0).alias("hit_rate"), (F.round("within_corr", 5) + 0.0).alias("within_corr"))


@query(_BT + "select " + ", ".join(f"round(quantile_cont(portfolio_return, {q}), 8) + 0.0 as p{n}" for q, n in ((0.05, "05"), (0.25, "25"), (0.5, "50"), (0.75, "75"), (0.95, "95"))) + ", round(min(portfolio_return), 8) + 0.0 as least, round(max(portfolio_return), 8) + 0.0 as most, round(avg(portfolio_return), 8) + 0.0 as mean from d")
def describe_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantiles of the book's daily returns."""
    v = F.col("portfolio_return")
    return rounded(_book(spark, sf_dir).agg(*[F.percentile(v, q).alias(f"p{n}") for q, n in ((0.05, "05"), (0.25, "25"), (0.5, "50"), (0.75, "75"), (0.95, "95"))], F.min(v).alias("least"), F.max(v).alias("most"), F.avg(v).alias("mean")), [], 8)


def _h_sql(key: str, perm: str, t: str) -> str:
    h = f"(({key} * 48271 + {perm} * 69621 + {t} * 16807) % 2147483647)"
    for _ in range(2):
        h = f"(({h} * {h} + 11) % 2147483647)"
    return h


@query(_BT + """, s as (select portfolio_return as v, row_number() over (order by t) - 1 as i from d), n as (select count(*) as n from s), b as (select rep, b, """ + _h_sql("b", "rep", "7") + """ % (select n from n) as st from (select unnest(range(50)) as rep) cross join (select unnest(range((select cast(ceil(n / 10.0) as bigint) from n))) as b)),
x as (select rep, b * 10 + k as pos, (st + k) % (select n from n) as i from b cross join (select unnest(range(10)) as k)) select cast(rep as int) as rep, round(avg(v), 8) + 0.0 as mean from x join s using (i) where pos < (select n from n) group by 1""")
def bootstrap_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the book under a circular block bootstrap of its dates."""
    return rounded(a.bootstrap_means(_book(spark, sf_dir), "portfolio_return", 10, 50), ["rep"], 8)


@query("select round(avg(mean), 8) + 0.0 as mean, round(coalesce(stddev_samp(mean), 0), 8) + 0.0 as std, count(*) as n from (" + ORACLE["bootstrap_dates"].replace("round(avg(v), 8) + 0.0 as mean", "avg(v) as mean") + ")")
def seed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and spread over the bootstrap's repetitions."""
    x = a.bootstrap_means(_book(spark, sf_dir), "portfolio_return", 10, 50)
    return rounded(x.agg(F.avg("mean").alias("mean"), F.coalesce(F.stddev_samp("mean"), F.lit(0.0)).alias("std"), F.count("mean").alias("n")), ["n"], 8)


@query(EVENT_SQL + FINAL_SQL.replace("\nwith cal as (select cast(row_number() over (order by trade_date) - 1 as int) as t, trade_date from (select distinct cal_date as trade_date from trade_cal where is_open = 1)),", ",", 1) + """, f as (select e.t, e.code, h, score as x, z.close_h / case when abs(b.close_h) >= 1e-9 then b.close_h end - 1 as y from e left join panel b on b.code = e.code and b.t = e.t cross join (select unnest(generate_series(1, 10)) as h) left join panel z on z.code = e.code and z.t = e.t + h),
j as (select * from f where x is not null and y is not null), r as (select h, t, cast(row_number() over (partition by h, t order by x, code) as double) as a, cast(row_number() over (partition by h, t order by y, code) as double) as b from j),
s as (select h, t, count(*) as n, sum(a * b) - sum(a) * sum(b) / count(*) as c, sum(a * a) - sum(a) * sum(a) / count(*) as va, sum(b * b) - sum(b) * sum(b) / count(*) as vb from r group by h, t)
select cast(h as int) as h, round(avg(c / sqrt(va * vb)), 6) + 0.0 as ic_mean, count(*) as n_days from s where n >= 5 and va > 1e-12 and vb > 1e-12 group by h""")
def horizon_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean rank IC of the score against returns of one to ten sessions."""
    fwd = a.horizon_returns(event_table(spark, sf_dir, "score").select("t", "code", "score"), bar_panel(spark, sf_dir, hindsight=True, fields=("close_h",)))
    ic = m.daily_ic(fwd, "score", "fwd", by=("h",)).where("ic is not null")
    return rounded(ic.groupBy("h").agg(F.avg("ic").alias("ic_mean"), F.count("ic").alias("n_days")), ["h", "n_days"])


_K = 4


@query(ranked_sql() + ", f as (select *, case when feat_b is not null and rank is not null then row_number() over (partition by t, feat_b is not null and rank is not null order by rank) end as fill_rank from k) select 'as_is' as view, count(y) as n, round(avg(y), 6) + 0.0 as hit, round(avg(ret), 6) + 0.0 as ret from f where rank <= 4 union all select 'filled', count(y), round(avg(y), 6) + 0.0, round(avg(ret), 6) + 0.0 from f where rank <= 4 and feat_b is not null union all select 'deeper', count(y), round(avg(y), 6) + 0.0, round(avg(ret), 6) + 0.0 from f where fill_rank <= 4")
def fill_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The picks as they are, those that can be filled, and the queue walked deeper."""
    x = m.ranked(event_table(spark, sf_dir, "score", "y", "ret", "feat_b"), "score").withColumn("_ok", F.col("feat_b").isNotNull() & F.col("rank").isNotNull())
    x = x.withColumn("fill_rank", F.when(F.col("_ok"), F.row_number().over(W.partitionBy("t", "_ok").orderBy("rank"))))
    views = {"as_is": F.col("rank") <= _K, "filled": (F.col("rank") <= _K) & F.col("feat_b").isNotNull(), "deeper": F.col("fill_rank") <= _K}
    each = F.explode(F.array_compact(F.array(*[F.when(c, n) for n, c in views.items()])))
    g = x.select(each.alias("view"), "y", "ret").groupBy("view").agg(F.count("y").alias("n"), F.avg("y").alias("hit"), F.avg("ret").alias("ret"))
    return rounded(g, ["view", "n"])


@query(ranked_sql() + ", x as (select t, code, score, rank, row_number() over (partition by t order by score, code) as r, count(score) over (partition by t) as n from k where score is not null), q as (select t, greatest(1, (5 * (r - 1) + n - 2) // (n - 1)) as bin, code from x where n > 1), s as (select bin, t, list(code) as s from q group by 1, 2) select cast(bin as int) as bin, round(avg(1 - len(list_intersect(s, p)) / len(s)), 6) + 0.0 as turnover from (select *, lag(s) over (partition by bin order by t) as p from s) where p is not null group by 1")
def quintile_turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean share of new names in each quintile of the score."""
    x = event_table(spark, sf_dir, "score").withColumn("bin", o.quantile_bin(F.col("score"))).where("bin is not null")
    s = x.groupBy("bin", "t").agg(F.collect_set("code").alias("s")).withColumn("p", F.lag("s").over(W.partitionBy("bin").orderBy("t"))).where("p is not null")
    return rounded(s.groupBy("bin").agg(F.avg(1 - F.size(F.array_intersect("s", "p")) / F.size("s")).alias("turnover")), ["bin"])


# residuals


@query(EVENT_SQL + ", c as (select t, code, feat_a as y, feat_b as x from e where feat_a is not null and feat_b is not null), s as (select *, avg(x) over w as mx, avg(y) over w as my, regr_slope(y, x) over w as b, count(*) over w as n from c window w as (partition by t)), z as (select t, code, n, y, y - my - b * (x - mx) as res from s), v as (select *, sum(res * res) over (partition by t) > 1e-12 * sum(y * y) over (partition by t) as rest from z) select e.t, e.code, " + r6("case when n > 2 and rest then res end", "residual", 9) + " from e left join v using (t, code) where e.t in (select t from s where n > 2)")
def style_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each date's least-squares residual of a feature on another, dates of three complete rows or more."""
    e = event_table(spark, sf_dir, "feat_a", "feat_b")
    n = F.count_if(F.col("feat_a").isNotNull() & F.col("feat_b").isNotNull()).over(o.across())
    return rounded(a.residualize(e.withColumn("_n", n).where("_n > 2"), "feat_a", ["feat_b"]).select("t", "code", "residual"), ["t", "code"], 9)


@query(EVENT_SQL + ", k as (select t, code, case when score is not null then row_number() over (partition by t order by score nulls last, code) / count(score) over (partition by t) end as y, case when feat_a is not null then row_number() over (partition by t order by feat_a nulls last, code) / count(feat_a) over (partition by t) end as x from e), c as (select * from k where x is not null and y is not null), s as (select *, avg(x) over w as mx, avg(y) over w as my, regr_slope(y, x) over w as b, count(*) over w as n from c window w as (partition by t)), z as (select t, code, n, y, y - my - b * (x - mx) as res from s), v as (select *, sum(res * res) over (partition by t) > 1e-12 * sum(y * y) over (partition by t) as rest from z) select e.t, e.code, " + r6("case when n > 2 and rest then res end", "residual", 9) + " from e left join v using (t, code) where e.t in (select t from s where n > 5)")
def rank_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score's ranks cleaned of another feature's, dates of more than five complete rows."""
    e = event_table(spark, sf_dir, "score", "feat_a")
    n = F.count_if(F.col("score").isNotNull() & F.col("feat_a").isNotNull()).over(o.across())
    return rounded(a.rank_residual(e.withColumn("_n", n).where("_n > 5"), "score", ["feat_a"]).select("t", "code", "residual"), ["t", "code"], 9)


@query()
def style_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest remaining correlation of the style-neutral score with each style on any date: all but zero."""
    styles = ["momentum_20d", "volatility_20d", "turnover_mean_20d", "log_total_mv"]
    s = _styles(bar_panel(spark, sf_dir, fields=("pct_chg", "turnover", "total_mv"))).select("t", "code", *styles)
    x, names = a.style_design(event_table(spark, sf_dir, "score").select("t", "code", "score").join(s, ["t", "code"], "left"), styles)
    return a.exposure(a.residualize(x, "score", names), "residual", names).select("x", F.round("worst", 6).alias("worst"))


ORACLE["style_exposure"] = "select unnest(['z_momentum_20d', 'z_volatility_20d', 'z_turnover_mean_20d', 'z_log_total_mv']) as x, 0.0::double as worst"


# permutation null

_PERMS = 10
_PERM_SQL = EVENT_SQL + f", pr as (select unnest(range({_PERMS})) as perm), q as (select perm, t, code, score, feat_a, y, case when row_number() over (partition by perm, t order by {_h_sql('event_id', 'perm', 't')}, event_id) <= sum(y) over (partition by perm, t) then 1.0 else 0.0 end as yp from e cross join pr where y is not null)"


@query(_PERM_SQL + "select cast(perm as int) as perm, count(*) as n, cast(sum(yp) as bigint) as positives, round(avg(case when yp = y then 1.0 else 0.0 end), 6) + 0.0 as same from q group by 1")
def placebo_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels shuffled within dates: counts stay, positions don't."""
    x = a.permuted(event_table(spark, sf_dir, "event_id", "y"), "y", "event_id", _PERMS).groupBy("perm")
    x = x.agg(F.count(F.lit(1)).alias("n"), F.sum("y_perm").cast("bigint").alias("positives"), F.avg((F.col("y_perm") == F.col("y")).cast("double")).alias("same"))
    return rounded(x, ["perm", "n", "positives"])


def _null_sql() -> str:
    parts = []
    for f in ("score", "feat_a"):
        parts.append(f"select '{f}' as factor, perm, t, cast(row_number() over (partition by perm, t order by {f}, code) as double) as a, cast(row_number() over (partition by perm, t order by yp, code) as double) as b, yp from q where {f} is not null")
    return _PERM_SQL + ", r as (" + " union all ".join(parts) + """), s as (select factor, perm, t, count(*) as n, sum(a * b) - sum(a) * sum(b) / count(*) as c, sum(a * a) - sum(a) * sum(a) / count(*) as va, sum(b * b) - sum(b) * sum(b) / count(*) as vb, sum(yp) as pos, sum(a * yp) as rs from r group by 1, 2, 3),
i as (select factor, perm, case when n >= 5 and va > 1e-12 and vb > 1e-12 then c / sqrt(va * vb) end as ic, case when n >= 5 and pos > 0 and pos < n then 2 * (rs - pos * (pos + 1) / 2) / (pos * (n - pos)) - 1 end as gini from s),
f as (select factor, perm, abs(avg(ic)) as ic_mean, abs(avg(ic) / stddev_samp(ic)) as icir, abs(avg(gini)) as gini from i group by 1, 2), nl as (select perm, max(ic_mean) as ic_mean, max(icir) as icir, max(gini) as gini from f group by 1)
"""


def _null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.placebo_null(event_table(spark, sf_dir, "event_id", "y", "score", "feat_a"), ["score", "feat_a"], "y", "event_id", _PERMS)


@query(_null_sql() + "select cast(perm as int) as perm, " + ", ".join(r6(c, c) for c in ("ic_mean", "icir", "gini")) + " from nl")
def placebo_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest absolute metric over the factors under each shuffle: the form with SQL, ten shuffles of two factors."""
    return rounded(_null(spark, sf_dir), ["perm"])


@query(_null_sql() + " union all ".join(f"select '{c}' as metric, round(quantile_cont({c}, 0.95), 6) + 0.0 as p95, round(quantile_cont({c}, 0.99), 6) + 0.0 as p99, round(quantile_cont({c}, 0.999), 6) + 0.0 as p999 from nl" for c in ("ic_mean", "icir", "gini")))
def placebo_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds from the null of ten shuffles, the form with SQL."""
    return rounded(a.null_quantiles(_null(spark, sf_dir)), ["metric"])


#: Shuffles of the reference's default; every factor that is graded is in the null.
_FULL_PERMS = 1000


def _full_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.placebo_null(event_table(spark, sf_dir), list(EVENT_FIELDS), "y", "event_id", _FULL_PERMS)


@query()
def placebo_null_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest absolute metric over all factors under each of 1000 shuffles; no SQL, the operator's is placebo_null's."""
    return rounded(_full_null(spark, sf_dir), ["perm"])


@query()
def placebo_quantiles_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds from the null of all factors and 1000 shuffles."""
    return rounded(a.null_quantiles(_full_null(spark, sf_dir)), ["metric"])


@query()
def placebo_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics of all factors graded by the thresholds of placebo_quantiles_full."""
    metrics = a.factor_metrics(event_table(spark, sf_dir), list(EVENT_FIELDS), "y")
    return rounded(a.grade(metrics, a.null_quantiles(_full_null(spark, sf_dir))), ["factor", "level", "eligible"])


# scoring and search


@query(ranked_sql() + "select trade_date, code, cast(rank as int) as rank, round(score, 6) + 0.0 as score from k where t = (select max(t) from k) and rank is not null")
def live_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last date's names by score."""
    e = event_table(spark, sf_dir, "score")
    last = e.agg(F.max("t").alias("t"))
    return m.ranked(e.join(F.broadcast(last), "t"), "score").where("rank is not null").select("trade_date", "code", "rank", (F.round("score", 6) + 0.0).alias("score"))


#: A test size of the search, whose own defaults are 400 trees and 25 generations.
_SMALL = {"population": 24, "generations": 2}


@query()
def factor_search_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An evolutionary search at test size, net of costs, bred on the earlier dates and selected on the later; a row a survivor."""
    fit, selection = lb.fit_selection(*lb.outcome_complete(0, calendar(spark, sf_dir).count(), 2))
    found = search(event_table(spark, sf_dir), list(EVENT_FIELDS), "ret", k=_K, kind="event", seed=3, cost=0.0001, fit=fit, selection=selection, **_SMALL)
    return spark.createDataFrame([(s.expression, float(s.fitness), float(s.selection), s.size) for s in found], "expression string, fitness double, selection double, size int")


@query()
def mined_factors_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds of the search at test size, the second on what the first leaves unexplained; a row a survivor."""
    fit, selection = lb.fit_selection(*lb.outcome_complete(0, calendar(spark, sf_dir).count(), 2))
    found = mine(event_table(spark, sf_dir), list(EVENT_FIELDS), "ret", rounds=2, k=_K, kind="event", seed=5, keep=2, cost=0.0001, fit=fit, selection=selection, **_SMALL)
    return spark.createDataFrame([(n, s.expression, float(s.fitness), float(s.selection)) for n, s in found], "round int, expression string, fitness double, selection double")


@query()
def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walk-forward classifier of the outcome: mean daily gini of each fold's test dates; no SQL for an iterative fit."""
    from ..operators.model import walk_forward_scores

    e = event_table(spark, sf_dir)
    folds = lb.walk_forward(calendar(spark, sf_dir).count(), 200, 20, 100, 2)
    s = walk_forward_scores(e, list(EVENT_FIELDS), folds)
    return rounded(m.daily_gini(s, "prediction_score", by=("fold",)).groupBy("fold").agg(F.avg("gini").alias("gini"), F.count("gini").alias("n_dates")), ["fold", "n_dates"])


@query()
def ablation_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the features beside the score add to boosted trees, over two seeds; a few small trees, as a test size."""
    from ..operators.diagnostics import seed_delta
    from ..operators.model import ablation

    fold = lb.walk_forward(calendar(spark, sf_dir).count(), 200, 20, 100, 2)[0]
    rows = ablation(event_table(spark, sf_dir), ["score"], list(EVENT_FIELDS[1:]), fold, (1, 2), iterations=3, depth=3)
    return rounded(seed_delta(spark.createDataFrame(rows, "arm string, seed int, gini double"), "arm", "gini", "base"), ["arm", "n"])
