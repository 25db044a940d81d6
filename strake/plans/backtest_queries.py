"""Queries of frozen books, ledgers, diagnostics, guards and style-neutral scores, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import finite, norm_code, plain_date, table
from ..functions import ops as o
from ..operators import audits as a
from ..operators import diagnostics as d
from ..operators import guards as g
from ..operators import labels as lb
from ..operators import ledger as lg
from ..operators import metrics as m
from ..operators import portfolio as p
from ..operators import relational as r
from ..sources.panel import EVENT_FIELDS, EVENT_SQL, FINAL_SQL, PANEL_SQL, bar_panel, bars, calendar, event_table
from .audit_queries import _EXIT_SQL, _ex_right, _h_sql, _null, _null_sql, _styles
from .panel_queries import _BT, _corr_sql, _screen_sql, guard, ic_sql, pdiv, r6, ranked_sql, rounded

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
_K = 4
_CAL = PANEL_SQL[: PANEL_SQL.index("bars as")]
BUY, SELL = 0.0006, 0.0011


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def also(sql: str) -> str:
    """SQL over the calendar as a continuation of another that has made it."""
    return ",\n" + sql[len(_CAL) :]


def net_sql(v: str, buy: str = str(BUY), sell: str = str(SELL)) -> str:
    return f"((1 + {v}) * (1 - {sell}) / (1 + {buy}) - 1)"


# books


_TARGET = f"(select * replace (case when ret is not null and y > 0 then 0.03 else ret end as ret) from k)"


@query(_BT.replace(" from k group by t having", f" from {_TARGET} group by t having") + "select t, n_available, n_executed, " + ", ".join(r6(c, c, 8) for c in ("hit_rate", "base_rate", "gross_return", "net_return", "portfolio_return")) + " from d")
def backtest_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily book when picks that hit are sold at the target, others at the close."""
    return rounded(p.backtest(event_table(spark, sf_dir, "score", "ret", "y"), "score", "ret", "y", _K, BUY, SELL, 2, target=0.03), ["t", "n_available", "n_executed"], 8)


@query("""
with cal as (select cast(row_number() over (order by trade_date) - 1 as int) as t, trade_date from (select distinct cal_date as trade_date from trade_cal where is_open = 1)),
x as (select c.t, upper(trim(stock_code)) as code, event_id, case when isfinite(score) then score end as score from event_rows join cal c on replace(event_rows.trade_date, '-', '') = c.trade_date where stock_code is not null),
b as (select distinct t, code, first_value(event_id) over w as event_id, first_value(score) over w as score from x window w as (partition by t, code order by score desc nulls last, event_id)),
k as (select *, row_number() over (partition by t order by score desc nulls last, code) as rank from b)
select t, code, event_id, cast(rank as int) as rank from k where rank <= 4 and score is not null""")
def topk_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four best names of every date when a name's repeated rows count as its best one."""
    raw = table(spark, sf_dir, "event_rows").withColumns({"trade_date": plain_date("trade_date"), "code": norm_code("stock_code")}).where("code is not null")
    rows = raw.join(F.broadcast(calendar(spark, sf_dir)), "trade_date").select("t", "code", "event_id", finite("score").alias("score"))
    return m.ranked(lg.collapse_duplicates(rows, "score", "event_id"), "score").where(F.col("rank") <= _K).select("t", "code", "event_id", "rank")


_LEDGER = ranked_sql() + also(_EXIT_SQL) + f"""
, market as (select t, code, case when lead(is_trading) over wt and lead(open_h) over wt > 0 then lead(open_h) over wt end as entry, lead(close_h, 2) over wt as close2 from panel window wt as (partition by code order by t)),
pk as (select t, code, rank from (select *, count(score) over (partition by t) as n from k) where rank <= {_K} and n >= {_K}),
l0 as (select pk.t, pk.code, pk.rank, entry, close2, x.ex.t as exit_t, x.ex.price as exit_price, x.ex.kind as exit_kind, case when entry is null then 'no_entry' when x.ex is null then 'open' else 'sold' end as status
  from pk left join market using (t, code) left join x using (t, code)),
l as (select *, close2 / entry - 1 as baseline, case when status = 'sold' then exit_price / entry - 1 end as realistic from l0)
"""


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = bar_panel(spark, sf_dir, hindsight=True, fields=("pre_close", "open", "high", "close", "open_h", "close_h", "is_trading")).withColumns({"down_limit": F.rint(F.col("pre_close") * 90) / 100, "limit_observed": F.col("pre_close").isNotNull()})
    return lg.ledger(event_table(spark, sf_dir, "score").select("t", "code", "score"), "score", _K, x)


@query(_LEDGER + "select t, code, cast(rank as int) as rank, status, exit_t, exit_kind, " + ", ".join(r6(c, n) for c, n in (("entry", "entry_price"), ("close2", "close_price"), ("exit_price", "exit_price"), ("baseline", "baseline"), ("realistic", "realistic"))) + " from l")
def trade_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pick with its entry, the exit the bars allow, and both returns."""
    return rounded(_ledger(spark, sf_dir), ["t", "code", "rank", "status", "exit_t", "exit_kind"])


@query(_LEDGER + "select t, " + ", ".join(f"count(*) filter (where status = '{s}') as n_{s}" for s in ("sold", "open", "no_entry")) + ", " + ", ".join(f"round(coalesce(sum({net_sql(c)}), 0) / {_K} / 2, 8) + 0.0 as {c}" for c in ("baseline", "realistic")) + " from l group by t")
def ledger_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The book by date: sold, never sold and never bought slots, net returns with the last two in cash."""
    return rounded(lg.ledger_daily(_ledger(spark, sf_dir), _K, BUY, SELL, 2), ["t", "n_sold", "n_open", "n_no_entry"], 8)


@query(_LEDGER + "select status, exit_kind, count(*) as n, " + r6("avg(exit_t - t - 2)", "mean_delay") + ", " + r6("avg(realistic - baseline)", "mean_error") + " from l group by 1, 2")
def ledger_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How late the sales were, and what that changed."""
    return rounded(lg.ledger_audit(_ledger(spark, sf_dir)), ["status", "exit_kind", "n"])


_ARMS = EVENT_SQL + also(FINAL_SQL) + f"""
, sc as (select t, code, 'score' as arm, score as x from e union all select t, code, 'feat_a', feat_a from e),
pk as (select * from (select *, row_number() over (partition by arm, t order by x desc nulls last, code) as p, count(x) over (partition by arm, t) as n from sc) where n >= {_K} and p <= {_K}),
fw as (select pk.arm, pk.t, h, z.close_h / case when abs(b.close_h) >= 1e-9 then b.close_h end - 1 as r from pk cross join (select unnest(generate_series(1, 10)) as h) left join panel b on b.code = pk.code and b.t = pk.t left join panel z on z.code = pk.code and z.t = pk.t + h),
dy as (select arm, cost, h, t, coalesce(sum((1 + r) * (1 - cost) / (1 + cost) - 1), 0) / {_K} / h as v, count(r) as done from fw cross join (select unnest([0.0::double, 0.001::double]) as cost) group by 1, 2, 3, 4)
select arm as score, cost, cast(h as int) as h, count(v) as n_days, round(avg(v), 8) + 0.0 as mean, round(stddev_samp(v), 8) + 0.0 as std, round(avg(v) / stddev_samp(v), 6) + 0.0 as ir, round(avg(done) / {_K}, 6) + 0.0 as execution_rate from dy group by 1, 2, 3
"""


@query(_ARMS)
def paired_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books of two scores, two costs and ten horizons over the same dates."""
    x = lg.paired_books(event_table(spark, sf_dir, "score", "feat_a"), bar_panel(spark, sf_dir, hindsight=True, fields=("close_h",)), ["score", "feat_a"], [0.0, 0.001], _K)
    r8 = lambda c, n: (F.round(c, n) + 0.0).alias(c)
    return x.select("score", "cost", "h", "n_days", r8("mean", 8), r8("std", 8), r8("ir", 6), r8("execution_rate", 6))


_BASIS = EVENT_SQL + also(FINAL_SQL) + f""", h as (select t, code, lead(close, 2) over (partition by code order by t) / lead(open) over (partition by code order by t) - 1 as raw, lead(close_h, 2) over (partition by code order by t) / lead(open_h) over (partition by code order by t) - 1 as hfq from panel),
k as (select t, code, row_number() over (partition by t order by score desc nulls last, code) as rank, score from e), s as (select k.t, k.code, rank, raw, hfq from k left join h using (t, code) where score is not null and rank <= {_K})
select count(*) as n_picks, count(raw) as n_raw, count(hfq) as n_hfq, round(avg(raw), 6) + 0.0 as mean_raw, round(avg(hfq), 6) + 0.0 as mean_hfq, sha256(string_agg(t || '|' || code, ',' order by t, rank)) as digest from s"""


@query(_BASIS)
def basis_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One frozen selection, its digest, and its outcome on raw and on adjusted prices."""
    h = _ex_right(spark, sf_dir).select("t", "code", "raw", "hfq")
    picks = m.ranked(event_table(spark, sf_dir, "score").select("t", "code", "score"), "score").where(F.col("rank") <= _K)
    names = F.transform(F.sort_array(F.collect_list(F.struct("t", "rank", "code"))), lambda x: F.concat_ws("|", x["t"], x["code"]))  # k rows a date
    x = picks.join(h, ["t", "code"], "left").agg(F.count(F.lit(1)).alias("n_picks"), F.count("raw").alias("n_raw"), F.count("hfq").alias("n_hfq"), F.avg("raw").alias("mean_raw"), F.avg("hfq").alias("mean_hfq"), F.sha2(F.concat_ws(",", names), 256).alias("digest"))
    return rounded(x, ["n_picks", "n_raw", "n_hfq", "digest"])


# diagnostics

_OK_Y, _OK_R = "(score is not null and y is not null)", "(score is not null and ret is not null)"
_PLACE = "case when {0} then cast(row_number() over (partition by t, {0} order by {1}, code) as double) end as {2}"
_DAYS = ranked_sql() + f""", p0 as (select *, {_PLACE.format(_OK_Y, 'score', 'a')}, {_PLACE.format(_OK_Y, 'y', 'b')}, {_PLACE.format(_OK_R, 'score', 'c')}, {_PLACE.format(_OK_R, 'ret', 'd')} from k),
p1 as (select t, case when count(a) >= 5 then corr(a, b) end as hit_ic, case when count(c) >= 5 then corr(c, d) end as close_ic,
  case when count(a) >= 5 and sum(y) filter (where a is not null) > 0 and sum(y) filter (where a is not null) < count(a) then 2 * (sum(a * y) - sum(y) filter (where a is not null) * (sum(y) filter (where a is not null) + 1) / 2) / (sum(y) filter (where a is not null) * (count(a) - sum(y) filter (where a is not null))) - 1 end as gini,
  case when count(score) >= {_K} then coalesce(sum(ret) filter (where rank <= {_K}), 0) / {_K} end as top_gross, case when count(score) >= {_K} then coalesce(sum({net_sql('ret', '0.001', '0.001')}) filter (where rank <= {_K}), 0) / {_K} end as top_net,
  case when count(score) >= 10 then coalesce(sum(ret) filter (where rank <= 10), 0) / 10 end as wide_gross, case when count(score) >= 10 then coalesce(sum(y) filter (where rank <= 10), 0) / 10 end as wide_hit,
  avg(ret) as pool_mean, case when count(score) >= {_K} then count(ret) filter (where rank <= {_K}) / {_K} end as execution_rate, coalesce(list(code) filter (where rank <= {_K}), []) as s from p0 group by t),
days as (select * exclude (s), case when len(s) > 0 and lag(s) over (order by t) is not null then 1 - len(list_intersect(s, lag(s) over (order by t))) / len(s) end as turnover from p1)
"""
_DAY_COLS = ("hit_ic", "close_ic", "gini", "top_gross", "top_net", "wide_gross", "wide_hit", "pool_mean", "execution_rate", "turnover")


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.daily_diagnostics(event_table(spark, sf_dir, "score", "ret", "y"), "score", "ret", "y", _K, cost=0.001)


@query(_DAYS + "select t, " + ", ".join(r6(c, c, 9) for c in _DAY_COLS) + " from days")
def daily_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything about a date in one row."""
    return rounded(_days(spark, sf_dir), ["t"], 9)


_SPANS = ", b as (select max(t) + 1 - 2 as hi from cal), spans as (select 'fit' as w, 0 as lo, cast(floor(0.8 * hi) as int) as hi from b union all select 'selection', cast(floor(0.8 * hi) as int) + 2, hi from b union all select 'full', 0, hi from b)"


def _spans(spark: SparkSession, sf_dir: str) -> dict[str, tuple[int, int]]:
    lo, hi = lb.outcome_complete(0, calendar(spark, sf_dir).count(), 2)
    fit, selection = lb.fit_selection(lo, hi)
    return {"fit": fit, "selection": selection, "full": (lo, hi)}


@query(_DAYS + _SPANS + 'select w as "window", count(top_net) as n_days, ' + ", ".join(r6(f"avg({c})", n) for c, n in (("top_net", "objective"), ("wide_hit", "wide_hit"), ("hit_ic", "hit_ic"), ("close_ic", "close_ic"), ("gini", "gini"))) + " from days join spans on t >= lo and t < hi group by 1")
def score_monitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score over the dates to fit on, to select on, and all."""
    return rounded(d.monitors(_days(spark, sf_dir), _spans(spark, sf_dir)), ["window", "n_days"])


_LIBRARY = {"f_score": "score", "f_minus_c": "neg(feat_c)", "f_ratio": "div(feat_d, feat_e)", "f_ranks": "add(cs_rank(feat_a), cs_rank(feat_b))"}
_CS = "case when {0} is not null then row_number() over (partition by t order by {0} nulls last, code) / count({0}) over (partition by t) end"
_ALIGN = EVENT_SQL + _SPANS + f""", v as (select t, code, ret, score as f_score, -feat_c as f_minus_c, {pdiv('feat_d', 'feat_e')} as f_ratio, {_CS.format('feat_a')} + {_CS.format('feat_b')} as f_ranks from e),
u as (unpivot (select t, code, coalesce(ret, 'nan'::double) as ret, coalesce(f_score, 'nan') as f_score, coalesce(f_minus_c, 'nan') as f_minus_c, coalesce(f_ratio, 'nan') as f_ratio, coalesce(f_ranks, 'nan') as f_ranks from v) on {', '.join(_LIBRARY)} into name factor value x),
w as (select factor, t, code, case when not isnan(ret) then ret end as ret, case when not isnan(x) then x end as x from u), pl as (select *, row_number() over (partition by factor, t order by x desc nulls last, code) as place from w),
dy as (select factor, t, case when count(x) >= {_K} then coalesce(sum({net_sql('ret', '0.001', '0.001')}) filter (where place <= {_K} and x is not null), 0) / {_K} end as v from pl group by 1, 2),
al as (select factor, avg(v) filter (where w = 'fit') as fit_net, avg(v) filter (where w = 'selection') as selection_net, count(v) filter (where w = 'fit') as n_fit, count(v) filter (where w = 'selection') as n_selection from dy join spans on t >= lo and t < hi where w <> 'full' group by 1)
"""


def _alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _spans(spark, sf_dir)
    return d.library_alignment(event_table(spark, sf_dir), _LIBRARY, "ret", _K, w["fit"], w["selection"], 0.001)


@query(_ALIGN + "select factor, n_fit, n_selection, " + r6("fit_net", "fit_net", 8) + ", " + r6("selection_net", "selection_net", 8) + " from al")
def library_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each factor's net return on the dates it was fitted on and on later ones."""
    return rounded(_alignment(spark, sf_dir), ["factor", "n_fit", "n_selection"], 8)


@query(_ALIGN + "select count(*) as n, round(corr(fit_net, selection_net), 5) + 0.0 as corr from al")
def library_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the order of factors by fitted return holds later."""
    x, y = F.col("fit_net") * 1e3, F.col("selection_net") * 1e3
    return rounded(_alignment(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), m.pearson(x, y, 3).alias("corr")), ["n"], 5)


@query(EVENT_SQL + """, c as (select t, score as x, y from e where score is not null and y is not null), q as (select t, rank() over (partition by t order by x) + (count(*) over (partition by t, x) - 1) / 2 as a, rank() over (partition by t order by y) + (count(*) over (partition by t, y) - 1) / 2 as b from c),
s as (select t, case when count(*) >= 5 and stddev_pop(a) > 1e-9 and stddev_pop(b) > 1e-9 then corr(a, b) end as ic from q group by t) select d.t, """ + r6("ic", "ic") + " from (select distinct t from e) d left join s using (t)")
def ic_average_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank IC of the score and the hit, with ties at their mean rank."""
    return rounded(d.average_tie_ic(event_table(spark, sf_dir, "score", "y"), "score", "y"), ["t"])


@query(EVENT_SQL + """, c as (select substr(trade_date, 1, 6) as month, count(*) as n, corr(score, ret) as r from e where score is not null and ret is not null group by 1),
f as (select *, asin(abs(r)) as lo, least(pi() / 2, asin(abs(r)) + 14 / sqrt(n)) as hi from c where n >= 4),
i as (select month, sum(case when k in (0, 4000) then 1 when k % 2 = 1 then 4 else 2 end * pow(cos(lo + (hi - lo) * k / 4000), n - 3)) * any_value(hi - lo) / 12000 as area from f cross join (select unnest(generate_series(0, 4000)) as k) group by month)
select month, n, round(r, 6) + 0.0 as r, round(2 * area / exp(lgamma((n - 2) / 2) + lgamma(0.5) - lgamma((n - 1) / 2)), 6) + 0.0 as p from c left join i using (month)""")
def correlation_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of score and outcome by month, with its p-value."""
    e = event_table(spark, sf_dir, "score", "ret").where("score is not null and ret is not null").withColumn("month", F.substring("trade_date", 1, 6))
    return rounded(d.correlation_test(e, "score", "ret", "month"), ["month", "n"])


_PCT = "case when turnover is not null then (rank() over (partition by t order by turnover nulls last) + (count(turnover) over (partition by t, turnover) - 1) / 2) / count(turnover) over (partition by t) end"


@query(ranked_sql() + also(PANEL_SQL) + f""", liq as (select t, code, open, {_PCT} as pct from bars) select count(*) as picks, round(avg(case when k.ret is null then 1.0 else 0.0 end), 6) + 0.0 as no_outcome, round(avg(case when nx.open is null then 1.0 else 0.0 end), 6) + 0.0 as no_entry,
round(avg(case when pct <= 0.1 then 1.0 when pct > 0.1 then 0.0 end), 6) + 0.0 as bottom_decile, round(median(pct), 6) + 0.0 as median_liquidity from k left join liq using (t, code) left join bars nx on nx.code = k.code and nx.t = k.t + 1 where rank <= {_K}""")
def pick_feasibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the picks lacked, and how liquid they were among their date's bars."""
    b = bars(spark, sf_dir, ("open", "turnover"))
    liquid = b.select("t", "code", o.cs_pct_rank(F.col("turnover")).alias("pct"))
    picks = m.ranked(event_table(spark, sf_dir, "score", "ret"), "score").where(F.col("rank") <= _K).select("t", "code", "ret").join(liquid, ["t", "code"], "left")
    return rounded(d.feasibility(r.at_offset(picks, b, F.lit(1), ["open"]), "ret", "open_at", "pct"), ["picks"])


@query(EVENT_SQL + also(FINAL_SQL) + f""", fw as (select t, code, {_PCT} as pct, {pdiv('lead(high_h, 2) over wt', 'lead(open_h) over wt')} - 1 as peak, {pdiv('lead(close_h, 2) over wt', 'lead(open_h) over wt')} - 1 as close from panel window wt as (partition by code order by t)),
j as (select e.t, e.code, score, y, peak, fw.close, pct from e left join fw using (t, code)), q as (select *, greatest(1, (5 * (row_number() over (partition by t order by score, code) - 1) + count(*) over (partition by t) - 2) // (count(*) over (partition by t) - 1)) as bin, count(*) over (partition by t) as n from j where score is not null),
b as (select * from q where n > 1), sets as (select bin, t, list(code) as s from b group by 1, 2), tv as (select bin, avg(1 - len(list_intersect(s, before)) / len(s)) as turnover from (select *, lag(s) over (partition by bin order by t) as before from sets) where before is not null group by bin)
select cast(bin as int) as bin, count(*) as n, round(avg(y), 6) + 0.0 as hit_rate, round(avg(peak), 6) + 0.0 as peak, round(avg(close), 6) + 0.0 as close, round(avg(peak) - avg(close), 6) + 0.0 as giveback, round(median(pct), 6) + 0.0 as median_liquidity, round(avg(case when pct <= 0.1 then 1.0 when pct > 0.1 then 0.0 end), 6) + 0.0 as bottom_decile, round(any_value(turnover), 6) + 0.0 as turnover from b join tv using (bin) group by 1""")
def quintile_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quintiles of the score: hits, peak, close and what was given back between, liquidity, turnover."""
    entry = o.lead(F.col("open_h"), 1)
    fw = bar_panel(spark, sf_dir, hindsight=True, fields=("turnover", "open_h", "high_h", "close_h")).select("t", "code", o.cs_pct_rank(F.col("turnover")).alias("pct"), (o.div(o.lead(F.col("high_h"), 2), entry) - 1).alias("peak"), (o.div(o.lead(F.col("close_h"), 2), entry) - 1).alias("close"))
    x = event_table(spark, sf_dir, "score", "y").select("t", "code", "score", "y").join(fw, ["t", "code"], "left")
    return rounded(d.bin_profile(x, "score", "y", "peak", "close", "pct"), ["bin", "n"])


@query(PANEL_SQL + """, h as (select t, code, not is_trading as halted, not is_trading and lag(is_trading) over (partition by code order by t) as mark from panel)
select cast(off as int) as "offset", count(*) as n, count(*) filter (where z.halted) as hits from h cross join (select unnest(generate_series(-10, 20)) as off) join h z on z.code = h.code and z.t = h.t + off where h.mark group by 1""")
def halt_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Around the first day of each halt, how many names don't trade; the day itself is the control."""
    x = bar_panel(spark, sf_dir, fields=("is_trading",)).select("t", "code", (~F.col("is_trading")).alias("halted"), (~F.col("is_trading") & o.delay(F.col("is_trading"), 1)).alias("mark"))
    return d.offset_profile(x.where("mark"), x, "halted", -10, 20)


_MOVED = ("feat_a", "feat_b", "y")


@query(EVENT_SQL + f", s as (select *, row_number() over (partition by t order by code, event_id) as i, row_number() over (partition by t order by {_h_sql('event_id', '0', 't')}, event_id) as j from e) select s.t, s.code, " + ", ".join(r6(f"z.{c}", c) for c in _MOVED) + " from s join s z on z.t = s.t and z.j = s.i")
def shuffled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several columns exchanged within dates by one permutation."""
    x = event_table(spark, sf_dir, "event_id", "feat_a", "feat_b", "y").select("t", "code", "event_id", *_MOVED)
    return rounded(d.shuffled_rows(x, list(_MOVED), "event_id").select("t", "code", *_MOVED), ["t", "code"])


# guards


@query("with d as (select replace(trade_date, '-', '') as d, count(*) as n from event_rows where trade_date is not null group by 1) select min(d) as first, max(d) as last, count(*) as n_dates, cast(sum(n) as bigint) as n_rows, sha256(string_agg(d, ',' order by d)) as digest from d")
def window_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dates event_rows covers, as one digest."""
    return g.window_digest(table(spark, sf_dir, "event_rows").select(plain_date("trade_date").alias("trade_date")))


@query(PANEL_SQL + "select substr(trade_date, 1, 6) as month, count(x) as n, count(*) filter (where x > 0.011) as n_off, round(max(x), 6) + 0.0 as worst from (select trade_date, abs(pct_chg - 100 * (close / pre_close - 1)) as x from bars) group by 1")
def derived_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated daily changes against those of the stated prices, by month."""
    b = bars(spark, sf_dir, ("pct_chg", "close", "pre_close")).withColumn("month", F.substring("trade_date", 1, 6))
    return rounded(g.derived_mismatch(b, "pct_chg", 100 * (F.col("close") / F.col("pre_close") - 1), 0.011, ["month"]), ["month", "n", "n_off"])


@query(PANEL_SQL + ", c as (select trade_date, code, abs(pre_close - lag(close) over (partition by code order by t)) as x from panel) select substr(trade_date, 1, 6) as month, count(x) as n, count(*) filter (where x > 0.006) as n_off, round(max(x), 6) + 0.0 as worst from c group by 1")
def price_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated previous closes against the closes of the session before, by month."""
    x = bar_panel(spark, sf_dir, fields=("close", "pre_close")).withColumns({"before": o.delay(F.col("close"), 1), "month": F.substring("trade_date", 1, 6)})
    return rounded(g.derived_mismatch(x, "pre_close", F.col("before"), 0.006, ["month"]), ["month", "n", "n_off"])


@query(PANEL_SQL + "select substr(trade_date, 1, 6) as month, count(*) as n_cells, count(distinct code) as n_codes from panel where close is not null and adj is null group by 1")
def unadjusted_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices that no factor known by then adjusts, by month."""
    x = g.unadjusted(bar_panel(spark, sf_dir, fields=("close", "adj"))).groupBy(F.substring("trade_date", 1, 6).alias("month"))
    return x.agg(F.count(F.lit(1)).alias("n_cells"), F.countDistinct("code").alias("n_codes"))


@query(PANEL_SQL + ", top as (select code from bars group by code order by median(amount) desc nulls last, code limit 10) select trade_date, code, " + r6("close", "close") + " from bars where code in (select code from top)")
def code_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars of the ten most traded codes."""
    b = bars(spark, sf_dir, ("amount", "close"))
    return rounded(g.select_codes(b, r.top_liquid(b, "amount", 10)).select("trade_date", "code", "close"), ["trade_date", "code"])


@query(EVENT_SQL + ", c as (select cal.t, z.trade_date as exit_date from cal left join cal z on z.t = cal.t + 2) select substr(exit_date, 1, 6) as exit_month, count(*) as n from e join c using (t) where exit_date <= '20230630' group by 1")
def outcome_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event rows whose exit, two sessions on, is not after the cutoff, by month of the exit."""
    cal = calendar(spark, sf_dir)
    x = lb.exit_before(event_table(spark, sf_dir, "event_id"), cal, 2, "20230630")
    return x.groupBy(F.substring("exit_date", 1, 6).alias("exit_month")).agg(F.count(F.lit(1)).alias("n"))


@query(EVENT_SQL + "select event_id as source_key, t, code from e where score is not null and y is not null and ret is not null and feat_a is not null")
def complete_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with all that a fit needs, and where they came from."""
    return g.complete_cases(event_table(spark, sf_dir, "event_id", "score", "y", "ret", "feat_a"), ["score", "y", "ret", "feat_a"], "event_id").select("source_key", "t", "code")


_MARK = "contains(replace(upper({0}), ' ', ''), 'ST')"


@query(EVENT_SQL + f""", n as (select upper(trim(ts_code)) as code, stock_name, start_date, end_date from namechange), cur as (select upper(trim(ts_code)) as code, arg_max({{'n': stock_name}}, loaded_at) as v from stock_basic where loaded_at is not null group by 1)
select trade_date, code, exists (select 1 from n where n.code = e.code and {_MARK.format('stock_name')} and e.trade_date >= start_date and (end_date is null or e.trade_date <= end_date)) or (not exists (select 1 from n where n.code = e.code) and coalesce((select {_MARK.format('v.n')} from cur where cur.code = e.code), false)) as flagged from e""")
def name_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a marked name was in effect on the date; codes without a name history go by their present name."""
    marked = lambda c: F.contains(F.replace(F.upper(c), F.lit(" "), F.lit("")), F.lit("ST"))
    names = table(spark, sf_dir, "namechange").withColumn("code", norm_code("ts_code"))
    now = table(spark, sf_dir, "stock_basic").where("loaded_at is not null").groupBy(norm_code("ts_code").alias("code")).agg(F.max_by(F.struct("stock_name"), "loaded_at").alias("v"))
    now = now.select("code", marked(F.col("v.stock_name")).alias("flagged"))
    e = event_table(spark, sf_dir, "event_id").select("trade_date", "code")
    return r.interval_any(e, names, key="code", at="trade_date", start="start_date", end="end_date", flag=marked(F.col("stock_name")), name="flagged", current=now)


# style-neutral scores

_STYLES = ("momentum_20d", "volatility_20d", "turnover_mean_20d", "log_total_mv")
_STYLE_SQL = f"""momentum_20d, volatility_20d, turnover_mean_20d, log_total_mv from (select t, code, {guard('pct_chg', 20, 'exp(sum(ln(1 + pct_chg / 100)) over w20) - 1')} as momentum_20d, {guard('pct_chg', 20, 'stddev_samp(pct_chg / 100) over w20')} as volatility_20d,
  {guard('turnover', 20, 'avg(turnover) over w20')} as turnover_mean_20d, case when total_mv > 0 then ln(total_mv) end as log_total_mv from panel window w20 as (partition by code order by t rows 19 preceding))"""


def _gram_schmidt() -> str:
    """Residuals of the score on the category's levels and the styles: demeaned within levels, then freed of one style after
    the other, each of which was freed of those before."""
    xs = [f"x{i}" for i in range(len(_STYLES))]
    zs = ", ".join(f"(case when stddev_samp({c}) over wt > 0 then ({c} - avg({c}) over wt) / stddev_samp({c}) over wt when {c} is not null then 0 end) as x{i}" for i, c in enumerate(_STYLES))
    sql = EVENT_SQL + also(PANEL_SQL) + f""", styles as (select t, code, {_STYLE_SQL}), mk as (select upper(trim(ts_code)) as code, arg_max({{'m': market}}, loaded_at) as v from stock_basic where loaded_at is not null group by 1),
z0 as (select e.t, e.code, e.score, e.ret, v.m as market, {', '.join(_STYLES)} from e left join styles using (t, code) left join mk using (code)), z1 as (select t, code, score, ret, market, {zs} from z0 window wt as (partition by t)),
g0 as (select t, code, ret, score, {', '.join(f'{c} - avg({c}) over w as {c}' for c in xs)}, score - avg(score) over w as y, score as raw from z1 where score is not null and market is not null and {' and '.join(f'{c} is not null' for c in xs)} window w as (partition by t, market))"""
    for i, x in enumerate(xs):
        coef = lambda c: f"coalesce(sum({c} * {x}) over (partition by t) / nullif(case when sum({x} * {x}) over (partition by t) > 1e-9 then sum({x} * {x}) over (partition by t) end, 0), 0)"  # noqa: B023, E731
        rest = [c if j <= i else f"{c} - {coef(c)} * {x} as {c}" for j, c in enumerate(xs)]
        sql += f", g{i + 1} as (select t, code, ret, score, raw, {', '.join(rest)}, y - {coef('y')} * {x} as y from g{i})"
    return sql + f", res as (select t, code, ret, score, {', '.join(xs)}, case when sum(y * y) over (partition by t) > 1e-12 * sum(raw * raw) over (partition by t) then y end as residual, count(*) over (partition by t) as n from g{len(xs)})"


_NEUTRAL = _gram_schmidt()


def _neutral(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    styles = _styles(bar_panel(spark, sf_dir, fields=("pct_chg", "turnover", "total_mv"))).select("t", "code", *_STYLES)
    market = table(spark, sf_dir, "stock_basic").where("loaded_at is not null").groupBy(norm_code("ts_code").alias("code")).agg(F.max_by(F.struct("market"), "loaded_at").alias("v")).select("code", "v.market")
    e = event_table(spark, sf_dir, "score", "ret").select("t", "code", "score", "ret").join(styles, ["t", "code"], "left").join(market, "code", "left")
    x, names = a.style_design(e, list(_STYLES), "market")
    full = F.col("score").isNotNull()
    for c in (*_STYLES, "market"):
        full = full & F.col(c).isNotNull()
    x = x.withColumn("n", F.count_if(full).over(o.across())).where(full & (F.col("n") > 12))
    return a.residualize(x, "score", names), names


@query(_NEUTRAL + "select t, code, round(residual, 6) + 0.0 as residual from res where n > 12")
def style_neutral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score freed of trailing styles and of the market segment, on dates of more than twelve complete rows."""
    return rounded(_neutral(spark, sf_dir)[0].select("t", "code", "residual"), ["t", "code"])


_BOOK = "select '{0}' as arm, count(v) as n_days, round(avg(v), 8) + 0.0 as mean, round(stddev_samp(v), 8) + 0.0 as std from (select t, case when count(x) >= 4 then coalesce(sum(ret) filter (where p <= 4), 0) / 4 end as v from (select t, {0} as x, ret, case when {0} is not null then row_number() over (partition by t order by {0} desc nulls last, code) end as p from res where n > 12) group by t)"


@query(_NEUTRAL + _BOOK.format("residual") + " union all " + _BOOK.format("score"))
def style_neutral_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The books of the raw and of the style-neutral score on their common rows."""
    x, _ = _neutral(spark, sf_dir)
    one = lambda c: p.top_k_portfolio(x, c, "ret", _K).agg(F.count("portfolio_return").alias("n_days"), F.avg("portfolio_return").alias("mean"), F.stddev_samp("portfolio_return").alias("std")).withColumn("arm", F.lit(c))
    return rounded(one("residual").unionByName(one("score")), ["arm", "n_days"], 8)


# choices among factors


def _select_sql() -> str:
    return f"""with recursive sc as ({_screen_sql()}), co as ({_corr_sql()}), od as (select feature, row_number() over (order by abs_ic desc, feature) as i from sc),
cl as (select feature, i, coalesce((select list(case when a = feature then b else a end) from co where (a = feature or b = feature) and abs(corr) > 0.7), []) as foes from od),
st as (select 0 as i, []::varchar[] as kept union all select cl.i, case when len(kept) < 4 and not list_has_any(kept, foes) then list_append(kept, feature) else kept end from st join cl on cl.i = st.i + 1),
fin as (select kept from st order by i desc limit 1) select cast(k - 1 as int) as position, kept[k] as feature from fin, (select unnest(generate_series(1, 4)) as k) where k <= len(kept)"""


ORACLE["feature_select"] = _select_sql()

_FORMAL = ["score", "feat_a"]


def _scopes_sql() -> str:
    ics = []
    for c in EVENT_FIELDS:
        au = f"select t, case when n >= 5 and p > 0 and p < n then 2 * (s - p * (p + 1) / 2) / (p * (n - p)) - 1 end as gini from (select t, count(*) as n, sum(y) as p, sum(k * y) as s from (select t, y, cast(row_number() over (partition by t order by {c}, code) as double) as k from e where {c} is not null and y is not null) group by t)"
        ics.append(f"select '{c}' as factor, ic_mean, icir, (select avg(gini) from ({EVENT_SQL} {au})) as gini from (select avg(ic) as ic_mean, avg(ic) / stddev_samp(ic) as icir from ({ic_sql(c, 'y')} select ic from i))")
    lv = "case when abs({0}) > q.{0}_999 then 3 when abs({0}) > q.{0}_99 then 2 when abs({0}) > q.{0}_95 then 1 else 0 end"
    quant = ", ".join(f"quantile_cont({c}, {v}) as {c}_{n}" for c in ("ic_mean", "icir", "gini") for v, n in ((0.95, "95"), (0.99, "99"), (0.999, "999")))
    return f"""with mt as ({' union all '.join(ics)}), q as (select {quant} from ({_null_sql()} select * from nl)), lv as (select factor, ic_mean, icir, mt.gini, least({', '.join(lv.format(c) for c in ('ic_mean', 'icir', 'gini'))}) as level from mt, q)
select factor, round(ic_mean, 6) + 0.0 as ic_mean, round(icir, 6) + 0.0 as icir, round(gini, 6) + 0.0 as gini, cast(level as int) as level, level >= 2 and factor in ('score', 'feat_a') as eligible from lv""".replace("abs(ic_mean)", "abs(mt.ic_mean)").replace("abs(icir)", "abs(mt.icir)").replace("abs(gini)", "abs(mt.gini)")


@query(_scopes_sql())
def placebo_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All factors graded by the thresholds of the formal ones (the test-size null of ten shuffles, which has SQL); the
    others are graded but never eligible."""
    metrics = a.factor_metrics(event_table(spark, sf_dir), list(EVENT_FIELDS), "y")
    return rounded(a.grade(metrics, a.null_quantiles(_null(spark, sf_dir)), _FORMAL), ["factor", "level", "eligible"])
