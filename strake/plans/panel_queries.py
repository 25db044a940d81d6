"""Queries over the bar panel and the event table, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ops as o
from ..functions.base_fields import base_fields
from ..functions.expr import compile_text, parse
from ..operators import metrics as m
from ..operators import portfolio as p
from ..sources.panel import EVENT_FIELDS, EVENT_SQL, PANEL_SQL, bar_panel, densify, event_table
from ..sources.panel import bars as panel_bar_rows
from ..sources.panel import calendar as session_calendar

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
FRAMES = "window wt as (partition by code order by t), wx as (partition by t), " + ", ".join(f"w{d} as (partition by code order by t rows {d - 1} preceding)" for d in (2, 5, 10, 20, 60))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, keep: list[str], digits: int = 6) -> DataFrame:
    """keep as they are, the other columns rounded; -0.0 becomes 0.0."""
    return df.select(*keep, *[(F.round(F.col(c).cast("double"), digits) + 0.0).alias(c) for c in df.columns if c not in keep])


def r6(sql: str, name: str, digits: int = 6) -> str:
    return f"round(cast({sql} as double), {digits}) + 0.0 as {name}"


def _panel_query(name: str, build, sql: str, digits: int = 6) -> None:
    fields = tuple(n.name for n in parse(build).walk() if not n.args) if isinstance(build, str) else ("turnover", "close")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        x = bar_panel(spark, sf_dir, fields=fields)
        v = compile_text(build, x.columns) if isinstance(build, str) else build()
        return rounded(x.select("trade_date", "code", v.alias("value")), ["trade_date", "code"], digits)

    run.__name__ = run.__qualname__ = name
    run.__doc__ = f"{build if isinstance(build, str) else name} on the bar panel."
    QUERIES[name] = run
    ORACLE[name] = f"{PANEL_SQL} select trade_date, code, {r6(sql, 'value', digits)} from panel {FRAMES}"


def guard(x: str, d: int, e: str) -> str:
    return f"case when count({x}) over w{d} = {d} then {e} end"


def pdiv(x: str, y: str) -> str:
    return f"case when abs({y}) >= 1e-9 then ({x}) / ({y}) end"


_RANK = "row_number() over (partition by t order by {0} nulls last, code)"
_LAG5 = "lag(close, 5) over wt"
_PX, _PY = "case when turnover is not null then pct_chg end", "case when pct_chg is not null then turnover end"
_OPS: list[tuple] = [
    ("op_delay", "ts_delay(close, 5)", _LAG5),
    ("op_delta", "ts_delta(close, 5)", f"close - {_LAG5}"),
    ("op_pct", "ts_pct(close, 5)", pdiv(f"close - {_LAG5}", f"abs({_LAG5})")),
    ("op_mean", "ts_mean(turnover, 5)", guard("turnover", 5, "avg(turnover) over w5")),
    ("op_sum", "ts_sum(turnover, 10)", guard("turnover", 10, "sum(turnover) over w10")),
    ("op_std", "ts_std(pct_chg, 20)", guard("pct_chg", 20, "stddev_samp(pct_chg) over w20")),
    ("op_max", "ts_max(close_h, 20)", guard("close_h", 20, "max(close_h) over w20")),
    ("op_min", "ts_min(close_h, 20)", guard("close_h", 20, "min(close_h) over w20")),
    ("op_rank_ts", "ts_rank(turnover, 10)", guard("turnover", 10, "(len(list_filter(list(turnover) over w10, lambda v: v < turnover)) + (len(list_filter(list(turnover) over w10, lambda v: v = turnover)) + 1) / 2.0) / 10")),
    ("op_argmax", "ts_argmax(close, 10)", guard("close", 10, "(t - arg_max(t, (close, -t)) over w10) / 9.0")),
    ("op_argmin", "ts_argmin(close, 10)", guard("close", 10, "(t - arg_min(t, (close, t)) over w10) / 9.0")),
    ("op_zscore_ts", "ts_zscore(turnover, 20)", guard("turnover", 20, pdiv("turnover - avg(turnover) over w20", "stddev_samp(turnover) over w20"))),
    ("op_cov", "ts_cov(pct_chg, turnover, 10)", guard(_PX, 10, f"covar_samp({_PX}, {_PY}) over w10"), 9),
    ("op_corr", "ts_corr(pct_chg, turnover, 10)", guard(_PX, 10, f"case when stddev_samp({_PX}) over w10 > 1e-9 and stddev_samp({_PY}) over w10 > 1e-9 then covar_samp({_PX}, {_PY}) over w10 / (stddev_samp({_PX}) over w10 * stddev_samp({_PY}) over w10) end")),
    ("op_decay", "ts_decay(pct_chg, 5)", guard("pct_chg", 5, "list_sum(list_transform(list(pct_chg) over w5, lambda v, i: v * i)) / 15.0")),
    ("op_cs_rank", "cs_rank(turnover)", f"case when turnover is not null then {_RANK.format('turnover')} / count(turnover) over wx end"),
    ("op_cs_rank_ordinal", lambda: o.cs_rank_ordinal(F.col("turnover")), f"case when turnover is not null then {_RANK.format('turnover')} else 0 end"),
    ("op_pct_rank", lambda: o.cs_pct_rank(F.col("close")), "case when close is not null then (rank() over (partition by t order by close nulls last) + (count(close) over (partition by t, close) - 1) / 2.0) / count(close) over wx end"),
    ("op_cs_zscore", "cs_zscore(turnover)", "case when stddev_pop(turnover) over wx >= 1e-9 then (turnover - avg(turnover) over wx) / stddev_pop(turnover) over wx end"),
    ("op_cs_zscore_sample", lambda: o.cs_zscore(F.col("turnover"), 1), "case when turnover is null then null when stddev_samp(turnover) over wx > 0 then (turnover - avg(turnover) over wx) / stddev_samp(turnover) over wx else 0 end"),
    ("op_cs_demean", "cs_demean(pct_chg)", "pct_chg - avg(pct_chg) over wx", 9),
    ("op_clip_sigma", lambda: o.clip_sigma(F.col("turnover"), 1.0), "case when turnover is not null then least(greatest(turnover, avg(turnover) over wx - stddev_pop(turnover) over wx), avg(turnover) over wx + stddev_pop(turnover) over wx) end"),
    ("op_robust_z", lambda: o.robust_z(F.col("turnover")), None),
    ("op_quantile_bin", lambda: o.quantile_bin(F.col("turnover")), f"case when turnover is not null and count(turnover) over wx > 1 then greatest(1, (5 * ({_RANK.format('turnover')} - 1) + count(turnover) over wx - 2) // (count(turnover) over wx - 1)) end"),
    ("op_arithmetic", "sub(add(open, close), mul(high, low))", "open + close - high * low"),
    ("op_protected_div", "div(amount, pct_chg)", pdiv("amount", "pct_chg"), 4),
    ("op_neg_abs_sign", "add(neg(pct_chg), mul(abs(pct_chg), sign(pct_chg)))", "-pct_chg + abs(pct_chg) * sign(pct_chg)"),
    ("op_log_sqrt", "add(log(pct_chg), sqrt(pct_chg))", "sign(pct_chg) * ln(1 + abs(pct_chg)) + sign(pct_chg) * sqrt(abs(pct_chg))"),
]
for _n, _b, _s, *_d in _OPS:
    if _s is None:
        _s = "case when scale > 1e-12 then (turnover - med) / scale end"
        _panel_query(_n, _b, "0")
        ORACLE[_n] = PANEL_SQL + ", a as (select *, median(turnover) over (partition by t) as med from panel), b as (select *, 1.4826 * median(abs(turnover - med)) over (partition by t) as scale from a) select trade_date, code, " + r6(_s, "value") + " from b"
    else:
        _panel_query(_n, _b, _s, *(_d or [6]))


# nested expressions


def _nested(name: str, text: str, inner: str, outer: str) -> None:
    _panel_query(name, text, "0")
    ORACLE[name] = f"{PANEL_SQL}, x as (select *, {inner} as i from panel {FRAMES}) select trade_date, code, {r6(outer, 'value')} from x {FRAMES}"


_nested("expr_rank_of_mean", "cs_rank(ts_sum(vol, 5))", guard("vol", 5, "sum(vol) over w5"), f"case when i is not null then {_RANK.format('i')} / count(i) over wx end")
_nested("expr_mean_of_rank", "ts_mean(cs_rank(turnover), 5)", f"case when turnover is not null then {_RANK.format('turnover')} / count(turnover) over wx end", guard("i", 5, "avg(i) over w5"))
_nested("expr_ratio_to_mean", "log(div(close_h, ts_mean(close_h, 20)))", guard("close_h", 20, pdiv("close_h", "avg(close_h) over w20")), "sign(i) * ln(1 + abs(i))")
_nested("expr_zscore_of_delta", "cs_zscore(ts_delta(close, 5))", f"close - {_LAG5}", "case when stddev_pop(i) over wx >= 1e-9 then (i - avg(i) over wx) / stddev_pop(i) over wx end")


# sources and shapes


@query(PANEL_SQL + "select trade_date, code, " + ", ".join(r6(c, c) for c in ("open", "high", "low", "close", "vol", "turnover")) + " from bars")
def panel_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bar a code and session, the latest delivery."""
    return rounded(panel_bar_rows(spark, sf_dir).select("trade_date", "code", "open", "high", "low", "close", "vol", "turnover"), ["trade_date", "code"])


@query(PANEL_SQL + "select t, count(*) as cells, count(close) as filled, cast(sum(case when is_trading then 1 else 0 end) as bigint) as trading from panel group by t")
def panel_densify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the dense panel per date: all, with a bar, trading."""
    x = densify(panel_bar_rows(spark, sf_dir, ("close", "vol")), session_calendar(spark, sf_dir))
    return x.groupBy("t").agg(F.count(F.lit(1)).alias("cells"), F.count("close").alias("filled"), F.count_if(F.col("close").isNotNull() & (F.coalesce("vol", F.lit(0.0)) > 0)).alias("trading"))


@query(PANEL_SQL + "select trade_date, code, " + r6("adj", "adj") + ", " + r6("close_h", "close_h") + " from panel")
def panel_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices times the factor in force."""
    return rounded(bar_panel(spark, sf_dir, fields=("adj", "close_h")).select("trade_date", "code", "adj", "close_h"), ["trade_date", "code"])


_FIELDS_SQL = f"""{PANEL_SQL},
a as (select *, lag(close_h) over wt as prev, round_even(pre_close * 110, 0) / 100 as lim, case when amount is not null then greatest(amount, 1e-9) end as amt from panel {FRAMES}),
b as (select *, {pdiv('close_h', 'prev')} - 1 as ret1, {pdiv('open_h', 'prev')} - 1 as gap, ln(amt) as la, case when coalesce(close >= lim - 0.001, false) then 1.0 else 0.0 end as at_lim from a),
c as (select *, {pdiv('abs(ret1)', 'amt')} as illiq from b),
"""


def _field_query(name: str, fields: dict[str, str], digits: int = 9) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        x = bar_panel(spark, sf_dir, fields=("open_h", "high_h", "low_h", "close_h", "pre_close", "close", "amount", "turnover"))
        f = base_fields(x.columns, F.rint(F.col("pre_close") * 110) / 100)
        return rounded(x.select("trade_date", "code", *[f[n].alias(n) for n in fields]), ["trade_date", "code"], digits)

    run.__name__ = run.__qualname__ = name
    run.__doc__ = f"Base fields {', '.join(fields)}."
    QUERIES[name] = run
    ORACLE[name] = _FIELDS_SQL + f"f as (select trade_date, code, {', '.join(f'{s} as {n}' for n, s in fields.items())} from c {FRAMES}) select trade_date, code, {', '.join(r6(n, n, digits) for n in fields)} from f"


_field_query("base_fields_returns", {"ret1": "ret1", "ret5": pdiv("close_h", "lag(close_h, 5) over wt") + " - 1", "ret20": pdiv("close_h", "lag(close_h, 20) over wt") + " - 1", "gap": "gap", "intraday": pdiv("close_h", "open_h") + " - 1"})
_field_query("base_fields_shape", {"hl_range": pdiv("high_h - low_h", "prev"), "close_pos": pdiv("close_h - low_h", "high_h - low_h"), "upper_shadow": pdiv("high_h - case when open_h is not null and close_h is not null then greatest(open_h, close_h) end", "prev"), "lower_shadow": pdiv("case when open_h is not null and close_h is not null then least(open_h, close_h) end - low_h", "prev")})
_field_query("base_fields_trend", {f"ma_dev{d}": guard("close_h", d, pdiv("close_h", f"avg(close_h) over w{d}") + " - 1") for d in (5, 20, 60)} | {"rsv20": f"case when count(low_h) over w20 = 20 and count(high_h) over w20 = 20 then {pdiv('close_h - min(low_h) over w20', 'max(high_h) over w20 - min(low_h) over w20')} end"})
_field_query("base_fields_risk", {"vola20": guard("ret1", 20, "stddev_samp(ret1) over w20"), "max_ret20": guard("ret1", 20, "max(ret1) over w20"), "open_gap_mean5": guard("gap", 5, "avg(gap) over w5"), "oc_corr20": guard("case when close_h is not null then open_h end", 20, "case when stddev_samp(open_h) over w20 > 1e-9 and stddev_samp(close_h) over w20 > 1e-9 then covar_samp(open_h, close_h) over w20 / (stddev_samp(open_h) over w20 * stddev_samp(close_h) over w20) end")})
_field_query("base_fields_liquidity", {"log_amount": "la", "amount_z20": guard("la", 20, pdiv("la - avg(la) over w20", "stddev_samp(la) over w20")), "amihud20": guard("illiq", 20, "avg(illiq) over w20 * 1e6"), "turnover_z20": guard("turnover", 20, pdiv("turnover - avg(turnover) over w20", "stddev_samp(turnover) over w20")), "to_up_limit": pdiv("lim - close", "close"), "limitup_cnt20": guard("at_lim", 20, "sum(at_lim) over w20")})


# metrics on the event table

_IC_SQL = EVENT_SQL + """, j as (select t, code, <x> as x, <y> as y from e where <x> is not null and <y> is not null),
r as (select t, cast(row_number() over (partition by t order by x, code) as double) as a, cast(row_number() over (partition by t order by y, code) as double) as b from j),
s as (select t, count(*) as n, sum(a * b) - sum(a) * sum(b) / count(*) as c, sum(a * a) - sum(a) * sum(a) / count(*) as va, sum(b * b) - sum(b) * sum(b) / count(*) as vb from r group by t),
i as (select d.t, case when n >= 5 and va > 1e-12 and vb > 1e-12 then c / sqrt(va * vb) end as ic, coalesce(n, 0) as n from (select distinct t from e) d left join s using (t))
"""


def ic_sql(x: str, y: str) -> str:
    return _IC_SQL.replace("<x>", x).replace("<y>", y)


@query(ic_sql("feat_a", "ret") + "select t, round(ic, 6) + 0.0 as ic, n from i")
def daily_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank IC of a feature and the later return, per date."""
    return rounded(m.daily_ic(event_table(spark, sf_dir, "feat_a", "ret"), "feat_a", "ret"), ["t", "n"])


@query(EVENT_SQL + "select t, round(case when count(ret) filter (where feat_a is not null) >= 5 and not isnan(corr(feat_a, ret)) then corr(feat_a, ret) end, 6) + 0.0 as ic from e group by t")
def daily_ic_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pearson IC per date."""
    return rounded(m.daily_ic(event_table(spark, sf_dir, "feat_a", "ret"), "feat_a", "ret", method="pearson").select("t", "ic"), ["t"])


_IC_SUMMARY = "avg(ic) as ic_mean, stddev_samp(ic) as ic_std, avg(ic) / stddev_samp(ic) as icir, avg(ic) / stddev_samp(ic) * sqrt(252) as icir_ann, avg(ic) / stddev_samp(ic) * sqrt(count(ic)) as t_stat, avg(case when ic > 0 then 1.0 when ic <= 0 then 0.0 end) as positive_rate, count(ic) as n_days, count(ic) / count(*) as coverage"
_IC_OUT = ", ".join(r6(c, c) for c in ("ic_mean", "ic_std", "icir", "icir_ann", "t_stat", "positive_rate", "coverage")) + ", n_days"


@query(ic_sql("feat_b", "ret") + f", z as (select {_IC_SUMMARY} from i) select {_IC_OUT} from z")
def ic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, information ratio, t and share of positive dates of an IC series."""
    return rounded(m.summarize_ic(m.daily_ic(event_table(spark, sf_dir, "feat_b", "ret"), "feat_b", "ret")), ["n_days"])


@query("select * from (" + ic_sql("score", "y") + f", z as (select 'y' as target, {_IC_SUMMARY} from i) select target, {_IC_OUT} from z) union all select * from (" + ic_sql("score", "ret") + f", z as (select 'ret' as target, {_IC_SUMMARY} from i) select target, {_IC_OUT} from z)")
def ic_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IC summaries of the score against several outcomes."""
    return rounded(m.ic_report(event_table(spark, sf_dir, "score", "y", "ret"), "score", ["y", "ret"]), ["target", "n_days"])


_AUC_SQL = EVENT_SQL + """, r as (select t, y, cast(row_number() over (partition by t order by score, code) as double) as k from e where score is not null and y is not null),
g as (select t, count(*) as n, sum(y) as p, sum(k * y) as s from r group by t),
a as (select d.t, case when n >= 5 and p > 0 and p < n then (s - p * (p + 1) / 2) / (p * (n - p)) end as auc from (select distinct t from e) d left join g using (t))
"""


@query(_AUC_SQL + "select t, round(auc, 6) + 0.0 as auc, round(2 * auc - 1, 6) + 0.0 as gini from a")
def daily_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC and gini of the score per date."""
    return rounded(m.daily_auc(event_table(spark, sf_dir, "score", "y"), "score").withColumn("gini", 2 * F.col("auc") - 1), ["t"])


_DAILY_SUMMARY = "select round(avg(v), 6) + 0.0 as mean, round(stddev_samp(v), 6) + 0.0 as std, round(avg(v) / stddev_samp(v), 6) + 0.0 as ir, count(v) as n_days, round(count(v) / count(*), 6) + 0.0 as coverage from (select 2 * auc - 1 as v from a)"


@query(_AUC_SQL + _DAILY_SUMMARY)
def gini_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean gini over dates."""
    return rounded(m.summarize_daily(m.daily_gini(event_table(spark, sf_dir, "score", "y"), "score"), "gini"), ["n_days"])


def ranked_sql(score: str = "score", where: str = "true") -> str:
    return EVENT_SQL + f", k as (select *, case when {score} is not null then row_number() over (partition by t order by {score} desc nulls last, code) end as rank from e where {where})"


@query(ranked_sql() + "select t, round(case when count(y) filter (where rank <= 10) = 10 then avg(y) filter (where rank <= 10) end, 6) + 0.0 as precision, round(avg(y), 6) + 0.0 as base from k group by t")
def precision_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of hits among the ten best-scored names, and the base rate, per date."""
    return rounded(m.precision_at_k(event_table(spark, sf_dir, "score", "y"), "score", 10), ["t"])


@query(ranked_sql() + ", q as (select case when count(y) filter (where rank <= 10) = 10 then avg(y) filter (where rank <= 10) end as p, avg(y) as b from k group by t) select round(avg(p / b) filter (where b > 0), 6) + 0.0 as lift, count(*) filter (where p is not null and b > 0) as n_days from q")
def lift_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean lift of the ten best-scored names."""
    return rounded(m.lift_at_k(event_table(spark, sf_dir, "score", "y"), "score", 10), ["n_days"])


@query(ranked_sql() + ", q as (select count(score) as n, sum(coalesce(y, 0)) filter (where rank <= 10) as h, sum(y) as s, count(y) as c from k group by t) select round(sum(h) filter (where n >= 10) / (10 * count(*) filter (where n >= 10)), 6) + 0.0 as hit_rate, round(sum(s) / sum(c), 6) + 0.0 as base_rate, round(sum(h) filter (where n >= 10) / (10 * count(*) filter (where n >= 10)) / (sum(s) / sum(c)), 6) + 0.0 as lift, round(avg(case when n >= 10 then 1.0 else 0.0 end), 6) + 0.0 as coverage from q")
def top_k_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit rate with unobserved outcomes as misses, pooled base rate."""
    return rounded(m.top_k_hit(event_table(spark, sf_dir, "score", "y"), "score", 10), [])


_FACTORS = list(EVENT_FIELDS)


def _corr_sql() -> str:
    ranks = ", ".join(f"case when {c} is not null then row_number() over (partition by t order by {c} nulls last, code) / count({c}) over (partition by t) end as r_{c}" for c in _FACTORS)
    pairs = [(a, b) for i, a in enumerate(_FACTORS) for b in _FACTORS[i + 1 :]]
    return EVENT_SQL + f", r as (select {ranks} from e) " + " union all ".join(f"select '{a}' as a, '{b}' as b, round(corr(r_{a}, r_{b}), 6) + 0.0 as corr from r" for a, b in pairs)


@query(_corr_sql())
def factor_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of the daily ranks of every pair of factors."""
    return rounded(m.factor_correlation(event_table(spark, sf_dir), _FACTORS), ["a", "b"])


def _screen_sql() -> str:
    parts = [f"select '{c}' as feature, round(ic_mean, 6) + 0.0 as ic_mean, round(abs(ic_mean), 6) + 0.0 as abs_ic, round((select count({c}) / count(*) from e), 6) + 0.0 as coverage from (select avg(ic) as ic_mean from i)" for c in EVENT_FIELDS]
    return " union all ".join(f"select * from ({ic_sql(c, 'ret')} {s})" for c, s in zip(EVENT_FIELDS, parts))


@query(_screen_sql())
def feature_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Univariate IC of every feature."""
    return rounded(m.screen_features(event_table(spark, sf_dir), list(EVENT_FIELDS), "ret"), ["feature"])


@query()
def feature_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy choice among the screened features by |IC| and mutual correlation; a row a feature kept."""
    e = event_table(spark, sf_dir)
    scores = [(r.feature, r.ic_mean) for r in m.screen_features(e, list(EVENT_FIELDS), "ret").collect()]  # a row a feature
    corr = {(r.a, r.b): r["corr"] for r in m.factor_correlation(e, list(EVENT_FIELDS)).collect()}
    kept = m.select_features(scores, corr, 4, floor=0.0)
    return spark.createDataFrame([(k, c) for k, c in enumerate(kept)], "position int, feature string")


_Q_SQL = EVENT_SQL + """, b as (select t, code, score, y, ret, greatest(1, (5 * (row_number() over (partition by t order by score, code) - 1) + count(*) over (partition by t) - 2) // (count(*) over (partition by t) - 1)) as bin, count(*) over (partition by t) as n from e where score is not null),
q as (select bin, count(*) as n, count(distinct t) as n_dates, count(y) as n_y, avg(y) as mean_y, count(ret) as n_ret, avg(ret) as mean_ret from b where n > 1 group by bin)
"""


@query(_Q_SQL + "select cast(bin as int) as bin, n, n_dates, n_y, n_ret, round(mean_y, 6) + 0.0 as mean_y, round(mean_ret, 6) + 0.0 as mean_ret from q")
def quintiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes by quintile of each date's scores."""
    return rounded(m.quantile_table(event_table(spark, sf_dir, "score", "y", "ret"), "score", ["y", "ret"]), ["bin", "n", "n_dates", "n_y", "n_ret"])


@query(_Q_SQL + ", r as (select bin, mean_ret, row_number() over (order by mean_ret, bin) as k from q) select round(max(mean_ret) filter (where bin = 5) - max(mean_ret) filter (where bin = 1), 6) + 0.0 as spread, round(corr(bin, k), 6) + 0.0 as rank_corr from r")
def quintile_monotonicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread and order of the quintiles' mean returns."""
    return rounded(m.quantile_monotonicity(m.quantile_table(event_table(spark, sf_dir, "score", "ret"), "score", ["ret"]), "mean_ret"), [])


# portfolios

_K = 4
_PORT = ranked_sql() + f", d as (select t, case when count(rank) >= {_K} then coalesce(sum(ret) filter (where rank <= {_K}), 0) / {_K} / 2 end as v, case when count(rank) >= {_K} then count(ret) filter (where rank <= {_K}) else 0 end as executed from k group by t)"


@query(_PORT + "select t, round(v, 8) + 0.0 as portfolio_return, executed from d")
def topk_portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily return of the four best-scored names, held two days."""
    return rounded(p.top_k_portfolio(event_table(spark, sf_dir, "score", "ret"), "score", "ret", _K, 2), ["t", "executed"], 8)


@query(_PORT + f"select round(avg(v), 8) + 0.0 as mean, round(stddev_samp(v), 8) + 0.0 as std, round(avg(v) / stddev_samp(v), 8) + 0.0 as ir, round(avg(case when v > 0 then 1.0 when v <= 0 then 0.0 end), 8) + 0.0 as positive_rate, round(sum(executed) filter (where v is not null) / (count(v) * {_K}), 8) + 0.0 as execution_rate, round(count(v) / count(*), 8) + 0.0 as coverage, count(v) as n_days from d")
def objective_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, information ratio, execution and coverage of the portfolio."""
    return rounded(p.summarize_objective(p.top_k_portfolio(event_table(spark, sf_dir, "score", "ret"), "score", "ret", _K, 2), _K), ["n_days"], 8)


_NET = "((1 + ret) * (1 - 0.0011) / (1 + 0.0006) - 1)"
_BT = ranked_sql() + f""", d as (select t, count(rank) as n_available, count(ret) filter (where rank <= {_K}) as n_executed, avg(y) filter (where rank <= {_K} and ret is not null) as hit_rate, avg(y) filter (where rank is not null) as base_rate,
  avg(ret) filter (where rank <= {_K}) as gross_return, avg({_NET}) filter (where rank <= {_K}) as net_return, coalesce(sum({_NET}) filter (where rank <= {_K}), 0) / {_K} / 2 as portfolio_return from k group by t having count(rank) >= {_K})"""


def _book(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.backtest(event_table(spark, sf_dir, "score", "ret", "y"), "score", "ret", "y", _K, 0.0006, 0.0011, 2)


@query(_BT + "select t, n_available, n_executed, " + ", ".join(r6(c, c, 8) for c in ("hit_rate", "base_rate", "gross_return", "net_return", "portfolio_return")) + " from d")
def backtest_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily book of the four best-scored names, net of costs."""
    return rounded(_book(spark, sf_dir), ["t", "n_available", "n_executed"], 8)


@query(_BT + f"""select count(*) as n_days, round(avg(n_executed), 6) + 0.0 as avg_executed, round(sum(n_executed) / (count(*) * {_K}), 6) + 0.0 as fill_rate, round(avg(hit_rate), 6) + 0.0 as hit_rate, round(avg(base_rate), 6) + 0.0 as base_rate,
round(avg(hit_rate) / avg(base_rate), 6) + 0.0 as lift, round(sum(net_return * n_executed) / sum(n_executed), 6) + 0.0 as mean_trade_return_net, round(avg(portfolio_return) * 252, 6) + 0.0 as ann_return, round(stddev_samp(portfolio_return) * sqrt(252), 6) + 0.0 as ann_vol, round(avg(portfolio_return) / stddev_samp(portfolio_return) * sqrt(252), 6) + 0.0 as sharpe from d""")
def backtest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The book's summary."""
    return rounded(p.summarize_backtest(_book(spark, sf_dir), _K), ["n_days"])


_EQ = _BT + """, c as (select t, portfolio_return, exp(sum(ln(1 + portfolio_return)) over (order by t)) as equity from d),
q as (select *, max(equity) over (order by t) as peak from c)"""


@query(_EQ + "select t, round(portfolio_return, 8) + 0.0 as portfolio_return, round(equity, 8) + 0.0 as equity, round(equity / peak - 1, 8) + 0.0 as drawdown, round(equity / greatest(peak, 1.0) - 1, 8) + 0.0 as drawdown_start from q")
def drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equity and both drawdowns."""
    return rounded(p.equity_curve(_book(spark, sf_dir)), ["t"], 8)


_RUNS = _EQ + """, n as (select t, row_number() over (order by t) as i, portfolio_return < 0 as loss from d), g as (select t, i - row_number() over (partition by loss order by t) as g, loss from n),
runs as (select min(t) as first_t, max(t) as last_t, count(*) as days from g where loss group by g)"""


@query(_RUNS + "select * from runs")
def loss_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of losing dates."""
    return p.loss_streaks(_book(spark, sf_dir))


@query(_RUNS + """select round(pow(arg_max(equity, t), 252.0 / count(*)) - 1, 6) + 0.0 as cagr, round(avg(case when portfolio_return > 0 then 1.0 else 0.0 end), 6) + 0.0 as day_win_rate, round(avg(portfolio_return) filter (where portfolio_return > 0) / abs(avg(portfolio_return) filter (where portfolio_return < 0)), 6) + 0.0 as profit_loss_ratio,
round(avg(portfolio_return) * 252, 6) + 0.0 as ann_return, round(stddev_samp(portfolio_return) * sqrt(252), 6) + 0.0 as ann_vol, round(avg(portfolio_return) / stddev_samp(portfolio_return) * sqrt(252), 6) + 0.0 as sharpe, round(least(min(equity / greatest(peak, 1.0) - 1), 0), 6) + 0.0 as max_drawdown, round(arg_max(equity, t), 6) + 0.0 as final_equity, (select max(days) from runs) as max_consecutive_losses from q""")
def performance_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Performance of the book's return series."""
    return rounded(p.performance(_book(spark, sf_dir)), ["max_consecutive_losses"])


@query(_BT + """, n as (select t, portfolio_return as r, row_number() over (order by t) as i from d), s1 as (select a.i, min(a.t) as start_t, b.i as j, any_value(b.r) as r from n a join n b on b.i between a.i and a.i + 19 group by a.i, b.i),
s2 as (select i, start_t, j, r, exp(sum(ln(1 + r)) over (partition by i order by j)) as eq from s1), s3 as (select *, greatest(1.0, max(eq) over (partition by i order by j)) as peak from s2)
select min(start_t) as start_t, round(arg_max(eq, j) - 1, 8) + 0.0 as compounded, round(avg(case when r > 0 then 1.0 else 0.0 end), 8) + 0.0 as positive_rate, round(min(eq / peak - 1), 8) + 0.0 as max_drawdown from s3 group by i having count(*) = 20""")
def rolling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run of 20 dates: compounded return, share of positive dates, worst drawdown."""
    return rounded(p.rolling_windows(_book(spark, sf_dir), 20), ["start_t"], 8)


@query(ranked_sql() + f", s as (select t, list(code) as s from k where rank <= {_K} group by t) select t, case when lag(s) over (order by t) is not null then round(1 - len(list_intersect(s, lag(s) over (order by t))) / {_K}, 6) + 0.0 end as turnover from s")
def selection_turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of picks that are new, per date."""
    return rounded(p.turnover(event_table(spark, sf_dir, "score"), "score", _K), ["t"])


@query(ranked_sql() + ", a as (select *, rank is not null and rank <= 20 and feat_a is not null as ok from k), b as (select *, case when ok then row_number() over (partition by t, ok order by rank) end as place from a) select t, count(*) filter (where place <= 4) as held, cast(max(rank) filter (where place <= 4) as int) as depth, round(coalesce(sum(ret) filter (where place <= 4), 0) / 4, 8) + 0.0 as portfolio_return from b group by t")
def event_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walk down a shortlist of twenty to four names that can be filled."""
    e = event_table(spark, sf_dir, "score", "ret", "feat_a").withColumn("fillable", F.col("feat_a").isNotNull())
    return rounded(p.event_book(e, "score", "ret", "fillable", 20, 4), ["t", "held", "depth"], 8)
