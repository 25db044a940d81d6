"""The training-data queries over the equity tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import checkpoint, day_number, day_text, finite, micros, norm_code, plain_date, table
from ..operators.bitemporal import known_at
from ..operators.grid import regular_grid
from ..operators.orphans import find_orphans
from ..operators.profile import profile
from ..operators.topn import top_n
from ..operators.trailing import apply_corrections, build_trees, query_trees, trailing_totals

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def sessions_of(spark: SparkSession, sf_dir: str) -> list[str]:
    """Open days of the calendar, which has one row a day whatever the size of the data."""
    return [r[0] for r in table(spark, sf_dir, "trade_cal").where("is_open = 1").select("cal_date").distinct().orderBy("cal_date").collect()]


# 1. attributes as known at event time


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "event_rows").where("event_time is not null").select("event_id", "stock_code", "event_time")
    records = table(spark, sf_dir, "adj_factor").where("adj_factor > 0 and not isnan(adj_factor)")
    return known_at(events, records, key="stock_code", time="event_time", version_key="ts_code", valid_from="trade_date", recorded="as_of_time", version_id="adj_id", payload=["adj_factor"])


@query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose factor as known then isn't the one known with hindsight."""
    return _known(spark, sf_dir).where("revised").groupBy("event_id").agg(F.max("known_id").alias("adj_id"))


@query
def p1_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per month of the event: events with a factor, without one yet, with one later revised, and the mean factor."""
    k = _known(spark, sf_dir).groupBy("event_id").agg(F.max(F.struct("event_time", "known_id", "known.adj_factor", "revised")).alias("r"))
    return k.groupBy(F.date_format("r.event_time", "yyyyMM").alias("month")).agg(
        F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("r.known_id") >= 0).alias("n_known"), F.count_if(F.col("r.known_id") == -1).alias("n_unknown"),
        F.count_if("r.revised").alias("n_revised"), F.round(F.avg("r.adj_factor"), 6).alias("mean_factor"),
    )


_P1 = """
with e as (select distinct event_id, upper(trim(stock_code)) k, event_time t from event_rows where event_time is not null),
a as (select distinct adj_id, upper(trim(ts_code)) k, trade_date d, as_of_time r, adj_factor x from adj_factor where adj_factor > 0 and not isnan(adj_factor)),
j as (select e.event_id, e.t, arg_max(a.adj_id, (a.d, a.r, a.adj_id)) hind,
      arg_max(a.adj_id, (a.d, a.r, a.adj_id)) filter (where a.r <= e.t) rght, arg_max(a.x, (a.d, a.r, a.adj_id)) filter (where a.r <= e.t) x
      from e left join a on e.k = a.k and a.d <= strftime(e.t, '%Y%m%d') group by 1, 2)
"""
ORACLE["p1_found"] = _P1 + "select event_id, coalesce(rght, -1) as adj_id from j where rght is distinct from hind"
ORACLE["p1_known"] = _P1 + """
select strftime(t, '%Y%m') as month, count(*) as n_events, count(rght) as n_known, count(*) filter (where hind is not null and rght is null) as n_unknown,
count(*) filter (where rght is distinct from hind) as n_revised, round(avg(x), 6) as mean_factor from j group by 1"""


# 2. references to records that do not exist

_REFS = {  # table: row id, code, the time at which the code must exist
    "event_rows": ("event_id", "stock_code", "event_time"),
    "daily": ("bar_id", "ts_code", "loaded_at"),
    "adj_factor": ("adj_id", "ts_code", "as_of_time"),
    "price_reads": ("read_id", "ts_code", "read_time"),
    "namechange": ("name_id", "ts_code", None),
}


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, dated = None, None
    for name, (row, code, at) in _REFS.items():
        df = table(spark, sf_dir, name)
        time = micros(at) if at else F.lit(None).cast("bigint")
        one = df.select(F.lit(name).alias("src_table"), F.col(row).cast("bigint").alias("row_id"), norm_code(code).alias("ref"), time.alias("at"))
        refs = one if refs is None else refs.unionByName(one)
        if name in ("event_rows", "daily"):
            one = df.select(F.lit(name).alias("src_table"), F.col(row).cast("bigint").alias("row_id"), plain_date("trade_date").alias("ref"), time.alias("at"))
            dated = one if dated is None else dated.unionByName(one)
    codes = find_orphans(refs, table(spark, sf_dir, "stock_basic"), key=F.col("ref"), parent_key=norm_code("ts_code"), at=F.col("at"), alive_from=micros("loaded_at"), alive_to=micros("deleted_at"))
    days = find_orphans(dated, table(spark, sf_dir, "trade_cal").where("is_open = 1"), key=F.col("ref"), parent_key=F.col("cal_date"), fixed=True)
    code_field = F.when(F.col("src_table") == "event_rows", "stock_code").otherwise("ts_code")
    both = codes.withColumn("ref_field", code_field).unionByName(days.withColumn("ref_field", F.lit("trade_date")))
    return both.groupBy("src_table", "row_id", "ref_field").agg(F.min("at").alias("at"))


@query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose code or date refers to no record."""
    return _orphans(spark, sf_dir).select("src_table", "row_id", "ref_field")


@query
def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references per table, field and month of the row's time ('none' without one)."""
    month = F.coalesce(F.date_format(F.timestamp_micros("at"), "yyyyMM"), F.lit("none"))
    return _orphans(spark, sf_dir).groupBy("src_table", "ref_field", month.alias("month")).agg(F.count(F.lit(1)).alias("n_orphans"))


def _orphan_sql() -> str:
    parts = []
    for name, (row, code, at) in _REFS.items():
        field = "stock_code" if name == "event_rows" else "ts_code"
        t = f"x.{at}" if at else "cast(null as timestamp)"
        parts.append(f"select '{name}' as src_table, cast({row} as bigint) as row_id, '{field}' as ref_field, {t} as ts from {name} x where {code} is not null and case when {t} is null then not exists (select 1 from p where p.k = upper(trim(x.{code}))) else not exists (select 1 from p where p.k = upper(trim(x.{code})) and p.loaded_at <= {t} and (p.deleted_at is null or p.deleted_at > {t})) end")
        if name in ("event_rows", "daily"):
            parts.append(f"select '{name}', cast({row} as bigint), 'trade_date', {t} from {name} x where trade_date is not null and replace(trade_date, '-', '') not in (select cal_date from trade_cal where is_open = 1)")
    return "with p as (select upper(trim(ts_code)) k, loaded_at, deleted_at from stock_basic), o as (" + " union all ".join(parts) + "), d as (select src_table, row_id, ref_field, min(ts) as ts from o group by 1, 2, 3) "


ORACLE["p2_found"] = _orphan_sql() + "select src_table, row_id, ref_field from d"
ORACLE["p2_report"] = _orphan_sql() + "select src_table, ref_field, coalesce(strftime(ts, '%Y%m'), 'none') as month, count(*) as n_orphans from d group by 1, 2, 3"


# 3. rolling totals over trailing periods


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bar a code and session: the latest delivery."""
    cal = table(spark, sf_dir, "trade_cal").where("is_open = 1").select(F.col("cal_date").alias("trade_date")).distinct()
    bars = table(spark, sf_dir, "daily").join(F.broadcast(cal), "trade_date", "left_semi")  # the calendar has a fixed size
    return (
        bars.groupBy(norm_code("ts_code").alias("ts_code"), day_number("trade_date").alias("day"))
        .agg(F.max_by(F.struct("turnover_rate_f", "pct_chg"), F.struct("loaded_at", "bar_id")).alias("b"))
        .select("ts_code", "day", F.coalesce(finite("b.turnover_rate_f"), F.lit(0.0)).alias("turnover"), F.log1p(finite("b.pct_chg") / 100).alias("ret"), F.pow(F.log1p(finite("b.pct_chg") / 100), F.lit(2)).alias("ret2"))
    )


@query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days on which the last week has more than half of the last 30 days' turnover."""
    t = trailing_totals(_bars(spark, sf_dir), entity="ts_code", day="day", values=["turnover"], stats=("sum",))
    return t.where("age >= 29 and 2 * round(turnover_sum_7, 4) > round(turnover_sum_30, 4)").select("ts_code", day_text(F.col("day")).alias("trade_date"))


@query
def p3_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every code and calendar day: trailing turnover, logarithmic return and volatility over 7 and 30 days."""
    t = trailing_totals(_bars(spark, sf_dir), entity="ts_code", day="day", values=["turnover", "ret", "ret2"])
    cols = []
    for w in (7, 30):
        n, s, q = F.col(f"ret_count_{w}"), F.col(f"ret_sum_{w}"), F.col(f"ret2_sum_{w}")
        cols += [F.round(f"turnover_sum_{w}", 4).alias(f"turnover_{w}d"), F.round(f"turnover_mean_{w}", 9).alias(f"turnover_mean_{w}d"), F.col(f"turnover_count_{w}").alias(f"bars_{w}d"), F.round(F.coalesce(s, F.lit(0.0)), 8).alias(f"log_return_{w}d"), F.when(n > 1, F.round(F.sqrt(F.greatest((q - s * s / n) / (n - 1), F.lit(0.0))), 5)).alias(f"volatility_{w}d")]
    return t.select("ts_code", day_text(F.col("day")).alias("trade_date"), *cols)


@query
def p3_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailing turnover from stored trees: built from the first delivery of every bar, then corrected by the later ones."""
    cal = table(spark, sf_dir, "trade_cal").where("is_open = 1").select(F.col("cal_date").alias("trade_date")).distinct()
    order, x = F.struct("loaded_at", "bar_id"), finite("turnover_rate_f")
    bars = table(spark, sf_dir, "daily").where("ts_code is not null").join(F.broadcast(cal), "trade_date", "left_semi")  # the calendar has a fixed size
    both = bars.groupBy(norm_code("ts_code").alias("ts_code"), day_number("trade_date").alias("day")).agg(F.min_by(F.struct(x.alias("x")), order)["x"].alias("first"), F.max_by(F.struct(x.alias("x")), order)["x"].alias("last"))
    both = checkpoint(both)  # read for the trees, the corrections and the spans
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    late = both.where("not (first <=> last)").select("ts_code", "day", (zero("last") - zero("first")).alias("d_sum"), (F.col("last").isNotNull().cast("int") - F.col("first").isNotNull().cast("int")).alias("d_count"))
    trees = apply_corrections(build_trees(both, entity="ts_code", day="day", value="first"), late, entity="ts_code", day="day", d_sum="d_sum", d_count="d_count")
    span = both.groupBy(F.col("ts_code").alias("entity")).agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    days = query_trees(trees, (7, 30)).join(span, "entity").where("day between lo and hi")
    r = lambda c: (F.round(c, 4) + 0.0).alias(c.replace("total", "turnover") + "d")
    return days.select(F.col("entity").alias("ts_code"), day_text(F.col("day")).alias("trade_date"), r("total_7"), r("total_30"), F.col("n_7").alias("bars_7d"), F.col("n_30").alias("bars_30d"))


_P3 = """
with b as (select upper(trim(ts_code)) as c, trade_date, arg_max((turnover_rate_f, pct_chg), (loaded_at, bar_id)) as v from daily
  where trade_date in (select cal_date from trade_cal where is_open = 1) group by 1, 2),
d as (select c, cast(strptime(trade_date, '%Y%m%d') as date) as day, coalesce(v[1], 0.0) as x, ln(1 + v[2] / 100) as r from b),
g as (select c, unnest(generate_series(min(day), max(day), interval 1 day))::date as day from d group by c),
f as (select g.c, g.day, coalesce(x, 0.0) as x, x as x0, r, min(g.day) over (partition by g.c) as first from g left join d using (c, day))
"""
ORACLE["p3_found"] = _P3 + """, w as (select c, day, first, round(sum(x) over (partition by c order by day rows 6 preceding), 4) as s7, round(sum(x) over (partition by c order by day rows 29 preceding), 4) as s30 from f)
select c as ts_code, strftime(day, '%Y%m%d') as trade_date from w where day >= first + 29 and 2 * s7 > s30"""
ORACLE["p3_trailing"] = _P3 + "select c as ts_code, strftime(day, '%Y%m%d') as trade_date, " + ", ".join(
    f"round(sum(x) over w{w}, 4) as turnover_{w}d, round(avg(x0) over w{w}, 9) as turnover_mean_{w}d, count(x0) over w{w} as bars_{w}d, round(coalesce(sum(r) over w{w}, 0), 8) as log_return_{w}d, case when count(r) over w{w} > 1 then round(stddev_samp(r) over w{w}, 5) end as volatility_{w}d"
    for w in (7, 30)
) + " from f window w7 as (partition by c order by day rows 6 preceding), w30 as (partition by c order by day rows 29 preceding)"


ORACLE["p3_corrected"] = _P3.replace("coalesce(v[1], 0.0) as x", "v[1] as x") + "select c as ts_code, strftime(day, '%Y%m%d') as trade_date, " + ", ".join(
    f"round(sum(x) over w{w}, 4) + 0.0 as turnover_{w}d, count(x0) over w{w} as bars_{w}d" for w in (7, 30)
) + " from f window w7 as (partition by c order by day rows 6 preceding), w30 as (partition by c order by day rows 29 preceding)"


# 4. irregular readings onto a regular grid


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regular_grid(table(spark, sf_dir, "price_reads"), sessions_of(spark, sf_dir), source="ts_code", time="read_time", value="hfq_close", read_id="read_id")


@query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions without a usable reading, with the reading that fills them."""
    return _grid(spark, sf_dir).where("missing").select(F.col("source").alias("ts_code"), "trade_date", "read_id")


@query
def p4_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regular series: one filled value a code and session, marked where missing."""
    return _grid(spark, sf_dir).select(F.col("source").alias("ts_code"), "trade_date", "missing", "read_id", F.round("value", 6).alias("hfq_close"))


@query
def p4_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smoother's values with their uncertainty, marked where missing."""
    r = lambda c, n: (F.round(c, n) + 0.0).alias(c)
    return _grid(spark, sf_dir).select(F.col("source").alias("ts_code"), "trade_date", "missing", r("smoothed", 4), r("smoothed_sd", 6))


_P4 = """
with s as (select cal_date, row_number() over (order by cal_date) as i, cast(strptime(cal_date, '%Y%m%d') as timestamp) + interval 15 hour as close from trade_cal where is_open = 1),
u as (select distinct upper(trim(ts_code)) as c, read_id, read_time, hfq_close from price_reads where hfq_close > 0 and isfinite(hfq_close)),
b as (select u.*, s.i from u asof join s on u.read_time <= s.close),
l as (select c, i, arg_max((read_id, hfq_close), (read_time, read_id)) as r from b group by 1, 2),
g as (select c, unnest(generate_series(min(i), max(i))) as i from l group by c),
f as (select g.c, g.i, l.r is null as missing, last_value(l.r ignore nulls) over (partition by g.c order by g.i) as r from g left join l using (c, i))
"""
ORACLE["p4_found"] = _P4 + "select c as ts_code, cal_date as trade_date, r[1] as read_id from f join s using (i) where missing"
ORACLE["p4_series"] = _P4 + "select c as ts_code, cal_date as trade_date, missing, r[1] as read_id, round(r[2], 6) as hfq_close from f join s using (i)"


# Kalman filter and Rauch-Tung-Striebel smoother as two recursions over each code's readings and closes
_SMOOTHER = _P4.replace("with s as", "with recursive s as", 1) + """
, rd as (select b.c, b.i, ln(hfq_close) as y, epoch_us(read_time) as us, read_id from b where b.i is not null),
nb as (select c, y - lag(y) over w as d, (us - lag(us) over w) / 86400000000.0 as dt from rd window w as (partition by c order by us, read_id)),
qs as (select c, greatest(coalesce(avg(d * d / (0.9 * dt + 0.1)), 1e-4), 1e-10) as q from nb group by c),
st as (select c, us / 86400000000.0 as x, y, i, miss, row_number() over (partition by c order by us, y is null, read_id) as k from (
  select c, us, y, null as i, null as miss, read_id from rd union all select f.c, epoch_us(s.close), null, f.i, f.missing, null from f join s using (i)) z),
fw as (
  select st.c, k, x, i, miss, q, y as l, 0.0::double as v, (500 * q + 1) * 0.05 * q / (500 * q + 1 + 0.05 * q) as a, 0.0::double as b, 9 * q + 1e-12 as e, y as pl, 0.0::double as pv, 500 * q + 1 as pa, 0.0::double as pb, 9 * q + 1e-12 as pe from st join qs using (c) where k = 1
  union all
  select c, k, x, i, miss, q, case when y is null then pl else pl + pa / (pa + 0.05 * q) * (y - pl) end, case when y is null then pv else pv + pb / (pa + 0.05 * q) * (y - pl) end,
    case when y is null then pa else pa - pa / (pa + 0.05 * q) * pa end, case when y is null then pb else pb - pa / (pa + 0.05 * q) * pb end, case when y is null then pe else pe - pb / (pa + 0.05 * q) * pb end, pl, pv, pa, pb, pe
  from (select st.c, st.k, st.x, st.i, st.miss, q, y, l + (st.x - fw.x) * v as pl, v as pv, a + 2 * (st.x - fw.x) * b + (st.x - fw.x) ** 2 * e + 0.9 * q * (st.x - fw.x) + 1e-4 * q * (st.x - fw.x) ** 3 / 3 as pa,
    b + (st.x - fw.x) * e + 1e-4 * q * (st.x - fw.x) ** 2 / 2 as pb, e + 1e-4 * q * (st.x - fw.x) as pe from fw join st on st.c = fw.c and st.k = fw.k + 1) z),
bw as (
  select c, k, x, i, miss, l, v, a, b, e, pl, pv, pa, pb, pe from (select *, max(k) over (partition by c) as top from fw) z where k = top
  union all
  select c, k, x, i, miss, l + g00 * d0 + g01 * d1, v + g10 * d0 + g11 * d1, a + g00 * (g00 * da + g01 * db) + g01 * (g00 * db + g01 * de), b + g10 * (g00 * da + g01 * db) + g11 * (g00 * db + g01 * de), e + g10 * (g10 * da + g11 * db) + g11 * (g10 * db + g11 * de), pl, pv, pa, pb, pe
  from (select *, ((a + dt * b) * npe - b * npb) / det as g00, (b * npa - (a + dt * b) * npb) / det as g01, ((b + dt * e) * npe - e * npb) / det as g10, (e * npa - (b + dt * e) * npb) / det as g11
    from (select fw.c, fw.k, fw.x, fw.i, fw.miss, fw.l, fw.v, fw.a, fw.b, fw.e, fw.pl, fw.pv, fw.pa, fw.pb, fw.pe, bw.x - fw.x as dt, bw.l - bw.pl as d0, bw.v - bw.pv as d1, bw.a - bw.pa as da, bw.b - bw.pb as db, bw.e - bw.pe as de,
      bw.pa as npa, bw.pb as npb, bw.pe as npe, bw.pa * bw.pe - bw.pb * bw.pb as det from bw join fw on fw.c = bw.c and fw.k = bw.k - 1) z) z2)
select c as ts_code, cal_date as trade_date, miss as missing, round(exp(l), 4) + 0.0 as smoothed, round(sqrt(greatest(a, 0)), 6) + 0.0 as smoothed_sd from bw join s using (i) where bw.i is not null
"""
ORACLE["p4_smoothed"] = _SMOOTHER


# 5. column-level data quality profile

_NUMERIC = {"score": (0.0, 1.0), "feat_a": (-8.0, 8.0), "feat_b": (0.0, 60.0), "feat_c": (0.0, 1.0), "feat_d": (0.0, 30.0), "feat_e": (0.0, 100.0), "feat_f": (-40.0, 40.0), "label_hit": (0.0, 1.0)}
_PATTERNS = {"feature_source_date": "[0-9]{8}", "feature_adj_factor_version": "raw-times-same-day-adj-v1:[0-9a-f]{64}"}


def _profile(spark: SparkSession, sf_dir: str, distinct: bool) -> DataFrame:
    return profile(spark, f"{sf_dir}/event_rows.parquet", load="load_id", numeric=_NUMERIC, patterns=_PATTERNS, distinct=distinct)


@query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that went bad in a load."""
    p = _profile(spark, sf_dir, False)
    num = F.col("column_name").isin(list(_NUMERIC))
    issues = F.array(
        F.when(4 * (F.col("n_rows") - F.col("n_finite")) >= F.col("n_rows"), "nulls"),
        F.when(num & (F.col("n_finite") > 0) & (50 * (F.col("n_finite") - F.col("n_in")) >= F.col("n_finite")), "range"),
        F.when(num & (F.col("n_finite") >= 20) & (F.col("lo") == F.col("hi")), "constant"),
        F.when(num & (F.col("n_in") >= 20) & (F.col("prev_in") >= 20) & (F.abs(F.col("mean") - F.col("prev_mean")) > 0.5 * F.col("prev_std")), "shift"),
        F.when(~num & (F.col("n_finite") > 0) & (20 * F.col("n_bad") >= F.col("n_finite")), "pattern"),
    )
    return p.select("column_name", "load_id", F.explode(F.array_compact(issues)).alias("issue"))


@query
def p5_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage, distinct values, range and malformed share of the ten columns that have a rule; p5_columns has them all."""
    r = lambda c: F.round(c, 6).alias(c)
    return _profile(spark, sf_dir, True).select("column_name", "load_id", "n_rows", "n_null", "n_finite", r("coverage"), r("mean"), F.round("std", 5).alias("std"), (F.col("lo") + 0.0).alias("lo"), (F.col("hi") + 0.0).alias("hi"), r("bad_share"), "n_distinct")


#: Texts of event_rows beside those of p5_found's rules; None: no spelling is laid down.
_TEXTS = _PATTERNS | {"trade_date": "[0-9]{8}|[0-9]{4}-[0-9]{2}-[0-9]{2}", "stock_code": None, "strategy_name": None}


@query
def p5_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column of event_rows and load: coverage, distinct values, range, malformed share and their change from the load before."""
    kinds = dict(table(spark, sf_dir, "event_rows").dtypes)
    numeric = {c: _NUMERIC.get(c) for c, k in kinds.items() if k in ("double", "float")}
    texts = {c: _TEXTS.get(c) for c, k in kinds.items() if k == "string"}
    p = profile(spark, f"{sf_dir}/event_rows.parquet", load="load_id", numeric=numeric, patterns=texts, whole=[c for c in kinds if c not in numeric and c not in texts])
    r = lambda c, n=6: F.round(c, n).alias(c)
    change = lambda c, b: F.round(F.col(c) - F.col(f"prev_{b}"), 6).alias(f"{b}_change")
    return p.select(
        "column_name", "load_id", "n_rows", "n_null", "n_finite", "n_in", r("coverage"), r("mean"), r("std", 5), (F.col("lo") + 0.0).alias("lo"), (F.col("hi") + 0.0).alias("hi"), "lo_txt", "hi_txt", r("bad_share"), "n_distinct",
        change("coverage", "coverage"), change("mean", "mean"), change("bad_share", "bad_share"), (F.col("n_distinct") - F.col("prev_distinct")).alias("distinct_change"),
    )


def _profile_sql(tail: str) -> str:
    parts = []
    for c, (a, b) in _NUMERIC.items():
        parts.append(f"select '{c}' as column_name, load_id, true as num, cast({c} as double) as raw, case when isfinite({c}) then cast({c} as double) end as v, case when isfinite({c}) and {c} between {a} and {b} then cast({c} as double) end as i, cast(null as varchar) as txt, false as bad from event_rows")
    for c, p in _PATTERNS.items():
        parts.append(f"select '{c}', load_id, false, null, case when {c} is not null then 0.0 end, null, {c}, not regexp_full_match({c}, '{p}') from event_rows")
    return "with u as (" + " union all ".join(parts) + """), g as (select column_name, load_id, num, count(*) as n, count(v) as nv, count(i) as ni, avg(i) as m, stddev_pop(i) as s, min(v) as lo, max(v) as hi,
    count(*) filter (where bad) as nb, count(raw) + count(txt) as filled, count(distinct case when raw = 0 then 0.0 else raw end) + count(distinct txt) as nd from u group by 1, 2, 3),
    p as (select *, lag(ni) over w as pn, lag(m) over w as pm, lag(s) over w as ps from g window w as (partition by column_name order by load_id)) """ + tail  # fmt: skip


ORACLE["p5_found"] = _profile_sql("""
select column_name, load_id, 'nulls' as issue from p where 4 * (n - nv) >= n
union all select column_name, load_id, 'range' from p where num and nv > 0 and 50 * (nv - ni) >= nv
union all select column_name, load_id, 'constant' from p where num and nv >= 20 and lo = hi
union all select column_name, load_id, 'shift' from p where num and ni >= 20 and pn >= 20 and abs(m - pm) > 0.5 * ps
union all select column_name, load_id, 'pattern' from p where not num and nv > 0 and 20 * nb >= nv""")
ORACLE["p5_profile"] = _profile_sql("""select column_name, load_id, n as n_rows, n - filled as n_null, nv as n_finite, round(nv / n, 6) as coverage, round(case when num then m end, 6) as mean, round(case when num then s end, 5) as std,
case when num then lo + 0.0 end as lo, case when num then hi + 0.0 end as hi, round(case when not num and nv > 0 then nb / nv end, 6) as bad_share, nd as n_distinct from p""")


def _columns_sql() -> str:
    numeric, parts = _NUMERIC | {"label_d2_return": ("-inf", "inf")}, []
    none = "cast(null as double)"
    for c, (a, b) in numeric.items():
        v = f"case when isfinite({c}) then {c} end"
        parts.append(f"select '{c}' as column_name, load_id, 'num' as kind, {c} is not null as filled, {v} as v, case when isfinite({c}) and {c} between '{a}'::double and '{b}'::double then {c} end as i, case when {c} = 0 then 0.0 else {c} end as num, cast(null as bigint) as whole, cast(null as varchar) as txt, cast(null as boolean) as bad from event_rows")
    for c, p in _TEXTS.items():
        parts.append(f"select '{c}', load_id, 'txt', {c} is not null, case when {c} is not null then 0.0 end, case when {c} is not null then 0.0 end, {none}, null, {c}, " + ("null" if p is None else f"not regexp_full_match({c}, '{p}')") + " from event_rows")
    for c, x in {"event_id": "event_id", "load_id": "load_id", "event_time": "epoch_us(event_time)", "loaded_at": "epoch_us(loaded_at)"}.items():
        parts.append(f"select '{c}', load_id, 'whole', {c} is not null, case when {c} is not null then 0.0 end, case when {c} is not null then 0.0 end, {none}, {x}, null, null from event_rows")
    return "with u as (" + " union all ".join(parts) + """), g as (select column_name, load_id, kind, count(*) as n, count(*) filter (where not filled) as nn, count(v) as nv, count(i) as ni, case when kind = 'num' then avg(i) end as m, case when kind = 'num' then stddev_pop(i) end as s,
    case when kind = 'num' then min(v) + 0.0 end as lo, case when kind = 'num' then max(v) + 0.0 end as hi, coalesce(min(txt), cast(min(whole) as varchar)) as lt, coalesce(max(txt), cast(max(whole) as varchar)) as ht,
    count(*) filter (where bad) / nullif(count(bad), 0) as bs, count(distinct num) + count(distinct whole) + count(distinct txt) as nd from u group by 1, 2, 3)
    select column_name, load_id, n as n_rows, nn as n_null, nv as n_finite, ni as n_in, round(nv / n, 6) as coverage, round(m, 6) as mean, round(s, 5) as std, lo, hi, lt as lo_txt, ht as hi_txt, round(bs, 6) as bad_share, nd as n_distinct,
    round(nv / n - lag(nv / n) over w, 6) as coverage_change, round(m - lag(m) over w, 6) as mean_change, round(bs - lag(bs) over w, 6) as bad_share_change, nd - lag(nd) over w as distinct_change from g window w as (partition by column_name order by load_id)"""  # fmt: skip


ORACLE["p5_columns"] = _columns_sql()


# 6. top N items within every group


def _picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    cal = table(spark, sf_dir, "trade_cal").where("is_open = 1").select(F.col("cal_date").alias("trade_date")).distinct()
    rows = (
        table(spark, sf_dir, "event_rows")
        .select(plain_date("trade_date").alias("trade_date"), "strategy_name", norm_code("stock_code").alias("code"), finite("score").alias("score"), "event_id", finite("label_d2_return").isNotNull().alias("executed"))
        .where("strategy_name is not null and score is not null and code is not null")
        .join(F.broadcast(cal), "trade_date", "left_semi")
    )
    best = (
        rows.groupBy("trade_date", "strategy_name", "code").agg(F.max(F.struct("score", (-F.col("event_id")).alias("minus"), "executed")).alias("b"))
        .select("trade_date", "strategy_name", "code", F.col("b.score").alias("score"), (-F.col("b.minus")).alias("event_id"), "b.executed")
    )
    return top_n(best, groups=["trade_date", "strategy_name"], order=[F.col("score").desc(), F.col("code").asc()], n=4).where("group_rows >= 4")


@query
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four best-scored stocks of every date and strategy."""
    return _picks(spark, sf_dir).select("trade_date", "strategy_name", "event_id")


@query
def p6_executed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per date and strategy: how many of the four picks were executed, their mean score, codes in the group."""
    return _picks(spark, sf_dir).groupBy("trade_date", "strategy_name").agg(F.count_if("executed").alias("executed"), F.round(F.avg("score"), 6).alias("mean_score"), F.max("group_rows").alias("n_codes"))


_P6 = """
with r as (select replace(trade_date, '-', '') as d, strategy_name as s, upper(trim(stock_code)) as c, score, event_id, coalesce(isfinite(label_d2_return), false) as ex from event_rows
  where isfinite(score) and strategy_name is not null and stock_code is not null and replace(trade_date, '-', '') in (select cal_date from trade_cal where is_open = 1)),
b as (select d, s, c, score, event_id, ex, row_number() over (partition by d, s, c order by score desc, event_id) as k from r),
t as (select *, row_number() over (partition by d, s order by score desc, c) as pos, count(*) over (partition by d, s) as n from b where k = 1)
"""
ORACLE["p6_found"] = _P6 + "select d as trade_date, s as strategy_name, event_id from t where pos <= 4 and n >= 4"
ORACLE["p6_executed"] = _P6 + "select d as trade_date, s as strategy_name, count(*) filter (where ex) as executed, round(avg(score), 6) as mean_score, max(n) as n_codes from t where pos <= 4 and n >= 4 group by 1, 2"
