import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strake.functions import ops as o
from strake.functions.expr import ExpressionError, FactorLibrary, FactorSpec, check, compile_text, parse
from strake.operators import audits, labels, metrics, portfolio, relational
from strake.operators.search import crossover, grow, mutate, search
from strake.sources import store as st
from strake.sources.lineage import Audit, require_clean, violations
from strake.streaming.upsert import stream_into


@pytest.fixture(scope="module")
def panel(spark):
    rnd = random.Random(0)
    rows = [(t, c, rnd.choice([None, *[round(rnd.gauss(0, 1), 2)] * 9]), round(rnd.gauss(0, 1), 1)) for t in range(30) for c in "abcdefgh"]
    return spark.createDataFrame(rows, "t int, code string, x double, y double").cache()


EXPRESSIONS = ["ts_mean(x, 5)", "ts_rank(x, 5)", "ts_argmax(x, 5)", "ts_decay(x, 3)", "ts_corr(x, y, 10)", "ts_cov(x, y, 5)", "ts_zscore(x, 5)", "ts_pct(x, 2)", "cs_rank(ts_delta(x, 1))", "ts_std(cs_zscore(x), 4)"]


@pytest.mark.parametrize("text", EXPRESSIONS)
def test_no_look_ahead(panel, text):
    """Changing the last date must not change any earlier one."""
    e = compile_text(text, panel.columns)
    get = lambda df: {(r.t, r.code): r.v for r in df.select("t", "code", e.alias("v")).where("t < 29").collect()}
    assert get(panel) == get(panel.withColumn("x", F.when(F.col("t") == 29, F.col("x") + 100).otherwise(F.col("x"))))


def test_small_operators(spark, panel):
    """Properties on random cells: protected division, ranks, constant dates, full windows."""
    rows = {(r.t, r.code): r for r in panel.select("t", "code", "x", "y", o.div(F.col("x"), F.col("y")).alias("q"), o.cs_rank(F.col("x")).alias("r"), o.cs_zscore(F.lit(7.0) + 0 * F.col("t")).alias("z"), o.ts_mean(F.col("x"), 6).alias("m")).collect()}
    for (t, code), r in rows.items():
        assert r.q == (None if r.x is None or abs(r.y) < 1e-9 else pytest.approx(r.x / r.y)) and r.z is None
        date = sorted((v.x, c) for (u, c), v in rows.items() if u == t and v.x is not None)
        assert r.r == (None if r.x is None else pytest.approx((date.index((r.x, code)) + 1) / len(date)))
        past = [rows[u, code].x for u in range(t - 5, t + 1)] if t >= 5 else [None]
        assert r.m == (None if None in past else pytest.approx(sum(past) / 6))
    with pytest.raises(ValueError):
        o.delay(F.col("x"), 0)


def test_expressions():
    text = "ts_mean(div(close, open), 5)"
    assert str(parse(text)) == text and parse(text).size == 4 and parse(text).depth == 3
    for bad in ("ts_mean(close, open)", "ts_mean(close, 0)", "ts_mean(close, -3)", "nope(close)", "add(close)", "add(close, open", "close)", "ts_mean(close, 2.5)", ""):
        with pytest.raises(ExpressionError):
            parse(bad)
    with pytest.raises(ExpressionError, match="outcome"):
        check(parse("add(close, label_hit)"), ["close", "label_hit"])
    with pytest.raises(ExpressionError, match="no column"):
        check(parse("vol"), ["close"])
    with pytest.raises(ExpressionError, match="along time"):
        check(parse("ts_mean(close, 3)"), ["close"], "event")


def test_fields_that_depend_on_the_columns(spark):
    from strake.functions.base_fields import base_fields

    rnd = random.Random(2)
    rows = [(t, c, *[rnd.uniform(1, 9) for _ in range(9)]) for t in range(3) for c in "ab"]
    cols = ["open_h", "high_h", "low_h", "close_h", "amount", "volume_ratio", "circ_mv", "pb", "pe_ttm"]
    df = spark.createDataFrame(rows, "t int, code string, " + ", ".join(f"{c} double" for c in cols)).withColumn("pb", F.when(F.col("code") == "a", 0.0).otherwise(F.col("pb")))
    f = base_fields(df.columns)
    assert {"volume_ratio_f", "log_circ_mv", "bp", "ep"} <= f.keys() and not {"turnover_f", "to_up_limit"} & f.keys()
    for r in df.select("*", *[f[n].alias(n) for n in ("volume_ratio_f", "log_circ_mv", "bp", "ep")]).collect():
        assert r.volume_ratio_f == r.volume_ratio and r.log_circ_mv == pytest.approx(np.log(r.circ_mv)) and r.ep == pytest.approx(1 / r.pe_ttm)
        assert r.bp == (None if r.code == "a" else pytest.approx(1 / r.pb))


def test_only_needed_columns_and_dates_are_read(spark, tmp_path):
    import __spark_entry__ as entry

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    text = plan(entry.queries()["topk_portfolio"](spark, "/root/testdata/sf0.001"))
    assert "label_d2_return" in text and "feat_a" not in text and "strategy_name" not in text
    text = plan(entry.queries()["op_mean"](spark, "/root/testdata/sf0.001"))
    assert "turnover_rate_f" in text and "raw_close" not in text and "adj_factor" not in text
    s = st.Store(spark, str(tmp_path))
    s.append_dated(SPEC, spark.createDataFrame([("20230103", "a", "1"), ("20230104", "b", "2")], "trade_date string, code string, px string"))
    assert "PartitionFilters: [isnotnull(trade_date" in plan(s.read_dated(SPEC, "20230104", "20230104"))


def test_search_window():
    assert labels.search_window(10, 4) == (0, 4) and labels.search_window(3, 4) == (0, 3)
    with pytest.raises(ValueError):
        labels.search_window(3, 0)


def test_library_round_trip(panel, tmp_path):
    lib = FactorLibrary([FactorSpec("f1", "ts_mean(x, 3)", -1), FactorSpec("f2", "cs_rank(y)")], ["x", "y"])
    lib.save(str(tmp_path / "lib.json"))
    again = FactorLibrary.load(str(tmp_path / "lib.json"))
    assert again == lib
    a, b = (sorted(x.apply(panel).select("t", "code", "f1", "f2").collect(), key=str) for x in (lib, again))
    assert a == b and dict(panel.limit(1).transform(lib.apply).dtypes)["f1"] == "float"
    with pytest.raises(ExpressionError):
        FactorLibrary([], ["gone"]).apply(panel)


def one_date(spark, scores, ys, rets=None):
    return spark.createDataFrame([(0, f"c{i}", s, y, r) for i, (s, y, r) in enumerate(zip(scores, ys, rets or ys))], "t int, code string, score double, y double, ret double")


def test_metrics_by_hand(spark):
    auc = lambda s, y: metrics.daily_auc(one_date(spark, s, y), "score", least=2).first().auc
    assert auc([1.0, 2.0, 3.0, 4.0], [0.0, 0.0, 1.0, 1.0]) == 1.0 and auc([4.0, 3.0, 2.0, 1.0], [0.0, 0.0, 1.0, 1.0]) == 0.0
    assert auc([1.0, 2.0, 3.0, 4.0], [0.0, 1.0, 0.0, 1.0]) == 0.75 and auc([1.0, 2.0, 3.0, 4.0], [1.0] * 4) is None
    p = metrics.precision_at_k(one_date(spark, [4.0, 3.0, 2.0, 1.0], [1.0, None, 1.0, 0.0]), "score", 2).first()
    assert p.precision is None and p.base == pytest.approx(2 / 3)
    assert metrics.select_features([("a", 0.1), ("b", -0.2), ("c", 0.15), ("d", 0.001)], {("a", "b"): 0.9, ("a", "c"): 0.1, ("b", "c"): 0.2}, 3) == ["b", "c"]


def test_portfolio_by_hand(spark):
    book = portfolio.top_k_portfolio(one_date(spark, [3.0, 3.0, 1.0, None], [1.0] * 4, [0.1, None, 0.5, 9.0]), "score", "ret", 2, 2).first()
    assert book.portfolio_return == pytest.approx(0.025) and book.executed == 1
    assert portfolio.top_k_portfolio(one_date(spark, [3.0], [1.0]), "score", "ret", 2).first().portfolio_return is None
    day = spark.createDataFrame([(t, v) for t, v in enumerate([-0.1, -0.1, 0.2, -0.05])], "t int, portfolio_return double")
    perf = portfolio.performance(day).first()
    assert perf.max_drawdown == pytest.approx(-0.19) and perf.max_consecutive_losses == 2 and perf.final_equity == pytest.approx(0.81 * 1.2 * 0.95)
    assert portfolio.rolling_windows(day, 3).count() == 2


def exit_panel(spark, days):
    rows = [(t, "a", *x) for t, x in enumerate(days)]
    df = spark.createDataFrame(rows, "t int, code string, open double, high double, close double, is_trading boolean, limit_observed boolean")
    return df.withColumns({"down_limit": F.lit(9.0), **{f"{c}_h": F.col(c) for c in ("open", "high", "close")}})


FREE, SEALED, HALT, BLIND = (10.0, 10.5, 10.2, True, True), (9.0, 9.0, 9.0, True, True), (None, None, None, False, True), (10.0, 10.5, 10.2, True, False)


@pytest.mark.parametrize(
    ("days", "want"),
    [
        ([FREE] * 4, (2, 10.2, "touch_close", False, False, False)),
        ([FREE, FREE, SEALED, SEALED, (10.0, 10.0, 9.5, True, True)], (4, 10.0, "open", True, False, False)),
        ([FREE, FREE, SEALED, (9.0, 9.9, 9.8, True, True)], (3, 9.8, "close", True, False, False)),
        ([FREE, FREE, HALT, FREE], (3, 10.0, "open", False, True, False)),
        ([FREE, FREE, BLIND, FREE], (3, 10.0, "open", False, False, True)),
        ([FREE, FREE, SEALED, SEALED], (None, None, None, True, False, False)),
        ([FREE, FREE], (None, None, None, False, False, False)),
    ],
)
def test_deferred_exit(spark, days, want):
    r = portfolio.deferred_exit(exit_panel(spark, days)).where("t = 0").first()
    assert (r.exit_t, r.exit_price, r.exit_kind, r.touch_sealed, r.met_suspension, r.met_missing_limit) == want


def test_splits():
    f = labels.walk_forward(100, 40, 10, 10, 2, 10)
    assert len(f) == 4 and f[1] == labels.Fold(1, (10, 50), (52, 62), (64, 74))
    with pytest.raises(ValueError):
        labels.walk_forward(50, 40, 10, 10, 2)
    assert labels.fit_selection(0, 200) == ((0, 160), (162, 200)) and labels.outcome_complete(0, 10, 2) == (0, 8)


def test_residual_is_orthogonal_and_explained_dates_are_null(panel):
    r = audits.residualize(panel.where("x is not null"), "x", ["y"])
    assert all(e.worst < 1e-9 for e in audits.exposure(r, "residual", ["y"]).collect())
    assert {z.residual for z in audits.residualize(panel.withColumn("z", 2 * F.col("y") + 1), "z", ["y"]).collect()} == {None}


def test_null_against_brute_force(spark):
    from strake.operators.audits import permuted, placebo_null
    from strake.operators.metrics import daily_auc, daily_ic, ratio

    rnd = np.random.default_rng(8)
    gap = lambda: None if rnd.random() < 0.2 else float(rnd.integers(0, 6))
    rows = [(t, f"c{i:02d}", int(rnd.integers(0, 1 << 40)) * 64 + i, gap(), gap(), None if t == 1 else gap(), None if rnd.random() < 0.1 else float(rnd.random() < (0, 0.3, 0.3, 0.5, 1)[t])) for t in range(5) for i in range(4 if t == 3 else 30)]
    df = spark.createDataFrame(rows, "t int, code string, id long, a double, b double, c double, y double").withColumn("id", F.col("id") % 100_000_000)
    long = permuted(df, "y", "id", 40).select("perm", "t", "code", "y_perm", F.inline(F.array(*[F.struct(F.lit(c).alias("factor"), F.col(c).alias("x")) for c in "abc"])))
    ic = daily_ic(long, "x", "y_perm", 5, by=("perm", "factor")).groupBy("perm", "factor").agg(F.abs(F.avg("ic")).alias("ic_mean"), F.abs(ratio(F.avg("ic"), F.stddev_samp("ic"))).alias("icir"))
    gini = daily_auc(long, "x", "y_perm", 5, by=("perm", "factor")).groupBy("perm", "factor").agg(F.abs(F.avg(2 * F.col("auc") - 1)).alias("gini"))
    want = ic.join(gini, ["perm", "factor"]).groupBy("perm").agg(F.max("ic_mean"), F.max("icir"), F.max("gini")).orderBy("perm").collect()
    got = placebo_null(df, ["a", "b", "c"], "y", "id", 40).orderBy("perm").collect()
    assert np.allclose(np.array(got), np.array(want), atol=1e-12) and len(got) == 40


def test_grades_take_the_whole_null(spark, monkeypatch):
    from strake.operators import audits
    from strake.plans import audit_queries
    from strake.sources.panel import EVENT_FIELDS

    asked, null = [], audits.placebo_null
    monkeypatch.setattr(audits, "placebo_null", lambda df, factors, y, key, perms: asked.append((factors, perms)) or null(df, factors, y, key, perms))
    got = audit_queries.placebo_grades(spark, "/root/testdata/sf0.001").collect()
    assert {r.factor for r in got} == set(EVENT_FIELDS) and asked == [(list(EVENT_FIELDS), 1000)]


def test_p_value():
    assert audits.correlation_p(0.5, 12) == pytest.approx(0.0978, abs=1e-3) and audits.incomplete_beta(2, 3, 0.3) == pytest.approx(0.3483, abs=1e-6)


def test_relational_guards(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 1.0)], "k int, v double")
    assert relational.dedup_or_fail(df, ["k"]).count() == 2
    with pytest.raises(relational.ContractError):
        relational.dedup_or_fail(df.union(spark.createDataFrame([(2, 3.0)], df.schema)), ["k"])
    with pytest.raises(relational.ContractError):
        relational.join_one(df, df, ["k"])
    a, b = (relational.fingerprint(x, ["k"]).orderBy("k").collect() for x in (df, df.orderBy(F.desc("k")).repartition(3)))
    assert a == b


SPEC = st.TableSpec("bars", ("trade_date", "code", "px"), frozenset({"px"}), "trade_date")


def test_upsert_keeps_every_date(spark):
    import __spark_entry__ as entry

    from .oracle import compare, database

    sf = "/root/testdata/sf0.001"
    d = spark.read.parquet(f"{sf}/daily.parquet")
    got = entry.queries()["upsert_all_dates"](spark, sf)
    assert got.groupBy("trade_date").count().exceptAll(d.groupBy("trade_date").count()).count() == 0 and got.count() == d.count()
    assert compare(spark, database(sf), sf, entry.queries()["upsert_all_dates"], entry.oracle_sql()["upsert_all_dates"]).startswith("ok")


def test_store(spark, tmp_path):
    s = st.Store(spark, str(tmp_path))
    assert s.read_dated(SPEC, "20200101", "20991231").count() == 0
    df = spark.createDataFrame([("20221230", "a", "1.5", 0), ("20230103", "a", "bad", 0), ("20230104", "b", "nan", 0)], "trade_date string, code string, px string, extra int")
    s.append_dated(SPEC, df)
    s.append_dated(SPEC, df)
    s.append_dated(SPEC, spark.createDataFrame([("20230103", "z", "7")], "trade_date string, code string, px string"))
    assert sorted(tuple(r) for r in s.read_dated(SPEC, "20220101", "20231231").collect()) == [("20221230", "a", 1.5), ("20230103", "z", 7.0), ("20230104", "b", None)]
    assert [r.code for r in s.read_dated(SPEC, "20230104", "20230104").collect()] == ["b"]
    assert s.missing_dates(SPEC, spark.createDataFrame([("20230104",), ("20230105",)], "trade_date string")).first().trade_date == "20230105"
    with pytest.raises(ValueError):
        s.append_dated(SPEC, df.drop("px"))


def test_stream_of_deliveries(spark, tmp_path):
    src = tmp_path / "in"
    df = spark.createDataFrame([("20230103", "a", "1"), ("20230103", "a", "1"), ("20230104", "b", "2")], "trade_date string, code string, px string")
    df.write.parquet(str(src))
    s = st.Store(spark, str(tmp_path / "store"))
    for _ in range(2):
        q = stream_into(spark.readStream.schema(df.schema).parquet(str(src)), s, SPEC, str(tmp_path / "cp"))
        q.awaitTermination(120)
    assert s.read_dated(SPEC, "20230101", "20231231").count() == 2


def test_calendar_and_lineage(spark):
    good = spark.createDataFrame([("20230103", 1), ("20230104", 0), ("20230105", 1)], "cal_date string, is_open int")
    assert st.load_calendar(good) == ["20230103", "20230105"]
    for bad in (("20230103", 1), ("20230231", 1), ("2023-01-09", 1), ("20230109", 2), (None, 1)):
        with pytest.raises(ValueError):
            st.load_calendar(good.union(spark.createDataFrame([bad], good.schema)))
    cal = spark.createDataFrame([(0, "20230103"), (1, "20230105")], "t int, trade_date string")
    v1 = "raw-times-same-day-adj-v1:" + "a" * 64
    rows = [("2023-01-03", "20230103", v1), ("20230104", "20230104", v1), ("20230103", None, v1), ("20230103", "20230105", v1), ("20230103", "20230103", "v0")]
    df = spark.createDataFrame(rows, "trade_date string, src string, ver string")
    assert [r.violation for r in violations(df, Audit("src", "ver"), cal).collect()] == [None, "date", "source", "calendar", "version"]
    assert violations(df.limit(1), Audit("src", horizon=1), cal).first().violation == "calendar"
    with pytest.raises(relational.ContractError):
        require_clean(df, Audit("src", "ver"), cal)


def test_survivors_beyond_the_first_block(spark):
    from strake.operators.search import Scored, survivors

    rnd = random.Random(9)
    df = spark.createDataFrame([(t, f"c{i}", rnd.gauss(0, 1), rnd.gauss(0, 1)) for t in range(12) for i in range(12)], "t int, code string, a double, b double")
    texts = ["a", *[f"add(a, {'add(a, ' * k}a{')' * k})" for k in range(8)], "b"]
    nodes = [parse(x) for x in texts]
    found = survivors(df, [Scored(str(x), x, 100.0 - i, x.size) for i, x in enumerate(nodes)], 2)
    assert [s.expression for s in found] == [str(nodes[0]), str(nodes[-1])]


def test_search_recovers_a_planted_factor(spark):
    rnd = random.Random(1)
    trees = [grow(rnd, ["x", "y"], 4, "panel", k % 2 == 0) for k in range(50)]
    for a, b in zip(trees, trees[1:]):
        for t in (crossover(rnd, a, b), mutate(rnd, a, ["x", "y"], "panel")):
            assert str(parse(str(t))) == str(t)
    rows = []
    for t in range(30):
        for c in range(30):
            alpha = rnd.gauss(0, 1)
            rows.append((t, f"c{c:02d}", alpha, rnd.gauss(0, 1), 0.02 * alpha + rnd.gauss(0, 0.002)))
    df = spark.createDataFrame(rows, "t int, code string, alpha double, noise double, ret double")
    best = search(df, ["alpha", "noise"], "ret", population=12, generations=2, kind="event", seed=2)[0]
    assert "alpha" in best.expression and best.fitness > 100
