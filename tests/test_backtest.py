import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strake.functions.expr import FactorLibrary, FactorSpec
from strake.operators import audits, diagnostics, guards, ledger, model
from strake.operators.bitemporal import known_at
from strake.operators.relational import ContractError
from strake.operators.search import Scored, mine, search, survivors
from strake.sources import store as st
from strake.sources.lineage import Audit, governed_scan
from strake.sources.panel import bar_panel

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def cut(spark, tmp_path_factory):
    """The tables without the factor records that became known from September 2022 on."""
    at = tmp_path_factory.mktemp("cut")
    for name in ("trade_cal", "daily"):
        os.symlink(f"{SF}/{name}.parquet", at / f"{name}.parquet")
    spark.read.parquet(f"{SF}/adj_factor.parquet").where("as_of_time < timestamp_ntz '2022-09-01 00:00:00'").write.parquet(str(at / "adj_factor.parquet"))
    return str(at)


def test_later_records_change_nothing_earlier(spark, cut):
    get = lambda d, **kw: {(r.trade_date, r.code): r.adj for r in bar_panel(spark, d, **kw).where("trade_date < '20220901'").select("trade_date", "code", "adj").collect()}
    assert get(SF) == get(cut) and set(get(SF).values()) != {None}
    assert get(SF, hindsight=True) != get(cut, hindsight=True)


def test_panel_factor_is_the_one_known_at_the_close(spark):
    cells = bar_panel(spark, SF).select("t", "trade_date", "code", "adj").withColumn("at", F.expr("to_timestamp_ntz(trade_date, 'yyyyMMdd') + interval 15 hour"))
    records = spark.read.parquet(f"{SF}/adj_factor.parquet").where("adj_factor > 0 and not isnan(adj_factor)")
    got = known_at(cells, records, key="code", time="at", version_key="ts_code", valid_from="trade_date", recorded="as_of_time", version_id="adj_id", payload=["adj_factor"])
    assert got.where("not (adj <=> known.adj_factor)").count() == 0 and got.where("adj is not null").count() > 100


def test_duplicates_collapse_or_are_refused(spark):
    df = spark.createDataFrame([(0, "a", 1, 0.5, 10.0), (0, "a", 2, 0.9, 10.0), (0, "b", 3, None, 7.0), (0, "b", 4, 0.1, 7.0), (0, "c", 6, 0.4, 1.0), (0, "c", 5, 0.4, 1.0)], "t int, code string, id long, score double, px double")
    assert sorted(r.id for r in ledger.collapse_duplicates(df, "score", "id", ("px",)).collect()) == [2, 4, 5]
    with pytest.raises(ContractError):
        ledger.collapse_duplicates(df.withColumn("px", F.col("id") * 1.0), "score", "id", ("px",))


def test_ledger_by_hand(spark):
    """a is sold on time, b sealed on the touch date and sold later, c never trades again, d can't be bought."""
    free, sealed, halt = (10.0, 10.5, 11.0, True), (9.0, 9.0, 9.0, True), (None, None, None, False)
    bars = {"a": [free] * 5, "b": [free, free, sealed, sealed, free], "c": [free, free, halt, halt, halt], "d": [free, halt, free, free, free]}
    rows = [(t, c, *x) for c, days in bars.items() for t, x in enumerate(days)]
    panel = spark.createDataFrame(rows, "t int, code string, open double, high double, close double, is_trading boolean")
    panel = panel.withColumns({"down_limit": F.lit(9.0), "limit_observed": F.lit(True), **{f"{c}_h": F.col(c) for c in ("open", "high", "close")}})
    df = spark.createDataFrame([(0, c, s) for c, s in zip("abcde", (5.0, 4.0, 3.0, 2.0, None))] + [(1, "a", 1.0)], "t int, code string, score double")
    x = ledger.ledger(df, "score", 4, panel)
    got = {r.code: (r.rank, r.status, r.exit_t, r.baseline, r.realistic) for r in x.collect()}
    a = pytest.approx
    assert got == {"a": (1, "sold", 2, a(0.1), a(0.1)), "b": (2, "sold", 4, a(-0.1), a(0.0)), "c": (3, "open", None, None, None), "d": (4, "no_entry", 2, None, None)}
    day = ledger.ledger_daily(x, 4).collect()
    assert [(r.t, r.n_sold, r.n_open, r.n_no_entry) for r in day] == [(0, 2, 1, 1)] and day[0].realistic == a(0.025) and day[0].baseline == a(0.0)


def test_window_and_curve_guards(spark):
    df = spark.createDataFrame([("20230103", 1), ("20230104", 1), ("20230104", 2)], "trade_date string, x int")
    frozen = guards.window_digest(df).first().asDict()
    assert frozen["n_dates"] == 2 and guards.require_window(df.orderBy(F.desc("trade_date")), frozen).count() == 3
    with pytest.raises(ContractError):
        guards.require_window(df.where("x = 1 and trade_date < '20230104'"), {"digest": frozen["digest"]})
    assert guards.window_digest(df.limit(0)).first().n_rows == 0
    curves = spark.createDataFrame([(0, 1, None, 0.1), (1, 1, None, 0.2), (0, 2, 0.5, 0.3), (0, 2, 0.5, 0.4)], "t int, seed int, least double, v double")
    assert guards.select_curve(curves, {"seed": 1, "least": None}).count() == 2
    for keys in ({"seed": 2}, {"seed": 9}, {}):
        with pytest.raises(ContractError):
            guards.select_curve(curves, keys)


def test_price_guards(spark):
    df = spark.createDataFrame([("20230103", "a", 10.0, 2.0, 20.0), ("20230104", "a", 11.0, None, None), ("20230105", "a", None, None, None)], "trade_date string, code string, close double, adj double, close_h double")
    assert guards.unadjusted(df).count() == 1 and guards.require_adjusted(df.where("adj is not null")).count() == 1
    with pytest.raises(ContractError):
        guards.require_adjusted(df)
    off = df.withColumn("twice", F.col("close") * 2)
    assert guards.require_derived(off, "close_h", F.col("twice"), 1e-6).count() == 3
    with pytest.raises(ContractError):
        guards.require_derived(off, "close_h", F.col("close"), 1e-6)
    assert [r.source_key for r in guards.complete_cases(df, ["adj", "close"], "trade_date").collect()] == ["20230103"]
    assert guards.select_codes(df, df.select("code").limit(1)).count() == 3


def test_snapshot_keeps_rows_and_lineage(spark, tmp_path):
    df = spark.createDataFrame([(t, f"2023010{t}", f"c{k}", float(t * k) if k else None) for t in range(5) for k in range(4)], "t int, trade_date string, code string, x double")
    at = str(tmp_path / "panel")
    guards.write_snapshot(df, at, {"basis": "adjusted", "as_of": "close"}, parts=3)
    again = guards.read_snapshot(spark, at, {"basis": "adjusted"})
    assert again.columns == df.columns and again.exceptAll(df).count() == 0 and again.count() == df.count()
    with pytest.raises(ContractError):
        guards.read_snapshot(spark, at, {"basis": "raw"})
    again.where("t < 3").write.mode("overwrite").parquet(str(tmp_path / "less"))
    os.rename(f"{at}/rows", f"{at}/whole")
    spark.read.parquet(str(tmp_path / "less")).withColumn("part", F.lit(0)).write.partitionBy("part").parquet(f"{at}/rows")
    with pytest.raises(ContractError):
        guards.read_snapshot(spark, at)


def test_control_and_shuffle(spark):
    cells = spark.createDataFrame([(t, c, (t, c) in {(2, "a"), (3, "a")}) for t in range(6) for c in "ab"], "t int, code string, halted boolean")
    prof = diagnostics.offset_profile(cells.where("halted and t = 2"), cells, "halted", -1, 2)
    assert sorted(tuple(r) for r in diagnostics.require_control(prof).collect()) == [(-1, 1, 0), (0, 1, 1), (1, 1, 1), (2, 1, 0)]
    with pytest.raises(ContractError):
        diagnostics.require_control(prof, -1)
    df = spark.createDataFrame([(t, f"c{k}", 100 * t + k, float(k), float(-k)) for t in range(3) for k in range(20)], "t int, code string, id long, a double, b double")
    got = diagnostics.shuffled_rows(df, ["a", "b"], "id").collect()
    assert all(r.a == -r.b for r in got) and sum(r.a == r.id % 100 for r in got) < 15
    assert sorted((r.t, r.a) for r in got) == sorted((r.t, r.a) for r in df.collect())


def test_design_with_a_category_against_least_squares(spark):
    rnd = np.random.default_rng(3)
    rows = [(t, f"c{k}", float(rnd.normal()), float(rnd.normal()), float(rnd.normal()), "xyz"[k % 3] if k != 7 else None) for t in range(2) for k in range(30)]
    df = spark.createDataFrame(rows, "t int, code string, y double, a double, b double, kind string")
    x, names = audits.style_design(df, ["a", "b"], "kind")
    assert names == ["z_a", "z_b", "kind=y", "kind=z"]
    got = {(r.t, r.code): r.residual for r in audits.residualize(x, "y", names).collect()}
    for t in range(2):
        part = [r for r in rows if r[0] == t and r[5]]
        m = np.array([[1, r[3], r[4], r[5] == "y", r[5] == "z"] for r in part], dtype=float)
        y = np.array([r[2] for r in part])
        rest = y - m @ np.linalg.lstsq(m, y, rcond=None)[0]
        assert np.allclose([got[t, r[1]] for r in part], rest) and got[t, "c7"] is None


def planted(spark, seed, both=False):
    rnd = random.Random(seed)
    rows = []
    for t in range(40):
        for c in range(25):
            a, b, n = rnd.gauss(0, 1), rnd.gauss(0, 1), rnd.gauss(0, 1)
            trap = a if t < 30 else -a  # earns on the fit block only
            rows.append((t, f"c{c:02d}", a, b, n, (0.02 * b if both else 0.0) + 0.02 * trap * (not both) + 0.03 * a * both + 0.01 * b + rnd.gauss(0, 0.002)))
    return spark.createDataFrame(rows, "t int, code string, a double, b double, noise double, ret double")


def test_survivors_must_earn_on_the_later_block(spark):
    found = search(planted(spark, 1), ["a", "b", "noise"], "ret", population=16, generations=1, kind="event", seed=4, fit=(0, 30), selection=(30, 40))
    assert found and all(s.selection > 0 for s in found) and "b" in found[0].expression
    assert survivors(None, [Scored("a", None, 5.0, 1, -1.0), Scored("b", None, -5.0, 1, 1.0)], 3) == []


def test_mining_goes_on_with_what_is_left(spark):
    rounds = mine(planted(spark, 2, both=True), ["a", "b", "noise"], "ret", rounds=2, population=14, generations=1, kind="event", seed=6, keep=1)
    assert [n for n, _ in rounds] == [0, 1]
    first, second = (s.expression for _, s in rounds)
    assert first != second and ("a" in first or "b" in first)


def test_models(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(t, f"c{k}", x := rnd.gauss(0, 1), rnd.gauss(0, 1) if k % 9 else None, float(x + rnd.gauss(0, 0.5) > 0.5), x + rnd.gauss(0, 0.5)) for t in range(12) for k in range(40)]
    df = spark.createDataFrame(rows, "t int, code string, a double, b double, y double, ret double").cache()
    train, test = df.where("t < 8"), df.where("t >= 8")
    for kind, y in (("logistic", "y"), ("regress", "ret"), ("regress_cs", "ret")):
        m = model.fit(train, ["a", "b"], y, kind, iterations=5, depth=3)
        assert model.mean_gini(model.predict(m, test)) > 0.5
    m, n = model.fit_early(train, test, ["a", "b"], steps=(2, 4))
    assert n in (2, 4)
    model.save_model(m, str(tmp_path / "m"), ["a", "b"], "boosted", {"b": "neg(c)"})
    again = model.load_model(str(tmp_path / "m"), ["a", "b"], {"b": "neg(c)"})
    assert model.predict(again, test).agg(F.sum("prediction_score")).first() == model.predict(m, test).agg(F.sum("prediction_score")).first()
    for features, texts in ((["b", "a"], {"b": "neg(c)"}), (["a", "b"], {"b": "c"})):
        with pytest.raises(ContractError):
            model.load_model(str(tmp_path / "m"), features, texts)
    with pytest.raises(ValueError):
        model.fit(train, ["a"], kind="forest")


def test_governed_scan(spark):
    cal = spark.createDataFrame([(0, "20230103"), (1, "20230104")], "t int, trade_date string")
    rows = [("2023-01-03", "b ", 1.0, "20230103"), ("20230103", "a", 2.0, "20230103"), ("20230104", "a", None, "20230104")]
    df = spark.createDataFrame(rows, "trade_date string, stock_code string, x double, x_source_date string")
    manifest = {"x": Audit("x_source_date")}
    got = governed_scan(df, manifest, cal, ["x"])
    assert sorted(tuple(r) for r in got.collect()) == [(0, "20230103", "A", 0, 2.0), (0, "20230103", "B", 1, 1.0), (1, "20230104", "A", 0, None)]
    with pytest.raises(ContractError):
        governed_scan(df, manifest, cal, ["y"])
    with pytest.raises(ContractError):
        governed_scan(df, manifest, cal, ["x"], train_end="20230103")


def test_exported_script(spark, tmp_path):
    lib = FactorLibrary([FactorSpec("f", "cs_rank(x)", -1)], ["x"], kind="event")
    lib.export_script(str(tmp_path / "s.py"))
    df = spark.createDataFrame([(0, "a", 1.0), (0, "b", 2.0)], "t int, code string, x double")
    df.write.parquet(str(tmp_path / "in"))
    import sys

    old, sys.argv = sys.argv, ["s.py", str(tmp_path / "in"), str(tmp_path / "out")]
    try:
        exec(compile((tmp_path / "s.py").read_text(), "s.py", "exec"), {})
    finally:
        sys.argv = old
    assert sorted(r.f for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [-1.0, -0.5]


def test_calendar_files(spark, tmp_path):
    (tmp_path / "c.csv").write_text("cal_date,is_open\n20230103,1\n20230104,0\n20230105,1\n")
    assert st.read_calendar(spark, str(tmp_path / "c.csv")) == ["20230103", "20230105"]
    for bad in ("cal_date,is_open\n20230104,1\n20230103,1\n", "cal_date,is_open\n20230103,yes\n"):
        (tmp_path / "bad.csv").write_text(bad)
        with pytest.raises(ValueError):
            st.read_calendar(spark, str(tmp_path / "bad.csv"))
    assert len(st.read_calendar(spark, f"{SF}/trade_cal.parquet")) > 400
