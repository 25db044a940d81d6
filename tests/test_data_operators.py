import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from strake.operators.bitemporal import staircase, known_at
from strake.operators.grid import regular_grid, smooth
from strake.operators.orphans import find_orphans
from strake.operators.profile import profile
from strake.operators.topn import top_n
from strake.operators.trailing import apply_corrections, build_trees, nodes_of, query_trees, trailing_totals

# 1. attributes as known at event time


@pytest.mark.parametrize("seed", range(20))
def test_rectangles_are_disjoint_and_right(seed):
    rnd = random.Random(seed)
    versions = sorted((rnd.randint(0, 8), rnd.randint(0, 8), i, None) for i in range(rnd.randint(1, 12)))
    rects = list(staircase(versions))
    assert len(rects) <= 2 * len(versions)
    for v in range(10):
        for r in range(10):
            want = max(((a, b, i) for a, b, i, _ in versions if a <= v and b <= r), default=None)
            got = [i for v1, v2, r1, r2, i, _ in rects if v1 <= v < v2 and r1 <= r < r2]
            assert got == ([want[2]] if want else [])


def brute_known(points, versions):
    out = []
    for eid, code, at in points:
        if code is None or at is None:
            out.append((eid, None, None))
            continue
        mine = [(d, r, i) for i, c, d, r in versions if c is not None and c.strip().upper() == code.strip().upper() and d <= at[:10].replace("-", "")]
        right = max((x for x in mine if x[1] <= at), default=None)
        hind = max(mine, default=None)
        out.append((eid, (right[2] if right else -1) if mine else None, (right != hind) if mine else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("cell", [1, 4, 64])
def test_known_at_against_brute_force(spark, cell):
    rnd = random.Random(1)
    day = lambda: f"2022-{rnd.randint(1, 12):02d}-{rnd.randint(1, 28):02d}"
    versions = [(i, rnd.choice(["A", " a", "B", "hot"]), day().replace("-", ""), f"{day()} {rnd.randint(0, 23):02d}:00:00") for i in range(90)]
    versions += versions[:5] + [(900, None, "20220101", "2022-01-01 00:00:00")]
    points = [(i, rnd.choice(["A", "b ", "HOT", "HOT", "none", None]), rnd.choice([f"{day()} {rnd.randint(0, 23):02d}:30:00", None])) for i in range(400)]
    v = spark.createDataFrame(versions, "vid long, code string, since string, seen string").withColumn("seen", F.to_timestamp_ntz("seen")).withColumn("factor", F.lit(1.5))
    p = spark.createDataFrame(points, "id long, code string, at string").withColumn("at", F.to_timestamp_ntz("at")).withColumn("factor", F.lit("mine"))
    args = {"key": "code", "time": "at", "version_key": "code", "valid_from": "since", "recorded": "seen", "version_id": "vid", "payload": ["factor"], "cell_versions": cell, "salt_rows": 50}
    got = known_at(p, v, **args)
    assert sorted(((r.id, r.known_id, r.revised) for r in got.collect()), key=repr) == brute_known(points, [x for x in set(versions)])
    assert {r.factor for r in got.collect()} == {"mine"}
    assert known_at(p, v.limit(0), **args).where("known_id is not null").count() == 0 and known_at(p.limit(0), v, **args).count() == 0


def test_points_meet_few_rectangles_of_a_crowded_key(spark, monkeypatch):
    """Thousands of versions of one key, known early, late and long after: every point's cell holds a few rectangles only."""
    from strake.operators import bitemporal

    rnd = random.Random(11)
    day = lambda n: np.datetime64("2022-01-01") + n
    versions = [(i, "hot" if i % 12 else "few", v := rnd.randint(0, 700), max(0, v + rnd.choice([-2, 0, 0, 1, 3, 400]))) for i in range(3000)]
    points = [(i, rnd.choice(["hot", "hot", "few", "none"]), n, max(0, n + rnd.choice([0, 0, 0, -500, 300]))) for i in range(1500) for n in [rnd.randint(0, 720)]]
    v = spark.createDataFrame([(i, k, str(day(a)).replace("-", ""), f"{day(b)} 10:00:00") for i, k, a, b in versions], "vid long, code string, since string, seen string").withColumn("seen", F.to_timestamp_ntz("seen"))
    p = spark.createDataFrame([(i, k, str(day(a)), f"{day(b)} 12:00:00") for i, k, a, b in points], "id long, code string, day string, at string").withColumn("at", F.to_timestamp_ntz("at"))
    seen, make = [], bitemporal._rectangles
    monkeypatch.setattr(bitemporal, "_rectangles", lambda *a: seen.append(make(*a)) or seen[-1])
    got = {r.id: (r.known_id, r.revised) for r in known_at(p, v, key="code", time="at", version_key="code", valid_from="since", recorded="seen", version_id="vid", payload=["vid"], valid_at=F.to_date("day"), salt_rows=40).collect()}
    for i, k, a, b in points:
        mine = [(d, r, n) for n, c, d, r in versions if c == k and d <= a]
        right = max((x for x in mine if x[1] <= b), default=None)
        assert got[i] == ((right[2] if right else -1, right != max(mine)) if mine else (None, None))
    cells = seen[0].groupBy("_k", "_cv", "_cr").count().where("_k = 'HOT'")
    assert cells.count() > 200 and cells.agg(F.avg("count")).first()[0] < 20


# 2. references to records that do not exist


def test_orphans(spark):
    parents = spark.createDataFrame([("a", 10, 20), ("a", 15, 30), ("a", 50, None), ("b", None, None), ("c", 5, 5), (None, 1, 2), ("d", 0, None)], "k string, f long, t long")
    refs = [(1, "a", 9), (2, "a", 10), (3, "a", 29), (4, "a", 30), (5, "a", 50), (6, "a", None), (7, "b", 3), (8, "b", None), (9, "c", 5), (10, "zz", None), (11, None, 3), (12, "d", 7), (10, "zz", None)]
    r = spark.createDataFrame(refs, "id long, k string, t long")
    for rows in (400_000, 2):
        got = find_orphans(r, parents, key=F.col("k"), parent_key=F.col("k"), at=F.col("t"), alive_from=F.col("f"), alive_to=F.col("t"), share_rows=rows)
        assert sorted(x.id for x in got.collect()) == [1, 4, 7, 9, 10, 10] and got.columns == r.columns
    held = find_orphans(r, parents, key=F.col("k"), parent_key=F.col("k"), at=F.col("t"), alive_from=F.col("f"), alive_to=F.col("t"), fixed=True)
    assert sorted(x.id for x in held.collect()) == [1, 4, 7, 9, 10, 10]
    none = find_orphans(r, parents.limit(0), key=F.col("k"), parent_key=F.col("k"))
    assert none.count() == 12 and find_orphans(r.limit(0), parents, key=F.col("k"), parent_key=F.col("k")).count() == 0


def test_orphans_against_brute_force(spark):
    rnd = random.Random(2)
    par = [(f"k{rnd.randint(0, 30)}", rnd.randint(0, 50), rnd.choice([None, rnd.randint(0, 80)])) for _ in range(60)]
    ref = [(i, f"k{rnd.choice([1, rnd.randint(0, 40)])}", rnd.choice([None, rnd.randint(0, 90)])) for i in range(600)]
    got = find_orphans(spark.createDataFrame(ref, "id long, k string, t long"), spark.createDataFrame(par, "k string, f long, u long"), key=F.col("k"), parent_key=F.col("k"), at=F.col("t"), alive_from=F.col("f"), alive_to=F.col("u"), share_rows=40)
    want = [i for i, k, t in ref if not any(a == k and (t is None or b <= t and (c is None or c > t)) for a, b, c in par)]
    assert sorted(x.id for x in got.collect()) == want


def test_more_ranges_than_a_case_tree_holds(spark):
    """Far over 256 ranges, a key of many lifetimes, and a hot key whose range is shared out."""
    par = spark.range(6000).select(F.format_string("k%05d", F.col("id") * 2).alias("k"), F.lit(0).cast("long").alias("f"), F.lit(None).cast("long").alias("t"))
    many = spark.range(4000).select(F.lit("many").alias("k"), (F.col("id") * 10).alias("f"), (F.col("id") * 10 + 5 + F.col("id") % 2 * 5).alias("t"))
    refs = spark.range(9000).select("id", F.when(F.col("id") % 3 == 0, "k00001").otherwise(F.format_string("k%05d", F.col("id"))).alias("k"), F.col("id").alias("t"))
    refs = refs.union(spark.range(40_000).select(F.col("id") + 10_000, F.lit("many"), F.col("id")))
    got = find_orphans(refs, par.union(many), key=F.col("k"), parent_key=F.col("k"), at=F.col("t"), alive_from=F.col("f"), alive_to=F.col("t"), range_keys=15, share_rows=3000)
    want = {i for i in range(9000) if i % 3 == 0 or i % 2} | {10_000 + i for i in range(40_000) if i % 10 >= 5 and i // 10 % 2 == 0}
    assert sorted(r.id for r in got.collect()) == sorted(want)


# 3. rolling totals


def test_nodes_cover_exactly_their_days():
    for lo in range(16):
        for hi in range(lo, 16):
            days = []
            for n in nodes_of(lo, hi, 16):
                width = 16 >> (n.bit_length() - 1)
                days += range((n - (1 << (n.bit_length() - 1))) * width, (n - (1 << (n.bit_length() - 1))) * width + width)
            assert sorted(days) == list(range(lo, hi + 1))


def brute_totals(rows, w):
    out = {}
    for e in {e for e, _, _ in rows}:
        days = [d for x, d, _ in rows if x == e]
        for d in range(min(days), max(days) + 1):
            v = [x for k, y, x in rows if k == e and d - w < y <= d and x is not None]
            out[e, d] = (round(sum(v), 6), len({y for k, y, x in rows if k == e and d - w < y <= d and x is not None}))
    return out


def test_trailing_totals(spark):
    rnd = random.Random(3)
    rows = [(e, d, rnd.choice([None, round(rnd.uniform(-5, 5), 3)])) for e in ("x", "y") for d in sorted(rnd.sample(range(18900, 19300), 70))] + [("z", 19000, 1.0)]
    df = spark.createDataFrame([*rows, (None, 3, 1.0), ("x", None, 1.0)], "e string, d int, v double").withColumn("age", F.lit("clash"))
    got = trailing_totals(df, entity="e", day="d", values=["v"]).collect()
    for w in (7, 30):
        want = brute_totals(rows, w)
        assert {(r.e, r.d): (round(r[f"v_sum_{w}"], 6), r[f"v_count_{w}"]) for r in got} == want
        assert all((r[f"v_mean_{w}"] is None) == (r[f"v_count_{w}"] == 0) for r in got)
    assert trailing_totals(df.limit(0), entity="e", day="d", values=["v"]).count() == 0


def test_corrections_equal_a_rebuild(spark):
    rows = [("x", 19000 + k, float(k)) for k in range(0, 150, 3)]
    df = spark.createDataFrame(rows, "e string, d int, v double")
    late = spark.createDataFrame([("x", 19003, 7.5, 0), ("x", 19004, 2.0, 1), ("new", 19000, 1.0, 1), (None, 1, 1.0, 1)], "e string, d int, s double, c int")
    fixed = apply_corrections(build_trees(df, entity="e", day="d", value="v"), late, entity="e", day="d", d_sum="s", d_count="c")
    whole = build_trees(spark.createDataFrame([(e, d, v + 7.5 if d == 19003 else v) for e, d, v in rows] + [("x", 19004, 2.0), ("new", 19000, 1.0)], df.schema), entity="e", day="d", value="v")
    tidy = lambda t: sorted((r.entity, r.shard, [round(x, 6) for x in r.sums], list(r.counts)) for r in t.collect())
    assert tidy(fixed) == tidy(whole)
    answers = query_trees(fixed.where("entity = 'x'"), (7, 30)).collect()
    got = {r.day: (round(r.total_30, 6), r.n_30) for r in answers}
    week = brute_totals([(r.e, r.d, r.v) for r in df.collect() if r.d != 19003] + [("x", 19003, 8.5 + 2), ("x", 19004, 2.0)], 7)
    assert all((round(r.total_7, 6), r.n_7) == week["x", r.day] for r in answers if ("x", r.day) in week)
    want = brute_totals([(r.e, r.d, r.v) for r in df.collect() if r.d != 19003] + [("x", 19003, 8.5 + 2), ("x", 19004, 2.0)], 30)
    assert all(got[d] == want["x", d] for _, d in want)


# 4. regular grid


def test_smoother_equals_dense_posterior():
    rnd = np.random.default_rng(4)
    times = np.sort(rnd.uniform(0, 20, 12))
    y = np.cumsum(rnd.normal(size=12))
    y[[3, 4, 8, 11]] = np.nan
    var, q, qs = 0.2, 0.5, 0.05
    m, p, last = smooth(times[:, None], y[:, None], np.array([var]), np.array([q]), np.array([qs]))
    # the same model written as one Gaussian: start (level, slope) and the integrated noises
    t = times - times[0]
    lo = np.minimum.outer(t, t)
    cov = (1e4 * var + 1) + (10 * q + 1e-12) * np.outer(t, t) + q * lo + qs * (lo**2 * np.maximum.outer(t, t) / 2 - lo**3 / 6)
    seen = ~np.isnan(y)
    k = cov[:, seen] @ np.linalg.inv(cov[np.ix_(seen, seen)] + var * np.eye(seen.sum()))
    mean = y[0] + k @ (y[seen] - y[0])
    assert np.allclose(m[:, 0], mean, atol=1e-3)
    assert np.allclose(p[:, 0], np.diag(cov - k @ cov[seen]), atol=1e-3)
    assert last[:, 0].tolist() == [0, 1, 2, 2, 2, 5, 6, 7, 7, 9, 10, 10]


def test_grid(spark):
    sessions = ["20220103", "20220104", "20220105", "20220106", "20220107"]
    rows = [(1, "a", "2022-01-03 10:00:00", 5.0), (2, "A ", "2022-01-03 15:00:00", 6.0), (3, "a", "2022-01-03 15:00:01", 7.0), (3, "a", "2022-01-03 15:00:01", 7.0), (4, "a", "2022-01-05 09:00:00", float("nan")), (5, "a", "2022-01-05 09:00:00", -1.0), (6, "a", "2022-01-07 09:00:00", 8.0), (7, "a", "2022-01-07 16:00:00", 9.0), (8, None, "2022-01-03 10:00:00", 5.0), (9, "b", None, 5.0), (10, "c", "2022-01-08 10:00:00", 5.0), (11, "d", "2022-01-01 10:00:00", 2.0)]
    df = spark.createDataFrame(rows, "id long, code string, at string, v double").withColumn("at", F.to_timestamp_ntz("at")).withColumn("source", F.lit(1))
    got = {(r.source, r.trade_date): (r.missing, r.read_id, r.value) for r in regular_grid(df, sessions, source="code", time="at", value="v", read_id="id").collect()}
    assert got == {("A", "20220103"): (False, 2, 6.0), ("A", "20220104"): (False, 3, 7.0), ("A", "20220105"): (True, 3, 7.0), ("A", "20220106"): (True, 3, 7.0), ("A", "20220107"): (False, 6, 8.0), ("D", "20220103"): (False, 11, 2.0)}
    assert regular_grid(df.limit(0), sessions, source="code", time="at", value="v", read_id="id").count() == 0
    assert regular_grid(df, [], source="code", time="at", value="v", read_id="id").count() == 0


@pytest.mark.parametrize(("hot", "cell_rows"), [(1, 200_000), (40, 200_000), (40, 16)])
def test_smoothed_uses_every_reading(spark, hot, cell_rows):
    rnd = np.random.default_rng(5)
    days = [f"202201{d:02d}" for d in (3, 4, 5, 6, 7, 10, 11, 12)]
    start, day = np.datetime64("2022-01-03T00:00:00"), np.timedelta64(1, "D")
    rows, want = [], {}
    closes = np.array([(np.datetime64(f"{d[:4]}-{d[4:6]}-{d[6:]}T15:00:00") - start) / day for d in days])
    for code, n in (("A", 12), ("B", 15 * hot), ("C", 1), ("D", 3)):
        at = np.sort(rnd.integers(0, 9 * 86400, n)) if code != "D" else np.array([50_000, 50_000, 4 * 86400])
        y = 3 + np.cumsum(rnd.normal(size=n)) * 0.02
        rows += [(len(rows) + i, code, str(start + np.timedelta64(int(a), "s")), float(np.exp(v))) for i, (a, v) in enumerate(zip(at, y))]
        t = at / 86400
        ok = slice(np.searchsorted(closes, t[0]), np.searchsorted(closes, t[-1]) + 1)
        q = max(np.mean(np.diff(y) ** 2 / (0.9 * np.diff(t) + 0.1)), 1e-10) if n > 1 else 1e-4
        times, ys = np.concatenate([t, closes[ok]]), np.concatenate([y, np.full(len(closes[ok]), np.nan)])
        order = np.lexsort((np.isnan(ys), times))
        one = lambda x: np.array([x])
        level, var, _ = smooth(times[order][:, None], ys[order][:, None], one(0.05 * q), one(0.9 * q), one(1e-4 * q))
        want |= {(code, d): (np.exp(level[k, 0]), np.sqrt(var[k, 0])) for d, k in zip(days[ok], np.nonzero(np.isnan(ys[order]))[0])}
    df = spark.createDataFrame([*rows, *rows[:5]], "id long, code string, at string, v double").withColumn("at", F.to_timestamp_ntz("at"))
    got = {(r.source, r.trade_date): (r.smoothed, r.smoothed_sd) for r in regular_grid(df, days, source="code", time="at", value="v", read_id="id", cell_rows=cell_rows).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-6) for k in want)


# 5. profile


@pytest.mark.parametrize("dictionary", [True, False])
def test_profile_against_brute_force(spark, tmp_path, dictionary):
    rnd = random.Random(6)
    rows = [(1 + k // 40, rnd.choice([0.5, 0.25, -0.0, 0.0, None, float("nan"), float("inf"), 9.0]), 3.0 if k < 40 else None if k < 80 else rnd.random(), rnd.choice(["12345678", "bad", None]) if k >= 40 else "12345678") for k in range(160)]
    t = pa.table({"load": pa.array([r[0] for r in rows], pa.int32()), "x": pa.array([r[1] for r in rows], pa.float64()), "c": pa.array([r[2] for r in rows], pa.float64()), "s": pa.array([r[3] for r in rows], pa.string())})
    tmp_path = tmp_path / "a b"
    (tmp_path / "t.parquet").mkdir(parents=True)
    for k in range(2):  # row groups of one load, and of two
        pq.write_table(t.slice(80 * k, 80), tmp_path / f"t.parquet/{k}.parquet", row_group_size=40 if k == 0 else 60, use_dictionary=dictionary)
    got = {(r.column_name, r.load_id): r for r in profile(spark, str(tmp_path / "t.parquet"), load="load", numeric={"x": (0.0, 1.0), "c": (0.0, 5.0)}, patterns={"s": "[0-9]{8}"}).collect()}
    assert len(got) == 12
    for (col, load), r in got.items():
        raw = [x[1 + ["x", "c", "s"].index(col)] for x in rows if x[0] == load]
        some = [v for v in raw if v is not None]
        assert r.n_rows == 40 and r.n_null == 40 - len(some)
        if col == "s":
            assert (r.n_finite, r.n_bad) == (len(some), sum(v == "bad" for v in some)) and r.n_distinct == len(set(some))
            continue
        fin = [v for v in some if np.isfinite(v)]
        ins = [v for v in fin if 0 <= v <= (1 if col == "x" else 5)]
        assert (r.n_finite, r.n_in) == (len(fin), len(ins)) and (r.lo, r.hi) == ((min(fin), max(fin)) if fin else (None, None))
        assert r.n_distinct == len({"nan" if np.isnan(v) else v + 0.0 for v in some})
        if ins:
            assert r["mean"] == pytest.approx(np.mean(ins)) and r["std"] == pytest.approx(np.std(ins), abs=1e-9)
        else:
            assert r["mean"] is None


def test_profile_of_columns_without_a_rule(spark, tmp_path):
    rows = [(1, 10, "b", 1.0, 5), (1, 9, "a", float("inf"), None), (2, 2**60 + 1, None, 7e9, 7), (2, 2**60, "", -2.0, 7)]
    df = spark.createDataFrame(rows, "load int, id long, s string, x double, us long")
    df.select("load", "id", "s", "x", F.timestamp_micros("us").cast("timestamp_ntz").alias("at")).coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    args = {"load": "load", "numeric": {"x": None}, "patterns": {"s": None}}
    got = {(r.column_name, r.load_id): r for r in profile(spark, str(tmp_path / "t.parquet"), whole=["id", "at", "load"], **args).collect()}
    assert {k: (r.n_finite, r.lo, r.hi, r.lo_txt, r.hi_txt, r.n_distinct, r.bad_share) for k, r in got.items()} == {
        ("id", 1): (2, None, None, "9", "10", 2, None), ("id", 2): (2, None, None, str(2**60), str(2**60 + 1), 2, None), ("at", 1): (1, None, None, "5", "5", 1, None), ("at", 2): (2, None, None, "7", "7", 1, None), ("load", 1): (2, None, None, "1", "1", 1, None),
        ("load", 2): (2, None, None, "2", "2", 1, None), ("s", 1): (2, None, None, "a", "b", 2, None), ("s", 2): (1, None, None, "", "", 1, None), ("x", 1): (1, 1.0, 1.0, None, None, 2, None), ("x", 2): (2, -2.0, 7e9, None, None, 2, None),
    }
    assert (got["s", 2].prev_coverage, got["s", 2].coverage, got["s", 2].prev_distinct, got["s", 1].prev_distinct) == (1.0, 0.5, 2, None)
    with pytest.raises(TypeError):
        profile(spark, str(tmp_path / "t.parquet"), whole=["x"], **args)


# 6. top N


@pytest.mark.parametrize("parts", [1, 7])
def test_top_n(spark, parts):
    rnd = random.Random(7)
    rows = [(rnd.choice(["hot", "hot", "hot", "g1", "g2", None]), i, rnd.choice([None, 1.0, 2.0, 3.0])) for i in range(900)] + [("one", 5000, 1.0)]
    df = spark.createDataFrame(rows, "g string, id long, s double").withColumn("position", F.lit("x")).drop("position").withColumn("_x", F.lit(1))
    got = top_n(df, groups=["g"], order=[F.col("s").desc_nulls_last(), F.col("id").asc()], n=5, partitions=parts).collect()
    for g in {r[0] for r in rows}:
        mine = sorted((x for x in rows if x[0] == g), key=lambda x: (x[2] is None, -(x[2] or 0), x[1]))
        assert [r.id for r in sorted((r for r in got if r.g == g), key=lambda r: r.position)] == [x[1] for x in mine[:5]]
        assert {r.group_rows for r in got if r.g == g} == {len(mine)}
    assert top_n(df.limit(0), groups=["g"], order=[F.col("s")], n=5).count() == 0
    same = spark.createDataFrame([("a", 1.0)] * 50, "g string, s double")
    assert [r.position for r in top_n(same, groups=["g"], order=[F.col("s")], n=3, partitions=4).collect()] == [1, 2, 3]
