"""Irregular readings onto a regular grid of sessions.

A Kalman filter with a continuous-time local linear trend (level and slope of the logarithm, white-noise driven) runs over
all usable readings at their own times. The readings of one source and session are first put together into one element: how
the state at the first of them leads to the state at the session's close, and what they say of the former. Elements combine
exactly, as in a parallel scan, so a source is bounded by the calendar without leaving out a reading, and a session of very many
readings is cut into spans of time whose elements are made apart. All variances of the
model are multiples of the source's q, so elements are made for q = 1 and scaled when q is known from all the pairs of
neighbouring readings. A pass forward and one backward over a source's sessions, sources side by side, give at every close
the smoothed level and its standard deviation, beside whether the session lacked a reading and the reading last assimilated,
which fills it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..common import checkpoint, finite, micros, norm_code

DAY = 86_400_000_000
CLOSE = 15 * 3_600_000_000


def smooth(times: np.ndarray, y: np.ndarray, var: np.ndarray, q: np.ndarray, q_slope: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smoothed levels, their variances and the position of the reading last assimilated (-1: none).

    times and y are (steps, n): each column a source, its steps in time order; y is NaN where a step only evaluates.
    var (n) is the variance of a reading, q and q_slope (n) the variances a day of the level's and the slope's noise.
    """
    steps, n = times.shape
    m = np.zeros((steps, 2, n))
    p = np.zeros((steps, 3, n))  # level, level-slope, slope
    mp, pp = np.zeros_like(m), np.zeros_like(p)
    last = np.full((steps, n), -1, dtype=np.int64)
    has_any = np.zeros(n, dtype=bool)
    for k in range(steps):
        if k:
            dt = times[k] - times[k - 1]
            l0, s0 = m[k - 1]
            a, b, c = p[k - 1]
            mp[k] = l0 + dt * s0, s0
            pp[k] = a + 2 * dt * b + dt * dt * c + q * dt + q_slope * dt**3 / 3, b + dt * c + q_slope * dt**2 / 2, c + q_slope * dt
            last[k] = last[k - 1]
        seen = ~np.isnan(y[k])
        fresh = seen & ~has_any
        if fresh.any():  # a source starts at its first reading, with an unknown slope
            mp[k][:, fresh] = np.stack([y[k][fresh], np.zeros(fresh.sum())])
            pp[k][:, fresh] = np.stack([1e4 * var[fresh] + 1, np.zeros(fresh.sum()), 10 * q[fresh] + 1e-12])
            has_any |= fresh
        a, b, c = pp[k]
        s = a + var
        g0, g1 = np.where(seen, a / s, 0), np.where(seen, b / s, 0)
        r = np.where(seen, np.where(seen, y[k], 0) - mp[k, 0], 0)
        m[k] = mp[k, 0] + g0 * r, mp[k, 1] + g1 * r
        p[k] = a - g0 * a, b - g0 * b, c - g1 * b
        last[k] = np.where(seen, k, last[k])
    for k in range(steps - 2, -1, -1):  # Rauch-Tung-Striebel
        dt = times[k + 1] - times[k]
        a, b, c = p[k]
        ap, bp, cp = pp[k + 1]
        det = ap * cp - bp * bp
        ok = (det > 1e-300) & (last[k] >= 0)
        inv = np.where(ok, 1 / np.where(ok, det, 1), 0)
        # gain G = P F' inv(P predicted)
        u0, u1, w0, w1 = a + dt * b, b, b + dt * c, c
        g00, g01 = (u0 * cp - u1 * bp) * inv, (u1 * ap - u0 * bp) * inv
        g10, g11 = (w0 * cp - w1 * bp) * inv, (w1 * ap - w0 * bp) * inv
        d0, d1 = m[k + 1] - mp[k + 1]
        da, db, dc = p[k + 1] - pp[k + 1]
        m[k] += np.stack([g00 * d0 + g01 * d1, g10 * d0 + g11 * d1])
        p[k] += np.stack([
            g00 * (g00 * da + g01 * db) + g01 * (g00 * db + g01 * dc),
            g10 * (g00 * da + g01 * db) + g11 * (g00 * db + g01 * dc),
            g10 * (g10 * da + g11 * db) + g11 * (g10 * db + g11 * dc),
        ])
    return m[:, 0], np.maximum(p[:, 0], 0), last


EVERY = 16  # one reading in so many tells which sessions are crowded
#: Variances of a reading and, a day, of the level's and the slope's noise, as multiples of q.
VAR, LEVEL, SLOPE = 0.05, 0.9, 1e-4
CELL = T.StructType([T.StructField("_source", T.StringType()), T.StructField("_session", T.IntegerType()), T.StructField("_cell", T.StructType([
    T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("y_first", T.DoubleType()), T.StructField("y_last", T.DoubleType()), T.StructField("rate", T.DoubleType()),
    T.StructField("pairs", T.LongType()), T.StructField("id", T.LongType()), T.StructField("value", T.DoubleType()), T.StructField("element", T.ArrayType(T.DoubleType())),
]))])


def _step(dt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Transition (n, 2, 2) over dt days and its noise for q = 1."""
    one = np.ones_like(dt)
    return np.stack([one, dt, 0 * dt, one], -1).reshape(-1, 2, 2), np.stack([LEVEL * dt + SLOPE * dt**3 / 3, SLOPE * dt**2 / 2, SLOPE * dt**2 / 2, SLOPE * dt], -1).reshape(-1, 2, 2)


def _rate(d: np.ndarray, dt: np.ndarray) -> np.ndarray:
    """q by one pair of neighbouring readings: the square of their difference over what is expected of it at q = 1."""
    return d * d / (LEVEL * dt + 2 * VAR)


def _dot(a: np.ndarray, v: np.ndarray) -> np.ndarray:
    return (a @ v[..., None])[..., 0]


def _inv(a: np.ndarray) -> np.ndarray:
    det = a[..., 0, 0] * a[..., 1, 1] - a[..., 0, 1] * a[..., 1, 0]
    return np.stack([a[..., 1, 1], -a[..., 0, 1], -a[..., 1, 0], a[..., 0, 0]], -1).reshape(a.shape) / det[..., None, None]


def _cells(schema: pa.Schema, closes: np.ndarray | None):
    """(source, session, readings in order) to one element a row: A (4), b (2), C (4), eta (2), J (4).

    Given the state x at the first reading's time, the state at the close (without closes: at the last reading) is
    N(A x + b, C), and the readings' likelihood in x is proportional to exp(eta x - x J x / 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            off = batch.column("_reads").offsets.to_numpy()
            at, rid, value = (batch.column("_reads").flatten().field(k).to_numpy(zero_copy_only=False) for k in range(3))
            start, size = off[:-1] - off[0], np.diff(off)
            order = np.argsort(-size, kind="stable")  # those with a k-th reading come first
            start, size = start[order], size[order]
            y, t = np.log(value), at / DAY
            a, b, c, eta, j = np.tile(np.eye(2), (n, 1, 1)), np.zeros((n, 2)), np.zeros((n, 2, 2)), np.zeros((n, 2)), np.zeros((n, 2, 2))
            rate = np.zeros(n)
            for k in range(size[0]):
                m = np.searchsorted(-size, -k, side="left")  # cells of more than k readings
                now = start[:m] + k
                if k:
                    dt = (at[now] - at[now - 1]) / DAY
                    f, q = _step(dt)
                    a[:m], b[:m], c[:m] = f @ a[:m], _dot(f, b[:m]), f @ c[:m] @ f.swapaxes(1, 2) + q
                    rate[:m] += _rate(y[now] - y[now - 1], dt)
                h, s, r = a[:m, 0].copy(), c[:m, 0, 0] + VAR, y[now] - b[:m, 0]
                g = c[:m, :, 0] / s[:, None]
                eta[:m] += h * (r / s)[:, None]
                j[:m] += h[:, :, None] * h[:, None, :] / s[:, None, None]
                a[:m] -= g[:, :, None] * h[:, None, :]
                b[:m] += g * r[:, None]
                c[:m] -= g[:, :, None] * c[:m, :1, :]
            end = start + size - 1
            session = batch.column("_session").to_numpy()[order]
            if closes is not None:
                f, q = _step((closes[session] - at[end]) / DAY)
                a, b, c = f @ a, _dot(f, b), f @ c @ f.swapaxes(1, 2) + q
            parts = [at[start], at[end], y[start], y[end], rate, size.astype(np.int64) - 1, rid[end], value[end]]
            yield pa.RecordBatch.from_arrays([batch.column("_source").take(pa.array(order)), pa.array(session), _packed(schema, parts, a, b, c, eta, j)], schema=schema)

    return run


def _packed(schema: pa.Schema, parts: list[np.ndarray], a: np.ndarray, b: np.ndarray, c: np.ndarray, eta: np.ndarray, j: np.ndarray) -> pa.StructArray:
    n = len(a)
    flat = np.hstack([a.reshape(n, 4), b, c.reshape(n, 4), eta, j.reshape(n, 4)])
    element = pa.ListArray.from_arrays(pa.array(np.arange(0, 16 * n + 1, 16, dtype=np.int32)), pa.array(flat.ravel()))
    kind = schema.field("_cell").type
    return pa.StructArray.from_arrays([*[pa.array(x) for x in parts], element.cast(kind.field("element").type)], fields=list(kind))


def _unpacked(e: np.ndarray) -> tuple[np.ndarray, ...]:
    return e[:, :4].reshape(-1, 2, 2), e[:, 4:6], e[:, 6:10].reshape(-1, 2, 2), e[:, 10:12], e[:, 12:].reshape(-1, 2, 2)


def _joined(schema: pa.Schema, closes: np.ndarray):
    """(source, session, cells of its spans of time) to the session's one cell, at its close: the spans' elements combined in
    order, each taken on to the next one's first reading."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        eye = np.eye(2)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            off = batch.column("_spans").offsets.to_numpy()
            start, size = off[:-1] - off[0], np.diff(off)
            flat = batch.column("_spans").flatten()
            parts = [flat.field(k).to_numpy(zero_copy_only=False) for k in range(8)]
            first = parts[0]
            order = np.lexsort((first, np.repeat(np.arange(n), size)))
            first, last, y_first, y_last, rate, pairs, rid, value = (x[order] for x in parts)
            a2, b2, c2, eta2, j2 = _unpacked(flat.field(8).flatten().to_numpy().reshape(-1, 16)[order])
            a, b, c, eta, j = (x[start] for x in (a2, b2, c2, eta2, j2))
            total, count = rate[start], pairs[start]
            for k in range(1, int(size.max())):
                w = np.nonzero(size > k)[0]
                now = start[w] + k
                dt = (first[now] - last[now - 1]) / DAY
                f, q = _step(dt)
                aw, bw, cw = f @ a[w], _dot(f, b[w]), f @ c[w] @ f.swapaxes(1, 2) + q
                x = a2[now] @ _inv(eye + cw @ j2[now])
                z = aw.swapaxes(1, 2) @ _inv(eye + j2[now] @ cw)
                eta[w] += _dot(z, eta2[now] - _dot(j2[now], bw))
                j[w] += z @ j2[now] @ aw
                b[w] = _dot(x, bw + _dot(cw, eta2[now])) + b2[now]
                c[w] = x @ cw @ a2[now].swapaxes(1, 2) + c2[now]
                a[w] = x @ aw
                total[w] += rate[now] + _rate(y_first[now] - y_last[now - 1], dt)
                count[w] += pairs[now] + 1
            end = start + size - 1
            session = batch.column("_session").to_numpy()
            f, q = _step((closes[session] - last[end]) / DAY)
            a, b, c = f @ a, _dot(f, b), f @ c @ f.swapaxes(1, 2) + q
            cell = _packed(schema, [first[start], last[end], y_first[start], y_last[end], total, count, rid[end], value[end]], a, b, c, eta, j)
            yield pa.RecordBatch.from_arrays([batch.column("_source"), pa.array(session), cell], schema=schema)

    return run


def _evaluate(schema: pa.Schema, closes: np.ndarray, cells: int = 400_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, cells // max(1, len(closes)))
        for whole in batches:
            for k in range(0, whole.num_rows, step):
                yield from _one(whole.slice(k, step))

    def _one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lists = batch.column("_cells")
        off = lists.offsets.to_numpy()
        off = off - off[0]
        n = batch.num_rows
        who = np.repeat(np.arange(n), np.diff(off))
        flat = lists.flatten()
        session, inner = flat.field(0).to_numpy(), flat.field(1)
        order = np.lexsort((session, who))
        session, who = session[order], who[order]
        first_at, last_at, y_first, y_last, rate, pairs, rid, value = (inner.field(k).to_numpy(zero_copy_only=False)[order] for k in range(8))
        e = inner.field(8).flatten().to_numpy().reshape(-1, 16)[order]
        first, last = session[off[:-1]], session[off[1:] - 1]
        lo = first.min()
        width = last.max() - lo + 1
        grid = closes[lo : lo + width]
        next_to = who[1:] == who[:-1]
        between = _rate(y_first[1:] - y_last[:-1], (first_at[1:] - last_at[:-1]) / DAY)
        total = np.bincount(who, weights=rate, minlength=n) + np.bincount(who[1:][next_to], weights=between[next_to], minlength=n)
        hits = np.bincount(who, weights=pairs, minlength=n) + np.bincount(who[1:][next_to], minlength=n)
        q = np.maximum(np.where(hits > 0, total / np.maximum(hits, 1), 1e-4), 1e-10)
        cell = np.full((width, n), -1)
        cell[session - lo, who] = np.arange(len(who))
        has = cell >= 0
        eye, scale = np.eye(2), q[who][:, None]
        a, b, c, eta, j = e[:, :4].reshape(-1, 2, 2), e[:, 4:6], (e[:, 6:10] * scale).reshape(-1, 2, 2), e[:, 10:12] / scale, (e[:, 12:] / scale).reshape(-1, 2, 2)
        mean, cov = np.zeros((width, n, 2)), np.zeros((width, n, 2, 2))
        m, p = np.zeros((n, 2)), np.zeros((n, 2, 2))
        fill, source_last = np.full((width, n), -1), np.full(n, -1)
        alive = lambda s: (s + lo >= first) & (s + lo <= last)

        def leap(s: int) -> np.ndarray:
            """Days from the close before to the session's first reading, or its close."""
            return np.where(has[s], first_at[cell[s]] - grid[s - 1], grid[s] - grid[s - 1]) / DAY if s else np.zeros(n)

        for s in range(width):
            new, k = first - lo == s, cell[s]
            f, noise = _step(np.where(new, 0, leap(s)))
            m, p = _dot(f, m), f @ p @ f.swapaxes(1, 2) + noise * q[:, None, None]
            if new.any():  # a source starts at its first reading, with an unknown slope
                m[new] = np.stack([y_first[k[new]], np.zeros(new.sum())], -1)
                p[new] = 0
                p[new, 0, 0], p[new, 1, 1] = 1e4 * VAR * q[new] + 1, 10 * LEVEL * q[new] + 1e-12
            w = np.nonzero(has[s])[0]
            k = k[w]
            x = a[k] @ _inv(eye + p[w] @ j[k])
            m[w], p[w] = _dot(x, m[w] + _dot(p[w], eta[k])) + b[k], x @ p[w] @ a[k].swapaxes(1, 2) + c[k]
            source_last[w] = k
            mean[s], cov[s], fill[s] = m, p, source_last
        back, info = np.zeros((n, 2)), np.zeros((n, 2, 2))  # what the readings after a close say of the state there
        for s in range(width - 1, -1, -1):
            x = _inv(eye + cov[s] @ info)
            mean[s], cov[s] = _dot(x, mean[s] + _dot(cov[s], back)), x @ cov[s]
            w = np.nonzero(has[s])[0]
            k = cell[s][w]
            x = a[k].swapaxes(1, 2) @ _inv(eye + info[w] @ c[k])
            back[w], info[w] = _dot(x, back[w] - _dot(info[w], b[k])) + eta[k], x @ info[w] @ a[k] + j[k]
            f, noise = _step(np.where(first - lo >= s, 0, leap(s)))
            x = f.swapaxes(1, 2) @ _inv(eye + info @ (noise * q[:, None, None]))
            back, info = _dot(x, back), x @ info @ f
        s, w = np.nonzero(np.stack([alive(s) for s in range(width)]))
        k = fill[s, w]
        yield pa.RecordBatch.from_arrays([
            batch.column("_source").take(pa.array(w)), pa.array((s + lo).astype(np.int32)), pa.array(~has[s, w]), pa.array(rid[k]), pa.array(value[k]),
            pa.array(np.exp(mean[s, w, 0])), pa.array(np.sqrt(np.maximum(cov[s, w, 0, 0], 0))),
        ], schema=schema)

    return run


def regular_grid(reads: DataFrame, sessions: list[str], *, source: str, time: str, value: str, read_id: str, cell_rows: int = 200_000) -> DataFrame:
    """(source, trade_date, missing, read_id, value, smoothed, smoothed_sd) for every source and session.

    ``sessions`` are the calendar's open days (YYYYMMDD). A usable reading is finite and positive; it belongs to the first
    session whose close (15:00) is not before its time; readings after the last session are dropped. A source's grid runs
    from its first to its last session with a usable reading. A session without one is ``missing`` and carries the
    reading (read_id, value) last assimilated before: that of the latest earlier session with the greatest time, then id.
    smoothed and smoothed_sd come from the smoother over all usable readings (sd of the logarithm). Rows lacking source or time are left out,
    repeated readings count once; no usable reading gives no rows.
    """
    closes = [(np.datetime64(f"{s[:4]}-{s[4:6]}-{s[6:]}") - np.datetime64("1970-01-01")).astype(int) * DAY + CLOSE for s in sorted(set(sessions))]
    out = T.StructType([T.StructField("source", T.StringType()), T.StructField("session", T.IntegerType()), T.StructField("missing", T.BooleanType()), T.StructField("read_id", T.LongType()), T.StructField("value", T.DoubleType()), T.StructField("smoothed", T.DoubleType()), T.StructField("smoothed_sd", T.DoubleType())])
    spark = reads.sparkSession
    if not closes:
        return spark.createDataFrame([], "source string, trade_date string, missing boolean, read_id bigint, value double, smoothed double, smoothed_sd double")
    # the calendar day a reading counts for, and the first session on or after it; one row a calendar day
    days = np.array([c // DAY for c in closes])
    span = np.arange(days[0] - 1, days[-1] + 1)
    cal = spark.createDataFrame([(int(d), int(np.searchsorted(days, d))) for d in span], "_day int, _session int")
    name = spark.createDataFrame([(i, s) for i, s in enumerate(sorted(set(sessions)))], "session int, trade_date string")
    usable = (
        reads.select(norm_code(source).alias("_source"), micros(time).alias("_at"), finite(value).alias("_value"), F.col(read_id).cast("bigint").alias("_id"))
        .where("_source is not null and _at is not null and _value > 0")
        .withColumn("_day", F.greatest(F.ceil((F.col("_at") - CLOSE) / DAY).cast("int"), F.lit(int(days[0]))))
        .join(F.broadcast(cal), "_day")
    )
    # a sample tells which sessions of a source hold more readings than a task should gather, and how long a span of them may be
    seen = usable.sample(1 / EVERY, seed=1).groupBy("_source", "_session").agg(F.count(F.lit(1)).alias("n"), (F.max("_at") - F.min("_at") + 1).alias("long")).where(F.col("n") * EVERY > cell_rows)
    hot = checkpoint(seen.select("_source", "_session", F.greatest(F.lit(1), F.floor(F.col("long") * cell_rows / (F.col("n") * EVERY))).cast("bigint").alias("_width")))
    n_hot = hot.count()
    keys = ["_source", "_session"]
    if n_hot:
        usable = usable.join(F.broadcast(hot) if n_hot <= 50_000 else hot, keys, "left").withColumn("_span", F.coalesce(F.floor(F.col("_at") / F.col("_width")), F.lit(0)))
    rows = usable.groupBy(*keys, *(["_span"] if n_hot else [])).agg(F.sort_array(F.collect_set(F.struct("_at", "_id", "_value"))).alias("_reads"))
    rows = rows.select("_source", F.col("_session").cast("int").alias("_session"), "_reads")
    at_close, cell = np.array(closes, dtype=np.int64), to_arrow_schema(CELL)
    if n_hot:
        spans = rows.mapInArrow(_cells(cell, None), CELL).groupBy(*keys).agg(F.collect_list("_cell").alias("_spans"))
        cells = spans.mapInArrow(_joined(cell, at_close), CELL)
    else:
        cells = rows.mapInArrow(_cells(cell, at_close), CELL)
    per = cells.groupBy("_source").agg(F.collect_list(F.struct("_session", "_cell")).alias("_cells"))
    filled = per.mapInArrow(_evaluate(to_arrow_schema(out), at_close), out)
    return filled.join(F.broadcast(name), "session").select("source", "trade_date", "missing", "read_id", "value", "smoothed", "smoothed_sd")
