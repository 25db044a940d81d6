"""Attributes as known at event time.

Every version of an entity's attribute has a valid time (from which day it holds) and a recorded time (from when it
was known). Among the versions with ``valid <= v`` and ``recorded <= r`` the last in the order (valid, recorded, id)
is the current one at the point (v, r). The plane of an entity splits into disjoint rectangles with one current
version each. One stack pass over the versions in that order yields at most two rectangles a version: a new version
cuts the upper part off the nearest earlier version that was recorded before it, and ends those recorded later.

The rectangles are indexed by a grid of square cells (entity, valid cell, recorded cell), and every point is compared with
the rectangles of its own cell only. The width of a cell is that at which a column of cells holds ``cell_versions``
versions of a usual entity; crowded entities have narrower cells, down to a day. The rectangles of a column are made apart
from those of the others, so that no task holds all versions of an entity: what earlier columns hand on to it is the front
of versions not yet superseded at its left edge, within the recorded times its points have. An entity has at most as many
columns as the calendar has days; one pass over their earliest recorded times tells which column's front to take where.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..common import checkpoint, day_number, micros, norm_code

EVER = 2**62  # recorded time: never superseded
LAST_DAY = 2**31 - 1
DAY_US = 86_400_000_000
UNKNOWN = -1  # id of the region in which versions are in force but none was known yet
WIDEST = 1024  # days
CELL = ["_k", "_cv", "_cr"]


class Stairs:
    """The stack pass: versions go in in order, rectangles (valid from, valid to, recorded from, recorded to, id, payload)
    come out. Intervals are half open; recorded to is EVER where nothing supersedes the version."""

    def __init__(self):
        self.stack: list[list] = []

    def add(self, v: int, r: int, i, p) -> Iterator[tuple]:
        stack = self.stack
        while stack and stack[-1][0] >= r:
            yield from _piece(stack.pop(), v)
        if stack:
            yield from _piece(stack[-1], v)
            stack[-1][1:3] = v, r
        stack.append([r, v, EVER, i, p])

    def end(self) -> Iterator[tuple]:
        for top in self.stack:
            yield from _piece(top, LAST_DAY)
        self.stack = []


def _piece(top: list, end: int) -> Iterator[tuple]:
    r, start, upper, i, p = top
    if start < end and r < upper:
        yield start, end, r, upper, i, p


def staircase(versions: list[tuple]) -> Iterator[tuple]:
    """Rectangles of a column's versions (valid, recorded, id, payload), given in order."""
    s = Stairs()
    for x in versions:
        yield from s.add(*x)
    yield from s.end()


def _rectangles_of(schema: pa.Schema):
    """(_k, _cv, _w, _lo, _hi, _v, _r, _id, _p), each column's versions in order, to rectangles, a row for each cell from
    _lo to _hi that one lies in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column, stairs, out = None, Stairs(), []

        def put(rects: Iterator[tuple]) -> None:
            k, cv, w, lo, hi = column
            for v1, v2, r1, r2, i, p in rects:
                for cr in range(max(lo, r1 // (w * DAY_US)), min(hi, (r2 - 1) // (w * DAY_US)) + 1):
                    out.append((k, cv, cr, v1, v2, r1, r2, i, p))

        for batch in batches:
            for *at, v, r, i, p in zip(*(batch.column(c).to_pylist() for c in ("_k", "_cv", "_w", "_lo", "_hi", "_v", "_r", "_id", "_p"))):
                if column is None or at != column:
                    if column:
                        put(stairs.end())
                    column = at
                put(stairs.add(v, r, i, p))
                if len(out) > 20_000:
                    yield _batch(out, schema)
                    out = []
        if column:
            put(stairs.end())
        if out:
            yield _batch(out, schema)

    return run


def _fronts_of(schema: pa.Schema):
    """An entity's columns in order (_k, _cv, earliest recorded time, recorded time of the last version, _w, _lo, _hi), the
    last three where it holds points, to what each column with points takes from earlier ones: (_k, _cv, _w, _lo, _hi,
    column, recorded from, recorded to). A row without a column stands for versions recorded after its points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, firsts, columns, last, out = None, [], [], None, []
        for batch in batches:
            for k, cv, first, final, w, lo, hi in zip(*(c.to_pylist() for c in batch.columns)):
                if k != key:
                    key, firsts, columns = k, [], []
                if w is not None and firsts:
                    a, b = lo * w * DAY_US, (hi + 1) * w * DAY_US
                    at, end = max(0, bisect_right(firsts, a) - 1), bisect_left(firsts, b)
                    for x in range(at, end):
                        out.append((k, cv, w, lo, hi, columns[x], max(a, firsts[x]), min(b, firsts[x + 1] if x + 1 < len(firsts) else EVER)))
                    if last >= b:
                        out.append((k, cv, w, lo, hi, None, b, EVER))
                if first is not None:
                    while firsts and firsts[-1] >= first:
                        firsts.pop()
                        columns.pop()
                    firsts.append(first)
                    columns.append(cv)
                    last = final
                if len(out) > 20_000:
                    yield _batch(out, schema)
                    out = []
        if out:
            yield _batch(out, schema)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)


def _days_a_cell(versions: Column, span: Column, each: int) -> Column:
    """The power of two of days, from 1 to WIDEST, in which ``each`` of the versions lie."""
    return F.pow(F.lit(2), F.floor(F.log2(F.greatest(F.lit(1.0), F.least(F.lit(float(WIDEST)), each * span / versions))))).cast("int")


def _in_cells(df: DataFrame, width: int, dense: DataFrame | None) -> DataFrame:
    """Adds _w, _cv and _cr."""
    df = df.withColumn("_w", F.lit(width)) if dense is None else df.join(dense, "_k", "left").withColumn("_w", F.coalesce("_w", F.lit(width)))
    return df.withColumns({"_cv": F.floor(F.col("_v") / F.col("_w")).cast("int"), "_cr": F.floor(F.floor(F.col("_r") / DAY_US) / F.col("_w")).cast("int")})


def _rectangles(base: DataFrame, occupied: DataFrame) -> DataFrame:
    """(_k, _cv, _cr, _v1, _v2, _r1, _r2, known_id, known): the rectangles in the occupied cells."""
    order = ["_v", "_r", "_id"]
    spans = occupied.groupBy("_k", "_cv", "_w").agg(F.min("_cr").alias("_lo"), F.max("_cr").alias("_hi"))
    heads = base.groupBy("_k", "_cv").agg(F.min("_r").alias("_first"), F.max(F.struct(*order)).alias("_last")).select("_k", "_cv", "_first", F.col("_last._r").alias("_final"))
    both = heads.join(spans, ["_k", "_cv"], "full").select("_k", "_cv", "_first", "_final", "_w", "_lo", "_hi")
    taken = T.StructType([T.StructField("_k", T.StringType()), *[T.StructField(c, T.IntegerType()) for c in ("_cv", "_w", "_lo", "_hi", "_from")], T.StructField("_a", T.LongType()), T.StructField("_b", T.LongType())])
    takes = both.repartition("_k").sortWithinPartitions("_k", "_cv").mapInArrow(_fronts_of(to_arrow_schema(taken)), taken)

    # the front at a column's right edge: versions that no later one of the column was recorded before
    ahead = F.min("_r").over(W.partitionBy("_k", "_cv").orderBy(*order).rowsBetween(1, W.unboundedFollowing))
    front = base.withColumn("_until", F.coalesce(ahead, F.lit(EVER))).where("_r < _until").select("_k", F.col("_cv").alias("_from"), "_r", "_until", "_id", "_p")
    cols = ["_k", "_cv", "_w", "_lo", "_hi", "_own", "_v", "_r", "_id", "_p"]
    edge = (F.col("_cv") * F.col("_w")).alias("_v")
    handed = takes.where("_from is not null").join(front, ["_k", "_from"]).where("_r < _b and _until > _a").withColumns({"_own": F.lit(0), "_v": edge}).select(cols)
    later = takes.where("_from is null").select("_k", "_cv", "_w", "_lo", "_hi", F.lit(0).alias("_own"), edge, F.col("_a").alias("_r"), F.lit(None).cast("bigint").alias("_id"), F.lit(None).cast(base.schema["_p"].dataType).alias("_p"))
    own = base.drop("_w").join(spans, ["_k", "_cv"]).withColumn("_own", F.lit(1)).select(cols)

    out = T.StructType([T.StructField("_k", T.StringType()), *[T.StructField(c, T.IntegerType()) for c in ("_cv", "_cr", "_v1", "_v2")], T.StructField("_r1", T.LongType()), T.StructField("_r2", T.LongType()), T.StructField("known_id", T.LongType()), T.StructField("known", base.schema["_p"].dataType)])
    rows = own.unionByName(handed).unionByName(later).repartition("_k", "_cv").sortWithinPartitions("_k", "_cv", "_own", *order)
    return rows.mapInArrow(_rectangles_of(to_arrow_schema(out)), out)


def known_at(
    points: DataFrame, versions: DataFrame, *, key: str, time: str, version_key: str, valid_from: str, recorded: str,
    version_id: str, payload: list[str], cell_versions: int = 4, valid_at: Column | None = None, salt_rows: int = 500_000,
) -> DataFrame:
    """Points with ``known_id``, ``known`` (struct of the payload columns) and ``revised``.

    known_id is the version in force on the point's day (``valid_at``, else the date of ``time``) as known at ``time``;
    UNKNOWN (-1) where versions are in force but none was known; NULL where none is in force or the point's key or time is
    NULL. revised tells whether the version that all later knowledge gives for that day is another one.
    Versions lacking key, valid or recorded time are ignored; repeated ones (same key, times, id) count once. Keys are
    compared after trimming and upper-casing. Points keep all their columns, whatever their names, and repeated points
    stay repeated; an empty side gives points without a version.
    """
    pay = F.struct(*[F.col(c) for c in payload])
    base = (
        versions.select(norm_code(version_key).alias("_k"), day_number(valid_from).alias("_v"), micros(recorded).alias("_r"), F.col(version_id).cast("bigint").alias("_id"), pay.alias("_p"))
        .where("_k is not null and _v is not null and _r is not null").dropDuplicates(["_k", "_v", "_r", "_id"])
    )
    p_type = base.schema["_p"].dataType
    base = checkpoint(base)
    per = base.groupBy("_k").agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_v"), (F.max("_v") - F.min("_v") + 1).alias("_span"))
    per = per.withColumn("_w", _days_a_cell(F.col("_n"), F.col("_span"), cell_versions))
    widths = per.groupBy("_w").agg(F.count(F.lit(1)).alias("keys"), F.sum("_n").alias("n"), F.sum("_span").alias("span")).collect()  # at most 11 rows
    if not widths:
        return points.withColumns({"known_id": F.lit(None).cast("bigint"), "known": F.lit(None).cast(p_type), "revised": F.lit(None).cast("boolean")})
    unknown = per.select("_k", "_v", F.lit(-EVER).alias("_r"), F.lit(UNKNOWN).cast("bigint").alias("_id"), F.lit(None).cast(p_type).alias("_p"))
    days = cell_versions * sum(x.span for x in widths) / sum(x.n for x in widths)
    usual = 1 << min(WIDEST, max(1, int(days))).bit_length() - 1
    dense = per.select("_k", "_w").where(F.col("_w") * 8 <= usual)
    n_dense = sum(x["keys"] for x in widths if x._w * 8 <= usual)
    dense = None if not n_dense else F.broadcast(dense) if n_dense <= 50_000 else dense  # beyond about 2 MB a shuffled join
    base = _in_cells(base.unionByName(unknown), usual, dense).drop("_cr")

    at = F.to_date(F.col(time)) if valid_at is None else valid_at
    pts = _in_cells(points.withColumns({"_k": norm_code(key), "_v": F.unix_date(at), "_r": micros(time)}), usual, dense)
    occupied = checkpoint(pts.where("_k is not null and _v is not null and _r is not null").groupBy(*CELL, "_w").agg(F.count(F.lit(1)).alias("_n")))
    rects = _rectangles(base, occupied).withColumn("revised", F.col("_r2") < EVER)

    # cells of more than salt_rows points and 1/4096 of all are shared out; there are at most 4096 of them
    least = F.greatest(F.lit(salt_rows), F.ceil(F.col("_all") / 4096))
    total = occupied.agg(F.sum("_n").alias("_all"))
    hot = occupied.crossJoin(F.broadcast(total)).where(F.col("_n") > least).select(*CELL, F.ceil(F.col("_n") / least).cast("int").alias("_salts"))  # one row on the right
    hot = F.broadcast(hot)
    salts = F.coalesce("_salts", F.lit(1))
    pts = pts.drop("_w").join(hot, CELL, "left").withColumn("_salt", F.pmod(F.monotonically_increasing_id(), salts.cast("bigint")).cast("int"))
    rects = rects.join(hot, CELL, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    p, q = pts.alias("p"), rects.alias("q")
    on = [F.col(f"p.{c}") == F.col(f"q.{c}") for c in (*CELL, "_salt")]
    on += [F.expr("p._v >= q._v1 and p._v < q._v2 and p._r >= q._r1 and p._r < q._r2")]
    return p.join(q, on, "left").select(*[F.col(f"p.`{c}`") for c in points.columns], "known_id", "known", "revised")
