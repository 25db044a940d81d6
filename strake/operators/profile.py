"""Column-level data quality profile of a parquet table, per load.

The files' footers are read first, in parallel. A chunk (column of a row group) of a single load needs no scan if its
statistics settle what is asked: exact null counts, which are all that columns without a rule need; a chunk of nulls only; a
dictionary of one value, which gives all moments; a dictionary whose texts all match the pattern, or none. Distinct counts
come from the dictionaries' values. Only the chunks that are left are scanned: those that mix loads, whose moments are asked for, or which aren't wholly
dictionary coded. Columns that need the same chunks share a scan of no other column; files that are needed whole are read
as they are, and of others the row groups, by their loads and row numbers. Extrema of texts and whole numbers come with the
distinct values.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator, Sequence
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..common import checkpoint, finite, micros

SUMS = ["n_rows", "n_null", "n_finite", "n_in", "s1", "s2", "n_bad"]
#: A row is a chunk's figures, one of its values, or (todo) the columns of a row group that must be scanned.
PIECE = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("todo", T.StringType()), T.StructField("column_name", T.StringType()), T.StructField("load_id", T.IntegerType()),
    *[T.StructField(c, T.DoubleType() if c in ("s1", "s2") else T.LongType()) for c in SUMS], T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType()),
    T.StructField("value_num", T.DoubleType()), T.StructField("value_int", T.LongType()), T.StructField("value_txt", T.StringType()),
])
NAMES = PIECE.fieldNames()
VALUES = ("value_num", "value_int", "value_txt")


def _bounds(valid: tuple[float, float] | None) -> tuple[float, float, float]:
    """Valid range and the value that sums are centred on."""
    return (-math.inf, math.inf, 0.0) if valid is None else (*valid, (valid[0] + valid[1]) / 2)


def _whole(df: DataFrame, c: str):
    """A whole number for the value of a column that is neither double nor text."""
    kind, x = df.schema[c].dataType, F.col(f"`{c}`")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return micros(x)
    if isinstance(kind, T.DateType):
        return F.unix_date(x).cast("bigint")
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        return x.cast("bigint")
    raise TypeError(f"{c}: {kind.simpleString()} has no profile")


def _figures(col: str, load, *figures) -> tuple:
    return (None, None, col, load, *figures, None, None, None)


def _value(col: str, load, kind: str, v) -> tuple:
    """A row of a distinct value; a number that is NaN is the text NaN."""
    if kind == "value_num":
        v, kind = ("NaN", "value_txt") if v != v else (v + 0.0, kind)
    return (None, None, col, load, *[None] * (len(SUMS) + 2), *[v if k == kind else None for k in VALUES])


def _footer_pieces(numeric: dict, patterns: dict, whole: list, load: str, distinct: bool):
    from ..sources import parquet_pages as P

    cols = (*numeric, *patterns, *whole)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq

        for frame in frames:
            for uri in frame["file"]:
                with P.open_file(uri) as f:
                    meta = pq.ParquetFile(f).metadata
                    row = 0
                    for g in range(meta.num_row_groups):
                        rows = list(of_group(uri, f, meta, g, row))
                        row += meta.row_group(g).num_rows
                        yield pd.DataFrame(rows, columns=NAMES).astype({c: "Int64" for c in NAMES if c.startswith("n_") or c in ("load_id", "value_int")})

    def of_group(uri: str, f, meta, g: int, row: int) -> Iterator[tuple]:
        index = {meta.row_group(g).column(i).path_in_schema: i for i in range(meta.num_columns)}
        at = P.chunk_of(meta, g, index[load])
        pure = at.nulls == 0 and at.lo is not None and at.lo == at.hi
        todo = {}
        for col in cols:
            if not pure:
                todo[col] = [True, distinct]
                continue
            c = P.chunk_of(meta, g, index[col])
            empty, alone = c.nulls == c.values, c.lo is not None and c.lo == c.hi
            words = P.dictionary_of(f, meta, g, index[col]) if not empty and (distinct and col not in whole or patterns.get(col) is not None or alone and col in numeric) else None
            figures = settled(col, c, words)
            if figures:
                yield _figures(col, int(at.lo), *figures)
            values = distinct and not empty and (words is None or col in whole)
            if distinct and not empty and not values:
                for w in words:
                    yield _value(col, int(at.lo), "value_num" if col in numeric else "value_txt", w)
            if values or figures is None:
                todo[col] = [figures is None, values]
        if todo:
            span = (None, None) if at.lo is None else (int(at.lo), int(at.hi)) if at.nulls == 0 else (None, None)
            yield (uri, json.dumps({"rows": [row, row + meta.row_group(g).num_rows, meta.num_rows], "loads": span, "columns": todo}), *[None] * (len(NAMES) - 2))

    def settled(col: str, c, words: list | None) -> tuple | None:
        """(rows, nulls, finite, in range, s1, s2, bad, lo, hi) where the chunk's statistics settle them."""
        if c.nulls is None:
            return None
        some = c.values - c.nulls
        if not some:
            return (c.values, c.nulls, 0, 0, 0.0, 0.0, 0, None, None)
        if col in numeric:
            if words is None or len(words) != 1:
                return None
            v, (a, b, mid) = words[0], _bounds(numeric[col])
            if not math.isfinite(v):
                return (c.values, c.nulls, 0, 0, 0.0, 0.0, 0, None, None)
            inside, x = a <= v <= b, v - mid
            return (c.values, c.nulls, some, some * inside, some * x * inside, some * x * x * inside, 0, v, v)
        if patterns.get(col) is None:
            return (c.values, c.nulls, some, some, 0.0, 0.0, 0, None, None)
        ok = {re.fullmatch(patterns[col], w) is not None for w in words or ()}
        return None if len(ok) != 1 else (c.values, c.nulls, some, some, 0.0, 0.0, 0 if ok == {True} else some, None, None)

    return run


def _scan(df: DataFrame, cols: list[str], numeric: dict, patterns: dict, load: str) -> DataFrame:
    """The pieces of a scan, one row a load and column."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for c in cols:
        x = F.col(f"`{c}`")
        aggs.append(F.count(x).alias(f"{c}_some"))
        if c in numeric:
            a, b, mid = _bounds(numeric[c])
            v = finite(x)
            inside = F.when(v.between(a, b), v - mid)
            aggs += [F.count(v).alias(f"{c}_finite"), F.count(inside).alias(f"{c}_in"), F.sum(inside).alias(f"{c}_s1"), F.sum(inside * inside).alias(f"{c}_s2"), F.min(v).alias(f"{c}_lo"), F.max(v).alias(f"{c}_hi")]
        elif patterns.get(c) is not None:
            aggs.append(F.count_if(~x.rlike(rf"\A(?:{patterns[c]})\z")).alias(f"{c}_bad"))
    wide = df.groupBy(F.col(load).cast("int").alias("load_id")).agg(*aggs)
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("double")
    rows = []
    for c in cols:
        n = c in numeric
        some = F.col(f"{c}_some")
        rows.append(F.struct(F.lit(c).alias("column_name"), F.col("n_rows"), (F.col("n_rows") - some).alias("n_null"), (F.col(f"{c}_finite") if n else some).alias("n_finite"), (F.col(f"{c}_in") if n else some).alias("n_in"), F.coalesce(F.col(f"{c}_s1"), F.lit(0.0)).alias("s1") if n else F.lit(0.0).alias("s1"), F.coalesce(F.col(f"{c}_s2"), F.lit(0.0)).alias("s2") if n else F.lit(0.0).alias("s2"), (F.col(f"{c}_lo") if n else none).alias("lo"), (F.col(f"{c}_hi") if n else none).alias("hi"), (F.col(f"{c}_bad") if patterns.get(c) is not None else zero).alias("n_bad")))
    return wide.select("load_id", F.inline(F.array(*rows)))


def _chunks(spark: SparkSession, df: DataFrame, load: str, units: list[tuple]) -> DataFrame:
    """The rows of row groups (file, first row, row after the last, rows of the file, least load, greatest load)."""
    held: dict[str, int] = {}
    for file, a, b, *_ in units:
        held[file] = held.get(file, 0) + b - a
    whole = sorted({u[0] for u in units if held[u[0]] == u[3]})
    part = [u for u in units if held[u[0]] != u[3]]
    read = lambda files: spark.read.schema(df.schema).parquet(*map(unquote, files))
    out = read(whole) if whole else None
    if part:
        spans = {(u[4], u[5]) for u in part}
        if any(lo is None for lo, _ in spans):
            near = F.lit(True)
        else:  # lets the reader pass over row groups of other loads
            spans = spans if len(spans) <= 100 else {(min(lo for lo, _ in spans), max(hi for _, hi in spans))}
            near = F.lit(False)
            for lo, hi in sorted(spans):
                near = near | F.col(load).between(lo, hi)
        rows = spark.createDataFrame([(re.sub("^file:/+", "file:/", u[0]), *u[1:3]) for u in part], "_file string, _a bigint, _b bigint")
        rows = F.broadcast(rows) if len(part) <= 100_000 else rows  # about 10 MB
        at, row = F.regexp_replace("_metadata.file_path", "^file:/+", "file:/").alias("_at"), F.col("_metadata.row_index").alias("_row")
        some = read(sorted({u[0] for u in part})).where(near).select("*", at, row)
        some = some.join(rows, F.expr("_at = _file and _row >= _a and _row < _b"), "left_semi").drop("_at", "_row")
        out = some if out is None else out.unionByName(some)
    return out


def profile(spark: SparkSession, path: str, *, load: str, numeric: dict[str, tuple[float, float] | None], patterns: dict[str, str | None], whole: Sequence[str] = (), distinct: bool = True) -> DataFrame:
    """(column_name, load_id, n_rows, n_null, n_finite, coverage, n_in, mean, std, lo, hi, n_bad, bad_share, n_distinct,
    prev_in, prev_mean, prev_std, lo_txt, hi_txt, prev_coverage, prev_bad_share, prev_distinct), a row a column and load.

    numeric: valid range by column, None for any value; n_finite counts values not NULL, NaN or infinite, lo and hi are their extrema, mean and
    (population) std those of the n_in values inside the range. patterns: regular expression for the whole text by column,
    None without a rule (bad_share is NULL then); n_finite counts non-NULL texts, n_bad those that don't match. whole: columns
    of integers, booleans, dates (as days) and timestamps (as microseconds), both from 1970; n_finite counts non-NULL values.
    lo_txt and hi_txt are the extrema of texts and of whole, NULL unless distinct is asked for. prev_ are the figures of the load before in order.
    n_distinct counts non-NULL values (NaN one value, -0.0 equal to 0.0), NULL unless asked for. Rows without a load form
    a load NULL, which has no load before and is before none. An empty table gives no rows.
    """
    df = spark.read.parquet(path)
    files = df.inputFiles()
    cols, ints = [*numeric, *patterns, *whole], {c: _whole(df, c) for c in whole}
    if not files:
        raise FileNotFoundError(path)
    parts = max(1, min(len(files), 4 * spark.sparkContext.defaultParallelism))
    seen = spark.createDataFrame([(f,) for f in files], "file string").repartition(parts).mapInPandas(_footer_pieces(numeric, patterns, list(whole), load, distinct), PIECE)
    seen = checkpoint(seen)
    needs: dict[str, list] = {}
    again: dict[str, list] = {}
    for r in seen.where("todo is not null").select("file", "todo").collect():  # a row a row group, as the reader's own plan has
        todo = json.loads(r["todo"])
        for c, (figures, values) in todo["columns"].items():
            for wanted, asked in ((needs, figures), (again, values)):
                if asked:
                    wanted.setdefault(c, []).append((r["file"], *todo["rows"], *todo["loads"]))

    def scans(wanted: dict[str, list]) -> list[tuple[list[str], DataFrame]]:
        """Columns that need the same chunks, and the rows of these."""
        by: dict[tuple, list[str]] = {}
        for c in cols:
            if c in wanted:
                by.setdefault(tuple(sorted(wanted[c], key=lambda u: u[:2])), []).append(c)
        return [(cs, _chunks(spark, df, load, list(units))) for units, cs in by.items()]

    names = ["column_name", "load_id", *SUMS, "lo", "hi"]
    pieces = seen.where("n_rows is not null").select(names)
    for cs, rows in scans(needs):
        pieces = pieces.unionByName(_scan(rows, cs, numeric, patterns, load).select(names))
    per = pieces.groupBy("column_name", "load_id").agg(*[F.sum(c).alias(c) for c in SUMS], F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    mid = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for c, r in numeric.items() for x in (c, _bounds(r)[2])]), F.col("column_name")), F.lit(0.0)) if numeric else F.lit(0.0)
    m = F.when(F.col("n_in") > 0, F.col("s1") / F.col("n_in"))
    is_num = F.col("column_name").isin(list(numeric))
    per = per.withColumns({
        "coverage": F.col("n_finite") / F.col("n_rows"),
        "mean": F.when(is_num, m + mid),
        "std": F.when(is_num & (F.col("n_in") > 0), F.sqrt(F.greatest(F.col("s2") / F.col("n_in") - m * m, F.lit(0.0)))),
        "bad_share": F.when(F.col("column_name").isin([c for c, p in patterns.items() if p is not None]) & (F.col("n_finite") > 0), F.col("n_bad") / F.col("n_finite")),
    })
    if distinct:
        fields = ["column_name", "load_id", "value_num", "value_int", "value_txt"]
        values = seen.where("todo is null and n_rows is null").select(fields)
        for cs, rows in scans(again):
            each = []
            for c in cs:
                x, no = F.col(f"`{c}`"), {k: F.lit(None).cast(k) for k in ("double", "bigint", "string")}
                num = F.when(~F.isnan(x), x.cast("double") + 0.0) if c in numeric else no["double"]
                txt = F.when(F.isnan(x), "NaN") if c in numeric else x if c in patterns else no["string"]
                each.append(F.struct(F.lit(c).alias("column_name"), num.alias("value_num"), ints.get(c, no["bigint"]).alias("value_int"), txt.alias("value_txt")))
            values = values.unionByName(rows.select(F.col(load).cast("int").alias("load_id"), F.inline(F.array(*each))).where("value_num is not null or value_int is not null or value_txt is not null").select(fields))
        ends = [f(c).alias(f"{n}_{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in ("value_int", "value_txt")]
        counts = values.distinct().groupBy("column_name", "load_id").agg(F.count(F.lit(1)).alias("n_distinct"), *ends)
        end = lambda n: F.when(~F.col("a.column_name").isin(list(numeric)), F.coalesce(f"{n}_value_txt", F.col(f"{n}_value_int").cast("string"))).alias(f"{n}_txt")
        per = per.alias("a").join(counts.alias("b"), F.expr("a.column_name = b.column_name and a.load_id <=> b.load_id"), "left").select("a.*", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"), end("lo"), end("hi"))
    else:
        per = per.withColumns({"n_distinct": F.lit(None).cast("bigint"), "lo_txt": F.lit(None).cast("string"), "hi_txt": F.lit(None).cast("string")})
    w = W.partitionBy("column_name", F.col("load_id").isNull()).orderBy("load_id")
    before = {"in": "n_in", "mean": "mean", "std": "std", "coverage": "coverage", "bad_share": "bad_share", "distinct": "n_distinct"}
    per = per.withColumns({f"prev_{a}": F.lag(c).over(w) for a, c in before.items()})
    return per.select("column_name", "load_id", "n_rows", "n_null", "n_finite", "coverage", "n_in", "mean", "std", "lo", "hi", "n_bad", "bad_share", "n_distinct", "prev_in", "prev_mean", "prev_std", "lo_txt", "hi_txt", "prev_coverage", "prev_bad_share", "prev_distinct")
