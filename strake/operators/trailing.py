"""Rolling totals over trailing periods.

Each entity's days are cut into shards of S days. A shard is a segment tree: node 1 holds the sum and the count of all
its days, nodes 2i and 2i+1 those of the halves of node i, node S + d those of day d. A trailing period of at most S
days is a suffix of one shard and a prefix of the next, each the union of at most 2 log2(S) nodes. As day d has the same
nodes in every tree, a batch of trees is queried for all days at once. A late correction changes one leaf and its
log2(S) ancestors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def shard_days(windows: tuple[int, ...]) -> int:
    return max(64, 1 << (max(windows) - 1).bit_length())


def nodes_of(lo: int, hi: int, size: int) -> list[int]:
    """Nodes of a tree of ``size`` leaves whose days together are lo..hi."""
    out, lo, hi = [], lo + size, hi + size + 1
    while lo < hi:
        if lo & 1:
            out.append(lo)
            lo += 1
        if hi & 1:
            hi -= 1
            out.append(hi)
        lo, hi = lo >> 1, hi >> 1
    return out


def build(leaves: np.ndarray) -> np.ndarray:
    """Trees (n, 2 S) of the rows of leaves (n, S)."""
    n, size = leaves.shape
    tree = np.zeros((n, 2 * size))
    tree[:, size:] = leaves
    half = size
    while half > 1:
        tree[:, half // 2 : half] = tree[:, half : 2 * half : 2] + tree[:, half + 1 : 2 * half : 2]
        half //= 2
    return tree


def query_nodes(window: int, size: int) -> tuple[list[list[int]], list[list[int]]]:
    """For each day of a shard, the nodes of its own and of the preceding shard's tree that make its trailing window."""
    own = [nodes_of(max(0, d - window + 1), d, size) for d in range(size)]
    before = [nodes_of(size + d - window + 1, size - 1, size) if d - window + 1 < 0 else [] for d in range(size)]
    return own, before


def total(trees: np.ndarray, before: np.ndarray, window: int) -> np.ndarray:
    """(n, S): the trailing totals of each day of trees, before[i] being the shard before trees[i]."""
    size = trees.shape[1] // 2
    out = np.zeros((len(trees), size))
    for at, nodes in enumerate(zip(*query_nodes(window, size))):
        for part, picked in zip((trees, before), nodes):
            for k in picked:
                out[:, at] += part[:, k]
    return out


def _leaves(batch: pa.RecordBatch, size: int, measures: int, spill: int = 1) -> tuple:
    """Dense leaves of the entities of a batch: each entity's shards, with ``spill`` empty ones in front."""
    days_col = batch.column("_days")
    offsets = days_col.offsets.to_numpy()
    flat = days_col.flatten()
    offsets = offsets - offsets[0]
    day = flat.field(0).to_numpy(zero_copy_only=False)
    first, last = np.minimum.reduceat(day, offsets[:-1]), np.maximum.reduceat(day, offsets[:-1])
    lo = first // size
    shards = last // size - lo + 1 + spill
    at = np.concatenate(([0], np.cumsum(shards)))
    entity = np.repeat(np.arange(len(lo)), np.diff(offsets))
    row = at[entity] + spill + day // size - lo[entity]
    sums, counts = np.zeros((measures, at[-1], size)), np.zeros((measures, at[-1], size))
    for m in range(measures):
        v = flat.field(1 + m)
        has = np.asarray(v.is_valid())
        np.add.at(sums[m], (row[has], (day % size)[has]), v.to_numpy(zero_copy_only=False)[has])
        np.add.at(counts[m], (row[has], (day % size)[has]), 1)
    return first, last, lo, shards, at, sums, counts


def _totals(schema: pa.Schema, windows: tuple[int, ...], size: int, measures: int, stats: tuple[str, ...], step: int = 256):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo_row in range(0, whole.num_rows, step):
                batch = whole.slice(lo_row, step)
                first, last, lo, shards, at, sums, counts = _leaves(batch, size, measures)
                n_days = last - first + 1
                entity = np.repeat(np.arange(len(lo)), n_days)
                start = np.concatenate(([0], np.cumsum(n_days)))
                age = np.arange(start[-1]) - start[entity]
                # position of each day among the answers, which leave out row 0 of the batch
                where = (at[entity] * size) + (first - lo * size)[entity] + age
                cols = [batch.column("_entity").take(pa.array(entity)), pa.array((first[entity] + age).astype(np.int32)), pa.array(age.astype(np.int32))]
                for m in range(measures):
                    ts, tc = build(sums[m]), build(counts[m])
                    for w in windows:
                        s = total(ts[1:], ts[:-1], w).ravel()[where]
                        c = total(tc[1:], tc[:-1], w).ravel()[where] if {"count", "mean"} & set(stats) else None
                        for stat in stats:
                            if stat == "mean":
                                cols.append(pa.array(np.divide(s, c, out=np.zeros_like(s), where=c > 0), mask=c == 0))
                            else:
                                cols.append(pa.array(s if stat == "sum" else c.astype(np.int64)))
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return run


def _gathered(df: DataFrame, entity: str, day: str, values: list[str]) -> DataFrame:
    """One row an entity with its (day, values); one value a day, so its length is bounded by the calendar."""
    daily = df.where(F.col(entity).isNotNull() & F.col(day).isNotNull()).groupBy(F.col(entity).alias("_entity"), F.col(day).cast("int").alias("_day"))
    daily = daily.agg(*[F.sum(F.col(v).cast("double")).alias(f"_v{i}") for i, v in enumerate(values)])
    return daily.groupBy("_entity").agg(F.collect_list(F.struct("_day", *[f"_v{i}" for i in range(len(values))])).alias("_days"))


def trailing_totals(df: DataFrame, *, entity: str, day: str, values: list[str], windows: tuple[int, ...] = (7, 30), stats: tuple[str, ...] = ("sum", "count", "mean")) -> DataFrame:
    """(entity, day, age, {value}_{stat}_{window}...) for every day between an entity's first and last row.

    ``day`` is a day number (int). Several rows of a day add up; NULL values count as no value, days without a row as
    empty ones: their sum is 0, count 0, and the mean of a period without values NULL. age is the days since the first.
    Rows lacking entity or day are left out; an empty table gives no rows. Entities share no state, and one has at most
    one entry a calendar day before it is gathered, so that a task never holds more than a calendar of any entity.
    """
    fields = [T.StructField(entity, df.schema[entity].dataType), T.StructField(day, T.IntegerType()), T.StructField("age", T.IntegerType())]
    fields += [T.StructField(f"{v}_{s}_{w}", T.LongType() if s == "count" else T.DoubleType()) for v in values for w in windows for s in stats]
    out = T.StructType(fields)
    return _gathered(df, entity, day, values).mapInArrow(_totals(to_arrow_schema(out), windows, shard_days(windows), len(values), stats), out)


def build_trees(df: DataFrame, *, entity: str, day: str, value: str, size: int = 64) -> DataFrame:
    """(entity, shard, sums, counts): the stored form, a segment tree for each entity and shard of ``size`` days."""
    out = T.StructType([T.StructField("entity", df.schema[entity].dataType), T.StructField("shard", T.IntegerType()), T.StructField("sums", T.ArrayType(T.DoubleType())), T.StructField("counts", T.ArrayType(T.DoubleType()))])
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                _, _, lo, shards, at, sums, counts = _leaves(batch, size, 1, spill=0)
                who = np.repeat(np.arange(len(lo)), shards)
                off = pa.array(np.arange(len(who) + 1, dtype=np.int32) * 2 * size)
                lists = [pa.ListArray.from_arrays(off, pa.array(build(x[0]).ravel()), type=schema.field(i).type) for i, x in ((2, sums), (3, counts))]
                yield pa.RecordBatch.from_arrays([batch.column("_entity").take(pa.array(who)), pa.array((lo[who] + np.arange(len(who)) - at[who]).astype(np.int32)), *lists], schema=schema)

    return _gathered(df, entity, day, [value]).mapInArrow(run, out)


def apply_corrections(trees: DataFrame, corrections: DataFrame, *, entity: str, day: str, d_sum: str, d_count: str, size: int = 64) -> DataFrame:
    """Trees after late corrections (changes of a day's sum and count): only the leaf and its ancestors change.

    Corrections of a shard without a tree make one. Corrections add up; those lacking entity or day are ignored.
    """
    levels = size.bit_length()
    node = F.explode(F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda k: F.floor((F.pmod(F.col(day), F.lit(size)) + size) / F.pow(F.lit(2), k)).cast("int")))
    delta = (
        corrections.where(F.col(entity).isNotNull() & F.col(day).isNotNull())
        .select(F.col(entity).alias("entity"), F.floor(F.col(day) / size).cast("int").alias("shard"), node.alias("node"), F.coalesce(F.col(d_sum).cast("double"), F.lit(0.0)).alias("s"), F.coalesce(F.col(d_count).cast("double"), F.lit(0.0)).alias("c"))
        .groupBy("entity", "shard", "node").agg(F.sum("s").alias("s"), F.sum("c").alias("c"))
        .groupBy("entity", "shard").agg(F.map_from_entries(F.collect_list(F.struct("node", F.struct("s", "c")))).alias("d"))
    )
    zero = F.array_repeat(F.lit(0.0), 2 * size)
    new = lambda col, f: F.when(F.col("d").isNull(), F.col(col)).otherwise(F.transform(F.coalesce(col, zero), lambda x, i: x + F.coalesce(F.try_element_at(F.col("d"), i)[f], F.lit(0.0))))
    return trees.join(delta, ["entity", "shard"], "full").select("entity", "shard", new("sums", "s").alias("sums"), new("counts", "c").alias("counts"))


def query_trees(trees: DataFrame, windows: tuple[int, ...], size: int = 64) -> DataFrame:
    """(entity, day, total_{w}, n_{w}...) for every day of every stored shard, from its tree and the one before."""
    if max(windows) > size:
        raise ValueError("a window may not be longer than a shard")
    w = W.partitionBy("entity").orderBy("shard")  # a row for every ``size`` days
    before = F.lag(F.struct("shard", "sums", "counts")).over(w)
    both = trees.select("entity", "shard", "sums", "counts", F.when(before["shard"] == F.col("shard") - 1, before).alias("p")).select("entity", "shard", "sums", "counts", F.col("p.sums").alias("p_sums"), F.col("p.counts").alias("p_counts"))
    out = T.StructType([trees.schema["entity"], T.StructField("day", T.IntegerType())])
    for k in windows:
        out = out.add(f"total_{k}", T.DoubleType()).add(f"n_{k}", T.LongType())
    schema = to_arrow_schema(out)

    def dense(lists: pa.ListArray) -> np.ndarray:
        """(rows, 2 size), zeros for a NULL."""
        x = np.zeros((len(lists), 2 * size))
        x[np.asarray(lists.is_valid())] = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, 2 * size)
        return x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                b = whole.slice(k, 256)
                sums, counts, p_sums, p_counts = (dense(b.column(c)) for c in ("sums", "counts", "p_sums", "p_counts"))
                day = b.column("shard").to_numpy()[:, None] * size + np.arange(size)
                cols = [b.column("entity").take(pa.array(np.repeat(np.arange(b.num_rows), size))), pa.array(day.ravel().astype(np.int32))]
                for k2 in windows:
                    cols += [pa.array(total(sums, p_sums, k2).ravel()), pa.array(np.rint(total(counts, p_counts, k2)).astype(np.int64).ravel())]
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return both.mapInArrow(run, out)
