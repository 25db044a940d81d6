"""References to records that do not exist.

Parent keys are cut into ranges of about ``range_keys`` keys, as many as there are. The lifetimes of a key are merged into
disjoint ones, and a range's parents become sorted arrays (key, alive from, alive to) in the task that probes it.
References go to the range of their key, large ranges in several shares that each get the range's parents first, and are
probed in Arrow batches by binary search. Parents of a table of fixed size are one range, held by every task, and their
references stay where they lie. Only misses leave the probe; they may be aggregated per table and period.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..common import checkpoint

FOREVER = 2**62
HELD = 100_000  # lifetimes of a fixed-size table that every task may hold: about 5 MB
EVERY = 16  # one reference in so many tells how many shares a range needs


def _listed(values: list, kind: str) -> Column:
    """A constant array."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def _bisect(key: Column, bounds: list[str]) -> Column:
    """Number of the range of ``key``: a binary search among the ranges' lower bounds, of which the first is open."""
    lows = _listed(bounds, "string")
    steps = [1 << i for i in reversed(range(max(1, (len(bounds) - 1).bit_length())))]
    return F.aggregate(_listed(steps, "int"), F.lit(0), lambda at, step: F.when(F.get(lows, at + step) <= key, at + step).otherwise(at))


class ParentRange:
    """Sorted keys of one range and, for each, disjoint intervals in which a record of the key is alive."""

    def __init__(self, keys: pa.Array, start: pa.Array, end: pa.Array):
        """keys with their lifetimes, which don't overlap; a lifetime without a start is none."""
        rows = pa.table([keys, start, end], names=["k", "f", "t"])
        rows = rows.sort_by([("k", "ascending"), ("f", "ascending")]).combine_chunks()
        coded = rows["k"].combine_chunks().dictionary_encode()
        self.keys = np.array(coded.dictionary.to_pylist(), dtype=object)
        has = np.asarray(rows["f"].is_valid())
        starts = rows["f"].to_numpy()[has].astype(np.int64)
        self.owner, self.ends = coded.indices.to_numpy(zero_copy_only=False)[has].astype(np.int64), rows["t"].to_numpy()[has].astype(np.int64)
        self.times = np.unique(starts)
        self.width = len(self.times) + 1
        self.where = self.owner * self.width + np.searchsorted(self.times, starts) + 1

    def misses(self, keys: pa.Array, at: pa.Array) -> np.ndarray:
        """True where no record of the key is alive at the time, or at a NULL time no record of the key exists."""
        coded = keys.dictionary_encode()
        words = np.array(coded.dictionary.to_pylist(), dtype=object)
        rank = np.full(len(words), -1, dtype=np.int64)
        if len(words) and len(self.keys):
            pos = np.minimum(np.searchsorted(self.keys, words), len(self.keys) - 1)
            rank = np.where(self.keys[pos] == words, pos, -1)
        rank = rank[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.full(len(keys), -1, dtype=np.int64)
        known = rank >= 0
        untimed = np.asarray(at.is_null())
        t = at.fill_null(0).to_numpy(zero_copy_only=False)
        alive = np.zeros(len(rank), dtype=bool)
        if len(self.where):
            i = np.searchsorted(self.where, rank * self.width + np.searchsorted(self.times, t, "right"), "right") - 1
            ok = known & (i >= 0)
            i = np.maximum(i, 0)
            alive = ok & (self.owner[i] == rank) & (t < self.ends[i])
        return ~np.where(untimed, known, alive)


def _probe(schema: pa.Schema, n: int):
    """Rows in the order of their slots, a slot's parents (kind 0) before its references, to the references that miss."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, pieces, parents = None, [], None
        for b in batches:
            place = b.column("_slot").to_numpy().astype(np.int64) * 2 + b.column("_kind").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(place)] if len(place) else []
            for lo, hi in zip(edges, edges[1:]):
                part = b.slice(lo, hi - lo)
                if place[lo] // 2 != slot:
                    slot, pieces, parents = place[lo] // 2, [], None
                if not place[lo] % 2:
                    pieces.append(part.select(["_k", "_t", "_until"]))
                    continue
                if parents is None:
                    t = pa.Table.from_batches(pieces or [part.slice(0, 0).select(["_k", "_t", "_until"])])
                    parents, pieces = ParentRange(*(c.combine_chunks() for c in t.columns)), []
                yield from _missing(part, parents, schema, n)

    return run


def _missing(part: pa.RecordBatch, parents: ParentRange, schema: pa.Schema, n: int) -> Iterator[pa.RecordBatch]:
    miss = parents.misses(part.column("_k"), part.column("_t"))
    if miss.any():
        yield pa.RecordBatch.from_arrays(part.filter(pa.array(miss)).columns[:n], schema=schema)


def _lifetimes(par: DataFrame) -> DataFrame:
    """(k, f, t): each key's lifetimes with those that touch or overlap made one; a key without any has a row without f."""
    alive = F.col("t") > F.col("f")
    par = par.select("k", F.when(alive, F.col("f")).alias("f"), F.when(alive, F.col("t")).alias("t"))
    w = W.partitionBy("k").orderBy(F.col("f").asc_nulls_first(), "t")
    before = F.max("t").over(w.rowsBetween(W.unboundedPreceding, -1))
    par = par.withColumn("_new", (F.col("f").isNotNull() & (before.isNull() | (F.col("f") > before))).cast("int"))
    par = par.withColumn("_i", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return par.groupBy("k", "_i").agg(F.min("f").alias("f"), F.max("t").alias("t")).select("k", "f", "t")


def find_orphans(
    refs: DataFrame, parents: DataFrame, *, key: Column, parent_key: Column, at: Column | None = None, alive_from: Column | None = None,
    alive_to: Column | None = None, fixed: bool = False, range_keys: int = 20_000, share_rows: int = 400_000,
) -> DataFrame:
    """The rows of ``refs`` whose key has no parent record, or none alive at ``at`` (alive_from <= at < alive_to).

    Times are microseconds (bigint). A NULL ``at`` asks only whether any record of the key exists; a NULL alive_to means
    for ever, a NULL alive_from never. A NULL key refers to nothing and is no orphan. Repeated references stay repeated,
    all their columns are kept; with no parents every non-NULL reference is an orphan. ``fixed`` says that parents don't
    grow with the data: up to HELD lifetimes they are sent to every task; beyond, and otherwise, they are cut into ranges.
    """
    none = F.lit(None).cast("bigint")
    par = parents.select(parent_key.cast("string").alias("k"), (F.lit(-FOREVER) if alive_from is None else alive_from).cast("bigint").alias("f"), F.coalesce(none if alive_to is None else alive_to.cast("bigint"), F.lit(FOREVER)).alias("t")).where("k is not null").distinct()
    par = checkpoint(_lifetimes(par))
    child = refs.withColumns({"_k": key.cast("string"), "_t": none if at is None else at.cast("bigint")}).where("_k is not null")
    schema, n = to_arrow_schema(refs.schema), len(refs.columns)
    n_keys = par.count()
    if fixed and n_keys <= HELD:
        held = refs.sparkSession.sparkContext.broadcast(tuple(zip(*par.collect())) or ((), (), ()))

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            k, f, t = held.value
            one = ParentRange(pa.array(k, pa.string()), pa.array(f, pa.int64()), pa.array(t, pa.int64()))
            for b in batches:
                yield from _missing(b, one, schema, n)

        return child.select(*[F.col(f"`{c}`") for c in refs.columns], "_k", "_t").mapInArrow(probe, refs.schema)

    n_ranges = max(8, -(-n_keys // range_keys))
    bounds = sorted(r["lo"] for r in par.repartitionByRange(n_ranges, "k").groupBy(F.spark_partition_id().alias("p")).agg(F.min("k").alias("lo")).collect())  # a row for every range_keys keys
    bounds = bounds or [""]
    # what a sample says decides only how the work is shared out; a range it doesn't hold is one share
    sizes = {r["_range"]: EVERY * r["n"] for r in child.sample(1 / EVERY, seed=1).groupBy(_bisect(F.col("_k"), bounds).alias("_range")).agg(F.count(F.lit(1)).alias("n")).collect()}
    shares = [-(-max(1, sizes.get(i, 1)) // share_rows) for i in range(len(bounds))]
    first = np.cumsum([0, *shares]).tolist()
    n_slots = first.pop()
    at_first, count = (F.get(_listed(x, "int"), F.col("_range")) for x in (first, shares))
    child = child.withColumn("_range", _bisect(F.col("_k"), bounds)).withColumn("_slot", (at_first + F.pmod(F.xxhash64(F.monotonically_increasing_id()), count)).cast("int"))
    arrays = (
        par.withColumn("_range", _bisect(F.col("k"), bounds)).withColumn("_slot", F.explode(F.sequence(at_first, at_first + count - 1)))
        .select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in refs.schema], F.col("k").alias("_k"), F.col("f").alias("_t"), F.col("t").alias("_until"), "_slot", F.lit(0).alias("_kind"))
    )
    child = child.select(*[F.col(f"`{c}`") for c in refs.columns], "_k", "_t", none.alias("_until"), "_slot", F.lit(1).alias("_kind"))
    both = arrays.union(child)
    both = both.repartitionById(n_slots, "_slot") if hasattr(both, "repartitionById") else both.repartition(n_slots, "_slot")
    return both.sortWithinPartitions("_slot", "_kind").mapInArrow(_probe(schema, n), refs.schema)
