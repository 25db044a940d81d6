"""Top N items within every group, by exact positions.

One range-partitioned sort of all rows on (group, score, identifier) spreads even a huge group over partitions. In one
pass each partition numbers its rows within their groups and counts each group; it keeps its first N rows of a group,
as later ones cannot be among the group's first N, and one row with the count. The counts, summed over the partitions
before, turn the local numbers into exact positions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def _starts(cols: list[pa.Array]) -> np.ndarray:
    """True where a row's group differs from the row before; the first row counts as a start."""
    n = len(cols[0])
    out = np.zeros(n, dtype=bool)
    out[0] = True
    for c in cols:
        a, b = c.slice(1), c.slice(0, n - 1)
        out[1:] |= pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False) | (np.asarray(a.is_null()) != np.asarray(b.is_null()))
    return out


def _number(schema: pa.Schema, groups: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # last group so far: its values, its count, the partition
        for b in batches:
            if not b.num_rows:
                continue
            cols = b.columns[:groups]
            start = _starts(cols)
            first = tuple(c[0].as_py() for c in cols)
            carry = held[1] if held and held[0] == first else 0
            if held and not carry:
                yield _count(held, schema, groups)
            at = np.flatnonzero(start)
            sizes = np.diff(np.append(at, b.num_rows))
            local = np.arange(b.num_rows) - np.repeat(at, sizes) + 1
            local[: sizes[0]] += carry
            keep = local <= n
            if keep.any():
                kept = b.filter(pa.array(keep))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(local[keep].astype(np.int64)), pa.nulls(len(kept), pa.int64())], schema=schema)
            sizes[0] += carry
            if len(at) > 1:
                done = b.take(pa.array(at[:-1]))
                blank = [pa.nulls(len(done), t.type) for t in list(schema)[groups:-3]]
                yield pa.RecordBatch.from_arrays([*done.columns[:groups], *blank, done.column("_part"), pa.nulls(len(done), pa.int64()), pa.array(sizes[:-1].astype(np.int64))], schema=schema)
            held = (tuple(c[int(at[-1])].as_py() for c in cols), int(sizes[-1]), b.column("_part")[0].as_py())
        if held:
            yield _count(held, schema, groups)

    return run


def _count(held: tuple, schema: pa.Schema, groups: int) -> pa.RecordBatch:
    row = [*held[0], *[None] * (len(schema) - groups - 3), held[2], None, held[1]]
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)


def top_n(df: DataFrame, *, groups: list[str], order: list[Column], n: int, partitions: int | None = None) -> DataFrame:
    """Each group's first n rows in ``order`` with ``position`` (1..n) and ``group_rows`` (all rows of the group).

    ``order`` must be total within a group for a fixed result; rows that tie in all of it get any order. NULL group
    values form groups of their own, NULL scores sort as ``order`` says. Other columns pass through under any name;
    repeated rows count as often as they occur; an empty table gives no rows.
    """
    spark = df.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rest = [c for c in df.columns if c not in groups]
    keys = [F.col(f"`{g}`") for g in groups]
    ranged = df.select(*keys, *[F.col(f"`{c}`") for c in rest])
    ranged = ranged.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order).withColumn("_part", F.spark_partition_id())
    out = T.StructType([*ranged.schema.fields, T.StructField("_local", T.LongType()), T.StructField("_rows", T.LongType())])
    out = T.StructType([T.StructField(f.name, f.dataType) for f in out])
    kept = ranged.mapInArrow(_number(to_arrow_schema(out), len(groups), n), out)
    before = W.partitionBy(*keys).orderBy("_part").rangeBetween(W.unboundedPreceding, -1)
    placed = kept.withColumns({"position": F.col("_local") + F.coalesce(F.sum("_rows").over(before), F.lit(0)), "group_rows": F.sum("_rows").over(W.partitionBy(*keys))})
    return placed.where(F.col("_local").isNotNull() & (F.col("position") <= n)).select(*[F.col(f"`{c}`") for c in df.columns], F.col("position").cast("int").alias("position"), "group_rows")
