"""Filling fixed-capacity containers with documents.

Best-fit decreasing over all documents at once. Only sizes matter to it and there are no more of them than the capacity,
so the packing is made on the histogram of sizes: items of one size are placed in runs, each into equally filled bins,
which are what one-by-one best-fit decreasing would choose. A segment tree over remaining capacities, whose leaves count
the open bins, finds the tightest fit in logarithmic time. Documents then look their bin up by their rank within their
size, which is made of per-block counts and their prefix sums, so that neither the driver nor a task sees all documents.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..common import checkpoint

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


class Tightest:
    """Segment tree over remaining capacities; a leaf holds the number of open bins."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)

    def add(self, remaining: int, n: int) -> None:
        i = remaining + self.size
        while i:
            self.tree[i] += n
            i >>= 1

    def find(self, least: int) -> int | None:
        """The smallest remaining capacity >= least of an open bin."""
        i = least + self.size
        if self.tree[i]:
            return least
        while i > 1:
            if not i & 1 and self.tree[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (size, first rank, items, items a bin, first bin) and the number of bins, for items of sizes 1..capacity.

    The items of a run of ranks go to consecutive bins, as many a bin as stated, the last bin perhaps fewer.
    """
    tree, bins, runs, n_bins = Tightest(capacity), {}, [], 0
    for size in sorted(histogram, reverse=True):
        rank, left = 0, histogram[size]
        while left:
            room = tree.find(size)
            if room is None:
                each = capacity // size
                first, count = n_bins, -(-left // each)
                n_bins += count
                room = capacity
            else:
                each = room // size
                first, count = bins[room].pop()
                need = -(-left // each)
                tree.add(room, -count)
                if count > need:
                    bins[room].append((first + need, count - need))
                    tree.add(room, count - need)
                    count = need
            items = min(left, each * count)
            runs.append((size, rank, items, each, first))
            whole, rest = divmod(items, each)
            for at, n, used in ((first, whole, each), (first + whole, 1, rest)):
                if n and used:
                    bins.setdefault(room - used * size, []).append((at, n))
                    tree.add(room - used * size, n)
            rank, left = rank + items, left - items
    return runs, n_bins


def token_counts(docs: DataFrame, *, doc_id: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of the documents with a non-empty text; special tokens' strings are ordinary text."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers as P
        import tiktoken

        with open(tokenizer, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(encode(t)) for t in b.column(1).to_pylist()], pa.int64())], schema=schema)

    return docs.where(F.length(text) > 0).select(F.col(doc_id).cast("bigint").alias("doc_id"), text).mapInArrow(run, "doc_id bigint, n_tokens bigint")


def pack_sizes(sizes: DataFrame, capacity: int, block_rows: int = 100_000) -> DataFrame:
    """(doc_id, piece, container_id, start_token, tokens) for (doc_id, n_tokens).

    A document of at most ``capacity`` tokens is one piece; a longer one fills containers of its own and its last piece
    is packed like a document. Documents without tokens take no container. The result is fixed by the ids and sizes;
    rows that repeat an id are documents of their own, in any order among themselves; NULL ids are kept.
    """
    spark = sizes.sparkSession
    sizes = checkpoint(sizes.where("n_tokens > 0"))
    rest = F.col("n_tokens") % capacity
    items = sizes.select("doc_id", rest.cast("int").alias("size"), (F.col("n_tokens") - rest).alias("start_token")).where("size > 0")
    blocks = max(16, items.count() // block_rows)
    items = items.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int"))
    counts = items.groupBy("size", "block").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.sum("n").over(W.partitionBy("size").orderBy("block")) - F.col("n")).drop("n")
    histogram = {r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    runs, n_bins = best_fit_decreasing(histogram, capacity)
    plan = spark.createDataFrame([(s, r, r + n, e, b) for s, r, n, e, b in runs], "size int, lo bigint, hi bigint, each bigint, bin bigint")
    if len(runs) <= 100_000:  # about 4 MB
        plan = F.broadcast(plan)
    local = F.row_number().over(W.partitionBy("size", "block").orderBy("doc_id", "start_token")) - 1
    ranked = items.withColumn("local", local).join(before, ["size", "block"]).withColumn("rank", F.col("local") + F.col("before"))
    placed = ranked.alias("r").join(plan.alias("p"), F.expr("r.size = p.size and r.rank >= p.lo and r.rank < p.hi"))
    placed = placed.select("doc_id", (F.col("start_token") / capacity).cast("int").alias("piece"), (F.col("bin") + F.floor((F.col("rank") - F.col("lo")) / F.col("each"))).alias("container_id"), "start_token", F.col("r.size").cast("bigint").alias("tokens"))

    long = sizes.where(F.col("n_tokens") >= capacity).select("doc_id", F.floor(F.col("n_tokens") / capacity).alias("full")).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int"))
    of_block = long.groupBy("block").agg(F.sum("full").alias("n"))
    of_block = of_block.withColumn("before", F.sum("n").over(W.orderBy("block")) - F.col("n")).drop("n")  # at most one row a block
    own = F.sum("full").over(W.partitionBy("block").orderBy("doc_id", "full").rowsBetween(W.unboundedPreceding, 0)) - F.col("full")
    cut = long.withColumn("own", own).join(of_block, "block").select("doc_id", (F.col("own") + F.col("before") + n_bins).alias("at"), F.explode(F.sequence(F.lit(0), (F.col("full") - 1).cast("int"))).alias("piece"))
    cut = cut.select("doc_id", "piece", (F.col("at") + F.col("piece")).alias("container_id"), (F.col("piece").cast("bigint") * capacity).alias("start_token"), F.lit(capacity).cast("bigint").alias("tokens"))
    return placed.unionByName(cut)


def pack(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", capacity: int = 2048, tokenizer: str = TOKENIZER) -> DataFrame:
    """``pack_sizes`` of the documents' token counts. NULL and empty texts take no container."""
    return pack_sizes(token_counts(docs, doc_id=doc_id, text=text, tokenizer=tokenizer), capacity)
