"""Evolutionary search for expressions. The trees live on the driver; a generation is scored in jobs of BATCH trees.

Trees are bred on the fit block of dates only. A tree survives if it also earns on the later selection block, whose result
orders the survivors. Mining goes on in rounds: what a round found joins the basis, and later trees are scored on what is left
of their daily ranks once those of the basis are taken out.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..common import finite
from ..functions.expr import Node, compile_node
from ..functions.ops import REGISTRY, cs_rank
from .audits import residualize
from .metrics import factor_correlation
from .portfolio import net_return

#: Windows that trees may use; fixed values.
WINDOWS = (3, 5, 10, 20, 60)
INVALID = -1e9
BATCH = 20


@dataclass(frozen=True)
class Scored:
    expression: str
    node: Node
    fitness: float
    size: int
    selection: float | None = None  # the same on the selection block


def grow(rnd: random.Random, fields: list[str], depth: int, kind: str, full: bool) -> Node:
    """A random typed tree; ``full`` makes every branch ``depth`` long."""
    if depth <= 1 or not full and rnd.random() < 0.25:
        return Node(rnd.choice(fields))
    ops = [x for x in REGISTRY.values() if kind == "panel" or x.event and x.name != "sign"]
    op = rnd.choice(ops)
    args = tuple(grow(rnd, fields, depth - 1, kind, full) for _ in range(op.columns))
    return Node(op.name, args, rnd.choice(WINDOWS) if op.windowed else None)


def replace(tree: Node, at: int, new: Node) -> Node:
    """The tree with its at-th node, in order, replaced."""
    if at == 0:
        return new
    at -= 1
    args = []
    for a in tree.args:
        n = a.size
        args.append(replace(a, at, new) if 0 <= at < n else a)
        at -= n
    return Node(tree.name, tuple(args), tree.window)


def crossover(rnd: random.Random, a: Node, b: Node) -> Node:
    return replace(a, rnd.randrange(a.size), rnd.choice(list(b.walk())))


def mutate(rnd: random.Random, a: Node, fields: list[str], kind: str) -> Node:
    return replace(a, rnd.randrange(a.size), grow(rnd, fields, 2, kind, False))


def fitness(df: DataFrame, nodes: list[Node], ret: str, k: int, min_coverage: float = 0.2, cost: float = 0.0, basis: tuple[str, ...] = ()) -> list[float]:
    """Mean daily net return (cost a side) of each tree's top k, in basis points; INVALID where it is defined in too few cells
    or dates. With a basis (columns of daily ranks) names go by the residual of the tree's ranks on those."""
    out: list[float] = []
    for at in range(0, len(nodes), BATCH):
        part = nodes[at : at + BATCH]
        wide = df.select("t", "code", ret, *basis, *[finite(compile_node(n)).alias(f"f{i}") for i, n in enumerate(part)])
        if basis:  # ranks of the tree and the basis: only sums of products leave a date
            wide = wide.withColumns({f"f{i}": cs_rank(F.col(f"f{i}")) for i in range(len(part))})
        long = wide.select("t", "code", ret, *basis, F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"f{i}").alias("x")) for i in range(len(part))])))
        if basis:
            long = residualize(long, "x", list(basis), "_left", ("i", "t")).drop("x").withColumnRenamed("_left", "x")
        w = W.partitionBy("i", "t").orderBy(F.col("x").desc_nulls_last(), "code")
        pick = F.when((F.row_number().over(w) <= k) & F.col("x").isNotNull(), net_return(F.col(ret), cost, cost))
        day = long.withColumn("pick", pick).groupBy("i", "t").agg(F.count("x").alias("n"), F.count(F.lit(1)).alias("all"), (F.coalesce(F.sum("pick"), F.lit(0.0)) / k).alias("v"))
        tot = day.groupBy("i").agg(F.avg(F.when(F.col("n") >= k, F.col("v"))).alias("v"), (F.sum("n") / F.sum("all")).alias("c"))
        got = {r["i"]: r for r in tot.collect()}  # one row a tree
        out += [1e4 * got[i]["v"] if i in got and got[i]["v"] is not None and got[i]["c"] >= min_coverage else INVALID for i in range(len(part))]
    return out


def survivors(df: DataFrame, scored: list[Scored], n: int, max_corr: float = 0.7) -> list[Scored]:
    """The best of positive fitness (and positive result on the selection block, if there is one), smaller trees first at
    ties, none too correlated with a better one."""
    value = lambda s: s.fitness if s.selection is None else s.selection
    ok = sorted((s for s in scored if s.fitness > 0 and value(s) > 0), key=lambda s: (-value(s), s.size, s.expression))
    kept: list[Scored] = []
    for at in range(0, len(ok), 4 * n):  # a block at a time against those kept, until there are n or none is left
        if len(kept) == n:
            break
        first, pool = len(kept), [*kept, *ok[at : at + 4 * n]]
        corr = {}
        if len(pool) > 1:
            wide = df.select("t", "code", *[finite(compile_node(s.node)).alias(f"f{i}") for i, s in enumerate(pool)])
            corr = {(r.a, r.b): r["corr"] for r in factor_correlation(wide, [f"f{i}" for i in range(len(pool))]).collect()}
        places = list(range(first))
        for i in range(first, len(pool)):
            if len(places) < n and all(abs(corr.get((f"f{j}", f"f{i}")) or 0) <= max_corr for j in places):
                places.append(i)
        kept = [pool[i] for i in places]
    return kept


def _span(df: DataFrame, span: tuple[int, int] | None) -> DataFrame:
    return df if span is None else df.where((F.col("t") >= span[0]) & (F.col("t") < span[1]))


def search(
    df: DataFrame, fields: list[str], ret: str, *, k: int = 4, population: int = 400, generations: int = 25, kind: str = "panel", seed: int = 1, keep: int = 5, max_depth: int = 5, max_size: int = 25,
    cost: float = 0.0, fit: tuple[int, int] | None = None, selection: tuple[int, int] | None = None, basis: tuple[str, ...] = (),
) -> list[Scored]:
    """Half-and-half start, tournaments of three, one-point crossover, subtree mutation; the best two always live on.

    fit and selection are spans [lo, hi) of dates; without them all dates serve for fitting and nothing is held back.
    """
    rnd = random.Random(seed)
    df = df.select("t", "code", ret, *fields, *basis).persist()
    train = _span(df, fit)
    memo: dict[str, Scored] = {}
    trees = [grow(rnd, fields, 2 + i % (max_depth - 2), kind, i % 2 == 0) for i in range(population)]
    try:
        for g in range(generations + 1):
            new = list({str(x): x for x in trees if str(x) not in memo}.values())
            for x, f in zip(new, fitness(train, new, ret, k, cost=cost, basis=basis)):
                memo[str(x)] = Scored(str(x), x, f, x.size)
            if g == generations:
                break
            pool = [memo[str(x)] for x in trees]
            pick = lambda: max(rnd.sample(pool, min(3, len(pool))), key=lambda s: (s.fitness, -s.size)).node
            best = sorted(pool, key=lambda s: (-s.fitness, s.size))[:2]
            trees = [s.node for s in best]
            while len(trees) < population:
                child = crossover(rnd, pick(), pick()) if rnd.random() < 0.7 else mutate(rnd, pick(), fields, kind)
                trees.append(child if child.depth <= max_depth and child.size <= max_size else pick())
        found = [s for s in memo.values() if s.fitness > 0]
        if selection is not None:
            later = fitness(_span(df, selection), [s.node for s in found], ret, k, cost=cost, basis=basis)
            found = [Scored(s.expression, s.node, s.fitness, s.size, v) for s, v in zip(found, later)]
        return survivors(train, found, keep)
    finally:
        df.unpersist()


def mine(df: DataFrame, fields: list[str], ret: str, *, rounds: int = 3, seed: int = 1, **kw) -> list[tuple[int, Scored]]:
    """(round, survivor): searches one after the other, each on what the survivors of those before it leave unexplained."""
    basis: list[str] = []
    out = []
    for n in range(rounds):
        found = search(df, fields, ret, seed=seed + n, basis=tuple(basis), **kw)
        for s in found:
            basis.append(f"_b{len(basis)}")
            df = df.withColumn(basis[-1], cs_rank(finite(compile_node(s.node))))
            out.append((n, s))
        if not found:
            break
    return out
