"""Exact top-k inner-product search with a ball tree per shard.

Vectors are dealt into shards of bounded size by a hash of their id; each shard
is built into a ball tree (halved at the median along the direction between two
far points, down to small leaves). Queries come in blocks, and each block meets
every shard: a cell is a block beside TREES_PER_CELL shards, keyed by (dim, block,
part). Within a cell the shards are searched one after the other: nodes are opened
in the order of their upper bound q.c + |q| r, and the current k-th score, shared
by all shards of the cell, ends the search of a shard as soon as no node can beat
it. Cells share a first k-th score: each query's among SEED_ROWS sampled vectors,
which the true one cannot be below. The best k of each cell are merged per query.

Defined cases: vectors that are null or hold null or non-finite components take
no part; only vectors of equal length are compared; ties go to the smaller
vec_id; a query never meets rows of its own id; of rows with equal ids each
counts; a null id takes no part; extra columns are not read; an empty table
gives no rows.
"""

from __future__ import annotations

import heapq
import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mutspan.llm.common import partitions

SCALE = 1024
SHARD_ROWS = 8192
BLOCK_QUERIES = 8192
#: Queries of a block at least, where there are fewer blocks than tasks.
FEWEST_QUERIES = 64
TREES_PER_CELL = 4
#: Vectors, of any dimension, that give queries their first k-th score.
SEED_ROWS = 1024
LEAF_ROWS = 64
NONE = np.iinfo(np.int64).min


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, dim, v array<long>): floor(1024 x) of every usable vector."""
    usable = vectors.where(
        F.col("vec_id").isNotNull()
        & F.col("embedding").isNotNull()
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    )
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    return usable.select("vec_id", F.size("embedding").alias("dim"), whole.alias("v"))


def pack_arrays(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def matrix(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and integer vectors of a group."""
    ids = rows.column("vec_id").to_numpy()
    flat = rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return ids.astype(np.int64), flat.reshape(len(ids), -1).astype(np.int64)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products; through floating point where that is exact."""
    size = max(1, a.shape[-1]) * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    if size < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def build(ids: np.ndarray, v: np.ndarray) -> dict[str, np.ndarray]:
    """Ball tree in arrays: rows in leaf order; per node centre, radius, row range, children (-1: leaf)."""
    order = np.argsort(ids, kind="stable")
    ids, v = ids[order], v[order]
    x = v.astype(np.float64)
    rows = np.arange(len(ids))
    centre, radius, span, kids = [], [], [], []

    def node(a: int, b: int) -> int:
        part = x[rows[a:b]]
        c = part.mean(axis=0)
        gaps = np.sqrt(((part - c) ** 2).sum(axis=1))
        k = len(centre)
        centre.append(c)
        radius.append(gaps.max())
        span.append((a, b))
        kids.append((-1, -1))
        if b - a > LEAF_ROWS and gaps.max() > 0:
            far = part[int(gaps.argmax())]
            other = part[int(((part - far) ** 2).sum(axis=1).argmax())]
            halves = np.argsort(part @ (other - far), kind="stable")
            rows[a:b] = rows[a:b][halves]
            mid = (a + b) // 2
            kids[k] = (node(a, mid), node(mid, b))
        return k

    node(0, len(ids))
    return {"ids": ids[rows], "v": v[rows], "centre": np.array(centre), "radius": np.array(radius), "span": np.array(span), "kids": np.array(kids)}


def shards(vectors: DataFrame, rows_per_shard: int) -> tuple[DataFrame, int]:
    """(dim, shard, tree) rows: one serialised ball tree for each shard of each dimension."""
    n = max(1, -(-vectors.count() // rows_per_shard))

    def run(rows: pa.Table) -> pa.Table:
        ids, v = matrix(rows)
        tree = pa.array([pack_arrays(**build(ids, v))], pa.binary())
        return pa.table({"dim": pa.array([v.shape[1]], pa.int32()), "shard": rows.column("shard").slice(0, 1), "tree": tree})

    dealt = vectors.withColumn("shard", F.expr(f"pmod(xxhash64(vec_id, v), {n})"))
    return dealt.groupBy("dim", "shard").applyInArrow(run, "dim int, shard long, tree binary"), n


def seeds(vectors: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of SEED_ROWS rows at most, by dimension."""
    chosen = vectors.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(SEED_ROWS).toArrow()
    dims = chosen.column("dim").to_numpy()
    return {int(d): matrix(chosen.filter(pa.array(dims == d))) for d in np.unique(dims)}


def first_scores(ids: np.ndarray, q: np.ndarray, seed: tuple[np.ndarray, np.ndarray] | None, k: int) -> np.ndarray:
    """Each query's k-th score among the sampled vectors without its own id; NONE if there are fewer."""
    if seed is None or len(seed[0]) < k:
        return np.full(len(ids), NONE, np.int64)
    out = np.empty(len(ids), np.int64)
    for a in range(0, len(ids), 1024):
        scores = product(q[a : a + 1024], seed[1])
        scores[ids[a : a + 1024, None] == seed[0][None, :]] = NONE
        out[a : a + 1024] = np.partition(scores, -k, axis=1)[:, -k]
    return out


def query_blocks(queries: DataFrame, rows_per_block: int, seed: dict, k: int) -> tuple[DataFrame, int]:
    """(dim, block, queries) rows with their first scores, and the number of blocks."""
    number = queries.count()
    n = max(1, -(-number // rows_per_block), min(partitions(queries.sparkSession), -(-number // FEWEST_QUERIES)))

    def run(rows: pa.Table) -> pa.Table:
        ids, v = matrix(rows)
        packed = pack_arrays(ids=ids, v=v, first=first_scores(ids, v, seed.get(v.shape[1]), k))
        return pa.table({"dim": pa.array([v.shape[1]], pa.int32()), "block": rows.column("block").slice(0, 1), "queries": pa.array([packed], pa.binary())})

    dealt = queries.withColumn("block", F.expr(f"pmod(xxhash64(vec_id), {n})"))
    return dealt.groupBy("dim", "block").applyInArrow(run, "dim int, block long, queries binary"), n


def search_tree(tree: dict, qid: int, q: np.ndarray, bounds: np.ndarray, first: int, best: list[tuple[int, int]], k: int) -> None:
    """Best-first search; `best` is a heap of (score, -vec_id), worst first; scores below `first` are not wanted."""
    span, kids, ids, v = tree["span"], tree["kids"], tree["ids"], tree["v"]
    frontier = [(-bounds[0], 0)]
    while frontier:
        bound, at = heapq.heappop(frontier)
        least = max(first, best[0][0]) if len(best) == k else first
        if -bound < least:
            return
        left, right = kids[at]
        if left >= 0:
            heapq.heappush(frontier, (-bounds[left], left))
            heapq.heappush(frontier, (-bounds[right], right))
            continue
        a, b = span[at]
        scores = product(v[a:b], q[None, :])[:, 0]
        for i in np.flatnonzero(scores >= least):
            if ids[a + i] == qid:
                continue
            entry = (int(scores[i]), -int(ids[a + i]))
            if len(best) < k:
                heapq.heappush(best, entry)
            elif entry > best[0]:
                heapq.heapreplace(best, entry)


def search_cell(blocks: pa.Table, trees: pa.Table, k: int) -> pa.Table:
    """The best k of some trees for each query of a block."""
    rows = []
    for blob in blocks.column("queries"):
        loaded = np.load(io.BytesIO(blob.as_py()))
        ids, q, first = loaded["ids"], loaded["v"], loaded["first"]
        state = [[] for _ in ids]
        norms = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
        for tree_blob in trees.column("tree"):
            tree = dict(np.load(io.BytesIO(tree_blob.as_py())))
            dots = q.astype(np.float64) @ tree["centre"].T
            bounds = dots + norms[:, None] * tree["radius"][None, :]
            bounds += 1e-9 * (np.abs(bounds) + np.abs(dots)) + 1e-6  # rounding must not cut a winner off
            for i in range(len(ids)):
                search_tree(tree, ids[i], q[i], bounds[i], int(first[i]), state[i], k)
        rows += [(int(i), -e[1], e[0]) for i, best in zip(ids, state) for e in best]
    columns = list(zip(*rows)) if rows else [[], [], []]
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, rows_per_shard: int = SHARD_ROWS, rows_per_block: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows of `vectors` for each query.

    Both tables have vec_id and embedding; a query's own id is no candidate.
    """
    usable = quantised(vectors)
    trees, n = shards(usable, rows_per_shard)
    blocks, n_blocks = query_blocks(quantised(queries), rows_per_block, seeds(usable), k)
    cell = ["dim", "block", "part"]
    # the stated query set against all rows, in blocks: a tree is sent to each block, a block to each part
    parts = -(-n // TREES_PER_CELL)
    here = blocks.withColumn("part", F.explode(F.expr(f"sequence(0L, {parts - 1}L)")))
    there = trees.select("dim", F.expr(f"shard div {TREES_PER_CELL}").alias("part"), "tree", F.explode(F.expr(f"sequence(0L, {n_blocks - 1}L)")).alias("block"))
    found = here.groupBy(*cell).cogroup(there.groupBy(*cell)).applyInArrow(lambda a, b: search_cell(a, b, k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
