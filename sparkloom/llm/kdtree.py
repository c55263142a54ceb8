"""Exact top-k search by inner product with KD-trees over shards.

Shards are cells of median splits that a bounded sample of the vectors sets, so
that a shard's vectors lie together. Every shard gets a tree: median splits
along the widest side of a node's tight bounding box, down to leaves. A box
bounds the inner product of a query with anything inside it; a query visits
leaves from the best bound on and stops at the first leaf whose bound lies
below its k-th best score so far. It starts in the shard that holds it; its
k-th score there goes with it to the other shards, and it is sent to those only
whose box can hold a score as good.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import materialize, small

LEAF = 128
#: Vectors of a shard, and queries that meet a shard in one task, on average.
SHARD_ROWS = 16_384
BLOCK_QUERIES = 8_192
#: Vectors that the splits between shards are fitted on, at most. Any splits give the same results.
SAMPLE_ROWS = 16_384
#: Numbers of the shards' boxes up to which they are broadcast; beyond, every query goes to every shard.
BOX_NUMBERS = 4_000_000


class KdTree:
    """The leaves of a median-split tree, with their tight bounding boxes."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        self.leaves: list[np.ndarray] = []
        stack = [np.arange(len(vectors))]
        while stack:
            rows = stack.pop()
            low, high = vectors[rows].min(0), vectors[rows].max(0)
            axis = int((high - low).argmax())
            if len(rows) <= leaf or high[axis] == low[axis]:
                self.leaves.append(rows)
                continue
            order = np.argsort(vectors[rows, axis], kind="stable")
            half = len(rows) // 2
            stack += [rows[order[half:]], rows[order[:half]]]
        self.vectors = [vectors[x] for x in self.leaves]
        self.ids = [ids[x] for x in self.leaves]
        self.low = np.array([x.min(0) for x in self.vectors])
        self.high = np.array([x.max(0) for x in self.vectors])

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query and leaf, a number that no inner product with the leaf's vectors exceeds."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, scores: np.ndarray, found: np.ndarray, least: np.ndarray | float = -np.inf) -> int:
        """Improve each query's k best (scores descending, ids ascending among equals) by this tree's vectors.

        ``least`` is a k-th score that the query has elsewhere: leaves whose
        bound lies below it aren't visited.

        Leaves are visited best first. All queries take a step together, those
        that are at the same leaf as one product. Returns the leaves visited.
        """
        bounds = self.bounds(queries)
        order = np.argsort(-bounds, axis=1, kind="stable")
        active, step, visits = np.arange(len(queries)), 0, 0
        least = np.broadcast_to(least, len(queries))
        while len(active) and step < len(self.leaves):
            leaf = order[active, step]
            go = bounds[active, leaf] >= np.maximum(scores[active, k - 1], least[active])
            active, leaf = active[go], leaf[go]
            visits += len(active)
            by_leaf = np.argsort(leaf, kind="stable")
            for part in np.split(by_leaf, np.flatnonzero(np.diff(leaf[by_leaf])) + 1):
                if len(part):
                    at = leaf[part[0]]
                    self._merge(active[part], queries, own, k, self.vectors[at], self.ids[at], scores, found)
            step += 1
        return visits

    @staticmethod
    def _merge(rows, queries, own, k, vectors, ids, scores, found) -> None:
        new = queries[rows] @ vectors.T
        new[ids[None, :] == own[rows, None]] = -np.inf
        better = (new >= scores[rows, k - 1 : k]).any(1)
        rows, new = rows[better], new[better]
        if not len(rows):
            return
        every = np.concatenate([scores[rows], new], 1)
        names = np.concatenate([found[rows], np.broadcast_to(ids, new.shape)], 1)
        best = np.lexsort((names, -every), axis=1)[:, :k]
        scores[rows], found[rows] = np.take_along_axis(every, best, 1), np.take_along_axis(names, best, 1)


def quantized(vector: Column, factor: float = 64.0) -> Column:
    """floor(factor * x) of each component; null if the vector is null, empty or holds null or non-finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.when((F.size(vector) > 0) & ~bad, F.transform(vector, lambda x: F.floor(F.lit(factor) * x.cast("double"))))


class Splits:
    """Cells of the space by median splits along the widest side; a missing component counts as 0."""

    def __init__(self, sample: list[np.ndarray], cells: int):
        width = max((len(x) for x in sample), default=0)
        points = np.zeros((len(sample), width))
        for i, x in enumerate(sample):
            points[i, : len(x)] = x
        self.nodes: list[tuple[int, int, float]] = []  # (cell split, axis, value): what lies beyond the value becomes a new cell
        held = [np.arange(len(sample))]
        while len(held) < cells:
            at = max(range(len(held)), key=lambda i: len(held[i]))
            part = points[held[at]]
            if len(part) < 2 or (part == part[0]).all():
                break
            axis = int((part.max(0) - part.min(0)).argmax())
            value = float(np.median(part[:, axis]))
            above = part[:, axis] > value
            if not above.any():
                value = float(part[:, axis][part[:, axis] < value].max())
                above = part[:, axis] > value
            self.nodes.append((at, axis, value))
            held.append(held[at][above])
            held[at] = held[at][~above]

    def cells(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int64)
        for new, (at, axis, value) in enumerate(self.nodes, 1):
            if axis < points.shape[1]:
                out[(out == at) & (points[:, axis] > value)] = new
            elif value < 0:
                out[out == at] = new
        return out


_NEAR = "query_id long, vec_id long, score long, shard long, low array<double>, high array<double>"


def _grid(rows: pd.Series) -> np.ndarray:
    return np.array(rows.tolist(), np.float64)


def _searched(tree: KdTree, asked: np.ndarray, own: np.ndarray, k: int, least: np.ndarray | float = -np.inf) -> pd.DataFrame:
    largest = max(np.abs(tree.low).max(), np.abs(tree.high).max())
    if len(asked) and largest * np.abs(asked).max() * asked.shape[1] >= 2**53:
        raise ValueError("inner products beyond 2**53")
    scores, found = np.full((len(asked), k), -np.inf), np.full((len(asked), k), np.iinfo(np.int64).max)
    tree.search(asked, own, k, scores, found, least)
    real = np.isfinite(scores)
    return pd.DataFrame({"query_id": np.repeat(own, k)[real.ravel()], "vec_id": found[real], "score": scores[real].astype(np.int64)})


def _sharded(read: DataFrame, total: int, shard_rows: int) -> DataFrame:
    """``read`` (id, v, q) with shard, in the shared folder. Cells that the sample took for smaller are dealt by a hash of the id."""
    cells = max(1, -(-total // shard_rows))
    if cells > 1:
        share = min(1.0, SAMPLE_ROWS / total)
        sample = read.where(F.xxhash64("id", F.lit(5)).cast("double") / 2.0**64 + 0.5 < share).select("v").limit(2 * SAMPLE_ROWS).collect()
        splits = Splits([np.array(r["v"], np.float64) for r in sample], cells)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = np.zeros(len(batch), np.int64)
                width = batch["v"].map(len).to_numpy()
                for n in np.unique(width):
                    out[width == n] = splits.cells(_grid(batch["v"][width == n]))
                yield batch.assign(cell=out)

        placed = read.mapInPandas(run, "id long, v array<bigint>, q boolean, cell long")
    else:
        placed = read.withColumn("cell", F.lit(0).cast("long"))
    placed = materialize(placed, "cells")
    parts = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / (2 * shard_rows)).alias("parts"))
    shard = F.col("cell") * (1 << 24) + F.pmod(F.xxhash64("id"), F.col("parts"))
    return placed.join(small(materialize(parts, "parts")), "cell").select("id", "v", "q", shard.alias("shard"))


def search(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", is_query: Column, k: int = 20, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best other rows by integer inner product.

    Ties go to the smaller id; a query gets fewer rows if there are fewer
    candidates. Rows whose id or vector is null, or whose vector is empty or
    holds null or non-finite components, take no part, and vectors only meet
    those of their own length; rows that repeat an id are candidates each, but
    never of that id. Other columns aren't read; an empty table gives an empty
    result. Inner products must stay below 2**53, else an error is raised.

    A first round searches each shard for the queries in it. In the second one
    a query goes to the shards whose box bound reaches its k-th score, with that
    score; a shard with more than ``block_queries`` of them meets them in several
    tasks.
    """
    read = vectors.select(F.col(id_col).cast("long").alias("id"), quantized(F.col(vector_col)).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    placed = _sharded(read, read.count(), shard_rows)

    def at_home(group: pd.DataFrame) -> pd.DataFrame:
        out, shard = [], group["shard"].iloc[0]
        for _, same in group.groupby(group["v"].map(len)):
            tree = KdTree(_grid(same["v"]), same["id"].to_numpy())
            asked = same[same["q"]]
            if len(asked):
                out.append(_searched(tree, _grid(asked["v"]), asked["id"].to_numpy(), k))
            out.append(pd.DataFrame({"shard": [shard], "low": [tree.low.min(0)], "high": [tree.high.max(0)]}))
        rows = pd.concat(out, ignore_index=True).reindex(columns=["query_id", "vec_id", "score", "shard", "low", "high"])
        boxes = {c: [x if isinstance(x, np.ndarray) else None for x in rows[c]] for c in ("low", "high")}
        return rows.astype({c: "Int64" for c in ("query_id", "vec_id", "score", "shard")}).assign(**boxes)

    near = materialize(placed.groupBy("shard").applyInPandas(at_home, _NEAR), "near")
    home = near.where("query_id is not null").select("query_id", "vec_id", "score")
    boxes = near.where("low is not null").select("shard", "low", "high")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = home.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("least"))
    queries = placed.where("q").join(kth, "id", "left")
    numbers = boxes.agg(F.sum(F.size("low")) * 2).first()[0] or 0
    if numbers <= BOX_NUMBERS:
        known = [(r["shard"], np.array(r["low"]), np.array(r["high"])) for r in boxes.collect()]
        shared = vectors.sparkSession.sparkContext.broadcast(known)

        def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                width = batch["v"].map(len).to_numpy()
                for n in np.unique(width):
                    part = batch[width == n]
                    points = _grid(part["v"])
                    least = part["least"].fillna(-np.inf).to_numpy(np.float64)
                    for shard, low, high in shared.value:
                        if len(low) == n:
                            bound = np.maximum(points, 0) @ high + np.minimum(points, 0) @ low
                            go = (bound >= least) & (part["shard"].to_numpy() != shard)
                            if go.any():
                                yield pd.DataFrame({"id": part["id"][go], "v": part["v"][go], "least": part["least"][go].astype("Int64"), "shard": shard})

        sent = queries.mapInPandas(route, "id long, v array<bigint>, least long, shard long")
    else:
        others = boxes.select(F.col("shard").alias("other"), F.size("low").alias("width"))
        sent = queries.join(others, F.size("v") == F.col("width")).where("other <> shard").select("id", "v", "least", F.col("other").alias("shard"))
    sent = materialize(sent, "sent")
    blocks = materialize(sent.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / block_queries).cast("int").alias("blocks")), "blocks")
    asked = sent.join(small(blocks), "shard").select("id", "v", "least", F.lit(True).alias("q"), "shard", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"))
    held = placed.join(small(blocks), "shard").select("id", "v", F.lit(None).cast("long").alias("least"), F.lit(False).alias("q"), "shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

    def abroad(group: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype=np.int64)]
        for _, same in group.groupby(group["v"].map(len)):
            candidates, asked = same[~same["q"]], same[same["q"]]
            if len(candidates) and len(asked):
                tree = KdTree(_grid(candidates["v"]), candidates["id"].to_numpy())
                out.append(_searched(tree, _grid(asked["v"]), asked["id"].to_numpy(), k, asked["least"].fillna(-np.inf).to_numpy(np.float64)))
        return pd.concat(out)

    far = asked.unionByName(held).groupBy("shard", "block").applyInPandas(abroad, "query_id long, vec_id long, score long")
    return home.union(far).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
