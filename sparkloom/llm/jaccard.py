"""N-gram Jaccard join in the metric space of shingle sets, exact.

Documents with equal sets are one point. The first n - ceil(t n) + k shingles of
a point, in any fixed order, are its *keys*: two points that link share k keys
at least. A point with fewer than k keys that any other has is alone (of two
sizes the smaller k counts). The points left that share a key make up a block,
and the smallest point of a block is its pivot. A pivot's *region* is all points of all
its blocks: every pair that may link is in some region, and boundary points are
in several. A region is then joined recursively and exactly: pivots split it
into Voronoi cells by Jaccard distance, a point is replicated to each cell
whose pivot is at most 2 (1 - t) farther than its nearest (by the triangle
inequality no link is lost), and small cells are compared pair by pair.

A large region is dealt out in tiles, each joined by itself together with the
pivot. Points within 1 - t of the pivot are linked by it and need no further
comparison with each other; only those that are not (outliers) still meet the
rest, tile by tile, if the triangle inequality leaves a link possible.

The order of shingles puts those last that a sample of the documents holds
repeatedly. Any order gives the same links; this one keeps common passages from
making large blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import U64, discard, materialize, mix, release, row_steps, small, text_buffers, words_of
from sparkloom.llm.components import connected_components

WORDS = 5
PERCENT = 80
#: Points of a tile of a region.
TILE = 1024
#: Points that are compared pair by pair; pivots of a set of points, and the largest distance at which a point is of a pivot's cell;
#: what the squares of the parts' sizes may add up to, at most, of the whole's.
LEAF = 24
PIVOTS = 8
FAR = 0.6
WORTH = 0.8
#: One document in so many is looked at for common shingles, and the most that are kept.
SAMPLE = 16
COMMON_AT_MOST = 4_000_000
_STEPS = mix(np.arange(1, 2 * WORDS + 2, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def shingle_sets(texts: pa.Array, size: int = WORDS) -> Iterator[np.ndarray]:
    """For each text the sorted 64-bit hashes of its distinct shingles.

    A text of fewer words is one shingle of all its words; without words it has
    none. Different shingles get different hashes but for chances of 2**-64.
    """
    data, offsets = text_buffers(texts)
    for first, last in row_steps(offsets):
        hashes, _, _, rows = words_of(data, offsets[first : last + 1])
        many = max(0, len(hashes) - size + 1)
        joined = np.zeros(many, U64)
        for k in range(size):
            joined += hashes[k : k + many] * _STEPS[k]
        joined = mix(joined)
        for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
            if b - a >= size:
                yield np.unique(joined[a : b - size + 1])
            elif b > a:
                yield mix((hashes[a:b] * _STEPS[size : size + b - a]).sum(keepdims=True, dtype=U64) + U64(b - a))
            else:
                yield np.zeros(0, U64)


def set_key(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share, as two signed integers."""
    return int(mix(shingles ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64).astype(np.int64)), int(mix(shingles + U64(0x14057B7EF767814F)).sum(dtype=U64).astype(np.int64))


def needed(n: int, percent: int = PERCENT) -> int:
    """Shingles that a set of n must share with any set it links with."""
    return -(-percent * n // 100)


def spare(n: int) -> int:
    """Keys that two points share at least which link, if the smaller one has n shingles."""
    return 1 + n // 10


class Region:
    """Points given by sorted hash arrays, and their links found so far (a forest)."""

    def __init__(self, sets: list[np.ndarray], percent: int = PERCENT):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)
        self.words, self.codes = np.unique(np.concatenate(sets), return_inverse=True)
        self.percent = percent
        self.parent = list(range(len(sets)))
        self.links: list[tuple[int, int]] = []
        #: How often points were parted by size and into cells, and the pairs of points that leaves compared.
        self.counts = {"halves": 0, "cells": 0, "pairs": 0}

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def link(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.links.append((x, y))

    def shared(self, pivot: int, points: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of one point with others."""
        mark = np.zeros(len(self.words), np.int64)
        mark[self.codes[self.starts[pivot] : self.starts[pivot] + self.sizes[pivot]]] = 1
        sizes = self.sizes[points]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(self.starts[points] - (ends - sizes), sizes)
        return np.add.reduceat(mark[self.codes[at]], ends - sizes)

    def distances(self, pivot: int, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Jaccard distances of points to a pivot, and which are linked with it."""
        both = self.shared(pivot, points)
        union = self.sizes[pivot] + self.sizes[points] - both
        return 1 - both / union, 100 * both >= self.percent * union

    def join(self, points: np.ndarray, home: np.ndarray) -> None:
        """Link the points at most 1 - t apart of which one at least is at home here."""
        reach = 1 - self.percent / 100 + 1e-9
        stack = [(points, home)]
        while stack:
            points, home = stack.pop()
            if len(points) > LEAF:
                parts = self._halves(points, home) or self._cells(points, home, reach)
                if parts:
                    stack += parts
                    continue
            self._leaf(points, home)

    def _halves(self, points: np.ndarray, home: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """The points parted at a size, each half with those of the other that are near enough in size to link; none if that leaves almost all."""
        sizes = self.sizes[points]
        cut = int(np.median(sizes[home])) if home.any() else 0
        small = sizes <= cut
        parts = []
        for mine in (small, ~small):
            if (mine & home).any():
                low, high = sizes[mine & home].min(), sizes[mine & home].max()
                inside = (100 * sizes >= self.percent * low) & (self.percent * sizes <= 100 * high)
                parts.append((points[inside], (home & mine)[inside]))
        if not parts or sum(len(x) ** 2 for x, _ in parts) > WORTH * len(points) ** 2:
            return []
        self.counts["halves"] += 1
        return parts

    def _cells(self, points: np.ndarray, home: np.ndarray, reach: float) -> list[tuple[np.ndarray, np.ndarray]]:
        """Voronoi cells of a few pivots, each with the points in its window; none if windows would hold almost all points.

        A point may link with one of a cell if it is at most 2 ``reach`` farther
        from the cell's pivot than from its own, and at most ``reach`` beyond the
        cell's radius. Points farther than FAR from every pivot make up a cell
        without a pivot; what is nearer than that by more than ``reach`` doesn't
        link with them.
        """
        far, pivots = [], [0]
        for _ in range(PIVOTS):
            row, linked = self.distances(int(points[pivots[-1]]), points)
            for y in points[linked]:
                self.link(int(points[pivots[-1]]), int(y))
            far.append(row)
            pivots.append(int(np.min(far, 0).argmax()))
            if np.min(far, 0)[pivots[-1]] <= reach:
                break
        every = np.array(far)
        nearest, least = every.argmin(0), every.min(0)
        parts = []
        for c, row in enumerate(every):
            mine = home & (nearest == c) & (least <= FAR)
            if mine.any():
                inside = (row <= least + 2 * reach) & (row <= row[mine].max() + reach)
                parts.append((points[inside], mine[inside]))
        if (home & (least > FAR)).any():
            inside = least > FAR - reach
            parts.append((points[inside], (home & (least > FAR))[inside]))
        if len(far) < 2 or not parts or sum(len(x) ** 2 for x, _ in parts) > WORTH * len(points) ** 2:
            return []
        self.counts["cells"] += len(parts)
        return parts

    def _leaf(self, points: np.ndarray, home: np.ndarray) -> None:
        for i in range(len(points) - 1):
            x, rest, at_home = int(points[i]), points[i + 1 :], home[i + 1 :]
            a = self.root(x)
            open_ = np.array([self.root(int(y)) != a for y in rest]) & (at_home | home[i])
            size = self.sizes[rest]
            open_ &= (100 * np.minimum(size, self.sizes[x]) >= self.percent * np.maximum(size, self.sizes[x]))
            rest = rest[open_]
            self.counts["pairs"] += len(rest)
            if len(rest):
                for y in rest[self.distances(x, rest)[1]]:
                    self.link(x, int(y))


def common_shingles(docs: DataFrame, id_col: str, text_col: str) -> np.ndarray:
    """Sorted hashes of shingles that several sampled documents hold; COMMON_AT_MOST at most, the most frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s for s in shingle_sets(batch.column(0)) if len(s)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["s"])
        release()

    sample = docs.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(SAMPLE)) == 0).select(F.col(text_col).cast("string").alias("text"))
    counts = sample.mapInArrow(run, "s long").groupBy("s").count().where("count > 1")
    rows = counts.orderBy(F.desc("count"), "s").limit(COMMON_AT_MOST).select("s").toPandas()["s"]
    return np.sort(rows.to_numpy(np.int64).view(U64))


def _points(docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """id, hi, lo, n, keys: a document's set by its 128 bits and size, and its first shingles in the order."""
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, id_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = common.value
        for batch in batches:
            hi, lo, n, keys = [], [], [], []
            for s in shingle_sets(batch.column(1)):
                a, b = set_key(s)
                hi.append(a)
                lo.append(b)
                n.append(len(s))
                if len(s) and len(last):
                    at = np.minimum(np.searchsorted(last, s), len(last) - 1)
                    common_here = last[at] == s
                    s = np.concatenate([s[~common_here], s[common_here]])
                keys.append(s[: n[-1] - needed(n[-1], percent) + spare(n[-1])].view(np.int64) if n[-1] else s.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(n, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["id", "hi", "lo", "n", "keys"])
        release()

    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return materialize(read.mapInArrow(run, "id long, hi long, lo long, n long, keys array<bigint>"), "points")


def _with_sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, s of the documents whose ids are in ``ids``; equal rows once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.view(np.int64) for s in shingle_sets(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "s"])
        release()

    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return read.join(ids, "id", "left_semi").mapInArrow(run, "id long, s array<bigint>")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows of equal first ``keys`` columns, from batches in which these lie together."""
    open_: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*open_, batch])
        codes = np.stack([table.column(i).to_numpy() for i in range(keys)])
        cuts = [0, *(np.flatnonzero((codes[:, 1:] != codes[:, :-1]).any(0)) + 1).tolist()]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield table.slice(a, b - a)
        open_ = table.slice(cuts[-1]).combine_chunks().to_batches()
    if open_:
        yield pa.Table.from_batches(open_)


def _read_group(group: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    sets = group.column("s").combine_chunks()
    values, offsets = sets.values.to_numpy().view(U64), sets.offsets.to_numpy()
    return group.column("id").to_numpy(), [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _join_tiles(tiles: DataFrame, percent: int) -> DataFrame:
    """From rows (p, tile, id, s, the pivot among them) to links (a, b) and distances to the pivot and sizes (d and n at b, a the pivot)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 2):
            ids, sets = _read_group(group)
            pivot = group.column("p")[0].as_py()
            region = Region(sets, percent)
            every = np.arange(len(ids))
            first = int(np.flatnonzero(ids == pivot)[0])
            far, linked = region.distances(first, every)
            for y in np.flatnonzero(linked):
                region.link(first, int(y))
            region.join(every, np.ones(len(ids), bool))
            a, b = (ids[[x[i] for x in region.links]] if region.links else np.zeros(0, np.int64) for i in (0, 1))
            core = np.array([region.root(int(x)) == region.root(first) for x in every])
            rows = [np.concatenate([a, np.full(len(ids), pivot)]), np.concatenate([b, ids]), np.concatenate([np.full(len(a), np.nan), far]), np.concatenate([np.zeros(len(a), np.int64), region.sizes]), np.concatenate([np.ones(len(a), bool), core])]
            yield pa.RecordBatch.from_arrays([pa.array(x, from_pandas=True) for x in rows], ["a", "b", "d", "n", "core"])
        release()

    placed = tiles.repartition("p", "tile").sortWithinPartitions("p", "tile")
    return placed.select("p", "tile", "id", "s").mapInArrow(run, "a long, b long, d double, n long, core boolean")


def _join_outliers(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) from rows (p, cell, chunk, tile, id, s, d, core, asked): outliers of a chunk of a cell with what is in a tile."""
    reach = 1 - percent / 100 + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 4):
            ids, sets = _read_group(group)
            far, asked = group.column("d").to_numpy(), group.column("asked").to_numpy(zero_copy_only=False)
            region = Region(sets, percent)
            rest, core = np.flatnonzero(~asked), np.flatnonzero(group.column("core").to_numpy(zero_copy_only=False))
            for x in core.tolist():  # the pivot links them
                region.parent[x] = int(core[0])
            if len(rest):
                for x in np.flatnonzero(asked):
                    near = rest[np.abs(far[rest] - far[x]) <= reach]
                    near = near[[region.root(int(y)) != region.root(int(x)) for y in near]] if len(near) else near
                    if len(near):
                        for y in near[region.distances(int(x), near)[1]]:
                            region.link(int(x), int(y))
            if region.links:
                yield pa.RecordBatch.from_arrays([pa.array(ids[[x[i] for x in region.links]]) for i in (0, 1)], ["a", "b"])
        release()

    placed = members.repartition("p", "cell", "chunk", "tile").sortWithinPartitions("p", "cell", "chunk", "tile")
    return placed.select("p", "cell", "chunk", "tile", "id", "s", "d", "core", "asked").mapInArrow(run, "a long, b long")


def jaccard_links(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, tile: int = TILE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(points, copies, components): points has id, hi, lo, n for each row, copies the smallest id of each set (hi, lo) that several ids have.

    A node is the smallest id of a set; components (node, component) has those
    that link with another set.
    """
    points = _points(docs, id_col, text_col, percent)
    full = points.where("n > 0 and id is not null")
    firsts = full.groupBy("hi", "lo").agg(F.min("id").alias("first"), F.max("id").alias("top")).where("first < top")
    copies = materialize(firsts.select("hi", "lo", "first"), "copies")
    single = full.join(small(copies), ["hi", "lo"], "left").where("first is null or first = id")
    keys = single.select("id", F.explode("keys").alias("key"))
    sizes = single.select("id", "n")
    least = 1 + F.floor(F.ceil(F.col("n") * percent / 100) / 10)
    written = []
    for _ in range(2):
        held = keys.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
        hits = materialize(keys.join(held, "key"), "hits")
        counts = hits.groupBy("id").agg(F.count(F.lit(1)).alias("c"))
        enough = materialize(counts.join(sizes, "id").groupBy("id").agg(F.max("c").alias("c"), F.min("n").alias("n")).where(F.col("c") >= least).select("id"), "enough")
        keys = hits.join(small(enough), "id", "left_semi").select("id", "key")
        written += [hits, enough]
    pivots = keys.groupBy("key").agg(F.min("id").alias("p"), F.max("id").alias("top")).where("p < top").select("key", "p")
    stars = materialize(keys.join(pivots, "key").where("id <> p").select("p", "id").distinct(), "stars")
    discard(*written)
    counts = stars.groupBy("p").agg(F.count(F.lit(1)).alias("m")).withColumn("tiles", F.ceil(F.col("m") / tile).cast("int"))
    asked = materialize(stars.select("id").union(stars.select("p")).distinct(), "asked")
    found_sets = _with_sets(docs, small(asked), id_col, text_col)
    if not full.groupBy("id").count().where("count > 1").isEmpty():  # several rows of one id
        found_sets = found_sets.dropDuplicates(["id", "s"])
    sets = materialize(found_sets, "sets")
    mine = stars.join(counts, "p").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    pivot_rows = counts.select("p", F.col("p").alias("id"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))
    tiles = mine.select("p", "id", "tile").unionByName(pivot_rows).join(sets, "id")
    found = materialize(_join_tiles(tiles, percent), "tiles")
    # outliers of regions of several tiles against what may link with them: neighbours by size and by distance to the pivot
    reach = 1 - percent / 100 + 1e-9
    by_size, by_far = F.floor(F.log(F.col("n")) / math.log(100 / percent) + 1e-9).cast("int"), F.floor(F.col("d") / reach).cast("int")
    rest = found.where("d is not null and a <> b").select(F.col("a").alias("p"), F.col("b").alias("id"), "d", "core", by_size.alias("by_size"), by_far.alias("by_far")).join(counts.where("tiles > 1").select("p"), "p")
    cell = lambda x, y: (x * 16 + y).cast("int").alias("cell")
    outliers = rest.where("not core").withColumn("cell", cell(F.col("by_size"), F.col("by_far")))
    chunks = materialize(outliers.groupBy("p", "cell").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("chunks")), "cells")
    if not chunks.isEmpty():
        step = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
        near = rest.withColumn("x", F.explode(step)).select("p", "id", "d", "core", cell(F.col("by_size") + F.col("x.i"), F.col("by_far") + F.col("x.j"))).join(chunks, ["p", "cell"])
        tiles_of = materialize(near.groupBy("p", "cell").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles")), "cells")
        chunk, place = F.pmod(F.xxhash64("id", F.lit(1)), "chunks").cast("int"), F.pmod(F.xxhash64("id"), "tiles").cast("int")
        asked_rows = outliers.join(chunks, ["p", "cell"]).join(tiles_of, ["p", "cell"]).select("p", "cell", "id", "d", "core", chunk.alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), F.lit(True).alias("asked"))
        others = near.join(tiles_of, ["p", "cell"]).select("p", "cell", "id", "d", "core", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), place.alias("tile"), F.lit(False).alias("asked"))
        late = _join_outliers(asked_rows.unionByName(others).join(sets, "id"), percent)
        links = found.where("d is null").select("a", "b").union(late)
    else:
        links = found.where("d is null").select("a", "b")
    components = connected_components(links)
    discard(stars, asked, sets, found, chunks)
    return points, copies, components


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, tile: int = TILE) -> DataFrame:
    """id_col, n_shingles, component_id of every row.

    Sets are of distinct 5-word shingles, A-Z as a-z, words parted by ASCII
    white space; a text of fewer words is one shingle. Two documents link when
    ``percent`` of their union is shared; component_id is the smallest id that
    links reach. Null, empty and blank texts have no shingles and link with
    nothing. Rows that share an id are one document with several texts: what
    links with one of them links with the id. A row without an id gets a null
    component. Other columns aren't read; an empty table gives an empty one.
    """
    points, copies, components = jaccard_links(docs, id_col=id_col, text_col=text_col, percent=percent, tile=tile)
    full = points.where("n > 0 and id is not null").select("id", "n", "hi", "lo")
    noded = full.join(small(copies), ["hi", "lo"], "left").select("id", "n", F.coalesce("first", "id").alias("node"))
    joined = noded.join(small(components), "node", "left").select("id", "n", F.coalesce("component", "node").alias("component"))
    alone = points.where("n = 0 or id is null").select("id", "n", F.col("id").alias("component"))
    return joined.union(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component, the one whose id names it.

    Rows that share an id stay or go together; rows without an id stay.
    """
    found = jaccard_components(docs, id_col=id_col, text_col=text_col, percent=percent)
    gone = materialize(found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(id_col)).distinct(), "copies")
    return docs.join(small(gone), id_col, "left_anti").select(*docs.columns)
