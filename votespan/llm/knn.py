"""Exact top-k search by inner product in KD-trees, one tree a shard.

Vectors are dealt into cells by median cuts, fitted on at most ``2 * SAMPLE`` vectors, so that
like vectors lie together; every vector is indexed.  A cell of more than ``shard_size`` vectors
is dealt on by a hash, so a vector that a third of the rows repeat fills no shard.  A shard's
tree splits at the median of its widest dimension down to small leaves and keeps the tight box
of every node; it is built once and written to the shared folder.  The best score a box can
hold for a query is the sum of the better corner in each dimension, so nodes are taken best
first until the bound falls below the query's kth score.

Queries travel, trees stay.  A query first searches the shard it lives in; the kth score found
there is passed on.  It is then sent to the shards of those cells only whose box may hold that
score, where it is pruned from the root down.  Each task loads one tree at a time and streams
the queries sent to it past, ``block_size`` at once.  A node whose bound equals the kth score is
still opened: ties go to smaller ids.

Cases: vectors that are null or hold null, NaN or infinite components take no part, neither
as queries nor as candidates; nor do rows without id.  Vectors are compared with vectors of
their own length.  Rows that repeat an id are candidates each by itself, are not candidates of
a query of that id, and as queries give one result each, or one in all if their vectors agree.
Rows that agree in id and vector are one row of a shard with its number of copies, and are ranked
as often as they occur.  Components must fit 31 bits after
scaling, or it raises.  Other columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window, functions as F

from votespan.llm.common import longs, shuffle_partitions, stash

#: Inner products below this are exact in floating point.
EXACT = 2.0**53
#: Vectors that the cells are fitted on, about, and how many of them a cell needs at least.
SAMPLE, PER_CELL = 4096, 16
#: Vectors in a shard: as few as the lower, so that all tasks have some; as many as the upper, or as fit into so many bytes.
SHARD_ROWS, SHARD_BYTES = (8192, 131_072), 32 << 20


class KdTree:
    """Median splits on the widest dimension, tight boxes; node i has children 2i+1 and 2i+2."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int):
        self.ids, self.vectors = ids, vectors
        depth = 0
        while leaf << depth < len(ids):
            depth += 1
        self.nodes = (2 << depth) - 1
        self.first_leaf = (1 << depth) - 1
        self.low = np.zeros((self.nodes, vectors.shape[1]))
        self.high = np.zeros((self.nodes, vectors.shape[1]))
        self.rows: dict[int, np.ndarray] = {}
        self._split(0, np.arange(len(ids)))

    def _split(self, node: int, rows: np.ndarray) -> None:
        own = self.vectors[rows]
        if len(rows):
            self.low[node], self.high[node] = own.min(axis=0), own.max(axis=0)
        if node >= self.first_leaf:
            self.rows[node] = rows
            return
        middle = len(rows) // 2
        if len(rows) and own.shape[1]:
            widest = int(np.argmax(self.high[node] - self.low[node]))
            rows = rows[np.argpartition(own[:, widest], middle)] if middle else rows
        self._split(2 * node + 1, rows[:middle])
        self._split(2 * node + 2, rows[middle:])

    def packed(self, copies: np.ndarray) -> list[bytes]:
        """Ids, copies, vectors in the order of the leaves, where the leaves begin, boxes."""
        leaves = [self.rows[node] for node in range(self.first_leaf, self.nodes)]
        order = np.concatenate(leaves)
        starts = np.cumsum([0, *map(len, leaves)])
        return [self.ids[order].astype("<i8").tobytes(), copies[order].astype("<i8").tobytes(), starts.astype("<i4").tobytes(),
                *(x.astype("<i4").tobytes() for x in (self.vectors[order], self.low, self.high))]

    @classmethod
    def unpacked(cls, dims: int, ids: bytes, copies: bytes, starts: bytes, *parts: bytes) -> tuple[KdTree, np.ndarray]:
        """(the tree, copies of its vectors) from what ``packed`` gave."""
        tree = cls.__new__(cls)
        tree.ids, edges = np.frombuffer(ids, "<i8"), np.frombuffer(starts, "<i4").tolist()
        tree.first_leaf = len(edges) - 2
        tree.nodes = 2 * tree.first_leaf + 1
        tree.vectors, tree.low, tree.high = (
            np.frombuffer(x, "<i4").reshape(n, dims).astype(kind)
            for x, n, kind in zip(parts, (len(tree.ids), tree.nodes, tree.nodes), (np.int64, np.float64, np.float64)))
        tree.rows = {tree.first_leaf + i: np.arange(a, b) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:]))}
        return tree, np.frombuffer(copies, "<i8")

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The best score each node may hold for each query."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query: np.ndarray, own: int, bounds: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(scores, ids, places among the vectors) of the best ``k`` that reach ``floor``, without ids equal to ``own``."""
        scores, ids, places = np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
        heap = [(-bounds[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < floor:
                break
            if node < self.first_leaf:
                for child in (2 * node + 1, 2 * node + 2):
                    if bounds[child] >= floor:
                        heapq.heappush(heap, (-bounds[child], child))
                continue
            rows = self.rows[node]
            if not len(rows):
                continue
            found = self.vectors[rows] @ query
            near = (found >= floor) & (self.ids[rows] != own)
            scores, ids = np.concatenate([scores, found[near]]), np.concatenate([ids, self.ids[rows][near]])
            places = np.concatenate([places, rows[near]])
            if len(ids) > k:
                best = np.lexsort((ids, -scores))[:k]
                scores, ids, places = scores[best], ids[best], places[best]
            if len(ids) == k:
                floor = max(floor, scores.min())
        return scores, ids, places


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """Rows of packed vectors of one length."""
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").astype(np.int64).reshape(len(column), dims)


def _packed_rows(batches):
    """Vectors as 32-bit integers on end."""
    for batch in batches:
        vectors = batch.column(batch.schema.get_field_index("v"))
        values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        if np.abs(values).max(initial=0) >= 2**31:
            raise ValueError("a component is too large")
        raw, ends = values.astype("<i4").tobytes(), np.cumsum(longs(batch, "dims")) * 4
        rows = [raw[x:y] for x, y in zip([0, *ends[:-1].tolist()], ends.tolist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(rows, pa.binary())], names=["vec_id", "dims", "raw"])


def median_cuts(vectors: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """(dimension, value) to cut at in each inner node of a tree of ``levels``; values up to it go left."""
    at, cut = np.zeros((1 << levels) - 1, np.int64), np.zeros((1 << levels) - 1, np.int64)
    own = {0: vectors}
    for node in range(len(at)):
        rows = own.pop(node)
        if len(rows):
            at[node] = int(np.argmax(rows.max(axis=0) - rows.min(axis=0)))
            cut[node] = np.partition(rows[:, at[node]], (len(rows) - 1) // 2)[(len(rows) - 1) // 2]
        right = rows[:, at[node]] > cut[node]
        own[2 * node + 1], own[2 * node + 2] = rows[~right], rows[right]
    return at, cut


def cells_of(vectors: np.ndarray, cuts: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """The cell of each vector; a length without cuts has one cell."""
    node = np.zeros(len(vectors), np.int64)
    if cuts is None:
        return node
    inner = len(cuts[0])
    for _ in range(inner.bit_length()):
        node = 2 * node + 1 + (vectors[np.arange(len(node)), cuts[0][node]] > cuts[1][node])
    return node - inner


def _fit_cells(rows: DataFrame, total: int, shard_size: int | None) -> tuple[dict, int]:
    """(cuts of each length, vectors in a shard), from a bounded draw."""
    share = -(-total // SAMPLE)
    drawn = rows.where(F.pmod(F.xxhash64("row", F.lit(5)), F.lit(share)) == 0).limit(2 * SAMPLE).select("dims", "raw").toArrow()
    lengths = longs(drawn, "dims") if drawn.num_rows else np.zeros(0, np.int64)
    if shard_size is None:
        tasks = shuffle_partitions(rows.sparkSession)
        room = SHARD_BYTES // (4 * int(lengths.max(initial=0)) + 16)
        shard_size = max(1, min(max(total // (4 * tasks), SHARD_ROWS[0]), SHARD_ROWS[1], room))
    cuts = {}
    for dims in np.unique(lengths).tolist():
        raw = drawn.column("raw").take(pa.array(np.flatnonzero(lengths == dims)))
        levels = min(len(raw) // PER_CELL, len(raw) * share // shard_size).bit_length() - 1
        if dims and levels > 0:
            cuts[dims] = median_cuts(_matrix(raw, dims), levels)
    return cuts, shard_size


def _with_cells(cuts: dict):
    """Adds the cell of each vector."""

    def run(batches):
        for batch in batches:
            lengths, raw = longs(batch, "dims"), batch.column(batch.schema.get_field_index("raw"))
            cell = np.zeros(len(lengths), np.int64)
            for dims in np.unique(lengths).tolist():
                if dims in cuts:
                    at = np.flatnonzero(lengths == dims)
                    cell[at] = cells_of(_matrix(raw.take(pa.array(at)), dims), cuts[dims])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    return run


PARTS = ("ids", "copies", "starts", "vectors", "low", "high")
TREE = ", ".join(f"{p} binary" for p in PARTS)


def _grown(leaf: int):
    """The tree of one shard as a row, with its size."""

    def run(key, table):
        dims, cell, sub = (x.as_py() for x in key)
        tree = KdTree(table.column("vec_id").to_numpy(), _matrix(table.column("raw"), dims), leaf)
        parts = tree.packed(table.column("copies").to_numpy())
        return pa.table({
            "dims": pa.array([dims], pa.int64()), "cell": pa.array([cell], pa.int64()), "sub": pa.array([sub], pa.int64()),
            "n": pa.array([table.num_rows], pa.int64()), **{name: pa.array([x], pa.binary()) for name, x in zip(PARTS, parts)}})

    return run


def _whole_box(table: pa.Table) -> pa.Table:
    """The box around all shards of a cell; four bytes a component."""
    low, high = (np.stack([np.frombuffer(x, "<i4") for x in table.column(name).to_pylist()]) for name in ("low", "high"))
    return pa.table({
        "dims": table.column("dims").slice(0, 1), "cell": table.column("cell").slice(0, 1),
        "low": pa.array([low.min(axis=0).tobytes()], pa.binary()), "high": pa.array([high.max(axis=0).tobytes()], pa.binary())})


def _routed(boxes: dict):
    """Adds the cells whose box may hold the score ``floor``; a length without boxes has one cell, which is open."""

    def run(batches):
        for batch in batches:
            lengths, floors = longs(batch, "dims"), longs(batch, "floor")
            raw = batch.column(batch.schema.get_field_index("raw"))
            cells: list[list[int]] = [[0]] * len(lengths)
            for dims in np.unique(lengths).tolist():
                if dims not in boxes:
                    continue
                names, low, high = boxes[dims]
                at = np.flatnonzero(lengths == dims)
                q = _matrix(raw.take(pa.array(at)), dims).astype(np.float64)
                best = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
                near = best + np.abs(best) * 1e-9 + 1 >= floors[at, None]
                for i, row in zip(at.tolist(), near):
                    cells[i] = names[row].tolist()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cells, pa.list_(pa.int64()))], names=[*batch.schema.names, "cells"])

    return run


def _past(k: int, block_size: int):
    """Rows sorted by (dims, cell, sub, query_id): a shard's tree (without query_id) comes before the queries sent to it."""

    def run(batches):
        tree = copies = shard = None
        for batch in batches:
            keys = np.stack([longs(batch, x) for x in ("dims", "cell", "sub")], axis=1)
            is_tree = batch.column(batch.schema.get_field_index("query_id")).is_null().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1) | is_tree[:-1]) + 1
            edges = [0, *cuts.tolist(), len(keys)]
            for a, b in zip(edges[:-1], edges[1:]):
                if a < b and is_tree[a]:
                    shard = keys[a].tolist()
                    tree, copies = KdTree.unpacked(
                        shard[0], *(batch.column(batch.schema.get_field_index(x))[a].as_py() for x in PARTS))
                elif a < b and keys[a].tolist() == shard:
                    for i in range(a, b, block_size):
                        yield _asked(tree, copies, batch.slice(i, min(block_size, b - i)), shard[0], k)

    return run


def _asked(tree: KdTree, copies: np.ndarray, queries: pa.RecordBatch, dims: int, k: int) -> pa.RecordBatch:
    q = _matrix(queries.column(queries.schema.get_field_index("raw")), dims)
    bounds = tree.bounds(q.astype(np.float64))
    most = max(np.abs(tree.low[0]).max(initial=0), np.abs(tree.high[0]).max(initial=0))
    kind = np.float64 if most * float(np.abs(q).max(initial=0)) * max(dims, 1) < EXACT else np.int64
    if kind is np.int64:
        bounds = bounds + np.abs(bounds) * 1e-9 + 1
    if tree.vectors.dtype != kind:
        tree.vectors = tree.vectors.astype(kind)
    q = q.astype(kind)
    out: list[tuple[np.ndarray, ...]] = []
    for i, (own, row, floor) in enumerate(zip(longs(queries, "query_id"), longs(queries, "row"), longs(queries, "floor"))):
        scores, ids, places = tree.search(q[i], own, bounds[i], k, floor)
        out.append((np.full(len(ids), own), np.full(len(ids), row), ids, scores.astype(np.int64), copies[places]))
    columns = [np.concatenate(c).astype(np.int64) for c in zip(*out)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "row", "vec_id", "score", "copies"])


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(vec_id, v, dims): scaled and floored, rows that take part only."""
    values = F.col(vector_col).cast("array<double>")
    sound = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = df.where(F.col(id_col).isNotNull() & values.isNotNull() & F.coalesce(sound, F.lit(False)))
    return kept.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.transform(values, lambda x: F.floor(x * F.lit(scale))).alias("v")).withColumn("dims", F.size("v").cast("long"))


def grow_trees(rows: DataFrame, cuts: dict, shard_size: int, leaf: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vectors with their shard, cells with their number of shards, trees), the last two written once."""
    celled = rows.mapInArrow(_with_cells(cuts), rows.withColumn("cell", F.lit(0).cast("long")).schema)
    cells = stash(celled.groupBy("dims", "cell").agg(F.ceil(F.count("*") / shard_size).cast("long").alias("subs")), "cells")
    dealt = celled.join(cells, ["dims", "cell"]).withColumn("sub", F.pmod("row", "subs")).drop("subs")
    trees = stash(
        dealt.select("dims", "cell", "sub", "vec_id", "raw", "copies").groupBy("dims", "cell", "sub")
        .applyInArrow(_grown(leaf), f"dims long, cell long, sub long, n long, {TREE}"), "trees")
    return dealt, cells, trees


def top_k(
    candidates: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20,
    scale: float = 64.0, shard_size: int | None = None, block_size: int = 2048, leaf: int = 128,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best of all other rows for each query.

    ``is_query`` is over ``vec_id``.  Without ``shard_size`` shards hold a quarter of a task's
    share of the vectors, within ``SHARD_ROWS`` and ``SHARD_BYTES``: larger shards are sent fewer
    queries in all.
    """
    spark = candidates.sparkSession
    vectors = whole_vectors(candidates, id_col, vector_col, scale)
    rows = stash(
        vectors.mapInArrow(_packed_rows, "vec_id long, dims long, raw binary")
        .groupBy("vec_id", "dims", "raw").agg(F.count("*").alias("copies"))
        .withColumn("row", F.xxhash64("vec_id", "raw")).withColumn("query", F.coalesce(is_query, F.lit(False))), "vectors")
    cuts, shard_size = _fit_cells(rows, rows.count(), shard_size)
    dealt, cells, trees = grow_trees(rows, cuts, shard_size, leaf)
    asked = stash(dealt.where("query").select(
        F.col("vec_id").alias("query_id"), "row", "dims", "cell", "sub", "raw"), "queries")
    parts = 2 * shuffle_partitions(spark)

    def against(queries: DataFrame) -> DataFrame:
        both = trees.drop("n").unionByName(queries.select("dims", "cell", "sub", "query_id", "row", "raw", "floor"), allowMissingColumns=True)
        return both.repartition(parts, "dims", "cell", "sub").sortWithinPartitions(
            "dims", "cell", "sub", F.asc_nulls_first("query_id")).mapInArrow(
            _past(k, block_size), "query_id long, row long, vec_id long, score long, copies long")

    # At home first: what is kth there is a floor everywhere else.
    start = F.lit(float("-inf"))
    home = stash(against(asked.withColumn("floor", start)), "home-results")
    floors = home.groupBy("query_id", "row").agg(
        F.when(F.count("*") >= k, F.min("score").cast("double")).alias("kth"))
    away = (
        asked.join(floors, ["query_id", "row"], "left").withColumn("floor", F.coalesce("kth", start)).drop("kth")
        .withColumnsRenamed({"cell": "home_cell", "sub": "home_sub"}))
    routed = away.mapInArrow(_routed(_boxes(trees, cuts)), away.withColumn("cells", F.array().cast("array<long>")).schema)
    sent = (
        routed.withColumn("cell", F.explode("cells")).join(cells, ["dims", "cell"])
        .withColumn("sub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("subs") - 1)))
        .where("cell <> home_cell or sub <> home_sub"))
    found = home.unionByName(against(sent))

    best = Window.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id")
    nearest = found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k)
    upto = F.sum("copies").over(best.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = nearest.withColumn("last", upto).withColumn("first", F.col("last") - F.col("copies") + 1).where(F.col("first") <= k)
    ranks = F.sequence(F.col("first").cast("int"), F.least("last", F.lit(k)).cast("int"))
    return ranked.select("query_id", F.explode(ranks).alias("rank"), "vec_id", "score")


def _boxes(trees: DataFrame, cuts: dict) -> dict:
    """(cells, low, high) of each length with cuts: no more boxes than the draw has cells."""
    if not cuts:
        return {}
    roots = trees.where(F.col("dims").isin(list(cuts))).select(
        "dims", "cell", *[F.substring(F.col(x), F.lit(1), (F.col("dims") * 4).cast("int")).alias(x) for x in ("low", "high")])
    found = roots.groupBy("dims", "cell").applyInArrow(_whole_box, roots.schema).toArrow()
    out = {}
    for dims in cuts:
        own = found.filter(pa.compute.equal(found.column("dims"), dims))
        out[dims] = (longs(own, "cell"), *(_matrix(own.column(x), dims).astype(np.float64) for x in ("low", "high")))
    return out
