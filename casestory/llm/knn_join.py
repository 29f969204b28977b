"""Exact top-k inner products by a Voronoi join.

Vectors of whole numbers are lifted by one coordinate, sqrt(M^2 - |x|^2) for data and 0 for queries,
M being the largest norm; then |q - x|^2 = |q|^2 + M^2 - 2 q.x, and the highest inner products are
the nearest neighbours. Pivots divide data and queries into cells. A histogram of distances per
data cell bounds how far the k-th neighbour of any query of a cell can lie; a row is sent to a query
cell only where its distance to that cell's pivot, less the cell's radius, is within the bound.
Queries of a cell and the rows sent to it meet in units of bounded size, are solved there exactly,
and the best k of all units stay.

Any pivots give the same rows; they are taken from the table by hash, at most ``PIVOTS``. The
histograms and bounds, at most ``PIVOTS`` x ``BINS`` numbers, are what reaches the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casestory.llm.common import stash

PIVOTS, BINS = 1024, 64
#: Queries and rows that meet in one unit, at most about.
QUERIES, ROWS = 256, 4096
SPREAD = 0x9E3779B97F4A7C15


def quantised(rows: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """``rid, vid, vec``: floor(scale * component) as long; vectors null or with a component that is
    null or not finite are left out. ``rid`` numbers the written rows, so copies stay apart."""
    v = F.col(vec_col)
    infinite = F.lit(float("inf"))
    unfit = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == infinite))
    kept = rows.where(v.isNotNull() & ~unfit)
    vec = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return kept.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("vid"), vec.alias("vec"))


def matrix(column, dims: int) -> np.ndarray:
    """Rows of a list column as a matrix; shorter vectors are padded with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(sizes), dims), dtype=np.int64)
    out[np.arange(dims) < sizes[:, None]] = flat
    return out


class Space:
    """Distances in the lifted space, and how vectors are packed."""

    def __init__(self, pivots: np.ndarray, square: float, most: int):
        self.pivots, self.square = pivots.astype(np.float64), square
        self.lift = np.sqrt(np.maximum(0, square - (self.pivots ** 2).sum(1)))
        self.kind = next(k for k, top in (("<i2", 2**15), ("<i4", 2**31), ("<i8", 2**64)) if most < top)
        #: Products are exact in doubles below this; else they are taken in 64-bit integers.
        self.doubles = float(most) ** 2 * max(1, pivots.shape[1]) < 2**53
        self.slack = 1e-6 * np.sqrt(square) + 1e-9

    def distances(self, x: np.ndarray, lifted: bool) -> np.ndarray:
        x = x.astype(np.float64)
        own = (x ** 2).sum(1)
        up = np.sqrt(np.maximum(0, self.square - own)) if lifted else np.zeros(len(x))
        d = (own + up ** 2)[:, None] + self.square - 2 * (x @ self.pivots.T + np.outer(up, self.lift))
        return np.sqrt(np.maximum(0, d))

    def products(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        if self.doubles:
            return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
        return q.astype(np.int64) @ x.astype(np.int64).T

    def pack(self, x: np.ndarray) -> list[bytes]:
        return [r.tobytes() for r in np.ascontiguousarray(x, dtype=self.kind)]

    def unpack(self, column) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), dtype=self.kind).reshape(len(column), -1)


def _cells(rows: DataFrame, state, dims: int) -> DataFrame:
    """``rid, vid, vec, cell, dist, qcell, qdist``: nearest pivots of a row as data and, where it is a
    query, as a query."""
    def run(batches):
        space = Space(*state)
        for batch in batches:
            x = matrix(batch.column("vec"), dims)
            d, q = space.distances(x, True), space.distances(x, False)
            cell, qcell = d.argmin(1), q.argmin(1)
            at = np.arange(len(x))
            asks = batch.column("asks").to_numpy(zero_copy_only=False).astype(bool)
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid"), batch.column("vid"), pa.array(space.pack(x), pa.binary()), pa.array(cell.astype(np.int32)), pa.array(d[at, cell]),
                 pa.array(qcell.astype(np.int32), mask=~asks), pa.array(q[at, qcell], mask=~asks)],
                ["rid", "vid", "vec", "cell", "dist", "qcell", "qdist"])
    return rows.mapInArrow(run, "rid long, vid long, vec binary, cell int, dist double, qcell int, qdist double")


def bounds(space: Space, counts: list[tuple[int, int, int]], queries: list[tuple[int, float, int]], k: int, width: float):
    """Per query cell (cell, radius, queries): (cell, radius, bound, rows that may be sent).

    ``counts`` are (cell, bin, rows). A row of cell j in a bin that ends at u lies within
    radius + |p_i p_j| + u of every query of cell i; the bound is where k + 1 rows, one of which may
    be the query's own, are sure to lie.
    """
    cell, step, n = (np.array(c) for c in zip(*counts))
    out = []
    for i, radius, _ in queries:
        p = space.pivots[[i]]
        # between (p_i, lift) and the others: both are lifted
        between = np.sqrt(np.maximum(0, 2 * space.square - 2 * (p @ space.pivots.T + space.lift[i] * space.lift)))[0]
        far = radius + between[cell] + (step + 1) * width
        order = np.argsort(far)
        enough = np.searchsorted(np.cumsum(n[order]), k + 1)
        bound = float(far[order[enough]]) + space.slack if enough < len(order) else float("inf")
        near = np.maximum(0, np.maximum(between[cell] - (step + 1) * width, step * width - between[cell])) - radius
        out.append((i, radius, bound, int(n[near <= bound + space.slack].sum())))
    return out


def best(scores: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray, left_out: np.ndarray):
    """(row, column) of each row's k highest scores at or above ``floor``, ties to smaller ids."""
    fit = ~left_out & (scores >= floor[:, None])
    least = np.iinfo(np.int64).min
    held = np.where(fit, scores, least)
    if scores.shape[1] > k:
        kth = np.partition(held, -k, axis=1)[:, -k]
        fit &= scores >= kth[:, None]
    row, col = np.nonzero(fit)
    order = np.lexsort((ids[col], -scores[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k]


def top_products(rows: DataFrame, asks: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
                 scale: int = 64, pivots: int = PIVOTS, queries: int = QUERIES, chunk: int = ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k highest inner products of every row where ``asks``
    (a condition on ``query_id``) holds, against all rows but itself.

    Ties go to the smaller id, a null id comes last. Vectors null or with null or non-finite
    components take no part; a shorter vector counts as padded with zeros, an empty one is zero. Rows
    that repeat id and vector are different rows: each finds the other. Scores are 64-bit integers.
    Fewer rows than k give all; no rows or no queries give none.
    """
    spark = rows.sparkSession
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    every = stash(quantised(rows, id_col, vec_col, scale).withColumn("query_id", F.col("vid")).withColumn(
        "asks", F.coalesce(asks, F.lit(False))).drop("query_id"), "vectors")
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    most = F.coalesce(F.greatest(F.abs(F.array_max("vec")), F.abs(F.array_min("vec"))), F.lit(0).cast("long"))
    dims, top, high, asked = every.agg(F.max(F.size("vec")), F.max(square), F.max(most), F.count_if("asks")).first()
    if not asked:
        return none
    dims = max(1, dims)
    wanted = max(1, min(pivots, -(-asked // queries)))
    vec = F.transform("vec", lambda x: x)
    chosen = every.select(vec.alias("vec")).distinct().orderBy(F.xxhash64("vec"), "vec").limit(wanted).collect()
    points = np.zeros((len(chosen), dims), dtype=np.int64)
    for point, r in zip(points, chosen):
        point[:len(r[0])] = r[0]
    state = points, float(top), int(high)
    space = Space(*state)
    cells = stash(_cells(every, state, dims), "cells")
    width = 2 * np.sqrt(space.square) / BINS + space.slack
    counts = cells.groupBy("cell", F.floor(F.col("dist") / width).cast("int").alias("bin")).agg(F.count("*").alias("n")).collect()
    asking = cells.where("qcell is not null").groupBy("qcell").agg(F.max("qdist").alias("radius"), F.count("*").alias("n")).orderBy("qcell").collect()
    found = bounds(space, [tuple(r) for r in counts], [tuple(r) for r in asking], k, width)
    plan, first = [], 0  # (cell, radius, bound, first unit, parts, blocks)
    for (cell, radius, bound, sent), r in zip(found, asking):
        parts, blocks = max(1, -(-sent // chunk)), max(1, -(-r["n"] // queries))
        plan.append((cell, radius, bound, first, parts, blocks))
        first += parts * blocks
    sent = _sent(cells, state, plan)
    asks_for = _asked(cells, plan)
    solved = asks_for.groupBy("unit").cogroup(sent.groupBy("unit")).applyInArrow(
        _solver(state, k), "rid long, query_id long, score long, vec_id long")
    order = Window.partitionBy("rid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return solved.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _sent(cells: DataFrame, state, plan) -> DataFrame:
    """``unit, rid, vid, vec``: every row once per unit part that may need it."""
    def run(batches):
        space = Space(*state)
        radii, limits = np.array([p[1] for p in plan]), np.array([p[2] for p in plan])
        which = np.array([p[0] for p in plan])
        for batch in batches:
            d = space.distances(space.unpack(batch.column("vec")), True)[:, which]
            need = d - radii <= limits + space.slack
            rid = batch.column("rid").to_numpy().astype(np.uint64)
            with np.errstate(over="ignore"):
                spread = (rid * np.uint64(SPREAD)) >> np.uint64(32)
            for c, (_, _, _, first, parts, blocks) in enumerate(plan):
                at = np.flatnonzero(need[:, c])
                if not len(at):
                    continue
                part = (spread[at] % np.uint64(parts)).astype(np.int64)
                own = batch.select(["rid", "vid", "vec"]).take(pa.array(at))
                for b in range(blocks):
                    yield pa.RecordBatch.from_arrays([pa.array(first + part * blocks + b), *own.columns], ["unit", "rid", "vid", "vec"])
    return cells.select("rid", "vid", "vec").mapInArrow(run, "unit long, rid long, vid long, vec binary")


def _asked(cells: DataFrame, plan) -> DataFrame:
    """``unit, rid, vid, vec, bound``: every query in its block of each part of its cell."""
    def run(batches):
        by_cell = {p[0]: p for p in plan}
        for batch in batches:
            rows, units, limits = [], [], []
            for i, (rid, cell) in enumerate(zip(batch.column("rid").to_pylist(), batch.column("qcell").to_pylist())):
                _, _, bound, first, parts, blocks = by_cell[cell]
                block = ((rid * SPREAD) >> 40) % blocks
                units += range(first + block, first + parts * blocks, blocks)
                rows += [i] * parts
                limits += [bound] * parts
            own = batch.select(["rid", "vid", "vec"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(units, pa.int64()), *own.columns, pa.array(limits, pa.float64())], ["unit", "rid", "vid", "vec", "bound"])
    return cells.where("qcell is not null").select("rid", "vid", "vec", "qcell").mapInArrow(
        run, "unit long, rid long, vid long, vec binary, bound double")


def _solver(state, k: int):
    def run(asked: pa.Table, sent: pa.Table) -> pa.Table:
        space, last = Space(*state), np.iinfo(np.int64).max
        names = ["rid", "query_id", "score", "vec_id"]
        if not asked.num_rows or not sent.num_rows:
            return pa.table([pa.array([], pa.int64())] * 4, names=names)
        q, x = space.unpack(asked["vec"]), space.unpack(sent["vec"])
        scores = space.products(q, x)
        bound = asked["bound"].to_numpy()
        norms = (q.astype(np.float64) ** 2).sum(1)
        with np.errstate(invalid="ignore"):
            floor = (norms + space.square - (bound + space.slack) ** 2) / 2 - space.slack - 1
        ids = sent["vid"].to_numpy(zero_copy_only=False) if not sent["vid"].null_count else sent["vid"].fill_null(last).to_numpy()
        own = asked["rid"].to_numpy()[:, None] == sent["rid"].to_numpy()[None, :]
        row, col = best(scores, ids, k, floor, own)
        return pa.table([asked["rid"].take(pa.array(row)), asked["vid"].take(pa.array(row)), pa.array(scores[row, col]), sent["vid"].take(pa.array(col))], names=names)
    return run
