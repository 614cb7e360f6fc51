"""Exact nearest neighbours: an inverted file with product-quantised residuals gives a bound, and what the bound reaches is measured.

Coarse centroids and the codebooks of residuals are fitted on the vectors of the TRAIN_ROWS smallest hashed ids (a
documented bound); every vector is indexed: its cell and a byte for each part of its residual. A query probes its
nearest cells (at least ``probes``, more until they hold enough candidates), scores their codes by asymmetric distance
tables, and the best ``rerank`` codes are measured exactly on the original vectors, in double precision. The k-th of these
distances bounds the k-th nearest. Every cell whose distance from the query less the cell's radius is within that bound is
then measured as a whole, so the result is that of brute force; where cells overlap much, as in isotropic vectors, that is
most cells, and the work grows with rows times queries.

Cells meet queries in blocks: a cell of many vectors, or probed by many queries, is cut into blocks of bounded size, so
a vector that a third of all rows share costs many tasks rather than one large one. The driver holds the fitted tables
and a count for each cell.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do vectors of another length than
the commonest of the training rows. A repeated id is one candidate, at its nearest vector; a repeated query id asks
once, with its smallest vector. Ties go to the smaller id. Fewer vectors than asked for give them all; an empty table
gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import stored

TRAIN_ROWS = 20_000
BLOCK = 20_000
QUERY_BLOCK = 2_000
#: Queries that meet a block of vectors in one task when all that the bound reaches is measured.
MEASURE_BLOCK = 8_000
PARTS = 16
CODES = 256


def usable(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :], 0)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    """At most k centroids; empty ones move to the points farthest from theirs."""
    points = np.unique(x, axis=0)
    k = min(k, len(points))
    c = points[rng.choice(len(points), k, replace=False)].copy()
    for _ in range(rounds):
        d = _distances(x, c)
        near = d.argmin(1)
        count = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        full = count > 0
        c[full] = total[full] / count[full, None]
        if not full.all():
            far = np.argsort(-d[np.arange(len(x)), near])[: int((~full).sum())]
            c[np.flatnonzero(~full)[: len(far)]] = x[far]
    return c


class Codes:
    """Centroids and codebooks; what tasks need, of fixed size."""

    def __init__(self, sample: np.ndarray, cells: int, seed: int):
        rng = np.random.default_rng(seed)
        self.dim = sample.shape[1]
        self.centroids = kmeans(sample, cells, rng)
        left = sample - self.centroids[_distances(sample, self.centroids).argmin(1)]
        self.edges = np.linspace(0, self.dim, min(PARTS, self.dim) + 1).astype(int)
        self.books = [kmeans(left[:, a:b], CODES, rng, 6) for a, b in zip(self.edges[:-1], self.edges[1:], strict=True)]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = _distances(x, self.centroids).argmin(1)
        left = x - self.centroids[cell]
        return cell, np.stack([_distances(left[:, a:b], book).argmin(1).astype(np.uint8) for a, b, book in zip(self.edges[:-1], self.edges[1:], self.books, strict=True)], 1)

    def tables(self, x: np.ndarray, cell: int) -> np.ndarray:
        """For each query of a cell: distance of its residual to every code of every part."""
        out = np.full((len(x), len(self.books), CODES), np.float32(np.inf))
        left = x - self.centroids[cell]
        for i, (a, b, book) in enumerate(zip(self.edges[:-1], self.edges[1:], self.books, strict=True)):
            out[:, i, : len(book)] = _distances(left[:, a:b], book)
        return out


def _matrix(column, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _index(codes):
    def index(batches):
        model = codes.value
        for b in batches:
            for at in range(0, len(b), 4096):
                piece = b.slice(at, 4096)
                v = _matrix(piece.column("v"), model.dim)
                cell, code = model.encode(v)
                far = np.sqrt(((v - model.centroids[cell]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([piece.column("vec_id"), pa.array(cell.astype(np.int32)), pa.array([r.tobytes() for r in code], pa.binary()), pa.array(far), piece.column("v")], names=["vec_id", "cell", "code", "far", "v"])

    return index


def _probe(codes, sizes: list[int], probes: int, enough: int):
    held = np.array(sizes)

    def probe(batches):
        model = codes.value
        for b in batches:
            for at in range(0, len(b), 1024):
                piece = b.slice(at, 1024)
                order = _distances(_matrix(piece.column("v"), model.dim), model.centroids).argsort(1, kind="stable")
                full = np.cumsum(held[order], 1)
                many = np.minimum(np.maximum(probes, (full < enough).sum(1) + 1), len(held))
                row = np.repeat(np.arange(len(piece)), many)
                cell = np.concatenate([o[:m] for o, m in zip(order, many, strict=True)]) if len(piece) else np.zeros(0, int)
                ids = piece.column("vec_id").take(pa.array(row))
                yield pa.RecordBatch.from_arrays([ids, pa.array(cell.astype(np.int32)), piece.column("v").take(pa.array(row))], names=["query_id", "cell", "v"])

    return probe


def _score(codes, rerank: int):
    def score(key, rows: pa.Table, queries: pa.Table) -> pa.Table:
        model, cell = codes.value, key[0].as_py()
        out_q, out_v, out_d = [], [], []
        if len(rows) and len(queries):
            ids = rows.column("vec_id").to_numpy()
            code = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
            order = np.argsort(ids, kind="stable")
            ids, code = ids[order], code[order]
            fresh = np.ones(len(ids), bool)
            fresh[1:] = (ids[1:] != ids[:-1]) | (code[1:] != code[:-1]).any(1)
            ids, code = ids[fresh], code[fresh].astype(np.int64)
            asks = queries.column("query_id").to_numpy()
            tables = model.tables(_matrix(queries.column("v"), model.dim), cell)
            for q, table in zip(asks, tables, strict=True):
                d = table[np.arange(code.shape[1]), code].sum(1)
                d[ids == q] = np.inf
                best = np.lexsort((ids, d)) if len(d) <= rerank else _best(d, ids, rerank)
                best = best[np.isfinite(d[best])][:rerank]
                out_q.append(np.full(len(best), q))
                out_v.append(ids[best])
                out_d.append(d[best].astype(np.float64))
        join = lambda xs, t: np.concatenate(xs) if xs else np.zeros(0, t)
        return pa.table({"query_id": pa.array(join(out_q, np.int64), pa.int64()), "vec_id": pa.array(join(out_v, np.int64), pa.int64()), "near": pa.array(join(out_d, np.float64), pa.float64())})

    return score


def _reached(codes, group: np.ndarray, radii: np.ndarray, slices: np.ndarray):
    """A row for each block of vectors that has a cell within a query's bound (null: none), with the query's vector."""
    live = np.flatnonzero(~(radii < 0))

    def reached(batches):
        model = codes.value
        for b in batches:
            for at in range(0, len(b), 256):
                piece = b.slice(at, 256)
                x = _matrix(piece.column("v"), model.dim)
                bound = piece.column("bound").to_numpy(zero_copy_only=False).astype(np.float64)
                for i in range(len(piece)):
                    # Measured directly, and with room for rounding; a comparison with NaN drops nothing.
                    d = np.sqrt(((model.centroids[live] - x[i]) ** 2).sum(1))
                    cells = live[~(d - radii[live] > bound[i] + 1e-9 * (d + radii[live]))]
                    of = np.unique(group[cells])
                    many = slices[of]
                    block = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    row = pa.array(np.full(len(block), i))
                    yield pa.RecordBatch.from_arrays([piece.column("vec_id").take(row), pa.array(np.repeat(of, many).astype(np.int32)), pa.array(block.astype(np.int32)), piece.column("v").take(row)], names=["query_id", "group", "block", "v"])

    return reached


def _measure(dim: int, k: int):
    """The k nearest ids of a block for each of its queries, by their nearest vector; ties go to the smaller id."""

    def measure(_key, rows: pa.Table, queries: pa.Table) -> pa.Table:
        out_q, out_v, out_d = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if len(rows) and len(queries):
            ids, y = rows.column("vec_id").to_numpy(), _matrix(rows.column("v"), dim)
            # Of equal vectors the k + 1 smallest ids suffice: one of them may be the query itself.
            _, same = np.unique(y.view(np.dtype((np.void, y.itemsize * dim))).ravel(), return_inverse=True)
            order = np.lexsort((ids, same))
            i, g = ids[order], same[order]
            fresh = np.ones(len(i), bool)
            fresh[1:] = (i[1:] != i[:-1]) | (g[1:] != g[:-1])
            order, g = order[fresh], g[fresh]
            first = np.concatenate([[0], np.flatnonzero(np.diff(g)) + 1])
            order = order[np.arange(len(g)) - np.repeat(first, np.diff(np.append(first, len(g)))) <= k]
            ids, y = ids[order], y[order]
            norms = (y * y).sum(1)
            enough = k + len(ids) - len(np.unique(ids))  # so many rows hold k ids
            asks, x = queries.column("query_id").to_numpy(), _matrix(queries.column("v"), dim)
            for at in range(0, len(asks), 64):
                part = x[at : at + 64]
                own = (part * part).sum(1)
                square = own[:, None] - 2 * part @ y.T + norms[None, :]
                for q, v, n, d in zip(asks[at : at + 64], part, own, square, strict=True):
                    # Quick squares choose, with room for rounding, what is measured in order of the parts.
                    d[ids == q] = np.inf
                    edge = np.partition(d, enough - 1)[enough - 1] if len(d) > enough else np.inf
                    near = np.flatnonzero(~(d > edge + 1e-9 * (n + norms)))
                    near = near[ids[near] != q]
                    total = np.zeros(len(near))
                    for j in range(dim):
                        total += (y[near, j] - v[j]) ** 2
                    sort = np.lexsort((ids[near], total))
                    sort = sort[np.sort(np.unique(ids[near[sort]], return_index=True)[1])[:k]]
                    out_q.append(np.full(len(sort), q))
                    out_v.append(ids[near[sort]])
                    out_d.append(np.sqrt(total[sort]))
        return pa.table({"query_id": pa.array(np.concatenate(out_q), pa.int64()), "vec_id": pa.array(np.concatenate(out_v), pa.int64()), "score": pa.array(np.concatenate(out_d), pa.float64())})

    return measure


def _best(d: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """The n least, ties by id: ids are in order, so among equals at the edge the first count."""
    edge = np.partition(d, n - 1)[n - 1]
    under, equal = np.flatnonzero(d < edge), np.flatnonzero(d == edge)
    take = np.concatenate([under, equal[: n - len(under)]])
    return take[np.lexsort((ids[take], d[take]))]


RESULT = "query_id long, rank int, vec_id long, score double"


def search(vectors: DataFrame, every: int = 100, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", cells: int | None = None, probes: int = 24, rerank: int = 200, seed: int = 10) -> DataFrame:
    """The k nearest of every row whose id is divisible by ``every``: query_id, rank (from 1), vec_id, score (Euclidean distance)."""
    spark = vectors.sparkSession
    kind = "array<float>" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    good = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast(kind).alias("v")).filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    sample = [r["v"] for r in good.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(TRAIN_ROWS).collect()]
    if not sample:
        return spark.createDataFrame([], RESULT)
    dim = sorted(Counter(map(len, sample)).items(), key=lambda x: (-x[1], x[0]))[0][0]
    good = good.filter(F.size("v") == dim)
    n = good.count()
    model = Codes(np.array([v for v in sample if len(v) == dim]), cells or min(1024, max(1, round(n**0.5))), seed)
    codes = spark.sparkContext.broadcast(model)
    # Written once: radii hold for the very cells that later steps read.
    placed = stored(good.mapInArrow(_index(codes), f"vec_id long, cell int, code binary, far double, v {kind}"), "cells")
    index = placed.select("vec_id", "cell", "code")
    sizes, radii = [0] * len(model.centroids), np.full(len(model.centroids), -1.0)
    for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("count"), F.max("far").alias("far")).collect():
        sizes[r["cell"]], radii[r["cell"]] = r["count"], r["far"]
    queries = good.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    probed = queries.mapInArrow(_probe(codes, sizes, probes, rerank + 1), f"query_id long, cell int, v {kind}")
    asked = {r["cell"]: r["count"] for r in probed.groupBy("cell").count().collect()}
    blocks = F.array(*[F.lit(max(1, -(-s // BLOCK))) for s in sizes])
    crowds = F.array(*[F.lit(max(1, -(-asked.get(i, 0) // QUERY_BLOCK))) for i in range(len(sizes))])
    left = index.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.get(blocks, F.col("cell"))).cast("int")).withColumn("crowd", F.explode(F.sequence(F.lit(0), F.get(crowds, F.col("cell")) - 1)))
    right = probed.withColumn("crowd", F.pmod(F.xxhash64("query_id"), F.get(crowds, F.col("cell"))).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.get(blocks, F.col("cell")) - 1)))
    near = left.groupBy("cell", "block", "crowd").cogroup(right.groupBy("cell", "block", "crowd")).applyInArrow(_score(codes, rerank), "query_id long, vec_id long, near double")
    first = Window.partitionBy("query_id").orderBy("near", "vec_id")
    chosen = near.groupBy("query_id", "vec_id").agg(F.min("near").alias("near")).withColumn("at", F.row_number().over(first)).filter(F.col("at") <= rerank).select("query_id", "vec_id")
    pairs = chosen.join(good, "vec_id").join(queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id")
    square = F.zip_with(F.col("v").cast("array<double>"), F.col("q").cast("array<double>"), lambda a, b: (a - b) * (a - b))
    measured = pairs.select("query_id", "vec_id", F.sqrt(F.aggregate(square, F.lit(0.0), lambda s, x: s + x)).alias("score")).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    nth = measured.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).filter(F.col("rank") == k).select("query_id", F.col("score").alias("bound"))
    bounded = queries.join(nth, queries["vec_id"] == nth["query_id"], "left").select("vec_id", "v", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    group, held = np.zeros(len(sizes), int), [0]
    for cell, n in enumerate(sizes):
        if held[-1] and held[-1] + n > BLOCK:
            held.append(0)
        group[cell], held[-1] = len(held) - 1, held[-1] + n
    slices = np.array([max(1, -(-n // BLOCK)) for n in held])
    reach = bounded.mapInArrow(_reached(codes, group, radii, slices), f"query_id long, group int, block int, v {kind}")
    here = F.array(*[F.lit(int(g)) for g in group])
    cut = F.array(*[F.lit(int(n)) for n in slices])
    crowd = max(1, -(-queries.count() // MEASURE_BLOCK))
    rows = placed.select("vec_id", F.get(here, F.col("cell")).alias("group"), "v").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.get(cut, F.col("group"))).cast("int")).withColumn("crowd", F.explode(F.sequence(F.lit(0), F.lit(crowd - 1))))
    asks = reach.withColumn("crowd", F.pmod(F.xxhash64("query_id"), F.lit(crowd)).cast("int"))
    nearest = rows.groupBy("group", "block", "crowd").cogroup(asks.groupBy("group", "block", "crowd")).applyInArrow(_measure(dim, k), "query_id long, vec_id long, score double")
    least = nearest.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = least.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
