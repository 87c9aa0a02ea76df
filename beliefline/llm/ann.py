"""Approximate nearest neighbours by an inverted multi-index.

Vectors are halved and each half is quantised by its own k-means (on a bounded sample); a cell is a pair of
centroids. Every vector is indexed under its cell. For each query a heap walks the pairs of centroids in the order of
their summed distances until the cells hold enough candidates. How many are enough is measured on the whole table:
for a fixed number of probes the true neighbours are found by one linear pass, and the rows that this order must reach
before it has ``recall`` of them are counted. That number depends on the data: vectors in clusters need a share that
falls with the table, vectors without any structure a share of it (see the README). Vectors are grouped
by their first centroid, large groups in blocks, and cogrouped with the queries that probe them, each with its list of
second centroids; the entries of those cells rerank by exact distance and the best of each block are merged.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, materialise

#: Vectors, those with the least hash of the id, that the centroids are fitted on at most.
SAMPLE = 20_000
RECALL, BLOCK, PER_CELL, TRIALS, LEAST = 0.96, 2_048, 12, 200, 1_000
#: A cell counts for so many rows at most, when probes are measured and when queries walk: copies fill single cells.
FULL = 4 * PER_CELL


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Lloyd's algorithm; an empty cluster moves to a random vector."""
    rng = np.random.default_rng(seed)
    x_unique = np.unique(x, axis=0)
    c = x_unique[rng.permutation(len(x_unique))[: min(k, len(x_unique))]]
    for _ in range(rounds):
        own = distances(x, c).argmin(axis=1)
        n = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), len(c))])
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances."""
    return np.maximum((x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2 * x @ c.T, 0)


def walk(a: np.ndarray, b: np.ndarray, counts: np.ndarray, enough: int, at_most: int) -> list[int]:
    """Non-empty cells by ascending a[i] + b[j] until they hold ``enough`` rows. A cell counts for ``at_most`` rows,
    so that one that is full of copies does not end the search."""
    oa, ob = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    heap, seen, out, total = [(a[oa[0]] + b[ob[0]], 0, 0)], {(0, 0)}, [], 0
    while heap and total < enough:
        _, i, j = heapq.heappop(heap)
        n = counts[oa[i], ob[j]]
        if n:
            out.append(int(oa[i]) * len(b) + int(ob[j]))
            total += min(int(n), at_most)
        for u, v in ((i + 1, j), (i, j + 1)):
            if u < len(a) and v < len(b) and (u, v) not in seen:
                seen.add((u, v))
                heapq.heappush(heap, (a[oa[u]] + b[ob[v]], u, v))
    return out


def _true_neighbours(index: DataFrame, probes: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(probe, cell, second) of the k nearest rows of the whole index to each probe, its own id aside. A task keeps k rows
    a probe, and so many reach the driver in all."""
    shared = index.sparkSession.sparkContext.broadcast((probes, ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, own = shared.value
        best = np.full((len(q), 0), np.inf)
        cells = np.zeros((2, len(q), 0), np.int64)
        for batch in batches:
            if batch.num_rows:
                d = distances(q, _matrix(batch.column(3), q.shape[1]))
                d[own[:, None] == batch.column(0).to_numpy()[None, :]] = np.inf
                here = np.broadcast_to(np.stack([batch.column(c).to_numpy() for c in (1, 2)])[:, None, :], (2, *d.shape))
                best, cells = np.hstack([best, d]), np.concatenate([cells, here], axis=2)
                keep = np.argpartition(best, min(k, best.shape[1]) - 1, axis=1)[:, :k]
                best, cells = np.take_along_axis(best, keep, 1), np.take_along_axis(cells, np.broadcast_to(keep, (2, *keep.shape)), 2)
        row, col = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(best[row, col]), pa.array(cells[0, row, col]), pa.array(cells[1, row, col])], names=["probe", "d", "cell", "second"])

    found = index.select("vec_id", "cell", "second", "v").mapInArrow(run, "probe long, d double, cell long, second long")
    rank = F.row_number().over(Window.partitionBy("probe").orderBy("d", "cell", "second"))
    return [(r["probe"], r["cell"], r["second"]) for r in found.withColumn("rank", rank).where(F.col("rank") <= k).collect()]


def needed_rows(found: list[tuple[int, int, int]], probes: np.ndarray, first: np.ndarray, second: np.ndarray, half: int, counts: np.ndarray, recall: float) -> int:
    """How many rows cells in the order of their summed distances hold before a share ``recall`` of the true neighbours
    is among them."""
    ranks, by = [], {}
    for probe, i, j in found:
        by.setdefault(probe, []).append(i * counts.shape[1] + j)
    for probe, cells in by.items():
        sums = (distances(probes[probe : probe + 1, :half], first)[0][:, None] + distances(probes[probe : probe + 1, half:], second)[0][None, :]).ravel()
        order = np.argsort(sums, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        ranks.append(np.cumsum(np.minimum(counts.ravel()[order], FULL))[place[cells]])
    return int(np.ceil(np.quantile(np.concatenate(ranks), recall))) if ranks else 0


def nearest(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vec_id, distance) of the k nearest of x for each q, exactly, ties to the smaller id."""
    rows, ids, scores = [], [], []
    for s in range(0, len(q), 64):
        near = distances(q[s : s + 64], x)
        for r, d in enumerate(near, s):
            keep = np.flatnonzero(x_ids != q_ids[r])
            if len(keep) > k:
                cut = np.partition(d[keep], k - 1)[k - 1]
                keep = keep[d[keep] <= cut + 1e-9 * (1 + cut + (q[r] * q[r]).sum())]
            exact = np.sqrt(((x[keep] - q[r]) ** 2).sum(axis=1))
            order = np.lexsort((x_ids[keep], exact))[:k]
            rows.append(np.full(len(order), r))
            ids.append(x_ids[keep][order])
            scores.append(exact[order])
    return np.concatenate(rows), np.concatenate(ids), np.concatenate(scores)


def search(vectors: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query, by Euclidean distance in double precision.

    vectors and queries have an id (whole numbers) and an array of numbers. Vectors that are null, zero, of another
    length than the most common one, or hold null, NaN or infinite components take no part, nor do rows with a null
    id. Rows with a query's id are its own and no candidates; repeated query rows count once, repeated candidate rows
    each. Other columns are not read.
    """
    spark = bounded_batches(vectors.sparkSession)

    def read(df: DataFrame) -> DataFrame:
        df = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
        bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
        return df.where(~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda c: c != 0))

    rows, asked = read(vectors), read(queries)
    dims = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, total = dims[0]["dim"], dims[0]["count"]
    rows, asked = rows.where(F.size("v") == dim), asked.where(F.size("v") == dim).dropDuplicates(["vec_id"])
    taken = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vec_id", "v").toArrow()
    fitted, probe_ids = _matrix(taken["v"].combine_chunks(), dim), taken["vec_id"].to_numpy()[:TRIALS]
    half, size = dim // 2, int(np.clip(round((total / PER_CELL) ** 0.5), 4, 1024))
    first, second = kmeans(fitted[:, :half], size) if half else np.zeros((1, 0)), kmeans(fitted[:, half:], size)
    books = spark.sparkContext.broadcast((first, second))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = books.value
        for batch in batches:
            x = _matrix(batch.column(1), dim)
            i, j = distances(x[:, :half], a).argmin(axis=1), distances(x[:, half:], b).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(i), pa.array(j), batch.column(1)], names=["vec_id", "cell", "second", "v"])

    index = materialise(rows.mapInArrow(assign, "vec_id long, cell long, second long, v array<double>"), "index")
    held = index.groupBy("cell", "second").count().collect()  # a row a pair of centroids that has any
    counts = np.zeros((len(first), len(second)), np.int64)
    for r in held:
        counts[r["cell"], r["second"]] = r["count"]
    probes_of = fitted[:TRIALS]
    candidates = max(LEAST, needed_rows(_true_neighbours(index, probes_of, probe_ids, k), probes_of, first, second, half, counts, recall))
    table, width = spark.sparkContext.broadcast(counts), len(second)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = books.value
        n = table.value
        for batch in batches:
            q = _matrix(batch.column(1), dim)
            da, db = distances(q[:, :half], a), distances(q[:, half:], b)
            blocks = -(-n.sum(axis=1) // BLOCK)
            for s in range(0, len(q), 64):
                take, cells, parts, seconds = [], [], [], []
                for i in range(s, min(s + 64, len(q))):
                    pairs = np.array(walk(da[i], db[i], n, candidates, FULL), np.int64)
                    for cell in np.unique(pairs // len(b)):
                        mine = (pairs[pairs // len(b) == cell] % len(b)).tolist()
                        for block in range(int(blocks[cell])):
                            take.append(i)
                            cells.append(int(cell))
                            parts.append(block)
                            seconds.append(mine)
                at = pa.array(take, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(cells, pa.int64()), pa.array(parts, pa.int64()), pa.array(seconds, pa.list_(pa.int64())), batch.column(1).take(at)], names=["query_id", "cell", "block", "seconds", "q"])

    blocks = spark.createDataFrame([(i, int(-(-n // BLOCK))) for i, n in enumerate(counts.sum(axis=1).tolist()) if n], "cell long, blocks long")
    dealt = index.join(F.broadcast(blocks), "cell").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks"))).select("cell", "block", "second", "vec_id", "v")
    probes = asked.mapInArrow(probe, "query_id long, cell long, block long, seconds array<long>, q array<double>")

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        asked_ids, found, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if left.num_rows and right.num_rows:
            x, q = _matrix(left["v"].combine_chunks(), dim), _matrix(right["q"].combine_chunks(), dim)
            ids, second, queries_ids = left["vec_id"].to_numpy(), left["second"].to_numpy(), right["query_id"].to_numpy()
            wanted = right["seconds"].combine_chunks()
            for i in range(len(q)):
                flags = np.zeros(width, bool)
                flags[wanted[i].values.to_numpy()] = True
                some = np.flatnonzero(flags[second])
                if len(some):
                    _, near, score = nearest(q[i : i + 1], queries_ids[i : i + 1], x[some], ids[some], k)
                    asked_ids.append(np.full(len(near), queries_ids[i]))
                    found.append(near)
                    scores.append(score)
        return pa.table({"query_id": np.concatenate(asked_ids), "vec_id": np.concatenate(found), "score": np.concatenate(scores)})

    found = dealt.groupBy("cell", "block").cogroup(probes.groupBy("cell", "block")).applyInArrow(rerank, "query_id long, vec_id long, score double")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
