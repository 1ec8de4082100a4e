"""Approximate nearest neighbours by an inverted multi-index.

Both halves of a vector are quantised separately, by k-means codebooks learnt on the driver from a bounded sample
(``SAMPLE`` vectors); a pair of centroids is a cell. Every vector is indexed under its cell. A query goes through the pairs by
the sum of its two squared distances, with a heap, until the cells it has seen hold enough vectors, where one cell counts
for an eighth at most: a cell of equal vectors doesn't use up a query. That is a first pass, for the distance of the k-th
vector found. A second one visits every cell that can hold a nearer one: by the triangle inequality, a cell is left out only
if the least and greatest distances of its vectors from its two centroids put all of them farther away. So the result is
exact at every size; how much is visited depends on how well the vectors cluster, not on a share fixed beforehand. The
vectors of the cells are ranked by their exact distance in double precision.

Cells are dealt to tasks by a hash; a cell of more than ``CHUNK`` vectors is cut into chunks by a hash of the id, each
with the cell's queries. A task returns its ten best for a query, so what is shuffled doesn't grow with a cell.

Defined results: rows with a null id, and vectors that are null, empty, zero, or hold null or non-finite components, or have
another length than most, take no part; ties go to the smaller id; of rows with equal ids the nearest counts, and none is a
neighbour of its own id; with fewer vectors than k, all of them; an empty table gives an empty result; other columns, of any
name, are ignored (:func:`usable` takes the two it needs).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm.common import materialize, partitions, sampled, table

SAMPLE, CHUNK = 20_000, 4096
#: What deals cells and chunks to tasks.
SPREAD, SPREAD_CHUNK = 1_000_003, 40_503
#: Centroids of a half: as many as give CELL vectors to a cell, up to the first bound; beyond, a sixteenth of the root of the number of
#: vectors, up to the second (so the driver's table of cells has a million rows at most). The first pass sees REACH times that root.
CENTROIDS, MOST_CENTROIDS, CELL, REACH = 256, 1024, 1, 100
#: Distances compared at once in the second pass; what rounding may add to a squared distance, for each unit of squared length.
TILE, ROUNDING = 2_000_000, 1e-9


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec) of the rows that take part."""
    v = F.col("vec")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec")).filter(F.col("vec_id").isNotNull() & v.isNotNull())
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.filter(finite)
    length = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("vec") == (length["n"] if length else 0))


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x_unique = np.unique(x, axis=0)
    c = x_unique[rng.permutation(len(x_unique))[:k]]
    for _ in range(rounds):
        at = nearest(x, c)
        n = np.bincount(at, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None], 0)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([squared(x[i : i + 4096], c).argmin(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def traverse(left: np.ndarray, right: np.ndarray, sizes: np.ndarray, enough: int) -> list[int]:
    """Cells in order of summed distance until they hold enough vectors; sizes: [left, right] vectors in each.

    The heap has the nearest cell that is left of each row, so no more entries than there are left centroids.
    """
    order = right.argsort(kind="stable")
    near, filled = right[order].tolist(), sizes[:, order] > 0
    first, counts = filled.argmax(1).tolist(), sizes[:, order]
    heap = [(left[i] + near[first[i]], i, 0) for i in np.flatnonzero(filled.any(1)).tolist()]
    heapq.heapify(heap)
    rows: dict[int, tuple[list, list]] = {}
    found, total, most, own = [], 0.0, enough / 8, left.tolist()
    while heap and total < enough:
        _, i, at = heap[0]
        if i not in rows:
            js = np.flatnonzero(filled[i])
            rows[i] = (js.tolist(), counts[i, js].tolist())
        js, ns = rows[i]
        found.append(i * len(near) + int(order[js[at]]))
        total += min(ns[at], most)
        if at + 1 < len(js):
            heapq.heapreplace(heap, (own[i] + near[js[at + 1]], i, at + 1))
        else:
            heapq.heappop(heap)
    return found


def matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten()).reshape(len(flat), -1) if len(flat) else np.zeros((0, 1))


def nearest_ids(ids: np.ndarray, vectors: np.ndarray, own: int, query: np.ndarray, k: int) -> list[tuple[float, int]]:
    """(distance, id) of the k vectors nearest to query under other ids, ties by id.

    Squares are added in the order of the components, so that a distance is the same number wherever it is computed.
    """
    rough = ((vectors - query) ** 2).sum(1)
    rough[ids == own] = np.inf
    wide = 4 * k
    while True:
        near = np.flatnonzero(rough <= np.partition(rough, wide)[wide] * (1 + ROUNDING)) if wide < len(rough) else np.arange(len(rough))
        d = np.where(rough[near] < np.inf, np.sqrt(np.cumsum((vectors[near] - query) ** 2, 1)[:, -1]), np.inf)
        found: dict[int, float] = {}
        for j in np.lexsort((ids[near], d)).tolist():
            if d[j] < np.inf:
                found.setdefault(int(ids[near[j]]), float(d[j]))
            if len(found) == k:
                break
        if len(found) == k or wide >= len(rough):
            return [(x, i) for i, x in found.items()]
        wide *= 4


def least_squared(query: np.ndarray, books: list[np.ndarray], at: tuple[np.ndarray, np.ndarray], rings: np.ndarray) -> np.ndarray:
    """For each cell (at: its two centroids) a lower bound of the squared distance of its vectors from query.

    rings: [cell, 4], the least and greatest distances of the cell's vectors from the left and from the right centroid.
    """
    half, bound = books[0].shape[1] if len(query) > 1 else 0, 0.0
    for k, part in enumerate((query[:half], query[half:]) if half else (np.zeros(1), query)):
        d = np.sqrt(((books[k] - part) ** 2).sum(1))[at[k]]
        bound = bound + np.maximum(np.maximum(d - rings[:, 2 * k + 1], rings[:, 2 * k] - d), 0) ** 2
    return bound


def centroids(total: int) -> int:
    """Centroids of each half for so many vectors."""
    return int(min(MOST_CENTROIDS, max(min(CENTROIDS, max(2, round((total / CELL) ** 0.5))), total**0.5 // 16)))


def search(rows: DataFrame, queries: DataFrame, *, k: int = 10, reach: float = REACH) -> DataFrame:
    """For each of queries (vec_id, vec) its k nearest among rows (vec_id, vec): query_id, rank, vec_id, score."""
    spark, result = rows.sparkSession, "query_id long, rank int, vec_id long, score double"
    total = rows.count()
    sample = sampled(rows, F.col("vec_id"), SAMPLE, total).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vec").collect()
    if not sample:
        return spark.createDataFrame([], result)
    x = np.array([r[0] for r in sample])
    half = x.shape[1] // 2
    size = centroids(total)
    books = [k_means(part, size) for part in ((x[:, :half], x[:, half:]) if half else (np.zeros((len(x), 1)), x))]
    halves = lambda m: (m[:, :half], m[:, half:]) if half else (np.zeros((len(m), 1)), m)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = halves(matrix(b.column(1)))
            a, c = (nearest(p, book) for p, book in zip(parts, books, strict=True))
            off = [pa.array(np.sqrt(((p - book[i]) ** 2).sum(1)), pa.float64()) for p, book, i in zip(parts, books, (a, c), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(a * len(books[1]) + c, pa.int64()), *off], names=["vec_id", "vec", "cell", "d0", "d1"])

    index = materialize(rows.mapInArrow(place, "vec_id long, vec array<double>, cell long, d0 double, d1 double"))
    sizes, rings = np.zeros((len(books[0]), len(books[1])), np.int64), np.zeros((len(books[0]) * len(books[1]), 4))
    for cell, n, *ring in index.groupBy("cell").agg(F.count("*"), F.min("d0"), F.max("d0"), F.min("d1"), F.max("d1")).collect():  # MOST_CENTROIDS squared rows at most
        sizes.flat[cell], rings[cell] = n, ring
    enough = max(2000, int(reach * total**0.5))

    parts = max(1, min(partitions(spark) * 4, total // 1000))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m, at, dealt, keys = matrix(b.column(1)), [], [], []
            d = [squared(p, book) for p, book in zip(halves(m), books, strict=True)]
            for i in range(b.num_rows):
                cells = np.array(traverse(d[0][i], d[1][i], sizes, enough), np.int64)
                n = -(-sizes.flat[cells] // CHUNK)
                cells, chunk = np.repeat(cells, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                part = (cells * SPREAD + chunk * SPREAD_CHUNK) % parts
                order = np.argsort(part, kind="stable")
                names, first = np.unique(part[order], return_index=True)
                at += [i] * len(names)
                dealt += names.tolist()
                keys += np.split((cells << 32)[order] + chunk[order], first[1:])
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(dealt, pa.int64()), b.column(0).take(at), b.column(1).take(at), pa.array(keys, pa.list_(pa.int64()))], names=["part", "query_id", "vec", "keys"])

    large = np.flatnonzero(sizes > CHUNK)
    if len(large):  # a row for each large cell, broadcast: no more than there are cells
        chunks = spark.createDataFrame([(int(c), int(-(-sizes.flat[c] // CHUNK))) for c in large], "large long, chunks long")
        index = index.join(F.broadcast(chunks), F.col("cell") == F.col("large"), "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).drop("large")
        chunk = F.pmod(F.xxhash64("vec_id"), F.col("chunks"))
    else:
        chunk = F.lit(0)
    key = F.shiftleft(F.col("cell"), 32) + F.col("chunk")
    part = F.pmod(F.col("cell") * SPREAD + F.col("chunk") * SPREAD_CHUNK, F.lit(parts)).cast("long")
    stored = index.withColumn("chunk", chunk.cast("long")).select(part.alias("part"), key.alias("key"), "vec_id", "vec")
    asked = queries.select("vec_id", "vec").mapInArrow(visit, "part long, query_id long, vec array<double>, keys array<long>")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            by_key = np.argsort(np.asarray(left.column("key")), kind="stable")
            stored_keys, ids, vectors = np.asarray(left.column("key"))[by_key], np.asarray(left.column("vec_id"))[by_key], matrix(left.column("vec"))[by_key]
            for q, v, keys in zip(right.column("query_id").to_pylist(), matrix(right.column("vec")), right.column("keys"), strict=True):
                lo, hi = (np.searchsorted(stored_keys, np.asarray(keys.values), side=side) for side in ("left", "right"))
                n = hi - lo
                at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                if len(at):
                    out += [(q, i, d) for d, i in nearest_ids(ids[at], vectors[at], q, v, k)]
        return pa.table({"query_id": pa.array([g[0] for g in out], pa.int64()), "vec_id": pa.array([g[1] for g in out], pa.int64()), "score": pa.array([g[2] for g in out], pa.float64())})

    found = stored.groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(compare, "query_id long, vec_id long, score double")
    best = lambda pairs: pairs.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).filter(F.col("rank") <= k)
    bounds = best(found).filter(F.col("rank") == k).select("query_id", F.col("score").alias("bound"))
    bounded = queries.join(bounds, F.col("vec_id") == F.col("query_id"), "left").select("vec_id", "vec", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    filled = np.flatnonzero(sizes)
    n_chunks = -(-sizes.flat[filled] // CHUNK)
    piece = np.repeat(np.arange(len(filled)), n_chunks)
    piece_part = (filled[piece] * SPREAD + (np.arange(n_chunks.sum()) - np.repeat(np.cumsum(n_chunks) - n_chunks, n_chunks)) * SPREAD_CHUNK) % parts

    def reached(q: np.ndarray, bound: float, cells: np.ndarray) -> np.ndarray:
        """Which cells can hold a vector within bound of q; what isn't a number is reached."""
        low, at = least_squared(q, books, (cells // len(books[1]), cells % len(books[1])), rings[cells]), bound * bound
        return ~(low > at + ROUNDING * (q @ q + at + low))

    def revisit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, dealt = [], []
            for i, (q, bound) in enumerate(zip(matrix(b.column(1)), b.column(2).to_pylist(), strict=True)):
                hit = np.zeros(parts, bool)
                hit[piece_part[reached(q, bound, filled)[piece]]] = True
                dealt += np.flatnonzero(hit).tolist()
                at += [i] * int(hit.sum())
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(dealt, pa.int64()), *(c.take(at) for c in b.columns)], names=["part", "query_id", "vec", "bound"])

    def settle(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            cells, inverse = np.unique(np.asarray(left.column("key")) >> 32, return_inverse=True)
            ids, vectors = np.asarray(left.column("vec_id")), matrix(left.column("vec"))
            asks, own, bounds = matrix(right.column("vec")), right.column("query_id").to_pylist(), np.asarray(right.column("bound"))
            lengths, tile = (vectors * vectors).sum(1), max(1, TILE // len(vectors))
            for lo in range(0, len(asks), tile):
                near = squared(asks[lo : lo + tile], vectors)  # by products, so rounded; what may be near enough is measured anew
                for i, d in enumerate(near, lo):
                    q, at = asks[i], bounds[i] * bounds[i]
                    rows = np.flatnonzero(~(d > at + ROUNDING * (q @ q + lengths)) & reached(q, bounds[i], cells)[inverse])
                    if len(rows):
                        out += [(own[i], v, x) for x, v in nearest_ids(ids[rows], vectors[rows], own[i], q, k)]
        return pa.table({"query_id": pa.array([g[0] for g in out], pa.int64()), "vec_id": pa.array([g[1] for g in out], pa.int64()), "score": pa.array([g[2] for g in out], pa.float64())})

    asked = bounded.mapInArrow(revisit, "part long, query_id long, vec array<double>, bound double")
    found = stored.groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(settle, "query_id long, vec_id long, score double")
    return best(found).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    rows = usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return search(rows, rows.filter(F.col("vec_id") % 100 == 0))


#: Brute force over all pairs of a query and a row, squares added in the order of the components.
ORACLE = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS vec FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
usual AS (SELECT len(vec) AS n FROM v GROUP BY 1 ORDER BY count(*) DESC, n LIMIT 1),
u AS (SELECT v.* FROM v, usual WHERE len(vec) = n),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id,
    min(sqrt(list_reduce(list_transform(list_zip(c.vec, q.vec), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda a, b: a + b))) AS score
    FROM u AS q, u AS c WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id GROUP BY 1, 2)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id))::INT AS rank, vec_id, score FROM pairs
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) <= 10"""
