"""Nearest neighbours by an inverted multi-index.

Unit vectors are cut in two halves, each with its own codebook of centroids, fitted on at most `fit_rows` vectors (a
documented bound on fitting; every vector is indexed). A vector's entry lies in the cell of its two nearest centroids.
A query walks centroid pairs by growing summed distance, with a heap over the two sorted lists of distances, until the
cells it has passed hold `reach` entries; these are reranked by exact cosine of the original vectors.

A codebook has 3 * n ** 0.25 centroids for n vectors, so that there are 9 * sqrt(n) cells: cells and the table of their
sizes, all that the driver holds, both grow with the root of n. Neighbouring cells of one left centroid are dealt
together until they hold `group` entries; a query goes only to groups with a cell that it passes. Groups of more than
`block` entries are split, as copies of one vector make them, and each part hands back k rows a query; a group that more
than `block` queries pass is copied for each block of them.

Vectors that are null, empty, zero, of another length than most, or with null or non-finite components take no part, as
entries or queries. Ties go to the smaller vec_id. Repeated rows are entries of their own; a query's own vec_id never
answers it. Different vectors under one queried vec_id are queries of their own, each with its k rows; equal ones are one
query. With fewer candidates than k, all are returned. An empty table gives an empty result. Long vectors cost in
proportion to their length.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import durable


def clean(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the rows that take part: finite, not all zero, none null."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    return rows.where(F.coalesce(fine, F.lit(False)))


def matrix(column) -> np.ndarray:
    """A list column of equal lengths as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / scale
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(1))


def codebook(x: np.ndarray, codes: int, rounds: int = 12) -> np.ndarray:
    """k-means from spread-out rows; a centroid left without rows takes the row farthest from its own."""
    x = np.unique(x, axis=0)
    rng = np.random.default_rng(10)
    centroids = x[rng.permutation(len(x))[:codes]].copy()
    for _ in range(rounds):
        d = distances(x, centroids)
        near = d.argmin(1)
        sums, counts = np.zeros_like(centroids), np.bincount(near, minlength=len(centroids))
        np.add.at(sums, near, x)
        full = counts > 0
        centroids[full] = sums[full] / counts[full, None]
        if not full.all():
            far = np.argsort(-d[np.arange(len(x)), near])[: int((~full).sum())]
            centroids[~full] = x[far]
    return centroids


def walk(near: np.ndarray, far: np.ndarray, sizes: np.ndarray, reach: int) -> list[tuple[int, int]]:
    """Centroid pairs by summed distance until their cells hold reach entries; empty cells are passed over."""
    a, b = np.argsort(near, kind="stable"), np.argsort(far, kind="stable")
    heap, pushed, held, out = [(near[a[0]] + far[b[0]], 0, 0)], {(0, 0)}, 0, []
    while heap and held < reach:
        _, i, j = heapq.heappop(heap)
        n = int(sizes[a[i], b[j]])
        if n:
            out.append((int(a[i]), int(b[j])))
            held += n
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in pushed:
                pushed.add((x, y))
                heapq.heappush(heap, (near[a[x]] + far[b[y]], x, y))
    return out


def best_rows(scores: np.ndarray, ids: np.ndarray, exact, k: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and exact scores of the k largest. scores may be off in the last places; what is near the k-th is scored anew."""
    some = np.flatnonzero(scores >= np.partition(scores, -k)[-k] - 1e-9) if len(scores) > k else np.arange(len(scores))
    some = some[scores[some] > -np.inf]
    sure = exact(some)
    order = np.lexsort((ids[some], -sure))[:k]
    return ids[some[order]], sure[order]


def rows_of(q: np.ndarray, e: np.ndarray):
    """Cosines of one vector with rows, each by the same sum, so that equal rows get equal scores."""
    return np.clip((e * q).sum(1) / (np.sqrt((e * e).sum(1)) * np.sqrt((q * q).sum())), -1, 1)


def true_nearest(index: DataFrame, q_ids: np.ndarray, q: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(query number, cell) of the true k nearest of a few queries: every row is compared, k rows a batch come back."""

    def compare(stream):
        for batch in stream:
            if batch.num_rows:
                e, ids, cell = unit(matrix(batch.column("v"))), batch.column("vec_id").to_numpy(), batch.column("cell").to_numpy()
                at, best, near = [], [], []
                for i, scores in enumerate(q @ e.T):
                    scores[ids == q_ids[i]] = -np.inf
                    top = np.argsort(-scores, kind="stable")[:k]
                    at += [i] * len(top)
                    best += scores[top].tolist()
                    near += cell[top].tolist()
                yield pa.record_batch([pa.array(at, pa.int32()), pa.array(best, pa.float64()), pa.array(near, pa.int32())], names=["at", "score", "cell"])

    rows = index.mapInArrow(compare, "at int, score double, cell int")
    top = rows.groupBy("at").agg(F.slice(F.sort_array(F.collect_list(F.struct("score", "cell")), asc=False), 1, k).alias("x"))
    return [(r[0], x[1]) for r in top.collect() for x in r[1] if x[0] > -np.inf]


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, codes: int | None = None, reach: int | None = None, aim: float = 0.985, probes: int = 128, fit_rows: int = 20_000, group: int = 2048, block: int = 8192, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, vec_id, score): each query's k nearest found. Queries: vec_id divisible by every.

    reach is how many entries a query's cells must hold. Where none is given, it is measured: `probes` vectors are
    compared with every row, and the walk must come as far as `aim` of their true neighbours lie."""
    spark = vectors.sparkSession
    rows = clean(vectors, id_col, vector_col)
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").take(1)
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, total = lengths[0]
    rows = rows.where(F.size("v") == width)
    half = width // 2
    codes = codes or max(2, round(3 * total**0.25))
    draw = lambda n, seed: rows.where(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 20)) < int(min(1.0, 2 * n / total) * (1 << 20)) + 1).orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(n).collect()
    x = unit(np.array([r["v"] for r in draw(fit_rows, 3)] or [[1.0] * width], float))
    books = [codebook(x[:, s], codes) if x[:, s].shape[1] else np.zeros((1, 0)) for s in (slice(0, half), slice(half, None))]
    n_left, n_right = map(len, books)

    def place(stream):
        for batch in stream:
            if batch.num_rows:
                u = unit(matrix(batch.column("v")))
                cell = distances(u[:, :half], books[0]).argmin(1) * n_right + distances(u[:, half:], books[1]).argmin(1)
                yield pa.record_batch([batch.column("vec_id"), batch.column("v"), pa.array(cell.astype(np.int32))], names=["vec_id", "v", "cell"])

    index = durable(rows.mapInArrow(place, "vec_id long, v array<double>, cell int"))
    sizes = np.zeros((n_left, n_right), np.int64)
    for cell, n in index.groupBy("cell").count().collect():  # one row a cell
        sizes[divmod(cell, n_right)] = n
    if reach is None:
        chosen = draw(probes, 7)
        q = unit(np.array([r["v"] for r in chosen] or [[1.0] * width], float))
        far: list[int] = []
        held: dict[int, dict[int, int]] = {}
        for at, cell in true_nearest(index, np.array([r["vec_id"] for r in chosen] or [-1]), q, k):
            if at not in held:
                d = distances(q[at : at + 1, :half], books[0])[0], distances(q[at : at + 1, half:], books[1])[0]
                passed = [a * n_right + b for a, b in walk(*d, sizes, total)]
                held[at] = dict(zip(passed, np.cumsum(sizes.ravel()[passed]).tolist(), strict=True))
            far.append(held[at][cell])
        reach = int(np.quantile(far, aim)) if far else total
    goal = reach
    # Cells of one left centroid, in order, until they hold `group` entries.
    group_of, sums = np.zeros(n_left * n_right, np.int64), []
    for a in range(n_left):
        for b in range(n_right):
            n = int(sizes[a, b])
            if not b or sums[-1] + n > group:
                sums.append(0)
            sums[-1] += n
            group_of[a * n_right + b] = len(sums) - 1

    def ask(stream):
        for batch in stream:
            if batch.num_rows:
                u = unit(matrix(batch.column("v")))
                left, right = distances(u[:, :half], books[0]), distances(u[:, half:], books[1])
                at, to, cells = [], [], []
                for i in range(len(u)):
                    by: dict[int, list[int]] = {}
                    for a, b in walk(left[i], right[i], sizes, goal):
                        by.setdefault(int(group_of[a * n_right + b]), []).append(a * n_right + b)
                    at += [i] * len(by)
                    to += by
                    cells += by.values()
                yield pa.record_batch([batch.column(0).take(pa.array(at, pa.int64())), batch.column(1).take(pa.array(at, pa.int64())), batch.column(2).take(pa.array(at, pa.int64())), pa.array(to, pa.int64()), pa.array(cells, pa.list_(pa.int32()))], names=["query_id", "twin", "q", "g", "cells"])

    def grouped(stream):
        for batch in stream:
            yield pa.record_batch([*batch.columns, pa.array(group_of[batch.column("cell").to_numpy()])], names=[*batch.schema.names, "g"])

    queries = index.where(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", F.xxhash64("v").alias("twin"), "v").dropDuplicates(["vec_id", "twin"])
    asked = durable(queries.mapInArrow(ask, "query_id long, twin long, q array<double>, g long, cells array<int>"))
    entries = index.mapInArrow(grouped, "vec_id long, v array<double>, cell int, g long")
    # Parts of a group's entries and blocks of its queries: both sides are counted, one row a group.
    parts = entries.groupBy("g").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    shape = durable(asked.groupBy("g").agg(F.ceil(F.count("*") / block).cast("int").alias("asks")).join(parts, "g"))
    asked = asked.join(shape, "g").withColumn("ask", F.pmod(F.xxhash64("query_id", "twin"), "asks").cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts", "asks")
    entries = entries.join(shape, "g").withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(5)), "parts").cast("int")).withColumn("ask", F.explode(F.sequence(F.lit(0), F.col("asks") - 1))).drop("parts", "asks")

    def rerank(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if left.num_rows and right.num_rows:
            ids, e, cell = right.column("vec_id").to_numpy(), matrix(right.column("v")), right.column("cell").to_numpy()
            names, twins, q = left.column("query_id").to_numpy(), left.column("twin").to_numpy(), matrix(left.column("q"))
            e, q = e / np.abs(e).max(1, keepdims=True), q / np.abs(q).max(1, keepdims=True)
            e_unit, q_unit = unit(e), unit(q)
            for at in range(0, len(q), 256):
                scores = q_unit[at : at + 256] @ e_unit.T
                for i, row in enumerate(scores, at):
                    row[~np.isin(cell, left.column("cells")[i].as_py()) | (ids == names[i])] = -np.inf
                    near, score = best_rows(row, ids, lambda some, i=i: rows_of(q[i], e[some]), k)
                    out[0] += [int(names[i])] * len(near)
                    out[1] += [int(twins[i])] * len(near)
                    out[2] += near.tolist()
                    out[3] += score.tolist()
        return pa.table(out, pa.schema([("query_id", pa.int64()), ("twin", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]))

    keys = ["g", "part", "ask"]
    found = asked.groupBy(*keys).cogroup(entries.groupBy(*keys)).applyInArrow(rerank, "query_id long, twin long, vec_id long, score double")
    # k rows a query and part: the rows of a query are as many as the parts that it meets.
    best = found.groupBy("query_id", "twin").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), "x.vec_id", (-F.col("x.far")).alias("score"))


def op10_multi_index(spark, sf_dir: str) -> DataFrame:
    """The five nearest found for every vector whose id is divisible by 50."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
