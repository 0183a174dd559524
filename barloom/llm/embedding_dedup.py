"""Near duplicates of embeddings by an inverted multi-index.

Unit vectors are cut in two halves, each with its own codebook (fitted on at most `fit_rows` vectors, a documented bound);
pairs of centroids are the cells of a product grid. Every vector traverses its label's cells by the sum of two squared
bounds: a vector of a half's cell a is at least (|q - a|^2 - |q - j|^2) / (2 |a - j|) away from q for every centroid j.
Two unit vectors of cosine c or more are at most sqrt(2 - 2c) apart, so that the cells beyond that sum hold no link: with
`recall` 1 the traversal stops there, and nothing is lost. Below 1 it stops at the sum that would have found that share
of `probes` sampled vectors, each turned by the angle of the threshold in a random direction.

The cells passed are a staircase: left centroids by growing bound, and for each the right ones that the rest of the sum
allows. Cells are dealt in tiles of neighbouring cells, split by hash above `block` vectors; a vector goes to the tiles
that it passes from its own on, so each pair meets once. A task holds one block and streams the vectors that visit it;
it hands back counts and the edges of a forest, never pairs. Links are confirmed by the cosine of the original vectors.

Equal vectors of one label are one class, counted by their distinct vec_ids: repeated rows are one vector, and copies are
not compared with each other. Different vectors under one vec_id are vectors of their own. Vectors of different lengths
are never compared. A vector without vec_id or label, or that is null, empty, zero, or holds null or non-finite parts,
links with nothing; its row is returned as its own component. An empty table gives an empty result.

Work: with vectors that have no structure every cell is near every other, and no index that loses nothing can pass over
many of them; there the work grows with the square of a label's vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import durable, partitions
from barloom.llm.links import components
from barloom.llm.multi_index import codebook, distances, matrix, unit


def rows_of(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, class, label, v): class is a 128-bit key of label and vector, null where a row takes no part."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").cast("string").alias("label"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    part = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & F.coalesce(fine, F.lit(False))
    key = F.concat(*[F.hex(F.xxhash64(F.lit(seed), "label", "v")) for seed in (17, 71)])
    return rows.select("vec_id", F.when(part, key).alias("class"), F.when(part, F.col("label")).alias("label"), F.when(part, F.col("v")).alias("v"))


def bounds(q: np.ndarray, centroids: np.ndarray, rivals: int = 8) -> np.ndarray:
    """Rows by centroids: what each row is at least away from any vector of a centroid's cell, squared."""
    d = distances(q, centroids)
    between = np.sqrt(distances(centroids, centroids))
    out = np.zeros_like(d)
    near = np.argpartition(d, min(rivals, len(centroids)) - 1, axis=1)[:, :rivals]
    for r in range(near.shape[1]):
        j = near[:, r]
        gap = 2 * between[j]
        away = np.divide(d - d[np.arange(len(q)), j][:, None], gap, out=np.zeros_like(d), where=gap > 1e-12)
        np.maximum(out, away, out=out)
    return out * out


def staircase(left: np.ndarray, right: np.ndarray, stop: float) -> np.ndarray:
    """Cells (left * width + right) whose two bounds sum to stop or less, nearest left centroids first."""
    a, b = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    width = np.searchsorted(right[b], stop - left[a], side="right")
    return np.concatenate([a[i] * len(b) + b[: width[i]] for i in np.flatnonzero(width)] or [np.zeros(0, np.int64)])


def turned(x: np.ndarray, cosine: float, seed: int) -> np.ndarray:
    """Unit rows turned by the angle of the cosine, each in a random direction."""
    noise = np.random.default_rng(seed).normal(size=x.shape)
    noise -= (noise * x).sum(1, keepdims=True) * x
    return cosine * x + np.sqrt(1 - cosine * cosine) * noise / np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-300)


def linked(q: np.ndarray, q_unit: np.ndarray, e: np.ndarray, e_unit: np.ndarray, cosine: float) -> np.ndarray:
    """Which rows of q and e have the cosine or more; what lies within rounding of it is computed anew, by the definition."""
    s = q_unit @ e_unit.T
    out = s >= cosine
    for i, j in zip(*np.nonzero(np.abs(s - cosine) < 1e-12), strict=True):
        a, b = q[i], e[j]
        out[i, j] = (a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())) >= cosine
    return out


class Forest:
    """Components among the rows of a block, by the links of one visitor after the other."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, hit: np.ndarray) -> None:
        roots = np.unique(self.root[hit])
        if len(roots) > 1:
            self.root[np.isin(self.root, roots)] = roots[0]


EDGES = "class string, other string, n long"


def block_links(cosine: float, chunk: int = 512):
    """A stream of rows sorted by block, members (home) first: counts and forest edges of each block."""

    def run(stream):
        name, ids, weights, e, e_unit, counts, forest, held = None, [], None, None, None, None, None, []
        out: list[list] = [[], [], []]

        def give(a, b, n):
            for column, x in zip(out, (a, b, n), strict=True):
                column.extend(x)

        def gather():
            """The members are all read: their own links."""
            nonlocal ids, weights, e, e_unit, counts, forest, held
            ids = [x for h in held for x in h[0]]
            weights, e = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            e = e / np.abs(e).max(1, keepdims=True)
            e_unit, counts, forest, held = unit(e), np.zeros(len(ids), np.int64), Forest(len(ids)), []
            for at in range(0, len(ids), chunk):
                hit = linked(e[at : at + chunk], e_unit[at : at + chunk], e, e_unit, cosine)
                hit[np.arange(len(hit)), np.arange(at, at + len(hit))] = False
                counts[at : at + chunk] += hit @ weights
                for i in np.flatnonzero(hit.any(1)):
                    hit[i, at + i] = True
                    forest.join(hit[i])

        def close():
            if held:
                gather()
            if name is not None:
                some = np.flatnonzero(counts)
                give([ids[i] for i in some], [ids[forest.root[i]] for i in some], counts[some].tolist())

        def visit(names, w, q):
            q = q / np.abs(q).max(1, keepdims=True)
            q_unit = unit(q)
            for at in range(0, len(names), chunk):
                hit = linked(q[at : at + chunk], q_unit[at : at + chunk], e, e_unit, cosine)
                found = np.flatnonzero(hit.any(1))
                if len(found):
                    counts[:] += w[at : at + chunk] @ hit
                    for i in found:
                        forest.join(hit[i])
                    give([names[at + i] for i in found], [ids[int(hit[i].argmax())] for i in found], (hit[found] @ weights).tolist())

        for batch in stream:
            blocks, home = batch.column("block").to_pylist(), batch.column("visitor").to_numpy()
            edge = [0, *[i for i in range(1, len(blocks)) if blocks[i] != blocks[i - 1] or home[i] != home[i - 1]], len(blocks)]
            for a, b in zip(edge, edge[1:]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if blocks[a] != name:
                    close()
                    name = blocks[a]
                names, w, x = part.column("class").to_pylist(), part.column("w").to_numpy(), matrix(part.column("v"))
                if home[a] == 0:
                    held.append((names, w, x))
                    continue
                if held:
                    gather()
                visit(names, w, x)
            if out[0]:
                yield pa.record_batch([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], names=["class", "other", "n"])
                out = [[], [], []]
        close()
        if out[0]:
            yield pa.record_batch([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], names=["class", "other", "n"])

    return run


def near_duplicates(vectors: DataFrame, cosine: float = 0.93, recall: float = 1.0, codes: int | None = None, block: int = 4096, probes: int = 512, fit_rows: int = 20_000, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    n_parts = partitions(spark)
    rows = durable(rows_of(vectors, id_col, vector_col, label_col))
    members = rows.where("class is not null").groupBy("class", "vec_id").agg(F.first("label").alias("label"), F.first("v").alias("v"))
    classes = members.groupBy("class").agg(F.min("vec_id").alias("least"), F.count("*").alias("w"), F.first("label").alias("label"), F.first("v").alias("v")).withColumn("width", F.size("v"))
    classes = durable(classes)
    shape = classes.groupBy("width").count().orderBy(F.desc("count"), "width").take(1)
    alone = rows.where("class is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not shape:
        return alone
    width, total = shape[0]
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0]
    half = width // 2
    codes = codes or max(2, round(3 * total**0.25))
    share = int(min(1.0, 2 * fit_rows / total) * (1 << 20)) + 1
    drawn = classes.where((F.col("width") == width) & (F.pmod(F.xxhash64("class", F.lit(3)), F.lit(1 << 20)) < share)).orderBy(F.xxhash64("class", F.lit(3)), "class").limit(fit_rows).select("v").collect()
    x = unit(np.array([r[0] for r in drawn] or [[1.0] * width], float))
    books = [codebook(x[:, s], codes) if x[:, s].shape[1] else np.zeros((1, 0)) for s in (slice(0, half), slice(half, None))]
    n_right = len(books[1])
    n_cells = len(books[0]) * n_right
    stop = 2 - 2 * cosine + 1e-9
    if recall < 1:
        q = turned(p := x[:probes], cosine, 5)
        near = [distances(p[:, s], book).argmin(1) for s, book in zip((slice(0, half), slice(half, None)), books, strict=True)]
        sums = sum(bounds(q[:, s], book)[np.arange(len(q)), at] for s, book, at in zip((slice(0, half), slice(half, None)), books, near, strict=True))
        stop = float(np.quantile(sums, recall))

    def place(stream):
        for batch in stream:
            if batch.num_rows:
                cell = np.zeros(batch.num_rows, np.int32)
                plain = np.flatnonzero(batch.column("width").to_numpy() == width)
                if len(plain):
                    u = unit(matrix(batch.column("v").take(pa.array(plain))))
                    cell[plain] = distances(u[:, :half], books[0]).argmin(1) * n_right + distances(u[:, half:], books[1]).argmin(1)
                yield pa.record_batch([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    placed = durable(classes.mapInArrow(place, "class string, least long, w long, label string, v array<double>, width int, cell int"))
    # Tiles of neighbouring cells: as many as the largest label fills with blocks, so that their table is as long as the
    # cells, whose number grows with the root of the vectors.
    sizes = np.zeros(n_cells, np.int64)
    for cell, n in placed.groupBy("cell").count().collect():
        sizes[cell] = n
    tiles = max(1, -(-largest // block))
    tile_of = np.minimum(np.maximum(np.cumsum(sizes) - 1, 0) * tiles // max(1, int(sizes.sum())), tiles - 1)

    def call(stream):
        """Tiles from a vector's own on that hold a cell which it passes."""
        for batch in stream:
            if batch.num_rows:
                home, plain = tile_of[batch.column("cell").to_numpy()], batch.column("width").to_numpy() == width
                seen: list[list[int]] = [[int(t)] for t in home]
                at = np.flatnonzero(plain)
                if len(at) and tiles > 1:
                    u = unit(matrix(batch.column("v").take(pa.array(at))))
                    left, right = bounds(u[:, :half], books[0]), bounds(u[:, half:], books[1])
                    for i, a, b in zip(at, left, right, strict=True):
                        passed = np.unique(tile_of[staircase(a, b, stop)])
                        seen[i] = sorted({int(home[i]), *passed[passed > home[i]].tolist()})
                names = ["class", "w", "label", "v", "width"]
                yield pa.record_batch([*[batch.column(c) for c in names], pa.array(home.astype(np.int32)), pa.array(seen, pa.list_(pa.int32()))], names=[*names, "home", "seen"])

    called = durable(placed.mapInArrow(call, "class string, w long, label string, v array<double>, width int, home int, seen array<int>"))
    own = ["label", "width"]
    split = durable(called.groupBy(*own, F.col("home").alias("tile")).agg(F.ceil(F.count("*") / block).cast("int").alias("parts")))
    # A row for each tile of its label that holds vectors, and there for each part: its own part's member, a visitor of
    # the later parts of its own tile and of all parts of later tiles.
    visits = called.select("class", "w", *own, "v", "home", F.explode("seen").alias("tile")).join(split, [*own, "tile"])
    mine = F.when(F.col("home") == F.col("tile"), F.pmod(F.xxhash64("class", F.lit(9)), F.col("parts")).cast("int")).otherwise(F.lit(-1))
    dealt = visits.withColumn("mine", mine).withColumn("part", F.explode(F.sequence(F.greatest("mine", F.lit(0)), F.col("parts") - 1)))
    named = dealt.select(F.concat_ws("|", "width", "tile", "part", "label").alias("block"), F.when(F.col("mine") == F.col("part"), 0).otherwise(1).alias("visitor"), "class", "w", "v")
    ranged = named.repartition(n_parts, "block").sortWithinPartitions("block", "visitor")
    found = durable(ranged.mapInArrow(block_links(cosine), EDGES))
    linked_to = found.groupBy("class").agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("class").alias("a"), F.col("other").alias("b")))
    every = placed.select("class", "least", "w").join(linked_to, "class", "left").join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    label = every.groupBy("root").agg(F.min("least").alias("component_id"))
    final = every.join(label, "root").select("class", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), "component_id")
    part = rows.where("class is not null").select("vec_id", "class").join(final, "class").select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return part.unionByName(alone)


def op11_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """All embeddings by label: links of cosine 0.93 or more, none lost."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
