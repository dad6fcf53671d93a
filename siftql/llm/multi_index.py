"""Near-duplicate vectors by an inverted multi-index.

Vectors are cut into halves with a codebook each; the product of the codebooks is a grid of cells (Babenko and Lempitsky,
2012).  A query visits cells by the multi-sequence algorithm: a frontier over the two sorted lists of distances yields
cells from the nearest on, where the distance of a cell is a lower bound for any vector in it (from the planes between
centroids).  A traversal stops once the target recall is reached: the distance that covers this share of the partners at
exactly the least cosine, which lie hardest to reach, is measured when the index is fitted.  A target of 1 goes on to the
radius of the search, beyond which no partner can lie.  Every candidate is then verified in double precision.

Codebooks grow with the square root of the number of vectors, so cells keep their size and a vector meets a bounded
number of strangers.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftql.llm._shared import materialize, release
from siftql.llm.components import components, forest

#: Vectors that a cell of the grid has on average, over all labels.
CELL = 8
#: Unit vectors that the codebooks are fitted on (those with the smallest hashes), at least and for each centroid; every vector is indexed.
SAMPLE, SAMPLE_EACH = 4_096, 16
#: Share of the partners at exactly the least cosine whose cells a traversal reaches; closer ones are reached more often.
TARGET_RECALL = 0.9999
#: Vectors of a cell, and queries, that meet in one group, counted in units of ``UNIT`` numbers.
CHUNK, UNIT = 512, 64
#: Lengths of vectors that have an index of their own; the vectors of further lengths are compared within their length and label.
LENGTHS = 8


def fit_codebook(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """k-means from farthest-first seeds of a seeded order; fewer centroids if there are fewer distinct vectors."""
    x = np.unique(x, axis=0)
    if len(x) <= k:
        return x
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = ((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)).argmin(1)
        c = np.array([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(k)])
    return np.unique(c, axis=0)


class Codebook:
    def __init__(self, centroids: np.ndarray):
        self.c = centroids
        self.apart = np.sqrt(np.maximum(((centroids[:, None] - centroids[None]) ** 2).sum(2), 1e-300))

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each row, and the squared lower bound of its distance to each centroid's cell."""
        d = np.maximum((x**2).sum(1)[:, None] - 2 * x @ self.c.T + (self.c**2).sum(1), 0)
        own = d.argmin(1)
        gap = (d - d[np.arange(len(d)), own][:, None]) / (2 * self.apart[own])
        gap[np.arange(len(d)), own] = 0
        return own, np.maximum(gap, 0) ** 2


def multi_sequence(first: np.ndarray, second: np.ndarray, limit: float) -> Iterator[tuple[int, int]]:
    """Cells (i, j) in order of ``first[i] + second[j]``, up to ``limit``."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, seen = [(float(first[a[0]] + second[b[0]]), 0, 0)], {(0, 0)}
    while heap:
        d, i, j = heapq.heappop(heap)
        if d > limit:
            return
        yield int(a[i]), int(b[j])
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(a) and q < len(b) and (p, q) not in seen:
                seen.add((p, q))
                heapq.heappush(heap, (float(first[a[p]] + second[b[q]]), p, q))


class MultiIndex:
    """Two codebooks for unit vectors of one dimension, and how far a traversal goes."""

    def __init__(self, sample: np.ndarray, centroids: int, min_cosine: float, target_recall: float = TARGET_RECALL, seed: int = 7):
        self.cut = sample.shape[1] // 2 or 1
        self.books = [Codebook(fit_codebook(h, centroids, seed=k)) for k, h in enumerate((sample[:, : self.cut], sample[:, self.cut :]))]
        self.wide = len(self.books[1].c)
        self.limit = 2 - 2 * min_cosine + 1e-9
        if target_recall < 1 and sample.shape[1] > 1:
            self.limit = min(self.limit, self._reach(sample, min_cosine, target_recall, np.random.default_rng(seed)))

    def _reach(self, sample: np.ndarray, min_cosine: float, target: float, rng: np.random.Generator) -> float:
        """The bound that covers the target's share of partners at the least cosine, in directions drawn evenly."""
        found = []
        for _ in range(-(-100_000 // len(sample))):
            way = rng.standard_normal(sample.shape)
            way -= (way * sample).sum(1, keepdims=True) * sample
            way /= np.maximum(np.linalg.norm(way, axis=1, keepdims=True), 1e-300)
            partner = min_cosine * sample + np.sqrt(1 - min_cosine**2) * way
            for at in range(0, len(sample), 1024):
                x, y = sample[at : at + 1024], partner[at : at + 1024]
                g, h = (b.bounds(p)[1] for b, p in zip(self.books, (x[:, : self.cut], x[:, self.cut :])))
                i, j = np.divmod(self.cells(y), self.wide)
                found.append(g[np.arange(len(x)), i] + h[np.arange(len(x)), j])
        return float(np.quantile(np.concatenate(found), target)) + 1e-9

    def cells(self, x: np.ndarray) -> np.ndarray:
        own = [b.bounds(h)[0] for b, h in zip(self.books, (x[:, : self.cut], x[:, self.cut :]))]
        return own[0] * self.wide + own[1]

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
        """The cell of each row, and the cells that it visits."""
        (a, g), (b, h) = (k.bounds(p) for k, p in zip(self.books, (x[:, : self.cut], x[:, self.cut :])))
        out = []
        for k in range(len(x)):
            i, j = np.flatnonzero(g[k] <= self.limit), np.flatnonzero(h[k] <= self.limit)  # no cell of another row or column is within reach
            out.append([int(i[p]) * self.wide + int(j[q]) for p, q in multi_sequence(g[k][i], h[k][j], self.limit)])
        return a * self.wide + b, out


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # squares of very large or small components stay finite
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _place(classes: DataFrame, indexes: dict[int, MultiIndex]) -> DataFrame:
    """``cid``, ``label``, ``dim``, ``cell``, ``asks``: each class as a member of its cell, and as a query of each cell that it visits."""
    label_type = classes.schema["label"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                step = max(1, min(1024, (1 << 20) // dim))
                for at in range(0, len(rows), step):
                    some = rows[at : at + step]
                    part = batch.take(pa.array(some))
                    if index := indexes.get(dim):
                        own, visits = index.visits(_unit(_matrix(part.column(3))))
                    else:
                        own, visits = np.zeros(len(some), np.int64), [[0]] * len(some)
                    n = np.array([len(c) for c in visits])
                    got = part.select(["cid", "label", "dim"]).take(pa.array(np.concatenate([np.arange(len(some)), np.repeat(np.arange(len(some)), n)])))
                    cell = np.concatenate([own, np.fromiter((c for cs in visits for c in cs), np.int64, int(n.sum()))])
                    yield pa.RecordBatch.from_arrays([*got.columns, pa.array(cell, pa.int64()), pa.array(np.arange(len(cell)) >= len(some))], ["cid", "label", "dim", "cell", "asks"])

    return classes.select("cid", "label", "dim", "v").mapInArrow(run, f"cid long, label {label_type.simpleString()}, dim int, cell long, asks boolean")


def _verify(met: DataFrame, min_cosine: float) -> DataFrame:
    """Counts (``id``, ``links``) and links that span components (``a``, ``b``) of sorted groups ``g``, ``m``, ``q`` of
    members and queries (``asks``).  A pair is met once: the query has the smaller identifier.
    """

    def group(x: dict[str, np.ndarray], out_id: list, out_n: list, links: list) -> None:
        asks, ids, n = x["asks"], x["id"], x["n"]
        members, queries = np.flatnonzero(~asks), np.flatnonzero(asks)
        if not len(members) or not len(queries):
            return
        u = _unit(x["v"].reshape(len(ids), -1))
        for at in range(0, len(queries), 256):
            some = queries[at : at + 256]
            i, j = np.nonzero((u[some] @ u[members].T >= min_cosine) & (ids[some][:, None] < ids[members][None]))
            if len(i):
                a, b = some[i], members[j]
                out_id += [ids[a], ids[b]]
                out_n += [n[b], n[a]]
                links[:] = forest([*links, *zip(ids[a].tolist(), ids[b].tolist())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(out_id: list, out_n: list, links: list) -> pa.RecordBatch:
            ids, at = np.unique(np.concatenate([*out_id, np.empty(0, np.int64)]), return_inverse=True)
            total = np.bincount(at, np.concatenate([*out_n, np.empty(0, np.int64)]), len(ids)).astype(np.int64)
            k, e = len(ids), len(links)
            a, b = [p for p, _ in links], [p for _, p in links]
            return pa.RecordBatch.from_arrays([pa.array([*ids.tolist(), *[None] * e], pa.int64()), pa.array([*total.tolist(), *[None] * e], pa.int64()), pa.array([*[None] * k, *a], pa.int64()), pa.array([*[None] * k, *b], pa.int64())], ["id", "links", "a", "b"])

        open_: list[dict[str, np.ndarray]] = []
        last = None
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            key = np.stack([batch.column(k).to_numpy() for k in range(3)], 1)
            v = batch.column(6)
            lengths = np.diff(v.offsets.to_numpy())
            flat, upto = np.asarray(v.flatten().to_numpy(zero_copy_only=False), float), np.concatenate([[0], np.cumsum(lengths)])
            x = {"id": batch.column(3).to_numpy(), "n": batch.column(4).to_numpy(), "asks": batch.column(5).to_numpy(zero_copy_only=False).astype(bool)}
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if open_ and tuple(key[a]) != last:
                    group({k: np.concatenate([p[k] for p in open_]) for k in open_[0]}, *out)
                    open_ = []
                open_.append({k: c[a:b] for k, c in x.items()} | {"v": flat[upto[a] : upto[b]]})
                last = tuple(key[a])
            if len(open_) == 1:  # let go of the batch
                open_ = [{k: c.copy() for k, c in open_[0].items()}]
            if out[0]:
                yield done(*out)
        if open_:
            out = ([], [], [])
            group({k: np.concatenate([p[k] for p in open_]) for k in open_[0]}, *out)
            if out[0]:
                yield done(*out)

    return met.select("g", "m", "q", "id", "n", "asks", "v").mapInArrow(run, "id long, links long, a long, b long")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", *, min_cosine: float = 0.98, target_recall: float = TARGET_RECALL) -> DataFrame:
    """Link vectors of equal label by cosine, and their components.

    Returns, for every row, ``vec_id``, ``n_links`` (long; other vectors linked directly), ``component_id`` (smallest
    identifier reachable, its own included) and ``kept`` (it is that one).

    Rows whose label is null or whose vector is null, zero, empty or holds a null or non-finite component link with
    nothing; vectors of different length do not link.  Equal vectors of one label are searched once, as a class with a
    count, so copies are never paired.  Identifiers are integers, or text that holds one, and are taken as unique; rows
    that share one share a node, so the links of each count for all.  A null identifier links with nothing and has a null
    component.  An empty table gives no rows; other columns are not read.

    A cell is met in groups of ``CHUNK`` vectors by ``CHUNK`` queries, however many vectors it has, and a group returns
    counts and a spanning forest, not its pairs.  Visits are (cell, class) pairs until the cells are known to have
    members; vectors travel once, to the groups.  The driver holds the codebooks and their sample, which grow with the
    square root of the number of vectors.
    """
    spark = vectors.sparkSession
    v = F.col(vector_col)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    good = F.coalesce(F.col("label").isNotNull() & F.col("id").isNotNull() & finite, F.lit(False))
    same = ["label", "dim", "h1", "h2"]
    rows = rows.withColumn("good", good).withColumn("dim", F.size("v")).withColumn("h1", F.xxhash64(F.lit(1), "v")).withColumn("h2", F.xxhash64("v", F.lit(2)))
    # A class: label and vector, the latter by 128 bits of hashes. Its name is its smallest identifier.
    classes = rows.where("good").groupBy(*same).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "vectors")
    dims = classes.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(LENGTHS).collect()
    indexes = {}
    for dim, n in dims:
        k = max(2, round((n / CELL) ** 0.5))
        own = classes.where(F.col("dim") == dim)
        sample = _unit(np.array([r.v for r in own.orderBy("h1", "id").limit(max(SAMPLE, SAMPLE_EACH * k)).select("v").collect()], float))
        indexes[dim] = MultiIndex(sample, k, min_cosine, target_recall)
    cell = ["label", "dim", "cell"]
    placed = materialize(_place(classes, indexes), "placed")
    units = lambda c: F.greatest(F.ceil(c * F.greatest(F.col("dim") / UNIT, F.lit(1)) / CHUNK), F.lit(1)).cast("int")
    sizes = placed.groupBy(*cell).agg(F.count(F.when(~F.col("asks"), 1)).alias("members"), F.count(F.when(F.col("asks"), 1)).alias("queries"))
    sizes = sizes.where("members > 0 AND queries > 0").select(*cell, F.monotonically_increasing_id().alias("g"), units(F.col("members")).alias("ms"), units(F.col("queries")).alias("qs"))
    sizes = materialize(sizes, "cells")
    h = F.xxhash64("cid")
    met = placed.join(sizes, cell).select("cid", "asks", "g", "ms", "qs")
    met = met.withColumn("m", F.explode(F.when(F.col("asks"), F.sequence(F.lit(0), F.col("ms") - 1)).otherwise(F.array(F.pmod(h, "ms").cast("int")))))
    met = met.withColumn("q", F.explode(F.when(F.col("asks"), F.array(F.pmod(h, "qs").cast("int"))).otherwise(F.sequence(F.lit(0), F.col("qs") - 1))))
    met = met.join(classes.select("cid", "id", "n", "v"), "cid").drop("ms", "qs").repartition("g", "m", "q").sortWithinPartitions("g", "m", "q")
    found = materialize(_verify(met, min_cosine), "found")
    release(placed)
    release(sizes)
    linked = components(found.where("a is not null").select("a", "b"))
    counted = found.where("id is not null").groupBy("id").agg(F.sum("links").alias("links"))
    info = classes.select(*same, "id", "n").join(counted, "id", "left").join(linked, F.col("id") == F.col("node"), "left")
    info = materialize(info.select(*same, (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component")), "classes")
    for old in (found, linked, classes):
        release(old)
    out = rows.where("good").select("id", *same).join(info, same).select("id", "n_links", "component")
    out = out.union(rows.where("not good").select("id", F.lit(0).cast("long"), F.col("id")))
    return out.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))
