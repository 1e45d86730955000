"""Approximate nearest neighbours by balanced posting lists.

Centroids are fitted on a bounded sample and kept balanced: a list that is too long splits in two. They are searched by an
in-memory graph of neighbouring centroids, which is broadcast (at most MOST_LISTS of them). A vector goes to its nearest list and, if it lies at a boundary, to further lists that are nearly as near. A query
visits the nearest lists up to a ratio of distances, and more until they are sure to hold enough candidates. Lists are cut
into blocks; a block of vectors meets a block of queries in one task, which passes on each query's best candidates only.

Equal vectors are stored once with the smallest ids that can be among the answers (one more than asked for; a query's own
id may be one of them), so groups of copies of any size cost one row, and ties keep to the smaller id.

Rules: vectors that are null, zero, or hold null, NaN or infinite components take no part, neither as queries nor as
candidates, nor do vectors with another number of components than most; ids that are null or repeated: null ids take no
part, a repeated id counts with each of its vectors; fewer candidates than asked for are all returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskflow.session import materialize

#: Rows the centroids are fitted on at most, vectors of a list to aim for, and lists at most (a bound of what is broadcast).
FIT_ROWS, LIST_SIZE, MOST_LISTS = 20_000, 300, 16_384
#: A vector is copied to at most COPIES lists whose distance is within (1 + BOUNDARY) of its nearest list's.
COPIES, BOUNDARY = 4, 0.15
#: A query visits at most PROBES lists within this ratio of its nearest list's distance, and at least LEAST_PROBES.
PROBES, LEAST_PROBES, RATIO = 32, 12, 1.6
#: Links to near centroids, width of the search, and where it starts (with no more lists than that it sees all of them).
DEGREE, BEAM, ENTRIES = 24, 48, 128
BLOCK = 2048
SEED = 5


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None], 0.0)


def balanced_centroids(x: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """k-means in rounds; after each, lists over twice the even size give half of their vectors to the place of the smallest."""
    rng = np.random.default_rng(SEED)
    c = x[rng.choice(len(x), lists, replace=False)].astype(np.float64)
    even = max(1.0, len(x) / lists)
    for turn in range(rounds):
        near = np.concatenate([_distances(x[i : i + 4096], c).argmin(1) for i in range(0, len(x), 4096)])
        sizes = np.bincount(near, minlength=lists)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        full = sizes > 0
        c[full] = sums[full] / sizes[full, None]
        if turn < rounds - 1:
            large = [k for k in np.argsort(-sizes) if sizes[k] > 2 * even]
            for k, small in zip(large, np.argsort(sizes)):
                if sizes[small] < even / 2:
                    members = x[near == k]
                    c[small] = members[rng.integers(len(members))] * 0.5 + c[k] * 0.5
    return c


@dataclass
class CentroidGraph:
    """Each centroid with its nearest others and a few far ones; search is best first with a beam, for many queries at once."""

    centroids: np.ndarray

    def __post_init__(self):
        c, n = self.centroids, len(self.centroids)
        degree = min(DEGREE, n - 1)
        rng = np.random.default_rng(SEED)
        near = [np.argpartition(_distances(c[i : i + 512], c), degree, axis=1)[:, : degree + 1] for i in range(0, n, 512)] if degree else [np.zeros((n, 1), int)]
        self.links = np.concatenate([np.concatenate(near), rng.integers(0, n, (n, min(8, n)))], axis=1)
        self.entries = rng.choice(n, min(n, ENTRIES), replace=False)

    def search(self, x: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
        """Centroids and squared distances, nearest first; ``want`` of them, or all."""
        n, rows = len(self.centroids), np.arange(len(x))
        beam = min(n, max(BEAM, want))
        seen = np.zeros((len(x), n), bool)
        seen[:, self.entries] = True
        ids = np.tile(self.entries, (len(x), 1))
        best = _distances(x, self.centroids[self.entries])
        done = np.zeros(ids.shape, bool)
        norms = (self.centroids * self.centroids).sum(1)
        own = (x * x).sum(1)
        while True:
            open_best = np.where(done, np.inf, best)
            at = open_best.argmin(1)
            live = np.flatnonzero(np.isfinite(open_best[rows, at]))
            if not len(live):
                break
            done[live, at[live]] = True
            step = self.links[ids[live, at[live]]]
            distance = np.maximum(own[live, None] - 2 * np.einsum("qd,qkd->qk", x[live], self.centroids[step]) + norms[step], 0.0)
            order = np.argsort(step, axis=1)
            again = np.zeros(step.shape, bool)
            np.put_along_axis(again, order[:, 1:], np.diff(np.take_along_axis(step, order, 1), axis=1) == 0, 1)
            distance[seen[live[:, None], step] | again] = np.inf
            seen[live[:, None], step] = True
            grown = np.full((len(x), step.shape[1]), np.inf)
            names = np.zeros((len(x), step.shape[1]), ids.dtype)
            grown[live], names[live] = distance, step
            ids, best = np.concatenate([ids, names], 1), np.concatenate([best, grown], 1)
            done = np.concatenate([done, ~np.isfinite(grown)], 1)
            if ids.shape[1] > beam:
                kept = np.argpartition(best, beam - 1, axis=1)[:, :beam]
                ids, best, done = (np.take_along_axis(a, kept, 1) for a in (ids, best, done))
        order = np.argsort(best, axis=1, kind="stable")[:, :want]
        return np.take_along_axis(ids, order, 1), np.take_along_axis(best, order, 1)


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``id, v`` of the rows that take part."""
    v = F.col(vector_column).cast("array<double>")
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
        & F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))) & F.exists("v", lambda c: c != 0))
    # -0.0 and 0.0 are one number
    rows = materialize(rows.withColumn("v", F.transform("v", lambda c: c + F.lit(0.0))))
    common = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    return rows.where(F.size("v") == common["d"]) if common else rows


def distinct_vectors(rows: DataFrame, most_ids: int) -> DataFrame:
    """``v, ids``: distinct vectors with their smallest ids. The limit per group is applied before the shuffle."""
    order = W.partitionBy("v").orderBy("id")
    few = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most_ids)
    return few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def _array(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def nearest(vectors: DataFrame, k: int = 20, query_every: int = 20, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``query_id, rank, id, score``: for each row whose id is divisible by ``query_every`` its k largest inner products with
    other rows."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_column, vector_column)
    stored = materialize(distinct_vectors(rows, k + 1).withColumn("vid", F.monotonically_increasing_id()))
    empty = spark.createDataFrame([], f"query_id long, rank int, {id_column} long, score double")
    head = stored.agg(F.count(F.lit(1)), F.max(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)), F.max(F.size("v"))).first()
    n, longest, dimension = head
    if not n:
        return empty
    # inner product as distance: one more component fills every stored vector up to the greatest length
    sample = stored.select("v", F.xxhash64("vid").alias("h")).orderBy("h").limit(FIT_ROWS).select("v").toArrow().combine_chunks()
    x = _array(sample.column("v").combine_chunks(), dimension)
    lists = int(min(MOST_LISTS, max(1, n // LIST_SIZE), len(x)))
    shared = spark.sparkContext.broadcast((CentroidGraph(balanced_centroids(_filled(x, longest), lists)), longest))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, most = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                ids, distance = graph.search(_filled(_array(part.column(1), dimension), most), COPIES)
                near = np.sqrt(distance)
                take = near <= (1 + BOUNDARY) * near[:, :1] + 1e-12
                take[:, 0] = True
                row, col = np.nonzero(take)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(ids[row, col].astype(np.int32)), pa.array(col == 0)], names=["vid", "list", "home"])

    placed = materialize(stored.select("vid", "v").mapInArrow(place, "vid long, list int, home boolean"))
    # one row per list, at most MOST_LISTS; every vector has one home
    sizes = placed.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.count_if("home").alias("homes"))
    homes = np.zeros(lists, np.int64)
    for r in sizes.select("list", "homes").collect():
        homes[r["list"]] = r["homes"]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, most = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                # of a query only the direction counts; distances to filled vectors order as inner products do
                q = _array(part.column(1), dimension)
                q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300) * np.sqrt(most)
                ids, distance = graph.search(np.concatenate([q, np.zeros((len(q), 1))], 1), 4 * PROBES)
                near, held = np.sqrt(distance), np.cumsum(homes[ids], axis=1)
                order = np.arange(ids.shape[1])[None]
                enough = np.concatenate([np.zeros((len(q), 1), bool), held[:, :-1] >= k + 1], 1)
                row, col = np.nonzero(~enough | (order < LEAST_PROBES) | ((order < PROBES) & (near <= RATIO * near[:, :1])))
                visited = ids[row, col]
                for i in np.flatnonzero(held[:, -1] < k + 1):  # too few candidates in all of these: every list
                    rest = np.setdiff1d(np.arange(lists), ids[i])
                    row, visited = np.concatenate([row, np.full(len(rest), i)]), np.concatenate([visited, rest])
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(visited.astype(np.int32))], names=["id", "v", "list"])

    visits = materialize(rows.where(F.col("id") % query_every == 0).select("id", "v").mapInArrow(probe, "id long, v array<double>, list int"))
    asked = visits.groupBy("list").agg(F.count(F.lit(1)).alias("asked"))
    # vectors and queries of a list meet block by block, each pair of blocks in its own task
    cut = lambda c: F.ceil(F.col(c) / F.lit(BLOCK)).cast("int")
    grid = F.broadcast(materialize(sizes.join(asked, "list").select("list", cut("n").alias("blocks"), cut("asked").alias("parts"))))
    numbers = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    block = ["list", "block", "part"]
    held = (
        placed.select("vid", "list").join(stored, "vid").join(grid, "list")
        .select("list", F.pmod(F.xxhash64("vid"), F.col("blocks")).cast("int").alias("block"), numbers("parts").alias("part"), "v", "ids"))
    queries = visits.join(grid, "list").select(
        "list", numbers("blocks").alias("block"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "id", "v")

    def meet(_: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _best(right, left, k)

    best = held.groupBy(*block).cogroup(queries.groupBy(*block)).applyInPandas(meet, "query_id long, id long, score double")
    return _ranked(best, k, id_column)


def _ranked(best: DataFrame, k: int, id_column: str) -> DataFrame:
    once = best.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    ranked = once.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_column), "score")


def _filled(x: np.ndarray, longest: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(longest - (x * x).sum(1), 0.0))[:, None]], axis=1)


def _best(queries: pd.DataFrame, stored: pd.DataFrame, k: int) -> pd.DataFrame:
    """Each query's k best ids of one block, ties to the smaller id."""
    if not len(queries) or not len(stored):
        return pd.DataFrame({"query_id": np.array([], np.int64), "id": np.array([], np.int64), "score": np.array([], float)})
    q, x = np.array(queries["v"].tolist(), float), np.array(stored["v"].tolist(), float)
    rough = q @ x.T
    top = min(k + 1, len(x))
    kept = np.argpartition(-rough, top - 1, axis=1)[:, :top]
    out: list[tuple[int, int, float]] = []
    ids = stored["ids"].tolist()
    for i, query in enumerate(queries["id"].tolist()):
        # vectors that tie with the last one kept belong to the choice as well
        chosen = np.flatnonzero(rough[i] >= rough[i, kept[i]].min() - 1e-9)
        scores = (x[chosen] * q[i]).sum(1)
        pairs = sorted((-s, int(other), s) for c, s in zip(chosen.tolist(), scores.tolist()) for other in ids[c] if other != query)
        out.extend((query, other, s) for _, other, s in pairs[:k])
    return pd.DataFrame(out, columns=["query_id", "id", "score"]).astype({"query_id": "int64", "id": "int64", "score": "float64"})
