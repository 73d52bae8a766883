"""Clustering of vectors around centroids, the nearest one found by the threshold algorithm.

Vectors become integers, so that sums, means and distances are exact and the result does not depend on how the rows are
dealt. For each component there is a list of the centroids in the order of that component. From a vector's value every
list is walked outward, the nearer neighbour first; a centroid met in any list has its exact distance computed. No
centroid still unmet can be nearer than the sum of the squared distances to the lists' next entries, the frontier: once
that strictly exceeds the best exact distance, the search is finished, ties included.

A round is one pass: each task adds its vectors up per cluster, Spark adds the tasks' sums, and the driver holds the
centroids alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetledger.llm.common import Workspace

#: Vector components times centroids that one numpy step handles.
STEP = 1 << 20


def component_bound(dims: int) -> int:
    """The largest integer component for which every squared distance still fits a long."""
    return isqrt((1 << 62) // dims) // 2


def integer_vectors(rows: DataFrame, dims: int, scale: int, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, v): floor(scale x component) of the vectors with exactly dims components, none null or non-finite. A
    component beyond component_bound stops the job: its distances would not fit."""
    x = F.col(vector_column).cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    bound = component_bound(dims)
    whole = F.transform(
        x,
        lambda c: F.when(F.abs(c * scale) <= bound, F.floor(c * scale)).otherwise(
            F.raise_error(F.lit(f"a component times {scale} exceeds {bound}"))
        ),
    )
    return (
        rows.where((F.size(x) == dims) & finite)
        .select(F.col(id_column).cast("long").alias("vec_id"), whole.cast("array<long>").alias("v"))
    )


@dataclass
class Lists:
    """Per component the centroids in order. values and numbers: a row per component, an entry per centroid, with an end
    mark on both sides that is farther than any centroid."""

    centroids: np.ndarray
    values: np.ndarray
    numbers: np.ndarray

    @classmethod
    def build(cls, centroids: np.ndarray) -> Lists:
        order = np.argsort(centroids, axis=0, kind="stable").T
        dims, far = centroids.shape[1], 4 * component_bound(centroids.shape[1])
        values = np.pad(np.take_along_axis(centroids.T, order, 1), ((0, 0), (1, 1)))
        values[:, 0], values[:, -1] = -far, far
        return cls(centroids, values, np.pad(order, ((0, 0), (1, 1)))) if dims else cls(centroids, values, order)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The number of each vector's nearest centroid (the smaller on ties), its squared distance, and how many exact
        distances were computed for all."""
        n, dims = x.shape
        count = len(self.centroids)
        dim = np.arange(dims)
        left = np.stack([np.searchsorted(self.values[d, 1:-1], x[:, d], "right") for d in range(dims)], 1)
        right = left + 1
        best = np.full(n, np.iinfo(np.int64).max)
        who = np.zeros(n, np.int64)
        met = np.zeros((n, count), bool)
        open_rows, computed = np.arange(n), 0
        for _ in range(count):
            here, lo, hi = x[open_rows], left[open_rows], right[open_rows]
            below, above = here - self.values[dim, lo], self.values[dim, hi] - here
            down = below <= above
            frontier = np.square(np.where(down, below, above)).sum(1)
            go = frontier <= best[open_rows]
            open_rows, here, lo, hi, down = open_rows[go], here[go], lo[go], hi[go], down[go]
            if not len(open_rows):
                break
            fresh = np.zeros((len(open_rows), count), bool)
            fresh[np.arange(len(open_rows))[:, None], self.numbers[dim, np.where(down, lo, hi)]] = True
            fresh &= ~met[open_rows]
            row, number = np.nonzero(fresh)
            exact = np.full(fresh.shape, np.iinfo(np.int64).max)
            exact[row, number] = np.square(here[row] - self.centroids[number]).sum(1)
            computed += len(row)
            first = exact.argmin(1)
            least = exact[np.arange(len(first)), first]
            old, old_who = best[open_rows], who[open_rows]
            better = (least < old) | ((least == old) & (first < old_who))
            best[open_rows], who[open_rows] = np.where(better, least, old), np.where(better, first, old_who)
            met[open_rows] |= fresh
            left[open_rows], right[open_rows] = lo - down, hi + ~down
            open_rows = open_rows[~met[open_rows].all(1)]
        return who, best, computed


def _blocks(batch: pa.RecordBatch, dims: int, centroids: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, vectors) of the batch in steps of bounded size."""
    flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    step = max(1, STEP // (dims * centroids))
    for start in range(0, len(flat), step):
        yield start, flat[start : start + step]


def _sums(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(cluster, dim, n, total) of one assignment; dim -1 holds the number of vectors."""
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = Lists.build(centroids)
        total = np.zeros((len(centroids), dims + 1), np.int64)
        for batch in batches:
            for _, x in _blocks(batch, dims, len(centroids)):
                who, _, _ = lists.nearest(x)
                for c in np.unique(who).tolist():
                    mine = x[who == c]
                    total[c, :dims] += mine.sum(0)
                    total[c, dims] += len(mine)
        c, d = np.nonzero(np.broadcast_to(total[:, dims:] > 0, total.shape))
        yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(d), pa.array(total[c, d])], names=["cluster", "dim", "total"])

    found = vectors.select("v").mapInArrow(run, "cluster long, dim long, total long")
    return found.groupBy("cluster", "dim").agg(F.sum("total").alias("total"))


def _moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floor(sum / count) per component; one without vectors stays."""
    dims = centroids.shape[1]
    totals = np.zeros((len(centroids), dims + 1), np.int64)
    # at most centroids x (dims + 1) rows
    for r in _sums(vectors, centroids).collect():
        totals[r.cluster, r.dim] = r.total
    held = totals[:, dims] > 0
    out = centroids.copy()
    out[held] = totals[held, :dims] // totals[held, dims:]
    return out


def _assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = Lists.build(centroids)
        for batch in batches:
            for start, x in _blocks(batch, dims, len(centroids)):
                who, best, _ = lists.nearest(x)
                ids = batch.column("vec_id").slice(start, len(x))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(who.astype(np.int32)), pa.array(best)], names=["vec_id", "cluster", "distance"]
                )

    return vectors.mapInArrow(run, "vec_id long, cluster int, distance long")


def centroid_digest(centroid: np.ndarray) -> str:
    return sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster(
    rows: DataFrame,
    work: Workspace,
    centroids: int = 8,
    rounds: int = 10,
    dims: int = 64,
    scale: int = 1024,
    seed: str = "3:",
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> tuple[DataFrame, np.ndarray]:
    """Clusters of the vectors of rows (id_column, vector_column; other columns play no part, whatever their names).

    Only vectors with exactly dims components take part, none null, NaN or infinite; others have no row. Centroids start
    as the vectors with the least sha256 of seed and id (equal ids: the lesser vector first; a null id counts as empty
    text and its rows are returned without id); with fewer vectors there are fewer centroids, with none the result is
    empty. Repeated rows count each. Returns (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), a
    row per vector, and the final centroids. Each round reads the written vectors once; equal vectors in any number are
    spread over the tasks like others, since nothing is grouped by vector.
    """
    vectors = work.save(integer_vectors(rows, dims, scale, id_column, vector_column), "vectors")
    key = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = vectors.select(key.alias("key"), "v").orderBy("key", "v").limit(centroids).collect()
    now = np.array([r.v for r in first], np.int64).reshape(-1, dims)
    schema = (
        "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    )
    if not len(now):
        return vectors.sparkSession.createDataFrame([], schema), now
    for _ in range(rounds):
        moved = _moved(vectors, now)
        if (moved == now).all():
            break  # every further round would repeat this one
        now = moved
    found = work.save(_assigned(vectors, now), "assigned")
    # as many rows as centroids
    inertia = {r.cluster: r.s for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    known = [(c, s, sum(inertia.values()), centroid_digest(now[c])) for c, s in inertia.items()]
    summary = found.sparkSession.createDataFrame(
        known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    )
    return found.join(F.broadcast(summary), "cluster").select(*(f.split()[0] for f in schema.split(", "))), now
