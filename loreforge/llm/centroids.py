"""Centroid clustering with an annulus search.

Vectors and centroids are whole numbers, so distances, sums and means are exact
and do not depend on how rows are dealt. The centroids are sorted by norm. For a
vector the distance to the centroid next to it in norm is an upper bound; no
centroid whose norm differs from the vector's by more than that can be nearer,
so a binary search cuts out the ring of those that can, and only these are
compared, exactly, those on the ring's edge too.

Centroids (k rows of `dim` numbers, both parameters) go to all executors; each
round is one pass that brings back k sums. Rows never move.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written

#: Components stay below this, so that a squared distance fits 64 bits.
MOST_COMPONENT = 1 << 27
_PAIRS = 1 << 14


@dataclass
class Ring:
    """Centroids (k rows of int64) in the order of their norms."""

    centroids: np.ndarray
    norms: np.ndarray = field(init=False)
    order: np.ndarray = field(init=False)

    def __post_init__(self):
        norms = np.sqrt((self.centroids * self.centroids).sum(1).astype(np.float64))
        self.order = np.argsort(norms, kind="stable")
        self.norms = norms[self.order]

    def between(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end place, in the order of norms, of the centroids that may
        be nearest to each row of x."""
        norm = np.sqrt((x * x).sum(1).astype(np.float64))
        right = np.minimum(np.searchsorted(self.norms, norm), len(self.norms) - 1)
        left = np.maximum(right - 1, 0)
        near = np.where(norm - self.norms[left] <= self.norms[right] - norm, left, right)
        gap = x - self.centroids[self.order[near]]
        reach = np.sqrt((gap * gap).sum(1).astype(np.float64))
        # wider than any rounding of the roots, so that ties on the edge are in
        reach += 1e-9 * (norm + reach) + 1e-6
        return np.searchsorted(self.norms, norm - reach, "left"), np.searchsorted(self.norms, norm + reach, "right")

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid (ties: the smaller) and the squared distance."""
        lo, hi = self.between(x)
        ends = np.cumsum(hi - lo)
        cluster, dist = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
        i = 0
        while i < len(x):
            done = int(ends[i - 1]) if i else 0
            j = max(i + 1, int(np.searchsorted(ends, done + _PAIRS, side="right")))
            n = (hi - lo)[i:j]
            first = ends[i:j] - n - done
            row = np.repeat(np.arange(i, j), n)
            which = self.order[np.arange(len(row)) - np.repeat(first - lo[i:j], n)]
            gap = x[row] - self.centroids[which]
            d = np.einsum("pc,pc->p", gap, gap)
            dist[i:j] = np.minimum.reduceat(d, first)
            which[d > dist[row]] = len(self.norms)
            cluster[i:j] = np.minimum.reduceat(which, first)
            i = j
        return cluster, dist


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    v = batch.column(batch.schema.get_field_index("v"))
    return v.flatten().to_numpy().astype(np.int64).reshape(len(v), -1)


def _sums(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ring, k = Ring(centroids), len(centroids)
        sums, n = np.zeros(centroids.shape, np.int64), np.zeros(k, np.int64)
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch)
            cluster = ring.nearest(x)[0]
            order = np.argsort(cluster, kind="stable")
            found, at = np.unique(cluster[order], return_index=True)
            sums[found] += np.add.reduceat(x[order], at, axis=0)
            n += np.bincount(cluster, minlength=k)
        on = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(on.astype(np.int32)), pa.array(n[on]), pa.array(list(sums[on]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    return run


def _assign(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ring = Ring(centroids)
        for batch in batches:
            if len(batch):
                cluster, dist = ring.nearest(_matrix(batch))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster.astype(np.int32)), pa.array(dist)], ["id", "cluster", "distance"])

    return run


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = 64, scale: int = 64) -> DataFrame:
    """id and v (array<int>): floor(scale * x) of each component, for the vectors
    of exactly `dim` components, none of them null, NaN or infinite. A component
    of MOST_COMPONENT or more is an error."""
    v = F.col(vec_col)
    finite = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform(v, lambda x: F.floor(F.when(F.abs(x.cast("double") * scale) < MOST_COMPONENT - 1, x.cast("double") * scale).otherwise(F.raise_error(F.lit("a component is too large for exact distances")).cast("double"))).cast("int"))
    return vectors.select(F.col(id_col).alias("id"), v.alias(vec_col)).filter(finite).select("id", scaled.alias("v"))


def start(kept: DataFrame, k: int) -> np.ndarray:
    """The k vectors whose ids have the smallest SHA-256 of `1:<id>`, in that order."""
    key = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = kept.select("v", key.alias("key")).orderBy("key", "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


def cluster_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64) -> tuple[DataFrame, np.ndarray]:
    """Returns (per vector, centroids). Per vector: the id, cluster, distance
    (squared), cluster_inertia, inertia and centroid_sha256 of its centroid's
    numbers joined by commas. centroids: k rows of `dim` whole numbers.

    `rounds` times every vector goes to its nearest centroid and each centroid
    that got any becomes their mean, rounded down; then vectors are assigned once
    more. With fewer than k vectors there are as many centroids as vectors.
    Vectors of another length or with a component that is null or not finite are
    left out, so is a null vector. Repeated rows and ids, and null ids, are rows
    of their own; a null id counts as empty text in the choice of the first
    centroids. Equal distances go to the smaller number. Other columns are
    ignored. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    kept = written(whole_vectors(vectors, id_col, vec_col, dim, scale), "op11-vectors")
    centroids = start(kept, k)
    if not len(centroids):
        centroids = np.zeros((1, dim), np.int64)  # no vector will ask
    for _ in range(rounds):
        sums = kept.mapInArrow(_sums(centroids), "cluster int, n long, sums array<long>")
        spread = sums.select("cluster", "n", F.posexplode("sums").alias("j", "s"))
        # k * dim rows
        for r in spread.groupBy("cluster", "j").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect():
            centroids[r.cluster, r.j] = r.s // r.n
    kind = vectors.schema[id_col].dataType.simpleString()
    assigned = written(kept.mapInArrow(_assign(centroids), f"id {kind}, cluster int, distance long"), "op11-assigned")
    inertia = {r.cluster: r.s for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    whole = sum(inertia.values())
    rows = [(c, s, whole, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, s in sorted(inertia.items())]
    per = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(per), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), centroids


def op11_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    return cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))[0]


_DIST = "list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"


def _round(i: int) -> str:
    nearest = f"a{i} AS (SELECT vec_id, v, rid, arg_min(n, (d, n)) AS cluster, min(d) AS d FROM (SELECT vec_id, v, rid, n, {_DIST} AS d FROM kept, c{i}) GROUP BY vec_id, v, rid)"
    if i == 3:
        return nearest
    return f"""{nearest},
m{i} AS (SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS c FROM (
  SELECT cluster, j, sum(v[j])::BIGINT AS s, count(*) AS n FROM a{i}, range(1, 65) r(j) GROUP BY cluster, j) GROUP BY cluster),
c{i + 1} AS (SELECT n, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} ON n = cluster)"""


OP11_SQL = f"""
WITH kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v, row_number() OVER () AS rid FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
),
c0 AS (SELECT row_number() OVER (ORDER BY key, v) - 1 AS n, v AS c FROM (SELECT v, sha256('1:' || coalesce(vec_id::VARCHAR, '')) AS key FROM kept ORDER BY key, v LIMIT 16)),
{", ".join(_round(i) for i in range(4))}
SELECT vec_id, cluster::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a3 JOIN c3 ON n = cluster
"""
