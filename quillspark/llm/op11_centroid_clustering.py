"""Centroid clustering of integer vectors with bounds from an n-simplex projection.

Distances of every vector to ``PIVOTS`` fixed pivots are taken once and kept.  The pivots are the corners of a simplex;
a vector's distances to them place it as the apex over that base: coordinates in the space that the pivots span, and its
height above it.  The Euclidean distance of two apexes is a lower bound of the distance of the vectors, and with the
height of one turned round an upper bound.  In each round the few centroids are placed alike; of a vector's centroids,
those whose lower bound exceeds the least upper bound are out, and the rest are compared by exact integer distances.
Bounds are floating-point numbers, so a margin that is far above their error is left.

Rounds read the written vectors and return, for each task, sums by cluster and component, which Spark adds up; only sums
of clusters and centroids reach the driver.  Sums are kept in limbs of ``LIMB`` bits, so they are exact at any size.

Defined results: vectors with another number of components, a null or non-finite one (or one that is infinite when it is
scaled) and null vectors are left out; rows that repeat a vec_id are vectors of their own; equal hashes go by the components; a null vec_id is no first centroid and
its row is assigned like any other; with fewer vectors than centroids each is one; a table without vectors gives no rows;
a distance, or a sum of distances, that no long holds is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import read, written

SIZE, CENTROIDS, ROUNDS, SALT, SCALE = 64, 40, 5, "2:", 256
PIVOTS = 32
#: A pivot must be that share of the largest distance away from the space of those before it.
INDEPENDENT = 1e-2
#: Margin of the bounds, as a share of the squares of the lengths involved.
MARGIN = 1e-6
#: Components up to here have exact 64-bit distances.
NARROW = 1 << 27
LIMB = 30
#: Pairs of vectors and centroids compared at a time.
PAIRS = 1 << 15


def integers(column: pa.Array, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """(rows, components): floor(256 x) of the vectors that have ``size`` finite components, as whole doubles."""
    lists = column.cast(pa.large_list(pa.float64()))
    lengths = np.diff(lists.offsets.to_numpy())
    if lists.null_count:
        lengths = np.where(lists.is_valid().to_numpy(zero_copy_only=False), lengths, -1)
    rows = np.flatnonzero(lengths == size)
    flat = lists.take(pa.array(rows)).flatten()
    values = np.floor(SCALE * flat.to_numpy(zero_copy_only=False).reshape(-1, size))  # nulls are nan here
    fine = np.isfinite(values).all(axis=1)
    return rows[fine], values[fine]


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(-1, size)


def whole(rows: list[list[int]]) -> np.ndarray:
    """The numbers as 64-bit integers where distances between such rows are, as Python's own else."""
    return np.array(rows, dtype=np.int64 if all(-NARROW <= v <= NARROW for r in rows for v in r) else object)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances, row by row, of whole doubles and whole numbers; Python integers where 64 bits may not do."""
    if not len(x) or (y.dtype != object or abs(y).max() <= NARROW) and np.abs(x).max() <= NARROW:
        d = x.astype(np.int64) - y.astype(np.int64)
        return np.einsum("ij,ij->i", d, d)
    return np.array([sum((int(a) - int(b)) ** 2 for a, b in zip(p, q, strict=True)) for p, q in zip(x, y, strict=True)], dtype=object)


def triangle(gram: np.ndarray) -> np.ndarray:
    """The lower triangular matrix whose product with its transpose is ``gram``.

    Here and below, sums go without BLAS, whose threads do not always survive the forks of Python workers.
    """
    out = np.zeros_like(gram)
    for i in range(len(gram)):
        for j in range(i):
            out[i, j] = (gram[i, j] - (out[i, :j] * out[j, :j]).sum()) / out[j, j]
        out[i, i] = np.sqrt(gram[i, i] - (out[i, :i] ** 2).sum())
    return out


@dataclass
class Simplex:
    """The pivots and the triangular coordinates of their simplex, the first one in the origin."""

    pivots: np.ndarray
    base: np.ndarray

    @classmethod
    def of(cls, points: np.ndarray, n: int = PIVOTS) -> Simplex:
        """Pivots among the points, each the farthest from the space that those before span."""
        chosen, rest = [0], (points - points[0]) / max(1.0, np.abs(points).max())
        far = (rest**2).sum(axis=1).max()
        while len(chosen) < n and far > 0:
            away = (rest**2).sum(axis=1)
            k = int(away.argmax())
            if away[k] <= INDEPENDENT**2 * far:
                break
            axis = rest[k] / np.sqrt(away[k])
            rest = rest - (rest * axis).sum(axis=1)[:, None] * axis
            chosen.append(k)
        pivots = points[chosen]
        between = ((pivots[:, None] - pivots) ** 2).sum(axis=2)
        gram = (between[0, 1:, None] + between[0, 1:] - between[1:, 1:]) / 2
        return cls(pivots, triangle(gram))

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Squared distances to the pivots."""
        return np.stack([((x - p) ** 2).sum(axis=1) for p in self.pivots], axis=1) if len(x) else np.zeros((0, len(self.pivots)))

    def apex(self, distances: np.ndarray) -> np.ndarray:
        """Coordinates from squared distances to the pivots; the height comes last."""
        own = distances[:, :1]
        if not len(self.base):
            return np.sqrt(own)
        between = ((self.pivots[1:] - self.pivots[0]) ** 2).sum(axis=1)
        flat = (own + between - distances[:, 1:]) / 2
        for i, row in enumerate(self.base):
            flat[:, i] = (flat[:, i] - np.einsum("ij,j->i", flat[:, :i], row[:i])) / row[i]
        height = np.sqrt(np.maximum(0, own[:, 0] - (flat**2).sum(axis=1)))
        return np.column_stack((flat, height))


def nearest(x: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, simplex: Simplex) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance, exact comparisons) of the vectors, whose apexes are given."""
    over = simplex.apex(simplex.distances(centroids.astype(np.float64)))
    spread = MARGIN * ((apexes**2).sum(axis=1)[:, None] + (over**2).sum(axis=1) + 1)
    flat = (apexes[:, :-1] ** 2).sum(axis=1)[:, None] + (over[:, :-1] ** 2).sum(axis=1) - 2 * np.einsum("ik,jk->ij", apexes[:, :-1], over[:, :-1])
    lower = flat + (apexes[:, -1:] - over[:, -1]) ** 2 - spread
    upper = (flat + (apexes[:, -1:] + over[:, -1]) ** 2 + spread).min(axis=1)
    row, c = np.nonzero(lower <= upper[:, None])
    parts = [squared(x[row[k : k + PAIRS]], centroids[c[k : k + PAIRS]]) for k in range(0, len(row), PAIRS)]
    wide = any(p.dtype == object for p in parts)
    exact = np.concatenate([p.astype(object) if wide else p for p in parts]) if parts else np.empty(0, np.int64)
    first = np.searchsorted(row, np.arange(len(x)))
    least = np.minimum.reduceat(exact, first) if len(x) else exact
    hit = np.flatnonzero(exact == least[row])
    return c[hit[np.searchsorted(row[hit], np.arange(len(x)))]], least, len(row)


def _limbs(total: int) -> Iterator[tuple[int, int]]:
    """The number in limbs of LIMB bits, of which the last one has the sign."""
    k = 0
    while total not in (0, -1) or k == 0:
        low = total & ((1 << LIMB) - 1)
        yield k, low
        total, k = total >> LIMB, k + 1
    if total:
        yield k, total


def _sums(x: np.ndarray, cluster: np.ndarray) -> Iterator[tuple[int, int, list[int]]]:
    """(cluster, vectors, exact sums of the components)."""
    narrow = not len(x) or np.abs(x).max() <= NARROW
    for c in np.unique(cluster):
        own = x[cluster == c]
        yield int(c), len(own), own.astype(np.int64).sum(axis=0).tolist() if narrow else [sum(map(int, column)) for column in own.T]


def _moved(vectors: DataFrame, centroids: np.ndarray, simplex: Simplex) -> np.ndarray:
    """The centroids after one round."""
    size = centroids.shape[1]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = [0] * len(centroids), [[0] * size for _ in centroids]
        for b in batches:
            x = _matrix(b.column(0), size)
            for c, n, own in _sums(x, nearest(x, simplex.apex(_matrix(b.column(1), len(simplex.pivots))), centroids, simplex)[0]):
                counts[c] += n
                sums[c] = [s + t for s, t in zip(sums[c], own, strict=True)]
        rows = [(c, -1, 0, n) for c, n in enumerate(counts) if n] + [(c, d, k, v) for c, n in enumerate(counts) if n for d, s in enumerate(sums[c]) for k, v in _limbs(s)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int32() if i < 3 else pa.int64()) for i in range(4)], ["c", "d", "limb", "v"])

    parts = vectors.select("x", "distances").mapInArrow(partial, "c int, d int, limb int, v long")
    found = parts.groupBy("c", "d", "limb").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()  # a row a centroid, component and limb
    total: dict[tuple[int, int], int] = {}
    for r in found:
        total[r.c, r.d] = total.get((r.c, r.d), 0) + (int(r.v) << (LIMB * r.limb))
    return whole([[total[c, d] // total[c, -1] for d in range(size)] if (c, -1) in total else own for c, own in enumerate(centroids.tolist())])


def clusters(df: DataFrame, key: str, vector: str, size: int = SIZE, n: int = CENTROIDS, rounds: int = ROUNDS) -> DataFrame:
    """key, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that is kept."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, x = integers(b.column(1), size)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array([v.tobytes() for v in x], pa.binary())], ["k", "x"])

    kept = df.select(F.col(key).cast("long").alias("k"), F.col(vector).alias("e")).mapInArrow(keep, "k long, x binary")
    kept = written(kept, "vectors")
    order = F.sha2(F.concat(F.lit(SALT), F.col("k").cast("string")), 256)
    first = kept.where("k is not null").select(order.alias("h"), "x").orderBy("h", "x").limit(n).collect()  # n rows
    if not first:
        return kept.where("false").select(F.col("k").alias(key), F.lit(0).alias("cluster"), *(F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")), F.lit("").alias("centroid_sha256"))
    points = np.array([np.frombuffer(bytes(r.x), np.float64) for r in first])
    simplex, centroids = Simplex.of(np.unique(points, axis=0)), whole([[int(v) for v in p] for p in points])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            far = simplex.distances(_matrix(b.column(1), size))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([v.tobytes() for v in far], pa.binary())], ["k", "x", "distances"])

    vectors = written(kept.mapInArrow(measure, "k long, x binary, distances binary"), "distances")
    for _ in range(rounds):
        centroids = _moved(vectors, centroids, simplex)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), size)
            c, d, _ = nearest(x, simplex.apex(_matrix(b.column(2), len(simplex.pivots))), centroids, simplex)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(c.astype(np.int32)), pa.array([v if v < 1 << 63 else None for v in d.tolist()], pa.int64())], ["k", "cluster", "distance"])

    assigned = written(vectors.select("k", "x", "distances").mapInArrow(assign, "k long, cluster int, distance long"), "assigned")
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    every = F.count("distance") == F.count(F.lit(1))
    by_cluster = assigned.groupBy("cluster").agg(F.when(every, exact).alias("d")).collect()  # a row a centroid
    held = [r.d for r in by_cluster]
    inertia = None if None in held else sum(held)
    fit = lambda v: None if v is None or v >= 1 << 63 else int(v)
    names = [sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    rows = [(r.cluster, fit(r.d), fit(inertia), names[r.cluster]) for r in by_cluster]
    sums = df.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(sums), "cluster").select(F.col("k").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all embeddings after five rounds from 40 of them."""
    return clusters(read(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def _sql(rounds: int = ROUNDS) -> str:
    """Assignment and means by components in rows, round after round."""
    parts = [
        "kept as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as x from embeddings"
        " where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64)",
        "part as (select r, unnest(range(64)) as d, unnest(x) as v from kept)",
        "c0 as (select c, unnest(range(64)) as d, unnest(x) as v from (select row_number() over (order by sha256('2:' || vec_id), x) - 1 as c, x from kept where vec_id is not null qualify c < 40))",
    ]
    for k in range(rounds + 1):
        parts.append(f"d{k} as (select p.r, c.c, sum((p.v - c.v) * (p.v - c.v))::bigint as dist from part p join c{k} c on c.d = p.d group by p.r, c.c)")
        parts.append(f"a{k} as (select r, c, dist from d{k} qualify row_number() over (partition by r order by dist, c) = 1)")
        if k < rounds:
            mean = "(sum(p.v) - ((sum(p.v) % count(*)) + count(*)) % count(*)) // count(*)"
            parts.append(f"m{k} as (select a.c, p.d, {mean} as v from a{k} a join part p on p.r = a.r group by a.c, p.d)")
            parts.append(f"c{k + 1} as (select o.c, o.d, coalesce(m.v, o.v)::bigint as v from c{k} o left join m{k} m on m.c = o.c and m.d = o.d)")
    return f"""with {", ".join(parts)}
select k.vec_id, a.c::integer as cluster, a.dist as distance, sum(a.dist) over (partition by a.c)::bigint as cluster_inertia, sum(a.dist) over ()::bigint as inertia, n.centroid_sha256
from a{rounds} a join kept k on k.r = a.r join (select c, sha256(string_agg(v::varchar, ',' order by d)) as centroid_sha256 from c{rounds} group by c) n on n.c = a.c"""


#: Distances of all vectors to all centroids, by components.
ORACLE_SQL = {"op11_centroid_clustering": _sql()}
