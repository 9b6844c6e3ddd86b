"""Lloyd's clustering of integer vectors, exact, with PCA-rotated filtering.

Every component x becomes floor(scale * x); distances, sums and centroids are
integers from then on, so no result depends on the order of additions.

Filter. The principal axes of all kept vectors rotate the space (mean and
covariance come from one aggregate). Of each vector the leading rotated
coordinates z, as many as hold ``VARIANCE`` of the variance, and the norm r of the
rest are stored. For a centroid with (z', r') the triangle inequality in the
remaining axes gives

    |z - z'|^2 + (r - r')^2  <=  squared distance.

The centroid of least bound is measured exactly; only centroids whose bound
(less a margin far above rounding errors) does not exceed that distance are
verified, in 64-bit integers. Ties go to the smaller centroid number, and since
equal distances survive the filter, the result equals a full search.

Only sums leave a task (one row per cluster), so a cluster may hold any share
of the vectors; k x dims integers go to the driver and back.

Defined results: vectors of another length, with null or non-finite components,
or with an integer beyond +-2^27 (its squared distances would not fit 64 bits)
are not kept. A null ``vec_id`` hashes as empty text; repeated rows are separate
vectors and ties of the initial order go to the smaller vector. Fewer kept
vectors than k: that many centroids; none: no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, table

K, ROUNDS, SCALE, DIMS, SEED = 16, 3, 64, 64, 1
VARIANCE = 0.8
LARGEST = 1 << 27
MARGIN = 1e-9


def kept_vectors(df: DataFrame, dims: int = DIMS, scale: int = SCALE, column: str = "embedding") -> DataFrame:
    """``(vec_id, q)``: the usable vectors as integers."""
    large = F.lit(float(LARGEST))
    whole = F.transform(F.col(column), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    usable = (F.size(column) == dims) & F.forall(
        column, lambda x: x.isNotNull() & ~F.isnan(x) & F.abs(F.lit(float(scale)) * x.cast("double")).between(F.lit(0.0), large))
    return df.filter(F.coalesce(usable, F.lit(False))) \
        .select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(whole, lambda x: x.cast("int")).alias("q"))


def _vectors(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.int64)


def principal_axes(vectors: DataFrame, dims: int):
    """Mean of all vectors, orthonormal axes, strongest first, and the variance along each."""
    def moments(batches):
        total = np.zeros((dims + 1, dims + 1))
        for batch in batches:
            if batch.num_rows:
                x = np.column_stack([_vectors(batch.column("q")).astype(float), np.ones(batch.num_rows)])
                total += x.T @ x
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()),
                                          pa.array(total.ravel())], names=["i", "j", "s"])

    total = np.zeros((dims + 1, dims + 1))
    for r in vectors.select("q").mapInArrow(moments, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        total[r["i"], r["j"]] = r["s"]
    n = max(total[-1, -1], 1.0)
    mean = total[-1, :-1] / n
    values, axes = np.linalg.eigh(total[:-1, :-1] / n - np.outer(mean, mean))
    order = np.argsort(-values)
    return mean, axes[:, order], np.maximum(values[order], 0.0)


def leading(variance: np.ndarray, share: float) -> int:
    """The least number of axes that hold ``share`` of the variance."""
    return int(min(np.searchsorted(np.cumsum(variance), share * variance.sum()) + 1, len(variance)))


def rotated(x: np.ndarray, mean: np.ndarray, axes: np.ndarray, lead: int):
    y = x - mean
    z = y @ axes[:, :lead]
    return z, np.sqrt(np.maximum((y * y).sum(1) - (z * z).sum(1), 0.0))


def with_rotation(vectors: DataFrame, mean, axes, lead: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            z, r = rotated(_vectors(batch.column("q")), mean, axes, lead)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * lead, pa.int32()), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("q"), flat, pa.array(r)],
                                             names=["vec_id", "q", "z", "rest"])

    return vectors.mapInArrow(run, "vec_id long, q array<int>, z array<double>, rest double")


def nearest(q, z, rest, centroids, z_c, rest_c):
    """Nearest centroid of every vector, its squared distance, and how many were verified."""
    bound = ((z[:, None, :] - z_c[None]) ** 2).sum(2) + (rest[:, None] - rest_c[None]) ** 2
    size = (z * z).sum(1) + rest * rest
    slack = MARGIN * (size[:, None] + ((z_c * z_c).sum(1) + rest_c * rest_c)[None] + 1.0)
    first = bound.argmin(1)
    best = ((q - centroids[first]) ** 2).sum(1)
    survive = bound - slack <= best[:, None].astype(float)
    cluster, distance = np.full(len(q), len(centroids)), np.full(len(q), np.iinfo(np.int64).max)
    for c in range(len(centroids)):          # ascending, so that ties keep the smaller number
        rows = np.flatnonzero(survive[:, c])
        d = ((q[rows] - centroids[c]) ** 2).sum(1)
        closer = d < distance[rows]
        cluster[rows[closer]], distance[rows[closer]] = c, d[closer]
    return cluster, distance, survive.sum(1)


def _assigner(centroids, mean, axes, lead):
    z_c, rest_c = rotated(centroids, mean, axes, lead)

    def assign(batch):
        q, z = _vectors(batch.column("q")), batch.column("z").flatten().to_numpy().reshape(batch.num_rows, -1)
        return q, *nearest(q, z, batch.column("rest").to_numpy(), centroids, z_c, rest_c)

    return assign


def moved(points: DataFrame, centroids, mean, axes, lead: int):
    """One round: the floors of the members' means; empty clusters stay."""
    assign = _assigner(centroids, mean, axes, lead)
    k, dims = centroids.shape

    def sums(batches):
        total, count = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            if batch.num_rows:
                q, cluster, _, _ = assign(batch)
                np.add.at(total, cluster, q)
                count += np.bincount(cluster, minlength=k)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(count[some]),
                                          pa.array(list(total[some]), pa.list_(pa.int64()))], names=["cluster", "n", "s"])

    parts = points.select("q", "z", "rest").mapInArrow(sums, "cluster int, n long, s array<long>")
    out = centroids.copy()
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(dims)]).alias("s")).collect():
        out[r["cluster"]] = [s // r["n"] for s in r["s"]]
    return out


def clustered(df: DataFrame, k: int = K, rounds: int = ROUNDS, scale: int = SCALE, dims: int = DIMS,
              variance: float = VARIANCE, seed: int = SEED):
    """``(assignment, centroids)``: one row ``(vec_id, cluster, distance, verified)`` per
    kept vector, written once, and the final integer centroids (k x dims)."""
    vectors = kept_vectors(df, dims, scale)
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    start = vectors.orderBy(name, "q").limit(k).collect()
    schema = "vec_id long, cluster int, distance long, verified int"
    if not start:
        return df.sparkSession.createDataFrame([], schema), np.zeros((0, dims), np.int64)
    centroids = np.array([r["q"] for r in start], np.int64)
    mean, axes, spread = principal_axes(vectors, dims)
    lead = leading(spread, variance)
    points = staged(with_rotation(vectors, mean, axes, lead), "rotated-vectors")
    for _ in range(rounds):
        centroids = moved(points, centroids, mean, axes, lead)
    assign = _assigner(centroids, mean, axes, lead)

    def run(batches):
        for batch in batches:
            _, cluster, distance, verified = assign(batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(distance), pa.array(verified, pa.int32())],
                names=["vec_id", "cluster", "distance", "verified"])

    return staged(points.mapInArrow(run, schema), "clusters"), centroids


def op12_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    rows, centroids = clustered(table(spark, sf_dir, "embeddings"))
    found = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("d")).collect()
    of = {r["cluster"]: int(r["d"]) for r in found}      # at most K rows
    every = sum(of.values())
    facts = spark.createDataFrame(
        [(c, of.get(c, 0), every, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest())
         for c, row in enumerate(centroids.tolist())],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.drop("verified").join(F.broadcast(facts), "cluster") \
        .select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    parts = [f"""kept AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE len(embedding) = {DIMS}
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x) AND abs({SCALE} * CAST(x AS DOUBLE)) <= {LARGEST})) = {DIMS})""",
             f"""c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')), q) - 1 AS c, q FROM kept
  QUALIFY c < {K})"""]
    for i in range(ROUNDS + 1):
        parts.append(f"""a{i} AS (
  SELECT r, any_value(vec_id) AS vec_id, any_value(kq) AS q, min(struct_pack(d := d, c := c)) AS best FROM (
    SELECT k.r, k.vec_id, k.q AS kq, c.c,
           list_sum(list_transform(list_zip(k.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
    FROM kept k, c{i} c) GROUP BY r)""")
        if i < ROUNDS:
            parts.append(f"""c{i + 1} AS (
  SELECT o.c, coalesce(n.q, o.q) AS q FROM c{i} o LEFT JOIN (
    SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS q FROM (
      SELECT best.c AS c, i, sum(q[i]) AS s, count(*) AS n
      FROM a{i}, range(1, {DIMS + 1}) AS t(i) GROUP BY ALL) GROUP BY c) n ON n.c = o.c)""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(best.c AS INTEGER) AS cluster, CAST(best.d AS BIGINT) AS distance,
  CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(f.q, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} f ON f.c = best.c"""


OP12_SQL = _sql()
