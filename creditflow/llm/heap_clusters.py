"""Centroid clustering with a heap of bounds for each cluster.

A vector's *gap* is its distance to the nearest other centroid less that to its own.
When centroids move, all gaps of a cluster shrink by no more than the drift of its
own centroid and the greatest drift among the others. So each cluster keeps one
number, the drift accumulated so far, and a vector enters the cluster's heap under
its gap plus that number: its gap has expired once the cluster's number reaches
the key. A round pops the keys that were reached, rescans these vectors exactly, and
pushes them again; the others are not read.

The heaps are a table in the shared folder. Each round appends a run, sorted by cluster
and key within each file, so that popping is a range read: of every run, the keys above
the drift of the last round and up to the drift of this one. A vector that was
popped before has its key below that range, so old entries need not be deleted.
Sums and counts follow from the vectors that changed their cluster.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from creditflow.llm.held import lean
from creditflow.llm.storage import shared_dir, stored

K, ROUNDS, DIM, SCALE, SALT = 8, 10, 64, 1024, "3"
#: Components reach this far at most, so that squared distances fit into 63 bits.
LARGEST = 1 << 26
#: Up to here float64 products of 64 components are exact.
EXACT = 1 << 22
#: Bounds in float64 are widened by this share.
MARGIN = 1e-9
#: Distances computed at once.
CELLS = 1 << 21

STATE = "id long, x array<int>, was int, cluster int, expires double"


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, dim: int, scale: int) -> DataFrame:
    """(id, x array<int>) of the vectors with dim components, none null or non-finite; an error if one is out of range."""
    v = F.col(vector_col)
    sound = (F.size(v) == dim) & ~F.exists(v, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == F.lit(float("inf"))))
    scaled = lambda c: F.floor(F.lit(float(scale)) * c.cast("double"))
    near = lambda c: F.abs(F.lit(float(scale)) * c.cast("double")) <= float(LARGEST)
    x = F.transform(v, lambda c: F.when(near(c), scaled(c)).otherwise(F.raise_error(F.lit(f"a component is beyond {LARGEST} / {scale}"))).cast("int"))
    return df.where(F.coalesce(sound, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), x.alias("x"))


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centroids, exact."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) < EXACT and x.shape[1] <= 64:
        a, c = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)[None]).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in centroids], axis=1)


def _vectors(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _slices(n: int, k: int) -> Iterator[slice]:
    step = max(1, CELLS // k)
    return (slice(i, i + step) for i in range(0, n, step))


@lean
def _push(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, drift: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Exact scan of (id, x, cluster) rows: their new cluster, and the key under which they enter its heap."""
    for batch in batches:
        x = _vectors(batch.column(1), centroids.shape[1])
        cluster, expires = np.empty(len(x), dtype=np.int32), np.empty(len(x))
        for s in _slices(len(x), len(centroids)):
            d = distances(x[s], centroids)
            own = d.argmin(1)  # the smaller number on a tie
            rows = np.arange(len(d))
            near = np.sqrt(d[rows, own].astype(float))
            d[rows, own] = np.iinfo(np.int64).max
            far = np.sqrt(d.min(1).astype(float)) if len(centroids) > 1 else np.full(len(d), np.inf)
            now = drift[own]
            cluster[s] = own
            expires[s] = np.maximum(now + (far - near) - MARGIN * (near + np.where(np.isinf(far), 0, far) + now), np.nextafter(now, np.inf))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(cluster), pa.array(expires)], ["id", "x", "was", "cluster", "expires"])


@lean
def _settle(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, drift: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Last assignment of (id, x, cluster, expires) rows: expired ones are scanned, others measured against their own centroid only."""
    for batch in batches:
        x, cluster = _vectors(batch.column(1), centroids.shape[1]), batch.column(2).to_numpy().copy()
        distance = np.empty(len(x), dtype=np.int64)
        popped = batch.column(3).to_numpy() <= drift[cluster]
        at = np.flatnonzero(popped)
        for s in _slices(len(at), len(centroids)):
            d = distances(x[at[s]], centroids)
            cluster[at[s]] = d.argmin(1)
            distance[at[s]] = d.min(1)
        rest = np.flatnonzero(~popped)
        for s in _slices(len(rest), x.shape[1]):
            distance[rest[s]] = ((x[rest[s]] - centroids[cluster[rest[s]]]) ** 2).sum(1)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster), pa.array(distance)], ["id", "cluster", "distance"])


def _between(low: np.ndarray, high: np.ndarray | None) -> Column:
    """Entries of each cluster whose key lies above low and up to high: column ranges, which Parquet prunes by."""
    sides = [(F.col("cluster") == c) & (F.col("expires") > float(a)) & (F.lit(True) if high is None else F.col("expires") <= float(high[c])) for c, a in enumerate(low)]
    return reduce(or_, sides)


@lean
def _moves(batches: Iterator[pa.RecordBatch], k: int, dim: int) -> Iterator[pa.RecordBatch]:
    """Rows and component sums that each cluster gains by the vectors of (x, was, cluster) rows: one row a cluster and task."""
    n, sums = np.zeros(k, dtype=np.int64), np.zeros((k, dim), dtype=np.int64)
    for batch in batches:
        x = _vectors(batch.column(0), dim)
        for column, sign in ((batch.column(1), -1), (batch.column(2), 1)):
            rows = np.flatnonzero(column.is_valid())
            home = column.drop_null().to_numpy()
            n += sign * np.bincount(home, minlength=k)
            np.add.at(sums, home, sign * x[rows])
    yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(np.column_stack([n, sums]).tolist(), pa.list_(pa.int64()))], ["cluster", "gain"])


def _changes(run: DataFrame, k: int, dim: int) -> np.ndarray:
    """k rows of (rows, component sums) to add for the vectors that changed their cluster in a run."""
    moved = run.where("was is null or was <> cluster").select("x", "was", "cluster")
    gains = moved.mapInArrow(lambda b: _moves(b, k, dim), "cluster int, gain array<long>").select("cluster", F.posexplode("gain").alias("i", "gain"))
    out = np.zeros((k, dim + 1), dtype=np.int64)
    for c, i, gain in gains.groupBy("cluster", "i").agg(F.sum("gain")).collect():  # k * (dim + 1) rows
        out[c, i] = gain
    return out


def first_centroids(vectors: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The k vectors whose SHA-256 of salt:id is smallest; equal ids by their components, null ids last."""
    address = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256)
    return [r["x"] for r in vectors.select(address.alias("address"), "x").orderBy(F.asc_nulls_last("address"), "x").limit(k).collect()]


def cluster(df: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, salt: str = SALT, id_col: str = "vec_id", vector_col: str = "embedding", log: list | None = None) -> tuple[DataFrame, list[list[int]]]:
    """((id, cluster, distance), centroids): Lloyd's rounds in integers, from hashed starts.

    Components are floor(scale * x). Each round assigns every vector to its nearest
    centroid (squared distance; ties: smaller number) and replaces non-empty
    centroids by floor(sum / count). log, if given, gets the vectors scanned in each round.

    Defined cases: vectors that are null, of another size, or hold null or
    non-finite components take no part; a component whose scaled value is beyond
    2**26 is an error; repeated rows count each; a null id is kept (and starts a
    centroid only if too few others are there); fewer than k vectors give as many
    centroids; an empty table gives no row; other columns do not matter.
    """
    vectors = integer_vectors(df, id_col, vector_col, dim, scale)
    spark, centroids = df.sparkSession, first_centroids(vectors, k, salt)
    empty = spark.createDataFrame([], f"{id_col} long, cluster int, distance long")
    if not centroids:
        return empty, []
    totals = np.zeros((len(centroids), dim + 1), dtype=np.int64)
    before = drift = np.zeros(len(centroids))
    heaps = f"{shared_dir(spark)}/heaps-{uuid.uuid4().hex}"
    live = lambda low, high=None: spark.read.schema(f"{STATE}, run int").parquet(heaps).where(_between(low, high))
    for round_ in range(rounds):
        if round_ and (drift == before).all():  # nothing moved, so nothing expires from here on
            break
        popped = live(before, drift).select("id", "x", "cluster") if round_ else vectors.withColumn("cluster", F.lit(None).cast("int"))
        at = np.array(centroids, dtype=np.int64)
        run = popped.mapInArrow(lambda b, at=at, now=drift: _push(b, at, now), STATE)
        run.sortWithinPartitions("cluster", "expires").write.parquet(f"{heaps}/run={round_}")
        run = spark.read.schema(STATE).parquet(f"{heaps}/run={round_}")
        if log is not None:
            log.append(run.count())
        totals += _changes(run, len(centroids), dim)
        moved = [[s // n for s in total] if n else old for old, (n, *total) in zip(centroids, totals.tolist(), strict=True)]
        step = np.array([sum((a - b) ** 2 for a, b in zip(x, y, strict=True)) ** 0.5 for x, y in zip(centroids, moved, strict=True)])
        others = np.array([max((s for j, s in enumerate(step) if j != c), default=0.0) for c in range(len(step))])
        before, drift, centroids = drift, drift + (step + others) * (1 + MARGIN), moved
    at = np.array(centroids, dtype=np.int64)
    rows = live(before).select("id", "x", "cluster", "expires").mapInArrow(lambda b: _settle(b, at, drift), "id long, cluster int, distance long")
    return rows.withColumnRenamed("id", id_col), centroids


def op13_heap_clusters(spark, sf_dir: str) -> DataFrame:
    rows, centroids = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    rows = stored(rows, "clusters")
    inertia = dict(rows.groupBy("cluster").agg(F.sum("distance")).collect())  # a row for each cluster
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    of = lambda values, kind: F.get(F.array(*map(F.lit, values)).cast(f"array<{kind}>"), F.col("cluster"))
    return rows.select("vec_id", "cluster", "distance", of([inertia.get(c, 0) for c in range(len(names))], "bigint").alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("long").alias("inertia"), of(names, "string").alias("centroid_sha256"))


def _oracle() -> str:
    """Plain rounds over all vectors."""
    rounds = []
    for r in range(ROUNDS + 1):
        rounds.append(f"""d{r} AS MATERIALIZED (SELECT r, c.c, list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{r} c),
a{r} AS MATERIALIZED (SELECT r, arg_min(c, d * {K} + c)::INT AS c, min(d) AS d FROM d{r} GROUP BY r)""")
        if r < ROUNDS:
            rounds.append(f"""m{r} AS (SELECT c, i, CASE WHEN sum(x[i]) >= 0 THEN sum(x[i])::HUGEINT // count(*) ELSE -((count(*) - 1 - sum(x[i])::HUGEINT) // count(*)) END AS x FROM (SELECT a.c, v.x, unnest(range(1, {DIM + 1})) AS i FROM a{r} a JOIN v USING (r)) GROUP BY c, i),
c{r + 1} AS MATERIALIZED (SELECT o.c, coalesce(n.x, o.x) AS x FROM c{r} o LEFT JOIN (SELECT c, list(x::BIGINT ORDER BY i) AS x FROM m{r} GROUP BY c) n USING (c))""")
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor({SCALE} * e::DOUBLE)::BIGINT) AS x FROM embeddings
      WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {DIM}),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('{SALT}:' || vec_id), x) - 1)::INT AS c, x FROM v ORDER BY c LIMIT {K}),
{", ".join(rounds)},
i AS (SELECT c, sum(d) AS s FROM a{ROUNDS} GROUP BY c)
SELECT vec_id, a.c AS cluster, a.d AS distance, i.s::BIGINT AS cluster_inertia, (SELECT sum(s) FROM i)::BIGINT AS inertia, sha256(array_to_string(f.x, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN v USING (r) JOIN i USING (c) JOIN c{ROUNDS} f USING (c)
"""


ORACLE_SQL = _oracle()
