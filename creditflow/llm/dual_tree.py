"""Exact top-k inner products by dual cover-tree search.

The upper tree is made in Spark. Its nodes are balls around separated centres
(farthest first over a bounded sample); every vector goes to the nearest centre, and
a node's covering radius is the distance of its farthest vector. For balls around
p and q with radii r and s, no inner product of their points exceeds
<p, q> + r|q| + s|p| + rs.

1. Each node of queries meets the data node of the greatest centre product. The
   k-th scores found there are floors: the worst of a query node is its group's.
2. Pairs of nodes whose bound reaches the floor of the query node remain; only these
   are shuffled, with each query's floor.

Large nodes are dealt into blocks, and a block of queries meets a block of data in
one task. There both sides are indexed down to small leaves (nested balls, each
level halving the radius until points are few), and pairs of nodes are searched
best bound first; a pair is pruned when its bound is below the worst k-th score, or
floor, of the query node's rows. Leaves are scored exactly. The k best of every
block are merged per query. Vectors that lie in all directions alike have no
balls that exclude any other: there every pair of nodes remains, and the search is
the exact product of blocks.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from creditflow.llm.storage import stored

if TYPE_CHECKING:  # only tasks that are given pandas frames load it
    import pandas as pd

#: Rows of a block on either side.
DATA_BLOCK, QUERY_BLOCK = 20_000, 4_000
LEAF = 256
#: Rows from which the upper tree's centres are chosen, centres at most, and rows a node has on average until then.
SAMPLE, NODES, NODE_ROWS = 20_000, 1024, 2_000


class Node:
    __slots__ = ("rows", "centre", "radius", "norm", "children")

    def __init__(self, points: np.ndarray, rows: np.ndarray):
        self.rows, own = rows, points[rows]
        self.centre = own[np.argmin(((own - own.mean(axis=0)) ** 2).sum(axis=1))]  # a cover tree's centres are points
        self.radius = math.sqrt(float(((own - self.centre) ** 2).sum(axis=1).max()))
        self.norm = math.sqrt(float((self.centre**2).sum()))
        self.children: list[Node] = []
        if len(rows) > LEAF and self.radius > 0:
            near = np.full(len(rows), np.inf)
            name = np.zeros(len(rows), dtype=np.int64)
            new, centres = int(((own - self.centre) ** 2).sum(axis=1).argmax()), 0
            while near.max() > (self.radius / 2) ** 2 and centres < 16:  # separated centres that cover at half the radius, 16 at most
                d = ((own - own[new]) ** 2).sum(axis=1)
                closer = d < near
                near[closer], name[closer] = d[closer], centres
                centres += 1
                new = int(near.argmax())
            self.children = [Node(points, rows[name == c]) for c in range(centres) if (name == c).any()] if centres > 1 else []


def search(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of the k best rows for each query (-inf where there are fewer); ties to the smaller id.

    floor: scores below which a query's rows do not matter.
    """
    best = np.full((len(queries), k), -np.inf)
    names = np.full((len(queries), k), np.iinfo(np.int64).max)
    floor = np.full(len(queries), -np.inf) if floor is None else floor
    if not len(queries) or not len(data):
        return best, names
    root = Node(data, np.arange(len(data)))
    reach = queries @ root.centre + root.radius * np.sqrt((queries**2).sum(axis=1))  # of a single query
    asked = np.flatnonzero(_reaches(reach, floor))
    if not len(asked):
        return best, names
    top = Node(queries, asked)
    bound = lambda q, x: float(q.centre @ x.centre) + q.radius * x.norm + x.radius * q.norm + q.radius * x.radius
    heap, tie = [(-bound(top, root), 0, top, root)], 0
    while heap:
        limit, _, q, x = heapq.heappop(heap)
        if not _reaches(-limit, np.maximum(best[q.rows, -1], floor[q.rows]).min()):
            continue
        if not q.children and not x.children:
            scores = queries[q.rows] @ data[x.rows].T
            scores[query_ids[q.rows][:, None] == data_ids[x.rows][None, :]] = -np.inf
            every = np.concatenate([best[q.rows], scores], axis=1)
            label = np.concatenate([names[q.rows], np.broadcast_to(data_ids[x.rows], scores.shape)], axis=1)
            label = np.where(np.isinf(every), np.iinfo(np.int64).max, label)
            order = np.lexsort((label, -every), axis=1)[:, :k]
            best[q.rows], names[q.rows] = np.take_along_axis(every, order, 1), np.take_along_axis(label, order, 1)
            continue
        split_query = bool(q.children) and (not x.children or q.radius >= x.radius)
        for a, b in [(c, x) for c in q.children] if split_query else [(q, c) for c in x.children]:
            tie += 1
            heapq.heappush(heap, (-bound(a, b), tie, a, b))
    return best, names


def _reaches(bound, score):
    """Whether a bound, give or take rounding, is not below a score."""
    return bound + 1e-6 * np.abs(bound) + 1e-6 >= score


def _search_block(pdf: pd.DataFrame, k: int) -> pd.DataFrame:
    import pandas as pd

    asked = pdf["asked"].to_numpy()
    if asked.all() or not asked.any():
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
    side = lambda m: (np.array(pdf["v"][m].tolist(), dtype=np.float64).reshape(int(m.sum()), -1), pdf["id"][m].to_numpy(np.int64))
    queries, query_ids = side(asked)
    data, data_ids = side(~asked)
    floor = pdf["floor"][asked].to_numpy(np.float64)
    best, names = search(queries, query_ids, data, data_ids, k, np.where(np.isnan(floor), -np.inf, floor))
    row, column = np.nonzero(np.isfinite(best))
    return pd.DataFrame({"query_id": query_ids[row], "vec_id": names[row, column], "score": best[row, column].astype(np.int64)})


def separated(points: np.ndarray, most: int) -> np.ndarray:
    """Rows of centres, farthest first, beginning nearest to the mean; no two alike."""
    first = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())
    out, near = [first], ((points - points[first]) ** 2).sum(axis=1)
    while len(out) < most and near.max() > 0:
        out.append(int(near.argmax()))
        near = np.minimum(near, ((points - points[out[-1]]) ** 2).sum(axis=1))
    return points[out]


def _placed(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Each row with its nearest centre and the distance to it."""
    centres: dict[int, np.ndarray] = shared.value
    for batch in batches:
        vectors, size = batch.column(1), batch.column(3).to_numpy()
        node, away = np.zeros(len(size), dtype=np.int32), np.zeros(len(size))
        for d in np.unique(size).tolist():
            mine = np.flatnonzero(size == d)
            points = vectors.take(pa.array(mine)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            around = centres.get(d, np.zeros((1, d)))
            squares = (around**2).sum(axis=1) - 2 * points @ around.T
            node[mine] = squares.argmin(axis=1)
            away[mine] = np.sqrt(((points - around[node[mine]]) ** 2).sum(axis=1))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(node), pa.array(away)], ["id", "v", "q", "d", "node", "away"])


def _bounds(centres: np.ndarray, asked: dict[int, float], held: dict[int, float]) -> np.ndarray:
    """Greatest inner product of any point of each query node (rows: ``asked``, node -> radius) with any of each data node."""
    p, q = centres[list(asked)], centres[list(held)]
    r, s = np.array(list(asked.values()))[:, None], np.array(list(held.values()))[None, :]
    norm = lambda x: np.sqrt((x**2).sum(axis=1))
    return p @ q.T + r * norm(q)[None, :] + s * norm(p)[:, None] + r * s


def _met(placed: DataFrame, floors: DataFrame | None, pairs: list[tuple[int, int, int]], blocks: dict[tuple[int, int], tuple[int, int]], k: int) -> DataFrame:
    """Scores from the given pairs (d, query node, data node); blocks: of queries and of data by (d, node)."""
    rows = [(d, a, b, blocks[d, a][0], blocks[d, b][1]) for d, a, b in pairs]
    pairs = F.broadcast(placed.sparkSession.createDataFrame(rows, "d int, a int, b int, xs int, ys int"))  # NODES ** 2 rows at most
    own = lambda m: F.pmod(F.xxhash64("id"), m).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), m - 1))
    queries = placed.where("q").join(pairs, (placed["d"] == pairs["d"]) & (F.col("node") == F.col("a"))).drop(pairs["d"])
    queries = queries.join(floors, "id", "left") if floors is not None else queries.withColumn("floor", F.lit(None).cast("double"))
    queries = queries.select("d", "a", "b", own(F.col("xs")).alias("x"), every(F.col("ys")).alias("y"), "id", "v", "floor", F.lit(True).alias("asked"))
    data = placed.join(pairs, (placed["d"] == pairs["d"]) & (F.col("node") == F.col("b"))).drop(pairs["d"])
    data = data.select("d", "a", "b", every(F.col("xs")).alias("x"), own(F.col("ys")).alias("y"), "id", "v", F.lit(None).cast("double").alias("floor"), F.lit(False).alias("asked"))
    return queries.unionByName(data).groupBy("d", "a", "b", "x", "y").applyInPandas(lambda pdf: _search_block(pdf, k), "query_id long, vec_id long, score long")


def search_table(rows: DataFrame, k: int, nodes: int | None = None) -> tuple[DataFrame, list, list, int]:
    """rows (id, v, q, d) -> scores of candidates; the pairs of nodes met first and after; and how many pairs there are."""
    spark = rows.sparkSession
    n = rows.count()
    sample = rows.where(F.pmod(F.xxhash64("id", "v"), F.lit(1 << 20)) < math.ceil((1 << 20) * min(1.0, SAMPLE / max(1, n)))).select("d", "v").collect()
    centres = {}
    for d in {r["d"] for r in sample}:
        points = np.array([r["v"] for r in sample if r["d"] == d], dtype=np.float64)
        most = nodes or min(NODES, math.ceil(n * len(points) / len(sample) / NODE_ROWS))
        centres[d] = separated(points, max(1, most))
    shared = spark.sparkContext.broadcast(centres)
    placed = stored(rows.mapInArrow(lambda b: _placed(b, shared), "id long, v array<double>, q boolean, d int, node int, away double"), "placed")
    stats = placed.groupBy("d", "node").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("r"), F.count_if("q").alias("nq"), F.max(F.when(F.col("q"), F.col("away"))).alias("rq")).collect()
    blocks = {(s["d"], s["node"]): (max(1, math.ceil(s["nq"] / QUERY_BLOCK)), max(1, math.ceil(s["n"] / DATA_BLOCK))) for s in stats}
    first, tables, total = [], {}, 0
    for d in {s["d"] for s in stats}:
        asked, held = {s["node"]: s["rq"] for s in stats if s["d"] == d and s["nq"]}, {s["node"]: s["r"] for s in stats if s["d"] == d}
        if not asked:
            continue
        around = centres.get(d, np.zeros((1, d)))
        tables[d] = (list(asked), list(held), _bounds(around, asked, held))
        total += len(asked) * len(held)
        product = around[list(asked)] @ around[list(held)].T
        first += [(d, a, list(held)[int(product[i].argmax())]) for i, a in enumerate(asked)]
    schema = "query_id long, vec_id long, score long"
    if not first:
        return spark.createDataFrame([], schema), [], [], 0
    found = stored(_met(placed, None, first, blocks, k), "found")
    met = set(first)
    rest = [(d, a, b) for d, (asked, held, _) in tables.items() for a in asked for b in held if (d, a, b) not in met]
    if not rest:
        return found, first, [], total
    floors = stored(found.distinct().groupBy("query_id").agg(F.try_element_at(F.sort_array(F.collect_list("score"), asc=False), F.lit(k)).cast("double").alias("floor")).select(F.col("query_id").alias("id"), "floor"), "floors")
    lowest = placed.where("q").select("id", "d", "node").join(floors, "id", "left").groupBy("d", "node").agg(F.min(F.coalesce("floor", F.lit(-math.inf))).alias("f")).collect()
    floor = {(r["d"], r["node"]): r["f"] for r in lowest}
    bound = {(d, a, b): t[i, j] for d, (asked, held, t) in tables.items() for i, a in enumerate(asked) for j, b in enumerate(held)}
    after = [p for p in rest if _reaches(bound[p], floor[p[:2]])]
    return (found.unionByName(_met(placed, floors, after, blocks, k)) if after else found), first, after, total


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best inner products of each query row with all other rows.

    Vectors hold integers (any numeric type). Vectors that are null, empty or
    hold null or non-finite values take no part, nor do null ids; vectors of
    different lengths do not meet; a row is no candidate of a query with the same
    id; repeated rows count once; fewer than k others give fewer rows.
    """
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), is_query.alias("q")).where(F.col("id").isNotNull() & fine & (F.size("v") > 0)).dropDuplicates(["id", "v"])
    found = search_table(stored(rows.select("id", "v", F.coalesce("q", F.lit(False)).alias("q"), F.size("v").alias("d")), "vectors"), k)[0]
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_dual_tree_topk(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: F.floor(F.lit(256) * x.cast("double"))).alias("v"), F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))).alias("fine")).where("fine")
    return top_k(vectors, F.col("vec_id") % 50 == 0, 5, vector_col="v")


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::DOUBLE) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.v, b.v)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
