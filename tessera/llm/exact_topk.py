"""Exact top-k by inner product with a KD-tree per shard.

Vectors are dealt to shards by space: a coarse tree of median splits of a bounded sample
gives cells, and a cell that holds more than a shard's rows is split by a hash.  Each
shard's own tree is built once, by median splits with the tight bounding box of every
node, and stored.  A query walks a tree best first: the bound of a box is the greatest
inner product that a point in it can have.  First each query searches its own shard; its
kth score there travels with it, and it goes on only to those shards whose root box can
reach that score, where boxes that can't are skipped.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

_FOUND = "query_id long, vec_id long, score long"
_CHUNK = 1024  # root boxes that a task looks at together


class KDTree:
    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = 64):
        """``points``: rows of integers in float64."""
        self.ids, self.points = ids, points
        self.start, self.end, self.left, self.right, lo, hi = [], [], [], [], [], []
        order = np.arange(len(ids))
        todo = [(0, len(ids), -1, False)]
        while todo:
            a, b, parent, is_right = todo.pop()
            node = len(self.start)
            if parent >= 0:
                (self.right if is_right else self.left)[parent] = node
            at = points[order[a:b]]
            lo.append(at.min(0))
            hi.append(at.max(0))
            self.start.append(a)
            self.end.append(b)
            self.left.append(-1)
            self.right.append(-1)
            if b - a > leaf and (hi[-1] > lo[-1]).any():
                axis, mid = int(np.argmax(hi[-1] - lo[-1])), (b - a) // 2
                part = np.argpartition(at[:, axis], mid)
                order[a:b] = order[a:b][part]
                todo += [(a + mid, b, node, True), (a, a + mid, node, False)]
        self.ids, self.points = ids[order], points[order]
        self.lo, self.hi = np.array(lo), np.array(hi)

    def packed(self) -> bytes:
        """As it is stored: points as small integers where they fit."""
        small = self.points.astype(np.int16) if np.abs(self.points).max(initial=0) < 1 << 15 else self.points
        return pickle.dumps({**vars(self), "points": small})

    @classmethod
    def unpacked(cls, raw: bytes) -> KDTree:
        out = object.__new__(cls)
        vars(out).update(pickle.loads(raw))
        out.points = out.points.astype(np.float64)
        return out

    def search(self, qids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray):
        """For each query the rows of its k best with a score of at least ``floor``."""
        bounds = np.maximum(queries, 0) @ self.hi.T + np.minimum(queries, 0) @ self.lo.T
        for i, q in enumerate(queries):
            kth, bound = floor[i], bounds[i]
            best_s, best_i = np.empty(0), np.empty(0, np.int64)
            heap = [(-bound[0], 0)]
            while heap:
                b, node = heapq.heappop(heap)
                if -b < kth:
                    break
                if self.left[node] >= 0:
                    for child in (self.left[node], self.right[node]):
                        if bound[child] >= kth:
                            heapq.heappush(heap, (-bound[child], child))
                    continue
                a, e = self.start[node], self.end[node]
                score = self.points[a:e] @ q
                ok = (score >= kth) & (self.ids[a:e] != qids[i])
                if ok.any():
                    best_s, best_i = np.concatenate([best_s, score[ok]]), np.concatenate([best_i, self.ids[a:e][ok]])
                    if len(best_s) > k:
                        top = np.lexsort((best_i, -best_s))[:k]
                        best_s, best_i = best_s[top], best_i[top]
                    if len(best_s) == k:
                        kth = max(kth, best_s.min())
            yield best_i, best_s


def _matrix(column) -> np.ndarray:
    """floor(1024 x) as float64, in which sums of products below 2**53 are exact."""
    values = column.combine_chunks()
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = np.floor(flat * 1024.0).reshape(len(values), -1) if len(values) else np.empty((0, 0))
    if m.size and m.shape[1] * float(np.abs(m).max()) ** 2 >= 2.0**53:
        raise ValueError("components are too large for exact integer scores")
    return m


def _table(qids, parts):
    import pyarrow as pa

    n = [len(i) for i, _ in parts]
    return pa.table(
        {
            "query_id": pa.array(np.repeat(qids, n).astype(np.int64)),
            "vec_id": pa.array(np.concatenate([i for i, _ in parts] or [np.empty(0)]).astype(np.int64)),
            "score": pa.array(np.concatenate([s for _, s in parts] or [np.empty(0)]).astype(np.int64)),
        }
    )


def coarse_tree(points: np.ndarray, cells: int) -> list[tuple[int, float, int, int]]:
    """(axis, value, left, right) of median splits into about ``cells`` cells of eight points
    at least; children below zero are cells, -1 the first of them."""
    nodes: list[list] = []
    made = 0

    def split(at: np.ndarray, want: int) -> int:
        nonlocal made
        spread = np.ptp(points[at], 0) if len(at) else np.zeros(1)
        axis = int(np.argmax(spread))
        value = float(np.median(points[at, axis])) if len(at) else 0.0
        left = points[at, axis] < value if len(at) else np.zeros(0, bool)
        if want < 2 or len(at) < 16 or not left.any() or left.all():
            made += 1
            return -made
        node = len(nodes)
        nodes.append([axis, value, 0, 0])
        nodes[node][2:] = [split(at[left], want // 2), split(at[~left], want - want // 2)]
        return node

    root = split(np.arange(len(points)), cells)
    return [tuple(x) for x in nodes] if root >= 0 else []


def cells_of(tree: list[tuple[int, float, int, int]], points: np.ndarray) -> np.ndarray:
    out = np.zeros(len(points), np.int64)
    todo = [(0, np.arange(len(points)))] if tree else []
    while todo:
        node, at = todo.pop()
        if node < 0:
            out[at] = -node - 1
        elif len(at):
            axis, value, left, right = tree[node]
            low = points[at, axis] < value
            todo += [(left, at[low]), (right, at[~low])]
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = 8192, block_rows: int = 2048, sample_rows: int = 16384) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k greatest integer inner products of each query.

    Components are floor(1024 x).  A query is never its own answer; ties go to the
    smaller id; with fewer than k candidates all are returned.

    * A vector that is null, has a null or non-finite component, or a null id takes no part.
    * Of rows with one id the least vector stands for all.
    * Only vectors of a query's own length are its candidates.
    * Products too large for exact scores raise an error.
    * Empty tables give an empty one.  Columns other than id and vector are left out,
      whatever their names.
    * The coarse tree is fit on the ``sample_rows`` vectors of least hash.  It only says
      which shard a vector is in: all are indexed, and the results are exact.
    """
    import pyarrow as pa

    def valid(df: DataFrame) -> DataFrame:
        v = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id is not null and v is not null")
        v = v.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size("v") > 0))
        return v.groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))

    base = stored(valid(vectors), "vectors")
    asked = stored(valid(queries), "queries")
    n = base.count()
    sample = base.orderBy(F.xxhash64("id"), "id").limit(sample_rows).toArrow()
    dims = sample.column("dim").to_numpy() if n else np.empty(0, np.int64)
    trees = {int(d): coarse_tree(_matrix(sample.filter(pa.array(dims == d)).column("v")), max(1, int(-(-n * (dims == d).mean() // shard_rows)))) for d in np.unique(dims)}
    shared = base.sparkSession.sparkContext.broadcast(trees)  # bounded by the sample

    def cell(batches):
        for batch in batches:
            d, v = batch.column(2).to_numpy(), batch.column(1)
            out = np.zeros(len(d), np.int64)
            for x in np.unique(d):
                at = np.flatnonzero(d == x)
                out[at] = cells_of(shared.value.get(int(x), []), _matrix(pa.chunked_array([v.take(pa.array(at))])))
            yield pa.RecordBatch.from_arrays([batch.column(0), v, batch.column(2), pa.array(out)], ["id", "v", "dim", "cell"])

    def dealt(df: DataFrame) -> DataFrame:
        x = df.mapInArrow(cell, f"id long, v {df.schema['v'].dataType.simpleString()}, dim int, cell long").join(sizes, ["dim", "cell"], "left")
        part = F.pmod(F.xxhash64("id", F.lit(2)), F.greatest(F.coalesce("parts", F.lit(1)), F.lit(1)))
        return x.select("id", "v", "dim", F.shiftleft("cell", 20).bitwiseOR(part).alias("shard"))

    sizes = base.mapInArrow(cell, f"id long, v {base.schema['v'].dataType.simpleString()}, dim int, cell long").groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / shard_rows).alias("parts"))
    sizes = stored(sizes, "cells")

    def build(table):
        tree = KDTree(table.column("id").to_numpy(), _matrix(table.column("v")))
        row = {"dim": [table.column("dim")[0].as_py()], "shard": [table.column("shard")[0].as_py()], "lo": [tree.lo[0].tolist()], "hi": [tree.hi[0].tolist()], "tree": [tree.packed()]}
        return pa.table(row, pa.schema([("dim", pa.int32()), ("shard", pa.int64()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())), ("tree", pa.binary())]))

    built = stored(dealt(base).groupBy("dim", "shard").applyInArrow(build, "dim int, shard long, lo array<double>, hi array<double>, tree binary"), "trees")
    ask = stored(dealt(asked).withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(max(1, -(-asked.count() // block_rows)))).cast("int")), "asked")

    def walk(key, left, right):
        if not left.num_rows or not right.num_rows:
            return _table(np.empty(0, np.int64), [])
        tree = KDTree.unpacked(left.column("tree")[0].as_py())
        qids = right.column("id").to_numpy()
        floor = right.column("kth").to_numpy(zero_copy_only=False).astype(np.float64)
        floor = np.where(np.isnan(floor), -np.inf, floor)
        return _table(qids, list(tree.search(qids, _matrix(right.column("v")), k, floor)))

    def meet(who: DataFrame) -> DataFrame:
        """Queries at the trees of their shards; a shard with many blocks of them is read by each."""
        keys = ["dim", "shard", "block"]
        at = built.select("dim", "shard", "tree").join(who.select(*keys).distinct().toDF(*keys), ["dim", "shard"])
        return at.groupBy(*keys).cogroup(who.groupBy(*keys)).applyInArrow(walk, _FOUND)

    home = stored(meet(ask.withColumn("kth", F.lit(None).cast("double"))), "home")
    kth = home.groupBy(F.col("query_id").alias("id")).agg(F.min("score").cast("double").alias("m"), F.count(F.lit(1)).alias("n"))
    carried = stored(ask.join(kth, "id", "left").withColumn("kth", F.when(F.col("n") >= k, F.col("m"))).drop("m", "n"), "carried")
    away = reached(carried, built.select("dim", "shard", "lo", "hi"))
    found = home.union(meet(away.join(carried.drop("shard", "dim"), "id")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def reached(asked: DataFrame, boxes: DataFrame) -> DataFrame:
    """``id, dim, shard``: the shards but its own whose root box can reach a query's kth score.

    Chunks of boxes meet blocks of queries; only ids of what passes go on."""
    import pyarrow as pa

    chunks = max(1, -(-boxes.count() // _CHUNK))
    b = boxes.withColumn("chunk", F.pmod(F.xxhash64("shard"), F.lit(chunks)).cast("int"))
    blocks = asked.select("dim", "block").distinct().toDF("dim", "block")
    q = asked.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    keys = ["dim", "chunk", "block"]

    def pairs(key, left, right):
        if not left.num_rows or not right.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "dim": pa.array([], pa.int32()), "shard": pa.array([], pa.int64())})
        lo, hi = (np.stack([np.asarray(x, np.float64) for x in left.column(c).to_pylist()]) for c in ("lo", "hi"))
        v, shard = _matrix(right.column("v")), left.column("shard").to_numpy()
        kth = right.column("kth").to_numpy(zero_copy_only=False).astype(np.float64)
        bound = np.maximum(v, 0) @ hi.T + np.minimum(v, 0) @ lo.T
        ok = (bound >= np.where(np.isnan(kth), -np.inf, kth)[:, None]) & (right.column("shard").to_numpy()[:, None] != shard)
        i, j = np.nonzero(ok)
        return pa.table({"id": pa.array(right.column("id").to_numpy()[i]), "dim": pa.array(np.full(len(i), key[0].as_py()), pa.int32()), "shard": pa.array(shard[j])})

    return b.join(blocks, "dim").groupBy(*keys).cogroup(q.groupBy(*keys)).applyInArrow(pairs, "id long, dim int, shard long")


def op2_exact_topk(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"), 10)


OP2_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) WHERE rank <= 10
"""
