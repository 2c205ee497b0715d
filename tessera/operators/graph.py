"""Reads of the typed graph: fan-in, neighbourhoods, callers, personalized rank."""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import words

_LINKS = 1_000_000  # links that one task of a round follows


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of an iteration: checkpoint in the session's shared folder, or, with
    a local master alone, in one of its own where none is set."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        at = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not at:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
            import tempfile

            at = f"{tempfile.gettempdir()}/tessera-{uuid.uuid4().hex}"
        sc.setCheckpointDir(at)
    return df.checkpoint(eager=True)


@contextmanager
def dealt(spark: SparkSession, partitions: int):
    """Plans made and run within keep ``partitions`` in every shuffle: a table that is cut
    here has a known partitioning, and joins on its key don't shuffle it again."""
    fixed = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": str(partitions)}
    was = {k: spark.conf.get(k) for k in fixed}
    try:
        for k, x in fixed.items():
            spark.conf.set(k, x)
        yield
    finally:
        for k, x in was.items():
            spark.conf.set(k, x)


def fan_in(edges: DataFrame, types: list[str] | None = None, candidates: DataFrame | None = None) -> DataFrame:
    """``target_id, fan_in``: how many edges come in, of the given types or of all.

    ``candidates`` (one column of ids) restricts the targets before the count.
    """
    e = edges.where(F.col("edge_type").isin(types)) if types else edges
    if candidates is not None:
        e = e.join(candidates.toDF("target_id").distinct(), "target_id", "left_semi")
    return e.groupBy("target_id").agg(F.count(F.lit(1)).alias("fan_in"))


def neighbourhood(edges: DataFrame, symbols: DataFrame, symbol: object, limit: int = 20) -> DataFrame:
    """Relations of one symbol each way: CALLS first, then by confidence, ``limit`` a side.

    ``direction, rank, total, edge_type, other_id, label, confidence``; the label is the
    other end's qualified name, or its id where it is no symbol.
    """
    both = edges.where(F.col("source_id") == F.lit(symbol)).select(F.lit("out").alias("direction"), "edge_type", F.col("target_id").alias("other_id"), "confidence")
    both = both.union(edges.where(F.col("target_id") == F.lit(symbol)).select(F.lit("in"), "edge_type", "source_id", "confidence"))
    named = both.join(symbols.select(F.col("id").alias("other_id"), "qualified_name"), "other_id", "left")
    named = named.withColumn("label", F.coalesce("qualified_name", F.col("other_id").cast("string")))
    side = Window.partitionBy("direction")
    order = side.orderBy((F.col("edge_type") != "CALLS").cast("int"), F.desc("confidence"), "edge_type", "other_id")
    ranked = named.withColumn("rank", F.row_number().over(order)).withColumn("total", F.count(F.lit(1)).over(side))
    return ranked.where(F.col("rank") <= limit).select("direction", "rank", "total", "edge_type", "other_id", "label", "confidence")


def expand(edges: DataFrame, seeds: DataFrame, outgoing_only: bool = False) -> DataFrame:
    """Seeds and their direct neighbours over all edges but CONTAINS: ``id``."""
    s = seeds.toDF("id").distinct()
    e = edges.where("edge_type <> 'CONTAINS'")
    near = e.join(s, e.source_id == s.id, "left_semi").select(F.col("target_id").alias("id"))
    if not outgoing_only:
        near = near.union(e.join(s, e.target_id == s.id, "left_semi").select("source_id"))
    return s.union(near).distinct()


def induced(edges: DataFrame, scope: DataFrame) -> DataFrame:
    """Edges but CONTAINS with both ends in ``scope`` (one column of ids), best first."""
    s = scope.toDF("id").distinct()
    e = edges.where("edge_type <> 'CONTAINS'")
    e = e.join(s, e.source_id == s.id, "left_semi").join(s.withColumnRenamed("id", "other"), F.col("target_id") == F.col("other"), "left_semi")
    return e.orderBy(F.desc("confidence"), "source_id", "target_id", "edge_type")


def callers_by_depth(edges: DataFrame, start: DataFrame, depth: int = 3) -> DataFrame:
    """``id, depth``: who reaches the start (one column of ids) over CALLS, breadth first.

    Layers stop at ``depth`` (1 to 5) or at an empty frontier; the start has no layer.
    """
    if not 1 <= depth <= 5:
        raise ValueError("depth is 1 to 5")
    calls = edges.where("edge_type = 'CALLS'").select("source_id", "target_id").distinct()
    seen = cut(start.toDF("id").distinct().select("id", F.lit(0).alias("depth")))
    front = seen
    for layer in range(1, depth + 1):
        near = calls.join(front, calls.target_id == front.id, "left_semi").select(F.col("source_id").alias("id")).distinct()
        front = cut(near.join(seen, "id", "left_anti").select("id", F.lit(layer).alias("depth")))
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen.where("depth > 0")


def relevance(symbols: DataFrame, query: str, seeds: list) -> DataFrame:
    """``id, relevance, weight`` of each symbol for a query and seed ids."""
    q = sorted({w for w in _plain_words(query)})
    seed = F.col("id").isin(seeds) if seeds else F.lit(False)
    own = words(F.col("qualified_name"))
    overlap = F.size(F.array_intersect(own, F.array(*[F.lit(w) for w in q]))) if q else F.lit(0)
    score = 20 * seed.cast("int") + 10 * (F.lower("qualified_name") == F.lit(query.lower())).cast("int") + overlap
    return symbols.select("id", score.alias("relevance"), (1.0 + 10.0 * score + 2.0 * (F.col("kind") == "endpoint").cast("int")).alias("weight"))


def _plain_words(text: str) -> list[str]:
    import re

    spaced = re.sub(r"([a-z])([A-Z])", r"\1 \2", text)
    return [w for w in re.split(r"[\W_]+", spaced.lower()) if w]


def personalized_rank(symbols: DataFrame, edges: DataFrame, query: str, seeds: list, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """``id, relevance, rank`` after a fixed number of rounds of personalized PageRank.

    Distinct edges but CONTAINS between symbols count; what has no way out gives its
    rank back to the preferences.
    """
    rel = relevance(symbols, query, seeds)
    total = rel.agg(F.sum("weight")).first()[0] or 1.0
    base = rel.select("id", "relevance", (F.col("weight") / F.lit(total)).alias("pref"))
    ids = base.select("id")
    links = edges.where("edge_type <> 'CONTAINS'").select("source_id", "target_id").join(ids.withColumnRenamed("id", "t"), F.col("target_id") == F.col("t"), "left_semi")
    # a row a source with all its targets, which is also what tells links apart
    links = links.groupBy("source_id").agg(F.collect_set("target_id").alias("to")).join(ids, F.col("source_id") == F.col("id"), "left_semi")
    links = cut(links.withColumn("part", F.lit(damping) / F.size("to")))
    many = links.agg(F.sum(F.size("to"))).first()[0] or 0
    tasks = max(symbols.sparkSession.sparkContext.defaultParallelism, -(-many // _LINKS))
    # the rank after a round is a sum of powers of the links applied to the preferences, so
    # a round is one join and one sum; what has no way out only changes the coefficients.
    # Links stay where they are: a round shuffles what goes along them, summed by task
    with dealt(symbols.sparkSession, tasks):
        links = cut(links.repartition(tasks, "source_id").sortWithinPartitions("source_id"))
        powers = [cut(base.select("id", F.col("pref").alias("w")).repartition(tasks, "id"))]
        for _ in range(rounds):
            step = links.hint("merge").join(powers[-1], F.col("source_id") == F.col("id")).select(F.explode("to").alias("v"), (F.col("w") * F.col("part")).alias("w"))
            powers.append(cut(step.groupBy(F.col("v").alias("id")).agg(F.sum("w").alias("w"))))

    def each(of: list[DataFrame], factors: list[float]) -> DataFrame:
        parts = [w.select("id", (F.col("w") * F.lit(x)).alias("w"), F.lit(k).alias("k")) for k, (w, x) in enumerate(zip(of, factors, strict=True))]
        return reduce(DataFrame.union, parts)

    mass = dict(each(powers, [1.0] * len(powers)).groupBy("k").agg(F.sum("w")).collect())  # a row a round
    back: list[float] = []  # what a round gives back to the preferences
    for t in range(rounds):
        back.append(1.0 - sum(back[t - 1 - k] * mass.get(k + 1, 0.0) for k in range(t)) - mass.get(t + 1, 0.0))
    total_rank = each(powers, [*reversed(back), 1.0]).groupBy(F.col("id").alias("v")).agg(F.sum("w").alias("rank"))
    return base.join(total_rank, F.col("id") == F.col("v"), "left").select("id", "relevance", F.coalesce("rank", F.lit(0.0)).alias("rank"))


def rank_order(ranked: DataFrame, symbols: DataFrame) -> DataFrame:
    """Symbols by relevance, then rank, then path and line."""
    return ranked.join(symbols, "id").orderBy(F.desc("relevance"), F.desc("rank"), "path", "start_line", "id")


def label(ids: DataFrame, symbols: DataFrame, files: DataFrame, column: str = "id") -> DataFrame:
    """Add ``label``: qualified name, else file path, else the id."""
    s = symbols.select(F.col("id").alias("__s"), F.col("qualified_name").alias("__q")).dropDuplicates(["__s"])
    f = files.select(F.col("id").alias("__f"), F.col("path").alias("__p")).dropDuplicates(["__f"])
    out = ids.join(s, F.col(column) == F.col("__s"), "left").join(f, F.col(column) == F.col("__f"), "left")
    return out.withColumn("label", F.coalesce("__q", "__p", F.col(column).cast("string"))).drop("__s", "__q", "__f", "__p")


def boundary(edges: DataFrame, owned: DataFrame) -> DataFrame:
    """Edges with ``place``: internal (both ends owned), outgoing or incoming (one end)."""
    o = owned.toDF("__o").distinct()
    e = edges.join(o.withColumnRenamed("__o", "__a"), F.col("source_id") == F.col("__a"), "left")
    e = e.join(o.withColumnRenamed("__o", "__b"), F.col("target_id") == F.col("__b"), "left")
    a, b = F.col("__a").isNotNull(), F.col("__b").isNotNull()
    place: Column = F.when(a & b, "internal").when(a, "outgoing").when(b, "incoming")
    return e.withColumn("place", place).where("place is not null").drop("__a", "__b")
