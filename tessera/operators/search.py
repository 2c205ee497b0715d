"""Full-text, vector and hybrid search over symbols."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.graph import cut
from tessera.functions.text import cosine, coverage_bonus, index_tokens, query_phrases, symbol_text

#: Column weights of the symbol index, BM25 and fusion constants.
SYMBOL_WEIGHTS = {"qualified_name": 5.0, "path": 2.0, "signature": 1.0}
K1, B = 1.2, 0.75
RRF_K = 60
SIGNAL_WEIGHTS = {"fts": 1.0, "vector": 1.0, "graph": 0.5}

Reranker = Callable[[Column, str], Column]


def _phrase_hits(tokens: Column, phrase: list[str]) -> Column:
    """How often the phrase stands in ``tokens``, its last token as a prefix."""
    *head, last = phrase
    if not head:
        return F.size(F.filter(tokens, lambda t: F.startswith(t, F.lit(last))))

    def at(_, i):
        own = [F.get(tokens, i + k).eqNullSafe(F.lit(w)) for k, w in enumerate(head)]
        own.append(F.coalesce(F.startswith(F.get(tokens, i + len(head)), F.lit(last)), F.lit(False)))
        return reduce(lambda a, b: a & b, own)

    return F.size(F.filter(F.transform(tokens, at), lambda x: x))


def bm25(docs: DataFrame, query: str, weights: Mapping[str, float], limit: int | None = 20, keep: Column | None = None, id_col: str = "id") -> DataFrame:
    """``id, score`` (less is better) of the rows in which every phrase of the query stands.

    Statistics (rows, rows with the phrase, mean length) range over all of ``docs``;
    ``keep`` (a snapshot, say) filters what is returned and never the statistics.  The
    statistics are one row and broadcast; ``docs`` is read for them and again for the hits.
    An empty query finds nothing.
    """
    phrases = query_phrases(query)
    if not phrases:
        return docs.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score")).limit(0)
    toks = docs.select(
        F.col(id_col).alias("id"), (keep if keep is not None else F.lit(True)).alias("keep"), *[index_tokens(F.col(c)).alias(f"t_{c}") for c in weights]
    )
    freq = [reduce(lambda a, b: a + b, [_phrase_hits(F.col(f"t_{c}"), p) * float(w) for c, w in weights.items()]) for p in phrases]
    rows = toks.select(
        "id", "keep", reduce(lambda a, b: a + b, [F.size(f"t_{c}") for c in weights]).alias("len"), *[f.alias(f"f{i}") for i, f in enumerate(freq)]
    )
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"), *[F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(len(phrases))])
    hit = reduce(lambda a, b: a & b, [F.col(f"f{i}") > 0 for i in range(len(phrases))])
    joined = rows.where(hit & F.col("keep")).crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(phrases)):
        idf = F.log((F.col("n") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5))
        idf = F.when(idf <= 0, 1e-6).otherwise(idf)
        f = F.col(f"f{i}")
        score = score - idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    out = joined.select("id", score.alias("score"))
    return out.orderBy("score", "id").limit(limit) if limit is not None else out


def search_symbols(symbols: DataFrame, query: str, snapshot_id: str | None = None, limit: int = 20) -> DataFrame:
    keep = F.col("snapshot_id") == F.lit(snapshot_id) if snapshot_id is not None else None
    return bm25(symbols, query, SYMBOL_WEIGHTS, limit, keep)


def vector_top_k(points: DataFrame, query: list[float] | Column, limit: int = 20, vector_col: str = "vector", id_col: str = "id") -> DataFrame:
    """``id, score`` of the ``limit`` points nearest by cosine, ties to the smaller id."""
    q = query if isinstance(query, Column) else F.array(*[F.lit(float(x)) for x in query])
    return points.select(F.col(id_col).alias("id"), cosine(F.col(vector_col), q).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def ranked(hits: DataFrame, source: str, descending: bool) -> DataFrame:
    """``id, source, rank`` (from 1) of a short list."""
    order = Window.orderBy(F.desc("score") if descending else F.col("score"), "id")
    return hits.select("id", F.lit(source).alias("source"), F.row_number().over(order).alias("rank"))


def graph_signal(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """Candidates with an incoming edge, most first: the semi-join comes before the count."""
    from .graph import fan_in

    hits = fan_in(edges, None, candidates.select("id")).select(F.col("target_id").alias("id"), F.col("fan_in").cast("double").alias("score"))
    return ranked(hits, "graph", True)


def fuse(lists: DataFrame, weights: Mapping[str, float] = SIGNAL_WEIGHTS) -> DataFrame:
    """Weighted reciprocal rank fusion of ``id, source, rank``: ``id, score, sources``."""
    w = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
    part = F.coalesce(F.try_element_at(w, F.col("source")), F.lit(1.0)) / (RRF_K + F.col("rank"))
    return lists.groupBy("id").agg(F.sum(part).alias("score"), F.array_sort(F.collect_set("source")).alias("sources"))


def keyword_reranker(text: Column, query: str) -> Column:
    """A deterministic stand-in: the share of query terms that the text contains."""
    terms = sorted({t for t in query.lower().split() if t})
    low = F.lower(text)
    hits = reduce(lambda a, b: a + b, [F.contains(low, F.lit(t)).cast("double") for t in terms], F.lit(0.0))
    return hits / float(max(len(terms), 1))


def hybrid_search(
    symbols: DataFrame,
    edges: DataFrame,
    query: str,
    points: DataFrame | None = None,
    query_vector: list[float] | Column | None = None,
    reranker: Reranker | None = None,
    snapshot_id: str | None = None,
    candidate_limit: int = 20,
    limit: int = 8,
) -> DataFrame:
    """``id, qualified_name, path, score, sources``: the best ``limit`` symbols.

    Full-text and vector hits give candidates, incoming edges a third list; the lists are
    fused, many query terms in a symbol's text add a bonus, and a reranker, if there is
    one and more than one candidate, replaces the score.  Without a vector or a reranker
    those stages are left out of the plan.
    """
    live = symbols if snapshot_id is None else symbols.where(F.col("snapshot_id") == F.lit(snapshot_id))
    lists = ranked(search_symbols(symbols, query, snapshot_id, candidate_limit), "fts", False)
    if points is not None and query_vector is not None:
        near = vector_top_k(points if snapshot_id is None else points.where(F.col("snapshot_id") == F.lit(snapshot_id)), query_vector, candidate_limit)
        near = near.join(live.select("id"), "id", "left_semi")
        lists = lists.union(ranked(near, "vector", True))
    lists = cut(lists)  # short; without it the searches would run once more for the graph
    lists = lists.union(graph_signal(lists.select("id").distinct(), edges))
    text = symbol_text(F.col("kind"), F.col("qualified_name"), F.col("signature"), F.col("path"))
    hits = fuse(lists).join(live.select("id", "qualified_name", "path", text.alias("text")), "id")
    hits = hits.withColumn("score", F.col("score") + coverage_bonus(F.col("text"), query.split()))
    hits = hits.orderBy(F.desc("score"), "id").limit(candidate_limit)
    if reranker is not None:
        n = F.count(F.lit(1)).over(Window.partitionBy())
        hits = hits.withColumn("n", n)
        hits = hits.withColumn("score", F.when(F.col("n") > 1, F.coalesce(reranker(F.col("text"), query), F.lit(0.0))).otherwise(F.col("score")))
        hits = hits.withColumn("sources", F.when(F.col("n") > 1, F.concat("sources", F.array(F.lit("rerank")))).otherwise(F.col("sources")))
    return hits.orderBy(F.desc("score"), "id").limit(limit).select("id", "qualified_name", "path", "score", "sources")


def federated(hits: DataFrame, limit: int, repo_col: str = "repo") -> DataFrame:
    """Merge hits of several repositories by raw score, with ``shown`` and ``total``."""
    total = hits.agg(F.count(F.lit(1)).alias("total"))
    top = hits.orderBy(F.desc("score"), repo_col, "id").limit(limit)
    return top.crossJoin(F.broadcast(total)).withColumn("shown", F.least(F.lit(limit), F.col("total")))


def index_symbols(symbols: DataFrame, cache: DataFrame, model: str, embed: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Vectors of a snapshot's symbols, embedding only texts that the cache lacks.

    ``cache``: ``point_id, text_hash, model, vector``.  ``embed`` adds ``vector`` to rows with
    ``text``.  Returns all points of the snapshot and those newly embedded.
    """
    from tessera.schema import point_id

    text = symbol_text(F.col("kind"), F.col("qualified_name"), F.col("signature"), F.col("path"))
    want = symbols.select(F.col("id"), "snapshot_id", point_id(F.col("id")).alias("point_id"), text.alias("text"))
    want = want.withColumn("text_hash", F.sha2("text", 256)).withColumn("model", F.lit(model))
    keys = ["point_id", "text_hash", "model"]
    had = want.join(cache.select(*keys, "vector").dropDuplicates(keys), keys)
    new = embed(want.join(cache.select(*keys).distinct(), keys, "left_anti"))
    cols = ["id", "snapshot_id", *keys, "vector"]
    return had.select(*cols).unionByName(new.select(*cols)), new.select(*cols)
