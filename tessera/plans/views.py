"""The driver's tables seen as a repository, in Spark and in SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """Lazy readers of one scale factor."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def files(t: Tables) -> DataFrame:
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return t.documents.select(
        F.col("doc_id").alias("id"), path.alias("path"), F.sha2("text", 256).alias("content_hash"), F.size(F.split("text", "\n", -1)).alias("line_count"), "text", "source", "lang"
    )


def modules(t: Tables) -> DataFrame:
    d = t.documents
    parts = [d.select(F.col("source").alias("path")), d.select(F.concat_ws("/", "source", "lang")), d.select(F.lit(".")).limit(1)]
    return reduce(DataFrame.union, parts).distinct()


def symbols(t: Tables) -> DataFrame:
    kind = F.when(F.col("p_size") % 5 == 0, "endpoint").when(F.col("p_size") % 5 == 1, "class").otherwise("function")
    return t.part.select(
        F.col("p_partkey").alias("id"),
        F.concat_ws("/", "p_brand", "p_type").alias("path"),
        F.col("p_name").alias("qualified_name"),
        kind.alias("kind"),
        F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("signature"),
        F.col("p_size").alias("start_line"),
        F.col("p_brand").alias("module"),
    )


def edges(t: Tables) -> DataFrame:
    """One edge for each ordered pair of parts in an order."""
    li = t.lineitem
    a = li.select("l_orderkey", F.col("l_partkey").alias("source_id"), F.col("l_linenumber").alias("n1"), "l_returnflag")
    b = li.select("l_orderkey", F.col("l_partkey").alias("target_id"), F.col("l_linenumber").alias("n2"))
    e = a.join(b, "l_orderkey").where("n1 < n2 and source_id <> target_id")
    kind = F.when(F.col("l_returnflag") == "A", "CALLS").when(F.col("l_returnflag") == "R", "DEPENDS_ON").otherwise("CONTAINS")
    return e.select("source_id", "target_id", kind.alias("edge_type")).distinct().withColumn("confidence", F.when(F.col("edge_type") == "CALLS", 0.9).otherwise(0.8))


def log(t: Tables) -> DataFrame:
    """Events as a git log: path, author, at, position (0 is the newest)."""
    k = F.get_json_object("props", "$.k")
    at = F.struct("ts", "event_id")
    return t.events.select(F.concat_ws("/", "event_type", k).alias("path"), (F.col("user_id") % 40).cast("string").alias("author"), "ts", "event_id", at.alias("at"))


def spans(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("path"), F.col("o_orderkey").alias("start_line"),
        (F.col("o_orderkey") + F.col("o_orderkey") % 97 * 10).alias("end_line"), F.col("o_orderpriority").alias("qualified_name"),
        F.when(F.col("o_orderstatus") == "O", "function").otherwise("class").alias("kind"),
    )


def points(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", F.col("o_custkey").cast("string").alias("path"))
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    # joined first: the rows of an order are then where they are grouped
    p = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_orderkey", "l_linenumber", "path").agg(F.min("l_partkey").alias("part"))
    return p.select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("point_id"), "path", (F.col("l_orderkey") + F.col("l_linenumber")).alias("line"), "part")


def previous(t: Tables) -> DataFrame:
    return t.documents.where("doc_id % 10 <> 0").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("content_hash"), "source", "lang")


def current(t: Tables) -> DataFrame:
    text = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return t.documents.where("doc_id % 11 <> 0").select(F.col("doc_id").alias("id"), F.sha2(text, 256).alias("content_hash"), "source", "lang")


# --- the same as SQL ---------------------------------------------------------------

SYMBOLS = """
sym AS (SELECT p_partkey AS id, p_brand || '/' || p_type AS path, p_name AS qn,
  CASE p_size % 5 WHEN 0 THEN 'endpoint' WHEN 1 THEN 'class' ELSE 'function' END AS kind,
  'size ' || p_size AS sig, p_size AS start_line, p_brand AS module FROM part)"""


def edges_sql() -> str:
    return """
edge AS MATERIALIZED (SELECT DISTINCT a.l_partkey AS source_id, b.l_partkey AS target_id,
  CASE a.l_returnflag WHEN 'A' THEN 'CALLS' WHEN 'R' THEN 'DEPENDS_ON' ELSE 'CONTAINS' END AS edge_type
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND a.l_partkey <> b.l_partkey)"""


FILES = """
file AS (SELECT doc_id AS id, source || '/' || lang || '/' || doc_id || '.txt' AS path, sha256(text) AS content_hash,
  len(string_split(text, chr(10))) AS line_count, text, source, lang FROM documents)"""

MODULES = """
mod AS (SELECT source AS path FROM documents UNION SELECT source || '/' || lang FROM documents UNION SELECT '.')"""

PREV_CUR = """
prev AS (SELECT doc_id AS id, sha256(text) AS content_hash, source, lang FROM documents WHERE doc_id % 10 <> 0),
cur AS (SELECT doc_id AS id, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS content_hash, source, lang FROM documents WHERE doc_id % 11 <> 0)"""


def bm25_sql(source: str, columns: dict[str, float], terms: list[str], prefix: str = "") -> str:
    """CTEs ``{prefix}hit(id, score)`` for one-token prefix terms over ``source``."""
    toks = ", ".join(f"list_filter(regexp_split_to_array(lower(strip_accents({c})), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '') AS t_{c}" for c in columns)
    freq = ", ".join(
        " + ".join(f"{w} * len(list_filter(t_{c}, lambda t: starts_with(t, '{term}')))" for c, w in columns.items()) + f" AS f{i}" for i, term in enumerate(terms)
    )
    length = " + ".join(f"len(t_{c})" for c in columns)
    n = range(len(terms))
    idf = {i: f"ln((n - n{i} + 0.5) / (n{i} + 0.5))" for i in n}
    score = " ".join(
        f"- (CASE WHEN {idf[i]} <= 0 THEN 1e-6 ELSE {idf[i]} END) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * len / avg_len))" for i in n
    )
    return f"""
{prefix}tok AS (SELECT id, {toks} FROM {source}),
{prefix}row AS (SELECT id, {length} AS len, {freq} FROM {prefix}tok),
{prefix}stat AS (SELECT count(*) AS n, avg(len) AS avg_len, {", ".join(f"count(*) FILTER (f{i} > 0) AS n{i}" for i in n)} FROM {prefix}row),
{prefix}hit AS (SELECT id, 0.0 {score} AS score FROM {prefix}row, {prefix}stat WHERE {" AND ".join(f"f{i} > 0" for i in n)})"""
