"""Line dedup: lines that several documents share stay only in the first of them.

Native: explode the normalised lines, hash them, find per hash the smallest document
and whether another document has it, and put what stays together again by position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

_RESULTS = ("n_lines", "n_dropped")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """All columns of ``docs`` with the kept lines as text, ``n_lines`` and ``n_dropped``.

    A line's key is the line without ASCII white space at its ends and with A-Z
    lower-cased.  A key of at least ``min_chars`` code points that at least
    ``min_docs`` documents hold loses all its lines but those of the smallest id.

    * Null or empty text is one empty line; the text returned is then empty.
    * A null id can't be ordered: such rows are not counted and keep all lines.
    * Rows that share an id count as one document; each is returned.
    * Columns of ``docs`` named like a result column are replaced by it.
    * A key is compared by two 64-bit hashes with different seeds.
    * A text, of any length, is split and put together within one row; an empty table
      gives an empty one.
    """
    extra = [c for c in docs.columns if c not in (*_RESULTS, id_col, text_col)]
    base = docs.select(
        F.col(id_col).alias("__id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("__text"),
        F.struct(*[F.col(f"`{c}`") for c in extra]).alias("__extra") if extra else F.lit(None).cast("int").alias("__extra"),
    )
    # rows of one id that differ in text are told apart; equal rows share their positions
    src = base.select("__id", "__text", F.xxhash64("__text").alias("__row"))
    lines = src.where("__id is not null").select("__id", "__row", F.posexplode(F.split("__text", "\n", -1)).alias("pos", "line"))
    key = ascii_lower(F.btrim("line", F.lit(" \t\n\x0b\x0c\r")))
    lines = lines.select("__id", "__row", "pos", key.alias("key")).where(F.char_length("key") >= min_chars)
    # the join key is derived, so that both sides of the join are exchanged for it
    # and adaptive execution can split a line that a third of all documents hold
    lines = lines.select("__id", "__row", "pos", F.xxhash64(F.lit(1), "key").alias("h1"), F.xxhash64(F.lit(2), "key").alias("h2"))
    aggs = [F.min("__id").alias("first")]
    if min_docs == 2:
        shared = lines.groupBy("h1", "h2").agg(*aggs, F.max("__id").alias("last")).where("first < last")
    else:
        shared = lines.groupBy("h1", "h2").agg(*aggs, F.countDistinct("__id").alias("n")).where(F.col("n") >= min_docs)
    shared = shared.select(F.bitwise_not("h1").alias("k1"), F.bitwise_not("h2").alias("k2"), "first")
    lost = (
        lines.select("__id", "__row", "pos", F.bitwise_not("h1").alias("k1"), F.bitwise_not("h2").alias("k2"))
        .join(shared, ["k1", "k2"])
        .where("__id > first")
        .groupBy("__id", "__row")
        .agg(F.collect_set("pos").alias("lost"))
    )
    both = base.withColumn("__row", F.xxhash64("__text")).join(lost, ["__id", "__row"], "left")
    n = F.size("parts")
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), n - 1), "lost"), lambda i: F.get(F.col("parts"), i)), "\n")
    out = both.withColumn("parts", F.split("__text", "\n", -1)).select(
        "__id",
        "__extra",
        F.when(F.col("lost").isNull(), F.col("__text")).otherwise(kept).alias("__kept"),
        n.cast("long").alias("n_lines"),
        F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_dropped"),
    )
    return out.select(
        F.col("__id").alias(id_col), F.col("__kept").alias(text_col), *[F.col("__extra").getField(c).alias(c) for c in extra], *_RESULTS
    )


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (
  SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (
  SELECT k.*, coalesce(k.doc_id > s.first, false) AS lost FROM k LEFT JOIN s ON k.key = s.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (lost))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
