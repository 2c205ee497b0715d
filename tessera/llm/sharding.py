"""Sharding by a hierarchical weighted hash tree (regions, racks, shards).

A document draws once for each region, then for each rack of the region that has won and
then for each shard of that rack.  A node's draw is -log(u) / weight with u from a hash of
the document's id and the node, its weight that of all shards below it, and the least
draw wins.  A draw depends on its own node alone, so a row moves at a level only into a
node whose weight has grown or out of one whose weight has shrunk: all movement stays in
the subtrees whose weights change.  A new shard in a region of its own takes rows only
into itself.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered


@dataclass(frozen=True)
class Shard:
    shard: int
    rack: int
    region: int
    weight: float = 1.0


def topology(n: int, per_rack: int = 5, per_region: int = 2) -> list[Shard]:
    """``n`` shards of equal weight, racks and regions filled in order."""
    return [Shard(i, i // per_rack, i // per_rack // per_region) for i in range(n)]


def _winner(key: Column, nodes: Column) -> Column:
    """The name of the node of least draw; ``nodes`` is an array of struct(name, weight)."""

    def draw(node: Column) -> Column:
        digest = F.md5(F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("null")), node["name"]))
        bits = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double")
        return -F.log((bits + 0.5) / float(1 << 52)) / node["weight"]

    return F.array_min(F.transform(nodes, lambda n: F.struct(draw(n).alias("draw"), n["name"].alias("name"))))["name"]


def place(key: Column, shards: Sequence[Shard]) -> Column:
    """struct(region, rack, shard) where ``key`` ends on its way down the tree.

    Names of nodes are ``region``, ``region/rack`` and ``region/rack/shard``.
    """
    below: dict[str, dict[str, float]] = {"": {}}
    for s in shards:
        if s.weight > 0:
            at = ""
            for part in (s.region, s.rack, s.shard):
                name = f"{at}/{part}" if at else str(part)
                level = below.setdefault(at, {})
                level[name] = level.get(name, 0.0) + s.weight
                at = name
    if not below[""]:
        raise ValueError("a shard of positive weight is needed")

    def children(of: str) -> Column:
        return F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("weight")) for n, w in sorted(below[of].items())])

    def descend(won: Column, level: int) -> Column:
        inner = [x for pair in ((F.lit(n), children(n)) for n in sorted(below) if n and n.count("/") == level) for x in pair]
        return _winner(key, F.element_at(F.create_map(*inner), won))

    leaf = F.split(descend(descend(_winner(key, children("")), 0), 1), "/")
    return F.transform(F.array(leaf), lambda x: F.struct(*[x[i].cast("int").alias(c) for i, c in enumerate(("region", "rack", "shard"))]))[0]


def shard_documents(docs: DataFrame, shards: Sequence[Shard], grown: Sequence[Shard] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Place each row by its id: size, text_crc32, region, rack, shard, slot, grown_shard.

    * The id and the tree decide alone, so equal ids share a shard.  A null id is
      placed as the word ``null``.
    * Only the bytes of a text count, so its length doesn't matter.  An empty table gives
      an empty one.  Columns other than id and text are left out, whatever their names.
    * A null text has size 16 and the checksum of the empty text.
    * Repeated rows get a slot each.  Slots run from 0 in the order of the first
      three hex digits of md5(id), then id, then checksum, without gaps.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("null"))), 1, 3).alias("bucket"),
        place(F.col(id_col), shards).alias("at"),
        (place(F.col(id_col), grown).getField("shard") if grown else F.lit(None).cast("int")).alias("grown_shard"),
    )
    rows = rows.select("doc_id", "size", "text_crc32", "bucket", "at.region", "at.rack", "at.shard", "grown_shard")
    return numbered(rows, "shard", "bucket", ["doc_id", "text_crc32", "size"], "slot").drop("bucket")


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = shard_documents(docs, topology(40), topology(41))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


OP6_SQL = r"""
WITH RECURSIVE bits(n, k, c) AS (
  SELECT n, 0, n::BIGINT FROM range(256) t(n)
  UNION ALL
  SELECT n, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY n) AS t FROM bits WHERE k = 8),
shards AS (SELECT s, s // 10 AS region, s // 5 AS rack, n FROM range(41) r(s), (VALUES (40), (41)) t(n) WHERE s < n),
level AS (
  SELECT n, 0 AS depth, '' AS up, region::VARCHAR AS name, count(*) AS w FROM shards GROUP BY ALL
  UNION ALL SELECT n, 1, region::VARCHAR, region || '/' || rack, count(*) FROM shards GROUP BY ALL
  UNION ALL SELECT n, 2, region || '/' || rack, region || '/' || rack || '/' || s, count(*) FROM shards GROUP BY ALL),
draws AS (
  SELECT doc_id, n, depth, up, name, -ln((('0x' || substr(md5(doc_id::VARCHAR || ':' || name), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) / w AS d
  FROM (SELECT DISTINCT doc_id FROM documents), level),
one AS (SELECT doc_id, n, arg_min(name, (d, name)) AS name FROM draws WHERE depth = 0 GROUP BY ALL),
two AS (SELECT x.doc_id, x.n, arg_min(x.name, (d, x.name)) AS name FROM draws x JOIN one y ON x.doc_id = y.doc_id AND x.n = y.n AND x.up = y.name WHERE depth = 1 GROUP BY ALL),
three AS (SELECT x.doc_id, x.n, arg_min(x.name, (d, x.name)) AS name FROM draws x JOIN two y ON x.doc_id = y.doc_id AND x.n = y.n AND x.up = y.name WHERE depth = 2 GROUP BY ALL),
placed AS (
  SELECT doc_id, max(split_part(name, '/', 3)::INT) FILTER (n = 40) AS shard, max(split_part(name, '/', 3)::INT) FILTER (n = 41) AS grown FROM three GROUP BY doc_id)
SELECT doc_id, (strlen(coalesce(text, '')) + 16)::BIGINT AS size,
       xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)),
                       lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), 4294967295)::BIGINT AS text_crc32,
       'key' AS law, shard::INT AS shard,
       (row_number() OVER (PARTITION BY shard ORDER BY substr(md5(doc_id::VARCHAR), 1, 3), doc_id) - 1)::BIGINT AS slot,
       grown::INT AS grown_shard
FROM documents JOIN placed USING (doc_id), tab
"""
