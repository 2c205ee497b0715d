"""Registered queries over the driver's tables and the SQL that checks them.

Every query applies a library operator to its whole tables; limits stand only where a
top-k report is the operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text as fx
from tessera.functions.tokens import piece_count
from tessera.operators import analysis, graph, history, packing, policy, resolve, search

from . import views as v
from .views import Tables

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None):
    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            SQL[name] = sql
        return f

    return register


# --- snapshots, names ------------------------------------------------------------------


@query(
    "snapshot_counts",
    f"""WITH {v.SYMBOLS}, {v.edges_sql()}, {v.FILES}, {v.MODULES}
SELECT 'edges' AS name, count(*)::BIGINT AS rows FROM edge UNION ALL SELECT 'files', count(*) FROM file
UNION ALL SELECT 'modules', count(*) FROM mod UNION ALL SELECT 'symbols', count(*) FROM sym""",
)
def snapshot_counts(t):
    return history.snapshot_counts({"files": v.files(t), "modules": v.modules(t), "symbols": v.symbols(t), "edges": v.edges(t)})


@query("latest_snapshot", "SELECT o_orderkey AS id, o_orderdate::VARCHAR AS created_at FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
def latest_snapshot(t):
    s = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"))
    return history.latest_snapshot(s).withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


_NAMES = """nm AS (SELECT DISTINCT p_name AS name FROM part WHERE p_partkey % 3 = 0 UNION SELECT DISTINCT upper(p_name) FROM part WHERE p_partkey % 3 = 1
  UNION SELECT DISTINCT string_split(p_name, ' ')[2] FROM part WHERE p_partkey % 3 = 2),
s AS (SELECT p_partkey AS id, replace(p_name, ' ', '.') AS dotted, p_name AS qn, p_brand || '/' || p_type AS path, p_size AS start_line FROM part)"""


def _names(t) -> DataFrame:
    p = t.part
    parts = [
        p.where("p_partkey % 3 = 0").select(F.col("p_name").alias("name")),
        p.where("p_partkey % 3 = 1").select(F.upper("p_name")),
        p.where("p_partkey % 3 = 2").select(F.split("p_name", " ")[1]),
    ]
    return parts[0].union(parts[1]).union(parts[2]).distinct()


@query(
    "name_resolution",
    f"""WITH {_NAMES},
n AS (SELECT DISTINCT replace(name, ' ', '.') AS name FROM nm),
m AS (SELECT n.name, s.id, s.path, s.start_line, CASE WHEN s.dotted = n.name THEN 0 WHEN ends_with(s.dotted, '.' || n.name) THEN 1 ELSE 2 END AS h
  FROM n JOIN s ON s.dotted = n.name OR ends_with(s.dotted, '.' || n.name) OR lower(s.dotted) = lower(n.name))
SELECT name, id, ['exact', 'suffix', 'case'][h + 1] AS how FROM (
  SELECT *, row_number() OVER (PARTITION BY name ORDER BY h, path, start_line, id) AS r FROM m) WHERE r = 1""",
)
def name_resolution(t):
    s = v.symbols(t).withColumn("qualified_name", F.replace("qualified_name", F.lit(" "), F.lit(".")))
    return resolve.resolve_name(s, _names(t).select(F.replace("name", F.lit(" "), F.lit("."))))


@query(
    "unique_resolution",
    f"""WITH {_NAMES}, n AS (SELECT name FROM nm UNION SELECT p_partkey::VARCHAR FROM part WHERE p_partkey % 50 = 0),
hit AS (SELECT n.name, s.id FROM n JOIN s ON s.id::VARCHAR = n.name UNION SELECT n.name, s.id FROM n JOIN s ON s.qn = n.name)
SELECT n.name, CASE WHEN count(h.id) = 1 THEN min(h.id) END::VARCHAR AS id, count(h.id)::BIGINT AS matches FROM n LEFT JOIN hit h ON h.name = n.name GROUP BY n.name""",
)
def unique_resolution(t):
    names = _names(t).union(t.part.where("p_partkey % 50 = 0").select(F.col("p_partkey").cast("string")))
    return resolve.resolve_unique(v.symbols(t), names).select("name", F.col("id").cast("string").alias("id"), F.col("matches").cast("long").alias("matches"))


# --- owners, imports, ranges ------------------------------------------------------------


@query(
    "module_ownership",
    f"""WITH {v.FILES}, m AS (SELECT path FROM ({v.MODULES.strip().removeprefix('mod AS (')[:-1]}) WHERE path = '.' OR hash_ok(path)),
o AS (SELECT f.id, f.path, m.path AS module, row_number() OVER (PARTITION BY f.id ORDER BY CASE WHEN m.path = '.' THEN 0 ELSE length(m.path) END DESC) AS r
  FROM file f JOIN m ON m.path = '.' OR starts_with(f.path, m.path || '/'))
SELECT id, path, module FROM o WHERE r = 1""".replace("hash_ok(path)", "md5(path) < 'b'"),
)
def module_ownership(t):
    m = v.modules(t).where((F.col("path") == ".") | (F.md5("path") < "b"))
    return resolve.owning_module(v.files(t).select("id", "path"), m)


@query(
    "import_resolution",
    """WITH h AS (SELECT DISTINCT unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages),
i AS (SELECT DISTINCT 'src/app.ts' AS path, './' || ltrim(href, '/') AS specifier FROM h),
f AS (SELECT DISTINCT 'src/' || ltrim(href, '/') || CASE len(href) % 4 WHEN 0 THEN '.ts' WHEN 1 THEN '/index.ts' WHEN 2 THEN '.py' ELSE '' END AS path FROM h),
c AS (SELECT i.*, s.pos, 'src/' || substr(specifier, 3) || s.suffix AS try FROM i,
  (VALUES (0, ''), (1, '.ts'), (2, '.tsx'), (3, '.js'), (4, '/index.ts'), (5, '/index.tsx')) s(pos, suffix)),
m AS (SELECT c.path, c.specifier, arg_min(c.try, c.pos) AS target FROM c JOIN f ON f.path = c.try GROUP BY ALL)
SELECT i.path, i.specifier, m.target FROM i LEFT JOIN m ON m.path = i.path AND m.specifier = i.specifier""",
)
def import_resolution(t):
    h = t.pages.select(F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href")).distinct()
    bare = F.regexp_replace("href", "^/+", "")
    imports = h.select(F.lit("src/app.ts").alias("path"), F.concat(F.lit("./"), bare).alias("specifier")).distinct()
    n = F.length("href") % 4
    suffix = F.when(n == 0, ".ts").when(n == 1, "/index.ts").when(n == 2, ".py").otherwise("")
    return resolve.resolve_imports(imports, h.select(F.concat(F.lit("src/"), bare, suffix).alias("path")).distinct())


_PACKAGES = """d AS (SELECT doc_id, source, lang, 'src/' || source || '/' || lang || '.py' AS path FROM documents),
f AS (SELECT DISTINCT path FROM d UNION SELECT DISTINCT 'src/' || source || '/__init__.py' FROM d UNION SELECT DISTINCT lang || '.py' FROM d),
i AS (SELECT DISTINCT path, CASE doc_id % 5 WHEN 0 THEN '.' || lang WHEN 1 THEN source || '.' || lang WHEN 2 THEN '..' || source WHEN 3 THEN lang ELSE '..none.' || lang END AS specifier FROM d)"""


@query(
    "python_imports",
    f"""WITH {_PACKAGES},
b AS (SELECT *, 0 AS pos, CASE WHEN starts_with(specifier, '..') THEN 'src/' || replace(substr(specifier, 3), '.', '/')
    WHEN starts_with(specifier, '.') THEN regexp_extract(path, '^(.*)/', 1) || '/' || replace(substr(specifier, 2), '.', '/') ELSE replace(specifier, '.', '/') END AS base FROM i
  UNION ALL SELECT *, 1, 'src/' || replace(specifier, '.', '/') FROM i WHERE NOT starts_with(specifier, '.')),
c AS (SELECT path, specifier, pos * 2 AS pos, base || '.py' AS try FROM b UNION ALL SELECT path, specifier, pos * 2 + 1, base || '/__init__.py' FROM b),
m AS (SELECT c.path, c.specifier, arg_min(c.try, c.pos) AS target FROM c JOIN f ON f.path = c.try GROUP BY ALL)
SELECT i.path, i.specifier, m.target FROM i LEFT JOIN m ON m.path = i.path AND m.specifier = i.specifier""",
)
def python_imports(t):
    d = t.documents.select("doc_id", "source", "lang", F.concat(F.lit("src/"), "source", F.lit("/"), "lang", F.lit(".py")).alias("path"))
    init = F.concat(F.lit("src/"), "source", F.lit("/__init__.py"))
    have = d.select("path").union(d.select(init)).union(d.select(F.concat("lang", F.lit(".py")))).distinct()
    kinds = [F.concat(F.lit("."), "lang"), F.concat_ws(".", "source", "lang"), F.concat(F.lit(".."), "source"), F.col("lang"), F.concat(F.lit("..none."), "lang")]
    spec = F.element_at(F.array(*kinds), (F.col("doc_id") % 5 + 1).cast("int"))
    return resolve.resolve_python_imports(d.select("path", spec.alias("specifier")).distinct(), have)


_SPANS = """span AS (SELECT o_orderkey AS id, o_custkey AS path, o_orderkey AS lo, o_orderkey + o_orderkey % 97 * 10 AS hi,
  o_orderpriority AS qn, CASE WHEN o_orderstatus = 'O' THEN 'function' ELSE 'class' END AS kind FROM orders),
pt AS (SELECT l_orderkey * 100 + l_linenumber AS point_id, o_custkey AS path, l_orderkey + l_linenumber AS line, min(l_partkey) AS part
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey, l_linenumber, o_custkey)"""


@query(
    "innermost_enclosing",
    f"""WITH {_SPANS}, h AS (
  SELECT point_id, s.id AS span_id, row_number() OVER (PARTITION BY point_id ORDER BY hi - lo, lo, s.id) AS r
  FROM pt JOIN span s ON s.path = pt.path AND pt.line BETWEEN s.lo AND s.hi)
SELECT point_id, span_id FROM h WHERE r = 1""",
)
def innermost_enclosing(t):
    return resolve.innermost(v.points(t), v.spans(t))


@query(
    "reference_edges",
    f"""WITH {_SPANS},
def AS (SELECT id, to_id FROM (SELECT d.id, s.id AS to_id, row_number() OVER (PARTITION BY d.id ORDER BY s.hi - s.lo, s.lo, s.id) AS n
  FROM span d JOIN span s ON s.path = d.path AND s.qn = d.qn AND d.lo BETWEEN s.lo AND s.hi WHERE d.id % 3 = 0) WHERE n = 1),
ref AS (SELECT pt.*, d.to_id AS target_id FROM pt JOIN def d ON d.id = pt.part - pt.part % 3),
near AS (SELECT r.point_id, r.target_id, r.path, r.line, s.id AS source_id, row_number() OVER (PARTITION BY point_id ORDER BY hi - lo, lo, s.id) AS n
  FROM ref r JOIN span s ON s.path = r.path AND r.line BETWEEN s.lo AND s.hi),
e AS (SELECT source_id, target_id, CASE WHEN s.kind = 'function' THEN 'CALLS' ELSE 'DEPENDS_ON' END AS edge_type, point_id, near.path, line
  FROM near JOIN span s ON s.id = target_id WHERE n = 1 AND source_id <> target_id)
SELECT source_id, target_id, edge_type, 0.9::DOUBLE AS confidence, 'scip' AS analyzer, arg_min(path, point_id)::VARCHAR AS path, min(point_id) // 100 + min(point_id) % 100 AS line,
  count(*)::BIGINT AS hits FROM e GROUP BY source_id, target_id, edge_type""",
)
def reference_edges(t):
    sp, pt = v.spans(t), v.points(t)
    sym = F.concat(F.lit("x/"), F.col("id").cast("string"), F.lit("#"), F.col("qualified_name"), F.lit("."))
    one = sp.where("id % 3 = 0").select(sym.alias("symbol"), F.lit(True).alias("is_definition"), "path", F.col("start_line").alias("line"), (-F.col("id") - 1).alias("ordinal"), "id")
    to = one.select("symbol", F.col("id").alias("__to"))
    refs = pt.join(to, F.col("part") - F.col("part") % 3 == F.col("__to")).select("symbol", F.lit(False).alias("is_definition"), "path", "line", F.col("point_id").alias("ordinal"))
    # definitions resolve to themselves: names are made unique by the id
    occ = one.drop("id").unionByName(refs)
    named = sp.withColumn("qualified_name", F.regexp_replace("qualified_name", r"\.", ""))
    return resolve.reference_edges(occ, named)


def _occurrences(t) -> DataFrame:
    """Definitions at the first line of every third span, named after it or, in one of seven, not."""
    sp = v.spans(t)
    name = F.when(F.col("id") % 7 == 0, F.lit("Other")).otherwise(F.regexp_replace("qualified_name", r"\.", ""))
    sym = F.concat(F.lit("x/"), F.col("id").cast("string"), F.lit("#"), name, F.lit("."))
    return sp.where("id % 3 = 0").select(sym.alias("symbol"), F.lit(True).alias("is_definition"), "path", F.col("start_line").alias("line"), F.col("id").alias("ordinal"), "id")


_DEFS = """def AS (SELECT id, to_id FROM (SELECT d.id, s.id AS to_id, row_number() OVER (PARTITION BY d.id ORDER BY s.hi - s.lo, s.lo, s.id) AS n
  FROM span d JOIN span s ON s.path = d.path AND s.qn = d.qn AND d.lo BETWEEN s.lo AND s.hi WHERE d.id % 3 = 0 AND d.id % 7 <> 0) WHERE n = 1)"""


@query(
    "unmapped_definitions",
    f"WITH {_SPANS}, {_DEFS} SELECT count(*)::BIGINT AS unmapped_definitions FROM span d WHERE d.id % 3 = 0 AND d.id NOT IN (SELECT id FROM def)",
)
def unmapped_definitions(t):
    return resolve.unmapped_definitions(_occurrences(t).drop("id"), v.spans(t).withColumn("qualified_name", F.regexp_replace("qualified_name", r"\.", "")))


@query(
    "relationship_edges",
    f"""WITH {_SPANS}, {_DEFS}, rel AS (SELECT o_orderkey AS a, o_orderkey + 3 * (o_custkey % 5 + 1) AS b FROM orders WHERE o_orderkey % 3 = 0 AND o_custkey % 4 < 3)
SELECT DISTINCT x.to_id AS source_id, y.to_id AS target_id, CASE WHEN s.kind = 'class' AND u.kind = 'class' THEN 'EXTENDS' ELSE 'IMPLEMENTS' END AS edge_type, 0.95::DOUBLE AS confidence, 'scip' AS analyzer
FROM rel JOIN def x ON x.id = a JOIN def y ON y.id = b JOIN span s ON s.id = x.to_id JOIN span u ON u.id = y.to_id""",
)
def relationship_edges(t):
    occ = _occurrences(t)
    o = t.orders.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("a"), (F.col("o_orderkey") + 3 * (F.col("o_custkey") % 5 + 1)).alias("b"), (F.col("o_custkey") % 4 < 3).alias("is_implementation"))
    ends = occ.select("id", "symbol")
    rel = o.join(ends.toDF("a", "source"), "a").join(ends.toDF("b", "target"), "b").select("source", "target", "is_implementation")
    return resolve.relationship_edges(rel, occ.drop("id"), v.spans(t).withColumn("qualified_name", F.regexp_replace("qualified_name", r"\.", "")))


@query(
    "source_containment",
    """WITH s AS (SELECT event_id AS id, user_id AS path, event_id AS lo, event_id + (event_id * 7919) % 4001 AS hi FROM events)
SELECT id, path::VARCHAR AS path, lo AS start_line, hi AS end_line FROM s WHERE NOT EXISTS (
  SELECT 1 FROM s o WHERE o.path = s.path AND o.id <> s.id AND o.lo <= s.lo AND o.hi >= s.hi AND (o.lo < s.lo OR o.hi > s.hi OR o.id < s.id))""",
)
def source_containment(t):
    e = F.col("event_id")
    s = t.events.select(e.alias("id"), F.col("user_id").cast("string").alias("path"), e.alias("start_line"), (e + e * 7919 % 4001).alias("end_line"))
    return resolve.uncovered(s)


# --- diffs --------------------------------------------------------------------------------


@query("snapshot_diff_changed", f"""WITH {v.PREV_CUR}
SELECT c.id, CASE WHEN p.id IS NULL THEN 'new' ELSE 'changed' END AS change FROM cur c LEFT JOIN prev p ON p.id = c.id WHERE p.id IS NULL OR p.content_hash <> c.content_hash""")
def snapshot_diff_changed(t):
    return resolve.changed(v.previous(t), v.current(t)).select("id", "change")


@query("snapshot_diff_removed", f"WITH {v.PREV_CUR} SELECT p.id FROM prev p ANTI JOIN cur c ON c.id = p.id")
def snapshot_diff_removed(t):
    return resolve.removed(v.previous(t), v.current(t)).select("id")


@query(
    "affected_modules",
    f"""WITH {v.PREV_CUR}, {v.FILES},
ch AS (SELECT c.id FROM cur c LEFT JOIN prev p ON p.id = c.id WHERE (p.id IS NULL OR p.content_hash <> c.content_hash)),
f AS (SELECT id, path, CASE WHEN md5(source || '/' || lang) < '8' THEN source || '/' || lang ELSE source END AS module FROM file),
imp AS (SELECT DISTINCT doc_id AS source_id, (doc_id * 31 + 7) % 997 AS target_id FROM documents),
x AS (SELECT module, 'changed' AS reason FROM f SEMI JOIN ch ON ch.id = f.id
  UNION ALL SELECT module, 'imports' FROM f SEMI JOIN (SELECT i.source_id FROM imp i SEMI JOIN ch ON ch.id = i.target_id) s ON s.source_id = f.id)
SELECT module, min(reason) AS reason FROM x GROUP BY module""",
)
def affected_modules(t):
    ch = resolve.changed(v.previous(t), v.current(t)).select("id")
    f = v.files(t).select("id", "path")
    d = t.documents
    deep = d.select(F.concat_ws("/", "source", "lang").alias("path")).where(F.md5("path") < "8")
    m = d.select(F.col("source").alias("path")).union(deep).distinct()
    e = d.select(F.col("doc_id").alias("source_id"), ((F.col("doc_id") * 31 + 7) % 997).alias("target_id"), F.lit("IMPORTS").alias("edge_type"))
    return resolve.affected_modules(f.join(ch, "id", "left_semi").select("path"), f, m, e)


# --- graph --------------------------------------------------------------------------------


@query("graph_fan_in", f"WITH {v.edges_sql()} SELECT target_id, count(*)::BIGINT AS fan_in FROM edge GROUP BY target_id")
def graph_fan_in(t):
    return graph.fan_in(v.edges(t))


_CONF = "CASE WHEN edge_type = 'CALLS' THEN 0.9 ELSE 0.8 END"


@query(
    "symbol_neighbourhood",
    f"""WITH {v.SYMBOLS}, {v.edges_sql()},
b AS (SELECT 'out' AS direction, edge_type, target_id AS other_id FROM edge WHERE source_id = 7 UNION ALL SELECT 'in', edge_type, source_id FROM edge WHERE target_id = 7),
r AS (SELECT b.*, qn AS label, {_CONF}::DOUBLE AS confidence,
  row_number() OVER (PARTITION BY direction ORDER BY (edge_type <> 'CALLS')::INT, {_CONF} DESC, edge_type, other_id)::INT AS rank,
  count(*) OVER (PARTITION BY direction) AS total FROM b JOIN sym ON sym.id = other_id)
SELECT direction, rank, total, edge_type, other_id, label, confidence FROM r WHERE rank <= 20""",
)
def symbol_neighbourhood(t):
    return graph.neighbourhood(v.edges(t), v.symbols(t), 7)


@query(
    "induced_subgraph",
    f"""WITH {v.edges_sql()}, seed AS (SELECT p_partkey AS id FROM part WHERE p_partkey < 5),
sc AS MATERIALIZED (SELECT id FROM seed UNION SELECT target_id FROM edge WHERE edge_type <> 'CONTAINS' AND source_id IN (FROM seed)
  UNION SELECT source_id FROM edge WHERE edge_type <> 'CONTAINS' AND target_id IN (FROM seed))
SELECT source_id, target_id, edge_type, {_CONF}::DOUBLE AS confidence FROM edge WHERE edge_type <> 'CONTAINS' AND source_id IN (FROM sc) AND target_id IN (FROM sc)""",
)
def induced_subgraph(t):
    e = v.edges(t)
    return graph.induced(e, graph.expand(e, t.part.where("p_partkey < 5").select("p_partkey")))


@query(
    "callers_by_depth",
    f"""WITH RECURSIVE {v.edges_sql()}, call AS (SELECT DISTINCT source_id, target_id FROM edge WHERE edge_type = 'CALLS'),
r(id, depth) AS (SELECT 3::BIGINT, 0 UNION SELECT c.source_id, r.depth + 1 FROM r JOIN call c ON c.target_id = r.id WHERE r.depth < 3)
SELECT id, min(depth)::INT AS depth FROM r GROUP BY id HAVING min(depth) > 0""",
)
def callers_by_depth(t):
    return graph.callers_by_depth(v.edges(t), t.part.where("p_partkey = 3").select("p_partkey"), 3)


def _ppr_sql(last: str) -> str:
    rounds = []
    for i in range(20):
        rounds.append(f"""
r{i + 1} AS MATERIALIZED (SELECT p.id, 0.15 * pref + 0.85 * coalesce(x.v, 0) + 0.85 * pref * coalesce((SELECT sum(r) FROM r{i} JOIN pref USING (id) WHERE deg IS NULL), 0) AS r
  FROM pref p LEFT JOIN (SELECT target_id, sum(r / deg) AS v FROM link JOIN r{i} ON r{i}.id = source_id JOIN pref q ON q.id = source_id GROUP BY target_id) x ON x.target_id = p.id)""")
    return f"""WITH {v.SYMBOLS}, {v.edges_sql()},
link AS MATERIALIZED (SELECT DISTINCT source_id, target_id FROM edge WHERE edge_type <> 'CONTAINS'),
rel AS (SELECT id, kind, (20 * (id IN (3, 5))::INT + 10 * (lower(qn) = 'red widget')::INT
  + len(list_intersect(list_filter(regexp_split_to_array(lower(qn), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), ['red', 'widget'])))::INT AS relevance FROM sym),
w AS (SELECT id, relevance, 1.0 + 10.0 * relevance + 2.0 * (kind = 'endpoint')::INT AS w FROM rel),
pref AS MATERIALIZED (SELECT w.id, relevance, w / (SELECT sum(w) FROM w) AS pref, deg
  FROM w LEFT JOIN (SELECT source_id, count(*) AS deg FROM link GROUP BY source_id) d ON d.source_id = w.id),
r0 AS MATERIALIZED (SELECT id, pref AS r FROM pref), {",".join(rounds)}
{last}"""


@query("personalized_rank", _ppr_sql("SELECT id, relevance, round(r, 9) AS rank FROM r20 JOIN pref USING (id)"))
def personalized_rank(t):
    return graph.personalized_rank(v.symbols(t), v.edges(t), "red widget", [3, 5]).withColumn("rank", F.round("rank", 9))


@query(
    "auto_seeds",
    _ppr_sql(
        """, top AS MATERIALIZED (SELECT id FROM r20 JOIN pref USING (id) JOIN sym USING (id) ORDER BY relevance DESC, r DESC, path, start_line, id LIMIT 3)
SELECT id, true AS seed FROM top UNION SELECT target_id, false FROM edge WHERE edge_type <> 'CONTAINS' AND source_id IN (FROM top) AND target_id NOT IN (FROM top)
UNION SELECT source_id, false FROM edge WHERE edge_type <> 'CONTAINS' AND target_id IN (FROM top) AND source_id NOT IN (FROM top)"""
    ),
)
def auto_seeds(t):
    e, s = v.edges(t), v.symbols(t)
    best = graph.rank_order(graph.personalized_rank(s, e, "red widget", [3, 5]), s).limit(3).select("id")
    top = graph.cut(best)
    return graph.expand(e, top).join(top.withColumn("seed", F.lit(True)), "id", "left").select("id", F.coalesce("seed", F.lit(False)).alias("seed"))


@query(
    "edge_labels",
    f"""WITH {v.SYMBOLS}, {v.FILES}, i AS (SELECT DISTINCT o_custkey + o_orderkey % 5000 AS id FROM orders)
SELECT i.id, coalesce(sym.qn, file.path, i.id::VARCHAR) AS label FROM i LEFT JOIN sym ON sym.id = i.id LEFT JOIN file ON file.id = i.id""",
)
def edge_labels(t):
    ids = t.orders.select((F.col("o_custkey") + F.col("o_orderkey") % 5000).alias("id")).distinct()
    return graph.label(ids, v.symbols(t), v.files(t).select("id", "path"))


@query(
    "boundary_edges",
    f"""WITH {v.SYMBOLS}, {v.edges_sql()}, own AS (SELECT id FROM sym WHERE module = 'Brand#11'),
e AS (SELECT source_id, target_id, edge_type, source_id IN (FROM own) AS a, target_id IN (FROM own) AS b FROM edge WHERE edge_type <> 'CONTAINS')
SELECT CASE WHEN a AND b THEN 'internal' WHEN a THEN 'outgoing' ELSE 'incoming' END AS place, count(*)::BIGINT AS edges,
  count(DISTINCT CASE WHEN a AND NOT b THEN target_id WHEN b AND NOT a THEN source_id END)::BIGINT AS external FROM e WHERE a OR b GROUP BY 1""",
)
def boundary_edges(t):
    own = v.symbols(t).where("module = 'Brand#11'").select("id")
    b = graph.boundary(v.edges(t).where("edge_type <> 'CONTAINS'"), own)
    other = F.when(F.col("place") == "outgoing", F.col("target_id")).when(F.col("place") == "incoming", F.col("source_id"))
    return b.groupBy("place").agg(F.count(F.lit(1)).alias("edges"), F.countDistinct(other).alias("external"))


# --- history ------------------------------------------------------------------------------


@query(
    "file_history",
    """WITH l AS (SELECT event_type || '/' || (props::JSON->>'k') AS path, (user_id % 40)::VARCHAR AS author, ts, event_id FROM events)
SELECT path, count(*)::BIGINT AS commit_count, arg_max(author, (ts, event_id)) AS last_author, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_commit_at,
  strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_commit_at FROM l GROUP BY path""",
)
def file_history(t):
    g = v.log(t)
    # newest first: the position is the order of (ts, event_id) reversed
    pos = F.struct((-F.unix_micros(F.col("ts").cast("timestamp"))).alias("a"), (-F.col("event_id")).alias("b"))
    at = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return history.file_history(g.select("path", "author", at.alias("at"), pos.alias("position")))


@query(
    "first_and_last_events",
    """SELECT user_id, 'first' AS which, arg_min(event_type, event_id) AS event_type, min(event_id) AS event_id FROM events GROUP BY user_id
UNION ALL SELECT user_id, 'last', arg_max(event_type, event_id), max(event_id) FROM events GROUP BY user_id""",
)
def first_and_last_events(t):
    e = t.events.select("user_id", "event_type", "event_id")
    ends = [history.keep_first(e, ["user_id"], "event_id", last=last).withColumn("which", F.lit("last" if last else "first")) for last in (False, True)]
    return ends[0].union(ends[1]).select("user_id", "which", "event_type", "event_id")


@query(
    "co_change_pairs",
    """WITH c AS (SELECT DISTINCT l_orderkey AS k, l_partkey AS f FROM lineitem),
ok AS (SELECT k FROM c GROUP BY k HAVING count(*) BETWEEN 2 AND 30)
SELECT x.f AS a, y.f AS b, count(*)::BIGINT AS commits FROM c x JOIN c y ON x.k = y.k AND x.f < y.f SEMI JOIN ok ON ok.k = x.k
GROUP BY x.f, y.f HAVING count(*) >= 2 ORDER BY commits DESC, a, b LIMIT 50""",
)
def co_change_pairs(t):
    return history.co_change(t.lineitem.select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("path")), least=2)


# --- search -------------------------------------------------------------------------------

_W = {"qn": 5.0, "path": 2.0, "sig": 1.0}


@query("bm25_search", f"WITH {v.SYMBOLS}, {v.bm25_sql('sym', _W, ['red', 'wid'])} SELECT id, round(score, 6) AS score FROM hit ORDER BY hit.score, id LIMIT 20")
def bm25_search(t):
    return search.search_symbols(v.symbols(t), "Red wid").withColumn("score", F.round("score", 6))


@query(
    "bm25_documents",
    f"WITH d AS (SELECT doc_id AS id, text FROM documents), {v.bm25_sql('d', {'text': 1.0}, ['the', 'ent', 'thorre'])} SELECT id, round(score, 6) AS score FROM hit",
)
def bm25_documents(t):
    d = t.documents.select(F.col("doc_id").alias("id"), "text")
    return search.bm25(d, "the ent* thorre", {"text": 1.0}, None).withColumn("score", F.round("score", 6))


_COS = "CASE WHEN list_dot_product(p.e, p.e) = 0 OR list_dot_product(q.e, q.e) = 0 THEN 0 ELSE list_dot_product(p.e, q.e) / (sqrt(list_dot_product(p.e, p.e)) * sqrt(list_dot_product(q.e, q.e))) END"


@query(
    "vector_topk",
    f"""WITH p AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT e FROM p WHERE id = 0)
SELECT p.id, round({_COS}, 6) AS score FROM p, q ORDER BY {_COS} DESC, p.id LIMIT 20""",
)
def vector_topk(t):
    one = t.embeddings.where("vec_id = 0").select(F.col("embedding").alias("q"))
    both = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")).crossJoin(F.broadcast(one))  # one row
    return search.vector_top_k(both, F.col("q")).withColumn("score", F.round("score", 6))


@query(
    "embedding_reuse",
    f"""WITH {v.PREV_CUR} SELECT CASE WHEN p.id IS NULL THEN 'embedded' ELSE 'reused' END AS how, count(*)::BIGINT AS n
FROM cur c LEFT JOIN prev p ON p.id = c.id AND p.content_hash = c.content_hash GROUP BY 1""",
)
def embedding_reuse(t):
    def as_symbols(df):
        sid = F.concat(F.lit("sym_"), F.lpad(F.col("id").cast("string"), 32, "0"))
        return df.select(
            sid.alias("id"), F.lit("s").alias("snapshot_id"), F.lit("function").alias("kind"), F.col("content_hash").alias("qualified_name"),
            F.lit(None).cast("string").alias("signature"), F.col("source").alias("path"),
        )

    def embed(df):
        return df.withColumn("vector", F.array(F.length("text").cast("double")))

    none = t.spark.createDataFrame([], "point_id string, text_hash string, model string, vector array<double>")
    cache, _ = search.index_symbols(as_symbols(v.previous(t)), none, "m", embed)
    points, new = search.index_symbols(as_symbols(v.current(t)), cache, "m", embed)
    how = points.join(new.select("point_id", F.lit("embedded").alias("how")), "point_id", "left").select(F.coalesce("how", F.lit("reused")).alias("how"))
    return how.groupBy("how").agg(F.count(F.lit(1)).alias("n"))


_LISTS = f"""{v.SYMBOLS}, {v.edges_sql()}, {v.bm25_sql("sym", _W, ["red", "wid"])},
fts AS (SELECT id, row_number() OVER (ORDER BY score, id) AS rank FROM (SELECT * FROM hit ORDER BY score, id LIMIT 20)),
p AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT e FROM p WHERE id = 0),
near AS (SELECT p.id, {_COS} AS score FROM p, q ORDER BY score DESC, p.id LIMIT 20),
vec AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM near SEMI JOIN sym ON sym.id = near.id),
cand AS (SELECT id FROM fts UNION SELECT id FROM vec),
fan AS (SELECT target_id AS id, count(*) AS n FROM edge SEMI JOIN cand ON cand.id = edge.target_id GROUP BY target_id),
lists AS (SELECT id, 'fts' AS source, rank, 1.0 AS w FROM fts UNION ALL SELECT id, 'vector', rank, 1.0 FROM vec
  UNION ALL SELECT id, 'graph', row_number() OVER (ORDER BY n DESC, id), 0.5 FROM fan),
fused AS (SELECT id, sum(w / (60 + rank)) AS s, list_sort(list(DISTINCT source)) AS sources FROM lists GROUP BY id),
bonus AS (SELECT f.id, qn, path, sources, lower(kind || ' ' || qn || ' ' || sig || ' — ' || path) AS low,
  s + pow((contains(low, 'red')::INT + contains(low, 'wid')::INT) / 2.0, 2) * 0.03 AS s FROM fused f JOIN sym ON sym.id = f.id)"""


@query("rrf_fusion", f"WITH {_LISTS} SELECT id, round(s, 6) AS score, array_to_string(sources, '+') AS sources FROM bonus")
def rrf_fusion(t):
    s = v.symbols(t)
    lists = search.ranked(search.search_symbols(s, "red wid"), "fts", False)
    one = t.embeddings.where("vec_id = 0").select(F.col("embedding").alias("q"))
    pts = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")).crossJoin(F.broadcast(one))
    near = search.vector_top_k(pts, F.col("q")).join(s.select("id"), "id", "left_semi")
    lists = lists.union(search.ranked(near, "vector", True))
    lists = lists.union(search.graph_signal(lists.select("id").distinct(), v.edges(t)))
    text = fx.symbol_text(F.col("kind"), F.col("qualified_name"), F.col("signature"), F.col("path"))
    out = search.fuse(lists).join(s.select("id", text.alias("text")), "id")
    score = F.round(F.col("score") + fx.coverage_bonus(F.col("text"), ["red", "wid"]), 6)
    return out.select("id", score.alias("score"), F.array_join("sources", "+").alias("sources"))


@query(
    "hybrid_search",
    f"""WITH {_LISTS}, top AS (SELECT * FROM bonus ORDER BY s DESC, id LIMIT 20),
re AS (SELECT *, (contains(low, 'red')::INT + contains(low, 'wid')::INT) / 2.0 AS score, count(*) OVER () AS n FROM top)
SELECT id, qn AS qualified_name, path, round(CASE WHEN n > 1 THEN score ELSE s END, 6) AS score,
  array_to_string(CASE WHEN n > 1 THEN sources || ['rerank'] ELSE sources END, '+') AS sources
FROM re ORDER BY CASE WHEN n > 1 THEN re.score ELSE s END DESC, id LIMIT 8""",
)
def hybrid_search(t):
    one = t.embeddings.where("vec_id = 0").select(F.col("embedding").alias("q"))
    pts = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")).crossJoin(F.broadcast(one))
    out = search.hybrid_search(v.symbols(t), v.edges(t), "red wid", pts, F.col("q"), search.keyword_reranker)
    return out.withColumn("score", F.round("score", 6)).withColumn("sources", F.array_join("sources", "+"))


@query(
    "federated_search",
    f"""WITH d AS (SELECT doc_id AS id, text, source FROM documents), {v.bm25_sql("d", {"text": 1.0}, ["the"])},
per AS (SELECT source AS repo, h.id, -score AS score, row_number() OVER (PARTITION BY source ORDER BY score, h.id) AS r FROM hit h JOIN d ON d.id = h.id),
x AS (SELECT * FROM per WHERE r <= 8)
SELECT repo, id, round(score, 6) AS score, least(20, (SELECT count(*) FROM x))::BIGINT AS shown, (SELECT count(*) FROM x)::BIGINT AS total
FROM x ORDER BY x.score DESC, repo, id LIMIT 20""",
)
def federated_search(t):
    d = t.documents.select(F.col("doc_id").alias("id"), "text", "source")
    hits = search.bm25(d, "the", {"text": 1.0}, None).join(d.select("id", F.col("source").alias("repo")), "id").withColumn("score", -F.col("score"))
    each = hits.withColumn("r", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("score"), "id"))).where("r <= 8").drop("r")
    out = search.federated(each, 20)
    return out.select("repo", "id", F.round("score", 6).alias("score"), F.col("shown").cast("long").alias("shown"), "total")


# --- policies -----------------------------------------------------------------------------


def _facts(t):
    e = v.edges(t).withColumn("edge_type", F.when(F.col("edge_type") == "CONTAINS", "IMPORTS").otherwise(F.col("edge_type")))
    s = v.symbols(t)
    e = e.withColumn("evidence_json", F.to_json(F.struct(F.concat(F.lit("p"), F.col("source_id").cast("string")).alias("path"), F.lit(1).alias("line"))))
    return {"edges": e, "symbols": s, "owners": s.select("id", "module")}


@query(
    "module_cycles",
    f"""WITH {v.SYMBOLS}, {v.edges_sql()},
m AS (SELECT a.module AS f, b.module AS t, min((source_id, target_id)) AS e FROM edge JOIN sym a ON a.id = source_id JOIN sym b ON b.id = target_id
  WHERE edge_type = 'CONTAINS' AND a.module <> b.module GROUP BY ALL)
SELECT x.f || ' <-> ' || x.t AS subject, 'p' || x.e[1] AS first_path, 'p' || y.e[1] AS back_path FROM m x JOIN m y ON x.f = y.t AND x.t = y.f WHERE x.f < x.t""".replace("x.e[1]", "struct_extract(x.e, 1)").replace("y.e[1]", "struct_extract(y.e, 1)"),
)
def module_cycles(t):
    c = policy.module_cycle(_facts(t), {})
    return c.select("subject", F.col("evidence")[0]["path"].alias("first_path"), F.col("evidence")[1]["path"].alias("back_path"))


@query(
    "high_fan_in",
    f"""WITH {v.SYMBOLS}, {v.edges_sql()}, h AS (SELECT target_id, count(*) AS n FROM edge WHERE edge_type <> 'CONTAINS' GROUP BY target_id HAVING count(*) >= 55)
SELECT qn AS subject, qn || ' is used by ' || n || ' references' AS claim, path, start_line AS line FROM h JOIN sym ON sym.id = target_id""",
)
def high_fan_in(t):
    c = policy.high_fan_in({"edges": v.edges(t), "symbols": v.symbols(t)}, {"threshold": 55})
    return c.select("subject", "claim", F.col("evidence")[0]["path"].alias("path"), F.col("evidence")[0]["line"].alias("line"))


@query(
    "untested_modules",
    """WITH f AS (SELECT d.doc_id AS id, source || '/' || lang AS module, source || '/' || lang || '/' || d.doc_id || '.ts' AS path FROM documents d),
t AS (SELECT DISTINCT module FROM f JOIN labels l ON l.doc_id = f.id WHERE l.toxic = 1)
SELECT module, count(*)::BIGINT AS symbols FROM f ANTI JOIN t ON t.module = f.module GROUP BY module HAVING count(*) >= 5""",
)
def untested_modules(t):
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".ts")))
    f = t.documents.select(F.col("doc_id").alias("id"), path.alias("path"), F.concat_ws("/", "source", "lang").alias("module"))
    e = t.labels.where("toxic = 1").select(F.col("doc_id").alias("source_id"), F.lit("TESTED_BY").alias("edge_type"))
    facts = {"files": f.select("id", "path"), "owners": f.select("id", "module"), "edges": e, "symbols": f.select("path", F.lit(1).alias("start_line"))}
    c = policy.untested_module(facts, {"minSymbols": 5})
    return c.select("module", F.regexp_extract("claim", r"has (\d+) symbols", 1).cast("long").alias("symbols"))


@query(
    "forbidden_imports",
    """WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)
SELECT 'pages/' || page_id || '.ts' AS subject, href AS specifier, count(*)::BIGINT AS n FROM h
WHERE page_id % 10 < 5 AND regexp_matches(href, '^/[Tt]h') GROUP BY ALL""",
)
def forbidden_imports(t):
    h = t.pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    path = F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".ts"))
    e = h.select(
        F.concat(F.lit("repo://r/"), path).alias("source_id"), F.lit("repo://r/x.ts").alias("target_id"), F.lit("IMPORTS").alias("edge_type"),
        F.to_json(F.struct(path.alias("path"), F.lit(1).alias("line"), F.col("href").alias("specifier"))).alias("evidence_json"),
    )
    c = policy.forbidden_import({"edges": e}, {"from": r"^pages/\d*[0-4]\.ts$", "to": "^/[Tt]h"})
    return c.groupBy("subject", F.col("evidence")[0]["detail"].alias("specifier")).agg(F.count(F.lit(1)).alias("n"))


_SEV = "['info', 'low', 'medium', 'high', 'critical'][(doc_id % 5 + 1)::INT]"


@query(
    "findings_filter",
    f"""SELECT l.doc_id AS id, {_SEV.replace('doc_id', 'l.doc_id')} AS severity, d.source AS module,
  CASE WHEN length(d.text) > 300 THEN substr(d.text, 1, 300) || '… [preview]' ELSE d.text END AS excerpt
FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE l.quality = 1 AND l.doc_id % 5 >= 3 AND d.source = 'src3'""",
)
def findings_filter(t):
    sev = F.element_at(F.array(*map(F.lit, ("info", "low", "medium", "high", "critical"))), (F.col("doc_id") % 5 + 1).cast("int"))
    status = F.when(F.col("quality") == 1, "confirmed").otherwise("rejected")
    f = t.labels.select(F.col("doc_id").alias("id"), sev.alias("severity"), status.alias("status"))
    f = f.join(t.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("module"), "text"), "id")
    return policy.findings_where(f, ["high", "critical"], "src3").select("id", "severity", "module", fx.preview(F.col("text")).alias("excerpt"))


@query(
    "policy_verdicts",
    f"""WITH {v.SYMBOLS}, {v.edges_sql()}, h AS (SELECT target_id, count(*) AS n FROM edge WHERE edge_type <> 'CONTAINS' GROUP BY target_id HAVING count(*) >= 50),
c AS (SELECT qn, qn || ' is used by ' || n || ' references' AS claim FROM h JOIN sym ON sym.id = target_id),
i AS (SELECT claim, row_number() OVER (ORDER BY qn, claim) - 1 AS idx FROM c)
SELECT CASE WHEN l.quality = 1 THEN 'confirmed' ELSE 'rejected' END AS status, count(*)::BIGINT AS n FROM i JOIN labels l ON l.doc_id = i.idx GROUP BY 1""",
)
def policy_verdicts(t):
    p = policy.Policy("fan-in", "medium", [("high_fan_in", {"threshold": 50})])
    c = policy.candidates(p, {"edges": v.edges(t), "symbols": v.symbols(t)})
    said = t.labels.select(F.col("doc_id").cast("int").alias("index"), (F.col("quality") == 1).alias("confirmed"), F.lit(0.9).alias("confidence"), F.lit("").alias("recommendation"))
    return policy.judged(c, said).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


# --- analysis, packing --------------------------------------------------------------------


@query(
    "summary_cache_latest",
    """SELECT conv_id AS subject_id, role AS level, turn AS id, text AS content_json FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC, text DESC) AS r FROM conversations) WHERE r = 1""",
)
def summary_cache_latest(t):
    s = t.conversations.select(
        F.col("conv_id").alias("subject_id"), F.col("role").alias("level"), F.lit("h").alias("content_hash"), F.lit("1").alias("prompt_version"),
        F.lit("m").alias("model"), F.col("turn").alias("created_at"), F.col("text").alias("id"), F.col("text").alias("content_json"),
    )
    return analysis.latest_summaries(s).select("subject_id", "level", F.col("created_at").alias("id"), "content_json")


@query(
    "cached_work",
    """WITH w AS (SELECT conv_id, turn % 3 AS h FROM conversations GROUP BY ALL),
s AS (SELECT conv_id, turn % 3 AS h, max((turn, text)) AS last FROM conversations WHERE role <> 'system' AND conv_id % 4 <> 0 GROUP BY ALL)
SELECT w.conv_id AS subject_id, w.h::VARCHAR AS content_hash, s.conv_id IS NOT NULL AS hit, struct_extract(s.last, 2) AS content_json FROM w LEFT JOIN s ON s.conv_id = w.conv_id AND s.h = w.h""",
)
def cached_work(t):
    c = t.conversations
    key = [F.col("conv_id").alias("subject_id"), F.lit("module").alias("level"), (F.col("turn") % 3).cast("string").alias("content_hash"), F.lit("1").alias("prompt_version"), F.lit("m").alias("model")]
    done = c.where("role <> 'system' and conv_id % 4 <> 0").select(*key, F.col("text").alias("content_json"), F.col("turn").alias("created_at"), F.col("text").alias("id"), F.lit("s").alias("snapshot_id"))
    hits, misses = analysis.work_list(c.select(*key).distinct(), done)
    out = hits.select("subject_id", "content_hash", F.lit(True).alias("hit"), "content_json")
    return out.union(misses.select("subject_id", "content_hash", F.lit(False), F.lit(None).cast("string")))


@query(
    "evidence_fingerprint",
    f"""WITH {v.FILES} SELECT source || '/' || lang AS module,
  sha256('{{"files":[' || string_agg('{{"path":"' || path || '","hash":"' || content_hash || '"}}', ',' ORDER BY path) || ']}}') AS fingerprint FROM file GROUP BY 1""",
)
def evidence_fingerprint(t):
    f = v.files(t).select(F.concat_ws("/", "source", "lang").alias("module"), "path", "content_hash")
    return history.fingerprint(f, "module", {"files": F.struct("path", F.col("content_hash").alias("hash"))})


_COST = "greatest(ceil(length(text) / 4.0), 1)::BIGINT"


@query(
    "budget_pack",
    f"""WITH RECURSIVE i AS (SELECT conv_id, turn, {_COST} AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS r FROM conversations),
p(conv_id, r, used, kept) AS (
  SELECT conv_id, 0::BIGINT, 0::BIGINT, ''::VARCHAR FROM i GROUP BY conv_id
  UNION ALL SELECT p.conv_id, i.r, CASE WHEN used + c <= 300 THEN used + c ELSE used END, CASE WHEN used + c <= 300 THEN kept || turn || ' ' ELSE kept END
  FROM p JOIN i ON i.conv_id = p.conv_id AND i.r = p.r + 1)
SELECT conv_id, rtrim(kept) AS kept, used, (r - len(string_split(rtrim(kept), ' ')) + CASE WHEN kept = '' THEN 1 ELSE 0 END)::BIGINT AS dropped
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY r DESC) AS n FROM p) WHERE n = 1""",
)
def budget_pack(t):
    c = t.conversations.select("conv_id", F.struct("turn", "text").alias("o"), piece_count(F.col("text")).alias("c"), "turn")
    out = packing.greedy_pack(c, "conv_id", "o", "c", 300, "turn")
    return out.select("conv_id", F.array_join(F.col("kept").cast("array<string>"), " ").alias("kept"), "used", F.col("dropped").cast("long").alias("dropped"))


@query(
    "budget_range_prefix",
    f"""WITH {v.FILES}, l AS (SELECT id, path, len(string_split(text, chr(10))) AS total, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM file),
s AS (SELECT *, sum(greatest(ceil(length((n::VARCHAR || chr(9) || x)) / 4.0), 1)) OVER (PARTITION BY id ORDER BY n) AS used FROM l WHERE n BETWEEN 2 AND 12),
k AS (SELECT id, count(*) AS c FROM s WHERE used <= 200 GROUP BY id)
SELECT f.path, 2::INT AS from_line, (1 + coalesce(c, 0))::INT AS to_line, 1 + coalesce(c, 0) < len(string_split(text, chr(10))) AS more FROM file f LEFT JOIN k ON k.id = f.id""",
)
def budget_range_prefix(t):
    return packing.line_range(v.files(t).select("path", "text"), 2, 12, budget=200).select("path", "from_line", "to_line", "more")


@query(
    "section_round_robin",
    f"""WITH RECURSIVE g AS (SELECT source AS module, lang AS section, least(sum({_COST}), 100000)::BIGINT AS c FROM documents GROUP BY ALL),
i AS (SELECT *, row_number() OVER (ORDER BY section, module) AS r FROM g),
p(r, used, kept, n) AS (SELECT 0::BIGINT, 0::BIGINT, ''::VARCHAR, 0::BIGINT UNION ALL
  SELECT i.r, CASE WHEN used + c <= 200000 THEN used + c ELSE used END, CASE WHEN used + c <= 200000 THEN kept || section || ':' || module || ' ' ELSE kept END,
    n + (used + c <= 200000)::INT FROM p JOIN i ON i.r = p.r + 1)
SELECT rtrim(kept) AS kept, used, (r - n)::BIGINT AS dropped FROM p ORDER BY r DESC LIMIT 1""",
)
def section_round_robin(t):
    g = t.documents.groupBy(F.col("source").alias("module"), F.col("lang").alias("section")).agg(F.least(F.sum(piece_count(F.col("text"))), F.lit(100000)).alias("c"))
    out = packing.round_robin(g.withColumn("group", F.lit("repo")), F.col("section"), "c", 200000)
    return out.select(F.array_join("kept", " ").alias("kept"), "used", F.col("dropped").cast("long").alias("dropped"))


@query(
    "token_savings",
    f"""WITH c AS (SELECT source, sum({_COST}) AS b, sum(least({_COST}, 100)) AS x, sum(least({_COST}, 25)) AS m, count(*) AS req, count(*) FILTER ({_COST} <= 100) AS cmp FROM documents GROUP BY source),
s AS (SELECT sum(b)::BIGINT AS baseline, sum(x)::BIGINT AS context, sum(m)::BIGINT AS map_only, sum(cmp)::BIGINT AS complete, sum(req)::BIGINT AS requested FROM c)
SELECT *, baseline - context AS saved, floor((baseline - context) * 1000.0 / greatest(baseline, 1) + 0.5) / 10 AS percent FROM s""",
)
def token_savings(t):
    c = piece_count(F.col("text"))
    d = t.documents.select("source", c.alias("c"))
    n = d.groupBy("source").agg(
        F.sum("c").alias("baseline"), F.sum(F.least("c", F.lit(100))).alias("context"), F.sum(F.least("c", F.lit(25))).alias("map_only"),
        F.count_if(F.col("c") <= 100).alias("complete"), F.count(F.lit(1)).alias("requested"),
    )
    return history.savings(n).withColumn("percent", F.col("percent").cast("double"))


@query(
    "evidence_json",
    "SELECT event_type AS path, (props::JSON->>'k')::INT AS line, count(*)::BIGINT AS n, count(*) FILTER (props::JSON->>'specifier' IS NULL)::BIGINT AS bare FROM events GROUP BY ALL",
)
def evidence_json(t):
    j = F.to_json(F.struct(F.col("event_type").alias("path"), F.get_json_object("props", "$.k").alias("line")))
    e = t.events.select(fx.edge_evidence(j).alias("e"))
    return e.groupBy("e.path", "e.line").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("e.specifier").isNull()).alias("bare"))
