"""Joins that resolve names, paths, imports, references and owners, and snapshot diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import dirname, last_segment, normalised, occurrence_name

#: What is tried after a relative import, in this order.
TS_SUFFIXES = ("", ".ts", ".tsx", ".js", "/index.ts", "/index.tsx")
PY_SUFFIXES = (".py", "/__init__.py")


# --- names -------------------------------------------------------------------------


def resolve_name(symbols: DataFrame, names: DataFrame) -> DataFrame:
    """``name, id, how``: an exact match, else the suffix ``.name``, else any case; the
    first by path and line of the best kind.  One join per kind keeps them equi-joins.

    A qualified name decides alone what it matches, so only its first symbol goes into the
    joins: a name that many symbols share is one row there.
    """
    s = symbols.groupBy("qualified_name").agg(F.min(F.struct("path", "start_line", "id")).alias("m")).select("qualified_name", "m.*")
    n = names.toDF("name").distinct()
    exact = n.join(s, F.col("name") == F.col("qualified_name")).withColumn("how", F.lit(0))
    # every dotted suffix of a qualified name is a key
    tails = s.withColumn("parts", F.split("qualified_name", r"\.")).where(F.size("parts") > 1)
    tails = tails.withColumn("i", F.explode(F.sequence(F.lit(2), F.size("parts")))).withColumn(
        "tail", F.array_join(F.slice("parts", F.col("i"), F.size("parts")), ".")
    )
    suffix = n.join(tails, F.col("name") == F.col("tail")).select("name", "id", "qualified_name", "path", "start_line").withColumn("how", F.lit(1))
    anycase = n.join(s, F.lower("name") == F.lower("qualified_name")).withColumn("how", F.lit(2))
    every = exact.unionByName(suffix).unionByName(anycase)
    first = F.min(F.struct("how", "path", "start_line", "id"))
    return every.groupBy("name").agg(first.alias("m")).select("name", "m.id", F.element_at(F.array(*map(F.lit, ("exact", "suffix", "case"))), F.col("m.how") + 1).alias("how"))


def resolve_unique(symbols: DataFrame, names: DataFrame) -> DataFrame:
    """``name, id, matches``: id or qualified name must match one symbol; else id is null."""
    n = names.toDF("name").distinct()
    by_id = n.join(symbols.select("id"), F.col("name") == F.col("id").cast("string"))
    by_name = n.join(symbols.select("id", "qualified_name"), F.col("name") == F.col("qualified_name")).select("name", "id")
    hits = by_id.union(by_name).distinct().groupBy("name").agg(F.count(F.lit(1)).alias("matches"), F.min("id").alias("one"))
    out = n.join(hits, "name", "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    return out.select("name", F.when(F.col("matches") == 1, F.col("one")).alias("id"), "matches")


def require_unique(symbols: DataFrame, names: list[str]) -> list:
    """Ids of the names; raises for one that is unknown or ambiguous."""
    if not names:
        return []
    spark = symbols.sparkSession
    got = {r["name"]: r for r in resolve_unique(symbols, spark.createDataFrame([(x,) for x in names], "name string")).collect()}
    for x in names:
        if got[x]["matches"] != 1:
            raise LookupError(f"unknown or ambiguous symbol {x!r}: {got[x]['matches']} matches")
    return [got[x]["id"] for x in names]


# --- owners and imports ------------------------------------------------------------


def ancestors(path: Column) -> Column:
    """``a/b/c.ts`` to [``a/b``, ``a``, ``.``]."""
    parts = F.split(path, "/")
    up = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return F.when(F.size(parts) > 1, F.concat(F.reverse(up), F.array(F.lit(".")))).otherwise(F.array(F.lit(".")))


def owning_module(files: DataFrame, modules: DataFrame, path_col: str = "path") -> DataFrame:
    """Add ``module`` (path of the owner): the longest directory that is a module.

    Ancestors are exploded and meet modules in an equi-join; files that no module
    covers get null.
    """
    keyed = files.select(F.col(path_col).alias("__p")).distinct().select("__p", F.posexplode(ancestors(F.col("__p"))).alias("__i", "__dir"))
    own = keyed.join(modules.select(F.col("path").alias("__dir")).distinct(), "__dir").groupBy("__p").agg(F.min(F.struct("__i", "__dir")).alias("__m"))
    return files.join(own, F.col(path_col) == F.col("__p"), "left").withColumn("module", F.col("__m.__dir")).drop("__p", "__m")


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Add ``target`` to ``path, specifier``: the first existing candidate of a relative import."""
    base = normalised(F.concat_ws("/", F.when(dirname(F.col("path")) == ".", F.lit("")).otherwise(dirname(F.col("path"))), F.col("specifier")))
    tries = F.transform(F.array(*[F.lit(s) for s in TS_SUFFIXES]), lambda s: F.concat(base, s))
    return _first_existing(imports, F.when(F.startswith("specifier", F.lit(".")), tries), files)


def resolve_python_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Add ``target`` to ``path, specifier``: leading dots climb; without any, the root and
    then ``src`` are tried."""
    dots = F.length(F.regexp_extract("specifier", r"^(\.*)", 1))
    rest = F.translate(F.regexp_replace("specifier", r"^\.+", ""), ".", "/")
    here = F.when(dirname(F.col("path")) == ".", F.lit("")).otherwise(dirname(F.col("path")))
    climbed = normalised(F.concat_ws("/", here, F.array_join(F.array_repeat(F.lit(".."), F.greatest(dots - 1, F.lit(0))), "/"), rest))
    bases = F.when(dots > 0, F.array(climbed)).otherwise(F.array(rest, F.concat(F.lit("src/"), rest)))
    tries = F.flatten(F.transform(bases, lambda b: F.transform(F.array(*[F.lit(s) for s in PY_SUFFIXES]), lambda s: F.concat(b, s))))
    return _first_existing(imports, tries, files)


def _first_existing(imports: DataFrame, tries: Column, files: DataFrame) -> DataFrame:
    keyed = imports.select("path", "specifier").distinct().select("path", "specifier", F.posexplode(tries).alias("__i", "__try"))
    hit = keyed.join(files.select(F.col("path").alias("__try")).distinct(), "__try").groupBy("path", "specifier").agg(F.min(F.struct("__i", "__try")).alias("__m"))
    return imports.join(hit, ["path", "specifier"], "left").withColumn("target", F.col("__m.__try")).drop("__m")


# --- ranges ------------------------------------------------------------------------


def innermost(points: DataFrame, spans: DataFrame, cell: int = 512) -> DataFrame:
    """The smallest span of a point's path that holds its line.

    ``points``: point_id, path, line; ``spans``: id, path, start_line, end_line.  Gives
    ``point_id, span_id`` for covered points.  Spans are exploded to cells of lines, so
    that the join is an equi-join on (path, cell) with few spans per key.  Ties: earlier
    start, then smaller id.
    """
    hit = _within(points.select("point_id", "path", "line"), spans, cell)
    return hit.groupBy("point_id").agg(F.min("m").alias("m")).select("point_id", "m.span_id")


def _within(points: DataFrame, spans: DataFrame, cell: int = 512) -> DataFrame:
    """Covered points with ``m``, the smallest span that holds them.  The spans of a cell
    meet a point as one list, so the join gives a row a point and nothing is grouped."""
    s = spans.where("end_line >= start_line").select(
        F.struct((F.col("end_line") - F.col("start_line")).alias("size"), "start_line", F.col("id").alias("span_id"), "end_line").alias("span"), F.col("path").alias("sp"),
        F.explode(F.sequence(F.floor(F.col("start_line") / cell), F.floor(F.col("end_line") / cell))).alias("sc"),
    )
    s = s.groupBy("sp", "sc").agg(F.collect_list("span").alias("spans"))
    p = points.withColumn("pc", F.floor(F.col("line") / cell))
    hit = p.join(s, (F.col("path") == F.col("sp")) & (F.col("pc") == F.col("sc")))
    least = F.array_min(F.filter("spans", lambda x: F.col("line").between(x["start_line"], x["end_line"])))
    return hit.withColumn("m", least).where("m is not null").drop("spans", "sp", "sc", "pc")


def map_definitions(occurrences: DataFrame, symbols: DataFrame) -> DataFrame:
    """``symbol, id``: index symbols to ours.  A definition goes to the smallest symbol of
    its file that spans its line and has its short name; a later definition replaces."""
    d = occurrences.where("is_definition").select("symbol", "path", "line", "ordinal", occurrence_name(F.col("symbol")).alias("name"))
    s = symbols.select("id", F.col("path").alias("sp"), "start_line", "end_line", last_segment(F.col("qualified_name")).alias("sn"))
    hit = d.join(s, (F.col("path") == F.col("sp")) & (F.col("name") == F.col("sn")) & F.col("line").between(F.col("start_line"), F.col("end_line")))
    best = hit.groupBy("symbol", "ordinal").agg(F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("size"), "start_line", "id")).alias("m"))
    return best.groupBy("symbol").agg(F.max_by("m.id", "ordinal").alias("id"))


def unmapped_definitions(occurrences: DataFrame, symbols: DataFrame) -> DataFrame:
    """One row: definitions that no symbol takes."""
    d = occurrences.where("is_definition").select("symbol", "path", "line", "ordinal", occurrence_name(F.col("symbol")).alias("name"))
    s = symbols.select(F.col("path").alias("sp"), "start_line", "end_line", last_segment(F.col("qualified_name")).alias("sn"))
    no = d.join(s, (F.col("path") == F.col("sp")) & (F.col("name") == F.col("sn")) & F.col("line").between(F.col("start_line"), F.col("end_line")), "left_anti")
    return no.agg(F.count(F.lit(1)).alias("unmapped_definitions"))


def reference_edges(occurrences: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges from the innermost symbol around each reference to what it refers to.

    ``source_id, target_id, edge_type, confidence, analyzer, path, line, hits``: CALLS to
    functions and methods, DEPENDS_ON else; self-references are left out; the first
    evidence of an edge stays and ``hits`` counts all.
    """
    kind = symbols.select(F.col("id").alias("target_id"), F.col("kind").alias("target_kind")).dropDuplicates(["target_id"])
    type_ = F.when(F.col("target_kind").isin("function", "method"), "CALLS").otherwise("DEPENDS_ON")
    defs = map_definitions(occurrences, symbols).withColumnRenamed("id", "target_id").join(kind, "target_id").select("symbol", "target_id", type_.alias("edge_type"))
    refs = occurrences.where("not is_definition").join(defs, "symbol").select("ordinal", "path", "line", "target_id", "edge_type")
    # a reference takes along all that its edge needs and is not shuffled again to be joined with its source
    hits = _within(refs, symbols).withColumn("source_id", F.col("m.span_id")).where("source_id <> target_id")
    first = F.min(F.struct("ordinal", "path", "line"))
    out = hits.groupBy("source_id", "target_id", "edge_type").agg(first.alias("f"), F.count(F.lit(1)).alias("hits"))
    return out.select("source_id", "target_id", "edge_type", F.lit(0.9).alias("confidence"), F.lit("scip").alias("analyzer"), "f.path", "f.line", "hits")


def relationship_edges(relationships: DataFrame, occurrences: DataFrame, symbols: DataFrame) -> DataFrame:
    """EXTENDS between classes, IMPLEMENTS else, for implementation relationships."""
    defs = map_definitions(occurrences, symbols)
    kinds = symbols.select("id", "kind").dropDuplicates(["id"])
    ends = defs.join(kinds, "id")
    r = relationships.where("is_implementation").select(F.col("source").alias("a"), F.col("target").alias("b"))
    r = r.join(ends.select(F.col("symbol").alias("a"), F.col("id").alias("source_id"), F.col("kind").alias("sk")), "a")
    r = r.join(ends.select(F.col("symbol").alias("b"), F.col("id").alias("target_id"), F.col("kind").alias("tk")), "b")
    type_ = F.when((F.col("sk") == "class") & (F.col("tk") == "class"), "EXTENDS").otherwise("IMPLEMENTS")
    return r.select("source_id", "target_id", type_.alias("edge_type"), F.lit(0.95).alias("confidence"), F.lit("scip").alias("analyzer")).distinct()


def uncovered(spans: DataFrame) -> DataFrame:
    """Spans that no other span of their path holds (larger first; of equal ones the
    smallest id stays).  A running maximum of ends replaces the interval self-join."""
    w = Window.partitionBy("path").orderBy("start_line", F.desc("end_line"), "id").rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("__end", F.max("end_line").over(w)).where("__end is null or __end < end_line").drop("__end")


# --- snapshots ---------------------------------------------------------------------


def changed(previous: DataFrame, current: DataFrame, key: str = "id", value: str = "content_hash") -> DataFrame:
    """Rows of ``current`` that are new or have another hash, with ``change``."""
    p = previous.select(F.col(key).alias("__k"), F.col(value).alias("__v"), F.lit(True).alias("__had"))
    j = current.join(p, F.col(key) == F.col("__k"), "left")
    out = j.withColumn("change", F.when(F.col("__had").isNull(), "new").when(~F.col(value).eqNullSafe(F.col("__v")), "changed"))
    return out.where("change is not null").drop("__k", "__v", "__had")


def removed(previous: DataFrame, current: DataFrame, key: str = "id") -> DataFrame:
    return previous.join(current.select(key).distinct(), key, "left_anti")


def affected_modules(changed_paths: DataFrame, files: DataFrame, modules: DataFrame, edges: DataFrame, reverse: bool = True) -> DataFrame:
    """``module, reason``: owners of changed paths, and of files that import one directly.

    Edges end in file ids.  A path that only went away marks nothing.
    """
    c = changed_paths.toDF("path").distinct()
    owned = owning_module(files, modules)
    direct = owned.join(c, "path", "left_semi").select("module", F.lit("changed").alias("reason"))
    out = direct
    if reverse:
        ids = files.join(c, "path", "left_semi").select(F.col("id").alias("target_id"))
        from_ = edges.where("edge_type = 'IMPORTS'").join(ids, "target_id", "left_semi").select(F.col("source_id").alias("id")).distinct()
        out = out.union(owned.join(from_, "id", "left_semi").select("module", F.lit("imports")))
    return out.where("module is not null").groupBy("module").agg(F.min("reason").alias("reason"))
