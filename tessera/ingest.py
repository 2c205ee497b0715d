"""Scan a repository into a snapshot, and refresh one incrementally."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schema
from tessera.catalog import Store
from tessera.functions.text import basename, dirname, is_test_path
from tessera.operators import graph, history, resolve
from tessera.sources import files as source_files
from tessera.sources import git, scip

#: Files that make their directory a module.
MANIFESTS = ("package.json", "pyproject.toml", "setup.py")


def find_modules(paths: DataFrame, repository: str) -> DataFrame:
    """``id, name, path``: directories with a manifest; without any, the root.

    The root is named after the repository, others after their directory."""
    repo = F.lit(repository)
    dirs = paths.where(basename(F.col("path")).isin(*MANIFESTS)).select(dirname(F.col("path")).alias("path")).distinct()
    root = paths.sparkSession.createDataFrame([(".",)], "path string")
    none = dirs.agg(F.count(F.lit(1)).alias("n")).where("n = 0")
    every = dirs.union(root.join(none, F.lit(True)).select("path"))
    name = F.when(F.col("path") == ".", repo).otherwise(basename(F.col("path")))
    return every.select(schema.module_uri(repo, F.col("path")).alias("id"), name.alias("name"), "path")


def build_facts(spark: SparkSession, root: str, repository: str, occurrences: DataFrame | None = None, relationships: DataFrame | None = None) -> dict[str, DataFrame]:
    """All fact tables of the working tree as DataFrames, without snapshot ids."""
    repo = F.lit(repository)
    rid = schema.repository_id(repo)
    tracked = spark.createDataFrame([(p,) for p in git.tracked_files(root)], "path string")
    parsed = graph.cut(source_files.extract(source_files.read_files(spark, os.path.realpath(root), tracked)))
    log = git.history(spark, root)
    hist = history.file_history(log)
    f = parsed.join(hist, "path", "left")
    fid = schema.file_uri(repo, F.col("path"))
    files = f.select(fid.alias("id"), rid.alias("repository_id"), "path", "language", "content_hash", "line_count", "last_author", "last_commit_at")

    s = parsed.select("path", F.posexplode("symbols").alias("o", "s")).select("path", "o", "s.*")
    sid = schema.symbol_id(repo, F.col("path"), F.col("kind"), F.col("qualified_name"), F.col("signature"))
    s = s.withColumn("id", sid)
    symbols = history.keep_first(s, ["id"], "o").select(
        "id", rid.alias("repository_id"), "path", "qualified_name", "kind", "signature", "start_line", "end_line", "content_hash", "source", "parent"
    )
    symbols = graph.cut(symbols)
    owner = schema.symbol_id(repo, F.col("path"), F.lit("class"), F.col("parent"), F.lit(None).cast("string"))

    def edge(df, source, target, kind, confidence, analyzer, evidence=None):
        ev = evidence if evidence is not None else F.lit(None).cast("string")
        return df.select(
            source.alias("source_id"), target.alias("target_id"), F.lit(kind).alias("edge_type") if isinstance(kind, str) else kind.alias("edge_type"),
            F.lit(confidence).alias("confidence"), F.lit(analyzer).alias("analyzer"), ev.alias("evidence_json"),
        )

    def place(path, line, **more):
        return F.to_json(F.struct(path.alias("path"), line.alias("line"), *[c.alias(n) for n, c in more.items()]))

    contains = edge(symbols, F.when(F.col("parent").isNotNull(), owner).otherwise(fid), F.col("id"), "CONTAINS", 1.0, "tree", place(F.col("path"), F.col("start_line")))
    imports = parsed.select("path", F.explode("imports").alias("i")).select("path", "i.specifier", "i.start_line")
    paths = files.select("path")
    ts = resolve.resolve_imports(imports.where(~F.col("path").endswith(".py")), paths)
    py = resolve.resolve_python_imports(imports.where(F.col("path").endswith(".py")), paths)
    hit = ts.unionByName(py).where("target is not null")
    tid = schema.file_uri(repo, F.col("target"))
    ev = place(F.col("path"), F.col("start_line"), specifier=F.col("specifier"))
    imported = edge(hit, fid, tid, "IMPORTS", 1.0, "tree", ev)
    from_test = hit.where(is_test_path(F.col("path")))
    by = F.to_json(F.struct(F.col("path").alias("testPath"), "specifier"))
    tested = edge(from_test, tid, fid, "TESTED_BY", 0.8, "convention", by)

    modules = find_modules(tracked, repository).withColumn("repository_id", rid)
    owned = resolve.owning_module(files.select("id", "path"), modules).where("module is not null")
    in_module = edge(owned.withColumn("m", schema.module_uri(repo, F.col("module"))), F.col("m"), F.col("id"), "CONTAINS", 1.0, "manifest")
    every = [contains, imported, tested, in_module]
    metrics = []
    if occurrences is not None:
        refs = resolve.reference_edges(occurrences, symbols)
        every.append(edge(refs, F.col("source_id"), F.col("target_id"), F.col("edge_type"), 0.9, "scip", place(F.col("path"), F.col("line"))))
        if relationships is not None:
            rel = resolve.relationship_edges(relationships, occurrences, symbols)
            every.append(edge(rel, F.col("source_id"), F.col("target_id"), F.col("edge_type"), 0.95, "scip"))
        lost = resolve.unmapped_definitions(occurrences, symbols)
        metrics.append(lost.select(rid.alias("subject_id"), F.lit("unmapped_definitions").alias("name"), F.col("unmapped_definitions").cast("double").alias("value"), F.lit("scip").alias("analyzer")))
    edges = every[0]
    for x in every[1:]:
        edges = edges.unionByName(x)
    order = F.struct(F.coalesce("evidence_json", F.lit("")), "confidence")
    edges = history.keep_first(edges.withColumn("o", order), ["source_id", "target_id", "edge_type", "analyzer"], "o", last=True).drop("o")

    tests = parsed.select("path", F.posexplode("tests").alias("o", "t")).select(schema.test_id(F.col("path"), F.col("t.name")).alias("id"), "path", "t.name", "o")
    tests = history.keep_first(tests, ["id"], "o").drop("o")
    counted = hist.join(paths, "path", "left_semi")
    metrics.append(counted.select(fid.alias("subject_id"), F.lit("commit_count").alias("name"), F.col("commit_count").cast("double").alias("value"), F.lit("git").alias("analyzer")))
    pairs = history.co_change(log.select("commit", "path"))
    metrics.append(
        pairs.select(schema.file_uri(repo, F.col("a")).alias("subject_id"), F.concat(F.lit("co_change:"), "b").alias("name"), F.col("commits").cast("double").alias("value"), F.lit("git").alias("analyzer"))
    )
    all_metrics = metrics[0]
    for m in metrics[1:]:
        all_metrics = all_metrics.unionByName(m)
    return {"files": files, "modules": modules, "symbols": symbols.drop("parent"), "edges": edges, "tests": tests, "metrics": all_metrics}


def scan(spark: SparkSession, root: str, store: Store, name: str | None = None, index: bytes | None = None) -> dict:
    """Scan a working tree into a new snapshot; counts of what was written."""
    name = name or os.path.basename(os.path.realpath(root))
    occ, rel = scip.tables(spark, index) if index else (None, None)
    facts = build_facts(spark, root, name, occ, rel)
    repo = store.upsert_repository(name, os.path.realpath(root))
    sid = store.commit_snapshot(repo["id"], git.head(root), facts)
    counts = {r["name"]: r["rows"] for r in history.snapshot_counts({t: store.read(t) for t in facts}, sid).collect()}
    return {"repository": name, "snapshot_id": sid, "commit_sha": git.head(root), "counts": counts}


@dataclass
class Refresh:
    up_to_date: bool
    snapshot_id: str | None
    changed_files: list[str] = field(default_factory=list)
    new: int = 0
    changed: int = 0
    removed: int = 0
    modules: list[str] = field(default_factory=list)


def refresh(spark: SparkSession, root: str, store: Store, name: str | None = None, index: bytes | None = None, mark_deletions: bool = False) -> Refresh:
    """Scan again if anything tracked changed since the last snapshot, and tell what it
    touches: changed symbols, their modules and modules that import a changed file.

    Symbols that only went away mark no module unless ``mark_deletions``.
    """
    last = store.latest()
    files = []
    if last is not None:
        sha = store.read("snapshots").where(F.col("id") == last).first()["commit_sha"]
        files = git.changed_since(root, sha)
        if sha == git.head(root) and not files:
            return Refresh(True, last)
    done = scan(spark, root, store, name, index)
    cur = store.read("symbols", done["snapshot_id"])
    prev = store.read("symbols", last) if last else store.read("symbols").limit(0)
    diff = graph.cut(resolve.changed(prev, cur).select("id", "path", "change"))
    gone = resolve.removed(prev, cur)
    paths = diff.select("path")
    if mark_deletions:
        paths = paths.union(gone.select("path"))
    f = store.read("files", done["snapshot_id"]).select("id", "path")
    mods = resolve.affected_modules(paths, f, store.read("modules", done["snapshot_id"]), store.read("edges", done["snapshot_id"]))
    n = {r["change"]: r["count"] for r in diff.groupBy("change").count().collect()}
    return Refresh(False, done["snapshot_id"], files, n.get("new", 0), n.get("changed", 0), gone.count(), [r["module"] for r in mods.orderBy("module").collect()])
