"""The queries a user of a scanned repository asks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera import schema
from tessera.catalog import Store
from tessera.functions.text import preview
from tessera.functions.tokens import TokenCounter, count_pieces
from tessera.operators import analysis, graph, history, packing, policy, resolve, search

MASKED = "[source hidden]"


class Engine:
    """One repository's store.  ``federation`` below asks several."""

    def __init__(self, store: Store, count: TokenCounter = count_pieces, expose_source: bool = True, embedder=None, reranker=None):
        self.store, self.count, self.expose_source = store, count, expose_source
        self.embedder, self.reranker = embedder, reranker

    # --- plumbing -------------------------------------------------------------------------

    @property
    def snapshot(self) -> str:
        sid = self.store.latest()
        if sid is None:
            raise LookupError("nothing has been scanned yet")
        return sid

    def table(self, name: str) -> DataFrame:
        return self.store.read(name, self.snapshot) if name in (*_BY,) else self.store.read(name)

    def _resolve(self, name: str) -> str:
        names = self.store.spark.createDataFrame([(name,)], "name string")
        row = resolve.resolve_name(self.table("symbols"), names).first()
        if row is None:
            raise LookupError(f"no symbol {name!r}")
        return row["id"]

    def facts(self) -> dict[str, DataFrame]:
        files, symbols, edges, modules = (self.table(t) for t in ("files", "symbols", "edges", "modules"))
        owned = resolve.owning_module(files.select("id", "path"), modules)
        inside = symbols.select("id", "path").join(owned.select("path", "module"), "path").select("id", "module")
        return {"files": files, "symbols": symbols, "edges": edges, "modules": modules, "owners": owned.select("id", "module").union(inside).where("module is not null")}

    # --- reads ----------------------------------------------------------------------------

    def overview(self) -> dict:
        counts = history.snapshot_counts({t: self.store.read(t) for t in ("files", "symbols", "edges", "modules", "tests", "metrics")}, self.snapshot)
        brief = self.store.read("summaries").where("level = 'repository'").orderBy(F.desc("created_at")).select("content_json").first()
        names = [r["name"] for r in self.table("modules").orderBy("path").select("name").collect()]
        return {"counts": {r["name"]: r["rows"] for r in counts.collect()}, "modules": names, "brief": brief[0] if brief else None}

    def module_context(self, name: str) -> dict:
        """Dossier and confirmed findings of the one module with that name or path."""
        rows = self.table("modules").where((F.col("name") == name) | (F.col("path") == name)).collect()
        if len(rows) != 1:
            raise LookupError(f"module {name!r} is unknown or ambiguous; use its path")
        m = rows[0]
        s = self.store.read("summaries").where((F.col("subject_id") == m["id"]) & (F.col("level") == "module")).orderBy(F.desc("created_at")).first()
        return {"module": m["name"], "path": m["path"], "dossier": s["content_json"] if s else None, "findings": self.findings(module=m["path"])}

    def symbol_context(self, name: str, limit: int = 20) -> dict:
        sid = self._resolve(name)
        s = self.table("symbols").where(F.col("id") == sid).first()
        rel = graph.neighbourhood(self.table("edges"), self.table("symbols"), sid, limit).orderBy("direction", "rank")
        return {k: s[k] for k in ("id", "qualified_name", "kind", "signature", "path", "start_line", "end_line")} | {"relations": [r.asDict() for r in rel.collect()]}

    def find_callers(self, name: str, depth: int = 3) -> list[list[str]]:
        """Names of callers, a list for each distance."""
        start = self.store.spark.createDataFrame([(self._resolve(name),)], "id string")
        found = graph.callers_by_depth(self.table("edges"), start, depth)
        named = found.join(self.table("symbols").select("id", "qualified_name"), "id", "left")
        rows = named.select("depth", F.coalesce("qualified_name", "id").alias("n")).collect()
        return [sorted(r["n"] for r in rows if r["depth"] == d) for d in range(1, max([r["depth"] for r in rows], default=0) + 1)]

    def findings(self, severities: list[str] | None = None, module: str | None = None) -> list[dict]:
        """Confirmed findings, the gravest first, each with its first three pieces of evidence."""
        f = policy.findings_where(self.store.findings(), severities, module)
        rank = F.array_position(F.array(*map(F.lit, schema.SEVERITIES)), F.col("severity"))
        rows = [r.asDict() for r in f.orderBy(F.desc(rank), "created_at", "id").collect()]
        first = F.row_number().over(Window.partitionBy("owner_id").orderBy("path", "start_line", "id"))
        e = self.store.read("evidence").where("owner_kind = 'finding'").join(f.select(F.col("id").alias("owner_id")), "owner_id", "left_semi")
        top: dict[str, list[dict]] = {}
        for r in e.withColumn("n", first).where("n <= 3").orderBy("owner_id", "n").collect():
            top.setdefault(r["owner_id"], []).append({"path": r["path"], "start_line": r["start_line"], "excerpt": shown(r["excerpt"] or "") if self.expose_source else MASKED})
        return [r | {"evidence": top.get(r["id"], [])} for r in rows]

    def get_evidence(self, finding_id: str | None = None, path: str | None = None, start: int = 1, end: int | None = None) -> list[dict]:
        """A finding's evidence, or lines of an indexed file within 2,000 tokens."""
        if finding_id is not None:
            e = self.store.read("evidence").where(F.col("owner_id") == finding_id)
            rows = [r.asDict() for r in e.orderBy("path", "start_line").collect()]
            return [r | {"excerpt": r["excerpt"] if self.expose_source else MASKED} for r in rows]
        if not self.expose_source:
            return [{"path": path, "text": MASKED}]
        text = self._source(path)
        lines = text.split("\n")
        last = min(end if end is not None else start + 20, start + 199, len(lines))
        while last >= start:
            shown = "\n".join(f"{i}\t{lines[i - 1]}" for i in range(start, last + 1))
            if self.count(shown) <= 2000:
                break
            last -= 1
        else:
            shown = ""
        return [{"path": path, "from_line": start, "to_line": last, "text": shown, "more": last < len(lines)}]

    def _source(self, path: str) -> str:
        row = self.table("files").where(F.col("path") == path).select("content_hash").first()
        root = self.store.repository()["root_path"]
        return packing.read_source(root, path, row["content_hash"] if row else None)

    def search(self, query: str, limit: int = 8) -> DataFrame:
        if not 1 <= limit <= 20:
            raise ValueError("limit is 1 to 20")
        points = vector = None
        if self.embedder is not None:
            points = self.table("vectors").where(F.col("model") == self.embedder.model_key)
            vector = self.embedder.embed([query])[0]
        return search.hybrid_search(self.store.read("symbols"), self.table("edges"), query, points, vector, self.reranker, self.snapshot, limit=limit)

    def reindex(self) -> int:
        """Store the vectors of this snapshot's symbols; how many had to be embedded.

        Texts embedded before by the same model, in any snapshot, are not embedded again."""
        from tessera.sources.services import embed_column

        points, new = search.index_symbols(self.table("symbols"), self.store.read("vectors"), self.embedder.model_key, lambda d: embed_column(d, self.embedder))
        have = self.table("vectors").select("id", "text_hash", "model")
        points = graph.cut(points.join(have, ["id", "text_hash", "model"], "left_anti"))
        n = new.count()
        self.store.append("vectors", points)
        return n

    def context_pack(self, query: str | None = None, module: str | None = None, symbols: list[str] = (), budget: int = 2000, include_source: bool = False, seed_from_search: bool = False) -> packing.ContextPack:
        """A budgeted map of what a task needs, with complete sources if asked for."""
        if query is not None and len(query) > 2000:
            raise ValueError("a query has 2,000 characters at most")
        if len(symbols) > 20:
            raise ValueError("20 symbols at most")
        every, edges = self.table("symbols"), self.table("edges")
        eligible = every
        if module is not None:
            one = self.table("modules").where((F.col("name") == module) | (F.col("path") == module)).collect()
            if len(one) != 1:
                raise LookupError("module is unknown or ambiguous; use its path")
            own = resolve.owning_module(self.table("files").select("path"), self.table("modules")).where(F.col("module") == one[0]["path"])
            eligible = every.join(own.select("path"), "path", "left_semi")
        seeds = set(resolve.require_unique(eligible, list(symbols)))
        if not seeds and query and seed_from_search:
            seeds = {r["id"] for r in self.search(query, 3).collect()}
        ranked = graph.personalized_rank(every, edges, query or "", sorted(seeds))
        ordered = graph.rank_order(ranked, eligible.drop("source", "content_hash"))
        if not seeds and query:
            seeds = {r["id"] for r in ordered.limit(3).select("id").collect()}
        if seeds:
            s = self.store.spark.createDataFrame([(x,) for x in seeds], "id string")
            ordered = ordered.join(graph.expand(edges, s, outgoing_only=include_source), "id", "left_semi").orderBy(F.desc("relevance"), F.desc("rank"), "path", "start_line", "id")
        # every row of a pack costs tokens, so no more rows than the budget has can be of use
        ordered = graph.cut(ordered)
        related = graph.cut(graph.induced(edges, ordered.select("id")).select("source_id", "target_id", "edge_type", "analyzer", "confidence"))
        totals = ordered.count(), related.count()
        best = [F.desc("relevance"), F.desc("rank"), "path", "start_line", "id"]
        cands = [r.asDict() for r in ordered.orderBy(*best).limit(max(budget, 1)).collect()]
        shown_ = self.store.spark.createDataFrame([(c["id"],) for c in cands], "id string")
        links = [r.asDict() for r in graph.induced(related, shown_).limit(max(budget, 1)).collect()]
        repo = self.store.repository()
        head = f"{repo['name']} at {repo['commit_sha'][:12]} ({self.snapshot})"
        read = None
        if include_source:

            def read(s):
                if not self.expose_source:
                    raise packing.StaleSource("source access is disabled")
                return self._source(s["path"])

        return packing.pack_context(head, cands, links, seeds, budget, read, self.count, totals)

    # --- policies and analysis ----------------------------------------------------------------

    def audit(self, policies: list[policy.Policy], judge=None) -> DataFrame:
        """Store the candidates of each policy as findings; rejected ones are only counted.

        ``judge(policy, candidates)`` gives a DataFrame of verdicts.  Running again adds
        findings again.  Returns ``policy_id, status, n``.
        """
        spark, facts, sid = self.store.spark, self.facts(), self.snapshot
        rid = self.store.repository()["repository_id"]
        totals = None
        for p in policies:
            c = graph.cut(policy.candidates(p, facts))
            j = graph.cut(policy.judged(c, judge(p, c) if judge else None).withColumn("id", F.concat(F.lit("finding_"), F.substring(F.sha2(F.concat_ws("\n", F.lit(sid), "policy_id", "detector", "subject", "claim", F.uuid()), 256), 1, 24))))
            keep = j.where("status <> 'rejected'")
            ev = keep.select("id", F.posexplode("evidence").alias("i", "e")).select(
                F.concat_ws("_", "id", F.col("i").cast("string")).alias("id"), F.col("id").alias("owner_id"), F.lit("finding").alias("owner_kind"), "e.path",
                F.col("e.line").alias("start_line"), F.col("e.line").alias("end_line"), F.col("e.detail").alias("excerpt"),
            )
            rows = keep.withColumns({"repository_id": F.lit(rid), "snapshot_id": F.lit(sid), "created_at": F.current_timestamp()})
            self.store.add_findings(rows, ev)
            n = j.groupBy("policy_id", "status").agg(F.count(F.lit(1)).alias("n"))
            totals = n if totals is None else totals.union(n)
        return totals if totals is not None else spark.createDataFrame([], "policy_id string, status string, n long")

    def ranking(self) -> DataFrame:
        """The rank of all symbols without a query, the same for every module."""
        return graph.cut(graph.personalized_rank(self.table("symbols"), self.table("edges"), "", []))

    def module_pack(self, module_path: str, budget: int = 6000, max_symbols: int | None = None, max_edges: int | None = None, ranked: DataFrame | None = None) -> dict:
        """A module's evidence under a budget; its fingerprint covers what was left out too."""
        f = self.facts()
        owned = f["owners"].where(F.col("module") == module_path).select("id")
        symbols = f["symbols"].join(owned, "id", "left_semi")
        files = f["files"].join(owned, "id", "left_semi")
        edges = f["edges"].where("edge_type <> 'CONTAINS'")
        at = graph.boundary(edges, owned)
        other = F.when(F.col("place") == "incoming", F.col("source_id")).when(F.col("place") == "outgoing", F.col("target_id"))
        ends = graph.label(at.where("place <> 'internal'").withColumn("id", other), f["symbols"], f["files"]).select("place", "id", "label").distinct()
        fan = graph.fan_in(edges)
        ranked = self.ranking() if ranked is None else ranked
        best = graph.rank_order(ranked, symbols).join(fan, F.col("id") == F.col("target_id"), "left").orderBy(F.desc("relevance"), F.desc("rank"), "path", "start_line", "id")
        inner = graph.label(graph.label(at.where("place = 'internal'"), f["symbols"], f["files"], "source_id").withColumnRenamed("label", "from"), f["symbols"], f["files"], "target_id")
        parts = F.lit("m").alias("m")
        hashes = [
            history.fingerprint(df.withColumn("m", parts), "m", {"x": F.struct(*cols)}).select("fingerprint").first()
            for df, cols in ((files, ("path", "content_hash")), (symbols, ("id", "content_hash")), (at, ("source_id", "target_id", "edge_type", "analyzer")),
                (ends.join(f["symbols"].select("id", "content_hash").union(f["files"].select("id", "content_hash")), "id", "left"), ("id", "content_hash")))
        ]
        import hashlib

        print_ = hashlib.sha256("\n".join(h[0] if h else "" for h in hashes).encode()).hexdigest()
        # only what concerns the module's own files comes here
        metrics = self.table("metrics")
        commits = {r["subject_id"]: r["value"] for r in metrics.where("name = 'commit_count'").join(owned, F.col("subject_id") == F.col("id"), "left_semi").collect()}
        pairs = metrics.where(F.startswith("name", F.lit("co_change:"))).select("subject_id", "value", F.substr("name", F.lit(len("co_change:") + 1)).alias("with"))
        pairs = pairs.join(f["files"].select(F.col("id").alias("subject_id"), F.col("path").alias("file")), "subject_id", "left")
        mine = files.select(F.col("path").alias("p"), F.lit(True).alias("mine"))
        pairs = pairs.withColumn("file", F.coalesce("file", "subject_id")).join(mine, F.col("file") == F.col("p"), "left").drop("p").withColumnRenamed("mine", "a")
        pairs = pairs.join(mine, F.col("with") == F.col("p"), "left").where("a or mine").orderBy("subject_id", "with")
        co = [{"file": r["file"], "with": r["with"], "count": int(r["value"])} for r in pairs.collect()]
        tests = self.table("tests").join(files.select("path"), "path", "left_semi").orderBy("path", "name")
        ev = {
            "symbols": [
                {"id": r["id"], "name": r["qualified_name"], "kind": r["kind"], "signature": r["signature"], "path": r["path"], "lines": [r["start_line"], r["end_line"]], "fan_in": r["fan_in"] or 0}
                for r in best.collect()
            ],
            "internal_edges": [
                {"source_id": r["source_id"], "target_id": r["target_id"], "from": r["from"], "to": r["label"], "type": r["edge_type"]}
                for r in inner.orderBy("source_id", "target_id", "edge_type").collect()
            ],
            "incoming": sorted({r["label"] for r in ends.where("place = 'incoming'").collect()}),
            "outgoing": sorted({r["label"] for r in ends.where("place = 'outgoing'").collect()}),
            "files": [{"path": r["path"], "language": r["language"], "lines": r["line_count"], "commits": int(commits.get(r["id"], 0))} for r in files.orderBy("path").collect()],
            "tests": [{"path": r["path"], "name": r["name"]} for r in tests.collect()],
            "co_changes": co,
        }
        m = self.table("modules").where(F.col("path") == module_path).first()
        return packing.pack_module({"name": m["name"], "path": m["path"]}, print_, ev, budget, max_symbols, max_edges, self.count)

    def analyze(self, model: analysis.Model, prompt_version: str = "1", module: str | None = None, budget: int = 6000) -> dict:
        """Dossiers of all modules in path order and, without a filter, a repository brief.

        Answers are reused by the hash of pack, prompt version and model, also from other
        snapshots."""
        import json

        mods = [r for r in self.table("modules").orderBy("path").collect() if module in (None, r["name"], r["path"])]
        ranked = self.ranking() if mods else None
        packs = [(m["id"], self.module_pack(m["path"], budget, ranked=ranked)) for m in mods]
        last = analysis.latest_summaries(self.store.read("summaries").where((F.col("model") == model.name) & (F.col("prompt_version") == prompt_version)))
        cache = {r["content_hash"]: json.loads(r["content_json"]) for r in last.select("content_hash", "content_json").collect()}
        answers, fresh, counts = analysis.analyse(packs, cache, model, prompt_version, lambda p: json.dumps(p, ensure_ascii=False))
        for sid, pack in packs:
            self.store.add_summary(self.snapshot, sid, "module", answers[sid], model.name, prompt_version, analysis.cache_key(pack, prompt_version, model.name))
        if module is None:
            repo = self.store.repository()
            whole = packing.pack_repository(repo["name"], self.overview()["counts"], [(m["name"], answers[m["id"]]) for m in mods], budget, self.count)
            got, _, more = analysis.analyse([(repo["repository_id"], whole)], cache, model, prompt_version, lambda p: json.dumps(p, ensure_ascii=False), analysis.BRIEF)
            key = analysis.cache_key(whole, prompt_version, model.name)
            self.store.add_summary(self.snapshot, repo["repository_id"], "repository", got[repo["repository_id"]], model.name, prompt_version, key)
            counts = {k: counts[k] + more[k] for k in counts}
        return counts

    def token_benchmark(self, cases: list[dict], budget: int = 2000) -> dict:
        """Tokens of the whole numbered files of the cases' symbols against those of packs."""
        rows = []
        for c in cases:
            ids = resolve.require_unique(self.table("symbols"), c["symbols"])
            paths = sorted({r["path"] for r in self.table("symbols").where(F.col("id").isin(ids)).select("path").collect()})
            full = "\n".join("\n".join(f"{i + 1}\t{x}" for i, x in enumerate(self._source(p).split("\n"))) for p in paths)
            src, only = self.context_pack(symbols=c["symbols"], budget=budget, include_source=True), self.context_pack(symbols=c["symbols"], budget=budget)
            rows.append((c["name"], self.count(full), src.tokens, only.tokens, len(set(ids) & set(src.source_ids)), len(ids)))
        df = self.store.spark.createDataFrame(rows, "name string, baseline long, context long, map_only long, complete long, requested long")
        return {"cases": [r.asDict() for r in df.collect()], "totals": history.savings(df).first().asDict()}


_BY = ("files", "modules", "symbols", "edges", "metrics", "tests", "coverage", "vectors")


class Federation:
    """Several repositories asked at once."""

    def __init__(self, engines: dict[str, Engine]):
        self.engines = engines

    def search(self, query: str, limit: int = 8) -> DataFrame:
        """Hits of all repositories by raw score, with how many there were."""
        out = None
        for name, e in sorted(self.engines.items()):
            hits = e.search(query, limit).withColumn("repo", F.lit(name))
            out = hits if out is None else out.unionByName(hits)
        return search.federated(out, limit)

    def owner(self, symbol: str) -> Engine:
        """The one repository that has the symbol."""
        found = []
        for name, e in self.engines.items():
            try:
                e._resolve(symbol)
                found.append(name)
            except LookupError:
                continue
        if len(found) != 1:
            raise LookupError(f"{symbol!r} is in {sorted(found) or 'no repository'}; name one")
        return self.engines[found[0]]

    def get_evidence(self, finding_id: str) -> list[dict]:
        for e in self.engines.values():
            rows = e.get_evidence(finding_id)
            if rows:
                return rows
        return []


def shown(text: str) -> str:
    """The preview of a long text as the list views show it."""
    return text if len(text) <= 300 else text[:300] + "… [preview]"


__all__ = ["Engine", "Federation", "preview", "shown"]
