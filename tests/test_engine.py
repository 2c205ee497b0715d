import subprocess

import pytest
from pyspark.sql import functions as F

from tessera import ingest
from tessera.catalog import Store, discover
from tessera.engine import MASKED, Engine, Federation
from tessera.operators.policy import Policy
from tessera.streaming.refresh import follow

FILES = {
    "package.json": "{}",
    "src/service.ts": "import { save } from './repo';\nexport class Service {\n  place(order: string) {\n    return save(order);\n  }\n}\nexport function checkout(o: string) {\n  return new Service().place(o);\n}\n",
    "src/repo.ts": "export function save(x: string) {\n  return x;\n}\n",
    "src/service.test.ts": "import { Service } from './service';\ntest('places', () => {});\ntest('places', () => {});\n",
    "tools/gen.py": "import os\n\ndef run():\n    pass\n",
}


def git(root, *args):
    subprocess.run(["git", "-C", str(root), "-c", "user.name=T", "-c", "user.email=t@example.com", *args], check=True, capture_output=True)


@pytest.fixture(scope="module")
def scanned(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    for p, text in FILES.items():
        (root / p).parent.mkdir(exist_ok=True)
        (root / p).write_text(text)
    git(root, "init", "-q")
    git(root, "add", ".")
    git(root, "commit", "-qm", "one")
    (root / "untracked.ts").write_text("export class No {}")
    store = Store(spark, str(tmp_path_factory.mktemp("stores") / "one"))
    return root, store, ingest.scan(spark, str(root), store, "shop")


def test_scan(scanned):
    root, store, done = scanned
    c = done["counts"]
    assert (c["files"], c["modules"], c["tests"], c["symbols"]) == (5, 1, 1, 5)
    e = {(r["source_id"].split("/")[-1], r["target_id"].split("/")[-1], r["edge_type"]) for r in store.read("edges").where("edge_type <> 'CONTAINS'").collect()}
    assert e == {("service.ts", "repo.ts", "IMPORTS"), ("service.test.ts", "service.ts", "IMPORTS"), ("service.ts", "service.test.ts", "TESTED_BY")}
    f = {r["path"]: r for r in store.read("files", done["snapshot_id"]).collect()}
    assert f["src/repo.ts"]["line_count"] == 4 and f["src/repo.ts"]["last_author"] == "T" and f["package.json"]["language"] == "json"
    assert store.read("modules").first()["name"] == "shop"
    own = {r["id"] for r in store.read("symbols").collect()}
    inner = store.read("edges").where("edge_type = 'CONTAINS' and analyzer = 'tree'").collect()
    assert sum(r["source_id"] in own for r in inner) == 1
    assert store.read("files", "no such").count() == 0
    Store(store.spark, store.root)
    assert store.spark.read.schema("version int").json(store.path("_schema")).count() == 1


def test_reads(scanned):
    root, store, done = scanned
    e = Engine(store)
    o = e.overview()
    assert o["counts"]["symbols"] == 5 and o["modules"] == ["shop"]
    assert e.symbol_context("place")["qualified_name"] == "Service.place" and e.symbol_context("checkout")["kind"] == "function"
    hits = e.search("service place").collect()
    assert hits[0]["qualified_name"] == "Service.place"
    p = e.context_pack(symbols=["checkout"], budget=400, include_source=True)
    assert p.tokens <= 400 and p.source_ids and "7\texport function checkout" in p.text
    q = e.context_pack(query="save", budget=300)
    assert "save" in q.text and q.total_symbols == 3
    with pytest.raises(LookupError):
        e.context_pack(symbols=["nope"])
    ev = e.get_evidence(path="src/repo.ts", start=2, end=2)[0]
    assert ev["text"] == "2\t  return x;" and ev["more"]
    assert Engine(store, expose_source=False).get_evidence(path="src/repo.ts")[0]["text"] == MASKED
    assert Engine(store, expose_source=False).context_pack(symbols=["checkout"], include_source=True).source_omissions


def test_callers(spark, scanned):
    root, store, done = scanned
    e = Engine(store)
    ids = {r["qualified_name"]: r["id"] for r in store.read("symbols").collect()}
    calls = [(ids["checkout"], ids["Service.place"]), (ids["Service.place"], ids["save"])]
    extra = spark.createDataFrame([(done["snapshot_id"], a, b, "CALLS", 0.9, "x", None) for a, b in calls], store.read("edges").schema)
    table = e.table
    e.table = lambda n: table(n).unionByName(extra) if n == "edges" else table(n)
    assert e.find_callers("save", 3) == [["Service.place"], ["checkout"]]


def test_audit_and_findings(scanned):
    root, store, done = scanned
    e = Engine(store)
    p = Policy("imports", "high", [("forbidden_import", {"from": "service", "to": "repo"})])
    assert [tuple(r)[1:] for r in e.audit([p]).collect()] == [("candidate", 1)]
    assert e.findings() == []

    def judge(policy, cands):
        return cands.select("index", F.lit(True).alias("confirmed"), F.lit(0.8).alias("confidence"), F.lit("move").alias("recommendation"))

    e.audit([p], judge)
    f = e.findings(["high"])
    assert len(f) == 1 and f[0]["recommendation"] == "move" and store.findings().count() == 2
    assert [x["path"] for x in f[0]["evidence"]] == ["src/service.ts"]
    ev = e.get_evidence(f[0]["id"])
    assert ev[0]["path"] == "src/service.ts" and Federation({"shop": e}).get_evidence(f[0]["id"]) == ev
    assert e.module_context("shop")["path"] == "."


def test_analyze_reuses_answers(scanned):
    class Model:
        name, calls = "fake", 0

        def complete(self, prompt, fields):
            self.calls += 1
            values = {"text": "x", "texts": ["x"], "claims": [{"claim": "c", "evidence": ["a.ts"]}], "ends": {"incoming": [], "outgoing": ["x"]}}
            values["risks"] = [{"claim": "c", "evidence": [], "severity": "low"}]
            return {k: values[kind] for k, kind in fields.items()}, 7, 3

    root, store, done = scanned
    e, m = Engine(store), Model()
    first = e.analyze(m)
    assert first == {"analyzed": 2, "cached": 0, "input_tokens": 14, "output_tokens": 6}
    assert e.analyze(m)["cached"] == 2 and m.calls == 2
    assert "objective" in e.overview()["brief"]
    r = e.token_benchmark([{"name": "c", "symbols": ["save"]}], 300)["totals"]
    assert r["complete"] == r["requested"] == 1


def test_refresh_and_stream(spark, scanned, tmp_path):
    root, store, done = scanned
    assert ingest.refresh(spark, str(root), store, "shop").up_to_date
    with (root / "src/repo.ts").open("a") as f:
        f.write("export function load() {\n  return 1;\n}\n")
    r = ingest.refresh(spark, str(root), store, "shop")
    assert (r.up_to_date, r.changed_files, r.new, r.changed, r.removed, r.modules) == (False, ["src/repo.ts"], 1, 0, 0, ["."])
    seen = []
    follow(store, str(tmp_path / "ck"), lambda sid, prev, ch, rm: seen.append((sid, prev, ch.count(), rm.count()))).awaitTermination(120)
    assert seen == [(done["snapshot_id"], None, 5, 0), (r.snapshot_id, done["snapshot_id"], 1, 0)]
    found = discover(spark, str(__import__("pathlib").Path(store.root).parent))
    assert list(found) == ["shop"] and Federation({"shop": Engine(found["shop"])}).owner("checkout").store is found["shop"]


def test_small_tables(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    a, b = s.upsert_repository("r", "/a"), s.upsert_repository("r", "/b")
    row = s.read("repositories").collect()
    assert len(row) == 1 and row[0]["root_path"] == "/b" and row[0]["created_at"] == a["created_at"] < b["created_at"]
    for status in ("started", "done"):
        s.record_run({"id": status, "snapshot_id": "1", "kind": "k", "model": "m", "cache_key": "c", "status": status})
    assert [r["status"] for r in s.read("analysis_runs").collect()] == ["done"]
    m = spark.createDataFrame([("1", "f", "n", 1.0, "a"), ("1", "f", "n", 2.0, "a")], s.read("metrics").schema)
    assert [r["value"] for r in s.upsert_metrics(m.coalesce(1)).collect()] == [2.0]
    many = spark.createDataFrame([("1", f"f{i}", "n", float(i), "a") for i in range(40)], s.read("metrics").schema).repartition(4)
    s.append("metrics", many.withColumn("value", F.lit(-1.0)))
    assert sorted(r["value"] for r in s.upsert_metrics(many).collect()) == [float(i) for i in range(40)]
    with pytest.raises(LookupError):
        Engine(s).overview()


def test_streams_stay_in_a_repository(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    cols = "id string, qualified_name string, content_hash string"
    seen = {}
    for repo, sid, rows in (("a", "a1", [("x", "x", "1")]), ("b", "b1", [("y", "y", "1")]), ("a", "a2", [("x", "x", "2"), ("z", "z", "1")]), ("b", "b2", [])):
        s.commit_snapshot(repo, "sha", {"symbols": spark.createDataFrame(rows, cols)}, sid)
    follow(s, str(tmp_path / "ck"), lambda sid, prev, ch, rm: seen.update({sid: (prev, ch.count(), rm.count())})).awaitTermination(120)
    assert seen == {"a1": (None, 1, 0), "b1": (None, 1, 0), "a2": ("a1", 2, 0), "b2": ("b1", 0, 1)}


def test_a_crash_leaves_the_revision_before(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    for run in ("one", "two"):
        s.record_run({"id": run, "snapshot_id": "1", "kind": "k", "model": "m", "cache_key": run, "status": "done"})
    assert sorted(r["id"] for r in s.read("analysis_runs").collect()) == ["one", "two"]
    assert spark.read.parquet(s.path("analysis_runs")).select("revision").distinct().count() == 2


def test_command_line(spark, scanned, capsys):
    from tessera import cli

    root, store, done = scanned

    def call(*args):
        return cli.run(cli.parser().parse_args([args[0], "--store", store.root, *args[1:]]), spark)

    assert call("reindex")["embedded"] > 0 and call("reindex") == {"embedded": 0}
    hit = call("query", "service place", "--limit", "3")
    assert hit[0]["qualified_name"] == "Service.place" and "vector" in hit[0]["sources"]
    assert "save" in call("context", "--symbol", "save", "--max-tokens", "300")
    assert call("symbol", "save")["kind"] == "function" and call("evidence", "src/service.ts")[0]["from_line"] == 1
    sizes = call("analyze", "--dry-run")
    assert [x["module"] for x in sizes] == ["shop"] and 0 < sizes[0]["tokens"] <= 4000
    assert cli.doctor()["healthy"] and "Ready." in cli.doctor_text(cli.doctor())
    bad = cli.doctor_text({"required": {"git": False}, "optional": {}, "missing_required": ["git"], "healthy": False})
    assert "Not ready: git" in bad
