import hashlib
import os
import random

import pytest

from tessera.functions.tokens import count_pieces
from tessera.operators import analysis, packing, policy


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_skips(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("ab"), i, rng.randrange(1, 60)) for i in range(40)]
    want = {}
    for g in "ab":
        used, kept = 0, []
        for _, i, c in [r for r in rows if r[0] == g]:
            if used + c <= 150:
                used, kept = used + c, [*kept, i]
        want[g] = (kept, used, sum(r[0] == g for r in rows) - len(kept))
    got = packing.greedy_pack(spark.createDataFrame(rows, "g string, i int, c int"), "g", "i", "c", 150, "i")
    assert {r["g"]: (r["kept"], r["used"], r["dropped"]) for r in got.collect()} == want


def test_line_range(spark):
    f = spark.createDataFrame([("a", "\n".join("x" * 38 for _ in range(30))), ("b", "one")], "path string, text string")
    got = {r["path"]: r for r in packing.line_range(f, 3, 8, budget=33).collect()}
    assert (got["a"]["to_line"], got["a"]["more"]) == (5, True) and got["a"]["text"].startswith("3\txxx")
    assert got["b"]["to_line"] == 2 and got["b"]["text"] == "" and not got["b"]["more"]


def symbols(n, sig=None):
    rows = [{"id": "seed", "path": "a.ts", "start_line": 1, "end_line": 3, "kind": "function", "qualified_name": "authorize", "signature": sig}]
    return rows + [{"id": f"u{i}", "path": "a.ts", "start_line": 4 + i, "end_line": 4 + i, "kind": "function", "qualified_name": f"utility{i}", "signature": "()"} for i in range(n)]


def test_seed_beats_popular_symbols():
    edges = [{"source_id": f"u{i}", "target_id": "u0", "edge_type": "CALLS", "analyzer": "x"} for i in range(1, 100)]
    p = packing.pack_context("repo", list(reversed(symbols(100))), edges, {"seed"}, 300)
    assert p.symbol_ids[0] == "seed" and p.tokens <= 300 and p.tokens == count_pieces(p.text) and 1 < len(p.symbol_ids) < 101
    assert p.total_edges == 99


def test_sources_cover_rows_and_stale_ones_are_told(tmp_path):
    text = "a\nb\nc\nd\n"
    (tmp_path / "a.ts").write_text(text)
    good = hashlib.sha256(text.encode()).hexdigest()
    p = packing.pack_context("repo", symbols(3), [], {"seed"}, 400, lambda s: packing.read_source(str(tmp_path), s["path"], good))
    assert p.source_ids == ["seed"] and "1\ta\n2\tb\n3\tc" in p.text and "1. a.ts" not in p.text and "2. a.ts:4-4" in p.text
    q = packing.pack_context("repo", symbols(3), [], {"seed"}, 400, lambda s: packing.read_source(str(tmp_path), s["path"], "0" * 64))
    assert q.source_omissions == ["seed"] and "did not fit" in q.text


def test_budget_holds_with_a_huge_signature():
    p = packing.pack_context("repo", symbols(2, "x" * 8000), [], {"seed"}, 256)
    assert p.tokens <= 256 and "seed" not in p.symbol_ids
    with pytest.raises(ValueError):
        packing.pack_context("h " * 900, symbols(1), [], set(), 256)


def test_source_guards(tmp_path):
    root, out = tmp_path / "r", tmp_path / "secret"
    root.mkdir()
    out.write_text("s")
    os.symlink(out, root / "link")
    h = hashlib.sha256(b"s").hexdigest()
    for path, want in (("../secret", h), ("link", h), ("none", h), ("link", None)):
        with pytest.raises(LookupError):
            packing.read_source(str(root), path, want)


def test_module_pack_counts_what_it_drops():
    ev = {"symbols": [{"id": str(i), "name": f"f{i}"} for i in range(10)], "internal_edges": [{"source_id": "0", "target_id": "1", "type": "CALLS"}, {"source_id": "0", "target_id": "9", "type": "CALLS"}], "files": [{"path": "a"}]}
    p = packing.pack_module({"name": "m"}, "f", ev, 4000, max_symbols=4)
    assert len(p["symbols"]) == 4 and p["dropped"]["symbols"] == 6
    assert p["internal_edges"] == [{"type": "CALLS"}] and p["dropped"]["edges"] == 1 and p["dropped"]["files"] == 0
    many = {"symbols": [{"id": str(i), "name": "n" * 40 + str(i)} for i in range(80)], "files": [{"path": "last.ts"}]}
    small = packing.pack_module({"name": "m"}, "f", many, 600)
    assert small["dropped"]["symbols"] > 0 and small["files"] == [{"path": "last.ts"}]


def test_repository_pack_shows_every_module():
    dossiers = [(f"m{i}", {"responsibility": "short", "publicApi": ["x" * 9] * 1000}) for i in range(10)]
    p = packing.pack_repository("r", {}, dossiers, 1000)
    assert len(p["modules"]) == 10 and p["omitted"] == {"modules": 0, "sections": 10}
    assert all(m["dossier"] == {"responsibility": "short"} for m in p["modules"])


E = "source_id string, target_id string, edge_type string, confidence double, analyzer string, evidence_json string"


@pytest.fixture(scope="module")
def facts(spark):
    files = spark.createDataFrame([("repo://r/a/x.ts", "a/x.ts"), ("repo://r/b/y.ts", "b/y.ts")], "id string, path string")
    ev = '{"path":"%s","line":%d,"specifier":"%s"}'
    edges = [("repo://r/a/x.ts", "repo://r/b/y.ts", "IMPORTS", 1.0, "t", ev % ("a/x.ts", 1, "../b/y")), ("repo://r/b/y.ts", "repo://r/a/x.ts", "IMPORTS", 1.0, "t", None)]
    sym = [(f"s{i}", "b/y.ts", f"f{i}", "function", None, i, i) for i in range(6)]
    edges += [(f"s{i}", "s0", "CALLS", 0.9, "t", None) for i in range(1, 6)]
    s = spark.createDataFrame(sym, "id string, path string, qualified_name string, kind string, signature string, start_line int, end_line int")
    owners = spark.createDataFrame([("repo://r/a/x.ts", "a"), ("repo://r/b/y.ts", "b")], "id string, module string")
    return {"files": files, "symbols": s, "edges": spark.createDataFrame(edges, E), "owners": owners}


def test_detectors(facts):
    c = policy.module_cycle(facts, {}).collect()
    assert [r["subject"] for r in c] == ["a <-> b"] and [e["path"] for e in c[0]["evidence"]] == ["a/x.ts", "b/y.ts"]
    assert [r["subject"] for r in policy.high_fan_in(facts, {"threshold": 5}).collect()] == ["f0"]
    assert policy.high_fan_in(facts, {"threshold": 6}).count() == 0
    assert [r["module"] for r in policy.untested_module(facts, {}).collect()] == ["b"]
    assert policy.forbidden_import(facts, {"from": "^a/"}).count() == 0
    got = policy.forbidden_import(facts, {"from": "^a/", "to": "^b/"}).collect()
    assert len(got) == 1 and got[0]["evidence"][0]["detail"] == "../b/y"


def test_verdicts(spark, facts):
    p = policy.Policy("p", "high", [("module_cycle", {}), ("untested_module", {"minSymbols": 2})])
    c = policy.candidates(p, facts)
    assert [(r["index"], r["detector"]) for r in c.orderBy("index").collect()] == [(0, "module_cycle"), (1, "untested_module")]
    assert {r["status"] for r in policy.judged(c, None).collect()} == {"candidate"}
    v = spark.createDataFrame([(0, True, 0.9, "split"), (7, True, 0.9, "")], "index int, confirmed boolean, confidence double, recommendation string")
    got = policy.judged(c, v).collect()
    assert [(r["status"], r["recommendation"]) for r in got] == [("confirmed", "split")]
    with pytest.raises(LookupError):
        policy.candidates(policy.Policy("q", "low", [("nope", {})]), facts)


class Fake:
    name = "fake"
    calls = 0

    def complete(self, prompt, fields):
        self.calls += 1
        values = {"text": "x", "texts": [], "claims": [], "risks": [], "ends": {"incoming": [], "outgoing": []}}
        return {k: values[kind] for k, kind in fields.items()}, 10, 5


def test_analysis_cache():
    m = Fake()
    packs = [("a", {"x": 1}), ("b", {"x": 2})]
    _, fresh, n = analysis.analyse(packs, {}, m, "1", str)
    assert (m.calls, n["analyzed"], n["input_tokens"]) == (2, 2, 20)
    _, _, n = analysis.analyse(packs, fresh, m, "1", str)
    assert (m.calls, n["cached"]) == (2, 2)
    _, _, n = analysis.analyse([("a", {"x": 3})], fresh, m, "1", str)
    assert n["analyzed"] == 1
    with pytest.raises(ValueError):
        analysis.check_answer({"responsibility": ""})


def test_answers_are_typed():
    good = {
        "responsibility": "r", "publicApi": ["a"], "dependencies": {"incoming": [], "outgoing": ["b"]}, "mainFlows": [], "strengths": [{"claim": "c", "evidence": ["x.ts"]}],
        "risks": [{"claim": "c", "evidence": [], "severity": "high"}], "opportunities": [], "testStrategy": "t",
    }
    assert analysis.check_answer(good) == good
    for field, value in {
        "responsibility": 1, "publicApi": "a", "mainFlows": [1], "dependencies": {"incoming": []}, "strengths": [{"claim": "c"}], "risks": [{"claim": "c", "evidence": [], "severity": "bad"}],
    }.items():
        with pytest.raises(ValueError, match=field):
            analysis.check_answer(good | {field: value})


def test_work_list(spark):
    cols = "snapshot_id string, subject_id string, level string, content_hash string, prompt_version string, model string, content_json string, created_at int, id string"
    s = spark.createDataFrame([("1", "m", "module", "h", "1", "x", "old", 1, "a"), ("1", "m", "module", "h", "1", "x", "new", 2, "b")], cols)
    w = spark.createDataFrame([("m", "module", "h", "1", "x"), ("m", "module", "h2", "1", "x")], "subject_id string, level string, content_hash string, prompt_version string, model string")
    hits, work = analysis.work_list(w, s)
    assert hits.first()["content_json"] == "new" and [r["content_hash"] for r in work.collect()] == ["h2"]
