import random

import pytest

from tessera.operators import resolve


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_names(spark):
    s = frame(spark, [("1", "A.run", "b.ts", 1), ("2", "run", "z.ts", 1), ("3", "B.run", "a.ts", 5), ("4", "Load", "a.ts", 1)], "id string, qualified_name string, path string, start_line int")
    n = frame(spark, [("run",), ("B.run",), ("load",), ("nope",), ("A.run",)], "name string")
    assert {r["name"]: (r["id"], r["how"]) for r in resolve.resolve_name(s, n).collect()} == {"run": ("2", "exact"), "B.run": ("3", "exact"), "load": ("4", "case"), "A.run": ("1", "exact")}
    only = resolve.resolve_name(s.where("id in ('1', '3')"), frame(spark, [("run",)], "name string")).first()
    assert (only["id"], only["how"]) == ("3", "suffix")
    assert resolve.require_unique(s, ["run", "3"]) == ["2", "3"]
    twice = s.union(frame(spark, [("5", "run", "q.ts", 1)], s.schema))
    with pytest.raises(LookupError):
        resolve.require_unique(twice, ["run"])


def test_owners(spark):
    files = frame(spark, [("a/b/c.ts",), ("a/x.ts",), ("top.ts",), ("ab/y.ts",)], "path string")
    mods = frame(spark, [("a",), ("a/b",)], "path string")
    assert {r["path"]: r["module"] for r in resolve.owning_module(files, mods).collect()} == {"a/b/c.ts": "a/b", "a/x.ts": "a", "top.ts": None, "ab/y.ts": None}
    root = resolve.owning_module(files, frame(spark, [(".",)], "path string")).collect()
    assert {r["module"] for r in root} == {"."}


def test_imports(spark):
    files = frame(spark, [(p,) for p in ("src/a.ts", "src/b/index.ts", "src/c.js", "c", "src/d.ts", "src/d")], "path string")
    i = frame(spark, [("src/x.ts", s) for s in ("./a", "./b", "../c", "./c", "axios", "./a.js", "./d")], "path string, specifier string")
    got = {r["specifier"]: r["target"] for r in resolve.resolve_imports(i, files).collect()}
    assert got == {"./a": "src/a.ts", "./b": "src/b/index.ts", "../c": "c", "./c": "src/c.js", "axios": None, "./a.js": None, "./d": "src/d"}


def test_python_imports(spark):
    files = frame(spark, [(p,) for p in ("src/pkg/__init__.py", "src/pkg/m.py", "top.py", "src/pkg/sub/n.py")], "path string")
    i = frame(spark, [("src/pkg/sub/n.py", s) for s in ("pkg.m", "top", "..m", ".n", "os", "pkg")], "path string, specifier string")
    got = {r["specifier"]: r["target"] for r in resolve.resolve_python_imports(i, files).collect()}
    assert got == {"pkg.m": "src/pkg/m.py", "top": "top.py", "..m": "src/pkg/m.py", ".n": "src/pkg/sub/n.py", "os": None, "pkg": "src/pkg/__init__.py"}


@pytest.mark.parametrize("seed", [1, 2])
def test_innermost(spark, seed):
    rng = random.Random(seed)
    spans = [(i, rng.choice("pq"), a := rng.randrange(2000), a + rng.choice([0, 5, 900])) for i in range(60)]
    points = [(i, rng.choice("pq"), rng.randrange(2500)) for i in range(300)]
    want = {}
    for i, p, x in points:
        inside = [(hi - lo, lo, j) for j, q, lo, hi in spans if q == p and lo <= x <= hi]
        if inside:
            want[i] = min(inside)[2]
    s = frame(spark, spans, "id int, path string, start_line int, end_line int")
    got = resolve.innermost(frame(spark, points, "point_id int, path string, line int"), s, cell=100)
    assert {r["point_id"]: r["span_id"] for r in got.collect()} == want


def test_references(spark):
    s = frame(
        spark,
        [("r", "port.ts", "Repo", "interface", 1, 5), ("rs", "port.ts", "Repo.save", "method", 2, 3), ("sv", "svc.ts", "Svc", "class", 1, 20), ("pl", "svc.ts", "Svc.place", "method", 5, 9), ("im", "i.ts", "Impl", "class", 1, 9)],
        "id string, path string, qualified_name string, kind string, start_line int, end_line int",
    )
    sym = {"rs": "x port.ts/Repo#save().", "r": "x port.ts/Repo#", "im": "x i.ts/Impl#", "pl": "x svc.ts/Svc#place()."}
    occ = [(sym["rs"], True, "port.ts", 2, 0), (sym["r"], True, "port.ts", 1, 1), (sym["im"], True, "i.ts", 1, 2), (sym["pl"], True, "svc.ts", 5, 3), ("x gone.ts/lost().", True, "svc.ts", 1, 4)]
    occ += [(sym["rs"], False, "svc.ts", 6, 5), (sym["rs"], False, "svc.ts", 7, 6), (sym["r"], False, "svc.ts", 2, 7), (sym["pl"], False, "svc.ts", 6, 8), (sym["rs"], False, "nowhere.ts", 1, 9)]
    o = frame(spark, occ, "symbol string, is_definition boolean, path string, line int, ordinal long")
    got = {(r["source_id"], r["target_id"]): (r["edge_type"], r["line"], r["hits"]) for r in resolve.reference_edges(o, s).collect()}
    assert got == {("pl", "rs"): ("CALLS", 6, 2), ("sv", "r"): ("DEPENDS_ON", 2, 1)}
    assert resolve.unmapped_definitions(o, s).first()[0] == 1
    rel = frame(spark, [(sym["im"], sym["r"], True), (sym["im"], "x?", True), (sym["im"], sym["r"], False)], "source string, target string, is_implementation boolean")
    assert [tuple(r)[:3] for r in resolve.relationship_edges(rel, o, s).collect()] == [("im", "r", "IMPLEMENTS")]


def test_uncovered_and_diff(spark):
    sp = frame(spark, [(1, "p", 1, 10), (2, "p", 2, 5), (3, "p", 1, 10), (4, "p", 8, 12), (5, "q", 3, 3)], "id int, path string, start_line int, end_line int")
    assert sorted(r["id"] for r in resolve.uncovered(sp).collect()) == [1, 4, 5]
    a = frame(spark, [("x", "1"), ("y", "1"), ("z", None)], "id string, content_hash string")
    b = frame(spark, [("y", "2"), ("w", "1"), ("z", None)], "id string, content_hash string")
    assert {r["id"]: r["change"] for r in resolve.changed(a, b).collect()} == {"y": "changed", "w": "new"}
    assert [r["id"] for r in resolve.removed(a, b).collect()] == ["x"]


def test_affected_are_direct_dependents(spark):
    f = frame(spark, [("1", "a/x.ts"), ("2", "b/y.ts"), ("3", "c/z.ts")], "id string, path string")
    m = frame(spark, [("a",), ("b",), ("c",)], "path string")
    e = frame(spark, [("2", "1", "IMPORTS"), ("3", "2", "IMPORTS")], "source_id string, target_id string, edge_type string")
    got = resolve.affected_modules(frame(spark, [("a/x.ts",)], "path string"), f, m, e)
    assert {r["module"]: r["reason"] for r in got.collect()} == {"a": "changed", "b": "imports"}


def test_a_name_of_many_symbols_is_one_row_in_the_joins(spark):
    s = spark.range(300).selectExpr("id", "concat('a.', elt(cast(id % 3 as int) + 1, 'Run', 'run', 'go')) as qualified_name", "concat('p', id % 7) as path", "cast(id % 5 as int) as start_line")
    got = resolve.resolve_name(s, spark.createDataFrame([("a.run",), ("Run",), ("A.GO",), ("none",)], "name string"))
    rows = [tuple(r) for r in s.collect()]
    first = lambda q: min((p, line, i) for i, n, p, line in rows if n == q)[2]
    assert sorted(map(tuple, got.collect())) == [("A.GO", first("a.go"), "case"), ("Run", first("a.Run"), "suffix"), ("a.run", first("a.run"), "exact")]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [qualified_name") == 3  # one below each kind of join


def test_references_are_shuffled_once_for_each_join(spark):
    occ = frame(spark, [("x/f.", True, "a", 1, 0), ("x/f.", False, "a", 12, 1), ("x/f.", False, "b", 3, 2), ("x/f.", False, "a", 2, 3)], "symbol string, is_definition boolean, path string, line int, ordinal int")
    sym = frame(spark, [(1, "f", "a", 1, 5, "function"), (2, "g", "a", 10, 20, "class"), (3, "h", "a", 11, 13, "class")], "id int, qualified_name string, path string, start_line int, end_line int, kind string")
    was = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = resolve.reference_edges(occ, sym)
        assert [tuple(r) for r in got.collect()] == [(3, 1, "CALLS", 0.9, "scip", "a", 12, 1)]
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, x in was.items():
            spark.conf.set(k, x)
    assert sum(" Exchange hashpartitioning(" in x for x in plan.splitlines()) <= 11
