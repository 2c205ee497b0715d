import pytest

from tessera.sources import extract_python, extract_typescript, policies, scip
from tessera.sources.services import LetterEmbedder, batches, model_key

PY = '''import os, json as j
from .models import User
from app.db import get

@app.get("/users")
async def list_users(limit: int = 10) -> list[User]:
    return []


class Service(Base):
    @router.post("/users/{id}")
    def create(self, data):
        def inner(): ...
        return data

    def plain(
        self,
        a,
    ):
        pass


def helper(x): return x
def test_it(): pass
'''


def test_python():
    got = extract_python.extract("app/main.py", PY)
    s = {(x["kind"], x["qualified_name"]): x for x in got["symbols"]}
    assert set(s) == {("endpoint", "GET /users"), ("function", "list_users"), ("class", "Service"), ("endpoint", "POST /users/{id}"), ("method", "Service.create"), ("method", "Service.plain"), ("function", "helper"), ("function", "test_it")}
    f = s["function", "list_users"]
    assert (f["signature"], f["start_line"], f["end_line"]) == ("(limit: int = 10) -> list[User]", 5, 7)
    assert s["method", "Service.plain"]["signature"] == "( self, a, )" and s["method", "Service.create"]["parent"] == "Service" and s["class", "Service"]["signature"] is None
    assert [x["specifier"] for x in got["imports"]] == ["os", "json", ".models", "app.db"]
    assert got["tests"] == [] and [x["name"] for x in extract_python.extract("test_main.py", PY)["tests"]] == ["test_it"]
    assert extract_python.extract("x.py", "def (")["symbols"] == []


TS = """import { a } from './a';
import type B from "../b"; // import './no'
import './side';
const notHere = "class Fake {}", re = /class Bad {}/;
/* function gone() {} */
export abstract class Service extends Base implements Port<string> {
  private count = 0;
  constructor(private readonly db: Db) { super(); }
  async run<T>(x: T, y = { a: 1 }): Promise<T> {
    if (x) { return x; }
    app.get('/inner', () => {});
  }
  handler = async (e: Event): Promise<void> => {
    this.run(e);
  };
  get size(): number { return 1; }
  abstract later(): void;
}
export interface Port<T> { save(x: T): void }
export const enum Color { Red, Green }
type Id = string |
  number;
export function load(id: Id): { ok: boolean } {
  return { ok: `${id}` === '}' };
}
export const arrow = (a: number, b: number) => a + b, other = 3;
const expr = function named(x) { return x; };
export default function main() {}
router.post("/users", handler);
client.get('/not-an-endpoint');
describe('group', () => {
  it('works', () => {});
  test("again", async () => {});
});
"""


def test_typescript():
    got = extract_typescript.extract("src/x.ts", TS)
    s = {(x["kind"], x["qualified_name"]): x for x in got["symbols"]}
    assert set(s) == {
        ("class", "Service"), ("method", "Service.constructor"), ("method", "Service.run"), ("method", "Service.handler"), ("method", "Service.size"), ("interface", "Port"), ("enum", "Color"),
        ("type", "Id"), ("function", "load"), ("function", "arrow"), ("function", "expr"), ("function", "main"), ("endpoint", "GET /inner"), ("endpoint", "POST /users"),
    }
    run = s["method", "Service.run"]
    assert (run["signature"], run["start_line"], run["end_line"], run["parent"]) == ("(x: T, y = { a: 1 }): Promise<T>", 9, 12, "Service")
    assert s["method", "Service.handler"]["signature"] == "(e: Event): Promise<void>" and s["class", "Service"]["end_line"] == 18
    assert s["function", "load"]["signature"] == "(id: Id): { ok: boolean }" and (s["function", "load"]["start_line"], s["function", "load"]["end_line"]) == (23, 25)
    assert (s["type", "Id"]["start_line"], s["type", "Id"]["end_line"]) == (21, 22) and s["function", "arrow"]["signature"] == "(a: number, b: number)"
    assert [x["specifier"] for x in got["imports"]] == ["./a", "../b", "./side"]
    assert [x["name"] for x in got["tests"]] == ["works", "again"]


def _field(n, value):
    def var(x):
        out = b""
        while x > 127:
            out, x = out + bytes([x & 127 | 128]), x >> 7
        return out + bytes([x])

    if isinstance(value, int):
        return var(n << 3) + var(value)
    return var(n << 3 | 2) + var(len(value)) + value


def test_scip():
    def occ(symbol, roles, rng=b"", single=None):
        return _field(2, (_field(1, rng) if rng else b"") + _field(2, symbol.encode()) + (_field(3, roles) if roles else b"") + (_field(8, _field(1, single)) if single is not None else b""))

    rel = _field(3, _field(1, b"pkg A#") + _field(4, _field(1, b"pkg I#") + _field(3, 1)) + _field(4, _field(1, b"pkg X#") + _field(2, 1)))
    doc = _field(1, b"src/a.ts") + occ("pkg A#", 1, bytes([4, 0, 9])) + occ("local 3", 0, bytes([1, 0, 2])) + occ("pkg B#", 8, single=6) + occ("pkg C#", 0, bytes([1, 2])) + rel
    o, r = scip.decode(_field(1, _field(3, b"root")) + _field(2, doc))
    assert o == [("pkg A#", True, "src/a.ts", 5, 0), ("pkg B#", False, "src/a.ts", 7, 1)] and r == [("pkg A#", "pkg I#", True)]


def test_policies(tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "b.yml").write_text("id: b\nseverity: high\ncandidate_detectors:\n  - module_cycle\n  - name: high_fan_in\n    params: {threshold: 3}\n")
    (tmp_path / "a.yaml").write_text("id: a\nseverity: low\ncandidate_detectors: [untested_module]\n")
    got = policies.load_policies(str(tmp_path))
    assert [p.id for p in got] == ["a", "b"] and got[1].candidate_detectors == [("module_cycle", {}), ("high_fan_in", {"threshold": 3})]
    for bad in ({"id": "x", "severity": "low"}, {"id": "x", "severity": "worst", "candidate_detectors": ["a"]}, [], {"id": "x", "severity": "low", "candidate_detectors": [3]}):
        with pytest.raises(ValueError):
            policies.parse_policy(bad)


def test_services():
    assert len(LetterEmbedder().embed(["ab"])[0]) == 26 and [len(b) for b in batches(map(str, range(70)))] == [32, 32, 6]
    assert model_key({"model_id": "a", "model_sha": "b"}) == model_key({"model_sha": "b", "model_id": "a"})
    with pytest.raises(ValueError):
        model_key({"model_id": "a"})
