"""Packing evidence under a token budget.

Relational: many groups at once with an additive cost, greedy with skips, all JVM.
Exact: one pack whose rendered text is counted as a whole, on the driver; a pack holds
64,000 tokens at most.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.tokens import TokenCounter, checked_budget, count_pieces

# --- relational ----------------------------------------------------------------------


def greedy_pack(items: DataFrame, group: str, order: str, cost: str, budget: int, item: str) -> DataFrame:
    """``group, kept, used, dropped``: items in order, each kept if it still fits.

    An item that doesn't fit is skipped and later, smaller ones may still fit, so this
    is no running sum with a cut-off.
    """
    row = F.struct(F.col(order).alias("o"), F.col(item).alias("i"), F.col(cost).cast("long").alias("c"))
    lists = items.groupBy(group).agg(F.sort_array(F.collect_list(row)).alias("items"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<{items.schema[item].dataType.simpleString()}>").alias("kept"))
    fold = F.aggregate(
        "items",
        start,
        lambda s, x: F.when(
            s["used"] + x["c"] <= budget, F.struct((s["used"] + x["c"]).alias("used"), F.concat(s["kept"], F.array(x["i"])).alias("kept"))
        ).otherwise(s),
    )
    packed = lists.select(group, F.size("items").alias("n"), fold.alias("p"))
    return packed.select(group, F.col("p.kept").alias("kept"), F.col("p.used").alias("used"), (F.col("n") - F.size("p.kept")).alias("dropped"))


def line_range(files: DataFrame, start: int, end: int | None, budget: int = 2000, most_lines: int = 200) -> DataFrame:
    """``path, from_line, to_line, text, more``: numbered lines from ``start`` to ``end``
    (default 20 on), at most ``most_lines``, cut from the end until they fit the budget."""
    from tessera.functions.tokens import piece_count

    end = start + 20 if end is None else end
    end = min(end, start + most_lines - 1)
    lines = F.slice(F.split("text", "\n", -1), start, max(end - start + 1, 1))
    shown = F.transform(lines, lambda x, i: F.concat((i + start).cast("string"), F.lit("\t"), x))

    def step(s, x):
        fits = s["open"] & (s["used"] + piece_count(x) <= budget)
        return F.struct(
            fits.alias("open"),
            F.when(fits, s["used"] + piece_count(x)).otherwise(s["used"]).alias("used"),
            F.when(fits, s["n"] + 1).otherwise(s["n"]).alias("n"),
        )

    init = F.struct(F.lit(True).alias("open"), F.lit(0).cast("long").alias("used"), F.lit(0).alias("n"))
    cut = files.select("path", shown.alias("shown"), F.size(F.split("text", "\n", -1)).alias("total")).withColumn("s", F.aggregate("shown", init, step))
    return cut.select(
        "path",
        F.lit(start).alias("from_line"),
        (F.lit(start) + F.col("s.n") - 1).alias("to_line"),
        F.array_join(F.slice("shown", F.lit(1), F.col("s.n")), "\n").alias("text"),
        (F.lit(start) + F.col("s.n") - 1 < F.col("total")).alias("more"),
    )


def round_robin(sections: DataFrame, order: Column, cost: str, budget: int) -> DataFrame:
    """Greedy over ``group, section, module``: sections in ``order``, and modules within
    each, so that one large module can't hide all later ones.  ``group, kept, used, dropped``."""
    items = sections.withColumn("__o", F.struct(order.alias("a"), F.col("module").alias("b"))).withColumn("__i", F.concat_ws(":", "section", "module"))
    return greedy_pack(items, "group", "__o", cost, budget, "__i")


# --- exact -----------------------------------------------------------------------------


@dataclass
class ContextPack:
    text: str
    tokens: int
    budget: int
    symbol_ids: list = field(default_factory=list)
    source_ids: list = field(default_factory=list)
    source_omissions: list = field(default_factory=list)
    total_symbols: int = 0
    total_edges: int = 0
    included_edges: int = 0


class StaleSource(LookupError):
    """The file isn't indexed, lies outside, is too large or has changed."""


def read_source(root: str, path: str, content_hash: str | None, most: int = 1 << 20) -> str:
    """The text of an indexed file: below the root even through links, of at most 1 MiB
    and with the indexed hash."""
    if content_hash is None:
        raise StaleSource(f"{path} is not indexed")
    top = Path(root).resolve()
    try:
        file = (top / path).resolve(strict=True)
    except OSError as e:
        raise StaleSource(path) from e
    if not file.is_relative_to(top) or not file.is_file():
        raise StaleSource(f"{path} is outside of the repository")
    if file.stat().st_size > most:
        raise StaleSource(f"{path} is too large")
    raw = file.read_bytes()
    if hashlib.sha256(raw).hexdigest() != content_hash:
        raise StaleSource(f"{path} has changed since it was indexed")
    return raw.decode("utf-8", "replace")


def pack_context(header: str, candidates: list[dict], edges: list[dict], seeds: set, budget: int = 2000, read=None, count: TokenCounter = count_pieces, totals: tuple[int, int] | None = None) -> ContextPack:
    """Fit candidates (best first), their edges and, with ``read(symbol)``, sources.

    Seeds get a row first, then sources (largest first), other symbols and edges with
    both ends in; each stays only if the whole text still fits.  ``totals`` tells how many
    symbols and edges there are where not all are given.  Rows that a source
    covers are not shown.  What was left out is told in the text, which itself costs
    tokens: if it no longer fits, edges go first, then symbols, then sources.
    """
    checked_budget(budget)
    all_symbols, all_edges = totals or (len(candidates), len(edges))
    chosen, links, sources, omitted = [], [], [], []

    def covers(entry, s):
        a = entry[0]
        return a["path"] == s["path"] and a["start_line"] <= s["start_line"] and a["end_line"] >= s["end_line"]

    def render() -> str:
        number = {s["id"]: i + 1 for i, s in enumerate(chosen)}
        out = [
            header,
            f"Budget {budget}; symbols {len(chosen)} of {all_symbols}; relations {len(links)} of {all_edges}; sources {len(sources)}; sources left out {len(omitted)}.",
        ]
        for s in chosen:
            if not any(covers(x, s) for x in sources):
                tail = f" {s['signature']}" if s.get("signature") else ""
                out.append(f"{number[s['id']]}. {s['path']}:{s['start_line']}-{s['end_line']} {s['kind']} {s['qualified_name']}{tail}")
        out += [f"{number[e['source_id']]} {e['edge_type']} {number[e['target_id']]} ({e.get('analyzer', '')})" for e in links]
        for s, text in sources:
            out.append(f"source {number.get(s['id'], '-')} {s['qualified_name']} {s['path']}:{s['start_line']}-{s['end_line']}\n{text}")
        if omitted:
            out.append("Some sources did not fit or could not be read; ask for them one by one.")
        return "\n".join(out)

    def fits() -> bool:
        return count(render()) <= budget

    def attempt(into: list, item) -> bool:
        into.append(item)
        if not fits():
            into.pop()
            return False
        return True

    if not fits():
        raise ValueError("the budget can't hold even the header")
    for s in candidates:
        if s["id"] in seeds:
            attempt(chosen, s)
    if read is not None:
        wanted = [s for s in candidates if s["id"] in seeds] or candidates[:3]
        for s in sorted(wanted, key=lambda s: s["start_line"] - s["end_line"]):
            if any(covers(x, s) for x in sources):
                continue
            try:
                lines = read(s).split("\n")[s["start_line"] - 1 : s["end_line"]]
            except LookupError:
                omitted.append(s["id"])
                continue
            text = "\n".join(f"{s['start_line'] + i}\t{x}" for i, x in enumerate(lines))
            if not attempt(sources, (s, text)):
                omitted.append(s["id"])
    have = {s["id"] for s in chosen}
    for s in candidates:
        if s["id"] not in have:
            attempt(chosen, s)
    have = {s["id"] for s in chosen}
    for e in edges:
        if e["source_id"] in have and e["target_id"] in have:
            attempt(links, e)
    while not fits():
        if links:
            links.pop()
        elif chosen:
            chosen.pop()
        elif sources:
            omitted.append(sources.pop()[0]["id"])
        else:
            raise ValueError("the budget can't hold even the header")
    text = render()
    inside = [s["id"] for s in candidates if any(covers(x, s) for x in sources)]
    return ContextPack(text, count(text), budget, [s["id"] for s in chosen], inside, omitted, all_symbols, all_edges, len(links))


def pack_module(module: dict, fingerprint: str, evidence: dict[str, list], budget: int = 6000, max_symbols: int | None = None, max_edges: int | None = None, count: TokenCounter = count_pieces) -> dict:
    """A module's evidence as JSON under a budget, with counts of what was dropped.

    ``evidence``: symbols (best first, with ``id``), internal_edges (source_id, target_id),
    incoming, outgoing, files, tests, co_changes.  Symbols stop at three quarters of the
    budget, so that relations, files and tests get room.
    """
    checked_budget(budget)
    names = ("symbols", "internal_edges", "incoming", "outgoing", "files", "tests", "co_changes")
    dropped = {"symbols": "symbols", "internal_edges": "edges", "incoming": "dependencies", "outgoing": "dependencies", "files": "files", "tests": "tests", "co_changes": "co_changes"}
    out: dict = {"module": module, "fingerprint": fingerprint} | {n: [] for n in names} | {"dropped": {}}
    for n in names:
        out["dropped"][dropped[n]] = out["dropped"].get(dropped[n], 0) + len(evidence.get(n, []))

    def size() -> int:
        return count(json.dumps(out, ensure_ascii=False, separators=(",", ":")))

    def add(name: str, item) -> bool:
        out[name].append(item)
        out["dropped"][dropped[name]] -= 1
        if size() <= budget:
            return True
        out[name].pop()
        out["dropped"][dropped[name]] += 1
        return False

    if size() > budget:
        raise ValueError(f"the budget can't hold the metadata of {module.get('name')}")
    kept = set()
    for s in evidence.get("symbols", []):
        if (max_symbols is not None and len(out["symbols"]) >= max_symbols) or size() > budget * 0.75:
            break
        if add("symbols", {k: v for k, v in s.items() if k != "id"}):
            kept.add(s["id"])
    for e in evidence.get("internal_edges", []):
        if max_edges is not None and len(out["internal_edges"]) >= max_edges:
            break
        if e["source_id"] in kept and e["target_id"] in kept:
            add("internal_edges", {k: v for k, v in e.items() if k not in ("source_id", "target_id")})
    for n in names[2:]:
        for item in evidence.get(n, []):
            add(n, item)
    return out


#: The sections of a module dossier, in the order of packing.
SECTIONS = ("responsibility", "publicApi", "dependencies", "risks", "mainFlows", "testStrategy", "strengths", "opportunities")


def pack_repository(name: str, stats: dict, dossiers: list[tuple[str, dict]], budget: int = 6000, count: TokenCounter = count_pieces) -> dict:
    """All modules' names, then their dossiers section by section across the modules."""
    checked_budget(budget)
    body = json.dumps(dossiers, ensure_ascii=False, separators=(",", ":"))
    out: dict = {"repository": name, "stats": stats, "fingerprint": hashlib.sha256(body.encode()).hexdigest(), "modules": []}
    out["omitted"] = {"modules": len(dossiers), "sections": 0}

    def fits() -> bool:
        return count(json.dumps(out, ensure_ascii=False, separators=(",", ":"))) <= budget

    if not fits():
        raise ValueError("the budget can't hold the summary of the repository")
    held = []
    for module, dossier in dossiers:
        have = dossier if isinstance(dossier, dict) else {}
        n = sum(s in have for s in SECTIONS)
        out["modules"].append({"module": module, "dossier": {}})
        out["omitted"]["modules"] -= 1
        out["omitted"]["sections"] += n
        if fits():
            held.append((have, out["modules"][-1]["dossier"]))
        else:
            out["modules"].pop()
            out["omitted"]["modules"] += 1
            out["omitted"]["sections"] -= n
    for section in SECTIONS:
        for have, into in held:
            if section in have:
                into[section] = have[section]
                out["omitted"]["sections"] -= 1
                if not fits():
                    del into[section]
                    out["omitted"]["sections"] += 1
    return out
