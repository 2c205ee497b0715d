"""Symbols, imports and tests of Python source, from the standard parser."""

from __future__ import annotations

import ast
import re

#: Decorator methods that make an endpoint.
METHODS = {"get", "post", "put", "delete", "patch", "head", "options", "websocket"}


def is_test(path: str) -> bool:
    return re.search(r"(^|/)test_[^/]+\.py$|_test\.py$", path) is not None


def _squeeze(text: str | None) -> str | None:
    return re.sub(r"\s+", " ", text).strip() if text else None


def _signature(source: str, node) -> str | None:
    """Parameters as written and the return type."""
    text = ast.get_source_segment(source, node) or ""
    at = re.match(r"(?:async\s+)?def\s+\w+\s*(?:\[[^\]]*\]\s*)?", text)
    if not at:
        return None
    depth, end = 0, at.end()
    for i in range(at.end(), len(text)):
        depth += (text[i] in "([{") - (text[i] in ")]}")
        if depth == 0:
            end = i + 1
            break
    back = _squeeze(ast.get_source_segment(source, node.returns)) if node.returns else None
    return f"{_squeeze(text[at.end() : end])}{f' -> {back}' if back else ''}"


def _endpoint(decorators) -> str | None:
    for d in decorators:
        if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.func.attr in METHODS and d.args:
            route = d.args[0]
            if isinstance(route, ast.Constant) and isinstance(route.value, str) and route.value.startswith("/"):
                return f"{d.func.attr.upper()} {route.value}"
    return None


def extract(path: str, source: str) -> dict[str, list[dict]]:
    """``symbols, imports, tests``; source that doesn't parse has none.

    A decorated definition starts at its first decorator; an endpoint spans that line.
    """
    out: dict[str, list[dict]] = {"symbols": [], "imports": [], "tests": []}
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return out

    def add(name, kind, start, end, signature=None, parent=None):
        out["symbols"].append({"qualified_name": name, "kind": kind, "signature": signature, "start_line": start, "end_line": end, "parent": parent})

    def function(node, owner):
        marks = node.decorator_list
        start, end = (marks[0].lineno, marks[0].end_lineno) if marks else (node.lineno, node.end_lineno)
        route = _endpoint(marks)
        if route:
            add(route, "endpoint", start, end)
        name = f"{owner}.{node.name}" if owner else node.name
        add(name, "method" if owner else "function", start, node.end_lineno, _signature(source, node), owner)
        if is_test(path) and node.name.startswith("test_"):
            out["tests"].append({"name": name, "start_line": start})

    for node in tree.body:
        if isinstance(node, ast.ClassDef):
            start = node.decorator_list[0].lineno if node.decorator_list else node.lineno
            add(node.name, "class", start, node.end_lineno)
            for x in node.body:
                if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    function(x, node.name)
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            function(node, None)
        elif isinstance(node, ast.Import):
            out["imports"] += [{"specifier": a.name, "start_line": node.lineno} for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            out["imports"].append({"specifier": "." * node.level + (node.module or ""), "start_line": node.lineno})
    for x in ("symbols", "tests"):
        out[x].sort(key=lambda s: s["start_line"])
    return out
