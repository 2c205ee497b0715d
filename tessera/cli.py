"""Command line: ``python -m tessera.cli COMMAND``."""

from __future__ import annotations

import argparse
import importlib
import importlib.util
import json
import shutil
import sys

OPTIONAL = {"tokenizers": "exact token counts", "yaml": "policies", "tree_sitter": "not used; extractors are built in"}


def doctor() -> dict:
    """What is here: required and optional, and whether all required is."""
    required = {"java": shutil.which("java") is not None, "git": shutil.which("git") is not None, "pyspark": importlib.util.find_spec("pyspark") is not None}
    optional = {k: importlib.util.find_spec(k) is not None for k in OPTIONAL}
    return {
        "required": required,
        "optional": optional,
        "missing_required": sorted(k for k, v in required.items() if not v),
        "missing_optional": sorted(k for k, v in optional.items() if not v),
        "healthy": all(required.values()),
    }


def doctor_text(report: dict) -> str:
    lines = [f"{'ok     ' if v else 'missing'}  {k}" for part in ("required", "optional") for k, v in report[part].items()]
    end = "Ready." if report["healthy"] else f"Not ready: {', '.join(report['missing_required'])} must be installed."
    return "\n".join([*lines, end])


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, help_: str, *args: tuple) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=help_)
        if name != "doctor":
            c.add_argument("--store", required=True, help="folder of the repository's store")
        for flags, kw in args:
            c.add_argument(*flags, **kw)
        return c

    path, name = (("path",), {}), (("--name",), {"default": None})
    budget = (("--max-tokens",), {"type": int, "default": 2000})
    add("scan", "scan a working tree into a snapshot", path, name, (("--scip",), {"default": None, "help": "a SCIP index"}))
    add("refresh", "scan again if something changed", path, name, (("--scip",), {"default": None}))
    add("onboard", "scan, index vectors and give an overview", path, name)
    add("query", "hybrid search", (("text",), {}), (("--limit",), {"type": int, "default": 8}))
    add("context", "a budgeted context pack", (("query",), {"nargs": "?"}), (("--symbol",), {"action": "append", "default": []}), (("--module",), {"default": None}), (("--source",), {"action": "store_true"}), budget)
    add("benchmark-tokens", "whole files against packs", (("cases",), {}), budget)
    add("audit", "run policies", (("policies",), {"help": "folder of YAML files"}))
    add("brief", "counts, modules and the stored brief")
    add("analyze", "dossiers of modules and a brief by a language model", (("--model",), {"default": None, "help": "module:attribute of a model"}), (("--module",), {"default": None}),
        (("--dry-run",), {"action": "store_true", "help": "only the sizes of the evidence packs"}), (("--max-tokens",), {"type": int, "default": 4000}))
    add("reindex", "store vectors of the latest snapshot")
    add("callers", "who calls a symbol", (("symbol",), {}), (("--depth",), {"type": int, "default": 3}))
    add("symbol", "a symbol and its relations", (("symbol",), {}))
    add("findings", "confirmed findings", (("--severity",), {"action": "append", "default": None}), (("--module",), {"default": None}))
    add("evidence", "lines of an indexed file", (("path",), {}), (("--start",), {"type": int, "default": 1}), (("--end",), {"type": int, "default": None}))
    add("doctor", "what is installed")
    return p


def run(args: argparse.Namespace, spark=None) -> object:
    if args.command == "doctor":
        return doctor_text(doctor())
    from tessera import ingest
    from tessera.catalog import Store
    from tessera.engine import Engine
    from tessera.sources.policies import load_cases, load_policies
    from tessera.sources.services import LetterEmbedder

    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("tessera").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store = Store(spark, args.store)
    engine = Engine(store, embedder=LetterEmbedder())
    index = open(args.scip, "rb").read() if getattr(args, "scip", None) else None
    match args.command:
        case "scan":
            return ingest.scan(spark, args.path, store, args.name, index)
        case "refresh":
            return vars(ingest.refresh(spark, args.path, store, args.name, index))
        case "onboard":
            done = ingest.scan(spark, args.path, store, args.name)
            return done | {"embedded": engine.reindex()} | engine.overview()
        case "query":
            return [r.asDict() for r in engine.search(args.text, args.limit).collect()]
        case "context":
            return engine.context_pack(args.query, args.module, args.symbol, args.max_tokens, args.source).text
        case "benchmark-tokens":
            return engine.token_benchmark(load_cases(args.cases), args.max_tokens)
        case "audit":
            return [r.asDict() for r in engine.audit(load_policies(args.policies)).collect()]
        case "brief":
            return engine.overview()
        case "analyze" if args.dry_run:
            ranked, out = engine.ranking(), []
            for m in engine.table("modules").orderBy("path").collect():
                if args.module in (None, m["name"], m["path"]):
                    pack = engine.module_pack(m["path"], args.max_tokens, ranked=ranked)
                    out.append({"module": m["name"], "symbols": len(pack["symbols"]), "tokens": engine.count(json.dumps(pack, ensure_ascii=False))})
            return out
        case "analyze":
            if not args.model or ":" not in args.model:
                raise SystemExit("analyze needs --model module:attribute or --dry-run")
            where, what = args.model.split(":", 1)
            model = getattr(importlib.import_module(where), what)
            return engine.analyze(model() if isinstance(model, type) else model, module=args.module, budget=args.max_tokens)
        case "reindex":
            return {"embedded": engine.reindex()}
        case "callers":
            return engine.find_callers(args.symbol, args.depth)
        case "symbol":
            return engine.symbol_context(args.symbol)
        case "findings":
            return engine.findings(args.severity, args.module)
        case "evidence":
            return engine.get_evidence(path=args.path, start=args.start, end=args.end)


def main(argv: list[str] | None = None) -> int:
    out = run(parser().parse_args(argv))
    print(out if isinstance(out, str) else json.dumps(out, indent=2, default=str, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    sys.exit(main())
