"""Policies from YAML files, and benchmark cases from JSON."""

from __future__ import annotations

import json
from pathlib import Path

from tessera.operators.policy import Policy
from tessera.schema import SEVERITIES


def parse_policy(data: object, where: str = "") -> Policy:
    if not isinstance(data, dict):
        raise ValueError(f"{where}: a policy is a mapping")
    for key in ("id", "severity", "candidate_detectors"):
        if not data.get(key):
            raise ValueError(f"{where}: {key} is missing")
    if data["severity"] not in SEVERITIES:
        raise ValueError(f"{where}: unknown severity {data['severity']!r}")
    detectors = []
    for d in data["candidate_detectors"]:
        if isinstance(d, str):
            detectors.append((d, {}))
        elif isinstance(d, dict) and d.get("name"):
            detectors.append((d["name"], d.get("params") or {}))
        else:
            raise ValueError(f"{where}: a detector is a name, or a name and params")
    return Policy(str(data["id"]), data["severity"], detectors, data.get("description", ""), data.get("judge") or {})


def load_policies(folder: str) -> list[Policy]:
    """All ``.yaml`` and ``.yml`` files below a folder, by id."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading policies needs PyYAML") from e
    found = [p for p in sorted(Path(folder).rglob("*")) if p.suffix in (".yaml", ".yml")]
    return sorted((parse_policy(yaml.safe_load(p.read_text(encoding="utf-8")), str(p)) for p in found), key=lambda p: p.id)


def load_cases(path: str) -> list[dict]:
    """Token benchmark cases: name, query, symbols."""
    cases = json.loads(Path(path).read_text(encoding="utf-8"))
    if not isinstance(cases, list) or not cases:
        raise ValueError("cases are a list")
    for c in cases:
        if not isinstance(c, dict) or not isinstance(c.get("name"), str) or not isinstance(c.get("symbols"), list) or not c["symbols"]:
            raise ValueError("a case has a name and symbols")
    return cases
