"""Cached model analysis: keys, hits, work lists and checks of a model's answers."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.schema import SEVERITIES

#: Fields of a module's dossier and of a repository brief, and what each holds.
DOSSIER = {
    "responsibility": "text",
    "publicApi": "texts",
    "dependencies": "ends",
    "mainFlows": "texts",
    "strengths": "claims",
    "risks": "risks",
    "opportunities": "claims",
    "testStrategy": "text",
}
BRIEF = {
    "objective": "text",
    "architecture": "text",
    "entryPoints": "texts",
    "boundedContexts": "texts",
    "criticalFlows": "texts",
    "persistence": "text",
    "testing": "text",
    "hotspots": "claims",
    "technicalDebt": "claims",
    "conventions": "texts",
}


class Model(Protocol):
    name: str

    def complete(self, prompt: str, schema: dict[str, str]) -> tuple[dict, int, int]:
        """The answer and the tokens that went in and out; ``schema`` tells its fields."""


def cache_key(pack: dict, prompt_version: str, model: str) -> str:
    body = json.dumps(pack, ensure_ascii=False, separators=(",", ":"), sort_keys=True)
    return hashlib.sha256(f"{body}\n{prompt_version}\n{model}".encode()).hexdigest()


def latest_summaries(summaries: DataFrame) -> DataFrame:
    """The last row of each (subject, level, hash, prompt, model)."""
    w = Window.partitionBy("subject_id", "level", "content_hash", "prompt_version", "model").orderBy(F.desc("created_at"), F.desc("id"))
    return summaries.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def work_list(wanted: DataFrame, summaries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of ``subject_id, level, content_hash, prompt_version, model``: a hit of
    another snapshot is a row to copy, a miss is work for the model."""
    keys = ["subject_id", "level", "content_hash", "prompt_version", "model"]
    last = latest_summaries(summaries)
    hits = wanted.join(last.select(*keys, "content_json", F.col("snapshot_id").alias("from_snapshot")), keys)
    return hits, wanted.join(last.select(*keys), keys, "left_anti")


def _holds(value: object, kind: str) -> bool:
    """Whether a field's value is what its kind says."""
    if kind == "text":
        return isinstance(value, str)
    if kind == "ends":
        return isinstance(value, dict) and set(value) == {"incoming", "outgoing"} and all(_holds(v, "texts") for v in value.values())
    if not isinstance(value, list):
        return False
    if kind == "texts":
        return all(isinstance(v, str) for v in value)
    names = {"claim", "evidence"} | ({"severity"} if kind == "risks" else set())
    return all(
        isinstance(v, dict) and set(v) == names and isinstance(v["claim"], str) and _holds(v["evidence"], "texts") and v.get("severity", SEVERITIES[0]) in SEVERITIES for v in value
    )


def check_answer(answer: object, fields: dict[str, str] = DOSSIER) -> dict:
    """The answer if it has every field and no other, each with what it should hold;
    raises otherwise."""
    if not isinstance(answer, dict):
        raise ValueError("an answer is an object")
    missing, extra = set(fields) - set(answer), set(answer) - set(fields)
    if missing or extra:
        raise ValueError(f"missing fields {sorted(missing)}, unknown fields {sorted(extra)}")
    wrong = sorted(k for k, v in answer.items() if not _holds(v, fields[k]))
    if wrong:
        raise ValueError(f"fields of another type {wrong}")
    return answer


def analyse(packs: list[tuple[str, dict]], cache: dict[str, dict], model: Model, prompt_version: str, prompt: Callable[[dict], str], fields: dict[str, str] = DOSSIER):
    """Ask the model for each (subject, pack) that the cache lacks, in the given order.

    Returns the answers by subject, the new cache rows and counters.
    """
    answers, fresh = {}, {}
    counts = {"analyzed": 0, "cached": 0, "input_tokens": 0, "output_tokens": 0}
    for subject, pack in packs:
        key = cache_key(pack, prompt_version, model.name)
        if key in cache or key in fresh:
            counts["cached"] += 1
        else:
            answer, used, made = model.complete(prompt(pack), fields)
            fresh[key] = check_answer(answer, fields)
            counts["analyzed"] += 1
            counts["input_tokens"] += used
            counts["output_tokens"] += made
        answers[subject] = fresh.get(key) or cache[key]
    return answers, fresh, counts
