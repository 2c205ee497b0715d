"""Architecture policies: detectors, verdicts and findings.

A detector gives candidates ``detector, module, subject, claim, evidence`` where evidence
is an array of structs (path, line, detail); candidates without evidence are dropped.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import edge_evidence, is_ts_test, uri_path

Facts = dict[str, DataFrame]
Detector = Callable[[Facts, dict[str, Any]], DataFrame]


def _evidence(path, line, detail):
    return F.struct(path.cast("string").alias("path"), line.cast("int").alias("line"), detail.cast("string").alias("detail"))


def module_imports(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """``from, to`` and the first import edge of each pair of modules; ``owners``: id, module."""
    a = owners.select(F.col("id").alias("source_id"), F.col("module").alias("from"))
    b = owners.select(F.col("id").alias("target_id"), F.col("module").alias("to"))
    e = edges.where("edge_type = 'IMPORTS'").join(a, "source_id").join(b, "target_id").where(F.col("from") != F.col("to"))
    return e.groupBy("from", "to").agg(F.min(F.struct("source_id", "target_id", "evidence_json")).alias("e")).select("from", "to", "e.*")


def module_cycle(facts: Facts, params: dict) -> DataFrame:
    """Pairs of modules that import each other: one candidate a pair, one import each way."""
    m = module_imports(facts["edges"], facts["owners"])
    back = m.select(F.col("from").alias("b"), F.col("to").alias("a"), F.struct("source_id", "evidence_json").alias("back"))
    both = m.where(F.col("from") < F.col("to")).join(back, (F.col("from") == F.col("a")) & (F.col("to") == F.col("b")))
    ev = F.array(
        *[
            _evidence(F.coalesce(edge_evidence(j)["path"], uri_path(s.cast("string"))), F.coalesce(edge_evidence(j)["line"], F.lit(1)), edge_evidence(j)["specifier"])
            for s, j in ((F.col("source_id"), F.col("evidence_json")), (F.col("back.source_id"), F.col("back.evidence_json")))
        ]
    )
    return both.select(
        F.lit("module_cycle").alias("detector"), F.col("from").alias("module"), F.concat_ws(" <-> ", "from", "to").alias("subject"),
        F.concat(F.lit("Modules "), "from", F.lit(" and "), "to", F.lit(" import each other")).alias("claim"), ev.alias("evidence"),
    )


def high_fan_in(facts: Facts, params: dict) -> DataFrame:
    """Symbols that at least ``threshold`` CALLS and DEPENDS_ON edges point to."""
    from .graph import fan_in

    hot = fan_in(facts["edges"], ["CALLS", "DEPENDS_ON"]).where(F.col("fan_in") >= int(params.get("threshold", 20)))
    s = facts["symbols"].join(hot, F.col("id") == F.col("target_id"))
    return s.select(
        F.lit("high_fan_in").alias("detector"), F.lit(None).cast("string").alias("module"), F.col("qualified_name").alias("subject"),
        F.concat(F.col("qualified_name"), F.lit(" is used by "), F.col("fan_in").cast("string"), F.lit(" references")).alias("claim"),
        F.array(_evidence(F.col("path"), F.col("start_line"), F.col("signature"))).alias("evidence"),
    )


def untested_module(facts: Facts, params: dict) -> DataFrame:
    """Modules of at least ``minSymbols`` symbols without a tested or a test file."""
    from .history import symbol_totals

    files, owners = facts["files"], facts["owners"]
    tested = facts["edges"].where("edge_type = 'TESTED_BY'").select(F.col("source_id").alias("id")).distinct()
    paths = files.join(tested, "id", "left_semi").select("path").union(files.where(is_ts_test(F.col("path"))).select("path"))
    own = files.join(owners.select("id", "module"), "id").select("path", "module")
    s = facts["symbols"].select("path", "start_line").join(own, "path")
    no = symbol_totals(s, paths).where((F.col("symbols") >= int(params.get("minSymbols", 5))) & ~F.col("tested") & F.col("module").isNotNull())
    first = s.groupBy("module").agg(F.min(F.struct("path", "start_line")).alias("f"))
    return no.join(first, "module").select(
        F.lit("untested_module").alias("detector"), "module", F.col("module").alias("subject"),
        F.concat(F.lit("Module "), "module", F.lit(" has "), F.col("symbols").cast("string"), F.lit(" symbols and no test")).alias("claim"),
        F.array(_evidence(F.col("f.path"), F.col("f.start_line"), F.lit(None))).alias("evidence"),
    )


def forbidden_import(facts: Facts, params: dict) -> DataFrame:
    """Imports from paths like ``from`` whose specifier or target is like ``to``."""
    e = facts["edges"].where("edge_type = 'IMPORTS'")
    x = edge_evidence(F.col("evidence_json"))
    path = F.coalesce(x["path"], uri_path(F.col("source_id").cast("string")))
    target = uri_path(F.col("target_id").cast("string"))
    e = e.select(path.alias("path"), F.coalesce(x["line"], F.lit(1)).alias("line"), x["specifier"].alias("specifier"), target.alias("target"))
    if not params.get("from") or not params.get("to"):
        hit = e.limit(0)
    else:
        hit = e.where(F.col("path").rlike(params["from"]) & (F.coalesce(F.col("specifier"), F.lit("")).rlike(params["to"]) | F.col("target").rlike(params["to"])))
    return hit.select(
        F.lit("forbidden_import").alias("detector"), F.lit(None).cast("string").alias("module"), F.col("path").alias("subject"),
        F.concat("path", F.lit(" imports "), F.coalesce("specifier", "target")).alias("claim"),
        F.array(_evidence(F.col("path"), F.col("line"), F.col("specifier"))).alias("evidence"),
    )


DETECTORS: dict[str, Detector] = {
    "module_cycle": module_cycle,
    "high_fan_in": high_fan_in,
    "untested_module": untested_module,
    "forbidden_import": forbidden_import,
}


@dataclass
class Policy:
    id: str
    severity: str
    candidate_detectors: list[tuple[str, dict]]
    description: str = ""
    judge: dict = field(default_factory=dict)


def candidates(policy: Policy, facts: Facts, detectors: dict[str, Detector] | None = None) -> DataFrame:
    """All candidates of a policy, numbered by detector, subject and claim."""
    from functools import reduce

    from pyspark.sql.window import Window

    known = DETECTORS if detectors is None else detectors
    parts = []
    for name, params in policy.candidate_detectors:
        if name not in known:
            raise LookupError(f"policy {policy.id}: no detector {name!r}")
        parts.append(known[name](facts, params))
    every = reduce(DataFrame.unionByName, parts).where(F.size("evidence") > 0)
    every = every.withColumn("policy_id", F.lit(policy.id)).withColumn("severity", F.lit(policy.severity))
    return every.withColumn("index", F.row_number().over(Window.partitionBy("policy_id").orderBy("detector", "subject", "claim")) - 1)


def judged(cands: DataFrame, verdicts: DataFrame | None) -> DataFrame:
    """Candidates with ``status``, ``confidence`` and ``recommendation``.

    Without a judge all are ``candidate`` with confidence 0.5.  With one (``index,
    confirmed, confidence, recommendation``) a candidate without a verdict is neither and
    goes; a verdict without a candidate is ignored; of two verdicts the confirming counts.
    """
    if verdicts is None:
        return cands.select("*", F.lit("candidate").alias("status"), F.lit(0.5).alias("confidence"), F.lit(None).cast("string").alias("recommendation"))
    v = verdicts.groupBy("index").agg(F.max(F.struct("confirmed", "confidence", "recommendation")).alias("v"))
    j = cands.join(v, "index")
    return j.select(
        *cands.columns, F.when(F.col("v.confirmed"), "confirmed").otherwise("rejected").alias("status"), F.col("v.confidence").alias("confidence"),
        F.col("v.recommendation").alias("recommendation"),
    )


def findings_where(findings: DataFrame, severities: list[str] | None = None, module: str | None = None, status: str = "confirmed") -> DataFrame:
    out = findings.where(F.col("status") == status)
    if severities:
        out = out.where(F.col("severity").isin(severities))
    if module is not None:
        out = out.where(F.col("module") == module)
    return out
