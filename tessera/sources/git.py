"""Facts from a git repository, by its command line on the driver."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: History window and framing of the log.
MAX_COMMITS = 500
RECORD, FIELD = "\x01", "\x02"


def _git(root: str, *args: str) -> bytes:
    return subprocess.run(["git", "-C", root, *args], check=True, capture_output=True).stdout


def head(root: str) -> str:
    return _git(root, "rev-parse", "HEAD").decode().strip()


def tracked_files(root: str) -> list[str]:
    return [p for p in _git(root, "ls-files", "-z").decode("utf-8", "surrogateescape").split("\0") if p]


def changed_since(root: str, commit: str) -> list[str]:
    """Tracked paths changed since a commit, committed or not; untracked ones don't count."""
    out = _git(root, "-c", "core.quotepath=off", "diff", "--name-only", commit).decode("utf-8", "surrogateescape")
    return sorted({x.strip() for x in out.split("\n") if x.strip()})


def raw_log(root: str, commits: int = MAX_COMMITS) -> str:
    form = f"--format={RECORD}%H{FIELD}%an{FIELD}%aI"
    return _git(root, "-c", "core.quotepath=off", "log", f"-{commits}", "--no-renames", "--name-only", form).decode("utf-8", "replace")


def parse_log(spark: SparkSession, raw: str) -> DataFrame:
    """``commit, author, at, position, path``; position 0 is the newest commit."""
    one = spark.createDataFrame([(raw,)], "raw string")
    rec = one.select(F.posexplode(F.filter(F.split("raw", RECORD), lambda x: F.trim(x) != "")).alias("position", "r"))
    lines = rec.select("position", F.split("r", "\n").alias("l"))
    head_ = F.split(F.col("l")[0], FIELD)
    paths = F.filter(F.transform(F.slice("l", F.lit(2), F.size("l")), F.trim), lambda x: x != "")
    return lines.select("position", head_[0].alias("commit"), head_[1].alias("author"), head_[2].alias("at"), F.explode(paths).alias("path"))


def history(spark: SparkSession, root: str) -> DataFrame:
    return parse_log(spark, raw_log(root))
