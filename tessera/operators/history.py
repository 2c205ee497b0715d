"""Git history, co-change, counts, de-duplication and fingerprints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_RUN = 250_000  # rows of files in commits that one task pairs


def snapshot_counts(tables: dict[str, DataFrame], snapshot_id: str | None = None) -> DataFrame:
    """``name, rows`` of each table, of one snapshot or of all."""
    parts = []
    for name, df in sorted(tables.items()):
        one = df if snapshot_id is None else df.where(F.col("snapshot_id") == F.lit(snapshot_id))
        parts.append(one.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows"))
    return reduce(DataFrame.union, parts)


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    """The one snapshot created last, over all repositories; ties to the greater id."""
    return snapshots.orderBy(F.desc("created_at"), F.desc("id")).limit(1)


def file_history(log: DataFrame) -> DataFrame:
    """``path, commit_count, last_author, last_commit_at, first_commit_at``.

    ``log``: path, author, at, position (0 is the newest).  First and last go by position
    in the log, never by the dates.
    """
    return log.groupBy("path").agg(
        F.count(F.lit(1)).alias("commit_count"),
        F.min_by("author", "position").alias("last_author"),
        F.min_by("at", "position").alias("last_commit_at"),
        F.max_by("at", "position").alias("first_commit_at"),
    )


def co_change(commits: DataFrame, least: int = 3, limit: int | None = 50, smallest: int = 2, largest: int = 30) -> DataFrame:
    """``a, b, commits``: pairs of files in one commit, a < b, counted over commits.

    ``commits``: commit, path.  Commits of under ``smallest`` or over ``largest`` files don't
    count, which bounds the pairs of a commit; ties by (a, b).  Tasks follow the exact number
    of rows, and so each holds a bounded number of commits and of pairs.
    """
    tasks = max(commits.sparkSession.sparkContext.defaultParallelism, -(-commits.count() // _RUN))
    one = commits.repartition(tasks, "commit").groupBy("commit").agg(F.collect_set("path").alias("paths")).where(F.size("paths").between(smallest, largest))
    # pairs are made within the row of a commit: no self-join, one shuffle for the counts
    p = F.array_sort("paths")
    pairs = one.select(p.alias("p")).select(
        F.explode(
            F.flatten(
                F.transform("p", lambda x, i: F.transform(F.slice("p", i + 2, F.size("p")), lambda y: F.struct(x.alias("a"), y.alias("b"))))
            )
        ).alias("x")
    )
    # few pairs repeat within a task, so they are counted after the shuffle alone
    out = pairs.select("x.a", "x.b").repartition(tasks, "a", "b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("commits")).where(F.col("commits") >= least)
    return out.orderBy(F.desc("commits"), "a", "b").limit(limit) if limit is not None else out


def keep_first(df: DataFrame, keys: list[str], ordinal: str, last: bool = False) -> DataFrame:
    """One row a key: the first (or last) by an explicit ordinal."""
    o = F.desc(ordinal) if last else F.col(ordinal)
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(o))).where("__r = 1").drop("__r")


def fingerprint(groups: DataFrame, by: str, parts: dict[str, Column]) -> DataFrame:
    """``by, fingerprint``: SHA-256 of JSON with each named list sorted."""
    lists = [F.sort_array(F.collect_list(c)).alias(n) for n, c in parts.items()]
    body = F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})
    return groups.groupBy(by).agg(*lists).select(by, F.sha2(body, 256).alias("fingerprint"))


def symbol_totals(symbols: DataFrame, tested: DataFrame) -> DataFrame:
    """``module, symbols, tested`` for symbols with a module; ``tested`` holds paths."""
    t = tested.toDF("path").distinct().withColumn("__t", F.lit(True))
    return symbols.join(t, "path", "left").groupBy("module").agg(F.count(F.lit(1)).alias("symbols"), F.bool_or(F.coalesce("__t", F.lit(False))).alias("tested"))


def savings(cases: DataFrame) -> DataFrame:
    """Totals of ``baseline, context, map_only, complete, requested`` with percents saved."""
    sums = cases.agg(*[F.sum(c).alias(c) for c in ("baseline", "context", "map_only", "complete", "requested")])
    saved = F.col("baseline") - F.col("context")
    return sums.withColumn("saved", saved).withColumn("percent", F.floor(saved * 1000.0 / F.greatest("baseline", F.lit(1)) + 0.5) / 10)
