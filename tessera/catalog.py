"""The snapshot store: one Parquet folder a table, partitioned by snapshot.

A scan writes its facts first and the snapshot's row last, so that readers, who start
from the snapshots table, never see half of one.
"""

from __future__ import annotations

import datetime as dt
import json
import time
import uuid
from pathlib import PurePosixPath

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessera import schema
from tessera.operators.history import keep_first, latest_snapshot

REPLACED = ("repositories", "analysis_runs")  # each write is a whole new revision
BY_SNAPSHOT = ("files", "modules", "symbols", "edges", "metrics", "tests", "coverage", "vectors")


_REVISION = StructField("revision", LongType())


def now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._migrate()

    def path(self, table: str) -> str:
        return str(PurePosixPath(self.root) / table) if "://" not in self.root else f"{self.root}/{table}"

    def _migrate(self) -> None:
        """Note the schema's version once; an already noted one changes nothing."""
        try:
            have = self.spark.read.schema("version int").json(self.path("_schema")).agg(F.max("version")).first()[0]
        except AnalysisException:
            have = None
        if have is not None and have > schema.VERSION:
            raise RuntimeError(f"the store has schema {have}, this library {schema.VERSION}")
        if have != schema.VERSION:
            self.spark.createDataFrame([(schema.VERSION,)], "version int").coalesce(1).write.mode("append").json(self.path("_schema"))

    # --- reads -------------------------------------------------------------------------

    def read(self, table: str, snapshot_id: str | None = None) -> DataFrame:
        """A table with its declared columns, empty if nothing was written; a snapshot
        prunes partitions."""
        want = schema.TABLES[table]
        try:
            df = self.spark.read.schema(want if table not in REPLACED else StructType([*want, _REVISION])).parquet(self.path(table))
        except AnalysisException:
            return self.spark.createDataFrame([], want)
        if table in REPLACED:
            df = self._newest(df, want)
        if snapshot_id is not None:
            df = df.where(F.col("snapshot_id") == F.lit(snapshot_id))
        return df.select(*want.names)

    def _newest(self, df: DataFrame, want: StructType) -> DataFrame:
        last = df.agg(F.max("revision")).first()[0]
        return df.where(F.col("revision") == F.lit(last)) if last is not None else df.limit(0)

    def latest(self) -> str | None:
        row = latest_snapshot(self.read("snapshots")).first()
        return row["id"] if row else None

    def repository(self) -> dict | None:
        row = self.read("snapshots").orderBy(F.desc("created_at"), F.desc("id")).join(self.read("repositories").withColumnRenamed("id", "repository_id").drop("created_at"), "repository_id").first()
        return row.asDict() if row else None

    def by_ids(self, table: str, ids: DataFrame, snapshot_id: str | None = None) -> DataFrame:
        return self.read(table, snapshot_id).join(ids.toDF("id").distinct(), "id", "left_semi")

    # --- writes ------------------------------------------------------------------------

    def append(self, table: str, df: DataFrame) -> None:
        want = schema.TABLES[table]
        cols = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want]
        out = df.select(*cols)
        if table in BY_SNAPSHOT:  # as many tasks as the rows came in, whatever the snapshot
            out.write.mode("append").partitionBy("snapshot_id").parquet(self.path(table))
        elif table in ("findings", "evidence"):
            out.write.mode("append").parquet(self.path(table))
        else:  # a row a call
            out.coalesce(1).write.mode("append").parquet(self.path(table))

    def _replace(self, table: str, df: DataFrame) -> None:
        """Write a small table anew as its next revision.  Readers take the newest one, which
        its one file makes visible at once, so a crash leaves the revision before."""
        rows = df.select(*schema.TABLES[table].names).collect()  # one row for each repository or run
        out = self.spark.createDataFrame(rows, schema.TABLES[table]).coalesce(1).withColumn("revision", F.lit(time.time_ns()))
        out.write.mode("append").parquet(self.path(table))

    def upsert_repository(self, name: str, root_path: str) -> dict:
        """A known name keeps its id and creation time and gets the new path.

        The returned row carries the time of this call."""
        made = now()
        rid = self.spark.range(1).select(schema.repository_id(F.lit(name)).alias("i")).first()[0]
        new = self.spark.createDataFrame([(rid, name, root_path, made)], schema.TABLES["repositories"])
        old = self.read("repositories")
        kept = old.where(F.col("name") == name).select("id", "name", F.lit(root_path).alias("root_path"), "created_at")
        self._replace("repositories", old.where(F.col("name") != name).unionByName(kept).unionByName(new.join(kept.select("name"), "name", "left_anti").select(*new.columns)))
        return {"id": rid, "name": name, "root_path": root_path, "created_at": made}

    def commit_snapshot(self, repository_id: str, commit_sha: str, facts: dict[str, DataFrame], snapshot_id: str | None = None) -> str:
        """Write all facts of a snapshot, then the row that makes it visible."""
        sid = snapshot_id or str(uuid.uuid4())
        for table, df in facts.items():
            self.append(table, df.withColumn("snapshot_id", F.lit(sid)))
        self.append("snapshots", self.spark.createDataFrame([(sid, repository_id, commit_sha, now())], schema.TABLES["snapshots"]))
        return sid

    def upsert_metrics(self, new: DataFrame) -> DataFrame:
        """The metrics with ``new`` on top: the last value of (snapshot, subject, name,
        analyzer) wins.  Returned, not written: the caller appends or compares."""
        names = schema.TABLES["metrics"].names
        both = self.read("metrics").withColumn("o", F.lit(0).cast("long")).unionByName(new.select(*names).withColumn("o", F.monotonically_increasing_id() + 1))
        return keep_first(both, ["snapshot_id", "subject_id", "name", "analyzer"], "o", last=True).select(*names)

    def add_findings(self, findings: DataFrame, evidence: DataFrame) -> None:
        """Evidence first: a finding that can be read has its evidence."""
        self.append("evidence", evidence)
        self.append("findings", findings)

    def findings(self, snapshot_id: str | None = None) -> DataFrame:
        f = self.read("findings")
        return f if snapshot_id is None else f.where(F.col("snapshot_id") == snapshot_id)

    def record_run(self, run: dict) -> None:
        """One row a cache key: a new run replaces the old."""
        old = self.read("analysis_runs").where(F.col("cache_key") != run["cache_key"])
        new = self.spark.createDataFrame([tuple(run.get(n) for n in schema.TABLES["analysis_runs"].names)], schema.TABLES["analysis_runs"])
        self._replace("analysis_runs", old.unionByName(new))

    def add_summary(self, snapshot_id: str, subject_id: str, level: str, content: dict, model: str, prompt_version: str, content_hash: str) -> None:
        body = json.dumps(content, ensure_ascii=False, separators=(",", ":"))
        row = (str(uuid.uuid4()), snapshot_id, subject_id, level, body, model, prompt_version, content_hash, now())
        self.append("summaries", self.spark.createDataFrame([row], schema.TABLES["summaries"]))


def discover(spark: SparkSession, folder: str) -> dict[str, Store]:
    """Stores in a folder and in its direct children, by name of the repository."""
    from pathlib import Path

    found: dict[str, Store] = {}
    top = Path(folder)
    for at in [top, *sorted(p for p in top.iterdir() if p.is_dir())]:
        if (at / "_schema").is_dir() and (at / "snapshots").is_dir():
            store = Store(spark, str(at))
            repo = store.repository()
            if repo:
                found[repo["name"]] = store
    return found
