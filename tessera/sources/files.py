"""Source files of a repository: contents, languages and what extractors find in them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Languages by extension, and the size above which files aren't parsed.
LANGUAGES = {
    ".ts": "typescript", ".tsx": "typescript", ".mts": "typescript", ".cts": "typescript",
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".py": "python", ".rb": "ruby", ".go": "go", ".rs": "rust", ".java": "java", ".kt": "kotlin",
    ".clj": "clojure", ".cljs": "clojure", ".json": "json", ".yml": "yaml", ".yaml": "yaml", ".md": "markdown",
    ".html": "html", ".css": "css", ".sql": "sql", ".sh": "shell",
}
MAX_PARSE_BYTES = 1 << 20

_FOUND = "symbols array<struct<qualified_name:string,kind:string,signature:string,start_line:int,end_line:int,parent:string,content_hash:string,source:string>>, imports array<struct<specifier:string,start_line:int>>, tests array<struct<name:string,start_line:int>>"


def language(path: Column) -> Column:
    """By the extension after the last dot; null if unknown."""
    ext = F.when(F.instr(path, ".") > 0, F.concat(F.lit("."), F.substring_index(path, ".", -1)))
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), ext)


def read_files(spark: SparkSession, root: str, tracked: DataFrame) -> DataFrame:
    """``path, content, content_hash, size`` of tracked files that can be read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*").load(root)
    base = root.rstrip("/") + "/"
    path = F.url_decode(F.substring_index(F.col("path"), base, -1))
    return raw.select(path.alias("path"), "content", F.sha2("content", 256).alias("content_hash"), F.length("content").alias("size")).join(
        tracked.toDF("path").distinct(), "path", "left_semi"
    )


def _lines(text: str, start: int, end: int) -> str:
    return "\n".join(text.split("\n")[start - 1 : end])


def extract_one(path: str, source: str) -> dict[str, list[dict]]:
    """Symbols with their text and its hash, imports and tests; other files have none."""
    from . import extract_python, extract_typescript

    if path.endswith(".py"):
        out = extract_python.extract(path, source)
    elif path.rpartition(".")[2] in ("ts", "tsx", "mts", "cts", "mtsx", "ctsx") and not path.endswith(".d.ts"):
        out = extract_typescript.extract(path, source)
    else:
        return {"symbols": [], "imports": [], "tests": []}
    for s in out["symbols"]:
        s["source"] = _lines(source, s["start_line"], s["end_line"])
        s["content_hash"] = hashlib.sha256(s["source"].encode("utf-8", "surrogatepass")).hexdigest()
    return out


def extract(files: DataFrame) -> DataFrame:
    """``path, content_hash, language, line_count, symbols, imports, tests`` for each file.

    Files over 1 MiB or of unknown language are hashed but have no line count and are
    not parsed.  One pass of Arrow batches over files, which spread over the cluster.
    """
    known = files.withColumn("language", language(F.col("path")))
    ok = F.col("language").isNotNull() & (F.col("size") <= MAX_PARSE_BYTES)
    known = known.select("path", "content_hash", "language", F.when(ok, F.col("content")).alias("content"))

    def run(frames) -> Iterator:
        import pandas as pd

        for pdf in frames:
            rows = []
            for path, raw in zip(pdf["path"], pdf["content"], strict=True):
                text = None if raw is None else bytes(raw).decode("utf-8", "replace")
                found = extract_one(path, text) if text is not None else {"symbols": [], "imports": [], "tests": []}
                rows.append((None if text is None else text.count("\n") + 1, found["symbols"], found["imports"], found["tests"]))
            out = pdf[["path", "content_hash", "language"]].copy()
            extra = pd.DataFrame(rows, columns=["line_count", "symbols", "imports", "tests"], index=out.index)
            extra["line_count"] = extra["line_count"].astype("Int32")
            yield pd.concat([out, extra], axis=1)

    return known.mapInPandas(run, f"path string, content_hash string, language string, line_count int, {_FOUND}")
