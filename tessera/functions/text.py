"""Scalar expressions over names, paths, lines and JSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """Distinct lower-cased words; camelCase is split, then at what is no letter or number."""
    spaced = F.regexp_replace(text, r"([a-z])([A-Z])", "$1 $2")
    return F.array_distinct(F.filter(F.split(F.lower(spaced), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def index_tokens(text: Column) -> Column:
    """Tokens of the full-text index: lower-cased, no diacritics, split at non-alphanumerics."""
    return F.filter(F.split(strip_marks(F.lower(F.coalesce(text, F.lit("")))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def strip_marks(text: Column) -> Column:
    """Latin letters without their diacritics (of Latin-1 and Latin Extended-A)."""
    import unicodedata

    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x180)]
    pairs = [(a, b) for a, b in pairs if a != b]
    return F.translate(text, "".join(a for a, _ in pairs), "".join(b for _, b in pairs))


def query_phrases(query: str) -> list[list[str]]:
    """Blank-separated terms, each a phrase of index tokens whose last one is a prefix."""
    import re
    import unicodedata

    plain = "".join(c for c in unicodedata.normalize("NFD", query.lower()) if not unicodedata.combining(c))
    phrases = [[t for t in re.split(r"[\W_]+", term) if t] for term in plain.split()]
    return [p for p in phrases if p]


def symbol_text(kind: Column, name: Column, signature: Column, path: Column) -> Column:
    return F.concat(kind, F.lit(" "), name, F.lit(" "), F.coalesce(signature, F.lit("")), F.lit(" — "), path)


def last_segment(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def occurrence_name(symbol: Column) -> Column:
    """Short name of an index symbol: after the last slash, the last part between # and dots,
    without backticks and parentheses."""
    parts = F.filter(F.split(F.substring_index(symbol, "/", -1), r"[#.]"), lambda x: x != "")
    return F.regexp_replace(F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("")), r"[`()]", "")


def compact(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def unquoted(literal: Column) -> Column:
    """A string literal's text: prefix letters and one or three quotes at each end go."""
    return F.regexp_replace(F.regexp_replace(literal, r"^[rbfuRBFU]*('''|\"\"\"|'|\"|`)", ""), r"('''|\"\"\"|'|\"|`)$", "")


def uri_path(uri: Column) -> Column:
    return F.regexp_replace(uri, r"^repo://[^/]*/", "")


def preview(text: Column, limit: int = 300) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("… [preview]"))).otherwise(text)


def dirname(path: Column) -> Column:
    """Parent directory; ``.`` at the top."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit("."))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def normalised(path: Column) -> Column:
    """``a/./b/../c`` to ``a/c``; climbing above the root keeps ``..``."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))

    def step(seen, part):
        up = (part == "..") & (F.size(seen) > 0) & (F.coalesce(F.try_element_at(seen, F.lit(-1)), F.lit("..")) != "..")
        return F.when(up, F.slice(seen, F.lit(1), F.greatest(F.size(seen) - 1, F.lit(0)))).otherwise(F.concat(seen, F.array(part)))

    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def numbered_lines(text: Column, start: int = 1) -> Column:
    """``n<TAB>line`` for each line."""
    return F.transform(F.split(text, "\n", -1), lambda x, i: F.concat((i + start).cast("string"), F.lit("\t"), x))


def is_test_path(path: Column) -> Column:
    return is_ts_test(path) | is_py_test(path)


def is_ts_test(path: Column) -> Column:
    return path.rlike(r"\.(test|spec)\.[cm]?[jt]sx?$")


def is_py_test(path: Column) -> Column:
    return path.rlike(r"(^|/)test_[^/]+\.py$|_test\.py$")


def is_parseable(path: Column) -> Column:
    return (path.rlike(r"\.[cm]?tsx?$") & ~path.rlike(r"\.d\.[cm]?ts$")) | path.endswith(".py")


def coverage_bonus(text: Column, terms: list[str]) -> Column:
    """(matched / terms)² · 0.03 with at least two distinct terms of over two letters."""
    use = sorted({t for t in (x.lower() for x in terms) if len(t) > 2})
    if len(use) < 2:
        return F.lit(0.0)
    low = F.lower(text)
    hits = reduce(lambda a, b: a + b, [F.contains(low, F.lit(t)).cast("int") for t in use])
    return F.pow(hits / F.lit(float(len(use))), 2.0) * 0.03


def edge_evidence(evidence: Column) -> Column:
    """struct(path, line, specifier) of an edge's JSON, null where it has none."""
    return F.struct(
        F.get_json_object(evidence, "$.path").alias("path"),
        F.get_json_object(evidence, "$.line").cast("int").alias("line"),
        F.get_json_object(evidence, "$.specifier").alias("specifier"),
    )


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""

    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)
