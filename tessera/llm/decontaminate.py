"""Benchmark decontamination by templates.

Native: numbers, names and units become typed placeholders, windows of the template
are hash-joined with those of the benchmark, and the slots of a match must map in one
way, so that a question with other numbers or names is found and chance matches of
templates are not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Unit words that become the unit placeholder.
UNITS = (
    "mm cm km kg mg ml kb mb gb tb inch inches foot feet yard yards mile miles metre metres meter meters gram grams kilogram kilograms "
    "litre litres liter liters ounce ounces pound pounds tonne tonnes second seconds minute minutes hour hours day days week weeks "
    "month months year years dollar dollars euro euros cent cents percent degree degrees"
).split()

_NAME, _NUMBER, _UNIT, _FIRST = "\x01", "\x02", "\x03", "\x04"
_SPLIT = "[^\\p{L}\\p{N}\x01-\x04]+"
_READINGS = ("word", "name", "plain")


def _tokens(text: Column) -> Column:
    """Lower-cased tokens: digit groups of a number are joined, a capital inside a sentence
    puts the mark of a name before its word, any other capital that of a first word."""
    t = F.regexp_replace(F.translate(text, _NAME + _NUMBER + _UNIT + _FIRST, "    "), r"(\p{N})[.,](\p{N})", "$1$2")
    t = F.regexp_replace(t, r"([^.!?:\s]\s+)(\p{Lu})", f"$1{_NAME}$2")
    t = F.regexp_replace(t, f"(\\p{{Lu}})(?<![\\p{{L}}\\p{{N}}{_NAME}]\\p{{Lu}})", f"{_FIRST}$1")
    return F.filter(F.split(F.lower(t), _SPLIT), lambda x: x != "")


def _bare(token: Column) -> Column:
    return F.when(token.startswith(_NAME) | token.startswith(_FIRST), F.substr(token, F.lit(2))).otherwise(token)


def _template(token: Column, bare: Column) -> Column:
    """The token with its placeholder."""
    word = F.when(bare.isin(UNITS), _UNIT).when(bare.rlike(r"\p{N}"), F.regexp_replace(bare, r"\p{N}+", _NUMBER)).otherwise(bare)
    return F.when(token.startswith(_NAME), _NAME).otherwise(word)


def _readings(tokens: Column) -> Column:
    """Hashes of each token in the three readings of a text: the template with a capital
    first word as a word, the template with it as a name, and the plain token."""

    def read(t: Column) -> Column:
        word = F.xxhash64(_template(t, _bare(t)))
        return F.struct(word.alias("word"), F.when(t.startswith(_FIRST), F.xxhash64(F.lit(_NAME))).otherwise(word).alias("name"), F.xxhash64(_bare(t)).alias("plain"))

    return F.transform(tokens, read)


def _window(hashes: Column, at: Column, w: int) -> Column:
    """The hash of the ``w`` tokens from ``at`` on, null where there are fewer."""
    return F.when(at + w <= F.size(hashes), F.xxhash64(F.lit(w), *[F.get(hashes, at + j) for j in range(w)]))


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 13,
    min_literals: int = 5,
    broadcast_rows: int = 1_000_000,
) -> DataFrame:
    """Pairs of a document and a benchmark item that it leaks.

    Columns: doc_id, item_id, n_windows (distinct windows of the item found in one
    alignment), item_windows, n_slots (placeholders compared), reparameterised (a slot
    has another value than in the item).

    * Windows of both sides are read in three ways and joined where any two agree: as
      templates with a capital first word of a sentence as a word, or as a name, and as
      plain lower-cased tokens, which find verbatim copies in any case.
    * A window has ``window`` tokens; an item with fewer is one window.  An item's window
      with fewer than ``min_literals`` words that are no placeholder can't be told from
      chance by its template: only its verbatim copies count.
    * An alignment counts only if each slot value of the item stands for one value in
      the document throughout, over its windows of the first reading or over all; the one
      with most windows gives the figures.
    * Null or empty texts and null ids leak nothing.  Rows with one id are one document;
      repeated rows change nothing.  Other columns are not looked at.  Empty tables give
      an empty one.  A document, of any length, is read whole by one task.
    * All windows, of whatever lengths the items have, come from one scan of ``docs``.
    * The benchmark's windows are broadcast only up to ``broadcast_rows`` of them (each
      of under 100 bytes); beyond that both sides are shuffled by window.
    """
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("it")).where("item_id is not null and it is not null").distinct()
    items = items.select("item_id", _tokens(F.col("it")).alias("rt")).where(F.size("rt") > 0)
    items = items.select("*", _readings(F.col("rt")).alias("r"), F.least(F.size("rt"), F.lit(window)).alias("w"), F.transform("rt", lambda t: _template(t, _bare(t))).alias("tt"))
    items = stored(items.select("item_id", "rt", "tt", "w", *[F.col(f"r.{x}").alias(x) for x in _READINGS]), "items")
    sizes = sorted(r[0] for r in items.select("w").distinct().collect())  # 1 to window at most
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("dt")).where("doc_id is not null and dt is not null")

    q = F.col("q")

    def literals(place: Column) -> Column:
        return F.size(F.filter(F.slice(place, q + 1, F.col("w")), lambda t: ~t.isin(_NAME, _NUMBER, _UNIT)))

    named = F.transform("rt", lambda t: F.when(t.startswith(_FIRST), _NAME).otherwise(_template(t, _bare(t))))
    rows = items.select("*", F.posexplode(F.sequence(F.lit(0), F.size("rt") - F.col("w"))).alias("q", "_"))
    window_of = {x: F.coalesce(*[F.when(F.col("w") == w, _window(F.col(x), q, w)) for w in sizes or [window]]) for x in _READINGS}
    kinds = [
        F.when(literals(F.col("tt")) >= min_literals, F.struct(F.lit(0).alias("kind"), window_of["word"].alias("h"))),
        F.when(literals(named) >= min_literals, F.struct(F.lit(1).alias("kind"), window_of["name"].alias("h"))),
        F.struct(F.lit(2).alias("kind"), window_of["plain"].alias("h")),
    ]
    iw = rows.select("item_id", "w", "q", F.explode(F.array(*kinds)).alias("x")).where("x is not null").select("item_id", "w", "q", "x.kind", "x.h")
    iw = stored(iw, "windows")
    small = iw.count() <= broadcast_rows

    hashed = d.select("doc_id", _readings(_tokens(F.col("dt"))).alias("r")).select("doc_id", *[F.col(f"r.{x}").alias(x) for x in _READINGS])
    p = F.col("p")
    # outer, since Spark filters the input of the other kind by evaluating it a second time
    x = hashed.select("doc_id", *_READINGS, F.posexplode_outer("plain").alias("p", "_")).where(p + min(sizes or [window]) <= F.size("plain"))
    x = x.select("doc_id", "p", *[_window(F.col(r), p, w).alias(f"{r}{w}") for w in sizes or [window] for r in _READINGS])
    # what reads alike in two ways is sent once
    each = []
    for w in sizes or [window]:
        word, name, plain = (F.col(f"{r}{w}") for r in _READINGS)
        each += [word, F.when(name != word, name), F.when((plain != word) & (plain != name), plain)]
    x = x.select("doc_id", "p", F.explode(F.array(*each)).alias("dh")).where("dh is not null")
    found = x.join(F.broadcast(iw) if small else iw, F.col("dh") == F.col("h"))
    found = found.select("doc_id", "item_id", (p - q).alias("shift"), "q", "kind", "w")
    sets = [F.collect_set(F.when(F.col("kind") == k, F.col("q"))).alias(name) for k, name in enumerate(("ts", "fs", "ps"))]
    aligned = stored(found.groupBy("doc_id", "item_id", "shift", "w").agg(*sets), "aligned")
    # the slots of what has matched, from the tokens of those documents and items alone
    hit = aligned.select("doc_id").distinct()
    hit = F.broadcast(hit) if aligned.count() <= broadcast_rows else hit
    bare = lambda tokens: F.transform(tokens, _bare)
    texts = d.join(hit, "doc_id", "left_semi").distinct().select("doc_id", bare(_tokens(F.col("dt"))).alias("dr"))
    template = F.struct(F.lit(False).alias("all"), F.col("ts").alias("qs"))
    every = F.struct(F.lit(True).alias("all"), F.array_union(F.array_union("ts", "fs"), F.col("ps")).alias("qs"))
    pairs = (
        aligned.join(items.select("item_id", "tt", "rt", bare(F.col("rt")).alias("ir"), F.size("tt").alias("n")), "item_id")
        .join(texts, "doc_id")
        .withColumn("by", F.explode(F.array(template, every)))
        .withColumn("qs", F.col("by.qs"))
        .where(F.size("qs") > 0)
        .withColumn("at", F.array_distinct(F.flatten(F.transform("qs", lambda i: F.sequence(i, i + F.col("w") - 1)))))
        .withColumn("slots", F.filter("at", lambda i: F.get(F.col("tt"), i).isin(_NAME, _NUMBER, _UNIT) | (F.col("by.all") & F.get(F.col("rt"), i).startswith(_FIRST))))
        .withColumn("map", F.array_distinct(F.transform("slots", lambda i: F.struct(F.get(F.col("ir"), i).alias("i"), F.get(F.col("dr"), i + F.col("shift")).alias("d")))))
        .where(F.size("map") == F.size(F.array_distinct(F.transform("map", lambda m: m["i"]))))
    )
    best = F.max(
        F.struct(
            F.size("qs").cast("long").alias("n_windows"),
            (F.col("n") - F.col("w") + 1).cast("long").alias("item_windows"),
            F.size("slots").cast("long").alias("n_slots"),
            F.exists("map", lambda m: ~m["i"].eqNullSafe(m["d"])).alias("reparameterised"),
        )
    )
    return pairs.groupBy("doc_id", "item_id").agg(best.alias("b")).select(F.col("doc_id").alias(id_col), "item_id", "b.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 1_000_000, **how) -> DataFrame:
    """``docs`` without the documents that leak an item; rows with a null id stay."""
    bad = leaks(docs, benchmark, id_col, text_col, broadcast_rows=broadcast_rows, **how)
    bad = stored(bad.select(F.col(id_col).alias("__bad")).distinct(), "leaks")
    bad = F.broadcast(bad) if bad.count() <= broadcast_rows else bad
    return docs.join(bad, F.col(id_col) == F.col("__bad"), "left_anti")


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP7_SQL = rf"""
WITH raw AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents WHERE text IS NOT NULL
  UNION SELECT 'b', item_id, text FROM benchmark WHERE text IS NOT NULL),
joined AS (
  SELECT kind, id, regexp_replace(translate(text, chr(1) || chr(2) || chr(3) || chr(4), '    '), '(\p{{N}})[.,](\p{{N}})', '\1\2', 'g') AS t FROM raw),
marked AS (
  SELECT kind, id, regexp_replace(regexp_replace(t, '([^.!?:\s]\s+)(\p{{Lu}})', '\1' || chr(1) || '\2', 'g'),
                                  '(^|[^\p{{L}}\p{{N}}\x01])(\p{{Lu}})', '\1' || chr(4) || '\2', 'g') AS m FROM joined),
tok AS (
  SELECT kind, id, list_filter(regexp_split_to_array(lower(m), '[^\p{{L}}\p{{N}}\x01-\x04]+'), lambda t: t <> '') AS rt FROM marked),
bare AS (
  SELECT *, list_transform(rt, lambda t: CASE WHEN t[1] IN (chr(1), chr(4)) THEN t[2:] ELSE t END) AS bt FROM tok),
tmpl AS (
  SELECT *, list_transform(range(1, len(rt) + 1), lambda i: CASE WHEN rt[i][1] = chr(1) THEN chr(1) WHEN bt[i] IN ({", ".join(f"'{u}'" for u in UNITS)}) THEN chr(3)
      ELSE regexp_replace(bt[i], '\p{{N}}+', chr(2), 'g') END) AS tt FROM bare),
named AS (
  SELECT *, list_transform(range(1, len(rt) + 1), lambda i: CASE WHEN rt[i][1] = chr(4) THEN chr(1) ELSE tt[i] END) AS ft FROM tmpl),
item AS (SELECT *, id AS item_id, len(tt) AS n, least(len(tt), 13) AS w FROM named WHERE kind = 'b' AND len(tt) > 0),
spot AS (SELECT *, unnest(range(0, n - w + 1)) AS q FROM item),
iw AS (
  SELECT item_id, w, q, 0 AS k, array_to_string(tt[q + 1:q + w], ' ') AS h FROM spot WHERE len(list_filter(tt[q + 1:q + w], lambda t: t NOT IN (chr(1), chr(2), chr(3)))) >= 5
  UNION ALL SELECT item_id, w, q, 1, array_to_string(ft[q + 1:q + w], ' ') FROM spot WHERE len(list_filter(ft[q + 1:q + w], lambda t: t NOT IN (chr(1), chr(2), chr(3)))) >= 5
  UNION ALL SELECT item_id, w, q, 2, array_to_string(bt[q + 1:q + w], ' ') FROM spot),
place AS (SELECT id AS doc_id, w, tt, ft, bt, unnest(range(0, len(tt) - w + 1)) AS p FROM named, (SELECT DISTINCT w FROM iw) s WHERE kind = 'd' AND len(tt) >= w),
dw AS (
  SELECT DISTINCT doc_id, w, p, unnest([array_to_string(tt[p + 1:p + w], ' '), array_to_string(ft[p + 1:p + w], ' '), array_to_string(bt[p + 1:p + w], ' ')]) AS h FROM place),
al AS (
  SELECT doc_id, item_id, p - q AS shift, iw.w, list(DISTINCT q) FILTER (k = 0) AS ts, list(DISTINCT q) AS qs FROM dw JOIN iw ON dw.h = iw.h AND dw.w = iw.w GROUP BY ALL),
way AS (SELECT doc_id, item_id, shift, w, false AS whole, ts AS qs FROM al WHERE len(ts) > 0 UNION ALL SELECT doc_id, item_id, shift, w, true, qs FROM al),
slot AS (
  SELECT way.doc_id, way.item_id, shift, way.w, len(qs) AS nq, i.n, i.bt AS ir, t.bt AS dr,
         list_filter(list_distinct(flatten(list_transform(qs, lambda q: range(q, q + way.w)))),
                     lambda x: i.tt[x + 1] IN (chr(1), chr(2), chr(3)) OR (whole AND i.rt[x + 1][1] = chr(4))) AS places
  FROM way JOIN item i USING (item_id) JOIN named t ON t.kind = 'd' AND t.id = way.doc_id),
map AS (SELECT *, list_distinct(list_transform(places, lambda x: {{'i': ir[x + 1], 'd': dr[x + 1 + shift]}})) AS m FROM slot),
fit AS (
  SELECT doc_id, item_id, nq::BIGINT AS n_windows, (n - w + 1)::BIGINT AS item_windows, len(places)::BIGINT AS n_slots,
         len(list_filter(m, lambda x: x.i <> x.d)) > 0 AS reparameterised FROM map
  WHERE len(m) = len(list_distinct(list_transform(m, lambda x: x.i))))
SELECT doc_id, item_id, b.n_windows, b.item_windows, b.n_slots, b.reparameterised
FROM (SELECT doc_id, item_id, max({{'n_windows': n_windows, 'item_windows': item_windows, 'n_slots': n_slots, 'reparameterised': reparameterised}}) AS b
      FROM fit GROUP BY ALL)
"""
