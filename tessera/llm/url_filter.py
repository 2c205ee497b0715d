"""URL filters: every capture is judged by the list entries in force when it was fetched.

Native: dated list events become validity intervals, the keys of a URL (host, parent
domains, path prefixes) meet the intervals of equal key in an equi-join, and the time
of the fetch picks the interval (an as-of join).  The most specific key decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored


def _bare(host: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(host), r"\.+$", ""), r"^www\.", "")


def url_host(url: Column) -> Column:
    """Lower-cased host without user, port, a closing dot and a leading ``www.``."""
    return _bare(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*(/[^?#]*)", 1)


def url_keys(url: Column, depth: int) -> Column:
    """``host``, its parent domains of two labels or more, and ``host/segment...`` to ``depth`` segments."""
    host, labels = url_host(url), F.split(url_host(url), r"\.")
    parents = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    parts = F.filter(F.split(url_path(url), "/"), lambda x: x != "")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(parts), F.lit(depth))),
        lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")),
    )
    none = F.array().cast("array<string>")
    return F.when(host == "", none).otherwise(
        F.array_distinct(F.concat(parents, F.when((F.size(parts) > 0) & F.lit(depth > 0), prefixes).otherwise(none)))
    )


def list_key(key: Column) -> Column:
    """The key of a list entry by the rules of ``url_keys``: the host lower-cased and
    without ``www.``, the segments of the path as they are."""
    parts = F.split(key, "/")
    return F.concat_ws("/", _bare(F.element_at(parts, 1)), F.filter(F.slice(parts, F.lit(2), F.size(parts)), lambda x: x != ""))


def validity(events: DataFrame) -> DataFrame:
    """``(key, action, listed_at)`` events to ``(key, action, from, to)``: each holds until the
    next event of its key.  Of events at one moment the last in the order of action counts.
    Events with a null field are no events; ``lift`` ends what was in force."""
    e = events.select(list_key(F.col("key")).alias("key"), "action", "listed_at").where("key is not null and action is not null and listed_at is not null")
    e = e.groupBy("key", "listed_at").agg(F.max("action").alias("action"))
    w = Window.partitionBy("key").orderBy("listed_at")
    return (
        e.withColumn("until", F.lead("listed_at").over(w)).where("action <> 'lift'").select("key", "action", F.col("listed_at").alias("since"), "until")
    )


def url_filter(captures: DataFrame, events: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """Per capture: id, url, time, verdict, entry, listed_at.

    ``verdict`` is ``blocked`` or ``allowed`` by the longest key in force at the fetch
    (of equally long ones the one listed last, then the greatest), else ``unlisted``.

    * A null or host-less URL or a null time is ``unlisted``.
    * Exact repeats of (id, url, time) give one row; other columns are left out, whatever
      their names.  An empty table of captures gives an empty one; without list entries
      all are ``unlisted``.  A URL of any length is one row; only prefixes as deep as the
      deepest entry are looked up.
    * An interval holds from its event on and ends before the next.
    """
    intervals = stored(validity(events), "intervals")
    segments = F.size(F.split("key", "/")) - 1
    depth = intervals.agg(F.max(segments)).first()[0] or 0
    c = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(time_col).alias("at"))
    keyed = c.select("id", "url", "at", F.explode_outer(url_keys(F.col("url"), depth)).alias("key"))
    held = keyed.join(
        intervals.withColumnRenamed("key", "entry"),
        (F.col("key") == F.col("entry")) & (F.col("at") >= F.col("since")) & (F.col("until").isNull() | (F.col("at") < F.col("until"))),
        "left",
    )
    best = held.groupBy("id", "url", "at").agg(
        F.max(F.when(F.col("entry").isNotNull(), F.struct(F.length("entry").alias("n"), "since", "entry", "action"))).alias("best")
    )
    verdict = F.when(F.col("best.action") == "block", "blocked").when(F.col("best.action") == "allow", "allowed").otherwise("unlisted")
    return best.select(
        F.col("id").alias(id_col),
        F.col("url").alias(url_col),
        F.col("at").alias(time_col),
        verdict.alias("verdict"),
        F.col("best.entry").alias("entry"),
        F.col("best.since").alias("listed_at"),
    )


def demo_captures(pages: DataFrame) -> DataFrame:
    """The tables have no fetch time: page i is fetched on day 7 i mod 366 of 2024."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 7 % 366).cast("int")).alias("fetched_at"))


def demo_events(pages: DataFrame) -> DataFrame:
    """The tables have no lists: a dated feed is drawn from md5 of the hosts that occur."""
    hosts = pages.select(url_host(F.col("url")).alias("host"), F.regexp_extract("url", r"^[^/]*//[^/]*/([a-z]+)/", 1).alias("section")).where("host <> ''")
    hosts = hosts.distinct().withColumn("h", F.md5("host"))

    def digits(at: int, n: int) -> Column:
        return F.conv(F.substring("h", at, n), 16, 10).cast("int")

    day = F.date_add(F.lit("2024-01-01").cast("date"), digits(2, 2))
    feed = [
        hosts.where(digits(1, 1) < 8).select(F.col("host").alias("key"), F.lit("block").alias("action"), day.alias("listed_at")),
        hosts.where((digits(1, 1) < 8) & (digits(4, 1) < 8)).select(
            F.col("host").alias("key"), F.lit("lift").alias("action"), F.date_add(day, 20 + digits(5, 2)).alias("listed_at")
        ),
        hosts.where((digits(7, 1) < 4) & (F.col("section") != "")).select(
            F.concat_ws("/", "host", "section").alias("key"), F.lit("allow").alias("action"), F.date_add(day, -30).alias("listed_at")
        ),
        hosts.where(F.col("host").endswith(".example.org")).select(
            F.lit("example.org").alias("key"), F.lit("block").alias("action"), F.lit("2024-09-01").cast("date").alias("listed_at")
        ),
    ]
    out = feed[0]
    for x in feed[1:]:
        out = out.union(x)
    return out.distinct()


def op10_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    out = url_filter(demo_captures(pages), demo_events(pages))
    return out.withColumns({c: F.col(c).cast("string") for c in ("fetched_at", "listed_at")})


OP10_SQL = r"""
WITH c AS (
  SELECT page_id, url, (DATE '2024-01-01' + (page_id * 7 % 366)::INT)::DATE AS fetched_at,
         regexp_replace(regexp_replace(lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\.+$', ''), '^www\.', '') AS host,
         list_filter(string_split(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*(/[^?#]*)', 1), '/'), lambda x: x <> '') AS parts
  FROM pages),
hosts AS (
  SELECT DISTINCT host, regexp_extract(url, '^[^/]*//[^/]*/([a-z]+)/', 1) AS section, md5(host) AS h FROM c WHERE host <> ''),
d AS (
  SELECT *, ('0x' || substr(h, 1, 1))::INT AS d1, ('0x' || substr(h, 4, 1))::INT AS d4, ('0x' || substr(h, 5, 2))::INT AS d5,
         ('0x' || substr(h, 7, 1))::INT AS d7, (DATE '2024-01-01' + ('0x' || substr(h, 2, 2))::INT)::DATE AS day FROM hosts),
events AS (
  SELECT host AS key, 'block' AS action, day AS listed_at FROM d WHERE d1 < 8
  UNION SELECT host, 'lift', (day + 20 + d5)::DATE FROM d WHERE d1 < 8 AND d4 < 8
  UNION SELECT host || '/' || section, 'allow', (day - 30)::DATE FROM d WHERE d7 < 4 AND section <> ''
  UNION SELECT 'example.org', 'block', DATE '2024-09-01' FROM d WHERE host LIKE '%.example.org'),
one AS (SELECT key, listed_at, max(action) AS action FROM events GROUP BY ALL),
iv AS (SELECT *, lead(listed_at) OVER (PARTITION BY key ORDER BY listed_at) AS until FROM one),
keyed AS (
  SELECT DISTINCT page_id, url, fetched_at, unnest(
    CASE WHEN host = '' THEN [] ELSE
      list_transform(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.'))
      || list_transform(range(1, len(parts) + 1), lambda i: host || '/' || array_to_string(parts[1:i], '/')) END) AS key
  FROM c),
hit AS (
  SELECT k.page_id, k.url, k.fetched_at, i.key AS entry, i.action, i.listed_at,
         row_number() OVER (PARTITION BY k.page_id, k.url, k.fetched_at ORDER BY length(i.key) DESC, i.listed_at DESC, i.key DESC) AS r
  FROM keyed k JOIN iv i ON i.key = k.key AND i.action <> 'lift' AND k.fetched_at >= i.listed_at AND (i.until IS NULL OR k.fetched_at < i.until))
SELECT DISTINCT c.page_id, c.url, c.fetched_at::VARCHAR AS fetched_at,
       CASE h.action WHEN 'block' THEN 'blocked' WHEN 'allow' THEN 'allowed' ELSE 'unlisted' END AS verdict, h.entry, h.listed_at::VARCHAR AS listed_at
FROM c LEFT JOIN hit h ON h.page_id = c.page_id AND h.url = c.url AND h.r = 1
"""
