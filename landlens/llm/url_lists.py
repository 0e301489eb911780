"""URL filters whose lists change over time: dated entries become validity intervals, captures meet them as of their fetch time.

An entry adds or removes a rule (allow or block) for a URL, a host or a registered domain. Consecutive entries of one rule
key become intervals; a capture is judged by the entries active at its fetch time, the most specific level first. The
join is an equi join on rule key and month: every interval is filed under the months it touches, and only distinct (key, day)
pairs of the captures are looked up, so a host with a third of all captures costs one look-up per day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landlens.session import cut_lineage

#: Most specific first.
LEVELS = ("url", "host", "domain")
#: The end of an interval that is still open.
OPEN = "9999-12-31"


def host_of(url: Column) -> Column:
    """The host in lower case, without user, port and trailing dots; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.nullif(F.regexp_replace(host, r"\.+$", ""), F.lit(""))


def domain_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def url_of(url: Column) -> Column:
    """The URL without scheme, query and fragment."""
    return F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"[?#].*$", "")


def intervals(entries: DataFrame) -> DataFrame:
    """level, key, verdict, valid_from, valid_to (exclusive): what each entry says until the next one for its key.

    ``entries``: level, key, dated (date), verdict ("block", "allow" or "none", which lifts the rule). Of several entries
    for one key and day, block counts before allow before none. Entries without level, key or date are no entries.
    """
    rank = F.when(F.col("verdict") == "block", 0).when(F.col("verdict") == "allow", 1).otherwise(2)
    per_day = (
        entries.filter("level IS NOT NULL AND key IS NOT NULL AND dated IS NOT NULL")
        .groupBy("level", "key", "dated")
        .agg(F.min_by(F.coalesce("verdict", F.lit("none")), rank).alias("verdict"))
    )
    following = F.lead("dated").over(Window.partitionBy("level", "key").orderBy("dated"))
    return (
        per_day.withColumn("valid_to", F.coalesce(following, F.lit(OPEN).cast("date")))
        .filter("verdict IN ('block', 'allow')")
        .select("level", "key", "verdict", F.col("dated").alias("valid_from"), "valid_to")
    )


def month(day: Column) -> Column:
    return (F.year(day) * 12 + F.month(day)).cast("int")


def judge_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """The verdict on each capture as of its fetch day; one row per input row.

    ``captures``: page_id, url, fetched (date); other columns are ignored. Returns page_id, host, fetched, verdict, level, kept.
    A capture without a matching active entry, with a null url or without a fetch day is kept, with null verdict and level.
    Repeated captures are judged each; empty captures give no rows, empty lists keep everything.
    """
    keyed = captures.select("page_id", "url", "fetched").withColumn("host", host_of(F.col("url")))
    keys = (url_of(F.col("url")), F.col("host"), domain_of(F.col("host")))
    wanted = keyed.select(
        "fetched", F.explode(F.array(*[F.struct(F.lit(n).alias("level"), k.alias("key")) for n, k in zip(LEVELS, keys, strict=True)])).alias("k")
    ).select("k.level", "k.key", "fetched").filter("key IS NOT NULL AND fetched IS NOT NULL").distinct()
    valid = cut_lineage(intervals(entries))
    # open intervals end with the last day that is asked for
    bounds = cut_lineage(wanted.agg(F.max("fetched").alias("newest"), F.min("fetched").alias("oldest"))).first()
    if bounds["newest"] is None:
        hits = valid.select("level", "key", F.col("valid_from").alias("fetched"), "verdict").limit(0)
    else:
        span = valid.filter((F.col("valid_from") <= F.lit(bounds["newest"])) & (F.col("valid_to") > F.lit(bounds["oldest"])))
        last = F.least(F.date_sub("valid_to", 1), F.lit(bounds["newest"]))
        first = F.greatest("valid_from", F.lit(bounds["oldest"]))
        filed = span.select("*", F.explode(F.sequence(month(first), month(last))).alias("month"))
        hits = (
            wanted.withColumn("month", month(F.col("fetched")))
            .join(filed, ["level", "key", "month"])
            .filter("fetched >= valid_from AND fetched < valid_to")
            .select("level", "key", "fetched", "verdict")
        )
    hits = cut_lineage(hits)
    out = keyed
    for name, key in zip(LEVELS, keys, strict=True):
        own = hits.filter(F.col("level") == name).select(
            F.col("key").alias(f"_{name}"), F.col("fetched").alias(f"_{name}_day"), F.col("verdict").alias(f"_{name}_verdict")
        )
        out = out.join(own, (key == F.col(f"_{name}")) & (F.col("fetched") == F.col(f"_{name}_day")), "left")
    verdict = F.coalesce(*[F.col(f"_{n}_verdict") for n in LEVELS])
    level = F.coalesce(*[F.when(F.col(f"_{n}_verdict").isNotNull(), F.lit(n)) for n in LEVELS])
    return out.select(
        "page_id", "host", "fetched", verdict.alias("verdict"), level.alias("level"), F.coalesce(verdict != "block", F.lit(True)).alias("kept")
    )


START = "2024-01-01"


def captures_of(pages: DataFrame) -> DataFrame:
    """The pages as captures: the table holds no fetch time, so the page's number gives a day of the year from ``START``."""
    day = F.date_add(F.lit(START).cast("date"), F.pmod(F.col("page_id") * 7919, F.lit(366)).cast("int"))
    return pages.select("page_id", "url", day.alias("fetched"))


def entries_of(pages: DataFrame) -> DataFrame:
    """Dated lists derived from the pages themselves: hosts by their letters, URLs of some pages, domains lifted again."""
    day = lambda n: F.date_add(F.lit(START).cast("date"), n.cast("int"))
    hosts = pages.select(host_of(F.col("url")).alias("host")).filter("host IS NOT NULL").distinct()
    n = F.length("host") + F.ascii("host")
    host_rows = hosts.select(
        F.lit("host").alias("level"), F.col("host").alias("key"),
        F.explode(F.array(
            F.struct(day(F.pmod(n * 11, F.lit(200))).alias("dated"), F.when(n % 5 == 0, "block").when(n % 5 == 1, "allow").otherwise("none").alias("verdict")),
            F.struct(day(F.pmod(n * 17, F.lit(150)) + 200).alias("dated"), F.when(n % 3 == 0, "block").otherwise("none").alias("verdict")),
        )).alias("e"),
    ).select("level", "key", "e.dated", "e.verdict")
    domains = hosts.select(domain_of(F.col("host")).alias("key")).distinct().filter(F.col("key").endswith(".org"))
    domain_rows = domains.select(F.lit("domain").alias("level"), "key", day(F.lit(90)).alias("dated"), F.lit("block").alias("verdict")).union(
        domains.select(F.lit("domain"), "key", day(F.lit(180)), F.lit("none"))
    )
    url_rows = pages.filter("url IS NOT NULL AND page_id % 3 = 0").select(
        F.lit("url").alias("level"), url_of(F.col("url")).alias("key"), day(F.pmod(F.col("page_id"), F.lit(300))).alias("dated"),
        F.when(F.col("page_id") % 2 == 0, "block").otherwise("allow").alias("verdict"),
    )
    return host_rows.union(domain_rows).union(url_rows)


SQL = r"""
WITH p AS (
  SELECT page_id, url, DATE '2024-01-01' + (((page_id * 7919) % 366 + 366) % 366)::INTEGER AS fetched,
         nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\.+$', ''), '') AS host,
         regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '[?#].*$', '') AS path
  FROM pages),
q AS (SELECT *, CASE WHEN host LIKE '%.%' THEN regexp_extract(host, '[^.]*\.[^.]*$') ELSE host END AS domain FROM p),
h AS (SELECT DISTINCT host, length(host) + ascii(host) AS n FROM p WHERE host IS NOT NULL),
dom AS (SELECT DISTINCT domain FROM q WHERE domain LIKE '%.org'),
entries AS (
  SELECT 'host' AS level, host AS key, DATE '2024-01-01' + ((n * 11) % 200)::INTEGER AS dated,
         CASE WHEN n % 5 = 0 THEN 'block' WHEN n % 5 = 1 THEN 'allow' ELSE 'none' END AS verdict FROM h
  UNION ALL SELECT 'host', host, DATE '2024-01-01' + ((n * 17) % 150 + 200)::INTEGER, CASE WHEN n % 3 = 0 THEN 'block' ELSE 'none' END FROM h
  UNION ALL SELECT 'domain', domain, DATE '2024-01-01' + 90, 'block' FROM dom
  UNION ALL SELECT 'domain', domain, DATE '2024-01-01' + 180, 'none' FROM dom
  UNION ALL SELECT 'url', path, DATE '2024-01-01' + ((page_id % 300 + 300) % 300)::INTEGER, CASE WHEN page_id % 2 = 0 THEN 'block' ELSE 'allow' END
  FROM p WHERE url IS NOT NULL AND page_id % 3 = 0),
active AS (
  SELECT q.page_id, e.level, arg_max(CASE e.verdict WHEN 'block' THEN 0 WHEN 'allow' THEN 1 ELSE 2 END, (e.dated - DATE '2000-01-01') * 3
         + 2 - CASE e.verdict WHEN 'block' THEN 0 WHEN 'allow' THEN 1 ELSE 2 END) AS said
  FROM (SELECT page_id, fetched, 'url' AS level, path AS key FROM q UNION ALL SELECT page_id, fetched, 'host', host FROM q
        UNION ALL SELECT page_id, fetched, 'domain', domain FROM q) q
  JOIN entries e ON e.level = q.level AND e.key = q.key AND e.dated <= q.fetched
  GROUP BY q.page_id, e.level),
best AS (
  SELECT page_id, min_by(said, CASE level WHEN 'url' THEN 0 WHEN 'host' THEN 1 ELSE 2 END) AS said,
         min_by(level, CASE level WHEN 'url' THEN 0 WHEN 'host' THEN 1 ELSE 2 END) AS level
  FROM active WHERE said < 2 GROUP BY page_id)
SELECT q.page_id, q.host, q.fetched, CASE b.said WHEN 0 THEN 'block' WHEN 1 THEN 'allow' END AS verdict, b.level, coalesce(b.said, 1) <> 0 AS kept
FROM q LEFT JOIN best b ON q.page_id = b.page_id
"""
