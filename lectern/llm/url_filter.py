"""URL filters by a temporal list join, with DataFrame functions only.

Dated list entries (host or parent domain, list, add or remove, date) become validity intervals per key. Each capture is
evaluated against the entries active at its fetch time: its host and the host's parent domains are matched with the
intervals that hold the time. Verdicts are worked out once for each different (host, time), so a host with very many
captures is reduced before the shuffle; the join that brings them back is split where one host has most rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import table

#: Host of a URL: after the scheme and user, before the port and path; an address in brackets is one.
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#]+)"


def intervals(entries: DataFrame) -> DataFrame:
    """(key, list, since, until) from (key, list, action, at): an add opens, the next remove closes, until is exclusive.

    Further adds of an open entry and removes of a closed one change nothing; of entries at the same time an add counts
    after a remove; entries with a null in key, list or time are ignored; an entry never removed has a null until.
    """
    line = Window.partitionBy("key", "list").orderBy("at", F.col("action").desc())
    clean = entries.where("key is not null and list is not null and at is not null and action in ('add', 'remove')").select(F.lower("key").alias("key"), "list", "action", "at").distinct()
    turns = clean.withColumn("was", F.lag("action").over(line)).where("action <> coalesce(was, 'remove')")
    turns = turns.withColumn("until", F.lead("at").over(line))
    return turns.where("action = 'add' and (until is null or until > at)").select("key", "list", F.col("at").alias("since"), "until")


def url_filter(captures: DataFrame, entries: DataFrame, id: str = "page_id", url: str = "url", fetched: str = "fetched") -> DataFrame:
    """One row per capture: id, url, fetched, host, verdict (block, allow or none), matched key, since.

    Of the active entries the longest key decides, and of equal keys allow wins over block. A null or malformed URL, or
    a null time, has verdict none. Repeated rows are all kept; empty tables are allowed on either side; other columns of
    captures and entries are ignored.
    """
    rows = captures.select(F.col(id).alias("id"), F.col(url).alias("url"), F.col(fetched).alias("fetched"))
    rows = rows.withColumn("host", F.lower(F.nullif(F.regexp_extract("url", HOST, 1), F.lit(""))))
    asked = rows.where("host is not null and fetched is not null").select("host", "fetched").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    keys = asked.select("host", "fetched", F.explode(F.array_distinct(suffixes)).alias("key"))
    active = keys.join(intervals(entries), "key").where("since <= fetched and (until is null or fetched < until)")
    best = F.max_by(F.struct("list", "key", "since"), F.struct(F.length("key"), (F.col("list") == "allow").cast("int"), "since"))
    verdict = active.groupBy("host", "fetched").agg(best.alias("best"))
    out = rows.join(verdict, ["host", "fetched"], "left")
    return out.select(F.col("id").alias(id), F.col("url").alias(url), F.col("fetched").alias(fetched), "host", F.coalesce("best.list", F.lit("none")).alias("verdict"), F.col("best.key").alias("matched"), F.col("best.since").alias("since"))


#: Entries (list, action, date) of the demonstration list, by group of hosts (0-7) and of their domains (100-102).
DEMONSTRATION = {
    0: [("block", "add", "2024-02-01 00:00:00"), ("block", "remove", "2024-06-15 12:00:00"), ("block", "add", "2024-10-01 00:00:00")],
    1: [("allow", "add", "2024-01-01 00:00:00")],
    2: [("block", "add", "2024-05-01 00:00:00"), ("allow", "add", "2024-07-01 00:00:00"), ("allow", "remove", "2024-09-01 00:00:00")],
    100: [("block", "add", "2024-04-01 00:00:00"), ("block", "remove", "2024-08-01 00:00:00")],
    101: [("block", "add", "2024-11-15 00:00:00")],
}


def demonstration_list(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts of a table, as pages come without one: by the length and first letter of the host."""
    host = F.lower(F.nullif(F.regexp_extract("url", HOST, 1), F.lit("")))
    hosts = pages.select(host.alias("key")).where("key is not null").distinct().withColumn("k", F.pmod(F.length("key") * 7 + F.ascii("key"), F.lit(8)))
    domain = F.regexp_extract("key", r"([^.]+\.[^.]+)$", 1)
    domains = hosts.select(F.nullif(domain, F.lit("")).alias("key")).where("key is not null").distinct().withColumn("k", 100 + F.length("key") % 3)
    entry = lambda *x: F.struct(F.lit(x[0]).alias("list"), F.lit(x[1]).alias("action"), F.lit(x[2]).cast("timestamp_ntz").alias("at"))
    dated = F.when(F.lit(False), F.array(entry("block", "add", "2024-01-01 00:00:00")))
    for k, some in DEMONSTRATION.items():
        dated = dated.when(F.col("k") == k, F.array(*[entry(*x) for x in some]))
    return hosts.unionByName(domains).select("key", F.explode(dated).alias("e")).select("key", "e.list", "e.action", "e.at")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages carry no fetch time: page n counts as fetched n hours into 2024, modulo the year."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(pmod(page_id * 7, 8784) as int))"))
    return url_filter(captures, demonstration_list(pages))


#: The list's entries and what becomes of them, said once more in SQL.
_ENTRIES = ", ".join(f"({k}, '{x}', '{action}', TIMESTAMP '{at}')" for k, some in DEMONSTRATION.items() for x, action, at in some)

ORACLE = rf"""
WITH p AS (
  SELECT page_id, url, lower(nullif(regexp_extract(url, '{HOST}', 1), '')) AS host,
         TIMESTAMP '2024-01-01 00:00:00' + to_hours(((page_id * 7) % 8784)::INT) AS fetched
  FROM pages),
hosts AS (SELECT DISTINCT host AS key, (length(host) * 7 + ascii(host)) % 8 AS k FROM p WHERE host IS NOT NULL),
domains AS (SELECT DISTINCT regexp_extract(key, '([^.]+\.[^.]+)$', 1) AS key FROM hosts),
names AS (SELECT key, k FROM hosts UNION ALL SELECT key, 100 + length(key) % 3 FROM domains WHERE key <> ''),
entries(k, list, action, dated) AS (VALUES {_ENTRIES}),
turns AS (SELECT *, coalesce(lag(action) OVER (PARTITION BY k, list ORDER BY dated, action DESC), 'remove') AS was FROM entries),
spans AS (SELECT k, list, action, dated AS since, lead(dated) OVER (PARTITION BY k, list ORDER BY dated, action DESC) AS until FROM turns WHERE action <> was),
valid AS (SELECT k, list, since, until FROM spans WHERE action = 'add' AND (until IS NULL OR until > since)),
list AS (SELECT DISTINCT n.key, v.list, v.since, v.until FROM names n JOIN valid v ON n.k = v.k),
hit AS (
  SELECT p.page_id, l.*, row_number() OVER (PARTITION BY p.page_id, p.url ORDER BY length(l.key) DESC, l.list = 'allow' DESC, l.since DESC) AS r, p.url AS u
  FROM p JOIN list l ON (p.host = l.key OR ends_with(p.host, '.' || l.key)) AND l.since <= p.fetched AND (l.until IS NULL OR p.fetched < l.until))
SELECT p.page_id, p.url, p.fetched, p.host, coalesce(h.list, 'none') AS verdict, h.key AS matched, h.since
FROM p LEFT JOIN hit h ON h.page_id = p.page_id AND h.u = p.url AND h.r = 1
"""
