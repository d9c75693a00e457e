"""Dated URL lists, joined to captures as they stood when each capture was fetched.

A list is a log of entries: a pattern (a host, or a domain with all below it) is added or removed on a day.  Each
addition becomes an interval that the pattern's next entry ends.  A capture looks up every suffix of its
host; intervals and captures meet in the cell of PERIOD days that both touch, so a pattern's long history isn't
searched whole.  Of each list the newest active entry counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casebook.llm.common import table

#: Days a cell.
PERIOD = 30
#: The list whose entries overrule all others.
ALLOW = "allow"


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and a leading www.; empty where the text is no URL."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.regexp_replace(host, r"^www\.", "")


def suffixes(host: Column) -> Column:
    """All of a host's suffixes at dots, the host first; none of an empty host."""
    labels = F.split(host, r"\.")
    return F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, pattern, day, action add/remove) to list, pattern, valid_from, valid_to (exclusive; null: still valid).

    Of entries of a pattern on one day a removal comes first.  An addition is ended by the next entry, whatever it is; empty intervals are left out."""
    order = Window.partitionBy("list", "pattern").orderBy("day", F.col("action") == "add")
    ended = entries.na.drop(subset=["list", "pattern", "day"]).withColumn("valid_to", F.lead("day").over(order)).where("action = 'add'")
    return ended.where("valid_to IS NULL OR valid_to > day").select("list", "pattern", F.col("day").alias("valid_from"), "valid_to")


def active_entries(captures: DataFrame, entries: DataFrame, period: int = PERIOD) -> DataFrame:
    """(key, url, day) and list entries to key, list, pattern, valid_from: the newest active entry of each list that has one.

    Captures without a day or a host match nothing.  No broadcast: lists and captures meet by shuffle, and a pattern with very many captures
    is split by Spark's handling of skewed joins."""
    rows = captures.na.drop(subset=["day"])
    last = rows.agg(F.max("day")).first()[0]
    if last is None:
        last = 0
    spans = intervals(entries).where(F.col("valid_from") <= last)
    until = F.least(F.coalesce(F.col("valid_to") - 1, F.lit(last)), F.lit(last))
    cells = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("valid_from") / period), F.floor(until / period))))
    seen = rows.select("key", "day", F.floor(F.col("day") / period).alias("cell"), F.explode(suffixes(host_of(F.col("url")))).alias("pattern"))
    met = seen.join(cells, ["pattern", "cell"]).where((F.col("valid_from") <= F.col("day")) & (F.col("valid_to").isNull() | (F.col("day") < F.col("valid_to"))))
    newest = met.groupBy("key", "list").agg(F.max(F.struct("valid_from", F.length("pattern").alias("n"), "pattern")).alias("e"))
    return newest.select("key", "list", F.col("e.pattern").alias("pattern"), F.col("e.valid_from").alias("valid_from"))


def url_verdicts(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """(key, url, day) to key, host, day, lists (comma-joined names, in order), since (oldest of the entries), blocked.

    One row for each row; `key` names a capture, and rows that share a key must share url and day.  A capture on no list has an empty text and is not blocked."""
    found = active_entries(captures.select("key", "url", "day").distinct(), entries)
    listed = found.groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"), F.min("valid_from").alias("since"))
    joined = captures.select("key", host_of(F.col("url")).alias("host"), "day").join(listed, "key", "left")
    named = F.coalesce("lists", F.lit(""))
    return joined.select("key", "host", "day", named.alias("lists"), "since", ((named != "") & ~F.array_contains(F.split(named, ","), ALLOW)).alias("blocked"))


def page_captures(pages: DataFrame) -> DataFrame:
    """Pages as captures: the day of a fetch follows from page_id, over two years."""
    return pages.select(F.col("page_id").alias("key"), "url", F.pmod(F.col("page_id") * 7919, F.lit(730)).alias("day"))


def page_lists(pages: DataFrame) -> DataFrame:
    """A log of list entries made from the pages' own hosts: each host, and the domain below which it lies, is listed, removed and partly listed again."""
    hosts = pages.select("page_id", host_of(F.col("url")).alias("host")).where("host <> ''")
    domain = F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)
    patterns = hosts.select("page_id", F.col("host").alias("pattern")).union(hosts.select("page_id", domain.alias("pattern"))).where("pattern <> ''")
    seeds = patterns.groupBy("pattern").agg(F.min("page_id").alias("s"))
    name = F.get(F.array(*map(F.lit, ("adult", ALLOW, "malware", "spam"))), F.pmod("s", F.lit(4)).cast("int"))
    first, gone = F.pmod(F.col("s") * 31, F.lit(500)), F.pmod(F.col("s") * 31, F.lit(500)) + 60 + F.pmod("s", F.lit(200))
    entry = lambda day, action: F.struct(day.cast("long").alias("day"), F.lit(action).alias("action"))
    log = F.array(entry(first, "add"), entry(gone, "remove"), entry(gone + 90, "add"))
    return seeds.select(name.alias("list"), "pattern", F.explode(F.when(F.pmod("s", F.lit(3)) == 0, log).otherwise(F.slice(log, 1, 2))).alias("e")).select("list", "pattern", "e.*")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages judged by the lists as they stood when each was fetched: one row for each row.

    A null url, or one without a host, is on no list; repeated rows are judged alike; page_id names a capture; html and other columns don't matter.  Of entries of a
    pattern on one day a removal comes first.  An empty table gives an empty table."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    found = url_verdicts(page_captures(pages), page_lists(pages))
    return found.select(F.col("key").alias("page_id"), "host", "day", "lists", "since", "blocked")


_HOST = r"regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\.', '')"
OP8_SQL = rf"""WITH caps AS (SELECT page_id, {_HOST} AS host, (page_id * 7919) % 730 AS day FROM pages),
patterns AS (SELECT page_id, host AS pattern FROM caps UNION ALL SELECT page_id, regexp_extract(host, '([^.]+\.[^.]+)$', 1) FROM caps),
seeds AS (SELECT pattern, min(page_id) AS s FROM patterns WHERE pattern <> '' GROUP BY pattern),
log AS (SELECT pattern, ['adult', '{ALLOW}', 'malware', 'spam'][s % 4 + 1] AS list, (s * 31) % 500 AS a, (s * 31) % 500 + 60 + s % 200 AS b, s FROM seeds),
spans AS (SELECT list, pattern, a AS valid_from, b AS valid_to FROM log UNION ALL SELECT list, pattern, b + 90, NULL FROM log WHERE s % 3 = 0),
cuts AS (SELECT *, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM caps WHERE host <> ''),
met AS (SELECT page_id, list, valid_from FROM (SELECT page_id, day, array_to_string(string_split(host, '.')[i:], '.') AS pattern FROM cuts) JOIN spans USING (pattern)
    WHERE valid_from <= day AND (valid_to IS NULL OR day < valid_to)),
newest AS (SELECT page_id, list, max(valid_from) AS valid_from FROM met GROUP BY page_id, list),
listed AS (SELECT page_id, string_agg(list, ',' ORDER BY list) AS lists, min(valid_from) AS since, bool_or(list = '{ALLOW}') AS allowed FROM newest GROUP BY page_id)
SELECT page_id, host, day, coalesce(lists, '') AS lists, since, lists IS NOT NULL AND NOT allowed AS blocked FROM caps LEFT JOIN listed USING (page_id)"""
