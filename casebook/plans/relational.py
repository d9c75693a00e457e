"""Relational queries: filters, facets, joins, aggregates, windows, top-k and set operations over the star schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casebook.operators import ordering
from casebook.plans.base import load, query


def conditions(filters: dict[str, Column], without: str | None = None) -> Column:
    """All filters but one, joined by AND; a facet leaves its own filter out."""
    return reduce(lambda a, b: a & b, [c for k, c in filters.items() if k != without], F.lit(True))


# -- scalar counts and groups -------------------------------------------------------------------------------


@query("""SELECT (SELECT count(*) FROM orders) AS n_orders, (SELECT count(*) FROM customer) AS n_customers, (SELECT count(*) FROM supplier) AS n_suppliers,
(SELECT count(*) FROM part) AS n_parts, (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') AS n_returned, (SELECT count(DISTINCT o_custkey) FROM orders) AS n_buyers""")
def overview_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of several tables in one row (A-01, A-03, A-07); each side of the join is one row."""
    one = lambda name, e, alias, cond=None: (load(spark, sf_dir, name).where(cond) if cond else load(spark, sf_dir, name)).agg(e.alias(alias))
    parts = [one("orders", F.count("*"), "n_orders"), one("customer", F.count("*"), "n_customers"), one("supplier", F.count("*"), "n_suppliers"), one("part", F.count("*"), "n_parts"),
             one("lineitem", F.count("*"), "n_returned", "l_returnflag = 'R'"), one("orders", F.countDistinct("o_custkey"), "n_buyers")]
    keyed = [p.withColumn("k", F.lit(1)) for p in parts]
    return reduce(lambda a, b: a.join(b, "k"), keyed).drop("k")


@query("SELECT coalesce(lang, 'none') AS lang, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents), 6) AS share FROM documents GROUP BY 1")
def lang_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language counts and shares, unknown as a group of its own (A-26)."""
    counts = load(spark, sf_dir, "documents").groupBy(F.coalesce("lang", F.lit("none")).alias("lang")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6))


@query("""SELECT o_orderstatus, count(*) AS n, sum((o_totalprice > 150000)::INT)::BIGINT AS n_large, count(*) FILTER (o_orderpriority LIKE '1%') AS n_urgent,
round(avg(o_totalprice), 4) AS mean_price, min(o_orderdate) AS first_day, max(o_orderdate) AS last_day FROM orders GROUP BY o_orderstatus""")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, conditional sums, means and extremes by group (A-02, A-04, A-05, P-14)."""
    return load(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(
        F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 150000).alias("n_large"), F.count_if(F.col("o_orderpriority").startswith("1")).alias("n_urgent"),
        F.round(F.avg("o_totalprice"), 4).alias("mean_price"), F.min("o_orderdate").alias("first_day"), F.max("o_orderdate").alias("last_day"))


@query("""WITH m AS (SELECT source, lang, count(*) AS n, min(doc_id) AS f FROM documents GROUP BY source, lang),
r AS (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY n DESC, f) AS k FROM m)
SELECT d.source, count(*) AS n_docs, bool_or(n_chars > 3000) AS any_long, min(doc_id) AS first_doc, max(doc_id) AS last_doc, any_value(r.lang) AS main_lang
FROM documents d JOIN r ON r.source = d.source AND k = 1 GROUP BY d.source""")
def source_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry by domain: any flag, modal value (ties: first seen), counts and ends (A-11, A-12); two levels of partial sums, no window over rows."""
    by_lang = load(spark, sf_dir, "documents").groupBy("source", "lang").agg(
        F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.bool_or(F.col("n_chars") > 3000).alias("any_long"))
    return by_lang.groupBy("source").agg(
        F.sum("n").alias("n_docs"), F.bool_or("any_long").alias("any_long"), F.min("first_doc").alias("first_doc"), F.max("last_doc").alias("last_doc"),
        F.max_by("lang", F.struct("n", -F.col("first_doc"))).alias("main_lang"))


@query("SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS priorities, count(DISTINCT o_orderstatus) AS n_status FROM orders GROUP BY o_custkey")
def listagg_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered concatenation of distinct values by group (A-06)."""
    return load(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("priorities"), F.countDistinct("o_orderstatus").alias("n_status"))


@query("""WITH t AS (SELECT regexp_replace(p_type, ' .*$', '') AS kind, p_size FROM part), top AS (SELECT kind FROM t GROUP BY kind ORDER BY count(*) DESC, kind LIMIT 6)
SELECT kind, count(*) FILTER (p_size <= 10) AS s10, count(*) FILTER (p_size > 10 AND p_size <= 25) AS s25, count(*) FILTER (p_size > 25) AS s50 FROM t SEMI JOIN top USING (kind) GROUP BY kind""")
def heat_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group by class pivot over the six largest groups (A-18)."""
    rows = load(spark, sf_dir, "part").select(F.split_part("p_type", F.lit(" "), F.lit(1)).alias("kind"), F.when(F.col("p_size") <= 10, "s10").when(F.col("p_size") <= 25, "s25").otherwise("s50").alias("band"))
    top = rows.groupBy("kind").count().orderBy(F.desc("count"), "kind").limit(6).select("kind")
    return rows.join(top, "kind", "left_semi").groupBy("kind").pivot("band", ["s10", "s25", "s50"]).count().na.fill(0)


@query("""WITH b AS (SELECT ceil((max(n_chars) - min(n_chars) + 1) / 24)::BIGINT AS w, min(n_chars) AS lo FROM documents)
SELECT (n_chars - lo) // w AS bucket, any_value(lo + ((n_chars - lo) // w) * w) AS low, count(*) AS n FROM documents, b GROUP BY 1""")
def adaptive_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 24 equal buckets over the data's range (A-20); the range is one row, known before the second pass."""
    docs = load(spark, sf_dir, "documents").select("n_chars")
    lo, hi = docs.agg(F.min("n_chars"), F.max("n_chars")).first()
    if lo is None:
        return docs.select(F.lit(0).cast("long").alias("bucket"), F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("n")).limit(0)
    width = -(-(hi - lo + 1) // 24)
    bucket = F.floor((F.col("n_chars") - lo) / width)
    return docs.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).withColumn("low", lo + F.col("bucket") * width)


@query("""WITH s AS (SELECT user_id, event_type, value, ts FROM events), k AS (SELECT user_id, max(value) AS best FROM s GROUP BY user_id)
SELECT s.user_id, any_value(best) AS best, arg_min(event_type, ts) FILTER (value = best) AS best_type, count(DISTINCT event_type) AS variants FROM s JOIN k USING (user_id) GROUP BY s.user_id""")
def best_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value of greatest confidence by group, the first on ties, with the number of variants (A-19)."""
    ev = load(spark, sf_dir, "events").select("user_id", "event_type", "value", (-F.unix_micros(F.col("ts").cast("timestamp"))).alias("early"))
    return ev.groupBy("user_id").agg(F.max("value").alias("best"), F.max_by("event_type", F.struct("value", "early")).alias("best_type"), F.countDistinct("event_type").alias("variants"))


@query("""WITH f AS (SELECT user_id, min(ts) FILTER (event_type = 'view') AS a, min(ts) AS b, max(ts) AS c FROM events GROUP BY user_id)
SELECT count(*) AS n, round(median(epoch(c) - epoch(b)) / 3600, 4) AS median_hours, round(avg(epoch(c) - epoch(b)) / 3600, 4) AS mean_hours FROM f""")
def median_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and mean of the time between a group's first and last event (A-21, W-02)."""
    ends = load(spark, sf_dir, "events").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).groupBy("user_id").agg((F.max("s") - F.min("s")).alias("gap"))
    (middle,) = ordering.medians(ends, [F.col("gap")])
    return ends.agg(F.count("*").alias("n"), F.round(F.lit(middle).cast("double") / 3600, 4).alias("median_hours"), F.round(F.avg("gap") / 3600, 4).alias("mean_hours"))


# -- joins ------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def work_queue_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that no later stage has taken up (J-04, J-05)."""
    return load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def semi_and_not_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semi join, and an anti join on a column without nulls (J-06, J-07, J-08)."""
    orders = load(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    buyers, finished = orders.where("o_totalprice > 200000").select("c_custkey"), orders.where("o_orderstatus = 'F'").select("c_custkey")
    return load(spark, sf_dir, "customer").select("c_custkey", "c_name").join(buyers, "c_custkey", "left_semi").join(finished, "c_custkey", "left_anti")


@query("""SELECT r_name, n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON c_custkey = o_custkey
JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE o_orderdate >= DATE '1995-01-01' GROUP BY r_name, n_name""")
def star_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Star of inner joins with a pushed filter (J-01, J-20); sums meet by customer first, so the big table shuffles small rows."""
    orders = load(spark, sf_dir, "orders").where(F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp_ntz"))
    sums = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("s"))
    named = load(spark, sf_dir, "nation").join(load(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    joined = sums.join(load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey").join(named, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("r_name", "n_name").agg(F.sum("n").alias("n_orders"), F.round(F.sum("s"), 2).alias("total"))


@query("""SELECT c_custkey, count(o_orderkey) AS n_orders, coalesce(sum((o_orderstatus = 'O')::INT), 0)::BIGINT AS n_open,
(SELECT round(max(o_totalprice), 2) FROM orders x WHERE x.o_custkey = c_custkey) AS largest FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def correlated_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlated scalars as one aggregate joined once (J-02, J-11, J-21)."""
    per = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("n_orders"), F.count_if(F.col("o_orderstatus") == "O").alias("n_open"), F.round(F.max("o_totalprice"), 2).alias("largest"))
    return load(spark, sf_dir, "customer").select("c_custkey").join(per, "c_custkey", "left").na.fill(0, ["n_orders", "n_open"])


@query("""WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k FROM n)
SELECT user_id, event_type AS main_type, n FROM r WHERE k = 1""")
def correlated_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most frequent value by group, ties by name (J-12, A-12)."""
    n = load(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    first = Window.partitionBy("user_id").orderBy(F.desc("n"), "event_type")
    return n.withColumn("k", F.row_number().over(first)).where("k = 1").select("user_id", F.col("event_type").alias("main_type"), "n")


@query("""WITH w AS (SELECT o_orderkey, o_orderdate::DATE AS lo, o_orderdate::DATE + 14 AS hi, o_custkey FROM orders WHERE o_totalprice > 100000)
SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM w a JOIN w b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND a.hi >= b.lo AND a.lo <= b.hi""")
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 14 days that overlap, for one key (J-13, J-14, P-12): an equi-join on key and date cell, the range as the rest.

    An interval lies in at most two cells; a pair counts in the cell where the later of the two begins."""
    rows = load(spark, sf_dir, "orders").where("o_totalprice > 100000").select("o_orderkey", "o_custkey", F.unix_date(F.to_date("o_orderdate")).alias("lo"))
    rows = rows.withColumn("hi", F.col("lo") + 14).withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / 15), F.floor(F.col("hi") / 15))))
    a, b = (rows.select("o_custkey", "cell", *[F.col(c).alias(f"{x}_{c}") for c in ("o_orderkey", "lo", "hi")]) for x in "ab")
    met = a.join(b, ["o_custkey", "cell"]).where("a_o_orderkey < b_o_orderkey AND a_hi >= b_lo AND a_lo <= b_hi")
    return met.where(F.col("cell") == F.floor(F.greatest("a_lo", "b_lo") / 15)).select(F.col("a_o_orderkey").alias("a"), F.col("b_o_orderkey").alias("b"))


# -- latest rows and order ---------------------------------------------------------------------------------------------


@query("SELECT user_id, arg_max(event_id, ts) AS event_id, arg_max(event_type, ts) AS event_type, max(ts) AS ts FROM events GROUP BY user_id")
def latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest row of each group (J-09, W-01) as a partial aggregate: no sort, no window."""
    rows = load(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id", "event_type").alias("s"))
    return rows.groupBy("user_id").agg(F.max("s").alias("s")).select("user_id", "s.event_id", "s.event_type", "s.ts")


@query("SELECT user_id, event_id, day FROM (SELECT user_id, event_id, ts::DATE AS day, rank() OVER (PARTITION BY user_id ORDER BY ts::DATE DESC) AS r FROM events) WHERE r = 1")
def latest_with_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of each group's newest day (J-10)."""
    rows = load(spark, sf_dir, "events").select("user_id", "event_id", F.to_date("ts").alias("day"))
    return rows.withColumn("r", F.rank().over(Window.partitionBy("user_id").orderBy(F.desc("day")))).where("r = 1").drop("r")


@query("SELECT user_id, arg_max(event_id, ts) AS event_id, count(*) AS n_seen FROM events WHERE ts <= (SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events) GROUP BY user_id")
def asof_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each group at a point in time (J-19): later rows are invisible."""
    ev = load(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    lo, hi = ev.agg(F.min("us"), F.max("us")).first()
    seen = ev.where(F.col("us") <= F.lit((lo or 0) + ((hi or 0) - (lo or 0)) // 2))
    return seen.groupBy("user_id").agg(F.max_by("event_id", "us").alias("event_id"), F.count("*").alias("n_seen"))


@query("""WITH base AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, o_orderdate::DATE AS day FROM orders WHERE o_totalprice >= 50000)
SELECT 'status' AS facet, o_orderstatus AS value, count(*) AS n FROM base WHERE o_orderpriority ILIKE '1-%' GROUP BY 2
UNION ALL SELECT 'priority', o_orderpriority, count(*) FROM base WHERE o_orderstatus = 'F' GROUP BY 2
UNION ALL SELECT 'year', year(day)::VARCHAR, count(*) FROM base WHERE o_orderstatus = 'F' AND o_orderpriority ILIKE '1-%' GROUP BY 2""")
def facet_all_but_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facet counts under all filters but the facet's own (P-08, P-09, P-05, U-01)."""
    base = load(spark, sf_dir, "orders").where("o_totalprice >= 50000")
    filters = {"status": F.col("o_orderstatus") == "F", "priority": F.col("o_orderpriority").ilike("1-%")}
    facet = lambda name, value, own: base.where(conditions(filters, own)).groupBy(value.cast("string").alias("value")).agg(F.count("*").alias("n")).select(F.lit(name).alias("facet"), "value", "n")
    return facet("status", F.col("o_orderstatus"), "status").unionByName(facet("priority", F.col("o_orderpriority"), "priority")).unionByName(facet("year", F.year("o_orderdate"), None))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey LIMIT 40 OFFSET 80")
def paged_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page of an order with mixed directions (O-01, O-02, P-02)."""
    rank = F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    return load(spark, sf_dir, "orders").orderBy(rank, F.desc("o_totalprice"), "o_orderkey").offset(80).limit(40).select("o_orderkey", "o_totalprice")


@query("""SELECT l_orderkey, count(*) AS n_items, count(DISTINCT l_suppkey) AS n_suppliers, count(*) + 2 * count(DISTINCT l_suppkey) AS score FROM lineitem GROUP BY l_orderkey ORDER BY score DESC, l_orderkey LIMIT 24""")
def topk_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top rows by an expression over aggregates (O-03, O-05)."""
    n = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_items"), F.countDistinct("l_suppkey").alias("n_suppliers"))
    return n.withColumn("score", F.col("n_items") + 2 * F.col("n_suppliers")).orderBy(F.desc("score"), "l_orderkey").limit(24)


@query("SELECT source, doc_id, n_chars, k FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k <= 3")
def group_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest rows of each group (O-04); Spark keeps k rows a group before the shuffle."""
    order = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return load(spark, sf_dir, "documents").select("source", "doc_id", "n_chars", F.row_number().over(order).alias("k")).where("k <= 3")


@query("""WITH m AS (SELECT max(o_orderdate) AS t FROM orders) SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders, m WHERE o_orderdate >= t - INTERVAL 90 DAY GROUP BY o_orderstatus""")
def data_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 90 days by the data's own clock (P-10, P-11); the clock is one value, so the filter reaches the scan."""
    orders = load(spark, sf_dir, "orders")
    newest = orders.agg(F.max("o_orderdate")).first()[0]
    from datetime import timedelta

    since = F.lit(newest - timedelta(days=90)).cast("timestamp_ntz") if newest else F.lit(None).cast("timestamp_ntz")
    return orders.where(F.col("o_orderdate") >= since).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""WITH p AS (SELECT l_orderkey, l_partkey % 40 AS part FROM lineitem GROUP BY ALL)
SELECT a.part AS a, b.part AS b, count(*) AS n FROM p a JOIN p b ON a.l_orderkey = b.l_orderkey AND a.part < b.part GROUP BY 1, 2 ORDER BY n DESC, a, b LIMIT 24""")
def cooccurrence_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent pairs of values that rows hold together (A-15): pairs of each row's own array, of at most 40 values."""
    sets = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.col("l_partkey") % 40)).alias("v"))
    pairs = F.flatten(F.transform("v", lambda x, i: F.transform(F.slice("v", i + 2, F.size("v")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return sets.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "a", "b").limit(24)


@query("""WITH m AS (SELECT max(ts) AS t FROM events), e AS (SELECT event_type, user_id, floor((epoch(t) - epoch(ts)) / 86400)::BIGINT AS age FROM events, m)
SELECT event_type, count(DISTINCT user_id) FILTER (age < 28) AS now_n, count(DISTINCT user_id) FILTER (age >= 28 AND age < 56) AS before_n, count(*) FILTER (7 - least(7, age // 7) = 7) AS week7,
count(*) FILTER (7 - least(7, age // 7) = 0) AS week0, CASE WHEN count(DISTINCT user_id) FILTER (age >= 28 AND age < 56) = 0 THEN NULL
ELSE round(100.0 * (count(DISTINCT user_id) FILTER (age < 28) - count(DISTINCT user_id) FILTER (age >= 28 AND age < 56)) / count(DISTINCT user_id) FILTER (age >= 28 AND age < 56), 2) END AS change FROM e GROUP BY event_type""")
def risk_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two periods, weekly buckets and the change between the periods by group (A-16, W-11, F-33)."""
    ev = load(spark, sf_dir, "events").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    newest = ev.agg(F.max("s")).first()[0] or 0.0
    aged = ev.withColumn("age", F.floor((F.lit(newest) - F.col("s")) / 86400)).withColumn("week", 7 - F.least(F.lit(7), F.floor(F.col("age") / 7)))
    now, past = F.col("age") < 28, (F.col("age") >= 28) & (F.col("age") < 56)
    groups = aged.groupBy("event_type").agg(F.countDistinct(F.when(now, F.col("user_id"))).alias("now_n"), F.countDistinct(F.when(past, F.col("user_id"))).alias("before_n"),
                                            F.count_if(F.col("week") == 7).alias("week7"), F.count_if(F.col("week") == 0).alias("week0"))
    return groups.withColumn("change", F.when(F.col("before_n") > 0, F.round(100.0 * (F.col("now_n") - F.col("before_n")) / F.col("before_n"), 2)))


@query("""SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\\.', '') AS domain, url ILIKE '%PAGE=%' AS paged, coalesce(nullif(regexp_extract(url, '#(.*)$', 1), ''), 'none') AS anchor
FROM pages WHERE url NOT ILIKE '%EXAMPLE.ORG%'""")
def like_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case-blind patterns and null handling (P-03, P-05, P-06, F-11)."""
    from casebook.functions.text import domain_of

    pages = load(spark, sf_dir, "pages").where(~F.col("url").ilike("%EXAMPLE.ORG%"))
    return pages.select("page_id", domain_of(F.col("url")).alias("domain"), F.col("url").ilike("%PAGE=%").alias("paged"), F.coalesce(F.nullif(F.regexp_extract("url", "#(.*)$", 1), F.lit("")), F.lit("none")).alias("anchor"))


@query("SELECT max(n) AS most, sum(n)::BIGINT AS total FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey UNION ALL SELECT count(*) FROM events GROUP BY user_id)")
def union_all_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An aggregate over a union (A-08, U-01, U-03)."""
    a = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).select("n")
    return a.unionByName(load(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n")).select("n")).agg(F.max("n").alias("most"), F.sum("n").alias("total"))


@query("""SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2""")
def events_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling day windows (G-S11, P-15)."""
    ev = load(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return ev.groupBy(F.window("t", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n", "total")


@query("""SELECT user_id, event_id, round(epoch(ts - min(ts) OVER (PARTITION BY user_id)) / 3600, 4) AS hours, ts::DATE AS day, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 4 AS chunk FROM events""")
def hours_since_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time since the group's first row, and chunks of rows in order (W-04, W-10)."""
    w = Window.partitionBy("user_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return load(spark, sf_dir, "events").select("user_id", "event_id", F.round((us - F.min(us).over(w)) / 3.6e9, 4).alias("hours"), F.to_date("ts").alias("day"),
                                                F.floor((F.row_number().over(w.orderBy("ts", "event_id")) - 1) / 4).alias("chunk"))


@query("SELECT get_k AS k, count(*) AS n, sum(v)::BIGINT AS total FROM (SELECT json_extract_string(props, '$.k')::BIGINT AS v, CASE WHEN json_extract_string(props, '$.k')::BIGINT % 2 = 1 THEN 'odd' ELSE 'even' END AS get_k FROM events) GROUP BY 1")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of JSON texts, malformed ones as null (P-17, F-41)."""
    v = F.try_to_number(F.get_json_object("props", "$.k"), F.lit("999999999")).cast("long")
    rows = load(spark, sf_dir, "events").select(v.alias("v"))
    return rows.groupBy(F.when(F.col("v") % 2 == 1, "odd").otherwise("even").alias("k")).agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query("""SELECT event_id, user_id FROM events WHERE event_id % 7 = 3 QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY (event_id * 7919) % 10007, event_id) <= 10""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repeatable sample of some rows a label (P-19): sampling is the operator."""
    order = Window.partitionBy("event_type").orderBy((F.col("event_id") * 7919) % 10007, "event_id")
    return load(spark, sf_dir, "events").where("event_id % 7 = 3").withColumn("k", F.row_number().over(order)).where("k <= 10").select("event_id", "user_id")
