"""Editorial queries: sources, publishers, ranks, maps, queues, repairs, lookups (X-*, O-*, W-*, Y-*, A-17, A-27, A-29), with order lines as articles and orders as incidents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casebook.functions.text import normalize_entity, space_tokens, tokenize
from casebook.operators import desk, ledger, records
from casebook.plans.base import load, query


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as articles: the supplier is the publisher at the headline's end; some addresses are an aggregator's, some unknown."""
    k = F.col("l_suppkey")
    url = F.when(k % 3 == 0, "https://news.google.com/rss/x").when(k % 3 == 1, F.concat(F.lit("https://www.S"), k.cast("string"), F.lit(".co.id/a?b=1")))
    title = F.concat(F.lit("Part "), (F.col("l_partkey") % 40).cast("string"), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit(" - Press "), k.cast("string"))))
    return load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("incident"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), title.alias("title"), url.alias("url"), F.col("l_shipdate").alias("at"), F.col("l_quantity").alias("quantity"))


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as known sources; a publisher may have two domains."""
    k = F.col("s_suppkey")
    return load(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.concat(F.lit(" PRESS "), (k - k % 4).cast("string")).alias("publisher"), F.concat(F.lit("p"), k.cast("string"), F.lit(".example.com")).alias("domain"), (k % 7).alias("articles"))


_ARTICLES = """art AS (SELECT l_orderkey AS incident, l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_suppkey % 5 = 0 THEN '' ELSE 'press ' || l_suppkey END AS p, l_shipdate AS tm,
  CASE l_suppkey % 3 WHEN 0 THEN 'news.google.com' WHEN 1 THEN 's' || l_suppkey || '.co.id' ELSE '' END AS host, 'Part ' || (l_partkey % 40) AS headline FROM lineitem),
reg AS (SELECT 'press ' || (s_suppkey - s_suppkey % 4) AS p, 'p' || s_suppkey || '.example.com' AS domain FROM supplier WHERE s_suppkey % 2 = 0 QUALIFY row_number() OVER (PARTITION BY s_suppkey - s_suppkey % 4 ORDER BY s_suppkey % 7 DESC, 'p' || s_suppkey || '.example.com') = 1),
src AS (SELECT art.*, domain AS known, CASE WHEN host NOT IN ('', 'news.google.com') THEN host WHEN art.p <> '' THEN coalesce(domain, 'penerbit:' || art.p) ELSE host END AS identity,
  coalesce(CASE WHEN host <> '' AND host NOT LIKE '%google.%' THEN host END, domain, '') AS direct FROM art LEFT JOIN reg USING (p))"""


@query(f"WITH {_ARTICLES} SELECT incident, count(DISTINCT nullif(identity, '')) AS sources, min(nullif(identity, '')) AS first_source FROM src GROUP BY incident")
def source_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct sources of each incident, by domain, publisher or registry (F-06, F-11, F-12, X-18, A-27)."""
    found = desk.source_identity(articles(spark, sf_dir), desk.publisher_domains(registry(spark, sf_dir))).withColumn("identity", F.nullif("identity", F.lit("")))
    return found.groupBy("incident").agg(F.countDistinct("identity").alias("sources"), F.min("identity").alias("first_source"))


@query(f"""WITH {_ARTICLES} SELECT incident, upper(p[1]) || p[2:] AS name, arg_min(nullif(direct, ''), id) FILTER (direct <> '') AS domain FROM src WHERE p <> '' GROUP BY incident, p""")
def incident_publishers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publishers of each incident with a domain where one is known (X-27)."""
    return desk.publishers_of(articles(spark, sf_dir), desk.publisher_domains(registry(spark, sf_dir))).select("incident", "name", "domain")


@query(f"""WITH {_ARTICLES}, names AS (SELECT incident, count(DISTINCT CASE WHEN p <> '' THEN p ELSE nullif(direct, '') END) AS publishers FROM src GROUP BY incident),
c AS (SELECT incident, direct, count(*) AS n FROM src WHERE direct <> '' GROUP BY incident, direct QUALIFY row_number() OVER (PARTITION BY incident ORDER BY n DESC, direct) <= 3)
SELECT incident, publishers, coalesce((SELECT string_agg(direct, ',' ORDER BY n DESC, direct) FROM c WHERE c.incident = names.incident), '') AS logos FROM names""")
def survey_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct publishers and the three most frequent domains of each incident (X-33)."""
    return desk.incident_media(articles(spark, sf_dir), desk.publisher_domains(registry(spark, sf_dir)))


@query("""WITH p AS (SELECT c_nationkey AS province, o_orderkey AS incident, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'City ' || (c_custkey % 9) END AS city, ['phishing', 'malware', 'fraud'][1 + o_orderkey % 3:2 + o_orderkey % 3] AS kinds FROM orders JOIN customer ON c_custkey = o_custkey),
k AS (SELECT province, kind, count(DISTINCT incident) AS n FROM (SELECT province, incident, unnest(kinds) AS kind FROM p) GROUP BY province, kind QUALIFY row_number() OVER (PARTITION BY province ORDER BY n DESC, kind) <= 2),
c AS (SELECT province, city, count(DISTINCT incident) AS n FROM p WHERE city <> '' GROUP BY province, city QUALIFY row_number() OVER (PARTITION BY province ORDER BY n DESC, city) <= 2),
f AS (SELECT province, incident FROM (SELECT DISTINCT province, incident FROM p) QUALIFY row_number() OVER (PARTITION BY province ORDER BY incident) <= 3)
SELECT province, count(DISTINCT incident) AS incidents, (SELECT string_agg(kind || ':' || n, ',' ORDER BY n DESC, kind) FROM k WHERE k.province = p.province) AS kinds,
(SELECT string_agg(city || ':' || n, ',' ORDER BY n DESC, city) FROM c WHERE c.province = p.province) AS cities, (SELECT string_agg(incident, ',' ORDER BY incident) FROM f WHERE f.province = p.province) AS samples FROM p GROUP BY province""")
def province_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provinces with their incidents, cities, kinds and first samples, each incident once (A-17)."""
    o, c = load(spark, sf_dir, "orders"), load(spark, sf_dir, "customer")
    city = F.when(F.col("c_custkey") % 4 == 0, "").otherwise(F.concat(F.lit("City "), (F.col("c_custkey") % 9).cast("string")))
    kinds = F.slice(F.array(*map(F.lit, ("phishing", "malware", "fraud"))), (F.col("o_orderkey") % 3 + 1).cast("int"), F.lit(2))
    rows = o.join(c, o["o_custkey"] == c["c_custkey"]).select(F.col("c_nationkey").alias("province"), F.col("o_orderkey").alias("incident"), city.alias("city"), kinds.alias("kinds"))
    return desk.province_rollup(rows)


@query("""WITH n AS (SELECT c_nationkey AS province, count(*) FILTER (c_acctbal > 7000) AS n FROM customer GROUP BY 1), m AS (SELECT max(n) AS m FROM n),
b AS (SELECT m, CASE WHEN m <= 5 THEN range(1, greatest(m, 1) + 1) ELSE list_distinct([1] || list_transform([0.15, 0.35, 0.6, 0.85], lambda s: greatest(1, floor(m * s + 0.5)::BIGINT))) END AS b FROM m)
SELECT province, n, len(list_filter(b, lambda x: x <= n)) - 1 AS class, array_to_string(list_sort(b), ',') AS breaks FROM n, b""")
def class_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map classes of provinces by their counts (A-29)."""
    counts = load(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("province")).agg(F.count_if(F.col("c_acctbal") > 7000).alias("n"))
    met = counts.withColumn("b", desk.class_breaks(F.lit(counts.agg(F.max("n")).first()[0])))
    return met.select("province", "n", desk.class_index(F.col("n"), F.col("b")).alias("class"), F.array_join(F.sort_array("b"), ",").alias("breaks"))


@query("""WITH i AS (SELECT l_orderkey AS incident, count(*) AS documents, count(DISTINCT l_suppkey) AS domains, max(l_shipdate)::DATE AS last_day FROM lineitem GROUP BY 1)
SELECT row_number() OVER (ORDER BY documents + 2 * domains DESC, incident) AS rank, incident, documents + 2 * domains AS score FROM i WHERE documents >= 2 AND last_day >= (SELECT max(last_day) FROM i) - 60 ORDER BY rank LIMIT 20""")
def top_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest incidents of the last days of the data, ranked (W-07, Y-01, O-03, P-11)."""
    i = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("incident")).agg(F.count("*").alias("documents"), F.countDistinct("l_suppkey").alias("domains"), F.unix_date(F.to_date(F.max("l_shipdate"))).alias("last_day"))
    return desk.top_incidents(i, 60, 20)


@query("""WITH d AS (SELECT user_id, (ts + INTERVAL 7 HOUR)::DATE AS day FROM events), n AS (SELECT user_id, day, count(*) AS n FROM d GROUP BY ALL),
r AS (SELECT *, day - row_number() OVER (PARTITION BY user_id ORDER BY day)::INT AS run FROM n)
SELECT user_id, min(day)::VARCHAR AS first_day, max(day)::VARCHAR AS last_day, count(*) AS days, sum(n)::BIGINT AS events FROM r GROUP BY user_id, run""")
def day_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of consecutive local days with events of each user (W-09, F-34); events are counted by day before they meet."""
    day = F.to_date(F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Asia/Jakarta"))
    counts = load(spark, sf_dir, "events").groupBy("user_id", day.alias("day")).agg(F.count("*").alias("n"))
    run = F.date_sub("day", F.row_number().over(Window.partitionBy("user_id").orderBy("day")))
    return counts.withColumn("run", run).groupBy("user_id", "run").agg(F.min("day").cast("string").alias("first_day"), F.max("day").cast("string").alias("last_day"), F.count("*").alias("days"), F.sum("n").alias("events")).drop("run")


@query(f"""WITH {_ARTICLES}, a AS (SELECT incident, min(id) AS anchor, arg_min(tm, (id, tm)) AS tm FROM art GROUP BY 1), g AS (SELECT art.incident, art.id, anchor, round(abs(epoch(art.tm) - epoch(a.tm)) / 86400, 4) AS gap FROM art JOIN a USING (incident)),
r AS (SELECT *, row_number() OVER (PARTITION BY incident ORDER BY (id = anchor) DESC, gap, id) AS k FROM g) SELECT incident, k, id, gap FROM r WHERE k <= 3""")
def nearest_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The articles nearest in time to each incident's anchor, the anchor first (O-06, F-36, S-07)."""
    own = articles(spark, sf_dir).select("incident", "id", "at")
    anchors = own.groupBy("incident").agg(F.min(F.struct(F.col("id").alias("anchor"), F.col("at").alias("anchor_at"))).alias("a")).select("incident", "a.*")
    return desk.by_time_distance(own.join(anchors, "incident"), 3).withColumn("gap", F.round("gap", 4))


@query("""WITH a AS (SELECT user_id AS id, count(*) AS answers FROM events WHERE event_type = 'click' GROUP BY 1), p AS (SELECT c_custkey AS id, coalesce(answers, 0) AS answers FROM customer LEFT JOIN a ON a.id = c_custkey ORDER BY answers, c_nationkey DESC, c_custkey LIMIT 30)
SELECT id, answers FROM p ORDER BY md5('7:' || id), id LIMIT 1""")
def least_answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next card to ask about, from the thirty with fewest answers (O-08); the pool is the feature."""
    answers = load(spark, sf_dir, "events").where("event_type = 'click'").select(F.col("user_id").alias("id"))
    return desk.least_answered(load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("published")), answers, 30, 7)


@query("""SELECT o_orderkey, weekofyear(o_orderdate)::INT AS week, CASE WHEN n >= 8 OR (heavy AND n >= 3) THEN 'crit' WHEN n >= 3 OR heavy THEN 'high' ELSE 'med' END AS severity,
CASE WHEN now >= 20 OR (now >= 8 AND now > prev * 1.5) THEN 'high' WHEN now >= 5 THEN 'medium' ELSE 'low' END AS risk, CASE o_orderkey % 4 WHEN 0 THEN 'Acme/North Co-Op' WHEN 1 THEN 'Big Bank' END AS service,
CASE o_orderkey % 4 WHEN 2 THEN 'GOVERNMENT' WHEN 0 THEN 'HEALTH' END AS sector
FROM (SELECT *, o_orderkey % 11 AS n, o_orderkey % 3 = 0 AS heavy, o_orderkey % 25 AS now, o_custkey % 9 AS prev FROM orders)""")
def display_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a list shows of incidents: week, severity, risk, service name, institution's sector (F-14, F-32, X-30, X-31)."""
    k = F.col("o_orderkey")
    pick = lambda *v: F.get(F.array(*map(F.lit, v)), (k % len(v)).cast("int"))
    target, sector = pick("acme/north co-op, other", "Big Bank", "City council", "users"), pick("HEALTH, TRADE", "TRADE", "TRADE", None)
    kinds = F.when(k % 3 == 0, "Ransomware, x").otherwise("phishing")
    service = desk.service_name(target, ["users", "people", "city council"])
    return load(spark, sf_dir, "orders").select(
        "o_orderkey", F.weekofyear("o_orderdate").alias("week"), desk.severity(k % 11, kinds, ["ransomware"]).alias("severity"), desk.risk_level(k % 25, F.col("o_custkey") % 9).alias("risk"), service.alias("service"),
        desk.institution_sector(target, sector, r"\bcouncil\b", ["jakarta"], ["HEALTH"]).alias("sector"))


@query(f"""WITH {_ARTICLES}, f AS (SELECT incident, headline, summary FROM (SELECT art.*, 'Part ' || (id % 3) AS summary FROM art) QUALIFY row_number() OVER (PARTITION BY incident ORDER BY tm, id, headline) = 1),
o AS (SELECT incident, headline, min((tm, id)) AS place FROM art GROUP BY incident, headline), m AS (SELECT o.* FROM o JOIN f ON f.incident = o.incident AND f.headline <> o.headline QUALIFY row_number() OVER (PARTITION BY o.incident ORDER BY place, o.headline) <= 3)
SELECT incident, concat_ws('. ', headline, (SELECT string_agg(m.headline, '. ' ORDER BY place, m.headline) FROM m WHERE m.incident = f.incident), CASE WHEN summary <> headline THEN summary END) AS text FROM f""")
def incident_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of each incident from its anchor's and other headlines (R-01, F-06)."""
    rows = articles(spark, sf_dir)
    docs = rows.withColumn("summary", F.concat(F.lit("Part "), (F.col("id") % 3).cast("string"), F.lit(" - Some press")))
    return desk.incident_texts(rows.groupBy("incident").agg(F.min(F.struct("at", "id")).alias("f")).select("incident", F.col("f.id").alias("anchor")), docs)


@query("""WITH i AS (SELECT c_custkey AS id, c_custkey AS rank, md5(c_mktsegment) AS digest FROM customer), s AS (SELECT c_custkey AS id, md5(CASE WHEN c_custkey % 3 = 0 THEN 'old' ELSE c_mktsegment END) AS digest, c_custkey % 10 AS made FROM customer WHERE c_custkey % 5 <> 0)
SELECT i.id, rank FROM i LEFT JOIN s USING (id) WHERE s.digest IS NULL OR s.digest <> i.digest OR made < 2 ORDER BY rank LIMIT 100""")
def changed_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs whose input is new, changed or stale, by rank within a budget (Y-02, X-22); the budget is the feature."""
    c, k = load(spark, sf_dir, "customer"), F.col("c_custkey")
    stored = c.where("c_custkey % 5 <> 0").select(k.alias("id"), F.md5(F.when(k % 3 == 0, "old").otherwise(F.col("c_mktsegment"))).alias("digest"), (k % 10).alias("made"))
    return desk.changed_jobs(c.select(k.alias("id"), k.alias("rank"), F.md5("c_mktsegment").alias("digest")), stored, 100, F.lit(2))


@query("""WITH l AS (SELECT l_partkey % 300 AS a, l_suppkey + 200 AS b, l_discount AS s FROM lineitem WHERE l_linenumber % 2 = 1), p AS (SELECT least(a, b) AS a, greatest(a, b) AS b, max(s) AS similarity FROM l GROUP BY 1, 2)
SELECT a, b, similarity FROM p WHERE NOT (a % 4 = 0 AND b % 2 = 0) AND a % 7 <> 0 AND b % 7 <> 0 ORDER BY similarity DESC, a, b LIMIT 50""")
def merge_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unordered candidate pairs to judge, most alike first (C-12, X-23); the budget is the feature."""
    links = load(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 300).alias("id"), (F.col("l_suppkey") + 200).alias("other"), F.col("l_discount").alias("similarity"), (F.col("l_linenumber") % 2 == 1).alias("same_event"))
    pairs = links.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))
    existing = links.select(F.explode(F.array("id", "other")).alias("id")).distinct().where("id % 7 <> 0")
    return desk.merge_jobs(links, pairs.where("a % 4 = 0 AND b % 2 = 0").distinct(), existing, 50)


@query("""WITH b AS (SELECT s_suppkey AS batch, md5(s_name) AS root, CASE WHEN s_suppkey % 4 = 0 THEN 'ANCHORED' ELSE 'PENDING' END AS status, CASE WHEN s_suppkey % 4 = 0 THEN 'old' END AS anchor FROM supplier)
SELECT batch, root, CASE WHEN batch % 3 = 0 AND batch % 5 <> 0 THEN 'ANCHORED' ELSE status END AS status, CASE WHEN batch % 3 = 0 AND batch % 5 <> 0 AND status <> 'ANCHORED' THEN 'tx' || batch ELSE anchor END AS anchor FROM b""")
def anchor_application(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors applied where root and batch both match and none is there yet (M-06, X-24)."""
    s, k = load(spark, sf_dir, "supplier"), F.col("s_suppkey")
    batches = s.select(k.alias("batch"), F.md5("s_name").alias("root"), F.when(k % 4 == 0, "ANCHORED").otherwise("PENDING").alias("status"), F.when(k % 4 == 0, "old").alias("anchor"))
    anchors = s.where("s_suppkey % 3 = 0").select(k.alias("batch"), F.md5(F.when(k % 5 == 0, "other").otherwise(F.col("s_name"))).alias("root"), F.concat(F.lit("tx"), k.cast("string")).alias("anchor"))
    return desk.apply_anchors(batches, anchors)


@query("""SELECT doc_id, doc_id % 10 <> 7 AS leaf_matches, doc_id % 10 = 3 AS content_changed FROM documents WHERE doc_id % 3 = 0""")
def proof_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence looked up in its batch: whether its leaf is that of its payload, whether its root can be proved from it and whether its content has changed since (M-07, M-03)."""
    d = load(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("content"))
    made = ledger.batches(d, "doc_id", "content", 64)
    placed = made.select("batch", "leaves", "root", F.posexplode("leaves").alias("at", "leaf"))
    stored = placed.select("leaf", F.col("at").alias("position"), ledger.verify_proof(F.col("leaf"), ledger.merkle_proof(F.col("leaves"), F.col("at"), 64), F.col("root")).alias("proved"))
    asked = d.where("doc_id % 3 = 0").select("doc_id", ledger.leaf_hash(F.col("content")).alias("leaf"), F.when(F.col("doc_id") % 10 == 7, "tampered").otherwise(F.col("content")).alias("payload"), F.when(F.col("doc_id") % 10 == 3, "other").otherwise(F.col("content")).alias("current"), "content")
    met = asked.join(stored.groupBy("leaf").agg(F.bool_and("proved").alias("proved")), "leaf", "left")
    return met.select("doc_id", ((ledger.leaf_hash(F.col("payload")) == F.col("leaf")) & F.coalesce("proved", F.lit(False))).alias("leaf_matches"), (F.col("current") != F.col("content")).alias("content_changed"))


@query("""WITH s AS (SELECT o_custkey AS task, ['COMPLETED', 'IN_PROGRESS', 'FAILED', 'COMPLETED'][o_orderkey % 4 + 1] AS status FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1)
SELECT c_custkey AS task, CASE status WHEN 'IN_PROGRESS' THEN 'restart' WHEN 'FAILED' THEN 'retry' ELSE 'new' END AS how FROM customer LEFT JOIN s ON task = c_custkey WHERE status IS DISTINCT FROM 'COMPLETED'""")
def crawl_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks that a resumed crawl still has to run (G-S1, X-10)."""
    k = F.col("o_orderkey")
    state = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("task"), F.get(F.array(*map(F.lit, ("COMPLETED", "IN_PROGRESS", "FAILED", "COMPLETED"))), (k % 4).cast("int")).alias("status"), k.alias("seq"))
    return desk.crawl_plan(load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("task")), state)


@query("""WITH d AS (SELECT o_custkey % 60 AS period, count(DISTINCT o_orderkey % 12) AS done FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1) SELECT n_nationkey AS period, coalesce(done, 0) AS done, coalesce(done, 0) >= 12 AS complete FROM nation LEFT JOIN d ON period = n_nationkey""")
def crawl_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods in which every task is completed (X-09)."""
    state = load(spark, sf_dir, "orders").select((F.col("o_custkey") % 60).alias("period"), (F.col("o_orderkey") % 12).alias("task"), F.when(F.col("o_orderstatus") != "P", "COMPLETED").otherwise("FAILED").alias("status"))
    return desk.crawl_complete(load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("period")), state, 12)


@query("""WITH r AS (SELECT l_orderkey AS k, max(l_shipdate) AS done FROM lineitem WHERE l_orderkey % 3 <> 0 GROUP BY 1) SELECT o_orderkey FROM orders LEFT JOIN r ON k = o_orderkey WHERE done IS NULL OR o_orderdate + INTERVAL 80 DAY > done""")
def needs_reprocessing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs without a result or newer than it (P-18, J-04)."""
    done = load(spark, sf_dir, "lineitem").where("l_orderkey % 3 <> 0").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("done"))
    met = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").join(done, "o_orderkey", "left")
    return met.where(F.col("done").isNull() | (F.col("o_orderdate") + F.expr("interval 80 days") > F.col("done"))).select("o_orderkey")


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_returnflag = 'R') SELECT l.l_orderkey, count(*) AS n, count(c.l_discount) AS with_claim FROM lineitem l LEFT JOIN c ON c.l_orderkey = l.l_orderkey AND c.l_linenumber = l.l_linenumber GROUP BY 1""")
def composite_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left join on a composite key (J-03)."""
    lines = load(spark, sf_dir, "lineitem")
    claims = lines.where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("claim"))
    return lines.select("l_orderkey", "l_linenumber").join(claims, ["l_orderkey", "l_linenumber"], "left").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count("claim").alias("with_claim"))


@query("""WITH p AS (SELECT p_partkey, p_name || ', ' || p_type || ',, ' || upper(p_brand) AS list FROM part)
SELECT p_partkey, trim(split_part(list, ',', 1)) AS first, instr(list, 'old') > 0 AS has_text, list_contains(list_transform(string_split(lower(list), ','), lambda v: trim(v)), 'old') AS has_value,
len(list_filter(string_split(list, ','), lambda v: trim(v) <> '')) AS n_values FROM p""")
def list_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicates on comma lists: part of the text, whole value, first value (P-13, P-16, F-43)."""
    rows = load(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(", "), "p_type", F.lit(",, "), F.upper("p_brand")).alias("list"))
    values = records.value_list(F.col("list"))
    return rows.select("p_partkey", records.first_value(F.col("list")).alias("first"), (F.instr("list", "old") > 0).alias("has_text"), F.array_contains(values, "old").alias("has_value"), F.size(values).alias("n_values"))


@query("""WITH a AS (SELECT unnest(from_json('[' || event_id || ',' || (event_id + user_id) || ',-1]', '["BIGINT"]')) AS id FROM events) SELECT id, count(*) AS n FROM a WHERE id >= 0 GROUP BY id""")
def json_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a JSON array of ids (F-42)."""
    text = F.concat(F.lit("["), "event_id", F.lit(","), F.col("event_id") + F.col("user_id"), F.lit(",-1]"))
    ids = load(spark, sf_dir, "events").select(F.explode(F.from_json(text, "array<bigint>")).alias("id"))
    return ids.where("id >= 0").groupBy("id").agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT l_orderkey AS article, 'org' || (l_suppkey % 20) AS entity, CASE WHEN l_linenumber % 2 = 0 THEN 'ORG' ELSE 'ACTOR' END AS kind, 'n' || (l_partkey % 30) AS name FROM lineitem), f AS (SELECT DISTINCT * FROM m WHERE article % 4 <> 0)
SELECT entity, count(*) AS gained FROM f GROUP BY entity""")
def entity_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions that each entity gains, known and repeated ones left out (E-05)."""
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    m = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("article"), text("org", F.col("l_suppkey") % 20).alias("entity"), F.when(F.col("l_linenumber") % 2 == 0, "ORG").otherwise("ACTOR").alias("kind"), text("n", F.col("l_partkey") % 30).alias("name"))
    return desk.mention_ledger(m.where("article % 4 = 0"), m)[1]


@query("""SELECT l_orderkey AS article, CASE WHEN l_linenumber % 2 = 0 THEN 'ORG' ELSE 'ACTOR' END AS kind, arg_min(l_suppkey, (-l_discount, l_linenumber, l_suppkey)) AS entity FROM lineitem GROUP BY 1, 2""")
def best_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best scored entity of each article and kind (C-01)."""
    m = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("article"), F.when(F.col("l_linenumber") % 2 == 0, "ORG").otherwise("ACTOR").alias("kind"), F.col("l_linenumber").alias("mention"), F.col("l_suppkey").alias("entity"), F.col("l_discount").alias("score"))
    return desk.best_entities(m)


@query(r"""WITH p AS (SELECT p_partkey, list_distinct(list_filter(regexp_extract_all(lower(p_name), '[\p{L}\p{N}]+'), lambda t: length(t) >= 3)) AS a, list_distinct(list_filter(regexp_extract_all(lower(CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_type END), '[\p{L}\p{N}]+'), lambda t: length(t) >= 3)) AS b FROM part)
SELECT p_partkey, len(a) > 0 AND len(b) > 0 AND (list_has_all(a, b) OR list_has_all(b, a)) AS same FROM p""")
def name_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that count as the same if one's tokens all stand in the other (T-10)."""
    other = F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).otherwise(F.col("p_type"))
    return load(spark, sf_dir, "part").select("p_partkey", desk.names_match(F.col("p_name"), other, tokenize).alias("same"))


@query("""WITH x AS (SELECT o_orderkey AS article, 'Bank ' || (o_custkey % 5) AS a, CASE WHEN o_orderkey % 2 = 0 THEN 'Shop ' || (o_custkey % 3) || '; Bank ' || (o_custkey % 5) WHEN o_orderkey % 3 = 0 THEN 'unknown' END AS b FROM orders)
SELECT article, a || CASE WHEN b LIKE 'Shop%' THEN '|' || split_part(b, ';', 1) ELSE '' END AS names, CASE WHEN b LIKE 'Shop%' THEN 2 ELSE 1 END AS n FROM x""")
def organisation_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Organisations from two fields, once each in order (E-06, F-19, U-06)."""
    from casebook.functions.text import split_values

    k, c = F.col("o_orderkey"), F.col("o_custkey")
    bank = F.concat(F.lit("Bank "), (c % 5).cast("string"))
    other = F.when(k % 2 == 0, F.concat(F.lit("Shop "), (c % 3).cast("string"), F.lit("; "), bank)).when(k % 3 == 0, "unknown")
    names = F.array_distinct(F.concat(split_values(bank), split_values(other)))
    return load(spark, sf_dir, "orders").select(k.alias("article"), F.array_join(names, "|").alias("names"), F.size(names).alias("n"))


@query("""WITH d AS (SELECT l_orderkey AS incident, count(*) AS n FROM lineitem GROUP BY 1) SELECT o_orderkey AS incident, coalesce(n, 0) AS documents, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN 'kept' || o_orderkey END, substr(sha256(o_orderkey::VARCHAR), 1, 24)) AS uid,
o_orderkey % 4 = 0 OR n IS NOT NULL AS processed FROM orders LEFT JOIN d ON incident = o_orderkey""")
def repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts made anew, missing ids filled, markers of what is processed recovered from results (X-04 to X-07, J-21)."""
    from casebook.functions.ids import article_uid

    o, k = load(spark, sf_dir, "orders"), F.col("o_orderkey")
    counts = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("incident")).agg(F.count("*").alias("n"))
    marked = o.where("o_orderkey % 4 = 0").select(k.alias("incident"))
    lost = counts.select("incident").join(marked, "incident", "left_anti")
    processed = marked.union(lost).withColumn("processed", F.lit(True))
    met = o.select(k.alias("incident"), F.coalesce(F.when(k % 3 == 0, F.concat(F.lit("kept"), k.cast("string"))), article_uid(k.cast("string"))).alias("uid")).join(counts, "incident", "left").join(processed, "incident", "left")
    return met.select("incident", F.coalesce("n", F.lit(0)).alias("documents"), "uid", F.coalesce("processed", F.lit(False)).alias("processed"))


@query("""SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'old.png' WHEN page_id % 3 = 0 THEN 'new.png' END AS image, sha256(html) AS hash, page_id % 5 = 0 OR sha256(html) <> sha256(html || CASE WHEN page_id % 2 = 0 THEN 'x' ELSE '' END) AS changed FROM pages""")
def content_saves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetched contents saved by hash; a known image stays if it's there or the new one is null (X-15, X-17)."""
    k = F.col("page_id")
    old = load(spark, sf_dir, "pages").where("page_id % 5 <> 0").select("page_id", F.when(k % 4 == 0, "old.png").alias("image"), F.sha2(F.concat("html", F.when(k % 2 == 0, "x").otherwise("")), 256).alias("hash"))
    first = load(spark, sf_dir, "pages").where("page_id % 5 = 0").select("page_id", F.when(k % 4 == 0, "old.png").alias("kept"))
    new = load(spark, sf_dir, "pages").select("page_id", F.when(k % 3 == 0, "new.png").alias("fresh"), F.sha2("html", 256).alias("now"))
    met = new.join(old, "page_id", "left").join(first, "page_id", "left")
    return met.select("page_id", F.coalesce("image", "kept", "fresh").alias("image"), F.col("now").alias("hash"), (F.col("hash").isNull() | (F.col("hash") != F.col("now"))).alias("changed"))


@query("""WITH i AS (SELECT o_orderkey AS incident, o_orderkey % 3 = 0 AS has_image, o_orderdate AS last FROM orders), t AS (SELECT l_orderkey AS incident, l_linenumber % 2 = 0 AS tried FROM lineitem)
SELECT incident FROM i WHERE NOT has_image AND incident IN (SELECT incident FROM t WHERE NOT tried) ORDER BY last DESC, incident LIMIT 120""")
def image_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents without an image that have an article not tried yet, newest first (S-07); the budget is the feature."""
    untried = load(spark, sf_dir, "lineitem").where("l_linenumber % 2 <> 0").select(F.col("l_orderkey").alias("o_orderkey"))
    open_ = load(spark, sf_dir, "orders").where("o_orderkey % 3 <> 0").join(untried, "o_orderkey", "left_semi")
    return open_.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(120).select(F.col("o_orderkey").alias("incident"))


@query("""WITH s AS (SELECT 'orders' AS stage, o_orderstatus AS level, o_totalprice AS score FROM orders UNION ALL SELECT 'lines', l_returnflag, l_extendedprice FROM lineitem UNION ALL SELECT 'events', event_type, value FROM events)
SELECT stage, level, count(*) AS n, round(avg(score), 4) AS mean FROM s GROUP BY ALL""")
def stage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of all stages by level in one table (X-13, K-14)."""
    part = lambda name, level, score: load(spark, sf_dir, name).groupBy(F.lit(name if name != "lineitem" else "lines").alias("stage"), F.col(level).alias("level")).agg(F.count("*").alias("n"), F.round(F.avg(score), 4).alias("mean"))
    return part("orders", "o_orderstatus", "o_totalprice").union(part("lineitem", "l_returnflag", "l_extendedprice")).union(part("events", "event_type", "value"))


@query("SELECT event_id, user_id FROM events ORDER BY CASE WHEN event_id % 50 = 0 THEN 0 ELSE 1 END, CASE WHEN event_id % 50 <> 0 THEN ts END, event_id LIMIT 25")
def earliest_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earliest rows, undated ones first (X-14); the number is the feature."""
    dated = F.when(F.col("event_id") % 50 != 0, F.col("ts"))
    return load(spark, sf_dir, "events").orderBy(F.asc_nulls_first(dated), "event_id").limit(25).select("event_id", "user_id")


@query("""SELECT l_orderkey AS incident, CASE WHEN l_orderkey % 4 = 0 THEN round((l_orderkey % 90) / 100, 4) ELSE round(0.3 * least(1.0, greatest(0.0, (count(DISTINCT l_suppkey) - 1) / 4)) + 0.3 * CASE WHEN count(*) >= 2 THEN (l_orderkey % 10) / 10 ELSE 0.35 END
+ 0.2 * CASE WHEN l_orderkey % 3 = 0 THEN 0.8 ELSE 0 END + 0.1 * 0.5 + 0.1 * (l_orderkey % 5) / 5, 4) END AS score FROM lineitem GROUP BY l_orderkey""")
def fallback_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored trust where there is one, else an estimate from what the row has (X-28)."""
    from casebook.operators.trust import trust

    k = F.col("incident")
    rows = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("incident")).agg(F.count("*").alias("docs"), F.countDistinct("l_suppkey").alias("domains"))
    stored = rows.where("incident % 4 = 0").select("incident", F.round((k % 90) / 100, 4).alias("stored"))
    made = trust((k % 10) / 10, F.col("domains"), F.col("docs"), F.when(k % 3 == 0, 0.8).otherwise(0.0), F.lit(0.5), (k % 5) / 5)["score"]
    return rows.join(stored, "incident", "left").select("incident", F.coalesce("stored", made).alias("score"))


@query(r"""SELECT coalesce(problem, 'ok') AS problem, count(*) AS n FROM (SELECT CASE WHEN NOT regexp_full_match(c_name || CASE WHEN c_custkey % 9 = 0 THEN ' x' ELSE '' END, '[A-Za-z0-9#]{4,40}') THEN 'id' WHEN c_custkey % 5 = 4 THEN 'answer' WHEN c_custkey % 7 = 0 THEN 'correction' WHEN c_custkey % 20 > 12 THEN 'steps' END AS problem FROM customer) GROUP BY 1""")
def input_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submitted rows checked: form of the id, allowed answers, length of a correction, number of steps (X-32)."""
    k = F.col("c_custkey")
    rows = load(spark, sf_dir, "customer").select(F.concat("c_name", F.when(k % 9 == 0, " x").otherwise("")).alias("id"), F.get(F.array(*map(F.lit, ("agree", "disagree", "unsure", "agree", "maybe"))), (k % 5).cast("int")).alias("answer"),
                                                  F.repeat(F.lit("a"), F.when(k % 7 == 0, 121).otherwise(120)).alias("correction"), F.array_repeat(F.lit("s"), (k % 20).cast("int")).alias("steps"))
    problem = F.when(~F.col("id").rlike(r"^[A-Za-z0-9#]{4,40}$"), "id").when(~F.col("answer").isin("agree", "disagree", "unsure"), "answer").when(F.length("correction") > 120, "correction").when(F.size("steps") > 12, "steps")
    return rows.groupBy(F.coalesce(problem, F.lit("ok")).alias("problem")).agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT l_orderkey AS incident, l_linenumber AS line, l_partkey AS part, list_distinct(string_split(lower(p_name || ' ' || p_type), ' ')) AS w FROM lineitem JOIN part ON p_partkey = l_partkey),
a AS (SELECT incident, arg_min(w, (line, part)) AS x FROM t WHERE incident % 6 <> 0 GROUP BY 1) SELECT t.incident, line, CASE WHEN x IS NOT NULL THEN round(len(list_intersect(w, x)) / len(list_distinct(w || x)), 6) END AS likeness FROM t LEFT JOIN a USING (incident)""")
def anchor_likeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likeness of each member to its incident's anchor, null where the anchor is missing (X-03, C-07)."""
    from casebook.functions.text import jaccard

    lines, part = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "part")
    tokens = lines.join(part, F.col("p_partkey") == F.col("l_partkey")).select(F.col("l_orderkey").alias("incident"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), space_tokens(normalize_entity(F.concat_ws(" ", "p_name", "p_type"))).alias("w"))
    anchors = tokens.where("incident % 6 <> 0").groupBy("incident").agg(F.min_by("w", F.struct("line", "part")).alias("anchor"))
    return tokens.join(anchors, "incident", "left").select("incident", "line", F.round(F.when(F.col("anchor").isNotNull(), jaccard(F.col("w"), F.col("anchor"))), 6).alias("likeness"))


@query("""WITH l AS (SELECT c_custkey AS incident, ['D1', 'D2', 'D4'][o_orderkey % 3 + 1] AS flow, CASE WHEN o_orderkey % 8 = 0 THEN 'removed' ELSE o_orderstatus END AS status, o_orderkey AS k FROM orders JOIN customer ON c_custkey = o_custkey),
n AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY incident, flow ORDER BY k DESC) = 1) SELECT incident, max(status) FILTER (flow = 'D1') AS d1, max(status) FILTER (flow = 'D2') AS d2, max(status) FILTER (flow = 'D4') AS d4 FROM n WHERE status <> 'removed' GROUP BY incident""")
def flow_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest output of each flow side by side, removed ones left out (X-29, J-09)."""
    from casebook.operators.flows import REMOVED, latest

    k = F.col("o_orderkey")
    log = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("incident"), F.get(F.array(*map(F.lit, ("D1", "D2", "D4"))), (k % 3).cast("int")).alias("flow"), F.when(k % 8 == 0, REMOVED).otherwise(F.col("o_orderstatus")).alias("status"), k.alias("k"))
    now = latest(log, ["incident", "flow"], "k").where(F.col("status") != REMOVED)
    return now.groupBy("incident").agg(*[F.max(F.when(F.col("flow") == f, F.col("status"))).alias(f.lower()) for f in ("D1", "D2", "D4")])
