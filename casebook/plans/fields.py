"""Field functions, extraction, merges, feeds and keyed writes as queries over the given tables (F-*, T-*, S-*, C-10 to C-13, K-01, K-02)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.functions import dates, ids, text
from casebook.operators import cluster, extract, relevance, sync
from casebook.operators.trust import weighted_mean
from casebook.plans.base import load, query
from casebook.sources import tables


def _pick(key: Column, *values) -> Column:
    return F.get(F.array(*map(F.lit, values)), (key % len(values)).cast("int"))


@query("""WITH d AS (SELECT s_suppkey AS k, ['shop' || s_suppkey || '.co.id', 'Shop.com.co', 'tempo.co', 'x.io', 'news.ca', 'giornale.it', 'a.com', 'b.gov.uk', 'localhost', ''][s_suppkey % 10 + 1] AS domain FROM supplier)
SELECT k, domain, ['ID', 'CO', 'unknown', 'unknown', 'CA', 'IT', 'unknown', 'GB', 'unknown', 'unknown'][k % 10 + 1] AS country FROM d""")
def domain_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Countries of domains; country domains in general use count only below a registry's second level (F-13)."""
    k = F.col("s_suppkey")
    own = F.when(k % 10 == 0, F.concat(F.lit("shop"), k.cast("string"), F.lit(".co.id"))).otherwise(_pick(k, None, "Shop.com.co", "tempo.co", "x.io", "news.ca", "giornale.it", "a.com", "b.gov.uk", "localhost", ""))
    return load(spark, sf_dir, "supplier").select(k.alias("k"), own.alias("domain")).withColumn("country", text.country_of(F.col("domain")))


@query(r"""WITH w AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), ' ') AS w FROM documents), n AS (SELECT doc_id,
len(list_intersect(list_distinct(w), string_split('dan yang dari dengan untuk serangan siber keamanan peretas ini itu akan telah', ' '))) AS i, len(list_intersect(list_distinct(w), string_split('the and of with cyber security attack hackers this that from', ' '))) AS e FROM w)
SELECT doc_id, CASE WHEN i > e THEN 'id' WHEN e > i THEN 'en' ELSE 'unknown' END AS language, (CASE WHEN i = e THEN 0.3 ELSE 0.6 END)::DOUBLE AS confidence FROM n""")
def language_guesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text by common words (F-20, X-11)."""
    language, confidence = text.guess_language(F.col("text"))
    return load(spark, sf_dir, "documents").select("doc_id", language.alias("language"), confidence.alias("confidence"))


@query(r"""SELECT o_orderkey AS k, 'Bank breach ' || (o_orderkey % 5) AS title, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'Clerk ' || (o_orderkey % 9) END AS publisher, 'Clerks say so' AS summary,
'see now order ' || (o_orderkey % 7) || ' a_b' AS clean, CASE WHEN o_orderkey % 2 = 0 THEN 'red,Blue' ELSE 'red' END AS parts, CASE WHEN o_orderkey % 4 <> 0 THEN 'x' END AS known, substr(sha256('salt' || o_custkey), 1, 24) AS visitor FROM orders""")
def text_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publishers cut from headlines and summaries, cleaned texts, value lists, unknown values, salted hashes (F-06, F-07, F-10, F-19, F-26, P-07)."""
    k, s = F.col("o_orderkey"), lambda c: c.cast("string")
    end = F.when(k % 3 == 0, "").otherwise(F.concat(_pick(k, " - ", " | ", " – "), F.lit("Clerk "), s(k % 9)))
    rows = load(spark, sf_dir, "orders").withColumn("t", F.concat(F.lit("Bank breach "), s(k % 5), end))
    publisher = text.publisher_of(F.col("t"))
    said = F.when(publisher == "", "Clerks say so").otherwise(F.concat(F.lit("Clerks say so - "), publisher))
    raw = F.concat(F.lit("See https://a.b/c?d=1  NOW: www.x.y order #"), s(k % 7), F.lit("! a_b"))
    return rows.select(k.alias("k"), text.without_publisher(F.col("t")).alias("title"), publisher.alias("publisher"), text.remove_publisher(said, publisher).alias("summary"), text.clean_text(raw).alias("clean"),
                       F.array_join(text.split_values(F.when(k % 2 == 0, "red, Blue ;N/A|red").otherwise(" red;-")), ",").alias("parts"), text.unknown_to_null(_pick(k, " N/A ", "x", "x", "x")).alias("known"), ids.salted_hash("salt", s(F.col("o_custkey"))).alias("visitor"))


@query("""SELECT o_orderkey AS k, o_orderdate AS iso, o_orderdate::DATE::VARCHAR AS mail_day, floor((epoch(o_orderdate) - epoch(TIMESTAMP '1995-06-15 12:00:00')) / 86400)::BIGINT AS gap, abs(epoch(o_orderdate) - epoch(TIMESTAMP '1995-06-15 12:00:00')) / 3600 AS hours,
round(greatest(0.0, 1 - abs(epoch(o_orderdate) - epoch(o_orderdate + to_hours((o_orderkey % 400)::BIGINT))) / 86400 / 14), 6) AS likeness, (CASE o_orderkey % 3 WHEN 0 THEN o_orderdate::DATE WHEN 1 THEN make_date(2024, 2, 25) END)::VARCHAR AS attack FROM orders""")
def date_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates parsed, compared and found in texts (F-27 to F-31, F-35)."""
    k, d = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    iso = F.when(k % 2 == 0, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format(d, "yyyy-MM-dd HH:mm:ss"))
    then = F.lit("1995-06-15 12:00:00").cast("timestamp")
    later = F.timestamp_seconds(F.unix_timestamp(d) + (k % 400) * 3600)
    said = F.when(k % 3 == 0, F.concat(F.lit("on 2024-13-40, then "), F.date_format(d, "yyyy-M-d"))).when(k % 3 == 1, "hit 2/25/2024 and 1/1/2024").otherwise("no day")
    return load(spark, sf_dir, "orders").select(k.alias("k"), dates.parse_iso(iso).cast("timestamp_ntz").alias("iso"), F.to_date(dates.parse_rfc2822(F.date_format(d, "EEE, d MMM yyyy HH:mm:ss Z"))).cast("string").alias("mail_day"),
                                                dates.day_gap(d, then).alias("gap"), dates.hours_between(d, then).cast("double").alias("hours"), F.round(dates.date_similarity(d, later), 6).alias("likeness"), dates.attack_date(said).cast("string").alias("attack"))


@query("""SELECT o_orderkey AS k, 'CVE-2024-' || (1000 + o_orderkey % 500) || ',' || md5(o_orderkey::VARCHAR) || CASE WHEN o_orderkey % 2 = 0 THEN ',' || sha256(o_orderkey::VARCHAR) ELSE '' END AS found FROM orders""")
def indicator_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vulnerability numbers and file hashes found in texts, in order, once each (F-44)."""
    k = F.col("o_orderkey").cast("string")
    said = F.concat(F.upper(F.md5(k)), F.lit(" cve-2024-"), (1000 + F.col("o_orderkey") % 500).cast("string"), F.lit(" CVE-2024-"), (1000 + F.col("o_orderkey") % 500).cast("string"), F.lit(" zz"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(" "), F.sha2(k, 256))).otherwise(""), F.lit(" abc123"))
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.array_join(text.indicators(said), ",").alias("found"))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'http://a/og.png' WHEN 1 THEN 'http://a/u.png?x=1&y=2' WHEN 2 THEN 'http://a/tw.png' END AS image FROM pages""")
def page_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preview images of pages by key, in order of precedence (F-45)."""
    tag = {0: '<meta name="twitter:image" content="http://a/tw.png"><meta property="og:image" content="http://a/og.png">', 1: "<meta name='twitter:image' content='http://a/tw.png'><META property='og:image:url' content='http://a/u.png?x=1&amp;y=2'>", 2: '<meta name="twitter:image" content="http://a/tw.png">'}
    k = F.col("page_id")
    extra = F.when(k % 4 == 0, tag[0]).when(k % 4 == 1, tag[1]).when(k % 4 == 2, tag[2]).otherwise("")
    return load(spark, sf_dir, "pages").select("page_id", text.og_image(F.concat(F.lit("<head>"), extra, F.lit("</head>"), "html")).alias("image"))


@query("""WITH p AS (SELECT p_partkey AS k, lower(p_name) AS a, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN lower(p_name) ELSE split_part(lower(p_name), ' ', 1) || ' other' END AS b FROM part),
f AS (SELECT k, CASE WHEN b IS NULL THEN NULL WHEN a = b THEN 1.0 ELSE len(list_intersect(string_split(a, ' '), string_split(b, ' '))) / len(list_distinct(string_split(a, ' ') || string_split(b, ' '))) END AS f FROM p)
SELECT k, round(f, 6) AS likeness, round(CASE WHEN f IS NULL THEN 0.5 ELSE (f * 0.3 + 0.5 * 0.1) / 0.4 END, 6) AS mean FROM f""")
def field_likeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likeness of fields, unknown ones left out of the weighted mean (X-01, X-02, F-17, F-39, F-40)."""
    k = F.col("p_partkey")
    other = F.when(k % 4 == 0, " N/A").when(k % 4 == 1, F.concat(F.lit(" "), F.upper("p_name"))).otherwise(F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(" other")))
    like = text.field_similarity(F.col("p_name"), other)
    return load(spark, sf_dir, "part").select(k.alias("k"), F.round(like, 6).alias("likeness"), F.round(weighted_mean([(like, 0.3), (F.lit(None).cast("double"), 0.6), (F.lit(0.5), 0.1)]), 6).alias("mean"))


@query("""SELECT p_partkey AS k, CASE WHEN regexp_matches(p_name, '(^| )ring( |$)') AND regexp_matches(p_name, '(^| )old( |$)') THEN 'jewels, age' WHEN regexp_matches(p_name, '(^| )ring( |$)') THEN 'jewels' WHEN regexp_matches(p_name, '(^| )old( |$)') THEN 'age' ELSE 'UNKNOWN' END AS category,
CASE WHEN regexp_matches(p_name, '(^| )ring( |$)') THEN 'jewels' WHEN regexp_matches(p_name, '(^| )bolt( |$)') AND regexp_matches(p_name, '(^| )hot( |$)') THEN 'heat' WHEN regexp_matches(p_name, '(^| )bolt( |$)') THEN 'thing' WHEN regexp_matches(p_name, '(^| )hot( |$)') THEN 'heat' ELSE 'UNKNOWN' END AS kind FROM part""")
def part_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories by dictionary, and kinds with a fallback whose generic one counts only alone (T-02, T-03)."""
    name = text.normalize_text(F.col("p_name"))
    kind = relevance.attack_types(name, {"jewels": ["ring"]}, {"thing": ["bolt"], "heat": ["hot"]}, "thing")
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), relevance.categories(name, {"jewels": ["ring"], "age": ["old"]}).alias("category"), kind.alias("kind"))


@query("""SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'Acme Bank' WHEN 1 THEN 'North Hospital' WHEN 2 THEN 'Delta Air' END AS organisation, (CASE o_orderkey % 4 WHEN 0 THEN 0.9 WHEN 1 THEN 0.8 WHEN 2 THEN 0.6 END)::DOUBLE AS confidence,
CASE WHEN o_orderkey % 2 = 0 THEN 'Night Fox|Red Door' ELSE '' END AS actors, round((CASE WHEN o_orderkey % 4 < 3 THEN 1 ELSE 0 END + 1) / 3, 6) AS known, CASE WHEN o_orderkey % 3 = 0 THEN 'Later' ELSE 'First' END AS filled FROM orders""")
def extraction_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Organisations and actors from headline, summary and body in tiers, with confidences and filled gaps (T-05 to T-09)."""
    k = F.col("o_orderkey")
    title = F.when(k % 4 == 0, "Acme Bank confirms breach").otherwise("News of the day")
    summary = F.when(k % 4 == 1, "Hackers hit North Hospital on Monday.").otherwise("Nothing new")
    body = F.when(k % 4 == 2, "An attack on Delta Air stopped flights.").otherwise("none")
    who = F.when(k % 2 == 0, "It was claimed by Night Fox and later attributed to Red Door, then claimed by NIGHT FOX.").otherwise("nobody knows")
    found = extract.tiered(title, summary, body, lambda t: extract.name_in(t, extract.ORGANISATION))
    rows = load(spark, sf_dir, "orders").select(k.alias("k"), found.alias("o"), F.array_join(extract.names_in(who, extract.ACTOR[1:]), "|").alias("actors"), F.when(k % 3 == 0, "UNKNOWN").otherwise("First").alias("old"))
    return rows.select("k", F.col("o.value").alias("organisation"), F.col("o.confidence").alias("confidence"), "actors", F.round(extract.extraction_confidence(F.col("o.value"), F.lit("x"), F.lit("UNKNOWN")), 6).alias("known"), extract.fill_unknown(F.col("old"), F.lit("Later")).alias("filled"))


@query("""WITH RECURSIVE i AS (SELECT o_orderkey AS id, epoch(o_orderdate)::BIGINT // 86400 AS d, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'T' || (o_orderkey % 5) END AS target, o_orderkey % 4 + 1 AS n FROM orders),
p AS (SELECT id AS a, id + 4 AS b FROM i WHERE (id % 10) / 10 >= 0.7 AND id + 4 IN (SELECT id FROM i)), e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r AS (SELECT a AS id, a AS c FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.c), c AS (SELECT id, min(c) AS c FROM r GROUP BY id),
h AS (SELECT c, arg_min(id, (d, id)) AS head FROM c JOIN i USING (id) GROUP BY c), m AS (SELECT i.*, coalesce(head, i.id) AS head FROM i LEFT JOIN c ON c.id = i.id LEFT JOIN h ON h.c = c.c)
SELECT head AS id, min(d) AS first_day, max(d) AS last_day, sum(n)::BIGINT AS documents, arg_min(target, (id <> head, d, id)) FILTER (target IS NOT NULL) AS target FROM m GROUP BY head""")
def judged_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents merged by confident judgements: the earliest heads its group, counts add up, the first known target stays (C-10 to C-12)."""
    k, day = F.col("o_orderkey"), F.unix_date(F.to_date("o_orderdate")).cast("long")
    o = load(spark, sf_dir, "orders")
    rows = o.select(k.alias("id"), day.alias("first_day"), day.alias("last_day"), F.when(k % 3 != 0, F.concat(F.lit("T"), (k % 5).cast("string"))).alias("target"), F.lit("").alias("family"), (k % 4 + 1).alias("documents"))
    pairs = o.select(k.alias("a"), (k + 4).alias("b"), ((k % 10) / 10).alias("confidence"))
    return cluster.merged(rows, cluster.merge_judged(rows, pairs, 0.7)).select("id", "first_day", "last_day", "documents", "target")


@query(r"""WITH t AS (SELECT l_orderkey AS incident, l_linenumber AS id, list_distinct(string_split(lower(p_name), ' ')) AS w FROM lineitem JOIN part ON p_partkey = l_partkey QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey) = 1),
a AS (SELECT incident, arg_min(w, id) AS x FROM t GROUP BY 1), j AS (SELECT t.incident, t.id, w, len(list_intersect(w, x)) / len(list_distinct(w || x)) AS j FROM t JOIN a USING (incident))
SELECT incident, id, round(j, 6) AS likeness FROM j WHERE j < 0.08 AND NOT list_contains(w, 'old')""")
def cluster_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of incidents that share too little with their anchor and lack the target's words (C-13)."""
    lines, part = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "part")
    members = lines.join(part, F.col("p_partkey") == F.col("l_partkey")).groupBy(F.col("l_orderkey").alias("incident"), F.col("l_linenumber").alias("id")).agg(F.min_by("p_name", "l_partkey").alias("p_name"))
    rows = members.select("incident", "id", text.space_tokens(F.col("p_name")).alias("tokens"), F.array(F.lit("old")).alias("target_tokens"))
    return cluster.cluster_outliers(rows).select("incident", "id", F.round("likeness", 6).alias("likeness"))


@query("""WITH k AS (SELECT n_name AS keyword, CASE WHEN n_nationkey % 4 = 0 THEN 'site:' || n_name || '.com' ELSE '"' || n_name || '"' END AS q FROM nation), l AS (SELECT unnest(['en', 'id']) AS language),
p AS (SELECT DATE '2024-01-01' + 30 * i::INT AS start FROM range(0, 4) t(i) WHERE DATE '2024-01-01' + 30 * (i + 1)::INT <= DATE '2024-05-05')
SELECT keyword, language, start::VARCHAR AS start, 'https://feed.example/search?q=' || replace(url_encode(q || ' after:' || start || ' before:' || (start + 30)), '%20', '+') || CASE language WHEN 'en' THEN '&hl=en-US&gl=US&ceid=US:en' ELSE '&hl=id&gl=ID&ceid=ID:id' END AS url FROM k, l, p""")
def search_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed addresses for every keyword, language and full period (S-01, S-03, S-04)."""
    words = load(spark, sf_dir, "nation").select(F.when(F.col("n_nationkey") % 4 == 0, F.concat(F.lit("site:"), "n_name", F.lit(".com"))).otherwise(F.col("n_name")).alias("word"), F.col("n_name").alias("keyword"))
    spans = tables.periods(spark, "2024-01-01", "2024-05-05").withColumn("j", F.lit(1))
    rows = tables.tasks(words, ["en", "id"]).withColumn("j", F.lit(1)).join(spans, "j")
    url = tables.search_url(F.col("word"), F.col("language"), F.col("start"), F.col("end"), {"en": ("en-US", "US", "US:en"), "id": ("id", "ID", "ID:id")}, "https://feed.example/search")
    return rows.select("keyword", "language", F.col("start").cast("string").alias("start"), url.alias("url"))


@query("""WITH r AS (SELECT o_orderkey AS id, o_orderdate AS published, CASE WHEN o_orderkey % 4 = 0 THEN 'timeout' WHEN o_orderkey % 4 = 1 THEN 'blocked' WHEN o_orderkey % 4 = 2 THEN 'empty' ELSE 'ok' END AS status FROM orders) SELECT status, count(*) AS n, max(CASE status WHEN 'ok' THEN 300 END) AS longest FROM r GROUP BY status""")
def fetch_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What fetched pages count as (S-05)."""
    k = F.col("o_orderkey")
    body = F.when(k % 4 == 1, "Please ENABLE JavaScript").when(k % 4 == 2, "   short ").otherwise(F.repeat(F.lit("word "), F.lit(100)))
    s = tables.fetch_status(body, F.when(k % 4 == 0, "timeout"), longest=300)
    return load(spark, sf_dir, "orders").select(s.alias("s")).groupBy("s.status").agg(F.count("*").alias("n"), F.max(F.length("s.text")).alias("longest"))


@query("""WITH r AS (SELECT o_orderkey AS id, o_orderdate AS published, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'error' WHEN 2 THEN 'unresolved' ELSE 'ok' END AS status, o_orderdate + to_days((o_orderkey % 20)::INT) AS tried FROM orders), n AS (SELECT max(o_orderdate) AS now FROM orders)
SELECT id FROM r, n WHERE status IS NULL OR (status IN ('error', 'unresolved') AND tried < now - INTERVAL 7 DAY) ORDER BY status IS NOT NULL, published DESC, id LIMIT 300""")
def fetch_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next pages to fetch within a budget, untried ones first (S-06); the budget is the feature."""
    o, k = load(spark, sf_dir, "orders"), F.col("o_orderkey")
    now = o.agg(F.max("o_orderdate").alias("now")).first()["now"]
    status = _pick(k, None, "error", "unresolved", "ok", "ok")
    tried = F.when(status.isNotNull(), F.col("o_orderdate") + F.make_dt_interval((k % 20).cast("int")))
    return tables.fetch_queue(o.select(k.alias("id"), F.col("o_orderdate").alias("published"), status.alias("status"), tried.alias("tried_at")), F.lit(now).cast("timestamp_ntz"), 300).select("id")


@query("""WITH s AS (SELECT o_orderkey AS line, CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE 's' || (o_orderkey // 2) END AS id, CASE WHEN o_orderkey % 12 = 5 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 14 = 3 THEN 1 ELSE 0 END AS bad FROM orders),
n AS (SELECT *, sum((bad = 0)::INT) OVER (PARTITION BY id ORDER BY line) AS nth FROM s) SELECT CASE WHEN bad = 0 AND nth > 1 THEN 'repeated' WHEN bad = 0 THEN 'valid' ELSE bad || ' errors' END AS outcome, count(*) AS n FROM n GROUP BY 1""")
def statement_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements with their errors; an id that an earlier valid row has is one (S-08)."""
    k = F.col("o_orderkey")
    rows = load(spark, sf_dir, "orders").select(k.alias("line"), F.when(k % 10 == 0, " ").otherwise(F.concat(F.lit("s"), F.floor(k / 2).cast("string"))).alias("statement_id"), F.lit("i").alias("incident_id"), F.when(k % 12 == 5, "odd").otherwise("confirmed").alias("status"),
                                                F.when(k % 14 == 3, "ftp://x").otherwise("https://x").alias("source_url"), F.lit("2024-01-31").alias("date"))
    checked = tables.checked_statements(rows, ("confirmed", "refuted"))
    n = F.size("errors")
    outcome = F.when(n == 0, "valid").when(F.array_contains("errors", "statement_id is repeated"), "repeated").otherwise(F.concat(n.cast("string"), F.lit(" errors")))
    return checked.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("""SELECT c_custkey::VARCHAR AS incident_id, c_mktsegment AS attack_type, NULL::VARCHAR AS target, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey::BIGINT END AS first_day, NULL::BIGINT AS document_count FROM customer""")
def evolved_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an older table in today's schema: missing columns null, others dropped, values that don't fit null (S-10, X-08, X-19)."""
    old = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("Incident_ID"), F.col("c_mktsegment").alias("attack_type"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey").cast("string")).otherwise("soon").alias("first_day"), F.lit(1).alias("dropped"))
    now = tables.conform(old, tables.schema("incidents"))
    if now.schema != tables.schema("incidents"):
        raise ValueError("the schemas differ")
    return now.select("incident_id", "attack_type", "target", "first_day", "document_count")


@query("""WITH t AS (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_orderkey % 3 <> 0), r AS (SELECT o_orderkey AS k, 'N' AS s FROM orders WHERE o_orderkey % 2 = 0)
SELECT 'ignore' AS mode, k, coalesce(t.s, r.s) AS s FROM t FULL JOIN r USING (k) UNION ALL SELECT 'replace', k, coalesce(r.s, t.s) FROM t FULL JOIN r USING (k)""")
def keyed_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserts that ignore or replace known keys (K-01, K-02)."""
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))
    table, rows = o.where("k % 3 <> 0"), o.where("k % 2 = 0").withColumn("s", F.lit("N"))
    return sync.insert_or_ignore(table, rows, ["k"]).select(F.lit("ignore").alias("mode"), "k", "s").unionByName(sync.insert_or_replace(table, rows, ["k"]).select(F.lit("replace").alias("mode"), "k", "s"))
