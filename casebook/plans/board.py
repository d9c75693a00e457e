"""Named dashboard and evaluation queries over the star schema: orders as incidents, their lines as articles, customers as cards, labels as judgements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casebook.operators import metrics
from casebook.operators.flows import prf
from casebook.plans.base import load, query


def _top(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each key; n is the feature."""
    return df.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("k") <= n).drop("k")


@query("SELECT event_type AS stage, arg_max(event_id, (ts, event_id)) AS run, max(ts) AS finished, count(*) AS runs FROM events WHERE user_id % 3 <> 0 GROUP BY 1")
def last_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest finished run of each stage in the run log (K-14, X-21)."""
    return load(spark, sf_dir, "events").where("user_id % 3 <> 0").groupBy(F.col("event_type").alias("stage")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("run"), F.max("ts").alias("finished"), F.count("*").alias("runs"))


@query("""WITH d AS (SELECT l_orderkey AS incident, count(*) AS documents, count(DISTINCT l_suppkey) AS publishers FROM lineitem GROUP BY 1)
SELECT incident, documents, publishers FROM (SELECT d.*, o_orderdate FROM d JOIN orders ON o_orderkey = incident WHERE documents >= 3 ORDER BY o_orderdate DESC, incident LIMIT 40) ORDER BY publishers DESC, documents DESC, incident LIMIT 1""")
def featured_incident(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest forty incidents of several documents, and of them the one with most publishers (O-05); both numbers are the feature."""
    d = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("incident")).agg(F.count("*").alias("documents"), F.countDistinct("l_suppkey").alias("publishers")).where("documents >= 3")
    pool = d.join(load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("incident"), "o_orderdate"), "incident").orderBy(F.desc("o_orderdate"), "incident").limit(40)
    return pool.orderBy(F.desc("publishers"), F.desc("documents"), "incident").limit(1).select("incident", "documents", "publishers")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, s_name, n_name, o_orderstatus FROM lineitem JOIN orders ON o_orderkey = l_orderkey LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN nation ON n_nationkey = s_nationkey
WHERE l_returnflag <> 'A' ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, l_partkey LIMIT 60""")
def news_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest articles with their incident, source and country (J-01, J-02); the rows are cut down before they are joined."""
    lines = load(spark, sf_dir, "lineitem").where("l_returnflag <> 'A'").join(load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus"), "l_orderkey")
    newest = lines.orderBy(F.desc("l_shipdate"), "l_orderkey", "l_linenumber", "l_partkey").limit(60)
    s = load(spark, sf_dir, "supplier").join(load(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"), "left").select(F.col("s_suppkey").alias("l_suppkey"), "s_name", "n_name")
    return newest.join(s, "l_suppkey", "left").select("l_orderkey", "l_linenumber", "l_partkey", "s_name", "n_name", "o_orderstatus")


@query("""WITH r AS (SELECT l_orderkey AS incident, count(*) FILTER (l_discount > 0.05) AS duplicates, count(*) FILTER (l_discount <= 0.05) AS others, count(DISTINCT l_suppkey) AS sources, min(l_shipdate) AS first_seen FROM lineitem GROUP BY 1)
SELECT o_orderkey AS incident, o_orderstatus AS status, coalesce(duplicates, 0) AS duplicates, coalesce(others, 0) AS others, coalesce(sources, 0) AS sources, first_seen, c_mktsegment AS card FROM orders LEFT JOIN r ON incident = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey""")
def incident_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents with the counts of their relations, sources, first report and card (J-02, A-05)."""
    r = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("incident")).agg(F.count_if(F.col("l_discount") > 0.05).alias("duplicates"), F.count_if(F.col("l_discount") <= 0.05).alias("others"), F.countDistinct("l_suppkey").alias("sources"), F.min("l_shipdate").alias("first_seen"))
    o, c = load(spark, sf_dir, "orders"), load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("card"))
    zero = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    return o.select(F.col("o_orderkey").alias("incident"), F.col("o_orderstatus").alias("status"), "o_custkey").join(r, "incident", "left").join(c, "o_custkey", "left").select("incident", "status", zero("duplicates"), zero("others"), zero("sources"), "first_seen", "card")


@query("""SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, l_discount FROM lineitem WHERE l_quantity > 10 QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY l_discount DESC, l_orderkey, l_linenumber, l_partkey) <= 3""")
def sample_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best rows of evidence of each kind (O-04); the number is the feature."""
    rows = load(spark, sf_dir, "lineitem").where("l_quantity > 10").select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_discount")
    return _top(rows, ["l_returnflag"], [F.desc("l_discount"), "l_orderkey", "l_linenumber", "l_partkey"], 3)


@query("""SELECT o_orderstatus AS section, o_orderkey AS incident FROM orders WHERE o_totalprice > 50000 QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate DESC, o_orderkey) <= 24""")
def alerts_by_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 24 alerts of each section (O-04); the number is the feature."""
    rows = load(spark, sf_dir, "orders").where("o_totalprice > 50000").select(F.col("o_orderstatus").alias("section"), F.col("o_orderkey").alias("incident"), "o_orderdate")
    return _top(rows, ["section"], [F.desc("o_orderdate"), "incident"], 24).select("section", "incident")


@query("""SELECT o_orderkey AS incident, o_totalprice AS score, n_name AS country FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderstatus <> 'P' ORDER BY o_orderdate DESC, o_orderkey LIMIT 400""")
def recent_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest four hundred cases with their country (O-02); the number is the feature."""
    newest = load(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").join(load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(400)
    return newest.join(load(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("o_orderkey").alias("incident"), F.col("o_totalprice").alias("score"), F.col("n_name").alias("country"))


@query("""WITH n AS (SELECT max(o_orderdate) AS now FROM orders) SELECT o_orderkey AS incident, c_mktsegment AS segment, count(*) OVER (PARTITION BY c_mktsegment) AS in_segment FROM orders JOIN customer ON c_custkey = o_custkey, n WHERE o_orderdate >= now - INTERVAL 90 DAY""")
def literacy_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases of the last ninety days of the data with their segment and its size (P-11); segments are counted before they are joined back."""
    o = load(spark, sf_dir, "orders")
    now = o.agg(F.max("o_orderdate").alias("now")).first()["now"]
    near = o.where(F.col("o_orderdate") >= F.lit(now).cast("timestamp_ntz") - F.expr("interval 90 days"))
    rows = near.join(load(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).select(F.col("o_orderkey").alias("incident"), F.col("c_mktsegment").alias("segment"))
    return rows.join(rows.groupBy("segment").agg(F.count("*").alias("in_segment")), "segment").select("incident", "segment", "in_segment")


@query("""WITH a AS (SELECT o_custkey AS incident, o_orderkey % 4 + 1 AS flow, o_orderpriority AS advice, o_orderkey AS k FROM orders WHERE o_orderkey % 4 <> 1), f AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY incident ORDER BY flow DESC, k DESC) = 1),
s AS (SELECT 'cards' AS kind, count(*) AS n FROM customer UNION ALL SELECT 'advice', count(*) FROM a UNION ALL SELECT 'regions', count(DISTINCT c_nationkey) FROM customer)
SELECT 'advice' AS kind, incident, 'D' || flow AS flow, advice FROM f UNION ALL SELECT kind, n, NULL, NULL FROM s""")
def advice_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advice of each incident from its most official flow, and counts of what there is (A-08, L-11)."""
    k = F.col("o_orderkey")
    a = load(spark, sf_dir, "orders").where("o_orderkey % 4 <> 1").select(F.col("o_custkey").alias("incident"), (k % 4 + 1).alias("flow"), F.col("o_orderpriority").alias("advice"), k.alias("k"))
    best = a.groupBy("incident").agg(F.max_by(F.struct("flow", "advice"), F.struct("flow", "k")).alias("b"))
    c = load(spark, sf_dir, "customer")
    none = F.lit(None).cast("string")
    count = lambda df, kind, n: df.agg(n.alias("incident")).select(F.lit(kind).alias("kind"), "incident", none.alias("flow"), none.alias("advice"))
    rows = best.select(F.lit("advice").alias("kind"), "incident", F.concat(F.lit("D"), F.col("b.flow").cast("string")).alias("flow"), "b.advice")
    return rows.unionByName(count(c, "cards", F.count("*"))).unionByName(count(a, "advice", F.count("*"))).unionByName(count(c, "regions", F.countDistinct("c_nationkey")))


@query("""SELECT p_partkey AS k, 'Sum ' || p_partkey AS summary, CASE WHEN p_partkey % 2 = 0 THEN 'a|b|c' ELSE 'a' END AS steps, CASE WHEN p_partkey % 3 = 0 THEN 'users' ELSE '' END AS targets FROM part""")
def cleaned_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers brought to a fixed form: other spellings of keys, single values as lists, blanks dropped, lists cut to their limits (Y-03, S-14)."""
    k = F.col("p_partkey")
    raw = F.concat(F.lit('{"'), F.when(k % 5 == 0, "ringkasan").otherwise("summary"), F.lit('":" Sum '), k.cast("string"), F.lit(' ","steps":'), F.when(k % 2 == 0, '["a"," ","b","c ","d"]').otherwise('"a"'), F.lit(',"targets":'), F.when(k % 3 == 0, '[{"group":" users "},{"group":""}]').otherwise('"none"'), F.lit("}"))
    get = lambda path: F.get_json_object("raw", path)
    listed = F.coalesce(F.from_json(get("$.steps"), "array<string>"), F.array(get("$.steps")))
    steps = F.slice(F.filter(F.transform(listed, lambda s: F.btrim(s)), lambda s: s != ""), 1, 3)
    groups = F.coalesce(F.from_json(get("$.targets"), "array<struct<group:string>>"), F.array().cast("array<struct<group:string>>"))
    targets = F.filter(F.transform(groups, lambda g: F.btrim(g["group"])), lambda g: F.coalesce(g, F.lit("")) != "")
    return load(spark, sf_dir, "part").select(k.alias("k"), raw.alias("raw")).select("k", F.btrim(F.coalesce(get("$.summary"), get("$.ringkasan"), F.lit(""))).alias("summary"), F.array_join(steps, "|").alias("steps"), F.array_join(targets, "|").alias("targets"))


@query("""WITH m AS (SELECT o_orderkey AS id, o_orderkey - o_orderkey % 5 AS head FROM orders WHERE o_orderkey % 5 < 2), t AS (SELECT DISTINCT unnest([id, head]) AS incident FROM m WHERE id <> head)
SELECT l_orderkey AS incident, count(*) AS kept FROM lineitem WHERE l_orderkey NOT IN (SELECT incident FROM t) GROUP BY 1""")
def kept_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence that stays after merges: that of both sides of a merge is made anew, an incident that merely gained an article keeps its own (G-S7, C-10)."""
    k = F.col("o_orderkey")
    mapping = load(spark, sf_dir, "orders").where("o_orderkey % 5 < 2").select(k.alias("id"), (k - k % 5).alias("head")).where("id <> head")
    touched = mapping.select(F.explode(F.array("id", "head")).alias("incident")).distinct()
    return load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("incident")).join(touched, "incident", "left_anti").groupBy("incident").agg(F.count("*").alias("kept"))


@query("""WITH j AS (SELECT doc_id, quality = 1 AS truth, doc_id % 3 <> 0 AS rules, doc_id % 4 <> 0 AS model, lang FROM labels JOIN documents USING (doc_id)),
s AS (SELECT lang, 'rules' AS judge, count(*) FILTER (rules AND truth) AS tp, count(*) FILTER (rules AND NOT truth) AS fp, count(*) FILTER (NOT rules AND truth) AS fn FROM j GROUP BY lang UNION ALL
SELECT lang, 'model', count(*) FILTER (model AND truth), count(*) FILTER (model AND NOT truth), count(*) FILTER (NOT model AND truth) FROM j GROUP BY lang)
SELECT lang, judge, tp, fp, fn, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) END AS recall FROM s""")
def label_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and a model scored against labels by language (A-23, the evaluation's label scoring and model against rules)."""
    d = load(spark, sf_dir, "documents").select("doc_id", "lang")
    rows = load(spark, sf_dir, "labels").join(d, "doc_id").select("lang", (F.col("quality") == 1).alias("truth"), F.explode(F.create_map(F.lit("rules"), F.col("doc_id") % 3 != 0, F.lit("model"), F.col("doc_id") % 4 != 0)).alias("judge", "said"))
    n = lambda c: F.count_if(c)
    sums = rows.groupBy("lang", "judge").agg(n(F.col("said") & F.col("truth")).alias("tp"), n(F.col("said") & ~F.col("truth")).alias("fp"), n(~F.col("said") & F.col("truth")).alias("fn"))
    return sums.withColumn("m", prf(F.col("tp"), F.col("fp"), F.col("fn"))).select("lang", "judge", "tp", "fp", "fn", F.round("m.precision", 6).alias("precision"), F.round("m.recall", 6).alias("recall"))


@query("""WITH c AS (SELECT o_orderstatus AS flow, count(*) AS n, median(o_totalprice) AS v FROM orders GROUP BY 1) SELECT '| ' || flow || ' | ' || n || ' | ' || (round(v, 2)::DECIMAL(20,2))::VARCHAR || ' |' AS line FROM c UNION ALL SELECT '| flow | n | value |' UNION ALL SELECT '|-|-|-|'""")
def metric_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a report table of a measure by flow (K-16, A-21)."""
    c = load(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("flow")).agg(F.count("*").alias("n"), F.median("o_totalprice").alias("v"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", "flow", F.col("n").cast("string"), F.round("v", 2).cast("decimal(20,2)").cast("string")), F.lit(" |"))
    head = spark.range(2).select(F.when(F.col("id") == 0, "| flow | n | value |").otherwise("|-|-|-|").alias("line"))
    return c.select(line.alias("line")).unionByName(head)


@query("""WITH l AS (SELECT o_custkey AS incident, 'D' || (o_orderkey % 4 + 1) AS flow, ['high', 'confirmed', 'refuted', 'low', 'agree'][o_orderkey % 5 + 1] AS status, ['true', 'hoax', 'odd'][o_orderkey % 3 + 1] AS basis FROM orders)
SELECT flow, CASE WHEN flow = 'D2' THEN CASE WHEN basis = 'odd' THEN 'undecided' ELSE basis END WHEN status IN ('high', 'confirmed') THEN 'true' WHEN status = 'refuted' THEN 'hoax' ELSE 'undecided' END AS verdict, count(*) AS n FROM l GROUP BY 1, 2""")
def verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each flow's outputs conclude (L-13)."""
    k = F.col("o_orderkey")
    pick = lambda *v: F.get(F.array(*map(F.lit, v)), (k % len(v)).cast("int"))
    flow = F.concat(F.lit("D"), (k % 4 + 1).cast("string"))
    rows = load(spark, sf_dir, "orders").select(flow.alias("flow"), metrics.verdict(flow, pick("high", "confirmed", "refuted", "low", "agree"), pick("true", "hoax", "odd")).alias("verdict"))
    return rows.groupBy("flow", "verdict").agg(F.count("*").alias("n"))
