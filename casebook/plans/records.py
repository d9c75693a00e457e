"""Cards, official statements and records, and the comparison of the flows, over customers as incidents and orders as their reports (L-*, A-21 to A-25)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.functions.storage import materialize
from casebook.operators import metrics, records
from casebook.operators.trust import level
from casebook.plans.base import load, query

GUIDE = records.Guide(
    steps_by_type={"phishing": 2, "malware": 1, "ransomware": 2, "scam": 2, "cyber": 2}, groups=["STUDENTS", "ELDERLY"], default_type="cyber", alias={"investment_scam": "scam"},
    channels={"bank": (["ELDERLY"], ["investment_scam"]), "content": ([], ["phishing"])}, audiences=["school"],
    audience_by_group={"STUDENTS": ["students", "parents", "teachers"], "ELDERLY": ["elderly"]}, audience_by_type={"phishing": ["users"], "scam": ["investors", "users"]},
    topics_by_group={"ELDERLY": ["calls"]}, topics_by_type={"phishing": ["links", "mail"], "cyber": ["basics", "updates"]}, topics_by_platform={"chat": ["privacy", "links", "groups"]}, hoax_topics=["check", "report"])
_KINDS = ("phishing, malware", " Ransomware", "UNKNOWN", "", "investment_scam,phishing")


def _pick(key: Column, values: tuple) -> Column:
    return F.get(F.array(*map(F.lit, values)), F.pmod(key, F.lit(len(values))).cast("int"))


def _named(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as incidents."""
    c, key = load(spark, sf_dir, "customer"), F.col("c_custkey")
    day = F.concat(F.lit("2024-03-"), F.lpad((key % 28 + 1).cast("string"), 2, "0"))
    return c.select(key.alias("incident"), _pick(key, _KINDS).alias("attack_type"), _named("Org ", key % 50).alias("target"), F.when(key % 3 != 0, _named("Crew ", key % 9)).alias("threat_actor"),
                    day.alias("attack_date"), _named(" City ", key % 20).alias("location"), (key % 6).alias("documents"), F.col("c_nationkey").alias("nation"))


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    groups = records.main_groups(o.select(F.col("o_custkey").alias("incident"), _pick(F.col("o_orderkey"), ("STUDENTS, ELDERLY", "ELDERLY", "UNKNOWN", "WORKERS")).alias("target_group")))
    t = o.where("o_custkey % 4 <> 0").groupBy(F.col("o_custkey").alias("incident")).agg(F.count("*").alias("documents"), F.countDistinct("o_orderpriority").alias("domains"))
    t = t.withColumn("score", F.round(F.least(F.lit(1.0), F.col("documents") / 16), 4)).withColumn("level", level(F.col("score")))
    rows = incidents(spark, sf_dir)
    named = rows.select("incident", F.when(F.col("nation") % 3 == 0, F.array(F.lit("school"))).when(F.col("nation") % 3 == 1, F.array(F.lit("platform:chat"), F.lit("other"))).alias("communities"))
    return records.cards(rows, groups, t, named, GUIDE)


_ONCE = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
_CARDS = """i AS (SELECT c_custkey AS incident, c_custkey % 5 AS k, 'Org ' || (c_custkey % 50) AS target, CASE WHEN c_custkey % 3 <> 0 THEN 'Crew ' || (c_custkey % 9) END AS threat_actor,
    '2024-03-' || lpad((c_custkey % 28 + 1)::VARCHAR, 2, '0') AS attack_date, 'City ' || (c_custkey % 20) AS location, c_custkey % 6 AS documents, c_nationkey % 3 AS m FROM customer),
ge AS (SELECT o_custkey AS incident, unnest(CASE o_orderkey % 4 WHEN 0 THEN ['STUDENTS', 'ELDERLY'] WHEN 1 THEN ['ELDERLY'] WHEN 2 THEN []::VARCHAR[] ELSE ['WORKERS'] END) AS g FROM orders),
gg AS (SELECT incident, g FROM (SELECT incident, g, count(*) AS n FROM ge GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY incident ORDER BY n DESC, g) = 1),
tr AS (SELECT o_custkey AS incident, count(*) AS documents, count(DISTINCT o_orderpriority) AS domains FROM orders WHERE o_custkey % 4 <> 0 GROUP BY 1),
c AS (SELECT i.*, g, CASE k WHEN 0 THEN 'phishing, malware' WHEN 1 THEN 'Ransomware' WHEN 4 THEN 'investment_scam,phishing' END AS attack_type,
    CASE WHEN tr.documents IS NOT NULL THEN round(least(1.0, tr.documents / 16), 4) END AS score, tr.documents AS td, domains FROM i LEFT JOIN gg USING (incident) LEFT JOIN tr USING (incident))"""


@query(f"""WITH {_CARDS},
l AS (SELECT *, CASE WHEN g IN ('STUDENTS', 'ELDERLY') THEN ['group:' || g] ELSE [] END || CASE k WHEN 0 THEN ['type:phishing:0', 'type:phishing:1', 'type:malware:0'] WHEN 1 THEN ['type:ransomware:0', 'type:ransomware:1']
    WHEN 4 THEN ['type:scam:0', 'type:scam:1', 'type:phishing:0'] ELSE ['type:cyber:0', 'type:cyber:1'] END AS s,
  CASE m WHEN 0 THEN ['school'] WHEN 1 THEN ['platform:chat'] ELSE [] END || CASE g WHEN 'STUDENTS' THEN ['students', 'parents'] WHEN 'ELDERLY' THEN ['elderly'] ELSE [] END
    || CASE k WHEN 0 THEN ['users'] WHEN 4 THEN ['investors', 'users'] ELSE [] END AS a,
  CASE m WHEN 1 THEN ['privacy', 'links'] ELSE [] END || CASE g WHEN 'ELDERLY' THEN ['calls'] ELSE [] END || CASE WHEN k IN (0, 4) THEN ['links', 'mail'] ELSE ['basics', 'updates'] END || ['report'] AS t FROM c)
SELECT incident, attack_type, target, threat_actor, attack_date, location, g AS target_group, CASE WHEN score IS NULL THEN 'no_score' WHEN score >= 0.72 THEN 'high' WHEN score >= 0.45 THEN 'medium' ELSE 'low' END AS status,
  array_to_string({_ONCE.format('s')}[1:3], ',') AS steps, concat_ws(',', CASE WHEN g = 'ELDERLY' OR k = 4 THEN 'bank' END, CASE WHEN k IN (0, 4) THEN 'content' END, 'patrol') AS channels,
  CASE WHEN len(a) = 0 THEN 'public' ELSE array_to_string({_ONCE.format('a')}[1:3], ',') END AS audience, array_to_string({_ONCE.format('t')}[1:3], ',') AS topics, score, coalesce(td, documents) AS documents, domains FROM l""")
def d1_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Machine cards with guidance and literacy (L-01 to L-03, F-43)."""
    join = lambda c: F.array_join(c, ",")
    return cards(spark, sf_dir).select("incident", *records.FIELDS, "status", join("prevention.steps").alias("steps"), join("prevention.channels").alias("channels"), join("literacy.audience").alias("audience"),
                                       join("literacy.topics").alias("topics"), F.col("basis.trust_score").alias("score"), "basis.documents", "basis.domains")


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seventh of the orders as statements; some are on incidents without a card."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o = load(spark, sf_dir, "orders").where("o_orderkey % 7 = 0")
    stated = {"attack_type": F.when(k % 2 == 0, "phishing"), "target": F.when(k % 5 < 3, F.upper(_named("org  ", c % 50))).when(k % 5 == 3, "Other"), "threat_actor": F.when(k % 3 == 0, _named("crew ", c % 9)), "attack_date": F.lit(None).cast("string"), "location": F.lit("UNKNOWN")}
    marks = F.create_map(F.lit("attack_date"), F.when(k % 2 == 0, "confirmed").otherwise("refuted"), F.lit("target"), F.lit("refuted"))
    return o.select(k.alias("statement_id"), (c + F.when(k % 11 == 0, 10_000_000).otherwise(0)).alias("incident"), F.to_date("o_orderdate").alias("date"), _pick(k, ("A", "B", "C")).alias("institution"),
                    _pick(k, ("confirmed", "refuted", "partial", "confirmed")).alias("status"), F.when(k % 6 != 0, _named("reason ", k % 4)).alias("reason"), *[v.alias(x) for x, v in stated.items()], marks.alias("marks"))


_STATED = """st AS (SELECT o_orderkey AS k, o_custkey + CASE WHEN o_orderkey % 11 = 0 THEN 10000000 ELSE 0 END AS incident, o_orderdate::DATE AS date, ['A', 'B', 'C'][o_orderkey % 3 + 1] AS institution FROM orders WHERE o_orderkey % 7 = 0),
lt AS (SELECT *, count(*) OVER (PARTITION BY incident) AS statements FROM st QUALIFY row_number() OVER (PARTITION BY incident ORDER BY date DESC, k DESC) = 1),
ins AS (SELECT incident, string_agg(DISTINCT institution, ',' ORDER BY institution) AS institutions FROM st GROUP BY incident),
d3 AS (SELECT incident, lt.k AS statement_id, lt.k AS q, statements, institutions, ['confirmed', 'refuted', 'partial', 'confirmed'][lt.k % 4 + 1] AS status, CASE WHEN lt.k % 6 <> 0 THEN 'reason ' || (lt.k % 4) END AS reason,
  CASE WHEN lt.k % 2 = 0 THEN 'phishing' ELSE attack_type END AS attack_type, CASE WHEN lt.k % 5 < 3 THEN 'ORG  ' || (incident % 50) WHEN lt.k % 5 = 3 THEN 'Other' ELSE target END AS target,
  CASE WHEN lt.k % 2 = 0 THEN CASE WHEN attack_type LIKE '%phishing%' THEN 'confirmed' ELSE 'refuted' END END AS kind_verdict, CASE WHEN lt.k % 5 < 3 THEN 'confirmed' ELSE 'refuted' END AS target_verdict,
  CASE WHEN lt.k % 3 = 0 THEN CASE WHEN threat_actor IS NOT NULL THEN 'confirmed' ELSE 'refuted' END END AS actor_verdict, CASE WHEN lt.k % 2 = 0 THEN 'confirmed' ELSE 'refuted' END AS date_verdict
  FROM lt JOIN c USING (incident) JOIN ins USING (incident))"""


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.statement_verdicts(cards(spark, sf_dir), records.latest_statements(statements(spark, sf_dir)))


@query(f"WITH {_CARDS}, {_STATED} SELECT incident, statement_id, status, reason, statements, institutions, attack_type, target, kind_verdict, target_verdict, actor_verdict, date_verdict FROM d3")
def d3_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest statement of each incident and what it says of the card's fields (L-08, X-12, X-26)."""
    v = lambda f, name: F.col(f"field_status.{f}").alias(name)
    return verdicts(spark, sf_dir).select("incident", "statement_id", "status", "reason", "statements", F.array_join("institutions", ",").alias("institutions"), "attack_type", "target",
                                          v("attack_type", "kind_verdict"), v("target", "target_verdict"), v("threat_actor", "actor_verdict"), v("attack_date", "date_verdict"))


@query(f"""WITH {_CARDS}, {_STATED} SELECT incident, CASE status WHEN 'confirmed' THEN 'official_advice' ELSE 'hoax_warning' END AS tier, CASE WHEN incident % 3 = 1 THEN incident END AS supersedes
FROM d3 WHERE status IN ('confirmed', 'refuted') AND reason IS NOT NULL AND incident % 3 <> 0""")
def d4_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Official records to append, each with the one it supersedes; unchanged ones are left out (L-09, F-25)."""
    found = materialize(verdicts(spark, sf_dir), "verdicts")
    none = found.limit(0).select("incident", F.col("incident").alias("output_id"), F.lit("").alias("output_hash"))
    same = records.official_records(found.where("incident % 3 = 0"), none).select("incident", F.col("incident").alias("output_id"), "output_hash")
    older = found.where("incident % 3 = 1").select("incident", F.col("incident").alias("output_id"), F.lit("older").alias("output_hash"))
    return records.official_records(found, same.union(older)).select("incident", "tier", "supersedes")


@query("""SELECT 'portal-' || event_id AS statement_id, user_id AS incident, ['Bank board', 'Police', 'I2'][event_id % 3 + 1] AS institution, ['confirmed', 'refuted'][event_id % 5 + 1] AS status,
['Handled', 'Not true'][event_id % 4 + 1] || CASE WHEN event_id % 2 = 0 THEN '. seen' ELSE '' END AS reason, CASE WHEN event_id % 9 = 0 THEN NULL ELSE 'confirmed' END AS target_mark,
CASE WHEN event_id % 9 <> 0 THEN 'Org ' || (event_id % 8) END AS target FROM events WHERE event_id % 5 < 2 AND event_id % 4 < 2""")
def portal_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Portal decisions as statements; unknown codes and broken JSON are handled row by row (L-10)."""
    k = F.col("event_id")
    marks = F.when(k % 9 == 0, "{broken").otherwise('{"target":"confirmed","colour":"refuted","location":"maybe"}')
    fixes = F.when(k % 9 == 0, "[1]").otherwise(F.concat(F.lit('{"target":" Org '), k % 8, F.lit('","colour":"red"}')))
    rows = load(spark, sf_dir, "events").select(k.alias("review_id"), F.col("user_id").alias("incident"), _pick(k, ("I0", "I1", "I2")).alias("institution"), _pick(k, ("confirmed", "refuted", "maybe", "other", "none")).alias("status"),
                                                _pick(k, ("handled", "hoax", "odd", "rare")).alias("code"), F.when(k % 2 == 0, " seen ").alias("note"), marks.alias("field_status"), fixes.alias("corrections"), F.lit(None).cast("string").alias("source_url"), F.col("ts").alias("created_at"))
    found = records.review_statements(rows, ("confirmed", "refuted", "partial"), {"handled": "Handled", "hoax": "Not true"}, {"I0": "Bank board", "I1": "Police"})
    return found.select("statement_id", "incident", "institution", "status", "reason", F.try_element_at("marks", F.lit("target")).alias("target_mark"), "target")


@query("""WITH m AS (SELECT source AS incident, doc_id AS id, string_split(text, chr(10))[1] AS title, (doc_id * 37) % 200 AS published, doc_id % 50 = 0 AS official FROM documents),
h AS (SELECT *, CASE WHEN contains(lower(title), 'license') THEN 'license' WHEN contains(lower(title), 'password') THEN 'password' ELSE '' END AS institution FROM m)
SELECT incident, id, institution, official FROM h WHERE official OR institution <> '' QUALIFY row_number() OVER (PARTITION BY incident ORDER BY published DESC, id) = 1""")
def statement_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents that may have an official statement, by an official source or a word in a title (L-14)."""
    d = load(spark, sf_dir, "documents")
    rows = d.select(F.col("source").alias("incident"), F.col("doc_id").alias("id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.pmod(F.col("doc_id") * 37, F.lit(200)).alias("published"), (F.col("doc_id") % 50 == 0).alias("official"))
    return records.statement_candidates(rows, d.select(F.col("source").alias("incident")).distinct(), ["license", "password"]).select("incident", "id", "institution", "official")


@query(f"""WITH {_CARDS} SELECT incident, attack_type, g AS target_group FROM c WHERE documents >= 2 AND (attack_type LIKE '%phish%' OR attack_type LIKE '%Ransom%' OR g = 'WORKERS')""")
def institution_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents within an institution's mandate, by part of a text or by group (L-16, P-13)."""
    found = cards(spark, sf_dir).drop("tier").join(incidents(spark, sf_dir).select("incident", "documents"), "incident")
    return records.institution_queue(found, ["phish", "Ransom"], ["WORKERS"]).select("incident", "attack_type", "target_group")


@query("""WITH r AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 13 = 0 THEN 'incident is empty' WHEN o_orderkey % 6 = 5 THEN 'flow is unknown' WHEN o_orderkey % 17 = 0 THEN 'status is empty' WHEN o_orderkey % 10 = 3 THEN 'tier is unknown' END AS problem FROM orders)
SELECT coalesce(problem, 'none') AS problem, count(*) AS n FROM r GROUP BY 1""")
def record_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to append checked against what a record may hold (L-04)."""
    k = F.col("o_orderkey")
    rows = load(spark, sf_dir, "orders").select(F.when(k % 13 != 0, k.cast("string")).alias("incident"), _pick(k, ("D1", "D2", "D3", "D4", "D1", "D9")).alias("flow"), F.when(k % 17 != 0, "open").otherwise("").alias("status"),
                                                F.when(k % 10 == 3, "odd").when(k % 10 > 3, "caution").alias("tier"))
    return records.valid_records(rows, metrics.FLOWS, ("early_warning", "caution", "official_advice", "hoax_warning")).groupBy(F.coalesce("problem", F.lit("none")).alias("problem")).agg(F.count("*").alias("n"))


# -- comparison of the flows ------------------------------------------------------------------------------------------------


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as outputs of the four flows on customers."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    flow = F.concat(F.lit("D"), (k % 4 + 1).cast("string"))
    shift = F.when(k % 5 == 0, 1).otherwise(0)
    values = {"attack_type": _pick(c + shift, ("phishing", "malware, phishing", "ransomware")), "target": F.when(k % 7 != 0, F.when(k % 2 == 0, F.upper(_named("Org ", (c + shift) % 50))).otherwise(_named("Org  ", (c + shift) % 50))),
              "threat_actor": F.when(k % 3 != 0, _named("Crew ", c % 9)), "attack_date": F.when(k % 10 != 0, _named("2024-03-", 10 + c % 18)), "location": F.when(k % 9 == 0, " ").otherwise(_named("City ", (c + shift) % 20))}
    status = F.when(k % 17 == 0, "removed").when(flow == "D1", _pick(k + c, ("high", "medium", "low"))).when(flow == "D2", _pick(k + c, ("agree", "disagree", "pending"))).when(flow == "D3", _pick(k + c, ("confirmed", "refuted", "partial"))).otherwise(_pick(k + c, ("confirmed", "refuted", "confirmed")))
    said = lambda i: F.when(flow == "D2", _pick(k + c + i, ("agree", "disagree", "none"))).when(flow == "D3", _pick(k + c + i, ("confirmed", "refuted", "none"))).when((flow == "D4") & ((k + c + i) % 11 == 0), "refuted").otherwise("none")
    marks = F.create_map(*[x for i, f in enumerate(records.JUDGED) for x in (F.lit(f), said(i))])
    part = lambda n: F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (k % 3 + 1).cast("int"), F.lit(n))
    return load(spark, sf_dir, "orders").select(k.alias("output_id"), c.alias("incident"), flow.alias("flow"), *[v.alias(x) for x, v in values.items()], status.alias("status"), _pick(k, ("true", "hoax", "odd", "undecided", "true")).alias("basis_verdict"),
                                                marks.alias("field_status"), part(2).alias("steps"), part(1).alias("audience"), F.when(k % 4 != 3, part(3)).otherwise(F.slice(part(3), 1, F.when(k % 8 == 3, 0).otherwise(1))).alias("topics"), F.col("o_orderdate").alias("recorded_at"))


def _metrics_sql() -> str:
    norm = lambda x: rf"nullif(trim(regexp_replace(lower({x}), '\s+', ' ', 'g')), '')"
    parts = lambda x: f"list_filter(list_transform(string_split(lower({x}), ','), lambda v: trim(v)), lambda v: v <> '')"
    same = lambda f, a, b: f"coalesce(len(list_filter({parts(b)}, lambda v: NOT list_contains({parts(a)}, v))) = 0, false)" if f == "attack_type" else f"coalesce({norm(a)} = {norm(b)}, false)"
    out = []
    add = lambda metric, flow, field, value, n: out.append(f"SELECT '{metric}' AS metric, '{flow}' AS flow, '{field}' AS field, ({value})::DOUBLE AS value, ({n})::BIGINT AS n FROM w")
    c = lambda cond: f"count(*) FILTER ({cond})"
    have = lambda f: f"w.s{f} IS NOT NULL"
    total = c(have("d1"))
    names = ("D1", "D2", "D3", "D4")
    for f in names:
        x = f.lower()
        add("coverage", f, "", c(have(x)), total)
        if f != "D1":
            add("coverage_share", f, "", f"CASE WHEN {total} > 0 THEN {c(have(x))} / {total} END", total)
        h = f"CASE WHEN w.begin_ >= w.started THEN greatest(0.0, epoch(w.f{x}) - epoch(w.begin_)) / 3600 END"
        add("median_hours", f, "", f"median({h})", f"count({h})")
    share = lambda a, b: f"CASE WHEN {b} > 0 THEN {a} / {b} END"
    for i, f in enumerate(records.JUDGED):
        truth, mine, bad = f"w.d4.{f}", f"w.d1.{f}", f"w.d4.m[{i + 1}] = 'refuted'"
        case = f"w.sd4 = 'confirmed' AND {norm(truth)} IS NOT NULL AND {have('d1')}"
        right = f"({norm(mine)} IS NOT NULL AND {same(f, mine, truth)} AND NOT {bad})"
        tp, fn, fp = c(f"{case} AND {right}"), c(f"{case} AND NOT {right}"), c(f"{case} AND NOT {right} AND {norm(mine)} IS NOT NULL")
        p, r = share(tp, f"({tp} + {fp})"), share(tp, f"({tp} + {fn})")
        add("precision", "D1", f, p, f"{tp} + {fn}")
        add("recall", "D1", f, r, f"{tp} + {fn}")
        add("f1", "D1", f, f"CASE WHEN ({p}) > 0 AND ({r}) > 0 THEN 2 * ({p}) * ({r}) / (({p}) + ({r})) END", f"{tp} + {fn}")
        said = {x: f"CASE w.{x}.m[{i + 1}] WHEN '{yes}' THEN true WHEN '{no}' THEN false END" for x, yes, no in (("d2", "agree", "disagree"), ("d3", "confirmed", "refuted"))}
        for x in ("d2", "d3"):
            agrees = f"({norm(f'w.{x}.{f}')} IS NOT NULL AND {same(f, f'w.{x}.{f}', truth)} AND NOT {bad})"
            judged = f"w.sd4 = 'confirmed' AND {norm(truth)} IS NOT NULL AND {have(x)} AND ({said[x]}) IS NOT NULL"
            add("judged_right", x.upper(), f, share(c(f"{judged} AND ({said[x]}) = {agrees}"), c(judged)), c(judged))
        both = f"({said['d2']}) IS NOT NULL AND ({said['d3']}) IS NOT NULL"
        k = c(both)
        s, a, b = (f"({c(f'{both} AND {cond}')} / {k})" for cond in (f"({said['d2']}) = ({said['d3']})", f"({said['d2']})", f"({said['d3']})"))
        e = f"({a} * {b} + (1 - {a}) * (1 - {b}))"
        add("agreement", "D2-D3", f, f"CASE WHEN {k} > 0 THEN {s} END", k)
        add("kappa", "D2-D3", f, f"CASE WHEN {k} > 0 AND {e} < 1 THEN ({s} - {e}) / (1 - {e}) END", k)
    hoax = c("w.sd4 = 'refuted'")
    add("hoaxes_refuted", "D4", "", hoax, c(have("d4")))
    add("hoaxes_passed", "D1", "", c("w.sd4 = 'refuted' AND w.sd1 IN ('high', 'medium')"), hoax)
    add("hoaxes_passed", "D2", "", c("w.sd4 = 'refuted' AND w.sd2 = 'agree'"), hoax)
    for part in ("steps", "audience", "topics"):
        chosen, offered = f"w.d4.{part}", f"w.d1.{part}"
        case = f"{have('d1')} AND len({chosen}) > 0"
        union = f"len(list_distinct(list_concat({offered}, {chosen})))"
        add(f"{part}_jaccard", "D1-D4", "", f"avg(len(list_intersect({offered}, {chosen})) / {union}) FILTER ({case})", c(case))
        if part == "steps":
            add("steps_added", "D4", "", share(c(f"{case} AND len(list_filter({chosen}, lambda v: NOT list_contains({offered}, v))) > 0"), c(case)), c(case))
    for f in names:
        x = f.lower()
        for v in ("true", "hoax", "undecided"):
            add("verdict", f, v, c(f"w.v{x} = '{v}'"), c(have(x)))
        if f != "D4":
            sure = f"{have(x)} AND {have('d4')} AND w.v{x} <> 'undecided'"
            add("verdict_as_official", f, "", share(c(f"{sure} AND w.v{x} = w.vd4"), c(sure)), c(sure))
    reached = f"{have('d1')} AND {have('d4')}"
    for v in ("high", "medium", "low", "no_score"):
        add("bias_all", "D1", v, share(c(f"w.sd1 = '{v}'"), total), total)
        add("bias_reached", "D1", v, share(c(f"{reached} AND w.sd1 = '{v}'"), c(reached)), c(reached))
    rows = "\nUNION ALL ".join(out)
    marks = ", ".join(f"CASE k % 4 WHEN 1 THEN ['agree', 'disagree', 'none'][(k + c + {i}) % 3 + 1] WHEN 2 THEN ['confirmed', 'refuted', 'none'][(k + c + {i}) % 3 + 1] WHEN 3 THEN CASE WHEN (k + c + {i}) % 11 = 0 THEN 'refuted' ELSE 'none' END ELSE 'none' END" for i in range(5))
    return f"""WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderdate AS tm, (o_orderkey % 5 = 0)::INT AS sh, ['a', 'b', 'c'][o_orderkey % 3 + 1:] AS abc FROM orders WHERE o_orderdate <= (SELECT max(o_orderdate) - INTERVAL 200 DAY FROM orders)),
l AS (SELECT k, c, tm, 'd' || (k % 4 + 1) AS flow, CASE WHEN k % 17 = 0 THEN 'removed' WHEN k % 4 = 0 THEN ['high', 'medium', 'low'][(k + c) % 3 + 1] WHEN k % 4 = 1 THEN ['agree', 'disagree', 'pending'][(k + c) % 3 + 1]
  WHEN k % 4 = 2 THEN ['confirmed', 'refuted', 'partial'][(k + c) % 3 + 1] ELSE ['confirmed', 'refuted', 'confirmed'][(k + c) % 3 + 1] END AS s,
  {{'attack_type': ['phishing', 'malware, phishing', 'ransomware'][(c + sh) % 3 + 1], 'target': CASE WHEN k % 7 <> 0 THEN CASE WHEN k % 2 = 0 THEN 'ORG ' ELSE 'Org  ' END || ((c + sh) % 50) END, 'threat_actor': CASE WHEN k % 3 <> 0 THEN 'Crew ' || (c % 9) END,
  'attack_date': CASE WHEN k % 10 <> 0 THEN '2024-03-' || (10 + c % 18) END, 'location': CASE WHEN k % 9 = 0 THEN ' ' ELSE 'City ' || ((c + sh) % 20) END, 'm': [{marks}], 'steps': abc[1:2], 'audience': abc[1:1],
  'topics': CASE WHEN k % 4 <> 3 THEN abc WHEN k % 8 = 3 THEN []::VARCHAR[] ELSE abc[1:1] END}} AS r FROM o),
n AS (SELECT *, CASE WHEN flow = 'd2' THEN CASE k % 5 WHEN 0 THEN 'true' WHEN 1 THEN 'hoax' WHEN 4 THEN 'true' ELSE 'undecided' END WHEN s IN ('high', 'confirmed') THEN 'true' WHEN s = 'refuted' THEN 'hoax' ELSE 'undecided' END AS v,
  first_value(tm) OVER (PARTITION BY c, flow ORDER BY k) AS f FROM l QUALIFY row_number() OVER (PARTITION BY c, flow ORDER BY k DESC) = 1),
live AS (SELECT * FROM n WHERE s <> 'removed' AND (s <> 'pending' OR v <> 'undecided')),
b AS (SELECT o_custkey AS c, min(o_orderdate) AS begin_ FROM orders GROUP BY 1),
w AS (SELECT ids.c, begin_, (SELECT min(f) FROM n WHERE flow = 'd1') AS started, {', '.join(f"{x}.r AS {x}, {x}.s AS s{x}, {x}.v AS v{x}, g{x}.f AS f{x}" for x in ('d1', 'd2', 'd3', 'd4'))}
  FROM (SELECT DISTINCT c FROM n) ids LEFT JOIN b ON b.c = ids.c {' '.join(f"LEFT JOIN live {x} ON {x}.c = ids.c AND {x}.flow = '{x}' LEFT JOIN n g{x} ON g{x}.c = ids.c AND g{x}.flow = '{x}'" for x in ('d1', 'd2', 'd3', 'd4'))})
SELECT metric, flow, field, round(value, 6) AS value, n FROM ({rows})"""


@query(_metrics_sql())
def flow_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the flows compare as of a day: some twenty families of measures from one pass (L-12, L-13, A-21 to A-25, X-12, P-17)."""
    o = load(spark, sf_dir, "orders")
    last = o.agg((F.max("o_orderdate") - F.expr("interval 200 days")).alias("day")).first()["day"]
    rows = metrics.outputs_as_of(outputs(spark, sf_dir), F.lit(last).cast("timestamp_ntz"))
    begun = o.groupBy(F.col("o_custkey").alias("incident")).agg(F.min("o_orderdate").alias("begin"))
    return metrics.compare(rows, begun).select("metric", "flow", "field", F.round("value", 6).alias("value"), "n")
