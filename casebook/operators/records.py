"""Records of the judgement flows: machine cards with guidance, official statements, verdicts and records (L-01 to L-04, L-08 to L-10, L-14, L-16)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook.functions.ids import output_hash
from casebook.functions.text import normalize_text

#: A card's fields, those that official bodies and the public may judge, and how many steps, audiences and topics are shown.
FIELDS = ("attack_type", "target", "threat_actor", "attack_date", "location", "target_group")
JUDGED = FIELDS[:5]
MOST_STEPS, MOST_AUDIENCES, MOST_TOPICS = 3, 3, 3
#: Status of a statement to the tier of the record it makes.
RECORD_TIERS = {"confirmed": "official_advice", "refuted": "hoax_warning"}


def known(x: Column) -> Column:
    """The trimmed text; null if it is blank or the word UNKNOWN."""
    text = F.btrim(x.cast("string"))
    return F.when((text != "") & (F.upper(text) != "UNKNOWN"), text)


def value_list(x: Column) -> Column:
    """Lower-case values of a comma list, blanks left out, in order (F-43)."""
    return F.filter(F.transform(F.split(F.lower(F.coalesce(x, F.lit(""))), ","), lambda v: F.btrim(v)), lambda v: v != "")


def first_value(x: Column) -> Column:
    """What stands before the first comma (P-16)."""
    return F.btrim(F.split_part(F.coalesce(x, F.lit("")), F.lit(","), F.lit(1)))


@dataclass
class Guide:
    """The catalogue behind a card's guidance: steps, audiences and topics by group and type of attack; all of it is the caller's data."""

    steps_by_type: dict[str, int]
    groups: list[str]
    default_type: str
    alias: dict[str, str] = field(default_factory=dict)
    channels: dict[str, tuple[list[str], list[str]]] = field(default_factory=dict)  # channel: (groups, types)
    last_channel: str = "patrol"
    audiences: list[str] = field(default_factory=list)
    audience_by_group: dict[str, list[str]] = field(default_factory=dict)
    audience_by_type: dict[str, list[str]] = field(default_factory=dict)
    default_audience: str = "public"
    topics_by_group: dict[str, list[str]] = field(default_factory=dict)
    topics_by_type: dict[str, list[str]] = field(default_factory=dict)
    topics_by_platform: dict[str, list[str]] = field(default_factory=dict)
    last_topic: str = "report"
    hoax_topics: list[str] = field(default_factory=list)


NONE = "array<string>"


def _table(entries: dict) -> Column:
    """A map literal from names to arrays or scalars; an empty one finds nothing."""
    value = lambda v: F.array(*map(F.lit, v)).cast(NONE) if isinstance(v, list) else F.lit(v)
    return F.create_map(*[x for k, v in (entries or {"": []}).items() for x in (F.lit(k), value(v))])


def _listed(entries: dict, key: Column) -> Column:
    return F.coalesce(F.try_element_at(_table(entries), key), F.array().cast(NONE))


def _aliased(types: Column, guide: Guide) -> Column:
    return F.transform(types, lambda t: F.coalesce(F.try_element_at(_table(guide.alias), t), t)) if guide.alias else types


def _by_rank(types: Column, entries: dict, default: str) -> Column:
    """Types that have an entry, or the default: two items of the first and one of each other."""
    own = F.filter(types, lambda t: t.isin(*entries))
    some = F.when(F.size(own) > 0, own).otherwise(F.array(F.lit(default)))
    return F.flatten(F.transform(some, lambda t, i: F.slice(_listed(entries, t), 1, F.when(i == 0, 2).otherwise(1))))


def prevention(group: Column, types: Column, guide: Guide) -> Column:
    """Struct of steps and channels (L-02): the group's own step, two of the first known type and one of each other, at most MOST_STEPS; then channels by group or type."""
    steps = {t: [f"type:{t}:{i}" for i in range(n)] for t, n in guide.steps_by_type.items()}
    own = F.when(group.isin(*guide.groups), F.array(F.concat(F.lit("group:"), group))).otherwise(F.array().cast(NONE))
    pool = _by_rank(_aliased(types, guide), steps, guide.default_type)
    hit = lambda groups, kinds: (group.isin(*groups) if groups else F.lit(False)) | (F.arrays_overlap(types, F.array(*map(F.lit, kinds))) if kinds else F.lit(False))
    channels = [F.when(F.coalesce(hit(*rule), F.lit(False)), F.lit(name)) for name, rule in guide.channels.items()]
    return F.struct(F.slice(F.array_distinct(F.concat(own, pool)), 1, MOST_STEPS).alias("steps"), F.array_compact(F.array(*channels, F.lit(guide.last_channel))).alias("channels"))


def literacy(group: Column, types: Column, communities: Column, guide: Guide, hoax: Column | None = None) -> Column:
    """Struct of audience and topics (L-03): communities named in reports first, then the group's, then the types'; for a hoax the topics are its own."""
    aliased = _aliased(types, guide)
    named = F.slice(F.filter(communities, lambda c: c.isin(*guide.audiences) | c.startswith("platform:")), 1, 2)
    audience = F.array_distinct(F.concat(named, F.slice(_listed(guide.audience_by_group, group), 1, 2), F.flatten(F.transform(aliased, lambda t: _listed(guide.audience_by_type, t)))))
    some = F.when(F.size(audience) > 0, F.slice(audience, 1, MOST_AUDIENCES)).otherwise(F.array(F.lit(guide.default_audience)))
    platform = F.flatten(F.transform(named, lambda c: F.slice(_listed(guide.topics_by_platform, F.replace(c, F.lit("platform:"), F.lit(""))), 1, 2)))
    topics = F.concat(platform, _listed(guide.topics_by_group, group), _by_rank(aliased, guide.topics_by_type, guide.default_type), F.array(F.lit(guide.last_topic)))
    if hoax is not None:
        topics = F.when(hoax, F.array(*map(F.lit, guide.hoax_topics)).cast(NONE)).otherwise(topics)
    return F.struct(some.alias("audience"), F.slice(F.array_distinct(topics), 1, MOST_TOPICS).alias("topics"))


def main_groups(members: DataFrame) -> DataFrame:
    """(incident, target_group comma lists) to (incident, target_group): the most frequent group, ties by name (A-12)."""
    each = members.where(known(F.col("target_group")).isNotNull()).select("incident", F.explode(F.filter(F.transform(F.split("target_group", ","), lambda g: F.btrim(g)), lambda g: g != "")).alias("g"))
    return each.groupBy("incident", "g").agg(F.count("*").alias("n")).groupBy("incident").agg(F.min_by("g", F.struct(-F.col("n"), "g")).alias("target_group"))


def cards(incidents: DataFrame, groups: DataFrame, trust: DataFrame, communities: DataFrame, guide: Guide) -> DataFrame:
    """Machine cards (L-01): clean fields, main group, trust level as status, guidance and what it rests on, one row an incident.

    incidents: incident, attack_type, target, threat_actor, attack_date, location, documents; trust: incident, score, level, documents, domains; communities: incident,
    communities.  An incident without trust has the status no_score and its own count of documents."""
    t = trust.select("incident", "score", "level", F.col("documents").alias("trust_documents"), "domains")
    met = incidents.join(groups, "incident", "left").join(t, "incident", "left").join(communities, "incident", "left")
    types, group = value_list(known(F.col("attack_type"))), F.coalesce("target_group", F.lit(""))
    named = F.coalesce("communities", F.array().cast(NONE))
    clean = [known(F.col(c)).alias(c) for c in JUDGED]
    return met.select("incident", *clean, "target_group", F.coalesce("level", F.lit("no_score")).alias("status"), F.lit("early_warning").alias("tier"), prevention(group, types, guide).alias("prevention"),
                      literacy(group, types, named, guide).alias("literacy"), F.struct(F.col("score").alias("trust_score"), F.coalesce("trust_documents", "documents").alias("documents"), "domains").alias("basis"))


def card_hash(*extra: str) -> Column:
    """Digest of a card's fields, status and tier as canonical JSON, the same whenever and by whatever version it was made (F-25)."""
    return output_hash(*FIELDS, "status", "tier", *extra)


def valid_records(rows: DataFrame, flows: tuple[str, ...], tiers: tuple[str, ...]) -> DataFrame:
    """Adds `problem` to rows to be appended: an unknown flow or tier, a missing incident or status; null if there is none (L-04)."""
    problem = (
        F.when(F.coalesce(F.col("incident"), F.lit("")) == "", "incident is empty").when(~F.coalesce(F.col("flow").isin(*flows), F.lit(False)), "flow is unknown")
        .when(F.coalesce(F.col("status"), F.lit("")) == "", "status is empty").when(F.col("tier").isNotNull() & ~F.col("tier").isin(*tiers), "tier is unknown")
    )
    return rows.withColumn("problem", problem)


def same_value(name: str, card: Column, stated: Column) -> Column:
    """Whether a card's value agrees with a stated one: for kinds of attack the card's list holds all stated ones, else equal once normalized (X-12)."""
    if name == "attack_type":
        return F.size(F.array_except(value_list(stated), value_list(card))) == 0
    return normalize_text(card) == normalize_text(stated)


def latest_statements(statements: DataFrame) -> DataFrame:
    """(incident, statement_id, date, institution, ...) to the latest by date and id of each incident, with the number of statements and their institutions."""
    rest = [c for c in statements.columns if c not in ("incident", "date", "statement_id")]
    newest = statements.groupBy("incident").agg(F.max_by(F.struct("date", "statement_id", F.struct(*rest).alias("r")), F.struct("date", "statement_id")).alias("m"), F.count("*").alias("statements"), F.sort_array(F.collect_set("institution")).alias("institutions"))
    return newest.select("incident", "m.date", "m.statement_id", *[F.col(f"m.r.{c}").alias(c) for c in rest], "statements", "institutions")


def statement_verdicts(cards_: DataFrame, statements: DataFrame) -> DataFrame:
    """D3 rows (L-08): the card's values with stated ones in their place, and of each judged field confirmed, refuted or as the institution marked it.

    statements: latest_statements() with status, reason, the JUDGED fields and `marks` (map of field to verdict).  Incidents without a card are left out."""
    s = statements.select("incident", "statement_id", "date", "institution", "institutions", "statements", "status", "reason", F.struct(*JUDGED).alias("stated"), "marks")
    met = s.join(cards_.select("incident", F.struct(*FIELDS).alias("card")), "incident")
    verdict = {}
    for f in JUDGED:
        stated, card = known(F.col(f"stated.{f}")), F.col(f"card.{f}")
        agrees = F.coalesce(card.isNotNull() & same_value(f, card, stated), F.lit(False))
        verdict[f] = F.when(stated.isNotNull(), F.when(agrees, "confirmed").otherwise("refuted")).otherwise(F.try_element_at("marks", F.lit(f)))
    values = [F.coalesce(known(F.col(f"stated.{f}")), F.col(f"card.{f}")).alias(f) for f in JUDGED] + [F.col("card.target_group").alias("target_group")]
    return met.select("incident", *values, F.struct(*[v.alias(f) for f, v in verdict.items()]).alias("field_status"), "status", F.lit(None).cast("string").alias("tier"), "reason", "statement_id", "institution", "institutions", "statements")


def official_records(verdicts: DataFrame, previous: DataFrame) -> DataFrame:
    """D4 records to append (L-09): of final verdicts with a reason, those that differ from the incident's last record; each names the record it supersedes.

    previous: incident, output_id, output_hash of the last record of each incident."""
    final = verdicts.where(F.col("status").isin(*RECORD_TIERS) & (F.coalesce(F.col("reason"), F.lit("")) != ""))
    tiered = final.withColumn("tier", F.try_element_at(_table(RECORD_TIERS), F.col("status"))).withColumn("output_hash", card_hash("reason"))
    met = tiered.join(previous.select("incident", F.col("output_id").alias("supersedes"), F.col("output_hash").alias("known")), "incident", "left")
    return met.where(F.col("known").isNull() | (F.col("known") != F.col("output_hash"))).drop("known")


def review_statements(reviews: DataFrame, statuses: tuple[str, ...], reasons: dict[str, str], names: dict[str, str]) -> DataFrame:
    """Portal decisions as statements (L-10): unknown statuses and reason codes are dropped, as are marks and corrections of unknown fields; broken JSON counts as none.

    reviews: review_id, incident, institution, status, code, note, field_status and corrections (JSON), source_url, created_at."""
    good = reviews.where(F.col("status").isin(*statuses) & F.col("code").isin(*reasons))
    parse = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    note = F.btrim(F.coalesce("note", F.lit("")))
    marks = F.map_filter(parse("field_status"), lambda k, v: k.isin(*JUDGED) & v.isin("confirmed", "refuted"))
    made = good.withColumns({"m": marks, "x": parse("corrections")})
    return made.select(
        F.concat(F.lit("portal-"), "review_id").alias("statement_id"), "incident", F.coalesce(F.try_element_at(_table(names), F.col("institution")), "institution").alias("institution"), "status",
        F.col("created_at").alias("date"), F.coalesce("source_url", F.concat_ws(":", F.lit("portal"), "institution", "review_id")).alias("source_url"),
        F.concat(F.try_element_at(_table(reasons), F.col("code")), F.when(note != "", F.concat(F.lit(". "), note)).otherwise("")).alias("reason"),
        *[known(F.try_element_at("x", F.lit(f))).alias(f) for f in JUDGED], F.col("m").alias("marks"))


def statement_candidates(members: DataFrame, cards_: DataFrame, words: list[str]) -> DataFrame:
    """Incidents that probably have an official statement (L-14): of each the newest article from an official source or whose title names an institution.

    members: incident, id, title, published, official (boolean)."""
    has = lambda w: F.contains(F.lower("title"), F.lit(w.lower()))
    word = F.coalesce(*[F.when(has(w), F.lit(w)) for w in words], F.lit(""))
    hits = members.where(F.col("official") | (word != "")).withColumn("institution", word)
    newest = hits.groupBy("incident").agg(F.max_by(F.struct("id", "title", "published", "institution", "official"), F.struct("published", -F.col("id"))).alias("a"))
    return newest.join(cards_.select("incident"), "incident", "left_semi").select("incident", "a.*")


def institution_queue(incidents: DataFrame, types: list[str], groups: list[str], least: int = 2) -> DataFrame:
    """Incidents of several documents within an institution's mandate: a kind of attack is named in the list's text, or the main group is one of its own (L-16)."""
    by_type = [F.instr(F.col("attack_type"), t) > 0 for t in types]
    mandate = F.lit(False)
    for c in [*by_type, F.col("target_group").isin(*groups) if groups else F.lit(False)]:
        mandate = mandate | F.coalesce(c, F.lit(False))
    return incidents.where((F.col("documents") >= least) & mandate)
