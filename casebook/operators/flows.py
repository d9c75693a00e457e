"""Judgement flows: votes, latest snapshots, change capture with tombstones, alert tiers (L-*, K-06, K-07)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fewest decisive votes, and the share that decides.
MIN_DECISIVE, AGREEMENT = 3, 2 / 3
REMOVED = "removed"


def decide(agree: Column, disagree: Column) -> Column:
    """agree, disagree or open: enough decisive votes, two thirds of them alike, agreement tested first (L-06)."""
    n = agree + disagree
    return F.when(n < MIN_DECISIVE, "open").when(agree / n >= AGREEMENT, "agree").when(disagree / n >= AGREEMENT, "disagree").otherwise("open")


def latest(log: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The newest row of each key, by partial aggregation (J-09, X-29)."""
    rest = [c for c in log.columns if c not in keys]
    newest = log.groupBy(*keys).agg(F.max(F.struct(F.col(seq).alias("__seq"), *rest)).alias("r"))
    return newest.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def vote_rollup(votes: DataFrame, cards: DataFrame) -> DataFrame:
    """(incident, field, shown, answer, respondent, correction, seq) votes and (incident, field, value) cards to one row a field.

    Votes on another value than the card's are counted as ignored.  If the field is decided against, the most frequent correction replaces its value; spellings count
    together, the first one given stands for them, ties go to the first seen (L-07, A-13, A-14)."""
    own = votes.where(F.col("answer").isin("agree", "disagree", "unsure")).join(cards, ["incident", "field"])
    own = own.withColumn("fresh", F.col("shown").eqNullSafe(F.col("value")))
    count = lambda cond: F.count_if(F.col("fresh") & cond)
    sums = own.groupBy("incident", "field").agg(
        F.first("value").alias("value"), count(F.col("answer") == "agree").alias("agree"), count(F.col("answer") == "disagree").alias("disagree"),
        count(F.col("answer") == "unsure").alias("unsure"), F.count_if(~F.col("fresh")).alias("ignored"), F.countDistinct(F.when(F.col("fresh"), F.col("respondent"))).alias("respondents"))
    tidy = F.btrim(F.regexp_replace("correction", r"\s+", " "))
    given = own.where(F.col("fresh") & (F.col("answer") == "disagree") & (F.coalesce(tidy, F.lit("")) != "")).select("incident", "field", tidy.alias("c"), "seq")
    spelled = given.groupBy("incident", "field", F.lower("c").alias("k")).agg(F.count("*").alias("n"), F.min("seq").alias("s"), F.min_by("c", "seq").alias("c"))
    best = spelled.groupBy("incident", "field").agg(F.max_by(F.struct("c", "n"), F.struct("n", -F.col("s"))).alias("best"))
    decided = sums.where("agree + disagree + unsure > 0").withColumn("verdict", decide(F.col("agree"), F.col("disagree"))).join(best, ["incident", "field"], "left")
    against = (F.col("verdict") == "disagree") & F.col("best").isNotNull()
    return decided.select("incident", "field", "agree", "disagree", "unsure", "ignored", "respondents", "verdict", F.when(against, F.col("best.c")).otherwise(F.col("value")).alias("value"),
                          F.when(against, F.col("best.n")).alias("correction_votes"))


def incident_status(fields: DataFrame) -> DataFrame:
    """One status an incident: any field decided against, else any decided for, else open."""
    n = lambda v: F.count_if(F.col("verdict") == v)
    return fields.groupBy("incident").agg(F.when(n("disagree") > 0, "disagree").when(n("agree") > 0, "agree").otherwise("open").alias("status"), F.sum("agree").alias("agree"), F.sum("disagree").alias("disagree"))


def change_capture(previous: DataFrame, current: DataFrame, key: str, hash_col: str, status: str = "status") -> DataFrame:
    """Rows to append: current ones whose hash is new or changed, and once a tombstone for each key that has vanished.

    previous: the latest row of each key.  Columns: key, change (new, changed, removed)."""
    old = previous.select(key, F.col(hash_col).alias("__old"), F.col(status).alias("__status"))
    new = current.select(key, F.col(hash_col).alias("__new"))
    met = old.join(new, key, "full")
    gone = F.col("__new").isNull() & (F.coalesce(F.col("__status"), F.lit("")) != REMOVED)
    change = F.when(gone, REMOVED).when(F.col("__new").isNotNull() & F.col("__old").isNull() & F.col("__status").isNull(), "new").when(F.col("__new").isNotNull() & ~F.col("__new").eqNullSafe(F.col("__old")), "changed")
    return met.withColumn("change", change).where("change IS NOT NULL").select(key, "change")


def tiers(d1: DataFrame, d2: DataFrame, d3: DataFrame, d4: DataFrame) -> DataFrame:
    """(incident, ...) flows to one tier: an official verdict first, else public agreement, else the machine's early warning; removed cards drop out (L-11)."""
    base = d1.where(F.col("status") != REMOVED).select("incident", F.col("status").alias("trust_level"))
    met = base.join(d2.select("incident", F.col("status").alias("s2")), "incident", "left").join(d3.select("incident", F.col("status").alias("s3"), "institution"), "incident", "left").join(d4.select("incident", F.col("tier").alias("t4")), "incident", "left")
    official = F.col("t4").isin("official_advice", "hoax_warning")
    tier = F.when(official, F.col("t4")).when(F.col("s2") == "agree", "caution").otherwise("early_warning")
    source = F.when(official, "D4").when(F.col("s2") == "agree", "D2").otherwise("D1")
    return met.select("incident", "trust_level", tier.alias("tier"), source.alias("source_flow"), F.when(F.col("s3") == "partial", F.coalesce("institution", F.lit("institution"))).alias("review_note"))


def prf(tp: Column, fp: Column, fn: Column) -> Column:
    """Struct of precision, recall, f1; undefined ones null, f1 null too where either is 0 (A-23)."""
    p, r = F.when(tp + fp > 0, tp / (tp + fp)), F.when(tp + fn > 0, tp / (tp + fn))
    return F.struct(p.alias("precision"), r.alias("recall"), F.when((p > 0) & (r > 0), 2 * p * r / (p + r)).alias("f1"))


def kappa(both: Column, a_only: Column, b_only: Column, neither: Column) -> Column:
    """Cohen's kappa of two yes-no judgements; null if agreement is certain by chance (A-24)."""
    n = both + a_only + b_only + neither
    seen = (both + neither) / n
    chance = ((both + a_only) * (both + b_only) + (b_only + neither) * (a_only + neither)) / (n * n)
    return F.when((n > 0) & (chance < 1), (seen - chance) / (1 - chance))
