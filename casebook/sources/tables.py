"""Table schemas, additive evolution, CSV statements with row-level checks, dictionaries and JSON lines (S-*, K-12, K-15, X-08)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SCHEMAS = {
    "articles": "article_id long, article_uid string, title string, summary string, content string, article_url string, published_date string, language string, first_seen string, last_seen string",
    "incidents": "incident_id string, attack_type string, target string, threat_actor string, location string, first_day long, last_day long, document_count long",
    "evidence": "evidence_uid string, incident_id string, article_id long, domain string, label string, independence double",
    "flow_outputs": "output_id long, incident_id string, flow string, status string, tier string, field_status map<string,string>, output_hash string, recorded_at timestamp",
    "statements": "statement_id string, incident_id string, institution string, status string, source_url string, date string",
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(SCHEMAS[name])


def conform(df: DataFrame, want: StructType) -> DataFrame:
    """The wanted columns in order, missing ones as typed nulls, others dropped, values that don't fit as nulls."""
    have = {c.lower(): c for c in df.columns}
    pick = lambda f: F.col(f"`{have[f.name.lower()]}`").try_cast(f.dataType) if f.name.lower() in have else F.lit(None).cast(f.dataType)
    return df.select(*[pick(f).alias(f.name) for f in want])


def read_optional(spark: SparkSession, path: str | None, want: StructType) -> DataFrame | None:
    """A table that may be absent: None if no path is set, an empty table if nothing is there, else its conformed rows."""
    if not path:
        return None
    from pyspark.errors import AnalysisException

    try:
        return conform(spark.read.option("mergeSchema", "true").parquet(path), want)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], want)


def checked_statements(rows: DataFrame, statuses: tuple[str, ...], line: str = "line") -> DataFrame:
    """Statements with `errors`: empty id or incident, unknown status, address that isn't http, malformed date, and an id that an earlier valid row has (S-08)."""
    bad = F.array_compact(F.array(
        F.when(F.coalesce(F.btrim("statement_id"), F.lit("")) == "", "statement_id is empty"), F.when(F.coalesce(F.btrim("incident_id"), F.lit("")) == "", "incident_id is empty"),
        F.when(~F.coalesce(F.col("status").isin(*statuses), F.lit(False)), "status is unknown"), F.when(~F.coalesce(F.col("source_url").rlike("^https?://"), F.lit(False)), "source_url is no http address"),
        F.when(~F.coalesce(F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False)), "date is malformed")))
    checked = rows.withColumn("errors", bad)
    order = Window.partitionBy("statement_id").orderBy(line)
    nth = F.sum((F.size("errors") == 0).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    repeated = (F.size("errors") == 0) & (nth > 1)
    return checked.withColumn("errors", F.when(repeated, F.array(F.lit("statement_id is repeated"))).otherwise(F.col("errors")))


def search_url(keyword: Column, language: Column, start: Column, end: Column, locales: dict[str, tuple[str, str, str]], base: str) -> Column:
    """Search feed address for a keyword, a language and a span of days (S-01): keywords are quoted but for site: ones, an end equal to the start moves on by a day."""
    until = F.when(start == end, F.date_add(end, 1)).otherwise(end)
    said = F.when(keyword.startswith("site:"), keyword).otherwise(F.concat(F.lit('"'), keyword, F.lit('"')))
    query = F.concat(said, F.lit(" after:"), start.cast("string"), F.lit(" before:"), until.cast("string"))
    coded = F.replace(F.replace(F.url_encode(query), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    tail = lambda i: F.coalesce(*[F.when(language == k, v[i]) for k, v in locales.items()], F.lit(locales["en"][i]))
    return F.concat(F.lit(base), F.lit("?q="), coded, F.lit("&hl="), tail(0), F.lit("&gl="), tail(1), F.lit("&ceid="), tail(2))


def periods(spark: SparkSession, since: str, today: str, days: int = 30) -> DataFrame:
    """Consecutive full periods of `days` days from a day on; a last partial one is left out (S-04)."""
    step = F.expr(f"sequence(date'{since}', date'{today}', interval {days} days)")
    return spark.range(1).select(F.explode(step).alias("start")).withColumn("end", F.date_add("start", days)).where(F.col("end") <= F.lit(today).cast("date"))


def tasks(keywords: DataFrame, languages: list[str]) -> DataFrame:
    """Every keyword in every language (S-03)."""
    return keywords.withColumn("language", F.explode(F.array(*map(F.lit, languages))))


def fetch_status(text: Column, failure: Column, shortest: int = 200, longest: int = 20_000) -> Column:
    """Struct of status and text of a fetched article (S-05): the failure if any, blocked pages, empty ones, else ok with the text cut to a limit that the feature sets."""
    blocked = F.coalesce(text, F.lit("")).rlike(r"(?i)access denied|enable javascript|captcha|are you a robot")
    status = F.when(failure.isNotNull(), failure).when(blocked, "blocked").when(F.length(F.btrim(F.coalesce(text, F.lit("")))) < shortest, "empty").otherwise("ok")
    return F.struct(status.alias("status"), F.when(status == "ok", F.left(text, F.lit(longest))).alias("text"))


def fetch_queue(rows: DataFrame, now: Column, budget: int, retry_days: int = 7) -> DataFrame:
    """The next rows to fetch: never tried ones first, then failures older than `retry_days`, newest first (S-06); the budget is the feature."""
    untried = F.col("status").isNull()
    again = F.col("status").isin("error", "unresolved") & (F.col("tried_at") < now - F.make_dt_interval(F.lit(retry_days)))
    return rows.where(untried | again).orderBy(F.when(untried, 0).otherwise(1), F.desc("published"), "id").limit(budget)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", "true").csv(path)
