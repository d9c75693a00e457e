"""What the editorial side asks of articles and incidents: sources, publishers, ranks, severities, queues, repairs and lookups (X-*, O-*, W-*, Y-*, R-01)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casebook.functions.text import domain_of, publisher_of, without_publisher

#: Hosts that only pass articles on; what stands before a publisher without a known domain; titles of an incident's text and its length.
AGGREGATORS, PUBLISHER_PREFIX, MORE_TITLES, LONGEST_TEXT = ("news.google.com",), "penerbit:", 3, 2000
#: Shares of the largest count at which map classes begin, below five every count is a class.
CLASS_SHARES, FEW_CLASSES = (0.15, 0.35, 0.60, 0.85), 5


def publisher_domains(sources: DataFrame) -> DataFrame:
    """(publisher, domain, articles) to one domain a lower-case publisher: that of most articles, ties by name (X-18)."""
    named = sources.where(F.col("publisher").isNotNull()).withColumn("publisher", F.lower(F.btrim("publisher"))).where("publisher <> ''")
    return named.groupBy("publisher").agg(F.min_by("domain", F.struct(-F.col("articles"), "domain")).alias("known_domain"))


def source_identity(articles: DataFrame, publishers: DataFrame, url: str = "url", title: str = "title") -> DataFrame:
    """Adds `identity` to articles (F-12): the medium's domain; behind an aggregator the publisher at the headline's end, by its domain if that is known; else the aggregator."""
    own = articles.withColumns({"host_": domain_of(F.col(url)), "publisher_": F.lower(publisher_of(F.col(title)))})
    met = own.join(publishers, F.col("publisher_") == publishers["publisher"], "left")
    named = F.coalesce("known_domain", F.concat(F.lit(PUBLISHER_PREFIX), "publisher_"))
    identity = F.when((F.col("host_") != "") & ~F.col("host_").isin(*AGGREGATORS), F.col("host_")).when(F.col("publisher_") != "", named).otherwise(F.col("host_"))
    return met.select(*articles.columns, identity.alias("identity"))


def publishers_of(articles: DataFrame, publishers: DataFrame) -> DataFrame:
    """(incident, id, title, url) to an incident's publishers: name as first spelled, domain from any of its articles or the registry (X-27)."""
    own = articles.withColumns({"name": publisher_of(F.col("title")), "host": domain_of(F.col("url"))}).where("name <> ''").withColumn("key", F.lower("name"))
    direct = F.when((F.col("host") != "") & ~F.contains("host", F.lit("google.")), F.col("host"))
    met = own.join(publishers, own["key"] == publishers["publisher"], "left").withColumn("domain", F.coalesce(direct, "known_domain"))
    return met.groupBy("incident", "key").agg(F.min_by("name", "id").alias("name"), F.min_by("domain", F.when(F.col("domain").isNotNull(), F.col("id"))).alias("domain")).drop("key")


def incident_media(articles: DataFrame, publishers: DataFrame, top: int = 3) -> DataFrame:
    """(incident, id, title, url) to distinct publishers and the `top` domains by articles, ties by name (X-33)."""
    own = articles.withColumns({"p": F.lower(publisher_of(F.col("title"))), "host": domain_of(F.col("url"))})
    direct = F.when((F.col("host") != "") & ~F.contains("host", F.lit("google.")), F.col("host"))
    met = own.join(publishers, own["p"] == publishers["publisher"], "left").withColumn("domain", F.coalesce(direct, "known_domain", F.lit("")))
    named = met.withColumn("name", F.when(F.col("p") != "", F.col("p")).otherwise(F.col("domain")))
    names = named.where("name <> ''").groupBy("incident").agg(F.countDistinct("name").alias("publishers"))
    counts = met.where("domain <> ''").groupBy("incident", "domain").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("k", F.row_number().over(Window.partitionBy("incident").orderBy(F.desc("n"), "domain"))).where(F.col("k") <= top)
    logos = ranked.groupBy("incident").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "domain"))), lambda x: x["domain"]), ",").alias("logos"))
    return articles.select("incident").distinct().join(names, "incident", "left").join(logos, "incident", "left").select("incident", F.coalesce("publishers", F.lit(0)).alias("publishers"), F.coalesce("logos", F.lit("")).alias("logos"))


def severity(documents: Column, kinds: Column, heavy: list[str]) -> Column:
    """crit, high or med by the number of documents and whether the first kind of attack is a heavy one (F-14)."""
    first = F.btrim(F.split_part(F.lower(F.coalesce(kinds, F.lit(""))), F.lit(","), F.lit(1)))
    is_heavy = first.isin(*heavy)
    return F.when((documents >= 8) | (is_heavy & (documents >= 3)), "crit").when((documents >= 3) | is_heavy, "high").otherwise("med")


def title_case(x: Column) -> Column:
    """Upper case for a letter at the start and after white space, stop, slash or hyphen; other letters stay (F-14)."""
    parts = F.split(x, r"(?<=[\s./-])")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.substring(p, 2, 1 << 30))), "")


def risk_level(now: Column, before: Column) -> Column:
    """Level of a group's risk from its incidents now and in the period before (X-30)."""
    return F.when((now >= 20) | ((now >= 8) & (now > before * 1.5)), "high").when(now >= 5, "medium").otherwise("low")


def service_name(target: Column, common: list[str]) -> Column:
    """The first named victim if it may stand as a service: 3 to 40 characters, no common word, not UNKNOWN; null otherwise (X-31)."""
    name = F.btrim(F.split_part(F.coalesce(target, F.lit("")), F.lit(","), F.lit(1)))
    ok = (name != "UNKNOWN") & F.length(name).between(3, 40) & ~F.lower(name).isin(*common)
    return F.when(ok, F.when(name == F.lower(name), title_case(name)).otherwise(name))


def institution_sector(target: Column, sector: Column, words: str, places: list[str], trusted: list[str]) -> Column:
    """GOVERNMENT for a victim that a word or a place name marks as one, else its first sector if that is trusted, else null (X-31)."""
    name = F.lower(F.btrim(F.split_part(F.coalesce(target, F.lit("")), F.lit(","), F.lit(1))))
    main = F.btrim(F.split_part(F.coalesce(sector, F.lit("")), F.lit(","), F.lit(1)))
    return F.when((name != "") & (name.rlike(words) | name.isin(*places)), "GOVERNMENT").when(main.isin(*trusted), main)


def class_breaks(most: Column) -> Column:
    """Ascending starts of map classes up to the largest count, each once (A-29)."""
    few = F.sequence(F.lit(1), F.greatest(most, F.lit(1)).cast("int"))
    many = F.array_distinct(F.concat(F.array(F.lit(1)), *[F.array(F.greatest(F.lit(1), F.floor(most * s + 0.5).cast("int"))) for s in CLASS_SHARES]))
    return F.when(most <= FEW_CLASSES, few).otherwise(many)


def class_index(value: Column, breaks: Column) -> Column:
    """The last class that a value reaches, -1 below the first."""
    return F.size(F.filter(breaks, lambda b: b <= value)) - 1


def province_rollup(mentions: DataFrame, top: int = 2) -> DataFrame:
    """(province, incident, city, kinds (array)) rows to one a province: incidents and cities counted once, the `top` kinds by incidents, the first three incidents (A-17)."""
    once = mentions.groupBy("province", "incident").agg(F.any_value("kinds").alias("kinds"))
    sums = once.groupBy("province").agg(F.count("*").alias("incidents"))
    kinds = once.select("province", F.explode(F.array_distinct("kinds")).alias("kind")).groupBy("province", "kind").agg(F.count("*").alias("n"))
    cities = mentions.where(F.coalesce("city", F.lit("")) != "").select("province", "incident", "city").distinct().groupBy("province", "city").agg(F.count("*").alias("n"))

    def best(counts: DataFrame, name: str, alias: str) -> DataFrame:
        ranked = counts.withColumn("k", F.row_number().over(Window.partitionBy("province").orderBy(F.desc("n"), name))).where(F.col("k") <= top)
        return ranked.groupBy("province").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", F.concat_ws(":", name, "n").alias("t")))), lambda x: x["t"]), ",").alias(alias))

    first = once.withColumn("k", F.row_number().over(Window.partitionBy("province").orderBy("incident"))).where("k <= 3").groupBy("province").agg(F.array_join(F.sort_array(F.collect_list("incident")), ",").alias("samples"))
    return sums.join(best(kinds, "kind", "kinds"), "province", "left").join(best(cities, "city", "cities"), "province", "left").join(first, "province", "left")


def top_incidents(incidents: DataFrame, days: int, most: int) -> DataFrame:
    """(incident, documents, domains, last_day) to the `most` largest by documents and twice the domains within `days` of the newest day of the data, ranked (W-07, Y-01)."""
    clock = incidents.agg(F.max("last_day")).first()[0]
    near = incidents.where((F.col("last_day") >= F.lit(clock) - days) & (F.col("documents") >= 2))
    best = near.withColumn("score", F.col("documents") + 2 * F.coalesce("domains", F.lit(0))).orderBy(F.desc("score"), "incident").limit(most)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "incident"))).select("rank", "incident", "score")  # `most` rows


def by_time_distance(members: DataFrame, most: int = 6) -> DataFrame:
    """(incident, id, at, anchor, anchor_at) to each incident's `most` articles nearest in time to its anchor, the anchor first (O-06, F-36)."""
    gap = F.abs(F.unix_timestamp(F.col("at").cast("timestamp")) - F.unix_timestamp(F.col("anchor_at").cast("timestamp"))) / 86400
    order = Window.partitionBy("incident").orderBy(F.desc(F.col("id") == F.col("anchor")), F.asc_nulls_first("gap"), "id")
    return members.withColumn("gap", gap).withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).select("incident", "k", "id", "gap")


def incident_texts(incidents: DataFrame, docs: DataFrame) -> DataFrame:
    """Text of each incident for comparison (R-01): the anchor's headline, up to three other headlines, and the anchor's summary.

    incidents: incident, anchor; docs: incident, id, at, title, summary.  Without its anchor an incident's first article stands for it.  Distinct headlines, each with its
    first place, are summed before they meet, so copies of one headline don't."""
    headed = docs.withColumn("headline", without_publisher(F.col("title")))
    place = F.struct("at", "id")
    own = headed.join(incidents.select("incident", "anchor"), "incident")
    first = own.groupBy("incident").agg(F.min_by(F.struct("headline", "summary"), F.struct((F.col("id") != F.col("anchor")).alias("other"), "at", "id", "headline")).alias("a"))
    others = headed.where("headline <> ''").groupBy("incident", "headline").agg(F.min(place).alias("place")).join(first.select("incident", F.col("a.headline").alias("own")), "incident").where("headline <> own")
    ranked = others.withColumn("k", F.row_number().over(Window.partitionBy("incident").orderBy("place", "headline"))).where(F.col("k") <= MORE_TITLES)
    more = ranked.groupBy("incident").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "headline"))), lambda x: x["headline"]).alias("more"))
    summary = without_publisher(F.col("a.summary"))
    parts = F.concat(F.array("a.headline"), F.coalesce("more", F.array().cast("array<string>")), F.array(F.when(summary == F.col("a.headline"), "").otherwise(summary)))
    return first.join(more, "incident", "left").select("incident", F.left(F.array_join(F.filter(parts, lambda p: F.coalesce(p, F.lit("")) != ""), ". "), F.lit(LONGEST_TEXT)).alias("text"))


def least_answered(candidates: DataFrame, answers: DataFrame, pool: int, seed: int) -> DataFrame:
    """(id, published) and (id) answers to the next card to ask about: of the `pool` with fewest answers, newest first, one by a seeded hash (O-08)."""
    counts = answers.groupBy("id").agg(F.count("*").alias("answers"))
    least = candidates.join(counts, "id", "left").select("id", "published", F.coalesce("answers", F.lit(0)).alias("answers")).orderBy("answers", F.desc("published"), "id").limit(pool)
    return least.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), "id")), "id").limit(1).select("id", "answers")


def changed_jobs(inputs: DataFrame, stored: DataFrame, budget: int, stale_before: Column | None = None) -> DataFrame:
    """(id, rank, digest) inputs whose stored (id, digest, made) is missing, differs or is too old, by rank, as many as the budget (Y-02, X-22)."""
    met = inputs.join(stored.select("id", F.col("digest").alias("known"), "made"), "id", "left")
    due = F.col("known").isNull() | (F.col("known") != F.col("digest"))
    if stale_before is not None:
        due = due | (F.col("made") < stale_before)
    return met.where(due).orderBy("rank", "id").limit(budget).select("id", "rank")


def merge_jobs(links: DataFrame, judged: DataFrame, existing: DataFrame, budget: int) -> DataFrame:
    """Unordered same-event pairs (a < b) with their greatest similarity, those judged or with a vanished end left out, most alike first (C-12, X-23)."""
    pairs = links.where("same_event").groupBy(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).agg(F.max("similarity").alias("similarity"))
    open_ = pairs.join(judged.select("a", "b"), ["a", "b"], "left_anti")
    ends = existing.select("id")
    live = open_.join(ends.withColumnRenamed("id", "a"), "a", "left_semi").join(ends.withColumnRenamed("id", "b"), "b", "left_semi")
    return live.orderBy(F.desc("similarity"), "a", "b").limit(budget).select("a", "b", "similarity")


def apply_anchors(batches: DataFrame, anchors: DataFrame) -> DataFrame:
    """Batches with the anchor whose root and batch id both match, unless they have one already (M-06).

    batches: batch, root, status, anchor; anchors: batch, root, anchor."""
    found = anchors.groupBy("batch", "root").agg(F.min("anchor").alias("new"))
    met = batches.join(found, ["batch", "root"], "left")
    fresh = F.col("new").isNotNull() & (F.col("status") != "ANCHORED")
    return met.select("batch", "root", F.when(fresh, "ANCHORED").otherwise(F.col("status")).alias("status"), F.when(fresh, F.col("new")).otherwise(F.col("anchor")).alias("anchor"))


def crawl_plan(tasks: DataFrame, state: DataFrame) -> DataFrame:
    """Tasks still to run: those whose latest state isn't completed; one left in progress by a broken run counts as open (G-S1, X-10)."""
    latest = state.groupBy("task").agg(F.max_by("status", "seq").alias("status"))
    return tasks.join(latest, "task", "left").where(~F.coalesce(F.col("status") == "COMPLETED", F.lit(False))).select(*tasks.columns, F.when(F.col("status") == "IN_PROGRESS", "restart").when(F.col("status").isNotNull(), "retry").otherwise("new").alias("how"))


def crawl_complete(periods: DataFrame, state: DataFrame, tasks: int) -> DataFrame:
    """(period) with how many tasks are completed, and whether that is all of them (X-09)."""
    done = state.where("status = 'COMPLETED'").groupBy("period").agg(F.countDistinct("task").alias("done"))
    return periods.join(done, "period", "left").select("period", F.coalesce("done", F.lit(0)).alias("done"), (F.coalesce("done", F.lit(0)) >= tasks).alias("complete"))


def names_match(a: Column, b: Column, tokens) -> Column:
    """Whether one name's tokens all stand in the other; a name without tokens matches none (T-10)."""
    x, y = tokens(a), tokens(b)
    inside = (F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0)
    return (F.size(x) > 0) & (F.size(y) > 0) & inside


def mention_ledger(ledger: DataFrame, mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New mentions (article, entity, kind, name) that the ledger doesn't have, once each; and how many an entity gains (E-05)."""
    key = ["article", "entity", "kind", "name"]
    fresh = mentions.select(*key).distinct().join(ledger.select(*key), key, "left_anti")
    return fresh, fresh.groupBy("entity").agg(F.count("*").alias("gained"))


def best_entities(mentions: DataFrame) -> DataFrame:
    """(article, kind, mention, entity, score) to the best scored entity of each article and kind, ties by the first mention (C-01)."""
    return mentions.groupBy("article", "kind").agg(F.min_by("entity", F.struct(-F.col("score"), "mention", "entity")).alias("entity"))
