"""Places, communities and platforms in texts, rolled up by incident (G-01 to G-04)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Names of at most so many places are broadcast.
BROADCAST_NAMES = 200_000


def gazetteer(places: DataFrame) -> DataFrame:
    """(name, region, is_city, context) to lower-case names; a name in two regions is dropped, a city comes before a region of its name (G-01)."""
    low = places.withColumn("name", F.lower(F.btrim("name"))).where("name <> ''")
    clear = low.groupBy("name").agg(F.countDistinct("region").alias("k")).where("k = 1").select("name")
    return low.join(clear, "name", "left_semi").groupBy("name").agg(F.max_by(F.struct("region", "is_city", "context"), "is_city").alias("p")).select("name", "p.*")


def phrases(text: Column, longest: int = 3) -> Column:
    """Distinct phrases of up to `longest` words, for an equi-join with names instead of a pattern for each of them."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), 1)

    def build(w: Column) -> Column:
        def spans_of(k: int) -> Column:
            return F.transform(w, lambda _, i: F.when(i + k <= F.size(w), F.array_join(F.slice(w, i + 1, k), " ")))

        spans = [spans_of(k) for k in range(1, longest + 1)]
        return F.array_distinct(F.array_compact(F.concat(*spans)))

    return F.transform(F.array(words), build)[0]


def mentions(texts: DataFrame, places: DataFrame, longest: int = 3) -> DataFrame:
    """(id, text) to (id, name, region) of the names found; a name with a context word counts only where that word stands too (G-02, G-03, J-16)."""
    # a list of counted size goes to the texts; beyond that, phrases and names meet by shuffle
    count, least, most = places.agg(F.count("*"), F.min(F.length("name")), F.max(F.length("name"))).first()
    near = F.broadcast(places) if count <= BROADCAST_NAMES else places
    # phrases shorter or longer than any name don't travel
    met = F.filter(phrases(F.col("text"), longest), lambda p: F.length(p).between(least or 0, most or 0))
    found = texts.select("id", F.explode(met).alias("name")).join(near, "name")
    needs = found.where("context IS NOT NULL").join(texts.select("id", phrases(F.col("text"), 1).alias("w")), "id").where(F.array_contains("w", F.lower("context"))).select("id", "name", "region")
    return found.where("context IS NULL").select("id", "name", "region").union(needs).distinct()


def incident_regions(strong: DataFrame, weak: DataFrame) -> DataFrame:
    """(incident, id, region) mentions in bodies and in summaries to (incident, region, n): each article once a region.

    A region that bodies name counts with its summary mentions; one named in summaries alone needs two articles (G-04)."""
    s = strong.select("incident", "id", "region").distinct()
    w = weak.select("incident", "id", "region").distinct().join(s, ["incident", "id", "region"], "left_anti")
    both = s.withColumn("s", F.lit(1)).unionByName(w.withColumn("s", F.lit(0))).groupBy("incident", "region").agg(F.count("*").alias("n"), F.sum("s").alias("strong"))
    return both.where("strong > 0 OR n >= 2").select("incident", "region", "n")


#: What a place's full name may begin with, besides its own name, and the short form of one of them.
PREFIXES, SHORT = ("Kabupaten Administrasi", "Kota Administrasi", "Kabupaten", "Kota"), ("Kabupaten", "Kab.")
#: Words of which one must stand before a name that is also a common word.
CONTEXT = ("di ke dari asal warga wilayah daerah kawasan kota kabupaten kab. provinsi polres polresta polrestabes polda pemkot pemkab pemprov dprd bupati".split()
           + ["wali kota", "walikota", "gubernur", "kejari", "kejati", "pengadilan negeri", "diskominfo", "in", "from"])


def place_phrases(provinces: DataFrame, cities: DataFrame, ambiguous: DataFrame, unless: str = "") -> DataFrame:
    """Phrases that name places (G-01): (phrase, label, kind, folded, before, unless), label being province or province/city.

    provinces: (province, name), a row a name or other name; cities: (province, city, name), full names such as "Kota Baru"; ambiguous: (name).  A full name stands for its city, a
    Kabupaten's also by its short form; the bare name does if no other province has it and no province is called so, a Kota before a Kabupaten; two words are also
    written as one.  Ambiguous bare names count only behind a word of CONTEXT."""
    own = provinces.select(F.btrim("name").alias("phrase"), F.col("province").alias("label")).where("phrase <> ''")
    prefix = "^(?:" + "|".join(PREFIXES) + ") "
    full = cities.select("province", F.concat_ws("/", "province", "city").alias("label"), F.btrim("name").alias("name"), F.regexp_replace(F.btrim("name"), prefix, "").alias("base"), F.btrim("name").startswith("Kota").alias("town"))
    named = full.select(F.col("name").alias("phrase"), "label").union(full.where(F.startswith("name", F.lit(SHORT[0]))).select(F.concat(F.lit(SHORT[1] + " "), F.col("base")).alias("phrase"), "label"))
    words = F.split("base", " ")
    two = F.when(F.size(words) == 2, F.array(F.concat(words[0], words[1]), F.concat(words[0], F.lower(words[1])))).otherwise(F.array().cast("array<string>"))
    bare = full.select("province", "label", "town", F.explode(F.array_distinct(F.concat(F.array("base"), two))).alias("phrase"))
    clear = bare.groupBy("phrase").agg(F.countDistinct("province").alias("k"), F.min_by("label", F.struct((~F.col("town")).alias("n"), "label")).alias("label")).where("k = 1").select("phrase", "label")
    plain = own.union(named).groupBy("phrase").agg(F.min("label").alias("label"))
    clear = clear.join(plain.select("phrase"), "phrase", "left_anti").join(ambiguous.select(F.col("name").alias("phrase"), F.lit(True).alias("odd")).distinct(), "phrase", "left")
    before = F.when(F.col("odd"), F.array(*map(F.lit, CONTEXT))).otherwise(F.array().cast("array<string>"))
    made = plain.withColumn("odd", F.lit(False)).unionByName(clear.withColumn("odd", F.coalesce("odd", F.lit(False))))
    return made.select("phrase", "label", F.lit("place").alias("kind"), F.lit(False).alias("folded"), before.alias("before"), F.when(F.col("odd"), unless).otherwise("").alias("unless"))
