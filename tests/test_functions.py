"""Functions against plain Python."""

import hashlib
import json
import re

import pytest
from pyspark.sql import functions as F

from casebook.functions import dates, ids, text


def one(spark, expr, **columns):
    names = list(columns)
    kinds = {str: "string", int: "long", float: "double", list: "array<string>", type(None): "string"}
    ddl = ", ".join(f"{n} {kinds[type(columns[n])]}" for n in names)
    return spark.createDataFrame([tuple(columns[n] for n in names)], ddl).select(expr.alias("x")).first()["x"]


def test_normalize(spark):
    assert one(spark, text.normalize_text(F.col("a")), a="  Big \t NEWS \n") == "big news"
    assert one(spark, text.normalize_text(F.col("a")), a=None) == ""


@pytest.mark.parametrize("given", ["Hello, hello WORLD42 ab", "Привет мир", "", "カタカナ テスト_x", "naïve café été"])
def test_tokenize(spark, given):
    want = list(dict.fromkeys(t for t in re.findall(r"[^\W_]+", given.lower()) if len(t) >= 3))
    assert one(spark, text.tokenize(F.col("a")), a=given) == want


@pytest.mark.parametrize(("word", "given", "hit"), [("phish", "they phished us", True), ("phish", "a phisherman", False), ("ddos", "ddos!", True), ("c++", "uses c++ here", True), ("ransomware", "preransomware", False), ("cve-", "a cve-2024", True), ("c2", "two c2s seen", True), ("c2", "c27", False), ("攻撃", "大攻撃者", True), ("攻撃", "a攻撃", False)])
def test_keyword_pattern(spark, word, given, hit):
    assert bool(re.search(text.keyword_pattern(word), given)) is hit
    assert one(spark, F.size(text.find_keywords(F.col("a"), [word])), a=given) == int(hit)


def test_overlapping_keywords(spark):
    words = ["data", "data breach", "leak"]
    found = text.drop_overlapping(text.find_keywords(F.col("a"), words), words)
    assert one(spark, found, a="big data breach and a leak") == ["data breach", "leak"]
    assert one(spark, found, a="data") == ["data"]


def test_publisher(spark):
    assert one(spark, text.publisher_of(F.col("a")), a="Bank hit by attack - The Daily") == "The Daily"
    assert one(spark, text.without_publisher(F.col("a")), a="Bank hit by attack | The Daily") == "Bank hit by attack"
    assert one(spark, text.remove_publisher(F.col("a"), F.lit("The Daily")), a="Summary - The Daily") == "Summary"


def test_similarities(spark):
    assert one(spark, text.jaccard(F.col("a"), F.lit(None).cast("array<string>")), a=["x"]) in (0.0, None)
    assert one(spark, text.char_similarity(F.col("a"), F.lit("abd")), a="abc") == pytest.approx(2 / 3)
    assert one(spark, text.field_similarity(F.col("a"), F.lit("N/A")), a="bank") is None
    assert one(spark, text.field_similarity(F.col("a"), F.lit("BANK of x")), a="bank of y") == pytest.approx(0.5)


@pytest.mark.parametrize(("url", "want"), [("https://www.Example.org:80/a?b", "example.org:80"), ("nothing", ""), (None, "")])
def test_domain(spark, url, want):
    assert one(spark, text.domain_of(F.col("a")), a=url) == want


def test_country(spark):
    assert one(spark, text.country_of(F.col("a")), a="news.co.id") == "ID"
    for domain, want in (("startup.io", "unknown"), ("tempo.co", "unknown"), ("paper.com.co", "CO"), ("news.ca", "CA"), ("giornale.it", "IT"), ("bbc.co.uk", "GB"), ("x.com", "unknown"), ("id", "unknown"), ("", "unknown")):
        assert one(spark, text.country_of(F.col("a")), a=domain) == want


def test_language_needs_more_distinct_words(spark):
    for given, want in (("the the the dan", ("unknown", 0.3)), ("dan yang the", ("id", 0.6)), ("The cyber attack", ("en", 0.6)), ("", ("unknown", 0.3))):
        language, sure = text.guess_language(F.col("a"))
        assert (one(spark, language, a=given), one(spark, sure, a=given)) == want


def test_indicators(spark):
    given = "cve-2024-12345 and CVE-2024-12345, hash " + "AB" * 16
    assert one(spark, text.indicators(F.col("a")), a=given) == ["CVE-2024-12345", "ab" * 16]


def test_html_and_image(spark):
    assert one(spark, text.clean_html(F.col("a")), a="&lt;b&gt;Bold&lt;/b&gt; &amp; <i>it</i>") == "Bold & it"
    page = '<meta property="og:image" content="http://x/a.png?a=1&amp;b=2">'
    assert one(spark, text.og_image(F.col("a")), a=page) == "http://x/a.png?a=1&b=2"


@pytest.mark.parametrize("value", ["plain", "é   \"quote\" \\ \n", "日本", "a/b"])
def test_canonical_json(spark, value):
    row = spark.createDataFrame([(value, 3, None, True)], "b string, a long, c string, d boolean").select(ids.canonical_json("b", "a", "c", "d").alias("x")).first()["x"]
    assert row == json.dumps({"b": value, "a": 3, "c": None, "d": True}, sort_keys=True, separators=(",", ":"))


def test_ids(spark):
    assert one(spark, ids.article_uid(F.col("a")), a="http://x") == hashlib.sha256(b"http://x").hexdigest()[:24]
    assert one(spark, ids.incident_id(F.col("a")), a="u1") == "INCIDENT_" + hashlib.sha1(b"INCIDENT|u1").hexdigest()[:12].upper()


def test_dates(spark):
    assert str(one(spark, dates.parse_iso(F.col("a")), a="2024-05-01T10:00:00Z")) == "2024-05-01 10:00:00"
    assert str(one(spark, dates.parse_iso(F.col("a")), a="2024-05-01")) == "2024-05-01 00:00:00"
    assert one(spark, dates.parse_iso(F.col("a")), a="soon") is None
    assert str(one(spark, dates.parse_rfc2822(F.col("a")), a="Wed, 01 May 2024 10:00:00 +0200")) == "2024-05-01 08:00:00"
    assert str(one(spark, dates.attack_date(F.col("a")), a="on 2024-13-40 or 31/12/2023")) == "2023-12-31"
    assert str(one(spark, dates.attack_date(F.col("a")), a="on 13-02-2025 or so")) == "2025-02-13"
    gap = dates.day_gap(F.lit("2024-01-01 00:00:00").cast("timestamp"), F.lit("2024-01-02 12:00:00").cast("timestamp"))
    assert one(spark, gap, a="x") == -2
