"""Text functions as Column expressions: normalization, tokens, keywords, publishers, similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values that stand for "not known"; the three sets belong to different stages and differ on purpose.
UNKNOWN_WIDE = ("", "unknown", "none", "null", "n/a", "na", "-")
UNKNOWN_FLOW = ("", "UNKNOWN")


def normalize_text(x: Column) -> Column:
    """Lower case, white space of any kind collapsed, ends trimmed; null becomes empty."""
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(x.cast("string"), F.lit(""))), r"(?U)\s+", " "))


def tokenize(x: Column, min_length: int = 3) -> Column:
    """Distinct runs of letters and digits of any script, at least min_length long, in order of appearance."""
    return F.filter(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), 1)), lambda t: F.length(t) >= min_length)


def space_tokens(x: Column) -> Column:
    """Distinct tokens between spaces of normalized text, of any length."""
    return F.filter(F.array_distinct(F.split(normalize_text(x), " ")), lambda t: t != "")


def cleaned_tokens(x: Column) -> Column:
    """Distinct tokens of cleaned text longer than two characters; underscores stay inside."""
    return F.filter(F.array_distinct(F.split(clean_text(x), " ")), lambda t: F.length(t) > 2)


def clean_text(x: Column) -> Column:
    """Lower case without links, www names and punctuation."""
    out = F.lower(F.coalesce(x.cast("string"), F.lit("")))
    for pattern in (r"https?://\S+", r"www\.\S+", r"(?U)[^\w\s]", r"(?U)\s+"):
        out = F.regexp_replace(out, pattern, " ")
    return F.btrim(out)


def clean_html(x: Column) -> Column:
    """Entities decoded first, then tags dropped, then white space collapsed."""
    out = F.coalesce(x, F.lit(""))
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.btrim(F.regexp_replace(F.regexp_replace(out, r"<[^>]+>", " "), r"(?U)\s+", " "))


def _escaped(word: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+?^$|/-" else c for c in word)


def keyword_pattern(keyword: str) -> str:
    """A pattern for a keyword as a whole word among Latin letters and digits, regular endings allowed; a side that is no letter or digit of any script has no boundary."""
    word = keyword.lower()
    # fixed value: the endings
    ends = r"(?:e?s|e?d|ing)?" if word[-1:].isalnum() else ""
    left = r"(?:^|[^a-z0-9])" if word[:1].isalnum() else ""
    right = r"(?:$|[^a-z0-9])" if word[-1:].isalnum() else ""
    return f"{left}{_escaped(word)}{ends}{right}"


def find_keywords(text: Column, keywords: list[str]) -> Column:
    """Keywords found in normalized text, in the list's order."""
    # a match holds the word itself: looking for that first is cheaper than the pattern
    hits = [F.when(F.contains(text, F.lit(k.lower())) & text.rlike(keyword_pattern(k)), F.lit(k)) for k in keywords]
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")


def drop_overlapping(found: Column, keywords: list[str]) -> Column:
    """Keywords that no other found keyword contains as words; which contain which is known beforehand."""
    import re

    inside = {k: [o for o in keywords if o != k and re.search(keyword_pattern(k), o.lower())] for k in keywords}
    inside = {k: v for k, v in inside.items() if v}
    if not inside:
        return found
    larger = F.create_map(*[x for k, v in inside.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.filter(found, lambda k: ~F.coalesce(F.arrays_overlap(F.element_at(larger, k), found), F.lit(False)))


#: Fixed value: a publisher's name at a headline's end.
_PUBLISHER = r"\s+[-–|]\s+([^-–|]{2,60})$"


def publisher_of(title: Column) -> Column:
    """The name after the last dash or bar of a headline; empty if there is none."""
    return F.btrim(F.regexp_extract(F.coalesce(title, F.lit("")), _PUBLISHER, 1))


def without_publisher(title: Column) -> Column:
    return F.btrim(F.regexp_replace(F.coalesce(title, F.lit("")), _PUBLISHER, ""))


def remove_publisher(summary: Column, publisher: Column) -> Column:
    """A summary without the publisher's name at its end and the marks before that."""
    ends = (publisher != "") & F.endswith(summary, publisher)
    return F.when(ends, F.regexp_replace(F.left(summary, F.length(summary) - F.length(publisher)), r"[\s\-–|]+$", "")).otherwise(summary)


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two arrays' elements; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def char_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 0 where both are empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(0.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def domain_of(url: Column) -> Column:
    """Network place of a URL, lower case, without a leading www.; user and port stay."""
    return F.regexp_replace(F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1), r"^www\.", "")


#: Top-level domains that give a country (their letters in upper case, uk apart), country domains in general use, and second levels of registries.
COUNTRY_DOMAINS = (
    "id my sg au nz uk ie in pk bd lk jp kr cn hk tw th vn ph de fr es it nl be ch at pl cz se no dk fi pt br mx ar cl co ca us ru ua tr il ae sa eg za ng ke"
).split()
GENERIC_DOMAINS = "co tv me cc fm ly io ai gg to ws".split()
SECOND_LEVELS = "com net org gov edu ac co mil or go web".split()


def country_of(domain: Column, countries: list[str] = COUNTRY_DOMAINS) -> Column:
    """Country by the last label, else 'unknown'; country domains in general use count only below a registry's second level."""
    labels = F.split(F.lower(F.coalesce(domain, F.lit(""))), r"\.")
    last, second = F.element_at(labels, -1), F.try_element_at(labels, F.lit(-2))
    generic = last.isin(*GENERIC_DOMAINS) & ~((F.size(labels) > 2) & second.isin(*SECOND_LEVELS))
    known = (F.size(labels) > 1) & last.isin(*countries) & ~generic
    return F.when(known, F.when(last == "uk", "GB").otherwise(F.upper(last))).otherwise("unknown")


def normalize_entity(x: Column) -> Column:
    """A name for matching: lower case, quotes dropped, brackets and stops as spaces."""
    return normalize_text(F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), "[\"'`’“”]", ""), "[(),;:]", " "))


def unknown_to_null(x: Column, values: tuple[str, ...] = UNKNOWN_WIDE) -> Column:
    known = F.lower(F.btrim(x)) if values is UNKNOWN_WIDE else x
    return F.when(known.isin(*values), F.lit(None).cast("string")).otherwise(x)


def split_values(x: Column) -> Column:
    """Values of a field parted by ; , or |, known ones of at most 300 characters, in order, once each."""
    parts = F.transform(F.split(F.coalesce(x, F.lit("")), "[;,|]"), lambda v: F.btrim(v))
    return F.array_distinct(F.filter(parts, lambda v: ~F.lower(v).isin(*UNKNOWN_WIDE) & (F.length(v) <= 300)))


def field_similarity(a: Column, b: Column) -> Column:
    """Null if either is unknown, 1 if equal once normalized, else the Jaccard index of their space tokens."""
    known = unknown_to_null(a).isNotNull() & unknown_to_null(b).isNotNull()
    return F.when(known, F.when(normalize_text(a) == normalize_text(b), F.lit(1.0)).otherwise(jaccard(space_tokens(a), space_tokens(b))))


def indicators(text: Column) -> Column:
    """CVE numbers (upper case) and MD5, SHA-1, SHA-256 values (lower case), in that order, once each."""
    find = lambda p: F.regexp_extract_all(text, F.lit(p), 1)
    cves = F.transform(find(r"(?i)\b(CVE-\d{4}-\d{4,7})\b"), lambda v: F.upper(v))
    return F.array_distinct(F.concat(cves, *[F.transform(find(rf"\b([A-Fa-f0-9]{{{n}}})\b"), lambda v: F.lower(v)) for n in (32, 40, 64)]))


#: Common words by which a short text's language is guessed.
STOP_WORDS = {
    "id": "dan yang dari dengan untuk serangan siber keamanan peretas ini itu akan telah".split(),
    "en": "the and of with cyber security attack hackers this that from".split(),
}


def guess_language(text: Column) -> tuple[Column, Column]:
    """(language, confidence): that of which the text has more distinct common words at 0.6, unknown at 0.3 if both are equal."""
    words = F.split(normalize_text(text), " ")
    count = {k: F.size(F.array_intersect(words, F.array(*map(F.lit, v)))) for k, v in STOP_WORDS.items()}
    found = F.when(count["id"] > count["en"], "id").when(count["en"] > count["id"], "en").otherwise("unknown")
    return found, F.when(count["id"] == count["en"], 0.3).otherwise(0.6)


def og_image(html: Column) -> Column:
    """The address of a page's preview image: og:image, then og:image:url, then twitter:image."""
    def one(name: str) -> Column:
        tag = F.regexp_extract(html, rf'(?is)(<meta[^>]+(?:property|name)=["\']{name}["\'][^>]*>)', 1)
        return F.nullif(F.regexp_extract(tag, r'(?is)content=["\']([^"\']*)["\']', 1), F.lit(""))

    return F.replace(F.coalesce(one("og:image"), one("og:image:url"), one("twitter:image")), F.lit("&amp;"), F.lit("&"))
