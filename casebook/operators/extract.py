"""Organisations, actors and tiered extraction from headline, summary and body (T-05 to T-08)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook.operators import phrases

#: Patterns of our own for organisations in reports, tried in order; group 1 is the name.
NAME = r"((?:[A-Z][\w&.'-]*)(?:\s+(?:of|and|for|the|[A-Z][\w&.'-]*)){0,5})"
ORGANISATION = (
    rf"{NAME}\s+(?:confirms|confirmed|discloses|disclosed|reports|reported|suffers|suffered|says|said)\b",
    rf"(?i:attack|breach|intrusion|leak)\s+(?:on|at|of|against)\s+{NAME}",
    rf"(?i:hackers?|attackers?|gang)\s+(?i:hit|hits|breached?|breach|target(?:s|ed)?|attack(?:s|ed)?)\s+{NAME}",
)
ACTOR = (rf"{NAME}\s+(?:ransomware|hacking|hacker)\s+(?:gang|group|operators?)", rf"(?:claimed|carried out|attributed)\s+(?:by|to)\s+{NAME}")
#: Words that are no names.
NOT_A_NAME = ("The", "This", "That", "It", "Hackers", "Attackers", "Police", "Government", "Researchers", "Experts", "Report", "Company", "Data", "Cyber")


#: The same in Indonesian: what befell a name, what was done to it, where it happened, what its owner says of it, what followed.
_ASSET = r"(?i:(?:server|situs|website|web|data|akun|sistem|aplikasi|basis|pribadi|pelanggan|nasabah|milik)\s+)*"
_NAME_ID = r"((?:[A-Z][\w&.'-]*)(?:\s+(?:dan\s+(?=[A-Z])|[A-Z0-9&][\w&.'-]*)){0,5})"
_INCIDENT_ID = r"(?i:peretasan|pembobolan|kebocoran|serangan|diretas|dibobol|bocor|dijebol|dibajak|disusupi|ransomware|phishing|insiden)"
ORGANISATION_ID = (
    rf"{_NAME_ID}\s+(?i:(?:diduga\s+)?(?:diretas|dibobol|diserang|dijebol|dibajak|disusupi)|kena\s+\w+|(?:jadi|menjadi)\s+korban)\b",
    rf"(?i:hacker|peretas|pelaku)\s+(?i:(?:diduga|klaim|mengklaim)\s+)*(?i:jebol|bobol|retas|serang|bajak|kuasai|menjebol|membobol|meretas|menyerang|menguasai)\s+{_ASSET}{_NAME_ID}",
    rf"(?i:peretasan|pembobolan|kebocoran|serangan|pencurian)\s+(?:[^\s.]+\s+){{0,6}}?(?i:di|pada|terhadap|menimpa)\s+{_ASSET}{_NAME_ID}",
    rf"(?i:peretasan|pembobolan|kebocoran)\s+{_ASSET}{_NAME_ID}",
    rf"{_NAME_ID}\s+(?i:bantah|membantah|akui|mengakui|sebut|menyebut|konfirmasi|mengonfirmasi|pastikan|memastikan|ungkap|mengungkap|cegah|mencegah|gagalkan|hadapi|alami|mengalami)\s+(?:[^\s.]+\s+){{0,6}}?{_INCIDENT_ID}",
    rf"{_NAME_ID}\s+(?:[^\s.]+\s+){{0,4}}?(?i:setelah|usai|akibat|imbas|pasca)\s+{_INCIDENT_ID}",
)
ACTOR_ID = (
    r"(?i:kelompok|geng|grup|sindikat)\s+(?i:hacker|peretas|ransomware|siber)\s+(?i:(?:bernama|berjuluk|asal\s+\w+)\s+)*[\"'“]?([A-Z][\w-]*(?:\s[A-Z0-9][\w-]*){0,2})",
    r"(?i:hacker|peretas|pelaku)\s+(?i:bernama|berjuluk|dijuluki|berinisial|yang\s+mengaku\s+sebagai)\s+[\"'“]?([A-Z][\w-]*(?:\s[A-Z0-9][\w-]*){0,2})",
    r"([A-Z][\w-]*(?:\s[A-Z0-9][\w-]*){0,2})\s(?i:mengaku|mengklaim|klaim)\s(?i:bertanggung\sjawab|meretas|membobol|menguasai|mencuri)",
)
#: Who reports or judges rather than suffers: a name that begins so is no organisation that was hit when it only says something.
REPORTERS = ("Polda", "Polres", "Polri", "Polisi", "Bareskrim", "Satgas", "BSSN", "Komdigi", "Kominfo", "OJK", "KPK", "Pakar", "Pengamat", "Peneliti", "Analis", "Menteri", "Presiden", "Gubernur", "DPR", "Interpol", "FBI", "CISA", "Kaspersky", "Microsoft", "Google")
#: Words of our own that are no names in Indonesian.
NOT_A_NAME_ID = ("Hacker", "Peretas", "Pelaku", "Data", "Situs", "Server", "Kasus", "Serangan", "Ini", "Itu", "Warga", "Pemerintah", "Perusahaan", "Korban", "Diduga", "Kebocoran", "Peretasan", "Pembobolan")


def _tidy(names: Column) -> Column:
    """Names without an article before, connecting words or stops behind."""
    return F.transform(names, lambda n: F.btrim(F.regexp_replace(F.regexp_replace(n, r"(?:\s+(?:of|and|for|the)|[\s.,'&-]+)+$", ""), r"^(?:The|the)\s+", "")))


def name_in(text: Column, patterns: tuple[str, ...], rejected: tuple[str, ...] = NOT_A_NAME) -> Column:
    """The first acceptable name: patterns in order, of each its matches in order; null if none."""
    found = F.concat(*[F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), 1) for p in patterns])
    return F.get(F.filter(_tidy(found), lambda n: (n != "") & ~n.isin(*rejected) & (F.length(n) <= 60)), F.lit(0))


def names_in(text: Column, patterns: tuple[str, ...], most: int = 3) -> Column:
    """Up to `most` names, once each whatever their case, in order."""
    found = F.concat(*[F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), 1) for p in patterns])
    ok = F.filter(_tidy(found), lambda n: (n != "") & ~n.isin(*NOT_A_NAME))
    first = F.filter(ok, lambda n, i: F.array_position(F.transform(ok, lambda o: F.lower(o)), F.lower(n)) == i + 1)
    return F.slice(first, 1, most)


def tiered(title: Column, summary: Column, content: Column, find, longest: int = 3000) -> Column:
    """Struct of value and confidence: headline .9, else summary .8, else the body's beginning .6 (T-06)."""
    tiers = [(find(title), 0.9), (find(summary), 0.8), (find(F.substring(F.coalesce(content, F.lit("")), 1, longest)), 0.6)]
    value = F.coalesce(*[v for v, _ in tiers])
    confidence = F.coalesce(*[F.when(v.isNotNull(), F.lit(c)) for v, c in tiers])
    return F.struct(value.alias("value"), confidence.alias("confidence"))


def extraction_confidence(*values: Column) -> Column:
    """Known fields of all (T-08)."""
    return sum((F.when(v.isNotNull() & (v != "UNKNOWN"), 1).otherwise(0) for v in values), F.lit(0)) / len(values)


def fill_unknown(old: Column, new: Column) -> Column:
    """A later source fills what is unknown and overwrites nothing (T-09)."""
    return F.when(old.isNull() | old.isin("", "UNKNOWN"), F.coalesce(new, old)).otherwise(old)


def organisation(text: Column, language: Column) -> Column:
    """The first acceptable organisation by the rules of a text's language: Indonesian ones for id, English ones else (T-05).

    Where an Indonesian name only says something, one that begins with a word of REPORTERS is passed over."""
    said = F.concat(*[F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), 1) for p in ORGANISATION_ID[:4]])
    stated = F.concat(*[F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), 1) for p in ORGANISATION_ID[4:]])
    own = F.concat(said, F.filter(stated, lambda n: ~F.split_part(n, F.lit(" "), F.lit(1)).isin(*REPORTERS)))
    found = F.get(F.filter(_tidy(own), lambda n: (n != "") & ~n.isin(*NOT_A_NAME_ID) & ~n.isin(*NOT_A_NAME) & (F.length(n) <= 60)), F.lit(0))
    return F.when(language == "id", found).otherwise(name_in(text, ORGANISATION))


def actors(texts: DataFrame, known: list[str], most: int = 3) -> DataFrame:
    """(id, text) to (id, actors): known names that stand in the text, longest first where they overlap, then names by the patterns of both languages, `most` at most, once
    each whatever their case, comma-joined; null if none (T-07)."""
    listed = phrases.find(texts, [phrases.Phrase(n, n, "actor", False) for n in known]).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("start", "phrase"))), lambda x: x["phrase"]).alias("listed"))
    met = texts.select("id", "text").join(listed, "id", "left")
    named = F.concat(*[F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(p), 1) for p in (*ACTOR, *ACTOR_ID)])
    every = F.concat(F.coalesce("listed", F.array().cast("array<string>")), F.filter(_tidy(named), lambda n: (n != "") & ~n.isin(*NOT_A_NAME) & ~n.isin(*NOT_A_NAME_ID)))
    first = F.transform(F.array(every), lambda a: F.filter(a, lambda n, i: F.array_position(F.transform(a, lambda o: F.lower(o)), F.lower(n)) == i + 1))[0]
    return met.select("id", F.nullif(F.array_join(F.slice(first, 1, most), ", "), F.lit("")).alias("actors"))
