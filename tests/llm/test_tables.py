"""Centroid clustering, source divergence and personal data against brute force, on odd rows too."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from casebook.llm import centroids, divergence, personal

# -- centroids ---------------------------------------------------------------------------------------------------------


def plain_clusters(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    now = [v for _, v in seeds]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(now))
    for _ in range(rounds):
        home = [near(v)[1] for _, v in kept]
        for j in range(len(now)):
            own = [v for (_, v), h in zip(kept, home) if h == j]
            if own:
                now[j] = [sum(x) // len(own) for x in zip(*own)]
    return sorted((i is not None, i or 0, near(v)[1], near(v)[0]) for i, v in kept), now


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(1)
    base = [[rng.gauss(0, 0.3) for _ in range(64)] for _ in range(5)]
    rows = [(i, [x + rng.gauss(0, 0.05) for x in rng.choice(base)]) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(40)] + [(100, rows[0][1]), (None, rows[3][1])]  # copies, one of an id that is there already, and one without
    return rows + [(200, None), (201, rows[0][1][:63]), (202, [None, *rows[0][1][1:]]), (203, [float("nan")] * 64), (204, [float("inf")] * 64), (205, []), (206, [0.0] * 64), (207, [-0.0009765625] * 64)]


def table_of(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster string")


@pytest.mark.parametrize("page", [9, 8192])
def test_clusters_are_the_plain_ones(spark, vectors, monkeypatch, page):
    monkeypatch.setattr(centroids.write_pages, "__defaults__", (page,))
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in vectors]
    want, final = plain_clusters(exact)
    found, got = centroids.cluster_vectors(table_of(spark, vectors).repartition(3))
    assert sorted((r["vec_id"] is not None, r["vec_id"] or 0, r["cluster"], r["distance"]) for r in found.collect()) == want and got.tolist() == final


def test_few_and_no_vectors(spark, vectors, tmp_path):
    found, final = centroids.cluster_vectors(table_of(spark, vectors[:3]))
    assert sorted((r["cluster"], r["distance"]) for r in found.collect()) == [(0, 0), (1, 0), (2, 0)] and len(final) == 3
    table_of(spark, vectors[:0]).write.parquet(str(tmp_path / "embeddings.parquet"))
    empty = centroids.op11_centroid_clustering(spark, str(tmp_path))
    assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_dictionaries_lose_nothing():
    rng = np.random.default_rng(2)
    wide = np.repeat(rng.integers(-500, 500, (6, 64)), 20, axis=0)  # six vectors twenty times each: the widest blocks do
    mixed = np.concatenate([wide[:, :16], rng.integers(-500, 500, (120, 48))], axis=1)
    for vectors_, first in ((wide, 16), (mixed, 16), (rng.integers(-9, 9, (50, 64)), 1)):
        blocks = centroids.dictionary_blocks(vectors_)
        assert blocks[0][1] == first and sum(b[1] for b in blocks) == 64
        assert (np.concatenate([distinct[codes] for _, _, distinct, codes in blocks], axis=1) == vectors_).all()


def test_components_without_an_exact_distance():
    with pytest.raises(ValueError):
        centroids.integers(np.full((1, 64), 2.0e5))


# -- divergence --------------------------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain_divergence(rows, least, top):
    rows = [(t or "", a or "", s or "") for t, a, s in rows]
    terms = [(a, s, TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))) for t, a, s in rows]
    out = []
    for lang in {a for _, a, _ in rows}:
        df = Counter(w for a, _, ws in terms if a == lang for w in set(ws))
        kept = sorted(w for w, n in df.items() if n >= least)
        counts = {s: Counter() for _, a, s in rows if a == lang}
        for a, s, ws in terms:
            if a == lang:
                counts[s].update(w for w in ws if w in set(kept))
        shares = lambda c: {w: 1 + 1_000_000_000 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept)) for w in kept}
        p = {s: shares(c) for s, c in counts.items()}
        q = shares(sum(counts.values(), Counter()))
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in counts:
            pairs = [(-sum(f(p[s][w], p[o][w]) for w in kept), o.encode(), o) for o in counts if o != s]
            words = [(-f(p[s][w], q[w]), w.encode(), w) for w in kept if counts[s][w] and p[s][w] > q[w]]
            for part, ranked in (("pair", sorted(pairs)), ("term", sorted(words)[:top])):
                out += [(lang, s, part, item, -v, i + 1) for i, (v, _, item) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize(("sources", "terms"), [(64, 8192), (3, 4)])
def test_divergence_is_the_plain_one(spark, monkeypatch, sources, terms):
    monkeypatch.setattr(divergence, "SOURCES", sources)
    monkeypatch.setattr(divergence, "TERMS", terms)
    rng = random.Random(3)
    words = ["Über", "naïve", "the", "The", "x1y", "a-b", "日本語", "no\u00a0break", "tab", "end.", "\u0085", "😀", "_", "42"] + [f"w{chr(97 + i)}" for i in range(26)]
    rows = [(" ".join(rng.choice(words) + rng.choice(["", ",", "!", "'s"]) for _ in range(rng.randint(0, 25))).replace("tab", "\t"), rng.choice(["en", "de", None, ""]), rng.choice([None, *(f"s{k}" for k in range(7))])) for _ in range(150)]
    rows += [(None, "en", "only null"), ("", "xx", "a"), (" \n ", "xx", "b"), ("solo solo", "yy", "one")] + [("Same text again", "de", "s1")] * 12 + [("x" * 200_000 + " the", "en", "s2")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "text string, lang string, source string, docs int").repartition(5)
    found = sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in divergence.divergence(df, 3, 4).collect())
    assert found == plain_divergence(rows, 3, 4) and any(r[4] for r in found)


def test_divergence_of_nothing(spark, none):
    assert divergence.divergence(none).count() == 0


def test_blocks_hold_about_so_many_bytes(spark):
    df = spark.createDataFrame([("ab cd " * 50, "en", "s")] * 40 + [("x " * 5000, "en", "s")], "text string, lang string, source string").coalesce(1)
    blocks = divergence.chunk_blocks(df, 3, 1000).where("kind = 0").collect()
    assert len(blocks) >= 14 and sum(len(divergence.unpack(r["a"])) for r in blocks) == 41


# -- personal data -----------------------------------------------------------------------------------------------------

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    odd = lambda d: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(t) if 12 <= len(digits(m)) <= 19 and not odd(digits(m))]
    return sorted(out + [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 9 <= len(digits(m)) <= 15])


def test_parsers_find_what_the_patterns_find():
    rng, anchors = random.Random(4), personal.automaton()
    parts = ["0", "1", "2", "9", "25", "0255", ".", ".", "-", " ", "+", "@", "a", "b.c", "(", ")", "é", "\n", "%", "://", "http", "4111111111111111", "account ", "\u0663"]
    for _ in range(30_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        assert [s for s in personal.spans(text, anchors) if s[1] < personal.BASE] == base_spans(text)


@pytest.mark.parametrize(("text", "want"), [
    ("IBAN: DE89 3704 0044 0532 0130 00 and", "account:6:33"), ("IBAN: DE88 3704 0044 0532 0130 00", ""), ("account number 12-345-678.", "account:15:25"), ("Account is open", ""), ("myaccount 12345678", ""),
    ("ssn 123-45-6789", "account:4:15"), ("SSN 000-45-6789", ""), ("Passport No. AB1234567", "account:13:22"), ("account 12345", ""), ("account 1234567x", ""), ("https://joe:pw@host.example/x?y=1.", "url:0:33,email:12:27"),
    ("see http://host.example/a@b", ""), ("ftp://me@[host]", ""), ("x://me@host", ""), ("", ""), ("account", ""), ("mail me@x.org, ring +49 (30) 1234567", "email:5:13,phone:20:36")])
def test_kinds_of_the_method(text, want):
    assert personal.spell(personal.spans(text, personal.automaton())) == want


def test_masks_and_odd_rows(spark, edge, none):
    df = spark.createDataFrame([(1, "a me@x.org b 1.2.3.4", 20, "x"), (None, None, 0, "x"), (3, "fine", 9, None)], "doc_id long, text string, n_chars int, row string")
    found = {r["doc_id"]: r for r in personal.masked(df).collect()}
    assert (found[1]["text"], found[1]["n_chars"]) == ("a [EMAIL] b [IP]", 16) and found[None]["text"] is None and found[3]["n_chars"] == 9 and personal.masked(df).columns == df.columns
    assert personal.masked(edge).count() == edge.count() and personal.masked(none).count() == 0 == personal.personal_data(none).count()
    assert all(not r["spans"] for r in personal.personal_data(edge).collect())


def test_query_of_personal_data(spark, tmp_path):
    long = "word " * 50_000 + "me@x.org"
    spark.createDataFrame([(1, "call +1 (017) 555-7713 now"), (2, None), (2, None), (4, long)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = sorted(personal.op13_personal_data(spark, str(tmp_path)).collect(), key=lambda r: r["doc_id"])
    assert [(r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["spans"]) for r in rows] == [(1, 0, 0, 0, 1, "phone:5:22"), (2, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, ""), (4, 1, 0, 0, 0, "email:250000:250008")]
    assert all(r["base_sha256"] == hashlib.sha256(r["spans"].encode()).hexdigest() for r in rows)


def test_work_grows_with_the_text():
    import time

    anchors = personal.automaton()
    for piece in ("@", "a@", "1.", "+1 ", "http://a", "account 1 ", "1 ", "iban AB12"):
        took = []
        for n in (40_000, 80_000):
            began = time.perf_counter()
            personal.spans(piece * n, anchors)
            took.append(time.perf_counter() - began)
        assert took[1] < 4 * took[0] + 0.2, piece
