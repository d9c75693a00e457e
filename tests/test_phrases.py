"""The automaton against alternations of regular expressions, and the forms of place names."""

import random
import re

from casebook.operators import geo, phrases
from casebook.operators.phrases import Phrase

CONTEXT = ("in", "from", "city of")


def plain(rows, text):
    """finditer over an alternation of each kind's phrases, longest first, plain ones and those that need a word before them apart."""
    out = []
    for kind, needs in sorted({(p.kind, bool(p.before)) for p in rows}):
        own = {p.phrase: p for p in rows if p.kind == kind and bool(p.before) == needs}
        names = "|".join(re.escape(n) for n in sorted(own, key=len, reverse=True))
        flags = re.I if next(iter(own.values())).folded else 0
        if needs:
            before = "|".join(map(re.escape, CONTEXT))
            found = re.finditer(rf"(?i:\b(?:{before}))\s+({names})(?![\w-])(?!\s+Jaya)", text, flags)
        else:
            found = re.finditer(rf"(?<![\w-])({names})(?![\w-])", text, flags)
        low = {k.lower(): k for k in own}
        out += [(m.start(1), m.end(1), kind, m[1] if m[1] in own else low[m[1].lower()]) for m in found]
    return sorted(out)


def test_hundreds_of_phrases_as_regular_expressions_find_them(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("bdlnrst") + rng.choice("aeiou") for _ in range(rng.randint(1, 3))).capitalize() for _ in range(60)]
    name = lambda: rng.choice([" ", " ", "-"]).join(rng.choice(words) for _ in range(rng.randint(1, 3)))
    places = {name() for _ in range(300)}
    odd = set(rng.sample(sorted(places), 60))
    rows = [Phrase(n, n.upper(), "place", False, CONTEXT if n in odd else (), "Jaya" if n in odd else "") for n in sorted(places)]
    rows += [Phrase(n.lower(), n, "keyword") for n in sorted({name() for _ in range(200)})]
    link = [" ", " ", " ", ", ", "-", "  ", "\n", "_", " in ", " from ", " IN  ", " city of ", " within ", " Jaya ", ".", "é"]
    texts = [(i, "".join(x for _ in range(rng.randint(0, 40)) for x in (rng.choice(words) if rng.random() < 0.9 else rng.choice(words).upper(), rng.choice(link)))) for i in range(400)]
    found = phrases.find(spark.createDataFrame([*texts, (999, None)], "id long, text string"), rows).collect()
    got = {i: sorted((r["start"], r["end"], r["kind"], r["phrase"]) for r in found if r["id"] == i) for i, _ in texts}
    assert all(got[i] == plain(rows, t) for i, t in texts) and len(found) > 2000 and {bool(r["phrase"] in odd) for r in found if r["kind"] == "place"} == {True, False}


def test_place_names(spark):
    provinces = spark.createDataFrame([("31", "Jakarta"), ("31", "Metro Jaya"), ("35", "Jatim"), ("33", "Banten Lama")], "province string, name string")
    cities = spark.createDataFrame([("35", "1", "Kota Malang"), ("35", "2", "Kabupaten Malang"), ("34", "1", "Kabupaten Kulon Progo"), ("33", "9", "Kabupaten Banjar"), ("35", "8", "Kota Banjar"), ("18", "3", "Kota Metro"), ("33", "7", "Kota Jakarta")],
                                   "province string, city string, name string")
    made = geo.place_phrases(provinces, cities, spark.createDataFrame([("Malang",), ("Metro",)], "name string"), "Jaya")
    label = {r["phrase"]: (r["label"], bool(r["before"])) for r in made.collect()}
    assert label["Jakarta"] == ("31", False) and label["Kota Jakarta"] == ("33/7", False) and label["Kab. Malang"] == ("35/2", False) and label["Malang"] == ("35/1", True) and "Banjar" not in label
    assert label["Kulonprogo"] == label["KulonProgo"] == label["Kulon Progo"] == label["Kab. Kulon Progo"] == ("34/1", False)
    texts = [(1, "Polda Metro Jaya menahan pelaku"), (2, "warga Kota Metro dan kota Metro"), (3, "nasib malang Malang"), (4, "dari Malang ke Kulonprogo"), (5, "in Metro Jaya")]
    found = phrases.find(spark.createDataFrame(texts, "id long, text string"), made)
    assert sorted((r["id"], r["label"]) for r in found.collect()) == [(1, "31"), (2, "18/3"), (2, "18/3"), (2, "18/3"), (4, "34/1"), (4, "35/1"), (5, "31")]  # a full name counts, and so does its own name behind a word of place
