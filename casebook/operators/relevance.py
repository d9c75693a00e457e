"""Rule-based relevance of a headline and summary, and categories by dictionary (T-01 to T-04)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from casebook.functions.text import drop_overlapping, find_keywords, normalize_text

RELEVANT, UNCERTAIN = 0.60, 0.40


def relevance(title: Column, summary: Column, attack: list[str], event: list[str], other: list[str], weak: list[str] = (), context: list[str] = ()) -> Column:
    """Struct of label, score, confidence and the matches.

    Attack words add .40, two of them .15 and four .10 more; event words .20; either in the headline .10 each; up to two words of other
    matters take .15 each.  Weak attack words alone, without a context word, don't count."""
    # both texts are normalized once a row, however many words are looked for
    norm = F.struct(normalize_text(title).alias("head"), normalize_text(summary).alias("rest"))
    given = F.transform(F.array(norm), lambda t: F.struct(t["head"].alias("head"), F.btrim(F.concat_ws(" ", t["head"], t["rest"])).alias("text")))
    return F.transform(given, lambda t: _judged(t["head"], t["text"], attack, event, other, weak, context))[0]


def _judged(head: Column, text: Column, attack: list[str], event: list[str], other: list[str], weak: list[str], context: list[str]) -> Column:
    """relevance() of normalized texts."""
    find = lambda where, words: drop_overlapping(find_keywords(where, list(words)), list(words))
    raw = F.struct(find(text, attack).alias("attack"), find(text, event).alias("event"), find(text, other).alias("other"), find(head, attack).alias("head_attack"),
                   find(head, event).alias("head_event"), (F.size(find_keywords(text, list(context))) > 0).alias("context"))

    def score(m: Column) -> Column:
        only_weak = (F.size(m["attack"]) > 0) & F.forall(m["attack"], lambda k: k.isin(*weak)) & ~m["context"] if weak else F.lit(False)
        n = F.when(only_weak, 0).otherwise(F.size(m["attack"]))
        points = (
            F.when(n > 0, 40).otherwise(0) + F.when(n >= 2, 15).otherwise(0) + F.when(n >= 4, 10).otherwise(0) + F.when(F.size(m["event"]) > 0, 20).otherwise(0)
            + F.when(~only_weak & (F.size(m["head_attack"]) > 0), 10).otherwise(0) + F.when(F.size(m["head_event"]) > 0, 10).otherwise(0) - 15 * F.least(F.size(m["other"]), F.lit(2))
        )
        value = F.greatest(F.lit(0), F.least(F.lit(100), points)) / 100
        label = F.when(value >= RELEVANT, "RELEVANT").when(value >= UNCERTAIN, "UNCERTAIN").otherwise("NOT_RELEVANT")
        none = F.array().cast("array<string>")
        return F.struct(label.alias("label"), F.round(value, 4).alias("score"), F.round(F.abs(value - 0.5) * 2, 4).alias("confidence"),
                        F.when(only_weak, none).otherwise(m["attack"]).alias("attack_matches"), m["event"].alias("event_matches"), m["other"].alias("other_matches"))

    empty = F.struct(F.lit("NOT_RELEVANT").alias("label"), F.lit(0.0).alias("score"), F.lit(0.0).alias("confidence"), *[F.array().cast("array<string>").alias(f"{k}_matches") for k in ("attack", "event", "other")])
    return F.when(text == "", empty).otherwise(F.transform(F.array(raw), score)[0])


def categories(text: Column, dictionary: dict[str, list[str]], unknown: str = "UNKNOWN") -> Column:
    """Categories with a word in the text, in the dictionary's order, comma-joined (T-02)."""
    hits = [F.when(F.size(find_keywords(text, words)) > 0, F.lit(name)) for name, words in dictionary.items()]
    found = F.array_join(F.array_compact(F.array(*hits)), ", ")
    return F.when(found == "", unknown).otherwise(found)


def attack_types(text: Column, first: dict[str, list[str]], fallback: dict[str, list[str]], generic: str) -> Column:
    """Specific categories, else fallback ones, the generic one only if alone (T-03)."""
    own, rest = categories(text, first), categories(text, fallback)
    alone = F.array_join(F.filter(F.split(rest, ", "), lambda c: c != generic), ", ")
    return F.when(own != "UNKNOWN", own).when((rest != "UNKNOWN") & (alone != ""), alone).otherwise(rest)
