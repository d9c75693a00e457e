"""Many phrases in texts by one automaton (G-01 to G-03, T-01, T-05, T-07).

All phrases, some hundreds or many thousands, of all kinds, are found in one pass over a text: an Aho-Corasick automaton gives every place where one ends.  What is kept is
what an alternation of the phrases, longest first, would match from left to right: a phrase stands alone (no letter, digit or mark of `joined` beside it), of phrases
that start at one place the longest counts, and none overlaps one before it.  A phrase may need one of some words directly before it, and may be ruled out by a word behind
it; kinds, and phrases with and without such a need, don't hide each other."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases that one automaton may hold, and a list that is worth one: an automaton takes some 650 bytes a phrase in each worker, twice that while the next task builds its
#: own.  A longer list, or one that grows with the texts, meets them by a join of phrases (geo.mentions).
MOST_PHRASES, LISTED = 500_000, 50_000


class Phrase(NamedTuple):
    phrase: str
    label: str
    kind: str = ""
    folded: bool = True
    before: tuple[str, ...] = ()
    unless: str = ""


def fold(text: str) -> str:
    """Lower case, character by character, so that places stay the same."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Matcher:
    """Finds phrases; joined: marks that tie a phrase to what is beside them, as letters and digits do."""

    def __init__(self, phrases: list[Phrase], joined: str = "_-"):
        import ahocorasick

        self.joined, self.machines = frozenset(joined), {}
        for folded in (False, True):
            own: dict[str, list[Phrase]] = {}
            for p in phrases:
                if p.folded == folded and p.phrase:
                    own.setdefault(fold(p.phrase) if folded else p.phrase, []).append(p)
            if own:
                machine = ahocorasick.Automaton()
                for key, same in own.items():
                    machine.add_word(key, (len(key), same))
                machine.make_automaton()
                self.machines[folded] = machine

    def _tied(self, text: str, at: int) -> bool:
        return 0 <= at < len(text) and (text[at].isalnum() or text[at] in self.joined)

    def _after_word(self, low: str, start: int, words: tuple[str, ...]) -> int | None:
        """Where the word begins that must stand directly before `start`, parted by white space."""
        gap = len(low[:start].rstrip()) if start and low[start - 1].isspace() else None
        if not gap:
            return None
        # as in an alternation, the first of the words that stands there counts
        return next((gap - len(w) for w in words if low.endswith(w, 0, gap) and not (gap > len(w) and (low[gap - len(w) - 1].isalnum() or low[gap - len(w) - 1] == "_"))), None)

    def find(self, text: str) -> list[tuple[int, int, Phrase]]:
        """(start, end, phrase) of all that stand, by start."""
        low, hits = fold(text), []
        for folded, machine in self.machines.items():
            for last, (size, same) in machine.iter(low if folded else text):
                start, end = last - size + 1, last + 1
                if self._tied(text, end):
                    continue
                for p in same:
                    begin = self._after_word(low, start, p.before) if p.before else start if not self._tied(text, start - 1) else None
                    if begin is None:
                        continue
                    rest = text[end : end + 64].lstrip()
                    if p.unless and len(rest) < len(text[end : end + 64]) and rest.startswith(p.unless):
                        continue
                    hits.append((begin, -size, start, end, p))
        hits.sort(key=lambda h: (h[0], h[1], h[4]))
        past: dict[tuple, tuple[int, str]] = {}
        out = []
        for begin, _, start, end, p in hits:
            group = p.kind, bool(p.before), p.folded
            if begin >= past.get(group, (0,))[0]:
                past[group] = (end,)
                out.append((start, end, p))
        return sorted(out, key=lambda h: h[:2])


def find(texts: DataFrame, phrases: DataFrame | list[Phrase], joined: str = "_-") -> DataFrame:
    """(id, text) to (id, kind, label, phrase, start, end) of all phrases that stand in the texts.

    phrases: Phrase rows, or a DataFrame with their columns (before: array), of at most MOST_PHRASES rows.  A null text has none."""
    if isinstance(phrases, DataFrame):
        rows = phrases.limit(MOST_PHRASES + 1).collect()
        if len(rows) > MOST_PHRASES:
            raise ValueError(f"more than {MOST_PHRASES} phrases: let phrases and texts meet by a join (geo.mentions)")
        phrases = [Phrase(**{k: tuple(v) if isinstance(v, list) else v for k, v in r.asDict().items() if v is not None}) for r in rows]

    def run(batches) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(phrases, joined)
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for start, end, p in matcher.find(text or ""):
                    for x, v in zip(out, (key, p.kind, p.label, p.phrase, start, end)):
                        x.append(v)
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names=["id", "kind", "label", "phrase", "start", "end"])

    return texts.select(F.col("id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "id long, kind string, label string, phrase string, start int, end int")
