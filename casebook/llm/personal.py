"""Personal data in texts: anchors found by one automaton, expanded and checked by small parsers.

An Aho-Corasick automaton over all anchors (at-sign, plus, digits, "://", words that announce an identifier) passes a
text once.  Where an anchor stands, its parser walks to both sides over the characters that its kind allows and checks
what it has: labels of a domain, parts of an address, check digits.  Parsers read a place a fixed number of times, so the work grows with
a text's length alone.

email, ip, card, phone: the forms of the contract, leftmost and not overlapping within a kind.  Added by the method:
url: an address with a scheme that names a user (user[:password]@host), up to its last character that isn't punctuation;
account: what follows a word of CUES: an IBAN with right check digits, a social security number of a valid range, a passport
number, or else 6 to 17 digits with single spaces or hyphens between them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.llm.common import release, table
from casebook.llm.vocab import slices

KINDS = ("email", "ip", "card", "phone", "url", "account")
BASE = 4
#: Words that announce an identifier, in lower case, with a capital, and in capitals.
CUES = ("iban", "account", "acct", "konto", "compte", "cuenta", "ssn", "passport")
#: What may stand between a cue and its identifier: these marks, and one of these words; CUE_REACH characters at most.
CUE_MARKS, CUE_WORDS, CUE_REACH = frozenset(" \t:#.=-"), ("number", "nummer", "numero", "num", "no", "nr", "is"), 16
SCHEMES = ("https", "http", "ftps", "sftp", "ftp", "ssh", "git")

_DIGIT = frozenset("0123456789")
_LETTER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_ALNUM = _DIGIT | _LETTER
_LOCAL, _LABEL = _ALNUM | frozenset("._%+-"), _ALNUM | frozenset("-")
_PHONE = _DIGIT | frozenset(" ().-")
_USER, _HOST, _PATH = _ALNUM | frozenset("._~%!$&*+,;=:-"), _ALNUM | frozenset(".-"), _ALNUM | frozenset("._~:/?#@!$&*+,;=%-")


def run(text: str, at: int, allowed: frozenset) -> int:
    """Where the run of allowed characters from `at` on ends."""
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def luhn(digits: str) -> bool:
    """Whether the last digit checks the others."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def iban(code: str) -> bool:
    """Whether a code's check digits are right: the remainder by 97 of its digits, the first four moved behind, is 1."""
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def email_at(text: str, at: int, least: int) -> tuple[int, int] | None:
    """The email around the at-sign, from `least` on: the longest local part before it, labels joined by full stops behind it, two at least."""
    start = at
    while start > least and text[start - 1] in _LOCAL:
        start -= 1
    if start == at:
        return None
    end = run(text, at + 1, _LABEL)
    if end == at + 1:
        return None
    labels = 1
    while text[end : end + 1] == "." and (stop := run(text, end + 1, _LABEL)) > end + 1:
        end, labels = stop, labels + 1
    return (start, end) if labels > 1 else None


def ips_at(text: str, at: int) -> tuple[list[tuple[int, int]], int]:
    """Addresses in the chain of digit runs joined by full stops that starts here, four runs each, and where the chain ends."""
    starts, ends = [at], [run(text, at, _DIGIT)]
    while text[ends[-1] : ends[-1] + 1] == "." and (stop := run(text, ends[-1] + 1, _DIGIT)) > ends[-1] + 1:
        starts.append(ends[-1] + 1)
        ends.append(stop)
    small = [int(text[max(a, b - 4) : b]) <= 255 and not text[a : max(a, b - 4)].strip("0") for a, b in zip(starts, ends)]
    return [(starts[i], ends[i + 3]) for i in range(0, len(starts) - 3, 4) if all(small[i : i + 4])], ends[-1]


def card_at(text: str, at: int) -> tuple[tuple[int, int] | None, int]:
    """The chain of digits with at most one space or hyphen between two that starts here, if it is a card number, and where it ends."""
    end = run(text, at, _DIGIT)
    while text[end : end + 1] in (" ", "-") and (stop := run(text, end + 1, _DIGIT)) > end + 1:
        end = stop
    if end - at > 37:
        return None, end
    digits = "".join(c for c in text[at:end] if c in _DIGIT)
    return ((at, end) if 12 <= len(digits) <= 19 and luhn(digits) else None), end


def phone_at(text: str, at: int) -> tuple[int, int] | None:
    """The number after a plus sign: a digit, then digits, brackets, spaces, points and hyphens up to the last digit."""
    if text[at + 1 : at + 2] not in _DIGIT:
        return None
    end = run(text, at + 2, _PHONE)
    while end > at + 3 and text[end - 1] not in _DIGIT:
        end -= 1
    if end < at + 4 or text[end - 1] not in _DIGIT:
        return None
    return (at, end) if 9 <= sum(c in _DIGIT for c in text[at:end]) <= 15 else None


def url_at(text: str, at: int, least: int) -> tuple[int, int] | None:
    """The address whose "://" stands here, if it names a user before its host."""
    scheme = next((s for s in SCHEMES if text[max(least, at - len(s)) : at] == s), None)
    if not scheme:
        return None
    user = run(text, at + 3, _USER)
    if user == at + 3 or text[user : user + 1] != "@":
        return None
    host = run(text, user + 1, _HOST)
    if not text[user + 1 : user + 2].isalnum() or host == user + 1:
        return None
    end = run(text, host, _PATH)
    while end > user + 2 and text[end - 1] in ".,;:!?&":
        end -= 1
    return at - len(scheme), end


def _free(text: str, at: int) -> bool:
    """No letter or digit stands here."""
    return not (0 <= at < len(text) and text[at].isalnum())


def code_at(text: str, at: int) -> tuple[int, int] | None:
    """The longest IBAN that starts here: two capitals, two digits, capitals and digits in groups, with right check digits."""
    if not ("A" <= text[at : at + 1] <= "Z" and "A" <= text[at + 1 : at + 2] <= "Z" and len(text) >= at + 15 and text[at + 2] in _DIGIT and text[at + 3] in _DIGIT):
        return None
    code, found, i = "", None, at
    while i < len(text) and len(code) < 34:
        if text[i] in _DIGIT or "A" <= text[i] <= "Z":
            code += text[i]
            i += 1
            if len(code) >= 15 and _free(text, i) and iban(code):
                found = at, i
        elif text[i] == " " and text[i + 1 : i + 2].isalnum():
            i += 1
        else:
            break
    return found


def account_at(text: str, end: int, cue: str) -> tuple[int, int] | None:
    """The identifier that a cue ending here announces."""
    at, stop = end, end + CUE_REACH
    while at < stop and text[at : at + 1] in CUE_MARKS and at < len(text):
        at += 1
    word = next((w for w in CUE_WORDS if text[at : at + len(w)].lower() == w and _free(text, at + len(w)) and len(text[at : at + len(w)].lower()) == len(w)), None)
    if word and at > end:
        at += len(word)
        while at < stop and at < len(text) and text[at] in CUE_MARKS:
            at += 1
    if at == end or at >= stop:
        return None
    if cue not in ("ssn", "passport") and (code := code_at(text, at)):
        return code
    if cue == "ssn":
        part = text[at : at + 11]
        good = len(part) == 11 and all(c in _DIGIT if i not in (3, 6) else c == "-" for i, c in enumerate(part)) and part[:3] not in ("000", "666") and part[0] != "9" and part[4:6] != "00" and part[7:] != "0000"
        return (at, at + 11) if good and _free(text, at + 11) else None
    if cue == "passport":
        first = at
        while first < at + 2 and "A" <= text[first : first + 1] <= "Z":
            first += 1
        last = run(text, first, _DIGIT)
        return (at, last) if 6 <= last - first <= 9 and _free(text, last) else None
    if text[at : at + 1] not in _DIGIT:
        return None
    last = run(text, at, _DIGIT)
    while text[last : last + 1] in (" ", "-") and (more := run(text, last + 1, _DIGIT)) > last + 1 and _free(text, more):
        last = more
    return (at, last) if 6 <= sum(c in _DIGIT for c in text[at:last]) <= 17 and last - at < 35 and _free(text, last) else None


def automaton():
    """All anchors; each gives (first character to act on, what it is, its length)."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for mark in ("@", "+", "://", *sorted(_DIGIT)):
        found.add_word(mark, ("digit" if mark in _DIGIT else mark, len(mark), ""))
    for cue in CUES:
        for form in (cue, cue.capitalize(), cue.upper()):
            found.add_word(form, ("cue", len(cue), cue))
    found.make_automaton()
    return found


def spans(text: str, anchors) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end) of all personal data in a text, in order; code points, ends exclusive."""
    out = []
    past = [0] * (len(KINDS) + 1)  # where each kind goes on
    for last, (what, length, cue) in anchors.iter(text):
        at = last - length + 1
        if what == "digit":
            if at >= past[1]:
                found, past[1] = ips_at(text, at)
                out += [(a, 1, b) for a, b in found]
            if at >= past[2]:
                found, past[2] = card_at(text, at)
                if found:
                    out.append((found[0], 2, found[1]))
            continue
        if what == "cue":
            kind, found = 5, account_at(text, last + 1, cue) if _free(text, at - 1) and at >= past[5] else None
        elif what == "@":
            kind, found = 0, email_at(text, at, past[0])
        elif what == "+":
            kind, found = 3, phone_at(text, at) if at >= past[3] else None
        else:
            kind, found = 4, url_at(text, at, past[4])
        if found:
            past[kind] = found[1]
            out.append((found[0], kind, found[1]))
    return sorted(out)


def spell(found: list[tuple[int, int, int]]) -> str:
    """kind:start:end of spans, comma-joined."""
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def mask(text: str, found: list[tuple[int, int, int]]) -> str:
    """The text with each run of overlapping spans replaced by the mark of its first kind."""
    out, at = [], 0
    for a, k, b in found:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def _each(batches, column: int, make):
    """make(text, spans) for all texts of the batches' column, slice by slice."""
    anchors = automaton()
    for batch in batches:
        for at, texts in slices(batch.column(column)):
            rows = [make(t, spans(t or "", anchors)) for t in texts.to_pylist()]
            yield batch.slice(at, len(texts)), rows
    release()


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, text) rows to doc_id, spans: array of (kind, start, end) in order.  A null text counts as empty; one row for each row."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run_(batches):
        for batch, rows in _each(batches, 1, lambda _, found: [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in found]):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["doc_id", "spans"])

    own = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run_, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind:string,start:long,end:long>>")


def masked(docs: DataFrame) -> DataFrame:
    """Rows of `docs` with personal data in the text masked, and n_chars, if there, counted anew where it changed; null texts and other columns stay as they are."""

    def run_(batches):
        for batch, rows in _each(batches, 1, lambda text, found: text if text is None or not found else mask(text, found)):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.string())], names=["row", "clean"])

    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text"))
    made = own.mapInArrow(run_, f"row {own.schema['row'].dataType.simpleString()}, clean string")
    new = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("clean").eqNullSafe(F.col("row.text")), F.col("row.n_chars")).otherwise(F.length("clean").cast(docs.schema["n_chars"].dataType))
    return made.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents: one row for each row, so repeated rows give repeated rows.

    A null or empty text has no spans and the digest of an empty string; a text of any length is scanned whole; a null doc_id stays null; of spans that start together the
    kinds' order decides, then the end; other columns don't matter; an empty table gives an empty table."""
    found = personal_data(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    text = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:BASE]))
    return found.select("doc_id", *[count(k) for k in KINDS[:BASE]], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), *[count(k) for k in KINDS[BASE:]])
