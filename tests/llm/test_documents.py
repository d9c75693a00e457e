"""Fingerprints, quality rules, secrets, chat, URL lists, toxicity, the Jaccard join and the pipeline on small and odd input."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from casebook.llm import chat, fingerprints, jaccard_join, quality, secrets, toxicity, url_filters

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k=5):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def prose(rng, n):
    return " ".join("".join(rng.choice("aeiou") + rng.choice("bdlnrst") for _ in range(rng.randint(1, 3))) for _ in range(n))


# -- fingerprints ------------------------------------------------------------------------------------------------


def test_sketch_is_exact_below_k_and_close_above():
    rng = random.Random(1)
    for n in (0, 1, 4, 5, 60, 3000):
        a = prose(rng, n)
        b = a[: 3 * len(a) // 4] + prose(rng, n // 3)
        x, y = fingerprints.sketch_arrays([a.encode(), b.encode()])
        want = jaccard(shingles(a), shingles(b))
        assert fingerprints.resemblance(x, y) == pytest.approx(want, abs=1e-9 if len(shingles(a) | shingles(b)) <= fingerprints.K else 0.15)
        assert fingerprints.distinct_shingles(x) == pytest.approx(len(shingles(a)), rel=0.3)
        assert (fingerprints.from_text(fingerprints.to_text(x)) == x).all()


def test_sketches_merge():
    rng = random.Random(2)
    a, b = prose(rng, 500), prose(rng, 700)
    x, y = fingerprints.sketch_arrays([a.encode(), b.encode()])
    hashes = np.unique(np.concatenate([fingerprints.shingle_hashes(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0] for t in (a, b)]))
    assert (fingerprints.merge(x, y) == hashes[: fingerprints.K]).all()
    assert fingerprints.containment(x, fingerprints.merge(x, y)) > 0.8


def test_fingerprints_edge_rows(spark, edge, none):
    found = fingerprints.fingerprint(edge).collect()
    prints = {r["doc_id"]: r["fingerprint"] for r in found}
    assert len(found) == edge.count() and prints[6] == prints[7] and prints[1] == prints[2] == prints[3] == ""
    merged = fingerprints.merge_fingerprints(fingerprints.fingerprint(edge).join(edge.select("doc_id", "source").distinct(), "doc_id"), "source")
    assert merged.count() == 3
    assert fingerprints.fingerprint(none).count() == 0 and fingerprints.compare_with_next(none).count() == 0


def test_next_document(spark, edge, edge_rows):
    given = [(i, t) for i, t in edge_rows if i != 7]
    found = {r["doc_id"]: r for r in fingerprints.compare_with_next(edge.where("doc_id <> 7")).collect()}
    for k, (i, t) in enumerate(given):
        t, nxt = t or "", given[(k + 1) % len(given)][1] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + nxt[:q]
        assert found[i]["n_chars"] == len(t) and found[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert found[i]["near_next"] == pytest.approx(jaccard(shingles(t), shingles(nxt)), abs=0.15)


# -- quality -------------------------------------------------------------------------------------------------------


def repeated(words):
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    return len({i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)})


def test_counts(spark, edge, edge_rows):
    rng = random.Random(4)
    texts = [t for i, t in edge_rows if i != 9] + [" ".join(rng.choice("abc") for _ in range(n)) + "\nline\nline\n" for n in (1, 3, 10, 200)] + ["#a $b\n\n x\n#a $b"]
    c = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", quality.text_counts(F.col("t")).alias("c")).collect()
    for r in c:
        text = texts[r["i"]] or ""
        words = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        want = (len(words), sum(map(len, words)), sum(text.count(x) for x in "#*$%&|<>"), len(lines), len(lines) - len(set(lines)), repeated(words))
        assert tuple(r["c"]) == want


def test_quality_edge_rows(spark, edge, none):
    found = quality.verdicts(edge).collect()
    assert len(found) == edge.count() and not any(r["kept"] for r in found if r["base_failed"])
    assert quality.verdicts(none).count() == 0
    kept = quality.keep_good(edge)
    assert kept.columns == edge.columns and kept.count() == sum(r["kept"] for r in found)


def test_bad_hosts_reject_soft_failures(spark):
    clean = " ".join(f"word{i}" for i in range(80))
    soft = clean + " $$$$$$$$$$$$$$$$$$$$"
    rows = [(i, soft, "bad") for i in range(50)] + [(100 + i, clean, "good") for i in range(200)] + [(300, soft, "good"), (301, clean, "bad")]
    found = {r["doc_id"]: r["kept"] for r in quality.verdicts(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not found[0] and found[300] and found[301] and found[100]


# -- secrets -----------------------------------------------------------------------------------------------------------


def base_spans(text):
    out = []
    for m in re.finditer(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[1]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_secret_spans(spark):
    key = "q9Zr4TtY7xKp2WvLm8NcB3sD"
    texts = ["password: token : abcdefgh", "é😀 API_KEY='abc.def-123' x", "AKIA" + "A1" * 8 + " AKIAKIA", "a1" * 12 + " " + "ab" * 11, f"see {key} here", "uuid 123e4567-e89b-12d3-a456-426614174000", "", None,
             "token=" + "deadbeef" * 4, "passwordpassword=abcdef secret=x token==abcdef", "plain-words-joined-by-hyphens-everywhere"]
    found = [r["spans"] for r in secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    for text, spans in zip(texts, found):
        assert [tuple(s) for s in spans if s["kind"] < 3] == base_spans(text or "")
    assert [s["kind"] for s in found[4]] == [3] and found[4][0]["start"] == 4 and found[4][0]["end"] == 4 + len(key)
    assert found[5] == [] and found[10] == []


def test_two_keys_far_apart_are_two_spans(spark):
    key, other = "q9Zr4TtY7xKp2WvLm8NcB3sD", "J1Qa5UeXo0ViH7gTb2NmR6yW"
    text = f"{key}{'a' * 60}{other} {key}-deadbeef0123456789abcdef"
    spans = secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["spans"]
    keys = [text[s["start"] : s["end"]] for s in spans if s["kind"] == 3]
    assert len(keys) == 3 and all(len(k) < 40 for k in keys) and key[2:-2] in keys[0] and other[2:-2] in keys[1] and key[2:-2] in keys[2]


def test_entropy_windows(spark):
    rng = random.Random(5)
    for _ in range(6):
        text = "".join(rng.choice("abcdefghijkmABCDEFGH0123456789") for _ in range(rng.randint(20, 45)))
        limit = secrets.limit_of("alnum")
        hot = [i for i in range(len(text) - 19) if sum(secrets.C_LOG_C[text[i : i + 20].count(c)] for c in set(text[i : i + 20])) <= limit]
        got = secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["spans"]
        if not base_spans(text) and not re.search(secrets.ALLOW, text) and not re.fullmatch("[0-9a-fA-F]+", text):
            assert [(s["start"], s["end"]) for s in got] == ([(hot[0], hot[-1] + 20)] if hot else [])


def test_entropy_beside_other_spans_and_words(spark):
    key = "q9Zr4TtY7xKp2WvLm8NcB3sDf6GhJ1Qa5UeXo0Vi"
    texts = ["AKIA" + "A1" * 8 + "/" + key, "a1" * 12 + "-" + key, "example-key=" + key, key + "_01234567", key, "example-9f8e7d6c5b4a-EXAMPLE", "a1" * 12]
    found = [r["text"] for r in secrets.redacted(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert all(key[4:-4] not in t for t in found) and found[5] == texts[5] and found[4] == found[6] == "[SECRET]"


def test_long_texts_in_blocks(spark, monkeypatch):
    rng = random.Random(15)
    key = "q9Zr4TtY7xKp2WvLm8NcB3sD"
    lines = [rng.choice(["", "plain words", "token=abcdef12", f"see {key} 😀", "AKIA" + "A1" * 8, "é " + "0a" * 12]) for _ in range(900)]
    text = "\n".join(lines)
    df = spark.createDataFrame([(1, text), (2, None), (3, "\n" * 5)], "doc_id long, text string")
    whole = {r["doc_id"]: ([tuple(s) for s in r["spans"]]) for r in secrets.scan(df).collect()}
    monkeypatch.setattr(secrets, "LONG", 100)
    monkeypatch.setattr(secrets, "PIECES", 7)
    found = {r["doc_id"]: ([tuple(s) for s in r["spans"]]) for r in secrets.scan(df).collect()}
    assert found == whole and [s for s in found[1] if s[1] < 3] == base_spans(text) and any(s[1] == 3 for s in found[1])
    monkeypatch.setattr(secrets, "LONG", 2)
    clean = {r["doc_id"]: r["text"] for r in secrets.redacted(df).collect()}
    assert key not in clean[1] and clean[1].count("\n") == text.count("\n") and clean[1].count("[SECRET]") == sum(1 for x in lines if x not in ("", "plain words")) and clean[2] is None and clean[3] == "\n" * 5


def test_redaction(spark, edge, none):
    df = spark.createDataFrame([(1, "a password=hunter22 b " + "0a" * 12, 5), (2, None, 0), (3, "fine", 4)], "doc_id long, text string, n_chars int")
    found = {r["doc_id"]: r for r in secrets.redacted(df).collect()}
    assert found[1]["text"] == "a [SECRET] b [SECRET]" and found[1]["n_chars"] == 21 and found[2]["text"] is None and found[3]["n_chars"] == 4
    assert secrets.redacted(edge).count() == edge.count() and secrets.scan(none).count() == 0


# -- chat ---------------------------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    rng = random.Random(6)
    odd = ["", "\\", "\\0<s>\\1[", "</s>[INST] ok [/INST]", "a]b", None, "x\ny"]
    turns = []
    for conv in (1, 2, None, 3):
        for t in range(rng.randint(1, 40) if conv != 3 else 150):
            role = "system" if t == 0 and conv != 2 else rng.choice(["user", "assistant", "tool]x[", None])
            turns.append((conv, t, role, rng.choice(odd + [prose(rng, rng.randint(1, 60))])))
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    windows = chat.format_windows(df, budget=160, history=20)
    for r in chat.read_back(windows).collect():
        own = [(role or "", text or "") for conv, _, role, text in turns if conv == r["conv_id"]]
        assert [tuple(t) for t in r["turns"]] == own
        assert r["targets"] == [text for role, text in own if role == "assistant"]
    many = windows.groupBy("conv_id").count().orderBy(F.desc("count")).first()
    assert many["count"] > 3
    assert chat.format_windows(df.limit(0)).count() == 0


def test_windows_keep_the_system_turn(spark):
    turns = [(1, 0, "system", "rules")] + [(1, t, "user" if t % 2 else "assistant", f"turn {t} " + "w " * 20) for t in range(1, 30)]
    found = chat.format_windows(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), 240, 30).orderBy("window").collect()
    assert len(found) > 3 and all(r["formatted"].startswith("[SYS]rules[/SYS]") for r in found) and all(r["n_repeated"] >= 1 for r in found[1:])


def test_windows_hold_their_budget(spark):
    rng = random.Random(11)
    turns, long = [], set()
    for conv in range(30):
        for t in range(rng.randint(1, 80)):
            n = rng.choice([0, 1, 3, 10, 40, 90, 150, 400])
            if t == 0 and conv % 2:
                turns.append((conv, t, "system", "w " * min(n, 90)))
                continue
            turns.append((conv, t, rng.choice(["user", "assistant"]), f"{t} " + "w " * n))
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    found = chat.format_windows(df, 400, 50).withColumn("turns", chat.read_turns(F.col("formatted"))).collect()
    sizes = {(c, t): len(text.split()) + chat.TURN_TOKENS for c, t, _, text in turns}
    for r in found:
        own = r["turns"][r["n_repeated"] :]
        assert r["n_tokens"] <= 400 or len(own) == 1
        again = [t for t in r["turns"][: r["n_repeated"]] if t["role"] != "system"]
        assert sum(len(t["text"].split()) + chat.TURN_TOKENS for t in again) <= 50
        first = next((int(t["text"].split()[0]) for t in own if t["role"] != "system"), None)
        if first and r["conv_id"] % 2 == 0:  # all turns that start within the history are there
            want, back = [], first - 1
            while back >= 0 and sum(sizes[r["conv_id"], k] for k in range(back, first)) <= 50:
                want.insert(0, back)
                back -= 1
            assert [int(t["text"].split()[0]) for t in again] == want
    assert max(r["n_tokens"] for r in found) > 300


# -- URL lists ----------------------------------------------------------------------------------------------------------------


def test_lists_as_of_the_fetch(spark):
    log = [("spam", "a.com", 10, "add"), ("spam", "a.com", 20, "remove"), ("spam", "a.com", 50, "add"), ("allow", "ok.a.com", 0, "add"), ("spam", "b.org", 5, "add"), ("spam", "b.org", 5, "remove"), (None, "c.com", 1, "add")]
    entries = spark.createDataFrame(log, "list string, pattern string, day long, action string")
    caps = [(1, "http://x.a.com/1", 9), (2, "http://x.a.com/1", 10), (3, "https://www.a.com", 19), (4, "http://a.com:80/", 20), (5, "http://a.com", 400), (6, "http://ok.a.com", 60), (7, "http://b.org", 5), (8, None, 5), (9, "no url", 5), (10, "http://a.com", None), (5, "http://a.com", 400), (11, "http://aa.com", 15)]
    found = sorted((r["key"], r["lists"], r["blocked"]) for r in url_filters.url_verdicts(spark.createDataFrame(caps, "key long, url string, day long"), entries).collect())
    blocked = [k for k, _, b in found if b]
    # b.org: on one day the removal comes first, so the addition holds
    assert blocked == [2, 3, 5, 5, 7] and dict((k, v) for k, v, _ in found)[6] == "allow,spam" and len(found) == len(caps)
    assert url_filters.url_verdicts(spark.createDataFrame([], "key long, url string, day long"), entries).count() == 0


# -- toxicity ----------------------------------------------------------------------------------------------------------------------


def test_forward_backward_matches_the_full_chain():
    rng = np.random.default_rng(7)
    model = toxicity.Model(lexicon={f"w{g}": g for g in range(1, 5)}, own=rng.normal(size=5), before=rng.normal(size=5), after=rng.normal(size=5), move=rng.normal(size=(2, 2)))
    scorer = toxicity.Scorer(model)
    for n, hits in ((1, {0: 2}), (5, {0: 1, 4: 3}), (40, {3: 1, 4: 4, 20: 2}), (300, {150: 4}), (90, {89: 1})):
        grades = np.zeros(n, np.int64)
        for k, g in hits.items():
            grades[k] = g
        emit = np.exp(np.stack([np.zeros(n), model.emissions(grades)], 1))
        move, ahead, back = np.exp(model.move), [], np.ones(2)
        a = emit[0]
        for t in range(n):
            a = a if t == 0 else (a @ move) * emit[t]
            a = a / a.sum()
            ahead.append(a)
        want = np.empty(n)
        for t in range(n - 1, -1, -1):
            both = ahead[t] * back
            want[t] = both[1] / both.sum()
            back = move @ (emit[t] * back)
            back = back / back.sum()
        spots, got = scorer.marginals(np.array(sorted(hits)), np.array([hits[k] for k in sorted(hits)]), n)
        assert got == pytest.approx(want[spots], abs=1e-9)


def test_fit_learns_and_finds_spans(spark, edge, none):
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(400):
        words = prose(rng, 60).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["gruk", "snarf!", "Blorg"]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    df, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels + [(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(df, lab)
    found = {r["doc_id"]: r for r in toxicity.score(df, model).collect()}
    held = [i for i, _ in docs if __import__("zlib").crc32(str(i).encode()) % 5 == 0]
    assert held and all((found[i]["score"] >= 0.5) == (i % 4 == 0) for i in held)
    span = found[0]["spans"][0]
    assert docs[0][1][span["start"] : span["end"]].strip("!").lower().split()[0] in ("gruk", "snarf", "blorg")
    odd = toxicity.score(edge, model).collect()
    assert len(odd) == edge.count() and all(0 <= r["score"] < 0.5 for r in odd)
    assert toxicity.keep_clean(edge, model).columns == edge.columns and toxicity.score(none, model).count() == 0
    assert toxicity.fit(none, lab.limit(0)).lexicon == {}


def test_threshold_does_not_depend_on_the_sample(spark, monkeypatch):
    rng = random.Random(12)
    docs, labels = [], []
    for i in range(4000):
        words, toxic = prose(rng, 30).split(), i % 50 == 0
        if toxic or i % 50 == 1 or i % 100 == 2:  # of the texts with the word, two fifths are toxic
            words.insert(rng.randrange(1, len(words)), "snarf")
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    df, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    for sample in ({1: 6000, 0: 14000}, {1: 6000, 0: 600}):
        monkeypatch.setattr(toxicity, "SAMPLE", sample)
        model = toxicity.fit(df, lab)
        assert "snarf" in model.lexicon and all(r["score"] < 0.5 for r in toxicity.score(df, model).collect())


def test_held_out_labels_do_not_reach_the_fit(spark):
    rng = random.Random(13)
    docs = [(i, " ".join(prose(rng, 40).split() + (["snarf"] * 2 if i % 3 == 0 else []))) for i in range(300)]
    held = [i for i, _ in docs if __import__("zlib").crc32(str(i).encode()) % 5 == 0]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    fits = [toxicity.fit(df, spark.createDataFrame([(i, int((i % 3 == 0) != (flip and i in held))) for i, _ in docs], "doc_id long, toxic int")) for flip in (False, True)]
    assert held and fits[0].lexicon == fits[1].lexicon and (fits[0].curve == fits[1].curve).all() and (fits[0].own == fits[1].own).all()


def test_repeated_rows_are_fitted_once(spark):
    rng = random.Random(14)
    docs = [(i, prose(rng, 20)) for i in range(20)] * 3
    sample = toxicity.fitting_sample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int"))
    assert sample.count() == sample.select("doc_id").distinct().count()


# -- Jaccard join -------------------------------------------------------------------------------------------------------------------


def components(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 75 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_join_loses_no_link(spark, seed):
    rng = random.Random(seed)
    rows, shared = [], prose(rng, 40)
    for family in range(25):
        words = prose(rng, rng.choice([3, 8, 60, 120, 700])).split() + (shared.split() if family % 2 else [])
        for _ in range(rng.randint(1, 6)):
            own = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                own[rng.randrange(len(own))] = prose(rng, 1)
            rows.append((rng.randrange(10_000) * 100 + len(rows), " ".join(own)))
    found = jaccard_join.similarity_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(tuple(r) for r in found.collect()) == components(rows)


def test_join_edge_rows(spark, edge, none, edge_rows):
    rows = [(i, t) for i, t in edge_rows]
    found = sorted(tuple(r) for r in jaccard_join.similarity_components(edge).collect())
    assert found == components(rows)
    assert jaccard_join.similarity_components(none).count() == 0
    heads = jaccard_join.keep_heads(edge)
    assert heads.columns == edge.columns and sorted(r["doc_id"] for r in heads.collect()) == [1, 2, 3, 4, 5, 6, 8, 9, 10, 11]


def test_blocks_bound_a_family_of_copies(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 16 * 5)
    monkeypatch.setattr(jaccard_join, "LEAST", 1)
    nodes = list(range(200)) + [900, 901, 902]
    groups = spark.createDataFrame([(1, n, 0) for n in nodes], "gid long, node long, head long")
    comps = spark.createDataFrame([(n, 0) for n in range(200)], "node long, component long")
    sigs = spark.createDataFrame([(n, 5, b"") for n in nodes], "node long, n long, wide binary")
    cells = {}
    for r in jaccard_join.unlinked_members(groups, comps, sigs).collect():
        cells.setdefault((r["i"], r["j"]), set()).add((r["block"], r["node"]))
    assert max(map(len, cells.values())) <= 4 * 16 and sum(map(len, cells.values())) <= 2 * len(nodes)
    met = {tuple(sorted((a, b))) for (i, j), held in cells.items() for x, a in held for y, b in held if a != b and (i == j or x != y)}
    assert {(a, b) for a in nodes for b in (900, 901, 902) if a < b} <= met


def test_copies_that_do_not_fit_in_a_block(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 150)
    monkeypatch.setattr(jaccard_join, "LEAST", 1)
    monkeypatch.setattr(jaccard_join, "CLUSTER_BITS", 1 << 12)
    rng = random.Random(3)
    words = prose(rng, 60).split()
    rows = [(i, " ".join(rng.choice("xyz") + w if rng.random() < 0.03 else w for w in words)) for i in range(60)]
    found = jaccard_join.similarity_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(tuple(r) for r in found.collect()) == components(rows)


def test_links_join_what_is_alike_once():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 100).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[k : k + 60], rng.integers(0, 1 << 63, 2).astype(np.uint64)])) for k in (0, 2, 4, 40)]
    assert len(jaccard_join.joined(sets, np.arange(4))) == 2 and len(jaccard_join.joined(sets, np.array([0, 0, 1, 2]))) == 1


def test_tree_prunes_only_what_cannot_be_alike():
    rng = np.random.default_rng(9)
    base = [rng.integers(0, 1 << 63, 300).astype(np.uint64) for _ in range(20)]
    sets = [np.unique(np.concatenate([b[: rng.integers(220, 300)], rng.integers(0, 1 << 63, 10).astype(np.uint64)])) for b in base for _ in range(4)]
    n = np.array([len(s) for s in sets])
    order = np.argsort(n)
    sig = np.stack([jaccard_join.bitmap(sets[i], 1024) for i in order])
    x, y = jaccard_join.SignatureTree(sig, n[order], np.arange(len(sets)), np.zeros(len(sets), np.int64)).pairs(False)
    got = {tuple(sorted((order[a], order[b]))) for a, b in zip(x, y)}
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 4 * len(np.intersect1d(sets[i], sets[j])) >= 3 * len(np.union1d(sets[i], sets[j]))}
    assert want and want <= got and len(got) < len(sets) * (len(sets) - 1) / 4


# -- pipeline ---------------------------------------------------------------------------------------------------------------------------


def test_columns_that_clash_stay_as_they_are(spark):
    from casebook.llm import packing

    good = " ".join(f"word{i}" for i in range(80))
    names = ["text", "source", "__c", "__rate", "host", "row", "counts", "head", "n", "__text", "clean", "kept"]
    df = spark.createDataFrame([(k, good + f" {k} token=abcdef{k}" * k, "s", *[f"v{k}"] * 10) for k in (1, 2, 2)], "doc_id long, " + ", ".join(f"`{c}` string" for c in names))
    for made in (quality.keep_good(df), jaccard_join.keep_heads(df), secrets.redacted(df)):
        assert made.columns == df.columns and all(set(r[3:]) == {f"v{r['doc_id']}"} for r in made.collect())
    assert "token" not in secrets.redacted(df).first()["text"] and jaccard_join.keep_heads(df.where("doc_id = 2")).count() == 1
    pieces = spark.createDataFrame([(k, 5 + k, "a", "b", "c") for k in range(9)], "doc_id long, length long, shard string, rank string, before string")
    packed = packing.best_fit(pieces, 16)
    assert packed.columns == [*pieces.columns, "sequence_id", "offset"] and {tuple(r[2:5]) for r in packed.collect()} == {("a", "b", "c")}


def test_pipeline_on_odd_rows(spark, tmp_path, edge):
    """Null, empty, long and repeated texts, a column called node: every stage keeps the columns and what it should; an empty table goes through."""
    import corpus_pipeline

    sf = str(tmp_path)
    spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int").write.parquet(sf + "/labels.parquet")
    rng = random.Random(16)
    words = lambda n: " ".join(f"{w}{rng.randrange(999)}" for w in prose(rng, n).split())
    one, long, unnamed = words(80), words(20_000), words(90)
    good = [(20, one, None, None, 0, "clash"), (20, one, None, None, 0, "clash"), (21, long, "en", "s", 5, None), (None, unnamed, "en", "s", None, "x")]
    now, kept = edge.union(spark.createDataFrame(good, edge.schema)), None
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, now, sf)
        assert made.columns == edge.columns or name == "best-fit packing"
        made.write.parquet(f"{sf}/{name}")
        now = spark.read.parquet(f"{sf}/{name}")
        kept = kept or {r["doc_id"] for r in now.collect()}
    packed = now.collect()
    assert kept == {20, 21, None} == {r["doc_id"] for r in packed} and sum(r["doc_id"] == 20 for r in packed) == 1 and sum(r["doc_id"] == 21 for r in packed) > 5
    edge.limit(0).write.parquet(sf + "/documents.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_pipeline_against_the_plain_rules(spark, tmp_path):
    """The whole pipeline against plain versions of its stages on planted rows."""
    import corpus_pipeline

    rng = random.Random(21)
    rows = []
    for i in range(60):
        words = [f"{w}{rng.randrange(50)}" for w in prose(rng, 90).split()]
        if i % 6 == 1:
            words = rows[-1][1].split()[:90]  # near copy of the one before
            words[40] = "changed"
        if i % 10 == 7:
            words = words[:30]  # too short
        rows.append((i, " ".join(words) + (" key AKIA" + "A1" * 8 if i % 6 == 0 else ""), "en", "s", 0))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    sf = str(tmp_path)
    df.write.parquet(sf + "/documents.parquet")
    spark.createDataFrame([(1, 0)], "doc_id long, toxic int").write.parquet(sf + "/labels.parquet")
    good = [(i, t) for i, t, *_ in rows if len(WORD.findall(t)) >= 50]
    heads = {d for d, _, c in components(good) if d == c}
    found = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in found} == heads and len(heads) < len(good) < len(rows)
    third = corpus_pipeline.STAGES[3][1](spark, df.where(F.col("doc_id").isin(*heads)), sf).collect()
    want = {i: t.replace("AKIA" + "A1" * 8, "[SECRET]") for i, t in good if i in heads}
    assert {r["doc_id"]: r["text"] for r in third} == want
    full = {}
    for r in found:
        full[r["sequence_id"]] = full.get(r["sequence_id"], 0) + r["length"]
    assert max(full.values()) <= 2048 and len(full) <= -(-sum(full.values()) // 2048) + 1


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    quality_rows = {r["doc_id"] for r in quality.verdicts(docs).collect() if r["kept"]}
    first = corpus_pipeline.STAGES[0][1](spark, docs, sf_dir)
    assert {r["doc_id"] for r in first.select("doc_id").collect()} == quality_rows and first.columns == docs.columns
    third = corpus_pipeline.STAGES[2][1](spark, first, sf_dir)
    rows = [(r["doc_id"], r["text"]) for r in first.collect()]
    assert {r["doc_id"] for r in third.select("doc_id").collect()} == {d for d, _, c in components(rows) if d == c}
    packed = corpus_pipeline.run(spark, sf_dir)
    assert packed.count() > 0 and "sequence_id" in packed.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "toxicity", "n-gram Jaccard join", "secret scans", "best-fit packing"]


def test_pipeline_bounds_what_a_worker_gets_at_once(spark, tmp_path, edge):
    """After each stage with Python the session's batches are small, whoever writes the stage's result; a smaller bound stays, and batches change no row."""
    import corpus_pipeline

    key, sf = "spark.sql.execution.arrow.maxBytesPerBatch", str(tmp_path)
    spark.createDataFrame([(1, 0)], "doc_id long, toxic int").write.parquet(sf + "/labels.parquet")
    texts = spark.range(0, 60, 1, 1).select(F.repeat(F.lit("word "), 20_000).alias("text"))
    probe = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], names=["bytes", "n"]) for b in batches)
    found = spark.conf.get(key)
    try:
        for name in ("toxicity", "n-gram Jaccard join", "best-fit packing"):
            stage = dict(corpus_pipeline.STAGES)[name]
            spark.conf.unset(key)
            wide = {tuple(map(str, r)) for r in stage(spark, edge, sf).collect()}
            most, n = texts.mapInArrow(probe, "bytes long, n long").agg(F.max("bytes"), F.sum("n")).first()
            assert most <= 1.2 * corpus_pipeline.BATCH_BYTES and n == 60, name
            spark.conf.set(key, "3k")
            assert {tuple(map(str, r)) for r in stage(spark, edge, sf).collect()} == wide and spark.conf.get(key) == "3k", name
    finally:
        spark.conf.set(key, found)
