"""Cases of earlier reviews: one doc_id in several components, roles of several lines, secrets on one long line, null ids in files, many ranges."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from casebook.llm import chat, common, fingerprints, jaccard_join, quality, secrets, token_files, toxicity


def prose(rng, n):
    return " ".join("".join(rng.choice("aeiou") + rng.choice("bdlnrst") for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_heads_are_kept_by_their_own_text(spark):
    rng = random.Random(1)
    a, b = prose(rng, 60), prose(rng, 60)
    rows = [(1, a, "x"), (5, a, "x"), (5, b, "x"), (5, b, "y"), (7, b, "x"), (9, "", "x"), (9, None, "x"), (None, a, "z")]
    kept = jaccard_join.keep_heads(spark.createDataFrame(rows, "doc_id long, text string, node string"))
    found = sorted(((r["doc_id"] or 0), r["text"] or "") for r in kept.collect())
    assert kept.columns == ["doc_id", "text", "node"] and found == sorted([(0, a), (1, a), (5, b), (9, "")])


@pytest.mark.parametrize("role", ["a\nb", "\n", "tool]\n[x", "user\n"])
def test_roles_with_line_breaks_come_back(spark, role):
    df = spark.createDataFrame([(1, 0, role, "said"), (1, 1, "assistant", "so")], "conv_id long, turn long, role string, text string")
    back = chat.read_back(chat.format_windows(df)).collect()[0]
    assert [tuple(t) for t in back["turns"]] == [(role, "said"), ("assistant", "so")]


def test_secrets_on_one_line_in_linear_time(spark):
    def took(n):
        text = " ".join(f"key{i} password=hunter{i % 90 + 10}" for i in range(n))
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.perf_counter()
        hits = secrets.scan(df).select(F.size("spans")).first()[0]
        return hits, time.perf_counter() - began

    took(100)
    (few, short), (many, long) = took(16_000), took(32_000)
    assert few == 16_000 and many == 32_000 and long < 3.2 * short + 0.5


def test_cuts_of_long_texts_change_nothing(spark, monkeypatch):
    rng = random.Random(4)
    parts = ["token : 'abcdef12'", "secret=", "= zzzzzzz9", "password", ":", "  ", ",", "{\"api_key\":\"Ab3dEf6h\"}", "AKIA" + "A1" * 8, "0a" * 13, "x y", "é", "q9Zr4TtY7xKp2WvLm8NcB3sD"]
    df = spark.createDataFrame([(i, " ".join(rng.choice(parts) for _ in range(60))) for i in range(60)], "doc_id long, text string")
    whole = {r[0]: r[1] for r in secrets.scan(df).collect()}
    clean = {r[0]: r[1] for r in secrets.redacted(df).collect()}
    monkeypatch.setattr(secrets, "LONG", 5)
    monkeypatch.setattr(secrets, "PIECES", 1)
    assert {r[0]: r[1] for r in secrets.scan(df).collect()} == whole and {r[0]: r[1] for r in secrets.redacted(df).collect()} == clean


def test_whole_hashes_decide_on_repeats(spark, monkeypatch):
    rng = random.Random(5)
    words = [[rng.choice("abcdefg") for _ in range(rng.randint(0, 40))] for _ in range(200)]
    df = spark.createDataFrame([(w,) for w in words], "w array<string>")

    def counted():
        return [r[0] for r in df.select(quality.repeated_words(F.col("w"))).collect()]

    def plain(w):
        at = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        return len({j for i, g in enumerate(at) if at.count(g) > 1 for j in range(i, i + 3)})

    assert counted() == [plain(w) for w in words]
    monkeypatch.setattr(quality, "PACKED", 5)
    assert counted() == [plain(w) for w in words]


def test_null_ids_in_token_files(spark):
    import public_tokenizers as vocabularies

    path = common.fresh_path(spark, "tokens")
    df = spark.createDataFrame([(-1, "minus one"), (None, "none"), (3, "three")], "doc_id long, text string")
    found = token_files.read_token_files(token_files.write_token_files(df, vocabularies.path("word_bpe_49k.json"), 1, path), path).orderBy("start").collect()
    assert [r["doc_id"] for r in found] == [None, -1, 3]


def test_ranges_cost_no_plan(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    sizes = [len(df.select(common.bucket_of(F.col("k"), list(range(n))))._jdf.queryExecution().toString()) for n in (10, 10_000)]
    assert sizes[0] == sizes[1]
    assert [r[0] for r in df.select(common.bucket_of(F.col("k"), [2, 5])).collect()] == [0, 0, 1, 1, 1, 2, 2, 2, 2, 2]


def test_hot_shingles_meet_in_pieces(spark, monkeypatch):
    from test_documents import components

    monkeypatch.setattr(jaccard_join, "SPLIT", 4)
    rng = random.Random(6)
    words, other = prose(rng, 80).split(), prose(rng, 30).split()
    rows = [(i, " ".join(prose(rng, 1) if rng.random() < 0.01 else w for w in words)) for i in range(70)]
    rows += [(100 + i, " ".join(words[:20] + [prose(rng, 1) for _ in range(40)])) for i in range(20)] + [(200 + i, " ".join(other + [prose(rng, 1) for _ in range(i % 4)])) for i in range(25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard_join.similarity_components(docs).collect()) == components(rows)
    level = jaccard_join.levels(jaccard_join.profile(docs))
    split = {(r["gid"], r["node"]) for r in jaccard_join.shared_prefixes(docs, level, 4, 4).collect()}
    monkeypatch.setattr(jaccard_join, "SPLIT", 1 << 16)
    whole = {(r["gid"], r["node"]) for r in jaccard_join.shared_prefixes(docs, level, 4, 4).collect()}
    sets = lambda pairs: {frozenset(n for g, n in pairs if g == gid) for gid, _ in pairs}
    assert {x for x in sets(split) if len(x) > 1} == sets(whole) and level.max() > 16


def test_pieces_of_the_most_frequent_shingles_are_one_group(spark):
    rng = random.Random(16)
    words = prose(rng, 30).split()
    docs = spark.createDataFrame([(i, " ".join(words + [prose(rng, 1) for _ in range(i % 9)])) for i in range(60)], "doc_id long, text string")
    # levels are bytes: above 120 a shingle meets in pieces, from 128 on a doubled level is no byte any more
    plain, often = (np.full(jaccard_join.CELLS, x, np.uint8) for x in (120, 140))
    whole, split = ({(r["gid"], r["node"]) for r in jaccard_join.shared_prefixes(docs, level, 4, 4).collect()} for level in (plain, often))
    sets = lambda pairs: {x for x in (frozenset(n for g, n in pairs if g == gid) for gid, _ in pairs) if len(x) > 1}
    assert sets(split) == sets(whole) and max(map(len, sets(whole))) > 20


def test_hidden_labels_spare_a_word_in_a_harmless_context():
    # grade 3 stands alone in harmless documents and as often beside grade 4 in toxic ones; no token has a label
    rng = np.random.default_rng(7)
    rows, toxic = [], []
    for i in range(400):
        row = np.zeros(11, np.int64)
        row[5] = 3
        if i % 2:
            row[4 + 2 * rng.integers(2)] = 4
        rows.append(row)
        toxic.append(i % 2)
        rows.append(np.zeros(11, np.int64))
        toxic.append(0)
    model = toxicity.fit_field(np.array(rows), np.array(toxic), np.ones(len(rows)))
    scorer = toxicity.Scorer(model)
    spots, alone = scorer.marginals(np.array([10]), np.array([3]), 30)
    _, both = scorer.marginals(np.array([10, 11]), np.array([4, 3]), 30)
    assert alone[spots == 10][0] < 0.3 and both.max() > 0.8
    # labels of documents alone tell which windows are toxic
    assert model.own[4] > model.own[0] and model.own[3] > model.own[0]


def test_toxic_spans_are_returned_as_offsets(spark, sf_dir):
    rows = toxicity.op9_toxicity(spark, sf_dir).collect()
    texts = {r["doc_id"]: r["text"] for r in common.table(spark, sf_dir, "documents").collect()}
    assert any(r["spans"] for r in rows)
    for r in rows:
        found = [tuple(map(int, x.split(":"))) for x in r["spans"].split(",") if x]
        assert len(found) == r["n_spans"] and all(0 <= a < b <= len(texts[r["doc_id"]]) for a, b in found)


def test_sketches_of_parts_are_the_sketch_of_the_whole(monkeypatch):
    rng = random.Random(8)
    texts = []
    for _ in range(200):
        words = [rng.choice("abcdef") * rng.choice([1, 2, 3, 40]) for _ in range(rng.randint(0, 60))]
        texts.append("".join(w + rng.choice([" ", "\n", "  \t", " \r\n "]) for w in words).encode() + rng.choice([b"", b"    ", b"end"]))
    whole = fingerprints.sketch_arrays(texts)
    for size in (1, 7, 30, 100):
        monkeypatch.setattr(fingerprints, "PART_BYTES", size)
        assert all((a == b).all() if len(a) == len(b) else False for a, b in zip(fingerprints.sketch_arrays(texts), whole))
        assert max(len(fingerprints.parts_of(t)) for t in texts) > 2
