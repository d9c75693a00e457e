"""Operators against small hand-made cases and plain Python versions."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from casebook.operators import cluster, extract, flows, geo, graph, ledger, linkage, ordering, relevance, sync, trust, vectors
from casebook.sources import tables


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_components_path_and_cycle(spark):
    edges = [(i, i + 1) for i in range(1, 200)] + [(500, 501), (501, 502), (502, 500), (7, 7), (None, 3)]
    found = dict(rows(graph.connected_components(spark.createDataFrame(edges, "a long, b long"))))
    assert {found[i] for i in range(1, 201)} == {1} and {found[i] for i in (500, 501, 502)} == {500}


def test_components_random(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    parent = list(range(300))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    found = dict(rows(graph.connected_components(spark.createDataFrame(edges, "a long, b long"))))
    assert found == {x: root(x) for e in edges for x in e if any(x in f and f[0] != f[1] for f in edges)}


def test_components_empty(spark):
    assert rows(graph.connected_components(spark.createDataFrame([], "a long, b long"))) == []


def test_syndicated_measures_from_the_original(spark):
    day = 86400
    head = "a headline that is long enough"
    given = [(1, head, 0), (2, head, 10 * day), (3, head, 20 * day), (4, head, 30 * day), (5, "short", 0), (6, "short", 0)]
    # 3 is 20 days from 1, though 10 from 2: it starts anew; 4 is within 14 days of 3
    assert rows(linkage.syndicated(spark.createDataFrame(given, "id long, headline string, at long"))) == [(1, 2), (3, 4)]
    undated = [(9, head, None), (1, head, 0), (2, head, 90 * day)]
    assert rows(linkage.syndicated(spark.createDataFrame(undated, "id long, headline string, at long"))) == [(9, 1), (9, 2)]


@pytest.mark.parametrize(("text", "title", "site", "want"), [
    (0.95, 0.0, False, "LIKELY_DUPLICATE"), (0.85, 0.9, False, "LIKELY_REPRODUCED"), (0.7, 0.9, False, "POSSIBLE_REPRODUCED"),
    (0.75, 0.2, True, "POSSIBLE_DUPLICATE"), (0.4, 0.0, False, "LIKELY_INDEPENDENT"), (0.6, 0.1, True, "UNCERTAIN_RELATION")])
def test_relations(spark, text, title, site, want):
    assert spark.range(1).select(linkage.relation(F.lit(text), F.lit(title), F.lit(site))).first()[0] == want


def test_relevance(spark):
    r = relevance.relevance(F.col("t"), F.col("s"), ["ransomware", "breach", "virus"], ["was hit"], ["how to"], ["virus"], ["computer"])
    given = [("Bank breach", "It was hit by ransomware"), ("virus season", "flu"), ("virus season", "a computer"), (None, None), ("how to", "how to")]
    found = [tuple(x["r"])[:2] for x in spark.createDataFrame(given, "t string, s string").select(r.alias("r")).collect()]
    assert found == [("RELEVANT", 0.85), ("NOT_RELEVANT", 0.0), ("UNCERTAIN", 0.5), ("NOT_RELEVANT", 0.0), ("NOT_RELEVANT", 0.0)]


def test_trust_levels(spark):
    t = trust.trust(F.col("i"), F.col("d"), F.col("n"), F.col("c"), F.col("s"), F.lit(1.0))
    given = [(None, 1, 1, 0.9, 1.0), (0.7, 3, 3, 0.9, 1.0), (None, 2, 2, 0.0, 0.0)]
    found = [tuple(x[0]) for x in spark.createDataFrame(given, "i double, d long, n long, c double, s double").select(t).collect()]
    assert found == [(0.485, "medium"), (0.74, "high"), (0.175, "low")]


def test_votes_exactly_two_thirds(spark):
    cases = [(2, 1, "agree"), (1, 2, "disagree"), (2, 0, "open"), (2, 2, "open"), (0, 3, "disagree")]
    found = [r[0] for r in spark.createDataFrame([c[:2] for c in cases], "a long, d long").select(flows.decide(F.col("a"), F.col("d"))).collect()]
    assert found == [c[2] for c in cases]


def test_vote_rollup_corrections(spark):
    votes = [("i", "target", "Bank", "disagree", "a", "Big  bank", 1), ("i", "target", "Bank", "disagree", "b", "big bank", 2), ("i", "target", "Bank", "disagree", "c", "Other", 3), ("i", "target", "Old", "agree", "d", None, 4)]
    cards = spark.createDataFrame([("i", "target", "Bank")], "incident string, field string, value string")
    r = flows.vote_rollup(spark.createDataFrame(votes, "incident string, field string, shown string, answer string, respondent string, correction string, seq long"), cards).first()
    assert (r["verdict"], r["value"], r["correction_votes"], r["ignored"]) == ("disagree", "Big bank", 2, 1)


def test_change_capture_writes_one_tombstone(spark):
    old = spark.createDataFrame([("a", "1", "live"), ("b", "1", "live"), ("c", "1", "live"), ("d", None, "removed")], "k string, h string, status string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("e", "1")], "k string, h string")
    assert rows(flows.change_capture(old, new, "k", "h")) == [("b", "changed"), ("c", "removed"), ("e", "new")]


def _node(a, b):
    return hashlib.sha256(b"\x01" + min(a, b) + max(a, b)).digest()


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13])
def test_merkle(spark, n):
    leaves = [hashlib.sha256(b"\x00" + f"p{i}".encode()).digest() for i in range(n)]
    level = leaves
    while len(level) > 1:
        level = [_node(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    df = spark.createDataFrame([([x.hex() for x in leaves],)], "l array<string>").withColumn("root", ledger.merkle_root(F.col("l"), 16))
    assert df.first()["root"] == level[0].hex()
    proofs = df.select("root", F.posexplode("l").alias("i", "leaf"), "l").select(ledger.verify_proof(F.col("leaf"), ledger.merkle_proof(F.col("l"), F.col("i"), 16), F.col("root")).alias("ok"))
    assert all(r["ok"] for r in proofs.collect())


def test_batches_are_linked(spark):
    rows_ = spark.createDataFrame([(i, f"p{i}") for i in range(10)], "id long, payload string")
    made = {r["batch"]: r for r in ledger.batches(rows_, "id", "payload", 4).collect()}
    assert [made[i]["n"] for i in range(3)] == [4, 4, 2] and made[0]["previous_root"] is None and made[2]["previous_root"] == made[1]["root"]


def test_row_index_with_ties_and_nulls(spark):
    given = [(i // 3 if i else None, f"x{i}") for i in range(40)]
    found = ordering.row_index(spark.createDataFrame(given, "k long, v string"), "k", buckets=7).collect()
    assert sorted(r["idx"] for r in found) == list(range(40))
    keys = [r["k"] for r in sorted(found, key=lambda r: r["idx"])]
    assert keys[0] is None and keys[1:] == sorted(keys[1:])


def test_sync_counts_multisets(spark):
    remote = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "k string, v long")
    local = spark.createDataFrame([("a", 1), ("b", 3), ("c", 4)], "k string, v long")
    assert rows(sync.sync_plan(remote, local)) == [(2, 2, True)]
    assert rows(sync.sync_plan(remote, remote)) == [(0, 0, False)]


def test_upserts(spark):
    old = spark.createDataFrame([("a", 1, 10), ("b", 2, 20)], "k string, v long, t long")
    new = spark.createDataFrame([("b", 5, 99), ("c", 6, 30)], "k string, v long, t long")
    assert rows(sync.upsert_keeping(old, new, ["k"], ("t",))) == [("a", 1, 10), ("b", 5, 20), ("c", 6, 30)]
    assert rows(sync.insert_or_ignore(old, new, ["k"])) == [("a", 1, 10), ("b", 2, 20), ("c", 6, 30)]
    assert rows(sync.insert_or_replace(old, new, ["k"])) == [("a", 1, 10), ("b", 5, 99), ("c", 6, 30)]


def test_chain(spark):
    given = [(1, "t", 0, 10, "x"), (2, "t", 30, 35, "x"), (3, "t", 50, 60, "y"), (4, "t", 55, 58, "z"), (5, "u", 0, 5, "x"), (6, None, 0, 0, "x")]
    found = rows(cluster.chain(spark.createDataFrame(given, "id long, target string, first_day long, last_day long, family string")))
    # 2 joins 1 (gap 20, one family); 3 follows in another family, so it heads; 4 overlaps 3 and joins it in spite of its family
    assert found == [(1, 1), (2, 1), (3, 3), (4, 3), (5, 5)]


def test_merge_judged(spark):
    inc = spark.createDataFrame([(1, 5), (2, 3), (3, 9), (4, None)], "id long, first_day long")
    pairs = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.8), (3, 4, 0.1), (1, 77, 0.9)], "a long, b long, confidence double")
    assert rows(cluster.merge_judged(inc, pairs, 0.7)) == [(1, 2), (2, 2), (3, 2)]


def test_neighbours_keep_the_window(spark):
    given = [(1, [1.0, 0.0], 0), (2, [0.99, 0.1], 5), (3, [1.0, 0.01], 100), (4, [0.0, 1.0], 1)]
    found = vectors.neighbours(spark.createDataFrame(given, "id long, vec array<double>, day long"), block=2)
    assert [(r["id"], r["other"], r["gap"]) for r in found.orderBy("id").collect()] == [(1, 2, 5), (2, 1, 5)]


def test_places(spark):
    places = spark.createDataFrame([("New Town", "A", True, None), ("Lake", "B", False, "north"), ("Twin", "A", True, None), ("Twin", "B", True, None)], "name string, region string, is_city boolean, context string")
    texts = spark.createDataFrame([(1, "In New town today"), (2, "a lake"), (3, "the lake up north"), (4, "twin")], "id long, text string")
    assert rows(geo.mentions(texts, geo.gazetteer(places))) == [(1, "new town", "A"), (3, "lake", "B")]
    strong = spark.createDataFrame([("i", 1, "A")], "incident string, id long, region string")
    weak = spark.createDataFrame([("i", 1, "A"), ("i", 2, "A"), ("i", 2, "B"), ("i", 3, "C"), ("i", 4, "C")], "incident string, id long, region string")
    assert rows(geo.incident_regions(strong, weak)) == [("i", "A", 2), ("i", "C", 2)]


def test_extraction(spark):
    df = spark.createDataFrame([("Acme Corp confirms data breach", "x", None), ("Nothing", "Hackers hit Blue Bank last week", None), ("No", "No", "An attack on City Hall was seen")], "t string, s string, c string")
    found = [tuple(r[0]) for r in df.select(extract.tiered(F.col("t"), F.col("s"), F.col("c"), lambda x: extract.name_in(x, extract.ORGANISATION))).collect()]
    assert found == [("Acme Corp", 0.9), ("Blue Bank", 0.8), ("City Hall", 0.6)]


def test_statements(spark):
    given = [(1, "s1", "i", "confirmed", "http://x", "2024-01-01"), (2, "s1", "i", "confirmed", "http://x", "2024-01-01"), (3, "", "i", "odd", "ftp://x", "1/1/24"), (4, "s2", "i", "odd", "http://x", "2024-01-01"), (5, "s2", "i", "refuted", "https://x", "2024-01-01")]
    df = spark.createDataFrame(given, "line long, statement_id string, incident_id string, status string, source_url string, date string")
    found = {r["line"]: r["errors"] for r in tables.checked_statements(df, ("confirmed", "refuted")).collect()}
    assert found[1] == [] and found[2] == ["statement_id is repeated"] and len(found[3]) == 4 and found[4] == ["status is unknown"] and found[5] == []


def test_conform_and_search_url(spark):
    df = tables.conform(spark.createDataFrame([("x", "7")], "Title string, article_id string"), tables.schema("articles"))
    assert df.columns[:3] == ["article_id", "article_uid", "title"] and df.first()["article_id"] == 7 and df.first()["summary"] is None
    url = tables.search_url(F.lit("data leak"), F.lit("xx"), F.lit("2024-01-01").cast("date"), F.lit("2024-01-01").cast("date"), {"en": ("en-US", "US", "US:en")}, "https://feed.example/search")
    assert spark.range(1).select(url).first()[0] == "https://feed.example/search?q=%22data+leak%22+after%3A2024-01-01+before%3A2024-01-02&hl=en-US&gl=US&ceid=US:en"
    assert [str(r["start"]) for r in tables.periods(spark, "2024-01-01", "2024-03-15").collect()] == ["2024-01-01", "2024-01-31"]


def test_alike_pairs_are_all_pairs(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    family = rng.sample(words, 40)
    sets = [family + [f"own{i}"] for i in range(30)] + [rng.sample(words[: rng.choice([40, 400])], rng.randint(1, 30)) for _ in range(300)] + [["aaa", "bbb", "ccc", "ddd", "eee"], ["aaa"], []]
    given = spark.createDataFrame(list(enumerate(sets)), "key long, t array<string>").select("key", F.transform("t", lambda t: F.xxhash64(t)).alias("tokens"))
    want = set()
    for i in range(len(sets)):
        for j in range(i):
            both = len(set(sets[i]) & set(sets[j]))
            if both and 5 * both >= len(set(sets[i]) | set(sets[j])):
                want.add((j, i, both, len(sets[j]), len(sets[i])))
    for block in (40, 1000):
        found = rows(linkage.alike_pairs(given, 1, 5, block))
        assert len(found) == len(want) and set(found) == want


def test_sets_travel_to_bands_in_reach(spark, monkeypatch):
    """Same pairs as nested loops for sizes of all magnitudes, and rows of blocks that grow with the sets in reach, not with all blocks."""
    rng = random.Random(12)
    monkeypatch.setattr(linkage, "LEAST_BLOCK", 8)
    sets = [[f"t{rng.randrange(12)}" for _ in range(rng.choice([1, 2, 3, 4, 6, 8, 12]))] for _ in range(120)] + [[f"u{k + i}" for k in range(2**m)] for m in range(7) for i in range(3)]
    sets = [sorted(set(s)) for s in sets]
    given = spark.createDataFrame(list(enumerate(sets)), "key long, t array<string>").select("key", F.transform("t", lambda t: F.xxhash64(t)).alias("tokens"))
    for num, den in ((1, 2), (3, 10), (7, 10), (1, 1)):
        want = {(j, i) for i in range(len(sets)) for j in range(i) if den * (both := len(set(sets[i]) & set(sets[j]))) >= num * len(set(sets[i]) | set(sets[j])) and both}
        assert {(r["a"], r["b"]) for r in linkage.alike_pairs(given, num, den, 10).collect()} == want


def test_large_families_keep_their_pairs(spark, tmp_path):
    from casebook.plans import domain

    texts = [(i, "headline of a copied report\n" + " ".join(f"copied{k}" for k in range(40))) for i in range(1, 26)] + [(99, "alone entirely different matter")]
    spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t)) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(str(tmp_path / "documents.parquet"))
    assert dict(rows(domain.components(spark, str(tmp_path)))) == {i: 1 for i in range(1, 26)}
    days = {i: i * 37 % 200 for i in range(1, 26)}
    found = dict((i, c) for c, i in rows(domain.incident_clusters(spark, str(tmp_path))))
    assert all(found[i] == found[j] for i in days for j in days if abs(days[i] - days[j]) < 14) and found[99] == 99


def test_names_resolve_to_the_best_entity(spark):
    entities = [(5, "North Harbour General Hospital of the Lake"), (3, "north harbour general hospital of the lakes"), (9, "Acme Bank"), (1, "")]
    mentions = [(1, "NORTH HARBOUR GENERAL HOSPITAL OF THE LAKE"), (2, "North Harbour General Hospital at the Lake"), (3, "acme  bank"), (4, "Acme Banks"), (5, ""), (6, None)]
    found = linkage.resolve_names(spark.createDataFrame(mentions, "id long, name string"), spark.createDataFrame(entities, "id long, name string"))
    assert {r["id"]: r["entity"] for r in found.collect()} == {1: 5, 2: 5, 3: 9, 4: None, 5: None, 6: None}


def test_row_index_keeps_any_columns(spark):
    df = spark.createDataFrame([(3, 1, "a"), (1, 2, "b"), (2, 3, "c")], "id long, range long, `before` string")
    assert rows(ordering.row_index(df, "id")) == [(1, 2, "b", 0), (2, 3, "c", 1), (3, 1, "a", 2)]


def test_neighbours_break_ties_by_id(spark):
    given = spark.createDataFrame([(i, [1.0, 0.0], 0) for i in range(40, 0, -1)], "id long, vec array<double>, day long")
    found = vectors.neighbours(given, top=3, block=1000)
    assert rows(found.where("id = 10").select("other")) == [(1,), (2,), (3,)] and rows(found.where("id = 2").select("other")) == [(1,), (3,), (4,)]


def test_storage_refuses_a_local_folder_on_a_cluster():
    from types import SimpleNamespace

    from casebook.functions import storage

    conf = SimpleNamespace(get=lambda key: None)
    cluster_like = SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: conf, master="yarn"))
    with pytest.raises(ValueError):
        storage.shared_dir(cluster_like)
