"""Steps whose work must not grow faster than the input, against plain versions."""

import random

import duckdb
from pyspark.sql import functions as F

from casebook.operators import linkage, phrases, vectors
from casebook.plans import registry


def _score(a, b):
    x, y = set(a.split()), set(b.split())
    before = list(range(len(b) + 1))
    for i, c in enumerate(a):
        row = [i + 1]
        for j, d in enumerate(b):
            row.append(min(before[j] + (c != d), row[-1] + 1, before[j + 1] + 1))
        before = row
    return 0.5 * len(x & y) / len(x | y) + 0.5 * (1 - before[-1] / max(len(a), len(b)))


def _names(rng, n, sizes):
    words = [f"{c}{d}word" for c in "abcdef" for d in "123"]
    out = set()
    while len(out) < n:
        one = rng.sample(words, rng.choice(sizes))
        out.add(" ".join(one))
        other = list(one)
        other[rng.randrange(len(other))] = rng.choice(words)
        out.add(" ".join(other[:: rng.choice([1, 1, 1, -1])]))
        out.add(" ".join(one[:-1]) or one[0])
    return sorted(out)


def test_short_names_meet_without_the_all_pairs_search(spark, monkeypatch):
    names = _names(random.Random(4), 120, [1, 2, 5, 8, 9, 10])
    monkeypatch.setattr(linkage, "alike_pairs", lambda *a, **k: (_ for _ in ()).throw(AssertionError("all pairs")))
    classes = linkage.name_classes(spark.createDataFrame(enumerate(names), "id long, name string"))
    found = linkage.fuzzy_pairs(classes, carried=("norm",)).collect()
    want = {frozenset((a, b)): _score(a, b) for i, a in enumerate(names) for b in names[:i] if _score(a, b) >= 0.85}
    assert len(found) == len(want) > 20
    assert all(abs(want[frozenset((r.a_norm, r.b_norm))] - r.score) < 1e-9 for r in found)


def test_names_on_both_sides_of_the_short_limit(spark):
    names = _names(random.Random(5), 90, [9, 10, 11, 12, 14])
    classes = linkage.name_classes(spark.createDataFrame(enumerate(names), "id long, name string"))
    found = {frozenset((r.a_norm, r.b_norm)) for r in linkage.fuzzy_pairs(classes, carried=("norm",)).collect()}
    assert found == {frozenset((a, b)) for i, a in enumerate(names) for b in names[:i] if _score(a, b) >= 0.85}
    assert any(len({len(n.split()) > linkage.SHORT for n in pair}) == 2 for pair in found)


def test_page_titles_and_their_sql_decode_the_same(spark, tmp_path):
    titles = ["say &quot;a&quot; &#39;b&#39; &apos;c&apos; &amp;quot;", "a\u00a0\u2003b\x0bc &nbsp; d", "x &lt;b&gt;y&lt;/b&gt; &amp;lt;", "", None]
    rows = [(i, "http://a.org/x", None if t is None else f"<title>{t}</title>") for i, t in enumerate(titles)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = sorted(map(tuple, registry.QUERIES["page_titles"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert found == sorted(con.execute(registry.ORACLES["page_titles"]).fetchall())
    assert [r[1] for r in found] == ["say \"a\" 'b' 'c' &quot;", "a b c d", "x y &lt;", "", ""]


def test_a_long_list_of_regions_goes_by_a_join(spark, sf_dir, monkeypatch):
    want = sorted(map(tuple, registry.QUERIES["region_rollup"](spark, sf_dir).collect()))
    monkeypatch.setattr(phrases, "LISTED", 5)
    monkeypatch.setattr(phrases, "find", lambda *a, **k: (_ for _ in ()).throw(AssertionError("an automaton of a long list")))
    assert want and sorted(map(tuple, registry.QUERIES["region_rollup"](spark, sf_dir).collect())) == want


def test_vectors_travel_once_for_each_large_block(spark):
    rows = spark.range(6000).select("id", F.array(F.lit(1.0), F.col("id") % 7 + 0.5).alias("vec"), (F.col("id") % 60).alias("day"))
    assert vectors.spread(rows).count() == 2 * 6000
    some = rows.where("id < 600")
    assert sorted(map(tuple, vectors.neighbours(some, block=50).select("id", "other", "gap").collect())) == sorted(map(tuple, vectors.neighbours(some).select("id", "other", "gap").collect()))


def test_trust_counts_sources_in_one_row_an_incident(spark, sf_dir):
    plan = registry.QUERIES["trust_score"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "distinct" not in plan.lower()


def test_a_divergence_block_holds_sixteen_megabytes_of_text(spark):
    from casebook.llm import divergence

    docs = spark.range(3, numPartitions=1).select(F.repeat(F.lit("word other "), 900_000).alias("text"), F.lit("en").alias("lang"), F.lit("a").alias("source"))
    assert divergence.chunk_blocks(docs, 2).where("kind = 0").count() == 3


def test_the_all_pairs_search_goes_in_passes_of_bounded_size(spark, monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(linkage, "LEAST_BLOCK", 8)
    monkeypatch.setattr(linkage, "LEAST_PASS", 1)
    sets = [sorted({rng.randrange(14) for _ in range(rng.choice([2, 3, 5, 8]))}) for _ in range(90)]
    days = [rng.choice([None, *range(60)]) for _ in sets]
    given = spark.createDataFrame([(k, s, d) for k, (s, d) in enumerate(zip(sets, days))], "key long, t array<long>, day long").select("key", F.transform("t", lambda t: F.xxhash64(t)).alias("tokens"), "day")
    alike = lambda i, j: len({*sets[i]} & {*sets[j]}) * 2 >= len({*sets[i]} | {*sets[j]})
    near = lambda i, j: None in (days[i], days[j]) or abs(days[i] - days[j]) <= 14
    ends = lambda df: {(r["a"], r["b"]) for r in df.collect()}
    want = {(j, i) for i in range(90) for j in range(i) if alike(i, j)}
    assert ends(linkage.alike_pairs(given, 1, 2, 10)) == want
    assert ends(linkage.alike_pairs(given, 1, 2, 10, days=14)) == {p for p in want if near(*p)} < want

    def parts(pairs):
        root = list(range(90))
        for a, b in sorted(pairs):
            x, y = root[a], root[b]
            root = [min(x, y) if r in (x, y) else r for r in root]
        return root

    spanning = ends(linkage.alike_pairs(given, 1, 2, 1000, spanning=True))
    assert spanning < want and parts(spanning) == parts(want)
    blocks = [(None, 4, 4, 100)] * 40
    passes = linkage.block_passes(blocks, 1, 2)
    assert sorted(c for p in passes for c in p) == [(i, j) for i in range(40) for j in range(i, 40)]
    assert max(sum(100 * len({*c}) for c in p) for p in passes) <= 1.5 * 4000


def test_written_tables_leave_no_shuffle_files(spark):
    import glob
    import os
    import time

    from casebook.functions.storage import materialize

    top = os.environ.get("SPARK_LOCAL_DIRS") or spark.conf.get("spark.local.dir", "/tmp")
    count = lambda: {p for p in glob.glob(f"{top}/blockmgr-*/*/shuffle_*.data") + glob.glob(f"{top}/*/blockmgr-*/*/shuffle_*.data")}
    before = count()
    made = materialize(spark.range(10_000).groupBy(F.col("id") % 100).count(), "sums")
    for _ in range(20):
        if not count() - before:
            break
        time.sleep(0.25)
    assert not count() - before and made.count() == 100
    spark.range(10_000).groupBy(F.col("id") % 100).count().collect()
    assert count() - before
