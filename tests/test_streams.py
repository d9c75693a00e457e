"""State of streams: what it gives against plain passes, and that it stays bounded while the watermark passes."""

import datetime as dt
import random

import pandas as pd
import pytest

from casebook.functions.storage import fresh_path
from casebook.streaming import streams

BEGIN = dt.datetime(2024, 1, 1)


def write(path, rows, files):
    """Rows in `files` files, read one a batch in order of name."""
    import os

    os.makedirs(path)
    size = -(-len(rows) // files)
    for k in range(files):
        part = pd.DataFrame(rows[k * size : (k + 1) * size], columns=["key", "ts", "words", "field"])
        part["ts"] = part["ts"].astype("datetime64[us]")
        part.to_parquet(f"{path}/{k:03d}.parquet")
        os.utime(f"{path}/{k:03d}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))


def run(spark, stream, name):
    rows = []
    q = stream.writeStream.foreachBatch(lambda df, _: rows.extend(map(tuple, df.collect()))).option("checkpointLocation", fresh_path(spark, name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return rows, [s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]]


@pytest.fixture(scope="module")
def rows():
    """40 keys, each busy for a few of 120 days; no row is later than its successors by more than a day."""
    rng = random.Random(2)
    out = []
    for key in range(40):
        start = key * 3
        for _ in range(12):
            at = BEGIN + dt.timedelta(days=start + rng.random() * 6)
            out.append((key, at, [rng.choice("abcdefgh") for _ in range(3)] + [f"k{key % 3}"], rng.choice([None, "x", "y"])))
    return sorted(out, key=lambda r: r[1] + dt.timedelta(days=rng.random()))


def test_windows_expire(spark, rows, tmp_path):
    write(str(tmp_path / "in"), rows, 12)
    stream = streams.read_events(spark, str(tmp_path / "in") + "/", spark.read.parquet(str(tmp_path / "in")).schema, 1)
    found, state = run(spark, streams.incident_windows(stream, "key", "ts", 4), "windows")
    last = {}
    for key, first, _, n in found:
        last[key, first] = max(n, last.get((key, first), 0))
    assert sum(last.values()) == len(rows) and {k for k, _ in last} == set(range(40))
    # 4 days and 3 of lateness behind a key's last event its state goes: never all keys at once, and few in the end
    assert max(state) < 25 and state[-1] < 12


def test_states_join_alike_articles_and_expire(spark, rows, tmp_path):
    write(str(tmp_path / "in"), rows, 12)
    stream = streams.read_events(spark, str(tmp_path / "in") + "/", spark.read.parquet(str(tmp_path / "in")).schema, 1)
    found, state = run(spark, streams.incident_states(stream, "key", "ts", "words", "field", 4), "states")
    size = -(-len(rows) // 12)
    want: dict = {}
    for k in range(12):  # batch by batch, each by time
        for key, at, words, field in sorted(rows[k * size : (k + 1) * size], key=lambda r: (r[1], sorted(r[2]))):
            t, words, best, home = at.replace(tzinfo=dt.timezone.utc).timestamp(), set(words), 0.0, None
            for o in want.setdefault(key, []):
                like = len(words & o["tokens"]) / len(words | o["tokens"])
                if o["first"] - 4 * 86400 <= t <= o["last"] + 4 * 86400 and like >= 0.35 and like > best:
                    best, home = like, o
            if home is None:
                home = {"first": t, "last": t, "n": 0, "tokens": set(), "field": None}
                want[key].append(home)
            home["last"], home["n"], home["field"] = max(home["last"], t), home["n"] + 1, home["field"] or field
            home["tokens"] |= words
    final = {}
    for key, first, end, n, tokens, field in found:
        final[key, first] = max((n, end, tokens, field or ""), final.get((key, first), (0, 0.0, 0, "")))
    assert final == {(k, o["first"]): (o["n"], o["last"], len(o["tokens"]), o["field"] or "") for k, os_ in want.items() for o in os_}
    assert max(state) < 25 and state[-1] < 12


def test_states_of_one_run_need_no_closing_batch(spark, rows, tmp_path, monkeypatch):
    write(str(tmp_path / "in"), rows, 6)
    made = []
    monkeypatch.setattr(streams, "fresh_path", lambda s, name: made.append(fresh_path(s, name)) or made[-1])

    def states(closing):
        stream = streams.read_events(spark, str(tmp_path / "in") + "/", spark.read.parquet(str(tmp_path / "in")).schema, 3)
        found = streams.run_to_table(streams.incident_states(stream, "key", "ts", "words", "field", 4), "states", closing=closing)
        return sorted(map(tuple, found.collect()), key=repr), spark.read.text(f"{made[-1]}/commits/*").inputFiles()

    (plain, batches), (short, fewer) = states(True), states(False)
    assert plain == short and len(fewer) == 2 < len(batches)
