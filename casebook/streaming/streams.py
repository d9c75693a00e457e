"""Structured Streaming forms of the incremental stages: windows, de-duplication, keyed upserts and incident state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from casebook.functions.storage import fresh_path

#: How late rows may come: the crawl reads its last three days again.
LATENESS = "3 days"


def read_events(spark: SparkSession, path: str, schema: StructType | None = None, files_per_batch: int = 4) -> DataFrame:
    """Files as a stream; times without a zone become UTC timestamps, as watermarks need."""
    want = schema or spark.read.parquet(path).schema
    rows = spark.readStream.schema(want).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path}*")  # a pattern, as a table may be one file
    return rows.withColumns({f.name: F.col(f.name).cast("timestamp") for f in want if f.dataType.typeName() == "timestamp_ntz"})


#: Spark's setting by which a stream ends with a batch without rows, once the watermark has moved.
_CLOSING = "spark.sql.streaming.noDataMicroBatches.enabled"


def run_to_table(stream: DataFrame, name: str, mode: str = "append", closing: bool = True) -> DataFrame:
    """Runs a stream over what is there and returns what it wrote; output and checkpoint live in shared storage.

    closing: ends with a batch without rows, which gives what the last watermark closes and lets state expire.  A stream that gives rows only for rows it reads
    doesn't need it: the state is this run's own and nobody reads it again."""
    spark = stream.sparkSession
    out, state = fresh_path(spark, name), fresh_path(spark, f"{name}-state")
    writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode(mode).trigger(availableNow=True)
    before = spark.conf.get(_CLOSING)
    spark.conf.set(_CLOSING, before if closing else "false")
    try:
        run = writer.start()  # the stream keeps the settings of its start
    finally:
        spark.conf.set(_CLOSING, before)
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def windowed_counts(events: DataFrame, time: str, width: str, *keys: str) -> DataFrame:
    """Counts by window and keys; a window is final once the watermark has passed it (G-S11)."""
    return events.withWatermark(time, LATENESS).groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def first_seen(events: DataFrame, time: str, key: str) -> DataFrame:
    """Each key once, though the source repeats rows within the lateness (G-S2)."""
    return events.withWatermark(time, LATENESS).dropDuplicatesWithinWatermark([key])


def upsert_batches(stream: DataFrame, key: str, newest: str, name: str) -> DataFrame:
    """Latest row of each key after a stream, through foreachBatch (G-S3, G-S4).

    A batch is appended under its number, so that a batch that is tried again replaces itself; reading keeps the newest row of each key."""
    spark = stream.sparkSession
    out, state = fresh_path(spark, name), fresh_path(spark, f"{name}-state")

    def put(batch: DataFrame, number: int) -> None:
        batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), newest).alias("r")).select("r.*").write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(stream.schema).parquet(out)
    return rows.groupBy(key).agg(F.max_by(F.struct(*stream.columns), newest).alias("r")).select("r.*")


def incident_windows(events: DataFrame, key: str, time: str, days: int = 14) -> DataFrame:
    """State of each key's running incident: an event up to `days` after the last joins it, a later one opens the next (G-S5, G-S6).

    One row an incident and batch that touched it: key, first, last, n; an incident is named by its key and first time.  A key's state goes once the watermark
    has passed the time in which an event could join, so the state holds the keys of the last days alone.  Events later than the watermark are dropped; others that come out
    of order join the running incident and never move its beginning."""
    reach = days * 86_400

    def update(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        first, last, n = state.get if state.exists else (None, None, 0)
        times = sorted(t.timestamp() for frame in frames for t in frame[time])
        touched = {}
        for t in times:
            if first is None or t > last + reach:
                first, last, n = t, t, 0
            last, n = max(last, t), n + 1
            touched[first] = (name[0], first, last, n)
        state.update((first, last, n))
        _expire(state, last + reach)
        yield pd.DataFrame(list(touched.values()), columns=[key, "first", "last", "n"])

    kind = f"{key} long, first double, last double, n long"
    return events.withWatermark(time, LATENESS).select(key, time).groupBy(key).applyInPandasWithState(update, kind, "first double, last double, n long", "append", GroupStateTimeout.EventTimeTimeout)


def _expire(state: GroupState, seconds: float) -> None:
    """The state is looked at again when the watermark passes this time; one that it has passed already counts from now."""
    state.setTimeoutTimestamp(max(int(seconds * 1000), state.getCurrentWatermarkMs()) + 1000)


#: Likeness at which an article joins an open incident, tokens after which an incident's text grows no more.
ALIKE, MOST_TOKENS = 0.35, 300


def incident_states(articles: DataFrame, key: str, time: str, tokens: str, field: str, days: int = 14) -> DataFrame:
    """Open incidents of each key with their texts: an article joins the most alike incident whose days it is near to, else it opens one (G-S6).

    One row an incident and batch that touched it: key, first, last, n, tokens (how many the incident has), field (its first known value).  Of equally alike incidents the
    earliest counts; articles of one batch go by time.  An incident is forgotten once the watermark has passed its last day by `days`, and a key with its last
    incident; so a key's state is bounded by the incidents of some days, at most MOST_TOKENS tokens and one article's each."""
    reach = days * 86_400

    def update(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else []
        touched = {}
        if not state.hasTimedOut:
            rows = sorted((t.timestamp(), sorted(set(words)), value or "") for frame in frames for t, words, value in zip(frame[time], frame[tokens], frame[field].fillna("")))
            open_ = [(o, set(o["tokens"])) for o in held]
            for t, words, value in rows:
                # articles come by time: an incident that ended too long before this one is out of reach for the rest of the batch
                open_ = [x for x in open_ if t <= x[0]["last"] + reach]
                own, best, at = set(words), 0.0, None
                for o, text in open_:
                    if not words or o["first"] - reach > t:
                        continue
                    both = len(own & text)
                    like = both / (len(own) + len(text) - both)
                    if like >= ALIKE and like > best:
                        best, at = like, (o, text)
                if at is None:
                    at = {"first": t, "last": t, "n": 0, "tokens": [], "field": None}, set()
                    held.append(at[0])
                    open_.append(at)
                o, text = at
                o["last"], o["n"], o["field"] = max(o["last"], t), o["n"] + 1, o["field"] or value or None
                if len(text) < MOST_TOKENS and not own <= text:
                    text |= own
                    o["tokens"] = sorted(text)
                touched[id(o)] = (name[0], o["first"], o["last"], o["n"], len(text), o["field"])
        mark = state.getCurrentWatermarkMs() / 1000
        held = [o for o in held if o["last"] + reach >= mark]
        if held:
            state.update((json.dumps(held),))
            _expire(state, min(o["last"] for o in held) + reach)
        elif state.exists:
            state.remove()
        if touched:
            yield pd.DataFrame(list(touched.values()), columns=[key, "first", "last", "n", "tokens", "field"])

    kind = f"{key} long, first double, last double, n long, tokens long, field string"
    return articles.withWatermark(time, LATENESS).select(key, time, tokens, field).groupBy(key).applyInPandasWithState(update, kind, "held string", "append", GroupStateTimeout.EventTimeTimeout)
