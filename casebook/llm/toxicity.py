"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Fitting takes a bounded sample of labelled documents (SAMPLE).  Words far more frequent in toxic documents than
in others form a lexicon graded by log-odds.  The field has two states; a token's emission depends on its own grade and its neighbours', and
neighbouring states interact.  Only documents are labelled, so which tokens are toxic is hidden: in a window of a harmless document none is; in a window around a
graded word of a toxic one some is, but for a share of HARMLESS.  The weights maximize the likelihood of that, summed over all token labels that agree with it; what
the gradient takes for a token's label is its marginal under the weights so far, given that its window has a toxic token.

Scoring runs forward-backward over all tokens of a whole text.  Tokens away from any graded word emit alike, so a stretch of them
is one power of the transfer matrix: exact, and as cheap as the graded words are few.  The marginals give the offending spans; a
logistic curve fitted on the sample turns their maximum and sum into the document's score.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.llm.common import release, table
from casebook.llm.vocab import slices

#: At most so many labelled documents of each class are fitted on, the first by a hash of doc_id.  Lexicon and windows come from these and have no bound of their own.
SAMPLE = {1: 6000, 0: 14000}
#: A lexicon word: in at least so many toxic contexts, with so much log-odds against the others and so great a likelihood ratio.
LEAST_CONTEXTS, LEAST_ODDS, LEAST_GAIN = 3, 1.5, 20.0
#: Upper ends of the grades 1, 2, ... of log-odds; the share of windows in toxic documents that are taken to be harmless.
GRADES, HARMLESS = (2.0, 3.0, 4.0), 0.3
#: Windows of tokens for fitting: their reach on both sides of a graded word.
REACH = 5
#: Powers of the transfer matrix kept; further ones equal their limit.
POWERS = 64
STRIP = ".,;:!?\"'()[]{}<>*_-#|~`"


@dataclass
class Model:
    lexicon: dict[str, int] = field(default_factory=dict)
    own: np.ndarray = field(default_factory=lambda: np.zeros(len(GRADES) + 2))
    before: np.ndarray = field(default_factory=lambda: np.zeros(len(GRADES) + 2))
    after: np.ndarray = field(default_factory=lambda: np.zeros(len(GRADES) + 2))
    move: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    curve: np.ndarray = field(default_factory=lambda: np.array([0.0, 0.0, 0.0]))

    def emissions(self, grades: np.ndarray) -> np.ndarray:
        """Of each token the score of the toxic state over the other; axis -1 runs along the tokens."""
        left = np.zeros_like(grades)
        right = np.zeros_like(grades)
        left[..., 1:], right[..., :-1] = grades[..., :-1], grades[..., 1:]
        return self.own[grades] + self.before[left] + self.after[right]


def word_of(token: str) -> str:
    return token.lower().strip(STRIP)


def grade_tokens(texts: pa.Array, lexicon: dict[str, int]):
    """(text, token number, start, end, grade) arrays of graded tokens, and how many tokens each text has."""
    texts = pc.fill_null(texts, "")
    for gap in "\t\n\v\f\r":
        texts = pc.replace_substring(texts, gap, " ")
    lists = pc.split_pattern(texts, " ")
    offsets = np.asarray(lists.offsets, np.int64)
    offsets = offsets - offsets[0]
    coded = lists.flatten().dictionary_encode()
    codes = np.asarray(coded.indices)
    grade = np.fromiter((lexicon.get(word_of(w), 0) for w in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
    sizes = np.asarray(pc.utf8_length(coded.dictionary), np.int64)[codes]
    number = np.concatenate([[0], np.cumsum(sizes > 0)])
    place = np.concatenate([[0], np.cumsum(sizes + 1)])
    at = np.flatnonzero(grade[codes])
    text = np.searchsorted(offsets, at, "right") - 1
    start = place[at] - place[offsets[text]]
    return text, number[at] - number[offsets[text]], start, start + sizes[at], grade[codes[at]], np.diff(number[offsets])


def fit_field(grades: np.ndarray, toxic_doc: np.ndarray, weight: np.ndarray, rounds: int = 300, rate: float = 0.1, decay: float = 1e-3, harmless: float = HARMLESS) -> Model:
    """Weights from weighted windows (rows) of grades, by Adam on the exact log-likelihood.

    toxic_doc: whether a window is of a toxic document, where token labels are hidden but not all harmless (with a chance of 1 - harmless), or of another, where all are."""
    model = Model()
    model.own[:] = np.arange(len(model.own)) - 2.5  # higher grades start as likelier
    hidden = np.asarray(toxic_doc, bool)
    n, length = grades.shape
    all_ = weight.sum()
    k = len(model.own)
    names = ("own", "before", "after", "move")
    mean = {x: np.zeros_like(getattr(model, x)) for x in names}
    var = {x: np.zeros_like(getattr(model, x)) for x in names}
    left, right = np.zeros_like(grades), np.zeros_like(grades)
    left[:, 1:], right[:, :-1] = grades[:, :-1], grades[:, 1:]
    for turn in range(1, rounds + 1):
        emit = np.stack([np.zeros((n, length)), model.emissions(grades)], -1)
        forward = np.empty((n, length, 2))
        forward[:, 0] = emit[:, 0]
        for t in range(1, length):
            forward[:, t] = np.logaddexp(forward[:, t - 1, :1] + model.move[0], forward[:, t - 1, 1:] + model.move[1]) + emit[:, t]
        back = np.zeros((n, length, 2))
        for t in range(length - 2, -1, -1):
            nxt = emit[:, t + 1] + back[:, t + 1]
            back[:, t] = np.logaddexp(nxt[:, :1] + model.move[:, 0], nxt[:, 1:] + model.move[:, 1])
        total = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        toxic = np.exp(forward[..., 1] + back[..., 1] - total[:, None])
        none = np.minimum(np.exp((length - 1) * model.move[0, 0] - total), 1 - 1e-9)  # that no token is toxic
        some = np.where(hidden, (1 - harmless) * (1 - none) / ((1 - harmless) * (1 - none) + harmless * none), 0.0)
        given = some / (1 - none)  # what a marginal grows by if some token is toxic, times how sure that is
        miss = (given - 1)[:, None] * toxic * weight[:, None]
        grad = {x: np.bincount(g.ravel(), miss.ravel(), k) / all_ for x, g in (("own", grades), ("before", left), ("after", right))}
        pair = np.exp(forward[:, :-1, :, None] + model.move + (emit + back)[:, 1:, None, :] - total[:, None, None, None])
        pair = pair.sum(1)
        still = np.zeros((2, 2))
        still[0, 0] = length - 1
        want = given[:, None, None] * (pair - none[:, None, None] * still) + (1 - some)[:, None, None] * still
        grad["move"] = ((want - pair) * weight[:, None, None]).sum(0) / all_
        for x in names:
            g = grad[x] - decay * getattr(model, x)
            mean[x] = 0.9 * mean[x] + 0.1 * g
            var[x] = 0.999 * var[x] + 0.001 * g * g
            getattr(model, x)[...] += rate * mean[x] / (1 - 0.9**turn) / (np.sqrt(var[x] / (1 - 0.999**turn)) + 1e-8)
    return model


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.move = np.exp(model.move)
        self.base = float(np.exp(model.emissions(np.zeros(3, np.int64))[1]))
        step = self.move * np.array([1.0, self.base])
        power, self.powers = np.eye(2), []
        for _ in range(POWERS + 1):
            self.powers.append(power)
            power = power @ step
            power = power / power.max()

    def marginals(self, number: np.ndarray, grade: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Token numbers beside or under a graded word, and their marginals of the toxic state in a text of n tokens."""
        spots = np.unique(np.clip(np.concatenate([number - 1, number, number + 1]), 0, n - 1))
        where = np.searchsorted(spots, number)
        own, left, right = np.zeros(len(spots), np.int64), np.zeros(len(spots), np.int64), np.zeros(len(spots), np.int64)
        own[where] = grade
        near = np.diff(spots) == 1
        left[1:][near], right[:-1][near] = own[:-1][near], own[1:][near]
        emit = np.exp(self.model.own[own] + self.model.before[left] + self.model.after[right]).tolist()
        gaps = np.diff(np.concatenate([[-1], spots, [n]])) - 1
        power = [self.powers[min(g, POWERS)] for g in gaps.tolist()]
        forward, ahead = [], np.array([1.0, 1.0])
        for i, e in enumerate(emit):
            if i == 0:
                # before the first spot: a stretch that starts freely
                ahead = (np.array([1.0, self.base]) @ self.powers[min(int(gaps[0]) - 1, POWERS)] @ self.move if gaps[0] else np.ones(2)) * np.array([1.0, e])
            else:
                ahead = ahead @ power[i] @ self.move * np.array([1.0, e])
            ahead = ahead / ahead.sum()
            forward.append(ahead)
        back = self.powers[min(int(gaps[-1]), POWERS)] @ np.ones(2)
        out = np.empty(len(emit))
        for i in range(len(emit) - 1, -1, -1):
            both = forward[i] * back
            out[i] = both[1] / both.sum()
            back = power[i] @ (self.move @ (np.array([1.0, emit[i]]) * back)) if i else back
            back = back / back.max()
        return spots, out

    def texts(self, texts: pa.Array):
        """Of each text: greatest marginal, sum of marginals, spans [(start, end, marginal)]."""
        text, number, start, end, grade, n = grade_tokens(texts, self.model.lexicon)
        most, total, spans = np.zeros(len(texts)), np.zeros(len(texts)), [[] for _ in range(len(texts))]
        cuts = np.flatnonzero(np.diff(text)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(text)]):
            if a == b:
                continue
            i = int(text[a])
            spots, p = self.marginals(number[a:b], grade[a:b], int(n[i]))
            most[i], total[i] = p.max(), p.sum()
            own = p[np.searchsorted(spots, number[a:b])]
            for k in range(a, b):
                if own[k - a] >= 0.5:
                    if spans[i] and number[k] == number[k - 1] + 1 and own[k - a - 1] >= 0.5:
                        spans[i][-1] = (spans[i][-1][0], int(end[k]), max(spans[i][-1][2], float(own[k - a])))
                    else:
                        spans[i].append((int(start[k]), int(end[k]), float(own[k - a])))
        return most, total, spans

    def score(self, most: np.ndarray, total: np.ndarray) -> np.ndarray:
        a, b, c = self.model.curve
        return 1 / (1 + np.exp(-np.clip(a + b * most + c * np.log1p(total), -30, 30)))


def held_out(doc_id: Column) -> Column:
    """Documents that no fit may see: a checksum of doc_id divisible by 5."""
    return F.crc32(doc_id.cast("string")) % 5 == 0


def known_labels(labels: DataFrame) -> DataFrame:
    """doc_id, toxic (0 or 1) of all labelled documents that aren't held out; of repeated labels the greater counts."""
    return labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out(F.col("doc_id")))


def class_weights(labels: DataFrame) -> dict[int, float]:
    """What a sampled document of each class counts for: labelled documents that aren't held out over those picked, so that the curve's threshold is that of
    all labelled documents at any size."""
    found = {r["toxic"]: r["count"] for r in known_labels(labels).groupBy("toxic").count().collect()}
    return {c: max(1.0, found.get(c, 0) / SAMPLE[c]) for c in SAMPLE}


def fitting_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, toxic of at most SAMPLE labelled documents of each class that aren't held out; of rows that share a doc_id the least text.

    The list of ids has a fixed bound, so it is broadcast."""
    known = known_labels(labels)
    pick = lambda label: known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE[label])
    met = docs.select("doc_id", "text").join(F.broadcast(pick(1).union(pick(0))), "doc_id")
    return met.groupBy("doc_id").agg(F.min("text").alias("text"), F.any_value("toxic").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits lexicon, field and curve; without documents of both classes, a model that scores all alike."""
    sample = fitting_sample(docs, labels).persist()
    try:
        counts = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
        if not (counts.get(0) and counts.get(1)):
            return Model(curve=np.array([-3.0 if not counts.get(1) else 3.0, 0.0, 0.0]))
        plain = F.transform(F.split(F.lower("text"), r"[\x20\x09-\x0D]+"), lambda w: F.btrim(w, F.lit(STRIP)))
        tokens = F.transform("w", lambda w, i: F.struct(w.alias("word"), F.coalesce(F.get("w", i - 1), F.lit("")).alias("before")))
        # a word counts once for each word before it, so copies of one text don't count for more
        contexts = sample.select("toxic", plain.alias("w")).select("toxic", F.explode(tokens).alias("t")).select("toxic", "t.*").where("word <> ''").distinct()
        words = contexts.groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).persist()
        all_t, all_c = (x or 1 for x in words.agg(F.sum("t"), F.sum("c")).first())  # 1: a class whose texts have no words
        t, c, share = F.col("t").cast("double"), F.col("c").cast("double"), all_t / (all_t + all_c)
        odds = F.log((t + 0.5) / (all_t + 1)) - F.log((c + 0.5) / (all_c + 1))
        gain = 2 * (t * F.log(t / ((t + c) * share)) + F.when(c > 0, c * F.log(c / ((t + c) * (1 - share)))).otherwise(0.0))
        graded = words.where(t >= LEAST_CONTEXTS).withColumns({"odds": odds, "gain": gain}).where((F.col("odds") >= LEAST_ODDS) & (F.col("gain") >= LEAST_GAIN))
        rows = graded.collect()  # words of the sample
        words.unpersist()
        lexicon = {r["word"]: 1 + sum(r["odds"] >= g for g in GRADES) for r in rows}

        def windows(batches):
            for batch in batches:
                for at, texts in slices(batch.column(0)):
                    toxic = np.asarray(batch.column(1).slice(at, len(texts)))
                    text, number, _, _, grade, n = grade_tokens(texts, lexicon)
                    grid = np.zeros((len(text) + len(n), 2 * REACH + 1), np.int64)
                    for shift in range(-REACH, REACH + 1):  # graded tokens stand in order: those near are within REACH places
                        k = np.arange(max(0, -shift), len(text) - max(0, shift))
                        gap = number[k + shift] - number[k]
                        near = (text[k + shift] == text[k]) & (abs(gap) <= REACH)
                        grid[k[near], gap[near] + REACH] = grade[k[near] + shift]
                    label = np.concatenate([toxic[text], np.zeros(len(n), np.int64)])  # the last rows: a plain window a text
                    yield pa.RecordBatch.from_arrays([pa.array(list(grid)), pa.array(label.astype(np.int64))], names=["grades", "toxic"])
            release()

        found = sample.select("text", F.col("toxic").cast("long").alias("toxic")).mapInArrow(windows, "grades array<long>, toxic long")
        kinds = found.groupBy("grades", "toxic").count().orderBy("toxic", "grades").collect()  # kinds of windows in the sample
        grades = np.array([r["grades"] for r in kinds], np.int64)
        toxic = np.array([r["toxic"] for r in kinds], np.int64)
        model = fit_field(grades, toxic == 1, np.sqrt([r["count"] for r in kinds]))
        model.lexicon = lexicon

        def features(batches):
            scorer = Scorer(model)
            for batch in batches:
                for at, texts in slices(batch.column(0)):
                    most, total, _ = scorer.texts(texts)
                    yield pa.RecordBatch.from_arrays([pa.array(most), pa.array(total), batch.column(1).slice(at, len(texts))], names=["most", "total", "toxic"])
            release()

        rows = sample.select("text", F.col("toxic").cast("long").alias("toxic")).mapInArrow(features, "most double, total double, toxic long").collect()  # SAMPLE rows at most
        own = class_weights(labels)
        weights = np.array([own[r["toxic"]] for r in rows])
        model.curve = _logistic(np.array([[1.0, r["most"], math.log1p(r["total"])] for r in rows]), np.array([r["toxic"] for r in rows], float), weights / weights.mean())
        return model
    finally:
        sample.unpersist()


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Logistic regression of weighted rows by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * (p * (1 - p) + 1e-9))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (weight * (y - p)) - ridge * w)
        w = w + step
        if abs(step).max() < 1e-8:
            break
    return w


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text) to doc_id, score (0 to 1), spans (start, end in code points, marginal), one row for each row.

    A null text counts as empty; a text without graded words has the curve's lowest score and no spans."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))

    def run(batches):
        scorer = Scorer(model)
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                most, total, spans = scorer.texts(texts)
                rows = [[{"start": s, "end": e, "marginal": p} for s, e, p in x] for x in spans]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(scorer.score(most, total)), pa.array(rows, kind)], names=["doc_id", "score", "spans"])
        release()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, spans array<struct<start:int,end:int,marginal:double>>")


def keep_clean(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """Rows of `docs` that score below the limit, with all their columns, whatever else those are called.

    A null or empty text has the lowest score and stays; repeated rows stay or go together; an empty table stays empty."""
    at = docs.columns.index("text")

    def run(batches):
        scorer = Scorer(model)
        for batch in batches:
            for first, texts in slices(batch.column(at)):
                most, total, _ = scorer.texts(texts)
                yield batch.slice(first, len(texts)).filter(pa.array(scorer.score(most, total) < limit))
        release()

    return docs.mapInArrow(run, docs.schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents: one row for each row, so repeated rows score alike.

    A null or empty text has the lowest score; a text of any length is scored whole; a null doc_id counts as not held out and is never fitted on; labels other than
    0 and 1 are ignored, and of repeated ones the greater counts; other columns don't matter.  An empty table gives an empty table."""
    docs = table(spark, sf_dir, "documents")
    found = score(docs, fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")))
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), F.size("spans").alias("n_spans"),
                        F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias("spans"))
