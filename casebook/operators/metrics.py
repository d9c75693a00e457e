"""How the flows compare as of a moment: coverage, speed, accuracy, agreement, missed hoaxes, guidance, verdicts, bias (L-12, L-13, A-21 to A-25).

Every incident becomes one row with the latest output of each flow; all measures are sums over these rows in one pass, then
laid out as (metric, flow, field, value, n) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook.functions.text import normalize_text
from casebook.operators.ordering import medians
from casebook.operators.records import JUDGED, same_value

FLOWS = ("D1", "D2", "D3", "D4")
#: Statuses that remove or defer a row, levels of trust, verdicts, and what makes a verdict.
REMOVED, PENDING = "removed", "pending"
LEVELS = ("high", "medium", "low", "no_score")
VERDICTS = ("true", "hoax", "undecided")
VERDICT_OF_STATUS = {"high": "true", "confirmed": "true", "refuted": "hoax"}
JUDGEMENT = {"D2": {"agree": True, "disagree": False}, "D3": {"confirmed": True, "refuted": False}}


def verdict(flow: Column, status: Column, basis_verdict: Column) -> Column:
    """What an output concludes: of the public's flow what its basis says, of others what the status means, else undecided (L-13)."""
    table = F.create_map(*[F.lit(x) for pair in VERDICT_OF_STATUS.items() for x in pair])
    public = F.when(basis_verdict.isin(*VERDICTS), basis_verdict)
    return F.coalesce(F.when(flow == "D2", public).otherwise(F.try_element_at(table, status)), F.lit("undecided"))


def outputs_as_of(log: DataFrame, as_of: Column) -> DataFrame:
    """One row an incident: the struct of each flow's latest output up to a moment, null if it has none, and when the flow first had one.

    log: output_id, incident, flow, the JUDGED fields, status, basis_verdict, field_status (map), steps, audience, topics (arrays), recorded_at.
    Removed rows don't count, nor pending ones without a verdict."""
    seen = log.where(F.col("recorded_at") <= as_of).withColumn("verdict", verdict(F.col("flow"), F.col("status"), F.col("basis_verdict")))
    rest = [c for c in seen.columns if c not in ("incident", "flow")]
    newest = seen.groupBy("incident", "flow").agg(F.max_by(F.struct(*rest), "output_id").alias("r"), F.min_by("recorded_at", "output_id").alias("first"))
    live = (F.col("r.status") != REMOVED) & ((F.col("r.status") != PENDING) | (F.col("r.verdict") != "undecided"))
    one = lambda f, c: F.any_value(F.when(F.col("flow") == f, c), True).alias
    return newest.groupBy("incident").agg(*[one(f, F.when(live, F.col("r")))(f) for f in FLOWS], *[one(f, F.col("first"))(f"first_{f}") for f in FLOWS])


def _jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def compare(rows: DataFrame, begun: DataFrame) -> DataFrame:
    """outputs_as_of() rows and (incident, begin) first reports to (metric, flow, field, value, n) rows; a measure without cases is null."""
    d = {f: F.col(f) for f in FLOWS}
    have = {f: F.col(f).isNotNull() for f in FLOWS}
    n = lambda cond: F.count_if(F.coalesce(cond, F.lit(False)))
    share = lambda hits, all_: F.when(all_ > 0, hits / all_)
    # the machine's first output of all: speed counts from incidents that began after it
    started = F.lit(rows.agg(F.min("first_D1")).first()[0])
    met = rows.join(begun, "incident", "left")
    hours = {f: F.when(F.col("begin") >= started, F.greatest(F.lit(0.0), (F.unix_timestamp(F.col(f"first_{f}").cast("timestamp")) - F.unix_timestamp(F.col("begin").cast("timestamp"))) / 3600)) for f in FLOWS}
    confirmed, refuted = d["D4"]["status"] == "confirmed", d["D4"]["status"] == "refuted"
    middle = dict(zip(FLOWS, medians(met, list(hours.values()))))
    out: list[tuple[str, str, str, Column, Column]] = []
    total = n(have["D1"])
    for f in FLOWS:
        out.append(("coverage", f, "", n(have[f]).cast("double"), total))
        if f != "D1":
            out.append(("coverage_share", f, "", share(n(have[f]), total), total))
        out.append(("median_hours", f, "", F.lit(middle[f]).cast("double"), F.count(hours[f])))
    for x in JUDGED:
        truth, mine = d["D4"][x], d["D1"][x]
        # values are normalized before they are compared, and an empty one is none
        some = lambda c: F.nullif(normalize_text(c), F.lit(""))
        case = confirmed & some(truth).isNotNull() & have["D1"]
        wrong = F.coalesce(F.try_element_at(d["D4"]["field_status"], F.lit(x)) == "refuted", F.lit(False))
        right = some(mine).isNotNull() & F.coalesce(same_value(x, mine, truth), F.lit(False)) & ~wrong
        tp, fn, fp = n(case & right), n(case & ~right), n(case & ~right & some(mine).isNotNull())
        p, r = share(tp, tp + fp), share(tp, tp + fn)
        out += [("precision", "D1", x, p, tp + fn), ("recall", "D1", x, r, tp + fn), ("f1", "D1", x, F.when((p > 0) & (r > 0), 2 * p * r / (p + r)), tp + fn)]
        said = {}
        for f, meaning in JUDGEMENT.items():
            mark = F.try_element_at(d[f]["field_status"], F.lit(x))
            said[f] = F.when(mark.isin(*[k for k, v in meaning.items() if v]), True).when(mark.isin(*[k for k, v in meaning.items() if not v]), False)
            agrees = some(d[f][x]).isNotNull() & F.coalesce(same_value(x, d[f][x], truth), F.lit(False)) & ~wrong
            judged = confirmed & some(truth).isNotNull() & have[f] & said[f].isNotNull()
            out.append(("judged_right", f, x, share(n(judged & (said[f] == agrees)), n(judged)), n(judged)))
        both = said["D2"].isNotNull() & said["D3"].isNotNull()
        k = n(both)
        same, a, b = n(both & (said["D2"] == said["D3"])) / k, n(both & said["D2"]) / k, n(both & said["D3"]) / k
        chance = a * b + (1 - a) * (1 - b)
        out += [("agreement", "D2-D3", x, F.when(k > 0, same), k), ("kappa", "D2-D3", x, F.when((k > 0) & (chance < 1), (same - chance) / (1 - chance)), k)]
    hoaxes = n(refuted)
    out += [("hoaxes_refuted", "D4", "", hoaxes.cast("double"), n(have["D4"])), ("hoaxes_passed", "D1", "", n(refuted & d["D1"]["status"].isin("high", "medium")).cast("double"), hoaxes),
            ("hoaxes_passed", "D2", "", n(refuted & (d["D2"]["status"] == "agree")).cast("double"), hoaxes)]
    for part in ("steps", "audience", "topics"):
        chosen, offered = d["D4"][part], F.coalesce(d["D1"][part], F.array().cast("array<string>"))
        case = have["D1"] & (F.size(chosen) > 0)
        out.append((f"{part}_jaccard", "D1-D4", "", F.avg(F.when(case, _jaccard(offered, chosen))), n(case)))
        if part == "steps":
            out.append(("steps_added", "D4", "", share(n(case & (F.size(F.array_except(chosen, offered)) > 0)), n(case)), n(case)))
    for f in FLOWS:
        for v in VERDICTS:
            out.append(("verdict", f, v, n(have[f] & (d[f]["verdict"] == v)).cast("double"), n(have[f])))
        if f != "D4":
            sure = have[f] & have["D4"] & (d[f]["verdict"] != "undecided")
            out.append(("verdict_as_official", f, "", share(n(sure & (d[f]["verdict"] == d["D4"]["verdict"])), n(sure)), n(sure)))
    reached = have["D1"] & have["D4"]
    for level in LEVELS:
        out += [("bias_all", "D1", level, share(n(have["D1"] & (d["D1"]["status"] == level)), total), total), ("bias_reached", "D1", level, share(n(reached & (d["D1"]["status"] == level)), n(reached)), n(reached))]
    wide = met.agg(*[F.struct(F.lit(m).alias("metric"), F.lit(f).alias("flow"), F.lit(x).alias("field"), v.cast("double").alias("value"), c.cast("long").alias("n")).alias(f"m{i}") for i, (m, f, x, v, c) in enumerate(out)])
    return wide.select(F.inline(F.array(*[F.col(f"m{i}") for i in range(len(out))])))
