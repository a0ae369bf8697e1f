"""Span-matching quality metrics as joins and aggregations. Spans are rows (doc_id, start, end, label[, action])."""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import blocks
from .intervals import by_document, dealt, one_to_one, sweep

SPAN_KEY = ["doc_id", "start", "end", "label"]


def ratio(x: Column, y: Column) -> Column:
    """x / y, null where y is 0."""
    return F.try_divide(x.cast("double"), F.nullif(y.cast("double"), F.lit(0.0)))


def with_ratios(df: DataFrame) -> DataFrame:
    """precision, recall, f1, false-positive rate from tp, fp, tn, fn."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return df.select("*", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(fp, fp + tn).alias("fp_rate"))


def dedupe_predictions(predicted: DataFrame) -> DataFrame:
    """Exactly equal predictions once, and how many were dropped of each."""
    return predicted.groupBy(*SPAN_KEY, "action").agg((F.count("*") - 1).alias("n_dropped"))


def exact_counts(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """tp, fp, fn per document and label; equal spans match one to one, those with a null anywhere none."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    rows = expected.select(*SPAN_KEY, one.alias("ne"), none.alias("np")).unionByName(predicted.select(*SPAN_KEY, none.alias("ne"), one.alias("np")))
    both = dealt(rows, "doc_id").groupBy(*SPAN_KEY).agg(F.sum("ne").alias("ne"), F.sum("np").alias("np"))
    hit = F.when(reduce(and_, [F.col(c).isNotNull() for c in SPAN_KEY]), F.least("ne", "np")).otherwise(none)
    return both.groupBy("doc_id", "label").agg(F.sum(hit).alias("tp"), F.sum(F.col("np") - hit).alias("fp"), F.sum(F.col("ne") - hit).alias("fn"))


def greedy_matches(expected: DataFrame, predicted: DataFrame, same_label: bool = True) -> DataFrame:
    """(doc_id, e_start, ..., p_label): overlapping pairs taken one to one, exact ones first, then by overlap. Spans of a
    document stream by in order of their starts; only spans that hang together are held at a time."""

    def tell(start: list, end: list, label: list, ne: list, np_: list) -> list[tuple]:
        own = one_to_one(start, end, label, ne, np_, same_label)
        return [(start[i], end[i], label[i], start[j], end[j], label[j], n) for i, j, n in own]

    out = "e_start int, e_end int, e_label string, p_start int, p_end int, p_label string, n long"
    found = by_document(expected, predicted, ["doc_id"], ["label"], tell, out)
    return found.withColumn("n", F.explode(F.array_repeat("n", F.col("n").cast("int")))).drop("n")


def relaxed_counts(expected: DataFrame, predicted: DataFrame, same_label: bool = True) -> DataFrame:
    """(doc_id, tp, fp, fn) of spans matched by overlap, one to one."""

    def tell(start: list, end: list, label: list, ne: list, np_: list) -> list[tuple]:
        return [(sum(n for *_, n in one_to_one(start, end, label, ne, np_, same_label)), sum(np_), sum(ne))]

    each = by_document(expected, predicted, ["doc_id"], ["label"], tell, "tp long, p long, e long")
    total = each.groupBy("doc_id").agg(F.sum("tp").alias("tp"), F.sum("p").alias("p"), F.sum("e").alias("e"))
    return total.select("doc_id", "tp", (F.col("p") - F.col("tp")).alias("fp"), (F.col("e") - F.col("tp")).alias("fn"))


def document_negatives(docs: DataFrame, expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """(doc_id, tn): 1 for documents with neither expected nor predicted spans."""
    some = expected.select("doc_id").unionByName(predicted.select("doc_id")).distinct()
    return docs.select("doc_id").join(some.withColumn("s", F.lit(1)), "doc_id", "left").select("doc_id", F.when(F.col("s").isNull(), 1).otherwise(0).alias("tn"))


def action_accuracy(matches: DataFrame, expected_actions: DataFrame, predicted_actions: DataFrame) -> DataFrame:
    m = matches.join(expected_actions, ["doc_id", "e_start", "e_end"]).join(predicted_actions, ["doc_id", "p_start", "p_end"])
    good = F.sum((F.col("e_action") == F.col("p_action")).cast("int"))
    return m.filter("e_action IS NOT NULL").agg(F.count("*").alias("n"), good.alias("n_right"), ratio(good, F.count("*")).alias("accuracy"))


def grouped(counts: DataFrame, *by: str) -> DataFrame:
    return with_ratios(counts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "tn", "fn")]))


def multi_axis(counts: DataFrame, axes: list[str]) -> DataFrame:
    """One row per value of each axis: GROUPING SETS over a single scan of the counts."""
    view = counts.select(*axes, "tp", "fp", "tn", "fn")
    sets = ", ".join(f"(`{a}`)" for a in axes)
    name = "CASE " + " ".join(f"WHEN grouping(`{a}`) = 0 THEN '{a}'" for a in axes) + " END"
    value = "coalesce(" + ", ".join(f"CAST(`{a}` AS STRING)" for a in axes) + ")"
    sums = ", ".join(f"sum({c}) AS {c}" for c in ("tp", "fp", "tn", "fn"))
    return with_ratios(counts.sparkSession.sql(f"SELECT {name} AS axis, {value} AS value, {sums} FROM {{t}} GROUP BY GROUPING SETS ({sets})", t=view))


def report_axes(samples: DataFrame, annotations: DataFrame, predicted: DataFrame, axes: list[str]) -> DataFrame:
    """(axis, value, n, tp, fp, tn, fn, ratios) of exact counts along axes of samples (doc_id, text, ...), whether their
    entities are mixed, length of text, and each assertion_type that annotations (spans with assertion_type) hold."""
    counts = exact_counts(annotations, predicted).groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    kinds = dealt(annotations.select("doc_id", "label", "assertion_type"), "doc_id").groupBy("doc_id").agg(F.size(F.collect_set("label")).alias("kinds"), F.collect_set("assertion_type").alias("said"))
    mixed = F.when(F.col("kinds").isNull(), "negative").when(F.col("kinds") > 1, "mixed_entities").otherwise("single_entity_type")
    length = F.when(F.length("text") < 80, "short").when(F.length("text") < 300, "medium").otherwise("long")
    own = samples.join(counts, "doc_id", "left").join(kinds, "doc_id", "left")
    own = own.select("doc_id", *axes, mixed.alias("mixed"), length.alias("text_length"), "said", F.lit(1).alias("n"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tp", "fp", "fn")], F.col("tp").isNull().cast("long").alias("tn"))
    names = [*axes, "mixed", "text_length"]
    values = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("string").alias("value")) for a in names])
    said = F.transform(F.coalesce("said", F.array().cast("array<string>")), lambda x: F.struct(F.lit("assertion_type").alias("axis"), x.alias("value")))
    rows = own.select(F.explode(F.concat(values, said)).alias("a"), "n", "tp", "fp", "tn", "fn")
    return with_ratios(rows.groupBy("a.axis", "a.value").agg(*[F.sum(c).alias(c) for c in ("n", "tp", "fp", "tn", "fn")]))


def averages(per_label: DataFrame) -> DataFrame:
    """Micro, macro and support-weighted F1 over labels with support."""
    s = F.col("tp") + F.col("fn")
    f = per_label.filter(s > 0)
    tp, fp, fn = (F.sum(c) for c in ("tp", "fp", "fn"))
    weighted = F.sum(F.when(F.col("f1").isNotNull(), F.col("f1") * s)) / F.nullif(F.sum(F.when(F.col("f1").isNotNull(), s)).cast("double"), F.lit(0.0))
    return f.agg(ratio(2 * tp, 2 * tp + fp + fn).alias("micro_f1"), F.avg("f1").alias("macro_f1"), weighted.alias("weighted_f1"))


def _poisson_steps() -> np.ndarray:
    """Cumulative Poisson(1) probabilities as 64-bit thresholds: a hash's weight is the number of thresholds it reaches."""
    steps, p, total = [], Fraction(math.exp(-1)), Fraction(0)
    for k in range(1, 20):
        total += p
        p /= k
        steps.append(min(int(total * 2**64), 2**64 - 1))
    return np.array(steps, np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def bootstrap_recall(doc_counts: DataFrame, resamples: int = 1000, seed: int = 20260806) -> DataFrame:
    """95 % interval of recall: every document gets a Poisson(1) weight in each resample from a hash of its id and the
    resample, so all resamples come from one distributed pass. Agrees with drawing with replacement up to noise. Weights
    are made and summed in one Arrow stage; only one row per resample and partition is shuffled."""
    steps, turn = _poisson_steps(), _mix(np.arange(1, resamples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, resamples), np.int64)
        for b in batches:
            h, *counts = (c.to_numpy() for c in b.columns)
            h, counts = h.view(np.uint64), np.stack(counts)
            for i in range(0, len(h), 256):
                u = _mix(h[i : i + 256, None] ^ turn)
                weight = np.zeros(u.shape, np.int64)
                for p in steps:
                    some = u >= p
                    if not some.any():
                        break
                    weight += some
                total += counts[:, i : i + 256] @ weight
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(resamples)), pa.array(total[0]), pa.array(total[1])], names=["r", "tp", "fn"])

    count = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c)
    each = doc_counts.select(F.xxhash64("doc_id", F.lit(seed)).alias("h"), count("tp"), count("fn")).mapInArrow(sums, "r long, tp long, fn long")
    recalls = each.groupBy("r").agg(ratio(F.sum("tp"), F.sum(F.col("tp") + F.col("fn"))).alias("recall"))
    return recalls.filter("recall IS NOT NULL").agg(F.percentile("recall", 0.025).alias("low"), F.percentile("recall", 0.975).alias("high"))


def document_decisions(rows: DataFrame) -> DataFrame:
    """Accuracies and leak rate over (expected_unsafe, unsafe, expected_status, status, leaked)."""
    n = F.count("*")
    approved = F.sum((F.col("status") == "ok").cast("int"))
    leaks = F.sum(((F.col("status") == "ok") & F.col("leaked")).cast("int"))
    return rows.agg(n.alias("n"), ratio(F.sum((F.col("expected_unsafe") == F.col("unsafe")).cast("int")), n).alias("unsafe_accuracy"), ratio(F.sum((F.col("expected_status") == F.col("status")).cast("int")), n).alias("disposition_accuracy"), ratio(leaks, approved).alias("approved_leak_rate"))


def tier_check(samples: DataFrame) -> DataFrame:
    """Whether all samples are of one tier."""
    return samples.agg(F.count_distinct("tier").alias("n_tiers")).withColumn("mixed", F.col("n_tiers") > 1)


def multiset_metrics(expected: DataFrame, actual: DataFrame, by: list[str]) -> DataFrame:
    """tp, fp, fn of two multisets of rows; empty denominators count as 1."""
    e, a = expected.groupBy(*by).agg(F.count("*").alias("ne")), actual.groupBy(*by).agg(F.count("*").alias("na"))
    hit = F.least("ne", "na")
    s = e.join(a, by, "full").fillna(0, ["ne", "na"]).agg(F.sum(hit).alias("tp"), F.sum(F.col("na") - hit).alias("fp"), F.sum(F.col("ne") - hit).alias("fn"))
    return s.select("*", F.coalesce(ratio(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(1.0)).alias("precision"), F.coalesce(ratio(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(1.0)).alias("recall"))


def assertion_metrics(expected: DataFrame, actual: DataFrame, samples: DataFrame) -> DataFrame:
    """One row over expected (doc_id, category, negated) and actual assertions (doc_id, position, category, negated,
    n_subjects): multiset counts of (category, negated); how often the first assertion of an expected category names its
    subject and has its negation; and the share of samples (doc_id, n_entities) with nothing to find that still have one."""
    m = multiset_metrics(expected, actual, ["category", "negated"])
    first = actual.groupBy("doc_id", "category").agg(F.min_by(F.struct("negated", "n_subjects"), "position").alias("a"))
    met = expected.join(first, ["doc_id", "category"], "left").agg(
        F.count("*").alias("n"), F.count("a").alias("n_met"), F.count_if(F.col("a.n_subjects") > 0).alias("n_linked"), F.count_if(F.col("a.negated") == F.col("negated")).alias("n_right")
    )
    none = samples.filter("n_entities = 0").join(expected, "doc_id", "left_anti").join(actual.select("doc_id", F.lit(1).alias("hit")).distinct(), "doc_id", "left")
    wrong = none.agg(F.coalesce(ratio(F.count("hit"), F.count("*")), F.lit(0.0)).alias("general_discussion_false_positive_rate"))
    linked = F.coalesce(ratio(F.col("n_linked"), F.col("n_met")), F.lit(1.0)).alias("subject_linking_accuracy")
    right = F.coalesce(ratio(F.col("n_right"), F.col("n")), F.lit(1.0)).alias("negation_accuracy")
    return m.crossJoin(met.select(linked, right)).crossJoin(wrong)  # one row each


def confusion(expected: DataFrame, actual: DataFrame, types: list[str]) -> DataFrame:
    """Expected type by actual type for equal texts of a document."""
    j = expected.select("doc_id", "text", F.col("entity_type").alias("expected")).join(actual.select("doc_id", "text", F.col("entity_type").alias("actual")), ["doc_id", "text"])
    return j.groupBy("expected").pivot("actual", types).count().fillna(0)


# Release groups, and transformations that normalisation undoes.
RELEASE_GROUPS = ("standard_clean", "negative_controls", "supported_adversarial", "partially_supported_adversarial", "unsupported_challenge")
RELEASE_GROUP = """CASE WHEN n_entities = 0 THEN 'negative_controls' WHEN transformation = 'original' THEN 'standard_clean' WHEN support = 'supported' THEN 'supported_adversarial'
WHEN support = 'partial' THEN 'partially_supported_adversarial' WHEN support = 'deliberately_unsupported' THEN 'unsupported_challenge' END"""


def release_group(samples: DataFrame) -> DataFrame:
    """samples (n_entities, transformation, support, ...) with the one group that each counts in."""
    return samples.withColumn("release_group", F.expr(RELEASE_GROUP))


def failures(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """(doc_id, failure) once a kind and document, from both sides.

    Expected spans are matched one to one: exactly, and by overlap of the same label. One without an exact match is an
    oversized or partial span if it has an overlapping match, has a wrong category if something overlaps it, else it is
    missed. Predictions without an exact match conflict with what they overlap, are of a wrong category if none of that
    has their label, and unexpected if they overlap nothing and come once. Equal predictions are duplicates. Where both
    sides have an action, matched spans whose actions differ are a defect of the policy's decision.

    All kinds come from one shuffle by document: equal spans are counted, the rest follows from a sweep of what overlaps.
    """
    acts = "action" in expected.columns and "action" in predicted.columns

    def spans(df: DataFrame) -> DataFrame:
        return df.select(*SPAN_KEY, "action" if acts else F.lit(None).cast("string").alias("action"))

    def tell(start: list, end: list, label: list, action: list, ne: list, np_: list) -> list[tuple]:
        return [(x,) for x in sorted(_kinds(start, end, label, action, ne, np_))]

    return by_document(spans(expected), spans(predicted), ["doc_id"], ["label", "action"], tell, "failure string").distinct()


def _kinds(start: list, end: list, label: list, action: list, ne: list, np_: list) -> set[str]:
    """The failures of one island. Its rows tell spans and actions; spans that differ in their action alone are one span."""
    spans: dict[tuple, list[int]] = {}
    for i, x in enumerate(zip(start, end, label, strict=True)):
        spans.setdefault(x, []).append(i)
    keys = list(spans)
    starts, ends, labels = (list(c) for c in zip(*keys, strict=True))
    many, times = ([sum(n[i] for i in own) for own in spans.values()] for n in (ne, np_))
    matched = one_to_one(starts, ends, labels, many, times)
    kinds: set[str] = set()
    exact, loose = [min(a, b) for a, b in zip(many, times, strict=True)], [0] * len(keys)
    for i, j, n in matched:
        if i != j:
            loose[i] += n
            kinds.add("oversized_span" if starts[j] <= starts[i] and ends[j] >= ends[i] else "partial_span")
        if _defect([(action[r], ne[r]) for r in spans[keys[i]] if ne[r]], [(action[r], np_[r]) for r in spans[keys[j]] if np_[r]], n):
            kinds.add("policy_decision_defect")
    met, same = [0] * len(keys), [False] * len(keys)
    if any(a > x + y for a, x, y in zip(many, exact, loose, strict=True)) or any(b > x for b, x in zip(times, exact, strict=True)):
        rows = [(s, r, e, i) for i, (s, e) in enumerate(zip(starts, ends, strict=True)) for r, n in ((0, many[i]), (1, times[i])) if n]
        rows.sort()
        s, r, e, own = (np.array(c, np.int64) for c in zip(*rows, strict=True))
        touched = set()
        for i, j in zip(*sweep(np.zeros(len(s), np.int64), r, s, e, s), strict=True):
            i, j = int(own[i]), int(own[j])
            touched.add(i)
            met[j] += 1
            same[j] |= labels[i] == labels[j]
        for i in range(len(keys)):
            if many[i] > exact[i] + loose[i]:
                kinds |= {"wrong_category", "overlapping_prediction_conflict"} if i in touched else {"missed_entity"}
            if times[i] > exact[i]:
                if met[i]:
                    kinds |= {"overlapping_prediction_conflict"} if same[i] else {"overlapping_prediction_conflict", "wrong_category"}
                elif times[i] == 1:
                    kinds.add("unexpected_false_positive")
    if any(n > 1 for n in times):
        kinds.add("duplicate_prediction")
    return kinds


def _defect(wanted: list[tuple], given: list[tuple], n: int) -> bool:
    """Whether some of n matches between copies of two spans, taken in the order of their actions, differ in a stated action."""
    spread = lambda rows: [a for a, times in rows for _ in range(min(times, n))][:n]
    return any(a is not None and a != b for a, b in zip(spread(wanted), spread(given), strict=True))


def sample_failures(kinds: DataFrame, samples: DataFrame, normalising: tuple[str, ...]) -> DataFrame:
    """failures() and what they come to for a sample's transformation: unsupported, or a fault of normalisation."""
    own = kinds.join(samples.select("doc_id", "transformation", "support"), "doc_id")
    unsupported = own.filter("support = 'deliberately_unsupported'").select("doc_id", F.lit("unsupported_transformation").alias("failure"))
    missed = own.filter(F.col("failure").isin("missed_entity", "partial_span", "oversized_span") & F.col("transformation").isin(*normalising))
    return kinds.unionByName(unsupported).unionByName(missed.select("doc_id", F.lit("normalization_failure").alias("failure"))).distinct()


def with_expected_keys(metrics: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Zero rows for keys that no sample has."""
    return metrics.join(F.broadcast(keys), key, "right").fillna(0, ["tp", "fp", "tn", "fn"])


def gates(report: DataFrame, thresholds: dict[str, tuple[str, float]]) -> DataFrame:
    """report's row with the names of the failed gates; a missing metric fails its gate."""
    failed = [F.when(F.coalesce(~(F.col(m) >= v if op == ">=" else F.col(m) <= v), F.lit(True)), F.lit(m)) for m, (op, v) in thresholds.items()]
    return report.withColumn("failures", F.array_compact(F.array(*failed))).withColumn("passed", F.size("failures") == 0)


def regressions(report: DataFrame, baseline: DataFrame, allowed: dict[str, float]) -> DataFrame:
    """report's row with the metrics that are worse than the baseline's by more than is allowed: by a fall where that is
    positive, by a rise where it is negative. Metrics that the baseline lacks can't regress; lost ones do."""
    j = report.crossJoin(baseline.select(*[F.col(m).alias(f"__{m}") for m in allowed]))  # one row each
    worse = {m: F.col(m) < F.col(f"__{m}") - by if by >= 0 else F.col(m) > F.col(f"__{m}") - by for m, by in allowed.items()}
    failed = [F.when(F.col(f"__{m}").isNotNull() & F.coalesce(w, F.lit(True)), F.lit(m)) for m, w in worse.items()]
    return j.select(*report.columns, F.array_compact(F.array(*failed)).alias("regressed"))


def comparison(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.select(key, F.col("f1").alias("f1_old")).join(new.select(key, F.col("f1").alias("f1_new")), key, "full").withColumn("delta", F.col("f1_new") - F.col("f1_old"))


def error_ranking(per_label: DataFrame, which: str) -> DataFrame:
    return per_label.filter(F.col(which) > 0).select("label", F.col(which).alias("n")).orderBy(F.desc("n"), "label")


def boundary_only(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """Documents with failures, and whether all of them are a matter of boundaries."""
    f = failures(expected, predicted)
    return f.groupBy("doc_id").agg(F.min(F.col("failure").isin("partial_span", "oversized_span", "overlapping_prediction_conflict")).alias("boundary_only"), F.count("*").alias("n_failures"))


#: Rows of a group per row that a rank can be off in a sketch; groups up to this size are ranked whole.
SKETCH = 10_000


def order_statistics(rows: DataFrame, by: str, value: str, ranks: dict[str, Column]) -> DataFrame:
    """(by, n, least, most, name...): exact values at 0-based ranks of each group, given by name as expressions over n.

    A sketch brackets each rank; one pass counts what lies below a bracket and the distinct values in it, combined
    before the shuffle, and the window that finds the rank sees the bracket alone: a few of SKETCH parts of a group, however
    large that is. A bracket without its rank fails the job. Nulls don't count; groups of nulls alone aren't there.
    """
    own = rows.filter(F.col(value).isNotNull()).select(by, F.col(value).alias("__v"))
    parts = [F.lit(i / 1000) for i in range(1001)]
    size = own.groupBy(by).agg(F.count("*").alias("n"), F.min("__v").alias("least"), F.max("__v").alias("most"), F.percentile_approx("__v", F.array(*parts), F.lit(SKETCH)).alias("__q"))
    # thousandths on both sides are further off than the sketch is wrong
    at = {k: F.floor(r / F.col("n") * 1000) for k, r in ranks.items()}
    whole = F.col("n") <= SKETCH

    def target(k: str, r: Column) -> Column:
        lo = F.when(whole | (at[k] < 1), F.col("least")).otherwise(F.get("__q", (at[k] - 1).cast("int")))
        hi = F.when(whole | (at[k] > 998), F.col("most")).otherwise(F.get("__q", (at[k] + 2).cast("int")))
        return F.struct(F.lit(k).alias("name"), lo.alias("lo"), hi.alias("hi"), r.cast("long").alias("rank"))

    size = size.select(by, "n", "least", "most", F.array(*[target(k, r) for k, r in ranks.items()]).alias("__t"))
    asked = own.join(size.select(F.col(by).alias("__by"), "__t"), F.col(by).eqNullSafe(F.col("__by"))).select(by, "__v", F.explode(F.filter("__t", lambda t: F.col("__v") <= t["hi"])).alias("t"))
    cells = asked.groupBy(by, "t.name", "t.rank", F.when(F.col("__v") >= F.col("t.lo"), F.col("__v")).alias("__v")).agg(F.count("*").alias("__c"))
    w = Window.partitionBy(by, "name").orderBy(F.asc_nulls_first("__v"))
    upto = cells.withColumn("__u", F.sum("__c").over(w)).filter(F.col("__u") > F.col("rank"))
    found = upto.groupBy(by).agg(*[F.min(F.when(F.col("name") == k, F.struct("__u", "__v"))).alias(k) for k in ranks])
    sure = lambda k: F.when(F.col(f"{k}.__v").isNull(), F.raise_error(F.lit("a sketch missed a rank"))).otherwise(F.col(f"{k}.__v")).alias(k)
    found = found.select(F.col(by).alias("__by"), *[sure(k) for k in ranks])
    return size.join(found, F.col(by).eqNullSafe(F.col("__by"))).select(by, "n", "least", "most", *ranks)


def latency_summary(samples: DataFrame, by: str, value: str) -> DataFrame:
    """Median, floor-index 95th percentile, minimum and maximum by group, exact for groups of any size. Nulls don't count."""
    last = F.col("n") - 1
    own = order_statistics(samples, by, value, {"__a": F.floor(last / 2), "__b": F.ceil(last / 2), "p95": F.floor(last * 0.95)})
    middle = (F.col("__a") + F.col("__b")) / 2
    return own.select(by, middle.alias("median"), "p95", "least", "most")


def ratcliff(pairs: DataFrame, a: str, b: str, out: str = "ratio", least: float | None = None) -> DataFrame:
    """Similarity of two texts by longest matching blocks, in Arrow batches: difflib's ratio without junk (functions.blocks).
    With least, only pairs that reach it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf[out] = [blocks.ratio(x, y, least or 0.0) for x, y in zip(pdf[a], pdf[b], strict=True)]
            yield pdf if least is None else pdf[pdf[out] >= least]

    ddl = pairs.schema.simpleString()[len("struct<") : -1]
    return pairs.mapInPandas(run, f"{ddl},{out}:double")
