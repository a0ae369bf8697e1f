"""Evaluation of the engine on a labelled corpus: every text is read once, then six stages of findings are scored together."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import core
from ..plans import taxonomy
from ..plans.policies import BUILT_IN, Policy
from .evaluate import ratio

# The stages that are scored, and the dispatches that a fixture can want.
STAGES = ("deterministic", "label_aware", "contextual", "merged", "residual_scan", "indirect_disclosure_scan")
DISPATCHES = ("permit", "review", "block")
SEEN = "struct<found:array<struct<stage:string,text:string,type:string>>,said:array<struct<category:string,negated:boolean,linked:boolean>>,blocked:boolean,needs_review:boolean,sanitized:string,safe:boolean,critical:int>"
_ITEM = "struct<stage:string,text:string,type:string,e:long,a:long,partial:long>"
#: Types that rules alone must find, as missing one is critical.
CRITICAL_RULES = [r[0] for r in taxonomy.ROWS if r[5] and r[4] == "critical" and not r[6]]


def _read(text: str | None, policy: Policy) -> tuple:
    """SEEN of one text. Texts that break the engine have no findings and aren't safe."""
    try:
        told = core.audit(text or "", policy)
        own = told["analysis"]
        found = own["found"]
        by_stage = [
            ("deterministic", [s for s in found if s["source"] in ("regex", "label")]), ("label_aware", [s for s in found if s["source"] == "label"]), ("contextual", [s for s in found if s["source"] == "contextual"]),
            ("merged", own["entities"]), ("residual_scan", told["findings"]),
        ]
        rows = [(stage, s["text"], s["entity_type"]) for stage, spans in by_stage for s in spans]
        if told["indirect"]:
            rows += [("indirect_disclosure_scan", a["id"], a["category"]) for a in own["assertions"]]
        # nobody named stands for the record's own subject
        said = [(a["category"], a["negated"], a["subjects"] != ["record-subject"]) for a in own["assertions"]]
        return rows, said, own["blocked"], own["requires_review"], told["sanitized"], told["safe"], told["critical"]
    except Exception:
        return [], [], True, False, None, False, 1


def observed(fixtures: DataFrame, policy: Policy | str = "gdpr_strict") -> DataFrame:
    """fixtures (as read_fixtures gives them) with seen: what the engine finds, says and leaves over of each input. One
    narrow stage reads every text once; all that follows are expressions and aggregates over its rows."""
    rule = BUILT_IN[policy] if isinstance(policy, str) else policy

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = ["found", "said", "blocked", "needs_review", "sanitized", "safe", "critical"]
        for batch in batches:
            yield pd.DataFrame([_read(t, rule) for t in batch], columns=names)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    # as nondeterministic no filter on what was seen is pushed below it, which would read every text again
    return fixtures.withColumn("seen", F.pandas_udf(run, SEEN).asNondeterministic()(F.col("input")))


def _none(c: str, kind: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast(kind))


def _expected() -> Column:
    return _none("expected_entities", "array<struct<text:string,type:string>>")


def _forbidden() -> Column:
    return _none("sanitized_must_not_contain", "array<string>")


def _left_over() -> Column:
    """The forbidden strings that the safe text still holds."""
    return F.filter(_forbidden(), lambda x: F.coalesce(F.contains(F.col("seen.sanitized"), x), F.lit(False)))


def stage_metrics(seen: DataFrame) -> DataFrame:
    """(stage, entity_type, tp, fp, fn, precision, recall, f1, exact_span_accuracy, partial_span_failures): multisets of (text,
    type) over the corpus. Every row is tagged with its stage and fanned out once: expectations to all six stages, findings
    to theirs, and to the merged stage what should have been replaced and wasn't. Empty denominators count as 1."""
    item = lambda stage, x, e, a, p: F.struct(stage.alias("stage"), x["text"].alias("text"), x["type"].alias("type"), F.lit(e).cast("long").alias("e"), F.lit(a).cast("long").alias("a"), p.cast("long").alias("partial"))
    zero = F.lit(0)
    wanted = F.flatten(F.transform(F.array(*map(F.lit, STAGES)), lambda s: F.transform(_expected(), lambda x: item(s, x, 1, 0, zero))))
    found = F.transform("seen.found", lambda x: item(x["stage"], x, 0, 1, zero))
    # one for each time that a forbidden string which is left stands for the expected text
    kept = F.transform(_expected(), lambda x: item(F.lit("merged"), x, 0, 0, F.size(F.filter(_left_over(), lambda f: f == x["text"]))))
    rows = seen.select(F.explode(F.concat(*[c.cast(f"array<{_ITEM}>") for c in (wanted, found, kept)])).alias("x")).select("x.*")
    each = rows.groupBy("stage", "type", "text").agg(F.sum("e").alias("e"), F.sum("a").alias("a"), F.sum("partial").alias("partial"))
    hit = F.least("e", "a")
    out = each.groupBy("stage", F.col("type").alias("entity_type")).agg(F.sum(hit).alias("tp"), F.sum(F.col("a") - hit).alias("fp"), F.sum(F.col("e") - hit).alias("fn"), F.sum("partial").alias("partial_span_failures"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p, r = (F.coalesce(ratio(tp, tp + x), F.lit(1.0)) for x in (fp, fn))
    out = out.withColumn("precision", p).withColumn("recall", r)
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return out.select("stage", "entity_type", "tp", "fp", "fn", "precision", "recall", f1.alias("f1"), F.col("recall").alias("exact_span_accuracy"), "partial_span_failures")


def _merged() -> Column:
    return F.filter("seen.found", lambda f: f["stage"] == "merged")


def misclassified(seen: DataFrame) -> DataFrame:
    """(expected, actual, n): types found on the texts of expected entities that weren't found as such."""
    merged = _merged()
    missed = F.filter(_expected(), lambda x: ~F.exists(merged, lambda f: (f["text"] == x["text"]) & (f["type"] == x["type"])))
    pairs = F.flatten(F.transform(missed, lambda x: F.transform(F.array_distinct(F.transform(F.filter(merged, lambda f: f["text"] == x["text"]), lambda f: f["type"])), lambda t: F.struct(x["type"].alias("expected"), t.alias("actual")))))
    return seen.select(F.explode(pairs).alias("p")).groupBy("p.expected", "p.actual").agg(F.count("*").alias("n"))


def failed(seen: DataFrame, policy: Policy | str = "gdpr_strict") -> DataFrame:
    """(id, reasons) of the fixtures that aren't met, every reason that there is: all told from the row itself. A dispatch that
    is none of the three fails the job, as it can't be judged."""
    rule = BUILT_IN[policy] if isinstance(policy, str) else policy
    actions = F.create_map(*[F.lit(x) for t in taxonomy.TYPES for x in (t, rule.action_for(t))])
    merged, said = _merged(), F.col("seen.said")
    claims = _none("expected_assertions", "array<struct<category:string,negated:boolean>>")
    blocked, review = F.col("seen.blocked"), F.col("seen.needs_review")
    off = {
        "missed_entity": F.exists(_expected(), lambda x: ~F.exists(merged, lambda f: (f["text"] == x["text"]) & (f["type"] == x["type"]))),
        "policy_action": F.exists(F.map_entries(F.coalesce("expected_policy_actions", F.create_map().cast("map<string,string>"))), lambda e: ~F.coalesce(F.try_element_at(actions, e["key"]) == e["value"], F.lit(False))),
        "dispatch": F.when(F.col("provider_dispatch") == "block", ~blocked).when(F.col("provider_dispatch") == "review", blocked | ~review).when(F.col("provider_dispatch") == "permit", blocked | review)
        .otherwise(F.raise_error(F.concat(F.lit("no such dispatch: "), F.coalesce("provider_dispatch", F.lit("none")), F.lit(" in "), F.col("id")))),
        "assertion": F.exists(claims, lambda x: ~F.exists(said, lambda a: a["category"] == x["category"])),
        "general_discussion": (F.size(claims) == 0) & (F.size(_expected()) == 0) & (F.size(said) > 0),
        "residual": ~F.col("seen.safe").eqNullSafe(F.col("expected_residual_safe")),
        "forbidden_text": F.size(_left_over()) > 0,
    }
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in off.items()]))
    return seen.select("id", reasons.alias("reasons")).filter(F.size("reasons") > 0)


def summary(seen: DataFrame) -> DataFrame:
    """One row: fixtures, assertion scores, recall of critical types by rules, replaced share of forbidden strings, leaks."""
    claims = _none("expected_assertions", "array<struct<category:string,negated:boolean>>")
    said, first = F.col("seen.said"), lambda x: F.get(F.filter("seen.said", lambda a: a["category"] == x["category"]), 0)
    count = lambda items, test: F.size(F.filter(items, test))
    quiet = (F.size(claims) == 0) & (F.size(_expected()) == 0)
    own = seen.select(
        F.size(claims).alias("claims"), count(claims, lambda x: first(x).isNotNull()).alias("met"), count(claims, lambda x: first(x)["linked"]).alias("linked"), count(claims, lambda x: first(x)["negated"] == x["negated"]).alias("right"),
        quiet.cast("int").alias("quiet"), (quiet & (F.size(said) > 0)).cast("int").alias("loud"), F.size(_forbidden()).alias("forbidden"), F.size(_left_over()).alias("left"), F.when(~F.col("seen.safe"), F.greatest(F.lit(1), "seen.critical")).otherwise(0).alias("unsafe"),
    )
    one = own.agg(F.count("*").alias("n_fixtures"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in own.columns])
    kind = "array<struct<what:string,a:string,b:string,e:long,n:long>>"
    tag = lambda what, a, b, e, n: F.struct(F.lit(what).alias("what"), a.alias("a"), b.alias("b"), F.lit(e).cast("long").alias("e"), F.lit(n).cast("long").alias("n"))
    critical = lambda items, e, n: F.transform(F.filter(items, lambda x: x["type"].isin(*CRITICAL_RULES)), lambda x: tag("critical", x["text"], x["type"], e, n))
    assertion = lambda items, e, n: F.transform(items, lambda x: tag("assertion", x["category"], x["negated"].cast("string"), e, n))
    ruled = F.filter("seen.found", lambda f: f["stage"] == "deterministic")
    rows = seen.select(F.explode(F.concat(*[c.cast(kind) for c in (critical(_expected(), 1, 0), critical(ruled, 0, 1), assertion(claims, 1, 0), assertion(said, 0, 1))])).alias("x")).select("x.*")
    each = rows.groupBy("what", "a", "b").agg(F.sum("e").alias("e"), F.sum("n").alias("n"))
    hit = lambda what: F.coalesce(F.sum(F.when(F.col("what") == what, F.least("e", "n"))), F.lit(0))
    size = lambda what, c: F.coalesce(F.sum(F.when(F.col("what") == what, F.col(c))), F.lit(0))
    two = each.agg(hit("assertion").alias("tp"), (size("assertion", "n") - hit("assertion")).alias("fp"), (size("assertion", "e") - hit("assertion")).alias("fn"), hit("critical").alias("c"), size("critical", "e").alias("ce"))
    or_one = lambda x, y, other=1.0: F.coalesce(ratio(x, y), F.lit(other))
    c = F.col
    return one.crossJoin(two).select(  # one row each
        "n_fixtures", "tp", "fp", "fn", or_one(c("tp"), c("tp") + c("fp")).alias("assertion_precision"), or_one(c("tp"), c("tp") + c("fn")).alias("assertion_recall"), or_one(c("linked"), c("met")).alias("subject_linking_accuracy"),
        or_one(c("right"), c("claims")).alias("negation_accuracy"), or_one(c("loud"), c("quiet"), 0.0).alias("general_discussion_false_positive_rate"), or_one(c("c"), c("ce")).alias("critical_span_recall"),
        or_one(c("forbidden") - c("left"), c("forbidden")).alias("full_span_replacement_rate"), (c("left") + c("unsafe")).alias("residual_leaks"),
    )


def counts(seen: DataFrame) -> DataFrame:
    """(axis, value, n): fixtures by language and expected entities by type."""
    pair = lambda axis, v: F.struct(F.lit(axis).alias("axis"), v.alias("value"))
    both = F.concat(F.array(pair("language", F.col("language"))), F.transform(_expected(), lambda x: pair("category", x["type"])))
    return seen.select(F.explode(both).alias("x")).groupBy("x.axis", "x.value").agg(F.count("*").alias("n"))


def evaluate_corpus(fixtures: DataFrame, policy: Policy | str = "gdpr_strict") -> dict[str, DataFrame]:
    """The whole report as tables. Texts are read once a table unless the caller writes observed() first, as it should for
    large corpora."""
    seen = observed(fixtures, policy)
    return {"stages": stage_metrics(seen), "confusion": misclassified(seen), "failed": failed(seen, policy), "summary": summary(seen), "counts": counts(seen)}
