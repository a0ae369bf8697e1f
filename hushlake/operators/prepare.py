"""Requests to safe text: one narrow stage, no shuffle. The policy travels in the closure, as it is a small constant."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import contextual, core
from ..plans.policies import BUILT_IN, Policy

RESULT = "struct<status:string,outcome:string,safe_text:string,mapping:map<string,string>,counts:map<string,int>,reasons:array<string>,n_entities:int>"
FINDING = "start int, end int, entity_type string, source string, rule string, confidence double, decision string, reason string, severity string, masked_preview string, supporting_sources array<string>, conflicting_types array<string>, id string"
# What a reviewer can do.
REVIEW_OPTIONS = ("accept", "ignore", "change_type", "replace")


def prepared(text: Column, policy: Policy | str = "default") -> Column:
    rule = BUILT_IN[policy] if isinstance(policy, str) else policy

    def run(batch: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([core.prepare(t, rule) for t in batch], columns=["status", "outcome", "safe_text", "mapping", "counts", "reasons", "n_entities"])

    run.__annotations__ = {"batch": pd.Series, "return": pd.DataFrame}
    # a filter on the result would be pushed below it, and every text be read again for each such use
    return F.pandas_udf(run, RESULT).asNondeterministic()(text)


def prepare(df: DataFrame, policy: Policy | str = "default", text: str = "text") -> DataFrame:
    """df with status, outcome, safe_text, mapping, counts, reasons and n_entities. Null texts, texts over a million
    characters and documents that break a guard come back blocked, never as a failed job."""
    return df.withColumn("__p", prepared(F.col(text), policy)).select(*df.columns, "__p.*")


def analyse(df: DataFrame, policy: Policy | str = "default", key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a finding with its decision; no raw text but a masked preview."""
    rule = BUILT_IN[policy] if isinstance(policy, str) else policy

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, t in zip(pdf[key], pdf[text], strict=True):
                for e in core.analyse(t or "", rule)["entities"]:
                    v = e["text"].strip()
                    mask = "••••" if not v else "•" * len(v) if len(v) <= 4 else v[0] + "•" * min(10, len(v) - 2) + v[-1]
                    rows.append((k, *[mask if c.split()[0] == "masked_preview" else e[c.split()[0]] for c in FINDING.split(", ")]))
            yield pd.DataFrame(rows, columns=[key, *[c.split()[0] for c in FINDING.split(", ")]])

    kind = dict(df.dtypes)[key]
    return df.select(key, text).mapInPandas(run, f"{key} {kind}, {FINDING}")


def assertions(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a special-category assertion."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, a["id"], a["category"], a["start"], a["end"], a["subjects"], a["confidence"], a["negated"], a["risk"]) for k, t in zip(pdf[key], pdf[text], strict=True) for a in contextual.analyse(t or "")[1]]
            yield pd.DataFrame(rows, columns=[key, "id", "category", "start", "end", "subjects", "confidence", "negated", "risk"])

    return df.select(key, text).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, id string, category string, start int, end int, subjects array<string>, confidence double, negated boolean, risk string")


def counts(findings: DataFrame, key: str = "doc_id") -> DataFrame:
    return findings.groupBy(key, "entity_type").agg(F.count("*").alias("n"))


def action_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("entity_type", "decision").agg(F.count("*").alias("n"))


def reason_codes(findings: DataFrame, key: str = "doc_id") -> DataFrame:
    """Sorted reasons a document; the call for a person comes first."""
    reviewed = F.max(F.col("decision") == "review")
    codes = F.array_sort(F.collect_set("reason"))
    return findings.groupBy(key).agg(F.when(reviewed, F.concat(F.array(F.lit("human_review_required")), codes)).otherwise(codes).alias("reasons"))


def suggested_tokens(findings: DataFrame, key: str = "doc_id") -> DataFrame:
    """A token for each distinct value, numbered by type in order of first appearance."""
    from pyspark.sql import Window

    first = findings.groupBy(key, "entity_type", "text").agg(F.min("start").alias("first_start"))
    w = Window.partitionBy(key, "entity_type").orderBy("first_start", "text")
    return first.withColumn("token", F.concat(F.lit("["), F.upper("entity_type"), F.lit("_"), F.row_number().over(w).cast("string"), F.lit("]")))


def decided_by_policy(findings: DataFrame, rules: DataFrame, policy: str) -> DataFrame:
    """Findings with the policy's action and threshold: a join with the small rules table (its size is policies x 67)."""
    own = rules.filter(F.col("policy") == policy).drop("policy")
    return findings.join(F.broadcast(own), "entity_type").withColumn("kept", F.col("confidence") >= F.col("threshold"))


def apply_review(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """Review decisions by finding id: ignored ones go, types and replacements change, blocks block."""
    j = findings.join(decisions, "id", "left")
    kept = j.filter(~F.coalesce(F.col("review_action").isin("ignore", "allow_once"), F.lit(False)))
    kind = F.when(F.col("review_action") == "change_type", F.col("new_type")).otherwise(F.col("entity_type"))
    decision = F.when(F.col("review_action") == "block", "block").when(F.col("review_action").isNotNull(), "pseudonymize").otherwise(F.col("decision"))
    return kept.withColumn("entity_type", kind).withColumn("decision", decision)


def restore(df: DataFrame, text: str = "safe_text", mapping: str = "mapping", out: str = "restored") -> DataFrame:
    """Tokens back to values in one pass, with built-in functions: a replaced value is not searched for tokens again."""
    token = r"\[(?:REDACTED|[A-Z][A-Z0-9_]*_[0-9]+)\]"
    gaps, found = F.split(text, token, -1), F.regexp_extract_all(text, F.lit(token), F.lit(0))
    values = F.transform(found, lambda t: F.coalesce(F.try_element_at(F.col(mapping), t), t))
    return df.withColumn(out, F.array_join(F.flatten(F.transform(F.arrays_zip(gaps.alias("g"), values.alias("v")), lambda x: F.array(F.coalesce(x["g"], F.lit("")), F.coalesce(x["v"], F.lit(""))))), ""))


def is_faulty() -> Column:
    """Whether a prepared row breaks an invariant: safe text exactly for approved ones, none of them reviewed or blocked, no
    mapping of others."""
    ok = F.col("status") == "ok"
    return (ok != F.col("safe_text").isNotNull()) | (ok & ~F.col("outcome").isin("ALLOW", "REDACTED", "PSEUDONYMIZED")) | (~ok & (F.size("mapping") > 0))


def output_faults(prepared_df: DataFrame) -> DataFrame:
    """Rows that break the result's invariants: none, if all is well."""
    return prepared_df.filter(is_faulty())
