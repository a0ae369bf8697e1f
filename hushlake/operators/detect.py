"""Deterministic detection: spans of all rules as one array column, on the raw text and on its normalised view."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scan import scan_all
from ..functions.spans import SPANS, as_spans, matches, no_spans, tail
from ..functions.validators import VALIDATORS, identifier_valid, internal_host, trim_iban
from ..plans import rules as R
from ..plans.taxonomy import lookup


_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string()), ("entity_type", pa.string()), ("confidence", pa.float64()), ("source", pa.string()), ("rule", pa.string()), ("precedence", pa.int32())]))


def _guarded(text: Column, guard: str, spans: Column) -> Column:
    return F.when(text.rlike(guard), spans).otherwise(no_spans())


def _resized(m: Column, text: Column, from_start: int | Column = 0) -> Column:
    start = (m["start"] + from_start).cast("int")
    return F.struct(start.alias("start"), (start + F.length(text)).cast("int").alias("end"), text.alias("text"))


def rule_spans(text: Column, rule: R.Rule) -> Column:
    found = matches(text, rule.pattern)
    if rule.fix == "iban":
        found = F.transform(found, lambda m: _resized(m, trim_iban(m["text"])))
    elif rule.fix == "quote":
        found = F.transform(found, lambda m: F.when(m["text"].startswith("'"), _resized(m, F.substring(m["text"], 2, 1 << 30), 1)).otherwise(m))
    if rule.validator:
        found = F.filter(found, lambda m: VALIDATORS[rule.validator](m["text"]))
    return _guarded(text, rule.guard, as_spans(found, rule.entity_type, rule.confidence, "regex", rule.name, rule.precedence))


def label_spans(text: Column, label: R.Label) -> Column:
    def value(m: Column) -> Column:
        raw = F.regexp_extract(m["text"], label.pattern, 1)
        own = tail(m, raw)
        kept = F.rtrim(raw)
        return F.struct(own["start"].alias("start"), (own["start"] + F.length(kept)).cast("int").alias("end"), kept.alias("text"))

    found = F.filter(F.transform(matches(text, label.pattern), value), lambda m: m["text"] != "")
    if label.validator:
        found = F.filter(found, lambda m: VALIDATORS[label.validator](m["text"]))
    return as_spans(found, label.entity_type, label.confidence, "label", label.name, 100)


def all_label_spans(text: Column) -> Column:
    """All labelled fields, behind one scan for any label; of rules that take the same value the one with the longest
    label wins, as that is the more specific one."""
    longest = {r.name: max(map(len, r.labels)) for r in R.LABELS}
    spans = F.concat(*[label_spans(text, r) for r in R.LABELS])
    best = F.filter(spans, lambda s: ~F.exists(spans, lambda o: (o["start"] == s["start"]) & (o["end"] == s["end"]) & (lookup(longest, o["rule"], 0) > lookup(longest, s["rule"], 0))))
    return F.when(text.rlike(R.ANY_LABEL), best).otherwise(no_spans())


def prefix_spans(text: Column, prefixes: dict[str, str] | None = None) -> Column:
    """References by their prefix, such as CUST-1234."""
    table = prefixes or R.PREFIXES
    names = "|".join(sorted(table, key=len, reverse=True))
    pattern = rf"(?i)(?<![A-Z0-9])(?:{names})(?:-[A-Z]{{2,8}})?[-_][A-Z0-9][A-Z0-9_-]{{2,}}(?![A-Z0-9])"
    found = F.filter(matches(text, pattern), lambda m: identifier_valid(m["text"]))
    kind = lambda m: lookup(table, F.upper(F.regexp_extract(m["text"], f"(?i)^({names})", 1)))
    spans = F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("text"), kind(m).alias("entity_type"), F.lit(1.0).alias("confidence"), F.lit("regex").alias("source"), F.lit("configured_prefix").alias("rule"), F.lit(95).alias("precedence"))).cast(SPANS)
    return _guarded(text, "[-_][A-Za-z0-9]", spans)


def creditor_spans(text: Column) -> Column:
    return _guarded(text, "(?i)RF[0-9]", as_spans(matches(text, R.CREDITOR), "payment_reference", 1.0, "regex", "rf_reference", 95))


def secret_spans(text: Column) -> Column:
    found = matches(text, R.SECRET)
    spans = F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("text"), F.when(F.lower(m["text"]).startswith("sess"), "session_token").otherwise("api_token").alias("entity_type"), F.lit(1.0).alias("confidence"), F.lit("regex").alias("source"), F.lit("secret_prefix").alias("rule"), F.lit(100).alias("precedence"))).cast(SPANS)
    return _guarded(text, "(?i)sk-|ghp_|xox|sess", spans)


def url_kind(url: Column) -> Column:
    """internal_url, sensitive_url_parameter or url."""
    full = F.when(F.lower(url).startswith("www."), F.concat(F.lit("http://"), url)).otherwise(url)
    authority = F.regexp_extract(full, "(?i)^https?://([^/?#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), ":[0-9]*$", "")
    path = F.lower(F.regexp_extract(full, "(?i)^https?://[^/?#]*([^?#]*)", 1))
    query = F.regexp_extract(full, r"^[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda p: F.lower(F.substring_index(p, "=", 1)))
    internal = internal_host(host) | reduce(lambda a, b: a | b, [path.contains(p) for p in R.INTERNAL_PATHS])
    sensitive = F.arrays_overlap(keys, F.array(*map(F.lit, R.QUERY_KEYS))) | authority.contains("@")
    return F.when(internal, "internal_url").when(sensitive, "sensitive_url_parameter").otherwise("url")


def url_spans(text: Column) -> Column:
    found = F.transform(matches(text, R.URL), lambda m: _resized(m, F.regexp_replace(m["text"], "[.,;:!?]+$", "")))
    spans = F.transform(
        F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("text"), url_kind(m["text"]).alias("kind"))),
        lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("text"), m["kind"].alias("entity_type"), F.when(m["kind"] == "url", 0.95).otherwise(1.0).alias("confidence"), F.lit("regex").alias("source"), m["kind"].alias("rule"), F.when(m["kind"] == "url", 60).otherwise(95).alias("precedence")),
    ).cast(SPANS)
    return _guarded(text, r"(?i)://|www\.", spans)


def _last_group(text: Column, pattern: str) -> Column:
    return F.transform(matches(text, pattern), lambda m: tail(m, F.regexp_extract(m["text"], pattern, 1)))


def credential_spans(text: Column) -> Column:
    """Own rules: bearer headers, vendor keys, assigned secrets."""
    parts = []
    for r in R.CREDENTIALS:
        found = _last_group(text, r.pattern)
        parts.append(_guarded(text, r.guard, as_spans(found, r.entity_type, 1.0, "credentials", r.name, r.precedence)))
    return F.concat(*parts)


def _scan_array(text: pa.Array) -> pa.Array:
    return pa.array(scan_all(text.to_pylist()), _ARROW)


_scan_array.__annotations__ = {"text": pa.Array, "return": pa.Array}


def detect(df: DataFrame, text: str = "text", out: str = "candidates") -> DataFrame:
    """df and an array of candidate spans of all rules in the offsets of the text, one Arrow-batched pass over each text.
    Null texts have no spans."""
    return df.withColumn(out, F.arrow_udf(_scan_array, SPANS)(F.col(text)))


def rule_findings(df: DataFrame, rule: R.Rule, *keep: str) -> DataFrame:
    """One rule's spans as rows, with built-in functions only; the guard filters texts before the pattern runs."""
    hit = df.filter(F.col("text").rlike(rule.guard))
    return findings(hit.withColumn("candidates", rule_spans(F.col("text"), rule)), "candidates", *keep)


def findings(df: DataFrame, column: str = "candidates", *keep: str) -> DataFrame:
    """One row a span. An inner explode would bring a filter on the array's size, which is pushed below the expressions (or
    the Arrow stage) that make the array, and so has every text searched twice."""
    return df.select(*keep, F.explode_outer(column).alias("s")).filter(F.col("s").isNotNull()).select(*keep, "s.*")
