"""Spans of pattern matches as array columns: the primitive that all detectors build on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,text:string,entity_type:string,confidence:double,source:string,rule:string,precedence:int>"
SPANS = f"array<{SPAN}>"


def no_spans() -> Column:
    return F.array().cast(SPANS)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start,end,text>> of the non-overlapping matches, in code points, from 0, half open.

    regexp_extract_all and split consume the same matches, so the pieces between give the offsets. The pattern must not
    match the empty string. Null text gives an empty array.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    empty = F.array().cast("array<struct<start:int,end:int,text:string>>")

    def step(acc: Column, i: Column) -> Column:
        start = acc["pos"] + F.length(F.get(gaps, i))
        m = F.get(found, i)
        end = start + F.length(m)
        return F.struct(end.cast("int").alias("pos"), F.array_append(acc["out"], F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), m.alias("text"))).alias("out"))

    fold = F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), F.struct(F.lit(0).alias("pos"), empty.alias("out")), step, lambda acc: acc["out"])
    return F.when(text.isNotNull() & text.rlike(pattern), fold).otherwise(empty)


def tail(m: Column, text: Column) -> Column:
    """The span of a text that ends a match."""
    return F.struct((m["end"] - F.length(text)).cast("int").alias("start"), m["end"].alias("end"), text.alias("text"))


def as_spans(found: Column, entity_type: str | Column, confidence: float, source: str, rule: str, precedence: int) -> Column:
    kind = F.lit(entity_type) if isinstance(entity_type, str) else entity_type
    return F.transform(
        found,
        lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("text"), kind.alias("entity_type"), F.lit(float(confidence)).alias("confidence"), F.lit(source).alias("source"), F.lit(rule).alias("rule"), F.lit(precedence).alias("precedence")),
    ).cast(SPANS)


def span_id(s: Column) -> Column:
    """First 16 hex digits of a hash of place, type, source and text."""
    return F.substring(F.sha2(F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"), s["entity_type"], s["source"], s["text"]), 256), 1, 16)


def mask_preview(value: Column) -> Column:
    v = F.trim(value)
    n = F.length(v)
    dot = F.lit("•")
    return F.when(n == 0, F.repeat(dot, 4)).when(n <= 4, F.repeat(dot, n)).otherwise(F.concat(F.substring(v, 1, 1), F.repeat(dot, F.least(F.lit(10), n - 2)), F.right(v, F.lit(1))))


def overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])
