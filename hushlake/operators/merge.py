"""Conflicts between spans: a total order, a greedy choice in that order, and what each choice discarded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import SPANS, overlap
from ..plans.taxonomy import SOURCE_RANK, TYPE_PRIORITY, lookup


def rank(s: Column) -> Column:
    """Smaller is better; text never decides, so the order in which detectors ran doesn't matter."""
    scope = F.when(s["rule"].isin("full_sensitive_assertion", "full_sentence"), 0).when(s["entity_type"].isin("sensitive_url_parameter", "internal_url"), 1).otherwise(2)
    return F.struct(
        scope.alias("a"), lookup(SOURCE_RANK, s["source"], 9).alias("b"), (-F.greatest(s["precedence"], lookup(TYPE_PRIORITY, s["entity_type"], 0))).alias("c"), (s["start"] - s["end"]).alias("d"),
        (-s["confidence"]).alias("e"), s["start"].alias("f"), s["entity_type"].alias("g"), s["source"].alias("h"), F.coalesce(s["rule"], F.lit("")).alias("i"),
    )


def merged(candidates: Column) -> Column:
    """The spans taken greedily by rank, each unless it overlaps one taken before, in order of place."""
    ranked = F.array_sort(F.transform(candidates, lambda s: F.struct(rank(s).alias("r"), s.alias("s"))))
    taken = F.aggregate(ranked, F.array().cast(SPANS), lambda acc, x: F.when(F.exists(acc, lambda t: overlap(t, x["s"])), acc).otherwise(F.array_append(acc, x["s"])))
    return F.array_sort(taken)


def evidence(selected: Column, candidates: Column) -> Column:
    """The selected spans with the sources that agree and the types that were found across them."""
    return F.transform(
        selected,
        lambda w: F.struct(
            *[w[c].alias(c) for c in ("start", "end", "text", "entity_type", "confidence", "source", "rule", "precedence")],
            F.array_sort(F.array_distinct(F.transform(F.filter(candidates, lambda c: (c["start"] == w["start"]) & (c["end"] == w["end"]) & (c["entity_type"] == w["entity_type"])), lambda c: c["source"]))).alias("supporting_sources"),
            F.array_sort(F.array_distinct(F.transform(F.filter(candidates, lambda c: overlap(c, w) & (c["entity_type"] != w["entity_type"])), lambda c: c["entity_type"]))).alias("conflicting_types"),
        ),
    )


def merge(df: DataFrame, candidates: str = "candidates", out: str = "entities") -> DataFrame:
    return df.withColumn("__m", merged(F.col(candidates))).withColumn(out, evidence(F.col("__m"), F.col(candidates))).drop("__m")


def diagnostics(df: DataFrame, key: str, candidates: str = "candidates", entities: str = "entities") -> DataFrame:
    """Per candidate whether it was selected or lost to an overlap; no raw text."""
    same = lambda a, b: (a["start"] == b["start"]) & (a["end"] == b["end"]) & (a["entity_type"] == b["entity_type"]) & (a["source"] == b["source"])
    rows = df.select(key, F.explode(candidates).alias("c"), entities)
    won = F.exists(entities, lambda e: same(e, F.col("c")))
    return rows.select(key, "c.start", "c.end", "c.entity_type", F.col("c.source").alias("detector"), "c.confidence", "c.precedence", F.when(won, "selected").otherwise("discarded_overlap").alias("decision"))
