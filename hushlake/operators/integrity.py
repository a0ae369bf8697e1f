"""Corpus checks: duplicates, near duplicates, leakage between splits, annotation faults."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normalise import integrity_text
from .evaluate import ratcliff
from .intervals import overlapping


def duplicate_groups(df: DataFrame, by: str, key: str = "doc_id") -> DataFrame:
    """Groups of rows equal in by, with size and smallest key. Sizes only: a group's members can be many."""
    return df.groupBy(by).agg(F.count("*").alias("n"), F.min(key).alias("first")).filter("n > 1")


def duplicates(df: DataFrame, normalised: bool = False, key: str = "doc_id") -> DataFrame:
    text = integrity_text(F.col("text")) if normalised else F.col("text")
    return duplicate_groups(df.select(key, F.sha2(text, 256).alias("h")), "h", key)


def simhash(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, simhash): for each of 64 bits the sign of a sum over 3-word shingles of the first 8 bytes of SHA-256. One
    narrow Arrow stage: as 64 aggregates the plan took minutes to compile, and shingles would have been shuffled."""

    def bits(t: str | None) -> int:
        words = re.findall(r"\w+", unicodedata.normalize("NFKC", t or "").casefold())
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
        raw = b"".join(hashlib.sha256(s.encode("utf-8", "replace")).digest()[:8] for s in shingles)
        ones = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        return int(np.packbits(2 * ones >= len(shingles)).view(">i8")[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bits(t) for t in b.column(1).to_pylist()], pa.int64())], names=[key, "simhash"])

    return df.select(key, text).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, simhash long")


def near_pairs(df: DataFrame, split: str, key: str = "doc_id", distance: int = 2, ratio: float | None = 0.85) -> DataFrame:
    """Pairs of different texts across splits with SimHashes at most distance bits apart. Two equal 16-bit bands of four
    are certain at distance 2, so buckets of two bands lead pairs together; equal texts stand for one another."""
    one = df.groupBy("text", split).agg(F.min(key).alias(key))
    h = simhash(one, key).join(one, key)
    band = lambda i: F.shiftrightunsigned("simhash", 16 * i).bitwiseAND(F.lit(0xFFFF))
    pairs_of = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    keys = F.array(*[F.concat_ws(":", F.lit(f"{i}{j}"), band(i).cast("string"), band(j).cast("string")) for i, j in pairs_of])
    rows = h.select(key, split, "simhash", F.explode(keys).alias("bucket"))
    a, b = rows.alias("a"), rows.alias("b")
    near = a.join(b, (F.col("a.bucket") == F.col("b.bucket")) & (F.col(f"a.{key}") < F.col(f"b.{key}")) & (F.col(f"a.{split}") != F.col(f"b.{split}")))
    near = near.filter(F.bit_count(F.col("a.simhash").bitwiseXOR(F.col("b.simhash"))) <= distance)
    ids = near.select(F.col(f"a.{key}").alias("left_id"), F.col(f"b.{key}").alias("right_id")).distinct()
    if ratio is None:
        return ids
    t = one.select(key, "text")
    full = ids.join(t.select(F.col(key).alias("left_id"), F.col("text").alias("left_text")), "left_id").join(t.select(F.col(key).alias("right_id"), F.col("text").alias("right_text")), "right_id")
    return ratcliff(full.filter("left_text <> right_text"), "left_text", "right_text", least=ratio).select("left_id", "right_id", "ratio")


def split_leakage(df: DataFrame, groups: list[str], split: str = "split") -> DataFrame:
    """Values of group keys that occur in several splits."""
    stacked = df.unpivot([split], groups, "group_key", "group_value")
    return stacked.filter("group_value IS NOT NULL").groupBy("group_key", "group_value").agg(F.count_distinct(split).alias("n_splits")).filter("n_splits > 1")


def annotation_faults(samples: DataFrame, default_action: DataFrame) -> DataFrame:
    """Annotations (doc_id, text, start, end, entity_type, expected_action, span_text) whose offsets or action are off."""
    j = samples.join(F.broadcast(default_action), "entity_type", "left")
    bad = F.when(F.expr("substring(text, start + 1, end - start)") != F.col("span_text"), "offset").when(F.col("end") <= F.col("start"), "empty").when(F.col("end") > F.length("text"), "outside").when(F.col("expected_action") != F.col("default_action"), "action")
    return j.withColumn("fault", bad).filter("fault IS NOT NULL").select("doc_id", "start", "end", "entity_type", "fault")


def partial_overlaps(spans: DataFrame, by: str = "doc_id") -> DataFrame:
    """Pairs of spans of a document that overlap without nesting."""
    own = spans.select(by, "start", "end")
    l, r = F.col("l"), F.col("r")
    pairs = overlapping(own, own, [by]).filter((l["start"] < r["start"]) & (r["start"] < l["end"]) & (l["end"] < r["end"]))
    return pairs.select(by, l["start"].alias("a_start"), l["end"].alias("a_end"), r["start"].alias("b_start"), r["end"].alias("b_end"))


def orphans(samples: DataFrame, key: str, parent: str) -> DataFrame:
    """Samples whose parent isn't in the corpus."""
    return samples.filter(F.col(parent).isNotNull()).join(samples.select(F.col(key).alias(parent)).distinct(), parent, "left_anti")


def integrity_checks(samples: DataFrame, annotations: DataFrame, counts: DataFrame, support: dict[str, str], actions: dict[str, str], n_mixed: int, allowed: list[str]) -> DataFrame:
    """(name, passed) of the twelve checks of an annotated corpus; a corpus without rows passes all that hold for each row.

    samples: doc_id, text, transformation, support, semantics_kept; annotations: doc_id, start, end, entity_type, action,
    span_text; counts: doc_id, tp_exact, tp_relaxed, support_exact, support_relaxed, n_duplicates; n_mixed is the number of
    documents with several types that the manifest states; allowed are the texts that negative samples are made of.
    """
    a = annotations.join(samples.select("doc_id", "text", "transformation", "support", "semantics_kept"), "doc_id")
    cut_ = F.expr("substring(text, start + 1, end - start)")
    per = annotations.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("entity_type").alias("kinds"))
    s = samples.join(per, "doc_id", "left").fillna(0, ["n", "kinds"])
    known = F.create_map(*[F.lit(x) for kv in support.items() for x in kv])
    right = F.create_map(*[F.lit(x) for kv in actions.items() for x in kv])
    clean, n0 = F.col("transformation") == "original", F.col("n") == 0
    flags = [n0, ~n0 & clean, ~n0 & ~clean & (F.col("support") == "supported"), ~n0 & (F.col("support") == "partial"), ~n0 & (F.col("support") == "deliberately_unsupported")]
    groups = sum((F.coalesce(f, F.lit(False)).cast("int") for f in flags), F.lit(0))
    from_allowed = F.lit(False)
    for t in allowed:
        from_allowed = from_allowed | F.col("text").contains(t)
    every = lambda c: F.coalesce(F.bool_and(F.coalesce(c, F.lit(False))), F.lit(True))
    one = a.agg(
        every(cut_ == F.col("span_text")).alias("every_expected_span_matches_source_substring"),
        every((F.col("start") >= 0) & (F.col("end") > F.col("start")) & (F.col("end") <= F.length("text"))).alias("unicode_codepoint_offsets_are_correct"),
        every(clean | (cut_ == F.col("span_text"))).alias("transformations_update_annotations"),
        every(F.array_contains(F.map_keys(right), F.col("entity_type"))).alias("expected_categories_match_detector_taxonomy"),
        every(F.try_element_at(right, F.col("entity_type")) == F.col("action")).alias("annotation_actions_match_taxonomy"),
    )
    two = s.agg(
        every(clean | F.col("semantics_kept")).alias("transformed_records_preserve_expected_semantics"),
        every(~n0 | from_allowed).alias("negative_records_have_no_accidental_generated_entity"),
        every(clean | (F.try_element_at(known, F.col("transformation")) == F.col("support"))).alias("unsupported_transformations_are_labeled_correctly"),
        every(groups == 1).alias("release_scoring_groups_are_mutually_exclusive"),
        (F.count(F.when(F.col("kinds") > 1, 1)) == n_mixed).alias("mixed_entity_documents_are_counted_once"),
    )
    sized = counts.join(s.select("doc_id", "n"), "doc_id")
    three = sized.agg(
        every((F.col("tp_relaxed") >= F.col("tp_exact")) & (F.col("support_exact") == F.col("n")) & (F.col("support_relaxed") == F.col("n"))).alias("exact_and_relaxed_span_math_is_correct"),
        every(F.col("n_duplicates") >= 0).alias("duplicate_predictions_do_not_inflate_false_positives"),
    )
    names = [c for t in (one, two, three) for c in t.columns]
    rows = [t.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("passed")) for c in t.columns])).alias("x")).select("x.*") for t in (one, two, three)]
    assert len(names) == 12
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def booleans(samples: DataFrame) -> DataFrame:
    """Corpus-wide predicates in one pass."""
    return samples.agg(
        (F.count("*") == F.count_distinct("doc_id")).alias("unique_ids"), F.bool_and(F.col("text").isNotNull()).alias("texts_present"), F.bool_and(F.length("text") > 0).alias("texts_nonempty"),
        F.bool_and(F.length("text") <= 100_000).alias("texts_bounded"), (F.count_distinct("lang") > 1).alias("several_languages"),
    )
