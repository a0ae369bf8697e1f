"""Filter interaction audit: each document's failures as a five-bit mask, 32 cells a part, all 120 orders told from the cells."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILTERS = "ABCDE"
SPACES = r"[\x20\x09-\x0D]+"


def text_mask(text: Column) -> Column:
    """Bits 0 to 3: whether A (under 100 words), B (under 80 % distinct words), C (over 10 % capitals A-Z), D (a character
    of #$%&*|) fail. Needs no more than the text; all of it is native."""
    parts = F.split(text, SPACES)  # empty strings at the ends only
    words = F.size(parts) - F.when(F.element_at(parts, 1) == "", 1).otherwise(0) - F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    distinct = F.size(F.array_distinct(parts)) - F.when(F.array_contains(parts, ""), 1).otherwise(0)
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = [words < 100, 100 * distinct < 80 * words, 100 * capitals > 10 * F.length(text), F.rlike(text, F.lit("[#$%&*|]"))]
    return sum((F.when(x, 1 << i).otherwise(0) for i, x in enumerate(fails)), F.lit(0))


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask) per row of docs. Bit 4 (E): the text is that of a smaller doc_id. Texts meet in one groupBy with
    partial aggregation, which leaves the smallest doc_id of each; only its (doc_id, hash) goes back to the rows, so that a
    text with very many copies is one row behind the shuffle. The hash need only tell texts of one doc_id apart."""
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("part"))
    h = F.xxhash64("text").alias("h")
    first = docs.filter("doc_id IS NOT NULL").groupBy("text").agg(F.min("doc_id").alias("k")).select("k", h, F.lit(True).alias("known"), F.lit(True).alias("first"))
    # rows without doc_id spread by their hash and meet nothing
    rows = docs.select("doc_id", "part", h, text_mask(F.col("text")).alias("mask"), F.col("doc_id").isNotNull().alias("known")).withColumn("k", F.coalesce("doc_id", "h"))
    copy = F.when(F.col("first").isNull() & F.col("known"), 1 << 4).otherwise(0)
    return rows.join(first, ["k", "h", "known"], "left").select("doc_id", "k", "known", "part", (F.col("mask") + copy).alias("mask"))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part and mask, those labelled quality = 1 and toxic = 1 among them. Of
    several labels of a doc_id, one that says 1 counts."""
    own = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("k")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    marked = failures(docs).join(own.withColumn("known", F.lit(True)), ["k", "known"], "left")
    return marked.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if(F.col("good")).alias("good"), F.count_if(F.col("toxic")).alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: one row per part,
    order of the five filters and step, zeros included.

    Null texts count as empty: under 100 words, none of B, C, D. Null lang is the part ''. A row without doc_id is told as a
    copy of nothing and has no label; rows repeated outright are documents each, neither a copy of the other. Columns other
    than doc_id, text, lang (of labels: doc_id, quality, toxic) are not read. An empty table gives no rows.
    A part's 32 cells are all that the orders need: what a filter removes at a step are the cells that fail it and nothing
    before it, and over all orders it comes first among m failing filters in 120 / m of them.
    """
    each = cells(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # at most 32
    orders = F.lit(",".join("".join(p) for p in permutations(FILTERS)))
    rows = each.withColumn("filter_order", F.explode(F.split(orders, ","))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    letter, before = F.substring("filter_order", F.col("step"), F.lit(1)), F.substring("filter_order", F.lit(1), F.col("step") - 1)
    bits = lambda some: sum((F.when(F.contains(some, F.lit(x)), 1 << i).otherwise(0) for i, x in enumerate(FILTERS)), F.lit(0))
    rows = rows.select("part", "filter_order", "step", "cells", bits(letter).alias("own"), bits(before).alias("past"))
    own, past = F.col("own"), F.col("past")

    def total(what: str, when) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda acc, c: acc + F.when(when(c["mask"]), c[what]).otherwise(0))

    fails = lambda m: m.bitwiseAND(own) != 0
    open_ = lambda m: m.bitwiseAND(past) == 0
    share = F.aggregate("cells", F.lit(0).cast("long"), lambda acc, c: acc + F.when(fails(c["mask"]), c["n"] * 120 / F.bit_count(c["mask"])).otherwise(0).cast("long"))
    return rows.select(
        "part", "filter_order", "step",
        total("n", lambda m: open_(m) & ~fails(m)).alias("kept"), total("n", lambda m: open_(m) & fails(m)).alias("removed"),
        total("n", lambda m: ~open_(m) & fails(m)).alias("redundant"), total("n", lambda m: m == own).alias("unique_fails"),
        total("good", lambda m: open_(m) & fails(m)).alias("good_lost"), total("toxic", lambda m: open_(m) & fails(m)).alias("toxic_lost"), share.alias("shapley"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


_LETTERS = "(VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS {}(l, b)"
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
w AS (SELECT doc_id, t, part, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS lo FROM d),
f AS (SELECT doc_id, part, [len(ws) < 100, 100 * len(list_distinct(ws)) < 80 * len(ws),
  100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > lo, false)] AS f FROM w),
lab AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, f[1]::INT + 2 * f[2]::INT + 4 * f[3]::INT + 8 * f[4]::INT + 16 * f[5]::INT AS mask,
  coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM f LEFT JOIN lab USING (doc_id)),
o AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bs FROM {_LETTERS.format("a")}, {_LETTERS.format("b")}, {_LETTERS.format("c")},
  {_LETTERS.format("d")}, {_LETTERS.format("e")} WHERE a.b + b.b + c.b + d.b + e.b = 31 AND (a.b | b.b | c.b | d.b | e.b) = 31),
s AS (SELECT filter_order, step::INT AS step, bs[step] AS own, coalesce(list_sum(bs[1:step - 1]), 0)::INT AS past FROM (SELECT *, unnest(range(1, 6)) AS step FROM o)),
g AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM m GROUP BY 1, 2),
r AS (SELECT part, filter_order, step, own, sum(n) FILTER (WHERE mask & (past | own) = 0) AS kept, sum(n) FILTER (WHERE mask & past = 0 AND mask & own > 0) AS removed,
  sum(n) FILTER (WHERE mask & past > 0 AND mask & own > 0) AS redundant, sum(n) FILTER (WHERE mask = own) AS unique_fails,
  sum(good) FILTER (WHERE mask & past = 0 AND mask & own > 0) AS good_lost, sum(toxic) FILTER (WHERE mask & past = 0 AND mask & own > 0) AS toxic_lost
  FROM g, s GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  (sum(coalesce(removed, 0)) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r
"""
