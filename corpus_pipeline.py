"""documents -> training corpus: language ID, line dedup, near-duplicate join, substring dedup, packing.

Each stage works on all that its predecessor kept, and its decisions take effect: rejected documents go, repeated lines
and passages are cut out, one document of each near-duplicate group stays, and what is left is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushlake.llm.common import written
from hushlake.llm.jaccard_join import linked_rows
from hushlake.llm.language_id import UNKNOWN, fit, identify, training_samples
from hushlake.llm.line_dedup import dedup_lines
from hushlake.llm.packing import pack
from hushlake.llm.substring_dedup import dedup_substrings

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text stays if one language has this share of its words, or if its words are this plain on average, whatever theirs.
MIN_SHARE, MIN_SURE = 0.34, 0.75


def _documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters and texts whose words no language explains: less than a third of them in any one, and
    unsure between several. A text that switches between plain languages stays. lang is set to the language found."""
    found = identify(docs, fit(training_samples(docs)))
    kept = found.filter((F.col("lang_pred") != UNKNOWN) & ((F.col("score") >= MIN_SHARE) | (F.col("sure") >= MIN_SURE)))
    return _documents(kept.withColumn("lang", F.col("lang_pred")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines found in 10 or more documents. Documents that lose all their lines go."""
    return _documents(dedup_lines(docs, min_docs=10, min_chars=1).filter((F.col("n_dropped") < F.col("n_lines")) & (F.trim("text") != "")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group linked by a Jaccard similarity of 0.8 on 5-word shingles: of the smallest doc_id, and of
    several of its rows the text with the smallest hash. Rows without words or doc_id stay."""
    rows = linked_rows(docs, k=5, num=80, den=100).filter("doc_id IS NOT NULL")
    first = rows.filter("doc_id = component_id").groupBy("group", "doc_id").agg(F.min("h").alias("h"))
    wordless = rows.filter("group IS NULL").select("group", "doc_id", "h")
    chosen = first.filter("group IS NOT NULL").unionByName(wordless).select("doc_id", "h").distinct()
    known = docs.filter("doc_id IS NOT NULL").withColumn("h", F.xxhash64("text"))
    kept = known.join(chosen, ["doc_id", "h"], "left_semi").dropDuplicates(["doc_id", "h"])
    return _documents(kept.unionByName(docs.filter("doc_id IS NULL"), allowMissingColumns=True))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of 50 words and more that occur in a document with a smaller doc_id. Documents that lose all
    their words go."""
    return _documents(dedup_substrings(docs, 50, rejoin=False).filter("n_removed < n_words"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of at most 1024 tokens."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 1024, 2)


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("substring dedup", substring_dedup),
    ("best-fit packing", packing),
]

#: The first stage's model and the last one's token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
