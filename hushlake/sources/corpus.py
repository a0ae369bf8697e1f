"""Scans and sinks of corpora: JSON fixtures, JSONL, CoNLL, CSV, manifests, reports, safe copies, an encrypted vault."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FIXTURE = (
    "corpus_version int, fixtures array<struct<id:string,language:string,input:string,expected_entities:array<struct<text:string,type:string>>,expected_assertions:array<struct<category:string,negated:boolean>>,"
    "expected_policy_actions:map<string,string>,sanitized_must_not_contain:array<string>,expected_residual_safe:boolean,provider_dispatch:string>>"
)
SAMPLE = (
    "id string, language string, domain string, text string, entities array<struct<start:int,end:int,entity_type:string,expected_action:string,text:string,assertion_type:string,provenance:map<string,string>>>, source string, tier string, "
    "format string, split string, transformation string, transformation_chain array<string>, transformation_support string, template_group string, source_record_group string, source_document_group string, transformation_parent string, "
    "entity_value_group string, seed_group string, metadata map<string,string>"
)
# Entity tags of token-labelled corpora.
TAGS = {"PER": "person", "PERSON": "person", "LOC": "location", "LOCATION": "location", "GRP": "organization", "CORP": "organization", "ORG": "organization"}


class CorpusError(ValueError):
    pass


def _refuse(bad: DataFrame, why: str) -> None:
    if bad.limit(1).count():
        raise CorpusError(why)


def read_fixtures(spark: SparkSession, root: str) -> DataFrame:
    """Fixtures of all *.json below root; version 1 and unique ids are required."""
    raw = spark.read.schema(FIXTURE).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("mode", "FAILFAST").json(root)
    _refuse(raw.filter("corpus_version IS NULL OR corpus_version <> 1"), "corpus_version")
    out = raw.select(F.explode("fixtures").alias("f")).select("f.*")
    _refuse(out.groupBy("id").count().filter("count > 1"), "duplicate id")
    return out


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Labelled samples, one JSON object a line; anything malformed fails the scan."""
    return spark.read.schema(SAMPLE).option("mode", "FAILFAST").json(path)


def read_benchmark(spark: SparkSession, root: str) -> DataFrame:
    """Samples of all *.json files {samples: [...]} below root, with the file they come from."""
    raw = spark.read.schema(f"split string, samples array<struct<{','.join(x.strip().replace(' ', ':', 1) for x in _fields(SAMPLE))}>>").option("multiLine", True).option("recursiveFileLookup", True).json(root)
    return raw.select(F.input_file_name().alias("file"), "split", F.explode("samples").alias("s")).select("file", F.coalesce("s.split", "split").alias("file_split"), "s.*")


def _fields(ddl: str) -> list[str]:
    out, deep, at = [], 0, 0
    for i, c in enumerate(ddl):
        deep += (c == "<") - (c == ">")
        if c == "," and not deep:
            out.append(ddl[at:i])
            at = i + 1
    return [*out, ddl[at:]]


def verify_manifest(spark: SparkSession, root: str, manifest: DataFrame, but: tuple[str, ...] = ("manifest.json",)) -> DataFrame:
    """(path, fault): files of a manifest (path below root, sha256) that are missing, changed or outside of root, and files
    below root that it doesn't list (but those named). Only hashes leave the executors."""
    outside = F.col("path").rlike(r"(^|/)\.\.(/|$)|^/")
    below = spark._jvm.org.apache.hadoop.fs.Path(root)
    below = below.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(below).toUri().getPath().rstrip("/")
    here = F.regexp_replace("path", r"^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?(?=/)", "")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    seen = files.select(here.substr(F.lit(len(below) + 2), F.length("path")).alias("found"), F.sha2("content", 256).alias("actual"))
    j = manifest.join(seen.filter(~F.col("found").isin(*but)), F.col("path") == F.col("found"), "full")
    why = F.when(F.col("path").isNull(), "unlisted").when(outside, "outside").when(F.col("actual").isNull(), "missing").when(F.col("actual") != F.col("sha256"), "changed")
    return j.withColumn("fault", why).filter("fault IS NOT NULL").select(F.coalesce("path", "found").alias("path"), "fault")


def read_conll(spark: SparkSession, path: str) -> DataFrame:
    """(file, sentence, position, token, tag) of token-per-line files; blank and # lines end sentences, which are numbered
    from 0 by such lines, whatever task reads them.

    A large file is read by several tasks: lines are in order within a block of a file, a small table of blocks tells how
    many sentences end before each, and how many tokens the sentence that goes on from earlier blocks has there already.
    No task sees more of a file than a block.
    """
    where = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    lines = spark.read.text(path).select(*where, F.monotonically_increasing_id().alias("line"), F.trim("value").alias("v"))
    ends = ((F.col("v") == "") | F.col("v").startswith("#")).alias("ends")
    lines = lines.select("file", "block", "line", "v", ends)
    here = Window.partitionBy("file", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = lines.withColumn("n_ended", F.sum(F.col("ends").cast("int")).over(here))
    # of each block: borders in it, and its tokens behind the last of them, which the next block's first sentence goes on from
    sentences = own.groupBy("file", "block", "n_ended").agg(F.count_if(~F.col("ends")).alias("n"))
    blocks = sentences.groupBy("file", "block").agg(F.max("n_ended").alias("borders"), F.max_by("n", "n_ended").alias("behind"))
    w = Window.partitionBy("file").orderBy("block")
    blocks = blocks.select("*", F.coalesce(F.sum("borders").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ended"), F.sum((F.col("borders") > 0).cast("int")).over(w).alias("run"))
    # blocks without a border go on with one sentence: what they have of it adds up
    blocks = blocks.withColumn("sofar", F.sum("behind").over(Window.partitionBy("file", "run").orderBy("block")))
    offsets = blocks.select("file", "block", "ended", F.coalesce(F.lag("sofar").over(w), F.lit(0)).alias("opened"))
    rows = own.filter(~F.col("ends")).join(offsets, ["file", "block"])
    parts = F.split("v", r"\s+")
    _refuse(lines.filter(~F.col("ends") & (F.size(parts) < 2)), "fewer than two columns")
    place = F.row_number().over(Window.partitionBy("file", "block", "n_ended").orderBy("line"))
    position = place + F.when(F.col("n_ended") == 0, F.col("opened")).otherwise(0)
    return rows.select("file", (F.col("ended") + F.col("n_ended")).alias("sentence"), position.cast("int").alias("position"), F.get(parts, 0).alias("token"), F.element_at(parts, -1).alias("tag"))


def bio_spans(tokens: DataFrame, by: list[str]) -> DataFrame:
    """(by..., start, end, entity_type, text) from BIO tags, tokens joined by one space: gaps and islands over windows.
    I- goes on with a span only behind the same type, else it begins one."""
    w = Window.partitionBy(*by).orderBy("position")
    kind = F.when(F.col("tag").contains("-"), F.coalesce(F.try_element_at(F.create_map(*[x for k, v in TAGS.items() for x in (F.lit(k), F.lit(v))]), F.upper(F.regexp_extract("tag", "^[BI]-(.*)$", 1))), F.lit("unmapped")))
    t = tokens.withColumn("kind", kind).withColumn("at", F.coalesce(F.sum(F.length("token") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    new = F.col("tag").startswith("B-") | ~F.coalesce(F.lag("kind").over(w) == F.col("kind"), F.lit(False))
    t = t.withColumn("island", F.sum(F.when(F.col("kind").isNull() | new, 1).otherwise(0)).over(w)).filter("kind IS NOT NULL")
    g = t.groupBy(*by, "island", "kind").agg(F.min("at").alias("start"), F.max(F.col("at") + F.length("token")).alias("end"), F.array_sort(F.collect_list(F.struct("position", "token"))).alias("ts"))
    return g.select(*by, F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.col("kind").alias("entity_type"), F.array_join(F.transform("ts", lambda x: x["token"]), " ").alias("text"))


def read_government(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """Documents of a CSV with header, or JSONL; text is required."""
    df = spark.read.option("header", True).option("multiLine", True).option("encoding", "UTF-8").csv(path) if fmt == "csv" else spark.read.json(path)
    _refuse(df.filter("text IS NULL OR trim(text) = ''"), "text missing")
    return df


def count_maps(samples: DataFrame, columns: list[str]) -> DataFrame:
    """Counts by value of each column, stacked."""
    return samples.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "field", "value").groupBy("field", "value").count()


#: Rows of a corpus file, at most: its digest is taken in one piece.
FILE_ROWS = 100_000
# Columns that a corpus is counted by.
COUNTED = ("language", "source", "split", "assertion_type", "entity_type", "domain", "transformation", "template_group")


def _path(spark: SparkSession, path: str) -> tuple:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_corpus(samples: DataFrame, root: str, counted: list[str] | None = None) -> None:
    """samples as JSON lines below root/data, sorted columns, with a manifest in root/manifest: the digest of every file that
    was written, and counts by value of each counted column (those of COUNTED that are there; entities count by theirs).

    The manifest is written aside and renamed last, so a corpus whose job ended early has none and is refused by
    read_corpus. A root that holds anything is left alone.
    """
    spark = samples.sparkSession
    fs, p = _path(spark, root)
    if fs.exists(p):
        raise CorpusError(f"{root} exists")
    samples.select(*sorted(samples.columns)).write.option("maxRecordsPerFile", FILE_ROWS).json(f"{root}/data")
    rows = spark.read.schema(samples.schema).json(f"{root}/data")
    inside = [c for c in COUNTED if "entities" in rows.columns and c in rows.schema["entities"].dataType.elementType.names]
    names = counted if counted is not None else [c for c in COUNTED if c in rows.columns]
    counts = count_maps(rows, names) if names else None
    if inside and counted is None:
        entities = count_maps(rows.select(F.explode("entities").alias("e")).select("e.*"), inside)
        counts = entities if counts is None else counts.unionByName(entities)
    aside = f"{root}/_manifest"
    _digests(spark, root).write.json(f"{aside}/files")
    if counts is not None:
        counts.withColumnRenamed("count", "n").write.json(f"{aside}/counts")
    if not fs.rename(_path(spark, aside)[1], _path(spark, f"{root}/manifest")[1]):
        raise CorpusError("manifest not written")


def _digests(spark: SparkSession, root: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(f"{root}/data")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("path"), F.sha2("content", 256).alias("sha256"))


def read_corpus(spark: SparkSession, root: str, schema: str | None = None) -> DataFrame:
    """The samples of write_corpus(). A corpus without a manifest, or with files that are missing, changed or not listed,
    is refused before anything is read."""
    fs, p = _path(spark, f"{root}/manifest")
    if not fs.exists(p):
        raise CorpusError("no manifest: the corpus was not written to its end")
    manifest = spark.read.schema("path string, sha256 string").json(f"{root}/manifest/files")
    bad = verify_manifest(spark, f"{root}/data", manifest).filter(~F.col("path").startswith("_")).orderBy("path").head(3)
    if bad:
        raise CorpusError("; ".join(f"{r['path']} {r['fault']}" for r in bad))
    return spark.read.schema(schema).json(f"{root}/data") if schema else spark.read.json(f"{root}/data")


def write_report(report: DataFrame, path: str, fmt: str = "json") -> None:
    flat = report if fmt == "json" else report.select(*[F.to_json(c).alias(c) if dict(report.dtypes)[c].startswith(("array", "map", "struct")) else F.col(c) for c in report.columns])
    flat.write.mode("errorifexists").format(fmt).option("header", True).save(path)


def write_safe_copy(prepared: DataFrame, path: str) -> None:
    """Approved texts alone; an existing copy is never overwritten."""
    prepared.filter("status = 'ok'").select(F.col("safe_text").alias("value")).write.mode("errorifexists").text(path)


def sealed(mapping: Column, key: Column) -> Column:
    """A mapping encrypted with AES-GCM; the key comes as a column so that it can be read from a secret source."""
    return F.base64(F.aes_encrypt(F.to_json(mapping), key, F.lit("GCM"), F.lit("DEFAULT")))


def opened(cipher: Column, key: Column) -> Column:
    """The mapping of sealed(); null if the key is another or the text was changed."""
    return F.from_json(F.try_aes_decrypt(F.unbase64(cipher), key, F.lit("GCM"), F.lit("DEFAULT")).cast("string"), "map<string,string>")
