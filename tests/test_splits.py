"""Large files read by several tasks, ranks found by sketch and count, corpora committed with their manifest."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from hushlake.operators import evaluate
from hushlake.sources import corpus


def sequential(text):
    out, sentence, position = [], 0, 0
    for line in text.split("\n")[:-1]:
        v = line.strip(" ")
        if v == "" or v.startswith("#"):
            sentence, position = sentence + 1, 0
        else:
            position += 1
            out.append((sentence, position, v.split()[0], v.split()[-1]))
    return out


@pytest.mark.parametrize("border", [0.1, 0.002])
def test_one_conll_file_read_by_several_tasks(spark, tmp_path, border):
    """Sentences that cross blocks, and blocks within one sentence, are numbered as one task would number them."""
    rng = random.Random(4)
    lines = ["" if rng.random() < border else "# id 7" if rng.random() < border / 2 else f"wörd{i} _ _ {rng.choice(['O', 'B-PER', 'I-PER'])}" for i in range(6000)]
    text = "\n".join(lines) + "\n"
    (tmp_path / "x.conll").write_text(text)
    (tmp_path / "y.conll").write_text("a O\n\nb O\n")
    keys = {"spark.sql.files.maxPartitionBytes": "4000", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        t = corpus.read_conll(spark, str(tmp_path)).cache()
        assert spark.read.text(str(tmp_path / "x.conll")).rdd.getNumPartitions() > 10
        got = t.filter(F.col("file").endswith("x.conll")).select("sentence", "position", "token", "tag").collect()
        assert sorted(map(tuple, got)) == sorted(sequential(text))
        assert sorted(tuple(r)[1:] for r in t.filter(F.col("file").endswith("y.conll")).collect()) == [(0, 1, "a", "O"), (1, 1, "b", "O")]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("n", [1, 2, 3, 40, 9_999, 60_001])
def test_ranks_are_exact(spark, n):
    """One group with all rows but a few, ties and nulls among them; no rank is off by one."""
    rng = random.Random(n)
    values = [float(rng.choice([rng.randrange(50), rng.random() * 1e6])) for _ in range(n)]
    df = spark.createDataFrame([("hot", v) for v in values] + [("hot", None), ("few", 3.0), ("none", None)], "g string, v double")
    got = {r["g"]: r for r in evaluate.latency_summary(df, "g", "v").collect()}
    own = sorted(values)
    assert set(got) == {"hot", "few"}
    assert got["hot"].asDict() == {"g": "hot", "median": statistics.median(own), "p95": own[int((n - 1) * 0.95)], "least": own[0], "most": own[-1]}
    assert got["few"]["p95"] == got["few"]["median"] == 3.0


def test_rank_of_a_group_far_larger_than_the_sketch(spark):
    df = spark.range(200_000).select(F.lit("hot").alias("g"), F.col("id").cast("double").alias("v"))
    out = evaluate.order_statistics(df, "g", "v", {"p": F.floor((F.col("n") - 1) * 0.95), "q": F.lit(0), "r": F.col("n") - 1}).first()
    assert (out["p"], out["q"], out["r"]) == (189_999.0, 0.0, 199_999.0)


def samples(spark, n=40):
    return spark.range(n).selectExpr("concat('s', id) AS id", "if(id % 2 = 0, 'nl', 'en') AS language", "concat('text ', id) AS text", "if(id % 5 = 0, 'x', 'original') AS transformation")


def test_corpus_is_committed_with_its_manifest(spark, tmp_path):
    root = str(tmp_path / "c")
    corpus.write_corpus(samples(spark).repartition(3), root, ["language", "transformation"])
    assert corpus.read_corpus(spark, root).count() == 40
    counts = {(r["field"], r["value"]): r["n"] for r in spark.read.json(f"{root}/manifest/counts").collect()}
    assert counts == {("language", "nl"): 20, ("language", "en"): 20, ("transformation", "x"): 8, ("transformation", "original"): 32}
    with pytest.raises(corpus.CorpusError, match="exists"):
        corpus.write_corpus(samples(spark), root, ["language"])


def test_torn_changed_and_foreign_files_are_refused(spark, tmp_path):
    root = tmp_path / "c"
    corpus.write_corpus(samples(spark).repartition(3), str(root), ["language"])
    part = sorted((root / "data").glob("part-*"))[0]
    held = part.read_text()
    (root / "data" / f".{part.name}.crc").unlink(missing_ok=True)  # a local file's own checksum
    part.write_text(held.replace("text", "next", 1))
    with pytest.raises(corpus.CorpusError, match="changed"):
        corpus.read_corpus(spark, str(root))
    part.write_text(held)
    assert corpus.read_corpus(spark, str(root)).count() == 40
    (root / "data" / "part-zz.json").write_text(held)
    with pytest.raises(corpus.CorpusError, match="unlisted"):
        corpus.read_corpus(spark, str(root))
    torn = tmp_path / "t"
    samples(spark).write.json(str(torn / "data"))
    with pytest.raises(corpus.CorpusError, match="manifest"):
        corpus.read_corpus(spark, str(torn))
