"""Texts are read once and in many tasks: no filter pulls their reading below it, and files of keys are dealt over tasks."""

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from hushlake.functions import normalise, scan
from hushlake.operators import detect, evaluate, golden, intervals, prepare
from hushlake.plans import catalog, golden_cases, rules


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def texts(spark):
    return spark.createDataFrame([(1, "IBAN NL91ABNA0417164300"), (2, None), (3, "nothing")], "doc_id long, text string")


def test_filters_on_results_read_no_text_again(spark):
    assert plan(prepare.restore(prepare.prepare(texts(spark)).filter("status = 'ok'"))).count("ArrowEvalPython") == 1
    assert plan(detect.findings(detect.detect(texts(spark)), "candidates", "doc_id")).count("ArrowEvalPython") == 1


def test_failed_fixtures_are_read_once(spark):
    k = spark.range(5).select(F.col("id").alias("k"))
    own = k.select(*[F.expr(x).alias(c) for c, x in golden_cases.FIXTURE.items()])
    assert plan(golden.failed(golden.observed(own))).count("ArrowEvalPython") == 1


def test_single_rules_run_once_behind_the_deal(spark):
    found = detect.findings(texts(spark).repartition(3).withColumn("c", detect.rule_spans(F.col("text"), catalog.RULE["iban"])), "c", "doc_id")
    below = plan(found).partition("Exchange")[2]
    assert "regexp" not in below.lower() and "rlike" not in below.lower()
    assert [(r.doc_id, r.start) for r in found.collect()] == [(1, 5)]


def test_keys_of_one_split_are_dealt(spark, tmp_path):
    pq.write_table(pa.table({"c_custkey": list(range(1000))}), tmp_path / "customer.parquet")
    dealt = catalog._keys(spark, str(tmp_path), 100)
    assert dealt.rdd.getNumPartitions() == 10 and sorted(r.k for r in dealt.collect()) == list(range(1000))
    pq.write_table(pa.table({"c_custkey": pa.array([], pa.int64())}), tmp_path / "customer.parquet")
    assert catalog._keys(spark, str(tmp_path)).count() == 0


def test_only_rules_with_a_label_in_the_text_are_searched():
    at = {r.name: i for i, r in enumerate(rules.LABELS)}
    assert scan._named("Project name \t: x\nBSN=1") == sorted(at[x] for x in ("name_label", "project_label", "bsn_label"))
    assert scan._named("name\n: x") == [] and scan._named("no sign") == []
    # a long s passes for an s in patterns, so all rules are searched
    assert [(s["entity_type"], s["text"]) for s in scan.labelled("paſſport: AB1234\nBSN: 123456782")] == [("bsn", "123456782"), ("passport_number", "AB1234")]


def test_views_of_spaces_need_no_cells():
    for text in ("", "a  b", "  a\t\tb \n c  ", "\n", "  ", "x\ny  z", "10.0.0.1  \n 10.0.0.2"):
        norm, cells = normalise.view(text)
        assert normalise.spaces_only(text) == norm and normalise.spaces(text) == normalise.runs(cells)
        place = normalise.place(normalise.spaces(text))
        assert all(place(a, b) == (cells[a][1], cells[b - 1][2]) for a in range(len(norm)) for b in range(a + 1, len(norm) + 1))


def test_spans_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(intervals, "DEAL", 100)
    e = spark.range(1000).selectExpr("id DIV 10 AS doc_id", "CAST(id % 10 * 20 AS INT) AS start", "CAST(id % 10 * 20 + 9 AS INT) AS end", "'a' AS label")
    counts = evaluate.exact_counts(e, e.filter("start > 0"))
    # twenty shares in all, of which neither side is aggregated before it is dealt, and nothing is shuffled after
    assert plan(counts).count("Exchange") == 1 and "hashpartitioning(doc_id" in plan(counts) and ", 19)" in plan(counts)
    assert counts.agg(F.sum("tp"), F.sum("fp"), F.sum("fn"), F.count("*")).first() == (900, 0, 100, 100)
    assert evaluate.relaxed_counts(e, e).agg(F.sum("tp"), F.sum("fp"), F.sum("fn")).first() == (1000, 0, 0)


def test_spans_with_nulls_match_none(spark):
    rows = [(1, 0, 5, None), (1, 0, 5, None), (None, 0, 5, "a")]
    e = spark.createDataFrame(rows, "doc_id long, start int, end int, label string")
    p = spark.createDataFrame(rows[1:], e.schema)
    assert sorted(map(tuple, evaluate.exact_counts(e, p).collect()), key=repr) == [(1, None, 0, 1, 2), (None, "a", 0, 1, 1)]
