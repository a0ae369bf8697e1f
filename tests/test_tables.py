"""Detectors as table functions of SQL."""

import pytest

from hushlake.functions import tables
from hushlake.functions.scan import scan
from hushlake.operators import prepare

TEXTS = ["Mail a.b@example.org from 10.0.0.7", "", None, "BSN: 111222333\nName: Jan Smit", "nothing of note"]


@pytest.fixture(scope="module")
def docs(spark):
    tables.register(spark)
    return spark.createDataFrame(list(enumerate(TEXTS)), "k int, text string")


def test_all_rules_are_those_of_the_scan(spark, docs):
    got = spark.sql("SELECT k, s.start, s.`end`, s.text, s.rule FROM {d} d, LATERAL sensitive_spans(d.text) s", d=docs).collect()
    want = [(i, s["start"], s["end"], s["text"], s["rule"]) for i, t in enumerate(TEXTS) if t for s in scan(t)]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) >= 4


def test_rules_named(spark, docs):
    got = spark.sql("SELECT k, s.text FROM {d} d, LATERAL sensitive_spans(d.text, rules => 'ipv4, email') s", d=docs).collect()
    assert sorted(map(tuple, got)) == [(0, "10.0.0.7"), (0, "a.b@example.org")]


def test_entities_are_those_of_the_analysis(spark, docs):
    got = spark.sql("SELECT k, s.start, s.entity_type, s.decision, s.reason FROM {d} d, LATERAL sensitive_entities(d.text, policy => 'gdpr') s", d=docs).collect()
    want = prepare.analyse(docs, "gdpr", key="k").select("k", "start", "entity_type", "decision", "reason").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) >= 3


@pytest.mark.parametrize("call,why", [("sensitive_spans(d.text, rules => '')", "some rule"), ("sensitive_spans(d.text, rules => 'ipv9')", "no such rule"), ("sensitive_spans(d.text, rules => d.text)", "some rule"), ("sensitive_spans(d.k)", "must be a string"), ("sensitive_entities(d.text, policy => 'mine')", "built-in policy")])
def test_refused_when_analysed(spark, docs, call, why):
    with pytest.raises(Exception, match=why):
        spark.sql(f"SELECT s.* FROM {{d}} d, LATERAL {call} s", d=docs)
