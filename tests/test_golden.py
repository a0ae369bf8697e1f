"""The engine on a labelled corpus: six stages, reasons of failures, faults of fixtures and of the engine."""

import pytest

from hushlake.functions import core
from hushlake.operators import golden

MAIL = "Mail a.b@example.org and a.b@example.org"


def fixtures(spark, rows):
    """rows: (id, input, entities, assertions, forbidden, safe, dispatch)."""
    ddl = "id string, input string, expected_entities array<struct<text:string,type:string>>, expected_assertions array<struct<category:string,negated:boolean>>, sanitized_must_not_contain array<string>, expected_residual_safe boolean, provider_dispatch string"
    return spark.createDataFrame(rows, ddl).selectExpr("*", "'en' AS language", "CAST(map() AS map<string,string>) AS expected_policy_actions")


def test_stages_count_multisets(spark):
    """Two expected, two found by rules and merged; nothing is left to find in safe text."""
    seen = golden.observed(fixtures(spark, [("a", MAIL, [("a.b@example.org", "email")] * 3, [], [], True, "permit"), ("n", None, None, None, None, True, "permit")]))
    rows = {r["stage"]: r for r in golden.stage_metrics(seen).collect() if r["entity_type"] == "email"}
    assert set(rows) == set(golden.STAGES)
    assert [(rows[s]["tp"], rows[s]["fp"], rows[s]["fn"]) for s in ("deterministic", "merged", "label_aware")] == [(2, 0, 1), (2, 0, 1), (0, 0, 3)]
    assert rows["label_aware"]["precision"] == 1.0 and rows["label_aware"]["f1"] == 0.0
    assert golden.failed(seen).collect() == []


def test_nothing_to_evaluate(spark):
    seen = golden.observed(fixtures(spark, []))
    assert golden.stage_metrics(seen).count() == golden.failed(seen).count() == golden.misclassified(seen).count() == 0
    one = golden.summary(seen).first()
    assert one["n_fixtures"] == 0 and one["assertion_precision"] == one["critical_span_recall"] == 1.0 and one["general_discussion_false_positive_rate"] == 0.0


def test_unknown_dispatch_fails_the_job(spark):
    seen = golden.observed(fixtures(spark, [("a", "x", [], [], [], True, "perhaps")]))
    with pytest.raises(Exception, match="no such dispatch"):
        golden.failed(seen).collect()


def test_what_breaks_the_engine_is_unsafe(spark, monkeypatch):
    def broken(*_):
        raise RuntimeError

    monkeypatch.setattr(core, "audit", broken)
    from hushlake.plans.policies import BUILT_IN

    found, said, blocked, _, safe_text, safe, critical = golden._read(MAIL, BUILT_IN["gdpr_strict"])
    assert (found, said, blocked, safe_text, safe, critical) == ([], [], True, None, False, 1)


def test_a_failing_scan_of_the_safe_text_leaves_it_unsafe(monkeypatch):
    """The rules read the input, and break on what came of it."""
    from hushlake.plans.policies import BUILT_IN

    scan = core.scan
    monkeypatch.setattr(core, "scan", lambda t: scan(t) if "@" in t else 1 / 0)
    told = core.audit(MAIL, BUILT_IN["gdpr_strict"])
    assert told["sanitized"] and not told["safe"] and told["critical"] == 1
