"""Failure kinds against a sequential version, release groups, corpus checks, tool names, latency."""

import random

from pyspark.sql import functions as F

from hushlake.operators import conversations, evaluate, integrity


def kinds(expected, predicted):
    """Failure kinds of one document, one span after another."""
    over = lambda a, b: a[0] < b[1] and b[0] < a[1]

    def match(relaxed):
        pairs = []
        for i, e in enumerate(expected):
            for j, p in enumerate(predicted):
                exact = e == p
                if exact or (relaxed and e[2] == p[2] and over(e, p)):
                    pairs.append((not exact, -(min(e[1], p[1]) - max(e[0], p[0])), i, j))
        left, right, out = set(), set(), {}
        for _, _, i, j in sorted(pairs):
            if i not in left and j not in right:
                left.add(i)
                right.add(j)
                out[i] = j
        return out

    exact, relaxed = match(False), match(True)
    found = set()
    for i, e in enumerate(expected):
        if i in exact:
            continue
        if i in relaxed:
            p = predicted[relaxed[i]]
            found.add("oversized_span" if p[0] <= e[0] and p[1] >= e[1] else "partial_span")
        elif any(over(e, p) for p in predicted):
            found |= {"wrong_category", "overlapping_prediction_conflict"}
        else:
            found.add("missed_entity")
    for j, p in enumerate(predicted):
        if j in exact.values():
            continue
        hit = [e for e in expected if over(e, p)]
        if hit:
            found.add("overlapping_prediction_conflict")
            if p[2] not in [e[2] for e in hit]:
                found.add("wrong_category")
        elif predicted.count(p) == 1:
            found.add("unexpected_false_positive")
    if len(set(predicted)) < len(predicted):
        found.add("duplicate_prediction")
    return found


def test_failure_kinds_against_a_sequential_version(spark):
    rng = random.Random(51)
    schema = "doc_id int, start int, end int, label string"
    e_rows, p_rows, want = [], [], set()
    for d in range(120):
        span = lambda: (a := rng.randrange(0, 30), a + rng.randint(1, 8), rng.choice("ab"))
        e = sorted({span() for _ in range(rng.randint(0, 3))})
        p = [x if rng.random() < 0.4 else span() for x in e] + [span() for _ in range(rng.randint(0, 2))]
        p += p[:1] * (d % 5 == 0)
        p.sort()
        e_rows += [(d, *x) for x in e]
        p_rows += [(d, *x) for x in p]
        want |= {(d, k) for k in kinds(e, p)}
    got = evaluate.failures(spark.createDataFrame(e_rows, schema), spark.createDataFrame(p_rows, schema))
    assert {tuple(r) for r in got.collect()} == want and len({k for _, k in want}) == 7


def test_release_groups(spark):
    rows = [(0, "original", "supported"), (0, "x", "partial"), (1, "original", "supported"), (1, "x", "supported"), (2, "x", "partial"), (1, "x", "deliberately_unsupported")]
    got = [r[0] for r in evaluate.release_group(spark.createDataFrame(rows, "n_entities int, transformation string, support string")).select("release_group").collect()]
    assert got == ["negative_controls"] * 2 + [evaluate.RELEASE_GROUPS[i] for i in (0, 2, 3, 4)]


def test_corpus_checks_of_an_empty_corpus_pass(spark):
    s = spark.createDataFrame([], "doc_id long, text string, transformation string, support string, semantics_kept boolean")
    a = spark.createDataFrame([], "doc_id long, start int, end int, entity_type string, action string, span_text string")
    c = spark.createDataFrame([], "doc_id long, tp_exact int, tp_relaxed int, support_exact int, support_relaxed int, n_duplicates int")
    rows = integrity.integrity_checks(s, a, c, {"x": "supported"}, {"email": "redact"}, 0, ["t"]).collect()
    assert len(rows) == 12 and all(r["passed"] for r in rows)


def test_outbound_tools(spark):
    names = ["mcp__mail__send", "mcp_x", "WebFetch", "webfetch", "google_search", "Read", None]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(conversations.is_outbound(F.col("n")).alias("a"), conversations.is_outbound(F.col("n"), "marked").alias("b"))
    assert [tuple(r) for r in df.collect()] == [(True, True), (False, True), (True, True), (False, True), (False, True), (False, False), (False, False)]


def test_latency_ranks_values(spark):
    rng = random.Random(52)
    rows = [("a", float(rng.randrange(20))) for _ in range(133)] + [("b", 1.0), ("c", None)]
    got = {r["k"]: (r["p95"], r["least"], r["most"]) for r in evaluate.latency_summary(spark.createDataFrame(rows, "k string, v double"), "k", "v").collect()}
    v = sorted(x for k, x in rows if k == "a")
    assert got == {"a": (v[int(132 * 0.95)], v[0], v[-1]), "b": (1.0, 1.0, 1.0)}
