"""Interval and as-of joins against brute force; hot keys, long intervals, nulls, empty tables."""

import random
import time

import pytest
from pyspark.sql import functions as F

from hushlake.operators import evaluate, intervals
from hushlake.operators.asof import asof_join


def spans(n, seed, top=300, labels="ab", longest=30):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        a = rng.randrange(top)
        out.append((rng.randrange(3), a, a + rng.choice([0, 1, rng.randrange(longest), rng.randrange(longest), rng.randrange(top)] if not rng.randrange(8) else [rng.randrange(1, longest)]), rng.choice(labels)))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id int, start int, end int, label string")


@pytest.mark.parametrize("block", [7, 64, 4096])
def test_overlapping_pairs(spark, block):
    left, right = spans(150, 1), [*spans(150, 2), *spans(20, 1)]
    got = intervals.overlapping(frame(spark, left), frame(spark, right), ["doc_id"], block=block).select("doc_id", "l.*", F.col("r.start").alias("s"), F.col("r.end").alias("e"), F.col("r.label").alias("x"))
    want = [(d, s, e, x, s2, e2, x2) for d, s, e, x in left for d2, s2, e2, x2 in right if d == d2 and s < e2 and s2 < e]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 300


def test_overlapping_of_nothing_and_of_nulls(spark):
    some, none = frame(spark, [(1, 0, 5, "a"), (None, 0, 5, "a"), (1, None, 5, "a"), (1, 3, None, "a")]), frame(spark, [])
    assert intervals.overlapping(some, some, ["doc_id"]).count() == 1
    assert intervals.overlapping(some, none, ["doc_id"]).count() == intervals.overlapping(none, some, ["doc_id"]).count() == 0


def test_one_document_with_very_many_spans(spark):
    """10^5 spans on one document: neighbours overlap, so pairs grow with the spans and not with their square."""
    n = 100_000
    rows = spark.range(n).select(F.lit(1).alias("doc_id"), (F.col("id") * 10).cast("int").alias("start"), (F.col("id") * 10 + 15).cast("int").alias("end"), F.lit("a").alias("label"))
    began = time.time()
    assert intervals.overlapping(rows, rows, ["doc_id"]).count() == 3 * n - 2
    moved = rows.withColumn("start", F.col("start") + 1)
    assert evaluate.relaxed_counts(rows, moved).first()["tp"] == n
    assert evaluate.failures(rows, moved).collect()[0]["failure"] is not None
    assert time.time() - began < 120


def test_equal_spans_in_great_number(spark):
    e = spark.range(30_000).select(F.lit(1).alias("doc_id"), F.lit(3).alias("start"), F.lit(9).alias("end"), F.lit("a").alias("label"))
    r = evaluate.relaxed_counts(e, e.limit(20_000)).first()
    assert (r["tp"], r["fp"], r["fn"]) == (20_000, 0, 10_000)


def greedy(e, p, same):
    """All pairs of one document, sorted, taken one to one."""
    pairs = []
    for i, (_, s, t, x) in enumerate(e):
        for j, (_, s2, t2, x2) in enumerate(p):
            if s < t2 and s2 < t and (not same or x == x2):
                pairs.append((not (s == s2 and t == t2), x != x2, -(min(t, t2) - max(s, s2)), i, j))
    left, right, out = set(), set(), []
    for *_, i, j in sorted(pairs):
        if i not in left and j not in right:
            left.add(i)
            right.add(j)
            out.append((i, j))
    return out


@pytest.mark.parametrize("same", [True, False])
def test_greedy_matches(spark, same):
    e, p = [sorted(spans(120, s, top=120)) for s in (3, 4)]
    p = sorted(p + e[::3] + e[::6])
    got = sorted(map(tuple, evaluate.greedy_matches(frame(spark, e), frame(spark, p), same).collect()))
    want = []
    for d in range(3):
        a, b = [x for x in e if x[0] == d], [x for x in p if x[0] == d]
        want += [(d, *a[i][1:], *b[j][1:]) for i, j in greedy(a, b, same)]
    assert got == sorted(want) and len(want) > 60


def kinds(e, p):
    """What the failures of one document are, by definition. Spans: (doc, start, end, label, action)."""
    over = lambda a, b: a[1] < b[2] and b[1] < a[2]
    out, ei, pi = set(), list(range(len(e))), list(range(len(p)))
    exact = {}
    for i in ei:
        j = next((j for j in pi if j not in exact.values() and e[i][:4] == p[j][:4]), None)
        if j is not None:
            exact[i] = j
    relaxed = dict(greedy([x[:4] for x in e], [x[:4] for x in p], True))
    for i in ei:
        if i in exact:
            continue
        if i in relaxed:
            g = p[relaxed[i]]
            out.add("oversized_span" if g[1] <= e[i][1] and g[2] >= e[i][2] else "partial_span")
        else:
            out |= {"wrong_category", "overlapping_prediction_conflict"} if any(over(e[i], x) for x in p) else {"missed_entity"}
    for j in pi:
        if j in exact.values():
            continue
        met = [x for x in e if over(x, p[j])]
        if met:
            out |= {"overlapping_prediction_conflict"} | ({"wrong_category"} if all(x[3] != p[j][3] for x in met) else set())
        elif sum(x[:4] == p[j][:4] for x in p) == 1:
            out.add("unexpected_false_positive")
    if len({x[:4] for x in p}) < len(p):
        out.add("duplicate_prediction")
    if any(e[i][4] is not None and e[i][4] != p[j][4] for i, j in relaxed.items()):
        out.add("policy_decision_defect")
    return out


def test_failures_by_definition(spark):
    rng, e, p = random.Random(5), [], []
    for doc in range(150):
        own = [(doc, a, a + rng.randint(1, 12), rng.choice("ab"), rng.choice(["x", "y", None])) for a in (rng.randrange(60) for _ in range(rng.randrange(5)))]
        other = [x[:4] + (rng.choice("xy"),) for x in own if rng.random() < 0.6] + [(doc, a, a + rng.randint(1, 12), rng.choice("ab"), "x") for a in (rng.randrange(60) for _ in range(rng.randrange(3)))]
        # copies of a span share their action, so that any of them may be the one matched
        own, other = sorted({x[:4]: x for x in own}.values()), sorted({x[:4]: x for x in other}.values())
        e += own
        p += other + other[: rng.randrange(2)]
    ddl = "doc_id int, start int, end int, label string, action string"
    got = {(r["doc_id"], r["failure"]) for r in evaluate.failures(spark.createDataFrame(e, ddl), spark.createDataFrame(p, ddl)).collect()}
    want = {(d, k) for d in range(150) for k in kinds(sorted(x for x in e if x[0] == d), sorted(x for x in p if x[0] == d))}
    assert got == want and len({k for _, k in want}) == 8


@pytest.mark.parametrize("ranges", [1, 5, 64])
@pytest.mark.parametrize("strict", [False, True])
def test_asof_join(spark, ranges, strict):
    rng = random.Random(6)
    key = lambda: rng.choice(["hot"] * 6 + ["b", "c", None])
    left = [(i, key(), rng.choice([None, *range(200)])) for i in range(300)]
    right = [(i, key(), rng.choice([None, *range(0, 200, 3)]), rng.choice(["p", None])) for i in range(120)]
    right = list({(x[1], x[2]): x for x in right}.values())  # one row a key and time
    got = asof_join(spark.createDataFrame(left, "id int, k string, t long"), spark.createDataFrame(right, "rid int, k string, t long, v string"), ["k"], "t", ranges, strict=strict)
    want = {}
    for i, k, t in left:
        some = [x for x in right if k is not None and t is not None and x[1] == k and x[2] is not None and (x[2] < t if strict else x[2] <= t)]
        want[i] = max(some, key=lambda x: x[2])[0] if some else None
    rows = got.select("id", "r.rid").collect()
    assert {r["id"]: r["rid"] for r in rows} == want and len(rows) == len(left)


def test_asof_join_of_nothing_and_with_an_age(spark):
    a, b = spark.createDataFrame([(1, 10), (2, 50)], "id int, t int"), spark.createDataFrame([(7, 5)], "rid int, t int")
    rows = asof_join(a, b.limit(0), [], "t").collect()
    assert [(r["id"], r["r"]) for r in sorted(rows)] == [(1, None), (2, None)] and asof_join(a.limit(0), b, [], "t").count() == 0
    aged = asof_join(a, b, [], "t", within=F.col("t") - F.col("r.t") <= 20)
    assert {r["id"]: r["r"] and r["r"]["rid"] for r in aged.collect()} == {1: 7, 2: None}
    assert [r["id"] for r in asof_join(a, b, [], "t", within=F.col("t") - F.col("r.t") <= 20, keep=False).collect()] == [1]
