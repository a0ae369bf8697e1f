"""Exact dedup, centroid clustering and the filter audit: odd rows, ties, empty tables, against brute force."""

import hashlib
import re

import numpy as np
import pytest

from hushlake.llm import delta_lloyd, exact_dedup, filter_audit


@pytest.mark.parametrize("trie_bytes", [exact_dedup.TRIE_BYTES, 64])
def test_exact_dedup(spark, trie_bytes):
    """A small bound makes tries spill by subtree; nulls, blanks, prefixes, copies, a long text, clashing columns."""
    texts = [None, "", " \t\n", "one", "o n e", "on", "one two", "onetwo ", "x" * 20_000, "x" * 19_999, *["many copies"] * 9, "many  copies", "é", "é"]
    rows = [(i, t, 5) for i, t in enumerate(texts)]
    got = exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string, group_size int"), trie_bytes).collect()
    bare = {i: re.sub(r"[\x20\x09-\x0D]", "", t or "") for i, t, _ in rows}
    for r in got:
        own = [i for i in bare if bare[i] == bare[r["doc_id"]]]
        keep = min(own, key=lambda i: (-len(texts[i] or ""), i))
        assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(own), keep == r["doc_id"])
        assert r["text_sha256"] == hashlib.sha256(bare[r["doc_id"]].encode()).hexdigest()
    assert sorted(r["doc_id"] for r in got) == list(range(len(rows)))
    assert exact_dedup.exact_duplicates(spark.createDataFrame([], "doc_id long, text string"), trie_bytes).count() == 0


def test_clustering(spark):
    """Against plain Lloyd on integers; unusable vectors are left out, equal ones tie to the smaller number."""
    rng = np.random.default_rng(3)
    usable = [(i, (rng.standard_normal(4) + i % 3).tolist()) for i in range(60)] + [(60 + i, [1.0, 1.0, 1.0, 1.0]) for i in range(5)]
    bad = [(90, None), (91, [1.0] * 3), (92, [1.0, None, 1.0, 1.0]), (93, [float("nan")] * 4), (94, [float("inf")] * 4)]
    df = spark.createDataFrame(usable + bad, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in delta_lloyd.cluster(df, k=5, rounds=3, dim=4, scale=64).collect()}
    v = {i: np.floor(64 * np.array(x)).astype(np.int64) for i, x in usable}
    c = [v[i] for i in sorted(v, key=lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest())[:5]]
    for turn in range(4):
        dist = {i: [int(((x - y) ** 2).sum()) for y in c] for i, x in v.items()}
        owner = {i: d.index(min(d)) for i, d in dist.items()}
        if turn < 3:
            c = [np.array([sum(int(v[i][j]) for i in own) // len(own) for j in range(4)]) if own else y for k, y in enumerate(c) for own in [[i for i in v if owner[i] == k]]]
    assert set(got) == set(v)
    assert all((r["cluster"], r["distance"]) == (owner[i], min(dist[i])) for i, r in got.items())
    assert {r["inertia"] for r in got.values()} == {sum(map(min, dist.values()))}
    assert all(r["centroid_sha256"] == hashlib.sha256(",".join(map(str, c[r["cluster"]].tolist())).encode()).hexdigest() for r in got.values())
    assert delta_lloyd.cluster(df.limit(0), k=5, dim=4).count() == 0


def test_filter_audit_of_odd_rows(spark):
    rows = [(1, None, "en"), (2, "", None), (2, "", None), (3, "A#", "en"), (4, "A#", "en"), (5, " ".join(f"w{i}" for i in range(150)), "en"), (None, "A#", "en")]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([(4, 1, 0), (4, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): r for r in filter_audit.audit(docs, labels).collect()}
    assert len(got) == 2 * 120 * 5
    first = got["en", "ABCDE", 1]
    assert (first["kept"], first["removed"], first["redundant"], first["good_lost"], first["toxic_lost"]) == (1, 4, 0, 1, 1)
    # only the fourth is a copy of a smaller id there; the null text and the part of '' are those of an empty text
    assert got["en", "EABCD", 1]["removed"] == 1 and got["", "EABCD", 1]["removed"] == 2 and got["en", "ABCDE", 5]["redundant"] == 1
    for part, n in (("en", 4), ("", 2)):
        assert sum(got[part, "ABCDE", k]["removed"] for k in range(1, 6)) == n
        assert sum(got[part, "ABCDE", k]["shapley"] for k in range(1, 6)) == 120 * n
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
