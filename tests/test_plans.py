"""DataFrame operators: native columns against Python, joins against small tables, sources and state."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from hushlake.functions import scan, spans, validators
from hushlake.operators import conversations, detect, evaluate, generate, integrity, language, merge, prepare
from hushlake.plans import rules
from hushlake.sources import corpus

TEXTS = [
    "🙂 mail jan@example.com, 'x@y.org' or a..b@c.d", "ip 10.0.0.1 256.1.1.1 1.2.3.4.5", "card 4111 1111 1111 1111 and 4111-1111-1111-1112", "NL91ABNA0417164300 NL91 ABNA 0417 1643 00",
    "123456782 000000000 12:30 25:00 3 May 2024 1/2/2024", "+31 6 12345678 010-1234567 1-2-3-4-5-6-7", "2001:db8::1 ::1 1:2:3:4:5:6:7:8 1::2::3", "1234 AB 00:1A:2B:3C:4D:5E", "", None,
]


@pytest.mark.parametrize("rule", rules.RULES, ids=lambda r: r.name)
def test_native_rules_agree_with_python(spark, rule):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    got = {(r["doc_id"], r["start"], r["end"], r["text"]) for r in detect.rule_findings(df, rule, "doc_id").collect()}
    want = {(i, s["start"], s["end"], s["text"]) for i, t in enumerate(TEXTS) for s in scan.structured(t or "") if s["rule"] == rule.name}
    assert got == want


def test_native_merge_agrees_with_python(spark):
    from hushlake.functions import core

    df = detect.detect(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string"))
    got = sorted((r["doc_id"], r["start"], r["end"], r["entity_type"]) for r in detect.findings(merge.merge(df), "entities", "doc_id").collect())
    assert got == sorted((i, s["start"], s["end"], s["entity_type"]) for i, t in enumerate(TEXTS) for s in core.merge(scan.scan(t or "")))


def test_mask(spark):
    row = spark.createDataFrame([("  ab ", "Jan de Vries", "")], "a string, b string, c string").select(*[spans.mask_preview(F.col(c)).alias(c) for c in "abc"]).first()
    assert tuple(row) == ("••", "J••••••••••s", "••••")


def test_null_is_invalid(spark):
    row = spark.range(1).select(*[v(F.lit(None).cast("string")).alias(k) for k, v in validators.VALIDATORS.items()]).first()
    assert not any(row)


def test_prepare_and_restore(spark):
    df = spark.createDataFrame([(1, "mail jan@example.com twice jan@example.com"), (2, None), (3, "fine")], "doc_id int, text string")
    p = prepare.prepare(df)
    rows = {r["doc_id"]: r for r in prepare.restore(p).collect()}
    assert rows[1]["safe_text"] == "mail [EMAIL_1] twice [EMAIL_1]" and rows[1]["restored"] == df.filter("doc_id = 1").first()["text"]
    assert rows[2]["status"] == "blocked" and rows[3]["outcome"] == "ALLOW"
    assert prepare.output_faults(p).count() == 0


def test_greedy_matching(spark):
    e = spark.createDataFrame([(1, 0, 5, "a"), (1, 10, 15, "a"), (2, 0, 3, "b")], "doc_id int, start int, end int, label string")
    p = spark.createDataFrame([(1, 0, 5, "a"), (1, 4, 12, "a"), (2, 1, 3, "c")], "doc_id int, start int, end int, label string")
    assert {tuple(r) for r in evaluate.relaxed_counts(e, p).collect()} == {(1, 2, 0, 0), (2, 0, 1, 1)}
    assert {tuple(r) for r in evaluate.relaxed_counts(e, p, same_label=False).collect()} == {(1, 2, 0, 0), (2, 1, 0, 0)}


def test_recall_interval_resamples_documents(spark, tmp_path):
    from hushlake.plans import catalog

    n = 1500  # alike modulo 500: resampling residue classes would widen the interval by the root of 3
    hit = [i % 500 % 2 == 0 for i in range(n)]
    rows = [(i, 1, 1.0, "A", "O", 1, 1 if hit[i] else 7) for i in range(n)]
    df = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string, l_partkey long, l_suppkey long")
    df.write.parquet(str(tmp_path / "lineitem.parquet"))
    low, high = catalog.QUERIES["recall_interval"](spark, str(tmp_path)).first()
    draws = np.sort(np.random.default_rng(22).choice(np.array(hit, float), (1000, n)).mean(1))
    assert abs(low - draws[24]) < 0.006 and abs(high - draws[974]) < 0.006


def test_bootstrap_weights_of_few_and_no_documents(spark):
    schema = "doc_id string, tp long, fn long"
    assert tuple(evaluate.bootstrap_recall(spark.createDataFrame([], schema)).first()) == (None, None)
    assert tuple(evaluate.bootstrap_recall(spark.createDataFrame([("a", 3, 1), ("b", 0, 0)], schema)).first()) == (0.75, 0.75)


def test_simhash_and_near_pairs(spark):
    """Against all pairs: one word of many changed leaves SimHashes close; equal texts and one split don't pair."""
    from difflib import SequenceMatcher

    base = [f"word{i}" for i in range(400)]
    rows = [(0, " ".join(base), "a"), (1, " ".join(base), "b"), (2, "something else entirely here", "b")]
    rows += [(3 + i, " ".join([*base[: 20 * i], "changed", *base[20 * i + 1 :]]), "ab"[i % 2]) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, split string")
    h = {r["doc_id"]: r["simhash"] for r in integrity.simhash(df).collect()}
    assert h[0] == h[1] != h[2]
    near = lambda a, b: a[2] != b[2] and a[1] != b[1] and bin((h[a[0]] ^ h[b[0]]) % 2**64).count("1") <= 2 and SequenceMatcher(None, a[1], b[1], autojunk=False).ratio() >= 0.85
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and near(a, b)}
    assert want
    assert {tuple(r) for r in integrity.near_pairs(df, "split").select("left_id", "right_id").collect()} == want


def test_language(spark):
    df = spark.createDataFrame([("this is from the office",), ("het is een brief van mijn",), ("bonjour",)], "text string")
    assert [r[0] for r in df.select(language.detected(F.col("text"))).collect()] == ["en", "nl", None]


def test_payloads(spark):
    rows = [(json.dumps({"a": ["mail jan@example.com", 1, None]}),), ("not json",), (json.dumps(["password: hunter2hunter"]),)]
    out = conversations.sanitise_payloads(spark.createDataFrame(rows, "payload string")).collect()
    assert [r["outcome"] for r in out] == ["PSEUDONYMIZED", "BLOCK", "BLOCK"] and json.loads(out[0]["safe_payload"]) == {"a": ["mail [EMAIL_1]", 1, None]}


def test_generator_is_deterministic_and_offsets_hold(spark):
    """Every span's text stands at its place, in code points, whatever the transformation did to the values."""
    a, b = (sorted(generate.samples(spark, 630).collect()) for _ in range(2))
    assert a == b and {r["transformation"] for r in a} == set(generate.TRANSFORMATIONS) and len({r["template_group"] for r in a if r["entities"]}) == 36
    for r in a:
        assert all(r["text"][e["start"] : e["end"]] == e["text"] for e in r["entities"])
        assert bool(r["entities"]) == r["template_group"].startswith("positive")
        assert r["applied"] == (r["transformation"] != "original")
        if r["transformation"] == "nested-overlap":
            one, _, inner = r["entities"]
            assert (inner["start"], inner["end"], inner["entity_type"]) == (one["start"] + 1, one["end"] - 1, "unknown_sensitive")


def test_generator_keeps_transformations_to_their_kind(spark):
    forms = {"initials": ("person", lambda v: v.endswith(".") and len(v) <= 8), "spaced-iban": ("iban", lambda v: len(v) == 22 and v[4] == " "), "split-phone": ("phone", lambda v: v.count(" - ") == 2), "email-obfuscation": ("email", lambda v: " [at] " in v and "@" not in v), "hyphenation": ("person", lambda v: "-" in v and not any(map(str.isdigit, v)))}
    rows = generate.samples(spark, 420).filter(F.col("transformation").isin(*forms)).collect()
    for r in rows:
        kind, test = forms[r["transformation"]]
        for e in r["entities"]:
            assert test(e["text"]) == (e["entity_type"] == kind), (r["transformation"], e)


def test_generator_with_nulls_repeats_and_nothing(spark):
    rows = generate.samples_of(spark.createDataFrame([(None,), (7,), (7,)], "k int"), "k").collect()
    assert len(rows) == 2 and rows[0] == rows[1]
    assert generate.samples_of(spark.createDataFrame([], "k int"), "k").count() == 0


def test_conll(spark, tmp_path):
    (tmp_path / "x.conll").write_text("# id\nAnna _ _ B-PER\nde _ _ I-PER\nBoer _ _ I-PER\nin _ _ O\nDelft _ _ I-LOC\n\nX _ _ O\n")
    t = corpus.read_conll(spark, str(tmp_path / "x.conll"))
    got = {(r["start"], r["end"], r["entity_type"], r["text"]) for r in corpus.bio_spans(t, ["file", "sentence"]).collect()}
    assert got == {(0, 12, "person", "Anna de Boer"), (16, 21, "location", "Delft")}


def test_fixture_scan_and_vault(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"corpus_version": 1, "fixtures": [{"id": "x", "language": "en", "input": "hi"}]}))
    assert corpus.read_fixtures(spark, str(tmp_path)).first()["id"] == "x"
    (tmp_path / "b.json").write_text(json.dumps({"corpus_version": 2, "fixtures": []}))
    with pytest.raises(corpus.CorpusError):
        corpus.read_fixtures(spark, str(tmp_path))
    m = spark.range(1).select(F.create_map(F.lit("[EMAIL_1]"), F.lit("a@b.c")).alias("m"))
    key = F.lit("0123456789abcdef")
    row = m.select(corpus.sealed(F.col("m"), key).alias("c")).select(corpus.opened(F.col("c"), key).alias("m"), corpus.opened(F.col("c"), F.lit("fedcba9876543210")).alias("n")).first()
    assert row["m"] == {"[EMAIL_1]": "a@b.c"} and row["n"] is None


def test_safe_copy_never_overwrites(spark, tmp_path):
    p = prepare.prepare(spark.createDataFrame([("fine",), ("password: hunter2hunter",)], "text string"))
    corpus.write_safe_copy(p, str(tmp_path / "out"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["fine"]
    with pytest.raises(Exception, match="exists"):
        corpus.write_safe_copy(p, str(tmp_path / "out"))


def test_model_spans_take_whole_names_and_map_back():
    from hushlake.operators import ner

    text = "met de heer van den Berg's hond; the public company Acme; Acme&amp;Co"
    at = text.index("Berg")
    assert ner.person_bounds(text, at, at + 4) == (text.index("van den"), at + 4)
    model = ner.lexicon({"Acme": "ORG", "Berg": "PER", "hond": "THING"})()
    assert [(s[2], s[3]) for s in ner.spans(text, model)] == [("van den Berg", "person"), ("Acme", "organization")]
    twice = lambda t: [(0, 3, "LOC", 0.5), (0, 3, "GPE", 0.9), (0, 3, "LOC", 0.7)]
    assert ner.spans("Ede", twice) == [(0, 3, "Ede", "location", 0.9, "model:GPE")]


def test_manifest_tells_files_by_their_path(spark, tmp_path):
    import hashlib

    from hushlake.sources.corpus import verify_manifest

    given = {"a/x.json": b"1", "b/x.json": b"2", "c.json": b"3", "manifest.json": b"{}", "extra.json": b"4"}
    for name, content in given.items():
        f = tmp_path / "corpus" / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(content)
    sha = {n: hashlib.sha256(c).hexdigest() for n, c in given.items()}
    rows = [("a/x.json", sha["a/x.json"]), ("b/x.json", sha["a/x.json"]), ("c.json", sha["c.json"]), ("gone.json", "0"), ("../up.json", "0")]
    got = verify_manifest(spark, str(tmp_path / "corpus"), spark.createDataFrame(rows, "path string, sha256 string"))
    assert {(r["path"], r["fault"]) for r in got.collect()} == {("b/x.json", "changed"), ("gone.json", "missing"), ("../up.json", "outside"), ("extra.json", "unlisted")}
