"""The training-data operators on small tables against brute force; nulls, empty tables, ties, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hushlake.llm import ann, html_text, jaccard_join, language_id, line_dedup, mphf, packing, pieces, substring_dedup, topk, toxicity
from hushlake.llm.components import components

public_tokenizers = pytest.importorskip("public_tokenizers")
BPE, SPM = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SPACE = " \t\n\x0b\x0c\r"


def docs(spark, texts, extra=False):
    rows = [(i, t, 7) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines int")
    return df if extra else df.drop("n_lines")


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(words, k=70))
    base = [" ".join(rng.choices(words, k=rng.randint(1, 160))) for _ in range(n)]
    out = []
    for i, t in enumerate(base):
        out.append(t if i % 7 else t + " " + passage)
        if i % 5 == 0:
            w = t.split()
            for _ in range(max(1, len(w) // 60)):
                w[rng.randrange(len(w))] = "changed"
            out.append(" ".join(w))
    return [*out, base[3], base[3].upper(), "", "  ", None, "one", "a b c"]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_mphf():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64))
    m = mphf.Mphf(*mphf.build(keys))
    assert sorted(m.find(keys).tolist()) == list(range(len(keys)))


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_line_dedup(spark, limit):
    texts = [f"own {i}\n  Shared Line\t\n\nx{i % 3}" for i in range(12)] + [None, "", "shared line\nshared line"]
    key = lambda x: x.strip(SPACE).translate({c: c + 32 for c in range(65, 91)})
    seen = {}
    for i, t in enumerate(texts):
        for k in {key(x) for x in (t or "").split("\n")}:
            seen.setdefault(k, set()).add(i)
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs(spark, texts, True), 10, 1, limit).collect()}
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or len(seen[key(x)]) < 10]
        assert (got[i]["text"], got[i]["n_lines"], got[i]["n_dropped"]) == ("\n".join(kept), len(lines), len(lines) - len(kept))
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0


def test_substring_dedup(spark):
    texts = corpus(2)
    first = {}
    for i, t in enumerate(texts):
        w = words(t)
        for p in range(len(w) - 49):
            first.setdefault(tuple(w[p : p + 50]), i)
    got = {r["doc_id"]: r for r in substring_dedup.dedup_substrings(docs(spark, texts)).collect()}
    removed = 0
    for i, t in enumerate(texts):
        w = words(t)
        gone = {q for p in range(len(w) - 49) if first[tuple(w[p : p + 50])] < i for q in range(p, p + 50)}
        removed += len(gone)
        assert (got[i]["text"], got[i]["n_words"], got[i]["n_removed"]) == (" ".join(x for q, x in enumerate(w) if q not in gone), len(w), len(gone))
    assert removed > 100 and substring_dedup.dedup_substrings(docs(spark, [])).count() == 0


def test_substring_dedup_of_rows_sharing_an_id(spark):
    rng = random.Random(23)
    own = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    a, b = own(80), own(60)
    rows = [(1, a), (2, a), (2, own(20) + a[10:70] + own(20)), (2, own(90)), (2, own(5)), (3, own(30) + b), (3, b + own(40)), (4, own(10) + b), (4, own(10) + b), (4, b), (5, own(60)), (5, a)]
    # 4 comes twice outright
    rows[8] = rows[7]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    want = []
    for i, w in rows:
        seen = {tuple(o[p : p + 50]) for j, o in rows if j < i for p in range(len(o) - 49)}
        gone = {q for p in range(len(w) - 49) if tuple(w[p : p + 50]) in seen for q in range(p, p + 50)}
        want.append((i, " ".join(x for q, x in enumerate(w) if q not in gone), len(w), len(gone)))
    assert sorted(tuple(r) for r in substring_dedup.dedup_substrings(df).select("doc_id", "text", "n_words", "n_removed").collect()) == sorted(want)


@pytest.mark.parametrize("k, num", [(4, 85), (5, 80)])
def test_jaccard_join(spark, k, num):
    texts = corpus(3)
    sets = []
    for t in texts:
        w = words((t or "").lower())
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(texts)))
    for _ in texts:
        for a in range(len(texts)):
            for b in range(a):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(docs(spark, texts), k, num, 100).collect()}
    assert got == {i: (len(s), root[i]) for i, s in enumerate(sets)} and len(set(root)) < len(root)


def test_group_keys_meet_all_linked_pairs():
    rule, rng = jaccard_join.Rule(4, 85, 100), np.random.default_rng(4)
    met = 0
    for _ in range(300):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        cut = int(rng.integers(0, max(1, n // 12) + 1))
        b = np.unique(np.concatenate([a[cut:], rng.integers(0, 2**63, cut).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= 85 * (len(a) + len(b) - both):
            (ka, na), (kb, nb) = rule.keys(a), rule.keys(b)
            low = (1 << jaccard_join.BAND_BITS) - 1
            common = np.intersect1d(ka, kb).astype(np.int64) & low
            need = [{int(x) & low: int(x) >> jaccard_join.BAND_BITS for x in v} for v in (na, nb)]
            assert any((common == band).sum() >= max(need[0][band], need[1][band]) for band in set(need[0]) & set(need[1]))
            met += 1
    assert met > 100


@pytest.mark.parametrize("groupings", [jaccard_join.GROUPINGS, 0])
def test_no_key_is_shared_by_unrelated_sets(monkeypatch, groupings):
    """Keys are contents: sets with nothing in common share none, however many of their groups are empty."""
    monkeypatch.setattr(jaccard_join, "GROUPINGS", groupings)
    rule, rng, seen, sparse = jaccard_join.Rule(5, 80, 100), np.random.default_rng(6), {}, 0
    for i in range(2000):
        keys, needs = rule.keys(np.unique(rng.integers(0, 2**63, int(rng.integers(1, 120))).astype(np.uint64)))
        sparse += len(needs) > len({int(x) % (1 << jaccard_join.BAND_BITS) // (groupings + 1) for x in needs})
        for k in set(keys.tolist()):
            assert seen.setdefault(k, i) == i
    assert sparse > 100 or not groupings


@pytest.mark.parametrize("groupings", [0, 1, 2])
def test_sparse_sets_meet_by_other_groupings_and_prefixes(monkeypatch, groupings):
    monkeypatch.setattr(jaccard_join, "GROUPINGS", groupings)
    rule, rng, low, met = jaccard_join.Rule(5, 80, 100), np.random.default_rng(7), (1 << jaccard_join.BAND_BITS) - 1, 0
    for _ in range(500):
        a = np.unique(rng.integers(0, 2**63, int(rng.integers(8, 100))).astype(np.uint64))
        cut = int(len(a) * 0.1)
        b = np.unique(np.concatenate([a[cut:], rng.integers(0, 2**63, cut).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 80 * (len(a) + len(b) - both):
            (ka, na), (kb, nb) = rule.keys(a), rule.keys(b)
            common = np.intersect1d(ka, kb).astype(np.int64) & low
            need = [{int(x) & low: int(x) >> jaccard_join.BAND_BITS for x in v} for v in (na, nb)]
            assert any((common == code).sum() >= max(need[0][code], need[1][code]) for code in set(need[0]) & set(need[1]))
            met += 1
    assert met > 200


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 50), (100, 101)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 21)} | {100: 50, 101: 50}


def test_best_fit_plan():
    rng = random.Random(5)
    for _ in range(60):
        room = rng.choice([5, 64, 1024])
        counts = {rng.randint(1, room): rng.randint(1, 40) for _ in range(20)}
        ranks, sequences = {}, {}
        for length, rank, number, first, offset in packing.best_fit(counts, room):
            for i in range(number):
                ranks.setdefault(length, []).append(rank + i)
                sequences.setdefault(first + i, []).append((offset, length))
        assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items()}
        for s in sequences.values():
            at = 0
            for offset, length in sorted(s):
                assert offset == at
                at += length
            assert at <= room


def test_packing(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BPE)
    texts = [*corpus(6), "x  y\n\nz ", "it's odd\tspacing \n here", "<|endoftext|> y"]
    rows = packing.pack(docs(spark, texts), BPE, 64, 2, with_ids=True).collect()
    for i, t in enumerate(texts):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [x for r in own for x in np.frombuffer(bytes(r["ids"]), "<u4").tolist()] == ids
        assert all(r["ids_crc32"] == zlib.crc32(bytes(r["ids"])) for r in own) and [r["length"] for r in own[1:]] == [64] * (len(own) - 1)
    for s in {r["sequence_id"] for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64


def test_pieces(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=SPM)
    rng = random.Random(7)
    texts = ["".join(rng.choices([" ", "  ", "\n", "a", "the", "ing", "été", "日本", "🙂", "1", "..", "ß", "word", "\t"], k=rng.randint(0, 14))) for _ in range(400)] + [None]
    both = pieces.decode_pieces(pieces.encode_pieces(docs(spark, texts), SPM), SPM).collect()
    for r in both:
        t = texts[r["doc_id"]] or ""
        assert np.frombuffer(bytes(r["piece_ids"]), "<u4").tolist() == sp.encode(t) and r["decoded"] == t


def vectors(spark, seed=8, n=700):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, 8)).astype(np.float32)
    m[10:40] = m[10]
    rows = [(i, m[i].tolist()) for i in range(n)] + [(5000, None), (5050, [0.0] * 8), (5100, [float("nan")] * 8), (5001, [1.0, None] + [0.0] * 6)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>"), m.astype(np.float64)


def test_exact_top_k(spark):
    df, m = vectors(spark)
    w = np.floor(256 * np.vstack([m, np.zeros((1, 8))]))
    ids = [*range(len(m)), 5050]
    got = {}
    for r in topk.exact_top_k(df).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q, row in [(i, i) for i in range(0, len(m), 50)] + [(5050, len(m))]:
        s = w @ w[row]
        best = sorted(((-int(s[j]), ids[j]) for j in range(len(ids)) if ids[j] != q))[:5]
        assert sorted(got[q]) == [(k + 1, v, -x) for k, (x, v) in enumerate(best)]


def test_ann_recall_and_scores(spark):
    df, m = vectors(spark)
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    got, hit, total = {}, 0, 0
    for r in ann.search(df).collect():
        got.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    assert set(got) == set(range(0, len(m), 50))
    for q, found in got.items():
        s = u @ u[q]
        s[q] = -2
        best = np.lexsort((np.arange(len(s)), -s.round(12)))[:5]
        hit, total = hit + len(set(best.tolist()) & set(found)), total + 5
        assert all(abs(s[v] - x) < 1e-12 for v, x in found.items())
    assert hit / total >= 0.9


def test_ann_finds_all_nearest_among_near_copies(spark):
    rng = np.random.default_rng(21)
    m = rng.normal(size=(6000, 16))
    m[::2] = m[0] + rng.normal(0, 0.02, (3000, 16))
    df = spark.createDataFrame([(i, m[i].tolist()) for i in range(len(m))], "vec_id long, embedding array<double>").repartition(1)
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    got = {}
    for r in ann.search(df, every=25).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    assert set(got) == set(range(0, len(m), 25))
    for q, found in got.items():
        s = u @ u[q]
        s[q] = -2
        assert [found[k] for k in range(1, 6)] == np.argsort(-s)[:5].tolist()


def test_language_id(spark):
    rng = random.Random(9)
    lex = {"xx": "ab ba aab bba abab", "yy": "cd dc ccd ddc cdcd"}
    rows = [(i, " ".join(rng.choices(lex[k].split(), k=30)), k) for i, k in enumerate(["xx", "yy"] * 30)]
    df = spark.createDataFrame([*rows, (99, None, "xx"), (98, "12 34", None), (97, "", "yy")], "doc_id long, text string, lang string")
    field = language_id.fit(language_id.training_samples(df.filter("doc_id < 40")), sequences=400, epochs=2)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(df.drop("lang"), field).collect()}
    assert all(got[i][0] == k for i, _, k in rows) and all(got[i] == ("und", 0.0) for i in (97, 98, 99))
    mixed = field.messages(field.emissions(["abab", "bba", "cdcd", "ddc"])[None], np.array([4]))[-1][0]
    assert mixed.argmax(1).tolist() == [0, 0, 1, 1]


def test_toxicity_scores_misspellings():
    rng = random.Random(10)
    plain = [f"{a}{b}" for a in ("ta", "mo", "li", "ru") for b in ("na", "so", "ke", "pi", "wo")]
    texts = [" ".join([*rng.choices(plain, k=40), *(["horrible", "rotten"] if i % 2 else [])]) for i in range(300)]
    model = toxicity.fit(texts, [i % 2 for i in range(300)])
    s = toxicity.Scorer(*model)
    clean, bad, misspelt, empty = s.score([" ".join(plain * 2), " ".join([*plain * 2, "horrible", "rotten"]), " ".join([*plain * 2, "horribble", "r0tten", "horribly"]), ""])
    assert clean < 0.5 < bad and clean < misspelt and 0 <= empty <= 1


def test_toxicity_scores_are_those_of_the_formula(spark):
    """Every score against a sum over words, one at a time: null, empty, repeated, long texts, a clashing column."""
    weights, bias = toxicity.fit(["a calm day for all", "you vile lout, begone"] * 60, [0, 1] * 60)

    def plainly(text):
        words = [w for w in map(toxicity.plain, (text or "").split()) if w]
        total, size = 0.0, 0.0
        for w, n in Counter(words).items():
            ids, _ = toxicity.bags([w], toxicity.SIZES, toxicity.BUCKETS)
            total += n**0.5 * float(weights[ids].astype(float).mean())
            size += n**0.5
        return 1 / (1 + np.exp(-np.clip(total / (size + toxicity.PAD) + bias, -60, 60)))

    rows = [(1, None), (2, ""), (3, "... !"), (4, "vile lout"), (4, "vile lout"), (5, "a calm day " * 3000), (6, "begone, v!le louts")]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, Score string")
    got = sorted((r["doc_id"], r["score"]) for r in toxicity.score_toxicity(df, (weights, bias)).collect())
    assert [i for i, _ in got] == [i for i, _ in rows]
    assert np.allclose([x for _, x in got], [plainly(t) for _, t in rows], atol=1e-6)
    assert toxicity.score_toxicity(df.limit(0), (weights, bias)).collect() == []


def test_html_text(spark):
    w = np.array(html_text.fitted_weights())
    page = '<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/">Home</a></li><li><a>News</a></li></ul></nav><div class="ad">buy now please do</div><article><h1>Head &amp; line</h1><p>First <b>bo</b>ld words here.<br>After break<p>Second paragraph, longer than that.</p><div class="notice">accept this</div><p>Third one ends it.</p></article><section class="comments"><p>I think so too</p></section><form><label>Name</label></form><footer>&copy; us</footer></body></html>'
    want = "Head & line First bold words here. After break Second paragraph, longer than that. Third one ends it."
    df = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "<p>only words stand here"), (5, "<nav><a>x</a></nav>"), (6, "<article><p>cut off &am")], "page_id long, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(df).collect()}
    assert got == {1: want, 2: "", 3: "", 4: "only words stand here", 5: "", 6: "cut off &am"} and w[0] > 0 and (w[5:] < 0).all()


@pytest.mark.parametrize("gap", ['<svg class="i"/>', "<math />", "<object data='x'>", "<select>", "<noscript>", "<svg><g/><svg></svg><text>drawn</text></svg>", "<select><option>one</select>", "<object><b>old</b></object>"])
@pytest.mark.parametrize("later", ["", "<svg><text>drawn</text></svg><object><p>old</p></object><select><option>one</option></select>"])
def test_html_text_keeps_what_follows_a_skipped_element(gap, later):
    page = f"<html><body><article><p>First part of the article here.{gap} Second part goes on.</p>{later}<p>Third part ends it all.</p></article></body></html>"
    assert html_text.Page(page).extract(np.array(html_text.fitted_weights())).split() == "First part of the article here. Second part goes on. Third part ends it all.".split()


def test_pipeline_stages(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    texts = [f"{t}" for t in corpus(11) if t]
    df = spark.createDataFrame([(i, t, "xx", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    out = df
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, out, str(tmp_path))
        assert out.columns == df.columns, name
    ids = [r["doc_id"] for r in out.collect()]
    assert len(ids) == len(set(ids)) and 0 < len(ids) < len(texts)


def pipeline_corpus():
    rng = random.Random(24)
    word = lambda lang: "".join(rng.choices("abe" if lang == "xx" else "cdo", k=rng.randint(4, 7)))
    lines = lambda lang, n: [" ".join(word(lang) for _ in range(20)) for _ in range(n)]
    rows = [(lang, lines(lang, rng.randint(3, 6))) for lang in ["xx", "yy"] * 15]
    often, seldom, passage = lines("xx", 1)[0], lines("yy", 1)[0], lines("xx", 3)
    for i in range(0, 20, 2):
        rows[i][1].insert(1, f"  {often.upper() if i % 4 else often} ")
    for i in range(1, 19, 2):
        rows[i][1].insert(1, seldom)
    for i in (20, 22, 26):
        rows[i][1].extend(passage)
    near = [[*x[:-1], " ".join([*x[-1].split()[:-1], "changed"])] for _, x in rows[6:10]]
    other = [[*x[:2], *lines(k, 2)] for k, x in rows[10:14]]
    rows += [(None, x) for x in near + other] + [("xx", [often]), ("xx", [often, "", "  "]), ("xx", lines("xx", 100)), (None, lines("yy", 3)), (None, lines("yy", 3)), (None, lines("xx", 4) + lines("yy", 2)), (None, passage)]
    rows += [("xx", ["12 34", "5"]), ("yy", [""]), ("xx", ["abba"]), ("yy", ["codo  docco"])]
    return [(i, "\n".join(x), lang) for i, (lang, x) in enumerate(rows)] + [(len(rows), None, "xx")]


def brute_stages(rows):
    """doc_id -> (text, lang) after each of the first four stages."""
    kept = {}
    for i, t, _ in rows:
        if re.search(r"[a-zA-Z]", t or ""):
            kept[i] = (t, "xx" if sum(c in "abeABE" for c in t) > sum(c in "cdoCDO" for c in t) else "yy")
    yield kept
    key = lambda x: x.strip(SPACE).translate({c: c + 32 for c in range(65, 91)})
    seen = {}
    for i, (t, _) in kept.items():
        for k in {key(x) for x in t.split("\n")}:
            seen.setdefault(k, set()).add(i)
    left = {i: ([x for x in t.split("\n") if not key(x) or len(seen[key(x)]) < 10], lang) for i, (t, lang) in kept.items()}
    kept = {i: ("\n".join(x), lang) for i, (x, lang) in left.items() if x and "\n".join(x).strip(" ")}
    yield kept
    sets = {}
    for i, (t, _) in kept.items():
        w = words(t.lower())
        sets[i] = {tuple(w[p : p + 5]) for p in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
        if all(root[root[i]] == root[i] for i in root):
            break
    kept = {i: x for i, x in kept.items() if root[i] == i}
    yield kept
    first = {}
    for i, (t, _) in sorted(kept.items()):
        w = words(t)
        for p in range(len(w) - 49):
            first.setdefault(tuple(w[p : p + 50]), i)
    out = {}
    for i, (t, lang) in kept.items():
        w = words(t)
        gone = {q for p in range(len(w) - 49) if first[tuple(w[p : p + 50])] < i for q in range(p, p + 50)}
        if len(gone) < len(w):
            out[i] = (" ".join(x for q, x in enumerate(w) if q not in gone) if gone else t, lang)
    yield out


def test_pipeline_run_against_brute_force(spark, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = pipeline_corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, lang, "s", -1) for i, t, lang in rows], schema).write.parquet(str(tmp_path / "documents.parquet"))
    stages, written = [], corpus_pipeline.written
    monkeypatch.setattr(corpus_pipeline, "written", lambda df: stages.append(written(df)) or stages[-1])
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    sizes = [len(rows)]
    for (name, _), got, want in zip(corpus_pipeline.STAGES, stages, brute_stages(rows), strict=False):
        assert sorted(tuple(r) for r in got.collect()) == sorted((i, t, lang, "s", len(t)) for i, (t, lang) in want.items()), name
        sizes.append(len(want))
    assert len(sizes) == 5 and all(a > b for a, b in zip(sizes, sizes[1:], strict=False))
    tok, pieces_ = Tokenizer.from_file(BPE), {}
    for i, (t, _) in want.items():
        ids = [*tok.encode(t, add_special_tokens=False).ids, 2]
        cuts = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]  # the first piece takes what is left over
        pieces_ |= {(i, n): ids[a:b] for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))}
    assert {(r["doc_id"], r["piece"]): (r["length"], r["ids_crc32"]) for r in packed} == {k: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for k, x in pieces_.items()} and len(packed) == len(pieces_)
    rooms = []
    for n in sorted(map(len, pieces_.values()), reverse=True):
        fit = min((r for r in rooms if r >= n), default=None)
        if fit is not None:
            rooms.remove(fit)
        rooms.append((1024 if fit is None else fit) - n)
    full = {}
    for r in sorted(packed, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == full.get(r["sequence_id"], 0)
        full[r["sequence_id"]] = r["offset"] + r["length"]
    assert sorted(full.values()) == sorted(1024 - r for r in rooms)


def test_sha_of_kept_text_is_utf8(spark):
    row = docs(spark, ["é"]).select(F.sha2("text", 256)).first()[0]
    assert row == hashlib.sha256("é".encode()).hexdigest()


def test_r_tree_finds_what_its_bound_allows():
    rule, rng = jaccard_join.Rule(4, 85, 100), np.random.default_rng(14)
    sets = []
    for i in range(300):
        base = np.unique(np.random.default_rng(i // 10).integers(0, 2**63, (30, 300, 6000, 9000)[i % 100 // 25] + i).astype(np.uint64) * np.uint64(2))
        sets.append(np.unique(np.concatenate([base[rng.random(len(base)) > 0.04 * (i % 5)], rng.integers(0, 2**63, len(base) // 30).astype(np.uint64)])))
    own = jaccard_join.Points([rule.counts(x) for x in sets], np.array([len(x) for x in sets]))
    q, p = jaccard_join.RTree(own, np.arange(100, 300)).search(np.arange(150), rule)
    over = np.bitwise_count(own.bits[:150, None] & own.bits[None]).sum(2, dtype=np.int64) + np.minimum(own.over[:150, None], own.over[None])
    want = [(i, j) for i, j in np.argwhere(rule.enough(over, own.n[:150, None] + own.n[None])).tolist() if j >= 100]
    assert sorted(zip(q.tolist(), p.tolist(), strict=True)) == sorted(want) and len(want) > 100
    for i in range(0, 150, 3):
        for j in range(i):
            if rule.enough(len(np.intersect1d(sets[i], sets[j])), len(sets[i]) + len(sets[j])):
                assert rule.enough(over[i, j], own.n[i] + own.n[j])


PROSE = "Second thoughts came to the council late in the week, and they changed what had been settled before by all of its members."


@pytest.mark.parametrize(
    "page",
    [
        '<article class="post-12 type-post category-privacy tag-social"><p>{}</p><p>{}</p></article>',
        '<body><nav><ul><li><a href="/">Home</a></li></ul></nav><article class="tag-search"><p>{}</p><p>{}</p></article></body>',
        '<body><div id="legal-news"><p>{}</p><p>{}</p></div></body>',
        '<body><article><p class="notice">Office closed<p>{}<p>{}</article></body>',
        '<body><article><ul><li class="share">Share this<li>{}<li>{}</ul></article></body>',
        '<body><article><p>{}</p><div class="cookie-consent-box">We use cookies</div><p>{}</p></article><div class="site-footer">All rights</div></body>',
        '<body><article><p>{}<div class="ad-slot">Buy now</div><p>{}</article><section class="comments-area"><p>First!</p></section></body>',
    ],
)
def test_article_text_is_kept(page):
    assert html_text.Page(page.format(PROSE, PROSE[::-1].title())).extract(np.array(html_text.fitted_weights())) == f"{PROSE} {PROSE[::-1].title()}"


FRAME = "<body><nav><ul><li><a href='/'>Home</a></li></ul></nav>{}<footer>All rights</footer></body>"


@pytest.mark.parametrize(
    "page",
    [
        '<div class="content-with-sidebar">{}</div>', '<div class="site nav-fixed">{}</div>', '<div class="container header-fixed"><article>{}</article></div>', '<div class="layout sidebar-right"><article>{}</article></div>',
        '<section class="social-issues">{}</section>', '<form id="aspnet"><div class="post">{}</div></form>', '<form><main>{}</main></form>', '<div class="sidebar-left"><article class="tag-cookies">{}</article></div>',
        '<main><div class="share">Tell others</div>{}</main>', '<article>{}</article><aside><article><p>By the by, more of it is said here.</p></article></aside>',
    ],
)
def test_whole_articles_stay_in_layouts_named_like_parts(page):
    body = f"<h1>Late turn</h1><p>{PROSE}</p><p><a>One</a> <a>Two</a> <a>Three</a></p><p>Bye.</p>"
    got = html_text.Page(FRAME.format(page.format(body))).extract(np.array(html_text.fitted_weights()))
    assert got.startswith(f"Late turn {PROSE}") and "Home" not in got and "rights" not in got and "others" not in got and "said here" not in got
    if "<article" in page or "<main" in page:
        assert got == f"Late turn {PROSE} One Two Three Bye."


@pytest.mark.parametrize("comments", ['<section class="comments"><article class="comment"><p>{}</p></article></section>', '<div id="disqus"><article><p>{}</p></article></div>', '<article class="comment"><p>{}</p></article>'])
def test_second_articles_stay_and_comments_go(comments):
    weights = np.array(html_text.fitted_weights())
    page = f"<article><p>{PROSE}</p></article>{'<br>' * 30}<article><p>{PROSE.upper()}</p></article>" + comments.format("I never. " * 60)
    assert html_text.Page(FRAME.format(page)).extract(weights) == f"{PROSE} {PROSE.upper()}"


def test_html_text_of_odd_rows(spark):
    """Nulls, no rows, repeats, clashing columns, a page past every batch bound: values are compared."""
    long = "<article>" + "".join(f"<p>{PROSE} {i}</p>" for i in range(80_000)) + "</article>"  # about 10 MB
    rows = [(1, None, "x"), (2, "", "x"), (3, f"<article>{PROSE}</article>", "x"), (3, f"<article>{PROSE}</article>", "x"), (4, "<nav>only</nav>", "x"), (5, long, "x"), (6, "no tags at all", None)]
    df = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = sorted((r["page_id"], r["text"]) for r in html_text.extract_text(df).collect())
    whole = " ".join(f"{PROSE} {i}" for i in range(80_000))
    assert got == [(1, ""), (2, ""), (3, PROSE), (3, PROSE), (4, ""), (5, whole), (6, "no tags at all")]
    assert html_text.extract_text(df.limit(0)).collect() == [] and html_text.extract_text(df).columns == ["page_id", "html", "text"]


def test_extraction_agrees_with_labels_of_held_out_pages():
    """Words of pages made by another seed, with the labels they were made from: what is found against what is there."""
    weights, hit, found, there = np.array(html_text.fitted_weights()), 0, 0, 0
    for parts in html_text.labelled_pages(80, seed=99):
        got = html_text.Page("".join(p for _, p in parts)).extract(weights).split()
        want = " ".join(re.sub("<[^>]*>", " ", p) for label, p in parts if label).split()
        hit += sum((Counter(got) & Counter(want)).values())
        found, there = found + len(got), there + len(want)
    assert hit / found > 0.97 and hit / there > 0.99


def test_region_is_the_best_run():
    rng = np.random.default_rng(31)
    for _ in range(200):
        page = html_text.Page("")
        n = int(rng.integers(0, 25))
        page.feats = [(float(x),) for x in rng.integers(-4, 5, n)]
        x = np.array([f[0] for f in page.feats])
        lo, hi = page.region(np.array([1.0]))
        best = max((x[i:j].sum() for i in range(n) for j in range(i + 1, n + 1)), default=0)
        assert (x[lo:hi].sum() == best and hi > lo) if best > 0 else (lo, hi) == (0, 0)


# --- tables with nulls, repeats, clashing names, long texts; empty tables ---

ODD = [None, "", " \t\n", "one", "a b c", "same words twice over here", "same words twice over here", "x" * 5000, "long text " * 4000]


def odd_table(spark, n=len(ODD)):
    rows = [(None if i == 3 else i // 2, ODD[i], "en" if i % 2 else None, i, "clash", 1.5, "c") for i in range(n)]
    return spark.createDataFrame(rows[:n], "doc_id long, text string, lang string, n_lines int, text_ string, score double, component_id string")


def operators(spark):
    field = language_id.fit({"xx": ["ab ba aab bba"], "yy": ["cd dc ccd"]}, sequences=200, epochs=1)
    model = toxicity.fit(["good day", "bad day"] * 40, [0, 1] * 40)
    return {
        "line": lambda d: line_dedup.dedup_lines(d, 2, 1),
        "language": lambda d: language_id.identify(d, field),
        "jaccard": lambda d: jaccard_join.near_duplicates(d),
        "substring": lambda d: substring_dedup.dedup_substrings(d),
        "packing": lambda d: packing.pack(d, BPE, 64, 2),
        "pieces": lambda d: pieces.encode_pieces(d, SPM),
        "toxicity": lambda d: toxicity.score_toxicity(d, model),
    }


@pytest.mark.parametrize("name", ["line", "language", "jaccard", "substring", "packing", "pieces", "toxicity"])
def test_odd_rows_and_no_rows(spark, name):
    run = operators(spark)[name]
    full, none = run(odd_table(spark)), run(odd_table(spark, 0))
    rows = full.collect()
    if name == "packing":
        assert len({(r["doc_id"], r["piece"]) for r in rows}) <= len(rows) and sum(r["piece"] == 0 for r in rows) == len(ODD)
    else:
        assert len(rows) == len(ODD)
    assert none.collect() == [] and none.schema == full.schema


def test_pipeline_stages_keep_odd_rows(spark):
    import corpus_pipeline

    rows = [(i, f"{w} " * 3 + f"only {i} here", "en", "s", 1) for i, w in enumerate(["alpha beta gamma", "delta eps zeta"] * 3)] + [(None, "no number but words in plenty", "en", "s", 1), (7, None, None, "s", None), (8, "", "en", "s", 0)]
    docs_ = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[1:]:
        for d in (docs_, docs_.limit(0), docs_.unionByName(docs_)):
            out = stage(spark, d, "")
            assert name == "best-fit packing" or out.columns == docs_.columns
            assert out.count() >= (0 if d.isEmpty() else 6)


def test_packing_is_as_tight_as_sequential_best_fit(spark):
    import bisect

    rng = random.Random(41)
    texts = [" ".join(rng.choices(["one", "two", "three", "four"], k=rng.randint(1, 62))) for _ in range(300)]
    rows = packing.pack(docs(spark, texts), BPE, 64, 2).collect()
    gaps: list[int] = []
    opened = 0
    for n in sorted((r["length"] for r in rows), reverse=True):
        at = bisect.bisect_left(gaps, n)
        gap = gaps.pop(at) if at < len(gaps) else 64
        opened += gap == 64
        if gap > n:
            bisect.insort(gaps, gap - n)
    assert len({r["sequence_id"] for r in rows}) <= opened


def test_forward_backward_agrees_with_enumeration():
    import itertools

    rng = np.random.default_rng(42)
    field = language_id.Field(["a", "b", "c"])
    field.move, field.start = rng.normal(size=(3, 3)).astype(np.float32), rng.normal(size=3).astype(np.float32)
    for n in (1, 2, 5):
        e = rng.normal(size=(1, n, 3)).astype(np.float32)
        post = field.messages(e, np.array([n]))[-1][0]
        want = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=n):
            w = np.exp(field.start[path[0]] + sum(e[0, t, y] for t, y in enumerate(path)) + sum(field.move[x, y] for x, y in itertools.pairwise(path)))
            for t, y in enumerate(path):
                want[t, y] += w
        assert np.allclose(post, want / want.sum(1, keepdims=True), atol=1e-5)


def test_very_common_window_spans_tasks(spark):
    rng = random.Random(43)
    shared = [f"s{i}" for i in range(60)]
    texts = [" ".join([f"a{rng.random()}" for _ in range(i % 7)] + shared + [f"b{rng.random()}"]) for i in range(400)]
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.dedup_substrings(docs(spark, texts).repartition(9)).collect()}
    assert got == {i: 60 * (i > 0) for i in range(400)}


def test_line_dedup_counts_documents_not_rows(spark):
    rows = [(1, f"common\nown {i}") for i in range(12)] + [(2, "common\nwide")] + [(i, "wide") for i in range(3, 11)] + [(2, "wide"), (None, "wide")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_dropped"]) for r in line_dedup.dedup_lines(df, 10, 1).collect())
    assert got == sorted([(1, 0)] * 12 + [(2, 1), (2, 1), (0, 1)] + [(i, 1) for i in range(3, 11)])


def test_vector_searches_over_many_shards_and_groups(spark, monkeypatch):
    """Shards of few rows and groups of few queries, rows repeated outright, equal vectors, negative ids, extra columns."""
    from hushlake.llm import vectors as shared

    for name, value in (("SHARD_ROWS", 40), ("LEAST_ROWS", 10), ("GROUP_QUERIES", 9), ("SEED_ROWS", 16)):
        monkeypatch.setattr(shared, name, value)
    rng = np.random.default_rng(4)
    m = rng.normal(size=(600, 6))
    m[100:140] = m[100]
    ids = np.arange(-100, 500)
    rows = [(int(i), v.tolist(), 0) for i, v in zip(ids, m, strict=True)]
    df = spark.createDataFrame(rows + rows[100:101] * 9, "vec_id long, embedding array<double>, floor int")
    w, u = np.floor(256 * m), m / np.linalg.norm(m, axis=1, keepdims=True)
    for found, scores in ((topk.exact_top_k(df, every=10, k=4), w @ w.T), (ann.search(df, every=10, k=4), (u @ u.T).round(9))):
        got = {}
        for r in found.collect():
            got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
        assert set(got) == {int(i) for i in ids if i % 10 == 0}
        for q, ranks in got.items():
            order = [int(ids[j]) for j in np.lexsort((ids, -scores[q + 100])) if ids[j] != q][:4]
            assert ranks == dict(enumerate(order, 1)), q


def test_vector_searches_of_empty_and_unusable_tables(spark):
    for rows in ([], [(0, None), (50, []), (100, [float("inf"), 1.0]), (None, [1.0, 2.0])]):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        assert topk.exact_top_k(df).collect() == [] and ann.search(df).collect() == []
    one = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in topk.exact_top_k(one).collect()] == [(0, 1, 1)]
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(one).collect()] == [(0, 1, 1)]


def test_pipeline_keeps_texts_of_many_languages(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(30)
    lex = {f"l{i}": [a + b + a for a in pair for b in pair] for i, pair in enumerate(("ab", "cd", "ef", "gh", "ij"))}
    rows = [(i, " ".join(rng.choices(lex[k], k=40)), k) for i, k in enumerate(list(lex) * 20)]
    mixed = [" ".join(" ".join(rng.choices(lex[k], k=6)) for k in rng.sample(list(lex), 5)) for _ in range(5)]
    rows += [(200 + i, t, None) for i, t in enumerate(mixed)] + [(300, "12 .. 7", None), (301, None, "l0")]
    df = spark.createDataFrame([(*r, "s", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"] for r in corpus_pipeline.language_id(spark, df, "").collect()}
    assert got == {r[0] for r in rows} - {300, 301}
    found = language_id.identify(df, language_id.fit(language_id.training_samples(df))).filter("doc_id BETWEEN 200 AND 250").collect()
    assert all(r["score"] < corpus_pipeline.MIN_SHARE and r["sure"] >= corpus_pipeline.MIN_SURE for r in found)
