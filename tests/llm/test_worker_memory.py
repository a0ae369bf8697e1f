"""What Python workers hold: nothing of another operator's, and bounded groups of whatever texts come."""

import gc

import numpy as np
import pyarrow as pa

from hushlake.llm import language_id, packing


def _function(spark, monkeypatch, build):
    """The function that build(docs) gives to mapInArrow, to be run here as a worker would."""
    found = []
    docs = spark.createDataFrame([(1, "ab cd")], "doc_id long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema, *a, **b: found.append(f) or self)
    build(docs)
    return found[0]


def _batch(texts):
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])


def test_a_later_operator_finds_no_encoder(spark, monkeypatch):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    field = language_id.fit({"xx": ["ab ba aab bba"], "yy": ["cd dc ccd"]}, sequences=200, epochs=1)
    pack = _function(spark, monkeypatch, lambda d: packing.tokenized_pieces(d, path, 1024, 2))
    tag = _function(spark, monkeypatch, lambda d: language_id.identify(d, field))

    def encoders():
        gc.collect()
        return {id(x) for x in gc.get_objects() if isinstance(x, packing.ChunkEncoder)}

    before = [x.column(3).to_pylist() for x in pack(iter([_batch(["ab cd", ""])]))]
    held = encoders()
    assert [x.column(3).to_pylist() for x in pack(iter([_batch(["ab cd", ""])]))] == before
    assert len(held) == 1 and encoders() == held  # the same operator's tasks make it once
    assert [x.column(2).to_pylist() for x in tag(iter([_batch(["ab ba", "cd dc", None])]))] == [["xx", "yy", "und"]]
    assert not encoders()
    assert [x.column(3).to_pylist() for x in pack(iter([_batch(["ab cd", ""])]))] == before


def test_tagging_is_bounded(spark, monkeypatch):
    """Many new words in one batch come in pieces, and give what each text gives by itself."""
    field = language_id.fit({"xx": ["ab ba aab bba"], "yy": ["cd dc ccd"]}, sequences=200, epochs=1)
    rng = np.random.default_rng(1)
    words = ["".join(w) for w in rng.choice(list("abcdefgh"), (40_000, 7))]
    docs = [" ".join(words[i : i + 4000]) for i in range(0, 40_000, 4000)] + ["", "12 34", "ab", " ".join(words) * 3]
    alone = [language_id.Tagger(field).shares([t])[0] for t in docs]
    tag, sizes = _function(spark, monkeypatch, lambda d: language_id.identify(d, field)), []
    plain = language_id.Field.emissions
    monkeypatch.setattr(language_id.Field, "emissions", lambda self, some: sizes.append(len(some)) or plain(self, some))
    (got,) = tag(iter([_batch(docs)]))
    assert 0 < max(sizes) <= language_id.NEW_WORDS
    for share, lang, score in zip(alone, got.column(2).to_pylist(), got.column(3).to_pylist(), strict=True):
        none = np.isnan(share[0])
        assert lang == ("und" if none else field.labels[share[:-1].argmax()])
        assert abs(score - (0 if none else share[:-1].max())) < 1e-6


def test_groups_hold_every_text():
    some = [b"x" * n for n in (5, 1 << 20, 3, 1 << 18, 1 << 18, 1)] + [b""] * 450
    groups = list(language_id.grouped(some))
    assert [t for g in groups for t in g] == [t.decode() for t in some]
    assert all(len(g) == 1 or len(g) <= language_id.GROUP_ROWS and sum(map(len, g)) <= language_id.GROUP_BYTES for g in groups)
    assert list(language_id.grouped([])) == []
