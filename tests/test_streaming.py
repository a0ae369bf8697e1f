"""Windowed counts, the vault and the memo of sessions as streams, the keyed store."""

import contextlib
import json

import pytest
from pyspark.sql import functions as F

from hushlake.streaming import memo, vault
from hushlake.streaming.store import KeyedStore
from hushlake.streaming.vault import windowed_counts

GIVEN = json.dumps({"[EMAIL_1]": "a@example.org"})


def test_windowed_counts(spark):
    df = spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'a' AS event_type, 1.0D AS value UNION ALL SELECT timestamp'2024-01-01 00:50:00', 'a', 2.0D UNION ALL SELECT timestamp'2024-01-01 01:00:00', 'a', 3.0D")
    assert sorted((r["n"], r["total"]) for r in windowed_counts(df).collect()) == [(1, 3.0), (2, 3.0)]


@contextlib.contextmanager
def settings(spark, **more):
    own = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false", "spark.sql.shuffle.partitions": "2"} | more
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def streamed(spark, tmp_path, ddl, steps, change, name, **more):
    """Rows of change(stream) over steps, a file a batch: the state outlives batches."""
    for i, rows in enumerate(steps):
        spark.createDataFrame(rows, ddl.replace(" timestamp", " string")).coalesce(1).write.json(str(tmp_path / "in" / f"{i:02}"))
    with settings(spark, **more):
        events = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in" / "*"))
        run = change(events).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        ended = run.awaitTermination(180)
        run.stop()
    assert ended
    return [tuple(r) for r in spark.table(name).collect()]


def test_vault_hands_a_mapping_out_once(spark, tmp_path):
    steps = [
        [("a", "store", GIVEN), ("b", "consume", None), ("c", "store", "not JSON"), ("d", "store", "[1]")],
        [("a", "store", GIVEN), ("c", "consume", None), ("d", "other", None)],
        [("a", "consume", None), ("e", "store", json.dumps({"x": "y" * vault.MAX_BYTES}))],
        [("a", "consume", None), ("a", "store", GIVEN)],
    ]
    got = streamed(spark, tmp_path, "session string, op string, mapping string", steps, vault.vault, "vault_codes")
    assert sorted(got, key=str) == sorted([
        ("a", "store", "stored", None), ("a", "store", "exists", None), ("a", "consume", "ok", GIVEN), ("a", "consume", "consumed", None), ("a", "store", "exists", None),
        ("b", "consume", "unknown", None), ("c", "store", "malformed", None), ("c", "consume", "unknown", None), ("d", "store", "malformed", None), ("d", "other", "malformed", None), ("e", "store", "too_large", None),
    ], key=str)


def test_vault_tells_expired_from_consumed_and_unknown(spark, tmp_path):
    """By the events' time: sessions of an hour; z moves the watermark on, so that timers run without events of their own."""
    at = lambda h, m=0: f"2024-01-01 {h:02}:{m:02}:00"
    steps = [
        [("a", "store", GIVEN, True, at(0)), ("b", "store", GIVEN, True, at(0)), ("c", "store", GIVEN, False, at(0, 40)), ("d", "store", GIVEN, True, at(0, 30)), ("d", "clear", None, True, at(0, 31))],
        [("b", "consume", None, True, at(0, 50)), ("c", "consume", None, True, at(0, 51)), ("c", "consume", None, True, at(0, 52)), ("d", "consume", None, True, at(0, 53))],
        [("z", "other", None, True, at(1, 25))],
        [("z", "other", None, True, at(1, 26)), ("a", "consume", None, True, at(1, 30)), ("b", "consume", None, True, at(1, 31)), ("c", "consume", None, True, at(1, 35))],
        [("c", "consume", None, True, at(1, 45)), ("z", "other", None, True, at(3))],
        [("a", "consume", None, True, at(3, 1)), ("b", "consume", None, True, at(3, 1))],
    ]
    ddl = "session string, op string, mapping string, single boolean, at timestamp"
    got = streamed(spark, tmp_path, ddl, steps, lambda e: vault.vault(e, 3_600_000, "1 minute"), "vault_times", **{"spark.sql.streaming.noDataMicroBatches.enabled": "true"})
    codes = {}
    for session, op, code, _ in got:
        codes.setdefault(session, []).append((op, code))
    assert codes["a"] == [("store", "stored"), ("cleanup", "expired"), ("consume", "expired"), ("consume", "unknown")]
    assert codes["b"] == [("store", "stored"), ("consume", "ok"), ("consume", "consumed"), ("consume", "unknown")]
    assert codes["c"] == [("store", "stored"), ("consume", "ok"), ("consume", "ok"), ("consume", "ok"), ("cleanup", "expired"), ("consume", "expired")]
    assert codes["d"] == [("store", "stored"), ("clear", "cleared"), ("consume", "unknown")]


def test_second_sight_costs_no_detector_call(spark, tmp_path):
    plain, mail = "Nothing of note.", "Mail a.b@example.org"
    steps = [
        [("s", 1, "inspect", plain, None), ("s", 2, "inspect", plain, None), ("t", 1, "inspect", plain, None), ("s", 3, "inspect", mail, None)],
        [("s", 4, "inspect", plain, None), ("s", 5, "inspect", mail, None), ("s", 6, "transform", mail, None), ("s", 7, "request", None, json.dumps({"m": [f"so: {mail}", 1]}))],
        [("s", 8, "request", None, json.dumps({"m": mail})), ("s", 9, "approve", "ping", None), ("s", 10, "request", None, json.dumps(["a ping"])), ("s", 11, "request", None, json.dumps(["a ping"])), ("s", 12, "request", None, "{"), ("s", 13, "other", None, None)],
        [("t", 2, "transform", mail, None), ("t", 3, "request", None, "[]"), ("t", 4, "request", None, json.dumps([mail]))],
    ]
    got = streamed(spark, tmp_path, "session string, seq long, op string, text string, payload string", steps, memo.memo, "memo_outcomes")
    by = {(s, q): (outcome, payload, analysed) for s, q, _, outcome, payload, analysed in got}
    assert [by["s", q] for q in range(1, 6)] == [("ALLOW", None, True), ("ALLOW", None, False), ("PSEUDONYMIZED", None, True), ("ALLOW", None, False), ("PSEUDONYMIZED", None, True)]
    assert by["t", 1] == ("ALLOW", None, True)
    assert by["s", 7] == ("REPLACED", json.dumps({"m": ["so: Mail [EMAIL_1]", 1]}), False)
    assert [by["s", q][0] for q in range(8, 14)] == ["CHECK", "ALLOW", "ALLOW", "CHECK", "BLOCK", "BLOCK"]
    assert [by["t", q][0] for q in (3, 4)] == ["CHECK", "CHECK"]


def pairs(spark, rows):
    return spark.createDataFrame([(i, m, a) for i, m, a in rows], "id string, mapping map<string,string>, at string").withColumn("at", F.col("at").cast("timestamp"))


def test_store_keeps_the_last_version_of_an_id(spark, tmp_path):
    root, key = str(tmp_path / "store"), F.lit("0123456789abcdef")
    store = KeyedStore(spark, root, key)
    assert store.rows().count() == 0 and store.compact() is None
    first = pairs(spark, [("a", {"x": "1"}, "2024-01-01"), ("b", {"x": "2"}, "2024-01-01"), ("a", {"x": "3"}, "2024-01-02"), (None, {"x": "9"}, "2024-01-02")])
    store.upsert(first, 0)
    store.upsert(first, 0)  # again after a failure
    second = pairs(spark, [("b", None, "2024-01-03"), ("c", {"x": "4"}, "2024-01-03")])
    store.upsert(second, 1)
    want = {"a": {"x": "3"}, "c": {"x": "4"}}
    read = lambda s: {r["id"]: r["mapping"] for r in s.mappings().collect()}
    assert read(store) == want
    assert store.rows(0).count() == 2
    assert store.compact() == 1 and store.compact() is None
    assert read(store) == want and not (tmp_path / "store/log/batch=0").exists()
    store.upsert(first, 0)  # a base holds this batch: nothing comes back
    assert read(store) == want
    store.upsert(pairs(spark, [("a", {"x": "5"}, "2024-01-04")]), 2)
    assert read(store) == want | {"a": {"x": "5"}}
    other = KeyedStore(spark, root, F.lit("fedcba9876543210")).mappings().collect()
    assert len(other) == 2 and all(r["mapping"] is None and not r["readable"] for r in other)
    # a base whose writing was cut off doesn't count
    store.rows().write.parquet(f"{root}/base/upto=7")
    (tmp_path / "store/base/upto=7/_SUCCESS").unlink()
    assert read(store) == want | {"a": {"x": "5"}}


def test_store_fed_by_a_stream(spark, tmp_path):
    for i in range(3):
        pairs(spark, [("a", {"x": str(i)}, f"2024-01-0{i + 1}"), (f"k{i}", {"x": "y"}, "2024-01-01")]).coalesce(1).write.json(str(tmp_path / "in" / str(i)))
    store = KeyedStore(spark, str(tmp_path / "store"), F.lit("0123456789abcdef"))
    with settings(spark):
        events = spark.readStream.schema("id string, mapping map<string,string>, at timestamp").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in" / "*"))
        run = events.writeStream.foreachBatch(store.upsert).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert run.awaitTermination(120)
    assert store.rows().count() == 4 and store.compact() == 2 and store.rows().count() == 4


@pytest.mark.parametrize("text,size", [(GIVEN, 22), ("{}", None), ("[1]", None), ('{"a": 1}', None), ('{"": "x"}', None), ("x", None)])
def test_size_of_a_mapping(text, size):
    assert vault._mapping_size(text) == size
