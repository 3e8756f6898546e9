"""Nested settings, the store on disk, and buffers of streams."""

import json

import pytest

from voxmill.operators import settings
from voxmill.operators.store import Store
from voxmill.streaming import buffers


def _merge(a, b):
    if isinstance(a, dict) and isinstance(b, dict) and a and b:
        return {k: _merge(a[k], b[k]) if k in a and k in b else a.get(k, b.get(k)) for k in {**a, **b}}
    return b


_LAYERS = [
    ({"plan": {"batch": 2, "patch": [1, 2], "net": {"depth": 5, "act": "relu"}}, "fold": "all", "a.b": {"c": None}}, {"plan": {"batch": 4, "net": {"act": {"name": "gelu", "p": 0.5}}}, "fold": {"k": 1}, "a.b": {"c": True, 'q"u': 1}}),
    ({"x": {"y": {"z": 1}}}, {"x": {"y": 3}}),
    ({"x": 1}, {"x": {"y": {"z": 1}}, "empty": {}}),
    ({"only": {"first": [{"a": 1}]}}, None),
    (None, {"only": "second"}),
]


def test_nested_settings_are_merged_by_path(spark):
    tables = [spark.createDataFrame([(k, json.dumps(pair[i])) for k, pair in enumerate(_LAYERS) if pair[i] is not None], "id int, document string") for i in (0, 1)]
    got = {r.id: json.loads(r.document) for r in settings.merge_documents(tables, ["id"]).collect()}
    assert got == {k: b if a is None else a if b is None else _merge(a, b) for k, (a, b) in enumerate(_LAYERS)}
    flat = settings.flattened(tables[0], ["id"])
    assert {(tuple(r.path), r.value) for r in flat.filter("id = 0").collect()} == {(("plan", "batch"), "2"), (("plan", "patch"), "[1,2]"), (("plan", "net", "depth"), "5"), (("plan", "net", "act"), '"relu"'), (("fold",), '"all"'), (("a.b", "c"), "null")}
    assert {tuple(r.path) for r in settings.differing(flat, settings.flattened(tables[1], ["id"]), ["id"]).filter("id = 1").collect()} == {("x", "y"), ("x", "y", "z")}
    empty = tables[0].limit(0)
    assert settings.merge_documents([empty, empty], ["id"]).count() == 0


def _changes(spark, rows):
    return spark.createDataFrame(rows, "key string, value string, ord long, deleted boolean")


def test_a_store_rewrites_only_what_changes(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", 8)
    assert store.read().count() == 0 and store.versions() == []
    assert store.upsert(_changes(spark, [(f"k{i}", str(i), i, False) for i in range(50)] + [("k1", "new", 99, False), ("k2", None, 99, True), (None, "x", 0, False)])) == 1
    want = {f"k{i}": str(i) for i in range(50) if i != 2} | {"k1": "new"}
    assert {r.key: r.value for r in store.read().collect()} == want
    before = store._folders()[1]
    assert store.upsert(_changes(spark, [("k7", "seven", 0, False)])) == 2
    after = store._folders()[1]
    assert sum(before[b] != after[b] for b in before) == 1
    assert {r.key: r.value for r in store.get(spark.createDataFrame([("k7",), ("k8",), ("none",)], "key string")).collect()} == {"k7": "seven", "k8": "8", "none": None}
    assert {r.key: r.value for r in store.read(1).collect()} == want
    assert store.compact() == 3 and store.vacuum() == [3]
    assert {r.key: r.value for r in store.read().collect()} == want | {"k7": "seven"}
    assert len([p for p in (tmp_path / "s/data").rglob("*.parquet")]) == len(store._folders()[1]) <= 8
    with pytest.raises(ValueError, match="8 buckets"):
        Store(spark, f"file://{tmp_path}/s", 4).read()


def test_a_killed_writer_leaves_the_store(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/s", 4)
    store.upsert(_changes(spark, [("a", "1", 0, False), ("b", "2", 0, False)]))

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(Store, "_commit", killed)
        store.upsert(_changes(spark, [("a", "lost", 1, False)]))
    assert {r.key: r.value for r in store.read().collect()} == {"a": "1", "b": "2"}
    version, folders = store._folders()
    store.upsert(_changes(spark, [("a", "first", 1, False)]))
    with pytest.raises(RuntimeError, match="another writer"):
        store._commit(version + 1, folders)
    assert store.vacuum() == [2] and {r.key: r.value for r in store.read().collect()} == {"a": "first", "b": "2"}


def test_runs_are_given_out_once_over_restarts(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kind = "key string, epoch long, ord long, value double, epochs long, minute long"
    parts = [
        [("a", 0, 0, 1.0, 3, 0), ("b", 1, 0, 4.0, 2, 0), ("a", 2, 0, 9.0, None, 0)],
        [("a", 2, 1, 3.0, None, 1), ("b", 1, 1, 6.0, None, 1), ("c", 0, 0, 1.0, 5, 1)],
        [("b", 0, 0, 2.0, None, 1), ("a", 1, 0, 2.0, None, 1), ("a", 0, -1, 50.0, None, 1)],
        [("d", 0, 0, 1.0, 2, 90)],
        [("d", 1, 0, 2.0, 2, 91)],
    ]
    a, b, c, d = {"a": (3, 2.0, 0)}, {"b": (2, 4.0, 0)}, {"c": (5, 1.0, 4)}, {"d": (2, 1.5, 0)}
    source = tmp_path / "in"
    for rows, want in zip(parts, ({}, {}, a | b, a | b | c, a | b | c | d), strict=True):
        spark.createDataFrame(rows, kind).selectExpr("*", "timestamp_seconds(1700000000 + 60 * minute) AS time").coalesce(1).write.mode("append").parquet(str(source))
        log = spark.readStream.schema(kind + ", time timestamp").parquet(str(source))
        query = buffers.whole_runs(log, 3_600_000).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).outputMode("append").trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        assert {r.key: (r.epochs, r.mean, r.missing) for r in spark.read.schema(buffers._OUT).parquet(str(tmp_path / "out")).collect()} == want
