"""Snapshots, imports and streams that are published by manifest."""

import json
import random

import pytest
from pyspark.sql import functions as F

from fieldbook.operators import imports
from fieldbook.operators.keyed import KeyedStore
from fieldbook.plans.imports import IMPORT, SLUGS
from fieldbook.sources.published import Folder, Manifest, shared_folder
from fieldbook.streaming import events

EVENT = "event_id string, cents long, status string, at int"


def deliveries(spark, rows):
    return events.delivered(spark.createDataFrame(rows, EVENT))


def state(store):
    return sorted(tuple(r) for r in store.read().select("event_id", "cents", "status").collect())


def test_keyed_store(spark, tmp_path):
    """Batches in any order and more than once: first amount, last status; only touched buckets are written, old data goes."""
    rnd = random.Random(5)
    rows = [(f"e{rnd.randrange(40)}", rnd.randrange(1000), rnd.choice("abc"), i) for i in range(200)]
    want = {}
    for e, cents, status, i in rows:
        want[e] = (want[e][0] if e in want else cents, status)
    rnd.shuffle(rows)
    store = events.event_store(spark, f"file://{tmp_path}/s", 8)
    with pytest.raises(ValueError):
        store.read()
    for k in range(4):
        part = [r for i, r in enumerate(rows) if i % 4 == k]
        assert store.apply(deliveries(spark, part), k)
        before = store.manifest.current()
        assert store.apply(deliveries(spark, part), k) == [] and store.manifest.current() == before  # the same batch again
    store.apply(deliveries(spark, rows[:50]), 9)  # the same rows under another number
    assert state(store) == sorted((e, *v) for e, v in want.items())
    old = store.manifest.current()
    touched = store.apply(deliveries(spark, [("e1", 0, "z", 999), (None, 7, "n", 1000)]), 10)
    new = store.manifest.current()
    assert 1 <= len(touched) <= 2 and {b for b in new[1]["buckets"] if new[1]["buckets"][b] != old[1]["buckets"].get(b)} == {str(b) for b in touched}
    assert (None, 7, "n") in [tuple(r) for r in store.read().select("event_id", "cents", "status").collect()]
    folder = Folder(spark, f"file://{tmp_path}/s")
    kept = {p for v in store.manifest.versions() for p in store.manifest.get(v)["buckets"].values()}
    there = {f"data/{d}/{b}" for d in folder.names("data") for b in folder.names(f"data/{d}") if b.startswith("_bucket=")}
    assert there == kept and len(store.manifest.versions()) == 2
    assert store.apply(deliveries(spark, []), 11) == [] and store.manifest.current()[1]["batch"] == 11


def test_unpublished_data_changes_nothing(spark, tmp_path):
    """A writer that died before it published: readers see what was, and the batch is done again."""
    path = f"file://{tmp_path}/s"
    store = events.event_store(spark, path, 4)
    store.apply(deliveries(spark, [("a", 1, "x", 1)]), 0)
    spark.range(3).write.parquet(f"{path}/data/{2:012d}/_bucket=0")
    assert state(store) == [("a", 1, "x")]
    store.apply(deliveries(spark, [("a", 5, "y", 2), ("b", 2, "x", 2)]), 1)
    assert state(store) == [("a", 1, "y"), ("b", 2, "x")]
    with pytest.raises(FileExistsError):
        store.manifest.publish(2, {})
    assert events.event_store(spark, path, 99).apply(deliveries(spark, [("c", 3, "x", 3)]), 2)  # the number of buckets stays
    assert len(state(store)) == 3 and Manifest(spark, path).current()[1]["of"] == 4


def test_a_batch_is_shuffled_once(spark, tmp_path):
    """Rows meet by their keys once, for the fold and for the files, and each part of them lies in one bucket."""
    plans = []

    class Spied(KeyedStore):
        def _dealt(self, rows, buckets):
            plans.append((self.fold(super()._dealt(rows, buckets)), super()._dealt(rows, buckets)))
            return super()._dealt(rows, buckets)

    store = Spied(spark, f"file://{tmp_path}/s", ["event_id"], events.fold_events, 4)
    for k in range(2):
        store.apply(deliveries(spark, [(f"e{i}", i, "x", i + k) for i in range(100)]), k)
    assert len(plans) == 2
    for folded, dealt in plans:
        assert folded._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        parts = dealt.select(F.spark_partition_id().alias("part"), F.pmod(F.hash("event_id"), F.lit(4)).alias("bucket")).distinct().collect()
        assert len({r["part"] for r in parts}) == len(parts) and len({r["bucket"] for r in parts}) == 4
    old = store.manifest.current()
    store.manifest.publish(old[0] + 1, {k: v for k, v in old[1].items() if k != "by"} | {"batch": 2, "buckets": {}})  # of a time without `by`
    store.apply(deliveries(spark, [("e1", 1, "x", 1)]), 3)
    assert store.manifest.current()[1]["by"] == "xxhash64" and state(store) == [("e1", 1, "x")]


def test_several_keys(spark, tmp_path):
    fold = lambda rows: rows.groupBy("a", "b").agg(F.max("n").alias("n"))
    store = KeyedStore(spark, f"file://{tmp_path}/s", ["a", "b"], fold, 3)
    for k, rows in enumerate(([(1, "x", 5), (1, None, 1)], [(1, "x", 3), (2, "x", 4), (1, None, 2)])):
        store.apply(spark.createDataFrame(rows, "a int, b string, n int"), k)
    assert sorted(map(str, (tuple(r) for r in store.read().collect()))) == sorted(map(str, [(1, "x", 5), (1, None, 2), (2, "x", 4)]))


def test_upsert_stream(spark, tmp_path):
    """Micro-batches into the snapshot, and a restart that finds nothing new."""
    path = f"file://{tmp_path}"
    for k, rows in enumerate(([("a", 1, "x", 1), ("b", 2, "x", 1)], [("a", 9, "y", 2)], [("a", 8, "w", 0)])):
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(f"{path}/in")
    for _ in range(2):
        source = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
        events.upsert_stream(source, f"{path}/s", 4).option("checkpointLocation", f"{path}/c").trigger(availableNow=True).start().awaitTermination()
        assert state(events.event_store(spark, f"{path}/s")) == [("a", 8, "y"), ("b", 2, "x")]


class Handle:
    """What the limiter asks of its state, in plain Python, with the most values ever held at once."""

    def __init__(self):
        self.live, self.waiting, self.timers, self.most = [], {}, set(), 0

    def getListState(self, *_):
        return type("L", (), {"exists": lambda s: bool(self.live), "get": lambda s: iter(self.live), "put": lambda s, rows: setattr(self, "live", list(rows))})()

    def getMapState(self, *_):
        def update(_, key, value):
            self.waiting[key] = value
            self.most = max(self.most, len(value[0]))

        return type("M", (), {"containsKey": lambda s, k: k in self.waiting, "getValue": lambda s, k: self.waiting[k], "updateValue": update, "removeKey": lambda s, k: self.waiting.pop(k)})()

    def registerTimer(self, at):
        self.timers.add(at)


def test_limiter_state_is_bounded():
    """One key with all rows, out of order, in small frames: decisions as in order, no more than a span waits together."""
    import pandas as pd

    rnd = random.Random(2)
    rows = [(i, i * 7_000_000 + rnd.randrange(5_000_000)) for i in range(3000)]
    handle, one = Handle(), events.Limiter(3600, 5)
    one.init(handle)
    got = {}
    for start in range(0, 3000, 300):
        part = rows[start : start + 300]
        rnd.shuffle(part)
        frames = [pd.DataFrame({"id": [r[0] for r in part[i : i + 50]], "micros": [r[1] for r in part[i : i + 50]]}) for i in range(0, 300, 50)]
        assert list(one.handleInputRows((1,), iter(frames), None)) == []
        mark = rows[start + 299][1] // 1000 if start < 2700 else 10**12
        for t in sorted(t for t in handle.timers if t <= mark):
            handle.timers.remove(t)
            for out in one.handleExpiredTimer((1,), None, type("T", (), {"getExpiryTimeInMs": lambda s, t=t: t})()):
                got.update(zip(out["id"], out["accepted"]))
    live, want = [], {}
    for i, t in rows:
        live = [x for x in live if x > t - 3_600_000_000]
        want[i] = len(live) < 5
        if want[i]:
            live.append(t)
    assert got == want and not handle.waiting and len(handle.live) <= 5 and handle.most <= 3600 // events.SPANS // 7 + 2


def test_limiter_reads_a_sparse_key_once():
    """Rows days apart are no states of their own: a micro-batch of a key reads and writes one piece and sets one timer."""
    import pandas as pd

    handle, one = Handle(), events.Limiter(3600, 1)
    one.init(handle)
    day = 86_400_000_000
    at = [9 * day, 2 * day, 2 * day + 1, *[k * day for k in range(3, 9)]]
    assert list(one.handleInputRows((1,), iter([pd.DataFrame({"id": range(9), "micros": at})]), None)) == []
    assert len(handle.waiting) == 1 and handle.timers == {9 * day // 1000 + 1}
    out = list(one.handleExpiredTimer((1,), None, type("T", (), {"getExpiryTimeInMs": lambda s: 9 * day // 1000 + 1})()))
    assert [i for x in out for i in x["id"]] == [1, 2, 3, 4, 5, 6, 7, 8, 0] and [a for x in out for a in x["accepted"]] == [True, False, *[True] * 7] and not handle.waiting


def lines_of(spark, given):
    rows = [(i, p, json.dumps(x) if isinstance(x, dict) else x) for i, xs in given.items() for p, x in enumerate(xs)]
    return spark.createDataFrame(rows, "import_id long, place long, line string")


ENVELOPE = "import_id long, sequence long, mode string, confirmed boolean, dataset string, rows long"


def test_imports_all_or_nothing(spark, tmp_path):
    fine = lambda n, **more: {"name": n, "category": SLUGS[0], **more}
    directory = imports.Directory(spark, f"file://{tmp_path}/d")
    assert directory.records() is None and directory.log() is None
    given = {1: [fine("a"), fine(" b  c ", id="own")], 2: [fine("x"), {"name": ""}], 3: [fine("r")], 4: [fine("s")], 5: [fine("k")], 6: [fine("m"), fine("n")], 7: [fine("o", createdAt="yesterday")], 9: [fine("z")], 10: ["no json"]}
    envelopes = [(1, 1, "append", None, "AB", 2), (2, 2, "append", None, None, None), (3, 3, "replace", None, None, None), (4, 4, "replace", False, None, None), (5, 5, "append", None, "cd", 2),
                 (6, 6, "append", None, "ab", 2), (7, 7, "append", None, None, None), (8, 8, "append", None, None, None), (9, 9, None, None, None, None), (10, 10, "append", None, None, None)]
    directory.apply(spark.createDataFrame(envelopes, ENVELOPE), lines_of(spark, given), IMPORT)
    got = {r["import_id"]: (r["outcome"], r["problem"]) for r in directory.log().collect()}
    assert got == {1: ("OK", None), 2: ("VALIDATION_ERROR", "line 1: name,category"), 3: ("REPLACE_CONFIRMATION_REQUIRED", None), 4: ("REPLACE_CONFIRMATION_REQUIRED", None), 5: ("DATASET_COUNT_MISMATCH", None),
                   6: ("KNOWN", None), 7: ("VALIDATION_ERROR", "line 0: createdAt"), 8: ("VALIDATION_ERROR", "no records"), 9: ("VALIDATION_ERROR", "mode"), 10: ("VALIDATION_ERROR", "line 0: not an object")}
    assert sorted((r["id"], r["name"], r["dataset"]) for r in directory.records().collect()) == [("1-0", "a", "ab"), ("own", "b c", "ab")]
    # a second go: its log knows the first, a confirmed replacement empties the directory, and appends follow
    again = spark.createDataFrame([(21, 1, "append", None, "ab", 2), (22, 2, "append", None, None, None), (23, 3, "replace", True, None, None), (24, 4, "append", None, None, None)], ENVELOPE)
    directory.apply(again, lines_of(spark, {21: given[1], 22: [fine("y")], 23: [fine("p"), fine("q")], 24: [fine("t")]}), IMPORT)
    log = {r["import_id"]: r for r in directory.log().where("import_id > 20").collect()}
    assert log[21]["outcome"] == "KNOWN" and log[23]["removed"] == 3 and log[23]["summary"] == "Replaced 3 resource(s) with 2 validated resource(s)"
    assert log[24]["summary"] == "Imported 1 validated resource(s)" and log[21]["action"] is None
    assert sorted(r["name"] for r in directory.records().collect()) == ["p", "q", "t"] and directory.log().count() == 14


def test_too_many_lines(spark, tmp_path, monkeypatch):
    staged = spark.createDataFrame([(1, p, []) for p in range(4)], "import_id long, place long, errors array<string>")
    none = spark.createDataFrame([], "dataset string, rows long")
    row = imports.decide(spark.createDataFrame([(1, 1, "append", None, None, None)], ENVELOPE), staged, none, most=3).first()
    assert (row["outcome"], row["problem"]) == ("VALIDATION_ERROR", "too many records")


def test_shared_folder(spark):
    assert shared_folder(spark) != shared_folder(spark)
