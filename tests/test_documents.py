"""Whole-table digests, and documents written and read as data sources."""

import csv
import datetime
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fieldbook.functions import encode
from fieldbook.operators.digest import digest, lanes
from fieldbook.sources import documents

SCHEMA = "a string, b string, i int, d double, t timestamp_ntz, x array<float>, m map<string,int>, s struct<p:int,q:string>, y binary, e decimal(10,2), day date"
ROW = ("ab", "c", 1, 0.1, datetime.datetime(2026, 1, 2, 3, 4, 5, 6), [1.5, None], {"k": 1, "l": 2}, (1, "z"), b"\0\1", Decimal("1.50"), datetime.date(2026, 1, 2))


def of(spark, rows, schema=SCHEMA):
    return tuple(digest(spark.createDataFrame(rows, schema)).first())


def test_digest_sees_every_change(spark):
    base = [ROW, tuple([None] * len(ROW)), ("x", *ROW[1:])]
    want = of(spark, base)
    assert want == of(spark, base[::-1]) == tuple(digest(spark.createDataFrame(base, SCHEMA).repartition(5)).first()) and want[0] == 3
    changed = [("a", "bc"), ("ab", ""), ("ab", None), ("abc", None)]
    others = [of(spark, [(*c, *ROW[2:]), *base[1:]]) for c in changed]
    for k, value in ((2, 2), (3, 0.1 + 2**-56), (4, datetime.datetime(2026, 1, 2, 3, 4, 5, 7)), (5, [None, 1.5]), (5, []), (6, {"k": 2, "l": 1}), (7, (1, None)), (8, b"\0"), (9, Decimal("1.51")), (10, None)):
        others.append(of(spark, [(*ROW[:k], value, *ROW[k + 1 :]), *base[1:]]))
    others += [of(spark, [*base, ROW]), of(spark, base[:2]), of(spark, [])]
    assert len({d for _, d in [want, *others]}) == len(others) + 1
    assert of(spark, [("1",)], "a string") != of(spark, [(1,)], "a int") != of(spark, [(1,)], "b int")


def test_digests_add_up(spark):
    rows = spark.range(100).withColumn("t", F.col("id").cast("string"))
    parts = [lanes(rows.where(F.col("id") % 3 == k)).first() for k in range(3)]
    assert tuple(sum(p[i] for p in parts) for i in range(len(parts[0]))) == tuple(lanes(rows).first())


CELLS = [("1", "plain"), ("2", 'say "x", y'), ("3", "two\r\nlines\n"), ("4", "=2*3"), ("5", None), ("6", " ü 日本 "), ("7", "a,b\n"), ("8", "'quoted'")]


def test_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame(CELLS, "id string, text string")
    line = F.concat(encode.csv_row(F.col("id"), F.col("text")), F.lit("\r\n"))
    for mode in ("overwrite", "overwrite"):
        documents.write(rows.repartition(5, "id").select(line.alias("value")), str(tmp_path / "d"), head="id,text\r\n", mode=mode)
    files = sorted(p for p in (tmp_path / "d").iterdir() if p.name[0] not in "._")
    whole = b"".join(p.read_bytes() for p in files).decode()
    assert whole.startswith("id,text\r\n") and whole.count("id,text") == 1 and not any(p.is_dir() for p in (tmp_path / "d").iterdir())
    want = sorted((i, "'" + t if t and t.startswith("=") else t or "") for i, t in CELLS)
    assert sorted(tuple(r) for r in list(csv.reader(whole.splitlines(keepends=True)))[1:]) == want
    back = documents.read_csv(spark, str(tmp_path / "d"))
    assert back.columns == ["id", "text"] and sorted((r[0], r[1] or "") for r in back.collect()) == want


def test_in_order(spark, tmp_path):
    lines = spark.range(1000, numPartitions=7).select(F.col("id").cast("string").alias("value"))
    documents.write(lines, str(tmp_path / "d"), '{"count": 1000, "resources": [', "]}", ",")
    whole = json.loads("".join(p.read_text() for p in sorted((tmp_path / "d").iterdir()) if p.name[0] not in "._"))
    assert whole["resources"] == list(range(1000))
    documents.write(lines.where("id < 0"), str(tmp_path / "none"), "[", "]", ",")
    assert "".join(p.read_text() for p in sorted((tmp_path / "none").iterdir()) if p.name[0] not in "._") == "[]"
    assert [int(r[0]) for r in documents.read_json(spark, str(tmp_path / "d")).collect()] == list(range(1000))
    with pytest.raises(Exception, match="FileExistsError"):
        documents.write(lines, str(tmp_path / "d"), mode="append")
    assert not any(p.is_dir() for p in (tmp_path / "d").iterdir())


def test_json_elements(spark, tmp_path):
    items = [{"name": 'a "b" ]', "tags": ["x", {"y": [1]}]}, {"name": "ü" * 70_000}, {}, {"n": None}]
    for k, text in enumerate((json.dumps({"mode": "append", "resources": items, "after": 1}), json.dumps({"resources": items}, indent=2, ensure_ascii=False))):
        (tmp_path / f"{k}.json").write_text(text)
        assert [json.loads(r[0]) for r in documents.read_json(spark, str(tmp_path / f"{k}.json")).collect()] == items
    for text in ('{"other": []}', '{"resources": {}}', '{"resources": [1, 2', '{"resources": [1 2 x]}'):
        (tmp_path / "bad.json").write_text(text)
        with pytest.raises(Exception):  # noqa: B017
            documents.read_json(spark, str(tmp_path / "bad.json")).collect()


def test_readers_stop(spark, tmp_path):
    """A body longer than allowed is refused while it is read, also where only its tail is too long."""
    (tmp_path / "a.json").write_text('{"resources": [1]' + " " * 200_000 + "}")
    (tmp_path / "a.csv").write_text("x\r\n" + "1\r\n" * 100_000)
    for read, name in ((documents.read_json, "a.json"), (documents.read_csv, "a.csv")):
        assert read(spark, str(tmp_path / name)).count() > 0
        with pytest.raises(Exception, match="longer than allowed"):
            read(spark, str(tmp_path / name), most_bytes=150_000).collect()

    class Endless:
        def open_input_stream(self, _):
            return type("S", (), {"read": lambda s, n: b"x" * n, "close": lambda s: None})()

    stream = documents.Bounded(Endless(), ["a"], 1_000_000)
    with pytest.raises(documents.TooLong):
        while True:
            stream.read(4096)


def test_failed_write_leaves_nothing(spark, tmp_path):
    lines = spark.range(10, numPartitions=2).select(F.when(F.col("id") == 7, F.raise_error(F.lit("no"))).otherwise(F.col("id").cast("string")).alias("value"))
    with pytest.raises(Exception):  # noqa: B017
        documents.write(lines, str(tmp_path / "d"), "head")
    assert not [p for p in (tmp_path / "d").rglob("*")] if (tmp_path / "d").exists() else True
    with pytest.raises(Exception, match="one column"):
        documents.write(spark.range(1), str(tmp_path / "d"))
