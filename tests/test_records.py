"""Validation, readers, signatures and links against plain Python and stated values."""

import hashlib
import hmac
import ipaddress
import json
import random

import pytest
from pyspark.sql import functions as F

from fieldbook.functions import encode, links, whatwg
from fieldbook.operators import limiter, membership, search, selection, validation
from fieldbook.plans.imports import RECORD, REQUEST


def judged(spark, lines, fields, partial=False):
    rows = spark.createDataFrame(list(enumerate(lines)), "i int, line string")
    return [r["e"] for r in rows.select("i", validation.errors(F.col("line"), fields, partial).alias("e")).orderBy("i").collect()]


def test_validation(spark):
    slug = RECORD["category"].values[0]
    lines = [json.dumps({"name": " x ", "category": slug}), json.dumps({"name": " ", "category": "none", "priority": 1.5, "verified": None}), "{}", "[]", "no json",
             json.dumps({"name": "n", "category": slug, "email": None, "tags": None, "other": 1})]
    assert judged(spark, lines, RECORD) == [[], ["name", "category", "priority", "verified"], ["name", "category"], ["not an object"], ["not an object"], ["tags", "unknown keys"]]
    assert judged(spark, lines[2:3], RECORD, True) == [[]]
    consents = [[True, True], [True], [True, False], "yes", []]
    assert judged(spark, [json.dumps({"consentRequired": c}) for c in consents], REQUEST) == [[], *[["consentRequired"]] * 4]


def test_signatures(spark):
    for key in ("k", "k" * 64, "long key " * 20):
        got = spark.createDataFrame([("1.é",)], "m string").select(encode.hmac(key, F.col("m"))).first()[0]
        assert got == hmac.new(key.encode(), "1.é".encode(), hashlib.sha256).hexdigest()


def test_numeric_hosts(spark):
    cases = {"1.2.3.4": 16909060, "16909060": 16909060, "0x1.2.772": 16909060, "01.0x2.03.4": 16909060, "1.2.3.256": -1, "1.2.3.4.5": -1, "256.1": -1, "08": -1, "4294967296": -1, "a.0x": -1, "a.b": None, "1.a": None}
    rows = spark.createDataFrame([(h,) for h in cases], "h string").select("h", whatwg.ipv4(F.col("h")).alias("n")).collect()
    assert {r["h"]: r["n"] for r in rows} == cases


def test_search_parameters():
    assert search.parameters(" a ") == ("a", 24, 0)
    for wrong in ({"q": "x" * 201}, {"limit": 0}, {"limit": 101, "most": 100}, {"offset": -1}):
        with pytest.raises(ValueError):
            search.parameters(**wrong)


def test_links_as_browsers_read_them(spark):
    """Punycode against Python's own, IPv6 against its addresses, and links of many shapes."""
    rnd = random.Random(4)
    names = ["bücher", "日本語", "ñandú-x", "пример", "a" + "é" * 20, "𝒳y", "☃", "plain"] + ["".join(rnd.choice("abcäöüéñ日本𝒳-") for _ in range(rnd.randint(1, 15))) for _ in range(40)]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", whatwg.punycode(F.col("n")).alias("p")).collect()
    assert all(r["p"] == (r["n"] if r["n"].isascii() else "xn--" + r["n"].encode("punycode").decode()) for r in rows)
    texts = ["::", "::1", "1::", "1:2:3:4:5:6:7:8", "1::8", "1:0:0:2:0:0:0:3", "1:0:2:0:3:0:4:0", "::ffff:1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "0:0:1::", "fe80::00a",
             "", ":", "1", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1::2::3", ":1::", "12345::", "::1.2.3", "::1.2.3.4.5", "::1.2.3.256", "::01.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "g::", ":::", "1:::2"]
    texts += [":".join(f"{rnd.choice([0, 0, 0, 1, 255, 65535]):x}" for _ in range(8)) for _ in range(30)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", whatwg.ipv6(F.col("t")).alias("p"), whatwg.shown(whatwg.ipv6(F.col("t"))).alias("s")).collect()
    for r in rows:
        try:
            want = ipaddress.IPv6Address(r["t"])
        except ValueError:
            assert r["p"] is None, r
            continue
        assert r["p"] == [int(want) >> 112 - 16 * i & 0xFFFF for i in range(8)], r
        if want.ipv4_mapped is None:
            assert r["s"] == want.compressed, r
    cases = {"http://[0:0:0:0:0:0:0:1]/": "http://[::1]", "x.org:080/a": "https://x.org:80/a", "http://x.org:080/a": "http://x.org/a", "http://x.org:65536": None, "http://a b.org": None, "http://bücher.example/ä?ö#ü": "http://xn--bcher-kva.example/%C3%A4?%C3%B6#%C3%BC",
             "http://u@v@x.org/": "http://u%40v@x.org", "http://:@x.org": "http://x.org", "\t http://X.org/a\\b c\n": "http://x.org/a/b%20c", "http://x.org/{a}?'q'#`": "http://x.org/%7Ba%7D?%27q%27#%60", "http://x.org/?": "http://x.org/?",
             "http://x.org/a/%2e%2E/b": "http://x.org/b", "http://1.2.3/": "http://1.2.0.3", "http://a%41.org/": "http://aa.org", "http://a%2g.org/": None, "http://": None, "http://x。org": "http://x.org"}
    rows = spark.createDataFrame([(u,) for u in cases], "u string").select("u", links.normalize(F.col("u")).alias("n")).collect()
    assert {r["u"]: r["n"] for r in rows} == cases


def test_places(spark):
    """Pages, places and numbers of an order against a sort of all, ties of the first column included."""
    rnd = random.Random(8)
    rows = [(i, rnd.choice("abc"), rnd.choice([None, 1, 2])) for i in range(500)]
    rnd.shuffle(rows)
    frame = spark.createDataFrame(rows, "id int, a string, b int")
    order = [F.col("a").desc(), F.col("b").asc_nulls_first(), F.col("id")]
    want = [r[0] for r in sorted(rows, key=lambda r: (-ord(r[1]), -1 if r[2] is None else r[2], r[0]))]
    for offset, limit in ((0, 5), (123, 300), (498, 50), (500, 3), (0, 0), (77, 1)):
        assert [r["id"] for r in selection.page(frame, order, offset, limit).collect()] == want[offset : offset + limit]
    assert {r["k"]: r["id"] for r in selection.numbered(frame, order, "k").collect()} == dict(enumerate(want, 1))
    assert selection.nth(frame, order, 1234).first()["id"] == want[234] and selection.nth(frame.where("id < 0"), order, 5).count() == 0
    assert selection.numbered(frame.where("id < 0"), order, "k").count() == 0 and selection.page(frame.where("id < 0"), order, 0, 3).count() == 0


def test_membership(spark):
    lists = spark.createDataFrame([(1, [5, 6, 5, None, 9]), (2, []), (3, None), (4, [8])], "collection_id int, members array<int>")
    entries = spark.createDataFrame([(5, "five"), (6, "six"), (7, "seven")], "id int, name string")
    assert sorted(map(tuple, membership.members(lists, entries).select("collection_id", "place", "id", "name").collect())) == [(1, 0, 5, "five"), (1, 1, 6, "six"), (1, 2, 5, "five")]
    assert sorted(map(tuple, membership.counted(lists, entries).collect())) == [(1, 5, 3, 2), (2, 0, 0, 0), (3, 0, 0, 0), (4, 1, 0, 1)]
    assert sorted(map(tuple, membership.containing(lists, entries).collect())) == [(5, 1), (6, 1), (7, 0)]


def test_limiter_runs(spark):
    """One key with all rows becomes as many runs as there are pauses, and decides as one sequence does."""
    rnd = random.Random(9)
    times, t = [], 0
    for _ in range(2000):
        t += rnd.choice([1, 1, 2, 5, 30, 59, 60, 61, 200])
        times.append(t)
    live, want = [], {}
    for i, s in enumerate(times):
        live = [x for x in live if x > s - 60]
        want[i] = len(live) < 3
        if want[i]:
            live.append(s)
    rows = spark.createDataFrame([(i, None, s) for i, s in enumerate(times)] + [(9999, 1, None)], "id long, key long, s long").withColumn("ts", F.timestamp_seconds("s"))
    assert {r["id"]: r["accepted"] for r in limiter.sliding(rows, "key", "ts", "id", 60, 3).collect()} == want
    timed = rows.where("s is not null").withColumn("m", F.unix_micros("ts"))
    assert limiter.runs(timed, "key", "m", 60_000_000).select("_run").distinct().count() == 1 + sum(b - a >= 60 for a, b in zip(times, times[1:]))
