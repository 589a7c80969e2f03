"""Filter audit, periodic runs and byte-indexed SimHash dedup against brute force."""

import hashlib
import random
import re
import zlib
from itertools import permutations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from compare import connect, same
from fieldbook.llm import filter_audit, near_bytes, periodic, queries
from test_operators import SF, corpus, docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def small(spark):
    return docs(spark, corpus()).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return docs(spark, [])


# filter audit


def audited(rows, filters, losses):
    """rows: (part, failures, losses); figures of every part, order and step, row by row."""
    out = {}
    for part in {p for p, _, _ in rows}:
        here = [(f, x) for p, f, x in rows if p == part]
        total = dict.fromkeys(filters, 0)
        for order in permutations(range(len(filters))):
            left = list(here)
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[0][f]]
                left = [r for r in left if not r[0][f]]
                total[filters[f]] += len(gone)
                out[part, "".join(filters[i] for i in order), step] = (
                    len(left), len(gone), sum(r[0][f] for r in here) - len(gone),
                    sum(r[0][f] and not any(r[0][i] for i in order if i != f) for r in here), *[sum(r[1][i] for r in gone) for i in range(len(losses))])
        for (p, order, step), v in list(out.items()):
            if p == part:
                out[p, order, step] = (*v, total[order[step - 1]])
    return out


@pytest.mark.parametrize("filters", ["A", "XY", "ABCD"])
def test_audit_row_by_row(spark, filters):
    rnd = random.Random(len(filters))
    rows = [(rnd.choice(["a", "a", "a", "b", None]), [rnd.choice([True, False, False, None]) for _ in filters], rnd.choice([True, None]), rnd.random() < 0.3) for _ in range(200)]
    schema = "part string, " + ", ".join(f"{f} boolean" for f in filters) + ", lost boolean, m0 boolean, _value long, cells int"
    frame = spark.createDataFrame([(p, *f, a, b, 1, 2) for p, f, a, b in rows], schema)
    got = filter_audit.audit(frame, "part", list(filters), {"first": "lost", "second": "m0"}).collect()
    want = audited([(p or "", [bool(x) for x in f], [bool(a), b]) for p, f, a, b in rows], filters, ["first", "second"])
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[4:]) for r in got} == want and len(got) == len(want)
    assert all(r["filter"] == r["filter_order"][r["step"] - 1] for r in got)


def test_audit_limits(spark):
    frame = spark.createDataFrame([("a", True)], "part string, A boolean")
    with pytest.raises(ValueError):
        filter_audit.audit(frame, "part", [], {})
    with pytest.raises(ValueError):
        filter_audit.audit(frame, "part", ["A", "A"], {})
    assert filter_audit.audit(frame.where("false"), "part", ["A"], {}).count() == 0


def test_audit_of_texts(spark, small, empty):
    """Null and empty texts, null ids, repeated rows and labels, capitals, long texts."""
    more = docs(spark, [(300, "ABC def", "en", None), (301, "ABC def", "en", ""), (301, "ABC def", "en", ""), (None, "ABC def", "en", "a"), (None, None, None, None),
                        (302, "x | y " * 150, "en", "b"), (303, " ".join(map(str, range(300))), "en", "b"), (204, "again one id", "en", "a")])
    whole = small.unionByName(more)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (300, 1, None), (303, 1, 1), (None, 1, 1), (999, 1, 1), *[(i, i % 2, i % 3 == 0 and 1 or 0) for i in range(2, 90)]],
                                   "doc_id long, quality int, toxic int")
    rows = whole.select("doc_id", "text", "source").collect()
    marks = {}
    for r in labels.collect():
        marks.setdefault(r[0], [False, False])
        marks[r[0]] = [marks[r[0]][0] or r[1] == 1, marks[r[0]][1] or r[2] == 1]
    plain = []
    for i, text, source in rows:
        text = text or ""
        words = WORD.findall(text)
        twin = i is not None and any((t or "") == text and j is not None and j < i for j, t, _ in rows)
        fails = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), bool(re.search(r"[#$%&*|]", text)), twin]
        plain.append((source or "", fails, marks.get(i, [False, False]) if i is not None else [False, False]))
    found = filter_audit.audit(filter_audit.labelled(filter_audit.text_failures(whole), labels), "part", list("ABCDE"), {"good_lost": "good", "toxic_lost": "toxic"})
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[4:]) for r in found.collect()}
    assert got == audited(plain, "ABCDE", ["g", "t"]) and len(got) == 600 * len({p for p, _, _ in plain})
    assert filter_audit.labelled(filter_audit.text_failures(empty), labels).count() == 0


def test_audit_query(spark):
    same(queries.op11_filter_audit(spark, SF).toPandas(), connect(SF).execute(queries.AUDIT_SQL).df())


# periodic runs


def runs_by_definition(words, least=12):
    out = {}
    n = len(words)
    for q in range(1, n // 2 + 1):
        start = 0
        for i in range(q, n + 1):
            if i == n or words[i] != words[i - q]:
                length = i - start
                if length >= max(least, 2 * q) and start + q < i:
                    out.setdefault((start, length), q)
                start = i - q + 1
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def kept_by_definition(words, runs):
    return [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]


def samples():
    rnd = random.Random(3)
    fib = ["a", "ab"]
    while len(fib) < 13:
        fib.append(fib[-1] + fib[-2])
    yield from (list("a" * n) for n in (0, 1, 11, 12, 13, 60))
    yield from (list("ab" * 6), list("ab" * 6 + "a"), list("abc" * 30 + "x" + "abc" * 30), list(fib[-1]), list("aab" * 20 + "ab" * 20))
    yield list("".join("ab"[bin(i).count("1") % 2] for i in range(256)))
    for _ in range(60):
        words = [rnd.choice("abc"[: rnd.randint(1, 3)]) for _ in range(rnd.randint(12, 80))]
        for _ in range(rnd.randint(0, 4)):
            at, n = rnd.randrange(len(words)), rnd.randint(1, 9)
            words[at:at] = words[at : at + n] * rnd.randint(1, 5)
        yield words
    phrase = [f"w{i}" for i in range(8)]
    yield sum(([f"x{i}", *phrase] for i in range(60)), [])  # many left words
    yield [f"u{i}" for i in range(3000)] + sum(([*phrase, "y"] for _ in range(400)), [])


@pytest.mark.parametrize("least", [12, 4, 7])
def test_runs_by_definition(least):
    for words in samples():
        ids = periodic.numbered([w.encode() for w in words])
        got = periodic.runs(ids, least)
        if len(words) < 1000:
            assert got == runs_by_definition(words, least), words
        stays = periodic.collapse(len(words), got)
        assert [w for w, s in zip(words, stays) if s] == kept_by_definition(words, got) if len(words) < 1000 else len(got) == 1


def test_runs_of_a_long_text():
    """One word a hundred thousand times, and a long period: no quadratic work."""
    assert periodic.runs(np.zeros(100_000, dtype=np.int64)) == [(0, 100_000, 1)]
    assert periodic.runs(np.arange(100_000, dtype=np.int64) % 777) == [(0, 100_000, 777)]


def test_detect(spark, empty):
    line = "to be or not to be or\tnot " * 5
    rows = docs(spark, [(1, line, "en", "a"), (1, line, "en", "a"), (None, line, None, None), (2, None, "en", "a"), (3, "", "en", "a"), (4, " \n", "en", "a"), (5, "no run here", "en", "a")])
    rows = rows.withColumn("runs", F.lit(1)).withColumn("collapsed", F.lit(2)).withColumn("n_words", F.lit(3))
    got = periodic.detect(rows).collect()
    words = line.split()
    want = runs_by_definition(words)
    for r in got:
        if r["doc_id"] in (1, None):
            assert [tuple(x) for x in r["runs"]] == want == [(0, 30, 6)] or [tuple(x) for x in r["runs"]] == want
            assert r["collapsed"] == " ".join(kept_by_definition(words, want)) and r["n_words"] == len(words)
        else:
            assert r["runs"] == [] and r["collapsed"] == ("no run here" if r["doc_id"] == 5 else "")
    assert len(got) == 7 and periodic.detect(empty).count() == 0


def test_runs_query(spark):
    """The contract in plain loops, planted repeats included."""
    table = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r["doc_id"]: r for r in queries.op12_periodic_runs(spark, SF).collect()}
    assert len(got) == len(table)
    some = 0
    for r in table:
        words = WORD.findall(r["text"] or "")
        h, n = zlib.crc32(str(r["doc_id"]).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        if n > 1500:
            continue
        runs = runs_by_definition(words)
        some += bool(runs)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        row = got[r["doc_id"]]
        assert (row["n_runs"], row["start"], row["length"], row["period"]) == (len(runs), *(best or (None, None, None)))
        assert row["exponent_milli"] == (best and 1000 * best[1] // best[2])
        assert row["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(" ".join(kept_by_definition(words, runs)).encode()).hexdigest()
    assert some > 10


# SimHash near-dedup


def fingerprint(text):
    words = [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in WORD.findall(text or "")]
    if not words:
        return 0
    terms = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(t >> b & 1 for t in terms) > len(terms))


def linked(rows):
    """Components by comparing all fingerprints; rows of one id are one node."""
    ids = sorted({i for i, _ in rows if i is not None})
    marks = {}
    for i, mark in rows:
        if i is not None:
            marks.setdefault(mark, set()).add(i)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    known = list(marks)
    for x, a in enumerate(known):
        for b in known[x:]:
            if (a ^ b).bit_count() <= 4:
                for i in marks[a]:
                    for j in (min(marks[a]), min(marks[b])):
                        one, other = sorted((root(i), root(j)))
                        parent[other] = one
    return {i: root(i) for i in ids}


def test_fingerprints(spark):
    for text in ("", None, " \n", "one", "One two three", "Ä a B c d", "日本 語 x y Z", "a " * 1000, " ".join(map(str, range(5000)))):
        assert near_bytes.majority(text) == fingerprint(text), text
    text = "the Quick brown fox"
    row = spark.createDataFrame([(text.lower(),)], "t string").select(F.xxhash64("t")).first()[0]
    assert near_bytes.majority(text) == row & (1 << 64) - 1  # Spark's own function has the same seed


@pytest.mark.parametrize("terms", [100_000, 300])
def test_fingerprint_pieces(monkeypatch, terms):
    monkeypatch.setattr(near_bytes, "TERMS", terms)
    text = " ".join(f"w{i % 97}" for i in range(2000))
    assert near_bytes.majority(text) == fingerprint(text)


def test_near_dedup(spark, small, empty):
    more = docs(spark, [(204, "one id of several texts", "en", None), (7, "one id of several texts", "en", None), (300, "", None, None), (None, "", None, None), (None, "x", None, None), (301, None, None, None)])
    whole = small.unionByName(more)
    rows = [(r["doc_id"], fingerprint(r["text"])) for r in whole.select("doc_id", "text").collect()]
    want = linked(rows)
    got = near_bytes.similar(whole).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["fingerprint"]) for r in got) == sorted((i is None, i or 0, f"{m:016x}") for i, m in rows)
    assert all(r["component_id"] == (None if r["doc_id"] is None else want[r["doc_id"]]) for r in got)
    assert near_bytes.similar(empty).count() == 0


def crowd(n, seed):
    """Fingerprints in chains of few flipped bits, with many that share most bytes, and random ones."""
    rnd = random.Random(seed)
    out = [rnd.getrandbits(64) for _ in range(n)]
    base = rnd.getrandbits(64)
    for _ in range(n):
        out.append(base ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 6))))
        out.append(rnd.choice(out[:n]) ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(3, 5))))
    low = rnd.getrandbits(64)
    out += [low ^ rnd.getrandbits(14) for _ in range(n)]
    return out


@pytest.mark.parametrize("limits", [(64, 16_384, 1024), (4, 30, 8), (2, 2, 8)])
def test_links_of_crowds(spark, monkeypatch, limits):
    """Long lists, tiles and divisions by half-bytes connect just what is within four bits."""
    for name, value in zip(("SMALL", "LARGE", "TILE"), limits):
        monkeypatch.setattr(near_bytes, name, value)
    marks = sorted({near_bytes._signed(m) for m in crowd(120, 5)})
    whole = {m: m & (1 << 64) - 1 for m in marks}
    want = linked([(m, whole[m]) for m in marks])
    pairs = near_bytes.links(spark.createDataFrame([(m,) for m in marks], "fp long")).collect()
    assert all((whole[a] ^ whole[b]).bit_count() <= 4 or want[a] == want[b] for a, b in pairs)
    parent = {m: m for m in marks}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        one, other = sorted((root(a), root(b)))
        parent[other] = one
    assert {m: root(m) for m in marks} == want
    assert len(pairs) < len(marks) ** 2 / 4


def test_near_dedup_query(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r[0], fingerprint(r[1])) for r in table]
    want = linked(rows)
    got = queries.op13_simhash_near_dedup(spark, SF).collect()
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == sorted((i, f"{m:016x}", want[i]) for i, m in rows)
