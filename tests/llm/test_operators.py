"""Each operator against a brute-force version on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import connect, same
from fieldbook.llm import chat, counting, jaccard, job, language, lines, mixing, packing, queries, simhash, textops, tokens, topk, url_filter
from fieldbook.llm.components import components
from fieldbook.llm.job import beside, tokenizer_file

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: names that operators use inside
CLASH = ("n", "size", "queue", "at", "ids", "h", "mark", "pos", "key", "range", "ahead", "taken", "component_id", "tokens", "score", "block")


def clash(frame):
    return frame.withColumns({c: F.lit(1) for c in CLASH if c not in frame.columns})


def docs(spark, rows):
    rows = [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]
    return clash(spark.createDataFrame(rows, SCHEMA))


def corpus():
    """Copies, near copies, nulls, empty and long texts over sources of uneven size."""
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6)))
    texts = [" ".join(word() for _ in range(rnd.randint(1, 60))) for _ in range(40)]
    out = []
    for i in range(150):
        words = rnd.choice(texts).split(" ")
        if rnd.random() < 0.5:
            words[rnd.randrange(len(words))] = word()
        out.append((i, " ".join(words), rnd.choice(["de", "en", None]), rnd.choice(["a", "a", "a", "b", None]), ))
    long = " ".join(word() for _ in range(20_000))
    return [*out, (200, None, "en", "a"), (201, "", None, "b"), (202, " \n\t", "de", "c"), (203, long, "en", "a"), (204, long + " x", "en", None), (205, "One two", "en", "b"),
            (206, "ONE\ntwo", "en", "b"), (207, "日本語 ß é ￿ 𝒳", None, "c"), (-3, "minus", None, "a")]


@pytest.fixture(scope="module")
def small(spark):
    return docs(spark, corpus()).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return docs(spark, [])


def test_language_id(spark, empty):
    found = queries.op1_language_id(spark, SF).toPandas()
    truth = spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id")
    assert sorted(found.doc_id) == sorted(truth.index) and found.score.between(0, 1).all()
    assert (found.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in found.doc_id]).all()
    judged = found[found.held_out & (found.lang_pred != "und")]
    known = [(p, truth.lang[i]) for i, p in zip(judged.doc_id, judged.lang_pred) if truth.lang[i] is not None]
    assert len(known) > 10 and np.mean([p == t for p, t in known]) >= 0.9
    assert language.language_id(empty).count() == 0
    rows = docs(spark, [(1, "the house is there", "en", "a"), (2, "das Haus ist dort", "de", "a"), (3, None, "en", "a"), (4, "12 !", "en", None), (4, "12 !", None, None)])
    got = {(r["doc_id"], r["lang_pred"], r["score"]) for r in language.language_id(rows).collect() if r["doc_id"] > 2}
    assert got == {(3, "und", 0.0), (4, "und", 0.0)}


def test_training_rows_are_bounded_without_ids(spark):
    """Rows with a null doc_id are thinned like others, not all kept or all left out."""
    rows = docs(spark, [(None, f"the house number {chr(97 + i % 26)}{chr(97 + i // 26)}", "en", "a") for i in range(600)])
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / (1 << 30)
    assert 20 < rows.where(draw < 100 / 600).count() < 200
    assert set(language.train(rows, 100)) == {"en"}


def by_loops(text):
    """The profile of a text, letter by letter and bit by bit."""
    letters = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    while "  " in letters:
        letters = letters.replace("  ", " ")
    lanes = language.BITS // 64
    vectors = {c: [int(w) for w in language.letter_vectors(np.array([ord(c)], dtype=np.uint32))[0]] for c in set(letters)}
    rolled = lambda c, k: [vectors[c][(i - k) % lanes] for i in range(lanes)]
    out = [0] * language.BITS
    for a, b, c in zip(letters, letters[1:], letters[2:]):
        bound = [x ^ y ^ z for x, y, z in zip(rolled(a, 2), rolled(b, 1), vectors[c])]
        for i in range(language.BITS):
            octet = bound[i // 64] >> (i % 64 // 8 * 8) & 255
            out[i] += -1 if octet >> (7 - i % 8) & 1 else 1
    return out


def test_language_profiles_by_loops(monkeypatch):
    texts = ["the house is there", "Über den  Häusern, 12 x", "日本語の文", "", "1 2", "a"]
    want = [by_loops(t) if any(c.isalpha() for c in t) else [0] * language.BITS for t in texts]
    got, has = language.profile(texts)
    assert has.tolist() == [any(c.isalpha() for c in t) for t in texts] and got.tolist() == want
    monkeypatch.setattr(language, "PIECE", 7)  # long texts in pieces
    monkeypatch.setattr(language, "GRAMS", 3)
    assert language.profile(texts)[0].tolist() == want


def test_language_by_cosines(spark):
    """Prototypes, and the language of the largest cosine, in plain loops."""
    rows = [(i, t, lang, "a") for i, (t, lang) in enumerate([("the house is there", "en"), ("they say that", "en"), ("das Haus ist dort", "de"), ("sie sagen das", "de"), ("maison la", "fr"),
                                                            ("this is that", None), ("der Hund ist da", None)] * 4)]
    unit = lambda v: np.array(v, dtype=np.float64) / np.linalg.norm(v)
    protos = {}
    for i, t, lang, _ in rows:
        if lang and zlib.crc32(str(i).encode()) % 5:
            protos[lang] = protos.get(lang, 0) + unit(by_loops(t))
    units = {k: unit(v) for k, v in protos.items()}
    common = sum(units.values()) / len(units)
    got = {r["doc_id"]: r for r in language.language_id(docs(spark, rows)).collect()}
    for i, t, _, _ in rows:
        v = unit(by_loops(t))
        best = max(sorted(units), key=lambda k: float((v - common) @ unit(units[k] - common)))
        assert got[i]["lang_pred"] == best and abs(got[i]["score"] - max(0, v @ units[best])) < 1e-4


def test_language_memory():
    """A megabyte of Chinese in many texts, and one text of ten."""
    import subprocess
    import sys

    code = ("import resource, numpy as np; from fieldbook.llm import language; r = np.random.default_rng(1); base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\n"
            "t = [''.join(map(chr, r.integers(0x4e00, 0x4e00 + 3500, 830))) for _ in range(400)]\n"
            "language.profile(t); language.profile([''.join(t) * 10])\n"
            "print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base) // 1024)")
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True)
    assert int(done.stdout.split()[-1]) < 300


def near(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] or a[i + 1:] == b[i:] or a[i:] == b[i + 1:]


def test_line_dedup(spark, empty):
    rnd = random.Random(3)
    base = "this line is said again and again in the corpus"
    pool = ["common head of numbered lines with number %03d" % k for k in range(90)] + [base, base + "!", base[:10] + base[11:], "short", "", "x" * 24, "x" * 23, "é" * 24]
    pool += [base[:k] + "Z" + base[k + 1:] for k in range(0, 40, 3)]
    rows = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(0, 6))), None, "a") for i in range(60)] + [(100, None, None, None), (101, "", None, None), (None, base, None, None)]
    first, kept = {}, {}
    for i, t, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        for p, line in enumerate((t or "").split("\n")):
            if len(line) >= lines.MIN_CHARS:
                first.setdefault(line, (i, p))
    gone = {a for a in first for b in first if first[b] < first[a] and near(a, b)}
    for i, t, *_ in rows:
        kept[i] = t if i is None or not t else "\n".join(x for p, x in enumerate(t.split("\n")) if len(x) < lines.MIN_CHARS or (x not in gone and first[x] == (i, p)))
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs(spark, rows).select("doc_id", "text", "n")).collect()}
    assert got == kept
    assert lines.dedup_lines(empty.select("doc_id", "text")).count() == 0


def test_line_dedup_of_short_lines(spark):
    """Exact repeats go whatever their length; blank lines stay, and one edit counts only where the longer line has NEAR_CHARS."""
    near_pool = ["y" * (lines.NEAR_CHARS - 1), "y" * (lines.NEAR_CHARS - 2) + "z", "y" * lines.NEAR_CHARS] + ["line %03d of one length" % k for k in range(80)]
    assert len(near_pool[-1]) == lines.NEAR_CHARS - 2
    edge = ["edge line number %03d off" % k for k in range(70)]
    edge += [x[:-1] for x in edge]
    assert {len(x) for x in edge} == {lines.NEAR_CHARS, lines.NEAR_CHARS - 1}
    rnd = random.Random(5)
    pool = ["All rights reserved.", "a", "b", "é", "", " ", "\t \u3000", *near_pool, *edge]
    rows = [(i, "\n".join(rnd.choice(pool) for _ in range(8))) for i in range(60)]
    first, kept = {}, {}
    for i, t in rows:
        for p, line in enumerate(t.split("\n")):
            if line.strip():
                first.setdefault(line, (i, p))
    gone = {a for a in first for b in first if first[b] < first[a] and max(len(a), len(b)) >= lines.NEAR_CHARS and near(a, b)}
    for i, t in rows:
        kept[i] = "\n".join(x for p, x in enumerate(t.split("\n")) if not x.strip() or (x not in gone and first[x] == (i, p)))
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == kept and "".join(kept.values()).count("All rights reserved.") == 1


@pytest.mark.parametrize("hot", [False, True])
def test_line_dedup_of_several_edits(spark, hot):
    """Every pair within the edits that its longer line allows is found, at all lengths and around those where one more is allowed, in small groups and large ones."""
    rnd = random.Random(11 + hot)
    some = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    head = some(1000)

    def edited(line, k):
        for _ in range(k):
            at, kind = rnd.randrange(len(line)), rnd.randrange(3)
            line = line[:at] + ("" if kind == 0 else rnd.choice("xyz")) + line[at + (kind < 2):]
        return line

    pool = []
    for n in (26, 40, 50, 51, 52, 53, 80, 101, 102, 103, 104, 105, 150, 205, 206, 207, 208, 209, 300, 413, 415, 416, 420, 700, 833):
        for _ in range(1 if hot else 4):
            line = head[: n * 2 // 3] + some(n - n * 2 // 3) if hot else some(n)
            pool += [line, *(edited(line, k) for k in range(1, 9))]
        if hot:
            pool += [head[: n * 2 // 3] + some(n - n * 2 // 3) for _ in range(12)]
            pool += [head[:n // 2] + some(4) + head[n // 2 + 4 : n] for _ in range(8)]
    rnd.shuffle(pool)
    pool = list(dict.fromkeys(x.strip(" ") + "." for x in pool))
    table = spark.createDataFrame([(i, "\n".join(pool[i : i + 5])) for i in range(0, len(pool), 5)], "doc_id long, text string")
    with connect(SF) as db:
        db.execute("create table l as select unnest($1) as x, unnest($2) as i", [pool, list(range(len(pool)))])
        near = db.execute("""select a.x, b.x, levenshtein(a.x, b.x) from l a, l b where a.i > b.i and abs(length(a.x) - length(b.x)) <= 6 and levenshtein(a.x, b.x) <= 6""").fetchall()
    gone = {a for a, b, d in near if d <= lines.edits(max(len(a), len(b)))}
    assert len({a for a, b, d in near if d > 1 and d <= lines.edits(max(len(a), len(b)))}) > 100 and {d for a, b, d in near if d <= lines.edits(max(len(a), len(b)))} >= {1, 2, 3, 4, 5}
    got = {x for r in lines.dedup_lines(table).collect() for x in r["text"].split("\n")}
    assert {x for x in pool if x not in gone} == got - {""}


@pytest.mark.parametrize("seed", range(3))
def test_banded_edit_distance(seed):
    rnd = random.Random(seed)
    for _ in range(300):
        a, b = ("".join(rnd.choice("ab") for _ in range(rnd.randint(0, 9))) for _ in "12")
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prior, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                prior, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, prior + (x != y))
        assert all(lines.within(a, b, k) == (d[-1] <= k) for k in range(4)), (a, b)


def test_chat(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [(-1, 0, "user", said), (-1, 1, "assistant", said), (1, 0, "system", "be [ROLE] kind <\\/s>"), (1, 1, "user", None), (1, 2, "assistant", "[\\\\INST] é 日本 "),
            (2, 0, "tool", ""), (2, 0, "tool", ""), (3, 0, "assistant", "first"), (3, 1, "assistant", ""), (4, 0, None, "no role"), (5, 0, "user", "long " * 20_000)]
    turns = clash(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    path = tokenizer_file("byte_bpe_50k.tiktoken")
    got = {r["conv_id"]: r for r in chat.digests(turns, path).collect()}
    for conv in {r[0] for r in rows}:
        own = [(r or "", t or "") for c, _, r, t in rows if c == conv]
        loss = "".join(t for r, t in own if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(own), sha("".join(f"{a}\n{b}\n" for a, b in own)), len(loss), sha(loss))
        assert r["formatted_chars"] > sum(len(t) for _, t in own)
    assert chat.digests(turns.where("false"), path).count() == 0
    one = chat.format_conversations(turns.where("conv_id = -1"), path).first()
    assert sum(i >= chat.RESERVED for i in one["ids"]) == 4 and len(one["ids"]) == len(one["loss"])


def test_simhash(spark, small, empty):
    rows = sorted((r for r in corpus()), key=lambda r: -r[0])
    got = {r["doc_id"]: r for r in simhash.edited(small).collect()}
    assert len(got) == len(rows)
    for k, (i, t, *_) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest()), i
        after_mark = got[rows[(k + 1) % len(rows)][0]]["fingerprint"]
        assert got[i]["near_next"] == 1 - (int(got[i]["fingerprint"], 16) ^ int(after_mark, 16)).bit_count() / simhash.BITS
    marks = simhash.fingerprint(small.union(small))
    assert marks.select("doc_id", "fingerprint").distinct().count() == len(rows)
    assert simhash.edited(empty).count() == 0
    odd = docs(spark, [(5, "a b c", None, None), (5, "d e f", None, None), (None, "g h i", None, None), (5, "a b c", None, None)])
    assert sorted(r["doc_id"] or 0 for r in simhash.edited(odd).collect()) == [0, 5, 5, 5]
    one = simhash.edited(docs(spark, [(1, "some words to be edited", None, None)])).first()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"some words to be" + b"some wo").hexdigest()


@pytest.mark.parametrize("small", [64, 4])
def test_simhash_within(spark, small, monkeypatch):
    """Block tables against all pairs, also where many fingerprints share a key and are compared in tiles."""
    monkeypatch.setattr(simhash, "SMALL", small)
    monkeypatch.setattr(simhash, "TILE", 16)
    rnd = random.Random(4)
    base = rnd.getrandbits(128)
    marks = [rnd.getrandbits(128) for _ in range(30)] + [base] * 3
    for _ in range(60):
        marks.append(base ^ sum(1 << b for b in rnd.sample(range(128), rnd.randint(1, 4))))
    rows = [(i, f"{m:032x}") for i, m in enumerate(marks)]
    frame = spark.createDataFrame(rows, "doc_id long, fingerprint string")
    distinct = sorted({r[1] for r in rows})
    for radius, blocks in ((0, 2), (3, 2), (4, 3)):
        far = {(a, b): (int(a, 16) ^ int(b, 16)).bit_count() for a, b in combinations(distinct, 2)}
        want = {(a, b, d) for (a, b), d in far.items() if d <= radius}
        assert {(r["a"], r["b"], r["distance"]) for r in simhash.within(frame, radius, blocks).collect()} == want
    assert simhash.within(frame.where("false"), 3).count() == 0


def test_simhash_by_votes():
    """The vectorised votes against counting each bit."""
    texts = ["a b c d e", "a", "", "x y " * 400]
    import pyarrow as pa

    got = simhash.fingerprints(pa.array(texts))
    for t, row in zip(texts, got):
        data, offsets = textops.buffer(pa.array([t]))
        terms, _ = textops.shingles(*textops.words(data, offsets), simhash.WIDTH)
        bits = [int(2 * sum(int(textops.mix(np.array([x + np.uint64(half + 1)], dtype=np.uint64))[0]) >> b & 1 for x in terms) > len(terms)) for half in range(2) for b in range(64)]
        assert np.unpackbits(row, bitorder="little").tolist() == bits


@pytest.mark.parametrize("weights", [None, {"a": 1, "b": 3}])
def test_packing(spark, small, empty, weights):
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, packing.EOS if hasattr(packing, "EOS") else 2] for i, t, *_ in corpus()}
    pieces = packing.pack(small, path, weights).toPandas()
    for i, own in pieces.sort_values("start").groupby("doc_id"):
        at = 0
        for p in own.itertuples():
            assert p.start == at and p.doc_tokens == len(ids[i])
            assert p.ids_crc32 == zlib.crc32(np.array(ids[i][at : at + p.length], dtype="<u4").tobytes())
            at += p.length
        assert at == len(ids[i])
    assert set(pieces.doc_id) == set(ids)
    short = 0
    for _, own in pieces.sort_values("offset").groupby("sequence_id"):
        assert (own.offset == np.concatenate([[0], own.length.cumsum()[:-1]])).all()
        short += own.length.sum() < packing.WINDOW
        assert own.length.sum() <= packing.WINDOW
    assert short <= 1
    assert packing.pack(empty, path).count() == 0


def packed(totals, weights=None, window=packing.WINDOW, quantum=packing.QUANTUM, seed=1):
    """Pieces of random documents as (queue, document, offset, length, place), checked for gaps and cuts."""
    rnd = np.random.default_rng(seed)
    totals = np.array(totals, dtype=np.int64)
    start, n, queue = [], [], []
    for q, t in enumerate(totals.tolist()):
        at = 0
        while at < t:
            n.append(min(t - at, int(rnd.integers(1, 3000))))
            start.append(at)
            queue.append(q)
            at += n[-1]
    start, n, queue = (np.array(x, dtype=np.int64) for x in (start, n, queue))
    given = packing.plan(totals, None if weights is None else np.array(weights, dtype=float), quantum)
    doc, offset, length, place = packing.pieces(start, n, queue, totals, given, window, quantum)
    order = np.argsort(place)
    assert (place[order] == np.concatenate([[0], np.cumsum(length[order])[:-1]])).all() and length.sum() == totals.sum()
    assert (place // window == (place + length - 1) // window).all()
    order = np.lexsort((offset, doc))
    begins = np.diff(doc[order], prepend=-1) != 0
    assert (offset[order][begins] == 0).all() and (offset[order][1:] == (offset + length)[order][:-1])[~begins[1:]].all()
    return queue[doc], doc, offset, length, place


def test_packing_keeps_the_mixture():
    """At any time each queue is within a few quanta of its share; when one runs dry, the others share the rest."""
    totals, weights = [700_000, 200_000, 3, 300_000], [3, 1, 1, 0]
    queue, _, _, length, place = packed(totals, weights)
    dry = 200_000 * 4  # a and b by 3 to 1 until b is dry
    for end in range(4096, dry, 40_960):
        inside = np.minimum(np.maximum(end - place, 0), length)
        assert abs(inside[queue == 0].sum() - end * 3 / 4) <= 3 * packing.QUANTUM
    assert place[queue == 3].min() >= 890_000
    queue, _, _, length, place = packed([700_000, 200_000, 100_000])
    for end in range(4096, 1_000_000, 40_960):
        inside = np.minimum(np.maximum(end - place, 0), length)
        assert all(abs(inside[queue == q].sum() - end * share) <= 3 * packing.QUANTUM for q, share in enumerate((0.7, 0.2, 0.1)))


@pytest.mark.parametrize("queues", [10, 65, 200, 1000])
def test_packing_shares_with_any_number_of_queues(queues):
    """Until a queue is dry its share of what is packed is that of its weight, however many run dry before it."""
    rnd = np.random.default_rng(queues)
    totals, weights = rnd.integers(20_000, 200_000, queues), rnd.random(queues) + 0.2
    queue, _, _, length, place = packed(totals, weights)
    dry = totals // packing.QUANTUM * packing.QUANTUM / weights
    for k in np.argsort(dry)[:: max(1, queues // 12)]:
        t = dry[k]
        want = np.where(dry <= t, totals // packing.QUANTUM * packing.QUANTUM, t * weights)
        got = np.bincount(queue, weights=np.minimum(np.maximum(int(want.sum()) - place, 0), length), minlength=queues)
        assert np.abs(got - want).max() <= 14 * packing.QUANTUM
        assert got[k] >= 0.9 * want[k]


def test_packing_of_rare_and_many_sources():
    queue, doc, offset, length, place = packed([10_000_000, 1000])
    assert sorted(length[queue == 1])[1:] == [256, 256, 256] or len(length[queue == 1]) <= 6  # quanta, but for ends of documents
    rnd = np.random.default_rng(3)
    totals, weights = rnd.integers(2000, 20_000, 5000), rnd.random(5000) + 0.1
    queue, _, _, length, place = packed(totals, weights)
    # and until any later one is: those that are not dry keep to their weights, the others have given all
    for share in (0.2, 0.5, 0.9, 0.99):
        t = np.quantile(totals / weights, share)
        want = np.minimum(totals // packing.QUANTUM * packing.QUANTUM, np.floor(t * weights))
        end = int(want.sum())
        got = np.bincount(queue, weights=np.minimum(np.maximum(end - place, 0), length), minlength=5000)
        assert np.abs(got - want).max() <= 16 * packing.QUANTUM
    first_dry = (totals / weights).min()
    end = int(first_dry * weights.sum())  # until the first queue is dry all have their targets
    got = np.bincount(queue, weights=np.minimum(np.maximum(end - place, 0), length), minlength=5000)
    assert np.abs(got - first_dry * weights).max() <= 14 * packing.QUANTUM
    for seed in range(20):
        k = int(rnd.integers(1, 30))
        some = rnd.integers(0, 50_000, k)
        packed(some, seed=seed)
        packed(some, rnd.integers(0, 4, k), 100, 20, seed)


def test_division_beyond_64_bits():
    rnd = random.Random(1)
    for _ in range(500):
        a, c = rnd.randrange(10**12), rnd.randrange(1, 10**12)
        b = rnd.randrange(c + 1) + c
        assert packing.divide(np.array([a]), np.array([b]), np.array([c]))[0] == a * b // c
        assert packing.divide(np.array([-a]), np.array([b]), np.array([c]))[0] == -a * b // c


def test_packing_of_odd_rows(spark):
    """Null ids and repeated rows are documents of their own."""
    path = tokenizer_file("word_bpe_49k.json")
    rows = [(None, "one two", None, "a"), (None, None, None, None), (7, "same row", None, "b"), (7, "same row", None, "b"), (7, "other", None, "b")]
    got = packing.pack(docs(spark, rows), path).collect()
    assert sum(r["length"] for r in got) == sum(r["doc_tokens"] for r in got) and sorted(str(r["doc_id"]) for r in got) == ["7", "7", "7", "None", "None"]
    at = 0
    for r in sorted(got, key=lambda r: r["offset"]):
        assert r["offset"] == at
        at += r["length"]


def test_token_counts(spark, small, empty):
    """Against the unigram model of another library over the same pieces and scores, long texts and unknown characters too."""
    import sentencepiece
    from tokenizers import models

    path = tokenizer_file("piece_bpe_32k.model")
    file = sentencepiece.SentencePieceProcessor(model_file=path)
    model = models.Unigram([(file.id_to_piece(i), file.get_score(i)) for i in range(file.get_piece_size())], file.unk_id(), True)
    more = ["  a  b ", " ", "日本語 𝒳𝒳 \n\n x\t y", "▁a ▁", "a" * 5000, "𝒳" * 3000, "line\nline\r\n end "]
    rows = [*corpus(), *[(1000 + i, t, None, None) for i, t in enumerate(more)], (None, "no id", None, None), (None, "no id", None, None)]
    got = sorted((str(r["doc_id"]), r["n_tokens"]) for r in counting.token_counts(docs(spark, rows), path).collect())
    assert got == sorted((str(i), len(model.tokenize("▁" + t.replace(" ", "▁"))) if t else 0) for i, t, *_ in rows)
    assert counting.token_counts(empty, path).count() == 0


def test_token_counts_of_other_vocabularies():
    """Without byte pieces a run of unknown characters is one; ties go to the piece that begins first."""
    from tokenizers import models

    pieces = [("<unk>", 0.0), ("▁", -2.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -3.0), ("ba", -2.0), ("aab", -3.0)]
    counter, model = counting.Counter(pieces[1:], False), models.Unigram(pieces, 0, False)
    rnd = random.Random(6)
    texts = ["".join(rnd.choice("ab xy") for _ in range(rnd.randint(1, 12))) for _ in range(400)]
    import pyarrow as pa

    assert counter.counts(pa.array(texts)).tolist() == [len(model.tokenize("▁" + t.replace(" ", "▁"))) for t in texts]
    with pytest.raises(ValueError):
        counting.Counter([("a▁b", -1.0)], False)


def test_known_hashes():
    known = textops.Known(3)
    assert known.add(np.array([5, 9], dtype=np.uint64), np.array([1, 2])) == 2 and known.add(np.array([1, 7], dtype=np.uint64), np.array([3, 4])) == 1
    assert known.get(np.array([1, 5, 7, 9, 11], dtype=np.uint64)).tolist() == [3, 1, -1, 2, -1]


def test_topk(spark):
    rnd = random.Random(5)
    rows = [(i, [rnd.randint(-3, 3) / 4 for _ in range(6)]) for i in range(400)] + [(500, None), (550, [None] * 6), (600, [float("nan")] * 6), (650, [float("inf")] * 6), (700, []), (50, [0.1] * 6)]
    rows += [rows[3], rows[3]]
    whole = sorted({(i, tuple(int(np.floor(256 * x)) for x in v)) for i, v in rows if v and None not in v and np.isfinite(v).all()})
    want = []
    for q in sorted({i for i, _ in whole if i % 50 == 0}):  # an id with two vectors asks with both
        scores = sorted((-sum(a * b for a, b in zip(qv, cv)), c) for i, qv in whole if i == q for c, cv in whole if c != q)
        want += [(q, k, -s, c) for k, (s, c) in enumerate(scores[:5], 1)]
    frame = clash(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = [(r["query_id"], r["rank"], r["score"], r["vec_id"]) for r in topk.search(frame, 50, 5).orderBy("query_id", "rank").collect()]
    assert got == want and sum(i == 50 for i, _ in whole) == 2
    assert topk.search(frame.where("false"), 50, 5).count() == 0
    few = spark.createDataFrame([(50, [1.0, 2.0]), (51, [3.0, 1.0]), (100, [1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.search(few, 50, 5).collect()] == [(50, 1, 51, 5 * 256 * 256)]


def test_topk_over_blocks(spark, monkeypatch):
    """Small blocks: bars are carried from the first to all others; many ties."""
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "QUERIES", 8)
    monkeypatch.setattr(topk, "PART", 32)
    rnd = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rnd.integers(-2, 3, 8)]) for i in range(700)]
    got = [(r["query_id"], r["score"], r["vec_id"]) for r in topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 10, 5).orderBy("query_id", "rank").collect()]
    want = []
    for q, qv in rows[::10]:
        scores = sorted((-int(np.dot(qv, cv)) * 65536, c) for c, cv in rows if c != q)
        want += [(q, -s, c) for s, c in scores[:5]]
    assert got == want


def shingle_set(t):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def test_components_with_hub(spark):
    """A hub with most of the links, random links and a long path, against union by smallest node."""
    rnd = random.Random(1)
    links = [(0, i) for i in range(1, 2000)] + [(rnd.randrange(5000, 7000), rnd.randrange(5000, 7000)) for _ in range(1200)] + [(i, i + 1) for i in range(10000, 10040)]
    root = {}

    def find(v):
        while root.setdefault(v, v) != v:
            v = root[v]
        return v

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {v: find(v) for a, b in links if a != b for v in (a, b)}
    assert {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_beside(spark):
    """An aggregate over all rows of a key, for a key with more rows than parts, repeated rows and no rows."""
    rows = [(0, i) for i in range(3000)] + [(1, 7), (1, 7), (2, 5)]
    df = spark.createDataFrame(rows, "k long, v long")
    got = beside(df, ["k"], ["v"], F.count(F.lit(1)), F.sum, "n").collect()
    assert sorted((r["k"], r["v"], r["n"]) for r in got) == sorted((k, v, {0: 3000, 1: 2, 2: 1}[k]) for k, v in rows)
    assert beside(df.where("k > 5"), ["k"], ["v"], F.min("v"), F.min, "m").count() == 0


def test_jaccard(spark, small, empty):
    sets = {i: shingle_set(t) for i, t, *_ in corpus()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar(small).collect()}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}
    assert len({c for _, c in got.values()}) < len(got)
    assert jaccard.similar(empty).count() == 0
    odd = docs(spark, [(None, "a b c d e f", None, None), (1, "a b c d e f", None, None), (1, "g h i j k", None, None), (2, "g h i j k", None, None)])
    assert sorted(map(tuple, jaccard.similar(odd).collect()), key=str) == sorted([(None, 2, None), (1, 2, 1), (1, 1, 1), (2, 1, 1)], key=str)


def least_miss(sizes, target):
    """The least distance to the target of any choice of 0 to 3 copies a document."""
    sums = 1
    for n in sizes:
        sums |= sums << n | sums << 2 * n | sums << 3 * n
    near = int(target)
    return next(d for d in range(near + 2) if sums >> max(0, near - d) & 1 or sums >> near + 1 + d & 1) + 1


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_mixing_is_near(spark, sf):
    got = queries.op9_mixing(spark, f"/root/testdata/{sf}").toPandas()
    for _, own in got.groupby("source", dropna=False):
        miss = abs(own.taken.sum() - own.target.iloc[0])
        assert miss <= 0.05 * own.target.iloc[0] or miss <= least_miss(own["size"], own.target.iloc[0])
    assert (got.copies <= 3).all() and (got.copies >= 0).all()


def test_mixing_beyond_the_largest(spark, monkeypatch):
    """Fewer documents with whole copies: the rest is spread over the others, ties at the bound included."""
    monkeypatch.setattr(mixing, "HEAD", 3)
    rows = docs(spark, [(i, "w " * n, "en", s) for s in "abcd" for i, n in enumerate([900, 500, 40, 40, 40, 40, *range(1, 60), 0, 0])])
    got = mixing.mix(rows).toPandas()
    assert len(got) == 4 * 67 and (got.taken <= 3 * got["size"]).all()
    for _, own in got.groupby("source"):
        assert abs(own.taken.sum() - own.target.iloc[0]) <= 60


def test_mixing(spark, small, empty):
    got = mixing.mix(small).toPandas()
    assert len(got) == len(corpus()) and (got.taken <= 3 * got["size"]).all()
    for source, own in got.groupby("source", dropna=False):
        assert own["size"].sum() == own.source_size.iloc[0] and own.target.iloc[0] <= 3 * own.source_size.iloc[0]
        # no more than the least that any choice of copies allows, or a twentieth, or a document of one word
        assert abs(own.taken.sum() - own.target.iloc[0]) <= max(least_miss(own["size"], own.target.iloc[0]), 0.05 * own.target.iloc[0], 1)
    assert abs(got.groupby("source", dropna=False).target.first().sum() - got["size"].sum()) < 1e-6
    columns = ["doc_id", "taken"]
    assert sorted(map(tuple, mixing.mix(small.repartition(5)).select(*columns).collect())) == sorted(map(tuple, got[columns].to_numpy().tolist()))
    assert mixing.mix(empty).count() == 0
    odd = docs(spark, [(None, "a b", None, "s"), (None, "a b", None, "s"), (1, None, None, "s"), (1, None, None, "s"), (2, "c", None, None), (3, "d e f", None, "")])
    again = mixing.mix(odd).toPandas()
    assert len(again) == 6 and (again.taken <= 3 * again["size"]).all() and again.target.notna().all()
    copies = mixing.replicate(small.select("doc_id", "text", "source")).count()
    assert copies == got.copies.sum()


def test_url_filter(spark):
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), (None, "/", "block")]
    urls = ["http://a.example.org/es/x", "http://EXAMPLE.org/en/12?q", "https://notexample.org/es/", "http://x.com/fr/", "http://x.com/de/#a", "x.com/de/", None, "", "http://com/de/",
            "http://org", "http://org/", "https://e.net/", "http://a.com:80/fr/", "http://example.org./es/", "ftp://q?x=http://b.com/fr/"]
    pages = clash(spark.createDataFrame([(i, u) for i, u in enumerate(urls * 2)], "page_id long, url string"))
    want = []
    for i, u in enumerate(urls * 2):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = rest.split("/")[0].split("?")[0].split("#")[0]
        path = rest[len(host):].split("?")[0].split("#")[0]
        host = host.lower()
        fits = [(len(h), len(p), h + p, v) for h, p, v in rules[:5] if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want.append((i, host, path, *(max(fits)[2:] if fits else (None, "allow"))))
    frame = spark.createDataFrame(rules, "host string, path string, verdict string")
    assert [tuple(r) for r in url_filter.filter_urls(pages, frame).orderBy("page_id").collect()] == want
    assert url_filter.filter_urls(pages.where("false"), frame).count() == 0
    assert url_filter.filter_urls(pages, frame.where("false")).count() == len(want)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracles(spark, name):
    same(queries.queries()[name](spark, SF).toPandas(), connect(SF).execute(queries.oracle_sql()[name]).df())


def test_workers_keep_no_other_operators_memory():
    """A tokenizer goes when another operator's task begins, and what a task let go of returns to the system."""
    import re
    from pathlib import Path

    def megabytes():
        return int(re.search(r"Pss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()).group(1)) / 1024

    def task(batches):
        yield from batches

    path = tokenizer_file("word_bpe_49k.json")
    task.__module__ = "fieldbook.llm.packing"
    assert list(job.frugal(task, iter([1]))) == [1] and tokens.word_tokenizer(path) is tokens.word_tokenizer(path)
    assert list(job.frugal(task, iter([1, 2]))) == [1, 2] and path in tokens._open
    task.__module__ = "fieldbook.llm.language"
    assert list(job.frugal(task, iter(range(20)))) == list(range(20)) and not tokens._open
    held = [bytearray(2000) for _ in range(50_000)]
    held[:] = held[::500]
    before = megabytes()
    assert list(job.frugal(task, iter([1]))) == [1] and megabytes() < before - 50


def test_line_dedup_reads_keys_once_for_all(spark):
    """Keys are those that two lines have and one is filed under, in few rows; blank lines and prefixes are as defined."""
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghijkl ") for _ in range(rnd.choice([20, 60, 110, 250])))
    pool = [word() for _ in range(60)]
    own = [*pool, *(x[:30] + "#" + x[30:] for x in pool), *(x[1:] for x in pool[:20]), " " * 70, " " * 9 + "y" * 60]
    texts = ["\n".join(rnd.choices(own, k=12)) for _ in range(60)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen = {}
    for text in texts:
        found = lines.Lines([text])
        assert found.blank.tolist() == [not x.strip() for x in text.split("\n")]
        assert (found.prefix == textops.rolling(lines.MIXED[np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)])).all()
        for at, key, _, _, shift, _ in found.seeds(np.flatnonzero(~found.blank)):
            for row, s in zip(key.tolist(), shift.tolist()):
                for k, x in zip(row, at.tolist()):
                    seen.setdefault(k, []).append((text.split("\n")[x], s == 0))
    want = {k for k, of in seen.items() if len({x for x, _ in of}) > 1 and any(f for _, f in of)}
    got = [r["key"] for r in lines.shared_seeds(table, 1).collect()]
    assert want and set(got) == want and len(got) == len(want)
