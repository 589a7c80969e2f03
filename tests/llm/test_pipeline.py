"""Each stage on its predecessor's rows."""

import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldbook.llm import jaccard, language, lines, mixing, packing, pipeline
from fieldbook.llm.job import tokenizer_file

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, docs.count()
    sizes = {"documents": rows}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        sizes[name] = docs.count()
        if name != "sequence_packing":
            assert docs.columns == columns
        if name == "language_id":
            clean = before.where("length(text) > 100").count()
            assert docs.where("length(text) > 100").count() >= 0.9 * clean and docs.where(docs.lang == language.UNKNOWN).count() == 0
        if name == "near_duplicates":
            components = jaccard.similar(before).select("component_id").distinct().count()
            assert sizes[name] == components and jaccard.similar(docs).where("component_id <> doc_id").count() == 0
        if name == "source_mixing":
            assert sizes[name] == mixing.mix(before).agg({"copies": "sum"}).first()[0]
        if name == "sequence_packing":
            assert docs.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()
    assert sizes["documents"] >= sizes["language_id"] >= sizes["line_dedup"] >= sizes["near_duplicates"] > 0


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
        docs = out if name != "sequence_packing" else docs


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, one id with two texts, and names that stages use inside."""
    long = "\n".join(f"a long text has line number {i} of very many" for i in range(4000))
    near = " ".join(f"word{i}" for i in range(60))
    rows = [(1, near, "en", "a", 1), (2, near + " more", "en", "a", 2), (3, near.upper(), None, None, None), (4, near, "de", "b", 4), (4, near, "de", "b", 4), (5, None, None, None, None), (6, "", "en", "a", 0),
            (7, " \n\t ", "en", None, 4), (8, long, "en", "c", len(long)), (9, long + "\nand an end", None, "c", None), (None, near, "en", "a", 9), (None, None, None, None, None), (10, "1 2 3", "en", "b", 5),
            (11, "one text of this id", "en", "b", 7), (11, "another text of this id", "en", "b", 7), (12, "said twice\nsaid twice\nsaid once", "en", "a", 5), (13, "said twice\nnew here", "en", "b", 5),
            (14, "this line has more than thirty letters\nx", "en", "a", 5), (15, "this line has more than thirty letterz\ny", "en", "a", 5), (16, "日本語 の 文 です", None, "d", 3), (17, "x", "en", "d", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return frame.withColumns({c: F.lit(1) for c in ("n_lines", "n_removed", "size", "copies", "queue", "ids", "n", "at", "component_id", "lang_pred", "score", "_mark")}).cache()


def taken(frame):
    return sorted((tuple(r) for r in frame.select(*COLUMNS).collect()), key=repr)


def test_language_stage_on_odd_rows(spark, odd):
    """Rows with a letter stay if they are short or score enough; the language found takes the place of what was said."""
    out = pipeline.language_id(spark, odd, SF)
    assert tuple(out.columns) == COLUMNS
    found = language.identify(odd.select(*COLUMNS), language.train(odd.select(*COLUMNS)), COLUMNS).collect()
    want = [(r["doc_id"], r["text"], r["lang_pred"], r["source"], r["n_chars"]) for r in found if r["lang_pred"] != "und" and (r["score"] >= 0.25 or len(r["text"]) < 200)]
    assert taken(out) == sorted(want, key=repr)
    lettered = [r for r in odd.collect() if any(c.isalpha() for c in r["text"] or "")]
    assert {r[0] for r in taken(out)} >= {r["doc_id"] for r in lettered if len(r["text"]) < 200} and not {5, 6, 7, 10} & {r[0] for r in taken(out)}


def test_line_stage_on_odd_rows(spark, odd):
    """In order of documents and places, later equal or nearly equal lines go; documents of which only blank ones are left go too."""
    rows = sorted({tuple(r[c] for c in COLUMNS) for r in odd.collect() if r["doc_id"] is not None and r["text"]}, key=lambda r: (r[0], lines_mark(spark, r[1])))
    seen, left = {}, {}
    for key, text in [((r[0], r[1]), r[1]) for r in rows]:
        for place, line in enumerate(text.split("\n")):
            if line.strip():
                seen.setdefault(line, (key, place))
    firsts = list(seen)
    rank = {x: i for i, x in enumerate(firsts)}
    short = [x for x in firsts if "number" not in x]
    gone = {b for a, b in combinations(sorted(short, key=rank.get), 2) if max(len(a), len(b)) >= lines.NEAR_CHARS and lines.within(a, b, 1)}
    numbered = [x for x in firsts if "number" in x]
    by_rest = {}
    for x in sorted(numbered, key=rank.get):  # one edit apart: equal but for one place, or one letter more
        keys = {x[:i] + "?" + x[i + 1 :] for i in range(len(x))} | {x[:i] + "?" + x[i:] for i in range(len(x) + 1)}
        if any(k in by_rest for k in keys):
            gone.add(x)
        for k in keys:
            by_rest.setdefault(k, x)
    want = []
    for r in odd.collect():
        row = tuple(r[c] for c in COLUMNS)
        if row[0] is None or not row[1]:
            want.append((*row[:4], None if row[1] is None else len(row[1])))
            continue
        kept = [x for p, x in enumerate(row[1].split("\n")) if not x.strip() or (x not in gone and seen[x] == ((row[0], row[1]), p))]
        text = "\n".join(kept)
        if text == row[1] or text.strip(" "):
            want.append((row[0], text, row[2], row[3], len(text)))
    assert taken(pipeline.line_dedup(spark, odd, SF)) == sorted(want, key=repr)


def lines_mark(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(F.xxhash64("t")).first()[0]


def shingled(text):
    words = [w.lower() for w in WORDS.findall(text or "")]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_duplicate_stage_on_odd_rows(spark, odd):
    """Of each group linked at 80 % the smallest id stays with all its texts; equal rows once, rows without an id all."""
    rows = [tuple(r[c] for c in COLUMNS) for r in odd.collect()]
    known = [r for r in rows if r[0] is not None]
    parent = {r[0]: r[0] for r in known}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [(r[0], shingled(r[1])) for r in known]
    for (i, a), (j, b) in combinations(sets, 2):
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            low, high = sorted((root(i), root(j)))
            parent[high] = low
    want = list({r for r in known if root(r[0]) == r[0]}) + [r for r in rows if r[0] is None]
    assert taken(pipeline.near_duplicates(spark, odd, SF)) == sorted(want, key=repr)
    assert {8, 1} <= {r[0] for r in want} and not {2, 3, 4, 9} & {r[0] for r in want}


def test_mixing_stage_on_odd_rows(spark, odd):
    """Every row as often as the mix says, and near the targets."""
    out = taken(pipeline.source_mixing(spark, odd, SF))
    plan = mixing.mix(odd).collect()
    size = lambda t: len(WORDS.findall(t or ""))
    want, got = Counter(), Counter((r[0], r[3], size(r[1])) for r in out)
    for r in plan:
        want[r["doc_id"], r["source"], r["size"]] += r["copies"]
    assert got == +want and set(out) <= {tuple(r[c] for c in COLUMNS) for r in odd.collect()}
    for source in {r["source"] for r in plan}:
        own = [r for r in plan if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(1, 0.05 * own[0]["target"], min((r["size"] for r in own if r["size"]), default=0))


def test_packing_stage_on_odd_rows(spark, odd):
    """Every id of every row in one piece, windows without gaps, one short window at most."""
    from tokenizers import Tokenizer

    out = pipeline.sequence_packing(spark, odd, SF).collect()
    tokenizer = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    want, got = Counter(), Counter()
    for r in odd.collect():
        want[r["doc_id"]] += len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1
    for r in out:
        got[r["doc_id"]] += r["length"]
    assert got == want
    windows = {}
    for r in out:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in windows.values():
        ends = np.cumsum([n for _, n in sorted(own)])
        assert [a for a, _ in sorted(own)] == [0, *ends[:-1]] and ends[-1] <= packing.WINDOW
    assert sum(sum(n for _, n in own) < packing.WINDOW for own in windows.values()) <= 1
