"""Runs of repeated words: maximal pairs of each text's LCP-interval tree, with lists of positions by left word.

A run is a stretch of words with smallest period q, at least `least` words and 2 * q long, that no neighbouring word
extends keeping period q.  Words q apart being equal, the run of length L beginning at s is a pair of positions s and
s + q that share exactly L - q words and differ in the words before them: a maximal pair at a distance of at most the
words it shares.  So runs are found without extending anything:

1. Words get numbers.  Only a text in which some `least` / 2 words occur twice can have a run; others are done.
2. Suffixes are ordered by prefix doubling, whose ranks also give the words that neighbours in this order share.
3. The tree of intervals sharing at least `least` / 2 words is walked from its leaves up.  A node keeps its positions in
   order, and in lists by the word to their left.  Where children meet in an interval that shares d words, the smaller one's
   positions look among the larger one's for others within d words that have another left word, through the window or
   through the lists, whichever is shorter; then the smaller is merged into the larger.
4. A pair at a multiple of the period gives the same stretch: the smallest period stays.

Each text is one task's work and nothing is shuffled.  Memory is bounded by a text: about four bytes for each of its words
and each doubling up to its longest repeat.

Defined results: a null or empty text and one without words have no run and the empty text left; repeated rows are done
each; texts are read whole; of overlapping runs each counts; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fieldbook.llm import textops
from fieldbook.llm.job import in_batches

LEAST = 12
_ODD = np.uint64(0x9E3779B97F4A7C15)
RUNS = "array<struct<start:long,length:long,period:long>>"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

Node = tuple[list[int], dict[int, list[int]]]


def numbered(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))


def repetitive(ids: np.ndarray, width: int) -> bool:
    """Whether some `width` words may occur twice (hashed: never wrongly false)."""
    n = len(ids) - width + 1
    if n < 2:
        return False
    codes, keys = textops.mix(ids.astype(np.uint64) + np.uint64(1)), np.zeros(n, dtype=np.uint64)
    for k in range(width):
        keys = keys * _ODD + codes[k : k + n]
    keys.sort()
    return bool((keys[1:] == keys[:-1]).any())


def suffixes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the order of their suffixes, and the words that each suffix shares with the one before (0 for the first)."""
    n = len(ids)
    ranks = [np.append(np.unique(ids, return_inverse=True)[1], -1).astype(np.int32)]
    step = 1
    while ranks[-1].max() < n - 1:
        now = ranks[-1].astype(np.int64)
        after = np.full(n, -1, dtype=np.int64)
        after[: max(n - step, 0)] = now[step:n]
        ranks.append(np.append(np.unique(now[:n] * (n + 1) + after + 1, return_inverse=True)[1], -1).astype(np.int32))
        step *= 2
    order = np.argsort(ranks[-1][:n])
    here, there = order[:-1].copy(), order[1:].copy()
    for level in range(len(ranks) - 1, -1, -1):
        same = (ranks[level][here] == ranks[level][there]).astype(np.int64) << level
        here += same
        there += same
    return order, np.concatenate([[0], there - order[1:]])


def _meet(one: Node, other: Node, shared: int, left: list[int], least: int, found: dict[tuple[int, int], int]) -> Node:
    """Pairs between two children of an interval, and the children as one node."""
    if len(one[0]) < len(other[0]):
        one, other = other, one
    places, lists = one
    for word, some in other[1].items():
        for x in some:
            low, high = bisect_left(places, x - shared), bisect_right(places, x + shared)
            if low == high:
                continue
            if high - low <= len(lists):
                near = [y for y in places[low:high] if left[y] != word]
            else:
                near = [y for w, ys in lists.items() if w != word for y in ys[bisect_left(ys, x - shared) : bisect_right(ys, x + shared)]]
            for y in near:
                period = abs(x - y)
                if shared + period >= least:
                    key = (x if x < y else y, shared + period)
                    if found.get(key, period) >= period:
                        found[key] = period
    for word, some in other[1].items():
        mine = lists.get(word)
        if mine is None:
            lists[word] = some
        elif len(some) == 1:
            insort(mine, some[0])
        else:
            mine.extend(some)
            mine.sort()
    if len(other[0]) == 1:
        insort(places, other[0][0])
    else:
        places.extend(other[0])
        places.sort()
    return one


def runs(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a text's word numbers, by start, then period."""
    floor = max(1, -(-least // 2))
    if not repetitive(ids, floor):
        return []
    order, shared = suffixes(ids)
    left = [-1, *ids[:-1].tolist()]
    found: dict[tuple[int, int], int] = {}
    # intervals of suffixes that share `floor` words lie between smaller values
    deep = np.append(shared[1:] >= floor, False)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], deep.astype(np.int8)])))
    for first, last in zip(edges[::2].tolist(), edges[1::2].tolist()):
        places, depths = order[first : last + 1].tolist(), [*shared[first + 1 : last + 1].tolist(), -1]
        stack: list[tuple[int, Node]] = []
        for place, depth in zip(places, depths):
            node: Node = ([place], {left[place]: [place]})
            while stack and stack[-1][0] > depth:
                d, sibling = stack.pop()
                node = _meet(sibling, node, d, left, least, found)
            if stack and stack[-1][0] == depth:
                stack[-1] = (depth, _meet(stack[-1][1], node, depth, left, least, found))
            elif depth >= 0:
                stack.append((depth, node))
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def collapse(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: a word in any run behind that run's first period goes."""
    edges = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in found:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:n]) == 0


def detect(docs: DataFrame, ids: tuple[str, ...] = ("doc_id",), text: str = "text", least: int = LEAST) -> DataFrame:
    """The columns `ids` of every row, n_words, its runs, and `collapsed`: the words that stay, joined by single spaces."""
    named = docs.select(*[F.col(c).alias(f"id{i}") for i, c in enumerate(ids)], F.col(text).alias("text"))
    schema = ", ".join(f"id{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(ids))
    names = [*[f"id{i}" for i in range(len(ids))], "n_words", "runs", "collapsed"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textops.slices(batch, "text"):
                counts, every, left = [], [], []
                for whole in part.column("text"):
                    words = (whole.as_py() or "").encode().split()  # of bytes: at the six ASCII spaces only
                    found = runs(numbered(words), least)
                    counts.append(len(words))
                    every.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                    if found:
                        stays = collapse(len(words), found)
                        words = [w for w, stay in zip(words, stays.tolist()) if stay]
                    left.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays([*[part.column(f"id{i}") for i in range(len(ids))], pa.array(counts, type=pa.int64()),
                                                  pa.array(every, type=_RUNS), pa.array(left, type=pa.string())], names=names)

    out = in_batches(named, task, f"{schema}, n_words long, runs {RUNS}, collapsed string")
    return out.withColumnsRenamed({f"id{i}": c for i, c in enumerate(ids)})


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and each text, with the repeats that the query's contract plants by doc_id (none for a null doc_id)."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g, few = F.floor(h / 10), F.coalesce(h % 10 == 0, F.lit(False))
    text = F.coalesce("text", F.lit(""))
    split = (docs.select("doc_id", text.alias("text"))
             .withColumn("words", F.when(few, F.split(F.btrim("text", F.lit(" \t\n\x0b\x0c\r")), r"[\x20\x09-\x0D]+")))
             .withColumn("n", F.size("words")).withColumn("a", (g % F.col("n")).cast("int"))
             .withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8))).cast("int")))
    again = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))
    changed = F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(again, F.lit(1), F.col("n") - F.col("a")))
    return split.select("doc_id", F.when(few, F.array_join(changed, " ")).otherwise(F.col("text")).alias("text"))
