"""SimHash near-dedup by an index of bytes at their positions, with count filtering.

A fingerprint has eight bytes.  Fingerprints that differ in at most `RADIUS` = 4 bits differ in at most four bytes, so they
share four bytes at least: the tally of shared positional bytes must reach four, and those that do are verified bit by bit.

The index's lists are keyed by bytes at their positions.  One byte alone selects a 256th of everything, which would make the
tally quadratic; so a list is entered by the first two bytes that two fingerprints share (with two more still to come
behind them), a list that is longer than `SMALL` is divided by the third, and again by the fourth.  Each pair that shares
four bytes meets in the list of its first two, three or four, so nothing is lost; each division only follows long lists.
Lists of four bytes that are still longer than `LARGE` hold fingerprints of 32 equal bits: their other 32 bits are divided
likewise into eight half-bytes, four of which are equal again, after which a list has at most 2**16 fingerprints.

Short lists are joined with themselves, and the tally and the bits are conditions of that join.  Long ones are dealt to
tiles of at most twice `TILE` fingerprints; of a tile comes a forest that connects what it links, not all pairs.  Equal
fingerprints are one entry, so exact copies cost nothing; a fingerprint held by very many rows is dealt over tasks.

Fingerprints: words are those of the bytes with A-Z lower-cased, terms the four-word shingles, repeats included, joined by
single spaces (a shorter text is one term); a bit is set if over half of the terms' XXH64 (seed 42) have it.

Defined results: a null or empty text has fingerprint zero and is linked like any other; texts are read whole, in pieces
of bounded size; rows of one doc_id are one node; a row with a null doc_id has a null component and links nothing; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from fieldbook.llm import textops
from fieldbook.llm.components import components
from fieldbook.llm.job import PARTS, beside, cut, in_batches

WIDTH, SEED, RADIUS = 4, 42, 4
#: Longest list that is joined with itself, longest list of four bytes that is dealt to tiles, and fingerprints on a side of a tile.
SMALL, LARGE, TILE = 64, 16_384, 1024
#: Terms hashed together.
TERMS = 100_000

# a byte's bits as eight counters of one byte
_COUNTERS = np.array([int.from_bytes(bytes(v >> k & 1 for k in range(8)), "little") for v in range(256)], dtype=np.uint64)


def majority(text: str | None) -> int:
    """The fingerprint of a text."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z only, and at the six ASCII spaces only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter((len(w) for w in words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - WIDTH + 1)
    starts, ends = starts[:n], ends[-n:]
    ones = np.zeros(64, dtype=np.int64)
    hashed, seed = xxhash.xxh64_intdigest, SEED
    for at in range(0, n, TERMS):
        some = [hashed(joined[s:e], seed) for s, e in zip(starts[at : at + TERMS].tolist(), ends[at : at + TERMS].tolist())]
        octets = np.array(some, dtype=np.uint64).view(np.uint8).reshape(-1, 8)
        blocks = np.arange(0, len(octets), 255)
        for k in range(8):
            sums = np.add.reduceat(_COUNTERS[octets[:, k]], blocks)
            ones[8 * k : 8 * k + 8] += sums.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, a signed 64-bit number, of every row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.fromiter((majority(t.as_py()) for t in batch.column("text")), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(marks.view(np.int64))], names=["doc_id", "fp"])

    return in_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), task, "doc_id long, fp long")


def _mask(places: tuple[int, ...], width: int) -> int:
    """Bits of the parts at `places`, each `width` bits wide."""
    return sum(((1 << width) - 1) << (width * p) for p in places)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def divisions() -> list[list[tuple[int, int]]]:
    """For each division of lists: the masks of the lists it makes, each with the mask of the list it divides."""
    out = []
    for n in (2, 3, 4):
        # the last byte chosen leaves room behind it for the rest of four
        some = [c for c in combinations(range(8), n) if c[-1] <= 7 - (4 - n)]
        out.append([(_signed(_mask(c[:-1], 8)) if n > 2 else 0, _signed(_mask(c, 8))) for c in some])
    halves = []
    for four in combinations(range(8), 4):
        rest = [h for p in range(8) if p not in four for h in (2 * p, 2 * p + 1)]
        halves += [(_signed(_mask(four, 8)), _signed(_mask(four, 8) | _mask(c, 4))) for c in combinations(rest, 4)]
    return [*out, halves]


def _tally(a: Column, b: Column) -> Column:
    """Bytes that two fingerprints share, place by place."""
    differ = a.bitwiseXOR(b)
    return sum((F.when(differ.bitwiseAND(F.lit(_signed(0xFF << 8 * k))) == 0, 1).otherwise(0) for k in range(8)), F.lit(0))


def _joined(short: DataFrame) -> DataFrame:
    """Pairs (a, b) of the lists that are short, by a join on the list whose conditions are the tally and the bits."""
    one, other = short.select("mask", "key", F.col("fp").alias("a")), short.select("mask", "key", F.col("fp").alias("b"))
    a, b = F.col("a"), F.col("b")
    near = (_tally(a, b) >= 8 - RADIUS) & (F.bit_count(a.bitwiseXOR(b)) <= RADIUS)
    return one.join(other, (one.mask == other.mask) & (one.key == other.key) & (a < b) & near).select("a", "b")


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of links between n nodes, a star for each set of nodes they connect."""
    least = np.arange(n)
    while True:
        low = np.minimum(least[a], least[b])
        before = least.copy()
        np.minimum.at(least, a, low)
        np.minimum.at(least, b, low)
        least = least[least]
        if (before == least).all():
            own = np.flatnonzero(least != np.arange(n))
            return own, least[own]


def _tiles(long: DataFrame) -> DataFrame:
    """Links of long lists: fingerprints are dealt to sides, and each pair of sides is a tile."""
    sides = F.ceil(F.col("size") / TILE)
    tiles = (long.withColumn("side", F.pmod(F.xxhash64("fp"), sides)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), sides - 1)))
             .select("mask", "key", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "fp"))

    def task(rows: pa.Table) -> pa.Table:
        marks = np.sort(rows.column("fp").to_numpy()).view(np.uint64)
        octets = marks.view(np.uint8).reshape(-1, 8)
        found_a, found_b = [], []
        for at in range(0, len(marks), 256):
            some = marks[at : at + 256, None] ^ marks[None, at:]
            shared = np.zeros(some.shape, dtype=np.uint8)
            for k in range(8):
                shared += octets[at : at + 256, k, None] == octets[None, at:, k]
            x, y = np.nonzero(shared >= 8 - RADIUS)
            near = (np.bitwise_count(some[x, y]) <= RADIUS) & (x < y)
            found_a.append(x[near] + at)
            found_b.append(y[near] + at)
        a, b = _forest(np.concatenate(found_a), np.concatenate(found_b), len(marks))
        return pa.table([pa.array(marks[a].view(np.int64)), pa.array(marks[b].view(np.int64))], names=["a", "b"])

    return tiles.groupBy("mask", "key", "i", "j").applyInArrow(task, "a long, b long")


def links(marks: DataFrame) -> DataFrame:
    """Links (a, b) that connect just the fingerprints of `marks` (fp) within RADIUS bits of each other, by any number of steps."""
    spark = marks.sparkSession
    lists = marks.select("fp", F.lit(0).cast("long").alias("mask")).distinct()
    found = []
    steps = divisions()
    for n, step in enumerate(steps):
        masks = F.broadcast(spark.createDataFrame(step, "mask long, finer long"))  # at most 70 * 70 rows
        finer = lists.join(masks, "mask").select("fp", F.col("finer").alias("mask"), F.col("fp").bitwiseAND(F.col("finer")).alias("key"))
        sized = cut(beside(finer, ["mask", "key"], ["fp"], F.count(F.lit(1)), F.sum, "size").where("size > 1"))
        found.append(_joined(sized.where(F.col("size") <= SMALL)))
        lists = sized.where(F.col("size") > SMALL)
        if n >= 2:  # four bytes at least
            last = n == len(steps) - 1
            found.append(_tiles(lists if last else lists.where(F.col("size") <= LARGE)))
            lists = lists.where(F.col("size") > LARGE)
        lists = lists.select("fp", "mask")
        if lists.isEmpty():
            break
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.distinct()


def similar(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id reachable by links) of every row."""
    marks = cut(fingerprints(docs))
    kept = marks.where("doc_id is not null").withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)))
    # a fingerprint's rows are met by part, so that no task has all rows of one
    parts = cut(kept.groupBy("fp", "_part").agg(F.min("doc_id").alias("least")))
    classes = cut(parts.groupBy("fp").agg(F.min("least").alias("rep")))
    near = links(classes)
    near = near.join(classes.select(F.col("fp").alias("a"), F.col("rep").alias("ra")), "a").join(classes.select(F.col("fp").alias("b"), F.col("rep").alias("rb")), "b")
    # rows of one doc_id with different texts: their classes are linked through that id
    owners = parts.join(classes, "fp").select("fp", "_part", "rep")
    twice = kept.groupBy("doc_id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high").select("doc_id")
    several = kept.join(twice, "doc_id", "left_semi").join(owners, ["fp", "_part"]).select("doc_id", "rep").distinct()
    same = beside(several, ["doc_id"], ["rep"], F.min("rep"), F.min, "least").select(F.col("rep").alias("a"), F.col("least").alias("b"))
    named = components(near.select(F.col("ra").alias("a"), F.col("rb").alias("b")).union(same))
    of = owners.join(named.withColumnRenamed("node", "rep"), "rep", "left").select("fp", "_part", F.coalesce("component", "rep").alias("component_id"))
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return (kept.join(of, ["fp", "_part"]).select("doc_id", shown, "component_id")
            .union(marks.where("doc_id is null").select("doc_id", shown, F.lit(None).cast("long"))))
