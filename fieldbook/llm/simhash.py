"""SimHash fingerprints of documents, and all fingerprints within a Hamming radius.

A text's terms are its three-word shingles (a shorter text is one term), each weighted by how often it occurs.  A
term's 128-bit hash votes for the sign of each bit; the fingerprint is 32 hex digits.  Votes are counted eight bits at
a time in the lanes of 64-bit integers, so a slice of a partition is a few passes over arrays.

`edited` also fingerprints each text with its tail replaced by the head of the next document, in descending doc_id.
Rows are partitioned by ranges of doc_id and read in order as a stream, so no task sees more than its range and memory
is one slice.  The last row of a range needs the first of the range that follows: each task gives these two rows out as
they are, with the range's number, and each last row is joined with the first one of the next range that has rows, so
that no task has more than its share of them.

`within` finds pairs of fingerprints in permuted block tables: with radius + t blocks, t at least are equal in any such
pair, so each fingerprint is filed under every choice of t blocks.  A key shared by more than `SMALL` fingerprints is not
paired off by a join: they are dealt to tiles of at most two times `TILE`, which are spread over tasks, and of a tile only
the pairs within the radius come out.

Defined results: a null text is empty; an empty text has the fingerprint of all zeros; equal texts have equal
fingerprints; a single document is its own next; rows with the same doc_id are ordered by a hash of the text, a null
doc_id comes last; repeated rows are each other's next; very long texts are read whole; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from fieldbook.llm import textops
from fieldbook.llm.job import cut, in_batches

BITS = 128
WIDTH = 3
#: Fingerprints of one key that are paired off by a join, and fingerprints on a side of a tile.
SMALL, TILE = 64, 1024

# a byte's bits as eight one-byte counters
_LANES = np.packbits(np.zeros((256, 64), dtype=np.uint8), axis=1).view(np.uint64).ravel()
for _k in range(8):
    _LANES = _LANES | (((np.arange(256, dtype=np.uint64) >> np.uint64(_k)) & np.uint64(1)) << np.uint64(8 * _k))


def fingerprints(texts: pa.Array) -> np.ndarray:
    """One row of BITS / 8 bytes per text."""
    data, offsets = textops.buffer(texts)
    terms, counts = textops.shingles(*textops.words(data, offsets), WIDTH)
    out = np.zeros((len(texts), BITS // 8), dtype=np.uint8)
    if not len(terms):
        return out
    # blocks of at most 255 terms of one text, so that no counter overflows
    some = np.flatnonzero(counts)
    n, first = counts[some], (np.cumsum(counts) - counts)[some]
    blocks = -(-n // 255)
    block_of = np.repeat(np.arange(len(some)), blocks)
    inner = np.arange(len(block_of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    starts = first[block_of] + 255 * inner
    text_starts = np.cumsum(blocks) - blocks
    for half in range(BITS // 64):
        octets = textops.mix(terms + np.uint64(half + 1)).view(np.uint8).reshape(-1, 8)
        for k in range(8):
            votes = np.add.reduceat(_LANES[octets[:, k]], starts).view(np.uint8).reshape(-1, 8)
            ones = np.add.reduceat(votes.astype(np.int64), text_starts)
            out[some, half * 8 + k] = np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").ravel()
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1.0 - np.bitwise_count(a ^ b).sum(axis=1) / BITS


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textops.slices(batch, "text"):
                marks = [x.tobytes().hex() for x in fingerprints(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(marks, type=pa.string())], names=["doc_id", "fingerprint"])

    return in_batches(docs.select("doc_id", "text"), task, "doc_id long, fingerprint string")


OUT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
       "near_edited double, near_next double")


NAMES = [c.split()[0] for c in OUT.split(", ")]


def _compared(ids: list, texts: list[str]) -> pa.RecordBatch:
    """The result for all rows but the last, which is only the next of the one before."""
    marks = fingerprints(pa.array(texts, type=pa.string()))
    edited = [t[: len(t) - len(t) // 3] + after[: len(t) // 3] for t, after in zip(texts, texts[1:])]
    changed = fingerprints(pa.array(edited, type=pa.string()))
    return pa.RecordBatch.from_arrays([
        pa.array(ids[:-1], type=pa.int64()), pa.array([len(t) for t in texts[:-1]], type=pa.int64()),
        pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], type=pa.string()),
        pa.array([m.tobytes().hex() for m in marks[:-1]], type=pa.string()), pa.array([x.tobytes().hex() for x in changed], type=pa.string()),
        pa.array(likeness(marks[:-1], changed)), pa.array(likeness(marks[:-1], marks[1:]))], names=NAMES)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a range in order; its first and its last row come as they are, with `edge` 0 and 1 and the range's number."""
    number = TaskContext.get().partitionId()

    def row(edge: int, doc_id, text: str) -> pa.RecordBatch:
        values = [doc_id, *[None] * (len(NAMES) - 1), edge, number, text]
        return pa.RecordBatch.from_arrays([pa.array([v], type=t) for v, t in zip(values, kinds)], names=[*NAMES, "edge", "range", "text"])

    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2, pa.int32(), pa.int32(), pa.string()]
    last: tuple | None = None
    for batch in batches:
        for part in textops.slices(batch, "text"):
            ids, texts = (part.column(c).to_pylist() for c in ("doc_id", "text"))
            if last is None:
                yield row(0, ids[0], texts[0])
            else:
                ids, texts = [last[0], *ids], [last[1], *texts]
            last = ids[-1], texts[-1]
            if len(ids) > 1:
                done = _compared(ids, texts)
                yield pa.RecordBatch.from_arrays([*done.columns, *[pa.nulls(done.num_rows, t) for t in kinds[-3:]]], names=[*NAMES, "edge", "range", "text"])
    if last is not None:
        yield row(1, *last)


def edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness (see OUT for the columns)."""
    docs = docs.select("doc_id", F.xxhash64("text").alias("tie"), F.coalesce("text", F.lit("")).alias("text"))
    order = (F.col("doc_id").desc_nulls_last(), F.col("tie"))
    ranges = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    found = cut(in_batches(ranges, _stream, OUT + ", edge int, range int, text string"))
    # the last row of a range is followed by the first row of the next range that has any, the very last by the very first
    firsts, lasts = found.where("edge = 0").select(F.col("range").alias("_next"), F.col("text").alias("after")), found.where("edge = 1").select("range", "doc_id", "text")
    every = Window.orderBy("range")  # numbers of ranges only
    follows = found.where("edge = 0").select("range").withColumn("_next", F.coalesce(F.lead("range").over(every), F.first("range").over(every)))
    pairs = lasts.join(follows, "range").join(firsts, "_next").select("doc_id", "text", "after")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text, after in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text", "after")]):
                yield _compared([doc_id, None], [text, after])

    return found.where("edge is null").select(*NAMES).union(in_batches(pairs, task, OUT))


def within(marks: DataFrame, radius: int, blocks: int = 2) -> DataFrame:
    """Pairs (a, b, distance) of different fingerprints within `radius` bits, a < b, each once; `blocks` equal ones make a key.

    A key is about BITS * blocks / (radius + blocks) bits wide: it should be wider than the logarithm of the number of
    fingerprints.  Equal fingerprints are one entry, so copies do not multiply.
    """
    n = radius + blocks
    cuts = [round(i * BITS / n) for i in range(n + 1)]
    bits = F.concat(*[F.lpad(F.conv(F.substring("fingerprint", 1 + 8 * i, 8), 16, 2), 32, "0") for i in range(4)])
    keys = F.array(*[F.xxhash64(F.lit(t), *[F.substring("bits", cuts[i] + 1, cuts[i + 1] - cuts[i]) for i in some]) for t, some in enumerate(combinations(range(n), blocks))])
    filed = marks.select("fingerprint").distinct().withColumn("bits", bits).select("fingerprint", F.explode(keys).alias("key"))
    sizes = filed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    live = cut(filed.join(sizes, "key"))
    rare = live.where(F.col("size") <= SMALL).select("key", "fingerprint")
    left, right = rare.withColumnRenamed("fingerprint", "a"), rare.withColumnRenamed("fingerprint", "b")
    words = lambda c: [F.conv(F.substring(c, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    distance = sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(words("a"), words("b"))), F.lit(0)).cast("int")
    few = left.join(right, "key").where("a < b").select("a", "b", distance.alias("distance"))
    sides = F.ceil(F.col("size") / TILE)
    tiles = (live.where(F.col("size") > SMALL).withColumn("side", F.pmod(F.xxhash64("fingerprint"), sides))
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), sides - 1)))
             .select("key", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "fingerprint"))

    def task(rows: pa.Table) -> pa.Table:
        side, other = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
        names = np.array(rows.column("fingerprint").to_pylist())
        values = np.array([np.frombuffer(bytes.fromhex(x), dtype=np.uint64) for x in names])
        here = np.flatnonzero(rows.column("side").to_numpy() == side)
        there = here if side == other else np.flatnonzero(rows.column("side").to_numpy() == other)
        far = np.bitwise_count(values[here][:, None] ^ values[there][None]).sum(axis=2, dtype=np.int32)
        x, y = np.nonzero((far <= radius) & (side != other or np.arange(len(here))[:, None] < np.arange(len(there))))
        columns = [pa.array(names[here[x]].tolist(), type=pa.string()), pa.array(names[there[y]].tolist(), type=pa.string()), pa.array(far[x, y])]
        return pa.table(columns, names=["x", "y", "distance"])

    found = tiles.groupBy("key", "i", "j").applyInArrow(task, "x string, y string, distance int")
    many = found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance")
    return few.where(F.col("distance") <= radius).union(many).distinct()
