"""Mixture-controlled packing: deficit round-robin over source queues, with a quantum and carried deficits.

Each source is a queue of its documents' token ids (each document ends with `EOS`).  Queues are served in quanta of
`QUANTUM` ids, which divides the window.  A queue's claim grows with every id that is packed, by its weight; while it is
below a quantum it is kept as the queue's deficit, over windows and partitions alike, so a rare source is not crumbled:
its quanta come whole, in every so many windows.  When a queue runs dry, the others share what it would have had.

The order of service has a closed form, so it needs no sequential pass.

1. A phase ends where a queue runs dry; in it each other queue gives the quanta of its weight (see `plan`).  There may be
   as many phases as queues.
2. In a phase the queues are the leaves of a balanced binary tree.  A node that has n quanta, l of them from its left
   side, takes its i-th from the left if floor((i + 1) l / n) > floor(i l / n): either side is within one quantum of its
   share at all times, and both end with the node.  A queue is thus within as many quanta of its share as the tree is
   deep.
3. Going up from a leaf, each step turns a quantum's place on one side into its place in the node, by one division.  A
   task that knows where a document begins in its queue therefore finds the window of each of its quanta by itself.
4. What is left of each queue, less than a quantum, is packed at the end, queue by queue.

All windows are full but the last.  A document's pieces end where the document, a quantum or a window ends; quanta that
follow each other in a window are one piece.

One row per source (its name and total) reaches the driver and every task: sources are a dimension, not data.

Defined results: a null text is only the end id; a null source is a queue of its own; rows with a null doc_id and
repeated rows are documents of their own; very long documents are cut over many windows; sources without a weight, or
with a weight of 0, are packed after all others, by their totals; an empty table gives no pieces; other columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fieldbook.llm import textops, tokens
from fieldbook.llm.job import before, cut, in_batches

WINDOW = 4096
QUANTUM = 256
#: Ids of a queue that one task puts in order, and the fewest tasks that a queue is dealt to.
CHUNK_IDS, CHUNKS = 16_000_000, 512


def tokenize(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, source, ids (little-endian, as narrow as the vocabulary allows) and n of every row."""
    kind = tokens.width(path)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokens.word_tokenizer(path)
        for batch in batches:
            for part in textops.slices(batch, "text"):
                ids, n = tokenizer.encode(part.column("text"))
                flat = np.insert(ids, np.cumsum(n), tokens.EOS).astype(kind)
                offsets = (np.concatenate([[0], np.cumsum(n + 1)]) * flat.itemsize).astype(np.int64)
                blob = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("source"), blob.cast(pa.binary()), pa.array(n + 1)],
                                                 names=["doc_id", "source", "ids", "n"])

    return in_batches(docs.select("doc_id", "source", "text"), task, "doc_id long, source string, ids binary, n long")


def divide(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """floor(a * b / c) where the product may be beyond 64 bits: an estimate, put right by the wrapped remainder."""
    estimate = np.floor(a.astype(np.float64) * b / c).astype(np.int64)
    with np.errstate(over="ignore"):
        rest = a * b - estimate * c
    return estimate + rest // c


class Plan(NamedTuple):
    """When queues run dry: `times` are the different ones in order, `dry` each queue's, with its weight and quanta."""

    times: np.ndarray
    dry: np.ndarray
    weights: np.ndarray
    quanta: np.ndarray

    @property
    def phases(self) -> int:
        """A phase ends where a queue runs dry; queues without a weight come after all others."""
        return len(self.times) + bool(((self.weights <= 0) & (self.quanta > 0)).any())

    def given(self, phase: np.ndarray | int, queue: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Quanta that queues have given when `phase` phases are over."""
        phase, quanta, weights = np.asarray(phase), self.quanta[queue], self.weights[queue]
        if not len(self.times):
            return np.where(phase > 0, quanta, 0)
        t = self.times[np.clip(phase - 1, 0, len(self.times) - 1)]
        served = np.minimum(np.floor(np.minimum(t * weights, 2.0**62)).astype(np.int64), quanta)
        done = (self.dry[queue] <= t) | (phase >= len(self.times))
        some = np.where(weights > 0, np.where(done, quanta, served), 0)
        return np.where(phase > len(self.times), quanta, np.where(phase > 0, some, 0))


def plan(totals: np.ndarray, weights: np.ndarray | None = None, quantum: int = QUANTUM) -> Plan:
    """By default a queue's weight is its total, so all run dry together: one phase.  Else queues of weight w and n quanta
    run dry at the times n / w.
    """
    quanta = totals // quantum
    weights = np.where(totals > 0, totals, 0).astype(np.float64) if weights is None else np.asarray(weights, dtype=np.float64)
    some = (quanta > 0) & (weights > 0)
    dry = np.divide(quanta, weights, out=np.zeros(len(quanta)), where=some)
    times = np.unique(dry[some])
    if len(times) and np.ptp(quanta[some] - weights[some] * times[-1]) < 1:
        times = times[-1:]  # they differ by less than a quantum
    return Plan(times, dry, np.where(some, weights, 0.0), quanta)


def places(order: Plan, queue: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """The place among all quanta of the nth quantum of a queue, for each pair.

    Its phase is found by halving; what queues give in a phase is worked out where a quantum of it is asked for, so the
    number of phases is not bounded and memory grows with the queues alone.
    """
    out = np.zeros(len(nth), dtype=np.int64)
    phase, above = np.zeros(len(nth), dtype=np.int64), np.full(len(nth), order.phases)  # the last with given <= nth
    while (above - phase > 1).any():
        middle = (phase + above) // 2
        fits = order.given(middle, queue) <= nth
        phase, above = np.where(fits, middle, phase), np.where(fits, above, middle)
    by_phase = np.argsort(phase, kind="stable")
    for some in np.split(by_phase, np.flatnonzero(np.diff(phase[by_phase])) + 1) if len(nth) else []:
        before_it, after_it = order.given(int(phase[some[0]])), order.given(int(phase[some[0]]) + 1)
        counts = after_it - before_it
        sums = np.concatenate([[0], np.cumsum(counts)])
        leaf, at = np.unique(queue[some], return_inverse=True)
        low, high = np.zeros(len(leaf), dtype=np.int64), np.full(len(leaf), len(counts))
        path: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while (high - low > 1).any():
            inner = high - low > 1
            mid = np.where(inner, (low + high) // 2, high)
            left = leaf < mid
            path.append((left, sums[mid] - sums[low], sums[high] - sums[mid]))
            low, high = np.where(left, low, mid), np.where(left, mid, high)
        place = nth[some] - before_it[queue[some]]
        for left, l, r in reversed(path):
            from_left, l, r = left[at], np.maximum(l[at], 1), r[at]
            n = l + r
            # ceil((place + 1) n / l) - 1 from the left, floor(place n / r) from the right
            up = np.where(from_left, -divide(-(place + 1), n, l) - 1, divide(place, n, np.maximum(r, 1)))
            place = np.where(from_left & (r == 0), place, up)
        out[some] = before_it.sum() + place
    return out


def pieces(start: np.ndarray, n: np.ndarray, queue: np.ndarray, totals: np.ndarray, order: Plan, window: int = WINDOW,
           quantum: int = QUANTUM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, offset in it, length, place in the stream) of each piece of documents at `start` of their queues."""
    quanta = totals // quantum
    end = start + n
    # quanta that the document touches; the queue's rest counts as one more
    first, last = start // quantum, (end - 1) // quantum
    many = last - first + 1
    doc = np.repeat(np.arange(len(n)), many)
    nth = np.repeat(first, many) + np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    low = np.maximum(nth * quantum, start[doc])
    high = np.minimum((nth + 1) * quantum, end[doc])
    rest = nth >= quanta[queue[doc]]
    place = np.zeros(len(doc), dtype=np.int64)
    whole = np.flatnonzero(~rest)
    place[whole] = places(order, queue[doc[whole]], nth[whole]) * quantum
    rests = totals - quanta * quantum
    place[rest] = quanta.sum() * quantum + (np.cumsum(rests) - rests)[queue[doc[rest]]]
    place += low - nth * quantum
    # the rests at the end may cross a window
    crossing = place // window != (place + (high - low) - 1) // window
    if crossing.any():
        split = np.where(crossing, window - place % window, 0)
        at = np.repeat(np.arange(len(doc)), 1 + crossing)
        second = np.zeros(len(at), dtype=bool)
        second[np.flatnonzero(np.diff(at, prepend=-1) == 0)] = True
        doc, cut_at = doc[at], low[at] + split[at]
        low, high = np.where(second, cut_at, low[at]), np.where(crossing[at] & ~second, cut_at, high[at])
        place = place[at] + np.where(second, split[at], 0)
    # pieces that go on where the one before ends, in its window, are one
    same = np.zeros(len(doc), dtype=bool)
    same[1:] = (doc[1:] == doc[:-1]) & (place[1:] == place[:-1] + high[:-1] - low[:-1]) & (place[1:] % window != 0)
    begins = np.flatnonzero(~same)
    return doc[begins], (low - start[doc])[begins], np.add.reduceat(high - low, begins) if len(begins) else begins, place[begins]


def pack(docs: DataFrame, path: str, weights: dict[str, float] | None = None, window: int = WINDOW, quantum: int = QUANTUM) -> DataFrame:
    """All pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and source."""
    if window % quantum:
        raise ValueError("the quantum must divide the window")
    spark, kind = docs.sparkSession, tokens.width(path)
    rows = cut(tokenize(docs, path)).withColumn("queue", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")))
    found = sorted((r["queue"], r["n"]) for r in rows.groupBy("queue").agg(F.sum("n").alias("n")).collect())
    totals = np.array([n for _, n in found], dtype=np.int64)
    chosen = np.array([weights.get(q[1:], 0.0) if q[0] == "=" else 0.0 for q, _ in found]) if weights else None
    shared = spark.sparkContext.broadcast(({q: i for i, (q, _) in enumerate(found)}, totals, plan(totals, chosen, quantum)))
    chunks = max(CHUNKS, int(totals.max(initial=0)) // CHUNK_IDS)
    placed = before(rows, ["queue"], ["doc_id", "ids"], "n", "at", F.pmod(F.xxhash64("doc_id", "ids"), F.lit(chunks)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, totals, order = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                queue = np.array([number[q] for q in part.column("queue").to_pylist()], dtype=np.int64)
                n = part.column("n").to_numpy()
                doc, start, length, place = pieces(part.column("at").to_numpy(), n, queue, totals, order, window, quantum)
                raw = part.column("ids").to_pylist()
                sums, last, ids = [], -1, memoryview(b"")
                for d, a, k in zip(doc.tolist(), (4 * start).tolist(), (4 * length).tolist()):
                    if d != last:
                        last, ids = d, memoryview(np.frombuffer(raw[d], dtype=kind).astype("<u4").tobytes())
                    sums.append(zlib.crc32(ids[a : a + k]))
                of = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(of), pa.array(start), pa.array(length), pa.array(sums, type=pa.int64()), pa.array(n[doc]),
                     pa.array(place // window), pa.array(place % window), part.column("source").take(of)],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"])

    return in_batches(placed.select("doc_id", "source", "queue", "ids", "n", "at"), task,
                      "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string")
