"""Filter interaction audit: what each of k filters removes at each step of every order, by contraction of count tensors.

Rows of a part are counted by which filters they fail: a tensor with an axis of two (pass, fail) per filter, one for the
rows themselves and one per kind of loss.  A filter's figures at a step need a selection of pass, fail or all along each
axis: earlier filters pass, the step's fails, later ones are free.  `numpy.einsum` contracts the tensors of a slice of
parts with these vectors; each selection is contracted once and used by all orders that share it.

Only counts are shuffled, combined before the shuffle: at most 2**k rows a part reach `audit`'s tasks, however many
documents a part has.  `repeats` finds copies by a digest of the text; a group of copies is dealt over many tasks.

Defined results: a null part is the empty string; a null failure is a pass and a null loss none; each repeated row counts;
a row with a null id repeats nothing and is repeated by none, and rows sharing the smallest id of a text are all first;
null texts are empty; very long texts are read whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fieldbook.llm.job import beside, cut, in_batches

PASSES, FAILS, ALL = np.array([1, 0]), np.array([0, 1]), np.array([1, 1])
#: Orders grow as the factorial of the filters.
MOST_FILTERS = 7
#: Parts whose tensors are contracted together.
PARTS_AT_ONCE = 16
SPACE = r"[\x20\x09-\x0D]+"
KEPT, REMOVED, REDUNDANT, UNIQUE, SHAPLEY = "kept", "removed", "redundant", "unique_fails", "shapley"


def plan(k: int) -> tuple[list[tuple[int, int]], np.ndarray, list[tuple[int, ...]]]:
    """The pairs (filter, set of earlier filters as bits), the pair at each step of each order, and all orders."""
    orders = list(permutations(range(k)))
    pairs: dict[tuple[int, int], int] = {}
    at = []
    for order in orders:
        earlier = 0
        for f in order:
            at.append(pairs.setdefault((f, earlier), len(pairs)))
            earlier |= 1 << f
    return list(pairs), np.array(at), orders


def contract(tensors: np.ndarray, k: int, pairs: list[tuple[int, int]]) -> dict[str, np.ndarray]:
    """Figures of all pairs: `tensors` is (part, measure, 2, ..., 2); each figure is (part, pair[, measure])."""
    axes = "".join(chr(ord("a") + i) for i in range(k))
    subscripts = f"YZ{axes}," + ",".join(axes) + "->YZ"
    known: dict[tuple[int, ...], np.ndarray] = {}
    vectors = (PASSES, FAILS, ALL)

    def select(some: list[int]) -> np.ndarray:
        key = tuple(some)
        if key not in known:
            known[key] = np.einsum(subscripts, tensors, *[vectors[s] for s in some], optimize=True)
        return known[key]

    out: dict[str, list[np.ndarray]] = {n: [] for n in (KEPT, REMOVED, REDUNDANT, UNIQUE)}
    for f, earlier in pairs:
        some = [0 if earlier >> i & 1 else 2 for i in range(k)]
        kept, removed = (select([s if i == f else x for i, x in enumerate(some)]) for s in (0, 1))
        out[KEPT].append(kept[:, 0])
        out[REMOVED].append(removed)
        out[REDUNDANT].append(select([1 if i == f else 2 for i in range(k)])[:, 0] - removed[:, 0])
        out[UNIQUE].append(select([1 if i == f else 0 for i in range(k)])[:, 0])
    return {n: np.stack(v, axis=1) for n, v in out.items()}


def audit(rows: DataFrame, part: str, filters: list[str], losses: dict[str, str]) -> DataFrame:
    """One row per part, order of the filters and step.

    `filters` are boolean columns, true where a row fails; their names, put together, name an order.  `losses` maps names
    of results to boolean columns; each counts the rows removed at the step where its column is true.
    """
    k = len(filters)
    if not 0 < k <= MOST_FILTERS or len(set(filters)) < k:
        raise ValueError(f"1 to {MOST_FILTERS} different filters")
    pairs, at, orders = plan(k)
    names = ["".join(filters[f] for f in order) for order in orders]
    truth = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("long")
    cell: Column = F.lit(0).cast("long")
    for i, f in enumerate(filters):
        cell = cell + truth(f) * (1 << i)
    measures = [F.count(F.lit(1)).alias("m0"), *[F.sum(truth(c)).alias(f"m{i}") for i, c in enumerate(losses.values(), 1)]]
    width = len(measures)
    counted = rows.withColumn("_cell", cell).withColumn("_part", F.coalesce(F.col(part), F.lit(""))).groupBy("_part", "_cell").agg(*measures)
    cells = counted.groupBy(F.col("_part").alias("part")).agg(F.collect_list(F.struct("_cell", F.array(*[f"m{i}" for i in range(len(measures))]).alias("m"))).alias("cells"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.array([math.factorial(e.bit_count()) * math.factorial(k - 1 - e.bit_count()) for _, e in pairs])
        own = np.array([[f == g for g, _ in pairs] for f in range(k)], dtype=np.int64) * weight
        letter = np.array([f for order in orders for f in order])
        for batch in batches:
            for start in range(0, batch.num_rows, PARTS_AT_ONCE):
                some = batch.slice(start, PARTS_AT_ONCE)
                tensors = np.zeros((some.num_rows, width, 1 << k), dtype=np.int64)
                for p, here in enumerate(some.column("cells").to_pylist()):
                    for c in here:
                        tensors[p, :, c["_cell"]] = c["m"]
                # the lowest bit is the last axis of the reshaped tensor
                tensors = tensors.reshape(some.num_rows, width, *[2] * k).transpose(0, 1, *range(k + 1, 1, -1))
                found = contract(tensors, k, pairs)
                removed = found[REMOVED]
                shapley = removed[:, :, 0] @ own.T
                n = len(at)
                columns = [some.column("part").take(pa.array(np.repeat(np.arange(some.num_rows), n))), pa.array(np.repeat(names, k).tolist() * some.num_rows),
                           pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), some.num_rows * len(orders))),
                           pa.array([filters[f] for f in letter] * some.num_rows)]
                figures = [found[KEPT][:, at], removed[:, at, 0], found[REDUNDANT][:, at], found[UNIQUE][:, at],
                           *[removed[:, at, m] for m in range(1, width)], shapley[:, letter]]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(x.ravel()) for x in figures]], names=schema_names)

    longs = [KEPT, REMOVED, REDUNDANT, UNIQUE, *losses, SHAPLEY]
    schema_names = ["part", "filter_order", "step", "filter", *longs]
    return in_batches(cells, task, "part string, filter_order string, step int, filter string, " + ", ".join(f"`{x}` long" for x in longs))


def repeats(rows: DataFrame, key: str, row_id: str, name: str) -> DataFrame:
    """Adds `name`: whether a row with a smaller id has the same (non-null) key."""
    spread = [row_id] if row_id in rows.columns else []
    return beside(rows, [key], spread, F.min(row_id), F.min, "_least").withColumn(name, F.coalesce(F.col(row_id) > F.col("_least"), F.lit(False))).drop("_least")


def text_failures(docs: DataFrame) -> DataFrame:
    """doc_id, part and the failures A to D of each text, with E where a smaller doc_id has the same text."""
    text = F.coalesce("text", F.lit(""))
    spaced = docs.select(F.col("doc_id").cast("long"), F.coalesce("source", F.lit("")).alias("part"), text.alias("text"))
    # the split is a column of its own, so that it is made once; a text without a word splits into one empty string
    split = spaced.withColumn("words", F.split(F.btrim("text", F.lit(" \t\n\x0b\x0c\r")), SPACE))
    count = lambda words: F.when(F.col("words")[0] == "", 0).otherwise(F.size(words)).cast("long")
    n, distinct = count("words"), count(F.array_distinct("words"))
    capitals = F.length(F.regexp_replace("text", "[^A-Z]", "")).cast("long")
    flagged = split.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), (n < 200).alias("A"), (100 * distinct < 50 * n).alias("B"),
                           (100 * capitals > 2 * F.length("text").cast("long")).alias("C"), F.col("text").rlike(r"[#$%&*|]").alias("D"))
    return repeats(flagged, "digest", "doc_id", "E").drop("digest")


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds good (some label of the id has quality 1) and toxic; ids are made unique first, and null ids meet no label."""
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = cut(rows)  # read twice from here on
    known, unknown = rows.where("doc_id is not null"), rows.where("doc_id is null")
    none = F.lit(None).cast("boolean")
    return known.join(marks, known.doc_id == marks["_id"], "left").drop("_id").unionByName(unknown.withColumns({"good": none, "toxic": none}))
