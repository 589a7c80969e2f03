"""N-gram Jaccard self-join by a token-group matrix: groups of documents that reach 80 % of common shingles.

A document is the set of its distinct five-word shingles, as 64-bit hashes.

1. Equal sets are one class, represented by the smallest doc_id; only representatives go on.
2. Similar documents are partitioned into groups: documents with an equal key of minimum hashes are compared with the
   first of them, and the connected ones are a group; all others are groups of one.
3. The token-group matrix has an entry for each token that is among the first tokens of a member of a group.  A set's
   first tokens, in an order common to all, are as many as it can lack at 80 % and one more, so a linked pair has one in
   common.  A document is a query to the groups (other than its own, each pair of groups once) whose members' sizes are
   near enough and that its first tokens hit so often that, if all later tokens were common, 80 % could be reached.
4. A qualifying group is stored as blocks of members with the union of their tokens.  The union's overlap with the query
   bounds the overlap with any member; only where it reaches 80 % of the query is the block opened, and each member
   compared exactly.
5. Components of all links, by smallest doc_id.

Nothing is lost to a cap: a pair is skipped only if both are in one group already.  The order puts tokens that are
frequent in a sample of documents last, which keeps common passages out of the first tokens; the links do not depend on
it.  Large groups are compared in blocks of bounded size, spread over tasks; a fixed-size bitmap of doc_ids spares the
shuffle the sets that no comparison needs (a false hit costs traffic, nothing else).

Defined results: a null or empty text has no shingles and is a component of its own; a text of one to four words is one
shingle; rows with the same doc_id are one node; a row with a null doc_id has a null component; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fieldbook.llm import textops
from fieldbook.llm.components import components
from fieldbook.llm.job import beside, bitmap, cut, in_batches, marked, released

WIDTH = 5
PERCENT = 80
#: Keys by which documents may be grouped, each of several minimum hashes.
KEYS, HASHES = 4, 3
BLOCK = 1024
#: The share of documents looked at for frequent shingles, how often there makes one frequent, and how many are kept.
SAMPLE, OFTEN, MOST = 0.05, 3, 100_000
#: Bits of the bitmap of doc_ids.
BITMAP = 1 << 23


def sets(texts: pa.Array, frequent: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """All texts' distinct shingles end to end, in the common order, and how many each text has."""
    data, offsets = textops.buffer(texts)
    tokens, counts = textops.shingles(*textops.words(data, offsets), width)
    row = np.repeat(np.arange(len(counts)), counts)
    late = np.isin(tokens, frequent) if len(frequent) else np.zeros(len(tokens), dtype=bool)
    # the hash's own top bits give way to the text's place and the lateness: 46 bits decide the order, ties do not matter
    key = (row.astype(np.uint64) << np.uint64(47)) | (late.astype(np.uint64) << np.uint64(46)) | (tokens >> np.uint64(18))
    order = np.argsort(key, kind="stable")
    tokens, row, key = tokens[order], row[order], key[order]
    same = np.zeros(len(tokens), dtype=bool)
    same[1:] = (key[1:] == key[:-1]) & (tokens[1:] == tokens[:-1])
    if (key[1:] == key[:-1]).sum() != same.sum():  # equal keys of different tokens: sort them out exactly
        order = np.lexsort((tokens, key))
        tokens, row, key = tokens[order], row[order], key[order]
        same[1:] = (key[1:] == key[:-1]) & (tokens[1:] == tokens[:-1])
    tokens, row = tokens[~same], row[~same]
    return tokens, np.bincount(row, minlength=len(counts))


def needed(n: np.ndarray) -> np.ndarray:
    """The smallest overlap of a set of n with any linked one."""
    return -(-n * PERCENT // 100)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in textops.slices(batch, "text"):
            for at in range(0, part.num_rows, 100_000):
                yield part.slice(at, 100_000)


def _binary(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = (np.concatenate([[0], np.cumsum(counts)]) * values.itemsize).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(values)]).cast(pa.binary())


def _longs(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values.view(np.int64)))


def frequent_tokens(docs: DataFrame) -> np.ndarray:
    """Shingles that are frequent among the documents of a sample; at most MOST."""
    none = np.zeros(0, dtype=np.uint64)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            tokens, _ = sets(part.column("text"), none)
            yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64))], names=["token"])

    few = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(SAMPLE * 1_000_000)).select("text")
    counted = in_batches(few, task, "token long").groupBy("token").count().where(F.col("count") >= OFTEN)
    rows = released(counted.orderBy(F.col("count").desc(), "token").limit(MOST).select("token")).collect()
    return np.sort(np.array([r[0] for r in rows], dtype=np.int64).view(np.uint64))


def features(docs: DataFrame) -> DataFrame:
    """doc_id, n (distinct shingles), two hashes of the set, and KEYS hashes of its minimum hashes."""
    none = np.zeros(0, dtype=np.uint64)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            tokens, counts = sets(part.column("text"), none)
            full = np.flatnonzero(counts)
            starts = (np.cumsum(counts) - counts)[full]
            marks = [np.zeros(len(counts), dtype=np.uint64) for _ in range(2 + KEYS)]
            if len(full):
                with np.errstate(over="ignore"):
                    marks[0][full] = np.add.reduceat(textops.mix(tokens), starts)
                    marks[1][full] = np.add.reduceat(textops.mix(tokens ^ np.uint64(0x5851F42D4C957F2D)), starts)
                for k in range(KEYS):
                    for h in range(HASHES):
                        seed = textops.mix(np.array([k * HASHES + h + 77], dtype=np.uint64))[0]
                        marks[2 + k][full] = textops.mix(marks[2 + k][full] + np.minimum.reduceat(textops.mix(tokens ^ seed), starts))
            keys = np.stack(marks[2:], axis=1).ravel()
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(counts.astype(np.int64)), pa.array(marks[0].view(np.int64)), pa.array(marks[1].view(np.int64)),
                 _longs(keys, np.full(len(counts), KEYS))], names=["doc_id", "n", "sum_a", "sum_b", "keys"])

    return in_batches(docs.select("doc_id", "text"), task, "doc_id long, n long, sum_a long, sum_b long, keys array<long>")


def _kept(docs: DataFrame, ids: DataFrame):
    """docs (doc_id, spot, text) and a function that keeps the rows of a batch whose id may be among `ids`."""
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(ids, ["doc_id"], BITMAP))
    spotted = docs.where("doc_id is not null").select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(BITMAP)).alias("spot"), "text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            there = marked(bits.value, batch.column("spot").to_numpy())
            if there.any():
                yield batch.filter(pa.array(there))

    return spotted, keep


def token_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and tokens (sorted 64-bit hashes) of the documents in ids (and a few more)."""
    spotted, keep = _kept(docs, ids)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(keep(batches)):
            tokens, counts = sets(part.column("text"), np.zeros(0, dtype=np.uint64))
            full = pa.array(counts > 0)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), _binary(tokens, counts)], names=["doc_id", "tokens"]).filter(full)

    return in_batches(spotted, task, "doc_id long, tokens binary")


def first_tokens(docs: DataFrame, ids: DataFrame, frequent: np.ndarray) -> DataFrame:
    """doc_id, n and first tokens of the documents in ids (and a few more)."""
    spotted, keep = _kept(docs, ids)
    late = docs.sparkSession.sparkContext.broadcast(frequent)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(keep(batches)):
            tokens, n = sets(part.column("text"), late.value)
            some = np.where(n > 0, n - needed(n) + 1, 0)
            starts = np.cumsum(n) - n
            at = np.repeat(starts, some) + np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n.astype(np.int64)), _longs(tokens[at], some)],
                                             names=["doc_id", "n", "first"])

    return in_batches(spotted, task, "doc_id long, n long, first array<long>")


def _open_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) found in cells: rows sorted by (cell, block, asks); members come before the queries."""
    here: object = None
    members: list[tuple[int, np.ndarray]] = []
    index: tuple[np.ndarray, ...] | None = None
    found: list[tuple[int, int]] = []
    for batch in batches:
        for cell, block, asks, doc, raw in zip(*[batch.column(c).to_pylist() for c in ("cell", "block", "asks", "doc_id", "tokens")]):
            if (cell, block) != here:
                here, members, index = (cell, block), [], None
            tokens = np.frombuffer(raw, dtype=np.uint64)
            if not asks:
                members.append((doc, tokens))
                continue
            if not members:
                continue
            if index is None:
                sizes = np.array([len(t) for _, t in members])
                every = np.concatenate([t for _, t in members])
                order = np.argsort(every, kind="stable")
                union, starts = np.unique(every[order], return_index=True)
                index = (sizes, union, np.append(starts, len(every)), np.repeat(np.arange(len(members)), sizes)[order])
            sizes, union, starts, owner = index
            at = np.minimum(np.searchsorted(union, tokens), len(union) - 1)
            hit = at[union[at] == tokens]
            if len(hit) < needed(np.int64(len(tokens))):  # no member can reach the threshold: the block stays closed
                continue
            n = starts[hit + 1] - starts[hit]
            where = np.repeat(starts[hit] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            common = np.bincount(owner[where], minlength=len(sizes))
            for m in np.flatnonzero(100 * common >= PERCENT * (sizes + len(tokens) - common)).tolist():
                if members[m][0] != doc:
                    found.append((doc, members[m][0]))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], type=pa.int64()) for i in (0, 1)], names=["a", "b"])
            found = []


def compare(docs: DataFrame, cells: DataFrame) -> DataFrame:
    """Links between the members (asks = 0) and the queries (asks = 1) of each (cell, block); cells has doc_id."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cells.join(token_sets(docs, cells.select("doc_id")), "doc_id")
    in_order = rows.repartition(parts, "cell", "block").sortWithinPartitions("cell", "block", "asks")
    return in_batches(in_order.select("cell", "block", "asks", "doc_id", "tokens"), _open_blocks, "a long, b long")


def _each(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), n - 1))


def stars(marks: DataFrame) -> DataFrame:
    """Cells of documents with an equal minimum hash and the first of them; queries in blocks of about BLOCK."""
    slots = marks.select("doc_id", "n", F.posexplode("keys").alias("k", "key"))
    heads = (slots.groupBy("k", "key").agg(F.min(F.struct("doc_id", "n")).alias("head"), F.count(F.lit(1)).alias("size")).where("size > 1")
             .select("k", "key", F.col("head.doc_id").alias("cell"), F.col("head.n").alias("m")))
    near = (F.least("n", "m") * 100 >= F.greatest("n", "m") * PERCENT)
    asked = slots.join(heads, ["k", "key"]).where((F.col("doc_id") != F.col("cell")) & near).select("doc_id", "cell").distinct()
    blocks = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("blocks"))
    dealt = beside(asked, ["cell"], ["doc_id"], F.count(F.lit(1)), F.sum, "size").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("long"))
    queries = (dealt.select("doc_id", "cell", F.pmod(F.xxhash64("doc_id"), "blocks").alias("block"), F.lit(1).alias("asks")))
    return queries.unionByName(blocks.select(F.col("cell").alias("doc_id"), "cell", _each(F.col("blocks")).alias("block"), F.lit(0).alias("asks")))


def matrix_cells(first: DataFrame, groups: DataFrame) -> DataFrame:
    """Cells of the groups that a document's first tokens hit: all members in blocks, and the queries."""
    parts = int(first.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = first.select("doc_id", "n", F.explode("first").alias("token")).repartition(parts, "token")
    shared = rows.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("token")
    entries = rows.join(shared, "token")
    labelled = cut(entries.join(groups, "doc_id", "left").withColumn("home", F.coalesce("grp", "doc_id")).select("token", "doc_id", "n", "home"))
    matrix = labelled.groupBy("token", F.col("home").alias("cell")).agg(F.min("n").alias("low"), F.max("n").alias("high"))
    near = (F.col("low") * PERCENT <= F.col("n") * 100) & (F.col("high") * 100 >= F.col("n") * PERCENT)
    hits = (labelled.join(matrix, "token").where((F.col("home") > F.col("cell")) & near).groupBy("doc_id", "n", "cell")
            .agg(F.count(F.lit(1)).alias("hits"), F.min("low").alias("low"), F.max("high").alias("high")))
    # all of a pair's first tokens up to the end of one side are known, so its overlap is at most the hits and the rest
    # of that side; n + m shingles with 80 % in common overlap by 80 / 180 of n + m at least
    rest = F.ceil(F.greatest("n", F.least("high", F.floor(F.col("n") * 100 / PERCENT))) * PERCENT / 100) - 1
    least = (F.col("n") + F.greatest("low", F.ceil(F.col("n") * PERCENT / 100))) * PERCENT / (100 + PERCENT)
    asked = cut(hits.where(F.col("hits") + rest >= least - 1e-6).select("doc_id", "cell"))
    wanted = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / (4 * BLOCK)).cast("long").alias("sides"))
    sizes = groups.groupBy(F.col("grp").alias("cell")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("blocks"))
    wanted = wanted.join(sizes, "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    whole = wanted.join(groups.withColumnRenamed("grp", "cell"), "cell", "left").withColumn("doc_id", F.coalesce("doc_id", "cell"))
    members = (whole.select("doc_id", "cell", "blocks", F.pmod(F.xxhash64("doc_id"), "blocks").alias("b"), _each(F.col("sides")).alias("side"))
               .select("doc_id", "cell", (F.col("side") * F.col("blocks") + F.col("b")).alias("block"), F.lit(0).alias("asks")))
    queries = (asked.join(wanted, "cell").select("doc_id", "cell", "blocks", F.pmod(F.xxhash64("doc_id"), "sides").alias("side"), _each(F.col("blocks")).alias("b"))
               .select("doc_id", "cell", (F.col("side") * F.col("blocks") + F.col("b")).alias("block"), F.lit(1).alias("asks")))
    return members.unionByName(queries)


def similar(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    marks = cut(features(docs))
    kept = marks.where("n > 0 and doc_id is not null")
    classes = kept.groupBy("n", "sum_a", "sum_b").agg(F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys"))
    classes = cut(classes)
    near = cut(compare(docs, stars(classes)))
    groups = cut(components(near).select(F.col("node").alias("doc_id"), F.col("component").alias("grp")))
    first = first_tokens(docs, classes, frequent_tokens(docs))
    first = cut(first.join(classes.select("doc_id").distinct(), "doc_id", "left_semi"))
    links = near.union(compare(docs, matrix_cells(first, groups)))
    # rows of one doc_id with different texts: their classes are linked through that id
    same = kept.join(classes.select("n", "sum_a", "sum_b", F.col("doc_id").alias("rep")), ["n", "sum_a", "sum_b"]).select("doc_id", "rep").distinct()
    same = cut(same)
    twice = same.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c"), F.min("rep").alias("b")).where("c > 1").join(same, "doc_id").select(F.col("rep").alias("a"), "b")
    named = components(links.union(twice))
    of = same.join(named.withColumnRenamed("node", "rep"), "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("component_id"))
    return (marks.select("doc_id", F.col("n").alias("n_shingles")).join(of, "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")))
