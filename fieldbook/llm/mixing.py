"""Mixing sources to target weights by systematic sampling.

Targets: each source's share of all words by weight, at most `most` times its own words; what a capped source gives up
is shared among the others by weight.  With sources sorted by most * size / weight the capped ones are a prefix, so
running sums over the (small) table of sources solve it without iteration.

Copies: within a source every document's expected copies are target / size, but for the `HEAD` largest ones.  These,
from the largest down, get the whole number of copies (0 to `most`) that brings the words taken so far nearest to what
their sizes call for, so the words by which a document misses are made up by smaller ones; what is left over at the end
is spread over the expected copies of all others.  Documents are laid out by size, their expected copies are added up,
one random offset per source is added, and a document is emitted once for each integer boundary that its stretch
crosses: a whole number of expected copies gives just these.  Expected copies are kept in fixed point, so reruns and
other engines agree to the last copy, and no document is emitted more than `most` times.  A source misses its target by
about half its smallest document if it has no more than `HEAD`, and otherwise by little more than one document that is
not among its `HEAD` largest, so by less than a `HEAD`th of its own words, whatever the offset.

The order is by size class (the length of the size in bits and its next `DETAIL` bits, so a class spans 1/16 of an
octave at most), then slice (of `SLICES`, by id), size and id.  The running sum over a source is therefore a rank, found
in two levels, and each size class of a source is spread over up to `SLICES` tasks, so a source with a third of all rows
is as well.

One row per source goes through one task in `targets`: sources are a dimension, not data.

Defined results: a null text has size 0; a source of size 0 has target 0 and takes nothing; null sources form one
source, the last; rows with a null doc_id come first among those of their size, and repeated rows are documents of their
own; an empty table gives an empty mix; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from fieldbook.llm.job import cut

WEIGHTS = (5, 2, 1)
BITS = 20
UNIT = 1 << BITS
DETAIL = 4
SLICES = 64
SEED = 20011
#: Documents of a source that get a whole number of expected copies: its largest ones.
HEAD = 128


def offset(source: Column, seed: int = SEED) -> Column:
    """The random offset of a source, below UNIT, drawn from the digest of the seed and its name (null as empty)."""
    return F.conv(F.left(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("")))), F.lit(BITS // 4)), 16, 10).cast("long")


def size_class(size: Column) -> Column:
    bits = F.length(F.bin(size))
    return bits * (1 << DETAIL) + F.floor(size / F.pow(F.lit(2.0), bits - 1 - DETAIL)).cast("int") % (1 << DETAIL)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """sizes (source, source_size; one row per source) with `target`, in words."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    s = sizes.withColumn("_w", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    by_cap = Window.orderBy(F.col("source_size") * most / F.col("_w"), F.col("source").asc_nulls_last())
    full = by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    prior = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    s = (s.withColumn("_cap", F.col("source_size") * most)
         .withColumn("_level", (F.sum("source_size").over(full) - F.coalesce(F.sum("_cap").over(prior), F.lit(0)))
                     / (F.sum("_w").over(full) - F.coalesce(F.sum("_w").over(prior), F.lit(0)))))
    # the first source whose cap is above the level ends the prefix of capped ones; its level holds for all later ones
    free = F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct(F.col("_cap") / F.col("_w"), "_level"))).over(full)["_level"]
    return s.select("source", "source_size", "_w", F.least(F.col("_cap").cast("double"), free * F.col("_w")).alias("target"))


def heads(docs: DataFrame) -> DataFrame:
    """source and heads: size and doc_id of its documents that are larger than the largest but HEAD, by size downwards.

    Ranks stop at HEAD + 1 within each task, so a source with a third of all rows is no burden.
    """
    order = Window.partitionBy("source").orderBy(F.col("size").desc(), F.col("doc_id").asc_nulls_first())
    top = docs.select("source", "size", "doc_id").withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= HEAD + 1)
    listed = top.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("_rank", "size", "doc_id"))).alias("heads"), F.max(F.when(F.col("_rank") > HEAD, F.col("size"))).alias("_beyond"))
    return listed.select("source", F.filter("heads", lambda h: h["size"] > F.coalesce("_beyond", F.lit(0))).alias("heads"), F.coalesce("_beyond", F.lit(0)).alias("bound"))


def whole_copies(listed: Column, rate: Column, most: int) -> Column:
    """For documents from the largest down, struct (owed, copies): copies of each, and the words (times UNIT) still owed after them."""
    def step(state: Column, head: Column) -> Column:
        owed = state["owed"] + rate * head["size"]
        n = F.least(F.lit(most).cast("long"), F.greatest(F.lit(0).cast("long"), F.floor((2 * owed + head["size"] * UNIT) / (2 * head["size"] * UNIT))))
        return F.struct((owed - n * head["size"] * UNIT).alias("owed"), F.concat(state["copies"], F.array(n)).alias("copies"))

    return F.aggregate(listed, F.struct(F.lit(0).cast("long").alias("owed"), F.array().cast("array<long>").alias("copies")), step)


def mix(docs: DataFrame, seed: int = SEED, most: int = 3) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and copies of every row of docs (doc_id, source, text)."""
    docs = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    place = {"_class": size_class(F.col("size")), "_slice": F.coalesce(F.pmod("doc_id", F.lit(SLICES)), F.lit(-1))}
    plan = targets(docs.groupBy("source").agg(F.sum("size").alias("source_size")), most=most)
    rate = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size") * UNIT), F.lit(most * UNIT).cast("long")))
    plan = plan.select("source", "source_size", "target", F.coalesce(rate, F.lit(0).cast("long")).alias("_rate"), offset(F.col("source"), seed).alias("_offset"))
    largest = heads(docs).withColumnRenamed("source", "_hs")
    plan = plan.join(largest, F.col("source").eqNullSafe(F.col("_hs"))).withColumn("_whole", whole_copies(F.col("heads"), F.col("_rate"), most))
    others = F.col("source_size") - F.aggregate("heads", F.lit(0).cast("long"), lambda n, h: n + h["size"])
    spread = F.when(others > 0, F.floor(F.col("_whole.owed") / others)).otherwise(F.lit(0).cast("long"))
    even = F.least(F.lit(most * UNIT).cast("long"), F.greatest(F.lit(0).cast("long"), F.col("_rate") + spread))
    plan = cut(plan.select("source", "source_size", "target", "_offset", "bound", "heads", F.col("_whole.copies").alias("_copies"), even.alias("_rate")))  # a row per source
    first = plan.select("source", "source_size", "target", F.explode(F.arrays_zip("heads", "_copies")).alias("h")).select(
        F.col("h.heads.doc_id").alias("doc_id"), "source", F.col("h.heads.size").alias("size"), "source_size", "target", F.col("h._copies").alias("copies"))

    # ranks within the source by (size class, slice, size, id): where each (class, slice) begins, then the place in it;
    # the largest documents are the last of their (class, slice), and are not counted
    docs, plan = docs.withColumns(place), plan.withColumnRenamed("source", "_gs").drop("heads", "_copies")
    ahead = Window.partitionBy("source").orderBy("_class", "_slice").rowsBetween(Window.unboundedPreceding, -1)
    groups = docs.groupBy("source", "_class", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    taken = first.withColumns(place).groupBy(F.col("source").alias("_ts"), F.col("_class").alias("_tc"), F.col("_slice").alias("_tk")).agg(F.count(F.lit(1)).alias("_t"))
    alike = F.col("source").eqNullSafe(F.col("_ts")) & (F.col("_class") == F.col("_tc")) & (F.col("_slice") == F.col("_tk"))
    groups = (groups.join(taken, alike, "left").withColumn("_base", F.coalesce(F.sum(F.col("_n") - F.coalesce("_t", F.lit(0))).over(ahead), F.lit(0)))
              .join(plan, F.col("source").eqNullSafe(F.col("_gs")))
              .select("_gs", F.col("_class").alias("_gc"), F.col("_slice").alias("_gk"), "_base", "source_size", "target", "bound", "_rate", "_offset"))
    inner = Window.partitionBy("source", "_class", "_slice").orderBy("size", "doc_id")
    same = F.col("source").eqNullSafe(F.col("_gs")) & (F.col("_class") == F.col("_gc")) & (F.col("_slice") == F.col("_gk"))
    end = (F.col("_base") + F.col("_in")) * F.col("_rate") + F.col("_offset")
    placed = docs.withColumn("_in", F.row_number().over(inner)).join(groups, same).where(F.col("size") <= F.col("bound")).withColumn("_end", end)
    copies = F.shiftright("_end", BITS) - F.shiftright(F.col("_end") - F.col("_rate"), BITS)
    placed = placed.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"))
    return placed.union(first).select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def replicate(docs: DataFrame, seed: int = SEED, most: int = 3) -> DataFrame:
    """The mix itself: every row of docs as often as it is emitted (rows alike in id, source and size take turns)."""
    names = docs.columns
    alike = ["doc_id", "source", "_size"]
    rows = docs.withColumn("_size", word_count(F.col("text")))
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*alike).orderBy(F.xxhash64("text"))))
    plan = mix(docs, seed, most).withColumnRenamed("size", "_size")
    plan = plan.withColumn("_nth", F.row_number().over(Window.partitionBy(*alike).orderBy("copies")))
    plan = plan.select(*[F.col(c).alias(f"_p{i}") for i, c in enumerate((*alike, "_nth"))], F.col("copies").alias("_copies")).where("_copies > 0")
    match = F.lit(True)
    for i, c in enumerate((*alike, "_nth")):
        match = match & F.col(c).eqNullSafe(F.col(f"_p{i}"))
    return rows.join(plan, match).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(*names)
