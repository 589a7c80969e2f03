"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir); all but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldbook.llm import jaccard, language, lines, mixing, packing
from fieldbook.llm.job import tokenizer_file

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what `language.accepted` rejects, by its default limits; `lang` becomes the language found.

    Texts that are null, empty or without a letter go; texts below the limit of length need only a letter; a null doc_id, source
    or lang is no reason to go; repeated rows are judged alike; very long texts are read whole; other columns are dropped.
    """
    docs = docs.select(*COLUMNS)
    found = language.identify(docs, language.train(docs), COLUMNS)
    return language.accepted(found, "text").select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated and nearly repeated lines; a document of which nothing else was left goes with them.

    The earliest line by doc_id and place stays.  Rows with a null or empty text, or a null doc_id, pass as they are; equal rows
    are one occurrence and keep the same lines; very long lines and texts are compared whole; n_chars becomes the new length.
    """
    left = lines.dedup_lines(docs.select(*COLUMNS)).where("n_removed = 0 or trim(text) <> ''")
    return left.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near duplicates.

    Rows of one doc_id are one document, whose group is that of all its texts: its different texts stay or go together;
    of equal rows one stays, and so do all rows without an id.  Null and empty texts are like no other and stay; very long texts
    are compared whole; rows that differ in another column than the text are no repeats of each other.
    """
    docs = docs.select(*COLUMNS)
    kept = jaccard.similar(docs).where("component_id = doc_id").select("doc_id").distinct()
    rows = docs.join(kept, "doc_id", "left_semi").withColumn("_mark", F.xxhash64("text", "lang", "source", "n_chars")).dropDuplicates(["doc_id", "_mark"])
    return rows.select(*COLUMNS).union(docs.where("doc_id is null"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and leaves out documents so that sources come near their target weights.

    Null sources are one source; a null or empty text has size 0 and is taken by its source's rate; rows with a null doc_id and
    repeated rows are documents of their own, so that of equal ones some may be taken more often than others.
    """
    return mixing.replicate(docs.select(*COLUMNS))


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into training sequences; one row per piece.

    A null or empty text is only the end id; a null source is a queue of its own; rows with a null doc_id and repeated rows are
    documents of their own; very long texts are cut over many sequences.
    """
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates),
          ("source_mixing", source_mixing), ("sequence_packing", sequence_packing)]
