"""Language identification by hyperdimensional profiles.

Every letter has a random vector of `BITS` signs, drawn from its code point.  A letter n-gram is bound by multiplying
its letters' vectors, each permuted by its place; a text bundles (adds) the vectors of all its trigrams, words set off
by spaces; a language's prototype bundles its texts' unit vectors.  A text has the language of the prototype with the
largest cosine, after the mean of all prototypes is taken off both sides' common direction.

Signs are kept as bits: binding is exclusive-or, permuting is rotating by machine words.  A slice of texts is bundled
`GRAMS` distinct trigrams at a time, by a matrix product of their counts and vectors; where most trigrams occur in one
text only, as in Chinese, their vectors are added up per text instead.  A text longer than a slice is read in pieces that
share two letters, so memory depends neither on the length of a text nor on its alphabet.

Training: a documented bound, `TRAIN_PER_LANG`, of labelled training rows per language, thinned evenly by a hash of the
id and text; everything else covers all rows.  Prediction uses the text alone.

Defined results: a null text or one without a letter is `und` with score 0; rows with a null lang are never learned
from; rows with a null doc_id are training rows; with no labelled row every text is `und`; very long texts are read whole;
of languages with an equal cosine the first by name is taken; repeated rows repeat; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fieldbook.llm import textops
from fieldbook.llm.job import in_batches

BITS = 1024
TRAIN_PER_LANG = 10_000
FOLDS = 5
UNKNOWN = "und"
#: Code points bundled at once, and distinct trigrams (or trigrams of a text) whose vectors are in memory at once.
PIECE = 1_000_000
GRAMS = 4096


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


_letter_class: np.ndarray | None = None


def letter_codes() -> np.ndarray:
    """For each code point the code point itself if it is a letter, else a space."""
    global _letter_class
    if _letter_class is None:
        known = np.full(0x110000, 32, dtype=np.uint32)
        letters = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()]
        known[letters] = letters
        _letter_class = known
    return _letter_class


def letter_vectors(codes: np.ndarray) -> np.ndarray:
    """Random sign bits of each code point, as machine words."""
    lanes = np.arange(BITS // 64, dtype=np.uint64)
    with np.errstate(over="ignore"):
        return textops.mix(codes.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + (lanes + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))


def _letters(text: str) -> Iterator[np.ndarray]:
    """The text's letters, words set off by single spaces, in pieces; each begins with the last two codes of the one before."""
    table, last = letter_codes(), np.array([32], dtype=np.uint32)
    for at in range(0, len(text), PIECE):
        letters = table[np.frombuffer(text[at : at + PIECE].lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        if at + PIECE >= len(text):
            letters = np.append(letters, np.uint32(32))
        before = np.concatenate([last[-1:], letters[:-1]])
        piece = np.concatenate([last, letters[(letters != 32) | (before != 32)]])
        yield piece
        last = piece[-2:]


def _ranks(values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and the place of each value among them; values are below `size`."""
    if size > 1 << 22:
        return np.unique(values, return_inverse=True)
    seen = np.zeros(size, dtype=bool)
    seen[values] = True
    distinct = np.flatnonzero(seen)
    index = np.zeros(size, dtype=np.int32)
    index[distinct] = np.arange(len(distinct), dtype=np.int32)
    return distinct, index[values]


def _bundle(pieces: list[np.ndarray], rows: list[int], out: np.ndarray) -> None:
    """Adds the vectors of the pieces' trigrams to the rows they belong to."""
    sizes = np.array([len(x) for x in pieces], dtype=np.int64)
    flat = np.concatenate(pieces)
    alphabet, place = _ranks(flat, 0x110000)
    n = len(alphabet)
    grams = place[:-2].astype(np.int32 if n < 1200 else np.int64)
    for later in (place[1:-1], place[2:]):
        grams *= n
        grams += later
    whole = np.ones(len(flat), dtype=bool)
    ends = np.cumsum(sizes)
    whole[ends - 1] = False
    whole[np.maximum(ends - 2, 0)] = False
    grams, owner = grams[whole[:-2]], np.repeat(np.array(rows, dtype=np.int32), sizes)[:-2][whole[:-2]]
    if not len(grams):
        return
    distinct, gram = _ranks(grams, n**3)
    vectors = letter_vectors(alphabet)
    once, twice = np.roll(vectors, 1, axis=1), np.roll(vectors, 2, axis=1)

    def add(some: np.ndarray, counts: np.ndarray, grams: np.ndarray) -> None:
        """A set bit is a -1: the sum of signs is the number of trigrams less twice that of their set bits."""
        bound = twice[grams // (n * n)] ^ once[grams // n % n] ^ vectors[grams % n]
        bits = np.unpackbits(bound.view(np.uint8), axis=1).astype(np.float32)
        out[some] += counts.sum(axis=1, keepdims=True) - 2 * (counts @ bits)

    first, last = rows[0], rows[-1] + 1
    if len(distinct) * (last - first) <= 64 * len(grams):
        owner -= first
        if len(distinct) > GRAMS:
            order = np.argsort(gram, kind="stable")
            gram, owner = gram[order], owner[order]
        for at in range(0, len(distinct), GRAMS):
            low, high = np.searchsorted(gram, [at, at + GRAMS]) if len(distinct) > GRAMS else (0, len(gram))
            m = min(GRAMS, len(distinct) - at)
            counts = np.bincount(owner[low:high] * np.int64(m) + (gram[low:high] - at), minlength=(last - first) * m).reshape(-1, m)
            add(slice(first, last), counts.astype(np.float32), distinct[at : at + m])
    else:  # owners are in order
        for at in range(0, len(gram), GRAMS):
            some, own = np.unique(owner[at : at + GRAMS], return_inverse=True)
            counts = np.zeros((len(some), len(own)), dtype=np.float32)
            counts[own, np.arange(len(own))] = 1
            add(some, counts, distinct[gram[at : at + GRAMS]])


def profile(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bundled trigram vectors (one row per text; whole numbers) and whether the text has a letter."""
    out, has = np.zeros((len(texts), BITS), dtype=np.float32), np.zeros(len(texts), dtype=bool)
    pieces: list[np.ndarray] = []
    rows: list[int] = []
    held = 0
    for i, text in enumerate(texts):
        for piece in _letters(text):
            has[i] |= bool((piece != 32).any())
            pieces.append(piece)
            rows.append(i)
            held += len(piece)
            if held >= PIECE:
                _bundle(pieces, rows, out)
                pieces, rows, held = [], [], 0
    if pieces:
        _bundle(pieces, rows, out)
    return out, has


def units(vectors: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, size, out=np.zeros_like(vectors), where=size > 0)


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """A slice's bytes of text and at most 400 rows, so that counts stay small."""
    for part in textops.slices(batch, column):
        for at in range(0, part.num_rows, 400):
            yield part.slice(at, 400)


def train(docs: DataFrame, bound: int = TRAIN_PER_LANG) -> dict[str, np.ndarray]:
    """Prototypes by language from the labelled rows of the training folds; one row per language reaches the driver."""
    labelled = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    totals = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not totals:
        return {}
    share = F.create_map(*[x for lang, n in totals.items() for x in (F.lit(lang), F.lit(min(1.0, bound / n)))])
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / (1 << 30)  # the text tells rows without an id apart
    thinned = labelled.where(draw < F.element_at(share, F.col("lang")))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                vectors, has = profile([t or "" for t in part.column("text").to_pylist()])
                vectors = units(vectors)
                langs = np.array(part.column("lang").to_pylist(), dtype=object)
                for lang in set(langs.tolist()):
                    sums[lang] = sums.get(lang, 0) + vectors[(langs == lang) & has].sum(axis=0, dtype=np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], type=pa.list_(pa.float64()))],
                                             names=["lang", "bundle"])

    parts = in_batches(thinned.select("text", "lang"), task, "lang string, bundle array<double>")
    summed = (parts.select("lang", F.posexplode("bundle").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
              .groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("bundle")))
    # sums of many tasks are rounded, so that their order does not show
    return {r["lang"]: np.round(np.array(r["bundle"]), 6) for r in summed.collect()}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in `keep`, lang_pred and score (cosine with the prototype, 0 to 1) of every row."""
    names = sorted(k for k, v in prototypes.items() if np.abs(v).sum() > 0)
    matrix = units(np.array([prototypes[k] for k in names], dtype=np.float32).reshape(len(names), BITS))
    common = matrix.mean(axis=0) if len(names) > 1 else np.zeros(BITS, dtype=np.float32)
    sharp = units(matrix - common)
    # several columns may have the same content, so text comes once more under a name of its own
    source = docs.select(*[F.col(k) for k in keep], F.coalesce("text", F.lit("")).alias("_whole"))
    schema = source.drop("_whole").schema.add("lang_pred", "string").add("score", "double")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "_whole"):
                vectors, has = profile(rows.column("_whole").to_pylist())
                if names:
                    vectors = units(vectors)
                    best = ((vectors - common) @ sharp.T).argmax(axis=1)
                    score = np.clip(np.einsum("ij,ij->i", vectors, matrix[best]), 0, 1)
                else:
                    has, best, score = np.zeros(len(has), dtype=bool), np.zeros(len(has), dtype=int), np.zeros(len(has))
                lang = [names[b] if h else UNKNOWN for b, h in zip(best.tolist(), has.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [*[rows.column(k) for k in keep], pa.array(lang, type=pa.string()), pa.array(np.where(has, score, 0.0).astype(np.float64))],
                    names=[*keep, "lang_pred", "score"])

    return in_batches(source, task, schema)


def accepted(found: DataFrame, text: str, least: float = 0.25, exempt: int = 200) -> DataFrame:
    """The rows in a known language: those whose score reaches `least`.

    The cosine of a few words is low in any language, so texts below `exempt` code points need only a letter.
    """
    known = F.col("lang_pred") != UNKNOWN
    return found.where(known & ((F.col("score") >= least) | (F.length(text) < exempt)))


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    found = identify(docs, train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
