"""Token counts by a count-only Viterbi over a vocabulary of scored pieces, with the tokenizer's own rules.

As in SentencePiece's unigram model, a text begins with a word mark and its spaces are word marks; nothing else is
normalised.  No piece of the vocabulary has a word mark behind another character (this is checked), so a best path
always breaks before a run of spaces, and each chunk of spaces and the characters up to the next space is scored alone.

An Aho-Corasick automaton names every vocabulary piece that ends at each character; the best score of each prefix and
the number of its pieces are carried along in a ring as long as the longest piece, no path is kept.  Ties go as in the
tokenizer: of equal scores, the piece that begins first.  A character that is no piece by itself may be unknown, 10
below the worst score, and counts as its UTF-8 bytes where the file has byte pieces; else a run of unknown ones is one.

Pieces and scores are read from a public SentencePiece file.  That file's scores need not be log-probabilities: those
of a BPE file are merge ranks, and the best path by them is in general not the segmentation that merging would give.

Each distinct chunk of a slice is counted once, and a bounded cache keeps the first `CACHE` chunks of a worker.

Defined results: a null or empty text has no tokens; a blank one has those of its spaces; very long texts and chunks are
read whole; repeated rows and rows with a null doc_id are counted like any other; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fieldbook.llm import textops
from fieldbook.llm.job import in_batches

MARK = "▁"
CACHE = 600_000
UNKNOWN_PENALTY = 10.0


def vocabulary(path: str) -> tuple[list[tuple[str, float]], bool]:
    """Pieces with their scores, and whether unknown characters are spelled in bytes; control and byte pieces are not text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    every = range(model.get_piece_size())
    pieces = [(model.id_to_piece(i), model.get_score(i)) for i in every if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]
    return pieces, any(model.is_byte(i) for i in every)


class Counter:
    """Counts of texts by a vocabulary."""

    def __init__(self, pieces: list[tuple[str, float]], in_bytes: bool):
        import ahocorasick

        if any(MARK in piece.lstrip(MARK) for piece, _ in pieces):
            raise ValueError("a piece has a word mark behind another character, so chunks can't be scored alone")
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.in_bytes = in_bytes
        self.longest = max((len(piece) for piece, _ in pieces), default=1)
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.known = textops.Known(CACHE)

    def count(self, chunk: str) -> int:
        """Pieces of the best path through a chunk whose spaces are word marks."""
        ring = self.longest + 1
        best, pieces, unknown = [0.0] * ring, [0] * ring, [False] * ring
        matches = self.automaton.iter(chunk) if len(self.automaton) else iter(())
        ahead = next(matches, None)
        for end, c in enumerate(chunk, 1):
            top, n, single, is_unknown = None, 0, False, False
            found = []
            while ahead is not None and ahead[0] == end - 1:
                found.append(ahead[1])
                ahead = next(matches, None)
            if len(found) > 1:
                found.sort(reverse=True)  # the longest begins first: only a better score replaces it
            for length, score in found:
                single = single or length == 1
                value = best[(end - length) % ring] + score
                if top is None or value > top:
                    top, n = value, pieces[(end - length) % ring] + 1
            if not single:
                last = (end - 1) % ring
                value = best[last] + self.unknown
                if top is None or value > top:
                    top, is_unknown = value, True
                    n = pieces[last] + (len(c.encode("utf-8", "surrogatepass")) if self.in_bytes else not unknown[last])
            here = end % ring
            best[here], pieces[here], unknown[here] = top, n, is_unknown
        return pieces[len(chunk) % ring]

    def counts(self, texts: pa.Array) -> np.ndarray:
        data, offsets = textops.buffer(texts)
        if not len(data):
            return np.zeros(len(texts), dtype=np.int64)
        space = data == 32
        begins = np.zeros(len(data), dtype=bool)
        begins[1:] = space[1:] & ~space[:-1]
        full = np.flatnonzero(offsets[1:] > offsets[:-1])
        begins[offsets[full]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(data))
        first = np.zeros(len(starts), dtype=bool)  # these get the mark that begins a text
        first[np.searchsorted(starts, offsets[full])] = True
        hashes = textops.span_hash(textops.rolling(textops.PLAIN[data]), starts, ends)
        hashes[first] = textops.mix(hashes[first] + np.uint64(1))
        distinct, one, each = np.unique(hashes, return_index=True, return_inverse=True)
        n = self.known.get(distinct)
        new = np.flatnonzero(n < 0)
        raw = data.tobytes()
        n[new] = [self.count((MARK if f else "") + raw[a:b].decode().replace(" ", MARK))
                  for f, a, b in zip(first[one[new]].tolist(), starts[one[new]].tolist(), ends[one[new]].tolist())]
        self.known.add(distinct[new], n[new])
        total = np.concatenate([[0], np.cumsum(n[each])])
        edges = np.searchsorted(starts, offsets)
        return total[edges[1:]] - total[edges[:-1]]


_open: dict[str, Counter] = {}


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and n_tokens of every row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _open:
            _open[path] = Counter(*vocabulary(path))
        for batch in batches:
            for part in textops.slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(_open[path].counts(part.column("text")))],
                                                 names=["doc_id", "n_tokens"])

    return in_batches(docs.select("doc_id", "text"), task, "doc_id long, n_tokens long")
