"""Exact tokenization with a bounded per-worker cache of white-space separated chunks.

The vocabulary's tokenizer drops white space and lower-cases, so a text's ids are those of its chunks end to end.  The
chunks of many texts are hashed together and each distinct one is looked up once.  A new chunk of Latin letters, digits
and common symbols is cut into pieces by the tokenizer's own pattern, and its words are encoded by the tokenizer's
model; any other chunk, or one with the beginning of a special token, goes to the tokenizer as it is.  The cache takes
the first `CACHE` chunks (frequent ones come early) of at most `CHUNK_IDS` ids and is then fixed: about 30 MB in sorted
arrays, however large the vocabulary of the texts.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa

from fieldbook.llm import textops
from fieldbook.llm.job import CACHES

EOS = 2
CACHE, PIECES, CHUNK_IDS = 600_000, 50_000, 64

_LETTERS = "a-zà-öø-ÿāăąćĉċčďđēĕėęěĝğġģĥħĩīĭįıĵķĺļľłńņňŋōŏőŕŗřśŝşšţťŧũūŭůűųŵŷźżžœßĳŀŉĸ"
_SYMBOLS = r"!-/:-@\[-`{-~¡¿«»°§–—‘’“”…€"
_pieces = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[{_SYMBOLS}]+").findall
_other = re.compile(rf"<\||[^0-9A-ZÀ-ÖØ-Þ{_LETTERS}{_SYMBOLS}]").search


class WordTokenizer:
    """Ids of whole texts."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.bytes_of = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.known = textops.Known(CACHE)
        self.starts, self.lengths, self.ids = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32), np.zeros(0, dtype="<u4"))
        self.pieces: dict[str, list[int]] = {}

    def _piece(self, piece: str) -> list[int]:
        ids = self.pieces.get(piece)
        if ids is None:
            symbols = piece if piece.isascii() else self.bytes_of.pre_tokenize_str(piece)[0][0]
            ids = [t.id for t in self.model.tokenize(symbols)]
            if len(self.pieces) < PIECES:
                self.pieces[piece] = ids
        return ids

    def _chunk(self, chunk: str) -> list[int]:
        if _other(chunk):
            return self.tokenizer.encode(chunk, add_special_tokens=False).ids
        pieces = _pieces(chunk.lower())
        if len(pieces) == 1:
            return self._piece(pieces[0])
        return [i for p in pieces for i in self._piece(p)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and how many each text has; null is an empty text."""
        data, offsets = textops.buffer(texts)
        inside = ~((data == 32) | (data == 9) | (data == 10) | (data == 13))
        starts, ends, first, last = textops.spans(inside, offsets)
        if not len(starts):
            return np.zeros(0, dtype="<u4"), np.zeros(len(texts), dtype=np.int64)
        hashes = textops.span_hash(textops.rolling(textops.PLAIN[data]), starts, ends)
        distinct, one, each = np.unique(hashes, return_index=True, return_inverse=True)
        place = self.known.get(distinct)
        new = np.flatnonzero(place < 0)
        all_starts, all_lengths, all_ids = self.starts, self.lengths, self.ids
        if len(new):
            raw, chunk = data.tobytes(), self._chunk
            found = [chunk(raw[a:b].decode("utf-8", "replace")) for a, b in zip(starts[one[new]].tolist(), ends[one[new]].tolist())]
            lengths = np.array([len(x) for x in found], dtype=np.int32)
            ids = np.fromiter((i for x in found for i in x), dtype="<u4", count=int(lengths.sum()))
            place[new] = np.arange(len(new)) + len(all_starts)
            all_starts = np.concatenate([all_starts, len(all_ids) + np.cumsum(lengths, dtype=np.int64) - lengths])
            all_lengths, all_ids = np.concatenate([all_lengths, lengths]), np.concatenate([all_ids, ids])
            short = np.flatnonzero(lengths <= CHUNK_IDS)
            kept = short[: self.known.add(distinct[new[short]], np.arange(len(short)) + len(self.starts))]
            if len(kept):
                at = np.repeat(np.cumsum(lengths, dtype=np.int64)[kept] - lengths[kept], lengths[kept])
                inner = np.arange(len(at)) - np.repeat(np.cumsum(lengths[kept]) - lengths[kept], lengths[kept])
                self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths[kept], dtype=np.int64) - lengths[kept]])
                self.lengths, self.ids = np.concatenate([self.lengths, lengths[kept]]), np.concatenate([self.ids, ids[at + inner]])
        place = place[each]
        lengths = all_lengths[place]
        total = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        at = np.repeat(all_starts[place] - total[:-1], lengths) + np.arange(total[-1])
        return all_ids[at], total[last] - total[first]


_open: dict[str, WordTokenizer] = {}
CACHES.append(_open)


def word_tokenizer(path: str) -> WordTokenizer:
    """One per worker process and file, as long as tasks of one operator follow each other."""
    if path not in _open:
        _open[path] = WordTokenizer(path)
    return _open[path]


def width(path: str) -> str:
    """The narrowest type that holds every id of the vocabulary."""
    return "<u2" if word_tokenizer(path).tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
