"""Chat formatting at token level.

Template, with control strings in brackets: ``<s>`` once; a user's turn is ``[INST]text[/INST]``, an assistant's is
``text</s>``, any other role's ``[ROLE]role[/ROLE]text</s>``.  Each role and text is escaped and encoded by itself, on
whatever task holds the row; control strings are never encoded but spliced in as reserved ids beyond the vocabulary,
so no text can produce one.  The loss mask covers the assistant's texts: segment lengths are summed up, +1 is put where
a loss segment begins and -1 where it ends, and a second running sum is the mask.

A control string inside a text gets a backslash after its first character, one more than it had there, so unescaping
is exact.

Turns are shuffled encoded and sorted by (conversation, turn) within partitions; a conversation is assembled and read
back as a stream of blocks, so a very long one needs no more memory than a block.  Its digests are sequential by
nature, so one conversation is one task's work.

Defined results: null texts and roles are empty; turns with the same number are ordered by role, then by their texts' ids; repeated
rows are turns of their own; rows with a null conv_id are one conversation; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fieldbook.llm.job import in_batches

CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]"]
RESERVED = 50257
BOS, EOS, USER, USER_END, ROLE, ROLE_END = range(RESERVED, RESERVED + len(CONTROLS))
_tail = "|".join(re.escape(c[1:]) for c in CONTROLS)
_escape = re.compile(rf"([<\[])(\\*)({_tail})")
_unescape = re.compile(rf"([<\[])\\(\\*)({_tail})")
BLOCK = 2000


def escape(text: str) -> str:
    return _escape.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _unescape.sub(r"\1\2\3", text)


_open: dict[str, object] = {}


def encoder(path: str):
    """The byte-level tokenizer, one per worker process."""
    if path not in _open:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _open[path] = tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _open[path]


def encode(turns: DataFrame, path: str) -> DataFrame:
    """conv_id, turn, role and the ids of each row's role and text."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = lambda text: np.array(encoder(path).encode_ordinary(escape(text)), dtype="<u4").tobytes()
        for batch in batches:
            texts = [ids(t or "") for t in batch.column("text").to_pylist()]
            roles = [r or "" for r in batch.column("role").to_pylist()]
            known = {r: ids(r) for r in set(roles)}
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("turn"), pa.array(roles, type=pa.string()),
                 pa.array([known[r] for r in roles], type=pa.binary()), pa.array(texts, type=pa.binary())],
                names=["conv_id", "turn", "role", "role_ids", "text_ids"])

    return in_batches(
        turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text"), task, "conv_id long, turn long, role string, role_ids binary, text_ids binary")


def assemble(turns: list[tuple[str, bytes, bytes]], begins: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ids and loss mask of consecutive turns (role, role ids, text ids) of one conversation."""
    mark = lambda i: np.array([i], dtype="<u4")
    segments, loss = ([mark(BOS)], [False]) if begins else ([], [])
    for role, role_ids, text_ids in turns:
        text = np.frombuffer(text_ids, dtype="<u4")
        if role == "user":
            parts = [mark(USER), text, mark(USER_END)]
        elif role == "assistant":
            parts = [text, mark(EOS)]
        else:
            parts = [mark(ROLE), np.frombuffer(role_ids, dtype="<u4"), mark(ROLE_END), text, mark(EOS)]
        segments += parts
        loss += [role == "assistant" and p is text for p in parts]
    lengths = np.array([len(s) for s in segments], dtype=np.int64)
    ends = np.cumsum(lengths)
    chosen = np.flatnonzero(loss)
    steps = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, dtype=np.int64)
    np.add.at(steps, ends[chosen] - lengths[chosen], 1)
    np.add.at(steps, ends[chosen], -1)
    return (np.concatenate(segments) if segments else np.zeros(0, dtype="<u4")), np.cumsum(steps)[:-1].astype(bool)


def read_back(ids: np.ndarray, mask: np.ndarray, path: str) -> Iterator[tuple[str, str, str, int]]:
    """(role, text, text under the loss mask, formatted characters) of each turn, from formatted ids alone."""
    decode = lambda part: encoder(path).decode(part.tolist()) if len(part) else ""
    at, chars = 0, 0
    while at < len(ids):
        chars = 0
        if ids[at] == BOS:
            chars += len(CONTROLS[0])
            at += 1
            if at == len(ids):
                return
        role = "assistant"
        if ids[at] == USER:
            role = "user"
            chars += len(CONTROLS[USER - RESERVED])
            at += 1
        elif ids[at] == ROLE:
            end = at + int(np.argmax(ids[at:] == ROLE_END))
            name = decode(ids[at + 1 : end])
            role = unescape(name)
            chars += len(CONTROLS[ROLE - RESERVED]) + len(name) + len(CONTROLS[ROLE_END - RESERVED])
            at = end + 1
        close = USER_END if role == "user" and ids[at - 1] == USER else EOS
        end = at + int(np.argmax(ids[at:] == close))
        text = decode(ids[at:end])
        under = decode(ids[at:end][mask[at:end]])
        yield role, unescape(text), unescape(under), chars + len(text) + len(CONTROLS[close - RESERVED])
        at = end + 1


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, bool, list[tuple[str, bytes, bytes]]]]:
    """Consecutive turns of one conversation, with whether it begins there."""
    last: object = _blocks
    for batch in batches:
        turns: list[tuple[str, bytes, bytes]] = []
        begins = False
        for conv, *turn in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "role", "role_ids", "text_ids")]):
            if conv != last or len(turns) == BLOCK:
                if turns:
                    yield last, begins, turns
                turns, begins, last = [], conv != last, conv
            turns.append(tuple(turn))
        if turns:
            yield last, begins, turns


def _in_order(turns: DataFrame, path: str) -> DataFrame:
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (encode(turns, path).repartition(parts, "conv_id")
            .sortWithinPartitions("conv_id", "turn", "role", "text_ids").drop("turn"))


def format_conversations(turns: DataFrame, path: str) -> DataFrame:
    """conv_id, block (from 0), ids and loss mask: a conversation is its blocks end to end."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for conv, begins, block in _blocks(batches):
            n = 0 if begins else n + 1
            ids, mask = assemble(block, begins)
            yield pa.RecordBatch.from_arrays(
                [pa.array([conv], type=pa.int64()), pa.array([n], type=pa.int64()), pa.array([ids.astype(np.int64)], type=pa.list_(pa.int64())),
                 pa.array([mask], type=pa.list_(pa.bool_()))], names=["conv_id", "block", "ids", "loss"])

    return in_batches(_in_order(turns, path), task, "conv_id long, block long, ids array<long>, loss array<boolean>")


def digests(turns: DataFrame, path: str) -> DataFrame:
    """What the formatted conversations say, read back from their ids and masks; one row per conversation."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        state: list | None = None

        def close() -> None:
            if state is not None:
                conv, n, said, loss_chars, loss, chars = state
                done.append((conv, n, said.hexdigest(), loss_chars, loss.hexdigest(), chars))

        def flush() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*done), kinds)], names=names)

        for conv, begins, block in _blocks(batches):
            if begins:
                close()
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                if len(done) >= 1000:
                    yield flush()
                    done.clear()
            for role, text, under, chars in read_back(*assemble(block, begins), path):
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                state[3] += len(under)
                state[4].update(under.encode())
                state[5] += chars
        close()
        if done:
            yield flush()

    return in_batches(_in_order(turns, path), task, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                                                    "loss_sha256 string, formatted_chars long")
