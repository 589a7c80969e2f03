"""Line deduplication by a segment-partition edit join.

A line that is not blank is removed where an equal line occurs earlier in the corpus (by doc_id, then place), or one within
`edits(n)` edits, n being the code points of the longer of the two: one edit from `NEAR_CHARS` on, two from 52, and one more
whenever the length doubles, without an end; blank lines stay as they are.

1. Equal lines are one entry, with their first occurrence.
2. Lines of less than `TWO` code points: with threshold 1 a line is split into two segments.  If two lines are within one edit, the longer one has one of the
   shorter one's segments at its beginning or end: a line is filed under its own length, and probes the index of its own
   length and the next smaller one, by hashes of (length, prefix, suffix).  One of `NEAR_CHARS` - 1 is only filed: it
   can be near a longer one, but not near another of its own length.
3. Entries with a key in common are verified by an edit distance on the diagonals of a band.
4. A key shared by more than `SMALL` lines is never paired off.  Its lines differ only in the gap between the shared
   prefix and suffix; the gap is cut into `PARTS` parts, a single edit lies in one of them, so the lines are filed again
   under keys that leave out one part at a time.  Keys of one line are dropped, small groups are verified as above, and
   large ones are cut again, until the gap is a single character: then all lines of a key are within one edit of each
   other and the later ones go.  The work is linear in the number of lines, and no pair is lost.
5. Longer lines, with threshold k: k + 1 segments of a length that depends on k alone, the first half of them counted from
   the line's beginning, the others from its end.  One segment of the shorter line is untouched, has at most j edits
   on its own side if it is the j-th from there (from 0), and k - j on the other: so the longer line has it at most j places from
   where it was, and probes 2 j + 1 places.  A line is filed for the next k too where a line of the next k can be near it.
   Most keys are of one line only: keys are counted first, many to a row, and the others made again with the lines' places.
6. Lines with such a key in common are paired and verified if they are at most `SMALL`; more are dealt into parts, and each
   two parts meet in one task (`tile`), which verifies what letters and lengths allow and returns lines, not pairs.  That is
   quadratic in the lines of one key, but bounded in memory and distributed.

Lines move as hashes; text is read again only for lines that need it, by a fixed-size bitmap.

Defined results: null and empty texts, and rows with a null doc_id, come back unchanged; equal repeated rows are the
same occurrence and are treated alike; rows with one doc_id and different texts are told apart by a hash of the text;
ties do not occur; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fieldbook.llm import textops
from fieldbook.llm.job import bitmap, cut, in_batches, marked

#: The shortest lines that take part: all but empty ones (and those of white space alone).
MIN_CHARS = 1
#: One edit in a shorter line often changes what it says, as in a number or a date.
NEAR_CHARS = 24
SMALL = 32
PARTS = 8
#: From so many code points on two edits are allowed.
TWO = 52
#: Lines of a part, where more than SMALL have a key in common.
TILE = 128
#: Code points hashed at once, keys sorted at once in a task, and lines for each group in which keys are counted.
BLOCK, SORTED, GROUP = 1 << 15, 1 << 20, 2048
BITMAP = 1 << 24
KEY_BITMAP = 1 << 26
U64 = np.uint64
SPACES = np.array([*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], dtype=np.uint32)
#: By code point: its hash, for the usual ones, and whether it is no white space.
MIXED = textops.mix(np.arange(1, (1 << 16) + 1, dtype=U64))
SOLID = ~np.isin(np.arange(0x3002), SPACES)
ID = ["doc_id", "mark", "pos"]


def edits(n: int) -> int:
    """The edits by which lines may differ, the longer of which has n code points: grows with the length, without an end."""
    return 0 if n < NEAR_CHARS else max(1, (n // (TWO // 2)).bit_length())


def segment(k: int) -> int:
    """The length of the k + 1 segments of lines with threshold k: they all find room in the shortest line of a pair."""
    return ((TWO >> 1 << k - 1) - k) // (k + 1)


def reach(a: str, b: str, i: int, j: int) -> int:
    """How many characters of a from i and of b from j agree."""
    most, same = min(len(a) - i, len(b) - j), 0
    if most < 1 or a[i] != b[j]:
        return 0
    while same + 64 <= most and a[i + same : i + same + 64] == b[j + same : j + same + 64]:
        same += 64
    for step in (32, 16, 8, 4, 2, 1):
        if same + step <= most and a[i + same : i + same + step] == b[j + same : j + same + step]:
            same += step
    return same


def within(a: str, b: str, k: int) -> bool:
    """Whether the edit distance of a and b is at most k: how far one comes with e edits on each of the 2k + 1 diagonals of the band."""
    goal = len(b) - len(a)
    if abs(goal) > k:
        return False
    far: dict[int, int] = {}
    for e in range(k + 1):
        new: dict[int, int] = {}
        # a diagonal from which the goal cannot be reached with the edits left is passed over
        for d in range(max(-e, goal - (k - e)), min(e, goal + (k - e)) + 1):
            i = max(far.get(d, -1) + 1, far.get(d - 1, -1), far.get(d + 1, -2) + 1) if e else 0
            i = min(i, len(a), len(b) - d)
            if i < 0 or i + d < 0:
                continue
            new[d] = i + reach(a, b, i, i + d)
        if new.get(goal, -1) >= len(a):
            return True
        far = new
    return False


class Lines:
    """The lines of a slice of texts, as spans of one array of code points."""

    def __init__(self, texts: list[str]):
        self.text = "\n".join(texts)
        codes = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        breaks = np.flatnonzero(codes == 10)
        self.starts = np.concatenate([[0], breaks + 1])
        self.ends = np.concatenate([breaks, [len(codes)]])
        per_text = np.array([t.count("\n") + 1 for t in texts], dtype=np.int64)
        self.row = np.repeat(np.arange(len(texts)), per_text)
        self.pos = np.arange(len(self.row)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        self.prefix = np.zeros(len(codes) + 1, dtype=U64)
        usual, (up, _) = not len(codes) or codes.max() < len(MIXED), textops.powers(len(codes))
        for at in range(0, len(codes), BLOCK):  # `textops.rolling`, a block at a time, so that what lies between stays in the CPU's cache
            some = codes[at : at + BLOCK]
            values = MIXED[some] if usual else textops.mix(some.astype(U64) + U64(1))
            values *= up[at : at + len(some)]
            values[:1] += self.prefix[at : at + 1]
            np.cumsum(values, out=self.prefix[at + 1 : at + 1 + len(some)])
        self.chars = self.ends - self.starts
        self.blank = self.chars == 0
        solid = lambda codes: SOLID[np.minimum(codes, len(SOLID) - 1)]
        unsure = np.flatnonzero(~self.blank)
        for i in range(8):  # most lines begin with what is no white space
            unsure = unsure[~solid(codes[self.starts[unsure] + i])]
            over = self.chars[unsure] == i + 1
            self.blank[unsure[over]] = True
            unsure = unsure[~over]
        if len(unsure):
            seen = np.concatenate([[0], np.cumsum(solid(codes), dtype=np.int32)])
            self.blank[unsure] = seen[self.ends[unsure]] == seen[self.starts[unsure]]

    def id_hashes(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = textops.span_hash(self.prefix, self.starts[some], self.ends[some])
        # a second, independent view of the line: its halves' hashes combined
        half = self.starts[some] + self.chars[some] // 3
        with np.errstate(over="ignore"):
            other = textops.mix(textops.span_hash(self.prefix, self.starts[some], half) * U64(3) + textops.span_hash(self.prefix, half, self.ends[some]))
        return h.view(np.int64), other.view(np.int64)

    def seeds(self, some: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray, np.ndarray, bool]]:
        """Keys of untouched segments: lines (of some), their keys (a row for each segment and shift), threshold, each row's place
        (2 j, or 2 j + 1 from the end) and shift, and whether they may be the longer line."""
        n = self.chars[some]
        top = edits(int(n.max())) + 1 if len(n) else 0
        for k in range(2, top + 1):
            low, size = TWO >> 1 << k - 1, segment(k)
            for long, mine in ((True, (n >= low) & (n < 2 * low)), (False, (n >= low - k) & (n < low))):
                at = some[mine]
                if not len(at):
                    continue
                said = np.array([(side, j, shift) for side, of in ((0, k // 2 + 1), (1, (k + 1) // 2)) for j in range(of) for shift in (range(-j, j + 1) if long else (0,))])
                side, j, shift = (x[:, None] for x in said.T)
                # a shift is to the right from the beginning, and to the left from the end
                start = np.where(side == 0, self.starts[at] + (j * size + shift), self.ends[at] - ((j + 1) * size + shift))
                place = 2 * j + side
                key = textops.span_hash(self.prefix, start, start + size)
                key *= U64(5)
                key += ((k << 32) + place).astype(U64) * U64(11)
                yield at, textops.mix(key).view(np.int64), k, place[:, 0], shift[:, 0], long

    def keys(self, some: np.ndarray, base: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Keys of (base length, first a characters, last z characters)."""
        head = textops.span_hash(self.prefix, self.starts[some], self.starts[some] + a)
        tail = textops.span_hash(self.prefix, self.ends[some] - z, self.ends[some])
        with np.errstate(over="ignore"):
            mixed = textops.mix(head * U64(5) + textops.mix(tail + U64(9)) * U64(7) + base.astype(U64) * U64(11) + (a - z).astype(np.int64).view(U64) * U64(13))
        return mixed.view(np.int64)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Lines]]:
    for batch in batches:
        for part in textops.slices(batch, "text"):
            yield part, Lines(part.column("text").to_pylist())


def _docs(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null and text is not null and text <> ''").select("doc_id", F.xxhash64("text").alias("mark"), "text")


def occurrences(docs: DataFrame, only: np.ndarray | None = None) -> DataFrame:
    """doc_id, mark, pos and two hashes of every line that takes part, its length and first four keys (0 where it needs none).

    With the bits of some first hashes as `only`: the lines that have one of them, without lengths and keys.
    """
    bits = None if only is None else docs.sparkSession.sparkContext.broadcast(only)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, lines in _slices(batches):
            some = np.flatnonzero((lines.chars >= MIN_CHARS) & ~lines.blank)
            h, g = lines.id_hashes(some)
            if bits is not None:
                there = marked(bits.value, h & (KEY_BITMAP - 1))
                some, h, g = some[there], h[there], g[there]
            row = pa.array(lines.row[some])
            columns = [part.column("doc_id").take(row), part.column("mark").take(row), pa.array(lines.pos[some]), pa.array(h), pa.array(g)]
            names = [*ID, "h", "g"]
            if bits is None:
                columns.append(pa.array(lines.chars[some]))
                names.append("chars")
                short = np.flatnonzero((lines.chars[some] >= NEAR_CHARS - 1) & (lines.chars[some] < TWO))
                n = lines.chars[some[short]]
                for k, base in enumerate((n, n - 1)):
                    zero = np.zeros_like(n)
                    for side, (a, z) in enumerate(((base // 2, zero), (zero, base - base // 2))):
                        key = np.zeros(len(some), dtype=np.int64)
                        key[short] = lines.keys(some[short], base, a, z)
                        columns.append(pa.array(key))
                        names.append(f"k{2 * k + side}")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, mark long, pos long, h long, g long" + (", chars long, k0 long, k1 long, k2 long, k3 long" if only is None else "")
    return in_batches(_docs(docs), task, schema)


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, mark, pos and line of the wanted occurrences."""
    wanted = cut(wanted.select(*ID).distinct())
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(wanted, ["doc_id", "mark"], BITMAP))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            there = marked(bits.value, batch.column("spot").to_numpy())
            for part in textops.slices(batch.filter(pa.array(there)), "text"):
                texts = [t.split("\n") for t in part.column("text").to_pylist()]
                n = np.array([len(t) for t in texts], dtype=np.int64)
                row = np.repeat(np.arange(len(n)), n)
                pos = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                line = pa.array([x for t in texts for x in t], type=pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)), part.column("mark").take(pa.array(row)), pa.array(pos), line],
                                                 names=[*ID, "line"])

    spotted = _docs(docs).select("doc_id", "mark", F.pmod(F.xxhash64("doc_id", "mark"), F.lit(BITMAP)).alias("spot"), "text")
    lines = in_batches(spotted, task, "doc_id long, mark long, pos long, line string")
    return lines.join(wanted, ID, "left_semi")


def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files each record again under keys that leave out one part of its gap."""
    for batch in batches:
        for part in textops.slices(batch, "line"):
            lines = Lines(part.column("line").to_pylist())
            base, a, z = (part.column(c).to_numpy() for c in ("base", "a", "z"))
            gap = base - a - z
            parts = np.where(gap <= 1, 2, np.minimum(gap, PARTS))
            row = np.repeat(np.arange(len(base)), parts)
            j = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
            m, g = parts[row], gap[row]
            low, high = j * g // m, g - (j + 1) * g // m
            single = g <= 1  # a gap of one character: the inserted one is before or after it
            low, high = np.where(single, np.where(j == 0, g, 0), low), np.where(single, np.where(j == 0, 0, g), high)
            a, z, base = a[row] + low, z[row] + high, base[row]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [*[part.column(c).take(take) for c in (*ID, "short")], pa.array(base), pa.array(a), pa.array(z), pa.array(lines.keys(row, base, a, z))],
                names=[*ID, "short", "base", "a", "z", "key"])


def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = [within(x, y, edits(max(len(x), len(y)))) for x, y in zip(batch.column("line").to_pylist(), batch.column("earlier_line").to_pylist())]
        yield batch.select(ID).filter(pa.array(good, type=pa.bool_()))


def extremes(key: np.ndarray, said: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order, and the least and largest of what is said of each, whose lowest bit is set if it is anywhere."""
    order = np.argsort(key)
    key, said = key[order], said[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    bit = np.bitwise_or.reduceat(said & U64(1), first)
    line = said & ~U64(1)
    return key[first], np.minimum.reduceat(line, first) | bit, np.maximum.reduceat(line, first) | bit


def shared_seeds(docs: DataFrame, n_lines: int) -> DataFrame:
    """The keys that two different lines or more have, one of which is filed under it (its shift is 0).

    Nearly all keys are of one line, so a row is not a key: a task sorts many and sends a range of them as one row, and
    tasks count ranges.  Ranges are as many as lines need; of a key, a row has two lines at most.  A line is 63 bits of its hash.
    """
    groups = max(64, n_lines // GROUP)

    def rows(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        key, low, high = extremes(*(np.concatenate(x) for x in zip(*held)))
        twice = 1 + (low != high)
        at = np.repeat(np.arange(len(key)), twice)
        said = low[at]
        said[np.cumsum(twice) - 1] = high
        key = key[at]
        group = ((key >> U64(32)) * U64(groups)) >> U64(32)
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        offsets = pa.py_buffer((np.append(first, len(key)) * 8).astype(np.int32))
        packed = [pa.Array.from_buffers(pa.binary(), len(first), [None, offsets, pa.py_buffer(x)]) for x in (key, said)]
        return pa.RecordBatch.from_arrays([pa.array(group[first].astype(np.int64)), *packed], names=["range", "keys", "lines"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, lines in _slices(batches):
            some = np.flatnonzero((lines.chars >= TWO - 2) & ~lines.blank)
            h = np.zeros(len(lines.chars), dtype=U64)
            h[some] = lines.id_hashes(some)[0].view(U64) & ~U64(1)
            for at, key, _, _, shift, _ in lines.seeds(some):
                held.append((key.view(U64).ravel(), (h[at] | (shift == 0).astype(U64)[:, None]).ravel()))
                size += key.size
            if size >= SORTED:
                yield rows(held)
                held, size = [], 0
        if held:
            yield rows(held)

    def count(group: pa.Table) -> pa.Table:
        key, low, high = extremes(*(np.frombuffer(b"".join(group.column(c).to_pylist()), dtype=U64) for c in ("keys", "lines")))
        return pa.table({"key": key[(low != high) & ((low & U64(1)) == 1)].view(np.int64)})

    return in_batches(_docs(docs), task, "range long, keys binary, lines binary").groupBy("range").applyInArrow(count, "key long")


def placed(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The lines that have one of the keys: key, doc_id, mark, pos, chars, k, place, shift, long."""
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(keys, ["key"], KEY_BITMAP, F.pmod("key", F.lit(KEY_BITMAP))))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, lines in _slices(batches):
            some = np.flatnonzero((lines.chars >= TWO - 2) & ~lines.blank)
            found = []
            for at, key, k, place, shift, long in lines.seeds(some):
                one, line = np.nonzero(marked(bits.value, key & (KEY_BITMAP - 1)))
                found.append((at[line], key[one, line], np.full(len(one), k, dtype=np.int32), place[one].astype(np.int32), shift[one].astype(np.int32), np.full(len(one), long)))
            if found:
                at, key, k, place, shift, long = (np.concatenate(x) for x in zip(*found))
                row = pa.array(lines.row[at])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), part.column("doc_id").take(row), part.column("mark").take(row), pa.array(lines.pos[at]), pa.array(lines.chars[at]), pa.array(k), pa.array(place), pa.array(shift), pa.array(long)],
                    names=["key", *ID, "chars", "k", "place", "shift", "long"])

    return in_batches(_docs(docs), task, "key long, doc_id long, mark long, pos long, chars long, k int, place int, shift int, long boolean").join(keys.select("key"), "key", "left_semi")


def tile(group: pa.Table) -> pa.Table:
    """The lines of two parts (or one) that have an earlier line within their edits in the other part (or their own)."""
    group = group.sort_by([(c, "ascending") for c in ID])
    text, part, plain = group.column("line").to_pylist(), group.column("part").to_numpy(), group.column("plain").to_numpy()
    # of lines that have an earlier segment in common, in its place, the pair is met in that segment's group
    k, place = group.column("k")[0].as_py(), group.column("place")[0].as_py()
    spans = [(side, j * segment(k), (j + 1) * segment(k)) for side, j in ((p & 1, p >> 1) for p in range(place)) if j < (k // 2 + 1, (k + 1) // 2)[side]]
    ahead = np.array([[hash(t[len(t) - end : len(t) - start] if side else t[start:end]) for side, start, end in spans] for t in text], dtype=np.int64).reshape(len(text), len(spans))
    n = np.array([len(t) for t in text])
    letters = np.zeros((len(text), 64), dtype=np.int32)
    for i, t in enumerate(text):
        letters[i] = np.bincount(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) & 63, minlength=64)
    one = group.column("a")[0].as_py() == group.column("b")[0].as_py()
    gone = np.zeros(len(text), dtype=bool)
    for i in range(1, len(text)):
        k = edits(int(n[i]))  # at least what the shorter of the two allows; a longer earlier line may allow one more
        may = (np.abs(n[:i] - n[i]) <= k + 1) & (np.abs(letters[:i] - letters[i]).sum(axis=1) <= 2 * k + 2)
        if not one:
            may &= part[:i] != part[i]
        if plain[i]:
            may &= ~(plain[:i] & (ahead[:i] == ahead[i]).any(axis=1))
        gone[i] = any(within(text[i], text[e], edits(max(int(n[i]), int(n[e])))) for e in np.flatnonzero(may))
    return group.select(ID).filter(pa.array(gone))


def later_long_lines(docs: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of lines with more than one edit: pairs to verify (later and earlier), and later lines of large groups, verified."""
    shared = cut(shared_seeds(docs, lines.count()))
    live = cut(placed(docs, shared).join(lines.select(*ID), ID, "left_semi"))  # first occurrences
    sizes = cut(live.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    few = live.join(sizes.where(F.col("size") <= SMALL).select("key"), "key")
    filed = few.where("shift = 0").select("key", *[F.col(c).alias(f"e_{c}") for c in ID], F.col("chars").alias("e_chars"))
    more = F.col("chars") - F.col("e_chars")
    pairs = few.where("long").join(filed, "key").where(more.between(0, F.col("k")) & ((F.col("shift") == 0) | (F.abs(more - F.col("shift")) <= F.col("k") - F.shiftright("place", 1))) & (F.struct(*ID) != F.struct("e_doc_id", "e_mark", "e_pos")))
    # lines with a segment in its place are paired whatever their lengths say of it: `tile` leaves such pairs to the segment's group
    first = F.struct(*ID) < F.struct("e_doc_id", "e_mark", "e_pos")
    pairs = pairs.select(*[F.when(first, F.col(f"e_{c}")).otherwise(F.col(c)).alias(c) for c in ID], *[F.when(first, F.col(c)).otherwise(F.col(f"e_{c}")).alias(f"e_{c}") for c in ID])
    parts = F.ceil(F.col("size") / TILE).cast("int")
    once = live.groupBy("key", *ID, "k", "place").agg(F.bool_or(F.col("long") & (F.col("shift") == 0)).alias("plain"))
    many = cut(once.join(sizes.where(F.col("size") > SMALL), "key").select("key", *ID, "k", "place", "plain", parts.alias("parts"), F.pmod(F.xxhash64(*ID), parts).cast("int").alias("part")))
    if many.isEmpty():
        return pairs, many.select(*ID)
    met = many.join(texts_of(docs, many), ID).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select("key", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "part", *ID, "k", "place", "plain", "line")
    met = met.repartition(4 * docs.sparkSession.sparkContext.defaultParallelism, "key", "a", "b")  # little data, much work
    return pairs, met.groupBy("key", "a", "b").applyInArrow(tile, "doc_id long, mark long, pos long").distinct()


RECORD = "doc_id long, mark long, pos long, short boolean, base long, a long, z long, key long"


def later_lines(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """The entries (first occurrences) that have an earlier entry within their edits."""
    half = F.floor(F.col("base") / 2)
    base = lambda short: F.col("chars") - (0 if short else 1)
    slots = F.array(*[F.struct(F.lit(k < 2).alias("short"), base(k < 2).alias("base"), F.lit(k % 2).alias("side"), F.col(f"k{k}").alias("key")) for k in range(4)])
    zero = F.lit(0).cast("long")
    records = (lines.where(F.col("chars").between(NEAR_CHARS - 1, TWO - 1)).select(*ID, "chars", F.explode(slots).alias("s")).select(*ID, "chars", "s.*")
               .where(F.col("short") | (F.col("chars") >= NEAR_CHARS))
               .select(*ID, "short", "base", F.when(F.col("side") == 0, half).otherwise(zero).alias("a"),
                       F.when(F.col("side") == 0, zero).otherwise(F.col("base") - half).alias("z"), "key"))
    long_pairs, long_lines = later_long_lines(docs, lines)
    pairs, certain = [long_pairs], [long_lines]
    while True:
        groups = records.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.max("short").alias("any_short")).where("size > 1 and any_short")
        live = cut(records.join(groups.select("key", "size"), "key"))
        gap = F.col("base") - F.col("a") - F.col("z")
        near_alike = F.col("base") >= NEAR_CHARS  # whether two lines of the shorter length count as near
        # no gap: everyone is within one edit of everyone; one character: those of the shorter length are
        close = live.where((gap <= 0) | ((gap == 1) & F.col("short") & near_alike))
        least = close.groupBy("key").agg(F.min(F.struct(*ID)).alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
        certain.append(close.join(least, "key").where(F.struct(*ID) > F.col("least")).select(*ID))
        few = live.where((F.col("size") <= SMALL) & (gap > 0))
        other = few.select("key", *[F.col(c).alias(f"e_{c}") for c in (*ID, "short")])
        pairs.append(few.join(other, "key").where((F.struct(*ID) > F.struct("e_doc_id", "e_mark", "e_pos")) & ((near_alike & F.col("short") & F.col("e_short")) | (F.col("short") != F.col("e_short"))))
                     .select(*ID, "e_doc_id", "e_mark", "e_pos"))
        many = cut(live.where((F.col("size") > SMALL) & (gap > 0)).drop("size", "key"))
        if many.isEmpty():
            break
        texts = texts_of(docs, many)
        records = cut(in_batches(many.distinct().join(texts, ID), expand, RECORD))
    found = certain[0]
    for c in certain[1:]:
        found = found.union(c)
    wanted = pairs[0]
    for p in pairs[1:]:
        wanted = wanted.union(p)
    wanted = cut(wanted.distinct())
    ends = wanted.select(*ID).union(wanted.select("e_doc_id", "e_mark", "e_pos"))
    texts = cut(texts_of(docs, ends))
    earlier = texts.select(F.col("doc_id").alias("e_doc_id"), F.col("mark").alias("e_mark"), F.col("pos").alias("e_pos"), F.col("line").alias("earlier_line"))
    both = wanted.join(texts, ID).join(earlier, ["e_doc_id", "e_mark", "e_pos"]).select(*ID, "line", "earlier_line")
    checked = in_batches(both, verify, "doc_id long, mark long, pos long")
    return found.union(checked).distinct()


def removals(docs: DataFrame) -> DataFrame:
    """doc_id, mark and pos of every line occurrence to remove."""
    every = occurrences(docs)
    keys = ["chars", "k0", "k1", "k2", "k3"]
    lines = cut(every.groupBy("h", "g").agg(F.min(F.struct(*ID)).alias("first"), (F.count(F.lit(1)) > 1).alias("again"), *[F.first(k).alias(k) for k in keys])
                .select("h", "g", "first.*", "again", *keys))
    later = later_lines(docs, lines).withColumn("gone", F.lit(True))
    judged = lines.select("h", "g", *ID, "again").join(later, ID, "left").where("gone or again")
    judged = cut(judged.select("h", "g", F.struct(*ID).alias("first"), F.coalesce("gone", F.lit(False)).alias("gone")))
    return (occurrences(docs, bitmap(judged, ["h"], KEY_BITMAP, F.pmod("h", F.lit(KEY_BITMAP)))).join(judged, ["h", "g"])
            .where(F.col("gone") | (F.struct(*ID) != F.col("first"))).select(*ID))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with the later of equal and nearly equal lines removed, and n_lines and n_removed (in place of columns of these names)."""
    docs = docs.drop("n_lines", "n_removed")
    gone = removals(docs).groupBy("doc_id", "mark").agg(F.collect_set("pos").alias("_gone")).select(F.col("doc_id").alias("_doc"), F.col("mark").alias("_mark"), "_gone")
    rows = docs.withColumn("_of", F.xxhash64("text"))
    joined = rows.join(gone, (F.col("doc_id") == F.col("_doc")) & (F.col("_of") == F.col("_mark")), "left").drop("_doc", "_mark", "_of")
    names = [f.name for f in docs.schema.fields]
    schema = docs.select(*names).schema.add("n_lines", "long").add("n_removed", "long")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, total, removed = [], [], []
            for text, drop in zip(batch.column("text").to_pylist(), batch.column("_gone").to_pylist()):
                lines = text.split("\n") if text else []
                total.append(len(lines))
                removed.append(len(drop or ()))
                if drop:
                    out = set(drop)
                    text = "\n".join(x for i, x in enumerate(lines) if i not in out)
                texts.append(text)
            columns = [pa.array(texts, type=pa.string()) if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total, type=pa.int64()), pa.array(removed, type=pa.int64())], names=[*names, "n_lines", "n_removed"])

    return in_batches(joined.select(*names, "_gone"), task, schema)
