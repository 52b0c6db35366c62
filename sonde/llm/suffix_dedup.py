"""Removal of passages that occur elsewhere, by a hash-compared suffix sort.

A byte goes if a string of ``LENGTH`` bytes over it also starts anywhere else. Not every
place is sorted: of the hashes of ``GRAM`` bytes, the least among each ``SPAN`` neighbours is
an anchor, so equal strings of LENGTH bytes hold an anchor at the same offset, and only
places around equal anchors need to be compared.

Around an anchor at `a`, the strings that start at a - o (o from 0 to SPAN - 1) are sought.
Anchors with equal grams and equal surroundings are one class, of which all such strings are
repeated. One member of each class is compared with the other classes of its group: prefix
polynomial hashes and binary search give the common extension of two of them, a mergesort
with it orders the continuations to the right and, read backwards, to the left, and the
extensions of neighbours, which are verified byte by byte, tell for each o which of them agree
on both sides. A group of more than ``GROUP`` classes is never gathered: the range of o is
halved, which leaves narrower common parts to group by and wider ones to form classes by.

The same search over words instead of bytes (``PASSAGE``) reports, beside the removal, which
words stand in a run of that many words that another document holds too, however few bytes
the run has; there the places must lie in different documents. A word is a hash of 32 bits there, so
that 51 words in a row are told apart by 1632 bits. Only grams that two documents have are looked at again.
Surroundings are told apart by 128-bit names.

Edge cases: a null or empty text keeps nothing and loses nothing; a text below LENGTH bytes
is kept, one below PASSAGE words has no passage; equal rows are places and documents of their
own, so equal long texts go altogether; null ids and further columns have no influence; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonde.functions.shipping import map_batches
from sonde.llm import scratch

GROUP = 8192
#: A key with more rows than this and one in HOT_KEYS of all is joined by broadcast: at most HOT_KEYS such keys exist.
HOT_KEYS = 20_000


@dataclass(frozen=True)
class Unit:
    """What strings consist of: bytes, or words (as hashes) that must recur in another document."""

    length: int
    gram: int
    words: bool = False

    @property
    def span(self) -> int:
        return self.length - self.gram + 1

    @property
    def dtype(self) -> type:
        return np.uint32 if self.words else np.uint8

    @property
    def size(self) -> int:
        return np.dtype(self.dtype).itemsize


BYTES = Unit(400, 100)
#: Passages of over 50 words.
PASSAGE = Unit(51, 8, words=True)
LENGTH = BYTES.length
#: Text that is looked at at once, so that what is made of it stays near the processor.
PIECE_BYTES = 1 << 17
_WHITE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 1 << 64)


class _Powers:
    """Powers of the base and of its inverse, modulo 2**64."""

    up, down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 2 * len(cls.up), 4096)
            base = np.full(size, _BASE, np.uint64)
            unbase = np.full(size, _UNBASE, np.uint64)
            base[0] = unbase[0] = 1
            cls.up, cls.down = np.multiply.accumulate(base), np.multiply.accumulate(unbase)
        return cls.up[:n], cls.down[:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the first 0, 1, 2 ... bytes along the last axis."""
    terms = (data.astype(np.uint64) + np.uint64(1)) * _Powers.of(data.shape[-1])[1]
    return np.concatenate([np.zeros((*data.shape[:-1], 1), np.uint64), np.cumsum(terms, axis=-1, dtype=np.uint64)], axis=-1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sliding(x: np.ndarray, width: int, f) -> np.ndarray:
    have = 1
    while have < width:
        more = min(have, width - have)
        x = f(x[:-more], x[more:])
        have += more
    return x


def word_hashes(data: np.ndarray, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of texts that stand one after another, and where each text's words end."""
    ends = np.array([len(data)]) if ends is None else ends
    inside = np.r_[False, ~_WHITE[data], False]
    cut = np.zeros(len(data) + 1, bool)  # a text begins or ends here
    cut[ends] = cut[0] = True
    start = np.flatnonzero(inside[1:] & (~inside[:-1] | cut) & np.r_[np.ones(len(data), bool), False])
    stop = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    upto = prefix_hashes(data)
    hashes = _mixed((upto[stop] - upto[start]) * _Powers.of(len(data) + 1)[0][start] + (stop - start).astype(np.uint64))
    return hashes.astype(np.uint32), np.searchsorted(start, ends)


def anchors(data: np.ndarray, unit: Unit = BYTES, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of anchors and the hashes of their grams, in texts that stand one after another."""
    if len(data) < unit.length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    upto = prefix_hashes(data)
    grams = _mixed((upto[unit.gram :] - upto[: -unit.gram]) * _Powers.of(len(data))[0][: len(upto) - unit.gram])
    least = _sliding(grams, unit.span, np.minimum)
    if ends is not None:  # strings that reach into the next text say nothing
        at = (ends[:, None] - np.arange(1, unit.length)).ravel()
        least[at[(at >= 0) & (at < len(least))]] = 0
    pad = np.zeros(unit.span - 1, np.uint64)
    at = np.flatnonzero(_sliding(np.r_[pad, least, pad], unit.span, np.maximum) == grams)
    return at, grams[at]


_SALTS = [n.to_bytes(8, "little") for n in range(max(BYTES.span, PASSAGE.span))]


def _class(context: bytes, left: int) -> bytes:
    """A name for the surroundings: two equal names mean equal elements at equal places."""
    return hashlib.blake2b(context, digest_size=16, salt=_SALTS[left] if left < len(_SALTS) else left.to_bytes(8, "little")).digest()


# -- the suffix sort ------------------------------------------------------------------------


def _common(hashes: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading bytes rows a and b have in common, by binary search over hashes."""
    low, high = np.zeros(len(a), np.int64), np.minimum(size[a], size[b])
    while (low < high).any():
        mid = (low + high + 1) >> 1
        same = hashes[a, mid] == hashes[b, mid]
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def _less(data: np.ndarray, hashes: np.ndarray, size: np.ndarray, group: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether row a comes before row b: by group, then by bytes, a prefix first, ties by number."""
    out = group[a] < group[b]
    same = np.flatnonzero(group[a] == group[b])
    a, b = a[same], b[same]
    n = _common(hashes, size, a, b)
    ended = (n == size[a]) | (n == size[b])
    last = data.shape[1] - 1
    byte = data[a, np.minimum(n, last)] < data[b, np.minimum(n, last)]
    short = (size[a] < size[b]) | ((size[a] == size[b]) & (a < b))
    out[same] = np.where(ended, short, byte)
    return out


def suffix_order(data: np.ndarray, size: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in order of group and bytes, and what each has in common with the one before.

    A mergesort whose runs double; an element's place in a merge is its place in its own run
    and the number of smaller ones in the other, found by binary search. Neighbours are then
    compared byte by byte; should hashes have misled the sort, plain bytes do it again.
    """
    m = len(size)
    hashes = prefix_hashes(data)
    order, width = np.arange(m), 1
    place = np.arange(m)
    while width < m:
        run = place // width
        other = np.minimum((run ^ 1) * width, m)
        low, high = np.zeros(m, np.int64), np.minimum(other + width, m) - other
        # rows ascend by group, so only a group on both sides of a seam needs a search
        beside = np.where(run & 1, other + high, other + 1) - 1
        own, theirs = group[order], group[order[np.minimum(beside, m - 1)]]
        apart = np.where(run & 1, own > theirs, own < theirs) & (high > 0)
        low, high = np.where(apart & (run & 1 == 1), high, low), np.where(apart & (run & 1 == 0), 0, high)
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            mid = (low[open_] + high[open_]) >> 1
            before = _less(data, hashes, size, group, order[other[open_] + mid], order[open_])
            low[open_] = np.where(before, mid + 1, low[open_])
            high[open_] = np.where(before, high[open_], mid)
        to = (run & ~1) * width + place % width + low
        merged = np.empty(m, np.int64)
        merged[to] = order
        order, width = merged, 2 * width
    common, sorted_ = _verified(data, size, group, order)
    if not sorted_:
        order = np.array(sorted(range(m), key=lambda k: (group[k], data[k, : size[k]].tobytes(), k)), np.int64)
        common, _ = _verified(data, size, group, order)
    return order, common


def _agreeing(data: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading elements rows a and b have in common, element by element."""
    differs = np.concatenate([data[a] != data[b], np.ones((len(a), 1), bool)], axis=1)
    return np.minimum(differs.argmax(axis=1), np.minimum(size[a], size[b]))


def _verified(data: np.ndarray, size: np.ndarray, group: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, bool]:
    """Common bytes of neighbours in the order, and whether it is one."""
    a, b = order[:-1], order[1:]
    most = np.minimum(size[a], size[b])
    n = _agreeing(data, size, a, b)
    n[group[a] != group[b]] = 0
    last = data.shape[1] - 1
    right = np.where(n == most, size[a] <= size[b], data[a, np.minimum(n, last)] < data[b, np.minimum(n, last)])
    good = (group[a] < group[b]) | ((group[a] == group[b]) & right)
    return np.r_[0, n], bool(good.all())


def repeated(contexts: list[bytes], left: np.ndarray, group: np.ndarray, low: int, high: int, unit: Unit = BYTES, owner: np.ndarray | None = None) -> np.ndarray:
    """For each context and each o in low..high, whether another owner of its group has the same string at o.

    A context holds left elements, the gram and what follows; group numbers do not fall. Without
    owners each context is one of its own.
    """
    m = len(contexts)
    owner = np.arange(m) if owner is None else owner
    after = np.array([len(c) for c in contexts], np.int64) // unit.size - left
    forward, backward = np.zeros((m, unit.length), unit.dtype), np.zeros((m, unit.span - 1), unit.dtype)
    for k, c in enumerate(contexts):
        raw = np.frombuffer(c, unit.dtype)
        forward[k, : after[k]] = raw[left[k] :]
        backward[k, : left[k]] = raw[: left[k]][::-1]
    out = np.zeros((m, high - low + 1), bool)
    begin = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if m else np.zeros(0, np.int64)
    size = np.diff(np.r_[begin, m])
    two = begin[size == 2]
    if len(two):  # what two have in common on either side bounds the offsets
        right, back = (_agreeing(x, n, two, two + 1)[:, None] for x, n in ((forward, after), (backward, left)))
        o = np.arange(low, high + 1)
        out[two] = out[two + 1] = (o >= unit.length - right) & (o <= back) & (owner[two] != owner[two + 1])[:, None]
    rest = np.flatnonzero(np.repeat(size > 2, size))
    if len(rest):
        out[rest] = _in_large_groups(forward[rest], after[rest], backward[rest], left[rest], group[rest], low, high, unit, owner[rest])
    return out


def _in_large_groups(forward: np.ndarray, after: np.ndarray, backward: np.ndarray, left: np.ndarray, group: np.ndarray, low: int, high: int, unit: Unit, owner: np.ndarray) -> np.ndarray:
    m = len(left)
    (right_order, right_common), (left_order, left_common) = suffix_order(forward, after, group), suffix_order(backward, left, group)
    first = np.r_[True, group[right_order][1:] != group[right_order][:-1]] if m else np.zeros(0, bool)
    out = np.zeros((m, high - low + 1), bool)
    right_class, left_class = np.empty(m, np.int64), np.empty(m, np.int64)
    for o in range(low, high + 1):
        right_class[right_order] = np.cumsum(first | (right_common < unit.length - o))
        left_class[left_order] = np.cumsum(first | (left_common < o))
        there = np.flatnonzero((left >= o) & (after >= unit.length - o))
        if not len(there):
            continue
        key = right_class[there] * (m + 1) + left_class[there]
        by = np.argsort(key, kind="stable")
        run = np.flatnonzero(np.r_[True, key[by][1:] != key[by][:-1]])
        owners = owner[there[by]]
        several = np.minimum.reduceat(owners, run) != np.maximum.reduceat(owners, run)
        out[there[by], o - low] = np.repeat(several, np.diff(np.r_[run, len(by)]))
    return out


# -- the distributed part -------------------------------------------------------------------

_ITEM = [T.StructField("uid", T.LongType()), T.StructField("at", T.IntegerType()), T.StructField("left", T.IntegerType())]
_KEYS = [T.StructField("low", T.IntegerType()), T.StructField("high", T.IntegerType()), T.StructField("gram", T.LongType()), T.StructField("c1", T.LongType()), T.StructField("c2", T.LongType())]
_FOUND = T.StructType([T.StructField("uid", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())])


def _text_at(batch: pa.RecordBatch, column: str, k: int, unit: Unit = BYTES) -> np.ndarray:
    value = batch.column(column)[k]
    data = np.frombuffer(value.as_buffer(), np.uint8) if value.is_valid and len(value.as_buffer()) else np.zeros(0, np.uint8)
    return word_hashes(data)[0] if unit.words else data


def _elements(batch: pa.RecordBatch, unit: Unit) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows a to b of the batch at a time, about PIECE_BYTES of text: their elements, and where each row's end."""
    text = batch.column("text")
    text = text.fill_null("") if text.null_count else text
    offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(text):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + PIECE_BYTES, side="right")) - 1)
        piece, ends = data[offsets[a] : offsets[b]], offsets[a + 1 : b + 1] - offsets[a]
        yield a, b, *(word_hashes(piece, ends) if unit.words else (piece, ends))
        a = b


def _find_anchors(unit: Unit):
    """Anchors with a name for their surroundings; in words, only those of the grams that a row lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            uids = b.column("uid").to_numpy()
            for first, stop, data, ends in _elements(b, unit):
                at, grams = anchors(data, unit, ends)
                row = np.searchsorted(ends, at, side="right")
                if unit.words:
                    listed = b.column("grams").slice(first, stop - first)
                    of = np.repeat(np.arange(stop - first), np.diff(listed.offsets.to_numpy()))
                    asked = _mixed(listed.flatten().to_numpy().view(np.uint64) + of.astype(np.uint64))
                    some = np.isin(_mixed(grams + row.astype(np.uint64)), asked)
                    at, grams, row = at[some], grams[some], row[some]
                if not len(at):
                    continue
                begin = np.r_[0, ends[:-1]][row]
                left, upto = np.minimum(at - begin, unit.span - 1), np.minimum(at + unit.length, ends[row])
                raw, size = data.tobytes(), unit.size
                names = np.frombuffer(b"".join([_class(raw[size * s : size * e], n) for s, e, n in zip((at - left).tolist(), upto.tolist(), left.tolist(), strict=True)]), np.int64).reshape(-1, 2)
                if unit.words:  # one place of each class of a row; `complete` finds the others
                    by = np.lexsort((at, names[:, 1], names[:, 0], row))
                    new = np.r_[True, (row[by][1:] != row[by][:-1]) | (names[by][1:] != names[by][:-1]).any(axis=1)]
                    one = np.sort(by[new])
                    at, grams, row, begin, left, upto, names = (x[one] for x in (at, grams, row, begin, left, upto, names))
                columns = [uids[first + row], (at - begin).astype(np.int32), left.astype(np.int32), (upto - at).astype(np.int32), grams.view(np.int64), names[:, 0], names[:, 1]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["uid", "at", "left", "after", "gram", "c1", "c2"])

    return run


def _find_grams(unit: Unit):
    """(uid, gram): the grams of a text's anchors, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            uids = b.column("uid").to_numpy()
            for first, _, data, ends in _elements(b, unit):
                at, grams = anchors(data, unit, ends)
                row = np.searchsorted(ends, at, side="right")
                by = np.lexsort((grams, row))
                row, grams = row[by], grams[by]
                new = np.r_[True, (row[1:] != row[:-1]) | (grams[1:] != grams[:-1])] if len(row) else np.zeros(0, bool)
                yield pa.RecordBatch.from_arrays([pa.array(uids[first + row[new]]), pa.array(grams[new].view(np.int64))], names=["uid", "gram"])

    return run


def _cut_contexts(unit: Unit):
    """The elements around the places that are wanted of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                yield _gather(b, k, _text_at(b, "text", k, unit).tobytes(), unit.size)

    return run


def _gather(b: pa.RecordBatch, k: int, raw: bytes, size: int) -> pa.RecordBatch:
    wanted = b.column("wanted")[k].values
    at, left, after = (wanted.field(n).to_numpy() for n in ("at", "left", "after"))
    context = [raw[size * (a - n) : size * (a + m)] for a, n, m in zip(at.tolist(), left.tolist(), after.tolist(), strict=True)]
    uid = np.full(len(at), b.column("uid")[k].as_py())
    return pa.RecordBatch.from_arrays([pa.array(uid), pa.array(at), pa.array(left), wanted.field("gram"), wanted.field("alone"), wanted.field("many"), pa.array(context, pa.binary())], names=["uid", "at", "left", "gram", "alone", "many", "context"])


def _compare(unit: Unit):
    """Rows sorted by (low, high, gram): sorts whole groups, some at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(t: pa.Table) -> pa.RecordBatch:
            low, high, gram = (t.column(n).to_numpy() for n in ("low", "high", "gram"))
            uid, at, alone = (t.column(n).to_numpy() for n in ("uid", "at", "alone"))
            left, contexts = t.column("left").to_numpy().astype(np.int64), t.column("context").to_pylist()
            ranges = np.flatnonzero(np.r_[True, (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
            found = []
            for s, e in zip(ranges, np.r_[ranges[1:], len(low)], strict=True):
                group = np.cumsum(np.r_[0, gram[s + 1 : e] != gram[s : e - 1]])
                # a class that several documents have agrees with any of them
                owner = np.where(alone[s:e], uid[s:e], -1) if unit.words else None
                hit = repeated(contexts[s:e], left[s:e], group, int(low[s]), int(high[s]), unit, owner)
                hit[~alone[s:e]] = False  # the whole class is repeated anyway
                pad = np.zeros((e - s, 1), bool)
                edge = np.diff(np.concatenate([pad, hit, pad], axis=1).astype(np.int8), axis=1)
                (row, first), (_, last) = np.nonzero(edge == 1), np.nonzero(edge == -1)
                first, last = first + low[s], last - 1 + low[s]  # from offset first to last
                found.append((uid[s:e][row], at[s:e][row] - last, at[s:e][row] - first + unit.length))
            cols = [np.concatenate(c) for c in zip(*found, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1].astype(np.int32)), pa.array(cols[2].astype(np.int32))], names=["uid", "start", "stop"])

        held: list[pa.Table] = []
        n = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(pa.Table.from_batches([b]))
            n += b.num_rows
            if n < GROUP:
                continue
            t = pa.concat_tables(held).combine_chunks()
            key = [t.column(c).to_numpy() for c in ("low", "high", "gram")]
            start = np.flatnonzero(np.r_[True, np.any([k[1:] != k[:-1] for k in key], axis=0)])
            done = 0
            while True:  # whole groups of about GROUP rows; the last one may go on in the next batch
                upto = start[(start > done) & (start <= max(done + GROUP, start[start > done][0] if (start > done).any() else 0))]
                if not len(upto):
                    break
                yield solved(t.slice(done, int(upto[-1]) - done))
                done = int(upto[-1])
            held, n = [t.slice(done)], t.num_rows - done
        if n:
            yield solved(pa.concat_tables(held).combine_chunks())

    return run


def _halve(unit: Unit):
    """Each row for both halves of its range of offsets, with the keys that these have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = unit.size
        for b in batches:
            out: dict[str, list] = {n: [] for n in ("uid", "at", "left", "context", "alone", "low", "high", "gram", "c1", "c2")}
            for uid, at, left, context, alone, low, high in zip(*(b.column(n).to_pylist() for n in ("uid", "at", "left", "context", "alone", "low", "high")), strict=True):
                mid, right = (low + high) // 2, len(context) // size - left - unit.gram
                for lo, hi in ((low, mid), (mid + 1, high)):
                    if lo > hi or left < lo or right < unit.span - 1 - hi:
                        continue
                    narrow, _ = struct.unpack("<qq", _class(context[size * (left - lo) : size * (left + unit.length - hi)], lo))
                    near = min(hi, left)
                    wide = struct.unpack("<qq", _class(context[size * (left - near) : size * (left + unit.length - lo)], near))
                    for name, value in zip(out, (uid, at, left, context, alone, lo, hi, narrow, *wide), strict=True):
                        out[name].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out["uid"], pa.int64()), pa.array(out["at"], pa.int32()), pa.array(out["left"], pa.int32()), pa.array(out["context"], pa.binary()), pa.array(out["alone"], pa.bool_()), pa.array(out["low"], pa.int32()), pa.array(out["high"], pa.int32()), pa.array(out["gram"], pa.int64()), pa.array(out["c1"], pa.int64()), pa.array(out["c2"], pa.int64())], names=list(out))

    return run


def _of_keys(rows: DataFrame, keys: DataFrame, on: list[str], n: str, total: int) -> DataFrame:
    """rows joined with keys (one row each, n: how many rows have it), whatever one key's share.

    Of all keys at most HOT_KEYS have more than that part of the rows; these are broadcast.
    """
    hot = F.col(n) > max(GROUP, total // HOT_KEYS)
    name = F.xxhash64(*on)
    names = [r[0] for r in keys.filter(hot).select(name).collect()]  # at most HOT_KEYS numbers
    if not names:
        return rows.join(keys, on)
    # a key of another one's hash goes the same way on both sides
    listed = name.isin(names)
    return rows.filter(listed).join(F.broadcast(keys.filter(listed)), on).unionByName(rows.filter(~listed).join(keys.filter(~listed), on))


def _with_shared_grams(docs: DataFrame, unit: Unit) -> DataFrame:
    """Those docs that share a gram with another one, with the array `grams`."""
    slim = scratch.save(map_batches(docs.select("uid", "text"), _find_grams(unit), "uid long, gram long"), "grams")
    shared = scratch.save(slim.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
    total = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    lists = scratch.save(_of_keys(slim, shared, ["gram"], "n", total).groupBy("uid").agg(F.collect_list("gram").alias("grams")), "lists")
    scratch.drop(slim)
    scratch.drop(shared)
    return docs.join(lists, "uid")


def repeated_ranges(docs: DataFrame, unit: Unit = BYTES, group: int = GROUP) -> DataFrame:
    """(uid, start, stop): ranges of docs (uid, text), in elements of the unit, that lie in repeated strings; they may overlap."""
    schema = T.StructType([*_ITEM, T.StructField("after", T.IntegerType()), *_KEYS[2:]])
    looked_at = _with_shared_grams(docs.select("uid", "text"), unit).select("uid", "text", "grams") if unit.words else docs.select("uid", "text")
    items = scratch.save(map_batches(looked_at, _find_anchors(unit), schema), "anchors")
    classes = items.groupBy("gram", "c1", "c2").agg(F.count("*").alias("n"), (F.count("*") == 1).alias("alone"), F.min(F.struct("uid", "at", "left", "after")).alias("one"))
    classes = scratch.save(classes, "classes")
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    copies = _of_keys(items, classes.filter("NOT alone").select("gram", "c1", "c2", "n"), ["gram", "c1", "c2"], "n", total)
    found = copies.filter(F.col("left") + F.col("after") >= unit.length).select("uid", (F.col("at") - F.col("left")).alias("start"), (F.col("at") + F.col("after")).alias("stop"))

    shared = classes.groupBy("gram").agg(F.count("*").alias("many"), *([F.min("one.uid").alias("_lo"), F.max("one.uid").alias("_hi"), F.min("alone").alias("_alone")] if unit.words else [])).filter("many > 1")
    if unit.words:  # grams of one document alone have nothing to compare
        shared = shared.filter("_lo < _hi OR NOT _alone").select("gram", "many")
    wanted = _of_keys(classes.select("gram", "alone", "one"), shared, ["gram"], "many", total).select("one.*", "gram", "alone", "many")
    lists = wanted.groupBy("uid").agg(F.collect_list(F.struct("at", "left", "after", "gram", "alone", "many")).alias("wanted"))
    cut_schema = T.StructType([*_ITEM, T.StructField("gram", T.LongType()), T.StructField("alone", T.BooleanType()), T.StructField("many", T.LongType()), T.StructField("context", T.BinaryType())])
    cut = map_batches(docs.select("uid", "text").join(lists, "uid"), _cut_contexts(unit), cut_schema)
    level = scratch.save(cut.withColumn("low", F.lit(0)).withColumn("high", F.lit(unit.span - 1)), "contexts")
    found = scratch.save(found, "found")
    scratch.drop(items)
    scratch.drop(classes)
    deeper = T.StructType([*_ITEM, T.StructField("context", T.BinaryType()), T.StructField("alone", T.BooleanType()), *_KEYS])
    while True:
        few = level.filter(F.col("many") <= group).select(*[f.name for f in _ITEM], "alone", "context", "low", "high", "gram")
        compared = map_batches(few.repartition("low", "high", "gram").sortWithinPartitions("low", "high", "gram"), _compare(unit), _FOUND)
        found = found.unionByName(scratch.save(compared, "found"))
        large = level.filter(F.col("many") > group)
        if large.isEmpty():
            scratch.drop(level)
            return found
        rows = scratch.save(map_batches(large, _halve(unit), deeper), "halves")
        scratch.drop(level)
        key = ["low", "high", "gram", "c1", "c2"]
        owns = F.when(F.col("alone"), F.col("uid"))  # null where the class already has several
        repeats = (F.min("uid") < F.max("uid") if unit.words else F.count("*") > 1) | (F.count(owns) < F.count("*"))
        sizes = scratch.save(rows.groupBy(*key).agg(F.count("*").alias("n"), (~repeats).alias("single"), F.min(F.struct("uid", "at")).alias("one")), "classes")
        total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        both = _of_keys(rows.filter("alone"), sizes.filter("NOT single").select(*key, "n"), key, "n", total)
        start = F.col("at") - F.least("high", "left")
        stop = F.col("at") + F.least(unit.length - F.col("low"), F.length("context") / unit.size - F.col("left")).cast("int")
        ranges = both.select("uid", start.alias("start"), stop.alias("stop")).filter(F.col("stop") - F.col("start") >= unit.length)
        found = found.unionByName(scratch.save(ranges, "found"))
        groups = sizes.groupBy("low", "high", "gram").agg(F.count("*").alias("many")).filter("many > 1")
        ones = _of_keys(sizes.select(*key, "one", "single"), groups, ["low", "high", "gram"], "many", total).select("low", "high", "gram", F.col("one.uid").alias("uid"), F.col("one.at").alias("at"), "single", "many")
        level = scratch.save(rows.drop("c1", "c2", "alone").join(ones, ["low", "high", "gram", "uid", "at"]).withColumnRenamed("single", "alone"), "contexts")
        scratch.drop(rows)
        scratch.drop(sizes)


def _merged(batch: pa.RecordBatch, column: str, k: int) -> np.ndarray:
    """The ranges (start, stop) of a row in order, joined where they meet."""
    values = batch.column(column)[k].values
    if values is None or not len(values):
        return np.zeros((0, 2), np.int64)
    start, stop = (values.field(n).to_numpy().astype(np.int64) for n in ("start", "stop"))
    by = np.argsort(start, kind="stable")
    start, upto = start[by], np.maximum.accumulate(stop[by])
    first = np.flatnonzero(np.r_[True, start[1:] > upto[:-1]])
    return np.stack([start[first], upto[np.r_[first[1:], len(start)] - 1]], axis=1)


def complete(data: np.ndarray, ranges: np.ndarray, unit: Unit) -> np.ndarray:
    """The ranges and all others of the same strings in data, joined where they meet."""
    upto = prefix_hashes(data)
    strings = _mixed((upto[unit.length :] - upto[: -unit.length]) * _Powers.of(len(data))[0][: len(upto) - unit.length])
    known = np.concatenate([strings[s : e - unit.length + 1] for s, e in ranges.tolist()])
    at = np.flatnonzero(np.isin(strings, known))
    first = np.flatnonzero(np.r_[True, at[1:] > at[:-1] + unit.length])
    return np.stack([at[first], at[np.r_[first[1:], len(at)] - 1] + unit.length], axis=1)


def cleaned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", group: int = GROUP, unit: Unit = BYTES, passage: Unit = PASSAGE) -> DataFrame:
    """(doc_id, kept, n_bytes, n_removed, n_spans, n_passages, passage_words) for each row.

    kept has the bytes that remain; the last two count maximal runs of words that lie in passages
    of other documents too, and the words in them.
    """
    rows = scratch.by_uid(docs.select(F.monotonically_increasing_id().alias("uid"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    both = repeated_ranges(rows, unit, group).withColumn("words", F.lit(False)).unionByName(repeated_ranges(rows, passage, group).withColumn("words", F.lit(True)))
    part = lambda of: F.collect_set(F.when(of, F.struct("start", "stop")))
    lists = both.groupBy("uid").agg(part(~F.col("words")).alias("ranges"), part(F.col("words")).alias("passages"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("kept", T.BinaryType()), *(T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans", "n_passages", "passage_words"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, sums = [], []
            for k in range(b.num_rows):
                raw = _text_at(b, "text", k).tobytes()
                gone, held = _merged(b, "ranges", k), _merged(b, "passages", k)
                if len(held):
                    held = complete(_text_at(b, "text", k, passage), held, passage)
                ends = [0, *gone.ravel().tolist(), len(raw)]
                kept.append(b"".join([raw[s:e] for s, e in zip(ends[::2], ends[1::2], strict=True)]) if len(gone) else raw)
                sums.append((len(raw), len(raw) - len(kept[-1]), len(gone), len(held), int((held[:, 1] - held[:, 0]).sum())))
            n = np.array(sums, np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(kept, pa.binary()), *(pa.array(n[:, c]) for c in range(5))], names=schema.names)

    return map_batches(rows.join(lists, "uid", "left").select("doc_id", "text", "ranges", "passages"), run, schema)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return cleaned(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passages", "passage_words")
