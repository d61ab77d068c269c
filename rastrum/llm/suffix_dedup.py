"""Substring dedup over a collection's Burrows-Wheeler transform and common prefixes, built column by column.

Every 50-byte string of a document lies in exactly one segment: a stretch of the document whose 50-byte windows share their
minimiser (the 12-byte substring of least hash), with 49 bytes after it. Equal strings have equal minimisers, so segments are
dealt to bins by minimiser and no match crosses bins.

A task works on numbered batches of documents. Equal segments of a batch go to their bin once, with the smallest and the largest
doc_id that hold them in the batch; where they stand is kept with the batch, in a row of its own. A bin answers with (batch, segment)
pairs, and the answers come back to their batch by its number: a passage of very many documents costs its bin one entry a batch, and
what is removed from a document is put together in one place, in one row.

A bin deals its segments to parts through a file on the executor's disk and works on one part after the other, so that memory is bounded
by a part's size whatever the bin's. In a part, segments whose minimiser with 19 bytes on one side occurs in one document only can't
share 50 bytes and are put aside; of the others, equal ones become one string with their smallest doc_id. These strings are a
collection whose transform grows by one symbol of every string each round, from the last to the first. A round reads the files of the
last one in order: it counts the ranks of the new symbols and takes the minimum of the common prefixes between two places of the same
symbol, which plus one is the common prefix of the two suffixes that begin there. Then it writes the new files (transform with suffix
starts, common prefixes) in order. In the finished order suffixes with 50 common bytes are neighbours, and each such group has a
smallest doc_id.

Defined cases: null texts count as empty; texts below 50 bytes have no strings; rows with the same doc_id don't repeat each
other, whatever their texts; rows with a null id neither lose bytes nor count as a smaller document. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
import math
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, settled, texts_of, tidy

LENGTH, GRAM = 50, 12
WINDOW = LENGTH - GRAM + 1  # minimiser places in a string
SIDE = (LENGTH - GRAM) // 2  # bytes that a string has on one side of its minimiser at least
#: Text of segments in a bin and in a part of it; a bin's bytes that wait for their file; file bytes kept in memory; entries read at once.
BIN_BYTES, PART_BYTES, FLUSH, SPOOL, BLOCK = 24 << 20, 5 << 18, 16 << 20, 1 << 20, 1 << 20
#: With more bins than this, their number and their size grow evenly.
MANY_BINS = 20_000
#: Segment text is so many times the documents' text, about.
BLOW_UP = 3.4
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
PAD = 64


def _words(buf: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as a number, a view. buf must end in padding."""
    return np.ndarray((len(buf) - 7,), "<u8", buffer=buf.data, strides=(1,))


def _mix(h: np.ndarray) -> np.ndarray:
    h = h * _A
    h ^= h >> np.uint64(29)
    h *= _B
    h ^= h >> np.uint64(32)
    return h


def cut_segments(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(padded text of all, segments' starts in it, their numbers of strings, places of their minimisers, minimisers' hashes)."""
    buf = np.frombuffer(b"".join(raw) + bytes(PAD), np.uint8)
    n = len(buf) - PAD
    lengths = np.array([len(x) for x in raw], np.int64)
    if n < LENGTH or not (lengths >= LENGTH).any():
        none = np.zeros(0, np.int64)
        return buf, none, none, none, none.astype(np.uint64)
    u = _words(buf)
    valid = np.zeros(n, bool)  # where a string starts
    at = 0
    for x in lengths.tolist():
        if x >= LENGTH:
            valid[at : at + x - LENGTH + 1] = True
        at += x
    got = [_runs(u, valid, lo, min(lo + STRETCH, n - LENGTH + 1)) for lo in range(0, n - LENGTH + 1, STRETCH)]
    return buf, *(np.concatenate(x) for x in zip(*got, strict=True))


#: Strings whose minimisers are found at once; their places must fit into the bits below.
STRETCH, PLACE_BITS = 1 << 23, 24


def _runs(u: np.ndarray, valid: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, numbers of strings, minimisers' places, hashes) of runs of strings lo..hi that share a minimiser. Among equal hashes the
    first in the string is taken, so that the choice depends on the string's bytes alone."""
    n = hi - lo + LENGTH - GRAM
    low = np.uint64((1 << PLACE_BITS) - 1)
    h = _mix(u[lo : lo + n] ^ (u[lo + GRAM - 8 : lo + GRAM - 8 + n] * _B))
    h &= ~low
    h |= np.arange(n, dtype=np.uint64)
    m, k = h, 1
    while 2 * k <= WINDOW:
        m = np.minimum(m[:-k], m[k:])
        k *= 2
    m = np.minimum(m[: len(m) - (WINDOW - k)], m[WINDOW - k :])
    ok = np.zeros(hi - lo + 2, bool)
    ok[1:-1] = valid[lo:hi]
    same = np.zeros(hi - lo + 1, bool)
    same[1:-1] = m[1:] == m[:-1]
    starts = np.flatnonzero(ok[1:-1] & ~(ok[:-2] & same[:-1]))
    ends = np.flatnonzero(ok[1:-1] & ~(ok[2:] & same[1:]))
    least = m[starts]
    return starts + lo, ends - starts + 1, (least & low).astype(np.int64) - starts, _mix(least >> np.uint64(PLACE_BITS))


def gather(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches put together."""
    before = np.cumsum(lengths) - lengths
    return buf[np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))]


def _pack(arrays: list[np.ndarray]) -> bytes:
    head = np.array([len(arrays), *(x.nbytes for x in arrays)], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(x.tobytes() for x in arrays))


def _unpack(blob: bytes, kinds: list[type]) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes = np.frombuffer(raw, np.int64, len(kinds) + 1)[1:].tolist()
    out, at = [], 8 * (len(kinds) + 1)
    for n, kind in zip(sizes, kinds, strict=True):
        out.append(np.frombuffer(raw[at : at + n], kind))
        at += n
    return out


#: A packed row of a bin: lengths, minimiser places, smallest doc_ids (differences), largest minus smallest doc_ids, text of segments.
_SENT = [np.uint8, np.uint8, np.int64, np.int64, np.uint8]
#: A batch's places: ids (differences), tags and lengths of its documents, ascending by id; how often each segment stands; where (differences).
_PLACES = [np.int64, np.int64, np.int64, np.int32, np.int64]


def pack_batch(ids: np.ndarray, tags: np.ndarray, raw: list[bytes], bins: int) -> tuple[list[tuple[int, int, bytes]], bytes | None]:
    """([(bin, number of its first segment, packed segments)], packed places) of a batch of documents in the order of their ids. Segments
    are numbered bin by bin, equal ones once."""
    buf, starts, strings, place, key = cut_segments(raw)
    if not len(starts):
        return [], None
    lengths = strings + LENGTH - 1
    # equal segments have equal keys: only where a key is repeated are texts hashed
    order = np.argsort(key, kind="stable")
    again = key[order][1:] == key[order][:-1]
    maybe = np.zeros(len(key), bool)
    maybe[order[1:][again]] = maybe[order[:-1][again]] = True
    first = np.arange(len(key))
    seen: dict[bytes, int] = {}
    view = memoryview(buf)
    for i, s, n in zip(np.flatnonzero(maybe).tolist(), starts[maybe].tolist(), lengths[maybe].tolist(), strict=True):
        first[i] = seen.setdefault(xxhash.xxh3_128_digest(view[s : s + n]), i)
    dest = (key >> np.uint64(20)) % np.uint64(bins)
    order = np.lexsort((first, dest))
    first, pos = first[order], starts[order]
    new = np.flatnonzero(np.r_[True, first[1:] != first[:-1]])
    times = np.diff(np.r_[new, len(first)])
    own, dest = first[new], dest[order][new]
    sizes = np.array([len(x) for x in raw], np.int64)
    ends = np.cumsum(sizes)
    low, high = (ids[np.searchsorted(ends, pos[at], "right")] for at in (new, new + times - 1))
    bounds = np.flatnonzero(np.r_[True, dest[1:] != dest[:-1], True])
    out = []
    for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        i = own[s:e]
        packed = _pack([lengths[i].astype(np.uint8), place[i].astype(np.uint8), np.diff(low[s:e], prepend=0), high[s:e] - low[s:e], gather(buf, starts[i], lengths[i])])
        out.append((int(dest[s]), s, packed))
    return out, _pack([np.diff(ids, prepend=0), tags, sizes, times.astype(np.int32), np.diff(pos, prepend=0)])


class Spool:
    """A sequence of numbers written in order and read in order: arrays as they were written while small, a temporary file beyond."""

    def __init__(self, kind: type):
        self.kind, self.n, self.parts, self.file, self.at = np.dtype(kind), 0, [], None, (0, 0)

    def write(self, x: np.ndarray) -> None:
        x = np.ascontiguousarray(x, self.kind)
        self.n += len(x)
        if self.file is None and self.n * self.kind.itemsize > SPOOL:
            self.file = tempfile.TemporaryFile()
            for part in self.parts:
                self.file.write(part.data)
            self.parts = []
        if self.file is None:
            self.parts.append(x)
        else:
            self.file.write(x.data)

    def rewind(self) -> None:
        self.at = (0, 0)
        if self.file is not None:
            self.file.seek(0)

    def read(self, n: int) -> np.ndarray:
        """The next n numbers, fewer at the end."""
        if self.file is not None:
            return np.frombuffer(self.file.read(n * self.kind.itemsize), self.kind)
        got = []
        while n and self.at[0] < len(self.parts):
            k, s = self.at
            x = self.parts[k][s : s + n]
            n -= len(x)
            self.at = (k, s + len(x)) if s + len(x) < len(self.parts[k]) else (k + 1, 0)
            got.append(x)
        return got[0] if len(got) == 1 else np.concatenate([np.zeros(0, self.kind), *got])

    def blocks(self) -> Iterator[np.ndarray]:
        """All in order: the arrays that were written, or blocks of the file."""
        self.rewind()
        if self.file is None:
            yield from (x for x in self.parts if len(x))
        else:
            while len(x := self.read(BLOCK)):
                yield x

    def all(self) -> np.ndarray:
        return np.concatenate([np.zeros(0, self.kind), *self.blocks()])

    def close(self) -> None:
        self.parts = []
        if self.file is not None:
            self.file.close()


#: Stands before a whole string in the transform and between strings; no UTF-8 text has this byte.
TERMINATOR = 0xFF


def transform(text: np.ndarray, starts: np.ndarray, lengths: np.ndarray, limit: int = LENGTH) -> tuple[Spool, Spool]:
    """(entries, common prefixes with the entry before, up to limit) of the strings text[starts : starts + lengths]. Strings lie in order
    with a terminator after each, the last byte too. An entry is a suffix's start in text, times 256, plus the symbol before it; the low bytes in order are
    the transform. Round j inserts, for every string that is long enough, its suffix of length j + 1, that is the symbol before its suffix
    of length j. Empty suffixes come first, in order of strings."""
    end = starts + lengths
    wide = np.uint32 if len(text) < 1 << 24 else np.uint64
    entries, prefix = Spool(wide), Spool(np.uint8)
    entries.write(end.astype(wide) << 8 | text[end - 1])
    prefix.write(np.zeros(len(starts), np.uint8))
    heads = np.zeros(257, np.int64)  # suffixes by first symbol, empty ones before them
    heads[0] = len(starts)
    stand = np.bincount(text[end - 1], minlength=256)  # symbols in the transform
    at, place, before = np.arange(len(starts)), end, text[end - 1]  # entries and starts of the last round's suffixes, in order, and the symbols before them
    for _ in range(int(lengths.max(initial=0))):
        go = before != TERMINATOR  # the byte before the first string is the last, a terminator
        (place, rank, symbol, common), (next_rank, next_symbol, next_common) = _ranks(entries, prefix, at[go], stand, limit)
        heads[1:] += np.bincount(symbol, minlength=256)
        before_symbol = np.cumsum(heads)  # heads[c + 1] counts symbol c, so this is all that sort before it
        at, after = before_symbol[symbol] + rank, before_symbol[next_symbol] + next_rank
        place = place - 1
        before = text[place - 1]
        stand = stand + np.bincount(before, minlength=256)
        order = np.argsort(after)
        entries, prefix = _merge(entries, prefix, at, place.astype(wide) << 8 | before, common, after[order], next_common[order])
    return entries, prefix


class RangeMin:
    """Minima of stretches of an array: tables of the minima of 1, 2, 4, ... SPAN places, and the same again for blocks of SPAN places."""

    SPAN = 64

    def __init__(self, x: np.ndarray, blocks: bool = True):
        levels = self.SPAN.bit_length() if blocks else max(1, len(x)).bit_length()
        self.table = np.empty((levels, len(x)), x.dtype)
        self.table[0] = x
        for k in range(1, levels):
            half = 1 << (k - 1)
            np.minimum(self.table[k - 1][: max(0, len(x) - half)], self.table[k - 1][half:], out=self.table[k][: max(0, len(x) - half)])
        self.blocks = RangeMin(self.table[-1][: len(x) - self.SPAN + 1 : self.SPAN], False) if blocks and len(x) >= self.SPAN else None

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minima of places lo to hi, both included."""
        level = np.minimum(np.frexp((hi - lo + 1).astype(float))[1], len(self.table)) - 1
        out = np.minimum(self.table[level, lo], self.table[level, hi + 1 - (1 << level)])
        if self.blocks is not None:
            first, last = -(-lo // self.SPAN), (hi + 1) // self.SPAN - 1
            more = np.flatnonzero(first <= last)
            out[more] = np.minimum(out[more], self.blocks.of(first[more], last[more]))
        return out


def _places(order: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Where the numbers ``of`` stand in a permutation, ascending."""
    asked = np.zeros(len(order), bool)
    asked[of] = True
    return np.flatnonzero(asked[order])


def _ranks(entries: Spool, prefix: Spool, at: np.ndarray, stand: np.ndarray, limit: int) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """In one pass over the files, for the entries ``at`` (ascending), sorted by symbol, then entry: (suffix's start, how often the symbol
    stands before the entry, symbol, common prefix of the suffix that begins with the symbol with the one before it); and for entries that
    aren't asked for but are the symbol's next after one that is: (rank, symbol, common prefix). stand: how often each symbol stands."""
    asked_rows, next_rows = [], []
    so_far = np.zeros(256, np.int64)
    least = np.full(256, 255, np.uint8)  # minimum of the common prefixes after each symbol's last place
    pending = np.zeros(256, bool)  # whether that place was asked for
    lo = 0
    prefix.rewind()
    for block in entries.blocks():
        shared = prefix.read(len(block))
        symbols = block.view(np.uint8)[:: block.itemsize].copy()
        s, e = np.searchsorted(at, (lo, lo + len(block)))
        order = np.argsort(symbols, kind="stable")
        whole = len(block) == entries.n
        count = stand if whole else np.bincount(symbols, minlength=256)
        group = np.cumsum(count) - count  # where each symbol's places begin in the order
        there = np.flatnonzero(count)
        own = _places(order, at[s:e] - lo)
        after = own + 1
        after = after[np.r_[own[1:] != after[:-1], True][: len(own)] & (after < len(block))]
        after = after[symbols[order[after]] == symbols[order[after - 1]]]
        if pending.any():  # symbols whose last place before this block was asked for
            head = group[there[pending[there]]]
            after = np.sort(np.r_[after, head[~np.isin(head, own)]])
        minima = RangeMin(shared)

        def common(k: np.ndarray) -> tuple[np.ndarray, ...]:
            """(entry, rank, symbol, common prefix) of the entries at places k of the order."""
            entry = order[k]
            c = symbols[entry]
            nth = k - group[c]
            low = minima.of(np.where(nth > 0, order[k - 1] + 1, 0), entry)
            low = np.where(nth > 0, low, np.minimum(low, least[c]))
            rank = nth + so_far[c]
            return entry, rank, c, np.where(rank > 0, np.minimum(low + np.uint8(1), limit), 0).astype(np.uint8)

        entry, *rest = common(own)
        asked_rows.append(((block[entry] >> 8).astype(np.int64), *rest))
        next_rows.append(tuple(common(after)[1:]))
        if not whole:
            tail = np.r_[np.minimum.accumulate(shared[::-1])[::-1], np.uint8(255)]
            np.minimum(least, tail[0], out=least)
            last = group[there] + count[there] - 1
            least[there] = tail[order[last] + 1]
            pending[there] = np.isin(last, own)
            so_far += count
        lo += len(block)
    if len(asked_rows) == 1:
        return asked_rows[0], next_rows[0]
    start, rank, c, common = (np.concatenate(x) for x in zip(*asked_rows, strict=True))
    order = np.argsort(c, kind="stable")
    return (start[order], rank[order], c[order], common[order]), tuple(np.concatenate(x) for x in zip(*next_rows, strict=True))


def _merge(entries: Spool, prefix: Spool, at: np.ndarray, new: np.ndarray, common: np.ndarray, after: np.ndarray, next_common: np.ndarray) -> tuple[Spool, Spool]:
    """New files with ``new`` put in as entries ``at`` (ascending) with their common prefixes, and with ``next_common`` as those of the
    entries ``after`` (ascending), in one pass over the old files."""
    out, out_prefix = Spool(entries.kind), Spool(np.uint8)
    total = entries.n + len(at)
    lo = done = 0  # entries and new entries written
    prefix.rewind()
    for old in entries.blocks():
        # old entries of this block that stand before each new entry still to come; those after its last wait, unless no block follows
        ahead = at[done:] - lo - np.arange(len(at) - done)
        take = len(ahead) if lo + len(old) + len(ahead) == total else int(np.searchsorted(ahead, len(old)))
        mask = np.zeros(len(old) + take, bool)
        fresh = at[done : done + take] - lo
        mask[fresh] = True
        stay = ~mask
        got, shared = np.empty(len(mask), old.dtype), np.empty(len(mask), np.uint8)
        got[stay], shared[stay] = old, prefix.read(len(old))
        got[fresh], shared[fresh] = new[done : done + take], common[done : done + take]
        s, e = np.searchsorted(after, (lo, lo + len(mask)))
        shared[after[s:e] - lo] = next_common[s:e]
        out.write(got)
        out_prefix.write(shared)
        lo, done = lo + len(mask), done + take
    entries.close()
    prefix.close()
    return out, out_prefix


def smallest(text: np.ndarray, lengths: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each place of the strings, which lie one after the other in text: the smallest doc of any string that has the same LENGTH
    bytes somewhere; places with fewer bytes to the end have no meaning. doc: of each string."""
    packed = np.cumsum(lengths) - lengths
    starts = packed + np.arange(len(lengths))
    apart = np.repeat(np.arange(len(lengths)), lengths) + np.arange(len(text))
    spaced = np.full(len(text) + len(lengths), TERMINATOR, np.uint8)
    spaced[apart] = text
    files = transform(spaced, starts, lengths)
    suffix, prefix = (files[0].all() >> 8).astype(np.int64), files[1].all()
    for f in files:
        f.close()
    owner = np.repeat(np.arange(len(lengths)), lengths + 1)[suffix]
    long = starts[owner] + lengths[owner] - suffix >= LENGTH
    group = np.cumsum(prefix < LENGTH)[long]
    suffix, owner = suffix[long], owner[long]
    out = np.full(len(text), np.iinfo(np.int64).max)
    if len(suffix):
        new = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        out[suffix - owner] = np.repeat(np.minimum.reduceat(doc[owner], new), np.diff(np.r_[new, len(group)]))
    return out


class Parts:
    """A bin's segments, dealt to parts: written to one file in chunks and read part by part."""

    #: Length, minimiser's place, smallest and largest doc_id, batch, number in the batch of each segment; then their text.
    KINDS = (np.uint8, np.uint8, np.int64, np.int64, np.int32, np.int32)

    def __init__(self, n: int):
        self.held: list[list[tuple[np.ndarray, ...]]] = [[] for _ in range(n)]
        self.chunks: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]  # place in the file, segments, bytes of text
        self.size, self.file, self.batches = 0, None, []

    def add(self, k: int, *arrays: np.ndarray) -> None:
        self.held[k].append(arrays)
        self.size += sum(x.nbytes for x in arrays)
        if self.size >= FLUSH:
            self._flush()

    def _flush(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        at = self.file.seek(0, 2)
        for k, rows in enumerate(self.held):
            if rows:
                arrays = [np.concatenate(x) for x in zip(*rows, strict=True)]
                self.file.writelines(np.ascontiguousarray(x, t).data for x, t in zip(arrays, (*self.KINDS, np.uint8), strict=True))
                self.chunks[k].append((at, len(arrays[0]), len(arrays[-1])))
                at = self.file.tell()
                self.held[k] = []
        self.size = 0

    def read(self, k: int) -> list[np.ndarray]:
        """All of part k."""
        rows = []
        for at, n, size in self.chunks[k]:
            self.file.seek(at)
            rows.append([np.frombuffer(self.file.read(np.dtype(t).itemsize * m), t) for t, m in [*((t, n) for t in self.KINDS), (np.uint8, size)]])
        rows += self.held[k]
        self.held[k] = []
        return [np.concatenate([np.zeros(0, t), *x]) for t, x in zip((*self.KINDS, np.uint8), zip(*rows, strict=True) if rows else [()] * 7, strict=True)]

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


#: An answer: of a batch's segment, from string ``at`` on ``n`` strings whose smallest document is ``least``.
_ANSWER = np.dtype([("segment", "<i4"), ("at", "u1"), ("n", "u1"), ("least", "<i8")])


def answers(lengths: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray, batch: np.ndarray, segment: np.ndarray, text: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(batch, answers) for the batches in which a document holds a string that a smaller document holds too."""
    if not len(lengths):
        return
    lengths, place = lengths.astype(np.int64), place.astype(np.int64)
    begin = np.cumsum(lengths) - lengths
    text = np.r_[text, np.zeros(PAD, np.uint8)]
    u = _words(text)

    def shared(at: np.ndarray, size: int, which: np.ndarray) -> np.ndarray:
        """Of the segments ``which``, those whose ``size`` bytes at ``at`` occur in two documents or more."""
        h = np.zeros(len(which), np.uint64)
        for k in [*range(0, size - 7, 8), size - 8]:
            h = _mix(h ^ u[at + k])
        order = np.argsort(h)
        new = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]])
        many = np.minimum.reduceat(low[which[order]], new) < np.maximum.reduceat(high[which[order]], new)
        return which[order[np.repeat(many, np.diff(np.r_[new, len(order)]))]]

    which = shared(begin + place, GRAM, np.arange(len(lengths)))
    ok = np.zeros(len(lengths), bool)
    for some, at in ((place[which] >= SIDE, begin + place - SIDE), (place[which] + GRAM + SIDE <= lengths[which], begin + place)):
        if some.any():
            ok[shared(at[which[some]], GRAM + SIDE, which[some])] = True
    which = np.flatnonzero(ok)
    if not len(which):
        return
    # equal segments become one string with the smallest document
    view = memoryview(text)
    digests = np.frombuffer(b"".join([xxhash.xxh3_128_digest(view[s : s + n]) for s, n in zip(begin[which].tolist(), lengths[which].tolist(), strict=True)]), np.uint64).reshape(-1, 2)
    order = np.lexsort((digests[:, 0], digests[:, 1]))
    d = digests[order]
    new = np.r_[True, (d[1:] != d[:-1]).any(axis=1)]
    string = np.empty(len(which), np.int64)
    string[order] = np.cumsum(new) - 1
    own = which[order[new]]
    least = np.minimum.reduceat(low[which[order]], np.flatnonzero(new))
    size = lengths[own]
    min_doc = smallest(gather(text, begin[own], size), size, least)
    at = np.cumsum(size) - size
    # each batch's segment with its strings' smallest documents, where they are below the largest that holds it there
    later = high[which] > np.minimum.reduceat(min_doc, at)[string]
    which, string = which[later], string[later]
    order = np.lexsort((segment[which], batch[which]))
    which, string = which[order], string[order]
    if not len(which):
        return
    k = lengths[which] - LENGTH + 1
    head = np.cumsum(k) - k
    within = np.arange(int(k.sum())) - np.repeat(head, k)
    value = min_doc[np.repeat(at[string], k) + within]
    none = np.iinfo(np.int64).max
    value = np.where(value < np.repeat(high[which], k), value, none)
    edge = np.zeros(len(value), bool)
    edge[head] = True
    edge[1:] |= value[1:] != value[:-1]
    run = np.flatnonzero(edge)
    n = np.diff(np.r_[run, len(value)])
    real = value[run] != none
    run, n = run[real], n[real]
    of = which[np.searchsorted(head, run, "right") - 1]
    out = np.empty(len(run), _ANSWER)
    out["segment"], out["at"], out["n"], out["least"] = segment[of], within[run], n, value[run]
    bounds = np.flatnonzero(np.r_[True, batch[of][1:] != batch[of][:-1], True])
    for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        yield int(batch[of[s]]), out[s:e].tobytes()


_OUT = "batch long, kind int, packed binary"


def _receive(parts: int):
    """Reads packed segments, bin after bin, and yields a row for each part and batch with its answers (kind 1). Batches' places (kind 0)
    pass through."""

    def rows(batch: list[int], kind: int, packed: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(batch, pa.int64()), pa.array([kind] * len(batch), pa.int32()), pa.array(packed, pa.binary())], names=["batch", "kind", "packed"])

    def finish(bin_: Parts | None) -> Iterator[pa.RecordBatch]:
        if bin_ is not None:
            for k in range(parts):
                if got := list(answers(*bin_.read(k))):
                    yield rows([bin_.batches[b] for b, _ in got], 1, [x for _, x in got])
            bin_.close()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bin_ = None, None
        for got in batches:
            for b, batch, base, blob in zip(got.column("bin").to_pylist(), got.column("batch").to_pylist(), got.column("base").to_pylist(), got.column("packed"), strict=True):
                if base < 0:
                    yield rows([batch], 0, [blob.as_py()])
                    continue
                if b != now:
                    yield from finish(bin_)
                    now, bin_ = b, Parts(parts)
                lengths, place, low, span, text = _unpack(blob.as_buffer(), _SENT)
                low = np.cumsum(low)
                n = lengths.astype(np.int64)
                begin = np.cumsum(n) - n
                padded = np.r_[text, np.zeros(PAD, np.uint8)]
                u = _words(padded)
                key = begin + place
                to = ((_mix(_mix(u[key]) ^ u[key + GRAM - 8]) >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                bounds = np.searchsorted(to[order], np.arange(parts + 1))
                number = len(bin_.batches)
                bin_.batches.append(batch)
                for k in range(parts):
                    w = order[bounds[k] : bounds[k + 1]]
                    if len(w):
                        bin_.add(k, lengths[w], place[w], low[w], low[w] + span[w], np.full(len(w), number, np.int32), (base + w).astype(np.int32), gather(padded, begin[w], n[w]))
        yield from finish(bin_)

    return run


def _stretches(packed: pa.Scalar, found: list[np.ndarray]) -> pa.RecordBatch | None:
    """A row for each document of a batch that loses bytes, with starts and ends of the stretches, as 64-bit numbers."""
    ids, tags, sizes, times, pos = _unpack(packed.as_buffer(), _PLACES)
    ids, pos, times = np.cumsum(ids), np.cumsum(pos), times.astype(np.int64)
    first, ends = np.cumsum(times) - times, np.cumsum(sizes)
    starts, stops = [], []
    for x in found:
        n = times[x["segment"]]
        run = np.repeat(np.arange(len(x)), n)
        place = np.repeat(first[x["segment"]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        doc = np.searchsorted(ends, pos[place], "right")
        hit = np.flatnonzero(ids[doc] > x["least"][run])
        s = pos[place[hit]] + x["at"][run[hit]] + doc[hit]  # documents are kept apart by one place
        starts.append(s)
        stops.append(s + x["n"][run[hit]] + (LENGTH - 1))
    s, e = np.concatenate(starts), np.concatenate(stops)
    if not len(s):
        return None
    order = np.argsort(s, kind="stable")
    s, reach = s[order], np.maximum.accumulate(e[order])
    new = np.flatnonzero(np.r_[True, s[1:] > reach[:-1]])
    s, e = s[new], reach[np.r_[new[1:] - 1, len(s) - 1]]
    begin = ends - sizes + np.arange(len(ids))
    doc = np.searchsorted(begin, s, "right") - 1
    new = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    pairs = pa.py_buffer(np.stack([s - begin[doc], e - begin[doc]], axis=1).astype(np.int64).tobytes())
    offsets = pa.py_buffer((np.r_[new, len(doc)] * 16).astype(np.int32).tobytes())
    return pa.RecordBatch.from_arrays([pa.array(ids[doc[new]]), pa.array(tags[doc[new]]), pa.BinaryArray.from_buffers(pa.binary(), len(new), [None, offsets, pairs])], names=["id", "tag", "pairs"])


def _bring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads rows by batch, its places first, and yields a row for each document that loses bytes."""
    now, places, found = None, None, []
    for got in batches:
        for batch, kind, packed in zip(got.column("batch").to_pylist(), got.column("kind").to_pylist(), got.column("packed"), strict=True):
            if batch != now:
                if found and (out := _stretches(places, found)):
                    yield out
                now, places, found = batch, None, []
            if kind:
                found.append(np.frombuffer(packed.as_py(), _ANSWER))
            else:
                places = packed
    if found and (out := _stretches(places, found)):
        yield out


def sizes_of(total: int, least: int) -> tuple[int, int]:
    """(bins, parts of a bin) for so many bytes of text and at least so many bins."""
    text = total * BLOW_UP
    bins = math.ceil(text / BIN_BYTES)
    if bins > MANY_BINS:
        bins = math.ceil(math.sqrt(bins * MANY_BINS))
    bins = max(least, bins)
    return bins, max(1, math.ceil(text / bins / PART_BYTES))


def repeats(docs: DataFrame) -> DataFrame:
    """(id, tag, pairs): of each document that holds strings of smaller documents, the maximal stretches that they cover. tag is the text's
    XXH64, which tells rows with the same doc_id apart. docs must have been read from files or a checkpoint: batches are numbered."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bins, parts = sizes_of(size, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for k, batch in enumerate(batches):
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            order = np.argsort(ids, kind="stable")
            texts = texts_of(batch)
            raw = [texts[i].encode() for i in order.tolist()]
            tags = np.array([xxhash.xxh64_intdigest(x, 42) for x in raw], np.uint64).view(np.int64)
            rows, places = pack_batch(ids[order], tags, raw, bins)
            if rows:
                rows.append(((task + k) % bins, -1, places))
                number = [task << 32 | k] * len(rows)
                yield pa.RecordBatch.from_arrays([pa.array([labels[b] for b, *_ in rows], pa.int32()), pa.array(number, pa.int64()), pa.array([s for _, s, _ in rows], pa.int32()), pa.array([x for *_, x in rows], pa.binary())], names=["bin", "batch", "base", "packed"])

    # numbers whose hash deals bin k to task k
    label = spark.range(bins * 24).select(F.col("id").cast("int").alias("label")).groupBy(F.pmod(F.hash("label"), F.lit(bins)).alias("bin")).agg(F.min("label").alias("label")).collect()
    label = {r["bin"]: r["label"] for r in label}
    labels = [label.get(k, k) for k in range(bins)]

    sent = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(send), "bin int, batch long, base int, packed binary")
    got = cut(sent.repartition(bins, "bin").sortWithinPartitions("bin").mapInArrow(tidy(_receive(parts)), _OUT), "repeats")
    return got.repartition("batch").sortWithinPartitions("batch", "kind").mapInArrow(tidy(_bring), "id long, tag long, pairs binary")


def dedup(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the bytes that are left as ``kept`` if with_text; a row for each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = settled(docs.select("doc_id", "text"))
    found = repeats(docs).groupBy("id", "tag").agg(F.first("pairs").alias("pairs"))  # equal rows have equal stretches
    tagged = docs.select("doc_id", "text", F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tag"))
    rows = tagged.join(found, ["id", "tag"], "left").select("doc_id", "text", "pairs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, pairs in zip(texts_of(batch), batch.column("pairs").to_pylist(), strict=True):
                raw = t.encode()
                spans = np.frombuffer(pairs or b"", np.int64).reshape(-1, 2).tolist()
                kept, at = [], 0
                for s, e in spans:
                    kept.append(raw[at:s])
                    at = e
                kept = b"".join([*kept, raw[at:]])
                out.append((len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), *([kept] if with_text else [])))
            kinds = [pa.int64()] * 3 + [pa.string()] + [pa.binary()] * with_text
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])])

    return rows.mapInArrow(tidy(run), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)


#: The same rows by grouping every 50-byte string of every document (as hexadecimal text).
ORACLE_SQL = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
p as (select doc_id, x, unnest(range(0, length(x) // 2 - 49)) as p from d where length(x) >= 100),
s as (select doc_id, p, substr(x, 2 * p + 1, 100) as s from p),
f as (select s, min(doc_id) as m from s group by s),
h as (select doc_id, p from s join f using (s) where m < doc_id),
i as (select doc_id, p, sum(new) over (partition by doc_id order by p) as k from (select doc_id, p, case when p <= lag(p) over (partition by doc_id order by p) + 50 then 0 else 1 end as new from h)),
v as (select doc_id, min(p) as a, max(p) + 50 as b from i group by doc_id, k),
g as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as e from v),
t as (select doc_id, sum(b - a) as n_removed, count(*) as n_spans, max(b) as b, string_agg(substr(x, 2 * e + 1, 2 * (a - e)), '' order by a) as kept from g join d using (doc_id) group by doc_id)
select doc_id, cast(length(x) // 2 as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept || substr(x, 2 * b + 1), x))) as kept_sha256 from d left join t using (doc_id)
"""
