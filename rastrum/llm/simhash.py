"""SimHash near-duplicates: a Gray-order hierarchical index finds fingerprints that differ in few bits.

The index stands inside buckets. Fingerprints of a bucket are sorted by their rank in the binary-reflected Gray code, which puts similar
ones side by side; neighbours are grouped level by level, and each upper node keeps the bits that all below it share as (mask, value). A
search goes down from the root, adds up the differences in the newly shared bits and prunes a whole group as soon as they exceed the limit.

``near_duplicates`` links fingerprints at up to two differing bits. The search runs over distinct fingerprints. Two that differ in two bits
agree in two of four blocks of 16 bits at least, so each fingerprint goes to six buckets, one for each pair of blocks, and every link is
found in some bucket. What a bucket returns is a spanning forest of its links, and the components of all forests are the components
of all links. A bucket with many fingerprints is divided by three parts of its other 32 bits, of which two differing bits leave one equal;
such a part has at most 2 ** 22 distinct fingerprints, so a task's group is bounded whatever the input.

``similar`` links texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, checked exactly. Their fingerprints differ
in ten bits on average, too many for blocks of bits to agree, so buckets are made from shingles: each of VIEWS buckets of a text is named by
its two least shingle hashes under one of VIEWS orders. A pair at 0.8 misses each with a probability of 0.36, all with 0.00004, and one
in 5,000 of such pairs differs in more than WIDE bits. Bucket mates within WIDE bits are candidates. First those of a few leaders of each
bucket are compared, so that a large group of near copies becomes one component for as many comparisons as it has members. Then the
index spans a forest over the candidates that aren't linked yet, and each tree of it is one group: its texts outside the group's
largest component are compared with all of the group, in bounded blocks, in workers that hold the sets of two blocks and return a spanning
forest of the links found. So rows grow with texts, not with pairs. Buckets with very many texts are divided by the texts' other buckets.

What buckets, their division and the bound on bits miss, an exact search of the rest finds. Two sets at 0.8 share one of the n // 5 + 1 least
hashes of each, so lists of texts by those hashes hold every link. Lists that lie in one component are left out; in the others two texts
of different components are candidates if sizes and places allow it, places being the hash's own among the sorted hashes of each set: in the
list of the least hash that two sets share all before it is in one set only, and what follows differs by the difference of its lengths
at least. Only rows that have such a mate get their sets' parity bitmaps, which differ in no more bits than the sets in members, and must
allow the similarity, too. Long lists and large groups are divided by size, since sizes of similar sets differ by a quarter at most, and
then compared in a bounded number of blocks. Candidates become groups and are compared as above, so no link is lost.

Defined cases: words are lower-cased in A-Z and parted by ASCII white space. For ``near_duplicates`` null texts and texts without words have
fingerprint zero, which is linked like any other; for ``similar`` they are linked to nothing. A text of fewer words than a shingle has one
shingle, all its words. Rows with a null id get fingerprint and component of their group in ``near_duplicates``; a group that has only such
rows has a null component; ``similar`` leaves them out. Repeated rows are alike. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, dealt, drop, gathered, hot_keys, spread, texts_of, tidy
from .components import components

BITS, SEED = 64, 42
#: Children of an index node; pairs that a search may hold; fingerprints above which a bucket of blocks is divided.
FAN, PAIRS, DIVIDE = 16, 1 << 18, 2048
#: For similar texts: words of a shingle, orders, bits that may differ, texts above which a bucket is divided, leaders of a bucket, texts of a block.
WORDS, VIEWS, WIDE, BIG, LEADERS, BLOCK = 5, 10, 20, 20_000, 8, 600
#: Least bits of a set's parity bitmap; texts of a list that are compared at once.
PARITY, LIST = 1024, 4000
#: Sizes of a band differ by this factor at most: somewhat more than two similar sets', so that rounding can't part them. Most blocks of a cell.
BAND, BLOCKS = 1.26, 8
#: Rows up to which the ids of texts to compare are broadcast: 16 MB.
SMALL = 1 << 21


def hashes_of(text: str, size: int) -> np.ndarray:
    """Hashes of the text's shingles, repeats included."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    k = max(1, len(words) - size + 1)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], SEED) for s, e in zip(starts[:k].tolist(), ends[min(size, len(words)) - 1 :].tolist(), strict=True)], np.uint64)


def folded(hashes: np.ndarray) -> int:
    """The fingerprint of hashes: a bit is 1 if set in over half of them."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint(text: str, size: int) -> int:
    """The text's fingerprint, zero without words."""
    return folded(hashes_of(text, size))


def fingerprints(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t or "", size) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Each number's place in the binary-reflected Gray code."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Gives the places that the pairs (a, b) connect, directly or through others, the least place among them; labels are places."""
    while True:
        a, b = label[a], label[b]
        differ = a != b
        if not differ.any():
            return
        a, b = a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label[:] = label[label]


class GrayIndex:
    """Distinct fingerprints in Gray order under levels of nodes that factor out shared bits."""

    def __init__(self, fps: np.ndarray):
        self.order = np.argsort(gray_rank(fps), kind="stable")
        self.leaves = fps[self.order]
        full = np.full(len(fps), ~np.uint64(0))
        self.levels = [(full, self.leaves)]  # (mask of shared bits, their values), leaves first
        while len(self.levels[-1][0]) > 1:
            mask, value = self.levels[-1]
            at = np.arange(0, len(mask), FAN)
            ones = np.bitwise_and.reduceat(value & mask, at)
            zeros = np.bitwise_and.reduceat(~value & mask, at)
            self.levels.append((ones | zeros, ones))

    def search(self, queries: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf) numbers of all pairs at ``limit`` differing bits or fewer."""
        q = np.arange(len(queries))
        node = np.zeros(len(queries), np.int64)
        mask, value = self.levels[-1]
        diff = np.bitwise_count((queries ^ value[0]) & mask[0]).astype(np.int64)
        for level in range(len(self.levels) - 2, -1, -1):
            ok = diff <= limit
            q, node, diff = q[ok], node[ok], diff[ok]
            up = self.levels[level + 1][0]
            mask, value = self.levels[level]
            width = np.minimum(FAN, len(mask) - node * FAN)
            parent = np.repeat(node, width)
            child = parent * FAN + np.arange(len(parent)) - np.repeat(np.cumsum(width) - width, width)
            q, diff = np.repeat(q, width), np.repeat(diff, width)
            new = mask[child] & ~up[parent]  # bits that the parent's pattern hasn't counted
            diff = diff + np.bitwise_count((queries[q] ^ value[child]) & new)
            node = child
        ok = diff <= limit
        return q[ok], node[ok]

    def searches(self, queries: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The pairs of ``search``, some queries at a time, so that a bounded number of pairs is held."""
        step = max(1, PAIRS // max(len(self.leaves), 1024))
        for s in range(0, len(queries), step):
            a, b = self.search(queries[s : s + step], limit)
            yield a + s, b

    def forest(self, limit: int) -> np.ndarray:
        """A spanning forest of the links among the leaves: rows (leaf, a leaf of its component)."""
        label = np.arange(len(self.leaves))
        for a, b in self.searches(self.leaves, limit):
            join_labels(label, a, b)
        at = np.flatnonzero(label != np.arange(len(label)))
        return np.stack([at, label[at]], axis=1)


def _links(limit: int):
    """Reads rows sorted by bucket and yields each bucket's forest; a bucket may go on in the next batch."""

    def edges(fps: np.ndarray) -> np.ndarray:
        index = GrayIndex(fps)
        return index.leaves[index.forest(limit)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            sig, bucket, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            fp = fp.view(np.uint64)
            change = np.flatnonzero((sig[1:] != sig[:-1]) | (bucket[1:] != bucket[:-1])) + 1
            out = []
            for s, e in zip([0, *change.tolist()], [*change.tolist(), len(fp)], strict=True):
                if key != (sig[s], bucket[s]):
                    if held and sum(map(len, held)) > 1:
                        out.append(edges(np.concatenate(held)))
                    key, held = (sig[s], bucket[s]), []
                held.append(fp[s:e].copy())
            if out:
                got = np.concatenate(out).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(got[:, 0].copy()), pa.array(got[:, 1].copy())], names=["a", "b"])
        if held and sum(map(len, held)) > 1:
            got = edges(np.concatenate(held)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(got[:, 0].copy()), pa.array(got[:, 1].copy())], names=["a", "b"])

    return run


def links(fps: DataFrame, limit: int = 2) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) whose components are those of all links at ``limit`` (0 to 2) bits."""
    if not 0 <= limit <= 2:
        raise ValueError("the buckets find links of up to two bits")
    block = [F.shiftrightunsigned("fp", 16 * k).bitwiseAND(0xFFFF) for k in range(4)]
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    both = lambda i, j: F.shiftleft(block[i], 16).bitwiseOR(block[j])
    cells = [F.struct(F.lit(k).alias("sig"), both(i, j).alias("bucket"), both(*sorted({0, 1, 2, 3} - {i, j})).alias("rest")) for k, (i, j) in enumerate(pairs)]
    rows = fps.select("fp").distinct().select("fp", F.explode(F.array(*cells)).alias("c")).select("c.*", "fp")
    sizes = rows.groupBy("sig", "bucket").agg(F.count("*").alias("n")).where("n > 1")
    many = rows.join(sizes, ["sig", "bucket"])
    rest = F.col("rest")
    divided = many.where(f"n > {DIVIDE}").select(
        F.explode(
            F.array(
                *[
                    F.struct((F.col("sig") + 6 * (k + 1)).alias("sig"), F.shiftleft("bucket", 12).bitwiseOR(part).alias("bucket"), F.col("fp").alias("fp"))
                    for k, part in enumerate((F.shiftrightunsigned(rest, 21).bitwiseAND(0x7FF), F.shiftrightunsigned(rest, 10).bitwiseAND(0x7FF), rest.bitwiseAND(0x3FF)))
                ]
            )
        ).alias("c")
    )
    ready = many.where(f"n <= {DIVIDE}").select("sig", "bucket", "fp").union(divided.select("c.*"))
    return ready.repartition("sig", "bucket").sortWithinPartitions("sig", "bucket").mapInArrow(tidy(_links(limit), 50_000), "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 3, limit: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id that links reach)."""
    found = cut(fingerprints(docs, size), "fingerprints")
    groups = cut(gathered(found.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))), "groups")
    members = components(links(groups, limit)).withColumnRenamed("node", "fp")
    joined = groups.join(members, "fp")
    least = joined.groupBy("root").agg(F.min("rep").alias("component_id"))
    moved = joined.join(least, "root").select("fp", "component_id")
    of = groups.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"))
    hot = hot_keys(groups, "fp", "n")
    got = dealt(found, "fp", hot, "doc_id").join(spread(of, "fp", hot), ["fp", "part"])
    return gathered(got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


#: Fixed by a rule: an odd multiplier for each order.
_TURNS = np.array([int.from_bytes(hashlib.md5(bytes([k])).digest()[:8], "little") | 1 for k in range(VIEWS)], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def buckets_of(hashes: np.ndarray) -> np.ndarray:
    """The VIEWS buckets of a set of hashes: its two least hashes under each order."""
    least = np.full((VIEWS, 2), ~np.uint64(0))
    for at in range(0, len(hashes), 1 << 16):
        turned = _mix(hashes[None, at : at + (1 << 16)] * _TURNS[:, None])
        least = np.partition(np.concatenate([least, turned], axis=1), 1, axis=1)[:, :2]
    least = np.sort(least, axis=1)
    return _mix(least[:, 0] * _TURNS[0] ^ _mix(least[:, 1] + _TURNS)).view(np.int64)


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """For each remainder whether an odd number of hashes has it: two bitmaps of one size differ in at most as many bits as the sets in
    hashes. The size is the power of two from the number of hashes on, PARITY at least; a half is the exclusive or of two."""
    size = max(PARITY, 1 << (len(hashes) - 1).bit_length())
    return np.packbits((np.bincount((hashes % np.uint64(size)).astype(np.int64), minlength=size) & 1).astype(np.uint8)).view(np.uint64)


class Bitmaps:
    """Bitmaps of several sets, and their halves for sets that are up to twice as large."""

    def __init__(self, bits: list[np.ndarray]):
        self.words = np.array([len(x) for x in bits])
        self.rows, self.at = {}, {}
        for w in np.unique(self.words).tolist():
            own = np.flatnonzero((self.words == w) | (self.words == 2 * w))
            self.at[w] = np.zeros(len(bits), np.int64)
            self.at[w][own] = np.arange(len(own))
            self.rows[w] = np.stack([bits[k] if len(bits[k]) == w else bits[k][:w] ^ bits[k][w:] for k in own.tolist()])

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Differing bits of each pair (a, b) of sets; sizes differ by a factor of two at most."""
        out, low = np.zeros(len(a), np.int64), np.minimum(self.words[a], self.words[b])
        for w, rows in self.rows.items():
            own, at, step = np.flatnonzero(low == w), self.at[w], max(1, (1 << 19) // w)
            for s in range(0, len(own), step):
                k = own[s : s + step]
                out[k] = np.bitwise_count(rows[at[a[k]]] ^ rows[at[b[k]]]).sum(axis=1, dtype=np.int64)
        return out


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def _sets(docs: DataFrame, whole: bool) -> DataFrame:
    """Of each text with words: doc_id, key (hash of its set of shingles), n (their number), then the set itself as ``hashes``, or fp, buckets,
    least (its n // 5 + 1 least hashes) and bits (its bitmap)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(hashes_of(t, WORDS)) for t in texts_of(batch)]
            rows = [k for k, h in enumerate(sets) if len(h)]
            sets = [sets[k] for k in rows]
            keys = np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in sets], np.uint64).view(np.int64)
            same = [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(keys), pa.array([len(h) for h in sets], pa.int32())]
            if whole:
                yield pa.RecordBatch.from_arrays([*same, _lists([h.view(np.int64) for h in sets])], names=["doc_id", "key", "n", "hashes"])
            else:
                fps = np.array([folded(h) for h in sets], np.uint64).view(np.int64)
                least = _lists([h[: len(h) // 5 + 1].view(np.int64) for h in sets])
                bits = pa.array([bitmap(h).tobytes() for h in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([*same, pa.array(fps), _lists([buckets_of(h) for h in sets]), least, bits], names=["doc_id", "key", "n", "fp", "buckets", "least", "bits"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, key long, n int, " + ("hashes array<long>" if whole else "fp long, buckets array<long>, least array<long>, bits binary"))


def _near(n: np.ndarray, fp: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether sizes and fingerprints allow the similarity."""
    return (5 * np.minimum(n[i], n[j]) >= 4 * np.maximum(n[i], n[j])) & (np.bitwise_count(fp[i] ^ fp[j]) <= WIDE)


def led(key: np.ndarray, n: np.ndarray, fp: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Pairs of a bucket's few leaders and their mates, as rows (leader, mate)."""
    left, out = np.argsort(_mix(key.view(np.uint64) * _TURNS[0]), kind="stable"), [np.zeros((0, 2), np.int64)]
    for _ in range(LEADERS):
        if len(left) < 2:
            break
        lead, rest = left[:1], left[1:]
        ok = _near(n, fp, lead, rest)
        out.append(np.stack([np.repeat(lead, int(ok.sum())), rest[ok]], axis=1))
        left = rest[~ok]
    return np.concatenate(out)


def spanned(key: np.ndarray, n: np.ndarray, fp: np.ndarray, root: np.ndarray) -> np.ndarray:
    """A spanning forest of the candidates of a bucket that aren't in one component, as rows (text, text of its tree)."""
    roots, sizes = np.unique(root, return_counts=True)
    ask = np.flatnonzero(root != roots[sizes.argmax()])  # one of two in different components isn't in the largest
    index, label = GrayIndex(fp), np.arange(len(key))
    for a, b in index.searches(fp[ask], WIDE):
        i, j = ask[a], index.order[b]
        ok = (root[i] != root[j]) & _near(n, fp, i, j)
        join_labels(label, i[ok], j[ok])
    at = np.flatnonzero(label != np.arange(len(label)))
    return np.stack([at, label[at]], axis=1)


def _by_group(n_keys: int, names: list[str], work) -> object:
    """A function of batches sorted by their first n_keys columns: calls ``work`` with the other columns of each group, which may go on in the
    next batch, and yields the pairs (a, b) that it returns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def finish() -> Iterator[pa.RecordBatch]:
            if sum(x.num_rows for x in held) > 1:
                pairs = work(pa.Table.from_batches(held))
                if len(pairs):
                    yield pa.RecordBatch.from_arrays([pa.array(pairs.min(axis=1)), pa.array(pairs.max(axis=1))], names=["a", "b"])

        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(n_keys)], axis=1)
            bounds = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1), True])
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if now is not None and tuple(keys[s]) != now:
                    yield from finish()
                    held = []
                now = tuple(keys[s])
                held.append(batch.slice(s, e - s).select(names))
        if held:
            yield from finish()

    return run


def _in_buckets(rows: DataFrame, f) -> DataFrame:
    """Pairs (a, b) of keys that ``f`` finds in the buckets of rows (h, key, n, fp, root)."""

    def work(got: pa.Table) -> np.ndarray:
        key, n, fp, root = (got.column(k).to_numpy() for k in ("key", "n", "fp", "root"))
        return key[f(key, n, fp.view(np.uint64), root)]

    return rows.repartition("h").sortWithinPartitions("h").mapInArrow(tidy(_by_group(1, ["key", "n", "fp", "root"], work), 50_000), "a long, b long").distinct()


def linked(key: np.ndarray, n: np.ndarray, root: np.ndarray, ask: np.ndarray, be: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """A spanning forest, beyond the components ``root``, of the links between texts that ask and texts that are to be compared (flags ask, be),
    as rows of keys; sets are sorted. The nearest are compared first; texts that have come together aren't compared any more."""
    label, out = root.copy(), []
    to, maps = np.flatnonzero(be), Bitmaps([bitmap(s) for s in sets])
    for q in np.flatnonzero(ask).tolist():
        mates = to[(label[to] != label[q]) & (key[to] != key[q])]
        mates = mates[5 * np.minimum(n[q], n[mates]) >= 4 * np.maximum(n[q], n[mates])]
        apart = maps.apart(np.full(len(mates), q), mates)
        mates, apart = (x[9 * apart <= n[q] + n[mates]] for x in (mates, apart))
        for m in mates[np.argsort(apart, kind="stable")].tolist():
            if label[m] != label[q]:
                shared = int((sets[q][np.minimum(np.searchsorted(sets[q], sets[m]), len(sets[q]) - 1)] == sets[m]).sum())
                if 9 * shared >= 4 * (len(sets[q]) + len(sets[m])):
                    out.append((key[q], key[m]))
                    label[label == label[m]] = label[q]
    return np.array(out, np.int64).reshape(-1, 2)


def _units(rows: DataFrame, groups: DataFrame, group: str, block: int, names: list[str]) -> DataFrame:
    """group, s, t, q, ask, names: rows (group, key, n, root, ...), each in the units in which it is compared; groups (group, key, n, root) are
    counted. A group of up to ``block`` rows is one unit. The rows of a larger one are dealt by size to bands, of which sets at 0.8 lie in one
    or in neighbours, and a cell s holds the bands s and s + 1. Rows outside a cell's largest component ask, all are compared; in a cell of
    one unit ask is 2 for those (they are compared, too), else the cell's asking blocks meet each of its blocks. A cell has BLOCKS blocks of
    either kind at most, so that rows grow with texts."""
    band = F.floor(F.log("n") / math.log(BAND)).cast("int")
    totals = groups.groupBy(group).agg((F.count("*") > block).alias("banded"))
    celled = lambda df: df.join(totals, group).withColumn("s", F.explode(F.when(F.col("banded"), F.array(band - 1, band)).otherwise(F.array(F.lit(0)))))
    own = ~F.col("banded") | (F.col("s") == band)
    sizes = celled(groups).groupBy(group, "s", "root").agg(F.count("*").alias("m"), F.max(own).alias("own")).groupBy(group, "s").agg(F.sum("m").alias("m"), F.max("own").alias("own"), F.max(F.struct("m", "root")).alias("x"))
    blocks = lambda c: F.ceil(c / F.greatest(F.lit(block), F.ceil(F.col("m") / BLOCKS))).cast("int")
    # the pairs of a cell without rows of its own band are those of the next one; one component has none
    sizes = sizes.where("own and m > x.m").select(group, "s", F.col("x.root").alias("largest"), blocks(F.col("m")).alias("to"), blocks(F.col("m") - F.col("x.m")).alias("from"))
    part = lambda c: F.pmod(F.xxhash64("key"), F.col(c)).cast("int")
    all_ = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    unit = lambda t, q, ask: F.struct(t.alias("t"), q.alias("q"), F.lit(ask).alias("ask"))
    asks = F.col("root") != F.col("largest")
    compared = F.transform(all_("from"), lambda q: unit(part("to"), q, 0))
    asking = F.when(asks, F.transform(all_("to"), lambda t: unit(t, part("from"), 1))).otherwise(F.array().cast("array<struct<t:int,q:int,ask:int>>"))
    alone = F.array(unit(F.lit(0), F.lit(0), F.when(asks, 2).otherwise(0)))
    dealt_ = celled(rows).join(sizes, [group, "s"]).withColumn("u", F.explode(F.when(F.col("to") == 1, alone).otherwise(F.concat(compared, asking))))
    return dealt_.select(group, "s", "u.t", "u.q", "u.ask", *names)


def _verified(groups: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) between different components inside groups (group, key, root)."""
    sets = _whole_sets(groups.select("key").distinct(), nodes, docs)
    groups = groups.join(nodes.select("key", "n"), "key")
    units = _units(groups.join(sets.dropDuplicates(["key"]), "key"), groups, "group", BLOCK, ["key", "n", "root", "hashes"])

    def work(got: pa.Table) -> np.ndarray:
        key, n, root, ask = (got.column(k).to_numpy() for k in ("key", "n", "root", "ask"))
        hashes = got.column("hashes").combine_chunks()
        flat, ends = hashes.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.r_[0, np.cumsum(n)]
        return linked(key, n, root, ask > 0, ask != 1, [flat[s:e] for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)])

    names = ["key", "n", "root", "ask", "hashes"]
    links = units.repartition("group", "s", "t", "q").sortWithinPartitions("group", "s", "t", "q").mapInArrow(tidy(_by_group(4, names, work)), "a long, b long").distinct()
    links = cut(gathered(links), "links")
    drop(sets)
    return links


def mates(unit: np.ndarray, ask: np.ndarray, n: np.ndarray, root: np.ndarray, place: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (a, b) of rows that share a unit, differ in root and in ask (true, false, or 2: all are compared) and whose sizes and places allow
    the similarity. Rows are sorted by unit and n; row i is compared with i + 1, then i + 2 and so on."""
    i, step = np.arange(len(n)), 0
    while len(i):
        step += 1
        i = i[i + step < len(n)]
        i = i[(unit[i] == unit[i + step]) & (4 * n[i + step] <= 5 * n[i])]
        a = i[(root[i] != root[i + step]) & ((ask[i] != ask[i + step]) | (ask[i] == 2))]
        b = a + step
        ok = 9 * (place[a] + place[b] + abs((n[a] - place[a]) - (n[b] - place[b]))) <= n[a] + n[b]
        yield a[ok], b[ok]


def crossed(unit: np.ndarray, ask: np.ndarray, key: np.ndarray, n: np.ndarray, root: np.ndarray, place: np.ndarray, maps: Bitmaps) -> np.ndarray:
    """A spanning forest, as rows of keys, of the ``mates`` whose bitmaps allow the similarity."""
    keys, at = np.unique(key, return_inverse=True)
    label = np.arange(len(keys))
    for a, b in mates(unit, ask, n, root, place):
        ok = 9 * maps.apart(a, b) <= n[a] + n[b]
        join_labels(label, at[a[ok]], at[b[ok]])
    at = np.flatnonzero(label != np.arange(len(label)))
    return keys[np.stack([at, label[at]], axis=1)]


def _by_unit(work):
    """A function of batches of rows (h, s, t, q, ask, key, n, root, place, ...) sorted by h, s, t, q and n: calls ``work`` with whole units, as a table
    and the arrays unit, ask, key, n, root and place, and yields what it returns, if anything; the last unit of a batch waits."""

    def called(got: pa.Table) -> Iterator[pa.RecordBatch]:
        if got.num_rows > 1:
            arrays = (got.column(k).to_numpy().astype(np.int64) for k in ("ask", "key", "n", "root", "place"))
            if (out := work(got, np.cumsum(_heads(got)), *arrays)) is not None:
                yield out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = pa.concat_tables([held, now]) if held is not None else now
            last = int(np.flatnonzero(_heads(now))[-1]) if now.num_rows else 0
            yield from called(now.slice(0, last))
            held = now.slice(last).combine_chunks()
        if held is not None:
            yield from called(held)

    return run


def _with_mates(got: pa.Table, unit: np.ndarray, ask: np.ndarray, key: np.ndarray, n: np.ndarray, root: np.ndarray, place: np.ndarray) -> pa.RecordBatch | None:
    """The rows that have a mate."""
    keep = np.zeros(len(n), bool)
    for a, b in mates(unit, ask, n, root, place):
        keep[a] = keep[b] = True
    return got.filter(pa.array(keep)).combine_chunks().to_batches()[0] if keep.any() else None


def _crossing(got: pa.Table, unit: np.ndarray, ask: np.ndarray, key: np.ndarray, n: np.ndarray, root: np.ndarray, place: np.ndarray) -> pa.RecordBatch | None:
    """``crossed`` of rows that have their bitmaps as ``bits``."""
    pairs = crossed(unit, ask, key, n, root, place, Bitmaps([np.frombuffer(x, np.uint64) for x in got.column("bits").to_pylist()]))
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"]) if len(pairs) else None


def _heads(got: pa.Table) -> np.ndarray:
    """Whether a unit (h, s, t, q) begins at each row."""
    x = np.stack([got.column(k).to_numpy().astype(np.int64) for k in ("h", "s", "t", "q")], axis=1)
    return np.r_[True, (x[1:] != x[:-1]).any(axis=1)] if len(x) else np.zeros(0, bool)


def _rest(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """A forest (a, b) of all candidates between different components that share one of their sets' least hashes."""
    names = ["key", "n", "root", "place"]
    sets = cut(gathered(_rooted(nodes.select("key", "n", "least"), roots)), "rest")
    rows = sets.select(F.posexplode("least").alias("place", "h"), "key", "n", "root")
    lists = rows.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("m")).where("lo <> hi").select("h", "m")
    lists = cut(gathered(lists), "lists")
    hot = hot_keys(lists, "h", "m")
    rows = cut(gathered(dealt(rows, "h", hot, "key").join(spread(lists, "h", hot), ["h", "part"]).select("h", "m", *names)), "rest")
    drop(sets)
    units = rows.where(F.col("m") <= LIST).select("h", *(F.lit(0).alias(k) for k in "stq"), F.lit(2).alias("ask"), *names)
    long = rows.where(F.col("m") > LIST).drop("m")
    if not lists.where(F.col("m") > LIST).isEmpty():
        units = units.union(_units(long, long, "h", LIST, names))
    sorted_ = lambda df: df.repartition("h", "s", "t", "q").sortWithinPartitions("h", "s", "t", "q", "n")
    units = cut(gathered(sorted_(units).mapInArrow(tidy(_by_unit(_with_mates), 50_000), units.schema)), "units")
    drop(rows, lists)
    found = sorted_(units.join(nodes.select("key", "bits"), "key")).mapInArrow(tidy(_by_unit(_crossing), 50_000), "a long, b long").distinct()
    found = cut(gathered(found), "forest")
    drop(units)
    return found


def _members(nodes: DataFrame) -> DataFrame:
    """h, key, n, fp: nodes in the buckets that hold several."""
    rows = nodes.select(F.explode("buckets").alias("h"), "key", "n", "fp").distinct()
    sizes = rows.groupBy("h").agg(F.count("*").alias("m")).where("m > 1")
    rows = cut(gathered(rows.join(sizes, "h")), "members")
    if rows.where(F.col("m") > BIG).isEmpty():
        return rows
    big = rows.where(F.col("m") > BIG).select("h", "key").withColumnRenamed("h", "big")
    finer = nodes.join(big, "key").select(F.expr("explode(transform(filter(buckets, b -> b <> big), b -> xxhash64(least(big, b), greatest(big, b))))").alias("h"), "key", "n", "fp").distinct()
    return cut(gathered(rows.where(F.col("m") <= BIG).select("h", "key", "n", "fp").unionByName(finer)), "members")


def _whole_sets(keys: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """key, hashes: the sets of the texts in question, read again, some more than once; from ``cut``."""
    reps = cut(gathered(nodes.join(keys, "key", "left_semi").select(F.col("rep").alias("doc_id")).distinct()), "reps")
    few = F.broadcast(reps) if reps.count() <= SMALL else reps
    return cut(_sets(docs.join(few, "doc_id", "left_semi"), True).select("key", "hashes"), "sets")


def _alike(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs of keys whose sets are similar."""
    sets = _whole_sets(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), nodes, docs)
    left, right = (sets.dropDuplicates(["key"]).select(F.col("key").alias(k), F.col("hashes").alias(f"{k}h")) for k in "ab")
    # shared / (n + m - shared) >= 0.8
    links = pairs.join(left, "a").join(right, "b").where("9 * size(array_intersect(ah, bh)) >= 4 * (size(ah) + size(bh))").select("a", "b")
    links = cut(gathered(links), "links")
    drop(sets)
    return links


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))


def similar(docs: DataFrame) -> DataFrame:
    """doc_id, component_id (smallest doc_id that links reach) of the rows that have an id and words."""
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    marks = cut(_sets(docs, False), "marks")
    ids = cut(gathered(marks.select("doc_id", "key")), "ids")
    nodes = cut(gathered(marks.groupBy("key").agg(F.min(F.struct("doc_id", "n", "fp", "buckets", "least", "bits")).alias("x")).select("key", F.col("x.doc_id").alias("rep"), "x.n", "x.fp", "x.buckets", "x.least", "x.bits")), "nodes")
    drop(marks)
    members = _members(nodes).select("h", "key", "n", "fp")
    pairs = cut(gathered(_in_buckets(members.withColumn("root", F.col("key")), led)), "pairs")
    first = _alike(pairs, nodes, docs)
    roots = cut(gathered(components(first).select(F.col("node").alias("key"), "root")), "roots")
    now = _rooted(members, roots).select("h", "key", "n", "fp", "root")
    open_ = now.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("h")  # others lie in one component
    forest = cut(gathered(_in_buckets(now.join(open_, "h", "left_semi"), spanned)), "forest")
    found = first
    for search in (lambda: forest, lambda: _rest(nodes, roots)):
        if (pairs := search()).isEmpty():
            continue
        groups = cut(gathered(_rooted(components(pairs).select(F.col("node").alias("key"), F.col("root").alias("group")), roots)), "groups")
        more = _verified(groups, nodes, docs)
        if not more.isEmpty():
            found = found.union(more)
            roots = cut(gathered(components(found).select(F.col("node").alias("key"), "root")), "roots")
    joined = _rooted(nodes.select("key", "rep"), roots)
    least = joined.groupBy("root").agg(F.min("rep").alias("component_id"))
    of = joined.join(least, "root").select("key", "component_id")
    return ids.join(of, "key").select("doc_id", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with the row of the smallest doc_id of each group of similar texts; rows without an id or words stay."""
    dropped = similar(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(cut(gathered(dropped), "copies"), "doc_id", "left_anti").select(*docs.columns)
