"""Quality rules: a linear-chain conditional random field labels lines as content or boilerplate; Viterbi decoding and the
content lines' share of the characters decide whether a document is kept.

The field is fitted here, by gradient ascent on the exact likelihood (forward-backward), on a bounded sample of labelled documents.
Their labels are of whole documents, so lines get theirs by multiple-instance training: a document of quality 1 has content lines
only, one of quality 0 has one boilerplate line at least. A document of quality 0 starts with those lines as boilerplate whose features
are commoner in documents of quality 0 (log odds over all lines); then the field is fitted, decodes these documents anew, and is fitted
to the result, ROUNDS times. A document without any boilerplate line by then gets its likeliest one. Line features are buckets of figures
that array arithmetic over a batch's bytes yields.

Defined cases: null texts have no words and fail; a line is a \\n-separated part, and only lines with a word are labelled; a
document without one has share 0. With no labelled rows of quality 0 every line is content. Repeated rows are judged one by one. Rows of
labels with a null id or another quality than 0 and 1 don't count, of several for one id the least quality does. Of docs only ``doc_id``
and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts_of, tidy

#: The field is fitted on about so many labelled documents of each class at most, whole ones with so many lines at most.
MAX_TRAIN_PER_CLASS, MAX_TRAIN_LINES = 1000, 1000
ROUNDS, STEPS, RATE, L2 = 2, 60, 0.3, 1e-3
#: Share of characters in content lines that a document needs.
KEEP_SHARE = 0.5
MIN_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER, _LOWER, _DIGIT, _MARK = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91], _LOWER[97:123], _DIGIT[48:58] = True, True, True
_MARK[[ord(c) for c in "!?=_~^{}[]\\/+@"]] = True
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?:;\"')"]] = True
#: Bounds of the buckets of each figure: share of symbols, capitals, digits and other marks; words; bytes a word; a repeated line; how it ends and begins; commas and full stops a word.
BOUNDS = ((0.01, 0.05, 0.1), (0.05, 0.2, 0.5), (0.02, 0.1, 0.3), (0.01, 0.05), (3, 6, 15, 40), (3, 5, 7, 10), (0.5,), (0.5,), (0.5,), (0.05, 0.2, 0.6))
_OFFSETS = np.cumsum([0, *(len(b) + 1 for b in BOUNDS)])
N_FEATURES = int(_OFFSETS[-1])


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that stand in the text twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    key, size = ids, len(seen)  # numbers of windows of growing length, exact: a pair (number, next word) gets a new number
    for k in range(1, window):
        key = key[: len(words) - k] * len(seen) + ids[k:]
        size *= len(seen)
        if size > 1 << 62 // max(len(seen), 1):
            key = np.unique(key, return_inverse=True)[1].reshape(-1)
            size = len(key)
    order = np.sort(key)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    hit = np.flatnonzero(np.isin(key, twice))
    delta = np.zeros(len(words) + 1, np.int64)
    np.add.at(delta, hit, 1)
    np.add.at(delta, hit + window, -1)
    return int((np.cumsum(delta[:-1]) > 0).sum())


def lines_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch: (document of each line with a word, its features as column numbers, its characters in words, document
    figures n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words as columns, nothing lost of any text)."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    figures = np.zeros((len(texts), 5), np.int64)
    repeated: list[bool] = []
    for i, b in enumerate(raw):
        words = b.split()
        figures[i, 0], figures[i, 4] = len(words), repeat_words(words)
        seen: set[bytes] = set()
        for line in b.split(b"\n"):
            again = line in seen
            seen.add(line)
            repeated.append(again)
    buf = np.frombuffer(b"".join(b + b"\n" for b in raw), np.uint8)
    ends = np.flatnonzero(buf == 10)
    starts = np.r_[0, ends[:-1] + 1] if len(ends) else ends
    space = _SPACE[buf]
    point = (buf & 0xC0) != 0x80
    per = lambda mask: np.add.reduceat(mask.astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)
    first = ~space & np.r_[True, space[:-1]]
    words, chars, symbols = per(first), per(point & ~space), per(_SYMBOL[buf])
    upper, lower, digit, mark = per(_UPPER[buf]), per(_LOWER[buf]), per(_DIGIT[buf]), per(_MARK[buf])
    stops = per((buf == 44) | (buf == 46))
    doc = np.repeat(np.arange(len(raw)), [b.count(b"\n") + 1 for b in raw])
    has = words > 0
    again = np.array(repeated, bool) & has
    figures[:, 1] = np.bincount(doc, chars, len(raw))
    figures[:, 2] = np.bincount(doc, symbols, len(raw))
    figures[:, 3] = np.bincount(doc[again], minlength=len(raw))
    # the last byte of a line that isn't blank, and whether its first letter is a capital
    at = np.arange(len(buf))
    last = np.maximum.reduceat(np.where(space, -1, at), starts) if len(starts) else at
    head = np.minimum.reduceat(np.where(space, len(buf), at), starts) if len(starts) else at
    k = np.flatnonzero(has)
    n, w = np.maximum(chars[k], 1), np.maximum(words[k], 1)
    values = (symbols[k] / n, upper[k] / np.maximum(upper[k] + lower[k], 1), digit[k] / n, mark[k] / n, words[k], n / w, again[k], _END[buf[last[k]]], _LOWER[buf[head[k]]], stops[k] / w)
    features = np.stack([np.searchsorted(b, v, "right") + o for b, v, o in zip(BOUNDS, values, _OFFSETS, strict=False)], axis=1).astype(np.int16) if len(k) else np.zeros((0, len(BOUNDS)), np.int16)
    return doc[k], features, chars[k], figures, has


class Field:
    """Weights of a two-label chain: label 1 is content. emit: features x 2; move: 2 x 2."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit, move

    def scores(self, features: np.ndarray) -> np.ndarray:
        return self.emit[features].sum(axis=1)

    def decode(self, doc: np.ndarray, features: np.ndarray) -> np.ndarray:
        """Viterbi's labels of lines, which lie document by document; documents advance together, line by line."""
        if not len(doc):
            return np.zeros(0, np.int8)
        e = self.scores(features)
        start = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        length = np.diff(np.r_[start, len(doc)])
        order = np.argsort(-length, kind="stable")
        start, length = start[order], length[order]
        best, back = e.copy(), np.zeros((len(doc), 2), np.int8)
        active = len(start)
        for t in range(1, int(length[0])):
            active = int(np.searchsorted(-length[:active], -t, "left"))
            at = start[:active] + t
            step = best[at - 1][:, :, None] + self.move[None]
            back[at] = step.argmax(axis=1)
            best[at] += step.max(axis=1)
        out = np.zeros(len(doc), np.int8)
        ends = start + length - 1
        out[ends] = best[ends].argmax(axis=1)
        active = len(start)
        for t in range(1, int(length[0])):
            active = int(np.searchsorted(-length[:active], -t, "left"))
            at = ends[:active] - t + 1
            out[at - 1] = back[at, out[at]]
        return out


class Chains:
    """Documents' lines, longest document first, with the rows that each place in a document takes up."""

    def __init__(self, lines: list[np.ndarray]):
        self.lengths = np.array([len(x) for x in lines])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.features = np.concatenate(lines).astype(np.int64)
        self.ends = self.starts + self.lengths - 1
        self.at = [self.starts[: int((self.lengths > t).sum())] + t for t in range(int(self.lengths[0]))]
        self.doc = np.repeat(np.arange(len(lines)), self.lengths)

    def marginals(self, emit: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probability of each label at each line, of each pair of labels at each line and the one before it) under the weights."""
        e = emit[self.features].sum(axis=1)
        alpha, beta = e.copy(), np.zeros_like(e)
        for i in self.at[1:]:
            before = alpha[i - 1][:, :, None] + move
            alpha[i] += np.logaddexp(before[:, 0], before[:, 1])
        for i in reversed(self.at[1:]):
            after = move + (e[i] + beta[i])[:, None, :]
            beta[i - 1] = np.logaddexp(after[:, :, 0], after[:, :, 1])
        z = np.logaddexp(*alpha[self.ends].T)[self.doc]
        pairs = np.zeros((len(e), 2, 2))
        later = np.ones(len(e), bool)
        later[self.starts] = False
        i = np.flatnonzero(later)
        pairs[i] = np.exp(alpha[i - 1][:, :, None] + move + (e[i] + beta[i])[:, None, :] - z[i, None, None])
        return np.exp(alpha + beta - z[:, None]), pairs

    def fit(self, labels: np.ndarray, weight: np.ndarray) -> Field:
        """Weights for the lines' labels, by ascent on the conditional likelihood; weight: of each line."""
        emit, move = np.zeros((N_FEATURES, 2)), np.zeros((2, 2))
        ge, gm = np.zeros_like(emit), np.zeros_like(move)
        truth = np.eye(2)[labels]
        true_pairs = np.zeros((len(labels), 2, 2))
        later = np.setdiff1d(np.arange(len(labels)), self.starts)
        true_pairs[later] = truth[later - 1][:, :, None] * truth[later][:, None, :]
        flat, each = self.features.reshape(-1), self.features.shape[1]
        for _ in range(STEPS):
            p, pairs = self.marginals(emit, move)
            g = (truth - p) * weight[:, None]
            d_emit = np.stack([np.bincount(flat, np.repeat(g[:, c], each), N_FEATURES) for c in (0, 1)], axis=1) - L2 * emit
            d_move = ((true_pairs - pairs) * weight[:, None, None]).sum(axis=0) - L2 * move
            ge += d_emit**2
            gm += d_move**2
            emit += RATE * d_emit / np.sqrt(ge + 1e-8)
            move += RATE * d_move / np.sqrt(gm + 1e-8)
        return Field(emit, move)


def fit_field(chains: list[tuple[np.ndarray, int]]) -> Field:
    """Weights from (features of a document's lines, quality of the document)."""
    chains = sorted(((f, y) for f, y in chains if len(f)), key=lambda x: -len(x[0]))
    quality = np.array([y for _, y in chains], int)
    if not (quality == 0).any():
        emit = np.zeros((N_FEATURES, 2))
        emit[:, 1] = 1.0
        return Field(emit, np.zeros((2, 2)))
    all_ = Chains([f for f, _ in chains])
    bad = quality[all_.doc] == 0
    count = np.stack([np.bincount(all_.features[bad == c].reshape(-1), minlength=N_FEATURES) + 1.0 for c in (False, True)])
    odds = np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())
    suspect = odds[all_.features].sum(axis=1)
    weight = np.where(quality == 1, 0.5 / max((quality == 1).sum(), 1), 0.5 / (quality == 0).sum())[all_.doc] / all_.lengths[all_.doc]
    labels = (~bad | (suspect <= 0)).astype(int)
    for turn in range(ROUNDS + 1):
        # one boilerplate line at least in each document of quality 0
        none = np.flatnonzero((np.add.reduceat(1 - labels, all_.starts) == 0) & (quality == 0))
        for d in none.tolist():
            s = all_.starts[d]
            labels[s + int(suspect[s : s + all_.lengths[d]].argmax())] = 0
        field = all_.fit(labels, weight)
        if turn < ROUNDS:
            p, _ = all_.marginals(field.emit, field.move)
            suspect = p[:, 0]
            labels = np.where(bad, field.decode(all_.doc, all_.features), 1).astype(int)
    return field


def train(docs: DataFrame, labels: DataFrame) -> Field:
    """A field from a bounded sample of labelled documents, the same share of each class drawn by a hash of doc_id."""
    known = labels.select("doc_id", "quality").where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sizes = dict(known.groupBy("quality").count().collect())
    share = F.when(F.col("quality") == 1, F.lit(min(1.0, MAX_TRAIN_PER_CLASS / sizes.get(1, 1)))).otherwise(F.lit(min(1.0, MAX_TRAIN_PER_CLASS / sizes.get(0, 1))))
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30))
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")  # some 2 * MAX_TRAIN_PER_CLASS rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, features, *_ = lines_of(texts_of(batch))
            bounds = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            whole = [features[s:e].tobytes() for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            fits = pa.array(bounds[1:] - bounds[:-1] <= MAX_TRAIN_LINES)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(whole, pa.binary())], names=["doc_id", "quality", "f"]).filter(fits)

    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    got = rows.mapInArrow(tidy(run), f"doc_id {types['doc_id']}, quality {types['quality']}, f binary").collect()
    got = {r["doc_id"]: (np.frombuffer(r["f"], np.int16).reshape(-1, len(BOUNDS)), int(r["quality"])) for r in sorted(got, key=lambda r: (r["doc_id"], bytes(r["f"])))}
    return fit_field(list(got.values()))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share."""
    field = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, features, chars, figures, _ = lines_of(texts_of(batch))
            content = field.decode(doc, features) == 1
            share = np.bincount(doc[content], chars[content], batch.num_rows) / np.maximum(figures[:, 1], 1)
            failed = (figures[:, 0] < MIN_WORDS) | (100 * figures[:, 4] > REPEAT_PERCENT * figures[:, 0])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(figures[:, k]) for k in range(5)), pa.array(failed), pa.array(~failed & (share >= KEEP_SHARE)), pa.array(share)], names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double")
