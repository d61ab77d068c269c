"""Language identification: multinomial naive Bayes over hashed character n-grams.

The model is a matrix of log-probabilities, languages x buckets; it is broadcast. Its size is bounded by CELLS: with more languages than
2 ** 8 n-grams are hashed to fewer buckets, so any number of labels is learned. Languages have no prior: all are equally likely before
the text is read. A batch of texts becomes one array of code points, n-grams become bucket numbers by array arithmetic, and a
language's score of a text is the sum of its row at the text's buckets.

Defined cases: null texts and texts without a letter get ``und`` and score 0; with no training row every text does. Equal
scores go to the language that sorts first. Repeated rows are predicted one by one. Only ``doc_id``, ``text`` and, in
training, ``lang`` are read, so further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts_of, tidy

#: Buckets are 2 ** BITS, or fewer with very many languages: the matrix has 2 ** CELLS numbers of four bytes, 64 MB, but 2 ** 6 buckets at least.
BITS, CELLS, LEAST_BITS = 16, 24, 6
ORDERS = (1, 2, 3)
SMOOTHING = 0.05
#: The classifier is fitted on about so many labelled rows of each language at most, drawn by a hash of doc_id.
MAX_TRAIN_PER_LANG = 4000
#: Labels up to which their sample shares are broadcast.
FEW_LANGS = 100_000
#: A document is accepted with a posterior from this on.
ACCEPT = 0.5
#: Code points and languages worked on at once; longer texts are taken in pieces.
PIECE, LANGS = 1 << 20, 256
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """Lower-case code point of each letter, a blank for all else."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if (x := chr(c)).isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def _pieces(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(documents, starts, code points, whether n-grams start there) of groups of whole texts or parts of long ones. Each text or part is
    followed by blanks, a part before them by what its last n-grams reach into; no n-gram starts in either."""
    parts: list[tuple[int, str, int]] = []
    for i, t in enumerate(texts):
        for s in range(0, max(len(t), 1), PIECE):
            part = t[s : s + PIECE + 2]
            parts.append((i, part, min(len(part), PIECE)))
    group: list[tuple[int, str, int]] = []
    size = 0
    for k, (i, t, own) in enumerate(parts):
        group.append((i, t, own))
        size += len(t) + 3
        if size >= PIECE or k == len(parts) - 1:
            points = np.frombuffer("".join(x + "   " for _, x, _ in group).encode("utf-32-le", "surrogatepass"), np.uint32)
            lengths, owns = np.array([len(x) + 3 for _, x, _ in group]), np.array([n for *_, n in group])
            counted = np.repeat(np.tile([True, False], len(group)), np.stack([owns, lengths - owns], axis=1).reshape(-1))
            yield np.array([d for d, *_ in group]), np.cumsum(lengths) - lengths, _letters()[points], counted
            group, size = [], 0


def bits_for(langs: int) -> int:
    """Bits of a bucket number with so many languages."""
    return max(LEAST_BITS, min(BITS, CELLS - max(langs - 1, 0).bit_length()))


def _buckets(points: np.ndarray, counted: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the bucket at each position and whether an n-gram with a letter starts there that is ``counted``."""
    letter = points != 32
    h, some = np.zeros(len(points), np.uint32), np.zeros(len(points), bool)
    for n in ORDERS:
        k = n - 1
        h = h.copy()
        h[: len(h) - k] = (h[: len(h) - k] + points[k:]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        some = some.copy()
        some[: len(h) - k] |= letter[k:]
        yield h >> np.uint32(32 - bits), some & counted


def held_out(doc_id: str = "doc_id"):
    """True for rows that training never sees: crc32 of the id's text leaves 1 when divided by 3. A null id counts as not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _count(bits: int):
    """Sums up n-grams of each language and yields them when a task ends or holds many languages."""

    def rows(counts: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, own in counts.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(own[at])], names=["lang", "bucket", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            by: dict[str, list[str]] = {}
            for t, lang in zip(texts_of(batch), batch.column("lang").to_pylist(), strict=True):
                by.setdefault(lang, []).append(t)
            for lang, texts in by.items():
                if lang not in counts and len(counts) >= 64:
                    yield from rows(counts)
                    counts = {}
                own = counts.setdefault(lang, np.zeros(1 << bits, np.int64))
                for _, _, points, counted in _pieces(texts):
                    for h, some in _buckets(points, counted, bits):
                        own += np.bincount(h[some], minlength=1 << bits)
        yield from rows(counts)

    return run


def train(docs: DataFrame, per_lang: int = MAX_TRAIN_PER_LANG) -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities) from rows that aren't held out and have a language.

    The sample is drawn language by language with a threshold on a hash of doc_id, so that a rare language keeps all its rows.
    Counts are summed in Spark; what reaches the driver is at most languages x buckets numbers."""
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    sizes = rows.groupBy("lang").agg(F.count("*").alias("rows"))
    langs = sorted(r[0] for r in sizes.select("lang").collect())
    bits = bits_for(len(langs))
    if not langs:
        return [], np.zeros((0, 1 << bits), np.float32)
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.floor(F.lit(float(1 << 30)) * per_lang / F.col("rows")) + 1
    shares = F.broadcast(sizes) if len(langs) <= FEW_LANGS else sizes
    got = rows.join(shares, "lang").where(drawn).select("text", "lang").mapInArrow(tidy(_count(bits)), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(langs), 1 << bits), np.float32)
    place = {x: i for i, x in enumerate(langs)}
    counts[[place[x] for x in got["lang"].to_pylist()], got["bucket"].to_numpy()] = got["n"].to_numpy()
    counts += np.float32(SMOOTHING)
    return langs, np.log(counts / counts.sum(axis=1, keepdims=True, dtype=np.float64).astype(np.float32))


def score_texts(texts: list[str], langs: list[str], matrix: np.ndarray) -> tuple[list[str], list[float]]:
    """Prediction and its posterior for each text; LANGS languages are scored at once."""
    bits = matrix.shape[1].bit_length() - 1
    seen = np.zeros(len(texts), np.int64)
    best, top, mass = np.zeros(len(texts), np.int64), np.full(len(texts), -np.inf), np.zeros(len(texts))
    for lo in range(0, len(langs), LANGS):
        block = matrix[lo : lo + LANGS]
        total = np.zeros((len(block), len(texts)))
        for docs, starts, points, counted in _pieces(texts):
            if not lo:
                np.add.at(seen, docs, np.add.reduceat((points != 32).astype(np.int64), starts))
            for h, some in _buckets(points, counted, bits):
                for k in range(len(block)):
                    np.add.at(total[k], docs, np.add.reduceat(np.where(some, block[k][h], np.float32(0)).astype(np.float64), starts))
        high = np.maximum(top, total.max(axis=0))
        with np.errstate(under="ignore"):
            mass = mass * np.exp(top - high) + np.exp(total - high).sum(axis=0)  # of all so far, as a multiple of the best's
        best, top = np.where(high > top, lo + total.argmax(axis=0), best), high
    return [langs[b] if n else UNKNOWN for b, n in zip(best, seen, strict=True)], [float(1 / m) if n else 0.0 for m, n in zip(mass, seen, strict=True)]


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], keep: list[str] | None = None) -> DataFrame:
    """The columns in ``keep`` (doc_id unless given) with lang_pred and score, a row for each row of docs."""
    keep = keep or ["doc_id"]
    langs, sent = model[0], docs.sparkSession.sparkContext.broadcast(model[1])
    rows = docs.select(*dict.fromkeys([*keep, "text"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, score = score_texts(texts_of(batch), langs, sent.value)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*keep, "lang_pred", "score"])

    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(tidy(run), ", ".join([*(f"`{c}` {types[c]}" for c in keep), "lang_pred string", "score double"]))


def accepted(docs: DataFrame, model: tuple[list[str], np.ndarray], least: float = ACCEPT) -> DataFrame:
    """docs without the rows that are predicted ``und`` or with a posterior below ``least``; ``lang`` is the prediction, other columns as
    they were."""
    langs, sent = model[0], docs.sparkSession.sparkContext.broadcast(model[1])
    text, lang = docs.columns.index("text"), docs.columns.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, score = score_texts([t or "" for t in batch.column(text).to_pylist()], langs, sent.value)
            cols = list(batch.columns)
            cols[lang] = pa.array(pred, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names).filter(pa.array([p != UNKNOWN and x >= least for p, x in zip(pred, score, strict=True)], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    return predict(docs, train(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
