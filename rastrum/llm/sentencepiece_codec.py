"""SentencePiece encoding and decoding on the tokenizers library.

The model file is parsed here (protobuf wire format), and from it the normaliser, the metaspace marker, the scored pieces and
byte fallback are rebuilt as a tokenizers ``Tokenizer``: a Unigram model from the piece scores, or, where the file holds a BPE
model, a BPE model whose merges are ranked by those scores. No tokenizer is trained.

Texts are normalised and go to the library as multithreaded batches. Where no piece has a marker after another character, which is
checked on the vocabulary, no piece can cross the place before a run of markers, so the library may cut texts there and keep the ids of
frequent words. Parity is checked on whole raw texts: the sentencepiece library encodes each of them too, with its own normaliser, and
all ids must be the same.

Defined cases: null and empty texts have no ids and decode to the empty text; texts with a literal marker character decode
with a blank in its place, as in sentencepiece, so their round trip is false, as is that of texts that the model's normaliser changes;
repeated rows are encoded one by one. Where segmentations of a unigram model have equal scores, the libraries may choose different ones:
parity is then false.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterator
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import tidy

MARK = "▁"
DEFAULT_MODEL = os.environ.get("RASTRUM_SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
#: Threads of the library in one Python worker.
THREADS = 2
#: Bytes of text that are encoded together.
SLICE = 1 << 18
#: Fixed values of the file format: piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of each field of a protobuf message; fixed-width values come as bytes."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[at]
            value, at, shift = value | (b & 0x7F) << shift, at + 1, shift + 7
            if b < 0x80:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        else:
            n, at = (8, at) if kind == 1 else (4, at) if kind == 5 else varint(at)
            value, at = data[at : at + n], at + n
        yield key >> 3, value


def parse_model(data: bytes) -> dict:
    """Pieces as (text, score, type) and what the trainer's and normaliser's specifications say."""
    out = {"pieces": [], "model_type": UNIGRAM, "byte_fallback": False, "charsmap": b"", "dummy_prefix": True, "squeeze": True, "escape": True, "suffix": False}
    for number, value in fields(data):
        if number == 1:
            piece = dict(fields(value))
            out["pieces"].append((piece.get(1, b"").decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)))
        elif number == 2:
            spec = dict(fields(value))
            out |= {"model_type": spec.get(3, UNIGRAM), "byte_fallback": bool(spec.get(35, 0)), "suffix": bool(spec.get(24, 0))}
        elif number == 3:
            spec = dict(fields(value))
            out |= {"charsmap": spec.get(2, b""), "dummy_prefix": bool(spec.get(3, 1)), "squeeze": bool(spec.get(4, 1)), "escape": bool(spec.get(5, 1))}
    return out


class CharacterMap:
    """The normaliser's table: a double-array trie of byte strings, then what they become, each ended by a zero. The longest string that
    begins at a place is replaced; a character with which none begins stays. The tokenizers library reads the same table grapheme by
    grapheme, which gives other results for some pairs of characters."""

    def __init__(self, data: bytes):
        size = int.from_bytes(data[:4], "little") if data else 0
        self.units = np.frombuffer(data[4 : 4 + size], "<u4").tolist()
        self.strings = data[4 + size :]
        self.inert: set[str] = set()  # characters with which no string begins

    def longest(self, raw: bytes) -> tuple[int, int]:
        """(length, place of the replacement) of the longest string that raw begins with; length 0 if there is none."""
        found, at = (0, 0), self._offset(self.units[0])
        for i, b in enumerate(raw):
            at ^= b
            unit = self.units[at] if at < len(self.units) else 0
            if unit & 0x800000FF != b:
                break
            at ^= self._offset(unit)
            if unit >> 8 & 1:
                found = (i + 1, self.units[at] & 0x7FFFFFFF)
        return found

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 0x200) >> 6)

    def apply(self, text: str) -> str:
        if not self.units:
            return text
        out, at = [], 0
        while at < len(text):
            c = text[at]
            if c in self.inert:
                out.append(c)
                at += 1
                continue
            raw = text[at : at + 32].encode("utf-8", "surrogatepass")
            n, where = self.longest(raw)
            if n:
                out.append(self.strings[where : self.strings.index(b"\0", where)].decode())
                at += len(raw[:n].decode("utf-8", "surrogatepass"))
            else:
                if not self._begins(c):
                    self.inert.add(c)
                out.append(c)
                at += 1
        return "".join(out)

    def _begins(self, c: str) -> bool:
        """Whether the trie goes on after c's bytes, so that longer strings may begin with it."""
        at = self._offset(self.units[0])
        for b in c.encode("utf-8", "surrogatepass"):
            at ^= b
            unit = self.units[at] if at < len(self.units) else 0
            if unit & 0x800000FF != b:
                return False
            at ^= self._offset(unit)
        return True


class Codec:
    """Encoder and decoder of one model file."""

    def __init__(self, data: bytes, threads: int = THREADS):
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        import sentencepiece
        from tokenizers import Regex, Tokenizer, decoders, models
        from tokenizers.pre_tokenizers import Split

        m = parse_model(data)
        if m["suffix"] or not m["escape"]:
            raise ValueError("only models with markers before words are rebuilt")
        self.pieces = m["pieces"]
        ids = {p: i for i, (p, _, _) in enumerate(self.pieces)}
        unk = next(i for i, (_, _, t) in enumerate(self.pieces) if t == UNKNOWN)
        if m["model_type"] == UNIGRAM:
            model = models.Unigram([(p, s) for p, s, _ in self.pieces], unk_id=unk, byte_fallback=m["byte_fallback"])
        elif m["model_type"] == BPE:
            usable = {p: s for p, s, t in self.pieces if t in (NORMAL, USER_DEFINED)}
            merges = [(-s, ids[p[:k]], ids[p[k:]], p[:k], p[k:]) for p, s in usable.items() for k in range(1, len(p)) if p[:k] in usable and p[k:] in usable]
            model = models.BPE(ids, [(a, b) for _, _, _, a, b in sorted(merges)], unk_token=self.pieces[unk][0], fuse_unk=True, byte_fallback=m["byte_fallback"])
        else:
            raise ValueError("only unigram and BPE models are rebuilt")
        self.map, self.squeeze = CharacterMap(m["charsmap"]), m["squeeze"]
        self.plain = not m["charsmap"] and not m["squeeze"]
        self.prefix = MARK if m["dummy_prefix"] else ""
        # words after single markers, which need no pattern, and after runs of them
        self.single, self.tokenizer = Tokenizer(model), Tokenizer(model)
        if all(MARK not in p.lstrip(MARK) for p, _, t in self.pieces if t in (NORMAL, USER_DEFINED)):
            self.single.pre_tokenizer = Split(MARK, "merged_with_next")
            self.tokenizer.pre_tokenizer = Split(Regex(f"{MARK}+"), "merged_with_next")
        self.tokenizer.decoder = decoders.Sequence([decoders.Replace(self.pieces[unk][0], " \u2047 "), decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.bytes = [bytes([int(p[3:5], 16)]) if t == BYTE else b" \xe2\x81\x87 " if t == UNKNOWN else b"" if t == CONTROL else p.replace(MARK, " ").encode() for p, _, t in self.pieces]
        self.is_byte = np.array([t == BYTE for _, _, t in self.pieces])

    def normalize(self, text: str) -> str:
        """The text by the model's table, and with runs of blanks made one and outer ones taken off if the model asks for it."""
        text = self.map.apply(text)
        return re.sub(" +", " ", text).strip(" ") if self.squeeze else text  # blanks only, no other white space

    def marked(self, text: str) -> str:
        """The normalised text with markers for blanks and, if the model asks for it, one before it."""
        if not self.plain:
            text = self.normalize(text)
        return self.prefix + text.replace(" ", MARK) if text else ""

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text."""
        marked = [self.marked(t) for t in texts]
        runs = [MARK + MARK in t for t in marked]
        out: list[list[int]] = [[]] * len(texts)
        for tokenizer, kind in ((self.single, False), (self.tokenizer, True)):
            at = [k for k, r in enumerate(runs) if r == kind]
            for k, x in zip(at, tokenizer.encode_batch_fast([marked[k] for k in at], add_special_tokens=False), strict=True):
                out[k] = x.ids
        return out

    def parity(self, texts: list[str], ids: list[list[int]]) -> list[bool]:
        """Whether the sentencepiece library gives the same ids for each whole raw text."""
        return [x == want for x, want in zip(ids, self.reference.encode(texts, num_threads=1), strict=True)]

    def _unmarked(self, text: str) -> str:
        return text[1:] if self.prefix and text[:1] == " " else text

    def decode(self, ids: list[int]) -> str:
        """Text of ids by the library: bytes of byte pieces, blanks for markers, the prefix blank taken off."""
        return self._unmarked(self.tokenizer.decode(ids, skip_special_tokens=False))

    def decode_all(self, ids: list[list[int]]) -> list[str]:
        """The same by a table of the pieces' bytes."""
        piece = self.bytes.__getitem__
        return [self._unmarked(b"".join(map(piece, x)).decode("utf-8", "replace")) for x in ids]


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of some SLICE bytes of text, whole rows each."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // SLICE
    bounds = np.flatnonzero(np.r_[True, sizes[1:] != sizes[:-1], True])
    for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        yield batch.slice(s, e - s)


@cache
def _codec(data: bytes) -> Codec:
    return Codec(data)


def transcode(docs: DataFrame, model: str = DEFAULT_MODEL, keep: list[str] | None = None, outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded", "round_trip", "parity")) -> DataFrame:
    """The columns in ``keep`` (doc_id unless given) and of each whole text the outputs: n_chars, n_tokens, n_byte_fallback, ids,
    decoded, round_trip, parity, ids_sha256 (of little-endian 32-bit ids), decoded_sha256. The model file is read by the driver and
    broadcast; it is refused above 64 MB."""
    with open(model, "rb") as f:
        data = f.read(64 << 20)
        if f.read(1):
            raise ValueError("the model file is too large to broadcast")
    sent = docs.sparkSession.sparkContext.broadcast(data)
    keep = keep or ["doc_id"]
    rows = docs.select(*dict.fromkeys([*keep, "text"]))
    kinds = {"n_chars": ("long", pa.int64()), "n_tokens": ("long", pa.int64()), "n_byte_fallback": ("long", pa.int64()), "ids": ("array<int>", pa.list_(pa.int32())), "decoded": ("string", pa.string()), "round_trip": ("boolean", pa.bool_()), "parity": ("boolean", pa.bool_()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent.value)
        for batch in batches:
            yield from map(one, slices(batch), repeat(codec))

    def one(batch: pa.RecordBatch, codec: Codec) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        found = codec.encode(texts)
        ids, decoded = [np.array(x, np.int32) for x in found], codec.decode_all(found)
        got = {"n_chars": lambda: map(len, texts), "n_tokens": lambda: map(len, ids), "n_byte_fallback": lambda: (int(codec.is_byte[x].sum()) for x in ids), "decoded": lambda: decoded, "round_trip": lambda: (a == b for a, b in zip(texts, decoded, strict=True)), "parity": lambda: codec.parity(texts, found), "ids_sha256": lambda: (hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in ids), "decoded_sha256": lambda: (hashlib.sha256(x.encode()).hexdigest() for x in decoded)}
        arrays = []
        for c in outputs:
            if c == "ids":
                offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)]))))
            else:
                arrays.append(pa.array(list(got[c]()), kinds[c][1]))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *arrays], names=[*keep, *outputs])

    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(tidy(run), ", ".join([*(f"`{c}` {types[c]}" for c in keep), *(f"{c} {kinds[c][0]}" for c in outputs)]))
