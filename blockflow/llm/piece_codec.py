"""SentencePiece encoding that keeps offsets, and decoding.

A model file holds a compiled character map: a double-array trie of byte
strings with their replacements.  Normalisation takes the longest key that
starts at each place (a character without a key stays as it is), applies the
model's rules for blanks, and writes down for every byte of the normalised
text the byte of the source character (or key) it came from.  The normalised
text is cut into pieces by the model itself, its own normaliser switched off,
so a piece is a run of normalised bytes; the alignment projects it back to
``[begin, end)`` in the bytes of the original text.  The ids are those of
``sentencepiece`` for the original text, the spans those of its offsets
(tested, with maps and rules that the given model doesn't use too).

A character outside the vocabulary becomes one piece per byte: all but the
last are empty spans at its start, the last spans the character.

Plan: one pass over the rows, no shuffle.  A text of over ``_SLICE``
normalised characters goes through the model in slices that end where no piece
of the vocabulary can cross (before a word mark that follows another
character), so memory follows the slice, and the result is that of the whole.

Defined cases: a null or empty text has no pieces and decodes to the empty
text; repeated rows are encoded alike; an empty table gives no rows; columns
beside ``id_col`` and ``text_col`` are ignored, whatever their names.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_text, sliced, table

MODEL = "piece_bpe_32k.model"
MARK = "▁"                              # the blank as pieces write it
_SLICE = 1 << 20
_NORMAL, _UNKNOWN, _CONTROL, _USER, _BYTE = 1, 2, 3, 4, 6


# --- the model file ----------------------------------------------------------

def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = raw[at]
        at += 1
        value |= (b & 127) << shift
        shift += 7
        if b < 128:
            return value, at


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes, bytes]]:
    """(number, value, its bytes in the file) of each field of a message."""
    at = 0
    while at < len(raw):
        first = at
        tag, at = _varint(raw, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(raw, at)
        else:
            n, at = _varint(raw, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = raw[at:at + n], at + n
        yield tag >> 3, value, raw[first:at]


def _message(number: int, body: bytes) -> bytes:
    n, size = len(body), b""
    while n > 127:
        size, n = size + bytes([n & 127 | 128]), n >> 7
    return bytes([number << 3 | 2]) + size + bytes([n]) + body


class CharacterMap:
    """Longest-prefix replacement by a compiled character map."""

    def __init__(self, blob: bytes = b"", fixed: tuple[str, ...] = ()):
        self.to: dict[str, str] = {}
        if blob:
            size = struct.unpack_from("<I", blob)[0]
            units = np.frombuffer(blob, "<u4", size // 4, 4)
            texts = blob[4 + size:]
            for key, at in self._keys(units):
                self.to[key.decode()] = texts[at:texts.index(b"\0", at)].decode()
        self.fixed = re.compile("|".join(re.escape(s) for s in sorted(fixed, key=len, reverse=True))) if fixed else None
        self.longest = max(map(len, self.to), default=0)
        heads = {k[0] for k in self.to} | {s[0] for s in fixed}
        self.head = re.compile("[" + "".join(map(re.escape, sorted(heads))) + "]") if heads else None

    @staticmethod
    def _keys(units: np.ndarray) -> Iterator[tuple[bytes, int]]:
        """(key, value) of every leaf of the double array."""
        def children(u: int) -> int:
            return (u >> 10) << ((u & 512) >> 6)

        open_ = [(b"", children(int(units[0])))]
        labels = np.arange(1, 256)
        while open_:
            key, base = open_.pop()
            near = base ^ labels
            near = np.where(near < len(units), near, 0)
            for c in labels[(units[near] & np.uint32(0x800000FF)) == labels]:
                u = int(units[base ^ int(c)])
                below = (base ^ int(c)) ^ children(u)
                name = key + bytes([c])
                if u >> 8 & 1:
                    yield name, int(units[below]) & 0x7FFFFFFF
                open_.append((name, below))

    def replacements(self, text: str) -> Iterator[tuple[int, int, str]]:
        """(start, end, replacement) of the places that change or hold a fixed symbol, in order."""
        at = 0
        while self.head and (m := self.head.search(text, at)):
            at = m.start()
            if self.fixed and (f := self.fixed.match(text, at)):
                yield at, f.end(), f[0]
                at = f.end()
                continue
            for n in range(min(self.longest, len(text) - at), 0, -1):
                if (new := self.to.get(text[at:at + n])) is not None:
                    yield at, at + n, new
                    at += n
                    break
            else:
                at += 1


class Codec:
    """Encoder and decoder of one model file."""

    def __init__(self, raw: bytes):
        import sentencepiece
        spec, rest, self.pieces = {}, [], []
        trainer: dict = {}
        for number, value, whole in _fields(raw):
            if number == 1:
                f = {n: v for n, v, _ in _fields(value)}
                self.pieces.append((f.get(1, b""), f.get(3, _NORMAL)))
            if number == 2:
                trainer = {n: v for n, v, _ in _fields(value)}
            if number == 3:
                spec = {n: v for n, v, _ in _fields(value)}
            else:
                rest.append(whole)
        self.prefix, self.squeeze, self.escape = (bool(spec.get(n, 1)) for n in (3, 4, 5))
        self.suffix = bool(trainer.get(24, 0))
        self.map = CharacterMap(spec.get(2, b""), tuple(p.decode() for p, t in self.pieces if t == _USER))
        self.bytes_ = bool(trainer.get(35, 0))
        bare = _message(3, _message(1, b"identity") + bytes([3 << 3, 0, 4 << 3, 0, 5 << 3, 0]))
        self.cutter = sentencepiece.SentencePieceProcessor(model_proto=b"".join(rest) + bare)
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=raw)
        #: normalised bytes of each id, -1 where they depend on the text
        self.width = np.array([1 if t == _BYTE else -1 if t == _UNKNOWN else len(p) for p, t in self.pieces], dtype=np.int64)
        self.byte = np.array([t == _BYTE for _, t in self.pieces])
        crossing = re.compile(f"[^{MARK}]{MARK}")
        self.sliceable = self.escape and self.bytes_ and not any(crossing.search(p.decode("utf-8", "replace")) for p, t in self.pieces)

    # --- normalisation -------------------------------------------------------

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """(normalised bytes, source byte of each, and one more for the end)."""
        if not text:
            return b"", np.zeros(1, dtype=np.int64)
        parts, origins, loose, units = [], [], [], []
        done = byte_at = flat_at = 0

        def take(piece: str, to: str | None) -> None:
            nonlocal byte_at, flat_at
            raw = piece.encode("utf-8", "replace")
            if to is None:                                   # unchanged: every byte stems from its character's first
                if raw:
                    b = np.frombuffer(raw, dtype=np.uint8)
                    own = np.maximum.accumulate(np.where((b & 0xC0) != 0x80, np.arange(len(b)), 0))
                    parts.append(raw)
                    origins.append(own + byte_at)
                    loose.append(b == 32)
            else:
                new = to.encode("utf-8", "replace")
                parts.append(new)
                origins.append(np.full(len(new), byte_at))
                heading = np.zeros(len(new), dtype=bool)
                heading[:len(new) - len(new.lstrip(b" "))] = True
                loose.append(heading)
                units.append((flat_at, len(new)))
            byte_at += len(raw)
            flat_at += len(parts[-1]) if piece else 0

        for a, b, new in self.map.replacements(text):
            take(text[done:a], None)
            take(text[a:b], new)
            done = b
        take(text[done:], None)
        flat = b"".join(parts)
        origin = np.concatenate(origins) if origins else np.zeros(0, dtype=np.int64)
        first, end = 0, byte_at
        out = np.frombuffer(flat, dtype=np.uint8)
        if self.squeeze:
            first = self._heading(text)
            before = np.empty(len(out), dtype=bool)          # does the byte before end a blank (or nothing)?
            before[:1] = True
            before[1:] = out[:-1] == 32
            drop = np.concatenate(loose) & before
            for at, n in units:                              # blanks that lead a replacement go or stay together
                lead = at + n - len(flat[at:at + n].lstrip(b" "))
                drop[at:lead] = before[at] if n else False
            out, origin = out[~drop], origin[~drop]
            if first == byte_at:                             # blanks alone
                return b"", np.zeros(1, dtype=np.int64)
        if self.escape and (out == 32).any():
            origin = np.repeat(origin, np.where(out == 32, 3, 1))
            out = np.frombuffer(out.tobytes().replace(b" ", MARK.encode()), dtype=np.uint8)
        mark = MARK.encode() if self.escape else b" "
        raw = out.tobytes()
        if self.prefix and not self.suffix:
            raw, origin = mark + raw, np.concatenate([np.full(len(mark), first), origin])
        if self.squeeze:
            while raw.endswith(mark):
                raw = raw[:-len(mark)]
                end = int(origin[len(raw)])
            origin = origin[:len(raw)]
        if self.prefix and self.suffix:
            raw, origin = raw + mark, np.concatenate([origin, np.full(len(mark), end)])
        return raw, np.append(origin, end)

    def _heading(self, text: str) -> int:
        """Bytes of the source that are blanks ahead of the text."""
        at = 0
        changes = self.map.replacements(text)
        a, b, new = next(changes, (len(text), len(text), ""))
        while at < len(text):
            if at == a:
                if new != " ":
                    break
                at = b
                a, b, new = next(changes, (len(text), len(text), ""))
            elif text[at] == " ":
                at += 1
            else:
                break
        return len(text[:at].encode("utf-8", "replace"))

    # --- encoding ------------------------------------------------------------

    def _slices(self, text: str, most: int) -> Iterator[str]:
        at = 0
        while self.sliceable and len(text) - at > most:
            cut = text.rfind(MARK, at + 1, at + most)
            while cut > at and text[cut - 1] == MARK:        # a run of marks stays with what follows it
                cut -= 1
            if cut <= at:
                cut = at + most
                while cut < len(text) and (text[cut] != MARK or text[cut - 1] == MARK):
                    cut += 1
            yield text[at:cut]
            at = cut
        if at < len(text):
            yield text[at:]

    def encode(self, text: str | None, most: int = _SLICE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begin, end): the pieces and their spans in the UTF-8 bytes of ``text``."""
        raw, origin = self.normalise(text or "")
        ids = [np.asarray(self.cutter.encode(s), dtype=np.int64) for s in self._slices(raw.decode(), most)] if raw else []
        ids = np.concatenate(ids) if ids else np.zeros(0, dtype=np.int64)
        width = self.width[ids]
        if (width < 0).any():                                # without byte pieces: an unknown piece is as long as its text
            width = np.array([len(p.encode()) for p in self.cutter.encode(raw.decode(), out_type=str)], dtype=np.int64)
        stop = np.cumsum(width)
        begin, end = origin[stop - width], origin[stop] if len(stop) else stop
        if len(ids) and self.byte[ids].any():
            inside = (np.frombuffer(raw + b" ", dtype=np.uint8)[stop] & 0xC0) == 0x80
            end = np.where(inside, begin, end)
        return ids, begin, end

    def decode(self, ids) -> str:
        return self.whole.decode(ids if isinstance(ids, list) else np.asarray(ids).tolist())


@lru_cache(maxsize=4)
def codec(path: str | None = None) -> Codec:
    """The codec of a model file (default: the installed one), kept per process."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path(MODEL)
    with open(path, "rb") as f:
        return Codec(f.read())


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None,
            decode: bool = False) -> DataFrame:
    """One row per document: ``id_col``, ``ids``, ``begins`` and ``ends``
    (arrays of equal length), and with ``decode`` also ``decoded``."""
    d = docs.select(id_col, text_col)
    numbers = [F.array(F.lit(0)).alias(c) for c in ("ids", "begins", "ends")]
    schema = d.select(id_col, *numbers, *([F.lit("").alias("decoded")] if decode else [])).schema

    def lists(rows: list[np.ndarray]) -> pa.ListArray:
        sizes = np.cumsum([0, *map(len, rows)])
        return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(rows), pa.int32()))

    def run(batches):
        c = codec(model)
        for b in sliced(batches, text_col, 2 << 20):
            rows = [c.encode(t) for t in b.column(text_col).to_pylist()]
            columns = [b.column(id_col), *(lists([r[i] for r in rows]) for i in range(3))]
            if decode:
                columns.append(pa.array([c.decode(r[0]) for r in rows], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)
    return map_text(d, run, schema)


def decoded(pieces: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """(``id_col``, text): the text of each row's ids (null: empty)."""
    d = pieces.select(id_col, ids_col)
    schema = d.select(id_col, F.lit("").alias("text")).schema

    def run(batches):
        c = codec(model)
        for b in batches:
            texts = [c.decode(r or []) for r in b.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(texts, pa.string())], names=schema.names)
    return map_text(d, run, schema)


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded with the 32k piece model."""
    out = encoded(table(spark, sf_dir, "documents"), decode=True)
    ids = F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))
