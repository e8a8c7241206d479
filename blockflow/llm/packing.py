"""Packing along a space-filling curve.

A document's vector: its character 4-grams (of UTF-8 bytes, ASCII lowered)
hashed into ``BUCKETS`` places, log counts, unit length, projected on ``DIMS``
fixed random directions.  The Hilbert key of the projections (``BITS`` bits
each) orders documents so that neighbours on the curve have similar text.
Spark range-sorts documents by (key, id, hash of the text) and each range is packed by
streaming through it: ids are laid end to end and cut every ``length``, so a
sequence holds neighbours of the curve and only the last sequence of a range
is not full.  Ranges are cut by Spark from a sample, keys with many rows are
split by id and text, so copies of one text do not pile up in a task.

Text moves once, as text; it is split into tokens after the shuffle, a few
documents at a time, and no range is ever held whole.  The sequence id is the
range's number times 2**40 plus the sequence's number in it.

Token ids are those of the byte-level BPE file for ``tokenizers``; they are
made with ``tiktoken`` from the same vocabulary, which gives the same ids
(tested) four times as fast, and with ``tokenizers`` itself for a text on
which tiktoken gives up.  The string of the file's added token is that token's
one id inside a text too, as ``tokenizers`` reads it by default.

Defined cases: a null or empty text is one piece with the end id alone; a
document longer than a sequence is cut into several pieces, a shorter one
where a sequence ends; repeated rows are packed one by one; null ids sort
first.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, map_text, sliced, table

BUCKETS, DIMS, BITS, LENGTH, END = 4096, 4, 15, 1024, 0
#: The added tokens of the BPE file, which ``tokenizers`` finds inside text.
SPECIAL = {"<|endoftext|>": 50256}
_SEED = 20240601


@lru_cache(maxsize=4)
def _directions(buckets: int, dims: int) -> np.ndarray:
    return np.random.default_rng(_SEED).standard_normal((buckets, dims))


def vector(text: str | None, buckets: int = BUCKETS, dims: int = DIMS) -> np.ndarray:
    """Projections of a text's hashed 4-gram vector (zeros for under 4 bytes)."""
    raw = (text or "").encode("utf-8", "replace").lower()
    if len(raw) < 4:
        return np.zeros(dims)
    counts = np.zeros(buckets)
    for at in range(0, len(raw) - 3, 1 << 22):
        g = np.ndarray((min(1 << 22, len(raw) - 3 - at),), dtype="<u4", buffer=raw, offset=at, strides=(1,))
        counts += np.bincount((g * np.uint32(2654435761)) >> np.uint32(20), minlength=buckets)[:buckets]
    v = np.log1p(counts)
    return (v / np.linalg.norm(v)) @ _directions(buckets, dims)


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position along the Hilbert curve of integer cells (n, dims), each below
    2**bits: the axes are turned cube by cube into the curve's transposed
    index, whose bits are then interleaved."""
    x = cells.astype(np.int64).copy()
    n, dims = x.shape
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            up = (x[:, i] & q) != 0
            swap = np.where(up, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(up, low, swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    turn, q = np.zeros(n, dtype=np.int64), 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[:, dims - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn[:, None]
    key = np.zeros(n, dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


def cells_of(v: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Projections (near standard normal) as cells: the range -4 to 4, evenly."""
    return np.clip(((v + 4.0) / 8.0 * (1 << bits)).astype(np.int64), 0, (1 << bits) - 1)


@lru_cache(maxsize=2)
def _coders(folder: str | None):
    import tiktoken
    if folder is None:
        import public_tokenizers
        folder = os.path.dirname(public_tokenizers.path("byte_bpe_50k.json"))
    with open(os.path.join(folder, "byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    from public_tokenizers import PATTERN
    return tiktoken.Encoding("byte_bpe_50k", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL), folder


@lru_cache(maxsize=4)
def _slow_coder(folder: str, special: bool):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(os.path.join(folder, "byte_bpe_50k.json"))
    t.encode_special_tokens = not special
    return t


def token_ids(text: str | None, folder: str | None = None, special: bool = False) -> list[int]:
    """Ids of a text, without the end id.  With ``special`` the strings of
    ``SPECIAL`` are one id each, otherwise ordinary text."""
    fast, folder = _coders(folder)
    try:
        return fast.encode(text or "", allowed_special="all") if special else fast.encode_ordinary(text or "")
    except BaseException as e:                    # the regex engine's stack, raised as a panic outside Exception
        if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
            raise
        return _slow_coder(folder, special).encode(text, add_special_tokens=False).ids


def along_curve(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, ``id_col``, ``text_col``) range-sorted by the Hilbert key."""
    d = docs.select(id_col, text_col)
    key = free_name(d, "key")
    schema = d.select(F.lit(0).cast("long").alias(key), id_col, text_col).schema

    def run(batches):
        for b in sliced(batches, text_col):
            v = np.array([vector(t) for t in b.column(text_col).to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(hilbert_key(cells_of(v))), b.column(id_col), b.column(text_col)],
                                             names=schema.names)
    # bounds are sampled to the driver, so the text itself is no part of them
    rows = map_text(d, run, schema).repartitionByRange(key, id_col, F.xxhash64(text_col))
    return rows.sortWithinPartitions(key, id_col, F.xxhash64(text_col), text_col)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end: int = END,
         folder: str | None = None) -> DataFrame:
    """One row per piece: ``id_col``, start, length, doc_tokens, sequence_id,
    offset, ids (binary, little-endian unsigned 32-bit).  ``folder`` holds the
    tokenizer files (default: the installed ones)."""
    if id_col.lower() in ("start", "length", "doc_tokens", "sequence_id", "offset", "ids"):
        raise ValueError(f"the id column's name {id_col!r} is one of the result's: rename it")
    rows = along_curve(docs, id_col, text_col)
    schema = docs.select(id_col, *[F.lit(0).cast("long").alias(c) for c in ("start", "length", "doc_tokens", "sequence_id", "offset")],
                         F.lit(b"").alias("ids")).schema

    def run(batches):
        base, at = TaskContext.get().partitionId() << 40, 0            # at: ids laid so far in this range
        for b in sliced(batches, text_col, 4 << 20):
            owner, cols, ids = [], ([], [], [], [], []), []
            for i, text in enumerate(b.column(text_col).to_pylist()):
                t = np.array([*token_ids(text, folder, special=True), end], dtype="<u4")
                s = 0
                while s < len(t):
                    n = min(length - at % length, len(t) - s)
                    owner.append(i)
                    for c, v in zip(cols, (s, n, len(t), base + at // length, at % length)):
                        c.append(v)
                    ids.append(t[s:s + n].tobytes())
                    s, at = s + n, at + n
            yield pa.RecordBatch.from_arrays([b.column(id_col).take(pa.array(owner, pa.int64())), *[pa.array(c, pa.int64()) for c in cols],
                                              pa.array(ids, pa.binary())], names=schema.names)
    return map_text(rows, run, schema)


def digest(pieces: DataFrame) -> DataFrame:
    """Pieces with the checksum of their ids in place of the ids."""
    return pieces.select(*[c for c in pieces.columns if c != "ids"], F.crc32("ids").alias("ids_crc32"))


def op9_hilbert_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 ids along the curve."""
    return digest(pack(table(spark, sf_dir, "documents")))
