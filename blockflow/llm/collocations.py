"""Phrase collocation mining over sorted occurrence relations (SETM).

Texts, ASCII lowered, fall into pieces at punctuation and line ends, pieces
into words.  The occurrence relation of length k holds a row per place where a
frequent phrase of k words stands, sorted by piece and position.  A round
merge-joins it with itself one position on (a phrase of k + 1 words is two of
length k that overlap in all but the ends), counts the groups, keeps those
with ``least`` occurrences or more, and semi-joins the joined places with the
frequent groups: the next relation, written in the same order.

Plan.  A stored row of a relation is a block of places, all of one language
and of whole pieces (about ``BLOCK`` bytes of text), with the distinct phrases
as 128-bit keys, a code per place and its step from the place before.  Its
columns are packed bytes, and its file has a page a row and a group every few:
Spark holds a row or two of it at a time, whatever the number of blocks a task
reads or writes.  Blocks never share a piece, so the merge join moves no data.
Group counts are added
up inside a block, then by Spark on the pair of keys that overlap: a common
phrase is one row per block.  Frequent groups stay a distributed table; tasks
get a bitmap of ``BITS`` bits of their keys (16 MB at any size), through which
all frequent phrases pass.  The few others that do can't become frequent, since
counts are exact and a phrase is never more frequent than its parts.

The tables of frequent phrases carry f of all their first and last words, so
scoring, and finding the phrases that always stand inside a longer one, joins
only these tables.  A phrase that stands in a longer candidate as often as
itself does so in one that is a single word longer, since counts can only fall
as words are added.  Products are decimals of 38 digits.

Ranks are numbers of a range-sorted table less the first of the language, so
no language is one task's.  Keys of two phrases collide with probability
2**-128.

Defined cases: a null text has no words; a null language is ``und``; repeated
rows count each; a language without candidates has no row; an empty table
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH_ROWS, sliced, table, written
from .sharding import row_numbers

LEAST, LONGEST, TOP = 100, 5, 2000
BLOCK, BITS, GROUPS = 4 << 20, 27, 1 << 19
_FEW, _MANY = 256, 10_000                            # rows of an Arrow batch: stored blocks and packed counts, small rows
_BATCH_BYTES = "4m"                                  # of an Arrow batch, unless a single row is larger
# Parquet counts on a hundred rows before it looks at their size; a stored block is a row of megabytes
_LARGE_ROWS = {"parquet.page.row.count.limit": 1, "parquet.block.row.count.limit": 2, "parquet.enable.dictionary": "false",
               "parquet.column.statistics.enabled": "false", "compression": "zstd"}
_BUCKET = 15                                         # bits of a bitmap bucket's size, as Spark builds them
_RANGE = 17                                          # of a range of key buckets that is counted in one place
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[0x20, 0x09]] = 1                              # between words
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2                # between pieces


# --- blocks of places --------------------------------------------------------

def words_of(raw: bytes) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(code, step, distinct words) of the words in ``raw``: ``step`` is 1 where
    the word follows the one before in the same piece, else 2."""
    raw = raw.lower()                                # bytes: A-Z alone
    kind = _KIND[np.frombuffer(raw, dtype=np.uint8)]
    edge = np.diff(np.concatenate([[False], kind == 0, [False]]).astype(np.int8))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    letters = np.frombuffer(raw, dtype=np.uint8)[kind == 0]
    offsets = np.zeros(len(start) + 1, dtype=np.int32)
    np.cumsum(stop - start, out=offsets[1:])
    words = pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    words = words.dictionary_encode()
    piece = np.cumsum(kind == 2, dtype=np.int32)[start] if len(start) else np.zeros(0, dtype=np.int32)
    step = np.full(len(start), 2, dtype=np.int8)
    step[1:][piece[1:] == piece[:-1]] = 1
    return np.asarray(words.indices, dtype=np.int64), step, words.dictionary


def text_blocks(batches: Iterator[pa.RecordBatch], text_col: str, lang_col: str, most: int = BLOCK) -> Iterator[tuple[str, bytes]]:
    """(language, texts of whole documents, lines apart), about ``most`` bytes each; twice that is held at once."""
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    for b in sliced(batches, text_col):
        for lang, text in zip(b.column(lang_col).to_pylist(), b.column(text_col).to_pylist()):
            if text:
                raw = text.encode("utf-8", "replace")
                held.setdefault(lang, []).append(raw)
                size[lang] = size.get(lang, 0) + len(raw)
        while sum(size.values()) > most:
            lang = max(size, key=size.get)
            size.pop(lang)
            yield lang, b"\n".join(held.pop(lang))
    for lang, raws in held.items():
        yield lang, b"\n".join(raws)


def word_keys(lang: str, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    seed = f"{len(lang)}:{lang}".encode("utf-8", "replace")
    raw = b"".join(xxhash.xxh3_128_digest(seed + w.encode("utf-8", "replace")) for w in words)
    keys = np.frombuffer(raw, dtype="<u8").reshape(-1, 2)
    return keys[:, 0], keys[:, 1]


def _mixed(a: np.ndarray, b: np.ndarray, odd: int) -> np.ndarray:
    x = a * np.uint64(odd) + b
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


def joined_keys(p1, p2, s1, s2) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the phrases whose first words have key (p1, p2), whose last have (s1, s2)."""
    return _mixed(p1, s1, 0x9E3779B97F4A7C15), _mixed(p2, s2, 0xC2B2AE3D27D4EB4F)


def merge_join(code: np.ndarray, step: np.ndarray, distinct: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, group, first code, last code): the places whose next place is the
    next position, and the distinct pairs that stand there."""
    at = np.flatnonzero(step[1:] == 1)
    pair, group = np.unique(code[at] * distinct + code[at + 1], return_inverse=True)
    return at, group, pair // max(distinct, 1), pair % max(distinct, 1)


def _kept(code: np.ndarray, step: np.ndarray, at: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, step, kept groups) of the places ``at`` whose group is kept."""
    position = np.cumsum(step, dtype=np.int64)[at]
    stay = keep[code]
    position = position[stay]
    out = np.full(len(position), 2, dtype=np.int8)
    out[1:][np.diff(position) == 1] = 1
    fresh = np.cumsum(keep) - 1
    return fresh[code[stay]], out, np.flatnonzero(keep)


def _planes(values: np.ndarray, kind: str) -> bytes:
    """Numbers as their lowest bytes, then the next, and so on: the high ones pack well."""
    return values.astype(kind).view(np.uint8).reshape(len(values), np.dtype(kind).itemsize).T.tobytes()


def _from_planes(raw, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(width, -1).T).view(kind).ravel()


def _relation(lang: str, h1, h2, code, step) -> pa.RecordBatch:
    """A stored row: the steps are a bit each, set where a place follows the one before."""
    columns = [h1.astype("<u8").tobytes(), h2.astype("<u8").tobytes(), _planes(code, "<u4"), np.packbits(step == 1).tobytes()]
    return pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), *(pa.array([c], pa.binary()) for c in columns)],
                                      names=["lang", "h1", "h2", "code", "step"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Stored rows of a relation, one by one: (lang, h1, h2, code, step)."""
    for b in batches:
        for i in range(b.num_rows):
            lang = b.column(0)[i].as_py()
            h1, h2, code, step = (b.column(c)[i].as_buffer() for c in range(1, 5))
            code = _from_planes(code, "<u4").astype(np.int64)
            step = 2 - np.unpackbits(np.frombuffer(step, dtype=np.uint8), count=len(code)).astype(np.int8)
            yield lang, np.frombuffer(h1, dtype="<u8"), np.frombuffer(h2, dtype="<u8"), code, step


RELATION = "lang string, h1 binary, h2 binary, code binary, step binary"


class KeyFilter:
    """A bitmap of keys as tasks read it: says of keys whether they may be among those it was built from."""

    def __init__(self, rows: list, bits: int, size: int):
        """``rows``: (number, bitmap) of the stretches of 2 ** ``size`` bits that have any."""
        self.bits, bytes_ = bits, 1 << (size - 3)
        self.map = np.zeros(max(1 << bits, 1 << size) // 8, dtype=np.uint8)
        for at, bitmap in rows:
            self.map[at * bytes_:(at + 1) * bytes_] = np.frombuffer(bitmap, dtype=np.uint8)

    def __call__(self, h1: np.ndarray) -> np.ndarray:
        spot = (h1 >> np.uint64(64 - self.bits)).astype(np.int64)
        return (self.map[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 == 1

    @classmethod
    def of(cls, groups: DataFrame, bits: int = BITS) -> KeyFilter:
        """Of the keys ``h1`` of a table."""
        spot = F.shiftrightunsigned("h1", 64 - bits)
        rows = groups.select(F.shiftright(spot, _BUCKET).alias("bucket"), spot.bitwiseAND(F.lit((1 << _BUCKET) - 1)).alias("bit"))
        rows = rows.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap")).collect()       # 2**(bits - 15) rows of 4 KB at most
        return cls([(r["bucket"], r["bitmap"]) for r in rows], bits, _BUCKET)


# --- rounds ------------------------------------------------------------------

def frequent_words(pieces: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(frequent words, words in all by language); ``pieces`` has (lang, text)."""
    def count(batches):
        for lang, raw in text_blocks(batches, "text", "lang"):
            code, _, words = words_of(raw)
            n = np.append(np.bincount(code, minlength=len(words)), len(code))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.concat_arrays([words, pa.nulls(1, pa.string())]),
                                              pa.array(n, pa.int64())], names=["lang", "word", "n"])

    def keyed(batches):
        for b in batches:
            langs, words = b.column(0).to_pylist(), b.column(1).to_pylist()
            h = [word_keys(g, [w]) if w is not None else (np.zeros(1, np.uint64),) * 2 for g, w in zip(langs, words)]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(np.concatenate([x[i] for x in h]).view(np.int64)) for i in (0, 1))],
                                             names=["lang", "word", "n", "h1", "h2"])

    counts = pieces.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = counts.where(F.col("word").isNull() | (F.col("n") >= least))
    counts = stored(counts, "word-counts", BATCH_ROWS)
    counts = stored(counts.mapInArrow(keyed, "lang string, word string, n long, h1 long, h2 long"), "words", _MANY)
    n, one = F.col("n"), F.col("word")
    words = counts.where(one.isNotNull()).select("h1", "h2", "lang", one.alias("phrase"), one.alias("last"), F.array(n).alias("pre"), F.array(n).alias("suf"))
    return words, counts.where(one.isNull()).select("lang", n.alias("total"))


def word_places(pieces: DataFrame, frequent: KeyFilter) -> DataFrame:
    """The occurrence relation of length 1: the places of frequent words."""
    shared = pieces.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        for lang, raw in text_blocks(batches, "text", "lang"):
            code, step, words = words_of(raw)
            h1, h2 = word_keys(lang, words.to_pylist())
            code, step, kept = _kept(code, step, np.arange(len(code)), shared.value(h1))
            if len(code):
                yield _relation(lang, h1[kept], h2[kept], code, step)
    return pieces.mapInArrow(run, RELATION)


def _packed(places: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted places (below 2**32) as steps, and counts (below 2**16), byte by byte planes, compressed."""
    return zlib.compress(_planes(np.diff(places, prepend=0), "<u4") + _planes(counts, "<u2"), 1)


def _unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(raw)
    n = len(raw) // 6
    return np.cumsum(_from_planes(raw[:4 * n], "<u4"), dtype=np.int64), _from_planes(raw[4 * n:], "<u2")


def hot_buckets(places: DataFrame, least: int, bits: int = BITS) -> tuple[KeyFilter, int]:
    """(the key buckets with ``least`` joined places or more, how often a block has one of them)."""
    width = min(_RANGE, bits)
    most = min(least, 0xFFFF)                            # a bucket is hot from there on, so counts may stop at it

    def count(batches):
        for _, h1, h2, code, step in _blocks(batches):
            _, group, first, last = merge_join(code, step, len(h1))
            if not len(first):
                continue
            key, _ = joined_keys(h1[first], h2[first], h1[last], h2[last])
            bucket, mine = np.unique((key >> np.uint64(64 - bits)).astype(np.int64), return_inverse=True)
            n = np.minimum(np.bincount(mine, weights=np.bincount(group, minlength=len(first)), minlength=len(bucket)), most).astype(np.int64)
            cut = np.flatnonzero(np.diff(bucket >> width, prepend=-1))
            ends = np.append(cut[1:], len(bucket))
            yield pa.RecordBatch.from_arrays(
                [pa.array((bucket[cut] >> width).astype(np.int32)),
                 pa.array([_packed(bucket[a:z] & ((1 << width) - 1), n[a:z]) for a, z in zip(cut, ends)], pa.binary())], names=["part", "counts"])

    def total(batches):
        part, sums, blocks = None, None, None

        def hot():
            bitmap = np.packbits(sums >= most, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([bitmap], pa.binary()),
                                               pa.array([int(blocks[sums >= most].sum())], pa.int64())], names=["part", "bitmap", "n"])
        for b in batches:
            for p, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if p != part:
                    if part is not None:
                        yield hot()
                    part, sums, blocks = p, np.zeros(1 << width, dtype=np.int64), np.zeros(1 << width, dtype=np.int64)
                at, n = _unpacked(raw)
                sums[at] += n
                blocks[at] += 1
        if part is not None:
            yield hot()

    counts = stored(places.mapInArrow(count, "part int, counts binary").repartition("part").sortWithinPartitions("part").mapInArrow(
        total, "part int, bitmap binary, n long"), "buckets", _FEW).collect()                          # 2**bits bits in all
    return KeyFilter([(r["part"], r["bitmap"]) for r in counts], bits, width), sum(r["n"] for r in counts)


def frequent_phrases(places: DataFrame, shorter: DataFrame, least: int, bits: int = BITS) -> DataFrame:
    """Phrases one word longer than those of ``places`` (their table is
    ``shorter``) with ``least`` occurrences: keys of themselves, their first
    words (p1, p2) and last words (s1, s2), and f of all first and last words."""
    hot, many = hot_buckets(places, least, bits)
    shared = places.sparkSession.sparkContext.broadcast(hot)
    cut = max(6, min(30, (many // GROUPS).bit_length()))            # bits of the key that name a range

    def count(batches):
        for _, h1, h2, code, step in _blocks(batches):
            _, group, first, last = merge_join(code, step, len(h1))
            n = np.bincount(group, minlength=len(first))
            keys = np.stack([h1[first], h2[first], h1[last], h2[last]], axis=1)
            key, _ = joined_keys(*keys.T)
            may = np.flatnonzero(shared.value(key))
            if not len(may):
                continue
            part = (key[may] >> np.uint64(64 - cut)).astype(np.int32)
            may, part = may[order := np.argsort(part, kind="stable")], part[order]
            starts = np.flatnonzero(np.diff(part, prepend=-1))
            flat = np.concatenate([keys[may], n[may, None].astype(np.uint64)], axis=1)
            offsets = (np.append(starts, len(may)) * flat.itemsize * flat.shape[1]).astype(np.int32)
            lists = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([pa.array(part[starts]), lists], names=["part", "counts"])

    def total(batches):
        part, held, size = None, [], 0

        def summed() -> np.ndarray:
            rows = np.concatenate(held)
            held.clear()
            rows = rows[np.lexsort(rows[:, :4].T)]
            starts = np.flatnonzero(np.r_[True, (rows[1:, :4] != rows[:-1, :4]).any(axis=1)])
            out = rows[starts]
            out[:, 4] = np.add.reduceat(rows[:, 4], starts)
            return out

        def frequent():
            rows = summed()
            rows = rows[rows[:, 4] >= least]
            columns = [*rows.T, *joined_keys(*rows.T[:4])]
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c).view(np.int64)) for c in columns], names=["p1", "p2", "s1", "s2", "n", "h1", "h2"])
        for b in batches:
            for p, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if p != part:
                    if held:
                        yield frequent()
                    part, held, size = p, [], 0
                held.append(np.frombuffer(raw, dtype=np.uint64).reshape(-1, 5))
                size += len(held[-1])
                if size > 2 * GROUPS:
                    held = [summed()]
                    size = len(held[0])
        if held:
            yield frequent()

    lists = places.mapInArrow(count, "part int, counts binary").repartition("part").sortWithinPartitions("part")
    found = lists.mapInArrow(total, "p1 long, p2 long, s1 long, s2 long, n long, h1 long, h2 long")
    found = stored(found, "groups", _FEW)
    first = shorter.select(F.col("h1").alias("p1"), F.col("h2").alias("p2"), "lang", F.col("phrase").alias("head"), "pre")
    rest = shorter.select(F.col("h1").alias("s1"), F.col("h2").alias("s2"), "last", "suf")
    n = F.array("n")
    return found.join(first, ["p1", "p2"]).join(rest, ["s1", "s2"]).select(
        "h1", "h2", "lang", F.concat_ws(" ", "head", "last").alias("phrase"), "last", F.concat("pre", n).alias("pre"), F.concat("suf", n).alias("suf"),
        "p1", "p2", "s1", "s2")


def longer_places(places: DataFrame, frequent: KeyFilter) -> DataFrame:
    """The occurrence relation one word longer: places joined with the next, of frequent groups."""
    shared = places.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        for lang, h1, h2, code, step in _blocks(batches):
            at, group, first, last = merge_join(code, step, len(h1))
            k1, k2 = joined_keys(h1[first], h2[first], h1[last], h2[last])
            code, step, kept = _kept(group, step, at, shared.value(k1))
            if len(code):
                yield _relation(lang, k1[kept], k2[kept], code, step)
    return places.mapInArrow(run, RELATION)


def stored(df: DataFrame, name: str, batch_rows: int, **options) -> DataFrame:
    """``df`` written and read back, its Python steps fed ``batch_rows`` rows or
    about ``_BATCH_BYTES`` at a time; ``options`` of the file's writer."""
    conf = df.sparkSession.conf
    settings = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(batch_rows), "spark.sql.execution.arrow.maxBytesPerBatch": _BATCH_BYTES}
    before = {k: conf.get(k) for k in settings}
    for k, v in settings.items():
        conf.set(k, v)
    try:
        return written(df, name, **options)
    finally:
        for k, v in before.items():
            conf.set(k, v)


def _score(n: Column) -> Column:
    """The lowest-scoring cut: struct (score, words before it, l, r)."""
    def cut(j):
        wide = [c.cast("decimal(19,0)") for c in (F.element_at("suf", -1), n, F.get("pre", j - 1), F.get("suf", F.size("suf") - j - 1))]
        a, n_, left, right = wide
        return F.struct(F.call_function("div", (F.lit(1000).cast("decimal(4,0)") * (a * n_).cast("decimal(34,0)")), left * right).alias("score"),
                        j.alias("cut"), F.get("pre", j - 1).alias("l"), F.get("suf", F.size("suf") - j - 1).alias("r"))
    return F.array_min(F.transform(F.sequence(F.lit(1), F.size("pre") - 1), cut))


def candidates(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST,
               bits: int = BITS) -> DataFrame:
    """Every phrase of 2 to ``longest`` words with ``least`` occurrences that
    doesn't always stand inside a longer one: lang, phrase, a, n, score and the
    cut's l and r."""
    pieces = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    groups, totals = frequent_words(pieces, least)
    places = stored(word_places(pieces, KeyFilter.of(groups, bits)), "places-1", BATCH_ROWS, **_LARGE_ROWS)
    found, inside = [], []
    for k in range(2, longest + 1):
        before = groups
        groups = stored(frequent_phrases(places, before, least, bits), f"phrases-{k}", _MANY)
        found.append(groups)
        if k > 2:
            for side, f in (("p", "pre"), ("s", "suf")):
                inside.append(groups.where(F.element_at(f, -1) == F.element_at(f, -2)).select(F.col(f"{side}1").alias("h1"), F.col(f"{side}2").alias("h2")))
        if k < longest:
            places = stored(longer_places(places, KeyFilter.of(groups, bits)), f"places-{k}", _FEW, **_LARGE_ROWS)

    def union(frames):
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    kept = union(found)
    if inside:
        kept = kept.join(union(inside), ["h1", "h2"], "left_anti")
    best = kept.join(totals, "lang").withColumn("best", _score(F.col("total")))
    return best.select("lang", "phrase", F.element_at("suf", -1).alias("a"), F.col("best.l").alias("l"), F.col("best.r").alias("r"),
                       F.col("total").alias("n"), F.col("best.score").alias("score"))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST,
                 top: int = TOP, bits: int = BITS) -> DataFrame:
    """Each language's first ``top`` candidates by score, count and phrase."""
    found = candidates(docs, text_col, lang_col, least, longest, bits)
    ordered, _ = row_numbers(found, [F.col("lang"), F.col("score").desc(), F.col("a").desc(), F.col("phrase")])
    first = ordered.groupBy("lang").agg(F.min("row_number").alias("first"))
    ranked = ordered.join(first, "lang").withColumn("rank", F.col("row_number") - F.col("first") + 1)
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest 2,000 phrases of every language of the documents."""
    return collocations(table(spark, sf_dir, "documents"))
