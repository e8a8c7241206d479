"""Benchmark decontamination by q-gram lemma filtering.

Texts of both sides are read alike: letters, digits and marks in lower case,
every run of other characters (white space, punctuation, symbols, controls of
any script) as one blank.  A benchmark item is covered by windows of
``WINDOW`` characters, each a quarter further on (a shorter item is one window).  A
document is contaminated when some window lies in it within the edit budget
``k`` (a tenth of the window).

Filter.  A window of m characters found with k edits shares at least
m + 1 - q * (k + 1) q-grams with the document (q-gram lemma), inside m + k
characters of it, and their diagonals (document minus item position) span at
most k.  So places are looked for where an item has that many q-grams within
that length, by sliding counts over the document's positions, in which a
position counts once per item however often the item repeats its q-gram.  Only
there are diagonals formed: q-grams are counted per band of 2k diagonals,
bands overlapping by half so that any span of k lies whole in one; bands, and
windows inside them, below the bound are left.  What remains is verified by a
banded alignment; where windows of the item stand letter for letter they are
found first, and places that they cover are not looked at again.

The benchmark is the stated query set: it is cut into blocks of at most
``block_chars`` characters (checked by a sum), each block's index of bounded
size goes to the tasks, and each block is one pass over the documents with no
shuffle (one pass per two million characters of benchmark).  Documents are
handled in pieces of bounded text, a longer one alone; its q-grams are handled
in slices of at most ``HITS`` (position, item) rows, items longer than
``PART`` in parts, and places longer than ``PLACE`` piece by piece, so a text
that repeats itself for megabytes needs no more memory than another.

Defined cases: null and empty texts hold nothing; items with fewer than q
characters after reading have no q-gram and never match (k is lowered for
short items so that the bound stays positive); a null item id is kept as
null; items repeated are each reported; repeated documents likewise.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import map_text, sliced, table

Q, WINDOW, EDITS, BLOCK_CHARS = 8, 96, 0.1, 2_000_000
HITS, PART, PLACE = 1 << 19, 2048, 512
_BLANK = 32
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BITS = 23


def _compared(c: str) -> str:
    """A character as it is compared: lower case, or a blank."""
    if unicodedata.category(c)[0] not in "LMN":
        return " "
    low = c.lower()
    return low if len(low) == 1 else c


def _codes_table() -> np.ndarray:
    codes = np.empty(0x10000, dtype=np.uint8)
    for c in range(0x10000):
        o = ord(_compared(chr(c)))
        codes[c] = o if o < 128 else 128 + (o & 127)
    return codes


class _Letters(dict):
    """For ``str.translate``: compared characters, made as they are met."""

    def __missing__(self, c: int) -> str:
        self[c] = low = _compared(chr(c))
        return low


_CODES: np.ndarray | None = None


def _codes() -> np.ndarray:
    global _CODES
    if _CODES is None:
        _CODES = _codes_table()
    return _CODES


_LETTERS = _Letters()


def _plain(text: str) -> str:
    """``text`` as it is compared, one character for each."""
    return text.translate(_LETTERS)


def read_codes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(one byte per kept character, its position in ``text``): ASCII letters
    lowered, one blank for each run of others than letters, digits and marks,
    other characters folded to 128-255 (only the filter reads these; the
    alignment reads the characters)."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")
    code = _codes()[np.minimum(points, 0xFFFF)]
    high = np.flatnonzero(points > 0xFFFF)
    if len(high):
        code[high] = [o if o < 128 else 128 + (o & 127) for o in (ord(_compared(text[i])) for i in high)]
    blank = code == _BLANK
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    if len(keep):
        keep[0] = not blank[0]
    at = np.flatnonzero(keep).astype(np.int32)
    return code[at], at


def reading(text: str) -> str:
    """The whole text as it is compared."""
    _, at = read_codes(text)
    return _plain("".join(text[p] for p in at)).strip(" ")


def budget(m: int, q: int = Q, edits: float = EDITS) -> tuple[int, int]:
    """(k, bound) of a window of m characters: edits allowed and q-grams shared at least."""
    k = max(0, min(int(edits * m), m // q - 1))
    return k, m + 1 - q * (k + 1)


def grams(codes: np.ndarray) -> np.ndarray:
    """All q-grams (q = 8) as integers, one per position."""
    n = len(codes) - Q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    return np.ndarray((n,), dtype="<u8", buffer=np.ascontiguousarray(codes).data, strides=(1,)).astype(np.uint64)


class Index:
    """q-gram postings of a block of benchmark items, long items in parts."""

    def __init__(self, items: list[tuple], window: int = WINDOW, edits: float = EDITS, part: int = PART):
        self.ids, self.item, self.texts, self.windows, lengths, budgets = [], [], [], [], [], []
        keys, owner, offset = [], [], []
        for number, (item_id, text) in enumerate(items):
            text = reading(text or "")
            m = min(len(text), window)
            if m < Q:
                continue
            starts = sorted({*range(0, max(1, len(text) - m + 1), max(1, m // 4)), len(text) - m})
            while starts:                                    # the windows beginning in ``part`` characters
                n = sum(s < starts[0] + part for s in starts[:part])
                mine, starts = starts[:n], starts[n:]
                piece = text[mine[0]:mine[-1] + m]
                t = len(self.ids)
                self.ids.append(item_id), self.item.append(number), self.texts.append(piece)
                self.windows.append(np.array(mine) - mine[0])
                lengths.append(m), budgets.append(budget(m, edits=edits))
                g = grams(_codes_of(piece))
                keys.append(g), owner.append(np.full(len(g), t)), offset.append(np.arange(len(g)))
        self.m = np.array(lengths, dtype=np.int64)
        self.k, self.bound = np.array(budgets, dtype=np.int64).reshape(-1, 2).T
        if not self.ids:
            return
        key, own = np.concatenate(keys), np.concatenate(owner)
        order = np.lexsort((own, key))
        key, own, self.offset = key[order], own[order], np.concatenate(offset)[order]
        pair = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (own[1:] != own[:-1])])       # a q-gram of a part
        self.pair_first, self.pair_size, self.pair_part = pair, np.diff(np.r_[pair, len(key)]), own[pair]
        self.key, self.first, self.size = np.unique(key[pair], return_index=True, return_counts=True)
        self.seen = np.zeros(1 << _BITS, dtype=bool)
        self.seen[self._slot(self.key)] = True
        self.reach = int((self.m + self.k).max())

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys * _MIX) >> np.uint64(64 - _BITS)

    def regions(self, texts: list[str | None], once: bool = False) -> Iterator[tuple[int, int, int, int, int]]:
        """(text number, item number, distance, start, end) of verified places:
        start and end are character positions in the text.  A place within one
        already given for the same text and item may be left out.  With
        ``once`` a text is left after its first."""
        if not self.ids:
            return
        parts, places, starts, n = [], [], [], 0
        gap = np.zeros(1, dtype=np.uint8)          # in no item, so no q-gram reaches over it
        for t in texts:
            c, at = read_codes(t) if t else (gap[:0], gap[:0])
            starts.append(n)
            parts += [c, gap]
            places.append(at)
            n += len(c) + 1
        code, start = np.concatenate(parts), np.array(starts)
        done: set[int] = set()
        for lo in range(0, len(code), 1 << 20):
            pos, at = self._hits(code, lo, min(len(code), lo + (1 << 20) + 2 * self.reach + Q))
            yield from self._slices(texts, start, places, pos, at, done if once else None)

    def _hits(self, code, lo, hi):
        """(position, number of the q-gram) of every q-gram of code[lo:hi] that some item has."""
        found = [(np.zeros(0, dtype=np.int64),) * 2]
        for a in range(lo, hi - Q + 1, 1 << 18):
            g = grams(code[a:min(hi, a + (1 << 18) + Q - 1)])
            pos = np.flatnonzero(self.seen[self._slot(g)])
            g = g[pos]
            at = np.minimum(np.searchsorted(self.key, g), len(self.key) - 1)
            ok = self.key[at] == g
            found.append((pos[ok] + a, at[ok]))
        return tuple(np.concatenate(x) for x in zip(*found))

    def _slices(self, texts, start, places, pos, at, done):
        total = np.cumsum(self.size[at])
        i = 0
        while i < len(pos):
            # at most HITS rows, but four windows' length at least; slices share two, so a place is whole in one
            j = np.searchsorted(total, total[i] + HITS, "right")
            j = max(int(j), int(np.searchsorted(pos, pos[i] + 4 * self.reach, "right")))
            yield from self._places(texts, start, places, pos[i:j], at[i:j], done)
            if j >= len(pos):
                return
            i = max(i + 1, int(np.searchsorted(pos, pos[j] - 2 * self.reach)))

    def _places(self, texts, start, places, pos, at, done):
        size = self.size[at]
        which = np.repeat(np.arange(len(pos)), size)
        pair = np.repeat(self.first[at] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        part, p = self.pair_part[pair], pos[which]
        group = (np.searchsorted(start, p, "right") - 1) * np.int64(len(self.ids)) + part
        order = np.argsort(group, kind="stable")
        group, p, pair, part = group[order], p[order], pair[order], part[order]
        # from hit i on, the bound is reached at hit i + bound - 1: near enough?
        last = np.arange(len(p)) + self.bound[part] - 1
        inside = np.flatnonzero(last < len(p))
        inside = inside[(group[last[inside]] == group[inside]) & (p[last[inside]] - p[inside] <= (self.m + self.k)[part[inside]] - Q)]
        if not len(inside):
            return
        ends = last[inside]
        cut = np.flatnonzero(np.r_[True, (group[inside[1:]] != group[inside[:-1]]) | (p[inside[1:]] > p[ends[:-1]] + Q)])
        for c, z in zip(cut, np.r_[cut[1:], len(inside)]):
            first, end = inside[c], ends[z - 1] + 1
            d, t = divmod(int(group[first]), len(self.ids))
            if done is not None and d in done:
                continue
            for found in self._verified(texts[d], places[d], t, p[first:end] - start[d], pair[first:end]):
                yield (d, self.item[t], *found)
                if done is not None:
                    done.add(d)
                    break

    def _verified(self, text, places, t, p, pair):
        """(distance, start, end) of windows of part ``t`` around its q-gram hits ``p`` (a run of near places)."""
        m, k = int(self.m[t]), int(self.k[t])
        for x in range(int(p[0]), int(p[-1]) + 1, PLACE):
            i, j = np.searchsorted(p, [x, x + PLACE + m + k])
            if i < j:
                yield from self._piece(text, places, t, p[i:j], pair[i:j], m, k)

    def _piece(self, text, places, t, p, pair, m, k):
        a, b = max(0, int(p[0]) - m - k), min(len(places), int(p[-1]) + Q + m + k)
        piece = _plain("".join(text[x] for x in places[a:b]))
        covered = np.zeros(len(piece) + 1, dtype=bool)
        inner = slice(int(p[0]) - a, int(p[-1]) + Q - a)
        for s in self.windows[t]:
            want, x = self.texts[t][s:s + m], -1
            while (x := piece.find(want, x + 1)) >= 0:
                if not covered[x:x + m].all():
                    covered[x:x + m] = True
                    yield 0, int(places[a + x]), int(places[a + x + m - 1]) + 1
            if covered[inner].all():
                return
        if _longest_gap(covered[inner]) <= k:
            return
        size = self.pair_size[pair]
        which = np.repeat(np.arange(len(p)), size)
        off = self.offset[np.repeat(self.pair_first[pair] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())]
        diagonal = p[which] - off
        band = diagonal // max(k, 1)
        order = np.argsort(band, kind="stable")
        of, cuts = np.unique(band[order], return_index=True)
        cuts = np.r_[cuts, len(order)]
        for i, value in enumerate(of):                      # a band and the next: 2k diagonals
            z = cuts[i + 2] if i + 1 < len(of) and of[i + 1] == value + 1 else cuts[i + 1]
            rows = order[cuts[i]:z]
            if len(rows) < self.bound[t]:
                continue
            low, high, offs = int(diagonal[rows].min()), int(diagonal[rows].max()), np.unique(off[rows])
            n = np.searchsorted(offs, self.windows[t] + m - Q, "right") - np.searchsorted(offs, self.windows[t], "left")
            for s in self.windows[t][n >= self.bound[t]].tolist():
                x, y = max(0, low + s - k - a), min(len(piece), high + s + m + k - a)
                if x >= y or covered[x:y].all():
                    continue
                found = align(self.texts[t][s:s + m], piece[x:y], k, low + s - a - x, high + s - a - x)
                if found is not None:
                    dist, u, v = found
                    covered[x + u:x + v] = True
                    yield dist, int(places[a + x + u]), int(places[a + x + v - 1]) + 1


def _codes_of(text: str) -> np.ndarray:
    """Codes of a text that is read already."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")
    return np.where(points < 128, points, 128 + (points & 127)).astype(np.uint8)


def _longest_gap(covered: np.ndarray) -> int:
    edge = np.flatnonzero(np.diff(np.r_[True, covered, True].astype(np.int8)))
    return int((edge[1::2] - edge[::2]).max(initial=0))


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that touch or overlap made one, in order."""
    out: list[tuple[int, int]] = []
    for x, y in sorted(spans):
        if out and x <= out[-1][1]:
            out[-1] = (out[-1][0], max(y, out[-1][1]))
        else:
            out.append((x, y))
    return out


def align(want: str, piece: str, k: int, low: int = 0, high: int | None = None):
    """(distance, start, end) of the best place of ``want`` in ``piece`` with at
    most k edits, or None.  The alignment keeps to the band of diagonals
    ``low`` - k to ``high`` + k, so it costs len(want) times the band."""
    x = piece.find(want)
    if x >= 0:
        return 0, x, x + len(want)
    high = len(piece) if high is None else high
    low, high = low - k, high + k
    w = np.frombuffer(want.encode("utf-32-le"), dtype="<u4")
    p = np.frombuffer(piece.encode("utf-32-le"), dtype="<u4")
    width, far = high - low + 1, 1 << 20
    idx = np.arange(width)
    # row i, cell c: want[:i] against piece ending at j = i + low + c; the start is free
    j = low + idx
    cost = np.where((j >= 0) & (j <= len(p)), 0, far)
    begin = j.copy()
    for i in range(1, len(w) + 1):
        j = i + low + idx
        inside = (j >= 1) & (j <= len(p))
        same = np.zeros(width, dtype=bool)
        same[inside] = p[j[inside] - 1] == w[i - 1]
        diag = np.where(inside, cost + ~same, far)
        up = np.r_[cost[1:] + 1, far]                       # a character of want left out
        nxt, src = np.where(diag <= up, diag, up), np.where(diag <= up, begin, np.r_[begin[1:], 0])
        nxt = np.where((j >= 0) & (j <= len(p)), nxt, far)
        run = np.minimum.accumulate(nxt - idx)               # characters of piece left out
        last = np.maximum.accumulate(np.where(nxt - idx == run, idx, 0))
        cost, begin = run + idx, src[last]
        cost = np.where((j >= 0) & (j <= len(p)), cost, far)
        if cost.min() > k:
            return None
    c = int(cost.argmin())
    end = len(w) + low + c
    return (int(cost[c]), int(begin[c]), end) if cost[c] <= k and end > begin[c] >= 0 else None


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text",
           block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple]]:
    """The benchmark in blocks near ``block_chars`` characters (by hash of the
    row), each collected by itself."""
    items = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    total = items.agg(F.sum(F.length("t"))).first()[0] or 0
    n = -(-total // block_chars)
    for b in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b)
        yield sorted(((r["i"], r["t"]) for r in part.collect()), key=lambda x: (x[0] is None, x[0], x[1] or ""))


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, edits: float = EDITS,
            block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document row and benchmark item found in it: ``id_col``,
    item_id, regions (separate places that its windows cover), distance (fewest
    edits of a window), first_char and last_char (the span of the places)."""
    schema = StructType([docs.schema[id_col], StructField("item_id", benchmark.schema[item_col].dataType)])
    for name, kind in (("regions", IntegerType()), ("distance", IntegerType()), ("first_char", LongType()), ("last_char", LongType())):
        schema = schema.add(name, kind)
    out, spark, names = None, docs.sparkSession, schema.names
    kinds = list(to_arrow_schema(schema).types)
    for items in blocks(benchmark, item_col, item_text, block_chars):
        shared = spark.sparkContext.broadcast(Index(items, window, edits))

        def run(batches, shared=shared, items=[(i, None) for i, _ in items]):
            index = shared.value
            for b in sliced(batches, text_col, 1 << 20):
                best: dict = {}
                for d, t, dist, x, y in index.regions(b.column(text_col).to_pylist()):
                    low, spans = best.get((d, t), (dist, []))
                    spans.append((x, y))
                    best[d, t] = min(low, dist), joined(spans) if len(spans) > 256 else spans
                if best:
                    ids, rows = b.column(id_col), []
                    for (d, t), (low, spans) in sorted(best.items()):
                        spans = joined(spans)
                        rows.append((ids[d].as_py(), items[t][0], len(spans), low, spans[0][0], spans[-1][1]))
                    yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*rows), kinds)], names=names)
        found = map_text(docs.select(id_col, text_col), run, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], schema)


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
               item_text: str = "text", window: int = WINDOW, edits: float = EDITS,
               block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found, columns unchanged."""
    for items in blocks(benchmark, item_col, item_text, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(Index(items, window, edits))

        def run(batches, shared=shared):
            for b in sliced(batches, text_col, 1 << 20):
                bad = {d for d, *_ in shared.value.regions(b.column(text_col).to_pylist(), once=True)}
                yield b.filter(pa.array([i not in bad for i in range(b.num_rows)])) if bad else b
        docs = map_text(docs, run, docs.schema)
    return docs


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents (clean documents have no row)."""
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
