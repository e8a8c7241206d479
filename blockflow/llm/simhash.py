"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints.  Words of the whole lower-cased text give word shingles; bit i
of the fingerprint is 1 when it is 1 in over half of the shingles' XXH64.

Index.  Equal fingerprints are one entry.  With at most ``distance`` = 4
differing bits, b > 4 bit blocks have b - 4 or more without a difference, so
the top nodes of the index are the choices of b - 4 blocks (masks) with their
shared bit pattern: entries under different patterns of a mask are pruned
whole, and every linked pair meets under some mask.  b is the least for which
a top node of evenly spread fingerprints stays near ``NODE`` entries: 5 blocks
(5 masks) up to some millions, 6 (15 masks) up to some billions.  Spark
shuffles entries to their top nodes, sorted by node and by Gray rank.  Below,
the entries of every node, in Gray order, form a hierarchy of ``_FAN`` members
a group: each group holds the mask of the bits on which its members agree and
their pattern, less what its parent holds already; a query goes down with the
differences accumulated so far and leaves every group where they exceed the
distance.  The hierarchies of all nodes in a task go down together, level by
level.  A node over ``tile`` entries is cut into tiles and each pair of tiles is
a task group of its own, so no task holds more than two tiles.

Links.  A task joins what it finds and sends a star (member, smallest
member) per linked set, never all pairs; components are made by
``components.connected_components``.

Defined cases: null or wordless text has fingerprint zero and is linked like
any other; fewer words than a shingle make one shingle; a null id takes part,
but the component id is the smallest id that is not null (null if none).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, hot_keys, join_by_hot, map_text, sliced, table, written
from .components import connected_components

SHINGLE, DISTANCE, NODE, TILE = 4, 4, 512, 4096
_FAN = 8


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    k = min(shingle, len(words))
    spans = zip(starts[:len(words) - k + 1].tolist(), (ends[k - 1:] - 1).tolist())
    one = np.zeros(64, dtype=np.int64)
    digest, n, part = xxhash.xxh64_intdigest, 0, []
    view = memoryview(joined)
    for a, b in spans:
        part.append(digest(view[a:b], 42))
        if len(part) == 65536:
            one += _ones(part)
            n, part = n + len(part), []
    if part:
        one += _ones(part)
        n += len(part)
    return int(np.packbits((2 * one > n)[::-1]).view(">u8")[0])


def _ones(hashes: list[int]) -> np.ndarray:
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(``id_col``, fp long) per row: the fingerprint's bits as a signed long."""
    d = docs.select(id_col, text_col)

    def run(batches):
        for b in sliced(batches, text_col):
            texts = b.column(text_col).to_pylist()
            fp = np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(fp)], names=[id_col, "fp"])
    return map_text(d, run, d.select(id_col, F.lit(0).cast("long").alias("fp")).schema)


def blocks_for(n: int, distance: int = DISTANCE, node: int = NODE) -> int:
    """The least number of bit blocks whose patterns spread ``n`` fingerprints to ``node`` a top node."""
    blocks = distance + 1
    while blocks < 2 * distance + 2 and n > node * 2 ** (64 * (blocks - distance) // blocks):
        blocks += 1
    return blocks


def block_masks(distance: int = DISTANCE, blocks: int = DISTANCE + 1) -> list[int]:
    """Masks of every choice of ``blocks - distance`` of ``blocks`` equal bit
    blocks: two words within ``distance`` bits agree on at least one of them."""
    cut = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(cut, cut[1:])]
    return [sum(pick) for pick in combinations(block, blocks - distance)]


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each word in the reflected Gray code."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """Hierarchies over the groups of ``words`` that begin at ``starts``, each
    group in Gray order; see the module's text.  ``pruned`` counts the groups of
    members that queries left whole."""

    def __init__(self, words: np.ndarray, starts: np.ndarray | None = None):
        self.words, self.pruned = words, 0
        starts = np.zeros(min(1, len(words)), dtype=np.int64) if starts is None else starts
        count = np.diff(np.append(starts, len(words)))
        self.group = np.repeat(np.arange(len(starts)), count)
        self.levels: list[tuple[np.ndarray, ...]] = []       # first member, one past the last, pattern, own mask; top first
        low, high, first = words, words, starts
        agree_below = None
        while len(words) and (not self.levels or count.max() > 1):
            nodes = -(-count // _FAN)
            offset = np.cumsum(nodes) - nodes
            nth = np.arange(nodes.sum()) - np.repeat(offset, nodes)
            at = np.repeat(first, nodes) + nth * _FAN
            end = np.minimum(at + _FAN, np.repeat(first + count, nodes))
            low, high = np.bitwise_and.reduceat(low, at), np.bitwise_or.reduceat(high, at)
            agree = ~(low ^ high)
            if agree_below is not None:                      # a group holds only what its parent doesn't
                self.levels[0][3][:] = agree_below & ~np.repeat(agree, end - at)
            self.levels.insert(0, (at, end, low & agree, agree.copy()))
            agree_below, first, count = agree, offset, nodes

    def within(self, distance: int, batch: int = 1 << 15):
        """Batches of (position, position) of all pairs of a group within ``distance``, the smaller first."""
        count = np.bitwise_count
        for lo in range(0, len(self.words), batch):
            q = np.arange(lo, min(len(self.words), lo + batch))
            node = self.group[q]
            gone = np.zeros(len(q), dtype=np.int16)
            for i, (first, end, pattern, own) in enumerate(self.levels):
                gone = gone + count((self.words[q] ^ pattern[node]) & own[node])
                ok = gone <= distance
                self.pruned += len(ok) - int(ok.sum())
                q, gone, node = q[ok], gone[ok], node[ok]
                size = end[node] - first[node]
                owner = np.repeat(np.arange(len(node)), size)
                child = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + first[node][owner]
                q, gone, node = q[owner], gone[owner], child
            later = node > q
            q, node = q[later], node[later]
            near = count(self.words[q] ^ self.words[node]) <= distance
            if near.any():
                yield q[near], node[near]


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (smallest position of the set) after joining a with b."""
    while len(a):
        la, lb = label[a], label[b]
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        label = label[label]
        while True:
            nxt = label[label]
            if (nxt == label).all():
                break
            label = nxt
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def linked(words: np.ndarray, starts: np.ndarray, distance: int) -> np.ndarray:
    """Label per word (smallest position linked with it inside its group);
    groups are the runs beginning at ``starts``, each in Gray order."""
    label, size = np.arange(len(words)), np.diff(np.append(starts, len(words)))
    some = np.flatnonzero(np.repeat(size > 1, size))          # a word alone in its group has no link there
    size = size[size > 1]
    for a, b in GrayIndex(words[some], np.cumsum(size) - size).within(distance):
        label = merge(label, some[a], some[b])
    return label


def links(entries: DataFrame, distance: int = DISTANCE, blocks: int | None = None, tile: int = TILE) -> DataFrame:
    """(a, b) longs joining all distinct words ``fp`` of ``entries`` that are
    connected by steps of at most ``distance`` bits."""
    blocks = blocks or blocks_for(entries.count(), distance)
    masks = [m - (1 << 64) if m >> 63 else m for m in block_masks(distance, blocks)]
    rank = F.col("fp")
    for s in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, s))
    top = F.explode(F.array(*[F.struct(F.lit(i).cast("short").alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits"))
                              for i, m in enumerate(masks)]))
    nodes = entries.select("fp", top.alias("n")).select("fp", "n.mask", "n.bits")
    large = nodes.groupBy("mask", "bits").agg(F.count("*").alias("size")).where(F.col("size") > tile)
    nodes = nodes.join(large, ["mask", "bits"], "left")
    parts = F.coalesce(F.ceil(F.col("size") / tile), F.lit(1)).cast("long")
    nodes = nodes.withColumn("parts", parts).withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("parts")))
    nodes = nodes.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    nodes = nodes.select("mask", "bits", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "fp")
    nodes = nodes.repartition("mask", "bits", "x", "y").withColumn("rank", rank)
    nodes = nodes.sortWithinPartitions("mask", "bits", "x", "y", "rank").select("mask", "bits", "x", "y", "fp")

    def run(batches):
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            done, rest = _split(t)
            if done is not None:
                yield from _stars(done, distance)
        if rest is not None and rest.num_rows:
            yield from _stars(rest, distance)
    return nodes.mapInArrow(run, "a long, b long")


def _changes(t: pa.Table) -> np.ndarray:
    change = np.zeros(t.num_rows, dtype=bool)
    change[:1] = True
    for c in ("mask", "bits", "x", "y"):
        v = t.column(c).to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(change)


def _split(t: pa.Table):
    """(whole groups, the last group, which may go on in the next batch)."""
    if not t.num_rows:
        return None, t
    last = int(_changes(t)[-1])
    return (t.slice(0, last) if last else None), t.slice(last)


def _stars(t: pa.Table, distance: int):
    words = t.column("fp").to_numpy()
    label = linked(words.view(np.uint64), _changes(t), distance)
    own = np.flatnonzero(label != np.arange(len(label)))
    if len(own):
        yield pa.RecordBatch.from_arrays([pa.array(words[own]), pa.array(words[label[own]])], names=["a", "b"])


def classes(prints: DataFrame, id_col: str = "doc_id", distance: int = DISTANCE) -> DataFrame:
    """(fp, root, component_id, copies) for every distinct fingerprint of the
    written table ``prints``: ``root`` names the component."""
    entries = written(prints.groupBy("fp").agg(F.min(id_col).alias("low"), F.count("*").alias("copies")), "entries")
    roots = connected_components(links(entries.select("fp"), distance))
    entries = entries.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "low", "copies")
    least = entries.groupBy("root").agg(F.min("low").alias("component_id"))
    return written(entries.join(least, "root").select("fp", "root", "component_id", "copies"), "classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    distance: int = DISTANCE) -> DataFrame:
    """(``id_col``, fp, root, component_id) for every row of ``docs``."""
    if id_col.lower() in ("fp", "root", "component_id"):
        raise ValueError(f"the id column's name {id_col!r} is one of the result's: rename it")
    prints = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    found = classes(prints, id_col, distance)
    total = found.agg(F.sum("copies")).first()[0] or 0
    hot = hot_keys(found, "copies", total)
    return join_by_hot(prints, found.drop("copies"), "fp", hot)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
             distance: int = DISTANCE) -> DataFrame:
    """One row of ``docs`` per component, columns unchanged (an id column named
    as in :func:`near_duplicates`' result is an error): the row with the
    component's smallest id (among rows repeating that id the smallest by
    fingerprint and then by the whole row; null ids only where a component
    has no other)."""
    root, fp, pick = free_name(docs, "root"), free_name(docs, "fp"), free_name(docs, "pick")
    marks = written(near_duplicates(docs, id_col, text_col, shingle, distance), "marks")
    rows = marks.groupBy(id_col).agg(F.count("*").alias("rows"))
    lead = marks.where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(id_col, "root").distinct()
    lead = written(lead.join(rows, id_col, "left"), "leaders")                     # no rows for a null id
    alone = lead.where("rows = 1").select(id_col)
    first = docs.join(alone.hint("shuffle_hash"), id_col, "left_semi").select(docs.columns)
    ties = lead.where("rows > 1 or rows is null")
    if ties.isEmpty():
        return first
    # the leading id names several rows: fingerprint those again (they carry no other name) and take the least
    tied = ties.select(F.col("root").alias(root))
    ids = ties.select(F.col(id_col).alias(pick)).distinct()
    rows = docs.join(ids, F.col(id_col).eqNullSafe(F.col(pick)), "left_semi")
    struct = F.struct(*[F.col(c) for c in docs.columns])
    keyed = rows.select(struct.alias(pick), F.col(id_col), F.col(text_col))

    def run(batches):
        for b in sliced(batches, text_col):
            v = np.array([fingerprint(t, shingle) for t in b.column(text_col).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(pick), b.column(id_col), pa.array(v)], names=[pick, id_col, fp])
    keyed = map_text(keyed, run, keyed.select(pick, id_col, F.lit(0).cast("long").alias(fp)).schema)
    roots = marks.select(F.col("fp").alias(fp), F.col("root").alias(root), F.col("component_id").alias("component_id")).distinct()
    keyed = keyed.join(roots, fp).join(tied, root, "left_semi")
    keyed = keyed.where(F.col(id_col).eqNullSafe(F.col("component_id")))
    least = keyed.groupBy(root).agg(F.min(F.struct(F.col(fp), F.to_json(pick).alias("j"), F.col(pick))).alias(pick))
    return first.unionByName(least.select(f"{pick}.{pick}.*").select(docs.columns))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
