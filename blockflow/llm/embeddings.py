"""Embedding near-dedup: spherical k-means cells, blocked cosine products.

Unit vectors are assigned to the ``PROBES`` nearest of k spherical k-means
centres (k grows with the number of different vectors, up to an eighth of the
sample).  Where more than ``tile`` entries of a label meet in a cell, the cell
gets centres of its own, fitted on a bounded sample of its entries, and each
entry goes to the ``SUB_PROBES`` nearest of these; so on down a tree, at most
``LEVELS`` deep, so that cells stay small however many vectors there are.  A
pair is compared in every leaf (label, path of cells) that both are in and
counted in one: at each level the smallest cell that both could go to, so a
pair split between neighbouring cells is still met.  Inside a leaf the cosines
are computed in double precision, block by block.

Equal rows (same label and vector) are one entry with a number of copies, so
copies are never expanded into pairs; an entry is in at most PROBES *
SUB_PROBES ** (LEVELS - 1) leaves.  A leaf that centres can't part (its vectors
are too much alike) and that stays over ``tile`` entries is cut into tiles, and
every pair of tiles is a task group of its own: a task holds two tiles at most.
Tasks send each entry's number of links and a star per linked set; components
are made by ``components.connected_components``.

The first centres are fitted on at most ``sample`` vectors (smallest hash of
the vector) collected to the driver, those of a cell in a task on about
``cell_sample`` of its entries (chosen by hash; twice that at most): documented
bounds.  Every vector is assigned and compared.  The share of linked pairs that
meet in a leaf is measured in tests/llm against all pairs, on one level and on
several.

Defined cases: a null label or vector, a zero vector, one with a null or
non-finite component links with nothing (0 links, its own component);
vectors of another length than the sampled ones share one cell per label and
length, compared whole, tile by tile; a null vec_id has a null component
unless it is linked with rows that have an id; repeated ids are rows of their
own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, hot_keys, join_by_hot, table, written
from .components import connected_components
from .simhash import merge

COSINE, PROBES, SAMPLE, PER_CELL, TILE = 0.93, 6, 16_384, 256, 4096
SUB_PROBES, CELL_SAMPLE, LEVELS = 3, 4096, 4
SAMPLE_VALUES = 4 << 20


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """(k, d) unit centres of the unit rows ``x``."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), size=min(k, len(x)), replace=False)]
    for _ in range(rounds):
        mine = np.concatenate([(x[a:a + 4096] @ centres.T).argmax(axis=1) for a in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, mine, x)
        norm = np.linalg.norm(sums, axis=1)
        empty = norm < 1e-12
        sums[empty], norm[empty] = x[rng.choice(len(x), size=int(empty.sum()))], 1.0
        centres = sums / norm[:, None]
    return centres


def unit(vectors: list) -> np.ndarray:
    v = np.array(vectors, dtype=np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)            # so that squares neither vanish nor overflow
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def valid(vector, label):
    """Condition: the row can be linked."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return label.isNotNull() & F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def centres_of(entries: DataFrame, n: int, sample: int = SAMPLE, per_cell: int = PER_CELL) -> np.ndarray | None:
    """Centres from the ``sample`` entries of smallest hash (fewer where vectors
    are so long that the sample would pass ``SAMPLE_VALUES`` numbers); None if
    there is none."""
    longest = entries.agg(F.max(F.size("vector"))).first()[0] or 1
    sample = min(sample, max(256, SAMPLE_VALUES // longest))
    rows = entries.select("vector").orderBy(F.xxhash64("vector")).limit(sample).collect()
    lengths = [len(r["vector"]) for r in rows]
    if not rows:
        return None
    dim = max(set(lengths), key=lambda d: (lengths.count(d), d))
    x = unit([r["vector"] for r in rows if len(r["vector"]) == dim])
    return spherical_kmeans(x, max(1, min(-(-n // per_cell), len(x) // 8)))


def assigned(entries: DataFrame, centres: np.ndarray, probes: int = PROBES) -> DataFrame:
    """An entry per cell it is assigned to: uid, copies, label, vector, size (of
    the vector), cell (the path, as text) and cells (by level, all the cells
    that the entry went to)."""
    d = entries.select("uid", "copies", "label", "vector")
    schema = d.select("*", F.size("vector").alias("size"), F.lit("").alias("cell"), F.array(F.array(F.lit(0))).alias("cells")).schema
    dim = centres.shape[1]

    def run(b):
        vectors = b.column("vector").to_pylist()
        sizes = np.array([len(v) for v in vectors], dtype=np.int32)
        p = min(probes, len(centres))
        cells = np.full((len(vectors), p), -1, dtype=np.int32)
        known = np.flatnonzero(sizes == dim)
        for a in range(0, len(known), 2048):
            part = known[a:a + 2048]
            near = unit([vectors[i] for i in part]) @ centres.T
            cells[part] = np.sort(np.argpartition(-near, p - 1, axis=1)[:, :p], axis=1)
        owner = np.repeat(np.arange(len(vectors)), np.where(sizes == dim, p, 1))
        nth = np.concatenate([np.arange(p) if s == dim else np.zeros(1, int) for s in sizes]).astype(int)
        t = pa.Table.from_batches([b]).take(pa.array(owner))
        return (t.append_column("size", pa.array(sizes[owner]))
                .append_column("cell", pa.array(cells[owner, nth].astype(str), pa.string()))
                .append_column("cells", _levels([cells[owner]])).combine_chunks())
    return d.mapInArrow(arrow_rows(run), schema)


def _levels(cells: list[np.ndarray]) -> pa.ListArray:
    """Rows of one list of cells per level, from a matrix per level."""
    rows = len(cells[0])
    width = np.array([c.shape[1] for c in cells])
    flat = pa.array(np.concatenate(cells, axis=1).ravel().astype(np.int32), pa.int32())
    inner = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *np.tile(width, rows)]), pa.int32()), flat)
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * len(cells), pa.int32()), inner)


def _matrices(cells: pa.Array, levels: int) -> list[np.ndarray]:
    """The matrix of each level, from rows of one path."""
    flat = cells.flatten()
    width = np.diff(flat.offsets.to_numpy())[:levels]
    whole = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(cells), -1)
    return np.split(whole, np.cumsum(width)[:-1], axis=1)


_KEY = ["label", "size", "cell"]


def _groups(batches, key: list[str]):
    """Tables of equal ``key`` from sorted batches; the last of a batch is held until the next says whether it goes on."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if rest is None else pa.concat_tables([rest, t])
        cut = np.zeros(t.num_rows, dtype=bool)
        for c in key:
            v = t.column(c).to_numpy()
            cut[1:] |= v[1:] != v[:-1]
        starts = [0, *np.flatnonzero(cut).tolist()]
        for a, z in zip(starts, starts[1:]):
            yield t.slice(a, z - a)
        rest = t.slice(starts[-1])
    if rest is not None and rest.num_rows:
        yield rest


def _units(t: pa.Table) -> np.ndarray:
    flat = t.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return unit(flat.reshape(t.num_rows, -1))


def crowded(cells: DataFrame, most: int) -> DataFrame:
    """(label, size, cell, many) of the cells with over ``most`` entries, written."""
    return written(cells.groupBy(*_KEY).agg(F.count("*").alias("many")).where(F.col("many") > most), "crowded")


def refined(cells: DataFrame, large: DataFrame, per_cell: int, cell_sample: int, probes: int) -> DataFrame:
    """``cells`` with the entries of the ``large`` ones a level further down."""
    rows = cells.join(large, _KEY)
    share = F.least(F.lit(1.0), F.lit(float(cell_sample)) / F.col("many"))
    # a vector of many numbers counts for several
    share = share / F.greatest(F.lit(1.0), F.col("size") * F.lit(cell_sample / SAMPLE_VALUES))
    drawn = rows.where(F.pmod(F.xxhash64("uid", "cell"), F.lit(1 << 30)) < share * F.lit(float(1 << 30)))
    drawn = drawn.select(*_KEY, "many", "uid", "vector").repartition(*_KEY).sortWithinPartitions(*_KEY, "uid")

    def fit(batches):
        for t in _groups(batches, _KEY):
            x = _units(t)
            k = max(2, min(-(-t.column("many")[0].as_py() // per_cell), len(x) // 8))
            if len(x) > 2:
                centres = spherical_kmeans(x, k)
                one = t.slice(0, 1).select(_KEY).append_column("centres", pa.array([centres.tobytes()], pa.binary()))
                yield from one.combine_chunks().to_batches()

    centres = written(drawn.mapInArrow(fit, cells.select(*_KEY, F.lit(b"").alias("centres")).schema), "cell-centres")
    # centres go ahead of the entries of their cell, once for each of the parts a very large cell is dealt to
    parts = F.ceil(F.col("many") / F.lit(1 << 15)).cast("int")
    ahead = centres.join(large, _KEY).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    none = {f.name: F.lit(None).cast(f.dataType) for f in cells.schema if f.name not in _KEY}
    ahead = ahead.select(*_KEY, "part", "centres").withColumns(none)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("uid"), parts).cast("int")).withColumn("centres", F.lit(None).cast("binary"))
    both = rows.select(*cells.columns, "part", "centres").unionByName(ahead.select(*cells.columns, "part", "centres"))
    both = both.repartition(*_KEY, "part").sortWithinPartitions(*_KEY, "part", F.col("centres").desc_nulls_last(), "uid")

    columns = cells.columns

    def descend(batches):
        key, near = None, None
        for b in batches:
            for t in _groups([b], [*_KEY, "part"]):
                if t.column("centres")[0].is_valid:
                    key = [t.column(c)[0].as_py() for c in (*_KEY, "part")]
                    near = np.frombuffer(t.column("centres")[0].as_py(), dtype=np.float64).reshape(-1, t.column("size")[0].as_py())
                    t = t.slice(1)
                t = t.select(columns)
                if not t.num_rows:
                    continue
                path = t.column("cell")[0].as_py()
                if key is None or key[:3] != [t.column(c)[0].as_py() for c in _KEY]:
                    yield from t.to_batches()                 # too few in the sample: the cell stays
                    continue
                p = min(probes, len(near))
                mine = np.sort(np.argpartition(-(_units(t) @ near.T), p - 1, axis=1)[:, :p], axis=1)
                upper = _matrices(t.column("cells").combine_chunks(), path.count("/") + 1)
                owner, nth = np.repeat(np.arange(t.num_rows), p), np.tile(np.arange(p), t.num_rows)
                out = t.take(pa.array(owner))
                names = [f"{path}/{c}" for c in range(len(near))]
                out = out.set_column(out.column_names.index("cell"), "cell", pa.array([names[c] for c in mine[owner, nth]], pa.string()))
                out = out.set_column(out.column_names.index("cells"), "cells", _levels([*(u[owner] for u in upper), mine[owner]]))
                yield from out.combine_chunks().to_batches()

    deeper = both.mapInArrow(descend, cells.schema)
    return cells.join(large.select(_KEY), _KEY, "left_anti").select(cells.columns).unionByName(deeper)


def leaves(entries: DataFrame, centres: np.ndarray, probes: int = PROBES, per_cell: int = PER_CELL, tile: int = TILE,
           cell_sample: int = CELL_SAMPLE, sub_probes: int = SUB_PROBES, levels: int = LEVELS) -> DataFrame:
    """An entry per leaf it is assigned to (:func:`assigned`), cells over ``tile`` entries parted."""
    cells = assigned(entries, centres, probes)
    if entries.count() <= tile:
        return cells
    cells = written(cells, "cells")
    for _ in range(levels - 1):
        large = crowded(cells, tile)
        if large.isEmpty():
            break
        cells = written(refined(cells, large, per_cell, cell_sample, sub_probes), "cells")
    return cells


def compare(x: np.ndarray, tiles: np.ndarray, cells: list[np.ndarray], copies: np.ndarray, path: list[int], cosine: float,
            cross: bool, block: int = 512):
    """(links per entry, counted with copies; label per entry) of one group, the
    leaf ``path``.  ``cross``: the group is a pair of tiles, compared with each
    other only."""
    n = len(x)
    count, label = np.zeros(n, dtype=np.int64), np.arange(n)
    for a in range(0, n, block):
        near = x[a:a + block] @ x[a:].T
        i, j = np.nonzero(near >= cosine)
        i, j = i + a, j + a
        ok = i < j
        if cross:
            ok &= tiles[i] != tiles[j]
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        label = merge(label, i, j)
        for level, cell in zip(cells, path):                  # the pair's first common cell at each level
            if level.shape[1] > 1 and len(i):
                first = np.full(len(i), np.iinfo(np.int32).max, dtype=np.int32)
                for c in range(level.shape[1]):
                    mine = level[i, c]
                    both = (level[j] == mine[:, None]).any(axis=1)
                    first = np.where(both, np.minimum(first, mine), first)
                own = first == cell
                i, j = i[own], j[own]
        np.add.at(count, i, copies[j])
        np.add.at(count, j, copies[i])
    return count, label


def pairs(cells: DataFrame, cosine: float = COSINE, tile: int = TILE) -> DataFrame:
    """(a, b, n) from the compared cells: b null: n links of entry a; else a star link of a and b."""
    large = crowded(cells, tile)
    parts = F.coalesce(F.ceil(F.col("many") / tile), F.lit(1)).cast("long")
    rows = cells.join(large, _KEY, "left").withColumn("parts", parts).withColumn("mine", F.pmod(F.xxhash64("uid"), F.col("parts")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    rows = rows.select(*_KEY, F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"),
                       "mine", "uid", "copies", "vector", "cells")
    group = [*_KEY, "x", "y"]
    rows = rows.repartition(*group).sortWithinPartitions(*group, "uid")

    def run(batches):
        for t in _groups(batches, group):
            uid = t.column("uid").to_numpy()
            if len(uid) < 2:
                continue
            path = [int(c) for c in t.column("cell")[0].as_py().split("/")]
            count, label = compare(_units(t), t.column("mine").to_numpy(), _matrices(t.column("cells").combine_chunks(), len(path)),
                                   t.column("copies").to_numpy(), path, cosine, t.column("x")[0].as_py() != t.column("y")[0].as_py())
            some, star = np.flatnonzero(count), np.flatnonzero(label != np.arange(len(label)))
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(uid[some]), pa.nulls(len(some), pa.int64()), pa.array(count[some])], names=["a", "b", "n"])
            if len(star):
                yield pa.RecordBatch.from_arrays([pa.array(uid[star]), pa.array(uid[label[star]]), pa.nulls(len(star), pa.int64())], names=["a", "b", "n"])
    return rows.mapInArrow(run, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                    cosine: float = COSINE, probes: int = PROBES, sample: int = SAMPLE, per_cell: int = PER_CELL,
                    tile: int = TILE, cell_sample: int = CELL_SAMPLE, sub_probes: int = SUB_PROBES) -> DataFrame:
    """One row per vector: ``id_col``, n_links, component_id, kept."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), F.col(label_col).alias("label"))
    # equal rows are known by 128 bits of their hash; rows that cannot link have none
    mark = F.when(valid(F.col("vector"), F.col("label")),
                  F.struct(F.xxhash64("label", "vector").alias("h"), F.xxhash64("vector", F.lit(1), "label").alias("g")))
    rows = rows.select("id", "vector", "label", mark.alias("key"))
    entries = rows.where("key is not null").groupBy("key").agg(
        F.count("*").alias("copies"), F.min("id").alias("low"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    entries = written(entries.withColumn("uid", F.monotonically_increasing_id()), "vectors")
    centres = centres_of(entries, entries.count(), sample, per_cell)
    alone = F.col("id").alias("component_id")
    if centres is None:
        out = rows.select("id", F.lit(0).cast("long").alias("n_links"), alone)
    else:
        found = written(pairs(leaves(entries, centres, probes, per_cell, tile, cell_sample, sub_probes), cosine, tile), "vector-links")
        roots = connected_components(found.where("b is not null").select("a", "b"))
        counts = found.where("b is null").groupBy(F.col("a").alias("uid")).agg(F.sum("n").alias("n"))
        entries = entries.select("uid", "key", "copies", "low").join(counts, "uid", "left").join(
            roots.withColumnRenamed("node", "uid"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))
        least = entries.groupBy("root").agg(F.min("low").alias("component_id"))
        entries = written(entries.join(least, "root").select(
            "key", "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"), "vector-classes")
        hot = hot_keys(entries, "copies", entries.agg(F.sum("copies")).first()[0] or 0)
        linkable = join_by_hot(rows.where("key is not null").select("id", "key"), entries.drop("copies"), "key", hot)
        out = linkable.select("id", "n_links", "component_id").unionByName(
            rows.where("key is null").select("id", F.lit(0).cast("long").alias("n_links"), alone))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", kept.alias("kept"))


def representatives(vectors: DataFrame, id_col: str = "vec_id", **how) -> DataFrame:
    """The rows of ``vectors`` that stay, one id per group (:func:`near_duplicates`)."""
    stay = near_duplicates(vectors, id_col, **how).where("kept").select(id_col).distinct()
    return vectors.join(stay, id_col, "left_semi")


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and representative of every embedding."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
