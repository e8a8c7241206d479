"""Prefix trie of conversations by depth bands.

A node of depth d is a distinct sequence of d turns (role and text) that some
conversation starts with; the root, of depth 0, has no turn.  Totals over
subtrees are rolled up in bands of ``BAND`` depths: a node explodes only to
its ancestors inside its band (fewer than ``BAND`` rows), and the totals of
whole bands go to the node their band hangs from.  Those anchors are a trie
themselves, a ``BAND``-th as deep, which is rolled up the same way, so the
number of rounds is the logarithm of the depth, and no depth makes a row
explode to more than ``BAND``.

Node keys follow the same bands.  A conversation is cut into rows of at most
``BAND`` turns; the key of a depth hashes the band's start key and the turns up
to it, and the start keys are the keys of the sequence of whole bands, by
recursion.  So a conversation of any length is never one row or one task.
Keys are the first 16 bytes of SHA-256; two nodes collide with probability
2**-128.

The list of members that end at a node is hashed in chunks: ids are numbered
by a range sort on (node, id), a chunk of ``CHUNK`` ids is one string, and a
node with several chunks streams through them in order, one chunk held.

Defined cases: turns are ordered by (turn, role, text digest), a null turn
first; a null role or text is empty; rows without a conversation id belong to
no conversation; an empty table has no node, not even a root; other columns
are ignored, whatever their names; repeated rows are turns of their own.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .sharding import row_numbers

BAND, CHUNK, HEADS, GROUP = 8, 4096, 6, 100


def _digest(*parts: Column) -> Column:
    """16 bytes of SHA-256 of binary columns."""
    return F.substring(F.unhex(F.sha2(F.concat(*parts), 256)), 1, 16)


def ROOT() -> Column:
    return F.unhex(F.lit("00" * 16))


def turns_of(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, pos, turn digest, chars): every turn with its place from 1."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    sized = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role)
    d = rows.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("at"), role.alias("role"),
        _digest(F.encode(sized, "UTF-8"), F.encode(text, "UTF-8")).alias("turn"), F.char_length(text).cast("long").alias("chars"))
    numbered, _ = row_numbers(d, ["conv", "at", "role", "turn"])
    first = numbered.groupBy("conv").agg(F.min("row_number").alias("first"))
    return numbered.join(first, "conv").select("conv", (F.col("row_number") - F.col("first") + 1).alias("pos"), "turn", "chars")


def rebuilt(turns: DataFrame, group: int = GROUP, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """((conv, pos, turn, chars), (conv, n)) of the rebuilt conversations: the
    first h turns of conversation c - c % ``group``, then c's own after its
    first h; h is crc32 of c's decimal text, modulo ``heads``.  Only these
    heads, fewer than ``heads`` rows for each, meet other conversations."""
    h = F.crc32(F.col("conv").cast("string")) % F.lit(heads)
    convs = turns.groupBy("conv").agg(F.count("*").alias("turns")).withColumn("h", h)
    convs = convs.withColumn("base", F.col("conv") - F.col("conv") % F.lit(group))
    base = turns.where((F.col("pos") < heads) & (F.col("conv") % F.lit(group) == 0))
    base = base.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("pos", "turn", "chars"))).alias("head")).withColumnRenamed("conv", "base")
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h").cast("int")), F.array().cast("array<struct<pos:bigint,turn:binary,chars:bigint>>"))
    convs = written(convs.join(base, "base", "left").select("conv", "turns", "h", head.alias("head")), "conversations")
    taken = F.size("head").cast("long")
    size = taken + F.greatest(F.col("turns") - F.col("h"), F.lit(0))
    borrowed = convs.select("conv", F.explode("head").alias("t")).select("conv", "t.pos", "t.turn", "t.chars")
    own = turns.join(convs.select("conv", "h", taken.alias("taken")), "conv").where(F.col("pos") > F.col("h"))
    own = own.select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "turn", "chars")
    return borrowed.unionByName(own), convs.select("conv", size.alias("n"))


# --- keys --------------------------------------------------------------------

def banded(items: DataFrame, band: int, extra: list[str]) -> DataFrame:
    """(conv, band, items): rows of at most ``band`` consecutive items (from 0: ``at``), in order."""
    cut = items.withColumn("band", F.call_function("div", F.col("at"), F.lit(band).cast("long")))
    return cut.groupBy("conv", "band").agg(F.sort_array(F.collect_list(F.struct("at", "item", *extra))).alias("items"))


def _keys(start: str, items: str) -> Column:
    """Keys of all prefixes of a band: of its start key and the items so far."""
    def upto(i):
        run = F.aggregate(F.slice(items, F.lit(1), i), F.unhex(F.lit("")), lambda so_far, x: F.concat(so_far, x["item"]))
        return _digest(F.col(start), run)
    return F.transform(F.sequence(F.lit(1), F.size(items)), upto)


def paths(items: DataFrame, longest: int, band: int = BAND, level: int = 0) -> list[DataFrame]:
    """Stored path rows by level, the turns' own first: (conv, band, start,
    keys, items).  ``items`` is (conv, at from 0, item[, chars], n), n the length
    of the sequence; ``longest`` the greatest n."""
    extra = [c for c in items.columns if c in ("chars",)]
    bands = banded(items.drop("n"), band, extra)
    if longest <= band:
        own = bands.withColumn("start", ROOT())
        return [written(own.withColumn("keys", _keys("start", "items")), f"paths-{level}")]
    bands = written(bands, f"bands-{level}")
    # bands are the items of the level above; a sequence without a whole band needs none
    above = bands.join(items.where(F.col("n") >= band).select("conv", "n").distinct(), "conv")
    whole = F.aggregate("items", F.unhex(F.lit("")), lambda so_far, x: F.concat(so_far, x["item"]))
    above = above.select("conv", F.col("band").alias("at"), _digest(whole).alias("item"),
                         F.ceil(F.col("n") / F.lit(band)).cast("long").alias("n"))
    upper = paths(above, -(-longest // band), band, level + 1)
    # each band's start is the key of the bands before it, its last key (if whole) that of itself too
    keyed = upper[0].select("conv", F.posexplode("items").alias("i", "x"), "start", "keys")
    keyed = keyed.select("conv", F.col("x.at").alias("band"),
                         F.when(F.col("i") == 0, F.col("start")).otherwise(F.get("keys", F.col("i") - 1)).alias("begin"),
                         F.get("keys", F.col("i")).alias("finish"))
    own = bands.join(keyed, ["conv", "band"], "left").withColumn("start", F.coalesce("begin", ROOT()))
    keys = _keys("start", "items")
    whole = F.col("finish").isNotNull() & (F.size("items") == band)
    keys = F.when(whole, F.concat(F.slice(keys, 1, band - 1), F.array("finish"))).otherwise(keys)
    return [written(own.withColumn("keys", keys).drop("begin", "finish"), f"paths-{level}")] + upper


# --- totals ------------------------------------------------------------------

def rolled_up(nodes: list[DataFrame], values: DataFrame, root: dict[str, int], names: list[str]) -> tuple[DataFrame, dict[str, int]]:
    """(totals over the subtree of every node, totals of the root).  ``nodes``
    are (key, start, above) by level, ``above`` the ancestors inside the band;
    ``values`` are (key, *names) of the nodes of the first level, ``root`` the
    root's own values."""
    own = nodes[0].join(values, "key")
    if len(nodes) == 1:
        below = None
        rest = own.agg(*[F.sum(n).alias(n) for n in names]).first()
        top = {n: root[n] + int(rest[n] or 0) for n in names}
    else:
        # totals of whole bands at the node they hang from, rolled up as a trie of their own
        hung = written(own.groupBy(F.col("start").alias("key")).agg(*[F.sum(n).alias(n) for n in names]), "hung")
        at_root = hung.where(F.col("key") == ROOT()).first()
        base = {n: root[n] + int(at_root[n] if at_root else 0) for n in names}
        below, top = rolled_up(nodes[1:], hung.where(F.col("key") != ROOT()), base, names)
    if below is not None:
        more = below.select("key", *[F.col(n).alias(f"more_{n}") for n in names])
        own = own.join(more, "key", "left").select(
            "key", "above", *[(F.col(n) + F.coalesce(f"more_{n}", F.lit(0))).alias(n) for n in names])
    spread = own.select(F.explode(F.concat("above", F.array("key"))).alias("key"), *names)
    return written(spread.groupBy("key").agg(*[F.sum(n).alias(n) for n in names]), "totals"), top


def _nodes(rows: DataFrame) -> DataFrame:
    """(key, start, above) of the distinct nodes of a level."""
    step = rows.select("start", F.posexplode("keys").alias("i", "key"), "keys")
    return step.groupBy("key").agg(F.first("start").alias("start"), F.first(F.slice("keys", F.lit(1), F.col("i"))).alias("above"))


def ends_hashed(ends: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(key, ends_sha256) for (key, conv): SHA-256 of each key's ids in order, comma-joined."""
    numbered, _ = row_numbers(ends.select("key", "conv"), ["key", "conv"])
    first = numbered.groupBy("key").agg(F.min("row_number").alias("first"), F.count("*").alias("ids"))
    part = F.call_function("div", F.col("row_number") - F.col("first"), F.lit(chunk).cast("long"))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    parts = numbered.join(first, "key").groupBy("key", part.alias("part")).agg(ids.alias("ids"), F.max("ids").alias("n"))
    parts = written(parts, "ends")
    single = parts.where(F.col("n") <= chunk).select("key", F.sha2("ids", 256).alias("ends_sha256"))
    several = parts.where(F.col("n") > chunk).select("key", "part", "ids").repartition("key").sortWithinPartitions("key", "part")

    def stream(batches):
        key, state = None, None
        for b in batches:
            done = []
            for k, part, text in zip(*(c.to_pylist() for c in b.columns)):
                if k != key:
                    if key is not None:
                        done.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256()
                state.update((b"," if part else b"") + text.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([h for _, h in done], pa.string())],
                                                 names=["key", "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["key", "ends_sha256"])
    return single.unionByName(several.mapInArrow(stream, single.schema))


def trie(sequences: DataFrame, lengths: DataFrame, band: int = BAND, chunk: int = CHUNK) -> DataFrame:
    """Nodes of the trie of ``sequences`` (conv, pos from 1, turn, chars), whose
    lengths, zeros included, are ``lengths`` (conv, n)."""
    lengths = written(lengths, "lengths")
    spark = lengths.sparkSession
    whole = lengths.agg(F.count("*").alias("n"), F.min("conv").alias("first"), F.max("n").alias("longest")).first()
    columns = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
               "saved_tokens long, ends_sha256 string")
    if not whole["n"]:
        return spark.createDataFrame([], columns)
    items = sequences.join(lengths, "conv").select("conv", (F.col("pos") - 1).alias("at"), F.col("turn").alias("item"), "chars", "n")
    levels = paths(items, max(whole["longest"], 1), band)
    step = levels[0].select("conv", "band", "start", "keys", F.posexplode("items").alias("i", "x"))
    parent = F.when(F.col("i") == 0, F.col("start")).otherwise(F.get("keys", F.col("i") - 1))
    step = step.select(F.get("keys", F.col("i")).alias("key"), parent.alias("parent"), "start", F.slice("keys", F.lit(1), F.col("i")).alias("above"),
                       (F.col("x.at") + 1).alias("depth"), F.col("x.chars").alias("chars"), "conv")
    nodes = step.groupBy("key").agg(*[F.first(c).alias(c) for c in ("parent", "start", "above", "depth", "chars")],
                                    F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"))
    nodes = written(nodes, "nodes")
    children = written(nodes.groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children")), "children")
    full = written(nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "nodes")
    of_root = children.where(F.col("key") == ROOT()).first()
    root_children = of_root["n_children"] if of_root else 0
    values = full.select("key", (F.col("n_children") == 0).cast("long").alias("n_leaves"),
                         ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
    names = ["n_leaves", "saved_tokens"]
    by_level = [full.select("key", "start", "above")] + [_nodes(rows) for rows in levels[1:]]
    totals, top = rolled_up(by_level, values, {"n_leaves": int(root_children == 0), "saved_tokens": 0}, names)

    last = levels[0].join(lengths, "conv").where(F.col("band") == F.call_function("div", F.col("n") - 1, F.lit(band).cast("long")))
    ends = last.select(F.element_at("keys", -1).alias("key"), "conv")
    ends = ends.unionByName(lengths.where(F.col("n") == 0).select(ROOT().alias("key"), "conv"))
    hashes = written(ends_hashed(ends, chunk), "hashes")

    nothing = F.sha2(F.lit(""), 256)
    up = full.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = full.join(totals, "key").join(hashes, "key", "left").join(up, "parent", "left")
    out = out.select("conv_id", "depth", F.coalesce("parent_conv_id", F.lit(whole["first"])).alias("parent_conv_id"), "n_convs", "n_children",
                     *names, F.coalesce("ends_sha256", nothing).alias("ends_sha256"))
    root = spark.createDataFrame([(whole["first"], 0, None, whole["n"], root_children, top["n_leaves"], top["saved_tokens"])],
                                 columns.rsplit(",", 1)[0]).withColumn("key", ROOT())
    root = root.join(hashes, "key", "left").drop("key").withColumn("ends_sha256", F.coalesce("ends_sha256", nothing))
    return out.unionByName(root)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each rebuilt on the head of its hundred's first."""
    return trie(*rebuilt(turns_of(table(spark, sf_dir, "conversations"))))
