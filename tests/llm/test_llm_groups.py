"""Operators on pairs and groups, and the pipeline."""

import os
import random
import re
import subprocess
import sys
import unicodedata
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from blockflow.llm import components, decontaminate, embeddings, line_dedup, packing, quality, simhash
from blockflow.llm.common import table

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    """rows: (doc_id, text[, source])."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, DOC)


def roots(n, pairs):
    par = list(range(n))

    def find(x):
        while par[x] != x:
            par[x] = par[par[x]]
            x = par[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        par[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


# --- line dedup ------------------------------------------------------------------

def brute_lines(rows, ratio, least):
    pages, seen = {}, {}
    for _, text, host in rows:
        pages[host] = pages.get(host, 0) + 1
        for line in {x.strip(" ") for x in (text or "").split("\n")} - {""} if text is not None else ():
            seen[host, line] = seen.get((host, line), 0) + 1
    drop = {k for k, n in seen.items() if n >= least and n > ratio * pages[k[0]]}
    return [(i, None if t is None else "\n".join(x for x in t.split("\n") if (h, x.strip(" ")) not in drop), h) for i, t, h in rows]


@pytest.mark.parametrize("limit", [200_000, 0])
def test_line_dedup_against_brute_force(spark, limit):
    rng = random.Random(2)
    pool = ["menu", "  menu ", "about us", "", " ", "x", "ünï", "rare 1", "rare 2"]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randrange(0, 8))) + f"\nown {i}", rng.choice(["a", "a", "a", "b", None])) for i in range(120)]
    rows += [(500, None, "a"), (501, "", "a"), (502, "", None), (500, "menu\nmenu", "a"), (500, "menu\nmenu", "a")]
    d = docs_of(spark, rows).withColumn("host", F.lit("clash")).withColumn("hash", F.lit(1)).withColumn("__host", F.lit(2))
    out = line_dedup.drop_boilerplate(d, ratio=0.3, broadcast_rows=limit, salts=4)
    assert out.columns == d.columns
    got = sorted((r["doc_id"], str(r["text"]), str(r["source"])) for r in out.collect())
    assert got == sorted((i, str(t), str(h)) for i, t, h in brute_lines(rows, 0.3, line_dedup.LEAST_PAGES))
    assert line_dedup.drop_boilerplate(d.limit(0), broadcast_rows=limit).count() == 0


def test_line_dedup_main_path_is_native(spark):
    for limit in (200_000, 0):
        d = line_dedup.drop_boilerplate(table(spark, SF, "documents"), ratio=0.01, broadcast_rows=limit)
        plan = d._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "NestedLoop", "Cartesian"))


def test_line_dedup_oracle(spark):
    import duckdb
    con = duckdb.connect()
    for sf in (SF, "/root/testdata/sf0.01"):
        con.execute(f"create or replace view documents as select * from '{sf}/documents.parquet'")
        want = sorted(con.execute(f"select doc_id, text, n_lines, n_dropped from ({line_dedup.OP3_SQL})").fetchall())
        got = sorted(tuple(r) for r in line_dedup.op3_line_dedup(spark, sf).collect())
        assert got == want
    assert sum(r[3] for r in got) > 0


def test_line_dedup_production_ratio_takes_lines_of_a_few_pages(spark):
    # of a host's 400 pages: 4% hold one line, 2% another, and five hold one that a host of 600 pages leaves
    rows = [(i, f"own {i}" + "\nmenu" * (i < 16) + "\nabout us" * (i < 8) + "\nby chance" * (i < 4), "a") for i in range(400)]
    rows += [(1000 + i, f"own {i}" + "\nfew" * (i < 5), "b") for i in range(600)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_boilerplate(docs_of(spark, rows)).collect()}
    assert all(got[i] == f"own {i}" + "\nby chance" * (i < 4) for i in range(400))
    assert all(got[1000 + i] == f"own {i}" + "\nfew" * (i < 5) for i in range(600))


# --- components --------------------------------------------------------------------

def test_components_against_union_find(spark):
    rng = random.Random(4)
    for n, m in ((40, 30), (200, 120), (300, 299)):
        pairs = [(i, i + 1) for i in range(n - 1)] if m == n - 1 else [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        df = spark.createDataFrame(pairs + pairs[:3], "a long, b long")
        got = {r["node"]: r["root"] for r in components.connected_components(df).collect()}
        want = roots(n, pairs)
        touched = {x for a, b in pairs if a != b for x in (a, b)}
        assert got == {i: want[i] for i in touched}
    odd = spark.createDataFrame([(1, None), (None, 2), (5, 5)], "a long, b long")
    assert components.connected_components(odd).count() == 0


# --- simhash -----------------------------------------------------------------------

def brute_print(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [None, "", " \t\n", "a", "A b", "a b c d", "a b c d e f a b c d", "Ünï CODE\x0bx\x85y z",
                                  "same " * 500, "w " + " ".join(map(str, range(70000)))])
def test_fingerprint_against_brute_force(text):
    assert simhash.fingerprint(text) == brute_print(text)


def test_masks_leave_no_pair_apart():
    rng = random.Random(1)
    for blocks, many in ((5, 5), (6, 15), (7, 35)):
        masks = simhash.block_masks(4, blocks)
        assert len(masks) == many
        for _ in range(2000):
            flips = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(flips & m == 0 for m in masks)
    assert [simhash.blocks_for(n) for n in (0, 1000, 1 << 21, 1 << 22, 1 << 30, 1 << 33)] == [5, 5, 5, 6, 6, 7]


def test_gray_index_against_all_pairs():
    rng = np.random.default_rng(3)
    for n in (1, 7, 9, 65, 600):
        base = rng.integers(0, 1 << 63, size=max(1, n // 6), dtype=np.uint64)
        words = base[rng.integers(0, len(base), n)]
        for _ in range(4):
            words = words ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
        words = np.unique(words)
        words = words[np.argsort(simhash.gray_rank(words))]
        index = simhash.GrayIndex(words)
        near = np.triu(np.bitwise_count(words[:, None] ^ words[None, :]) <= 4, 1)
        for batch in (1 << 15, 50):
            got = [p for q, w in index.within(4, batch) for p in zip(q.tolist(), w.tolist())]
            assert sorted(got) == sorted(map(tuple, np.argwhere(near).tolist()))
        assert n < 600 or index.pruned > 0
        assert simhash.linked(words, np.array([0]), 4).tolist() == roots(len(words), np.argwhere(near).tolist())
    x = np.arange(64, dtype=np.uint64)
    assert simhash.gray_rank(x ^ (x >> np.uint64(1))).tolist() == x.tolist()


def test_gray_index_over_many_groups():
    rng = np.random.default_rng(5)
    groups = []
    for n in [1, 2, 8, 9, 64, 65, 300, 1, 1, 30]:
        words = np.unique(rng.integers(0, 1 << 10, n, dtype=np.uint64) | rng.integers(0, 1 << 63, dtype=np.uint64) << np.uint64(1))
        groups.append(words[np.argsort(simhash.gray_rank(words))])
    words, starts = np.concatenate(groups), np.cumsum([0, *map(len, groups[:-1])])
    want = [(a + i, a + j) for a, g in zip(starts, groups) for i, j in np.argwhere(np.triu(np.bitwise_count(g[:, None] ^ g[None, :]) <= 4, 1)).tolist()]
    got = [p for q, w in simhash.GrayIndex(words, starts).within(4) for p in zip(q.tolist(), w.tolist())]
    assert sorted(got) == sorted(want)
    assert simhash.linked(words, starts, 4).tolist() == roots(len(words), want)


def test_the_hierarchy_prunes_on_the_driver_table(spark):
    # the top nodes of the first mask, as a task of the query meets them
    fp = np.unique(np.array([r["fp"] for r in simhash.fingerprints(table(spark, "/root/testdata/sf0.1", "documents")).collect()]).astype(np.int64)).view(np.uint64)
    assert simhash.blocks_for(len(fp)) == 5
    mask = np.uint64(simhash.block_masks(4, 5)[0])
    words = fp[np.lexsort((simhash.gray_rank(fp), fp & mask))]
    starts = np.flatnonzero(np.r_[True, (words[1:] ^ words[:-1]) & mask != 0])
    index = simhash.GrayIndex(words, starts)
    got = {p for q, w in index.within(4) for p in zip(q.tolist(), w.tolist())}
    assert len(index.levels) > 1 and index.pruned > 0
    size = np.diff(np.append(starts, len(words)))
    for a, n in zip(starts.tolist(), size.tolist()):
        g = words[a:a + n]
        assert {(a + i, a + j) for i, j in np.argwhere(np.triu(np.bitwise_count(g[:, None] ^ g[None, :]) <= 4, 1)).tolist()} <= got


@pytest.mark.parametrize("blocks", [None, 6])
@pytest.mark.parametrize("tile", [4096, 3])
def test_links_connect_what_all_pairs_connect(spark, tile, blocks):
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(40)]
    words = {0, (1 << 64) - 1} | set(base)
    for _ in range(300):
        w = rng.choice(base)
        for b in rng.sample(range(64), rng.randrange(1, 5)):
            w ^= 1 << b
        words.add(w)
    words = sorted(words)
    signed = [w - (1 << 64) if w >> 63 else w for w in words]
    df = spark.createDataFrame([(w,) for w in signed], "fp long")
    got = simhash.links(df, blocks=blocks, tile=tile).collect()
    at = {w: i for i, w in enumerate(signed)}
    arr = np.array(words, dtype=np.uint64)
    want = [(i, j) for i, j in np.argwhere(np.bitwise_count(arr[:, None] ^ arr[None, :]) <= 4).tolist() if i < j]
    assert roots(len(words), [(at[r["a"]], at[r["b"]]) for r in got]) == roots(len(words), want)
    assert all(len({(r["a"], r["b"]) for r in got}) <= 15 * len(words) * (1 if tile > 3 else 400) for _ in (0,))


def brute_components(rows):
    fp = [brute_print(t) for _, t in rows]
    comp = roots(len(rows), [(i, j) for i, j in combinations(range(len(rows)), 2) if (fp[i] ^ fp[j]).bit_count() <= 4])
    low = {}
    for c, (i, _) in zip(comp, rows):
        if i is not None:
            low[c] = min(low.get(c, i), i)
    return fp, comp, [low.get(c) for c in comp]


def test_simhash_query_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    fp, _, low = brute_components(rows)
    got = simhash.op5_simhash_dedup(spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted((i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fp, low))


def test_simhash_defined_cases_and_keep_one(spark):
    long = " ".join(f"w{i}" for i in range(400))
    near = long.replace("w200 ", "x200 ")
    rows = [(5, None), (3, ""), (9, "  "), (1, long), (2, near), (4, long), (4, long), (None, long), (7, "alone text here"),
            (7, "alone text here"), (8, "other one"), (None, "no id"), (None, "no id"), (6, "dup id"), (6, long + " tail")]
    assert (brute_print(long) ^ brute_print(near)).bit_count() <= 4
    fp, comp, low = brute_components(rows)
    d = docs_of(spark, rows).withColumn("fp", F.lit("clash")).withColumn("root", F.lit(1)).withColumn("component_id", F.lit(2)).withColumn("rows", F.lit(3))
    got = simhash.near_duplicates(d).collect()
    assert sorted((r["doc_id"] or -1, r["fp"], r["component_id"] or -1) for r in got) == sorted(
        (i or -1, f - (1 << 64) if f >> 63 else f, c or -1) for (i, _), f, c in zip(rows, fp, low))
    kept = simhash.keep_one(d)
    assert kept.columns == d.columns
    kept = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len(kept) == len(set(comp)) and all(k in rows for k in kept)
    assert sorted(i or -1 for i, _ in kept) == sorted({c: l or -1 for c, l in zip(comp, low)}.values())
    assert simhash.keep_one(d.limit(0)).count() == 0 and simhash.near_duplicates(d.limit(0)).count() == 0


# --- embeddings ----------------------------------------------------------------------

def brute_vectors(rows, cosine):
    ok = []
    for _, v, label in rows:
        good = v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)
        ok.append(np.array(v, float) / np.linalg.norm(np.array(v, float)) if good else None)
    links = [(i, j) for i, j in combinations(range(len(rows)), 2) if ok[i] is not None and ok[j] is not None
             and rows[i][2] == rows[j][2] and len(ok[i]) == len(ok[j]) and float(ok[i] @ ok[j]) >= cosine]
    n = [sum(i in p for p in links) for i in range(len(rows))]
    comp, low = roots(len(rows), links), {}
    for c, r in zip(comp, rows):
        if r[0] is not None:
            low[c] = min(low.get(c, r[0]), r[0])
    return n, [low.get(c) for c in comp]


def made_vectors(seed, n, d=8):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 5, d))
    rows = []
    for i in range(n):
        v = base[rng.integers(len(base))] + rng.normal(size=d) * rng.choice([0.0, 0.1, 0.4])
        rows.append((1000 - i, [float(x) for x in np.float32(v)], int(rng.integers(2))))
    return rows


@pytest.mark.parametrize("tile", [4096, 4])
def test_embeddings_against_all_pairs(spark, tile):
    odd = [(2000, None, 1), (2001, [0.0] * 8, 1), (2002, [float("nan")] * 8, 1), (2003, [1.0] * 8, None), (2004, [1.0] * 3, 1),
           (2005, [2.0] * 3, 1), (2006, [1.0, None] * 4, 1), (2007, [], 1), (2008, [float("inf")] + [1.0] * 7, 0), (2009, [1e-30] * 8, 0),
           (2010, [1e30] * 8, 0), (None, [1.0] * 8, 0), (2011, [1.0] * 8, 0), (2011, [1.0] * 8, 0)]
    rows = made_vectors(1, 200) + odd
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("uid", F.lit("clash")).withColumn("cell", F.lit(1))
    # every cell probed: the comparison must be complete
    got = embeddings.near_duplicates(df, probes=64, per_cell=20, tile=tile)
    n, low = brute_vectors(rows, 0.93)
    assert sorted((r["vec_id"] or -1, r["n_links"], r["component_id"] or -1) for r in got.collect()) == sorted(
        (r[0] or -1, k, c or -1) for r, k, c in zip(rows, n, low))
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in got.collect())
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_embedding_recall_with_production_probes(spark):
    rows = made_vectors(7, 1500, 32)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    x = embeddings.unit([r[1] for r in rows])
    lab = np.array([r[2] for r in rows])
    near = (x @ x.T >= 0.93) & (lab[:, None] == lab[None, :])
    want = int(near.sum()) - len(rows)
    got = embeddings.near_duplicates(df, per_cell=16).agg(F.sum("n_links")).first()[0]
    assert want > 500 and 0.9 * want <= got <= want


@pytest.mark.parametrize("tile", [64, 16])
def test_embedding_cells_on_several_levels(spark, tile):
    rows = made_vectors(7, 1500, 12)
    odd = [(5000 + i, [1.0, 2.0, 3.0] if i % 2 else [1.0, 2.0, 3.0 + i], 1) for i in range(100)]          # of another length
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")
    got = embeddings.near_duplicates(df, sample=256, per_cell=12, tile=tile, cell_sample=128)
    n, low = brute_vectors(rows + odd, 0.93)
    links = {r[0]: k for r, k in zip(rows + odd, n)}
    found = {r["vec_id"]: r["n_links"] for r in got.collect()}
    assert found.keys() == links.keys() and all(found[i] <= links[i] for i in links)             # none below the bound, none counted twice
    assert sum(found.values()) >= 0.97 * sum(links.values()) and sum(links.values()) > 1000


def test_no_leaf_grows_with_the_number_of_vectors(spark):
    def largest(n):
        rng = np.random.default_rng(n)
        v = rng.normal(size=(n, 6)).astype(np.float32)
        entries = spark.createDataFrame([(i, 1, i % 2, [float(x) for x in r]) for i, r in enumerate(v)], "uid long, copies long, label int, vector array<float>")
        centres = embeddings.centres_of(entries, n, sample=256, per_cell=16)
        assert len(centres) <= 32
        cells = embeddings.leaves(entries, centres, probes=3, per_cell=16, tile=96, cell_sample=256, sub_probes=2)
        counts = cells.groupBy("label", "size", "cell").count()
        depth = cells.select(F.max(F.size(F.split("cell", "/")))).first()[0]
        copies = cells.groupBy("uid").count().agg(F.max("count")).first()[0]
        return counts.agg(F.max("count")).first()[0], depth, copies
    small, large = largest(1000), largest(16000)
    assert large[1] > small[1] and large[0] <= max(96, 1.2 * small[0])
    assert large[2] <= 3 * 2 ** 3


def test_embedding_query_links_none_below_the_bound(spark):
    rows = [tuple(r) for r in table(spark, SF, "embeddings").select("vec_id", "embedding", "label").collect()]
    n, low = brute_vectors(rows, 0.93)
    got = embeddings.op8_embedding_dedup(spark, SF).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == sorted((r[0], k, c) for r, k, c in zip(rows, n, low))
    one = embeddings.representatives(table(spark, SF, "embeddings"))
    assert one.count() == sum(r["kept"] for r in got)


# --- decontamination --------------------------------------------------------------------

def brute_align(want, piece):
    """Fewest edits of ``want`` against any stretch of ``piece``."""
    row = [0] * (len(piece) + 1)
    for i, w in enumerate(want, 1):
        nxt = [i]
        for j, p in enumerate(piece, 1):
            nxt.append(min(row[j - 1] + (w != p), row[j] + 1, nxt[-1] + 1))
        row = nxt
    return min(row)


def edited(rng, text, n):
    s = list(text)
    for _ in range(n):
        p, r = rng.randrange(len(s)), rng.random()
        if r < .34:
            s[p] = rng.choice("abcxyz")
        elif r < .67:
            del s[p]
        else:
            s.insert(p, rng.choice("abcxyz"))
    return "".join(s)


def test_alignment_against_brute_force():
    rng = random.Random(6)
    for _ in range(300):
        want = "".join(rng.choices("abcd", k=rng.randrange(8, 40)))
        piece = "".join(rng.choices("abcd", k=rng.randrange(0, 20))) + edited(rng, want, rng.randrange(0, 6)) + "".join(rng.choices("abcd", k=rng.randrange(0, 20)))
        k, best = rng.randrange(0, 7), brute_align(want, piece)
        got = decontaminate.align(want, piece, k)
        assert (got is None) == (best > k)
        if got:
            d, x, y = got
            assert d == best and 0 <= x < y <= len(piece) and brute_align(want, piece[x:y]) == d


def test_bound_is_the_lemma():
    for m in (8, 20, 40, 95, 96, 400):
        k, bound = decontaminate.budget(m)
        assert bound >= 1 and bound == m + 1 - 8 * (k + 1) and (m < 80 or k == m // 10)


def test_windows_with_few_edits_are_found_and_clean_texts_left():
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 9))) for _ in range(300)]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(12, 60)))) for i in range(40)]
    index = decontaminate.Index(items)
    texts, truth = [], []
    for i, (_, t) in enumerate(items):
        start, end = " ".join(rng.choices(words, k=rng.randrange(0, 300))), " ".join(rng.choices(words, k=50))
        k = rng.choice([0, 0, 2, 5, 9])
        whole = edited(rng, t[:96], min(k, decontaminate.budget(min(96, len(t)))[0]))
        texts.append(f"{start}\n{whole.upper()}  {end}")
        truth.append(i)
    texts += [" ".join(rng.choices(words, k=400)) for _ in range(20)] + [None, "", "short"]
    hits = {}
    for d, t, dist, x, y in index.regions(texts):
        hits.setdefault(d, set()).add(items[t][0])
        piece, (m, k, windows) = re.sub(" +", " ", decontaminate._plain(texts[d][x:y])), brute_windows(items[t][1])
        assert dist <= k and min(brute_align(w, piece) for w in windows) <= dist
    assert all(i in hits.get(n, set()) for n, i in enumerate(truth))
    assert not [d for d in hits if d >= len(truth)]


def brute_reading(text):
    """Letters, digits and marks in lower case, one blank for each run of others."""
    low = ((c.lower() if len(c.lower()) == 1 else c) if unicodedata.category(c)[0] in "LMN" else " " for c in text)
    return re.sub(" +", " ", "".join(low)).strip(" ")


def brute_windows(text, window=96):
    text = brute_reading(text or "")
    m = min(len(text), window)
    if m < 8:
        return m, 0, []
    starts = sorted({*range(0, len(text) - m + 1, max(1, m // 4)), len(text) - m})
    return m, max(0, min(int(0.1 * m), m // 8 - 1)), [text[s:s + m] for s in starts]


def brute_contaminated(texts, items):
    """{(text number, item number)}: some window of the item ends somewhere in the text within its edits."""
    gap = 12                                               # more than any budget
    whole, ends = [], []
    for t in texts:
        whole += [ord(c) for c in brute_reading(t or "")] + [0x110000] * gap
        ends.append(len(whole))
    code = np.array(whole, dtype=np.int32)
    idx, found = np.arange(len(code) + 1, dtype=np.int32), set()
    for n, (_, text) in enumerate(items):
        m, k, windows = brute_windows(text)
        for w in windows:
            cost = np.zeros(len(code) + 1, dtype=np.int32)
            for c in w:
                nxt = np.minimum(cost[:-1] + (code != ord(c)), cost[1:] + 1)
                cost = np.minimum.accumulate(np.concatenate([[cost[0] + 1], nxt]) - idx) + idx
            found |= {(int(np.searchsorted(ends, j, "left")), n) for j in np.flatnonzero(cost <= k) if j}
    return found


def test_filter_against_all_windows_at_all_places():
    rng = random.Random(12)
    words = ["the", "of", "and", "ab", "ba", "river", "\u2019s", "na\u00efve", "a", "10"]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(3, 70)))) for i in range(14)] + [(90, "ha " * 60), (91, None), (92, "tiny")]
    texts = [" ".join(rng.choices(words, k=rng.randrange(0, 200))) for _ in range(25)]
    for _, t in items[:14] * 3:
        at = rng.randrange(0, max(1, len(t) - 60))
        texts.append("x " * rng.randrange(0, 40) + edited(rng, t[at:at + 130], rng.randrange(0, 12)) + " y" * 30)
    texts += ["ha " * 50, "haha " * 50, None, ""]
    want = brute_contaminated(texts, items)
    for part in (2048, 40):
        got = {(d, t) for d, t, *_ in decontaminate.Index(items, part=part).regions(texts)}
        assert got == want and len(want) > 15
    once = list(decontaminate.Index(items).regions(texts, once=True))
    assert len(once) == len({d for d, *_ in once}) and {d for d, *_ in once} == {d for d, _ in want}


BLANKS = [chr(c) for c in range(0x10000) if chr(c).isspace()] + ["\u200b", "\ufeff", " \u2014 ", "...", "\u3002", "\u00a0\u3000"]


def test_exact_copies_with_any_blank_are_found():
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklm", k=5)) for _ in range(16)]
    noise = " ".join("".join(rng.choices("nopqrstuvw", k=6)) for _ in range(60))
    for blank in BLANKS:
        item, plain = blank.join(words), " ".join(words)
        for a, b in ((item, f"{noise} {item} {noise}"), (item, f"{noise} {plain} {noise}"), (plain, f"{noise} {item} {noise}")):
            got = list(decontaminate.Index([(1, a)]).regions([b]))
            assert got and min(g[2] for g in got) == 0, repr(blank)
    curly = [(1, "the dog\u2019s owner didn\u2019t say \u201cwhat\u201d it\u2019s called, we\u2019re sure they\u2019ll tell us that he\u2019s gone")]
    got = list(decontaminate.Index(curly).regions([curly[0][1].replace("\u2019", "'").replace("\u201c", '"').replace("\u201d", '"')]))
    assert got and got[0][2] == 0


def test_periodic_texts_in_bounded_memory():
    # four million characters that repeat, against an item that repeats: in a process of its own, for its peak
    code = ("from blockflow.llm import decontaminate as D\n"
            "ix = D.Index([(1, 'ha' * 250)]); spans = []\n"
            "for d, t, dist, x, y in ix.regions(['ha' * 2_000_000]):\n"
            "    spans.append((x, y)); spans = D.joined(spans) if len(spans) > 256 else spans\n"
            "assert D.joined(spans) == [(0, 4_000_000)]\n"
            "print(next(int(x.split()[1]) // 1024 for x in open('/proc/self/status') if x.startswith('VmHWM')))")
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) < 500


def test_long_texts_are_read_over_every_edge():
    rng = random.Random(2)
    item = "".join(rng.choices("abcdefghij klmnop", k=150))
    index = decontaminate.Index([(1, item)])
    noise = "".join(rng.choices("qrstuvwxyz ", k=5_000_000))
    for at in (0, 4_194_200, 4_194_304, 4_999_000):
        text = noise[:at] + " " + item + " " + noise[at:]
        got = list(index.regions(["x", text, "y"]))
        assert got and {d for d, *_ in got} == {1}
    assert not list(index.regions([noise]))


def test_decontamination_query_finds_whole_items(spark):
    sf = "/root/testdata/sf0.01"
    read = lambda s: " " + " ".join(re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", s.lower())) + " "
    docs = {r["doc_id"]: read(r["text"] or "") for r in table(spark, sf, "documents").collect()}
    want = {(d, r["item_id"]) for r in table(spark, sf, "benchmark").collect() for d, t in docs.items() if read(r["text"]) in t}
    got = decontaminate.op10_decontaminate(spark, sf).collect()
    assert want and {(r["doc_id"], r["item_id"]) for r in got} == want
    clean = decontaminate.keep_clean(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    assert {r["doc_id"] for r in clean.collect()} == set(docs) - {d for d, _ in want}


def test_decontamination_blocks_and_defined_cases(spark):
    d, b = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    whole = sorted(map(tuple, decontaminate.matches(d, b).collect()))
    assert whole == sorted(map(tuple, decontaminate.matches(d, b, block_chars=1500).collect()))
    odd = docs_of(spark, [(1, None), (2, ""), (None, "x " + b.first()["text"] + " y"), (3, "tiny"), (3, "tiny")]).withColumn("item_id", F.lit("clash"))
    got = decontaminate.matches(odd, b.unionByName(spark.createDataFrame([(None, "tiny"), (77, None), (78, "")], b.schema)))
    assert [r["doc_id"] for r in got.collect()] == [None]
    kept = decontaminate.keep_clean(odd, b)
    assert kept.columns == odd.columns and kept.count() == 4
    assert decontaminate.matches(odd, b.limit(0)).count() == 0 and decontaminate.matches(odd.limit(0), b).count() == 0
    assert decontaminate.keep_clean(odd, b.limit(0)).count() == 5


# --- pipeline ------------------------------------------------------------------------------

def test_pipeline_against_brute_force(spark):
    import corpus_pipeline as P
    sf = "/root/testdata/sf0.001"
    assert [n for n, _ in P.STAGES] == ["quality classifier", "line dedup", "simhash near-dedup", "benchmark decontamination", "packing"]
    docs = table(spark, sf, "documents")
    names = docs.columns
    # stage by stage, each on all its predecessor kept
    scores = {r["doc_id"]: r["predicted"] for r in quality.op7_quality_qda(spark, sf).collect()}
    one = P.quality_stage(spark, docs, sf)
    assert one.columns == names and sorted(r["doc_id"] for r in one.collect()) == sorted(i for i, p in scores.items() if p)
    two = P.line_stage(spark, one, sf)
    rows = [(r["doc_id"], r["text"], r["source"]) for r in one.collect()]
    want = brute_lines(rows, line_dedup.RATIO, line_dedup.LEAST_PAGES)
    assert two.columns == names and sorted((r["doc_id"], r["text"], r["source"]) for r in two.collect()) == sorted(want)
    assert all(r["n_chars"] == len(r["text"]) for r in two.collect() if r["text"] is not None)
    three = P.near_dedup_stage(spark, two, sf)
    _, comp, low = brute_components([(i, t) for i, t, _ in want])
    assert three.columns == names and sorted(r["doc_id"] for r in three.collect()) == sorted(set(low))
    four = P.decontamination_stage(spark, three, sf)
    texts = {r["doc_id"]: r["text"] for r in three.collect()}
    hit = {list(texts)[d] for d, _ in brute_contaminated(list(texts.values()), [tuple(r) for r in table(spark, sf, "benchmark").collect()])}
    assert four.columns == names and {r["doc_id"] for r in four.collect()} == set(texts) - hit
    five = P.run(spark, sf).collect()
    assert {r["doc_id"] for r in five} == set(texts) - hit
    assert sum(r["length"] for r in five) == sum(len(packing.token_ids(t)) + 1 for i, t in texts.items() if i not in hit)
    ids = [(r["doc_id"], r["start"]) for r in five]
    assert len(ids) == len(set(ids))


@pytest.mark.parametrize("limit", [200_000, 0])
def test_pipeline_keeps_the_text_of_one_of_each_group_of_copies(spark, limit, monkeypatch):
    import corpus_pipeline as P
    monkeypatch.setattr(P.line_dedup.drop_boilerplate, "__defaults__",
                        tuple(limit if x == 200_000 else x for x in P.line_dedup.drop_boilerplate.__defaults__))
    word = random.Random(4)
    texts = [" ".join("".join(word.choices("abcdefgh", k=6)) for _ in range(40)) for _ in range(42)]
    rows = [(i, texts[i] + "\nmenu" * (i < 20), "a") for i in range(40)]
    rows += [(100 + i, texts[40] + "\nmenu\nlast words of it", "a") for i in range(30)]          # over any share of its host
    rows += [(200 + i, texts[41], h) for h in ("a", "b") for i in range(15)] + [(300 + i, None, "b") for i in range(9)]
    lines = P.line_stage(spark, docs_of(spark, rows), SF)
    got = sorted((r["doc_id"], r["text"] or "") for r in lines.collect())
    assert got == sorted((i, (t or "").replace("\nmenu", "")) for i, t, _ in rows)
    kept = {r["text"] or "" for r in P.near_dedup_stage(spark, lines, SF).collect()}
    assert kept == {*texts[:40], texts[40] + "\nlast words of it", texts[41], ""}


def test_pipeline_stages_on_odd_and_empty_documents(spark):
    import corpus_pipeline as P
    odd = docs_of(spark, [(None, None, None), (1, "", None), (1, "", None), (2, "plain words of a text.", "h")]).withColumn("score", F.lit("clash"))
    for rows in (odd, odd.limit(0)):
        docs = rows
        for name, stage in P.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == rows.columns, name
        assert P.STAGES[-1][1](spark, docs, SF).count() >= 0
