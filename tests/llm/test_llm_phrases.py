"""Phrases, prefix tries and piece codecs against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
import sentencepiece
from pyspark.sql import functions as F

import public_tokenizers
from blockflow.llm import collocations, piece_codec, prefix_trie
from blockflow.llm.piece_codec import Codec, _fields, _message

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


# --- collocations -------------------------------------------------------------

def brute_phrases(docs, least, longest=5, top=2000):
    f, n = {}, Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        c = f.setdefault(lang, Counter())
        for p in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", p)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    c[tuple(w[i:i + k])] += 1
    out = []
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) >= 2 and a >= least}
        inside = {p[i:i + k] for p, a in found.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= 100 * c[p[i:i + k]]}
        rows = []
        for p, a in found.items():
            if p not in inside:
                score, _, left, right = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), left, right))
        for i, (score, a, p, left, right) in enumerate(sorted(rows)[:top]):
            out.append((lang, i + 1, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def phrase_docs():
    rng = random.Random(3)
    words = ["the", "The", "a", "Cat", "sat", "on", "ß", "É", "x.y", "new", "york", "new\tyork", "  ", "\n", "!", "very", "　", "NEW"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 60))), rng.choice(["en", "en", "en", "de", None, "und", ""])) for i in range(150)]
    rows += [(900, None, "en"), (901, "", None), (902, "a " * 3000, "en"), (903, "he he he he", "de"), (904, "united states of america " * 50, "fr")]
    return rows + rows[:20]


@pytest.mark.parametrize("bits", [27, 4])
def test_collocations_against_brute_force(spark, bits):
    rows = phrase_docs()
    d = spark.createDataFrame([(i, t, g, "s", 0) for i, t, g in rows], DOC).withColumns({"h1": F.lit(1), "phrase": F.lit("clash")})
    got = collocations.collocations(d.repartition(5), least=4, top=40, bits=bits)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute_phrases([(g, t) for _, t, g in rows], 4, top=40)


def test_collocations_of_the_small_tables(spark):
    docs = [(r["lang"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in collocations.op11_collocations(spark, SF).collect())
    assert got == brute_phrases(docs, 100) and got


def test_collocations_of_nothing(spark):
    for rows in ([], [(1, None, "en", "s", 0)], [(1, "one two", None, None, None)]):
        assert collocations.collocations(spark.createDataFrame(rows, DOC)).collect() == []


def test_score_is_exact_beyond_64_bits(spark):
    a, n = 9_000_000_000, 9_000_000_000_000_000
    d = spark.createDataFrame([([a + 1, a], [a + 3, a], n), ([7, 7, 5], [5, 5, 5], 12)], "pre array<long>, suf array<long>, total long")
    got = [tuple(r["best"]) for r in d.select(collocations._score(F.col("total")).alias("best")).collect()]
    assert got[0] == (1000 * a * n // ((a + 1) * (a + 3)), 1, a + 1, a + 3)
    assert got[1] == (1000 * 5 * 12 // (7 * 5), 1, 7, 5)             # equal cuts: the first


def test_rare_groups_never_reach_the_exact_count(spark):
    rows = [(i, f"alpha beta w{i} alpha beta x{i}", "en", "s", 0) for i in range(40)]
    pieces = spark.createDataFrame(rows, DOC).select("lang", "text")
    groups, _ = collocations.frequent_words(pieces, 1)
    places = collocations.written(collocations.word_places(pieces, collocations.KeyFilter.of(groups)), "t")
    hot, many = collocations.hot_buckets(places, 40)
    assert many == 1 or places.count() > 1
    keys = [r["h1"] for r in collocations.frequent_phrases(places, groups, 1).select("h1", "phrase").collect()]
    passed = hot(np.array(keys, dtype=np.int64).view(np.uint64)).sum()
    assert len(keys) > 80 and passed == 1                          # "alpha beta"
    assert [r["phrase"] for r in collocations.frequent_phrases(places, groups, 40).collect()] == ["alpha beta"]


def test_blocks_are_stored_a_page_each_and_few_to_a_group(spark, monkeypatch):
    kept, conf = {}, spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")

    def spy(df, name, **options):
        out = written(df, name, **options)
        kept[name] = out.inputFiles()
        return out
    written = collocations.written
    monkeypatch.setattr(collocations, "written", spy)
    rows = [(i, "alpha beta gamma alpha beta gamma", f"l{i}", "s", 0) for i in range(12)]      # a language, a block
    found = collocations.candidates(spark.createDataFrame(rows, DOC).coalesce(1), least=2, longest=3)
    assert sorted(tuple(r) for r in found.select("lang", "phrase", "a").collect()) == sorted((f"l{i}", "alpha beta gamma", 2) for i in range(12))
    for name in ("places-1", "places-2"):
        files = [pq.ParquetFile(f.removeprefix("file:").replace("//", "/")).metadata for f in kept[name]]
        groups = [m.row_group(g) for m in files for g in range(m.num_row_groups)]
        assert sum(g.num_rows for g in groups) == 12 and max(g.num_rows for g in groups) <= 2
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == conf


@pytest.mark.parametrize("places,counts", [([], []), ([0], [1]), ([5, 6, 70000, 2**31], [1, 65535, 2, 3])])
def test_packed_counts(places, counts):
    a, n = collocations._unpacked(collocations._packed(np.array(places, dtype=np.int64), np.array(counts, dtype=np.int64)))
    assert a.tolist() == places and n.tolist() == counts


# --- prefix trie ----------------------------------------------------------------

def brute_trie(rows):
    def key(t):
        at, role, text = t
        raw = hashlib.sha256(f"{len(role.encode())}:{role}".encode() + text.encode()).digest()[:16]
        return at is not None, at or 0, role, raw
    convs, seqs, nodes, kids = {}, {}, {}, {}
    for c, at, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((at, role or "", text or ""))
    for c in convs:
        convs[c].sort(key=key)
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        seqs[c] = [t[1:] for t in convs.get(base, [])[:h]] + [t[1:] for t in turns[h:]]
    for c, s in sorted(seqs.items()):
        for d in range(len(s) + 1):
            nodes.setdefault(tuple(s[:d]), []).append(c)
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(nodes, key=len, reverse=True):
        below = kids.get(p, [])
        leaves[p] = sum(leaves[x] for x in below) or 1
        saved[p] = sum(saved[x] for x in below) + ((len(nodes[p]) - 1) * len(p[-1][1]) if p else 0)
    for p, m in nodes.items():
        ends = ",".join(str(c) for c in sorted(m) if len(seqs[c]) == len(p))
        out.append((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


CONV = "conv_id long, turn long, role string, text string"


def trie_of(spark, rows, **how):
    d = spark.createDataFrame(rows, CONV).withColumns({"key": F.lit("clash"), "pos": F.lit(0), "conv": F.lit(1)})
    got = prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.turns_of(d)), **how)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def conversations(seed, n, most, vocabulary):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample([*range(0, 60), *range(100, 160), *range(-140, -90), 10**12, 10**12 + 7], n):
        for t in range(rng.randrange(1, most)):
            rows.append((c, t, rng.choice(["user", "assistant"][:1 + t % 2]), rng.choice(vocabulary)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("band,chunk", [(2, 2), (3, 5), (8, 4096)])
def test_trie_against_brute_force(spark, band, chunk):
    rows = conversations(band, 120, 23, ["hi", "hi", "hi", "", "é😀"])
    rows += [(3, None, None, None), (3, None, "user", "first"), (None, 1, "user", "no conversation"), (70, 1, "u", "x"), (70, 1, "u", "x"), (70, 1, "a", "y")]
    assert trie_of(spark, rows, band=band, chunk=chunk) == brute_trie(rows)


def test_trie_with_very_unequal_lengths(spark):
    rows = [(c, t, "user", "same" if t != 40 else str(c % 3)) for c in (200, 201, 207, 213) for t in range(97)] + conversations(5, 30, 4, ["same", "b"])
    assert trie_of(spark, rows, band=3) == brute_trie(rows)


def test_trie_of_copies_is_hashed_in_chunks(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(1000, 1400) for t in range(7)]
    assert trie_of(spark, rows, band=4, chunk=64) == brute_trie(rows)


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    assert trie_of(spark, []) == []
    assert trie_of(spark, [(None, 1, "user", "x")]) == []
    # an id whose h covers all its own turns, and whose hundred has no first conversation
    c = next(c for c in range(501, 599) if zlib.crc32(str(c).encode()) % 6 == 5)
    got = trie_of(spark, [(c, 0, "user", "a")])
    assert got == brute_trie([(c, 0, "user", "a")]) and got[0][1] == 0 and got[0][3] == 1


def test_trie_of_the_small_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted((tuple(r) for r in prefix_trie.op12_prefix_trie(spark, SF).collect()), key=str)
    assert got == brute_trie(rows)


# --- piece codec ------------------------------------------------------------------

RAW = open(public_tokenizers.path(piece_codec.MODEL), "rb").read()


def variant(rule, prefix, squeeze):
    """The given model with another character map and other rules for blanks."""
    spec = next(v for n, v, _ in _fields(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()) if n == 3)
    body = b"".join(w for n, _, w in _fields(spec) if n in (1, 2)) + bytes([3 << 3, prefix, 4 << 3, squeeze])
    return b"".join(w for n, _, w in _fields(RAW) if n != 3) + _message(3, body)


def odd_texts(n=600):
    rng = random.Random(11)
    alphabet = "ab c  ﬁＡ①é́ \t\n　日ㇰ가ｶﾞ▁😀\x00㌔…½"
    return ["".join(rng.choices(alphabet, k=rng.randrange(0, 50))) for _ in range(n)] + ["", "   ", " a ", "▁", "  ▁ ", "<s> </s> <unk> <0x41>"]


@pytest.mark.parametrize("rule,prefix,squeeze", [(None, 1, 0), ("nmt_nfkc", 1, 1), ("nfkc_cf", 0, 1), ("nfkc_cf", 1, 1), ("nmt_nfkc_cf", 1, 0)])
def test_codec_equals_the_library(rule, prefix, squeeze):
    c = Codec(RAW if rule is None else variant(rule, prefix, squeeze))
    for text in odd_texts():
        ids, begin, end = c.encode(text, most=16)
        assert ids.tolist() == c.whole.encode(text), text
        want = [(p.begin, p.end) for p in c.whole.encode(text, return_type="proto").pieces]
        assert list(zip(begin.tolist(), end.tolist())) == want, text
        assert c.decode(ids) == c.whole.decode(ids.tolist())


def test_spans_cover_the_text():
    c = piece_codec.codec()
    for text in odd_texts(200):
        raw, (_, begin, end) = text.encode(), c.encode(text)
        assert b"".join(raw[a:z] for a, z in zip(begin, end)) == raw
        assert c.decode(c.encode(text)[0]) == text.replace("▁", " ")


def test_long_texts_are_cut_where_no_piece_crosses():
    c = piece_codec.codec()
    assert c.sliceable
    text = "word " * 3000 + "  " * 500 + "x" * 5000 + " end ▁▁ of" * 100
    ids = c.encode(text, most=64)[0]
    assert ids.tolist() == c.whole.encode(text)


def test_encoded_rows(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "two words", None), (3, "two words", "en"), (None, "é😀\n", "en"), (5, "a" * 20000, "en")]
    d = spark.createDataFrame(rows, "doc_id long, text string, ids string").withColumn("begins", F.lit(0))
    got = piece_codec.encoded(d, decode=True)
    assert got.columns == ["doc_id", "ids", "begins", "ends", "decoded"]
    c = piece_codec.codec()
    assert sorted(((r["doc_id"], r["ids"], r["decoded"]) for r in got.collect()), key=str) == \
        sorted(((i, c.whole.encode(t or ""), t or "") for i, t, _ in rows), key=str)
    back = piece_codec.decoded(got.select("doc_id", "ids"))
    assert sorted(((r["doc_id"], r["text"]) for r in back.collect()), key=str) == sorted(((i, t or "") for i, t, _ in rows), key=str)
    assert piece_codec.encoded(d.where("false")).collect() == []


def test_op13_on_the_small_tables(spark):
    whole = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(piece_codec.MODEL))
    want = []
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = whole.encode(r["text"] or "")
        want.append((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(whole.decode(ids).encode()).hexdigest()))
    assert sorted(tuple(r) for r in piece_codec.op13_sentencepiece(spark, SF).collect()) == sorted(want)
