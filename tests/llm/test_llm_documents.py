"""Single-pass operators: licenses, HTML, language, quality, packing, shards."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockflow.llm import html_extract, langid, licenses, packing, quality, sharding
from blockflow.llm.common import sliced, table

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, extra=""):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


# --- licenses ----------------------------------------------------------------

def test_license_base_places_against_brute_force(spark):
    rng = random.Random(3)
    bits = ["under the MIT license", "Apache License, Version 2.0", "CC-BY-NC", "foo", "under", "the", "ünder", "cc by", "MIT"]
    texts = [None, "", " ", "...", "CC BY NC by nc"] + [" ".join(rng.choices(bits, k=rng.randrange(1, 30))) for _ in range(60)]
    rows = {r["doc_id"]: r for r in licenses.license_scan(docs_of(spark, texts)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        hits = [(a, label) for label, p in licenses.BASE for a in range(len(w)) if w[a:a + len(p.split())] == p.split()]
        r = rows[i]
        assert (r["n_words"], r["n_base"]) == (len(w), len(hits))
        assert r["first_word"] == min((a for a, _ in hits), default=None)
        assert r["last_word"] == max((a for a, _ in hits), default=None)
        assert r["base_labels"] == ",".join(sorted({x for _, x in hits}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1


def _regex_of(template):
    """The template as a regular expression over blank-joined words (brute force)."""
    out = []
    for p in re.findall(r"\[\[|\]\]|\{\{[^}]*\}\}|[a-z]+", template):
        if p == "[[":
            out.append("(?:")
        elif p == "]]":
            out.append(")?")
        elif p.startswith("{{"):
            c = p[2:-2].split("|")[1:]
            out.append("(?:" + "|".join("".join(f" {w}" for w in x.split()) for x in c) + ")" if c else r"(?: \S+){1,%d}" % licenses.REPLACE)
        else:
            out.append(f" {re.escape(p)}")
    return re.compile("".join(out))


@pytest.mark.parametrize("template", ["a [[b]] c {{x}} d", "a {{v|b c|b|d}} e [[f [[g]] h]]", "[[a]] b c", "a b [[{{x}} c]] d"])
def test_license_automaton_against_regular_expression(template):
    machine, pattern = licenses.Automaton("l", template), _regex_of(template)
    rng = random.Random(5)
    for _ in range(400):
        words = rng.choices("abcdefgh", k=rng.randrange(1, 14))
        for at in range(len(words)):
            ends = [z for z in range(at + 1, len(words) + 1)
                    if pattern.fullmatch("".join(f" {w}" for w in words[at:z]))]
            assert machine.accept(words, at) == max(ends, default=-1), (words, at)


def _filled(template, rng, optional):
    """A text of the template: regions filled in, optional ones taken or left."""
    out, skip, depth = [], 0, 0
    for p in re.findall(r"\[\[|\]\]|\{\{[^}]*\}\}|" + licenses.WORD.pattern, template):
        if p == "[[":
            depth += 1
            skip = skip or (0 if optional else depth)
        elif p == "]]":
            skip = 0 if skip == depth else skip
            depth -= 1
        elif not skip:
            choices = p[2:-2].split("|")[1:] if p.startswith("{{") else None
            words = [p] if choices is None else rng.choice(choices).split() if choices else rng.choices(["The", "Örg", "of", "2024", "Persons"], k=rng.randrange(1, 8))
            out += [(w, choices is None and not depth) for w in words]
    return out


@pytest.mark.parametrize("number", range(len(licenses.FULL)))
def test_license_wordings_in_full(number):
    label, template = licenses.FULL[number]
    rng = random.Random(number)
    for optional in (True, False):
        words = _filled(template, rng, optional)
        text = "Copyright 2024\n" + "".join(w.upper() + rng.choice([" ", ", ", ".\n * ", "; "]) for w, _ in words)
        found = {(s["label"], s["end"] - s["first"]) for s in licenses.scan(text)["spans"]}
        assert label in licenses.scan(text)["labels"].split(","), (label, text)
        assert any(k == label and n >= len(words) - 12 for k, n in found)         # a leading name may be read short
        mandatory = [i for i, (_, must) in enumerate(words) if must]
        for i in rng.sample(mandatory, min(25, len(mandatory))):                   # one altered mandatory word
            changed = " ".join(w if k != i else "zzz" for k, (w, _) in enumerate(words))
            assert not licenses.Scanner([(label, template)]).scan(changed)["labels"] or label in ("mit",) and i > 60, (label, words[i])


def test_license_labels_tell_near_wordings_apart():
    rng, full = random.Random(2), {}
    for label, t in licenses.FULL:
        full.setdefault(label, " ".join(w for w, _ in _filled(t, rng, True)))
    got = {label: set(licenses.scan(full[label])["labels"].split(",")) for label in full}
    assert len(full) >= 28 and all(label in got[label] for label in full)
    for a, b in (("bsd-2", "bsd-3"), ("bsd-3", "bsd-4"), ("bsd-1", "bsd-2"), ("mit-0", "mit"), ("0bsd", "isc"), ("cc-by", "cc-by-sa")):
        assert b not in got[a] and a not in got[b], (a, b, got[a], got[b])
    assert got["bsd-3"] == {"bsd-3"} and got["zlib"] == {"zlib"} and got["bsl-1"] == {"bsl-1"}


def test_license_notices_are_exact():
    assert "gpl-3" in licenses.scan("Licensed under the GNU General Public License, version 3.")["labels"]
    assert licenses.scan("Licensed under the GNU General Private License, version 3.")["labels"] == ""
    assert licenses.scan("Released under the BSD 3-Clause License.")["labels"] == "bsd-3"
    assert licenses.scan("Released under the 2-clause BSD license.")["labels"] == "bsd-2"
    with pytest.raises(ValueError):
        licenses.Automaton("x", "a [[b")
    with pytest.raises(ValueError):
        licenses.Automaton("x", "[[a]]")


def test_license_empty_table(spark):
    assert licenses.license_scan(docs_of(spark, [])).count() == 0


# --- HTML ----------------------------------------------------------------------

def test_html_article_of_the_driver_pages(spark):
    import html as h
    got = {r["page_id"]: r for r in html_extract.op2_html_extract(spark, SF).collect()}
    pages = table(spark, SF, "pages").collect()
    assert len(got) == len(pages)
    for p in pages:
        a = re.search(r"<article>(.*?)</article>", p["html"], re.S)[1]
        a = re.sub(r"</?(p|h1|h2|br|li|ul|div)[^>]*>", " ", re.sub(r"<!--.*?-->", "", a, flags=re.S))
        want = " ".join(h.unescape(re.sub(r"<[^>]+>", "", a)).split())
        assert got[p["page_id"]]["text"] == want and got[p["page_id"]]["n_chars"] == len(want)
        assert got[p["page_id"]]["url"] == p["url"]


PAGE = """<html><body class="has-sidebar"><header><h1>Site</h1><p>Slogan of the site, here.</p></header>
<div class="cookie-notice">We use cookies. Accept them, please.</div>
<div id="content"><div class="post"><h2>Title here</h2><p>First para with <a href=x>a link</a>
 &amp; text &lt;b&gt;, long enough to be a paragraph, as one would write it.<p>Short.
<ul><li>item one<li>item <b>tw</b>o</ul><script>var x="<p>no</p>";</script><!-- gone --><style>p{}</style>
<form><input><label>Mail</label><button>Go</button></form>
<p>Second para that is long, and has punctuation. It goes on; and on.</p><div class="ad">Buy now, only today!</div></div>
<div class="comments"><p>I liked this article a lot, thank you. Really long comment, with much punctuation. Yes!</p></div></div>
<div id="sidebar"><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul></div><footer>(c) x</footer></body>"""


def test_html_without_article_tag():
    assert html_extract.main_text(PAGE) == (
        "Title here First para with a link & text <b>, long enough to be a paragraph, as one would write it. Short. "
        "item one item two Second para that is long, and has punctuation. It goes on; and on.")


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("   ", ""), ("plain text x < y", "plain text x < y"), ("<p>a<p>b", "a b"), ("<script>x", ""),
    ("<p>a&nbsp;&#228;</p><!-- open", "a ä"), ("</p></div>stray<br>end", "stray end"), ("<article><p>One</article>", "One"),
    ('<div class="site-header"><p>S, t.</p></div><div id="post-header"><h1>T</h1></div><div><p>Long enough a text, for sure.</p></div>',
     "T Long enough a text, for sure."), ('<div id="header"><p>S, t.</p></div><p>Text, here.</p>', "Text, here."),
    ("<ARTICLE><P CLASS=x>Up</P></ARTICLE>", "Up"), ("<p hidden>no</p><p>yes</p>", "yes"), ("<nav>only a menu</nav>", ""),
])
def test_html_defined_cases(page, text):
    assert html_extract.main_text(page) == text


@pytest.mark.parametrize("start,end", [
    ('<div class="page has-sidebar"><article>', "</article></div>"), ('<div id="content-sidebar-wrap"><article>', "</article></div>"),
    ('<div class="layout no-banner"><main>', "</main></div>"), ('<article class="post comments-open">', "</article>"),
    ('<main class="with-sidebar">', "</main>"), ('<div class="layout no-banner">', "</div>"), ('<div id="content-sidebar-wrap">', "</div>"),
    ('<div class="sidebar-right">', "</div>"), ('<div class="sidebar"><div class="notice"><main>', "</main></div></div>"),
    ('<article class="post format-aside category-social">', "</article>"), ('<div class="cookie-bar-shown"><article>', "</article></div>"),
    ('<div id="page" class="header-fixed"><article class="sponsored">', "</article></div>")])
def test_html_wrappers_named_like_parts(start, end):
    text = "First paragraph of the article, which is long enough; it says things. Second one, with more of it, and a stop."
    page = f"""<body><div class="cookie-notice">We use cookies, accept them.</div>{start}<p>{text}</p><p>{text}</p>
        <div class="comments"><article class="comment"><p>{text} I liked it, thank you, all of it, a lot.</p></article></div>{end}
        <div class="sidebar"><p>Other things, here.</p><article>Teaser, of another.</article></div></body>"""
    assert html_extract.main_text(page) == f"{text} {text}"


LINE = "Sentence of the article, which is long enough; it says things."
LONG = " ".join([LINE] * 17)
MENU = "<ul><li><a href=1>Home</a><li><a href=1>About</a><li><a href=1>Contact</a></ul>"
REFS = "<ul><li><a href=1>Ref one</a><li><a href=1>Ref two</a><li><a href=1>Ref three</a></ul>"


@pytest.mark.parametrize("page,text", [
    (f"<div class=post><div class=intro>{LINE} {LINE}</div><div class=text>{LONG}</div></div>", f"{LINE} {LINE} {LONG}"),
    (f"<div class=post><h2>Head</h2><p>{LINE}</p><p>Short.</p><blockquote>{LONG}</blockquote><p>{LINE}</p></div>",
     f"Head {LINE} Short. {LONG} {LINE}"),
    (f"<div class=post><p>{LINE}</p><pre>{LONG}</pre><p>{LINE}</p></div>", f"{LINE} {LONG} {LINE}"),
    (f"<div class=post><p>{LINE}</p><ul><li>{LONG}<li>short</ul><p>{LINE}</p></div>", f"{LINE} {LONG} short {LINE}"),
    (f"<div class=post><p>{LINE}</p><table><tr><td>{LONG}<td>1</table><p>{LINE}</p></div>", f"{LINE} {LONG} 1 {LINE}"),
    (f"<body><div>{MENU}</div><div><p>{LONG}</p></div><div><p>{LINE}</p></div></body>", f"{LONG} {LINE}"),
    (f"<body><article><p>{LONG}</p>{REFS}</article>{MENU}</body>", f"{LONG} Ref one Ref two Ref three"),
    (f"<body><div>{MENU}</div><div class=post><p>{LONG}</p><h2>Sources</h2><div>{REFS}</div></div></body>",
     f"{LONG} Sources Ref one Ref two Ref three"),
    (f"<body>{MENU}<h1>Title</h1><p>{LONG}</p><p>{LINE}</p><h2>Sources</h2>{REFS}</body>",
     f"Title {LONG} {LINE} Sources Ref one Ref two Ref three")])
def test_html_whole_article_without_article_tag(page, text):
    assert html_extract.main_text(page) == text


def test_html_long_and_deep_pages():
    assert html_extract.main_text("<div>" * 20000 + "<p>deep text.</p>") == "deep text."
    many = "<article>" + "".join(f"<p>Paragraph {i}, here.</p>" for i in range(20000)) + "</article>"
    assert html_extract.main_text(many).count("Paragraph") == 20000


def test_html_null_rows_and_extra_columns(spark):
    df = spark.createDataFrame([(1, None, None, "x"), (None, "u", "<p>t</p>", "y")], "page_id long, url string, html string, text string")
    got = html_extract.extract(df).collect()
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in got) == [(0, "t", 1), (1, "", 0)]
    assert html_extract.extract(df.limit(0)).count() == 0


# --- language --------------------------------------------------------------------

def test_language_accuracy_and_undetermined(spark):
    got = langid.op4_language_id(spark, SF).join(table(spark, SF, "documents"), "doc_id").collect()
    held = [r for r in got if r["held_out"] and r["lang"] is not None]
    assert sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.95
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) == r["held_out"] for r in got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_defined_cases(spark):
    d = table(spark, SF, "documents")
    odd = spark.createDataFrame([(900001, None, "en"), (900002, "", "en"), (900003, "123 ²!! _", "de"), (None, "the and of", None)],
                                "doc_id long, text string, lang string")
    both = d.select("doc_id", "text", "lang").unionByName(odd).withColumn("score", F.lit("clash")).withColumn("label", F.lit(1))
    model = langid.fit(both, sample=200)
    got = {r["doc_id"]: r for r in langid.identify(both, model).collect()}
    assert [got[i]["lang_pred"] for i in (900001, 900002, 900003)] == ["und"] * 3
    assert got[None]["lang_pred"] == "en"
    none = langid.fit(both.limit(0))
    assert {r["lang_pred"] for r in langid.identify(both, none).collect()} == {"und"}
    one = langid.fit(both.where("lang = 'en'"), sample=20)
    assert {r["lang_pred"] for r in langid.identify(both.where("text like '%a%'"), one).collect()} == {"en"}


def test_language_model_is_sparse_and_counts_match():
    at, n = langid.counts("Ab, ab!")
    text = " ab ab "
    grams = [text[i:i + k] for k in (1, 2, 3) for i in range(len(text) - k + 1)]
    assert n.sum() == len(grams) and len(at) == len(set(grams))
    w = langid.ftrl([(np.array([0, 2]), np.array([1.0, 1.0])), (np.array([1, 2]), np.array([1.0, 1.0]))] * 50,
                    np.array([0, 1] * 50), 2, 4)
    assert (w[3] == 0).all() and w[0, 0] > w[0, 1] and w[1, 1] > w[1, 0]


def test_temperature_calibrates():
    rng = np.random.default_rng(1)
    z = rng.normal(size=(4000, 3))
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    y = np.array([rng.choice(3, p=q) for q in p])
    assert abs(langid.temperature(z * 3.0, y) - 3.0) < 0.4


# --- quality ----------------------------------------------------------------------

def test_quality_accuracy_on_the_held_out_fold(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.op7_quality_qda(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) / len(got) > 0.97
    assert all((r["score"] >= 0.3) == bool(r["predicted"]) for r in got)


def test_quality_fit_equals_direct_moments(spark):
    d, lab = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = quality.fit(quality.document_statistics(d), lab)
    y = {r["doc_id"]: r["quality"] for r in lab.collect() if r["quality"] is not None}
    rows = [(quality.statistics(r["text"]), y[r["doc_id"]]) for r in d.collect() if r["doc_id"] in y]
    x, c = np.array([a for a, _ in rows]), np.array([b for _, b in rows])
    for k in (0, 1):
        assert np.allclose(model.means[k], x[c == k].mean(axis=0))
    scatter = [np.cov(x[c == k].T, bias=True) for k in (0, 1)]
    pooled = sum(s * (c == k).mean() for k, s in enumerate(scatter))
    for k in (0, 1):
        s = 0.7 * scatter[k] + 0.3 * pooled
        s = 0.9 * s + np.diag(0.1 * np.diag(s) + 1e-3)
        assert np.allclose(model.factors[k].T @ model.factors[k], np.linalg.inv(s), rtol=1e-5)


def test_quality_defined_cases(spark):
    texts = [None, "", "a", "word " * 30000, "\x00\n\n", "ÄÖ " * 5] * 2
    d = docs_of(spark, texts).withColumn("stats", F.lit("clash")).withColumn("y", F.lit(2))
    s = quality.document_statistics(d)
    assert s.count() == len(texts)
    assert all(np.isfinite(r["stats"]).all() for r in s.collect())
    none = quality.fit(s, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r["score"] for r in quality.score_statistics(s, none).collect()} == {0.5}
    only = quality.fit(s, spark.createDataFrame([(1, 1), (2, 1), (None, 0), (3, None)], "doc_id long, quality int"))
    assert {r["score"] for r in quality.score_statistics(s, only).collect()} == {1.0}
    kept = quality.keep_good(d, none)
    assert kept.columns == d.columns and kept.count() == len(texts)
    assert quality.document_statistics(d.limit(0)).count() == 0


# --- packing -----------------------------------------------------------------------

def _tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def test_token_ids_equal_those_of_the_tokenizer_file(spark):
    t = _tokenizer()
    texts = [r["text"] or "" for r in table(spark, SF, "documents").collect()]
    texts += ["", " ", "\n\n  x", "<|endoftext|>", "naïve 日本語 🙂‍", "a" * 3000, "I'll they've 123,456", "\t\r\n ", " " * 3000 + "x"]
    for x in texts:
        assert packing.token_ids(x) == t.encode(x, add_special_tokens=False).ids


def check_pieces(pieces, texts, length, encode):
    by_doc, by_seq = {}, {}
    for r in pieces:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for i, rows in by_doc.items():
        want, at = np.array([*encode(texts[i] or ""), 0], dtype="<u4"), 0
        for r in sorted(rows, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(want) and r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(want[at:at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(want)
    sizes = []
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= length
        sizes.append(at)
    return sizes


def test_packing_against_the_tokenizer(spark):
    t = _tokenizer()
    d = table(spark, SF, "documents")
    pieces = packing.op9_hilbert_pack(spark, SF).collect()
    sizes = check_pieces(pieces, {r["doc_id"]: r["text"] for r in d.collect()}, 1024,
                         lambda x: t.encode(x, add_special_tokens=False).ids)
    assert sum(s < 1024 for s in sizes) <= 8 and sum(sizes) / (1024 * len(sizes)) > 0.9
    ids = packing.pack(d).select("doc_id", "start", "ids").collect()
    assert sum(len(r["ids"]) // 4 for r in ids) == sum(sizes)


def test_packing_ids_of_the_added_token_are_those_of_the_tokenizer_defaults(spark):
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x  <|endoftext|><|endoftext|>\n\n y", "<|endoftext| >", "<|ENDOFTEXT|>",
             "a" * 50 + "<|endoftext|>", "plain", "", " " * 2000000 + "x<|endoftext|>", "^" * 2000000 + "<|endoftext|>"]
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert want[0] == [64, 220, 50256, 275] and [packing.token_ids(x, special=True) for x in texts] == want
    assert packing._slow_coder(packing._coders(None)[1], True).encode(texts[0], add_special_tokens=False).ids == want[0]
    ids = packing.pack(docs_of(spark, texts), length=64).orderBy("doc_id", "start").collect()
    for i, w in enumerate(want):
        assert b"".join(r["ids"] for r in ids if r["doc_id"] == i) == np.array([*w, 0], dtype="<u4").tobytes()


def test_packing_defined_cases(spark):
    texts = [None, "", "x", "long text " * 3000, "x", "x"]
    d = docs_of(spark, texts).withColumn("start", F.lit("clash")).withColumn("ids", F.lit(1))
    pieces = packing.digest(packing.pack(d, length=64)).collect()
    check_pieces(pieces, dict(enumerate(texts)), 64, packing.token_ids)
    assert packing.pack(d.limit(0)).count() == 0
    again = packing.digest(packing.pack(d.unionByName(d), length=64)).collect()
    assert len({(r["doc_id"], r["sequence_id"], r["offset"]) for r in again}) == len(again)


def test_hilbert_neighbours_differ_by_one_step():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        side = 1 << bits
        grid = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), -1).reshape(-1, dims)
        key = packing.hilbert_key(grid, bits)
        assert sorted(key) == list(range(side ** dims))
        walk = grid[np.argsort(key)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_curve_brings_like_texts_together(spark):
    d = table(spark, "/root/testdata/sf0.01", "documents").where("lang is not null and length(text) > 300")
    rows = packing.along_curve(d).join(d.select("doc_id", "lang"), "doc_id").orderBy("__key", "doc_id").collect()
    near = np.mean([a["lang"] == b["lang"] for a, b in zip(rows, rows[1:])])
    share = np.array([sum(r["lang"] == v for r in rows) for v in {r["lang"] for r in rows}]) / len(rows)
    assert near > (share ** 2).sum() + 0.1


# --- shards ---------------------------------------------------------------------------

def brute_shards(rows, shards=8):
    keys = sorted(((i is not None, i or 0), zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for i, t in rows)
    return sorted((k[0][1] if k[0][0] else None, k[2], k[1], sharding.place(j, len(keys)) % shards, sharding.place(j, len(keys)) // shards)
                  for j, k in enumerate(keys))


def test_shards_against_brute_force(spark):
    for sf in (SF, "/root/testdata/sf0.01"):
        got = sharding.op6_feistel_shards(spark, sf).collect()
        want = brute_shards([(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()])
        assert sorted((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in got) == want
        counts = np.bincount([r["shard"] for r in got], minlength=8)
        assert counts.max() - counts.min() <= 1 and {r["law"] for r in got} == {"rows"}
        for s in range(8):
            assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 99, 101, 1000, 1023])
def test_feistel_is_a_permutation_and_can_be_undone(spark, n):
    places = [sharding.place(i, n) for i in range(n)]
    assert sorted(places) == list(range(n))
    assert [sharding.row_at(p, n) for p in places] == list(range(n))
    got = spark.range(n).select("id", sharding.permuted(F.col("id"), n).alias("p")).collect()
    assert [r["p"] for r in sorted(got)] == places


def test_shards_defined_cases(spark):
    texts = [None, "", "same", "same", "ü" * 5000] * 3
    rows = [(None if i % 5 == 4 else i // 5, t) for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash")).withColumn("slot", F.lit(0))
    got = sharding.shuffled(d).collect()
    assert sorted((r["slot"] * 8 + r["shard"]) for r in got) == list(range(len(texts)))
    assert sharding.shuffled(d.limit(0)).count() == 0
    carried = sharding.shuffled(d.drop("shard", "slot"), carry=("text",)).collect()
    assert sorted(r["text"] or "" for r in carried) == sorted(t or "" for t in texts)


def test_pieces_of_a_batch_cover_it():
    import pyarrow as pa
    texts = ["a" * n for n in (5, 1, 0, 9, 2, 2, 2)] + [None]
    b = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    parts = list(sliced([b], "text", 5))
    assert [t for p in parts for t in p.column("text").to_pylist()] == texts and len(parts) >= 4


# --- language identification against plain loops ------------------------------------------

def plain_counts(text):
    """Hashed 1- to 3-grams of a text, one at a time."""
    low, found = [], {}
    for c in text:
        if c.isalpha() or ord(c) > 0xFFFF:
            low.append(ord(c.lower()) if len(c.lower()) == 1 and ord(c) <= 0xFFFF else ord(c))
        elif low and low[-1] != 32:
            low.append(32)
    low = [32, *low] if low else [32]
    if low[-1] != 32:
        low.append(32)
    m32 = 0xFFFFFFFF
    for i in range(len(low)):
        h1 = low[i] * 0x9E3779B1 & m32
        hashes = [h1]
        if i + 1 < len(low):
            h2 = (h1 ^ 0x5BD1E995) + low[i + 1] * 0x85EBCA6B & m32
            hashes.append(h2)
            if i + 2 < len(low):
                hashes.append((h2 * 0xC2B2AE35) + low[i + 2] * 0x27D4EB2F & m32)
        for h in hashes:
            h = ((h ^ h >> 15) * 2654435761 & m32) >> 17
            found[h] = found.get(h, 0) + 1
    return found


@pytest.mark.parametrize("text", ["Hello, wörld!", "a", "  two  words 12 x", "日本 語", "ÀÉ-ß😀z"])
def test_language_features_against_plain_loops(text):
    at, n = langid.counts(text)
    assert dict(zip(at.tolist(), n.tolist())) == plain_counts(text)


@pytest.mark.parametrize("lasso", [langid.L1, 0.8])
def test_ftrl_against_a_plain_loop(lasso):
    rng = np.random.default_rng(4)
    features, classes = 30, 3
    rows = [(np.append(np.sort(rng.choice(features, 6, replace=False)), features), np.append(rng.random(6), 1.0)) for _ in range(40)]
    labels = rng.integers(0, classes, 40)
    z = [[0.0] * classes for _ in range(features + 1)]
    n = [[0.0] * classes for _ in range(features + 1)]

    def weight(i, k):
        l1 = 0.0 if i == features else lasso
        if abs(z[i][k]) <= l1:
            return 0.0
        return -(z[i][k] - math.copysign(l1, z[i][k])) / ((langid.BETA + math.sqrt(n[i][k])) / langid.ALPHA + langid.L2)
    for _ in range(langid.EPOCHS):
        for (at, v), y in zip(rows, labels):
            w = {(i, k): weight(i, k) for i in at for k in range(classes)}
            s = [sum(w[i, k] * x for i, x in zip(at, v)) for k in range(classes)]
            e = [math.exp(x - max(s)) for x in s]
            for k in range(classes):
                p = e[k] / sum(e) - (k == y)
                for i, x in zip(at, v):
                    g = p * x
                    sigma = (math.sqrt(n[i][k] + g * g) - math.sqrt(n[i][k])) / langid.ALPHA
                    z[i][k] += g - sigma * w[i, k]
                    n[i][k] += g * g
    want = np.array([[weight(i, k) for k in range(classes)] for i in range(features + 1)])
    assert np.allclose(langid.ftrl(rows, labels, classes, features, l1=lasso), want, atol=1e-12) and (want == 0).any() == (lasso > 0.5)


def test_temperature_is_the_best_of_a_grid():
    rng = np.random.default_rng(6)
    logits = rng.normal(size=(200, 4)) * 5
    labels = np.array([rng.choice(4, p=np.exp(x / 3) / np.exp(x / 3).sum()) for x in logits])

    def loss(t):
        s = logits / t
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(200), labels]).mean())
    best = langid.temperature(logits, labels)
    assert all(loss(best) <= loss(t) + 1e-9 for t in np.exp(np.linspace(np.log(0.25), np.log(20), 400)))


def test_inverse_document_frequencies_count_every_training_text(spark):
    texts = ["abc", "abd", "xyz", None, "12", "abc"]
    docs = docs_of(spark, texts)
    model = langid.fit(docs)
    have = [plain_counts(t) for t in texts if t and any(c.isalpha() for c in t)]
    for h in {k for c in have for k in c}:
        assert model.idf[h] == pytest.approx(math.log((1 + len(have)) / (1 + sum(h in c for c in have))) + 1)


def test_names_of_the_result_are_refused_as_ids(spark):
    d = docs_of(spark, ["a b c"])
    from blockflow.llm import simhash
    for name in ("fp", "Root", "component_id"):
        with pytest.raises(ValueError, match="rename"):
            simhash.near_duplicates(d.withColumnRenamed("doc_id", name), id_col=name)
    with pytest.raises(ValueError, match="rename"):
        packing.pack(d.withColumnRenamed("doc_id", "start"), id_col="start")
