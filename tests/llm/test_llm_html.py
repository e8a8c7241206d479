"""Article text that must stay, pages whose markup repeats, and generated pages with known articles."""

import random
import time

import pytest

from blockflow.llm.html_extract import main_text

P = "<p>This is a plain paragraph of the article, with enough words, and punctuation. It goes on.</p>"
TEXT = P[3:-4]


@pytest.mark.parametrize("inner,kept", [
    ("<label>Tag</label>", "Tag"), ("<p>Press <label for=x>the key</label> twice.</p>", "Press the key twice."),
    ('<section id="related-work"><p>Earlier studies, by others.</p></section>', "Earlier studies, by others."),
    ('<div class="alert-history"><p>Alerts, year by year.</p></div>', "Alerts, year by year."),
    ('<div class="social-history"><p>The town, its people.</p></div>', "The town, its people."),
    ('<p id="menu-of-options">Options, three of them.</p>', "Options, three of them."),
    ('<h2 id="comments-on-law">Comments on law</h2>', "Comments on law"), ('<h2 id="comments">On comments</h2>', "On comments"),
    ("<p>so <math><mi>E</mi><mo>=</mo><mi>m</mi><annotation>\\E</annotation></math> holds.</p>", "so E=m holds."),
    ('<p title="abc>one</p><p>two</p>', "one two"), ("<p>a < b and c > d</p>", "a < b and c > d"), ("<svg/><p>after a picture</p>", "after a picture")])
@pytest.mark.parametrize("shell", ["<article>{}</article>", "<main><div class=wrap>{}</div></main>"])
def test_parts_of_the_article_stay(inner, kept, shell):
    page = "<body><nav><a href=x>Home</a></nav>" + shell.format(P * 3 + inner + P * 2) + "<footer>Foot</footer></body>"
    assert main_text(page) == " ".join([TEXT] * 3 + [kept] + [TEXT] * 2)


@pytest.mark.parametrize("inner", [
    '<div class="related-posts"><ul><li><a href=x>Other story</a></li><li><a href=y>More</a></li></ul></div>',
    '<div class="share-tools"><a href=x>Share this</a> <a href=y>Mail</a></div>', '<div class="comment-list"><p>A reader, angry.</p></div>',
    '<section id="user-comments"><p>A reader, angry.</p></section>', '<div class="newsletter-signup"><p>Join our list, now.</p></div>',
    '<form><label>Name</label> <input></form>', '<div class="ad-slot">Buy, now.</div>', '<aside><p>Beside, this.</p></aside>'])
def test_other_parts_go(inner):
    assert main_text(f"<article>{P * 3}{inner}{P}</article>") == " ".join([TEXT] * 4)


def test_a_second_article_stays_and_teasers_go():
    second = "<article><h2>Second</h2>" + P * 2 + "</article>"
    teaser = "<article class=teaser><h3><a href=x>Teaser one</a></h3><p><a href=x>Read</a> it.</p></article>"
    for start, end in (("<main>", "</main>"), ("<body>", "</body>"), ("<div class=posts>", "</div>")):
        got = main_text(f"{start}<article>{P * 8}</article>{second}{teaser}{end}")
        assert got == " ".join([TEXT] * 8 + ["Second"] + [TEXT] * 2)


@pytest.mark.parametrize("unit", ["a<b ", '<a "x ', "</div>", "<div>", "<svg/>", "<!x ", "<p class='a> ", "<li><a href=x>y</a>", "<!--", "<script>x", "&lt;"])
def test_time_grows_with_the_page(unit):
    def seconds(n):
        page = f"<article>{P}" + unit * n + "</article>"
        best = 9e9
        for _ in range(3):
            began = time.process_time()
            main_text(page)
            best = min(best, time.process_time() - began)
        return best
    small, large = seconds(10_000), seconds(40_000)
    assert large < 10 * max(small, 0.02), (small, large)


def test_stray_closing_tags_on_a_deep_stack():
    page = "<div>" * 20_000 + "<p>deep words.</p>" + "</span></section>" * 20_000
    began = time.process_time()
    assert main_text(page) == "deep words."
    assert time.process_time() - began < 10


# --- generated pages: blocks are written with what a plain reader must find ------------

WORDS = "river stone winter market old bridge people found water later called after north house road light".split()


def sentence(rng, n):
    return (" ".join(rng.choices(WORDS, k=n)) + rng.choice([".", "!", ", too."])).capitalize()


def block(rng):
    """(markup, its text) of one block of an article."""
    kind, text = rng.randrange(8), " ".join(sentence(rng, rng.randrange(6, 20)) for _ in range(rng.randrange(1, 4)))
    if kind == 0:
        head = sentence(rng, 4)
        return f'<h2 id="{rng.choice(["comments", "menu", "s1"])}">{head}</h2>', head
    if kind == 1:
        items = [sentence(rng, 6) for _ in range(3)]
        return "<ul>" + "".join(f"<li>{i}" for i in items) + "</ul>", " ".join(items)
    if kind == 2:
        return f"<blockquote>{text}</blockquote>", text
    if kind == 3:
        a, b = text.split(" ", 1) if " " in text else (text, "x")
        return f"<p><b>{a}</b>\n  {b} &amp; <a href='#'>more</a></p>", f"{a} {b} & more"
    if kind == 4:
        return f'<div class="{rng.choice(["social-history", "note", "alert-of-1900"])}"><p>{text}</p></div>', text
    if kind == 5:
        return f"<p>{text}<br>x <label>y</label> <code>a&lt;b</code></p>", f"{text} x y a<b"
    return f"<p>{text}</p>", text


OUTSIDE = ["<nav><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></nav>", "<header><h1>The Site</h1><p>A slogan, of it.</p></header>",
           "<footer><p>Copyright, the site. All rights.</p></footer>", '<div class="cookie-notice"><p>We use cookies, you know.</p></div>',
           '<aside><h3>Popular</h3><p>Some story, of others.</p></aside>', "<script>if (a < b) document.write('<p>no</p>')</script>",
           '<div id="comments"><p>A reader says this, and that.</p></div>', "<form><label>Search</label><button>Go</button></form>",
           "<!-- a <p>comment</p> -->", "<style>p { color: red }</style>"]


@pytest.mark.parametrize("seed", range(60))
def test_generated_pages(seed):
    rng = random.Random(seed)
    blocks = [(f"<p>{t}</p>", t) for t in [" ".join(sentence(rng, 14) for _ in range(3))]] + [block(rng) for _ in range(rng.randrange(3, 25))]
    before, after = (rng.sample(OUTSIDE, rng.randrange(0, 5)) for _ in range(2))
    inner = "".join(m + (rng.choice(OUTSIDE[3:]) if rng.random() < 0.1 else "") for m, _ in blocks)
    tag = rng.choice(["article", "main"])
    page = f"<html><body class='has-sidebar'>{''.join(before)}<{tag} class='post comments-open'>{inner}</{tag}>{''.join(after)}</body></html>"
    assert main_text(page) == " ".join(t for _, t in blocks)
