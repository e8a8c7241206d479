"""Main-text extraction by tag-path ratios.

The page is read into blocks: the text between block-level tags, with the
path of tags (root to leaf, with the words of class and id) it stands under;
inline tags do not cut a block.  Scripts, styles, forms, menus, headers,
footers, sidebars, notices, adverts and reader comments are known by tag,
role, class or id and leave no block.  A class or id that tells a state or a
layout ("has-sidebar", "content-sidebar-wrap") names no such part, and an
element that holds the article or over half of the score is none.  Inside an
article or main a name counts if all its words name parts ("comment-list", not
"related-work"); one with other words too does only where over half of the
element's text is linked.  A heading or paragraph there is never a part by its
id.  A label is text like any other unless it stands in a form, and formulas
are part of their sentence (their source annotations aren't).

The scanner goes forward once: what it can't find ahead (a closing quote, a
">") it doesn't look for again, and stray closing tags are known by a count of
open ones, so time grows with the page's length whatever its markup.

Ratios.  For each tag path the text length and the punctuation of all its
blocks are added up and divided by the number of its blocks; the score of a
path is the product of the two means, damped by the share of linked text.
The scores are smoothed along the page with a Gaussian window, fused with the
score of the block's own path (so a short paragraph gains from its fellows,
and a stray line in between loses to its own path), and blocks over
``THRESHOLD`` times the standard deviation are content.

Selection.  The main container is the deepest element with ``COVER`` of the
content blocks' text that is no block of text, list or table, widened to an
enclosing ``article`` or ``main``.  An article or main is taken whole.  Other
articles beside the one with most of the score are taken too unless they are
teasers: those with fewer than two content blocks, or with half of their text
linked.  On
pages without one every content block is taken, wherever it stands; the
element that holds them all (unless it is the body) is the container, and its
headings and short paragraphs, whose own ratio says little, are taken with
them, but lists of links only inside the container.  Without an h1 of its own
it takes the last one above it.

Decoding: character references are decoded once, white space inside a block
becomes one blank, blocks are joined by one blank in page order; nothing else
is dropped or cut.

Defined cases: null and empty pages, and pages without text outside the known
parts, give an empty text; text without tags is one block; unclosed and stray
tags are tolerated; an unclosed comment or script runs to the end of the
page; repeated pages are extracted alike.
"""

from __future__ import annotations

import html
import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_text, sliced, table

THRESHOLD, COVER, SMOOTH = 0.2, 0.8, 2.0

_TAG = re.compile(r"</?([a-zA-Z][^\s/><]*)")
_MARKS = re.compile(r"[>\"']")
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORDS = re.compile(r"[a-z0-9]+")
_PUNCT = re.compile(r"[.,;:!?…。，；：！？]")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("""script style textarea title xmp iframe noembed noframes noscript template svg canvas object
    annotation annotation-xml""".split())
INLINE = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp
    small span strike strong sub sup time tt u var wbr nobr center_ img math mi mo mn ms mtext mrow msup msub msubsup mfrac msqrt mroot
    mover munder munderover mmultiscripts mtable mtr mtd mspace mstyle mpadded mphantom menclose merror mfenced semantics""".split())
#: Tags whose text is never the article's.
OUTSIDE = frozenset("""head nav footer aside form button select option optgroup datalist fieldset menu dialog audio video
    applet map progress meter output legend""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar status".split())
#: Blocks of text, lists and tables: never the container of the article.
LEAVES = HEADINGS | frozenset("""p blockquote pre li ul ol dl dt dd td th tr thead tbody tfoot table caption figure figcaption
    address details summary""".split())
ROOTS = frozenset("html body".split())
#: Words of a class or id that name a part outside the article.
NAMES = frozenset("""ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar
    navigation menu menubar breadcrumb breadcrumbs sidebar aside footer masthead cookie cookies consent notice notices
    gdpr newsletter subscribe subscription signup login popup modal overlay comment comments commentlist respond disqus
    replies reply share sharing social related recommended recommendations widget widgets pagination pager toolbar
    topbar searchform copyright alert disclaimer""".split())
#: A class or id with one of these tells a state of the page or of the element ("has-sidebar", "comments-open").
STATES = frozenset("has have with without no not open opened closed enabled disabled".split())
#: With a word of each, it names a wrapper of the content ("content-sidebar-wrap").
WRAPS, CONTENTS = frozenset("wrap wrapper container layout".split()), frozenset("content main page site post article entry body".split())
#: Reader comments, and other parts that may hold more text than the article.
COMMENTS = frozenset("comment comments commentlist respond disqus replies reply".split())
NEVER = COMMENTS | frozenset("""ad ads adv advert adverts advertisement advertising nav navbar navigation menu menubar footer
    cookie cookies consent gdpr newsletter subscribe subscription signup login popup modal overlay copyright disclaimer""".split())
#: Words that go with the name of a part without making it a wrapper ("comment-list").
PIECES = frozenset("""area list section body item content box form thread block container wrap wrapper holder inner title text
    user users reader readers your post posts article articles story stories page site links link button buttons icon icons bar
    slot unit group row col top bottom left right sticky inline wide primary secondary mobile desktop more also read tags topics
    count meta header heading label sign up in by this wp fb""".split())
#: With one of these (or alone) the name "header" means the site's, not the article's.
SITE = frozenset("site page top global main masthead".split())
#: Tags that an opening block tag closes when they are the innermost open block.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
         "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"},
         "tfoot": {"tbody", "tr", "td", "th"}}
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}


@dataclass(slots=True)
class Element:
    tag: str
    path: int          # number of its tag path within the page
    parent: int
    outside: bool      # by tag, role or style, or below such an element
    main: bool
    own_main: str      # "main" or "article" if it is one itself
    named: int         # by class or id: 0 not, 1 a part, 2 a part of NEVER, 3 reader comments, -1 perhaps one (in an article)


@dataclass(slots=True)
class Block:
    text: str
    element: int
    path: int
    linked: int
    outside: bool


@dataclass
class Page:
    elements: list[Element] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)
    paths: dict[tuple[int, str], int] = field(default_factory=dict)      # (parent's path, step) -> number


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(text)} if text.strip() else {}


def _named(tag: str, own_main: str, inside: bool, attrs: dict[str, str]) -> int:
    """What the class and id say of an element, see ``Element.named``."""
    if own_main == "main" or tag in ("html", "body"):
        return 0
    kind, perhaps, rest = 0, False, []
    own_id = "" if (inside or own_main) and (tag in HEADINGS or tag == "p") else attrs.get("id", "")
    for name in f"{attrs.get('class', '')} {own_id}".lower().split():
        words = set(_WORDS.findall(name))
        if not STATES.isdisjoint(words) or not (WRAPS.isdisjoint(words) or CONTENTS.isdisjoint(words)):
            continue
        rest += words
        if not NAMES.isdisjoint(words):
            whole = all(w in NAMES or w in PIECES or w.isdigit() for w in words)
            perhaps = perhaps or not whole and inside
            if whole or not own_main and not inside:
                kind = max(kind, 1 if NEVER.isdisjoint(words) else 3 if whole and not COMMENTS.isdisjoint(words) else 2)
    if not kind and not own_main and not inside and "header" in rest and (len(rest) == 1 or not SITE.isdisjoint(rest)):
        kind = 1
    return kind or (-1 if perhaps and not own_main else 0)


def _open(tag: str, attrs: dict[str, str], parent: Element | None, at: int, paths: dict) -> Element:
    names = _WORDS.findall(f"{attrs.get('class', '')} {attrs.get('id', '')}".lower())
    role = attrs.get("role", "").lower()
    own_main = "main" if "main" in (tag, role) else "article" if "article" in (tag, role) else ""
    inside = bool(parent and parent.main)
    outside = bool(parent and parent.outside)
    if not own_main and tag not in ("html", "body"):
        outside = outside or tag in OUTSIDE or role in ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true" \
            or "display:none" in attrs.get("style", "").replace(" ", "").lower() or not inside and tag == "header"
    named = _named(tag, own_main, inside, attrs) if names else 0
    step = ".".join([tag, *sorted(set(names))[:4]])
    path = paths.setdefault((parent.path if parent else -1, step), len(paths))
    return Element(tag, path, at, outside, bool(own_main) or inside, own_main, named)


def read(page: str | None) -> Page:
    """Elements and blocks of a page."""
    out, stack, links = Page(), [], 0
    parts: list[str] = []
    linked = 0
    text = page or ""

    def flush():
        nonlocal parts, linked
        if parts:
            words = " ".join(html.unescape("".join(parts)).split())
            if words:
                top = stack[-1] if stack else -1
                path = out.elements[top].path if stack else -1
                out.blocks.append(Block(words, top, path, linked, bool(stack) and out.elements[top].outside))
            parts, linked = [], 0

    def push(tag, attrs):
        parent = stack[-1] if stack else -1
        out.elements.append(_open(tag, attrs, out.elements[parent] if stack else None, parent, out.paths))
        stack.append(len(out.elements) - 1)

    def add(piece):
        nonlocal linked
        if piece:
            parts.append(piece)
            if links:
                linked += len(piece)

    open_tags: dict[str, int] = {}                 # how many of each are on the stack
    last_gt = text.rfind(">")
    no_more = {'"': len(text) + 1, "'": len(text) + 1}       # from here on there is none

    def tag_end(lt):
        """Where the tag that begins at ``lt`` ends (after its ">"): quoted
        values are passed over, a quote that nothing closes is a character."""
        pos = lt + 1
        while pos <= last_gt:
            m = _MARKS.search(text, pos)
            if m[0] == ">":
                return m.end()
            close = text.find(m[0], m.end()) if m.start() < no_more[m[0]] else -1
            if close < 0:
                no_more[m[0]] = min(no_more[m[0]], m.start())
            pos = m.end() if close < 0 or close > last_gt else close + 1
        return -1

    def leave():
        i = stack.pop()
        open_tags[out.elements[i].tag] -= 1

    at, end = 0, len(text)
    while at < end:
        lt = text.find("<", at)
        if lt < 0:
            add(text[at:])
            break
        if lt > at:
            add(text[at:lt])
        if text.startswith("<!--", lt):
            at = text.find("-->", lt + 4)
            at = end if at < 0 else at + 3
            continue
        if text.startswith("<![CDATA[", lt):
            at = text.find("]]>", lt + 9)
            add(html.escape(text[lt + 9:at if at >= 0 else end], quote=False))
            at = end if at < 0 else at + 3
            continue
        m = _TAG.match(text, lt) if lt < last_gt else None
        if m is None and (lt > last_gt or text[lt + 1:lt + 2] not in ("!", "?")):
            add("<")                               # a bare "<" is text
            at = lt + 1
            continue
        if m is None:
            at = text.index(">", lt) + 1
            continue
        at = tag_end(lt)
        if at < 0:
            add("<")
            at = lt + 1
            continue
        tag, attrs = m[1].lower(), text[m.end():at - 1]
        if text[lt + 1] == "/":
            if tag == "a":
                links = max(0, links - 1)
            if tag in INLINE:
                continue
            if tag == "p" or open_tags.get(tag):
                flush()
            if open_tags.get(tag):
                while out.elements[stack[-1]].tag != tag:
                    leave()
                leave()
            continue
        if tag in RAW:
            if not attrs.rstrip().endswith("/"):
                done = _RAW_END[tag].search(text, at)
                at = done.end() if done else end
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in INLINE or tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "a":
                links += 1
            continue
        flush()
        links = 0
        if stack and out.elements[stack[-1]].tag == "p":
            leave()
        while stack and out.elements[stack[-1]].tag in _ENDS.get(tag, ()):
            leave()
        push(tag, _attributes(attrs))
        open_tags[tag] = open_tags.get(tag, 0) + 1
    flush()
    _mark(out)
    return out


def _mark(page: Page) -> None:
    """Marks the blocks below named elements as outside.  Names are guesses:
    an element that holds the page's main or article, or over half of the
    score of the page, is its wrapper whatever its name says (but not reader
    comments, and by the score alone none of ``NEVER``)."""
    els = page.elements
    if not any(e.named for e in els):
        return
    text, linked = [0] * len(els), [0] * len(els)
    for b in page.blocks:
        if b.element >= 0:
            text[b.element] += len(b.text)
            linked[b.element] += min(b.linked, len(b.text))
    for i in range(len(els) - 1, -1, -1):
        if els[i].parent >= 0:
            text[els[i].parent] += text[i]
            linked[els[i].parent] += linked[i]

    def below(marks):                                        # the strongest mark on the way up from each element
        got = [0] * len(els)
        for i, e in enumerate(els):
            got[i] = max(marks[i], got[e.parent] if e.parent >= 0 else 0)
        return got

    def above(flags):                                        # elements that hold a flagged one, or are it
        for i in range(len(els) - 1, -1, -1):
            if flags[i] and els[i].parent >= 0:
                flags[els[i].parent] = True
        return flags

    named = [e.named if e.named >= 0 else int(2 * n > t) for e, n, t in zip(els, linked, text)]
    for i, holds in enumerate(above([e.own_main == "main" and not e.outside for e in els])):
        if holds:
            named[i] = 0
    under = below(named)
    blocks = [b for b in page.blocks if not b.outside]
    mass, total = [0.0] * len(els), 0.0
    for b, s in zip(blocks, path_scores(blocks) if blocks else ()):
        if b.element < 0 or under[b.element] < 3:
            total += (w := len(b.text) * float(s))
            if b.element >= 0:
                mass[b.element] += w
    for i in range(len(els) - 1, -1, -1):
        if els[i].parent >= 0:
            mass[els[i].parent] += mass[i]
    articles = [i for i, e in enumerate(els) if e.own_main and not e.outside
                and not (e.parent >= 0 and els[e.parent].main) and mass[i] > 0]
    free = sum(mass[i] for i in articles if not under[i])
    best = max(articles, key=mass.__getitem__, default=-1)
    if best >= 0 and under[best] and mass[best] > max(free, total / 4):       # no teaser in a sidebar
        for i, holds in enumerate(above([i == best for i in range(len(els))])):
            if holds:
                named[i] = 0
        free = mass[best]
    if free <= total / 4:
        named = [0 if k == 1 and m > total / 2 else k for k, m in zip(named, mass)]
    under = below(named)
    for b in page.blocks:
        b.outside = b.outside or b.element >= 0 and under[b.element] > 0


def path_scores(blocks: list[Block]) -> np.ndarray:
    """Fused ratio of every block, see the module's text."""
    stats: dict[int, list[float]] = {}
    for b in blocks:
        s = stats.setdefault(b.path, [0, 0, 0, 0])
        s[0] += len(b.text)
        s[1] += len(_PUNCT.findall(b.text))
        s[2] += 1
        s[3] += min(b.linked, len(b.text))
    ratio = {p: math.log1p(n / c * (1 + u / c)) * (1 - a / n) for p, (n, u, c, a) in stats.items()}
    own = np.array([ratio[b.path] for b in blocks])
    reach = int(3 * SMOOTH)
    window = np.exp(-0.5 * (np.arange(-reach, reach + 1) / SMOOTH) ** 2)
    padded = np.pad(own, reach)
    weight = np.convolve(np.pad(np.ones(len(own)), reach), window, "valid")
    smooth = np.convolve(padded, window, "valid") / weight
    return np.sqrt(own * smooth)


def main_blocks(page: Page) -> list[Block]:
    blocks = [b for b in page.blocks if not b.outside]
    if not blocks:
        return []
    score = path_scores(blocks)
    limit = THRESHOLD * float(score.std())
    content = score > limit if len(blocks) > 1 else np.ones(1, dtype=bool)
    mass = np.zeros(len(page.elements))
    total = 0.0
    for b, s, is_content in zip(blocks, score, content):
        if is_content:
            total += (w := len(b.text) * s)
            if b.element >= 0:
                mass[b.element] += w
    # elements are numbered in page order, so a child has a larger number than its parent
    els = page.elements
    passing = [False] * len(els)                           # with a passing block in or below
    for b, is_content in zip(blocks, content):
        if is_content and b.element >= 0:
            passing[b.element] = True
    direct = passing[:]
    for i in range(len(mass) - 1, -1, -1):
        if els[i].parent >= 0:
            mass[els[i].parent] += mass[i]
            passing[els[i].parent] |= passing[i]
    direct_child = direct[:]                              # with a passing block in itself or in a child
    for i, el in enumerate(els):
        if direct[i] and el.parent >= 0:
            direct_child[el.parent] = True
    holder = max((e for e in np.flatnonzero(mass >= COVER * total).tolist() if total and els[e].tag not in LEAVES), default=-1)
    bound, e = False, holder
    while e >= 0:
        if els[e].tag in ("article", "main"):
            holder, bound = e, True
            if els[e].tag == "article":
                break
        e = els[e].parent
    within = [holder < 0] * (len(mass) + 1)              # the last is for text outside all elements
    for i, el in enumerate(els):
        within[i] = i == holder or within[el.parent]
    if bound:
        chosen = [within[b.element] for b in blocks]
        if els[holder].tag == "article":
            beside = _articles(blocks, content, els)
            chosen = [c or b.element >= 0 and beside[b.element] for c, b in zip(chosen, blocks)]
    else:
        near = within[:]
        if holder >= 0 and els[holder].tag not in ROOTS:
            around = _common([b.element for b, is_content in zip(blocks, content) if is_content], els)
            if around >= 0 and els[around].tag not in ROOTS:
                within = [False] * (len(mass) + 1)
                for i, el in enumerate(els):
                    within[i] = i == around or within[el.parent]
                near = within[:]
            for i, el in enumerate(els):                  # a heading or short paragraph beside a passing block
                near[i] = near[i] or el.parent >= 0 and passing[el.parent] and els[el.parent].tag not in ROOTS
        lists = _link_paths(blocks)
        flat = holder < 0 or els[holder].tag in ROOTS
        first = int(np.argmax(content)) if content.any() else len(blocks)
        chosen = []
        for i, (b, is_content) in enumerate(zip(blocks, content)):
            take = bool(is_content) or near[b.element]
            if take and b.path in lists and b.linked >= 0.9 * len(b.text):
                # of the article if it stands in its container, or in a flat page after and beside its text
                at = _list_parent(b.element, els)
                take = i > first and at >= 0 and direct_child[at] if flat else within[b.element]
            chosen.append(take)
    titles = [i for i, b in enumerate(blocks) if b.element >= 0 and els[b.element].tag == "h1"]
    first = chosen.index(True) if any(chosen) else 0
    if not any(chosen[i] for i in titles):                # the title stands just above its text
        above = [i for i in titles if i < first]
        if above or not any(chosen):
            chosen[above[-1] if above else first] = True
    return [b for b, c in zip(blocks, chosen) if c]


def _articles(blocks: list[Block], content: np.ndarray, els: list[Element]) -> list[bool]:
    """For every element: does it lie in an outermost article that is no teaser?"""
    own = [-1] * len(els)
    for i, e in enumerate(els):
        over = own[e.parent] if e.parent >= 0 else -1
        own[i] = over if over >= 0 or e.tag != "article" or e.outside else i
    sums: dict[int, list[int]] = {}
    for b, is_content in zip(blocks, content):
        if b.element >= 0 and own[b.element] >= 0:
            s = sums.setdefault(own[b.element], [0, 0, 0])
            s[0] += bool(is_content)
            s[1] += len(b.text)
            s[2] += min(b.linked, len(b.text))
    whole = {a for a, (n, text, linked) in sums.items() if n >= 2 and 2 * linked < text}
    return [a in whole for a in own]


def _common(at: list[int], els: list[Element]) -> int:
    """The deepest element, no leaf block, that holds all of ``at``; -1 for none."""
    if not at or min(at) < 0:
        return -1
    below = [0] * len(els)
    for e in at:
        below[e] += 1
    for i in range(len(els) - 1, -1, -1):                 # a child has a larger number than its parent
        if els[i].parent >= 0:
            below[els[i].parent] += below[i]
    top = max((i for i, n in enumerate(below) if n == len(at)), default=-1)
    while top >= 0 and els[top].tag in LEAVES:
        top = els[top].parent
    return top


def _list_parent(e: int, els: list[Element]) -> int:
    """The element that holds the list of a list item, or the block itself."""
    while e >= 0 and els[e].tag in ("li", "ul", "ol", "dl", "dt", "dd", "p"):
        e = els[e].parent
    return e


def _link_paths(blocks: list[Block]) -> set[int]:
    """Paths that hold hardly anything but short links, three or more."""
    sums: dict[int, list[int]] = {}
    for b in blocks:
        s = sums.setdefault(b.path, [0, 0, 0])
        s[0] += 1
        s[1] += len(b.text)
        s[2] += min(b.linked, len(b.text))
    return {p for p, (n, text, linked) in sums.items() if n >= 3 and linked >= 0.9 * text and text < 60 * n}


def main_text(page: str | None) -> str:
    return " ".join(b.text for b in main_blocks(read(page)))


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", carry: tuple[str, ...] = ("url",)) -> DataFrame:
    """``id_col``, the ``carry`` columns, text and n_chars per page; one pass, no shuffle."""
    d = pages.select(id_col, *carry, html_col)
    schema = d.select(id_col, *carry, F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema

    def run(batches):
        for b in sliced(batches, html_col):
            texts = [main_text(h) for h in b.column(html_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(id_col), *[b.column(c) for c in carry], pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], names=schema.names)
    return map_text(d, run, schema)


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
