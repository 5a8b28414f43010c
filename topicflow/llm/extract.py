"""HTML extraction with a tree-structured graphical model over the DOM.

Every element that starts a block, or carries a telling class or id, is a
node that is either content or not.  A node potential scores what the node
shows (kind, tag, own text, link share, sentence marks, share of the page); an
edge potential for each kind of parent and child scores which labels go together from
parent to child.  Sum-product message passing, once upward and once downward,
gives each node's exact marginal; the text of nodes more likely content than
not is returned.

Training uses labelled pages: pages with exactly one ``article`` element,
whose inside is content, taken from a bounded sample (``sample`` pages in
hash order).  So that the model does not hang on that tag, further labelled
pages are made from them by known edits: the article becomes another
container, and menus, headers, sidebars, notices, adverts, forms and reader
comments with text of other pages are put around and into it.  Node weights
are a logistic regression, edge potentials smoothed log ratios of label
pairs, so a page outside the training set needs no label and no article tag.

Text: character references are decoded, white space inside a block becomes
one space, blocks are trimmed and joined in page order by one space.

Only what holds raw text in HTML (scripts, styles, titles, ...) is skipped, up
to its end tag; without one, only the start tag is.  Buttons and choices are
nodes the model judges like others; formulas and embedded objects belong to
the node they stand in.

Defined results: null and empty html give the empty string; unclosed and
stray tags are repaired as browsers do in the common cases; without any page
to learn from, the edits of an empty page are; repeated rows stay.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Params:
    sample: int = 400              # bound of the labelled pages collected for training
    max_chars: int = 20_000        # longest html learned from
    edits: int = 4                 # pages made from each
    smooth: float = 0.5
    seed: int = 11


# HTML element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike "
                   "strong sub sup time tt u var wbr br img mi mn mo ms mtext mrow mfrac msqrt mroot mstyle msub msup msubsup munder "
                   "mover munderover tspan math svg object canvas video audio".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp template".split())       # no text of the page inside
PHRASE = frozenset("button select datalist optgroup noscript".split())         # nodes that leave a paragraph open
CLOSES = {"p": frozenset("p".split()), "li": frozenset(("li", "p")), "dt": frozenset(("dt", "dd", "p")), "dd": frozenset(("dt", "dd", "p")),
          "tr": frozenset(("tr", "td", "th", "p")), "td": frozenset(("td", "th", "p")), "th": frozenset(("td", "th", "p")),
          "option": frozenset(("option",))} | {t: frozenset(("option",) if t == "optgroup" else ()) for t in PHRASE}
STOPS = frozenset("table ul ol dl div section article main aside nav header footer form body html blockquote".split())
NEGATIVE_TAGS = frozenset("nav footer aside header form menu dialog fieldset".split())
POSITIVE_TAGS = frozenset(("article", "main"))
# Words of class, id and role names.
NEGATIVE = frozenset("nav navbar navigation menu header masthead topbar footer bottom sidebar aside ad ads advert advertisement adverts banner "
                     "sponsor sponsored promo promotion cookie cookies consent notice notices alert gdpr comment comments commentlist respond "
                     "reply replies discussion disqus form newsletter subscribe signup login search share sharing social related recommended "
                     "breadcrumb breadcrumbs pagination pager widget popup modal overlay copyright legal tags toolbar skip complementary "
                     "contentinfo bannerad message warning disclaimer".split())
POSITIVE = frozenset("article content main post entry story body articlebody text maincontent prose".split())
# Each character of a tag is read in one way only: a quote matters after an equals sign, if it is closed.
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:_-]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""", re.S)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
OPENING = re.compile("<[a-zA-Z/!?]")
LABEL = re.compile("\x00([01])")                    # labels of the training pages; no page has this character there
WORD = re.compile(r"[a-z]+")
HIDDEN = re.compile(r"""\bhidden\b(?!\s*=\s*["']?false)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)


@dataclass
class Page:
    """Nodes in page order (a parent before its children)."""
    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    kind: list[str] = field(default_factory=list)
    label: list[int | None] = field(default_factory=list)
    chars: list[int] = field(default_factory=list)
    links: list[int] = field(default_factory=list)
    marks: list[int] = field(default_factory=list)
    pieces: list[tuple[int, str]] = field(default_factory=list)    # node, or -1 at a block boundary


def hint(names: str) -> int:
    words = set(WORD.findall(names.lower()))
    return -1 if words & NEGATIVE else 1 if words & POSITIVE else 0


class Stack:
    """Open elements, with the places of each name."""

    def __init__(self, root: int):
        self.rows, self.where, self.stops = [("html", root)], {"html": [0]}, [0]

    def push(self, tag: str, node: int) -> None:
        self.where.setdefault(tag, []).append(len(self.rows))
        if tag in STOPS:
            self.stops.append(len(self.rows))
        self.rows.append((tag, node))

    def close(self, names, through: bool) -> None:
        """Close the innermost element of these names, if no element that stops it stands inside (``through``: none does)."""
        k = max((self.where[t][-1] for t in names if self.where.get(t)), default=0)
        if k and (through or self.stops[-1] <= k):
            for tag, _ in self.rows[k:]:
                self.where[tag].pop()
                if tag in STOPS:
                    self.stops.pop()
            del self.rows[k:]


def parse(html: str | None, labelled: bool = False) -> Page:
    p = Page()

    def node(parent: int, tag: str, side: int, label: int | None) -> int:
        kind = ("neg" if tag in NEGATIVE_TAGS or side < 0 else "pos" if tag in POSITIVE_TAGS or side > 0 else
                "root" if tag in ("html", "body") else "text" if tag in TEXT else "plain")
        p.parent.append(parent)
        p.tag.append(tag)
        p.kind.append(kind)
        p.label.append(label if label is not None else p.label[parent] if parent >= 0 else None)
        p.chars.append(0)
        p.links.append(0)
        p.marks.append(0)
        return len(p.tag) - 1

    stack = Stack(node(-1, "html", 0, None))
    depth, at, text = 0, 0, html or ""
    last = text.rfind(">") + 1                                     # no tag ends behind it
    missing: set[str] = set()                                      # end tags that the rest of the page lacks

    def find(pattern: str, start: int) -> tuple[int, int] | None:
        if pattern not in missing:
            if m := re.compile(pattern, re.I | re.A).search(text, start):
                return m.span()
            missing.add(pattern)
        return None

    def add(raw: str) -> None:
        n = stack.rows[-1][1]
        p.pieces.append((n, raw))
        size = len(raw.strip())
        if size:
            p.chars[n] += size
            p.marks[n] += sum(map(raw.count, ".,;!?"))
            if depth:
                p.links[n] += size

    while m := TAG.search(text, at, last):
        if m.start() > at:
            add(text[at:m.start()])
        at = m.end()
        if m[0].startswith("<!--") and not m[0].endswith("-->"):   # a comment without an end
            at = len(text)
        if m[1] is not None:
            add(m[1])
        if m[3] is None:
            continue
        tag = m[3].lower()
        if m[2]:                                                   # end tag
            if tag == "a":
                depth = max(0, depth - 1)
            stack.close((tag,), tag in STOPS)
            if tag not in INLINE:
                p.pieces.append((-1, ""))
            continue
        if tag in ("head",) or tag in RAW:                         # no text of the page inside
            if not m[4].endswith("/"):
                end = find(rf"</{re.escape(tag)}(?=[\s/>])", at)
                if tag == "head":
                    body = find("<body", at)
                    if body and (not end or body < end):
                        at, end = body[0], None
                if end:                                            # without an end tag only the start tag goes
                    at = text.find(">", end[1]) + 1 or len(text)
            continue
        if tag == "br" or tag in VOID:
            if tag not in ("img", "wbr"):
                p.pieces.append((-1, ""))
            continue
        if tag in ("html", "body") and (tag == "html" or stack.where.get("body")):
            continue
        side, label = 0, None
        if m[4]:
            mark = LABEL.search(m[4]) if labelled else None
            label = int(mark[1]) if mark else None
            side = hint(" ".join(b or c or d for _, b, c, d in NAMED.findall(m[4])))
            if HIDDEN.search(m[4]):
                side = -1
        inline = tag in INLINE
        if not inline:
            p.pieces.append((-1, ""))
            shuts = CLOSES.get(tag, CLOSES["p"])
            stack.close(shuts, False)
        if tag == "a":
            depth += 1
        if inline and side >= 0 and label is None:
            stack.push(tag, stack.rows[-1][1])
        else:
            stack.push(tag, node(stack.rows[-1][1], tag, side, label))
    if at < len(text):                                             # a tag cut off by the end of the page is no text
        cut = OPENING.search(text, max(at, last))
        add(text[at:cut.start() if cut else len(text)])
    return p


TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre figcaption td th tr".split())
KINDS = ("root", "plain", "neg", "pos", "text")


def features(p: Page) -> list[list[str]]:
    """Names of what each node shows."""
    n = len(p.tag)
    total = list(p.chars)
    linked = list(p.links)
    for i in range(n - 1, 0, -1):
        total[p.parent[i]] += total[i]
        linked[p.parent[i]] += linked[i]
    page = max(1, total[0])
    seen, out = 0, []
    for i in range(n):
        c = p.chars[i]
        whole = total[i]
        share = whole / page
        out.append([
            "kind=" + p.kind[i], "tag=" + p.tag[i],
            "own=" + str(min(10, c.bit_length())),
            "link=" + ("none" if not whole else "0" if not linked[i] else "1" if linked[i] < 0.3 * whole else "2" if linked[i] < 0.7 * whole else "3"),
            "mark=" + ("none" if not c else "0" if not p.marks[i] else "1"),
            "share=" + ("0" if share < 0.02 else "1" if share < 0.1 else "2" if share < 0.4 else "3"),
            "place=" + str(int(4 * min(seen, page - 1) / page)),
        ])
        seen += c
    return out


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    edges: dict[str, tuple[float, float, float, float]]            # kind of edge -> potentials 00, 01, 10, 11 (parent, child)


def _edge(p: Page, i: int) -> str:
    """Kind of the edge from a node's parent: that of the parent, and whether the child looks unlike content."""
    return p.kind[max(0, p.parent[i])] + ("-" if p.kind[i] == "neg" else "+")


def marginals(p: Page, model: Model) -> list[float]:
    """Log-odds of content for each node, by sum-product on the tree."""
    w = model.weights
    up = [sum(w.get(f, 0.0) for f in fs) for fs in features(p)]
    n = len(up)
    sent = [0.0] * n
    table = [model.edges[_edge(p, i)] for i in range(n)]

    def message(odds: float, yes: float, no: float) -> float:
        """Log of the sum over the sender's two labels, finite for any odds."""
        return yes + odds if odds > 30 else no if odds < -30 else math.log(math.exp(no) + math.exp(odds + yes))

    for i in range(n - 1, 0, -1):                                  # children come after their parents
        t = table[i]
        sent[i] = message(up[i], t[3], t[2]) - message(up[i], t[1], t[0])
        up[p.parent[i]] += sent[i]
    out = up
    for i in range(1, n):
        t = table[i]
        above = out[p.parent[i]] - sent[i]
        out[i] += message(above, t[3], t[1]) - message(above, t[2], t[0])
    return out


def extract(html: str | None, model: Model) -> str:
    if not html:
        return ""
    p = parse(html)
    odds = marginals(p, model)
    blocks, now = [], []
    for n, raw in p.pieces:
        if n < 0:
            blocks.append("".join(now))
            now = []
        elif odds[n] > 0:
            now.append(raw)
    blocks.append("".join(now))
    return " ".join(" ".join(entities.unescape(b).split()) for b in blocks if b and not b.isspace()).strip()


# -- training -----------------------------------------------------------------------

ARTICLE = re.compile(r"<article\b[^>]*>(.*?)</article\s*>", re.S | re.I)
BODY = re.compile(r"(<body\b[^>]*>)(.*?)(</body\s*>|\Z)", re.S | re.I)


def _edited(html: str, inside: str, others: list[str], rng: random.Random) -> str:
    """A labelled page: the article in another container, boilerplate around and inside."""
    pick = rng.choice
    words = [w for w in pick(others).split() if w] or ["text"]

    def some(low: int, high: int) -> str:
        k = rng.randrange(max(1, len(words) - 1))
        return " ".join(words[k:k + rng.randint(low, high)])

    def links(n: int) -> str:
        return "".join(f'<li><a href="#">{some(1, 3)}</a></li>' for _ in range(n))

    def choices() -> str:
        tag = pick(["select", "select", "datalist"])
        return f"<{tag}>{''.join(f'<option>{some(1, 3)}' for _ in range(rng.randint(1, 6)))}</{tag}>"

    def paragraphs(n: int) -> str:
        return "".join(f"<p>{some(5, 60)}.</p>" for _ in range(n))

    menus = [lambda: f"<nav><ul>{links(6)}</ul></nav>", lambda: f'<div class="{pick(["menu", "navbar", "nav main-nav"])}">{links(5)}</div>',
             lambda: f'<ul class="breadcrumb">{links(3)}</ul>', lambda: f"<ul>{links(7)}</ul>"]
    heads = [lambda: f"<header><h1>{some(1, 4)}</h1><p>{some(3, 10)}</p></header>", lambda: f'<div id="{pick(["header", "masthead", "top-header"])}">{some(2, 8)}</div>']
    sides = [lambda: f"<aside><h3>{some(1, 4)}</h3>{paragraphs(rng.randint(1, 4))}<ul>{links(4)}</ul></aside>",
             lambda: f'<div class="{pick(["sidebar", "widget", "related posts", "social share"])}"><h4>{some(1, 3)}</h4>{paragraphs(rng.randint(0, 3))}{links(3)}</div>']
    notes = [lambda: f'<div class="{pick(["cookie-notice", "notice", "alert", "consent banner", "gdpr"])}"><p>{some(5, 30)}</p></div>',
             lambda: f'<div role="alert">{some(5, 25)}</div>']
    adverts = [lambda: f'<div class="{pick(["ad", "ads", "advert", "sponsored", "banner ad-slot", "promo"])}">{some(4, 30)}.</div>',
               lambda: f'<div id="ad-{rng.randrange(99)}"><p>{some(4, 30)}.</p></div>']
    forms = [lambda: f'<form action="#"><label>{some(1, 4)}</label><input name="q"><p>{some(3, 15)}</p></form>',
             lambda: f'<div class="{pick(["newsletter", "subscribe", "login"])}"><p>{some(4, 20)}</p><input></div>',
             lambda: f"<form><label>{some(1, 3)}</label>{choices()}<button>{some(1, 2)}</button></form>", lambda: choices(),
             lambda: f"<button>{some(1, 3)}</button>"]
    talk = [lambda: f'<{t} {pick(["class", "id"])}="{pick(["comments", "comment-list", "discussion", "reader-comments"])}"><h3>{some(1, 3)}</h3>'
                    f"{''.join(f'<div class={chr(34)}comment{chr(34)}>{paragraphs(rng.randint(1, 2))}</div>' for _ in range(rng.randint(1, 5)))}</{t}>"
            for t in ("section", "div")] + [lambda: f'<ol class="commentlist">{"".join(f"<li>{some(5, 50)}.</li>" for _ in range(3))}</ol>']
    feet = [lambda: f"<footer>&copy; {some(3, 15)}.</footer>", lambda: f'<div class="{pick(["footer", "copyright", "site-footer"])}"><p>{some(4, 20)}.</p></div>']

    def mark(x: str) -> str:
        return re.sub(r"\A<(\w+)", "<\\1 \x000", x)

    def some_of(*families, rate=0.6) -> str:
        return "".join(mark(pick(f)()) for f in families if rng.random() < rate)

    def within(body: str) -> str:
        """Boilerplate between the paragraphs of the article, or after them."""
        cut = [m.start() for m in re.finditer(r"<p\b", body)]
        if cut and rng.random() < 0.5:
            k = pick(cut)
            body = body[:k] + some_of(adverts, forms, notes, rate=0.4) + body[k:]
        return body + (some_of(talk, sides, rate=0.4) if rng.random() < 0.5 else "")

    outer = pick([("<article", "</article>"), ("<main", "</main>"), ('<div class="content"', "</div>"), ('<div id="main-content"', "</div>"),
                  ('<section class="post"', "</section>"), ("<div", "</div>"), ("<div", "</div>"), ('<td class="story"', "</td>")])
    article = f'{outer[0]} \x001>{within(inside)}{outer[1]}'
    if rng.random() < 0.3:
        article = f"<div>{article}</div>"
    if rng.random() < 0.3:
        article = f"<main>{article}{some_of(talk, sides)}</main>"
    return (f'<html><body \x000>{some_of(notes, heads, menus, adverts)}{article}'
            f"{some_of(adverts, talk, sides, forms, notes, menus, feet)}</body></html>")


def labelled(pages: list[str], p: Params) -> list[Page]:
    rng = random.Random(p.seed)
    single = [(h, m[0]) for h in (x.replace("\x00", "") for x in pages) if len(m := ARTICLE.findall(h)) == 1]
    single = single or [("", "<h1>a b c</h1><p>a b c, d e f.</p><p>g h i j k l m n.</p>")]
    plain = [" ".join(re.sub(r"<[^>]*>", " ", inside).split()) for _, inside in single]
    out = []
    for html, inside in single:
        marked = re.sub(r"(?i)<article\b", "<article \x001", html, count=1)
        if html:
            out.append(re.sub(r"(?i)<body\b", "<body \x000", marked, count=1))
        out += [_edited(html, inside, plain, rng) for _ in range(p.edits)]
    return [parse(x, labelled=True) for x in out]


def fit(pages: list[str], p: Params = Params()) -> Model:
    trees = labelled(pages, p)
    index: dict[str, int] = {}
    rows, y = [], []
    counts = {k + side: np.full((2, 2), p.smooth) for k in KINDS for side in "+-"}
    for t in trees:
        label = [x or 0 for x in t.label]
        for i, fs in enumerate(features(t)):
            rows.append([index.setdefault(f, len(index)) for f in fs])
            y.append(label[i])
            if i:
                counts[_edge(t, i)][label[t.parent[i]], label[i]] += 1
    rows, y = np.array(rows), np.array(y, float)
    w, m, v = np.zeros(len(index)), np.zeros(len(index)), np.zeros(len(index))
    for step in range(1, 151):
        q = 1 / (1 + np.exp(-w[rows].sum(1)))
        g = np.bincount(rows.ravel(), np.repeat(q - y, rows.shape[1]), len(index)) / len(y) + 1e-4 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-9)
    share = np.array([1 - y.mean(), y.mean()])
    edges = {}
    for k, c in counts.items():                                    # how much likelier a child's label is than anywhere
        ratio = np.log(c / c.sum(1, keepdims=True) / share[None, :])
        edges[k] = tuple(float(x) for x in ratio.ravel())
    return Model({f: float(w[i]) for f, i in index.items()}, edges)


# -- Spark ------------------------------------------------------------------------------

def train(pages: DataFrame, p: Params = Params()) -> Model:
    """The model of a bounded sample of pages with one article element."""
    good = pages.select("html", F.xxhash64("html").alias("_h")).where((F.length("html") <= p.max_chars) & F.lower("html").contains("<article"))
    chosen = good.select("_h").distinct().orderBy("_h").limit(p.sample)           # numbers only; the pages follow by them
    rows = good.join(F.broadcast(chosen), "_h").dropDuplicates(["_h"]).collect()
    return fit([r["html"] for r in sorted(rows, key=lambda r: r["_h"])], p)


def main_text(pages: DataFrame, p: Params = Params(), model: Model | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    model = pages.sparkSession.sparkContext.broadcast(model or train(pages, p))     # a few hundred numbers

    def run(batches):
        import pyarrow as pa
        for b in batches:
            out = [extract(h, model.value) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())],
                                             ["page_id", "url", "text", "n_chars"])

    return (pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
                 .mapInArrow(run, "page_id long, url string, text string, n_chars long"))
