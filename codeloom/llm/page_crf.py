"""Main text of web pages by a linear-chain conditional random field over their leaf blocks."""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages that the field is trained on at most, smallest hashes first, the longest of them in characters, the blocks
#: of a stretch, and the stretches.
TRAINED = 240
TRAINED_CHARS = 200_000
TRAINED_BLOCKS = 60
TRAINED_STRETCHES = 2_000

#: Layouts that each training page is written in, besides its own.
LAYOUTS = 3

#: A tag up to the first ``>`` outside of quoted values, and up to the first at all. A quote that follows no ``=``, or is
#: without its partner before the next tag, is an ordinary character.
TAG = re.compile(r"""</?([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>="']++|=\s*+(?:"[^"<]*+"|'[^'<]*+')?|["'])*+)>""")
PLAIN_TAG = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>")
NAMES = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.IGNORECASE)

# Elements of HTML by how they break text.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = set("svg math template noscript select".split())
LEAVES_DRAWING = set("blockquote body center dd div dl dt h1 h2 h3 h4 h5 h6 head hr li ol p pre table ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {
    "p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"},
    "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}, "div": {"p"}, "ul": {"p"}, "ol": {"p"},
    "table": {"p"}, "section": {"p"}, "article": {"p"}, "aside": {"p"}, "footer": {"p"}, "header": {"p"}, "nav": {"p"},
    "form": {"p"}, "blockquote": {"p"}, "h1": {"p"}, "h2": {"p"}, "h3": {"p"}, "body": {"head", "title"},
}
ANCESTORS = (
    "head title nav header footer aside form article main section table ul ol li h1 h2 h3 h4 p blockquote pre figure "
    "figcaption button label fieldset dl td body"
).split()
ANCESTOR_SET = frozenset(ANCESTORS)

#: Words of class, id and role names, in groups that mean alike. Fixed values.
ROLES = {
    "advert": "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion promoted dfp adsense",
    "menu": "menu nav navbar navigation breadcrumb breadcrumbs toc tabs pagination pager skip",
    "head": "header masthead topbar logo brand site-header branding hero-nav",
    "foot": "footer foot copyright legal colophon bottom imprint",
    "side": "sidebar side aside widget rail related recommended recommendations trending popular more",
    "notice": "cookie cookies consent notice alert gdpr popup modal overlay warning privacy banner-cookie paywall",
    "talk": "comment comments reply replies discussion discuss disqus respond thread feedback responses",
    "form": "form login signin signup subscribe subscription newsletter search register contact",
    "share": "share sharing social follow tags meta byline author date tools toolbar",
    "body": "content article post entry story body main text maincontent main-content article-body post-content entry-content story-body",
}
ROLE_OF = {w: r for r, words in ROLES.items() for w in words.split()}

PHRASES = re.compile(
    r"©|\(c\) \d{4}|copyright|all rights reserved|cookie|subscribe|newsletter|sign in|log in|advert|sponsored|privacy"
    r"|terms of|read more|share this|follow us|comments?\b|reply\b|related|menu",
    re.IGNORECASE,
)


@dataclass
class Block:
    """Text between two breaks, and where it stands: the kinds of its ancestors, the roles of their names, their number."""

    text: str
    tags: frozenset[str]
    roles: frozenset[str]
    depth: int
    linked: int = 0
    label: int | None = None


@dataclass(slots=True)
class _Open:
    """An open element, with what it takes over from those around it."""

    tag: str
    tags: frozenset[str] = frozenset()
    roles: frozenset[str] = frozenset()
    label: int | None = None
    linked: bool = False
    hidden: int = 0
    foreign: bool = False


class _Stack:
    """Open elements. Closing one costs no more than the elements it removes: places are kept by tag, those that end a
    run of inline elements (``solid``) and those that an inline end tag does not cross (``walls``) in lists of their own."""

    def __init__(self) -> None:
        self.open = [_Open("")]
        self.places: dict[str, list[int]] = {}
        self.solid: list[int] = []
        self.walls: list[int] = []

    @property
    def top(self) -> _Open:
        return self.open[-1]

    def push(self, tag: str, attrs: str) -> None:
        mark = re.search(r'data-label="([01])"', attrs) if "data-label" in attrs else None
        up, k = self.top, len(self.open)
        tags = up.tags if tag not in ANCESTOR_SET or tag in up.tags else up.tags | {tag}
        own = _roles(attrs)
        self.open.append(_Open(
            tag, tags, up.roles if own <= up.roles else up.roles | own, int(mark[1]) if mark else up.label, up.linked or tag == "a",
            up.hidden + (tag in HIDDEN), up.foreign or tag in ("svg", "math"),
        ))
        self.places.setdefault(tag, []).append(k)
        if tag not in INLINE:
            self.solid.append(k)
            if tag not in HIDDEN:
                self.walls.append(k)

    def cut(self, k: int) -> None:
        while len(self.open) > k:
            self.places[self.open.pop().tag].pop()
        for places in (self.solid, self.walls):
            while places and places[-1] >= k:
                places.pop()

    def matching(self, tag: str) -> int | None:
        """Place of the element that an end tag closes."""
        places = self.places.get(tag)
        if not places or (tag in INLINE and self.walls and self.walls[-1] > places[-1]):
            return None
        return places[-1]

    def close_before(self, tag: str) -> None:
        """Close what a start tag closes without saying so."""
        while self.solid and self.open[self.solid[-1]].tag in CLOSES[tag]:
            self.cut(self.solid[-1])


def _roles(attrs: str) -> frozenset[str]:
    found = set()
    if "=" in attrs:
        for groups in NAMES.findall(attrs):
            for name in "".join(groups).lower().split():
                for part in (name, *re.split(r"[-_]", name)):
                    if part in ROLE_OF:
                        found.add(ROLE_OF[part])
    return frozenset(found)


def leaf_blocks(page: str) -> list[Block]:
    """Blocks of text in page order. Character references are decoded, white space inside a block is one space, and
    blocks without text are left out. What scripts, styles, comments, drawings, templates and choices hold is no text.

    Broken markup is read as far as it goes, in time proportional to the page: an element that was never closed ends with
    the one around it, and one that hides its contents does so only if its end tag follows. Scripts and styles without an end
    go on to the end of the page, as in browsers, and so do comments; a tag that nothing ends is text.
    """
    blocks: list[Block] = []
    s = _Stack()
    parts: list[str] = []
    linked = 0
    ends: dict[str, int] = {}
    low = page.lower()
    if len(low) != len(page):  # letters whose small form is longer
        low = re.sub("[A-Z]+", lambda m: m[0].lower(), page)

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            up = s.top
            blocks.append(Block(text, up.tags, up.roles, len(s.open) - 1, min(linked, len(text)), up.label))
        parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if not s.top.hidden:
            parts.append(text)
            if s.top.linked:
                linked += len(" ".join(text.split()))

    def ended(tag: str, at: int) -> bool:
        if tag not in ends:
            ends[tag] = low.rfind("</" + tag)
        return ends[tag] >= at

    def skipped(at: int) -> int:
        """End of the comment or declaration that begins here."""
        if page.startswith("<!--", at):
            stop = page.find("-->", at + 2)
            return stop + 3 if stop >= 0 else len(page)
        if page.startswith("<![CDATA[", at) and sections > at:
            return page.index("]]>", at) + 3
        return page.find(">", at) + 1

    tags, last, sections = TAG, page.rfind(">"), page.rfind("]]>")
    at = 0
    while (mark := page.find("<", at)) >= 0:
        if mark > at:
            add(page[at:mark])
        if page.startswith("<!--", mark) or page[mark + 1 : mark + 2] in ("!", "?") and mark < last:
            at = skipped(mark)
            continue
        m = tags.match(page, mark) if mark < last else None
        if m is None and mark < last and PLAIN_TAG.match(page, mark):
            tags = PLAIN_TAG  # every tag end behind here stands in quotes, so those are none
            m = tags.match(page, mark)
        if m is None:
            add("<")
            at = mark + 1
            continue
        at = m.end()
        tag, attrs = m[1].lower(), m[2]
        if page[mark + 1] == "/":
            k = s.matching(tag)
            if s.top.hidden:
                if k is None or s.open[k - 1].hidden:
                    s.cut(k or len(s.open))
                    continue
                s.cut(next(i for i in range(k, len(s.open)) if s.open[i].hidden))
                parts.append(" ")
            if tag not in INLINE and tag not in HIDDEN:
                flush()
            if k is not None:
                s.cut(k)
            continue
        if s.top.foreign and tag in LEAVES_DRAWING and not s.places.get("foreignobject"):
            s.cut(min(s.places[t][0] for t in ("svg", "math") if s.places.get(t)))
        self_closed = attrs.endswith("/")
        if tag in RAW and not (self_closed and (s.top.foreign or not ended(tag, at))):
            if ended(tag, at):
                stop = low.index("</" + tag, at)
                if tag == "title" and not s.top.hidden and not s.top.foreign:
                    flush()
                    s.push(tag, attrs)
                    add(page[at:stop])
                    flush()
                    s.cut(len(s.open) - 1)
                elif not s.top.hidden:
                    parts.append(" ")
                gt = page.find(">", stop)
                at = gt + 1 if gt >= 0 else len(page)
            elif tag in ("script", "style"):
                at = len(page)
            continue
        if tag == "br" or tag in RAW:
            if not s.top.hidden:
                parts.append(" ")
            continue
        if tag in HIDDEN:
            if not self_closed and ended(tag, at) and not (tag in ("select", "noscript") and s.places.get(tag)):
                if not s.top.hidden:
                    parts.append(" ")
                s.push(tag, attrs)
            continue
        if tag not in INLINE and not s.top.hidden:
            flush()
        if tag in VOID or self_closed:
            continue
        if tag in CLOSES:
            s.close_before(tag)
        s.push(tag, attrs)
    if at < len(page):
        add(page[at:])
    flush()
    return blocks


N_FEATURES = len(ANCESTORS) + len(ROLES) + 15


def block_features(blocks: list[Block]) -> np.ndarray:
    """One row per block: ancestors, roles of their names, and what the text is like."""
    x = np.zeros((len(blocks), N_FEATURES))
    n = len(blocks)
    places: dict[tuple, list[float]] = {}
    for k, b in enumerate(blocks):
        words = b.text.count(" ") + 1
        place = (b.tags, b.roles)
        if place not in places:
            places[place] = [float(t in b.tags) for t in ANCESTORS] + [float(r in b.roles) for r in ROLES]
        phrase = words < 60 and bool(PHRASES.search(b.text))
        x[k] = places[place] + [
            1.0, math.log1p(words) / 4, words >= 8, words >= 20, b.linked / len(b.text), b.linked * 2 > len(b.text),
            b.text[-1] in ".!?…\"'»”:", min((b.text.count(",") + b.text.count(".")) / words, 1.0), phrase,
            phrase and words < 30, sum(map(b.text.count, "0123456789")) / len(b.text),
            k == 0, k == n - 1, k / n, b.depth / 10,
        ]
    return x


@dataclass
class Field:
    """Weights of a chain over two labels: ``unary`` for main text over other text, ``pair[a, b]`` for b behind a."""

    unary: np.ndarray
    pair: np.ndarray

    def decode(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Best labels of every page (Viterbi), pages of like length side by side."""
        out: list[np.ndarray] = [np.zeros(0, int)] * len(pages)
        order = sorted(range(len(pages)), key=lambda i: len(pages[i]))
        for lo in range(0, len(order), 128):
            group = [i for i in order[lo : lo + 128] if len(pages[i])]
            if not group:
                continue
            n = np.array([len(pages[i]) for i in group])
            u = np.zeros((len(group), n.max()))
            for r, i in enumerate(group):
                u[r, : n[r]] = pages[i] @ self.unary
            best = np.stack([np.zeros(len(group)), u[:, 0]], 1)
            back = np.zeros((n.max(), len(group), 2), "i1")
            ends = np.where((n == 1)[:, None], best, 0.0)
            for t in range(1, n.max()):
                step = best[:, :, None] + self.pair[None]
                back[t] = step.argmax(1)
                best = step.max(1)
                best[:, 1] += u[:, t]
                ends[n == t + 1] = best[n == t + 1]
            for r, i in enumerate(group):
                y = np.zeros(n[r], int)
                y[-1] = ends[r].argmax()
                for t in range(n[r] - 1, 0, -1):
                    y[t - 1] = back[t, r, y[t]]
                out[i] = y
        return out


def train_field(pages: list[tuple[np.ndarray, np.ndarray]], steps: int = 200, rate: float = 0.15, ridge: float = 0.1) -> Field:
    """Most likely weights given labelled pages, less a ridge: forward-backward over all pages side by side, Adam steps."""
    pages = [p for p in pages if len(p[1])]
    n = np.array([len(y) for _, y in pages])
    b, longest = len(pages), int(n.max(initial=1))
    x, y = np.zeros((b, longest, N_FEATURES)), np.zeros((b, longest), int)
    for r, (fx, fy) in enumerate(pages):
        x[r, : n[r]], y[r, : n[r]] = fx, fy
    inside = np.arange(longest)[None] < n[:, None]
    follows = inside[:, 1:]
    seen = np.stack([[((y[:, :-1] == i) & (y[:, 1:] == j) & follows).sum() for j in (0, 1)] for i in (0, 1)]).astype(float)
    w = np.zeros(N_FEATURES + 4)
    m, v = np.zeros_like(w), np.zeros_like(w)
    total = max(int(n.sum()), 1)
    log_sum = lambda a, axis: np.logaddexp(np.take(a, 0, axis), np.take(a, 1, axis))
    for k in range(1, steps + 1):
        u, pair = x @ w[:N_FEATURES], w[N_FEATURES:].reshape(2, 2)
        fwd, bwd = np.zeros((b, longest, 2)), np.zeros((b, longest, 2))
        fwd[:, 0, 1] = u[:, 0]
        for t in range(1, longest):
            fwd[:, t] = log_sum(fwd[:, t - 1, :, None] + pair[None], 1)
            fwd[:, t, 1] += u[:, t]
        for t in range(longest - 2, -1, -1):
            ahead = bwd[:, t + 1].copy()
            ahead[:, 1] += u[:, t + 1]
            step = log_sum(ahead[:, None, :] + pair[None], 2)
            bwd[:, t] = np.where(inside[:, t + 1, None], step, 0.0)
        z = log_sum(fwd[np.arange(b), n - 1], 1)
        p1 = np.where(inside, np.exp(fwd[:, :, 1] + bwd[:, :, 1] - z[:, None]), 0.0)
        gradient = np.zeros_like(w)
        gradient[:N_FEATURES] = np.einsum("bt,btf->f", p1 - y * inside, x)
        ahead = bwd[:, 1:].copy()
        ahead[:, :, 1] += u[:, 1:]
        both = np.exp(fwd[:, :-1, :, None] + pair[None, None] + ahead[:, :, None, :] - z[:, None, None, None])
        gradient[N_FEATURES:] = ((both * follows[:, :, None, None]).sum((0, 1)) - seen).ravel()
        gradient = (gradient + ridge * w) / total
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        w -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return Field(w[:N_FEATURES], w[N_FEATURES:].reshape(2, 2))


def plain_labels(blocks: list[Block]) -> list[int] | None:
    """Labels of a page that marks its article: what stands in ``article`` or ``main`` and in nothing that says otherwise;
    none for a page without such an element."""
    apart = {"nav", "header", "footer", "aside", "form", "button", "head", "title"}
    other = {"advert", "talk", "notice", "form", "menu", "side", "share", "foot"}
    if not any({"article", "main"} & b.tags for b in blocks):
        return None
    return [int(bool({"article", "main"} & b.tags) and not apart & b.tags and not other & b.roles) for b in blocks]


LINKS = "Home|About us|Contact|News|Products|Archive|Help|Accueil|Startseite|Kontakt|Inicio|Blog|Shop|Politics|Sport|Search".split("|")
CLOSINGS = "© 2024 All rights reserved|Privacy policy|Terms of use|Copyright|Imprint|Follow us|Back to top|Cookie settings".split("|")
NOTICES = "We use cookies to improve your visit. Accept|Please accept our cookies|This site uses cookies.|Subscribe to our newsletter for more".split("|")


def laid_out(paragraphs: list[str], others: list[str], rng: random.Random) -> str:
    """A page with the paragraphs as its article and the others around and between them, in a layout drawn at random.
    Every element says in ``data-label`` what it holds."""
    def el(tag: str, inner: str, names: str = "", label: int | None = None) -> str:
        kind = f' {rng.choice(["class", "id"])}="{names}"' if names and rng.random() < 0.8 else ""
        mark = f' data-label="{label}"' if label is not None else ""
        return f"<{tag}{kind}{mark}>{inner}</{tag}>"

    esc = lambda t: html.escape(t, quote=False)
    some = lambda k: [esc(rng.choice(others)) for _ in range(k)] if others else [esc(rng.choice(LINKS))]
    name = lambda role: rng.choice([w for w in ROLES[role].split() if len(w) > 1])
    links = lambda: el("ul", "".join(f'<li><a href="#">{esc(rng.choice(LINKS)) if rng.random() < 0.6 else some(1)[0][:20]}</a></li>' for _ in range(rng.randint(2, 8))))
    pick = lambda semantic, plain="div": semantic if rng.random() < 0.6 else plain

    def article() -> str:
        out = [el(rng.choice(["h1", "h1", "h2"]), esc(paragraphs[0][:70]))] if rng.random() < 0.8 else []
        for p in paragraphs:
            shape = rng.random()
            if shape < 0.75:
                out.append(el("p", f"<b>{esc(p)}</b>" if rng.random() < 0.05 else esc(p)))
            elif shape < 0.82:
                out.append(el("ul", "".join(el("li", esc(x)) for x in re.split(r"(?<=[.!?]) ", p))))
            elif shape < 0.88:
                out.append(el("blockquote", el("p", esc(p))))
            elif shape < 0.92:
                out.append(el("h2", esc(p[:50])) + el("p", esc(p)))
            elif shape < 0.95:
                out.append(el("table", el("tr", el("td", esc(p)) + el("td", esc(p[:30])))))
            else:
                out.append(el("div", esc(p)))
            if rng.random() < 0.12:
                out.append(el(pick("aside"), some(1)[0], name(rng.choice(["advert", "advert", "side", "notice"])), 0))
        if rng.random() < 0.3:
            out.append(el("div", "".join(f'<a href="#">{esc(x)}</a> ' for x in ["Share", "Tweet", "Print"]), name("share"), 0))
        return "".join(out)

    talk = el("section" if rng.random() < 0.5 else "div", (el("h3", "Comments") if rng.random() < 0.6 else "") + "".join(
        el(rng.choice(["div", "article", "li"]), (el("span", esc(rng.choice(LINKS))) if rng.random() < 0.4 else "") + el("p", x), name("talk"), 0) for x in some(rng.randint(1, 5))
    ), name("talk"), 0)
    inner = article() + (talk if rng.random() < 0.3 else "")
    body = el(pick("article", rng.choice(["div", "main", "section"])), inner, name("body"), 1)
    parts = [
        el(pick("header"), (el("p", some(1)[0]) if rng.random() < 0.5 else esc(rng.choice(LINKS))), name("head"), 0) if rng.random() < 0.6 else "",
        el(pick("nav"), links(), name("menu"), 0) if rng.random() < 0.9 else "",
        el("div", esc(rng.choice(NOTICES)) if rng.random() < 0.6 else el("p", some(1)[0]), name("notice"), 0) if rng.random() < 0.4 else "",
        el("div", some(1)[0], name("advert"), 0) if rng.random() < 0.7 else "",
        el(pick("aside"), links() + el("p", some(1)[0]), name("side"), 0) if rng.random() < 0.4 else "",
        body,
        talk if rng.random() < 0.35 else "",
        el("form", el("label", esc(rng.choice(LINKS))) + el("p", some(1)[0]) + el("button", "OK"), name("form"), 0) if rng.random() < 0.35 else "",
        el(pick("aside"), el("h3", esc(rng.choice(LINKS))) + links() + "".join(el("p", x) for x in some(rng.randint(0, 2))), name("side"), 0) if rng.random() < 0.4 else "",
        el(pick("footer"), f"{esc(rng.choice(CLOSINGS))} &middot; {some(1)[0]}" + (links() if rng.random() < 0.3 else ""), name("foot"), 0) if rng.random() < 0.9 else "",
    ]
    title = f"<head><title data-label=\"0\">{esc(paragraphs[0][:60])}</title><style>p{{margin:0}}</style></head>"
    return f"<html>{title}<body>{''.join(parts)}</body></html>"


def training_pages(sample: list[str], layouts: int = LAYOUTS, seed: int = 7) -> list[tuple[np.ndarray, np.ndarray]]:
    """Features and labels of the sample's pages that mark their article, and of their texts in other layouts. Where no
    page marks one, long blocks of the pages serve as paragraphs of the drawn layouts, in which labels are known, and
    short ones as what stands around them. Chains of many blocks are cut into stretches."""
    rng = random.Random(seed)
    read = [(blocks, plain_labels(blocks)) for blocks in map(leaf_blocks, sample)]
    own = [(blocks, labels) for blocks, labels in read if labels]
    guessed = own or [(blocks, [int(b.text.count(" ") >= 12 and b.linked * 2 < len(b.text)) for b in blocks]) for blocks, _ in read]
    texts = [[b.text for b, y in zip(blocks, labels, strict=True) if y] for blocks, labels in guessed]
    others = [b.text for blocks, labels in guessed for b, y in zip(blocks, labels, strict=True) if not y]
    sentences = [t for ts in texts for t in ts[:3]]
    pages = [(block_features(blocks), np.array(labels)) for blocks, labels in own]
    for paragraphs in texts:
        for _ in range(layouts if paragraphs else 0):
            around = rng.sample(sentences, min(6, len(sentences))) + rng.sample(others, min(4, len(others)))
            blocks = leaf_blocks(laid_out(paragraphs[:25], around, rng))
            pages.append((block_features(blocks), np.array([b.label or 0 for b in blocks])))
    cuts = [(x[lo : lo + TRAINED_BLOCKS], y[lo : lo + TRAINED_BLOCKS]) for x, y in pages for lo in range(0, len(y), TRAINED_BLOCKS)]
    return cuts if len(cuts) <= TRAINED_STRETCHES else rng.sample(cuts, TRAINED_STRETCHES)


def sampled_pages(pages: DataFrame, most: int) -> list[str]:
    """At most ``most`` pages, those with the smallest hashes: hashes first, so that a task sends numbers and not pages,
    and copies of one page count once."""
    fit = pages.select("html", F.xxhash64("page_id", "url", "html").alias("h"))
    least = [r["h"] for r in fit.select("h").distinct().orderBy("h").limit(most).collect()]
    if not least:
        return []
    taken = fit.where(F.col("h") <= least[-1]).groupBy("h").agg(F.min("html").alias("html"))
    return [r["html"] for r in sorted(taken.collect(), key=lambda r: r["h"])]


def trained_field(pages: DataFrame, most: int = TRAINED) -> Field:
    """The field, trained on a bounded sample of the pages that mark their article, or of all where none does."""
    fit = pages.where(F.length("html").between(1, TRAINED_CHARS))
    sample = sampled_pages(fit.where(F.col("html").rlike(r"(?i)<(?:article|main)[\s>/]")), most) or sampled_pages(fit, most)
    rows = training_pages(sample)
    return train_field(rows) if rows else Field(np.zeros(N_FEATURES), np.zeros((2, 2)))


def main_texts(pages: DataFrame, model: Field | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) per row of ``pages`` (page_id, url, html): the blocks that the field labels as main
    text, in page order, joined by a space; n_chars counts code points.

    The field is trained on at most ``TRAINED`` pages that mark their article themselves and on their texts in layouts drawn
    at random, in which every element's label is known; then every page is cut into blocks and decoded by itself, whole
    and without a shuffle. Without pages that mark an article, the layouts hold the long blocks of any pages. Null or empty
    pages, and pages without main text, give an empty text. Repeated rows are each extracted. Other columns are not read.
    """
    model = model or trained_field(pages)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                blocks = [leaf_blocks(page) for page in part.column(2).to_pylist()]
                labels = model.decode([block_features(b) for b in blocks])
                texts = [" ".join(b.text for b, y in zip(bs, ys, strict=True) if y) for bs, ys in zip(blocks, labels, strict=True)]
                columns = [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInArrow(extract, "page_id bigint, url string, text string, n_chars bigint")
