"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded from the root down.

A page is parsed into block elements and runs of text. Every node gets features: its tag, tokens
of its class, id and role, depth, density of text, links and tags in its subtree, and how it
stands among its siblings. Boosted trees give the odds that a node is, or holds, main text. The
labels of a page are then chosen together: below a dropped node everything is dropped, and of
all labellings that obey this the likeliest is taken, so that no kept text hangs under a dropped
ancestor.

The trees are trained here, on layouts that are generated around texts of a bounded sample of
the pages (SAMPLE), with every part's label known.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages whose texts fill the generated layouts, blocks of a page that are taken, characters of a block, and layouts.
SAMPLE, TAKEN, CHARS, LAYOUTS = 64, 40, 2000, 800
#: Pages, and nodes, that are scored at once.
PAGES, NODES = 128, 20_000

# Elements by role.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html ins legend li main menu nav noscript ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# What they hold is no markup: without an end tag it is all that follows.
RAW = frozenset("script style textarea title".split())
# What they hold is no text of the page; without an end tag of their own only the tag is left out.
FOREIGN = frozenset("template svg iframe select button canvas audio video".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
# What tokens of class, id and role speak of.
TOKENS = {
    "content": "article content post entry story body main text markdown prose blog read",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager tabs toc skip topbar",
    "head": "header masthead banner logo branding hero top",
    "foot": "footer foot copyright legal bottom colophon",
    "side": "sidebar side aside widget rail complementary",
    "advert": "ad ads advert advertisement adsbygoogle sponsor sponsored promo promoted promotion doubleclick outbrain taboola",
    "notice": "cookie cookies consent gdpr notice alert banner popup modal overlay warning paywall",
    "comment": "comment comments disqus reply replies discussion respond feedback reader",
    "share": "share sharing social follow tweet facebook buttons",
    "related": "related recommended recommendations more popular trending teaser",
    "form": "form login signin signup subscribe newsletter search input",
    "meta": "byline author meta date tags tag category",
}
TAG_GROUPS = {
    "article": "article", "main": "main", "section": "section", "div": "div", "p": "p pre blockquote", "heading": "h1 h2 h3 h4 h5 h6", "list": "ul ol dl menu", "item": "li dt dd",
    "nav": "nav", "aside": "aside", "header": "header", "footer": "footer", "form": "form fieldset legend", "table": "table tbody thead tfoot tr td th caption", "figure": "figure figcaption", "other": "address details dialog summary center ins body html",
}
_GROUP = {t: i for i, ts in enumerate(TAG_GROUPS.values()) for t in ts.split()}
_TOKEN = {}
for _i, _ws in enumerate(TOKENS.values()):
    for _w in _ws.split():
        _TOKEN.setdefault(_w, []).append(_i)

_OPEN = re.compile(r"<(?:(!--)|[!?]|(/?)([a-zA-Z][^\s/>]{0,63}))")
_SIGN = re.compile("[>\"']")
_ATTR = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-label|data-label)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


_ENDS = {name: re.compile(f"</{name}(?![a-z0-9-])", re.I) for name in RAW} | {"head": re.compile("</head|<body", re.I)}
_NEXT = {name: re.compile(f"<(/?){name}(?![a-z0-9-])", re.I) for name in FOREIGN}


class Tags:
    """The tags of a source in order. A tag ends at the next > outside quotes; one that has none is text.

    Every place is looked at a bounded number of times: the first sign after a start is kept for the
    next start, the quotes on a way that led to no end are remembered, and after the last > nothing is
    looked for.
    """

    def __init__(self, source: str):
        self.source, self.last = source, source.rfind(">")
        self.seen, self.sign = 0, -1  # from where the first sign was looked for, and its place
        self.dead: set[int] = set()

    def first_sign(self, at: int) -> int:
        if not self.seen <= at <= self.sign:
            m = _SIGN.search(self.source, at)
            self.seen, self.sign = at, m.start() if m else len(self.source)
        return self.sign

    def end_of(self, at: int) -> int:
        """Where the tag whose attributes begin here ends, or -1."""
        way, sign = [], self.first_sign(at) if at <= self.last else self.last + 1
        while sign <= self.last and sign not in self.dead:
            if self.source[sign] == ">":
                return sign
            way.append(sign)
            closed = self.source.find(self.source[sign], sign + 1)
            m = _SIGN.search(self.source, closed + 1) if closed >= 0 else None
            if not m:
                break
            sign = m.start()
        self.dead.update(way)
        return -1

    def after(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """The next tag or comment: start, end, whether it closes, name (none for comments) and attributes."""
        while m := _OPEN.search(self.source, at):
            if not m[3]:
                end = self.source.find("-->" if m[1] else ">", m.end())
                return m.start(), len(self.source) if end < 0 else end + (3 if m[1] else 1), False, "", ""
            end = self.end_of(m.end())
            if end >= 0:
                return m.start(), end + 1, bool(m[2]), m[3].lower(), self.source[m.end() : end]
            at = m.start() + 1
        return None


class Page:
    """Nodes in page order (parents first): block elements and, as leaves, runs of text.

    The content of RAW and FOREIGN elements and of the head is left out. `labelled` reads the labels
    that generated layouts carry; in pages that are served such attributes mean nothing.
    """

    __slots__ = ("tags", "parents", "depths", "tokens", "labels", "texts", "links", "inline")

    def __init__(self, source: str, labelled: bool = False):
        self.tags, self.parents, self.depths, self.tokens, self.labels = ["html"], [-1], [0], [()], [-1]
        self.texts, self.links, self.inline = [""], [0], [0]
        stack: list[tuple[str, int]] = [("html", 0)]  # open elements; inline ones have their block's number
        blocks = [0]  # places of the open block elements in the stack
        open_: dict[str, int] = {"html": 1}  # how many of each are open
        run: list[str] = []
        linked = tags = at = 0
        headed = False

        def end_run() -> None:
            nonlocal run, linked, tags
            text = " ".join("".join(run).split())
            if text:
                self.add("#text", stack[-1][1], (), -1)
                self.texts[-1], self.links[-1], self.inline[-1] = text, linked, tags
            run, linked, tags = [], 0, 0

        def cut(depth: int) -> None:
            for tag, _ in stack[depth:]:
                open_[tag] -= 1
            del stack[depth:]
            while blocks[-1] >= depth:
                blocks.pop()

        signs = Tags(source)
        for start, end, closes, name, attributes in iter(lambda: signs.after(at), None):
            if start > at:
                piece = html.unescape(source[at:start])
                run.append(piece)
                if open_.get("a"):
                    linked += len(piece)
            at = end
            if not name:
                continue
            if closes:
                if name in BLOCKS:
                    end_run()
                if open_.get(name) and name != "html":
                    cut(next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name))
                continue
            if name in RAW or name == "head" and not headed:
                if attributes.endswith("/"):
                    continue
                # An unclosed head ends where the body begins.
                found = _ENDS[name].search(source, at)
                headed = headed or name == "head"
                at = found.start() if found else at if name == "head" else len(source)
                run.append(" ")
                continue
            if name in FOREIGN:
                run.append(" ")
                found = None if attributes.endswith("/") else _NEXT[name].search(source, at)
                at = found.start() if found and found[1] else at
                continue
            if name in BLOCKS:
                end_run()
                if (depth := self.implied(stack, blocks, name)) is not None:
                    cut(depth)
                if name in ("html", "body") and open_.get(name):
                    continue
                if name not in VOID:
                    tokens, label = _tokens(attributes, labelled)
                    self.add(name, stack[-1][1], tokens, label)
                    blocks.append(len(stack))
                    stack.append((name, len(self.tags) - 1))
                    open_[name] = open_.get(name, 0) + 1
            elif name in VOID:
                run.append(" ")
            else:
                tags += 1
                if not attributes.endswith("/"):
                    stack.append((name, stack[-1][1]))
                    open_[name] = open_.get(name, 0) + 1
        if at < len(source):
            run.append(html.unescape(source[at:]))
        end_run()

    def implied(self, stack: list[tuple[str, int]], blocks: list[int], name: str) -> int | None:
        """From where on the start of a block element implies open ones to have ended."""
        for k in range(len(blocks) - 1, 0, -1):
            i = blocks[k]
            tag = stack[i][0]
            if tag == "p" or tag in CLOSES.get(name, ()):
                return i
            if not (tag in ("tbody", "thead") and name == "tr"):
                return None
        return None

    def add(self, tag: str, parent: int, tokens: tuple[int, ...], label: int) -> None:
        self.tags.append(tag)
        self.parents.append(parent)
        self.depths.append(self.depths[parent] + 1)
        self.tokens.append(tokens)
        self.labels.append(label if label >= 0 else self.labels[parent])
        self.texts.append("")
        self.links.append(0)
        self.inline.append(0)


def _tokens(attributes: str, labelled: bool) -> tuple[tuple[int, ...], int]:
    found, label = set(), -1
    if "=" in attributes:
        for name, value in _ATTR.findall(attributes):
            value = value.strip("\"'")
            if name.lower() == "data-label":
                label = int(value) if labelled else label
                continue
            for word in _WORD.findall(value):
                found.update(_TOKEN.get(word.lower(), ()))
    return tuple(found), label


N_TOKENS, N_GROUPS = len(TOKENS), len(TAG_GROUPS) + 1


def features(page: Page) -> np.ndarray:
    """One row per node."""
    n = len(page.tags)
    parents = np.array(page.parents)
    chars = np.array([len(t) for t in page.texts], float)
    stops = np.array([sum(t.count(c) for c in ".,;:!?") if t else 0 for t in page.texts], float)
    links, inline = np.array(page.links, float), np.array(page.inline, float)
    leaf = (chars > 0).astype(float)
    paragraphs = np.array([t == "p" for t in page.tags], float)
    sums = np.stack([chars, stops, links, inline + 1, leaf, paragraphs])
    for i in range(n - 1, 0, -1):
        sums[:, parents[i]] += sums[:, i]
    own = np.zeros((n, N_TOKENS))
    above = np.zeros((n, N_TOKENS))
    group = np.zeros((n, N_GROUPS))
    group_above = np.zeros((n, N_GROUPS))
    order = np.zeros(n)
    count = np.zeros(n)
    for i in range(n):
        p = parents[i]
        group[i, _GROUP.get(page.tags[i], N_GROUPS - 1)] = 1
        for t in page.tokens[i]:
            own[i, t] = 1
        if i:
            above[i] = np.maximum(above[p], own[p])
            group_above[i] = np.maximum(group_above[p], group[p])
            order[i] = count[p]
            count[p] += 1
    safe = np.maximum(sums[0], 1)
    up = np.maximum(parents, 0)
    among = np.maximum(count[up], 1)
    shape = np.stack(
        [
            np.array(page.depths, float),
            np.log1p(sums[0]),
            sums[2] / safe,
            sums[3] / safe * 100,
            sums[1] / safe * 100,
            np.log1p(sums[0] / np.maximum(sums[4], 1)),
            sums[5],
            count,
            order,
            order / among,
            among,
            sums[0] / np.maximum(sums[0][up], 1),
            sums[0] / max(1.0, sums[0][0]),
            np.log1p(sums[0][up]),
            sums[2][up] / safe[up],
        ]
    )
    return np.concatenate([shape.T, own, above, group, group_above], axis=1)


class Boosted:
    """Gradient-boosted trees of fixed depth for a yes-or-no label (logistic loss)."""

    def __init__(self, rounds: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 24):
        self.rounds, self.depth, self.rate, self.bins = rounds, depth, rate, bins
        self.base, self.feature, self.limit, self.leaf = 0.0, [], [], []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        cuts = [c if len(c) > 1 or len(np.unique(x[:, f])) < 2 else np.array([(x[:, f].min() + x[:, f].max()) / 2]) for f, c in enumerate(cuts)]
        used = [f for f, c in enumerate(cuts) if len(c)]
        cuts = [cuts[f] for f in used]
        code = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in zip(used, cuts, strict=True)], axis=1)
        share = y.mean()
        self.base = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
        margin = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            inner = 2**self.depth - 1
            feature, limit, node = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(len(y), int)
            for k in range(inner):
                rows = np.flatnonzero(node == k)
                if len(rows) >= 20:
                    best = self._split(code[rows], g[rows], h[rows], cuts)
                    if best:
                        feature[k], limit[k] = used[best[0]], best[1]
                node[rows] = 2 * k + 1 + (x[rows, feature[k]] > limit[k])
            leaf = np.zeros(inner + 1)
            np.add.at(leaf, node - inner, g)
            weight = np.full(inner + 1, 1.0)
            np.add.at(weight, node - inner, h)
            leaf = self.rate * leaf / weight
            margin += leaf[node - inner]
            self.feature.append(feature)
            self.limit.append(limit)
            self.leaf.append(leaf)
        return self

    def _split(self, code: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray]) -> tuple[int, float] | None:
        """The split of largest gain over all features and bins: one histogram for all of them."""
        n, wide = code.shape[1], self.bins + 1
        slot = (code + np.arange(n) * wide).ravel()
        left_g, left_h = (np.bincount(slot, np.repeat(v, n), n * wide).reshape(n, wide).cumsum(axis=1)[:, :-1] for v in (g, h))
        total_g, total_h = g.sum(), h.sum()
        gain = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1) - total_g**2 / (total_h + 1)
        for f, cut in enumerate(cuts):
            gain[f, len(cut) :] = 0
        f, at = np.unravel_index(int(np.argmax(gain)), gain.shape)
        return (int(f), float(cuts[f][at])) if gain[f, at] > 1e-3 else None

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, limit, leaf in zip(self.feature, self.limit, self.leaf, strict=True):
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            out += leaf[node - len(feature)]
        return out


def decode(parents: list[int], margin: np.ndarray) -> np.ndarray:
    """The likeliest labels among those where everything below a dropped node is dropped."""
    yes, no = -np.logaddexp(0, -margin), -np.logaddexp(0, margin)
    keep, drop = yes.copy(), no.copy()
    for i in range(len(parents) - 1, 0, -1):
        keep[parents[i]] += max(keep[i], drop[i])
        drop[parents[i]] += drop[i]
    out = np.zeros(len(parents), bool)
    out[0] = True  # the page itself
    for i in range(1, len(parents)):
        out[i] = out[parents[i]] and keep[i] > drop[i]
    return out


def main_text(page: Page, kept: np.ndarray) -> str:
    return "\n".join(t for t, k in zip(page.texts, kept.tolist(), strict=True) if k and t)


class Layouts:
    """Pages put together around given sentences, each part with its label."""

    def __init__(self, texts: list[str], seed: int = 7):
        self.r = random.Random(seed)
        self.texts = [t for t in texts if len(t) > 40] or ["Some plain words, that stand for a longer sentence in a page."]

    def words(self, low: int, high: int) -> str:
        w = self.r.choice(self.texts).split()
        n = self.r.randint(low, high)
        at = self.r.randint(0, max(0, len(w) - n))
        return html.escape(" ".join(w[at : at + n]), quote=False)

    def tag(self, choices: str, inner: str, label: int) -> str:
        """choices: alternatives `tag` or `tag.class` or `tag#id`, by white space."""
        name, sign, mark = re.fullmatch(r"(\w+)([.#@]?)(.*)", self.r.choice(choices.split())).groups()
        kind = {".": "class", "#": "id", "@": "role"}.get(sign)
        attr = f' {kind}="{mark.replace("+", " ")}"' if kind else ""
        return f'<{name}{attr} data-label="{label}">{inner}</{name}>'

    def links(self, n: int) -> str:
        items = [f'<a href="/{i}">{self.words(1, 3)}</a>' for i in range(n)]
        return self.r.choice([lambda: "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", lambda: " | ".join(items), lambda: "".join(f"<p>{x}</p>" for x in items)])()

    def paragraphs(self, low: int, high: int, longest: int = 120) -> str:
        r = self.r
        out = []
        for _ in range(r.randint(low, high)):
            kind = r.random()
            text = self.words(1, 6) if kind < 0.15 else self.words(6, longest)
            if kind > 0.93:
                out.append("<ul>" + "".join(f"<li>{self.words(3, 20)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind > 0.88:
                out.append(f"<h2>{self.words(2, 8)}</h2>")
            elif kind > 0.84:
                out.append(f"<blockquote><p>{text}</p></blockquote>")
            elif kind > 0.80:
                out.append(f'<p>{text} <a href="#">{self.words(1, 4)}</a> {self.words(3, 20)}</p>')
            elif kind > 0.7:
                out.append(f"<p><b>{text}<br>")
            else:
                out.append(f"<p>{text}</p>")
        return "".join(out)

    def part(self, kind: str) -> str:
        t, w, r = self.tag, self.words, self.r
        lead = self.paragraphs(1, 3, 40)
        return {
            "menu": lambda: t("nav nav.main-nav div.navbar div.menu ul.nav-menu div#menu div@navigation div.breadcrumbs header.site-header", self.links(r.randint(2, 9)), 0),
            "head": lambda: t("header header.site-header div#header div.masthead div.top-banner div@banner", f"<h1>{w(1, 4)}</h1>" * r.randint(0, 1) + f"<p>{w(2, 12)}</p>", 0),
            "foot": lambda: t("footer footer.site-footer div.footer div#footer div.copyright div@contentinfo", f"&copy; {w(1, 3)} &middot; {w(2, 14)}" + self.links(3) * r.randint(0, 1), 0),
            "side": lambda: t("aside aside.sidebar div.sidebar div#sidebar div.widget section.side-rail", r.choice([self.links(r.randint(3, 8)), lead]), 0),
            "advert": lambda: t("div.ad div.ads div.advert div.ad-slot div.sponsored div#advertisement aside.ad ins.adsbygoogle section.promo", r.choice([w(3, 30), f"<p>{w(3, 40)}</p>"]), 0),
            "notice": lambda: t("div.cookie-notice div.notice div.consent-banner div@alert div#cookie-banner section.alert div.popup", f"<p>{w(5, 40)}</p>", 0),
            "comment": lambda: t("section#comments div.comments div.comment-list div#disqus section.comments ol.comments div.reader-comments", "".join(t("div.comment li.comment article.comment div", f"<p>{w(3, 50)}</p>", 0) for _ in range(r.randint(1, 6))), 0),
            "share": lambda: t("div.share div.social div.share-buttons ul.social-links", self.links(r.randint(2, 5)), 0),
            "related": lambda: t("div.related section.related-posts div.recommended aside.more div.teaser", self.links(r.randint(2, 6)), 0),
            "form": lambda: t("form form.newsletter form#search form.login div.subscribe-form", f"<label>{w(2, 8)}</label><input><p>{w(3, 20)}</p>", 0),
        }[kind]()

    def page(self) -> str:
        r = self.r
        body = self.paragraphs(*r.choice([(1, 1), (1, 3), (2, 6), (5, 25)]), r.choice([15, 40, 120]))
        if r.random() < 0.35:  # something foreign within the article
            cut = [m.start() for m in re.finditer(r"<p>|<h2>", body)] or [0]
            at = r.choice(cut)
            body = body[:at] + self.part(r.choice(["advert", "share", "related", "form", "notice"])) + body[at:]
        title = r.choice([f"<h1>{self.words(2, 12)}</h1>", f"<h1>{self.words(2, 12)}</h1>", f"<header><h1>{self.words(2, 12)}</h1></header>", ""])
        main = self.tag("article article article main article.post main.content div.post-content div#content div.article-body div.entry-content section.story div#main div div.text div.page", title + body, 1)
        if r.random() < 0.3:
            main = main.replace(' data-label="1">', ' data-label="1"><div>', 1) + "</div>" if not main.endswith("</article>") else main[:-10].replace(' data-label="1">', ' data-label="1"><div class="inner">', 1) + "</div></article>"
        before = [self.part(k) for k in r.sample(["menu", "head", "advert", "notice", "side", "form"], r.randint(0, 4))]
        after = [self.part(k) for k in r.sample(["foot", "comment", "related", "side", "advert", "form", "share"], r.randint(0, 4))]
        inner = "".join(before) + main + "".join(after)
        if r.random() < 0.4:
            inner = self.tag("div div.wrapper div#page div.container main section", inner, -1)
        return f'<html><head><title>t</title></head><body>{inner}</body></html>'


def labels_of(page: Page) -> np.ndarray:
    """1 for nodes that are or hold main text."""
    y = np.array(page.labels) == 1
    for i in range(len(y) - 1, 0, -1):
        y[page.parents[i]] |= y[i]
    return y


def train(texts: list[str], layouts: int = LAYOUTS) -> Boosted:
    made = Layouts(texts)
    pages = [Page(made.page(), labelled=True) for _ in range(layouts)]
    return Boosted().fit(np.concatenate([features(p) for p in pages]), np.concatenate([labels_of(p) for p in pages]).astype(float))


def sample_texts(pages: DataFrame, id_col: str, html_col: str) -> list[str]:
    """Texts of the first blocks of SAMPLE pages (least hashes of the id), each of bounded length; they only fill layouts."""
    hashed = pages.select(F.xxhash64(id_col).alias("h"), F.col(html_col).alias("html"))
    # Only hashes are ordered; SAMPLE of them are broadcast.
    least = hashed.select("h").distinct().orderBy("h").limit(SAMPLE)
    rows = hashed.join(F.broadcast(least), "h").groupBy("h").agg(F.min("html").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[t[:CHARS] for t in Page(h or "").texts if t][:TAKEN] for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], names=["h", "texts"])

    return [t for r in sorted(rows.mapInArrow(run, "h long, texts array<string>").collect()) for t in r.texts]


def _parts(sources: list[str]) -> Iterator[list[Page]]:
    """The parsed pages in parts of bounded size."""
    part, nodes = [], 0
    for source in sources:
        page = Page(source)
        part.append(page)
        nodes += len(page.tags)
        if len(part) >= PAGES or nodes >= NODES:
            yield part
            part, nodes = [], 0
    if part:
        yield part


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per page: all columns but html_col, then text, n_chars and n_blocks.

    Null or empty pages give an empty text, repeated rows repeated rows, an empty table no rows.
    Columns named text, n_chars or n_blocks are replaced. Pages of any length and nesting are extracted whole, in time linear in their length.
    """
    model = pages.sparkSession.sparkContext.broadcast(train(sample_texts(pages, id_col, html_col)))
    added = ("text", "n_chars", "n_blocks")
    rest = [c for c in pages.columns if c not in (html_col, *added)]
    rows = pages.select(*(F.col(f"`{c}`") for c in rest), F.coalesce(F.col(html_col), F.lit("")).alias(html_col))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "text string, n_chars long, n_blocks int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = model.value
        for batch in batches:
            at = 0
            for parsed in _parts(batch.column(len(rest)).to_pylist()):
                part, at = batch.slice(at, len(parsed)), at + len(parsed)
                sizes = np.cumsum([0, *(len(p.tags) for p in parsed)])
                margins = trees.margin(np.concatenate([features(p) for p in parsed]))
                kept = [decode(p.parents, margins[a:b]) for p, a, b in zip(parsed, sizes, sizes[1:], strict=False)]
                texts = [main_text(p, k) for p, k in zip(parsed, kept, strict=True)]
                blocks = [sum(1 for t, k in zip(p.texts, ks.tolist(), strict=True) if t and k) for p, ks in zip(parsed, kept, strict=True)]
                columns = [*(part.column(i) for i in range(len(rest))), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(blocks, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=[*rest, *added])

    return rows.mapInArrow(run, schema)
