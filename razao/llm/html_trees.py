"""Operator 4: main text of HTML pages by gradient-boosted trees over DOM-node features.

Each element is a node with features of its subtree (text density, links,
punctuation), its attribute tokens and tag, its depth and its siblings. Trees
give every node a probability of holding main text. The decoding is
hierarchical: the likeliest set of nodes in which every kept node's parent is
kept, by one pass from the leaves up and one down; so no dropped block holds a
kept one.

The trees are fitted on a bounded sample of the pages themselves
(``SAMPLE_PAGES``): of the distinct pages whose article landmark labels their
own nodes, those with the smallest hashes. Each is also rewritten several times
(landmarks renamed to plain boxes with usual class words, menus, notices,
sidebars, forms and comments added), so that the fit doesn't hang on one
template. If none is short enough, fewer longer ones are taken. If no page of
the table labels itself, a warning says so and the trees are fitted on made-up
articles of the pages' own words, rewritten likewise. Everything else reads
every page whole.

Defined results: a null or empty html gives an empty text; markup that isn't
closed ends with the page; repeated rows give repeated rows.
"""

from __future__ import annotations

import html
import logging
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .boosting import Trees, fit
from .common import slices

#: Pages that the trees are fitted on at most, and the longest that takes part; of longer ones the same bytes together.
SAMPLE_PAGES, SAMPLE_BYTES = 96, 100_000
#: How much longer pages may be if no shorter one labels itself.
LONGER = (1, 8, 96)
REWRITES = 4

# How HTML's tags behave.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noembed noframes".split())
HIDDEN = set("script style textarea title noscript iframe xmp noembed noframes head template svg math canvas select option button object audio video datalist".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}, "option": {"option"}}
SCOPE = {"ul": {"li"}, "ol": {"li"}, "dl": {"dt", "dd"}, "table": {"tr", "td", "th", "tbody", "thead", "tfoot"}}
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([A-Za-z][^\s/><]*)((?:[^<>"']++|"[^"]*"|'[^']*')*+)>""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|aria-label|itemprop|data-component|hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Attribute words by what they say of a block.
WORDS = {
    "main": "article articlebody main content post entry body story text prose markdown blog news page detail copy reading",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc topbar tabs pagination pager skip links",
    "header": "header masthead banner top logo brand hero branding",
    "footer": "footer foot bottom copyright legal colophon contentinfo",
    "side": "sidebar aside side rail related recommended recommendations widget widgets trending popular more teaser complementary",
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promotion promoted commercial adsense outbrain taboola",
    "notice": "cookie cookies consent notice popup modal overlay gdpr alert subscribe newsletter signup paywall disclaimer toast dialog",
    "comment": "comment comments reply replies discussion discuss disqus respond responses feedback reviews review thread",
    "form": "form search login register contact input searchform",
    "social": "share sharing social facebook twitter follow like tags meta byline author print",
}
GROUP = {w: g for g, ws in enumerate(WORDS.values()) for w in ws.split()}
TAGS = ["article main", "section", "div", "p", "h1 h2 h3 h4 h5 h6", "ul ol dl menu", "li dt dd", "table tr td th tbody", "nav", "header hgroup", "footer", "aside", "form fieldset", "a", "blockquote pre figure figcaption", "html body"]
TAG_GROUP = {t: g for g, ts in enumerate(TAGS) for t in ts.split()}


class Node:
    __slots__ = ("tag", "attrs", "parent", "items", "kids", "place")

    def __init__(self, tag: str, attrs: str, parent: "Node | None"):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.items: list = []  # strings and nodes, in page order
        self.kids: list[Node] = []


def parse(page: str) -> Node:
    """The element tree; end tags that HTML lets a writer leave out are understood."""
    root = here = Node("#root", "", None)
    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        start = m.start() if m else n
        if start > at:
            here.items.append(html.unescape(page[at:start]))
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            up = here
            while up is not root and up.tag != tag:
                up = up.parent
            if up is not root:
                here = up.parent
            elif tag == "br" or tag == "p":
                here.items.append(" ")
            continue
        if tag in CLOSES_P:
            up = here
            while up is not root and (up.tag in INLINE or up.tag == "p"):
                if up.tag == "p":
                    here = up.parent
                    break
                up = up.parent
        if tag in CLOSED_BY:
            up, stop = here, CLOSED_BY[tag]
            while up is not root and up.tag not in SCOPE:
                if up.tag in stop:
                    here = up.parent
                up = up.parent
        node = Node(tag, m[3], here)
        here.items.append(node)
        here.kids.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            node.items.append(page[at:end.start() if end else n])
            at = end.end() if end else n
        elif tag not in VOID and not m[3].endswith("/"):
            here = node
    return root


def boxes(root: Node) -> list[Node]:
    """The nodes that are decided on, parents first: elements that aren't inline and can be seen.
    An inline element that holds such a node is one as well."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        node.place = len(out)
        out.append(node)
        todo += [k for k in reversed(node.kids) if k.tag not in HIDDEN and k.tag not in VOID and not (k.tag in INLINE and plain(k))]
    return out


def plain(node: Node) -> bool:
    todo = list(node.kids)
    while todo:
        k = todo.pop()
        if k.tag not in INLINE and k.tag not in VOID and k.tag not in HIDDEN:
            return False
        todo += k.kids
    return True


def inline_text(node: Node, out: list[str], link: bool = False) -> int:
    """Appends the text of an inline subtree; how much of it is in links."""
    linked, todo = 0, [(i, link) for i in reversed(node.items)]
    while todo:
        item, inside = todo.pop()
        if isinstance(item, str):
            out.append(item)
            linked += len(item) * inside
        elif item.tag in VOID:
            out.append(" " if item.tag != "wbr" else "")
        elif item.tag not in HIDDEN:
            todo += [(i, inside or item.tag == "a") for i in reversed(item.items)]
    return linked


def segments(nodes: list[Node]) -> list[list]:
    """Each node's own items in page order: ("text", linked length) or the box that stands there."""
    own = []
    inside = {id(n) for n in nodes}
    for node in nodes:
        parts, buffer, linked = [], [], 0
        for item in node.items:
            if isinstance(item, str):
                buffer.append(item)
                linked += len(item) * (node.tag == "a")
            elif id(item) in inside:
                if buffer:
                    parts.append(("".join(buffer), linked))
                    buffer, linked = [], 0
                parts.append(item)
            elif item.tag in VOID:
                buffer.append(" " if item.tag != "wbr" else "")
            elif item.tag not in HIDDEN:
                linked += inline_text(item, buffer, item.tag == "a" or node.tag == "a")
        if buffer:
            parts.append(("".join(buffer), linked))
        own.append(parts)
    return own


NO_MARKS = np.zeros(len(WORDS))


def marks(node: Node) -> tuple[np.ndarray, bool]:
    """Word groups among a node's attribute words; whether it is hidden."""
    if not node.attrs:
        return NO_MARKS, False
    found, hidden = np.zeros(len(WORDS)), False
    for m in ATTRIBUTE.finditer(node.attrs):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "hidden":
            hidden = True
        elif name == "style":
            hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
        else:
            for w in NAME_PART.findall(value):
                if (g := GROUP.get(w.lower())) is not None:
                    found[g] += 1
    return found, hidden


def features(nodes: list[Node], own: list[list]) -> np.ndarray:
    """One row a node: subtree sums by one pass from the last node to the first, the rest from parents to children."""
    n = len(nodes)
    rows = []  # characters, in links, sentence marks, nodes, paragraphs' characters, words that begin upper case
    begin, offset = [], 0
    for node, parts in zip(nodes, own):
        begin.append(offset)
        chars = links = stops = upper = 0
        for part in parts:
            if isinstance(part, tuple):
                text, linked = part
                size = len(text.strip())
                chars += size
                links += min(linked, size)
                stops += text.count(". ") + text.count(", ") + text.endswith(".")
                upper += sum([w[:1].isupper() for w in text.split()]) if size < 200 else 0
        offset += chars
        rows.append((chars, links, stops, 1, chars if node.tag == "p" else 0, upper))
    sums, begin = np.array(rows, float), np.array(begin, float)
    up = np.array([0 if x.parent is None else x.parent.place for x in nodes])
    mark, tags = np.zeros((n, len(WORDS))), np.zeros((n, len(TAGS)))
    known = [(i, TAG_GROUP[x.tag]) for i, x in enumerate(nodes) if x.tag in TAG_GROUP]
    if known:
        tags[tuple(zip(*known))] = 1
    for i, node in enumerate(nodes):
        if node.attrs:
            mark[i] = marks(node)[0]
    place, depth = np.zeros((n, 4)), [0] * n
    for parent in nodes:
        if parent.kids:
            size, same = len(parent.kids), Counter([k.tag for k in parent.kids])
            for j, k in enumerate(parent.kids):
                if hasattr(k, "place"):
                    place[k.place] = size, same[k.tag] / size, j / size, size - j
                    depth[k.place] = depth[parent.place] + 1
    depth = np.array(depth, float)
    above, above_tags = np.zeros_like(mark), np.zeros_like(tags)
    order = np.argsort(depth, kind="stable")
    levels = np.split(order, np.searchsorted(depth[order], np.arange(1, depth.max() + 1)))
    for here in levels[1:]:
        above[here] = above[up[here]] + mark[up[here]]
        above_tags[here] = above_tags[up[here]] + tags[up[here]]
    for here in levels[:0:-1]:
        np.add.at(sums, up[here], sums[here])
    offset = float(offset)
    total, parent = max(sums[0, 0], 1.0), np.maximum(up, 0)
    chars = sums[:, 0]
    shape = np.stack([
        np.log1p(chars), chars / total, chars / np.maximum(sums[parent, 0], 1), sums[:, 1] / np.maximum(chars, 1), sums[:, 2] / np.maximum(chars, 1) * 100,
        np.log1p(chars / sums[:, 3]), np.log1p(sums[:, 3]), sums[:, 4] / np.maximum(chars, 1), sums[:, 5] / np.maximum(chars, 1), depth,
        begin / max(offset, 1.0), (begin + chars) / max(offset, 1.0), sums[parent, 1] / np.maximum(sums[parent, 0], 1),
    ], 1)
    return np.concatenate([shape, place, np.minimum(mark, 2), np.minimum(above, 2), tags, np.minimum(above_tags, 1)], 1)


def decode(p: np.ndarray, up: np.ndarray) -> np.ndarray:
    """The likeliest set of kept nodes whose parents are kept. up: each node's parent, parents first; the root stays."""
    p = np.clip(p, 1e-6, 1 - 1e-6)
    yes, no = np.log(p), np.log1p(-p)
    gone, kept = no.copy(), yes.copy()  # of the whole subtree
    for i in range(len(p) - 1, 0, -1):
        gone[up[i]] += gone[i]
        kept[up[i]] += max(kept[i], gone[i])
    keep = np.ones(len(p), bool)
    for i in range(1, len(p)):
        keep[i] = keep[up[i]] and kept[i] >= gone[i]
    return keep


def spoken(nodes: list[Node], own: list[list], keep: np.ndarray) -> str:
    """The kept text: white space as one space, blocks joined by one."""
    out, todo = [], [(nodes[0], 0)]
    while todo:
        node, at = todo.pop()
        parts = own[node.place]
        while at < len(parts):
            part = parts[at]
            at += 1
            if isinstance(part, tuple):
                out.append(part[0])
            elif keep[part.place]:
                out.append(" ")
                todo += [(node, at), (part, 0)]
                break
            else:
                out.append(" ")
        else:
            out.append(" ")
    return " ".join("".join(out).split())


LANDMARK, NOT_MAIN = {"article", "main"}, {"nav", "aside", "footer", "form"}


def truth(nodes: list[Node]) -> np.ndarray | None:
    """Labels by landmarks: what an article holds is main text, and so is what holds an article. None without one."""
    y, inside = np.zeros(len(nodes)), np.zeros(len(nodes), bool)
    for i, node in enumerate(nodes):
        above = i > 0 and inside[node.parent.place]
        bad = node.tag in NOT_MAIN or marks(node)[0][[WORD_GROUPS.index(g) for g in ("advert", "comment", "notice", "social", "menu", "side")]].any()
        inside[i] = (above or node.tag in LANDMARK) and not bad
    if not inside.any():
        return None
    y[inside] = 1
    for i in range(len(nodes) - 1, 0, -1):
        if y[i] and node_open(nodes[i].parent):
            y[nodes[i].parent.place] = 1
    return y


WORD_GROUPS = list(WORDS)


def node_open(node: Node) -> bool:
    return node.tag not in NOT_MAIN


def rewritten(page: str, rnd: random.Random) -> str:
    """The page with another outside: its article under another name, and blocks added that are not main text.
    Landmarks that only training needs stay readable as data-truth."""
    words = re.sub(r"<[^>]*>", " ", page).split()[:400] or ["word"]

    def some(low: int, high: int) -> str:
        at, n = rnd.randrange(len(words)), rnd.randint(low, high)
        return html.escape(html.unescape(" ".join((words * 2)[at:at + n])).replace("<", " "))

    def named(kind: str, tags: str = "div section") -> str:
        tag, ws = rnd.choice(tags.split()), WORDS[kind].split()
        form = rnd.choice(["{}", "{}-wrap", "site-{}", "{}Box", "block {}", "page__{}", "{}-1"])
        attr = rnd.choice(["class", "class", "id"])
        return f'{tag} {attr}="{form.format(rnd.choice(ws))}"'

    def block(kind: str, body: str, tags: str = "div section") -> str:
        start = named(kind, tags)
        return f"<{start}>{body}</{start.split()[0]}>"

    def lines(tag: str, least: int, most: int, low: int, high: int) -> str:
        return "".join(f"<{tag}>{some(low, high)}</{tag}>" for _ in range(rnd.randint(least, most)))

    def links(least: int, most: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{some(1, 4)}</a></li>' for i in range(rnd.randint(least, most))) + "</ul>"

    extra = {
        "menu": lambda: block("menu", links(3, 10), "div nav ul section"), "side": lambda: block("side", lines("h3", 1, 2, 1, 4) + links(2, 8) + lines("p", 0, 2, 4, 20), "div aside section"),
        "advert": lambda: block("advert", lines("p", 1, 2, 3, 18) if rnd.random() < 0.5 else some(3, 25), "div aside section"), "notice": lambda: block("notice", some(5, 30) + "<button>ok</button>", "div section aside"),
        "comment": lambda: block("comment", lines("h3", 0, 1, 1, 3) + "".join(block("comment", lines("p", 1, 2, 4, 40), "div li article") for _ in range(rnd.randint(1, 5))), "div section ol"),
        "form": lambda: block("form", f"<label>{some(1, 4)}</label><input><button>{some(1, 2)}</button>", "form div"), "social": lambda: block("social", links(2, 5), "div ul"),
        "header": lambda: block("header", some(1, 5) + links(0, 5), "header div"), "footer": lambda: block("footer", "&copy; " + some(2, 15) + links(0, 5), "footer div"),
    }
    page = re.sub(r"<div class=\"ad\">(.*?)</div>", lambda m: block("advert", m[1]), page, flags=re.S) if rnd.random() < 0.5 else page
    page = re.sub(r"<nav>(.*?)</nav>", lambda m: block("menu", m[1]), page, flags=re.S) if rnd.random() < 0.5 else page
    page = re.sub(r"<footer>(.*?)</footer>", lambda m: block("footer", m[1]), page, flags=re.S) if rnd.random() < 0.5 else page
    before = "".join(extra[k]() for k in rnd.sample(["menu", "header", "advert", "notice", "form", "social", "side"], rnd.randint(0, 4)))
    after = "".join(extra[k]() for k in rnd.sample(["side", "advert", "notice", "form", "social", "comment", "footer", "menu"], rnd.randint(0, 5)))
    within = "".join(extra[k]() for k in rnd.sample(["advert", "social", "comment", "notice", "form"], rnd.choice([0, 0, 1, 2])))
    style = rnd.random()
    if style < 0.3:
        start, end = "<article data-truth>", "</article>"
    elif style < 0.85:
        name = named("main", "div section main")
        start, end = f"<{name} data-truth>", f"</{name.split()[0]}>"
    else:
        start, end = "<div data-truth>", "</div>"
    if rnd.random() < 0.4:
        name = rnd.choice(['div class="container"', 'div id="wrapper"', "div", 'div class="row"', 'div class="layout"'])
        start, end = f"<{name}>" + start, end + "</div>"
    page = re.sub(r"<article\b[^>]*>", lambda m: before + start, page, count=1)
    cut = page.rfind("</article>")
    if cut >= 0:
        first, parts = page[:cut].rpartition(start)[::2]
        parts = re.split(r"(?<=</p>)|(?<=</h1>)", parts)
        if rnd.random() < 0.4:  # a short article
            parts = parts[:rnd.randint(1, 4)]
        for _ in range(rnd.choice([0, 0, 1, 2, 4])):  # what an article may hold beside paragraphs
            parts.insert(rnd.randint(1, len(parts)), rnd.choice([
                lambda: "<ul>" + lines("li", 1, 6, 1, 12) + "</ul>", lambda: f"<h2>{some(1, 6)}</h2>", lambda: f"<blockquote>{some(3, 30)}</blockquote>",
                lambda: "<table>" + "".join(f"<tr><td>{some(1, 3)}</td><td>{some(1, 3)}</td></tr>" for _ in range(3)) + "</table>",
                lambda: f"<section><h3>{some(1, 5)}</h3><p>{some(2, 40)}</p></section>", lambda: f"<p>{some(1, 5)}</p>", lambda: f"<pre>{some(2, 20)}</pre>",
                lambda: f'<p>{some(2, 20)} <a href="/x">{some(1, 4)}</a> {some(1, 9)}</p>', lambda: f"<figure><img><figcaption>{some(2, 9)}</figcaption></figure>"])())
        body = "".join(parts)
        page, cut = first + start + body + page[cut:], len(first + start + body)
    return page[:cut] + within + end + after + page[cut + len("</article>"):] if cut >= 0 else page


def example(page: str) -> tuple[np.ndarray, np.ndarray] | None:
    nodes = boxes(parse(page))
    marked = [n for n in nodes if "data-truth" in n.attrs]
    if marked:
        y, top = np.zeros(len(nodes)), marked[0]
        for i, node in enumerate(nodes[1:], 1):
            up, good = node, marks(node)[0][[WORD_GROUPS.index(g) for g in ("advert", "comment", "notice", "social", "menu", "side", "form", "footer", "header")]].sum() == 0 and node.tag not in NOT_MAIN
            while up is not None and up is not top:
                up = up.parent
            y[i] = up is top and (node is top or (good and y[node.parent.place]))
        node = top.parent
        while node is not None:
            y[node.place], node = 1, node.parent
    elif (y := truth(nodes)) is None:
        return None
    return features(nodes, segments(nodes)), y


def labels_itself(page: str) -> bool:
    return truth(boxes(parse(page))) is not None


def made_up(page: str, rnd: random.Random) -> str:
    """An article of the page's visible words, in paragraphs."""
    nodes = boxes(parse(page))
    words = spoken(nodes, segments(nodes), np.ones(len(nodes), bool)).split()
    if not words:
        return ""
    pick = lambda n: html.escape(" ".join((words[a:] + words)[:n] if (a := rnd.randrange(len(words))) else words[:n]))
    return f"<html><body><article><h1>{pick(rnd.randint(2, 8))}</h1>" + "".join(f"<p>{pick(rnd.randint(8, 80))}.</p>" for _ in range(rnd.randint(2, 9))) + "</article></body></html>"


def train(pages: list[str], seed: int = 7) -> Trees | None:
    """Trees from sample pages; None if none of them has a landmark."""
    found, rnd = [], random.Random(seed)
    for page in pages:
        if re.search(r"<article\b", page, re.I) and (e := example(page)):
            found += [e, *(x for _ in range(REWRITES) if (x := example(rewritten(page, rnd))))]
        elif e := example(page):
            found.append(e)
    return fit(np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])) if found else None


def main_texts(pages: list[str | None], trees: Trees | None) -> list[str]:
    made = []
    for page in pages:
        nodes = boxes(parse(page or ""))
        own = segments(nodes)
        made.append((nodes, own, features(nodes, own)))
    if not made:
        return []
    p = trees.probability(np.concatenate([x for _, _, x in made])) if trees else None
    out, at = [], 0
    for nodes, own, x in made:
        up = np.array([0 if n.parent is None else n.parent.place for n in nodes])
        own_p = p[at:at + len(nodes)] if p is not None else np.array([0.1 if n.tag in NOT_MAIN else 0.9 for n in nodes])
        hidden = np.array([marks(n)[1] for n in nodes])
        out.append(spoken(nodes, own, decode(np.where(hidden, 0.0, own_p), up)))
        at += len(nodes)
    return out


def distinct_pages(pages: DataFrame, n: int, usable=None) -> list[str]:
    """Of the distinct texts of ``pages`` (html) for which ``usable`` holds, the ``n`` with the smallest hashes.

    Only the lowest part of the hash range that should hold 2n distinct texts is read as text; it is widened while fewer
    than n are found. So tasks send some n rows together, and copies of a page are one."""
    hashed = pages.where("html is not null").select("html", F.xxhash64("html").alias("h"))
    total = hashed.select("h").distinct().count()
    part = 2 * n / max(total, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([usable(p) for p in b.column(1).to_pylist()], pa.bool_()))

    while total:
        near = hashed if part >= 1 else hashed.where(F.col("h") <= F.lit(int(part * 2 ** 64) - 2 ** 63))
        one = near.groupBy("h").agg(F.min("html").alias("html"))
        found = (one.mapInArrow(run, one.schema) if usable else one).orderBy("h").limit(n).collect()
        if len(found) >= n or part >= 1:
            return [r["html"] for r in found]
        part *= 4
    return []


def fitted(pages: DataFrame) -> Trees | None:
    """Trees for a table of pages (html); None if no page has a word."""
    marked = pages.where(F.col("html").rlike(r"(?i)<(?:article|main)\b"))
    for times in LONGER:
        if sample := distinct_pages(marked.where(F.octet_length("html") <= SAMPLE_BYTES * times), SAMPLE_PAGES // times, labels_itself):
            return train(sample)
    rnd = random.Random(11)
    for times in LONGER:
        sample = distinct_pages(pages.where(F.octet_length("html") <= SAMPLE_BYTES * times), SAMPLE_PAGES // times)
        if made := [m for p in sample if (m := made_up(p, rnd))]:
            logging.getLogger(__name__).warning("no page has an article landmark; the trees are fitted on %d made-up articles", len(made))
            return train(made)
    return None


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row. The trees go to the tasks with the function; they are a few kilobytes."""
    src = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    trees = fitted(src.select("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            texts = main_texts(b.column(2).to_pylist(), trees)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    types = dict(src.dtypes)
    return src.mapInArrow(run, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars bigint")
