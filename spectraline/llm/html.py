"""Main text of web pages by a tree-structured graphical model.

The nodes are a page's block elements and its text blocks; each is content or not. A node has a potential from
what is seen of it (tag, role words in class and id; for a text its link share and length together), an edge one
from parent and child. Sum-product messages go up and then down the tree and give each text block's marginal, and
blocks more likely content than not are the text, in page order.

Marks. <article> and <main> stand for content, <nav>, <footer>, <aside>, <form> and the like, `hidden`, and role words
such as `comments` or `advert` (PARTS) stand for what is not, if class and id say nothing else; a <header> inside an article is that
article's own, a <form> with half of the page's text goes around the page. Marks off are evidence: their node is held at not content. If every <article>
and <main> is below some mark off, those marks go; so do all names where they would leave a page empty. Such a word among others (`post about-login`,
`two-column-sidebar`) is a feature, `hint`, with a learnt rate.

Training. A page with an <article> or <main> labels its nodes: what is under it is content, what holds it is on its
path, all else is not; below marks off inside it nothing is said. The marks are therefore no features of the fit: learnt
are the rates of all other tags and role words, of link share with length, and of edges, over all such pages without a cap.
Each rate is PRIOR_SHARE of a prior rate and the rest the counted one, at any number of pages, so that a layout
which the table lacks is still known; without a labelled page priors alone hold. The features are fixed sets, so
the counts' size does not depend on the data.

Edge cases: null or empty html gives the empty text; so does an empty table no row. Unclosed and stray tags are tolerated:
elements whose text is not the page's (HIDE) end at the next block where their end tag is missing, only script, style and
comments run to the end of the page. A page without markup is one block; long pages are used whole; repeated rows give
equal rows; null page_ids stay; further columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
from collections import Counter

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML's element names and words that page authors use for parts.
HIDE = frozenset("title textarea select svg iframe object noscript template".split())
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html label legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
FURNITURE = frozenset("nav header footer aside form button menu dialog fieldset label legend option".split())
MAIN = frozenset("article main".split())
GENERIC = frozenset("html body div section table thead tbody tfoot tr td th ul ol li dl dt dd".split())  # say nothing by themselves
PARTS = frozenset("ad ads advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr login masthead menu menubar modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion related sidebar signup sponsor sponsored subscribe toolbar topbar widget widgets".split())
VAGUE = frozenset("discussion form header reactions reader replies reply respond responses search share sharing skip social tags".split())
ON_WORDS = frozenset("article articlebody body content entry main maincontent post postcontent story text".split())
SHAPES = frozenset("area bar block box button buttons container global group holder icons inner item items left links list main outer page panel right row section site title top wrap wrapper".split())
STATES = frozenset("has no with without open closed is not hide show".split())

PRIOR_SHARE, HELD = 0.25, -30.0
# Prior rates among what is not content and what is, within each group of features.
TAGS = {"p": (0.1, 0.4), "blockquote": (0.02, 0.06), "pre": (0.02, 0.06), "figure": (0.02, 0.03), "figcaption": (0.02, 0.04), "h1": (0.02, 0.06), "h2": (0.04, 0.08), "h3": (0.05, 0.06), "other": (0.1, 0.1)}
ROLES = {"on": (0.02, 0.3), "none": (0.65, 0.65), "vague": (0.25, 0.02), "hint": (0.08, 0.03)}
LINKS, SIZES = ((0.3, 0.72), (0.2, 0.2), (0.5, 0.08)), ((0.35, 0.25), (0.25, 0.25), (0.2, 0.25), (0.2, 0.25))
PRIOR = {f"tag:{k}": v for k, v in TAGS.items()} | {f"role:{k}": v for k, v in ROLES.items()} | {f"text:{i}{j}": (a * c, b * d) for i, (a, b) in enumerate(LINKS) for j, (c, d) in enumerate(SIZES)}
EDGES = {"page": (0.5, 0.001), "part": (0.7, 0.001), "text": (0.95, 0.001), "in": (0.97, 0.001), "words": (0.98, 0.001), "beside": (0.1, 0.001)}  # prior rates of content below content, and below other parts
MAIN_ODDS, ROOT_ODDS = 4.0, 6.0  # log odds of an <article> or <main>, and that a page has content

ATTRIBUTES = r"((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)"
TOKEN = (
    regex
    .compile(
        r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|<(script|style)(?=[\s/>])" + ATTRIBUTES + r"(?:>|\Z).*?(?:</\1(?=[\s/>])[^>]*+>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)" + ATTRIBUTES + r">|</?[a-zA-Z][^<>]*+\Z",
        regex.S | regex.I,
    )
)
WALL = r"body|form|main|html"  # a hidden element that reaches one of these was not closed
MARKS = regex.compile(r"(?:^|[\s/])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", regex.I)
GONE = regex.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", regex.I)
LETTERS = regex.compile(r"[A-Z]?[a-z]+|[A-Z]+")
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ANY_BLOCK = regex.compile(r"</?(?:" + "|".join(sorted(BLOCKS - {"option"})) + r")(?=[\s/>])", regex.I)
ENDS = {t: regex.compile(rf"<(/?)({t}|{WALL})(?=[\s/>])", regex.I) for t in HIDE}


def hidden_end(page: str, tag: str, at: int) -> int:
    """Where the hidden element whose start tag ends at `at` is over."""
    depth = 1
    for m in ENDS[tag].finditer(page, at):
        if m[2].lower() != tag:
            break
        depth += -1 if m[1] else 1
        if not depth:
            end = page.find(">", m.end())
            return len(page) if end < 0 else end + 1
    found = ANY_BLOCK.search(page, at)
    return found.start() if found else len(page)


def role_of(rest: str) -> str:
    """off, hint, vague, on or none, from the class names and ids of a start tag: off only if they say nothing but a part, hint if a part's word is one of others."""
    found = set()
    for m in MARKS.finditer(rest):
        for name in (m[1] or m[2] or m[3] or "").split():
            words = {w.lower() for w in LETTERS.findall(name)}
            if not words or words & STATES:
                continue
            if words & PARTS:
                found.add("off" if words <= PARTS | VAGUE | SHAPES else "hint")
            elif words & VAGUE and words <= VAGUE | SHAPES:
                found.add("vague")
            elif words & ON_WORDS:
                found.add("on")
            elif not words <= SHAPES:
                found.add("other")
    if "off" in found:
        return "on" if "on" in found else "hint" if "other" in found or "hint" in found else "off"
    return next((r for r in ("vague", "on", "hint") if r in found), "none")


class Tree:
    """Nodes in page order: parent, features, whether marked off, whether <article> or <main>, label (None if the page doesn't say); text for text blocks."""

    def __init__(self, page: str) -> None:
        self.parent, self.seen, self.off, self.main, self.top, self.text = [-1], [()], [0], [False], [True], [None]
        self.named, self.form = [False], [False]
        self.stack: list[tuple[str, int]] = [("", 0)]
        self.pieces: list[str] = []
        self.linked, self.link_depth, self.mains = 0, 0, 0
        last = 0
        while m := TOKEN.search(page, last):
            if m.start() > last:
                self.words(page[last : m.start()])
            last = m.end()
            name = m.group(4)
            if name:
                tag = name.lower()
                if tag in HIDE:
                    if not m.group(3) and not (tag == "svg" and m.group(5).endswith("/")):
                        last = hidden_end(page, tag, last)
                else:
                    self.tag(tag, bool(m.group(3)), m.group(5))
        self.words(page[last:])
        self.block()
        n = len(self.parent)
        level = list(map(int, self.off))  # the strongest mark off at a node or above it
        for i in range(1, n):
            level[i] = max(level[i], level[self.parent[i]])
        best = min((x for x, m, o in zip(level, self.main, self.off, strict=True) if m and not o), default=0)
        self.holds = [False] * n  # has an <article> or <main> below it, of those with the weakest mark above
        for i in range(n - 1, 0, -1):
            self.holds[self.parent[i]] |= self.holds[i] or self.main[i] and not self.off[i] and level[i] == best
        self.off = [bool(o) and not h for o, h in zip(self.off, self.holds, strict=True)]
        self.free_forms()
        self.inside = [m and not o for m, o in zip(self.main, self.off, strict=True)]
        for i in range(1, n):
            self.inside[i] |= self.inside[self.parent[i]] and not self.off[i]

    def free_forms(self) -> None:
        """A form that holds at least half of the page's text, marks off inside and outside left out, is no part of the page but around it."""
        n = len(self.parent)
        size, shut = [len(t or "") for t in self.text], self.off[:]
        for i in range(1, n):
            shut[i] = self.off[i] and not self.form[i] or shut[self.parent[i]]
        size = [0 if s else x for s, x in zip(shut, size, strict=True)]
        for i in range(n - 1, 0, -1):
            size[self.parent[i]] += size[i]
        self.off = [o and not (f and 2 * x >= size[0]) for o, f, x in zip(self.off, self.form, size, strict=True)]

    def words(self, raw: str) -> None:
        text = entities.unescape(raw) if "&" in raw else raw
        self.pieces.append(text)
        if self.link_depth:
            self.linked += len(text)

    def block(self) -> None:
        """End the text block at hand."""
        if self.pieces:
            raw = "".join(self.pieces)
            text = " ".join(raw.split())
            if text:
                share, size = self.linked / len(raw), len(text)
                self.node(
                    self.stack[-1][1],
                    (f"text:{0 if share < 0.2 else 1 if share < 0.6 else 2}{0 if size < 25 else 1 if size < 80 else 2 if size < 250 else 3}",),
                    text=text,
                )
            self.pieces, self.linked = [], 0

    def node(self, parent: int, seen: tuple, off: int = 0, main: bool = False, top: bool = False, text: str | None = None, form: bool = False) -> int:
        self.parent.append(parent)
        self.seen.append(seen)
        self.off.append(off)
        self.main.append(main)
        self.top.append(top)
        self.text.append(text)
        self.named.append(off == 1)
        self.form.append(form)
        return len(self.parent) - 1

    def leave(self, depth: int) -> None:
        """Close elements down to the given depth; a link opened inside them, if left open, ends there."""
        for tag, _ in self.stack[depth:]:
            self.mains -= tag in MAIN
        del self.stack[depth:]
        if self.link_depth > depth:
            self.link_depth = 0

    def tag(self, tag: str, closing: bool, rest: str) -> None:
        if tag == "a":
            self.link_depth = 0 if closing else len(self.stack)
        if tag == "br" or tag == "hr":
            self.block()
        if tag not in BLOCKS or tag in VOID:
            return
        self.block()
        if closing:
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i][0] == tag:
                    self.leave(i)
                    break
            return
        if self.stack[-1][0] == "p":
            self.leave(len(self.stack) - 1)
        shut = CLOSES.get(tag)
        while shut and self.stack[-1][0] in shut:
            self.leave(len(self.stack) - 1)
        role = role_of(rest) if rest else "none"
        off = int(role == "off")  # 1: by its name, 2: by its nature
        gone = bool(rest and GONE.search(rest))
        if tag in FURNITURE and not (tag == "header" and self.mains) or gone:
            off = 2
        if tag in ("body", "html"):
            off = 0
        seen = (f"role:{role}",) if role != "off" else ()
        if tag not in GENERIC and tag not in MAIN and tag not in FURNITURE:
            seen = (*seen, f"tag:{tag if tag in TAGS else 'other'}")
        at = self.node(self.stack[-1][1], seen, off, tag in MAIN, tag in ("html", "body"), form=tag == "form" and role != "off" and not gone)
        self.mains += tag in MAIN
        self.stack.append((tag, at))

    def kind(self, i: int) -> str:
        """Edges are counted apart to text blocks, inside an <article> or <main>, beside one, from the whole page, and between other parts."""
        up = self.parent[i]
        if self.text[i] is not None:
            return "words" if self.inside[up] else "text"
        return "in" if self.inside[up] else "beside" if self.holds[up] and not self.holds[i] and not self.main[i] else "page" if self.top[up] else "part"

    def labels(self) -> list:
        """1 under an <article> or <main> and on the path to one, 0 elsewhere, None where nothing is said; all None on a page without."""
        n = len(self.parent)
        if not self.holds[0]:
            return [None] * n
        label = [1] * n
        for i in range(1, n):
            up = self.parent[i]
            if label[up] != 1:
                label[i] = label[up]
            elif self.inside[up]:
                label[i] = None if self.off[i] else 1
            else:
                label[i] = int(self.holds[i] or self.inside[i])
        return label


def counts(page: str) -> Counter:
    """Features by label and edges by labels of one page."""
    tree, out = Tree(page), Counter()
    label = tree.labels()
    for i, y in enumerate(label):
        if i and y is not None:
            for f in tree.seen[i]:
                out[f, y] += 1
            up = label[tree.parent[i]]
            if up is not None and not tree.off[i] and not tree.main[i] and not tree.top[i]:
                out[f"edge:{tree.kind(i)}:{up}", y] += 1
    return out


class Model:
    def __init__(self, total: dict[tuple[str, int], int]) -> None:
        """total: counts over all pages. A feature's weight is the log ratio of its rates in content and elsewhere."""
        group: Counter = Counter()
        for (f, y), n in total.items():
            group[f.split(":")[0], y] += n

        def rate(f: str, y: int) -> float:
            g = f.split(":")[0]
            whole = sum(v[y] for k, v in PRIOR.items() if k.startswith(g))
            own = PRIOR[f][y] / whole
            return own if not group[g, y] else PRIOR_SHARE * own + (1 - PRIOR_SHARE) * total.get((f, y), 0) / group[g, y]

        self.weight = {f: math.log(rate(f, 1) / rate(f, 0)) for f in PRIOR}
        self.edge = {}
        for k, prior in EDGES.items():
            p = []
            for up, own in ((0, prior[1]), (1, prior[0])):
                seen = [total.get((f"edge:{k}:{up}", y), 0) for y in (0, 1)]
                p.append(own if not sum(seen) else PRIOR_SHARE * own + (1 - PRIOR_SHARE) * seen[1] / sum(seen))
            self.edge[k] = 1 - p[0], p[0], 1 - p[1], p[1]

    def marginals(self, tree: Tree) -> list[float]:
        """Log odds of content for each node, by messages up and then down the tree."""
        n, weight, parent = len(tree.parent), self.weight, tree.parent
        edge = [self.edge[tree.kind(i)] for i in range(n)]
        up = [HELD if tree.off[i] else MAIN_ODDS * tree.main[i] + sum(weight[f] for f in tree.seen[i]) for i in range(n)]
        up = [x + ROOT_ODDS * t for x, t in zip(up, tree.top, strict=True)]
        sent = [0.0] * n
        for i in range(n - 1, 0, -1):
            e = math.exp(max(-30.0, min(30.0, up[i])))
            t00, t01, t10, t11 = edge[i]
            sent[i] = 0.0 if tree.off[i] else math.log((t11 * e + t10) / (t01 * e + t00))
            if not tree.off[parent[i]]:
                up[parent[i]] += sent[i]
        for i in range(1, n):
            if tree.off[i]:
                continue
            q = math.exp(max(-30.0, min(30.0, up[parent[i]] - (0.0 if tree.off[parent[i]] else sent[i]))))
            t00, t01, t10, t11 = edge[i]
            up[i] += math.log((t11 * q + t01) / (t10 * q + t00))
        return up

    def text(self, page: str) -> str:
        tree = Tree(page)
        out = self.blocks(tree)
        if not out and any(tree.named):  # names alone leave no page empty
            tree.off = [o and not n for o, n in zip(tree.off, tree.named, strict=True)]
            out = self.blocks(tree)
        return " ".join(out)

    def blocks(self, tree: Tree) -> list[str]:
        """The text blocks more likely content than not."""
        return [t for t, o in zip(tree.text, self.marginals(tree), strict=True) if t is not None and o > 0]


def trained(pages: DataFrame) -> Model:
    """Potentials from all pages that mark their parts; a few hundred counts reach the driver."""

    def put(batches):
        total: Counter = Counter()
        for batch in batches:
            for page in batch.column("html"):
                if page.is_valid:
                    total.update(counts(page.as_py()))
        keys = list(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([f for f, _ in keys], pa.string()), pa.array([y for _, y in keys], pa.int32()), pa.array([total[k] for k in keys], pa.int64())],
            names=["f", "y", "n"],
        )

    rows = pages.select("html").mapInArrow(put, "f string, y int, n long").groupBy("f", "y").agg(F.sum("n").alias("n")).collect()
    return Model({(r.f, r.y): r.n for r in rows})


def main_text(pages: DataFrame, model: Model) -> DataFrame:
    """page_id, url, text, n_chars of each page."""
    held = pages.sparkSession.sparkContext.broadcast(model)

    def put(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [held.value.text(p.as_py() or "") for p in part.column("html")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    return pages.select("page_id", "url", "html").mapInArrow(put, "page_id long, url string, text string, n_chars long")
