"""Main-text extraction: gradient-boosted trees over DOM nodes and a hierarchical decoding of their scores.

A page becomes a tree of elements. Nodes that hold text, and their ancestors, get
features: kind of tag, depth, siblings, text and link density of the subtree, attribute
tokens of the node and of its ancestors. Boosted trees (fitted by Spark) score each node.

Names of several words (comment-list, adSlot, no-sidebar, share-price) are read by parts:
where a furniture word stands in the name, and what sort of word stands beside it, say
which of GROUPS the name is in. What a group means is for the trees to learn.

The trees learn from a bounded sample of pages that mark their article (article, main):
text in it is wanted, other text is not; on pages without such a mark, paragraphs and
headings outside bars are wanted, bars are not. These two tags are not among the features. As
few pages name every kind of furniture, each sampled page is also seen again with blocks
put among its paragraphs: its own sentences under a name or in an element that stands
for furniture (not wanted), or under names that only resemble these (wanted); some pages get
a header ahead of the article (not wanted) or lose what is ahead of it, some are wrapped in such an element whole (still wanted).

Decoding chooses which nodes to keep: a kept node's parent is kept, each node kept adds its
score, and each dropped node under a kept one costs CUT. The best choice is found from
the leaves up, so ancestors and descendants never contradict each other. Nothing else
decides on text but that of scripts, styles, controls and the like is not read at all.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, load, text_or_empty

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
RAW = frozenset("script style textarea title noscript template svg iframe select button".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: An open element that a start tag of the named kind closes, up to the nearest of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
CLOSES_P = ({"p"}, {"td", "th", "li", "div", "article", "section", "table"})
BARS = frozenset("nav footer aside form menu dialog".split())
ARTICLE = frozenset("article main".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
#: Words that name page furniture, and those that name content; parts of things; words that turn a name about.
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer form gdpr header login masthead "
    "menu modal nav navbar navigation newsletter notice pagination pager pingback popup promo promoted recommended related reply replies search share sharing sidebar "
    "signup skip social sponsor sponsored subscribe teaser toolbar trackback widget widgets".split()
)
CONTENT = frozenset("article articles body content entry main page post posts story stories text".split())
PARTS = frozenset(
    "area bar block bottom box button buttons card cards column container feed frame grid group holder icon icons inner item items label left link links list module "
    "outer panel region right row section slot slots stack strip thread top tray unit units wrap wrapper zone".split()
)
QUALIFIERS = frozenset("has have hide is no non not show un with without".split())
#: Where a furniture word stands in a name: alone; after a word of another sort; before parts or content; before other words.
GROUPS = ("alone", "qualified", "header_last", "after_content", "after_other", "before_part", "before_other")
#: Groups that are left out of what is learnt from a page's own names: only names put into copies say what they mean.
DOUBTFUL = frozenset(("alone", "after_content", "after_other", "before_part"))

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: The rest of a start tag; a > inside quotes does not end it. Each character is looked at once.
REST = re.compile(r"[^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+>")
ATTRIBUTE = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile(r"[a-z]{2,}")
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")

FEATURES = (
    "paragraph heading item cell box header header_above bar bar_share alone_share qualified_share header_last_share after_content_share after_other_share "
    "before_part_share before_other_share content content_above depth children siblings same_before "
    "own_chars subtree_chars chars_per_tag link_share marks_per_char chars_per_run position page_share"
).split()
CUT = 6.0
NO_SHARE = 2.0  # of features that are shares of the page's text, where there is no such element


class Page:
    """Elements in document order (tag, parent, attribute tokens, place in the source) and the text runs of blocks: (element, text).

    Whatever stands outside html, head and body belongs to an implied body. The time it takes is in proportion to the source:
    a tag whose quotes are not closed ends at the next >, and so do all tags after it; one without any > drops the rest.
    """

    def __init__(self, source: str):
        self.tags, self.parents, self.tokens, self.starts = ["#root"], [-1], [frozenset()], [-1]
        self.link_chars = [0]
        self.runs: list[tuple[int, str]] = []
        self.implied: set[int] = set()
        self._held: list[str] = []
        self._stack, self._blocks, self._depths = [0], [0], {}  # open elements, the block each is in, depths by tag
        at, size, quotes = 0, len(source), True
        while at < size:
            start = source.find("<", at)
            if start < 0 or start + 1 == size:
                self._text(source[at:])
                break
            closing = source[start + 1] == "/"
            name = NAME.match(source, start + 1 + closing)
            if not name and source[start + 1] not in "!?/":  # a plain <
                self._text(source[at : start + 1])
                at = start + 1
                continue
            self._text(source[at:start])
            if not name:
                comment = source.startswith("<!--", start)
                end = source.find("-->" if comment else ">", start + 2)
                at = size if end < 0 else end + (3 if comment else 1)
                continue
            rest = REST.match(source, name.end()) if quotes else None
            quotes = rest is not None
            end = rest.end() if rest else source.find(">", name.end()) + 1
            if not end:
                break
            at, tag = end, name[0].lower()
            if closing:
                self._close(tag)
            elif tag in RAW:
                last = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
                at = (source.find(">", last.end()) + 1 or size) if last else size
                self._held.append(" ")
            elif tag in VOID:
                if tag in BLOCKS:
                    self._flush()
                self._held.append(" " if tag == "br" else "")
            else:
                self._start(tag, source[name.end() : end], start)
        self._flush()
        self._weigh()

    def _weigh(self) -> None:
        n = len(self.tags)
        self.own = [0] * n
        for node, text in self.runs:
            self.own[node] += len(text)
        self.subtree = self.own[:]
        for i in range(n - 1, 0, -1):
            self.subtree[self.parents[i]] += self.subtree[i]

    def _push(self, tag: str, tokens: frozenset, start: int) -> None:
        at = len(self.tags)
        self.tags.append(tag)
        self.parents.append(self._stack[-1])
        self.tokens.append(tokens)
        self.starts.append(start)
        self.link_chars.append(0)
        self._depths.setdefault(tag, []).append(len(self._stack))
        self._stack.append(at)
        self._blocks.append(at if tag in BLOCKS else self._blocks[-1])

    def _cut(self, depth: int) -> None:
        """Closes the elements at depth and below."""
        if any(self.tags[i] in BLOCKS for i in self._stack[depth:]):
            self._flush()
        for i in reversed(self._stack[depth:]):
            self._depths[self.tags[i]].pop()
        del self._stack[depth:], self._blocks[depth:]

    def _deepest(self, tags) -> int:
        return max((self._depths[t][-1] for t in tags if self._depths.get(t)), default=0)

    def _body(self) -> None:
        """An implied body where nothing is open."""
        if len(self._stack) == 1:
            self._push("body", frozenset(), -1)
            self.implied.add(self._stack[-1])

    def _start(self, tag: str, attributes: str, start: int) -> None:
        if tag in BLOCKS:
            self._flush()
            if tag not in ("html", "body"):
                self._pop(*CLOSES_P)
        if tag in CLOSES:
            self._pop(*CLOSES[tag])
        if tag in ("html", "head", "body"):
            if self._stack[-1] in self.implied:
                self._cut(len(self._stack) - 1)
        else:
            self._body()
        if self.tags[self._stack[-1]] == "head":
            self._cut(len(self._stack) - 1)
        found = ATTRIBUTE.findall(attributes) if "=" in attributes else ()
        self._push(tag, frozenset(t for a in found for t in HUMP.sub("-", "".join(a)).lower().split()), start)

    def _close(self, tag: str) -> None:
        if tag in BLOCKS:
            self._flush()
        if depth := self._deepest((tag,)):
            self._cut(depth)

    def _pop(self, which, until) -> None:
        """Closes the innermost open element of which, unless one of until is further in."""
        depth = self._deepest(which)
        if depth and depth > self._deepest(until - which):
            self._cut(depth)

    def _text(self, text: str) -> None:
        if not text:
            return
        if len(self._stack) == 1 and text.strip():
            self._body()
        self._held.append(text)
        if self._depths.get("a"):
            self.link_chars[self._blocks[-1]] += len(text.strip())

    def _flush(self) -> None:
        if self._held:
            text = " ".join(html.unescape("".join(self._held)).split())
            self._held.clear()
            if text:
                self.runs.append((self._blocks[-1], text))


def words(name: str) -> list[str]:
    """The words of a name; two known ones written as one (commentlist) are taken apart."""
    known, out = FURNITURE | CONTENT | PARTS | QUALIFIERS, []
    for word in WORD.findall(name):
        cut = next((i for i in range(2, len(word) - 1) if word[:i] in known and word[i:] in known), 0) if word not in known and len(word) <= 30 else 0
        out += [word[:cut], word[cut:]] if cut else [word]
    return out


@lru_cache(100_000)
def group_of(name: str) -> tuple[int, bool]:
    """Which of GROUPS a name is in (-1: none), and whether it names content."""
    parts = words(name[:200])
    found = [i for i, w in enumerate(parts) if w in FURNITURE]
    if not found:
        return -1, not CONTENT.isdisjoint(parts)
    last = found[-1]
    if not QUALIFIERS.isdisjoint(parts[: found[0]]):
        group = "qualified"
    elif len(parts) == 1:
        group = "alone"
    elif last == len(parts) - 1:
        group = "header_last" if parts[last] == "header" and len(found) == 1 else "after_content" if parts[last - 1] in CONTENT else "after_other"
    else:
        group = "before_part" if all(w in PARTS or w in CONTENT for w in parts[last + 1 :]) else "before_other"
    return GROUPS.index(group), False


def node_features(page: Page) -> tuple[np.ndarray, list[int]]:
    """Features of the elements that hold text or have a descendant that does, and these elements in document order.

    The shares of bars and of the groups of names are those of the page's text in the smallest such element that a node is or is in.
    """
    n = len(page.tags)
    own, subtree, runs, marks = page.own, page.subtree, [0] * n, [0] * n
    for node, text in page.runs:
        runs[node] += 1
        marks[node] += text.count(",") + text.count(".")
    tags, links, depth = [1] * n, page.link_chars[:], [0] * n
    children, before, last = [0] * n, [0] * n, {}
    for i in range(1, n):
        p = page.parents[i]
        depth[i] = depth[p] + 1
        children[p] += 1
        before[i] = last[p, page.tags[i]] = last.get((p, page.tags[i]), -1) + 1
    for i in range(n - 1, 0, -1):
        p = page.parents[i]
        tags[p] += tags[i]
        links[p] += links[i]
        marks[p] += marks[i]
        runs[p] += runs[i]
    total = max(1, subtree[0])
    content, header = [0] * n, [0] * n
    bars, names = [NO_SHARE] * n, [(NO_SHARE,) * len(GROUPS)] * n
    seen, rows, nodes = 0, [], []
    for i in range(1, n):
        p, tag, tokens, s = page.parents[i], page.tags[i], page.tokens[i], subtree[i]
        share, c, names[i] = s / total, 0, names[p]
        for token in tokens:
            group, content_name = group_of(token)
            c += content_name
            if group >= 0:
                names[i] = (*names[i][:group], min(names[i][group], share), *names[i][group + 1 :])
        content[i], header[i] = content[p] + c, header[p] or tag == "header"
        bars[i] = min(bars[p], share) if tag in BARS else bars[p]
        if s:
            rows.append((
                tag == "p", len(tag) == 2 and tag[0] == "h" and tag[1].isdigit(), tag in ("li", "dd", "dt"), tag in ("td", "th"), tag in ("div", "section", "blockquote"),
                tag == "header", header[p], tag in BARS, bars[i], *names[i], c, content[p], depth[i], children[i], children[p], before[i],
                own[i], s, s / tags[i], min(1.0, links[i] / s), marks[i] / s, s / max(1, runs[i]), seen / total, share,
            ))
            nodes.append(i)
        seen += own[i]
    return np.array(rows, np.float32).reshape(len(rows), len(FEATURES)), nodes


def weak_labels(page: Page, nodes: list[int], put: list[tuple[int, int, bool]] = ()) -> list[int]:
    """1: wanted, 0: not, -1: unknown.

    put: the blocks put into the source (start, end, wanted), which say it for what is in them. Else what is in the article is wanted, what is
    outside it is not; unknown are the elements around it, and bars and names of DOUBTFUL groups inside it.
    On a page without an article, bars are not wanted; paragraphs and headings outside them and such names are; the rest is unknown.
    """
    n = len(page.tags)
    inside, around, doubtful, barred, prose, said = [False] * n, [False] * n, [False] * n, [False] * n, [False] * n, [-1] * n
    for i in range(1, n):
        p, tag = page.parents[i], page.tags[i]
        inside[i] = inside[p] or tag in ARTICLE
        barred[i] = barred[p] or tag in BARS
        prose[i] = prose[p] or tag in PROSE
        odd = tag in BARS or any(group >= 0 and GROUPS[group] in DOUBTFUL for group, _ in map(group_of, page.tokens[i]))
        doubtful[i] = doubtful[p] or inside[i] and odd
        said[i] = next((int(wanted) for a, b, wanted in put if a <= page.starts[i] < b), said[p])  # five at most
    for i in range(n - 1, 0, -1):
        around[page.parents[i]] |= around[i] or inside[i]
    if around[0]:
        return [said[i] if said[i] >= 0 else -1 if doubtful[i] else 1 if inside[i] else -1 if around[i] else 0 for i in nodes]
    for i in range(1, n):
        doubtful[i] = doubtful[page.parents[i]] or any(group >= 0 and GROUPS[group] in DOUBTFUL for group, _ in map(group_of, page.tokens[i]))
    return [said[i] if said[i] >= 0 else 0 if barred[i] else 1 if prose[i] and not doubtful[i] else -1 for i in nodes]


def first_tag(source: str, names: str) -> tuple[str, int] | None:
    """The name and the end of the first start tag of one of names (a pattern)."""
    found = re.search(rf"<({names})(?=[\s>])", source, re.I)
    end = source.find(">", found.end()) + 1 if found else 0
    return (found[1], end) if end else None


def invented(rng: random.Random) -> str:
    """A word that is in none of the lists, nor two of them."""
    while True:
        word = "".join(rng.choice("bcdfgklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randrange(2, 5)))
        if group_of(word) == (-1, False) and word not in PARTS | QUALIFIERS:
            return word


def compound(rng: random.Random, wanted: bool) -> str:
    """A name of two words, one of furniture, that stands for furniture or only looks like it."""
    name = rng.choice(sorted(FURNITURE - {"header"}))
    if wanted:
        first, second = rng.choice(((rng.choice(sorted(QUALIFIERS)), name), (name, invented(rng))))
    else:
        other = rng.choice((invented(rng), rng.choice(sorted(CONTENT | PARTS))))
        first, second = rng.choice(((name, rng.choice(sorted(PARTS | CONTENT))), (other, name)))
    return rng.choice((f"{first}-{second}", f"{first}-{second}", f"{first}_{second}", first + second.title()))


def furnished(source: str, seed: int) -> tuple[str, list[tuple[int, int, bool]]] | None:
    """The page with blocks of its own sentences put among its paragraphs, and where these stand and whether they are wanted.

    Those of its article, or of its body where it has none; None without paragraphs there.
    """
    rng = random.Random(seed)
    article, body = first_tag(source, "article|main"), first_tag(source, "body")
    if article and body and body[1] < article[1] and rng.random() < 0.3:  # nothing ahead of the article
        source = source[: body[1]] + source[source.rfind("<", 0, article[1]) :]
        article = first_tag(source, "article|main")
    article = article or body or ("html", 0)
    last = re.search(rf"</{article[0]}(?=[\s>])", source[article[1] :], re.I)
    inside = source[article[1] :][: last.start() if last else None]
    places = [m.start() + article[1] for m in re.finditer(r"<p[\s>]", inside, re.I)]
    sentences = [html.escape(s) for _, run in Page(inside).runs for s in re.split(r"(?<=[.!?]) ", run)]
    if not places or not sentences:
        return None
    names, near = sorted(FURNITURE), ("no-{}", "has-{}", "with-{}", "{}-price", "entry-{}", "un{}")
    blocks = []
    for kind in rng.sample(range(7), 4):
        attribute, tag = rng.choice(("class", "id", "class", "role")), rng.choice(("div", "div", "section", "ul", "ol"))
        said, wanted = [], rng.choice((0, 0, rng.random())) * len(inside)  # from one sentence to half of the page
        while not said or sum(map(len, said)) < wanted:
            said.append(" ".join(rng.choices(sentences, k=rng.randrange(1, 4))))
        inner = "".join(f"<p>{s}</p>" for s in said) if len(said) > 1 or rng.random() < 0.5 else said[0]
        if tag in ("ul", "ol"):
            inner = "".join(f"<li>{s}</li>" for s in said)
        if kind == 0:
            blocks.append((f'<{tag} {attribute}="{rng.choice(["", "box "])}{rng.choice(names)}">{inner}</{tag}>', False))
        elif kind == 1:
            bar = rng.choice(sorted(BARS))
            blocks.append((f"<{bar}>{inner}</{bar}>", False))
        elif kind == 2:
            blocks.append((f'<p class="{rng.choice((rng.choice(names), compound(rng, False)))}">{rng.choice(sentences)}</p>', False))
        elif kind in (3, 4):
            blocks.append((f'<{tag} {attribute}="{rng.choice(["", "box "])}{compound(rng, False)}">{inner}</{tag}>', False))
        elif kind == 5:
            blocks.append((f'<{tag} {attribute}="{compound(rng, True)}">{inner}</{tag}>', True))
        else:
            head = rng.choice(('<header class="{1}-header"><h2>{0}</h2></header>', '<p class="{2}">{0}</p>', "<header><h2>{0}</h2></header>", '<div class="{1}-header">{0}</div>'))
            blocks.append((head.format(rng.choice(sentences), rng.choice(sorted(CONTENT)), compound(rng, True)), True))
    out, put, at = [], [], 0
    length = 0
    for place, (block, wanted) in sorted(zip(rng.choices(places, k=len(blocks)), blocks, strict=True), key=lambda x: x[0]):
        length += place - at
        out += [source[at:place], block]
        put.append((length, length + len(block), wanted))
        at, length = place, length + len(block)
    made = "".join(out) + source[at:]
    body = first_tag(made, "body")
    if body and body[1] < article[1] and article[0].lower() != "body" and rng.random() < 0.5:
        top = rng.choice(("<header>{0}</header>", "<header><p>{0}</p></header>", '<header class="{1}-header">{0}</header>', '<div class="{1}-header">{0}</div>'))
        top = top.format(rng.choice(sentences)[: rng.choice((12, 40, 200))], rng.choice(("site", "page", "top", invented(rng))))
        made = made[: body[1]] + top + made[body[1] :]
        put = [(body[1], body[1] + len(top), False), *((a + len(top), b + len(top), w) for a, b, w in put)]
    if body and rng.random() < 0.4:
        around = rng.choice((
            '<form action="/">', "<form>", f'<div id="page" class="{rng.choice(names)}">', f'<div class="{rng.choice(near).format(rng.choice(names))}">',
            f'<div class="{compound(rng, rng.random() < 0.5)}">',
        ))
        made = made[: body[1]] + around + made[body[1] :]
        put = [(a + len(around), b + len(around), w) if a >= body[1] else (a, b, w) for a, b, w in put]
    return made, put


@dataclass(frozen=True)
class Settings:
    pages: int = 1500  # pages that the trees are fitted on at most
    furnished: int = 600  # furnished copies of them at least, one a page at least
    rounds: int = 20
    depth: int = 5
    seed: int = 5


class Trees:
    """Boosted regression trees as arrays: margin = sum of weight * leaf."""

    def __init__(self, model):
        self.trees = []
        for weight, tree in zip(model.treeWeights, model.trees, strict=True):
            feature, threshold, left, right, value = [], [], [], [], []

            def add(node):
                at = len(feature)
                leaf = node.subtreeDepth() == 0
                feature.append(0 if leaf else node.split().featureIndex())
                threshold.append(np.inf if leaf else node.split().threshold())
                value.append(node.prediction() if leaf else 0.0)
                left.append(at)
                right.append(at)
                if not leaf:
                    left[at], right[at] = add(node.leftChild()), add(node.rightChild())
                return at

            add(tree._java_obj.rootNode())
            self.trees.append((weight, tree.depth, *(np.array(a) for a in (feature, threshold, left, right, value))))

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        rows = np.arange(len(x))
        for weight, depth, feature, threshold, left, right, value in self.trees:
            at = np.zeros(len(x), np.intp)
            for _ in range(depth):
                at = np.where(x[rows, feature[at]] <= threshold[at], left[at], right[at])
            out += weight * value[at]
        return 2 * out


class Markup:
    """Where no page has a paragraph to learn from: a few of the features by hand."""

    def margin(self, x: np.ndarray) -> np.ndarray:
        at = {name: x[:, FEATURES.index(name)] for name in FEATURES}
        small = np.minimum(at["bar_share"], at["alone_share"]) < 0.5
        return 1.0 - 3 * small - 3 * (at["link_share"] > 0.5)


def train(pages: DataFrame, settings: Settings = Settings()):
    s = settings
    sample = bounded_sample(pages.select("page_id", "html"), "page_id", s.pages, s.seed)
    copies = -(-s.furnished // max(1, sample.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = [], []
            for page_id, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                more = [furnished(source, ((page_id or 0) * copies + k) * 31 + s.seed) for k in range(copies)]
                for text, put in ((source, []), *(m for m in more if m)):
                    page = Page(text)
                    rows, nodes = node_features(page)
                    for row, label in zip(rows.tolist(), weak_labels(page, nodes, put), strict=True):
                        if label >= 0:
                            x.append(row)
                            y.append(float(label))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.float64())], names=["x", "label"])

    rows = sample.mapInArrow(run, "x array<double>, label double").select(array_to_vector("x").alias("features"), "label").cache()
    try:
        if rows.select("label").distinct().count() < 2:
            return Markup()
        return Trees(GBTClassifier(maxIter=s.rounds, maxDepth=s.depth, stepSize=0.3, seed=s.seed, cacheNodeIds=False).fit(rows))
    finally:
        rows.unpersist()


def decode(page: Page, nodes: list[int], margins: np.ndarray) -> set[int]:
    """The elements kept: of all sets that hold the root and each member's parent, one with the largest sum of scores less CUT for each node whose parent alone is in it.

    A node's score is its margin, weighed by the text of its own. A page with text in implied bodies alone has one block and
    nothing to choose from: it is kept.
    """
    if all(node in page.implied for node, _ in page.runs):
        return {0} | page.implied
    gain = [0.0] * len(page.tags)
    for i, margin in zip(nodes, margins.tolist(), strict=True):
        gain[i] = margin * (page.own[i] ** 0.5 + 1)
    for i in reversed(nodes):
        gain[page.parents[i]] += max(gain[i], -CUT)
    kept = {0}
    for i in nodes:
        if page.parents[i] in kept and gain[i] > -CUT:
            kept.add(i)
    return kept


def extract(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per row of pages: page_id, url, text (blocks of the article in page order, joined by a line feed), n_chars.

    - null and empty html, and pages without article text: text is empty, n_chars 0;
    - html cut short or badly nested is read as far as it goes; a tag that never ends takes the rest of the page with it;
    - repeated rows give repeated results; null ids and urls are passed on;
    - where no page has a paragraph, there is nothing to learn from, and a few features decide by fixed weights in place of the trees;
    - an empty table gives an empty result; columns other than page_id, url, html are not looked at.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_or_empty("html").alias("html"))
    trees = rows.sparkSession.sparkContext.broadcast(train(rows, settings))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                parsed = [Page(source.as_py()) for source in part.column(2)]
                features = [node_features(page) for page in parsed]
                margins = trees.value.margin(np.concatenate([x for x, _ in features]))
                texts, done = [], 0
                for page, (x, nodes) in zip(parsed, features, strict=True):
                    kept = decode(page, nodes, margins[done : done + len(x)])
                    done += len(x)
                    texts.append("\n".join(text for node, text in page.runs if node in kept))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
                )

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op4_dom_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(load(spark, sf_dir, "pages"))
