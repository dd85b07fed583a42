"""Web pages as trees of block elements and runs of text, many pages in one set of arrays, and what a node's features are."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import numpy as np

#: Fixed values of the HTML format: elements that begin and end a block, those without content, those whose content isn't markup,
#: and those whose text isn't part of what a page says.
BLOCKS = frozenset(
    "html head body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd nav header footer aside form fieldset table caption thead tbody "
    "tfoot tr td th figure figcaption blockquote pre address details summary hgroup center dialog menu search hr noscript".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
HIDDEN = frozenset("head noscript template svg math select button datalist object audio video canvas".split())
#: An element that opens ends an open one of these, if it is found before any of the others named behind it.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    **dict.fromkeys(("tbody", "thead", "tfoot"), ({"tbody", "thead", "tfoot"}, {"table"})),
}

_COMMENT = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"""[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+>""")
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_GOLD = re.compile(r"\sgold=(\d)")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[^\W\dA-Za-z_]+")
_PUNCTUATION = re.compile(r"[.,;:!?]")

#: Kinds of elements that features tell apart; a run of text is a kind too.
KINDS = ("text", "article", "main", "section", "div", "p", "heading", "list", "li", "nav", "header", "footer", "aside", "form", "table", "cell", "figure", "other")
_KIND = {k: i for i, k in enumerate(KINDS)}
_KIND |= {f"h{i}": _KIND["heading"] for i in range(1, 7)} | dict.fromkeys(("ul", "ol", "dl", "menu"), _KIND["list"]) | dict.fromkeys(("dt", "dd"), _KIND["li"])
_KIND |= dict.fromkeys(("td", "th"), _KIND["cell"]) | dict.fromkeys(("fieldset", "dialog", "search"), _KIND["form"]) | {"figcaption": _KIND["figure"]}


def tokens(attributes: str) -> frozenset[str]:
    """Lower-case words of class, id and role."""
    if "=" not in attributes:
        return frozenset()
    return frozenset(w.lower() for m in _ATTRIBUTE.finditer(attributes) for w in _WORD.findall(m[2] or m[3] or m[4] or ""))


class Forest:
    """Nodes of pages, in page order: a parent comes before its children, -1 is no node."""

    def __init__(self):
        self.page: list[int] = []
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.kind: list[int] = []
        self.words: list[frozenset[str]] = []
        self.gold: list[int] = []  # 1 and 0 as marked, or -1; inherited
        self.tags: list[int] = []  # tags opened in this element, or in the run
        self.runs: list[int] = []  # nodes that are text
        self.text: list[str] = []  # of the runs
        self.linked: list[int] = []

    def _node(self, page: int, parent: int, kind: int, words: frozenset[str], gold: int) -> int:
        self.page.append(page)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.kind.append(kind)
        self.words.append(words)
        self.gold.append(gold if gold >= 0 or parent < 0 else self.gold[parent])
        self.tags.append(1)
        return len(self.page) - 1

    def add(self, page: int, source: str) -> None:
        """The page's elements and runs of text. Text in white space only is none."""
        top = self._node(page, -1, _KIND["other"], frozenset(), -1)
        stack: list[tuple[str, int]] = []  # open elements; inline ones that matter have no node
        node, hidden, links = top, 0, 0
        pieces: list[str] = []
        linked = extra = 0
        other, no_words = _KIND["other"], frozenset()

        def flush() -> None:
            nonlocal linked, extra
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                self.runs.append(self._node(page, node, 0, no_words, -1))
                self.tags[-1] += extra
                self.text.append(text)
                self.linked.append(min(linked, len(text)))
            linked = extra = 0

        def pop(to: int) -> None:
            nonlocal node, hidden, links
            while len(stack) > to:
                name, at = stack.pop()
                hidden -= name in HIDDEN
                links -= name == "a"
                if at >= 0:
                    node = self.parent[at]

        pos, size, quoted = 0, len(source), True
        while pos < size:
            at = source.find("<", pos)
            end = size if at < 0 else at
            if end > pos and not hidden:
                piece = html.unescape(source[pos:end])
                pieces.append(piece)
                linked += len(piece) if links else 0
            if at < 0:
                break
            m = _NAME.match(source, at)
            if m is None:
                if source.startswith("<!--", at):
                    pos = _COMMENT.match(source, at).end()
                elif source.startswith(("<!", "<?", "</"), at):
                    pos = source.find(">", at) + 1 or size
                else:  # a bare sign
                    if not hidden:
                        pieces.append("<")
                    pos = at + 1
                continue
            rest = _REST.match(source, m.end()) if quoted else None
            if rest is None:
                quoted = False  # an open quote: from here on a tag ends at the next sign
                pos = source.find(">", m.end()) + 1 or size
            else:
                pos = rest.end()
            name = m[1].lower()
            if source[at + 1] == "/":
                if name in BLOCKS:
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] == name:
                            flush()
                            pop(k)
                            break
                elif name == "br":
                    pieces.append(" ")
                else:
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] == name:
                            pop(k)
                            break
                        if stack[k][1] >= 0:
                            break
                continue
            if name in RAW:
                if name not in ("iframe", "textarea", "title") or not source.startswith("/>", pos - 2):
                    close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(source, pos)
                    pos = close.start() if close else size
                continue
            if name == "br":
                pieces.append(" ")
                extra += 1
            elif name in BLOCKS:
                flush()
                if name == "hr":
                    continue
                if stack:
                    for k in range(len(stack) - 1, -1, -1):  # an open paragraph ends where a block begins
                        if stack[k][0] == "p":
                            pop(k)
                            break
                        if stack[k][1] >= 0:
                            break
                    if name in ENDS:
                        ended, bound = ENDS[name]
                        for k in range(len(stack) - 1, -1, -1):
                            if stack[k][0] in ended:
                                pop(k)
                                break
                            if stack[k][0] in bound:
                                break
                    elif stack and stack[-1][0] == "head" and name not in ("head", "noscript"):
                        pop(len(stack) - 1)
                attributes = source[m.end() : pos]
                gold = _GOLD.search(attributes)
                node = self._node(page, node, _KIND.get(name, other), tokens(attributes), int(gold[1]) if gold else -1)
                stack.append((name, node))
                hidden += name in HIDDEN
            elif name not in VOID:
                extra += 1
                if name == "a" or (name in HIDDEN and not source.startswith("/>", pos - 2)):
                    if name == "a" and links:  # links don't nest
                        for k in range(len(stack) - 1, -1, -1):
                            if stack[k][0] == "a":
                                del stack[k]
                                links -= 1
                                break
                    stack.append((name, -1))
                    hidden += name in HIDDEN
                    links += name == "a"
        flush()


@dataclass
class Nodes:
    """A forest's numbers."""

    parent: np.ndarray
    depth: np.ndarray
    levels: list[np.ndarray]  # the nodes of each depth
    runs: np.ndarray
    features: list[np.ndarray]  # one array a feature
    chars: np.ndarray  # of the subtree


def up(levels: list[np.ndarray], parent: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Sums over subtrees."""
    total = value.astype(np.float64)
    for level in reversed(levels[1:]):
        np.add.at(total, parent[level], total[level])
    return total


def measured(forest: Forest, odds: dict[str, float]) -> Nodes:
    """The features of every node.

    Of the subtree: length, share of linked text, punctuation, digits, mean length of a run, length for each tag (its density), runs.
    Of the place: depth, text before it, share of the page's text. Of the siblings: how many, how many of the same kind, its
    place among them, its share of their text, length and links of those next to it. Of the parent: links, share of text. Of
    the attribute words that ``odds`` knows: the least and the greatest log odds, its own, and its ancestors' too. Kind: its
    own, and those of its ancestors too.
    """
    n = len(forest.page)
    parent, depth, page, kind = (np.array(x, np.int64) for x in (forest.parent, forest.depth, forest.page, forest.kind))
    order = np.argsort(depth, kind="stable")
    levels = np.split(order, np.cumsum(np.bincount(depth))[:-1]) if n else []
    runs = np.array(forest.runs, np.int64)
    spread = lambda values: np.bincount(runs, np.array(values, float), n) if n else np.zeros(0)
    own = spread([len(t) for t in forest.text])
    chars = up(levels, parent, own)
    linked = up(levels, parent, spread(forest.linked))
    points = up(levels, parent, spread([len(_PUNCTUATION.findall(t)) for t in forest.text]))
    digits = up(levels, parent, spread([sum(map(t.count, "0123456789")) for t in forest.text]))
    many = up(levels, parent, spread([1] * len(runs)))
    tags = up(levels, parent, np.array(forest.tags))
    some = np.maximum(chars, 1)
    first = np.flatnonzero(parent < 0)
    whole = np.maximum(chars[first][np.cumsum(parent < 0) - 1], 1) if n else chars
    before = np.cumsum(own) - own
    before -= before[first][np.cumsum(parent < 0) - 1] if n else 0
    # children of one parent stand next to each other in this order, which is page order among them
    among = np.lexsort((np.arange(n), parent))
    same = np.zeros(n, bool)
    same[1:] = (parent[among][1:] == parent[among][:-1]) & (parent[among][1:] >= 0)
    group = np.cumsum(~same) - 1
    starts = np.flatnonzero(~same)
    siblings, at, previous, following, alike = np.empty(n), np.empty(n), np.full(n, -1), np.full(n, -1), np.empty(n)
    siblings[among] = np.bincount(group, minlength=len(starts))[group] if n else 0
    at[among] = np.arange(n) - starts[group]
    previous[among[1:]] = np.where(same[1:], among[:-1], -1)
    following[among[:-1]] = np.where(same[1:], among[1:], -1)
    _, code, count = np.unique(parent * len(KINDS) + kind, return_inverse=True, return_counts=True)
    alike[:] = count[code] if n else 0
    theirs = np.where(parent >= 0, chars[parent], chars)
    links = linked / some
    beside = lambda x, where: np.where(where >= 0, x[where], -1)
    log = np.log1p(chars)
    features = [
        log, links, points / some, digits / some, chars / np.maximum(many, 1), chars / np.maximum(tags, 1), many,
        depth, before / whole, chars / whole, siblings, alike, at / siblings, chars / np.maximum(theirs, 1),
        beside(log, previous), beside(log, following), beside(links, previous), beside(links, following),
        beside(links, parent), beside(chars / whole, parent),
    ]
    known = np.zeros((n, 2))
    for i, words in enumerate(forest.words):
        if words and (said := [odds[w] for w in words if w in odds]):
            known[i] = min(said), max(said)
    marks = np.zeros((n, len(KINDS)), bool)
    marks[np.arange(n), kind] = True
    around, least, most = marks.copy(), known[:, 0].copy(), known[:, 1].copy()
    for level in levels[1:]:
        above = parent[level]
        around[level] |= around[above]
        least[level], most[level] = np.minimum(least[level], least[above]), np.maximum(most[level], most[above])
    features += [*known.T, least, most, *marks.T, *around.T]
    return Nodes(parent, depth, levels, runs, features, chars)


def decoded(nodes: Nodes, score: np.ndarray, mixed: float) -> np.ndarray:
    """Which runs stay, by the best choice that no ancestor contradicts.

    ``score`` is each node's log odds of being main text. A subtree is kept whole, dropped whole, or left to its children at the
    price ``mixed``; kept or dropped whole, every node in it adds its score or takes it off. So the choice for an element and
    those for all within it are one.
    """
    if not len(score):
        return np.zeros(0, bool)
    score = np.where(nodes.chars > 0, score, 0)
    keep = up(nodes.levels, nodes.parent, score)
    leaf = np.zeros(len(score), bool)
    leaf[nodes.runs] = True
    best = np.abs(keep)
    apart = np.zeros(len(score))
    for level in reversed(nodes.levels):
        free = np.where(leaf[level], -np.inf, apart[level] - mixed)
        best[level] = np.maximum(best[level], free)
        within = level[nodes.parent[level] >= 0]
        np.add.at(apart, nodes.parent[within], best[within])
    whole = np.zeros(len(score), np.int8)  # 1 kept, -1 dropped, 0 left to the children
    for level in nodes.levels:
        above = np.where(nodes.parent[level] >= 0, whole[nodes.parent[level]], 0)
        alone = np.where(np.abs(keep[level]) >= best[level], np.where(keep[level] > 0, 1, -1), 0)
        whole[level] = np.where(above != 0, above, alone)
    return whole[nodes.runs] == 1
