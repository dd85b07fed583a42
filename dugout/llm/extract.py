"""Main text of web pages: gradient-boosted trees over DOM nodes, then a choice that no ancestor contradicts.

Every block element and run of text has features of its subtree, its place, its siblings and its attribute words
(``dom.measured``). Trees (``boost``) give its odds of being main text, and ``dom.decoded`` keeps or drops whole subtrees.

Labels come from the pages themselves. What stands in a page's only article or main element, but for menus, asides, forms and
the like in it, is main text. The paragraphs, links and remarks of these pages are also put into other layouts, drawn at
random, whose marks are known: other elements and attribute words around the text, sidebars, notices, adverts, reader
comments. So the trees know more than one site's way to write an article.
"""

from __future__ import annotations

import html
import math
import random
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dugout.llm import boost, dom
from dugout.llm.common import col, map_columns

#: The model is fitted on so many pages at most, of at most so many code points; all pages are extracted, whole.
FIT_PAGES, FIT_CHARS = 240, 30_000
#: Other layouts for each of these pages, how often an attribute word must occur to count, and the price of leaving an element
#: to its children.
LAYOUTS, OFTEN, MIXED = 4, 5, 1.0
SEED = 17

#: How pages name their parts: elements, and attribute words.
ROLES = {
    "article": (("article", "main", "section", "div"), ("content", "post body", "entry content", "article text", "story", "main", "page content", "post", "text", "", "")),
    "nav": (("nav", "div", "ul"), ("menu", "navigation", "nav main", "navbar", "top links", "breadcrumb", "pagination", "tabs", "toc")),
    "header": (("header", "div"), ("header", "site header", "masthead", "topbar", "banner", "branding", "logo")),
    "footer": (("footer", "div"), ("footer", "site footer", "bottom", "copyright", "colophon", "legal")),
    "aside": (("aside", "div", "section"), ("sidebar", "widget", "related", "secondary", "recommended", "popular", "more stories", "teaser", "rail", "share social")),
    "notice": (("div", "section", "dialog"), ("cookie notice", "consent", "gdpr banner", "alert", "notice", "popup", "modal", "message", "disclaimer", "warning", "paywall")),
    "ad": (("div", "aside", "section"), ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "adsbox", "banner ad", "sponsor")),
    "form": (("form", "div", "fieldset"), ("search", "newsletter", "subscribe", "login", "signup", "contact form", "form")),
    "comments": (("section", "div", "ol", "ul"), ("comments", "comment list", "replies", "discussion", "responses", "reader comments", "thread", "disqus")),
}
#: Elements and attribute words that a page's own article or main element doesn't cover.
_OUT = {dom.KINDS.index(k) for k in ("nav", "header", "footer", "aside", "form")}
_OUT_WORDS = frozenset(w for role, (_, names) in ROLES.items() if role != "article" for name in names for w in name.split()) - {"main", "more", "top", "text", "message"}


@dataclass
class Parts:
    """What a page is made of: headings and paragraphs of its main text, links, remarks."""

    prose: list[str] = field(default_factory=list)
    links: list[str] = field(default_factory=list)
    remarks: list[str] = field(default_factory=list)


def _wrapped(r: random.Random, role: str, inner: str, gold: int) -> str:
    elements, names = ROLES[role]
    element, name = r.choice(elements), r.choice(names)
    if element not in ("div", "section", "ol", "ul") and r.random() < 0.5:
        name = ""  # the element tells
    said = f' {r.choice(("class", "class", "id"))}="{name if r.random() < 0.5 else name.replace(" ", "-")}"' if name else ""
    return f"<{element}{said} gold={gold}>{inner}</{element}>"


def laid_out(r: random.Random, parts: Parts, others: Parts) -> str:
    """One page with the prose of ``parts`` as its marked main text, in a layout drawn at random; the rest from ``others`` too."""
    text = html.escape
    pick = lambda some, n: [r.choice(some) for _ in range(n)] if some else []
    links = parts.links + others.links or ["Home"]
    remarks = parts.remarks + others.remarks or ["Thanks."]
    sentences = [" ".join(s.split()[: r.randint(4, 60)]) for s in pick(others.prose or remarks, 12)]

    def menu(n: int) -> str:
        made = [f'<a href="/{i}">{text(x)}</a>' for i, x in enumerate(pick(links, n))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in made) + "</ul>" if r.random() < 0.7 else r.choice((" | ", " ", "<br>")).join(made)

    def remark(n: int = 2) -> str:
        return "".join(f"<p>{text(x)}</p>" if r.random() < 0.6 else text(x) + " " for x in pick(remarks + sentences, r.randint(1, n)))

    def comments() -> str:
        said = [f'<div class="comment"><b>{text(r.choice(links))}</b><p>{text(s)}</p></div>' if r.random() < 0.6 else f"<li>{text(s)}</li>" for s in r.sample(sentences, r.randint(1, len(sentences)))]
        return _wrapped(r, "comments", ("<h3>Comments</h3>" if r.random() < 0.5 else "") + "".join(said), 0)

    def aside() -> str:
        return _wrapped(r, "aside", ("<h3>" + text(r.choice(links)) + "</h3>" if r.random() < 0.6 else "") + (menu(r.randint(2, 8)) if r.random() < 0.6 else remark(4)), 0)

    def form() -> str:
        return _wrapped(r, "form", f"<label>{text(r.choice(links))}</label><input name=q>" + (remark(1) if r.random() < 0.5 else "") + "<button>Go</button>", 0)

    def insert() -> str:
        return r.choice((lambda: _wrapped(r, "ad", remark(), 0), aside, form, lambda: _wrapped(r, "notice", remark(), 0), lambda: _wrapped(r, "nav", menu(3), 0)))()

    body, prose = [], parts.prose
    if r.random() < 0.3:  # a short one
        first = r.randrange(len(prose))
        prose = [" ".join(x.split()[: r.randint(3, 40)]) for x in prose[first : first + r.randint(1, 3)]]
    for i, x in enumerate(prose):
        short = len(x) < 90
        element = "h1" if i == 0 and short else r.choice(("h2", "h3", "p", "p")) if short else r.choices(("p", "blockquote", "div", "li"), (12, 1, 2, 1))[0]
        inner = f"<b>{text(x)}</b>" if r.random() < 0.1 else f"<a href='/x'>{text(x[:20])}</a>{text(x[20:])}" if r.random() < 0.15 else text(x)
        made = f"<{element} gold=1>{inner}</{element}>"
        body.append(f"<ul gold=1>{made}</ul>" if element == "li" else made)
        if r.random() < 0.12:
            body.append(insert())
    ends = [f for f in (comments, aside, form, lambda: _wrapped(r, "nav", menu(4), 0)) if r.random() < 0.35]
    inside = r.random() < 0.3
    article = _wrapped(r, "article", "".join(body) + ("".join(f() for f in ends) if inside else ""), 1)
    around = "" if inside else "".join(f() for f in ends)
    head = [_wrapped(r, "header", f"<div>{text(r.choice(links))}</div>" + (menu(4) if r.random() < 0.5 else ""), 0)] if r.random() < 0.6 else []
    head += [_wrapped(r, "nav", menu(r.randint(3, 12)), 0)] if r.random() < 0.8 else []
    head += [insert() for _ in range(r.randint(0, 2))]
    foot = [insert()] if r.random() < 0.4 else []
    foot += [_wrapped(r, "footer", remark() + (menu(4) if r.random() < 0.5 else ""), 0)] if r.random() < 0.85 else []
    middle = aside() + article + around if r.random() < 0.3 else article + around + (aside() if r.random() < 0.5 else "")
    for _ in range(r.randint(0, 2)):
        middle = f'<div class="{r.choice(("container", "wrapper", "row", "page", "col", ""))}">{middle}</div>'
    return f"<html><head><title>{text(prose[0] if prose else '')}</title></head><body>{''.join(head)}{middle}{''.join(foot)}</body></html>"


def _own_labels(forest: dom.Forest) -> bool:
    """Marks a page's nodes by its only article or main element; false if there is no such one."""
    roots = [i for i, k in enumerate(forest.kind) if dom.KINDS[k] in ("article", "main")]
    roots = [i for i in roots if forest.parent[i] not in roots]
    if len(roots) != 1:
        return False
    gold = [0] * len(forest.kind)
    gold[roots[0]] = 1
    for i in range(roots[0] + 1, len(gold)):
        gold[i] = int(gold[forest.parent[i]] and forest.kind[i] not in _OUT and not forest.words[i] & _OUT_WORDS)
    forest.gold = gold
    return True


def _parts(forest: dom.Forest, marked: bool) -> Parts:
    found = Parts()
    for node, text, linked in zip(forest.runs, forest.text, forest.linked, strict=True):
        if linked * 2 > len(text):
            found.links.append(text)
        elif forest.gold[node] == 1 if marked else len(text) > 120:
            found.prose.append(text)
        else:
            found.remarks.append(text)
    return found


@dataclass
class Model:
    trees: boost.Trees
    odds: dict[str, float]  # of attribute words, in logs


def fit(pages: list[str]) -> Model | None:
    """A model of these pages; none if they have no text."""
    r = random.Random(SEED)
    marked, parts = [], []
    for page in pages:
        forest = dom.Forest()
        forest.add(0, page)
        if own := _own_labels(forest):
            marked.append(page)
        parts.append(_parts(forest, own))
    parts = [p for p in parts if p.prose]
    if not parts:
        return None
    together, number = dom.Forest(), 0
    gold: list[int] = []
    for page in marked:
        before = len(together.page)
        together.add(number, page)
        forest = dom.Forest()
        forest.add(0, page)
        _own_labels(forest)
        gold += forest.gold
        assert len(gold) == len(together.page) > before
        number += 1
    for p in parts:
        for _ in range(LAYOUTS):
            together.add(number, laid_out(r, p, r.choice(parts)))
            gold += together.gold[len(gold) :]
            number += 1
    words: dict[str, list[int]] = {}
    mark = np.array(gold)
    for some, g in zip(together.words, gold, strict=True):
        for w in some:
            words.setdefault(w, [0, 0, 0])[g] += 1
    odds = {w: math.log((yes + 0.5) / (no + 0.5)) for w, (no, yes, neither) in words.items() if no + yes + neither >= OFTEN}
    nodes = dom.measured(together, odds)
    is_run = np.zeros(len(mark), bool)
    is_run[nodes.runs] = True
    inside = dom.up(nodes.levels, nodes.parent, np.where(is_run, nodes.chars * (mark == 1), 0)) / np.maximum(nodes.chars, 1)
    pure = (nodes.chars > 0) & ((inside == 0) | (inside == 1))  # what holds both is left to its children
    features = [f[pure] for f in nodes.features]
    return Model(boost.fit(features, inside[pure].astype(float), 1 + 0.2 * np.log1p(nodes.chars[pure])), odds)


def learn(pages: DataFrame, html_col: str = "html") -> Model | None:
    """A model fitted on FIT_PAGES pages of at most FIT_CHARS code points: those of the least hashes."""
    x = col(html_col).alias("html")
    short = pages.select(x).filter((F.length("html") > 0) & (F.length("html") <= FIT_CHARS))
    some = short.orderBy(F.xxhash64("html"), "html").limit(FIT_PAGES).collect()
    return fit([r["html"] for r in some])


def main_texts(pages: list[str], model: Model) -> list[str]:
    """The main text of each page: its blocks, two line ends between."""
    forest = dom.Forest()
    for i, page in enumerate(pages):
        forest.add(i, page)
    nodes = dom.measured(forest, model.odds)
    score = np.clip(model.trees.score(nodes.features), -6, 6)
    score[nodes.runs] *= np.log1p(nodes.chars[nodes.runs]) / 3
    found: list[list[str]] = [[] for _ in pages]
    for k in np.flatnonzero(dom.decoded(nodes, score, MIXED)):
        found[forest.page[forest.runs[k]]].append(forest.text[k])
    return ["\n\n".join(blocks) for blocks in found]


def extract(pages: DataFrame, keep: list[str] | None = None, html_col: str = "html", model: Model | None = None) -> DataFrame:
    """``keep`` (all by default) and the main text of every page: text, n_chars.

    A null or empty page, and one without main text, has an empty text. Pages are whole however long. Repeated pages have the
    same text each. A kept column named as one of the two, in any case, is replaced. Character references are decoded; white
    space within a block becomes one space. Without a model one is learned from these pages; of a table without any text all
    texts are empty.
    """
    model = model or learn(pages, html_col)
    made = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def worker():
        def work(column: pa.Array):
            pages = [x or "" for x in column.to_pylist()]
            texts = main_texts(pages, model) if model else [""] * len(pages)
            return texts, [len(t) for t in texts]

        return work

    return map_columns(pages, worker, made, [html_col], keep)


def oracle_sql() -> str:
    """The same for pages whose article element holds headings and paragraphs only, as those of ``pages`` do."""
    plain = "regexp_replace(replace(b, '<br>', ' '), '<[^>]*>', '', 'g')"
    for reference, sign in (("&amp;?", "chr(1)"), ("&quot;", "chr(34)"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&#x27;", "chr(39)"), ("\x01", "'&'")):
        plain = f"regexp_replace({plain}, '{reference}', {sign}, 'g')"
    return f"""SELECT page_id, url, text, length(text) AS n_chars FROM (
  SELECT page_id, url, coalesce(array_to_string(list_filter(list_transform(regexp_split_to_array(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '</?(?:p|h1)>'),
    lambda b: trim(regexp_replace({plain}, '\\s+', ' ', 'g'))), lambda b: b <> ''), chr(10) || chr(10)), '') AS text FROM pages)"""
