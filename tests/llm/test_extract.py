"""Main text: against the article's own blocks, against all choices on small trees, on layouts not learned from, on broken markup."""

import html
import itertools
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from dugout.llm import boost, dom, extract, queries

SMALL = "/root/testdata/sf0.001/pages.parquet"


def blocks(source):
    """The runs of text of a page, in order."""
    forest = dom.Forest()
    forest.add(0, source)
    return forest.text


def plain(page):
    inner = page.partition("<article>")[2].partition("</article>")[0]
    found = (" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", inner))
    return "\n\n".join(b for b in found if b)


@pytest.fixture(scope="module")
def pages():
    return [r["html"] for r in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()]


@pytest.fixture(scope="module")
def model(pages):
    return extract.fit(pages[:150])


def test_query(tmp_path, spark):
    """Null, empty, repeated and very long pages, pages without text, columns of the operator's own names."""
    rows = pq.read_table(SMALL).to_pylist()
    more = [None, "", " ", "<html></html>", rows[3]["html"], rows[4]["html"].replace("</h1>", "</h1>" + "<p>" + "Long words, and more of them. " * 40_000 + "</p>", 1)]
    rows += [{"page_id": 1000 + i, "url": None, "html": x} for i, x in enumerate(more)] + [dict(rows[0]), {"page_id": None, "url": "u", "html": rows[5]["html"]}]
    table = pa.Table.from_pylist([{**r, "Text": "own", "n_chars": "own", "k0": 1} for r in rows])
    pq.write_table(table, tmp_path / "pages.parquet")
    got = queries.op13_html_extraction(spark, str(tmp_path))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    wanted = [(r["page_id"], r["url"], plain(r["html"] or ""), len(plain(r["html"] or ""))) for r in rows]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(wanted, key=str)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT page_id, url, html FROM '{tmp_path}/pages.parquet'")
    assert sorted(con.execute(extract.oracle_sql()).fetchall(), key=str) == sorted(wanted, key=str)


def test_empty(tmp_path, spark):
    pq.write_table(pq.read_table(SMALL).slice(0, 0), tmp_path / "pages.parquet")
    assert queries.op13_html_extraction(spark, str(tmp_path)).collect() == []


def test_given_pages(pages, model):
    assert extract.main_texts(pages[150:], model) == [plain(p) for p in pages[150:]]


def test_other_layouts(pages, model):
    """Layouts drawn anew, of pages that the model hasn't seen."""
    r, parts = random.Random(5), []
    for page in pages[150:]:
        forest = dom.Forest()
        forest.add(0, page)
        assert extract._own_labels(forest)
        parts.append(extract._parts(forest, True))
    right = extra = lost = 0
    for p in parts:
        forest = dom.Forest()
        forest.add(0, page := extract.laid_out(r, p, r.choice(parts)))
        wanted = [t for n, t in zip(forest.runs, forest.text, strict=True) if forest.gold[n] == 1]
        got = extract.main_texts([page], model)[0].split("\n\n")
        right += sum(len(t) for t in got if t in wanted)
        extra += sum(len(t) for t in got if t not in wanted)
        lost += sum(len(t) for t in wanted if t not in got)
    assert right / (right + extra) > 0.97 and right / (right + lost) > 0.99


def test_site_by_hand(model):
    said = "The council voted on Tuesday to keep the old bridge open, after a long debate that drew some two hundred people to the hall."
    page = f"""<!doctype html><html><head><title>t</title><script>if (a < b) document.write("<p>no</p>")</script></head><body>
    <div id="cookie-banner" class="notice">We use cookies to make this site work. <a href=x>Settings</a><button>Accept all</button></div>
    <header class="site-header"><a href="/">The Post</a><nav><ul><li><a href=a>World</a><li><a href=b>Sport</a><li><a href=c>Money</a></ul></nav></header>
    <div class="container"><div class="sidebar"><h3>Most read</h3><ul><li><a href=1>Ten things about rivers</a></li><li><a href=2>Why bridges fall</a></li></ul></div>
    <div class="post-content"><h1>Old bridge &mdash; it stays</h1><p>{said}<p>{said}<div class="ad">Buy   two, get one.</div><p>{said}</p>
    <section class="comments"><h2>Comments</h2><div class="comment"><p>Good. The bridge was built by my grandfather, and I am glad that it stays.</p></div></section></div></div>
    <footer>&copy; The Post</footer></body></html>"""
    assert extract.main_texts([page], model)[0].split("\n\n") == ["Old bridge \N{EM DASH} it stays", said, said, said]


def test_markup():
    assert blocks("a<b>b</b>c <br>d<p>e<p>f<div>g</div>h") == ["abc d", "e", "f", "g", "h"]
    assert blocks("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e") == ["a", "b", "c", "d", "e"]
    assert blocks("<table><tr><td>a<td>b<tr><td>c</table>d") == ["a", "b", "c", "d"]
    assert blocks("x<script>var t='</p>';a<b</script>y<style>p{}</style>z<!-- c <p> -->!<!-->?") == ["xyz!?"]
    assert blocks("<head><title>t<b></title><meta a><noscript>n</noscript></head>a") == ["a"]
    assert blocks("<head><title>t</title><p>a</p>") == ["a"]
    assert blocks("a < b <3 &lt;p&gt; &amp;lt; &#233;&nbsp;e &bogus;") == ["a < b <3 <p> &lt; é e &bogus;"]
    assert blocks("<a title='>'>a</a><p title=\"<p>\">b</p><p class=\"open>c</p>d") == ["a", "b", "c", "d"]
    assert blocks("a<!-- never ends <p>b") == ["a"] and blocks("a<script>never ends") == ["a"] and blocks("a<p") == ["a"]
    assert blocks("<p>a<select><option>b</select>c<button>d</button>e<textarea>f</textarea>") == ["ace"]
    assert blocks("<button>a<p>b</p>c</button>d") == ["d"] and blocks("<p><button>a</p>b") == ["b"]
    assert blocks("</p></div></b>a</br>b</span>") == ["a b"] and blocks("") == [] and blocks(" \n\t<p> </p>") == []


@pytest.mark.parametrize("source", ["<p><b>x" * 20_000, "<div>" * 20_000 + "x", '<a "' * 20_000, "<!--" * 20_000, "<" * 100_000, "<script>" * 20_000, "</p>" * 20_000])
def test_long_and_broken(source, model):
    assert isinstance(extract.main_texts([source], model)[0], str)


def test_decoding_is_the_best_choice():
    """Against every way to keep, drop or leave each element of a small tree."""
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = int(rng.integers(2, 9))
        parent = np.array([-1] + [int(rng.integers(0, i)) for i in range(1, n)])
        depth = np.zeros(n, int)
        for i in range(1, n):
            depth[i] = depth[parent[i]] + 1
        levels = [np.flatnonzero(depth == d) for d in range(depth.max() + 1)]
        runs = np.setdiff1d(np.arange(n), parent)
        chars = np.ones(n)
        score, mixed = rng.normal(size=n), 0.7
        nodes = dom.Nodes(parent, depth, levels, runs, [], chars)
        best = None
        for state in itertools.product((1, -1, 0), repeat=n):
            fits = all(p < 0 or state[p] == 0 or state[p] == state[i] for i, p in enumerate(parent)) and all(state[i] for i in runs)
            if fits:
                value = sum(s * x if s else -mixed for s, x in zip(state, score, strict=True))
                best = max(best or (value, state), (value, state))
        assert dom.decoded(nodes, score, mixed).tolist() == [best[1][i] == 1 for i in runs]


def test_trees():
    """An interaction of a flag and two numbers that no single split tells."""
    rng = np.random.default_rng(1)
    a, b, c = rng.normal(size=4000), rng.normal(size=4000), rng.random(4000) < 0.5
    wanted = ((a > 0.3) ^ (b > 0)) & c
    model = boost.fit([a[:3000], b[:3000], c[:3000], np.zeros(3000)], wanted[:3000].astype(float), np.ones(3000))
    found = model.score([a[3000:], b[3000:], c[3000:], np.zeros(1000)]) > 0
    assert (found == wanted[3000:]).mean() > 0.97
