"""Main text of whole pages: omitted tags, wrappers, marks and comments, and density where no tag tells."""

import re

import pyarrow.parquet as pq
import pytest

from veldspar.llm import html_main

PROSE = "Some prose of the page that goes on for a while, with commas and all."
CASES = {
    "head not closed": ("<html><head><meta charset=utf-8><title>T</title><body><article><p>Text here.</p></article>", ["Text here."]),
    "no body, head not closed": ("<head><title>T</title><p>First here.<p>Second one.", ["First here.", "Second one."]),
    "text ends the head": ("<head>stray text<body><p>para</p>", ["stray text", "para"]),
    "noscript in the head": ("<head><noscript><p>enable it</p></noscript><title>x</title></head><body><p>ok text</p>", ["ok text"]),
    "after the body": ("<body><div>x</div></body><p>More text after it.</p></html>tail", ["x", "More text after it.", "tail"]),
    "page-wide form": (f"<body><form><nav><a href=x>a</a></nav><div><p>{PROSE}</p></div></form>", [PROSE]),
    "form around an article": (f"<body><form><article><p>{PROSE}</p></article></form><p>{PROSE}{PROSE}</p>", [PROSE]),
    "search form": (f"<body><form><p>Search <input></p></form><div><p>{PROSE}</p><p>Again.</p></div>", [PROSE, "Again."]),
    "notice beside one paragraph": ("<body><article><div class=promo>Buy this now please.</div><p>One.</p></article>", ["One."]),
    "notice beside nine": ("<body><article><div class=promo>Buy this now please.</div>" + "<p>One.</p>" * 9 + "</article>", ["One."] * 9),
    "all in a notice": ("<body><div class=popup><h1>T</h1><p>All the text.</p><div class=ad>ad</div></div>", ["T", "All the text."]),
    "long comments": ("<body><article><p>Short.</p></article><div id=comments>" + f"<p>{PROSE}</p>" * 5 + "</div>", ["Short."]),
    "comments that are articles": ("<body><div><h1>T</h1><p>Short.</p></div><div id=comments>" + f"<article><p>{PROSE}</p></article>" * 5 + "</div>", ["T", "Short."]),
    "nothing but comments": (f"<body><div class=comments><p>{PROSE}</p></div>", [PROSE]),
    "a box of links in a main": (f"<body><main><div><p>{PROSE}</p></div><div><a href=a>one</a> <a href=b>two</a></div><ul><li><a href=q>ref</a></li></ul></main>", [PROSE, "ref"]),
}


@pytest.mark.parametrize("name", CASES)
def test_page(name):
    page, want = CASES[name]
    assert html_main.main_blocks(page) == want


@pytest.fixture(scope="module")
def pages():
    return [h for h in pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist() if h]


def article_text(page):
    """Blocks of the given pages' one article, by splitting at its block tags."""
    inner = re.sub(r"<!--.*?-->", "", re.search(r"<article>(.*?)</article>", page, re.S)[1], flags=re.S)
    blocks = [re.sub(r"\s+", " ", html_main.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", b)))).strip() for b in re.split(r"</?(?:p|h1|li|ul|div)\b[^>]*>", inner)]
    return [b for b in blocks if b]


def test_given_pages_whole(pages):
    assert all(html_main.main_blocks(p) == article_text(p) for p in pages)


def test_density_alone_finds_the_article(pages, monkeypatch):
    """Without semantic tags and classes, sums and thresholds find it; without densities nothing does."""
    bare = [re.sub(r' class="[^"]*"', "", re.sub(r"<(/?)(article|nav|footer)\b", r"<\1div", p)) for p in pages]
    want = [article_text(p) for p in pages]
    got = [html_main.main_blocks(p) for p in bare]
    assert all(set(w) <= set(g) for g, w in zip(got, want, strict=True))
    assert sum(g == w for g, w in zip(got, want, strict=True)) >= 0.93 * len(pages)
    score = html_main._score

    def without(nodes, body):
        score(nodes, body)
        for n in nodes:
            n.density = n.total = 0.0

    monkeypatch.setattr(html_main, "_score", without)
    assert not any(html_main.main_blocks(p) == w for p, w in zip(bare, want, strict=True))


def test_halves_of_an_article_stay_together():
    half = "<div>" + "".join(f"<p>{PROSE} {i}</p>" for i in range(4)) + "</div>"
    page = f"<body><div><a href=x>menu one</a><a href=y>menu two</a></div><div><h1>Title</h1>{half}{half}</div><div>© us, all rights</div>"
    assert html_main.main_blocks(page) == ["Title", *[f"{PROSE} {i}" for i in range(4)] * 2]
