"""Main text of pages with and without marks, against what the pages were made from."""

import random

import pytest

from shelfmark.llm import main_text
from shelfmark.llm.main_text import FEATURES, default_tree

PARAGRAPHS = [" ".join(f"word{i}of{j}" for i in range(18)) + "." for j in range(10)]
BODY = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
TEXT = "\n".join(PARAGRAPHS)
LONG = " ".join(f"aside{i}" for i in range(90)) + "."
LINKS = " ".join(f"<a href=/{i}>link{i}</a>" for i in range(90))


def splits(node):
    return set() if node.feature < 0 else {FEATURES[node.feature]} | splits(node.low) | splits(node.high)


def test_the_tree_splits_by_link_density_of_blocks_and_neighbours():
    found = splits(default_tree())
    assert "links" in found and found & {"links_before", "links_after"} and "around" in found


@pytest.mark.parametrize("mark", ["div id=content", "div id=main", 'div class="main-content"', "div role=main", "article", "main", 'div class="post-body"', "div", "section"])
def test_ten_paragraphs_in_any_container(mark):
    name = mark.split()[0]
    menu, foot = f"<nav>{LONG}</nav>", f"<footer>{LONG}</footer>"
    comments = f"<div id=comments><p>{LONG}</p><p>{LONG}</p></div>"
    for page in (f"<{mark}>{BODY}</{name}>", f"{menu}<{mark}>{BODY}</{name}>{comments}{foot}", f"<ul><li>{LINKS}</ul><{mark}>{BODY}</{name}>{foot}"):
        assert main_text.main_text(f"<html><body>{page}</body></html>") == TEXT


def test_linked_lists_and_adverts_inside_an_article():
    page = f"<article>{BODY}<p>{LINKS}</p><div class=adslot>Buy one and get another one for free.</div></article>"
    assert main_text.main_text(page) == TEXT
    linked = "".join(f"<li><a href=x>Read also part {i} of this</a>" for i in range(6))
    assert main_text.main_text(f"<article>{BODY}<ul>{linked}</ul></article>") == TEXT
    heading = "<article><h1><a href=x>A heading that is a link</a></h1>"
    assert main_text.main_text(f"{heading}{BODY}</article>") == "A heading that is a link\n" + TEXT


@pytest.mark.parametrize("tag", ["<div data-u=/x/>", "<div/>", "<span/>", "<div data-u='x'/>"])
def test_a_slash_ends_no_html_element(tag):
    inner = tag[1:].split()[0].split("/")[0].rstrip(">")
    page = f"<div><article>{tag}<p>{PARAGRAPHS[0]}</p></{inner}><p>{PARAGRAPHS[1]}</p></article></div>"
    assert main_text.main_text(page) == "\n".join(PARAGRAPHS[:2])


def test_a_weak_mark_counts_only_where_nothing_else_marks():
    page = f"<div id=content><article>{BODY}</article><p>Some other text that stands beside the article here.</p></div>"
    assert main_text.main_text(page) == TEXT


def test_long_pages_and_many_blocks():
    many = [f"Paragraph number {i} says something that is long enough to be a sentence." for i in range(20_000)]
    assert main_text.main_text("<article>" + "".join(f"<p>{p}" for p in many) + "</article>") == "\n".join(many)
    one = "word " * 400_000 + "end."
    assert main_text.main_text(f"<article><p>{one}</p></article>") == " ".join(one.split())


def made_page(rng):
    """A random page and its main text."""
    def sentence(n):
        return " ".join(rng.choice(("lorem", "ipsum", "dolor", "sit", "amet", "é", "caf&eacute;")) for _ in range(n)) + "."

    shown = [sentence(rng.randrange(12, 90)) for _ in range(rng.randrange(2, 8))]
    parts = [f"<p>{x}" + rng.choice(("</p>", "")) for x in shown]
    for _ in range(rng.randrange(3)):
        parts.insert(rng.randrange(len(parts) + 1), rng.choice(('<div class="ad">Buy now, friends.</div>', "<script>x('<p>')</script>", "<!-- <p>no -->", "<aside>Beside it all.</aside>")))
    mark = rng.choice(("article", "main", 'div class="entry-content"', "div id=content", "article class=post"))
    name = mark.split()[0]
    before = rng.choice(("", "<nav><ul><li><a href=/>Home</a><li><a href=/b>Other</a></ul></nav>", f"<header><p>{sentence(30)}</p></header>", f'<div class="cookie-notice">{sentence(40)}</div>'))
    after = rng.choice(("", f"<footer>{sentence(60)}</footer>", f"<div id=comments><p>{sentence(50)}</p></div>", f'<form><label>Mail</label><input><p>{sentence(9)}</p></form>'))
    page = f"<!doctype html><html><head><title>t</title></head><body>{before}<{mark}>{''.join(parts)}</{name}>{after}</body></html>"
    return page, "\n".join(x.replace("&eacute;", "é") for x in shown)


def test_random_pages_give_what_they_were_made_from(spark):
    rng = random.Random(5)
    pages = [made_page(rng) for _ in range(400)]
    rows = [(i, f"http://x.org/{i}", p, "clash", 3) for i, (p, _) in enumerate(pages)] + [(400, None, None, "", 0), (400, "u", "", "", 0), (7, "u", pages[7][0], "", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int").repartition(3)
    got = main_text.extract_main_text(df).collect()
    assert len(got) == 403 and all(len(r["text"]) == r["n_chars"] for r in got)
    wrong = [r["page_id"] for r in got if r["text"] != (pages[r["page_id"]][1] if r["page_id"] < 400 else "")]
    assert wrong == []
    assert main_text.extract_main_text(df.limit(0)).collect() == []
