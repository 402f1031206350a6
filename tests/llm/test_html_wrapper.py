"""Wrappers on pages whose main texts are known."""

from collections import Counter

import numpy as np
import pytest

from chronofeat.llm import html_wrapper
from chronofeat.llm.html_wrapper import extract, extract_main_text, learn, pattern

WORDS = "red blue green tall small house tree river stone cloud bread music winter letter garden".split()


def prose(rng, n):
    return " ".join(f"{WORDS[i]}{j}" for i, j in zip(rng.integers(0, len(WORDS), n), rng.integers(0, 9, n)))


LEGAL = "All rights are reserved and nothing of this may be copied or sold at all. " * 12
NOTE = "This site is run by volunteers."


def plain_site(rng, i):
    """A page without any telling tag or name, and its body."""
    title, a, b = prose(rng, 5), prose(rng, 40), prose(rng, 50)
    lead = f"<div class='q'>{prose(rng, 12)}</div>" if i % 3 == 0 else ""
    page = f"<html><body><div class='u'><a href='1'>Home</a> | <a href='2'>About</a></div>{lead}<div class='v'><h1>{title}</h1><p>{a}<br>{b}</p><p>{NOTE}</p></div><div class='w'><p>{LEGAL}</p></div></body></html>"
    return page, f"{title} {a} {b}"


def named_site(rng, i):
    body = [prose(rng, 6), *(prose(rng, 30) for _ in range(1 + i % 4))]
    items = [prose(rng, 3) for _ in range(i % 3)]
    comments = "".join(f"<li class='comment'><p>{prose(rng, 60)}</p></li>" for _ in range(i % 5))
    text = "".join(f"<p>{x}</p>" for x in body[1:]) + (f"<ul>{''.join(f'<li>{x}</li>' for x in items)}</ul>" if items else "")
    page = f"<body class='has-sidebar'><nav>{prose(rng, 9)}</nav><div class='layout has-sidebar'><article><header><h1>{body[0]}</h1></header>{text}</article><div class='sidebar'>{prose(rng, 80)}</div></div><ol class='commentlist'>{comments}</ol><footer>{prose(rng, 9)}</footer></body>"
    return page, " ".join([*body, *items])


def site(kind, n, seed=0):
    rng = np.random.default_rng(seed)
    return [kind(rng, i) for i in range(n)]


def shares(pairs):
    """Of words: those of the bodies that were found, and those found that are the bodies'."""
    hit = found = there = 0
    for got, want in pairs:
        a, b = Counter(got.split()), Counter(want.split())
        hit, found, there = hit + (a & b).total(), found + a.total(), there + b.total()
    return hit / there, hit / found


def test_slots_of_the_wrapper_give_the_text():
    pages = site(plain_site, 7)
    wrapper = learn([p for p, _ in pages])
    assert [extract(p, wrapper) for p, _ in pages] == [b for _, b in pages]
    assert all(extract(p) != b for p, b in pages)  # by its own expression alone a page's legal note is most of it


def test_expressions_have_optional_and_repeated_groups_and_slots():
    said = pattern(learn([p for p, _ in site(plain_site, 7)]).root)
    assert "<div>(=)</> <div>(_)</>? <div>(<h1>(_)</> <p>" in said and said.endswith("<div>(<p>(=)</>)</></></></>")
    assert "<ul><li>(_+)+</>+</>?" in pattern(learn([p for p, _ in site(named_site, 7)]).root)


def test_expressions_do_not_depend_on_how_pages_are_dealt():
    pages = [p for p, _ in site(plain_site, 9)]
    one = learn(pages)
    parts = []
    for some in (pages[:4], pages[4:5], pages[5:]):
        w = html_wrapper.expression(html_wrapper.tree(some[0]))
        for p in some[1:]:
            html_wrapper.combine(w, html_wrapper.expression(html_wrapper.tree(p)))
        parts.append(html_wrapper._packed(w, {html_wrapper.digest(p) for p in some}))
    root, different = html_wrapper._joined(parts)
    two = html_wrapper.Wrapper(root, len(different))
    assert [extract(p, one) for p in pages] == [extract(p, two) for p in pages]


@pytest.mark.parametrize("kind", [plain_site, named_site])
def test_bodies_are_found_and_nothing_else(spark, kind):
    pages = {i: x for i, x in enumerate(site(kind, 40, 3))}
    rows = [(i, f"http://{kind.__name__}.org/{i}", p, "x") for i, (p, _) in pages.items()]
    out = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, host string").repartition(5)).collect()}
    recall, precision = shares([(out[i], b) for i, (_, b) in pages.items()])
    assert recall == 1 and precision == 1


@pytest.mark.parametrize("names", ["layout has-sidebar", "post no-comments", "page with-menu", "entry-share ad-free"])
@pytest.mark.parametrize("tag", ["article", "section"])
def test_names_that_only_mention_what_is_no_article(names, tag):
    page = f"<body><nav>menu</nav><div class='{names}'><{tag}><h1>Title</h1><p>Some words here.</p></{tag}></div></body>"
    assert extract(page) == "Title Some words here."


def test_deep_and_long_and_repeated_pages(spark):
    deep = "<body>" + "<div>" * 3000 + "<article><p>deep text</p></article>" + "</div>" * 3000 + "<nav>menu</nav><footer>foot</footer></body>"
    long = "<body><nav>menu</nav><article>" + "".join(f"<p>text {i}</p>" for i in range(40_000)) + "</article><footer>foot</footer></body>"
    rows = [(1, "http://a/1", deep), (2, "http://a/2", long), (3, "http://b/3", long), (3, "http://b/3", long), (4, "http://b/4", long), (5, "http://b/5", long)]
    out = [(r.page_id, r.text, r.n_chars) for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    whole = " ".join(f"text {i}" for i in range(40_000))
    assert Counter(out) == Counter([(1, "deep text", 9), *((i, whole, len(whole)) for i in (2, 3, 3, 4, 5))])


def test_markup_is_read_as_browsers_do():
    assert extract("foo<script>x</script>bar &amp; <b>bold</b>ly <p>a<br>b<ul><li>one<li>two</ul> 1 < 2") == "foobar & boldly a b one two 1 < 2"
    assert extract("<form><article><p>text in a form that is wrapped around it</p></article><input><button>go</button></form>") == "text in a form that is wrapped around it"
