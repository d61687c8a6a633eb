"""Wrappers of hosts and the texts they extract."""

import itertools
import json
import random

import pytest

from tidemark.llm import wrapper
from tidemark.llm.wrapper import Node, main_text, slots_of, tokens

SHELL = ("<!DOCTYPE html><html><head><title>T &amp; co</title><style>p{{}}</style><script>var a='</p><article>';</script></head>"
         "<body class='has-sidebar'><header><h1>Site</h1></header><nav><ul><li><a href='/'>Home</a><li><a href='/x'>X</a></ul></nav>"
         "{0}<aside>see also</aside><footer>&copy; us</footer></body></html>")


def learned(pages):
    node = Node.new()
    for page in pages:
        node.align(tokens(page))
    return node


def texts_of(pages):
    slots = slots_of(learned(pages))
    return [main_text(tokens(p), slots) for p in pages]


def test_parts_that_are_none_of_the_article_go():
    article = ("<article><header><h1>Head <em>line</em></h1></header><p>One&nbsp;&lt;two&gt; &amp;amp; caf&eacute;<br>next\n\n line"
               "<p>Second <b>bold<p>third</p><div class='ad-slot'>buy</div><ul><li>a<li>b</ul><form><p>mail<input></form>"
               "<section id='comments'><h2>Comments</h2><article><p>first!</p></article></section><!-- x --></article>")
    assert texts_of([SHELL.format(article)]) == ["Head line\n\nOne <two> &amp; café next line\n\nSecond bold\n\nthird\n\na\n\nb"]


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("   ", ""), ("plain words", "plain words"), ("<p>a<p>b", "a\n\nb"), ("a<div>b</div>c", "a\n\nb\n\nc"),
    ("<script>x", ""), ("<!-- open", ""), ("<p>x <!---> y</p>", "x y"), ("1 < 2 <b", "1 < 2 <b"), ("<p title='a>b'>c</p>", "c"),
    ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n\n2\n\n3"), ("<nav>only a menu</nav>", ""), ("</p></div>x", "x"),
    ("<p>a</br>b</p>", "ab"), ("<P>Up</P><SCRIPT>no</Script>", "Up"), ("&lt;p&gt;", "<p>"), ("<h1>a<h2>b</h1>c", "a\n\nb\n\nc"),
])
def test_odd_pages(page, want):
    assert texts_of([page]) == [want]


def test_deep_and_long_pages():
    deep = "<div>" * 50_000 + "<nav>m</nav><p>inner</p>" + "</div>" * 50_000 + "after"
    assert texts_of([deep]) == ["inner\n\nafter"]
    long = "<article>" + "".join(f"<p>paragraph {k}</p>" for k in range(60_000)) + "</article>"
    assert texts_of([long])[0].count("\n\n") == 59_999
    assert tokens("<a " * 100_000 + "'" * 100_001)


def test_a_wrapper_is_an_expression_with_optional_and_repeated_groups():
    pages = ["<div class=top>x</div><h2>a</h2><p>1</p><p>2</p><h2>b</h2><p>3</p><ul><li>q</ul>",
             "<div class=top>x</div><h2>c</h2><p>4</p><address>z</address>"]
    assert learned(pages).expression() == "div.top[#] (h2[#] p[#]+)+ address[#]? ul[li[#]]?"
    assert learned(pages[1:]).expression() == "div.top[#] h2[#] p[#] address[#]"


def test_hosts_without_marks_are_told_apart_by_what_differs():
    def page(k):
        body = "".join(f"<p>{random.Random(k * 10 + j).random()} " + "word " * 30 + "</p>" for j in range(4))
        return (f"<div class=a1><p>{'About this site and all that it offers to its dear readers. ' * 20}</p></div>"
                f"<div class=b2><h1>Title {k}</h1></div><div class=c3><div>{body}</div></div>"
                f"<div class=d4><ul>" + "".join(f"<li><a href=/{j}>{'another story ' * 9}{k}</a>" for j in range(9)) + "</ul></div>")

    got = texts_of([page(k) for k in range(5)])
    for k, text in enumerate(got):
        assert text.startswith(f"Title {k}\n\n0.") and text.count("\n\n") == 4 and "About" not in text and "story" not in text


def test_wrappers_merge_to_the_same_slots_in_any_order():
    pages = [SHELL.format(f"<article><h1>{k}</h1>" + "<p>x" * (k % 3) + "<h2>s</h2>" * (k % 2) + "<ul><li>i</ul>" * (k % 4 == 3)
                          + "</article>") for k in range(8)]
    whole = learned(pages)
    seen = set()
    for order in itertools.islice(itertools.permutations(range(4)), 0, 24, 5):
        parts = [learned(pages[2 * k:2 * k + 2]) for k in order]
        total = Node.new()
        for part in parts:
            total.merge(Node.unpacked(json.loads(json.dumps(part.packed()))))
        assert slots_of(total) == slots_of(whole) and total.count == whole.count == 8
        slots = slots_of(total)
        seen.add(tuple(main_text(tokens(p), slots) for p in pages))
        assert total.members.keys() == whole.members.keys()
    assert len(seen) == 1


def test_extract(spark):
    body = "<article><h1>T{0}</h1><p>text of {0}</p></article>"
    rows = [(k, f"https://User@Big.example:80/{k}", SHELL.format(body.format(k))) for k in range(200)]
    rows += [(200, None, "<p>x</p>"), (201, "no url", "<p>y</p>"), (202, "http://e.org", None), (202, "http://e.org", ""),
             (None, "http://e.org/", SHELL.format(body.format("n"))), (2**60 + 1, "http://f.org?q", "<main>big id</main>")]
    pages = spark.createDataFrame([(*r, "t", 1, "s") for r in rows], "page_id long, url string, html string, text string, "
                                  "host int, slots string").repartition(13)
    got = sorted(wrapper.extract(pages).collect(), key=str)
    want = [(i, u, f"T{i}\n\ntext of {i}") for i, u, _ in rows[:200]] + [
        (200, None, "x"), (201, "no url", "y"), (202, "http://e.org", ""), (202, "http://e.org", ""),
        (None, "http://e.org/", "Tn\n\ntext of n"), (2**60 + 1, "http://f.org?q", "big id")]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    found = {r["host"]: r for r in wrapper.wrappers(pages, fan=2).collect()}
    assert set(found) == {"big.example", "", "e.org", "f.org"}
    assert found["big.example"]["expression"] == (
        "^header[h1[#]] -nav[ul[li[#]+]] +article[h1[#] p[#]] -aside[#] -footer[#]")
    assert wrapper.extract(pages.where("false")).count() == 0
