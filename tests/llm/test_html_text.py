"""Main-text extraction on pages of known text."""

import math
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphsift.llm import html_text
from graphsift.llm.html_text import main_text

LONG = "A paragraph that is long enough to look like an article, with several words in it."


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title></head><body>{body}</body></html>"


@pytest.mark.parametrize(("html", "text"), [
    (None, ""), ("", ""), ("   ", ""), ("plain", "plain"), ("<p>open <b>bold", "open bold"),
    (page(f"<nav><a href=x>Home</a></nav><article><h1>Title</h1><p>{LONG}</p><p>Second &amp;\n last&nbsp;one</p>"
          "</article><footer>&copy; me</footer>"), f"Title\n{LONG}\nSecond & last one"),
    (page(f"<div class='cookie-notice'><p>We use cookies, many of them, believe us.</p></div><div id=main><p>{LONG}"
          f"<p>{LONG}<div class='comments'><p>{LONG}</p></div></div><div class='ad'>{LONG}</div>"), f"{LONG}\n{LONG}"),
    (page(f"<article><p>{LONG}</p><script>var a='<p>no</p>';</script><form><p>{LONG}</p></form>"
          f"<section class=comments><article class=comment><p>{LONG}</p></article></section></article>"), LONG),
    (page(f"<aside><p>{LONG}</p></aside><div><section><p>{LONG} a</p><p>{LONG} b</p></section><section>"
          f"<p>{LONG} c</p><p>{LONG} d</p></section></div>"), f"{LONG} a\n{LONG} b\n{LONG} c\n{LONG} d"),
    (page(f"<article><p>{LONG}<br>next</p><ul><li>one<li>two</ul><table><tr><td>x<td>y</table></article>"),
     f"{LONG} next\none\ntwo\nx\ny"),
    (page(f"<article><p>a &lt;tag&gt; &#8364; &am</p><!-- <p>hidden</p> --><p hidden>no</p><p>{LONG}</p></article>"),
     f"a <tag> € &am\n{LONG}"),
])
def test_known_pages(html, text):
    assert main_text(html) == text


SOUP = f"""<div><div><a href=1>Home and more</a> <a href=2>Latest news of today</a> <a href=3>All about us</a></div>
    <div><div><span>Only a short line here</span></div></div>
    <div><h2>Title of it</h2><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p><div><p>{LONG} b</p><p>{LONG} c</p></div></div>
    <div>Copyright by some of us</div></div>"""

SOUP_TEXT = "\n".join(["Title of it", LONG, LONG, LONG, f"{LONG} b", f"{LONG} c"])


def brute_best(html):
    """Tag path of the element with the largest density sum, from the formula, node by node."""
    page = html_text._Page(html)
    n = len(page.tag)
    drop, named, _ = html_text._told_apart(page)
    below = [[j for j in range(n) if i in _line(page, j) and not drop[j]] for i in range(n)]
    own = [sum(len(" ".join(html_text.unescape(t).split())) for k, t in page.events if k == i and t and not drop[i])
           for i in range(n)]
    link = [[j for j in below[i] if any(page.tag[k] == "a" for k in _line(page, j))] for i in range(n)]
    chars = [sum(own[j] for j in below[i]) for i in range(n)]
    body = page.tag.index("body") if "body" in page.tag else 0

    def density(i):
        if not chars[i]:
            return 0.0
        tags = max(1, len(below[i]) - 1)
        lc_all = sum(own[j] for j in link[i])
        lt = max(1, sum(page.tag[j] == "a" for j in below[i]))
        share = sum(own[j] for j in link[body]) / max(1, chars[body])
        base = math.log(chars[i] / max(1, chars[i] - lc_all) * lc_all + share * chars[i] + math.e)
        return (chars[i] / tags * max(0.0, math.log(chars[i] / max(1, lc_all) * tags / lt))
                / max(math.log(base), html_text.LEAST_LOG))

    sums = [own[i] + (0 if page.tag[i] in html_text.WHOLE else sum(density(j) for j in below[i] if page.parent[j] == i))
            for i in range(n)]
    best = max((i for i in range(n) if not drop[i] and not named[i]), key=lambda i: (round(sums[i], 6), -i))
    return [page.tag[k] for k in _line(page, best)]


def _line(page, i):
    out = []
    while i >= 0:
        out.append(i)
        i = page.parent[i]
    return out


def chosen(html, monkeypatch):
    """Tag path of what main_text chooses."""
    seen = []
    real = html_text._densities
    monkeypatch.setattr(html_text, "_densities", lambda p, d, t: seen.append((p, d, real(p, d, t))) or seen[-1][2])
    main_text(html)
    page, drop, (_, sums) = seen[-1]
    named = html_text._told_apart(page)[1]
    best = max((i for i in range(len(sums)) if not drop[i] and not named[i]), key=lambda i: (round(sums[i], 6), -i))
    return [page.tag[k] for k in _line(page, best)]


@pytest.fixture(scope="module")
def given_pages(spark):
    return [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect()]


def test_largest_sum_by_brute_force(given_pages, monkeypatch):
    for html in [SOUP, *[h for h in given_pages if h and len(h) < 6000][:60]]:
        assert chosen(html, monkeypatch) == brute_best(html)


def test_density_decides(given_pages, monkeypatch):
    """Without densities, the text of the given pages is another one."""
    right = [main_text(h) for h in given_pages]
    assert main_text(SOUP) == SOUP_TEXT
    monkeypatch.setattr(html_text, "_densities", lambda p, d, t: ([1.0] * len(p.tag), [1.0] * len(p.tag)))
    assert sum(main_text(h) == r for h, r in zip(given_pages, right, strict=True)) < 0.05 * len(right)
    assert main_text(SOUP) != SOUP_TEXT


def test_element_lists_do_not_decide(given_pages, monkeypatch):
    """Without the lists of furniture, density finds the same text on all but a few of the given pages."""
    right = [main_text(h) for h in given_pages]
    for name in ("NOT_CHOSEN", "FURNITURE", "ROLES"):
        monkeypatch.setattr(html_text, name, frozenset())
    assert sum(main_text(h) == r for h, r in zip(given_pages, right, strict=True)) > 0.98 * len(right)


def test_ties_go_to_the_first():
    assert main_text(page(f"<div><p>{LONG} a</p></div><div><p>{LONG} b</p></div>")).startswith(f"{LONG} a")


@pytest.mark.parametrize("parts", [("<div>", "</b>"), ("<b><div>", "<i>", "</b>"), ("<i>", "</p>"), ("<p>",), ("<i>x",),
                                   ("<table>", "<td>x"), ("<ul>", "<li>a", "<article>"), ("<div>x", "</div>"), ('<a "',)])
def test_time_is_linear_in_tags(parts):
    def took(n):
        start = time.process_time()
        main_text("".join(x * n for x in parts))
        return time.process_time() - start
    assert took(100_000) < 60 * max(took(5_000), 0.01)      # 20 times the tags; 400 if quadratic


def test_menus_lose_against_text():
    links = "".join(f"<li><a href=/{i}>a menu entry of some length {i}</a></li>" for i in range(60))
    assert main_text(page(f"<div><ul>{links}</ul></div><div><p>{LONG}</p><p>{LONG}</p></div>")) == f"{LONG}\n{LONG}"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/abp \"'=!-&;\n", max_size=200))
def test_any_text_is_read(html):
    assert "\r" not in main_text(html)


def test_long_and_deep_pages():
    paragraphs = [f"{LONG} {i}" for i in range(3000)]
    assert main_text(page("<article>" + "".join(f"<p>{p}" for p in paragraphs))) == "\n".join(paragraphs)
    assert main_text("<div>" * 50_000 + LONG) == LONG


def test_extract(spark):
    rows = [(1, "u", f"<p>{LONG}", 5), (None, None, None, 6), (1, "u", f"<p>{LONG}", 5)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")
    got = html_text.extract(pages, keep=["url"])
    assert sorted(map(tuple, got.collect()), key=str) == [(1, "u", LONG), (1, "u", LONG), (None, None, "")]
    assert html_text.extract(pages.limit(0)).count() == 0
