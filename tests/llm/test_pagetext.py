"""Block extraction on markup of many kinds; differencing of template lines."""

import random

import pytest

from broadsheet.llm import pagetext

PAGE = (
    "<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a='</p>';</script></head><body><nav><ul><li><a href=/>Menu</a></ul></nav>"
    "<!-- c --><div class='ad'>Buy</div><article><header><h1>Head &amp; line</h1></header><p><b>Para\n  one<br>next</p><p>&eacute;&#233; <i>x</i>y<ul><li>a<li>b</ul>"
    "<aside>side</aside><section id=comments><p>reader</p></section></article><form>f</form><footer>&copy; foot</footer></body></html>"
)


def lines(page):
    return pagetext.main_lines(pagetext.page_blocks(page), set())


def test_article_without_furniture():
    assert lines(PAGE) == ["Head & line", "Para one next", "éé xy", "a", "b"]


@pytest.mark.parametrize(("page", "blocks"), [
    ("", []), ("plain text", ["plain text"]), ("<p>a &am", ["a &am"]), ("<article><p>a &amp", ["a &"]), ("<p>x<br/>y", ["x y"]),
    ("<article><p>1 < 2 and <b>3</b></article>", ["1 < 2 and 3"]), ("<script>never closed <p>x", []), ("<nav>menu<p>still menu</nav><p>text", ["text"]),
    ("<div class='cookie-notice'>c</div><div>t</div>", ["t"]), ("<table><tr><td>a<td>b</table>", ["a", "b"]), ("<p>a  b</p></p></div>c", ["a b", "c"]),
])
def test_odd_markup(page, blocks):
    assert lines(page) == blocks


def test_an_article_rules_out_what_stands_beside_it():
    page = "<div class=header>H</div><p>Beside</p><main><div class=article-header><h1>T</h1></div><p>x</main><p>After"
    assert pagetext.page_blocks(page) == [(pagetext.DROPPED, "H"), (pagetext.OPEN, "Beside"), (pagetext.KEPT, "T"), (pagetext.KEPT, "x"), (pagetext.OPEN, "After")]
    assert lines(page) == ["T", "x"] and lines("<div class='page-header'>H</div><p>x") == ["x"]


def test_shared_lines_are_a_longest_common_subsequence():
    dice = random.Random(4)

    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = row
            row = [0]
            for j, y in enumerate(b):
                row.append(before[j] + 1 if x == y else max(before[j + 1], row[-1]))
        return row[-1]

    for _ in range(300):
        a, b = ([dice.randrange(4) for _ in range(dice.randrange(9))] for _ in range(2))
        places = pagetext.shared_lines(a, b)
        rest = iter(b)
        assert len(places) == longest(a, b) and all(a[i] in rest for i in places)


def test_template_lines_of_the_nearest_page_go(spark):
    def page(own):
        return f"<div>Site name</div><div>{own}</div><p>its story</p><div>All rights</div>"

    rows = [(i, f"http://h{i % 2}.example/a/{i:03}", page(f"own {i}").replace("its", f"story {i} and its"), "clash") for i in range(40)]
    rows += [(98, "http://lonely.example/", page("own 98"), ""), (99, None, None, ""), (97, "http://h0.example/b", "<div>Site name</div><article><p>one</p></article>", ""), (96, "http://h0.example/c", "<article><p>one</p></article>", ""), (100, "http://h0.example/a/000", rows[0][2], ""), (1, rows[1][1], rows[1][2], "")]
    out = pagetext.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, _lines string").repartition(5))
    assert out.columns == ["page_id", "url", "html", "_lines", "_text"] and out.count() == len(rows)
    text = {r.page_id: r._text for r in out.collect()}
    assert pagetext.template_lines(out.select("page_id", "url", "html")).count() > 40
    assert text[5] == "own 5\n\nstory 5 and its story" and text[1] == "own 1\n\nstory 1 and its story" and text[97] == text[96] == "one"
    assert text[98] == "Site name\n\nown 98\n\nits story\n\nAll rights" and text[99] == ""
    assert pagetext.extract_text(out.select("page_id", "url", "html").limit(0)).count() == 0


def test_a_text_that_neighbours_carry_whole_stays(spark):
    story = "<p>The story</p><p>goes on</p>"
    rows = [
        (1, "http://a.example/x/1", story), (2, "http://a.example/x/2", story), (3, "http://b.example/1", story), (4, "http://b.example/2", story + "<p>more</p>"),
        (5, "http://c.example/n/1", "<div>Site</div><p>one</p>"), (6, "http://c.example/n/2", "<div>Site</div><p>two</p>"), (7, "http://c.example/n/22", "<div>Site</div><p>two</p>"),
    ]
    out = pagetext.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    text = {r.page_id: r._text for r in out.collect()}
    assert text[1] == text[2] == text[3] == "The story\n\ngoes on" and text[4] == "The story\n\ngoes on\n\nmore"
    assert text[5] == "one" and text[6] == "two"


DATA = "/root/testdata/sf0.01"


def plain_texts(pages):
    """Pairing, alignment and deletion in plain Python over all pages."""
    from os.path import commonprefix
    from urllib.parse import urlsplit

    def place(url):
        cut = urlsplit(url or "")
        return cut.netloc.lower(), (url or "").split(cut.netloc, 1)[1] if cut.netloc else (url or "")

    blocks = {r.page_id: pagetext.page_blocks(r.html or "") for r in pages}
    once = {}
    for r in pages:
        once.setdefault((*place(r.url), tuple(t for _, t in blocks[r.page_id])), r.page_id)
    order, shared = sorted(once, key=lambda k: k[:2]), {}
    for at, (host, path, own) in enumerate(order):
        near = [k for k in order[max(at - 1, 0) : at] + order[at + 1 : at + 2] if k[0] == host]
        for other in sorted(near, key=lambda k: -len(commonprefix([k[1], path]))):
            found = pagetext.shared_lines(list(own), list(other[2]))
            if len(found) < min(len(own), len(other[2])):
                shared[host, path, own] = set(found)
                break
    return {r.page_id: "\n\n".join(pagetext.main_lines(blocks[r.page_id], shared.get((*place(r.url), tuple(t for _, t in blocks[r.page_id])), set()))) for r in pages}, shared


@pytest.mark.skipif(not __import__("os").path.isdir(DATA), reason="the driver's tables are not here")
@pytest.mark.parametrize("bare", [False, True])
def test_whole_table_equals_a_plain_version(spark, bare):
    pages = spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url", "html")
    if bare:  # without article elements differencing decides
        pages = pages.selectExpr("page_id", "url", "replace(replace(html, '<article', '<div'), '</article', '</div') AS html")
    rows = pages.collect()
    plain, shared = plain_texts(rows)
    found = {r.page_id: r._text for r in pagetext.extract_text(pages).collect()}
    assert sum(found[i] == plain[i] for i in plain) >= len(plain) - 2  # pages of equal path have no order
    assert sum(map(bool, shared.values())) > 20


def test_long_pages_align_in_linear_space():
    import tracemalloc

    dice = random.Random(3)
    own = [dice.randrange(3_000) for _ in range(20_000)]
    other = [x for x in own if dice.random() < 0.7]
    tracemalloc.start()
    found = pagetext.shared_lines(own, other)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == len(other) and [own[i] for i in found] == other
    assert peak < 200e6


def test_halving_finds_a_longest_subsequence(monkeypatch):

    dice = random.Random(4)
    for _ in range(200):
        a, b = ([dice.randrange(6) for _ in range(dice.randrange(40))] for _ in range(2))
        monkeypatch.setattr(pagetext, "_TABLE", 1_000_000)
        whole = pagetext.shared_lines(a, b)
        monkeypatch.setattr(pagetext, "_TABLE", 8)
        halved = pagetext.shared_lines(a, b)
        assert len(halved) == len(whole) and halved == sorted(set(halved))
        left = iter(b)
        assert all(any(x == y for y in left) for x in (a[i] for i in halved))


@pytest.mark.parametrize("name", ["search-result", "related work", "comment-theory", "share capital", "header"])
def test_parts_of_an_article_stay_whatever_else_their_names_say(name):
    blocks = pagetext.page_blocks(f'<article><p>one</p><section class="{name}"><p>two</p></section><div class="share-buttons">x</div></article>')
    assert pagetext.main_lines(blocks, set()) == ["one", "two"]
