import random

import pytest

from tabreg.llm import html_wrappers
from tabreg.llm.html_wrappers import _fold, article_paths, expression, main_text, page_text, parse, wrapper_of


def one(source):
    page = parse(source)
    own = wrapper_of(page)
    return page_text(page, own, article_paths(own), 1)


def test_article_and_broken_markup():
    assert one("<title>t</title><nav><li>m</nav><article><h1>A &amp B</h1><p><b>one<br><p>two\n  three</p>tail</article><footer>f") == (
        "A & B\none\ntwo three\ntail")
    assert one("<article><header><h1>T</h1></header><p>x<script>if (a<b) '</p>'</script>y</p><aside>no</aside>"
               "<div class='post-comments'><p>no</p></div><form>no</form><!-- <p>no</p> --></article>") == "T\nxy"
    assert one("") == "" and one("plain &lt;text&gt; 3 < 4") == "plain <text> 3 < 4" and one("<p>a<p>b") == "a\nb"
    assert one("<div class=\"a>b\">x</div><p title='<p>'>y") == "x\ny"


def test_without_an_article():
    assert one("<body><div id=header>site</div><div class='cookie-notice'>c</div><div class=wrap><ul class=menu><li>m</ul><div class=text>"
               "<h2>T</h2><p>long text here</p><ul><li>i1<li>i2</ul><div class=ad>buy</div></div></div><div id=sidebar>s</div>") == (
        "T\nlong text here\ni1\ni2")


def page(rng, k):
    words = " ".join(f"w{rng.randint(0, 999)}" for _ in range(30))
    extra = "<p class=byl>by x</p>" if k % 2 else ""
    return (f"<html><body><div class=top>Our Site</div><div class=box><div class=xa><a href=/>home</a> <a href=/b>more</a></div>"
            f"<div class=xb><h1>Title {k}</h1>{extra}" + "".join(f"<p>{words} {j}</p>" for j in range(k % 4 + 1)) +
            "</div></div><div class=end>All rights reserved</div></body></html>")


def test_wrapper_of_a_host():
    rng = random.Random(14)
    pages = [page(rng, k) for k in range(12)]
    whole = None
    for p in pages:
        own = wrapper_of(parse(p))
        whole = own if whole is None else _fold(whole, own)
    text = expression(whole)
    assert "<div.top>#TEXT</>" in text and "<h1>#SLOT</>" in text and "(<p>#SLOT</>)+" in text and "<p.byl>#TEXT</>?" in text
    left, right = wrapper_of(parse(pages[0])), wrapper_of(parse(pages[1]))
    for p in pages[2:7]:
        left = _fold(left, wrapper_of(parse(p)))
    for p in pages[7:]:
        right = _fold(right, wrapper_of(parse(p)))
    assert expression(_fold(left, right)) == text
    got = page_text(parse(pages[2]), whole, article_paths(whole), 12)
    assert got.startswith("Title 2\nw") and "Our Site" not in got and "reserved" not in got and "home" not in got


def test_a_word_of_a_name_drops_no_article():
    text = "<h1>T</h1><p>flour and sugar, one cup of each</p>"
    for whole in ('<article id="cookie-recipe">{}</article>', '<main class="no-sidebar">{}</main>', '<div id=wrap class="has-sidebar">{}</div>',
                  '<div class="right-sidebar"><article>{}</article></div>', '<div class="right-sidebar"><div>{}</div></div>',
                  '<main><div class="right-sidebar">{}</div></main>', '<article class="comment">{}</article>',
                  '<div class="post ad-free">{}</div>', '<div class="entry has-comments">{}</div>', '<section id="law-of-copyright">{}</section>'):
        assert one(f"<body><nav>m</nav>{whole.format(text)}<div class=ad>buy</div></body>") == "T\nflour and sugar, one cup of each", whole
    assert one('<article><h2 id="copyright-law">A</h2><h2 id=copyright>B</h2><p>c</p><p id=search>d</p></article>') == "A\nB\nc\nd"
    assert one("<article><p>a</p></article><div class=related-posts><article>other</article></div><div class=sidebarLeft>s</div>") == "a"
    assert one("<article><p>a</p><section class='comments-area'><p>much longer than the article</p></section></article>") == "a"
    assert one("<article><p>a</p><article class=comment>b</article></article><div id=comments><article>much longer</article></div>") == "a"
    assert one("<div class=post><h1>T</h1>a</div><div id=comments><article class=comment>much longer</article></div>") == "T\na"
    assert one("<article><h1>T</h1>a<div id=comments><article>much longer</article></div></article>") == "T\na"


def host_texts(pages):
    whole = None
    for p in pages:
        own = wrapper_of(parse(p))
        whole = own if whole is None else _fold(whole, own)
    return [page_text(parse(p), whole, article_paths(whole), len(pages)) for p in pages]


def test_host_evidence_for_a_doubtful_name():
    pages = [f"<article><h1>T {k}</h1><div class='cookie-recipe'>step {k}</div><div class='notice-of-use'><p>We use it.</p></div>"
             f"<div class='search-by-word'>see <a href=/{k}>word number {k}</a></div></article>" for k in range(5)]
    assert host_texts(pages) == [f"T {k}\nstep {k}" for k in range(5)]
    assert host_texts(pages[:1] * 5) == ["T 0\nstep 0\nWe use it."] * 5


def test_without_an_article_nothing_varied_goes():
    pages = [f"<body><div class=top><b>Our</b> <i>Site</i></div><div class=box><h1>Title {k}</h1><p>lead {k}</p><div class=text>"
             + f"<p>words {k} of the body, far longer than the rest</p>" * 5 + "</div></div><div class=end>All rights</div></body>" for k in range(6)]
    body = "\n".join(["words {} of the body, far longer than the rest"] * 5)
    assert host_texts(pages) == [f"Title {k}\nlead {k}\n" + body.format(*[k] * 5) for k in range(6)]


def test_copies_of_a_page_make_no_constants():
    same = "<body><div class=box><h1>Title</h1><p>only paragraph</p></div></body>"
    assert host_texts([same] * 5) == ["Title\nonly paragraph"] * 5
    mixed = [same, same, same, same.replace("only", "another")]
    assert host_texts(mixed)[0] == "Title\nonly paragraph"


def test_small_articles_beside_large_ones_stay():
    pages = ["<body><article class=long>" + f"<p>words {k}</p>" * 50 + f"</article><article class=short><p>brief {k}</p></article></body>"
             for k in range(4)]
    assert all(t.endswith(f"words {k}\nbrief {k}") for k, t in enumerate(host_texts(pages)))


@pytest.mark.parametrize("limit", [32 << 20, 0])
def test_table(spark, monkeypatch, limit):
    monkeypatch.setattr(html_wrappers, "BROADCAST_BYTES", limit)
    rng = random.Random(15)
    rows = [(k, f"https://h{min(k % 7, 2)}.example.org/{k}", page(rng, k)) for k in range(60)]
    rows += [(100, None, "<p>a</p>"), (101, "x", None), (102, "https://h0.example.org", ""), (0, rows[0][1], rows[0][2]),
             (103, "https://long.example", "<article>" + "<p>word &amp; word</p>" * 5000 + "</article>"), (None, "u", "<p>z")]
    table = spark.createDataFrame([(*r, "t", "w") for r in rows], "page_id long, url string, html string, host string, wrapper string")
    got = main_text(table.repartition(5)).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    text = {r.page_id: r.text for r in got}
    assert text[100] == "a" and text[101] == "" and text[102] == "" and text[None] == "z" and text[103].count("\n") == 4999
    assert text[5].split("\n")[0] == "Title 5" and "reserved" not in text[5] and "home" not in text[5]
    assert main_text(table.limit(0)).count() == 0


def test_any_depth_of_nesting(spark):
    n = 100_000
    deep = "<body>" + "<div>" * n + "<p>far down</p>" + "</div>" * n + "<p>after</p></body>"
    unclosed = "<b>" * n + "words" + "</i>" * n
    rows = [(1, "http://a.b/1", deep), (2, "http://a.b/2", unclosed), (3, "http://a.b/3", "<article><p>plain</p></article>"), (4, "http://c.d/", deep)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    got = {r.page_id: r.text for r in main_text(pages).collect()}
    assert got[3] == "plain" and got[4] == "far down\nafter"
    assert "far down" in got[1] and got[2] == "words"
