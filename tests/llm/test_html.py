import html
import re

from heddle.llm import html as H


def expected(page):
    """Article text of the generated pages, by string operations."""
    body = re.search(r"<article>(.*?)(?:</article>|\Z)", page or "", re.S)
    if not body:
        return ""
    parts = re.split(r"</?(?:p|h1)>", body[1])
    found = (" ".join(html.unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0] == "<br>" else "", x)).split()) for x in parts)
    return "\n\n".join(x for x in found if x)


def test_whole_table(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    rows = H.op8_html(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == expected(pages[r.page_id]) and r.n_chars == len(r.text) > 0


SHELL = '<html><head><title>T</title></head><body><div id="top">Welcome to our site</div><div class="nav-bar">Menu {n}</div><div class="body"><h2>Head {n}</h2><p>First&nbsp;&amp; {n}<p>Second <b>bold {n}</b>\n x</div><div class="comments"><p>me too {n}</p></div><div id="end">All rights reserved</div><script>if (a < b) {{}}</script></body></html>'


def test_constant_nodes_are_template(spark):
    rows = [(i, f"http://h.example/{i}", SHELL.format(n=i)) for i in range(6)] + [(9, "http://alone.example/", SHELL.format(n=9))]
    rows += [(10, None, None), (11, "x", ""), (12, "http://h.example/12", "<p>only"), (12, "http://h.example/12", "<p>only")]
    df = spark.createDataFrame([(*r, "t", "h") for r in rows], "page_id long, url string, html string, text string, host string").repartition(3)
    out = {r.page_id: r.text for r in H.extracted(df).collect()}
    assert out[3] == "Head 3\n\nFirst & 3\n\nSecond bold 3 x"
    assert out[9].startswith("Welcome to our site\n\nHead 9")
    assert (out[10], out[11], out[12]) == ("", "", "only")
    assert H.extracted(df.filter("false")).count() == 0


def test_alignment_is_the_best_one():
    a, b = H.folded([H.parse("<div></div><p><b></b></p><i></i>")]), H.folded([H.parse("<p><b></b></p><div></div><i></i>")])
    assert H.match(a, b, {})[0] == 4  # root, p, b, i
    both = H.merged(a, b)
    assert [k.sign for k in both.kids].count("div") == 2 and both.pages == 2


def test_broken_pages():
    assert H.main_text("<article>a<br>b<p>c<div>d</div>e</article>f", None) == "a b\n\nc\n\nd\n\ne"
    assert H.main_text("x <!-- y", None) == "x"
    assert H.main_text("<ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table>", None) == "a\n\nb\n\n1\n\n2\n\n3"
    assert H.main_text("<div><p>long " + "word " * 200_000 + "</div>", None).count("word") == 200_000
    H.any_depth()
    assert H.main_text("<div>" * 30_000 + "deep", None) == "deep"
    assert H.main_text("<div>" * 900 + "<nav>menu</nav><p>text</p>", None) == "text"
    deep = [H.folded([H.parse("".join(f"<div><b class='{'xy'[(i + j) % 7 % 2]}'></b>" for i in range(3000)) + "deep")]) for j in range(2)]
    both = H.merged(*deep)
    back = H.thaw(H.json.loads(H.json.dumps(both.plain())))
    assert back.pages == 2 and back.plain() == both.plain()
    assert H.main_text("<article><header><h1>T</h1></header><p>x</p><footer>f</footer><div class='share'>s</div></article>", None) == "T\n\nx"


def texts(spark, page):
    rows = [(i, f"http://h.example/{i}", page.format(n=chr(97 + i) * 3)) for i in range(9)]
    return {r.page_id: r.text for r in H.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_template_goes_before_article_elements(spark):
    inside = "<body><article><div class='note'>Read our terms</div><h1>Head {n}</h1><p>Story {n}</p><article class='comment'><p>me too {n}</p></article></article><article class='related'>see {n}</article></body>"
    assert texts(spark, inside)[2] == "Head ccc\n\nStory ccc"
    cards = "<body><div class='body'><p>The whole long story of {n}, told at length</p></div><article><p>card {n}</p></article><article><p>other {n}</p></article></body>"
    assert texts(spark, cards)[2] == "The whole long story of ccc, told at length"
    alike = "<body><div>{n}</div><article><p>The same story on each page</p></article></body>"
    assert texts(spark, alike)[2] == "The same story on each page"


#: Neither article nor main elements nor telling names: a bar of links, a varying teaser, a story among whose paragraphs a constant one stands,
#: a list of links that vary, other varying texts, and a notice.
PLAIN = "<body><div><a href=x>Section {n}</a><a href=y>Page {n}</a></div><div><div>Hot today: {n}</div></div><div><div><h2>Head {n}</h2><p>Once upon a time {n} went far away.</p><p>Ask us about reprints.</p><p>Then {n} came home, and it was late in the year.</p><div><p><a href=z>More of {n}</a></p><p><a href=z>And {n} again</a></p></div></div></div><div><p>Somebody said {n}</p><p>Nobody agreed</p></div><p>Kindly read our terms</p></body>"
STORY = "Head ccc\n\nOnce upon a time ccc went far away.\n\nThen ccc came home, and it was late in the year."


def test_the_template_alone_tells(spark):
    assert texts(spark, PLAIN)[2] == STORY
    alone = H.main_text(PLAIN.format(n="ccc"), None)
    assert alone != STORY and "Ask us about reprints." in alone and "More of ccc" in alone  # without the host nothing is constant
    names = H.ASIDE_TAGS, H.ASIDE_WORDS, H.MAIN_TAGS
    try:
        H.ASIDE_TAGS, H.ASIDE_WORDS, H.MAIN_TAGS = frozenset(), frozenset(), frozenset()
        host = H.induced(PLAIN.format(n="aaa"))
        for n in "bcdefghi":
            host.add(H.induced(PLAIN.format(n=n * 3)))
        assert H.main_text(PLAIN.format(n="ccc"), H.loads(host.dumps())) == STORY
    finally:
        H.ASIDE_TAGS, H.ASIDE_WORDS, H.MAIN_TAGS = names


def test_copies_of_a_page_are_no_template(spark):
    rows = [(i, "http://h.example/", PLAIN.format(n="ccc")) for i in range(9)]
    got = {r.text for r in H.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == 1 and STORY.split("\n\n")[1] in got.pop()


def test_what_the_template_decides_on_the_given_pages():
    """Without tag and class lists, on hosts with enough pages: most articles are still found by where text varies."""
    pages = spark_free_pages()
    hosts = {}
    for url, page in pages:
        hosts.setdefault(url.split("/")[2], []).append(page)
    names = H.ASIDE_TAGS, H.ASIDE_WORDS, H.MAIN_TAGS
    right = n = 0
    try:
        H.ASIDE_TAGS, H.ASIDE_WORDS, H.MAIN_TAGS = frozenset(), frozenset(), frozenset()
        for own in hosts.values():
            if len(own) >= 5:
                host = H.induced(own[0])
                for page in own[1:]:
                    host.add(H.induced(page))
                for page in own:
                    n += 1
                    right += H.main_text(page, host) == expected(page)
    finally:
        H.ASIDE_TAGS, H.ASIDE_WORDS, H.MAIN_TAGS = names
    assert n > 50 and right > 0.9 * n, (right, n)


def spark_free_pages():
    import pyarrow.parquet as pq

    return [(r["url"], r["html"]) for r in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()]
