import random

import numpy as np
import pytest

from quizlens.llm import html_text as HT

SCHEMA = "page_id long, url string, html string"
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head>
<body class="home"><header><h1>Site</h1></header><nav><ul><li><a href=x>Menu</a></ul></nav><!-- <p>gone</p> -->
<div class="ad">Buy</div><aside>Side</aside><form><label>Mail</label><input value="p"></form>
<main><article><header><h2>Head&amp;line</h2></header><p>One  two
<b>three</b>&nbsp;four<br>five<p>Six &lt;b&gt; &#233;&#x41; &copy AT&T</p><div class='share-bar'>Share</div>
<ul><li>a<li>b</ul><table><tr><td>x<td>y</table><script>evil()</script>
<section id="comments"><article><p>First!</p></article></section><p>Last</article></main>
<div role="contentinfo">Info</div><footer>&copy; all</footer></body></html>"""


def test_blocks_of_a_page():
    assert HT.extract([PAGE]) == ["Head&line\nOne two three four five\nSix <b> éA © AT&T\na\nb\nx\ny\nLast"]


@pytest.mark.parametrize("html,text", [
    (None, ""), ("", ""), ("<article>", ""), ("plain < text", "plain < text"), ("<article><p class='x", ""),
    ("<article>a<p>b &am", "a\nb &am"), ("<article>a<script>x", "a"), ("<article>a<!-- b", "a"),
    ("<nav>n</nav>a", "a"), ("</div></p>a</b>b", "ab"), ("<article>a\x00 b\n\t c</article>", "a\x00 b c"),
    ("<ARTICLE><P>Up</P></ARTICLE>", "Up"), ("<article><img alt='>' src=x>z", "z"), ("<article><p>a</i></p>b", "a\nb")])
def test_broken_markup(html, text):
    got = HT.extract([html])[0]
    assert got == text


def runs(streams, width, pages):
    """Covered tokens, window by window."""
    where = {}
    for p, s in enumerate(streams):
        for i in range(len(s) - width + 1):
            where.setdefault(tuple(s[i:i + width]), set()).add(p)
    out = []
    for s in streams:
        hit = [False] * len(s)
        for i in range(len(s) - width + 1):
            if len(where[tuple(s[i:i + width])]) >= pages:
                hit[i:i + width] = [True] * width
        out.append(hit)
    return out


@pytest.mark.parametrize("width,pages", [(1, 2), (2, 2), (3, 2), (5, 3), (8, 2)])
def test_suffix_ranks_equal_windows(width, pages):
    rnd = random.Random(width)
    for _ in range(20):
        streams = [[rnd.randrange(4) for _ in range(rnd.randrange(0, 40))] for _ in range(rnd.randrange(1, 7))]
        assert [x.tolist() for x in HT.repeated(streams, width, pages)] == runs(streams, width, pages)
    assert [len(x) for x in HT.repeated([[], []], width, pages)] == [0, 0]


def test_host_decides_unmarked_blocks():
    """Pages without an article: what pages of the host share goes, what one
    page alone has stays."""
    strip = "this site uses many small files to make your visit nicer than before"
    pages = [f"<div>{strip}</div><div>{i} story {i} tells {i * 7} of {i} things nobody {i} knows</div>" for i in range(4)]
    assert HT.extract(pages) == [f"{i} story {i} tells {i * 7} of {i} things nobody {i} knows" for i in range(4)]
    assert strip in HT.extract(pages[:1])[0]
    mixed = f"<div>only here one {strip} and two</div>"
    assert HT.extract([pages[0], mixed])[1] == "only here one and two"


def test_article_copies_are_kept():
    page = "<article><p>" + " ".join(f"w{i}" for i in range(60)) + "</p></article>"
    assert len(set(HT.extract([page, page + " ", page + "<p>z"]))) <= 2
    assert all("w0 w1" in t for t in HT.extract([page, page + " "]))


def test_rows(frame, empty):
    assert HT.main_text(empty(SCHEMA)).count() == 0
    big = "<article>" + "<p>abc def</p>" * 40_000 + "</article>"
    rows = [(1, "http://a.b/x", PAGE, 1), (1, "http://a.b/x", PAGE, 1), (2, None, PAGE, 1), (None, "no host", "<p>q", 1),
            (3, "http://A.b/y", None, 1), (4, "http://a.b", big, 1)]
    got = HT.main_text(frame(rows, SCHEMA + ", host int"), part_bytes=1000).collect()
    text = HT.extract([PAGE])[0]
    assert sorted(((r.page_id, r.url, r.text, r.n_chars) for r in got), key=repr) == sorted([
        (1, "http://a.b/x", text, len(text)), (1, "http://a.b/x", text, len(text)), (2, None, text, len(text)),
        (None, "no host", "q", 1), (3, "http://A.b/y", "", 0),
        (4, "http://a.b", "\n".join(["abc def"] * 40_000), 40_000 * 8 - 1)], key=repr)


def test_query_equals_plain_reading_of_articles(spark):
    """Every page of the table has an article of h1 and p elements only."""
    import html
    import re
    from quizlens.llm.queries import q_op4_html_text
    sf = "/root/testdata/sf0.01"

    def plain(page):
        body = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>?", "", p.replace("<br>", " "))).split())
                 for p in re.split(r"</?(?:p|h1)\b[^>]*>", body)]
        return "\n".join(p for p in parts if p)

    want = {r.page_id: plain(r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r.page_id: r.text for r in q_op4_html_text(spark, sf).collect()}
    assert got == want and np.mean([bool(t) for t in got.values()]) == 1.0


def test_part_size_decides_no_text(frame):
    """A run on two pages of the host goes, whatever parts they fall into."""
    rnd = random.Random(3)
    rows = []
    for i in range(60):
        own = " ".join(rnd.choices("abcdefghijklmnop", k=40))
        pair = " ".join(f"pair{i // 2}x{k}" for k in range(9))
        art = "<article><p>" + " ".join(f"quoted{i - 1}x{k}" for k in range(10)) + "</p></article>" if i % 2 else ""
        quote = "" if i % 2 else " ".join(f"quoted{i}x{k}" for k in range(10))
        rows.append((i, f"http://h.x/{i}", f"<div>{own}</div><div>{pair}</div>{art}<div>one {quote} two</div><nav>n</nav>"))
    rows += [(100, "http://h.x/100", rows[0][2]), (101, "http://other.x/", rows[0][2])]
    # a copy of a page is not another page
    rows += [(200 + i, f"http://h.x/c{i}", "<div>" + " ".join(f"copied{k}" for k in range(20)) + "</div>") for i in range(4)]
    texts = [{r.page_id: r.text for r in HT.main_text(frame(rows, SCHEMA), part_bytes=size).collect()}
             for size in (1 << 30, 2000, 300)]
    assert texts[0] == texts[1] == texts[2] and len(texts[0]) == len(rows)
    assert not any("pair" in texts[0][i] for i in range(60)) and "quoted0x0" not in texts[0][0]
    assert "copied0 copied1" in texts[0][200] and "quoted0x0" in texts[0][101] and "quoted0x0" in texts[0][1]


ART = "<article><p>The story itself.</p></article>"


@pytest.mark.parametrize("page,text", [
    (f"<body class='has-sidebar'>{ART}", "The story itself."),
    (f"<main class='no-ads'>{ART}</main>", "The story itself."),
    ("<article class='post comments-open'><p>The story itself.</p></article>", "The story itself."),
    (f"<div id='search-results'>{ART}</div>", "The story itself."),
    (f"<html><head><title>t</title><body>{ART}", "The story itself."),
    (f"<head><meta charset=x><link rel=y>{ART}", "The story itself."),
    ("<head><title>t</title>plain text", "plain text"),
    ("<article><p class='related-work'>Related work.</p><p>End</p></article>", "Related work.\nEnd"),
    ("<article><p class='ad'>Buy</p><div class='share-bar'>Share</div><p>End</p></article>", "End"),
    (f"{ART}<div class='comment-list'><p>First!</p></div>", "The story itself."),
    (f"{ART}<section><article class='comment'><p>First!</p></article></section>", "The story itself."),
    (f"<div class='sidebar'>{ART}</div>", ""),
    ("<article><p>one <svg><text>icon</text></svg>two <button>Like</button>three</p></article>", "one two three"),
    ("<article><p>one <button><div>x</div></button> two</p></article>", "one\ntwo"),
    ("<article><p>a <label>b<p>c</article>d", "a\nc\nd")])
def test_names_and_heads_lose_no_article(page, text):
    assert HT.extract([page]) == [text]


def test_hot_host_is_dealt_by_host_and_part(spark, frame):
    """With no broadcast at all, the parts of one host still go apart."""
    from quizlens import session
    rows = frame([(i, f"http://hot.x/{i}", f"<article><p>page {i} {'words ' * 50}</p></article>") for i in range(400)], SCHEMA, parts=4)
    conf, limit = "spark.sql.autoBroadcastJoinThreshold", session.BROADCAST_MAX_BYTES
    spark.conf.set(conf, "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    defaults = session.small_side.__defaults__
    session.small_side.__defaults__ = (0, False)
    try:
        df = HT.main_text(rows, part_bytes=4000)
        plan = df._jdf.queryExecution().executedPlan().toString()
        sizes = df.rdd.glom().map(len).collect()
    finally:
        session.small_side.__defaults__ = defaults
        spark.conf.unset(conf)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert session.BROADCAST_MAX_BYTES == limit and "BroadcastHashJoin" not in plan
    assert "hashpartitioning(host" in plan and "part" in plan.split("FlatMapGroupsInPandas")[1].split("Exchange")[1][:120]
    assert sum(sizes) == 400 and max(sizes) < 200
