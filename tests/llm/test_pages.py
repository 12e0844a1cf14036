"""Main text of pages and url templates: hand-made cases and the given pages."""

import html
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from predlens.llm import queries
from predlens.llm.urls import Rule, TemplateTree, judge_urls, sql_judged, url_parts
from predlens.llm.wrappers import Node, Page, extract_main_text, folded, infer_wrappers, main_places, main_text, merged


def text_of(source):
    return main_text(source, main_places(Page(source).root))


def wrapper(*sources):
    total = None
    for source in sources:
        tree = Page(source).root
        total = tree if total is None else merged(total, tree)
    return total


@pytest.mark.parametrize(
    "source, wanted",
    [
        ("<article><p>a &amp; b\n  c</p></article>", "a & b c"),
        ("<article><h1>T</h1><p>one<p>two<br>three</article><footer>f</footer>", "T\none\ntwo three"),
        ("<body><nav>n</nav><article><b>x <i>y</i></b>z<p>q &lt;p&gt;</p></article>", "x yz\nq <p>"),
        ("<article>a<script>var t='</p><p>no';</script>b<style>p{}</style></article>", "ab"),
        ("<article><p>a<!-- no <p> --></p><div class='ad box'>buy</div><p>b</p></article>", "a\nb"),
        ("<article><ul><li>1<li>2<ul><li>3</ul></ul><aside>s</aside></article>", "1\n2\n3"),
        ("<main><p>m</p><section id=comments><article><p>reader</p></article></section></main>", "m"),
        ("<article><p>cut off in a <b>tag", "cut off in a tag"),
        ("<article><p>x</p><p", "x"),
        ("<article><p title='a>b'>x < y</p></article>", "x < y"),
        ("<article><header><h1>H</h1></header><p>p</p><form><p>f</p></form></article>", "H\np"),
        ("<div class=menu>m</div><div><p>long enough text of the page here</p><p>more of it</p></div><div class=footer>f</div>", "long enough text of the page here\nmore of it"),
        ("<article><table><tr><td>a<td>b<tr><td>c</table></article>", "a b\nc"),
        ("<article><p>a&nbsp;b &copy</p></article>", "a b ©"),
        ("plain words", "plain words"),
        ("<nav>only a menu</nav>", ""),
        ("", ""),
        (None, ""),
    ],
)
def test_blocks(source, wanted):
    assert (text_of(source) if source else main_text(source, [])) == wanted


@pytest.mark.parametrize(
    "source, wanted",
    [
        ("<html><head><title>t</title><meta charset=utf-8><body><article><p>a</p></article>", "a"),
        ("<head><title>t</title><link href=x><script>s</script><article><p>a</p></article>", "a"),
        ("<head><title>t</title><span>a</span> b", "a b"),
        ("<head><title>t</title>a<p>b</p>", "a\nb"),
        ("<head><style>s</style><noscript>n</noscript> <template><p>no</p></template><svg><title>s</title></svg><p>a</p>", "a"),
        ("<head><title>t</title></head><body><p>a</p></body>", "a"),
    ],
)
def test_heads_left_open(source, wanted):
    assert text_of(source) == wanted


@pytest.mark.parametrize(
    "source, wanted",
    [
        ("<article class='post has-sidebar'><p>a</p></article>", "a"),
        ("<main class=no-sidebar><p>a</p></main>", "a"),
        ("<div class='content with-comments'><p>a</p></div><div class=entry-footer>f</div>", "a"),
        ("<div id='content' class='footer-dark'><p>a</p><div class='post-comments'>c</div></div>", "a"),
        ("<article><p>a</p></article><article class='Sidebar wide'><p>s</p></article>", "a"),
        ("<article><p>a</p><div class='content ad'>buy</div><div class=has-sidebar>s</div></article>", "a"),
    ],
)
def test_boilerplate_words_in_names_of_content(source, wanted):
    assert text_of(source) == wanted


def test_wrapper_of_two_pages():
    one = "<nav><ul><li>a<li>b</ul></nav><article><h1>A</h1><p>x</p></article><footer>same</footer>"
    two = "<nav><ul><li>c</ul></nav><div class=ad>!</div><article><h1>B</h1><p>y</p><p>z</p></article><footer>same</footer>"
    found = wrapper(one, two)
    assert found.expression() == (
        "<page><nav><ul>(<li>#</li>)+</ul></nav>(<div.ad>'!'</div>)?<article><h1>#</h1>(<p>#</p>)+</article><footer>'same'</footer></page>"
    )
    assert Node.load(found.dump()).expression() == found.expression()


def test_repeated_groups():
    pairs = [Node(s) for s in ["dt", "dd"] * 3]
    assert [n.expression() for n in folded(pairs)] == ["(<dt></dt><dd></dd>)+"]


def test_deep_and_long_pages():
    deep = "<div>" * 500 + "<article><p>in</p></article>" + "</div>" * 500
    assert text_of(deep) == "in"
    assert text_of("<article>" + "<p>word</p>" * 20_000 + "</article>").count("\n") == 19_999


def reference(source):
    article = re.search(r"<article>(.*?)(?:</article>|\Z)", source, re.DOTALL)
    blocks = re.split(r"</?(?:p|h1)\b[^>]*>", article.group(1)) if article else []
    texts = [" ".join(html.unescape(re.sub(r"<[^>]*>?", "", b.replace("<br>", " "))).split()) for b in blocks]
    return "\n".join(t for t in texts if t)


@pytest.mark.parametrize("depth", [1, 59, 60, 61, 70, 3000])
def test_elements_of_any_depth(frame, depth):
    """What stands below many elements is text or menu like anything else, and the elements around it still end."""
    deep = "<div>" * depth
    pages = [
        f"<div><article><p>before</p>{deep}<p>after</p></article><p>last</p></div>",
        f"<article><p>text</p>{deep}<nav><p>menu</p></nav><aside>side</aside><div class=\"sidebar\">bar</div><p>more</p>{'</div>' * depth}<p>end</p></article>",
        f"{deep}<article><header>head of it</header><p>inner</p></article>{'</div>' * depth}",
    ]
    df = frame([(i, f"http://h{i}.org/a", page) for i, page in enumerate(pages)], "page_id long, url string, html string")
    found = {r["page_id"]: r["text"] for r in extract_main_text(df).collect()}
    assert found == {0: "before\nafter", 1: "text\nmore\nend", 2: "head of it\ninner"}


def test_query_on_given_pages(spark, data):
    source = {r["page_id"]: r for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    found = queries.op10_wrapper_text(spark, data).collect()
    assert len(found) == len(source)
    for row in found:
        assert row["text"] == reference(source[row["page_id"]]["html"])
        assert row["n_chars"] == len(row["text"]) and row["url"] == source[row["page_id"]]["url"]


def test_frame_edge_cases(frame):
    rows = [
        (1, "http://a.b/x", "<article><p>one</p></article>", "t"), (1, "http://a.b/x", "<article><p>one</p></article>", "t"),
        (2, "http://A.b/y", None, "t"), (None, None, "<article>two</article>", None), (3, "http://a.b/z", "", "t"),
        (4, "http://a.b/w", "<p>no article here</p>", "t"),
    ]
    pages = frame(rows, "page_id long, url string, html string, host string")
    found = sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in extract_main_text(pages).collect())
    assert found == [(0, "two", 3), (1, "one", 3), (1, "one", 3), (2, "", 0), (3, "", 0), (4, "no article here", 15)]
    assert extract_main_text(pages.limit(0)).count() == 0


def test_wrappers_of_a_hot_host(frame):
    rows = [("h" if i % 3 else f"o{i}", f"<article><h1>{i}</h1><p>{i}</p></article>") for i in range(90)]
    found = {r["host"]: r for r in infer_wrappers(frame(rows, "host string, html string")).collect()}
    assert len(found) == 31 and found["h"]["pages"] == 60


def test_url_parts(frame):
    urls = [None, "", "no scheme/x", "HTTP://Ex.ORG", "http://a.b?q=/x", "ftp://A.b/P/q?x#y", "x://y://z/w", "http://a.b#f/g", "http:///p", "http://É.net/a\nb"]
    found = {r["url"]: (r["host"], r["path"]) for r in url_parts(frame([(u,) for u in urls], "url string")).collect()}
    assert found == {
        None: ("", ""), "": ("", ""), "no scheme/x": ("", ""), "HTTP://Ex.ORG": ("ex.org", ""), "http://a.b?q=/x": ("a.b", ""),
        "ftp://A.b/P/q?x#y": ("a.b", "/P/q"), "x://y://z/w": ("y:", "//z/w"), "http://a.b#f/g": ("a.b", ""), "http:///p": ("", "/p"),
        "http://É.net/a\nb": ("É.net", "/a\nb"),
    }


def test_rules_and_templates(frame):
    urls = [f"http://x.com/good/{i}" for i in range(30)] + [f"http://x.com/bad/{i}" for i in range(30)] + ["http://x.com/bad/page", "http://y.net", "http://snet/", "http://a.net/q"]
    rules = (Rule("block", "net", "/"), *[Rule("block", "x.com", f"/bad/{i}") for i in range(9)], Rule("allow", "x.com", "/good/1"))
    pages = frame([(i, u, "v") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    found = {urls[r["page_id"]]: r for r in judge_urls(pages, rules, TemplateTree(strength=1.0)).collect()}
    assert found["http://x.com/bad/25"]["verdict"] == "block" and found["http://x.com/good/25"]["verdict"] == "allow"
    assert found["http://x.com/bad/12"]["rule"] == "x.com/bad/1" and found["http://x.com/bad/12"]["template"] == "x.com/bad/*"
    assert found["http://y.net"]["rule"] is None and found["http://snet/"]["rule"] is None and found["http://a.net/q"]["rule"] == "net/"


def test_labels_reach_urls_without_any(frame):
    """Evidence goes down from the host, along the whole path, and not to other hosts."""
    deep = "/a/b/c/d"
    urls = [f"http://spam.com/de/{i}" for i in range(30)] + [f"http://half.com/{p}/{i}" for p in ("bad", "good") for i in range(30)]
    urls += [f"http://deep.com{deep}/{p}/x{i % 3}" for p in ("bad", "good") for i in range(30)]
    asked = {
        "http://spam.com/en/7": "block", "http://spam.com": "block", "http://half.com/other/7": "allow", "http://new.com/de/1": "allow",
        f"http://deep.com{deep}/bad/page": "block", f"http://deep.com{deep}/good/page": "allow", f"http://deep.com{deep}/else": "allow",
    }
    rules = (
        Rule("block", "spam.com", "/de/"), Rule("block", "half.com", "/bad/"), Rule("allow", "half.com", "/good/"),
        Rule("block", "deep.com", f"{deep}/bad/x"), Rule("allow", "deep.com", f"{deep}/good/x"),
    )
    urls += asked
    pages = frame(list(enumerate(urls)), "page_id long, url string")
    found = {urls[r["page_id"]]: r for r in judge_urls(pages, rules).collect()}
    assert {url: found[url]["verdict"] for url in asked} == asked and not any(found[url]["rule"] for url in asked)
    assert found["http://spam.com/en/7"]["template"] == "spam.com/~/*" and found["http://new.com/de/1"]["labelled"] == 0


def test_url_tree_against_sql(spark, frame):
    """Random trees of paths of unequal depth, with repeated rows, against the check SQL."""
    draw = random.Random(5)
    hosts = ["x.example.com", "y.example.net", "z.net", "w.org", "example.com", "v.de"]
    words = ["de", "en", "fr", "a", "b", "7", "x.html", "12.html", "*", "~", *[f"k{i}" for i in range(12)]]
    urls = []
    for host in hosts:
        for _ in range(60):
            path = "/".join(draw.choice(words[: draw.choice([4, 8, 22])]) for _ in range(draw.randrange(5)))
            urls += [f"http://{host}/{path}" + draw.choice(["", "/"])] * draw.choice([1, 1, 3])
    pages = frame(list(enumerate(urls)), "page_id long, url string")
    from oracle import compare

    connection = duckdb.connect()
    connection.register("pages", pages.toPandas())
    good, message = compare(judge_urls(pages).withColumn("purity", F.round("purity", 9)), connection, sql_judged())
    assert good, message


def test_url_edge_cases(frame):
    rows = [(None, None), (1, "x"), (1, "x"), (2, "http://a.b/" + "s/" * 3000), (3, "http://a.net/")]
    pages = frame([(*r, 1, "h") for r in rows], "page_id long, url string, host int, path string")
    found = judge_urls(pages).collect()
    assert sorted((r["page_id"] or 0, r["verdict"]) for r in found) == [(0, "allow"), (1, "allow"), (1, "allow"), (2, "allow"), (3, "block")]
    assert judge_urls(pages.limit(0)).count() == 0
    assert {r["verdict"] for r in judge_urls(pages.where("page_id = 1")).collect()} == {"allow"}
