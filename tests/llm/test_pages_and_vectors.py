"""Pages, urls and vector searches against brute force, with broken rows among them."""

import math
import re
from functools import reduce
from html import unescape

import numpy as np
import pytest

from daftar.llm import ann, exact_topk, html_text, queries, url_rules


@pytest.mark.parametrize(
    "html,text",
    [
        (None, ""),
        ("", ""),
        ("<p>a &amp; b&#233;\n  c</p><script>var x='</p>'</script>", "a & bé c"),
        ("<nav><a>menu</a></nav><article><h1>T</h1><p>one<br>two<p>three</article><footer>f</footer>", "T\none two\nthree"),
        ("<body><div class='sidebar-left'>s</div><main><p>x <b>y</b>z</p><div class='ad'>ad</div></main>", "x yz"),
        ("<article><p>text</p><section id='comments'><p>nice</p></section><aside>a</aside><form>f</form></article>", "text"),
        ("<article><p>cut off <b>here", "cut off here"),
        ("<div hidden>h</div><p>" + "long words " * 20000 + "</p>", ("long words " * 20000).strip()),
        ("<!DOCTYPE html><!-- c --><![CDATA[x]]><p>ok</p>", "ok"),
    ],
)
def test_main_text(html, text):
    assert html_text.main_text(html) == text


@pytest.mark.parametrize("html,text", [
    ("<article><p>One</p><![foo bar><p>Two</p><![ --><p>Three</p></article>", "One\nTwo\nThree"),
    ("<article><p>One</p><![CDATA[ open > <p>Two</p></article>", "One\nTwo"),
    ("<article><p>One</p><![CDATA[ <p>no</p> ]]><p>Two</p></article>", "One\nTwo"),
    ("<body><nav><a>menu</a><article><p>One</p><aside>no</aside><p>Two</p></article><footer>f</footer></body>", "One\nTwo"),
    ("<body><div class='ad'>buy<article><p>One</p></article></body>", "One"),
    ("<main><div><div class='ad'>buy<article><p>One</p></article></main>", "One"),
    ("<main><p>One</p><aside><article>teaser</article></aside><ul><li class='related'><article>teaser</article></ul></main>", "One"),
    ("<html><head><title>t</title><body><article><p>One</p>Two</body></html>", "One\nTwo"),
])
def test_main_text_of_malformed_pages(html, text):
    assert html_text.main_text(html) == text


@pytest.mark.parametrize("html,text", [
    ("<html><head><title>t</title><meta charset='utf-8'><p>One</p><p>Two</p></html>", "One\nTwo"),
    ("<html><head><title>t</title><body><p>One</p></body></html>", "One"),
    ("<article><h2 id='binary-search'>Binary search</h2><p>One</p></article>", "Binary search\nOne"),
    ("<article><header class='article-header'><h1>Title</h1></header><p>One</p></article>", "Title\nOne"),
    ("<article><p>One</p><section class='side-effects'><h2>Side effects</h2><p>Two</p></section></article>", "One\nSide effects\nTwo"),
    ("<article><p>One</p><div class='comment-list'><p>no</p></div><div id='sidebar-left'>no</div><div class='adBox'>no</div></article>", "One"),
    ("<article><p>One</p><div class='x7'><h3>3 Comments</h3><div><p>no</p></div></div><p>Two</p></article>", "One\nTwo"),
    ("<article><p>One</p><article><p>Inner</p></article><p>Two</p></article>", "One\nInner\nTwo"),
])
def test_main_text_keeps_the_article(html, text):
    assert html_text.main_text(html) == text


STORY = "".join(f"<p>{'A sentence of the story that is long enough to count. ' * n}</p>" for n in (4, 1, 6, 3)) + "<p>Short.</p>"


@pytest.mark.parametrize("page", [
    "<div><ul>{menu}</ul></div><div class='q'>{story}</div><div><ul>{menu}</ul></div>",
    "<div>We set cookies on your machine, please say that you agree to that.</div><div><ul>{menu}</ul></div><div>{story}</div><div><ul>{menu}</ul></div><div>All rights of this page are reserved by its owner.</div>",
    "<table><tr><td>{menu}</td><td>{story}</td><td>{menu}</td></tr></table>",
    "<div><div><div>{menu}</div><div><h1>Title</h1><div>{story}</div></div></div></div><div><h2>Comments (2)</h2><div><p>I liked the story very much, thank you for this.</p></div></div>",
])
def test_regions_without_telling_names(page):
    """Clustering alone: no article or main part, no class that says anything."""
    menu = "".join(f"<li><a href='#'>Entry {i}</a></li>" for i in range(8))
    got = html_text.main_text("<body>" + page.format(menu=menu, story=STORY) + "</body>")
    want = html_text.main_text(f"<article>{STORY}</article>")
    assert got.removeprefix("Title\n") == want and got.startswith("Title") == ("Title" in page)


def independent(page):
    """The article of a given page by plain text search: between its tags, cut at block tags, tags removed, references decoded."""
    inner = re.search(r"(?s)<article[^>]*>(.*)</article>", page or "")
    inner = re.sub(r"(?s)<!--.*?-->|<(script|style|form|aside|nav|footer)\b.*?</\1>|<div class=.(?:ad|comments?|sidebar|notice)\b.*?</div>", "\x00", inner.group(1)) if inner else ""
    parts = re.split(r"\x00|</?(?:p|h[1-6]|div|section|ul|ol|li|table|tr|td|th|blockquote|pre|figure|figcaption|hr)\b[^>]*>", inner)
    texts = [" ".join(unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br[^>]*>", " ", x))).split()) for x in parts]
    return "\n".join(t for t in texts if t)


def test_given_pages(spark, sf_middle):
    """The registered query on given pages against an independent extraction, and the same pages with articles that aren't declared."""
    pages = spark.read.parquet(f"{sf_middle}/pages.parquet")
    rows = pages.collect()
    got = {r.page_id: r for r in queries.op2_html_extraction(spark, sf_middle).collect()}
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.page_id].text == independent(r.html) and got[r.page_id].n_chars == len(got[r.page_id].text) > 0
        assert html_text.main_text(re.sub(r"<(/?)(article|main)\b", r"<\1div", r.html)) == got[r.page_id].text


def test_content_region_without_markup():
    body = "".join(f"<p>{'A sentence of the story that is long enough to count. ' * 4}</p>" for _ in range(6))
    links = "".join(f"<a href='#'>L{i}</a> " for i in range(30))
    got = html_text.main_text(f"<body><div>{links}</div><div>{body}<p>Short.</p></div><table><tr><td><a>x</a><a>y</a></td></tr></table></body>")
    assert got.count("\n") == 6 and got.endswith("Short.") and "L3" not in got


def test_extract(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a</p>", 5), (1, "u", "<p>a</p>", 5), (2, None, None, 5), (None, "v", "<p></p>", 5)], "page_id long, url string, html string, n_chars int")
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in html_text.extract(pages).collect()) == [("1", "a", 1), ("1", "a", 1), ("2", "", 0), ("None", "", 0)]
    assert html_text.extract(pages.limit(0)).count() == 0


def brute_verdict(url, rules, default):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = rest[:cut].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        path = rest[cut:].split("?")[0].split("#")[0]
    fit = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fit)[1], max(fit)[2]) if fit else (host, path, None, default)


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://", "http://net", "http://net/", "HTTP://A.NET/x", "http://anet/x", "https://Example.net/en/a?b=/c#d", "http://x.example.net/en", "ftp://a.b.example.com/de/x", "http://q.org/fr/", "http://q.org?/fr/", "a://b://c.net/", "http://u@example.com:80/de/", "http://net/" + "x" * 5000, "http://ÄB.net/ü"]
    pages = spark.createDataFrame([(i % 7, u, "allow") for i, u in enumerate(urls * 2)], "page_id long, url string, verdict string")
    want = sorted(map(str, ((i % 7, *brute_verdict(u, queries.URL_RULES, "allow")) for i, u in enumerate(urls * 2))))
    got = url_rules.judge(pages, url_rules.rules_frame(pages, queries.URL_RULES))
    assert sorted(str(tuple(r)) for r in got.select("page_id", "host", "path", "rule", "verdict").collect()) == want
    assert url_rules.judge(pages.limit(0), url_rules.rules_frame(pages, queries.URL_RULES)).count() == 0
    assert {r.verdict for r in url_rules.judge(pages, url_rules.rules_frame(pages, [])).collect()} == {"allow"}


def test_many_url_rules(spark):
    """More entries than blocks: the filter lets much through, the join removes it."""
    rules = [(f"h{i}.example", "/a/" if i % 2 else "", "block") for i in range(9000)]
    pages = spark.createDataFrame([(i, f"http://s.h{i * 3}.example/{'a' if i % 3 else 'b'}/x") for i in range(5000)], "page_id long, url string")
    want = [(i, brute_verdict(f"http://s.h{i * 3}.example/{'a' if i % 3 else 'b'}/x", [r for r in rules[i * 3 : i * 3 + 1]], "allow")[3]) for i in range(5000)]
    assert sorted((r.page_id, r.verdict) for r in url_rules.judge(pages, url_rules.rules_frame(pages, rules)).collect()) == want


def vectors(n=900, d=16):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, d)).astype(np.float32)
    x[300:600] = x[300]  # one vector held by a third of the rows
    x[:50] *= 20
    return x


def frame(spark, x):
    odd = [(-20, None), (-40, []), (-60, [math.nan] * 16), (-80, [math.inf] + [0.0] * 15), (-100, [None] + [1.0] * 15), (None, [1.0] * 16), (-120, [1.0] * 3), (-200, [0.0] * 16)]
    return spark.createDataFrame([(i, [float(v) for v in r], "c") for i, r in enumerate(x)] + [(*o, "c") for o in odd], "vec_id long, embedding array<float>, score string")


def test_exact_topk(spark):
    x = vectors()
    rows = frame(spark, x)
    got = {}
    for r in exact_topk.search(rows, rows.where("vec_id % 100 = 0"), 10).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    ids = np.r_[np.arange(len(x)), -200]
    whole = np.floor(np.vstack([x, np.zeros((1, 16))]).astype(float) * 1024).astype(np.int64)
    assert set(got) == {*range(0, len(x), 100), -200}
    for q in got:
        s = whole @ whole[np.flatnonzero(ids == q)[0]]
        best = sorted((-int(s[j]), int(i)) for j, i in enumerate(ids) if i != q)[:10]
        assert sorted(got[q]) == [(k, i, -v) for k, (v, i) in enumerate(best, 1)]
    assert exact_topk.search(rows.limit(0), rows.limit(0), 10).count() == 0
    few = rows.where("vec_id between 0 and 4")
    assert exact_topk.search(few, few.where("vec_id = 0"), 10).count() == 4


def test_cover_tree_covers():
    x = vectors(400).astype(float)
    x[200:] = x[200:] * 0.01 + np.repeat(np.eye(16)[:10] * 50, 20, axis=0)

    def below(n):
        return np.concatenate([n.points, *(below(c) for c in n.children)]).astype(int)

    def walk(n):
        held = below(n)
        assert (np.sqrt(((x[held] - x[n.center]) ** 2).sum(1)) <= n.radius + 1e-9).all()
        for c in n.children:
            assert c.radius <= n.radius / 2 + 1e-9
            walk(c)

    tree = exact_topk.cover_tree(x, leaf=8)
    assert sorted(below(tree).tolist()) == list(range(400)) and tree.children
    walk(tree)
    q = (x[200::7] * 100).astype(np.int64)
    search = exact_topk.DualSearch((x * 100).astype(np.int64), np.arange(400), q, -1 - np.arange(len(q)), 3)
    search.run()
    assert search.visited < 0.8 * len(q) * 400  # clustered rows are pruned


def test_ann_recall(spark):
    x = vectors()
    rows = frame(spark, x)
    got = {}
    for r in ann.search(rows, rows.where("vec_id % 20 = 0"), 20).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, len(x), 20))
    hits = 0
    for q, found in got.items():
        s = np.zeros(len(x))
        for j in range(16):
            s += x[:, j].astype(float) * float(x[q, j])
        best = sorted((-s[i], i) for i in range(len(x)) if i != q)[:20]
        assert [k for k, _, _ in sorted(found)] == list(range(1, 21))
        assert all(v == s[i] for _, i, v in found)
        hits += len({i for _, i in best} & {i for _, i, _ in found})
    assert hits / (20 * len(got)) >= 0.9
    few = rows.where("vec_id between 0 and 4")
    assert ann.search(few, few.where("vec_id = 0"), 20).count() == 4
    assert ann.search(rows.limit(0), rows.limit(0), 20).count() == 0


def test_ann_abandons_and_keeps_recall(spark):
    """Over a sample smaller than the table, with lists that are not all probed."""
    x = np.random.default_rng(6).normal(size=(4000, 16)).astype(np.float32) + np.repeat(np.eye(16, dtype=np.float32)[np.arange(8)] * 4, 500, axis=0)
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    was = ann.SAMPLE, ann.ROWS_PER_LIST
    try:
        ann.SAMPLE, ann.ROWS_PER_LIST = 512, 250
        got = {}
        for r in ann.search(rows, rows.where("vec_id % 80 = 0"), 20).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
    finally:
        ann.SAMPLE, ann.ROWS_PER_LIST = was
    hits = 0
    for q, found in got.items():
        s = x.astype(float) @ x[q].astype(float)
        hits += len({i for _, i in sorted((-s[i], i) for i in range(4000) if i != q)[:20]} & found)
    assert hits / (20 * len(got)) >= 0.9


@pytest.mark.parametrize("search,k,measure", [(ann.search, 20, None), (exact_topk.search, 10, 1024)])
def test_rows_that_share_an_id(spark, search, k, measure):
    """Every row is a candidate: 31 rows of one id may take 31 places; a query's own id never."""
    x = np.random.default_rng(3).normal(size=(130, 8)).astype(np.float32)
    ids = [1] * 31 + [0] + list(range(2, 100))
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in zip(ids, x, strict=True)], "vec_id long, embedding array<float>").repartition(3)
    got = {}
    for r in search(rows, rows.where("vec_id in (0, 1, 40)"), k).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == {0, 1, 40}
    v = np.floor(x.astype(float) * measure).astype(np.int64) if measure else x.astype(float)
    for q, found in got.items():
        mine = v[min((i for i in range(len(ids)) if ids[i] == q), key=lambda i: v[i].tolist())]
        scores = [reduce(lambda t, ab: t + ab[0] * ab[1], zip(r.tolist(), mine.tolist(), strict=True), 0) for r in v]  # in order, as sum() compensates
        best = sorted((-s, i) for s, i in zip(scores, ids, strict=True) if i != q)[:k]
        assert sorted(found) == [(n, i, -s) for n, (s, i) in enumerate(best, 1)]
    same = spark.createDataFrame([(i // 40, [1.0, 2.0]) for i in range(120)], "vec_id long, embedding array<float>")
    assert search(same, same.where("vec_id = 0"), k).count() == k


def test_exact_topk_of_huge_components(spark):
    """Sums beyond 2**53 are exact, ties to the smaller id included; a score that a long can't hold is an error."""
    rows = spark.createDataFrame([(0, [3.0e6, 1.0]), (1, [2.9e6, 1.0]), (2, [2.9e6, 2.0]), (3, [2.9e6, 1.0])], "vec_id long, embedding array<double>")
    got = [(r.rank, r.vec_id, r.score) for r in exact_topk.search(rows, rows.where("vec_id = 0"), 10).orderBy("rank").collect()]
    s = [3000000 * 2900000 * 1024**2 + k * 1024**2 for k in (1, 2)]
    assert got == [(1, 2, s[1]), (2, 1, s[0]), (3, 3, s[0])]
    with pytest.raises(Exception, match="too large|out of bounds|OverflowError"):
        rows = spark.createDataFrame([(i, [1.0e9, 1.0e9]) for i in range(2)], "vec_id long, embedding array<double>")
        exact_topk.search(rows, rows.where("vec_id = 0"), 10).collect()


def test_exact_topk_prunes_across_blocks():
    """With a bound from outside, a block that holds nothing near is left after its root."""
    rng = np.random.default_rng(4)
    x = np.floor(rng.normal(size=(3000, 8)) * 10 + 500)
    q = np.floor(rng.normal(size=(40, 8)) * 10 - 500)
    search = exact_topk.DualSearch(x, np.arange(3000), q, -1 - np.arange(40), 5, np.zeros(40, np.int64))
    assert len(search.run()[0]) == 0 and search.visited == 0


def test_ann_recall_on_given_vectors(spark, sf_middle):
    """The registered query; the lists and the scan answer, as the sample holds a twentieth of the rows."""
    rows = spark.read.parquet(f"{sf_middle}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = {}
    for r in queries.op1_approximate_nearest_neighbours(spark, sf_middle).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert set(got) == {i for i in ids.tolist() if i % 20 == 0}
    hits = 0
    for q, found in got.items():
        s = np.where(ids == q, -np.inf, x @ x[np.flatnonzero(ids == q)[0]])
        hits += len(found & set(ids[np.argsort(-s)[:20]].tolist()))
    assert hits / (20 * len(got)) >= 0.9


def test_a_page_in_one_form(spark):
    """Server-side frameworks put a whole page into a form; forms beside an article still go."""
    article = "".join(f"<p>Paragraph {i} of the article, which has quite a few words in it.</p>" for i in range(5))
    whole = f"<html><body><form><nav><a href='/'>Home</a></nav><div>{article}</div></form></body></html>"
    beside = f"<html><body><div>{article}</div><form><label>Your name, please, and all of your comment</label><input></form></body></html>"
    want = "\n".join(f"Paragraph {i} of the article, which has quite a few words in it." for i in range(5))
    pages = spark.createDataFrame([(1, "u", whole), (2, "u", beside), (3, "u", "<form></form>")], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_text.extract(pages).collect()} == {1: want, 2: want, 3: ""}
