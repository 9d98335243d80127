"""Quality, page texts, exact search and the pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.llm import html, quality, topk

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body class="ad-free"><nav><ul><li><a href="/">Home</a><li>More</ul></nav>
<div class="cookie-notice">We use cookies</div><aside>Side</aside><article><h1>Title &amp; {0}</h1><p>First <b>bold</b>
 text {0}<p>Second &copy; 2 &am<br>line<script>var x = "<p>no</p>";</script><form><input>Send</form><ul><li>one<li>two</ul></article>
<section class="comments"><article class="comment">Nice!</article></section><footer>Foot {0}</footer>"""


def test_page_text_without_what_stands_around():
    assert html.main_text(PAGE.format("A")) == "Title & A First bold text A Second © 2 &am line one two"


def test_templates_tell_pages_without_an_article_apart():
    page = "<body><div class=top>Welcome</div><div><p>Story {0}</p><p>More of {0}</p></div><div>All rights</div></body>"
    template = None
    for k in range(6):
        template = html.merged(template, html.tree(html.parse(page.format(f"{k}, which is longer than the rest of it"))))
    template = html.loads(html.dumps(template))
    assert html.main_text(page.format(3), template) == "Story 3 More of 3"
    assert html.main_text(page.format(3), None) == "Welcome Story 3 More of 3 All rights"


def test_constants_inside_articles_go_and_copies_stay():
    page = "<article><h1>{0}</h1><p>All about {0} and so on, at length.</p><p>Read it, share it</p></article>"
    of = lambda names: html.loads(html.dumps(__import__("functools").reduce(html.merged, (html.tree(html.parse(page.format(n))) for n in names))))
    assert html.main_text(page.format("B"), of("ABCD")) == "B All about B and so on, at length."
    assert html.main_text(page.format("A"), of("AAAA")) == "A All about A and so on, at length. Read it, share it"


def test_teasers_are_not_the_article():
    page = "<article>one</article><div><p>" + "The main text of this page. " * 9 + "</p></div><article>two</article>"
    assert html.main_text(page) == "one " + ("The main text of this page. " * 9).strip() + " two"


@pytest.mark.parametrize("tag", ["div", "span", "nav", "p", "ul", "article"])
def test_very_deep_pages(tag):
    deep = f"<{tag}>" * 100_000 + "text" + f"</{tag}>" * 100_000 + "<p>end"
    template = html.loads(html.dumps(html.tree(html.parse(deep))))
    assert html.main_text(deep, template) in ({"nav": ["end"], "article": ["text"]}.get(tag, ["text end"]))


def brute_matching(a, b):
    """Simple tree matching by its recursion alone."""
    if a[0] != b[0]:
        return 0

    def align(x, y):
        if not x or not y:
            return 0
        return max(align(x[:-1], y), align(x, y[:-1]), align(x[:-1], y[:-1]) + brute_matching(x[-1], y[-1]))

    return 1 + align(a[3], b[3])


def test_tree_matching_against_brute_force():
    r = random.Random(8)

    def some(depth):
        return "".join(f"<{t}>{some(depth - 1) if depth else r.choice('xyz')}</{t}>" for t in r.choices(["div", "section", "h2", "ul"], k=r.randint(1, 3)))

    for _ in range(40):
        a, b = (html.tree(html.parse(some(2))) for _ in range(2))
        assert html.matched(a, b) == brute_matching(a, b)


def test_templates_help_where_nothing_is_marked(spark):
    """Pages of the test data without <article>, and without class names: what stands around must go."""
    import re

    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    better = n = 0
    for k in range(6):  # hosts made of the pages' articles, each with a frame of its own
        own = [r for r in rows if r.page_id % 6 == k][:12]
        frame = f"<div><p>Menu of host {k}</p><p>Welcome to it</p></div>{{}}<div><p>All rights at host {k}</p></div>"
        bodies = [re.search(r"<article>(.*)</article>", r.html, re.S) for r in own]
        bodies = ["<div>" + re.sub(r' class="[^"]*"', "", m[1]) + "</div>" for m in bodies if m]
        template = None
        for body in bodies:
            template = html.merged(template, html.tree(html.parse(frame.format(body))))
        for body in bodies:
            want, page = html.main_text(body), frame.format(body)
            n += 1
            better += html.main_text(page, template) == want and html.main_text(page, None) != want
    assert n >= 50 and better >= 0.95 * n


def test_simple_tree_matching_counts_pairs():
    t = lambda x: html.tree(html.parse(x))
    a, b = t("<div><h1>a</h1><p>b</p><ul><li>c</ul></div>"), t("<div><p>b</p><table></table><ul><li>x<li>y</ul></div>")
    assert html.matched(a, b) == html.matched(b, a) == 7  # page, div, p, its text, ul, li, its text
    both = html.merge(a, b)
    assert both[1] == 2 and [c[0] for c in both[3][0][3]] == ["h1.#", "p.#", "table.#", "ul.#"]


@pytest.mark.parametrize("bad", ["", "<", "<p", "</p></p>", "<![CDATA[x", "<!DOCTYPE", "a & b &#0; &#x110000;", "<p>" * 300, "<!-- open"])
def test_broken_pages_dont_fail(bad):
    assert isinstance(html.main_text(bad), str)


def test_pages_frame(spark):
    rows = [(k, f"http://Host.example/{k % 3}", PAGE.format(k), "x") for k in range(9)] + [(9, None, None, "x"), (9, None, None, "x"), (10, "no url", "<p>alone", "x")]
    df = spark.createDataFrame(rows, "page_id int, url string, html string, host string")
    got = html.extract(df).orderBy("page_id").collect()
    assert [r.text for r in got] == [f"Title & {k} First bold text {k} Second © 2 &am line one two" for k in range(9)] + ["", "", "alone"]
    assert html.extract(df.where("page_id < 0")).count() == 0


def brute_top(vectors, queries, k):
    out = []
    for q, x in queries:
        own = sorted(((-sum(a * b for a, b in zip(x, y, strict=False)), i) for i, y in vectors if i != q))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(own)]
    return sorted(out)


def test_exact_search(spark):
    rng = np.random.default_rng(5)
    vectors = [(i, rng.normal(0, 1, 40).tolist()) for i in range(700)]
    vectors += [(i, vectors[3][1]) for i in range(700, 760)]  # ties
    odd = [(900, None), (901, [float("nan")] * 40), (902, [1.0, None]), (903, [float("inf")]), (904, []), (905, [0.5]), (None, [1.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in vectors + odd], "vec_id long, embedding array<float>, score int")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 100 == 0, 10).collect())
    scaled = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in vectors + [(904, []), (905, [0.5])]]
    assert got == brute_top(scaled, [(i, v) for i, v in scaled if i % 100 == 0], 10)
    assert topk.top_k(df.where("vec_id < 0"), F.col("vec_id") % 100 == 0).count() == 0


def test_search_with_repeated_query_rows(spark):
    rng = np.random.default_rng(6)
    vectors = [(i, rng.normal(0, 1, 8).tolist()) for i in range(300)]
    vectors += [vectors[100], (200, rng.normal(0, 1, 8).tolist())]  # the same row again, and another one under a used id
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in vectors], "vec_id long, embedding array<float>, row int, is_query int")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 100 == 0, 10).collect())
    scaled = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in vectors]
    want = []
    for q, (i, x) in enumerate(scaled):
        if i % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), j) for c, (j, y) in enumerate(scaled) if c != q)[:10]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert got == sorted(want) and len(got) == 50


def test_large_components_stay_exact(spark):
    df = spark.createDataFrame([(i, [float(2**20 + i), -float(2**19 - 7 * i)]) for i in range(0, 300)], "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 100 == 0, 3).collect())
    scaled = [(r.vec_id, [int(1024 * x) for x in r.embedding]) for r in df.collect()]
    assert got == brute_top(scaled, [(i, v) for i, v in scaled if i % 100 == 0], 3)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghijklmnop", k=r.randint(2, 8))) for _ in range(n))


def labelled(spark):
    rows, labels = [], []
    for k in range(240):
        good = k % 3 != 0
        text = prose(k, 60).capitalize() + ". " + prose(k + 999, 40) + "." if good else "BUY NOW!! " * 30 if k % 2 else "a | b | " * 40
        rows.append((k, text, "en", f"src{k % 4}", len(text)))
        if k % 5:
            labels.append((k, int(good), 0))
    labels += [(None, 1, 0), (10**6, 0, 0), (3, None, 0)]
    rows += [(500, None, None, None, None), (501, "", "en", "alone", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_on_held_out_labels(spark):
    docs, labels = labelled(spark)
    got = {r.doc_id: r for r in quality.score(docs, labels).collect()}
    assert len(got) == 242
    assert all((got[k]._posterior >= 0.5) == (k % 3 != 0) for k in range(240) if k % 5 == 0)
    # the same combination by hand
    sites, rows = {}, [r for r in got.values()]
    for r in rows:
        sites.setdefault((r.source, r.lang), []).append(r._evidence)
    share = sum(r._evidence for r in rows) / len(rows)
    r = got[1]
    odds = r._evidence / (1 - r._evidence) * r._path_share / (1 - r._path_share) * (1 - share) / share
    assert r._posterior == pytest.approx(odds / (1 + odds))
    own = sites[(r.source, r.lang)]
    low, high = sorted(((sum(own) - r._evidence) / (len(own) - 1), r._host_share))
    assert low - 1e-9 <= r._path_share <= high + 1e-9
    assert quality.good_documents(docs, labels).columns == docs.columns
    assert quality.good_documents(docs, labels.where("quality = 1")).count() == 242
    assert quality.good_documents(docs, labels.limit(0)).count() == 242
    assert quality.good_documents(docs.limit(0), labels).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs, labels = labelled(spark)
    more = docs.where("doc_id in (1, 2)").withColumn("doc_id", F.col("doc_id") + 1000)
    docs.unionByName(more).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    rows = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, str(tmp_path))
        assert out.columns == docs.columns
        rows = spark.createDataFrame(out.collect(), out.schema)
    ids = {r.doc_id for r in rows.collect()}
    assert {1, 2, 4, 5} <= ids and not {0, 3, 6, 1001, 1002} & ids
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == ids


@pytest.mark.parametrize("names", ["layout has-sidebar", "content no-sidebar", "page with-header", "post-content social-science", "main-content related-party", "is-menu-open", "headerless"])
def test_names_of_wrappers_that_only_sound_like_side_blocks(spark, names):
    page = f'<html><body><div class="{names}"><p>The text of the page.</p></div><div class="site-header">Top</div><div id="sidebarLeft">Side</div><div class="cookie-banner">Note</div></body></html>'
    rows = spark.createDataFrame([(1, "http://a.b/c", page)], "page_id long, url string, html string")
    assert html.extract(rows).first().text == "The text of the page."
