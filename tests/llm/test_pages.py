"""HTML extraction, URL filters, the registry and the pipeline."""

import html
import re
import time

from pyspark.sql import functions as F

from lectern.llm import html_extract, queries, url_filter


def test_pages_give_their_article(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r for r in html_extract.extract(pages).collect()}
    for r in pages.collect():
        a = r.html.index("<article>") + 9
        e = r.html.find("</article>", a)
        body = re.sub("</?b>", "", r.html[a : e if e >= 0 else len(r.html)])
        want = " ".join(x for x in (" ".join(html.unescape(p).split()) for p in re.split("</?(?:p|h1|br)>", body)) if x)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


def test_pages_without_marked_parts_give_the_same(spark, sf):
    """The windows alone find the article: what the page marks as article is a plain div here."""
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        plain = re.sub("<(/?)(?:article|main)\\b", r"<\1div", r.html)
        assert html_extract.main_text(plain) == html_extract.main_text(r.html)


def brute_windows(lines):
    """Kept lines of a page without links and marks: of stretches without a window of empty lines, from the first with a surge to the last one, or else the largest."""
    w, s = html_extract.WINDOW, html_extract.SURGE
    # A left-out element is an empty line where it begins and one where it ends.
    page = [y for x in lines for y in ([x] if x else ["", ""])]
    full = [i for i, x in enumerate(page) if x]
    hills = []
    for i in full:
        if hills and i - hills[-1][-1] <= w:
            hills[-1].append(i)
        else:
            hills.append([i])
    total = lambda i: sum(len(x) for x in page[i : i + w])
    high = [h for h in hills if any(total(i) >= s for i in range(h[0], h[-1] + 1))] or sorted(hills, key=lambda h: sum(len(page[i]) for i in h))[-1:]
    return " ".join(page[i] for h in hills if high[0][0] <= h[0] <= high[-1][0] for i in h)


def test_surge_and_dive_by_brute_force():
    import random

    rng = random.Random(4)
    for _ in range(300):
        lines = [rng.choice(["", "x" * rng.randrange(1, 15), "y" * rng.randrange(20, 90)]) for _ in range(rng.randrange(1, 25))]
        page = "".join(f"<p>{x}</p>" if x else "<form>out</form>" for x in lines)
        assert html_extract.main_text(page) == brute_windows(lines), lines


def test_unmatched_tags_cost_no_more_than_their_number():
    for page in ("<i>" * 40_000 + "</b>" * 40_000 + "end", "<b>" * 20_000 + "<p>x" * 20_000, "<div><i>" * 20_000 + "</b><p>y" * 20_000):
        began = time.process_time()
        assert html_extract.main_text(page)
        assert time.process_time() - began < 2


PAGE = """<!doctype html><html><head><title>T</title><script>if (a < b) "</p>";</script></head><body class="with-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav>
<div class="cookie-notice">We use cookies.</div><div id="content"><h2>Head &amp; more</h2><p>First paragraph, long enough to make the windows surge, as it goes on for a while &mdash; and on.<div class="ad">Buy now!</div><p>Short.<p>Second <b>bo</b>ld
 line<br>after a break.</div><form><label>Mail</label><input></form><section id="comments"><p>A reader writes a long comment that must not be in the text, although it is prose as well.</section><aside>Related</aside><footer>&copy; x</footer>"""


def test_page_without_marked_article():
    assert html_extract.main_text(PAGE) == "Head & more First paragraph, long enough to make the windows surge, as it goes on for a while — and on. Short. Second bold line after a break."


def test_classes_that_only_mention_a_part():
    page = '<div class="page has-sidebar"><div class="article-header"><h1>Own head</h1></div><article class="post no-ads"><p>Text one.</p><div class="comment-list"><p>Not this.</p></div></article><div class="site-header">Not this.</div></div>'
    assert html_extract.main_text(page) == "Text one."
    assert html_extract.main_text(page.replace("article", "div").replace("div-header", "article-header")) == "Own head Text one."


def test_marked_teasers_do_not_replace_the_article():
    body = "<p>The real article stands in plain blocks, and goes on for longer than any of the cards beside it do.</p>" * 4
    cards = "".join(f"<article><h3>Card {k}</h3><p>A few words.</p></article>" for k in range(6))
    want = " ".join(["The real article stands in plain blocks, and goes on for longer than any of the cards beside it do."] * 4)
    assert html_extract.main_text(f"<body><div>{body}</div><div>{cards}</div></body>") == want
    assert html_extract.main_text(f"<body><div>{cards}</div><div>{body}</div></body>") == want
    assert html_extract.main_text(f"<body><p>Short note outside.</p><article>{body}<p>End.</p></article></body>") == want + " End."


def test_extraction_edges(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>hi <b>there</b>.<br>x"), (3, "u", "plain < 3 &am"), (4, "u", "<article><p>a<article><p>b"), (5, "u", "<!-- never closed <p>x"), (6, "u", "<script>x"), (7, "u", "<p>" + "w " * 100_000), (8, "u", "<nav><p>only a menu</nav>"), (8, "u", "<div><div>" * 3000 + "deep")]
    d = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = [(r.page_id, r.text) for r in html_extract.extract(d).collect()]
    want = {1: "", 2: "", None: "hi there. x", 3: "plain < 3 &am", 4: "a b", 5: "", 6: "", 7: " ".join(["w"] * 100_000)}
    assert len(got) == len(rows) and all(t == want[i] for i, t in got if i in want)
    assert html_extract.extract(d.limit(0)).count() == 0


def test_intervals(spark):
    e = [("k", "block", "add", "2024-01-02"), ("k", "block", "add", "2024-01-05"), ("k", "block", "remove", "2024-02-01"), ("k", "block", "remove", "2024-02-02"), ("k", "block", "add", "2024-03-01"), (None, "block", "add", "2024-01-01"), ("k", "block", "add", None), ("K2", "allow", "remove", "2024-01-01")]
    d = spark.createDataFrame(e, "key string, list string, action string, at string").withColumn("at", F.col("at").cast("timestamp_ntz"))
    got = sorted((r.key, r.list, str(r.since)[:10], str(r.until)[:10]) for r in url_filter.intervals(d).collect())
    assert got == [("k", "block", "2024-01-02", "2024-02-01"), ("k", "block", "2024-03-01", "None")]


def test_url_filter(spark):
    e = spark.createDataFrame([("example.org", "block", "add", "2024-01-01"), ("good.example.org", "allow", "add", "2024-02-01")], "key string, list string, action string, at string").withColumn("at", F.col("at").cast("timestamp_ntz"))
    rows = [(1, "http://A.example.org/x", "2024-01-05"), (2, "https://good.example.org:8080", "2024-01-05"), (3, "https://u@good.example.org/", "2024-03-05"), (4, "https://example.org.evil.net/", "2024-03-05"), (5, None, "2024-03-05"), (6, "no url", "2024-03-05"), (7, "http://example.org", None), (1, "http://A.example.org/x", "2024-01-05"), (8, "http://[::1]:80/x", "2024-01-05")]
    c = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, fetched string, key string").withColumn("fetched", F.col("fetched").cast("timestamp_ntz"))
    rows = url_filter.url_filter(c, e).collect()
    assert sorted((r.page_id, r.verdict) for r in rows) == [(1, "block"), (1, "block"), (2, "block"), (3, "allow"), (4, "none"), (5, "none"), (6, "none"), (7, "none"), (8, "none")]
    assert [r.host for r in rows if r.page_id == 8] == ["[::1]"]
    assert url_filter.url_filter(c, e.limit(0)).where("verdict <> 'none'").count() == 0
    assert url_filter.url_filter(c.limit(0), e).count() == 0


def test_oracles(spark, sf, duck):
    for name, sql in queries.ORACLES.items():
        df, rel = queries.QUERIES[name](spark, sf), duck.sql(sql)
        names = sorted(df.columns)
        assert names == sorted(rel.columns)
        want = [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()]
        assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr) == sorted((tuple(r[c] for c in names) for r in want), key=repr)


def test_pipeline_stages_on_edges(spark, sf):
    """Nulls, empty texts, repeated rows, ties, columns with the operators' own names; and empty tables."""
    import corpus_pipeline as c

    long = " ".join(f"w{k}" for k in range(80))
    rows = [(1, long, "en"), (1, long, "en"), (None, long, "en"), (3, long.upper(), None), (4, long + " more", "xx"), (5, None, None), (6, "", "en"), (None, None, None), (None, "b " + long[2:], ""), (7, "few words", "en"), (7, " ".join(f"v{k}" for k in range(70)), "en")]
    full = [(*r, "s", 1, k, "t", "u", 2.0, 3, [k]) for k, r in enumerate(rows)]
    docs = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, _key int, _sha string, digest string, row double, id int, sha array<int>")
    every = {repr(tuple(r)) for r in docs.collect()}
    now = docs
    for k, (name, stage) in enumerate(c.STAGES):
        for table in (docs, docs.limit(0)):
            got = stage(spark, table, sf)
            if k + 1 < len(c.STAGES):
                assert got.columns == docs.columns, name
                assert {repr(tuple(r)) for r in got.collect()} <= (every if table is docs else set()), name
            else:
                assert got.count() == table.count()
        now = stage(spark, now, sf).persist()
        ids = [(r.doc_id, r._key) for r in now.collect()] if k + 1 < len(c.STAGES) else None
        if name == "quality_rules":
            assert sorted(x[1] for x in ids) == [0, 1, 2, 3, 4, 8, 10]
        if name == "exact_dedup":
            assert sorted(x[1] for x in ids) == [0, 4, 8, 10]
        if name == "ngram_jaccard_join":
            assert sorted(x[1] for x in ids) == [0, 10]


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as c
    from helpers import LOWER

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    for k, (name, stage) in enumerate(c.STAGES):
        docs = stage(spark, docs, sf).persist()
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        if k + 1 < len(c.STAGES):
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert all(tuple(r) == tuple(before[r.doc_id]) for r in docs.collect())
        if name == "exact_dedup":
            texts = [r.text.translate(LOWER) for r in docs.collect()]
            assert len(set(texts)) == len(texts)
        if name == "ngram_jaccard_join":
            from test_documents import brute_links

            now = brute_links([(r.doc_id, r.text) for r in docs.collect()])
            assert all(x[2] == 0 for x in now.values())
        assert set(ids) <= set(before)
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
