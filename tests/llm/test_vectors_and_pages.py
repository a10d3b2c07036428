"""Embeddings, pages and the pipeline."""

import random

import duckdb
import numpy as np
import pyspark.sql.functions as F
import pytest

import corpus_pipeline
from driftmark.llm import embed_lsh, queries, substring_dedup, wrapper


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_twin(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
    got = queries.queries()[name](spark, sf)
    want = con.sql(f"select {', '.join(got.columns)} from ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_lattice_points_are_nearest():
    rng = np.random.default_rng(0)
    y = rng.uniform(-2, 2, (2000, 8))
    p = embed_lsh.nearest_e8(y)
    own = ((2 * y - p) ** 2).sum(axis=1)
    other = ((2 * y[:, None] - p[:, None] - embed_lsh.FACETS[None]) ** 2).sum(axis=2).min(axis=1)
    assert len(embed_lsh.FACETS) == 240 and (own <= other + 1e-9).all()


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    rows = []
    for g in range(40):
        base = rng.standard_normal(64)
        for _ in range(rng.integers(1, 8)):
            rows.append((len(rows), (base + 0.15 * rng.standard_normal(64)).astype("float32").tolist(), int(g % 3)))
    rows += [(len(rows), rows[4][1], rows[4][2]), (len(rows) + 1, [2 * x for x in rows[4][1]], rows[4][2]), (len(rows) + 2, rows[4][1], 9)]
    odd = [(900, None, 1), (901, [0.0] * 64, 1), (902, [float("nan")] * 64, 1), (903, [None] * 64, 1), (904, [], 1), (905, rows[0][1], None), (None, rows[0][1], 0), (906, [1.0, 2.0], 0)]
    df = spark.createDataFrame([(i, v, lab, 1, "a") for i, v, lab in rows + odd], "vec_id long, embedding array<float>, label int, n_links int, key string")
    x = np.array([v for _, v, _ in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    lab = np.array([z for _, _, z in rows])
    link = (x @ x.T >= 0.93) & (lab[:, None] == lab[None])
    np.fill_diagonal(link, False)
    part = np.arange(len(rows))
    for _ in range(len(rows)):
        part = np.array([min([part[i], *part[link[i]]]) for i in range(len(rows))])
    got = {r["vec_id"]: r for r in embed_lsh.lattice_duplicates(df).collect()}
    assert len(got) == len(rows) + len(odd)
    for k, (i, _, _) in enumerate(rows):
        assert got[i]["n_links"] == link[k].sum() and got[i]["component_id"] == rows[part[k]][0]
        assert got[i]["kept"] == (got[i]["component_id"] == i)
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i, _, _ in odd)
    assert embed_lsh.lattice_duplicates(df.limit(0)).count() == 0


def page(title, body, extra=""):
    return (
        f"<html><head><title>t</title><script>var t='</p>';</script><style>p{{}}</style></head><body><header><p>Site</p></header><nav><ul><li><a href='/'>Home</a></li></ul></nav>"
        f"<div class='cookie-notice'>We use cookies</div><article><h1>{title}</h1>{body}<div class='comments'><p>nice!</p></div></article>{extra}<aside>side</aside><form><p>mail</p></form><footer>&copy; x</footer>"
    )


def test_pages(spark):
    rows = [(i, f"https://a.example/{i}", page(f"Title {i}", f"<p><b>First  &amp; {i}<br>line<p>Second\n{i}</p><ul><li>x{i}<li>y</ul>")) for i in range(8)]
    # No article element: the promotion between the texts is the same on all pages and goes as template.
    rows += [(20 + i, f"http://B.example/{i}", f"<body><div><p>Story {i} goes on</p></div><div><p>Buy our paper today</p></div><div><p>End of {i}</p></div><div><a href='/'>More stories</a></div></body>") for i in range(6)]
    # Copies of one page are no evidence of a template.
    rows += [(40 + i, f"http://c.example/{i}", page("Same", "<p>Same text</p>")) for i in range(9)]
    rows += [(60, None, "<p>plain &eacute;</p>"), (61, "http://d", None), (62, "::bad", ""), (63, "http://d", "<p>" * 3000 + "deep"), (None, "http://d", "no tags")]
    df = spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], "page_id long, url string, html string, text string, host string")
    got = {r["page_id"]: r for r in wrapper.extract_main_text(df).collect()}
    assert len(got) == len(rows)
    for i in range(8):
        assert got[i]["text"] == f"Title {i}\n\nFirst & {i} line\n\nSecond {i}\n\nx{i}\n\ny"
        assert got[i]["n_chars"] == len(got[i]["text"])
    for i in range(6):
        assert got[20 + i]["text"] == f"Story {i} goes on\n\nEnd of {i}"
    assert got[40]["text"] == "Same\n\nSame text"
    assert [got[i]["text"] for i in (60, 61, 62, 63, None)] == ["plain é", "", "", "deep", "no tags"]
    assert wrapper.extract_main_text(df.limit(0)).count() == 0


def test_pages_without_an_end_of_head():
    texts = lambda html: [b[1] for b in wrapper.parse_page(html)[1]]
    head = "<html><head><meta charset=utf-8><title>t</title><script>x<y</script>"
    for body in ("<body><p>One<p>Two", "<p>One<p>Two", "<body>One<p>Two</body></html>", "One<p>Two", "<span>One</span><p>Two"):
        assert texts(head + body) == texts(head + "</head>" + body) == ["One", "Two"]


def test_pages_keep_varying_slots_whatever_their_names(spark):
    words = lambda i: " ".join(f"word{i}x{j}" for j in range(30))
    rows = []
    for i in range(6):
        body = f"<header class='post-header'><h1>Title {i}</h1></header><p>{words(i)}</p><section id='search-algorithms'><p>Section {i}</p></section><div class='comments'><p>nice {i}</p></div>"
        rows.append((i, f"http://a.example/{i}", f"<body><div class='layout has-sidebar'><article class='post comments-open'>{body}</article></div>"))
        refs = f"<ul><li><a href='x'>Reference {i}</a></li></ul>"
        rows.append((10 + i, f"http://b.example/{i}", f"<body><div class='layout has-sidebar'><p>{words(i)}</p>{refs}</div><div><p><a href='y'>More {i % 2}</a></p></div>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in wrapper.extract_main_text(df).collect()}
    for i in range(6):
        assert got[i] == f"Title {i}\n\n{words(i)}\n\nSection {i}"
        assert got[10 + i] == f"{words(i)}\n\nReference {i}"


def test_tree_matching():
    a = [(0, "r"), (1, "a"), (2, "x"), (1, "b"), (1, "c")]
    b = [(0, "r"), (1, "b"), (1, "a"), (2, "x"), (2, "y"), (1, "c")]
    assert wrapper.simple_tree_matching(a, b) == {0: 0, 1: 2, 2: 3, 4: 5}
    assert wrapper.simple_tree_matching(a, [(0, "q")]) == {}


def test_pages_of_another_kind_keep_their_text(spark):
    """The host's wrapper has little text in its first container; a page of another kind has all of its text there."""
    words = lambda i, n: " ".join(f"word{i}x{j}" for j in range(n))
    rows = [(i, f"http://a.example/{i}", f"<body><div><p>{words(i, 3)}</p></div><div><h1>Title {i}</h1><p>{words(i, 80)}</p></div></body>") for i in range(30)]
    rows.append((99, "http://a.example/99", f"<body><div><p>{words(99, 60)}</p></div></body>"))
    got = {r["page_id"]: r["text"] for r in wrapper.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[99] == words(99, 60) and got[3] == f"Title 3\n\n{words(3, 80)}"


def test_repeated_pages_repeat_their_text(spark):
    page = lambda i: f"<body><nav><a href='/'>Home</a></nav><article><h1>Title {i}</h1><p>Words of {i}</p></article></body>"
    rows = [(i, f"http://a.example/{i}", page(i)) for i in range(7)] + [(3, "http://a.example/3", page(3))] * 9 + [(None, None, None)] * 2
    got = [(r["page_id"], r["text"]) for r in wrapper.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    want = [(i, "" if i is None else f"Title {i}\n\nWords of {i}") for i, _, _ in rows]
    assert sorted(got, key=str) == sorted(want, key=str)


def random_tree(rng, n):
    """A tree as (depth, label) in page order."""
    out = [(0, "r")]
    while len(out) < n:
        out.append((rng.randint(1, out[-1][0] + 1), rng.choice("abc")))
    return out


def matched(a, b):
    """Simple tree matching by plain recursion: the number of matched nodes."""
    kids = lambda t, i: [k for k in range(i + 1, len(t)) if t[k][0] == t[i][0] + 1 and all(t[x][0] > t[i][0] for x in range(i + 1, k))]

    def go(i, j):
        if a[i][1] != b[j][1]:
            return 0
        x, y = kids(a, i), kids(b, j)
        grid = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for m in range(len(x)):
            for n in range(len(y)):
                grid[m + 1][n + 1] = max(grid[m][n + 1], grid[m + 1][n], grid[m][n] + go(x[m], y[n]))
        return 1 + grid[-1][-1]

    return go(0, 0)


def test_tree_matching_against_plain_recursion(monkeypatch):
    rng = random.Random(15)
    whole = wrapper._pairs
    for most in (1 << 20, 6):
        monkeypatch.setattr(wrapper, "_pairs", lambda weights, most=most: whole(weights, most))
        for _ in range(60):
            a, b = random_tree(rng, rng.randint(1, 30)), random_tree(rng, rng.randint(1, 30))
            found = wrapper.simple_tree_matching(a, b)
            assert len(found) == matched(a, b) == len(set(found.values()))
            for i, j in found.items():  # labels agree, and order and descent are kept
                assert a[i][1] == b[j][1] and a[i][0] == b[j][0]
            line = sorted(found.items())
            assert [j for _, j in line] == sorted(j for _, j in line)
    deep = [(i, "d") for i in range(5000)]
    assert len(wrapper.simple_tree_matching(deep, deep[:4000])) == 4000
    wide = [(0, "r"), *[x for i in range(1500) for x in ((1, "a"), (2, f"b{i % 700}"))]]
    assert len(wrapper.simple_tree_matching(wide, wide[:-2])) == len(wide) - 2


def test_deep_pages_keep_their_text(spark):
    rows = [(i, f"http://a.example/{i}", "<div>" * 3000 + f"<p>text {i}" + "</div>" * 3000) for i in range(6)]
    got = wrapper.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {(r["page_id"], r["text"]) for r in got} == {(i, f"text {i}") for i in range(6)}


def test_slots_find_the_article_without_its_tags(spark):
    """The test pages, whose menus, adverts and footers change from page to page, with their telling elements and names
    taken away: slots alone must find what stands in the article."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    plain = pages
    for tag in ("article", "nav", "footer"):
        plain = plain.withColumn("html", F.expr(f"regexp_replace(html, '<(/?){tag}>', '<$1div>')"))
    plain = plain.withColumn("html", F.expr("replace(html, '<div class=\"ad\">', '<div>')"))
    want = {r["page_id"]: r["text"] for r in wrapper.extract_main_text(pages).collect()}
    bare = {r["page_id"]: r["text"] for r in wrapper.extract_main_text(plain).collect()}
    off = {r["page_id"]: r["text"] for r in wrapper.extract_main_text(pages, tags=False).collect()}
    counts = pages.groupBy(F.expr("lower(try_parse_url(url, 'HOST'))").alias("h")).count().filter("count >= 8").select("h")
    large = {r["page_id"] for r in pages.join(counts, F.expr("lower(try_parse_url(url, 'HOST'))") == F.col("h")).collect()}
    assert len(large) > 50
    for got in (bare, off):
        hit = [sum(len(b) for b in got[i].split("\n\n") if b in want[i].split("\n\n")) for i in large]
        assert sum(hit) / sum(len(want[i]) for i in large) > 0.98  # recall
        assert sum(hit) / sum(len(got[i]) for i in large) > 0.98  # precision


def test_page_texts_against_the_marked_article(spark):
    """Every test page marks its article, which a regular expression finds as well."""
    import html as h
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in wrapper.extract_main_text(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        blocks = [" ".join(h.unescape(re.sub(r"<br>", " ", re.sub(r"</?(?:b|i|em|a)\b[^>]*>", "", x))).split()) for x in re.split(r"</?(?:p|h1|ul|li|div|blockquote|table|tr)\b[^>]*>", inner)]
        assert got[r["page_id"]] == "\n\n".join(b for b in blocks if b), r["page_id"]


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, sf)
        if name == corpus_pipeline.STAGES[-1][0]:
            break
        assert after.columns == docs.columns and after.dtypes == docs.dtypes
        assert after.select("doc_id").exceptAll(before.select("doc_id")).count() == 0
        if name == "suffix-array dedup":
            spans = {r["doc_id"]: r for r in substring_dedup.repeated_spans(before, length=corpus_pipeline.PASSAGE).collect()}
            texts = {r["doc_id"]: r["text"] for r in before.collect()}
            assert after.count() == before.count()
            for r in after.collect():
                s, raw, at, kept = spans[r["doc_id"]], texts[r["doc_id"]].encode(), 0, b""
                for a, b in zip([*s["starts"], len(raw)], [*s["ends"], len(raw)]):
                    kept += raw[at:a].decode(errors="ignore").encode()
                    at = b
                assert r["text"].encode() == kept and r["n_chars"] == len(r["text"])
        before = after.cache()
    packed = after.collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in before.filter(F.length("text") > 0).collect()}


def test_pipeline_on_awkward_rows(spark):
    sf = "/root/testdata/sf0.001"
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "a text without id " * 20, "en", "s", 1), (3, "x " * 50, None, "s", 100), (3, "x " * 50, None, "s", 100)]
    for some in (rows, []):
        docs = spark.createDataFrame(some, schema)
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, sf).count() <= len(some)


def test_pipeline_on_repeated_and_null_ids(spark):
    sf = "/root/testdata/sf0.001"
    clean = spark.read.parquet(f"{sf}/documents.parquet")
    schema = clean.schema
    for _, stage in corpus_pipeline.STAGES[:2]:
        clean = stage(spark, clean, sf)
    picked = []
    for r in clean.filter("length(text) > 1000").orderBy("doc_id").collect():
        if not any(r["text"][i : i + 60] in p["text"] for p in picked for i in range(0, len(r["text"]) - 60, 30)):
            picked.append(r)
    a, b, c, d = picked[:4]
    null = lambda r, text: (None, text, r["lang"], r["source"], len(text))
    # Two rows of one id, two null-id copies, and a null-id text that shares a passage with another document.
    rows = [tuple(a), tuple(a), null(b, b["text"]), null(b, b["text"]), null(c, c["text"] + " " + d["text"][:600]), tuple(d)]
    docs = spark.createDataFrame(rows, schema).repartition(3)
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, sf)
    cut = [(r["doc_id"], r["text"].strip()) for r in docs.collect()]
    want = [(a["doc_id"], a["text"]), (None, b["text"]), (None, c["text"]), (d["doc_id"], d["text"][600:])]
    assert sorted(cut, key=str) == sorted(((i, t.strip()) for i, t in want), key=str)
    packed = corpus_pipeline.packing_stage(spark, docs, sf).filter("start = 0").collect()
    assert sorted(str(r["doc_id"]) for r in packed) == sorted(str(i) for i, _ in want)


@pytest.mark.parametrize("partitions", [1, 3])
def test_ids_on_several_vectors_keep_all_links(spark, partitions):
    rng = np.random.default_rng(17)
    a, b = (rng.standard_normal(64) for _ in range(2))
    rows = [(5, a, 1), (5, b, 1), (7, a + 0.01, 1), (8, b + 0.01, 1), (9, a, 2), (5, a, 1)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame([(i, v.tolist(), z) for i, v, z in order], "vec_id long, embedding array<double>, label int").repartition(partitions)
        got = {(r["vec_id"], r["n_links"], r["component_id"]) for r in embed_lsh.lattice_duplicates(df).collect()}
        assert got == {(5, 2, 5), (7, 2, 5), (8, 1, 5), (9, 0, 9)}


def test_stages_and_pipelines_side_by_side(spark):
    """Results that are held unread, and two runs at once in one session, do not disturb each other."""
    from concurrent.futures import ThreadPoolExecutor

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = corpus_pipeline.quality_rules_stage(spark, docs, sf)
    want = corpus_pipeline.quality_rules_stage(spark, docs.limit(0), sf).count(), held.count()
    corpus_pipeline.quality_rules_stage(spark, docs.filter("doc_id > 50"), sf).count()
    assert (0, held.count()) == want
    with ThreadPoolExecutor(2) as pool:
        both = list(pool.map(lambda _: sorted(map(str, corpus_pipeline.run(spark, sf).collect())), range(2)))
    assert both[0] == both[1]


def test_formulas_stay(spark):
    html = page("Energy", "<p>Energy <math><mi>E</mi><mo>=</mo><mi>m</mi></math> holds.</p>")
    df = spark.createDataFrame([(1, "http://a.example/1", html)], "page_id long, url string, html string")
    assert "Energy E = m holds." in wrapper.extract_main_text(df).first()["text"].replace("E=m", "E = m")
