import base64
import gzip
import hashlib
import random

import numpy as np
import pytest

from sparkbags.llm import graph, html_text, near_vectors, warc
from sparkbags.llm.common import work_dir


def test_components(spark):
    r = random.Random(2)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000, 1000), (None, 4), *((i, i + 1) for i in range(400, 440))]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in links:
        if a is not None and b is not None:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {x.node: x.component for x in graph.components(spark.createDataFrame(links, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in root}
    assert graph.components(spark.createDataFrame([], "src long, dst long")).count() == 0


def plain_links(rows):
    ok = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) == 64 and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    x = np.array([v / np.abs(v).max() for _, v in ok]).reshape(-1, 64)
    x /= np.sqrt((x * x).sum(1))[:, None]
    near = x @ x.T >= 0.9
    return {(ok[a][0], ok[b][0]) for a, b in zip(*np.nonzero(np.triu(near, 1)), strict=True)}


@pytest.mark.parametrize("settings", [{}, {"cell": 16, "block": 10}])
def test_near_vectors(spark, settings):
    r = np.random.default_rng(1)
    base = r.standard_normal((40, 64))
    rows = []
    for i in range(400):
        v = base[i % 40] / np.linalg.norm(base[i % 40])
        u = r.standard_normal(64)
        u -= u @ v * v
        c = 0.99 - 0.03 * r.random()
        rows.append((i, (c * v + np.sqrt(1 - c * c) * u / np.linalg.norm(u)).tolist()))
    odd = [(1000, None), (1001, [0.0] * 64), (1002, [float("nan")] * 64), (1003, [None] + [1.0] * 63), (1004, []), (1005, [1.0] * 3), (1006, rows[0][1])]
    df = spark.createDataFrame([(*x, 1) for x in rows + odd], "vec_id long, embedding array<double>, k int")
    want = plain_links(rows + odd)
    got = {x.vec_id: x for x in near_vectors.near(df, **settings).collect()}
    assert len(got) == 407 and sum(x.n_links for x in got.values()) >= 0.95 * 2 * len(want)
    n = {k: sum(k in p for p in want) for k in got}
    assert all(x.n_links <= n[k] for k, x in got.items())
    assert all(x.kept == (x.vec_id == x.component_id) for x in got.values())
    assert all(got[k].n_links == 0 and got[k].kept for k in range(1000, 1006)) and got[1006].n_links > 0
    assert near_vectors.near(df.limit(0)).count() == 0 and near_vectors.near(df.where("vec_id in (1000, 1004)")).count() == 2


def test_near_vectors_of_any_length_and_repeated_keys(spark):
    """Every row counts, whatever its key; lengths don't mix."""
    a, b, c = [1.0, 2.0, 3.0], [1.0, 2.0, 3.1], [1.0] * 5
    rows = [(1, a), (1, a), (2, a), (None, b), (7, [0.0, 0.0, -1.0]), (8, c), (9, c), (None, c), (None, None), (None, None)]
    got = near_vectors.near(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in got) == sorted([("1", 3, "1", True), ("1", 3, "1", True), ("2", 3, "1", False), ("None", 3, "1", False), ("7", 0, "7", True), ("8", 2, "8", True), ("9", 2, "8", False), ("None", 2, "8", False), ("None", 0, "None", True), ("None", 0, "None", True)])


def test_equal_vectors_are_one_node(spark):
    from pyspark.sql import functions as F

    many = spark.range(30_000).select(F.col("id").alias("vec_id"), F.array(*[F.lit(float(i % 7) + 1) for i in range(64)]).alias("embedding"))
    out = near_vectors.near(many).agg(F.min("n_links"), F.max("n_links"), F.max("component_id"), F.count("*")).first()
    assert tuple(out) == (29_999, 29_999, 0, 30_000)


def test_the_session_keeps_its_settings(spark):
    """Operators bound their Arrow batches without leaving that to the caller."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = [spark.conf.get(k) for k in names]
    warc.round_trip(spark.createDataFrame(PAGES[:2], SCHEMA)).count()
    html_text.extract(spark.createDataFrame(PAGES[:2], SCHEMA)).count()
    assert [spark.conf.get(k) for k in names] == before


def test_window_counts_reach_the_recall_they_are_set_for():
    r = np.random.default_rng(3)
    p = r.standard_normal((20000, near_vectors.PROJECTIONS))  # differences of pairs at the threshold
    assert (np.sum(np.abs(p) <= near_vectors.WINDOW, 1) >= near_vectors.least_count()).mean() >= 1 - near_vectors.MISS


PAGES = [(1, "u", None, "x"), (2, "", "x", "x"), (3, None, "x", "x"), (4, "u\nv", "", "x"), (5, "u", "é\r\n\r\n0\r\n\r\n" * 9000, "x"), (6, "u", "é\r\n\r\n0\r\n\r\n" * 9000, "x"), (7, "u", "a" * 32768, "x")]
SCHEMA = "page_id long, url string, html string, k string"


@pytest.mark.parametrize("least", [0, 2])
@pytest.mark.parametrize("n", [0, len(PAGES)])
def test_warc_round_trip(spark, least, n):
    pages, top = PAGES[:n], {}
    for i, _, h, _ in pages:
        top[h or ""] = i
    got = sorted(map(tuple, warc.round_trip(spark.createDataFrame(pages, SCHEMA), least=least).collect()))
    want = []
    for i, _, h, _ in pages:
        p = (h or "").encode()
        first = top[h or ""] == i or len(p) < least
        want.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if first else "revisit", None if first else top[h or ""]))
    assert got == want


def test_warc_archives_are_gzip_and_missing_segments_are_noticed(spark):
    path = work_dir(spark)
    warc.write(spark.createDataFrame(PAGES, SCHEMA).coalesce(1), path)
    parsed = warc.read_records(spark, path)
    assert parsed.where("record_type = 'continuation'").count() > 2
    origin = parsed.where("page_id = '6'").first().record_id
    lost = parsed.where(f"not (segment = 2 and origin = '{origin}')")
    assert [r.page_id for r in warc.reassemble(lost).where("not complete").collect()] == ["6"]
    altered = parsed.selectExpr(*[c if c != "digest" else "if(page_id = '7', 'X', digest) as digest" for c in parsed.columns])
    assert [r.page_id for r in warc.reassemble(altered).where("not complete").collect()] == ["7"]
    for broken in (lost, altered):
        with pytest.raises(Exception, match="incomplete or damaged"):
            warc.reassemble(broken, strict=True).collect()
    data = b"".join(warc.records("0-0", 1, "http://a/", b"pay", warc.digest(b"pay"), None))
    assert gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: response")
    with pytest.raises(ValueError):
        list(warc.parse(data[:-9]))


def test_warc_keeps_rows_with_repeated_and_null_ids_apart(spark):
    """Payloads of several segments under one id, or under none."""
    rows = [(1, "u", "a" * 100_000, "x"), (1, "u", "a" * 100_000, "x"), (1, "u", "b" * 90_000, "x"), (None, "u", "c" * 80_000, "x"), (None, "u", "d" * 70_000, "x"), (None, "u", "a" * 100_000, "x"), (None, None, "s", "x"), (None, None, "s", "x")]
    got = [tuple(r) for r in warc.round_trip(spark.createDataFrame(rows, SCHEMA)).collect()]
    want = []
    for i, _, h, _ in rows:
        sha = base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
        first = i is not None or h[0] != "a"
        want.append((i, len(h), sha, "response" if first else "revisit", None if first else 1))
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("n", [0, 1, 8191, 8192, 20000])
def test_chunked_framing(n):
    p = bytes(random.Random(n).randrange(256) for _ in range(n))
    assert warc.from_chunks(warc.to_chunks(p)) == p
    with pytest.raises(ValueError):
        warc.from_chunks(warc.to_chunks(p)[:-5])


@pytest.mark.parametrize("page,want", [
    (None, ""), ("", ""), ("a < b & c", "a < b & c"), ("<p>a<p>b", "a\n\nb"), ("x<scri", "x"), ('<p title="a>b">q</p>', "q"),
    ("<div><!-- x --><p>un<i>clo</i>sed", "unclosed"), ("<p>a&nbsp;&amp;\n b<br>c", "a & b c"),
    ('<nav>n</nav><article><header><h1>T</h1></header><p>x<div class="ad">AD</div><ul><li>1<li>2</ul><aside>s</aside><div id="comments">c</div></article><p>out<footer>f</footer>', "T\n\nx\n\n1\n\n2"),
    ('<script>var t="</p>";</script><form><p>f</form><p>y', "y"),
])
def test_html(page, want):
    assert html_text.text_of(page) == want


def test_site_tree_removes_what_a_host_repeats(spark):
    page = '<body><div class="x1"><span>Same words</span></div><div class="body"><p>text %d</p><p>shared</p></div></body>'
    rows = [(i, f"http://h.com/{i}", page % i, "k") for i in range(20)] + [(50, "http://h.com/0", page % 0, "k"), (99, "http://k.com/", page % 1, "k"), (100, None, None, "k")]
    got = {r.page_id: r for r in html_text.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[3].text == "text 3\n\nshared" and got[3].n_chars == 14
    assert got[99].text == "Same words\n\ntext 1\n\nshared" and (got[100].text, got[100].url) == ("", None)
    assert html_text.extract(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("n", [1, 300])
def test_pages_take_time_in_proportion_to_their_length(n):
    """Deep, unclosed and cut pages; a quadratic parser would not end here."""
    for part in ("<div>", '<div class="a">x', '<a title="x>t', '<div class="ad">x', "<i>", "</b>", "<article>x", "<a ", "<!-- ", "<title>x", "<"):
        whole = html_text.Page(part * n * 100)
        whole.contents(), whole.text()


def test_words_in_names_are_no_names():
    page = '<article>a<p class="ad-hoc">b</p><div class="social-science">c</div><div id="related-work">d</div><div class="ad-slot-2">X</div><div class="cookieBanner">Y</div></article>'
    assert html_text.text_of(page) == "a\n\nb\n\nc\n\nd"


def test_importance_equals_a_plain_count(spark):
    """The tree of hosts whose templates have no known names, against sums over pages."""
    import math
    import re

    r = random.Random(5)
    rows = []
    for i in range(60):
        host = f"h{i % 3}.com"
        deal = "".join(f'<div class="{x}">{r.choice(["same", "text", str(i)])}<div class="in">{r.choice(["u", "v", str(i)])}</div></div>' for x in r.sample("pqrs", 3))
        rows.append((i, f"http://{host}/{i}", f"<body>{deal}</body>", "k"))
    rows.append((99, "http://h0.com/copy", rows[0][2], "k"))
    got = sorted((t.host, t.m, round(t.importance, 9)) for t in html_text.style_tree(spark.createDataFrame(rows, SCHEMA)).collect())
    pages: dict = {}
    for host, page in {(u.split("/")[2], h) for _, u, h, _ in rows}:
        for name, text, below in re.findall(r'<div class="(.)">(.*?)<div class="in">(.*?)</div>', page):
            pages.setdefault((host, name), []).append({text, ("in", below)})
            pages.setdefault((host, name, "in"), []).append({below})
    want = []
    for (host, *_), seen in pages.items():
        m, features = len(seen), set().union(*seen)
        f = [sum(x in own for own in seen) for x in features]
        want.append((host, m, round(1 - sum(map(math.log, f)) / len(f) / math.log(m), 9) if m > 1 else 1.0))
    assert got == sorted(want)
    assert len({x[2] for x in got}) > 5


@pytest.mark.parametrize("page,want", [
    ('<body><div class="page has-sidebar"><article><p>long text</p></article><div class="sidebar">s</div></div>', "long text"),
    ('<div class="widget-container"><div class="menu">m</div><main><p>long text</p></main></div>', "long text"),
    ('<form id="aspnet"><div class="social notice"><p>most of the text</p></div><div class="menu">m</div></form>', "most of the text"),
    ('<article><p>long text</p></article><div class="related"><article><p>teaser</p></article></div>', "long text"),
    ('<article><p>long text</p></article><div id="comments"><article class="comment"><p>a comment that is longer</p></article></div>', "long text"),
])
def test_names_never_drop_the_main_text(page, want):
    assert html_text.text_of(page) == want


def test_site_tree_reads_all_branches(spark):
    """Outside the article: what differs is read, what repeats, has a name or was never
    seen often isn't; inside, what repeats leaves."""
    page = '<body><div class="top">Same</div><div class="lead"><p>lead %d</p></div><article><p>text %d</p><div class="box">Buy</div></article><div class="ad">ad %d</div><p>out %d</p></body>'
    rows = [(i, f"http://h.com/{i}", page.replace("%d", str(i)), "k") for i in range(20)] + [(99, "http://k.com/", page.replace("%d", "1"), "k")]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[3] == "lead 3\n\ntext 3" and got[99] == "text 1\n\nBuy"
