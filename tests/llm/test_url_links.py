"""Aliases by links of all kinds: resolved nodes, components, and the query's SQL on a table that has links."""

from urllib.parse import urljoin, urlsplit

import duckdb
import pytest
from larder.llm import url_filter
from pyspark.sql import functions as F

CANONICAL = '<html><head><link rel="canonical" href="{}"></head><body>x</body></html>'
REFRESH = "<html><head><meta http-equiv=refresh content='0; url={}'></head></html>"


@pytest.mark.parametrize("page", ["http://a.org", "http://a.org/", "http://a.org/d/e", "http://a.org/d/e/?q=1", "http://a.org/d/../e/f"])
def test_links_resolve_as_the_standard_says(spark, page):
    links = ["x.html", "./p", "../q", "../../r", "../..", ".", "..", "/s/./t/../u", "/", "?k=v", "//b.net/c/../d", "https://c.com/../z?y#f", "a/b/../../c/", "./../x/./y?p=../q"]
    rows = spark.createDataFrame([(x,) for x in links], "link string")
    host, path = url_filter.split_url(F.lit(page))
    full = url_filter._absolute(F.col("link"), host, path, url_filter.query_of(F.lit(page)))
    rows = url_filter._fixed(rows, full=full)
    to_host, to_path = url_filter.split_url(F.col("full"))
    got = {r.link: r.node for r in rows.select("link", url_filter._node(to_host, to_path, url_filter.query_of(F.col("full"))).alias("node")).collect()}
    for link in links:
        want = urlsplit(urljoin(page, link))
        # it leaves the dots of links with a host of their own, and of the page's own path
        plain = urlsplit(urljoin(f"http://{want.netloc}/", want.path)).path
        assert got[link] == want.netloc + (plain or "/") + (f"?{want.query}" if want.query else ""), link


def test_links_that_lead_to_no_page(spark):
    rows = spark.createDataFrame([(x,) for x in ("mailto:a@b.c", "javascript:go()", "data:text/html,x", "tel:1")], "link string")
    assert {r.full for r in rows.select(url_filter._absolute(F.col("link"), F.lit("a.org"), F.lit("/p"), F.lit("")).alias("full")).collect()} == {None}


def _pages():
    rows = [
        (1, "http://a.org/fr/one", CANONICAL.format("two")), (2, "http://a.org/fr/two", REFRESH.format("../../x/./three")), (3, "http://a.org/x/three", CANONICAL.format("http://b.net/es/page")), (4, "http://a.org/x/alone", None),
        (5, "http://c.org/d/e", CANONICAL.format("./p")), (6, "http://c.org/d/p", CANONICAL.format("//d.net/fr/")), (7, "http://e.org/view?id=1", CANONICAL.format("http://f.net/fr/1")), (8, "http://e.org/view?id=2", ""), (9, "http://e.org/view?id=1#part", ""),
        (10, "http://g.org/", CANONICAL.format("http://h.net/es/9")), (11, "http://g.org", CANONICAL.format("http://www.example.com/en/ok")), (12, "http://example.com/en/no", CANONICAL.format("http://i.org/k")), (13, "http://i.org/k", ""),
        (14, "http://j.org/m", CANONICAL.format("mailto:x@n.net")), (15, None, CANONICAL.format("http://h.net/es/9")), (16, "no url", None), (17, "http://i.org/l/../k", ""), (17, "http://i.org/l/../k", ""), (None, "http://i.org/k#z", ""),
    ]
    chain = [(100 + k, f"http://chain.org/s{k}/index", CANONICAL.format(f"../s{k + 1}/index")) for k in range(40)] + [(140, "http://chain.org/s40/index", CANONICAL.format("http://z.net/fr/end"))]
    return rows + chain


def test_decisions_of_aliases_and_the_sql(spark, tmp_path):
    pages = spark.createDataFrame([(*r, "x", 1) for r in _pages()], "page_id long, url string, html string, host string, node int")
    got = sorted((tuple(r) for r in url_filter.judge_urls(pages).collect()), key=str)
    verdict = {r[0]: r[4] for r in got}
    blocked = {1, 2, 3, 5, 6, 7, 9, 12, 13, 17, None, *range(100, 141)}
    assert {k for k, v in verdict.items() if v == "block"} == blocked and len(got) == len(_pages())
    pages.select("page_id", "url", "html").write.parquet(str(tmp_path / "pages"))
    con = duckdb.connect()
    con.execute(f"create view pages as from '{tmp_path}/pages/*.parquet'")
    want = con.execute(url_filter.ORACLE_SQL["op8_url_filter"])
    names = [d[0] for d in want.description]
    assert got == sorted((tuple(dict(zip(names, r, strict=True))[c] for c in ("page_id", "host", "path", "rule", "verdict")) for r in want.fetchall()), key=str)


def test_no_pages(spark):
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
