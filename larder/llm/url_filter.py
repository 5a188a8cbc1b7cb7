"""URL rules, and their decisions carried over to aliases by redirects and canonical links. DataFrame functions only.

A page's node is its host, path and query, as sites may part their pages by the query alone; rules look at its host and path.
Edges are the canonical links and refresh redirects
of the pages' html, and a table of redirects where there is one. Pages without a rule of their own take the decision of
their component: allow if a page in it is allowed by a rule, else block if one is blocked, else allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .components import components

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The rules of the contract, as (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
_CANONICAL = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
_REFRESH = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ://."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def query_of(url: Column) -> Column:
    """The query with its question mark, without the fragment; empty where there is none."""
    return F.coalesce(F.regexp_extract(url, r"://[^?#]*(\?[^#]+)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits (null if none) and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _without_dots(path: Column) -> Column:
    """path, which begins with a slash, without its segments . and .., of which the latter takes the segment before it along."""
    parts = F.split(path, "/")
    kept = F.aggregate(
        F.slice(parts, 2, F.size(parts)), F.array().cast("array<string>"), lambda a, x: F.when(x == ".", a).when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, x))
    )
    ends = F.element_at(parts, -1).isin(".", "..")
    return F.concat(F.lit("/"), F.array_join(F.when(ends, F.array_append(kept, F.lit(""))).otherwise(kept), "/"))


def _absolute(link: Column, host: Column, path: Column, query: Column) -> Column:
    """The url that a link on a page leads to; null where it leads to no page of a host, as mailto: or a script."""
    link = F.regexp_replace(link, "&amp;", "&")
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_extract(path, r"^(.*/)", 1))
    at = lambda *parts: F.concat(F.lit("x://"), host, *parts)
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(F.lit("x:"), link))
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(link.startswith("/"), at(link))
        .when(link.startswith("?"), at(path, link))
        .when(link.startswith("#"), at(path, query))
        .otherwise(at(folder, link))
    )


def _node(host: Column, path: Column, query: Column) -> Column:
    """Host, path without dot segments, and query."""
    return F.concat(host, F.when(path == "", F.lit("/")).otherwise(_without_dots(path)), query)


def _fixed(df: DataFrame, **columns: Column) -> DataFrame:
    """df with further columns, each worked out once: the optimiser copies no expression past a generator."""
    return df.select("*", F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("_")).select(*df.columns, "_.*")


def links_of(html: Column) -> Column:
    """The targets of all canonical links and refresh redirects in html, as they stand there."""
    return F.concat(
        F.transform(F.regexp_extract_all(html, F.lit(_CANONICAL), F.lit(0)), lambda t: F.regexp_extract(t, r"""(?is)\bhref\s*=\s*["']?\s*([^"'\s>]+)""", 1)),
        F.transform(F.regexp_extract_all(html, F.lit(_REFRESH), F.lit(0)), lambda t: F.regexp_extract(t, r"""(?is)\burl\s*=\s*["']?\s*([^"'\s>;]+)""", 1)),
    )


def link_edges(pages: DataFrame) -> DataFrame:
    """(a, b): nodes that a link joins, for rows (host, path, query, links)."""
    links = pages.filter("host <> ''").select("host", "path", "query", F.explode("links").alias("link")).filter("link <> ''")
    links = _fixed(links, full=_absolute(F.col("link"), F.col("host"), F.col("path"), F.col("query")))
    to_host, to_path = split_url(F.col("full"))
    links = _fixed(links, to_host=to_host, to_path=to_path, to_query=query_of(F.col("full")))
    return links.filter("to_host <> ''").select(_node(F.col("host"), F.col("path"), F.col("query")).alias("a"), _node(F.col("to_host"), F.col("to_path"), F.col("to_query")).alias("b")).filter("a <> b")


def judge_urls(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row of pages: its id, host, path, the longest rule that fits (null if none) and the verdict.

    redirects: further edges as rows (source, target) of urls. Null urls and those without :// have no host or path, fit no
    rule, have no aliases and are allowed. Pages that link nowhere keep their own rule's verdict or are allowed. Links are
    resolved against their page, dot segments included; those that lead to no host (mailto: and the like) are none. Rows that
    are repeated are judged each; an empty table gives an empty result; columns other than those named are not read.
    A rule's own verdict always stands; among aliases, allow goes before block.
    """
    host, path = split_url(F.col(url_col).cast("string"))
    links = F.coalesce(links_of(F.col(html_col).cast("string")), F.array().cast("array<string>"))
    # one scan of the html; what follows reads hosts, paths and links
    read = materialize(pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), query_of(F.col(url_col).cast("string")).alias("query"), links.alias("links")))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = read.select("page_id", "host", "path", "query", rule.alias("rule"), verdict.alias("own"))
    edges = link_edges(read)
    if redirects is not None:
        (sh, sp), (th, tp) = split_url(F.col("source")), split_url(F.col("target"))
        more = _fixed(redirects.select("source", "target"), sh=sh, sp=sp, sq=query_of(F.col("source")), th=th, tp=tp, tq=query_of(F.col("target"))).filter("sh <> '' and th <> ''")
        edges = edges.unionByName(more.select(_node(F.col("sh"), F.col("sp"), F.col("sq")).alias("a"), _node(F.col("th"), F.col("tp"), F.col("tq")).alias("b")).filter("a <> b"))
    edges = materialize(edges)
    if edges.isEmpty():
        return own.select("page_id", "host", "path", "rule", F.coalesce("own", F.lit("allow")).alias("verdict"))
    member = components(edges)
    # a node is judged by its own host and path, whether or not a page of the table has it
    node_host, node_path = F.regexp_extract("node", r"^[^/]*", 0), F.regexp_extract("node", r"^[^/]*([^?]*)", 1)
    _, of_node = rule_of(node_host, node_path, rules)
    judged = member.withColumn("v", of_node)
    shared = judged.groupBy("component").agg(F.max(F.col("v") == "allow").alias("allowed"), F.max(F.col("v") == "block").alias("blocked"))
    by_node = materialize(member.join(shared, "component").filter("blocked and not coalesce(allowed, false)").select("node"))
    blocked = own.withColumn("node", _node(F.col("host"), F.col("path"), F.col("query"))).join(by_node.withColumn("alias_blocked", F.lit(True)), "node", "left")
    return blocked.select("page_id", "host", "path", "rule", F.coalesce("own", F.when(F.col("alias_blocked"), "block"), F.lit("allow")).alias("verdict"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


_SPLIT = r"""
select *, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path
from (select *, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end rest from {})"""
_RULE = """case when (host = 'www.example.com' or host like '%.www.example.com') and starts_with(path, '/en/') then 'www.example.com/en/'
  when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/en/') then 'example.com/en/'
  when (host = 'net' or host like '%.net') and starts_with(path, '/es/') then 'net/es/'
  when (host = 'net' or host like '%.net') and starts_with(path, '/fr/') then 'net/fr/'
  when (host = 'com' or host like '%.com') and starts_with(path, '/') then 'com/' end"""
_VERDICT = "case when rule in ('com/', 'www.example.com/en/') then 'allow' when rule is not null then 'block' end"

_DOTS = """segs{k} as (select *, string_split(p, '/') s from {source}),
fold{k} as (select id, 2 i, cast([] as varchar[]) acc, s from (select distinct id, s from segs{k}) union all
  select id, i + 1, case when s[i] = '.' then acc when s[i] = '..' then acc[1:greatest(len(acc) - 1, 0)] else list_append(acc, s[i]) end, s from fold{k} where i <= len(s)),
flat{k} as (select id, '/' || array_to_string(case when s[-1] in ('.', '..') then list_append(acc, '') else acc end, '/') plain from fold{k} where i = len(s) + 1)"""
_PLACED = "case when path = '' then '/' else path end p, coalesce(regexp_extract(url, '://[^?#]*(\\?[^#]+)', 1), '') query"

ORACLE_SQL = {
    "op8_url_filter": rf"""
with recursive s0 as ({_SPLIT.format("pages")}),
p0 as (select row_number() over () id, page_id, html, host, path, {_PLACED} from s0), {_DOTS.format(k=1, source="p0")},
q as (select page_id, html, host, path, query, {_RULE} rule, host || plain || query node from p0 join flat1 using (id)),
own as (select *, {_VERDICT} own from q),
links as (
  select host h, path pt, query qu, node a, regexp_extract(tag, '(?i)\bhref\s*=\s*["'']?\s*([^"''\s>]+)', 1) link
  from (select *, unnest(regexp_extract_all(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>')) tag from own)
  union all
  select host h, path pt, query qu, node a, regexp_extract(tag, '(?i)\burl\s*=\s*["'']?\s*([^"''\s>;]+)', 1) link
  from (select *, unnest(regexp_extract_all(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>')) tag from own)),
full_links as (
  select a, case when regexp_matches(l, '^[A-Za-z][A-Za-z0-9+.-]*://') then l when starts_with(l, '//') then 'x:' || l when regexp_matches(l, '^[A-Za-z][A-Za-z0-9+.-]*:') then null when starts_with(l, '/') then 'x://' || h || l
                 when starts_with(l, '?') then 'x://' || h || pt || l when starts_with(l, '#') then 'x://' || h || pt || qu else 'x://' || h || case when pt = '' then '/' else regexp_extract(pt, '^(.*/)', 1) end || l end url
  from (select *, replace(link, '&amp;', '&') l from links where link <> '' and h <> '')),
s2 as ({_SPLIT.format("full_links")}), p2 as (select row_number() over () id, a, host, {_PLACED} from s2 where host <> ''), {_DOTS.format(k=2, source="p2")},
edges as (select a, host || plain || query b from p2 join flat2 using (id)),
pairs as (select a, b from edges union select b, a from edges),
reach as (select a node, a other from pairs union select r.node, e.b from reach r join pairs e on r.other = e.a),
judged as (select other, {_VERDICT} v from (select other, {_RULE} rule from (select distinct other, regexp_extract(other, '^[^/]*') host, regexp_extract(other, '^[^/]*([^?]*)', 1) path from reach))),
shared as (select node from reach join judged using (other) group by node having bool_or(v = 'block') and not coalesce(bool_or(v = 'allow'), false))
select page_id, host, path, rule, coalesce(own, case when node in (select node from shared) then 'block' end, 'allow') verdict from own"""
}
