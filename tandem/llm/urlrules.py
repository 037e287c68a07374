r"""URL rules with redirect equivalence, in DataFrame functions alone.

A rule is a verdict, a host and a beginning of a path. It fits a url whose host is the rule's or ends in a dot and it, and whose
path starts with the rule's; of those that fit, the longest host and path wins, then `allow`. Rules are looked up by the
suffixes of the host, so their number does not multiply the pages.

Urls that no rule fits take the verdict of the urls that lead to the same place. Edges between urls come from redirect
rows, from canonical links and refresh targets in the page itself, and from the url's own plain form (no scheme, `www.` or `m.`, tracking
parameters, fragment, closing slashes or .html). Links are read from what stands before `</head>` or `<body`, else from the whole page; `&amp;`
is decoded, and links relative to the site, the folder or the page are resolved against the page's url. Connected components over all edges carry a
block to every alias, unless a url in the component is explicitly allowed, which goes first; a url with a rule of its own keeps that rule's verdict.
In the graph a url is its 128-bit md5.

Urls and pages of any length are taken whole: all patterns run in linear time and none repeats a group, which Java matches by recursion. Null urls and urls without `://` have empty host and path, are in no component and are allowed unless a rule fits an empty host.
Null html has no links. Repeated pages are judged each for itself. Extra columns pass through, renamed if they clash; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, read, unclash
from .components import connected_components

#: The rules of the registered query.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
#: A table of at most so many rules is broadcast, a longer one joined by host.
MAX_RULES = 100_000
ADDED = ["host", "path", "rule", "verdict"]


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def plain(url: Column) -> Column:
    """The url's form under which its aliases meet; null if it has no host."""
    host = F.regexp_replace(host_of(url), r"^(?:www|m)\.", "")
    path = F.regexp_replace(F.rtrim(path_of(url), F.lit("/")), r"\.html?$", "")
    query = F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda p: (p != "") & ~p.rlike(r"^(?:utm_\w+|ref|fbclid|gclid)(?:=|$)"))
    form = F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(query), "&"))).otherwise(""))
    return F.when(host != "", F.replace(form, F.lit("://"), F.lit(":")))  # a form is no url, so no rule fits one that its query holds


def walked_up(parts: Column) -> Column:
    """Parts of a path without those that a `..` takes back; one at the root takes nothing.

    Every part is a run of steps up and of names; neighbours are joined round by round, half as many each time, so a path of n parts takes n log n.
    """
    run = lambda p: F.struct(F.when(p == "..", 1).otherwise(0).alias("up"), F.when(p == "..", F.array().cast("array<string>")).otherwise(F.array(p)).alias("names"))

    def joined(a: Column, b: Column) -> Column:
        left = F.size(a["names"])
        both = F.struct((a["up"] + F.greatest(b["up"] - left, F.lit(0))).alias("up"), F.concat(F.slice(a["names"], F.lit(1), F.greatest(left - b["up"], F.lit(0))), b["names"]).alias("names"))
        return F.when(b.isNull(), a).otherwise(both)

    # a string has fewer than 2 ** 31 parts; once one run is left, a round changes nothing
    halved = lambda runs, _: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(runs) - 1) / 2).cast("int"))), lambda i: joined(F.get(runs, 2 * i), F.get(runs, 2 * i + 1)))
    runs = F.concat(F.array(run(F.lit(".."))), F.transform(parts, run))  # a step up from the root, so there is one run at least
    return F.get(F.aggregate(F.sequence(F.lit(1), F.lit(31)), runs, halved), F.lit(0))["names"]


def absolute(link: Column, url: Column) -> Column:
    """A link as it stands in the page of a url; null for other schemes, for places within the page and where the url has no host."""
    base, path = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1), path_of(url)
    folder = F.when(path == "", "/").otherwise(F.regexp_extract(path, r"(?s)^(.*/)", 1))
    parts = F.filter(F.split(F.concat(folder, F.regexp_extract(link, r"(?s)^([^?#]*)", 1)), "/"), lambda p: p != ".")
    steps = F.concat(F.array(F.lit("")), walked_up(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1)))))
    walked = F.array_join(F.when(F.contains(link, F.lit("..")), steps).otherwise(parts), "/")
    near = F.concat(base, walked, F.regexp_extract(link, r"(?s)^[^?#]*(.*)$", 1))
    return (
        F.when((link == "") | link.startswith("#") | (base == ""), None)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), link)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), None)
        .when(link.startswith("//"), F.concat(F.regexp_extract(url, r"(?s)^(.*?:)//", 1), link))
        .when(link.startswith("/"), F.concat(base, link))
        .when(link.startswith("?"), F.concat(base, path, link))
        .otherwise(near)
    )


def first_link(tags: Column, names: str, value: str) -> Column:
    """What `value` finds in the first of the tags that `names` fits; empty if it finds nothing, null if there is none."""
    return F.replace(F.regexp_extract(F.get(F.filter(tags, lambda t: t.rlike(names)), F.lit(0)), value, 1), F.lit("&amp;"), F.lit("&"))


def page_edges(pages: DataFrame) -> DataFrame:
    """(a, b) from each url to its plain form, its canonical link and its refresh target."""
    known = pages.where("url is not null")
    # the columns are computed one after the other, so that no page is searched twice for one link
    tags = lambda name: F.regexp_extract_all("head", F.lit(rf"(?i)(<{name}\b[^<>]*>)"), F.lit(1))
    heads = known.where("html is not null").select("url", F.get(F.split("html", r"(?i)</head>|<body\b", 2), F.lit(0)).alias("head"))
    canonical = first_link(tags("link"), r"(?i)\brel\s*=\s*[\x22']?canonical\b", r"(?i)\bhref\s*=\s*[\x22']?([^\x22'\s>]+)")
    refresh = first_link(tags("meta"), r"(?i)http-equiv\s*=\s*[\x22']?refresh\b", r"(?i)\burl\s*=\s*[\x22']?([^\x22'\s>;]+)")
    found = heads.select("url", F.explode(F.array_compact(F.array(canonical, refresh))).alias("link")).where("link <> ''")
    linked = found.select(F.col("url").alias("a"), absolute(F.col("link"), F.col("url")).alias("b"))
    return known.select(F.col("url").alias("a"), plain(F.col("url")).alias("b")).unionAll(linked).where("b is not null and a <> b")


def judged(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (distinct, with host and path) with rule and its verdict, null where none fits."""
    rules = rules.select(F.col("host").alias("_rhost"), F.col("path").alias("_rpath"), F.col("verdict").alias("_rverdict"))
    if rules.limit(MAX_RULES + 1).count() <= MAX_RULES:
        rules = F.broadcast(rules)
    labels, most = F.split("host", r"\."), rules.agg(F.max(F.size(F.split("_rhost", r"\.")))).first()[0] or 1
    # no rule has more labels than `most`, so longer suffixes need not be looked up
    suffixes = F.transform(F.sequence(F.greatest(F.size(labels) - most + 1, F.lit(1)), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fit = urls.withColumn("_suffix", F.explode(suffixes)).join(rules, (F.col("_suffix") == F.col("_rhost")) & F.col("path").startswith(F.col("_rpath")))
    best = F.struct((F.length("_rhost") + F.length("_rpath")).alias("n"), (F.col("_rverdict") == "allow").cast("int").alias("allow"), F.concat("_rhost", "_rpath").alias("rule"))
    found = fit.groupBy("url").agg(F.max(best).alias("_best"))
    return found.select("url", F.col("_best.rule").alias("rule"), F.when(F.col("_best.allow") == 1, "allow").otherwise("block").alias("rule_verdict"))


def rule_table(spark: SparkSession, rules) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """pages with host, path, rule and verdict; redirects may hold further edges as (from_url, to_url)."""
    spark = pages.sparkSession
    pages = unclash(pages, [*ADDED, "rule_verdict", "_hash", "_url", "_node"])
    ws = Workspace(spark, "urls")
    edges = page_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(F.col("from_url").alias("a"), F.col("to_url").alias("b")))
    edges = ws.keep(edges.distinct())
    urls = pages.select("url").where("url is not null").unionAll(edges.select("a")).unionAll(edges.select("b")).distinct()
    rated = ws.keep(judged(urls.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}), rules))
    # the graph is joined by digests of the urls, which keeps its tables slim; the hints keep large sides from being broadcast by estimate
    node = lambda c: F.unhex(F.md5(F.encode(c, "UTF-8")))
    part = connected_components(edges.select(node("a").alias("a"), node("b").alias("b")), ws)
    own = rated.select(node("url").alias("node"), "rule_verdict")
    by_part = part.join(own.hint("merge"), "node").groupBy("component").agg(F.max((F.col("rule_verdict") == "allow").cast("int")).alias("_allow"), F.max((F.col("rule_verdict") == "block").cast("int")).alias("_block"))
    blocked = ws.keep(part.join(by_part.where("_block = 1 and _allow = 0").select("component").hint("merge"), "component", "left_semi").select(F.col("node").alias("_node")))
    ws.drop(edges)
    out = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url")), "_hash": node("url")})
    out = out.join(rated.withColumnRenamed("url", "_url").hint("merge"), F.col("url") == F.col("_url"), "left").join(blocked.hint("merge"), F.col("_hash") == F.col("_node"), "left")
    verdict = F.coalesce("rule_verdict", F.when(F.col("_node").isNotNull() & F.col("url").isNotNull(), "block").otherwise("allow"))
    return out.select(*pages.columns, "host", "path", "rule", verdict.alias("verdict"))


def op6_redirect_rules(spark, sf_dir):
    rules = rule_table(spark, RULES)
    return judge(read(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
with recursive u0 as (select page_id, url, html, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path, regexp_extract(html, '(?is)^(.*?)(?:</head>|<body\b|$)', 1) as head,
  regexp_extract(coalesce(url, ''), '(?s)^(.*?://[^/?#]*)', 1) as base,
  list_sort(list_filter(string_split(regexp_extract(coalesce(url, ''), '\?([^#]*)', 1), '&'), lambda p: p <> '' and not regexp_matches(p, '^(?:utm_\w+|ref|fbclid|gclid)(?:=|$)'))) as query from pages),
found as (select url, host, path, base, case when path = '' then '/' else regexp_extract(path, '(?s)^(.*/)', 1) end as folder,
  unnest([regexp_extract(list_filter(regexp_extract_all(head, '(?i)<link\b[^<>]*>'), lambda t: regexp_matches(t, '(?i)\brel\s*=\s*[\x22'']?canonical\b'))[1], '(?i)\bhref\s*=\s*[\x22'']?([^\x22''\s>]+)', 1),
    regexp_extract(list_filter(regexp_extract_all(head, '(?i)<meta\b[^<>]*>'), lambda t: regexp_matches(t, '(?i)http-equiv\s*=\s*[\x22'']?refresh\b'))[1], '(?i)\burl\s*=\s*[\x22'']?([^\x22''\s>;]+)', 1)]) as raw from u0 where url is not null),
links as (select *, replace(raw, '&amp;', '&') as link from found where raw <> ''),
near as (select *, case when not contains(link, '..') then array_to_string([p for p in string_split(folder || regexp_extract(link, '(?s)^([^?#]*)', 1), '/') if p <> '.'], '/') else array_to_string(list_reduce([[p] for p in string_split(folder || regexp_extract(link, '(?s)^([^?#]*)', 1), '/') if p <> '.'],
  lambda acc, p: case when p[1] = '..' then acc[1 : greatest(len(acc) - 1, 1)] else list_concat(acc, p) end), '/') end || regexp_extract(link, '(?s)^[^?#]*(.*)$', 1) as walked from links),
edges as (select distinct a, b from (
    select url as a, case when host <> '' then replace(regexp_replace(host, '^(?:www|m)\.', '') || regexp_replace(rtrim(path, '/'), '\.html?$', '') || case when len(query) > 0 then '?' || array_to_string(query, '&') else '' end, '://', ':') end as b from u0 where url is not null
    union all select url, case when link = '' or starts_with(link, '#') or base = '' then null when regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.\-]*://') then link when regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.\-]*:') then null
      when starts_with(link, '//') then regexp_extract(url, '(?s)^(.*?:)//', 1) || link when starts_with(link, '/') then base || link when starts_with(link, '?') then base || path || link else base || walked end from near)
  where b is not null and a <> b),
sym as (select a, b from edges union select b, a from edges),
nodes as (select url from u0 where url is not null union select a from sym),
reach as (select a, b from sym union select reach.a, sym.b from reach join sym on reach.b = sym.a),
parsed as (select url, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from nodes),
rules(verdict, host, path) as (values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
own as (select url, arg_max(r.host || r.path, len(r.host || r.path)) as rule, arg_max(r.verdict, len(r.host || r.path)) as verdict
  from parsed p join rules r on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path) group by url),
alias as (select reach.a as url, bool_or(own.verdict = 'allow') as allowed, bool_or(own.verdict = 'block') as blocked from reach join own on own.url = reach.b group by reach.a)
select page_id, u0.host, u0.path, own.rule, coalesce(own.verdict, case when alias.blocked and not alias.allowed then 'block' else 'allow' end) as verdict
from u0 left join own using (url) left join alias using (url)
"""
