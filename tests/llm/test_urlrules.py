from tandem.llm import urlrules


def judge(spark, pages, redirects=()):
    df = spark.createDataFrame(pages, "page_id long, url string, html string, rule string")
    red = spark.createDataFrame(list(redirects), "from_url string, to_url string") if redirects else None
    return {r.page_id: r for r in urlrules.judge(df, urlrules.rule_table(spark, urlrules.RULES), red).collect()}


def test_rules_hosts_and_paths(spark):
    pages = [
        (1, "https://WWW.Example.com/en/1?x", None, ""), (2, "http://example.com/en/77", None, ""), (3, "http://a.example.net/de/8", None, ""), (4, "http://b.net/de/8", None, ""), (5, "http://notcom/en/1", None, ""),
        (6, None, None, ""), (7, "no scheme com/en/", None, ""), (8, "x://org/es/#t", None, ""), (9, "http://h.com/EN/", None, ""), (10, "http://x.com?u=http://y.org/es/", None, ""), (10, "http://x.com?u=http://y.org/es/", None, ""),
    ]
    got = judge(spark, pages)
    assert {i: (r.host, r.path, r.rule, r.verdict) for i, r in got.items()} == {
        1: ("www.example.com", "/en/1", "com/en/", "block"), 2: ("example.com", "/en/77", "example.com/en/7", "allow"), 3: ("a.example.net", "/de/8", "example.net/de/8", "block"), 4: ("b.net", "/de/8", "net/de/", "allow"),
        5: ("notcom", "/en/1", None, "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("org", "/es/", "org/es/", "block"), 9: ("h.com", "/EN/", None, "allow"), 10: ("x.com", "", None, "allow"),
    }


def test_blocks_reach_aliases_and_allow_goes_first(spark):
    canonical = '<html><head><link href="http://z.org/es/1" rel="canonical"></head></html>'
    pages = [
        (1, "http://alias.io/1", canonical, ""), (2, "http://m.alias.io/1/", None, ""), (3, "http://far.io/", '<head><meta http-equiv="refresh" content="0; url=/go"></head>', ""), (4, "http://other.io/", None, ""),
        (5, "http://both.io/", None, ""), (6, "http://c.com/en/1", None, ""),
    ]
    red = [("http://far.io/go", "http://d.com/en/2"), ("http://both.io/", "http://c.com/en/1"), ("http://both.io/", "http://example.com/en/7"), ("http://loop.io", "http://loop.io"), (None, "http://x.io")]
    got = judge(spark, pages, red)
    assert {i: (r.verdict, r.rule) for i, r in got.items()} == {1: ("block", None), 2: ("block", None), 3: ("block", None), 4: ("allow", None), 5: ("allow", None), 6: ("block", "com/en/")}
    assert "rule_0" in got[1].asDict() and judge(spark, []) == {}


def test_links_relative_to_site_folder_and_page(spark):
    at = "http://far.io/a/b/page?x=1"
    want = {
        "page2": "http://far.io/a/b/page2", "../x": "http://far.io/a/x", "../../../x/./y?z": "http://far.io/x/y?z", "?id=3": "http://far.io/a/b/page?id=3", "/go": "http://far.io/go", "//c.org/d": "http://c.org/d",
        "http://e.org/f": "http://e.org/f", "mailto:a@b.c": None, "#top": None, "": None, "./k?u=http://q": "http://far.io/a/b/k?u=http://q",
    }
    links = spark.createDataFrame([(k,) for k in want], "link string")
    from pyspark.sql import functions as F

    got = {r.link: r.to for r in links.select("link", urlrules.absolute(F.col("link"), F.lit(at)).alias("to")).collect()}
    assert got == want
    assert links.select(urlrules.absolute(F.lit("x"), F.lit("http://h.io")).alias("to")).first().to == "http://h.io/x"


def test_blocks_reach_aliases_of_pages_without_a_closed_head(spark):
    pages = [
        (1, "http://p.io/a/b", '<link rel=canonical href="../t?a=1&amp;b=2"><p>no head here', ""), (2, "http://q.io/", '<body><link rel="canonical" href="http://z.org/es/1">', ""),
        (3, "http://r.io/", '<meta http-equiv=refresh content="0;url=http://z.org/es/9"></HEAD><link rel=canonical href="http://fine.io/">', ""),
    ]
    red = [("http://p.io/t?a=1&b=2", "http://z.org/es/2")]
    assert {i: r.verdict for i, r in judge(spark, pages, red).items()} == {1: "block", 2: "allow", 3: "block"}


def test_very_long_urls_and_pages(spark):
    n = 50_000
    urls = ["http://h.io" + "/" * n, "http://h.io/" + "/" * n + "x", "http://" + "a." * n + "org/es/1", "http://h.io/" + ".html" * n, "http://h.io/?" + "a=1&" * n, "x" * 1_000_000, "http://h.io/" + "a/" * 500_000, "http://h.io/?" + "y" * 1_000_000]
    pages = ["<link " * n, "<meta http-equiv=refresh " * n, "<a " * 300_000, '<head><link rel=canonical href="' + "b/" * n + '">', "<link rel" + " " * n, None, '<link rel=canonical href="../' + "c/" * n + '">', "x" * 1_000_000]
    got = judge(spark, [(i, u, h, "") for i, (u, h) in enumerate(zip(urls, pages))])
    assert [got[i].verdict for i in range(len(urls))] == ["allow", "allow", "block", "allow", "allow", "allow", "allow", "allow"]
    assert got[2].rule == "org/es/" and got[5].host == ""


def test_query_and_sql_where_aliases_decide(spark, tmp_path):
    from .helper import same_as_sql

    hosts, pages = ["a.io", "www.a.io", "m.a.io", "b.com", "c.org", "example.com", "example.net"], []
    for i in range(300):
        url = f"{'http' if i % 3 else 'https'}://{hosts[i % 7]}/{('en', 'de', 'es', 'x')[i % 4]}/{i % 11}{('', '/', '.html', '?utm_a=1', '?b=2&a=1')[i % 5]}"
        to = f"http://{hosts[(i * 5 + 3) % 7]}/{('en', 'de', 'es', 'x')[i % 3]}/{i % 13}"
        link = (f'<link rel="canonical" href="{to}">', f'<meta http-equiv="refresh" content="0; url={i % 9}">', f"<LINK href='../es/{i % 5}?a=1&amp;b=2' rel=canonical>", "", f'<a href="{to}">')[i % 5]
        pages.append((i, url if i % 50 else None, (f"<head>{link}</head><body>", f"{link}<body>", link, None)[i % 4]))
    n = same_as_sql(spark, tmp_path, {"pages": (pages, "page_id long, url string, html string")}, urlrules.op6_redirect_rules, urlrules.SQL)
    assert n == 300
    got = spark.read.parquet(f"{tmp_path}/pages.parquet")
    by_alias = [r for r in urlrules.judge(got, urlrules.rule_table(spark, urlrules.RULES)).collect() if r.rule is None and r.verdict == "block"]
    assert len(by_alias) > 10


def test_steps_upward_against_a_stack(spark):
    import random

    from pyspark.sql import functions as F

    def walked(parts):
        out = []
        for p in parts:
            if p == "..":
                del out[-1:]
            else:
                out.append(p)
        return out

    rng = random.Random(2)
    rows = [(i, [rng.choice(["..", "a", "", "b"]) for _ in range(rng.randint(0, 40))]) for i in range(300)]
    got = spark.createDataFrame(rows, "i int, parts array<string>").withColumn("w", urlrules.walked_up(F.col("parts"))).collect()
    assert all(r.w == walked(r.parts) for r in got)


def test_links_of_any_length_reach_their_target(spark):
    far = "c/" * 500_000
    pages = [
        (1, "http://p.io/a/b", f'<link rel=canonical href="../es/{"x" * 9000}">', ""), (2, "http://q.io/a/b", f'<link rel=canonical href="{far}{"../" * 500_000}../es/1">', ""),
        (3, "http://r.io/a/" + far + "z", f'<link rel=canonical href="{"../" * 500_001}../t">', ""),
    ]
    red = [(f"http://p.io/es/{'x' * 9000}", "http://z.org/es/1"), ("http://q.io/es/1", "http://z.org/es/2"), ("http://r.io/t", "http://z.org/es/3")]
    assert {i: r.verdict for i, r in judge(spark, pages, red).items()} == {1: "block", 2: "block", 3: "block"}
