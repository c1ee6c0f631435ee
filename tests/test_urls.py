import pytest
from pyspark.sql import functions as F

from pagemill.functions.text import clean_text, trim_text
from pagemill.functions.urls import is_valid_url, resolve_url, url_hostname, url_parts, url_path
from pagemill.operators import links as L
from tests.conftest import plan_of

BASE = "https://ex.test/a/b?x=1#top"
RESOLVED = {
    "": BASE, "#": BASE, "#s": "https://ex.test/a/b?x=1#s", "?y=2": "https://ex.test/a/b?y=2", "?": "https://ex.test/a/b?",
    "c": "https://ex.test/a/c", "./c": "https://ex.test/a/c", "../c": "https://ex.test/c", "../../c": "https://ex.test/c",
    "/c": "https://ex.test/c", ".": "https://ex.test/a/", "..": "https://ex.test/", "//h.test/x": "https://h.test/x",
    "///x": "https://ex.test///x", "HTTP://EX.test/q": "http://EX.test/q", "/für": "https://ex.test/f%C3%BCr",
    "/the,": "https://ex.test/the,", "/%zz": None, "mailto:a@b.c": "mailto:a@b.c", "tel:+1 2": "tel:+1 2",
    "/a/./b/../c/.": "https://ex.test/a/c/", "/a//../b": "https://ex.test/a/b", "/a b?q r#f g": "https://ex.test/a%20b?q r#f%20g",
    "/%c3%bc": "https://ex.test/%c3%bc", "/%c3%bc ü": "https://ex.test/%C3%BC%20%C3%BC", "%41/ü": "https://ex.test/a/A/%C3%BC",
    "/%ff ü": "https://ex.test/%FF%20%C3%BC", "1a:b": None, ":x": None, "a b:c": None, "./a:b": "https://ex.test/a/a:b",
    "http://h:80a/": None, "http://h:80/x/../y": "http://h:80/y", "http://h": "http://h", "http://u:p@h/x": "http://u:p@h/x",
    "http://a b/": None, "/x#a#b": "https://ex.test/x#a%23b", "http://[::1]:8080/a": "http://[::1]:8080/a",
    "file:///x/y": "file:///x/y", "/a\tb": None, "/a!b(c)": "https://ex.test/a!b(c)", "/a!b ü": "https://ex.test/a%21b%20%C3%BC",
}


def test_resolution_table(spark):
    df = spark.createDataFrame([(BASE, r) for r in RESOLVED], "b string, r string")
    got = {x["r"]: x["o"] for x in df.select("r", resolve_url(F.col("b"), F.col("r")).alias("o")).collect()}
    assert got == RESOLVED


def test_resolution_is_idempotent(spark):
    df = spark.createDataFrame([(BASE, r) for r in RESOLVED], "b string, r string")
    once = df.select("b", resolve_url(F.col("b"), F.col("r")).alias("o")).filter("o is not null")
    assert once.filter(resolve_url(F.col("b"), F.col("o")) != F.col("o")).count() == 0


def test_parts(spark):
    urls = ["https://U@Ex.test:8080/p%20q?a=b#c", "mailto:x@y", "http://h", "http://[::1]:80/", "http://h:9z/"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    rows = df.select(url_parts(F.col("u")).alias("p"), url_hostname(F.col("u")).alias("h"), url_path(F.col("u")).alias("d")).collect()
    assert tuple(rows[0]["p"]) == ("https", "Ex.test:8080", "Ex.test", "/p%20q", "a=b", "c")
    assert (rows[0]["h"], rows[0]["d"]) == ("Ex.test", "/p q")
    assert rows[1]["h"] == "" and rows[2]["d"] == "" and rows[3]["h"] == "::1" and rows[4]["p"] is None
    assert df.filter(is_valid_url(F.col("u"))).count() == 4


def test_text(spark):
    v = "　 a\x0b\x0bb \n c\nd "
    df = spark.createDataFrame([(v,)], "s string").select(clean_text(F.col("s")).alias("c"), trim_text(F.col("s")).alias("t"))
    assert tuple(df.first()) == ("a\x0b\x0bb c\nd", "a\x0b\x0bb \n c\nd")


def hosts(spark, *names):
    return spark.createDataFrame([("https://s.test/", f"https://{n}/x") for n in names], "src_url string, url string")


@pytest.mark.parametrize("table", [False, True])
def test_excluded_domains(spark, table):
    df = hosts(spark, "another-example.com", "example.com.evil.test", "example.com:81", "b.test", "EXAMPLE.com")
    listed = ["example.com", "zz.b.test"]
    domains = spark.createDataFrame([(d,) for d in listed], "domain string") if table else listed
    kept = {r["url"] for r in L.not_excluded_domain(df, domains).collect()}
    assert kept == {"https://example.com.evil.test/x", "https://b.test/x", "https://EXAMPLE.com/x"}
    every = spark.createDataFrame([("",)], "domain string") if table else [""]
    assert L.not_excluded_domain(df, every).count() == 0


def test_excluded_domain_table_without_broadcast_and_with_a_hot_host(spark):
    names = ["hot.example.com"] * 50 + [f"h{n}.test" for n in range(50)] + ["hot.kept.test"] * 50
    df = hosts(spark, *names).withColumn("ord", F.monotonically_increasing_id())
    domains = spark.createDataFrame([("example.com",), ("h7.test",)], "domain string")
    kept = L.not_excluded_domain(df, domains, max_bytes=0, rows_per_key=4)
    assert kept.count() == 99


def test_ad_patterns(spark):
    df = hosts(spark, "x.test").withColumn("url", F.lit("https://x.test/adexampleXcom"))
    assert L.not_ad_link(df, ["adexample.com"]).count() == 0
    assert L.not_ad_link(df, [r"(?P<n>zz)", "[[:digit:]]"]).count() == 1
    assert L.not_ad_link(df, [r"[[:upper:]]com$"]).count() == 0
    with pytest.raises(ValueError):
        L.not_ad_link(df, ["("])
    assert L.not_ad_link(df, ["("], on_bad_pattern="ignore").count() == 1


def test_links_resolve_once_and_need_no_shuffle(spark):
    pages = spark.createDataFrame([("https://ex.test/", "<a href=/x>")], "url string, html string")
    links = L.crawlable_links(L.page_links(pages), ["bad.test"], ["ads"])
    plan = plan_of(links)
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan
    assert [r["url"] for r in links.collect()] == ["https://ex.test/x"]
