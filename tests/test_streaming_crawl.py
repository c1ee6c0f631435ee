import random

import pytest
from pyspark.sql import functions as F

from pagemill.operators.robots import robots_rules
from pagemill.plans.crawl import crawl_documents
from pagemill.schema import PAGE_SCHEMA
from pagemill.sources.pages import seed_frontier
from pagemill.streaming import pages as S
from pagemill.streaming.crawl import stream_crawl
from tests.test_streaming import feed, site

AT = "http://w.test/"


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Every partition with state starts a Python worker in every batch."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def web(spark, seed, n=60):
    """Random pages of one host; some are missing, failed or disallowed."""
    draw = random.Random(seed)
    rows = []
    for k in range(n):
        links = "".join(f"<a href=/{draw.choice(('p', 'p', 'x'))}{draw.randrange(n)}>l</a>" for _ in range(draw.randrange(1, 7)))
        if k % 9:
            rows.append((f"{AT}p{k}", 404 if k % 11 == 5 else 200, f"<title>t{k}</title><article>text {k % 20}</article>{links}"))
    pages = spark.createDataFrame(rows, "url string, status int, html string")
    return pages.withColumn("fetched_at", F.timestamp_seconds(F.lit(1700000000)))


def text(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("seed", [1])
def test_streamed_crawl_equals_batch_crawl(spark, tmp_path, seed):
    src, root = str(tmp_path / "in"), str(tmp_path / "crawl")
    pages = web(spark, seed).cache()
    files = spark.createDataFrame([("w.test", "User-agent: *\nDisallow: /p3")], "host string, body string")
    args = dict(content_tags=["article"], ad_patterns=["/x1"], limits={"title": 2})
    seeds = [AT + f"p{k}" for k in (1, 2, 40)]
    parts = [F.pmod(F.xxhash64("url"), F.lit(3)) == k for k in range(3)]
    for k, part in enumerate(parts):
        feed(pages.filter(part).coalesce(1), src)
        if k == 0:  # two batches at once, seeds that come later
            continue
        now = seed_frontier(seeds[: k + 1], spark)
        got = stream_crawl(S.stream_pages(spark, src, max_files_per_trigger=1), now, root, 3, robots=robots_rules(files, "bot"), **args)
        seen = spark.read.schema(PAGE_SCHEMA).parquet(src)
        want = crawl_documents(seen, now, 3, robots=files, agent="bot", **args)
        assert text(got.reached.select("url", "depth")) == text(want.reached.select("url", "depth"))
        assert text(got.documents) == text(want.documents.select(*got.documents.columns))
        assert text(got.missing.select("url", "depth")) == text(want.missing.select("url", "depth"))
    assert got.documents.filter("depth > 1").count() > 3


def test_smaller_depth_comes_later(spark, tmp_path):
    """A page first reached over a detour; the short way arrives later and lets its links in."""
    src, root = str(tmp_path / "in"), str(tmp_path / "crawl")
    link = lambda *to: "".join(f"<a href=/{t}>l</a>" for t in to)
    page = lambda name, *to: (f"{AT}{name}", 200, link(*to))
    seeds = seed_frontier([AT + "a", AT + "s"], spark)
    schema = "url string, status int, html string"
    stamped = lambda rows: spark.createDataFrame(rows, schema).withColumn("fetched_at", F.timestamp_seconds(F.lit(1700000000)))
    feed(stamped([page("a", "b"), page("b", "c"), page("c", "d"), page("d")]), src)
    depths = lambda r: {x["url"][len(AT) :]: x["depth"] for x in r.reached.collect()}
    assert depths(stream_crawl(S.stream_pages(spark, src), seeds, root, 2)) == {"a": 0, "s": 0, "b": 1, "c": 2}
    feed(stamped([page("s", "c")]), src)
    assert depths(stream_crawl(S.stream_pages(spark, src), seeds, root, 2)) == {"a": 0, "s": 0, "b": 1, "c": 1, "d": 2}
    assert depths(stream_crawl(S.stream_pages(spark, src), seeds, root, 2)) == {"a": 0, "s": 0, "b": 1, "c": 1, "d": 2}


def test_crawl_of_nothing(spark, tmp_path):
    src = str(tmp_path / "in")
    feed(site(spark).limit(0), src)
    got = stream_crawl(S.stream_pages(spark, src), seed_frontier(["http://s.test/"], spark), str(tmp_path / "c"), 2)
    assert got.documents.count() == 0 and got.missing.count() == got.reached.count() == 1


def test_late_rows_are_kept(spark, tmp_path):
    src, root = str(tmp_path / "in"), str(tmp_path / "late")
    at = lambda rows: spark.createDataFrame(rows, "url string, s long").select("url", F.timestamp_seconds("s").alias("fetched_at"))
    stream = lambda: S.stream_pages(spark, src, at([("x", 1)]).schema, max_files_per_trigger=1)
    batches = [
        [("a", 1000), ("b", 1100), ("a", 1001)],
        [("c", 1090), ("old", 900), ("a", 950), ("old", 890), (None, 1)],  # behind 1100 - 60: old is new, a is a repeat
        [("d", 1500), ("old", 899), ("b", 1499)],
        [("e", 1400), ("untimed", None), ("old", 1600), ("c", 1000)],
    ]
    want = [
        ({"a", "b"}, {}),
        ({"a", "b", "c"}, {"old": 890, None: 1}),
        ({"a", "b", "c", "d"}, {"old": 890, None: 1}),
        ({"a", "b", "c", "d", "old"}, {"e": 1400, "untimed": None, None: 1}),
    ]
    for rows, (passed_urls, late_urls) in zip(batches, want, strict=True):
        at(rows).coalesce(1).write.mode("append").parquet(src)
        for _ in range(2):
            passed, late = S.stream_late_urls(stream(), root, "60 seconds")
            assert {r["url"] for r in passed.collect()} == passed_urls
            assert {r["url"]: r["fetched_at"] and int(r["fetched_at"].timestamp()) for r in late.collect()} == late_urls
