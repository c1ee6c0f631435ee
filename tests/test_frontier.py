import random

import pytest
from pyspark.sql import functions as F

from pagemill.operators import dedup, frontier, joins, robots, validate
from pagemill.plans.crawl import crawl_documents, outcomes
from pagemill.sources.documents import write_documents
from pagemill.sources.pages import seed_frontier
from tests.conftest import plan_of

EDGES = [("a", "b"), ("a", "c"), ("b", "a"), ("b", "d"), ("c", "d"), ("d", "e")]


def edges(spark, pairs=EDGES):
    return spark.createDataFrame(pairs, "src_url string, url string")


def depths(df):
    return {r["url"]: r["depth"] for r in df.collect()}


@pytest.mark.parametrize("max_depth,want", [(2, dict(a=0, b=1, c=1, d=2)), (0, dict(a=0)), (9, dict(a=0, b=1, c=1, d=2, e=3))])
def test_crawl(spark, max_depth, want):
    seeds = seed_frontier(["a", "a"], spark)
    assert depths(frontier.crawl(seeds, edges(spark), max_depth)) == want


def test_cap_leaves_the_rest_unvisited(spark):
    seeds = seed_frontier(["a"], spark)
    assert depths(frontier.crawl(seeds, edges(spark), 1, cap=1)) == dict(a=0, b=1)
    # c was dropped in round 1, so it may still come in later
    more = edges(spark, [*EDGES, ("b", "c")])
    assert depths(frontier.crawl(seeds, more, 2, cap=1)) == dict(a=0, b=1, c=2)


def bfs(pairs, seeds, max_depth):
    out, level = dict.fromkeys(seeds, 0), list(seeds)
    for d in range(1, max_depth + 1):
        level = [y for x in level for s, y in pairs if s == x and y not in out and not out.update({y: d})]
    return out


@pytest.mark.parametrize("rows_per_key", [3, 10**6])
def test_crawl_with_a_hot_page_equals_bfs(spark, rows_per_key):
    rnd = random.Random(3)
    pairs = [("n0", f"n{k}") for k in range(1, 60)]
    pairs += [(f"n{rnd.randrange(200)}", f"n{rnd.randrange(200)}") for _ in range(150)] + [("n0", "n1")] * 40
    got = frontier.crawl(seed_frontier(["n0", "n7"], spark), edges(spark, pairs), 4, rows_per_key=rows_per_key)
    assert depths(got) == bfs(pairs, ["n0", "n7"], 4)
    assert got.count() == len(depths(got))


@pytest.mark.parametrize("max_bytes", [0, 1 << 20])
def test_round(spark, max_bytes):
    now = spark.createDataFrame([("a", 0), ("b", 1), ("d", 2)], "url string, depth int")
    seen = spark.createDataFrame([("a",), ("b",)], "url string")
    got = frontier.expand_frontier(now, edges(spark), seen, 2, max_bytes=max_bytes, rows_per_key=1)
    assert depths(got) == dict(c=1, d=2)


def test_links_and_visited_urls_are_not_shuffled_again(spark):
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    table = joins.reliable_checkpoint(edges(spark))
    heavy = joins.reliable_checkpoint(joins.heavy_keys(table, ["src_url"], 1))
    table = joins.salt_big(table, heavy, ["src_url"]).repartition(8, "src_url", "_salt").persist()
    table.count()
    seen = frontier._Seen(8)
    seen.add(seed_frontier(["a"], spark))
    seen.add(seed_frontier(["b"], spark))
    fresh = frontier._next_round(table, heavy, seen, seed_frontier(["b"], spark))
    lines = plan_of(fresh).splitlines()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
    assert depths(fresh.withColumn("depth", F.lit(0))) == dict(d=0)
    table.unpersist()
    seen.close()
    # exchanges: the sources to the links, what is found to the visited URLs; none over a kept table
    depth_of = lambda line: len(line) - len(line.lstrip(" :|+-"))
    kept = [k for k, line in enumerate(lines) if "InMemoryTableScan" in line]
    assert len(kept) == 3
    outer = [line for line in lines if "Exchange hashpartitioning(url" in line and "InMemoryRelation" not in line]
    for k in kept:
        above = [line for line in lines[:k] if depth_of(line) < depth_of(lines[k])]
        assert not any("Exchange hashpartitioning(src_url" in line for line in above)
    assert outer


@pytest.mark.parametrize("cap", [1, 3, 7, 1000])
def test_backlog_reaches_what_no_cap_reaches(spark, cap):
    rnd = random.Random(5)
    pairs = [(f"n{rnd.randrange(14)}", f"n{rnd.randrange(14)}") for _ in range(24)]
    seeds = seed_frontier(["n0", "n7"], spark)
    got = frontier.crawl(seeds, edges(spark, pairs), 4, cap=cap, overflow="keep", rows_per_key=3)
    assert depths(got) == bfs(pairs, ["n0", "n7"], 4) and got.count() == len(depths(got))


def test_backlog_after_some_rounds(spark):
    seeds = seed_frontier(["a"], spark)
    first = frontier.crawl(seeds, edges(spark), 9, cap=1, overflow="keep", max_rounds=3)
    assert depths(first) == dict(a=0, b=1, c=1)  # in the order of depth and URL
    with pytest.raises(ValueError):
        frontier.crawl(seeds, edges(spark), 1, cap=1, overflow="wait")


@pytest.mark.parametrize("rows_per_group", [2, 10**6])
def test_frontier_split(spark, rows_per_group):
    rows = [(f"u{k:02d}", k % 4) for k in range(23)]
    now = spark.createDataFrame(rows, "url string, depth int")
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    for cap in (0, 1, 6, 8, 23, 99):
        got = frontier.frontier_split(now, cap, rows_per_group).collect()
        assert len(got) == 23 and {r["url"] for r in got if r["now"]} == {u for u, _ in ordered[:cap]}


@pytest.mark.parametrize("rows_per_group", [7, 10**6])
def test_fetch_plan_numbers_hot_hosts(spark, rows_per_group):
    rows = [(f"http://hot.test/{n:03d}", n % 3) for n in range(90)] + [(f"http://h{n}.test/", 0) for n in range(20)]
    got = frontier.fetch_plan(spark.createDataFrame(rows, "url string, depth int"), 500, rows_per_group).collect()
    want = {}
    for host in {r[0].split("/")[2] for r in rows}:
        for k, (url, depth) in enumerate(sorted((r for r in rows if r[0].split("/")[2] == host), key=lambda r: (r[1], r[0]))):
            want[url] = (host, depth, k + 1, k * 500)
    assert {r["url"]: (r["host"], r["depth"], r["position"], r["slot_ms"]) for r in got} == want


# --- joins ---------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, how):
    big = spark.createDataFrame([("hot", n % 5) for n in range(300)] + [(f"k{n}", n) for n in range(40)] + [(None, 1)], "k string, v int")
    small = spark.createDataFrame([("hot", 1)] + [(f"k{n}", n) for n in range(0, 40, 3)], "k string, w int")
    want = big.join(small, ["k"], how)
    for max_bytes in (0, 1 << 20):
        got = joins.lookup_join(big, small, ["k"], how, max_bytes=max_bytes, rows_per_key=10)
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_salting_spreads_equal_rows(spark):
    big = spark.createDataFrame([("hot", 1)] * 400, "k string, v int").repartition(8)
    heavy = joins.heavy_keys(big, ["k"], 100)
    assert heavy.first()["_parts"] == 4
    assert joins.salt_big(big, heavy, ["k"]).select("_salt").distinct().count() > 1


# --- dedup ---------------------------------------------------------------------------------------------------
def test_dedup(spark):
    rows = [("h1", "b", 0), ("h1", "a", 1), ("h1", "c", 0), ("h2", "z", 2)]
    df = spark.createDataFrame(rows, "hash_id string, url string, depth int")
    kept = dedup.dedup_documents(df)
    assert "hashpartitioning" not in plan_of(kept)  # the rows stay where they are while repeated keys are few
    assert {(r["hash_id"], r["url"]) for r in kept.collect()} == {("h1", "b"), ("h2", "z")}
    assert [tuple(r) for r in dedup.duplicate_groups(df).collect()] == [("h1", 3, "a", "c")]
    for max_bytes in (0, 1 << 20):
        members = dedup.duplicate_members(df, max_bytes=max_bytes, rows_per_key=1)
        assert {tuple(r) for r in members.collect()} == {("h1", m, "a") for m in "abc"}


# --- robots --------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("max_bytes", [0, 1 << 20])
def test_robots(spark, max_bytes):
    cases = [
        (None, "/x", True),
        ("User-agent: *\nDisallow:", "/x", True),
        ("User-agent: *\nDisallow: /a\nAllow: /a/b", "/a/b/c", True),
        ("User-agent: *\nDisallow: /a\nAllow: /a/b", "/a/c", False),
        ("User-agent: testbot\r\nDisallow: /t\r\n\r\nUser-agent: *\r\nDisallow: /", "/t", False),
        ("User-agent: testbot\nDisallow: /t\n\nUser-agent: *\nDisallow: /", "/x", True),
        ("User-agent: a\nUser-agent: testbot\nDisallow: /s", "/s", False),
        ("User-agent: *\nDisallow: /*.html$", "/p.html", False),
        ("User-agent: *\nDisallow: /*.html$", "/p.html.gz", True),
        ("User-agent: *\nDisallow: /x?q", "/x?q=1", True),
        ("USER-AGENT: TestBot # me\nDISALLOW: /c # no", "/c", False),
        ("User-agent: test\nDisallow: /\n\nUser-agent: testbot\nDisallow: /q", "/x", True),
        ("User-agent: testbot\nDisallow: /a\n\nUser-agent: other\nDisallow: /\n\nUser-agent: testbot\nDisallow: /b", "/b", False),
        ("Disallow: /\nUser-agent: testbot\nAllow: /", "/x", True),
        ("User-agent: *\nDisallow: /", "", False),
        ("User-agent: *\nDisallow: /a\nAllow: /a", "/a", True),
        ("User-agent: *\nDisallow: /a.b", "/axb", True),
        ("User-agent: *\nDisallow: /a*c*e", "/a-c-e-f", False),
        ("﻿User-agent: *\nSitemap: x\nDisallow: /für", "/f%C3%BCr", False),
        ("User-agent: testbot\nCrawl-delay: 3\nUser-agent: b\nDisallow: /d", "/d", False),
        ("not robots at all", "/x", True),
    ]
    files = [(f"h{k}.test:81", body) for k, (body, _, _) in enumerate(cases) if body is not None]
    rules = robots.robots_rules(spark.createDataFrame(files, "host string, body string"), "testbot")
    pages = spark.createDataFrame([(k, f"http://h{k}.test:81{p}") for k, (_, p, _) in enumerate(cases)], "k int, url string")
    got = robots.robots_allowed(pages, rules, max_bytes=max_bytes, rows_per_key=1).orderBy("k").collect()
    assert [r["allowed"] for r in got] == [want for _, _, want in cases]


def test_robots_status(spark):
    files = spark.createDataFrame([("h.test", "User-agent: *\nDisallow: /", 500)], "host string, body string, status int")
    assert robots.robots_rules(files, "testbot").count() == 0


# --- checks and the whole crawl --------------------------------------------------------------------------------
def test_checks(spark):
    df = spark.createDataFrame([([],), ([1.0] * 3,), ([1.0] * 4,), (None,)], "content_vector array<float>")
    assert [r["vector_ok"] for r in validate.check_vector(df, 4).collect()] == [True, False, True, True]
    assert [len(r[0]) for r in validate.fill_zero_vector(df, 4).collect()] == [4, 3, 4, 4]
    text = spark.createDataFrame([("é", "aa")], "url string, title string")
    assert validate.check_lengths(text, {"url": 2, "title": 1}).first()["too_long"] == "title"
    assert validate.check_lengths(text, {"url": 1, "title": 1}).first()["too_long"] == "url"
    assert validate.check_lengths(text, {"url": 0, "title": 0}).first()["too_long"] is None


def test_report_of_the_writing_job(spark, tmp_path):
    rows = spark.createDataFrame([(0, "stored"), (1, "stored"), (1, "robots"), (None, None)], "depth int, outcome string")
    want = sorted(map(str, validate.crawl_report(rows).collect()))
    seen, report = validate.observed_report(rows, [0, 1, 2, None], ["stored", "robots", None])
    seen.write.parquet(str(tmp_path / "rows"))
    assert sorted(map(str, report().collect())) == want
    seen, report = validate.observed_report(rows, [0, 1], ["stored", "robots"])
    seen.write.parquet(str(tmp_path / "others"))
    with pytest.raises(ValueError, match="not listed"):
        report()


def site(spark):
    body = "<title>{0}</title><article>text {0}</article>{1}"
    at = "http://s.test"
    rows = [
        (f"{at}/", 200, body.format("root", "<a href=/a>a</a><a href=/robo>r</a><a href=/gone>g</a><a href=http://o.test/>o</a><a href=/none>n</a>")),
        (f"{at}/a", 200, body.format("a", "<a href=/>r</a><a href=/b>b</a><a href=/ad1>x</a>")),
        (f"{at}/b", 200, body.format("b", "<a href=/c>c</a>")),
        (f"{at}/c", 200, body.format("c", "")),
        (f"{at}/robo", 200, body.format("robo", "<a href=/behind>x</a>")),
        (f"{at}/gone", 404, body.format("gone", "<a href=/behind>x</a>")),
        (f"{at}/behind", 200, body.format("behind", "")),
        (f"{at}/ad1", 200, body.format("ad1", "")),
    ]
    return spark.createDataFrame(rows, "url string, status int, html string").withColumn(
        "fetched_at", F.timestamp_seconds(F.lit(1700000000))
    )


def test_whole_crawl(spark, tmp_path):
    result = crawl_documents(
        site(spark),
        seed_frontier(["http://s.test/"], spark),
        max_depth=2,
        robots=spark.createDataFrame([("s.test", "User-agent: *\nDisallow: /robo")], "host string, body string"),
        agent="testbot",
        content_tags=["article"],
        ad_patterns=["/ad[0-9]"],
        limits={"title": 3},
    )
    assert "Python" not in plan_of(result.documents)  # pages were parsed once, into the table that is joined
    at = "http://s.test"
    assert depths(result.reached) == {f"{at}/": 0, f"{at}/a": 1, f"{at}/robo": 1, f"{at}/gone": 1, f"{at}/none": 1, f"{at}/b": 2}
    reasons = {r["url"][len(at) :]: r["reject_reason"] for r in result.documents.collect()}
    # a refused document does not end its branch, a disallowed or failed page does
    assert reasons == {"/": "too_long:title", "/a": None, "/b": None, "/robo": "robots", "/gone": "status"}
    accepted, rejected = validate.route_rejects(result.documents)
    assert rejected.count() == 3
    stored = write_documents(accepted.drop("depth"), str(tmp_path / "docs"))
    write_documents(accepted.drop("depth"), str(tmp_path / "docs"))
    assert stored.sparkSession.read.parquet(str(tmp_path / "docs")).count() == 4  # appended, not merged
    with pytest.raises(ValueError):
        write_documents(accepted, str(tmp_path / "docs"))
    report = {(r["depth"], r["outcome"]): r["pages"] for r in validate.crawl_report(outcomes(result)).collect()}
    assert report[(None, None)] == 6 and report[(1, "not_captured")] == 1 and report[(2, "stored")] == 1
