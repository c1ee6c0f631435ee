import random
import re
import time

import pytest
from pyspark.sql import functions as F

from pagemill.operators import links as L
from pagemill.operators import patterns as P
from pagemill.operators import robots
from pagemill.operators.embedding import embed_once
from tests.conftest import plan_of


@pytest.mark.parametrize(
    "pattern,want",
    [
        ("/ads/", ("/ads/", True)),
        (r"/banner(\d+)x?\.gif$", ("/banner", True)),
        (r"foo\.bar", ("foo.bar", True)),
        ("a(bc)?defg", ("defg", True)),
        ("(abc)+d", ("abc", True)),
        ("(abc|axd)xyz", ("xyz", True)),
        ("abc|def", None),
        ("(?i)/AdServer/", ("/adserver/", False)),
        ("(?i)für", None),
        ("(?P<a>track)er", ("tracker", True)),
        ("(?<a>track)er", ("tracker", True)),
        (r"\p{Upper}own", ("own", True)),
        (r"\Qa.b\Ecd", None),
        ("(?x) a b c", None),
        ("x{0}yes", ("yes", True)),
        ("(no){0,2}yes", ("yes", True)),
        ("a.b", None),
        ("[", None),
        ("(?i:abc)de", ("de", True)),
        ("", None),
    ],
)
def test_required_literal(pattern, want):
    assert P.required_literal(pattern) == want


def test_every_match_holds_the_literal():
    draw = random.Random(1)
    parts = ["ab", "c", "(de)", "(f|g)", "h?", "i+", "(jk)*", ".", "[lm]", "n{2}", "(?:op){1,2}", "^", r"\.", r"\d"]
    texts = ["".join(draw.choice("abcdefghijklmnop.1") for _ in range(draw.randrange(1, 14))) for _ in range(3000)]
    checked = 0
    for _ in range(400):
        pattern = "".join(draw.choice(parts) for _ in range(draw.randrange(1, 6)))
        found = P.required_literal(pattern)
        for text in texts if found else ():
            if re.search(pattern, text):
                checked += 1
                assert found[0] in text, (pattern, text)
    assert checked > 500


@pytest.mark.parametrize("max_bytes", [40, 1 << 20])
def test_table_equals_list(spark, max_bytes):
    draw = random.Random(2)
    urls = [f"http://{draw.choice('abc')}.test/{draw.choice(('ads', 'Ads', 'x', 'ünï'))}/{draw.randrange(60)}.{draw.choice(('gif', 'html'))}" for _ in range(300)]
    links = spark.createDataFrame([(u, k) for k, u in enumerate([*urls, None])], "url string, k int")
    listed = ["/ads/1", "(?i)/ADS/2", r"/\d+\.gif$", "[[:upper:]]ds/3", "ünï/4", "a.test/x/5|b.test/x/6", "no such thing"]
    for some in (listed, listed[:2], listed[5:6], []):
        table = spark.createDataFrame([(p,) for p in [*some, *some, None]], "pattern string")
        want = sorted(r["k"] for r in L.not_ad_link(links.na.drop(), some).collect())
        got = P.not_ad_link_table(links.na.drop(), table, max_bytes=max_bytes)
        assert sorted(r["k"] for r in got.collect()) == want
        assert "Exchange" not in plan_of(got)
    assert P.not_ad_link_table(links, ["[", "/ads/"], on_bad_pattern="ignore").count() < 300
    with pytest.raises(ValueError, match="invalid ad pattern"):
        P.not_ad_link_table(links, ["["])


def test_many_patterns(spark):
    urls = spark.range(40_000).select(F.concat(F.lit("http://s.test/story/"), "id", F.lit("/page.html?ref="), F.col("id") % 97).alias("url"))
    many = [rf"/banner-{n}/[a-z]+\.(gif|png)" for n in range(20_000)] + ["/story/7[0-9]*/page"]
    start = time.time()
    assert P.not_ad_link_table(urls, many).count() == urls.filter("NOT url RLIKE '/story/7[0-9]*/page'").count()
    assert time.time() - start < 60


# --- robots by index -------------------------------------------------------------------------------------------
def random_robots(draw):
    piece = lambda: "".join(draw.choice(("a", "b", "/", "*", "%41", "ü", ".")) for _ in range(draw.randrange(0, 5)))
    lines = ["User-agent: *"]
    for _ in range(draw.randrange(1, 30)):
        lines.append(f"{draw.choice(('Allow', 'Disallow'))}: /{piece()}{draw.choice(('', '', '$'))}")
    return "\n".join(lines)


@pytest.mark.parametrize("max_bytes", [0, 1 << 20])
def test_index_equals_rules_in_the_row(spark, max_bytes):
    draw = random.Random(3)
    files = spark.createDataFrame([(f"h{k}.test", random_robots(draw)) for k in range(25)], "host string, body string")
    rules = robots.robots_rules(files, "bot")
    path = lambda: "".join(draw.choice(("a", "b", "/", "A", "ü", ".")) for _ in range(draw.randrange(0, 7)))
    rows = [(f"http://h{draw.randrange(27)}.test/{path()}", k) for k in range(1500)]
    pages = spark.createDataFrame([*rows, (None, 1), ("no url", 2)], "url string, k int")
    text = lambda df: sorted(map(str, df.select("url", "k", "allowed").collect()))
    want = text(robots.robots_allowed(pages, rules, many=1000))
    for many in (0, 12):
        got = robots.robots_allowed(pages, rules, max_bytes=max_bytes, rows_per_key=50, many=many)
        assert got.columns == ["url", "k", "allowed"] and text(got) == want


def test_very_many_rules_of_one_host(spark):
    body = "\n".join(["User-agent: *", *(f"Disallow: /private/{n}/" for n in range(20_000)), "Allow: /private/7/open"])
    rules = robots.robots_rules(spark.createDataFrame([("h.test", body)], "host string, body string"), "bot")
    n = F.col("id") % 40_000
    pages = spark.range(100_000).select(F.concat(F.lit("http://h.test/private/"), n, F.when(F.col("id") % 2 == 0, "/open").otherwise("/x")).alias("url"))
    start = time.time()
    got = robots.robots_allowed(pages, rules)
    assert got.filter("NOT allowed").count() == pages.filter(
        "cast(regexp_extract(url, 'private/([0-9]+)', 1) as int) < 20000 AND NOT url LIKE '%/private/7/open%'"
    ).count()
    assert time.time() - start < 90


# --- embedding once --------------------------------------------------------------------------------------------
def test_each_text_is_embedded_once(spark):
    rows = [(k, f"text {k % 7}", "old") for k in range(300)] + [(300, "", "old"), (301, None, "old"), (302, None, None)]
    docs = spark.createDataFrame(rows, "k int, text string, content_vector string").repartition(4)
    calls = spark.sparkContext.accumulator(0)

    def model(text):
        @F.pandas_udf("array<float>")
        def vector(texts):
            calls.add(len(texts))
            return texts.map(lambda t: [float(len(t or "")), 1.0 if t is None else 0.0])

        return vector(text)

    for options in ({}, {"part_bytes": 10, "max_bytes": 0, "rows_per_key": 20}):
        calls.value = 0
        got = embed_once(docs, model, **options)
        assert got.columns == ["k", "text", "content_vector"]
        got = {r["k"]: (r["text"], list(r["content_vector"])) for r in got.collect()}
        assert calls.value == 9  # seven texts, the empty one and the missing one
        assert got == {k: (t, [float(len(t or "")), float(t is None)]) for k, t, _ in rows}
    assert embed_once(docs.limit(0), model).count() == 0
