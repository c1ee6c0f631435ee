"""Pages with very many blocks: the same content as by testing every pair, in about linear time."""

import random
import time

import pytest
from pyspark.sql import functions as F

from pagemill.functions import extract as X
from pagemill.functions import nodes as N
from pagemill.functions.columns import count_below, let
from pagemill.functions.nodes import html_nodes


def test_count_below(spark):
    draw = random.Random(3)
    rows = [(sorted(draw.randint(0, 30) for _ in range(draw.randint(0, 20))), draw.randint(-1, 31)) for _ in range(300)]
    df = spark.createDataFrame(rows, "a array<int>, v int")
    got = df.select("a", "v", count_below(F.col("a"), F.col("v")).alias("n")).collect()
    assert all(r["n"] == sum(x < r["v"] for x in r["a"]) for r in got)


def page(blocks):
    parts = []
    for i in range(blocks):
        inner = f"<nav>menu {i}</nav>" if i % 3 == 0 else ""
        ad = " class=adsbygoogle" if i % 50 == 7 else ""
        parts.append(f"<section{ad}><p>Paragraph {i} {inner} with words enough to be longer than fifty bytes</p></section>")
    return "<title>t</title>" + "".join(parts) + "<a href=/x>x</a>"


@pytest.mark.parametrize("few", [0, 10_000])
def test_halving_gives_the_same(spark, monkeypatch, few):
    monkeypatch.setattr(N, "FEW", few)
    df = spark.createDataFrame([(page(40),), (page(3),), ("",)], "html string")
    dom = df.select(html_nodes(F.col("html")).alias("dom"))
    view = dom.select(X.page_view(F.col("dom")).alias("page"))
    got = view.select(
        "page.main_content", F.transform("page.cut", lambda r: r["i"]).alias("cut"), F.transform("page.nodes", lambda r: r["i"]).alias("left")
    ).collect()
    monkeypatch.setattr(N, "FEW", 8)
    assert len(got[0]["cut"]) == 14 and "menu" not in got[0]["main_content"]
    want = dom.select(X.page_view(F.col("dom")).alias("page")).select(
        "page.main_content", F.transform("page.cut", lambda r: r["i"]).alias("cut"), F.transform("page.nodes", lambda r: r["i"]).alias("left")
    ).collect()
    assert got == want


def test_sixteen_thousand_blocks(spark):
    took = []
    for blocks in (4_000, 16_000):
        df = spark.createDataFrame([(page(blocks),)], "html string")
        content = df.select(let(html_nodes(F.col("html")), X.main_content_fallback).alias("c"))
        start = time.time()
        text = content.first()["c"]
        took.append(time.time() - start)
        assert f"Paragraph {blocks - 1} " in text and "menu" not in text
    assert took[1] < 10 * max(took[0], 0.5)
