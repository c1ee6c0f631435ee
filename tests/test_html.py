import hashlib
import random

import pytest
from pyspark.sql import functions as F

from pagemill.functions.html_tree import PageTree
from pagemill.functions.nodes import html_nodes, select_nodes
from pagemill.operators.links import page_links, same_host
from pagemill.plans.documents import to_documents
from tests.conftest import plan_of

P = "The quick brown fox jumps over the lazy dog near the old river bank."
A = "An aside paragraph that is deliberately longer than fifty bytes in total."
G1 = (
    '<!doctype html><html lang=" en-US "><head><title> Hello &amp; Bye </title>'
    '<meta name="description" content="  d1  "><link rel="canonical" href="../c#f">'
    '<meta property="article:published_time" content="2024-03-01T10:00:00+09:00"></head><body><h1>Top</h1>'
    "<article>One  two<p>three</p></article><article>four</article><h3> </h3>"
    '<a href="#x">a</a><a href="JavaScript:void(0)">b</a><a href="/p?q=1#z">c</a><a href="mailto:a@b.c">d</a>'
    '<a href="//other.test/q">e</a><a href="http://ex.test:8080/r">f</a></body></html>'
)
G2 = (
    f'<html><body><article><nav>menu <a href="/n">n</a></nav><p>{P}</p><aside><p>{A}</p><h3>Gone</h3></aside>'
    '<h2>Sub</h2></article><p>short</p><footer><a href="/f">f</a></footer></body></html>'
)
EMPTY_HASH = hashlib.sha256(b"").hexdigest()


def tree(html):
    t = PageTree(html)
    return b"".join(t.text).decode(), [(r[1], r[0], r[5]) for r in t.rows], t


def tags(html):
    return [r[1] for r in PageTree(html).rows]


def text_of(html, tag):
    t = PageTree(html)
    text = b"".join(t.text)
    return [text[r[3] : r[4]].decode() for r in t.rows if r[1] == tag]


def test_optional_end_tags():
    assert text_of("<p>a<p>b<div>c</div>d", "p") == ["a", "b"]
    assert text_of("<ul><li>a<ul><li>x</ul><li>b</ul>", "li") == ["ax", "x", "b"]
    assert text_of("<table><tr><td>1<td>2<tr><td>3</table>z", "td") == ["1", "2", "3"]
    assert text_of("<dl><dt>a<dd>b<dt>c</dl>", "dd") == ["b"]
    assert text_of("<select><option>a<option>b</select>", "option") == ["a", "b"]
    assert text_of("<h1>a<h2>b</h2>", "h1") == ["a"]
    assert text_of("<article>a</p>b</article>", "p") == [""]


def test_raw_text_and_entities():
    assert text_of('<script>var t="</p>";</script><p>x', "script") == ['var t="</p>";']
    assert text_of("<title>a &lt;b> &amp c</title>", "title") == ["a <b> & c"]
    assert text_of("<article>a<noscript><img></noscript>b</article>", "article") == ["a<img>b"]
    assert PageTree('<a href="?a=1&copy=2&amp;b=&lt;">').rows[-1][2] == {"href": "?a=1&copy=2&b=<"}
    assert text_of("<p>&am &middot;", "p") == ["&am ·"]


def test_comments_attributes_and_truncation():
    assert tree("a<!-- <p>x</p> -->b<!doctype x><?y?>c")[0] == "abc"
    assert PageTree("<a HREF='x y' href=z Data-q=1 checked>").rows[-1][2] == {"href": "x y", "data-q": "1", "checked": ""}
    assert tree("a<p title='never closed")[0] == "a"
    assert tree("1 < 2 <3")[0] == "1 < 2 <3"
    assert tags("<html><body lang=x><br/><img src=a>") == ["html", "head", "body", "br", "img"]


def test_implied_structure():
    assert tags("<title>t</title>x") == ["html", "head", "title", "body"]
    assert PageTree("<p>a<html lang=de>").rows[0][2] == {"lang": "de"}
    _, rows, _ = tree("<div><p>a</div><p>b")
    assert rows == [("html", 0, 6), ("head", 1, 2), ("body", 1, 6), ("div", 3, 5), ("p", 4, 5), ("p", 3, 6)]


def test_deep_nesting_is_bounded_and_balanced():
    html = "<div>" * 1000 + "deep<script>x</script><p>q</p>" + "</div>" * 1000 + "<article>after</article>"
    t = PageTree(html)
    article = next(r for r in t.rows if r[1] == "article")
    assert b"".join(t.text) == b"deepxqafter"
    assert article[0] == 3 and text_of(html, "article") == ["after"]


def test_random_markup_keeps_ranges_nested():
    rnd = random.Random(5)
    tokens = (
        "<p> </p> <div> </div> <b> </b> <li> <ul> </ul> <table> <tr> <td> </table> <article> </article> <h1> </h2> "
        "<script> </script> <title> <!-- --> <a/href=x> </a> <br> </br> <svg> <path/> </svg> <body> <html/lang=x> "
        "</body> <head> </head> text &amp; & < > <option> <select> <template> <textarea> <button> <plaintext> é <td </"
    ).split()
    for _ in range(2000):
        html = "".join(rnd.choice(tokens) for _ in range(rnd.randrange(30)))
        t = PageTree(html)
        assert not t.stack and len(b"".join(t.text)) == t.size
        for i, (up, _, _, start, stop, last) in enumerate(t.rows, 1):
            assert up < i <= last <= len(t.rows) and 0 <= start <= stop <= t.size, html
            if up:
                _, _, _, s, e, to = t.rows[up - 1]
                assert last <= to and s <= start and stop <= e, html


def test_invalid_utf8_page_is_still_parsed(spark, tmp_path):
    from pagemill.sources.pages import read_pages

    (tmp_path / "a.html").write_bytes(b"<title>caf\xe9</title>")
    pages = read_pages(spark, str(tmp_path), "html")
    assert to_documents(pages).first()["title"] == "caf�"


def documents(spark, html, selectors=(), url="https://ex.test/"):
    return to_documents(spark.createDataFrame([(url, html)], "url string, html string"), selectors).first()


def links(spark, html, selectors=(), url="https://ex.test/"):
    df = page_links(spark.createDataFrame([(url, html)], "url string, html string"), selectors)
    return df


def test_g1_configured_tags(spark):
    url = "https://ex.test/a/b?x=1"
    d = documents(spark, G1, ["article"], url)
    assert d["main_content"] == "One twothree\nfour"
    assert d["hash_id"] == "10eb9c2f51ce6de91d6f1a1598723637761d1e3d4649d894120a1f5ed80e15dd"
    assert (d["title"], d["meta_description"], d["language"]) == ("Hello & Bye", "d1", "en-US")
    assert d["canonical_url"] == "https://ex.test/c#f"
    assert d["publication_timestamp"] == 1709254800
    assert d["headings_text"] == "Top | "
    assert d["content_vector"] == []
    rows = links(spark, G1, ["article"], url)
    assert [r["href"] for r in rows.orderBy("ord").collect()] == [
        "/p?q=1#z", "mailto:a@b.c", "//other.test/q", "http://ex.test:8080/r",
    ]
    assert [r["url"] for r in same_host(rows).orderBy("ord").collect()] == [
        "https://ex.test/p?q=1#z", "http://ex.test:8080/r",
    ]


def test_g2_fallback_removes_boilerplate_for_good(spark):
    d = documents(spark, G2)
    assert d["main_content"] == f"{P}Sub {P} {A}"
    assert d["hash_id"] == "d2dcfea29b7835e3db2d0a0cad20d1a5e4f3455fb5cf9249e40515404df09c38"
    assert d["headings_text"] == "Sub"
    assert [r["url"] for r in links(spark, G2).collect()] == ["https://ex.test/f"]
    d = documents(spark, G2, ["article"])
    assert d["headings_text"] == "Gone | Sub"
    assert "menu n" in d["main_content"]
    assert {r["href"] for r in links(spark, G2, ["article"]).collect()} == {"/n", "/f"}


def test_g3_empty_match_suppresses_the_fallback(spark):
    html = f"<article><img></article><p>{P}</p>"
    d = documents(spark, html, ["article"])
    assert (d["main_content"], d["hash_id"]) == ("", EMPTY_HASH)
    assert documents(spark, html, ["main"])["main_content"] == P


@pytest.mark.parametrize("text,kept", [("é" * 25, False), ("é" * 26, True), ("a" * 50, False), ("a" * 51, True)])
def test_g4_threshold_is_bytes(spark, text, kept):
    assert documents(spark, f"<p>{text}</p>")["main_content"] == (text if kept else "")


def test_g5_script_inside_a_match_counts(spark):
    assert documents(spark, "<article>a<script>var x;</script>b</article>", ["article"])["main_content"] == "avar x;b"


def test_heading_loses_boilerplate_inside_it(spark):
    html = f"<h1>a<span class='x adsbygoogle'>ad</span>b</h1><section>{P}<nav>{A}</nav></section>"
    d = documents(spark, html)
    assert (d["headings_text"], d["main_content"]) == ("ab", P)


def test_selectors(spark):
    html = "<div id=d class='a b'><p data-k='v1'>1</p><p>2</p></div><nav><a href=x>3</a></nav><a>4</a>"
    df = spark.createDataFrame([(html,)], "html string").select(html_nodes(F.col("html")).alias("dom"))
    wanted = {
        "p": 2, "p, a": 4, "a[href]": 1, "[data-k='v1']": 1, "[data-k=v2]": 0, ".a": 1, "div.b": 1, "p.b": 0, "#d": 1,
        "nav a": 1, "div p, nav": 3, "*": 8, "[data-k^='v']": 1, "[class~=b]": 1, "[class$=b]": 1, "[data-k*='1']": 1,
    }
    row = df.select(*[F.size(select_nodes(F.col("dom"), s)).alias(str(k)) for k, s in enumerate(wanted)]).first()
    assert dict(zip(wanted, row)) == {**wanted, "*": 9}
    with pytest.raises(ValueError):
        select_nodes(F.col("dom"), "a > b")


@pytest.mark.parametrize(
    "head,want",
    [
        ('<meta property="article:published_time" content="2024-03-01T10:00:00Z"><meta name=pubdate content="2020-01-01">', 1709287200),
        ('<meta property="article:published_time" content=""><meta name=pubdate content="2024-03-01">', 1709251200),
        ('<meta property="article:published_time" content="junk"><meta name=pubdate content="2024-03-01">', 0),
        ('<time datetime="">a</time><time datetime="2024-03-01">b</time>', 0),
        ('<time>a</time><time datetime="2024-03-01">b</time>', 1709251200),
    ],
)
def test_date_precedence(spark, head, want):
    assert documents(spark, head)["publication_timestamp"] == want


def test_date_formats(spark):
    from pagemill.functions.extract import parse_publication_ts

    want = {
        "2024-03-01T10:00:00.5Z": 1709287200,
        "2024-03-01T10:00:00,5Z": 1709287200,
        "2024-03-01T9:00:00Z": 1709283600,
        "2024-03-01T10:00:00+19:30": 1709287200 - 19 * 3600 - 1800,
        "2024-03-01T10:00:00-02:00": 1709287200 + 7200,
        "2024-03-01": 1709251200,
        **dict.fromkeys(
            ["2024-03-01T10:00:00", "2024-03-01T10:00:00+0900", "2024-03-01T10:00:00z", "2024-02-30", " 2024-03-01",
             "2024-03-01T24:00:00Z", "2024-03-01T10:00:60Z", "2024-03-01T10:00:00+25:00", "", "2024-3-1"]
        ),
    }
    df = spark.createDataFrame([(k,) for k in want], "s string")
    for zone in ("UTC", "Asia/Tokyo"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        got = {r["s"]: r["t"] for r in df.select("s", parse_publication_ts(F.col("s")).alias("t")).collect()}
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        assert got == want


def test_pages_are_parsed_once_and_filters_reach_the_scan(spark, tmp_path):
    from pagemill.sources.pages import ok_responses, read_pages

    rows = [(f"https://ex.test/{n}", 200 if n % 2 else 404, G2) for n in range(6)]
    spark.createDataFrame(rows, "url string, status int, html string").write.parquet(str(tmp_path / "p"))
    docs = to_documents(ok_responses(read_pages(spark, str(tmp_path / "p"))), ["article"])
    plan = plan_of(docs.filter(F.col("title") == "").select("url", "title", "headings_text", "main_content"))
    assert plan.count("ArrowEvalPython") == 1
    assert "EqualTo(status,200)" in plan
    assert "Exchange" not in plan
    assert docs.count() == 3


def test_pages_in_pieces_give_the_same():
    import pyarrow as pa

    from pagemill.functions import nodes as N

    pages = pa.array([f"<p id=x{k}>text <b>{k}</b>" * (k % 4) if k % 5 else None for k in range(40)])
    parts = N._parts(pages, 50)
    assert len(parts) > 5 and sum(map(len, parts)) == 40
    assert pa.concat_arrays([N._dom_batch(p) for p in parts]).to_pylist() == N._dom_batch(pages).to_pylist()


def test_parsed_pages_come_out_in_bounded_pieces(monkeypatch):
    """One batch of pages with many elements is never one batch of the result, and the next one is not asked for early."""
    import pyarrow as pa

    from pagemill.functions import nodes as N

    pages = pa.array([f"<article id=a{k}>" + "<font>" * 600 + "text" for k in range(1000)])
    taken = []

    def batches():
        for _ in range(2):
            taken.append(1)
            yield pages

    sizes, rows = [], 0
    for piece in N._dom_udf.func(batches()):
        assert len(taken) == rows // 1000 + 1
        sizes.append(len(piece.field("nodes").flatten()))
        rows += len(piece)
    assert rows == 2000 and max(sizes) < 200_000 and sum(sizes) == 2000 * 604
