"""Nothing is lost or changed in silence: deep pages, long host names, odd vectors, encoded robots rules, dedup order."""

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from pagemill.functions.html_tree import PageTree
from pagemill.operators import dedup, links, robots, vectors
from pagemill.schema import DOCUMENT_SCHEMA, PAGE_SCHEMA
from pagemill.sources.documents import write_documents, write_routed
from pagemill.sources.pages import read_pages


def text_of(tree, tag):
    whole = b"".join(tree.text)
    return [whole[r[3] : r[4]].decode() for r in tree.rows if r[1] == tag]


def test_deep_elements_nest():
    tree = PageTree("<font>" * 3000 + "<article>deep <p>text</article>" + "</font>" * 3000)
    assert text_of(tree, "article") == ["deep text"]
    tree = PageTree("<ul><li>" * 2000 + "<p>x" + "</li></ul>" * 2000 + "<div>after</div>")
    assert text_of(tree, "div") == ["after"] and text_of(tree, "p") == ["x"]


def test_deep_pages_stay_linear():
    import time

    start = time.time()
    PageTree("<font>" * 100_000 + "</b>" * 100_000 + "<p>" * 1000)
    assert time.time() - start < 10


def test_domain_table_equals_list_on_long_hosts(spark):
    long = ".".join(["a" * 60] * 5) + ".bad.example"
    urls = [f"http://{long}/x", "http://ok.example/", f"http://{long[1:]}/", "http://z/"]
    rows = spark.createDataFrame([(u,) for u in urls], "url string")
    for domains in ([long], ["bad.example"], [long, "z"]):
        table = spark.createDataFrame([(d,) for d in domains], "domain string")
        listed = sorted(r[0] for r in links.not_excluded_domain(rows, domains).collect())
        assert sorted(r[0] for r in links.not_excluded_domain(rows, table).collect()) == listed


def test_many_patterns(spark):
    rows = spark.createDataFrame([("http://a/ad777/",), ("http://a/b",), ("http://a/xyxy",)], "url string")
    patterns = [f"/ad{i}/" for i in range(20_000)] + [r"(xy)\1", r"\Qa|b", "(?i)NOTHERE"]
    assert [r[0] for r in links.not_ad_link(rows, patterns).collect()] == ["http://a/b"]
    with pytest.raises(ValueError):
        links.not_ad_link(rows, ["fine", "(broken"])
    assert links.not_ad_link(rows, ["(broken"], on_bad_pattern="ignore").count() == 3


def vectors_frame(spark, rows, columns="id long, vector array<float>"):
    return spark.createDataFrame(rows, columns)


@pytest.mark.parametrize("options", [{}, {"max_bytes": 0, "vector_block": 2, "query_block": 1}])
def test_missing_vectors_take_no_part(spark, options):
    good = [(i, [float(i), 1.0]) for i in range(6)]
    data = vectors_frame(spark, [(100, []), (101, None), *good])
    queries = vectors_frame(spark, [(200, []), (201, None), (202, [2.2, 1.0])])
    got = vectors.knn_l2(data, queries, 2, **options).orderBy("rank").collect()
    assert [(r["query_id"], r["id"]) for r in got] == [(202, 2), (202, 3)]


def test_other_sizes_fail(spark):
    data = vectors_frame(spark, [(1, [1.0, 2.0]), (2, [1.0])])
    with pytest.raises(ValueError, match="differ in size"):
        vectors.knn_l2(data, data, 1)
    with pytest.raises(Exception, match="vector size is not 2"):
        vectors.knn_l2(data, data.filter("id = 1"), 1).collect()


def test_lists_accept_missing_vectors(spark):
    data = vectors_frame(spark, [(100, []), (101, None)] + [(i, [float(i), 1.0]) for i in range(20)])
    model = vectors.ivf_train(data, 3)
    assigned = vectors.ivf_assign(data, model)
    assert {r["id"] for r in assigned.filter("list_id IS NULL").collect()} == {100, 101}
    got = vectors.knn_ivf(assigned, data.filter("id = 7"), model, 2, 3).orderBy("rank").collect()
    assert [r["id"] for r in got] == [7, 6]
    for index in ("HNSW", "IVF_FLAT", "other"):
        found = vectors.search(data, data.filter("id = 7"), 1, index, nlist=3, nprobe=3).collect()
        assert [r["id"] for r in found] == [7]


def allowed(spark, body, urls):
    rules = robots.robots_rules(spark.createDataFrame([("h", body)], "host string, body string"), "bot")
    pages = spark.createDataFrame([(f"http://h{u}",) for u in urls], "url string")
    return {r["url"][8:]: r["allowed"] for r in robots.robots_allowed(pages, rules).collect()}


def test_robots_compare_in_one_encoding(spark):
    body = "User-agent: *\nDisallow: /f%C3%BCr\nDisallow: /a%20b\nDisallow: /ümlaut\nDisallow: /%7Euser\nDisallow: /x%2Ay\nDisallow: /p%2fq"
    urls = ["/f%C3%BCr/1", "/f%c3%bcr", "/für", "/a%20b", "/%C3%BCmlaut", "/~user/1", "/x%2ay", "/x-y", "/xzy", "/p%2Fq", "/p/q", "/ok", "/50%"]
    got = allowed(spark, body, urls)
    assert [u for u in urls if got[u]] == ["/x-y", "/xzy", "/p/q", "/ok", "/50%"]


def test_latest_robots_file_counts(spark):
    rows = [("h", "User-agent: *\nDisallow: /old", 1), ("h", "User-agent: *\nDisallow: /a", 2)]
    table = spark.createDataFrame(rows, "host string, body string, fetched_at long")
    rules = robots.robots_rules(table, "bot").select(F.explode("rules").alias("r")).select("r.pattern").collect()
    assert [r[0] for r in rules] == ["/a"]
    with pytest.raises(Exception, match="several robots files"):
        robots.robots_rules(table.drop("fetched_at"), "bot").collect()


def test_robots_on_a_stream_with_large_rules(spark, tmp_path):
    spark.createDataFrame([("http://h/a",), ("http://h/b",)], "url string").write.parquet(f"{tmp_path}/in")
    rules = robots.robots_rules(spark.createDataFrame([("h", "User-agent: *\nDisallow: /a")], "host string, body string"), "bot")
    pages = spark.readStream.schema("url string").parquet(f"{tmp_path}/in")
    checked = robots.robots_allowed(pages, rules, max_bytes=0)
    query = checked.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True)
    query.start(f"{tmp_path}/out").awaitTermination()
    got = {r["url"]: r["allowed"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {"http://h/a": False, "http://h/b": True}


def test_dedup_keeps_the_first_and_shuffles_no_body(spark):
    rows = [(f"h{i % 40}", i, f"u{i % 7}", "body" * 50) for i in range(200)] + [("t", 1, "u", "x")] * 3 + [(None, 1, "u", "x")] * 2
    docs = spark.createDataFrame(rows, "hash_id string, depth int, url string, html_source string")
    kept = dedup.dedup_documents(docs)
    got = sorted((r["hash_id"] or "", r["depth"]) for r in kept.collect())
    assert got == sorted([("", 1), ("", 1), ("t", 1)] + [(f"h{i}", i) for i in range(40)])
    clean = dedup.dedup_documents(docs.filter("hash_id LIKE 'h%'"))
    assert "Exchange hashpartitioning" not in plan_of(clean)
    with pytest.raises(ValueError, match="missing"):
        dedup.dedup_documents(docs.drop("depth"))


def documents(spark, vectors_of):
    names = DOCUMENT_SCHEMA.fieldNames()
    rows = []
    for i, vector in enumerate(vectors_of):
        values = {n: (i if DOCUMENT_SCHEMA[n].dataType.simpleString() in ("bigint", "int") else f"{n}{i}") for n in names}
        rows.append(tuple((values | {"content_vector": vector})[n] for n in names))
    return spark.createDataFrame(rows, DOCUMENT_SCHEMA)


def test_store_contract(spark, tmp_path):
    docs = documents(spark, [[1.0, 2.0], None, [], [1.0]])
    good, bad = write_routed(docs, f"{tmp_path}/routed", dimension=2)
    assert sorted(r["content_vector"] for r in good.collect()) == [[0.0, 0.0], [0.0, 0.0], [1.0, 2.0]]
    assert [(r["reject_reason"], r["content_vector"]) for r in bad.collect()] == [("vector_size", [1.0])]
    stored = write_documents(docs.filter("crawled_at < 3"), f"{tmp_path}/plain", dimension=2)
    assert sorted(r["content_vector"] for r in stored.collect()) == [[0.0, 0.0], [0.0, 0.0], [1.0, 2.0]]
    with pytest.raises(Exception, match="vector size is not 2"):
        write_documents(docs, f"{tmp_path}/fails", dimension=2)


@pytest.mark.parametrize("kind", ["csv", "json", "orc", "parquet"])
def test_sources(spark, tmp_path, kind):
    rows = [("http://a/", 200, '<p>x, "y"</p>\n<b>', None), ("http://b/", None, "<p>z</p>", None)]
    pages = spark.createDataFrame(rows, PAGE_SCHEMA)
    writer = pages.write.format(kind)
    if kind == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.save(f"{tmp_path}/{kind}")
    got = read_pages(spark, f"{tmp_path}/{kind}", kind).collect()
    assert sorted(map(str, got)) == sorted(map(str, pages.collect()))
