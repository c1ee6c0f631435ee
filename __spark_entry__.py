"""Registered queries: every operator over the given tables, and the SQL they are compared with."""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import checks as C  # noqa: E402
import oracle  # noqa: E402
from pagemill.functions import embed as E  # noqa: E402
from pagemill.functions import extract as X  # noqa: E402
from pagemill.functions.models import count_model  # noqa: E402
from pagemill.functions.nodes import first_node, html_nodes, select_nodes  # noqa: E402
from pagemill.functions.text import clean_text, content_hash  # noqa: E402
from pagemill.functions.urls import url_parts  # noqa: E402
from pagemill.operators import dedup, frontier, links, patterns, robots, validate, vectors  # noqa: E402
from pagemill.operators.embedding import embed_once  # noqa: E402
from pagemill.operators.joins import shared_folder  # noqa: E402
from pagemill.plans.crawl import crawl_documents, outcomes  # noqa: E402
from pagemill.plans.documents import parsed_pages, to_documents  # noqa: E402
from pagemill.session import ship_package  # noqa: E402
from pagemill.sources.documents import write_documents, write_documents_once  # noqa: E402
from pagemill.sources.pages import ok_responses, read_pages, seed_frontier, spread  # noqa: E402
from pagemill.streaming import pages as S  # noqa: E402
from pagemill.streaming.crawl import stream_crawl  # noqa: E402
from pagemill.streaming.store import stream_store_documents  # noqa: E402

try:  # the training-data operators and their pipeline are an optional part
    import corpus_pipeline  # noqa: E402
    from pagemill.llm import queries as llm_queries  # noqa: E402
except ModuleNotFoundError as missing:  # a broken module of the part is an error, only its absence is none
    if missing.name not in ("corpus_pipeline", "pagemill.llm"):
        raise
    corpus_pipeline = llm_queries = None

TAGS = ["article"]


# --- inputs ------------------------------------------------------------------------------------------------
def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The captured pages, spread over the cores where the table is one small file."""
    return spread(read_pages(spark, f"{sf_dir}/pages.parquet"))


def _sql(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    _pages(spark, sf_dir).createOrReplaceTempView("pages")
    return spark.sql(query)


def _aug(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with status, description, canonical link, date, headings and more links; see `checks`."""
    stamp = F.timestamp_seconds(F.lit(1704067200) + F.col("page_id"))
    return _sql(spark, sf_dir, C.AUGMENTED).withColumn("fetched_at", stamp)


def _stamped(spark, query: str) -> DataFrame:
    pages = spark.sql(query)
    return pages.withColumn("fetched_at", F.timestamp_seconds(F.lit(1704067200) + F.col("page_id")))


def _scratch(spark: SparkSession) -> str:
    """New folder for written results, next to the checkpoints the cluster shares."""
    return f"{shared_folder(spark)}/out-{uuid.uuid4().hex}"


def _doc_columns(docs: DataFrame) -> DataFrame:
    return docs.select(
        "hash_id",
        "url",
        F.octet_length("html_source").cast("long").alias("html_bytes"),
        F.sha2("html_source", 256).alias("html_hash"),
        "main_content",
        "title",
        "meta_description",
        "canonical_url",
        "language",
        "publication_timestamp",
        "headings_text",
        "crawled_at",
    )


# --- sources and sinks -------------------------------------------------------------------------------------
def q_read_pages(spark, sf_dir):
    pages = read_pages(spark, f"{sf_dir}/pages.parquet")
    return pages.select(
        "url", F.octet_length("html").cast("long").alias("html_bytes"), F.sha2("html", 256).alias("html_hash")
    )


def q_ok_responses(spark, sf_dir):
    return ok_responses(_aug(spark, sf_dir)).select("url", "status")


def q_seed_frontier(spark, sf_dir):
    return seed_frontier(_pages(spark, sf_dir))


def q_write_documents(spark, sf_dir):
    return _doc_columns(write_documents(to_documents(_aug(spark, sf_dir), TAGS), _scratch(spark) + "/documents"))


def q_write_documents_once(spark, sf_dir):
    """Two batches; the first is written again, as after a crash."""
    docs, path = to_documents(_aug(spark, sf_dir), TAGS), _scratch(spark) + "/documents"
    even = F.octet_length("url") % 2 == 0
    for part, batch in ((docs.filter(even), 0), (docs.filter(even), 0), (docs.filter(~even), 1)):
        table = write_documents_once(part, path, batch)
    return _doc_columns(table)


def q_write_document_vectors(spark, sf_dir):
    """Vectors of stored documents, zeros where a document has none."""
    embed = lambda text: F.when(F.octet_length(F.col("url")) % 2 == 0, E.embed_dummy(text, C.VECTOR_DIM))
    docs = to_documents(_aug(spark, sf_dir), TAGS, embed=embed)
    stored = write_documents(docs, _scratch(spark) + "/documents", dimension=C.VECTOR_DIM)
    rows = stored.select("url", F.posexplode("content_vector").alias("i", "v"))
    return rows.select("url", "i", F.round(F.col("v").cast("double"), 5).alias("v"))


# --- extraction --------------------------------------------------------------------------------------------
def q_html_nodes(spark, sf_dir):
    dom = _pages(spark, sf_dir).select("page_id", html_nodes(F.col("html")).alias("dom"))
    tags = dom.select("page_id", F.explode(F.transform("dom.nodes", lambda n: n["tag"])).alias("tag"))
    return tags.groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))


def q_select_nodes(spark, sf_dir):
    dom = _pages(spark, sf_dir).select("page_id", html_nodes(F.col("html")).alias("dom"))
    d = F.col("dom")
    return dom.select(
        "page_id",
        F.size(select_nodes(d, "nav a[href]")).alias("nav_links"),
        F.size(select_nodes(d, ".ad")).alias("ads"),
        F.size(select_nodes(d, "meta[charset='utf-8']")).alias("charset"),
        F.size(select_nodes(d, "h1, p")).alias("blocks"),
        first_node(d, "a[href]")["attrs"]["href"].alias("first_href"),
    )


def _extracted(name: str, extract: Callable) -> Callable:
    def query(spark, sf_dir):
        parsed = parsed_pages(_aug(spark, sf_dir), TAGS)
        return parsed.select("page_id", extract(F.col("page")).alias(name))

    return query


def q_extract_canonical_url(spark, sf_dir):
    parsed = parsed_pages(_aug(spark, sf_dir), TAGS)
    return parsed.select("page_id", X.extract_canonical_url(F.col("page"), F.col("url")).alias("canonical_url"))


def q_extract_publication_ts(spark, sf_dir):
    parsed = parsed_pages(_aug(spark, sf_dir), TAGS)
    ts = F.coalesce(X.extract_publication_ts(F.col("page")), F.lit(0)).cast("long")
    return parsed.select("page_id", ts.alias("publication_timestamp"))


def _content(tags: list[str]) -> Callable:
    def query(spark, sf_dir):
        dom = _pages(spark, sf_dir).select("page_id", html_nodes(F.col("html")).alias("dom"))
        content = dom.select("page_id", X.extract_main_content(F.col("dom"), tags).alias("main_content"))
        return content.withColumn("hash_id", content_hash(F.col("main_content")))

    return query


def q_clean_text(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", clean_text(F.col("text")).alias("clean"))


def q_main_content_deep(spark, sf_dir):
    """Articles behind more open elements than browsers nest."""
    html = F.replace(F.col("html"), F.lit("<article>"), F.lit("<font>" * C.OPEN_ELEMENTS + "<article>"))
    dom = _pages(spark, sf_dir).select("page_id", html_nodes(html).alias("dom"))
    content = dom.select("page_id", X.extract_main_content(F.col("dom"), TAGS).alias("main_content"))
    return content.withColumn("hash_id", content_hash(F.col("main_content")))


def q_content_hash(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", content_hash(F.col("text")).alias("hash_id"))


def q_to_documents(spark, sf_dir):
    return _doc_columns(to_documents(_aug(spark, sf_dir), TAGS))


# --- links and URLs ----------------------------------------------------------------------------------------
def q_extract_links(spark, sf_dir):
    parsed = parsed_pages(_aug(spark, sf_dir), TAGS)
    return parsed.select("page_id", F.inline(X.extract_links(F.col("page"))))


def q_url_parts(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select("page_id", url_parts(F.col("url")).alias("u"))
    return pages.select("page_id", "u.scheme", "u.host", "u.hostname", "u.path", "u.query", "u.fragment")


def _links(spark, sf_dir):
    return links.page_links(_aug(spark, sf_dir), TAGS)


def q_resolve_url(spark, sf_dir):
    return _links(spark, sf_dir)


def q_same_host(spark, sf_dir):
    return links.same_host(_links(spark, sf_dir)).select("src_url", "ord", "url")


def q_not_excluded_domain(spark, sf_dir):
    return links.not_excluded_domain(_links(spark, sf_dir), C.EXCLUDED).select("src_url", "ord", "url")


def q_not_excluded_domain_table(spark, sf_dir):
    domains = spark.createDataFrame([(d,) for d in C.EXCLUDED], "domain string")
    return links.not_excluded_domain(_links(spark, sf_dir), domains).select("src_url", "ord", "url")


def q_not_ad_link(spark, sf_dir):
    return links.not_ad_link(_links(spark, sf_dir), C.AD_PATTERNS).select("src_url", "ord", "url")


def q_not_ad_link_table(spark, sf_dir):
    """The same patterns among many that fit no link."""
    table = spark.createDataFrame([(p,) for p in [*C.AD_PATTERNS, *C.OTHER_PATTERNS]], "pattern string")
    return patterns.not_ad_link_table(_links(spark, sf_dir), table).select("src_url", "ord", "url")


# --- dedup -------------------------------------------------------------------------------------------------
def _hashed_texts(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", "text", content_hash(F.col("text")).alias("hash_id"))


def q_dedup_documents(spark, sf_dir):
    kept = dedup.dedup_documents(_hashed_texts(spark, sf_dir), order=["doc_id"])
    return kept.select("hash_id", "doc_id", F.octet_length("text").cast("long").alias("bytes"))


def q_dedup_page_documents(spark, sf_dir):
    """One document per content hash of the written page documents."""
    written = write_documents(to_documents(_aug(spark, sf_dir), TAGS), _scratch(spark) + "/documents")
    return _doc_columns(dedup.dedup_documents(written, order=["url"]))


def q_duplicate_groups(spark, sf_dir):
    return dedup.duplicate_groups(_hashed_texts(spark, sf_dir), member="doc_id")


def q_duplicate_members(spark, sf_dir):
    return dedup.duplicate_members(_hashed_texts(spark, sf_dir), member="doc_id")


# --- frontier ----------------------------------------------------------------------------------------------
def _graph(spark, sf_dir):
    """(nodes, edges): N // 4 -> N, N -> N // 2, and a link back to page 0 from everywhere."""
    nodes = _sql(spark, sf_dir, C.GRAPH)
    source = nodes.select(F.col("page_id").alias("id"), F.col("url").alias("other"))
    down = nodes.join(source, F.col("parent") == F.col("id")).select(F.col("other").alias("src_url"), "url")
    up = nodes.join(source, F.col("half") == F.col("id")).select(F.col("url").alias("src_url"), F.col("other").alias("url"))
    root = source.filter("id = 0").first()  # the one row with this id
    back = nodes.select(F.col("url").alias("src_url"), F.lit(root["other"] if root else None).cast("string").alias("url"))
    return nodes, down.unionByName(up).unionByName(back.filter("url IS NOT NULL"))


def _round(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    depth = F.when(F.col("url").like("%#top"), F.lit(C.MAX_DEPTH)).otherwise(F.lit(0))
    visited = nodes.filter(F.col("url").like("http://%")).select("url")
    return frontier.expand_frontier(nodes.select("url", depth.alias("depth")), edges, visited, C.MAX_DEPTH)


def _crawl(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    seeds = seed_frontier(nodes.filter(F.col("page_id") == 0))
    return frontier.crawl(seeds, edges, C.MAX_DEPTH)


def q_frontier_limit(spark, sf_dir):
    return frontier.frontier_limit(_round(spark, sf_dir), C.CAP)


def q_crawl_backlog(spark, sf_dir):
    """The same walk with few URLs a round; what overflows waits."""
    nodes, edges = _graph(spark, sf_dir)
    seeds = seed_frontier(nodes.filter(F.col("page_id") == 0))
    size = max(C.CAP, nodes.count() // 8)
    return frontier.crawl(seeds, edges, C.MAX_DEPTH, cap=size, overflow="keep")


def q_fetch_plan(spark, sf_dir):
    return frontier.fetch_plan(_crawl(spark, sf_dir), C.DELAY_MS)


# --- robots, checks, report --------------------------------------------------------------------------------
def _rules(spark, sf_dir):
    return robots.robots_rules(_sql(spark, sf_dir, C.ROBOTS), "testbot")


def q_robots_rules(spark, sf_dir):
    rule = F.explode("rules").alias("rule")
    return _rules(spark, sf_dir).select("host", rule).select("host", "rule.pattern", "rule.allow")


def q_robots_allowed(spark, sf_dir):
    rules = _rules(spark, sf_dir)
    return robots.robots_allowed(_pages(spark, sf_dir), rules).select("url", "allowed")


def q_robots_allowed_index(spark, sf_dir):
    """The same rules found by join, as for hosts with very many."""
    rules = _rules(spark, sf_dir)
    return robots.robots_allowed(_pages(spark, sf_dir), rules, many=0).select("url", "allowed")


def _gated(spark, sf_dir):
    rules = _rules(spark, sf_dir)
    pages = robots.robots_allowed(_aug(spark, sf_dir), rules)
    reason = validate.page_reject_reason(F.col("url"), F.col("allowed"), F.col("status"))
    return pages.select("url", "status", reason.alias("reject_reason"))


def q_route_rejects(spark, sf_dir):
    accepted, rejected = validate.route_rejects(_gated(spark, sf_dir))
    good = accepted.select("url", F.lit("accepted").alias("outcome"))
    return good.unionByName(rejected.select("url", F.col("reject_reason").alias("outcome")))


def q_check_lengths(spark, sf_dir):
    docs = to_documents(_aug(spark, sf_dir), TAGS, extra=["page_id"])
    return validate.check_lengths(docs, C.LIMITS).select("page_id", "too_long")


def _mixed_vectors(spark, sf_dir):
    """The given vectors, whole, cut to three elements, or empty."""
    whole = F.col("embedding")
    kind = F.col("vec_id") % 3
    vector = F.when(kind == 0, whole).when(kind == 1, F.slice(whole, 1, 3)).otherwise(F.slice(whole, 1, 0))
    return _table(spark, sf_dir, "embeddings").select("vec_id", vector.alias("content_vector"))


def q_check_vector(spark, sf_dir):
    return validate.check_vector(_mixed_vectors(spark, sf_dir), 64).select("vec_id", "vector_ok")


def q_fill_zero_vector(spark, sf_dir):
    filled = validate.fill_zero_vector(_mixed_vectors(spark, sf_dir), 64)
    rows = filled.select("vec_id", F.posexplode("content_vector").alias("i", "x"))
    return rows.select("vec_id", (F.col("i") + 1).alias("i"), F.round(F.col("x").cast("double"), 6).alias("x"))


def _outcomes(spark, sf_dir):
    outcome = F.coalesce(F.col("reject_reason"), F.lit("accepted")).alias("outcome")
    return _gated(spark, sf_dir).select(F.col("status").alias("depth"), outcome)


def q_crawl_report(spark, sf_dir):
    return validate.crawl_report(_outcomes(spark, sf_dir))


def q_crawl_report_observed(spark, sf_dir):
    """Counted by the job that writes the outcomes."""
    rows, report = validate.observed_report(_outcomes(spark, sf_dir), C.STATUSES, ["accepted", "robots", "status", "bad_url"])
    rows.write.parquet(_scratch(spark) + "/outcomes")
    return report()


def q_stream_crawl_report(spark, sf_dir):
    folder = _scratch(spark) + "/outcomes"
    rows = _outcomes(spark, sf_dir)
    for depth in (F.col("depth") == 200, F.col("depth") != 200):
        rows.filter(depth).write.mode("append").parquet(folder)
    stream = S.stream_pages(spark, folder, rows.schema, max_files_per_trigger=2)
    return S.stream_crawl_report(stream, _scratch(spark))


def q_crawl_documents(spark, sf_dir):
    pages = _aug(spark, sf_dir)
    result = crawl_documents(
        pages,
        seed_frontier(pages),
        max_depth=1,
        robots=_sql(spark, sf_dir, C.ROBOTS),
        agent="testbot",
        content_tags=TAGS,
        excluded_domains=C.EXCLUDED,
        ad_patterns=C.AD_PATTERNS,
    )
    return validate.crawl_report(outcomes(result))


def _linked(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Pages that link to one another, and seeds."""
    _aug(spark, sf_dir).createOrReplaceTempView("aug")
    spark.sql(C.SAME_HOST).createOrReplaceTempView("same_host")
    return _stamped(spark, C.CRAWL_PAGES), seed_frontier(spark.sql(C.CRAWL_SEEDS))


def q_crawl_linked_documents(spark, sf_dir):
    """Pages that link to one another, crawled to a depth, with the document columns."""
    pages, seeds = _linked(spark, sf_dir)
    robots_files = _sql(spark, sf_dir, C.ROBOTS)
    return _crawled(crawl_documents(pages, seeds, C.MAX_DEPTH, robots=robots_files, agent="testbot", content_tags=TAGS))


def _crawled(result) -> DataFrame:
    return result.documents.select(
        "url", "depth", "reject_reason", "hash_id", "title", "meta_description", "canonical_url", "language",
        "publication_timestamp", "crawled_at",
    )


# --- vectors -----------------------------------------------------------------------------------------------
def q_embed_dummy(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.posexplode(E.embed_dummy(F.col("text"), C.EMBED_DIM)).alias("i", "v"))
    return rows.select("doc_id", "i", F.round(F.col("v").cast("double"), 5).alias("v"))


def q_embed_with(spark, sf_dir):
    return _counted(_table(spark, sf_dir, "documents").select("doc_id", _counts()(F.col("text")).alias("v")))


def q_embed_once(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return _counted(embed_once(docs, _counts(), vector="v"))


def _counts() -> Callable:
    E.register_embedder("counts", count_model)
    return E.text_embedder("Counts", 3)


def _counted(docs: DataFrame) -> DataFrame:
    v = F.col("v")
    return docs.select(
        "doc_id",
        F.round(v[0].cast("double"), 4).alias("v0"),
        v[1].cast("double").alias("v1"),
        v[2].cast("double").alias("v2"),
    )


def _embeddings(spark, sf_dir):
    return _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")


COLUMNS = {"id_col": "vec_id", "vector_col": "embedding"}


def _knn(metric: str, **options) -> Callable:
    def query(spark, sf_dir):
        v = _embeddings(spark, sf_dir)
        found = vectors.knn(v, v, C.KNN_K, metric, **COLUMNS, **options)
        return found.withColumn("score", F.round("score", 6))

    return query


def q_knn_missing_vectors(spark, sf_dir):
    """Some vectors are null or empty, the first row's among them."""
    kind = F.col("vec_id") % 5
    some = F.when(kind > 1, F.col("embedding")).when(kind == 0, F.slice("embedding", 1, 0))
    v = _embeddings(spark, sf_dir).withColumn("embedding", some)
    return vectors.knn_l2(v, v, C.KNN_K, **COLUMNS).withColumn("score", F.round("score", 6))


def _ivf(spark, sf_dir, nlist=16):
    v = _embeddings(spark, sf_dir)
    model = vectors.ivf_train(v, nlist, vector_col="embedding")
    return v, model, vectors.ivf_assign(v, model, "embedding")


def q_ivf_assign(spark, sf_dir):
    """Each vector's list against the nearest centroid found by search."""
    _, model, assigned = _ivf(spark, sf_dir)
    centroids = vectors.centroid_table(spark, model)
    nearest = vectors.knn_l2(
        centroids, assigned.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), 1
    )
    both = assigned.join(nearest, F.col("vec_id") == F.col("query_id"))
    return both.select("vec_id", (F.col("list_id") == F.col("id")).alias("nearest"))


def q_knn_ivf(spark, sf_dir):
    v, model, assigned = _ivf(spark, sf_dir)
    found = vectors.knn_ivf(assigned, v, model, C.KNN_K, nprobe=16, **COLUMNS)
    return found.withColumn("score", F.round("score", 6))


def _given_centroids(spark, sf_dir) -> tuple[DataFrame, list]:
    """Vectors, and the first of them as centroids of lists."""
    v = _embeddings(spark, sf_dir)
    first = v.filter(F.col("vec_id") < C.LISTS).orderBy("vec_id").collect()  # one row per list
    return v, [r["embedding"] for r in first]


def q_ivf_assign_given(spark, sf_dir):
    v, given = _given_centroids(spark, sf_dir)
    return vectors.ivf_assign(v, given, "embedding").select("vec_id", "list_id")


def q_ivf_list_table(spark, sf_dir):
    v, given = _given_centroids(spark, sf_dir)
    lists = vectors.list_table(vectors.ivf_assign(v, given, "embedding"), given, "embedding")
    return lists.select("list_id", F.round("radius", 6).alias("radius"), "n")


def _probing(metric: str, search: Callable, **options) -> Callable:
    def query(spark, sf_dir):
        v, given = _given_centroids(spark, sf_dir)
        found = search(vectors.ivf_assign(v, given, "embedding"), v, given, C.KNN_K, 2, metric, **COLUMNS, **options)
        return found.select("query_id", "id", F.round("score", 6).alias("score"), "rank")

    return query


# --- streaming ---------------------------------------------------------------------------------------------
def _captured(spark, sf_dir, copies: int = 1) -> tuple[str, object]:
    """The augmented pages written ``copies`` times as files for a stream to pick up."""
    folder = _scratch(spark) + "/captured"
    pages = _aug(spark, sf_dir)
    for _ in range(copies):
        pages.write.mode("append").parquet(folder)
    return folder, pages.schema


def _stream(spark, sf_dir, copies: int = 1) -> DataFrame:
    folder, schema = _captured(spark, sf_dir, copies)
    return S.stream_pages(spark, folder, schema)


def q_stream_documents(spark, sf_dir):
    out = _scratch(spark)
    stream = S.stream_documents(_stream(spark, sf_dir).drop("status"), TAGS)
    S.run_available(stream, out + "/documents", out + "/progress")
    return _doc_columns(spark.read.parquet(out + "/documents"))


def _stream_urls(delay: str | None) -> Callable:
    def query(spark, sf_dir):
        out = _scratch(spark)
        S.run_available(S.stream_dedup_urls(_stream(spark, sf_dir, 2), delay).select("url"), out + "/urls", out + "/progress")
        return spark.read.parquet(out + "/urls")

    return query


def _arrivals(spark, parts: list[DataFrame]) -> DataFrame:
    """A stream that brings the parts one after the other, a batch each. Every part is written by all cores, as one file
    per core; where some part has too few rows for that, every part is one file."""
    schema = parts[0].schema
    for files in (spark.sparkContext.defaultParallelism, 1):
        folder = _scratch(spark) + "/captured"
        for part in parts:
            dealt = part.repartition(files) if files > 1 else part.coalesce(1)
            dealt.write.mode("append").parquet(folder)
        # no part has more files than that
        if len(spark.read.schema(schema).parquet(folder).inputFiles()) == files * len(parts):
            break
    return S.stream_pages(spark, folder, schema, max_files_per_trigger=files)


def _stored(spark, sf_dir):
    """Half of the pages, then all again under other URLs, then the other half."""
    first = _aug(spark, sf_dir)
    again = _stamped(spark, C.AUGMENTED.replace("from pages", f"from ({C.RECAPTURED}) r"))
    stream = _arrivals(spark, [first.filter("page_id % 3 = 0"), again, first.filter("page_id % 3 > 0")])
    return stream_store_documents(stream, _scratch(spark), TAGS, limits=C.LIMITS)


def q_stream_store_documents(spark, sf_dir):
    return _doc_columns(_stored(spark, sf_dir)[0])


def q_stream_rejects(spark, sf_dir):
    return _stored(spark, sf_dir)[1]


def q_stream_store_gated(spark, sf_dir):
    """Behind robots rules and the visited test: pages captured again with other content do not count."""
    first = _aug(spark, sf_dir)
    again = _stamped(spark, C.AUGMENTED.replace("from pages", f"from ({C.CHANGED}) r"))
    stream = _arrivals(spark, [first.filter("page_id % 2 = 0"), again.filter("page_id % 2 = 0"), first.filter("page_id % 2 > 0")])
    documents, _ = stream_store_documents(stream, _scratch(spark), TAGS, robots=_rules(spark, sf_dir), visited=True)
    return _doc_columns(documents)


def q_stream_late_urls(spark, sf_dir):
    """Two thirds of the pages, then the other third with repeats, then all again: what passes the bounded visited
    test, and what first came too late for it."""
    pages = _aug(spark, sf_dir)
    stream = _arrivals(spark, [pages.filter("page_id % 3 > 0"), pages.filter("page_id % 3 < 2"), pages])
    passed, late = S.stream_late_urls(stream, _scratch(spark), f"{C.DELAY_S} seconds")
    outcome = lambda rows, name: rows.select("url", F.lit(name).alias("outcome"))
    return outcome(passed, "passed").unionByName(outcome(late, "late"))


def q_stream_crawl(spark, sf_dir):
    """Linked pages that arrive in three batches, crawled to a depth as they come."""
    pages, seeds = _linked(spark, sf_dir)
    stream = _arrivals(spark, [pages.filter(f"page_id % 3 = {k}") for k in (2, 0, 1)])
    result = stream_crawl(stream, seeds, _scratch(spark), C.MAX_DEPTH, robots=_rules(spark, sf_dir), content_tags=TAGS)
    return _crawled(result)


# --- contract ----------------------------------------------------------------------------------------------
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "read_pages": q_read_pages,
    "ok_responses": q_ok_responses,
    "seed_frontier": q_seed_frontier,
    "write_documents": q_write_documents,
    "write_documents_once": q_write_documents_once,
    "write_document_vectors": q_write_document_vectors,
    "html_nodes": q_html_nodes,
    "select_nodes": q_select_nodes,
    "extract_title": _extracted("title", X.extract_title),
    "extract_meta_description": _extracted("meta_description", X.extract_meta_description),
    "extract_canonical_url": q_extract_canonical_url,
    "extract_language": _extracted("language", X.extract_language),
    "extract_publication_ts": q_extract_publication_ts,
    "extract_headings": _extracted("headings_text", X.extract_headings),
    "main_content_tags": _content(TAGS),
    "main_content_fallback": _content([]),
    "main_content_deep": q_main_content_deep,
    "clean_text": q_clean_text,
    "content_hash": q_content_hash,
    "to_documents": q_to_documents,
    "extract_links": q_extract_links,
    "url_parts": q_url_parts,
    "resolve_url": q_resolve_url,
    "same_host": q_same_host,
    "not_excluded_domain": q_not_excluded_domain,
    "not_excluded_domain_table": q_not_excluded_domain_table,
    "not_ad_link": q_not_ad_link,
    "not_ad_link_table": q_not_ad_link_table,
    "dedup_documents": q_dedup_documents,
    "dedup_page_documents": q_dedup_page_documents,
    "duplicate_groups": q_duplicate_groups,
    "duplicate_members": q_duplicate_members,
    "expand_frontier": _round,
    "crawl": _crawl,
    "crawl_backlog": q_crawl_backlog,
    "frontier_limit": q_frontier_limit,
    "fetch_plan": q_fetch_plan,
    "robots_rules": q_robots_rules,
    "robots_allowed": q_robots_allowed,
    "robots_allowed_index": q_robots_allowed_index,
    "route_rejects": q_route_rejects,
    "check_lengths": q_check_lengths,
    "check_vector": q_check_vector,
    "fill_zero_vector": q_fill_zero_vector,
    "crawl_report": q_crawl_report,
    "crawl_report_observed": q_crawl_report_observed,
    "stream_crawl_report": q_stream_crawl_report,
    "crawl_documents": q_crawl_documents,
    "crawl_linked_documents": q_crawl_linked_documents,
    "embed_dummy": q_embed_dummy,
    "embed_with": q_embed_with,
    "embed_once": q_embed_once,
    "knn_l2": _knn("L2"),
    "knn_ip": _knn("IP"),
    "knn_l2_blocks": _knn("L2", max_bytes=0, vector_block=500, query_block=200),
    "knn_missing_vectors": q_knn_missing_vectors,
    "ivf_assign": q_ivf_assign,
    "knn_ivf": q_knn_ivf,
    "ivf_assign_given": q_ivf_assign_given,
    "ivf_list_table": q_ivf_list_table,
    "knn_ivf_probe2": _probing("L2", vectors.knn_ivf),
    "knn_ivf_bounded": _probing("L2", vectors.knn_ivf_bounded),
    "knn_ivf_bounded_ip": _probing("IP", vectors.knn_ivf_bounded),
    "stream_documents": q_stream_documents,
    "stream_dedup_urls": _stream_urls(None),
    "stream_dedup_urls_watermark": _stream_urls("1 hour"),
    "stream_store_documents": q_stream_store_documents,
    "stream_rejects": q_stream_rejects,
    "stream_store_gated": q_stream_store_gated,
    "stream_late_urls": q_stream_late_urls,
    "stream_crawl": q_stream_crawl,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One query per operator; each takes (spark, sf_dir)."""

    def shipped(query: Callable) -> Callable:
        return lambda spark, sf_dir: query(ship_package(spark), sf_dir)

    every = dict(_QUERIES)
    if llm_queries is not None:
        every |= llm_queries.QUERIES | {"pipeline": corpus_pipeline.run}
    return {name: shipped(query) for name, query in every.items()}


def oracle_sql() -> dict[str, str]:
    """The SQL of every query that SQL can express."""
    every = dict(oracle.oracle_sql())
    if llm_queries is not None:
        every |= llm_queries.ORACLE_SQL
        if corpus_pipeline.ORACLE_SQL is not None:
            every["pipeline"] = corpus_pipeline.ORACLE_SQL
    return every


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: captured pages to document rows."""
    ship_package(spark)
    pages = _pages(spark, "/root/testdata/sf0.001")
    docs = to_documents(pages, TAGS)
    return docs.select("hash_id", "url", "title", "language", "main_content")
