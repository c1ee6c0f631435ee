"""The queries of this package over the given tables, with production parameters."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.sql import ORACLE_SQL  # noqa: F401
from pagemill.llm import ann, chat, fingerprints, hard_negatives, language, licences, mixing, ngram_join, packing, pii, runs, topk, url_rules

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Place of a public tokenizer file; the same on all machines of a cluster."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = language.held_out(F.col("doc_id"))
    model = language.fit(docs.filter(~held_out))
    return language.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score"
    )


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.usable(table(spark, sf_dir, "embeddings"))
    return topk.each_row(rows, "vec_id % 20 = 0", lambda queries, rows: ann.nearest(rows, queries, 20))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.usable(table(spark, sf_dir, "embeddings")).filter(topk.fits_long(F.col("vector")))
    rows = rows.select("vec_id", topk.scaled_floor(F.col("vector")).alias("vector"))
    return topk.each_row(rows, "vec_id % 50 = 0", lambda queries, rows: topk.exact_top_k(queries, rows, 5))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = mixing.document_sizes(table(spark, sf_dir, "documents"))
    return mixing.mix(sizes).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan_licences(table(spark, sf_dir, "documents"))
    share = F.aggregate("spans", F.lit(0.0), lambda best, s: F.greatest(best, s["share"]))
    n_base = F.size("base_starts").cast("long")
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id",
        "n_words",
        n_base.alias("n_base"),
        F.array_min("base_starts").alias("first_word"),
        F.array_max("base_starts").alias("last_word"),
        joined("base_labels").alias("base_labels"),
        joined(F.concat("base_labels", F.transform("spans", lambda s: s["label"]))).alias("labels"),
        F.when(n_base > 0, F.lit(1.0)).otherwise(share).alias("score"),
    )


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.find_personal_data(docs, pii.accepted_patterns(docs))
    listed = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in pii.KINDS[: pii.BASE]],
        F.sha2(listed("base"), 256).alias("base_sha256"),
        listed("spans").alias("spans"),
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    rows = rows.filter(topk.finite(F.col("embedding")) & topk.fits_long(F.col("embedding")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select("vec_id", label.alias("label"), topk.scaled_floor(F.col("embedding")).alias("vector"))
    return hard_negatives.mine_hard_negatives(rows, "vec_id % 50 = 0")


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def repeated_end(doc_id: int | None, words: list[str]) -> list[str]:
    """The words of a document; in one of ten ids they repeat from some word on, as the contract of the query says."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    g = h // 10
    start = g % len(words)
    period = 1 + (len(words) - start) // (3 + g % 8)
    unit = words[start : start + period]
    return words[:start] + (unit * (len(words) // period + 1))[: len(words) - start]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.find_runs(table(spark, sf_dir, "documents"), prepare=repeated_end, whole=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_language_id": op2_language_id,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_nearest_neighbours": op4_nearest_neighbours,
    "op5_exact_top_k": op5_exact_top_k,
    "op6_source_mixing": op6_source_mixing,
    "op7_url_filter": op7_url_filter,
    "op8_license_scan": op8_license_scan,
    "op9_chat_format": op9_chat_format,
    "op10_personal_data": op10_personal_data,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_document_fingerprints": op12_document_fingerprints,
    "op13_periodic_runs": op13_periodic_runs,
}
