"""Table shapes."""

from pyspark.sql import types as T

PAGE_SCHEMA = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("html", T.StringType()),
        T.StructField("fetched_at", T.TimestampType()),
    ]
)

DOCUMENT_SCHEMA = T.StructType(
    [
        T.StructField("hash_id", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("html_source", T.StringType()),
        T.StructField("main_content", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("meta_description", T.StringType()),
        T.StructField("canonical_url", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("publication_timestamp", T.LongType()),
        T.StructField("headings_text", T.StringType()),
        T.StructField("crawled_at", T.LongType()),
        T.StructField("content_vector", T.ArrayType(T.FloatType())),
    ]
)

FRONTIER_SCHEMA = T.StructType(
    [T.StructField("url", T.StringType()), T.StructField("depth", T.IntegerType())]
)

EMBEDDING_DIMENSION = 768
