"""Exact top-k search: tiles of queries by rows are matrix products, each tile keeps the best of every query, and the
lists of a query are merged in a tree over the shards.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import ordered_rank, saved

TILE_VALUES = 1 << 22  # numbers of one side of a tile at most
LEAST_ROWS = 1024  # of a shard
FAN_IN = 16  # lists of a query merged at once
STEP_QUERIES = 256  # of a tile scored at once
RESULT = "query_id long, vec_id long, score {score}"


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    fits = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & fits, F.lit(False))


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, vector`` of the rows that can take part: id there, vector there, all components finite. Other columns
    are not read."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    return rows.filter(F.col("vec_id").isNotNull() & finite(F.col("vector")))


def each_row(rows: DataFrame, asked: str, search: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """``search(queries, rows)`` over ``rows`` (``vec_id, vector``), the queries being those with the condition ``asked``,
    where an id may be on several rows: each is a query and a candidate of its own.

    Where ids repeat, the search runs on row numbers in the order of the ids, so its ties go the same way, and the ids are
    put back into its lists.
    """
    rows = saved(rows.withColumn("asked", F.expr(asked)))
    sides = lambda r: (r.filter("asked").select("vec_id", "vector"), r.select("vec_id", "vector"))
    if rows.groupBy("vec_id").count().filter("count > 1").isEmpty():
        return search(*sides(rows))
    ranked = ordered_rank(rows.withColumn("_row", F.monotonically_increasing_id()), [F.col("vec_id"), F.col("_row")], "number")
    ranked = saved(ranked.drop("_row"))
    found = search(*sides(ranked.withColumn("vec_id", F.col("number"))))
    name = lambda column: ranked.select(F.col("number").alias(column), F.col("vec_id").alias(f"_{column}"))
    named = found.join(name("query_id"), "query_id").join(name("vec_id"), "vec_id")
    return named.select(F.col("_query_id").alias("query_id"), "rank", F.col("_vec_id").alias("vec_id"), "score")


def matrix(column):
    """Rows of an Arrow list column, all of one length, as a matrix."""
    import numpy as np

    if hasattr(column, "combine_chunks"):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(flat) else np.zeros((len(column), 0), flat.dtype)


LONG = 1 << 63


def fits_long(vector: Column, scale: float = 256.0) -> Column:
    """Whether ``scale`` times every component lies inside the whole numbers of 64 bits; floor would cut others off."""
    return F.forall(vector, lambda x: F.abs(x.cast("double")) * F.lit(scale) < F.lit(2.0**63))


def _integer_scores(a, b):
    """Exact inner products of integer rows: by floating point where no sum can reach 2**53, else by Python's integers,
    which may be larger than a long."""
    import numpy as np

    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    largest = [max(abs(int(side.max())), abs(int(side.min()))) for side in (a, b)]
    if largest[0] * largest[1] * a.shape[1] < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(object) @ b.astype(object).T


def best_of_row(scores, ids, own: int, k: int, slack: float = 0.0):
    """Places of the k best scores of one query, and those within ``slack`` of the last; ids must ascend, so equal
    scores come with the smaller id first. The query's own id is left out."""
    import numpy as np

    others = np.flatnonzero(ids != own)
    scores = scores[others]
    if scores.dtype == object:  # of those that fit no long there is nothing to return
        fits = (scores < LONG) & (scores >= -LONG)
        others, scores = others[fits.astype(bool)], scores[fits.astype(bool)].astype(np.int64)
    if len(scores) > k:
        last = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= last - slack) if slack else np.flatnonzero(scores >= last)
        others, scores = others[near], scores[near]
    order = np.lexsort((np.arange(len(scores)), ~scores if scores.dtype == np.int64 else -scores))
    return others[order] if slack else others[order[:k]]


def _tile(k: int):
    """Arrow function over one tile: the k best rows for each of its queries."""

    def search(table):
        import numpy as np
        import pyarrow as pa

        query = table.column("is_query").to_numpy(zero_copy_only=False).astype(bool)
        ids = table.column("vec_id").to_numpy()
        out: list[tuple] = []
        if query.any() and not query.all():
            vectors = matrix(table.column("vector"))
            rows = np.flatnonzero(~query)
            rows = rows[np.argsort(ids[rows], kind="stable")]
            row_ids, row_vectors = ids[rows], vectors[rows]
            every = np.flatnonzero(query)
            for start in range(0, len(every), STEP_QUERIES):
                part = every[start : start + STEP_QUERIES]
                scores = _integer_scores(vectors[part], row_vectors)
                for place, at in enumerate(part):
                    best = best_of_row(scores[place], row_ids, ids[at], k)
                    out += [(ids[at], row_ids[b], scores[place, b]) for b in best]
        shard = table.column("shard")[0].as_py()
        columns = [np.array([row[c] for row in out], np.int64) for c in range(3)]
        return pa.table(
            {"query_id": columns[0], "vec_id": columns[1], "score": columns[2], "shard": np.full(len(out), shard, np.int64)}
        )

    return search


def best_rows(lists: DataFrame, by: list, k: int) -> DataFrame:
    """The k best rows per group: highest score, ties to the smaller id; ``rank`` from 1."""
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("vec_id"))
    return lists.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def merge_lists(lists: DataFrame, shards: int, k: int) -> DataFrame:
    """Merge per-shard lists of every query (``query_id, vec_id, score, shard``) in a tree of ``FAN_IN``."""
    while shards > 1:
        shards = -(-shards // FAN_IN)
        lists = lists.withColumn("shard", F.floor(F.col("shard") / FAN_IN))
        if shards > 1:
            lists = best_rows(lists, ["query_id", "shard"], k).drop("rank")
    return best_rows(lists, ["query_id"], k)


def exact_top_k(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """The ``k`` rows with the largest integer inner product for each query: ``query_id, rank, vec_id, score``.

    Both sides have ``vec_id`` (unique) and ``vector``, an array of integers. A query is never its own result; ties go
    to the smaller id; a query with fewer candidates gets them all. Vectors of another length than the query's are no
    candidates; a pair whose score fits no long is left out. Shards and query blocks are dealt by a hash of the id, so a tile's size is bounded and no key is hot.
    """
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("d")).first()
    if not size["n"]:
        size = {"n": 1, "d": 1}
    most = max(1, TILE_VALUES // max(1, size["d"]))
    cores = max(1, rows.sparkSession.sparkContext.defaultParallelism)
    shards = -(-size["n"] // min(most, max(LEAST_ROWS, size["n"] // (2 * cores))))
    blocks = max(1, -(-queries.count() // most))
    dealt = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    columns = ["vec_id", "vector", F.size("vector").alias("width")]
    asked = queries.select(*columns, dealt(blocks, 1).alias("block"), every(shards).alias("shard"), F.lit(True).alias("is_query"))
    kept = rows.select(*columns, dealt(shards, 2).alias("shard"), every(blocks).alias("block"), F.lit(False).alias("is_query"))
    tiles = asked.unionByName(kept).groupBy("width", "block", "shard")
    lists = tiles.applyInArrow(_tile(k), RESULT.format(score="long") + ", shard long")
    return merge_lists(lists, shards, k).select("query_id", "rank", "vec_id", "score")


def scaled_floor(vector: Column, scale: float = 256.0) -> Column:
    """Components turned into whole numbers: floor of ``scale`` times the component as a double (see `fits_long`)."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("long"))
