"""Nearest neighbours: exact search and inverted lists.

Both searches run the same kernel. Vectors and queries carry a ``cell``; a query is compared with the vectors of
its cell only. Exact search has a single cell; inverted lists have one per list, and a query is repeated for
every list it probes.

* Queries that measure small are broadcast: each task streams its vectors once and keeps the best ``k`` per query,
  so vectors are never shuffled and a full list costs no more than any other.
* Otherwise each cell is cut into strips of blocks on both sides, and each pair of strips is one group, compared block
  by block. The number of strips follows the cores and the memory of a task, not the blocks, so rows are repeated for
  as many groups when there are more of them, until a strip would not fit its bytes.

Either way a task emits at most ``k`` rows per query it saw, never a pair list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.operators.joins import broadcast_checked, measured_bytes, reliable_checkpoint

# Queries to broadcast. Every task answers all of them with up to k rows each, so this also bounds what is
# shuffled after the scan; it is far below what an executor could hold.
QUERY_BYTES = 8 << 20
STRIP_BYTES = 64 << 20  # of one side of a task, in double precision; one block at least
TILES_PER_CORE = 4  # tasks that block pairs are gathered in
VECTOR_BLOCK, QUERY_BLOCK = 8192, 256  # rows compared at once, unless the caller says
SLACK = 1e-9  # of bounds in double precision
SCORE_CELLS = 4_000_000  # entries of one score matrix inside a task


def index_settings(index_type: str = "IVF_FLAT", metric_type: str = "L2") -> tuple[str, str]:
    """(index, metric) in effect: IP or else L2; an unknown index type falls back to IVF_FLAT with L2. HNSW is
    answered by exact search."""
    metric = "IP" if metric_type.upper() == "IP" else "L2"
    index = index_type.upper()
    return (index, metric) if index in ("IVF_FLAT", "HNSW") else ("IVF_FLAT", "L2")


def _scores(vectors: np.ndarray, query: np.ndarray, metric: str) -> np.ndarray:
    """Exact scores in double, smaller is better. Row-wise, so equal vectors always score equal."""
    if metric == "L2":
        diff = vectors - query
        return (diff * diff).sum(axis=1)
    return -(vectors * query).sum(axis=1)


def _best(ids: np.ndarray, vectors: np.ndarray, queries: np.ndarray, k: int, metric: str) -> Iterator[tuple]:
    """(query index, ids, scores) of the best k of one batch. A matrix product narrows the candidates; its
    rounding error is far below the slack, and the survivors are scored exactly."""
    vv = (vectors * vectors).sum(axis=1)
    qq = (queries * queries).sum(axis=1)
    slack = 1e-9 * (1 + qq + vv.max())
    step = max(1, SCORE_CELLS // len(vectors))
    for start in range(0, len(queries), step):
        rough = -(queries[start : start + step] @ vectors.T)
        if metric == "L2":
            rough = vv + 2 * rough
        for j, row in enumerate(rough, start):
            if len(row) > k:
                keep = np.flatnonzero(row <= np.partition(row, k - 1)[k - 1] + slack[j])
            else:
                keep = np.arange(len(row))
            score = _scores(vectors[keep], queries[j], metric)
            order = np.lexsort((ids[keep], score))[:k]
            yield j, ids[keep][order], score[order]


class _TopK:
    """Best k per query over the batches of one task."""

    def __init__(self, k: int):
        self.k, self.rows = k, {}

    def add(self, query, ids: np.ndarray, scores: np.ndarray) -> None:
        if query in self.rows:
            old_ids, old_scores = self.rows[query]
            ids, scores = np.concatenate([old_ids, ids]), np.concatenate([old_scores, scores])
            order = np.lexsort((ids, scores))[: self.k]
            ids, scores = ids[order], scores[order]
        self.rows[query] = (ids, scores)

    def frame(self, names: list[str]) -> pd.DataFrame:
        if not self.rows:
            return pd.DataFrame({n: [] for n in names})
        ids, scores = zip(*self.rows.values())
        query = np.repeat(list(self.rows), [len(i) for i in ids])
        return pd.DataFrame(dict(zip(names, (query, np.concatenate(ids), np.concatenate(scores)))))


def _matrix(column, dim: int) -> np.ndarray:
    if isinstance(column, pa.Array):
        flat = column.flatten().to_numpy(zero_copy_only=False)
    else:
        flat = np.concatenate(column.to_list()) if len(column) else np.empty(0)
    return flat.astype(np.float64).reshape(-1, dim)


def _by_cell(cells: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(cells, kind="stable")
    values, starts = np.unique(cells[order], return_index=True)
    for cell, rows in zip(values.tolist(), np.split(order, starts[1:])):
        yield cell, rows


def _search_broadcast(
    vectors: DataFrame, queries: DataFrame, probes: DataFrame | None, k: int, metric: str, dim: int, schema
) -> DataFrame:
    local = queries.toArrow()  # measured by the caller, like the probes
    q_ids = local["query_id"].to_numpy()
    q_matrix = _matrix(local["query_vector"].combine_chunks(), dim) if local.num_rows else np.empty((0, dim))
    if probes is None:
        rows_of = {0: np.arange(len(q_ids))}
    else:
        pairs = probes.toArrow()
        at = pd.Series(np.arange(len(q_ids)), index=q_ids)
        rows = at.loc[pairs["query_id"].to_numpy()].to_numpy()
        rows_of = {cell: rows[which] for cell, which in _by_cell(pairs["cell"].to_numpy())}
    shared = vectors.sparkSession.sparkContext.broadcast((q_ids, q_matrix, rows_of))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = _TopK(k)
        q_ids, q_matrix, rows_of = shared.value
        for batch in batches:
            if not batch.num_rows or not len(q_ids):  # no queries: vectors may have any size
                continue
            ids = batch["id"].to_numpy(zero_copy_only=False)
            matrix = _matrix(batch["vector"], dim)
            for cell, rows in _by_cell(batch["cell"].to_numpy(zero_copy_only=False)):
                asking = rows_of.get(cell)
                if asking is not None and len(asking):
                    for j, best, score in _best(ids[rows], matrix[rows], q_matrix[asking], k, metric):
                        top.add(q_ids[asking[j]], best, score)
        frame = top.frame([f.name for f in schema])
        yield pa.RecordBatch.from_pandas(frame, schema=_arrow(schema), preserve_index=False)

    return vectors.select("cell", "id", "vector").mapInArrow(scan, schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _grid(vectors: DataFrame, queries: DataFrame, dim: int, vector_block: int, query_block: int) -> DataFrame:
    """``cell, v_strips, q_strips``, one row per cell that has both sides: a strip is some blocks that share a task.

    A row is repeated once per strip of the other side. All cells together are cut into about ``TILES_PER_CORE`` tiles
    a core, by their shares of the scores, however many rows there are; only strips over ``STRIP_BYTES`` are cut further.
    """
    tiles = TILES_PER_CORE * max(1, vectors.sparkSession.sparkContext.defaultParallelism)
    most = max(1, STRIP_BYTES // (8 * dim))  # rows of a strip, unless one block has more

    def counted(df: DataFrame, side: str, block: int) -> DataFrame:
        counts = df.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
        blocks, least = F.ceil(F.col("n") / block), F.ceil(F.col("n") / max(most, block))
        return counts.select("cell", F.col("n").alias(side), blocks.alias(f"{side}_blocks"), least.alias(f"{side}_least"))

    both = counted(vectors, "v", vector_block).join(counted(queries, "q", query_block), "cell")
    both = reliable_checkpoint(both)  # one row per cell
    scores = both.agg(F.sum(F.col("v").cast("double") * F.col("q"))).first()[0] or 1.0
    share = F.ceil(F.lit(float(tiles)) * F.col("v") * F.col("q") / scores)
    queried = F.least("q_blocks", F.ceil(F.sqrt(share)))
    v_strips = F.greatest("v_least", F.least("v_blocks", F.ceil(share / queried)))
    q_strips = F.greatest("q_least", F.least("q_blocks", F.ceil(share / v_strips)))
    return both.select("cell", v_strips.cast("int").alias("v_strips"), q_strips.cast("int").alias("q_strips"))


def _ranks(ids: pa.Array) -> np.ndarray:
    """Place of every id in their order, equal for equal ids; null is last."""
    order = pc.sort_indices(ids, null_placement="at_end").to_numpy()
    follows = np.zeros(len(ids), np.int64)
    if len(ids) > 1:
        there = ids.take(pa.array(order))
        follows[1:] = pc.fill_null(pc.not_equal(there[1:], there[:-1]), True).to_numpy(zero_copy_only=False)
    ranks = np.empty(len(ids), np.int64)
    ranks[order] = np.cumsum(follows)
    return ranks


def _best_of_strip(
    ranks: np.ndarray, vectors: np.ndarray, queries: np.ndarray, k: int, metric: str, step: int
) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the best k of a strip for each query, -1 where there are fewer; ``step`` vectors at a time.
    A matrix product finds the vectors that may be better than the k-th so far; these are scored exactly."""
    places, scores = np.full((len(queries), k), -1, np.int64), np.full((len(queries), k), np.inf)
    with np.errstate(all="ignore"):  # components that are no numbers, or too large
        vv, qq = (vectors * vectors).sum(axis=1), (queries * queries).sum(axis=1)
        slack = 1e-9 * (1 + qq + max(vv[np.isfinite(vv)], default=0.0))
        offset = qq if metric == "L2" else np.zeros(len(queries))
        turned = queries * (-2.0 if metric == "L2" else -1.0)
        for start in range(0, len(vectors), step):
            part = vectors[start : start + step]
            rough = turned @ part.T
            if metric == "L2":
                rough += vv[start : start + step]
            worst = np.where(places[:, -1] >= 0, scores[:, -1], np.inf) - offset
            few = np.flatnonzero(places[:, -1] < 0)
            if len(few) and len(part) > k:
                worst[few] = np.partition(rough[few], k - 1, axis=1)[:, k - 1]
            # negated, so that a score that is no number is looked at
            query, vector = np.nonzero(~(rough > (worst + slack)[:, None]))
            if not len(query):
                continue
            vector += start
            exact, at_once = np.empty(len(query)), max(1, SCORE_CELLS // vectors.shape[1])
            for first in range(0, len(query), at_once):
                these = slice(first, first + at_once)
                diff = vectors[vector[these]] - queries[query[these]] if metric == "L2" else None
                exact[these] = (
                    (diff * diff).sum(axis=1) if metric == "L2" else -(vectors[vector[these]] * queries[query[these]]).sum(axis=1)
                )
            asked = np.unique(query)
            query = np.concatenate([np.repeat(asked, k), query])
            vector = np.concatenate([places[asked].reshape(-1), vector])
            exact = np.concatenate([scores[asked].reshape(-1), exact])
            order = np.lexsort((ranks[vector], exact, vector < 0, query))
            query, vector, exact = query[order], vector[order], exact[order]
            place = np.arange(len(query)) - np.searchsorted(query, query)
            kept = place < k
            places[query[kept], place[kept]], scores[query[kept], place[kept]] = vector[kept], exact[kept]
    return places, scores


def _search_blocks(
    vectors: DataFrame, queries: DataFrame, k: int, metric: str, dim: int, schema, vector_block: int, query_block: int
) -> DataFrame:
    grid = F.broadcast(_grid(vectors, queries, dim, vector_block, query_block))
    v = (
        vectors.join(grid, "cell")
        .withColumn("v_strip", F.pmod(F.xxhash64("id"), F.col("v_strips")).cast("int"))
        .withColumn("q_strip", F.explode(F.sequence(F.lit(0), F.col("q_strips") - 1)))
        .select("cell", "v_strip", "q_strip", "id", "vector")
    )
    q = (
        queries.join(grid, "cell")
        .withColumn("q_strip", F.pmod(F.xxhash64("query_id"), F.col("q_strips")).cast("int"))
        .withColumn("v_strip", F.explode(F.sequence(F.lit(0), F.col("v_strips") - 1)))
        .select("cell", "v_strip", "q_strip", "query_id", "query_vector")
    )
    result = _arrow(schema)

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        asked, found, scored = [], [], []
        if left.num_rows and right.num_rows:
            matrix, ranks = _matrix(left["vector"].combine_chunks(), dim), _ranks(left["id"].combine_chunks())
            asking = right["query_vector"].combine_chunks()
            step = min(vector_block, len(matrix))
            at_once = max(1, min(query_block, SCORE_CELLS // step))
            for start in range(0, right.num_rows, at_once):
                block = _matrix(asking[start : start + at_once], dim)
                places, scores = _best_of_strip(ranks, matrix, block, k, metric, step)
                there = places >= 0
                asked.append(start + np.nonzero(there)[0])
                found.append(places[there])
                scored.append(scores[there])
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        ids = [right["query_id"].take(pa.array(join(asked, np.int64))), left["id"].take(pa.array(join(found, np.int64)))]
        return pa.table([*ids, pa.array(join(scored, np.float64))], names=result.names).cast(result)

    keys = ["cell", "v_strip", "q_strip"]
    return v.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInArrow(tile, schema)


def _search(
    vectors: DataFrame,
    queries: DataFrame,
    probes: DataFrame | None,
    k: int,
    metric: str,
    max_bytes: int,
    vector_block: int | None,
    query_block: int | None,
) -> DataFrame:
    sizes = queries.agg(F.min(F.size("query_vector")), F.max(F.size("query_vector"))).first()
    if sizes[0] != sizes[1]:
        raise ValueError(f"query vectors differ in size: {sizes[0]} to {sizes[1]}")
    dim = sizes[0] or 1
    schema = T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("id", vectors.schema["id"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )
    wrong = F.raise_error(F.concat(F.lit(f"vector size is not {dim}: "), F.size("vector").cast("string")))
    same = F.lit(sizes[0] is None) | (F.size("vector") == dim)  # without queries nothing is compared
    vectors = vectors.withColumn("vector", F.when(same, F.col("vector")).otherwise(wrong))
    size = measured_bytes(queries) + (measured_bytes(probes) if probes is not None else 0)
    if size <= max_bytes:
        partial = _search_broadcast(vectors, queries, probes, k, metric, dim, schema)
    else:
        if probes is None:
            asking = queries.select(F.lit(0).alias("cell"), "query_id", "query_vector")
        else:
            asking = queries.join(probes, "query_id").select("cell", "query_id", "query_vector")
        fits = max(1, STRIP_BYTES // (8 * dim))
        block, asked = vector_block or min(VECTOR_BLOCK, fits), query_block or min(QUERY_BLOCK, fits)
        partial = _search_blocks(vectors, asking, k, metric, dim, schema, block, asked)
    w = Window.partitionBy("query_id").orderBy("score", "id")
    ranked = partial.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    score = F.col("score") if metric == "L2" else -F.col("score")
    return ranked.select("query_id", "id", score.alias("score"), "rank")


def _prepared(df: DataFrame, id_col: str, vector_col: str, names: tuple[str, str]) -> DataFrame:
    return df.select(F.col(id_col).alias(names[0]), F.col(vector_col).alias(names[1])).filter(
        F.size(names[1]) > 0
    )


def knn(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    metric: str = "L2",
    id_col: str = "id",
    vector_col: str = "vector",
    max_bytes: int = QUERY_BYTES,
    vector_block: int | None = None,
    query_block: int | None = None,
) -> DataFrame:
    """Exact ``k`` nearest vectors of every query: ``query_id, id, score, rank``. Score is the squared distance
    (L2, ascending) or the inner product (IP, descending); ties go to the smaller id. Both tables use
    ``id_col`` and ``vector_col``; ids are unique. A null or empty vector is none: it takes no part on either side. All
    others must have one size, or the search fails."""
    v = _prepared(vectors, id_col, vector_col, ("id", "vector")).select(F.lit(0).alias("cell"), "*")
    q = _prepared(queries, id_col, vector_col, ("query_id", "query_vector"))
    return _search(v, q, None, k, metric.upper(), max_bytes, vector_block, query_block)


def knn_l2(vectors: DataFrame, queries: DataFrame, k: int, **options) -> DataFrame:
    return knn(vectors, queries, k, "L2", **options)


def knn_ip(vectors: DataFrame, queries: DataFrame, k: int, **options) -> DataFrame:
    return knn(vectors, queries, k, "IP", **options)


# --- inverted lists -------------------------------------------------------------------------------------------
def ivf_train(vectors: DataFrame, nlist: int, seed: int = 42, vector_col: str = "vector", max_iter: int = 20):
    """K-means centroids of ``nlist`` lists; null and empty vectors take no part."""
    data = vectors.filter(F.size(vector_col) > 0).select(array_to_vector(F.col(vector_col)).alias("features"))
    return KMeans(k=nlist, seed=seed, maxIter=max_iter).fit(data)


def centres(model) -> list:
    """Centroids of a model of `ivf_train`, or those given as a list of vectors."""
    return list(model.clusterCenters() if hasattr(model, "clusterCenters") else model)


def ivf_assign(vectors: DataFrame, model, vector_col: str = "vector") -> DataFrame:
    """Adds ``list_id``, the list with the nearest centroid (ties: the first); null for a null or empty vector. Map-only.
    ``model`` comes from `ivf_train`, or is a list of centroids, of which list ``n`` has the n-th."""
    there = F.size(vector_col) > 0
    if not hasattr(model, "clusterCenters"):
        nearest = _nearest_of(np.array(model, np.float64))
        return vectors.withColumn("list_id", F.when(there, nearest(F.col(vector_col).cast("array<double>"))))
    zero = F.array_repeat(F.lit(0.0), len(model.clusterCenters()[0]))
    vector = F.when(there, F.col(vector_col).cast("array<double>")).otherwise(zero)
    tagged = vectors.withColumn("_features", array_to_vector(vector))
    assigned = model.copy().setFeaturesCol("_features").setPredictionCol("list_id").transform(tagged)
    return assigned.withColumn("list_id", F.when(there, F.col("list_id"))).drop("_features")


def _nearest_of(centroids: np.ndarray):
    """Arrow function: place of the nearest centroid; vectors of another size fail."""

    @F.pandas_udf("int")
    def nearest(vectors: pd.Series) -> pd.Series:
        out = np.full(len(vectors), -1, np.int32)
        there = np.flatnonzero(vectors.notna() & (vectors.str.len() > 0))
        step = max(1, SCORE_CELLS // len(centroids))
        for start in range(0, len(there), step):
            part = there[start : start + step]
            matrix = np.stack(vectors.iloc[part].to_list())
            if matrix.shape[1] != centroids.shape[1]:
                raise ValueError(f"vector size is not {centroids.shape[1]}: {matrix.shape[1]}")
            rough = (centroids * centroids).sum(axis=1) - 2 * (matrix @ centroids.T)
            slack = 1e-9 * (1 + (matrix * matrix).sum(axis=1) + (centroids * centroids).sum(axis=1).max())
            for row, at in enumerate(part):
                near = np.flatnonzero(rough[row] <= rough[row].min() + slack[row])
                out[at] = near[np.argmin(_scores(centroids[near], matrix[row], "L2"))]
        return pd.Series(out)

    return nearest


def centroid_table(spark, model) -> DataFrame:
    rows = [(n, [float(x) for x in c]) for n, c in enumerate(centres(model))]
    return spark.createDataFrame(rows, "id int, vector array<double>")


def list_table(assigned: DataFrame, model, vector_col: str = "vector") -> DataFrame:
    """``list_id, radius, n``: the largest distance of a member from its centroid, and the number of members. Empty lists
    have no row. Partial aggregation over the vectors; the centroids are as many as there are lists."""
    centroids = centroid_table(assigned.sparkSession, model).select(F.col("id").alias("list_id"), F.col("vector").alias("_c"))
    apart = F.zip_with(F.col(vector_col), "_c", lambda x, c: (x - c) * (x - c))
    distance = F.sqrt(F.aggregate(apart, F.lit(0.0), lambda s, x: s + x))
    members = assigned.filter(F.col("list_id").isNotNull()).select(F.col("list_id").cast("int"), vector_col)
    joined = members.join(broadcast_checked(centroids) or centroids, "list_id")
    return joined.groupBy("list_id").agg(F.max(distance).alias("radius"), F.count(F.lit(1)).alias("n"))


def knn_ivf(
    assigned: DataFrame,
    queries: DataFrame,
    model,
    k: int,
    nprobe: int,
    metric: str = "L2",
    id_col: str = "id",
    vector_col: str = "vector",
    max_bytes: int = QUERY_BYTES,
    vector_block: int | None = None,
    query_block: int | None = None,
) -> DataFrame:
    """Nearest vectors within the ``nprobe`` lists nearest to each query, scored exactly. With all lists probed
    this equals `knn`. ``assigned`` comes from `ivf_assign`."""
    spark = assigned.sparkSession
    q = _prepared(queries, id_col, vector_col, ("query_id", "query_vector"))
    probes = knn(
        centroid_table(spark, model),
        q.select(F.col("query_id").alias("id"), F.col("query_vector").alias("vector")),
        nprobe,
        metric,
        max_bytes=max_bytes,
        vector_block=vector_block,
        query_block=query_block,
    ).select("query_id", F.col("id").alias("cell"))
    probes = reliable_checkpoint(probes)  # read by the size check, the grid and the search
    v = assigned.filter(F.col("list_id").isNotNull()).select(
        F.col("list_id").cast("int").alias("cell"), F.col(id_col).alias("id"), F.col(vector_col).alias("vector")
    )
    return _search(v, q, probes, k, metric.upper(), max_bytes, vector_block, query_block)


def knn_ivf_bounded(
    assigned: DataFrame,
    queries: DataFrame,
    model,
    k: int,
    nprobe: int = 1,
    metric: str = "L2",
    id_col: str = "id",
    vector_col: str = "vector",
    lists: DataFrame | None = None,
    max_bytes: int = QUERY_BYTES,
    vector_block: int | None = None,
    query_block: int | None = None,
) -> DataFrame:
    """Exact nearest vectors from as few lists as bounds allow: the columns of `knn` and ``lists_probed``.

    The ``nprobe`` lists nearest to a query are searched first. No member of a list is nearer than the centroid's distance
    less the list's radius (nor has a larger inner product than the centroid's plus query norm times radius), so the
    other lists are searched only where that bound does not rule them out against the k-th result so far. ``lists`` is
    the table of `list_table`, computed when it is not given.
    """
    spark, metric = assigned.sparkSession, metric.upper()
    options = {"max_bytes": max_bytes, "vector_block": vector_block, "query_block": query_block}
    q = _prepared(queries, id_col, vector_col, ("query_id", "query_vector"))
    v = assigned.filter(F.col("list_id").isNotNull()).select(
        F.col("list_id").cast("int").alias("cell"), F.col(id_col).alias("id"), F.col(vector_col).alias("vector")
    )
    lists = reliable_checkpoint(list_table(assigned, model, vector_col) if lists is None else lists)
    names = q.select(F.col("query_id").alias("id"), F.col("query_vector").alias("vector"))
    apart = knn(centroid_table(spark, model), names, len(centres(model)), metric, **options)
    apart = apart.withColumnsRenamed({"id": "cell", "score": "_apart"}).drop("rank")
    apart = apart.join(lists.select(F.col("list_id").alias("cell"), "radius"), "cell")  # one row per query and list
    nearest = F.col("_apart") if metric == "L2" else -F.col("_apart")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(nearest, "cell"))
    apart = reliable_checkpoint(apart.withColumn("_place", place))

    first = apart.filter(F.col("_place") <= nprobe).select("query_id", "cell")
    found = reliable_checkpoint(_search(v, q, first, k, metric, **options).drop("rank"))
    worst = F.max("score") if metric == "L2" else F.min("score")
    reach = found.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, worst).alias("_reach"))
    norm = F.sqrt(F.aggregate("query_vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    left = apart.filter(F.col("_place") > nprobe).join(reach, "query_id", "left")
    left = left.join(q.select("query_id", norm.alias("_norm")), "query_id")
    if metric == "L2":
        bound = F.greatest(F.lit(0.0), F.sqrt("_apart") - F.col("radius"))
        possible = bound * bound * (1 - SLACK) <= F.col("_reach") + SLACK
    else:
        bound = F.col("_apart") + F.col("_norm") * F.col("radius")
        possible = bound + SLACK * (1 + F.abs(bound)) >= F.col("_reach")
    more = reliable_checkpoint(left.filter(F.col("_reach").isNull() | possible).select("query_id", "cell"))
    probed = first.unionByName(more).groupBy("query_id").agg(F.count(F.lit(1)).cast("int").alias("lists_probed"))
    if not more.isEmpty():
        found = found.unionByName(_search(v, q.join(more.select("query_id").distinct(), "query_id"), more, k, metric, **options).drop("rank"))
    order = F.col("score") if metric == "L2" else -F.col("score")
    w = Window.partitionBy("query_id").orderBy(order, "id")
    ranked = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.join(probed, "query_id")


def search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    index_type: str = "IVF_FLAT",
    metric_type: str = "L2",
    nlist: int = 128,
    nprobe: int = 8,
    id_col: str = "id",
    vector_col: str = "vector",
) -> DataFrame:
    """Search under the index and metric names of a collection's settings (see `index_settings`)."""
    index, metric = index_settings(index_type, metric_type)
    columns = {"id_col": id_col, "vector_col": vector_col}
    if index == "HNSW":
        return knn(vectors, queries, k, metric, **columns)
    model = ivf_train(vectors, nlist, vector_col=vector_col)
    return knn_ivf(ivf_assign(vectors, model, vector_col), queries, model, k, nprobe, metric, **columns)
