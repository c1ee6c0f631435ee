"""Approximate nearest neighbours by multiprobe p-stable hashing.

Every vector is hashed into one bucket per table: floors of ``functions`` random projections over a width. A query
visits, in every table, its own bucket and perturbed ones in the order of the estimated chance that a near vector is
there, judged by the distances to the borders of its cells. Candidates of all tables are merged and ranked by the exact
inner product.

The largest inner product becomes the smallest distance by one more component that brings every vector to the largest
norm; queries get 0 there and are scaled to that norm.

Cell width and number of buckets visited are measured on a bounded sample: of the settings that would find enough of
the sample's nearest pairs, the one that visits the fewest rows is taken. Every row is hashed with it.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import saved, slices
from pagemill.llm.topk import best_of_row, best_rows, matrix

TABLES = 4
FUNCTIONS = 6
WIDTHS = (0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8)  # of a cell, in units of the largest norm; wider ones where none of them serves
BUCKETS = 32  # of a table that a query visits at most, so that visits grow with the queries alone; wider cells where these do not serve
TARGET = 0.94  # share of the nearest pairs that the settings must find, beside two standard errors of the sample
SAMPLE_ROWS = 4_000  # rows the settings are measured on
SAMPLE_QUERIES = 400
SAMPLE_BYTES = 32 << 20  # of their components in double precision; fewer rows where vectors are long
GROUP_ROWS = 16_384  # hashed rows that share a task; larger buckets are cut
GROUP_QUERIES = 8_192  # queries of a task
SEED = 20_240_601


def _projections(tables: int, functions: int, dimension: int, seed: int):
    import numpy as np

    draw = np.random.default_rng((seed, dimension))
    return draw.standard_normal((dimension + 1, tables * functions)), draw.random(tables * functions)


def perturbations(functions: int):
    """All moves by -1, 0 or 1 in every function."""
    import numpy as np

    return np.array(list(product((-1, 0, 1), repeat=functions)), np.int64)


def probes(cells, inside, functions: int, count: int):
    """The ``count`` most promising cells of a table for each query: the sums of squared distances to the borders that
    a move crosses put them in order, the query's own cell first."""
    import numpy as np

    moves = perturbations(functions)
    up, down = (moves == 1).astype(float), (moves == -1).astype(float)
    cost = (1 - inside) ** 2 @ up.T + inside**2 @ down.T
    order = np.argsort(cost, axis=1, kind="stable")[:, :count]
    return cells[:, None, :] + moves[order]


def _hash(cells, table: int, dimension: int):
    """One 64-bit number for a cell of a table of vectors of one length."""
    import numpy as np

    mixed = np.full(cells.shape[:-1], (dimension << 16) + table + 1, np.uint64)
    for k in range(cells.shape[-1]):
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + cells[..., k].astype(np.uint64)
    mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed ^ (mixed >> np.uint64(27))).view(np.int64)


def _spread(vectors, asks: bool, axes):
    """Projections of rows, or of queries, whose vectors are in units of the largest norm."""
    import numpy as np

    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    if asks:
        last, vectors = np.zeros_like(size), vectors / size
    else:
        last = np.sqrt(np.maximum(0, 1 - size**2))
    return np.hstack([vectors, last]) @ axes


def depths(row_at, query_at, tables: int, functions: int):
    """For each query and row the number of buckets that the query must visit per table until it meets the row in one;
    3 ** functions + 1 where no perturbed bucket holds it. ``_at`` are projections in units of the width."""
    import numpy as np

    never = 3**functions + 1
    weights = 3 ** np.arange(functions - 1, -1, -1)
    cells, found = np.floor(row_at).astype(np.int64), np.full((len(query_at), len(row_at)), never, np.int32)
    own = np.floor(query_at).astype(np.int64)
    moves = perturbations(functions)
    for table in range(tables):
        these = slice(table * functions, (table + 1) * functions)
        visited = probes(own[:, these], (query_at - own)[:, these], functions, never)
        moved = visited - own[:, None, these]
        place = np.empty(moved.shape[:2], np.int32)
        np.put_along_axis(place, (moved + 1) @ weights, np.arange(1, len(moves) + 1, dtype=np.int32)[None, :], axis=1)
        for q in range(len(own)):
            away = cells[:, these] - own[q, these]
            near = np.flatnonzero((np.abs(away) <= 1).all(axis=1))
            found[q, near] = np.minimum(found[q, near], place[q, (away[near] + 1) @ weights])
    return found


def _nearest_pairs(rows, row_ids, queries, query_ids, k: int):
    """Whether a row is among the ``k`` largest inner products of a query, its own row left out."""
    import numpy as np

    scores = np.where(query_ids[:, None] == row_ids, -np.inf, queries @ rows.T)
    k = min(k, len(row_ids))
    best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    wanted = np.zeros(scores.shape, bool)
    np.put_along_axis(wanted, best, True, axis=1)
    return wanted & np.isfinite(scores)


def fit(
    sample, norm: float, share: float, k: int, widths: Iterable[float], tables: int, functions: int, seed: int,
    buckets: int | None = None,
):
    """``(width, count, visited)``: cell width, buckets per table, and the share of rows these visit on the sample.

    ``sample`` holds ``(rows, row ids, queries, query ids)`` per vector length. It is the ``share`` of all rows, so the
    ``k`` nearest of all are at least as near as the ``k * share`` nearest of the sample: the settings find the former
    at least as well. Of the settings that find ``TARGET`` and two standard errors of those, all where the queries are
    few, the one that visits the fewest rows is taken, fewer buckets first among those within a tenth of it. Settings of
    more than ``buckets`` per table do not count: without that limit, samples of almost the same vectors may differ
    twentyfold in the buckets visited, for a few rows less.
    """
    import numpy as np

    near = max(1, math.ceil(k * share))
    asked = max(1, sum(len(ids) for *_, ids in sample))
    target = min(1.0, TARGET + 2 * math.sqrt(TARGET * (1 - TARGET) / asked))
    parts = []
    for rows, row_ids, queries, query_ids in sample:
        axes, shift = _projections(tables, functions, rows.shape[1], seed)
        wanted = _nearest_pairs(rows, row_ids, queries, query_ids, near)
        parts.append((_spread(rows / norm, False, axes), _spread(queries / norm, True, axes), shift, wanted))
    most = min(3**functions, buckets or 3**functions)
    found: list[tuple[float, int, float]] = []
    if not any(wanted.any() for *_, wanted in parts):
        return max(widths), most, 1.0  # no query has a candidate in the sample
    for width in [*widths, *(max(widths) * 1.4**n for n in range(1, 65))]:
        if found and width > max(widths):
            break
        deep = [depths(r / width + shift, q / width + shift, tables, functions) for r, q, shift, _ in parts]
        hits = np.sort(np.concatenate([d[w] for d, (*_, w) in zip(deep, parts, strict=True)]))
        count = int(hits[math.ceil(target * len(hits)) - 1])
        if count <= most:
            every = np.concatenate([d.reshape(-1) for d in deep])
            found.append((width, count, float((every <= count).mean())))
    if not found:
        return max(widths), most, 1.0
    least = min(v for _, _, v in found)
    return min((f for f in found if f[2] <= 1.1 * least), key=lambda f: (f[1], f[2]))


def settings(
    rows: DataFrame, queries: DataFrame, k: int, norm: float, widths: Iterable[float] = WIDTHS,
    tables: int = TABLES, functions: int = FUNCTIONS, seed: int = SEED, buckets: int | None = BUCKETS,
) -> tuple[float, int, float]:
    """`fit` on at most ``SAMPLE_ROWS`` rows and ``SAMPLE_QUERIES`` queries, drawn by a hash of their id."""
    import numpy as np
    import pyarrow as pa

    total, longest = rows.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    most = max(k + 1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * (longest or 1))))
    drawn = lambda side, n: side.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(n).toArrow()
    by_length: dict[int, list] = {}
    for place, side in enumerate((drawn(rows, most), drawn(queries, min(SAMPLE_QUERIES, most)))):
        lengths = np.array([len(v) for v in side.column("vector")], np.int64)
        for length in np.unique(lengths):
            part = side.take(pa.array(np.flatnonzero(lengths == length)))
            pair = [matrix(part.column("vector")).astype(np.float64), part.column("vec_id").to_numpy()]
            by_length.setdefault(int(length), [None, None])[place] = pair
    sample = [(*r, *q) for r, q in by_length.values() if r and q]
    return fit(sample, norm, min(1.0, most / max(1, total)), k, tuple(widths), tables, functions, seed, buckets)


def _buckets(norm: float, asks: bool, tables: int, functions: int, width: float, count: int, seed: int):
    """Arrow function: the buckets of rows, or those that queries visit."""

    def place(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa

        ready: dict[int, tuple] = {}
        for batch in slices(batches, 1024):
            lengths = np.array(batch.column(1).value_lengths().to_numpy(zero_copy_only=False), np.int64)
            for dimension in np.unique(lengths):
                part = batch.take(pa.array(np.flatnonzero(lengths == dimension)))
                vectors = matrix(part.column(1)).astype(np.float64) / norm
                if dimension not in ready:
                    ready[dimension] = _projections(tables, functions, int(dimension), seed)
                axes, shift = ready[dimension]
                at = _spread(vectors, asks, axes) / width + shift
                cell = np.floor(at)
                inside = at - cell
                found = []
                for table in range(tables):
                    these = slice(table * functions, (table + 1) * functions)
                    cells = cell[:, these].astype(np.int64)
                    visited = probes(cells, inside[:, these], functions, count) if asks else cells[:, None, :]
                    found.append(_hash(visited, table, int(dimension)))
                found = np.concatenate(found, axis=1)
                offsets = np.arange(len(found) + 1, dtype=np.int32) * found.shape[1]
                buckets = pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column(0), buckets], names=["vec_id", "buckets"])

    return place


def _rank(k: int):
    """Arrow function over one tile, a group of buckets with the queries that visit some of them: the k largest inner
    products of each query among the rows in its buckets, in double precision."""

    def rank(table):
        import numpy as np
        import pyarrow as pa

        query = table.column("is_query").to_numpy(zero_copy_only=False).astype(bool)
        ids = table.column("vec_id").to_numpy()
        out: list[list] = [[], [], []]
        for width in np.unique(table.column("width").to_numpy()):
            fits = table.column("width").to_numpy() == width
            asked, held = np.flatnonzero(query & fits), np.flatnonzero(~query & fits)
            if not len(asked) or not len(held):
                continue
            keys, key_of = np.unique(table.column("keys").take(pa.array(held)).combine_chunks().flatten().to_numpy(), return_inverse=True)
            row_ids, first, row_of = np.unique(ids[held], return_index=True, return_inverse=True)
            rows = matrix(table.column("vector").take(pa.array(held[first]))).astype(np.float64)
            order = np.argsort(row_of, kind="stable")
            starts = np.searchsorted(row_of[order], np.arange(len(row_ids)))
            visits = table.column("keys").take(pa.array(asked)).to_pylist()
            vectors = matrix(table.column("vector").take(pa.array(asked))).astype(np.float64)
            for start in range(0, len(asked), 128):
                part = slice(start, start + 128)
                seen = np.zeros((len(asked[part]), len(keys)), bool)
                for place, wanted in enumerate(visits[part]):
                    seen[place] = np.isin(keys, wanted)
                met = np.logical_or.reduceat(seen[:, key_of[order]], starts, axis=1)
                rough = np.where(met, vectors[part] @ rows.T, -np.inf)
                for place, at in enumerate(asked[part]):
                    slack = 1e-9 * (1 + np.abs(rough[place], where=met[place], out=np.zeros(len(rows))).max())
                    near = best_of_row(rough[place], row_ids, ids[at], k, slack)
                    near = np.sort(near[met[place][near]])
                    # summed row by row, so that equal vectors score the same wherever they meet
                    exact = (rows[near] * vectors[start + place]).sum(axis=1)
                    best = np.argsort(-exact, kind="stable")[:k]
                    out[0].append(np.full(len(best), ids[at]))
                    out[1].append(row_ids[near[best]])
                    out[2].append(exact[best])
        join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        return pa.table(
            {"query_id": join(out[0], np.int64), "vec_id": join(out[1], np.int64), "score": join(out[2], np.float64)}
        )

    return rank


def _met(queries: DataFrame, visits: DataFrame, rows: DataFrame, hashed: DataFrame, k: int) -> DataFrame:
    """Rank queries and rows that share a bucket. ``visits`` and ``hashed`` are ``(vec_id, bucket)``.

    A bucket over ``GROUP_ROWS`` rows is cut into parts. Parts are gathered in groups of about that size, so a query is
    sent to a group once with the parts it visits there; groups that many queries visit are repeated for blocks of them.
    """
    cores = max(1, rows.sparkSession.sparkContext.defaultParallelism)
    total = hashed.count()
    share = min(GROUP_ROWS, max(512, total // (2 * cores)))
    groups = max(1, -(-total // share))
    sizes = saved(
        hashed.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / share).cast("long").alias("parts"))
    )
    key = F.xxhash64("bucket", "part")
    group = F.pmod(F.xxhash64("key", F.lit(1)), F.lit(groups))
    held = hashed.join(sizes.filter("parts > 1"), "bucket", "left").withColumn(
        "part", F.pmod(F.xxhash64("vec_id"), F.coalesce("parts", F.lit(1)))
    )
    held = held.select("vec_id", key.alias("key")).withColumn("group", group)
    asked = visits.join(sizes, "bucket").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    asked = asked.select("vec_id", key.alias("key")).withColumn("group", group)
    asked = saved(asked.groupBy("group", "vec_id").agg(F.collect_set("key").alias("keys")))
    blocks = asked.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / GROUP_QUERIES).cast("long").alias("blocks"))
    width = F.size("vector").alias("width")
    one = asked.join(blocks, "group").join(queries, "vec_id").select(
        "group", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).alias("block"), "vec_id", "vector", width, "keys",
        F.lit(True).alias("is_query"),
    )
    other = held.join(blocks, "group").join(rows, "vec_id").select(
        "group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "vec_id", "vector", width,
        F.array("key").alias("keys"), F.lit(False).alias("is_query"),
    )
    tiles = one.unionByName(other).groupBy("group", "block")
    found = tiles.applyInArrow(_rank(k), "query_id long, vec_id long, score double")
    return best_rows(found.distinct(), ["query_id"], k)


def nearest(
    rows: DataFrame,
    queries: DataFrame,
    k: int,
    tables: int = TABLES,
    functions: int = FUNCTIONS,
    width: float | None = None,
    count: int | None = None,
    seed: int = SEED,
) -> DataFrame:
    """The ``k`` rows found with the largest inner product for each query: ``query_id, rank, vec_id, score``.

    Both sides have ``vec_id`` (unique) and ``vector`` (not null, finite; vectors of zeros are left out). A query is
    never its own result; ties go to the smaller id. Vectors of another length than the query's are no candidates. Of
    rows with one and the same vector only the k + 1 smallest ids are hashed: no other can be among the k nearest.
    A query that finds fewer than k is searched again against all rows, in blocks, so it gets k or all there are: for
    such a query that is exact search.

    ``width`` of a cell and ``count`` of buckets visited per table are measured by `settings` unless both are given.
    """
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    rows, queries = rows.filter(norm > 0), queries.filter(norm > 0)
    copies = Window.partitionBy("vector").orderBy("vec_id")
    rows = rows.withColumn("_n", F.row_number().over(copies)).filter(F.col("_n") <= k + 1).drop("_n")
    rows, queries = saved(rows.select("vec_id", "vector")), saved(queries.select("vec_id", "vector"))
    largest = rows.agg(F.max(norm)).first()[0] or 1.0
    if width is None or count is None:
        widths, limit = (WIDTHS, BUCKETS) if width is None else ((width,), None)
        width, count, _ = settings(rows, queries, k, largest, widths, tables, functions, seed, limit)

    def hashed(side: DataFrame, asks: bool) -> DataFrame:
        placed = side.mapInArrow(
            _buckets(largest, asks, tables, functions, width, count, seed), "vec_id long, buckets array<long>"
        )
        return saved(placed.select("vec_id", F.explode("buckets").alias("bucket")))

    found = saved(_met(queries, hashed(queries, True), rows, hashed(rows, False), k))
    served = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k)
    short = saved(queries.join(served, "vec_id", "left_anti"))
    if short.isEmpty():
        return found.select("query_id", "rank", "vec_id", "score")
    by_length = lambda side: side.select("vec_id", F.size("vector").cast("long").alias("bucket"))
    again = _met(short, by_length(short), rows, by_length(rows), k)
    whole = found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti")
    return whole.unionByName(again).select("query_id", "rank", "vec_id", "score")
