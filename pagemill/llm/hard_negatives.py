"""Hard-negative mining with bounds along a spanning tree of the anchors.

The inner product of a candidate with an anchor differs from that with the anchor's parent in the tree by at most the
length of their edge times the candidate's norm. So from the parent's scores (or what bounds them) every candidate gets
an interval, and only candidates whose interval meets the window that is asked for are scored again, exactly.

Anchors are put in order of label and of the signs of random projections, so that neighbours in a block are near each
other; every ``TREE`` anchors of a block have a minimum spanning tree. Blocks of anchors meet shards of candidates in tiles of
bounded size, and the short lists of the shards are merged in a tree. First the positives are found, then the negatives
in the windows that their scores set.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import ordered_rank, saved, slices
from pagemill.llm.topk import FAN_IN, matrix

TILE_VALUES = 1 << 22  # numbers of one side of a tile at most
LEAST_ROWS = 1024  # of a shard
TREE = 256  # anchors of a spanning tree
CHUNK = 4096  # candidates bounded at once
BITS = 16  # signs that order the anchors
SEED = 20_260_301
LONG = 1 << 63


def spanning_tree(vectors) -> list[tuple[int, int, float]]:
    """Minimum spanning tree as ``(node, parent, edge length)``, parents first; the first node has parent -1."""
    import numpy as np

    square = (vectors * vectors).sum(axis=1)
    away, parent = np.full(len(vectors), np.inf), np.full(len(vectors), -1)
    out, node = [], 0
    for _ in range(len(vectors)):
        up = int(parent[node])
        edge = 0.0 if up < 0 else float(np.sqrt(((vectors[node] - vectors[up]) ** 2).sum()))
        out.append((node, up, edge))
        away[node] = -1.0
        distance = np.maximum(0.0, square + square[node] - 2 * (vectors @ vectors[node]))
        nearer = distance < away
        away[nearer], parent[nearer] = distance[nearer], node
        node = int(np.argmin(np.where(away < 0, np.inf, away)))
    return out


class _Exact:
    """Exact integer inner products: by floating point where no sum can reach 2**53, else by Python's integers."""

    def __init__(self, anchors, rows):
        import numpy as np

        biggest = [max(abs(int(side.max())), abs(int(side.min()))) if side.size else 0 for side in (anchors, rows)]
        small = biggest[0] * biggest[1] * max(1, rows.shape[1]) < 1 << 53
        self.anchors, self.rows = (x.astype(np.float64 if small else object) for x in (anchors, rows))
        self.slack = 0.0 if small else 1e-12  # of a float that stands for a whole number


def best(scores, ids, count: int) -> list[tuple[int, int]]:
    """The ``count`` highest scores with their ids, ties to the smaller id; those that fit no long are left out."""
    import numpy as np

    if scores.dtype == object:
        fits = [(-s, i) for s, i in zip(scores.tolist(), ids.tolist(), strict=True) if -LONG <= s < LONG]
        return [(int(-s), i) for s, i in sorted(fits)[:count]]
    if len(scores) > 4 * count:
        near = scores >= np.partition(scores, len(scores) - count)[len(scores) - count]
        scores, ids = scores[near], ids[near]
    order = np.lexsort((ids, -scores))[:count]
    return [(int(scores[k]), int(ids[k])) for k in order]


class _List:
    """The best ``count`` scores inside a window, over all chunks of a tile."""

    def __init__(self, count: int, low: int = -LONG, high: int = LONG):
        self.count, self.low, self.high, self.found = count, low, high, []

    def add(self, scores, ids) -> None:
        inside = (scores >= self.low) & (scores <= self.high)
        new = best(scores[inside], ids[inside], self.count)
        if new:
            self.found = sorted(self.found + new, key=lambda x: (-x[0], x[1]))[: self.count]
            if len(self.found) == self.count:
                self.low = max(self.low, self.found[-1][0])


def scan(exact: _Exact, anchors: list[int], tree: list[tuple], rows, norms, ids, numbers, own, lists: list[list[_List]]) -> int:
    """Fill ``lists`` (some for each anchor of ``tree``) from the candidates ``rows`` (places in ``exact``), and return how
    many scores were computed. ``numbers`` and ``own`` are row numbers of candidates and anchors: none is its own candidate."""
    import numpy as np

    computed = 0
    for start in range(0, len(rows), CHUNK):
        part = rows[start : start + CHUNK]
        length, name, number, vectors = norms[part], ids[part], numbers[part], exact.rows[part]
        bounds: dict[int, tuple] = {}
        for node, up, edge in tree:
            if up < 0:
                low, high = np.full(len(part), -np.inf), np.full(len(part), np.inf)
                asked = np.arange(len(part))
            else:
                width = edge * length
                low, high = bounds[up][0] - width, bounds[up][1] + width
                meets = np.zeros(len(part), bool)
                for wanted in lists[node]:
                    least = float(wanted.low)
                    if wanted.high >= LONG and len(part) > wanted.count:  # an open window: others are surely better
                        least = max(least, np.partition(low, len(low) - wanted.count - 1)[len(low) - wanted.count - 1])
                    if wanted.low <= wanted.high:
                        meets |= (high >= least) & (low <= float(wanted.high))
                asked = np.flatnonzero(meets)
            scores = (vectors if len(asked) == len(part) else vectors[asked]) @ exact.anchors[anchors[node]]
            computed += len(asked)
            rough = scores.astype(np.float64)
            spare = np.abs(rough) * exact.slack
            low[asked], high[asked] = rough - spare, rough + spare
            bounds[node] = (low, high)
            others = number[asked] != own[node]
            for wanted in lists[node]:
                wanted.add(scores[others], name[asked][others])
    return computed


def _tile(positives: int, negatives: int, mining: bool):
    """Arrow function over one tile: short lists of positives of its anchors, or of negatives in the windows that the
    positives set."""

    def mine(table):
        import numpy as np
        import pyarrow as pa

        flag = table.column("is_anchor").to_numpy(zero_copy_only=False).astype(bool)
        out: list[tuple] = []
        if flag.any() and not flag.all():
            number, ids = table.column("number").to_numpy(), table.column("vec_id").to_numpy()
            labels, ranks = table.column("label").to_numpy(), table.column("rank").to_numpy(zero_copy_only=False)
            vectors = matrix(table.column("vector"))
            mine_, rows = np.flatnonzero(flag), np.flatnonzero(~flag)
            mine_ = mine_[np.argsort(ranks[mine_], kind="stable")]
            exact = _Exact(vectors[mine_], vectors[rows])
            norms = np.sqrt((vectors[rows].astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-9)
            known = table.column("positives") if mining else None
            for label in np.unique(labels[mine_]):
                same = labels[rows] == label
                candidates = np.flatnonzero(~same if mining else same)
                places = np.flatnonzero(labels[mine_] == label)
                for start in range(0, len(places), TREE):
                    part = places[start : start + TREE]
                    points = vectors[mine_[part]].astype(np.float64)
                    sizes = np.sqrt((points**2).sum(axis=1))
                    tree = [(n, up, e * (1 + 1e-9) + (sizes[n] + sizes[up]) * 1e-12) for n, up, e in spanning_tree(points)]
                    own = number[mine_[part]]
                    if mining:
                        held = [known[int(mine_[p])].as_py() for p in part]
                        lists = [[_List(negatives, -(-h["score"] // 2), 95 * h["score"] // 100) for h in some] for some in held]
                    else:
                        held = [[None]] * len(part)
                        lists = [[_List(positives)] for _ in part]
                    scan(exact, part.tolist(), tree, candidates, norms, ids[rows], number[rows], own, lists)
                    for k, p in enumerate(part):
                        for h, wanted in zip(held[k], lists[k], strict=True):
                            head = (int(own[k]), int(ids[mine_[p]])) + ((h["place"], h["vec_id"], h["score"]) if mining else ())
                            out += [(*head, i, s) for s, i in wanted.found]
        names = ["anchor", "anchor_id", *(["place", "positive_id", "positive_score"] if mining else []), "vec_id", "score"]
        columns = {name: pa.array([r[k] for r in out], pa.int64()) for k, name in enumerate(names)}
        return pa.table(columns | {"shard": pa.array([table.column("shard")[0].as_py()] * len(out), pa.int64())})

    return mine


def _merged(lists: DataFrame, by: list[str], shards: int, count: int) -> DataFrame:
    """The best ``count`` rows per group with their ``place`` from 1; the lists of ``FAN_IN`` shards at a time."""

    def kept(lists: DataFrame, keys: list[str]) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("vec_id"))
        return lists.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= count)

    while shards > FAN_IN:
        shards = -(-shards // FAN_IN)
        lists = kept(lists.withColumn("shard", F.floor(F.col("shard") / FAN_IN)), [*by, "shard"]).drop("_place")
    return kept(lists, by).drop("shard")


def _codes(batches: Iterable) -> Iterator:
    """Row number, label, width and the signs of random projections of a vector, as a number."""
    import numpy as np
    import pyarrow as pa

    for batch in slices(batches, 1024):
        lengths = np.array(batch.column(2).value_lengths().to_numpy(zero_copy_only=False), np.int64)
        for width in np.unique(lengths):
            part = batch.take(pa.array(np.flatnonzero(lengths == width)))
            axes = np.random.default_rng((SEED, int(width))).standard_normal((int(width), BITS))
            signs = matrix(part.column(2)).astype(np.float64) @ axes > 0
            codes = signs @ (1 << np.arange(BITS))[::-1]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(np.full(len(codes), width, np.int64)), pa.array(codes.astype(np.int64))],
                names=["number", "label", "width", "code"])


def mine_hard_negatives(rows: DataFrame, anchors: str, positives: int = 5, negatives: int = 3) -> DataFrame:
    """For every anchor its ``positives`` other rows of the same label with the highest inner product, and for each of them
    the first ``negatives`` rows of other labels whose score is from 50 % to 95 % of the positive's: ``anchor_id,
    positive_id, rank, negative_id, positive_score, negative_score``. Ties go to the smaller id; a positive without such a
    row gives none.

    ``rows`` has ``vec_id``, ``label`` and ``vector``, an array of longs; ``anchors`` is a condition on its columns. Rows with a
    null in any of these columns or in the vector take no part; other columns are not read. Rows with one id are rows
    of their own, repeated rows too. Vectors of another length than the anchor's are no candidates. Scores are exact; a pair
    whose score fits no long is left out. An empty table gives no rows.
    """
    whole = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()
    whole = whole & ~F.exists("vector", lambda x: x.isNull())
    columns = ["number", "vec_id", "label", "vector", F.size("vector").cast("long").alias("width")]
    rows = rows.filter(whole).withColumn("label", F.col("label").cast("long"))
    rows = saved(rows.select("vec_id", "label", "vector", F.expr(anchors).alias("asked")).withColumn("number", F.monotonically_increasing_id()))
    asked = rows.filter("asked")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("d")).first()
    most = max(1, TILE_VALUES // max(1, size["d"] or 1))
    cores = max(1, rows.sparkSession.sparkContext.defaultParallelism)
    shards = max(1, -(-size["n"] // min(most, max(LEAST_ROWS, size["n"] // (2 * cores)))))
    blocks = max(1, -(-asked.count() // most))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    coded = asked.select("number", "label", "vector").mapInArrow(_codes, "number long, label long, width long, code long")
    ranked = ordered_rank(coded, [F.col(c) for c in ("width", "label", "code", "number")], "rank").select("number", "rank")
    asked = saved(asked.select(*columns).join(ranked, "number"))
    none = F.lit(None).cast("array<struct<place: long, vec_id: long, score: long>>")
    shard = F.pmod(F.xxhash64("number"), F.lit(shards)).alias("shard")
    held = rows.select(
        *columns, F.lit(None).cast("long").alias("rank"), none.alias("positives"), F.lit(False).alias("is_anchor"), shard,
        every(blocks).alias("block"),
    )

    def lists(sides: DataFrame, known, mining: bool, schema: str) -> DataFrame:
        block = F.floor(F.col("rank") / most).alias("block")
        side = sides.select(
            "number", "vec_id", "label", "vector", "width", "rank", known.alias("positives"), F.lit(True).alias("is_anchor"),
            every(shards).alias("shard"), block,
        )
        tiles = side.unionByName(held).groupBy("width", "block", "shard")
        return tiles.applyInArrow(_tile(positives, negatives, mining), schema)

    head = "anchor long, anchor_id long, "
    found = _merged(lists(asked, none, False, head + "vec_id long, score long, shard long"), ["anchor"], shards, positives)
    per_anchor = found.groupBy(F.col("anchor").alias("number")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("_place").cast("long").alias("place"), "vec_id", "score"))).alias("known")
    )  # at most ``positives`` of them
    mined = lists(
        asked.join(per_anchor, "number"), F.col("known"), True,
        head + "place long, positive_id long, positive_score long, vec_id long, score long, shard long",
    )
    best_ones = _merged(mined, ["anchor", "place"], shards, negatives)
    return best_ones.select(
        "anchor_id", "positive_id", F.col("_place").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )
