import random

import pytest

from pagemill.llm import ann, queries, topk
from pyspark.sql import functions as F

np = pytest.importorskip("numpy")
NAN, INF = float("nan"), float("inf")
ODD = [(9001, None), (9002, [1.0, None, 2.0, 0.0]), (9003, [NAN, 0.0, 0.0, 0.0]), (9004, [INF, 1.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0, 1.0])]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")


def vectors(seed, n, d=4):
    draw = random.Random(seed)
    rows = [(i, [float(np.float32(draw.gauss(0, 1))) for _ in range(d)]) for i in range(n)]
    return rows + [(n + i, rows[i % 3][1]) for i in range(40)]  # copies


def brute(rows, step, k, score):
    out = {}
    for q, v in rows:
        if q % step == 0:
            scored = sorted(((-score(v, w), i) for i, w in rows if i != q and len(w) == len(v)))
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def lists(df):
    got: dict = {}
    for r in df.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: [(i, s) for _, i, s in sorted(x)] for q, x in got.items()}


def whole(v):
    return [int(np.floor(256.0 * x)) for x in v]


def test_exact_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "TILE_VALUES", 64)
    monkeypatch.setattr(topk, "LEAST_ROWS", 1)
    monkeypatch.setattr(topk, "FAN_IN", 3)
    rows = vectors(1, 200)
    used = topk.usable(frame(spark, rows + ODD))
    used = used.select("vec_id", topk.scaled_floor(F.col("vector")).alias("vector"))
    got = lists(topk.exact_top_k(used.filter("vec_id % 50 = 0"), used, 5))
    assert got == brute(rows, 50, 5, lambda a, b: sum(x * y for x, y in zip(whole(a), whole(b), strict=True)))


def test_large_components_stay_exact(spark):
    rows = [(0, [3.0e9, 1.0]), (1, [3.0e9, 0.00390625]), (2, [3.0e9, 0.0]), (3, [1.0])]
    used = spark.createDataFrame([(i, [int(x * 256) for x in v]) for i, v in rows[:3]], "vec_id long, vector array<bigint>")
    got = lists(topk.exact_top_k(used.filter("vec_id = 0").selectExpr("vec_id", "transform(vector, x -> x div 1000000) as vector"), used, 2))
    v = [[int(x * 256) for x in r[1]] for r in rows[:3]]
    q = [x // 1000000 for x in v[0]]
    assert got == {0: [(i, sum(a * b for a, b in zip(q, v[i], strict=True))) for i in (1, 2)]}


def test_few_candidates(spark):
    used = topk.usable(frame(spark, [(0, [1.0]), (1, [2.0]), (2, [2.0]), (3, [1.0, 1.0])]))
    used = used.select("vec_id", topk.scaled_floor(F.col("vector")).alias("vector"))
    assert lists(topk.exact_top_k(used.filter("vec_id = 0"), used, 5)) == {0: [(1, 131072), (2, 131072)]}
    empty = used.limit(0)
    assert topk.exact_top_k(empty, empty, 5).count() == 0


def test_neighbours_of_small_and_odd_tables(spark):
    rows = vectors(2, 15) + [(500, [0.0] * 4), (600, [1.0, 2.0])]
    used = topk.usable(frame(spark, rows + ODD))
    got = lists(ann.nearest(used, used.filter("vec_id % 5 = 0"), 20))
    want = brute([r for r in rows if any(r[1])], 5, 20, lambda a, b: float(np.sum(np.array(a) * np.array(b))))
    want = {q: v for q, v in want.items() if v}
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert all(abs(a - b) < 1e-12 for q in got for (_, a), (_, b) in zip(got[q], want[q], strict=True))
    assert ann.nearest(used.limit(0), used.limit(0), 3).count() == 0


def test_buckets_and_queries_are_cut(spark, monkeypatch):
    rows = vectors(3, 600)
    used = topk.usable(frame(spark, rows))
    one = lists(ann.nearest(used, used.filter("vec_id % 5 = 0"), 10))
    monkeypatch.setattr(ann, "GROUP_ROWS", 37)
    monkeypatch.setattr(ann, "GROUP_QUERIES", 11)
    assert lists(ann.nearest(used, used.filter("vec_id % 5 = 0"), 10)) == one


def test_probes_come_in_order_of_distance():
    inside = np.array([[0.1, 0.45]])
    found = ann.probes(np.zeros((1, 2), np.int64), inside, 2, 4)[0].tolist()
    assert found == [[0, 0], [-1, 0], [0, -1], [-1, -1]]


def expected(rows, step, k, score):
    """Lists of every query row, by place: repeated ids are rows of their own."""
    out = []
    for at, (q, v) in enumerate(rows):
        if q % step == 0:
            scored = sorted((-score(v, w), i) for n, (i, w) in enumerate(rows) if n != at and len(w) == len(v))
            scored = [(s, i) for s, i in scored if -topk.LONG <= -s < topk.LONG]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def query(spark, tmp_path, name, rows):
    path = f"{tmp_path}/{name}"
    frame(spark, rows).repartition(3).write.parquet(f"{path}/embeddings.parquet")
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in queries.QUERIES[name](spark, path).collect())


def test_rows_with_one_id_are_rows_of_their_own(spark, tmp_path):
    rows = vectors(8, 130)
    rows += [(100, rows[3][1]), (100, rows[100][1]), (7, rows[9][1]), (7, rows[7][1]), (20, [0.5] * 4)]
    whole_score = lambda a, b: sum(x * y for x, y in zip(whole(a), whole(b), strict=True))
    assert query(spark, tmp_path, "op5_exact_top_k", rows + ODD) == expected(rows, 50, 5, whole_score)
    got = query(spark, tmp_path, "op4_nearest_neighbours", rows + ODD)
    want = expected(rows, 20, 20, lambda a, b: float(np.dot(np.float64(a), np.float64(b))))
    assert len(got) == len(want) and {(q, r) for q, r, *_ in got} == {(q, r) for q, r, *_ in want}
    met = sum(min(a, b) for a, b in ((got_n[x], n) for got_n, x, n in counted(got, want)))
    assert met >= 0.9 * len(want)


def counted(got, want):
    from collections import Counter

    mine = Counter((q, i) for q, _, i, _ in got)
    return [(mine, x, n) for x, n in Counter((q, i) for q, _, i, _ in want).items()]


def test_two_rows_of_one_id(spark, tmp_path):
    assert query(spark, tmp_path, "op5_exact_top_k", [(50, [1.0]), (50, [2.0])]) == [(50, 1, 50, 131072), (50, 1, 50, 131072)]


def test_scores_beyond_a_long_are_left_out(spark, tmp_path):
    """Components that are no whole number of 64 bits take no part, pairs whose score is none are left out."""
    draw = random.Random(9)
    rows = [(i * 10, [float(np.float32(draw.choice((1, -1)) * draw.random() * 10.0 ** draw.choice((0, 6, 7, 10)))) for _ in range(3)]) for i in range(60)]
    huge = [(7, [1e30, 1.0, 1.0]), (8, [-1e17, 1.0, 1.0]), (50, [4e16, 1.0, 1.0])]
    got = query(spark, tmp_path, "op5_exact_top_k", rows + huge)
    assert got == expected(rows, 50, 5, lambda a, b: sum(x * y for x, y in zip(whole(a), whole(b), strict=True)))


def sphere(draw, n, d):
    x = draw.standard_normal((n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def shapes(draw):
    centres = draw.standard_normal((200, 48))
    return {
        "sphere": sphere(draw, 6000, 384),
        "norms": sphere(draw, 6000, 16) * draw.lognormal(0, 1, (6000, 1)),
        "clusters": centres[draw.integers(0, 200, 6000)] + 0.05 * draw.standard_normal((6000, 48)),
    }


@pytest.mark.parametrize("name", ["sphere", "norms", "clusters"])
def test_settings_of_a_sample_find_the_nearest_of_all(name):
    """Settings fitted on a third of the rows reach the recall on all; of clustered rows under a third is visited."""
    draw = np.random.default_rng(4)
    x, k = shapes(draw)[name], 20
    ids, norm = np.arange(len(x)), np.linalg.norm(x, axis=1).max()
    some, asks = draw.permutation(len(x))[:2000], draw.permutation(len(x))[:200]
    width, count, visited = ann.fit([(x[some], ids[some], x[asks], ids[asks])], norm, 1 / 3, k, ann.WIDTHS, 4, 6, ann.SEED)
    others = draw.permutation(len(x))[:100]
    axes, shift = ann._projections(4, 6, x.shape[1], ann.SEED)
    deep = ann.depths(ann._spread(x / norm, False, axes) / width + shift, ann._spread(x[others] / norm, True, axes) / width + shift, 4, 6)
    wanted = ann._nearest_pairs(x, ids, x[others], ids[others], k)
    assert (deep[wanted] <= count).mean() >= 0.9
    assert abs((deep <= count).mean() - visited) < 0.05
    assert name != "clusters" or visited < 0.3


def test_depths_equal_the_order_of_probes():
    draw = np.random.default_rng(6)
    rows, asks = draw.normal(0, 1.2, (80, 6)), draw.normal(0, 1.2, (15, 6))
    deep = ann.depths(rows, asks, 2, 3)
    for q, at in enumerate(asks):
        for r, row in enumerate(np.floor(rows).astype(int)):
            met = [28]
            for t in (slice(0, 3), slice(3, 6)):
                cell = np.floor(at[None, t]).astype(np.int64)
                order = ann.probes(cell, at[None, t] - cell, 3, 27)[0].tolist()
                met += [order.index(row[t].tolist()) + 1] if row[t].tolist() in order else []
            assert deep[q, r] == min(met)


def test_measured_settings_of_a_table(spark, monkeypatch):
    """Recall over a table with vectors of two lengths, fitted on a few of its rows."""
    draw = np.random.default_rng(7)
    x = sphere(draw, 1500, 96)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000 + i, v.tolist()) for i, v in enumerate(sphere(draw, 200, 5))]
    monkeypatch.setattr(ann, "SAMPLE_ROWS", 500)
    used = topk.usable(frame(spark, rows))
    got = lists(ann.nearest(used, used.filter("vec_id % 20 = 0"), 20))
    want = brute([(i, np.float32(v).astype(float)) for i, v in rows], 20, 20, lambda a, b: float(np.dot(a, b)) if len(a) == len(b) else -9.0)
    met = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert all(len(got[q]) == 20 for q in want) and met >= 0.9 * 20 * len(want)


def test_buckets_visited_are_bounded(spark, monkeypatch):
    """Where many small buckets would spare rows, a query still visits a bounded number of them."""
    monkeypatch.setattr(ann, "SAMPLE_ROWS", 1_000)
    draw = np.random.default_rng(5)
    x = draw.standard_normal((4_000, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, vector array<double>")
    asking = rows.filter("vec_id % 20 = 0")
    assert ann.settings(rows, asking, 20, 1.0)[1] <= 32
    found = ann.nearest(rows, asking, 20).collect()
    scores = x[::20] @ x.T
    scores[np.arange(200), np.arange(0, 4_000, 20)] = -np.inf
    best = np.argsort(-scores, axis=1)[:, :20]
    assert len({(r["query_id"], r["vec_id"]) for r in found} & {(20 * q, int(i)) for q, near in enumerate(best) for i in near}) >= 0.9 * 4_000
