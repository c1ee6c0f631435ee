import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.functions import embed as E
from pagemill.operators import vectors as V
from tests.conftest import plan_of


def vec(f, n=6):
    return [round(x, n) for x in f]


def test_dummy_embedder(spark):
    df = spark.createDataFrame([("abc",), ("é",), ("",)], "s string")
    got = [vec(r[0]) for r in df.select(E.embed_dummy(F.col("s"), 4)).collect()]
    assert got == [[0.029995, 0.039989, 0.049979, 0.059964], [0.019999, 0.029995, 0.039989, 0.049979], [0.0] * 4]
    assert df.select(F.size(E.embed_dummy(F.col("s"), 0))).first()[0] == 768
    n = np.float32(np.arange(3, 771)) * np.float32(0.01)
    whole = df.select(E.text_embedder("Dummy")(F.col("s"))).first()[0]
    assert np.allclose(whole, np.sin(n.astype(np.float64)).astype(np.float32), atol=1e-7)


def test_user_embedder(spark):
    df = spark.createDataFrame([("abc",), ("",), (None,)], "s string")
    E.register_embedder("Len", lambda: lambda texts: [[float(len(t)), 1.0] for t in texts])
    got = [list(r[0]) for r in df.select(E.text_embedder("LEN", 2)(F.col("s"))).collect()]
    assert got == [[3.0, 1.0], [0.0, 0.0], [0.0, 0.0]]
    with pytest.raises(ValueError):
        E.text_embedder("nope")
    with pytest.raises(Exception, match="size 3"):
        df.select(E.text_embedder("len", 3)(F.col("s"))).collect()


def test_index_settings():
    assert V.index_settings("hnsw", "ip") == ("HNSW", "IP")
    assert V.index_settings("ivf_flat", "cosine") == ("IVF_FLAT", "L2")
    assert V.index_settings("flat", "IP") == ("IVF_FLAT", "L2")


def data(spark, n=400, dim=8, seed=1):
    rnd = np.random.default_rng(seed)
    m = rnd.normal(size=(n, dim)).astype(np.float32)
    m[n // 2 :: 3] = m[0]  # a third of all vectors are copies, so ties are frequent
    rows = [(int(i), [float(x) for x in m[i]]) for i in range(n)]
    return m, spark.createDataFrame(rows, "id bigint, vector array<float>").repartition(5)


def brute(m, q, k, metric):
    a, b = m.astype(np.float64), q.astype(np.float64)
    score = ((b[:, None] - a[None]) ** 2).sum(-1) if metric == "L2" else -(b[:, None] * a[None]).sum(-1)
    return [list(np.lexsort((np.arange(len(a)), np.round(row, 9)))[:k]) for row in score]


@pytest.mark.parametrize("metric", ["L2", "IP"])
@pytest.mark.parametrize("options", [{}, {"max_bytes": 0, "vector_block": 60, "query_block": 9}])
def test_exact_search(spark, metric, options):
    m, df = data(spark)
    got = V.knn(df, df.filter("id < 40"), 7, metric, **options)
    lists = {}
    for r in got.orderBy("query_id", "rank").collect():
        lists.setdefault(r["query_id"], []).append(r["id"])
    assert [lists[q] for q in range(40)] == brute(m, m[:40], 7, metric)


def test_more_neighbours_than_vectors_and_odd_sizes(spark):
    _, df = data(spark, 6)
    none = df.unionByName(spark.createDataFrame([(99, []), (98, None)], "id bigint, vector array<float>"))
    assert V.knn_l2(none, df.filter("id < 2"), 50).count() == 12
    odd = df.unionByName(spark.createDataFrame([(99, [1.0])], "id bigint, vector array<float>"))
    with pytest.raises(Exception, match="vector size"):  # an odd size is not left out in silence
        V.knn_l2(odd, df.filter("id < 2"), 50).count()
    assert V.knn_l2(df, df.filter("id < 0"), 3).count() == 0


def test_vectors_are_not_shuffled_when_queries_are_few(spark):
    _, df = data(spark)
    spark.range(1).count()
    plan = plan_of(V.knn_l2(df.coalesce(2), df.filter("id < 3"), 3))
    assert "MapInArrow" in plan and "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
    scan_side = plan[plan.index("MapInArrow") :]
    assert "hashpartitioning(cell" not in scan_side


@pytest.mark.parametrize("options", [{}, {"max_bytes": 0, "vector_block": 50, "query_block": 7}])
def test_inverted_lists(spark, options):
    m, df = data(spark, 300)
    model = V.ivf_train(df, 6)
    assigned = V.ivf_assign(df, model).cache()
    queries = df.filter("id < 30")
    exact = {(r["query_id"], r["rank"]): r["id"] for r in V.knn_l2(df, queries, 5).collect()}
    full = {(r["query_id"], r["rank"]): r["id"] for r in V.knn_ivf(assigned, queries, model, 5, 6, **options).collect()}
    assert full == exact
    part = V.knn_ivf(assigned, queries, model, 5, 2, **options)
    found = {(r["query_id"], r["id"]) for r in part.collect()}
    recall = len(found & {(q, i) for (q, _), i in exact.items()}) / len(exact)
    assert 0.4 < recall <= 1
    assert part.filter("rank = 1 and score > 1e-9").count() == 0  # a vector finds itself in its own list


def clustered(spark, n=600, dim=6, lists=12, seed=4):
    """Vectors close around ``lists`` far centres, some rows without a vector."""
    rnd = np.random.default_rng(seed)
    centre = rnd.normal(size=(lists, dim)) * 20
    m = (centre[rnd.integers(0, lists, n)] + rnd.normal(size=(n, dim))).astype(np.float32)
    m[n // 2 :: 5] = m[0]
    rows = [(int(i), [float(x) for x in m[i]]) for i in range(n)] + [(n, None), (n + 1, [])]
    return m, centre, spark.createDataFrame(rows, "id bigint, vector array<float>").repartition(5)


@pytest.mark.parametrize("metric", ["L2", "IP"])
@pytest.mark.parametrize("options", [{}, {"max_bytes": 0, "vector_block": 60, "query_block": 9}])
def test_bounded_search_is_exact_and_skips_lists(spark, metric, options):
    m, centre, df = clustered(spark)
    given = [[float(x) for x in c] for c in centre]
    assigned = V.ivf_assign(df, given)
    lists = V.list_table(assigned, given)
    asking = df.filter("id % 6 = 0")
    got = V.knn_ivf_bounded(assigned, asking, given, 5, metric=metric, lists=lists, **options).collect()
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault(r["query_id"], []).append(r["id"])
    ids = list(range(0, 600, 6))
    assert [found[q] for q in ids] == brute(m, m[ids], 5, metric)
    probed = [r["lists_probed"] for r in got]
    assert np.mean(probed) < (3 if metric == "L2" else 8)  # of twelve lists


def test_bounded_search_fills_up_from_other_lists(spark):
    """The nearest list holds fewer than k vectors: the others are searched as well."""
    rows = [(1, [0.0, 0.0]), (2, [9.0, 0.0]), (3, [9.0, 1.0]), (4, [40.0, 0.0])]
    df = spark.createDataFrame(rows, "id bigint, vector array<float>")
    given = [[0.0, 0.0], [9.0, 0.5], [40.0, 0.0], [99.0, 9.0]]
    got = V.knn_ivf_bounded(V.ivf_assign(df, given), df.filter("id = 1"), given, 3).orderBy("rank").collect()
    assert [r["id"] for r in got] == [1, 2, 3] and {r["lists_probed"] for r in got} == {3}  # the last list is empty
    radii = {r["list_id"]: (round(r["radius"], 3), r["n"]) for r in V.list_table(V.ivf_assign(df, given), given).collect()}
    assert radii == {0: (0.0, 1), 1: (0.5, 2), 2: (0.0, 1)}


def test_given_centroids(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, []), (4, [5.0, 0.0])], "id bigint, vector array<float>")
    got = {r["id"]: r["list_id"] for r in V.ivf_assign(df, [[0.0, 0.0], [2.0, 0.0], [6.0, 0.0]]).collect()}
    assert got == {1: 0, 2: None, 3: None, 4: 2}  # a tie goes to the first
    with pytest.raises(Exception, match="vector size is not 3"):
        V.ivf_assign(df, [[0.0] * 3]).collect()


def exploded_rows(df) -> int:
    """Rows that the explodes of the executed plan of ``df`` gave."""
    df._jdf.collectToPython()

    def walk(node) -> int:
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        own = node.metrics().apply("numOutputRows").value() if name == "Generate" else 0
        children = node.children()
        return own + sum(walk(children.apply(i)) for i in range(children.size()))

    return walk(df._jdf.queryExecution().executedPlan())


def test_rows_are_not_repeated_for_every_block(spark):
    """Six times the vectors and queries: about six times the rows that reach the block pairs, not 36 times."""
    rows = []
    for n in (2_000, 12_000):
        df = spark.range(n).select("id", F.array(F.rand(1), F.rand(2)).alias("vector"))
        rows.append(exploded_rows(V.knn_l2(df, df, 3, max_bytes=0, vector_block=20, query_block=10)))
    assert rows[0] >= 4_000 and rows[1] <= 7 * rows[0]


def test_strips_are_bounded_and_shared_out(spark, monkeypatch):
    side = lambda sizes, name: spark.createDataFrame([(c,) for c, n in sizes for _ in range(n)], "cell int").withColumn(name, F.lit(0))
    v, q = side([(0, 400), (1, 40), (2, 5)], "id"), side([(0, 400), (1, 40)], "query_id")
    strips = {r["cell"]: (r["v_strips"], r["q_strips"]) for r in V._grid(v, q, 2, 10, 10).collect()}
    tiles = V.TILES_PER_CORE * spark.sparkContext.defaultParallelism
    assert set(strips) == {0, 1} and strips[1] == (1, 1) and strips[0][0] * strips[0][1] <= tiles + strips[0][1]
    monkeypatch.setattr(V, "STRIP_BYTES", 2 * 8 * 20)  # of twenty rows
    assert {r["cell"]: (r["v_strips"], r["q_strips"]) for r in V._grid(v, q, 2, 10, 10).collect()}[0] == (20, 20)


@pytest.mark.parametrize("metric", ["L2", "IP"])
def test_components_that_are_no_numbers_and_repeated_ids(spark, metric):
    """The same by blocks as by broadcast: rows without a score come last, ids may repeat on both sides."""
    rows = [(n % 7, [float(n % 5), 1.0]) for n in range(30)] + [(90, [float("inf"), 0.0]), (91, [1e200, 1e200])]
    df = spark.createDataFrame(rows, "id bigint, vector array<double>")
    asking = df.filter("id < 90")
    find = lambda **options: sorted(map(tuple, V.knn(df, asking, 9, metric, **options).collect()))
    assert find(max_bytes=0, vector_block=4, query_block=3) == find()
    none = df.unionByName(spark.createDataFrame([(92, [float("nan"), 0.0])], "id bigint, vector array<double>"))
    got = V.knn(none, asking.filter("id = 1"), 200, metric, max_bytes=0, vector_block=4, query_block=3)
    assert [r["id"] for r in got.orderBy(F.desc("rank")).limit(1).collect()] == [92]
