from collections import Counter

import pytest

from pagemill.llm import mixing as M


def goals(sizes, weights=(1, 2, 3), limit=3.0):
    """Targets by raising the level until nothing changes."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    full: dict = {}
    while len(full) < len(names):
        level = (sum(sizes.values()) - sum(full.values())) / sum(weight[s] for s in names if s not in full)
        over = [s for s in names if s not in full and limit * sizes[s] <= weight[s] * level]
        if not over:
            return full | {s: weight[s] * level for s in names if s not in full}
        full |= {s: limit * sizes[s] for s in over}
    return full


def docs(spark, extra=()):
    rows = []
    for k, (source, n) in enumerate([("hot", 900), ("b", 30), ("é", 20), (None, 40), ("tiny", 1), ("z", 200)]):
        rows += [(k * 1000 + i, "w " * (5 + (i * 7) % 60), source, 3.5) for i in range(n)]
    rows += [(9001, None, "void", None), (9002, "", "void", 1.0), *extra]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, taken double")


def test_targets_and_shares(spark):
    sized = M.document_sizes(docs(spark))
    got = M.mix(sized).collect()
    total, taken, target, largest = Counter(), Counter(), {}, Counter()
    for r in got:
        total[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
    want = goals(total)
    for s in total:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 3 * largest[s]
        assert all(r["source_size"] == total[s] for r in got if r["source"] == s)
    assert len(got) == 1193


def test_reruns_agree_and_rows_keep_their_columns(spark):
    table = docs(spark)
    first = [sorted(map(str, M.mix_documents(table).collect())) for _ in range(2)]
    assert first[0] == first[1]
    mixed = M.mix_documents(table)
    assert mixed.dtypes == table.dtypes
    assert {r["taken"] for r in mixed.collect()} == {3.5}


def test_size_column_of_the_documents_stays(spark):
    table = spark.createDataFrame([(i, "a b c", "s", "big") for i in range(4)], "doc_id long, text string, source string, size string")
    assert {r["size"] for r in M.mix_documents(table).collect()} == {"big"}


def test_repeated_rows(spark):
    table = spark.createDataFrame([(1, "a b", "s")] * 40 + [(2, "c d", "t")] * 10, "doc_id long, text string, source string")
    got = Counter(r["source"] for r in M.mix_documents(table).collect())
    assert abs(got["s"] - 50 / 3 * 1) <= 7 and got["t"] <= 30 and sum(got.values()) == pytest.approx(50, abs=2)


def test_empty_table_and_no_words(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert M.mix_documents(empty).count() == 0
    void = spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")
    got = M.mix(M.document_sizes(void)).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in got] == [(0, 0.0, 0)] * 2
