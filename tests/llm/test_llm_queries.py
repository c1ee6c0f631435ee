"""Queries with SQL against DuckDB; the rest over the smallest tables against plain Python."""

import os
import re
from collections import Counter

import pytest

import __spark_entry__ as entry
from pagemill.llm import queries as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("pages", "documents", "embeddings", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(data):
    return sorted((tuple(r) for r in data), key=lambda r: tuple((x is None, str(x)) for x in r))


def test_registered():
    names = set(entry.queries())
    assert set(Q.QUERIES) | {"pipeline"} <= names
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in Q.QUERIES} == set(range(1, 14))


@pytest.mark.parametrize("name", list(Q.ORACLE_SQL))
def test_query_equals_sql(spark, db, name):
    got = Q.QUERIES[name](spark, SF)
    want = db.sql(Q.ORACLE_SQL[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    assert rows(got.select(*names).collect()) == rows(want.select(*[f'"{n}"' for n in names]).fetchall())


def test_language_is_told_for_held_out_rows(spark):
    found = Q.op2_language_id(spark, SF).collect()
    docs = {r["doc_id"]: r for r in Q.table(spark, SF, "documents").collect()}
    assert len(found) == len(docs)
    held = [r for r in found if r["held_out"]]
    right = sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held)
    assert held and right >= 0.95 * len(held)


def test_near_duplicates_equal_brute_force(spark):
    from test_ngram_join import brute_force

    docs = [(r["doc_id"], r["text"]) for r in Q.table(spark, SF, "documents").collect()]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in Q.op3_ngram_jaccard_join(spark, SF).collect()}
    assert got == brute_force(docs)


def test_neighbours_reach_the_recall(spark):
    np = pytest.importorskip("numpy")
    data = Q.table(spark, SF, "embeddings").orderBy("vec_id").collect()
    x = np.array([r["embedding"] for r in data], np.float64)
    got: dict = {}
    for r in Q.op4_nearest_neighbours(spark, SF).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for q in range(0, len(x), 20):
        scores = x @ x[q]
        scores[q] = -np.inf
        want = set(np.lexsort((np.arange(len(x)), -scores))[:20].tolist())
        found = sorted(got[q])
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert all(abs(s - scores[v]) < 1e-12 for _, v, s in found)
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        hits += len(want & {v for _, v, _ in found})
    assert hits >= 0.9 * 20 * len(range(0, len(x), 20))


def test_mixture_shares(spark):
    found = Q.op6_source_mixing(spark, SF).collect()
    docs = {r["doc_id"]: r for r in Q.table(spark, SF, "documents").collect()}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")) for i, d in docs.items()}
    total = Counter()
    for i, d in docs.items():
        total[d["source"]] += size[i]
    names = sorted(total)
    left, target, level = set(names), {}, 0.0
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    while left:
        level = (sum(total.values()) - sum(target.values())) / sum(weight[s] for s in left)
        over = {s for s in left if 3 * total[s] <= weight[s] * level}
        if not over:
            break
        target |= {s: 3.0 * total[s] for s in over}
        left -= over
    target |= {s: weight[s] * level for s in left}
    taken = Counter()
    for r in found:
        source = docs[r["doc_id"]]["source"]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == total[source]
        assert r["target"] == pytest.approx(target[source])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[source] += r["taken"]
    assert len(found) == len(docs)
    for s in names:
        assert abs(taken[s] - target[s]) <= 2 * max(size[i] for i, d in docs.items() if d["source"] == s)


def test_licence_places_and_personal_data_equal_plain_search(spark):
    from test_licences import plain_places
    from test_pii import plain_base

    docs = {r["doc_id"]: r["text"] or "" for r in Q.table(spark, SF, "documents").collect()}
    for r in Q.op8_license_scan(spark, SF).collect():
        words, places = plain_places(docs[r["doc_id"]])
        starts = [p for p, _ in places]
        assert (r["n_words"], r["n_base"]) == (words, len(places))
        assert (r["first_word"], r["last_word"]) == (min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted({label for _, label in places}))
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""}
    import hashlib

    for r in Q.op10_personal_data(spark, SF).collect():
        base = plain_base(docs[r["doc_id"]])
        listed = ",".join(f"{k}:{s}:{e}" for s, k, e in base)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        counts = Counter(k for _, k, _ in base)
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [counts[k] for k in ("email", "ip", "card", "phone")]
        assert set(filter(None, listed.split(","))) <= set(r["spans"].split(","))
