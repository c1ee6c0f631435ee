import os

import pytest

import corpus_pipeline as C
from pagemill.llm import pii

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tables = [docs]
    for name, stage in C.STAGES:
        stage(spark, tables[-1], SF).write.parquet(f"{folder}/{name}")
        tables.append(spark.read.parquet(f"{folder}/{name}"))
    return tables


def test_stages_keep_the_columns(staged):
    assert all(t.columns == staged[0].columns for t in staged[:-1])
    assert [name for name, _ in C.STAGES] == ["language_id", "near_duplicates", "personal_data", "mix_sources", "pack"]


def test_clean_documents_pass_the_language_stage(staged):
    assert staged[1].count() >= 0.98 * staged[0].count()


def test_one_of_each_group(staged):
    from test_ngram_join import brute_force

    rows = [(r["doc_id"], r["text"]) for r in staged[1].collect()]
    want = sorted(i for i, (c, _) in brute_force(rows).items() if i == c)
    assert sorted(r["doc_id"] for r in staged[2].collect()) == want


def test_no_base_kind_is_left(staged):
    rows = staged[3].collect()
    assert len(rows) == staged[2].count()
    assert not any(pii.base_spans(r["text"]) for r in rows)
    before = {r["doc_id"]: r["text"] for r in staged[2].collect()}
    touched = [r for r in rows if r["text"] != before[r["doc_id"]]]
    assert touched and all("[" in r["text"] for r in touched)


def test_run_packs_the_mixture(spark, staged):
    got = C.run(spark, SF).collect()
    last = staged[-1].collect()
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, got)) == sorted(map(key, last))
    assert sum(r["length"] for r in got) <= 1024 * len({r["sequence_id"] for r in got})
    copies = staged[4].count()
    assert sum(r["piece"] == 0 for r in got) == copies


ADDED = "_id string, _key string, _row string, _hits string, score double, lang_pred string, _doc string, _rank string, c0 string"


def test_stages_keep_columns_with_clashing_names(spark):
    """Their values stay, whatever the stages call their own columns; nulls, repeated rows and an empty table as well."""
    long = "the house of the man and the dog that was in the garden by the river with many birds and one old tree "
    rows = [(k, f"{long} number {k} {'x y z ' * k} mail me{k}@example.org", "en", f"s{k % 2}") for k in range(12)]
    rows += [(k, t, "en", s) for k, t, _, s in rows[:3]] + [(100, rows[5][1], None, None), (None, long * 2, "en", "s1"), (101, None, "en", "s0")]
    names = [part.split()[0] for part in ADDED.split(", ")]
    values = lambda k: tuple(float(k) + 0.5 if n == "score" else f"mine{k}" for n in names)
    schema = f"{ADDED}, doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(*values(n), *r, len(r[1] or "")) for n, r in enumerate(rows)], schema)
    mine = {values(n) for n in range(len(rows))}
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.schema.simpleString() == docs.schema.simpleString(), name
        got = [tuple(r[n] for n in names) for r in out.collect()]
        assert got and set(got) <= mine, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        if name in ("language_id", "near_duplicates"):
            docs = out
    assert stage.__name__ == "mix_sources"
    assert C.STAGES[-1][1](spark, docs, SF).count() > 0
