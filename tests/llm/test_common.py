import random

import pytest

pa = pytest.importorskip("pyarrow")

from pagemill.llm import common, mixing  # noqa: E402


def test_slices_are_bounded_in_rows_and_bytes():
    draw = random.Random(3)
    sizes = [draw.choice((0, 1, 50, 3000, 20_000)) for _ in range(700)]
    texts = [None if n == 1 else "x" * n for n in sizes]
    batches = [pa.record_batch({"n": list(range(i, min(i + 333, 700))), "t": pa.array(texts[i : i + 333], pa.string())}) for i in range(0, 700, 333)]
    pieces = list(common.slices([*batches, batches[0].slice(0, 0)], 64, 10_000))
    assert [n for p in pieces for n in p.column(0).to_pylist()] == list(range(700))
    assert [t for p in pieces for t in p.column(1).to_pylist()] == texts
    assert all(0 < p.num_rows <= 64 and (p.num_rows == 1 or p.nbytes <= 10_000) for p in pieces)


def test_mixture_is_written_where_it_is_told(spark, tmp_path):
    docs = spark.createDataFrame([(i, "a", "w " * (i + 1)) for i in range(9)], "doc_id long, source string, text string")
    folder = f"{tmp_path}/mixed"
    got = mixing.mix_documents(docs, folder)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, mixing.mix_documents(docs).collect()))
    assert spark.read.parquet(folder).count() == 9
