import hashlib
import random

import numpy as np

from pagemill.llm import fingerprints as P
from pagemill.llm import queries

LETTERS = "ab cé\U0001f600\0"


def prefix(text):
    return P.Prefix(P.code_points(text))


def plain_hash(text):
    out = 0
    for base in P.BASES:
        h = 0
        for c in text:
            h = (h * base + ord(c) + 1) % P.PRIME
        out = out << P.BITS | h
    return out


def random_text(draw, size):
    return "".join(draw.choice(LETTERS) for _ in range(size))


def test_spans_equal_the_plain_polynomial(monkeypatch):
    draw = random.Random(1)
    for size in (0, 1, 5, 300, P.BLOCK, P.BLOCK + 1, 2 * P.BLOCK + 77):
        text = random_text(draw, size)
        p = prefix(text)
        assert p.whole() == plain_hash(text)
        for _ in range(4):
            i = draw.randrange(size + 1)
            m = draw.randrange(size - i + 1)
            assert int(p.spans(i, i + 1, m)[0]) == plain_hash(text[i : i + m])


def test_shared_start():
    draw = random.Random(2)
    a, b = random_text(draw, 3 * P.BLOCK // 2), random_text(draw, P.BLOCK)
    for kept in (0, 1, P.BLOCK, len(a)):
        both = P.Prefix(P.code_points(b), prefix(a), kept)
        assert all((x == y).all() for x, y in zip(both.arrays, prefix(a[:kept] + b).arrays, strict=True))


def test_common_extensions():
    draw = random.Random(3)
    base = random_text(draw, 500)
    other = base[100:350] + "#" + base[351:]
    a, b = prefix(base), prefix(other)
    starts_a, starts_b = [draw.randrange(501) for _ in range(300)], [draw.randrange(len(other) + 1) for _ in range(300)]
    starts_a += [100 + k for k in range(60)]
    starts_b += list(range(60))
    want = []
    for i, j in zip(starts_a, starts_b, strict=True):
        m = 0
        while i + m < len(base) and j + m < len(other) and base[i + m] == other[j + m]:
            m += 1
        want.append(m)
    assert [P.common_extension(a, i, b, j) for i, j in zip(starts_a, starts_b, strict=True)] == want


def spans(text):
    window = min(P.WINDOW, len(text))
    return {text[i : i + window] for i in range(len(text) - window + 1)} if text else set()


def test_likeness():
    draw = random.Random(4)
    a, b = random_text(draw, 60), random_text(draw, 50)
    pairs = [(a, a), (a, b), (a, a[:40] + b), ("", ""), ("", a), (a[:3], a[:3]), (a[:3], a[:4])]
    for x, y in pairs:  # few spans: exact
        union = spans(x) | spans(y)
        assert P.likeness(P.fingerprint(prefix(x)), P.fingerprint(prefix(y))) == (len(spans(x) & spans(y)) / len(union) if union else 1.0)
    errors = []
    for k in range(40):  # many spans: estimated
        x = random_text(draw, 4000)
        y = x[: 100 * k] + random_text(draw, 4000 - 100 * k)
        want = len(spans(x) & spans(y)) / len(spans(x) | spans(y))
        errors.append(abs(P.likeness(P.fingerprint(prefix(x)), P.fingerprint(prefix(y))) - want))
    assert np.mean(errors) < 0.06 and max(errors) < 0.25
    assert P.likeness(P.fingerprint(prefix("xy" * 3000)), P.fingerprint(prefix("xy" * 2000))) == 1.0  # the same two spans


def test_long_text_in_blocks(monkeypatch):
    text = random_text(random.Random(5), 3 * P.BLOCK)
    mixed = P._mixed(prefix(text).spans(0, len(text) - P.WINDOW + 1, P.WINDOW))
    assert P.sketch(prefix(text)).tolist() == sorted(set(mixed.tolist()))[: P.KEPT]


def expected(rows):
    """Plain version over ``(id, text)`` rows in the documented order."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = []
    for k, (key, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        prints = [P.fingerprint(prefix(t)) for t in (text, edited, after)]
        common = [next((i for i, (x, y) in enumerate(zip(text, t)) if x != y), min(len(text), len(t))) for t in (edited, after)]  # noqa: B905
        out.append((key, len(text), sha(edited), prints[0], prints[1], P.likeness(*prints[:2]), P.likeness(prints[0], prints[2]), *common))
    return out


def run(spark, tmp_path, rows, schema="doc_id long, text string, n_chars long, fingerprint string, _text int"):
    data = spark.createDataFrame([(i, t, 7, "x", 1) for i, t in rows], schema)
    path = f"{tmp_path}/{len(rows)}"
    data.repartition(5).write.parquet(f"{path}/documents.parquet")
    return queries.QUERIES["op12_document_fingerprints"](spark, path)


def test_query_equals_brute_force(spark, tmp_path):
    draw = random.Random(6)
    rows = [(i * 3, random_text(draw, draw.choice((0, 1, 2, 33, 200, 900)))) for i in range(150)]
    rows = [(i, t if i % 60 else rows[5][1]) for i, t in rows] + [(10_000, "copy " * 9), (-4, None), (None, "no id")]
    got = run(spark, tmp_path, rows)
    assert got.columns[:7] == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0)))
    assert sorted(map(str, got.collect())) == sorted(str(r) for r in spark.createDataFrame(expected(ordered), got.schema).collect())


def test_repeated_ids_and_rows(spark, tmp_path):
    rows = [(5, "same text " * 8)] * 40 + [(4, "below " * 9), (6, "above " * 9)]
    got = [tuple(r) for r in run(spark, tmp_path, rows).collect()]
    want = expected([(6, "above " * 9)] + rows[:40] + [(4, "below " * 9)])
    assert sorted(map(str, got)) == sorted(map(str, want))
    both = {r[2] for r in run(spark, tmp_path / "ids", [(1, "a" * 50), (1, "b" * 50)]).collect()}
    assert both == {r[2] for r in expected([(1, "a" * 50), (1, "b" * 50)])}  # two rows: each is the other's next


def test_one_row_and_none(spark, tmp_path):
    assert [tuple(r) for r in run(spark, tmp_path, [(1, "abcde")]).collect()] == expected([(1, "abcde")])
    assert run(spark, tmp_path, []).collect() == []


def test_compare_spans(spark):
    rows = [("abcabc", 0, "abcabd", 0, 5), ("abcabc", 0, "abcabd", 0, 6), ("xab", 1, "ab", 0, 2), ("a", 5, "a", 0, 1), ("a", 0, None, 0, 1), ("é", 0, "é", 0, 9)]
    pairs = spark.createDataFrame([(*r, "old") for r in rows], "text_a string, start_a int, text_b string, start_b int, length int, common string")
    got = [(r["equal"], r["common"]) for r in P.compare_spans(pairs).collect()]
    assert got == [(True, 5), (False, 5), (True, 2), (False, 0), (None, None), (False, 1)]
