import hashlib
import random
import zlib

import pytest

from pagemill.llm import queries, runs

PAUSES = " \t\n\x0b\x0c\r"


def brute(words):
    """Every run by comparing all stretches with every lag; the smallest period by trying all."""
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            smallest = next(p for p in range(1, length + 1) if all(words[k] == words[k + p] for k in range(i, i + length - p)))
            if length >= max(6, 4 * q) and smallest == q:
                found.append((i, length, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def texts():
    draw = random.Random(7)
    for k in range(400):
        size = draw.randrange(0, 90)
        yield [draw.choice("abcdefgh"[: 1 + k % 8]) for _ in range(size)]
    for _ in range(150):  # planted runs between noise, also one behind the other
        words = []
        for _ in range(draw.randrange(1, 5)):
            words += [draw.choice("abcdxyz") for _ in range(draw.randrange(0, 6))]
            unit = [draw.choice("abc") for _ in range(draw.randrange(1, 7))]
            words += (unit * 8)[: draw.randrange(1, 8 * len(unit) + 1)]
        yield words
    a, b = ["a"], ["a", "b"]  # words of Fibonacci
    while len(b) < 150:
        a, b = b, b + a
    yield b
    yield ["x"] * 60 + ["y"] + ["x"] * 61
    yield (["x"] * 7 + ["y"]) * 9
    yield ["x", "y"] * 20 + ["y"] + ["x", "y"] * 20


def test_runs_equal_brute_force():
    for words in texts():
        assert [tuple(r) for r in runs.runs_of(words)] == brute(words), words


def test_extension_over_many_steps(monkeypatch):
    monkeypatch.setattr(runs, "STEP", 2)
    for words in texts():
        assert [tuple(r) for r in runs.runs_of(words)] == brute(words), words


def test_segments_are_stable():
    """Splitting goes on inside the parts: no word of a segment is rare in it, and all runs are kept."""
    words = "a b a b a b a b r a b a b a b a b".split()
    assert runs.segments(runs.coded(words)) == [(0, 8), (9, 17)]
    # c occurs four times, but twice on either side of the rare word, so the recursion splits there as well
    words = "c a a a c a a a r a a a c a a a c".split()
    assert runs.segments(runs.coded(words)) == []
    words = "c a a a a a a c r c a a a a a a c".split()
    assert runs.segments(runs.coded(words)) == [(1, 7), (10, 16)]


def test_long_texts_of_few_words():
    words = ["w"] * 200_000
    assert [tuple(r) for r in runs.runs_of(words)] == [(0, 200_000, 1)]
    draw = random.Random(2)
    words = [draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(30_000)] + list("pqr") * 5_000
    found = [tuple(r) for r in runs.runs_of(words)]
    assert max(found, key=lambda r: r[1])[2] == 3 and found == sorted(found)


def expected(doc_id, text):
    for pause in PAUSES:
        text = text.replace(pause, " ")
    words = [w for w in text.split(" ") if w]
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words)
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    dropped = {i for s, m, q in found for i in range(s + q, s + m)}
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *four, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(kept))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_equals_brute_force(spark, tmp_path):
    draw = random.Random(3)
    rows = [(i, draw.choice(PAUSES).join(words), "s") for i, words in enumerate(texts())]
    rows += [(9000, None, "s"), (9001, "", None), (9002, " \n ", "s"), (9003, "a a " * 12, "s"), (None, "z " * 9, "s")]
    rows += rows[40:43] + [(41, "other text under a known id", "s")]
    docs = spark.createDataFrame([(*r, 5, "c") for r in rows], "doc_id long, text string, source string, n_runs int, collapsed string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op13_periodic_runs"](spark, str(tmp_path))
    assert got.columns == COLUMNS
    text = lambda rows: sorted(map(str, rows))
    assert text(tuple(r) for r in got.collect()) == text(expected(i, t or "") for i, t, _ in rows)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, *_ in rows if i is not None) > 20  # some were planted


def test_spans_and_texts_of_the_operator(spark):
    docs = spark.createDataFrame([(1, "so so so so so so it is"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in runs.find_runs(docs).collect()}
    assert got[1]["collapsed"] == "so it is" and [tuple(r) for r in got[1]["runs"]] == [(0, 6, 1)]
    assert got[2]["collapsed"] == "" and got[2]["runs"] == []
    assert runs.find_runs(docs.limit(0)).collect() == []


@pytest.mark.parametrize("text", ["", "a", "a a a a a", "a a a a a a"])
def test_short_texts(text):
    words = runs.words_of(text)
    assert len(runs.runs_of(words)) == (len(words) >= 6)
