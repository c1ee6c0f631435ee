import random

from pagemill.llm import ngram_join as N


def shingles(text):
    words = (text or "").lower().split()
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute_force(docs):
    """doc_id to (class, links) by comparing all pairs."""
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}
    links = dict.fromkeys(sets, 0)

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            common = len(sets[a] & sets[b])
            if common and common >= 0.8 * (len(sets[a]) + len(sets[b]) - common) * (1 - 1e-9):
                links[a] += 1
                links[b] += 1
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {i: (top(i), links[i]) for i in ids}


def corpus(seed, n=260):
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choices("abcdefgh", k=draw.randint(2, 6))) for _ in range(400)]
    texts = [" ".join(draw.choices(vocabulary, k=draw.randint(1, 120))) for _ in range(60)]
    rows = []
    for i in range(n):
        words = draw.choice(texts).split()
        for _ in range(draw.choice([0, 0, 1, 2, 5])):
            words[draw.randrange(len(words))] = draw.choice(vocabulary)
        rows.append((i * 3, draw.choice([" ", "  ", "\n"]).join(words)))
    return rows


def test_bands_reach_the_recall():
    for similarity, recall in ((0.8, 0.9999), (0.5, 0.9), (0.95, 0.999)):
        bands, rows = N.choose_bands(similarity, recall, 128)
        assert bands * rows <= 128 and 1 - (1 - similarity**rows) ** bands >= recall


def test_equals_brute_force(spark):
    rows = corpus(1) + [(10_001, ""), (10_002, None), (10_003, " \n"), (10_004, "one two"), (10_005, "One  two")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, bucket int")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in N.near_duplicates(docs).collect()}
    assert got == brute_force(rows)


def test_small_tiles_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(N, "TILE_ROWS", 3)
    rows = corpus(2)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in N.near_duplicates(docs).collect()}
    assert got == brute_force(rows)


def test_one_of_each_group_stays(spark):
    rows = corpus(3) + [(9_000, ""), (9_001, None)]
    want = sorted(i for i, (c, _) in brute_force(rows).items() if i == c)
    docs = spark.createDataFrame([(i, t, "x") for i, t in [*rows, rows[0], (None, "a b c")]], "doc_id long, text string, lang string")
    got = [r["doc_id"] for r in N.keep_one(docs).collect()]
    assert got.count(None) == 1
    assert sorted(i for i in got if i is not None) == want


def test_repeated_and_nameless_rows(spark):
    text = "a b c d e f g h"
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (2, text + " i j k l m n")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["class_id"] or 0, r["n_links"]) for r in N.near_duplicates(docs).collect())
    assert got == [(0, 0, 0), (1, 1, 1), (1, 1, 1), (2, 2, 0)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert N.near_duplicates(docs).count() == 0
    assert N.keep_one(docs).count() == 0


def test_one_id_with_several_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    near, c, d = b + " end", " ".join(f"c{i}" for i in range(40)), " ".join(f"d{i}" for i in range(40))
    rows = [(5, a), (5, b), (3, near), (7, c), (7, d), (7, d), (8, d), (9, ""), (9, None), (9, c + " end"), (None, c)]
    for part in (rows, rows[::-1]):
        docs = spark.createDataFrame([(i, t, 0) for i, t in part], "doc_id int, text string, _n int")
        got = [(r["doc_id"], r["text"]) for r in N.keep_one(docs).collect()]
        want = [(5, a), (3, near), (7, c), (7, d), (9, ""), (9, None), (None, c)]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_repeats_of_one_row_are_cut_before_the_exchange(spark):
    from conftest import plan_of

    docs = spark.createDataFrame([(1, "a b c")] * 50, "doc_id long, text string")
    kept = N.keep_one(docs)
    assert kept.count() == 1
    assert "Partial" in "".join(x for x in plan_of(kept).splitlines() if "WindowGroupLimit" in x)


def test_texts_that_share_an_id_are_fetched_once(spark, monkeypatch):
    """800 texts under one id and 2,000 repeats of one row: as many rows reach the tiles as there are distinct texts."""
    seen = spark.sparkContext.accumulator(0)
    compare = N._compare

    def counting(similarity, n):
        inner = compare(similarity, n)

        def tile(table):
            seen.add(table.num_rows)
            return inner(table)

        return tile

    monkeypatch.setattr(N, "_compare", counting)
    base = " ".join(f"w{k}" for k in range(40))
    rows = [(1, base.replace("w0 ", f"x{k} ", 1)) for k in range(800)] + [(2, base)] * 2000
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = N.near_duplicates(docs).collect()
    assert {r["class_id"] for r in got} == {1} and len(got) == 2800
    assert {r["n_links"] for r in got if r["doc_id"] == 2} == {2799}
    bands, _ = N.choose_bands()
    assert seen.value <= 801 * bands * 5  # four blocks of a bucket at most, not squared
