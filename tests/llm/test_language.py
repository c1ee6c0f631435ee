import copy
import math
import random

from pyspark.sql import functions as F

from pagemill.llm import language as L

TEXT = {"en": "the house of the man and the dog that was in the garden", "fr": "la maison de le chien qui est dans les jardins avec une", "xx": "zzyzx qqu vvax kkol zzyzx wwob"}


def docs(spark):
    rows = [(i, TEXT[lang] + f" {i}", lang, 0.5) for i, lang in enumerate(list(TEXT) * 40)]
    rows += [(900, None, "en", 0.1), (901, "", None, 0.2), (902, "12 34 ²½ !?", "en", 0.3), (903, "gardening housed", None, 0.4), (904, "gardening housed", None, 0.4)]
    rows += [(None, "le chien", "fr", None), (905, "the dog " * 20_000, None, 0.9)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")


def test_prediction(spark):
    table = docs(spark)
    model = L.fit(table.filter(~L.held_out(F.col("doc_id"))))
    assert model.langs == ["en", "fr", "xx"]
    got = {r["doc_id"]: r for r in L.predict(table, model).collect()}
    assert len(got) == table.count()
    assert all(got[i]["lang_pred"] == lang for i, lang in enumerate(list(TEXT) * 40))
    assert [got[i]["lang_pred"] for i in (900, 901, 902, 903, 904, 905, None)] == ["und", "und", "und", "en", "en", "en", "fr"]
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[900]["score"] == 0.0


def test_only_text_decides(spark):
    table = docs(spark)
    model = L.fit(table)
    other = table.withColumn("lang", F.lit("fr")).withColumn("doc_id", F.col("doc_id") + 77)
    a = sorted((r["text"] or "", r["lang_pred"], r["score"]) for r in L.predict(table, model).collect())
    assert a == sorted((r["text"] or "", r["lang_pred"], r["score"]) for r in L.predict(other, model).collect())


def plain_score(model, text):
    """Every word by itself, in double precision sums over all words."""
    total, found = [0.0] * len(model.langs), L.LETTERS.findall(text.lower())
    for word in found:
        known, n = model.tables[0].get(word), 0
        parts = [known] if known else []
        for n in () if known else range(L.LONGEST, 0, -1):
            parts = [model.tables[n][g] for g in L.grams(word, n) if g in model.tables[n]]
            if parts:
                break
        for k in range(len(total)):
            if parts:
                own = [dict(zip(*p, strict=True)).get(k, model.absent[n][k]) for p in parts]
                total[k] += sum(own) / len(own)
            else:
                total[k] += model.absent[1][k]
    mean = [t / len(found) * min(len(found), L.EVIDENCE) for t in total]
    odds = [math.exp(m - max(mean)) for m in mean]
    best = odds.index(max(odds))
    return model.langs[best], odds[best] / sum(odds)


def test_full_cache_changes_nothing(spark):
    """Texts with more different words than the cache has places, and with different vectors, one after the other."""
    draw = random.Random(1)
    word = lambda: "".join(draw.choice("abcdefghijklmnopqrstuvwz") for _ in range(draw.randrange(1, 8)))
    model = L.fit(docs(spark))
    texts = [" ".join(word() for _ in range(draw.choice((1, 40, 9000)))) for _ in range(30)] + list(TEXT.values())
    small, large = copy.copy(model).ready(4096), copy.copy(model).ready(10_000_000)
    assert len(small.vectors) == 4096 < len(large.vectors)
    for text in texts:
        want = plain_score(model, text)
        for got in (small.predict(text), large.predict(text)):
            assert got[0] == want[0] and abs(got[1] - want[1]) < 1e-9


def test_many_languages_keep_their_words(spark):
    rows = [(100 * k + i, f"word{chr(97 + k % 26)}{chr(97 + k // 26)}x common", f"l{k:03d}") for k in range(300) for i in range(2)]
    model = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.langs) == 300 and len(model.tables[0]) == 301
    ready = model.ready()
    assert all(ready.predict(text)[0] == lang for _, text, lang in rows[::20])


def test_sample_keeps_whole_rows_of_every_language(spark):
    model = L.fit(docs(spark), sample_chars=600)
    assert model.langs == ["en", "fr", "xx"] and 0 < len(model.tables[0])


def test_rejected_documents_go(spark):
    table = docs(spark)
    kept = L.keep_identified(table)
    assert kept.columns == table.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert {900, 901, 902} & ids == set() and ids >= set(range(120)) | {903, 905, None}
    assert {r["lang"] for r in kept.filter("doc_id in (903, 904, 905)").collect()} == {"en"}


def test_nothing_to_learn(spark):
    table = docs(spark).limit(0)
    model = L.fit(table)
    assert L.predict(table, model).count() == 0
    assert {r["lang_pred"] for r in L.predict(docs(spark), model).collect()} == {"und"}
