"""Language identification by words first: known words score by their log frequency in each language, unseen ones
by the longest character n-grams that are known.

The classifier is fitted on a bounded sample of labelled rows (``SAMPLE_CHARS`` characters of whole texts a language,
documented here); everything else covers all rows. The model holds ``WORDS`` words and ``GRAMS`` n-grams a length for each
language, stored sparsely, so it grows in proportion to the number of languages.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import plain_names, saved, slices

SAMPLE_CHARS = 4_000_000  # expected characters of the fitted sample, per language
WORDS = 20_000  # most frequent words kept per language
GRAMS = 20_000  # most frequent n-grams kept per language and length
CELLS = 8_000_000  # scores of all languages in the vectors at hand
CHUNK = 4096  # words of a text scored at once
LONGEST = 4  # characters of the longest n-gram
UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")
CACHED = 200_000  # words whose vector is kept at hand
LEAST_SCORE = 0.35  # under which a document of the pipeline is rejected
EVIDENCE = 20  # words after which more of them make the score no surer


def grams(word: str, n: int) -> list[str]:
    """The n-grams of a word between its marked ends."""
    word = f"<{word}>"
    return [word[i : i + n] for i in range(len(word) - n + 1)]


def _counts(batches: Iterable) -> Iterator:
    """Partial counts of words (n = 0) and n-grams per language, one row each per slice."""
    import pyarrow as pa

    for batch in slices(batches, 512):
        words: dict[str, Counter] = {}
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words.setdefault(lang, Counter()).update(LETTERS.findall(text.lower()))
        langs, sizes, items, counts = [], [], [], []
        for lang, found in words.items():
            parts = [found, *(Counter() for _ in range(LONGEST))]
            for word, times in found.items():
                for n in range(1, LONGEST + 1):
                    for gram in grams(word, n):
                        parts[n][gram] += times
            for n, part in enumerate(parts):
                langs += [lang] * len(part)
                sizes += [n] * len(part)
                items += part.keys()
                counts += part.values()
        yield pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array(sizes, pa.int32()), pa.array(items, pa.string()),
             pa.array(counts, pa.int64())], names=["lang", "n", "item", "times"])


class Model:
    """Log frequencies of words (length 0) and n-grams by length, each with the languages that have it; ``absent`` holds, by
    length and language, the value of what a language has not."""

    def __init__(self, langs: list[str], tables: list[dict[str, tuple]], absent: list[list[float]]):
        self.langs, self.tables, self.absent = langs, tables, absent

    def ready(self, cached: int = CACHED):
        import numpy as np

        slots = max(CHUNK, min(cached, CELLS // max(1, len(self.langs))))
        self.vectors = np.zeros((slots, len(self.langs)), np.float64)
        self.index: dict[str, int] = {}
        return self

    def vector(self, word: str) -> list[float]:
        """Log frequencies of a known word; else the mean of the known n-grams of the longest length that has any; else
        of an absent character."""
        found, n = [self.tables[0][word]] if word in self.tables[0] else [], 0
        lengths = iter(range(LONGEST, 0, -1))
        while not found:
            n = next(lengths, 0)
            if not n:
                return self.absent[1]
            found = [self.tables[n][g] for g in grams(word, n) if g in self.tables[n]]
        absent = self.absent[n]
        more = [0.0] * len(absent)
        for places, values in found:
            for place, value in zip(places, values, strict=True):
                more[place] += value - absent[place]
        return [a + m / len(found) for a, m in zip(absent, more, strict=True)]

    def place(self, word: str) -> int:
        at = self.index.get(word)
        if at is None:
            at = self.index[word] = len(self.index)
            self.vectors[at] = self.vector(word)
        return at

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language of a whole text and how sure it is; ties go to the first language in code point order."""
        import numpy as np

        found = LETTERS.findall((text or "").lower())
        if not self.langs or not any(c.isalpha() for w in found for c in w):
            return UNKNOWN, 0.0
        total = np.zeros(len(self.langs))
        for start in range(0, len(found), CHUNK):
            part = found[start : start + CHUNK]
            if len(self.index) + len(part) > len(self.vectors):
                self.index.clear()  # between chunks only: the vectors of a chunk stay until it is summed
            total += self.vectors[[self.place(w) for w in part]].sum(axis=0)
        mean = total / len(found) * min(len(found), EVIDENCE)
        odds = np.exp(mean - mean.max())
        best = int(np.argmax(odds))
        return self.langs[best], float(odds[best] / odds.sum())


def fit(labelled: DataFrame, id_col: str = "doc_id", sample_chars: int = SAMPLE_CHARS) -> Model:
    """Fit a model on ``labelled`` (``text``, ``lang`` and the id, used for sampling alone).

    Rows without text or language are left out. A language with more than ``sample_chars`` characters gives the share
    of its rows that has that many, chosen by a hash of id and text. An empty table gives a model that only says
    ``und``.
    """
    import math

    rows = labelled.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang", id_col)
    sizes = rows.groupBy("lang").agg(F.sum(F.length("text")).alias("n")).collect()  # one row per language
    if not sizes:
        return Model([], [{} for _ in range(LONGEST + 1)], [[] for _ in range(LONGEST + 1)])
    share = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1.0, sample_chars / max(r["n"], 1))))])
    draw = F.pmod(F.xxhash64(id_col, "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.filter(draw < share[F.col("lang")]).select("text", "lang")
    counts = sample.mapInArrow(_counts, "lang string, n int, item string, times long")
    counts = saved(counts.groupBy("lang", "n", "item").agg(F.sum("times").alias("times")))
    totals = {(r["lang"], r["n"]): r["t"] for r in counts.groupBy("lang", "n").agg(F.sum("times").alias("t")).collect()}
    by = Window.partitionBy("lang", "n").orderBy(F.col("times").desc(), "item")
    kept = F.when(F.col("n") == 0, F.lit(WORDS)).otherwise(F.lit(GRAMS))
    frequent = counts.withColumn("_k", F.row_number().over(by)).filter(F.col("_k") <= kept).drop("_k")
    langs = sorted({r["lang"] for r in sizes})
    column = {lang: k for k, lang in enumerate(langs)}
    absent = [[math.log(0.5 / (totals.get((lang, n), 0) + 1)) for lang in langs] for n in range(LONGEST + 1)]
    tables: list[dict[str, tuple]] = [{} for _ in range(LONGEST + 1)]
    for r in frequent.collect():  # at most WORDS + LONGEST * GRAMS rows per language
        places, values = tables[r["n"]].get(r["item"], ((), ()))
        value = math.log(r["times"] / (totals[r["lang"], r["n"]] + 1))
        tables[r["n"]][r["item"]] = ((*places, column[r["lang"]]), (*values, value))
    return Model(langs, tables, absent)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` added, from ``text_col`` alone; map-only.

    A null text or one without a letter is ``und`` with score 0. Columns with the added names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [n for n in docs.columns if n not in ("lang_pred", "score")]
    at = names.index(text_col)
    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*(f"`{n}` {types[n]}" for n in names), "lang_pred string", "score double"])

    def add(batches: Iterable) -> Iterator:
        import pyarrow as pa

        ready = shared.value.ready()
        for batch in slices(batches):
            found = [ready.predict(text) for text in batch.column(at).to_pylist()]
            langs, scores = [x[0] for x in found], [x[1] for x in found]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=[*batch.schema.names, "lang_pred", "score"])

    return docs.select(*names).mapInArrow(add, schema)


def held_out(id_col: Column) -> Column:
    """The rows kept from fitting: crc32 of the id as text leaves 2 by 4. A null id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def keep_identified(docs: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """``docs`` without those whose language is ``und`` or less sure than ``least_score``, fitted on ``docs`` itself.

    Every other row stays with its columns as they are; a missing ``lang`` is filled with the predicted one.
    """
    model = fit(docs.filter(~held_out(F.col("doc_id"))))
    rows, names = plain_names(docs)
    found = predict(rows, model, names["text"]).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score))
    filled = found.withColumn(names["lang"], F.coalesce(names["lang"], "lang_pred"))
    return filled.select(*names.values()).toDF(*docs.columns)
