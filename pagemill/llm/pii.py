"""Personal data by bootstrapped contextual extraction.

Seeds (e-mail and IP addresses, card and phone numbers, long hexadecimal secrets) are found by their form. Every seed
and every other token that looks like an identifier stands in a lexical pattern, the items to its left. Spark scores the
graph of patterns and instances in rounds: patterns by the share of trusted instances among all they take, instances
by the patterns that take them. Patterns of high confidence then mark identifiers of unseen form.

The accepted patterns are a saved table. Tasks get all of them while they are few; beyond that the candidates of the
texts are joined to the table, with the same result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import count
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import plain_names, saved, slices, with_row
from pagemill.operators.joins import lookup_join

KINDS = ("email", "ip", "card", "phone", "secret", "id")
BASE = 4  # the first kinds are the base ones
SUPPORT = 5  # trusted instances a pattern needs
SHARED = 100_000  # accepted patterns that tasks hold in memory; more are joined
CONFIDENCE = 0.6  # trusted share of a pattern's instances
TRUST = 0.8  # score from which an instance counts as trusted
CONTEXT = 2  # items of a pattern
WINDOW = 100  # characters to the left in which they are looked for

INTERESTING = re.compile("[0-9@]")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# The look behind keeps long runs of digits linear: a match can only begin where a run does.
IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile("[0-9]")
TOKEN = re.compile(r"[A-Za-z0-9][A-Za-z0-9._/+-]*+")
HEX = re.compile("[0-9a-f]{16,}")
ITEM = re.compile(r"[^\W\d_]+|[^\w\s]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            end = match.end()
            yield start, end
        at = text.find("@", match.end() if match else at + 1)


def _luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds in code points, by start, then kind. Linear in the text."""
    if not INTERESTING.search(text):
        return []
    spans = [(start, 0, end) for start, end in _emails(text)]
    for m in IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m[0].split(".")):
            spans.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            spans.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(DIGITS.findall(m[0])) <= 15:
                spans.append((m.start(), 3, m.end()))
    return sorted(spans)


def _pattern(text: str, start: int) -> int:
    """Hash of the items to the left: words in lower case, other signs for themselves."""
    import xxhash

    items = ITEM.findall(text, max(0, start - WINDOW), start)
    left = "\x00".join(items[-CONTEXT:]).lower() if items else ""
    return xxhash.xxh3_64_intdigest(left) - (1 << 63)


@dataclass
class Occurrence:
    start: int
    end: int
    kind: int
    seed: bool
    pattern: int
    instance: int


def occurrences(text: str) -> tuple[list[tuple[int, int, int]], list[Occurrence]]:
    """Base spans, and every seed or identifier-like token with its pattern.

    Identifier-like is a token of at least 6 characters with 4 digits that no base span overlaps; one of 16 or more
    hexadecimal digits, letters and numerals among them, is a seed.
    """
    import xxhash

    base = base_spans(text)
    found = [(start, end, kind, True) for start, kind, end in base]
    if INTERESTING.search(text):
        taken = sorted((start, end) for start, _, end in base)
        k = reach = 0
        for m in TOKEN.finditer(text):
            start, end = m.span()
            while end > start and text[end - 1] in "._/+-":
                end -= 1
            if end - start < 6 or len(DIGITS.findall(text, start, end)) < 4:
                continue
            while k < len(taken) and taken[k][0] < end:
                reach = max(reach, taken[k][1])
                k += 1
            if reach > start:
                continue
            value = text[start:end]
            secret = bool(HEX.fullmatch(value)) and not value.isdigit()
            found.append((start, end, 4 if secret else 5, secret))
    out = []
    for start, end, kind, seed in found:
        instance = xxhash.xxh3_64_intdigest(text[start:end].lower()) - (1 << 63)
        out.append(Occurrence(start, end, kind, seed, _pattern(text, start), instance))
    return base, out


def pattern_graph(docs: DataFrame) -> DataFrame:
    """Distinct pairs ``(pattern, instance, seed)`` of the whole corpus, hashed; an instance that is a seed anywhere
    in a pair's occurrences is one in the pair."""

    def pairs(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches):
            found: dict[tuple[int, int], bool] = {}
            for text in batch.column(0).to_pylist():
                for o in occurrences(text or "")[1]:
                    found[o.pattern, o.instance] = o.seed or found.get((o.pattern, o.instance), False)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([p for p, _ in found], pa.int64()),
                    pa.array([i for _, i in found], pa.int64()),
                    pa.array(list(found.values()), pa.bool_()),
                ],
                names=["pattern", "instance", "seed"],
            )

    edges = docs.select("text").mapInArrow(pairs, "pattern long, instance long, seed boolean")
    return edges.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"))


def accepted_patterns(docs: DataFrame, rounds: int | None = None) -> DataFrame:
    """Saved table ``(pattern, confidence)`` of the patterns accepted over the pattern-instance graph of all texts, by
    rounds until no more are accepted (or ``rounds`` of them). Trust and patterns only ever grow, so the rounds end.

    A pattern's confidence is the trusted share of its distinct instances. It is accepted with ``SUPPORT`` trusted
    instances, however many others there are. An instance is trusted if it is a seed, or if the accepted patterns that
    take it leave at most 1 - ``TRUST`` doubt together. Nothing but two sums per round reaches the driver.
    """
    edges = saved(pattern_graph(docs).withColumn("trusted", F.col("seed")))
    mark = None
    for _ in count() if rounds is None else range(rounds):
        trusted = F.sum(F.col("trusted").cast("long"))
        scored = edges.groupBy("pattern").agg(trusted.alias("f"), F.count(F.lit(1)).alias("n"))
        good = scored.filter((F.col("f") >= SUPPORT) & (F.col("f") >= CONFIDENCE * F.col("n")))
        good = saved(good.select("pattern", (F.col("f") / F.col("n")).alias("confidence")))
        hashes = F.sum(F.xxhash64("pattern").cast("decimal(38,0)"))
        now = tuple(good.agg(F.count(F.lit(1)), hashes).first())
        if now == mark:
            break
        mark = now
        doubt = F.log(F.lit(1.0) - F.least(F.col("confidence"), F.lit(0.999)))
        taken = lookup_join(edges, good, ["pattern"], "inner", materialized=True)
        taken = taken.groupBy("instance").agg(F.sum(doubt).alias("_doubt"))
        sure = taken.filter(F.exp("_doubt") <= 1 - TRUST).select("instance", F.lit(True).alias("_sure"))
        edges = saved(
            edges.join(sure, "instance", "left")
            .withColumn("trusted", F.col("seed") | F.coalesce("_sure", F.lit(False)))
            .drop("_sure")
        )
    return good


def learn_patterns(docs: DataFrame, rounds: int | None = None) -> list[int]:
    """Hashes of the accepted patterns in order, on the driver: for tables with few of them."""
    return sorted(r["pattern"] for r in accepted_patterns(docs, rounds).select("pattern").collect())


def all_spans(text: str, accepted: frozenset[int]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and base and discovered spans together, as (start, kind, end) by start, then kind."""
    base, found = occurrences(text)
    more = [(o.start, o.kind, o.end) for o in found if o.kind >= BASE and o.pattern in accepted]
    return base, sorted(base + more)


def _with_hits(docs: DataFrame, accepted: list[int] | DataFrame, text: str) -> tuple[DataFrame, list[int]]:
    """``docs`` with ``_hits``, the accepted patterns its text has where they are joined (else null), and the patterns
    that go to all tasks.

    A table of more than ``SHARED`` patterns is joined with the distinct patterns of every row's candidates; the hits
    come back by row number. Both ways give the same spans.
    """
    if isinstance(accepted, DataFrame):
        few = accepted.select("pattern").limit(SHARED + 1).collect()
        if len(few) > SHARED:
            return _joined_hits(docs, accepted.select("pattern").distinct(), text), []
        accepted = [r["pattern"] for r in few]
    return docs.withColumn("_hits", F.lit(None).cast("array<long>")), accepted


def _joined_hits(docs: DataFrame, accepted: DataFrame, text: str) -> DataFrame:
    rows = with_row(docs)

    def candidates(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches):
            numbers, patterns = [], []
            for number, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = {o.pattern for o in occurrences(text or "")[1] if o.kind >= BASE}
                numbers += [number] * len(own)
                patterns += own
            yield pa.RecordBatch.from_arrays(
                [pa.array(numbers, pa.int64()), pa.array(patterns, pa.int64())], names=["_row", "pattern"]
            )

    found = saved(rows.select("_row", text).mapInArrow(candidates, "_row long, pattern long"))
    hits = lookup_join(found, accepted, ["pattern"], "left_semi")
    hits = hits.groupBy("_row").agg(F.collect_list("pattern").alias("_hits"))  # of one text
    return lookup_join(rows, hits, ["_row"]).drop("_row")


def find_personal_data(docs: DataFrame, accepted: list[int] | DataFrame) -> DataFrame:
    """``doc_id`` with ``base`` and ``spans``, arrays of (start, kind, end) in code points.

    ``accepted`` is a list of patterns or a table of them; up to ``SHARED`` of them this is map-only. A null text is
    empty. Every row gives one row, repeated ones too; other columns are not read.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    docs, accepted = _with_hits(docs.select("doc_id", "text"), accepted, "text")
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(accepted))
    span = "array<struct<start: long, kind: string, end: long>>"

    def find(batches: Iterable) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))
        for batch in slices(batches):
            found = [
                all_spans(text or "", shared.value if hits is None else frozenset(hits))
                for text, hits in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            ]
            columns = [
                pa.array([[{"start": s, "kind": KINDS[k], "end": e} for s, k, e in f[which]] for f in found], kind)
                for which in (0, 1)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "base", "spans"])

    return docs.select("doc_id", "text", "_hits").mapInArrow(find, f"doc_id {id_type}, base {span}, spans {span}")


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with every span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    parts, done = [], 0
    for start, kind, end in spans:
        if start >= done:
            parts += [text[done:start], f"[{KINDS[kind].upper()}]"]
        done = max(done, end)
    return "".join([*parts, text[done:]])


def redact_documents(docs: DataFrame, accepted: list[int] | DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced and ``n_chars``, where there is one, counted anew.

    ``accepted`` is a list of patterns or a table of them; up to ``SHARED`` of them this is map-only. All other columns
    and all rows stay as they are; a null text stays null.
    """
    rows, names = plain_names(docs)
    schema, at, text = rows.schema, docs.columns.index("text"), names["text"]
    given, accepted = _with_hits(rows, accepted, text)
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(accepted))

    def clean(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches):
            texts = [
                x and redact(x, all_spans(x, shared.value if hits is None else frozenset(hits))[1])
                for x, hits in zip(batch.column(at).to_pylist(), batch.column(len(schema)).to_pylist(), strict=True)
            ]
            columns = list(batch.columns)[:-1]
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    cleaned = given.select(*names.values(), "_hits").mapInArrow(clean, schema)
    if "n_chars" in names:
        n_chars = names["n_chars"]
        chars = F.coalesce(F.length(text).cast(schema[n_chars].dataType), F.col(n_chars))
        cleaned = cleaned.withColumn(n_chars, chars)
    return cleaned.toDF(*docs.columns)
