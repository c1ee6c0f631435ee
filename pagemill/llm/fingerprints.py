"""Document fingerprints from prefix polynomial hashes.

The prefix array of a text holds, for every place, the polynomial of the code points before it, modulo a prime, for two
bases. The hash of any span follows from two entries, so spans are compared without looking at their text, and the
longest common extension of two places is found by binary search. The hashes of all spans of ``WINDOW`` code points
give the fingerprint: the size and hash of the whole text, and the ``KEPT`` smallest of the mixed span hashes, from which
the likeness of two texts (the share of spans they have in common) is told.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.common import slices
from pagemill.operators.joins import shared_folder

BITS = 31
PRIME = (1 << BITS) - 1
BASES = (1_000_003_133, 1_580_030_173)
BLOCK = 1 << 14  # code points hashed at once
WINDOW = 32  # code points of a span
KEPT = 64  # span hashes of a fingerprint


def _reduced(x):
    """``x`` (below 2**63) modulo the prime."""
    import numpy as np

    x = (x & np.uint64(PRIME)) + (x >> np.uint64(BITS))
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(BITS))
    return np.where(x >= np.uint64(PRIME), x - np.uint64(PRIME), x)


@cache
def _tables(base: int):
    """Powers of a base up to a block, and of its inverse from the first on."""
    import numpy as np

    def powers(factor: int, first: int, count: int):
        out = np.array([first], np.uint64)
        while len(out) < count:
            out = np.concatenate([out, _reduced(out * np.uint64(pow(factor, len(out), PRIME)))])
        return out[:count]

    inverse = pow(base, -1, PRIME)
    return powers(base, 1, BLOCK + 1), powers(inverse, inverse, BLOCK)


def code_points(text: str):
    import numpy as np

    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Prefix:
    """Prefix arrays of a text, one for each base; eight bytes a code point."""

    def __init__(self, codes, before: Prefix | None = None, shared: int = 0):
        """``before`` and ``shared``: another text whose first ``shared`` code points are this one's as well; ``codes``
        are those behind them."""
        import numpy as np

        self.size = shared + len(codes)
        self.arrays = []
        for k, base in enumerate(BASES):
            powers, inverses = _tables(base)
            out = np.zeros(self.size + 1, np.uint32)
            if shared:
                out[: shared + 1] = before.arrays[k][: shared + 1]
            for start in range(0, len(codes), BLOCK):
                part = codes[start : start + BLOCK].astype(np.uint64) + np.uint64(1)
                terms = np.cumsum(_reduced(part * inverses[: len(part)]))
                carry = np.uint64(out[shared + start])
                sums = _reduced(terms) + carry
                out[shared + start + 1 : shared + start + 1 + len(part)] = _reduced(sums * powers[1 : len(part) + 1])
            self.arrays.append(out)

    def spans(self, start: int, stop: int, length: int):
        """Hashes of the spans of one length that start from ``start`` to before ``stop``, 62 bits each."""
        import numpy as np

        both = []
        for base, array in zip(BASES, self.arrays, strict=True):
            low = _reduced(array[start:stop].astype(np.uint64) * np.uint64(pow(base, length, PRIME)))
            both.append(_reduced(array[start + length : stop + length].astype(np.uint64) + np.uint64(PRIME) - low))
        return (both[0] << np.uint64(BITS)) | both[1]

    def whole(self) -> int:
        return int(self.arrays[0][-1]) << BITS | int(self.arrays[1][-1])


def equal_spans(a: Prefix, i: int, b: Prefix, j: int, length: int) -> bool:
    """Whether spans of two texts that start at ``i`` and ``j`` are equal, by their hashes."""
    for base, x, y in zip(BASES, a.arrays, b.arrays, strict=True):
        ends, starts = int(x[i + length]) - int(y[j + length]), int(x[i]) - int(y[j])
        if (ends - starts * pow(base, length, PRIME) if starts else ends) % PRIME:
            return False
    return True


def common_extension(a: Prefix, i: int, b: Prefix, j: int) -> int:
    """Length of the longest equal spans that start at ``i`` and ``j``: binary search on span hashes."""
    low, high = 0, min(a.size - i, b.size - j)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if equal_spans(a, i, b, j, middle) else (low, middle - 1)
    return low


def _mixed(x):
    """Well spread 32-bit numbers from span hashes."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) >> np.uint64(32)


def smallest(values, count: int):
    """The ``count`` smallest different values, or all."""
    import numpy as np

    if len(values) > 8 * count:
        bound = 4 * count * (1 << 32) // len(values)
        while True:
            low = np.unique(values[values < bound])
            if len(low) >= count or bound >= 1 << 32:
                return low[:count]
            bound *= 4
    return np.unique(values)[:count]


def sketch(prefix: Prefix):
    """The smallest mixed hashes of all spans of ``WINDOW`` code points; a shorter text is one span."""
    import numpy as np

    if not prefix.size:
        return np.zeros(0, np.uint64)
    window = min(WINDOW, prefix.size)
    found = np.zeros(0, np.uint64)
    for start in range(0, prefix.size - window + 1, BLOCK):  # so that a long text needs no long temporary arrays
        stop = min(start + BLOCK, prefix.size - window + 1)
        part = smallest(_mixed(prefix.spans(start, stop, window)), KEPT)
        found = smallest(np.concatenate([found, part]), KEPT) if len(found) else part
    return found


def fingerprint(prefix: Prefix) -> str:
    """Size, hash of the whole text and the sketch, in hexadecimal digits."""
    listed = "".join(f"{x:08x}" for x in sketch(prefix).tolist())
    return f"{prefix.size:x}-{prefix.whole():016x}-{listed}"


def likeness(a: str, b: str) -> float:
    """Estimated share of common spans among all spans of two texts, told from their fingerprints alone: 1 for equal
    texts; exact while both texts have at most ``KEPT`` different spans. An empty text is like an empty one only."""
    if a == b:
        return 1.0
    left, right = (s.rsplit("-", 1)[1] for s in (a, b))
    left, right = ({s[i : i + 8] for i in range(0, len(s), 8)} for s in (left, right))
    every = sorted(left | right)
    # beyond the last value of a full sketch nothing is known of its text
    ends = [max(side) for side in (left, right) if len(side) == KEPT]
    seen = [x for x in every if not ends or x <= min(ends)]
    return sum(x in left and x in right for x in seen) / len(seen) if seen else 0.0


class _Document:
    def __init__(self, key, text: str):
        self.key, self.text = key, text
        self.prefix = Prefix(code_points(text))
        self.print = fingerprint(self.prefix)

    def against(self, other: _Document) -> tuple:
        """This document with the end replaced by the start of another, and compared with it."""
        size = self.prefix.size
        kept, moved = size - size // 2, other.text[: size // 2]
        edited = Prefix(code_points(moved), self.prefix, kept)
        edited_print = fingerprint(edited)
        digest = hashlib.sha256((self.text[:kept] + moved).encode("utf-8", "surrogatepass")).hexdigest()
        common = lambda b: common_extension(self.prefix, 0, b, 0)
        return (
            self.key, size, digest, self.print, edited_print, likeness(self.print, edited_print),
            likeness(self.print, other.print), common(edited), common(other.prefix),
        )


NAMES = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "common_edited", "common_next"]
FIGURES = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_edited long, common_next long"
DONE, FIRST, LAST = 0, 1, 2


def _record(rows: list[tuple], key_type, names: list[str]):
    import pyarrow as pa

    kinds = [key_type, pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()]
    columns = [pa.array([r[k] for r in rows], kinds[k]) for k in range(len(names))]
    return pa.RecordBatch.from_arrays(columns, names=names)


def _walk(names: list[str]):
    """Arrow function over sorted rows ``(id, text, part)``: every row against the next; the ends of a partition are
    handed on with their texts."""

    def walk(batches: Iterable) -> Iterator:
        before = part = None
        for piece in slices(batches):
            rows = []
            for key, text, at in zip(piece.column(0).to_pylist(), piece.column(1), piece.column(2).to_pylist(), strict=True):
                now = _Document(key, text.as_py())
                if before is None:
                    part = at
                    rows.append((None, *[None] * 8, FIRST, part, now.text))
                else:
                    rows.append((*before.against(now), DONE, part, None))
                before = now
            if rows:
                yield _record(rows, piece.schema.field(0).type, names)
                kind = piece.schema.field(0).type
        if before is not None:
            yield _record([(before.key, *[None] * 8, LAST, part, before.text)], kind, names)

    return walk


def _pairs(names: list[str]):
    """Arrow function over rows ``(id, text, next text)``."""

    def compare(batches: Iterable) -> Iterator:
        for piece in slices(batches, 1):
            row = [piece.column(k)[0].as_py() for k in range(3)]
            yield _record([_Document(row[0], row[1]).against(_Document(None, row[2]))], piece.schema.field(0).type, names)

    return compare


def edited_fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None
) -> DataFrame:
    """Every row of ``docs`` and its edited text (the later half replaced by the start of the next row's text):
    the id, ``n_chars, edited_sha256, fingerprint, edited_fingerprint``, ``near_edited`` and ``near_next``, the likeness of
    its fingerprint to the edited text's and the next row's, and ``common_edited`` and ``common_next``, the code points
    they begin with in common.

    The next row is that with the next smaller id; null ids come last, rows with one id in the order of a hash of their
    text, equal rows behind each other; after the last row comes the first, so a single row is its own next. A null
    text is empty. Other columns are not read. An empty table gives no rows.

    Texts are shuffled once, by ranges of the id, and each task walks its sorted rows. The result is written to
    ``folder`` (by default a new one in the shared folder), together with the first and last text of every partition;
    those are compared afterwards.
    """
    spark = docs.sparkSession
    kind = {f.name: f.dataType.simpleString() for f in docs.schema}[id_col]
    folder = folder or f"{shared_folder(spark)}/fingerprints-{uuid.uuid4().hex}"
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), text.alias("_text"), F.xxhash64(text).alias("_hash"), F.spark_partition_id().alias("_from"))
    order = [F.col(id_col).desc_nulls_last(), F.col("_hash"), F.col("_from")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = dealt.select(id_col, "_text", F.spark_partition_id().alias("_part"))
    done_names, all_names = [id_col, *NAMES], [id_col, *NAMES, "_kind", "_part", "_text"]
    schema = f"`{id_col}` {kind}, {FIGURES}"
    walked = dealt.mapInArrow(_walk(all_names), f"{schema}, _kind int, _part int, _text string")
    walked.write.option("compression", "zstd").partitionBy("_kind").parquet(folder)
    table = spark.read.schema(walked.schema).parquet(folder)

    firsts, lasts = table.filter(F.col("_kind") == FIRST), table.filter(F.col("_kind") == LAST)
    filled = sorted(r["_part"] for r in firsts.select("_part").collect())  # one number per partition
    after = list(zip(filled, filled[1:] + filled[:1], strict=True))
    followed = spark.createDataFrame(after, T.StructType([T.StructField(n, T.IntegerType()) for n in ("_part", "_then")]))
    ends = lasts.select(id_col, "_text", "_part").join(F.broadcast(followed), "_part")
    ends = ends.join(firsts.select(F.col("_part").alias("_then"), F.col("_text").alias("_next")), "_then")
    rest = ends.select(id_col, "_text", "_next").mapInArrow(_pairs(done_names), schema)
    return table.filter(F.col("_kind") == DONE).select(*done_names).unionByName(rest)


def compare_spans(pairs: DataFrame) -> DataFrame:
    """``pairs`` (``text_a, start_a, text_b, start_b, length``; places from 0) with ``equal``, whether the spans of that
    length are equal, and ``common``, the longest equal spans from there. A span that does not lie in its text is equal
    to none, and a place outside has nothing in common; any null gives nulls. Map-only. Columns named ``equal`` and
    ``common`` are replaced."""
    kept = [n for n in pairs.columns if n not in ("equal", "common")]
    types = {f.name: f.dataType.simpleString() for f in pairs.schema}
    asked = [kept.index(n) for n in ("text_a", "start_a", "text_b", "start_b", "length")]

    def judge(a, i, b, j, length):
        if None in (a, i, b, j, length):
            return None, None
        if not (0 <= i <= len(a) and 0 <= j <= len(b)):
            return False, 0
        left, right = Prefix(code_points(a)), Prefix(code_points(b))
        inside = length >= 0 and i + length <= left.size and j + length <= right.size
        same = inside and equal_spans(left, i, right, j, length)
        return same, common_extension(left, i, right, j)

    def add(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for piece in slices(batches):
            found = [judge(*[piece.column(k)[r].as_py() for k in asked]) for r in range(piece.num_rows)]
            columns = [pa.array([f[k] for f in found], (pa.bool_(), pa.int64())[k]) for k in range(2)]
            yield pa.RecordBatch.from_arrays([*piece.columns, *columns], names=[*kept, "equal", "common"])

    schema = ", ".join([*(f"`{n}` {types[n]}" for n in kept), "equal boolean", "common long"])
    return pairs.select(*kept).mapInArrow(add, schema)
