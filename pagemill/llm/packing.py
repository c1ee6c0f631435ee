"""Best-fit packing by minimum bin slack.

The work of filling bins depends only on how many pieces there are of each length, a table of at most ``capacity``
rows whatever the corpus. Per bin, a bitset subset-sum over the lengths still there finds the fullest combination
around the largest one; it is taken as often as the counts allow. Spark counts the lengths, ranks the pieces of each
length, and every piece finds its bin from its rank.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator, Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import saved, slices, with_row
from pagemill.llm.tokens import PieceEncoder

CAPACITY = 1024
END_ID = 2
ROWS_PER_PART = 20_000  # ranked together in one window
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def fullest(counts: Mapping[int, int], capacity: int) -> Counter:
    """The combination with the least slack that holds the largest length: how many of each length.

    Bit s of ``reach`` says that lengths tried so far can sum to s; larger lengths are tried first, and the search
    stops when the room can be filled exactly, which leaves the small lengths for later bins.
    """
    largest = max(counts)
    room = capacity - largest
    mask, reach, tried = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        there = min(counts[length] - (length == largest), room // length)
        if there <= 0:
            continue
        tried.append((length, reach))
        step = 1
        while there:
            step = min(step, there)
            reach |= (reach << (step * length)) & mask
            there -= step
            step *= 2
        if reach >> room & 1:
            break
    left, chosen = reach.bit_length() - 1, Counter({largest: 1})
    for length, before in reversed(tried):
        while not before >> left & 1:
            chosen[length] += 1
            left -= length
    return chosen


def plan_bins(counts: Mapping[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Bins for ``counts`` (length to number of pieces): combinations and how often each is used."""
    left = {length: n for length, n in counts.items() if n > 0}
    plan = []
    while left:
        chosen = fullest(left, capacity)
        times = min(left[length] // n for length, n in chosen.items())
        for length, n in chosen.items():
            left[length] -= n * times
            if not left[length]:
                del left[length]
        plan.append((dict(chosen), times))
    return plan


def places(plan: list[tuple[dict[int, int], int]]) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each length, in order of rank: first rank, pieces per bin, first bin, offset in the bin."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    ranked: Counter = Counter()
    first_bin = 0
    for chosen, times in plan:
        offset = 0
        for length in sorted(chosen, reverse=True):
            out.setdefault(length, []).append((ranked[length], chosen[length], first_bin, offset))
            ranked[length] += chosen[length] * times
            offset += length * chosen[length]
        first_bin += times
    return out


def _place(plan: list[tuple[dict[int, int], int]]):
    import numpy as np
    import pyarrow as pa

    table = {length: np.array(rows, dtype=np.int64) for length, rows in places(plan).items()}

    def assign(batches: Iterable) -> Iterator:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("_rank").to_numpy(zero_copy_only=False)
            bins, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for value in np.unique(length):
                at = np.flatnonzero(length == value)
                rows = table[int(value)]
                row = rows[np.searchsorted(rows[:, 0], rank[at], side="right") - 1]
                inside = rank[at] - row[:, 0]
                bins[at] = row[:, 2] + inside // row[:, 1]
                offset[at] = row[:, 3] + inside % row[:, 1] * value
            names = [n for n in batch.schema.names if n != "_rank"]
            columns = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(bins * 2), pa.array(offset)], names=[*names, "sequence_id", "offset"]
            )

    return assign


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to ``pieces``, whose ``length`` (1 to ``capacity``) must not be null.

    Pieces of full length are bins of their own and are not ranked. The others are ranked inside their length over
    parts of bounded size, so a length that a third of all pieces share is spread. Sequence numbers are odd for full
    pieces and even for the rest. Repeated rows are packed one by one; no pieces give no rows.
    """
    names = [n for n in pieces.columns if n not in ("sequence_id", "offset")]
    rows = with_row(pieces.select(*names, F.col("length").cast("long").alias("_length")).drop("length")
                    .withColumnRenamed("_length", "length").select(*names))
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if any(length is None or not 1 <= length <= capacity for length in counts):
        raise ValueError(f"lengths must be between 1 and {capacity}")
    full = rows.filter(F.col("length") == capacity)
    full = full.withColumn("sequence_id", F.col("_row") * 2 + 1).withColumn("offset", F.lit(0).cast("long"))
    rest = {length: n for length, n in counts.items() if length < capacity}
    if not rest:
        return full.select(*names, "sequence_id", "offset")
    parts = max(1, -(-max(rest.values()) // ROWS_PER_PART))
    short = rows.filter(F.col("length") < capacity).withColumn("_part", F.pmod(F.xxhash64("_row"), F.lit(parts)))
    sizes = short.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_part").orderBy("_row")
    ranked = short.withColumn("_rank", F.row_number().over(inside) - 1).join(starts, ["length", "_part"])
    ranked = ranked.select(*names, (F.col("_before") + F.col("_rank")).alias("_rank"))
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([*(f"`{n}` {types[n]}" for n in names), "sequence_id long", "offset long"])
    placed = ranked.mapInArrow(_place(plan_bins(rest, capacity)), schema)
    return placed.unionByName(full.select(*names, "sequence_id", "offset"))


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Token pieces of every whole text: ``doc_id, piece, start, length, ids_crc32``; map-only.

    ``tokenizer`` is the path of a byte-level BPE file, the same on all machines; its added tokens are known
    in the texts. A null text is an empty one and gives the end id alone. Documents over ``capacity`` ids are cut; the first piece takes the remainder.
    """

    def cut(batches: Iterable) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa

        encoder = PieceEncoder(tokenizer, added_tokens=True)
        end = np.array([end_id], "<u4").tobytes()
        for batch in slices(batches):
            out: list[list] = [[], [], [], [], []]
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(texts), strict=True):
                ids += end
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n, capacity), n]
                for piece, (start, stop) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    row = (doc_id, piece, start, stop - start, zlib.crc32(ids[start * 4 : stop * 4]))
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, kinds, strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenize, cut and pack ``docs`` (``doc_id, text``); other columns are not read.

    Rows with a null ``doc_id`` are packed too and keep the null; an empty table gives an empty result.
    """
    return pack(token_pieces(docs, tokenizer, capacity, end_id), capacity)
