"""N-gram Jaccard join: MinHash bands find candidates, full n-gram sets verify them.

1. Texts that are equal word for word become one text with a number of copies.
2. Every text gets a signature; ``bands`` hashes of ``rows`` minima each, chosen for the target recall.
3. Texts are dealt by band hash. Buckets with the same members are kept once, so that most near copies meet once.
4. A bucket is cut into tiles of bounded rows and bytes; a tile compares the n-gram sets of its texts and returns, for
   each text, its links and one edge to the smallest text it hangs together with. No pair leaves a tile. A pair that
   meets in several buckets counts in the smallest of them.
5. Connected components over these edges are the classes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.common import connected_components, plain_names, saved, slices

SHINGLE = 5  # words
SIMILARITY = 0.8
RECALL = 0.9999  # of pairs just at the similarity
PERMUTATIONS = 128
TILE_ROWS = 256  # of a bucket in one block; a tile has two blocks
TILE_CHARS = 8 << 20


def choose_bands(similarity: float = SIMILARITY, recall: float = RECALL, permutations: int = PERMUTATIONS) -> tuple:
    """(bands, rows): the most rows per band for which pairs at ``similarity`` meet with ``recall``."""
    for rows in range(permutations, 0, -1):
        bands = permutations // rows
        if 1 - (1 - similarity**rows) ** bands >= recall:
            return bands, rows
    raise ValueError("no bands reach this recall")


def words(text: str) -> list[str]:
    """Words of a text: what white space parts, in lower case."""
    return text.lower().split()


class Shingler:
    """64-bit hashes of the word n-grams of a text; word hashes are cached up to a bound."""

    def __init__(self, n: int = SHINGLE, cached: int = 200_000):
        self.n, self.cached, self.seen = n, cached, {}

    def _hashes(self, found: list[str]):
        import numpy as np
        import xxhash

        if len(self.seen) > self.cached:
            self.seen = {}
        seen = self.seen
        for word in set(found).difference(seen):
            seen[word] = xxhash.xxh3_64_intdigest(word)
        return np.fromiter(map(seen.__getitem__, found), np.uint64, len(found))

    def shingles(self, found: list[str]):
        """Distinct hashes in order; a text of fewer than n words has one n-gram, all of it, and no words give none."""
        import numpy as np

        if not found:
            return np.zeros(0, np.uint64)
        hashes = self._hashes(found)
        n = min(self.n, len(found))
        size = len(hashes) - n + 1
        mixed = np.full(size, n, np.uint64)
        for k in range(n):
            mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + size]
        mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        return np.unique(mixed ^ (mixed >> np.uint64(27)))


def _signatures(bands: int, rows: int, n: int):
    """Arrow function: text key, length and band hashes of each row."""
    import numpy as np

    def sign(batches: Iterable) -> Iterator:
        import pyarrow as pa

        draw = np.random.default_rng(20_240_501)
        scale = draw.integers(1 << 62, size=bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        shift = draw.integers(1 << 62, size=bands * rows, dtype=np.uint64)
        weight = draw.integers(1 << 62, size=rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        number = np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        shingler = Shingler(n)

        def minima(hashes):
            low = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
            for start in range(0, len(hashes), 256):
                part = hashes[start : start + 256, None] * scale + shift
                np.minimum(low, part.min(axis=0), out=low)
            return low >> np.uint64(20)

        for batch in slices(batches):
            keys, chars, every = [], [], []
            for text in batch.column(1).to_pylist():
                found = words(text or "")
                keys.append(text_key(found))
                chars.append(len(text or ""))
                if found:
                    mixed = (minima(shingler.shingles(found)).reshape(bands, rows) * weight).sum(axis=1) + number
                    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                    every.append((mixed ^ (mixed >> np.uint64(32))).view(np.int64))
                else:
                    every.append(None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array(keys, pa.int64()),
                    pa.array(chars, pa.int64()),
                    pa.array(every, pa.list_(pa.int64())),
                ],
                names=["doc_id", "hash", "key", "chars", "bands"],
            )

    return sign


def _texts(table) -> list[str]:
    return [text or "" for text in table.column("text").to_pylist()]


def text_key(found: list[str]) -> int:
    """What names a text: a signed 64-bit hash of its words."""
    import xxhash

    return xxhash.xxh3_64_intdigest(" ".join(found)) - (1 << 63)


def _compare(similarity: float, n: int):
    """Arrow function over one tile: links and a smallest partner for each of its texts."""

    def compare(table):
        import numpy as np
        import pyarrow as pa

        bucket = table.column("bucket")[0].as_py()
        same = table.column("tile_a")[0].as_py() == table.column("tile_b")[0].as_py()
        shingler, sets, mine = Shingler(n), [], {}
        for at, (name, text) in enumerate(zip(table.column("key").to_pylist(), _texts(table), strict=True)):
            found = words(text)
            if name not in mine and text_key(found) == name:
                mine[name] = at
                sets.append(shingler.shingles(found))
        table = table.take(list(mine.values()))
        rows = table.num_rows
        key = table.column("key").to_numpy()
        copies = table.column("copies").to_numpy()
        side = table.column("side").to_numpy()
        sizes = np.array([len(s) for s in sets])
        owners = np.repeat(np.arange(rows), sizes)
        hashes, place = np.unique(np.concatenate(sets), return_inverse=True)
        shared = np.bincount(place, minlength=len(hashes)) > 1
        column = np.cumsum(shared) - 1
        keep = shared[place]
        owners, column = owners[keep], column[place[keep]]
        order = np.argsort(column, kind="stable")
        owners, column = owners[order], column[order]
        common = np.zeros((rows, rows), np.float32)
        width = 4096
        for start in range(0, int(shared.sum()), width):
            a, b = np.searchsorted(column, [start, start + width])
            part = np.zeros((rows, width), np.float32)
            part[owners[a:b], column[a:b] - start] = 1
            common += part @ part.T
        least = similarity * (1 - 1e-9)
        alike = common >= least * (sizes[:, None] + sizes[None, :] - common)
        np.fill_diagonal(alike, False)
        if not same:
            alike &= side[:, None] != side[None, :]
        own = [set(b) for b in table.column("buckets").to_pylist()]
        for a, b in zip(*np.nonzero(np.triu(alike)), strict=True):
            if bucket != min(own[a] & own[b]):
                alike[a, b] = alike[b, a] = False
        linked = np.flatnonzero(alike.any(axis=1))
        links = alike @ copies
        root = np.arange(rows)

        def top(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a in linked:
            for b in np.flatnonzero(alike[a, :a]):
                x, y = top(a), top(b)
                if x != y:
                    low, high = (x, y) if key[x] < key[y] else (y, x)
                    root[high] = low
        return pa.table(
            {
                "key": pa.array(key[linked], pa.int64()),
                "root": pa.array(key[[top(x) for x in linked]] if len(linked) else key[:0], pa.int64()),
                "links": pa.array(links[linked].astype(np.int64), pa.int64()),
            }
        )

    return compare


def distinct_texts(docs: DataFrame, bands: int, rows: int, n: int) -> tuple[DataFrame, DataFrame]:
    """Signatures of all rows, and one row per distinct text with words: key, copies, least doc_id and the hash of the
    text of such a row, band hashes."""
    signed = saved(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash")).mapInArrow(
            _signatures(bands, rows, n), "doc_id long, hash long, key long, chars long, bands array<long>"
        )
    )
    first = F.min(F.struct("doc_id", "hash")).alias("first")
    texts = (
        signed.filter(F.col("bands").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("key")
        .agg(
            F.count(F.lit(1)).alias("copies"),
            first,
            F.max("chars").alias("chars"),
            F.first("bands").alias("bands"),
        )
        .select("key", "copies", F.col("first.doc_id").alias("first_doc"), F.col("first.hash").alias("first_hash"), "chars", "bands")
    )
    return signed, texts


def near_duplicates(
    docs: DataFrame,
    similarity: float = SIMILARITY,
    n: int = SHINGLE,
    recall: float = RECALL,
    permutations: int = PERMUTATIONS,
) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``): ``doc_id, class_id, n_links``.

    ``class_id`` is the smallest doc_id of all documents that links tie together; ``n_links`` counts the other documents
    with an n-gram Jaccard similarity of at least ``similarity``, word-for-word copies included. A text without words
    (null, empty) has no n-gram and no links, and is a class of its own. A row without doc_id cannot be named: it is
    returned with null class and no links and takes no part. Equal texts are known by a 64-bit hash of their words.
    """
    signed, texts, linked = _linked_texts(docs, similarity, n, recall, permutations)
    every = texts.select("key", "copies", "first_doc").join(linked, "key", "left")
    every = every.select(
        "key",
        F.coalesce("class_id", "first_doc").alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    named = F.col("doc_id").isNotNull()
    compared = signed.filter(named & F.col("bands").isNotNull()).select("doc_id", "key").join(every, "key")
    alone = signed.filter(~(named & F.col("bands").isNotNull())).select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")
    )
    return compared.select("doc_id", "class_id", "n_links").unionByName(alone)


def _linked_texts(
    docs: DataFrame, similarity: float, n: int, recall: float, permutations: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signatures of all rows, distinct texts, and of the texts with a link ``key, links, class_id, root``: ``root``
    is the least key of the class, which tells classes apart where their texts share doc_ids."""
    bands, rows = choose_bands(similarity, recall, permutations)
    signed, texts = distinct_texts(docs, bands, rows, n)
    texts = saved(texts)
    member = texts.select("key", "chars", F.explode("bands").alias("bucket"))
    buckets = (
        member.groupBy("bucket")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("chars").alias("size"),
            F.sum(F.shiftright(F.xxhash64("key"), 16)).alias("mark"),
            F.sum(F.shiftright(F.xxhash64("key", F.lit(1)), 16)).alias("mark2"),
        )
        .filter("n > 1")
    )
    # buckets with the same members say the same; the two sums of hashes tell member sets apart
    kept = buckets.groupBy("n", "size", "mark", "mark2").agg(F.min("bucket").alias("bucket"))
    kept = kept.select("bucket", _blocks(F.col("n"), F.col("size")).alias("blocks"))
    met = member.join(kept, "bucket")
    where = saved(
        met.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("bucket", "blocks"))).alias("where"))
    )  # at most one entry per band
    needed = where.join(texts.select("key", "copies", "first_doc", "first_hash"), "key")
    # a text comes back by id and hash, so that texts that share an id do not meet; of repeated rows one is left before
    # the exchange
    texts_of = docs.select(F.col("doc_id").cast("long").alias("first_doc"), F.xxhash64("text").alias("first_hash"), "text")
    needed = needed.join(texts_of.dropDuplicates(["first_doc", "first_hash"]), ["first_doc", "first_hash"])
    tiles = (
        needed.withColumn("at", F.explode("where"))
        .withColumn("bucket", F.col("at.bucket"))
        .withColumn("blocks", F.col("at.blocks"))
        .withColumn("side", F.pmod(F.xxhash64("key", F.lit(2)), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
        .select(
            "key",
            "copies",
            "text",
            "bucket",
            "side",
            F.transform("where", lambda w: w["bucket"]).alias("buckets"),
            F.least("side", "other").alias("tile_a"),
            F.greatest("side", "other").alias("tile_b"),
        )
    )
    found = tiles.groupBy("bucket", "tile_a", "tile_b").applyInArrow(
        _compare(similarity, n), "key long, root long, links long"
    )
    found = saved(found)
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("key").alias("a"), F.col("root").alias("b")))
    linked = links.join(parts.withColumnRenamed("node", "key"), "key")
    firsts = texts.select("key", "first_doc").join(linked, "key")
    classes = firsts.groupBy("root").agg(F.min("first_doc").alias("class_id"))
    return signed, texts, linked.join(classes, "root").select("key", "links", "class_id", "root")


def _blocks(count, chars):
    """Blocks of a bucket, so that each has at most about ``TILE_ROWS`` texts and ``TILE_CHARS`` characters."""
    return F.greatest(F.ceil(count / TILE_ROWS), F.ceil(chars / TILE_CHARS)).cast("long")


def _keys(at: int):
    """Arrow function: the row with the key of its text, the column at place ``at``; null without words."""

    def add(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches):
            found = [words(text or "") for text in batch.column(at).to_pylist()]
            keys = pa.array([text_key(f) if f else None for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, keys], names=[*batch.schema.names, "_key"])

    return add


def keep_one(
    docs: DataFrame,
    similarity: float = SIMILARITY,
    n: int = SHINGLE,
    recall: float = RECALL,
    permutations: int = PERMUTATIONS,
) -> DataFrame:
    """``docs`` without near duplicates: of every class one row stays, that with the smallest doc_id.

    ``doc_id`` need not be unique: texts with one id that do not hang together are classes of their own, and of several
    texts of a class with its smallest id that with the smallest key stays; of rows with this id and these words one
    stays, by a hash of the text. Rows without doc_id and rows without words stay. All columns stay as they are.
    """
    _, texts, linked = _linked_texts(docs, similarity, n, recall, permutations)
    classes = texts.select("key", "first_doc").join(linked.select("key", "root"), "key", "left")
    first = classes.groupBy(F.coalesce("root", "key").alias("_class")).agg(F.min(F.struct("first_doc", "key")).alias("_m"))
    kept = first.select(F.col("_m.first_doc").alias("_id"), F.col("_m.key").alias("_key"))
    rows, names = plain_names(docs)
    schema = T.StructType([*rows.schema, T.StructField("_key", T.LongType())])
    keyed = rows.mapInArrow(_keys(docs.columns.index("text")), schema).withColumn("_id", F.col(names["doc_id"]).cast("long"))
    plain = F.col("_id").isNull() | F.col("_key").isNull()
    once = Window.partitionBy("_id", "_key").orderBy(F.xxhash64(names["text"]))  # cut to one row before the exchange as well
    named = keyed.filter(~plain).withColumn("_row", F.row_number().over(once)).filter("_row = 1")
    named = named.join(kept, ["_id", "_key"], "left_semi")
    return named.select(*names.values()).unionByName(keyed.filter(plain).select(*names.values())).toDF(*docs.columns)
