"""Which documents hold which of a stated set of keys: rolling hashes of the text probe the sorted keys."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a key that are compared; a longer key is looked for by its beginning.
KEY_BYTES = 30
#: Bytes of keys that are broadcast at once, and of text that is hashed at once.
BLOCK_BYTES, SLICE = 8 << 20, 1 << 20
_FILTER_BITS = 20
_rng = np.random.default_rng(20240301)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64)
_ODD = _rng.integers(0, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)
#: Bytes of a longer key that tell most positions apart before all of it is hashed.
_HEAD = 8


def gram_hashes(buf: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n bytes at every position that has them (of every row, if there are rows): spans are doubled, the last two overlap."""
    h, size, level = _BYTE[buf], 1, 0
    while size < n and h.size:
        step = min(size, n - size)
        h = h[..., : max(0, h.shape[-1] - step)] * _ODD[level] + h[..., step:]
        h ^= h >> np.uint64(29)
        size, level = size + step, level + 1
    return h * _ODD[15]


def _heads(buf: np.ndarray) -> np.ndarray:
    """Filter number of the ``_HEAD`` bytes at every position that has them."""
    wide = np.ndarray((max(0, len(buf) - _HEAD + 1),), np.uint64, np.ascontiguousarray(buf), 0, (1,))
    return ((wide * _ODD[14]) >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)


class Keys:
    """Distinct keys by length with the items that have them."""

    def __init__(self, rows: list[tuple[int, bytes]]):
        items: dict[bytes, set[int]] = {}
        for item, key in rows:
            items.setdefault(key[:KEY_BYTES], set()).add(item)
        self.groups = []
        for n in sorted({len(k) for k in items} - {0}):
            keys = [k for k in items if len(k) == n]
            found = np.array([gram_hashes(np.frombuffer(k, np.uint8), n)[0] for k in keys])
            order = np.argsort(found, kind="stable")
            maybe = np.zeros(1 << _FILTER_BITS, bool)
            maybe[(found >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
            heads = np.zeros(1 << _FILTER_BITS, bool)
            if n > _HEAD:
                heads[np.concatenate([_heads(np.frombuffer(k[:_HEAD], np.uint8)) for k in keys])] = True
            self.groups.append((n, found[order], maybe, heads, [sorted(items[keys[i]]) for i in order]))

    @staticmethod
    def _hashed(buf: np.ndarray, n: int, maybe: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions that may begin a key of n bytes, and the hashes there."""
        if n > _HEAD:
            at = np.flatnonzero(heads[_heads(buf[: len(buf) - n + _HEAD])])
            if len(at) * n < len(buf):
                h = gram_hashes(np.ndarray((len(buf) - n + 1, n), np.uint8, np.ascontiguousarray(buf), 0, (1, 1))[at], n)[:, 0]
                return at, h
        h = gram_hashes(buf, n)
        at = np.flatnonzero(maybe[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        return at, h[at]

    def within(self, buf: np.ndarray, offsets: np.ndarray) -> set[tuple[int, int]]:
        """(row, item) of every text that has a key of the item."""
        out = set()
        for n, found, maybe, heads, items in self.groups:
            for a in range(0, max(0, len(buf) - n + 1), SLICE):
                at, h = self._hashed(buf[a : a + SLICE + n - 1], n, maybe, heads)
                low = np.searchsorted(found, h, "left")
                high = np.searchsorted(found, h, "right")
                row = np.searchsorted(offsets, at + a, "right") - 1
                good = (high > low) & (at + a + n <= offsets[row + 1])
                # Keys of one hash are all taken: who asks confirms on the texts.
                for r, i, j in np.unique(np.stack([row[good], low[good], high[good]]), axis=1).T.tolist():
                    out.update((r, item) for k in range(i, j) for item in items[k])
        return out


def _found(keys: Keys, hay: pa.Array) -> set[tuple[int, int]]:
    """(row, item) of the texts that have a key of the item, by hash."""
    text = pa.array(hay.fill_null("").to_pylist(), pa.large_string()) if hay.null_count else hay.cast(pa.large_string())
    _, ends, data = text.buffers()
    offsets = np.frombuffer(ends, np.int64)[text.offset : text.offset + len(text) + 1]
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(text) else np.zeros(0, np.uint8)
    return keys.within(buf, offsets - offsets[0])


def candidates(hays: DataFrame, keys: DataFrame) -> DataFrame:
    """Distinct (item_id, doc_id) of all documents (doc_id, hay) that hold a key (item_id, key); by hash, so to be confirmed.

    The keys go out in blocks of about ``BLOCK_BYTES``, each of which meets every document.
    """
    spark = hays.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    kinds = dict(hays.dtypes)["doc_id"], dict(keys.dtypes)["item_id"]
    schema = f"item_id {kinds[1]}, doc_id {kinds[0]}"
    asked = keys.select("item_id", F.substring(F.col("key").cast("binary"), 1, KEY_BYTES).alias("key")).dropna().distinct()
    total = asked.agg(F.coalesce(F.sum(F.length("key")), F.lit(0))).first()[0]
    n = max(1, -(-int(total) // BLOCK_BYTES))
    out = spark.createDataFrame([], schema)
    for b in range(n):
        rows = [(r.item_id, bytes(r.key)) for r in asked.filter(F.pmod(F.xxhash64("key"), F.lit(n)) == b).collect()]
        shared = spark.sparkContext.broadcast(Keys(rows))

        def run(batches, shared=shared):
            for batch in batches:
                if pairs := sorted(_found(shared.value, batch.column("hay"))):
                    ids = batch.column("doc_id")
                    yield pa.RecordBatch.from_arrays([pa.array([i for _, i in pairs], pa.int64()), ids.take(pa.array([r for r, _ in pairs]))], ["item_id", "doc_id"])

        out = out.unionByName(hays.select("doc_id", "hay").mapInArrow(run, schema))
    return out.distinct()


def spans(hays: DataFrame, keys: DataFrame) -> DataFrame:
    """(item_id, doc_id, start, end): where the documents (doc_id, hay) that hold a whole key (item_id, key) have it first, in characters.

    Keys go out whole, in blocks of about ``BLOCK_BYTES``, and are confirmed where the document is read: no text is shuffled.
    A row of keys and a row of documents give a row at most; empty keys none.
    """
    spark = hays.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    kinds = dict(hays.dtypes)["doc_id"], dict(keys.dtypes)["item_id"]
    asked = keys.select(F.col("item_id").cast("long").alias("item_id"), "key").dropna().filter("key <> ''")
    total = asked.agg(F.coalesce(F.sum(F.octet_length("key")), F.lit(0))).first()[0]
    n = max(1, -(-int(total) // BLOCK_BYTES))
    out = None
    for b in range(n):
        rows = [(r.item_id, r.key) for r in asked.filter(F.pmod(F.xxhash64("key"), F.lit(n)) == b).collect()]
        shared = spark.sparkContext.broadcast((Keys([(i, key.encode()) for i, (_, key) in enumerate(rows)]), rows))

        def run(batches, shared=shared):
            first, items = shared.value
            for batch in batches:
                hay, held = batch.column("hay"), []
                for r, i in sorted(_found(first, hay)):
                    at = (hay[r].as_py() or "").find(items[i][1])
                    if at >= 0:
                        held.append((r, items[i][0], at, at + len(items[i][1])))
                if held:
                    row, item, start, end = zip(*held, strict=True)
                    numbers = [pa.array(c, pa.int64()) for c in (item, start, end)]
                    yield pa.RecordBatch.from_arrays([*numbers, batch.column("doc_id").take(pa.array(row))], ["item_id", "start", "end", "doc_id"])

        found = hays.select("doc_id", "hay").filter("doc_id IS NOT NULL").mapInArrow(run, f"item_id long, start long, end long, doc_id {kinds[0]}")
        out = found if out is None else out.unionByName(found)
    return out.select(F.col("item_id").cast(kinds[1]).alias("item_id"), "doc_id", "start", "end")
