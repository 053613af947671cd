"""Token ids of whole documents in files that can be searched: one wavelet matrix a shard.

Texts are encoded by the tokenizers library.  A text is first cut where the pre-tokeniser of
byte-level vocabularies always cuts: before the last white space in front of a word.  Each
distinct unit is encoded by the library once per worker and remembered (``MEMORY`` units); the
units of a text, put together again, must give its bytes, or the library encodes it whole, as it
does texts that spell a special token.

Encoded documents are written once, then dealt out by ranges of the document id to tasks of
some ``TASK_TOKENS`` tokens each, which cut them into shards of at most ``SHARD_TOKENS``; a
document that does not fit is continued in the next shard, so no task holds more than a shard
and a document.  A file carries the table of its documents and where they start among the
task's tokens.  Task and attempt name a file, which is renamed when whole, so that a task that
runs again leaves nothing half-written; the list of files (a row a shard) holds the attempts
that counted.  Positions in the corpus follow from one number a task, which the driver adds up
(one row for ``TASK_TOKENS`` tokens).

Reading takes whole shards back; the checksum of a document in several shards is put together
from those of its pieces.

Defined results: a null or empty text is the end id alone; null ids come first; rows that
repeat an id are documents of their own, in any order among themselves if their tokens differ;
very long texts are encoded whole; no documents give no rows; other columns are ignored.  A
text that spells a special token has that token's id, as the library has it by default.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, only, tidied
from .textops import U64, Words, blocks, flat
from .wavelet import TokenFile, filesystem, write

MODEL = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 0
SHARD_TOKENS = 1 << 21
TASK_TOKENS = 1 << 25
#: Units that a worker remembers.
MEMORY = 1_000_000
#: Units that the library gets as one text.
JOINED = 100
_PLAIN = re.compile(r" ?[^\s\x00-\x20]+")
#: Bytes that begin a character which is never white space; some characters of the others are.
_SAFE = np.zeros(256, bool)
_SAFE[33:127] = _SAFE[0xC3:0xF5] = True
_SAFE[[0xE1, 0xE2, 0xE3]] = False


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of every run, one run after the other."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size), size)


class Encoder:
    """The library's ids of byte-level texts, with a memory of units."""

    def __init__(self, model: str):
        """``model``: the text of a tokenizer file."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(model)
        self.kind = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        feed = self.library.encode("\n", add_special_tokens=False).ids
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.feed = feed[0] if len(feed) == 1 else None
        self._forget()

    def _forget(self) -> None:
        self._keys, self._place = np.zeros(0, U64), np.zeros(0, np.int64)
        self._raw, self._ids = [np.zeros(0, np.uint8)], [np.zeros(0, self.kind)]
        self._raw_at, self._ids_at = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def _library(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units one after the other, and the number of each; plain ones are joined by line feeds, which are cut off again."""
        plain = np.fromiter((self.feed is not None and _PLAIN.fullmatch(u) is not None for u in units), bool, len(units))
        alone, able = [np.flatnonzero(~plain)], np.flatnonzero(plain)
        joined = [able[i : i + JOINED] for i in range(0, len(able), JOINED)]
        coded = self.library.encode_batch_fast(["\n".join([units[i] for i in g.tolist()]) for g in joined], add_special_tokens=False)
        # A line feed behind every group, so that each unit ends at one.
        lists = [c.ids for c in coded]
        feeds = [x.count(self.feed) + 1 for x in lists]
        good = [n == len(g) for n, g in zip(feeds, joined, strict=True)]
        alone += [g for g, ok in zip(joined, good, strict=True) if not ok]
        found = np.fromiter(chain.from_iterable(chain(x, (self.feed,)) for x, ok in zip(lists, good, strict=True) if ok), np.int64)
        end = np.flatnonzero(found == self.feed) if len(found) else np.zeros(0, np.int64)
        order = np.concatenate([*(g for g, ok in zip(joined, good, strict=True) if ok), np.concatenate(alone)]).astype(np.int64)
        rest = [c.ids for c in self.library.encode_batch_fast([units[i] for i in np.concatenate(alone).tolist()], add_special_tokens=False)]
        ids = np.concatenate([np.delete(found, end), np.fromiter(chain.from_iterable(rest), np.int64)])
        counts = np.concatenate([np.diff(end, prepend=-1) - 1, np.array([len(x) for x in rest], np.int64)])
        start, size = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
        start[order], size[order] = np.cumsum(counts) - counts, counts
        return ids[spread(start, size)].astype(self.kind), size

    def _learn(self, hashes: np.ndarray, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        pool = raw[spread(start, size)]
        cut = np.concatenate([[0], np.cumsum(size)])
        data, edges = pool.tobytes(), cut.tolist()
        ids, counts = self._library([data[a:b].decode("utf-8") for a, b in zip(edges[:-1], edges[1:], strict=True)])
        place = len(self._raw_at) - 1 + np.arange(len(hashes))
        self._raw_at = np.concatenate([self._raw_at, self._raw_at[-1] + cut[1:]])
        self._ids_at = np.concatenate([self._ids_at, self._ids_at[-1] + np.cumsum(counts)])
        self._raw = [np.concatenate([*self._raw, pool])]
        self._ids = [np.concatenate([*self._ids, ids])]
        at = np.searchsorted(self._keys, hashes)
        self._keys, self._place = np.insert(self._keys, at, hashes), np.insert(self._place, at, place)

    def encode(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of runs of texts one after the other, and the number of ids of each text."""
        buf, offsets = flat(column)
        for i, j in blocks(offsets):
            yield self._run(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])

    def _run(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        texts = len(offsets) - 1
        if not len(buf):
            return np.zeros(0, self.kind), np.zeros(texts, np.int64)
        data = buf.tobytes()
        if any(x in data for x in self.special):
            return self._whole(buf, offsets)  # white space in front of a special token is cut otherwise
        if len(self._keys) > MEMORY:
            self._forget()
        before = np.zeros(len(buf), bool)  # white space in front of what is none
        before[:-1] = ((buf[:-1] == 32) | (buf[:-1] == 10)) & _SAFE[buf[1:]]
        before[offsets[1:][np.diff(offsets) > 0] - 1] = False  # the end of a text
        start = before.copy()
        start[1:] |= before[:-1] & (buf[:-1] == 10)
        start[offsets[:-1][np.diff(offsets) > 0]] = True
        begin = np.flatnonzero(start)
        size = np.diff(np.append(begin, len(buf)))
        units = Words.__new__(Words)
        units.buf, units.start, units.end = buf, begin, begin + size
        unique, first, back = np.unique(units._hash(), return_index=True, return_inverse=True)
        at = np.searchsorted(self._keys, unique)
        known = np.zeros(len(unique), bool)
        inside = at < len(self._keys)
        known[inside] = self._keys[at[inside]] == unique[inside]
        if not known.all():
            new = first[~known]
            self._learn(unique[~known], buf, begin[new], size[new])
            at = np.searchsorted(self._keys, unique)
        place = self._place[at][back]
        length = self._raw_at[place + 1] - self._raw_at[place]
        if not (np.array_equal(length, size) and np.array_equal(self._raw[0][spread(self._raw_at[place], length)], buf)):
            return self._whole(buf, offsets)  # two units share a hash
        counts = self._ids_at[place + 1] - self._ids_at[place]
        ends = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(begin, offsets)]
        return self._ids[0][spread(self._ids_at[place], counts)], np.diff(ends)

    def _whole(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data, cut = buf.tobytes(), offsets.tolist()
        coded = self.library.encode_batch_fast([data[a:b].decode("utf-8") for a, b in zip(cut[:-1], cut[1:], strict=True)], add_special_tokens=False)
        return np.array([x for c in coded for x in c.ids], self.kind), np.array([len(c.ids) for c in coded], np.int64)


_kept: tuple[str, Encoder] | None = None


def _worker(key: str, model: str) -> Encoder:
    """One encoder per Python worker and vocabulary, so that its memory outlives a task."""
    global _kept
    if _kept is None or _kept[0] != key:
        _kept = (key, Encoder(model))
    return _kept[1]


def encode_documents(docs: DataFrame, model: str = MODEL, end_id: int = END_ID) -> DataFrame:
    """doc_id, tie (tells rows of one id apart), n and ids (little-endian, 2 bytes each if the vocabulary allows, else 4) with the end id."""
    kind = dict(docs.dtypes)["doc_id"]
    text = Path(model).read_text(encoding="utf-8")  # some megabytes
    key, shared = hashlib.sha256(text.encode()).hexdigest(), docs.sparkSession.sparkContext.broadcast(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _worker(key, shared.value)
        for b in batches:
            at = 0
            for ids, counts in encoder.encode(b.column("text")):
                with_end = np.insert(ids, np.cumsum(counts), end_id)
                width = encoder.kind.itemsize
                ends = np.concatenate([[0], np.cumsum(counts + 1) * width])
                rows = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(with_end.tobytes())]).cast(pa.binary())
                some = b.slice(at, len(counts))
                at += len(counts)
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("tie"), pa.array(counts + 1), pa.array(np.full(len(counts), width, np.int32)), rows], ["doc_id", "tie", "n", "width", "ids"])

    return only(docs, "doc_id", "text").withColumn("tie", F.monotonically_increasing_id()).select("doc_id", "tie", "text").mapInArrow(tidied(run), f"doc_id {kind}, tie long, n long, width int, ids binary")


FILES = "file string, task int, shard int, n long"


def write_shards(coded: DataFrame, folder: str, tasks: int, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Lazy list of the shards that reading it writes to ``folder`` in ascending order of ids (nulls first)."""
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie").asc()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        store, root = filesystem(folder)
        held: list[np.ndarray] = []
        pieces: list[tuple] = []  # doc_id, tie, first token of the document in the task, place in the shard, size, tokens of the document before and after
        files: list[tuple] = []
        filled = done = 0
        kind = None

        def flush() -> None:
            nonlocal held, pieces, filled
            store.create_dir(root, recursive=True)
            name = f"part-{context.partitionId():05d}-{len(files):05d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}.tok"
            columns = list(zip(*pieces, strict=True))
            table = pa.table([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:])], ["doc_id", "tie", "first", "place", "size", "skipped", "after"])
            with store.open_output_stream(f"{root}/.{name}", compression=None) as sink:
                write(sink, np.concatenate(held), table)
            store.move(f"{root}/.{name}", f"{root}/{name}")
            files.append((f"{folder}/{name}", context.partitionId(), len(files), filled))
            held, pieces, filled = [], [], 0

        for b in batches:
            kind = b.schema.field("doc_id").type
            for doc_id, tie, width, raw in zip(*(b.column(c).to_pylist() for c in ("doc_id", "tie", "width", "ids")), strict=True):
                ids = np.frombuffer(raw, f"<u{width}")
                at = 0
                if filled and filled + len(ids) > shard_tokens:
                    flush()
                while at < len(ids):
                    part = ids[at : at + shard_tokens - filled]
                    pieces.append((doc_id, tie, done, filled, len(part), at, len(ids) - at - len(part)))
                    held.append(part)
                    filled += len(part)
                    at += len(part)
                    if filled == shard_tokens:
                        flush()
                done += len(ids)
        if filled:
            flush()
        if files:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*files, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["file", "task", "shard", "n"])

    return coded.repartitionByRange(tasks, *order).sortWithinPartitions(*order).mapInArrow(tidied(run), FILES)


# ---- checksums of texts in pieces -----------------------------------------------------------


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo the one of CRC-32, both with the lowest power in the highest bit."""
    out = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            out ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


def moved_crc(crc: int, following: int) -> int:
    """What a CRC-32 adds to that of a text in which so many bytes follow: the parts of a text are combined by XOR."""
    power, square = 1 << 31, 1 << 23  # x^0, x^8
    while following:
        if following & 1:
            power = _times(power, square)
        square, following = _times(square, square), following >> 1
    return _times(power, crc)


def read_shards(files: DataFrame, conv: str, readers: int) -> DataFrame:
    """The pieces of documents as read back; ``crc`` is what a piece adds to the checksum of its document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, task in zip(b.column("file").to_pylist(), b.column("task").to_pylist(), strict=True):
                shard = TokenFile(name)
                ids, table = shard.ids().astype("<u4"), shard.documents()
                shard.close()
                raw = memoryview(ids.tobytes())
                place, size, after = (table.column(c).to_numpy() for c in ("place", "size", "after"))
                crc = [zlib.crc32(raw[4 * p : 4 * (p + n)]) for p, n in zip(place.tolist(), size.tolist(), strict=True)]
                crc = [moved_crc(c, 4 * a) if a else c for c, a in zip(crc, after.tolist(), strict=True)]
                out = table.select(["doc_id", "tie", "first", "size", "skipped", "after"]).append_column("crc", pa.array(crc, pa.int64())).append_column("task", pa.array([task] * len(crc), pa.int32()))
                yield from out.combine_chunks().to_batches(max_chunksize=10_000)

    return files.select("file", "task").repartition(readers, "file").mapInArrow(tidied(run), f"doc_id {conv}, tie long, first long, size long, skipped long, after long, crc long, task int")


def find_token(files: DataFrame, token: int, kind: str = "long") -> DataFrame:
    """doc_id (of type ``kind``) and place in the document of every occurrence of a token, found by rank and select without reading the other ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column("file").to_pylist():
                shard = TokenFile(name)
                if shard.count(token):
                    at, table = shard.positions(token), shard.documents()
                    row = np.searchsorted(table.column("place").to_numpy(), at, "right") - 1
                    whole = table.take(pa.array(row))
                    offset = at - whole.column("place").to_numpy() + whole.column("skipped").to_numpy()
                    yield from pa.table([whole.column("doc_id"), pa.array(offset)], ["doc_id", "place"]).combine_chunks().to_batches(max_chunksize=10_000)
                shard.close()

    return files.select("file").mapInArrow(tidied(run), f"doc_id {kind}, place long")


def count_token(files: DataFrame, token: int) -> DataFrame:
    """How often a token occurs in each shard, from two ranks a plane."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, counts = b.column("file").to_pylist(), []
            for name in names:
                shard = TokenFile(name)
                counts.append(shard.count(token))
                shard.close()
            yield pa.RecordBatch.from_arrays([b.column("file"), pa.array(counts, pa.int64())], ["file", "count"])

    return files.select("file").mapInArrow(tidied(run), "file string, count long")


def store_and_read(docs: DataFrame, model: str = MODEL, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS, task_tokens: int = TASK_TOKENS) -> DataFrame:
    """Writes all documents and reads every shard back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    kind = dict(docs.dtypes)["doc_id"]
    coded = scratch.settle(encode_documents(docs, model, end_id), "coded")
    total = coded.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tasks = max(-(-total // task_tokens), min(spark.sparkContext.defaultParallelism, -(-total // (1 << 16))), 1)
    files = scratch.settle(write_shards(coded, f"{scratch.root}/shards", tasks, shard_tokens), "files")
    scratch.drop(coded)
    sums = sorted((r.task, r.n) for r in files.groupBy("task").agg(F.sum("n").alias("n")).collect())  # one row for task_tokens tokens
    base = np.concatenate([[0], np.cumsum([n for _, n in sums])]).tolist()
    bases = spark.createDataFrame([(t, b) for (t, _), b in zip(sums, base[:-1], strict=True)], "task int, base long")
    pieces = scratch.settle(read_shards(files, kind, max(tasks, spark.sparkContext.defaultParallelism)), "pieces")
    parted = (F.col("skipped") > 0) | (F.col("after") > 0)
    columns = ["task", "doc_id", "tie", "first", "size", "crc"]
    joined = pieces.filter(parted).groupBy("task", "doc_id", "tie").agg(F.min("first").alias("first"), F.sum("size").alias("size"), F.bit_xor("crc").alias("crc"))
    every = pieces.filter(~parted).select(columns).unionByName(joined.select(columns))
    return every.join(F.broadcast(bases), "task").select("doc_id", (F.col("base") + F.col("first")).alias("start"), F.col("size").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
