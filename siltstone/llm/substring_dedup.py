"""Substring dedup: removes words covered by windows that start in an earlier document too.

A window is ``WINDOW`` consecutive words of one document; it is repeated if a document
with a smaller id holds the same words in a row.  Every word covered by a repeated window
goes.

1. Anchors.  The anchor of a window is the least of the hashes of its runs of ``GRAM``
   words, so equal windows have equal anchors, and neighbouring windows mostly share
   theirs.  Anchors that only one document has cannot be of repeated windows; the others
   get the smallest document that has them as their shard, or a part of it if that
   document's anchors occur too often (``SHARD_ANCHORS``).
2. Segments.  Each split of the input fetches its own anchors of step 1 (they travel to
   the texts, not the texts to them) and cuts out the stretches of windows that belong to
   one shard.  Rows are named by file, split and place in the file (the scan's metadata).
3. Search.  The distinct stretches of some shards make one compressed FM-index; all of
   them are streamed through it by backward search.  The matching statistics give, for
   every window, the smallest document that holds it.  Stretches equal to one of a smaller
   document are repeated as a whole.
   Anchors with ``HOT`` occurrences or more would bring unbounded groups into one task, so
   their windows are parted by hash: a partial aggregate leaves each distinct window once,
   with its smallest document; those of several documents are indexed and searched like
   stretches, and the answer is joined to the places of the window.
4. Each split fetches its repeated intervals and writes what is left of its texts.

Defined results: null, empty and blank texts have no words and keep nothing (the hash of
the empty string); texts shorter than a window lose nothing; rows with a null id lose
nothing and take nothing from others; rows of equal id do not remove each other's words,
however many files or scans they come from; an empty table gives an empty result; columns
beside id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, few_or_many, only, shuffle_width, tidied
from .fm_index import FMIndex
from .textops import U64, Words, blocks, flat, grams, mix

WINDOW = 13
GRAM = 5
#: Occurrences from which an anchor is too common to be a shard's.
HOT = 256
#: Words of the distinct stretches that share an index, unless one shard alone has more.
INDEX_WORDS = 300_000
#: Occurrences of the anchors of one shard, some 20 words each at most; a document with more gets several shards.
SHARD_ANCHORS = 50_000
#: Folders of what travels to the texts: at least so many, and one for so many splits where there are more.
BUCKETS = 1024
SPLITS_PER_BUCKET = 16


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` neighbours, by doubling."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    have, size = values, 1
    while size * 2 <= width:
        have = np.minimum(have[: len(have) - size], have[size:])
        size *= 2
    return np.minimum(have[:n], have[width - size : width - size + n])


def window_anchors(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, anchor) of every window, first words counted over all rows."""
    anchor = _least(grams(w.hash, GRAM), WINDOW - GRAM + 1)
    row = np.repeat(np.arange(len(w.first) - 1), w.counts)
    start = np.flatnonzero(row[: len(anchor)] == row[WINDOW - 1 :][: len(anchor)])
    return row[start], start, anchor[start]


def _splits(batch: pa.RecordBatch, names: tuple[str, str] = ("split", "ordinal")) -> Iterator[tuple[int, np.ndarray, pa.RecordBatch]]:
    """(split, places of the rows in their file, rows) of each run of one split in a batch."""
    split, ordinal = (batch.column(c).to_numpy(zero_copy_only=False) for c in names)
    cuts = [0, *(np.flatnonzero(split[1:] != split[:-1]) + 1).tolist(), len(split)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield int(split[a]), ordinal[a:b], batch.slice(a, b - a)


def _words_of(rows: pa.RecordBatch) -> Iterator[tuple[int, int, Words]]:
    buf, offsets = flat(rows.column("text"))
    for i, j in blocks(offsets):
        yield i, j, Words(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def _is_one_scan(docs: DataFrame) -> bool:
    """Whether the rows are those of one scan of parquet files, each once: projections and filters over a relation."""
    plan = docs._jdf.queryExecution().analyzed()
    if not plan.deterministic():
        return False
    while plan.children().size() == 1 and plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().apply(0)
    return plan.nodeName().startswith(("LogicalRelation", "Relation")) and "parquet" in plan.toString().lower()[:2000]


def named_rows(docs: DataFrame, scratch: Scratch, names: tuple[str, str] = ("split", "ordinal")) -> DataFrame:
    """``docs`` with the file split and the place in its file of every row, which every scan of the same files finds again.

    Tables that are not one scan of parquet files (unions, joins, rows of this session) are written first.
    """
    if not _is_one_scan(docs):
        docs = scratch.settle(docs, "texts")
    meta = docs.metadataColumn("_metadata")
    return docs.withColumns({names[0]: F.xxhash64(meta["file_path"], meta["file_block_start"]), names[1]: meta["row_index"]})


def anchor_rows(texts: DataFrame, named: bool) -> DataFrame:
    """Anchors of all texts: with their document (``named``), or with split and ordinal."""

    def run(batches):
        for b in batches:
            for split, ordinal, rows in _splits(b):
                ids = rows.column("doc_id")
                for i, _, w in _words_of(rows):
                    row, _, anchor = window_anchors(w)
                    if not len(row):
                        continue
                    new = np.ones(len(row), bool)
                    new[1:] = (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1])
                    row, anchor = row[new] + i, pa.array(anchor[new].view(np.int64))
                    if named:
                        yield pa.RecordBatch.from_arrays([anchor, ids.take(pa.array(row))], ["anchor", "doc_id"])
                    else:
                        yield pa.RecordBatch.from_arrays([anchor, pa.array(np.full(len(row), split)), pa.array(ordinal[row])], ["anchor", "split", "ordinal"])

    if named:
        return texts.mapInArrow(tidied(run), "anchor long, doc_id long").filter("doc_id IS NOT NULL")
    return texts.mapInArrow(tidied(run), "anchor long, split long, ordinal long")


def _buckets(texts: DataFrame) -> int:
    """How many folders the splits of a table are dealt to, from the planner's estimate of its size."""
    size = int(str(texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    conf = texts.sparkSession._jsparkSession.sessionState().conf()
    return max(BUCKETS, size // int(conf.filesMaxPartitionBytes()) // SPLITS_PER_BUCKET)


def by_split(rows: DataFrame, scratch: Scratch, name: str, buckets: int) -> tuple[str, int]:
    """Writes rows into folders of a few splits each, in order and small row groups, and returns where."""
    where = scratch.path(name)
    width = max(shuffle_width(rows.sparkSession), 1)
    dealt = rows.withColumn("bucket", F.pmod("split", F.lit(buckets))).repartition(width, "bucket").sortWithinPartitions("bucket", "split")
    dealt.write.partitionBy("bucket").option("compression", "zstd").option("parquet.block.size", 1 << 20).parquet(where)
    return where, buckets


def _fetch(where: tuple[str, int], split: int, columns: list[str]) -> dict[str, np.ndarray] | None:
    """What ``by_split`` has written for a split, or None; row groups of other splits are passed over."""
    uri, buckets = where
    store, root = pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))
    found = store.get_file_info(pafs.FileSelector(f"{root}/bucket={split % buckets}", allow_not_found=True))
    mine = [("split", "=", split)]
    parts = [pq.read_table(f.path, filesystem=store, columns=columns, partitioning=None, filters=mine) for f in found if f.path.endswith(".parquet")]
    table = pa.concat_tables(parts) if parts else None
    return {c: table.column(c).to_numpy() for c in columns} if table is not None and len(table) else None


def _digest(content: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(content, digest_size=8).digest(), "little", signed=True)


STRETCH = "shard long, h long, h2 long, doc_id long, split long, ordinal long, start int, n int, words binary, places binary"


def stretches(texts: DataFrame, shared_anchors: tuple[str, int]) -> DataFrame:
    """Stretches of windows of one shard with their words.

    Windows with a hot anchor have no shard: a row for each of them and batch, named by
    128 bits of hash, with the smallest document in ``doc_id``, the largest in
    ``ordinal`` and (document, ordinal, start) of all places in ``places``.
    """
    names = [c.split()[0] for c in STRETCH.split(", ")]
    kinds = [pa.int64()] * 6 + [pa.int32()] * 2 + [pa.binary()] * 2

    def run(batches):
        current, known = None, None
        for b in batches:
            for split, ordinal, rows in _splits(b):
                if split != current:
                    got = _fetch(shared_anchors, split, ["ordinal", "anchor", "shard", "hot"])
                    known = None
                    if got is not None:
                        key = _pair_key(got["ordinal"], got["anchor"].view(U64))
                        order = np.argsort(key)
                        known = key[order], got["shard"][order], got["hot"][order].astype(bool)
                    current = split
                if known is None:
                    continue
                ids = rows.column("doc_id").to_numpy(zero_copy_only=False)
                null = np.array(rows.column("doc_id").is_null())
                common: list[np.ndarray] = []
                texts_of: list[bytes] = []
                for i, j, w in _words_of(rows):
                    yield from cut(w, ordinal[i:j], split, ids[i:j], null[i:j], known, common, texts_of)
                if common:
                    yield from gather(np.concatenate(common, axis=1), texts_of, split)

    def gather(x, texts_of, split):
        """One row for each distinct window of a batch: its words, its smallest and largest document, and all its places."""
        order = np.lexsort((x[2], x[1], x[0]))
        x = x[:, order]
        new = np.ones(x.shape[1], bool)
        new[1:] = (x[0, 1:] != x[0, :-1]) | (x[1, 1:] != x[1, :-1])
        first = np.flatnonzero(new)
        past = np.append(first[1:], x.shape[1])
        places = np.ascontiguousarray(x[2:5].T)
        packed = [places[a:z].tobytes() for a, z in zip(first.tolist(), past.tolist(), strict=True)]
        n = len(first)
        words = [texts_of[block][a:z] for block, a, z in x[5:8, first].T.tolist()]
        cols = [pa.nulls(n, pa.int64()), x[0, first], x[1, first], x[2, first], np.full(n, split), x[2, past - 1], np.zeros(n), past - first, words, packed]
        yield _batch(cols, kinds, names)

    def cut(w, ordinal, split, ids, null, known, common, texts_of):
        row, start, anchor = window_anchors(w)
        key = _pair_key(ordinal[row], anchor)
        at = np.searchsorted(known[0], key)
        at[at == len(known[0])] = 0
        hit = (known[0][at] == key) & ~null[row]
        row, start, at = row[hit], start[hit], at[hit]
        shard, hot = known[1][at], known[2][at]
        place = start - w.first[row]
        if hot.any():
            at = start[hot]
            with np.errstate(over="ignore"):
                second = mix(grams(w.hash, WINDOW - 6)[at] * U64(31) + grams(w.hash, 7)[at + 6])
            r = row[hot]
            block = np.full(len(r), len(texts_of))
            texts_of.append(w.buf.tobytes())
            common.append(np.stack([grams(w.hash, WINDOW)[at].view(np.int64), second.view(np.int64), ids[r].astype(np.int64), ordinal[r], place[hot], block, w.start[at], w.end[at + WINDOW - 1]]))
        row, start, shard, place = (x[~hot] for x in (row, start, shard, place))
        if not len(row):
            return
        new = np.ones(len(row), bool)
        new[1:] = (start[1:] != start[:-1] + 1) | (row[1:] != row[:-1]) | (shard[1:] != shard[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(row)))
        begin, end = w.start[start[first]], w.end[start[first] + size + WINDOW - 2]
        raw = w.buf.tobytes()
        words = [b" ".join(raw[a:z].split()) for a, z in zip(begin.tolist(), end.tolist(), strict=True)]
        r = row[first]
        cols = [shard[first], np.array([_digest(x) for x in words]), np.zeros(len(r)), ids[r].astype(np.int64), np.full(len(r), split), ordinal[r], place[first], size, words, pa.nulls(len(r), pa.binary())]
        yield _batch(cols, kinds, names)

    return texts.mapInArrow(tidied(run), STRETCH)


def _pair_key(ordinal: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(anchor + mix(ordinal.astype(U64) + U64(1)))


def _batch(cols: list, kinds: list, names: list[str]) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c if isinstance(c, list) else np.asarray(c).astype(k.to_pandas_dtype()), k) for c, k in zip(cols, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names)


def least_documents(texts: list[bytes], owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest owner of the window at each word of the texts (a huge number where none begins), by an FM-index of them all.

    The words of the texts stand one after the other with one place behind each text; their counts come too.
    """
    w = Words(*flat(pa.array(texts, pa.large_binary())))
    parts = [w.hash[a:z] for a, z in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)]
    index = FMIndex(parts, owners, WINDOW)
    sizes = w.counts
    query = np.zeros(int((sizes + 1).sum()), np.int64)
    query[np.arange(len(w.hash)) + np.repeat(np.arange(len(sizes)), sizes)] = index.symbols(w.hash)
    return index.matching_statistics(query)[1], sizes


INTERVAL = "split long, ordinal long, start int, n int"


def search_shards(cuts: DataFrame) -> DataFrame:
    """Repeated windows of the stretches, as runs of window starts: split, ordinal, start, n."""
    names = [c.split()[0] for c in INTERVAL.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    width = max(shuffle_width(cuts.sparkSession), 1)
    dealt = cuts.select("shard", "h", "doc_id", "split", "ordinal", "start", "n", "words").repartition(width, "shard").sortWithinPartitions("shard", "h", "doc_id")

    def run(batches):
        held: list[tuple[bytes, int, list]] = []  # distinct stretches: words, owner, places of the owner
        size, shard, last_h, out = 0, None, None, []
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("shard", "h", "doc_id", "split", "ordinal", "start", "n", "words")]
            for sh, h, doc, split, ordinal, start, n, words in zip(*cols, strict=True):
                if sh != shard:
                    if size >= INDEX_WORDS:
                        yield from search(held)
                        held, size = [], 0
                    shard, last_h = sh, None
                place = (split, ordinal, start, n)
                if h == last_h and held[-1][0] == words:
                    if doc == held[-1][1]:
                        held[-1][2].append(place)
                    else:  # the same words as a stretch of a smaller document
                        out.append(place)
                        if len(out) >= 20_000:
                            yield _batch([np.array(c) for c in zip(*out, strict=True)], kinds, names)
                            out = []
                    continue
                last_h = h
                held.append((words, doc, [place]))
                size += n + WINDOW - 1
        if out:
            yield _batch([np.array(c) for c in zip(*out, strict=True)], kinds, names)
        if held:
            yield from search(held)

    def search(held):
        owners = np.array([x[1] for x in held], dtype=np.int64)
        least, sizes = least_documents([x[0] for x in held], owners)
        of = np.repeat(np.arange(len(sizes)), sizes + 1)
        at = np.flatnonzero(least < owners[of])
        if not len(at):
            return
        first = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (of[at[1:]] != of[at[:-1]])
        begin = np.flatnonzero(new)
        count = np.diff(np.append(begin, len(at)))
        rows = []
        for k, begin_at, n in zip(of[at[begin]].tolist(), (at[begin] - first[of[at[begin]]]).tolist(), count.tolist(), strict=True):
            rows += [(split, ordinal, start + begin_at, n) for split, ordinal, start, _ in held[k][2]]
        yield _batch([np.array(c) for c in zip(*rows, strict=True)], kinds, names)

    return dealt.mapInArrow(tidied(run), INTERVAL)


def hot_windows(cuts: DataFrame, scratch: Scratch) -> DataFrame:
    """Windows with a hot anchor that several documents hold: split, smallest document, packed places.

    Partial aggregates leave every distinct window once; those of several documents are
    indexed, in slices of a hash range, and searched for their smallest document.  The
    answer is written, so that the join behind it can be split where a window is hot.
    """
    hot = cuts.filter("shard IS NULL").select("h", "h2", "doc_id", F.col("ordinal").alias("last"), "split", "words", "places")
    distinct = hot.groupBy("h", "h2").agg(F.min("doc_id").alias("doc_id"), F.max("last").alias("most"), F.first("words").alias("words")).filter("doc_id < most").select("h", "h2", "doc_id", "words")
    slice_rows = INDEX_WORDS // WINDOW

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, slice_rows):
                some = b.slice(i, slice_rows)
                least, _ = least_documents(some.column("words").to_pylist(), some.column("doc_id").to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([some.column("h"), some.column("h2"), pa.array(least[:: WINDOW + 1])], ["h", "h2", "least"])

    found = scratch.settle(distinct.mapInArrow(tidied(run), "h long, h2 long, least long"), "least")
    return hot.drop("words").join(found, ["h", "h2"]).filter("last > least").select("split", "least", "places")


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _intervals(repeated: tuple, split: int) -> dict[str, np.ndarray] | None:
    """All repeated intervals of a split by ordinal: those found by search, and the common windows."""
    parts = []
    if (found := _fetch(repeated[0], split, ["ordinal", "start", "n"])) is not None:
        parts.append(np.stack([found["ordinal"], found["start"].astype(np.int64), found["n"].astype(np.int64)]))
    if (found := _fetch(repeated[1], split, ["least", "places"])) is not None:
        for least, packed in zip(found["least"].tolist(), found["places"], strict=True):
            doc, ordinal, start = np.frombuffer(packed, np.int64).reshape(-1, 3).T
            later = doc > least
            parts.append(np.stack([ordinal[later], start[later], np.ones(int(later.sum()), np.int64)]))
    if not parts:
        return None
    whole = np.concatenate(parts, axis=1)
    whole = whole[:, np.argsort(whole[0], kind="stable")]
    return {"ordinal": whole[0], "start": whole[1], "n": whole[2]}


def _rest_of(batches, repeated: tuple, names: tuple[str, str] = ("split", "ordinal")) -> Iterator[tuple[pa.RecordBatch, dict[str, list]]]:
    """Runs of rows and what their repeated intervals leave: counts, hashes and texts (bytes)."""
    current, known = None, None
    for b in batches:
        for split, ordinal, rows in _splits(b, names):
            if split != current:
                known, current = _intervals(repeated, split), split
            for i, j, w in _words_of(rows):
                yield rows.slice(i, j - i), _rest(w, ordinal[i:j], known)


def _rest(w: Words, ordinal: np.ndarray, known: dict[str, np.ndarray] | None) -> dict[str, list]:
    gone = np.zeros(len(w.start) + 1, np.int64)
    if known is not None:
        low, high = np.searchsorted(known["ordinal"], [ordinal[0], ordinal[-1] + 1])
        start = known["start"][low:high] + w.first[np.searchsorted(ordinal, known["ordinal"][low:high])]
        np.add.at(gone, start, 1)
        np.add.at(gone, start + known["n"][low:high] + WINDOW - 1, -1)
    gone = np.cumsum(gone)[:-1] > 0
    total = np.concatenate([[0], np.cumsum(gone)])
    removed = (total[w.first[1:]] - total[w.first[:-1]]).tolist()
    raw, first, kept = w.buf.tobytes(), w.first.tolist(), []
    for k, lost in enumerate(removed):
        i, j = first[k], first[k + 1]
        words = raw[int(w.start[i]) : int(w.end[j - 1])].split() if j > i else []
        if lost:
            words = [x for x, g in zip(words, gone[i:j].tolist(), strict=True) if not g]
        kept.append(b" ".join(words))
    return {"n_words": w.counts.tolist(), "n_removed": removed, "kept_sha256": [hashlib.sha256(t).hexdigest() for t in kept], "kept_text": kept}


def keep_rest(texts: DataFrame, repeated: tuple, with_text: bool = False) -> DataFrame:
    """What the repeated intervals leave of every text: counts and hash, and the text itself when wanted."""
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text
    kinds = {"n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "kept_text": pa.binary()}

    def run(batches):
        for rows, result in _rest_of(batches, repeated):
            cols = [pa.array(result[c], kinds[c]) for c in names[1:]]
            if with_text:
                cols[-1] = cols[-1].cast(pa.string())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *cols], names)

    return texts.mapInArrow(tidied(run), RESULT + (", kept_text string" if with_text else ""))


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text) of every row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "substring")
    texts = named_rows(only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")), scratch)
    return keep_rest(texts, find_repeats(texts, scratch), with_text)


def rewrite_documents(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` with the repeated words gone from the texts (and ``n_chars`` counted anew).

    A text that loses nothing stays as it is; of the others the kept words are joined by
    one space, and nothing is left of a text that only repeats earlier ones.
    """
    scratch = Scratch(docs.sparkSession, "substring")
    schema, names = docs.schema, ("split", "ordinal")
    while set(names) & set(docs.columns):
        names = (names[0] + "_", names[1] + "_")
    texts = named_rows(docs, scratch, names)
    places = texts.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(names[0]).alias("split"), F.col(names[1]).alias("ordinal"))
    repeated = find_repeats(places, scratch)

    def run(batches):
        for rows, result in _rest_of(batches, repeated, names):
            lost, kept = result["n_removed"], result["kept_text"]
            old = rows.column("text").to_pylist()
            new = [k.decode() if n else t for n, k, t in zip(lost, kept, old, strict=True)]
            cols = []
            for field in schema:
                column = rows.column(field.name)
                if field.name == "text":
                    column = pa.array(new, pa.string())
                elif field.name == "n_chars":
                    column = pa.array([len(t) if n else c for n, t, c in zip(lost, new, column.to_pylist(), strict=True)], column.type)
                cols.append(column)
            yield pa.RecordBatch.from_arrays(cols, schema.names)

    return texts.mapInArrow(tidied(run), schema)


def find_repeats(texts: DataFrame, scratch: Scratch) -> tuple:
    """Where the repeated intervals of the texts and their repeated common windows are written, by split."""
    buckets = _buckets(texts)
    many = anchor_rows(texts, named=True).groupBy("anchor").agg(F.min("doc_id").alias("shard"), F.max("doc_id").alias("last"), F.count("*").alias("n")).filter("shard < last")
    many = scratch.settle(many.select("anchor", "shard", "n", (F.col("n") >= HOT).alias("hot")), "anchors")
    # A document whose anchors occur very often, such as a very long one with a small id, gets several shards.
    load = many.filter("NOT hot").groupBy("shard").agg(F.sum("n").alias("n")).filter(F.col("n") > SHARD_ANCHORS)
    load = scratch.settle(load.select("shard", F.ceil(F.col("n") / SHARD_ANCHORS).alias("parts")), "load")
    part = F.when(F.col("parts").isNotNull(), F.pmod("anchor", F.col("parts"))).otherwise(F.lit(0).cast("long"))
    dealt = many.join(few_or_many(load), "shard", "left").select("anchor", F.xxhash64("shard", part).alias("shard"), "hot")
    shared = by_split(anchor_rows(texts, named=False).join(dealt.hint("shuffle_hash"), "anchor"), scratch, "shared", buckets)
    scratch.drop(many)
    cuts = scratch.settle(stretches(texts, shared), "stretches")
    repeated = by_split(search_shards(cuts.filter("shard IS NOT NULL")), scratch, "repeated", buckets)
    return repeated, by_split(hot_windows(cuts, scratch), scratch, "common", buckets)
