"""Chunkers: closed-form windows in SQL; snapped windows and greedy packing as folds over one document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Chunk ids of a document start at its id times this many: enough for texts of four thousand million characters.
CHUNK_IDS = 10_000_000


def plain_windows(docs: DataFrame, size: int = 512, overlap: int = 64) -> DataFrame:
    """Windows at fixed steps; a tail that the window before already holds is left out."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than the window")
    step, reach = size - overlap, -(-size // (size - overlap))
    # The text is cut into steps once: positions in a long text are never counted anew for every window.
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    cut = docs.filter(F.length("text") > 0).select("doc_id", F.length("text").alias("n"), pieces.alias("pieces"))
    windows = F.transform("pieces", lambda _, i: F.substring(F.array_join(F.slice(F.col("pieces"), i + 1, F.lit(reach)), ""), 1, size))
    starts = F.greatest(F.ceil((F.col("n") - overlap) / step), F.lit(1)).cast("int")
    rows = cut.select("doc_id", "n", F.posexplode(F.slice(windows, F.lit(1), starts)).alias("i", "text"))
    start = F.col("i").cast("bigint") * step
    return rows.select("doc_id", (F.col("doc_id") * CHUNK_IDS + F.col("i")).alias("chunk_id"), start.alias("char_start"), F.least(start + size, F.col("n")).cast("bigint").alias("char_end"), "text")


def snapped_bounds(text: str, size: int = 512, overlap: int = 64) -> Iterator[tuple[int, int]]:
    """Windows whose end goes back to the last space; the next one starts ``overlap`` before that end."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than the window")
    begin, n = 0, len(text)
    while begin < n:
        end = min(begin + size, n)
        if end < n and (space := text.rfind(" ", begin, end)) > begin:
            end = space
        yield begin, end
        if end >= n:
            return
        begin = end - overlap if end - overlap > begin else end


def snapped_windows(docs: DataFrame, size: int = 512, overlap: int = 64, with_text: bool = False) -> DataFrame:
    """doc_id, place, char_start, char_end (and text) of snapped windows: a map over texts, no shuffle."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than the window")

    def run(frames):
        for f in frames:
            rows = [(d, k, a, z, t[a:z] if with_text else None) for d, t in zip(f.doc_id, f.text, strict=True) for k, (a, z) in enumerate(snapped_bounds(t or "", size, overlap))]
            yield pd.DataFrame(rows, columns=["doc_id", "place", "char_start", "char_end", "text"])

    rows = docs.select("doc_id", "text").mapInPandas(run, "doc_id long, place int, char_start long, char_end long, text string")
    return rows if with_text else rows.drop("text")


def packed_bounds(text: str, most: int = 1024, table_alone: bool = False) -> Iterator[tuple[int, int]]:
    """Bounds, in the text itself, of its lines packed as ``packed`` does: a line without a full stop and of at most
    40 characters heads a section, one with a bar is a table."""
    at, section, first, was_table = 0, None, None, False
    for raw in text.split("\n"):
        line = raw.strip(" \t\r")
        begin = at + len(raw) - len(raw.lstrip(" \t\r"))
        at += len(raw) + 1
        if not line:
            continue
        end, table = begin + len(line), "|" in line
        if len(line) <= 40 and "." not in line:
            section = line
        if first is not None and section == first[0] and end - first[1] <= most and not (table_alone and (table or was_table)):
            stop = end
        else:
            if first is not None:
                yield first[1], stop
            first, stop = (section, begin), end
        was_table = table
    if first is not None:
        yield first[1], stop


def plain_bounds(text: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Bounds of the windows of ``plain_windows``."""
    for begin in range(0, len(text), size - overlap):
        if begin == 0 or begin + overlap < len(text):
            yield begin, min(begin + size, len(text))


#: Chunkings that are plain windows: size and overlap.
PLAIN = {"plain512": (512, 64), "plain256": (256, 32)}
#: Chunkings by name: bounds of the chunks of a text.
CHUNKERS = {
    "plain512": lambda t: plain_bounds(t, *PLAIN["plain512"]),
    "plain256": lambda t: plain_bounds(t, *PLAIN["plain256"]),
    "snapped512": snapped_bounds,
    "recursive": packed_bounds,
    "table_aware": lambda t: packed_bounds(t, table_alone=True),
}


def chunk_bounds(name: str, texts: list[str]) -> np.ndarray:
    """Text, place in it, begin and end of the chunks of many texts, as rows of a matrix; plain windows without a step for each."""
    if name not in PLAIN:
        return np.array([(d, k, a, z) for d, t in enumerate(texts) for k, (a, z) in enumerate(CHUNKERS[name](t))], np.int64).reshape(-1, 4).T
    size, overlap = PLAIN[name]
    length = np.array([len(t) for t in texts], np.int64)
    n = np.where(length > 0, np.maximum(-(-(length - overlap) // (size - overlap)), 1), 0)
    doc = np.repeat(np.arange(len(texts)), n)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    begin = place * (size - overlap)
    return np.stack([doc, place, begin, np.minimum(begin + size, length[doc])])


def all_chunks(docs: DataFrame, names: tuple[str, ...] = tuple(CHUNKERS)) -> DataFrame:
    """chunking, doc_id, chunk_id, char_start, char_end, text of several chunkings from one read of the texts: a map, no shuffle.

    Chunks of one chunking are numbered within their document.
    """

    def run(frames):
        for f in frames:
            for d, t in zip(f.doc_id, f.text, strict=True):
                rows = [(name, d, d * CHUNK_IDS + k, a, z, t[a:z]) for name in names for k, (a, z) in enumerate(CHUNKERS[name](t or ""))]
                if rows:
                    yield pd.DataFrame(rows, columns=["chunking", "doc_id", "chunk_id", "char_start", "char_end", "text"])

    return docs.filter("doc_id IS NOT NULL").select("doc_id", "text").mapInPandas(run, "chunking string, doc_id long, chunk_id long, char_start long, char_end long, text string")


def packed(blocks: DataFrame, most: int = 1024, table_alone: bool = False) -> DataFrame:
    """Greedy packing of whole blocks, a fold over each document's blocks in order.

    A chunk ends before a block of another section and before a block that would make it
    longer than ``most``.  With ``table_alone`` every table block is a chunk of its own.
    ``blocks``: doc_id, pos, section, is_table, char_start, char_end.  Only bounds enter
    the fold, so a group is the offsets of one document, never its text.
    """
    parts = ("pos", "section", "is_table", "char_start", "char_end")
    b = blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*parts))).alias("b"))
    kind = dict(blocks.dtypes)["doc_id"]
    schema = f"doc_id {kind}, place int, char_start long, char_end long, section string, is_table boolean, n_blocks long"
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [None, pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64()]

    def chunks_of(rows) -> Iterator[tuple]:
        first = None  # the block that opened the chunk, its last end, whether it has a table, its number of blocks
        for _, section, table, start, end in rows:
            if first is not None and section == first[0] and end - first[1] <= most and not (table_alone and (table or last_table)):
                stop, any_table, n = max(stop, end), any_table or table, n + 1
            else:
                if first is not None:
                    yield first[1], stop, first[0], any_table, n
                first, stop, any_table, n = (section, start), end, table, 1
            last_table = table
        if first is not None:
            yield first[1], stop, first[0], any_table, n

    def run(batches):
        for batch in batches:
            lists = batch.column("b")
            fields = [lists.flatten().field(c).to_pylist() for c in parts]
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)).tolist()
            rows, owners, begin = [], [], 0
            for d, end in enumerate(ends):
                for place, chunk in enumerate(chunks_of(zip(*(f[begin:end] for f in fields), strict=True))):
                    rows.append((place, *chunk))
                    owners.append(d)
                begin = end
            if rows:
                cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(owners)), *cols], names)

    return b.mapInArrow(run, schema)
