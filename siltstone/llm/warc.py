"""WARC archives: write records with an index, then read selected records by coalesced byte ranges.

Writing: every page becomes one gzip member of a ``.warc.gz`` file in a folder that all
executors share.  Of the pages with equal payloads of at least ``min_revisit`` bytes, that
with the largest id holds the payload (``response``); the others are ``revisit`` records
that refer to it.  Each writing task names its file by its partition and attempt and
renames it when whole, so a task that runs again leaves no half-written archive, and the
index holds only the files of the attempts that counted.

Index first: one row per record with file, offset, length, URL, payload digest, kind.

Reading: the index rows wanted are sorted by file and offset, dealt out by byte windows
of each file, and neighbouring ranges are merged into one read when the gap between them
is small and the merged read stays bounded.

Defined results: a null or empty html is an empty payload; a null URL is written as an
empty target; repeated rows give repeated records; no pages give no records.  Every row
has its own record, whatever its id: rows of one id with different payloads are told
apart by their digests, rows of one id with equal payloads are both of the same kind, and
a row with a null id has a record without a number, which is always a response and which
nothing refers to.  Columns beside id, url and html are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, only, tidied

MIN_REVISIT = 1000
#: A merged read spans gaps of up to MAX_GAP bytes and MAX_READ bytes in all.
MAX_GAP = 64 << 10
MAX_READ = 8 << 20
#: Index rows are dealt to readers by windows of WINDOW bytes of a file, some READER_BYTES a task.
WINDOW = 8 << 20
READER_BYTES = 32 << 20

INDEX = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, file string, offset long, length long"


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def with_sums(pages: DataFrame) -> DataFrame:
    """Adds payload size and hex SHA-1 of the payload, computed by built-in functions."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    return pages.withColumn("n", F.length(payload).cast("long")).withColumn("digest", F.sha1(payload))


def revisits(sums: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """(page_id, digest, refers_to) of the pages whose payload a page with a larger id holds too."""
    big = sums.filter(F.col("n") >= min_revisit).select("page_id", "digest")
    held = big.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("copies")).filter("copies > 1")
    return big.join(held, "digest").filter("page_id < refers_to").select("page_id", "digest", "refers_to").distinct()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_of(urn: str | None) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">") if urn else ""
    return int(number) if number else None


def record_head(page_id: int | None, url: str, kind: str, digest: str, length: int, refers_to: int | None) -> bytes:
    """WARC/1.1 header block; deterministic, so that equal input gives equal archives."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z",
             f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: text/html; charset=utf-8"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join([*lines, f"Content-Length: {length}", "", ""]).encode()


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-cased names; ``version`` too) and the payload of an unzipped record."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not gap or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {"version": lines[0]}
    for line in lines[1:]:
        name, _, value = line.partition(":")
        fields[name.lower()] = value.strip()
    n = int(fields["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("record length does not match its header")
    return fields, rest[:n]


def gzip_member(raw: bytes, level: int = 1) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def write_archives(pages: DataFrame, folder: str, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Lazy index of the archives that reading it writes to ``folder`` (a URI that executors reach)."""
    wanted = with_sums(only(pages, "page_id", "url", "html").withColumn("page_id", F.col("page_id").cast("long")))
    planned = wanted.join(revisits(wanted, min_revisit), ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz"
        store, root = _filesystem(folder)
        sink, offset, rows = None, 0, []
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")]
            for page_id, url, html, refers_to in zip(*cols, strict=True):
                if sink is None:
                    store.create_dir(root, recursive=True)
                    sink = store.open_output_stream(f"{root}/.{name}", compression=None)
                payload = (html or "").encode("utf-8")
                kind = "response" if refers_to is None else "revisit"
                digest = hashlib.sha1(payload).hexdigest()
                body = payload if refers_to is None else b""
                target = " ".join((url or "").split())
                member = gzip_member(record_head(page_id, target, kind, digest, len(body), refers_to) + body + b"\r\n\r\n")
                sink.write(member)
                rows.append((page_id, url, kind, refers_to, digest, len(payload), f"{folder}/{name}", offset, len(member)))
                offset += len(member)
        if sink is None:
            return
        sink.close()
        store.move(f"{root}/.{name}", f"{root}/{name}")
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        names = [c.split()[0] for c in INDEX.split(", ")]
        for i in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 10_000], strict=True), kinds, strict=True)], names)

    return planned.mapInArrow(tidied(write), INDEX)


def coalesce_ranges(spans: list[tuple[int, int]], max_gap: int = MAX_GAP, max_read: int = MAX_READ) -> list[tuple[int, int, int]]:
    """Merges sorted (offset, length) spans: (first span, past the last, bytes to read) of each read."""
    out: list[tuple[int, int, int]] = []
    i = 0
    while i < len(spans):
        begin, end, j = spans[i][0], sum(spans[i]), i + 1
        while j < len(spans) and spans[j][0] - end <= max_gap and sum(spans[j]) - begin <= max_read:
            end, j = max(end, sum(spans[j])), j + 1
        out.append((i, j, end - begin))
        i = j
    return out


def read_records(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """Reads the records of the given index rows back and parses them.

    Returns page_id, record_type, refers_to, stored_digest (of the record's header),
    read_bytes and read_digest of the payload as read, and the payload when wanted.
    """
    spread = index.select("file", "offset", "length").withColumn("win", F.floor(F.col("offset") / F.lit(WINDOW)))
    # The index rows are small, what they stand for is not: the number of readers follows the bytes to read.
    total = int(spread.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0])
    readers = max(-(-total // READER_BYTES), index.sparkSession.sparkContext.defaultParallelism)
    sorted_ranges = spread.repartition(readers, "file", "win").sortWithinPartitions("file", "offset")
    schema = "page_id long, record_type string, refers_to long, stored_digest string, read_bytes long, read_digest string" + (", payload binary" if with_payload else "")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_name, source = None, None
        for b in batches:
            files, offsets, lengths = (b.column(i).to_pylist() for i in range(3))
            i = 0
            while i < len(files):
                j = i
                while j < len(files) and files[j] == files[i]:
                    j += 1
                if open_name != files[i]:
                    store, path = _filesystem(files[i])
                    source, open_name = store.open_input_file(path), files[i]
                spans = list(zip(offsets[i:j], lengths[i:j], strict=True))
                for first, past, size in coalesce_ranges(spans):
                    begin = spans[first][0]
                    raw = source.read_at(size, begin)
                    rows = []
                    for at, n in spans[first:past]:
                        fields, payload = parse_record(zlib.decompress(raw[at - begin : at - begin + n], 31))
                        row = (_page_of(fields["warc-record-id"]), fields["warc-type"], _page_of(fields.get("warc-refers-to")),
                               fields["warc-payload-digest"].removeprefix("sha1:"), len(payload), hashlib.sha1(payload).hexdigest())
                        rows.append((*row, payload) if with_payload else row)
                    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary())
                    names = ["page_id", "record_type", "refers_to", "stored_digest", "read_bytes", "read_digest", "payload"]
                    cols = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds[: len(cols)], strict=True)], names[: len(cols)])
                i = j

    return sorted_ranges.mapInArrow(tidied(read), schema)


def archive_and_read(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Writes all pages, settles the index, reads every record back; one row per page.

    A revisit's size and digest are those of the response it refers to, as read back.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    folder = f"{scratch.root}/archives"
    index = scratch.settle(write_archives(pages, folder, min_revisit), "index")
    records = scratch.settle(read_records(index, with_payload=False), "records")
    whole = records.filter("record_type = 'response'").select("page_id", F.col("read_bytes").alias("payload_bytes"), F.col("read_digest").alias("payload_digest"), "record_type", "refers_to")
    # A response of that number with the digest in the revisit's header must have been read back; it tells the size.
    sizes = whole.select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("stored_digest"), "payload_bytes").distinct()
    joined = records.filter("record_type = 'revisit'").select("page_id", "record_type", "stored_digest", "refers_to").join(sizes, ["refers_to", "stored_digest"], "left")
    lost = F.raise_error(F.format_string("revisit of page %s has another digest than its response", F.col("page_id")))
    checked = F.when(F.col("payload_bytes").isNotNull(), F.col("stored_digest")).otherwise(lost)
    revisited = joined.select("page_id", "payload_bytes", checked.alias("payload_digest"), "record_type", "refers_to")
    return whole.unionByName(revisited)
