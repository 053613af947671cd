"""Release archives: tar files whose bytes depend on their members alone, and a data source that reads only those a filter wants.

Writing: members are dealt to archives by ranges of their ids, sorted by id and content, and an
archive ends at ``ARCHIVE_BYTES`` of contents.  Names, order, times and modes are fixed, so the
same table gives the same archives whatever the partitioning, and a task that runs again
writes the same bytes under the same name.  The manifest has a row an archive: its file,
SHA-256, number of members, and least and greatest id.

Reading (``spark.read.format("release_archives")``): the manifest is read once, by the driver; each
archive whose ids can meet the pushed comparisons on ``id`` is planned, some ``SPLIT_BYTES`` a task.  A task
streams its archives member by member and fails if one has not the released digest.

Defined results: a null id is written under the name ``none`` and read back as null (no comparison
wants it); repeated ids are members of their own; a null content is empty; no rows give no archive.
"""

from __future__ import annotations

import hashlib
import io
import tarfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.dataset as pads
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

ARCHIVE_BYTES = 32 << 20
#: Bytes of archives that a task reads.
SPLIT_BYTES = 128 << 20
MANIFEST = "file string, sha256 string, n long, n_bytes long, least long, greatest long"
MEMBERS = "id long, content binary"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def member(name: str, content: bytes) -> bytes:
    """Header and padded content of a member."""
    info = tarfile.TarInfo(name)
    info.size, info.mtime, info.mode = len(content), 0, 0o644
    return info.tobuf(tarfile.USTAR_FORMAT) + content + b"\0" * (-len(content) % 512)


#: What ends an archive: two empty blocks.
END = b"\0" * 1024


def write_archives(members: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes (id long, content string or binary) to archives under ``folder``; returns the manifest, stored beside them."""
    spark = members.sparkSession
    rows = members.select(F.col("id").cast("long").alias("id"), F.coalesce(F.col("content").cast("binary"), F.lit(b"")).alias("content"))
    known = rows.agg(F.min("id"), F.max("id"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0))).first()
    buckets = max(1, -(-int(known[2]) // archive_bytes))
    width = max(1, -(-((known[1] or 0) - (known[0] or 0) + 1) // buckets))
    bucket = F.coalesce(F.floor((F.col("id") - F.lit(known[0] or 0)) / F.lit(width)), F.lit(-1)).cast("long")
    sha = F.sha2(F.col("content"), 256)
    dealt = rows.withColumn("bucket", bucket).withColumn("sha", sha).repartition(min(buckets + 1, 10_000), "bucket").sortWithinPartitions("bucket", "id", "sha")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(folder)
        attempt = TaskContext.get().taskAttemptId()
        sink = name = None
        last, number, digest, facts = None, 0, None, []

        def finish() -> None:
            sink.write(END)
            digest.update(END)
            sink.close()
            store.move(f"{root}/.{name}-{attempt}", f"{root}/{name}")
            facts.append((f"{folder}/{name}", digest.hexdigest(), n, size, least, greatest))

        for b in batches:
            for i, content, at in zip(b.column("id").to_pylist(), b.column("content").to_pylist(), b.column("bucket").to_pylist(), strict=True):
                if sink is not None and (at != last or size + len(content) > archive_bytes):
                    finish()
                    sink = None
                if sink is None:
                    number = number + 1 if at == last else 0
                    last, name = at, f"archive-{at + 1:010d}-{number:06d}.tar"
                    store.create_dir(root, recursive=True)
                    sink, digest = store.open_output_stream(f"{root}/.{name}-{attempt}", compression=None), hashlib.sha256()
                    n, size, least, greatest = 0, 0, i, i
                raw = member("none" if i is None else f"{i}", content)
                sink.write(raw)
                digest.update(raw)
                n, size, greatest = n + 1, size + len(content), i
        if sink is not None:
            finish()
        if facts:
            kinds = (pa.string(), pa.string(), *[pa.int64()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*facts, strict=True), kinds, strict=True)], [c.split()[0] for c in MANIFEST.split(", ")])

    dealt.mapInArrow(run, MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """id and content of all members; comparisons with ``id`` are pushed to the choice of archives."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("release_archives").option("path", folder).load()


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "release_archives"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options["path"].rstrip("/"))


class Archives(InputPartition):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class _Hashed(io.RawIOBase):
    """A stream that takes the digest of what is read from it."""

    def __init__(self, inner):
        self.inner, self.digest = inner, hashlib.sha256()

    def readable(self) -> bool:
        return True

    def read(self, n: int = -1) -> bytes:
        raw = self.inner.read(n if n >= 0 else None)
        self.digest.update(raw)
        return raw


class ArchiveReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder
        self.least, self.greatest, self.wanted = None, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Notes what comparisons ask of ids; all of them are applied to the members again by Spark."""
        for f in filters:
            if getattr(f, "attribute", None) == ("id",):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.least = f.value if self.least is None else max(self.least, f.value)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.greatest = f.value if self.greatest is None else min(self.greatest, f.value)
                if isinstance(f, In):
                    values = {v for v in f.value if v is not None}
                    self.wanted = values if self.wanted is None else self.wanted & values
            yield f

    def _may_hold(self, least: int | None, greatest: int | None) -> bool:
        if self.least is None and self.greatest is None and self.wanted is None:
            return True
        if greatest is None:  # only null ids, which no comparison wants
            return False
        if least is None:
            least = -(1 << 63)
        fits = (self.least is None or greatest >= self.least) and (self.greatest is None or least <= self.greatest)
        return fits and (self.wanted is None or any(least <= v <= greatest for v in self.wanted))

    def partitions(self) -> list[InputPartition]:
        store, path = filesystem(f"{self.folder}/manifest")
        rows = pads.dataset(path, filesystem=store, format="parquet").to_table(columns=["file", "sha256", "n_bytes", "least", "greatest"]).to_pylist()
        out, held, size = [], [], 0
        for r in sorted(rows, key=lambda r: r["file"]):
            if self._may_hold(r["least"], r["greatest"]):
                held.append((r["file"], r["sha256"]))
                size += r["n_bytes"]
                if size >= SPLIT_BYTES:
                    out.append(Archives(held))
                    held, size = [], 0
        return [*out, Archives(held)] if held or not out else out

    def read(self, partition: Archives) -> Iterator[pa.RecordBatch]:
        for name, sha in partition.files:
            store, path = filesystem(name)
            with store.open_input_stream(path, compression=None) as raw:
                stream = _Hashed(raw)
                with tarfile.open(fileobj=stream, mode="r|") as tar:
                    ids, contents, size = [], [], 0
                    for info in tar:
                        ids.append(None if info.name == "none" else int(info.name))
                        contents.append(tar.extractfile(info).read())
                        size += info.size
                        if size >= 8 << 20 or len(ids) >= 1000:
                            yield self._batch(ids, contents)
                            ids, contents, size = [], [], 0
                while stream.read(1 << 20):
                    pass
                if stream.digest.hexdigest() != sha:
                    raise ValueError(f"{name} is not the archive that was released")
                if ids:
                    yield self._batch(ids, contents)

    @staticmethod
    def _batch(ids: list, contents: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(contents, pa.binary())], ["id", "content"])
