"""Session, table and scratch-storage helpers of this subpackage."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch; documents of usual length make a batch of some megabytes.
BATCH_ROWS = 1000
#: Bytes of an Arrow batch, whatever its rows (documents may be very long).
BATCH_BYTES = 8 << 20

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def prepare(spark: SparkSession) -> SparkSession:
    """Bounds Arrow batches, so that long texts cannot fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder; a small one, read in fewer splits than there are cores, is dealt out to them."""
    rows = prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if name in ("documents", "pages") and rows.rdd.getNumPartitions() < cores else rows


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the cluster names none (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        context = spark.sparkContext._jsc.sc().getCheckpointDir()
        if context.isDefined():
            return context.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="siltstone-")
        spark.sparkContext.setCheckpointDir(where)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return where


def remove_tree(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Hadoop's file system layer, wherever it is."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(self._quiet_remove)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def settle(self, df: DataFrame, name: str) -> DataFrame:
        """Writes the rows and reads them back; ``drop`` later frees the disk."""
        where = self.path(name)
        df.write.option("compression", "zstd").parquet(where)
        out = self.spark.read.schema(df.schema).parquet(where)
        out._siltstone_path = where
        return out

    def drop(self, df: DataFrame) -> None:
        remove_tree(self.spark, df._siltstone_path)

    def _quiet_remove(self) -> None:
        try:
            remove_tree(self.spark, self.root)
        except Exception:  # the session has gone already
            pass


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, whatever else (clashing names included) the table holds."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A map over Arrow batches that gives freed memory back when its task ends: Python workers outlive tasks."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:  # glibc
                trim(0)

    return wrapped


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``mapInArrow`` of a function of one batch; empty batches are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(tidied(run), schema)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Ids are broadcast only up to so many rows of one number; beyond, tables are joined by a shuffle.
BROADCAST_ROWS = 500_000


def few_or_many(ids: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a written table of ids for broadcast if it is small enough, counted here."""
    return F.broadcast(ids) if ids.count() <= most else ids
