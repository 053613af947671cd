"""Table sinks and scans: partitioned chunks and traces, a flat vector store, a content-addressed embedding cache."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.retrieval import matrix_search, top_k


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, under the one the cluster names; a temporary one on a single machine.

    It is deleted when the program ends, if the session still lives then.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="siltstone-")
    folder = f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, folder)
    return folder


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _forget(spark: SparkSession, folder: str) -> None:
    try:
        _delete(spark, folder)
    except Exception:  # the session has gone already
        pass


def kept(rows: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The rows written to a new shared folder and read back: computed once for all that reads them later."""
    spark, folder = rows.sparkSession, shared_folder(rows.sparkSession, name)
    rows.write.option("compression", "zstd").partitionBy(*by).parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)


@contextmanager
def settled(rows: DataFrame, name: str) -> Iterator[DataFrame]:
    """The rows written to a new shared folder and read back, for as long as the block runs; then the folder is deleted."""
    spark, folder = rows.sparkSession, shared_folder(rows.sparkSession, name)
    try:
        rows.write.option("compression", "zstd").parquet(folder)
        yield spark.read.schema(rows.schema).parquet(folder)
    finally:
        _delete(spark, folder)


def write_chunks(chunks: DataFrame, folder: str) -> None:
    """One folder per chunking strategy; a scan of one strategy reads only its folder."""
    chunks.write.mode("overwrite").partitionBy("strategy").parquet(folder)


def write_traces(traces: DataFrame, folder: str) -> None:
    """One folder per arm, rows sorted by question."""
    arms = ["condition", "model", "prompt"]
    traces.repartition(*arms).sortWithinPartitions(*arms, "question_id").write.mode("overwrite").partitionBy(*arms).parquet(folder)


class VectorTable:
    """Append-only unit vectors with exact inner-product search."""

    def __init__(self, rows: DataFrame, size: int):
        self.rows, self.size = rows, size

    @staticmethod
    def load(spark: SparkSession, folder: str, size: int) -> "VectorTable":
        return VectorTable(spark.read.parquet(folder), size)

    def add(self, rows: DataFrame) -> "VectorTable":
        """A vector of another length fails the job that reads it."""
        fit = F.when(F.size("v") == self.size, F.col("v")).otherwise(F.raise_error(F.lit(f"a vector has not {self.size} cells")))
        return VectorTable(self.rows.unionByName(rows.select("item_id", fit.alias("v"))), self.size)

    def persist(self, folder: str) -> None:
        self.rows.write.mode("overwrite").parquet(folder)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """``queries``: query_id and q, a stated set that is broadcast in blocks."""
        return top_k(matrix_search(self.rows, queries, k), k, "item_id")


def missing_texts(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct texts (by SHA-256) that the cache (text_sha, v) lacks: what remains to be embedded."""
    keyed = texts.select(F.sha2("text", 256).alias("text_sha"), "text").dropDuplicates(["text_sha"])
    return keyed.join(cache.select("text_sha"), "text_sha", "left_anti")


def cached_vectors(texts: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """The cached vector of every row; null where it is missing."""
    return texts.withColumn("text_sha", F.sha2("text", 256)).join(cache, "text_sha", "left").select(key, "v")


def request_key(system: Column, user: Column, params: Column) -> Column:
    """SHA-256 over the request as canonical JSON: fields and parameters in fixed order."""
    ordered = F.map_from_entries(F.array_sort(F.map_entries(params)))
    return F.sha2(F.to_json(F.struct(ordered.alias("params"), system.alias("system"), user.alias("user"))), 256)
