"""A resumable runner of request batches: each key is sent once, whatever dies in between.

A stream of requests (``key``, ``request``, ``worst``: the most it may cost) is cut into
submissions of bounded size and cost.  For each, the states are written in this order, every
one under the name of its submission, so that a repeated trigger finds what an earlier one did:

1. ``planned``: the keys and requests of all submissions of an attempt, as a table of the shared folder;
2. ``sent``: an empty mark, written right before the service is called with the folder of 1.
   The service takes a submission's name once; if the mark is there, the runner asks
   whether the service knows the name before it calls;
3. ``done``: key, response, attempt, as a table; keys that failed stay open for ``attempts`` times.

Keys that are done, or planned in another submission, are left out by anti-joins.  What happens
in a trigger is decided from the folder alone; Structured Streaming repeats a trigger that did
not end with the same rows.

Defined results: of rows with one key the one with the least request counts; null keys are
passed over; a request that alone exceeds the cost of a submission has one of its own; no rows
write nothing.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

REQUESTS = "key string, request string, worst double"
PLANNED = "submission string, key string, request string, worst double, attempt int"
DONE = "submission string, key string, response string, failed boolean, attempt int"


class Service(Protocol):
    """What runs requests: it takes a submission's folder once by name, and gives (key, response, failed) rows back."""

    def knows(self, submission: str) -> bool: ...

    def submit(self, submission: str, folder: str) -> None: ...

    def collect(self, spark: SparkSession, submission: str) -> DataFrame: ...


class BatchRunner:
    def __init__(self, spark: SparkSession, folder: str, service: Service, most: int = 1000, most_cost: float = 10.0, attempts: int = 3):
        self.spark, self.folder, self.service = spark, folder.rstrip("/"), service
        self.most, self.most_cost, self.attempts = most, most_cost, attempts

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def _files(self, path):
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _there(self, *parts: str) -> bool:
        path = self._path(*parts)
        return self._files(path).exists(path)

    def _table(self, kind: str, schema: str) -> DataFrame:
        """The rows of all parts of a kind that are whole, which their writer says at its end."""
        path = self._path(kind)
        names = [f.getPath().getName() for f in self._files(path).listStatus(path)] if self._there(kind) else []
        out = self.spark.createDataFrame([], schema)
        for name in names:  # a part is a trigger's attempt, or a submission
            if self._there(kind, name, "_SUCCESS"):
                out = out.unionByName(self.spark.read.schema(schema).parquet(self._path(kind, name).toString()))
        return out

    def done(self) -> DataFrame:
        return self._table("done", DONE)

    def _submissions(self, requests: DataFrame, name: str) -> DataFrame:
        """Cuts requests into submissions by running counts and worst costs; sums over ranges of keys come first, so that no task orders all."""
        part = requests.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(64)))
        before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        sums = part.groupBy("part").agg(F.count("*").alias("n"), F.sum("worst").alias("cost"))
        shift = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("cost").over(before), F.lit(0.0)).alias("c0"))
        inside = Window.partitionBy("part").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
        place = F.col("n0") + F.coalesce(F.count("*").over(inside), F.lit(0))
        cost = F.col("c0") + F.coalesce(F.sum("worst").over(inside), F.lit(0.0))
        cut = F.concat_ws("-", F.lit(name), F.floor(place / self.most).cast("string"), F.floor(cost / self.most_cost).cast("string"))
        return part.join(F.broadcast(shift), "part").select(cut.alias("submission"), "key", "request", "worst", "attempt")

    def trigger(self, rows: DataFrame, batch: int) -> None:
        """Plans, sends and collects the rows of one trigger; may be repeated from any point."""
        least = F.min(F.struct("request", "worst")).alias("r")
        requests = rows.filter(F.col("key").isNotNull()).groupBy("key").agg(least).select("key", "r.request", "r.worst")
        for attempt in range(1, self.attempts + 1):
            plan = f"b{batch:09d}a{attempt}"
            if not self._there("planned", plan, "_SUCCESS"):
                open_ = self._open(requests, plan[:10], attempt).withColumn("attempt", F.lit(attempt))
                self._submissions(open_, plan).write.mode("overwrite").partitionBy("submission").parquet(self._path("planned", plan).toString())
            planned = self.spark.read.schema(PLANNED).parquet(self._path("planned", plan).toString())
            for r in sorted(planned.select("submission").distinct().collect()):  # one row a submission
                self._run(plan, r.submission)

    def _open(self, requests: DataFrame, trigger: str, attempt: int) -> DataFrame:
        """What an attempt has to send: at first the keys that no other trigger has planned, then those that failed the time before."""
        if attempt == 1:
            taken = self._table("planned", PLANNED).filter(~F.col("submission").startswith(trigger)).select("key").distinct()
            return requests.join(taken, "key", "left_anti")
        failed = self.done().filter(F.col("submission").startswith(f"{trigger}a{attempt - 1}-") & F.col("failed"))
        return requests.join(failed.select("key"), "key")

    def _run(self, plan: str, submission: str) -> None:
        if self._there("done", submission, "_SUCCESS"):
            return
        folder = self._path("planned", plan, f"submission={submission}").toString()
        if not (self._there("sent", submission) and self.service.knows(submission)):
            mark = self._path("sent", submission)
            self._files(mark).create(mark, True).close()
            self.service.submit(submission, folder)
        asked = self.spark.read.schema("key string, request string, worst double, attempt int").parquet(folder)
        answers = asked.select("key", "attempt").join(self.service.collect(self.spark, submission), "key", "left")
        rows = answers.select(F.lit(submission).alias("submission"), "key", "response", F.coalesce("failed", F.lit(True)).alias("failed"), "attempt")
        rows.write.mode("overwrite").parquet(self._path("done", submission).toString())

    def start(self, requests: DataFrame, checkpoint: str) -> StreamingQuery:
        """Runs the stream of requests until its source is exhausted."""
        return requests.writeStream.foreachBatch(self.trigger).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
