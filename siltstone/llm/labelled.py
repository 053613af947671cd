"""Bounded, deterministic samples of labelled documents, and the split that keeps a third of them out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only, tidied

FOLDS = 3
HELD_OUT_FOLD = 1


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo the folds; fold 1 is never learnt from."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """(doc_id, y, fold, text) of at most ``per_class`` documents of each class outside the held-out fold, one row each.

    Which ones is fixed by a hash of the id, so that the sample does not depend on how
    the tables are partitioned.  Rows with a null id or label are passed over; repeated
    labels of one document are averaged, ties being positive; of the rows that repeat an id
    the text with the least hash stands for all, so that a hot id does not add to the sample.
    """
    usable = labels.select(F.col("doc_id"), F.col(label).cast("double").alias("y")).dropna()
    usable = usable.filter(fold_of(F.col("doc_id")) != HELD_OUT_FOLD).groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    order = [F.xxhash64(F.col("doc_id").cast("string"), F.lit(17)), F.col("doc_id")]
    known = only(docs, "doc_id").distinct().join(usable, "doc_id")
    drawn = [known.filter(F.col("y") == y).orderBy(*order).limit(per_class) for y in (0, 1)]
    chosen = F.broadcast(drawn[0].unionByName(drawn[1]))  # 2 * per_class rows of three numbers at most
    texts = only(docs, "doc_id", "text").join(chosen, "doc_id").withColumn("text", F.coalesce("text", F.lit("")))
    one = texts.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return one.select("doc_id", "y", fold_of(F.col("doc_id")).cast("int").alias("fold"), "text")


def with_verdict(docs: DataFrame, scored_schema: str, score_batch, threshold: float) -> DataFrame:
    """Applies a batch scorer (texts column in, float64 scores out) to every row of ``docs``."""
    import pyarrow as pa

    kind = dict(docs.dtypes)["doc_id"]
    rows = only(docs, "doc_id", "text").select("doc_id", F.coalesce(fold_of(F.col("doc_id")) == HELD_OUT_FOLD, F.lit(False)).alias("held_out"), "text")

    def run(batches):
        for b in batches:
            if b.num_rows:
                score = pa.array(score_batch(b.column("text")), pa.float64())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), score], ["doc_id", "held_out", "score"])

    scored = rows.mapInArrow(tidied(run), f"doc_id {kind}, held_out boolean, score double{scored_schema}")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
