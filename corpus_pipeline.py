"""The corpus pipeline: toxic documents go, one of each group of near copies stays, repeated
passages go, documents that leak a benchmark go, and what is left is encoded.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of ``documents``.  For odd rows all stages agree:

* a null in ``lang``, ``source`` or ``n_chars`` and columns of any other name, those that the
  operators use themselves included, pass through untouched;
* a null or empty text is a document without words: it is scored, linked with nothing, loses
  nothing, leaks nothing and has no pieces;
* a very long text is worked on whole; repeated rows are judged one by one, except where a
  stage removes documents by their id, which removes all rows of that id;
* an empty table gives an empty table with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import decontaminate, minhash_dedup, pieces, substring_dedup, toxicity
from siltstone.llm.common import Scratch, prepare, table


#: Similarity of five-word shingles, in percent, from which two documents are near copies (op8's 85 is that query's own).
NEAR_PERCENT = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score below the operator's threshold, the labels of ``sf_dir`` being learnt from.

    A text without words scores as the bias says; a row with a null id is scored like any
    other; scores at the threshold go.  Without labels of both classes no row goes unless
    all labels are positive.
    """
    prepare(spark)
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts linked at ``NEAR_PERCENT``, the one with the smallest id.

    A tie at exactly that similarity is a link.  Texts without words are never linked; a row
    with a null id always stays; of rows that repeat an id all stay or all go.
    """
    prepare(spark)
    return minhash_dedup.without_copies(docs, percent=NEAR_PERCENT)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, its text without the words of windows that a document with a smaller id holds too.

    A text that loses nothing stays as it is, white space included; one that loses all is
    empty.  Rows with a null id lose nothing and take nothing from others; rows of one id
    take nothing from each other.  ``n_chars`` follows the text where it changes.
    """
    prepare(spark)
    return substring_dedup.rewrite_documents(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that leak no item of the benchmark of ``sf_dir``.

    Items without a text, and those too short to tell a leak, remove nothing; a leaking row
    takes all rows of its id along, rows with a null id included.
    """
    prepare(spark)
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, lossless and decoded_sha256 of every row, repeated rows and null ids too."""
    prepare(spark)
    return pieces.encode_documents(docs)


STAGES = [("toxicity", drop_toxic), ("near-dedup", drop_near_copies), ("substring dedup", drop_repeated_passages), ("decontamination", drop_leaks), ("sentencepiece", encode)]

#: A trained classifier decides in the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each one's rows are written and read again for the next."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        after = scratch.settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
