"""A training corpus from raw documents: five stages, each written as Parquet and read again as the next one's documents.

Defined cases: a null or empty text fails the base limits of the first stage; repeated rows are judged alike and one of them stays
after the third stage; null keys pass; further columns of documents pass, whatever their names, but for ids, score, nbest and
round_trip, which the last stage gives; without documents, labels or benchmark rows every stage gives what its operator gives for
an empty table (no labels: the ranking scores all alike, at a half).
"""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinegrid.llm.common import fresh, shared_folder, table
from kinegrid.llm.contamination import decontaminate
from kinegrid.llm.neardup import drop_near_duplicates
from kinegrid.llm.ranking import THRESHOLD, held_out, score, train
from kinegrid.llm.rules import keep_good
from kinegrid.llm.segment import NBEST, Vocabulary, encode


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that weak supervision of the rules keeps."""
    return keep_good(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose ranking score reaches the threshold; the ranking is learnt from the labelled documents of the whole input."""
    model = train(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), train_only=lambda k: ~held_out(k))
    into = fresh(docs.columns, "score")
    return score(docs, model, into=into).where(F.col(into) >= THRESHOLD).drop(into)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the pieces of their best segmentation (ids), its score, the N best, and whether the pieces read back to the text."""
    into = fresh(docs.columns, "decoded")
    back = encode(docs, Vocabulary.load(), nbest=NBEST, decoded=into)
    return back.withColumn("round_trip", F.col(into) == F.coalesce("text", F.lit(""))).drop(into)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("sentencepiece", tokens),
]
#: The rules' fit, the ranking and the piece lattice are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def _delete(spark: SparkSession, path: str) -> None:
    """A stage's documents, when the next stage's are written. Those of the last written stage stay for whoever reads the result."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Between stages the kept documents are written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = posixpath.join(shared_folder(spark), f"pipeline-{uuid.uuid4().hex}")
    last = None
    for name, stage in STAGES[:-1]:
        path = posixpath.join(folder, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            _delete(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
