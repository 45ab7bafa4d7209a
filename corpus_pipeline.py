"""A training-corpus pipeline over the documents table.

``run`` applies the stages in order.  Each stage gets all rows that the one
before it kept, is written as Parquet to the folder the cluster shares for
checkpoints and is read again from there, so a lost executor costs its own
tasks only.  The stages leave every column of the documents in place (extra
ones too); the last returns token ids.  SQL cannot express the classifier, the
fingerprints or the tokenizer, so there is no oracle.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.llm import decontaminate, line_crf, pii, simhash, transducer
from ledgerflow.llm.queries import quality_field
from ledgerflow.llm.shared import fresh, table
from ledgerflow.session import ensure_checkpoint_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field scores as good (null and empty texts go).

    Without labels of both kinds nothing can be told, and all rows stay.
    """
    score = fresh(docs, "quality_score")
    field = quality_field(spark, docs, sf_dir)
    if not field.fitted:
        return docs
    return (docs.withColumn(score, line_crf.score_column(docs, "text", field))
            .filter(F.col(score) >= line_crf.THRESHOLD).drop(score))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: that of the smallest id.

    A row that shares its id with a row of another text is a document of its
    own; rows with a null id stay.
    """
    return simhash.keep_one(docs, "doc_id", "text")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    found = fresh(docs, "overlaps")
    items = table(spark, sf_dir, "benchmark", "item_id", "text")
    return (docs.withColumn(found, decontaminate.matches_column(docs, "text", items, "item_id", "text"))
            .filter(F.size(found) == 0).drop(found))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts masked by its kind."""
    out = docs.withColumn("text", pii.mask_column(docs, "text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether they decode to it again."""
    both = transducer.round_trip(docs, "text", ["doc_id"], with_text=False)
    return both.select("doc_id", "bpe.ids", F.size("bpe.ids").cast("bigint").alias("n_tokens"),
                       F.col("bpe.same").alias("decodes"))


STAGES = [("quality classifier", quality), ("SimHash near-dedup", near_duplicates),
          ("benchmark decontamination", decontamination), ("PII", personal_data),
          ("BPE encoding and decoding", token_ids)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages' result over the documents of ``sf_dir``."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/stage-{k}")
        docs = spark.read.parquet(f"{folder}/stage-{k}")
    return docs
