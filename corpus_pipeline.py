"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

1. toxicity: documents that the string-kernel machine, trained on ``labels``, predicts toxic go.
2. line dedup: lines that many documents share stay in one of them.
3. near dedup: of documents whose SimHash fingerprints (shingles of five words, four bits) link, or whose shingle sets have a
   verified Jaccard similarity of 0.8, the one with the smallest doc_id stays.
4. decontamination: documents that hold a benchmark item go.
5. packing: what is left is packed into sequences of 1024 tokens; one row a piece.

Stages 1 to 4 return the columns of ``documents`` (n_chars follows the text). Nulls, empty texts, repeated rows, empty tables and
further columns are treated as each operator's docstring says: rows with a null doc_id are never dropped by stages 3 and 4.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cindermap.llm.common import staged, table
from cindermap.llm.decontaminate import drop_contaminated
from cindermap.llm.linedup import drop_repeated_lines
from cindermap.llm.neardup import drop_near_duplicates
from cindermap.llm.packing import pack_documents
from cindermap.llm.toxicity import drop_toxic

NEAR_SHINGLE, NEAR_BITS, SIMILARITY = 5, 4, 0.8


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = drop_repeated_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs, NEAR_SHINGLE, NEAR_BITS, SIMILARITY)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 2)


STAGES = [("toxicity", toxicity), ("line dedup", line_dedup), ("near dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]

#: The stages' models, alignments and searches are beyond SQL; tests/llm hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
