"""Corpus pipeline: five stages over ``documents``, each by one operator.

1. quality_rules: documents that a rule rejects go (operator 8);
2. near_dedup: one document of each near-duplicate group stays, similarity 0.8
   on five-word shingles (operator 10);
3. decontamination: documents that hold a window of ``benchmark`` go (4);
4. secret_scan: reported spans are replaced by a mask (2);
5. packing: the token sequences (3), one row per piece.

``STAGES`` are (name, function(spark, docs, sf_dir)); each result is written as
Parquet and read again as the next one's documents.  All but the last return
the columns of documents.  SQL can't express the last one (a tokenizer), so
ORACLE_SQL is None and the tests compare with plain Python.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from paysift.llm.common import prepare, save, table
from paysift.llm.decontaminate import drop_contaminated
from paysift.llm.near_dedup import drop_near_duplicates
from paysift.llm.packing import pack
from paysift.llm.quality_rules import keep_good
from paysift.llm.secrets import redact

ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontamination", decontamination),
          ("secret_scan", secret_scan), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
