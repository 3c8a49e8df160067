"""From raw documents to packed sequences: the stages in order, each written and read again before the next.

Documents with null text or without a letter, empty ones among them, have no language and go in the first stage. Line dedup takes lines out and leaves the documents, even
those that end up empty. Repeated rows, equal texts and near copies are one document after the third stage, that of the smallest id, null ids last. Very long texts are
read whole. Columns of the documents may have any names. Empty tables give no pieces; an empty benchmark removes nothing.

On a cluster ``spark.checkpoint.dir`` must name the shared folder. A stage's own tables are deleted once its rows are written, and these once the next stage's are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wellspring.llm import decontamination, language_id, line_dedup, packing, simhash
from wellspring.llm._common import table
from wellspring.llm.queries import TOKENIZER
from wellspring.scratch import forget, remove, shared_folder, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models reject go; the others stay as they are."""
    return language_id.keep_identified(docs, language_id.fit(docs))


def remove_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found on many sites are taken out of the texts; ``n_chars`` follows the text."""
    out = line_dedup.remove_boilerplate(docs)
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component over SimHash links and over similarities of 0.8 on five words, the document with the smallest id stays, one of them if that id occurs on several rows."""
    return simhash.keep_one(docs, similarity=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by benchmark passages go."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts' pieces with their places in the packed sequences."""
    return packing.pack(docs, TOKENIZER)


STAGES = [("language_id", identify_language), ("line_dedup", remove_lines), ("simhash_near_dedup", one_of_near_duplicates), ("benchmark_decontamination", decontaminate), ("packing", pack)]

#: SQL cannot express the trained and iterative stages; ``tests/llm/test_pipeline.py`` holds them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's rows kept as Parquet in the shared checkpoint folder."""
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, last = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        mark, path = written(spark), f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        forget(spark, mark)
        if last is not None:
            remove(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs
