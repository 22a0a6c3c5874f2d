"""From raw documents to training batches, in stages that call the operators of ``notewise.llm``.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame.  :func:`run` writes each stage's rows as Parquet in the shared folder and
gives them, read again, to the next.  All stages but the last keep the columns of
``documents``.  Documents leave when their language is rejected, when they are exact
copies (the largest doc_id stays) or near copies (the smallest stays); mixing then
orders what is left, and packing returns one row per document with its batch, which
follows the mix inside each length bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from notewise.llm.common import put
from notewise.llm.exact_dedup import drop_copies
from notewise.llm.language_id import keep_identified
from notewise.llm.mixing import mixed_documents, places
from notewise.llm.ngram_join import keep_one
from notewise.llm.packing import pack
from notewise.session import ship_package


#: Target weights of the sources; None weighs them by their size, as mixing does by default.
WEIGHTS = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return mixed_documents(docs, weights=WEIGHTS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return pack(docs, order=places(docs, weights=WEIGHTS))


STAGES = [("language", language), ("exact", exact), ("near", near), ("mixing", mixing), ("packing", packing)]

#: Compression, like scheduling, is beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = put(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
