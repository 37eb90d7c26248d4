"""The training-data pipeline: filter, de-duplicate, decontaminate and mix the table of documents.

Every stage reads all that the one before kept. Columns of ``documents`` pass through whatever else the table holds; a row without a
key is a document of its own; empty tables pass through every stage. ``n_chars`` follows the text when a stage shortens it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from arealens.llm import decontam, minhash, mixing, quality, suffix
from arealens.llm.staging import shielded, stage_table
from arealens.session import ensure_shared_folder, ship_package


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier, fitted on ``labels``, does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").withColumnsRenamed({"doc_id": "_key"})

    def stage(rows, name):
        model = quality.train(
            rows, labels.withColumnRenamed("_key", name("doc_id")), key=name("doc_id"), text=name("text"), lang=name("lang"), source=name("source")
        )
        scored = quality.score(rows, model, key=name("doc_id"), text=name("text"), lang=name("lang"), source=name("source"))
        return scored.filter("keep")

    return shielded(stage)(docs)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least key, and of repeated rows one."""
    return shielded(lambda rows, name: minhash.one_of_each(rows, name("doc_id"), name("text")))(docs)


def without_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of ``suffix.PASSAGE`` bytes that occur again, cut at whole characters. Every document stays; NULL stays NULL.

    The length is set so that passages of over 50 words are found, which can be shorter than the operator's own 400 bytes.
    """

    def stage(rows, name):
        text, chars = name("text"), name("n_chars")
        kept = [c for c in rows.columns if c not in (name("doc_id"), text)]
        rows = rows.withColumn("_null", F.col(text).isNull())
        cut = suffix.remove_repeats(rows, suffix.PASSAGE, key=name("doc_id"), text=text, whole_characters=True, keep=(*kept, "_null"))
        cut = cut.withColumn(text, F.when(~F.col("_null"), F.decode("kept", "UTF-8")))
        return cut.withColumn(chars, F.when(F.col("n_removed") > 0, F.length(text)).otherwise(F.col(chars)).cast(rows.schema[chars].dataType))

    return shielded(stage)(docs)


def without_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``, neither word for word nor with other numbers and names."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return shielded(lambda rows, name: decontam.drop_contaminated(rows, benchmark, name("doc_id"), name("text")))(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at equal weight: every document as often as its Poisson draw says, in a global shuffle order."""
    return mixing.poisson_mix(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("near duplicates", one_of_near_duplicates),
    ("repeated strings", without_repeated_strings),
    ("benchmark decontamination", without_benchmark_leaks),
    ("mixing", mixed),
]

#: The classifier and the byte strings have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written as Parquet and read again by the next."""
    ship_package(ensure_shared_folder(spark))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
