"""The training-corpus pipeline: five stages over ``documents``, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import frames, jaccard, mixing, packing, quality, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good(docs.select(*COLUMNS), _labels(spark, sf_dir))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs.select(*COLUMNS), _labels(spark, sf_dir))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs.select(*COLUMNS))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.curriculum(docs.select(*COLUMNS)).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the mix. ``mix_file`` and ``mix_row`` say where a document stood in it: read by them, sequences are in training order, and its copies are told apart."""
    number = F.regexp_replace(F.col("_metadata.file_name"), r"^part-(\d+)-.*?(-c\d+)?\.[^-]*$", "$1$2")
    placed = docs.select("doc_id", "text", number.alias("mix_file"), F.col("_metadata.row_index").alias("mix_row"))
    return packing.packed(placed, keep=("mix_file", "mix_row"))


STAGES = [
    ("quality classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("n-gram Jaccard join", jaccard_stage),
    ("mixing sources", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: Learned scores and greedy packing have no SQL form; tests/llm holds the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage stored on its way is deleted once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = frames.tables_stored(spark)
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = frames.stored(stage(spark, docs, sf_dir), f"stage{k}")
        frames.drop_stored(spark, first, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
