"""From raw documents to packed training sequences: quality, near duplicates, repeated passages, benchmark leaks, packing.

Each stage takes what the one before it wrote, and all but the last give the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import best_fit_packing, decontaminate, quality_resample, simhash_dedup, suffix_dedup
from foliant.llm.shared import written
from foliant.session import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
PASSAGE_BYTES = 200  # most passages of over 50 words are longer; 51 words of three letters are not
CAPACITY = 2048


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling keeps. Repeated rows, and rows that share an id and a text, stay or go together; null and empty texts have weight 0 and
    are sampled like any other; without labels all stay; an empty table stays empty."""
    ship(spark)
    docs = docs.select(*COLUMNS)
    kept = quality_resample.resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    return docs.join(kept, (F.xxhash64("text") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a five-word Jaccard similarity of 0.8 or more: the one with the smallest id, a null id last. Documents are told
    apart by id and text, so rows that share an id, or have none, go or stay by their texts; of equal rows one stays. Null, empty and blank texts are one group; an empty
    table stays empty."""
    ship(spark)
    return simhash_dedup.one_of_each(docs.select(*COLUMNS)).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that repeat; a document of which nothing is left goes. Null and empty texts stay as they are, rows that share an id are told
    apart by their texts, and repeated rows, which repeat one another, go if they are as long as a passage; an empty table stays empty."""
    ship(spark)
    found = suffix_dedup.covered(docs.select(*COLUMNS), PASSAGE_BYTES, carry=("lang", "source", F.col("text").isNull().alias("was_null")))
    kept = suffix_dedup.kept_texts(found).where(~F.col("cut") | (F.trim("kept") != ""))
    text = F.when(~F.col("carry.was_null"), F.col("kept"))
    return kept.select("doc_id", text.alias("text"), "carry.lang", "carry.source", F.length(text).cast("long").alias("n_chars"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark: rows that share an id, or have none, go or stay by their own texts, repeated rows together. Null and empty texts
    stay; without a benchmark all stay; an empty table stays empty."""
    ship(spark)
    return decontaminate.clean(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, packed into sequences. Null and empty texts are a piece of the end mark alone; rows that share an id, repeated ones too, are packed
    each; very long texts are cut; an empty table gives no pieces."""
    ship(spark)
    return best_fit_packing.pack(docs.select(*COLUMNS), CAPACITY)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("benchmark_leaks", benchmark_leaks), ("packing", packing)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
