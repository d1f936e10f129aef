"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and all that its predecessor kept; run()
writes what a stage returns as Parquet to the shared folder and reads it back for the
next one.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratablock.llm.common import cut, made_so_far, read_table, release
from stratablock.llm.decontaminate import decontaminate
from stratablock.llm.line_dedup import line_dedup
from stratablock.llm.quality import THRESHOLD, scored, train
from stratablock.llm.simhash import near_duplicates
from stratablock.llm.unigram import unigram_codes

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Five-word shingles of which four in five are shared.
WORDS, SIMILARITY = 5, 0.8


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below THRESHOLD go.  The network learns from the labelled rows of the stage's own input."""
    model = train(docs, read_table(spark, sf_dir, "labels"))
    return scored(docs, model).filter(F.col("score") >= THRESHOLD).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines go out of the texts; every document stays."""
    return line_dedup(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the smallest id stays (of null ids and equal ids, the one with the least text hash)."""
    found = cut(near_duplicates(docs, WORDS, SIMILARITY).select("_id", "_text_hash", F.col("component_id").alias("_class")), "near-classes")
    # a class without any id is one of equal null-id texts: each text stands for itself
    alone = found.filter("_class is null").select("_id", "_text_hash")
    first = found.filter("_class is not null").groupBy("_class").agg(F.min(F.when(F.col("_id") == F.col("_class"), F.col("_text_hash"))).alias("_text_hash"))
    stays = first.select(F.col("_class").alias("_id"), "_text_hash").unionByName(alone).distinct()
    docs, text_hash = docs.select(*COLUMNS), F.xxhash64(F.coalesce("text", F.lit("")))
    kept = docs.join(cut(stays, "stays").hint("merge"), docs["doc_id"].eqNullSafe(F.col("_id")) & (text_hash == F.col("_text_hash")), "left_semi")
    return kept.select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item occurs go."""
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark")).filter(F.size("matches") == 0).select(*COLUMNS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and their number, digest and round trip."""
    import public_tokenizers

    return unigram_codes(docs, public_tokenizers.path("piece_bpe_32k.model"), ids=True)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("encoding", encoding_stage),
]

#: Learned scores, shingle similarity and alignment aren't for SQL; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows.  What a stage has cut, and its input, is deleted once its output is written."""
    docs, others = read_table(spark, sf_dir, "documents"), made_so_far(spark)
    for name, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        within = made_so_far(spark)
        docs = cut(made, f"stage-{name}")
        release(spark, others | (made_so_far(spark) - within))
    return docs
