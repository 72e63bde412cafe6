"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept, and is written
as Parquet and read again before the next. All stages but the last return the columns of
their documents, whatever else these are called; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lensaudit.llm import common, decontaminate, jaccard_join, line_dedup, packing, quality, queries

TOKENIZER = "byte_bpe_50k.json"
#: Units an encoder keeps: fewer than it would alone, as workers of the other stages are still there.
CACHE_UNITS = 300_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the quality classifier scores below 1/2. Null and empty texts have
    the score of such texts; rows of one text stay or go together."""
    return quality.keep_good(docs, _table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later repeated runs of lines. Documents of which nothing is left go; n_chars
    is counted again where a text changed. Null and empty texts stay as they are; rows that
    agree in doc_id and text are one document; a null doc_id comes first."""
    rows = line_dedup.dedup_lines(docs)
    left = F.col("text").rlike(r"\S")
    rows = rows.where((F.col("removed_lines") == 0) | left)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("removed_lines") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.select(docs.columns)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of near duplicates: that of the smallest doc_id, a null
    one last, then of the smallest hash of the text; of rows that agree in both, one. Rows
    without words all stay."""
    return jaccard_join.keep_one(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth or more lies in windows of the benchmark, and cuts
    runs of at least a whole window (13 words) out of the others; n_chars is counted again where
    a text changed. Null and empty texts stay; repeated rows are treated alike."""
    (was,) = common.fresh(docs, "_was")
    rows = docs.withColumn(was, F.length("text"))
    rows = decontaminate.decontaminate(rows, _table(spark, sf_dir, "benchmark"), span=decontaminate.WINDOW)
    if "n_chars" in docs.columns:
        left = F.length("text")
        rows = rows.withColumn("n_chars", F.when(left < F.col(was), left.cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences, one row for each: its ids, and the doc_ids and
    bounds of its pieces. Null and empty texts are their end token; repeated rows are packed each."""
    return packing.sequences(docs, queries.tokenizer_path(TOKENIZER), cache_units=CACHE_UNITS)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("jaccard_join", jaccard_stage),
    ("decontaminate", decontaminate_stage),
    ("packing", packing_stage),
]

#: No SQL: trees, winnowing and packing cannot be said in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    work = common.work_dir(spark, "pipeline")
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stage(stage(spark, docs, sf_dir), f"{work}/{name}")
    return docs
