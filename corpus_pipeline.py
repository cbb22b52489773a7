"""A corpus pipeline: quality classifier, line dedup, near-duplicate removal, benchmark decontamination, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; what one returns is written and is the next one's ``docs``.
For all of them: a null text is one without words; rows with a null id are kept or judged like any other and never told apart by it; repeated rows are
judged alike; very long texts are read whole; columns besides those of documents are dropped; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadmosaic.lineage import removed, scratch
from quadmosaic.llm.common import settled, table
from quadmosaic.llm.decontam import with_contamination
from quadmosaic.llm.line_dedup import apply_bitmaps, keep_bitmaps
from quadmosaic.llm.packing import best_fit
from quadmosaic.llm.quality_pu import classify, trained
from quadmosaic.llm.simhash import near_duplicates

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the positive-unlabelled classifier accepts, at a score of 0.5 or more."""
    return classify(docs, trained(spark, docs, sf_dir), keep=COLUMNS).where("score >= 0.5").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a line that stands in ten documents or more keeps the first place; ``n_chars`` follows the text. Documents left without a word go: each of their lines stays elsewhere."""
    kept = apply_bitmaps(docs, keep_bitmaps(docs, keep_first=True))
    changed = F.col("n_dropped") > 0
    text = F.when(changed, F.col("kept_text")).otherwise(F.col("text"))
    rows = kept.withColumns({"text": text, "n_chars": F.when(changed, F.char_length(text).cast("long")).otherwise(F.col("n_chars"))})
    return rows.where(~(changed & ~F.col("text").rlike("[^ \\t\\n\\x0b\\f\\r]"))).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, the one with the smallest id, and one row of each document. Rows without an id stay.

    A document is an id and a text: where texts differ under one id each is judged by itself, and of those in one group the one of the smallest hash stays.
    """
    own = ["doc_id", "text_hash"]
    groups = settled(near_duplicates(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), keep=("text_hash",))).where("doc_id is not null")
    first = groups.groupBy("component_fp").agg(F.min(F.struct(*own)).alias("first")).select("first.*")
    gone = groups.select(*own).distinct().join(first, own, "left_anti").withColumnsRenamed({"doc_id": "gone_id", "text_hash": "gone_hash"})
    kept = docs.join(gone, (F.col("doc_id") == F.col("gone_id")) & (F.xxhash64("text") == F.col("gone_hash")), "left_anti").select(*COLUMNS)
    if groups.groupBy(*own).count().where("count > 1").isEmpty():
        return kept
    return kept.where("doc_id is not null").dropDuplicates(["doc_id", "text"]).unionByName(kept.where("doc_id is null"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents with a passage of the benchmark."""
    return with_contamination(docs, table(spark, sf_dir, "benchmark")).where("n_hit = 0").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deals what is left into bins."""
    return best_fit(docs)


STAGES = [("quality", quality), ("lines", lines), ("near", near), ("benchmark", benchmark), ("packing", packing)]
#: The first stage is a trained classifier, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder and read again. A stage's files go once the next one's are written."""
    folder = scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
        if i:
            removed(spark, f"{folder}/{i - 1}-{STAGES[i - 1][0]}")
    return docs
