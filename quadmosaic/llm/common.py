"""What the text operators share: reading tables, cutting lineage, splitting words."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from quadmosaic.lineage import settled  # noqa: F401  the operators take it from here

#: Bytes that separate words in the operators that split at blanks.
BLANKS = " \t\n\x0b\x0c\r"
#: A word of letters and digits; any character above ASCII belongs to it. Upper case is still in.
WORD_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(_UPPER, _LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def per_text(docs: DataFrame, make: Callable[[], Callable[[list], list]], out: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows ``doc_id``, the columns of ``keep`` and those of ``out`` (a DDL string), one for each row of ``docs``.

    ``make`` is called once for each task and gives a function from a batch's texts to one list for each column. What is kept passes by untouched.
    """
    kept = [(c, docs.schema[c].dataType) for c in keep if c != "doc_id"]
    rows = docs.select(F.col(text_col).alias("__text"), F.col(id_col).cast("long").alias("doc_id"), *(F.col(c) for c, _ in kept))
    schema = StructType([StructField("doc_id", LongType()), *(StructField(c, kind) for c, kind in kept), *StructType.fromDDL(out).fields])
    fields = to_arrow_schema(schema)
    made = list(fields)[1 + len(kept) :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for batch in batches:
            columns = apply(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(c, f.type) for c, f in zip(columns, made))], names=fields.names)

    return rows.mapInArrow(run, schema)


def fold_ascii(text: str) -> str:
    """Lower-cases A-Z and nothing else."""
    return text.lower() if text.isascii() else text.translate(_FOLD)


def fold_ascii_col(col: Column) -> Column:
    """:func:`fold_ascii` as a column; pure ASCII values take the faster built-in."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, _UPPER, _LOWER))


def words_of(text: str | None) -> list[str]:
    """Folded words of letters, digits and non-ASCII characters."""
    return WORD.findall(fold_ascii(text)) if text else []


def fold_of(doc_id, parts: int):
    """crc32 of the id's text modulo ``parts``: the fold that held-out rows are told by."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def in_fold(doc_id: Column, parts: int, part: int) -> Column:
    """Whether an id is in a fold; a null id is in none."""
    return F.coalesce(fold_of(doc_id, parts) == part, F.lit(False))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with lines before it until no column of ``df`` has it."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def sample_ids(rows: DataFrame, label: str | None, most: int) -> DataFrame:
    """Distinct ``doc_id, <label>``: for each value of the label at most ``most`` ids, by the smallest hash of the id. Without a label, all ids are one class.

    Ids are first thinned to about 1.3 times the bound, so the top-k merges a bounded number of rows for a value at any size.
    """
    order, parts = F.xxhash64("doc_id", F.lit(17)), 1 << 20
    if label is None:
        ids = rows.where("doc_id is not null").select("doc_id").distinct()
        below = int(min(1.0, 1.3 * most / max(ids.count(), 1)) * parts) + 1
        return ids.where(F.pmod(order, F.lit(parts)) < below).orderBy(order, "doc_id").limit(most)
    rows = rows.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", label).distinct()
    rate = F.least(F.lit(1.0), F.lit(1.3 * most) / F.count("*"))
    rates = settled(rows.groupBy(label).agg((F.floor(rate * parts) + 1).alias("__below")))
    side = F.broadcast(rates) if rates.count() <= 10_000 else rates
    thinned = rows.join(side, label).where(F.pmod(order, F.lit(parts)) < F.col("__below"))
    rank = F.row_number().over(W.partitionBy(label).orderBy(order, "doc_id"))
    return thinned.withColumn("__rank", rank).where(F.col("__rank") <= most).select("doc_id", label)


def sample_texts(docs: DataFrame, chosen: DataFrame, most_bytes: int) -> DataFrame:
    """Rows ``doc_id, text`` and the columns of ``chosen`` for the chosen ids (a bounded number): one row for each id, the least text of it, and no more than ``most_bytes`` of text in all.

    Texts are taken by the hash of their id while they fit; only their sizes are looked at together, the texts stay where they are.
    """
    label = [c for c in chosen.columns if c != "doc_id"]
    texts = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")
    one = settled(texts.groupBy("doc_id", *label).agg(F.min("text").alias("text")))
    order = W.partitionBy(F.lit(0)).orderBy(F.xxhash64("doc_id", F.lit(18)), "doc_id").rowsBetween(W.unboundedPreceding, 0)
    fits = one.select("doc_id", F.octet_length("text").alias("size")).withColumn("total", F.sum("size").over(order)).where(F.col("total") <= most_bytes)
    return one.join(F.broadcast(fits.select("doc_id")), "doc_id", "left_semi")
