"""Line dedup over hashes, as keep bitmaps.

Each line gives a row of its key's hash, document and position. Rows are range-partitioned by the hash (and by a salt of the document,
so that one very common line spreads over many tasks) and sorted by document and position inside each
partition; a window then streams over them to mark first occurrences and to count documents. No text is shuffled
for that: the result is one sparse bitmap for each document. :func:`apply_bitmaps` cuts the lines: bitmaps of a measured small size go to where the texts
are, larger ones meet the texts by a shuffle of both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadmosaic.llm.common import BLANKS, fold_ascii_col, fresh, settled, table

MIN_DOCS = 10
#: Lines, on average, of one key and salt if all lines had one key: how many salts there are follows from the number of lines.
SALT_ROWS, SALTS = 1 << 17, 32
#: Bytes of bitmaps that go to every task.
BROADCAST_BYTES = 64 << 20


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keep_bitmaps(docs: DataFrame, min_docs: int = MIN_DOCS, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``doc_id, text_hash, keep`` for the documents that lose lines; all others keep every line.

    A key is a line without the ASCII blanks at its ends and with A-Z lower-cased; lines with an empty key are always kept. A key in ``min_docs`` documents
    or more loses all its lines, or with ``keep_first`` all but the first (smallest document id, then position).
    ``keep`` is an array of structs: ``word``, the index of a group of 64 lines, and ``bits``, with bit i set if line ``64 * word + i`` stays; groups that
    stay whole are left out. Documents are told apart by id: rows that share an id, or have none, count as one
    document, and ``text_hash`` tells their texts apart. Null or empty text is one empty line. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    lines = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    key = fold_ascii_col(F.btrim("line", F.lit(BLANKS)))
    keyed = settled(
        lines.withColumn("key", key)
        .where("key <> ''")
        .select(F.xxhash64("key").alias("h1"), F.hash("key").alias("h2"), "doc_id", "text_hash", "pos")
    )
    salts = max(SALTS, -(-keyed.count() // SALT_ROWS))
    keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = ["h1", "h2", "salt"]
    ranged = keyed.repartitionByRange(parts, *by).sortWithinPartitions(*by, "doc_id", "text_hash", "pos")
    stream = W.partitionBy(*by).orderBy("doc_id", "text_hash", "pos")
    marked = ranged.withColumn("new_doc", (F.row_number().over(stream) == 1) | ~F.lag("doc_id").over(stream).eqNullSafe(F.col("doc_id")))
    # one row for each key and salt; a key has as many of these as there are salts at most, so their sums meet without a hot group
    local = marked.where("new_doc").groupBy(*by).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "text_hash", "pos")).alias("least"))
    whole = W.partitionBy("h1", "h2")
    frequent = local.select(*by, F.sum("n").over(whole).alias("n_docs"), F.min("least").over(whole).alias("first")).where(F.col("n_docs") >= min_docs)
    dropped = keyed.join(frequent, by)
    if keep_first:
        dropped = dropped.where(~F.struct("doc_id", "text_hash", "pos").eqNullSafe(F.col("first")))
    # one shuffle by document serves both steps: lines to groups of 64, groups to the document's bitmap
    gone = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pos") % 64)).alias("gone")
    groups = dropped.repartition("doc_id", "text_hash").groupBy("doc_id", "text_hash", F.floor(F.col("pos") / 64).cast("int").alias("word")).agg(gone)
    return groups.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("word", F.bitwise_not("gone").alias("bits")))).alias("keep"))


def _flags(keep: Column) -> Column:
    """A byte for each line up to the last group that loses one, "0" where it goes: lines look theirs up in constant time."""

    def group(x: Column, i: Column) -> Column:
        before = F.coalesce(F.get(keep, i - 1)["word"] + 1, F.lit(0))
        return F.concat(F.repeat(F.lit("1" * 64), x["word"] - before), F.reverse(F.lpad(F.bin(x["bits"]), 64, "0")))

    return F.array_join(F.transform(keep, group), "").cast("binary")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines`` and ``n_dropped``; columns of ``docs`` by these names are replaced, all others stay. A document of which no line stays has an empty text."""
    mark, part = fresh(docs, "bitmap"), fresh(docs, "kept_lines")
    marks = settled(bitmaps.select(F.struct("doc_id", "text_hash", "keep").alias(mark)))
    # a bitmap takes an id, a hash and 16 bytes for each of its groups of 64 lines
    size = marks.agg(F.sum(64 + 32 * F.size(F.col(mark)["keep"]))).first()[0] or 0
    own = F.col(mark)
    same = F.col(id_col).cast("long").eqNullSafe(own["doc_id"]) & (F.xxhash64(text_col) == own["text_hash"])
    joined = docs.drop("kept_text", "n_lines", "n_dropped").join(F.broadcast(marks) if size <= BROADCAST_BYTES else marks.hint("shuffle_hash"), same, "left")
    flags, lines = fresh(docs, "flags"), _lines(F.col(text_col))
    gone = F.lit("0").cast("binary")
    joined = joined.withColumn(flags, F.when(own.isNotNull(), _flags(own["keep"])))
    kept = F.when(F.col(flags).isNull(), lines).otherwise(F.filter(lines, lambda x, i: F.substring(F.col(flags), i + 1, F.lit(1)) != gone))
    return joined.withColumn(part, kept).withColumns(
        {"n_lines": F.size(lines).cast("long"), "n_dropped": (F.size(lines) - F.size(part)).cast("long"), "kept_text": F.array_join(part, "\n")}
    ).drop(part, mark, flags)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = apply_bitmaps(docs, keep_bitmaps(docs))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP6_SQL = r"""
with d as (
  select row_number() over () rid, doc_id, string_split(coalesce(text, ''), chr(10)) ls from documents
), l as (
  select rid, doc_id, unnest(ls) line, unnest(generate_series(1, len(ls))) pos from d
), k as (
  select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') key from l
), f as (
  select key from k where key <> '' group by key having count(distinct coalesce(doc_id::varchar, '')) >= 10
), m as (
  select k.*, f.key is not null as gone from k left join f using (key)
)
select doc_id, count(*)::bigint n_lines, count(*) filter (gone)::bigint n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) kept_sha256
from m group by rid, doc_id
"""
