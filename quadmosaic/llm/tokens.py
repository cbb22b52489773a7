"""Token ids in Parquet files that can be read in part.

Documents are range-partitioned by id, sorted, and encoded where their texts then are. Each file has one row for a document: its id, its place in its
shard, its number of ids, and the ids as a list. Ids have a dictionary (a vocabulary's ids take two bytes or less there); ascending
columns are delta-encoded. Row groups and pages are small enough, and pages have an index, that a reader of some documents or of the metadata alone leaves
the other pages where they are. A table of shards, one row for each, turns places into positions among all ids.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quadmosaic.lineage import removed, scratch
from quadmosaic.llm.common import settled, table

#: Added after the ids of each document.
END_ID = 1
#: Bytes of a row group and of a page, and rows of a page, that the writer aims at.
GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 64 << 20, 256 << 10, 2000
#: Pieces of text whose ids a task keeps, and their greatest length.
CACHE_PIECES, CACHED_LENGTH = 1 << 19, 40
#: Ids and documents that a task gathers before it sends them on.
BATCH_IDS, BATCH_DOCS = 1 << 17, 512

#: What a folded text of Latin characters (the first 256, without most controls) falls into before its parts are split further; a part's ids don't depend on what stands around it.
_PARTS = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^ \t\n\x0b\x0c\r\x85\xa0a-zªµºß-öø-ÿ0-9²³¹¼½¾]+").findall
_NOT_LATIN = re.compile(r"[^\t-\r -~\x85\xa0-\xff]").search
#: Characters at which any text may be cut.
_BLANKS = re.compile(r"[ \t\n\x0b\x0c\r]+")
#: Tells whether texts may be encoded in pieces.
_PROBE = "It's  Über-naïve\tcafé́ ̈x 12 a.b\n3,4 'll 're ... 你好 don't\r\nab ABC, (Word); \"Quoted\" end' x's'. re-Do 'S we'VE"
_LATIN_PROBE = "Été, l'ÎLE: «Größe» 3½×2÷1 ª\xa0naïve's ß µm¿Qué? x\xad\xadY d'IL LL'LL 'Re'"

SCHEMA = "doc_id long, shard int, place long, n_tokens long, ids array<int>"
#: What holds for each column of the files: ascending numbers are told by their differences, ids by a dictionary.
FILE_OPTIONS = {
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#ids.list.element": "true",
    "parquet.enable.dictionary#shard": "true",
    "parquet.block.size": str(GROUP_BYTES),
    "parquet.page.size": str(PAGE_BYTES),
    "parquet.page.row.count.limit": str(PAGE_ROWS),
    "parquet.page.write-checksum.enabled": "true",
    "compression": "lz4_raw",
}


def public_tokenizer(name: str) -> str:
    """The file of a public tokenizer, as its package finds it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_signs() -> list[str]:
    """The character that byte-level tokenizers write for each byte: its own if that can be seen, else one of those from 256 on, in order."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in seen else chr(next(rest)) for b in range(256)]


class _Kept(dict):
    """Ids by text as bytes, made when first asked for. Short texts stay while they are among the last ones that were asked for."""

    def __init__(self, make: Callable[[str], list[int]], most: int):
        self.make, self.half, self.before = make, most // 2, {}

    def __missing__(self, text: str) -> bytes:
        ids = self.before.get(text)
        if ids is None:
            ids = array("i", self.make(text)).tobytes()
        if len(text) <= CACHED_LENGTH:
            if len(self) >= self.half:
                self.before = dict(self)
                self.clear()
            self[text] = ids
        return ids


def encoder(tokenizer: str, cache_pieces: int = CACHE_PIECES) -> Callable[[str | None], np.ndarray]:
    """A function from a text to its ids by a tokenizer file of the tokenizers library, without special tokens added.

    Words and signs of Latin texts are encoded one by one, words by the library's model directly; other texts in pieces between blanks. Ids are kept for the next time. That gives the ids of the whole text only if the tokenizer lower-cases, drops blanks, never joins over one and parts
    letters from signs; one that doesn't is told by a probe and gets whole texts.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer)
    whole = lambda text: library.encode(text, add_special_tokens=False).ids
    model, special = library.model, [t.content for t in library.get_added_tokens_decoder().values()]
    signs = _byte_signs()

    def part(text: str) -> list[int]:
        """Of one part of a folded Latin text: letters go to the model, as the signs of their bytes."""
        return [t.id for t in model.tokenize(text if text.isascii() else "".join(map(signs.__getitem__, text.encode())))] if text.isalpha() else whole(text)

    parts, pieces = _Kept(part, cache_pieces), _Kept(whole, cache_pieces)

    def encode(text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        if any(s in text for s in special):
            return np.array(whole(text), np.int32)
        if not _NOT_LATIN(text):
            return np.frombuffer(b"".join(map(parts.__getitem__, _PARTS(text.lower()))), np.int32)
        out: list[bytes] = []
        for piece in _BLANKS.split(text):
            if _NOT_LATIN(piece):
                out.append(pieces[piece])
            else:
                out += map(parts.__getitem__, _PARTS(piece.lower()))
        return np.frombuffer(b"".join(out), np.int32)

    if encode(_PROBE).tolist() + encode(_LATIN_PROBE).tolist() != whole(_PROBE) + whole(_LATIN_PROBE):
        return lambda text: np.array(whole(text or ""), np.int32)
    return encode


def encoded(docs: DataFrame, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``doc_id, shard, place, n_tokens, ids`` of ``docs`` in ascending order of id; ``place`` counts the ids before it in its shard, which is a range of documents."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # rows of one id go by where they were read, so that very many of one id still make several shards
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", "row"]
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("shard", F.spark_partition_id())
    # a worker process has its copy of a broadcast value for all its tasks, and there the encoder with what it has kept
    kept = docs.sparkSession.sparkContext.broadcast({})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "encode" not in kept.value:
            kept.value["encode"] = encoder(tokenizer)
        encode, end = kept.value["encode"], np.array([end_id], np.int32)
        place = 0
        for batch in batches:
            doc_id, shard, texts = batch.columns
            start, arrays, sizes, held = 0, [], [], 0
            for i in range(len(texts)):
                own = encode(texts[i].as_py())
                arrays += own, end
                sizes.append(len(own) + 1)
                held += len(own) + 1
                if i + 1 == len(texts) or held >= BATCH_IDS or len(sizes) >= BATCH_DOCS:
                    n = np.array(sizes, np.int64)
                    ends = np.cumsum(n)
                    ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(np.concatenate(arrays)))
                    columns = [doc_id[start : i + 1], shard[start : i + 1], pa.array(place + ends - n), pa.array(n), ids]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "shard", "place", "n_tokens", "ids"])
                    place += held
                    start, arrays, sizes, held = i + 1, [], [], 0

    return placed.select("doc_id", "shard", "text").mapInArrow(run, SCHEMA)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of ``docs`` to ``<folder>/ids`` and the table of shards to ``<folder>/shards``.

    A null text is an empty one and has the end id alone. Null ids come first; rows of one id stay as they were read, repeated rows stand once each. Texts are
    encoded whole, however long. An empty table gives files without rows. Other columns are not read. A lost task is run again; files are
    committed together.
    """
    spark = docs.sparkSession
    encoded(docs, tokenizer, end_id, id_col, text_col).write.options(**FILE_OPTIONS).parquet(f"{folder}/ids")
    sums = spark.read.parquet(f"{folder}/ids").groupBy("shard").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    before = F.coalesce(F.sum("n_tokens").over(W.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row for each task of the write
    sums.withColumn("base", before).coalesce(1).write.parquet(f"{folder}/shards")


def read_tokens(spark: SparkSession, folder: str, ids: tuple[int, int] | None = None, columns: tuple[str, ...] = ("doc_id", "start", "n_tokens", "ids")) -> DataFrame:
    """The chosen columns of the files, of all documents or those with an id from ``ids[0]`` to ``ids[1]``; ``start`` counts all ids before a document's.

    Only the pages of these columns, and of these documents, are read.
    """
    rows = spark.read.parquet(f"{folder}/ids")
    if ids is not None:
        rows = rows.where(F.col("doc_id").between(*ids))
    if "start" in columns:
        rows = rows.join(F.broadcast(spark.read.parquet(f"{folder}/shards").select("shard", "base")), "shard").withColumn("start", F.col("base") + F.col("place"))
    return rows.select(*columns)


def digest(rows: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of rows as :func:`read_tokens` gives them; the crc32 is of the ids as little-endian 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            flat, offsets = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
            sums = [zlib.crc32(flat[a:z].tobytes()) for a, z in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, StructType.fromDDL("doc_id long, start long, n_tokens long, ids_crc32 long"))


def op12_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files are in the shared folder only until their digests are taken."""
    folder = scratch(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), folder, public_tokenizer("word_bpe_49k.json"))
    out = settled(digest(read_tokens(spark, folder)))
    removed(spark, folder)
    return out
