"""Spelling variants of a corpus's words by full neighbourhood generation.

Of each word of the vocabulary all deletions, replacements and insertions over the observed alphabet are made, each once, and looked up
in the vocabulary: what is found is one edit away, so no distance is ever computed. They are made as rolling hashes, an edit's from those of the word's
two ends; a bitmap of the vocabulary's hashes drops those that are in it for certain not, and the rest are spelled out and joined to the vocabulary
by equality. A word then follows its most frequent neighbour where that is frequent enough; chains of such steps end in a root.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadmosaic.llm.common import fold_ascii_col, settled, table

#: A maximal run of these, once A-Z are lower-cased, is what a word is made from. There are 90 such characters, so the alphabet is bounded.
RUN = r"[a-zÀ-ÿ]+"
MIN_LENGTH, MIN_TIMES = 5, 3
#: One in so many runs of a document loses a character.
NOISE = 97
#: A word takes a near word's form if that is so many times as frequent.
RATIO = 2
#: Bits of the bitmap: so many for each word, within these powers of two. Beyond the last one it lets more pass, which the join then drops.
WORD_BITS, LEAST_POWER, MOST_POWER = 32, 15, 28
#: Bytes of links between words that go to every task; beyond that both sides of the join are shuffled.
BROADCAST_BYTES = 16 << 20
#: Hashes that a task makes at once.
AT_ONCE = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Odd multipliers whose high bits are a hash's places in the bitmap.
_PROBES = tuple(np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
_PAGE = 1 << 15  # bits of a value of Spark's bitmap functions


def noisy_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int = NOISE, min_length: int = MIN_LENGTH) -> DataFrame:
    """Rows ``word``, one for each occurrence of a run that has ``min_length`` code points or more after one of its code points was lost, where the crc32 of ``<doc_id>:<run>`` says so."""
    runs = F.regexp_extract_all(fold_ascii_col(F.col(text_col)), F.lit(RUN), F.lit(0))
    each = docs.select(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":")).alias("id"), F.explode(runs).alias("run")).where(F.char_length("run") >= min_length)
    hashed = each.withColumn("h", F.crc32(F.concat("id", "run").cast("binary")))
    at = F.pmod("h", F.char_length("run")).cast("int")
    word = F.when(F.col("h") % noise == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).where(F.char_length("word") >= min_length)


def _by_length(words: list[str]) -> Iterator[tuple[list[str], np.ndarray]]:
    """Words of equal length, and their code points as rows; no more at once than :data:`AT_ONCE` code points, or one word."""
    groups: dict[int, list[str]] = {}
    for w in words:
        groups.setdefault(len(w), []).append(w)
    for length, own in groups.items():
        step = max(1, AT_ONCE // max(length, 1))
        for i in range(0, len(own), step):
            part = own[i : i + step]
            yield part, np.frombuffer("".join(part).encode("utf-32-le"), "<u4").reshape(len(part), length)


def _powers(n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, _BASE, np.uint64))])


def _ends(codes: np.ndarray, powers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place, the hash of what is before it, and what all from it on adds to the word's hash."""
    n, length = codes.shape
    head, tail = np.zeros((n, length + 1), np.uint64), np.zeros((n, length + 1), np.uint64)
    own = codes.astype(np.uint64)
    for i in range(length):
        head[:, i + 1] = head[:, i] * _BASE + own[:, i]
    tail[:, :length] = np.cumsum((own * powers[length - 1 :: -1][:length])[:, ::-1], axis=1)[:, ::-1]
    return head, tail


def _places(hashes: np.ndarray, length: int, power: int) -> list[np.ndarray]:
    """The bits of strings of ``length`` by their hashes, one for each probe."""
    with np.errstate(over="ignore"):
        mixed = hashes + np.uint64(length) * _PROBES[0]
        mixed ^= mixed >> np.uint64(29)
        return [(mixed * m) >> np.uint64(64 - power) for m in _PROBES]


def bitmap(words: DataFrame, power: int) -> np.ndarray:
    """A bit array of 2 ** ``power`` with the bits of all ``words``; it is put together by Spark, and its size doesn't depend on how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, codes in _by_length(batch.column(0).to_pylist()):
                length = codes.shape[1]
                head, _ = _ends(codes, _powers(length))
                bits = np.unique(np.concatenate(_places(head[:, length], length, power)).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(bits)], names=["bit"])

    bits = words.select("word").mapInArrow(run, "bit long")
    pages = bits.groupBy((F.col("bit") / _PAGE).cast("long").alias("page")).agg(F.bitmap_construct_agg((F.col("bit") % _PAGE)).alias("bits"))
    out = np.zeros(max(1, (1 << power) // _PAGE) * (_PAGE // 8), np.uint8)
    for r in pages.toLocalIterator():
        out[r.page * (_PAGE // 8) : (r.page + 1) * (_PAGE // 8)] = np.frombuffer(r.bits, np.uint8)
    return out


def _edits(codes: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """All strings one edit away, each once, as (length, hashes, rows of ``codes``, edits). An edit is 2 i + 1 for what goes in at i, 2 i for what takes the place
    of the i-th, times the alphabet and one, plus the letter's number, the last one for none.

    A string that several edits give is made by one of them: a character of a run of equal ones is deleted at the run's start and inserted at its end.
    """
    n, length = codes.shape
    powers = _powers(length + 1)
    head, tail = _ends(codes, powers)
    letters, size = alphabet.astype(np.uint64), np.int64(len(alphabet) + 1)
    step = max(1, AT_ONCE // (n * len(alphabet)))
    numbers = np.arange(len(alphabet), dtype=np.int64)
    none = np.zeros((n, 1), codes.dtype)
    preceding = np.concatenate([none, codes], axis=1)
    for a in range(0, length + 1, step):
        at = np.arange(a, min(a + step, length + 1))
        left, right = head[:, at], tail[:, at]
        # insertions: not of the letter that stands before
        whole = (left * powers[length + 1 - at] + right)[:, :, None] + letters * powers[length - at][:, None]
        ok = preceding[:, at][:, :, None] != alphabet
        edits = np.broadcast_to(((2 * at + 1) * size)[:, None] + numbers, whole.shape)
        yield length + 1, whole[ok], np.nonzero(ok)[0], edits[ok]
        at = at[at < length]
        if len(at):
            left, right, own = head[:, at], tail[:, at + 1], codes[:, at]
            whole = (left * powers[length - at] + right)[:, :, None] + letters * powers[length - 1 - at][:, None]
            ok = own[:, :, None] != alphabet
            edits = np.broadcast_to((2 * at * size)[:, None] + numbers, whole.shape)
            yield length, whole[ok], np.nonzero(ok)[0], edits[ok]
            ok = own != preceding[:, at]
            whole = left * powers[length - 1 - at] + right
            edits = np.broadcast_to(2 * at * size + size - 1, whole.shape)
            yield length - 1, whole[ok], np.nonzero(ok)[0], edits[ok]


def neighbours(words: list[str], alphabet: list[str], bits: np.ndarray | None = None, power: int = 0) -> Iterator[tuple[list[str], list[str]]]:
    """Batches of words and the strings one edit away that the bitmap ``bits`` may hold; all of them without one."""
    letters = np.array([ord(c) for c in alphabet], np.uint32)
    none = len(letters)
    # one number more stands for no letter
    spelled = np.append(letters, np.uint32(0))
    for part, codes in _by_length(words):
        step = max(1, AT_ONCE // max(1, none * (codes.shape[1] + 1)))
        for a in range(0, len(part), step):
            own = codes[a : a + step]
            padded = np.concatenate([own, np.zeros((len(own), 1), own.dtype)], axis=1)
            for length, hashes, row, edit in _edits(own, letters) if none else ():
                if bits is not None:
                    for p in range(len(_PROBES)):
                        place = _places(hashes, length, power)[p]
                        ok = bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1 > 0
                        hashes, row, edit = hashes[ok], row[ok], edit[ok]
                kind, letter = np.divmod(edit, none + 1)
                at, inserted = kind >> 1, kind & 1
                columns = np.arange(length)
                source = columns - (columns > at[:, None]) * inserted[:, None] + (columns >= at[:, None]) * (letter == none)[:, None]
                out = padded[row[:, None], source]
                put = np.flatnonzero(letter < none)
                out[put, at[put]] = spelled[letter[put]]
                text = out.astype("<u4").tobytes().decode("utf-32-le")
                if len(row):
                    yield [part[a + r] for r in row], [text[k * length : (k + 1) * length] for k in range(len(row))]


def candidates(words: DataFrame, alphabet: list[str], power: int) -> DataFrame:
    """Rows ``word, near`` for the distinct strings one edit away from each of ``words`` (distinct) whose hash is that of a word."""
    shared = words.sparkSession.sparkContext.broadcast(bitmap(words, power))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for word, near in neighbours(batch.column(0).to_pylist(), alphabet, shared.value, power):
                yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(near, pa.string())], names=["word", "near"])

    return words.select("word").mapInArrow(run, "word string, near string")


def _roots(links: DataFrame) -> DataFrame:
    """Rows ``word, root``: where following ``links`` (``word, form``) ends. Each round doubles the steps taken, and a step at least doubles the count, so a handful of rounds is enough."""
    size = links.agg(F.sum(F.octet_length("word") + F.octet_length("form") + 24)).first()[0] or 0
    reached = links.select("word", F.col("form").alias("root"))
    while True:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = settled(reached.join(F.broadcast(further) if size <= BROADCAST_BYTES else further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        reached = step.select("word", "root")
        if step.where("moved").isEmpty():
            return reached


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Rows ``word, form, root, n, n_near, form_n`` of a vocabulary ``word, n`` (distinct words).

    ``form`` is the near word (one code point inserted, deleted or replaced) of the largest ``n``, the smallest in code-point order among equals, if
    that is at least ``ratio`` times the word's own; ``root`` is where forms lead, the word itself if it has none. A word of few letters,
    an empty one too, is treated like any other; an empty vocabulary gives no rows.
    """
    if ratio < 2:
        raise ValueError("a form must be at least twice as frequent, else forms may go in circles")
    words = settled(words.select("word", F.col("n").cast("long").alias("n")))
    alphabet = sorted(r[0] for r in words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct().collect())
    power = min(max((max(words.count(), 1) * WORD_BITS - 1).bit_length(), LEAST_POWER), MOST_POWER)
    known = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    found = candidates(words, alphabet, power).join(known, "near")
    best = found.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("rank"), F.col("near"))).alias("best"))
    taken = -F.col("best.rank") >= ratio * F.col("n")
    formed = settled(
        words.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("best.near")).alias("form"), F.when(taken, -F.col("best.rank")).alias("form_n")
        )
    )
    roots = _roots(formed.where("form is not null").select("word", "form"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, min_times: int = MIN_TIMES, noise: int = NOISE, ratio: int = RATIO, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`variants` of the words that stand ``min_times`` times or more in ``docs``.

    A null text has no words; a null id is an empty one where runs are hashed. Repeated rows count each time; a very long text is read whole and a
    very long word is a word like any other (its neighbourhood has as many strings as it has letters, times the alphabet). An empty table gives no
    rows. Other columns are not read.
    """
    words = noisy_words(docs, id_col, text_col, noise).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_times)
    return variants(words, ratio)


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))
