"""Language identification, words first, with backoff to character n-grams.

A word that the model knows adds its log frequency in each language; a word that no language has falls back to
its character n-grams, the longest length of which any is known. The mean over the words decides.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadmosaic.llm.common import in_fold, per_text, sample_ids, table

#: The bound of training: documents of one language. A word or n-gram counts if it was seen in training so often, in all languages together.
TRAIN_DOCS, MIN_TIMES, MAX_GRAM = 2000, 2, 5
#: Log10 frequency of what a language doesn't have while another does.
PENALTY = -7.0
#: Words whose scores a task keeps at once, and the bytes that they may take: of very many languages a task keeps fewer words.
CACHE_WORDS, CACHE_BYTES = 1 << 18, 64 << 20
#: Languages up to which scores are a table of all of them, which then is no larger than the texts of the n-grams.
TABLE_LANGS = 16
#: N-grams of one word that are looked at together.
GRAM_BLOCK = 1 << 12

#: Runs of letters, and of numbers that aren't digits, which are cut out.
_RUNS = re.compile(r"[^\W\d_]+")
#: Marks (vowel signs, accents of their own) belong to the letter before them.
_MARK, _MARKED_RUNS = regex.compile(r"\p{M}"), regex.compile(r"\p{L}[\p{L}\p{M}]*")


def words_in(text: str) -> list[str]:
    """The words of a text: runs of Unicode letters with their marks, lower-cased and composed."""
    text = text.lower()
    if not text.isascii() and _MARK.search(text):
        return _MARKED_RUNS.findall(unicodedata.normalize("NFC", text))
    out = []
    for run in _RUNS.findall(text):
        if run.isalpha():
            out.append(run)
        else:
            out += "".join(c if c.isalpha() else " " for c in run).split()
    return out


def grams(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)] if n > 1 else list(word)


def count_grams(rows: DataFrame, max_gram: int = MAX_GRAM, most: int = 1 << 18) -> DataFrame:
    """Rows ``lang, n, gram, times``; n is 0 for words. Each task adds up what it sees and sends it on when it has ``most`` different ones, and at its end."""
    kinds = (pa.string(), pa.int32(), pa.string(), pa.int64())

    def sent(seen: Counter) -> pa.RecordBatch:
        columns = list(zip(*((*k, v) for k, v in seen.items()))) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["lang", "n", "gram", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[tuple[str, int, str]] = Counter()
        for batch in batches:
            words: Counter[tuple[str, str]] = Counter()
            for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                words.update((lang, w) for w in words_in(text))
            for (lang, w), times in words.items():
                seen[lang, 0, w] += times
                for n in range(1, max_gram + 1):
                    for g in grams(w, n):
                        seen[lang, n, g] += times
            if len(seen) >= most:
                yield sent(seen)
                seen.clear()
        yield sent(seen)

    return rows.select("lang", "text").mapInArrow(run, "lang string, n int, gram string, times long").groupBy("lang", "n", "gram").agg(F.sum("times").alias("times"))


MODEL_COLUMNS = ("lang", "n", "gram", "times")


class Model:
    """Scores of words in each language, from ``lang, n, gram, times``: tuples, or a table of Arrow, whose texts become Python's once for each gram.

    Beyond ``TABLE_LANGS`` languages only those that have a word or n-gram are kept with it, so the model is as large as its rows, however many languages there are.
    """

    def __init__(self, rows: list[tuple[str, int, str, int]] | pa.Table, max_gram: int = MAX_GRAM):
        if not isinstance(rows, pa.Table):
            columns = zip(MODEL_COLUMNS, (pa.string(), pa.int32(), pa.string(), pa.int64()), zip(*rows) if rows else [()] * 4)
            rows = pa.table({name: pa.array(values, kind) for name, kind, values in columns})
        lang = rows["lang"].combine_chunks().dictionary_encode()
        names, code = lang.dictionary.to_pylist(), lang.indices.to_numpy()
        n, times = rows["n"].to_numpy(), rows["times"].to_numpy()
        totals = np.zeros((len(names), max_gram + 1))
        np.add.at(totals, (code, n), times)
        order = sorted(range(len(names)), key=lambda i: (-totals[i, 0], names[i]))  # ties go to the language with more text
        self.langs, self.max_gram = [names[i] for i in order], max_gram
        column = np.empty(len(names), np.int64)
        column[order] = np.arange(len(names))
        self.tables: list[dict[str, int]] = []  # for each length, a gram's number
        self.rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # for each length: where a gram's languages start, the languages, and its scores in them
        self.full: list[np.ndarray] = []  # for each length the scores in all languages, where these are few
        small = np.min_scalar_type(max(len(names), 1))
        for k in range(max_gram + 1):
            own = np.flatnonzero(n == k)
            gram = rows["gram"].take(pa.array(own)).combine_chunks().dictionary_encode()
            self.tables.append({g: i for i, g in enumerate(gram.dictionary.to_pylist())})
            number = gram.indices.to_numpy()
            starts = np.concatenate([[0], np.cumsum(np.bincount(number, minlength=len(gram.dictionary)))])
            own = own[np.argsort(number, kind="stable")]
            self.rows.append((starts, column[code[own]].astype(small), np.log10(times[own] / totals[code[own], k]).astype(np.float32)))
        if len(names) <= TABLE_LANGS:
            self.full = [self._dense(k, range(len(table))) for k, table in enumerate(self.tables)]
            self.rows = []

    @property
    def nbytes(self) -> int:
        """The bytes of the scores, without the texts of words and n-grams."""
        return sum(a.nbytes for arrays in (*self.rows, self.full) for a in arrays)

    def _dense(self, n: int, numbers: Sequence[int]) -> np.ndarray:
        """The scores of some n-grams in all languages, a row for each."""
        if self.full:
            return self.full[n][numbers]
        starts, langs, scores = self.rows[n]
        out = np.full((len(numbers), len(self.langs)), PENALTY, np.float32)
        for row, i in zip(out, numbers):
            own = slice(starts[i], starts[i + 1])
            row[langs[own]] = scores[own]
        return out

    def word(self, word: str) -> np.ndarray:
        """The word's score in each language: its own, or the mean of its n-grams of the greatest length of which any is known."""
        known = self.tables[0].get(word)
        if known is not None:
            return self.full[0][known] if self.full else self._dense(0, [known])[0]
        for n in range(self.max_gram, 0, -1):
            found = [i for g in grams(word, n) if (i := self.tables[n].get(g)) is not None]
            if found:
                if len(found) <= GRAM_BLOCK:
                    return self._dense(n, found).mean(axis=0, dtype=np.float64)
                blocks = (self._dense(n, found[at : at + GRAM_BLOCK]).sum(axis=0, dtype=np.float64) for at in range(0, len(found), GRAM_BLOCK))
                return sum(blocks) / len(found)
        return np.full(len(self.langs), PENALTY)

    def scorer(self, cache_words: int = CACHE_WORDS):
        """A function from texts to [languages, scores]; it keeps the scores of words it has seen, up to ``cache_words`` and ``CACHE_BYTES``."""
        cache_words = max(2, min(cache_words, CACHE_BYTES // (8 * max(len(self.langs), 1))))
        places: dict[str, int] = {}
        scores = np.empty((cache_words, max(len(self.langs), 1)))

        def place(word: str) -> int:
            i = places[word] = len(places)
            scores[i] = self.word(word)
            return i

        def one(text: str | None) -> tuple[str, float]:
            words = words_in(text) if text else []
            if not words or not self.langs:
                return "und", 0.0
            total = np.zeros(len(self.langs))
            for at in range(0, len(words), cache_words // 2):
                part = words[at : at + cache_words // 2]
                if len(places) + len(part) > cache_words:
                    places.clear()
                get = places.get
                total += scores[[i if (i := get(w)) is not None else place(w) for w in part]].sum(axis=0)
            mean = total / len(words)
            best = int(mean.argmax())
            return self.langs[best], float(1 / np.power(10, mean - mean[best]).sum())

        return lambda texts: list(zip(*map(one, texts))) or [[], []]


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS, min_times: int = MIN_TIMES, max_gram: int = MAX_GRAM) -> Model:
    """A model of all languages in ``docs`` (``doc_id, text, lang``; rows with a null in any of these don't count), from a sample of ``train_docs`` documents of each."""
    ids = sample_ids(docs, "lang", train_docs)
    rows = docs.select("doc_id", "text", "lang").where("text is not null").join(F.broadcast(ids), ["doc_id", "lang"], "left_semi").dropDuplicates(["doc_id", "lang"])
    kept = count_grams(rows, max_gram).withColumn("all", F.sum("times").over(W.partitionBy("n", "gram"))).where(F.col("all") >= min_times)
    return Model(kept.select(*MODEL_COLUMNS).toArrow(), max_gram)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``doc_id, lang_pred, score``: one for each row of ``docs``; score is the best language's share of likelihood for a word.

    ``und`` with score 0 for a null text, one without a letter (category L), or an empty model. Where languages tie, the one with more training text wins, then the
    name. Null ids stay, repeated rows get the same answer, an empty table gives no rows; very long texts are scored whole, in parts. Other columns are not read.
    """
    return per_text(docs, lambda: model.scorer(), "lang_pred string, score double", id_col, text_col)


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~in_fold(F.col("doc_id"), 4, 2)))
    return identify(docs, model).select("doc_id", in_fold(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")
