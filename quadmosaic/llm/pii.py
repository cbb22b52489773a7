"""Personal data: patterns for identifiers, and an information-theoretic choice of the words that give them away.

Identifiers (e-mail, IP, card and phone numbers) are the protected entities. For each, the words near it are counted over the whole
corpus. A word discloses an entity by the pointwise mutual information of the two, as a share of the entity's
own information content: 1 means that the word stands only where the entity does. Words at or above ``remove`` are
removed. Words at or above ``generalise`` are cut to the longest beginning, of :data:`LONGEST_START` letters at most, that, as a class of all words that begin so, discloses less than that; where none does, they are
removed, too. This is done in every document where they stand, whether it states the entity or not. A pair
counts only if it was seen in ``support`` different contexts, so copies of one passage are no evidence.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadmosaic.llm.common import per_text, settled, table

KINDS = ("email", "ip", "card", "phone")
TERM_KINDS = ("general", "removed")
#: Words on each side of an entity that are its context.
AROUND, SUPPORT, GENERALISE, REMOVE = 5, 2, 0.75, 0.9
#: Letters of the longest beginning that a word is generalised to: more would say too much of it, and work grows with the square of it.
LONGEST_START = 32
#: Rows and bytes of the words that are sent to every task; more are joined by a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 20_000, 4 << 20

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can't start inside a run of digits: what fails at the run's start fails further on, and a match ends with its run.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]{3,}")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Found from each @, as its left side is a run up to it: time stays linear in long runs."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", done)
    return out


def entities(text: str | None) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end) of all identifiers, sorted. Matches that fail their check are dropped."""
    if not text:
        return []
    out = [(a, 0, z) for a, z in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def terms_of(text: str) -> list[str]:
    return [w.lower() for w in _TERM.findall(text)]


def merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The (start, end) of the stretches that sorted spans cover; they don't overlap, so both ends ascend."""
    out: list[tuple[int, int]] = []
    for a, _, z in spans:
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def blanked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with blanks for whatever the spans cover."""
    out, done = [], 0
    for a, z in merged(spans):
        out += [text[done:a], " " * (z - a)]
        done = z
    return "".join([*out, text[done:]])


def mentions(text: str | None, around: int = AROUND) -> list[tuple[str, list[str], str]]:
    """(entity, distinct words near it, hash of these words in order) for each identifier of a text."""
    spans = entities(text)
    out: list[tuple[str, list[str], str]] = []
    plain = blanked(text, spans) if spans else ""  # words of identifiers are no context
    words = [(m.start(), m[0].lower()) for m in _TERM.finditer(plain)]
    for start, kind, end in spans:
        left, right = bisect_left(words, (start,)), bisect_left(words, (end,))
        before, after = [w for _, w in words[max(0, left - around) : left]], [w for _, w in words[right : right + around]]
        context = hashlib.md5(" ".join([*before, "", *after]).encode(), usedforsecurity=False).hexdigest()
        value = re.sub(r"[\x20().-]", "", text[start:end]) if kind > 1 else text[start:end].lower()
        out.append((f"{KINDS[kind]}:{value}", sorted({*before, *after}), context))
    return out


def disclosing(docs: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``term, replacement``, one for each word that discloses an entity: the beginning that it is generalised to, or an empty one if it is to be removed.

    Everything is counted by distinct pairs and partial sums, so an entity that stands in very many documents is never one group.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # per_text passes one id: it gets the row's key here
    keyed = rows.select(F.xxhash64("doc_id", F.xxhash64("text")).alias("doc_id"), "text")

    def run(texts: list) -> list:
        return [[[dict(entity=e, terms=t, context=c) for e, t, c in mentions(x)] for x in texts]]

    found = settled(per_text(keyed, lambda: run, "m array<struct<entity:string,terms:array<string>,context:string>>").select(F.col("doc_id").alias("doc"), F.explode("m").alias("m")).select("doc", "m.*"))
    n = rows.count()
    near = found.select("entity", "doc", "context", F.explode("terms").alias("term"))
    pair = ["entity", "term"]
    contexts = near.select(*pair, "context").distinct().groupBy(*pair).agg(F.count("*").alias("n_contexts")).where(F.col("n_contexts") >= support)
    both = near.select(*pair, "doc").distinct().groupBy(*pair).agg(F.count("*").alias("n_both"))
    own = found.select("entity", "doc").distinct().groupBy("entity").agg(F.count("*").alias("n_entity"))
    information = F.log2(n / F.col("n_entity"))

    def share(n_term: Column) -> Column:
        """The part of the entity's information that the word discloses."""
        return F.when(information > 0, F.log2(F.col("n_both") * F.lit(float(n)) / (F.col("n_entity") * n_term)) / information).otherwise(F.lit(0.0))

    # a word's documents near any entity are some of all its documents: what they already rule out needs no count over the corpus
    beside = near.select("term", "doc").distinct().groupBy("term").agg(F.count("*").alias("n_near"))
    together = settled(both.join(contexts, pair).join(own, "entity").join(beside, "term").where(share(F.col("n_near")) >= generalise))
    times = _document_counts(rows, settled(together.select("term").distinct()))
    at_least = F.greatest(F.coalesce("n_term", F.lit(0)), F.col("n_both"))
    chosen = settled(together.join(times, "term", "left").withColumn("share", share(at_least)).where(F.col("share") >= generalise).select(*pair, "n_entity", "share"))
    words = settled(chosen.groupBy("term").agg((F.max("share") >= remove).alias("removed")))
    wide = words.where("not removed and char_length(term) > 1").select("term", F.explode(F.sequence(F.lit(1), F.least(F.char_length("term") - 1, F.lit(LONGEST_START)))).alias("k")).select("term", F.substring("term", F.lit(1), F.col("k")).alias("start"))
    starts = settled(wide.select("start").distinct())
    if starts.isEmpty():
        return words.select("term", F.lit("").alias("replacement"))
    # each beginning, as a class of words, against every entity that its word discloses
    lengths = F.sequence(F.lit(1), F.least(F.greatest(F.char_length("term") - 1, F.lit(1)), F.lit(LONGEST_START)))
    entities_of = chosen.select("entity").distinct()
    classes = near.join(entities_of, "entity", "left_semi").select("entity", "doc", "term").distinct().select("entity", "doc", F.explode(F.transform(lengths, lambda k: F.substring(F.col("term"), F.lit(1), k))).alias("start"))
    class_both = classes.join(starts, "start", "left_semi").distinct().groupBy("entity", "start").agg(F.count("*").alias("n_both"))
    class_times = _document_counts(rows, starts.withColumnRenamed("start", "term"), beginnings=True).withColumnRenamed("term", "start")
    tested = wide.join(chosen.select(*pair, "n_entity"), "term").join(class_both, ["entity", "start"]).join(class_times, "start", "left").withColumn("share", share(at_least))
    safe = tested.groupBy("term", "start").agg(F.max("share").alias("share")).where(F.col("share") < generalise)
    longest = safe.groupBy("term").agg(F.max_by("start", F.char_length("start")).alias("start"))
    return words.join(longest, "term", "left").select("term", F.coalesce("start", F.lit("")).alias("replacement"))


def _few(terms: DataFrame) -> list | None:
    """The rows of ``terms``, which is settled, if their measured size lets every task have them."""
    n, size = terms.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    return terms.collect() if n <= BROADCAST_ROWS and size <= BROADCAST_BYTES else None


#: Letters by which words are told apart first when their beginnings are looked up; no word is shorter.
ROOT = 3


def _keys_of(text: str | None, lengths: tuple[int, ...] = (), roots: frozenset[str] = frozenset()) -> set[str]:
    """The distinct words of a text, or their proper beginnings of some lengths: all of fewer letters than ``ROOT``, longer ones of words that begin as ``roots``."""
    words = set(terms_of(text or ""))
    if not lengths:
        return words
    short, longer = [k for k in lengths if k < ROOT], [k for k in lengths if k >= ROOT]
    keys = {w[:k] for k in short for w in words}
    keys.update(w[:k] for w in words if w[:ROOT] in roots for k in longer if k < len(w))
    return keys


def _document_counts(rows: DataFrame, wanted: DataFrame, beginnings: bool = False) -> DataFrame:
    """Rows ``term, n_term``: in how many rows' texts each wanted term stands, or words that begin with it. Tasks count a set of checked size on their own; a larger one is joined."""
    lengths = tuple(r.n for r in wanted.select(F.char_length("term").alias("n")).distinct().orderBy("n").collect()) if beginnings else ()
    few = _few(wanted)
    if few is not None:
        chosen = frozenset(r.term for r in few)
        roots = frozenset(w[:ROOT] for w in chosen if len(w) >= ROOT)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: Counter[str] = Counter()
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    seen.update(chosen.intersection(_keys_of(text, lengths, roots)))
            yield pa.RecordBatch.from_pydict({"term": pa.array(seen.keys(), pa.string()), "n": pa.array(seen.values(), pa.int64())})

        return rows.select("text").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_term"))
    every = frozenset(r.root for r in wanted.where(F.char_length("term") >= ROOT).select(F.substring("term", 1, ROOT).alias("root")).distinct().collect()) if beginnings else frozenset()
    words = per_text(rows, lambda: lambda texts: [[sorted(_keys_of(t, lengths, every)) for t in texts]], "terms array<string>").select(F.explode("terms").alias("term"))
    return words.join(wanted, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_term"))


def spans_of(text: str | None, terms: dict[str, str]) -> list[tuple[int, int, int]]:
    """(start, index in ``KINDS + TERM_KINDS``, end) of identifiers and of disclosing words that don't touch one, sorted."""
    found = entities(text)
    if terms and text:
        inside = merged(found)
        starts = [a for a, _ in inside]
        for m in _TERM.finditer(text):
            start = terms.get(m[0].lower())
            if start is not None:
                before = bisect_left(starts, m.end())  # only the last stretch that starts before the word's end can reach into it
                if not before or inside[before - 1][1] <= m.start():
                    found.append((m.start(), len(KINDS) + (not start), m.end()))
    return sorted(found)


def sanitised(text: str | None, spans: list[tuple[int, int, int]], terms: dict[str, str]) -> str | None:
    """The text with identifiers replaced by their kind, generalised words cut to their beginning and a star, and removed words gone."""
    if text is None:
        return None
    out, done = [], 0
    for start, kind, end in spans:
        if start >= done:
            put = f"[{KINDS[kind].upper()}]" if kind < len(KINDS) else f"{terms[text[start:end].lower()]}*" if kind == len(KINDS) else ""
            out += [text[done:start], put]
            done = end
        elif end > done:
            done = end
    return "".join([*out, text[done:]])


def find_personal_data(docs: DataFrame, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """Rows ``doc_id, spans`` (and ``sanitised``, if asked for), one for each row of ``docs``; a span is ``start, kind, end`` with code points, end exclusive.

    Null text has no spans and stays null; empty text has none. Null ids stay; rows of the same id and text are one document in the counts;
    an empty table gives no rows. Texts are read whole, however long. A word that discloses an entity at exactly a threshold is above it. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    terms = settled(disclosing(docs, support, generalise, remove, id_col, text_col))
    few = _few(terms)
    schema = "spans array<struct<start:long,kind:string,end:long>>" + ", sanitised string" * with_text

    def result(texts: list, spans: list, terms: list) -> list:
        out = [[dict(start=a, kind=(KINDS + TERM_KINDS)[k], end=z) for a, k, z in s] for s in spans]
        return [out, [sanitised(*x) for x in zip(texts, spans, terms)]] if with_text else [out]

    if few is not None:
        chosen = {r.term: r.replacement for r in few}
        return per_text(rows, lambda: lambda texts: result(texts, [spans_of(t, chosen) for t in texts], [chosen] * len(texts)), schema)
    # too many for every task: words meet the terms by a shuffle, what is found goes back to its document
    key = F.xxhash64("doc_id", F.xxhash64("text"))
    words = per_text(rows.select(key.alias("doc_id"), "text"), lambda: lambda texts: [[sorted(_keys_of(t)) for t in texts]], "terms array<string>").select(F.col("doc_id").alias("doc"), F.explode("terms").alias("term"))
    side = words.distinct().join(terms, "term").groupBy("doc").agg(F.collect_list(F.struct("term", "replacement")).alias("terms"))
    joined = rows.join(side, key == F.col("doc"), "left")

    def run(pairs: list) -> list:
        texts, own = [p["text"] for p in pairs], [{t["term"]: t["replacement"] for t in p["terms"] or []} for p in pairs]
        return result(texts, [spans_of(*x) for x in zip(texts, own)], own)

    return per_text(joined.select("doc_id", F.struct("text", "terms").alias("text")), lambda: run, schema)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``n_spans`` counts all spans, those of the method too; ``sanitised_sha256`` is of the sanitised text (null for a null text)."""
    rows = find_personal_data(table(spark, sf_dir, "documents"), with_text=True)
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS))
    listed: Callable = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_kind = lambda k: F.filter("spans", lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select(
        "doc_id", *counts, sha(listed(base)).alias("base_sha256"), listed(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"), sha(F.col("sanitised")).alias("sanitised_sha256")
    )
