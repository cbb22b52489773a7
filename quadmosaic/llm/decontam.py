"""Benchmark decontamination over a positional inverted index, in DataFrame operations only.

The index stores postings (term, document, position) of training tokens with the words around each; only terms that are
needed are stored: of each benchmark window the two rarest in the whole corpus. A posting's position less the term's place in the item is its
shift. Postings of one exact match have the same shift, those of a proximity match shifts that differ by the words put in between;
intersecting the lists of a window's rarest terms by document and shift gives its candidates, and the stored words decide exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadmosaic.llm.common import WORD_SEPARATORS, fold_ascii_col, fresh, settled, table

WINDOW = 10
#: Terms of a window that are looked up.
RAREST = 2
#: Bytes, as JSON, up to which a side is sent to every task; a larger one is joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def _words(text: Column) -> Column:
    return F.array_remove(F.split(fold_ascii_col(F.coalesce(text, F.lit(""))), WORD_SEPARATORS, -1), "")


def _small(df: DataFrame) -> DataFrame:
    """``df``, which is settled, marked for broadcast if its measured size allows it."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def windows(items: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Rows ``item, item_id, start, words``: every window of every item, with its own words only. ``item`` tells items apart; one without an id is named ``null``. Items without words have none."""
    named = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    rows = items.select(named.alias("item_id"), _words(F.col(text_col)).alias("all")).where("size(all) > 0").distinct().withColumn("item", F.xxhash64("item_id", "all"))
    last = F.greatest(F.size("all") - window, F.lit(0))
    return rows.select("item", "item_id", F.explode(F.sequence(F.lit(0), last)).alias("start"), "all").select("item", "item_id", "start", F.slice("all", F.col("start") + 1, window).alias("words"))


def anchors(docs: DataFrame, wins: DataFrame, rarest: int = RAREST, text_col: str = "text") -> DataFrame:
    """Rows ``term, before, after, wins``: the terms that are looked up, by the words beside them in the item, and the windows that each is among the rarest of
    (``item, item_id, start, words, place``; place in the window)."""
    placed = wins.select("item", "item_id", "start", "words", F.posexplode("words").alias("place", "term"))
    vocabulary = settled(placed.select("term").distinct())
    tokens = docs.select(F.explode(_words(F.col(text_col))).alias("term"))
    times = tokens.join(_small(vocabulary), "term", "left_semi").groupBy("term").agg(F.count("*").alias("times"))
    rank = F.row_number().over(W.partitionBy("item", "start").orderBy(F.coalesce("times", F.lit(0)), "term", "place"))
    ranked = placed.join(times, "term", "left").withColumn("rank", rank).where(F.col("rank") <= rarest)
    beside = lambda step: F.get("words", F.col("place") + step)
    return ranked.select("term", beside(-1).alias("before"), beside(1).alias("after"), F.struct("item", "item_id", "start", "words", "place").alias("win"))


def postings(docs: DataFrame, terms: DataFrame, around: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index: rows ``term, doc_id, text_hash, pos, first, near`` for every place of the ``terms`` in ``docs``.

    ``near`` has the words from position ``first`` to ``pos + around``.
    """
    words = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), _words(F.col(text_col)).alias("words"))
    each = words.select("doc_id", "text_hash", "words", F.posexplode("words").alias("pos", "term"))
    first = F.greatest(F.col("pos") - around, F.lit(0))
    near = F.slice("words", first + 1, F.col("pos") + around + 1 - first)
    return each.join(_small(terms), "term", "left_semi").select("term", "doc_id", "text_hash", "pos", first.alias("first"), near.alias("near"))


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``doc_id, text_hash, item_id, start, first, last, exact``: the windows of items (``start``, in item words) that stand in a document from word ``first`` to ``last``.

    With ``slop`` 0 these are exact phrases. With more they are proximity matches, too: a window's words stand in their order with up to ``slop`` other words between them,
    all gaps together; around each place of one of the window's rarest terms the tightest such span is taken. Null and empty texts have no
    words. Rows of the same id and text count once; null ids are kept; other columns are not read. An item without an id is named ``null``.
    """
    wins = settled(windows(items, window))
    marks = settled(anchors(docs, wins, RAREST, text_col))
    terms = settled(marks.select("term").distinct())
    index = settled(postings(docs, terms, window - 1 + slop, id_col, text_col))
    here = F.col("pos") - F.col("first")
    # a window of two words or more has a word beside the term, no further off than the slop allows
    near_to = lambda side, sign: F.coalesce(F.expr(" or ".join(f"get(near, pos - first + {sign * d}) = {side}" for d in range(1, slop + 2))), F.lit(False))
    alone = F.col("before").isNull() & F.col("after").isNull()
    hits = index.join(_small(marks), "term").where(alone | near_to("before", -1) | near_to("after", 1))

    def reached(words: Column, sign: int) -> Column:
        """Where in ``near`` the last of ``words`` stands, each looked for from the one before on, no further off than the slop allows; null if one is missing."""
        step = lambda at, w: F.coalesce(*[F.when(F.get("near", at + sign * d) == w, at + sign * d) for d in range(1, slop + 2)])
        return F.aggregate(words, here, step)

    place, own = F.col("win.place"), F.col("win.words")
    if slop:
        low, high = reached(F.reverse(F.slice(own, 1, place)), -1), reached(F.slice(own, place + 2, F.size(own)), 1)
    else:
        at = here - place
        same = (at >= 0) & (F.slice("near", F.greatest(at, F.lit(0)) + 1, F.size(own)) == own)
        low, high = F.when(same, at), F.when(same, at + F.size(own) - 1)
    found = hits.withColumns({"low": low, "high": high}).where(F.col("low").isNotNull() & F.col("high").isNotNull() & (F.col("high") - F.col("low") < F.size(own) + slop))
    found = found.select(
        "doc_id", "text_hash", "win.item", "win.item_id", "win.start", "win.place", (F.col("pos") - place).alias("shift"), (F.col("first") + F.col("low")).alias("first"), (F.col("first") + F.col("high")).alias("last"),
        F.size(own).alias("length"),
    )
    # the lists of a window's rarest terms meet where their shifts differ by the slop at most: in one of two neighbouring buckets of shifts
    bucket = F.floor(F.col("shift") / (slop + 1))
    dealt = found.withColumn("bucket", F.explode(F.array(bucket, bucket + 1)) if slop else bucket)
    lists = dealt.groupBy("doc_id", "text_hash", "item", "item_id", "start", "length", "bucket").agg(F.collect_set("place").alias("places"), F.collect_set(F.struct("first", "last")).alias("spans"))
    whole = lists.where(F.size("places") >= F.least(F.lit(RAREST), F.col("length"))).select("doc_id", "text_hash", "item_id", "start", "length", F.explode("spans").alias("span"))
    rows = whole.select("doc_id", "text_hash", "item_id", "start", "span.first", "span.last", (F.col("span.last") - F.col("span.first") + 1 == F.col("length")).alias("exact"))
    return rows.distinct() if slop else rows


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``doc_id, text_hash, n_hit, n_near, item_ids`` for the documents with a match: words inside any exact match, words inside any match, and the items with exact matches, sorted as strings."""
    found = settled(matches(docs, items, window, slop, id_col, text_col))
    by = ["doc_id", "text_hash"]
    places = found.groupBy(*by, "first", "last").agg(F.max("exact").alias("exact")).select(*by, F.explode(F.sequence("first", "last")).alias("pos"), "exact").groupBy(*by, "pos").agg(F.max("exact").alias("exact"))
    hit = places.groupBy(*by).agg(F.count_if("exact").alias("n_hit"), F.count("*").alias("n_near"))
    named = found.where("exact").groupBy(*by).agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    joined = hit.alias("h").join(named.alias("n"), F.col("h.doc_id").eqNullSafe(F.col("n.doc_id")) & (F.col("h.text_hash") == F.col("n.text_hash")), "left")
    return joined.select("h.doc_id", "h.text_hash", "n_hit", "n_near", ids.alias("item_ids"))


def with_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_hit``, ``n_near`` and ``item_ids`` (0 and empty for clean documents); columns of ``docs`` by these names are replaced, all others stay."""
    made, mark = ("n_hit", "n_near", "item_ids"), fresh(docs, "contamination")
    hit = settled(contamination(docs, items, window, slop, id_col, text_col).select(F.struct("doc_id", "text_hash", *made).alias(mark)))
    own = F.col(mark)
    same = F.col(id_col).cast("long").eqNullSafe(own["doc_id"]) & (F.xxhash64(text_col) == own["text_hash"])
    joined = docs.drop(*made).join(_small(hit), same, "left")
    zero, none = F.lit(0).cast("long"), F.array().cast("array<string>")
    return joined.withColumns({c: F.coalesce(own[c], none if c == "item_ids" else zero) for c in made}).drop(mark)


#: Other words that may stand between the words of a window in the query's proximity matches.
SLOP = 1


def op5_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact matches of the benchmark; ``n_near`` counts the words of proximity matches, too."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = docs.select("doc_id", F.xxhash64("text").alias("__hash"), F.size(_words(F.col("text"))).cast("long").alias("n_words"))
    hit = settled(contamination(docs, table(spark, sf_dir, "benchmark"), slop=SLOP)).withColumnRenamed("doc_id", "__id")
    joined = rows.join(_small(hit), rows["doc_id"].eqNullSafe(hit["__id"]) & (rows["__hash"] == hit["text_hash"]), "left")
    zero = F.lit(0).cast("long")
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", zero).alias("n_hit"),
        F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("item_ids", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", zero) > 0).alias("contaminated"),
        F.coalesce("n_near", zero).alias("n_near"),
    )


OP5_SQL = r"""
with d as (
  select row_number() over () rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w
  from documents
), b as (
  select distinct coalesce(item_id::varchar, 'null') item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w
  from benchmark
), bw as (
  select distinct item_id, least(len(w), 10) n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') g
  from (select item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) i from b where len(w) > 0)
), lens as (
  select distinct n from bw
), dw as (
  select rid, i, n, array_to_string(w[i : i + n - 1], ' ') g
  from (select rid, w, n, unnest(generate_series(1, len(w) - n + 1)) i from d, lens where len(w) >= n)
), m as (
  select rid, i, dw.n, item_id from dw join bw on dw.g = bw.g and dw.n = bw.n
), gap as (
  select rid, i, n + 1 n, array_to_string(list_concat(w[i : i + j - 1], w[i + j + 1 : i + n]), ' ') g, n size
  from (select rid, w, n, i, unnest(generate_series(1, n - 1)) j from (select rid, w, n, unnest(generate_series(1, len(w) - n)) i from d, lens where len(w) > n and n > 1))
), mg as (
  select rid, i, gap.n from gap join bw on gap.g = bw.g and gap.size = bw.n
), near as (
  select rid, count(distinct p) n_near from (select rid, unnest(generate_series(i, i + n - 1)) p from (select rid, i, n from m union all select * from mg)) group by rid
), hit as (
  select rid, count(distinct p) n_hit from (select rid, unnest(generate_series(i, i + n - 1)) p from m) group by rid
), it as (
  select rid, count(distinct item_id) n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) ids from m group by rid
)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(ids, '')) items_sha256, n_hit is not null contaminated, coalesce(n_near, 0)::bigint n_near
from d left join hit using (rid) left join it using (rid) left join near using (rid)
"""
