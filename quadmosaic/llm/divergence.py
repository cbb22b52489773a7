"""How the sources of a language differ in their words: an audit by counts alone.

Terms are exploded from the texts and counted by language and source. Each language keeps the terms of enough documents; its groups are crossed with
these, so that what a group never says is a zero of its own. Smoothed shares, in integers, are then compared term by term: group against group
(a self-join by language and term) and group against its language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadmosaic.llm.common import fold_ascii_col, settled, table

#: A maximal run of these is a term, once A-Z are lower-cased: letters of ASCII, and whatever is beyond it.
TERM = r"[a-z\x{80}-\x{10FFFF}]+"
MIN_DOCS, TOP_TERMS = 30, 50
#: What is added to each count, and the whole of a group's shares.
SMOOTHING, WHOLE = 5, 1_000_000_000
#: Parts that a language's vocabulary is dealt to when its groups meet it, so that one language fills many tasks.
SALTS = 64


def term_counts(docs: DataFrame) -> DataFrame:
    """Rows ``lang, source, term, n, n_docs``: occurrences, and rows of ``docs`` with the term. Counted in the tasks first, so a frequent term or source is no hot group."""
    terms = F.regexp_extract_all(fold_ascii_col(F.col("text")), F.lit(TERM), F.lit(0))
    both = F.array(F.struct(F.col("ts").alias("ts"), F.lit(False).alias("once")), F.struct(F.array_distinct("ts").alias("ts"), F.lit(True).alias("once")))
    parts = docs.select("lang", "source", terms.alias("ts")).select("lang", "source", F.explode(both).alias("part"))
    each = parts.select("lang", "source", F.col("part.once").alias("once"), F.explode("part.ts").alias("term"))
    return each.groupBy("lang", "source", "term").agg(F.count(F.when(~F.col("once"), 1)).alias("n"), F.count(F.when(F.col("once"), 1)).alias("n_docs"))


def _share(n: Column, size: Column) -> Column:
    """1 and the smoothed share of :data:`WHOLE`, rounded down; exact for counts of up to 19 digits."""
    return F.lit(1).cast("long") + F.call_function("div", F.lit(WHOLE).cast("decimal(10,0)") * (n + SMOOTHING).cast("decimal(20,0)"), size.cast("decimal(20,0)"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """Rows ``lang, source, part, item, value, rank`` of ``docs`` (``text, lang, source``).

    Part ``pair`` has for each group the other sources of its language by the sum of differences of shares; part ``term`` the ``top_terms`` terms that the
    group uses above its language's share. Ranks go by value, largest first, then by item.

    Nulls are empty strings and meet rows that have these. Each row of ``docs`` is a document, repeated ones too. A group without terms, or of a language
    that keeps none, has its pairs (of value 0 in the latter case) and no terms; the only source of a language has no pairs. Very long texts are
    read whole, an empty table gives no rows, other columns are not read. Pairs are as many as the result asks for: the square of a language's sources.
    """
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    frequent = F.sum("n_docs").over(W.partitionBy("lang", "term"))
    kept = settled(term_counts(rows).withColumn("docs", frequent).where(F.col("docs") >= min_docs).select("lang", "source", "term", "n"))
    vocabulary = settled(kept.groupBy("lang", "term").agg(F.sum("n").alias("n_lang")))
    sizes = vocabulary.groupBy("lang").agg((F.sum("n_lang") + SMOOTHING * F.count("*")).alias("lang_size"), F.count("*").alias("v"))
    said = kept.groupBy("lang", "source").agg(F.sum("n").alias("said"))
    groups = settled(
        rows.select("lang", "source").distinct().join(said, ["lang", "source"], "left").join(sizes, "lang", "left")
        .select("lang", "source", "lang_size", (F.coalesce("said", F.lit(0)) + SMOOTHING * F.col("v")).alias("size"))
    )

    salted = vocabulary.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int"))
    met = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).join(salted, ["lang", "salt"])
    dense = met.join(kept, ["lang", "source", "term"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    shares = settled(dense.select("lang", "source", "term", "n", _share(F.col("n"), F.col("size")).alias("p"), _share(F.col("n_lang"), F.col("lang_size")).alias("q")))

    one, other = shares.select("lang", "term", "source", "p"), shares.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"))
    apart = one.join(other, ["lang", "term"]).where("source < item").groupBy("lang", "source", "item").agg(F.sum(F.abs(F.col("p") - F.col("q"))).alias("value"))
    beside = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source < item")
    pairs = settled(beside.join(apart, ["lang", "source", "item"], "left").withColumn("value", F.coalesce("value", F.lit(0))))
    pairs = pairs.unionByName(pairs.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))

    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    above = shares.where("n > 0 and p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    ranked = pairs.withColumn("rank", rank).withColumn("part", F.lit("pair")).unionByName(above.withColumn("rank", rank).where(F.col("rank") <= top_terms).withColumn("part", F.lit("term")))
    return ranked.select("lang", "source", "part", "item", "value", "rank")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
with d as (
  select row_number() over () rid, coalesce(lang, '') lang, coalesce(source, '') source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') ts
  from documents
), t as (
  select rid, lang, source, unnest(ts) term from d
), k as (
  select lang, term, count(*)::hugeint n from t group by lang, term having count(distinct rid) >= 30
), c as (
  select lang, source, term, count(*)::hugeint n from t semi join k using (lang, term) group by lang, source, term
), g as (
  select distinct lang, source from d
), z as (
  select lang, sum(n)::hugeint n, count(*)::hugeint v from k group by lang
), dense as (
  select lang, source, term, coalesce(c.n, 0) n, 1 + (1000000000 * (k.n + 5)) // (z.n + 5 * z.v) q,
    (sum(coalesce(c.n, 0)) over (partition by lang, source))::hugeint + 5 * z.v size
  from g join k using (lang) join z using (lang) left join c using (lang, source, term)
), s as (
  select *, 1 + (1000000000 * (n + 5)) // size p from dense
), a as (
  select x.lang, x.source, y.source item, sum(abs(x.p - y.p)) as value from s x join s y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all
), r as (
  select x.lang, x.source, 'pair' part, y.source item, coalesce(a.value, 0)::bigint as value
  from g x join g y on x.lang = y.lang and x.source <> y.source left join a on a.lang = x.lang and a.source = x.source and a.item = y.source
  union all
  select lang, source, 'term', term, (p - q)::bigint from s where n > 0 and p > q
)
select lang, source, part, item, value, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank
from r qualify part = 'pair' or rank <= 50
"""
