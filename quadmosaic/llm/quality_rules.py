"""Quality rules as a bitmask ledger.

Each rule is evaluated once for each document. The ledger keeps the measurements and one bit for each
failed rule; policies (named, versioned sets of rules) and ablations are then bitwise expressions over
the ledger, without reading a text again.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadmosaic.llm.common import BLANKS, per_text, table

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_upper")
_SYMBOLS = b"#*$%&|<>"
_UPPER_BYTES, _LOWER_BYTES = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``fails`` is a SQL condition over the measurements; true sets the rule's bit."""

    bit: int
    name: str
    fails: str


#: The version of the rules and their bits; a ledger carries the one that it was made with.
RULES_VERSION = 1
RULES = (
    Rule(0, "too_few_words", "n_words < 50"),
    Rule(1, "repeated_phrases", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule(4, "word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    Rule(5, "shouting", "2 * n_upper > n_letters"),
    Rule(6, "too_many_words", "n_words > 1000000"),
)


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    def mask(self, rules: tuple[Rule, ...] = RULES) -> int:
        bits = {r.name: r.bit for r in rules}
        return sum(1 << bits[n] for n in self.rules)


BASE = Policy("base", 1, ("too_few_words", "repeated_phrases"))
WEB = Policy("web", 1, ("too_few_words", "repeated_phrases", "symbols", "repeated_lines", "word_length", "shouting", "too_many_words"))


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one text, in the order of ``MEASURES``; null or empty text has no words."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    windows = list(zip(words, words[1:], words[2:]))
    times = Counter(windows)
    repeated = 0
    if len(times) < len(windows):
        last = -1  # the last position that is counted
        for i, w in enumerate(windows):
            if times[w] > 1:
                repeated += i + 2 - max(last, i - 1)
                last = i + 2
    lines = raw.split(b"\n")
    full = [x for x in lines if x.split(None, 1)]
    upper, lower = (len(raw) - len(raw.translate(None, x)) for x in (_UPPER_BYTES, _LOWER_BYTES))
    return (
        len(words),
        len(text) - sum(text.count(c) for c in BLANKS),
        len(raw) - len(raw.translate(None, _SYMBOLS)),
        len(lines),
        len(full) - len(set(full)),
        repeated,
        upper + lower,
        upper,
    )


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``doc_id``, the measurements, ``fail_bits`` and ``rules_version``; one row for each row of ``docs``.

    A null or empty text measures 0 everywhere but for ``n_lines``, which is 1. A null id stays null, repeated
    rows give repeated ledger rows, and an empty table gives an empty ledger. Other columns are not read.
    """

    rows = per_text(docs, lambda: lambda texts: list(zip(*map(measure, texts))) or [[]] * len(MEASURES), ", ".join(f"{m} long" for m in MEASURES), id_col, text_col)
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    return rows.withColumns({"fail_bits": bits, "rules_version": F.lit(RULES_VERSION)})


def passes(policy: Policy, rules: tuple[Rule, ...] = RULES) -> Column:
    """True where no rule of the policy failed."""
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask(rules)).cast("long")) == 0


def ablations(ledger_rows: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail only it (and so come back without it), and documents dropped without it.

    The ledger is first reduced to counts of failure patterns, 2^rules at most; each pattern then counts towards every rule. A ledger of another version of the rules is an error.
    """
    mask = F.lit(policy.mask(rules)).cast("long")
    known = F.when(F.col("rules_version") == RULES_VERSION, F.col("fail_bits")).otherwise(F.raise_error(F.lit("a ledger of another version of the rules")))
    patterns = ledger_rows.select(known.bitwiseAND(mask).alias("bits")).groupBy("bits").count()
    chosen = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in rules if r.name in policy.rules])
    each = patterns.withColumn("r", F.explode(chosen)).select("bits", "count", "r.rule", "r.bit")
    total = lambda c: F.coalesce(F.sum(F.when(F.expr(c), F.col("count"))), F.lit(0)).cast("long")
    return each.groupBy(F.lit(policy.name).alias("policy"), F.lit(policy.version).alias("version"), "rule").agg(
        total("bits & bit <> 0").alias("n_failed"), total("bits = bit").alias("n_only"), total("bits <> 0 and bits <> bit").alias("n_dropped_without")
    )


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the web policy does over all documents."""
    return ablations(ledger(table(spark, sf_dir, "documents")), WEB)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~passes(BASE)).alias("base_failed"), (passes(BASE) & passes(WEB)).alias("kept"), "fail_bits")


OP1_SQL = r"""
with d as (
  select row_number() over () rid, doc_id, coalesce(text, '') t from documents
), w as (
  select rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') ws, string_split(t, chr(10)) ls from d
), win as (
  select rid, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] g from (select rid, ws, unnest(generate_series(1, len(ws) - 2)) i from w)
), rep as (
  select rid, i from (select rid, i, count(*) over (partition by rid, g) n from win) where n > 1
), cov as (
  select rid, count(distinct p) n from (select rid, unnest([i, i + 1, i + 2]) p from rep) group by rid
), dup as (
  select rid, count(*) - count(distinct l) n from (select rid, unnest(ls) l from w) where regexp_matches(l, '[^\x20\x09-\x0D]') group by rid
), m as (
  select doc_id, len(ws)::bigint n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint n_symbols, coalesce(dup.n, 0)::bigint n_dup_lines, coalesce(cov.n, 0)::bigint n_repeat_words,
    len(ls)::bigint n_lines, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) n_letters, length(regexp_replace(t, '[^A-Z]', '', 'g')) n_upper
  from w left join dup using (rid) left join cov using (rid)
), b as (
  select *, (case when n_words < 50 then 1 else 0 end) + (case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end)
    + (case when 10 * n_symbols > n_words then 4 else 0 end) + (case when 10 * n_dup_lines > 3 * n_lines then 8 else 0 end)
    + (case when word_chars < 2 * n_words or word_chars > 15 * n_words then 16 else 0 end)
    + (case when 2 * n_upper > n_letters then 32 else 0 end) + (case when n_words > 1000000 then 64 else 0 end) fail_bits
  from m
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 base_failed, (fail_bits & 127) = 0 kept, fail_bits::bigint fail_bits from b
"""

ABLATIONS_SQL = OP1_SQL[: OP1_SQL.rindex("select doc_id")] + "select 'web' policy, 1 as version, r.rule, count(*) filter ((fail_bits & r.bit) <> 0) n_failed, count(*) filter (fail_bits = r.bit) n_only, count(*) filter (fail_bits <> 0 and fail_bits <> r.bit) n_dropped_without from b, (values "
ABLATIONS_SQL += ", ".join(f"('{r.name}', {1 << r.bit})" for r in RULES) + ") r(rule, bit) group by r.rule"
