"""Best-fit packing of documents into bins of a fixed number of tokens, under conflicts.

Two documents of one source, or of one cluster of duplicates, don't share a bin. Documents are dealt into shards of a bounded
number of rows, which pack on their own. In a shard the pieces come longest first; open bins are kept by
residual, and each carries one bitmap of its sources and one of its clusters. The search starts at the
smallest residual that holds the piece and goes on to the next larger ones until a bin has neither bit:
that is the tightest compatible bin. A residual whose bins all conflict (the AND of their bitmaps has the bit) is passed over whole.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadmosaic.llm.common import BLANKS, settled, table
from quadmosaic.llm.simhash import near_duplicates

CAPACITY = 4096
#: Rows of one shard, on average. Memory and time of a task depend on it, not on the table's size.
SHARD_ROWS = 8192


class _Residual:
    """The open bins of one residual: bin to its bitmaps, and the AND of all bitmaps."""

    __slots__ = ("bins", "sources", "clusters")

    def __init__(self):
        self.bins: dict[int, tuple[int, int]] = {}
        self.sources = self.clusters = -1

    def add(self, number: int, sources: int, clusters: int) -> None:
        self.bins[number] = (sources, clusters)
        self.sources &= sources
        self.clusters &= clusters

    def take(self, source: int, cluster: int) -> tuple[int, int, int] | None:
        """Removes the first bin without either bit. The ANDs stay, as a lower bound, until the bins are gone."""
        if self.sources & source or self.clusters & cluster:
            return None
        for number, (s, c) in self.bins.items():
            if not (s & source or c & cluster):
                del self.bins[number]
                if not self.bins:
                    self.sources = self.clusters = -1
                return number, s, c
        # none fits: make the bounds exact, so that the next search of this kind passes over
        self.sources = self.clusters = -1
        for s, c in self.bins.values():
            self.sources &= s
            self.clusters &= c
        return None


def pack(lengths: list[int], sources: list, clusters: list, capacity: int = CAPACITY) -> list[int]:
    """The bin of each piece, in the order given; lengths are at most ``capacity``. A cluster of None conflicts with nothing."""
    bit_of_source = {s: 1 << i for i, s in enumerate(dict.fromkeys(sources))}
    times: dict = {}
    for c in clusters:
        times[c] = times.get(c, 0) + 1
    bit_of_cluster = {c: 1 << i for i, c in enumerate(c for c, n in times.items() if n > 1 and c is not None)}  # single ones can't conflict
    levels: dict[int, _Residual] = {}
    residuals: list[int] = []
    out, n_bins = [], 0
    for length, s, c in zip(lengths, sources, clusters):
        source, cluster = bit_of_source[s], bit_of_cluster.get(c, 0)
        at, got, left = bisect_left(residuals, length), None, 0
        while at < len(residuals):
            left = residuals[at]
            got = levels[left].take(source, cluster)
            if got:
                if not levels[left].bins:
                    del levels[left], residuals[at]
                break
            at += 1
        number, ss, cc = got or (n_bins, 0, 0)
        left = left if got else capacity
        n_bins += not got
        out.append(number)
        left -= length
        if left > 0:
            if left not in levels:
                levels[left] = _Residual()
                insort(residuals, left)
            levels[left].add(number, ss | source, cc | cluster)
    return out


PACKED = "doc_id string, piece int, first_token long, n_tokens long, shard long, bin long"


def n_tokens(text_col: str = "text") -> Column:
    """Words between ASCII blanks."""
    return F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(f"[^{BLANKS}]+")).cast("long")


def best_fit(docs: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster: str | None = None, tokens: Column | None = None) -> DataFrame:
    """Rows ``doc_id, piece, first_token, n_tokens, shard, bin``: where each document's tokens go.

    Tokens are words between ASCII blanks, or as many as ``tokens`` says. A document over ``capacity`` tokens, however long, is cut: its full pieces fill bins of their own and the
    rest is packed as any piece. Documents without a token (null, empty or blank texts) get one piece of 0 tokens, which takes a place under the
    same conflicts. A null source is a source of its own. ``cluster`` is a SQL expression for the class of duplicates; by default rows
    of the same text are one, and null is in conflict with nothing. Null ids are kept; repeated rows are packed apart; ties go in the order of ids; an empty table gives no rows. Rows reach
    shards by a hash of their own, whatever is in them, so no source, cluster or repeated row
    decides a shard's size, and only ids, lengths and two keys are shuffled. Other columns are not read. Bins are named by ``shard`` and ``bin``.
    """
    key = F.expr(cluster) if cluster else F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(
        F.xxhash64(F.monotonically_increasing_id()).alias("own"),
        F.col(id_col).cast("long").cast("string").alias("doc_id"),
        (n_tokens(text_col) if tokens is None else tokens).alias("n"),
        F.xxhash64(F.coalesce(F.col(source_col).cast("string"), F.lit("\x00null"))).alias("source"),
        key.cast("string").alias("cluster"),
    )
    rows = settled(rows)  # a row keeps its own hash, also when a task runs again
    n_shards = max(1, -(-rows.count() // shard_rows))
    rows = rows.withColumn("shard", F.pmod("own", F.lit(n_shards))).drop("own")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "n", "source", "cluster"], kind="stable", na_position="first", ignore_index=True)
        n = pdf["n"].to_numpy()
        full = n // capacity - ((n % capacity == 0) & (n > 0))  # full pieces before the last one
        last = n - full * capacity
        order = np.argsort(-last, kind="stable")
        bins = np.empty(len(n), np.int64)
        bins[order] = pack(last[order].tolist(), pdf["source"].to_numpy()[order].tolist(), pdf["cluster"].to_numpy(object)[order].tolist(), capacity)
        at = np.repeat(np.arange(len(n)), full)
        piece = np.arange(len(at)) - np.repeat(np.cumsum(full) - full, full)
        own = (bins.max() + 1 if len(bins) else 0) + np.arange(len(at))
        cols = {
            "row": np.concatenate([at, np.arange(len(n))]),
            "piece": np.concatenate([piece, full]).astype(np.int32),
            "n_tokens": np.concatenate([np.full(len(at), capacity), last]),
            "bin": np.concatenate([own, bins]),
        }
        out = pd.DataFrame(cols)
        out["doc_id"] = pdf["doc_id"].to_numpy()[out["row"]]
        out["first_token"] = out["piece"].astype("int64") * capacity
        out["shard"] = pdf["shard"].iat[0]
        return out[["doc_id", "piece", "first_token", "n_tokens", "shard", "bin"]]

    packed = rows.groupBy("shard").applyInPandas(run, PACKED)
    return packed.withColumn("doc_id", F.col("doc_id").cast("long"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs all documents; near copies, exact ones among them, are one cluster."""
    docs = table(spark, sf_dir, "documents")
    # a row's id for the clusters is never null, so that near copies without an id are told from others, too
    keyed = docs.select(F.xxhash64("doc_id", F.xxhash64("text")).alias("key"), "text", F.col("doc_id").alias("own_id"), "source", n_tokens().alias("n"))
    rows = near_duplicates(keyed, "key", keep=("own_id", "source", "n"))
    return best_fit(rows, id_col="own_id", cluster="component_id", tokens=F.col("n"))
