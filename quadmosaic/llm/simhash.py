"""Near duplicates by SimHash, linked through a Gray-order hierarchical index.

Fingerprints that differ in at most ``max_bits`` of 64 bits agree wholly on one of ``max_bits + k`` blocks of
bits (in fact on ``k`` of them), so equal choices of ``k`` blocks bring every close pair together. Within such a bucket the
fingerprints are sorted by Gray rank and grouped; a group's node keeps the bits that all its members share,
its children keep only what their parents do not. A search adds up differences from the top down and drops
a whole group once the sum exceeds the limit. Buckets give only spanning links, never all their pairs;
connected components follow by alternating large-star and small-star rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadmosaic.llm.common import per_text, settled, table

BITS, MAX_BITS, SHINGLE, SEED = 64, 4, 4, 42
#: Fingerprints of one bucket that one task takes; a larger bucket is dealt out as pairs of blocks of that size.
BLOCK_ROWS = 8192
#: Links up to which each node's least neighbour goes to every task.
BROADCAST_LINKS = 1 << 18
#: Members of a node on each level of the index.
FANOUT = 8


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Majority of the bits of the XXH64 of all word shingles; 0 without words."""
    words = text.encode().lower().split() if text else []  # bytes: only A-Z are lower-cased, only ASCII blanks split
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(len(words) - shingle + 1, 1)
    digest = xxhash.xxh64_intdigest
    stops = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), stops.tolist())), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 65536):
        ones += np.unpackbits(hashes[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows ``doc_id``, the columns of ``keep`` and ``fp``; the fingerprint as a signed long with the same bits."""

    return per_text(docs, lambda: lambda texts: [np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)], "fp long", id_col, text_col, keep)


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Position of each fingerprint in the reflected Gray sequence."""
    rank = fp.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return rank


class GrayIndex:
    """A hierarchy over fingerprints sorted by Gray rank.

    ``levels[0]`` has the fingerprints themselves, ``levels[-1]`` the top nodes. A node of a level has the value and the mask
    of the bits that all members share; ``own`` is the mask without the bits that its parent has already.
    """

    def __init__(self, fp: np.ndarray, fanout: int = FANOUT):
        self.order = np.argsort(gray_rank(fp), kind="stable")
        self.fanout = fanout
        values, masks = [fp[self.order]], [np.full(len(fp), np.iinfo(np.uint64).max, np.uint64)]
        while len(values[-1]) > fanout:
            at = np.arange(0, len(values[-1]), fanout)
            v, m = values[-1], masks[-1]
            same = np.bitwise_and.reduceat(m, at)
            low, high = np.bitwise_and.reduceat(v, at), np.bitwise_or.reduceat(v, at)
            masks.append(same & ~(low ^ high))
            values.append(low & masks[-1])
        self.values = values
        self.own = []
        for k, m in enumerate(masks):
            if k + 1 < len(masks):
                m = m & ~masks[k + 1][np.arange(len(m)) // fanout]
            self.own.append(m)

    def search(self, queries: np.ndarray, limit: int, labels: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, position in index order) within ``limit`` bits. ``labels`` are classes of the queries and of the index's rows: nodes
        wholly in the query's own class are skipped, as they can't add a link."""
        shared = self._classes(labels[1]) if labels else None
        top = len(self.values) - 1
        q = np.repeat(np.arange(len(queries)), len(self.values[top]))
        node = np.tile(np.arange(len(self.values[top])), len(queries))
        spent = np.zeros(len(q), np.uint8)
        for k in range(top, -1, -1):
            spent = spent + np.bitwise_count((queries[q] ^ self.values[k][node]) & self.own[k][node])
            keep = spent <= limit
            if shared is not None:
                keep &= shared[k][node] != labels[0][q]
            q, node, spent = q[keep], node[keep], spent[keep]
            if k:
                n = len(self.values[k - 1])
                q, spent = np.repeat(q, self.fanout), np.repeat(spent, self.fanout)
                node = (node[:, None] * self.fanout + np.arange(self.fanout)).ravel()
                inside = node < n
                q, node, spent = q[inside], node[inside], spent[inside]
        return q, node

    def _classes(self, labels: np.ndarray) -> list[np.ndarray]:
        """For each level the class of a node's members, or -1 where they differ."""
        out = [labels]
        for k in range(1, len(self.values)):
            at = np.arange(0, len(out[-1]), self.fanout)
            low, high = np.minimum.reduceat(out[-1], at), np.maximum.reduceat(out[-1], at)
            out.append(np.where(low == high, low, -1))
        return out


def spanning_links(left: np.ndarray, right: np.ndarray | None = None, limit: int = MAX_BITS, step: int = 64) -> list[tuple[int, int]]:
    """Links that connect whatever is connected by pairs within ``limit`` bits: among ``left``, or between ``left`` and ``right``."""
    fp = left if right is None else np.concatenate([left, right])
    target = GrayIndex(left if right is None else right)
    rows = target.order + (0 if right is None else len(left))
    parent = np.arange(len(fp))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    queries = target.order if right is None else np.argsort(gray_rank(left), kind="stable")
    for at in range(0, len(queries), step):
        q = queries[at : at + step]
        while not np.array_equal(up := parent[parent], parent):
            parent = up
        found_q, found = target.search(fp[q], limit, (parent[q], parent[rows]))
        for a, b in zip(q[found_q].tolist(), rows[found].tolist()):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
                links.append((int(fp[a]), int(fp[b])))
    return links


def _blocks(n_blocks: int) -> list[np.uint64]:
    """Masks of ``n_blocks`` runs of bits that make up all 64."""
    cuts = [round(i * BITS / n_blocks) for i in range(n_blocks + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]


def close_links(nodes: DataFrame, max_bits: int = MAX_BITS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Spanning links ``a, b`` between different fingerprints of ``nodes`` (column ``fp``, distinct) within ``max_bits`` bits.

    The more fingerprints there are, the more bits a bucket's key takes; every choice finds the same links. A bucket over ``block_rows`` is
    cut into blocks, and each pair of blocks is a group of its own, so no task holds more than two blocks.
    """
    spark = nodes.sparkSession
    n = nodes.count()
    extra = 1 if n < 1 << 22 else 2 if n < 1 << 31 else 3
    masks = [sum(c) for c in combinations(_blocks(max_bits + extra), extra)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keys = F.array(*[F.struct(F.lit(i).alias("k"), F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")).alias("v")) for i, m in enumerate(masks)])
    keyed = nodes.select("fp", F.explode(keys).alias("key")).select("fp", "key.k", "key.v")
    sizes = keyed.groupBy("k", "v").count().where("count > 1").withColumn("m", F.ceil(F.col("count") / block_rows).cast("int")).drop("count")
    own = F.pmod(F.xxhash64("fp"), F.col("m")).cast("int")
    dealt = (
        keyed.join(sizes, ["k", "v"])
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
        .select("k", "v", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp")
    )

    def links_of(fp: np.ndarray, own: np.ndarray, i: int, j: int) -> list[tuple[int, int]]:
        if i == j:
            return spanning_links(fp, None, max_bits)
        a, b = fp[own == i], fp[own == j]
        return spanning_links(a, b, max_bits) if len(a) and len(b) else []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Groups come sorted, most of them small, many to a batch; the last of a batch may go on in the next."""
        held: np.ndarray | None = None
        for pdf in batches:
            rows = pdf[["k", "v", "i", "j", "own", "fp"]].to_numpy()
            rows = rows if held is None else np.concatenate([held, rows])
            cuts = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1)) + 1
            held = rows[cuts[-1] if len(cuts) else 0 :]
            yield as_links(rows, [0, *cuts.tolist()])
        if held is not None:
            yield as_links(held, [0, len(held)])

    def as_links(rows: np.ndarray, cuts: list[int]) -> pd.DataFrame:
        found: list[tuple[int, int]] = []
        fp = np.ascontiguousarray(rows[:, 5]).view(np.uint64)
        for a, b in zip(cuts, cuts[1:]):
            if b - a > 1:
                found += links_of(fp[a:b], rows[a:b, 4], *rows[a, 2:4].tolist())
        return pd.DataFrame(np.array(found, np.uint64).reshape(-1, 2).view(np.int64), columns=["a", "b"])

    by = ["k", "v", "i", "j"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, *by).sortWithinPartitions(*by).mapInPandas(run, "a long, b long")


def _beside_least(links: DataFrame, least: DataFrame, n_links: int) -> DataFrame:
    """``links`` joined to ``least`` (one row for each ``u``, with the number ``n`` of its links).

    Up to ``BROADCAST_LINKS`` links, ``least`` goes to every task. Beyond, only nodes with a thousandth of all links or more, of which there are a thousand at most, do; the others are joined by a shuffle.
    """
    if n_links <= BROADCAST_LINKS:
        return links.join(F.broadcast(least), "u")
    least = settled(least)
    hot = F.col("n") * 1000 >= n_links
    many = links.join(F.broadcast(least.where(hot)), "u")
    return many.unionByName(links.join(F.broadcast(least.where(hot).select("u")), "u", "left_anti").join(least.where(~hot), "u"))


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links`` (``a, b``, of any type that can be ordered): rows ``node, root`` with the smallest node of each, by alternating stars.

    Each round works on links alone, by grouping with partial minima; it ends when no link changes. A node's links are never brought together in one task.
    """
    edges = settled(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark, n_links = None, edges.count()
    while True:
        # large star: larger neighbours move to the smallest of the neighbourhood
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = _beside_least(both, low, 2 * n_links).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node and its smaller neighbours move to the smallest of these
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _beside_least(large, low, 2 * n_links).select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        edges = settled(small.where("u <> v").distinct())
        seen = edges.agg(F.count("*").alias("n"), F.expr("coalesce(bit_xor(xxhash64(u, v)), 0)").alias("x")).first()
        if seen == mark:
            return edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
        mark, n_links = seen, seen.n


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS, block_rows: int = BLOCK_ROWS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows ``doc_id``, the columns of ``keep``, ``fp``, ``component_id`` and ``component_fp``: one for each row of ``docs``, the smallest id reachable over close fingerprints, and a fingerprint that stands for its group.

    Null and empty texts have fingerprint 0 and link to each other as any; very long texts are read whole, and an empty table gives no rows. Rows with a null id keep it and take part; ``component_id`` is
    the smallest id that is not null, or null where there is none; where texts differ under one id, groups may share it, but not ``component_fp``. Repeated rows give repeated rows. No other column is read.
    """
    rows = settled(fingerprints(docs, id_col, text_col, shingle, keep))
    n = rows.count()
    nodes = settled(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_rows")))
    # nodes are ordered by their smallest id, null last: a component's root then has its id, and nothing is dealt by component
    name = lambda side: F.struct(F.col(f"{side}.least").isNull().alias("unnamed"), F.col(f"{side}.least").alias("least"), F.col(f"{side}.fp").alias("fp"))
    links = close_links(nodes.select("fp"), max_bits, block_rows)
    ends = links.join(nodes.alias("x"), F.col("a") == F.col("x.fp")).join(nodes.alias("y"), F.col("b") == F.col("y.fp")).select(name("x").alias("a"), name("y").alias("b"))
    roots = components(ends).select(F.col("node.fp").alias("fp"), F.col("root.least").alias("found"), F.col("root.fp").alias("found_fp"), F.lit(True).alias("linked"))
    named = settled(nodes.join(roots, "fp", "left").select("fp", "n_rows", F.when(F.col("linked"), F.col("found")).otherwise(F.col("least")).alias("component_id"), F.coalesce("found_fp", "fp").alias("component_fp")))
    # fingerprints of a thousandth of all rows or more, a thousand at most, go to their rows; the others are joined by a shuffle
    hot = F.col("n_rows") * 1000 >= n
    out = ["doc_id", *keep, "fp", "component_id", "component_fp"]
    many = rows.join(F.broadcast(named.where(hot)), "fp").select(*out)
    few = rows.join(F.broadcast(named.where(hot).select("fp")), "fp", "left_anti").join(named.where(~hot), "fp").select(*out)
    return many.unionAll(few)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
