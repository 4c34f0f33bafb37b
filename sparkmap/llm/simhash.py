"""SimHash near-duplicates with vantage-point trees.

A 64-bit fingerprint has bit i set if more than half of the text's shingle
hashes have it.  Equal fingerprints are taken together first.  The distinct ones
are linked at a Hamming distance of `bits` or less:

1. a vantage-point tree is grown on a bounded sample (one fingerprint in eight
   at most): each node splits at a distance from its vantage point;
2. every fingerprint goes to its own shard (leaf) and, by the triangle bound, to
   each shard that its ball of radius `bits` reaches;
3. a shard finds its exact pairs with a tree of its own, grown the same way.

A shard larger than expected is dealt out as a grid of (part of its own
fingerprints) x (part of its visitors), so any shard is bounded in memory and
any cluster spreads.  Shards report a spanning forest of their links, never more
edges than they have fingerprints; components are found in Spark.

Defined cases: a text without words has fingerprint 0 and is linked like any
other; a null text has no words; a null doc_id is never a component_id unless
its component has no other; repeated rows are linked as copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from sparkmap.llm.common import free_name
from sparkmap.llm.components import components, forest
from sparkmap.session import materialize

SEED = 42
BITS = 2
SAMPLE_FINGERPRINTS = 1 << 17
LEAST_RATE = 8
SHARD = 1024
PART_OWN = 4096
PART_VISITORS = 1 << 16
LEAF = 64


def fingerprint_of(text: bytes | None, shingle: int = 3) -> int:
    """64 majority bits over the XXH64 of all shingles (repeats included) of a text's words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        # a shingle is a slice of the words joined by single blanks
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = (ends - [len(w) + 1 for w in words]).tolist()
        grams = [joined[s:e] for s, e in zip(starts, (ends[shingle - 1 :] - 1).tolist())]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(g, SEED) for g in grams), np.uint64, len(grams))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 4096):
        ones += np.unpackbits(h[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def _fingerprints(text: pd.Series, shingle: int) -> pd.Series:
    return pd.Series(np.array([fingerprint_of(t, shingle) for t in text], np.uint64).view(np.int64), dtype="int64")


def fingerprint(text: Column, shingle: int = 3) -> Column:
    """The fingerprint as a signed long."""

    def each(batch: pd.Series) -> pd.Series:
        return _fingerprints(batch, shingle)

    return F.pandas_udf(each, "long")(text.cast("binary"))


def distance(a, b):
    return np.bitwise_count(a ^ b)


def _split(rows: np.ndarray, rng, bits: int) -> tuple[np.uint64, int] | None:
    """A vantage point and a distance near the median that cuts through few rows; None if all are equally far."""
    best = None
    for v in rows[rng.integers(0, len(rows), 4)]:
        n = np.bincount(distance(rows, v), minlength=65)
        upto = np.cumsum(n) / len(rows)
        for d in np.flatnonzero((upto > 0.25) & (upto < 0.75)):
            torn = n[max(0, d - bits + 1) : d + bits + 1].sum() / len(rows) + abs(upto[d] - 0.5) / 4
            if best is None or torn < best[0]:
                best = (torn, v, int(d))
    return best and best[1:]


class Tree:
    """Vantage-point tree in arrays; a child below 0 is leaf number ~child."""

    def __init__(self, sample: np.ndarray, leaf: int, bits: int = BITS):
        self.bits, self.leaves = bits, 0
        self.point: list = []
        self.cut: list[int] = []
        self.child: list[list[int]] = []
        rng = np.random.default_rng(5)
        self.root = self._grow(np.sort(sample), leaf, rng)
        self.point = np.array(self.point, np.uint64)

    def _grow(self, rows: np.ndarray, leaf: int, rng) -> int:
        found = _split(rows, rng, self.bits) if len(rows) > leaf else None
        if found is None:
            self.leaves += 1
            return ~(self.leaves - 1)
        here = len(self.cut)
        self.point.append(found[0])
        self.cut.append(found[1])
        self.child.append([0, 0])
        near = distance(rows, found[0]) <= found[1]
        self.child[here][:] = [self._grow(rows[near], leaf, rng), self._grow(rows[~near], leaf, rng)]
        return here

    def route(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row number, leaf, own) for each leaf that the ball around a row reaches; own marks the one it lies in."""
        out = []
        todo = [(self.root, np.arange(len(rows)), np.ones(len(rows), bool))]
        while todo:
            node, at, own = todo.pop()
            if not len(at):
                continue
            if node < 0:
                out.append((at, np.full(len(at), ~node), own))
                continue
            d = distance(rows[at], self.point[node]).astype(int)
            cut = self.cut[node]
            for child, reaches, inside in zip(self.child[node], (d <= cut + self.bits, d > cut - self.bits), (d <= cut, d > cut)):
                todo.append((child, at[reaches], (own & inside)[reaches]))
        at, leaf, own = map(np.concatenate, zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool))
        return at, leaf, own


def pairs(own: np.ndarray, visitors: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) with own[i], visitors[j] at most `bits` apart; the tree grows as far as the cuts prune."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    rng = np.random.default_rng(9)
    todo = [(np.arange(len(own)), np.arange(len(visitors)))]
    while todo:
        a, b = todo.pop()
        if not len(a) or not len(b):
            continue
        split = _split(own[a], rng, bits) if len(a) > LEAF else None
        if split is None:
            step = max(1, (1 << 20) // len(a))
            for s in range(0, len(b), step):
                i, j = np.nonzero(distance(own[a][:, None], visitors[b[s : s + step]][None, :]) <= bits)
                found.append((a[i], b[s + j]))
            continue
        v, cut = split
        da, db = distance(own[a], v).astype(int), distance(visitors[b], v).astype(int)
        todo += [(a[da <= cut], b[db <= cut + bits]), (a[da > cut], b[db > cut - bits])]
    if not found:
        return np.zeros(0, int), np.zeros(0, int)
    return tuple(np.concatenate(x) for x in zip(*found))


def _links(group: pd.DataFrame, bits: int) -> pd.DataFrame:
    f, own = group["fp"].to_numpy().view(np.uint64), group["own"].to_numpy(bool)
    values = np.unique(f)
    at_own, at_visitor = np.searchsorted(values, f[own]), np.searchsorted(values, f[~own])
    i, j = pairs(values[at_own], values[at_visitor], bits)
    a, b = forest(at_own[i], at_visitor[j], len(values))
    return pd.DataFrame({"a": values[a].view(np.int64), "b": values[b].view(np.int64)})


def link(fingerprints: DataFrame, bits: int = BITS, shard: int = SHARD) -> DataFrame:
    """Edges (a, b) that connect the fingerprints `fp` (distinct) whose chains of links have at most `bits` a step."""
    n = fingerprints.count()
    rate = max(LEAST_RATE, -(-n // SAMPLE_FINGERPRINTS))
    sample = fingerprints.where(F.pmod(F.xxhash64("fp"), F.lit(rate)) == 0).toPandas()["fp"].to_numpy(np.int64)
    tree = Tree(sample.view(np.uint64), max(8, shard // rate), bits)

    def routed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = b["fp"].to_numpy(np.int64)
            at, leaf, own = tree.route(fp.view(np.uint64))
            yield pd.DataFrame({"shard": leaf, "fp": fp[at], "own": own})

    visits = fingerprints.select("fp").mapInPandas(routed, "shard int, fp long, own boolean")
    # one row for each leaf of the tree, which has SAMPLE_FINGERPRINTS / 8 at most
    sizes = visits.groupBy("shard").agg(F.sum(F.col("own").cast("long")).alias("n_own"), F.count(F.lit(1)).alias("n_all"))
    parts = sizes.select(
        "shard",
        F.ceil(F.greatest("n_own", F.lit(1)) / PART_OWN).cast("int").alias("own_parts"),
        F.ceil(F.col("n_all") / PART_VISITORS).cast("int").alias("visitor_parts"),
    )
    part = lambda of: F.pmod(F.xxhash64("fp", F.lit("part")), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    met = visits.join(F.broadcast(parts), "shard")
    own = met.where("own").select("shard", "fp", "own", part("own_parts").alias("o"), every("visitor_parts").alias("v"))
    visitors = met.select("shard", "fp", F.lit(False).alias("own"), part("visitor_parts").alias("v"), every("own_parts").alias("o"))

    def linked(group: pd.DataFrame) -> pd.DataFrame:
        return _links(group, bits)

    return own.unionByName(visitors).groupBy("shard", "o", "v").applyInPandas(linked, "a long, b long")


def near_duplicates(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """fp, root, component_id: a name of its component and the least doc_id of all documents in it, for each
    distinct fingerprint of `prints` (doc_id, fp)."""
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = materialize(components(link(distinct, bits)), "roots")
    placed = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return placed.join(least, "root").select("fp", "root", "component_id")


def cluster(docs: DataFrame, bits: int = BITS, shingle: int = 3) -> DataFrame:
    """doc_id, fp, component_id: one row per row of `docs`."""
    prints = materialize(docs.select("doc_id", fingerprint(F.col("text"), shingle).alias("fp")), "fingerprints")
    return prints.join(near_duplicates(prints, bits).drop("root"), "fp")


def one_of_each(docs: DataFrame, bits: int = BITS, shingle: int = 3) -> DataFrame:
    """`docs` without all but one row of each component: its least doc_id (a null one last), among equal ids the first row read."""
    fp, row = free_name(docs, "fp__"), free_name(docs, "row__")
    marked = materialize(
        docs.withColumns({fp: fingerprint(F.col("text"), shingle), row: F.monotonically_increasing_id()}), "marked"
    )
    prints = marked.select("doc_id", F.col(fp).alias("fp"), F.col(row).alias("row"))
    found = near_duplicates(prints.select("doc_id", "fp"), bits).withColumnRenamed("fp", "fp_of")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    by_fp = prints.groupBy("fp").agg(first)
    kept = (
        by_fp.join(found, by_fp["fp"] == found["fp_of"])
        .groupBy("root").agg(F.min("first").alias("first"))
        .select(F.col("first.row").alias("kept__"))
    )
    return marked.join(kept, marked[row] == kept["kept__"], "left_semi").drop(fp, row)
