"""Embedding near-duplicates by dual traversal of cover trees.

Vectors are compared on the unit sphere, where cosine >= threshold means a
distance of at most t = sqrt(2 - 2 * threshold).  A cover tree has nested levels
with halving radii: each centre of a level lies within that level's radius of a
centre above.  Two nodes can hold a linked pair only if the distance of their
centres is at most t plus both covering radii; all other node pairs are pruned
with everything below them.

Upper levels: centres come from a bounded sample (one vector in eight at most);
every vector descends to its nearest one, and covering radii are the true maxima
over all vectors.  Neighbouring leaves make up chunks of about equal size, and a
large leaf is split into several.  The dual traversal of the upper levels gives
the chunk pairs that are left.
Lower levels: each chunk is covered by groups of a quarter and half that radius;
a chunk pair is one task, which prunes group pairs by the same bound and
compares what is left in double precision.

Equal vectors are taken together first, with their number.  A task returns how
many vectors each vector links with and a spanning forest of the links, so a
dense cluster of any size costs no more rows than it has vectors.

Defined cases: a vector that is null, empty or zero, or has null or non-finite
components, links with nothing; vectors of different lengths never link;
repeated rows are copies and link; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from sparkmap.llm.components import components, forest
from sparkmap.session import materialize

THRESHOLD = 0.9
LEVELS = (1.0, 0.5)
GROUP_RADII = (0.25, 0.125)
SAMPLE_VECTORS = 2048
LEAST_RATE = 8
CHUNK = 2048
MOST_CHUNKS = 1024
MARGIN = 1e-9


def unit(x: np.ndarray) -> np.ndarray:
    # halved exponents first, so that the squares of very large or small components stay finite
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between unit vectors."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def cover(x: np.ndarray, radius: float) -> np.ndarray:
    """For each row the row number of its centre: a row no centre is within `radius` of becomes one."""
    centre = np.full(len(x), -1)
    while len(left := np.flatnonzero(centre < 0)):
        # rows of one stretch see each other in one product; the first uncovered row opens a centre
        stretch = left[:512]
        d = apart(x[stretch], x[left])
        for k, i in enumerate(stretch):
            if centre[i] < 0:
                new = left[d[k] <= radius]
                centre[new[centre[new] < 0]] = i
                centre[i] = i
    return centre


class Top:
    """The upper levels: leaf centres in an order that keeps the children of a node together."""

    def __init__(self, sample: np.ndarray):
        above = cover(sample, LEVELS[0])
        leaves: list[int] = []
        parents: list[int] = []
        for c in np.unique(above):
            inside = np.flatnonzero(above == c)
            below = np.unique(cover(sample[inside], LEVELS[1]))
            leaves += inside[below].tolist()
            parents += [len(set(parents))] * len(below)
        self.centres, self.parent = sample[leaves], np.array(parents, int)

    def descend(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest leaf and the distance to its centre."""
        leaf, d = np.zeros(len(x), int), np.zeros(len(x))
        for i in range(0, len(x), 4096):
            far = apart(x[i : i + 4096], self.centres)
            leaf[i : i + 4096] = far.argmin(1)
            d[i : i + 4096] = far.min(1)
        return leaf, d

    def pairs(self, radius: np.ndarray, t: float) -> np.ndarray:
        """Which pairs of leaves a dual traversal from the root leaves over (a symmetric matrix)."""
        tops = int(self.parent.max()) + 1
        first = np.array([np.flatnonzero(self.parent == p)[0] for p in range(tops)])
        to_top = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (self.centres * self.centres[first][self.parent]).sum(1)))
        top_radius = np.zeros(tops)
        np.maximum.at(top_radius, self.parent, to_top + radius)
        heads = self.centres[first]
        open_ = apart(heads, heads) <= top_radius[:, None] + top_radius[None, :] + t + MARGIN
        close = apart(self.centres, self.centres) <= radius[:, None] + radius[None, :] + t + MARGIN
        return close & open_[np.ix_(self.parent, self.parent)]


def chunks(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first chunk, number of chunks) of each leaf: neighbours share a chunk, a large leaf has several."""
    first, parts = np.zeros(len(counts), int), np.ones(len(counts), int)
    chunk, held = 0, 0
    for i, n in enumerate(counts):
        if n > size:
            chunk += held > 0
            first[i], parts[i] = chunk, -(-n // size)
            chunk, held = chunk + parts[i], 0
            continue
        if held + n > size:
            chunk, held = chunk + 1, 0
        first[i], held = chunk, held + n
    return first, parts


def _grouped(rows: pd.DataFrame) -> pd.DataFrame:
    """A chunk's rows with the group they are in: covered at the wider radius, then each wide group at the narrower."""
    x = unit(np.stack(rows["vec"].to_numpy()).astype(float))
    centre = np.zeros(len(x), int)
    for s in range(0, len(x), CHUNK):
        part = np.arange(s, min(len(x), s + CHUNK))
        wide = cover(x[part], GROUP_RADII[0])
        for c in np.unique(wide):
            inside = part[wide == c]
            centre[inside] = inside[cover(x[inside], GROUP_RADII[1])] if len(inside) > 1 else inside
    return rows.assign(grp=np.unique(centre, return_inverse=True)[1].astype(np.int32), lead=centre == np.arange(len(x)))


class _Side:
    def __init__(self, rows: pd.DataFrame):
        rows = rows.sort_values(["grp", "lead"], ascending=[True, False], kind="stable")
        self.x = unit(np.stack(rows["vec"].to_numpy()).astype(float))
        self.node, self.times = rows["node"].to_numpy(), rows["times"].to_numpy()
        self.first = np.flatnonzero(np.diff(rows["grp"].to_numpy(), prepend=-1))
        self.end = np.append(self.first[1:], len(rows))
        own = np.repeat(self.first, self.end - self.first)
        d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (self.x * self.x[own]).sum(1)))
        self.radius = np.maximum.reduceat(d, self.first)


def block(a: _Side, b: _Side, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) with cosine of a.x[i] and b.x[j] >= threshold, by groups whose bounds allow it."""
    t = np.sqrt(max(0.0, 2.0 - 2.0 * threshold)) + MARGIN
    out_i, out_j = [np.zeros(0, int)], [np.zeros(0, int)]
    heads_b = b.x[b.first]
    for s in range(0, len(a.first), 1024):
        part = slice(s, s + 1024)
        near = apart(a.x[a.first[part]], heads_b) <= a.radius[part][:, None] + b.radius[None, :] + t
        for g, row in zip(range(s, s + len(near)), near):
            groups = np.flatnonzero(row)
            if not len(groups):
                continue
            members = np.concatenate([np.arange(b.first[k], b.end[k]) for k in groups])
            own = np.arange(a.first[g], a.end[g])
            cos = a.x[own] @ b.x[members].T
            i, j = np.nonzero(cos >= threshold - MARGIN)
            i, j, c = own[i], members[j], cos[i, j]
            edge = np.abs(c - threshold) < 2 * MARGIN
            if edge.any():  # as near as this, one way of summing decides for every block
                c[edge] = [float(np.sum(a.x[p] * b.x[q])) for p, q in zip(i[edge], j[edge])]
            out_i.append(i[c >= threshold])
            out_j.append(j[c >= threshold])
    return np.concatenate(out_i), np.concatenate(out_j)


def _links(rows: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """node, root, links: the forest's edges (links 0) and for each node of a link how many vectors it meets here."""
    left, right = _Side(rows[rows["side"] == 0]), rows[rows["side"] == 1]
    same = not len(right)
    right = left if same else _Side(right)
    i, j = block(left, right, threshold)
    if same:
        i, j = i[i != j], j[i != j]
    nodes = left.node if same else np.concatenate([left.node, right.node])
    at = j if same else j + len(left.node)
    links = np.zeros(len(nodes), np.int64)
    np.add.at(links, i, right.times[j])
    if not same:
        np.add.at(links, at, left.times[i])
    a, root = forest(i, at, len(nodes))
    met = np.flatnonzero(links)
    return pd.DataFrame(
        {
            "node": np.concatenate([nodes[a], nodes[met]]),
            "root": np.concatenate([nodes[root], nodes[met]]),
            "links": np.concatenate([np.zeros(len(a), np.int64), links[met]]),
        }
    )


def usable(v: Column) -> Column:
    """Not null, not empty, not zero, all components finite."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, finite) & F.exists(v, lambda c: c != 0)


def _chunk_links(classes: DataFrame, n: int, threshold: float) -> DataFrame:
    """node, root, links over the distinct vectors (node, times, vec) of one length."""
    rate = max(LEAST_RATE, -(-n // SAMPLE_VECTORS))
    drawn = classes.where(F.pmod(F.xxhash64("node"), F.lit(rate)) == 0).select("vec").toPandas()["vec"]
    if not len(drawn):
        drawn = classes.select("vec").limit(1).toPandas()["vec"]
    top = Top(unit(np.stack(drawn.to_numpy()).astype(float)))

    def descended(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                leaf, d = top.descend(unit(np.stack(b["vec"].to_numpy()).astype(float)))
                yield b.assign(leaf=leaf.astype(np.int32), d=d)

    kind = classes.schema["vec"].dataType.simpleString()
    placed = materialize(classes.mapInPandas(descended, f"node string, times long, vec {kind}, leaf int, d double"), "placed")
    counts, radius = np.zeros(len(top.centres), np.int64), np.zeros(len(top.centres))
    for r in placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("d")).collect():  # one row a centre
        counts[r["leaf"]], radius[r["leaf"]] = r["n"], r["d"]
    first, parts = chunks(counts, max(CHUNK, -(-n // MOST_CHUNKS)))
    total = int((first + parts).max())
    open_ = top.pairs(radius, np.sqrt(max(0.0, 2.0 - 2.0 * threshold)))
    open_ &= (counts > 0)[:, None] & (counts > 0)[None, :]
    meets = np.zeros((total, total), bool)
    a, b = np.nonzero(open_)
    meets[first[a], first[b]] = True
    for leaf in np.flatnonzero(parts > 1):  # all its chunks meet what the leaf meets
        own = slice(first[leaf], first[leaf] + parts[leaf])
        meets[own] |= meets[first[leaf]]
        meets[:, own] |= meets[:, [first[leaf]]]
    meets |= meets.T
    session = classes.sparkSession
    # at most one row for each centre, and MOST_CHUNKS^2 / 2 pairs of small numbers
    leaf_table = session.createDataFrame([(i, int(first[i]), int(parts[i])) for i in range(len(first))], "leaf int, first int, parts int")
    partners = session.createDataFrame(
        [(c, sorted((min(c, int(o)), max(c, int(o))) for o in np.flatnonzero(meets[c]))) for c in range(total)],
        "chunk int, pairs array<struct<a:int,b:int>>",
    )
    chunk = F.col("first") + F.pmod(F.xxhash64("node", F.lit("chunk")), F.col("parts")).cast("int")
    dealt = placed.join(F.broadcast(leaf_table), "leaf").select("node", "times", "vec", chunk.alias("chunk"))

    def grouped(rows: pd.DataFrame) -> pd.DataFrame:
        return _grouped(rows)

    fields = f"node string, times long, vec {kind}, chunk int, grp int, lead boolean"
    trees = materialize(dealt.groupBy("chunk").applyInPandas(grouped, fields), "trees")
    met = trees.join(F.broadcast(partners), "chunk").withColumn("pair", F.explode("pairs")).select(
        "node", "times", "vec", "grp", "lead", "pair.a", "pair.b", F.when(F.col("chunk") == F.col("pair.a"), 0).otherwise(1).alias("side")
    )

    def linked(rows: pd.DataFrame) -> pd.DataFrame:
        return _links(rows, threshold)

    return met.groupBy("a", "b").applyInPandas(linked, "node string, root string, links long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of `vectors` (vec_id, embedding)."""
    v = F.col("embedding")
    node = F.when(usable(v), F.md5(F.concat_ws(",", v.cast("array<string>"))))
    base = materialize(vectors.select("vec_id", node.alias("node"), v.alias("vec")), "vectors")
    classes = base.where("node IS NOT NULL").groupBy("node").agg(
        F.count(F.lit(1)).alias("times"), F.first("vec").alias("vec"), F.min("vec_id").alias("least")
    )
    classes = materialize(classes, "classes")
    found = None
    sizes = classes.groupBy(F.size("vec").alias("length")).agg(F.count(F.lit(1)).alias("n")).collect()  # one row a length
    for r in sorted(sizes, key=lambda r: r["length"]):
        part = _chunk_links(classes.where(F.size("vec") == r["length"]).select("node", "times", "vec"), r["n"], threshold)
        found = part if found is None else found.union(part)
    if found is None:
        return base.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = materialize(found, "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    joined = classes.select("node", "times", "least").join(links, "node", "left").join(roots, "node", "left")
    joined = joined.select(
        "node", "least", (F.col("times") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root")
    )
    least = joined.groupBy("root").agg(F.min("least").alias("component"))
    known = joined.join(least, "root").select("node", "n_links", "component")
    return base.select("vec_id", "node").join(known, "node", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
