"""Seeded resamples of paired deltas, laid out in blocks of draws.

A task holds a block of draws for a bundle of cells.  It makes the draws once
and multiplies them with the deltas of all its cells, so their cost does not
grow with the number of cells.  One rule holds for cells of every size:

sign flip   the sign of a patient in draw d is bit d mod 128 (of 16 bytes, the
            least significant bit of the first byte first) of
            md5(seed | d div 128 | patient)
bootstrap   slot j of resample d takes the delta of rank r mod n (ascending,
            0-based), r being the (j mod 4)-th little-endian 32-bit number of
            md5(seed | d | j div 4)

Because the bootstrap picks ranks, a draw's median is the delta at the middle of
the picked ranks, which are the same for all cells of one size: no values are
sorted per draw.

A cell of any size is dealt out in chunks (patients by hash, ranks by range); a
chunk sends one vector of partial sums for each block, and these are added up in
a stream.  What grows in a task is the number of draws, which is a parameter.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sparkmap.functions.tails import tail_interval
from sparkmap.operators.ordering import positions

CHUNK = 1 << 16  # deltas of a cell in one array
BUNDLE = 1 << 18  # deltas that share a task, on average
BITS = 128
VECTOR = 2048  # draws in one vector that is sent on
NUMBERS = 1 << 21  # numbers a task holds at a time


def _tasks(df: DataFrame) -> int:
    """Tasks for work that is large although its input is small.

    A fixed number, because AQE would merge the few input bytes into one task.
    """
    return 4 * df.sparkSession.sparkContext.defaultParallelism


def _blocks(df: DataFrame, dealt: DataFrame, draws: int) -> DataFrame:
    """One row for each (bundle, chunk) and block of draws: `block` (its first draw), `size`, `cells`.

    `dealt` holds the columns of a cell's chunk: `chunk`, `cell` (a struct of what a task needs of it).
    """
    tasks = _tasks(df)
    bundles = max(1, -(-df.count() // BUNDLE))
    step = max(VECTOR, -(-draws // tasks // VECTOR) * VECTOR)
    together = dealt.groupBy(F.pmod(F.xxhash64("cell.key"), F.lit(bundles)).alias("bundle"), "chunk").agg(F.collect_list("cell").alias("cells"))
    return (
        together.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(draws - 1).cast("long"), F.lit(step).cast("long"))))
        .repartition(tasks, "bundle", "chunk", "block")
        .select("block", F.least(F.lit(step), F.lit(draws) - F.col("block")).alias("size"), "chunk", "cells")
    )


def _present(deltas: DataFrame, keys: Sequence[str]) -> DataFrame:
    return deltas.where("delta IS NOT NULL").select(F.struct(*keys).alias("key"), "subject", "delta")


def _key_type(df: DataFrame) -> str:
    return df.schema["key"].dataType.simpleString()


def _signs(seed: int, words: range, subjects: Sequence[str]) -> np.ndarray:
    """The bits of each patient in the draws of the given words, packed: [patient, 16 bytes a word]."""
    heads = [b"%d|%d|" % (seed, w) for w in words]
    raw = b"".join([md5(h + s.encode()).digest() for s in subjects for h in heads])
    return np.frombuffer(raw, np.uint8).reshape(len(subjects), -1)


def _flipped(seed: int, first: int, size: int, groups: dict[tuple, np.ndarray]) -> Iterator[tuple[int, dict[tuple, np.ndarray]]]:
    """For stretches of draws: sums of the deltas under their signs, [cell, draw], for each list of patients."""
    subjects = sorted(set().union(*groups))
    row = {s: i for i, s in enumerate(subjects)}
    for start in range(first, first + size, VECTOR):
        n = min(VECTOR, first + size - start)
        packed = _signs(seed, range(start // BITS, (start + n - 1) // BITS + 1), subjects)
        sums = {}
        for patients, values in groups.items():
            total = np.zeros((len(values), n))
            at = np.array([row[s] for s in patients])
            step = max(1, NUMBERS // VECTOR)
            for k in range(0, len(at), step):
                bits = np.unpackbits(packed[at[k : k + step]], axis=1, bitorder="little")[:, :n]
                total += values[:, k : k + step] @ (1.0 - 2.0 * bits)
            sums[patients] = total
        yield start, sums


def signflip_mc(deltas: DataFrame, draws: int = 10_000_000, seed: int = 20260927, keys: Sequence[str] = ()) -> DataFrame:
    """Two-sided Monte-Carlo sign flip: p = (extreme + 1) / (draws + 1), with its exact interval.

    A draw is extreme if its absolute mean reaches the observed one, less 1e-15 and the rounding of the sums.
    """
    keys = list(keys)
    d = _present(deltas, keys)
    whole = d.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"),
        (F.abs(F.sum("delta")) / F.count(F.lit(1)) - F.lit(1e-15) - F.sum(F.abs("delta")) * F.lit(2.0**-52)).alias("bar"),
    )
    chunks = F.ceil(F.col("n") / F.lit(CHUNK))
    dealt = (
        d.join(whole, "key")
        .groupBy("key", "n", "bar", F.pmod(F.xxhash64("subject"), chunks).alias("chunk"))
        .agg(F.array_sort(F.collect_list(F.struct("subject", "delta"))).alias("s"))
        .select("chunk", F.struct("key", "n", "bar", F.col("s.subject").alias("subjects"), F.col("s.delta").alias("deltas")).alias("cell"))
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                groups: dict[tuple, list] = {}
                for cell in r.cells:
                    groups.setdefault(tuple(cell["subjects"]), []).append(cell)
                arrays = {s: np.array([list(c["deltas"]) for c in cells]) for s, cells in groups.items()}
                hits = {s: np.zeros(len(cells), np.int64) for s, cells in groups.items()}
                parts = []
                for start, sums in _flipped(seed, r.block, r.size, arrays):
                    for s, total in sums.items():
                        for i, cell in enumerate(groups[s]):
                            if len(s) == cell["n"]:
                                hits[s][i] += int((np.abs(total[i]) / cell["n"] >= cell["bar"]).sum())
                            else:
                                parts.append((cell["key"], cell["n"], cell["bar"], start, r.chunk, 0, total[i]))
                done = [(c["key"], c["n"], c["bar"], r.block, 0, h, None) for s, cells in groups.items() if len(s) == cells[0]["n"] for c, h in zip(cells, hits[s])]
                yield pd.DataFrame(done + parts, columns=["key", "n", "bar", "block", "chunk", "hits", "part"])

    sent = _blocks(d, dealt, draws).mapInPandas(run, f"key {_key_type(d)}, n long, bar double, block long, chunk long, hits long, part array<double>")

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Hits of whole cells as they are; partial sums of a block are added up over its chunks first."""
        now, total = None, np.zeros(0)

        def closed() -> pd.DataFrame:
            key, n, bar, _ = now
            return pd.DataFrame([(key, int((np.abs(total) / n >= bar).sum()))], columns=["key", "hits"])

        for frame in frames:
            kept = frame["part"].isna()
            yield frame.loc[kept, ["key", "hits"]]
            for r in frame[~kept].itertuples(index=False):
                if now is None or (r.key, r.block) != (now[0], now[3]):
                    if now is not None:
                        yield closed()
                    now, total = (r.key, r.n, r.bar, r.block), np.zeros(len(r.part))
                total = total + r.part
        if now is not None:
            yield closed()

    hits = (
        sent.repartition("key", "block").sortWithinPartitions("key", "block", "chunk")
        .mapInPandas(add, f"key {_key_type(d)}, hits long").groupBy("key").agg(F.sum("hits").alias("n_extreme"))
    )
    return with_interval(hits.select("key.*", "n_extreme"), draws)


def with_interval(hits: DataFrame, draws: int) -> DataFrame:
    """The p of `n_extreme` hits among so many draws, and the exact interval of the tail."""
    low, high = tail_interval(F.col("n_extreme"), F.lit(draws).cast("bigint"))
    return hits.withColumn("n_draws", F.lit(draws).cast("bigint")).withColumns(
        {"p_mc": (F.col("n_extreme") + 1) / F.lit(draws + 1.0), "mc_ci_low": low, "mc_ci_high": high}
    )


def _ranks(seed: int, draws: range, n: int) -> np.ndarray:
    """The 32-bit numbers of n slots in each draw."""
    raw = b"".join([md5(b"%d|%d|%d" % (seed, d, j)).digest() for d in draws for j in range(-(-n // 4))])
    return np.frombuffer(raw, "<u4").reshape(len(draws), -1)


def bootstrap_ci(deltas: DataFrame, draws: int = 200_000, seed: int = 20260928, keys: Sequence[str] = ()) -> DataFrame:
    """95 % percentile intervals of the mean (`ci_*`) and of the median (`median_*`) of resamples."""
    keys = list(keys)
    d = _present(deltas, keys)
    ranked = positions(d, ["key"], ["delta", "subject"]).withColumn("chunk", F.floor(F.col("pos") / F.lit(CHUNK)))
    dealt = (
        ranked.groupBy("key", F.col("total").alias("n"), "chunk")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "delta"))).alias("s"))
        .select("chunk", F.struct("key", "n", F.col("s.delta").alias("deltas")).alias("cell"))
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                groups: dict[int, list] = {}
                for cell in r.cells:
                    groups.setdefault(cell["n"], []).append(cell)
                arrays = {n: np.array([list(c["deltas"]) for c in cells]) for n, cells in groups.items()}
                most, low = max(groups), r.chunk * CHUNK
                step = max(1, min(VECTOR, NUMBERS // most))
                for start in range(r.block, r.block + r.size, VECTOR):
                    vectors: dict[int, list] = {n: [] for n in groups}
                    for s in range(start, min(start + VECTOR, r.block + r.size), step):
                        numbers = _ranks(seed, range(s, min(s + step, start + VECTOR, r.block + r.size)), most)
                        for n, values in arrays.items():
                            vectors[n].append(_picked(numbers[:, :n] % n, values, low, n))
                    rows = []
                    for n, cells in groups.items():
                        mean, middle = (np.concatenate(v, axis=1) for v in zip(*vectors[n]))
                        rows += [(c["key"], start, r.chunk, m, k) for c, m, k in zip(cells, mean, middle)]
                    yield pd.DataFrame(rows, columns=["key", "block", "chunk", "mean", "middle"])

    sent = _blocks(d, dealt, draws).mapInPandas(run, f"key {_key_type(d)}, block long, chunk long, mean array<double>, middle array<double>")

    def quantiles(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Adds up the chunks of a block and takes the quantiles of a cell's draws."""
        key, block, done = None, None, []

        def closed() -> pd.DataFrame:
            mean, middle = (np.quantile(np.concatenate(v), (0.025, 0.975)) for v in zip(*done))
            return pd.DataFrame([(key, *mean, *middle)], columns=["key", "ci_low", "ci_high", "median_low", "median_high"])

        for frame in frames:
            for r in frame.itertuples(index=False):
                if r.key != key:
                    if done:
                        yield closed()
                    key, block, done = r.key, None, []
                if r.block == block:
                    done[-1] = (done[-1][0] + r.mean, done[-1][1] + r.middle)
                else:
                    done.append((r.mean, r.middle))
                    block = r.block
        if done:
            yield closed()

    found = (
        sent.repartition("key").sortWithinPartitions("key", "block", "chunk")
        .mapInPandas(quantiles, f"key {_key_type(d)}, ci_low double, ci_high double, median_low double, median_high double")
    )
    return found.select("key.*", "ci_low", "ci_high", "median_low", "median_high")


def _picked(ranks: np.ndarray, values: np.ndarray, low: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """What a chunk of ranks from `low` on adds to the mean and to the median of each draw: two of [cell, draw]."""
    draws, width = len(ranks), values.shape[1]
    here = (ranks >= low) & (ranks < low + width)
    flat = (np.arange(draws)[:, None] * width + (ranks.astype(np.int64) - low))[here]
    counts = np.bincount(flat, minlength=draws * width).reshape(draws, width)
    middle = np.zeros((len(values), draws))
    lower, upper = (n - 1) // 2, n // 2
    halves = np.partition(ranks, (lower, upper), axis=1)
    for k in (lower, upper):
        at = halves[:, k].astype(np.int64) - low
        inside = (at >= 0) & (at < width)
        middle[:, inside] += values[:, at[inside]] / 2
    return values @ counts.T / n, middle
