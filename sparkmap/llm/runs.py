"""Periodic runs of words by block convolution.

A run is a stretch of words with smallest period q, of at least max(24, 3 q)
words, that no neighbouring word extends.  At each scale B = 8, 16, 32, ... the
words are cut into blocks of B.  A run with B <= q < 2 B holds a whole block and
that block's copy q words on (3 q >= 2 B - 1 + q; the blocks of 8 serve all
q < 16, for which 24 words do).  So the places where a block fits the window of
the distances from B to 2 B - 1 behind it, without a mismatch, hold every period
of that scale.

A block's squared differences to all places of its window are
sum x^2 + sum y^2 - 2 sum x y; the last sum is a correlation, taken by a number
theoretic transform modulo 65537, whose roots of unity reach every size needed.
The transform of a size n1 x n2 is two products with matrices of roots and one
with twiddle factors; all sums stay below 2^53, so doubles carry them exactly.
A sum of zero modulo 65537 gives a distance, which is tried word by word: the
stretch with that distance is extended in both directions, and its distance is
its smallest period unless a prime fraction of it is a period as well.

A block that holds a word not found again within 2 B words has no such copy and
is left out of the convolution.  Blocks over 4,096 words are sought by their
first 4,096, in windows cut to that size, so memory does not follow the period.

Documents of an Arrow batch are laid end to end, up to 2^17 words at a time
(one longer document alone), each with word numbers of its own.

Defined cases: a null text has no words, no runs and an empty rest, as have empty
and blank texts; repeated rows are worked off each for itself; an empty table
gives no rows; `detect` keeps all columns of its input and refuses names that
clash with its two new ones.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from sparkmap.llm.common import free_name

LEAST_WORDS = 24
LEAST_TIMES = 3
BASE = 8
LONGEST_BLOCK = 4096
AT_ONCE = 1 << 17
P = 65537.0  # 2^16 + 1, prime; 3 generates all its units
NONE = np.int64(1 << 60)


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo P for whole numbers below 2^53; a multiple of P may come out as P instead of 0."""
    return x - P * np.floor(x * (1.0 / P))


@lru_cache(maxsize=64)
def _roots(size: int, inverse: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matrices of roots for rows and columns, and the twiddle factors between them."""
    root = pow(3, 65536 // size, 65537)
    power = np.ones(size, np.int64)
    for i in range(1, size):
        power[i] = power[i - 1] * root % 65537
    n1 = 1 << ((size.bit_length() - 1) // 2)
    n2 = size // n1
    sign = -1 if inverse else 1
    grid = lambda a, b, step: power[(sign * step * np.outer(np.arange(a), np.arange(b))) % size].astype(np.float64)
    return grid(n1, n1, n2), grid(n1, n2, 1), grid(n2, n2, n1)


def _transform(x: np.ndarray, size: int, inverse: bool = False) -> np.ndarray:
    """Transforms of rows x (shorter ones count as filled up with 0): [rows, n1, n2], place k1 + n1 k2."""
    across, twiddle, along = _roots(size, inverse)
    n2 = along.shape[0]
    x = x.reshape(len(x), -1, n2)
    return _mod(_mod(_mod(across[:, : x.shape[1]] @ x) * twiddle) @ along)


def correlate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """sum_k x[r, k] y[r, s + k] modulo P for s below half the length of the rows of y.

    x has half their length; entries are whole numbers from 0 to P.
    """
    size = y.shape[1]
    product = _mod(_transform(x, size, inverse=True) * _transform(y, size))
    across, twiddle, along = _roots(size, True)
    half = across.shape[0] // 2
    back = _mod(across[:half] @ _mod(_mod(product @ along) * twiddle)).reshape(len(x), -1)
    return np.round(back).astype(np.int64) * pow(size, -1, 65537) % 65537


def _next_distance(ids: np.ndarray) -> np.ndarray:
    """How far on each word is found again."""
    order = np.argsort(ids, kind="stable")
    out = np.full(len(ids), NONE)
    same = ids[order[1:]] == ids[order[:-1]]
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


def _copies(ids: np.ndarray, code: np.ndarray, squares: np.ndarray, at: np.ndarray, block: int, first: int, shifts: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of the blocks at `at` whose differences to the words `distance` on sum up to 0,
    for distances from `first` on, `shifts` of them."""
    size = 2 * shifts
    places, distances = [], []
    step = max(1, (1 << 20) // size)
    for k in range(0, len(at), step):
        here = at[k : k + step, None]
        x = np.zeros((len(here), shifts))
        x[:, :block] = code[here + np.arange(block)]
        y = code[here + first + np.arange(size)]
        s = np.arange(shifts)
        sums = (squares[here + block] - squares[here]) + (squares[here + first + s + block] - squares[here + first + s])
        r, s = np.nonzero((sums - 2 * correlate(x, y)) % 65537 == 0)
        i, d = at[k + r], first + s
        far = (d > 0) & (i + d + block <= len(ids))
        i, d = i[far], d[far]
        for j in (0, block // 2, block - 1):  # most false ones differ here
            ok = ids[i + j] == ids[i + d + j]
            i, d = i[ok], d[ok]
        places.append(i)
        distances.append(d)
    return (np.concatenate(places), np.concatenate(distances)) if places else (at[:0], at[:0])


def _same(ids: np.ndarray, a: int, b: int, step: int) -> int:
    """How many words from a and b on (a < b; backwards where step is -1) are equal."""
    left = len(ids) - b if step > 0 else a + 1
    done, stretch = 0, 64
    while done < left:
        n = min(stretch, left - done)
        lo, hi = (a + done, b + done) if step > 0 else (a - done - n + 1, b - done - n + 1)
        differ = (ids[lo : lo + n] != ids[hi : hi + n])[::step]
        k = int(differ.argmax())
        if differ[k]:
            return done + k
        done, stretch = done + n, stretch * 2
    return left


def _primes(n: int) -> Iterator[int]:
    p = 2
    while p * p <= n:
        if n % p == 0:
            yield p
            while n % p == 0:
                n //= p
        p += 1
    if n > 1:
        yield n


def _smallest(ids: np.ndarray, start: int, period: int) -> bool:
    """Whether no proper fraction of `period` is a period of the stretch (of at least three periods) from `start`."""
    for p in _primes(period):
        q = period // p
        if (ids[start : start + 2 * period - q] == ids[start + q : start + 2 * period]).all():
            return False
    return True


def _outside(i: np.ndarray, d: np.ndarray, block: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which candidates (sorted by place) lie in no run whose period divides their distance."""
    keep = np.ones(len(i), bool)
    for s, e, q in found:
        if e - s >= block + q:
            lo, hi = np.searchsorted(i, (s, e))
            keep[lo:hi] &= (i[lo:hi] + d[lo:hi] + block > e) | (d[lo:hi] % q != 0)
    return keep


def find(ids: np.ndarray, longest: int | None = None) -> list[tuple[int, int, int]]:
    """All runs (start, end, period) of a sequence of word numbers, by start and period.

    `longest`: no run is longer than this (the longest document of a batch).
    """
    n, found = len(ids), []
    if n < LEAST_WORDS:
        return found
    gap = _next_distance(ids)
    code = np.concatenate([(ids * 40503 + 17) % 65537, np.zeros(2 * LONGEST_BLOCK + 2, np.int64)])
    squares = np.concatenate([[0], np.cumsum(code * code % 65537)])
    code = code.astype(np.float64)
    block = BASE
    while (3 * block if block > BASE else LEAST_WORDS) <= (longest or n):
        part = min(block, LONGEST_BLOCK)
        whole = np.full(-(-n // block) * block, NONE)
        whole[:n] = gap
        at = np.flatnonzero(whole.reshape(-1, block)[:, :part].max(1) < 2 * block) * block
        if len(at):
            if block == BASE:
                i, d = _copies(ids, code, squares, at, block, 0, 2 * block)
            else:
                cut = [
                    _copies(ids, code, squares, at[at + first < n], part, first, part) for first in range(block, 2 * block, part)
                ]
                i, d = (np.concatenate(c) for c in zip(*cut))
            order = np.argsort(i, kind="stable")
            i, d = i[order], d[order]
            keep = _outside(i, d, part, found)
            i, d = i[keep], d[keep]
            last, until = 0, 0
            for k in np.lexsort((i, d)):
                place, period = int(i[k]), int(d[k])
                if period == last and place < until:
                    continue
                end = place + period + _same(ids, place, place + period, 1)
                start = place - (_same(ids, place - 1, place + period - 1, -1) if place else 0)
                last, until = period, end - period
                if end - start >= max(LEAST_WORDS, LEAST_TIMES * period) and _smallest(ids, start, period):
                    found.append((start, end, period))
        block *= 2
    return sorted(set(found), key=lambda r: (r[0], r[2]))


def _rest(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words but those behind the first period of a run."""
    edges = np.zeros(len(words) + 1, np.int64)
    for s, e, q in runs:
        edges[s + q] += 1
        edges[e] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0)])


def _of(texts: list[list[bytes]]) -> Iterator[tuple[list[tuple[int, int, int]], bytes]]:
    """Runs and rest of each document, given as lists of words."""
    number: dict = defaultdict(count().__next__)
    ids = [np.fromiter(map(number.__getitem__, words), np.int64, len(words)) for words in texts]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
    every = np.concatenate([x + k * len(number) for k, x in enumerate(ids)]) if ids else np.zeros(0, np.int64)
    runs = find(every, max(map(len, texts), default=0))
    k = 0
    for words, start, end in zip(texts, starts[:-1], starts[1:]):
        mine = []
        while k < len(runs) and runs[k][0] < end:
            s, e, q = runs[k]
            mine.append((int(s - start), int(e - start), q))
            k += 1
        yield mine, _rest(words, mine) if mine else b" ".join(words)


def _detected(text: pd.Series) -> pd.DataFrame:
    out, waiting, held = [], [], 0

    def done() -> None:
        nonlocal held
        for runs, rest in _of(waiting):
            out.append(([s for s, _, _ in runs], [e - s for s, e, _ in runs], [q for _, _, q in runs], rest))
        waiting.clear()
        held = 0

    for t in text:
        words = t.split() if t else []
        if held + len(words) > AT_ONCE and waiting:
            done()
        waiting.append(words)
        held += len(words)
    done()
    return pd.DataFrame(out, columns=["start", "length", "period", "rest"])


_FOUND = "start array<bigint>, length array<bigint>, period array<bigint>, rest binary"


def periodic(text: Column) -> Column:
    """Struct of the runs' starts, lengths and periods (word numbers, by start and period) and the rest of the text."""
    return F.pandas_udf(_detected, _FOUND)(text.cast("binary"))


def detect(docs: DataFrame, text: str = "text", runs: str = "runs", rest: str = "collapsed") -> DataFrame:
    """`docs` with its periodic runs, array<struct<start, length, period>>, and the text without the repeats."""
    clash = {runs.lower(), rest.lower()} & {c.lower() for c in docs.columns}
    if clash:
        raise ValueError(f"columns already there: {sorted(clash)}; name others")
    s = free_name(docs, "found__")
    found = docs.withColumn(s, periodic(F.col(text)))
    return found.select(
        *docs.columns,
        F.arrays_zip(*[F.col(s)[c].alias(c) for c in ("start", "length", "period")]).alias(runs),
        F.col(s)["rest"].cast("string").alias(rest),
    )
