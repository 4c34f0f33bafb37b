"""Balanced label propagation into shards.

Documents of one group (by default, of equal text) are linked.  A document
starts in a shard drawn by hash.  In each round every group's documents move to
the shard that holds most of the group, as far as quotas allow: the driver sees
only the flows between shards (at most shards^2 numbers) and scales them until
no shard exceeds its capacity; which of the movers go is drawn by hash.  All
documents of a group that start in one shard move together, so the rounds work
on one row per (group, first shard), not on documents.

A group larger than a quarter of a shard is split into parts of about that size
first, since it cannot stay whole and its parts still can.

At the end the law `rows` is enforced exactly: shard counts are at most one
apart.  Places in a shard are given in the order linked documents first; what
lies beyond the quota of a full shard, unlinked documents first, fills the
holes of the others by arithmetic on the places.

Defined cases: null texts are equal to each other and have 8 bytes; repeated
rows are linked as equal texts; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sparkmap.llm.common import numbered
from sparkmap.session import materialize

SHARDS = 24
ROUNDS = 4
SLACK = 1.02


def _quotas(flows: dict[tuple[int, int], int], loads: list[float], capacity: float) -> dict[tuple[int, int], float]:
    """Share of each flow that may go, so that no shard ends above its capacity (or its present load)."""
    share = dict.fromkeys(flows, 1.0)
    for _ in range(50):
        moved = {k: n * share[k] for k, n in flows.items()}
        for to in range(len(loads)):
            came = sum(n for (_, b), n in moved.items() if b == to)
            went = sum(n for (a, _), n in moved.items() if a == to)
            room = max(0.0, max(capacity, loads[to]) - loads[to] + went)
            if came > room:
                for k in flows:
                    if k[1] == to:
                        share[k] *= room / came
    return share


def _look_up(values: list, at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))


def propagate(cells: DataFrame, fixed: list[int], shards: int, rounds: int = ROUNDS) -> DataFrame:
    """grp, first, n, shard: where the `n` documents of a group that started in `first` end.

    `cells` has grp, first, n; `fixed` are the numbers of unlinked documents in each shard.
    """
    now = cells.withColumn("shard", F.col("first"))
    for r in range(rounds):
        held = now.groupBy("grp", "shard").agg(F.sum("n").alias("here"))
        best = held.groupBy("grp").agg(
            F.max(F.struct("here", F.xxhash64("grp", "shard").alias("draw"), "shard")).alias("top")
        )
        now = materialize(now.join(best.select("grp", F.col("top.shard").alias("to")), "grp"), "cells")
        flow = {(x["shard"], x["to"]): x["n"] for x in now.groupBy("shard", "to").agg(F.sum("n").alias("n")).collect()}
        moving = {k: n for k, n in flow.items() if k[0] != k[1]}
        if not moving:
            return now.drop("to")
        loads = [fixed[s] + sum(n for (a, _), n in flow.items() if a == s) for s in range(shards)]
        share = _quotas(moving, loads, SLACK * sum(loads) / shards)
        table = [share.get((a, b), 0.0) for a in range(shards) for b in range(shards)]
        draw = F.shiftrightunsigned(F.xxhash64("grp", "first", F.lit(r)), 11) / F.lit(float(1 << 53))
        goes = draw < _look_up(table, F.col("shard") * shards + F.col("to"))
        now = now.withColumn("shard", F.when(goes, F.col("to")).otherwise(F.col("shard"))).drop("to")
    return materialize(now, "cells")


def shard(docs: DataFrame, shards: int = SHARDS, group: Column | None = None, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, grp, linked, shard, slot: one row per row of `docs`.

    `slot` counts from 0 without gaps in each shard; counts are at most one apart.
    """
    text = F.col("text")
    base = materialize(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            (F.xxhash64(text, text.isNull(), F.octet_length(text)) if group is None else group).alias("cls"),
            F.pmod(F.xxhash64("doc_id", F.lit("first")), F.lit(shards)).cast("int").alias("first"),
        ),
        "sized",
    )
    total = base.count()
    part = max(1, total // (4 * shards))
    multiple = base.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.ceil(F.col("n") / part))
    state = base.join(multiple, "cls", "left").select(
        "doc_id", "size", "text_crc32", "first",
        F.col("n").isNotNull().alias("linked"),
        F.when(F.col("n").isNull(), F.col("cls")).otherwise(F.xxhash64("cls", parts)).alias("grp"),
    )
    state = materialize(state, "linked")
    alone = {x["first"]: x["n"] for x in state.where(~F.col("linked")).groupBy("first").agg(F.count(F.lit(1)).alias("n")).collect()}
    cells = state.where("linked").groupBy("grp", "first").agg(F.count(F.lit(1)).alias("n"))
    ends = propagate(cells, [alone.get(s, 0) for s in range(shards)], shards, rounds).select("grp", "first", "shard")
    placed = state.join(ends.withColumn("linked", F.lit(True)), ["grp", "first", "linked"], "left").withColumn(
        "shard", F.coalesce("shard", "first")
    )
    return _level(placed.drop("first"), shards, total)


def _level(placed: DataFrame, shards: int, total: int) -> DataFrame:
    """Exact quotas and slots."""
    row = numbered(placed, ["shard", F.desc("linked"), "grp", "doc_id", "size", "text_crc32"], "pos")
    counts = {x["shard"]: x["n"] for x in placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = [counts.get(s, 0) for s in range(shards)]
    order = sorted(range(shards), key=lambda s: (-n[s], s))  # the fullest keep the odd rows
    quota = [0] * shards
    for i, s in enumerate(order):
        quota[s] = total // shards + (i < total % shards)
    starts, beyond, holes = [0], [0], [0]
    for s in range(shards):
        starts.append(starts[-1] + n[s])
        beyond.append(beyond[-1] + max(0, n[s] - quota[s]))
        holes.append(holes[-1] + max(0, quota[s] - n[s]))
    here, quota_here = F.col("pos") - _look_up(starts[:-1], F.col("shard")), _look_up(quota, F.col("shard"))
    spare = _look_up(beyond[:-1], F.col("shard")) + here - quota_here
    hole = F.lit(0)
    for s in range(shards):  # the last shard whose holes begin at or before this number
        if holes[s + 1] > holes[s]:
            hole = F.when(spare >= holes[s], F.lit(s)).otherwise(hole)
    row = row.withColumns({"here__": here, "moves__": here >= quota_here, "hole__": hole, "spare__": spare})
    slot = F.when(F.col("moves__"), _look_up(n, F.col("hole__")) + F.col("spare__") - _look_up(holes[:-1], F.col("hole__")))
    return row.select(
        "doc_id", "size", "text_crc32", "grp", "linked",
        F.when(F.col("moves__"), F.col("hole__")).otherwise(F.col("shard")).cast("int").alias("shard"),
        slot.otherwise(F.col("here__")).cast("long").alias("slot"),
    )
