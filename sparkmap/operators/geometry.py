"""Site and channel geometry: pairs, harmonised maps, feature tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from sparkmap.functions import space
from sparkmap.functions.numeric import finite
from sparkmap.operators.quality import one_per_key

TILE = 4096  # rows of a subject on one side of a tile
PAIR_KEYS = ["subject", "stim_site", "recording_channel"]


def salted_pairs(left: DataFrame, right: DataFrame, on: str, tile: int = TILE) -> DataFrame:
    """All left-right pairs of a key, where one key may dominate either side or both.

    The rows of a key are counted.  A key with more than `tile` rows on a side
    becomes a grid: its rows are dealt over as many strips as it needs on that
    side and repeated once for each strip of the other.  All other keys are
    joined as they are.
    """
    strips = lambda df, out: df.groupBy(on).agg(F.ceil(F.count(F.lit(1)) / F.lit(tile)).alias(out))
    grid = strips(left, "_nl").join(strips(right, "_nr"), on)
    heavy = grid.where("_nl > 1 OR _nr > 1")
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.coalesce(n, F.lit(1)).cast("long") - 1)
    own = lambda df, n: F.coalesce(F.pmod(F.xxhash64(*df.columns), n), F.lit(0)).cast("long")

    def dealt(df: DataFrame, mine: str, others: str, a: str, b: str) -> DataFrame:
        # heavy keys are at most the rows of both sides over the tile
        return df.join(heavy, on, "left").withColumn(a, own(df, F.col(mine))).withColumn(b, F.explode(every(F.col(others)))).drop("_nl", "_nr")

    return dealt(left, "_nl", "_nr", "_l", "_r").join(dealt(right, "_nr", "_nl", "_r", "_l"), [on, "_l", "_r"]).drop("_l", "_r")


def site_channel_pairs(
    sites: DataFrame, channels: DataFrame, mm: float = 10.0, rule: str = "ge"
) -> DataFrame:
    """Every eligible recording channel of every site of a subject.

    `sites`: subject, stim_site, contact_a, contact_b, mid_x/y/z.
    `channels`: subject, recording_channel, x/y/z.
    The two stimulating contacts and the near field are left out.
    """
    pairs = salted_pairs(sites, channels, "subject")
    away = (F.col("recording_channel") != F.col("contact_a")) & (F.col("recording_channel") != F.col("contact_b"))
    d = space.displacement(space.point("mid_"), space.point())
    return (
        pairs.where(away)
        .withColumn("distance_to_stim", d["distance"])
        .where(space.near_field(F.col("distance_to_stim"), mm, rule))
    )


def availability_flags(df: DataFrame, groups: dict[str, Sequence[str]]) -> DataFrame:
    """One flag per group of columns: all of them present."""
    for name, cols in groups.items():
        ok = F.lit(True)
        for c in cols:
            ok = ok & F.col(c).isNotNull()
        df = df.withColumn(name, ok)
    return df


def hemi_sign_agreement(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of left contacts with x<0 and of right contacts with x>0."""
    agrees = F.when(F.col("hemi") == "L", F.col("x") < 0).when(F.col("hemi") == "R", F.col("x") > 0)
    flag = agrees.cast("double")
    per_key = df.groupBy(*keys) if keys else df.groupBy()
    return per_key.agg(F.count(flag).alias("n_sided"), F.avg(flag).alias("agreement"))


def check_geometry(df: DataFrame) -> DataFrame:
    """Largest error of stored midpoints and lengths against the contacts."""
    a, b = space.point("a_"), space.point("b_")
    mid = space.midpoint(a, b)
    errors = [F.abs(m - F.col(f"mid_{x}")) for m, x in zip(mid, space.AXES)]
    return df.agg(
        F.max(F.greatest(*errors)).alias("max_midpoint_error"),
        F.max(F.abs(space.norm(space.minus(b, a)) - F.col("pair_length"))).alias("max_length_error"),
    )


def site_geometry(df: DataFrame) -> DataFrame:
    """Midpoint, length, orientation and its axis tensor from a_x..b_z."""
    a, b = space.point("a_"), space.point("b_")
    o = space.unit_vector(a, b)
    return df.select(
        "*",
        *[m.alias(f"mid_{x}") for m, x in zip(space.midpoint(a, b), space.AXES)],
        space.norm(space.minus(b, a)).alias("pair_length"),
        *[u.alias(f"axis_{x}") for u, x in zip(o, space.AXES)],
        *[t.alias(f"axis_{n}") for n, t in space.axis_tensor(o).items()],
    )


def harmonize_map(maps: DataFrame, channels: DataFrame, sites: DataFrame) -> DataFrame:
    """Map rows with channel and site geometry; rows without either stay, flagged.

    Many map rows to one channel and one site: a second row of either stops the job.
    """
    rec = channels.select("subject", "recording_channel", *[F.col(a).alias(f"rec_{a}") for a in space.AXES])
    rec = one_per_key(rec, ["subject", "recording_channel"], "channel row")
    sites = one_per_key(sites, ["subject", "stim_site"], "site row")
    out = maps.join(rec, ["subject", "recording_channel"], "left").join(sites, ["subject", "stim_site"], "left")
    d = space.displacement(space.point("mid_"), space.point("rec_"))
    out = out.select("*", *[c.alias(n) for n, c in d.items()])
    return availability_flags(
        out,
        {
            "has_recording": [f"rec_{a}" for a in space.AXES],
            "has_site": [f"mid_{a}" for a in space.AXES],
            "has_pair": [f"rec_{a}" for a in space.AXES] + [f"mid_{a}" for a in space.AXES],
        },
    )


# The sixteen geometric model inputs.
FEATURES = (
    [f"mid_{a}" for a in space.AXES]
    + [f"rec_{a}" for a in space.AXES]
    + ["dx", "dy", "dz", "log_distance"]
    + [f"axis_{t}" for t in ("xx", "yy", "zz", "xy", "xz", "yz")]
)


def build_features(
    maps: DataFrame, channels: DataFrame, sites: DataFrame, bridge: DataFrame, unknown: str = "UNK"
) -> DataFrame:
    """Model table: map keys, targets, sixteen geometric inputs and three label tokens.

    `bridge`: subject, contact, token.  Rows with a non-finite input are left
    out; a missing token becomes `unknown`.
    """
    out = harmonize_map(maps, channels, sites)
    bridge = one_per_key(bridge.select("subject", "contact", "token"), ["subject", "contact"], "token")
    for contact, name in (("contact_a", "stim_a_roi"), ("contact_b", "stim_b_roi"), ("recording_channel", "recording_roi")):
        tokens = bridge.select("subject", F.col("contact").alias(contact), F.col("token").alias(name))
        out = out.join(tokens, ["subject", contact], "left").withColumn(name, F.coalesce(name, F.lit(unknown)))
    ok = F.lit(True)
    for c in FEATURES:
        ok = ok & finite(F.col(c))
    return out.where(ok)


def geometry_coverage(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of map rows, sites and channels that have geometry."""
    share = lambda c: F.avg(F.col(c).cast("double"))
    per_site = df.groupBy(*keys, "stim_site").agg(F.max("has_site").alias("h")).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_sites"), F.avg(F.col("h").cast("double")).alias("site_share")
    )
    per_channel = df.groupBy(*keys, "recording_channel").agg(F.max("has_recording").alias("h")).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_channels"), F.avg(F.col("h").cast("double")).alias("channel_share")
    )
    rows = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pairs"), share("has_pair").alias("pair_share"))
    return rows.join(per_site, list(keys)).join(per_channel, list(keys))

