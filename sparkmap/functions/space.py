"""Points and vectors as plain column arithmetic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from sparkmap.functions.numeric import safe_ratio

Point = tuple[Column, Column, Column]
AXES = ("x", "y", "z")

# Affine from the average-surface space to the MNI152 space.
SURFACE_TO_MNI = (
    (0.9975, -0.0073, 0.0176, -0.0429),
    (0.0146, 1.0009, -0.0024, 1.5496),
    (-0.0130, -0.0093, 0.9971, 1.1840),
)


def point(prefix: str = "", suffix: str = "") -> Point:
    return tuple(F.col(f"{prefix}{a}{suffix}") for a in AXES)


def affine3(p: Point, matrix: Sequence[Sequence[float]] = SURFACE_TO_MNI) -> Point:
    return tuple(F.lit(r[0]) * p[0] + F.lit(r[1]) * p[1] + F.lit(r[2]) * p[2] + F.lit(r[3]) for r in matrix)


def midpoint(a: Point, b: Point) -> Point:
    return tuple((i + j) / F.lit(2.0) for i, j in zip(a, b))


def minus(a: Point, b: Point) -> Point:
    return tuple(i - j for i, j in zip(a, b))


def norm(v: Point) -> Column:
    return F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])


def unit_vector(a: Point, b: Point) -> Point:
    """Direction from a to b; NULL when the two coincide."""
    d = minus(b, a)
    return tuple(safe_ratio(c, norm(d)) for c in d)


def axis_tensor(o: Point) -> dict[str, Column]:
    """Sign-free orientation: the six distinct products of the direction."""
    x, y, z = o
    return {"xx": x * x, "yy": y * y, "zz": z * z, "xy": x * y, "xz": x * z, "yz": y * z}


def displacement(origin: Point, target: Point) -> dict[str, Column]:
    d = minus(target, origin)
    return {"dx": d[0], "dy": d[1], "dz": d[2], "distance": norm(d), "log_distance": F.log1p(norm(d))}


def present(p: Point) -> Column:
    return p[0].isNotNull() & p[1].isNotNull() & p[2].isNotNull()


def near_field(distance: Column, mm: float = 10.0, rule: str = "gt") -> Column:
    """The three near-field rules in use.

    `gt`: keep pairs strictly beyond mm; `ge`: keep pairs at mm or beyond;
    `flag_le`: TRUE for the near pairs, mm included.
    """
    if rule == "gt":
        return distance > F.lit(mm)
    if rule == "ge":
        return distance >= F.lit(mm)
    if rule == "flag_le":
        return distance <= F.lit(mm)
    raise ValueError(rule)
