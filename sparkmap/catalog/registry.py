"""Named queries and the SQL that states what they must return.

A column spec such as "subject n:i mean:d" fixes names and types on both sides:
`i` is BIGINT, `d` DOUBLE rounded to six digits (`d9`: nine), anything else is
left as it is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, deps: str, body: str) -> None:
    """A named SQL building block; `deps` lists the blocks it reads."""
    _CTES[name] = (tuple(deps.split()), body)


def _with(names: list[str]) -> str:
    done: list[str] = []

    def add(name: str) -> None:
        if name in done:
            return
        for d in _CTES[name][0]:
            add(d)
        done.append(name)

    for n in names:
        add(n)
    if not done:
        return ""
    return "WITH " + ",\n".join(f"{n} AS ({_CTES[n][1]})" for n in done) + "\n"


def _spec(cols: str) -> list[tuple[str, str]]:
    return [tuple(c.split(":")) if ":" in c else (c, "") for c in cols.split()]


def _spark_col(name: str, kind: str) -> Column:
    c = F.col(name)
    if kind == "i":
        c = c.cast("bigint")
    elif kind.startswith("d"):
        c = F.round(c.cast("double"), int(kind[1:] or 6)) + F.lit(0.0)
    return c.alias(name)


def _sql_col(name: str, kind: str) -> str:
    if kind == "i":
        return f"CAST({name} AS BIGINT) AS {name}"
    if kind.startswith("d"):
        return f"round(CAST({name} AS DOUBLE), {int(kind[1:] or 6)}) + 0.0 AS {name}"
    return name


def query(name: str, cols: str, deps: str = "", sql: str | None = None):
    """Register a query; `sql` (over the blocks in `deps`) is its oracle."""
    spec = _spec(cols)

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(spark, sf_dir).select(*[_spark_col(n, k) for n, k in spec])

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            chosen = ", ".join(_sql_col(n, k) for n, k in spec)
            ORACLES[name] = f"{_with(deps.split())}SELECT {chosen} FROM ({sql}) AS q"
        return fn

    return register
