"""Gates: each check returns the offending rows; `require_empty` makes one fail the job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T


def expect_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def forbid_columns(df: DataFrame, substrings: Sequence[str]) -> DataFrame:
    bad = [c for c in df.columns if any(s.lower() in c.lower() for s in substrings)]
    if bad:
        raise ValueError(f"forbidden columns: {bad}")
    return df


def expect_unique(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Duplicate keys with their counts."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def expect_one_value(df: DataFrame, group: Sequence[str], col: str) -> DataFrame:
    """Groups where `col` takes more than one value."""
    return (
        df.groupBy(*group)
        .agg(F.min(col).alias("lowest"), F.max(col).alias("highest"))
        .where("lowest <> highest")
    )


def expect_max(df: DataFrame, error: Column, tol: float) -> DataFrame:
    """One row: the largest error and whether it is within tolerance."""
    return df.agg(F.max(error).alias("max_error")).withColumn("passed", F.col("max_error") <= F.lit(tol))


def expect_count(df: DataFrame, n: int | DataFrame) -> DataFrame:
    """One row: the number of rows and whether it is the expected one, a number or a one-row table of it."""
    found = df.agg(F.count(F.lit(1)).alias("n"))
    if isinstance(n, int):
        return found.withColumn("passed", F.col("n") == F.lit(n))
    return found.crossJoin(n.toDF("_expected")).select("n", (F.col("n") == F.col("_expected")).alias("passed"))


def expect_group_count(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Groups that do not have exactly n members."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != F.lit(n))


def same_keys(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys present on one side only."""
    ka, kb = a.select(*key).distinct(), b.select(*key).distinct()
    left = ka.join(kb, list(key), "left_anti").withColumn("only_in", F.lit("a"))
    return left.unionByName(kb.join(ka, list(key), "left_anti").withColumn("only_in", F.lit("b")))


def overlap_keys(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    return a.select(*key).intersect(b.select(*key))


def match_counts(actual: DataFrame, frozen: DataFrame, key: Sequence[str], col: str = "n") -> DataFrame:
    """Recomputed and stored count of every key, with an exact-match flag."""
    a = actual.select(*key, F.col(col).alias("actual"))
    f = frozen.select(*key, F.col(col).alias("stored"))
    return a.join(f, list(key), "full").withColumn("matches", F.col("actual").eqNullSafe(F.col("stored")))


def drop_counters(df: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """How many rows each rule hits."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in reasons.items()],
    )


def check_deterministic(df: DataFrame, key: Sequence[str], val: str) -> DataFrame:
    """Keys (NULL counts as a key value) that map to more than one value (NULL is one)."""
    return (
        df.groupBy(*key)
        .agg((F.count_distinct(F.col(val)) + F.max(F.col(val).isNull().cast("bigint"))).alias("n_values"))
        .where("n_values > 1")
    )


def require_empty(df: DataFrame, message: str) -> DataFrame:
    """A lazy gate: any row that reaches it stops the job."""
    return df.where(F.raise_error(F.lit(message)).cast("boolean"))


def one_per_key(df: DataFrame, key: Sequence[str], what: str) -> DataFrame:
    """`df` unchanged if each key has one row; a second row stops the job that reads it.

    For the small side of a many-to-one join, whose shuffle on the key it shares.
    """
    key = list(key)
    rest = [c for c in df.columns if c not in key]
    grouped = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*rest) if rest else F.lit(0)).alias("_r"))
    known = F.lit(True)
    for k in key:
        known = known & F.col(k).isNotNull()
    stop = F.raise_error(F.concat_ws(" ", F.lit(f"more than one {what} for"), *[F.col(k).cast("string") for k in key])).cast("boolean")
    return grouped.where(F.when(known & (F.col("_n") > 1), stop).otherwise(F.lit(True))).select(
        *[F.col(c) if c in key else F.col(f"_r.{c}").alias(c) for c in df.columns]
    )


def compare_tables(a: DataFrame, b: DataFrame, key: Sequence[str], rtol: float = 1e-12) -> DataFrame:
    """Differences between two tables, one row per key and field.

    Floats agree within a relative tolerance (no absolute one); NaN and a missing float never agree.
    Everything else must be equal, and so must the types.  Missing, extra and
    duplicate keys are differences too.
    """
    if dict(a.dtypes) != dict(b.dtypes):
        raise ValueError(f"schemas differ: {a.dtypes} / {b.dtypes}")
    key = list(key)
    fields = [f for f in a.schema.fields if f.name not in key]

    def differs(f: T.StructField) -> Column:
        x, y = F.col(f"a.{f.name}"), F.col(f"b.{f.name}")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            near = F.abs(x - y) <= F.lit(rtol) * F.greatest(F.abs(x), F.abs(y))
            ok = ~F.isnan(x) & ~F.isnan(y) & ((x == y) | near)
            return ~F.coalesce(ok, F.lit(False))
        return ~x.eqNullSafe(y)

    def side(df: DataFrame, name: str) -> DataFrame:
        # one row per key, so that duplicates meet as a count and never multiply
        return df.groupBy(*key).agg(
            F.count(F.lit(1)).alias(f"_n_{name}"),
            F.first(F.struct(*[f.name for f in fields])).alias(name) if fields else F.lit(None).alias(name),
        )

    both = side(a, "a").join(side(b, "b"), key, "full")
    single = (F.col("_n_a") == 1) & (F.col("_n_b") == 1)
    problems = [
        F.when(F.col("_n_a").isNull(), F.lit("(extra)")),
        F.when(F.col("_n_b").isNull(), F.lit("(missing)")),
        F.when((F.col("_n_a") > 1) | (F.col("_n_b") > 1), F.lit("(duplicate)")),
        *[F.when(single & differs(f), F.lit(f.name)) for f in fields],
    ]
    return both.select(*key, F.explode(F.array_compact(F.array(*problems))).alias("field"))


def table_fingerprint(df: DataFrame) -> DataFrame:
    """Order-free content hash: row count, xor and sum of row hashes.

    A row's hash is the head of the md5 of its values as texts, each with its length in front, NULL as `-`: neither
    a NULL nor a separator in a value can make two rows alike.
    """
    part = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    row = F.concat_ws("|", *[part(F.col(c).cast("string")) for c in sorted(df.columns)])
    h = F.conv(F.substring(F.md5(row), 1, 15), 16, 10).cast("bigint")
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.bit_xor(h).alias("xor_hash"),
        F.sum(h.cast("decimal(38,0)")).cast("string").alias("sum_hash"),
    )


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str], last: bool = False) -> DataFrame:
    """The first (or last) row of each key in an explicit order, as a mergeable aggregate."""
    rest = [c for c in df.columns if c not in key]
    pick = F.max if last else F.min
    packed = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest if c not in order])
    return df.groupBy(*key).agg(pick(packed).alias("_r")).select(*[
        F.col(c) if c in key else F.col(f"_r.{c}").alias(c) for c in df.columns
    ])
