"""Names, labels and other text."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, functions as F

# Markers that stand for a missing text. Which set applies
# depends on the table, so it is a parameter everywhere.
MISSING_BASIC = ("", "n/a", "na", "nan", "none", "null")
MISSING_LABEL = MISSING_BASIC + ("unknown", "unk")
MISSING_TABLE = MISSING_LABEL + ("<na>",)

# What marks a hemisphere in a label.
LEFT_MARKS = (
    r"(^|[^a-z])left([^a-z]|$)",
    r"^lh([^a-z]|$)",
    r"^lh[_\-.]",
    r"^ctx[-_.]?lh[-_.]",
    r"^wm[-_.]?lh[-_.]",
    r"[-_.]lh$",
)
RIGHT_MARKS = (
    r"(^|[^a-z])right([^a-z]|$)",
    r"^rh([^a-z]|$)",
    r"^rh[_\-.]",
    r"^ctx[-_.]?rh[-_.]",
    r"^wm[-_.]?rh[-_.]",
    r"[-_.]rh$",
)
# What is not part of a label's stem, in order of removal.
STEM_NOISE = (
    r"^(ctx|wm)[-_.]?(lh|rh)[-_.]?",
    r"\b(left|right)\b",
    r"^(lh|rh)[-_.]?",
    r"[-_.]?(lh|rh)$",
    r"[^a-z0-9]+",
)
# Fixed value: what separates the two contacts of a pair label.
PAIR_SEPARATORS = r"[-_;,+/\\\s]+"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def valid_text(c: Column, missing: Iterable[str] = MISSING_BASIC) -> Column:
    """TRUE when the text is present and not a missing marker; never NULL."""
    return F.coalesce(~F.lower(strip(c)).isin(*missing), F.lit(False))


def clean_text(c: Column, missing: Iterable[str] = MISSING_BASIC) -> Column:
    return F.when(valid_text(c, missing), strip(c))


def norm_name(c: Column) -> Column:
    """Without white space."""
    return F.regexp_replace(c, r"(?U)\s+", "")


def casefold_key(c: Column) -> Column:
    """Case-insensitive join key."""
    return F.lower(strip(c))


def norm_site(c: Column) -> Column:
    """Pair label with one spelling: no spaces, dash as the separator."""
    return F.replace(norm_name(c), F.lit("_"), F.lit("-"))


def norm_subject(c: Column) -> Column:
    """`sub-7`, `sub_07`, `sub7`, `7`, `7.0` all become `sub-07`; anything else stays.

    Digits behind `sub` are filled to two and otherwise kept: `sub-007` is another subject than `sub-07`.
    """
    c = strip(c.cast("string"))
    tagged = F.nullif(F.regexp_extract(c, r"(?i)sub[-_]?(\d+)", 1), F.lit(""))
    number = c.try_cast("double").try_cast("bigint").cast("string")
    digits = F.coalesce(tagged, number)
    padded = F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits)
    return F.coalesce(F.concat(F.lit("sub-"), padded), c)


def _accent_table() -> tuple[str, str]:
    """Accented letters and their bases, by rule from the Unicode data."""
    accented, base = [], []
    for code in range(0xA0, 0x30000):
        plain = "".join(x for x in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(x))
        if len(plain) == 1 and plain != chr(code):
            accented.append(chr(code))
            base.append(plain)
    return "".join(accented), "".join(base)


_ACCENTED, _BASE = _accent_table()


def _several() -> str:
    """A character class of all characters that fold to several, by rule from the Unicode data."""
    codes = [
        code for code in range(0xA0, 0x30000)
        if len("".join(x for x in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(x))) > 1
    ]
    spans, start = [], codes[0]
    for a, b in zip(codes, [*codes[1:], None]):
        if b != a + 1:
            spans.append(rf"\x{{{start:X}}}-\x{{{a:X}}}")
            start = b
    return "[" + "".join(spans) + "]"


# in front of a class of many ranges the plain range test rules out most characters
_BEYOND_ASCII = r"[\x{80}-\x{10FFFF}&&%s]"
_SEVERAL = _BEYOND_ASCII % _several()
_MARK = _BEYOND_ASCII % r"\p{Mn}"


def _unfold(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t and "".join(x for x in unicodedata.normalize("NFKD", t) if not unicodedata.combining(x)))


def ascii_fold(c: Column) -> Column:
    """Strip accents and fold compatibility forms.

    Forms of one character go by table and loose marks by class; only texts that
    hold a form of several characters (`ﬁ`, `½`, Hangul) are normalised in Arrow batches.
    """
    # ASCII folds to itself
    plain = F.octet_length(c) == F.char_length(c)
    held = ~plain & c.rlike(_SEVERAL)
    unfolded = F.when(held, F.pandas_udf(_unfold, "string")(F.when(held, c))).otherwise(c)
    return F.when(plain, c).otherwise(F.regexp_replace(F.translate(unfolded, _ACCENTED, _BASE), _MARK, ""))


def _matches_any(c: Column, patterns: Iterable[str]) -> Column:
    return c.rlike("|".join(f"(?:{p})" for p in patterns))


def hemi_from_label(c: Column) -> Column:
    """L or R as written in the label (left is tested first), else NULL."""
    low = F.lower(ascii_fold(c))
    return F.when(_matches_any(low, LEFT_MARKS), "L").when(_matches_any(low, RIGHT_MARKS), "R")


def hemi_from_meta(c: Column) -> Column:
    """L or R from a metadata field."""
    low = F.lower(strip(c))
    return F.when(low.startswith("l") | low.contains("left"), "L").when(
        low.startswith("r") | low.contains("right"), "R"
    )


def canonical_stem(c: Column, missing: Iterable[str] = MISSING_LABEL) -> Column:
    """Label without hemisphere and separators; NULL when nothing is left."""
    stem = strip(F.lower(ascii_fold(c)))
    for noise in STEM_NOISE:
        stem = F.regexp_replace(stem, noise, "")
    return F.when(valid_text(stem, missing), stem)


def label_key(c: Column, missing: Iterable[str] = MISSING_LABEL) -> Column:
    """(hemi, stem), NULL for a missing label."""
    return F.when(
        valid_text(c, missing),
        F.struct(hemi_from_label(c).alias("hemi"), canonical_stem(c, missing).alias("stem")),
    )


def protocol_key(current: Column, frequency: Column, pulse_width: Column, kind: Column) -> Column:
    """One comparable key per stimulation protocol."""

    def number(c: Column) -> Column:
        return F.round(c.try_cast("double"), 9)

    return F.struct(
        number(current).alias("current"),
        number(frequency).alias("frequency"),
        number(pulse_width).alias("pulse_width"),
        F.lower(strip(kind)).alias("kind"),
    )


def canonical_pair(a: Column, b: Column, sep: str = "--") -> Column:
    """Order-free pair id."""
    return F.concat(F.least(a, b), F.lit(sep), F.greatest(a, b))


def event_uid(*parts: Column) -> Column:
    return F.concat_ws(":", *[p.cast("string") for p in parts])


def parse_json_list(c: Column) -> Column:
    return F.from_json(c, "array<string>")


def join_distinct(c: Column, sep: str = "|") -> Column:
    """Aggregate: sorted distinct texts in one string (for small vocabularies)."""
    return F.array_join(F.array_sort(F.collect_set(c)), sep)
