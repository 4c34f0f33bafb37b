"""Mapping one label vocabulary onto another, and how much of the data it covers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sparkmap.functions.text import (
    MISSING_LABEL, PAIR_SEPARATORS, canonical_stem, hemi_from_label, norm_name, valid_text,
)

UNKNOWN = "UNK"


def vocabulary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """How often each valid token occurs in each label column."""
    long = df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("label_column"), F.col(c).alias("token")) for c in cols])).alias("x")
    ).select("x.*")
    return (
        long.where(valid_text(F.col("token"), MISSING_LABEL))
        .groupBy("label_column", F.trim("token").alias("token"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def vocab_overlap(values: DataFrame, vocab: DataFrame, token: str = "token", weight: str = "n") -> DataFrame:
    """Weighted and plain share of the values that occur in the vocabulary."""
    known = vocab.select(F.col("token").alias(token)).distinct().withColumn("_hit", F.lit(1.0))
    hit = F.coalesce("_hit", F.lit(0.0))
    return (
        values.join(known, token, "left")
        .groupBy("label_column")
        .agg((F.sum(F.col(weight) * hit) / F.sum(weight)).alias("weighted_share"), F.avg(hit).alias("plain_share"))
    )


def better_representation(overlap: DataFrame, text: str, numeric: str) -> DataFrame:
    """Which of two label columns overlaps more; a tie chooses the text."""
    def share(c: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("label_column") == c, F.col("weighted_share"))), F.lit(0.0))

    return overlap.agg(share(text).alias("text_share"), share(numeric).alias("numeric_share")).withColumn(
        "chosen", F.when(F.col("numeric_share") > F.col("text_share"), numeric).otherwise(text)
    )


def with_label_key(df: DataFrame, token: str) -> DataFrame:
    return df.withColumn("hemi", hemi_from_label(F.col(token))).withColumn("stem", canonical_stem(F.col(token)))


def candidates(target: DataFrame, by: Sequence[str]) -> DataFrame:
    """Target tokens under each key, as a sorted list (a label vocabulary is small)."""
    return (
        with_label_key(target.select("token").distinct(), "token")
        .where(F.col("stem").isNotNull())
        .groupBy(*by)
        .agg(F.array_sort(F.collect_set("token")).alias("candidates"))
    )


def bridge_candidates(source: DataFrame, target: DataFrame, hemi: Column | None = None) -> DataFrame:
    """Exact, strict (hemi and stem) and stem candidates of each source token.

    `source`: token, n, and whatever `hemi` reads.  Only a unique strict
    candidate is a safe target.
    """
    src = with_label_key(source, "token")
    if hemi is not None:
        src = src.withColumn("hemi", F.coalesce("hemi", hemi))
    exact = target.select("token").distinct().withColumn("exact", F.col("token"))
    strict = candidates(target, ["hemi", "stem"]).select(
        F.coalesce("hemi", F.lit("")).alias("_h"), "stem", F.col("candidates").alias("_strict")
    )
    by_stem = candidates(target, ["stem"]).withColumnRenamed("candidates", "_stem_c")
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    text = lambda c: F.coalesce(F.array_join(c, "|"), F.lit(""))
    return (
        src.withColumn("_h", F.coalesce("hemi", F.lit("")))
        .join(exact, "token", "left")
        .join(strict, ["_h", "stem"], "left")
        .join(by_stem, "stem", "left")
        .withColumn("n_strict", F.when(F.col("_strict").isNull(), 0).otherwise(n("_strict")))
        .withColumn("n_stem", F.when(F.col("_stem_c").isNull(), 0).otherwise(n("_stem_c")))
        .withColumn("strict_candidates", text("_strict"))
        .withColumn("stem_candidates", text("_stem_c"))
        .withColumn("target", F.when(F.col("n_strict") == 1, F.get("_strict", F.lit(0))))
        .drop("_h", "_strict", "_stem_c")
    )


def bridge_coverage(mapping: DataFrame, weight: str = "n") -> DataFrame:
    safe = F.col("target").isNotNull().cast("double")
    return mapping.agg(
        F.count(F.lit(1)).alias("n_tokens"),
        (F.sum(F.col(weight) * safe) / F.sum(weight)).alias("weighted_share"),
        F.avg(safe).alias("unique_share"),
    )


def freeze_bridge(mapping: DataFrame) -> DataFrame:
    ok = valid_text(F.col("target"), MISSING_LABEL)
    return mapping.withColumn(
        "frozen_token", F.when(ok, F.trim("target")).otherwise(UNKNOWN)
    ).withColumn(
        "bridge_status",
        F.when(ok, "unique_hemi_stem_match").otherwise("unseen_or_ambiguous_to_UNK"),
    )


def crosswalk(rows: DataFrame) -> DataFrame:
    """Distinct mappings with electrode and subject counts."""
    return rows.groupBy("roi_text", "metadata_hemi", "frozen_token", "bridge_status").agg(
        F.count(F.lit(1)).alias("n_electrodes"), F.count_distinct("subject").alias("n_subjects")
    )


def coverage_by(df: DataFrame, flag: Column, group: Sequence[str], prefix: str = "") -> DataFrame:
    flag = F.coalesce(flag, F.lit(False))
    return df.groupBy(*group).agg(
        F.count(F.lit(1)).alias(f"{prefix}n"),
        F.count_if(flag).alias(f"{prefix}known"),
        F.avg(flag.cast("double")).alias(f"{prefix}share"),
    )


def operational_coverage(recording: DataFrame, sites: DataFrame, bridge: DataFrame) -> DataFrame:
    """Coverage of recording contacts, stimulation contacts and their union, per subject.

    `recording`: subject, contact. `sites`: subject, contact_a, contact_b.
    `bridge`: subject, contact, roi_text, frozen_token.
    """
    rec = recording.select("subject", "contact").distinct()
    stim = sites.select("subject", F.explode(F.array("contact_a", "contact_b")).alias("contact")).distinct()
    both = rec.union(stim).distinct()
    tagged = (
        rec.withColumn("contact_set", F.lit("recording"))
        .unionByName(stim.withColumn("contact_set", F.lit("stimulation")))
        .unionByName(both.withColumn("contact_set", F.lit("union")))
    )
    found = bridge.withColumn("_found", F.lit(True))
    known = F.coalesce(F.col("frozen_token") != UNKNOWN, F.lit(False))
    return (
        tagged.join(found, ["subject", "contact"], "left")
        .groupBy("subject", "contact_set")
        .agg(
            F.count(F.lit(1)).alias("n_contacts"),
            F.count_if(F.coalesce("_found", F.lit(False))).alias("n_found"),
            F.count_if(valid_text(F.col("roi_text"), MISSING_LABEL)).alias("n_labelled"),
            F.count_if(known).alias("n_known"),
        )
    )


def pair_labels(pairs: DataFrame, bridge: DataFrame) -> DataFrame:
    """Pairs with `stim_known` (both contacts) and `all_known` (and the channel)."""
    out = pairs
    for contact in ("contact_a", "contact_b", "recording_channel"):
        known = bridge.select(
            "subject", F.col("contact").alias(contact), (F.col("frozen_token") != UNKNOWN).alias(f"_{contact}")
        )
        out = out.join(known, ["subject", contact], "left")
    flag = lambda c: F.coalesce(F.col(f"_{c}"), F.lit(False))
    return (
        out.withColumn("stim_known", flag("contact_a") & flag("contact_b"))
        .withColumn("all_known", F.col("stim_known") & flag("recording_channel"))
        .drop("_contact_a", "_contact_b", "_recording_channel")
    )


def pair_coverage(labelled: DataFrame, group: Sequence[str]) -> DataFrame:
    return labelled.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.count_if("stim_known").alias("n_stim_known"),
        F.count_if("all_known").alias("n_all_known"),
    )


def coverage_summary(operational: DataFrame, pairs: DataFrame) -> DataFrame:
    """Overall shares: recording contacts, stimulation contacts and pairs."""
    op = operational.groupBy("subject").agg(
        *[
            F.sum(F.when(F.col("contact_set") == s, F.col(c)).otherwise(0)).alias(f"{s}_{c}")
            for s in ("recording", "stimulation")
            for c in ("n_contacts", "n_known")
        ]
    )
    wide = op.join(pairs, "subject", "full")
    ratio = lambda a, b: F.try_divide(F.sum(a).cast("double"), F.sum(b).cast("double"))
    return wide.agg(
        F.count(F.lit(1)).alias("n_subjects"),
        ratio("recording_n_known", "recording_n_contacts").alias("recording_share"),
        ratio("stimulation_n_known", "stimulation_n_contacts").alias("stimulation_share"),
        ratio("n_all_known", "n_pairs").alias("pair_share"),
    )


def known_fraction(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Share of rows whose token is known, for each label column."""
    long = df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("label_column"), F.col(c).alias("token")) for c in cols])).alias("x")
    ).select("x.*")
    return long.groupBy("label_column").agg(
        F.avg(F.when(F.col("token") != UNKNOWN, 1.0).otherwise(0.0)).alias("known_share")
    )


def parse_pair(labels: DataFrame, names: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Resolve each pair label to exactly two known names of its group.

    Three stages, each only for what the one before left open: exact tokens,
    tokens without regard to case, names found in the text between delimiters.
    `labels`: group, label. `names`: group, name. Returns group, label,
    contact_a, contact_b (NULL when unresolved).

    The third stage is an equi join too.  Labels and names are cut into tokens
    (runs of letters and digits, and single other characters); an index holds,
    for each first token of a name, how many tokens such names have.  Only
    stretches of a label whose first token begins a name, of these lengths, are
    cut and looked up, so their number grows with the length of the label.
    """
    group = list(group)
    todo = labels.select(*group, "label").distinct().withColumn("_raw", norm_name(F.col("label")))
    known = names.select(*group, norm_name(F.col("name")).alias("name")).distinct()
    folded = known.groupBy(*group, F.lower("name").alias("_low")).agg(F.max("name").alias("name"))
    tokens = todo.select(
        *group, "label", F.posexplode(F.split("_raw", PAIR_SEPARATORS)).alias("_i", "_tok")
    ).where("_tok <> ''")

    def two(hits: DataFrame, order: Column) -> DataFrame:
        got = F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col("name").alias("name"))))
        return (
            hits.groupBy(*group, "label")
            .agg(F.count(F.lit(1)).alias("_n"), got.alias("_hits"))
            .where("_n = 2")
            .select(*group, "label", F.col("_hits")[0]["name"].alias("contact_a"), F.col("_hits")[1]["name"].alias("contact_b"))
        )

    first = two(tokens.withColumn("name", F.col("_tok")).join(known, [*group, "name"], "left_semi"), F.col("_i"))
    rest = tokens.join(first, [*group, "label"], "left_anti").withColumn("_low", F.lower("_tok"))
    second = two(rest.join(folded, [*group, "_low"]), F.col("_i"))

    still = todo.join(first, [*group, "label"], "left_anti").join(second, [*group, "label"], "left_anti")
    cut = still.select(*group, "label", _tokens(F.lower("_raw")).alias("_t"))
    lowered = known.withColumn("_low", F.lower("name")).withColumn("_t", _tokens(F.col("_low")))
    index = lowered.where(F.size("_t") > 0).groupBy(*group, F.col("_t")[0].alias("_head")).agg(F.collect_set(F.size("_t")).alias("_sizes"))
    heads = cut.select(*group, "label", F.explode(F.array_distinct("_t")).alias("_head")).join(index, [*group, "_head"])
    sizes = heads.groupBy(*group, "label").agg(F.map_from_entries(F.collect_list(F.struct("_head", "_sizes"))).alias("_sizes"))
    pieces = cut.join(sizes, [*group, "label"]).select(*group, "label", F.explode(_stretches(F.col("_t"), F.col("_sizes"))).alias("_low"))
    lowered = lowered.drop("_t")
    third = two(pieces.join(lowered, [*group, "_low"]), F.struct(-F.length("name"), F.col("name")))

    found = first.unionByName(second).unionByName(third)
    return todo.drop("_raw").join(found, [*group, "label"], "left")


def _tokens(low: Column) -> Column:
    return F.regexp_extract_all(low, F.lit("([a-z0-9]+|[^a-z0-9])"), F.lit(1))


def _stretches(tokens: Column, sizes: Column) -> Column:
    """The texts of a label's stretches that a name may be: free on both sides, with a first token and a length of the index."""
    word = lambda i: F.coalesce(F.get(tokens, i).rlike("^[a-z0-9]"), F.lit(False))
    none = F.array().cast("array<int>")

    def from_here(token: Column, i: Column) -> Column:
        wanted = F.when(~word(i - 1), F.coalesce(F.try_element_at(sizes, token), none)).otherwise(none)
        whole = F.filter(wanted, lambda n: (i + n <= F.size(tokens)) & ~word(i + n))
        return F.transform(whole, lambda n: F.array_join(F.slice(tokens, i + 1, n), ""))

    return F.array_distinct(F.flatten(F.transform(tokens, from_here)))
