"""Metadata profiling: which sites, channels and subjects can be used."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from sparkmap.functions.numeric import all_finite, finite
from sparkmap.functions.text import join_distinct, strip
from sparkmap.operators.ordering import median, quantiles
from sparkmap.operators.quality import first_per_key

# The eligibility thresholds of the study.
MIN_SITE_PULSES = 5
MIN_CHANNELS_PER_SITE = 20
MIN_USABLE_SITES = 11


def restrict_if_present(df: DataFrame, group: Sequence[str], keep: Column) -> DataFrame:
    """In groups that have any row where `keep` holds, only those rows; other groups stay whole."""
    flagged = df.withColumn("_keep", F.coalesce(keep, F.lit(False)))
    has = flagged.where("_keep").select(*group).distinct().withColumn("_has", F.lit(True))
    return (
        flagged.join(has, list(group), "left")
        .where(F.col("_keep") | F.col("_has").isNull())
        .drop("_keep", "_has")
    )


def site_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("subject", "stim_site").agg(F.count(F.lit(1)).alias("n_pulses"))


def sites_over(counts: DataFrame, thresholds: Sequence[int] = (5, 10)) -> DataFrame:
    return counts.groupBy("subject").agg(
        F.count(F.lit(1)).alias("n_sites"),
        *[F.count_if(F.col("n_pulses") >= t).alias(f"n_sites_ge{t}") for t in thresholds],
    )


def dominant_value(df: DataFrame, group: Sequence[str], key: str, n_out: str = "n") -> DataFrame:
    """Most frequent key of each group; ties go to the smaller key.

    One mergeable min over (-n, key): no window over the group.
    """
    counts = df.groupBy(*group, key).agg(F.count(F.lit(1)).alias("_n"))
    best = F.min(F.struct((-F.col("_n")).alias("neg"), F.col(key).alias("key")))
    return counts.groupBy(*group).agg(best.alias("_b")).select(
        *group, F.col("_b.key").alias(key), (-F.col("_b.neg")).alias(n_out)
    )


def channel_status() -> Column:
    """Lower case without white space around it; a missing status is good, and so is all that is not `bad`."""
    return F.lower(strip(F.coalesce("status", F.lit("good"))))


def first_channel(channels: DataFrame, keys: Sequence[str], order: str = "row_order") -> DataFrame:
    """The first row of each channel name by the column `order`, which the table must have: without it "first" means nothing."""
    if order not in channels.columns:
        raise ValueError(f"no column {order} to tell which row of a channel comes first")
    return first_per_key(channels, list(keys), [order])


def channel_inventory(
    channels: DataFrame, electrodes: DataFrame, keys: Sequence[str], types: Sequence[str] = ("ECOG", "SEEG")
) -> DataFrame:
    """Channels that are not bad, of a wanted type, with finite coordinates; the first row of each name counts."""
    located = electrodes.where(all_finite(F.col("x"), F.col("y"), F.col("z"))).select(*keys)
    return (
        first_channel(channels, keys)
        .withColumn("status", channel_status())
        .withColumn("type", F.upper(strip(F.coalesce("type", F.lit("UNKNOWN")))))
        .where((F.col("status") != "bad") & F.col("type").isin(*types))
        .join(located, list(keys), "left_semi")
    )


def to_json_counts(df: DataFrame, group: Sequence[str], key: str, out: str) -> DataFrame:
    """Value counts of a small vocabulary as one JSON object per group, keys sorted."""
    counts = df.groupBy(*group, key).agg(F.count(F.lit(1)).alias("_n"))
    entries = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col("_n").alias("v"))))
    return counts.groupBy(*group).agg(F.to_json(F.map_from_entries(entries)).alias(out))


def channel_profile(channels: DataFrame, group: Sequence[str], name: str = "name") -> DataFrame:
    """Channels, those that are not bad, and counts by type; the first row of each name counts."""
    channels = first_channel(channels, [*group, name])
    total = channels.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_channels"),
        F.count_if(channel_status() != "bad").alias("n_good"),
    )
    return total.join(to_json_counts(channels, group, "type", "type_counts"), list(group))


def coordinate_coverage(electrodes: DataFrame, channels: DataFrame, keys: Sequence[str], group: str) -> DataFrame:
    """Electrodes with coordinates, and the share of good channels that are located."""
    ok = all_finite(F.col("x"), F.col("y"), F.col("z"))
    located = electrodes.where(ok).select(*keys).distinct().withColumn("_located", F.lit(True))
    per_group = electrodes.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_electrodes"), F.count_if(ok).alias("n_with_xyz")
    )
    good = first_channel(channels, keys).where(channel_status() != "bad").join(located, list(keys), "left")
    share = good.groupBy(group).agg(
        F.avg(F.when(F.col("_located"), 1.0).otherwise(0.0)).alias("good_located_share")
    )
    return per_group.join(share, group, "left")


def run_inventory(events: DataFrame, run: str, is_stim: Column, site: str) -> DataFrame:
    """Rows, stimulation rows and their sites of each run, and whether its file has the site column.

    Files of another header are united by name, so a run without the column has
    it NULL throughout; a table without it has no sites at all.
    """
    value = F.col(site) if site in events.columns else F.lit(None).cast("string")
    return events.groupBy(run).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.coalesce(is_stim, F.lit(False))).alias("n_stim_rows"),
        F.count_distinct(F.when(is_stim, value)).alias("n_sites"),
        F.bool_or(value.isNotNull()).alias("has_site_column"),
    )


def numeric_profile(df: DataFrame, group: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Median, min and max of each column."""
    ends = df.groupBy(*group).agg(
        *[a for c in cols for a in (F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"))]
    )
    return ends.join(quantiles(df, group, {f"{c}_median": median(c) for c in cols}), list(group), "left")


# Names that mark columns of an atlas, and the triplets of MNI coordinates, in lower case.
ATLAS_MARKS = ("destrieux", "atlas", "roi", "region", "label", "aparc")
MNI_TRIPLETS = (
    ("mni_x", "mni_y", "mni_z"),
    ("mni152_x", "mni152_y", "mni152_z"),
    ("x_mni", "y_mni", "z_mni"),
    ("x_mni152", "y_mni152", "z_mni152"),
)
MNI_SYSTEMS = ("mni152", "mni152lin", "mni152nlin")
MILLIMETRES = ("mm", "millimeter", "millimeters")


def _joined(values: Column) -> Column:
    return F.coalesce(F.array_join(F.array_sort(F.array_distinct(values)), "|"), F.lit(""))


def interface_audit(cells: DataFrame, systems: DataFrame, recordings: DataFrame, pairs: DataFrame, group: str = "subject") -> DataFrame:
    """One row a subject: what its electrode files, coordinate documents and recordings offer an anatomical bridge.

    `cells`: group, columns, cells (of `read_cells`).  `systems`: group, system,
    units.  `recordings`: group, sampling, line, reference, manufacturer.
    `pairs`: group, label, contact_a, contact_b (of `parse_pair`).  Groups come
    from `cells`; one without the other tables has empty texts and zero sites.
    """
    xyz = F.lit(True)
    for c in "xyz":
        xyz = xyz & F.coalesce(finite(F.try_element_at("cells", F.lit(c)).try_cast("double")), F.lit(False))
    headers = cells.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_electrodes"), F.count_if(xyz).alias("n_xyz"), F.flatten(F.collect_set("columns")).alias("_c")
    )  # distinct headers of a subject's files
    marked = lambda marks: F.filter("_c", lambda c: reduce(or_, [F.lower(c).contains(m) for m in marks]))
    named = lambda c: F.get(F.filter("_c", lambda x: F.lower(F.trim(x)) == c), F.lit(0))
    triplets = [F.when(F.size(F.array_compact(F.array(*[named(c) for c in t]))) == 3, F.concat_ws("|", *[named(c) for c in t])) for t in MNI_TRIPLETS]
    found = headers.select(
        group, "n_electrodes", "n_xyz", _joined(marked(["mni"])).alias("explicit_mni_columns"),
        F.array_join(F.array_compact(F.array(*triplets)), "|").alias("candidate_mni_triplets"), _joined(marked(ATLAS_MARKS)).alias("atlas_columns"),
    ).withColumn("direct_mni_columns", F.col("candidate_mni_triplets") != "")
    known = F.coalesce("system", F.lit("UNKNOWN"))
    unit = F.coalesce("units", F.lit("UNKNOWN"))
    declared = systems.groupBy(group).agg(
        join_distinct(known).alias("coordinate_systems"),
        join_distinct(unit).alias("coordinate_units"),
        F.bool_or(reduce(or_, [F.lower(known).contains(m) for m in MNI_SYSTEMS])).alias("direct_mni_system"),
        F.bool_or(F.lower(known) == "fsaverage").alias("fsaverage_system"),
        F.bool_and(F.lower(unit).isin(*MILLIMETRES) | (unit == "UNKNOWN")).alias("unit_mm"),
    )
    heard = recordings.groupBy(group).agg(*[
        join_distinct(F.col(c).cast("string")).alias(n)
        for c, n in (("sampling", "sampling_frequencies"), ("line", "power_line_frequencies"), ("reference", "reference_electrodes"), ("manufacturer", "manufacturers"))
    ])
    sites = pairs.groupBy(group).agg(
        F.count_distinct("label").alias("n_unique_stim_sites"),
        F.count_distinct(F.when(F.col("contact_a").isNotNull() & F.col("contact_b").isNotNull(), F.col("label"))).alias("n_stim_sites_pair_parsed"),
    )
    out = found.join(declared, group, "left").join(heard, group, "left").join(sites, group, "left")
    texts = ["coordinate_systems", "coordinate_units", "sampling_frequencies", "power_line_frequencies", "reference_electrodes", "manufacturers"]
    defaults = {c: F.coalesce(c, F.lit("")) for c in texts}
    defaults |= {c: F.coalesce(c, F.lit(False)) for c in ("direct_mni_system", "fsaverage_system")} | {"unit_mm": F.coalesce("unit_mm", F.lit(True))}
    defaults |= {c: F.coalesce(c, F.lit(0)) for c in ("n_unique_stim_sites", "n_stim_sites_pair_parsed")}
    return out.withColumns(defaults).withColumn(
        "stim_pair_match_fraction", F.try_divide(F.col("n_stim_sites_pair_parsed").cast("double"), F.col("n_unique_stim_sites"))
    )


def declared_values(files: DataFrame, group: Sequence[str], texts: dict[str, str], flags: dict[str, Column]) -> DataFrame:
    """Distinct declared values (as text) and the share of files each flag holds for."""
    return files.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_files"),
        *[join_distinct(F.col(c)).alias(n) for n, c in texts.items()],
        *[F.avg(F.coalesce(c, F.lit(False)).cast("double")).alias(n) for n, c in flags.items()],
    )


def schema_counts(files: DataFrame, columns: str) -> DataFrame:
    """In how many files each column name occurs."""
    return (
        files.select(F.explode(columns).alias("column_name"))
        .groupBy("column_name")
        .agg(F.count(F.lit(1)).alias("n_files"))
    )


def site_eligibility(
    events: DataFrame,
    pairs: DataFrame,
    min_pulses: int = MIN_SITE_PULSES,
    min_channels: int = MIN_CHANNELS_PER_SITE,
) -> DataFrame:
    """Per site: pulses of the subject's dominant protocol, eligible channels, usable or not.

    Unusable sites stay in the result with `site_usable` false.
    """
    dominant = dominant_value(events, ["subject"], "protocol").select("subject", "protocol")
    pulses = (
        events.join(dominant, ["subject", "protocol"], "left_semi")
        .groupBy("subject", "stim_site")
        .agg(F.count(F.lit(1)).alias("n_pulses"))
    )
    channels = pairs.groupBy("subject", "stim_site").agg(
        F.count_distinct("recording_channel").alias("n_channels")
    )
    return (
        pulses.join(channels, ["subject", "stim_site"], "left")
        .withColumn("n_channels", F.coalesce("n_channels", F.lit(0)))
        .withColumn("site_usable", (F.col("n_pulses") >= min_pulses) & (F.col("n_channels") >= min_channels))
    )


def subject_eligibility(sites: DataFrame, min_sites: int = MIN_USABLE_SITES) -> DataFrame:
    usable = sites.where("site_usable")
    base = sites.groupBy("subject").agg(
        F.count(F.lit(1)).alias("n_sites"), F.count_if(F.col("site_usable")).alias("n_usable_sites")
    )
    spread = usable.groupBy("subject").agg(F.min("n_channels").alias("min_channels")).join(
        quantiles(usable, ["subject"], {"median_channels": median("n_channels")}), "subject"
    )
    return base.join(spread, "subject", "left").withColumn("eligible", F.col("n_usable_sites") >= min_sites)


def cohort(subjects: DataFrame) -> DataFrame:
    return subjects.where("eligible").select("subject").orderBy("subject")


def subject_profile(parts: Sequence[DataFrame], key: str = "subject") -> DataFrame:
    """One wide row per subject out of several per-subject tables, each optional."""
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, key, "full")
    return out


def subject_inventory(df: DataFrame) -> DataFrame:
    """Rows, distinct sites and distinct channels; distinct first, so hot subjects shrink map-side."""
    rows = df.groupBy("subject", "stim_site", "recording_channel").agg(F.count(F.lit(1)).alias("_n"))
    return rows.groupBy("subject").agg(
        F.sum("_n").alias("n_rows"),
        F.count_distinct("stim_site").alias("n_sites"),
        F.count_distinct("recording_channel").alias("n_channels"),
    )


def coordinate_inventory(
    files: DataFrame, electrodes: DataFrame, channels: DataFrame, keys: Sequence[str], system: str, group: str
) -> DataFrame:
    systems = files.groupBy(group).agg(join_distinct(F.col(system)).alias("coordinate_systems"))
    return systems.join(coordinate_coverage(electrodes, channels, keys, group), group, "full")
