"""Projections, predicates and text scalars over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkmap.catalog.registry import cte, query
from sparkmap.catalog.roles import contact_points, part_labels, table, trials
from sparkmap.functions import hashing, numeric, text
from sparkmap.operators import bridge, eligibility

# a text column with numbers, bad numbers and missing marks, from the events
cte("texts", "", """
  SELECT event_id, value, event_type, CASE event_id % 5 WHEN 0 THEN 'n/a' WHEN 1 THEN 'nan' WHEN 2 THEN ' '
    ELSE CAST(value AS VARCHAR) END AS txt FROM events""")


def _texts(spark, sf):
    e = table(spark, sf, "events", "event_id", "value", "event_type")
    m = F.col("event_id") % 5
    return e.withColumn("txt", F.when(m == 0, "n/a").when(m == 1, "nan").when(m == 2, " ").otherwise(F.col("value").cast("string")))


@query("to_number", "event_id x:d", "texts", """
  SELECT event_id, CASE WHEN isnan(TRY_CAST(txt AS DOUBLE)) THEN NULL ELSE TRY_CAST(txt AS DOUBLE) END AS x FROM texts""")
def _(spark, sf):
    return _texts(spark, sf).select("event_id", numeric.to_number(F.col("txt")).alias("x"))


@query("drop_missing", "event_type n:i mean_x:d", "texts", """
  SELECT event_type, count(*) AS n, avg(x) AS mean_x FROM (
    SELECT event_type, TRY_CAST(txt AS DOUBLE) AS x FROM texts) WHERE x IS NOT NULL AND NOT isnan(x) GROUP BY event_type""")
def _(spark, sf):
    x = _texts(spark, sf).withColumn("x", numeric.to_number(F.col("txt"))).na.drop(subset=["x"])
    return x.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean_x"))


@query("finite", "event_id ok all_ok", "texts", """
  SELECT event_id, coalesce(isfinite(TRY_CAST(txt AS DOUBLE)), FALSE) AS ok,
    coalesce(isfinite(TRY_CAST(txt AS DOUBLE)) AND isfinite(value), FALSE) AS all_ok FROM texts""")
def _(spark, sf):
    x = F.col("txt").try_cast("double")
    return _texts(spark, sf).select(
        "event_id", numeric.finite(x).alias("ok"), numeric.all_finite(x, F.col("value")).alias("all_ok")
    )


@query("valid_text", "contact valid clean", "part_labels", """
  SELECT contact, lower(trim(roi_text)) NOT IN ('', 'n/a', 'na', 'nan', 'none', 'null', 'unknown', 'unk') AS valid,
    CASE WHEN roi_text = 'unknown' THEN NULL ELSE trim(roi_text) END AS clean FROM part_labels""")
def _(spark, sf):
    c = F.col("roi_text")
    return part_labels(spark, sf).select(
        "contact", text.valid_text(c, text.MISSING_LABEL).alias("valid"), text.clean_text(c, text.MISSING_LABEL).alias("clean")
    )


@query("norm_name", "s_suppkey name key site", "", """
  SELECT s_suppkey, replace(s_name || 'x', ' ', '') AS name, lower(s_name) AS key,
    replace(replace(trim(s_name || '_A 1'), ' ', ''), '_', '-') AS site FROM supplier""")
def _(spark, sf):
    n = F.col("s_name")
    return table(spark, sf, "supplier", "s_suppkey", "s_name").select(
        "s_suppkey",
        text.norm_name(F.concat(F.lit(" \t"), n, F.lit(" \n x\u00a0"))).alias("name"),
        text.casefold_key(F.concat(n, F.lit("\t "))).alias("key"),
        text.norm_site(F.concat(n, F.lit("_A 1"))).alias("site"),
    )


@query("casefold_key", "key n:i", "", "SELECT lower(trim(p_brand || ' ' || p_name)) AS key, count(*) AS n FROM part GROUP BY 1")
def _(spark, sf):
    key = text.casefold_key(F.concat_ws(" ", "p_brand", "p_name"))
    return table(spark, sf, "part", "p_brand", "p_name").groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query("norm_site", "site n:i", "", """
  SELECT replace(replace(trim(p_name || '_' || p_brand), ' ', ''), '_', '-') AS site, count(*) AS n FROM part GROUP BY 1""")
def _(spark, sf):
    site = text.norm_site(F.concat_ws("_", "p_name", "p_brand"))
    return table(spark, sf, "part", "p_brand", "p_name").groupBy(site.alias("site")).agg(F.count(F.lit(1)).alias("n"))


@query("norm_subject", "c_custkey subject", "", """
  SELECT c_custkey, CASE c_custkey % 6 WHEN 3 THEN c_name WHEN 1 THEN 'sub-00' || n WHEN 5 THEN 'sub-0' || n
    ELSE 'sub-' || CASE WHEN length(n) < 2 THEN '0' || n ELSE n END END AS subject
  FROM (SELECT *, CAST(c_nationkey AS VARCHAR) AS n FROM customer)""")
def _(spark, sf):
    n = F.col("c_nationkey").cast("string")
    m = F.col("c_custkey") % 6
    raw = (
        F.when(m == 0, F.concat(F.lit("sub-"), n)).when(m == 1, F.concat(F.lit("Sub00"), n))
        .when(m == 2, F.concat(n, F.lit(".0"))).when(m == 3, F.concat(F.lit("\t"), F.col("c_name"), F.lit("\n")))
        .when(m == 4, F.concat(F.lit("SUB_"), n)).otherwise(F.concat(F.lit("ses-1/sub0"), n, F.lit("_x")))
    )
    return table(spark, sf, "customer", "c_custkey", "c_name", "c_nationkey").select(
        "c_custkey", text.norm_subject(raw).alias("subject")
    )


@query("ascii_fold", "doc_id folded", "", "SELECT doc_id, strip_accents(text) AS folded FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents", "doc_id", "text").select("doc_id", text.ascii_fold(F.col("text")).alias("folded"))


_LEFT = "|".join(f"(?:{p})" for p in text.LEFT_MARKS)
_RIGHT = "|".join(f"(?:{p})" for p in text.RIGHT_MARKS)
cte("label_hemi", "part_labels", f"""
  SELECT *, CASE WHEN regexp_matches(lower(roi_text), '{_LEFT}') THEN 'L'
    WHEN regexp_matches(lower(roi_text), '{_RIGHT}') THEN 'R' END AS hemi,
    CASE WHEN lower(hemi_text) LIKE 'l%' OR lower(hemi_text) LIKE '%left%' THEN 'L'
      WHEN lower(hemi_text) LIKE 'r%' OR lower(hemi_text) LIKE '%right%' THEN 'R' END AS meta_hemi
  FROM part_labels""")


def stem_sql(col: str) -> str:
    out = f"trim(lower({col}))"
    for noise in text.STEM_NOISE:
        out = f"regexp_replace({out}, '{noise}', '', 'g')"
    missing = ", ".join(f"'{m}'" for m in text.MISSING_LABEL)
    return f"CASE WHEN {out} NOT IN ({missing}) THEN {out} END"


cte("label_stem", "label_hemi", f"SELECT *, {stem_sql('roi_text')} AS stem FROM label_hemi")


@query("hemi_from_label", "contact hemi", "label_hemi", "SELECT contact, hemi FROM label_hemi")
def _(spark, sf):
    return part_labels(spark, sf).select("contact", text.hemi_from_label(F.col("roi_text")).alias("hemi"))


@query("hemi_from_meta", "contact meta_hemi", "label_hemi", "SELECT contact, meta_hemi FROM label_hemi")
def _(spark, sf):
    return part_labels(spark, sf).select("contact", text.hemi_from_meta(F.col("hemi_text")).alias("meta_hemi"))


@query("canonical_stem", "contact stem", "label_stem", "SELECT contact, stem FROM label_stem")
def _(spark, sf):
    return part_labels(spark, sf).select("contact", text.canonical_stem(F.col("roi_text")).alias("stem"))


@query("label_key", "hemi stem n:i", "label_stem", """
  SELECT hemi, stem, count(*) AS n FROM label_stem WHERE roi_text <> 'unknown' GROUP BY hemi, stem""")
def _(spark, sf):
    key = part_labels(spark, sf).select(text.label_key(F.col("roi_text")).alias("k")).where("k IS NOT NULL")
    return key.groupBy("k.hemi", "k.stem").agg(F.count(F.lit(1)).alias("n"))


@query("protocol_key", "current:d frequency:d pulse_width:d kind n:i", "", """
  SELECT round(l_discount, 9) AS current, round(l_quantity, 9) AS frequency, round(l_tax, 9) AS pulse_width,
    lower(trim(l_returnflag)) AS kind, count(*) AS n FROM lineitem GROUP BY 1, 2, 3, 4""")
def _(spark, sf):
    li = table(spark, sf, "lineitem", "l_discount", "l_quantity", "l_tax", "l_returnflag")
    key = text.protocol_key(*[F.col(c).cast("string") for c in ("l_discount", "l_quantity", "l_tax", "l_returnflag")])
    return li.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n")).select("k.*", "n")


@query("parse_bool", "event_type n_true:i n:i", "", """
  SELECT event_type, count(*) FILTER (WHERE event_id % 4 < 2) AS n_true, count(*) AS n FROM events GROUP BY event_type""")
def _(spark, sf):
    m = F.col("event_id") % 4
    raw = F.when(m == 0, " TRUE").when(m == 1, "Yes").when(m == 2, "0").otherwise(F.lit(None))
    return table(spark, sf, "events", "event_id", "event_type").groupBy("event_type").agg(
        F.count_if(numeric.parse_bool(raw)).alias("n_true"), F.count(F.lit(1)).alias("n")
    )


cte("pair_texts", "contact_points", """
  SELECT a.subject, CASE a.vec_id % 5 WHEN 0 THEN a.name || '-' || b.name WHEN 1 THEN lower(a.name) || '_' || lower(b.name)
      WHEN 2 THEN 'stim(' || a.name || ')(' || lower(b.name) || ')' WHEN 3 THEN a.name || b.name
      ELSE a.name || '-' || b.name || '-' || a.name END AS label
  FROM contact_points a JOIN contact_points b ON a.subject = b.subject AND b.vec_id = a.vec_id + 1""")
cte("pair_tokens", "pair_texts", """
  SELECT subject, label, unnest(regexp_split_to_array(replace(trim(label), ' ', ''), '[-_;,+/\\\\\\s]+')) AS tok,
    generate_subscripts(regexp_split_to_array(replace(trim(label), ' ', ''), '[-_;,+/\\\\\\s]+'), 1) AS i
  FROM (SELECT DISTINCT subject, label FROM pair_texts)""")
cte("pair_one", "pair_tokens contact_points", """
  SELECT t.subject, label, arg_min(name, i) AS contact_a, arg_max(name, i) AS contact_b
  FROM pair_tokens t JOIN contact_points c ON t.subject = c.subject AND t.tok = c.name GROUP BY ALL HAVING count(*) = 2""")
cte("pair_two", "pair_tokens contact_points pair_one", """
  SELECT t.subject, label, arg_min(name, i) AS contact_a, arg_max(name, i) AS contact_b
  FROM pair_tokens t JOIN contact_points c ON t.subject = c.subject AND lower(t.tok) = lower(c.name)
  WHERE (t.subject, label) NOT IN (SELECT (subject, label) FROM pair_one) GROUP BY ALL HAVING count(*) = 2""")
cte("pair_three", "pair_texts contact_points pair_one pair_two", """
  SELECT t.subject, label, arg_min(name, lpad(CAST(99 - length(name) AS VARCHAR), 2, '0') || name) AS contact_a,
    arg_max(name, lpad(CAST(99 - length(name) AS VARCHAR), 2, '0') || name) AS contact_b
  FROM (SELECT DISTINCT subject, label FROM pair_texts) t JOIN contact_points c ON t.subject = c.subject
    AND regexp_matches(label, '(^|[^A-Za-z0-9])' || name || '([^A-Za-z0-9]|$)', 'i')
  WHERE (t.subject, label) NOT IN (SELECT (subject, label) FROM pair_one)
    AND (t.subject, label) NOT IN (SELECT (subject, label) FROM pair_two) GROUP BY ALL HAVING count(*) = 2""")


@query("parse_pair", "subject label contact_a contact_b", "pair_texts pair_one pair_two pair_three", """
  SELECT t.subject, t.label, p.contact_a, p.contact_b FROM (SELECT DISTINCT subject, label FROM pair_texts) t
  LEFT JOIN (FROM pair_one UNION ALL FROM pair_two UNION ALL FROM pair_three) p ON t.subject = p.subject AND t.label = p.label""")
def _(spark, sf):
    return parsed_pairs(spark, sf)


def parsed_pairs(spark, sf):
    """Labels in five spellings of neighbouring contacts, resolved to the subject's contacts."""
    c = contact_points(spark, sf).select("subject", "name", "vec_id")
    nxt = c.select("subject", F.col("name").alias("b"), (F.col("vec_id") - 1).alias("vec_id"))
    m, a, b = F.col("vec_id") % 5, F.col("name"), F.col("b")
    label = (
        F.when(m == 0, F.concat(a, F.lit("-"), b))
        .when(m == 1, F.concat(F.lower(a), F.lit("_"), F.lower(b)))
        .when(m == 2, F.concat(F.lit("stim("), a, F.lit(")("), F.lower(b), F.lit(")")))
        .when(m == 3, F.concat(a, b))
        .otherwise(F.concat(a, F.lit("-"), b, F.lit("-"), a))
    )
    labels = c.join(nxt, ["subject", "vec_id"]).select("subject", label.alias("label"))
    return bridge.parse_pair(labels, c, ["subject"])


@query("canonical_pair", "pair n:i", "", """
  SELECT least(p_brand, p_type) || '--' || greatest(p_brand, p_type) AS pair, count(*) AS n FROM part GROUP BY 1""")
def _(spark, sf):
    pair = text.canonical_pair(F.col("p_type"), F.col("p_brand"))
    return table(spark, sf, "part", "p_brand", "p_type").groupBy(pair.alias("pair")).agg(F.count(F.lit(1)).alias("n"))


@query("parse_json_list", "event_id n:i joined", "", """
  SELECT event_id, len(l) AS n, array_to_string(l, '|') AS joined FROM (
    SELECT event_id, from_json('["' || event_type || '","' || user_id || '"]', '["VARCHAR"]') AS l FROM events)""")
def _(spark, sf):
    raw = F.concat(F.lit('["'), "event_type", F.lit('","'), F.col("user_id").cast("string"), F.lit('"]'))
    e = table(spark, sf, "events", "event_id", "event_type", "user_id").withColumn("l", text.parse_json_list(raw))
    return e.select("event_id", F.size("l").alias("n"), F.array_join("l", "|").alias("joined"))


@query("to_json_counts", "c_nationkey counts", "", """
  SELECT c_nationkey, '{' || string_agg('"' || c_mktsegment || '":' || n, ',' ORDER BY c_mktsegment) || '}' AS counts
  FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL) GROUP BY c_nationkey""")
def _(spark, sf):
    return eligibility.to_json_counts(
        table(spark, sf, "customer", "c_nationkey", "c_mktsegment"), ["c_nationkey"], "c_mktsegment", "counts"
    )


@query("join_distinct", "subject protocols", "trials", """
  SELECT subject, string_agg(DISTINCT protocol, '|' ORDER BY protocol) AS protocols FROM trials GROUP BY subject""")
def _(spark, sf):
    return trials(spark, sf).groupBy("subject").agg(text.join_distinct(F.col("protocol")).alias("protocols"))


@query("stable_seed", "o_orderkey seed:i", "", """
  SELECT o_orderkey, ('0x' || substr(sha256('20260926|' || o_custkey || '|' || o_orderkey), 1, 8))::BIGINT AS seed FROM orders""")
def _(spark, sf):
    return table(spark, sf, "orders", "o_orderkey", "o_custkey").select(
        "o_orderkey", hashing.stable_seed(F.lit(20260926), F.col("o_custkey"), F.col("o_orderkey")).alias("seed")
    )


@query("log1p_expm1_clip", "o_orderkey forward:d inverse:d", "", """
  SELECT o_orderkey, ln(1 + greatest(o_totalprice - 100000, 0)) AS forward,
    greatest(exp(o_totalprice / 100000 - 2) - 1, 0) AS inverse FROM orders""")
def _(spark, sf):
    p = F.col("o_totalprice")
    return table(spark, sf, "orders", "o_orderkey", "o_totalprice").select(
        "o_orderkey", numeric.log1p_clip(p - 100000).alias("forward"), numeric.expm1_clip(p / 100000 - 2).alias("inverse")
    )


@query("safe_ratio", "l_returnflag l_linestatus ratio:d zero:d", "", """
  SELECT l_returnflag, l_linestatus, sum(l_extendedprice) / sum(l_quantity) AS ratio, NULL AS zero
  FROM lineitem GROUP BY 1, 2""")
def _(spark, sf):
    g = table(spark, sf, "lineitem", "l_returnflag", "l_linestatus", "l_extendedprice", "l_quantity").groupBy(
        "l_returnflag", "l_linestatus"
    )
    return g.agg(
        numeric.safe_ratio(F.sum("l_extendedprice"), F.sum("l_quantity")).alias("ratio"),
        numeric.safe_ratio(F.sum("l_quantity"), F.count_if(F.col("l_quantity") < 0)).alias("zero"),
    )


@query("event_uid", "run_base n:i", "trials", """
  SELECT run_base, count(DISTINCT run_base || ':' || event_uid) AS n FROM trials GROUP BY run_base""")
def _(spark, sf):
    uid = text.event_uid(F.col("run_base"), F.col("event_uid"))
    return trials(spark, sf).groupBy("run_base").agg(F.count_distinct(uid).alias("n"))
