"""Readers, writers, file inventories and the incremental ingest."""

import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from sparkmap.operators import eligibility
from sparkmap.operators.response import cut_epochs
from sparkmap.sources import files, tables
from sparkmap.streaming import runs


def test_csv_round_trip_and_refusal(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", None), (1, "a", 1.5)], "k int, t string, x double")
    out = str(tmp_path / "t")
    tables.write_sorted_csv_gz(df, out, ["k"])
    text = "".join(gzip.open(p, "rt").read() for p in sorted((tmp_path / "t").glob("*.gz")))
    assert [line[0] for line in text.splitlines() if line[0] in "12"] == ["1", "2"]
    assert {tuple(r) for r in tables.read_csv(spark, out, "k int, t string, x double").collect()} == {(1, "a", 1.5), (2, "b", None)}
    with pytest.raises(Exception, match="exist"):
        tables.write_sorted_csv_gz(df, out, ["k"])
    tables.write_table(df, str(tmp_path / "p"))
    with pytest.raises(Exception, match="exist"):
        tables.write_table(df, str(tmp_path / "p"))


def test_read_tree(spark, tmp_path):
    for sub, ses, body in (("01", "a", "name\tx\nE1\t1\n"), ("02", "b", "name\ty\nE2\t2\n")):
        d = tmp_path / f"sub-{sub}" / f"ses-{ses}"
        d.mkdir(parents=True)
        (d / f"sub-{sub}_ses-{ses}_electrodes.tsv").write_text(body)
    globs = [f"{tmp_path}/sub-01/*/*.tsv", f"{tmp_path}/sub-02/*/*.tsv"]
    got = {tuple(r)[:2] + tuple(r)[3:] for r in tables.read_tree(spark, globs, wanted=["name", "x", "z"]).collect()}
    assert got == {("01", "a", "E1", "1", None), ("02", "b", "E2", None, None)}


def test_read_cells(spark, tmp_path):
    """Headers that differ from file to file, rows that are short, names that agree in lower case."""
    for sub, body in (("01", "name\tx\tX\nE1\t1\t9\nE2\n"), ("02", "Z\tname\nq\tE3\n\n"), ("03", "name\tx\n")):
        (tmp_path / f"sub-{sub}").mkdir()
        (tmp_path / f"sub-{sub}" / "electrodes.tsv").write_text(body)
    cells = tables.read_cells(spark, [f"{tmp_path}/*/*.tsv"], ["sub"])
    got = sorted(((r.sub, r.columns, r.cells) for r in cells.collect()), key=lambda r: (r[0], r[2]["name"]))
    assert got == [("01", ["name", "x", "X"], {"name": "E1", "x": "1"}), ("01", ["name", "x", "X"], {"name": "E2", "x": None}), ("02", ["Z", "name"], {"z": "q", "name": "E3"})]
    evidence = {(r.file[-21:-15], r.column_name): (r.n_rows, r.n_present, r.numeric_share) for r in tables.column_evidence(cells).collect()}
    assert evidence[("sub-01", "x")] == (2, 1, 1.0) and evidence[("sub-02", "z")] == (1, 1, 0.0)


def test_interface_audit(spark):
    cells = spark.createDataFrame(
        [("a", ["name", "x", "y", "z", "x_mni", "y_mni", "z_mni"], {"name": "E1", "x": "1", "y": "2", "z": "nan"}),
         ("a", ["name", "x", "y", "z", "x_mni", "y_mni", "z_mni"], {"name": "E2", "x": "1", "y": "2", "z": "3"}),
         ("b", ["name", "Region"], {"name": "E3"})], "subject string, columns array<string>, cells map<string,string>",
    )
    systems = spark.createDataFrame([("a", "MNI152Lin", "Millimeters"), ("a", None, None)], "subject string, system string, units string")
    recordings = spark.createDataFrame([("a", 512.0, 50, None, "M")], "subject string, sampling double, line int, reference string, manufacturer string")
    pairs = spark.createDataFrame([("a", "E1-E2", "E1", "E2"), ("a", "E1-Q", None, None)], "subject string, label string, contact_a string, contact_b string")
    got = {r.subject: r for r in eligibility.interface_audit(cells, systems, recordings, pairs).collect()}
    a, b = got["a"], got["b"]
    assert (a.n_electrodes, a.n_xyz, a.candidate_mni_triplets, a.direct_mni_columns, a.direct_mni_system, a.unit_mm) == (2, 1, "x_mni|y_mni|z_mni", True, True, True)
    assert (a.coordinate_systems, a.sampling_frequencies, a.reference_electrodes, a.stim_pair_match_fraction) == ("MNI152Lin|UNKNOWN", "512.0", "", 0.5)
    assert (b.atlas_columns, b.n_xyz, b.coordinate_systems, b.n_unique_stim_sites, b.stim_pair_match_fraction) == ("Region", 0, "", 0, None)


def test_pick_column(spark):
    df = spark.createDataFrame([(1, 2)], "Subject_ID int, x int")
    assert tables.pick_column(df, ["subject", "subject_id"]) == "Subject_ID"
    with pytest.raises(ValueError):
        tables.pick_column(df, ["subject_id", "x"], strict=True)


def test_file_inventory_and_guard(spark, tmp_path):
    (tmp_path / "derivatives").mkdir()
    (tmp_path / "a.txt").write_bytes(b"hello")
    (tmp_path / "derivatives" / "atlas.tsv").write_bytes(b"x")
    rows = {r["file_name"]: r for r in files.file_inventory(spark, str(tmp_path)).collect()}
    assert rows["a.txt"]["sha256"] == hashlib.sha256(b"hello").hexdigest()
    assert rows["a.txt"]["git_blob"] == hashlib.sha1(b"blob 5\0hello").hexdigest()
    paths = files.path_table(spark, str(tmp_path))
    assert files.guard_sources(paths, [".eeg"]).count() == 2
    with pytest.raises(Exception, match="forbidden source"):
        files.guard_sources(paths, [".eeg"], ["derivatives"]).collect()
    assert [(r["suffix"], r["is_derivative"]) for r in files.candidate_paths(paths, ["atlas"]).collect()] == [(".tsv", True)]


def test_large_files_are_hashed_in_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "BLOCK_BYTES", 1000)
    for name, body in (("a b.bin", b"x" * 12_345), ("c.bin", b""), ("d.bin", bytes(range(256)) * 50)):
        (tmp_path / name).write_bytes(body)
    whole = {r.file_name: tuple(r)[2:] for r in files.file_inventory(spark, str(tmp_path), "*.bin").collect()}
    blocks = {r.file_name: tuple(r)[2:] for r in files.file_inventory(spark, str(tmp_path), "*.bin", whole_bytes=100).collect()}
    assert whole == blocks and len(whole) == 3


def test_a_file_of_three_gigabytes(spark, tmp_path):
    with open(tmp_path / "sparse.bin", "wb") as f:  # takes no room
        f.truncate(3 << 30)
    (row,) = files.file_inventory(spark, str(tmp_path)).collect()
    zeros, want = bytes(1 << 24), hashlib.sha256()
    for _ in range((3 << 30) >> 24):
        want.update(zeros)
    assert row.length == 3 << 30 and row.sha256 == want.hexdigest()


def test_manifest_diff(spark):
    f = lambda *r: spark.createDataFrame(list(r), "path string, sha256 string")
    got = files.manifest_diff(f(("same", "1"), ("changed", "2"), ("new", "3")), f(("same", "1"), ("changed", "9"), ("gone", "4")))
    assert {tuple(r) for r in got.collect()} == {("changed", "changed"), ("new", "extra"), ("gone", "missing")}


def test_incremental_ingest_reads_each_file_once(spark, tmp_path):
    src, dst, ck = (str(tmp_path / n) for n in ("src", "dst", "ck"))
    df = spark.range(6).select(F.concat(F.lit("run"), F.col("id") % 2).alias("run_base"), F.col("id").alias("v"))
    df.where("v < 4").write.mode("append").parquet(src)
    for _ in range(2):  # the second call finds nothing new
        runs.ingest_runs_incremental(spark, src, df.schema, dst, ck, lambda b: b.withColumn("v", F.col("v") * 10))
    assert spark.read.parquet(dst).count() == 4
    df.where("v >= 4").write.mode("append").parquet(src)
    runs.ingest_runs_incremental(spark, src, df.schema, dst, ck, lambda b: b.withColumn("v", F.col("v") * 10))
    assert sorted(r["v"] for r in spark.read.parquet(dst).collect()) == [0, 10, 20, 30, 40, 50]


def test_samples_across_files(spark, tmp_path):
    """A window over two files, a late file, a repeated batch, and a gate that waits for the last run."""
    src, folder, out = str(tmp_path / "src"), str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(run, i, float(i * (1 + k))) for k, run in enumerate(("01", "02")) for i in range(20)]
    df = spark.createDataFrame(rows, "run_base string, sample_idx long, value double")
    events = spark.createDataFrame([("01", 7, 5, 15), ("02", 8, 8, 12)], "run_base string, event int, lo long, hi long")
    expected = spark.createDataFrame([("01", 20), ("02", 20)], "run_base string, n_rows long")
    cut = lambda b: cut_epochs(events, b, ["run_base"], 4).select("run_base", "event", "sample_idx", "value")
    extract = lambda p: p.groupBy("run_base", "event").agg(F.count("value").alias("n"), F.sum("value").alias("total"))
    columns = extract(cut(df)).schema
    go = lambda: runs.ingest_samples(spark, src, df.schema, expected, cut, extract, folder, max_files=1)
    trials = lambda: sorted(map(tuple, spark.read.parquet(f"{folder}/trials").select("event", "n", "total").collect()))
    for part in ("sample_idx < 10", "sample_idx >= 10 AND run_base = '01'", "sample_idx BETWEEN 10 AND 14 AND run_base = '02'"):
        df.where(part).coalesce(1).write.mode("append").parquet(src)
    go()
    assert trials() == [(7, 10, float(sum(range(5, 15))))]  # the window reaches over two files
    report = {r.run_base: r.status for r in runs.ledger_report(expected, runs.ledger(spark, folder)).collect()}
    assert report == {"01": "completed", "02": "open"}
    with pytest.raises(RuntimeError, match="1 of 2 runs"):
        runs.finalise(spark, expected, columns, folder, out)
    df.where("sample_idx >= 15 AND run_base = '02'").coalesce(1).write.mode("append").parquet(src)  # the late file
    go()
    assert trials() == [(7, 10, float(sum(range(5, 15)))), (8, 4, 2.0 * sum(range(8, 12)))]
    last = max((tmp_path / "in" / "checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()  # as if the job had died before the commit of its last batch
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    go()
    assert len(trials()) == 2 and runs.ledger(spark, folder).agg(F.sum("n_rows")).first()[0] == 40
    assert {r.event: r.n for r in runs.finalise(spark, expected, columns, folder, out).collect()} == {7: 10, 8: 4}
    with pytest.raises(Exception, match="exist"):
        runs.finalise(spark, expected, columns, folder, out)
    more = spark.createDataFrame([("01", 20), ("02", 20), ("03", 5)], "run_base string, n_rows long")
    assert {r.status for r in runs.ledger_report(more, runs.ledger(spark, folder)).collect()} == {"completed", "waiting"}
    less = spark.createDataFrame([("01", 19)], "run_base string, n_rows long")
    assert {r.status for r in runs.ledger_report(less, runs.ledger(spark, folder)).collect()} == {"overfull", "unexpected"}


def test_progress(spark):
    f = lambda *r: spark.createDataFrame([(x,) for x in r], "run_base string")
    report = runs.progress_report(f("a", "b", "c"), f("a"), f("a", "b", "x"))
    assert {r["run_base"]: r["status"] for r in report.collect()} == {"a": "completed", "b": "ready", "c": "waiting", "x": "unexpected"}
    assert tuple(runs.finalise_gate(report).first()) == (3, 1, False)
