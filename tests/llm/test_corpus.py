"""Mixing, sharding, SimHash, line dedup, embeddings, the pipeline; each against brute force."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from sparkmap.llm import embeddings, linededup, mixing, packing, sharding, simhash
from sparkmap.llm.components import components, forest
from sparkmap.session import arrow_rows


def words(text):
    return (text or "").encode().split()


def reach(nodes, edges):
    """Least node reachable from each."""
    least = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(least[a], least[b])
            changed |= least[a] != m or least[b] != m
            least[a] = least[b] = m
    return least


def test_targets(spark):
    sized = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), ("d", 5), (None, 300), ("z", 0)], "source string, size long")
    got = {r["source"]: r for r in mixing.targets(sized).collect()}
    weights = dict(zip(["a", "b", "c", "d", "z", None], [5, 2, 1, 5, 2, 1]))
    total = 1.5 * 2315
    capped, target = set(), {}
    while True:  # water filling by rounds
        rest = total - sum(2 * got[s]["source_size"] for s in capped)
        level = rest / sum(w for s, w in weights.items() if s not in capped)
        target = {s: 2 * got[s]["source_size"] if s in capped else level * w for s, w in weights.items()}
        more = {s for s in weights if s not in capped and target[s] > 2 * got[s]["source_size"]}
        if not more:
            break
        capped |= more
    assert {s: r["target"] for s, r in got.items()} == pytest.approx(target)


def test_mix(docs, corpus, no_docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(corpus)
    assert sorted(r["size"] for r in rows) == sorted(len(words(r[1])) for r in corpus)
    by = defaultdict(list)
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by[r["source"]].append(r)
    for source, rs in by.items():
        assert rs[0]["source_size"] == sum(r["size"] for r in rs)
        assert abs(sum(r["taken"] for r in rs) - rs[0]["target"]) <= 3
    again = mixing.mix(docs.repartition(5)).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))
    assert mixing.mix(no_docs).count() == 0


def test_mixed_is_the_mix(docs, corpus, no_docs):
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    taken = sum(r["taken"] for r in mixing.mix(docs).collect())
    assert sum(len(words(r["text"])) for r in out.collect()) == taken
    texts = [r[1] for r in corpus if r[1]]
    assert all(any(t.startswith(r["text"]) for t in texts) for r in out.collect())
    assert mixing.mixed(no_docs).count() == 0


def test_better_quality_comes_first(spark):
    rows = [(i, "a", "word word word word " * 5 if i % 2 else "w# w# w# w# " * 5) for i in range(4000)]
    rows += [(10_000 + i, "b", "word " * 20) for i in range(4000)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), weights=(1, 2), share=0.75).toPandas()
    a = mixed[mixed.source == "a"]
    assert a[a.doc_id % 2 == 1].taken.sum() > 1.2 * a[a.doc_id % 2 == 0].taken.sum()


@pytest.mark.parametrize("shards", [3, 24])
def test_shard(docs, corpus, no_docs, shards):
    rows = sharding.shard(docs, shards).collect()
    assert len(rows) == len(corpus)
    want = Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in corpus)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    assert sharding.shard(no_docs).count() == 0


def test_linked_documents_meet(spark):
    rows = [(i, f"group {i // 4}") for i in range(4000)] + [(5000 + i, f"alone {i}") for i in range(4000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    together = got[got.doc_id < 5000].assign(g=lambda d: d.doc_id // 4).groupby("g").shard.agg(lambda s: s.value_counts().iloc[0])
    assert together.mean() > 3.6  # four of four is the best; by chance it would be 1.2


def brute_print(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " ", "One", "one TWO", "ä Ä b", "a b c", "a b c d e a b c", "x\x1fy\x0bz w v u t s"])
def test_fingerprint(text):
    assert simhash.fingerprint_of(text.encode() if text is not None else None) == brute_print(text)


def test_simhash(docs, corpus, no_docs):
    rows = simhash.cluster(docs).collect()
    assert len(rows) == len(corpus)
    prints = {r[0:2]: brute_print(r[1]) for r in corpus if len(r[1] or "") < 5000}
    ids = defaultdict(set)
    for r in rows:
        ids[r["fp"] % 2**64].add(r["doc_id"])
    for (doc_id, _), p in prints.items():
        assert doc_id in ids[p]
    distinct = sorted(ids)
    edges = [(a, b) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if (a ^ b).bit_count() <= 2]
    root = reach(distinct, edges)
    least = defaultdict(list)
    for p in distinct:
        least[root[p]] += [d for d in ids[p] if d is not None]
    for r in rows:
        assert r["component_id"] == min(least[root[r["fp"] % 2**64]], default=None)
    assert simhash.cluster(no_docs).count() == 0


def test_links_of_a_dense_cluster(spark, monkeypatch):
    """Fingerprints a few bits around one centre and at random, in small shards with parts."""
    monkeypatch.setattr(simhash, "PART_OWN", 20)
    monkeypatch.setattr(simhash, "PART_VISITORS", 60)
    rng = random.Random(6)
    centre = rng.getrandbits(64)
    values = {rng.getrandbits(64) for _ in range(600)}
    for _ in range(700):
        v = centre
        for _ in range(rng.randint(0, 6)):
            v ^= 1 << rng.randrange(64)
        values.add(v)
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    edges = simhash.link(spark.createDataFrame([(v,) for v in signed], "fp long"), shard=64).collect()
    want = reach(signed, [(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) % 2**64).bit_count() <= 2])
    assert reach(signed, [(r["a"], r["b"]) for r in edges]) == want


def test_one_of_each(docs, corpus, no_docs):
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    got = [r["doc_id"] for r in kept.collect()]
    want = {r["component_id"] for r in simhash.cluster(docs).collect()}
    assert len(got) == len(want) and set(got) == want
    assert simhash.one_of_each(no_docs).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(120)]
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == reach(nodes, [e for e in edges if e[0] != e[1]])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    a, b = np.array(edges).T
    node, root = forest(a, b, 401)
    linked = {x: y for x, y in zip(node.tolist(), root.tolist())}
    assert {n: linked.get(n, n) for n in nodes} == got


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_dedup(rows):
    """(doc_id, text) of each distinct row to its deduplicated text; doc_ids are distinct and not null."""
    first = {}
    for d, t in sorted(rows):
        for no, line in enumerate(t.split("\n")):
            if len(line) >= linededup.LEAST_CHARS:
                first.setdefault(line, (d, no))
    ordered = sorted(first, key=first.get)
    near = {b for i, b in enumerate(ordered) if any(abs(len(a) - len(b)) <= 1 and distance(a, b) <= 1 for a in ordered[:i])}
    return {
        d: "\n".join(x for no, x in enumerate(t.split("\n")) if x not in first or (first[x] == (d, no) and x not in near))
        for d, t in rows
    }


@pytest.mark.parametrize("paired", [24, 1])
def test_line_dedup(spark, monkeypatch, paired):
    """Edits anywhere, templates that differ in one place, very long lines; by pairs and by forms."""
    monkeypatch.setattr(linededup, "MOST_PAIRED", paired)
    rng = random.Random(paired)
    alphabet = "abé漢 x"
    base = ["".join(rng.choice(alphabet) for _ in range(n)) for n in (19, 20, 21, 30, 31, 40, 64, 129, 300, 700)]

    def edit(line):
        i, kind = rng.randrange(len(line) + 1), rng.randrange(3)
        if kind == 0:
            return line[:i] + rng.choice(alphabet) + line[i:]
        return line[:i] + ("" if kind == 1 else rng.choice(alphabet)) + line[i + 1 :]

    lines = base + [edit(b) for b in base for _ in range(4)] + [edit(edit(b)) for b in base for _ in range(3)]
    lines += [f"a template with field {i} in the middle" for i in (1, 2, 12, 21, 345, 346)] + ["", "  ", "short"]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 6)))) for i in range(60)]
    got = linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r["doc_id"]: r["text"] for r in got} == brute_dedup(rows)
    assert all(r["n_lines"] - r["n_removed"] == len(r["text"].split("\n")) or not r["text"] for r in got)


def test_line_dedup_defined_cases(docs, corpus, no_docs):
    out = linededup.dedup(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_removed"]
    rows = out.collect()
    assert len(rows) == len(corpus)
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r["text"])
    assert by[240] == [None] and by[241] == [""] and by[242] == [" \n\t "]
    assert len(set(by[5])) == 1 and len(by[5]) == 3  # rows equal in doc_id and text count as one
    copies = [by[i][0] for i in range(160, 240)]
    assert set(copies) == {""} and by[3] != [""]
    assert linededup.dedup(no_docs).count() == 0


def links_of(vectors):
    ok = {i: np.array(v, float) for i, v in vectors if v and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    links = {
        (i, j)
        for i, a in ok.items() for j, b in ok.items()
        if i != j and len(a) == len(b) and float((a / np.linalg.norm(a)) @ (b / np.linalg.norm(b))) >= embeddings.THRESHOLD
    }
    return links


@pytest.mark.parametrize("chunk", [2048, 40])
def test_embeddings(spark, monkeypatch, chunk):
    monkeypatch.setattr(embeddings, "CHUNK", chunk)
    rng = np.random.default_rng(chunk)
    centres = rng.normal(size=(6, 12))
    vectors = [centres[i % 6] + rng.normal(size=12) * [0.05, 0.2, 0.5][i % 3] for i in range(150)]
    vectors += [centres[0] + rng.normal(size=12) * 0.02 for _ in range(90)] + list(rng.normal(size=(40, 12)))
    vectors += [vectors[7]] * 60 + [vectors[8] * 5.0, rng.normal(size=5), rng.normal(size=5)]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(vectors)]
    rows += [(1000, None), (1001, []), (1002, [0.0] * 12), (1003, [1.0, None] + [0.0] * 10), (1004, [float("nan")] * 12), (1005, [float("inf")] + [0.0] * 11)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n_links", F.lit("x"))
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(df).collect()}
    links = links_of(rows)
    n = Counter(i for i, _ in links)
    root = reach([i for i, _ in rows], links)
    assert len(got) == len(rows)
    for i, _ in rows:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (n[i], root[i], root[i] == i)
    assert embeddings.near_duplicates(df.where("false")).count() == 0


def test_pipeline(spark, docs, corpus, no_docs, tmp_path):
    frame, before = docs.withColumn("n_chars", F.length("text")), None
    frame.write.parquet(str(tmp_path / "in"))
    frame = spark.read.parquet(str(tmp_path / "in"))
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frame, str(tmp_path))
        if i + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == frame.columns
        out.write.parquet(str(tmp_path / name))
        before, frame = frame, spark.read.parquet(str(tmp_path / name))
        if name == "language":
            ids = {r["doc_id"] for r in frame.collect()}
            assert not ids & {240, 241, 242, 243} and len(ids & set(range(160))) > 150
        if name == "near_dedup":
            kept = Counter(r["fp"] for r in simhash.cluster(frame).select("fp").collect())
            assert max(kept.values()) == 1
            assert {r["component_id"] for r in simhash.cluster(before).collect()} == {r["doc_id"] for r in frame.collect()}
    rows = frame.collect()
    assert len({r["piece"] for r in rows}) == len(rows)
    assert sum(r["length"] for r in rows) == sum(r["doc_tokens"] for r in rows if r["start"] == 0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, str(tmp_path)).count() == 0


def test_pack_stage_bounds_its_workers(spark, docs, monkeypatch):
    """Few rows at a time and a small memo in the stage's workers; the pieces are those of the operator, the setting comes back."""
    key, whole, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", packing.pack, {}
    before = spark.conf.get(key, None)

    def spied(*args, **named):
        seen.update(named, rows=int(spark.conf.get(key)))
        return whole(*args, **named)

    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    want = Counter(whole(docs, public_tokenizers.path("byte_bpe_50k.json"), corpus_pipeline.END_ID).digests().select(columns).collect())
    monkeypatch.setattr(packing, "pack", spied)
    got = Counter(corpus_pipeline.pack(spark, docs, "").select(columns).collect())
    assert seen["rows"] <= packing.BATCH and seen["memo_pieces"] <= 300_000
    assert spark.conf.get(key, None) == before
    assert got == want


def test_pack_stage_leaves_nothing_in_its_workers(spark, docs, monkeypatch):
    """Workers go on to other stages; vocabulary and remembered pieces do not go with them."""
    import gc

    from sparkmap.llm.encoding import Encoder

    monkeypatch.setattr(corpus_pipeline, "MEMO_PIECES", 123_457)  # tells this test's encoders from others'
    packed = {tuple(r) for r in corpus_pipeline.pack(spark, docs, "").drop("piece").collect()}

    def held(batches):
        for b in batches:
            found = [e.most for e in gc.get_objects() if isinstance(e, Encoder)]
            yield pa.RecordBatch.from_pydict({"n": pa.array([found.count(123_457)], pa.int64())})

    assert not any(r["n"] for r in spark.range(64).repartition(64).mapInArrow(held, "n long").collect())
    whole = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), corpus_pipeline.END_ID)
    assert packed == {tuple(r) for r in whole.digests().select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset").collect()}


def test_arrow_rows(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    rows = spark.range(0, 5000, numPartitions=1)
    with arrow_rows(spark, 700):
        with arrow_rows(spark, 2000):  # a smaller bound that holds already stays
            assert max(r.n for r in rows.mapInArrow(sizes, "n long").collect()) == 700
    assert max(r.n for r in rows.mapInArrow(sizes, "n long").collect()) == 5000
