"""Ids, directly addressable codes, packing."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash

from sparkmap.llm import packing, tokenfiles
from sparkmap.llm.codes import Block, pack
from sparkmap.llm.encoding import ID, Encoder

WORD, BYTE = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ALPHABET = ["a", "B", "İ", "ŉ", "क़", "각", "\x01", "é", "'s", "ß", "Σ", "漢", "́", "1", "23", ".", ",", "!", "\n", "\t", " ", "  ", "<|endoftext|>", "\r\n", "ing", "'", "😀", "\x85"]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_memo_changes_no_ids(path):
    rng = random.Random(3)
    texts = [None, ""] + ["".join(rng.choice(ALPHABET) if rng.random() < 0.7 else " " for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    encoder = Encoder(path, memo_pieces=150)
    for i in range(0, len(texts), 300):
        for t, ids in zip(texts[i : i + 300], encoder.encode(texts[i : i + 300])):
            assert np.frombuffer(ids, ID).tolist() == encoder.tokenizer.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("n,top", [(0, 9), (1, 300), (511, 256), (512, 70_000), (513, 2**32), (5000, 50_000), (1500, 200)])
def test_codes(n, top):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, top, n).astype(np.uint32)
    block = Block(pack(ids))
    assert len(block) == n and [block[i] for i in range(n)] == ids.tolist()
    for _ in range(40):
        a = rng.integers(0, n + 1)
        b = rng.integers(a, n + 1)
        assert (block.slice(a, b) == ids[a:b]).all()
    with pytest.raises(IndexError):
        block[n]


def tie(text):
    h = 42 if text is None else xxhash.xxh64_intdigest(text.encode(), 42)
    return h - 2**64 if h >= 2**63 else h


def ids_of(path, text, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return [*t.encode(text or "", add_special_tokens=False).ids, end]


@pytest.mark.parametrize("block_ids", [64, 1 << 18])
def test_token_files(spark, docs, corpus, tmp_path, block_ids):
    path = str(tmp_path / "files")
    tokenfiles.write(docs, path, WORD, 2, block_ids)
    blocks = tokenfiles.read(spark, path)
    got = sorted(tokenfiles.documents(blocks).collect(), key=lambda r: r["start"])
    start, want = 0, []
    everything = []
    for d, t in sorted(((r[0], r[1]) for r in corpus), key=lambda x: (x[0] is not None, x[0] or 0, tie(x[1]))):
        ids = ids_of(WORD, t, 2)
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, ID).tobytes())))
        start += len(ids)
        everything += ids
    assert [tuple(r) for r in got] == want
    places = [0, 1, 77, start - 1, start // 2]
    found = tokenfiles.tokens_at(blocks, spark.createDataFrame([(p,) for p in [*places, None, start + 5]], "place long")).collect()
    assert {(r["place"], r["id"]) for r in found} == {(p, everything[p]) for p in places}


def test_token_files_of_nothing(spark, no_docs, tmp_path):
    tokenfiles.write(no_docs, str(tmp_path / "none"), WORD, 2)
    assert tokenfiles.documents(tokenfiles.read(spark, str(tmp_path / "none"))).count() == 0


def test_plan_uses_every_piece():
    rng = np.random.default_rng(1)
    histogram = np.bincount(rng.integers(1, 1025, 20_000), minlength=1025)
    histogram[700] += 9000  # a third of all pieces share a length
    patterns = packing.plan(histogram)
    used = np.zeros(1025, np.int64)
    for combo, times in patterns:
        assert sum(combo) <= 1024
        for length in combo:
            used[length] += times
    assert (used == histogram).all()
    even = np.bincount(rng.integers(1, 1025, 20_000), minlength=1025)
    filled = (even * np.arange(1025)).sum() / (1024 * sum(t for _, t in packing.plan(even)))
    assert filled > 0.98


def test_solution_is_not_negative_and_fits():
    histogram = np.zeros(11)
    histogram[[3, 7, 4, 6, 5]] = [10, 10, 4, 4, 8]
    combos = packing.combinations(np.flatnonzero(histogram), 10)
    x = packing.solve(combos, histogram)
    assert (x >= 0).all()
    fitted = np.zeros(11)
    for combo, n in zip(combos, x):
        for length in combo:
            fitted[length] += n
    assert np.abs(fitted - histogram).max() < 0.1


def test_pack(docs, corpus, no_docs):
    packed = packing.pack(docs, BYTE, 0)
    got = packed.digests().toPandas()
    want = sorted((-1 if r[0] is None else r[0], zlib.crc32(np.array(ids_of(BYTE, r[1], 0), ID).tobytes())) for r in corpus)
    pieces = packed.pieces.toPandas().sort_values("piece")
    whole, ids, last = [], [], None
    for p in pieces.itertuples():
        if p.start == 0 and ids:
            whole.append((last, ids))
            ids = []
        ids, last = [*ids, *p.ids], p.doc_id
    whole.append((last, ids))
    assert sorted((-1 if d is None or d != d else int(d), zlib.crc32(np.array(x, ID).tobytes())) for d, x in whole) == want
    assert len(got) == len(pieces) and got.piece.is_unique
    got = got.sort_values(["sequence_id", "offset"])
    ends = (got.offset + got.length).groupby(got.sequence_id)
    assert (ends.shift(fill_value=0) == got.offset).all() and ends.max().max() <= 1024
    windows = {r["sequence_id"]: r["ids"] for r in packed.sequences().collect()}
    assert sum(map(len, windows.values())) == got.length.sum()
    first = got.iloc[-1]
    at, n = int(first["offset"]), int(first["length"])
    part = windows[int(first["sequence_id"])][at : at + n]
    assert zlib.crc32(np.array(part, ID).tobytes()) == first.ids_crc32
    assert packing.pack(no_docs, BYTE, 0).digests().count() == 0
