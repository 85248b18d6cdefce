"""Tokens, record files and packing: equality with the library, round trips, valid plans."""

import zlib

import numpy as np
import pytest
from data import SCHEMA, corpus

from tracemill.llm import checksum, common, packing, records, tokens


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, 1, "x") for r in corpus()]
    return spark.createDataFrame(rows, SCHEMA + ", ids string, part string").repartition(4)


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokens.default_path())
    return lambda text: whole.encode(text or "", add_special_tokens=False).ids


ODD = ["it's CAN'T 'Sally o'REILLY'LL", "x <|endoftext|>y z", "a\x1cb \xa0 c\x85d", "İstanbul Σας ﬁ ǆ", "12³ ½x …—", "日本語 テスト", "é é", "", " \n", None]


def test_ids_equal_those_of_the_library(reference):
    own = tokens.TextTokenizer(tokens.default_path(), keep=50)
    texts = [*ODD, *[r[1] for r in corpus()]]
    for _ in range(2):  # again, when parts are remembered or forgotten
        assert [list(np.frombuffer(x, own.dtype)) for x in own.encode(texts)] == [reference(t) for t in texts]


def test_checksums():
    rng = np.random.default_rng(1)
    data = [b"123456789", b"", b"a", b"\0" * 32, *[rng.bytes(n) for n in (3, 4, 5, 511, 512, 513, 5000)]]

    def slow(text):
        value = 0xFFFFFFFF
        for byte in text:
            value ^= byte
            for _ in range(8):
                value = value >> 1 ^ checksum.POLYNOMIAL * (value & 1)
        return value ^ 0xFFFFFFFF

    found = checksum.crc32c(data)
    assert int(found[0]) == 0xE3069283 and int(found[3]) == 0x8A9136AA
    assert [int(x) for x in found] == [slow(x) for x in data]


def test_records_round_trip(spark, docs, reference, tmp_path):
    files = records.write_records(docs, f"file://{tmp_path}/records", tokens.default_path())
    rows = sorted(((r[0], reference(r[1]) + [1]) for r in corpus()), key=lambda r: (r[0] is not None, r[0] or 0))
    got = records.read_summaries(files).orderBy("start").collect()
    start = 0
    for row, (doc_id, ids) in zip(got, rows, strict=True):
        assert tuple(row) == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    shuffled = [(r.doc_id, list(r.ids)) for r in records.read_shuffled(files, seed=3).collect()]
    key = lambda r: (str(r[0]), r[1])
    assert sorted(shuffled, key=key) == sorted(rows, key=key) and shuffled != rows
    assert records.read_summaries(records.write_records(spark.createDataFrame([], SCHEMA), common.new_path(spark, "none"), tokens.default_path())).count() == 0
    path = max(tmp_path.glob("records/*.records"), key=lambda p: p.stat().st_size)
    data = bytearray(path.read_bytes())
    data[len(data) // 2] ^= 4
    path.write_bytes(data)
    with pytest.raises(Exception, match="checksums"):
        records.read_summaries(files).collect()


def check_plan(counts, size, steps):
    rows, used = packing.plan(np.array(counts), size, steps)
    filled, placed = np.zeros(used, int), np.zeros(len(counts), int)
    for length, first, count, sequence, offset in rows:
        assert first == placed[length]
        placed[length] += count
        assert (offset <= size - length) and count > 0
        filled[sequence:sequence + count] += length
    assert (placed == counts).all() and (filled <= size).all() and (filled > 0).all()
    return used


def test_plans_are_whole_and_tight():
    rng = np.random.default_rng(0)
    for size, steps, lengths in [(64, 16, rng.integers(1, 65, 500)), (64, 64, rng.geometric(0.1, 3000).clip(1, 64)), (8, 8, [8] * 5), (8, 8, []), (8, 8, [5] * 7), (4096, 64, rng.lognormal(6, 1, 20_000).astype(int).clip(1, 4096))]:
        counts = np.bincount(np.array(lengths, int), minlength=size + 1)
        used = check_plan(counts, size, steps)
        least = -(-int((np.arange(size + 1) * counts).sum()) // size)
        assert used >= least
        if len(lengths) > 1000:
            assert used <= 1.01 * least + 1


def test_fit_is_the_best_non_negative_one():
    rng = np.random.default_rng(2)
    for _ in range(20):
        matrix, target = rng.random((8, 12)), rng.normal(size=8)
        x = packing.nonnegative_fit(matrix, target)
        gain = matrix.T @ (target - matrix @ x)
        assert (x >= 0).all() and gain.max() < 1e-6 and np.abs(gain[x > 0]).max(initial=0) < 1e-6


def test_packing(spark, docs, reference):
    want = sorted((r[0], p // 512, p, len(ids[p:p + 512]), zlib.crc32(np.array(ids[p:p + 512], "<u4").tobytes()))
                  for r in corpus() if r[0] is not None for ids in [reference(r[1]) + [1]] for p in range(0, len(ids), 512))
    pieces = common.stored(packing.pack(docs, tokens.default_path(), size=512, with_ids=True), "test-pieces")
    rows = pieces.collect()
    assert sorted(tuple(r)[:5] for r in rows if r.doc_id is not None) == want
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for held in by_sequence.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 512
    assert len(by_sequence) <= 1.02 * sum(r.length for r in rows) / 512 + 1
    made = {r.sequence_id: r for r in packing.sequences(pieces).collect()}
    assert {s: len(r.ids) for s, r in made.items()} == {s: sum(x.length for x in held) for s, held in by_sequence.items()}
    assert packing.pack(spark.createDataFrame([], SCHEMA), tokens.default_path()).count() == 0
