"""Mixing, token files, packing and the pipeline."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import mixing, packing, token_files
from ledgerloom.llm.encoding import PieceEncoder, byte_bpe_path, word_bpe_path
from ledgerloom.session import Scratch

TEXTS = [
    None, "", " ", "a", "It's  two spaces", "tab\there\r\n", "line\nline\n\nline ", "<|endoftext|> a<|endoftext|>", "naïve café, 日本語 テキスト. 😀😀",
    "Upper lower UPPER, end.", "x" * 3000, "don't 'sfoo ''s", "12,345.67 a1b2", "a \n b\n c", "\nfirst", "é ́ ́b", "word. word, word! (word)",
]


@pytest.mark.parametrize("path,spaces", [(byte_bpe_path(), True), (word_bpe_path(), False)])
def test_pieces_give_the_ids_of_the_whole_text(path, spaces):
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice(" \n.,a'bé1") for _ in range(40)) for _ in range(300)]
    encoder = PieceEncoder(path, spaces)
    for _ in range(2):
        assert encoder.encode(texts) == [encoder.plain(t) for t in texts]


# --- mixing -----------------------------------------------------------------


@pytest.mark.parametrize("seed", range(8))
def test_schedule_stays_within_a_block(seed):
    rng = random.Random(seed)
    shares = mixing.whole_weights({f"s{i}": rng.random() ** 3 for i in range(rng.randint(1, 25))}, 400)
    plan = mixing.schedule(shares)
    assert sum(shares.values()) == len(plan) >= 400 and all(shares.values())
    assert {s: sum(x == s for x, _, _ in plan) for s in shares} == shares
    assert mixing.deviation(plan, shares) < 1
    due = {(s, j): slot for s, j, slot in plan}
    total = len(plan)
    assert all(j * total // shares[s] <= slot < -(-(j + 1) * total // shares[s]) for (s, j), slot in due.items())


def test_mix_order(spark):
    rng = random.Random(2)
    rows = [(i, "x" * rng.randint(0, 300), "hot" if i % 3 else f"s{i % 5}") for i in range(900)]
    rows += [(1000, None, None), (1001, "y", None), (None, "z", "s0"), (4, rows[4][1], rows[4][2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_order(docs, block_bytes=500).collect()
    assert sorted(map(str, (r.doc_id for r in got))) == sorted(map(str, (r[0] for r in rows)))
    before = {}
    for r in sorted(got, key=lambda r: (str(r.source), r.doc_id is None, r.doc_id or 0, r.before)):
        assert r.before == before.get(r.source, 0) and r.block == r.before // 500
        assert r.block * r.period // r.share <= r.slot < r.due_slot
        before[r.source] = r.before + r.n_bytes
    exact = [r for r in got if r.in_mix]
    last = max(r.slot for r in exact) + 1
    for r in {r.source: r for r in exact}.values():
        had = len({x.block for x in exact if x.source == r.source})
        assert abs(had - last * r.share / r.period) < 2
    with pytest.raises(ValueError):
        mixing.mix_order(docs, weights={"hot": 1})
    assert mixing.mix_order(docs.limit(0)).count() == 0
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.count() == len(rows)


@pytest.mark.parametrize("weights", [dict.fromkeys("abc", 1 / 3), {"big": 0.9} | {f"s{i}": 0.0001 for i in range(1000)}])
def test_schedule_follows_the_given_weights(weights):
    total = sum(weights.values())
    blocks = {s: int(3000 * w / total) + 2 for s, w in weights.items()}
    shares = mixing.whole_weights(weights, mixing.PERIOD)
    plan = [x[:3] for x in mixing.slots(shares, blocks)]
    assert {s: sum(x == s for x, _, _ in plan) for s in weights} == blocks
    every = {s: 0 for s in weights}
    for s, _, slot in plan:
        if slot >= 3000:
            break
        every[s] += 1
        assert abs(every[s] - weights[s] / total * (slot + 1)) < 1
    assert all(abs(n - 3000 * weights[s] / total) < 1 for s, n in every.items())


def test_mix_order_follows_the_given_weights(spark):
    weights = {"a": 0.9} | {f"s{i:03}": 0.0001 for i in range(1000)}
    rows = [(i, "x" * 10, "a") for i in range(2000)] + [(5000 + i, "y" * 10, f"s{i:03}") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_order(docs, weights, block_bytes=10).filter("slot < 1500").collect()
    total = sum(weights.values())
    assert abs(sum(r.source == "a" for r in got) - 1500 * 0.9 / total) < 1
    assert len({r.slot for r in got}) == len(got) == 1500
    equal = spark.createDataFrame([(i, "z" * 10, "abc"[i % 3]) for i in range(9000)], "doc_id long, text string, source string")
    rows = sorted(mixing.mix_order(equal, dict.fromkeys("abc", 1.0), block_bytes=10).collect(), key=lambda r: r.slot)
    had = dict.fromkeys("abc", 0)
    for k, r in enumerate(rows):
        had[r.source] += 1
        assert r.slot == k and all(abs(n - (k + 1) / 3) < 1 for n in had.values())


# --- token files ------------------------------------------------------------


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 13, 16, 17, 24, 31, 32])
def test_bit_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001).astype("<u4")
    data = token_files.pack_ids(ids, bits)
    assert len(data) == -(-1001 * bits // 8)
    assert (token_files.unpack_ids(data, bits, 1001) == ids).all()
    assert (token_files.unpack_ids(data, bits, 13, 500) == ids[500:513]).all()
    with pytest.raises(ValueError):
        token_files.pack_ids(np.array([1 << bits]), bits) if bits < 32 else token_files.pack_ids(np.array([]), 0) or (_ for _ in ()).throw(ValueError)


def test_token_files(spark, monkeypatch):
    rows = [(3 * i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (6, TEXTS[2]), (-5, "first")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scratch = Scratch(spark)
    shards = token_files.write_token_files(docs, scratch.path("ids"), shards=3, scratch=scratch)
    got = token_files.read_token_files(spark, shards).collect()
    encoder = PieceEncoder(byte_bpe_path(), True)
    want, at = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = encoder.plain(t) + bytes(4)
        want.append((i, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    first = min(shards.collect(), key=lambda r: r.shard)
    shard = token_files.Shard(first.uri)
    assert shard.bits == 16 and shard.document(0).tobytes() == encoder.plain("first") + bytes(4)
    empty = token_files.write_token_files(docs.limit(0), scratch.path("none"), shards=2, scratch=scratch)
    assert token_files.read_token_files(spark, empty).count() == 0
    scratch.close()


# --- packing ----------------------------------------------------------------


def test_best_fit_takes_the_least_room_and_closes_the_fullest():
    bins = packing.BestFit(10, 2)
    assert [bins.place(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    bins = packing.BestFit(10, 2)
    assert [bins.place(n) for n in (6, 9, 5, 1, 4)] == [(0, 0), (1, 0), (2, 0), (0, 6), (2, 5)]


@pytest.mark.parametrize("length, most", [(16, 1), (16, 3), (100, 8), (4096, 64)])
def test_best_fit_against_a_linear_scan(length, most):
    """The bitset gives what a scan of all open bins gives: least room first, the fullest closes; of equals the latest."""
    rng = random.Random(length + most)
    bins, open_bins, made = packing.BestFit(length, most), [], 0
    for _ in range(5000):
        size = rng.choice([rng.randint(1, length), rng.randint(1, max(1, length // 4)), length])
        latest = [(free, -at, number) for at, (free, number) in enumerate(open_bins)]
        fitting = [b for b in latest if b[0] >= size]
        if fitting:
            free, at, number = min(fitting)
            open_bins.pop(-at)
        else:
            if len(open_bins) >= most:
                open_bins.pop(-min(latest)[1])
            free, number, made = length, made, made + 1
        assert bins.place(size) == (number, length - free)
        if free > size:
            open_bins.append((free - size, number))
        assert bins.open == len(open_bins) <= most


def test_pack_documents(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["word", "other", "thing,"]) for _ in range(rng.randint(0, 90)))) for i in range(200)]
    rows += [(300, None), (301, ""), (302, "long " * 700), (None, "no id"), (5, rows[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack_documents(docs, length=128).collect()
    encoder = PieceEncoder(word_bpe_path(), False)
    want = []
    for i, t in rows:
        ids = encoder.plain(t) + np.array([1], "<u4").tobytes()
        want += [(str(i), k, s // 4, len(ids[s : s + 512]) // 4, zlib.crc32(ids[s : s + 512])) for k, s in enumerate(range(0, len(ids), 512))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 128
    assert len(by) <= 1.15 * sum(r.length for r in got) / 128 + 4
    whole = packing.packed_sequences(docs, length=128).collect()
    assert {r.sequence_id: r.n_tokens for r in whole} == {s: sum(n for _, n in p) for s, p in by.items()}
    assert packing.pack_documents(docs.limit(0)).count() == 0


# --- pipeline ---------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    scratch = Scratch(spark)
    before = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = scratch.cut(stage(spark, docs, sf), "stage")
        after = {r.doc_id for r in out.select("doc_id").collect()}
        assert after <= before and len(after) > 0.7 * len(before), name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        docs, before = out, after
    assert before == {r.doc_id for r in corpus_pipeline.run(spark, sf).select("doc_id").collect()}
    scratch.close()


def test_packed_sequences_follow_the_mixture(spark):
    import corpus_pipeline

    rng = random.Random(7)
    source = lambda i: "few" if i >= 540 else "many"
    rows = [(i, " ".join(rng.choice(["word", "other", "thing"]) for _ in range(300)), source(i)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)
    scratch = Scratch(spark)
    written = scratch.cut(docs, "docs")
    pack = lambda d: sorted(map(tuple, corpus_pipeline.packs(spark, scratch.cut(d, "stage"), "").collect()), key=lambda r: (r[5], r[6]))
    got, plain = pack(corpus_pipeline.mix(spark, written, "")), pack(written)
    assert sorted(r[:5] for r in got) == sorted(r[:5] for r in plain) and got != plain
    weight = 60**0.7 / (60**0.7 + 540**0.7)
    few, every, block = 0, 0, mixing.BLOCK_BYTES
    last = sum(r.n_bytes for r in mixing.mix_order(written).filter("in_mix").collect())
    per_token = sum(len(t) for _, t, _ in rows) / sum(r[3] for r in got)
    for r in got:
        every += r[3] * per_token
        few += r[3] * per_token * (source(r[0]) == "few")
        if every < last:
            assert abs(few - weight * every) < 2 * block
    assert few > 3 * block
    scratch.close()
