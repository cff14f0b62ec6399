import zlib

import numpy as np
import xxhash

from folioflux.llm.sharding import assign_shards, jump_hash, op6_shards


def plain_jump(key, shards):
    at, nxt = -1, 0
    while nxt < shards:
        at = nxt
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        nxt = int((at + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return at


def test_jump_hash_equals_the_published_loop():
    keys = np.random.default_rng(1).integers(0, 1 << 64, 3000, dtype=np.uint64)
    for shards in (1, 2, 8, 9, 1000):
        got = jump_hash(keys, shards)
        assert got.tolist() == [plain_jump(int(k), shards) for k in keys]


def test_appended_shards_take_rows_only_into_themselves():
    keys = np.random.default_rng(2).integers(0, 1 << 64, 50_000, dtype=np.uint64)
    before, after = jump_hash(keys, 8), jump_hash(keys, 9)
    moved = before != after
    assert (after[moved] == 8).all() and abs(moved.mean() - 1 / 9) < 0.01
    counts = np.bincount(before, minlength=8)
    assert counts.min() > 0.95 * 50_000 / 8


def test_digest(spark):
    texts = [None, "", "é", "abc", "abc"]
    docs = spark.createDataFrame([(k if k != 3 else None, t, k) for k, t in enumerate(texts)], "doc_id long, text string, shard int")
    rows = op6_shards(docs).collect()
    assert len(rows) == 5 and {r.law for r in rows} == {"key"}
    by = {r.doc_id: r for r in rows}
    assert (by[0].size, by[2].size, by[2].text_crc32) == (1, 3, zlib.crc32("é".encode()))
    assert all(r.shard == plain_jump(xxhash.xxh64_intdigest(("" if r.doc_id is None else str(r.doc_id)).encode()), 8) for r in rows)
    assert op6_shards(docs.limit(0)).count() == 0


def test_slots_are_gapless_in_small_buckets(spark):
    rows = spark.range(2000).selectExpr("id % 700 as doc_id", "id as extra")
    got = assign_shards(rows, "doc_id", 8, rows_per_bucket=10).collect()
    for shard in range(8):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert len({(r.shard, r.slot) for r in got}) == 2000
