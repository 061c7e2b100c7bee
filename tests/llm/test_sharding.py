import random
import zlib
from collections import defaultdict

import xxhash

from lexiquarry.llm.sharding import shard

SCHEMA = "doc_id long, text string, size string"


def rows_of(spark, data, shards=4):
    return shard(spark.createDataFrame(data, SCHEMA), shards).collect()


def test_balance_slots_and_checksums(spark):
    data = [(i, "w%d " % i * (1 + i % 37), "x") for i in range(3000)] + [(9000 + i, "same text " * 20, None) for i in range(1500)]
    got = rows_of(spark, data)
    want = {i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t, _ in data}
    assert {r.doc_id: (r.size, r.text_crc32) for r in got} == want
    total, by = sum(s for s, _ in want.values()), defaultdict(list)
    for r in got:
        by[r.shard].append(r)
        assert r.law == "bytes" and r.grown_shard is None
    assert sorted(by) == [0, 1, 2, 3]
    for rows in by.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
        assert abs(sum(r.size for r in rows) - total / 4) < 0.02 * total / 4


def test_equal_texts_stay_together(spark):
    data = [(i, "text %d" % (i // 3) + " pad" * 40, "") for i in range(3000)]
    by = defaultdict(set)
    for r in rows_of(spark, data):
        by[r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in by.values())


def test_nulls_ties_empty(spark):
    assert rows_of(spark, []) == []
    got = rows_of(spark, [(None, None, None), (1, "", None), (1, "", None), (2, None, "a"), (3, "ü" * 100_000, "b")])
    assert len(got) == 5 and {r.size for r in got} == {1, 200_001}
    assert all(r.text_crc32 == 0 for r in got if r.size == 1)


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def plain(data, shards):
    """Rows in order of the text's hash; each group of equal texts goes where its middle byte falls."""
    low = (1 << 23) - 1
    rows = [(signed(xxhash.xxh64((t or "").encode(), seed=42).intdigest()) if t is not None else 42, len((t or "").encode()) + 1, i, t) for i, t, _ in data]
    groups = defaultdict(list)
    for h, size, i, t in rows:
        groups[h & ~low, h].append((size, i))
    total, at, out = sum(r[1] for r in rows), 0, {}
    for key in sorted(groups):
        size = sum(x for x, _ in groups[key])
        for _, i in groups[key]:
            out[i] = min(shards - 1, (2 * at + size) * shards // (2 * total))
        at += size
    return out


def test_equals_a_plain_version(spark):
    for seed in range(4):
        rng = random.Random(seed)
        data = [(i, rng.choice(["a b", "c", "", None, "ü"]) if rng.random() < 0.02 else f"text {seed} {rng.randrange(2000)} " + "x" * rng.randrange(60), "") for i in range(4000)]
        got = rows_of(spark, data, 5)
        assert {r.doc_id: r.shard for r in got} == plain(data, 5)
        for s in range(5):
            assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_groups_under_a_hundredth_of_a_shard_are_never_split(spark):
    for seed in range(3):
        data = [(i, "group %d of %d " % (i // 40, seed) + "pad" * 9, "") for i in range(40 * 960)]
        shards, ranges = defaultdict(set), defaultdict(set)
        for r in rows_of(spark, data, 8):
            shards[r.text_crc32].add(r.shard)
            ranges[r.text_crc32].add(r.range_id)
        assert all(len(x) == 1 for x in [*shards.values(), *ranges.values()])


def test_one_row_repeated_is_split(spark):
    data = [(None, None, None)] * 3000 + [(5, "the very same row", None)] * 3000 + [(i, f"other {i}", None) for i in range(10, 1000)]
    got = rows_of(spark, data, 4)
    total, size, ranges = sum(r.size for r in got), defaultdict(int), defaultdict(int)
    for r in got:
        size[r.shard] += r.size
        ranges[r.range_id] += 1
    assert len(got) == len(data) and max(size.values()) - min(size.values()) < 0.03 * total / 4
    assert max(ranges.values()) < 1500
