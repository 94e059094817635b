import zlib
from collections import defaultdict

import pytest

from kernloom.llm.sharding import op2_sharding, shard_by_bytes


def holds(rows, texts, shards, slack):
    assert len(rows) == len(texts)
    sizes, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    mean = sum(sizes.values()) / shards
    assert max(sizes.values()) <= mean * (1 + slack) and min(sizes[i] for i in range(shards)) >= mean * (1 - slack)


def test_hot_text_is_split_and_sizes_are_near(spark):
    texts = {i: "hot copy " * 20 for i in range(4000)} | {i: f"text {i} " * (i % 40) for i in range(4000, 12000)}
    df = spark.createDataFrame([(i, t, "z") for i, t in texts.items()], "doc_id bigint, text string, shard string").repartition(8)
    rows = op2_sharding(df).collect()
    holds(rows, texts, 40, 0.04)
    assert {(r.doc_id, r.size, r.text_crc32) for r in rows} == {
        (i, len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in texts.items()
    }
    again = {r.doc_id: (r.shard, r.slot) for r in op2_sharding(df.repartition(3)).collect()}
    assert again == {r.doc_id: (r.shard, r.slot) for r in rows}


def test_light_groups_stay_whole(spark):
    rows = shard_by_bytes(
        spark.createDataFrame([(i, f"group {i // 4} " * 5) for i in range(20000)], "doc_id bigint, text string"), samples=3000
    ).collect()
    where = defaultdict(set)
    for r in rows:
        where[r.text].add(r.shard)
    assert all(len(s) == 1 for s in where.values())


@pytest.mark.parametrize("rows", [[], [(None, None)], [(1, "a"), (1, "a"), (None, ""), (2, None)]])
def test_small_and_null(spark, rows):
    out = op2_sharding(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(out) == len(rows)
    assert sorted(r.size for r in out) == sorted(len((t or "").encode()) + 16 for _, t in rows)


def test_one_row_repeated_and_null_ids_are_parted(spark):
    rows = [(7, "same " * 9)] * 6000 + [(None, "none " * 9)] * 6000 + [(i, f"other {i} " * 5) for i in range(100, 4100)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)
    out = op2_sharding(df).collect()
    holds(out, rows, 40, 0.08)
    assert len({r.shard for r in out if r.doc_id == 7}) > 8


def test_groups_that_fit_stay_whole(spark):
    # groups of a thirtieth of a shard have several samples each, and stay together
    rows = [(i, f"group {i // 10} " * 5) for i in range(12000)]
    out = op2_sharding(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    where = defaultdict(set)
    for r in out:
        where[r.doc_id // 10].add(r.shard)
    assert all(len(s) == 1 for s in where.values())
    holds(out, rows, 40, 0.08)
