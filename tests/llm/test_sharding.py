import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from tandem.llm import sharding


def check(rows, got, shards=8):
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        raw = (r.text or "").encode()
        assert r["size"] == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw)
        by[r.shard].append(r)
    for s, x in by.items():
        assert 0 <= s < shards and sorted(r.slot for r in x) == list(range(len(x)))
    return {s: sum(r["size"] for r in x) for s, x in by.items()}


def test_bytes_are_balanced_and_groups_together(spark):
    rows = [(i, "é" * (i * 37 % 400) + str(i), "x") for i in range(3000)] + [(i, "the same text", "x") for i in range(5000, 5100)] + [(9000, None, "x"), (9001, "", "x"), (None, "q", "x"), (1, rows0 := "é" * 37 + "1", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(5)
    for part_bytes in (sharding.PART_BYTES, 20_000):
        got = sharding.shard(df, part_bytes=part_bytes).collect()
        assert "shard_0" in got[0].asDict()
        sizes = check(rows, got)
        mean = sum(sizes.values()) / 8
        assert len(sizes) == 8 and all(abs(v - mean) <= 0.01 * mean + 900 for v in sizes.values())
        assert len({r.shard for r in got if r.text == "the same text"}) == 1


def test_a_huge_group_is_split_only_as_it_must(spark):
    rows = [(i, "copy") for i in range(900)] + [(1000 + i, f"own {i}") for i in range(300)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sizes = check(rows, got)
    assert max(sizes.values()) <= 1.05 * min(sizes.values())


def test_few_rows_and_none(spark):
    for rows in ([], [(1, "a")], [(1, "a" * 5000), (2, "b")], [(1, "a")] * 20):
        check(rows, sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_against_sorting_by_key_and_cutting_at_byte_totals(spark):
    rows = [(i, "é" * (i * 53 % 300) + str(i % 700)) for i in range(2000)] + [(i, "copy" * 50) for i in range(3000, 3400)] + [(5000, None), (None, "x"), (7, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    keys = sorted(((r.k1, r.k2, r.doc_id, r["size"], r.text) for r in sharding.keyed(df).collect()), key=lambda k: k[:2])  # no two rows are equal here
    sums = [0]
    for k in keys:
        sums.append(sums[-1] + k[3])
    for part_bytes in (sharding.PART_BYTES, 4000):
        got = {(r.doc_id, r.text): (r.shard, r.slot) for r in sharding.shard(df, tolerance=0.0, part_bytes=part_bytes).collect()}
        cuts = [min(range(len(sums)), key=lambda j: (abs(sums[j] - sums[-1] * i // 8), j)) for i in range(1, 8)]
        starts = [0, *cuts]
        for at, k in enumerate(keys):
            shard = sum(c <= at for c in cuts)
            assert got[k[2], k[4]] == (shard, at - starts[shard])


def test_buckets_against_comparing_pairs():
    import numpy as np

    rng = np.random.default_rng(4)
    keys = sorted({(int(a), int(b)) for a, b in rng.integers(0, 6, (12, 2))})
    k1, k2 = rng.integers(0, 7, 400), rng.integers(0, 7, 400)
    want = [sum(k <= (a, b) for k in keys) for a, b in zip(k1.tolist(), k2.tolist())]
    assert sharding.bucket_of(keys)(k1, k2).tolist() == want and sharding.bucket_of([])(k1, k2).tolist() == [0] * 400


def test_buckets_of_three_numbers_against_comparing():
    import numpy as np

    rng = np.random.default_rng(5)
    keys = sorted({tuple(map(int, k)) for k in rng.integers(0, 4, (20, 3))})
    rows = rng.integers(0, 5, (500, 3))
    assert sharding.bucket_of(keys)(*rows.T).tolist() == [sum(k <= tuple(r) for k in keys) for r in rows.tolist()]


def test_equal_rows_are_cut_to_the_tolerance(spark):
    n = 100_000
    df = spark.range(n).selectExpr("cast(7 as bigint) as doc_id", "repeat('equal row ', 5) as text").unionByName(spark.range(1000).selectExpr("id as doc_id", "concat('own ', id) as text"))
    for columns, part_bytes in ((["doc_id"], sharding.PART_BYTES), (None, 100_000)):
        got = sharding.shard(df, columns=columns, part_bytes=part_bytes)
        counts = [F.sum("size").alias("bytes"), F.count("*").alias("n"), F.countDistinct("slot").alias("slots"), F.max("slot").alias("top")]
        sizes = {r.shard: r for r in got.groupBy("shard").agg(*counts).collect()}
        mean = sum(r.bytes for r in sizes.values()) / 8
        assert len(sizes) == 8 and all(abs(r.bytes - mean) <= 0.005 * mean + 60 and r.n == r.slots == r.top + 1 for r in sizes.values())
        assert sum(r.n for r in sizes.values()) == n + 1000
