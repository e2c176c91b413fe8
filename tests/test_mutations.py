import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from keytide.functions import hashing
from keytide.operators import counting, frequent, mutations


def one_by_one(ops):
    now, out = {}, []
    for i, k, op, c in ops:
        c, before = c or 0, now.get(k, 0)
        after = before + c if op == "insert" else max(0, before - c) if op == "remove" else (c or before) if op == "set" else 0 if op == "delete" else before
        now[k] = after
        out.append((i, k, op, c, after, after - before))
    return out, {k: v for k, v in now.items() if v}


@pytest.mark.parametrize("block_rows", [7, 64, 1 << 20])
def test_mutations_equal_a_dictionary(spark, block_rows):
    r = random.Random(block_rows)
    hot = lambda: r.choice([1, 1, 1, 2, 3, None, r.randrange(40)])
    kinds = ["insert"] * 5 + ["remove"] * 4 + ["set", "delete", "other"]
    ops = [(i, hot(), r.choice(kinds), r.choice([0, 1, 1, 2, 5, 9, None])) for i in range(1500)]
    ops += [(i, 77, "remove" if i % 3 else "insert", i % 5) for i in range(1500, 2500)]  # no set or delete
    df = spark.createDataFrame(ops, "idx long, key int, op string, count long").withColumn("before", F.lit("x"))
    rows, left = one_by_one(ops)
    got = mutations.apply_in_order(df.repartition(5), block_rows)
    assert got.columns == [*df.columns, "now", "applied"]
    assert sorted((x.idx, x.key, x.op, x["count"] or 0, x.now, x.applied) for x in got.collect()) == sorted(rows, key=lambda x: x[0])
    assert {x.key: x["count"] for x in mutations.counts_after(df, block_rows).collect()} == left


def test_mutations_of_no_rows(spark):
    none = spark.createDataFrame([], "idx long, key long, op string, count long")
    assert mutations.apply_in_order(none).count() == 0 and mutations.counts_after(none).count() == 0


@pytest.mark.parametrize("kind", ["long", "string"])
def test_candidates_hold_all_heavy_hitters(spark, kind):
    r = random.Random(3)
    keys = [r.choice([1, 2, 3, r.randrange(20), r.randrange(5000), None]) for _ in range(20_000)]
    df = spark.createDataFrame([(None if k is None else k if kind == "long" else f"k{k}", r.choice([1, 1, 3])) for k in keys], f"key {kind}, w int").repartition(6)
    for threshold, weight in ((300, None), (900, "w"), (1, None), (19_000, None)):
        got = frequent.heavy_hitters(df, "key", threshold, weight)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, counting.heavy_hitters(df, "key", threshold, weight).collect()), key=str)
    # what is shuffled: summaries, then candidates counted in each partition
    most = 2 * 20_000 // 300 + 1
    told = frequent.summaries(df, "key", most)
    assert told.count() <= 6 * (most + 1)
    count = Counter(x.key for x in df.collect() if x.key is not None)
    error = told.agg(F.sum("error")).first()[0]
    assert error <= 20_000 / most
    sums = {x.key: x.n for x in told.where("key is not null").groupBy("key").agg(F.sum("n").alias("n")).collect()}
    assert all(sums.get(k, 0) <= n <= sums.get(k, 0) + error for k, n in count.items())
    few = frequent.candidates(df, "key", 300, most)
    assert len(count) > 10 * few.count() and few.count() <= most
    assert frequent.heavy_hitters(df.limit(0), "key", 5).count() == 0


def test_places_in_hash_order(spark):
    keys = sorted(random.Random(5).sample(range(1 << 47), 3000))
    df = spark.createDataFrame([(k, v, 1) for k in keys for v in (0, 1)], "key long, value int, count int")
    order = sorted((h, v, k) for k, h in ((x.key, x.h) for x in df.select("key", hashing.hash_64(F.col("key")).alias("h")).distinct().collect()) for v in (0, 1))
    for first, n in ((0, 5), (1000, 700), (5990, 100), (7000, 3)):
        got = counting.at_places(df, first, n)
        assert sorted((x.place, x.hash, x.value, x.key) for x in got.collect()) == [(first + i, *x) for i, x in enumerate(order[first : first + n])]
        assert "Sort [" not in got._jdf.queryExecution().optimizedPlan().toString()  # no order over all


def test_page_in_hash_order_hashes_in_few_steps(spark):
    keys = random.Random(6).sample(range(1 << 47), 500)
    rows = spark.createDataFrame([(k,) for k in [*keys, *keys[:100], None]], "key long")
    page = counting.in_hash_order(counting.keyed_count(rows, "key"), 1 << 47).limit(50)
    hashes = dict(rows.where("key is not null").select("key", hashing.hash_64(F.col("key"))).collect())
    want = sorted((h, k, 2 if k in keys[:100] else 1) for k, h in hashes.items() if h >= 1 << 47)[:50]
    assert [(r.hash, r.key, r["count"]) for r in page.collect()] == want
    assert page._jdf.queryExecution().optimizedPlan().toString().count("key#") < 200  # each once a row where the filter stands
