import os
import random
import re
from collections import OrderedDict

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from keytide.functions import hashing
from keytide.operators import bias, reports, scoring
from keytide.sources import generators, streams
from keytide.streaming import timely


def parts_of(seed, n=3000, keys=60):
    r = random.Random(seed)
    rows, at = [], {}
    for i in range(n):
        k = (i // 150 * 5 + r.randrange(12)) % keys  # a few at a time
        c = at.get(k, 0) + 1 if r.random() < 0.93 else r.randint(0, 5)
        at[k] = c if c < 5 else 0
        rows.append((i, k, r.choice(["00", "01", "10", "11"]) if c == 5 else r.choice(["0", "0", "0", "1", "0x", "2"]), c))
    return rows


def two_tables(rows, capacity, shards, threshold, most_ones, inner_shard):
    """(assembled, labels) by two dictionaries in order of use, as a worker with bounded tables has them."""
    made, labels = [], []
    for shard in range(shards):
        live = OrderedDict()
        for i, k, v, c in rows:
            if k % shards != shard:
                continue
            if k not in live:
                if c <= 1:
                    if len(live) == capacity:
                        del live[next(iter(live))]
                    live[k] = [1, int(re.match(r"\d*", v)[0] or 0)]
            elif live[k][0] != c - 1:
                del live[k]
            elif c <= 4:
                live[k] = [c, live[k][1] | int(re.match(r"\d*", v)[0] or 0) << 16 * (c - 1)]
                live.move_to_end(k)
            else:
                inner = live.pop(k)[1]
                made.append((i, k, inner - (1 << 64) if inner >> 63 else inner, int(v[1] != "0"), int(v[0] != "0")))
    tables = {}
    for i, k, inner, value, truth in sorted(made):
        t = tables.setdefault(inner_shard(k, inner), OrderedDict())
        if inner not in t and len(t) == capacity:
            del t[next(iter(t))]
        n, ones = t.pop(inner, (0, 0))
        t[inner] = (n + 1, ones + value)
        if n + 1 == threshold:
            few = ones + value <= most_ones
            labels.append((inner, i, ones + value, truth, {(1, 1): "true_anomaly", (1, 0): "false_positive", (0, 1): "false_negative", (0, 0): "true_negative"}[int(few), truth]))
    return sorted(made), sorted(labels)


def test_two_bounded_tables_against_dictionaries(spark):
    rows = parts_of(1)
    parts = spark.createDataFrame(rows, "idx long, okey long, val string, cnt int").repartition(5)
    for capacity, shards in ((7, 1), (9, 3), (1000, 2)):
        made, labels = two_tables(rows, capacity, shards, 3, 1, lambda k, inner: inner % shards)
        got = bias.assemble_bounded(parts, capacity, shards)
        assert sorted((x.idx, x.okey, x.key, x.value, x.truth) for x in got.collect()) == made and made
        judged = bias.two_level_lru(parts, capacity, shards, threshold=3, most_ones=1).collect()
        assert sorted((x.key, x.idx, x.ones, x.truth, x.label) for x in judged) == labels and labels


def test_epochs_over_block_borders(spark):
    r = random.Random(2)
    rows = [(i, r.randrange(12) if r.random() < 0.7 else r.randrange(80)) for i in range(4000)]
    s = spark.createDataFrame(rows, "idx long, key long").withColumns({"value": F.lit(0), "truth": F.lit(0)}).repartition(4)
    live, epoch, want = {}, {}, []
    for i, k in rows:
        t = live.setdefault(k % 2, OrderedDict())
        if k not in t:
            epoch[k] = epoch.get(k, 0) + 1
            if len(t) == 9:
                t.popitem(last=False)
        t[k] = 1
        t.move_to_end(k)
        want.append((i, k, epoch[k]))
    for block in (50, 700, 10_000):  # blocks with fewer rows than the table has keys, too
        assert sorted((x.idx, x.key, x.epoch) for x in bias.lru_epochs(s, 9, 2, block).collect()) == want


def test_bounded_streaming_equals_batch(spark, tmp_path):
    rows = parts_of(3, 1500, 40)
    table = pd.DataFrame(rows, columns=["idx", "okey", "val", "cnt"]).astype({"cnt": "int32"})
    one = table.assign(key=table.okey, value=(table.cnt % 2).astype("int32"), truth=(table.okey % 3 == 0).astype("int32"))
    for name, frame, start in (("parts", table, lambda s: timely.two_level_bias(s, 9, 2, 3, 1)), ("keys", one[["idx", "key", "value", "truth"]], lambda s: timely.bounded_bias(s, 9, 2, 5, 2))):
        os.makedirs(tmp_path / name)
        for k in range(3):
            frame.iloc[500 * k : 500 * (k + 1)].sample(frac=1, random_state=k).to_parquet(tmp_path / name / f"{k}.parquet")
            os.utime(tmp_path / name / f"{k}.parquet", (1000 + k, 1000 + k))
        whole = spark.createDataFrame(frame)
        source = spark.readStream.schema(spark.read.parquet(str(tmp_path / name)).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
        q = start(source).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"cp-{name}")).option("path", str(tmp_path / f"out-{name}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        got = sorted((x.key, x.idx, x.ones, x.truth, x.label) for x in spark.read.parquet(str(tmp_path / f"out-{name}")).collect())
        if name == "parts":
            want = two_tables(rows, 9, 2, 3, 1, lambda k, inner: k % 2)[1]
        else:
            want = sorted((x.key, x.idx, x.ones, x.truth, x.label) for x in bias.lru_classify(whole, 9, 2, 5, 2).collect())
        assert got == want and got


def lookup3(data: bytes, seed: int) -> int:
    """Jenkins' hash of any bytes, to compare with: checked by its published value."""
    m, rot = 0xFFFFFFFF, lambda x, k: (x << k | x >> 32 - k) & 0xFFFFFFFF
    a = b = c = 0xDEADBEEF + len(data) + seed & m
    while len(data) > 12:
        a, b, c = (x + int.from_bytes(data[4 * k : 4 * k + 4], "little") & m for k, x in enumerate((a, b, c)))
        a = (a - c ^ rot(c, 4)) & m; c = c + b & m; b = (b - a ^ rot(a, 6)) & m; a = a + c & m; c = (c - b ^ rot(b, 8)) & m; b = b + a & m  # noqa: E702
        a = (a - c ^ rot(c, 16)) & m; c = c + b & m; b = (b - a ^ rot(a, 19)) & m; a = a + c & m; c = (c - b ^ rot(b, 4)) & m; b = b + a & m  # noqa: E702
        data = data[12:]
    data += bytes(12 - len(data))
    a, b, c = (x + int.from_bytes(data[4 * k : 4 * k + 4], "little") & m for k, x in enumerate((a, b, c)))
    for x, y, k in (("c", "b", 14), ("a", "c", 11), ("b", "a", 25), ("c", "b", 16), ("a", "c", 4), ("b", "a", 14), ("c", "b", 24)):
        v = {"a": a, "b": b, "c": c}
        v[x] = (v[x] ^ v[y]) - rot(v[y], k) & m
        a, b, c = v["a"], v["b"], v["c"]
    return c


def test_hash_rule_of_workers(spark):
    assert lookup3(b"Four score and seven years ago", 0) == 0x17770551
    keys = np.random.default_rng(1).integers(1 << 63, size=500).astype(np.uint64)
    assert hashing.hashlittle(keys).tolist() == [lookup3(int(k).to_bytes(8, "little"), 12345) for k in keys]
    rows = spark.createDataFrame([(int(k),) for k in keys[:50]], "key long").select("key", hashing.hashed_partition_of(F.col("key"), 7).alias("w")).collect()
    assert all(x.w == lookup3(x.key.to_bytes(8, "little"), 12345) % 7 for x in rows)


def test_captured_keys_are_read_again(spark, tmp_path):
    s = generators.powerlaw(spark, 40)
    packets = streams.to_packets(s)
    streams.capture_keys(packets, str(tmp_path / "keys"))
    want = [x.key for x in streams.captured_keys(packets).orderBy("packet_id", "pos").collect()]
    got = streams.read_binary_keys(spark, str(tmp_path / "keys"), chunk_keys=300).orderBy("idx").collect()
    assert [x.key for x in got] == want and [x.idx for x in got] == list(range(2000))
    (tmp_path / "odd").write_bytes(b"\x01" + bytes(7) + b"\x05")
    assert [(x.idx, x.key) for x in streams.read_binary_keys(spark, str(tmp_path / "odd")).collect()] == [(0, 1)]
    (tmp_path / "none").write_bytes(b"")
    assert streams.read_binary_keys(spark, str(tmp_path / "none")).count() == 0


def test_several_senders(spark):
    a, b = (generators.powerlaw(spark, 4, sender=k) for k in (0, 1))
    assert a.agg(F.max("key")).first()[0] < 2 * generators.OFFSET <= b.agg(F.min("key")).first()[0]
    ids = [sorted(x.packet_id for x in streams.to_packets(s, sender=k, senders=2).collect()) for k, s in enumerate((a, b))]
    assert ids == [[0, 2, 4, 6], [1, 3, 5, 7]]


def test_lines_with_the_value_first(spark):
    lines = ["12 packets received", "a 3 4 5 max key", "7 9", "foo 5", "only words here", "one", "  2.5   rate ", "", "x 1 y 2 z"]

    def plain(line):
        w = line.split()
        digit = [x[0].isdigit() for x in w]
        k = max([i for i, d in enumerate(digit) if d], default=-1) + 1
        k = min(k, len(w) - 1)
        j = k - 1
        while j >= 0 and digit[j]:
            j -= 1
        return " ".join(w[k:]), w[j + 1]

    got = scoring.parsed_reversed_lines(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert sorted((x.name, x.value) for x in got) == sorted(plain(x) for x in lines if x.strip())


def test_quantiles_and_running_sums(spark):
    r = np.random.default_rng(3)
    for x in (r.normal(size=40_000), r.integers(5, size=3000).astype(float), np.array([1.0]), np.array([1.0, 2.0])):
        df = spark.createDataFrame(pd.DataFrame({"x": x})).repartition(4)
        got = reports.quantiles(df, "x", (0.0, 0.25, 0.5, 0.9, 1.0), accuracy=1000).first()
        assert np.allclose(list(got), np.quantile(x, (0.0, 0.25, 0.5, 0.9, 1.0)))
    rows = pd.DataFrame({"idx": range(3000), "key": np.where(r.random(3000) < 0.5, 1, r.integers(30, size=3000))})
    got = reports.running_count(spark.createDataFrame(rows).repartition(5), block_rows=128).toPandas().sort_values("idx")
    assert (got.running.to_numpy() == (rows.groupby("key").cumcount() + 1).to_numpy()).all()


def test_stays_judged_in_blocks_equal_whole_epochs(spark):
    r = random.Random(8)
    rows = [(i, r.choice([1, 1, 2, r.randrange(9), r.randrange(60)]), int(r.random() < 0.3), i % 2) for i in range(5000)]
    s = spark.createDataFrame(rows, "idx long, key long, value int, truth int").repartition(4)
    for block in (40, 900, 1 << 20):
        for capacity, shards, threshold in ((6, 2, 4), (25, 1, 9)):
            want = bias.classify(bias.lru_epochs(s, capacity, shards), threshold, 1, ("key", "epoch"))
            got = bias.lru_classify(s, capacity, shards, threshold, 1, block)
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_frontier_equals_a_table_in_order_of_use():
    r = random.Random(9)
    for capacity in (1, 2, 5, 30):
        known = r.sample(range(40), min(capacity, 7))
        key = known + [r.randrange(r.choice((3, 40))) for _ in range(800)]
        live, want = OrderedDict.fromkeys(known), []
        for k in key[len(known) :]:
            want.append(k not in live)
            live.pop(k, None)
            live[k] = None
            if len(live) > capacity:
                live.popitem(last=False)
        assert bias.fresh_rows(np.array(key), capacity, len(known))[len(known) :].tolist() == want


def test_blocks_of_a_bounded_outer_table_run_again_until_they_fit(spark):
    rows = parts_of(5, 2500, 50)
    parts = spark.createDataFrame(rows, "idx long, okey long, val string, cnt int").repartition(8)
    assert parts.rdd.getNumPartitions() >= 8
    for capacity, shards, block in ((6, 1, 100), (40, 2, 30), (1000, 1, 300)):  # a table that forgets soon, late, never
        made, _ = two_tables(rows, capacity, shards, 3, 1, lambda k, inner: 0)
        got = bias.assemble_bounded(parts, capacity, shards, block)
        assert sorted((x.idx, x.okey, x.key, x.value, x.truth) for x in got.collect()) == made
    assert bias.assemble_bounded(parts.limit(0), 5, 1).count() == 0


class InMemory(dict):
    """State of a shard, as a table sees it."""

    def __init__(self):
        self.uses = []

    getValue, containsKey, updateValue, removeKey = dict.get, dict.__contains__, dict.__setitem__, dict.__delitem__  # noqa: N815

    def get(self, *key):
        return iter(list(self.uses)) if not key else dict.get(self, *key)

    def put(self, rows):
        self.uses = list(rows)

    def appendList(self, rows):  # noqa: N802
        self.uses += rows

    def clear(self):
        self.uses = []


def test_a_stored_table_equals_one_in_memory_over_batches():
    r = random.Random(10)
    for capacity in (1, 3, 20):
        entries, uses, size = InMemory(), InMemory(), (0, 0, 0)
        plain, rows, got, want = bias.BiasTable(capacity, 3, 1), 0, [], []
        for _ in range(60):
            kept = bias.BiasTable(capacity, 3, 1)
            kept.live = timely.StoredTable(entries, uses, *size)
            for _ in range(r.randrange(40)):
                kept.live.place, row = rows, (r.randrange(r.choice((4, 40))), r.randrange(2), 1)
                got.append(kept.row(*row))
                want.append(plain.row(*row))
                rows += 1
            size = kept.live.save()
            assert len(entries) == size[0] == len(plain.live) <= capacity and len(uses.uses) == size[2] <= 2 * capacity + 200
        assert got == want and any(got)
