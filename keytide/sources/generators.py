"""Synthetic key streams, made in parallel by Spark and reproducible from a seed."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keytide.functions.hashing import evahash, fold, murmur64a, numpy_udf


def _uniform(*what) -> F.Column:
    """A reproducible uniform number in [0, 1) from a hash; independent of partitioning."""
    return F.shiftrightunsigned(F.xxhash64(*what), 11) / float(1 << 53)


def _shuffled(rows: DataFrame, seed: int) -> DataFrame:
    """(idx, key) of ``rows`` (id, key) in an order drawn from the seed.

    Places come from a range sort by a hash: rows are counted in each sorted bucket, and the buckets'
    offsets (a few numbers) make the places dense without one task seeing all rows.
    """
    from pyspark.sql import Window as W

    buckets = 256
    r = rows.withColumn("o", F.xxhash64(F.lit(seed), "id", "key")).withColumn("b", F.pmod(F.shiftrightunsigned("o", 40), F.lit(buckets)))
    sizes = r.groupBy("b").agg(F.count("*").alias("n"))
    before = sizes.withColumn("at", F.sum("n").over(W.orderBy("b").rowsBetween(W.unboundedPreceding, -1))).select("b", F.coalesce("at", F.lit(0)).alias("at"))
    place = F.row_number().over(W.partitionBy("b").orderBy("o", "id", "key")) - 1
    return r.withColumn("p", place).join(F.broadcast(before), "b").select((F.col("at") + F.col("p")).cast("long").alias("idx"), "key")  # 256 rows


def zipf(spark: SparkSession, n: int, universe: int, s: float = 1.5, seed: int = 1) -> DataFrame:
    """(idx, key): ranks of a Zipf law by its distribution function, hashed to 48-bit keys.

    The first half million ranks are exact, the rest fall into buckets that are uniform inside.
    """
    exact = min(universe, 500_000)
    mass = np.arange(1, exact + 1, dtype=np.float64) ** -s
    edges = [exact]
    while edges[-1] < universe:
        edges.append(min(universe, edges[-1] * 2))
    tail = [((b + 0.5) ** (1 - s) - (a + 0.5) ** (1 - s)) / (1 - s) if s != 1 else math.log((b + 0.5) / (a + 0.5)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    cdf = np.cumsum(np.concatenate([mass, tail]))
    cdf /= cdf[-1]

    @F.pandas_udf("long")
    def rank(u: pd.Series, v: pd.Series) -> pd.Series:
        at = np.searchsorted(cdf, u.to_numpy(), side="right")
        at = np.minimum(at, len(cdf) - 1)
        out = at + 1
        far = at >= exact
        if far.any():
            lo = np.array(edges[:-1])[at[far] - exact]
            hi = np.array(edges[1:])[at[far] - exact]
            out[far] = lo + 1 + (v.to_numpy()[far] * (hi - lo)).astype(np.int64)
        return pd.Series(out)

    hashed = numpy_udf(murmur64a)
    ranks = spark.range(n).select(F.col("id").alias("idx"), rank(_uniform(F.lit(seed), "id"), _uniform(F.lit(seed + 1), "id")).alias("rank"))
    return ranks.select("idx", fold(hashed("rank")).alias("key"))


def arbitrary(spark: SparkSession, kind: int, n: int, ram: int, seed: int = 1) -> DataFrame:
    """(idx, key) of one of four adversarial mixes for a memory of ``ram`` keys.

    1: ram/8 keys 24 to 50 times, the rest random keys; 2: ram/8 keys 24 times, the rest 23 times;
    3: ram keys once, then the first ram/8 in turns, unshuffled; 4: every key 1 to 24 times.
    """
    hot = max(1, ram // 8)
    key = lambda c: fold(F.xxhash64(F.lit(seed), c))
    if kind == 3:
        i = F.col("id")
        return spark.range(n).select(i.alias("idx"), key(F.when(i < ram, i).otherwise((i - ram) % hot)).alias("key"))
    if kind == 1:
        times = F.floor(_uniform(F.lit(seed), "id") * 27 + 24).cast("int")
        heavy = spark.range(hot).select("id", key(F.col("id")).alias("key"), times.alias("times"))
        total = heavy.agg(F.sum("times")).first()[0]
        rest = spark.range(hot, hot + max(0, n - total)).select("id", key(F.col("id")).alias("key"), F.lit(1).alias("times"))
        rows = heavy.unionByName(rest)
    elif kind == 2:
        keys = hot + max(0, (n - 24 * hot) // 23)
        rows = spark.range(keys).select("id", key(F.col("id")).alias("key"), F.when(F.col("id") < hot, 24).otherwise(23).alias("times"))
    else:
        rows = spark.range(max(1, int(n / 12.5))).select("id", key(F.col("id")).alias("key"), F.floor(_uniform(F.lit(seed), "id") * 24 + 1).cast("int").alias("times"))
    return _shuffled(rows.select(F.explode(F.sequence(F.lit(1), "times")).alias("id"), "key"), seed)


def with_planted(stream: DataFrame, planted: DataFrame) -> DataFrame:
    """The stream with the keys of ``planted`` (idx, key) in place of its own at those places."""
    p = planted.select("idx", F.col("key").alias("_new"))
    return stream.join(p, "idx", "left").withColumn("key", F.coalesce("_new", "key")).drop("_new")


#: Fixed values of the biased power-law generator: seeds, mask, key offset, keys and exponent.
KEY_SEED, VALUE_SEED, MASK, OFFSET, KEYS, POWER = 678912345, 98765, 12345, 1_000_000_000, 100_000, 0.5
#: The linear congruential generator of the C library's reentrant ``rand_r``.
LCG_A, LCG_C = 1103515245, 12345


def lcg_jump(state: int, steps: int) -> int:
    """The state after so many steps, in logarithmic time."""
    a, c, mul, add, m = LCG_A, LCG_C, 1, 0, (1 << 32) - 1
    while steps:
        if steps & 1:
            mul, add = mul * a & m, (add * a + c) & m
        a, c, steps = a * a & m, (c * a + c) & m, steps >> 1
    return (mul * state + add) & m


def rand_r(seed: int, first: int, n: int) -> np.ndarray:
    """Draws first .. first + n - 1 of ``rand_r``: three steps each, of 11, 10 and 10 bits."""
    steps = 3 * n
    states = np.empty(steps + 1, dtype=np.uint64)
    states[0] = lcg_jump(seed, 3 * first)
    done, mul, add = 1, LCG_A, LCG_C
    while done <= steps:  # doubles what is known
        k = min(done, steps + 1 - done)
        states[done : done + k] = states[:k] * np.uint64(mul) + np.uint64(add) & np.uint64(0xFFFFFFFF)
        mul, add, done = mul * mul & 0xFFFFFFFF, (add * mul + add) & 0xFFFFFFFF, done + k
    part = lambda k, bits: (states[1 + k :: 3][:n] >> np.uint64(16)) % np.uint64(1 << bits)
    return ((part(0, 11) << np.uint64(10) ^ part(1, 10)) << np.uint64(10) ^ part(2, 10)).astype(np.int64)


def power_law_cdf(keys: int = KEYS, power: float = POWER, most: int = 2**31 - 1) -> np.ndarray:
    """Scaled distribution function: 1 - i B(i, power + 1) for rank i."""
    out = np.zeros(keys, dtype=np.int64)
    for i in range(1, keys):
        out[i] = math.floor((1.0 - i * math.exp(math.lgamma(i) + math.lgamma(power + 1) - math.lgamma(i + power + 1))) * most)
    return out


def powerlaw(spark: SparkSession, packets: int, per_packet: int = 50, sender: int = 0, block: int = 1 << 18) -> DataFrame:
    """(idx, key, value, truth) of the biased power-law generator, made in parallel.

    The generator is sequential: a draw beyond the last key is drawn again, and each datum takes one
    value draw. Any block of draws is reached by jumping ahead; one pass counts the accepted draws
    of each block, and their offsets tell every block its first datum.
    """
    n, cdf = packets * per_packet, power_law_cdf(power=POWER)
    seeds = KEY_SEED + sender, VALUE_SEED + sender
    blocks = -(-int(n * 1.02 + 1000) // block)

    def keys_of(b: int) -> np.ndarray:
        r = rand_r(seeds[0], b * block, block)
        return np.searchsorted(cdf, r[r < cdf[-1]], side="left")

    def count(batches):
        for pdf in batches:
            yield pd.DataFrame({"b": pdf["id"], "n": [len(keys_of(b)) for b in pdf["id"].tolist()]})

    ids = spark.range(0, blocks, 1, blocks)
    sizes = dict(ids.mapInPandas(count, "b long, n long").collect())  # a number a block
    first, at = {}, 0
    for b in range(blocks):
        first[b], at = at, at + sizes[b]

    def make(batches):
        for pdf in batches:
            for b in pdf["id"].tolist():
                key = keys_of(b)[: max(0, n - first[b])] + OFFSET * (1 + sender)  # senders' keys are disjoint
                if not len(key):
                    continue
                truth = (evahash(key.view(np.uint64), MASK) & np.uint64(0xFF)) == 0x11
                draw = rand_r(seeds[1], first[b], len(key))
                value = np.where(truth, (draw & 0xF) == 0, (draw & 1) == 1)
                yield pd.DataFrame({"idx": first[b] + np.arange(len(key)), "key": key, "value": value.astype(np.int32), "truth": truth.astype(np.int32)})

    return ids.mapInPandas(make, "idx long, key long, value int, truth int")


def active_set(spark: SparkSession, n: int, live: int = 131_072, seed: int = 1) -> DataFrame:
    """(idx, key, value, truth) of a drifting set of about ``live`` active keys.

    Key i has a total drawn from a heavy tail (i^-1.5), starts where the keys before it leave room,
    and spreads its rows over a life whose pace swells and fades. Made from independent keys, so it
    has the same kind of drift as a ring of queues without being one.
    """
    u = _uniform(F.lit(seed), "id")
    total = F.least(F.greatest(F.floor(F.pow(u, F.lit(-2.0 / 3.0)) * 2), F.lit(1)), F.lit(65_536)).cast("int")
    keys = spark.range(max(1, n // 4)).select("id", total.alias("total"), (F.col("id") * 4).alias("start"))
    rows = keys.select("id", "start", "total", F.explode(F.sequence(F.lit(1), "total")).alias("j"))
    x = (F.col("j") - 1 + _uniform(F.lit(seed + 1), "id", "j")) / F.col("total")
    bell = x + F.sin(x * 2 * math.pi) / (2 * math.pi) * 0.9
    when = (F.col("start") + bell * live).cast("long")
    hashed = rows.select(when.alias("when"), (F.col("id") + OFFSET).alias("key"), "j").where(F.col("when") < n)
    return _valued(_ranked(hashed), seed)


def _ranked(rows: DataFrame) -> DataFrame:
    """(idx, key) of rows (when, key, j) by time: dense places from counts of time buckets."""
    from pyspark.sql import Window as W

    r = rows.withColumn("b", F.shiftright("when", 14))
    sizes = r.groupBy("b").agg(F.count("*").alias("n"))
    before = sizes.select("b", F.coalesce(F.sum("n").over(W.orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("at"))
    place = F.row_number().over(W.partitionBy("b").orderBy("when", "key", "j")) - 1
    return r.withColumn("p", place).join(before, "b").select((F.col("at") + F.col("p")).alias("idx"), "key", "j")


def _valued(rows: DataFrame, seed: int) -> DataFrame:
    """Adds truth by the key's mask hash and values: 1 for one in 16 of a biased key's rows, else for half."""
    biased = (numpy_udf(evahash, seed=MASK)("key") % 256 == 0x11).cast("int")
    r = rows.withColumn("truth", biased).withColumn("r", F.pmod(F.xxhash64(F.lit(seed), "key", "j"), F.lit(16)))
    return r.select("idx", "key", F.when(F.col("truth") == 1, (F.col("r") == 3).cast("int")).otherwise((F.col("r") < 8).cast("int")).alias("value"), "truth")


def two_level(spark: SparkSession, n_outer: int, inner_keys: int = 1000, seed: int = 1) -> DataFrame:
    """(idx, okey, val, cnt): parts of outer keys that spell inner keys, interleaved.

    Most outer keys send all five parts, some stop early. The inner key's rank is drawn from a heavy
    tail; its four 16-bit parts are hashes of it, and the fifth has the digits of truth and value.
    """
    u = _uniform(F.lit(seed), "id")
    rank = F.least(F.floor(F.pow(1 - u, F.lit(-1.1))), F.lit(inner_keys)).cast("long")
    sent = F.when(_uniform(F.lit(seed + 1), "id") < 0.1, F.floor(_uniform(F.lit(seed + 2), "id") * 4 + 1)).otherwise(5).cast("int")
    outer = spark.range(n_outer).select("id", rank.alias("rank"), F.explode(F.sequence(F.lit(1), sent)).alias("cnt"))
    truth = (F.pmod(F.xxhash64(F.lit(0x123456), "rank"), F.lit(256)) == 0x11).cast("int")
    draw = F.pmod(F.xxhash64(F.lit(seed + 3), "id"), F.lit(16))
    value = F.when(truth == 1, (draw == 0).cast("int")).otherwise((draw < 8).cast("int"))
    part = F.pmod(F.xxhash64("rank", "cnt"), F.lit(1 << 15)).cast("string")
    val = F.when(F.col("cnt") < 5, part).otherwise(F.concat(truth.cast("string"), value.cast("string")))
    when = F.col("id") + (F.col("cnt") - 1) * 64 + F.pmod(F.xxhash64("id", "cnt"), F.lit(32))
    rows = outer.select(when.alias("when"), F.col("id").alias("key"), F.col("cnt").alias("j"), val.alias("val"))
    placed = _ranked(rows.select("when", "key", "j"))
    return placed.join(rows.select("key", "j", "val"), ["key", "j"]).select("idx", F.col("key").alias("okey"), "val", F.col("j").alias("cnt"))
