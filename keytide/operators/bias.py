"""Bias detection: does a key's value stay rare over its first T occurrences?

``classify`` looks at whole streams. ``lru_epochs`` first cuts a key's occurrences where a bounded
table would have forgotten it. ``assemble`` builds inner keys from outer keys' parts,
``assemble_bounded`` does so with a bounded table of outer keys.
"""

from __future__ import annotations

import re
from collections import OrderedDict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keytide.operators.reports import running_sum
from keytide.operators.tables import dropped, written

T_DEFAULT, M_DEFAULT = 24, 4


def classify(stream: DataFrame, threshold: int = T_DEFAULT, most_ones: int = M_DEFAULT, by: tuple[str, ...] = ("key",)) -> DataFrame:
    """(key.., idx, ones, truth, label) of each key that reached the threshold.

    Biased if at most ``most_ones`` of the first ``threshold`` values are 1; ``truth`` is that of
    the T-th row, ``idx`` its place. Labels: true_anomaly, false_positive, false_negative,
    true_negative. The threshold is at least 2, as a first row is never judged.
    """
    if threshold < 2:
        raise ValueError("a first row is never judged: the threshold must be 2 or more")
    w = W.partitionBy(*by).orderBy("idx")
    first = stream.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= threshold)
    got = first.groupBy(*by).agg(F.count("*").alias("n"), F.sum("value").alias("ones"), F.max("idx").alias("idx"), F.max(F.when(F.col("rn") == threshold, F.col("truth"))).alias("truth"))
    biased, true = F.col("ones") <= most_ones, F.col("truth") == 1
    label = F.when(biased & true, "true_anomaly").when(biased, "false_positive").when(true, "false_negative").otherwise("true_negative")
    return got.where(F.col("n") == threshold).select(*by, "idx", "ones", "truth", label.alias("label"))


def confusion(labelled: DataFrame) -> DataFrame:
    """(label, keys) of the four labels that occur."""
    return labelled.groupBy("label").agg(F.count("*").alias("keys"))


def stats(stream: DataFrame) -> DataFrame:
    """(datums, unique_keys, max_occurrence) of a stream."""
    return stream.groupBy("key").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("datums"), F.count("*").alias("unique_keys"), F.max("n").alias("max_occurrence"))


def whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (shard, _block), which come one after another."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        shard, block = t["shard"].to_numpy(), t["_block"].to_numpy()
        cut = np.flatnonzero((shard[1:] != shard[:-1]) | (block[1:] != block[:-1])) + 1
        for k, (s, e) in enumerate(zip([0, *cut.tolist()], [*cut.tolist(), len(shard)], strict=True)):
            if held and (k or (shard[0], block[0]) != last):
                yield pa.concat_tables(held).combine_chunks()
                held = []
            held.append(t.slice(s, e - s))
        last = shard[-1], block[-1]
    if held:
        yield pa.concat_tables(held).combine_chunks()


def neighbours(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the row before and the row after with the same key; -1 and the number of rows without one."""
    n, order = len(key), np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    before, after = np.full(n, -1), np.full(n, n)
    before[order[same + 1]] = order[same]
    after[order[same]] = order[same + 1]
    return before, after


def fresh_rows(key: np.ndarray, capacity: int, known: int = 0) -> np.ndarray:
    """Whether a table of the ``capacity`` last used keys meets each row's key anew; the first ``known`` rows are what it holds.

    The table is the keys whose last row lies at or after a frontier, the place of its oldest entry.
    The frontier only ever moves on, to the next row that is still its key's last one.
    """
    before, after = (x.tolist() for x in neighbours(key))
    fresh = bytearray(len(key))
    oldest, held = 0, known
    for t in range(known, len(key)):
        p = before[t]
        if p > oldest:
            continue
        if p < oldest:
            fresh[t] = 1
            if held < capacity:
                held += 1
                continue
        oldest += 1
        while after[oldest] <= t:
            oldest += 1
    return np.frombuffer(fresh, dtype=np.bool_)


def _met(stream: DataFrame, capacity: int, shards: int, block_rows: int, most: int | None = None) -> DataFrame:
    """The stream with ``shard`` and ``_fresh``, whether its shard's table met the key anew; of each stay in a block the first ``most`` rows."""
    dealt = stream.select(*stream.columns, F.pmod("key", F.lit(shards)).cast("int").alias("shard"), F.floor(F.col("idx") / block_rows).alias("_block"))
    last = dealt.groupBy("shard", "_block", "key").agg(F.max("idx").alias("idx"))
    latest = W.partitionBy("shard", "_block").orderBy(F.desc("idx"))
    last = last.withColumn("_n", F.row_number().over(latest)).where(F.col("_n") <= capacity).drop("_n")

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What the table holds before each block, from the blocks' last keys in order."""
        key = idx = np.empty(0, dtype=np.int64)
        at = None
        for t in whole_blocks(batches):
            shard, block = t["shard"][0].as_py(), t["_block"][0].as_py()
            if shard != at:
                key, idx, at = key[:0], idx[:0], shard
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(idx), pa.array(np.full(len(key), shard, np.int32)), pa.array(np.full(len(key), block))], ["key", "idx", "shard", "_block"])
            key, idx = np.concatenate([key, t["key"].to_numpy()]), np.concatenate([idx, t["idx"].to_numpy()])
            kept = np.flatnonzero(neighbours(key)[1] == len(key))[-capacity:]
            key, idx = key[kept], idx[kept]

    begin = last.repartition(shards, "shard").sortWithinPartitions("shard", "_block", "idx").mapInArrow(starts, "key long, idx long, shard int, _block long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_blocks(batches):
            key, known = t["key"].to_numpy(), int(t["_old"].to_numpy().sum())
            fresh = fresh_rows(key, capacity, known)[known:]
            t = t.slice(known).drop_columns(["_old", "_block"]).append_column("_fresh", pa.array(fresh.astype(np.int64)))
            if most is not None and t.num_rows:
                order = np.argsort(key[known:], kind="stable")
                new = fresh[order].copy()
                new[0] = True
                new[1:] |= key[known:][order[1:]] != key[known:][order[:-1]]
                begun = np.flatnonzero(new)
                rank = np.arange(len(order)) - begun[np.cumsum(new) - 1]
                t = t.take(pa.array(np.sort(order[rank < most])))
            yield from t.combine_chunks().to_batches()

    known = {"key", "idx", "shard", "_block"}
    old = begin.select(*(F.col(n) if n in known else F.lit(0 if t in ("int", "bigint", "smallint", "tinyint") else None).cast(t).alias(n) for n, t in dealt.dtypes))
    rows = dealt.withColumn("_old", F.lit(False)).unionByName(old.withColumn("_old", F.lit(True)))
    out = ", ".join(f"`{n}` {t}" for n, t in dealt.dtypes if n != "_block") + ", _fresh long"
    # the old rows' idx is below the block's, so that they come first
    return rows.select(*dealt.columns, "_old").repartition("shard", "_block").sortWithinPartitions("shard", "_block", "idx").mapInArrow(run, out)


def lru_epochs(stream: DataFrame, capacity: int, shards: int, block_rows: int | None = None) -> DataFrame:
    """The stream with ``shard`` and ``epoch``: how often a table of ``capacity`` keys had met the key anew.

    Each shard (key modulo ``shards``) has a table of its own, as each worker of a parallel run
    does; one shard is one global table. A shard's order is cut into blocks that run in parallel.
    What the table holds where a block begins is known from each block's ``capacity`` last
    different keys, which one pass per shard over these short lists tells; a block's task holds
    its rows as arrays. The rows with what was met are written once. Keys must not be null.
    """
    block_rows = block_rows or max(1 << 16, 16 * capacity)
    met = written(_met(stream, capacity, shards, block_rows))
    return running_sum(met, "_fresh", "epoch").select(*stream.columns, "shard", F.col("epoch").cast("int").alias("epoch"))


def lru_classify(stream: DataFrame, capacity: int, shards: int, threshold: int = T_DEFAULT, most_ones: int = M_DEFAULT, block_rows: int | None = None) -> DataFrame:
    """``classify`` for each stay of a key in the bounded table.

    Of a stay only the first ``threshold`` rows in each block leave the block's task, so that a hot
    key, which stays long, has few rows to bring together.
    """
    block_rows = block_rows or max(1 << 16, 16 * capacity)
    met = _met(stream, capacity, shards, block_rows, threshold)
    stays = F.sum("_fresh").over(W.partitionBy("key").orderBy("idx").rowsBetween(W.unboundedPreceding, 0))
    return classify(met.withColumn("epoch", stays.cast("int")), threshold, most_ones, ("key", "epoch"))


def assemble(parts: DataFrame) -> DataFrame:
    """(okey, idx, key, value, truth): inner keys from the parts (idx, okey, val, cnt) of outer keys.

    A part with counter 1 opens an outer key. Counters 1 to 4 bring 16 bits each, 5 brings two
    digits, truth and value, and closes it. A part whose counter doesn't follow closes the outer key
    and is itself lost; parts of a closed key with a counter over 1 are ignored. One outer key's few
    parts are folded in order by an SQL aggregate over their array.
    """
    rows = parts.groupBy("okey").agg(F.array_sort(F.collect_list(F.struct("idx", "cnt", "val"))).alias("p"))
    empty = F.expr("CAST(array() AS array<struct<idx:bigint,key:bigint,value:int,truth:int>>)")
    start = F.struct(F.lit(0).alias("c"), F.lit(0).cast("long").alias("inner"), empty.alias("out"))

    def step(s, x):
        c, bits = s["c"], F.try_to_number(x["val"], F.lit("99999")).cast("long")
        opens, follows = (c == 0) & (x["cnt"] <= 1), (c > 0) & (x["cnt"] == c + 1)
        moved = F.when(x["cnt"] == 2, F.shiftleft(bits, 16)).when(x["cnt"] == 3, F.shiftleft(bits, 32)).when(x["cnt"] == 4, F.shiftleft(bits, 48)).otherwise(bits)
        done = follows & (x["cnt"] == 5)
        digit = lambda k: F.when(F.substring(x["val"], k, 1) == "0", 0).otherwise(1)
        made = F.array(F.struct(x["idx"].cast("long").alias("idx"), s["inner"].alias("key"), digit(2).alias("value"), digit(1).alias("truth")))
        return F.struct(
            F.when(opens, 1).when(done, 0).when(follows, c + 1).otherwise(0).alias("c"),
            F.when(opens, bits).when(follows & ~done, s["inner"].bitwiseOR(moved)).otherwise(F.lit(0).cast("long")).alias("inner"),
            F.when(done, F.concat(s["out"], made)).otherwise(s["out"]).alias("out"),
        )

    return rows.select("okey", F.explode(F.aggregate("p", start, step, lambda s: s["out"])).alias("x")).select("okey", "x.idx", "x.key", "x.value", "x.truth")


def leading_number(text: str) -> int:
    """The number that a text begins with; 0 without one."""
    m = re.match(r"\s*([+-]?\d+)", text or "")
    return int(m[1]) if m else 0


def signed(x: int) -> int:
    """The low 64 bits of a number, as a signed one."""
    x &= (1 << 64) - 1
    return x - (1 << 64) * (x >> 63)


class OuterTable:
    """A bounded table of outer keys whose inner keys are being put together; the least recently used makes room.

    Counters 1 to 4 refresh an outer key; a counter that doesn't follow, or the fifth part, takes
    it out at once.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.live: OrderedDict[int, tuple[int, int]] = OrderedDict()  # outer key: (parts, inner key so far)

    def part(self, okey: int, val: str, cnt: int) -> tuple[int, int, int] | None:
        """(inner key, value, truth) once the part completes one."""
        have, inner = self.live.pop(okey, (0, 0))
        if have == 0:
            if cnt > 1:
                return None
            if len(self.live) >= self.capacity:
                self.live.popitem(last=False)
            self.live[okey] = (1, signed(leading_number(val)))
        elif cnt == have + 1 and cnt <= 4:
            self.live[okey] = (cnt, signed(inner | leading_number(val) << 16 * have))
        elif cnt == have + 1:
            return inner, int(val[1:2] != "0"), int(val[:1] != "0")
        return None


class BiasTable:
    """A bounded table of keys with their rows and ones; a key is judged once, at its T-th row in the table."""

    def __init__(self, capacity: int, threshold: int, most_ones: int):
        self.capacity, self.threshold, self.most_ones = capacity, threshold, most_ones
        self.live: OrderedDict[int, tuple[int, int]] = OrderedDict()

    def row(self, key: int, value: int, truth: int) -> tuple[int, str] | None:
        """(ones, label) where the row is the key's T-th."""
        n, ones = self.live.pop(key, (0, 0))
        if n == 0 and len(self.live) >= self.capacity:
            self.live.popitem(last=False)
        n, ones = n + 1, ones + value
        self.live[key] = (n, ones)
        if n != self.threshold or n == 1:
            return None
        biased = ones <= self.most_ones
        return ones, ("true_anomaly" if truth == 1 else "false_positive") if biased else ("false_negative" if truth == 1 else "true_negative")


def assemble_bounded(parts: DataFrame, capacity: int, shards: int, block_rows: int | None = None) -> DataFrame:
    """``assemble`` with a table of ``capacity`` outer keys for each shard (outer key modulo ``shards``).

    A key that the table forgets loses its parts. A shard's order is cut into blocks that run in
    parallel, each from a guess of what the table holds there: nothing at first, then what the block
    before has handed over. Blocks whose guess was wrong run again until none was. A table
    soon forgets what it began with, so that most blocks run twice; whatever it takes, the rows
    are those of one table followed in order. Null ``okey`` and ``idx`` are left out. The result is
    a written table in the shared folder.
    """
    block_rows = block_rows or max(1 << 16, 16 * capacity)
    block = F.floor(F.col("idx") / block_rows)
    rows = written(parts.where("okey IS NOT NULL AND idx IS NOT NULL").select("okey", "idx", "val", "cnt", F.pmod("okey", F.lit(shards)).cast("int").alias("shard"), block.alias("_block")))
    state = "struct<okeys:array<bigint>,have:array<int>,inner:array<bigint>>"

    def run(_, part: pa.Table, begin: pa.Table) -> pa.Table:
        part = part.sort_by("idx")
        held = begin["start"][0].as_py()
        table, out = OuterTable(capacity), []
        table.live.update(zip(held["okeys"], zip(held["have"], held["inner"], strict=True), strict=True))
        for okey, idx, val, cnt in zip(*(part[c].to_pylist() for c in ("okey", "idx", "val", "cnt")), strict=True):
            if made := table.part(okey, val, cnt):
                out.append((okey, idx, *made))
        cols = list(zip(*out, strict=True)) or [()] * 5
        end = {"okeys": list(table.live), "have": [h for h, _ in table.live.values()], "inner": [i for _, i in table.live.values()]}
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
        made = pa.table({n: pa.array([*c, None], k) for n, c, k in zip(("okey", "idx", "key", "value", "truth"), cols, kinds, strict=True)})
        n = made.num_rows
        kind = pa.struct([("okeys", pa.list_(pa.int64())), ("have", pa.list_(pa.int32())), ("inner", pa.list_(pa.int64()))])
        same = lambda c, k: pa.array([part[c][0].as_py()] * n, k)
        return made.append_column("shard", same("shard", pa.int32())).append_column("_block", same("_block", pa.int64())).append_column("end", pa.array([None] * (n - 1) + [end], kind))

    def ran(blocks: DataFrame, turn: int) -> DataFrame:
        """The rows that these blocks (shard, _block, start) make, and a row with what each hands over."""
        ours = rows.join(blocks.select("shard", "_block"), ["shard", "_block"], "left_semi")
        by = ["shard", "_block"]
        out = ours.groupBy(*by).cogroup(blocks.select(*by, "start").groupBy(*by)).applyInArrow(run, f"okey long, idx long, key long, value int, truth int, shard int, _block long, end {state}")
        return written(out.withColumn("turn", F.lit(turn)))

    order = W.partitionBy("shard").orderBy("_block")
    blocks = rows.select("shard", "_block").distinct().withColumn("_before", F.lag("_block").over(order))
    blocks = written(blocks.withColumn("start", F.expr(f"CAST(named_struct('okeys', array(), 'have', array(), 'inner', array()) AS {state})")).withColumn("turn", F.lit(0)))
    turns = [ran(blocks, 0)]
    now = blocks
    while True:
        made = turns[-1].where("end IS NOT NULL").select("shard", "_block", "end")
        ends = made if len(turns) == 1 else made.unionByName(ends.join(made, ["shard", "_block"], "left_anti"))
        ends = written(ends)
        handed = ends.select("shard", F.col("_block").alias("_before"), F.col("end").alias("handed"))
        known = written(now.join(handed, ["shard", "_before"], "left").withColumn("wrong", F.col("handed").isNotNull() & (F.col("handed") != F.col("start"))))
        again = known.where("wrong").select("shard", "_block", "_before", F.col("handed").alias("start"), F.lit(len(turns)).alias("turn"))
        if again.isEmpty():
            break
        now = written(again.unionByName(known.where("NOT wrong").select("shard", "_block", "_before", "start", "turn")))
        turns.append(ran(now.where(F.col("turn") == len(turns)), len(turns)))
    valid = reduce(DataFrame.unionByName, turns).where("idx IS NOT NULL").join(now.select("shard", "_block", "turn"), ["shard", "_block", "turn"], "left_semi")
    out = written(valid.select("okey", "idx", "key", "value", "truth"))
    dropped(rows, blocks, ends, known, *turns)
    return out


def two_level_lru(parts: DataFrame, capacity: int, shards: int, threshold: int = T_DEFAULT, most_ones: int = M_DEFAULT) -> DataFrame:
    """Labels of inner keys with both tables bounded: outer keys put together, and inner keys judged."""
    return lru_classify(assemble_bounded(parts, capacity, shards), capacity, shards, threshold, most_ones)


def gaps(parts: DataFrame) -> DataFrame:
    """The parts whose counter doesn't follow the one before of their outer key."""
    before = F.lag("cnt").over(W.partitionBy("okey").orderBy("idx"))
    return parts.withColumn("before", before).where(F.col("cnt") != F.coalesce("before", F.lit(0)) + 1)
