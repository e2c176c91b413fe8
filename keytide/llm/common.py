"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words in every word-based contract: space and \x09-\x0D.
#: ``bytes.split()`` without arguments splits at exactly these.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_ids(df: DataFrame, id_col: str) -> None:
    """Raises where ids aren't whole numbers: components and first owners are told by their order."""
    kind = dict(df.select(F.col(id_col)).dtypes)[id_col]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_col} must be a whole number, not {kind}")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only on a local master where none is set (tests)."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named is None and sc.getCheckpointDir() is None:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="keytide-checkpoint-"))
    return named or sc.getCheckpointDir()


def written(df: DataFrame, *by: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again: its lineage is cut there.

    Columns ``by`` become folders, so that a filter on them reads only its own. ``dropped`` deletes such a table once nothing reads it any more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/keytide-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of tables that ``written`` returned and that nothing reads any more."""
    for t in tables:
        jvm, conf = t.sparkSession._jvm, t.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(t.written_path)
        path.getFileSystem(conf).delete(path, True)


#: What each module keeps in a worker beyond a task, and how to let go of it.
_kept: dict = {}


def keeps(module: str, release) -> None:
    """Tells that ``module`` has caches in this worker, which ``release()`` empties."""
    _kept[module] = release


def release_others(module: str) -> None:
    """Empties the caches of all other modules: workers live on and serve one operator after another.

    Memory that Arrow and the C library hold in reserve goes back to the system.
    """
    for name in [n for n in _kept if n != module]:
        _kept.pop(name)()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: Rows that a function over batches gets at a time, and their bytes if they are more than one, which bounds a worker's memory.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def pieces(batch: pa.RecordBatch, rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``rows`` rows and ``BATCH_BYTES`` bytes, one row at least."""
    for at in range(0, batch.num_rows, rows):
        waiting = [batch.slice(at, rows)]
        while waiting:
            now = waiting.pop()
            if now.num_rows > 1 and now.nbytes > BATCH_BYTES:
                half = now.num_rows // 2
                waiting += [now.slice(half), now.slice(0, half)]
            else:
                yield now


def in_batches(fn, rows: int = BATCH_ROWS):
    """A ``mapInArrow`` function that applies ``fn(RecordBatch) -> dict of columns`` to ``rows`` rows at a time."""

    @functools.wraps(fn)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_others(fn.__module__)
        for batch in batches:
            for part in pieces(batch, rows):
                yield from pa.table(fn(part)).combine_chunks().to_batches()

    return run


def texts(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def connected_components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges``; the component is its smallest node.

    Large-star and small-star rounds: each halves path lengths with two grouped minima and two
    equi-joins, so a hub is pre-aggregated before the shuffle and AQE may split it in the joins.
    Edges never leave the executors; only a count and a checksum a round reach the driver.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    e = written(edges.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).where("u != v").distinct())
    check = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = check(e)
    for _ in range(rounds):
        if not seen[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        before, e = e, written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        dropped(before)
        now = check(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0..n-1 and links (i, j): the smallest node that each reaches (numpy, one block)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = np.minimum(new, new[new])
        if np.array_equal(new, label):
            return label
        label = new


def bounded_runs(batches: Iterator[pa.RecordBatch], key: str, most: int) -> Iterator[tuple[pa.Table, bool]]:
    """(table, False) of whole runs of equal keys, or (table, True) of a piece of a run of over ``most`` rows.

    Rows come sorted by ``key``. At most about ``most`` rows and two batches are held.
    """
    held: list[pa.Table] = []
    long, last = False, None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        c = t[key].to_numpy()
        starts = np.flatnonzero(np.concatenate([[last is None or last != c[0]], c[1:] != c[:-1]]))
        last = c[-1]
        first, end = (int(starts[0]), int(starts[-1])) if len(starts) else (t.num_rows, t.num_rows)
        held.append(t.slice(0, first))
        if sum(x.num_rows for x in held) > most or long and len(starts):
            if any(x.num_rows for x in held):
                yield pa.concat_tables(held), True
            held, long = [], not len(starts)
        if len(starts):
            whole = pa.concat_tables([*held, t.slice(first, end - first)])
            if whole.num_rows:
                yield whole, False
            held, long = [t.slice(end)], False
    if any(x.num_rows for x in held):
        yield pa.concat_tables(held), long


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables cut from rows sorted by ``keys`` so that no run of equal keys is split between two."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        new = np.zeros(now.num_rows, dtype=bool)
        first = True
        for k in keys:
            c = now[k].to_numpy()
            new[1:] |= c[1:] != c[:-1]
            first = first and bool(held) and held[-1][k][-1].as_py() == c[0].item()
        starts = np.flatnonzero(new)
        if not len(starts):  # one key only
            if held and not first:
                yield pa.concat_tables(held)
                held = []
            held.append(now)
            continue
        held.append(now.slice(0, starts[-1]))
        yield pa.concat_tables(held)
        held = [now.slice(starts[-1])]
    if held:
        yield pa.concat_tables(held)


def matrix(column, dim: int, kind: str = "<f8") -> np.ndarray:
    """Equally long vectors kept as binary, as the rows of a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, dim)
