"""Nearest neighbours by a block matrix join of int8 tiles with error bounds.

Every vector is rounded to int8 with a scale of its own where it is read. Queries and rows are
dealt into blocks, as these bytes and four numbers; each pair of a query block and a row block is one
tile, a task's unit of work. One integer matrix product gives all inner products of a tile up to an error
bound from the rounding residues: |<x, y> - <x', y'>| <= |x - x'| |y| + |x'| |y - y'|. A row survives
for a query if its upper bound reaches the query's k-th best lower bound, first of those in the tile,
then of those in all tiles. Only for what survives are vectors fetched and products made in double
precision; each task's heaps have its best rows of a query, and a ranked window merges them. The result is exact.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keytide.llm.common import dropped, in_batches, matrix, written
from keytide.llm.vectors import packed

#: Rows of a query block and of a row block, a byte for each component; the more rows in a tile, the fewer survive in all.
QUERY_BLOCK, ROW_BLOCK = 1024, 16384


def rounded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(int8 rows, scale, norm of the residue, norm of the row, norm of the rounded row)."""
    scale = np.abs(x).max(axis=1) / 127
    scale[scale == 0] = 1  # components too small to divide: all of the row is residue
    q = np.clip(np.rint(x / scale[:, None]), -127, 127).astype(np.int8)
    back = q * scale[:, None]
    norm = lambda a: np.sqrt((a * a).sum(axis=1))
    return q, scale, norm(x - back), norm(x), norm(back)


def int8_rows(rows: DataFrame) -> DataFrame:
    """(node, id, dim, q, scale, residue, norm, back) of vectors (node, id, dim, v): their rounded form."""

    @in_batches
    def run(batch):
        dims, out = batch.column("dim").to_numpy(), {}
        parts = []
        for dim in np.unique(dims).tolist():
            at = np.flatnonzero(dims == dim)
            q, *numbers = rounded(matrix(batch.column("v").take(pa.array(at)), dim))
            parts.append((at, [x.tobytes() for x in q], *numbers))
        order = pa.array(np.concatenate([x[0] for x in parts]) if parts else np.empty(0, np.int64))
        out = {k: batch.column(k).take(order) for k in ("node", "id", "dim")}
        out["q"] = pa.array([x for p in parts for x in p[1]], pa.binary())
        return out | {k: pa.array(np.concatenate([p[c] for p in parts]) if parts else np.empty(0)) for c, k in enumerate(("scale", "residue", "norm", "back"), 2)}

    return rows.mapInArrow(run, "node long, id long, dim int, q binary, scale double, residue double, norm double, back double")


def tile_bounds(a: pa.Table, b: pa.Table, k: int):
    """(places in ``a``, places in ``b``, lower bound, upper bound) of what survives in a tile of queries ``a`` and rows ``b``."""
    dim = a["dim"][0].as_py()
    wide = np.float32 if dim * 127 * 127 < 1 << 24 else np.float64  # sums of int8 products stay exact
    of = lambda t, c: t[c].to_numpy()
    q, qid = matrix(a["q"], dim, "i1").astype(wide), of(a, "id")
    floor, found = np.full(len(q), -np.inf), []
    for at in range(0, b.num_rows, 1024):
        part = b.slice(at, 1024)
        guess = (q @ matrix(part["q"], dim, "i1").astype(wide).T).astype(np.float64) * of(a, "scale")[:, None] * of(part, "scale")[None, :]
        bound = of(a, "residue")[:, None] * (of(part, "back") + of(part, "residue"))[None, :] + of(a, "norm")[:, None] * of(part, "residue")[None, :]
        bound = bound * (1 + 1e-9) + 1e-12 * (of(a, "norm")[:, None] * of(part, "back")[None, :])
        low = np.where(qid[:, None] == of(part, "id")[None, :], -np.inf, guess - bound)
        if part.num_rows >= k:
            floor = np.maximum(floor, np.partition(low, part.num_rows - k, axis=1)[:, part.num_rows - k])
        i, j = np.nonzero((guess + bound >= floor[:, None]) & (low > -np.inf))
        found.append((i, j + at, low[i, j], (guess + bound)[i, j]))
    i, j, low, high = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((-low, i))
    i, j, low, high = i[order], j[order], low[order], high[order]
    begin = np.searchsorted(i, np.arange(len(q) + 1))
    kth = begin[:-1] + k - 1
    enough = kth < begin[1:]
    floor[enough] = np.maximum(floor[enough], low[kth[enough]])
    good = high >= floor[i]
    return i[good], j[good], low[good], high[good]


def best_of(found: DataFrame, k: int) -> DataFrame:
    """(query, query_id, id, score) of pairs (query, query_id, id, v, w): the ``k`` best of each query among a task's rows, in double precision."""

    def run(batches):
        heaps: dict[int, tuple[int, list]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                dims = np.fromiter(map(len, part.column("v").to_pylist()), np.int64, part.num_rows) // 8
                score = np.empty(len(dims))
                for dim in np.unique(dims).tolist():
                    rows = pa.array(np.flatnonzero(dims == dim))
                    score[dims == dim] = np.einsum("ij,ij->i", *(matrix(part.column(c).take(rows), dim) for c in ("v", "w")))
                for query, qid, row, x in zip(*(part.column(c).to_pylist() for c in ("query", "query_id", "id")), score.tolist(), strict=True):
                    heap = heaps.setdefault(query, (qid, []))[1]
                    if len(heap) < k:
                        heapq.heappush(heap, (x, -row))  # the worst kept stands first
                    elif (x, -row) > heap[0]:
                        heapq.heapreplace(heap, (x, -row))
        out = [(query, qid, -row, x) for query, (qid, heap) in heaps.items() for x, row in heap]
        cols = list(zip(*out, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query", "query_id", "id", "score"])

    return found.select("query", "query_id", "id", "v", "w").mapInArrow(run, "query long, query_id long, id long, score double")


def nearest(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the k rows of largest inner product for each query row.

    Candidates are all usable rows but those with the query's own id, of the query's dimension.
    Ties go to the smaller id; a query with fewer candidates gets them all. Null, zero and
    non-finite vectors and null ids take no part; repeated rows count as often as they stand
    there, but a repeated query id answers once, for its vector of fewest components and, of these,
    of the first bytes. Only the two named columns are read.
    """
    asks = F.coalesce(is_query, F.lit(False)).alias("asks")
    given = df.where(F.col(id_col).isNotNull()).select(F.col(id_col), F.col(vec_col), asks)
    every = [packed(given.where(c), id_col, vec_col).withColumn("asks", F.lit(a)) for a, c in ((True, F.col("asks")), (False, ~F.col("asks")))]
    rows = written(every[0].unionByName(every[1]).withColumn("node", F.monotonically_increasing_id()))
    first = rows.where("asks").groupBy("id").agg(F.min(F.struct("dim", "v", "node")).alias("x")).select("x.node")
    small = written(int8_rows(rows))
    asked = small.select(*(F.col(c).alias(c) for c in small.columns)).join(first, "node", "left_semi")
    n, nq = rows.agg(F.count("*"), F.count(F.when(F.col("asks"), 1))).first()
    nb, mb = max(1, -(-n // ROW_BLOCK)), max(1, -(-nq // QUERY_BLOCK))
    deal = lambda salt, m: F.pmod(F.xxhash64(F.lit(salt), "node"), F.lit(m)).cast("int")
    right = small.withColumn("rb", deal(1, nb)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(mb - 1))))
    left = asked.withColumn("qb", deal(2, mb)).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))))

    def tile(a, b):
        if not a.num_rows or not b.num_rows:
            return pa.table({c: pa.array([], t) for c, t in (("query", pa.int64()), ("node", pa.int64()), ("low", pa.float64()), ("high", pa.float64()))})
        i, j, low, high = tile_bounds(a, b, k)
        return pa.table({"query": pa.array(a["node"].to_numpy()[i]), "node": pa.array(b["node"].to_numpy()[j]), "low": pa.array(low), "high": pa.array(high)})

    key = ["dim", "rb", "qb"]
    met = written(left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(tile, "query long, node long, low double, high double"))
    place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("low"), "node"))
    floor = met.withColumn("place", place).where(F.col("place") <= k).groupBy("query").agg(F.count("*").alias("n"), F.min("low").alias("floor"))
    left_over = met.join(floor, "query").where((F.col("n") < k) | (F.col("high") >= F.col("floor"))).select("query", "node")
    asking = rows.select(F.col("node").alias("query"), F.col("id").alias("query_id"), "v")
    pairs = left_over.join(asking, "query").join(rows.select("node", "id", F.col("v").alias("w")), "node")
    best = best_of(pairs, k)
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    out = written(ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score"))
    dropped(rows, small, met)
    return out
