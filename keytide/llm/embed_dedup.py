"""Near-duplicate vectors by sorted projection passes.

Equal vectors are one node. In each pass every vector gets the signs of its products with random
directions, drawn anew for the pass; vectors are ordered lexicographically by these concatenated
bits, and each is compared in double precision with the next rows of the order, a bounded window.
The verified pairs of all passes are united to components.

How likely a pass misses a partner depends on how dense a vector's neighbourhood is, so it is
measured: all that share more leading bits with a vector than the row one window away does stand
within its window. From these bits, and from how near their planes are to the vector, each pass
gives each vector its chance to miss a partner at the threshold. Vectors whose chances over all passes so far multiply to over ``MISS``
stay open, and further passes, with new directions, order the open ones only. A pass counts nothing
for rows at a partition's edge, whose windows reach into another task. Once the passes still needed
would compare as many pairs as all of the open vectors have, these are compared all with all.

A window can't hold all partners of a vector in a dense group. So the links of a component are
counted afterwards within it: in a large component the vectors within half the threshold angle of
its centre all link with each other, which the triangle inequality proves, and only the others are
compared, block by block, with all of it. Counts leave a block, never pairs.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keytide.llm.common import BATCH_ROWS, connected_components, forest, in_batches, matrix, whole_runs, written
from keytide.llm.vectors import packed, usable

#: Rows that a vector is compared with in each pass.
WINDOW = 128
#: Bits by which a pass sorts.
BITS = 63
#: Share of pairs right at the threshold that all passes together may miss.
MISS = 0.002
#: Distinct vectors that are compared as one block.
BLOCK = 1024
#: Vectors that passes have left open up to which all are compared with all.
FEW = 8192
#: Most passes between two looks at what is still open.
AT_ONCE = 32


def passes(n: int, threshold: float, window: int = WINDOW, miss: float = MISS) -> int:
    """Passes after which a pair at the threshold has stood in a window with chance 1 - miss, if vectors spread evenly.

    Two vectors share a bit with chance 1 - angle/pi, and stand in one window if they share about
    log2(n / window) leading bits.
    """
    p = (1 - math.acos(threshold) / math.pi) ** max(0.0, math.log2(max(n, 1) / window))
    return 4 if p >= 1 else max(4, math.ceil(math.log(miss) / math.log1p(-p)))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def shared_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading bits of ``BITS`` that signatures share."""
    x = a ^ b
    high = x >> 32
    return BITS - np.where(high > 0, 32 + np.frexp(high)[1], np.frexp(x & 0xFFFFFFFF)[1])


def agree(x: np.ndarray, w: np.ndarray, threshold: float) -> np.ndarray:
    """For unit vectors and directions: the chance that a partner at the threshold, on any side, has the same sign.

    The nearer a direction's plane is to the vector, the smaller. The partner's part across the
    vector is spread like a normal variable; its distribution is taken from a series (7.1.26 of
    Abramowitz and Stegun).
    """
    m = x @ w
    across = np.sqrt(np.maximum((w * w).sum(axis=0) - m * m, 1e-300) / max(1, len(w) - 1))
    z = np.abs(m) * threshold / math.sqrt(1 - threshold * threshold) / across / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-z * z)
    return 1 - tail / 2


def window_links(nodes: DataFrame, rounds: int, seed: list[int], threshold: float, stored: str, window: int = WINDOW) -> DataFrame:
    """(a, b, miss) of ``rounds`` passes over ``nodes``: a verified link of a and b, or, where b is null, the logarithm of a's chance to miss a partner in a pass. ``stored`` is the type that holds all components exactly."""
    def planes(p, dim):
        return np.random.default_rng([*seed, p, dim]).standard_normal((dim, BITS))

    def order(batches):
        for batch in (b.slice(at, BATCH_ROWS) for b in batches for at in range(0, b.num_rows, BATCH_ROWS)):
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                rows = pa.Table.from_batches([batch]).filter(pa.array(dims == dim))
                x = matrix(rows["v"], dim)
                v = rows["v"] if stored == "<f8" else pa.array([r.tobytes() for r in x.astype(stored)], pa.binary())
                for p in range(rounds):
                    sig = (x @ planes(p, dim) > 0) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                    t = pa.table({"pass": pa.array(np.full(len(x), p, np.int32)), "dim": rows["dim"], "sig": pa.array(sig), "node": rows["node"], "v": v})
                    yield from t.combine_chunks().to_batches()

    def chances(group, sig, x, start, stop, from_edge, to_end):
        """(rows of start..stop that count, log of each one's chance to miss)."""
        at = np.arange(start, stop)
        behind = np.where(at >= window, shared_bits(sig[at], sig[np.maximum(at - window, 0)]) + 1, 0)
        ahead = np.where(at + window < len(sig), shared_bits(sig[at], sig[np.minimum(at + window, len(sig) - 1)]) + 1, 0)
        sure = np.ones(len(at), dtype=bool)
        if from_edge:
            sure &= at >= window
        if not to_end:
            sure &= at + window < len(sig)
        at, bits = at[sure], np.maximum(behind, ahead)[sure]
        w = planes(group >> 32, group & 0xFFFFFFFF)
        agreed = np.concatenate([np.ones((len(at), 1)), np.cumprod(agree(x[at], w, threshold), axis=1), np.zeros((len(at), 1))], axis=1)
        return at, np.log(np.maximum(1 - agreed[np.arange(len(at)), bits], 1e-40))

    def told(node, at, miss):
        return pa.RecordBatch.from_arrays([pa.array(node[at]), pa.nulls(len(at), pa.int64()), pa.array(miss)], ["a", "b", "miss"])

    def windows(batches):
        # of the group at hand: its last rows, how many of these are told already, and whether it began at the partition's edge
        kept: dict = {}
        for batch in batches:
            t = pa.Table.from_batches([batch])
            group = t["pass"].to_numpy().astype(np.int64) << 32 | t["dim"].to_numpy()
            cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(group)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                g, dim = int(group[a]), int(group[a]) & 0xFFFFFFFF
                node, sig, x = t["node"].to_numpy()[a:b], t["sig"].to_numpy()[a:b], unit(matrix(t["v"].slice(a, b - a), dim, stored).astype(float))
                if kept.get("group") == g:
                    node, sig, x = (np.concatenate([kept[k], y]) for k, y in (("node", node), ("sig", sig), ("x", x)))
                else:
                    if kept:
                        yield told(kept["node"], *chances(kept["group"], kept["sig"], kept["x"], kept["told"], len(kept["sig"]), kept["edge"], True))
                    kept = {"told": 0, "edge": not kept}
                i, j = [], []
                for s in range(0, len(node), window):
                    near = x[s : s + window] @ x[s : s + 2 * window].T
                    p, q = np.nonzero(near >= threshold)
                    ahead = (q > p) & (q - p <= window)
                    i.append(p[ahead] + s)
                    j.append(q[ahead] + s)
                label = forest(np.concatenate(i), np.concatenate(j), len(node))
                other = np.flatnonzero(label != np.arange(len(node)))
                yield pa.RecordBatch.from_arrays([pa.array(node[other]), pa.array(node[label[other]]), pa.nulls(len(other), pa.float64())], ["a", "b", "miss"])
                stop = max(kept["told"], len(node) - window)
                yield told(node, *chances(g, sig, x, kept["told"], stop, kept["edge"], False))
                drop = max(0, len(node) - 2 * window)
                kept = {"group": g, "node": node[drop:], "sig": sig[drop:], "x": x[drop:], "told": stop - drop, "edge": kept["edge"] and not drop}
        # the last group may go on in the next partition, so its last window counts nothing

    sorted_ = nodes.select("node", "dim", "v").mapInArrow(order, "pass int, dim int, sig long, node long, v binary")
    sorted_ = sorted_.repartitionByRange("pass", "dim", "sig").sortWithinPartitions("pass", "dim", "sig", "node")
    return sorted_.mapInArrow(windows, "a long, b long, miss double")


def all_links(nodes: DataFrame, n: int, threshold: float) -> DataFrame:
    """(a, b): links that join all of the ``n`` ``nodes`` at the threshold, found by comparing all with all in blocks."""
    blocks = max(1, -(-n // BLOCK))
    cells = nodes.select("node", "dim", "v", F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int").alias("k"))
    cells = cells.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    cells = cells.select("dim", F.least("k", "o").alias("p"), F.greatest("k", "o").alias("q"), "node", "v")

    def compare(batches):
        for t in whole_runs(batches, ["dim", "p", "q"]):
            dim, p, q = (t[k].to_numpy() for k in ("dim", "p", "q"))
            new = np.flatnonzero((dim[1:] != dim[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])) + 1
            for s, e in zip([0, *new.tolist()], [*new.tolist(), len(dim)], strict=True):
                x, node = unit(matrix(t["v"].slice(s, e - s), int(dim[s]))), t["node"].to_numpy()[s:e]
                label = forest(*np.nonzero(x @ x.T >= threshold), len(node))
                other = np.flatnonzero(label != np.arange(len(node)))
                yield pa.RecordBatch.from_arrays([pa.array(node[other]), pa.array(node[label[other]])], ["a", "b"])

    return cells.repartition("dim", "p", "q").sortWithinPartitions("dim", "p", "q").mapInArrow(compare, "a long, b long")


def found_links(nodes: DataFrame, n: int, threshold: float, seed: int, stored: str, few: int = FEW, window: int = WINDOW) -> DataFrame:
    """(a, b): links of the ``n`` ``nodes``; a link at the threshold is missed with a chance of ``MISS`` at most.

    A first turn of passes is made at any size.
    """
    links, missed, open_, need, turn = [], None, nodes, passes(n, threshold, window), 0
    while n and (not turn or n > max(few, 2 * window * need)):
        rounds = min(need, AT_ONCE)
        out = written(window_links(open_, rounds, [seed, turn], threshold, stored, window))
        links.append(out.where("b is not null").select("a", "b"))
        now = out.where("b is null").select(F.col("a").alias("node"), "miss")
        now = now.unionByName(missed.join(open_.select("node"), "node", "left_semi")) if missed is not None else now
        missed = written(now.groupBy("node").agg(F.sum("miss").alias("miss")))
        left = open_.join(missed, "node", "left").withColumn("miss", F.coalesce("miss", F.lit(0.0))).where(F.col("miss") > math.log(MISS))
        open_, turn = written(left.select("node", "dim", "v", "miss")), turn + rounds
        n, mean = open_.agg(F.count("*"), F.avg("miss")).first()
        open_ = open_.select("node", "dim", "v")
        if n:
            need = max(4, math.ceil((math.log(MISS) - mean) / min(mean / turn, -1e-9)))
    if n:
        links.append(all_links(open_, n, threshold))
    return functools.reduce(DataFrame.unionByName, links) if links else nodes.select(F.col("node").alias("a"), F.col("node").alias("b"))


def link_near_duplicates(df: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 7, few: int = FEW, window: int = WINDOW) -> DataFrame:
    """(id, n_links, component_id, kept) for every row of ``df``.

    ``n_links`` counts the other rows at cosine ``threshold`` or more, ``component_id`` is the
    smallest id reachable over links. Null, zero and non-finite vectors link with nothing, nor do
    vectors of different dimension. Repeated rows count as other rows. A null id keeps its row;
    it is never a component's name and never kept. Only the two named columns are read. ``window`` rows
    are compared with each in a pass; up to ``few`` vectors that passes have left open are compared all with all.
    """
    vecs = packed(df, id_col, vec_col)
    member = written(vecs.withColumn("node", F.xxhash64("v")))  # 64 bits name a vector
    nodes = written(member.groupBy("node").agg(F.min("id").alias("low"), F.count("*").alias("copies"), F.first("dim").alias("dim"), F.first("v").alias("v")))
    n = nodes.count()
    stored = "<f4" if dict(df.dtypes)[vec_col] == "array<float>" else "<f8"
    comps = connected_components(found_links(nodes, n, threshold, seed, stored, few, window), "a", "b")
    grouped = written(nodes.join(comps, "node").select("node", "component", "low", "copies", "dim", "v"))
    counted = count_links(grouped, threshold)
    rooted = nodes.select("node", "low", "copies").join(grouped.select("node", "component"), "node", "left").withColumn("root", F.coalesce("component", "node"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(lowest, "root").join(counted, "node", "left").select("node", "component_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    linked = member.select("id", "node").join(named, "node").select("id", "n_links", "component_id")
    alone = df.where(~usable(F.col(vec_col))).select(F.col(id_col).cast("long").alias("id"), F.lit(0).cast("long").alias("n_links"), F.col(id_col).cast("long").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def count_links(grouped: DataFrame, threshold: float) -> DataFrame:
    """(node, others): rows that each node of a component links with, besides its own copies."""
    sizes = grouped.groupBy("component").agg(F.count("*").alias("members"))
    rows = grouped.join(sizes, "component")
    half = math.acos(threshold) / 2 - 1e-7

    @in_batches
    def sums(batch):
        t = pa.Table.from_batches([batch])
        comp, dims, got = t["component"].to_numpy(), t["dim"].to_numpy(), []
        for c in np.unique(comp).tolist():
            at = np.flatnonzero(comp == c)
            got.append((c, unit(matrix(t["v"].take(at), int(dims[at[0]]))).sum(axis=0)))
        return {"component": pa.array([c for c, _ in got], pa.int64()), "s": pa.array([s for _, s in got], pa.list_(pa.float64()))}

    def centre(key, t):
        s = np.array(t["s"].to_pylist()).sum(axis=0)
        return pa.table({"component": pa.array([key[0].as_py()], pa.int64()), "centre": pa.array([s.astype("<f8").tobytes()], pa.binary())})

    large = rows.where(F.col("members") > BLOCK)
    centres = large.select("component", "dim", "v").mapInArrow(sums, "component long, s array<double>").groupBy("component").applyInArrow(centre, "component long, centre binary")

    def placed(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            inner = []
            for v, c in zip(t["v"].to_pylist(), t["centre"].to_pylist(), strict=True):
                x, y = np.frombuffer(v, "<f8"), np.frombuffer(c, "<f8")
                size = math.sqrt((x @ x) * (y @ y))
                inner.append(size > 0 and math.acos(min(1.0, max(-1.0, (x @ y) / size))) <= half)
            yield from t.drop_columns(["centre"]).append_column("inner", pa.array(inner, pa.bool_())).combine_chunks().to_batches()

    names = "component long, node long, copies long, dim int, v binary, members long, inner boolean"
    cols = ["component", "node", "copies", "dim", "v", "members"]
    sided = large.select(*cols).join(centres, "component").mapInArrow(placed, names).unionByName(rows.where(F.col("members") <= BLOCK).select(*cols, F.lit(False).alias("inner")))
    sided = written(sided)
    ball = sided.where("inner").groupBy("component").agg(F.sum("copies").alias("ball"))
    certain = sided.where("inner").select("component", "node", "copies").join(ball, "component").select("node", (F.col("ball") - F.col("copies")).alias("others"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("members") / BLOCK)).cast("int")
    cells = sided.withColumn("n", blocks).withColumn("b", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    cells = cells.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    cells = cells.select("component", F.least("b", "o").alias("p"), F.greatest("b", "o").alias("q"), "b", "node", "copies", "dim", "v", "inner")

    def compare(batches):
        for t in whole_runs(batches, ["component", "p", "q"]):
            comp, p, q = (t[k].to_numpy() for k in ("component", "p", "q"))
            new = np.flatnonzero((comp[1:] != comp[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])) + 1
            cuts = [0, *new.tolist(), len(comp)]
            node, copies, b, inner = (t[k].to_numpy() for k in ("node", "copies", "b", "inner"))
            dims, vs = t["dim"].to_numpy(), t["v"].to_pylist()
            out_node, out_n = [], []
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                x = unit(np.frombuffer(b"".join(vs[s:e]), "<f8").reshape(e - s, int(dims[s])))
                link = x @ x.T >= threshold
                np.fill_diagonal(link, False)
                if p[s] != q[s]:
                    link &= b[s:e, None] != b[None, s:e]
                link &= ~(inner[s:e, None] & inner[None, s:e])
                out_node.append(node[s:e])
                out_n.append(link @ copies[s:e])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_node)), pa.array(np.concatenate(out_n))], ["node", "others"])

    outer = cells.repartition("component", "p", "q").sortWithinPartitions("component", "p", "q").mapInArrow(compare, "node long, others long")
    return outer.unionByName(certain).groupBy("node").agg(F.sum("others").alias("others"))
