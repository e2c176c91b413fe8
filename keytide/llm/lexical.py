"""Exact ranked lexical search over a tiered index.

The postings of the terms that the queries hold are split into tiers by impact, the part of the
score that a document's own frequency and length decide: a term's first tier has its few postings
of highest impact, and each further tier has some times more. A term's residual bound after a tier
is the highest impact below it.

The first tier alone proposes documents for every query; the k-th best of their exact scores is a
threshold. A query is exact at the first tier at which the bounds of its terms together stay below
its threshold, as a document that wasn't met there can't reach it; queries that lack this proof fall
through to the tier that gives it, the last at worst, where nothing is left. Very frequent terms
whose bounds together come to less than half of the threshold aren't read below their first tier.
Documents whose score may reach the threshold are scored anew from all their terms.

Documents are read once and turned into rows of term counts where they lie; only postings that a
query asks for are shuffled, by query and document. Queries are taken in blocks, whose distinct terms
are what is broadcast.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keytide.llm.common import dropped, in_batches, texts, written

#: Lower-cases A-Z and turns every ASCII character that is no letter or digit into a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Bytes of a text that are cut into terms at a time.
PIECE = 1 << 20
#: Distinct terms of a block of queries, about: what is broadcast at once.
BLOCK_TERMS = 1 << 16
#: Postings of a term's first tier, about, and how many times more each further tier has.
TIER_ROWS, TIER_GROWTH = 256, 16
#: Documents of the first tier that are scored whole for the threshold, for each result asked for.
FIRST = 4
#: Impacts are below 10^6; tiers end at multiples of 2^LEVEL.
LEVEL = 10


def term_counts(raw: bytes, number=None) -> tuple[int, Counter]:
    """How many terms a text has, and how often each occurs; ``number`` names those to count and drops the rest."""
    raw, at, n, found = raw.translate(FOLD), 0, 0, Counter()
    while at < len(raw):
        end = raw.find(b" ", at + PIECE)
        end = len(raw) if end < 0 else end
        terms = raw[at:end].split()
        n, at = n + len(terms), end
        found.update(map(number, terms) if number else terms)
    found.pop(None, None)
    return n, found


def query_terms(items: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(query, item_id, names) of each row of ``items``: a number of its own and its distinct terms."""

    def rows(batch: pa.RecordBatch) -> dict:
        names = [list(term_counts(x)[1]) for x in texts(batch["text"])]
        return {"query": batch["query"], "item_id": batch["item_id"], "names": pa.array(names, pa.list_(pa.binary()))}

    rows.__module__ = __name__
    kind = items.schema[id_col].dataType.simpleString()
    given = items.select(F.monotonically_increasing_id().alias("query"), F.col(id_col).alias("item_id"), F.col(text_col).alias("text"))
    return given.mapInArrow(in_batches(rows), f"query bigint, item_id {kind}, names array<binary>")


def counted_terms(docs: DataFrame, vocabulary: Broadcast, text_col: str, id_col: str) -> DataFrame:
    """(row, doc_id, n, terms, tfs) of each row of ``docs``: the numbers of the known terms in it and their counts."""

    def rows(batch: pa.RecordBatch) -> dict:
        number = vocabulary.value.get
        found = [term_counts(x, number) for x in texts(batch["text"])]
        at = pa.array(np.cumsum([0] + [len(c) for _, c in found]), pa.int32())
        cut = lambda flat: pa.ListArray.from_arrays(at, pa.array(np.fromiter(flat, dtype=np.int32)))
        terms, tfs = cut(t for _, c in found for t in c.keys()), cut(v for _, c in found for v in c.values())
        return {"row": batch["row"], "doc_id": batch["doc_id"], "n": pa.array([n for n, _ in found], pa.int64()), "terms": terms, "tfs": tfs}

    rows.__module__ = __name__
    kind = docs.schema[id_col].dataType.simpleString()
    given = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return given.mapInArrow(in_batches(rows), f"row bigint, doc_id {kind}, n bigint, terms array<int>, tfs array<int>")


def with_impacts(counts: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """``counts`` with each posting a row: (row, doc_id, term, impact), lengths in units of the mean one."""
    length = F.expr(f"10L + ((cast(n as decimal(18, 0)) * {90 * n_docs}BD) div {n_terms}BD)")
    each = counts.withColumn("m", length).select(*[c for c in counts.columns if c not in ("n", "terms", "tfs")], "m", F.explode(F.arrays_zip("terms", "tfs")).alias("p"))
    impact = F.expr("(1000000000L * p.tfs) div (1000L * p.tfs + 8L * m)")
    return each.select(*[c for c in each.columns if c not in ("m", "p")], F.col("p.terms").alias("term"), impact.alias("impact"))


def tier_limits(postings: DataFrame, n_docs: int, tier_rows: int, growth: int) -> DataFrame:
    """(term, df, w, limits, residual): each tier's lowest level, and the highest impact below it.

    It comes from the number of postings on each level of impact, so that no term's list is put in order.
    """
    by_level = postings.groupBy("term", F.shiftright("impact", LEVEL).alias("level")).agg(F.count("*").alias("n"), F.max("impact").alias("top"))
    higher = Window.partitionBy("term").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, -1)
    above = F.coalesce(F.sum("n").over(higher), F.lit(0))
    tier = F.when(above < tier_rows, 0).otherwise(1 + F.floor(F.log(above / tier_rows) / F.log(F.lit(float(growth)))))
    tiers = by_level.withColumn("tier", tier).groupBy("term", "tier").agg(F.sum("n").alias("n"), F.min("level").alias("low"), F.max("top").alias("top"))
    whole = tiers.groupBy("term").agg(F.sum("n").alias("df"), F.array_sort(F.collect_list(F.struct("tier", "low", "top"))).alias("t"))
    weight = F.floor(1000 * F.log((F.lit(2 * n_docs + 2).cast("double")) / (2 * F.col("df") + 1)))
    residual = F.concat(F.expr("transform(slice(t, 2, size(t)), x -> x.top)"), F.array(F.lit(0).cast("bigint")))
    return whole.select("term", "df", weight.cast("bigint").alias("w"), F.expr("transform(t, x -> x.low)").alias("limits"), residual.alias("residual"))


def whole_scores(pairs: DataFrame, counts: DataFrame, asked: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """(query, row, doc_id, score) of ``pairs`` (query, row), from all terms of the documents."""
    met = with_impacts(counts.join(pairs, "row"), n_docs, n_terms)
    return met.join(F.broadcast(asked.select("query", "term", "w")), ["query", "term"]).groupBy("query", "row", "doc_id").agg(F.sum(F.col("w") * F.col("impact")).alias("score"))


def block_search(docs: DataFrame, queries: DataFrame, k: int, text_col: str, id_col: str, tier_rows: int, growth: int) -> DataFrame:
    """The k best documents of each of ``queries`` (query, item_id, names), whose terms fit into a broadcast."""
    spark = docs.sparkSession
    names = [bytes(r[0]) for r in queries.select(F.explode("names")).distinct().collect()]
    vocabulary = spark.sparkContext.broadcast({x: i for i, x in enumerate(names)})
    counts = written(counted_terms(docs, vocabulary, text_col, id_col))
    n_docs, n_terms = counts.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_terms = max(n_terms, 1)
    postings = with_impacts(counts.drop("doc_id"), n_docs, n_terms)
    # as many rows as the block has terms
    terms = written(tier_limits(postings, n_docs, tier_rows, growth))
    tier = F.expr(f"cast(size(filter(limits, x -> x > shiftright(impact, {LEVEL}))) as int)")
    index = written(postings.join(F.broadcast(terms.select("term", "limits")), "term").select("row", "term", "impact", tier.alias("tier")), "tier")
    known = spark.createDataFrame(list(enumerate(names)), "term int, name binary")
    asked = written(queries.select("query", F.explode("names").alias("name")).join(F.broadcast(known), "name").join(F.broadcast(terms.drop("limits")), "term").select("query", "term", "df", "w", "residual"))

    best = lambda *order: F.row_number().over(Window.partitionBy("query").orderBy(*order))
    met = index.where("tier = 0").join(F.broadcast(asked.select("query", "term", "w")), "term")
    met = met.groupBy("query", "row").agg(F.sum(F.col("w") * F.col("impact")).alias("seen"))
    first = written(met.withColumn("place", best(F.desc("seen"), "row")).where(F.col("place") <= FIRST * k).select("query", "row"))
    scored = whole_scores(first, counts, asked, n_docs, n_terms)
    threshold = scored.withColumn("place", best(F.desc("score"))).where(F.col("place") == k).select("query", F.col("score").alias("threshold"))

    # how deep each query must read each of its terms
    running = Window.partitionBy("query").orderBy(F.desc("df"), "term").rowsBetween(Window.unboundedPreceding, 0)
    left = asked.join(threshold, "query", "left").fillna(0, ["threshold"]).withColumn("top", F.col("w") * F.col("residual")[0])
    left = left.withColumn("shallow", 2 * F.sum("top").over(running) <= F.col("threshold"))
    last = terms.agg(F.coalesce(F.max(F.size("residual")), F.lit(1)) - 1).first()[0]
    after = lambda depth: F.col("w") * F.get("residual", F.least(depth, F.size("residual") - 1))
    bound = left.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(last)))).groupBy("query", "threshold", "depth")
    bound = bound.agg(F.sum(F.when(F.col("shallow"), F.col("top")).otherwise(after(F.col("depth")))).alias("bound"))
    depth = bound.groupBy("query").agg(F.coalesce(F.min(F.when(F.col("bound") < F.col("threshold"), F.col("depth"))), F.lit(last)).alias("depth"))
    reads = left.join(depth, "query").withColumn("reads", F.when(F.col("shallow"), 0).otherwise(F.col("depth"))).withColumn("rest", after(F.col("reads")))
    reads = written(reads.select("query", "term", "w", "depth", "reads", "rest", "threshold", F.sum("rest").over(Window.partitionBy("query")).alias("bound")))

    deepest = reads.agg(F.coalesce(F.max("reads"), F.lit(0))).first()[0]
    met = index.where(F.col("tier") <= deepest).join(F.broadcast(reads), "term").where("tier <= reads")
    met = met.groupBy("query", "row").agg(F.sum(F.col("w") * F.col("impact") - F.col("rest")).alias("seen"), F.first("bound").alias("bound"), F.first("threshold").alias("threshold"))
    able = written(met.where("seen + bound >= threshold").select("query", "row"))
    scored = whole_scores(able, counts, asked, n_docs, n_terms).where("score > 0")
    ranked = scored.withColumn("rank", best(F.desc("score"), F.asc_nulls_last("doc_id"), "row")).where(F.col("rank") <= k)
    out = ranked.join(F.broadcast(reads.select("query", "depth").distinct()), "query").join(queries.select("query", "item_id"), "query")
    out = written(out.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score", (F.col("depth") + 1).cast("int").alias("tiers")))
    dropped(counts, terms, index, asked, first, reads, able)
    vocabulary.unpersist()
    return out


def search(
    docs: DataFrame, items: DataFrame, k: int = 10, text_col: str = "text", id_col: str = "doc_id", item_text: str = "text", item_id: str = "item_id", tier_rows: int = TIER_ROWS, growth: int = TIER_GROWTH, block_terms: int = BLOCK_TERMS
) -> DataFrame:
    """(item_id, rank, doc_id, score, tiers): the ``k`` best rows of ``docs`` for each row of ``items``; exact.

    Scores above 0 only, equal ones by ascending id, null ids last. ``tiers`` is the number of tiers
    that the proof took. Null and empty texts have no terms: such items get no rows, such documents
    don't count. Rows that share an id are rows of their own, on both sides. Other columns are dropped.
    The result is a written table in the shared folder.
    """
    queries = written(query_terms(items, item_text, item_id))
    total = queries.agg(F.coalesce(F.sum(F.size("names")), F.lit(0))).first()[0]
    blocks, out = max(1, -(-total // block_terms)), None
    for b in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b)
        found = block_search(docs, part, k, text_col, id_col, tier_rows, growth)
        out = found if out is None else out.unionByName(found)
    dropped(queries)
    return out
