import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from keytide.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    found = [(d, Counter(terms(t))) for d, t in docs]
    N, L = sum(bool(c) for _, c in found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in found:
            n = sum(c.values())
            m = 10 + 90 * n * N // max(L, 1)
            s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if s:
                scored.append((-s, d is None, d or 0))
        out += [(item, r + 1, None if x[1] else x[2], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def made(seed, n=400):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["Ähre", "ähre", "ÇA", "漢字", "naïve", "don't", "X1"]
    some = lambda size: " ".join(rng.choice(words[: rng.choice((5, 30, 307))]) for _ in range(size))
    docs = [(i, some(rng.choice((1, 5, 20, 200)))) for i in range(n)]
    docs += [(i, docs[i][1]) for i in range(20)] + [(n + i, docs[0][1].upper()) for i in range(30)] + [(None, docs[1][1]), (9001, None), (9002, ""), (9003, " .,; ")]
    return docs, [(i, some(rng.choice((1, 4, 30)))) for i in range(25)] + [(3, docs[5][1]), (None, "w1 W1 w2"), (50, None), (51, "?"), (52, "unknown")]


@pytest.mark.parametrize("seed,tier_rows,growth,block", [(1, 2, 2, 1 << 16), (2, 256, 16, 1 << 16), (3, 8, 3, 60)])
def test_equals_scores_of_all_documents(spark, seed, tier_rows, growth, block):
    docs, items = made(seed)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"row": F.lit("x"), "query": F.lit(1), "term": F.lit(None).cast("string")})
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(7))
    got = lexical.search(d.repartition(5), i, tier_rows=tier_rows, growth=growth, block_terms=block)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint"), ("tiers", "int")]
    rows = got.collect()
    assert sorted((tuple(r)[:4] for r in rows), key=str) == brute(docs, items, 10)
    if tier_rows == 2:  # proofs came from more than one depth
        assert len({r.tiers for r in rows}) > 2


def test_tiers_have_the_highest_impacts_first(spark):
    docs, _ = made(4)
    words = sorted({t.encode() for _, x in docs for t in terms(x)})
    counts = lexical.counted_terms(spark.createDataFrame(docs, "doc_id long, text string"), spark.sparkContext.broadcast({w: i for i, w in enumerate(words)}), "text", "doc_id")
    postings = lexical.with_impacts(counts, 450, 20_000).cache()
    limits = {r.term: r for r in lexical.tier_limits(postings, 450, 4, 3).collect()}
    lists = {}
    for r in postings.collect():
        lists.setdefault(r.term, []).append(r.impact)
    assert set(lists) == set(limits)
    for t, impacts in lists.items():
        r = limits[t]
        tier = [sum(x > (v >> lexical.LEVEL) for x in r.limits) for v in impacts]
        assert r.df == len(impacts) and len(r.residual) == max(tier) + 1
        for j, bound in enumerate(r.residual):
            assert bound == max([v for v, x in zip(impacts, tier) if x > j], default=0)
            assert all(v > bound for v, x in zip(impacts, tier) if x <= j)


def test_long_texts_and_empty_tables(spark):
    text = "Aa bb " * 400_000 + "x" * 3_000_000 + " é"
    assert lexical.term_counts(text.encode()) == (800_002, Counter({b"aa": 400_000, b"bb": 400_000, b"x" * 3_000_000: 1, "é".encode(): 1}))
    none = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert [lexical.search(d, i).count() for d, i in ((none[0], none[1]), (none[0], one[1]), (one[0], none[1]), one)] == [0, 0, 0, 1]
