import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from keytide.llm import queries, spelling


def distance_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def brute(words, ratio=10):
    form, out = {}, []
    for w, n in words.items():
        near = [(-m, v) for v, m in words.items() if distance_one(w, v)]
        best = min(near, default=None)
        form[w] = best[1] if best and -best[0] >= ratio * n else None
        out.append((w, n, len(near), form[w], -best[0] if form[w] is not None else None))
    root = lambda w: w if form[w] is None else root(form[w])
    return sorted((*x, root(x[0])) for x in out)


@pytest.mark.parametrize("seed,letters", [(1, "ab"), (2, "abé漢"), (3, "aàb𝒳")])
def test_equals_comparing_all_words(spark, seed, letters):
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(0, 8))): rng.choice((1, 1, 2, 10, 25, 100, 1000, 10_000)) for _ in range(500)}
    df = spark.createDataFrame([(w, n) for w, n in words.items()] + [(None, 5)], "word string, n int").withColumns({"id": F.lit(0), "key": F.lit("x")})
    got = spelling.group_variants(df.repartition(7))
    assert got.dtypes == [("word", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form", "string"), ("form_n", "bigint"), ("root", "string")]
    assert sorted(map(tuple, got.collect())) == brute(words)


def test_chains_of_forms_and_long_words(spark):
    words = {"a" * k: 10**k for k in range(1, 19)}
    long = "ab" + "".join(random.Random(5).choice("abc") for _ in range(100_000))
    words |= {long: 100, long[:50_000] + long[50_001:]: 5, long[:-1] + "z": 10, long[1] + long[0] + long[2:] + "q": 1}
    got = {r.word: r for r in spelling.group_variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert all(got["a" * k].root == "a" * 18 and got["a" * k].n_near == (1 if k in (1, 18) else 2) for k in range(1, 19))
    assert (got[long].n_near, got[long[:-1] + "z"].root, got[long[:50_000] + long[50_001:]].form) == (2, long, long)


def test_keys_are_those_of_the_strings():
    words = ["", "a", "aab", "abba", "Ωx", "𝒳𝒳y"]
    word, place, key = spelling.deletion_keys(words)
    of = lambda s: int(spelling.deletion_keys([s])[2][0])
    found = {(words[w], int(p)): int(k) for w, p, k in zip(word, place, key)}
    assert len(found) == len(word) == sum(1 + len({w[:i] + w[i + 1 :] for i in range(len(w))}) for w in words)
    assert all(k == of(w if p < 0 else w[:p] + w[p + 1 :]) for (w, p), k in found.items())
    assert len(spelling.deletion_keys([])[0]) == 0


def test_words_of_documents(spark, tmp_path):
    import zlib

    text = "Straße STRASSE, naïveté naïveté Éclairs×÷eclairs abcdefg ABCDEFGH_abcdefgh " + "x" * 70_000
    rows = [(k, text) for k in range(60)] + [(1, text), (None, "abcdefgh"), (7, None), (8, "")]
    spark.createDataFrame(rows, "doc_id int, text string").withColumns({"run": F.lit("a"), "word": F.lit(1)}).write.parquet(f"{tmp_path}/documents.parquet")
    words = Counter()
    import re

    for d, t in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r)
            h = zlib.crc32(f"{'' if d is None else d}:{r}".encode())
            words[r[: h % len(r)] + r[h % len(r) + 1 :] if h % 31 == 0 else r] += 1
    want = brute({w: n for w, n in words.items() if len(w) >= 7 and n >= 2})
    assert sorted(map(tuple, queries.op11_spelling(spark, str(tmp_path)).select("word", "n", "n_near", "form", "form_n", "root").collect())) == want
    assert any(x[3] for x in want)
    assert spelling.group_variants(spark.createDataFrame([], "word string, n long")).count() == 0
