import itertools
import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from keytide.llm import langid, toxicity

ODD = [(900001, None, "en"), (900002, "", "en"), (900003, "12 ... !?", None), (900004, "the " * 30_000, "en"), (900004, "the " * 30_000, "en"), (None, "der die das", "de")]


def docs(spark, sf="sf0.01"):
    d = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text", "lang")
    return d.unionByName(spark.createDataFrame(ODD, "doc_id long, text string, lang string")).withColumn("score", F.lit("x")).withColumn("held_out", F.lit(1))


def test_language_of_held_out_texts(spark):
    got = langid.identify(docs(spark)).join(docs(spark).select("doc_id", "lang", F.length("text").alias("n")), "doc_id").where("held_out and lang is not null and n > 60").collect()
    assert len(got) > 150
    right = sum(r.lang_pred == r.lang for r in got) / len(got)
    assert right > 0.97, right
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_odd_rows(spark):
    got = [(r.doc_id, r.lang_pred) for r in langid.identify(docs(spark, "sf0.001")).collect() if r.doc_id is None or r.doc_id > 900000]
    assert Counter(got) == Counter([(900001, "und"), (900002, "und"), (900003, "und"), (900004, "en"), (900004, "en"), (None, "de")])
    empty = docs(spark, "sf0.001").limit(0)
    assert langid.identify(empty).count() == 0
    unlabelled = docs(spark, "sf0.001").withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(unlabelled).collect()} == {"und"}


def test_grams_against_a_plain_count():
    text = "Été, 12 mots!  Ça va?\nétÉ"
    words = ["été", "mots", "ça", "va", "été"]
    line = "_" + "_".join(words) + "_"
    want = Counter(line.replace("_", ""))
    for n in (2, 3):
        want.update(g for g in ("".join(x) for x in zip(*(line[i:] for i in range(n)))) if g[1 if n == 3 else 0] != "_" or (n == 2 and g[1] != "_"))
    code, count = np.unique(langid.grams(text), return_counts=True)
    assert sum(count) == sum(want.values()) and sorted(count) == sorted(want.values())
    assert langid.ranked(langid.grams("aaa"))[0] == ord("a")


def test_ordinal_gradient_points_downhill():
    r = np.random.default_rng(0)
    n, hot = 3000, np.array([3, 5, 7])
    x = r.random((n, 20)) < 0.3
    z = x[:, hot] @ np.array([2.0, 3.0, 4.0]) + r.logistic(size=n)
    grade = np.digitize(z, [3.0, 6.0])
    row, at = np.nonzero(x)
    w, theta = toxicity.fit(at, row, np.ones(len(at)), grade, 3, 32, ridge=0.0, rounds=800)
    assert theta[0] < theta[1]
    assert np.allclose(w[hot], [2, 3, 4], atol=0.4) and np.abs(np.delete(w, hot)).max() < 0.4
    p = toxicity.grade_chances(np.array([-9.0, 0.0, 9.0]), theta)
    assert np.allclose(p.sum(axis=1), 1) and (p >= 0).all()
    assert all(a < b for a, b in itertools.pairwise(p @ np.arange(3)))


def test_toxic_texts_without_their_labels(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", F.col("toxic").alias("grade"))
    train = labels.where("doc_id % 3 != 0")
    got = toxicity.grade_documents(d, train).join(labels.where("doc_id % 3 = 0").select("doc_id"), "doc_id").collect()
    truth = {r.doc_id: r.grade for r in labels.collect()}
    found = sum(r.toxic and truth[r.doc_id] == 1 for r in got)
    false = sum(r.toxic and truth[r.doc_id] == 0 for r in got)
    there = sum(truth[r.doc_id] == 1 for r in got)
    print("toxic", there, "found", found, "false", false, "of", len(got))
    assert found >= 0.88 * there and false <= 0.01 * (len(got) - there)


def test_toxicity_of_odd_rows(spark):
    d = docs(spark, "sf0.001")
    labels = spark.createDataFrame([(1, 0), (2, None), (None, 1), (3, 1), (3, 0), (900001, 0)], "doc_id long, grade int")
    got = toxicity.grade_documents(d.withColumn("grade", F.lit("x")), labels).collect()
    assert len(got) == d.count() and all(0 <= r.severity <= 2 for r in got)
    none = toxicity.grade_documents(d, labels.limit(0)).collect()
    assert {r.severity for r in none} == {0.0}
    assert toxicity.grade_documents(d.limit(0), labels).count() == 0


def plain_grams(text):
    """All n-grams of a text as (n, code points), 0 for a border between words."""
    s = [0]
    for c in f"{text.lower()} ":
        code = ord(c) if c.isalpha() and ord(c) < 1 << 20 else 0
        if code or s[-1]:
            s.append(code)
    one = [(1, x) for x in s if x]
    two = [(2, *s[i : i + 2]) for i in range(len(s) - 1)]
    return one + two + [(3, *s[i : i + 3]) for i in range(len(s) - 2) if s[i + 1]]


def test_profiles_and_distances_against_plain_python(spark):
    from collections import Counter

    from keytide.llm import langid

    size = 60
    texts = [("aa", "baba lala Baba, ala!"), ("aa", "la ba la ba bala"), ("bb", "zyx zyz xyz Yzx"), ("bb", "xyzzy zy? yx"), ("cc", "élé àlà éàl"), ("cc", "Élà"), (None, "baba zyx"), (None, "lé"), (None, "12 !"), (None, None), (None, ""), (None, "qqq"), (None, "ab" * 3000)]
    docs = spark.createDataFrame([(k * 4 + 1, t, lang, t) for k, (lang, t) in enumerate(texts)], "doc_id long, text string, lang string, score string").repartition(3)
    held = {r.doc_id: r.h for r in docs.select("doc_id", langid.held_out("doc_id").alias("h")).collect()}
    rank = lambda c: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:size]]
    counts = {}
    for k, (lang, t) in enumerate(texts):
        if lang and not held[k * 4 + 1]:
            counts.setdefault(lang, Counter()).update(plain_grams(t))
    profile = {lang: {g: i for i, g in enumerate(rank(c))} for lang, c in counts.items()}
    got = {r.doc_id: r for r in langid.identify(docs, size=size).collect()}
    for k, (_, t) in enumerate(texts):
        mine = rank(Counter(plain_grams(t or "")))
        want = ("und", 0.0)
        if mine:
            d = {lang: sum(min(abs(p[g] - i), size) if g in p else size for i, g in enumerate(mine)) / len(mine) / size for lang, p in profile.items()}
            best = min(sorted(d), key=d.get)
            want = (best, 1 - d[best])
        x = got[k * 4 + 1]
        assert x.lang_pred == want[0] and abs(x.score - want[1]) < 1e-12 and x.held_out == held[k * 4 + 1], (t, want, x)


def test_texts_in_an_unlearnt_language_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("known", F.col("lang"))
    for away in ("es", "de"):
        told = docs.withColumn("lang", F.when(F.col("lang") != away, F.col("lang")))
        kept = {r.known: r.n for r in langid.keep_known(told).groupBy("known").agg(F.count("*").alias("n")).collect()}
        all_ = {r.known: r.n for r in docs.groupBy("known").agg(F.count("*").alias("n")).collect()}
        assert kept.get(away, 0) <= 0.15 * all_[away]  # short ones
        assert sum(n for k, n in kept.items() if k != away) >= 0.995 * sum(n for k, n in all_.items() if k != away)
    assert langid.keep_known(docs).count() >= 0.995 * docs.count()
    assert langid.keep_known(docs, least=0.0).count() == docs.where("text rlike '[A-Za-z]'").count()
    assert langid.keep_known(docs.withColumn("lang", F.lit(None).cast("string"))).count() == 0


def test_whole_grades_equal_plain_sums_and_the_highest_label_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(None, None), (70001, ""), (70002, "the " * 3000)], docs.schema))
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    highest = labels.select("doc_id", (F.col("toxic") * 2).alias("grade"))
    several = highest.unionByName(highest.withColumn("grade", F.lit(0))).unionByName(highest.where("grade = 2").withColumn("grade", F.lit(1)))
    w, theta = toxicity.train(docs, highest)
    w2, theta2 = toxicity.train(docs, several)
    assert np.allclose(w, w2, atol=1e-6) and np.allclose(theta, theta2, atol=1e-6)
    got = {x.doc_id: x for x in toxicity.grade_documents(docs, several).collect()}
    rows = docs.collect()
    assert len(got) == len({x.doc_id for x in rows})
    for x in rows:
        at, value = toxicity.features((x.text or "").encode())
        z = sum(float(w[a]) * float(v) for a, v in zip(at, value))
        below = [1 / (1 + math.exp(-min(40, max(-40, t - z)))) for t in theta] + [1.0]
        p = [b - a for a, b in zip([0.0, *below], below)]
        y = got[x.doc_id]
        assert abs(y.severity - (p[1] + 2 * p[2])) < 1e-6 and abs(y.p_toxic - (1 - p[0])) < 1e-6
        assert y.toxic == (y.p_toxic >= 0.5) and p[y.grade] >= max(p) - 1e-6


def test_least_scores_count_every_labelled_text(spark):
    rng = random.Random(8)
    words = {"aa": ["kilo", "maru", "tenno", "sabi", "woru"], "bb": ["dref", "glint", "spork", "brunt", "clegs"]}
    both = words["aa"] + words["bb"]
    rows = [(" ".join(rng.choices(words[lang] if rng.random() < 0.9 else both, k=rng.randint(3, 9))), lang) for lang in words for _ in range(13_000)]
    labelled = spark.createDataFrame(rows, "text string, lang string").repartition(8)
    model = langid.learn(labelled)
    scores = {}
    for text, lang in rows:
        name, score, n = langid.judged_text(text, model)
        if name == lang:
            scores.setdefault(n.bit_length(), []).append(score)
    want = {bits: langid.MARGIN * sorted(x)[max(0, math.ceil(langid.LOW * len(x)) - 1)] for bits, x in scores.items()}
    got = langid.least_scores(labelled, model)
    assert got.keys() == want.keys() and all(0 <= want[b] - got[b] <= langid.MARGIN / 10_000 + 1e-12 for b in want)
