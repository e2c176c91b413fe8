import itertools
import random
import sys
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from keytide.llm import bpe, simhash

sys.path.insert(0, __file__.rsplit("/", 1)[0])
from test_pii import brute as personal  # noqa: E402
from test_substring import brute as passages  # noqa: E402


def shingles(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)])


def expected(rows):
    """{id: text} after the first four stages, in plain Python."""
    rows = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    f = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for _ in rows:
        for i, j in itertools.combinations(range(len(rows)), 2):
            if 5 * len(f[i] & f[j]) >= 4 * len(f[i] | f[j]):
                label[i] = label[j] = min(label[i], label[j])
    best = {}
    for k, (i, _) in zip(label, rows):
        best[k] = min(i, best.get(k, i))
    rows = [(i, t) for k, (i, t) in zip(label, rows) if best[k] == i]
    cut = {x[0]: x for x in passages(rows, 50)}
    out = {}
    for i, t in rows:
        t = cut[str(i)][4] if cut[str(i)][2] else t
        text, at = "", 0
        for s, _, e, kind in personal(t):
            text += t[at:s] + f"[{kind.upper()}]" if s >= at else ""
            at = max(at, e)
        out[i] = text + t[at:]
    return out


def test_pipeline_against_plain_python(spark, tmp_path):
    r = random.Random(11)
    words = [f"word{i}x" for i in range(900)] + ["Über", "a@b.example.com", "10.0.0.7", "4111111111111111", "+1 (988) 555-2485"]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage = prose(80)
    rows = [(i, prose(r.randint(20, 600))) for i in range(40)]
    rows += [(100 + i, f"{prose(30)} {passage} {prose(25)}") for i in range(6)]
    rows += [(200 + i, t) for i, t in rows[:6]] + [(300 + i, " ".join(w for k, w in enumerate(t.split()) if k != 9) + " end") for i, t in rows[30:36] if len(t) > 1500]
    rows += [(400, None), (401, ""), (402, "12 34 !"), (403, "the " * 4000)]
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    want = expected(rows)
    assert len(want) < len(rows) - 8

    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns and now.dtypes == docs.dtypes
    got = {x.doc_id: x for x in now.collect()}
    assert {i: x.text for i, x in got.items()} == want
    assert all(x.n_chars == len(x.text) and x.source == "src0" for x in got.values())

    library = Tokenizer.from_file(bpe.default_path())
    pieces, windows = defaultdict(list), defaultdict(list)
    for x in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces[x.doc_id].append(x)
        windows[x.sequence_id].append(x)
    assert set(pieces) == set(want)
    for i, t in want.items():
        ids, at = [*library.encode(t, add_special_tokens=False).ids, 1], 0
        for x in sorted(pieces[i], key=lambda x: x.start):
            assert x.start == at and x.doc_tokens == len(ids)
            at += x.length
            assert x.ids_crc32 == zlib.crc32(np.array(ids[x.start : at], "<u4").tobytes())
        assert at == len(ids)
    for w in windows.values():
        total = sum(x.length for x in w)
        assert total == 2048 or total & (total - 1) == 0


def test_keep_one_of_repeated_and_null_ids(spark):
    text = "one two three four five six"
    docs = spark.createDataFrame([(7, text), (7, text), (9, text), (None, text), (None, "quite another text of seven words"), (None, "quite another text of seven words")], "doc_id long, text string")
    got = sorted((str(x.doc_id), x.text[:5]) for x in simhash.keep_one(docs).collect())
    assert got == [("7", "one t"), ("None", "quite")]


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
