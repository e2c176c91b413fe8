import hashlib
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from keytide.llm import bpe, packing

LIBRARY = Tokenizer.from_file(bpe.default_path())
MODEL = bpe.model(bpe.default_path())


def library_ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=("Cs", "Cn")), max_size=40))
def test_any_text_like_the_library(text):
    ids = library_ids(text)
    assert MODEL.encode(text) == ids
    assert MODEL.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_words_with_many_merges_like_the_library():
    r = random.Random(5)
    for _ in range(3000):
        text = "".join(r.choice("aabcdeéthinger's ΣÇ.<|endoftext|>\x1c\x85") for _ in range(r.randint(0, 60)))
        assert MODEL.encode(text) == library_ids(text), repr(text)


def test_special_tokens_and_long_words():
    for text in ("a<|endoftext|>B <|startoftext|>", "<|endoftext|><|endoftext|>", "x" * 30_000, "ab" * 5_000 + "<|end", "É" * 2_000):
        assert MODEL.encode(text) == library_ids(text)
    assert MODEL.plain(MODEL.encode("Hello  wörld's 12")) == "hello wörld 's 1 2"


def rows(spark):
    return spark.createDataFrame([(1, "Hello wörld", "x"), (2, None, "y"), (2, "", "y"), (None, "b " * 3000, None), (5, "c " * 5000, "z")], "doc_id long, text string, ids string")


def test_encode_rows(spark):
    got = {(r.doc_id, r.n_tokens): r for r in bpe.digests(rows(spark)).collect()}
    assert len(got) == 4 and (2, 0) in got and got[2, 0].ids_sha256 == hashlib.sha256(b"").hexdigest()
    ids = library_ids("Hello wörld")
    assert got[1, len(ids)].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert got[1, len(ids)].decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    full = bpe.encode(rows(spark)).where("doc_id = 1").first()
    assert full.ids == ids
    assert bpe.digests(rows(spark).limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 4), max_size=8), st.integers(1, 120))
def test_best_fill_is_best(waiting, room):
    sums = {0}
    for length, times in waiting.items():
        sums = {s + k * length for s in sums for k in range(times + 1)}
    chosen = packing.best_fill(waiting, room)
    assert sum(n * k for n, k in chosen.items()) == max(s for s in sums if s <= room)
    assert all(k <= waiting[n] for n, k in chosen.items())


def whole(pieces, lengths, capacity):
    by_doc, by_window = {}, {}
    for k, start, n, w, at in pieces:
        by_doc.setdefault(k, []).append((start, n))
        by_window.setdefault(w, []).append((at, n))
    for k, n in enumerate(lengths):
        at = 0
        for start, size in sorted(by_doc.get(k, [])):
            assert start == at and size > 0
            at += size
        assert at == n
    for parts in by_window.values():
        at = 0
        for start, size in sorted(parts):
            assert start == at
            at += size
        assert at == capacity or at < capacity and at & (at - 1) == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 200), max_size=40))
def test_every_token_in_one_piece_without_padding(lengths):
    whole(packing.pack(lengths, 64), lengths, 64)


def test_pack_documents(spark):
    got = packing.pack_documents(rows(spark), with_ids=True).collect()
    assert {r.doc_id for r in got} == {1, 2, None, 5}
    for r in got:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
    assert sorted(r.doc_tokens for r in got if r.doc_id == 2) == [1, 1]
    assert sum(r.length for r in got) == 5001 + 3001 + 1 + 1 + len(library_ids("Hello wörld")) + 1
    windows = {}
    for r in got:
        windows[r.sequence_id] = windows.get(r.sequence_id, 0) + r.length
    assert all(n == 2048 or n & (n - 1) == 0 for n in windows.values())
    assert packing.pack_documents(rows(spark).limit(0)).count() == 0


def test_small_caches_give_the_same_ids():
    rng = random.Random(5)
    text = " ".join("".join(rng.choice("abcdeé'1.") for _ in range(rng.randint(1, 12))) for _ in range(3000))
    path = bpe.default_path()
    assert bpe.WordBpe(path, 0.0001).packed(text) == bpe.WordBpe(path).packed(text)


def test_several_blocks_and_partitions(spark):
    rng = random.Random(8)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.choice((0, 3, 90, 700))))) for i in range(400)], "doc_id long, text string").repartition(5)
    got = packing.pack_documents(docs, capacity=256, block_tokens=3000, with_ids=True).collect()
    assert len({r.sequence_id >> 32 for r in got}) == 5
    windows, pieces = {}, {}
    for r in got:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append(r)
    for parts in windows.values():  # gapless, full or a power of two: so no number is used for two windows
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == 256 or at & (at - 1) == 0
    for x in docs.collect():
        ids = [i for r in sorted(pieces[x.doc_id], key=lambda r: r.start) for i in r.ids]
        assert ids == [*library_ids(x.text), 1]
    assert sum(len(parts) for parts in windows.values()) == len(got) and len(windows) > 100


def test_texts_encoded_together_are_what_each_is_alone():
    rng = random.Random(11)
    parts = ["lación", "queño", "ing", "ä", "Ñ", "don't", "x" * 45, "y1", "9", "é" * 17, "ß" * 40, ".,", "的", "\U0001f600", "<|endoftext|>", "<|", "\x1c", "Σ", "e\u0301", "a" * 31, "tion"]
    many = ["", " ", *("".join(rng.choice(parts) + rng.choice(["", "", " ", "\n", "\x85"]) for _ in range(rng.randint(1, 60))) for _ in range(300))]
    alone = bpe.WordBpe(bpe.default_path())
    want = [alone.packed(x) for x in many]
    for kept in (1.0, 0.00001):
        m = bpe.WordBpe(bpe.default_path(), kept)
        assert [ids for k in range(0, len(many), 7) for ids in m.packed_all(many[k : k + 7])] == want
        assert m.packed_all(many) == want and not any(len(x) > 40 for cache in (m.packed_words, m.packed_pieces) for x in cache)
