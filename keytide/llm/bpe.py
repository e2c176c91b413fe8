"""Exact BPE encoding by dynamic programming over prefixes, and decoding.

A BPE encoding has one property that makes greedy merging unnecessary: every prefix of a word has
exactly one valid encoding, and a token sequence is that encoding just when each two neighbours
are what BPE makes of their joined text. So for every prefix one number is enough, the last token
of its encoding. It is found among the tokens that end there (an automaton with suffix links
gives them all), as the one whose predecessor, the last token of the shorter prefix, is compatible
with it. Following the stored tokens backwards gives the ids.

Time is linear in the word for a bounded token length; a word of 100,000 letters is no trouble,
as merging by priority would be.

``packed_all`` encodes many texts at once: their new short words are merged by priority, all in step
in a matrix, which for words of a few letters takes a fraction of the time and gives the same ids.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keytide.llm.common import in_batches, keeps, texts

#: Stands for the end-of-word mark inside the automaton; no byte symbol maps to it.
END = "\x00"
#: Stretches of text, words and pair tests that a worker keeps in its caches, each emptied beyond its number.
CACHE_WORDS, CACHE_PIECES, CACHE_PAIRS = 350_000, 650_000, 400_000
#: The same for stretches of text whose ids alone are kept.
CACHE_PACKED = 800_000
#: Bytes of the longest word that is merged in a matrix, the widths of these, and their rows.
MOST_BYTES, WIDTHS, MATRIX_ROWS = 32, (8, 12, 16, 32), 1 << 14
#: Space to Python, but not to the tokenizer's pattern engine; texts that hold one are cut by pattern.
NOT_SPACE = "\x1c\x1d\x1e\x1f"
#: White space of the pattern engine.
SPACE = r"\t\n\x0b\x0c\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> dict[int, str]:
    """The printable symbol of each byte, by the public rule of byte-level BPE."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordBpe:
    """A BPE model with an end-of-word mark, from a ``tokenizers`` JSON file.

    ``kept`` is the share of the caches' full size: less takes less memory and more time, for the same ids.
    """

    def __init__(self, path: str, kept: float = 1.0):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.names = {i: t for t, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names |= {i: t for t, i in self.special.items()}
        self.symbol = byte_symbols()
        self.byte = {s: b for b, s in self.symbol.items()}
        self.rank: dict[tuple[int, int], int] = {}  # by priority
        self.parts: dict[int, tuple[int, int, int]] = {}  # token: priority of its own merge, left, right
        self.merged: dict[tuple[int, int], int] = {}
        for k, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pair = self.vocab[left], self.vocab[right]
            self.rank.setdefault(pair, k)
            made = self.vocab[left + right]
            self.parts.setdefault(made, (k, *pair))
        self.automaton = ahocorasick.Automaton()
        for token, i in self.vocab.items():
            inner = token[: -len(self.suffix)] + END if token.endswith(self.suffix) else token
            self.automaton.add_word(inner, (len(inner), i))
        self.automaton.make_automaton()
        self.most_words, self.most_packed, self.most_pieces, self.most_pairs = (int(kept * n) for n in (CACHE_WORDS, CACHE_PACKED, CACHE_PIECES, CACHE_PAIRS))
        self.fits: dict[int, bool] = {}
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^" + SPACE + r"\p{L}\p{N}]+")
        self.split_special = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")") if self.special else None
        self.spaces = regex.compile("[" + SPACE + "]+")
        self.packed_pieces: dict[str, bytes] = {}
        self.packed_words: dict[str, bytes] = {}
        self.shown_words: dict[str, tuple[str, str]] = {}
        self.letters = [self.symbol[b] for b in range(256)]
        # for words in a matrix: tokens of single bytes, inside and at the end of a word, and merges by pair
        self.inside, self.ending = (np.array([self.vocab.get(s + mark, -1) for s in self.letters]) for mark in ("", self.suffix))
        self.pairs, self.pair_ranks = np.ascontiguousarray(np.array(sorted((a << 32 | b, k) for (a, b), k in self.rank.items()), dtype=np.int64).reshape(-1, 2).T)
        self.makes = np.array([self.vocab[m.replace(" ", "", 1) if isinstance(m, str) else "".join(m)] for m in model["merges"]], dtype=np.int64)

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE leaves ``left`` and ``right`` as they are when their texts stand together.

        Replays the merges across the border, latest first: undoing the later of the two tokens'
        own merges shows which parts met at the border when it happened. A merge of the two parts
        that would have come before the undone one (equal priority: the left one goes first) takes
        the border away.
        """
        a, b = left, right
        limit = (1 << 60, 0)  # the priority, and whether it stands right of the border, of the merge last undone
        ok = True
        while True:
            k = self.rank.get((a, b))
            # the merge at the border stands right of one undone in ``left`` and left of one in ``right``
            if k is not None and (k, 1) < limit:
                ok = False
                break
            pa_, pb = self.parts.get(a), self.parts.get(b)
            if pa_ is None and pb is None:
                break
            if pb is None or (pa_ is not None and pa_[0] > pb[0]):
                limit, a = (pa_[0], 0), pa_[2]
            elif pa_ is None or pb[0] > pa_[0]:
                limit, b = (pb[0], 2), pb[1]
            else:  # the same merge on both sides: the left one was done first, so the right one is undone first
                limit, b = (pb[0], 2), pb[1]
        return ok

    def encode_word(self, word: str) -> list[int]:
        """Token ids of one word, given as byte symbols."""
        inner = word + END
        n = len(inner)
        last, length_of = [-1] * (n + 1), [0] * (n + 1)
        fits, compatible = self.fits, self.compatible
        for at, (length, token) in self.automaton.iter(inner):  # all tokens that end at each place, longest first
            if last[at + 1] >= 0:
                continue
            if before := at + 1 - length:
                left = last[before]
                if left < 0:
                    continue
                pair = left << 32 | token
                ok = fits.get(pair)
                if ok is None:
                    if len(fits) >= self.most_pairs:
                        fits.clear()
                    ok = fits[pair] = compatible(left, token)
                if not ok:
                    continue
            last[at + 1], length_of[at + 1] = token, length
        ids, at = [], n
        while at:
            ids.append(last[at])
            at -= length_of[at]
        ids.reverse()
        return ids

    def normal(self, text: str) -> str:
        """NFC, then lower case one character at a time (no final-sigma rule)."""
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Priorities of pairs of tokens; the number of merges where there is none."""
        none = len(self.makes)
        if not none:
            return np.zeros(left.shape, dtype=np.int64)
        pair = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pair, self.pair_ranks[at], none)

    def merged_words(self, raw: list[bytes], width: int) -> list[bytes]:
        """Packed ids of words of 1 to ``width`` bytes: in each step, every word makes its first merge of least rank."""
        n = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        flat = np.frombuffer(b"".join(raw), dtype=np.uint8)
        cells = np.arange(width) < n[:, None]
        ids = np.full((len(raw), width + 1), -1)
        ids[:, :width][cells] = self.inside[flat]
        ids[np.arange(len(raw)), n - 1] = self.ending[flat[np.cumsum(n) - 1]]
        none = len(self.makes)
        rank = np.full((len(raw), width + 1), none)
        more = cells[:, 1:]  # pairs that lie in a word
        rank[:, : width - 1][more] = self.ranks(ids[:, : width - 1][more], ids[:, 1:width][more])
        done, now, at = ids.copy(), np.arange(len(raw)), np.arange(width + 1)
        while len(now):
            first = rank.argmin(axis=1)
            rows = np.arange(len(now))
            least = rank[rows, first]
            goes = least < none
            if not goes.all():
                done[now[~goes]] = ids[~goes]
                ids, rank, now, first, least = ids[goes], rank[goes], now[goes], first[goes], least[goes]
                rows = np.arange(len(now))
            after = at[:-1] > first[:, None]
            ids[:, :-1] = np.where(after, ids[:, 1:], ids[:, :-1])
            rank[:, :-1] = np.where(after, rank[:, 1:], rank[:, :-1])
            ids[rows, first] = self.makes[least]
            for shift in (-1, 0):  # the pairs left and right of the new token
                k = first + shift
                ok = (k >= 0) & (ids[rows, k + 1] >= 0)
                new = np.full(len(k), none)
                new[ok] = self.ranks(ids[rows[ok], k[ok]], ids[rows[ok], k[ok] + 1])
                inside = k >= 0
                rank[rows[inside], k[inside]] = new[inside]
        there = done >= 0
        blob = done[there].astype("<u4").tobytes()
        ends = (4 * np.cumsum(there.sum(axis=1))).tolist()
        return [blob[a:b] for a, b in zip([0, *ends], ends)]

    def learn_pieces(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """Packed ids of words of the tokenizer, all at once where they are short."""
        if (self.inside < 0).any() or (self.ending < 0).any():
            return {x: self.encode_piece(x) for x in pieces}
        by_width: dict[int, list[str]] = {w: [] for w in WIDTHS}
        got = {}
        for x in pieces:
            n = len(x.encode())
            if n <= MOST_BYTES:
                by_width[next(w for w in WIDTHS if n <= w)].append(x)
            else:
                got[x] = self.encode_piece(x)
        for width, some in by_width.items():
            for k in range(0, len(some), MATRIX_ROWS):
                part = some[k : k + MATRIX_ROWS]
                got.update(zip(part, self.merged_words([x.encode() for x in part], width)))
        return got

    def packed_all(self, many: Iterable[str]) -> list[bytes]:
        """``packed`` of each text, with the words that no cache has encoded together."""
        out: list = []
        new: set[str] = set()
        get = self.packed_words.get
        for text in many:
            if "<|" in text:  # may hold a special token
                out.append(self.packed(text))
                continue
            words = self.chunks(text)
            codes = list(map(get, words))
            holes = [k for k, c in enumerate(codes) if c is None]
            if holes:
                missing = [words[k] for k in holes]
                new.update(missing)
                out.append((codes, holes, missing))
            else:
                out.append(b"".join(codes))
        if not new:
            return out
        parts = {w: self.pieces_of(w) for w in new}
        known, cached = self.packed_pieces, self.packed_words
        if len(known) > self.most_pieces:
            known.clear()
        if len(cached) > self.most_packed:
            cached.clear()
        known.update(self.learn_pieces({x for some in parts.values() for x in some if x not in known}))
        made = {w: known[some[0]] if len(some) == 1 else b"".join([known[x] for x in some]) for w, some in parts.items()}
        cached.update(made)
        for at, x in enumerate(out):
            if not isinstance(x, bytes):
                codes, holes, missing = x
                for k, w in zip(holes, missing):
                    codes[k] = made[w]
                out[at] = b"".join(codes)
        for w in [w for w in new if len(w) > 40]:  # a cache holds short words only
            cached.pop(w)
            for x in parts[w]:
                known.pop(x, None)
        return out

    def encode_piece(self, piece: str) -> bytes:
        """Ids of one word of the tokenizer, packed."""
        letters = self.letters
        return b"".join([i.to_bytes(4, "little") for i in self.encode_word("".join([letters[b] for b in piece.encode()]))])

    def packed_piece(self, piece: str) -> bytes:
        value = self.encode_piece(piece)
        if len(piece) <= 40:
            if len(self.packed_pieces) >= self.most_pieces:
                self.packed_pieces.clear()
            self.packed_pieces[piece] = value
        return value

    def encode_chunk(self, chunk: str) -> bytes:
        """Packed ids of a stretch of text without white space, which may be several words to the tokenizer."""
        get, make = self.packed_pieces.get, self.packed_piece
        return b"".join([get(x) or make(x) for x in self.pieces_of(chunk)])

    def pieces_of(self, chunk: str) -> list[str]:
        """The words that a stretch of text without white space is to the tokenizer."""
        chunk = self.normal(chunk)
        if chunk.isalpha():  # just the characters of \p{L}
            return [chunk]
        if chunk[-1] in ".,;:!?" and chunk[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return self.pieces.findall(chunk)

    def packed_chunk(self, chunk: str) -> bytes:
        value = self.encode_chunk(chunk)
        if len(chunk) <= 40:
            if len(self.packed_words) >= self.most_packed:
                self.packed_words.clear()
            self.packed_words[chunk] = value
        return value

    def shown_chunk(self, chunk: str) -> tuple[str, str]:
        ids = np.frombuffer(self.encode_chunk(chunk), "<u4").tolist()
        value = " ".join(map(str, ids)), " ".join([self.names[i] for i in ids])
        if len(chunk) <= 40:
            if len(self.shown_words) >= self.most_words:
                self.shown_words.clear()
            self.shown_words[chunk] = value
        return value

    def chunks(self, text: str) -> list[str]:
        """The stretches between white space; no word of the tokenizer crosses one."""
        if any(c in text for c in NOT_SPACE):
            return [x for x in self.spaces.split(text) if x]
        return text.split()

    def parts_of(self, text: str | None) -> list[tuple[bool, str]]:
        """(is a special token, part): a special token's text is cut out before all else."""
        if not text:
            return []
        if self.split_special and "<|" in text:
            return [(bool(k % 2), part) for k, part in enumerate(self.split_special.split(text)) if part]
        return [(False, text)]

    def packed(self, text: str | None) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit numbers."""
        get, make = self.packed_words.get, self.packed_chunk
        return b"".join([self.special[part].to_bytes(4, "little") if special else b"".join([get(w) or make(w) for w in self.chunks(part)]) for special, part in self.parts_of(text)])

    def shown(self, text: str | None) -> tuple[str, str]:
        """The ids of a text in decimal, and what they decode to."""
        get, make = self.shown_words.get, self.shown_chunk
        found: list[tuple[str, str]] = []
        for special, part in self.parts_of(text):
            found += [(str(self.special[part]), part)] if special else [get(w) or make(w) for w in self.chunks(part)]
        return " ".join([x[0] for x in found]), " ".join([x[1] for x in found])

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text), "<u4").tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """Token texts joined by one space, as a tokenizer file without a decoder asks for."""
        return " ".join(self.names[i] for i in ids)

    def plain(self, ids: Iterable[int]) -> str:
        """The words behind the ids: bytes put together, a space where a word ends."""
        out = bytearray()
        for i in ids:
            name = self.names[i]
            if name in self.special:
                out += name.encode()
                continue
            word = name.removesuffix(self.suffix)
            out += bytes(self.byte[c] for c in word)
            if name.endswith(self.suffix):
                out += b" "
        return out.decode(errors="replace").rstrip(" ")


_models: dict[tuple[str, float], WordBpe] = {}


def model(path: str, kept: float = 1.0) -> WordBpe:
    """The model of a file, read once in each worker, which holds one at a time."""
    if (path, kept) not in _models:
        _models.clear()
        _models[path, kept] = WordBpe(path, kept)
    keeps(__name__, _models.clear)
    return _models[path, kept]


def encode(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", path: str | None = None, decoded: bool = True) -> DataFrame:
    """(id, ids array<int>, n_tokens, decoded) of every text; nothing is shuffled.

    A null or empty text has no ids and decodes to the empty string. Rows are independent: repeated
    ids and null ids each keep their row, and no other column of ``docs`` is read. ``decoded`` is
    what the tokenizer file's own decoding gives, null where it isn't asked for.
    """
    path = path or default_path()

    @in_batches
    def run(batch):
        m = model(path)
        all_ids = [m.encode(raw.decode()) for raw in texts(batch.column(1))]
        back = [m.decode(ids) if decoded else None for ids in all_ids]
        return {id_col: batch.column(0), "ids": pa.array(all_ids, pa.list_(pa.int32())), "n_tokens": pa.array([len(x) for x in all_ids], pa.int64()), "decoded": pa.array(back, pa.string())}

    kind = dict(docs.select(F.col(id_col)).dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, n_tokens long, decoded string")


def digests(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", path: str | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): what ``encode`` gives, hashed where it is made."""
    path = path or default_path()

    @in_batches
    def run(batch):
        m = model(path)
        n, of_ids, of_text = [], [], []
        for raw in texts(batch.column(1)):
            ids, back = m.shown(raw.decode())
            n.append(ids.count(" ") + 1 if ids else 0)
            of_ids.append(hashlib.sha256(ids.encode()).hexdigest())
            of_text.append(hashlib.sha256(back.encode()).hexdigest())
        return {id_col: batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(of_ids), "decoded_sha256": pa.array(of_text)}

    kind = dict(docs.select(F.col(id_col)).dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
