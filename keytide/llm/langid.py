"""Language identification by rank-order profiles.

A profile lists the most frequent character n-grams (1 to 3 letters, word borders included) of a
language by rank. A text's own ranked list is compared with each by the out-of-place distance: how
far every n-gram stands from its place in the profile, with a fixed penalty where it is missing.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keytide.llm.common import in_batches, keeps, release_others, texts

#: N-grams of a profile and of a text's list; also the penalty of a missing one.
PROFILE = 400
UNKNOWN = "und"


@functools.cache
def letters() -> np.ndarray:
    """For every code point itself if it is a letter, else 0."""
    keeps(__name__, letters.cache_clear)
    return np.fromiter((c if c < 1 << 20 and chr(c).isalpha() else 0 for c in range(0x110000)), dtype=np.uint64, count=0x110000)


def grams(text: str) -> np.ndarray:
    """Codes of all n-grams of a text: 20 bits a letter, 0 for a word border, their number on top."""
    s = letters()[np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), dtype=np.uint32)]
    s = s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])]  # one border between words
    two = s[:-1] << np.uint64(20) | s[1:]
    three = s[:-2] << np.uint64(40) | two[1:] | np.uint64(3 << 60)
    return np.concatenate([s[s != 0], two[two != 0] | np.uint64(2 << 60), three[s[1:-1] != 0]])


def ranked(codes: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent codes, ties by code."""
    code, count = np.unique(codes, return_counts=True)
    return code[np.lexsort((code, -count))[:most]]


def held_out(id_col: str) -> Column:
    """Whether a row is kept from training: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def profiles(rows: DataFrame, size: int = PROFILE) -> dict[str, np.ndarray]:
    """Each language's ranked n-grams from all ``rows`` (text, lang); a few hundred numbers each."""

    @in_batches
    def run(batch):
        langs = batch.column(1).to_pylist()
        of: dict[str, list[np.ndarray]] = {}
        out: list[tuple[str, np.ndarray, np.ndarray]] = []

        def flush(lang):
            out.append((lang, *np.unique(np.concatenate(of.pop(lang)), return_counts=True)))

        for raw, lang in zip(texts(batch.column(0)), langs, strict=True):
            of.setdefault(lang, []).append(grams(raw.decode()))
            if sum(map(len, of[lang])) > 2_000_000:
                flush(lang)
        for lang in list(of):
            flush(lang)
        return {"lang": pa.array([x[0] for x in out for _ in x[1]], pa.string()), "code": pa.array(np.concatenate([x[1] for x in out]).view(np.int64)), "n": pa.array(np.concatenate([x[2] for x in out]))}

    counts = rows.select("text", "lang").mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    w = W.partitionBy("lang").orderBy(F.desc("n"), "code")
    top = counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= size)
    found: dict[str, list[tuple[int, int]]] = {}
    for r in top.select("lang", "rank", "code").toLocalIterator():
        found.setdefault(r.lang, []).append((r.rank, r.code))
    return {lang: np.array([c for _, c in sorted(x)], dtype=np.uint64) for lang, x in sorted(found.items())}


def distances(mine: np.ndarray, sorted_profiles: list[tuple[np.ndarray, np.ndarray]], size: int = PROFILE) -> np.ndarray:
    """Mean out-of-place distance to each profile, as a share of the penalty."""
    rank = np.arange(len(mine))
    out = []
    for code, place in sorted_profiles:
        at = np.minimum(np.searchsorted(code, mine), len(code) - 1)
        out.append(np.where(code[at] == mine, np.minimum(np.abs(place[at] - rank), size), size).mean() / size)
    return np.array(out)


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE) -> tuple[list[str], list[tuple[np.ndarray, np.ndarray]]]:
    """(languages, their profiles sorted by code, with ranks) of the rows with text and language."""
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    found = {k: c for k, c in profiles(rows.where("text IS NOT NULL AND lang IS NOT NULL"), size).items() if len(c)}
    return list(found), [(c[o], o) for c in found.values() for o in [np.argsort(c)]]


def identify(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang", size: int = PROFILE) -> DataFrame:
    """(id, held_out, lang_pred, score) of every row of ``docs``.

    Learns from the rows that aren't held out and have a text and a language. ``score`` is 1 less
    the distance to the nearest profile, from 0 to 1; ties go to the language first by name. A null
    text or one without letters is ``und`` with score 0, as is every text if nothing was learnt.
    Rows with a null id aren't held out; repeated rows stay. Only the three named columns are read.
    """
    model = learn(docs.where(~held_out(id_col)), text_col, lang_col, size)

    @in_batches
    def run(batch):
        got = [nearest(raw.decode(), model, size) for raw in texts(batch.column(2))]
        return {"id": batch.column(0), "held_out": batch.column(1), "lang_pred": pa.array([x for x, _ in got], pa.string()), "score": pa.array([x for _, x in got], pa.float64())}

    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(run, f"id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)


#: The share of labelled texts that may score less than the least score, how much less than that a text's score
#: may be, and the steps in which scores are counted.
LOW, MARGIN, STEPS = 0.005, 0.5, 10_000


def least_scores(labelled: DataFrame, model, size: int = PROFILE) -> dict[int, float]:
    """The least score of a text in a learnt language, by the bits of its number of different n-grams.

    From the scores that all labelled texts (text, lang) get for their own language: ``MARGIN`` times
    what all but a share of ``LOW`` of them reach, in steps of 1 / ``STEPS``.
    """

    @in_batches
    def run(batch):
        bits, steps = [], []
        for raw, lang in zip(texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            name, score, n = judged_text(raw.decode(), model, size)
            if name == lang:
                bits.append(n.bit_length())
                steps.append(int(score * STEPS))
        return {"bits": pa.array(bits, pa.int32()), "step": pa.array(steps, pa.int32())}

    counts = labelled.select("text", "lang").mapInArrow(run, "bits int, step int").groupBy("bits", "step").agg(F.count("*").alias("n"))
    w = W.partitionBy("bits")  # STEPS + 1 rows at most
    below = F.sum("n").over(w.orderBy("step").rowsBetween(W.unboundedPreceding, 0))
    reached = counts.withColumn("below", below).withColumn("all", F.sum("n").over(w)).where(F.col("below") >= LOW * F.col("all"))
    return {r.bits: MARGIN * r.step / STEPS for r in reached.groupBy("bits").agg(F.min("step").alias("step")).collect()}  # 10 rows


def judged_text(text: str, model, size: int = PROFILE) -> tuple[str, float, int]:
    """(language, 1 less its distance, different n-grams compared) of a text."""
    names, sorted_profiles = model
    mine = ranked(grams(text), size)
    if not len(mine) or not names:
        return UNKNOWN, 0.0, 0
    d = distances(mine, sorted_profiles, size)
    k = int(d.argmin())
    return names[k], float(1 - d[k]), len(mine)


def nearest(text: str, model, size: int = PROFILE) -> tuple[str, float]:
    """(language, 1 less its distance) of a text; ``und`` and 0 without letters or languages."""
    return judged_text(text, model, size)[:2]


def keep_known(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: float | None = None, size: int = PROFILE) -> DataFrame:
    """The rows of ``docs`` that are text in a learnt language; all columns stay.

    Learns from all rows with a text and a language, and where nothing was learnt, keeps no row. A text
    goes if it has no letters or if its score is below what texts of its size and language have
    (``least_scores``), as that of a text in an unlearnt language is; for a size that no labelled
    text has, the next known one counts. With a number for ``least``, texts go up to that score.
    """
    model = learn(docs, text_col, lang_col, size)
    labelled = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    known = least_scores(labelled, model, size) if least is None else {}
    limit = [min(((abs(b - k), -b, x) for k, x in known.items()), default=(0, 0, least or 0.0))[2] for b in range(size.bit_length() + 1)]

    @F.arrow_udf("boolean")
    def stays(column: pa.Array) -> pa.Array:
        release_others(__name__)
        out = []
        for raw in column.cast(pa.binary()):
            name, score, n = judged_text((raw.as_py() or b"").decode(), model, size)
            out.append(name != UNKNOWN and score > limit[n.bit_length()])
        return pa.array(out, pa.bool_())

    return docs.where(stays(F.col(text_col)))
