"""Spelling variants by a symmetric-delete join.

Every word emits keys for itself and for each distinct string that deleting one letter leaves. Two
words at distance one meet at exactly one key: the shorter one's own, where a letter was added, or
what both leave when their differing letter goes. An equi-join on the keys finds all of them, a check
of the words drops the rest (two swapped letters, equal hashes), and what is left is aggregated: each
word's number of near words and the most frequent of them. Chains of forms are followed by joins
that double their reach.

A key is the 64-bit hash of its string, summed from the letters' parts, so that all deletions of a
word cost time and memory in proportion to its length, not to its square; a key is shared by
as many words at most as one letter can be put in or changed. Words are carried by number and fetched
for the pairs that met.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keytide.llm.common import dropped, in_batches, written

#: Letters of a run.
LETTERS = r"[A-Za-zÀ-ÿ]"
#: Multiplier of the hash of a string.
BASE = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers with their bits stirred."""
    x = x.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(by)
    return x ^ x >> np.uint64(31)


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, place, key): the hash of each word, at place -1, and of what each distinct deletion leaves.

    Of a run of equal letters only the first one is deleted.
    """
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    code = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4")
    start = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(code)) - start[of]
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(0, int(sizes.max(initial=0))), BASE)]), dtype=np.uint64)
    part = mixed(code)
    kept, moved = (np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)]) for x in (part * power[place], np.where(place > 0, part * power[np.maximum(place, 1) - 1], 0).astype(np.uint64)))
    first = np.ones(len(code), dtype=bool)
    first[1:] = (code[1:] != code[:-1]) | (place[1:] == 0)
    k = np.flatnonzero(first)
    own = kept[start + sizes] - kept[start]
    left = kept[k] - kept[start[of[k]]] + moved[(start + sizes)[of[k]]] - moved[k + 1]
    return np.concatenate([np.arange(len(words)), of[k]]), np.concatenate([np.full(len(words), -1), place[k]]), np.concatenate([own, left]).view(np.int64)


def keys_of(nodes: DataFrame) -> DataFrame:
    """(key, id, place) of every word of ``nodes`` (id, word)."""

    def rows(batch: pa.RecordBatch) -> dict:
        word, place, key = deletion_keys(batch["word"].to_pylist())
        return {"key": pa.array(key), "id": batch["id"].take(pa.array(word)), "place": pa.array(place, pa.int32())}

    rows.__module__ = __name__
    return nodes.select("id", "word").mapInArrow(in_batches(rows), "key bigint, id bigint, place int")


def without(word: Column, place: Column) -> Column:
    """What deleting the letter at ``place`` leaves; the word itself at -1."""
    return F.when(place < 0, word).otherwise(F.concat(F.substring(word, F.lit(1), place), F.substring(word, place + 2, F.length(word))))


def near_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b, word_a, word_b), once for each two words of ``nodes`` (id, word, n) at distance one."""
    keys = keys_of(nodes)
    one, two = keys.toDF("key", "a", "at_a"), keys.toDF("key", "b", "at_b")
    met = one.join(two, "key").where("a < b and not (at_a < 0 and at_b < 0)").drop("key")
    for side in "ab":
        met = met.join(nodes.select(F.col("id").alias(side), F.col("word").alias(f"word_{side}"), F.col("n").alias(f"n_{side}")), side)
    # two replaced letters: one of the words may have an equal letter before its own, so the later place is the one
    place = {x: F.when(F.col(f"at_{x}") < 0, -1).otherwise(F.greatest("at_a", "at_b")) for x in "ab"}
    return met.where(without(F.col("word_a"), place["a"]) == without(F.col("word_b"), place["b"])).select("a", "b", "n_a", "n_b", "word_a", "word_b")


def followed(links: DataFrame) -> DataFrame:
    """(id, to): where the links (id, to) of each id end, written; every round doubles the reach. There are no circles."""
    jumps = written(links.select("id", "to"))
    while True:
        ahead = jumps.select(F.col("id").alias("to"), F.col("to").alias("next"))
        after = written(jumps.join(ahead, "to", "left").select("id", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
        dropped(jumps)
        moved, jumps = not after.where("moved").isEmpty(), after
        if not moved:
            return jumps


def letter_runs(docs: DataFrame, least: int, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, run) of each maximal run of at least ``least`` letters in ``docs``, only A-Z lower-cased; null texts have none."""
    run = F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"{LETTERS}{{{least},}}"), F.lit(0)))
    lower = F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return docs.select(F.col(id_col).alias("id"), run.alias("run")).select("id", lower.alias("run"))


def group_variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of each row of ``words`` (word, n), whose words are distinct.

    Near words differ by one letter added, deleted or replaced. A word's form is its most frequent
    near word, of equal ones the first in code-point order, if that is at least ``ratio`` times as
    frequent; root is where forms lead, the word itself without one. Null words are left out, the
    empty word is near every single letter. The result is a written table in the shared folder.
    """
    if ratio < 2:
        raise ValueError("forms must be more frequent than their variants")
    nodes = written(words.where("word is not null").select(F.monotonically_increasing_id().alias("id"), "word", F.col("n").cast("bigint").alias("n")))
    ends = F.explode(F.array(*[F.struct(F.col(x).alias("id"), (-F.col(f"n_{y}")).alias("less"), F.col(f"word_{y}").alias("form"), F.col(y).alias("to")) for x, y in ("ab", "ba")]))
    near = near_pairs(nodes).select(ends.alias("e")).select("e.*")
    near = written(near.groupBy("id").agg(F.count("*").alias("n_near"), F.min(F.struct("less", "form", "to")).alias("best")))
    found = nodes.join(near, "id", "left").withColumn("has", F.expr(f"(-best.less) div {ratio} >= n"))
    roots = followed(found.where("has").select("id", F.col("best.to").alias("to")))
    names = roots.join(nodes.select(F.col("id").alias("to"), F.col("word").alias("root_word")), "to").select("id", "root_word")
    when = lambda c: F.when(F.col("has"), c)
    out = found.join(names, "id", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), when(F.col("best.form")).alias("form"), when(-F.col("best.less")).alias("form_n"), F.coalesce("root_word", "word").alias("root"))
    out = written(out)
    dropped(nodes, near, roots)
    return out
