"""The registered queries of this subpackage: each numbered operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keytide.llm import ann, bpe, embed_dedup, html_text, langid, lexical, lm, oracles, packing, pii, simhash, spelling, substring, toxicity
from keytide.llm.common import table


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.link_near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(table(spark, sf_dir, "documents"))


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    # 0: not toxic; 1: toxic in a text of quality; 2: toxic in a text without
    grade = F.when(F.col("toxic") == 1, F.when(F.col("quality") == 0, 2).otherwise(1)).when(F.col("toxic") == 0, 0)
    return toxicity.grade_documents(table(spark, sf_dir, "documents"), labels.select("doc_id", grade.alias("grade")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spelling.letter_runs(table(spark, sf_dir, "documents"), 7)
    h, run = F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), "run")), F.col("run")
    word = F.when(h % 31 == 0, spelling.without(run, (h % F.length(run)).cast("int"))).otherwise(run)
    words = runs.select(word.alias("word")).where(F.length("word") >= 7).groupBy("word").agg(F.count("*").alias("n"))
    return spelling.group_variants(words.where("n >= 2"))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("tiers")


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_embedding_dedup, op2_simhash, op3_pii, op4_language, op5_bpe, op6_substring, op7_lm, op8_toxicity, op9_packing, op10_ann, op11_spelling, op12_lexical, op13_html_text)}
QUERIES |= oracles.QUERIES
ORACLE_SQL: dict[str, str] = oracles.ORACLE_SQL
