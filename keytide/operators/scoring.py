"""Scores of a run against a complete one, and the text forms of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVENTS = ("true_anomaly", "false_positive", "false_negative")


def score(full: DataFrame, run: DataFrame) -> DataFrame:
    """(missing, extra, negatives, score) of a run's labelled keys against the complete run's.

    Events are compared as bags; true negatives only by their number.
    """
    listed = lambda d, n: d.where(F.col("label").isin(*EVENTS)).groupBy("label", "key").agg(F.count("*").alias(n))
    both = listed(full, "a").join(listed(run, "b"), ["label", "key"], "full_outer").na.fill(0, ["a", "b"])
    diff = both.agg(F.coalesce(F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))), F.lit(0)).alias("missing"), F.coalesce(F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))), F.lit(0)).alias("extra"))
    tn = lambda d, n: d.agg(F.count(F.when(F.col("label") == "true_negative", 1)).alias(n))
    one = diff.crossJoin(tn(full, "x")).crossJoin(tn(run, "y"))  # one row each
    return one.select("missing", "extra", F.abs(F.col("x") - F.col("y")).alias("negatives"), (F.col("missing") + F.col("extra") + F.abs(F.col("x") - F.col("y"))).alias("score"))


def drop_rate(sent: Column, received: Column) -> Column:
    """Percent of packets lost; more received than sent is none lost."""
    return F.lit(100.0) - F.lit(100.0) * F.least(received, sent) / sent


def event_lines(labelled: DataFrame) -> DataFrame:
    """(idx, value): ``true anomaly = key`` lines in order of detection; true negatives are only counted."""
    name = F.replace("label", F.lit("_"), F.lit(" "))
    return labelled.where(F.col("label").isin(*EVENTS)).select("idx", F.concat_ws(" = ", name, F.col("key").cast("string")).alias("value")).orderBy("idx")


def parsed_lines(lines: DataFrame) -> DataFrame:
    """(name, value) of ``name = value`` lines in column ``value``; other lines are left out."""
    at = lambda k: F.trim(F.regexp_extract("value", r"^\s*([^=]+?)\s*=\s*(\S+)\s*$", k))
    return lines.select(at(1).alias("name"), at(2).alias("value")).where("name <> ''")


def parsed_reversed_lines(lines: DataFrame) -> DataFrame:
    """(name, value) of lines of column ``value`` whose value stands before the name.

    The name is the run of words at the end that don't begin with a digit, or the last word if that
    does; the value is the first of the run of numbers right before it, or the name's first word if
    there is none. Lines without words are left out.
    """
    line = F.trim(F.regexp_replace("value", r"\s+", " "))
    rows = lines.select(line.alias("l")).where("l <> ''")
    name = F.coalesce(F.nullif(F.regexp_extract("l", r"(?:^|(?<= ))([^0-9 ]\S*(?: [^0-9 ]\S*)*)$", 1), F.lit("")), F.substring_index("l", " ", -1))
    rows = rows.select("l", name.alias("name")).withColumn("rest", F.expr("trim(left(l, length(l) - length(name)))"))
    number = F.regexp_extract("rest", r"(?:^|(?<= ))([0-9]\S*)(?: [0-9]\S*)*$", 1)
    return rows.select("name", F.when(number != "", number).otherwise(F.substring_index("name", " ", 1)).alias("value"))
