"""Evaluation of predicted span labels: precision, recall, F1, confusion, error texts and confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _rates(tp: Column, fp: Column, fn: Column) -> list[Column]:
    p, r = tp / F.greatest(tp + fp, F.lit(1)), tp / F.greatest(tp + fn, F.lit(1))
    return [p.alias("precision"), r.alias("recall"), (2 * p * r / F.greatest(p + r, F.lit(1e-8))).alias("f1")]


def micro(df: DataFrame, gold: str = "gold", pred: str = "pred", outside: str = "O") -> DataFrame:
    """One row: tp, fp, fn, precision, recall, f1; a wrong label is both a false positive and a false negative."""
    g, p = F.col(gold), F.col(pred)
    c = df.agg(F.count_if((g == p) & (g != outside)).alias("tp"), F.count_if((p != outside) & (g != p)).alias("fp"), F.count_if((g != outside) & (g != p)).alias("fn"))
    return c.select("*", *_rates(F.col("tp"), F.col("fp"), F.col("fn")))


def per_label(df: DataFrame, gold: str = "gold", pred: str = "pred", outside: str = "O") -> DataFrame:
    """The same for each label, by precision, then most false positives."""
    g, p = F.col(gold), F.col(pred)
    kinds = F.when(g == p, F.array(F.struct(g.alias("label"), F.lit("tp").alias("k")))).otherwise(F.array(F.struct(p.alias("label"), F.lit("fp").alias("k")), F.struct(g.alias("label"), F.lit("fn").alias("k"))))
    d = df.select(F.inline(kinds)).where(F.col("label") != outside)
    c = d.groupBy("label").agg(*(F.count_if(F.col("k") == k).alias(k) for k in ("tp", "fp", "fn")))
    return c.select("*", *_rates(F.col("tp"), F.col("fp"), F.col("fn"))).orderBy("precision", F.desc("fp"), "label")


def confusion(df: DataFrame, gold: str = "gold", pred: str = "pred", k: int | None = None) -> DataFrame:
    """(gold, pred, n) of unequal labels; with k the k most frequent predictions for each gold label."""
    c = df.where(F.col(gold) != F.col(pred)).groupBy(F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))
    return c if k is None else c.withColumn("_r", F.row_number().over(Window.partitionBy("gold").orderBy(F.desc("n"), "pred"))).where(F.col("_r") <= k).drop("_r")


def top_error_texts(df: DataFrame, label: str = "label", text: str = "text", k: int = 20) -> DataFrame:
    """The k most frequent texts of each label in lower case; the empty one counts towards k but doesn't come out."""
    c = df.groupBy(F.col(label).alias("label"), F.lower(F.trim(text)).alias("text")).agg(F.count("*").alias("n"))
    return c.withColumn("_r", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "text"))).where((F.col("_r") <= k) & (F.col("text") != "")).drop("_r")


def confidence(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Mean, median, quartiles (linear between neighbours), least, greatest and number of the values."""
    q = lambda p: F.percentile(value, p)
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.avg(value).alias("mean"), q(0.5).alias("median"), q(0.25).alias("p25"), q(0.75).alias("p75"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("n"))
