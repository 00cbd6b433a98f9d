"""Deterministic clean-up of labelled spans: prefixes off, unwanted spans out, duplicates once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx


def _one_of(patterns) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def is_english_level(t: Column) -> Column:
    near = tx.any_of(t, set(lx.ENGLISH_LEVEL_TERMS) | set(lx.ENGLISH_LEVEL_CONTEXT_TERMS))
    return t.isin(*lx.ENGLISH_LEVEL_TERMS) | t.startswith("english level") | t.startswith("level of english") | (F.contains(t, F.lit("english")) & near)


def is_no_skill(t: Column) -> Column:
    return t.isin(*lx.NON_SKILL_TERMS) | t.rlike(_one_of(lx.NON_SKILL_PATTERNS))


def is_degree(t: Column) -> Column:
    return ~t.rlike(_one_of(lx.DEGREE_NOISE_PATTERNS)) & t.rlike(_one_of(lx.DEGREE_KEYWORD_PATTERNS))


def is_certification(t: Column) -> Column:
    named = t.rlike(_one_of(lx.CERTIFICATION_PATTERNS)) | F.contains(t, F.lit("certified")) | (t.rlike("certificate|certification") & F.contains(t, F.lit(" ")))
    return ~t.isin(*lx.CERTIFICATION_GENERIC_TERMS) & ~t.rlike(_one_of(lx.CERTIFICATION_NOISE_PATTERNS)) & named


def is_activity(t: Column) -> Column:
    """Two words or more, of which the first, behind the prefixes, is a verb of action."""
    words = F.regexp_extract_all(tx.strip_prefixes(t, lx.WORK_ACTIVITY_PREFIXES), F.lit("([a-z]+(?:'[a-z]+)?)"), F.lit(1))
    return ~t.isin(*lx.GENERIC_WORK_ACTIVITY_TERMS) & F.contains(t, F.lit(" ")) & (F.size(words) >= 2) & F.coalesce(F.get(words, F.lit(0)).isin(*lx.ACTION_VERB_TOKENS), F.lit(False))


def span_key(normalized: Column, span: Column) -> Column:
    """What a span is judged by: its normalized text, or else its text, in lower case with single blanks."""
    return tx.collapse(F.coalesce(F.nullif(tx.stringify(normalized, trim=False), F.lit("")), tx.stringify(span)))


def drop_span(label: Column, t: Column) -> Column:
    """Whether a span is unwanted; t: the span_key. Without a label or any text it stays."""
    lab = F.upper(tx.stringify(label))
    return (
        F.when((lab == "") | (t == ""), False)
        .when(lab == "ABILITY", True)
        .when(lab == "SKILL", is_english_level(t) | is_no_skill(t))
        .when(lab == "INDUSTRY", t.isin(*lx.NON_INDUSTRY_TERMS))
        .when(lab == "PROJECT_TYPE", t.isin(*lx.GENERIC_PROJECT_TYPE_TERMS))
        .when(lab == "DEGREE", ~is_degree(t))
        .when(lab == "CERTIFICATION", ~is_certification(t))
        .when(lab == "WORK_ACTIVITY", ~is_activity(t))
        .otherwise(False)
    )


def wanted(df: DataFrame, label: str = "label", normalized: str = "normalized", text: str = "text") -> DataFrame:
    """The spans that aren't unwanted. The key is bound once for each span, so the many tests of it don't repeat it."""
    return df.where(~F.exists(F.array(span_key(F.col(normalized), F.col(text))), lambda t: drop_span(F.col(label), t)))


def trim_span(df: DataFrame, text: str = "text", start: str = "start", normalized: str = "normalized", prefixes=lx.NOISY_PREFIXES) -> DataFrame:
    """Noisy prefixes off the span's text, again and again; start moves along, end stays. A normalized text that isn't
    empty follows. Spans without a start stay as they are."""
    run = F.regexp_extract(F.col(text), "(?i)^((?:(?:" + "|".join(tx.literal(p) for p in sorted(prefixes, key=len, reverse=True)) + r")(?U:\s*))+)", 1)
    n = F.when(F.col(start).isNull() | F.col(text).isNull(), 0).otherwise(F.length(run))
    d = df.withColumn("_n", n)
    cut = F.expr(f"substring(`{text}`, _n + 1)")
    again = F.when((F.col("_n") > 0) & (F.coalesce(F.col(normalized), F.lit("")) != ""), tx.collapse(cut)).otherwise(F.col(normalized))
    return d.withColumns({normalized: again, start: F.col(start) + F.col("_n"), text: F.when(F.col("_n") > 0, cut).otherwise(F.col(text))}).withColumn("trimmed", F.col("_n") > 0).drop("_n")


def refine(df: DataFrame, id: str = "record_id", pos: str = "pos") -> DataFrame:
    """Spans (id, pos, label, text, start, end, normalized) trimmed, without unwanted ones, of equal ones the first."""
    d = trim_span(df)
    d = wanted(d)
    w = Window.partitionBy(id, F.upper("label"), "start", "end", "text").orderBy(pos)
    return d.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def cleanup_stats(before: DataFrame, after: DataFrame, id: str = "record_id") -> DataFrame:
    """One row: spans before and after, documents changed beyond trimming, spans trimmed."""
    a = before.groupBy(id).agg(F.count("*").alias("n0"))
    b = after.groupBy(id).agg(F.count("*").alias("n1"), F.sum(F.col("trimmed").cast("bigint")).alias("t"))
    j = a.join(b, id, "left").na.fill(0, ["n1", "t"])
    return j.agg(F.sum("n0").alias("spans_before"), F.sum("n1").alias("spans_after"), F.sum((F.col("n0") != F.col("n1")).cast("bigint")).alias("documents_changed"), F.sum("t").alias("spans_trimmed"))
