"""Rule-based weak labels: lexicon terms, a row's own role and technology, degree and certification patterns, activity lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx
from .spans import activity_spans, pattern_spans, prune, term_spans

TERMS = {"JOB_ROLE": lx.ROLE_KEYWORDS, "TECHNOLOGY": lx.TECHNOLOGY_TERMS, "SKILL": lx.SKILL_TERMS, "INDUSTRY": lx.INDUSTRY_TERMS, "PROJECT_TYPE": lx.PROJECT_TYPE_TERMS}


def role_parts(c: Column) -> Column:
    """A value without separators, or its parts of three characters and more."""
    t = tx.stringify(c)
    parts = F.filter(F.transform(F.split(t, "[|;,/]+"), lambda x: F.regexp_replace(x, tx.ENDS, "")), lambda x: F.length(x) >= 3)
    return F.when(t == "", F.array().cast("array<string>")).when(t.rlike("[|;,/]"), F.array_distinct(parts)).otherwise(F.array(t))


def own_roles(*cs: Column) -> Column:
    """Role terms of a row: parts of up to five words that are known roles or hold a hint, without the general ones."""
    words = lambda x: F.size(F.filter(F.split(x, r"(?U)\s+"), lambda w: w != ""))
    ok = lambda x: (words(x) <= 5) & ~F.lower(x).isin(*lx.GENERIC_ROLE_TERMS) & (x.isin(*lx.ROLE_KEYWORDS) | tx.any_of(F.lower(x), lx.ROLE_HINT_TOKENS))
    return F.array_distinct(F.filter(F.concat(*(role_parts(c) for c in cs)), ok))


def own_technologies(keyword: Column) -> Column:
    k = tx.stringify(keyword)
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.when(k.isin(*lx.TECHNOLOGY_TERMS, "Golang"), F.array(k)).otherwise(none), F.when(k == ".NET", F.array(F.lit(".NET"), F.lit("ASP.NET"), F.lit("C#"))).otherwise(none)))


def weak_spans(df: DataFrame, id: str = "record_id", text: str = "text", position: str = "position", keyword: str = "primary_keyword", terms=TERMS, degrees=lx.DEGREE_SPANS, certifications=lx.CERTIFICATION_SPANS) -> DataFrame:
    """(id, label, start, end, text, normalized): the pruned union of all extractors."""
    pair = lambda label, a: F.transform(a, lambda t: F.struct(F.lit(label).alias("label"), t.alias("term")))
    own = F.concat(pair("JOB_ROLE", own_roles(F.col(position), F.col(keyword))), pair("TECHNOLOGY", own_technologies(F.col(keyword))))
    d = df.where(tx.stringify(text) != "").withColumn("_own", own)
    parts = [term_spans(d, terms, id, text, "_own"), pattern_spans(d, "DEGREE", degrees, id, text), pattern_spans(d, "CERTIFICATION", certifications, id, text), activity_spans(d, id=id, text=text)]
    spans = reduce(lambda a, b: a.unionByName(b), parts).dropDuplicates([id, "label", "start", "end"])
    return prune(spans, id).withColumn("normalized", F.lower("text"))


def doccano_rows(df: DataFrame, spans: DataFrame, id: str = "record_id") -> DataFrame:
    """(doc_id, text, labels array<struct<start,end,label>>), labels in order."""
    g = spans.groupBy(id).agg(F.sort_array(F.collect_list(F.struct("start", "end", "label"))).alias("labels"))
    none = F.array().cast("array<struct<start:int,end:int,label:string>>")
    return df.join(g, id, "left").select(F.col(id).alias("doc_id"), "text", F.coalesce("labels", none).alias("labels"))


def combined_rows(df: DataFrame, spans: DataFrame, id: str = "record_id") -> DataFrame:
    """Minimal training records: (record_id, document_type, text, entities)."""
    g = spans.groupBy(id).agg(F.sort_array(F.collect_list(F.struct("start", "end", "label", "text", "normalized"))).alias("entities"))
    return df.join(g, id, "left").select(F.col(id).alias("record_id"), F.col("doc_type").alias("document_type"), "text", "entities")


def stats(df: DataFrame, spans: DataFrame, id: str = "record_id", doc_type: str = "doc_type") -> DataFrame:
    """(doc_type, documents, documents_with_entities, spans), doc_type null for all together."""
    n = spans.groupBy(id).agg(F.count("*").alias("_n"))
    d = df.withColumn(doc_type, F.coalesce(doc_type, F.lit("unknown"))).join(n, id, "left").rollup(doc_type).agg(F.count("*").alias("documents"), F.count("_n").alias("documents_with_entities"), F.coalesce(F.sum("_n"), F.lit(0)).alias("spans"), F.grouping(doc_type).alias("_g"))
    return d.select(F.when(F.col("_g") == 1, "all").otherwise(F.col(doc_type)).alias("doc_type"), "documents", "documents_with_entities", "spans")


def label_counts(spans: DataFrame) -> DataFrame:
    return spans.groupBy("label").agg(F.count("*").alias("spans"))
