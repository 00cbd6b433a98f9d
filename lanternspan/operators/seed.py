"""Cleaning, drop reasons, exact de-duplication and the stratified seed sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx


def it_probes(keyword: Column, position: Column, text: Column, prefix: int = 1500) -> tuple[Column, Column]:
    """Header (keyword and position) and body (header and the text's start), lower case."""
    header = F.lower(F.concat(tx.stringify(keyword), F.lit(" "), tx.stringify(position)))
    return header, F.lower(F.concat(header, F.lit(" "), F.substring(text, 1, prefix)))


def is_it(keyword: Column, position: Column, text: Column, strict: bool = False, keywords=lx.IT_PRIMARY_KEYWORDS, ambiguous=lx.AMBIGUOUS_PRIMARY_KEYWORDS, signals=lx.IT_SIGNAL_TERMS, roles=lx.STRICT_IT_ROLE_TERMS, tech=lx.STRICT_IT_TECH_TERMS, not_it=lx.STRICT_NON_IT_HEADER_TERMS) -> Column:
    header, body = it_probes(keyword, position, text)
    k = tx.stringify(keyword)
    if strict:
        return F.when(k.isin(*keywords), True).when(tx.any_of(header, not_it), False).otherwise(tx.any_of(header, roles) & tx.any_of(body, tech))
    return F.when(k.isin(*keywords), True).when(k.isin(*ambiguous), tx.any_of(body, signals)).otherwise(False)


def mark_repeats(d: DataFrame, keys: list[str], pos: str, name: str, salts: int = 1024) -> DataFrame:
    """d with the column `name`: whether a row with equal keys and a smaller `pos` exists; false where the last key is null.

    Two ranking windows: by key and salt of the position, then by key over the first rows of the salts alone, so that
    a group of any size never meets in one task. Rows without a key, and those that the first window has settled, are
    spread by their position. The rows are computed once and nothing is joined.
    """
    free, null = F.xxhash64(pos), F.col(keys[-1]).isNull()
    rank = lambda: F.row_number().over(Window.partitionBy(*keys, "_s").orderBy(pos))
    d = d.withColumn("_s", F.when(null, free).otherwise(F.pmod(free, F.lit(salts)))).withColumn("_r", rank())
    d = d.withColumn("_s", F.when(null | (F.col("_r") > 1), free).otherwise(F.lit(-1)))
    return d.withColumn("_q", rank()).withColumn(name, ~null & ((F.col("_r") > 1) | (F.col("_q") > 1))).drop("_s", "_r", "_q")


def with_drop_reason(df: DataFrame, *, id: str = "id", doc_type: str = "doc_type", language: str = "source_language", text: str = "text", keyword: str = "primary_keyword", position: str = "position", pos: str = "pos", it_only: bool = False, min_chars=(200, 350), min_words=(30, 50)) -> DataFrame:
    """All columns with the cleaned text, its metrics and drop_reason, the first that fails; null for kept rows.

    Duplicates count among survivors only: the first by `pos` within a document type and collapsed text stays. Texts
    are cleaned once (see mark_repeats); the windows carry them only where a later step reads them.
    """
    kind = F.lower(tx.stringify(doc_type))
    lang = F.lower(tx.stringify(language))
    d = df.withColumn("_kind", kind).withColumn(text, tx.clean_text(tx.stringify(text)))
    d = d.withColumns({"text_length": F.length(text).cast("bigint"), "word_count": tx.count_words(F.col(text)), "length_bucket": tx.length_bucket(F.col("_kind"), F.length(text))})
    low = lambda c, b: F.when(F.col("_kind") == "cv", F.col(c) < b[0]).otherwise(F.col(c) < b[1])
    reason = F.when((tx.stringify(id) == "") | (tx.stringify(text) == ""), "missing_core_fields").when(~F.col("_kind").isin("cv", "jd"), "unknown_type").when((lang != "") & ~lang.startswith("en"), "language")
    if it_only:
        reason = reason.when(~is_it(F.col(keyword), F.col(position), F.col(text)), "non_it")
    reason = reason.when(low("text_length", min_chars) | low("word_count", min_words), "short_or_sparse")
    d = d.withColumn("drop_reason", reason).withColumn("_key", F.when(F.col("drop_reason").isNull(), F.sha2(tx.collapse(F.col(text)), 256)))
    d = mark_repeats(d, ["_kind", "_key"], pos, "_again").withColumn("drop_reason", F.when(F.col("_again"), "duplicate_text").otherwise(F.col("drop_reason")))
    group = F.concat(F.coalesce(F.nullif(F.col(keyword), F.lit("")), F.lit("unknown")), F.lit("::"), F.col("length_bucket"))
    return d.withColumn("seed_group", group).drop("_kind", "_key", "_again")


def drop_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("drop_reason")).agg(F.count("*").alias("n"))


def diverse_sample(df: DataFrame, n: int, seed: int = 42, *, strata=("primary_keyword", "length_bucket"), id: str = "id") -> DataFrame:
    """n rows, one from each stratum per round, strata in order; within a stratum by md5 of id and seed.

    A stratum may be hot; only its first n ranks can be chosen, so a top-n per salt comes before the ranking window.
    """
    h = F.md5(F.concat(F.col(id).cast("string"), F.lit(f"|{seed}")))
    k = [F.coalesce(F.nullif(F.col(s).cast("string"), F.lit("")), F.lit("unknown")).alias(f"_s{i}") for i, s in enumerate(strata)]
    names = [f"_s{i}" for i in range(len(strata))]
    d = df.select("*", *k, h.alias("_h")).withColumn("_salt", F.pmod(F.xxhash64(id), F.lit(32)))
    d = d.withColumn("_r", F.row_number().over(Window.partitionBy(*names, "_salt").orderBy("_h", id))).where(F.col("_r") <= n)
    d = d.withColumn("_r", F.row_number().over(Window.partitionBy(*names).orderBy("_h", id)))
    return d.orderBy("_r", *names).limit(n).drop(*names, "_h", "_r", "_salt")


def seed_subset(df: DataFrame, n_cv: int, n_jd: int, seed: int = 42, **kw) -> DataFrame:
    """The cv and jd samples, ordered by type and id; the jd sample is drawn with the next seed."""
    cv, jd = df.where("doc_type = 'cv'"), df.where("doc_type = 'jd'")
    out = diverse_sample(cv, n_cv, seed, **kw).unionByName(diverse_sample(jd, n_jd, seed + 1, **kw))
    return out.orderBy("doc_type", kw.get("id", "id"))


def top_values(df: DataFrame, column: str, k: int = 20, pos: str | None = None) -> DataFrame:
    """The k most frequent values; ties go to the one met first by `pos`, or without it to the smaller value."""
    first = F.min(pos) if pos else F.lit(0)
    return df.groupBy(column).agg(F.count("*").alias("n"), first.alias("_p")).orderBy(F.desc("n"), "_p", column).limit(k).drop("_p")


def seed_stats(df: DataFrame, keyword: str = "primary_keyword", k: int = 20, pos: str = "pos") -> dict[str, DataFrame]:
    """Counts by document type, length bucket and language, the most frequent keywords by type, and lengths by type."""
    n = F.count("*").alias("n")
    kinds = {t: top_values(df.where(F.col("doc_type") == t), keyword, k, pos) for t in ("cv", "jd")}
    return {
        "by_type": df.groupBy("doc_type").agg(n), "by_bucket": df.groupBy("doc_type", "length_bucket").agg(n), "keywords_cv": kinds["cv"], "keywords_jd": kinds["jd"],
        "lengths": df.groupBy("doc_type").agg(F.min("text_length").alias("least"), F.max("text_length").alias("most"), F.avg("text_length").alias("mean")),
    }


def looks_like_it(df: DataFrame, strict: bool = False, keyword: str = "primary_keyword", position: str = "position", text: str = "text") -> Column:
    """is_it of the cleaned text, for raw rows."""
    return is_it(F.col(keyword), F.col(position), tx.clean_text(tx.stringify(text)), strict)
