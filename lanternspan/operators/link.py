"""Linking span texts to taxonomy entries: blocking by tokens, else by trigrams; lexical, semantic and context scores; top k."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx


def targets(spark, table=lx.LABEL_TARGET_TYPES) -> DataFrame:
    """(label, entry_type) that each label links to."""
    return spark.createDataFrame([(k, t) for k, ts in table.items() for t in ts], "label string, entry_type string")


def candidates(mentions: DataFrame, entries: DataFrame, limit: int = 256, min_overlap: int = 1) -> DataFrame:
    """(label, text, entry_id, block_score): for each distinct mention (label, text) at most `limit` entries.

    Entries whose title or aliases share a token, ranked by the Jaccard similarity of the token sets; mentions without one are matched
    by character trigrams instead. Both are equi-joins on a token and an allowed entry type; ties go to the entry_id.
    """
    spark = mentions.sparkSession
    m = mentions.select(F.upper("label").alias("label"), "text").where("text is not null").distinct()
    m = m.join(F.broadcast(targets(spark)), "label").withColumn("ts", F.array_distinct(tx.tokenize(F.col("text")))).withColumn("gs", tx.ngrams(F.col("text")))
    names = F.concat_ws(" ", "title", F.array_join(F.coalesce("aliases", F.array().cast("array<string>")), " "))
    e = entries.select("entry_id", "entry_type", F.array_distinct(tx.tokenize(names)).alias("ets"), tx.ngrams(names).alias("egs"))

    def block(left: DataFrame, a: str, b: str, least: int) -> DataFrame:
        x = left.select("label", "text", "entry_type", F.size(a).alias("n"), F.explode(a).alias("g"))
        y = e.select("entry_id", "entry_type", F.size(b).alias("k"), F.explode(b).alias("g"))
        hit = x.join(y, ["entry_type", "g"]).groupBy("label", "text", "entry_id").agg(F.count("*").alias("both"), F.first("n").alias("n"), F.first("k").alias("k"))
        return hit.where(F.col("both") >= least).select("label", "text", "entry_id", (F.col("both") / F.greatest(F.col("n") + F.col("k") - F.col("both"), F.lit(1))).alias("block_score"))

    by_token = block(m, "ts", "ets", min_overlap)
    rest = m.join(by_token.select("label", "text").distinct(), ["label", "text"], "left_anti")
    both = by_token.unionByName(block(rest, "gs", "egs", 1))
    w = Window.partitionBy("label", "text").orderBy(F.desc("block_score"), "entry_id")
    return both.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit).drop("_r")


def sequence_ratio(a: Column, b: Column) -> Column:
    """Ratio of matching blocks, as difflib finds them (with its heuristic for long second texts); null for a null."""

    def ratio(x, y):
        from difflib import SequenceMatcher

        return None if x is None or y is None else SequenceMatcher(None, x, y).ratio()

    return F.udf(ratio, "double", useArrow=True)(a, b)


def lexical_scores(pairs: DataFrame) -> DataFrame:
    """pairs (label, text, entry_id, names array<string>) with lexical_score: the best of exact match and
    0.45 sequence + 0.35 token Jaccard + 0.20 containment over the entry's names."""
    t = tx.normalize_text(F.col("text"))
    d = pairs.withColumn("_t", t).select("*", F.explode(F.filter("names", lambda n: n != "")).alias("_n"))
    j = tx.jaccard(F.array_distinct(tx.tokenize(F.col("_t"))), F.array_distinct(tx.tokenize(F.col("_n"))))
    inside = (F.contains("_n", "_t") | F.contains("_t", "_n")).cast("double")
    s = F.greatest((F.col("_t") == F.col("_n")).cast("double"), 0.45 * sequence_ratio(F.col("_t"), F.col("_n")) + 0.35 * j + 0.20 * inside)
    best = d.withColumn("_s", s).groupBy("label", "text", "entry_id").agg(F.max("_s").alias("lexical_score"))
    return pairs.drop("names").join(best, ["label", "text", "entry_id"])


def cosine(a: Column, b: Column) -> Column:
    """Dot product of unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / F.greatest(n, F.lit(1e-12)))


def link(mentions: DataFrame, entries: DataFrame, top_k: int = 5, min_score: float = 0.35, limit: int = 256, min_overlap: int = 1, semantic: DataFrame | None = None) -> DataFrame:
    """(record_id, mention_id, label, text, rank, entry_id, entry_type, onetsoc_code, score, lexical_score, semantic_score, context_boost).

    mentions: (record_id, mention_id, label, text). Roles are linked first; the codes of a record's best role links
    raise the score of its other mentions. Scores of texts and entries are computed once per distinct text.
    semantic: (text, entry_id, semantic_score), if an embedder made one; without it the lexical score stands for it.
    """
    info = entries.select("entry_id", "entry_type", "onetsoc_code", "hot_technology", "in_demand", F.concat(F.array("normalized_text"), F.coalesce("alias_normalized", F.array().cast("array<string>"))).alias("names"))
    c = candidates(mentions, entries, limit, min_overlap).join(info.select("entry_id", "names"), "entry_id").select("label", "text", "entry_id", "names")
    s = lexical_scores(c)
    s = s.join(semantic, ["text", "entry_id"], "left") if semantic is not None else s.withColumn("semantic_score", F.lit(None).cast("double"))
    s = s.join(info.drop("names"), "entry_id")
    tech = (F.col("entry_type") == "technology_skill").cast("double")
    base = 0.55 * F.col("lexical_score") + 0.45 * F.coalesce("semantic_score", "lexical_score")
    flags = 0.03 * tech * F.coalesce(F.col("hot_technology").cast("double"), F.lit(0.0)) + 0.03 * tech * F.coalesce(F.col("in_demand").cast("double"), F.lit(0.0))
    s = s.withColumns({"base": base, "flags": flags}).select("label", "text", "entry_id", "entry_type", "onetsoc_code", "lexical_score", "semantic_score", "base", "flags")
    m = mentions.select("record_id", "mention_id", F.upper("label").alias("label"), "text")
    j = m.join(s, ["label", "text"])
    best = j.where("label = 'JOB_ROLE'").withColumn("score", F.col("base") + F.col("flags")).where(F.col("score") >= min_score)
    best = best.groupBy("record_id", "mention_id").agg(F.min_by("onetsoc_code", F.struct(-F.round("score", 9), F.col("entry_id"))).alias("code"))
    context = best.groupBy("record_id").agg(F.collect_set("code").alias("codes"))
    j = j.join(context, "record_id", "left")
    boost = F.when((F.col("label") != "JOB_ROLE") & F.coalesce(F.array_contains("codes", F.col("onetsoc_code")), F.lit(False)), 0.08).otherwise(0.0) + F.col("flags")
    j = j.withColumn("context_boost", boost).withColumn("score", F.col("base") + F.col("context_boost")).where(F.col("score") >= min_score)
    w = Window.partitionBy("record_id", "mention_id").orderBy(F.desc(F.round("score", 9)), "entry_id")
    j = j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)
    return j.select("record_id", "mention_id", "label", "text", "rank", "entry_id", "entry_type", "onetsoc_code", "score", "lexical_score", "semantic_score", "context_boost")


def mapping_summary(mentions: DataFrame, links: DataFrame, by_record: bool = False) -> DataFrame:
    """Mentions, supported and mapped ones by label (null: all) or by record, the rate mapped / max(supported, 1), and the
    average score of the best links, 0 without any."""
    supported = F.upper("label").isin(*lx.LABEL_TARGET_TYPES)
    mapped = links.where("rank = 1").select("record_id", "mention_id", F.lit(1).alias("_m"), F.col("score").alias("_s"))
    d = mentions.join(mapped, ["record_id", "mention_id"], "left").withColumn("label", F.upper("label")).withColumn("_ok", supported.cast("bigint"))
    g = d.groupBy("record_id") if by_record else d.rollup("label")
    out = g.agg(F.count("*").alias("entities"), F.sum("_ok").alias("supported"), F.count("_m").alias("mapped"), F.coalesce(F.avg("_s"), F.lit(0.0)).alias("average_best_score"))
    return out.withColumn("mapped_rate", F.col("mapped") / F.greatest(F.col("supported"), F.lit(1)))


def record_label_counts(mentions: DataFrame, links: DataFrame) -> DataFrame:
    """(record_id, by_label map<label, struct<entities, supported, mapped>>)."""
    d = mentions.join(links.where("rank = 1").select("record_id", "mention_id", F.lit(1).alias("_m")), ["record_id", "mention_id"], "left").withColumn("label", F.upper("label"))
    ok = F.col("label").isin(*lx.LABEL_TARGET_TYPES).cast("bigint")
    n = d.groupBy("record_id", "label").agg(F.count("*").alias("entities"), F.sum(ok).alias("supported"), F.count("_m").alias("mapped"))
    return n.groupBy("record_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", F.struct("entities", "supported", "mapped").alias("n"))))).alias("by_label"))


def record_mappings(mentions: DataFrame, links: DataFrame) -> DataFrame:
    """(record_id, mappings): a record's mentions in order, each with whether its label is supported, the entry types it
    may mean and its candidates, best first; mentions without candidates have none. mentions may have start, end and
    normalized."""
    none = lambda c, ty: F.col(c) if c in mentions.columns else F.lit(None).cast(ty)
    fields = [c for c in ("rank", "entry_id", "entry_type", "onetsoc_code", "score", "lexical_score", "semantic_score", "context_boost") if c in links.columns]
    c = links.groupBy("record_id", "mention_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("candidates"))
    label = F.upper(tx.stringify("label"))
    types = F.create_map(*(x for k, ts in lx.LABEL_TARGET_TYPES.items() for x in (F.lit(k), F.array(*map(F.lit, ts)))))
    m = mentions.select("record_id", "mention_id", label.alias("entity_label"), F.col("text").alias("entity_text"), none("start", "int").alias("start"), none("end", "int").alias("end"), none("normalized", "string").alias("normalized"))
    m = m.join(c, ["record_id", "mention_id"], "left").withColumn("target_entry_types", F.coalesce(F.try_element_at(types, F.col("entity_label")), F.array().cast("array<string>")))
    one = F.struct(F.col("mention_id").alias("entity_index"), "entity_label", "entity_text", "start", "end", "normalized", (F.size("target_entry_types") > 0).alias("supported"), "target_entry_types", F.coalesce("candidates", F.filter(F.array(F.lit(None).cast(c.schema["candidates"].dataType.elementType)), lambda x: x.isNotNull())).alias("candidates"))
    return m.groupBy("record_id").agg(F.sort_array(F.collect_list(one)).alias("mappings"))


def entry_text(title: Column, aliases: Column) -> Column:
    """What an embedder reads of an entry: its title, and its aliases behind it."""
    return F.when(F.size(aliases) > 0, F.concat(title, F.lit(". "), F.array_join(aliases, "; "))).otherwise(title)


def semantic_scores(pairs: DataFrame, entries: DataFrame, embed: Callable[[list[str]], "list[list[float]]"], batch: int = 64) -> DataFrame:
    """(text, entry_id, semantic_score) of candidate pairs (text, entry_id) by an embedder: texts in, a vector for each
    out, which runs in the tasks. Each distinct text and entry is embedded once; vectors are brought to unit length."""

    def vectors(df: DataFrame, key: str, text: str) -> DataFrame:
        def run(batches):
            for pdf in batches:
                for i in range(0, len(pdf), batch):
                    part = pdf.iloc[i : i + batch]
                    yield part[[key]].assign(v=[[float(x) for x in v] for v in embed(part[text].tolist())])

        d = df.select(F.col(key), F.col(text)).mapInPandas(run, f"{key} string, v array<double>")
        return d.select(key, unit(F.col("v")).alias("v"))

    t = pairs.select("text", F.col("text").alias("t")).distinct()
    e = entries.select("entry_id", entry_text(F.col("title"), F.coalesce("aliases", F.array().cast("array<string>"))).alias("t"))
    a, b = vectors(t, "text", "t").withColumnRenamed("v", "x"), vectors(e, "entry_id", "t").withColumnRenamed("v", "y")
    return pairs.select("text", "entry_id").distinct().join(a, "text").join(b, "entry_id").select("text", "entry_id", cosine(F.col("x"), F.col("y")).alias("semantic_score"))


def mean_pool(vectors: Column, mask: Column) -> Column:
    """Unit mean of the token vectors whose mask is 1 (array<array<double>>, array<int>); zeros where no mask is."""
    n = F.greatest(F.aggregate(mask, F.lit(0), lambda s, x: s + x), F.lit(1))
    zero = F.transform(F.coalesce(F.get(vectors, F.lit(0)), F.array().cast("array<double>")), lambda x: F.lit(0.0))
    kept = F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda p: p["m"] == 1)
    total = F.aggregate(kept, zero, lambda s, p: F.zip_with(s, p["v"], lambda x, y: x + y))
    return unit(F.transform(total, lambda x: x / n))


def record_codes(links: DataFrame, k: int = 5) -> DataFrame:
    """(record_id, top_codes, role_codes): the k most frequent codes of best links, ties by first mention, and the role codes in order."""
    b = links.where("rank = 1 and onetsoc_code <> ''")
    n = b.groupBy("record_id", "onetsoc_code").agg(F.count("*").alias("n"), F.min("mention_id").alias("at"), F.min(F.when(F.col("label") == "JOB_ROLE", F.col("mention_id"))).alias("role"))
    top = F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "at", "onetsoc_code"))), 1, k), lambda x: x["onetsoc_code"])
    roles = F.transform(F.array_sort(F.collect_list(F.when(F.col("role").isNotNull(), F.struct("role", "onetsoc_code")))), lambda x: x["onetsoc_code"])
    return n.groupBy("record_id").agg(top.alias("top_codes"), roles.alias("role_codes"))
