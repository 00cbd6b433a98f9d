"""Registered queries of the core over the test tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx
from ..operators import annotate as an
from ..operators import features as ft
from ..sources.readers import read_parquet
from ..operators import ingest, link, metrics, refine, seed, spans, taxonomy, weak

#: Terms that occur in the test texts, by label.
TERMS = {"TECHNOLOGY": ["python", "sql", "c#", "c++", "quillbase", "quillbase studio", "java", "javascript"], "SKILL": ["release planning", "roadmap reporting", "usability"], "INDUSTRY": ["hotel groups", "energy brokers"]}
RELEASES = (r"\brelease \d+\.\d+\b", r"\bversion \d+\b")
VERBS = ("built", "cut ", "handled ", "extended ", "monitored ", "we ", "you ", "it's ")


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _docs(spark, d):
    return read_parquet(spark, f"{d}/documents.parquet")


def clean_text_metrics(spark, d):
    t = tx.clean_text(tx.stringify("text"))
    x = _docs(spark, d).select("doc_id", "doc_type", t.alias("t"))
    return x.select("doc_id", F.length("t").cast("bigint").alias("text_length"), tx.count_words(F.col("t")).alias("word_count"), tx.length_bucket(F.col("doc_type"), F.length("t")).alias("length_bucket"), F.md5("t").alias("digest"))


def _cleaned(spark, d):
    return seed.with_drop_reason(_docs(spark, d), id="record_id", language="lang", position="position_title", pos="doc_id", min_chars=(200, 350), min_words=(30, 50))


def drop_reason_counts(spark, d):
    return seed.drop_counts(_cleaned(spark, d))


def exact_dedupe(spark, d):
    return _cleaned(spark, d).where("drop_reason is null").select("doc_id", "doc_type", "text_length", "word_count", "seed_group")


def seed_round_robin(spark, d):
    return seed.diverse_sample(_cleaned(spark, d).where("drop_reason is null"), 100, 42, id="doc_id").select("doc_id", "primary_keyword", "length_bucket")


def seed_top_keywords(spark, d):
    return seed.top_values(_cleaned(spark, d).where("drop_reason is null"), "primary_keyword", 10)


KEYWORDS, AMBIGUOUS, SIGNALS = ("backend", "mobile", "devops", "data"), ("qa", "design", "security"), ("python", "java", "sql", "quillbase")


def it_predicate(spark, d):
    ok = seed.is_it(F.col("primary_keyword"), F.col("position_title"), F.col("text"), keywords=KEYWORDS, ambiguous=AMBIGUOUS, signals=SIGNALS)
    return _docs(spark, d).where("text is not null").select("doc_id", ok.alias("is_it"))


def it_predicate_strict(spark, d):
    ok = seed.is_it(F.col("primary_keyword"), F.col("position_title"), F.col("text"), strict=True, keywords=KEYWORDS[:1], roles=("developer", "engineer", "architect"), tech=SIGNALS, not_it=("manager", "keeper"))
    return _docs(spark, d).where("text is not null").select("doc_id", ok.alias("is_it"))


def term_counts(spark, d):
    return spans.term_spans(_docs(spark, d), TERMS, "doc_id").groupBy("label", F.lower("text").alias("term")).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("documents"))


def regex_spans(spark, d):
    return spans.pattern_spans(_docs(spark, d), "RELEASE", RELEASES, "doc_id").groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def line_activity(spark, d):
    return spans.activity_spans(_docs(spark, d), VERBS, "doc_id").select("doc_id", "start", "end", F.md5("text").alias("digest"))


def weak_label_counts(spark, d):
    return weak.label_counts(weak.weak_spans(_docs(spark, d).withColumnRenamed("position_title", "position"), id="doc_id"))


def flagship(spark, d):
    kept = _cleaned(spark, d).where("drop_reason is null")
    return spans.term_spans(kept, TERMS, "doc_id").groupBy("label").agg(F.count("*").alias("spans"), F.countDistinct("doc_id").alias("documents"))


def chunk_documents(spark, d):
    c = ft.chunk_records(_docs(spark, d).select(F.col("doc_id").cast("string").alias("record_id"), "text"), 1400, 120)
    return c.select("feature_id", "chunk_start", "chunk_end", F.md5("text").alias("digest"))


def span_chunk_assign(spark, d):
    s = table(spark, d, "span_annotations").where("record_id is not null").dropDuplicates(["annotation_id"])
    s = s.select("annotation_id", tx.collapse(F.col("record_id")).alias("record_id"), F.col("span_start").cast("int").alias("start"), F.col("span_end").cast("int").alias("end"))
    c = table(spark, d, "chunk_records").where("not contains(feature_id, '::sub-') and text is not null").groupBy("feature_id").agg(F.min(F.struct("chunk_index", F.col("chunk_start").cast("int").alias("chunk_start"), (F.col("chunk_start") + F.length("text")).cast("int").alias("chunk_end"))).alias("c"))
    c = c.select(F.lower(F.substring_index("feature_id", "::chunk-", 1)).alias("record_id"), "c.*")
    return spans.first_holding_chunk(s, c, "record_id", "annotation_id").select("annotation_id", F.col("chunk_index").cast("bigint").alias("chunk_index"))


def offset_repair(spark, d):
    docs = _docs(spark, d).where("record_id is not null and text is not null").groupBy(tx.collapse(F.col("record_id")).alias("record_id")).agg(F.min_by("text", "doc_id").alias("doc"))
    s = table(spark, d, "span_annotations").where("record_id is not null and text is not null")
    s = s.groupBy("annotation_id").agg(F.max_by(F.struct(tx.collapse(F.col("record_id")).alias("record_id"), "text", "span_start", "span_end"), F.struct("annotated_at", "text", "span_start", "record_id")).alias("s")).select("annotation_id", "s.*")
    j = s.join(docs, "record_id")
    return j.select("annotation_id", spans.repaired_start(F.col("doc"), F.col("text"), F.col("span_start").cast("int"), F.col("span_end").cast("int")).cast("bigint").alias("start"))


def refine_spans(spark, d):
    s = table(spark, d, "span_annotations").where("text is not null")
    s = s.select("annotation_id", "label", "text", F.col("span_start").cast("int").alias("start"), F.col("span_end").cast("int").alias("end"), "normalized", F.coalesce("record_id", F.lit("")).alias("record_id"))
    s = refine.trim_span(s)
    return refine.wanted(s).groupBy("label").agg(F.count("*").alias("n"), F.sum(F.col("trimmed").cast("bigint")).alias("trimmed"))


def batch_merge(spark, d):
    a = an.parse_answers(table(spark, d, "batch_outputs"))
    return a.select("custom_id", F.coalesce("error", F.lit("")).alias("error"), F.coalesce("answer.document_language", F.lit("")).alias("language"), F.coalesce(F.size("answer.entities"), F.lit(0)).cast("bigint").alias("entities"))


def batch_finalize(spark, d):
    docs = _docs(spark, d).where("text is not null and record_id is not null").groupBy(tx.collapse(F.col("record_id")).alias("record_id")).agg(F.min_by(F.struct("doc_type", "text"), "doc_id").alias("x")).select("record_id", F.col("x.doc_type").alias("document_type"), "x.text")
    m = table(spark, d, "chunk_records").where("custom_id is not null and text is not null").groupBy("custom_id").agg(F.max_by(F.struct("feature_id", "chunk_index", "chunk_start", "text"), F.struct("ingested_at", "text")).alias("c"))
    m = m.select("custom_id", F.lower(F.substring_index("c.feature_id", "::chunk-", 1)).alias("record_id"), "c.chunk_index", F.col("c.chunk_start").cast("int").alias("chunk_start"), F.col("c.text").alias("chunk_text"))
    ok, bad = an.merge_answers(docs, m, an.parse_answers(table(spark, d, "batch_outputs")))
    return ok.select("record_id", "document_language", "is_it_document", F.size("entities").cast("bigint").alias("entities"), F.lit("").alias("error")).unionByName(bad.select("record_id", F.lit("").alias("document_language"), F.lit(False).alias("is_it_document"), F.lit(0).cast("bigint").alias("entities"), "error"))


def chunk_ids(spark, d):
    c = table(spark, d, "chunk_records").where("record_id is not null").select("record_id", "chunk_index", "chunk_start").distinct()
    return c.select("record_id", "chunk_index", "chunk_start", tx.chunk_id(F.col("record_id"), F.col("chunk_index"), F.col("chunk_start")).alias("chunk_id"))


def record_ids(spark, d):
    x = _docs(spark, d).where("text is not null")
    return x.select("doc_id", tx.record_id(F.col("company_name"), F.col("doc_id"), "text", F.col("text")).alias("stable_id"))


def resume_antijoin(spark, d):
    c = table(spark, d, "chunk_records").select(F.lower(F.substring_index("feature_id", "::chunk-", 1)).alias("record_id"))
    x = _docs(spark, d).where("record_id is not null").select(tx.collapse(F.col("record_id")).alias("record_id"))
    return ingest.unprocessed(x, c)


def resume_state(spark, d):
    return ingest.resume_state(_docs(spark, d).select("doc_type", F.col("doc_id").alias("source_offset")))


def unpivot_texts(spark, d):
    from ..sources.readers import unpivot_texts as unpivot

    x = unpivot(_docs(spark, d), [("text", "auto"), ("position_title", "jd")], ["doc_id"])
    return x.groupBy("source_column", "type_hint").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def doc_types(spark, d):
    return _docs(spark, d).groupBy(tx.infer_doc_type(F.col("source"), "record_text", "auto").alias("kind"), tx.language(F.col("lang")).alias("language")).agg(F.count("*").alias("n"))


def shard_totals(spark, d):
    x = _docs(spark, d).where("text is not null").select(F.col("doc_id").alias("pos"), F.octet_length("text").cast("bigint").alias("bytes"), F.lit(1).cast("bigint").alias("requests"), tx.estimated_tokens(F.col("text")).alias("tokens"))
    return an.shard_totals(an.pack_shards(x, limits=(4_000_000, 900, 700_000)))


def descriptor_pivot(spark, d):
    x = table(spark, d, "lineitem").withColumn("pos", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return taxonomy.descriptor_scores(x, ["l_partkey"], "l_returnflag", "l_extendedprice", "pos", "R", "N")


def taxonomy_counts(spark, d):
    return taxonomy.index_summary(table(spark, d, "onet_entries"))


def _mentions(spark, d):
    s = table(spark, d, "span_annotations").where("text is not null and trim(text) <> '' and record_id is not null")
    s = s.groupBy("annotation_id").agg(F.max_by(F.struct("record_id", "label", "text"), F.struct("annotated_at", "text", "record_id", "label")).alias("s"))
    return s.select(F.col("s.record_id").alias("record_id"), F.col("annotation_id").alias("mention_id"), "s.label", "s.text")


def token_block(spark, d):
    return link.candidates(_mentions(spark, d), table(spark, d, "onet_entries")).select("label", "text", "entry_id", F.round("block_score", 6).alias("block_score"))


def entity_links(spark, d):
    e = table(spark, d, "onet_entries")
    return link.link(_mentions(spark, d), e, 3).select("record_id", "mention_id", "rank", "entry_id", F.round("score", 6).alias("score"))


def mapping_summary(spark, d):
    m = _mentions(spark, d)
    return link.mapping_summary(m, link.link(m, table(spark, d, "onet_entries"), 1)).select(F.coalesce("label", F.lit("all")).alias("label"), "entities", "supported", "mapped", F.round("mapped_rate", 6).alias("mapped_rate"))


def trigrams(spark, d):
    return table(spark, d, "onet_entries").select("entry_id", F.explode(tx.ngrams(F.col("title"))).alias("gram"))


def semantic_top(spark, d):
    """Nearest of the other vectors for every vector whose id is divisible by 50."""
    e = table(spark, d, "embeddings").select("vec_id", link.unit(F.col("embedding")).alias("v"))
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    s = e.join(F.broadcast(q) if q.limit(20_001).count() <= 20_000 else q, F.col("vec_id") != F.col("query_id")).select("query_id", "vec_id", F.round(link.cosine(F.col("q"), F.col("v")), 6).alias("score"))
    best = s.groupBy("query_id").agg(F.max_by(F.struct("vec_id", "score"), F.struct("score", -F.col("vec_id"))).alias("b"))
    return best.select("query_id", "b.vec_id", "b.score")


def stratified_split(spark, d):
    return ft.stratified_split(_docs(spark, d), id="doc_id", kind="doc_type")


def candidate_ngrams(spark, d):
    t = _docs(spark, d).select("doc_id", F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "[ \n]+"), lambda w: w != "")).alias("n_tokens"))
    return spans.candidate_spans(t, 4, "doc_id").groupBy("doc_id").agg(F.count("*").alias("spans"), F.sum("span_width").alias("width"))


def _candidates(spark, d):
    """Runs of up to three tokens of every chunk; label_id is that of the annotation whose repaired bounds are a run's, or 0."""
    c = table(spark, d, "chunk_records").where("feature_id is not null and text is not null").groupBy("feature_id").agg(F.max_by(F.struct("chunk_index", F.col("chunk_start").cast("int").alias("chunk_start"), "text"), F.struct("ingested_at", "text")).alias("c"))
    c = c.select("feature_id", F.lower(F.substring_index("feature_id", "::chunk-", 1)).alias("record_id"), "c.*")
    record = F.coalesce(F.nullif(tx.collapse(F.col("record_id")), F.lit("")), F.lower(F.substring_index("feature_id", "::chunk-", 1)))
    s = table(spark, d, "span_annotations").where("label is not null and trim(text) <> ''").withColumn("record_id", record).where("record_id is not null")
    s = s.groupBy("annotation_id").agg(F.max_by(F.struct("record_id", "label", "text", "span_start", "span_end"), F.struct("annotated_at", "text", "span_start", "record_id")).alias("s")).select("annotation_id", "s.*")
    docs = _docs(spark, d).where("record_id is not null and text is not null").groupBy(tx.collapse(F.col("record_id")).alias("record_id")).agg(F.min_by("text", "doc_id").alias("doc"))
    start = spans.repaired_start(F.col("doc"), F.col("text"), F.col("span_start").cast("int"), F.col("span_end").cast("int"))
    s = s.join(docs, "record_id").select("annotation_id", "record_id", "label", F.length("text").alias("n"), start.alias("start")).where("start is not null").withColumn("end", F.col("start") + F.col("n"))
    # of the chunks that hold a span the first takes it, as spans.first_holding_chunk has it
    held = s.join(c.select("record_id", "feature_id", "chunk_index", "chunk_start", (F.col("chunk_start") + F.length("text")).alias("chunk_end")), "record_id").where("start >= chunk_start and end <= chunk_end")
    held = held.groupBy("annotation_id", "label", "start", "end").agg(F.min(F.struct("chunk_index", "chunk_start", "feature_id")).alias("f")).join(F.broadcast(ft.label_ids(table(spark, d, "span_annotations"))), "label")
    held = held.groupBy(F.col("f.feature_id").alias("feature_id")).agg(F.collect_list(F.struct((F.col("start") - F.col("f.chunk_start")).alias("a"), (F.col("end") - F.col("f.chunk_start")).alias("b"), "label_id")).alias("gold"))
    # the spans of a chunk join it before its runs are made; the windows of the sampling still shuffle the runs
    runs = c.select("feature_id", "text").join(held, "feature_id", "left").select("feature_id", ft.token_offsets(F.col("text")).alias("offsets"), "gold")
    gold = F.transform("gold", lambda g: F.struct(spans.token_span(F.col("offsets"), g["a"], g["b"]).alias("t"), g["label_id"].alias("label_id")))
    runs = runs.select(F.struct("feature_id", gold.alias("gold")).alias("f"), F.size("offsets").alias("n_tokens"))
    runs = spans.candidate_spans(runs, 3, "f")
    same = F.filter("f.gold", lambda g: (g["t"]["first"] == F.col("start_token")) & (g["t"]["last"] == F.col("end_token")))
    return runs.select("f.feature_id", "start_token", "end_token", "span_width", F.coalesce(F.array_max(F.transform(same, lambda g: g["label_id"])), F.lit(0)).alias("label_id"))


def negative_sample(spark, d):
    return ft.sample_negatives(_candidates(spark, d), 2, 8).groupBy("feature_id").agg(F.count("*").alias("n"), F.sum((F.col("label_id") != 0).cast("bigint")).alias("labelled"), F.sum("start_token").alias("starts"))


def label_vocabulary(spark, d):
    return ft.label_ids(table(spark, d, "span_annotations")).select("label", F.col("label_id").cast("bigint").alias("label_id"))


def _predictions(spark, d):
    s = table(spark, d, "span_annotations").select("annotation_id", F.coalesce("label", F.lit("O")).alias("gold"), "text")
    return s.withColumn("pred", F.when(F.col("text").rlike("[0-9]"), "TECHNOLOGY").when(F.col("text").rlike("[A-Z]{3}"), "JOB_ROLE").when(F.contains("text", F.lit(" ")), "SKILL").otherwise("O"))


def prf_metrics(spark, d):
    p = _predictions(spark, d)
    one = metrics.micro(p).select(F.lit("all").alias("label"), "tp", "fp", "fn", "precision", "recall", "f1")
    return one.unionByName(metrics.per_label(p)).select("label", "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


def confusion(spark, d):
    return metrics.confusion(_predictions(spark, d))


def error_texts(spark, d):
    p = _predictions(spark, d).where("gold <> pred and text is not null")
    return metrics.top_error_texts(p.select(F.col("gold").alias("label"), "text"), k=10)


def confidence_percentiles(spark, d):
    c = metrics.confidence(table(spark, d, "events"), "value", "event_type")
    return c.select("event_type", *(F.round(x, 6).alias(x) for x in ("mean", "median", "p25", "p75", "min", "max")), "n")


def document_votes(spark, d):
    v = table(spark, d, "chunk_records").where("document_type is not null").select(F.substring_index("feature_id", "::chunk-", 1).alias("record_id"), F.struct("chunk_index", "ingested_at", "feature_id", tx.doc_type(F.col("document_type")).alias("kind")).alias("v")).distinct()
    return v.groupBy("record_id").agg(F.sort_array(F.collect_list("v")).alias("v")).select("record_id", an.vote(F.transform("v", lambda x: x["kind"])).alias("kind"))


def retry_delays(spark, d):
    x = spark.range(1).select(F.explode(F.array(*map(F.lit, ("31s", "1500ms", "2m", "1h", "7", "soon", "")))).alias("value"))
    return x.select("value", tx.retry_seconds(F.col("value")).alias("seconds"))


def revenue_by_nation(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    li = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    g = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("c_nationkey").agg(F.round(F.sum("r"), 2).alias("revenue"), F.count("*").alias("n"))
    return g.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "revenue", "n")


QUERIES = {
    f.__name__: f
    for f in (
        flagship, clean_text_metrics, drop_reason_counts, exact_dedupe, seed_round_robin, seed_top_keywords, it_predicate, it_predicate_strict, term_counts, regex_spans, line_activity, weak_label_counts, chunk_documents, span_chunk_assign,
        offset_repair, refine_spans, batch_merge, batch_finalize, chunk_ids, record_ids, resume_antijoin, resume_state, unpivot_texts, doc_types, shard_totals, descriptor_pivot, taxonomy_counts, token_block, entity_links, mapping_summary, trigrams,
        semantic_top, stratified_split, candidate_ngrams, negative_sample, label_vocabulary, prf_metrics, confusion, error_texts, confidence_percentiles, document_votes, retry_delays, revenue_by_nation,
    )
}


# ---------------------------------------------------------------- SQL

#: White space as Unicode has it, for RE2.
_S = r"[\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_SL = _S.replace(r"\n", "")
_WC = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{_S}+|{_S}+$', '', 'g')"


def _clean(x: str) -> str:
    x = _strip(f"coalesce({x}, '')")
    for a, b in lx.MANUAL_TEXT_REPLACEMENTS.items():
        x = f"replace({x}, {_q(a)}, {_q(b)})"
    for a, b in ((r"\r\n?", "\\n"), (r"[ \t]*\n[ \t]*", "\\n"), (r"[ \t]{2,}", " "), (r"\n{3,}", "\\n\\n"), (rf"{_SL}*\n{_SL}*", "\\n")):
        b = "' '" if b == " " else "chr(10)" if b == "\\n" else "chr(10) || chr(10)"
        x = f"regexp_replace({x}, '{a}', {b}, 'g')"
    return rf"regexp_replace({_strip(x)}, '\n{{3,}}', chr(10) || chr(10), 'g')"


_DEFS = f"""
    c AS (SELECT *, {_clean("text")} AS t, lower({_strip("coalesce(doc_type, '')")}) AS kind, lower({_strip("coalesce(lang, '')")}) AS lg FROM documents),
    m AS (SELECT *, length(t) AS text_length, len(regexp_extract_all(t, '[{_WC}](?:[{_WC}+#./-]*[{_WC}])?')) AS word_count,
        CASE WHEN kind = 'cv' THEN CASE WHEN length(t) < 400 THEN 'short' WHEN length(t) < 900 THEN 'medium' WHEN length(t) < 1800 THEN 'long' ELSE 'xlong' END
             ELSE CASE WHEN length(t) < 1000 THEN 'short' WHEN length(t) < 1800 THEN 'medium' WHEN length(t) < 3000 THEN 'long' ELSE 'xlong' END END AS length_bucket FROM c),
    r AS (SELECT *, CASE WHEN {_strip("coalesce(record_id, '')")} = '' OR t = '' THEN 'missing_core_fields' WHEN kind NOT IN ('cv', 'jd') THEN 'unknown_type' WHEN lg <> '' AND NOT starts_with(lg, 'en') THEN 'language'
        WHEN text_length < CASE WHEN kind = 'cv' THEN 200 ELSE 350 END OR word_count < CASE WHEN kind = 'cv' THEN 30 ELSE 50 END THEN 'short_or_sparse' END AS reason,
        trim(regexp_replace(lower(t), '{_S}+', ' ', 'g')) AS k FROM m),
    z AS (SELECT *, CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY kind, k, reason IS NULL ORDER BY doc_id) > 1 THEN 'duplicate_text' ELSE reason END AS drop_reason,
        coalesce(nullif(primary_keyword, ''), 'unknown') AS pk FROM r)
"""
_TYPE = lambda x: f"CASE WHEN regexp_matches(lower({x}), 'cv|resume|candidate|profile') THEN 'cv' WHEN regexp_matches(lower({x}), 'jd|job|description|vacancy|posting|role') THEN 'jd' ELSE 'unknown' END"
_TERMS = ", ".join(f"({_q(k)}, {_q(t)})" for k, ts in TERMS.items() for t in ts)
_HAS = lambda x, ts: "(" + " OR ".join(f"contains({x}, {_q(t)})" for t in ts) + ")"
_IN = lambda ts: ", ".join(map(_q, ts))
_TERM_COUNT = rf"""len(regexp_extract_all(regexp_replace(lower(text), '([^A-Za-z0-9])', '\1\1', 'g'),
    '(?:^|[^A-Za-z0-9])' || regexp_escape(regexp_replace(term, '([^A-Za-z0-9])', '\1\1', 'g')) || '(?:$|[^A-Za-z0-9])'))"""
_LATEST = """(SELECT annotation_id, arg_max({'r': record_id, 'l': label, 't': text}, {'a': annotated_at, 't': text, 'r': record_id, 'l': label}) AS s
    FROM span_annotations WHERE text IS NOT NULL AND trim(text) <> '' AND record_id IS NOT NULL GROUP BY 1)"""
_PRED = "(SELECT coalesce(label, 'O') AS gold, text, CASE WHEN regexp_matches(text, '[0-9]') THEN 'TECHNOLOGY' WHEN regexp_matches(text, '[A-Z]{3}') THEN 'JOB_ROLE' WHEN contains(text, ' ') THEN 'SKILL' ELSE 'O' END AS pred FROM span_annotations)"
_RATES = "round(tp / greatest(tp + fp, 1), 6) AS precision, round(tp / greatest(tp + fn, 1), 6) AS recall, round(2 * (tp / greatest(tp + fp, 1)) * (tp / greatest(tp + fn, 1)) / greatest(tp / greatest(tp + fp, 1) + tp / greatest(tp + fn, 1), 1e-8), 6) AS f1"

_PREFIXES = "(?i)^(?:(?:" + "|".join(tx.literal(p).replace("'", "''") for p in sorted(lx.NOISY_PREFIXES, key=len, reverse=True)) + ")" + _S + "*)+"
_COLLAPSE = lambda x: f"trim(regexp_replace(lower({x}), '{_S}+', ' ', 'g'))"
_TOKENS = lambda x: f"list_distinct(list_filter(regexp_extract_all({x}, '[a-z0-9][a-z0-9.+#/\\-]*'), lambda t: t NOT IN ({_IN(sorted(lx.STOPWORDS))}) AND (length(t) > 1 OR t IN ({_IN(sorted(lx.SHORT_KEEP_TOKENS))}))))"
_NORM = lambda x: f"replace({x}, '’', chr(39))"
_GRAMS = lambda x: f"CASE WHEN {x} = '' THEN []::varchar[] ELSE list_distinct(list_transform(generate_series(1, greatest(length({x}) - 2, 1)), lambda i: substr({x}, i, 3))) END"
#: A record's first text, and the latest form of each annotation with its place.
_FIRST_DOC = f"(SELECT {_COLLAPSE('record_id')} AS r, arg_min(text, doc_id) AS doc, arg_min(doc_type, doc_id) AS kind FROM documents WHERE record_id IS NOT NULL AND text IS NOT NULL GROUP BY 1)"
#: Start of a span (a, b) with the text t in doc: as given, or the nearest occurrence.
_REPAIRED = """CASE WHEN t = '' THEN NULL WHEN a >= 0 AND a <= b AND b <= length(doc) AND substr(doc, a + 1, b - a) = t THEN a WHEN NOT contains(doc, t) THEN NULL
    ELSE list_min(list_transform(generate_series(1, len(string_split(doc, t)) - 1), lambda i: {'d': abs(coalesce(list_sum(list_transform(string_split(doc, t)[1:i], lambda x: length(x))), 0) + (i - 1) * length(t) - coalesce(a, 0)), 'p': coalesce(list_sum(list_transform(string_split(doc, t)[1:i], lambda x: length(x))), 0) + (i - 1) * length(t)})).p END"""
_LABEL_KEY = lambda x: f"regexp_replace(regexp_replace(upper({_strip(x)}), '[^A-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
_ALIAS = lambda x: f"coalesce(map([{_IN(lx.ENTITY_LABEL_ALIASES)}], [{_IN(lx.ENTITY_LABEL_ALIASES.values())}])[{x}], {x})"
_ANSWERS = r"""o AS (SELECT custom_id, arg_max({'s': status_code, 'c': content}, {'a': received_at, 'c': content}) AS o FROM batch_outputs WHERE custom_id IS NOT NULL GROUP BY 1),
        p AS (SELECT custom_id, o.s AS s, regexp_replace(regexp_replace(trim(coalesce(o.c, ''), E' \t\r\n'), '^```(?:json)?\s*', ''), '\s*```$', '') AS raw FROM o),
        ans AS (SELECT custom_id, CASE WHEN s <> 200 THEN 'status ' || s WHEN s IS NULL THEN 'status missing' WHEN raw = '' THEN 'empty content' WHEN NOT (json_valid(raw) AND starts_with(raw, '{')) THEN 'content is not a JSON object' END AS err, CASE WHEN json_valid(raw) AND starts_with(raw, '{') THEN raw END AS js FROM p)"""

SQL = {
    "token_block": f"""WITH t AS (SELECT * FROM (VALUES {", ".join(f"({_q(k)}, {_q(t)})" for k, ts in lx.LABEL_TARGET_TYPES.items() for t in ts)}) AS v(label, entry_type)),
        m AS (SELECT DISTINCT upper(s.l) AS label, s.t AS text FROM {_LATEST}), mm AS (SELECT label, text, {_TOKENS(_COLLAPSE(_NORM('text')))} AS ts, replace({_COLLAPSE(_NORM('text'))}, ' ', '') AS g FROM m),
        e AS (SELECT entry_id, entry_type, {_COLLAPSE(_NORM("concat_ws(' ', title, array_to_string(coalesce(aliases, []), ' '))"))} AS x FROM onet_entries),
        ee AS (SELECT entry_id, entry_type, {_TOKENS('x')} AS ts, replace(x, ' ', '') AS g FROM e),
        tk AS (SELECT label, text, entry_id, len(list_intersect(mm.ts, ee.ts)) AS n_both, len(mm.ts) + len(ee.ts) AS total FROM mm JOIN t USING (label) JOIN ee USING (entry_type) WHERE list_has_any(mm.ts, ee.ts)),
        r AS (SELECT * FROM mm WHERE (label, text) NOT IN (SELECT (label, text) FROM tk)),
        rg AS (SELECT label, text, {_GRAMS('g')} AS gs FROM r), eg AS (SELECT entry_id, entry_type, {_GRAMS('g')} AS gs FROM ee),
        tg AS (SELECT label, text, entry_id, len(list_intersect(rg.gs, eg.gs)) AS n_both, len(rg.gs) + len(eg.gs) AS total FROM rg JOIN t USING (label) JOIN eg USING (entry_type) WHERE list_has_any(rg.gs, eg.gs)),
        u AS (SELECT *, n_both / greatest(total - n_both, 1) AS score FROM (SELECT * FROM tk UNION ALL SELECT * FROM tg)),
        k AS (SELECT *, row_number() OVER (PARTITION BY label, text ORDER BY score DESC, entry_id) AS n FROM u)
        SELECT label, text, entry_id, round(score, 6) AS block_score FROM k WHERE n <= 256""",
    "offset_repair": f"""WITH d AS {_FIRST_DOC}, s AS (SELECT annotation_id, arg_max({{'r': record_id, 't': text, 'a': span_start, 'b': span_end}}, {{'x': annotated_at, 't': text, 'a': span_start, 'r': record_id}}) AS s FROM span_annotations WHERE record_id IS NOT NULL AND text IS NOT NULL GROUP BY 1),
        j AS (SELECT annotation_id, s.t AS t, s.a AS a, s.b AS b, doc FROM s JOIN d ON d.r = {_COLLAPSE('s.r')})
        SELECT annotation_id, cast({_REPAIRED} AS bigint) AS start FROM j""",
    "shard_totals": """WITH RECURSIVE x AS (SELECT row_number() OVER (ORDER BY doc_id) AS i, strlen(text) AS b, greatest(1, (strlen(text) + 3) // 4) AS t FROM documents WHERE text IS NOT NULL),
        f(i, shard, b, n, t) AS (SELECT 0::bigint, 0::bigint, 0::bigint, 0::bigint, 0::bigint UNION ALL
            SELECT x.i, CASE WHEN full_ THEN shard + 1 ELSE shard END, CASE WHEN full_ THEN x.b ELSE f.b + x.b END, CASE WHEN full_ THEN 1 ELSE f.n + 1 END, CASE WHEN full_ THEN x.t ELSE f.t + x.t END
            FROM (SELECT *, i + 1 AS next FROM f) f JOIN x ON x.i = f.next, LATERAL (SELECT f.n > 0 AND (f.b + x.b > 4000000 OR f.n + 1 > 900 OR f.t + x.t > 700000) AS full_) c)
        SELECT shard AS shard_id, count(*) AS records, count(*)::bigint AS requests, sum(x.b)::bigint AS bytes, sum(x.t)::bigint AS tokens FROM f JOIN x USING (i) GROUP BY 1""",
    "batch_finalize": f"""WITH d AS {_FIRST_DOC}, {_ANSWERS},
        c AS (SELECT custom_id, arg_max({{'f': feature_id, 'i': chunk_index, 's': chunk_start, 't': text}}, {{'a': ingested_at, 't': text}}) AS c FROM chunk_records WHERE custom_id IS NOT NULL AND text IS NOT NULL GROUP BY 1),
        m AS (SELECT custom_id, lower(split_part(c.f, '::chunk-', 1)) AS r, c.i AS i, c.s AS s, c.t AS doc, CASE WHEN ans.custom_id IS NULL THEN 'no answer for the chunk' ELSE err END AS err, CASE WHEN err IS NULL THEN js END AS js FROM c LEFT JOIN ans USING (custom_id)),
        bad AS (SELECT r, arg_min(err, {{'i': i, 'c': custom_id, 'e': err}}) AS err FROM m WHERE err IS NOT NULL GROUP BY 1),
        lg AS (SELECT r, i, lower({_strip("coalesce(json_extract_string(js, '$.document_language'), '')")}) AS l, coalesce(json_extract_string(js, '$.is_it_document') = 'true', false) AS it FROM m WHERE err IS NULL),
        ln AS (SELECT r, i, it, CASE WHEN l = '' THEN 'unknown' WHEN starts_with(l, 'en') THEN 'en' ELSE l END AS l FROM lg),
        lo AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY i, l) AS p FROM ln),
        lv AS (SELECT r, l, count(*) AS n, min(p) AS p FROM lo WHERE l <> 'unknown' GROUP BY 1, 2), lb AS (SELECT r, arg_max(l, {{'n': n, 'p': -p}}) AS l FROM lv GROUP BY 1),
        it AS (SELECT r, bool_or(it) AS it FROM ln GROUP BY 1),
        en AS (SELECT r, s, doc, unnest(from_json(json_extract(js, '$.entities'), '["json"]')) AS e FROM m WHERE err IS NULL),
        ef AS (SELECT r, s, doc, {_LABEL_KEY("coalesce(json_extract_string(e, '$.label'), '')")} AS k, {_strip("coalesce(json_extract_string(e, '$.text'), '')")} AS t, cast(floor(try_cast(json_extract_string(e, '$.start') AS double)) AS bigint) AS a, cast(floor(try_cast(json_extract_string(e, '$.end') AS double)) AS bigint) AS b FROM en),
        er AS (SELECT r, {_ALIAS('k')} AS k, t, s + {_REPAIRED} AS a FROM ef),
        ec AS (SELECT r, count(DISTINCT {{'k': k, 'a': a, 't': t}}) AS n FROM er WHERE k IN ({_IN(lx.ENTITY_LABELS)}) AND a IS NOT NULL GROUP BY 1)
        SELECT d.r AS record_id, CASE WHEN ok THEN coalesce(lb.l, 'unknown') ELSE '' END AS document_language, ok AND it.it AS is_it_document, CASE WHEN ok THEN coalesce(ec.n, 0) ELSE 0 END AS entities, CASE WHEN ok THEN '' ELSE coalesce(bad.err, 'no chunks for the record') END AS error
        FROM (SELECT d.*, (SELECT count(*) FROM m WHERE m.r = d.r) > 0 AND d.r NOT IN (SELECT r FROM bad) AS ok FROM d WHERE d.r <> '') d LEFT JOIN bad ON bad.r = d.r LEFT JOIN lb ON lb.r = d.r LEFT JOIN it ON it.r = d.r LEFT JOIN ec ON ec.r = d.r""",
    "clean_text_metrics": f"WITH {_DEFS} SELECT doc_id, text_length, word_count, CASE WHEN doc_type = 'cv' THEN CASE WHEN length(t) < 400 THEN 'short' WHEN length(t) < 900 THEN 'medium' WHEN length(t) < 1800 THEN 'long' ELSE 'xlong' END ELSE CASE WHEN length(t) < 1000 THEN 'short' WHEN length(t) < 1800 THEN 'medium' WHEN length(t) < 3000 THEN 'long' ELSE 'xlong' END END AS length_bucket, md5(t) AS digest FROM z",
    "drop_reason_counts": f"WITH {_DEFS} SELECT coalesce(drop_reason, 'kept') AS drop_reason, count(*) AS n FROM z GROUP BY 1",
    "exact_dedupe": f"WITH {_DEFS} SELECT doc_id, doc_type, text_length, word_count, pk || '::' || length_bucket AS seed_group FROM z WHERE drop_reason IS NULL",
    "seed_round_robin": f"WITH {_DEFS}, h AS (SELECT doc_id, primary_keyword, length_bucket, pk, row_number() OVER (PARTITION BY pk, length_bucket ORDER BY md5(doc_id || '|42'), doc_id) AS rn FROM z WHERE drop_reason IS NULL) SELECT doc_id, primary_keyword, length_bucket FROM h ORDER BY rn, pk, length_bucket LIMIT 100",
    "seed_top_keywords": f"WITH {_DEFS} SELECT primary_keyword, count(*) AS n FROM z WHERE drop_reason IS NULL GROUP BY 1 ORDER BY n DESC, primary_keyword NULLS FIRST LIMIT 10",
    "it_predicate": f"SELECT doc_id, CASE WHEN {_strip("coalesce(primary_keyword, '')")} IN ({_IN(KEYWORDS)}) THEN true WHEN {_strip("coalesce(primary_keyword, '')")} IN ({_IN(AMBIGUOUS)}) THEN {_HAS("lower(" + _strip("coalesce(primary_keyword, '')") + " || ' ' || " + _strip("coalesce(position_title, '')") + " || ' ' || substr(text, 1, 1500))", SIGNALS)} ELSE false END AS is_it FROM documents WHERE text IS NOT NULL",
    "it_predicate_strict": f"WITH p AS (SELECT doc_id, {_strip("coalesce(primary_keyword, '')")} AS k, lower({_strip("coalesce(primary_keyword, '')")} || ' ' || {_strip("coalesce(position_title, '')")}) AS h, text FROM documents WHERE text IS NOT NULL) SELECT doc_id, CASE WHEN k IN ({_IN(KEYWORDS[:1])}) THEN true WHEN {_HAS('h', ('manager', 'keeper'))} THEN false ELSE {_HAS('h', ('developer', 'engineer', 'architect'))} AND {_HAS("lower(h || ' ' || substr(text, 1, 1500))", SIGNALS)} END AS is_it FROM p",
    "term_counts": f"SELECT label, term, cast(sum(k) AS bigint) AS n, count(*) AS documents FROM (SELECT doc_id, label, term, {_TERM_COUNT} AS k FROM documents, (VALUES {_TERMS}) AS v(label, term) WHERE text IS NOT NULL) WHERE k > 0 GROUP BY 1, 2",
    "flagship": f"WITH {_DEFS}, k AS (SELECT doc_id, label, len(regexp_extract_all(regexp_replace(lower(t), '([^A-Za-z0-9])', '\\1\\1', 'g'), '(?:^|[^A-Za-z0-9])' || regexp_escape(regexp_replace(term, '([^A-Za-z0-9])', '\\1\\1', 'g')) || '(?:$|[^A-Za-z0-9])')) AS k FROM z, (VALUES {_TERMS}) AS v(label, term) WHERE drop_reason IS NULL) SELECT label, cast(sum(k) AS bigint) AS spans, count(DISTINCT doc_id) AS documents FROM k WHERE k > 0 GROUP BY 1",
    "regex_spans": r"SELECT doc_id, cast(len(a) + len(b) AS bigint) AS n, cast(list_sum(list_transform(list_concat(a, b), lambda x: length(x))) AS bigint) AS chars FROM (SELECT doc_id, regexp_extract_all(text, '(?i)\brelease \d+\.\d+\b') AS a, regexp_extract_all(text, '(?i)\bversion \d+\b') AS b FROM documents WHERE text IS NOT NULL) WHERE len(a) + len(b) > 0",
    "line_activity": rf'''WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), u AS (SELECT doc_id, i, ls[i] AS line, coalesce(list_sum(list_transform(ls[1:i - 1], lambda x: length(x) + 1)), 0) AS ahead FROM l, unnest(generate_series(1, len(ls))) AS g(i)), s AS (SELECT *, {_strip('line')} AS s, ahead + length(line) - length(regexp_replace(line, '^{_S}+', '')) AS start FROM u) SELECT doc_id, cast(start AS integer) AS start, cast(start + length(s) AS integer) AS "end", md5(s) AS digest FROM s WHERE length(s) BETWEEN 18 AND 180 AND regexp_matches(lower(regexp_replace(s, '^[\-\*\d\.\)\t\n\f\r\x0b ]+', '')), '^(?:built|cut |handled |extended |monitored |we |you |it''s )')''',
    "chunk_documents": rf"""WITH RECURSIVE d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE text IS NOT NULL),
        w(doc_id, text, n, k, cur, a, b) AS (
            SELECT doc_id, text, n, -1, 0, 0, 0 FROM d WHERE n > 1400
            UNION ALL
            SELECT doc_id, text, n, k + 1, greatest(b2 - 120, cur + 1), a2, b2 FROM (
                SELECT *, CASE WHEN hi - tr <= cur + ld THEN cur ELSE cur + ld END AS a2, CASE WHEN hi - tr <= cur + ld THEN hi ELSE hi - tr END AS b2 FROM (
                    SELECT *, length(substr(text, cur + 1, hi - cur)) - length(regexp_replace(substr(text, cur + 1, hi - cur), '^{_S}+', '')) AS ld,
                        length(substr(text, cur + 1, hi - cur)) - length(regexp_replace(substr(text, cur + 1, hi - cur), '{_S}+$', '')) AS tr FROM (
                        SELECT *, CASE WHEN cur + 1400 >= n THEN n WHEN regexp_matches(substr(text, cur + 701, 700), '[ \n]') THEN cur + 700 + length(regexp_extract(substr(text, cur + 701, 700), '(?s)^.*[ \n]')) ELSE cur + 1400 END AS hi
                        FROM w WHERE k = -1 OR b < n))))
        SELECT doc_id || '::chunk-' || k AS feature_id, cast(a AS integer) AS chunk_start, cast(b AS integer) AS chunk_end, md5(substr(text, a + 1, b - a)) AS digest FROM w WHERE k >= 0
        UNION ALL SELECT doc_id || '::chunk-0', 0, cast(n AS integer), md5(text) FROM d WHERE n <= 1400""",
    "span_chunk_assign": f"""WITH s AS (SELECT DISTINCT ON (annotation_id) annotation_id, trim(regexp_replace(lower(record_id), '{_S}+', ' ', 'g')) AS r, span_start AS a, span_end AS b FROM span_annotations WHERE record_id IS NOT NULL),
        c AS (SELECT lower(split_part(feature_id, '::chunk-', 1)) AS r, min(chunk_index) AS i, arg_min(chunk_start, (chunk_index, chunk_start, length(text))) AS x, arg_min(chunk_start + length(text), (chunk_index, chunk_start, length(text))) AS y FROM chunk_records WHERE NOT contains(feature_id, '::sub-') AND text IS NOT NULL GROUP BY feature_id)
        SELECT annotation_id, cast(min(i) AS bigint) AS chunk_index FROM s LEFT JOIN c ON s.r = c.r AND a >= x AND b <= y GROUP BY 1""",
    "refine_spans": rf"""WITH s AS (SELECT upper({_strip("coalesce(label, '')")}) AS lab, label, text, normalized, CASE WHEN span_start IS NULL THEN '' ELSE regexp_extract(text, '{_PREFIXES}') END AS p FROM span_annotations WHERE text IS NOT NULL),
        t AS (SELECT *, p <> '' AS trimmed, CASE WHEN p <> '' THEN substr(text, length(p) + 1) ELSE text END AS x FROM s),
        n AS (SELECT *, CASE WHEN trimmed AND coalesce(normalized, '') <> '' THEN trim(regexp_replace(lower(x), '{_S}+', ' ', 'g')) ELSE normalized END AS y FROM t),
        k AS (SELECT *, trim(regexp_replace(lower(coalesce(nullif(y, ''), {_strip('x')})), '{_S}+', ' ', 'g')) AS n FROM n)
        SELECT label, count(*) AS n, cast(sum(trimmed::int) AS bigint) AS trimmed FROM k WHERE NOT CASE WHEN lab = '' OR n = '' THEN false WHEN lab = 'ABILITY' THEN true
            WHEN lab = 'SKILL' THEN n IN ({_IN(lx.NON_SKILL_TERMS)}) OR n IN ({_IN(lx.ENGLISH_LEVEL_TERMS)}) OR starts_with(n, 'english level') OR starts_with(n, 'level of english') OR (contains(n, 'english') AND {_HAS('n', sorted(set(lx.ENGLISH_LEVEL_TERMS) | set(lx.ENGLISH_LEVEL_CONTEXT_TERMS)))}) OR regexp_matches(n, {_q("|".join(f"(?:{p})" for p in lx.NON_SKILL_PATTERNS))})
            WHEN lab = 'INDUSTRY' THEN n IN ({_IN(lx.NON_INDUSTRY_TERMS)}) WHEN lab = 'PROJECT_TYPE' THEN n IN ({_IN(lx.GENERIC_PROJECT_TYPE_TERMS)}) ELSE false END GROUP BY 1""",
    "chunk_ids": "SELECT DISTINCT record_id, chunk_index, chunk_start, 'chunk-' || substr(sha1(record_id || '|' || chunk_index || '|' || chunk_start), 1, 16) AS chunk_id FROM chunk_records WHERE record_id IS NOT NULL",
    "record_ids": f"SELECT doc_id, CASE WHEN {_strip("coalesce(company_name, '')")} <> '' THEN {_strip('company_name')} || ':text' ELSE 'row-' || doc_id || ':text:' || substr(sha1(text), 1, 12) END AS stable_id FROM documents WHERE text IS NOT NULL",
    "resume_antijoin": f"SELECT DISTINCT trim(regexp_replace(lower(record_id), '{_S}+', ' ', 'g')) AS record_id FROM documents d WHERE record_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM chunk_records c WHERE lower(split_part(c.feature_id, '::chunk-', 1)) = trim(regexp_replace(lower(d.record_id), '{_S}+', ' ', 'g')))",
    "resume_state": "SELECT doc_type, count(*) AS rows, max(doc_id) + 1 AS next_offset FROM documents GROUP BY 1",
    "unpivot_texts": "SELECT 'text' AS source_column, 'auto' AS type_hint, count(*) AS n, cast(sum(length(text)) AS bigint) AS chars FROM documents WHERE trim(text) <> '' UNION ALL SELECT 'position_title', 'jd', count(*), cast(sum(length(position_title)) AS bigint) FROM documents WHERE trim(position_title) <> ''",
    "doc_types": f"SELECT coalesce(nullif({_TYPE("coalesce(source, '')")}, 'unknown'), 'unknown') AS kind, CASE WHEN {_strip("coalesce(lang, '')")} = '' THEN 'unknown' WHEN starts_with(lower({_strip('lang')}), 'en') THEN 'en' ELSE lower({_strip('lang')}) END AS language, count(*) AS n FROM documents GROUP BY 1, 2",
    "descriptor_pivot": "SELECT l_partkey, arg_max(l_extendedprice, l_orderkey * 10 + l_linenumber) FILTER (l_returnflag = 'R') AS importance, arg_max(l_extendedprice, l_orderkey * 10 + l_linenumber) FILTER (l_returnflag = 'N') AS level FROM lineitem GROUP BY 1",
    "taxonomy_counts": "SELECT entry_type, count(*) AS entries FROM onet_entries GROUP BY 1",
    "trigrams": f"WITH t AS (SELECT entry_id, regexp_replace(replace(lower(title), '’', ''''), '{_S}+', '', 'g') AS x FROM onet_entries WHERE title IS NOT NULL) SELECT DISTINCT entry_id, substr(x, i, 3) AS gram FROM t, unnest(generate_series(1, greatest(length(x) - 2, 1))) AS g(i) WHERE x <> ''",
    "semantic_top": "WITH e AS (SELECT vec_id, embedding::double[] AS v, sqrt(list_dot_product(embedding::double[], embedding::double[])) AS n FROM embeddings), s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_dot_product(q.v, e.v) / (q.n * e.n), 6) AS score FROM e JOIN e q ON q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id) SELECT query_id, arg_max(vec_id, (score, -vec_id)) AS vec_id, max(score) AS score FROM s GROUP BY 1",
    "stratified_split": "WITH g AS (SELECT cast(doc_id AS varchar) AS doc_id, CASE WHEN doc_type IN ('cv', 'jd') THEN doc_type ELSE 'other' END AS k FROM documents), n AS (SELECT *, count(*) OVER (PARTITION BY k) AS n, row_number() OVER (PARTITION BY k ORDER BY md5(doc_id || '|42'), doc_id) AS r FROM g), c AS (SELECT *, greatest(1, floor(n * 0.8)) AS a, greatest(1, floor(n * 0.1)) AS b FROM n) SELECT doc_id, CASE WHEN n <= 2 THEN CASE WHEN r = 1 THEN 'train' ELSE 'dev' END WHEN r <= CASE WHEN a + b >= n THEN greatest(1, n - 2) ELSE a END THEN 'train' WHEN r <= CASE WHEN a + b >= n THEN greatest(1, n - 2) + 1 ELSE a + b END THEN 'dev' ELSE 'test' END AS split FROM c",
    "candidate_ngrams": r"WITH t AS (SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \n]+'), lambda w: w <> '')) AS n FROM documents), s AS (SELECT doc_id, i, least(i + 3, n - 1) - i + 1 AS k FROM t, unnest(generate_series(0, n - 1)) AS g(i)) SELECT doc_id, cast(sum(k) AS bigint) AS spans, cast(sum(k * (k + 1) // 2) AS bigint) AS width FROM s GROUP BY 1",
    "label_vocabulary": "SELECT label, row_number() OVER (ORDER BY label) AS label_id FROM (SELECT DISTINCT label FROM span_annotations WHERE label IS NOT NULL) UNION ALL SELECT 'O', 0",
    "prf_metrics": f"WITH p AS {_PRED}, k AS (SELECT gold AS label, 'tp' AS k FROM p WHERE gold = pred UNION ALL SELECT pred, 'fp' FROM p WHERE gold <> pred UNION ALL SELECT gold, 'fn' FROM p WHERE gold <> pred), c AS (SELECT coalesce(label, 'all') AS label, count(*) FILTER (k = 'tp') AS tp, count(*) FILTER (k = 'fp') AS fp, count(*) FILTER (k = 'fn') AS fn FROM k WHERE label <> 'O' GROUP BY ROLLUP (label)) SELECT label, tp, fp, fn, {_RATES} FROM c",
    "confusion": f"WITH p AS {_PRED} SELECT gold, pred, count(*) AS n FROM p WHERE gold <> pred GROUP BY 1, 2",
    "error_texts": f"WITH p AS {_PRED}, c AS (SELECT gold AS label, lower(trim(text)) AS text, count(*) AS n FROM p WHERE gold <> pred AND text IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, text) AS r FROM c) SELECT label, text, n FROM r WHERE r <= 10 AND text <> ''",
    "confidence_percentiles": "SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.75), 6) AS p75, round(min(value), 6) AS min, round(max(value), 6) AS max, count(value) AS n FROM events WHERE value IS NOT NULL GROUP BY 1",
    "retry_delays": "SELECT * FROM (VALUES ('31s', 31.0::double), ('1500ms', 1.5), ('2m', 120.0), ('1h', 3600.0), ('7', 7.0), ('soon', NULL), ('', NULL)) AS v(value, seconds)",
    "revenue_by_nation": "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
    "document_votes": f"WITH v AS (SELECT DISTINCT split_part(feature_id, '::chunk-', 1) AS record_id, chunk_index, ingested_at, feature_id, {_TYPE('document_type')} AS kind FROM chunk_records WHERE document_type IS NOT NULL), o AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY chunk_index, ingested_at, feature_id, kind) AS p FROM v), c AS (SELECT record_id, kind, count(*) AS n, min(p) AS p FROM o WHERE kind <> 'unknown' GROUP BY 1, 2) SELECT record_id, coalesce((SELECT arg_max(kind, (n, -p)) FROM c WHERE c.record_id = o.record_id), 'unknown') AS kind FROM o GROUP BY 1",
    "batch_merge": r"""WITH o AS (SELECT custom_id, arg_max({'s': status_code, 'c': content}, {'a': received_at, 'c': content}) AS o FROM batch_outputs WHERE custom_id IS NOT NULL GROUP BY 1),
        p AS (SELECT custom_id, o.s AS s, regexp_replace(regexp_replace(trim(coalesce(o.c, ''), E' \t\r\n'), '^```(?:json)?\s*', ''), '\s*```$', '') AS raw FROM o),
        j AS (SELECT *, CASE WHEN json_valid(raw) AND starts_with(raw, '{') THEN raw END AS js FROM p)
        SELECT custom_id, CASE WHEN s <> 200 THEN 'status ' || s WHEN s IS NULL THEN 'status missing' WHEN raw = '' THEN 'empty content' WHEN js IS NULL THEN 'content is not a JSON object' ELSE '' END AS error,
            CASE WHEN s = 200 THEN coalesce(json_extract_string(js, '$.document_language'), '') ELSE '' END AS language, CASE WHEN s = 200 AND js IS NOT NULL THEN coalesce(json_array_length(js, '$.entities'), 0)::bigint ELSE 0 END AS entities FROM j""",
}
