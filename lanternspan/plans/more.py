"""Further registered queries of the core: training data, answers of services, mapping summaries; and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx
from ..operators import annotate as an
from ..operators import features as ft
from ..operators import link, responses, seed, spans, weak
from ..sources.readers import typed_documents
from .core import _COLLAPSE, _LATEST, _NORM, _S, _docs, _mentions, _q, _strip, table


def annotation_documents(spark, d):
    t = typed_documents(_docs(spark, d).drop("lang"))
    return t.groupBy("document_type").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def exact_links(spark, d):
    """Links of mentions whose text is an entry's title or alias; the best is that with the least id."""
    e = table(spark, d, "onet_entries").select("entry_id", "entry_type", F.coalesce("onetsoc_code", F.lit("")).alias("onetsoc_code"), F.explode(F.array_distinct(F.concat(F.array("title"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("name"))
    e = e.select("entry_id", "entry_type", "onetsoc_code", tx.normalize_text(F.col("name")).alias("k")).where("k <> ''").distinct()
    m = _mentions(spark, d).withColumn("k", tx.normalize_text(F.col("text"))).join(F.broadcast(link.targets(spark)), "label")
    j = m.join(e, ["entry_type", "k"]).groupBy("record_id", "mention_id", "label", "text").agg(F.min(F.struct("entry_id", "onetsoc_code")).alias("b"))
    return j.select("record_id", "mention_id", "label", "text", F.lit(1).alias("rank"), "b.entry_id", "b.onetsoc_code", F.when(F.col("text") == F.lower("text"), 1.0).otherwise(0.75).alias("score"))


def exact_mapping_summary(spark, d):
    s = link.mapping_summary(_mentions(spark, d), exact_links(spark, d))
    return s.select(F.coalesce("label", F.lit("all")).alias("label"), "entities", "supported", "mapped", F.round("mapped_rate", 6).alias("mapped_rate"), F.round("average_best_score", 6).alias("average"))


def record_mapping_summary(spark, d):
    s = link.mapping_summary(_mentions(spark, d), exact_links(spark, d), by_record=True)
    return s.select("record_id", "entities", "supported", "mapped", F.round("mapped_rate", 6).alias("mapped_rate"), F.round("average_best_score", 6).alias("average"))


def record_codes(spark, d):
    c = link.record_codes(exact_links(spark, d))
    return c.select("record_id", F.array_join("top_codes", ",").alias("top_codes"), F.array_join("role_codes", ",").alias("role_codes"))


def record_label_counts(spark, d):
    c = link.record_label_counts(_mentions(spark, d), exact_links(spark, d)).select("record_id", F.explode("by_label").alias("label", "n"))
    return c.select("record_id", "label", "n.entities", "n.supported", "n.mapped")


def record_mappings(spark, d):
    m = link.record_mappings(_mentions(spark, d), exact_links(spark, d)).select("record_id", F.inline("mappings"))
    return m.select("record_id", F.col("entity_index").alias("mention_id"), "entity_label", "supported", F.size("target_entry_types").cast("bigint").alias("types"), F.coalesce(F.get("candidates", F.lit(0))["entry_id"], F.lit("")).alias("entry_id"))


def response_texts(spark, d):
    """Answers of the batch in the envelopes of a chat service, taken out again."""
    b = table(spark, d, "batch_outputs").where("custom_id is not null").groupBy("custom_id").agg(F.max_by(F.struct("status_code", "finish_reason", "content"), F.struct("received_at", "content")).alias("o")).select("custom_id", "o.*")
    choice = F.struct(F.col("finish_reason"), F.struct(F.col("content")).alias("message"))
    body = F.struct(F.array(choice).alias("choices"))
    row = F.to_json(F.struct("custom_id", F.struct("status_code", body.alias("body")).alias("response")))
    t = responses.batch_text(b.select(F.col("custom_id").alias("id"), row.alias("row")))
    return t.select("custom_id", F.md5(F.coalesce("text", F.lit(""))).alias("digest"), F.coalesce("error", F.lit("")).alias("error"))


def candidate_texts(spark, d):
    """Document texts as the parts of a generated candidate, taken out again."""
    part = lambda c: F.struct(c.alias("text"))
    half = F.floor(F.length("text") / 2).cast("int")
    parts = F.array(part(F.substring("text", F.lit(1), half)), part(F.expr("substring(text, cast(floor(length(text) / 2) as int) + 1)")))
    one = F.struct(F.when(F.col("doc_type") == "cv", "STOP").otherwise(F.when(F.col("doc_id") % 3 == 0, "SAFETY")).alias("finishReason"), F.struct(parts.alias("parts")).alias("content"))
    x = _docs(spark, d).where("text is not null").select("doc_id", F.to_json(F.struct(F.array(one).alias("candidates"))).alias("body"))
    return responses.candidate_text(x).select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("digest"), F.coalesce("error", F.lit("")).alias("error"))


_ERRORS = (
    (429, '{"error": {"status": "RESOURCE_EXHAUSTED", "message": "Quota exceeded", "details": [{"retryDelay": "31s"}, {"quotaId": "RequestsPerDay"}]}}', 31.0, False, True, True, True),
    (401, "", None, True, False, False, False),
    (503, "gateway", None, False, False, False, True),
    (400, '{"error": {"code": "insufficient_quota"}}', None, False, True, False, False),
    (429, '{"error": {"code": "rate_limit_exceeded", "message": "slow down"}}', None, False, False, True, True),
    (403, '{"error": {"status": "PERMISSION_DENIED"}}', None, True, False, False, False),
)


def api_errors(spark, d):
    x = spark.createDataFrame([(i, *e[:2]) for i, e in enumerate(_ERRORS)], "id bigint, status int, body string")
    return responses.classify_errors(x).select("id", F.coalesce("retry_after_seconds", F.lit(-1.0)).alias("wait"), "key_invalid", "quota_exhausted", "rate_limited", "transient")


def chunk_spans(spark, d):
    """Spans of annotations in the first chunk that holds them, offsets from its start."""
    s = table(spark, d, "span_annotations").where("record_id is not null and text is not null and span_start is not null and span_end is not null").dropDuplicates(["annotation_id"])
    s = s.groupBy(tx.collapse(F.col("record_id")).alias("record_id")).agg(F.collect_list(F.struct("label", F.col("span_start").cast("int").alias("start"), F.col("span_end").cast("int").alias("end"), F.col("annotation_id").cast("string").alias("text"))).alias("entities"))
    docs = _docs(spark, d).where("record_id is not null and text is not null").groupBy(tx.collapse(F.col("record_id")).alias("record_id")).agg(F.min_by("text", "doc_id").alias("text"))
    c = ft.chunks_with_spans(docs.join(s, "record_id"), 1400, 120)
    return c.groupBy("record_id").agg(F.count("*").alias("chunks"), F.sum(F.size("spans")).alias("held"), F.sum("unassigned").cast("bigint").alias("lost"), F.sum(F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, x: a + x["start"])).alias("starts"))


def gold_candidates(spark, d):
    """Runs of up to three words of position titles; those that a lexicon of roles holds are gold."""
    w = _docs(spark, d).where("position_title is not null").select("doc_id", F.filter(F.split(F.lower("position_title"), " "), lambda x: x != "").alias("w"))
    c = spans.candidate_spans(w.select("doc_id", F.size("w").alias("n_tokens"), ), 3, "doc_id")
    at = w.select("doc_id", F.posexplode("w").alias("start_token", "x")).where(F.col("x").isin("engineer", "manager", "analyst", "developer"))
    gold = at.select("doc_id", "start_token", F.col("start_token").alias("end_token"), F.lit(1).alias("label_id"))
    g = ft.with_gold(c, gold, "doc_id")
    return g.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("label_id").cast("bigint").alias("gold"), F.sum("span_width").cast("bigint").alias("width"))


def manifest_gaps(spark, d):
    """What a manifest of the chunked records lacks of the documents, and the other way round."""
    docs = _docs(spark, d).where("record_id is not null").select(tx.collapse(F.col("record_id")).alias("record_id"))
    ids = table(spark, d, "chunk_records").select(F.lower(F.substring_index("feature_id", "::chunk-", 1)).alias("record_id"), F.when(F.col("chunk_index") % 3 == 0, "train").when(F.col("chunk_index") % 3 == 1, "dev").otherwise("test").alias("split"))
    return ft.manifest_gaps(docs, ids)


def changed_models(spark, d):
    """Requests of all chunks, of which those of chunk 0 get another model."""
    c = table(spark, d, "chunk_records").where("custom_id is not null and text is not null").select("custom_id", "chunk_index", F.to_json(F.struct("custom_id", F.struct(F.when(F.col("chunk_index") % 2 == 0, "old").otherwise("new").alias("model"), F.col("text").alias("input")).alias("body"))).alias("request"))
    r = an.with_model(c, "new")
    return r.groupBy("custom_id").agg(F.count("*").alias("n"), F.sum(F.col("changed").cast("bigint")).alias("changed"), F.min(F.get_json_object("request", "$.body.model")).alias("model"), F.max(F.md5(F.get_json_object("request", "$.body.input"))).alias("digest"))


def weak_stats(spark, d):
    """How many documents of each type have annotations."""
    docs = _docs(spark, d).where("record_id is not null").groupBy(tx.collapse(F.col("record_id")).alias("record_id")).agg(F.min_by("doc_type", "doc_id").alias("doc_type"))
    s = table(spark, d, "span_annotations").where("record_id is not null").select(tx.collapse(F.col("record_id")).alias("record_id"))
    return weak.stats(docs, s)


def first_met_keywords(spark, d):
    return seed.top_values(_docs(spark, d), "primary_keyword", 15, "doc_id")


def seed_lengths(spark, d):
    x = _docs(spark, d).where("text is not null").select("doc_id", "doc_type", "primary_keyword", F.length("text").alias("text_length"), tx.length_bucket(F.col("doc_type"), F.length("text")).alias("length_bucket"))
    s = seed.seed_stats(x, pos="doc_id")
    n = s["by_bucket"].select("doc_type", F.col("length_bucket").alias("key"), F.col("n").cast("double").alias("value"))
    return n.unionByName(s["lengths"].select("doc_type", F.lit("mean length").alias("key"), F.round("mean", 4).alias("value")))


QUERIES = {
    f.__name__: f
    for f in (
        annotation_documents, exact_mapping_summary, record_mapping_summary, record_codes, record_label_counts, record_mappings, response_texts, candidate_texts, api_errors, chunk_spans, gold_candidates, manifest_gaps, changed_models,
        weak_stats, first_met_keywords, seed_lengths,
    )
}

_TARGETS = ", ".join(f"({_q(k)}, {_q(t)})" for k, ts in lx.LABEL_TARGET_TYPES.items() for t in ts)
_LINKS = f"""t AS (SELECT * FROM (VALUES {_TARGETS}) AS v(label, entry_type)), ms AS (SELECT annotation_id AS i, s.r AS r, s.l AS label, s.t AS text, {_COLLAPSE(_NORM('s.t'))} AS k FROM {_LATEST}),
    e AS (SELECT DISTINCT entry_id, entry_type, coalesce(onetsoc_code, '') AS code, {_COLLAPSE(_NORM('n'))} AS k FROM (SELECT *, unnest(list_concat([title], coalesce(aliases, []))) AS n FROM onet_entries)),
    l AS (SELECT r, i, min(entry_id) AS entry_id, arg_min(code, entry_id) AS code, any_value(label) AS label, any_value(CASE WHEN text = lower(text) THEN 1.0 ELSE 0.75 END) AS score FROM ms JOIN t USING (label) JOIN e USING (entry_type, k) WHERE k <> '' GROUP BY 1, 2),
    j AS (SELECT ms.r, ms.i, upper(ms.label) AS label, upper(ms.label) IN (SELECT label FROM t) AS ok, l.entry_id, l.code, l.score FROM ms LEFT JOIN l ON l.i = ms.i AND l.r = ms.r)"""
_RATE = "count(*) AS entities, cast(sum(ok::int) AS bigint) AS supported, count(entry_id) AS mapped, round(count(entry_id) / greatest(sum(ok::int), 1), 6) AS mapped_rate, round(coalesce(avg(score), 0.0), 6) AS average"
_KEY = _COLLAPSE("record_id")

SQL = {
    "annotation_documents": "SELECT coalesce(nullif(trim(doc_type), ''), 'unknown') AS document_type, count(*) AS n, cast(sum(length(text)) AS bigint) AS chars FROM documents WHERE trim(coalesce(record_id, '')) <> '' AND trim(coalesce(text, '')) <> '' GROUP BY 1",
    "exact_mapping_summary": f"WITH {_LINKS} SELECT coalesce(label, 'all') AS label, {_RATE} FROM j GROUP BY ROLLUP (label)",
    "record_mapping_summary": f"WITH {_LINKS} SELECT r AS record_id, {_RATE} FROM j GROUP BY 1",
    "record_codes": f"""WITH {_LINKS}, n AS (SELECT r, code, count(*) AS n, min(i) AS i, min(i) FILTER (label = 'JOB_ROLE') AS role FROM j WHERE code <> '' GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY n DESC, i, code) AS p FROM n)
        SELECT r AS record_id, coalesce(string_agg(code, ',' ORDER BY p) FILTER (p <= 5), '') AS top_codes, coalesce(string_agg(code, ',' ORDER BY role, code) FILTER (role IS NOT NULL), '') AS role_codes FROM k GROUP BY 1""",
    "record_label_counts": f"WITH {_LINKS} SELECT r AS record_id, label, count(*) AS entities, cast(sum(ok::int) AS bigint) AS supported, count(entry_id) AS mapped FROM j GROUP BY 1, 2",
    "record_mappings": f"WITH {_LINKS} SELECT r AS record_id, i AS mention_id, label AS entity_label, ok AS supported, (SELECT count(*) FROM t WHERE t.label = j.label) AS types, coalesce(entry_id, '') AS entry_id FROM j",
    "response_texts": f"""WITH o AS (SELECT custom_id, arg_max({{'s': status_code, 'f': finish_reason, 'c': content}}, {{'a': received_at, 'c': content}}) AS o FROM batch_outputs WHERE custom_id IS NOT NULL GROUP BY 1),
        e AS (SELECT custom_id, {_strip("coalesce(o.c, '')")} AS t, CASE WHEN coalesce(o.s, 0) <> 200 THEN 'status ' || coalesce(cast(o.s AS varchar), 'missing') WHEN lower({_strip("coalesce(o.f, '')")}) NOT IN ('', 'stop') THEN 'finish reason ' || lower({_strip("coalesce(o.f, '')")}) WHEN {_strip("coalesce(o.c, '')")} = '' THEN 'empty content' ELSE '' END AS error FROM o)
        SELECT custom_id, md5(CASE WHEN error = '' THEN t ELSE '' END) AS digest, error FROM e""",
    "candidate_texts": f"WITH e AS (SELECT doc_id, {_strip('text')} AS t, CASE WHEN doc_type IS DISTINCT FROM 'cv' AND doc_id % 3 = 0 THEN 'finish reason SAFETY' WHEN {_strip('text')} = '' THEN 'empty content' ELSE '' END AS error FROM documents WHERE text IS NOT NULL) SELECT doc_id, md5(CASE WHEN error = '' THEN t ELSE '' END) AS digest, error FROM e",
    "api_errors": "SELECT * FROM (VALUES " + ", ".join(f"({i}::bigint, {-1.0 if e[2] is None else e[2]}::double, {e[3]}, {e[4]}, {e[5]}, {e[6]})" for i, e in enumerate(_ERRORS)) + ") AS v(id, wait, key_invalid, quota_exhausted, rate_limited, transient)",
    "gold_candidates": """WITH w AS (SELECT doc_id, list_filter(string_split(lower(position_title), ' '), lambda x: x <> '') AS w FROM documents WHERE position_title IS NOT NULL),
        r AS (SELECT doc_id, w, i, j FROM w, unnest(generate_series(1, len(w))) AS g(i), unnest(generate_series(i, least(i + 2, len(w)))) AS h(j))
        SELECT doc_id, count(*) AS n, cast(sum((i = j AND w[i] IN ('engineer', 'manager', 'analyst', 'developer'))::int) AS bigint) AS gold, cast(sum(j - i + 1) AS bigint) AS width FROM r GROUP BY 1""",
    "manifest_gaps": f"""WITH d AS (SELECT DISTINCT {_KEY} AS r FROM documents WHERE record_id IS NOT NULL), m AS (SELECT DISTINCT lower(split_part(feature_id, '::chunk-', 1)) AS r, chunk_index % 3 AS s FROM chunk_records)
        SELECT DISTINCT r AS record_id, 'missing' AS gap FROM m WHERE r NOT IN (SELECT r FROM d) UNION ALL SELECT r, 'unassigned' FROM d WHERE r NOT IN (SELECT r FROM m WHERE r IS NOT NULL) UNION ALL SELECT r, 'repeated' FROM m GROUP BY r HAVING count(*) > 1""",
    "changed_models": "SELECT custom_id, count(*) AS n, cast(sum((chunk_index % 2 = 0)::int) AS bigint) AS changed, 'new' AS model, max(md5(text)) AS digest FROM chunk_records WHERE custom_id IS NOT NULL AND text IS NOT NULL GROUP BY 1",
    "weak_stats": f"""WITH d AS (SELECT {_KEY} AS r, arg_min(coalesce(doc_type, 'unknown'), doc_id) AS k FROM documents WHERE record_id IS NOT NULL GROUP BY 1), s AS (SELECT {_KEY} AS r, count(*) AS n FROM span_annotations WHERE record_id IS NOT NULL GROUP BY 1)
        SELECT coalesce(k, 'all') AS doc_type, count(*) AS documents, count(n) AS documents_with_entities, cast(coalesce(sum(n), 0) AS bigint) AS spans FROM d LEFT JOIN s USING (r) GROUP BY ROLLUP (k)""",
    "first_met_keywords": "SELECT primary_keyword, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, min(doc_id) LIMIT 15",
    "seed_lengths": """WITH x AS (SELECT doc_type, length(text) AS n, CASE WHEN doc_type = 'cv' THEN CASE WHEN length(text) < 400 THEN 'short' WHEN length(text) < 900 THEN 'medium' WHEN length(text) < 1800 THEN 'long' ELSE 'xlong' END
        ELSE CASE WHEN length(text) < 1000 THEN 'short' WHEN length(text) < 1800 THEN 'medium' WHEN length(text) < 3000 THEN 'long' ELSE 'xlong' END END AS b FROM documents WHERE text IS NOT NULL)
        SELECT doc_type, b AS key, count(*)::double AS value FROM x GROUP BY 1, 2 UNION ALL SELECT doc_type, 'mean length', round(avg(n), 4) FROM x GROUP BY 1""",
}
