"""Registered queries on small tables of which no row may be left out."""

from datetime import datetime

from pyspark.sql import functions as F

from lanternspan.functions import lexicon as lx
from lanternspan.plans import core


def save(rows, schema, name, spark, d):
    spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")


def test_candidate_ngrams_of_long_documents(spark, tmp_path):
    texts = {1: "a b c", 2: " ".join(["w"] * 401), 3: "x\n" * 1000, 4: "", 5: None}
    save(list(texts.items()), "doc_id bigint, text string", "documents", spark, tmp_path)
    want = {}
    for k, t in texts.items():
        n = len((t or "").split())
        w = [b - a + 1 for a in range(n) for b in range(a, min(a + 4, n))]
        if w:
            want[k] = (len(w), sum(w))
    assert {r.doc_id: (r.spans, r.width) for r in core.candidate_ngrams(spark, str(tmp_path)).collect()} == want


def test_negative_sample_counts_tokens_and_takes_annotated_spans(spark, tmp_path):
    at, words = datetime(2024, 1, 1), "w" * 5 + " x" * 200
    long = words + ", C++ and Node.js."
    doc = "We use Python 3.7, SQL."
    save([(1, " R1 ", doc), (2, "r2", long)], "doc_id bigint, record_id string, text string", "documents", spark, tmp_path)
    chunks = [("r1::chunk-0", None, 0, 0, doc, at), ("r1::chunk-0", "r1", 0, 0, doc, at), ("r2::chunk-0", "r2", 0, 0, long, at), ("r3::chunk-0::sub-0", "r3", 0, 0, "a" * 90, at)]
    save(chunks, "feature_id string, record_id string, chunk_index int, chunk_start bigint, text string, ingested_at timestamp", "chunk_records", spark, tmp_path)
    marks = [(1, "r1", "TECHNOLOGY", 7, 17, "Python 3.7"), (2, None, "TECHNOLOGY", 16, 19, "SQL"), (3, "r2", "SKILL", long.index("C++"), long.index("C++") + 3, "C++"), (4, "r2", "SKILL", 0, 2, "ww"), (5, "r1", "SKILL", 0, 6, "absent")]
    save([(i, r, "r1::chunk-0", lab, a, b, t, at) for i, r, lab, a, b, t in marks], "annotation_id bigint, record_id string, feature_id string, label string, span_start bigint, span_end bigint, text string, annotated_at timestamp", "span_annotations", spark, tmp_path)
    runs = core._candidates(spark, str(tmp_path)).cache()
    assert {r.feature_id: r.n for r in runs.groupBy("feature_id").agg(F.max("end_token").alias("n")).collect()} == {"r1::chunk-0": 6, "r2::chunk-0": 205, "r3::chunk-0::sub-0": 0}
    got = {(r.feature_id, r.start_token, r.end_token, r.label_id) for r in runs.where("label_id <> 0").collect()}
    assert got == {("r1::chunk-0", 2, 3, 2), ("r1::chunk-0", 5, 5, 2), ("r2::chunk-0", 202, 202, 1)}
    assert {r.feature_id: (r.n, r.labelled) for r in core.negative_sample(spark, str(tmp_path)).collect()} == {"r1::chunk-0": (10, 2), "r2::chunk-0": (9, 1), "r3::chunk-0::sub-0": (1, 0)}


def test_offset_repair_of_short_spans_and_industries(spark, tmp_path):
    at, doc = datetime(2024, 1, 1), "C# and SQL for hotel groups, SQL again"
    save([(1, "R1", doc)], "doc_id bigint, record_id string, text string", "documents", spark, tmp_path)
    marks = [(1, "TECHNOLOGY", 27, 30, "SQL"), (2, "TECHNOLOGY", 1, 3, "C#"), (3, "INDUSTRY", 16, 28, "hotel groups"), (4, None, 15, 27, "hotel groups")]
    save([(i, "r1", lab, a, b, t, at) for i, lab, a, b, t in marks], "annotation_id bigint, record_id string, label string, span_start bigint, span_end bigint, text string, annotated_at timestamp", "span_annotations", spark, tmp_path)
    assert {r.annotation_id: r.start for r in core.offset_repair(spark, str(tmp_path)).collect()} == {1: 29, 2: 0, 3: 15, 4: 15}


def test_refine_spans_takes_all_labels_and_prefixes(spark, tmp_path):
    rows = [("JOB_ROLE", "Data Engineer"), ("JOB_ROLE", "strong Data Engineer"), ("TECHNOLOGY", "experience with Python"), ("TECHNOLOGY", "Knowledge of SQL"), ("SKILL", "strong negotiation"), ("ABILITY", "x")]
    rows = [(i, "r", lab, t, 0, len(t), None) for i, (lab, t) in enumerate(rows)]
    save(rows, "annotation_id bigint, record_id string, label string, text string, span_start bigint, span_end bigint, normalized string", "span_annotations", spark, tmp_path)
    assert {r.label: (r.n, r.trimmed) for r in core.refine_spans(spark, str(tmp_path)).collect()} == {"JOB_ROLE": (2, 1), "TECHNOLOGY": (2, 2), "SKILL": (1, 1)}


def test_weak_label_counts_uses_the_whole_lexicons(spark, tmp_path):
    text = f"{lx.SKILL_TERMS[0]}; {lx.TECHNOLOGY_TERMS[0]}; {lx.INDUSTRY_TERMS[0]}; {lx.PROJECT_TYPE_TERMS[0]}; Technical Writer"
    save([(1, text, None, None)], "doc_id bigint, text string, position_title string, primary_keyword string", "documents", spark, tmp_path)
    got = {r.label for r in core.weak_label_counts(spark, str(tmp_path)).collect()}
    assert {"SKILL", "TECHNOLOGY", "INDUSTRY", "PROJECT_TYPE", "JOB_ROLE"} <= got
