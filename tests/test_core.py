"""Core operators on small literal cases, and whole queries against SQL."""

import json

import pytest
from pyspark.sql import functions as F

from lanternspan.functions import text as tx
from lanternspan.operators import annotate as an
from lanternspan.operators import convert, features, ingest, link, metrics, refine, seed, spans, taxonomy, weak
from lanternspan.sources import readers, sinks
from lanternspan.streaming.incremental import run_available


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v"))).first()[0]


def test_clean_text_and_words(spark):
    assert one(spark, "Line 1\r\n\r\n\r\nLine 2â€™s text with   extra\tÂ spaces ", tx.clean_text) == "Line 1\n\nLine 2's text with extra spaces"
    assert one(spark, "Python C# Node.js ASP.NET", tx.count_words) >= 4
    assert one(spark, "cv", lambda c: tx.length_bucket(c, F.lit(300))) == one(spark, "jd", lambda c: tx.length_bucket(c, F.lit(300))) == "short"
    assert one(spark, "jd", lambda c: tx.length_bucket(c, F.lit(2500))) == "long"


@pytest.mark.parametrize("value,want", [("31s", 31.0), ("1500ms", 1.5), ("2m", 120.0), ("later", None)])
def test_retry_seconds(spark, value, want):
    assert one(spark, value, tx.retry_seconds) == want


def test_labels_and_operators(spark):
    assert one(spark, "technologies", tx.entity_label) == "TECHNOLOGY" and one(spark, "salary", tx.entity_label) is None
    assert one(spark, "SKILL: python", tx.foreign_label) == "SKILL" and one(spark, "Occupation", tx.foreign_label) == "JOB_ROLE"
    assert one(spark, "weird-token", lambda c: tx.fact_operator(c, F.lit("EXPERIENCE_YEARS"), F.lit(False))) == "="
    assert one(spark, "at least 3", lambda c: tx.fact_operator(c, F.lit("DEGREE"), F.lit(True))) == ">="
    assert one(spark, "resume", lambda c: tx.infer_doc_type(c, "job_description", "auto")) == "cv"
    assert one(spark, "", lambda c: tx.infer_doc_type(c, "job_description", "auto")) == "jd"


def test_chunks_are_ordered_and_exact():
    t = "\n\n".join(f"Paragraph {i} about things." for i in range(20))
    c = spans.chunk_bounds(t, 60, 10)
    assert len(c) > 1 and all(b > a for a, b in c) and [a for a, _ in c] == sorted(a for a, _ in c) and c[-1][1] == len(t)
    assert spans.chunk_bounds("x" * 25, 10, 3)[1] == (7, 17) and spans.chunk_bounds("x" * 10, 10, 3) == [(0, 10)]
    with pytest.raises(ValueError):
        spans.chunk_bounds("x", 0, 0)


@pytest.mark.parametrize("text,span,start,end,want", [("Python, SQL, and Python again", "Python", 18, 24, 17), ("aaaa", "aa", 1, 9, 0), ("a\\Eb a\\Eb", "a\\Eb", 4, 8, 5), ("abc", "x", 0, 1, None), ("a.c abc", "abc", None, None, 4), ("abc", "", 0, 0, None)])
def test_offset_repair(spark, text, span, start, end, want):
    d = spark.createDataFrame([(text, span, start, end)], "t string, s string, a int, b int")
    assert d.select(spans.repaired_start(F.col("t"), F.col("s"), F.col("a"), F.col("b"))).first()[0] == want


def test_weak_spans(spark):
    text = "Technical Writer and leadership.\nBachelor's degree in Computer Science\n- Built the payment pipeline for shops"
    rows = [("r1", "cv", text, "Lead", "Support"), ("r2", "cv", None, None, None), ("r3", "cv", "Spring Boot", "Blockchain/Web3 marketer, Technical writer", ".NET")]
    d = spark.createDataFrame(rows, "record_id string, doc_type string, text string, position string, primary_keyword string")
    got = {(r.record_id, r.label, r.text) for r in weak.weak_spans(d).collect()}
    assert ("r1", "DEGREE", "Bachelor's degree in Computer Science") in got
    assert not any(r == "r2" for r, _, _ in got)
    roles = d.where("record_id = 'r3'").select(weak.own_roles(F.col("position"), F.col("primary_keyword"))).first()[0]
    assert "Technical writer" in roles and not any("/" in x for x in roles)
    assert weak.doccano_rows(d, weak.weak_spans(d)).count() == 3


def test_prune_and_refine(spark):
    s = spark.createDataFrame([("r", "JOB_ROLE", 0, 4, "lead"), ("r", "JOB_ROLE", 5, 30, "Blockchain, Technical writer"), ("r", "JOB_ROLE", 14, 30, "Technical writer"), ("r", "DEGREE", 40, 60, "master of the team")], "record_id string, label string, start int, end int, text string")
    assert {r.text for r in spans.prune(s).collect()} == {"Technical writer"}
    rows = [("SKILL", "intermediate"), ("ABILITY", "x"), ("SKILL", "communication skills"), ("SKILL", "agile mindset"), ("WORK_ACTIVITY", "build ETL pipelines"), ("WORK_ACTIVITY", "support"), ("INDUSTRY", "fintech"), ("CERTIFICATION", "training course"), ("SKILL", "communication skills"), ("ABILITY", "")]
    e = spark.createDataFrame([("r", i, lab, t, 0, len(t), t) for i, (lab, t) in enumerate(rows)], "record_id string, pos int, label string, text string, start int, end int, normalized string")
    assert sorted(r.text for r in refine.refine(e).collect()) == ["", "build ETL pipelines", "communication skills", "fintech"]
    t = spark.createDataFrame([("strong knowledge of SQL", 3, 26, "strong knowledge of sql")], "text string, start int, end int, normalized string")
    r = refine.trim_span(t, prefixes=("strong ", "knowledge of ")).first()
    assert (r.text, r.start, r.end, r.normalized) == ("SQL", 23, 26, "sql")


def test_foreign_rows(spark):
    d = spark.createDataFrame([("abc", "python sql dev", '[[0, 6, "Skills"], [7, 10, "ABILITY"], [0, 99, "SKILL"], [1, "x"]]', '[{"start": 11, "end": 14, "tag": "Occupation"}]'), ("e", "t", None, "oops")], "record_id string, text string, labels string, annotations string")
    got = {(r.label, r.text) for r in convert.foreign_spans(d, {"Skills": "TECHNOLOGY"}).collect()}
    assert got == {("TECHNOLOGY", "python"), ("JOB_ROLE", "dev")}


def test_annotate_and_merge(spark):
    text = "We need a Backend Developer who knows Python. " * 3
    rec = spark.createDataFrame([("a", "jd", text), ("b", "jd", "plain words"), ("c", "jd", "broken")], "record_id string, document_type string, text string")

    def answer(texts):
        for t in texts:
            yield None if t == "broken" else "```json\n" + json.dumps({"document_language": "English", "is_it_document": True, "summary": "s", "entities": [{"label": "job role", "text": "Backend Developer", "start": 1, "end": 2}]}) + "\n```"

    ok, bad = an.annotate(rec, answer, size=60, overlap=10)
    rows = {r.record_id: r for r in ok.collect()}
    assert set(rows) == {"a", "b"} and [r.record_id for r in bad.collect()] == ["c"]
    assert {text[e.start : e.end] for e in rows["a"].entities} == {"Backend Developer"} and rows["a"].document_language == "en" and rows["a"].summary == "s s"
    assert rows["b"].entities == []


def test_shards_and_retarget(spark):
    r = spark.createDataFrame([(i, 40, 1, 10) for i in range(5)], "pos bigint, bytes bigint, requests bigint, tokens bigint")
    assert [x.shard_id for x in an.pack_shards(r, limits=(100, 9, 999)).orderBy("pos").collect()] == [0, 0, 1, 1, 2]
    p = an.prepare(spark.createDataFrame([("a", "cv", "hello"), ("b", "cv", "world")], "record_id string, document_type string, text string"), "m1")
    assert p.count() == 2 and json.loads(p.first().request)["body"]["model"] == "m1"
    shards = spark.createDataFrame([("a", 0), ("b", 1)], "record_id string, shard_id int")
    _, req = an.retarget(p.select("record_id", F.lit("m1").alias("model")), p.select("record_id", "request"), shards, shards.where("shard_id = 0"), "m2")
    assert {x.record_id: json.loads(x.request)["body"]["model"] for x in req.collect()} == {"a": "m1", "b": "m2"}


def test_taxonomy_and_links(spark, tmp_path):
    files = {
        "Occupation Data.txt": "O*NET-SOC Code\tTitle\tDescription\n15-1\tBackend Developers\tBuild services\n11-2\tOperations Managers\tPlan work\n",
        "Alternate Titles.txt": "O*NET-SOC Code\tAlternate Title\n15-1\tBackend Developer\n99-9\tNobody\n",
        "Skills.txt": "O*NET-SOC Code\tElement ID\tElement Name\tScale ID\tData Value\n15-1\t2.B\tProgramming\tIM\t4.5\n15-1\t2.B\tProgramming\tLV\tx\n",
        "Technology Skills.txt": "O*NET-SOC Code\tCommodity Code\tCommodity Title\tExample\tHot Technology\tIn Demand\n15-1\t43\tTools\tPython\tY\tN\n",
        "Task Statements.txt": "O*NET-SOC Code\tTask ID\tTask\n15-1\t7\tDevelop REST APIs\n",
    }
    for name, t in files.items():
        (tmp_path / name).write_text(t)
    e = taxonomy.index(readers.read_taxonomy(spark, str(tmp_path))).cache()
    assert {r.entry_type: r.entries for r in taxonomy.index_summary(e).collect()} == {"occupation": 2, "alternate_title": 1, "skill": 1, "technology_skill": 1, "task_statement": 1}
    assert e.where("entry_type = 'skill'").select("importance", "level").first()[:] == (4.5, None)
    sinks.write_index(e, str(tmp_path / "index"))
    assert readers.read_index(spark, str(tmp_path / "index")).count() == 6
    m = spark.createDataFrame([("r", 0, "JOB_ROLE", "Backend Developer"), ("r", 1, "TECHNOLOGY", "Python"), ("r", 2, "SKILL", "Programing"), ("r", 3, "INDUSTRY", "Fintech")], "record_id string, mention_id int, label string, text string")
    links = link.link(m, e, 3, 0.2)
    best = {r.mention_id: r for r in links.where("rank = 1").collect()}
    assert best[0].onetsoc_code == "15-1" and best[1].context_boost == pytest.approx(0.11) and best[2].onetsoc_code == "15-1" and 3 not in best
    s = {r.label: (r.entities, r.supported, r.mapped) for r in link.mapping_summary(m, links).collect()}
    assert s[None] == (4, 3, 3) and s["INDUSTRY"] == (1, 0, 0)
    assert link.record_codes(links).first().role_codes == ["15-1"]


@pytest.mark.parametrize("n,want", [(1, {"train": 1}), (2, {"train": 1, "dev": 1}), (3, {"train": 1, "dev": 1, "test": 1}), (10, {"train": 8, "dev": 1, "test": 1})])
def test_stratified_split(spark, n, want):
    d = spark.createDataFrame([(f"r{i}", "cv") for i in range(n)], "record_id string, document_type string")
    assert {r["split"]: r["count"] for r in features.stratified_split(d).groupBy("split").count().collect()} == want


def test_spans_in_chunks_and_tokens(spark):
    c = features.chunk_records(spark.createDataFrame([("d", "0123456789abcdefghij")], "record_id string, text string"), 10, 3)
    s = spark.createDataFrame([("d", 1, 7, 9), ("d", 2, 12, 15), ("d", 3, 0, 20)], "record_id string, span_id int, start int, end int")
    assert [(r.span_id, r.chunk_index) for r in spans.first_holding_chunk(s, c).orderBy("span_id").collect()] == [(1, 0), (2, 1), (3, None)]
    o = spark.createDataFrame([([(0, 0), (0, 4), (5, 11), (12, 15), (0, 0)],)], "o array<struct<start:int,end:int>>")
    f = lambda a, b: o.select(spans.token_span(F.col("o"), F.lit(a), F.lit(b))).first()[0]
    assert tuple(f(5, 11)) == (2, 2) and tuple(f(0, 11)) == (1, 2) and f(1, 11) is None
    cand = spans.candidate_spans(spark.createDataFrame([("f", 5), ("g", 0)], "feature_id string, n_tokens int"), 1).withColumn("label_id", F.when(F.col("start_token").isin(1, 3), 2).otherwise(0))
    kept = features.sample_negatives(cand, 1, 1)
    assert kept.where("label_id = 2").count() == 2 and kept.count() == 4


def test_metrics(spark):
    d = spark.createDataFrame([("A", "A"), ("A", "B"), ("O", "A"), ("B", "O"), ("O", "O")], "gold string, pred string")
    r = metrics.micro(d).first()
    assert (r.tp, r.fp, r.fn) == (1, 2, 2) and metrics.micro(d.limit(0)).first().f1 == 0
    assert {(x.gold, x.pred) for x in metrics.confusion(d, k=1).collect()} == {("A", "B"), ("O", "A"), ("B", "O")}
    q = metrics.confidence(spark.createDataFrame([(1.0,), (2.0,), (None,)], "v double"), "v").first()
    assert (q.median, q.p25, q.n) == (1.5, 1.25, 2)


def test_normalised_rows_and_scans(spark, tmp_path):
    raw = spark.createDataFrame([("abc", "Dev", "Short", "extra", "null"), (None, None, "x" * 90, "extra", None)], "id string, Position string, CV string, Moreinfo string, Highlights string")
    a, b = ingest.normalize(raw, "cv").collect()
    assert a.id == "cv::abc" and a.text == "Position: Dev\n\nCV:\nShort\n\nMore Info:\nextra" and b.id == "" and "extra" not in b.text
    jd = ingest.normalize(raw, "jd")
    assert ingest.union(ingest.normalize(raw, "cv"), jd).count() == 4
    s = spark.createDataFrame([(i, i % 2 == 1) for i in range(10)], "source_offset bigint, ok boolean")
    assert [r.source_offset for r in ingest.scan_until(s, F.col("ok"), 2, start=2).collect()] == [3, 5] and ingest.scan_until(s, F.col("ok"), 9, start=2, budget=2).count() == 1
    (tmp_path / "e.json").write_text(json.dumps({"items": [{"a": 1}, 5, {"a": 2}]}))
    assert readers.read_enveloped(spark, str(tmp_path / "e.json")).count() == 2
    assert readers.text_columns(["Resume_Text", "job"], "cv:resume_text, job") == [("Resume_Text", "cv"), ("job", "auto")]
    with pytest.raises(ValueError):
        readers.resolve_column(["a"], "b")
    assert readers.sniff_separator("a;b\n1;2\n3;4") == ";" and readers.processed_ids(spark, str(tmp_path / "none")).count() == 0


def test_seed_sample(spark):
    rows = [(f"{t}{i}", t, f"{t} text number {i} " + "word " * 40, "en", k, "Dev", i) for t in ("cv", "jd") for i, k in enumerate(("a", "a", "b"))] + [("x", "cv", "Too short", "en", "a", "", 9), ("d", "cv", "cv text number 0 " + "WORD  " * 40, "en", "a", "", 10)]
    d = spark.createDataFrame(rows, "id string, doc_type string, text string, source_language string, primary_keyword string, position string, pos int")
    c = seed.with_drop_reason(d, min_chars=(50, 50), min_words=(8, 8))
    assert {r.drop_reason: r.n for r in seed.drop_counts(c).collect()} == {"kept": 6, "short_or_sparse": 1, "duplicate_text": 1}
    s = seed.seed_subset(c.where("drop_reason is null"), 2, 2).collect()
    assert [r.doc_type for r in s] == ["cv", "cv", "jd", "jd"] and {r.primary_keyword for r in s[:2]} == {"a", "b"}


def test_incremental_run_takes_each_id_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    step = lambda d: (d.where("ok"), d.where("not ok"))
    for n, rows in enumerate(([("a", True), ("b", False)], [("a", True), ("c", True)])):
        (src / f"{n}.json").write_text("\n".join(json.dumps({"record_id": i, "ok": ok}) for i, ok in rows))
        run_available(spark, str(src), "record_id string, ok boolean", step, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.json(str(tmp_path / "out/rows/*"))
    assert sorted(r.record_id for r in got.collect()) == ["a", "c"]


def test_entry_point_lists_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 40
