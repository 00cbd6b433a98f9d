"""Linking by aliases, repeats, answers of services, requests, features, manifests, and writing to shared folders."""

import json

import pytest
from pyspark.sql import functions as F

from lanternspan.operators import annotate as an
from lanternspan.operators import features as ft
from lanternspan.operators import link, responses, seed
from lanternspan.operators.taxonomy import ENTRY
from lanternspan.sources import readers, sinks

SPANS = "array<struct<label:string,start:int,end:int,text:string>>"


def entries(spark):
    row = lambda i, title, aliases: (i, "technology_skill", title, title.lower(), aliases, [a.lower() for a in aliases], "15-1", "", "", "", None, None, "", "", False, False)
    return spark.createDataFrame([row("t1", "Amazon Elastic Compute Cloud", ["EC2", "Management software"]), row("t2", "Quillbase", [])], ENTRY)


def test_mentions_that_only_an_alias_has_are_linked(spark):
    m = spark.createDataFrame([("r", 1, "TECHNOLOGY", "EC2"), ("r", 2, "TECHNOLOGY", "management software"), ("r", 3, "TECHNOLOGY", "quilbase"), ("s", 4, "OTHER", "x")], "record_id string, mention_id bigint, label string, text string")
    got = link.link(m, entries(spark))
    assert {(r.mention_id, r.entry_id) for r in got.where("rank = 1").collect()} == {(1, "t1"), (2, "t1"), (3, "t2")}
    s = {r.record_id: (r.mapped, r.average_best_score) for r in link.mapping_summary(m, got, by_record=True).collect()}
    assert s["s"] == (0, 0.0) and s["r"][0] == 3
    shape = {r.record_id: r.mappings for r in link.record_mappings(m, got).collect()}
    assert [x.entity_index for x in shape["r"]] == [1, 2, 3] and shape["s"][0].candidates == [] and not shape["s"][0].supported
    vectors = lambda texts: [[float("ec2" in t.lower()), 1.0] for t in texts]
    sem = {r.text: round(r.semantic_score, 3) for r in link.semantic_scores(m.select("text", F.lit("t1").alias("entry_id")), entries(spark), vectors).collect()}
    assert sem["EC2"] == 1.0 and sem["x"] == 0.707


@pytest.mark.parametrize("salts", [1, 3, 1024])
def test_repeats_are_marked_behind_the_first(spark, salts):
    rows = [(i, "k" if i % 2 else None if i % 4 else f"u{i}") for i in range(60)]
    d = seed.mark_repeats(spark.createDataFrame(rows, "pos bigint, key string").repartition(5), ["key"], "pos", "again", salts)
    assert {r.pos for r in d.where("again").collect()} == {i for i in range(3, 60, 2)} and d.count() == 60


def test_answers_of_services(spark):
    ask = lambda f, rows: [(r.text, r.error) for r in f(spark.createDataFrame([(r,) for r in rows], "body string")).collect()]
    chat = lambda m, **k: json.dumps({"choices": [{"message": m, **k}]})
    parts = [{"type": "text", "text": "a"}, {"type": "image", "text": "z"}, 3, {"type": "text", "text": "b "}]
    got = ask(responses.message_text, [chat({"content": " hi "}, finish_reason="stop"), chat({"content": parts}), chat({"content": "x"}, finish_reason="length"), chat({"refusal": "no"}), '{"choices":[]}', "broken", None])
    assert got == [("hi", None), ("ab", None), (None, "finish reason length"), (None, "refusal: no"), (None, "no choices"), (None, "body is not JSON"), (None, "body is not JSON")]
    calls = []

    def call(text, key):
        calls.append(key)
        raise ValueError(key)

    run = responses.with_retries(call, 2, ("a", "a", "b"), lambda e: "quota" if str(e) == "a" else "transient", lambda s: None)
    assert run("x") is None and calls == ["a", "b", "b"]


def test_models_of_requests_change_by_structure(spark):
    rows = ['{"custom_id":"a","body":{"model":"m1","t":"\\"model\\":\\"m1\\""}}', '{"custom_id":"b","body":{"model":"m2"}}', '{"custom_id":"c","body":{}}']
    got = an.with_model(spark.createDataFrame([(r,) for r in rows], "request string"), "m2").collect()
    assert [r.changed for r in got] == [True, False, True] and [json.loads(r.request)["body"]["model"] for r in got] == ["m2"] * 3
    assert json.loads(got[0].request)["body"]["t"] == '"model":"m1"'
    with pytest.raises(Exception, match="no body object"):
        an.with_model(spark.createDataFrame([('{"body":3}',)], "request string"), "m2").collect()


def test_features_cut_again_and_sample(spark):
    text = ("We use Python and C++ at scale. " * 8).strip()
    rows = [("r1", "cv", text, [("TECHNOLOGY", 7, 13, "Python"), ("SKILL", 3, 5, "us"), ("SKILL", 0, 9999, "?")]), ("r2", None, None, None)]
    d = spark.createDataFrame(rows, f"record_id string, document_type string, text string, entities {SPANS}")
    labels = {"O": 0, "TECHNOLOGY": 1, "SKILL": 2}
    f, stats = ft.build_features(d, labels, max_tokens=40, width=3, least=4, multiplier=2)
    s = stats.first()
    assert (s.documents, s.dropped_unassigned_spans, s.dropped_alignment_spans, s.positive_spans, s.dropped_truncated_chunks) == (1, 1, 1, 1, 0) and s.retokenized_subchunks == 2
    rows = f.collect()
    assert {r.feature_id for r in rows} == {"r1::chunk-0::sub-0", "r1::chunk-0::sub-1"} and all(len(r.labels) <= 1 + 4 for r in rows)
    whole, _ = ft.build_features(d, labels, analysis=True, width=2)
    r = whole.first()
    assert r.texts[:3] == ["We", "We use", "use"] and [text[a:b] for a, b in zip(r.char_starts, r.char_ends)] == r.texts
    assert ft.build_features(d.limit(0), labels)[1].first().documents == 0


def test_manifests_must_fit(spark, tmp_path):
    docs = spark.createDataFrame([("a",), ("b",), ("c",)], "record_id string")
    m = lambda rows: spark.createDataFrame(rows, "record_id string, split string")
    assert ft.apply_manifest(docs, m([("a", "train"), ("b", "dev"), ("c", "test")])).count() == 3
    for bad, what in (([("a", "train"), ("b", "dev"), ("x", "test")], "missing"), ([("a", "train")], "unassigned"), ([("a", "train"), ("a", "dev"), ("b", "dev"), ("c", "test")], "repeated")):
        with pytest.raises(ValueError, match=what):
            ft.apply_manifest(docs, m(bad))
    p = tmp_path / "m.json"
    p.write_text(json.dumps({"train": ["a"], "dev": ["b"], "test": []}))
    with pytest.raises(ValueError, match="test"):
        readers.read_split_manifest(spark, str(p))
    assert ft.resume_plan(8, 0) == (1, 8) and ft.resume_plan(8, 3, 2) == (4, 5)
    with pytest.raises(ValueError):
        ft.resume_plan(3, 3)


def test_lines_that_are_no_objects_fail(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": 1}\n\n{"a": 2}\n')
    assert {r.a for r in readers.read_jsonl(spark, str(p)).collect()} == {1, 2}
    p.write_text('{"a": 1}\n[{"a": 2}]\n')
    with pytest.raises(Exception, match="JSON object"):
        readers.read_jsonl(spark, str(p), "a int").collect()
    with pytest.raises(FileNotFoundError, match="x.jsonl"):
        readers.require_readable(spark, f"{tmp_path}/y.jsonl")


def test_a_batch_folder_and_what_it_holds(spark, tmp_path):
    recs = spark.createDataFrame([("r1", "cv", "one two three"), ("r2", "jd", "four")], "record_id string, document_type string, text string")
    p = an.prepare(recs, "m1")
    shards = spark.createDataFrame([("r1", 0), ("r2", 1)], "record_id string, shard_id int")
    found = sinks.write_batch(p, an.record_rows(p, recs, "m1"), shards, f"{tmp_path}/job", "m1")
    assert [(s["shard_id"], s["records"], s["requests"]) for s in found["shards"]] == [(0, 1, 1), (1, 1, 1)]
    assert readers.read_json(spark, f"{tmp_path}/job/manifest.json")["model"] == "m1"
    assert [r.record_id for r in readers.shard_records(readers.read_chunks(spark, f"{tmp_path}/job/chunks"), 1).collect()] == ["r2"]
    rows = spark.read.json(f"{tmp_path}/job/records")
    sinks.rewrite(rows.withColumn("model", F.lit("m2")), f"{tmp_path}/job/records")
    assert {r.model for r in spark.read.json(f"{tmp_path}/job/records").collect()} == {"m2"}


def test_chunks_take_the_spans_they_hold_whole(spark):
    text = " ".join(f"word{i}" for i in range(40))
    spans = [("A", i, i + 6, str(i)) for i in range(0, len(text) - 6, 5)]
    d = spark.createDataFrame([("r", text, spans), ("s", "short", None)], f"record_id string, text string, entities {SPANS}")
    rows = ft.chunks_with_spans(d, 60, 10).where("record_id = 'r'").orderBy("chunk_index").collect()
    bounds = [(r.chunk_start, r.chunk_start + len(r.text)) for r in rows]
    first = {s: next((n for n, (a, b) in enumerate(bounds) if s[1] >= a and s[2] <= b), None) for s in spans}
    assert [[(x.text, x.start) for x in r.spans] for r in rows] == [[(s[3], s[1] - bounds[n][0]) for s in spans if first[s] == n] for n in range(len(rows))]
    assert sum(r.unassigned for r in rows) == sum(n is None for n in first.values())
