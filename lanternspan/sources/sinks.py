"""Sinks: JSON lines, error rows beside them, outputs by type, summaries and split manifests."""

from __future__ import annotations

import json
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """mode: append, overwrite, or errorifexists, which guards what is there."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def error_path(path: str) -> str:
    p = Path(path)
    return str(p.with_name(f"{p.stem}.errors.jsonl"))


def write_with_errors(rows: DataFrame, errors: DataFrame, path: str, mode: str = "append") -> None:
    write_jsonl(rows, path, mode)
    write_jsonl(errors, error_path(path), mode)


def write_by_type(df: DataFrame, path: str, by: str = "doc_type", mode: str = "errorifexists") -> None:
    """A folder for each value of `by`, the combined rows, and the number of rows of each. The combined rows are read back
    from the folders, so the input is computed once."""
    df.write.mode(mode).partitionBy(by).json(f"{path}/by_type")
    back = df.sparkSession.read.schema(df.schema).json(f"{path}/by_type")
    write_jsonl(back.select(df.columns), f"{path}/combined", mode)
    write_summary(back.groupBy(by).agg(F.count("*").alias("rows")), f"{path}/stats.json")


def write_shards(requests: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Request lines by shard_id; one shard's lines come from one task."""
    requests.repartition("shard_id").sortWithinPartitions("shard_id", "custom_id").select("shard_id", F.col("request").alias("value")).write.mode(mode).partitionBy("shard_id").text(path)


def write_index(entries: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The entries, and beside them <path>.summary.json with their number by type."""
    entries.write.mode(mode).option("ignoreNullFields", False).json(path)
    write_summary(entries.groupBy("entry_type").agg(F.count("*").alias("entries")), f"{path}.summary.json")


def write_summary(row: DataFrame, path: str) -> None:
    """An aggregated result as one JSON document in any file system that Spark writes."""
    write_document(row.sparkSession, [r.asDict(recursive=True) for r in row.collect()], path)


def write_document(spark: SparkSession, value, path: str) -> None:
    """A small JSON document, written beside its place and moved there."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".part")
    fs = p.getFileSystem(conf)
    out = fs.create(part, True)
    out.write(bytearray(json.dumps(value, ensure_ascii=False, indent=2, default=str).encode()))
    out.close()
    fs.delete(p, False)
    fs.rename(part, p)


def rewrite(df: DataFrame, path: str) -> None:
    """JSON lines that replace those of `path`, which df may read: written beside it, then moved in its place."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p, new, old = (jvm.org.apache.hadoop.fs.Path(path + s) for s in ("", ".new", ".old"))
    write_jsonl(df, path + ".new", "overwrite")
    fs = p.getFileSystem(conf)
    fs.delete(old, True)
    if fs.exists(p):
        fs.rename(p, old)
    fs.rename(new, p)
    fs.delete(old, True)


class Workdir:
    """Places of a labelling batch: manifest, jobs, records, and by shard requests, chunks and outputs."""

    def __init__(self, root: str):
        self.root = root.rstrip("/")
        self.manifest, self.jobs, self.records = (f"{self.root}/{n}" for n in ("manifest.json", "jobs.json", "records"))
        self.requests, self.chunks, self.outputs = (f"{self.root}/{n}" for n in ("requests", "chunks", "outputs"))


def write_batch(prepared: DataFrame, records: DataFrame, shards: DataFrame, root: str, model: str, mode: str = "errorifexists") -> dict:
    """Requests and chunks by shard, record rows, and a manifest of the shards. prepared: rows of annotate.prepare;
    shards: (record_id, shard_id)."""
    w, spark = Workdir(root), prepared.sparkSession
    d = prepared.join(shards, "record_id").persist()
    try:
        write_shards(d, w.requests, mode)
        cols = [c for c in ("custom_id", "record_id", "document_type", "chunk_index", "chunk_start", "chunk_text", "shard_id") if c in d.columns]
        d.select(*cols).write.mode(mode).json(w.chunks)
        write_jsonl(records, w.records, mode)
        n = d.groupBy("shard_id").agg(F.countDistinct("record_id").alias("records"), F.count("*").alias("requests"), F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens")).orderBy("shard_id")
        found = {"model": model, "created_at": utc_now(), "shards": [r.asDict() for r in n.collect()]}  # a row per shard
    finally:
        d.unpersist()
    write_document(spark, found, w.manifest)
    return found


def dump_responses(raw: DataFrame, path: str, body: str = "body", mode: str = "append") -> None:
    """Raw bodies by record and chunk; ids become names of files without other signs than letters, digits, _ . and -."""
    safe = F.regexp_replace(F.col("record_id"), "[^A-Za-z0-9_.-]+", "_")
    raw.select(safe.alias("record"), F.col("chunk_index").alias("chunk"), F.col(body).alias("value")).write.mode(mode).partitionBy("record", "chunk").text(path)


def utc_now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="seconds")


def split_manifest(splits: DataFrame, path: str, id: str = "record_id", mode: str = "errorifexists") -> None:
    """(split, id) rows in a folder for each split."""
    splits.select("split", id).write.mode(mode).partitionBy("split").json(path)
