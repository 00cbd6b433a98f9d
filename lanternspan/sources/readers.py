"""Scans: CSV, JSON lines, JSON with an envelope, delimited files with a sniffed separator, taxonomy directories."""

from __future__ import annotations

import csv
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..operators.taxonomy import ENTRY


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A table with a partition or more for each core: small files with few row groups would leave most cores idle."""
    d, cores = spark.read.parquet(path), spark.sparkContext.defaultParallelism
    return d.repartition(2 * cores) if d.rdd.getNumPartitions() < cores else d


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header, all columns text, quoted line breaks kept."""
    return spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("encoding", "UTF-8").csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One object per line; blank lines are skipped, any other line that isn't an object, an array too, fails the read."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    sound = F.when(F.trim("value").startswith("{"), F.col("value")).otherwise(F.raise_error(F.lit("a line isn't a JSON object")).cast("string"))
    if schema is None:
        schema = spark.read.option("mode", "FAILFAST").json(lines.select("value").rdd.map(lambda r: r[0])).schema
    parsed = F.from_json(sound, schema if isinstance(schema, str) else schema.json(), {"mode": "FAILFAST"})
    return lines.select(parsed.alias("r")).select("r.*")


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path) if path.lower().endswith(".csv") else read_jsonl(spark, path)


def read_enveloped(spark: SparkSession, path: str, keys=("data", "items", "records")) -> DataFrame:
    """Rows of a JSON list, or of the first list under one of the keys; items that aren't objects are left out."""
    v = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    lists = [F.expr(f"try_variant_get(v, '$', 'array<variant>')"), *(F.expr(f"try_variant_get(v, '$.{k}', 'array<variant>')") for k in keys)]  # noqa: F541
    rows = v.select(F.explode(F.coalesce(*lists)).alias("row"))
    return rows.where(F.schema_of_variant("row").startswith("OBJECT")).select(F.to_json("row").alias("json"))


def resolve_column(columns: list[str], explicit: str | None, candidates=()) -> str | None:
    """The named column, exactly or without regard to case (else an error); without a name the first candidate there is."""
    lower = {c.lower(): c for c in columns}
    if explicit:
        found = explicit if explicit in columns else lower.get(explicit.lower())
        if found is None:
            raise ValueError(f"there is no column {explicit}")
        return found
    return next((lower[c] for c in candidates if c in lower), None)


def text_columns(columns: list[str], spec: str | None = None, one: str | None = None, kind: str = "auto") -> list[tuple[str, str]]:
    """(column, document type) of the texts to read; spec: "cv:resume,jd:job_text" or plain names."""
    if spec:
        out = []
        for item in filter(None, (s.strip() for s in spec.split(","))):
            head, _, tail = item.partition(":")
            typed = tail and head.strip().lower() in ("cv", "jd")
            out.append((resolve_column(columns, tail.strip() if typed else item), head.strip().lower() if typed else "auto"))
        if not out:
            raise ValueError("no text columns are named")
        return out
    found = resolve_column(columns, one, lx.TEXT_COLUMN_CANDIDATES)
    if not found:
        raise ValueError("no text column is found; name one")
    return [(found, kind)]


def unpivot_texts(df: DataFrame, specs: list[tuple[str, str]], keep: list[str]) -> DataFrame:
    """A row for each non-empty text column: the kept columns, source_column, type_hint and text."""
    parts = F.array(*(F.struct(F.lit(c).alias("source_column"), F.lit(k).alias("type_hint"), F.col(f"`{c}`").cast("string").alias("text")) for c, k in specs))
    return df.select(*keep, F.inline(parts)).where(F.trim("text") != "")


def sniff_separator(sample: str, fallback: str = "\t") -> str:
    try:
        return csv.Sniffer().sniff(sample, delimiters="\t,;").delimiter
    except csv.Error:
        return fallback


def read_delimited(spark: SparkSession, path: str, pos: str = "pos") -> DataFrame:
    """A delimited file whose separator is sniffed from its first 8192 characters, with the number of each row."""
    head = "\n".join(r["value"] for r in spark.read.text(path).limit(50).collect())[:8192].lstrip("\ufeff")
    sep = sniff_separator(head, "\t" if path.endswith(".txt") else ",")
    d = spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    return d.select("*", F.monotonically_increasing_id().alias(pos))  # taken at the scan, before any shuffle


def list_files(spark: SparkSession, directory: str) -> list[str]:
    """The files of a folder in any file system that Spark reads."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(directory)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(str(s.getPath()) for s in fs.listStatus(path) if s.isFile()) if fs.exists(path) else []


def taxonomy_files(directory: str, aliases=lx.FILE_ALIASES, spark: SparkSession | None = None) -> dict[str, str]:
    """Table name -> file, by the file's name without case and signs; the table of occupations is needed."""
    canon = lambda s: "".join(c for c in s.lower() if c.isascii() and c.isalnum())
    found = list_files(spark, directory) if spark else sorted(str(p) for p in Path(directory).iterdir() if p.is_file())
    files = {canon(p.rsplit("/", 1)[-1].rsplit(".", 1)[0]): p for p in found}
    out = {name: files[canon(a)] for name, al in aliases.items() for a in (al if isinstance(al, tuple) else (al,)) if canon(a) in files}
    if "occupation_data" not in out:
        raise FileNotFoundError(f"{directory} holds no table of occupations")
    return out


def read_taxonomy(spark: SparkSession, directory: str) -> dict[str, DataFrame]:
    return {name: read_delimited(spark, path) for name, path in taxonomy_files(directory, spark=spark).items()}


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """A written index of entries; missing fields get their defaults."""
    d = spark.read.schema(ENTRY).json(path)
    return d.na.fill("").na.fill(False).withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("aliases", "alias_normalized")})


def require_readable(spark: SparkSession, path: str) -> None:
    """An error for a missing path, which names up to twenty files of the kind beside it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        beside = [x.rsplit("/", 1)[-1] for x in list_files(spark, path.rsplit("/", 1)[0] or ".") if x.endswith(".jsonl")]
        raise FileNotFoundError(f"{path} doesn't exist; beside it are {beside[:20]}")


def row_count(spark: SparkSession, path: str) -> int:
    """Rows of a parquet table, from the footers of its files."""
    return spark.read.parquet(path).count()


SPANS = "array<struct<label:string,start:int,end:int,text:string,normalized:string>>"


def typed_documents(df: DataFrame, most: int | None = None) -> DataFrame:
    """(record_id, document_type, text, entities) of annotation rows: without those that lack an id or text; the type is
    document_type, else doc_type, else unknown. With `most` the first so many by record_id."""
    has = lambda c: F.nullif(F.btrim(F.col(c).cast("string")), F.lit("")) if c in df.columns else F.lit(None).cast("string")
    spans = F.col("entities") if "entities" in df.columns else F.lit(None).cast(SPANS)
    d = df.select(has("record_id").alias("record_id"), F.coalesce(has("document_type"), has("doc_type"), F.lit("unknown")).alias("document_type"), F.col("text"), spans.alias("entities"))
    d = d.where(F.col("record_id").isNotNull() & (F.btrim(F.coalesce("text", F.lit(""))) != ""))
    return d if most is None else d.orderBy("record_id").limit(most)


def read_annotations(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    require_readable(spark, path)
    return typed_documents(spark.read.schema(f"record_id string, document_type string, doc_type string, text string, entities {SPANS}").json(path), most)


CHUNK = "custom_id string, record_id string, document_type string, chunk_index int, chunk_start int, chunk_text string, shard_id int"


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunk rows of a batch's folder."""
    return spark.read.schema(CHUNK).json(path)


def shard_records(chunks: DataFrame, shard: int) -> DataFrame:
    """The distinct record ids of one shard."""
    return chunks.where((F.col("shard_id") == shard) & (F.coalesce("record_id", F.lit("")) != "")).select("record_id").distinct()


def read_json(spark: SparkSession, path: str, default=None):
    """A small JSON document, or the default where there is none."""
    import json

    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        if default is None:
            raise FileNotFoundError(path)
        return default
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def read_label_map(spark: SparkSession, path: str) -> dict[str, str]:
    """A JSON object of labels; anything else is an error."""
    found = read_json(spark, path)
    if not isinstance(found, dict):
        raise ValueError(f"{path} must hold a JSON object")
    return {str(k): str(v) for k, v in found.items()}


def read_split_manifest(spark: SparkSession, path: str, splits=("train", "dev", "test"), id: str = "record_id") -> DataFrame:
    """(split, id) of a JSON document {split: [ids]} or of a folder of written splits; each split needs an id."""
    if list_files(spark, path) and path.endswith(".json"):
        m = spark.read.schema(", ".join(f"{s} array<string>" for s in splits)).json(path, multiLine=True)
        d = m.select(F.inline(F.flatten(F.array(*(F.transform(F.coalesce(s, F.array().cast("array<string>")), lambda x, s=s: F.struct(F.lit(s).alias("split"), F.btrim(x).alias(id))) for s in splits)))))
    else:
        d = spark.read.schema(f"{id} string, split string").json(path)
    return checked_manifest(d.where(F.coalesce(id, F.lit("")) != "").distinct(), splits)


def checked_manifest(d: DataFrame, splits=("train", "dev", "test")) -> DataFrame:
    """The (split, id) rows; a split without any is an error."""
    have = {r["split"] for r in d.select("split").distinct().limit(100).collect()}
    if lacking := [s for s in splits if s not in have]:
        raise ValueError(f"the manifest has no record ids for {lacking}")
    return d


def processed_ids(spark: SparkSession, path: str, id: str = "record_id") -> DataFrame:
    """Distinct ids of an output that may not exist yet."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(f"{id} string").json(path).where(F.col(id).isNotNull()).distinct()
    except AnalysisException:
        return spark.createDataFrame([], f"{id} string")
