"""From records to annotation requests and back: chunks, requests, shards, answers, merged records and error rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx
from .spans import chunks, repaired_start

ENTITY = "struct<label:string,text:string,start:string,end:string,normalized:string>"
FACT = "struct<fact_type:string,text:string,start:string,end:string,operator:string,value:string,unit:string,normalized:string,is_mandatory:boolean>"
ANSWER = f"document_language string, is_it_document boolean, summary string, entities array<{ENTITY}>, qualification_facts array<{FACT}>"


def prepare(records: DataFrame, model: str, size: int = 12000, overlap: int = 200, system: str = "Label the spans of the document chunk.") -> DataFrame:
    """(record_id, chunk_index, chunk_start, chunk_text, custom_id, request, bytes, tokens) of each chunk of each record."""
    c = chunks(records.where(tx.stringify("text") != ""), "text", size, overlap)
    prompt = F.concat(F.lit("record_id: "), "record_id", F.lit("\ndocument_type: "), F.coalesce("document_type", F.lit("unknown")), F.lit("\nchunk_index: "), F.col("chunk_index").cast("string"), F.lit("\nchunk_start: "), F.col("chunk_start").cast("string"), F.lit("\n\n"), "chunk_text")
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    c = c.withColumn("custom_id", tx.chunk_id(F.col("record_id"), F.col("chunk_index"), F.col("chunk_start")))
    body = F.struct(F.lit(model).alias("model"), F.array(message("system", F.lit(system)), message("user", prompt)).alias("messages"), F.lit(0).alias("temperature"))
    c = c.withColumn("request", F.to_json(F.struct("custom_id", F.lit("POST").alias("method"), body.alias("body"))))
    return c.withColumns({"bytes": (F.octet_length("request") + 1).cast("bigint"), "tokens": tx.estimated_tokens(F.concat("request", F.lit("\n")))})


def pack_shards(records: DataFrame, order: str = "pos", limits=lx.SHARD_LIMITS, bucket: int = 100_000) -> DataFrame:
    """(pos, shard_id): records (pos, bytes, requests, tokens) in order, a new shard where any limit would be passed.

    Next-fit is a fold over the order. It runs in buckets of `bucket` positions, so no task holds more; up to that
    many records the outcome is that of one fold. A record beyond a limit by itself is an error.
    """
    most_bytes, most_requests, most_tokens = limits

    def fold(pdf):
        pdf = pdf.sort_values(order, ignore_index=True)
        shard, b, n, t, out = 0, 0, 0, 0, []
        for x, y, z in zip(pdf["bytes"], pdf["requests"], pdf["tokens"]):
            if x > most_bytes or y > most_requests or z > most_tokens:
                raise ValueError("a record is larger than a shard may be")
            if n and (b + x > most_bytes or n + y > most_requests or t + z > most_tokens):
                shard, b, n, t = shard + 1, 0, 0, 0
            b, n, t = b + x, n + y, t + z
            out.append(shard)
        pdf["local"] = out
        return pdf[[order, "bucket", "bytes", "requests", "tokens", "local"]]

    d = records.select(order, "bytes", "requests", "tokens").withColumn("bucket", F.floor(F.col(order) / bucket).cast("bigint"))
    packed = d.groupBy("bucket").applyInPandas(fold, f"{order} bigint, bucket bigint, bytes bigint, requests bigint, tokens bigint, local bigint")
    per = packed.groupBy("bucket").agg((F.max("local") + 1).alias("n"))
    base = per.withColumn("base", F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).select("bucket", "base")  # a row per bucket
    return packed.join(base, "bucket").select(order, "bytes", "requests", "tokens", (F.col("base") + F.col("local")).alias("shard_id"))


def shard_totals(packed: DataFrame) -> DataFrame:
    return packed.groupBy("shard_id").agg(F.count("*").alias("records"), F.sum("requests").alias("requests"), F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"))


def parse_answers(outputs: DataFrame, id: str = "custom_id", status: str = "status_code", finish: str = "finish_reason", content: str = "content", at: str = "received_at") -> DataFrame:
    """(custom_id, answer, error): of several answers the latest; a failed status, an unfinished answer or JSON that isn't an object is an error."""
    last = outputs.where(F.col(id).isNotNull()).groupBy(id).agg(F.max_by(F.struct(F.col(status).alias("status"), F.col(finish).alias("finish"), F.col(content).alias("content")), F.struct(F.col(at), F.col(content))).alias("o"))
    raw = tx.unfenced(F.col("o.content"))
    d = last.select(id, "o.status", "o.finish", raw.alias("raw"))
    parsed = F.from_json("raw", ANSWER)
    sound = F.try_parse_json("raw").isNotNull() & F.col("raw").startswith("{")
    error = F.when(F.col("status") != 200, F.concat(F.lit("status "), F.coalesce(F.col("status").cast("string"), F.lit("missing")))).when(F.col("status").isNull(), "status missing").when(F.col("raw") == "", "empty content").when(~sound, "content is not a JSON object")
    d = d.withColumn("error", error)
    return d.select(id, F.when(F.col("error").isNull(), parsed).alias("answer"), "error")


def _spans(kind: str) -> Column:
    """Sanitized entities or facts of one chunk's answer, offsets repaired within the chunk and moved to the document."""
    items = F.col("answer.entities" if kind == "entities" else "answer.qualification_facts")

    def one(e):
        span = tx.stringify(e["text"])
        number = lambda x: F.floor(x.try_cast("double")).cast("int")
        a = repaired_start(F.col("chunk_text"), span, number(e["start"]), number(e["end"]))
        norm = F.coalesce(F.nullif(tx.stringify(e["normalized"]), F.lit("")), tx.collapse(span))
        start = a + F.col("chunk_start")
        if kind == "entities":
            return F.struct(tx.entity_label(e["label"]).alias("label"), span.alias("text"), start.alias("start"), (start + F.length(span)).alias("end"), norm.alias("normalized"))
        k, must = tx.fact_type(e["fact_type"]), F.coalesce(e["is_mandatory"], F.lit(False))
        return F.struct(k.alias("fact_type"), span.alias("text"), start.alias("start"), (start + F.length(span)).alias("end"), tx.fact_operator(e["operator"], k, must).alias("operator"), tx.stringify(e["value"]).alias("value"), tx.stringify(e["unit"]).alias("unit"), norm.alias("normalized"), must.alias("is_mandatory"))

    head = "label" if kind == "entities" else "fact_type"
    return F.filter(F.transform(F.coalesce(items, F.array()), one), lambda s: s[head].isNotNull() & s["start"].isNotNull())


def vote(values: Column, default: str = "unknown") -> Column:
    """Most frequent of an ordered array, without empty and unknown ones; ties go to the first seen."""
    v = F.filter(values, lambda x: x.isNotNull() & ~x.isin("", "unknown"))
    best = F.array_max(F.transform(F.array_distinct(v), lambda x: F.struct(F.size(F.filter(v, lambda y: y == x)).alias("n"), (-F.array_position(v, x)).alias("p"), x.alias("x"))))
    return F.coalesce(best["x"], F.lit(default))


def joined_summary(parts: Column, most: int = 400) -> Column:
    t = F.trim(F.array_join(F.slice(F.filter(parts, lambda x: x != ""), 1, 2), " "))
    return F.when(F.length(t) > most, F.concat(F.rtrim(F.substring(t, 1, most - 3)), F.lit("..."))).otherwise(t)


def _last_of_equal(items: Column, keys: tuple[str, ...], order: tuple[str, ...]) -> Column:
    """Of equal items the last one, sorted."""
    same = lambda x, y: F.struct(*(x[k] for k in keys)) == F.struct(*(y[k] for k in keys))
    at = F.transform(items, lambda x, i: F.struct(*(x[k].alias(f"k{j}") for j, k in enumerate(order)), i.alias("i"), x.alias("x")))
    kept = F.filter(at, lambda p: ~F.exists(at, lambda q: (q["i"] > p["i"]) & same(q["x"], p["x"])))
    return F.transform(F.array_sort(kept), lambda p: p["x"])


def merge_answers(records: DataFrame, manifest: DataFrame, answers: DataFrame, done: DataFrame | None = None, require_english: bool = False, require_it: bool = False) -> tuple[DataFrame, DataFrame]:
    """(annotations, errors). Chunks of a record in order, all of which need a sound answer, become one annotation record.

    records: record_id, document_type, text; manifest: custom_id, record_id, chunk_index, chunk_start, chunk_text. A
    record without chunks, with a chunk without an answer, or with a failed one is an error row (record_id,
    custom_id, error) of its first such chunk. Records in `done` are left out; of repeated record_ids one stays.
    """
    r = records.where(tx.stringify("record_id") != "").dropDuplicates(["record_id"])
    if done is not None:
        r = r.join(done.select("record_id").distinct(), "record_id", "left_anti")
    c = manifest.join(answers, "custom_id", "left").withColumn("error", F.when(F.col("answer").isNull() & F.col("error").isNull(), "no answer for the chunk").otherwise(F.col("error")))
    c = c.select("record_id", "custom_id", "chunk_index", "error", F.struct("chunk_index", "custom_id", "error").alias("at"), F.struct(F.col("chunk_index"), tx.language(F.col("answer.document_language")).alias("lang"), F.coalesce("answer.is_it_document", F.lit(False)).alias("it"), tx.stringify(F.col("answer.summary")).alias("summary"), _spans("entities").alias("entities"), _spans("facts").alias("facts")).alias("part"))
    g = c.groupBy("record_id").agg(F.sort_array(F.collect_list("part")).alias("parts"), F.min(F.when(F.col("error").isNotNull(), F.col("at"))).alias("bad"))
    j = r.join(g, "record_id", "left")
    errors = j.where("parts is null or bad is not null").select("record_id", F.col("bad.custom_id").alias("custom_id"), F.coalesce("bad.error", F.lit("no chunks for the record")).alias("error"))
    each = lambda f: F.transform("parts", lambda p: p[f])
    out = j.where("parts is not null and bad is null").select(
        "record_id", "document_type", "text",
        vote(each("lang")).alias("document_language"), F.exists("parts", lambda p: p["it"]).alias("is_it_document"), joined_summary(each("summary")).alias("summary"),
        _last_of_equal(F.flatten(each("entities")), ("label", "start", "end", "text"), ("start", "end", "label")).alias("entities"),
        _last_of_equal(F.flatten(each("facts")), ("fact_type", "start", "end", "text", "operator", "value"), ("start", "end", "fact_type")).alias("qualification_facts"),
        F.length("text").alias("text_length"),
    )
    if require_english:
        out = out.where("document_language = 'en'")
    return (out.where("is_it_document") if require_it else out), errors


def annotate(records: DataFrame, annotator: Callable[[list[str]], Iterator[str]], size: int = 12000, overlap: int = 200) -> tuple[DataFrame, DataFrame]:
    """Chunks through an annotator (texts in, JSON answers out, None for a failed one) and back to (annotations, errors).

    The annotator runs in the tasks, a batch at a time; requests carry the chunk's id, so a repeated task asks the same.
    """
    c = chunks(records.where(tx.stringify("text") != ""), "text", size, overlap)
    m = c.select(tx.chunk_id(F.col("record_id"), F.col("chunk_index"), F.col("chunk_start")).alias("custom_id"), "record_id", "chunk_index", "chunk_start", "chunk_text")

    def ask(batches):
        for pdf in batches:
            yield pdf[["custom_id"]].assign(content=list(annotator(pdf["chunk_text"].tolist())))

    asked = m.mapInPandas(ask, "custom_id string, content string")
    answers = parse_answers(asked.withColumns({"status_code": F.when(F.col("content").isNotNull(), 200), "finish_reason": F.lit("stop"), "received_at": F.lit(0)}))
    return merge_answers(records, m, answers)


def with_model(requests: DataFrame, model: str, request: str = "request") -> DataFrame:
    """Requests with body.model set, and changed, whether it was another. A request whose body isn't an object is an error
    when it is met. The body is taken apart and put together as JSON, so texts that look like a model stay."""
    v = F.try_parse_json(request)
    body = F.try_variant_get(v, "$.body", "map<string,variant>")
    head = F.try_variant_get(v, "$", "map<string,variant>")
    sound = F.when(body.isNotNull(), True).otherwise(F.raise_error(F.lit("a request has no body object")).cast("boolean"))
    other = sound & ~F.coalesce(F.try_variant_get(v, "$.body.model", "string") == model, F.lit(False))
    put = lambda m, k, x: F.map_concat(F.map_filter(m, lambda q, _: q != k), F.create_map(F.lit(k), x))
    new = put(head, "body", F.parse_json(F.to_json(put(body, "model", F.parse_json(F.to_json(F.lit(model).cast("variant")))))))
    d = requests.withColumn("changed", other)
    return d.withColumn(request, F.when(F.col("changed"), F.to_json(new)).otherwise(F.col(request)))


def retarget(records: DataFrame, requests: DataFrame, shards: DataFrame, submitted: DataFrame, model: str) -> tuple[DataFrame, DataFrame]:
    """(records, requests) with another model, and changed, where their shard isn't submitted yet. shards: (record_id, shard_id)."""
    open_ids = shards.join(submitted.select("shard_id").distinct(), "shard_id", "left_anti").select("record_id").distinct().withColumn("_open", F.lit(True))
    rec = records.join(open_ids, "record_id", "left").withColumn("changed", F.coalesce(F.col("_open") & ~F.col("model").eqNullSafe(F.lit(model)), F.lit(False)))
    rec = rec.withColumn("model", F.when(F.col("changed"), F.lit(model)).otherwise(F.col("model"))).drop("_open")
    req = requests.join(open_ids, "record_id", "left")
    done = with_model(req.where("_open"), model).drop("_open")
    return rec, done.unionByName(req.where("_open is null").drop("_open").withColumn("changed", F.lit(False)))


def record_rows(prepared: DataFrame, records: DataFrame, model: str, size: int = 12000, overlap: int = 200) -> DataFrame:
    """A row for each record of a batch: id, type, text, how it was cut, its chunks' custom ids in order, and where it came from."""
    ids = prepared.groupBy("record_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "custom_id"))), lambda x: x["custom_id"]).alias("custom_ids"), F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("requests"))
    more = [c for c in ("source_column", "source_row", "source_path", "source_id") if c in records.columns]
    return records.select("record_id", "document_type", "text", *more).join(ids, "record_id").withColumns({"model": F.lit(model), "chunk_size": F.lit(size), "chunk_overlap": F.lit(overlap), "text_length": F.length("text")})
