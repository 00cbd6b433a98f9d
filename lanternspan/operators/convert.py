"""Third-party span rows: triplets [start, end, label] and objects {start, end, label | entity | tag}."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx


def foreign_spans(df: DataFrame, label_map: dict[str, str] | None = None, id: str = "record_id", text: str = "text", labels: str = "labels", annotations: str = "annotations") -> DataFrame:
    """(id, label, start, end, text, normalized). labels and annotations hold JSON arrays as text; either may be null.

    Items without two whole numbers and a known label, and spans outside the text, are left out; of equal spans one stays.
    """
    t = tx.stringify(text)
    parse = lambda c: F.try_parse_json(F.col(c)) if c in df.columns else F.lit(None).cast("variant")
    d = df.select(F.col(id), t.alias("_t"), parse(labels).alias("_l"), parse(annotations).alias("_a"))
    arr = lambda c: F.coalesce(F.expr(f"try_variant_get({c}, '$', 'array<variant>')"), F.array().cast("array<variant>"))
    get = lambda v, p, ty: F.try_variant_get(v, p, ty)
    trip = F.filter(F.transform(arr("_l"), lambda v: F.struct(get(v, "$[0]", "bigint").alias("a"), get(v, "$[1]", "bigint").alias("b"), get(v, "$[2]", "string").alias("label"), get(v, "$[3]", "string").alias("more"))), lambda s: s["more"].isNull())
    trip = F.transform(trip, lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), s["label"].alias("label")))
    obj = F.transform(arr("_a"), lambda v: F.struct(get(v, "$.start", "bigint").alias("a"), get(v, "$.end", "bigint").alias("b"), F.coalesce(*(F.nullif(get(v, f"$.{k}", "string"), F.lit("")) for k in ("label", "entity", "tag"))).alias("label")))
    s = d.select(id, "_t", F.inline(F.concat(trip, obj))).withColumn("label", tx.foreign_label(F.col("label"), label_map))
    s = s.where("label is not null and a >= 0 and b > a and b <= length(_t)")
    span = F.expr("substring(_t, cast(a as int) + 1, cast(b - a as int))")
    return s.select(id, "label", F.col("a").cast("int").alias("start"), F.col("b").cast("int").alias("end"), span.alias("text"), F.lower(span).alias("normalized")).distinct()


def converted_rows(df: DataFrame, text: str = "text", id: str = "doc_id", doc_type: str | None = None, default_type: str = "unknown", pos: str = "pos") -> DataFrame:
    """(record_id, document_type, text) of the rows with a text; a missing id becomes row-<pos>."""
    kind = F.nullif(tx.doc_type(F.coalesce(F.nullif(tx.stringify(doc_type), F.lit("")), F.lit(default_type))) if doc_type else tx.doc_type(F.lit(default_type)), F.lit("unknown"))
    d = df.where(tx.stringify(text) != "")
    return d.select(F.coalesce(F.nullif(tx.stringify(id), F.lit("")), F.concat(F.lit("row-"), F.col(pos).cast("string"))).alias("record_id"), F.coalesce(kind, F.lit(default_type)).alias("document_type"), tx.stringify(text).alias("text"))


def valid_spans(df: DataFrame, id: str = "record_id") -> DataFrame:
    """Spans (id, doc_text, label, text, start, end) whose bounds hold exactly their text; of equal ones one."""
    from .spans import valid_span

    lab = F.upper(tx.stringify("label"))
    d = df.withColumn("label", lab).withColumn("text", tx.stringify("text"))
    ok = valid_span(tx.stringify("doc_text"), F.col("label"), F.col("start"), F.col("end"), F.col("text"))
    return d.where(F.coalesce(ok, F.lit(False))).withColumn("_r", F.row_number().over(Window.partitionBy(id, "label", "start", "end").orderBy("text"))).where("_r = 1").drop("_r", "doc_text")
