"""Training features: splits, chunk records, candidate spans, negative sampling."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .spans import chunks


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Row numbers within keys that may be hot, by order, whose first column is a hexadecimal hash: ranks within
    its 256 leading bytes, plus the counts of the bytes before."""
    bucket = F.substring(order[0], 1, 2)
    d = df.withColumn("_b", bucket)
    n = d.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    n = n.withColumn("_before", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_b")) - F.col("_n")).drop("_n")
    d = d.withColumn("_in", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order)))
    return d.join(n, [*keys, "_b"]).withColumn(name, F.col("_in") + F.col("_before")).drop("_b", "_in", "_before")


def stratified_split(df: DataFrame, train: float = 0.8, dev: float = 0.1, seed: int = 42, id: str = "record_id", kind: str = "document_type") -> DataFrame:
    """(id, split). Within cv, jd and other documents, by md5 of id and seed: one document is train, two are train and
    dev, more give max(1, floor(n * ratio)) to train and dev and the rest to test. If dev or test stay empty overall,
    the last train documents move there."""
    if min(train, dev, 1 - train - dev) <= 0:
        raise ValueError("all three ratios must be positive")
    d = df.select(F.col(id).cast("string").alias(id), F.when(F.col(kind).isin("cv", "jd"), F.col(kind)).otherwise("other").alias("_g"))
    d = d.withColumn("_h", F.md5(F.concat(F.col(id), F.lit(f"|{seed}"))))
    n = d.groupBy("_g").agg(F.count("*").alias("_n"))
    d = ranked(d, ["_g"], ["_h", id], "_r").join(F.broadcast(n), "_g")
    a, b = F.greatest(F.lit(1), F.floor(F.col("_n") * train)), F.greatest(F.lit(1), F.floor(F.col("_n") * dev))
    full = a + b >= F.col("_n")
    a, b = F.when(full, F.greatest(F.lit(1), F.col("_n") - 2)).otherwise(a), F.when(full, 1).otherwise(b)
    a, b = F.when(F.col("_n") <= 2, 1).otherwise(a), F.when(F.col("_n") == 1, 0).when(F.col("_n") == 2, 1).otherwise(b)
    d = d.withColumn("split", F.when(F.col("_r") <= a, "train").when(F.col("_r") <= a + b, "dev").otherwise("test"))
    have = {r["split"]: r["count"] for r in d.groupBy("split").count().collect()}  # three rows at most
    lacking = [s for s in ("dev", "test") if not have.get(s)]
    if lacking and have.get("train", 0) > len(lacking):
        tail = d.where("split = 'train'").orderBy(F.desc("_g"), F.desc("_r")).limit(len(lacking)).withColumn("_i", F.row_number().over(Window.orderBy(F.desc("_g"), F.desc("_r"))))
        moved = tail.select(id, F.element_at(F.array(*map(F.lit, lacking)), F.col("_i")).alias("_to"))
        d = d.join(moved, id, "left").withColumn("split", F.coalesce("_to", "split"))
    return d.select(id, "split")


def manifest_gaps(df: DataFrame, manifest: DataFrame, id: str = "record_id") -> DataFrame:
    """(id, gap): manifest ids without a document ("missing"), documents without a split ("unassigned"), and ids in
    several splits ("repeated")."""
    ids, own = manifest.select(id, "split").distinct(), df.select(id).distinct()
    missing = ids.select(id).distinct().join(own, id, "left_anti").withColumn("gap", F.lit("missing"))
    free = own.join(ids.select(id), id, "left_anti").withColumn("gap", F.lit("unassigned"))
    twice = ids.groupBy(id).agg(F.count("*").alias("n")).where("n > 1").select(id, F.lit("repeated").alias("gap"))
    return missing.unionByName(free).unionByName(twice)


def apply_manifest(df: DataFrame, manifest: DataFrame, id: str = "record_id") -> DataFrame:
    """Documents with their split. A gap between documents and manifest is an error that names up to five ids of each kind."""
    gaps = manifest_gaps(df, manifest, id)
    found = gaps.groupBy("gap").agg(F.count("*").alias("n"), F.min(id).alias("least")).collect()  # three rows at most
    if found:
        some = {r["gap"]: [x[id] for x in gaps.where(F.col("gap") == r["gap"]).orderBy(id).limit(5).collect()] for r in found}
        raise ValueError("; ".join(f"{r['n']} record ids are {r['gap']}, such as {some[r['gap']]}" for r in found))
    return df.join(manifest.select(id, "split"), id)


def chunks_with_spans(df: DataFrame, size: int = 1400, overlap: int = 120, id: str = "record_id", spans: str = "entities") -> DataFrame:
    """chunk_records with each document's spans (array<struct<label,start,end,text>>) in the first chunk that holds them,
    offsets from the chunk's start; unassigned: how many of the document's spans no chunk holds, at its first chunk."""
    c = chunks(df.select(id, "text", F.coalesce(spans, F.array().cast("array<struct<label:string,start:int,end:int,text:string>>")).alias("_s")), "text", size, overlap)
    c = c.withColumn("_e", F.col("chunk_start") + F.length("chunk_text"))
    bounds = c.groupBy(id).agg(F.sort_array(F.collect_list(F.struct("chunk_index", "chunk_start", "_e"))).alias("_all"))
    holds = lambda s, b: (s["start"] >= b["chunk_start"]) & (s["end"] <= b["_e"])
    c = c.join(bounds, id)
    first = lambda s: F.array_min(F.transform(F.filter("_all", lambda b: holds(s, b)), lambda b: b["chunk_index"]))
    own = F.transform(F.filter("_s", lambda s: first(s) == F.col("chunk_index")), lambda s: F.struct(s["label"].alias("label"), (s["start"] - F.col("chunk_start")).alias("start"), (s["end"] - F.col("chunk_start")).alias("end"), s["text"].alias("text")))
    lost = F.when(F.col("chunk_index") == 0, F.size(F.filter("_s", lambda s: first(s).isNull()))).otherwise(0)
    return c.select(F.concat(F.col(id), F.lit("::chunk-"), F.col("chunk_index").cast("string")).alias("feature_id"), id, "chunk_index", "chunk_start", F.col("chunk_text").alias("text"), own.alias("spans"), lost.alias("unassigned"))


def with_gold(candidates: DataFrame, gold: DataFrame, id: str = "feature_id") -> DataFrame:
    """Candidate spans with label_id, that of the gold span (id, start_token, end_token, label_id) with the same bounds, or 0."""
    g = gold.groupBy(id, "start_token", "end_token").agg(F.max("label_id").alias("label_id"))
    return candidates.join(g, [id, "start_token", "end_token"], "left").withColumn("label_id", F.coalesce("label_id", F.lit(0)))


def whitespace_tokens(text: str) -> list[tuple[int, int]]:
    """Bounds of the tokens of the built-in tokenizer."""
    return [m.span() for m in _TOKEN.finditer(text)]


FEATURE = "feature_id string, record_id string, document_type string, n_tokens int, span_starts array<int>, span_ends array<int>, span_widths array<int>, labels array<int>, char_starts array<int>, char_ends array<int>, texts array<string>"
COUNTS = ("chunk_examples", "dropped_unassigned_spans", "dropped_truncated_chunks", "retokenized_subchunks", "dropped_alignment_spans", "positive_spans")


def build_features(df: DataFrame, labels: dict[str, int], tokenize: Callable[[str], list[tuple[int, int]]] = whitespace_tokens, split: str = "train", size: int = 1400, overlap: int = 120, max_tokens: int = 256, width: int = 8, multiplier: int = 4, least: int = 64, seed: int = 42, analysis: bool = False) -> tuple[DataFrame, DataFrame]:
    """(features, stats) of documents (record_id, document_type, text, entities array<struct<label,start,end,text>>).

    A document's chunks take its spans; a chunk of more than max_tokens tokens is cut again into chunks of half its
    length, no longer than half of `size` and no shorter than 160, unless it is hardly longer than that, which drops it.
    Candidates are all runs of up to `width` tokens; spans whose bounds are no token's are dropped. In the split
    train negatives are sampled by a hash of feature and bounds; analysis=True keeps all, with the characters' bounds and
    texts. stats: one row of counts. A document is one task's row; documents don't depend on each other.
    """
    from .spans import chunk_bounds

    own = F.coalesce("entities", F.array().cast("array<struct<label:string,start:int,end:int,text:string>>"))
    rows = df.where(tx.stringify("text") != "").select(F.col("record_id").cast("string").alias("record_id"), F.coalesce("document_type", F.lit("unknown")).alias("document_type"), "text", F.transform(own, lambda s: F.struct(s["label"].alias("label"), s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"))).alias("spans"))

    def pieces(name, text, spans, limit, lap, count):
        left = spans
        for i, (a, b) in enumerate(chunk_bounds(text, limit, lap)):
            held = [(k, x - a, y - a) for k, x, y in left if x >= a and y <= b]
            left = [s for s in left if not (s[1] >= a and s[2] <= b)]
            yield f"{name}-{i}", text[a:b], held
        count["dropped_unassigned_spans"] += len(left)

    def order(name, i, j):
        return hashlib.md5(f"{name}|{i}|{j}|{seed}".encode()).hexdigest()

    def features_of(record, kind, text, spans, count):
        todo = list(pieces(f"{record}::chunk", text, [(s["label"], s["start"], s["end"]) for s in spans if s["start"] is not None and s["end"] is not None], size, overlap, count))
        while todo:
            name, t, held = todo.pop(0)
            bounds = tokenize(t)
            if len(bounds) > max_tokens:
                half = max(min(len(t) // 2, size // 2), 160)
                if len(t) > half + 20:
                    cut = list(pieces(f"{name}::sub", t, held, half, min(overlap, max(40, half // 8)), count))
                    count["retokenized_subchunks"] += len(cut)
                    todo = cut + todo
                else:
                    count["dropped_truncated_chunks"] += 1
                continue
            at, to, gold = {a: i for i, (a, b) in reversed(list(enumerate(bounds))) if b > a}, {b: i for i, (a, b) in reversed(list(enumerate(bounds))) if b > a}, {}
            for k, a, b in held:
                if k in labels and a in at and b in to and to[b] >= at[a]:
                    gold[at[a], to[b]] = labels[k]
                else:
                    count["dropped_alignment_spans"] += 1
            runs = [(i, j, gold.get((i, j), 0)) for i in range(len(bounds)) for j in range(i, min(i + width, len(bounds)))]
            if split == "train" and not analysis:
                good = sum(1 for r in runs if r[2])
                most = max(least, good * multiplier) if good else least
                chosen = {r[:2] for r in sorted((r for r in runs if not r[2]), key=lambda r: (order(name, r[0], r[1]), r[0], r[1]))[:most]}
                runs = [r for r in runs if r[2] or r[:2] in chosen]
            if runs:
                count["chunk_examples"] += 1
                count["positive_spans"] += sum(1 for r in runs if r[2])
                i, j, lab = map(list, zip(*runs))
                chars = ([bounds[x][0] for x in i], [bounds[y][1] for y in j]) if analysis else (None, None)
                yield name, record, kind, len(bounds), i, j, [y - x + 1 for x, y in zip(i, j)], lab, *chars, [t[a:b] for a, b in zip(*chars)] if analysis else None

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for record, kind, text, spans in zip(pdf["record_id"], pdf["document_type"], pdf["text"], pdf["spans"]):
                count = dict.fromkeys(COUNTS, 0)
                made = list(features_of(record, kind, text, spans, count))
                out += [(*f, *([0] * len(COUNTS))) for f in made]
                out.append((None, record, kind, *[None] * 8, *count.values()))  # the document's counts
            yield pd.DataFrame(out, columns=[*(c.split(" ")[0] for c in FEATURE.split(", ")), *COUNTS])

    made = rows.mapInPandas(run, FEATURE + "".join(f", {c} bigint" for c in COUNTS))
    stats = made.where("feature_id is null").agg(F.count("*").alias("documents"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS))
    features = made.where("feature_id is not null").drop(*COUNTS)
    return (features if analysis else features.drop("char_starts", "char_ends", "texts")), stats


def resume_plan(requested: int, done: int, more: int = 0) -> tuple[int, int]:
    """(first, last) epoch of a run that goes on after `done` epochs: up to `requested`, or `more` further ones."""
    if done < 0 or more < 0:
        raise ValueError("epochs can't be negative")
    last = done + more if done and more else requested
    if done and last < done + 1:
        raise ValueError(f"nothing to do: epoch {done} is done, the last asked for is {last}")
    return done + 1, last


def check_resume(saved: dict, current: dict, keys: tuple[str, ...] = ("label_to_id", "max_span_width", "width_embedding_dim", "classifier_hidden_dim", "model_name")) -> None:
    """An error where a saved setting, if it is known, differs from the current one."""
    for k in keys:
        if saved.get(k) not in (None, {}) and saved[k] != current.get(k):
            raise ValueError(f"the saved {k} {saved[k]!r} doesn't match {current.get(k)!r}")


def chunk_records(df: DataFrame, size: int = 1400, overlap: int = 120, id: str = "record_id", mark: str = "chunk") -> DataFrame:
    """(feature_id, id, chunk_index, chunk_start, chunk_end, text): ids are <id>::<mark>-<index>; mark "sub" for chunks of chunks."""
    c = chunks(df.select(id, "text"), "text", size, overlap)
    return c.select(F.concat(F.col(id), F.lit(f"::{mark}-"), F.col("chunk_index").cast("string")).alias("feature_id"), id, "chunk_index", "chunk_start", (F.col("chunk_start") + F.length("chunk_text")).alias("chunk_end"), F.col("chunk_text").alias("text"))


#: A word with the signs inside and behind it that names of technologies have (Node.js, 4.3, C++), or any other sign alone.
_TOKEN = re.compile(r"\w(?:[\w+#./-]*[\w+#])?|[^\w\s]")


def token_offsets(text: Column) -> Column:
    """array<struct<start,end>> of the tokens of a text, from 0."""

    @F.udf("array<struct<start:int,end:int>>", useArrow=True)
    def cut(t):
        return None if t is None else [m.span() for m in _TOKEN.finditer(t)]

    return cut(text)


def label_ids(spans: DataFrame) -> DataFrame:
    """(label, label_id): 0 is the label O, the others follow in order. Without any label there is nothing to learn: an error."""
    labels = spans.select("label").where("label is not null").distinct()
    if labels.isEmpty():
        raise ValueError("no span has a label")
    return labels.withColumn("label_id", F.row_number().over(Window.orderBy("label"))).unionByName(labels.sparkSession.createDataFrame([("O", 0)], "label string, label_id int"))


def sample_negatives(candidates: DataFrame, multiplier: int = 4, least: int = 64, seed: int = 42, id: str = "feature_id") -> DataFrame:
    """All spans with a label, and of the others, per feature, max(least, labelled * multiplier), or `least` if none is labelled."""
    d = candidates.withColumn("_h", F.md5(F.concat_ws("|", id, "start_token", "end_token", F.lit(str(seed)))))
    w = Window.partitionBy(id)
    d = d.withColumn("_p", F.sum((F.col("label_id") != 0).cast("int")).over(w)).withColumn("_r", F.row_number().over(Window.partitionBy(id, F.col("label_id") == 0).orderBy("_h", "start_token", "end_token")))
    keep = F.when(F.col("_p") > 0, F.greatest(F.lit(least), F.col("_p") * multiplier)).otherwise(least)
    return d.where((F.col("label_id") != 0) | (F.col("_r") <= keep)).drop("_h", "_p", "_r")
