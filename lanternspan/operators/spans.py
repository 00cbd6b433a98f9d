"""Span algebra: chunks with exact offsets, offset repair, term, pattern and line extraction, pruning and assignment."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx

_GAP, _SOLID = re.compile("[ \n]"), re.compile(r"\S+")
SPAN = "array<struct<label:string,text:string,start:int,end:int,normalized:string>>"


def chunk_bounds(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the chunks, from the positions of the text's signs and of its blanks and line ends.

    A chunk reaches `size` characters on, or up to behind the last blank or line end in the second half of that; what
    isn't white space within bounds it. The next chunk begins `overlap` before that bound, but further on than the last.
    """
    if size <= 0 or overlap < 0:
        raise ValueError("the chunk size must be positive and the overlap not negative")
    n = len(text)
    if n <= size:
        return [(0, n)]
    gaps = [m.start() for m in _GAP.finditer(text)]
    words = [m.span() for m in _SOLID.finditer(text)]
    firsts, lasts = [a for a, _ in words], [b for _, b in words]

    def solid(lo: int, hi: int) -> tuple[int, int]:
        i, j = bisect_right(lasts, lo), bisect_left(firsts, hi) - 1
        return (max(lo, firsts[i]), min(hi, lasts[j])) if i <= j else (lo, hi)

    out: list[tuple[int, int]] = []
    begin = 0
    while begin < n and (not out or out[-1][1] < n):
        reach = begin + size
        if reach < n:
            last = bisect_left(gaps, reach) - 1
            if last >= 0 and gaps[last] >= max(begin + 1, begin + size // 2):
                reach = gaps[last] + 1
        out.append(solid(begin, min(reach, n)))
        begin = max(out[-1][1] - overlap, begin + 1)
    return out


def chunks(df: DataFrame, text: str = "text", size: int = 12000, overlap: int = 200) -> DataFrame:
    """The rows with chunk_index, chunk_start and chunk_text. Texts that fit in one chunk never leave the JVM."""

    @F.udf("array<struct<chunk_index:int,chunk_start:int,chunk_text:string>>", useArrow=True)
    def cut(t):
        return [(i, a, t[a:b]) for i, (a, b) in enumerate(chunk_bounds(t, size, overlap))]

    d = df.where(F.col(text).isNotNull())
    one = F.array(F.struct(F.lit(0).alias("chunk_index"), F.lit(0).alias("chunk_start"), F.col(text).alias("chunk_text")))
    small = d.where(F.length(text) <= size).select("*", F.inline(one))
    return small.unionByName(d.where(F.length(text) > size).select("*", F.inline(cut(F.col(text)))))


def occurrences(text: Column, span: Column) -> Column:
    """Starts (from 0) of the non-overlapping occurrences of a literal: lengths of the parts between, summed up."""
    parts = F.split(text, F.concat(F.lit("\\Q"), F.replace(span, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")), -1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    n = F.length(span)
    step = lambda acc, p: F.struct((acc["at"] + F.length(p) + n).alias("at"), F.concat(acc["out"], F.array(acc["at"] + F.length(p))).alias("out"))
    return F.aggregate(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), zero, step, lambda a: a["out"])


def repaired_start(text: Column, span: Column, start: Column, end: Column) -> Column:
    """The given start where it holds the span; else that of the nearest occurrence (ties: the first); else null."""
    exact = (start >= 0) & (start <= end) & (end <= F.length(text)) & (F.substring(text, start + 1, end - start) == span)
    found = occurrences(text, span)
    best = F.array_min(F.transform(found, lambda p: F.struct(F.abs(p - F.coalesce(start, F.lit(0))).alias("d"), p.alias("p"))))["p"]
    return F.when(span == "", None).when(F.coalesce(exact, F.lit(False)), start).when(~F.contains(text, span), None).otherwise(best)


def valid_span(text: Column, label: Column, start: Column, end: Column, span: Column | None = None) -> Column:
    ok = label.isin(*lx.ENTITY_LABELS) & (start >= 0) & (end > start) & (end <= F.length(text))
    return ok if span is None else ok & (F.substring(text, start + 1, end - start) == span)


def term_spans(df: DataFrame, terms: dict[str, list[str]], id: str = "record_id", text: str = "text", extra: str | None = None) -> DataFrame:
    """(id, label, start, end, text): every term without regard to case between ASCII letters and digits' ends.

    terms: label -> terms; extra: a column of array<struct<label,term>> with a row's own ones. All terms are met in
    one pass over the text by an automaton; each term's occurrences don't overlap, different terms' may.
    """
    fixed = [(label, t.lower()) for label, ts in terms.items() for t in ts]

    def run(batches):
        import ahocorasick
        import pyarrow as pa

        base: dict[str, set[str]] = {}
        for label, t in fixed:
            base.setdefault(t, set()).add(label)
        auto = ahocorasick.Automaton()
        for t in base:
            auto.add_word(t, t)
        auto.make_automaton()
        edge = lambda s, i: not (0 <= i < len(s) and s[i].isascii() and s[i].isalnum())
        for b in batches:
            out = []
            for key, t, own in zip(*(c.to_pylist() for c in b.columns)):
                low = t.lower()
                if len(low) != len(t):  # a letter whose lower case is longer keeps its place
                    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in t)
                hits = [(e - len(w) + 1, w, base[w]) for e, w in auto.iter(low)] if base else []
                for o in own or ():
                    w = (o["term"] or "").lower()
                    if w and o["label"] not in base.get(w, ()):
                        hits += [(m.start(), w, (o["label"],)) for m in re.finditer(re.escape(w), low)]
                last: dict = {}
                for a, w, labels in sorted(hits, key=lambda h: (h[0], h[1])):
                    if edge(low, a - 1) and edge(low, a + len(w)):
                        for label in labels:
                            if a >= last.get((label, w), 0):
                                last[label, w] = a + len(w)
                                out.append((key, label, a, a + len(w), t[a : a + len(w)]))
            out = list(dict.fromkeys(out))
            yield pa.RecordBatch.from_arrays([pa.array(x, ty) for x, ty in zip(zip(*out) if out else [[]] * 5, (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()))], ["id", "label", "start", "end", "text"])

    own = F.col(extra) if extra else F.lit(None).cast("array<struct<label:string,term:string>>")
    d = df.where(F.col(text).isNotNull()).select(F.col(id).cast("string"), F.col(text).cast("string"), own)
    return d.mapInArrow(run, "id string, label string, start int, end int, text string").withColumnRenamed("id", id)


def pattern_spans(df: DataFrame, label: str, patterns, id: str = "record_id", text: str = "text") -> DataFrame:
    """(id, label, start, end, text) of each pattern's matches, without regard to case; a span of two patterns counts once.

    Native: the parts between the matches give the offsets.
    """
    parts = []
    for p in patterns:
        rx = f"(?iu){p}"
        rows = df.where(F.col(text).rlike(rx)).select(F.col(id).alias("_id"), F.regexp_extract_all(F.col(text), F.lit(f"({rx})"), F.lit(1)).alias("m"), F.split(F.col(text), rx, -1).alias("s"))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,text:string>>").alias("out"))
        step = lambda a, x: F.struct((a["at"] + F.length(x["0"]) + F.length(x["m"])).alias("at"), F.concat(a["out"], F.array(F.struct((a["at"] + F.length(x["0"])).alias("start"), x["m"].alias("text")))).alias("out"))
        spans = F.aggregate(F.arrays_zip(F.slice("s", F.lit(1), F.size("m")), F.col("m")), zero, step, lambda a: a["out"])
        parts.append(rows.select("_id", F.inline(spans)))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.select(F.col("_id").alias(id), F.lit(label).alias("label"), "start", (F.col("start") + F.length("text")).alias("end"), "text").distinct()


def activity_spans(df: DataFrame, verbs=lx.WORK_ACTIVITY_VERBS, id: str = "record_id", text: str = "text", shortest: int = 18, longest: int = 180) -> DataFrame:
    """(id, label, start, end, text) of lines that start with one of the verbs behind their list mark."""
    lines = F.split(F.col(text), "\n", -1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,line:string>>").alias("out"))
    step = lambda a, x: F.struct((a["at"] + F.length(x) + 1).alias("at"), F.concat(a["out"], F.array(F.struct(a["at"].alias("start"), x.alias("line")))).alias("out"))
    d = df.where(F.col(text).isNotNull()).select(F.col(id), F.inline(F.aggregate(lines, zero, step, lambda a: a["out"])))
    d = d.withColumn("s", F.regexp_replace("line", tx.ENDS, "")).where(F.length("s").between(shortest, longest))
    head = F.lower(F.regexp_replace("s", r"^[\-\*\d\.\)\s]+", ""))
    d = d.where(head.rlike("^(?:" + "|".join(tx.literal(v) for v in verbs) + ")"))
    start = F.col("start") + F.length("line") - F.length(F.regexp_replace("line", r"(?U)^\s+", ""))
    return d.select(id, F.lit("WORK_ACTIVITY").alias("label"), start.alias("start"), (start + F.length("s")).alias("end"), F.col("s").alias("text"))


def prune(df: DataFrame, id: str = "record_id", generic=lx.GENERIC_JOB_ROLES) -> DataFrame:
    """Spans without general roles, without compound roles that hold a shorter one, and without false degrees."""
    role = F.col("label") == "JOB_ROLE"
    roles = df.where(role).select(F.col(id).alias("_id"), F.col("start").alias("_a"), F.col("end").alias("_b"), F.length("text").alias("_n"))
    compound = role & (F.col("text").rlike("[/,]") | (F.size(F.filter(F.split("text", r"(?U)\s+"), lambda w: w != "")) > 4))
    inside = (F.col(id) == F.col("_id")) & (F.col("_a") >= F.col("start")) & (F.col("_b") <= F.col("end")) & (F.col("_n") < F.length("text"))
    low = F.lower(F.trim("text"))
    keep = df.where(~(role & low.isin(*generic)) & ~((F.col("label") == "DEGREE") & low.rlike(r"\b(?:master|bachelor) of the\b")))
    return keep.where(~compound).unionByName(keep.where(compound).join(roles, inside, "left_anti")).dropDuplicates([id, "label", "start", "end"])


def first_holding_chunk(spans: DataFrame, pieces: DataFrame, id: str = "record_id", key: str = "span_id") -> DataFrame:
    """Each span with the first chunk (chunk_index, chunk_start, chunk_end) that holds all of it; null where none does."""
    held = spans.alias("s").join(pieces.alias("c"), (F.col(f"s.{id}") == F.col(f"c.{id}")) & (F.col("s.start") >= F.col("c.chunk_start")) & (F.col("s.end") <= F.col("c.chunk_end")))
    best = held.groupBy(F.col(f"s.{key}").alias(key)).agg(F.min(F.struct("c.chunk_index", "c.chunk_start", "c.chunk_end")).alias("c"))
    return spans.join(best, key, "left").select(spans["*"], F.col("c.chunk_index"), F.col("c.chunk_start"), F.col("c.chunk_end"))


def candidate_spans(tokens: DataFrame, width: int = 8, id: str = "feature_id") -> DataFrame:
    """(id, start_token, end_token, span_width) of all runs of up to `width` tokens; tokens: (id, n_tokens)."""
    i = tokens.where("n_tokens > 0").select(id, "n_tokens", F.explode(F.sequence(F.lit(0), F.col("n_tokens") - 1)).alias("start_token"))
    return i.select(id, "start_token", F.explode(F.sequence("start_token", F.least(F.col("start_token") + width - 1, F.col("n_tokens") - 1))).alias("end_token")).withColumn("span_width", F.col("end_token") - F.col("start_token") + 1)


def token_span(offsets: Column, start: Column, end: Column) -> Column:
    """struct<first,last> of the tokens whose bounds are exactly the span's, or null; offsets: array<struct<start,end>>."""
    at = lambda side, v: F.array_position(F.transform(offsets, lambda o: F.when(o["end"] > o["start"], o[side]).otherwise(F.lit(-1))), v) - 1
    a, b = at("start", start), at("end", end)
    return F.when((a >= 0) & (b >= a), F.struct(a.cast("int").alias("first"), b.cast("int").alias("last")))
