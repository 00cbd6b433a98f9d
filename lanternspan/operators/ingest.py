"""Normalised CV and job description rows from raw exports, and scans that go on until enough rows are accepted."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def _get(df: DataFrame, name: str) -> Column:
    return tx.hub_text(F.col(f"`{name}`")) if name in df.columns else F.lit("")


def _line(label: str, c: Column, sep: str = ": ") -> Column:
    return F.when(c != "", F.concat(F.lit(label + sep), c))


def normalize(df: DataFrame, kind: str, dataset: str = "", offset: str | None = None) -> DataFrame:
    """Raw rows of one kind ("cv" or "jd") as normalised rows; missing columns count as empty.

    A CV's other sections come in only where its body has fewer than 80 characters. Without an id the id is empty.
    """
    g = lambda n: _get(df, n)
    cv = kind == "cv"
    body = g("CV") if cv else g("Long Description")
    years = g("Experience Years") if cv else g("Exp Years")
    head = [_line("Position", g("Position"))] + ([] if cv else [_line("Company Name", g("Company Name"))])
    head += [_line("Primary Keyword", g("Primary Keyword")), _line("English Level", g("English Level")), _line("Experience Years", years), _line("CV" if cv else "Job Description", body, ":\n")]
    if cv:
        head += [F.when(F.length(body) < 80, _line(label, g(c), ":\n")) for label, c in (("More Info", "Moreinfo"), ("Looking For", "Looking For"), ("Highlights", "Highlights"))]
    sid = g("id")
    cols = {
        "id": F.when(sid != "", F.concat(F.lit(f"{kind}::"), sid)).otherwise(""), "source_id": sid, "doc_type": F.lit(kind), "text": F.regexp_replace(F.concat_ws("\n\n", *head), tx.ENDS, ""), "source_dataset": F.lit(dataset),
        "source_language": F.coalesce(F.nullif(g("CV_lang" if cv else "Long Description_lang"), F.lit("")), F.lit("unknown")), "position": g("Position"), "primary_keyword": g("Primary Keyword"), "english_level": g("English Level"), "experience_years": years,
    }
    if not cv:
        cols |= {"company_name": g("Company Name"), "published": g("Published")}
    if offset:
        cols["source_offset"] = F.col(offset).cast("bigint")
    return df.select(*(c.alias(n) for n, c in cols.items()))


def union(cv: DataFrame, jd: DataFrame) -> DataFrame:
    return cv.unionByName(jd, allowMissingColumns=True)


def scan_until(df: DataFrame, accept: Column, n: int, offset: str = "source_offset", start: int = 0, budget: int | None = None, normalizer: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The first n accepted rows from an offset on, within a budget of scanned offsets. Range and predicate reach the scan."""
    d = df.where(F.col(offset) >= start)
    if budget is not None:
        d = d.where(F.col(offset) < start + budget)
    d = d.transform(normalizer) if normalizer else d
    return d.where(accept).orderBy(offset).limit(n)


def resume_state(df: DataFrame, offset: str = "source_offset") -> DataFrame:
    """(doc_type, rows, next_offset) of what an earlier run has written."""
    return df.groupBy("doc_type").agg(F.count("*").alias("rows"), (F.coalesce(F.max(F.col(offset).cast("string").try_cast("bigint")), F.lit(-1)) + 1).alias("next_offset"))


def unprocessed(df: DataFrame, done: DataFrame, id: str = "record_id") -> DataFrame:
    """Rows whose id isn't among those done, one for each id."""
    return df.join(done.select(id).distinct(), id, "left_anti").dropDuplicates([id])
