"""Column functions over text: cleaning, counting, normalising, tokens, identifiers and JSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as lx

#: White space as in Unicode: the line end, and the rest.
BLANKS = "\t\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_BLANK = r"\t\x0b\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space at both ends.
ENDS = rf"^[\n{_BLANK}]+|[\n{_BLANK}]+$"
#: Characters of words, those of ASCII first, which is the quick way through the class.
_WORD = r"a-zA-Z0-9_\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}"


def strip(c: Column) -> Column:
    """The text without white space at its ends."""
    return F.btrim(c, F.lit("\n" + BLANKS))


def stringify(c, trim: bool = True) -> Column:
    """Text of a value, null as empty; stripped at both ends unless trim is False."""
    t = F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit(""))
    return F.btrim(t, F.lit("\n" + BLANKS)) if trim else t


def hub_text(c) -> Column:
    """Stripped text; the words null, nan and none mean empty."""
    t = stringify(c)
    return F.when(F.lower(t).isin("null", "nan", "none"), "").otherwise(t)


def clean_text(c: Column, replacements: dict[str, str] = lx.MANUAL_TEXT_REPLACEMENTS) -> Column:
    """Fixed replacements in their order, one kind of line end, no blanks around line ends, single blanks, at most one empty line."""
    t = reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), replacements.items(), c)
    t = F.replace(F.replace(t, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    t = F.regexp_replace(t, r"(?<![ \t])[ \t]*+\n[ \t]*+", "\n")
    t = F.regexp_replace(t, r"[ \t]{2,}+", " ")
    t = F.regexp_replace(t, rf"(?<![{_BLANK}])[{_BLANK}]*+\n[{_BLANK}]*+", "\n")
    return F.regexp_replace(strip(t), r"\n{3,}+", "\n\n")


def count_words(c: Column) -> Column:
    return F.regexp_count(c, F.lit(rf"[{_WORD}](?:[{_WORD}+#./-]*[{_WORD}])?")).cast("bigint")


def collapse(c: Column) -> Column:
    """Lower case, runs of white space as one blank, stripped: the key of exact duplicates and of span texts."""
    return F.trim(F.regexp_replace(F.lower(c), rf"[\n{_BLANK}]++", " "))


def normalize_text(c: Column) -> Column:
    return collapse(F.translate(F.coalesce(c, F.lit("")), "’", "'"))


def length_bucket(doc_type: Column, n: Column) -> Column:
    ladder = lambda bounds: reduce(lambda w, b: w.when(n < b[0], b[1]), bounds[1:], F.when(n < bounds[0][0], bounds[0][1])).otherwise("xlong")
    return F.when(doc_type == "cv", ladder(lx.CV_BUCKETS)).otherwise(ladder(lx.JD_BUCKETS))


def any_of(c: Column, terms) -> Column:
    """Whether the text contains any of the terms, by one alternation of literals."""
    return c.rlike("|".join(literal(t) for t in sorted(terms))) if terms else F.lit(False)


def literal(term: str) -> str:
    """The term as a pattern that matches itself."""
    return "".join("\\" + ch if not ch.isalnum() and not ch.isspace() and ord(ch) < 128 and ch != "_" else ch for ch in term)


def bounded(term: str) -> str:
    """Pattern of the term between ASCII letters and digits' ends."""
    return f"(?<![A-Za-z0-9]){literal(term)}(?![A-Za-z0-9])"


def tokenize(c: Column) -> Column:
    """Tokens of letters, digits and .+#/- without stop words and single characters other than the kept ones."""
    found = F.regexp_extract_all(normalize_text(c), F.lit(r"([a-z0-9][a-z0-9.+#/\-]*)"), F.lit(1))
    return F.filter(found, lambda t: ~t.isin(*lx.STOPWORDS) & ((F.length(t) > 1) | t.isin(*lx.SHORT_KEEP_TOKENS)))


def ngrams(c: Column, size: int = 3) -> Column:
    """Distinct character n-grams of the text without white space; a shorter text is its own; empty gives none."""
    t = F.replace(normalize_text(c), F.lit(" "), F.lit(""))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - size + 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(size)))
    return F.when(F.length(t) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(grams))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def doc_type(c: Column) -> Column:
    t = F.lower(stringify(c))
    w = reduce(lambda w, kv: w.when(any_of(t, kv[1]), kv[0]), [*lx.DOC_TYPE_WORDS.items()][1:], F.when(any_of(t, lx.DOC_TYPE_WORDS["cv"]), "cv"))
    return w.otherwise("unknown")


def infer_doc_type(value: Column, column_name: str, fallback: str) -> Column:
    """The value's type, else that of the column's name, else the fallback's."""
    return F.coalesce(*(F.nullif(doc_type(x), F.lit("unknown")) for x in (value, F.lit(column_name), F.lit(fallback))), F.lit("unknown"))


def language(c: Column) -> Column:
    t = F.lower(stringify(c))
    return F.when(t == "", "unknown").when(t.startswith("en"), "en").otherwise(t)


def _canonical(c: Column, aliases: dict[str, str], closed) -> Column:
    key = F.regexp_replace(F.regexp_replace(F.upper(stringify(c)), "[^A-Z0-9]+", "_"), "^_+|_+$", "")
    table = F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv))
    v = F.coalesce(F.try_element_at(table, key), key)
    return F.when(v.isin(*closed), v)


def entity_label(c: Column) -> Column:
    return _canonical(c, lx.ENTITY_LABEL_ALIASES, lx.ENTITY_LABELS)


def fact_type(c: Column) -> Column:
    return _canonical(c, lx.FACT_TYPE_ALIASES, lx.FACT_TYPES)


def foreign_label(c: Column, label_map: dict[str, str] | None = None) -> Column:
    """A third party's label: the map by the whole, by the part before a colon, then by both in capitals; then aliases."""
    raw = stringify(c)
    head = strip(F.substring_index(raw, ":", 1))
    m = F.create_map(*(F.lit(x) for kv in (label_map or {"": ""}).items() for x in kv))
    mapped = F.coalesce(*(F.try_element_at(m, x) for x in (raw, head, F.upper(raw), F.upper(head))), head)
    key = F.replace(F.upper(strip(mapped)), F.lit(" "), F.lit("_"))
    v = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in lx.SOURCE_LABEL_ALIASES.items() for x in kv)), key), key)
    return F.when(v.isin(*lx.ENTITY_LABELS), v)


def fact_operator(raw: Column, kind: Column, mandatory: Column) -> Column:
    v = F.lower(stringify(raw))
    has = lambda *ts: any_of(v, ts)
    return (
        F.when(v.isin("=", "=="), "=")
        .when(v.isin(">", "<", ">=", "<="), v)
        .when(has("preferred", "nice to have"), "preferred")
        .when(has("at least", "minimum", "min ", "or more"), ">=")
        .when(has("less than"), "<")
        .when(has("no more than", "at most"), "<=")
        .when(v.isin("required", "must", "mandatory"), F.when(kind == "EXPERIENCE_YEARS", ">=").otherwise("unknown"))
        .when(~mandatory & kind.isin("EXPERIENCE_YEARS", "DEGREE", "CERTIFICATION"), "=")
        .otherwise("unknown")
    )


def retry_seconds(c: Column) -> Column:
    """Seconds of a delay such as 31s, 1500ms, 2m, 1h or 7; null where it is none."""
    t = F.lower(stringify(c))
    p = r"^(\d+(?:\.\d+)?)(ms|s|m|h)?$"
    unit = F.regexp_extract(t, p, 2)
    factor = F.when(unit == "ms", 0.001).when(unit == "m", 60.0).when(unit == "h", 3600.0).otherwise(1.0)
    return F.when(t.rlike(p), F.regexp_extract(t, p, 1).try_cast("double") * factor)


def backoff_seconds(attempt: Column, retry_after: Column) -> Column:
    return F.coalesce(retry_after, F.least(F.lit(30.0), 2.0 * attempt))


def transient_status(c: Column) -> Column:
    return c.isin(429, 500, 502, 503, 504)


def record_id(source_id: Column, row_index: Column, column: str, text: Column) -> Column:
    by_row = F.concat(F.lit("row-"), row_index.cast("string"), F.lit(f":{column}:"), F.substring(F.sha1(text), 1, 12))
    return F.when(stringify(source_id) != "", F.concat(stringify(source_id), F.lit(f":{column}"))).otherwise(by_row)


def chunk_id(record: Column, index: Column, start: Column) -> Column:
    return F.concat(F.lit("chunk-"), F.substring(F.sha1(F.concat_ws("|", record, index.cast("string"), start.cast("string"))), 1, 16))


def estimated_tokens(c: Column) -> Column:
    return F.greatest(F.lit(1).cast("bigint"), F.floor((F.octet_length(c) + 3) / 4).cast("bigint"))


def unfenced(c: Column) -> Column:
    """JSON of a model's answer without code fences around it."""
    t = stringify(c)
    return F.when(t.startswith("```"), F.regexp_replace(F.regexp_replace(t, r"^```(?:json)?\s*", ""), r"\s*```$", "")).otherwise(t)


def strip_prefixes(c: Column, prefixes) -> Column:
    """Any of the prefixes off the start, again and again, with the blanks behind them."""
    return F.regexp_replace(c, "^(?:(?:" + "|".join(literal(p) for p in prefixes) + r")\s*)+", "")


def first_of(df, *names: str) -> Column:
    """First non-empty of the columns of these names, compared by letters and digits only; empty if there is none."""
    canon = lambda s: "".join(ch for ch in s.lower() if ch.isascii() and ch.isalnum())
    have = {canon(c): c for c in df.columns}
    found = [F.nullif(stringify(F.col(f"`{have[canon(n)]}`")), F.lit("")) for n in names if canon(n) in have]
    return F.coalesce(*found, F.lit(""))
