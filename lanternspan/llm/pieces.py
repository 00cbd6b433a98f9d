"""Problem 2: splitting oversized items at natural boundaries."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows

#: Ends of paragraphs, sentences and words, strongest first; a cut lies before the matched blank.
_PARAGRAPH = re.compile(r"(?<=\S)(?=[ \t\r]*\n[ \t\r]*\n)")
_LINE = re.compile(r"(?<=\S)(?=[ \t\r]*\n)")
_SENTENCE = re.compile(r"[.!?…。]['\"”’)\]]*(?=\s)")
_WORD_END = re.compile(r"(?<=\S)(?=\s)")


def boundaries(text: str) -> list[list[int]]:
    """Cut positions of each strength: paragraph, line, sentence and word ends."""
    return [
        [m.end() for m in _PARAGRAPH.finditer(text)],
        [m.end() for m in _LINE.finditer(text)],
        [m.end() for m in _SENTENCE.finditer(text)],
        [m.end() for m in _WORD_END.finditer(text)],
    ]


def _nearest(at: list[int], target: float, lo: int, hi: int) -> int | None:
    i, j = bisect_left(at, lo), bisect_right(at, hi)
    return min(at[i:j], key=lambda p: (abs(p - target), p), default=None)


def cut(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of pieces of at most `limit` characters; each starts `overlap` characters before the last one's end.

    The smallest number of pieces is computed first; their ends get equally spaced targets and snap to the
    strongest boundary within an eighth of the limit, or else to the strongest one that the limit allows. If a
    piece can't hold the limit, there is one piece more. A text within the limit is one piece; an empty text none.
    """
    n = len(text)
    if n <= limit:
        return [(0, n)] if n else []
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than the limit")
    strengths = boundaries(text)
    count, near = -(-(n - overlap) // (limit - overlap)), max(1, limit // 8)
    while True:
        out, start = [], 0
        for k in range(count, 1, -1):
            lo, hi = start + overlap + 1, min(start + limit, n - 1)
            lo = max(lo, n - (k - 1) * (limit - overlap))  # what remains must fit into k - 1 pieces
            if lo > hi:
                break
            target = start + overlap + (n - start - overlap) / k
            end = None
            for a, b in ((max(lo, int(target) - near), min(hi, int(target) + near)), (lo, hi)):
                end = next((p for s in strengths if (p := _nearest(s, target, a, b)) is not None), None)
                if end is not None:
                    break
            if end is None:
                if k > 1 and count < 2 * n and _loosen(strengths[-1], start, overlap, limit, n):
                    break  # a boundary exists that this number of pieces can't use
                end = max(lo, min(hi, int(target)))
            out.append((start, end))
            start = end - overlap
        else:
            if n - start <= limit:
                return [*out, (start, n)]
        count += 1


def _loosen(words: list[int], start: int, overlap: int, limit: int, n: int) -> bool:
    return _nearest(words, start + limit, start + overlap + 1, min(start + limit, n - 1)) is not None


def split_oversized(df: DataFrame, key: str, text: str, kind: str, limit: int, overlap: int = 120) -> DataFrame:
    """(item_kind, item_key, piece_index, piece_start, piece_end, text) of the texts over the limit.

    Lengths and offsets count code points. Texts within the limit, empty and null ones give no rows, as does a
    null key; rows sent twice give their pieces once. Filter and dedupe stay in the JVM, so Python sees
    oversized texts only. A text without any blank is cut at the equally spaced targets.
    """
    over = df.select(F.col(key).cast("string").alias("item_key"), F.col(text).cast("string").alias("t")).where((F.length("t") > limit) & F.col("item_key").isNotNull())
    over = over.withColumn("h", F.xxhash64("t")).dropDuplicates(["item_key", "h"]).select("item_key", "t")

    def run(batches):
        import pyarrow as pa

        for item, t in arrow_rows(batches):
            p = cut(t, limit, overlap)
            yield pa.RecordBatch.from_arrays(
                [pa.array([kind] * len(p)), pa.array([item] * len(p)), pa.array(range(len(p)), pa.int64()), pa.array([a for a, _ in p], pa.int64()), pa.array([b for _, b in p], pa.int64()), pa.array([t[a:b] for a, b in p], pa.string())],
                ["item_kind", "item_key", "piece_index", "piece_start", "piece_end", "text"],
            )

    return over.mapInArrow(run, "item_kind string, item_key string, piece_index bigint, piece_start bigint, piece_end bigint, text string")


def p2_pieces(spark, d):
    docs = split_oversized(spark.read.parquet(f"{d}/documents.parquet"), "doc_id", "text", "document", 6000)
    return docs.unionByName(split_oversized(spark.read.parquet(f"{d}/chunk_records.parquet"), "feature_id", "text", "chunk", 1200))


def p2_found(spark, d):
    return p2_pieces(spark, d).select("item_kind", "item_key").distinct()
