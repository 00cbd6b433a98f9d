"""Problem 9: evaluation texts leaking into training text."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, WordHasher, arrow_rows, in_batches, mix64, shingles

#: Item windows up to which index and items travel to every task (some 100 bytes each); beyond it sketches are joined.
MAX_INDEX = 500_000
#: Bits of the filter that keeps documents' windows out of that join, at most (64 MB); a full filter keeps fewer out.
MAX_FILTER_BITS = 1 << 29


def size_class(n_words: int, run: int) -> int:
    """The least size of the items in this one's partition: run, 2 run, 4 run and so on."""
    return run << max(0, (n_words // run).bit_length() - 1)


def needed(n_words: int, run: int, share: float) -> int:
    """Consecutive words that an item of this size must have in common with a document."""
    return max(run, math.ceil(share * n_words))


def window_sketches(h: np.ndarray, width: int, k: int, minima: int) -> np.ndarray:
    """For each window of `width` words one key, made of the least of its shingles of k words under `minima` orders."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    s, key = shingles(h, k), np.zeros(n, np.uint64)
    for j in range(minima):
        m, have, want = (mix64(s ^ np.uint64(j * 0x9E3779B97F4A7C15 % 2**64)) if j else s), 1, width - k + 1
        while have * 2 <= want:
            m = np.minimum(m[:-have], m[have:])
            have *= 2
        if want > have:
            m = np.minimum(m[: have - want], m[want - have :])
        key = mix64(key * np.uint64(0xD6E8FEB86659FD93) + m[:n])
    return key


def anchors(h: np.ndarray, at: np.ndarray, width: int, k: int) -> np.ndarray:
    """Position of the least shingle of each window that starts at `at`: equal windows have it at the same place."""
    return at + np.lib.stride_tricks.sliding_window_view(shingles(h, k), width - k + 1)[at].argmin(1)


def common_run(a: list[str], i: int, b: list[str], j: int) -> tuple[int, int]:
    """(start in a, length) of the longest run of equal words through a[i] and b[j]; length 0 if these differ."""
    lo, n, m = 0, len(a), len(b)
    while lo < min(i, j) and a[i - lo - 1] == b[j - lo - 1]:
        lo += 1
    hi = 0
    while i + hi < n and j + hi < m and a[i + hi] == b[j + hi]:
        hi += 1
    return (i - lo, lo + hi) if hi else (i, 0)


def _window_ids(words: list[str], width: int) -> list[int]:
    """A number for each window; windows with the same words have the same."""
    seen: dict[tuple, int] = {}
    return [seen.setdefault(tuple(words[i : i + width]), len(seen)) for i in range(len(words) - width + 1)]


class _Index:
    """Items of one size partition: keys of their windows, where the least shingle lies, and the words."""

    def __init__(self, items: list[tuple[int, list[str]]], width: int, k: int, minima: int, run: int, share: float):
        self.width, self.items, hasher = width, items, WordHasher()
        self.ids = [_window_ids(w, width) for _, w in items]
        self.need = [needed(len(w), run, share) for _, w in items]
        places: dict[tuple[int, int, int], None] = {}
        for n, (_, words) in enumerate(items):
            h = hasher(words)
            keys = window_sketches(h, width, k, minima)
            places |= dict.fromkeys(zip(keys.tolist(), [n] * len(keys), anchors(h, np.arange(len(keys)), width, k).tolist()))
        rows = sorted(places)
        self.keys = np.array([r[0] for r in rows], np.uint64)
        self.place = [(n, p) for _, n, p in rows]

    def search(self, h: np.ndarray, words: list[str], k: int, minima: int) -> list[tuple[int, int, int]]:
        """(item, shared windows, longest run) of the items that the words share enough with; runs are compared word by word."""
        keys = window_sketches(h, self.width, k, minima)
        if not len(keys) or not len(self.keys):
            return []
        at = np.searchsorted(self.keys, keys)
        hit = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == keys)
        if not len(hit):
            return []
        end = np.searchsorted(self.keys, keys[hit], "right")
        runs: dict[int, dict[int, int]] = {}
        covered: dict[tuple[int, int], int] = {}
        for p, lo, hi in sorted({*zip(anchors(h, hit, self.width, k).tolist(), at[hit].tolist(), end.tolist())}):
            for n, s in self.place[lo:hi]:
                if covered.get((n, p - s), -1) > p:
                    continue
                start, length = common_run(self.items[n][1], s, words, p)
                covered[n, p - s] = p - s + start + length
                if length >= self.width:
                    runs.setdefault(n, {})[start] = max(length, runs.get(n, {}).get(start, 0))
        out = []
        for n, found in runs.items():
            longest = max(found.values())
            if longest >= self.need[n]:
                ids = self.ids[n]
                out.append((self.items[n][0], len({ids[i] for s, length in found.items() for i in range(s, s + length - self.width + 1)}), longest))
        return out


def _words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def containment_search(items: DataFrame, docs: DataFrame, item_key: str = "item_id", doc_key: str = "doc_id", text: str = "text", run: int = 20, k: int = 5, share: float = 0.0, minima: int = 2, max_index: int = MAX_INDEX) -> DataFrame:
    """(item, doc, shared_windows, item_windows, longest_run): pairs with enough consecutive words in common, namely
    at least `run` and at least `share` of the item's words.

    Items are partitioned by size (run words and more, 2 run, 4 run ...). In each partition the threshold becomes a
    width: the consecutive words that its smallest item needs. Items and documents are cut to all windows of that
    width, so a short item and a long document are compared at equal size, where containment is equality: a contained
    window has the same least shingles of k words, under each of `minima` orders, for certain. Windows that agree in
    all of them are candidates, so recall doesn't depend on chance; they are aligned at the least shingle and then
    compared word by word as far as the words agree, which decides.
    Partitions with one width are searched at once. Items shorter than `run` words, null and empty texts and null keys
    match nothing; copies of a text match alike; of rows with one item key and different texts each counts as an item.
    Up to `max_index` item windows the index goes to every task and documents aren't shuffled; beyond, documents'
    windows that pass a Bloom filter of the items' keys are joined by key, and their words compared.
    """
    if not 1 <= k <= run:
        raise ValueError("shingles must have at least one word and no more than a run")
    spark = docs.sparkSession
    it = items.select(F.col(item_key).cast("bigint").alias("key"), F.col(text).cast("string").alias("t")).where("key is not null").distinct()
    dc = docs.select(F.col(doc_key).cast("bigint").alias("key"), F.col(text).cast("string").alias("t")).where("key is not null and t is not null")
    names = [item_key, doc_key, "shared_windows", "item_windows", "longest_run"]
    width_of = lambda n: needed(size_class(n, run), run, share)

    def measure(batches):
        import pyarrow as pa

        for rows in in_batches(arrow_rows(batches)):
            out = [(key, t, width_of(n), n - width_of(n) + 1) for key, t in rows if (n := len(_words(t))) >= run]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, ty) for x, ty in zip(zip(*out), (pa.int64(), pa.string(), pa.int32(), pa.int64()))], ["key", "t", "width", "n"])

    sized = it.mapInArrow(measure, "key bigint, t string, width int, n bigint")
    per_width = {r["width"]: r["n"] for r in sized.groupBy("width").agg(F.sum("n").alias("n")).collect()}  # a row per partition
    if sum(per_width.values()) > max_index:
        return _joined(sized, dc, sorted(per_width), run, k, share, minima, sum(per_width.values())).toDF(*names)
    held: dict[int, list] = {}
    for r in sized.collect() if per_width else ():  # at most max_index windows
        held.setdefault(r["width"], []).append((r["key"], _words(r["t"])))
    sent = spark.sparkContext.broadcast([_Index(x, w, k, minima, run, share) for w, x in sorted(held.items())])

    def search(batches):
        import pyarrow as pa

        hasher = WordHasher()
        for rows in in_batches(arrow_rows(batches)):
            out = []
            for doc, t in rows if sent.value else ():
                words = _words(t)
                h = hasher(words)
                out += [(i, doc, n, longest) for index in sent.value for i, n, longest in index.search(h, words, k, minima)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["item", "doc", "n", "longest"])

    found = dc.mapInArrow(search, "item bigint, doc bigint, n bigint, longest bigint").groupBy("item", "doc").agg(F.max("n").alias("n"), F.max("longest").alias("longest"))
    totals: dict[int, int] = {}
    for w, x in held.items():
        for key, words in x:
            totals[key] = max(totals.get(key, 0), len(set(_window_ids(words, w))))
    total = spark.createDataFrame([*totals.items()], "key bigint, item_windows bigint")
    return found.join(F.broadcast(total), F.col("item") == F.col("key")).select("item", "doc", "n", "item_windows", "longest").toDF(*names)


def _joined(sized: DataFrame, dc: DataFrame, widths: list[int], run: int, k: int, share: float, minima: int, windows: int) -> DataFrame:
    """The search for more items than tasks can hold: one equi-join on (width, key), then the words are compared."""
    spark = dc.sparkSession

    def cut(of_item: bool, sent=None):
        def each(batches):
            import pyarrow as pa

            hasher = WordHasher()
            bits = None if sent is None else np.frombuffer(sent.value, np.uint8)
            for rows in in_batches(arrow_rows(batches), 1):
                out = []
                for key, t, *own in rows:
                    words = _words(t)
                    h = hasher(words)
                    for w in own[:1] if of_item else widths:
                        sk = window_sketches(h, w, k, minima)
                        at = np.arange(len(sk)) if bits is None else np.flatnonzero(_has(bits, sk))
                        out += [(key, len(words), w, int(x), int(i), " ".join(words[i : i + w])) for i, x in zip(at.tolist(), sk[at].view(np.int64))]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, ty) for x, ty in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()))], ["id", "size", "width", "k", "at", "w"])

        return each

    shape = "id bigint, size bigint, width int, k bigint, at bigint, w string"
    left = sized.select("key", "t", "width").mapInArrow(cut(True), shape)
    n_bits = min(MAX_FILTER_BITS, 1 << max(16, (16 * windows).bit_length()))
    words = left.select((F.pmod("k", F.lit(n_bits)) / 64).cast("bigint").alias("i"), F.pmod("k", F.lit(64)).cast("int").alias("b"))
    filled = words.groupBy("i").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("v")).toArrow()  # at most n_bits / 64 rows
    table = np.zeros(n_bits // 64, np.int64)
    table[filled.column("i").to_numpy()] = filled.column("v").to_numpy()
    sent = spark.sparkContext.broadcast(table.tobytes())
    right = dc.mapInArrow(cut(False, sent), shape)
    a, b = left.select(F.col("id").alias("item"), "size", "width", "k", F.col("at").alias("i"), "w"), right.select(F.col("id").alias("doc"), "width", "k", F.col("at").alias("j"), "w")
    met = a.join(b, ["width", "k", "w"]).select("item", "doc", "size", "width", "i", "j", "w")
    island = F.col("i") - F.row_number().over(Window.partitionBy("item", "doc", "size", "width", F.col("j") - F.col("i")).orderBy("i"))
    runs = met.withColumn("g", F.struct((F.col("j") - F.col("i")).alias("d"), island.alias("s")))
    longest = runs.groupBy("item", "doc", "size", "width", "g").agg((F.count("*") + F.col("width") - 1).alias("r")).groupBy("item", "doc", "size").agg(F.max("r").alias("longest"))
    enough = longest.where(F.col("longest") >= F.greatest(F.lit(run), F.ceil(F.lit(share) * F.col("size"))))
    shared = met.groupBy("item", "doc", "size").agg(F.countDistinct("w").alias("n"))
    pairs = enough.join(shared, ["item", "doc", "size"]).groupBy("item", "doc").agg(F.max("n").alias("n"), F.max("longest").alias("longest"))
    total = left.groupBy("id", "size").agg(F.countDistinct("w").alias("n")).groupBy("id").agg(F.max("n").alias("item_windows"))
    return pairs.join(total, F.col("item") == F.col("id")).select("item", "doc", "n", "item_windows", "longest")


def _has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys' bits are set, as _joined has set them in 64-bit words (little-endian)."""
    n = np.uint64(len(bits) * 8)
    p = keys % n  # a power of two, so the remainder is the same for signed numbers
    return (bits[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 > 0


def p9_found(spark, d):
    return containment_search(spark.read.parquet(f"{d}/eval_items.parquet"), spark.read.parquet(f"{d}/documents.parquet")).select("item_id", "doc_id")


def p9_leaks(spark, d):
    return containment_search(spark.read.parquet(f"{d}/eval_items.parquet"), spark.read.parquet(f"{d}/documents.parquet"))
