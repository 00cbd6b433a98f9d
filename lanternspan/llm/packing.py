"""Problem 8: filling fixed-capacity containers with items."""

from __future__ import annotations

import heapq
import importlib.util
import os
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_rows, in_batches

#: A word, or any other single character that isn't white space (Java syntax).
WORD_OR_SIGN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\p{IsWhite_Space}]"


class _OpenContainers:
    """Open containers by room left, in a tree over rooms; each node knows the cheapest container below it."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.heaps: list[list] = [[] for _ in range(capacity + 1)]
        self.best = [(np.inf, -1)] * (2 * self.size)

    def put(self, room: int, cost: float, c: int) -> None:
        heapq.heappush(self.heaps[room], (cost, c))
        self._up(room)

    def _up(self, room: int) -> None:
        i, best = room + self.size, self.best
        best[i] = self.heaps[room][0] if self.heaps[room] else (np.inf, -1)
        while i > 1:
            i >>= 1
            new = min(best[2 * i], best[2 * i + 1])
            if best[i] == new:
                break
            best[i] = new

    def tightest(self, least: int) -> int | None:
        """The smallest room of at least `least` that a container has."""
        i, best = least + self.size, self.best
        while best[i][1] < 0:
            while i & 1:  # a right child: on to the parent
                i >>= 1
                if i == 0:
                    return None
            i += 1
            if i & (i - 1) == 0:  # past the right edge of the tree
                return None
        while i < self.size:
            i = 2 * i if best[2 * i][1] >= 0 else 2 * i + 1
        return i - self.size

    def take(self, least: int, most: int) -> tuple[int, float, int] | None:
        """(room, cost, container) of the cheapest with a room from `least` to `most`; it leaves the structure."""
        lo, hi, at = least + self.size, min(most, len(self.heaps) - 1) + 1 + self.size, 0
        found = (np.inf, -1)
        while lo < hi:
            if lo & 1:
                if self.best[lo] < found:
                    found, at = self.best[lo], lo
                lo += 1
            if hi & 1:
                hi -= 1
                if self.best[hi] < found:
                    found, at = self.best[hi], hi
            lo >>= 1
            hi >>= 1
        if found[1] < 0:
            return None
        while at < self.size:
            at = 2 * at if self.best[2 * at] == found else 2 * at + 1
        cost, c = heapq.heappop(self.heaps[room := at - self.size])
        self._up(room)
        return room, cost, c


def pack(sizes: np.ndarray, capacity: int, linear: float = 1.0, quadratic: float = 1.0 / 1024, waste: float = 0.005, bands: tuple[float, ...] = (1.0, 0.5, 0.25, 0.06, 0.015, 0.004, 0.0)) -> np.ndarray:
    """Container of every item. Items go in descending order to the cheapest container among those with room.

    A container's cost is the sum of linear*n + quadratic*n*n over its items. Containers from the tightest that holds
    the item up to a band of room above it compete by cost; the band is a share of the capacity. A band of 1 lets
    all compete, which balances cost best and leaves the most room unused; narrower ones balance less and waste less.
    The widest band whose outcome exceeds the least possible number of containers by no more than `waste` is kept, or
    else the outcome with the fewest containers. sizes: 1 to capacity.
    """
    order = np.argsort(-sizes, kind="stable")
    least, best = -(-int(sizes.sum()) // capacity), None
    for share in bands:
        band = int(share * capacity)
        rooms, out = _OpenContainers(capacity), np.empty(len(sizes), np.int64)
        rooms.heaps[capacity] = [(0.0, c) for c in range(least)]
        rooms._up(capacity)
        used = least
        for i in order:
            size = int(sizes[i])
            tight = rooms.tightest(size)
            if tight is None:
                room, cost, c = capacity, 0.0, used
                used += 1
            else:
                room, cost, c = rooms.take(size, tight + band)
            out[i] = c
            rooms.put(room - size, cost + linear * size + quadratic * size * size, c)
        if best is None or used < best[0]:
            best = used, out
        if used <= least * (1 + waste):
            break
    return best[1]


def cost_spread(sizes: np.ndarray, containers: np.ndarray, linear: float = 1.0, quadratic: float = 1.0 / 1024) -> float:
    """Standard deviation of the containers' costs, as a share of their mean."""
    n = sizes.astype(float)
    cost = np.bincount(np.unique(containers, return_inverse=True)[1], linear * n + quadratic * n * n)
    return float(cost.std() / cost.mean())


def count_words_and_signs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, tokens): a token is a word or any other single character that isn't white space; counted in the JVM."""
    return df.select(F.col(key).cast("bigint").alias(key), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_OR_SIGN)), F.lit(0)).cast("bigint").alias("tokens"))


def _tokenizer(pattern: str, ranks: bytes):
    import base64

    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def bpe_length(bpe, text: str, part: int = 100_000) -> int:
    """Tokens of the text. A long text is encoded in parts that end before a blank between two signs that aren't blank:
    there the tokenizer's pattern ends a match in any case, so the sum is exact. A part without such a place grows."""
    n, at = 0, 0
    while len(text) - at > part:
        m = _BREAK.search(text, at + part)
        if not m:
            break
        n += len(bpe.encode_ordinary(text[at : m.start() + 1]))
        at = m.start() + 1
    return n + len(bpe.encode_ordinary(text[at:]))


#: A sign, a single blank and another sign; a match of the pattern may start with a blank, but none goes on through one.
_BREAK = re.compile(r"\S(?= \S)")


def count_bpe(df: DataFrame, key: str, text: str, path: str = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """(key, tokens) of a public byte-level BPE; path: its ranks, beside an __init__.py with the PATTERN it was made with.

    Both are read at the driver and broadcast (under 1 MB), so that workers need no files.
    """
    spec = importlib.util.spec_from_file_location("_tokenizer_files", os.path.join(os.path.dirname(path), "__init__.py"))
    spec.loader.exec_module(module := importlib.util.module_from_spec(spec))
    with open(path, "rb") as f:
        sent = df.sparkSession.sparkContext.broadcast((module.PATTERN, f.read()))

    def run(batches):
        import pyarrow as pa

        bpe = _tokenizer(*sent.value)
        for rows in in_batches(arrow_rows(batches)):
            n = [bpe_length(bpe, t) if t else 0 for _, t in rows]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array(n, pa.int64())], [key, "tokens"])

    return df.select(F.col(key).cast("bigint").alias(key), F.col(text).cast("string")).mapInArrow(run, f"{key} bigint, tokens bigint")


def fill_containers(sizes: DataFrame, key: str, capacity: int = 1024, shard_items: int = 20_000) -> DataFrame:
    """(key, piece_index, token_start, tokens, container) from (key, tokens).

    Items over the capacity are the only ones split: into full pieces, each a container of its own, and a rest
    that is packed like a whole item. Items are spread by a hash over shards of about `shard_items`, which are
    packed independently, so a task's work is bounded; a shard leaves at most its last containers open.
    Items without tokens (null or empty texts) come out with tokens 0 and container null; null keys are kept.
    """
    spark = sizes.sparkSession
    scratch = Scratch(spark, "packing")
    t = scratch.table(sizes.select(F.col(key).alias("k"), "tokens"))
    shards = max(1, -(-t.count() // shard_items))
    full = F.expr(f"transform(sequence(0, cast((tokens - 1) div {capacity} as int)), i -> struct(cast(i as bigint) as piece_index, cast(i * {capacity} as bigint) as token_start, least(tokens - i * {capacity}, {capacity}) as n))")
    pieces = t.where("tokens > 0").select("k", F.inline(full)).withColumn("shard", F.pmod(F.xxhash64("k", "piece_index"), F.lit(shards)))

    def run(pdf):
        pdf = pdf.sort_values(["n", "k", "piece_index"], ascending=[False, True, True], kind="stable", ignore_index=True)
        shard = int(pdf["shard"].iloc[0])
        c = pack(pdf["n"].to_numpy(), capacity)
        return pdf.assign(container=[f"{shard}-{x}" for x in c])[["k", "piece_index", "token_start", "n", "container"]]

    packed = pieces.groupBy("shard").applyInPandas(run, "k bigint, piece_index bigint, token_start bigint, n bigint, container string")
    empty = t.where("tokens = 0").select("k", F.lit(0).cast("bigint"), F.lit(0).cast("bigint"), F.lit(0).cast("bigint"), F.lit(None).cast("string"))
    return packed.union(empty).toDF(key, "piece_index", "token_start", "tokens", "container")


def p8_found(spark, d):
    sizes = count_words_and_signs(spark.read.parquet(f"{d}/documents.parquet"), "doc_id", "text")
    return fill_containers(sizes, "doc_id", 1024).where("piece_index > 0").select("doc_id").distinct()


def p8_containers(spark, d):
    return fill_containers(count_bpe(spark.read.parquet(f"{d}/documents.parquet"), "doc_id", "text"), "doc_id", 1024)
