"""Problem 4: near-duplicate records with small edits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, WordHasher, arrow_rows, in_batches, shingles, spread_rows
from .components import components


#: Minima in a block and bits kept of each: a block has 40 bits, so different texts seldom share one by chance.
ROWS, BITS = 4, 10
#: Bytes of a block.
WIDE = ROWS * BITS // 8
#: Members of a block from which on pairs of blocks stand in for it.
HOT = 400
#: Hashes taken through the permutations at one time; they fit a core's cache.
PART = 16_384


def block_shape(threshold: float, miss: float = 1e-6, rows: int = ROWS) -> int:
    """Blocks of `rows` minima needed so that a pair at the threshold shares none with probability `miss`."""
    return max(1, int(np.ceil(np.log(miss) / np.log(1 - threshold**rows))))


def fingerprints(sets: list[np.ndarray], size: int, seed: int = 7) -> np.ndarray:
    """For each set of hashes `size` numbers of BITS bits, of its least value under each of `size` permutations.

    Two sets agree at a number with the probability of their Jaccard similarity (plus 2**-BITS of the rest), so the
    Hamming distance of two fingerprints measures it. No set may be empty.
    """
    rng = np.random.default_rng(seed)
    mul, add = rng.integers(1, 2**32, size, np.uint32) | np.uint32(1), rng.integers(0, 2**32, size, np.uint32)
    out = np.empty((len(sets), size), np.uint16)
    first = 0
    while first < len(sets):
        last, n = first, 0
        while last < len(sets) and (last == first or n + len(sets[last]) <= PART):
            n += len(sets[last])
            last += 1
        x = (np.concatenate(sets[first:last]) >> np.uint64(32)).astype(np.uint32)
        at, y = np.cumsum([0, *map(len, sets[first : last - 1])]), np.empty_like(x)
        for j in range(size):
            np.multiply(x, mul[j], out=y)
            np.add(y, add[j], out=y)
            least = np.minimum.reduceat(y, at)
            least ^= least >> np.uint32(15)
            out[first:last, j] = (least * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS)
        first = last
    return out


def packed(prints: np.ndarray) -> np.ndarray:
    """Fingerprints as bytes, WIDE for each block of ROWS numbers."""
    block = np.zeros((len(prints), prints.shape[1] // ROWS), "<u8")
    for r in range(ROWS):
        block |= prints[:, r::ROWS].astype(np.uint64) << np.uint64(BITS * r)
    return np.ascontiguousarray(block.view(np.uint8).reshape(*block.shape, 8)[:, :, :WIDE]).reshape(len(prints), -1)


def hamming(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Numbers in which packed fingerprints differ."""
    wide = np.zeros((len(x), x.shape[1] // WIDE, 8), np.uint8)
    wide[:, :, :WIDE] = (x ^ y).reshape(len(x), -1, WIDE)
    differ = wide.view("<u8")[:, :, 0]
    mask = np.uint64((1 << BITS) - 1)
    return sum(((differ >> np.uint64(BITS * r)) & mask > 0).sum(1) for r in range(ROWS))


def _shingled(docs: DataFrame, key: str, text: str, k: int, min_words: int):
    """Rows (key, word hashes) of the documents with enough words, by batch."""

    def each(batches):
        hasher = WordHasher()
        for rows in in_batches(arrow_rows(batches)):
            out = []
            for doc, t in rows:
                words = WORD.findall(t.lower()) if t else []
                if len(words) >= max(min_words, k) and doc is not None:
                    out.append((doc, hasher(words)))
            if out:
                yield out

    return docs.select(F.col(key).cast("bigint").alias("doc"), F.col(text).cast("string").alias("t")), each


class NearDuplicates:
    """Documents whose sets of k consecutive words have a Jaccard similarity of at least `threshold`.

    1. Every document of at least `min_words` words gets a fingerprint and the hash of its word sequence; equal
       sequences form a class, and only its smallest id goes on, so copies never multiply pairs.
    2. Pigeonhole blocks: fingerprints are cut into blocks; close ones share at least one but with the probability
       `miss` at the threshold, and less above it, so a join on (block number, block) finds the candidates. A block of
       more than HOT texts is split: its members meet where they share any second block as well, which close
       ones do with the same probability, so boilerplate in many texts doesn't pair them all.
    3. The Hamming distance of the whole fingerprints drops the far ones, at five standard deviations from the
       threshold; the exact Jaccard similarity of the word shingles (64-bit hashes) decides.
    Null and short texts take no part; a null id is left out; a repeated id counts once.
    """

    def __init__(self, docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, threshold: float = 0.8, min_words: int = 1, miss: float = 1e-6, hot: int = HOT):
        self.scratch = scratch = Scratch(docs.sparkSession, "neardup")
        blocks = block_shape(threshold, miss)
        size = blocks * ROWS
        spread = float(np.sqrt(threshold * (1 - threshold) / size))
        most = int(size * (1 - threshold + 5 * spread))  # Hamming distance
        base, each = _shingled(spread_rows(docs), key, text, k, min_words)

        def sketch(batches):
            import pyarrow as pa

            for out in each(batches):
                prints = packed(fingerprints([shingles(h, k) for _, h in out], size))
                cls = [int(shingles(h, len(h))[0].view(np.int64)) for _, h in out]
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in out], pa.int64()), pa.array(cls, pa.int64()), pa.array([p.tobytes() for p in prints], pa.binary())], ["doc", "cls", "print"])

        self.members = scratch.table(base.mapInArrow(sketch, "doc bigint, cls bigint, print binary"))
        reps = self.members.groupBy("cls").agg(F.min_by("print", "doc").alias("print"), F.min("doc").alias("rep"))
        self.reps = scratch.table(reps.select("rep", "cls", "print"))

        def together(keyed: DataFrame) -> DataFrame:
            """The rows (rep, i, block) whose block others have too, with their number."""
            return keyed.withColumn("n", F.count("*").over(Window.partitionBy("block"))).where("n > 1")

        def pairs(met: DataFrame) -> DataFrame:
            a, b = met.select(F.col("rep").alias("a"), "block"), met.select(F.col("rep").alias("b"), "block")
            return a.join(b, "block").where("a < b").select("a", "b")

        block = lambda i: F.substring(F.col("print"), i * WIDE + 1, F.lit(WIDE))
        every = F.sequence(F.lit(0), F.lit(blocks - 1))
        keyed = self.reps.select("rep", F.posexplode(F.transform(every, lambda i: F.xxhash64(i, block(i)))).alias("i", "block"))
        met = scratch.table(together(keyed))
        candidates = pairs(met.where(F.col("n") <= hot))
        if not met.where(F.col("n") > hot).isEmpty():
            busy = met.where(F.col("n") > hot).select("rep", "i", "block").join(self.reps.select("rep", "print"), "rep")
            both = F.transform(F.filter(every, lambda j: j != F.col("i")), lambda j: F.xxhash64("block", j, block(j)))
            candidates = candidates.union(pairs(together(busy.select("rep", F.explode(both).alias("block")))))
        candidates = scratch.table(candidates.distinct())

        def near(batches):
            import pyarrow as pa

            for t in batches:
                if t.num_rows:
                    x, y = (np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint8).reshape(t.num_rows, -1) for c in ("x", "y"))
                    yield pa.RecordBatch.from_arrays([t.column(c).filter(pa.array(hamming(x, y) <= most)) for c in ("a", "b")], ["a", "b"])

        p = self.reps.select("rep", "print")
        close = candidates.join(p.toDF("a", "x"), "a").join(p.toDF("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(near, "a bigint, b bigint")
        close = scratch.table(close)

        def sets(batches):
            import pyarrow as pa

            for out in each(batches):
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in out], pa.int64()), pa.array([np.unique(shingles(h, k)).tobytes() for _, h in out], pa.binary())], ["doc", "s"])

        involved = close.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
        s = scratch.table(base.where("doc is not null").join(involved, "doc", "left_semi").dropDuplicates(["doc"]).mapInArrow(sets, "doc bigint, s binary"))

        def exact(batches):
            import pyarrow as pa

            for t in batches:
                js = []
                for x, y in zip(t.column("x").to_pylist(), t.column("y").to_pylist()):
                    u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    both = len(np.intersect1d(u, v, assume_unique=True))
                    js.append(both / (len(u) + len(v) - both))
                yield pa.RecordBatch.from_arrays([t.column("a"), t.column("b"), pa.array(js, pa.float64())], ["a", "b", "similarity"])

        scored = close.join(s.toDF("a", "x"), "a").join(s.toDF("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(exact, "a bigint, b bigint, similarity double")
        #: (a, b, similarity) between the smallest ids of two classes.
        self.links = scratch.table(scored.where(F.col("similarity") >= threshold))
        for done in (met, candidates, close, s):
            scratch.drop(done)

    def pairs(self) -> DataFrame:
        """(doc_a, doc_b), every pair of documents, copies expanded; its size is that of the result asked for."""
        m = self.members.select("doc", "cls").distinct()
        named = m.join(self.reps.select("cls", "rep"), "cls").select("doc", "rep")
        across = self.links.select("a", "b").join(named.toDF("x", "a"), "a").join(named.toDF("y", "b"), "b").select("x", "y")
        several = self.members.groupBy("cls").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("cls")
        n = m.join(several, "cls")
        within = n.select("cls", F.col("doc").alias("x")).join(n.select("cls", F.col("doc").alias("y")), "cls").where("x < y").select("x", "y")
        return across.union(within).select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).distinct()

    def groups(self) -> DataFrame:
        """(doc_id, group_id, class_id, links): a row for each document that took part; no pairs within classes of copies.

        class_id is the smallest id with the same words, links the number of other classes that are near,
        group_id the smallest id reached over links.
        """
        roots = components(self.links.select("a", "b"), self.scratch).toDF("rep", "root")
        n = self.links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
        reps = self.reps.select("cls", "rep").join(roots, "rep", "left").join(n, "rep", "left")
        return self.members.select("doc", "cls").distinct().join(reps, "cls").select(F.col("doc").alias("doc_id"), F.coalesce("root", "rep").alias("group_id"), F.col("rep").alias("class_id"), F.coalesce("links", F.lit(0).cast("bigint")).alias("links"))


def p4_found(spark, d):
    return NearDuplicates(spark.read.parquet(f"{d}/documents.parquet"), k=3, threshold=0.7, min_words=40).pairs()


def p4_groups(spark, d):
    return NearDuplicates(spark.read.parquet(f"{d}/documents.parquet"), k=3, threshold=0.7, min_words=40).groups()
