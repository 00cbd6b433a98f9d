"""Helpers shared by the operators: words, hashes, scratch tables and batches of bounded size."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of Unicode letters and digits, compared in lower case.
WORD = re.compile(r"[^\W_]+")
#: The same in Java's syntax.
JAVA_WORD = r"[\p{L}\p{N}]+"
#: Characters that a Python task holds as numpy arrays at one time.
BATCH_CHARS = 1_500_000


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Where it is unset, a temporary folder serves a local session (tests); on a
    cluster each executor would write to a disk of its own, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not getattr(scratch_dir, "local", None):
        scratch_dir.local = tempfile.mkdtemp(prefix="lanternspan-")
        atexit.register(shutil.rmtree, scratch_dir.local, ignore_errors=True)
    return f"file://{scratch_dir.local}"


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Setting of Spark: whether a query's shuffle files are removed at its end; else they stay until the driver collects garbage.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written to the shared folder, so that lineage is cut and lost executors cost nothing already done."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}", 0

    def table(self, df: DataFrame, free: bool = False) -> DataFrame:
        """With free=True the shuffle files of df leave the disks as soon as the table is written."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        was = self.spark.conf.get(_FREE)
        self.spark.conf.set(_FREE, "true" if free else was)
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(_FREE, was)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that no later plan reads."""
        if path := getattr(df, "_scratch_path", None):
            _delete(self.spark, path)


def record_key(c):
    """Record ids compare without case and surrounding blanks; blank is null."""
    return F.nullif(F.lower(F.regexp_replace(c.cast("string"), r"(?U)^\s+|\s+$", "")), F.lit(""))


def mix64(h: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash (fixed constants of MurmurHash3)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class WordHasher:
    """Hashes of words; a worker's memory of words is emptied when it holds a million."""

    def __init__(self):
        self.seen: dict[str, int] = {}

    def __call__(self, words: list[str]) -> np.ndarray:
        seen, digest = self.seen, xxhash.xxh3_64_intdigest
        try:
            return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(seen) > 1_000_000:
                seen.clear()
            for w in words:
                if w not in seen:
                    seen[w] = digest(w)
        return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive entries of h."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    return mix64(out)


def char_codes(text: str) -> np.ndarray:
    """Code points; a lone surrogate is kept as its own value."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def in_batches(rows: Iterator[tuple], text_at: int = -1, chars: int = BATCH_CHARS) -> Iterator[list[tuple]]:
    """Rows in lists whose texts hold about `chars` characters, so that memory doesn't depend on row size."""
    out, n = [], 0
    for r in rows:
        out.append(r)
        n += len(r[text_at] or "") + 50
        if n >= chars:
            yield out
            out, n = [], 0
    if out:
        yield out


def arrow_rows(batches) -> Iterator[tuple]:
    """Rows of the Arrow batches that mapInArrow hands over."""
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def spread_rows(df: DataFrame) -> DataFrame:
    """df with a partition or more for each core: small files with few row groups would leave most cores idle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def table_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of df; for scans the size of the files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def text_bytes(df: DataFrame, column: str) -> int:
    """About the bytes of a table whose texts make up most of it: Catalyst's estimate of all its files (for one column it
    would take a string for 20 bytes), else (a petabyte or more is a guess) a pass over the column."""
    n = table_bytes(df)
    return n if n < 1 << 50 else int(df.agg(F.sum(F.octet_length(column))).first()[0] or 0)


def hash_sample(df: DataFrame, key: str, wanted, size: int, share: float) -> DataFrame:
    """The `size` rows that are wanted (a condition) with the smallest hashes of their keys.

    A bound on the hash, from the number of rows and the least share of them that is wanted, keeps what tasks send
    to the driver at a few times the sample, however many tasks there are; where fewer are wanted, fewer come.
    """
    n = df.select(key).count()
    bound = int(-(2**63) + min(1.0, size / share / max(n, 1)) * (2**64 - 1))
    h = F.xxhash64(key)
    return df.where(h <= F.lit(min(bound, 2**63 - 1))).where(wanted).orderBy(h, key).limit(size)
