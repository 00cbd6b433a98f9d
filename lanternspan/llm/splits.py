"""Problem 1: splits that keep related records together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, record_key
from .components import components

#: Largest subset-sum bitset; a residual beyond it is first reduced by taking whole groups in descending order.
MAX_BITS = 4_000_000


def choose_counts(histogram: dict[int, int], ratios: list[float], max_bits: int = MAX_BITS) -> list[dict[int, int]]:
    """How many groups of each size every split takes; the first split takes what the others leave.

    histogram: size -> number of groups; it has at most sqrt(2 N) entries for N members. Each later split first
    takes its share of every size, then a bitset over the sizes' remaining multiplicities (in binary parts) finds
    the reachable total closest to its target. Ties take the smaller total.
    """
    left, total = dict(histogram), sum(s * m for s, m in histogram.items())
    out: list[dict[int, int]] = []
    for r in ratios[1:]:
        target = round(total * r)
        take = {s: min(left[s], int(histogram[s] * r)) for s in left}
        rest = target - sum(s * m for s, m in take.items())
        for s in sorted(left, reverse=True):
            while rest > max_bits and s <= rest and take[s] < left[s]:
                k = max(1, min(left[s] - take[s], (rest - max_bits) // s))
                take[s] += k
                rest -= k * s
        rest = max(0, rest)
        largest = max((s for s in left if take[s] < left[s]), default=0)
        width = min(rest + largest, rest * 2) + 1
        mask, parts, bits, history = (1 << width) - 1, [], 1, []
        for s in sorted(left):
            m = min(left[s] - take[s], width // s)
            k = 1
            while m > 0:
                part = min(k, m)
                history.append(bits)
                parts.append((s, part))
                bits |= (bits << (s * part)) & mask
                m -= part
                k *= 2
        best = next(t for d in range(width + 1) for t in (rest - d, rest + d) if 0 <= t < width and bits >> t & 1)
        for (s, part), before in zip(reversed(parts), reversed(history)):
            if not before >> best & 1:
                take[s] += part
                best -= s * part
        for s, k in take.items():
            left[s] -= k
        out.append(take)
    return [left, *out]


def related_groups(documents: DataFrame, scratch: Scratch) -> DataFrame:
    """(record, group_author, n_records) for each record with an author: its group's smallest author_id and number of records.

    Only records under two or more authors join authors, so the graph over authors is built from those alone.
    """
    pairs = scratch.table(
        documents.select(record_key(F.col("record_id")).alias("record"), F.col("author_id").cast("bigint").alias("author"))
        .where("record is not null and author is not null")
        .distinct()
    )
    spans = pairs.groupBy("record").agg(F.min("author").alias("a"), F.max("author").alias("z"))
    bridges = pairs.join(spans.where("a <> z"), "record").select("a", F.col("author").alias("b"))
    roots = components(bridges, scratch).toDF("a", "root")
    record = spans.select("record", "a").join(roots, "a", "left").select("record", F.coalesce("root", "a").alias("group_author"))
    record = scratch.table(record)
    sizes = record.groupBy("group_author").agg(F.count("*").alias("n_records"))
    return record.join(sizes, "group_author")


def feature_groups(features: DataFrame, documents: DataFrame, scratch: Scratch) -> DataFrame:
    """(feature_id, record, group_author, n_records), one row for each distinct non-null feature_id.

    The record is the part of feature_id before "::chunk-", since record_id may be null or spelled differently.
    A record without any author is its own group: group_author is null and n_records 1.
    """
    f = features.select("feature_id").where("feature_id is not null").distinct()
    f = f.select("feature_id", record_key(F.substring_index("feature_id", "::chunk-", 1)).alias("record"))
    groups = related_groups(documents, scratch)
    return f.join(groups, "record", "left").withColumn("n_records", F.coalesce("n_records", F.lit(1).cast("bigint")))


def split_features(features: DataFrame, documents: DataFrame, names=("train", "dev", "test"), ratios=(0.8, 0.1, 0.1), seed: int = 42, salt_groups: int = 200_000) -> DataFrame:
    """(feature_id, record, group_key, split): every feature once, all features of a group in one split.

    Groups of one size are interchangeable: they are ranked by a seeded hash, in parts of about `salt_groups` groups whose
    offsets come from counts, so that the many groups of size 1 never meet in one task. Empty input gives no rows; a null
    feature_id is left out.
    """
    scratch = Scratch(features.sparkSession, "splits")
    key = F.coalesce(F.concat(F.lit("author:"), F.col("group_author").cast("string")), F.concat(F.lit("record:"), F.coalesce("record", "feature_id")))
    f = scratch.table(feature_groups(features, documents, scratch).select("feature_id", "record", key.alias("group_key")))
    groups = scratch.table(f.groupBy("group_key").agg(F.count("*").alias("size")).withColumn("h", F.xxhash64("group_key", F.lit(seed))))
    by_size = groups.groupBy("size").count().collect()  # distinct sizes: at most the root of twice the features
    salts = max(1, -(-max((r["count"] for r in by_size), default=1) // salt_groups))
    groups = groups.withColumn("salt", F.pmod("h", F.lit(salts)))
    counts = choose_counts({r["size"]: r["count"] for r in by_size}, list(ratios))
    bounds = []
    for r in by_size:
        at = 0
        for i in [*range(1, len(names)), 0]:
            bounds.append((r["size"], at, at + counts[i].get(r["size"], 0), names[i]))
            at += counts[i].get(r["size"], 0)
    spark = features.sparkSession
    plan = spark.createDataFrame(bounds, "size bigint, lo bigint, hi bigint, split string").where("lo < hi")
    offsets = groups.groupBy("size", "salt").count().withColumn("base", F.sum("count").over(Window.partitionBy("size").orderBy("salt")) - F.col("count")).drop("count")
    rank = F.row_number().over(Window.partitionBy("size", "salt").orderBy("h", "group_key")) - 1
    placed = groups.withColumn("r", rank).join(offsets, ["size", "salt"]).withColumn("r", F.col("r") + F.col("base"))
    placed = placed.join(plan, (placed["size"] == plan["size"]) & (placed["r"] >= plan["lo"]) & (placed["r"] < plan["hi"])).select("group_key", "split")
    return f.join(placed, "group_key").select("feature_id", "record", "group_key", "split")


def p1_found(spark, d):
    scratch = Scratch(spark, "splits")
    g = feature_groups(spark.read.parquet(f"{d}/chunk_records.parquet"), spark.read.parquet(f"{d}/documents.parquet"), scratch)
    return g.where("n_records >= 2 and group_author is not null").select("feature_id", "group_author")


def p1_splits(spark, d):
    return split_features(spark.read.parquet(f"{d}/chunk_records.parquet"), spark.read.parquet(f"{d}/documents.parquet"))
