"""Problem 10: long exact spans shared between records."""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_rows, char_codes, mix64, text_bytes

#: Perfect difference sets; each residue modulo the period is a difference of two members.
COVERS = {
    7: (0, 1, 3),
    13: (0, 1, 3, 9),
    31: (0, 1, 3, 8, 12, 18),
    57: (0, 1, 3, 13, 32, 36, 43, 52),
    73: (0, 1, 3, 7, 15, 31, 36, 54, 63),
    183: (0, 1, 3, 16, 23, 28, 42, 76, 82, 86, 119, 137, 154, 175),
}
#: Shortest anchor; shorter ones are common by chance.
LEAST_ANCHOR = 16
#: Anchors that a task gathers before it sends them on.
FLUSH = 2_000_000
#: Two bases of window hashes; what is taken for equal agrees under both.
_BASE, _BASE2 = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
#: Documents of which a bucket holds the anchors: bytes of text, at least and at most; between them as many buckets as
#: tasks can address in frames of some length.
LEAST_BUCKET, MOST_BUCKET, FRAMES = 1_000_000, 64_000_000, 20_000
#: Bits of the filter over documents, at most (64 MB); a full filter lets texts through, which the join then drops.
MAX_FILTER_BITS = 1 << 29


def period_for(length: int) -> int:
    """The longest known period whose anchors are at least 0.39 of the length (and LEAST_ANCHOR) long."""
    fit = [v for v in COVERS if length - v + 1 >= max(LEAST_ANCHOR, int(0.39 * length))]
    if not fit:
        raise ValueError(f"spans of {length} characters are too short for difference-cover anchors")
    return max(fit)


class _Powers:
    def __init__(self, base: int = _BASE):
        self.base = base
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int):
        if len(self.up) <= n:
            with np.errstate(over="ignore"):
                base, inverse = np.uint64(self.base), np.uint64(pow(self.base, -1, 2**64))
                self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n + 1, base)]), dtype=np.uint64)
                self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n + 1, inverse)]), dtype=np.uint64)
        return self.up, self.down


def window_hashes(prefix: np.ndarray, down: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hash of text[p : p + length] for each p of `at`, from prefix sums of code * base**position modulo 2**64."""
    return mix64((prefix[at + length] - prefix[at]) * down[at])


def prefix_sums(codes: np.ndarray, up: np.ndarray) -> np.ndarray:
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(mix64(codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], out=out[1:])
    return out


def _runs(h: np.ndarray) -> np.ndarray:
    """Number of the run of equal values that each entry of the sorted h lies in."""
    return np.cumsum(np.concatenate([[0], h[1:] != h[:-1]]).astype(np.int64)) if len(h) else np.empty(0, np.int64)


def settle(h, c, doc, flag, contexts: bool = True):
    """State of each occurrence of an anchor: bit 1, its whole context occurs in another document, so every span
    around it does; bit 2, its spans have to be compared one by one; 0, the anchor occurs in no other document.

    h: anchor hashes; c: context hashes, 0 where the document ends before the context does; doc: any number of the
    document; flag: the occurrence stands for several documents of another task. In a group with several
    contexts, each context keeps one occurrence to compare with, however many share it. With contexts=False, c is
    more of the hash: what is alike in both is one stretch, and the state is 1 or 0.
    """
    order = np.lexsort((doc, c, h))
    hs, cs, ds, fs = h[order], c[order], doc[order], flag[order]
    run = _runs(hs) if contexts else np.cumsum(np.concatenate([[0], (hs[1:] != hs[:-1]) | (cs[1:] != cs[:-1])]).astype(np.int64)) if len(hs) else np.empty(0, np.int64)
    n = int(run[-1]) + 1 if len(run) else 0
    lo, hi = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
    np.minimum.at(lo, run, ds)
    np.maximum.at(hi, run, ds)
    shared = (lo < hi) | (np.bincount(run, fs, n) > 0)
    if not contexts:
        state = shared[run].astype(np.uint8) if n else np.empty(0, np.uint8)
        state[(fs > 0) & (np.bincount(run, minlength=n)[run] == 1)] = 0
        out = np.empty(len(h), np.uint8)
        out[order] = state
        return out, order, run, shared
    new = np.concatenate([[True], (hs[1:] != hs[:-1]) | (cs[1:] != cs[:-1])]) if n else np.empty(0, bool)
    cls = np.cumsum(new) - 1
    k = int(cls[-1]) + 1 if n else 0
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(hs)) - 1 if n else first
    several = (np.bincount(run[first], minlength=n) > 1) | (np.bincount(run, cs == 0, n) > 0)
    whole = (ds[first] != ds[last]) & (cs[first] != 0) if k else np.empty(0, bool)
    state = np.where(whole[cls], 1, 2) if k else np.empty(0, np.int64)
    state[first] |= 2 * several[run[first]]
    state[~shared[run]] = 0
    state[(fs > 0) & (np.bincount(run, minlength=n)[run] == 1)] = 0  # its own task has settled it already
    out = np.empty(len(h), np.uint8)
    out[order] = state
    return out, order, run, shared


def squeeze(values: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of unsigned numbers, byte by byte; equal high bytes so lie together and compress."""
    raw = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(raw[:, :width].T).tobytes())


def unsqueeze(data: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(width, -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, :width] = raw.T
    return out.view("<u8").ravel()


def pack(pos: np.ndarray) -> bytes:
    """Positions in order: the first, then the steps between them in as few bytes as the longest needs. Where all places
    of a stretch are marked, its steps are all alike and Spark's compression leaves little of them."""
    pos = np.sort(pos.astype(np.int64))
    step = np.diff(pos)
    width = next(w for w in (1, 2, 4) if step.max(initial=0) < 1 << 8 * w)
    return pos[:1].astype("<u4").tobytes() + bytes([width]) + step.astype(f"<u{width}").tobytes()


def unpack(data: bytes) -> np.ndarray:
    first, width = np.frombuffer(data, "<u4", 1).astype(np.int64), data[4]
    return np.cumsum(np.concatenate([first, np.frombuffer(data, f"<u{width}", -1, 5).astype(np.int64)]))


#: Bytes sent of two hashes: of anchors and, under the other base, of their contexts; of stretches under either base.
#: An anchor met by chance is compared again; a context or stretch is taken for equal, at 112 or 88 bits.
ANCHOR_BYTES, CONTEXT_BYTES = 6, 8
STRETCH_BYTES, STRETCH_MORE = 8, 3


class _Sender:
    """Gathers (hash, context, document, position) of a task, settles what it can and sends the rest by hash bucket.
    Without contexts, the positions of what is settled go packed and without a state.

    Of a hash that several documents of the task hold one occurrence goes on, so what meets in a bucket is at
    most one row of a hot hash per task and flush.
    """

    def __init__(self, buckets: int, contexts: bool):
        self.buckets, self.contexts = buckets, contexts
        self.clear()

    def clear(self):
        self.parts, self.n = [], 0

    def add(self, h, c, doc: int, pos):
        self.parts.append((h, c, np.full(len(h), doc, np.int64), pos.astype(np.uint32)))
        self.n += len(h)

    def flush(self):
        import pyarrow as pa

        if not self.n:
            return
        h, c, doc, pos = (np.concatenate(x) for x in zip(*self.parts))
        self.clear()
        state, order, run, shared = settle(h, c, doc, np.zeros(len(h), np.uint8), self.contexts)
        run_first = np.concatenate([[True], run[1:] != run[:-1]])
        send = np.zeros(len(h), bool)
        send[order[~shared[run] | run_first]] = True
        flag = (state > 0).astype(np.uint8)
        known = state > 0
        rows = []
        if known.any():
            for d, a, b in _by(doc[known], pos[known], state[known]):
                rows.append((-1 - int(d) % self.buckets, int(d), *((a.tobytes(), b.tobytes()) if self.contexts else (pack(a), b"")), None, None, None))
        bucket = (h >> np.uint64(40)) % np.uint64(self.buckets)
        at = np.flatnonzero(send)
        at = at[np.argsort(bucket[at], kind="stable")]
        used, first = np.unique(bucket[at], return_index=True)
        for k, a, b in zip(used.tolist(), first.tolist(), [*first[1:].tolist(), len(at)]):
            i = at[a:b]
            ids, local = np.unique(doc[i], return_inverse=True)
            by = np.lexsort((pos[i], local))
            i, local = i[by], local[by]
            step = np.diff(pos[i].astype(np.int64), prepend=0)
            step[np.flatnonzero(np.diff(local, prepend=-1))] = pos[i][np.flatnonzero(np.diff(local, prepend=-1))]
            hashes = squeeze(h[i], ANCHOR_BYTES if self.contexts else STRETCH_BYTES)
            rows.append((k, None, squeeze(step, 4), squeeze(flag[i], 1), hashes, squeeze(c[i], CONTEXT_BYTES if self.contexts else STRETCH_MORE), ids.astype(np.int64).tobytes() + np.bincount(local).astype(np.uint32).tobytes()))
        for i in range(0, len(rows), 500):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[i : i + 500]), (pa.int32(), pa.int64(), *[pa.binary()] * 5))], _SENT_NAMES)


_SENT = "bucket int, doc bigint, pos binary, state binary, h binary, c binary, ids binary"
_SENT_NAMES = ["bucket", "doc", "pos", "state", "h", "c", "ids"]


def _by(doc, *cols):
    """Each document with its part of the columns."""
    order = np.argsort(doc, kind="stable")
    d = doc[order]
    edges = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1], [True]])) if len(d) else [0]
    for a, b in zip(edges[:-1], edges[1:]):
        yield d[a], *(c[order[a:b]] for c in cols)


def _receiver(contexts: bool):
    def settle_bucket(table):
        import pyarrow as pa

        known, met = [], []
        for r in table.to_pylist():
            if r["bucket"] < 0:
                known.append((r["doc"], r["pos"], r["state"]))
            else:
                h = unsqueeze(r["h"], ANCHOR_BYTES if contexts else STRETCH_BYTES)
                c = unsqueeze(r["c"], CONTEXT_BYTES if contexts else STRETCH_MORE)
                ids = r["ids"]
                n = len(ids) // 12
                ids, counts = np.frombuffer(ids[: 8 * n], np.int64), np.frombuffer(ids[8 * n :], np.uint32)
                total = np.cumsum(unsqueeze(r["pos"], 4).astype(np.int64))
                first = np.cumsum(counts) - counts
                base = np.where(first > 0, total[first - 1], 0)
                pos = (total - np.repeat(base, counts)).astype(np.uint32)
                met.append((h, c, np.repeat(ids, counts), unsqueeze(r["state"], 1).astype(np.uint8), pos))
        if met:
            h, c, doc, flag, pos = (np.concatenate(x) for x in zip(*met))
            state = settle(h, c, doc, flag, contexts)[0]
            ok = state > 0
            known += [(int(d), *((a.tobytes(), b.tobytes()) if contexts else (pack(a), b""))) for d, a, b in _by(doc[ok], pos[ok], state[ok])]
        return pa.table({"doc": pa.array([x[0] for x in known], pa.int64()), "pos": pa.array([x[1] for x in known], pa.binary()), "state": pa.array([x[2] for x in known], pa.binary())})

    return settle_bucket


def shared_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 300) -> DataFrame:
    """(doc_id, span_start, span_end, n_chars): maximal regions covered by stretches of `length` that other documents hold.

    Difference-cover anchors: windows are hashed only at positions whose residue modulo the period lies in the
    cover; any two equal stretches hold an anchor at the same place within both. An anchor seen in one document
    only ends there. Where the anchor's surroundings (every stretch that can hold it) are equal too, all of them
    are shared; only at the edges of shared regions are single stretches hashed and compared. Occurrences meet by
    hash in packed buckets, each task having settled and merged its own first. Offsets count code points.
    Null and shorter texts give no rows, nor does a null id; a repeated id counts as one document, of which
    copies within one text don't count.
    """
    v = period_for(length)
    w, cover = length - v + 1, np.array(COVERS[v])
    base = docs.select(F.col(key).cast("bigint").alias("doc"), F.col(text).cast("string").alias("t")).where((F.length("t") >= length) & F.col("doc").isNotNull())
    size = text_bytes(docs, text)
    buckets = max(16, -(-size // min(MOST_BUCKET, max(LEAST_BUCKET, size // FRAMES))))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(size // 2_000_000, 2000 + size // 32_000_000))

    def anchors(batches):
        sender, powers, other = _Sender(buckets, True), _Powers(), _Powers(_BASE2)
        for doc, t in arrow_rows(batches):
            codes = char_codes(t)
            n = len(codes)
            up, down = powers.upto(n + 1)
            prefix = prefix_sums(codes, up)
            at = (np.arange(0, n, v)[:, None] + cover).ravel()
            at = at[at + w <= n]
            c = np.zeros(len(at), np.uint64)
            inner = (at >= v - 1) & (at + length <= n)
            if inner.any():
                up2, down2 = other.upto(n + 1)
                c[inner] = np.maximum(window_hashes(prefix_sums(codes, up2), down2, at[inner] - (v - 1), length + v - 1), np.uint64(1))
            sender.add(window_hashes(prefix, down, at, w), c, doc, at)
            if sender.n >= FLUSH:
                yield from sender.flush()
        yield from sender.flush()

    def stretches(batches):
        import pyarrow as pa

        sender, powers, other = _Sender(buckets, False), _Powers(), _Powers(_BASE2)
        for doc, t, found in arrow_rows(batches):
            codes = char_codes(t)
            n = len(codes)
            state = np.concatenate([np.frombuffer(x["state"], np.uint8) for x in found])
            pos = np.concatenate([np.frombuffer(x["pos"], np.uint32) for x in found]).astype(np.int64)
            sure, ask = (_cover(pos[state & bit > 0], v, n - length + 1) for bit in (1, 2))
            if sure.any():
                yield pa.RecordBatch.from_arrays([pa.array(x, ty) for x, ty in zip(([-1 - doc % buckets], [doc], [pack(np.flatnonzero(sure))], [b""], [None], [None], [None]), (pa.int32(), pa.int64(), *[pa.binary()] * 5))], _SENT_NAMES)
            if ask.any():
                up, down = powers.upto(n + 1)
                up2, down2 = other.upto(n + 1)
                at = np.flatnonzero(ask)
                more = window_hashes(prefix_sums(codes, up2), down2, at, length) & np.uint64((1 << 8 * STRETCH_MORE) - 1)
                sender.add(window_hashes(prefix_sums(codes, up), down, at, length), more, doc, at)
                if sender.n >= FLUSH:
                    yield from sender.flush()
        yield from sender.flush()

    def regions(batches):
        import pyarrow as pa

        for doc, found in arrow_rows(batches):
            p = np.unique(np.concatenate([unpack(x) for x in found]))
            gap = np.flatnonzero(np.diff(p) > length)
            start, end = p[np.append(0, gap + 1)], p[np.append(gap, len(p) - 1)] + length
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(start), doc)), pa.array(start), pa.array(end)], ["doc_id", "span_start", "span_end"])

    met = "doc bigint, pos binary, state binary"
    found = base.mapInArrow(anchors, _SENT).repartition(parts, "bucket").groupBy("bucket").applyInArrow(_receiver(True), met)
    # the anchors are off the disks before more is sent
    by_doc = Scratch(docs.sparkSession, "sharedspans").table(found.groupBy("doc").agg(F.collect_list(F.struct("pos", "state")).alias("found")), free=True)
    asked = _likely(base, by_doc, size).join(by_doc, "doc").select("doc", "t", "found")
    marks = asked.mapInArrow(stretches, _SENT).repartition(parts, "bucket").groupBy("bucket").applyInArrow(_receiver(False), met)
    return marks.groupBy("doc").agg(F.collect_list("pos").alias("found")).mapInArrow(regions, "doc_id bigint, span_start bigint, span_end bigint")


def _likely(base: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """Rows of base whose doc may be among the wanted ones, so that the join needn't shuffle all texts.

    A Bloom filter of two bits for each document: as many bits as a thirtieth of the input's bytes, MAX_FILTER_BITS at
    most. Its words are put together by a grouped aggregation, so that no task reads more than its share of them.
    """
    bits = 1 << min(MAX_FILTER_BITS.bit_length() - 1, max(16, (size // 30).bit_length()))
    doc = F.col("doc")
    places = wanted.select(F.explode(F.array(*(F.pmod(F.xxhash64(doc, F.lit(i)), F.lit(bits)) for i in (0, 1)))).alias("p"))
    words = places.groupBy(F.shiftright("p", 6).alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("v"))
    filled, table = words.toArrow(), np.zeros(bits // 64, np.int64)  # at most bits / 64 rows
    table[filled.column("i").to_numpy()] = filled.column("v").to_numpy()
    sent = base.sparkSession.sparkContext.broadcast(table.tobytes())

    def keep(batches):
        has = np.frombuffer(sent.value, np.uint8)
        import pyarrow as pa

        for b in batches:
            ok = np.ones(b.num_rows, bool)
            for c in ("p", "q"):
                p = b.column(c).to_numpy(zero_copy_only=False)
                ok &= (has[p >> 3] >> (p & 7).astype(np.uint8)) & 1 > 0
            yield b.select(["doc", "t"]).filter(pa.array(ok))

    asked = base.select("doc", "t", *(F.pmod(F.xxhash64(doc, F.lit(i)), F.lit(bits)).alias(c) for i, c in ((0, "p"), (1, "q"))))
    return asked.mapInArrow(keep, "doc bigint, t string")


def _cover(anchor: np.ndarray, v: int, n: int) -> np.ndarray:
    """Which of the n stretches hold one of the anchors."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, np.clip(anchor - (v - 1), 0, n), 1)
    np.add.at(d, np.minimum(n, anchor + 1), -1)
    return np.cumsum(d[:-1]) > 0


def p10_found(spark, d):
    return shared_spans(spark.read.parquet(f"{d}/documents.parquet"))


def p10_shared(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    s = shared_spans(docs).groupBy("doc_id").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"))
    n = docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n_chars"))
    return n.join(s, "doc_id", "left").select("doc_id", "n_chars", F.coalesce("shared_chars", F.lit(0).cast("bigint")).alias("shared_chars"), F.coalesce(F.round(F.col("shared_chars") / F.col("n_chars"), 6), F.lit(0.0)).alias("share"))
