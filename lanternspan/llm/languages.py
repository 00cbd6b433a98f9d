"""Problem 3: missing or wrong document language labels."""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_rows, hash_sample, in_batches, table_bytes
from .encodings import _LOOK, restore
from .prose import PROSE

LANGS = ("en", "uk", "pl", "de", "es")
#: Labelled documents from which the words' likelihoods are learned; those with the smallest hashes of their ids.
SAMPLE = 3000
#: Suffixes of addresses and the language they speak for.
SUFFIXES = {"uk": "en", "us": "en", "ua": "uk", "pl": "pl", "de": "de", "at": "de", "es": "es", "mx": "es"}
#: Ukrainian letters in Latin ones (the official scheme of 2010), elsewhere and at the start of a word.
ROMAN = dict(zip("абвгґдежзиіклмнопрстуфхцчшщьєїйюя", "a b v h g d e zh z y i k l m n o p r s t u f kh ts ch sh shch _ ie i i iu ia".replace("_", "").split(" ")))
ROMAN_START = {"є": "ye", "ї": "yi", "й": "y", "ю": "yu", "я": "ya"}
_WORD = re.compile(r"[^\W\d_]+|[?]{2,}|\d")
_LETTERS = re.compile(r"[^\W\d_]{2,}")
_SENTENCE_END = re.compile(r"(?<=[.!?…])\s+|\n+")
_BULLET = re.compile(r"[-*•·–—|;:,]+|\d+[.)]")
_SUFFIX = re.compile(r"(?<=[\w-]\.)[a-z]{2}(?![\w.@-])")
_SEPARATOR, _COMMA = re.compile(r";| [|] "), re.compile(",")
_CONTACT = re.compile(r"@|\[at\]|\(at\)|\d[\d\s().-]{6,}\d")
#: Tokens of running prose that make a stretch.
STRETCH = 15


def romanize(word: str) -> str:
    head = ROMAN_START.get(word[:1]) or ROMAN.get(word[:1], word[:1])
    return head + "".join(ROMAN.get(c, c) for c in word[1:])


def units(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences and lines that hold a letter."""
    out, at = [], 0
    for m in [*_SENTENCE_END.finditer(text), None]:
        end = m.start() if m else len(text)
        if _LETTERS.search(text, at, end) or "????" in text[at:end]:
            out.append((at, end))
        at = m.end() if m else end
    return out


def words(text: str) -> list[str]:
    return ["??" if w[0] == "?" else w for w in _WORD.findall(text.lower()) if not w.isdigit()]


class Likelihoods:
    """Log-likelihoods of words under each language: a multinomial over known words; others count by their trigrams."""

    def __init__(self, rows: list[tuple[str, str]], rounds: int = 2):
        """rows: (language, text); labels are wrong in part, so sentences move to their likeliest language and count again."""
        sents = [(LANGS.index(lang), words(t[a:b])) for lang, t in rows for a, b in units(t)]
        own = [(LANGS.index(lang), words(t[a:b])) for lang, t in PROSE.items() for a, b in units(t)]
        for k in range(rounds + 1):
            self._count([*sents, *own * 4])
            if k < rounds:
                scores = self.score([w for _, w in sents])
                sents = [(int(s.argmax()) if len(w) > 3 else lang, w) for (lang, w), s in zip(sents, scores)]

    def _count(self, sents):
        by = defaultdict(lambda: np.zeros(len(LANGS)))
        for lang, ws in sents:
            for w in ws:
                by[w][lang] += 1
        uk = LANGS.index("uk")
        for w, n in list(by.items()):
            if n[uk] > 0 and any("а" <= c <= "ї" for c in w):  # the same word in Latin letters
                by[romanize(w)][uk] += 0.1 * n[uk]
        by["??"][:] = 0
        by["??"][uk] = 50  # only an alphabet that is lost as a whole leaves nothing but question marks
        names = list(by)
        n = np.stack([by[w] for w in names])
        total = n.sum(0) + 0.2 * len(names)
        self.table = np.log((n + 0.2) / total)
        grams = defaultdict(lambda: np.zeros(len(LANGS)))
        for w, c in zip(names, n):
            for g in _trigrams(w):
                grams[g] += np.minimum(c, 5)
        g = np.stack(list(grams.values()))
        self.gram = dict(zip(grams, np.log((g + 0.5) / (g.sum(0) + 0.5 * len(g)))))
        self.table -= self.table.mean(1, keepdims=True)
        self.index = {w: i for i, w in enumerate(names) if c_known(n[i])}
        self.known = {w for w in self.index if n[self.index[w]].sum() >= 4}
        self.clipped = np.clip(self.table, -4, 4).astype(np.float32)
        self.memo: dict[str, np.ndarray] = {}

    def other(self, w: str) -> np.ndarray:
        got = self.memo.get(w)
        if got is None:
            if len(self.memo) > 300_000:
                self.memo.clear()
            v = sum((self.gram[g] for g in _trigrams(w) if g in self.gram), np.zeros(len(LANGS)))
            got = self.memo[w] = np.clip(0.3 * (v - v.mean()), -1.5, 1.5).astype(np.float32)
        return got

    def score(self, lists: list[list[str]]) -> np.ndarray:
        """Sum of the words' log-likelihoods (less their mean over languages) for each list. Unknown words count, by
        their trigrams, only where fewer than six are known."""
        out = np.zeros((len(lists), len(LANGS)), np.float32)
        get, flat, ends = self.index.get, [], []
        for i, ws in enumerate(lists):
            n = len(flat)
            flat += [k for w in ws if (k := get(w)) is not None]
            ends.append(len(flat))
            if len(flat) - n < 6:
                for w in ws:
                    if w not in self.index:
                        out[i] += self.other(w)
        if flat:
            total = np.concatenate([np.zeros((1, len(LANGS))), np.cumsum(self.clipped[flat], 0, dtype=np.float64)])
            e = np.array(ends)
            out += (total[e] - total[np.concatenate([[0], e[:-1]])]).astype(np.float32)
        return out


def c_known(n: np.ndarray) -> bool:
    return n.sum() >= 2


def _trigrams(w: str):
    p = f"^{w}$"
    return [p[i : i + 3] for i in range(len(p) - 2)]


def prose_tokens(text: str, model: Likelihoods, ws: list[str] | None = None) -> int:
    """Blank-separated tokens of the unit if it is running prose, else 0; list marks don't count."""
    if _CONTACT.search(text):
        return 0
    toks = [t for t in text.split() if not _BULLET.fullmatch(t)]
    for sep, most in ((_SEPARATOR, 6), (_COMMA, 3)):
        found = sep.findall(text)
        if len(found) >= (2 if sep is _SEPARATOR else 3) and len(toks) < most * len(found):
            tail = text[text.rindex(found[-1]) + len(found[-1]) :]  # a sentence may follow the list's last entry
            n = prose_tokens(tail, model)
            return n - 1 if n > 6 else 0
    ws = words(text) if ws is None else ws
    known = sum(w in model.known or w == "??" for w in ws)
    if not ws or known < 0.4 * len(ws):
        return 0
    return len(toks)


def decode(scores: list[np.ndarray], priors: list[np.ndarray], switch: float = 4.0) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each document the language of each unit, and its posterior: a chain over units that keeps the language
    unless the words say otherwise. Documents run together in groups of about one number of units; padding behind
    a document favours no language, so it changes nothing before it."""
    out: list = [None] * len(scores)
    order = sorted(range(len(scores)), key=lambda i: len(scores[i]))
    k = len(LANGS)
    step = np.where(np.eye(k, dtype=bool), 0.0, -switch)
    for at in range(0, len(order), 256):
        part = order[at : at + 256]
        n = len(scores[part[-1]])
        s = np.zeros((n, len(part), k))
        for j, i in enumerate(part):
            s[: len(scores[i]), j] = scores[i] + priors[i]
        fwd, bwd, back = np.empty_like(s), np.zeros_like(s), np.zeros(s.shape, np.int8)
        best = fwd[0] = s[0]
        for t in range(1, n):
            m = best[:, :, None] + step
            back[t] = m.argmax(1)
            best = m.max(1) + s[t]
            fwd[t] = _sum(fwd[t - 1][:, :, None] + step, 1) + s[t]
        for t in range(n - 2, -1, -1):
            bwd[t] = _sum(step + (s[t + 1] + bwd[t + 1])[:, None, :], 2)
        post = fwd + bwd
        post = np.exp(post - _sum(post, 2)[:, :, None])
        path = np.empty((n, len(part)), np.int64)
        path[-1] = best.argmax(1)
        for t in range(n - 1, 0, -1):
            path[t - 1] = back[t][np.arange(len(part)), path[t]]
        for j, i in enumerate(part):
            u = len(scores[i])
            out[i] = path[:u, j], post[np.arange(u), j, path[:u, j]]
    return out


def _sum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def label_language(c):
    """The language in front of the label's first "-" or "_", in lower case; null stays null."""
    return F.lower(F.trim(F.regexp_extract(c, r"^([^-_]*)", 1)))


def segments(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", host: str = "source", sample: int = SAMPLE) -> DataFrame:
    """(key, label, segment, seg_start, seg_end, lang, confidence, tokens): stretches of one language.

    Evidence is fused by Bayes' rule: likelihoods of the words (learned from at most `sample` labelled documents
    and a few built-in texts), how often each declared language goes with each true one, suffixes of addresses in the
    text, and each host's share of languages, smoothed towards that of all hosts. The last two tables are grouped
    aggregations over all documents. Wrongly decoded text is restored first. tokens counts running prose
    only (lists and contact lines have none). Offsets refer to the restored text. Null and empty texts and such
    without a letter give no row; without a label column or value the label says nothing.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "languages")
    col = lambda c: F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string")
    base = docs.select(F.col(key).cast("bigint").alias("doc"), F.col(text).cast("string").alias("t"), label_language(col(label)).alias("label"), F.coalesce(col(host), F.lit("")).alias("host")).where(F.col("t").rlike(r"[\p{L}?]"))
    rows = hash_sample(base, "doc", F.col("label").isin(*LANGS), sample, 0.5).select("label", "t").collect()
    model = spark.sparkContext.broadcast(Likelihoods([(r["label"], r["t"]) for r in rows]))

    def score(batches):
        import pyarrow as pa

        m = model.value
        for rows in in_batches(arrow_rows(batches)):
            out, lists = [], []
            for doc, t, lab, h in rows:
                if _LOOK.search(t):
                    t = restore(t)[0]
                us = units(t)
                if not us:
                    continue
                ws = [words(t[a:b]) for a, b in us]
                n = [(a, b, prose_tokens(t[a:b], m, w)) for (a, b), w in zip(us, ws)]
                lean = np.zeros(len(LANGS), np.float32)
                for suffix in _SUFFIX.findall(t) if "@" in t or "www." in t else ():
                    if suffix in SUFFIXES:
                        lean[LANGS.index(SUFFIXES[suffix])] += 0.3
                lean = np.minimum(lean, 1.2)  # every address counts, though many tell little more than a few
                out.append([doc, lab, h, 0, np.array(n, np.int32).tobytes(), (len(lists), len(lists) + len(us), lean)])
                lists += ws
            scores = m.score(lists)
            for r in out:
                x, y, lean = r[5]
                s = scores[x:y] + lean
                r[3], r[5] = int(s.sum(0).argmax()), s.tobytes()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, ty) for x, ty in zip(zip(*out), (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.binary(), pa.binary()))], ["doc", "label", "host", "likely", "units", "scores"])

    scored = scratch.table(base.mapInArrow(score, "doc bigint, label string, host string, likely int, units binary, scores binary"))
    declared = np.ones((len(LANGS) + 1, len(LANGS)))
    known = F.when(F.col("label").isin(*LANGS), F.col("label"))
    for r in scored.groupBy(known.alias("label"), "likely").count().collect():  # six labels by five languages
        declared[LANGS.index(r["label"]) if r["label"] else -1, r["likely"]] += r["count"]
    overall = declared.sum(0) / declared.sum()
    given = np.log(declared / declared.sum(0))
    hosts = scored.groupBy("host").pivot("likely", list(range(len(LANGS)))).count().na.fill(0)
    hosts = hosts.select("host", F.array(*(F.col(str(i)).cast("double") for i in range(len(LANGS)))).alias("n"))
    joined = scored.join(F.broadcast(hosts) if table_bytes(hosts) < 1_000_000 else hosts, "host")

    def fuse(batches):
        import pyarrow as pa

        for b in batches:
            rows, out = list(zip(*(b.column(c).to_pylist() for c in ("doc", "label", "units", "scores", "n")))), []
            spans = [np.frombuffer(r[2], np.int32).reshape(-1, 3) for r in rows]
            hosts = np.array([r[4] for r in rows], float).reshape(-1, len(LANGS))
            share = np.log((hosts + 50 * overall) / (hosts.sum(1, keepdims=True) + 50))
            priors = [(p + given[LANGS.index(r[1]) if r[1] in LANGS else -1]) / max(3, len(us)) for p, r, us in zip(share, rows, spans)]
            found = decode([np.frombuffer(r[3], np.float32).reshape(-1, len(LANGS)) for r in rows], priors)
            for (doc, lab, *_), us, (path, post) in zip(rows, spans, found):
                edges = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1], [True]]))
                size = np.maximum(1, us[:, 1] - us[:, 0])
                for i, (x, y) in enumerate(zip(edges[:-1], edges[1:])):
                    out.append((doc, lab, i, int(us[x, 0]), int(us[y - 1, 1]), LANGS[path[x]], round(float(post[x:y] @ size[x:y]) / float(size[x:y].sum()), 6), int(us[x:y, 2].sum())))
            yield pa.RecordBatch.from_arrays([pa.array(x, ty) for x, ty in zip(zip(*out) if out else [[]] * 8, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64()))], _SEGMENT)

    schema = "doc bigint, label string, segment bigint, seg_start bigint, seg_end bigint, lang string, confidence double, tokens bigint"
    return joined.select("doc", "label", "units", "scores", "n").mapInArrow(fuse, schema).withColumnRenamed("doc", key)


_SEGMENT = ["doc", "label", "segment", "seg_start", "seg_end", "lang", "confidence", "tokens"]


def p3_found(spark, d):
    s = segments(spark.read.parquet(f"{d}/documents.parquet"))
    return s.where((F.col("tokens") >= STRETCH) & ~F.col("lang").eqNullSafe(F.col("label"))).select("doc_id", "lang").distinct()


def p3_segments(spark, d):
    return segments(spark.read.parquet(f"{d}/documents.parquet"))
