"""Problem 7: garbled text from wrong character encoding."""

from __future__ import annotations

import functools
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, spread_rows
from .prose import OTHER_PROSE, PROSE

#: Encoding chains as (written with, read with), the order in which the text was spoilt.
CHAINS = {
    "utf-8>cp1252": [("utf-8", "cp1252")],
    "utf-8>latin-1": [("utf-8", "latin-1")],
    "utf-8>cp1250": [("utf-8", "cp1250")],
    "utf-8>cp1251": [("utf-8", "cp1251")],
    "utf-8>mac-roman": [("utf-8", "mac-roman")],
    "utf-8>cp437": [("utf-8", "cp437")],
    "utf-8>cp850": [("utf-8", "cp850")],
    "utf-8>cp852": [("utf-8", "cp852")],
    "utf-8>cp866": [("utf-8", "cp866")],
    "utf-8>koi8-u": [("utf-8", "koi8-u")],
    "utf-8>cp1252 twice": [("utf-8", "cp1252")] * 2,
    "utf-8>latin-1 twice": [("utf-8", "latin-1")] * 2,
    "utf-8>cp1251 twice": [("utf-8", "cp1251")] * 2,
    "cp1251>cp1252": [("cp1251", "cp1252")],
    "cp1251>latin-1": [("cp1251", "latin-1")],
    "cp1251>cp1250": [("cp1251", "cp1250")],
    "cp1251>koi8-u": [("cp1251", "koi8-u")],
    "cp1251>cp866": [("cp1251", "cp866")],
    "cp1251>mac-roman": [("cp1251", "mac-roman")],
    "koi8-u>cp1251": [("koi8-u", "cp1251")],
    "koi8-u>cp1252": [("koi8-u", "cp1252")],
    "cp866>cp1251": [("cp866", "cp1251")],
    "cp866>cp1252": [("cp866", "cp1252")],
    "cp1250>cp1252": [("cp1250", "cp1252")],
    "iso8859-2>cp1252": [("iso8859-2", "cp1252")],
    "cp1252>cp1250": [("cp1252", "cp1250")],
    "cp1252>cp1251": [("cp1252", "cp1251")],
    "cp1252>mac-roman": [("cp1252", "mac-roman")],
    "cp1252>cp437": [("cp1252", "cp437")],
    "cp1252>cp850": [("cp1252", "cp850")],
    "mac-roman>cp1252": [("mac-roman", "cp1252")],
    "iso8859-5>cp1251": [("iso8859-5", "cp1251")],
    "iso8859-5>cp1252": [("iso8859-5", "cp1252")],
    "utf-8>iso8859-2": [("utf-8", "iso8859-2")],
    "cp852>cp1252": [("cp852", "cp1252")],
}
CLEAN = "clean"
#: Signs that occur in good text; lines whose only other characters are ASCII need no look.
USUAL = "•–—’‘“”„…®™©€°№«»"
BUCKETS = 1 << 14
_LOOK = re.compile(f"[^\x00-\x7f{USUAL}]")
#: Letters of the five languages, and of transliterations met in them.
_LETTERS = "абвгґдеєжзиіїйклмнопрстуфхцчшщьюяёыэъąćęłńóśźżäöüßáéíñúçïâôàè"
GOOD = frozenset(_LETTERS + _LETTERS.upper() + USUAL + "¿¡ºª·\xa0´§")
#: What is left of lost characters: the replacement character, or question marks instead of whole words: a long run of
#: them, or one among others. A single short run is a placeholder or meant.
LOST = re.compile(r"\ufffd|[?]{6}|[?]{4}[^?\n]{1,3}[?]{2}|[?]{2}[^?\n]{1,3}[?]{4}")
#: Documents of which clean lines are learned from, at most.
SAMPLE = 300
#: How much better a restored line must be than the line as it was, under the model of clean text (nats for a pair of bytes).
MARGIN = 0.3


@functools.cache
def _tables(name: str) -> tuple[list[str], dict[str, int]]:
    """Characters of the 256 bytes, and back; a byte without a character stands for the control character of its number."""
    chars = []
    for b in range(256):
        try:
            chars.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            chars.append(chr(b))
    return chars, {c: b for b, c in reversed(list(enumerate(chars)))}


def _encode(text: str, name: str) -> bytes | None:
    if name == "utf-8":
        return text.encode("utf-8", "surrogatepass")
    back = _tables(name)[1]
    try:
        return bytes([back[c] for c in text])
    except KeyError:
        return None


def _decode(data: bytes, name: str) -> str | None:
    if name == "utf-8":
        try:
            return data.decode("utf-8")
        except UnicodeDecodeError:
            return None
    return "".join(map(_tables(name)[0].__getitem__, data))


def garble(text: str, chain: str) -> str | None:
    for written, read in CHAINS[chain]:
        data = _encode(text, written)
        text = None if data is None else _decode(data, read)
        if text is None:
            return None
    return text


def invert(text: str, chain: str) -> str | None:
    """The text before the chain, or None where a step can't be undone strictly."""
    for written, read in reversed(CHAINS[chain]):
        data = _encode(text, read)
        text = None if data is None else _decode(data, written)
        if text is None:
            return None
    return text


def byte_bigrams(text: str) -> np.ndarray:
    """Hashes of the pairs of UTF-8 bytes of which one isn't ASCII; the first byte of a pair of ASCII tells nothing."""
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    b = np.where((b >= 48) & (b <= 57), 48, b)
    pair = (b[:-1] << np.uint32(8)) | b[1:]
    pair = pair[(b[:-1] > 127) | (b[1:] > 127)]
    return (pair * np.uint32(0x9E3779B1)) >> np.uint32(18)


def _training_rows(sample: tuple[str, ...] = ()) -> dict[str, list[str]]:
    """Clean and garbled lines: PROSE and the sample as they are and in upper case, the words of PROSE also alone. Lines of other
    languages are clean only: letters that the five languages lack are no sign of garbling."""
    lines = [x for t in PROSE.values() for x in t.split("\n")]
    lines += [x.upper() for x in lines]
    lines += [f" {w} " for x in lines for w in x.split() if not w.isascii() and len(w) > 3]
    lines += [y for x in sample for y in (x, x.upper())]
    rows = {CLEAN: [*lines, *(y for x in OTHER_PROSE for y in (x, x.upper())), *OTHER_PROSE * (len(sample) // 200)]}
    for chain in CHAINS:
        rows[chain] = [g for x in lines if (g := garble(x, chain)) is not None and g != x]
    # letters of another alphabet or with an accent inside ordinary words are typing habits, not garbling
    swap = str.maketrans("aeopcx", "аеорсх")
    for w in PROSE["en"].split():
        if len(w) > 4 and w.isascii():
            rows[CLEAN] += [f"{w[:2]}{w[2:4].translate(swap)}{w[4:]}", w.replace("e", "é", 1), f"{w}®"]
    return rows


class Classifier:
    """Log-probabilities of the hashed bigrams under each chain and under clean text (multinomial, add-0.05 smoothing)."""

    def __init__(self, sample: tuple[str, ...] = ()):
        rows = _training_rows(sample)
        self.names, table = list(rows), np.empty((len(rows), BUCKETS), np.float32)
        for i, texts in enumerate(rows.values()):
            n = np.bincount(np.concatenate([byte_bigrams(t) for t in texts]), minlength=BUCKETS) + 0.05
            table[i] = np.log(n / n.sum())
        self.table = np.ascontiguousarray(table.T)  # a row for each bigram

    def scores(self, text: str) -> np.ndarray:
        return self.table[byte_bigrams(text)].sum(0)

    def clean(self, text: str) -> float:
        """Mean log-probability of the text's bigrams under clean text; -10 for a text without any."""
        b = byte_bigrams(text)
        return float(self.table[b, self.names.index(CLEAN)].mean()) if len(b) else -10.0


@functools.cache
def classifier() -> Classifier:
    """The classifier of the built-in lines alone."""
    return Classifier()


def clean_lines(texts, most: int = 100) -> tuple[str, ...]:
    """Lines with other than ASCII characters that show no mark of garbling, cut to `most` characters."""
    return tuple(x[:most] for t in texts for x in t.split("\n") if not x.isascii() and not _ODD.search(x))


_SAME_SHAPE = str.maketrans("асеорхуіјкмтвнАСЕОРХУІЈКМТВН", "aceopxyijkmtbhACEOPXYIJKMTBH")
_TWO_SCRIPTS = re.compile("[A-Za-z][\u0400-\u052f]|[\u0400-\u052f][A-Za-z]")
_TOKEN = re.compile(r"[^\W\d_]+")


def without_lookalikes(line: str) -> str:
    """The line with Cyrillic letters inside Latin words written as the Latin ones of the same shape.

    Such letters are typing habits, not garbling. Words with other Cyrillic letters stay as they are.
    """

    def word(m):
        w = m[0]
        if _TWO_SCRIPTS.search(w):
            t = w.translate(_SAME_SHAPE)
            if not any("\u0400" <= c < "\u0530" for c in t):
                return t
        return w

    return _TOKEN.sub(word, line) if _TWO_SCRIPTS.search(line) else line


_RARE = re.compile("[^\x00-\x7f" + re.escape("".join(sorted(GOOD))) + "]")
_CYRILLIC_CASE = re.compile("[а-яґєії][А-ЯҐЄІЇ]")
_SHOUTED = re.compile("[А-ЯҐЄІЇ]{3}")
_SIGN_INSIDE = re.compile(r"[^\W\d_][" + re.escape(USUAL.replace("’", "")) + r"¿¡ªº·´§]+[^\W\d_]")
#: Usual signs as UTF-8 read in another encoding: the character of the lead byte and those of the bytes behind it. A
#: Cyrillic letter before a no-break space is left out, as it is a word (В) where a sentence may start.
_GARBLED = re.compile("|".join(sorted({re.escape(g) for c in USUAL + "¿¡ºª·\xa0´§" for chain, steps in CHAINS.items() if len(steps) == 1 and steps[0][0] == "utf-8" and len(g := garble(c, chain)) > 1 and not (c == "\xa0" and "\u0400" <= g[0] < "\u0530")}, key=len, reverse=True)))


def strangeness(text: str) -> float:
    """How much a text shows of what good text lacks; compared between a line and its restorations."""
    t = without_lookalikes(text)
    return 2.0 * len(_RARE.findall(t)) + len(_CYRILLIC_CASE.findall(t)) + len(_TWO_SCRIPTS.findall(t)) + len(_SIGN_INSIDE.findall(t)) + len(_GARBLED.findall(t)) + 0.1 * len(_SHOUTED.findall(t))


#: Any of the marks that strangeness counts, or a look-alike letter: lines without one need no further look.
_ODD = re.compile("|".join(x.pattern for x in (_RARE, _CYRILLIC_CASE, _SHOUTED, _TWO_SCRIPTS, _SIGN_INSIDE, _GARBLED)))
_CONTROL = re.compile("[\x7f-\x9f]")
_MIXED = re.compile(r"\S*[^\x00-\x7f]\S*(?:[ \xa0]\S*[^\x00-\x7f]\S*)*")


def restore_line(line: str, model: Classifier | None = None) -> tuple[str, str | None]:
    """(restored line, chain), or the line itself and None. The classifier orders the chains; the first whose
    inverse decodes strictly and leaves nothing strange holds, or else the one that leaves the least. Where the whole line doesn't decode, its runs of
    words with other than ASCII characters are taken one by one.

    A restoration has to be likelier clean text than the line was, by MARGIN, or to decode from UTF-8 wholly, and to give the line again when it is
    garbled by the chain, so good text in any language stays as it is."""
    probe = " ".join(w for w in line.split(" ") if not w.isascii())  # plain words bear no evidence
    before = strangeness(probe)
    if before < 0.3:  # no mark but a word or two in capitals, such as РНОКПП, which tell nothing
        return line, None
    model = model or classifier()
    score, names = model.scores(without_lookalikes(probe)), model.names
    best, floor = (before, None), model.clean(without_lookalikes(probe)) + MARGIN
    order = np.argsort(-score, kind="stable")
    if _GARBLED.search(probe):  # UTF-8 hardly decodes by chance, and single signs are too short for the classifier
        order = sorted(order, key=lambda i: not names[i].startswith("utf-8"))
    for i in order:
        if names[i] == CLEAN:
            if before < 2:
                break
            continue
        out = _undo(probe, names[i])
        if out != probe and not _CONTROL.search(out) and (s := strangeness(out)) < best[0] and (model.clean(out) >= floor or _decodes(probe, names[i])) and _again(probe, out, names[i]):
            best = (s, names[i])
            if not s:
                break
    if not best[1]:
        return line, None
    out = _undo(line, best[1])
    if strangeness(out) >= strangeness(line):
        return line, None
    if best[0] >= 2:
        again, more = restore_line(out, model)
        return again, best[1] + (f", {more}" if more else "")
    return out, best[1]


def _decodes(text: str, chain: str) -> bool:
    """Whether the whole text is valid UTF-8 read otherwise, with several sequences, which good text hardly is by chance."""
    out = invert(text, chain) if chain.startswith("utf-8") else None
    return out is not None and len(text) - len(out) >= 3


def _again(text: str, out: str, chain: str) -> bool:
    """Whether the chain makes the text from what was restored, wholly or in the runs that were taken one by one."""
    whole = garble(out, chain)
    if whole == text:
        return True
    return all(x == y or garble(y, chain) == x for x, y in zip(text.split(" "), out.split(" "))) if len(text.split(" ")) == len(out.split(" ")) else invert(text, chain) is None


def _undo(text: str, chain: str) -> str:
    out = invert(text, chain)
    return _MIXED.sub(lambda m: invert(m[0], chain) or m[0], text) if out is None else out


def restore(text: str, model: Classifier | None = None) -> tuple[str, list[str], bool]:
    """(restored text, chains found, whether characters are lost for good)."""
    chains, out = [], []
    for line in text.split("\n"):
        if not line.isascii() and _ODD.search(line):
            line, chain = restore_line(line, model)
            if chain:
                chains.append(chain)
        out.append(line)
    if chains:  # lines that alone are too short to tell follow the chain of their neighbours
        first = chains[0].split(", ")[0]
        for i, line in enumerate(out):
            if first in CHAINS and _LOOK.search(line):
                back = invert(line, first)
                if back and back != line and strangeness(back) < strangeness(line) and (model or classifier()).clean(back) > (model or classifier()).clean(line):
                    out[i] = back
    return "\n".join(out), sorted(set(chains)), bool(LOST.search(text))


def repair(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(key, restored, chains, lost): a row for each document with a wrongly decoded sequence.

    The classifier learns from built-in lines and the clean lines of at most `sample` documents, each garbled by every
    chain. Every line with an unusual character is classified by its hashed byte bigrams, the predicted chain inverted
    and kept where it decodes strictly and gives likelier clean text; replacement characters (U+FFFD) or question marks in place of words tell
    of lost characters, which stay as they are (lost = true). Texts of ASCII characters are passed over in the JVM. Null and empty texts give no row.
    """

    look = docs.select(F.col(key).cast("bigint").alias(key), F.col(text).cast("string").alias("t")).where(F.col("t").rlike("[^\\x00-\\x7f]|[?]{4}"))
    learned = hash_sample(look, key, F.col("t").rlike("[\\u0100-\\u024f\\u0400-\\u04ff]"), sample, 0.1).select(F.substring("t", 1, 20_000).alias("t")).collect()
    model = docs.sparkSession.sparkContext.broadcast(Classifier(clean_lines(r["t"] for r in learned)))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for k, t in zip(*(c.to_pylist() for c in b.columns)):
                restored, chains, lost = restore(t, model.value)
                if chains or lost:
                    rows.append((k, restored, " | ".join(chains), lost))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string(), pa.bool_()))], [key, "restored", "chains", "lost"])

    return spread_rows(look).mapInArrow(run, f"{key} bigint, restored string, chains string, lost boolean")


def p7_found(spark, d):
    return repair(spark.read.parquet(f"{d}/documents.parquet")).select("doc_id").distinct()


def p7_restored(spark, d):
    return repair(spark.read.parquet(f"{d}/documents.parquet"))
