"""Problem 5: mapping free-entered values to a canonical list."""

from __future__ import annotations

import math
import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_rows, table_bytes

#: Entry types that a label's values may mean.
TARGETS = {"JOB_ROLE": ("occupation", "alternate_title"), "SKILL": ("skill", "knowledge", "ability"), "TECHNOLOGY": ("technology_skill",)}
#: Cyrillic letters in Latin ones, and Latin letters that share their sound; both sides go through both.
SOUNDS = str.maketrans(
    {"а": "a", "б": "b", "в": "v", "г": "g", "ґ": "g", "д": "d", "е": "e", "є": "e", "ё": "e", "ж": "z", "з": "z", "и": "i", "і": "i", "ї": "i", "й": "j", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o"}
    | {"п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "h", "ц": "c", "ч": "c", "ш": "s", "щ": "s", "ю": "u", "я": "a", "ь": "", "ъ": "", "ы": "i", "э": "e", "w": "v", "y": "i", "q": "k", "x": "ks", "ł": "l"}
)
LOOKALIKES = str.maketrans("асеорхуіјкмтвн", "aceopxyijkmtbh")
#: Usual short forms of occupations' last words.
SHORT_FORMS = {"dev": "developer", "eng": "engineer", "engr": "engineer", "mgr": "manager", "arch": "architect", "cons": "consultant", "adm": "administrator", "admin": "administrator", "spec": "specialist", "anlst": "analyst", "mngr": "manager"}
#: Words beside a name that don't change what it means: seniority, level, praise and the like.
ADDITIONS = frozenset("senior sr junior jr middle mid lead principal head chief intern trainee strong good very excellent basic advanced skills skill framework library remote hybrid contract freelance team ii iii iv years year".split())
_PARENTHESES = re.compile(r"\([^)]*\)|\[[^\]]*\]")
_TOKEN = re.compile(r"[^\W_]+(?:\+\+|#)?(?:/[wfmd]/[dxwf]\b)?")
_VERSION = re.compile(r"v?\d+(?:\.\d+)*")
_DOTTED = re.compile(r"(?<![^\W_])v?\d+(?:\.\d+)+(?![^\W_])|\.js\b")


def tokens(text: str, fillers: frozenset[str] = frozenset()) -> list[str]:
    """Words of the value in one spelling: no case, accents, look-alike letters, versions or additions, Latin sounds.

    Where nothing but additions and fillers is left, those stay.
    """
    t = unicodedata.normalize("NFKC", text)
    t = "".join(c for c in unicodedata.normalize("NFD", t) if not ("̀" <= c <= "ͯ" and c not in "̆̈"))
    t = unicodedata.normalize("NFC", t).replace("®", " ").replace("™", " ").replace("©", " ")
    t = _PARENTHESES.sub(" ", t) if _PARENTHESES.sub("", t).strip() else t
    t = re.sub(r"\b[mwf]/[mwf]/[dx]\b", " ", t.lower())
    words = _TOKEN.findall(_DOTTED.sub(" ", t)) or _TOKEN.findall(t)
    out = []
    for w in words:
        if any("a" <= c <= "z" for c in w):
            w = w.translate(LOOKALIKES)
        out.append(w)
    kept = [w for w in out if w not in ADDITIONS and not _VERSION.fullmatch(w)] or out
    kept = [SHORT_FORMS.get(w, w) if i else w for i, w in enumerate(kept)]
    kept = [w.translate(SOUNDS) for w in kept]
    return [w for w in kept if w not in fillers] or kept


def grams(words: list[str]) -> list[str]:
    """The set of pairs of neighbouring letters of each word, its start marked; a word order doesn't show in it."""
    out = set()
    for w in words:
        w = "^" + w
        out.update(w[i : i + 2] for i in range(len(w) - 1))
    return sorted(out)


def near(a: list[str], b: list[str]) -> bool:
    """Whether one letter more, less, other, or swapped with its neighbour makes one value the other; word order aside."""
    x, y = " ".join(sorted(a)), " ".join(sorted(b))
    if x == y:
        return True
    if len(x) > len(y):
        x, y = y, x
    if len(y) - len(x) > 1 or len(y) < 4:
        return False
    i = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), len(x))
    if len(x) < len(y):
        return x[i:] == y[i + 1 :]
    return x[i + 1 :] == y[i + 1 :] or (x[i : i + 2] == y[i : i + 2][::-1] and x[i + 2 :] == y[i + 2 :])


def _prefix(gs: list[str], rank: dict[str, int], least: float) -> list[str]:
    """The rarest grams, of which a set with a Jaccard similarity of `least` shares at least one."""
    return sorted(gs, key=lambda g: (rank.get(g, 0), g))[: len(gs) - math.ceil(least * len(gs)) + 1]


#: Similarity from which candidates are compared: of values of up to SHORT grams, one typing error leaves less.
SHORT, LEAST, LEAST_SHORT = 8, 0.45, 0.3
#: Similarity from which a candidate is taken without being one typing error away.
SURE = 0.55


def map_values(values: DataFrame, reference: DataFrame, key: str = "annotation_id", label: str = "label", text: str = "text", targets: dict[str, tuple[str, ...]] = TARGETS) -> DataFrame:
    """(key, entry_id, similarity): the entry that each value of a label in `targets` means, or 'none' with similarity 0.

    Set-similarity join by prefixes: values and names (titles and aliases) become sets of letter pairs, whose order
    is their rarity among the names; sets that are similar enough share one of their few rarest, so only those are
    joined, then filtered by length and position and compared exactly. The most similar entry is kept if it is at
    least SURE or one typing error away; ties go to the latter, then to the smallest entry_id.
    Null and blank texts and other labels give no row; of rows with one key the latest (annotated_at, if there is
    such a column) counts; null keys are left out. Each distinct value is compared once, however often it occurs.
    """
    spark = values.sparkSession
    scratch = Scratch(spark, "canonical")
    pairs = spark.createDataFrame([(t, c) for c, ts in targets.items() for t in ts], "entry_type string, cls string")
    when = F.col("annotated_at") if "annotated_at" in values.columns else F.lit(0)
    v = values.where(F.col(label).isin(*targets) & F.col(text).rlike(r"(?U)\S") & F.col(key).isNotNull())
    v = v.groupBy(F.col(key).alias("k")).agg(F.max_by(F.struct(F.col(label).alias("cls"), F.col(text).cast("string").alias("t")), F.struct(when, F.col(text))).alias("v")).select("k", "v.cls", "v.t")
    v = scratch.table(v)
    entries = reference.where("entry_id is not null").select("entry_id", "entry_type", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))
    entries = entries.join(F.broadcast(pairs), "entry_type").select("cls", "entry_id", "title", "aliases")

    def words(batches):
        import pyarrow as pa

        for cls, _, title, aliases in arrow_rows(batches):
            own = set(tokens(title))
            added = {w for a in aliases if a for w in tokens(a)} - own
            yield pa.RecordBatch.from_arrays([pa.array([cls] * (len(own) + len(added))), pa.array([*own, *added], pa.string()), pa.array([1] * len(own) + [0] * len(added), pa.int32())], ["cls", "w", "own"])

    # words that aliases of five entries or more put beside a title, while no title has them ("systems", "of")
    added = entries.mapInArrow(words, "cls string, w string, own int").groupBy("cls", "w").agg(F.max("own").alias("own"), F.count("*").alias("n")).where("own = 0 and n >= 5")
    fillers: dict[str, set] = {}
    for r in added.collect():
        fillers.setdefault(r["cls"], set()).add(r["w"])
    fill = {c: frozenset(ws) for c, ws in fillers.items()}
    none = frozenset()

    def named(batches):
        import pyarrow as pa

        for cls, entry, title, aliases in arrow_rows(batches):
            keys = {" ".join(tokens(n, fill.get(cls, none))) for n in (title, *aliases) if n} - {""}
            yield pa.RecordBatch.from_arrays([pa.array([cls] * len(keys)), pa.array([entry] * len(keys)), pa.array([*keys], pa.string()), pa.array([grams(x.split(" ")) for x in keys], pa.list_(pa.string()))], ["cls", "entry_id", "name", "gs"])

    names = scratch.table(entries.mapInArrow(named, "cls string, entry_id string, name string, gs array<string>"))
    # pairs of letters: as many as the square of the alphabet, whatever the length of the list
    rank: dict[str, dict[str, int]] = {}
    for r in names.select("cls", F.explode("gs").alias("g")).groupBy("cls", "g").count().collect():
        rank.setdefault(r["cls"], {})[r["g"]] = r["count"]

    def keyed(batches):
        import pyarrow as pa

        for b in batches:
            rows = list(zip(*(c.to_pylist() for c in b.columns)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([" ".join(tokens(t, fill.get(c, none))) for c, t in rows], pa.string())], ["cls", "t", "key"])

    texts = scratch.table(v.select("cls", "t").distinct().mapInArrow(keyed, "cls string, t string, key string"))

    def prefixes(least, entry):
        def run(batches):
            import pyarrow as pa

            for b in batches:
                rows = []
                for cls, name, *rest in zip(*(c.to_pylist() for c in b.columns)):
                    gs = grams(name.split(" "))
                    t = least or (LEAST if len(gs) > SHORT else LEAST_SHORT)
                    rows += [(cls, name, len(gs), t, g, i) for i, g in enumerate(_prefix(gs, rank.get(cls, {}), t))]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 6, (pa.string(), pa.string(), pa.int32(), pa.float64(), pa.string(), pa.int32()))], ["cls", "name", "n", "t", "g", "i"])

        return run

    shape = "cls string, name string, n int, t double, g string, i int"
    probe = texts.where("key <> ''").select("cls", "key").distinct().mapInArrow(prefixes(None, False), shape).toDF("cls", "key", "x", "t", "g", "i")
    index = names.select("cls", "name").distinct().mapInArrow(prefixes(LEAST_SHORT, True), shape).select("cls", "name", F.col("n").alias("y"), "g", F.col("i").alias("j"))
    met = probe.join(index, ["cls", "g"]).where("y >= t * x and x >= t * y and 1 + least(x - i - 1, y - j - 1) + least(i, j) >= t / (1 + t) * (x + y)")
    met = met.select("cls", "key", "name").distinct()

    def compare(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for a, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                x, y = a.split(" "), c.split(" ")
                g, h = set(grams(x)), set(grams(y))
                both = len(g & h)
                j = both / (len(g) + len(h) - both)
                out.append((j, near(x, y)))
            keep = [i for i, (j, n) in enumerate(out) if n or j >= SURE]
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(pa.array(keep, pa.int64())) for i in range(3)), pa.array([out[i][0] for i in keep], pa.float64()), pa.array([out[i][1] for i in keep], pa.bool_())], ["cls", "key", "name", "j", "near"])

    scored = met.mapInArrow(compare, "cls string, key string, name string, j double, near boolean").join(names.select("cls", "name", "entry_id"), ["cls", "name"])
    best = scored.groupBy("cls", "key").agg(F.min_by(F.struct("entry_id", "j"), F.struct(-F.round("j", 9), ~F.col("near"), F.col("entry_id"))).alias("b"))
    meaning = texts.join(best, ["cls", "key"], "left").select("cls", "t", F.coalesce("b.entry_id", F.lit("none")).alias("entry_id"), F.coalesce("b.j", F.lit(0.0)).alias("similarity"))
    meaning = scratch.table(meaning)
    small = table_bytes(meaning) <= 4_000_000
    return v.join(F.broadcast(meaning) if small else meaning, ["cls", "t"]).select(F.col("k").alias(key), "entry_id", "similarity")


def p5_found(spark, d):
    return map_values(spark.read.parquet(f"{d}/span_annotations.parquet"), spark.read.parquet(f"{d}/onet_entries.parquet")).select("annotation_id", "entry_id")


def p5_mapped(spark, d):
    return map_values(spark.read.parquet(f"{d}/span_annotations.parquet"), spark.read.parquet(f"{d}/onet_entries.parquet"))
