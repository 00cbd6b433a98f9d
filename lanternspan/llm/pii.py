"""Problem 6: personal information inside free text."""

from __future__ import annotations

import functools
import pickle
import re
from collections import Counter
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, hash_sample, in_batches, spread_rows
from .encodings import strangeness
from .tagger import OVERLAP, WINDOW, Tagger

TYPES = ("NAME", "EMAIL", "PHONE", "NATIONAL_ID", "ADDRESS")
TAGS = ["O", *(f"{b}-{t}" for t in TYPES for b in "BI")]
#: Documents with contact details from which the tagger learns: those with the smallest hashes of their ids.
SAMPLE = 2500
#: Training windows, at most; two fifths of them hold nothing personal.
MAX_WINDOWS = 3600
#: The length from which a document isn't a sample.
LONGEST = 20_000

_U, _L = "A-ZÀ-ÖØ-ÞĄĆĘŁŃŚŹŻĀ-ŽА-ЯЁЄІЇҐ", "a-zß-öø-ÿāąćęłńśźža-žа-яёєіїґ'’"
#: One part of a name: capitalized or all capitals, hyphenated or not.
_PART = rf"(?:[{_U}][{_L}]+|[{_U}]{{2}}[{_U}'’]*)(?:-(?:[{_U}][{_L}]+|[{_U}]{{2,}}))?"
_NAME = rf"(?<![\w@.+-]){_PART}(?:(?: [{_U}]\.)+ {_PART}| {_PART}|, {_PART}(?: [{_U}]\.)?)(?![\w@])|(?<![\w@.+-])(?:[{_U}]\. ?){{1,2}}{_PART}(?![\w@])|(?<![\w@.+-]){_PART} [{_U}]\.(?: ?[{_U}]\.)?(?!\w)"
NAME = re.compile(_NAME)
#: What stands in front of a name in the five languages.
NAME_CAPTIONS = (
    "Name:", "My name is", "Contact person:", "Please ask for", "Reference available from", "Kind regards,", "Best regards,", "Sincerely,", "ПІБ:", "Мене звати", "Контактна особа:", "З повагою,",
    "Imię i nazwisko:", "Nazywam się", "Osoba kontaktowa:", "Pozdrawiam,", "Z poważaniem,", "Ansprechperson:", "Ansprechpartner:", "Ansprechpartnerin:", "Mein Name ist", "Ich heiße", "Mit freundlichen Grüßen", "Nombre:", "Me llamo", "Persona de contacto:", "Un saludo,", "Atentamente,",
)
_CAPTIONED = re.compile(rf"(?:{'|'.join(map(re.escape, NAME_CAPTIONS))}),?[ \n]*[-*•]? ?({_NAME})")
_CAPITAL = re.compile(rf"[{_U}][\w'’]{{2,}}(?:-[{_U}]\w+)?")
_HOST = r"[\w-]+(?:(?:\.| ?\[dot\] ?| ?\(dot\) ?| dot )[\w-]+)*(?:\.| ?\[dot\] ?| ?\(dot\) ?| dot )[^\W\d_]{2,}"
EMAIL = re.compile(rf"(?<![\w.+-])[\w.+-]*\w(?:(?: ?@ ?| ?\[at\] ?| ?\(at\) ?){_HOST}| at [\w-]+(?: dot [\w-]+)+)", re.I)
#: Shapes of phone numbers: with a country code, with an area code in brackets, and national groupings.
PHONE = re.compile(
    r"(?<![\w+(])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\) ?)?\d[\d .\-/]{4,14}\d|\(\+\d{1,3}\) ?\d[\d .\-/]{5,12}\d|\(\d{2,5}\) ?\d{3}[ .-]?\d{2}[ .-]?\d{2}|00\d{2} ?\d{9}|1-\d{3}-\d{3}-\d{4}"
    r"|8 \d{3} \d{3}-\d{4}|\d{3}[.-]\d{3}[.-]\d{4}|0\d{2} \d{4} \d{4}|0\d{2,4}[/ -]\d{3,6}[ -]\d{2,4}|\d{3}([ .-])\d{3}\1\d{3}|0\d{9})(?![\w/]|[.,-]\d)"
)
#: Shapes of personal numbers; those of digits only need the caption in front.
ID_SHAPE = re.compile(
    r"(?<![\w+-])(?:\d{3}-\d{2}-\d{4}|\d{3}-\d{3}-\d{2}-\d{2}|[A-ZА-ЯІ]{2} \d{2} \d{2} \d{2} [A-Z]|[A-ZА-ЯЬ]{2,3} ?\d{6,7}|[A-Z]\d{2}-\d{4}-\d{3}|\d{8}-?[A-ZÑ]|[XYZ]-?\d{7}-?[A-ZÑ]|\d{2} \d{3} \d{3} \d{3}|[A-Z]\d{2}[A-Z]\d{5,6}|\d{2} \d{6} [A-Z] \d{3})(?![\w-])"
)
#: Captions of personal numbers.
ID_CAPTIONS = (
    "PESEL", "NIP", "NINO", "SSN", "DNI", "NIE", "NIF", "РНОКПП", "ІПН", "ID-card", "ID-картка", "Passport", "passport", "pasaporte", "paszport", "паспорт", "Reisepass", "Ausweisnummer", "Personalausweis", "Steuer-ID", "Sozialversicherungsnummer", "dowód osobisty", "insurance number", "ID card",
)
_ID_CAPTION = "(?:" + "|".join(map(re.escape, ID_CAPTIONS)) + ")"
ID_CAPTIONED = re.compile(_ID_CAPTION + r"(?: no\.?| nr\.?| is|:| №| number)*:? ?((?:[A-ZА-ЯЬ]{1,3} ?)?\d[\d -]*\d(?: ?-?[A-ZÑ](?: \d{3})?(?!\w))?)")
#: What the shape of addresses below needs of each language: one of these words or endings.
STREET_WORDS = (
    "Street", "St", "Lane", "Ln", "Road", "Rd", "Avenue", "Ave", "Court", "Ct", "Close", "Drive", "Dr", "Square", "Way", "Place", "Terrace", "straße", "strasse", "str.", "weg", "gasse", "platz", "allee", "ring", "damm", "ufer", "ul.", "al.", "os.", "pl.",
    "вул", "просп", "пров", "бульв", "пл.", "площа", "Calle", "C/", "Avenida", "Avda.", "Plaza", "Paseo",
)
_TOWN = rf"[{_U}][{_L}]+(?:[ -][{_U}][{_L}]+)?"
_STREET_EN = r"(?:Street|St\.?|Lane|Ln\.?|Road|Rd\.?|Avenue|Ave\.?|Court|Ct\.?|Close|Drive|Dr\.?|Square|Way|Place|Terrace)"
ADDRESS = re.compile(
    rf"(?<!\w)(?:(?:(?:Flat|Apt\.?|Unit) \d+\w?, )?\d+[a-z]? [{_U}][{_L}]+(?: [{_U}][{_L}]+)? {_STREET_EN}(?:, (?:Flat|Apt\.?|Unit) \d+\w?)?, ({_TOWN})(?:,? [A-Z]{{1,2}}\d{{1,2}}[A-Z]? \d[A-Z]{{2}})?"
    rf"|[{_U}][{_L}]+(?:straße|strasse|str\.|weg|gasse|platz|allee|ring|damm|ufer) \d+ ?[a-z]?, (?:\d{{5}} )?({_TOWN})"
    rf"|(?:ul|al|os|pl)\. ?[{_U}][{_L}]+(?: [{_U}][{_L}]+)? \d+[a-z]?(?:/\d+| m\. \d+)?, (?:\d{{2}}-\d{{3}} )?({_TOWN})"
    rf"|(?:вул|просп|пров|бульв|пл)\. ?[{_U}][{_L}]+, \d+[а-я]?(?:, кв\. \d+)?, (?:м\. ?)?({_TOWN})|(?:вулиця|проспект|провулок|бульвар|площа) [{_U}][{_L}]+,? \d+[а-я]?(?:/\d+)?, (?:м\. ?)?({_TOWN})"
    rf"|(?:Calle|C/|Avenida|Avda\.|Plaza|Paseo) (?:(?:de|del|la|las|los|el) )*[{_U}][{_L}]+(?: [{_U}][{_L}]+)?,? \d+(?:, \d+º ?\w*)?, (?:\d{{5}} )?({_TOWN}))"
)
_DIGIT = re.compile(r"\d")
_LOWER = re.compile(rf"[{_L}]{{2,}}(?:-[{_L}]+)*")
#: Share of all documents in which a word has to occur in lower case to count as common (two documents at least): the
#: words that do are fewer than the words of an average document over this share, however many documents there are.
COMMON = 2e-5
#: Sure enough for a span that no known shape bears out: the mean probability of its characters' tags.
SURE = 0.9
#: How much the outside tag's score is lowered where spans are looked for; shapes and SURE decide on what comes out.
LEAN = 1.0


#: What is no part of a span at its ends.
_TRIM = " \t\r.,;:|·•*-–()[]"


class Lexicon:
    """What texts say of words: which occur in lower case, which stand in names, which are towns."""

    def __init__(self, texts: list[str] = (), counts: tuple[Counter, Counter, Counter] | None = None, least: int = 2):
        lower, parts, towns = counts or self.count(texts)
        # at any size of the corpus some names are also met in lower case: a word counts as common where it is more often so than in names
        self.lower = frozenset(w for w, n in lower.items() if n >= least and n > parts[w])
        self.names = frozenset(w for w in parts if w not in self.lower)
        often = sorted(parts.values(), reverse=True)
        often = max(3, often[len(often) // 12] if often else 3)  # given names are few, so each occurs often
        self.given = frozenset(w for w, n in parts.items() if n >= often and w not in self.lower)
        self.towns = frozenset(w for w, n in towns.items() if n >= least)
        self.heads = frozenset(w.split("-")[0] for w in self.given)

    @classmethod
    def count(cls, texts) -> tuple[Counter, Counter, Counter]:
        """Texts in which a word occurs in lower case, parts of names under captions, and towns at the end of addresses."""
        lower, parts, towns, seen = Counter(), Counter(), Counter(), Counter()
        for t in texts:
            seen.update(set(t.split()))
            for m in _CAPTIONED.finditer(t) if any(map(t.__contains__, NAME_CAPTIONS)) else ():
                parts.update(cls.parts(m[1]))
            for line in t.split("\n") if any(map(t.__contains__, STREET_WORDS)) else ():  # no address goes beyond a line or lacks these
                for m in ADDRESS.finditer(line) if ", " in line and _DIGIT.search(line) else ():
                    if line[m.end() : m.end() + 1] in ("", ".", ",", ";"):
                        towns[next(g for g in m.groups() if g)] += 1
        for x, n in seen.items():
            if _LOWER.fullmatch(w := x.strip(_TRIM)):
                lower[w] += n
        return lower, parts, towns

    @classmethod
    def of(cls, docs: DataFrame) -> Lexicon:
        """The lexicon of all texts (column t). Rare words stay with the tasks: see COMMON for the bound on the others."""

        def run(batches):
            import pyarrow as pa

            for rows in in_batches(((t,) for (t,) in arrow_rows(batches)), chars=8_000_000):
                found = [(kind, w, n) for kind, c in enumerate(cls.count(t for (t,) in rows)) for w, n in c.items()]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, ty) for x, ty in zip(zip(*found), (pa.int32(), pa.string(), pa.int64()))], ["kind", "word", "n"])

        least = max(2, int(COMMON * docs.count()))
        n = docs.select("t").mapInArrow(run, "kind int, word string, n bigint").groupBy("kind", "word").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | ((F.col("kind") == 1) & (F.col("n") >= least // 10)))
        counts = (Counter(), Counter(), Counter())
        for r in n.toLocalIterator():
            counts[r["kind"]][r["word"]] = r["n"]
        return cls(counts=counts, least=least)

    def _key(self):
        return self.lower, self.names, self.given, self.towns

    def __eq__(self, other):
        return isinstance(other, Lexicon) and self._key() == other._key()

    def __hash__(self):
        return hash(self._key())

    @staticmethod
    def parts(name: str) -> list[str]:
        return [w.lower() for w in re.findall(r"[^\W\d_]{2,}(?:-[^\W\d_]{2,})?", name)]

    def town_end(self, m: re.Match, text: str) -> int:
        """End of an address: a second capitalized word belongs to the town only where the sample knows it so."""
        i = next(i for i in range(1, m.re.groups + 1) if m[i])
        town = m[i]
        if " " in town and m.end() == m.end(i) and town not in self.towns:
            return m.start(i) + town.index(" ")
        return m.end()


def shapes(text: str, lex: Lexicon) -> list[tuple[int, int, str]]:
    """Spans whose shape fits a type, stronger types first; overlapping weaker ones are left out."""
    found: list[tuple[int, int, str]] = []

    def add(a, b, kind):
        if not any(a < y and x < b for x, y, _ in found):
            found.append((a, b, kind))

    for m in EMAIL.finditer(text):
        add(m.start(), m.end(), "EMAIL")
    for m in ADDRESS.finditer(text):
        add(m.start(), lex.town_end(m, text), "ADDRESS")
    for m in ID_SHAPE.finditer(text):
        add(m.start(), m.end(), "NATIONAL_ID")
    for m in ID_CAPTIONED.finditer(text):
        add(m.start(1), m.end(1), "NATIONAL_ID")
    for m in PHONE.finditer(text):
        add(m.start(), m.end(), "PHONE")
    for m in _CAPTIONED.finditer(text):
        add(m.start(1), m.end(1), "NAME")
    at = 0
    while m := NAME.search(text, at):  # names may begin at any of the words of a run of capitalized ones
        ws = lex.parts(m[0])
        sure = sum(w in lex.given for w in ws) == 1 and all(w in lex.given or (w not in lex.lower and (w in lex.names or len(w) > 4)) for w in ws)
        if sure and len(ws) >= 1:
            add(m.start(), m.end(), "NAME")
            at = m.end()
        else:
            at = m.start() + max(1, len(re.match(r"\S+\s?", m[0])[0]))
    return found


#: What every span that find can return has in its line, whatever the tagger says: a digit of any kind (phone and personal
#: numbers, addresses), an at sign or word (addresses of mail), or what any name has, a capital behind another's word or
#: initial. Neither a shape nor a decoded span crosses lines.
_NEAR_OTHERS = re.compile(r"[\d¹²³⁰-₉①-⓿❶-➓\u1369-\u1371\u19da\U00010a40-\U00010a43\U00010e60-\U00010e68\U00011052-\U0001105a\U0001f100-\U0001f10a]|@|\[at\]|\(at\)| at ", re.I)
_NEAR_NAME = re.compile(rf"[{_U}][{_U}{_L}-]+,? [{_U}]|[{_U}]\. ?[{_U}]")


def may_hold(line: str) -> bool:
    """Whether a line can have a span in it: of what lacks all of these signs nothing is returned, whatever its tags."""
    return bool(_NEAR_OTHERS.search(line)) or bool(_NEAR_NAME.search(line))


_AT = re.compile(r"@|\[at\]|\(at\)| at [\w-]+ dot ", re.I)
_LETTERS = re.compile(r"[^\W\d_]+")


def may_fit(text: str, kind: str, lex: Lexicon) -> bool:
    """Whether shapes can have a span of the kind in a text: False only where it has none."""
    if kind == "EMAIL":
        return bool(_AT.search(text))
    if kind == "NAME":
        return any(w.lower() in lex.heads for w in _LETTERS.findall(text)) or bool(_CAPTIONED.search(text))
    if not _DIGIT.search(text):
        return False
    if kind == "ADDRESS":
        return ", " in text and any(map(text.__contains__, STREET_WORDS))
    if kind == "PHONE":
        return bool(PHONE.search(text))
    return bool(ID_SHAPE.search(text) or ID_CAPTIONED.search(text))


def windows(text: str) -> list[tuple[int, str]]:
    """(start, text) of the windows over every line that can hold a span, each line whole; one longer than a window is
    cut into overlapping ones, each of which overlaps with its neighbours only."""
    out, at = [], 0
    for line in text.split("\n"):
        if may_hold(line):
            out += [(at + i, line[i : i + WINDOW]) for i in range(0, max(1, len(line) - OVERLAP), WINDOW - OVERLAP)]
        at += len(line) + 1
    return out


def reformatted(number: str, rng: np.random.Generator) -> str:
    """The number's digits and letters in other groups, between other signs: no list of shapes has all ways to write one."""
    signs = [c for c in number if c.isalnum()]
    out, sep = [], " -./"[rng.integers(4)] if rng.random() < 0.9 else ""
    while signs:
        k = int(rng.integers(2, 6))
        out.append("".join(signs[:k]))
        signs = signs[k:]
    if len(out) > 1 and len(out[-1]) == 1:
        out[-2:] = ["".join(out[-2:])]
    if number.startswith("+"):
        return "+" + sep.join(out)
    return f"({out[0]}) {sep.join(out[1:])}" if rng.random() < 0.2 and len(out) > 1 else sep.join(out)


def train(texts: list[str], lex: Lexicon) -> Tagger:
    """The tagger, fitted to windows of the sample whose spans are labelled by captions, shapes and names met under
    captions; of numbers also in formats that no shape knows."""
    rng = np.random.default_rng(3)
    some, none = [], []

    def label(w: str, at: int, spans) -> np.ndarray:
        lab = np.zeros(len(w), np.int64)
        for a, b, kind in spans:
            x, y = max(a, at), min(b, at + len(w))
            if x < y:
                k = 1 + 2 * TYPES.index(kind)
                lab[x - at : y - at] = k + 1
                if x == a:
                    lab[x - at] = k
        return lab

    for t in texts:
        spans = sorted(shapes(t, lex))
        at = 0
        for line in t.split("\n"):
            own = [(a - at, b - at, kind) for a, b, kind in spans if at <= a < at + len(line)]
            at += len(line) + 1
            copies = [(line, own)]
            if any(kind in ("PHONE", "NATIONAL_ID") for *_, kind in own) and rng.random() < 0.6:
                parts, moved, p = [], [], 0
                for a, b, kind in own:
                    parts.append(line[p:a])
                    new = reformatted(line[a:b], rng) if kind in ("PHONE", "NATIONAL_ID") else line[a:b]
                    start = sum(map(len, parts))
                    moved.append((start, start + len(new), kind))
                    parts.append(new)
                    p = b
                copies.append(("".join(parts) + line[p:], moved))
            for ln, sp in copies:
                for i, w in windows(ln):
                    lab = label(w, i, sp)
                    (some if lab.any() else none).append((w, lab))
    rows = [part[i] for part, n in ((some, MAX_WINDOWS * 3 // 5), (none, MAX_WINDOWS * 2 // 5)) for i in rng.permutation(len(part))[:n]]
    chars = Counter(c for w, _ in rows for c in w)
    tagger = Tagger(TAGS, "".join(sorted(c for c, n in chars.items() if n >= 3)))
    if rows:
        tagger.fit([w for w, _ in rows], [lab for _, lab in rows])
    return tagger


@functools.lru_cache(maxsize=2)
def _trained(spark, texts: tuple[str, ...], lex: Lexicon) -> Tagger:
    """Trained in a task, so that the driver's memory and core stay free; the models of the last samples are kept."""
    sent = spark.sparkContext.broadcast((texts, lex))

    def fit(batches):
        import pyarrow as pa

        for _ in batches:
            texts, lex = sent.value
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(list(texts), lex))], pa.binary())], ["model"])

    return pickle.loads(spark.range(1, numPartitions=1).mapInArrow(fit, "model binary").collect()[0]["model"])


def _settle(text: str, a: int, b: int, kind: str, sure: float, fits: list[tuple[int, int, str]], lex: Lexicon) -> tuple[int, int] | None:
    """Bounds of a decoded span: its own, trimmed, if the tagger is SURE; where a shape of its type has half its
    characters or more, those of the shape, as it knows where numbers end. A name must not hold a common word, a number
    needs five digits and few letters, an address a digit, some letters and two blanks; none of them stands in garbled text."""
    best = max(((min(b, y) - max(a, x), x, y) for x, y, k in fits if k == kind), default=(0, 0, 0))
    if best[0] * 2 >= min(b - a, best[2] - best[1]) and best[0] > 0:
        return best[1:]
    while a < b and text[a] in (_TRIM.replace("(", "") if kind == "PHONE" else _TRIM):
        a += 1
    while b > a and text[b - 1] in _TRIM:
        b -= 1
    if kind == "EMAIL":
        return (a, b) if EMAIL.fullmatch(text[a:b]) else None
    if strangeness(text[max(0, a - 15) : b + 15]) > 0.5:
        return None  # wrongly decoded text looks like anything
    if kind == "NAME":
        m = NAME.search(text[a:b])
        if not m or sure < SURE or any(w in lex.lower for w in lex.parts(m[0])):
            return None
        return a + m.start(), a + m.end()
    digits, letters = sum(c.isdigit() for c in text[a:b]), sum(c.isalpha() for c in text[a:b])
    if sure < SURE or not (digits >= 1 and letters >= 4 and text.count(" ", a, b) >= 2 if kind == "ADDRESS" else digits >= 5 and letters <= {"PHONE": 0, "NATIONAL_ID": 3}[kind]):
        return None
    edge = text[a - 1 : a] + text[b : b + 1]
    return None if any(c.isalnum() for c in edge) else (a, b)


def reconcile(pieces: list[tuple[int, np.ndarray, np.ndarray]]) -> list[tuple[int, int, str, float]]:
    """Spans, with their mean probability, from the tags of overlapping windows: where two overlap, each position takes
    the tag of the window whose middle is nearer."""
    out: list[tuple[int, int, str, float]] = []
    tags: dict[int, tuple[float, int, float]] = {}
    last = -1
    for at, t, *p in pieces:
        p = p[0] if p else np.ones(len(t))
        mid = at + len(t) / 2
        before = last + 1 - at
        inside = t.nonzero()[0]
        for i, k, x in zip(inside.tolist(), t[inside].tolist(), p[inside].tolist()):
            new = (abs(at + i - mid), k, x)
            tags[at + i] = min(tags.get(at + i, new), new)
        if len(inside):
            last = max(last, at + int(inside[-1]))
        for i in (t[:before] == 0).nonzero()[0].tolist() if before > 0 else ():  # an outside tag counts as well
            if at + i in tags and abs(at + i - mid) < tags[at + i][0]:
                del tags[at + i]
    run = None
    for p in sorted(tags):
        _, k, sure = tags[p]
        kind = TYPES[(k - 1) // 2]
        if run and run[2] == kind and p == run[1] and k % 2 == 0:
            run = (run[0], p + 1, kind, run[3] + sure)
        else:
            if run:
                out.append(run)
            run = (p, p + 1, kind, sure)
    return [(a, b, kind, total / (b - a)) for a, b, kind, total in ([*out, run] if run else out)]


def find(text: str, lex: Lexicon, decoded: list[tuple[int, np.ndarray, np.ndarray]]) -> list[tuple[int, int, str]]:
    """Spans from the tagged windows of a text. Shapes are looked up around what was decoded only."""
    rough, out, near, fits = reconcile(decoded), set(), (0, 0), None
    for a, b, kind, sure in rough:
        if b + 60 > near[1]:
            near, fits = (max(0, a - 100), b + 160), None
        if fits is None and may_fit(part := text[near[0] : near[1]], kind, lex):
            fits = [(near[0] + x, near[0] + y, k) for x, y, k in shapes(part, lex)]
        if got := _settle(text, a, b, kind, sure, fits or [], lex):
            out.add((*got, kind))
    kept: list[tuple[int, int, str]] = []
    for a, b, kind in sorted(out, key=lambda s: (s[0], -s[1])):
        if not kept or a >= kept[-1][1]:
            kept.append((a, b, kind))
    return kept


def tagged(texts: list[str], tagger: Tagger, batch: int = 768) -> dict[int, list[tuple[int, np.ndarray, np.ndarray]]]:
    """By text, the tags and their probabilities of its windows. All windows are read; those with outside tags only are
    left out unless one beside them has others, as find makes nothing of them."""
    pieces = [(i, at, w) for i, t in enumerate(texts) for at, w in windows(t)]
    got: list = [None] * len(pieces)
    order, hits = sorted(range(len(pieces)), key=lambda j: len(pieces[j][2])), []
    for k in range(0, len(order), batch):
        part = order[k : k + batch]
        tags, sure = tagger.decode_with_confidence(tagger.encode([pieces[j][2] for j in part]), LEAN)
        for c, j in enumerate(part):
            got[j] = tags, sure, c
        hits += [part[c] for c in np.flatnonzero(tags.any(0)).tolist()]
    out: dict[int, list] = {}
    for j in sorted({x for j in hits for x in (j - 1, j, j + 1) if 0 <= x < len(pieces) and pieces[x][0] == pieces[j][0] and abs(pieces[x][1] - pieces[j][1]) < WINDOW}):
        (i, at, w), (tags, sure, c) = pieces[j], got[j]
        out.setdefault(i, []).append((at, tags[: len(w), c], sure[: len(w), c]))
    return out


def personal(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, redact: bool = False) -> DataFrame:
    """(key, span_start, span_end, pii_type) of each occurrence, or with redact=True (key, redacted, n_spans).

    A character-level bidirectional LSTM with CRF transitions, trained on windows of at most `sample` documents,
    tags every window; overlapping windows are reconciled into spans. Only lines are passed over of which no tag could
    make a span (see may_hold). Where a known shape meets a span it gives its bounds; else the tagger's own stand if it is sure. In the redacted text each span is "[TYPE]".
    Offsets count code points. Null and empty texts, and those with nothing found, give no span; redacted texts come
    for all non-null ones. Repeated rows give their spans once per row with another text.
    """
    spark = docs.sparkSession
    base = spread_rows(docs.select(F.col(key).cast("bigint").alias("doc"), F.col(text).cast("string").alias("t")).where("t is not null"))
    contact = reduce(lambda a, b: a | b, (F.contains("t", F.lit(c)) for c in ("@", "[at]", "(at)", *NAME_CAPTIONS)), F.col("t").rlike(r"\+\d{2}"))
    rows = hash_sample(base, "doc", contact & (F.length("t") < LONGEST), sample, 0.1).collect()
    lex = Lexicon.of(base)
    sent = spark.sparkContext.broadcast((_trained(spark, tuple(r["t"] for r in rows), lex), lex))

    def run(batches):
        import pyarrow as pa

        tagger, lex = sent.value
        for rows in in_batches(arrow_rows(batches)):
            decoded = tagged([t for _, t in rows], tagger)
            out = []
            for i, (doc, t) in enumerate(rows):
                if i not in decoded and not redact:
                    continue
                spans = find(t, lex, decoded.get(i, []))
                if redact:
                    parts, at = [], 0
                    for a, b, kind in spans:
                        parts += [t[at:a], f"[{kind}]"]
                        at = b
                    out.append((doc, "".join(parts) + t[at:], len(spans)))
                else:
                    out += [(doc, *s) for s in spans]
            if out:
                types, names = ((pa.int64(), pa.string(), pa.int64()), ["doc", "redacted", "n"]) if redact else ((pa.int64(), pa.int64(), pa.int64(), pa.string()), ["doc", "a", "b", "kind"])
                yield pa.RecordBatch.from_arrays([pa.array(x, ty) for x, ty in zip(zip(*out), types)], names)

    if redact:
        return base.mapInArrow(run, "doc bigint, redacted string, n bigint").toDF(key, "redacted", "n_spans")
    return base.mapInArrow(run, "doc bigint, a bigint, b bigint, kind string").toDF(key, "span_start", "span_end", "pii_type")


def p6_found(spark, d):
    return personal(spark.read.parquet(f"{d}/documents.parquet")).distinct()


def p6_redacted(spark, d):
    return personal(spark.read.parquet(f"{d}/documents.parquet"), redact=True)
