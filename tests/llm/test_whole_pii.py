"""Personal information that neither a sign nor the sample announces."""

import random

import numpy as np
import pytest

from lanternspan.llm import pii
from lanternspan.llm.tagger import Tagger


@pytest.mark.parametrize(
    "line",
    ["Angaben: Ausweisnummer: L00X65031", "L00X03405", "AB 12 34 56 C", "Passport: 12", "(02) 123 45 67", "8 044 123-4567", "ul. Polna 3/4, Gdynia", "вул. Лісова, 2, Ромни", "write to jorun at mail dot example", "x[AT]y.example", "Quentow, Tolmar", "J. Kestrel", "KESTREL J."],
)
def test_lines_with_a_shape_are_read(line):
    assert pii.windows(f"plain words\n{line}\nplain words") == [(12, line)]


def test_long_lines_are_read_whole():
    line = "plain words " * 40 + "7"
    assert set(range(len(line))) == {i for at, w in pii.windows(line) for i in range(at, at + len(w))}


def test_lexicon_counts_all_documents(spark):
    rng = random.Random(1)
    rows = [(i, f"Name: {rng.choice(['Jorun', 'Elmira'])} Kestrel{'abcdefghij'[i % 10]}\nplain words") for i in range(40)] + [(99, "Name: Wendel Verrinaard\n" + "long text " * 3000)]
    lex = pii.Lexicon.of(spark.createDataFrame(rows, "doc bigint, t string").repartition(4))
    assert {"wendel", "verrinaard", "jorun"} <= lex.names and {"plain", "words"} <= lex.lower
    assert lex == pii.Lexicon([t for _, t in rows])


def test_decoded_names_of_unknown_parts_are_kept():
    t = "we met Oswin Tarrel there"
    tags = np.zeros(len(t), np.int64)
    tags[7:19] = 2
    tags[7] = 1
    assert pii.find(t, pii.Lexicon(["plain words", "plain words"]), [(0, tags)]) == [(7, 19, "NAME")]


class _Marks:
    """Stands for the tagger: tags what it is told to as a name and keeps what it was given."""

    def __init__(self, *names):
        self.names, self.read = names, []

    def encode(self, texts):
        self.read += texts
        self.now = texts
        return np.ones((max(map(len, texts)), len(texts)), np.int32)

    def decode_with_confidence(self, ids, lean=0.0):
        tags = np.zeros(ids.shape, np.int8)
        for c, t in enumerate(self.now):
            for n in self.names:
                if n in t:
                    tags[t.index(n) : t.index(n) + len(n), c] = 2
                    tags[t.index(n), c] = 1
        return tags, np.ones(ids.shape, np.float32)


def test_the_tagger_reads_every_line_that_can_hold_a_span():
    lines = ["gestern half uns wieder Oswin Tarrel beim umzug", "so plain words " * 30 + "then Brenna Quillow left", "Yes We Can", "room 7", "plain words only"]
    texts = ["\n".join(lines), "plain words", "", "Mirel Dost"]
    tagger = _Marks("Oswin Tarrel", "Brenna Quillow", "Mirel Dost")
    decoded = pii.tagged(texts, tagger, batch=2)
    for line in (*lines[:4], "Mirel Dost"):
        assert all(any(line[i : i + 2] in w for w in tagger.read) for i in range(len(line) - 1))
        assert sum(w in line for w in tagger.read) == len(pii.windows(line))
    lex = pii.Lexicon(["plain words", "plain words"])
    assert [[t[a:b] for a, b, _ in pii.find(t, lex, decoded.get(i, []))] for i, t in enumerate(texts)] == [["Oswin Tarrel", "Brenna Quillow"], [], [], ["Mirel Dost"]]


def test_lines_passed_over_give_nothing_whatever_their_tags():
    lex, rng = pii.Lexicon(["plain words", "plain words"]), random.Random(2)
    pool = ["Passport:", "ul.", "Name:", "dot", "example", "at", "McX", "and", "PESEL", "Street,", "O'Neil", "ab-cd", "I", "Kestrel,", "J.", "(+)", "[]", "é", "вул."]
    lines = [" ".join(rng.choices(pool, k=rng.randint(1, 8))) for _ in range(3000)]
    passed = [x for x in lines if not pii.may_hold(x)]
    assert len(passed) > 300
    for line in passed:
        for k in range(len(pii.TYPES)):
            tags = np.full(len(line), 2 + 2 * k)
            tags[0] -= 1
            assert pii.find(line, lex, [(0, tags)]) == []
    assert all(pii.may_hold(c) for c in map(chr, range(0x110000)) if c.isdigit())


def _random_tagger(seed=0, outside=0.0):
    """A tagger whose weights are drawn, with a score added to the outside tag's: tags of all kinds come out."""
    rng = np.random.default_rng(seed)
    t = Tagger(pii.TAGS, "abcdefgh0 ,.", seed=seed)
    t.p["T"] = rng.standard_normal(t.p["T"].shape).astype(np.float32)
    t.p["O"] *= 3
    t.p["o"][0] += outside
    return t


def _random_texts(rng, n, length):
    return ["".join(rng.choice("abcdefgh0 ,.") for _ in range(length or rng.randint(1, 60))) for _ in range(n)]


@pytest.mark.parametrize("outside", [0.0, 1.0, 2.0])
def test_tags_do_not_depend_on_the_texts_beside(outside):
    tagger, texts, some = _random_tagger(outside=outside), _random_texts(random.Random(3), 120, 0), 0
    tags, sure = tagger.decode_with_confidence(tagger.encode(texts), 1.0)
    for c, x in enumerate(texts):
        own, p = tagger.decode_with_confidence(tagger.encode([x]), 1.0)
        assert (tags[: len(x), c] == own[:, 0]).all() and not tags[len(x) :, c].any()
        assert np.allclose(sure[: len(x), c], p[:, 0], atol=1e-4)
        some += own.any()
    assert some


@pytest.mark.parametrize("outside", [0.0, 1.0, 2.0])
def test_tags_are_those_of_the_plain_network(outside):
    tagger = _random_tagger(1, outside)
    ids = tagger.encode(_random_texts(random.Random(4), 200, 40))
    tags, sure = tagger.decode_with_confidence(ids, 1.0)
    e, trans = tagger.emissions(ids)[0].astype(np.float64), tagger.p["T"].astype(np.float64)
    e[:, :, 0] -= 1
    score = lambda path, c: e[np.arange(len(path)), c, path].sum() + trans[path[:-1], path[1:]].sum()
    for c in range(ids.shape[1]):
        s, back = e[0, c], []
        for t in range(1, len(e)):
            way = s[:, None] + trans
            back.append(way.argmax(0))
            s = way.max(0) + e[t, c]
        path = [int(s.argmax())]
        for b in back[::-1]:
            path.append(int(b[path[-1]]))
        assert score(tags[:, c].astype(int), c) > score(np.array(path[::-1]), c) - 1e-3
        if tags[:, c].any():
            p = np.exp(e[:, c] - e[:, c].max(1, keepdims=True))
            assert np.allclose(sure[:, c], p[np.arange(len(p)), tags[:, c]] / p.sum(1), atol=1e-3)


_POOL = ["Passport:", "ul. Polna 3/4,", "Gdynia", "12 Elm Street,", "Dover", "Name:", "Oswin Tarrel", "Tarrel,", "Jorun-Ann", "dot", "example", "jo at mail dot example", "x@y.example", "x [AT] y.example", "J.", "PESEL", "+44 20 7946 0958", "020 7946 0958", "L00X65031", "Hauptstraße 5,", "Berlin", "7", "(3)", "and", "plain words"]


def test_shapes_are_only_passed_over_where_there_are_none():
    lex, rng, met = pii.Lexicon(["Name: Jorun Kestrel\nName: Jorun Dost\nName: Jorun Velt\nplain words and"] * 3), random.Random(5), set()
    for _ in range(3000):
        text = rng.choice(" \n").join(rng.choices(_POOL, k=rng.randint(1, 6)))
        kinds = {k for *_, k in pii.shapes(text, lex)}
        met |= kinds
        assert all(pii.may_fit(text, k, lex) for k in kinds)
    assert met == set(pii.TYPES) and lex.given


def test_shapes_are_not_looked_up_for_types_that_none_can_have(monkeypatch):
    calls, shapes = [], pii.shapes
    monkeypatch.setattr(pii, "shapes", lambda t, lex: calls.append(t) or shapes(t, lex))
    t, tags = "we run releases with 7 plain words there", np.zeros(40, np.int64)
    for k in (1, 2, 3, 4):
        tags[12:30] = 2 + 2 * k
        tags[12] -= 1
        pii.find(t, pii.Lexicon(["plain words", "plain words"]), [(0, tags)])
    assert not calls
    mail = "write to x@y.example"
    tags = np.zeros(len(mail), np.int64)
    tags[9:], tags[9] = 4, 3
    assert pii.find(mail, pii.Lexicon([]), [(0, tags)]) == [(9, 20, "EMAIL")] and calls
