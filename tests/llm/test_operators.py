"""Each operator against brute force or its own promises on small fixtures, and on awkward input."""

import random
import re

import numpy as np
import pytest

from lanternspan.llm import canonical, encodings, languages, leaks, neardup, packing, pieces, pii, sharedspans, splits, tagger
from lanternspan.llm.common import WORD

DOCS = "doc_id bigint, record_id string, text string, lang string, source string, author_id bigint, key string, h bigint, doc string, t string"
WORDS = "alpha bravo cedar delta ember flint grove heron inlet jetty knoll larch maple north ocean plain quartz ridge slope tower".split()


def words(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def frame(spark, texts):
    """Rows of awkward tables: extra columns named like the operators' own ones."""
    return spark.createDataFrame([(i, f"cv::r{i}", t, "en", "feed", (i or 0) % 3, "x", 1, "y", "z") for i, t in texts], DOCS)


AWKWARD = [(1, None), (2, ""), (3, " \n "), (4, "word"), (5, "x" * 50_000), (6, "same text here."), (6, "same text here."), (None, "no id"), (7, "𝔘nicode 🙂 ends"), (8, "-" * 3000 + "\n" * 50)]


@pytest.mark.parametrize("rows", [[], AWKWARD], ids=["empty", "awkward"])
def test_awkward_input_gives_rows_of_a_fixed_schema(spark, rows):
    d = frame(spark, rows)
    items = d.withColumnRenamed("doc_id", "item_id")
    feats = d.selectExpr("concat('cv::r', doc_id, '::chunk-0') AS feature_id", "record_id", "key", "h")
    out = {
        "splits": splits.split_features(feats, d),
        "groups": splits.feature_groups(feats, d, splits.Scratch(spark, "t")),
        "pieces": pieces.split_oversized(d, "doc_id", "text", "document", 1000, 50),
        "languages": languages.segments(d),
        "near": neardup.NearDuplicates(d, k=3, threshold=0.7).pairs(),
        "near groups": neardup.NearDuplicates(d, k=3, threshold=0.7).groups(),
        "pii": pii.personal(d),
        "redacted": pii.personal(d, redact=True),
        "encodings": encodings.repair(d),
        "packing": packing.fill_containers(packing.count_words_and_signs(d, "doc_id", "text"), "doc_id", 64),
        "leaks": leaks.containment_search(items, d),
        "leaks joined": leaks.containment_search(items, d, max_index=0),
        "shared": sharedspans.shared_spans(d, length=300),
    }
    got = {k: v.collect() for k, v in out.items()}
    if not rows:
        assert not any(got.values())
    else:
        assert {r.feature_id for r in got["splits"]} == {f"cv::r{i}::chunk-0" for i in range(1, 9)}
        assert {r.item_key for r in got["pieces"]} == {"5", "8"}
        assert not got["shared"] and not got["leaks"] and not got["leaks joined"]
        assert {r.doc_id for r in got["packing"] if r.container is None} >= {1, 2, 3}
        assert len(got["redacted"]) == 9  # all but the null text; nothing personal is in them
        assert all(r.n_spans == 0 for r in got["redacted"])


def test_values_awkward(spark):
    ref = spark.createDataFrame([("e1", "technology_skill", "Quillbase", ["QB Server", None]), ("e2", "technology_skill", None, None), (None, "skill", "x", []), ("e3", "skill", "Risk Triage", [])], "entry_id string, entry_type string, title string, aliases array<string>")
    rows = [(1, "TECHNOLOGY", "quillbase v8", "k"), (1, "TECHNOLOGY", "quillbase v8", "k"), (2, "SKILL", "risk traige", "k"), (3, "SKILL", None, "k"), (4, "SKILL", "  ", "k"), (5, "INDUSTRY", "x", "k"), (6, "TECHNOLOGY", "???", "k"), (None, "SKILL", "a", "k"), (7, "TECHNOLOGY", "z" * 5000, "k"), (8, "TECHNOLOGY", "Квіллбасе®", "k"), (9, "TECHNOLOGY", "base", "k")]
    v = spark.createDataFrame(rows, "annotation_id bigint, label string, text string, key string")
    got = {r.annotation_id: r.entry_id for r in canonical.map_values(v, ref).collect()}
    assert got == {1: "e1", 2: "e3", 6: "none", 7: "none", 8: "e1", 9: "none"}
    assert canonical.map_values(v.limit(0), ref).count() == 0
    assert {r.entry_id for r in canonical.map_values(v, ref.limit(0)).collect()} == {"none"}


def test_one_typing_error():
    assert canonical.near(["abcd"], ["abdc"]) and canonical.near(["abcd"], ["abcde"]) and canonical.near(["abcd"], ["abxd"])
    assert not canonical.near(["abcd"], ["badc"]) and not canonical.near(["abc"], ["abd"])


def test_prefixes_meet_where_sets_are_similar():
    rng = random.Random(1)
    rank = {chr(97 + i): i for i in range(26)}
    for _ in range(2000):
        a, b = (set(rng.sample("abcdefghijklmnop", rng.randint(1, 12))) for _ in "ab")
        if len(a & b) / len(a | b) >= 0.45:
            assert set(canonical._prefix(sorted(a), rank, 0.45)) & set(canonical._prefix(sorted(b), rank, 0.3))


def test_groups_follow_all_links(spark):
    rows = [("cv::a", 5), (" CV::A ", 3), ("cv::b", 3), ("cv::b", 9), ("cv::c", 9), ("cv::d", None), ("cv::e", 7), (None, 7), ("  ", 5)]
    d = spark.createDataFrame(rows, "record_id string, author_id bigint")
    f = spark.createDataFrame([(f"cv::{x}::chunk-{i}",) for x in "abcdef" for i in (0, 1)], "feature_id string")
    got = {r.feature_id: (r.group_author, r.n_records) for r in splits.feature_groups(f, d, splits.Scratch(spark, "t")).collect()}
    assert got["cv::a::chunk-0"] == got["cv::c::chunk-1"] == (3, 3)
    assert got["cv::d::chunk-0"] == got["cv::f::chunk-0"] == (None, 1) and got["cv::e::chunk-0"] == (7, 1)
    s = {r.feature_id: r.split for r in splits.split_features(f, d).collect()}
    assert len(s) == 12 and len({s[f"cv::{x}::chunk-{i}"] for x in "abc" for i in (0, 1)}) == 1


def test_long_chains_of_records_settle(spark):
    n = 200
    d = spark.createDataFrame([(f"r{i}", a) for i in range(n) for a in (i, i + 1)], "record_id string, author_id bigint")
    f = spark.createDataFrame([(f"r{n - 1}::chunk-0",)], "feature_id string")
    assert splits.feature_groups(f, d, splits.Scratch(spark, "t")).first().group_author == 0


@pytest.mark.parametrize("histogram", [{1: 100}, {1: 3, 5: 4, 60: 1}, {7: 10}, {2: 1}, {50: 1, 3: 17, 1: 9}])
def test_split_totals_are_the_closest(histogram):
    total = sum(s * m for s, m in histogram.items())
    train, dev, test = splits.choose_counts(histogram, [0.8, 0.1, 0.1])
    for s, m in histogram.items():
        assert train[s] + dev[s] + test[s] == m
    reach = {0}
    for s, m in histogram.items():
        reach = {r + s * k for r in reach for k in range(m + 1)}
    target = round(total * 0.1)
    assert abs(sum(s * k for s, k in dev.items()) - target) == min(abs(r - target) for r in reach)


def test_pieces_keep_limit_overlap_and_text():
    rng = random.Random(4)
    for n, limit, overlap in ((5000, 700, 60), (1201, 1200, 120), (9000, 1200, 120), (300, 100, 0)):
        t = words(rng, n)[:n].replace(" n", ".\nN").replace(" o", "\n\no")
        p = pieces.cut(t, limit, overlap)
        assert p[0][0] == 0 and p[-1][1] == len(t) and all(b - a <= limit for a, b in p)
        assert all(c == b - overlap for (_, b), (c, _) in zip(p, p[1:]))
        assert all(t[b].isspace() for _, b in p[:-1])
    assert pieces.cut("x" * 2500, 1000, 100)[-1][1] == 2500 and pieces.cut("", 10, 1) == [] and pieces.cut("abc", 10, 1) == [(0, 3)]
    with pytest.raises(ValueError):
        pieces.cut("x" * 20, 10, 10)


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(2)
    texts = []
    for i in range(60):
        base = words(rng, rng.randint(45, 120)).split(" ")
        texts.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            e = list(base)
            for _ in range(rng.randrange(6)):
                e[rng.randrange(len(e))] = "edit" + str(rng.randrange(999))
            texts.append((" ".join(e)).upper())
    d = frame(spark, list(enumerate(texts)))
    sets = {i: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} for i, t in enumerate(texts) if len(w := WORD.findall(t.lower())) >= 40}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])}
    n = neardup.NearDuplicates(d, k=3, threshold=0.7, min_words=40)
    assert {tuple(r) for r in n.pairs().collect()} == want
    groups = {r.doc_id: r.group_id for r in n.groups().collect()}
    assert set(groups) == set(sets) and all(groups[a] == groups[b] for a, b in want)


@pytest.mark.parametrize("length", [60, 300])
def test_shared_spans_against_brute_force(spark, length):
    rng = random.Random(3)
    pool = [words(rng, 90) for _ in range(3)]
    texts = []
    for _ in range(25):
        t = words(rng, rng.randint(5, 120))
        for _ in range(rng.randrange(3)):
            p = rng.choice(pool)
            a = rng.randrange(0, 200)
            t += p[a : a + rng.randint(length - 5, 600)] + words(rng, 4)
        texts.append(t)
    texts += [texts[0], texts[0][:-1] + "é", "ab" * 400]
    at: dict = {}
    for i, t in enumerate(texts):
        for p in range(len(t) - length + 1):
            at.setdefault(t[p : p + length], set()).add(i)
    want = set()
    for i, t in enumerate(texts):
        span = None
        for p in range(len(t) - length + 1):
            if len(at[t[p : p + length]]) > 1:
                if span and p <= span[1]:
                    span[1] = p + length
                else:
                    want |= {(i, *span)} if span else set()
                    span = [p, p + length]
        want |= {(i, *span)} if span else set()
    assert {tuple(r) for r in sharedspans.shared_spans(frame(spark, list(enumerate(texts))), length=length).collect()} == want


@pytest.mark.parametrize("v", sharedspans.COVERS)
def test_covers_hold_every_difference(v):
    c = sharedspans.COVERS[v]
    assert {(a - b) % v for a in c for b in c} == set(range(v))


def test_squeezed_numbers_return():
    x = np.random.default_rng(1).integers(0, 2**48, 1000).astype(np.uint64)
    assert (sharedspans.unsqueeze(sharedspans.squeeze(x, 6), 6) == x).all()


@pytest.mark.parametrize("limit", [0, leaks.MAX_INDEX])
def test_leaks_against_brute_force(spark, limit):
    rng = random.Random(5)
    items = [words(rng, n) for n in (10, 19, 20, 60, 200)]
    docs = [words(rng, 300)]
    for it in items:
        w = it.split(" ")
        for n in (15, 19, 20, 40):
            a = rng.randrange(max(1, len(w) - n))
            docs.append(words(rng, 30) + " " + ", ".join(w[a : a + n]).upper() + " " + words(rng, 200))
    grams = lambda t: {tuple(w[k : k + 20]) for w in [WORD.findall(t.lower())] for k in range(len(w) - 19)}
    want = {(i, j) for i, it in enumerate(items) for j, d in enumerate(docs) if grams(it) & grams(d)}
    got = leaks.containment_search(frame(spark, list(enumerate(items))).withColumnRenamed("doc_id", "item_id"), frame(spark, list(enumerate(docs))), max_index=limit)
    assert {(r.item_id, r.doc_id) for r in got.collect()} == want and want


def test_packing_holds_capacity_and_loses_nothing(spark):
    rng = random.Random(6)
    sizes = [(i, rng.choice([0, 1, 30, 200, 500, 900, 1024, 1025, 5000])) for i in range(800)]
    rows = packing.fill_containers(spark.createDataFrame(sizes, "doc_id bigint, tokens bigint"), "doc_id", 1024, shard_items=300).collect()
    fill, total = {}, {}
    for r in rows:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.tokens
        if r.container:
            fill[r.container] = fill.get(r.container, 0) + r.tokens
    assert total == dict(sizes) and max(fill.values()) <= 1024
    assert sum(fill.values()) > 0.9 * 1024 * len(fill)
    assert {r.doc_id for r in rows if r.piece_index > 0} == {i for i, n in sizes if n > 1024}


@pytest.mark.parametrize("chain", [c for c in encodings.CHAINS if c.startswith("utf-8>")])
def test_garbled_prose_returns(chain):
    lines = ["Мій дім стоїть біля річки, де щороку цвіте вишня.", "Wir prüften täglich größere Mengen für Köln.", "Żółw poszedł na łąkę, gdzie świeciło słońce."]
    known = [(x, g) for x in lines if (g := encodings.garble(x, chain)) and g != x]
    assert sum(encodings.restore(g)[0] == x for x, g in known) >= len(known) - 1
    assert all(encodings.restore(g)[1] for _, g in known)


def test_clean_text_is_left_alone():
    t = "Résumés in any format – it’s fine.\nНавички: Квілбейз, Вимоги\nWoрkshop Bluefin® 3 200 €\nРНОКПП 0123456789\n¿Qué? ¡Sí!"
    assert encodings.restore(t) == (t, [], False)
    assert encodings.restore("a � b")[2] and encodings.restore("?????? ??")[2]


def test_languages_of_mixed_documents(spark):
    p = {k: v.split("\n") for k, v in encodings.PROSE.items()}
    rows = [(1, "\n".join(p["en"][3:9] + p["pl"][:3]), "en"), (2, "\n".join(p["uk"][:4]), None), (3, encodings.garble("\n".join(p["uk"][:4]), "utf-8>cp1252"), "uk-UA"), (4, "\n".join(p["de"][:5]), "es")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {(r.doc_id, r.lang) for r in languages.segments(d).collect() if r.tokens >= 15}
    assert got == {(1, "en"), (1, "pl"), (2, "uk"), (3, "uk"), (4, "de")}


def test_romanized_words():
    assert languages.romanize("щоденник") == "shchodennyk" and languages.romanize("юрій") == "yurii"


def test_tagger_learns_and_is_deterministic():
    rng = random.Random(7)
    texts = [f"{rng.choice(WORDS)} call {rng.randrange(10**6, 10**7)} {rng.choice(WORDS)}" for _ in range(200)]
    labels = [np.array([1 if c.isdigit() else 0 for c in t]) for t in texts]
    fit = lambda: tagger.Tagger(["O", "N"], "".join(sorted({c for t in texts for c in t})), emb=8, hidden=8).fit(texts, labels, epochs=15)
    a, b = fit(), fit()
    ids = a.encode(["ember call 7654321 north"])
    assert (a.decode(ids) == b.decode(ids)).all() and a.decode(ids)[11:18, 0].all() and not a.decode(ids)[:10, 0].any()


def test_shapes_of_personal_information():
    t = "Name: Jorun Kestrel\nWrite to jorun.k+jobs@mail.example or jorun at mail dot example. Tel: +44 7700 900123, SSN 123-45-6789; 12 Elm Street, Apt 4, Kestrelby"
    lex = pii.Lexicon([t])
    found = {(t[a:b], k) for a, b, k in pii.shapes(t, lex)}
    assert found >= {("Jorun Kestrel", "NAME"), ("jorun.k+jobs@mail.example", "EMAIL"), ("jorun at mail dot example", "EMAIL"), ("+44 7700 900123", "PHONE"), ("123-45-6789", "NATIONAL_ID"), ("12 Elm Street, Apt 4, Kestrelby", "ADDRESS")}


def test_personal_information_is_found_and_replaced(spark):
    rng = random.Random(8)
    given, family = ["Jorun", "Elmira", "Tolmar", "Varga", "Selwyn"], ["Kestrel", "Brambick", "Quentow", "Halstead", "Drossel"]
    rows = []
    for i in range(150):
        g, f = rng.choice(given), rng.choice(family)
        rows.append((i, f"We test every release.\nContact person: {g} {f}\nEmail: {g.lower()}{i}@mail{i}.example\nTel: +44 7700 900{i:03d}\nOrder no. {i:04d}-221-{i:04d} was archived."))
    d = frame(spark, rows)
    got = pii.personal(d).collect()
    text = dict(rows)
    by = {k: {(r.doc_id, text[r.doc_id][r.span_start : r.span_end]) for r in got if r.pii_type == k} for k in pii.TYPES}
    for kind, pattern in (("EMAIL", r"\S+@\S+"), ("PHONE", r"\+44 7700 \d+"), ("NAME", r"(?<=person: ).+")):
        want = {(i, re.search(pattern, t)[0]) for i, t in rows}
        assert len(by[kind] & want) >= 0.95 * len(want), kind
    out = {r.doc_id: r.redacted for r in pii.personal(d, redact=True).collect()}
    assert sum("[NAME]" in t and "[EMAIL]" in t and "release" in t for t in out.values()) >= 140
