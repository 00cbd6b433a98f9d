"""What the operators promise beyond the planted cases: other languages stay, counts are exact, hot groups lose nothing."""

import importlib.util
import random

import numpy as np
import pytest

from lanternspan.llm import encodings, leaks, neardup, packing, pii, sharedspans
from lanternspan.llm.tagger import Gate

OTHERS = [
    "Příliš žluťoučký kůň úpěl ďábelské ódy. Zkušenosti s vývojem softwaru a řízením týmů.",
    "Développeur expérimenté, maîtrise du français et de l’anglais, où l’équipe a réalisé des œuvres d’été à Noël.",
    "Şirketimiz için yazılım geliştirici arıyoruz; iyi derecede İngilizce bilgisi şart.",
    "Αναζητούμε έμπειρο προγραμματιστή για την ομάδα μας στην Αθήνα.",
    "Vi søger en erfaren udvikler, der kan arbejde selvstændigt på vores kontor i Århus, også på større opgaver.",
    "Procuramos programador com experiência, comunicação e organização, disponível para reuniões às terças.",
    "Ищем опытного разработчика, который объяснит сложные вещи простыми словами.",
    "我们正在寻找有经验的软件工程师", "経験豊富なエンジニアを募集しています。", "password ????",
]


@pytest.mark.parametrize("line", OTHERS)
def test_other_languages_stay(line):
    assert encodings.restore(line) == (line, [], False)


def test_classifier_learns_from_clean_records_and_harms_none(spark):
    good = "Шукаємо досвідченого розробника для нашої команди у Львові."
    rows = [(i, x) for i, x in enumerate([*OTHERS, good, encodings.garble(good, "koi8-u>cp1251"), encodings.garble(good, "iso8859-5>cp1251"), encodings.garble(OTHERS[1], "utf-8>cp1252"), None, ""])]
    got = {r.doc_id: r.restored for r in encodings.repair(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    n = len(OTHERS)
    assert got == {n + 1: good, n + 2: good, n + 3: OTHERS[1]}


def test_long_texts_are_counted_as_the_tokenizer_does():
    spec = importlib.util.spec_from_file_location("_files", "/opt/tokenizers/__init__.py")
    spec.loader.exec_module(files := importlib.util.module_from_spec(spec))
    bpe = packing._tokenizer(files.PATTERN, open("/opt/tokenizers/byte_bpe_multi_50k.tiktoken", "rb").read())
    rng = random.Random(3)
    for _ in range(200):
        t = "".join(rng.choice(["word", "w", " ", "  ", "\n", "\t", "12", "é", "漢", "'s", ".", "?!", "\xa0", " a"]) for _ in range(rng.randrange(400)))
        assert packing.bpe_length(bpe, t, part=rng.randrange(1, 60)) == len(bpe.encode_ordinary(t))


def test_little_room_is_wasted_and_costs_are_balanced():
    rng = np.random.default_rng(4)
    sizes = np.concatenate([rng.integers(1, 1025, 2000), rng.integers(1, 200, 3000), np.full(500, 1024)])
    c = packing.pack(sizes, 1024)
    assert np.bincount(c, sizes).max() <= 1024 and c.max() + 1 <= 1.005 * -(-sizes.sum() // 1024)
    tight = packing.pack(sizes, 1024, bands=(0.0,))
    assert packing.cost_spread(sizes, packing.pack(sizes, 1024, bands=(1.0,))) <= packing.cost_spread(sizes, tight) * 1.2


@pytest.mark.parametrize("limit", [0, leaks.MAX_INDEX])
@pytest.mark.parametrize("run,k,share", [(8, 3, 0.0), (6, 2, 0.5)])
def test_partial_containment_against_brute_force(spark, limit, run, k, share):
    rng = random.Random(5)
    text = lambda n: [rng.choice("one two three four five six seven eight nine ten".split()) + str(rng.randrange(9)) for _ in range(n)]
    items = [text(rng.choice([4, 7, 9, 15, 30, 70])) for _ in range(25)]
    docs = []
    for _ in range(50):
        t = text(60)
        for _ in range(rng.randrange(3)):
            i = rng.choice(items)
            a = rng.randrange(len(i))
            at = rng.randrange(len(t))
            t[at:at] = i[a : a + rng.randrange(1, 40)]
        docs.append(t)

    def longest(x, y):
        best, row = 0, [0] * (len(y) + 1)
        for a in x:
            row = [0] + [row[j] + 1 if a == b else 0 for j, b in enumerate(y)]
            best = max(best, *row)
        return best

    want = {(i, d, n) for i, x in enumerate(items) for d, y in enumerate(docs) if len(x) >= run and (n := longest(x, y)) >= leaks.needed(len(x), run, share)}
    frame = lambda rows, key: spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(rows)], f"{key} bigint, text string")
    got = leaks.containment_search(frame(items, "item_id"), frame(docs, "doc_id"), run=run, k=k, share=share, max_index=limit).collect()
    assert {(r.item_id, r.doc_id, r.longest_run) for r in got} == want and len(got) == len(want)


def test_split_blocks_find_the_same_pairs(spark):
    rng = random.Random(6)
    common = [f"same{i}" for i in range(60)]
    rows = []
    for i in range(40):
        own = common + [f"own{i}x{j}" for j in range(rng.randrange(3, 30))]
        rows.append((i, " ".join(own)))
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    pairs = lambda hot: {tuple(r) for r in neardup.NearDuplicates(d, k=3, threshold=0.7, hot=hot).pairs().collect()}
    assert pairs(3) == pairs(10**9) != set()


def test_packed_fingerprints_keep_their_distance():
    x = np.random.default_rng(1).integers(0, 1 << neardup.BITS, (50, 200)).astype(np.uint16)
    y = np.where(np.random.default_rng(2).random(x.shape) < 0.3, x ^ 1, x).astype(np.uint16)
    assert (neardup.hamming(neardup.packed(x), neardup.packed(y)) == (x != y).sum(1)).all()


def test_stretches_alike_in_one_hash_only_are_kept_apart():
    h, c = np.array([5, 5, 5, 7], np.uint64), np.array([1, 2, 1, 1], np.uint64)
    doc, none = np.array([1, 2, 3, 3]), np.zeros(4, np.uint8)
    assert sharedspans.settle(h, c, doc, none, False)[0].tolist() == [1, 0, 1, 0]


def test_gate_lets_new_names_and_numbers_through():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abdeiklmnorstu") for _ in range(rng.randrange(4, 9)))
    lines, inside = [], []
    for _ in range(1500):
        plain = [word() for _ in range(8)]
        if rng.random() < 0.4:
            at = rng.randrange(8)
            plain[at : at + 1] = [word().title(), word().title()]
            lines.append(plain)
            inside.append([0 if at <= i < at + 2 else -1 for i in range(9)])
        else:
            lines.append(plain)
            inside.append([-1] * 8)
    gate = Gate(lost=0.0, margin=1.0).fit(lines[:1000], inside[:1000])
    held = [(ws, sp) for ws, sp in zip(lines[1000:], inside[1000:])]
    assert all(any(sp[i] == 0 for i in gate.hits(ws)) for ws, sp in held if 0 in sp)
    assert sum(bool(gate.hits(ws)) for ws, sp in held if 0 not in sp) < 0.2 * len(held)


def test_numbers_written_otherwise_keep_their_signs():
    rng = np.random.default_rng(7)
    for t in ("+44 7700 900123", "123-45-6789", "AB 12 34 56 C"):
        for _ in range(20):
            new = pii.reformatted(t, rng)
            assert [c for c in new if c.isalnum()] == [c for c in t if c.isalnum()]
