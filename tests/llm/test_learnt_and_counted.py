"""Toxicity, collocations and vector codes against brute force, and in the defined odd cases."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import collocations, toxicity, vector_codes
from shelfmark.llm.toxicity import plain_word

# ---- collocations ----


def brute_collocations(rows, least, most):
    """``rows``: (lang, text). Every n-gram counted, as the contract states."""
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", low):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            totals[lang] += len(words)
            for n in range(1, 5):
                for i in range(len(words) - n + 1):
                    counts[lang][tuple(words[i : i + n])] += 1
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        covered = Counter()
        for p, a in candidates.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    covered[p[i : i + n]] = max(covered[p[i : i + n]], a)
        scored = []
        for p, a in candidates.items():
            if 100 * covered[p] >= 80 * a:
                continue
            score, _, l, r = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), " ".join(p), l, r))
        for rank, (s, a, _, phrase, l, r) in enumerate(sorted(scored)[:most], 1):
            out.append((lang, rank, phrase, -a, l, r, totals[lang], -s))
    return sorted(out)


def phrase_rows(seed, n):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "g", "Über", "d-e", "x y", "🙂", "Z"]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(words) + rng.choice(["", "", "", ",", ".", "\n", "\t"]) for _ in range(rng.randrange(40)))
        if i % 3 == 0:
            text += " the quick brown fox jumps! The Quick Brown fox"
        rows.append((i, rng.choice(["en", "de", None]), text))
    return rows + [(n, "en", None), (n + 1, "en", ""), (n + 2, None, " \t\n.,"), (n, "en", "a a a a a a a"), (n, "en", "a a a a a a a")]


@pytest.mark.parametrize("least,most,sampled", [(2, 2000, 8), (5, 7, 8), (30, 50, 4), (3, 2000, 1000)])
def test_collocations_equal_brute_force(spark, least, most, sampled):
    """With few sampled documents nearly every frequent phrase is a failure of the border."""
    rows = phrase_rows(least, 120)
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(5)
    docs = docs.withColumns({"rank": F.lit(9), "phrase": F.lit("clash"), "n": F.lit(0), "drawn": F.lit(True), "f": F.lit(1)})
    got = collocations.collocations(docs, least=least, most=most, sampled=sampled)
    assert sorted(map(tuple, got.collect())) == brute_collocations([r[1:] for r in rows], least, most)


def test_collocations_of_long_texts_hot_copies_and_nothing(spark, monkeypatch):
    long = "one two three four " * 60_000
    rows = [(1, "en", long), (2, "en", "x" * 2_000_000 + " one two"), *[(i, "fr", "copy of one text") for i in range(3, 400)]]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3)
    got = sorted(map(tuple, collocations.collocations(docs, least=30).collect()))
    assert got == brute_collocations([r[1:] for r in rows], 30, 2000)
    assert {r[2] for r in got if r[0] == "fr"} == {"copy of one text"}
    assert collocations.collocations(docs.limit(0)).collect() == []


def test_counts_do_not_depend_on_how_much_a_task_holds():
    everything = collocations.Filters({k: np.full(collocations.FILTER_BITS // 64, 2**64 - 1, np.uint64) for k in (1, 2, 3, 4)})

    def counts(most):
        out, words = Counter(), collocations.Words()

        def add():
            for lang, size, _, times, numbers in collocations._counted(words, 4, everything, everything):
                for i, n in enumerate(times):
                    out[(lang, size, b" ".join(words.texts[w[i]] for w in numbers))] += int(n)

        for _, lang, text in phrase_rows(1, 60):
            words.add(lang or "und", (text or "").encode())
            if words.held > most:
                add()
                words = collocations.Words()
        add()
        return out

    assert counts(1 << 22) == counts(50)


# ---- vector codes ----


def brute_codes(rows, parts=8, entries=16, rounds=6):
    """``rows``: (id, vector, label), kept ones only, in the order of seeds."""
    x = np.array([[math.floor(4096 * float(v)) for v in r[1]] for r in rows], dtype=np.int64)
    cut = x.shape[1] // parts
    books = [x[:entries, p * cut : (p + 1) * cut].copy() for p in range(parts)]

    def nearest(p):
        d = ((x[:, None, p * cut : (p + 1) * cut] - books[p][None]) ** 2).sum(axis=2)
        return d.argmin(axis=1), d.min(axis=1)

    for _ in range(rounds):
        for p in range(parts):
            at, _ = nearest(p)
            for e in range(len(books[p])):
                mine = x[at == e, p * cut : (p + 1) * cut]
                if len(mine):
                    books[p][e] = [int(s) // len(mine) for s in mine.sum(axis=0)]
    found = [nearest(p) for p in range(parts)]
    error = sum(d for _, d in found)
    by_label = Counter()
    for r, e in zip(rows, error):
        by_label[r[2]] += int(e)
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return sorted(
        (r[0], "".join(f"{at[i]:02x}" for at, _ in found), int(error[i]), by_label[r[2]], digest) for i, r in enumerate(rows))


VECTORS = "vec_id long, embedding array<float>, label int, code string, id int, x string"


def vector_rows(kind, n, width=16):
    rng = np.random.default_rng(n)
    if kind == "ties":  # few different points at equal distances
        x = rng.integers(-1, 2, (n, width)) / 2
    elif kind == "copies":  # a third of all rows are one vector
        x = rng.normal(size=(n, width))
        x[::3] = x[0]
    else:
        x = rng.normal(size=(n, width)) * rng.choice([0.01, 1, 30], (n, 1))
    return [(i, [float(np.float32(v)) for v in row], int(i % 4) if i % 5 else None, "clash", 1, "clash") for i, row in enumerate(x)]


@pytest.mark.parametrize("kind,n", [("plain", 700), ("ties", 400), ("copies", 600), ("plain", 5)])
def test_vector_codes_equal_brute_force(spark, kind, n):
    rows = vector_rows(kind, n)
    odd = [
        (n, None, 1, "", 0, ""), (n + 1, [math.nan] + [0.0] * 15, 1, "", 0, ""), (n + 2, [None] + [0.0] * 15, 1, "", 0, ""),
        (n + 3, [math.inf] + [0.0] * 15, 1, "", 0, ""), (n + 4, [0.0] * 8, 1, "", 0, "")]
    df = spark.createDataFrame(rows + odd, VECTORS).repartition(4)
    got = vector_codes.compress(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
    assert sorted(map(tuple, got.collect())) == brute_codes([r[:3] for r in rows])


def test_vector_codes_of_repeated_ids_and_nothing(spark):
    rows = vector_rows("plain", 60)
    table = rows + rows[:7] + [(3, rows[9][1], 2, "", 0, ""), (None, rows[4][1], None, "", 0, "")]
    df = spark.createDataFrame(table, VECTORS).repartition(3)
    order = sorted(table, key=lambda r: (r[0] is None, r[0] or 0, r[1]))  # null ids last
    got = vector_codes.compress(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    got = sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got)
    assert got == brute_codes([(-1 if r[0] is None else r[0], *r[1:3]) for r in order])
    none = vector_codes.compress(df.limit(0))
    assert none.collect() == [] and "codebooks_sha256" in none.columns
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.compress(spark.createDataFrame([(1, [1.0] * 9, 0)], "vec_id long, embedding array<float>, label int"))


def test_trees_decide_whole_subtrees():
    """Far apart clusters are settled by a handful of nodes, and sums equal a plain count."""
    rng = np.random.default_rng(0)
    points = np.vstack([rng.integers(-20, 20, (500, 4)) + c for c in ([0] * 4, [4000] * 4, [-9000] * 4)]).astype(np.int32)
    tree = vector_codes.CoverTree(points)
    book = np.array([[0] * 4, [4000] * 4, [-9000] * 4])
    ranges = [(s, e) for start, end, _ in tree.ranges(book) for s, e in zip(start, end)]
    assert len(ranges) < 60 and sum(e - s for s, e in ranges) == len(tree.points)
    sums = tree.sums(book)
    for e in range(3):
        mine = points[e * 500 : (e + 1) * 500]
        assert sums[e].tolist() == [*mine.sum(axis=0).tolist(), 500]


# ---- toxicity ----

DOCS = "doc_id long, text string, features string, score double, y string"


def toxic_rows(n=900, seed=4):
    """Clean and toxic texts; toxic ones hold words known only from the labels."""
    rng = random.Random(seed)
    syllables = ["ka", "lo", "mi", "ren", "tas", "vu", "der", "sol", "pim", "gro"]
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(3, 80))]
        bad = i % 4 == 0
        if bad:
            for _ in range(rng.randrange(2, 6)):
                words.insert(rng.randrange(len(words) + 1), rng.choice(["zorgul", "brakkt"]) + rng.choice(["", "en", "ig", "ung"]))
        text = " ".join(words) + rng.choice([".", "!", "?"])
        rows.append((i, text, "clash", 0.5, "clash"))
        labels.append((i, int(bad) if i % 2 == 0 or i % 3 == 0 else None, 1))
    return rows, labels


@pytest.fixture(scope="module")
def toxic(spark):
    rows, labels = toxic_rows()
    odd = [(None, "no id zorgul", "", 0.0, ""), (5000, None, "", 0.0, ""), (5001, "", "", 0.0, ""), (5002, " \n ", "", 0.0, ""),
           (5003, "zorgulen brakktig zorgul " + "kalo miren " * 300_000, "", 0.0, ""), (1, rows[1][1], "", 0.0, "")]
    return spark.createDataFrame(rows + odd, DOCS).repartition(5), spark.createDataFrame(labels + [(1, 0, 1), (None, 1, 1), (9999, 1, 1)], "doc_id long, toxic int, quality int")


def test_toxicity_is_learnt_from_labels(spark, toxic):
    docs, labels = toxic
    scored = toxicity.score_toxicity(docs, labels).collect()
    assert len(scored) == 906 and all(0 <= r["score"] <= 1 for r in scored)
    by_id = defaultdict(list)
    for r in scored:
        by_id[r["doc_id"]].append(r)
    held = [r for r in scored if r["held_out"] and r["doc_id"] < 900]
    assert len(held) > 150 and all((r["score"] >= 0.5) == (r["doc_id"] % 4 == 0) for r in held)
    assert by_id[5000][0]["score"] == by_id[5001][0]["score"] == by_id[5002][0]["score"] < 0.5
    assert len(by_id[1]) == 2 and by_id[1][0]["score"] == by_id[1][1]["score"]


def test_lexicon_equals_brute_force(spark):
    rows, labels = toxic_rows(300, 8)
    y = {i: v for i, v, _ in labels if v is not None}
    texts = [(r[1], float(y[r[0]])) for r in rows if r[0] in y]
    got = toxicity.learn_lexicon(spark.createDataFrame(texts, "text string, y double").repartition(4))
    counts = {1: Counter(), 0: Counter()}
    for text, v in texts:
        counts[int(v)].update({s for w in set(text.split()) for s in toxicity.stems_of(plain_word(w)[0])})
    nt = sum(v for _, v in texts)
    nc = len(texts) - nt

    def ratio(a, b):
        cells = [(a, (a + b) * nt), (b, (a + b) * nc), (nt - a, (nt + nc - a - b) * nt), (nc - b, (nt + nc - a - b) * nc)]
        return 2 * sum(o * math.log(o * (nt + nc) / e) for o, e in cells if o)

    strong = sorted(
        (-round(ratio(a, counts[0][s]), 6), -len(s), s) for s, a in counts[1].items()
        if a >= 4 and a / nt >= 10 * (counts[0][s] + 0.5) / (nc + 1) and ratio(a, counts[0][s]) >= 24)
    want = []
    for _, _, s in strong:
        if not any(x in want for x in toxicity.stems_of(s)):
            want.append(s)
    assert got == want and "zorgul" in got


def test_toxicity_without_labels_or_with_one_class(spark, toxic):
    docs, labels = toxic
    few = docs.limit(20)
    assert {r["score"] for r in toxicity.score_toxicity(few, labels.limit(0)).collect()} == {0.5}
    assert {r["score"] for r in toxicity.score_toxicity(few, labels.where("toxic = 0")).collect()} <= {0.0, 0.5}
    assert toxicity.score_toxicity(docs.limit(0), labels).collect() == []


@pytest.mark.parametrize("word,plain,disguised", [
    ("Idiot,", "idiot", False), ("1d1ot", "idiot", True), ("s.t.u.p.i.d", "stupid", False), ("m*o*r*o*n!", "moron", True),
    ("$tupid", "stupid", True), ("well-known", "wellknown", False), ("covid19", "covidi", False), ("2024", "oa", False), ("...", "", False)])
def test_plain_words(word, plain, disguised):
    got, seen = plain_word(word)
    assert (got, seen) == (plain, disguised)
