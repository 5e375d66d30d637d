"""The whole pipeline on a small corpus with planted cases, against a brute-force version of its stages."""

import hashlib
import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from shelfmark.llm import mixing
from shelfmark.llm.settings import MIX

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n)) + "."
    passage = prose(40)
    texts, labels = {}, {}
    for i in range(200):
        texts[i] = prose(rng.randrange(40, 120))
        labels[i] = 1
    for i in range(200, 260):
        texts[i] = "BUY NOW!! " * rng.randrange(10, 40) + str(i)
        labels[i] = 0
    for i in range(260, 300):  # near copies: one word of 80 and more differs
        base = texts[i - 260].split(" ")
        base[len(base) // 2] = "changed"
        texts[i] = " ".join(base) + " " + prose(1)
    for i in range(300, 320):  # exact copies
        texts[i] = texts[120]
    for i in range(320, 350):  # a passage that many documents share
        texts[i] = f"{prose(30)} {passage} {prose(30)}"
    for i in range(260, 350):
        labels[i] = 1
    rows = [(i, t, "en", f"src{0 if i % 3 else i % 5}", len(t)) for i, t in texts.items()]
    return rows, [(i, y, 0) for i, y in labels.items()]


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def one_of_each(rows):
    sets = {r[0]: shingles(r[1]) for r in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [r for r in rows if find(r[0]) == r[0]]


def without_passages(rows, length=100):
    seen, out = set(), []
    for r in sorted(rows):
        data = r[1].encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            window = data[i : i + length]
            if window in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(window)
        kept = bytes(b for b, g in zip(data, gone) if not g).decode()
        if kept or not data:
            out.append((*r[:1], kept, *r[2:4], len(kept)))
    return out


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    rows, labels = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows, str(folder)


def test_run_equals_the_stages_by_brute_force(spark, made):
    rows, folder = made
    clean = [r for r in rows if not 200 <= r[0] < 260]
    want = without_passages(one_of_each(clean))
    assert len(want) < 260 and sum(len(r[1]) for r in want) < sum(len(r[1]) for r in one_of_each(clean))
    mixed = mixing.mix_sources(spark.createDataFrame(want, SCHEMA), **MIX)
    times = Counter(r["doc_id"] for r in mixed.select("doc_id").collect())
    text = {r[0]: r[1] for r in want}
    expected = Counter({(i, s, hashlib.sha256(text[i].encode()).hexdigest()): n for i, n in times.items() for s in (1, 2)})
    got = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r["doc_id"], r["sample"], r["decoded_sha256"]) for r in got) == expected
    assert {r["inclusion"] <= 0 and r["n_pieces"] > 0 for r in got} == {True}


def test_run_of_an_empty_corpus(spark, tmp_path):
    for name, schema in (("documents", SCHEMA), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
