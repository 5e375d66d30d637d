"""The pipeline operators on small tables, against brute force and in the defined odd cases."""

import hashlib
import itertools
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import captures, fingerprints, main_text, mixing, near_dups, nearest, quality, segmentations, suffix_dups, token_counts
from shelfmark.llm.settings import PIECES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string"
LONG = " ".join(f"word{i}" for i in range(300))
TEXTS = [
    LONG, LONG, LONG.replace("word7 ", "other "), "x" + LONG[:500], "", None, "short text", "ab" * 400, "é日🙂 " * 60, "\n\n a\tb \n",
    " ".join(f"alpha{i}" for i in range(40)), "short text"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s0" if i % 3 else None, 0, "clash") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "en", "s0", 0, "clash"), (None, "no id", None, "s1", None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_token_counts_equal_the_library(docs, none):
    from sentencepiece import SentencePieceProcessor

    held = SentencePieceProcessor(model_file=PIECES)
    for row in token_counts.count_tokens(docs, PIECES).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        assert row["n_tokens"] == len(held.encode(row["text"] or "")) and row["n_bytes"] == len((row["text"] or "").encode())
    assert token_counts.count_tokens(none, PIECES).count() == 0


def test_mixture_rates_and_salted_join(spark, docs, none):
    many = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("abcd").alias("text"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"))
    out = mixing.mix_sources(many, weights={"a": 3, "b": 1}, target_chars=80000)
    share = out.groupBy("source").count().collect()
    assert abs({r["source"]: r["count"] for r in share}["a"] - 15000) < 500
    plain = {tuple(r) for r in mixing.mix_sources(docs).select("doc_id", "copy", "shuffle_key").collect()}
    assert plain == {tuple(r) for r in mixing.mix_sources(docs, broadcast_sources=0).select("doc_id", "copy", "shuffle_key").collect()}
    assert mixing.mix_sources(none).count() == 0


def test_quality_learns_and_odd_tables(spark, docs, none):
    good = [(i, " ".join(f"w{(i * 7 + j * j) % 97}" for j in range(60)) + ".", 1) for i in range(0, 200)]
    bad = [(i, "BUY!! NOW!! " * 30, 0) for i in range(200, 400)]
    table = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    stats = quality.document_statistics(table)
    model = quality.fit(stats, table.select("doc_id", "quality"))
    scored = quality.score_texts(table, model).where(quality.held_out(F.col("doc_id"))).collect()
    assert len(scored) > 40 and all((r["score"] >= 0.3) == (r["quality"] == 1) for r in scored)
    assert quality.score_texts(docs, model).where("score between 0 and 1").count() == docs.count()
    blank = quality.fit(quality.document_statistics(none), none.select("doc_id", F.lit(1).alias("quality")))
    assert {r["score"] for r in quality.score_texts(docs, blank).collect()} == {0.5}


def test_pooling_is_monotone():
    x, y = quality.pool_adjacent(np.arange(5.0), np.array([0, 1, 0, 1, 1.0]), np.ones(5))
    assert list(y) == sorted(y) and y[1] == 0.5


def _shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else {tuple(words)} if words else set()


def test_near_duplicates_equal_brute_force(docs, none):
    rows = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    sets = {r["doc_id"]: _shingles(r["text"]) for r in rows.collect()}
    root = {i: i for i in sets}
    for _ in sets:
        for a, b in itertools.combinations(sets, 2):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                root[a] = root[b] = min(root[a], root[b])
    for r in near_dups.link(docs).where("doc_id is not null").collect():
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), root[r["doc_id"]], r["doc_id"] == root[r["doc_id"]])
    kept = near_dups.keep_one_of_each(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 1").count() == 0 and kept.where("doc_id = 3").count() == 1
    assert near_dups.link(none).count() == 0


def test_near_duplicates_at_four_fifths(spark):
    import corpus_pipeline

    words = [f"w{i}" for i in range(104)]  # 100 shingles
    near = words[:93] + [f"x{i}" for i in range(11)]  # 89 in common of 111: 0.802
    far = [f"v{i}" for i in range(104)]
    less = far[:92] + [f"y{i}" for i in range(12)]  # 88 in common of 112: 0.786
    rows = [(i, " ".join(t), "en", "s0", 0, None) for i, t in enumerate((words, near, far, less))]
    table = spark.createDataFrame(rows, DOCS)
    assert [len(_shingles(rows[a][1]) & _shingles(rows[a + 1][1])) for a in (0, 2)] == [89, 88]
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, table, "").collect()} == {0, 2, 3}
    assert {r["doc_id"] for r in near_dups.keep_one_of_each(table).collect()} == {0, 2, 3}
    assert near_dups.link(table, percent=85).where("kept").count() == 4


def test_sketch_estimates():
    a, b = np.arange(1, 1000, dtype=np.uint64), np.arange(200, 1200, dtype=np.uint64)
    a, b = (near_dups.sketch(near_dups.mix(x), 512) for x in (a, b))
    assert abs((a == b).mean() - 800 / 1199) < 0.08
    assert len(near_dups.sketch(np.array([5], np.uint64), 96)) == 96


@pytest.mark.parametrize("percent", [80, 85, 95, 100])
def test_estimates_miss_no_more_than_bands(percent):
    j, n = percent / 100, near_dups.BANDS * near_dups.ROWS
    least = math.ceil(near_dups.least_estimate(percent) * n)
    tail = sum(math.comb(n, i) * j**i * (1 - j) ** (n - i) for i in range(least))
    assert tail <= (1 - j**near_dups.ROWS) ** near_dups.BANDS <= 1e-7


def test_cover_is_perfect():
    assert Counter((a - b) % 73 for a in suffix_dups.COVER for b in suffix_dups.COVER if a != b) == {i: 1 for i in range(1, 73)}


def test_repeats_equal_brute_force(docs, none):
    rows = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    seen, want = set(), {}
    for r in sorted(rows.collect(), key=lambda r: r["doc_id"]):
        data = (r["text"] or "").encode()
        gone = [False] * len(data)
        for i in range(len(data) - 99):
            if data[i : i + 100] in seen:
                gone[i : i + 100] = [True] * 100
            seen.add(data[i : i + 100])
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        want[r["doc_id"]] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    got = suffix_dups.remove_repeats(rows)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got.collect()} == want
    left = suffix_dups.without_repeats(docs)
    assert left.columns == docs.columns and left.where("doc_id = 1").count() == 0 and left.where("doc_id = 4").count() == 1
    assert suffix_dups.remove_repeats(none).count() == 0


def test_nearest_recall_and_unusable_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 16)).astype(float)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None), (9100, [0.0] * 16), (9200, [float("nan")] * 16), (9300, [1.0]), (9400, [None] * 16), (5, x[5].tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest.nearest(table, F.col("vec_id") % 100 == 0).collect()
    hits = 0
    for q in range(0, 3000, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        hits += len({i for i in np.argsort(d) if i != q and d[i] <= np.sort(d)[10]} & {r["vec_id"] for r in got if r["query_id"] == q})
    assert len(got) == 300 and hits >= 270 and max(r["vec_id"] for r in got) < 3000
    few = nearest.nearest(spark.createDataFrame(rows[:4], table.schema), F.col("vec_id") == 0)
    assert few.count() == 3 and nearest.nearest(table.limit(0), F.lit(True)).count() == 0


def test_nearest_with_repeated_ids(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 16)).astype(float)
    ids = spark.range(2000).orderBy(F.xxhash64("id", F.lit(3)), "id").limit(1).collect()
    hot = ids[0]["id"]  # comes first in the sample
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    for more in ([(hot, x[hot].tolist())] * 1000, rows * 9):
        table = spark.createDataFrame(rows + more, "vec_id long, embedding array<double>")
        got = nearest.nearest(table, F.col("vec_id") % 100 == 0).collect()
        hits = 0
        for q in range(0, 2000, 100):
            d = np.sqrt(((x - x[q]) ** 2).sum(1))
            found = [r["vec_id"] for r in got if r["query_id"] == q]
            assert len(found) == len(set(found)) == 10
            hits += len({i for i in np.argsort(d)[:11] if i != q} & set(found))
        assert hits >= 180


def test_main_text():
    page = (
        '<html><head><title>T</title><script>var a="<p>no</p>"</script></head><body><nav><a href=x>Menu</a></nav><div class="ad">Buy now.</div>'
        "<article><h1>Head &amp; line</h1><p>One<b> two</b>\n three.<p>Four<br>five.</p></article><div id=comments><p>First!</p></div><footer>&copy; me</footer>")
    assert main_text.main_text(page) == "Head & line\nOne two three.\nFour five."
    assert main_text.main_text(None) == main_text.main_text("") == main_text.main_text("<nav>x</nav><p") == ""
    assert main_text.main_text(page[: page.index("Four") + 2] + "<b") == "Head & line\nOne two three.\nFo"


TWO = "\n".join(" ".join([f"{x} sentence that is long enough to be read as a text of its own"] * 4) + "." for x in ("One", "Another"))
ARTICLE = "<article><p>{}</p><p>{}</p></article>".format(*TWO.split("\n"))
PLAIN = ARTICLE.replace("article>", "section>")


@pytest.mark.parametrize("page", [
    '<body><p class="notice">We use cookies here.' + PLAIN,
    '<body><p class="notice">We use <b>cookies here.<p>' + TWO.replace("\n", "<p>"),
    '<body><p class="notice">We use cookies here.<p>' + TWO.replace("\n", "<p>"),
    '<article><p class="notice">We use cookies here.<p>' + TWO.replace("\n", "<p>") + "</article>",
])
def test_main_text_after_an_unclosed_notice(page):
    assert main_text.main_text(page).removeprefix("We use cookies here.\n") == TWO


@pytest.mark.parametrize("page", [
    f'<div class="no-sidebar">{ARTICLE}</div>', f'<div class="page has-header">{ARTICLE}</div>', f'<div class="no-sidebar">{PLAIN}</div>',
    ARTICLE.replace("<article>", '<article class="post ad-free">'), f'<div class="page widget">{ARTICLE}</div>', f"<form id=all>{ARTICLE}</form>",
    f'<div class="with-sidebar"><div class="sidebar-box"><p>Read these other pages as well.</p></div>{ARTICLE}<ul class="comment-list"><li><article class=comment>I was first to write.</article></ul></div>',
])
def test_main_text_inside_wrappers(page):
    assert main_text.main_text(f"<body>{page}</body>") == TWO


@pytest.mark.parametrize("part", [
    '<svg class="i"/>', "<math/>", "<div><button>Menu</div>", "<div><select><option>One<option>Two</div>", "<div><iframe src=x>No frames.</div>",
    "<button>Menu", "<select><option>One", "<iframe src=x>", "<svg><title>Logo</title><path d='m0'/>", "<button>Menu</button><svg><text>Logo</text></svg><div><svg/></div>",
])
def test_main_text_after_elements_without_text(part):
    assert main_text.main_text(f"<html><head><title>T</title><body>{part}{ARTICLE}</body></html>") == TWO
    assert main_text.main_text(f"<body><article><header>{part}</header>{ARTICLE[9:]}") == TWO


def test_archives_round_trip(spark):
    rows = [(1, "http://a.org/x?y=1", "same é"), (2, "http://b.a.org/", "same é"), (3, None, None), (4, "::bad", ""), (5, "http://a.org/x?y=1", "line\r\n\r\nWARC/1.1\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in captures.archive(pages).collect()}
    assert got[1]["record_type"] == "revisit" and got[1]["refers_to"] == 2 and got[1]["payload_bytes"] == 7
    assert got[3]["refers_to"] == 4 and got[3]["payload_bytes"] == 0
    assert bytes(got[5]["payload"]).decode() == rows[4][2] and got[5]["payload_digest"] == captures.payload_digest(rows[4][2].encode())
    assert captures.url_key("http://www.B.example.org:8080/p?q") == "org,example,b:8080)/p?q"


def test_archive_files_are_bounded_by_bytes(spark, monkeypatch, tmp_path):
    """Pages of 1 MB fill a file by bytes, not by records; small ones share files; none is lost."""
    import gzip

    monkeypatch.setattr(captures, "FILE_BYTES", 8 << 20)
    monkeypatch.setattr(captures, "FILE_RECORDS", (64, 8, 1))
    sizes = [1_000_000] * 20 + [9_000_000] + [200] * 300 + [0]
    pages = spark.createDataFrame([(i, f"http://x.org/{i}") for i in range(len(sizes))], "page_id long, url string").withColumn(
        "html", F.concat(F.lpad(F.col("page_id").cast("string"), 6, "0"), F.repeat(F.lit("é"), F.when(F.col("page_id") < 20, 499_997).when(F.col("page_id") == 20, 4_499_997).when(
            F.col("page_id") < 321, 97).otherwise(0)))).coalesce(2)
    path = str(tmp_path / "archives")
    got = {r["page_id"]: r for r in captures.archive(pages, path).collect()}
    assert {i: len(r["payload"]) for i, r in got.items()} == {i: max(n, 6) for i, n in enumerate(sizes)}
    found = [gzip.decompress(f.read_bytes()) for f in (tmp_path / "archives").glob("part-*")]
    assert max(x.count(b"WARC/1.1\r\n") for x in found if len(x) > 8 << 20) in (1, 8) and sum(len(x) > 9_500_000 for x in found) == 0
    assert max(x.count(b"WARC/1.1\r\n") for x in found) == 64


def test_archives_of_no_pages(spark):
    assert captures.archive(spark.createDataFrame([], "page_id long, url string, html string, key string")).collect() == []


def test_archives_find_captures_of_odd_urls(spark):
    urls = [
        " http://x.org/a", "http://x.org/a\n", "http://x.o\trg/a", "\xa0http://x.org/", " ", "http://München.de/a b", "http://MÜNCHEN.de/ä#ü",
        "http://[bad/Ä", "http://Ü.org:bad/", "http://x／y.org/", "http://x.org/%zz?ß=%C3%9F", "http://x.org/\x00\x1f", None, ""]
    assert captures.url_key(urls[0]) == captures.url_key(urls[1]) == captures.url_key(urls[2]) == "org,x)/a"
    assert captures.url_key(urls[5]).startswith("de,m%C3%BCnchen)") and captures.url_key(urls[6]).startswith("de,m%C3%BCnchen)")
    for url in urls:
        assert captures.url_key(url) == captures.url_key(captures.target_uri(url))
    pages = spark.createDataFrame([(i, u, f"page {i}") for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = captures.archive(pages).collect()
    assert sorted((r["page_id"], bytes(r["payload"]).decode()) for r in got) == [(i, f"page {i}") for i in range(len(urls))]


def test_fingerprints_equal_brute_force(docs):
    rows = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    order = sorted(((r["doc_id"], r["text"] or "") for r in rows.collect()), reverse=True)
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(rows).collect()}
    lines = lambda t: {x for x in t.split("\n") if x}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i]["near_edited"] == pytest.approx(like(lines(t), lines(edited))) and got[i]["near_next"] == pytest.approx(like(lines(t), lines(after)))
    assert got[0]["fingerprint"] == got[1]["fingerprint"] != got[2]["fingerprint"]


def test_fingerprints_of_texts_with_very_many_lines(spark):
    """Every third line differs; a text of 60,000 lines takes little more than its share."""
    import time

    took = {}
    for n in (6_000, 60_000):
        own = "\n".join(f"line {i} of the text" for i in range(n))
        other = "\n".join(f"line {i} of the text" if i % 3 else f"other {i}" for i in range(n))
        pair = spark.createDataFrame([(1, own), (2, other)], "doc_id long, text string")
        start = time.time()
        got = {r["doc_id"]: r["near_next"] for r in fingerprints.fingerprints(pair).collect()}
        took[n] = time.time() - start
        kept = n - -(-n // 3)
        assert got[1] == got[2] == pytest.approx(kept / (2 * n - kept))
    assert took[60_000] < 60 + 12 * took[6_000]


def test_segmentations_are_a_sample_without_replacement(docs, none):
    vocabulary = segmentations.vocabulary_for(PIECES, 0.3)
    n, text = 4000, "abc d"
    search = segmentations.Search(segmentations.Lattices(vocabulary), [text] * n, np.arange(n))
    found = search.paths(2)
    p, first, second = {}, Counter(), Counter()
    for paths in found:
        a, b = (tuple(search.pieces(x[2])) for x in paths[:2])
        assert a != b and paths[0][0] > paths[1][0] > paths[2][0]
        p |= {a: math.exp(paths[0][1] - search.whole[0]), b: math.exp(paths[1][1] - search.whole[0])}
        first[a] += 1
        second[b] += 1
    for s in p:
        expected = sum(p[x] * p[s] / (1 - p[x]) for x in p if x != s)
        assert abs(first[s] / n - p[s]) < 0.03 and abs(second[s] / n - expected) < 0.03
    for r in segmentations.sample_segmentations(docs, PIECES).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        assert r["decoded"] == (r["text"] or "") and r["inclusion"] <= 0
    assert segmentations.sample_segmentations(none, PIECES).count() == 0


def test_segmentations_of_ids_that_are_no_numbers(spark):
    rows = [("a", "one text"), ("b", "one text"), ("a", "one text"), (None, "one text"), ("c", None)]
    got = segmentations.sample_segmentations(spark.createDataFrame(rows, "doc_id string, text string"), PIECES).collect()
    assert {r["doc_id"] for r in got} == {"a", "b", "c", None} and all(r["decoded"] in ("one text", "") for r in got)
    of = lambda i: sorted((r["sample"], tuple(r["ids"])) for r in got if r["doc_id"] == i)
    assert len(of("a")) == 4 and len(set(of("a"))) == 2


def test_stages_keep_clashing_columns_and_microseconds(spark):
    rows = [(i, f"document {i} " + " ".join(f"w{i * 31 + j}" for j in range(40)), i, "x") for i in range(12)]
    docs = spark.createDataFrame(rows + [(50, *rows[3][1:])], "doc_id long, text string, kept_id long, carried string")
    docs = docs.withColumns({
        "at": F.timestamp_micros(F.lit(1_700_000_000_123_456) + F.col("doc_id")), "plain": F.lit("2024-01-02 03:04:05.678901").cast("timestamp_ntz"),
        "kept": F.lit(True), "n_bytes": F.lit(0.1), "blob": F.lit(b"\x00\xff")})
    kept = near_dups.keep_one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == list(range(12))
    cut = suffix_dups.without_repeats(docs)
    assert cut.columns == docs.columns
    want = {r["doc_id"]: r for r in docs.collect()}
    got = cut.collect()
    assert {r["doc_id"] for r in got} == set(range(12)) and all(
        r[c] == want[r["doc_id"]][c] for r in got for c in docs.columns if c != "text")


def test_pipeline_stages_keep_the_columns(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns


def test_quality_scores_equal_a_plain_refit(spark):
    """The normal equations and the isotonic steps once more, in plain numpy over all labelled rows."""
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    stats = quality.document_statistics(docs)
    model = quality.fit(stats, labels)
    held = {r["doc_id"]: np.array(r["stats"]) for r in stats.collect()}
    known = [(r["doc_id"], float(r["quality"])) for r in labels.where("quality is not null").where(~quality.held_out(F.col("doc_id"))).collect()]
    x, y = np.array([held[i] for i, _ in known]), np.array([v for _, v in known])
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1

    def features(rows):
        z = np.clip((rows - mean) / scale, -8, 8)
        return np.hstack([np.cos(z @ model.directions + model.phases) * np.sqrt(2 / len(model.phases)), z, np.ones((len(z), 1))])

    a = features(x)
    penalty = np.full(a.shape[1], 1e-3 * len(y) / quality.FEATURES)
    penalty[-1] = 1e-9
    weights = np.linalg.solve(a.T @ a + np.diag(penalty), a.T @ y)
    raw = a @ weights
    cells = {}
    for cell, r, v in zip(np.clip((raw + 1) / 3 * quality.BINS, 0, quality.BINS - 1).astype(int), raw, y):
        cells.setdefault(cell, []).append((r, v))
    blocks = [[(float(np.mean([r for r, _ in c])), float(np.mean([v for _, v in c])), len(c))] for _, c in sorted(cells.items())]
    level = lambda b: sum(v * n for _, v, n in b) / sum(n for _, _, n in b)
    i = 0
    while i + 1 < len(blocks):  # merge neighbours that fall, and look back
        if level(blocks[i]) >= level(blocks[i + 1]):
            blocks[i : i + 2] = [blocks[i] + blocks[i + 1]]
            i = max(i - 1, 0)
        else:
            i += 1
    knots = [sum(r * n for r, _, n in b) / sum(n for _, _, n in b) for b in blocks]
    ids = sorted(held)
    want = np.clip(np.interp(features(np.array([held[i] for i in ids])) @ weights, knots, [level(b) for b in blocks]), 0, 1)
    got = {r["doc_id"]: r["score"] for r in quality.score_statistics(stats, model).collect()}
    np.testing.assert_allclose([got[i] for i in ids], want, atol=1e-5)
