"""Near-duplicate groups: fast similarity sketches, banding, exact verification.

A text's set holds its distinct shingles of five words (A-Z lower-cased, words split at ASCII
white space; fewer words form one shingle; no words, no set). A sketch of ``BANDS * ROWS``
coordinates is filled in rounds: in each of the first t rounds every element falls into a hashed
bin with a value that grows with the round, in the next t rounds round i fills bin i, so every
coordinate is filled whatever the size of the set, and most texts need one or two rounds. The
coordinates estimate the Jaccard similarity with concentration as strong as t samples give.

Texts with equal sets are one class from the start. Classes that share a band are candidates;
links are decided on the full sets. First the shingles are counted that a class shares with no
other candidate: they bound each of its intersections, so a class with many of them has no links
at all. Every other class is compared with the class of a shared band that has the smallest
portion of such shingles, the likely original (a star instead of all pairs); the links are joined
to components, and then every pair that shares a band across two components is compared as well,
unless it can't be linked by that bound, or so few coordinates of the sketches are equal that a
pair at the threshold has fewer no more often than it shares no band. No group is capped. A pair at
the threshold shares no band with a probability of 4.7e-8 at 80 percent and 5.5e-11 at 85; the
estimate drops it with 2.7e-8 and 3.0e-11.

Defined cases: null and empty texts have no set, are linked with nothing and are their own
component; repeated rows are documents each; a null id never names a component if the component
has another; an empty table gives an empty result; other columns are ignored by ``link`` and kept
by ``keep_one_of_each``.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import U64, Rolling, chunks, flat_texts, mix, random_words, tidy
from shelfmark.llm.components import components
from shelfmark.session import materialise, stored

WORDS = 5
BANDS, ROWS = 32, 4

#: Least estimate, as a share of equal coordinates, at which a pair across components is compared:
#: fewer are equal at the threshold no more often than no band is (binomial tail).
def least_estimate(percent: int) -> float:
    j, n = percent / 100, BANDS * ROWS
    missed, least, below = (1 - j**ROWS) ** BANDS, 0, 0.0
    while least < n and (below := below + comb(n, least) * j**least * (1 - j) ** (n - least)) <= missed:
        least += 1
    return least / n


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PLACES = random_words(5, WORDS) | U64(1)


def shingle_sets(flat: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingle fingerprints of each text."""
    for first, last in chunks(offsets):
        at = offsets[first : last + 1] - offsets[first]
        data = _LOWER[flat[offsets[first] : offsets[last]]]
        word = ~_SPACE[data]
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        inner = at[:-1][at[:-1] < len(data)]
        begins[inner] = word[inner]
        ends = np.zeros(len(data) + 1, bool)
        ends[1:] = word
        ends[:-1] &= ~word | begins
        start, end = np.flatnonzero(begins), np.flatnonzero(ends)
        hashes = mix(Rolling(data).of(start, end))
        n = len(hashes) - WORDS + 1
        rolled = mix(sum((hashes[k : n + k] * _PLACES[k] for k in range(WORDS)), np.zeros(n, U64))) if n > 0 else None
        bounds = np.searchsorted(start, at)
        for a, b in zip(bounds[:-1], bounds[1:]):
            if b - a >= WORDS:
                yield np.unique(rolled[a : b - WORDS + 1])
            elif b > a:
                yield mix((hashes[a:b] * _PLACES[: b - a]).sum(keepdims=True) + U64(b - a))
            else:
                yield np.zeros(0, U64)


def class_key(shingles: np.ndarray) -> bytes:
    """128 bits that name a set."""
    parts = (shingles.sum(dtype=U64), mix(shingles ^ U64(0xA5A5A5A5)).sum(dtype=U64))
    return b"".join(int(mix(np.array([x + U64(len(shingles))]))[0]).to_bytes(8, "big") for x in parts)


def sketch(shingles: np.ndarray, t: int) -> np.ndarray:
    """The fast similarity sketch of a set that isn't empty: ``t`` values, all filled."""
    empty = ~U64(0)
    out = np.full(t, empty, U64)
    for i in range(2 * t):
        h = mix(shingles ^ _SEEDS[i])
        value = (U64(i) << U64(48)) | (h >> U64(16))
        if i < t:
            np.minimum.at(out, ((h & U64(0xFFFF)) * U64(t) >> U64(16)).astype(np.int64), value)
        else:
            out[i - t] = min(out[i - t], value.min())
        if out.max() != empty:
            break
    return mix(out)


_SEEDS = random_words(23, 2 * BANDS * ROWS)
_ROW_SEEDS = random_words(31, BANDS * ROWS) | U64(1)


def band_values(coordinates: np.ndarray) -> np.ndarray:
    """One 64-bit value for each band, distinct between bands."""
    return mix((coordinates * _ROW_SEEDS).reshape(BANDS, ROWS).sum(axis=1, dtype=U64))


def sketches(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, key, bands, coordinates`` for each row; the last three are null
    without words. ``coordinates`` holds 15 bits of each, for estimates."""
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, bands, values = [], [], [], []
            for s in shingle_sets(*flat_texts(batch.column(1))):
                sizes.append(len(s))
                c = sketch(s, BANDS * ROWS) if len(s) else None
                keys.append(None if c is None else class_key(s))
                bands.append(None if c is None else band_values(c).view(np.int64))
                values.append(None if c is None else (c & U64(0x7FFF)).astype(np.int16))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(values, pa.list_(pa.int16()))],
                names=["doc_id", "n_shingles", "key", "bands", "coordinates"])

    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_shingles long, key binary, bands array<long>, coordinates array<short>"
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def _with_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [class_key(s) if len(s) else None for s in shingle_sets(*flat_texts(batch.column(1)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), batch.column(1)], names=["doc_id", "key", "text"])

    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, key binary, text string"
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def linked(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (``a, b``) whose full sets reach the threshold."""
    left = texts.select(F.col("key").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("key").alias("b"), F.col("text").alias("text_b"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (shingle_sets(*flat_texts(batch.column(i))) for i in (2, 3))
            found = []
            for x, y in zip(one, two):
                both = len(np.intersect1d(x, y, assume_unique=True))
                found.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(found, pa.bool_()))

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(run, "a binary, b binary")


def link(docs: DataFrame, *, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, n_links`` for each row. ``percent`` is the least
    100 * intersection / union; ``n_links`` counts the links that were needed to join its class."""
    rows = stored(sketches(docs, id_col=id_col, text_col=text_col))
    classes = stored(
        rows.where(F.col("key").isNotNull()).groupBy("key").agg(
            F.min("doc_id").alias("first_id"), F.max("n_shingles").alias("size"),
            F.first("bands").alias("bands"), F.first("coordinates").alias("coordinates")))
    spread = classes.select("key", F.explode("bands").alias("band"))
    shared = spread.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    members = stored(spread.join(shared, "band").select("band", "key"))
    nodes = materialise(members.select("key").distinct())
    needed = classes.select("key", "first_id").join(nodes, "key", "left_semi")
    texts = _with_keys(docs, id_col, text_col)
    texts = texts.join(
        needed.select(F.col("key").alias("need"), "first_id"),
        (F.col("key") == F.col("need")) & F.col("doc_id").eqNullSafe(F.col("first_id")), "left_semi")
    texts = stored(texts.select("key", "text").dropDuplicates(["key"]))
    info = classes.select("key", "size", "coordinates").join(nodes, "key", "left_semi")
    info = info.join(_own_shingles(texts), F.xxhash64("key") == F.col("node"), "left")
    info = info.select("key", "size", "coordinates", (F.col("size") - F.coalesce("own", F.lit(0))).alias("shared"))
    info = stored(info.where(100 * F.col("shared") >= percent * F.col("size")))
    members = stored(members.join(info, "key").join(classes.select("key", "bands"), "key"))
    star = materialise(_star(members, info, percent))
    edges = materialise(linked(star, texts, percent))
    roots = components(edges)
    across = materialise(_pairs_across(members, roots, star, percent))
    more = materialise(linked(across, texts, percent))
    edges = edges.union(more)
    roots = components(edges)
    degree = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    joined = classes.select("key", "first_id").join(roots, F.col("key") == F.col("node"), "left").drop("node")
    joined = joined.withColumn("root", F.coalesce("root", "key"))
    least = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = joined.join(least, "root").join(degree, F.col("key") == F.col("node"), "left")
    named = stored(named.select(F.col("key").alias("class"), "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links")))
    # rows without a set have no class: their own id names them
    own = rows.select("doc_id", "n_shingles", F.coalesce("key", F.col("doc_id").cast("string").cast("binary")).alias("key"))
    out = own.join(named, F.col("key") == F.col("class"), "left")
    component = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _own_shingles(texts: DataFrame) -> DataFrame:
    """``node, own``: how many shingles of each class no other class of ``texts`` has."""
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, s in zip(batch.column(0), shingle_sets(*flat_texts(batch.column(1)))):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), name.as_py())), pa.array(s.view(np.int64))], names=["node", "shingle"])

    named = texts.select(F.xxhash64("key").alias("node"), "text")
    counted = named.mapInArrow(run, "node long, shingle long").groupBy("shingle").agg(
        F.count("*").alias("n"), F.bit_xor("node").alias("node"))
    return counted.where("n = 1").groupBy("node").agg(F.count("*").alias("own"))


def _may_link(percent: int) -> Column:
    """A link needs ``(100 + percent) * both >= percent * (size_a + size_b)``, and a class shares
    at most its size less its own shingles."""
    return (100 + percent) * F.least("shared_a", "shared_b") >= percent * (F.col("size_a") + F.col("size_b"))


def _star(members: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """``a, b``: each class and the likely original among those that share a band with it."""
    portion = (F.col("size") - F.col("shared")) / F.col("size")
    pivots = members.groupBy("band").agg(F.min(F.struct(portion.alias("p"), "key")).alias("pivot"))
    best = members.select("band", "key").join(pivots, "band").where(F.col("key") != F.col("pivot.key"))
    best = best.groupBy("key").agg(F.min("pivot")["key"].alias("pivot"))
    a = info.select(F.col("key"), F.col("size").alias("size_a"), F.col("shared").alias("shared_a"))
    b = info.select(F.col("key").alias("pivot"), F.col("size").alias("size_b"), F.col("shared").alias("shared_b"))
    return best.join(a, "key").join(b, "pivot").where(_may_link(percent)).select(F.col("key").alias("a"), F.col("pivot").alias("b"))


def _pairs_across(members: DataFrame, roots: DataFrame, done: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes that share a band, lie in different components, were not compared and may
    be linked."""
    at = members.join(roots, F.col("key") == F.col("node"), "left").drop("node")
    at = at.withColumn("root", F.coalesce("root", "key"))
    split = at.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("band")
    at = materialise(at.join(split, "band"))
    columns = ("key", "root", "size", "shared", "coordinates", "bands")
    one = at.select("band", *[F.col(c).alias(f"{c}_a") for c in columns])
    two = at.select("band", *[F.col(c).alias(f"{c}_b") for c in columns])
    # one row for a pair: at the smallest band that both have
    first = F.array_min(F.array_intersect("bands_a", "bands_b"))
    same = F.zip_with("coordinates_a", "coordinates_b", lambda x, y: F.when(x == y, 1).otherwise(0))
    agree = F.aggregate(same, F.lit(0), lambda n, x: n + x)
    pairs = one.join(two, "band").where(
        (F.col("key_a") > F.col("key_b")) & (F.col("root_a") != F.col("root_b")) & _may_link(percent)
        & (agree >= F.lit(least_estimate(percent) * BANDS * ROWS)) & (F.col("band") == first))
    pairs = pairs.select(F.col("key_a").alias("a"), F.col("key_b").alias("b"))
    return pairs.join(done, ["a", "b"], "left_anti")


def keep_one_of_each(docs: DataFrame, *, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose document is kept, equal rows once; all columns. Rows that repeat
    an id with different texts stay or go together."""
    kept = link(docs, percent=percent, id_col=id_col, text_col=text_col).where("kept").select(F.col("doc_id").alias("kept_id"))
    kept = materialise(kept.distinct())
    same = F.col(f"d.`{id_col}`").eqNullSafe(F.col("k.kept_id"))  # the rows may have columns of these names
    return docs.alias("d").join(kept.alias("k"), same, "left_semi").dropDuplicates([id_col, text_col])
