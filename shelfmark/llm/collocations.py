"""Phrase collocation mining by Toivonen's method over the n-grams of each language.

1. A sample of the documents proposes phrases: n-grams that reach a lowered count in it, found level
   by level.
2. A pass over all documents counts the proposed phrases and their negative border: every n-gram of
   which both shorter parts (without the last, without the first word) are proposed. For single
   words the border is every other word. Counts are summed by a short key, so that little moves;
   a colliding key can only look too frequent, and what stays below the least count is settled.
3. A border phrase that is frequent after all is a failure: its longer neighbours may be missing.
   The expansion pass adds them, taking every phrase it adds as proposed as well, whence the border
   is closed after it: a frequent phrase has frequent parts, each of them kept or added. The same
   pass counts what step 2 kept by its text, exactly. The result is complete whatever the sample held.

Proposed and kept phrases go to the tasks as filters of fixed size (``FILTER_BITS`` bits for each
length). A false positive only makes a pass count a phrase more; at sizes that fill the filters all
n-grams are counted, still exactly. Tasks sum up before the shuffle.

Defined cases: null and empty texts hold no word; a null language is ``und``; repeated rows count
each; an empty table gives no rows. Ties are broken by count, then phrase.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import floor, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfmark.llm.common import U64, flat_texts, mix
from shelfmark.operators.ordering import top_n
from shelfmark.session import stored

#: Words of a phrase at most (the keys have room for four).
LONGEST = 4
FILTER_BITS = 1 << 25
#: Bits of the keys that the first pass counts by.
KEY_BITS = 40
#: One of so many documents is sampled.
SAMPLED = 8
#: Words that a task holds before it counts and hands on what it has, by key and by text.
KEYED_AT_ONCE, TEXT_AT_ONCE = 1 << 20, 1 << 19
#: Distinct words that a task tells apart before it does so.
WORDS_APART = 1 << 18

# Bytes that end a piece become line feeds, tabs become spaces; no other byte of UTF-8 text is one of them.
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(_BREAKS + b"\t", b"\n" * len(_BREAKS) + b" ")


class Numbers(dict):
    """Numbers of words in the order they appear; nothing has −1, the end of a piece 0."""

    def __init__(self) -> None:
        super().__init__({b"": -1, b"\n": 0})
        self.texts: list[bytes] = [b""]

    def __missing__(self, word: bytes) -> int:
        self.texts.append(word)
        self[word] = number = len(self.texts) - 1
        return number


class Words:
    """The sequences of word numbers of each language, 0 between pieces."""

    def __init__(self) -> None:
        self.numbers = Numbers()
        self.sequences: dict[str, list[np.ndarray]] = {}
        self.held = 0

    @property
    def texts(self) -> list[bytes]:
        return self.numbers.texts

    def add(self, lang: str, text: bytes) -> None:
        tokens = text.lower().translate(_TABLE).replace(b"\n", b" \n ").split(b" ")
        found = np.fromiter(map(self.numbers.__getitem__, tokens), np.int32, len(tokens))
        found = np.append(found[found >= 0], np.int32(0))
        self.sequences.setdefault(lang, []).append(found)
        self.held += len(found)

    def full(self, at_once: int) -> bool:
        return self.held >= at_once or len(self.texts) >= WORDS_APART


def _keys(lang: str, words: list[np.ndarray]) -> np.ndarray:
    """Keys of phrases, given the hashes of their first, second, … words; the last two bits hold the
    number of words less one."""
    out = np.full(len(words[0]), xxhash.xxh3_64_intdigest(lang.encode()), U64)
    for w in words:
        out = mix(out * U64(0x9E3779B97F4A7C15) + w)
    return ((out >> U64(64 - KEY_BITS)) & ~U64(3)) | U64(len(words) - 1)


class Filters:
    """Per length a filter of phrases: the bits that their keys set."""

    def __init__(self, bits: dict[int, np.ndarray] | None = None):
        self.bits = bits or {}

    def has(self, size: int, keys: np.ndarray) -> np.ndarray:
        held = self.bits.get(size)
        if held is None:
            return np.zeros(len(keys), bool)
        at = (keys >> U64(2)) & U64(FILTER_BITS - 1)
        return (held[(at >> U64(6)).astype(np.int64)] >> (at & U64(63))) & U64(1) == 1

    def with_keys(self, phrases: DataFrame) -> Filters:
        """These filters and the keys of a table. What reaches the driver is one row for each 64 bits
        that hold any, at most ``FILTER_BITS / 64`` for each length."""
        at = F.shiftrightunsigned("key", 2).bitwiseAND(FILTER_BITS - 1)
        places = phrases.select(
            (F.col("key").bitwiseAND(3) + 1).cast("int").alias("size"), F.shiftright(at, 6).cast("int").alias("slot"),
            F.expr(f"shiftleft(1L, cast((shiftrightunsigned(key, 2) & {FILTER_BITS - 1}) & 63 as int))").alias("bits"))
        found = places.groupBy("size", "slot").agg(F.bit_or("bits").alias("bits")).toArrow()
        sizes, slot, bits = (found.column(i).to_numpy() for i in range(3))
        out = {k: v.copy() for k, v in self.bits.items()}
        for size in set(sizes.tolist()):
            mine = sizes == size
            out.setdefault(size, np.zeros(FILTER_BITS // 64, U64))[slot[mine]] |= bits[mine].view(U64)
        return Filters(out)


def _counted(
    held: Words, longest: int, proposed: Filters, kept: Filters | None = None,
) -> Iterator[tuple[str, int, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Counts of the n-grams held: ``(lang, size, keys, times, words)``.

    Without ``kept``: of single words, and of n-grams both parts of which are ``proposed``. With it:
    of what that counts, those ``kept``; and of n-grams that it misses although both parts are kept
    or themselves missed. Size 0 gives the number of words.
    """
    hashes, n_words = np.fromiter(map(xxhash.xxh3_64_intdigest, held.texts), U64, len(held.texts)), len(held.texts)
    for lang, sequences in held.sequences.items():
        ids = np.concatenate(sequences)
        starts = np.nonzero(ids > 0)[0]
        if kept is not None and len(starts):
            yield lang, 0, np.zeros(1, U64), np.array([len(starts)]), []
        live = open_ = part = np.zeros(0, bool)
        for size in range(1, longest + 1):
            if size == 1:
                key, known = ids[starts], np.ones(len(starts), bool)
            else:
                # an n-gram stands where its first part and, one place on, its second part stand
                ahead, ahead_open = np.zeros(len(ids) + 1, bool), np.zeros(len(ids) + 1, bool)
                ahead[starts[live]] = True
                ahead_open[starts[open_]] = True
                both = live & ahead[starts + 1]
                starts = starts[both]
                known = open_[both] & ahead_open[starts + 1]
                # the number of the first part and the next word name the n-gram exactly
                key = part[both].astype(np.int64) * n_words + ids[starts + size - 1]
            if not len(starts):
                break
            _, first, part, times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            part = part.reshape(-1)
            words = [ids[starts[first] + i] for i in range(size)]
            keys, known = _keys(lang, [hashes[w] for w in words]), known[first]
            opened = known & proposed.has(size, keys)
            if kept is None:
                chosen, lives = np.ones(len(keys), bool), opened
            else:
                chosen = lives = ~known | kept.has(size, keys)
            yield lang, size, keys[chosen], times[chosen], [w[chosen] for w in words]
            live, open_ = lives[part], opened[part]


def _over(texts: DataFrame, schema: str, at_once: int, records: Callable[[Words], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``records`` of the words of ``texts`` (``lang, text``), about ``at_once`` words at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Words()
        for batch in batches:
            flat, offsets = flat_texts(batch.column(1))
            for i, lang in enumerate(batch.column(0).to_pylist()):
                held.add(lang, flat[offsets[i] : offsets[i + 1]].tobytes())
                if held.full(at_once):
                    yield from records(held)
                    held = Words()
        yield from records(held)

    return texts.mapInArrow(run, schema)


def count_keys(texts: DataFrame, longest: int, proposed: Filters, least_size: int = 1) -> DataFrame:
    """``key, f`` of the n-grams from ``least_size`` to ``longest`` words whose parts are proposed."""
    def records(held: Words) -> Iterator[pa.RecordBatch]:
        for _, size, keys, times, _ in _counted(held, longest, proposed):
            if size >= least_size:
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(times)], names=["key", "f"])

    return _over(texts, "key bigint, f bigint", KEYED_AT_ONCE, records).groupBy("key").agg(F.sum("f").alias("f"))


def count_phrases(texts: DataFrame, longest: int, proposed: Filters, kept: Filters) -> DataFrame:
    """``lang, size, phrase, f`` of kept phrases and of those that the proposals miss; size 0 holds the
    number of words."""
    # language and phrase in one text, which moves less than columns do; no phrase holds a tab
    def records(held: Words) -> Iterator[pa.RecordBatch]:
        texts = pa.array(held.texts, pa.binary())
        for lang, size, _, times, words in _counted(held, longest, proposed, kept):
            if not len(times):
                continue
            parts = [texts.take(pa.array(w)) for w in words] or [pa.array([b""], pa.binary())]
            phrase = pc.binary_join_element_wise(*parts, b" ") if size > 1 else parts[0]
            named = pc.binary_join_element_wise(pa.scalar(lang.encode(), pa.binary()), phrase, b"\t").cast(pa.string())
            yield pa.RecordBatch.from_arrays([named, pa.array(times)], names=["named", "f"])

    counted = _over(texts, "named string, f bigint", TEXT_AT_ONCE, records).groupBy("named").agg(F.sum("f").alias("f"))
    phrase = F.substring_index("named", "\t", -1)
    split = counted.select(
        F.left("named", F.length("named") - F.length(phrase) - 1).alias("lang"), phrase.alias("phrase"), "f")
    words = F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " ")))
    return split.select("lang", words.cast("int").alias("size"), "phrase", "f")


def frequent_phrases(
    docs: DataFrame, least: int, *, text_col: str = "text", lang_col: str = "lang", sampled: int = SAMPLED, longest: int = LONGEST,
) -> DataFrame:
    """``lang, size, phrase, f`` of all n-grams of up to ``longest`` words with at least ``least``
    occurrences, and with size 0 the number of words of each language."""
    plain = [F.col(f"`{c}`") for c, kind in docs.dtypes if kind in ("string", "bigint", "int", "double")]
    rows = docs.select(
        F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        (F.pmod(F.xxhash64(*plain), F.lit(sampled)) == 0).alias("drawn"))
    sample, rows = stored(rows.where("drawn").drop("drawn")), rows.drop("drawn")
    expected = least / sampled
    lowered = max(2, floor(expected - sqrt(expected)))
    proposed = Filters()
    for size in range(1, longest):
        proposed = proposed.with_keys(count_keys(sample, size, proposed, size).where(F.col("f") >= lowered))
    kept = Filters().with_keys(count_keys(rows, longest, proposed).where(F.col("f") >= least))
    counted = count_phrases(rows, longest, proposed, kept)
    return stored(counted.where((F.col("f") >= least) | (F.col("size") == 0)))


def score(frequent: DataFrame, cover: int = 80) -> DataFrame:
    """``lang, phrase, a, l, r, score`` of phrases of two words and more, scored by their worst cut,
    without those that lie inside a longer one of at least ``cover`` percent of their count."""
    counts = frequent.where("size > 0").select("lang", "phrase", "f")
    words = F.split("phrase", " ")
    phrases = frequent.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), words.alias("w"))

    inside = phrases.where("size > 2").select(
        "lang", F.col("a").alias("longer"),
        F.explode(F.expr(
            "flatten(transform(sequence(2, size - 1), k -> transform(sequence(1, size - k + 1), i -> array_join(slice(w, i, k), ' '))))")).alias("phrase"))
    covered = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))

    cuts = phrases.select(
        "lang", "phrase", "a", F.explode(F.expr("sequence(1, size - 1)")).alias("k"), "w", "size").select(
        "lang", "phrase", "a", "k", F.expr("array_join(slice(w, 1, k), ' ')").alias("left_part"),
        F.expr("array_join(slice(w, k + 1, size - k), ' ')").alias("right_part"))

    def part(side: str, name: str) -> DataFrame:
        return counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name))

    value = F.expr("cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0)) div cast(l + r as decimal(20,0))")
    cuts = cuts.join(part("left_part", "l"), ["lang", "left_part"]).join(part("right_part", "r"), ["lang", "right_part"])
    worst = cuts.withColumn("score", value).groupBy("lang", "phrase", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.score", "cut.l", "cut.r")
    kept = worst.join(covered, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (F.col("longer").cast("decimal(19,0)") * 100 < F.col("a").cast("decimal(19,0)") * cover))
    return kept.drop("longer")


def collocations(
    docs: DataFrame, *, least: int = 30, most: int = 2000, text_col: str = "text", lang_col: str = "lang", sampled: int = SAMPLED,
) -> DataFrame:
    """The first ``most`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``."""
    frequent = frequent_phrases(docs, least, text_col=text_col, lang_col=lang_col, sampled=sampled)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = top_n(score(frequent), ["lang"], order, most)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    # at most ``most`` rows of a language are left
    totals = frequent.where("size = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle(least: int = 30, most: int = 2000, cover: int = 80) -> str:
    """DuckDB SQL for ``collocations`` on the table ``documents``, by counting every n-gram."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang,
            unnest(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
        runs AS MATERIALIZED (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
        grams AS MATERIALIZED (SELECT lang, size, phrase, count(*) AS f FROM (
            SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase FROM (
                SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM runs, (VALUES (1), (2), (3), (4)) s(size) WHERE len(w) >= size))
            GROUP BY ALL),
        totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM grams WHERE size = 1 GROUP BY lang),
        cand AS MATERIALIZED (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE size > 1 AND f >= {least}),
        cuts AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:size], ' ') AS y
            FROM (SELECT *, unnest(range(1, size)) AS k FROM cand)),
        scored AS (SELECT c.lang, c.phrase, c.a, p.f AS l, q.f AS r, k, CAST(2000000 * CAST(c.a AS HUGEINT) // (CAST(p.f AS HUGEINT) + q.f) AS BIGINT) AS score
            FROM cuts c JOIN grams p ON p.lang = c.lang AND p.phrase = c.x JOIN grams q ON q.lang = c.lang AND q.phrase = c.y
            QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, k) = 1),
        inside AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer FROM (
            SELECT lang, w, a, m, unnest(range(1, size - m + 2)) AS i FROM cand, (VALUES (2), (3)) s(m) WHERE m < size) GROUP BY ALL),
        kept AS (SELECT s.* FROM scored s LEFT JOIN inside i USING (lang, phrase)
            WHERE i.longer IS NULL OR 100 * CAST(i.longer AS HUGEINT) < {cover} * CAST(s.a AS HUGEINT))
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM kept JOIN totals USING (lang) QUALIFY rank <= {most}"""
