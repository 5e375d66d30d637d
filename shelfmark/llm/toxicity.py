"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic steps.

A lexicon of word stems is learnt from the labelled texts (beginnings of words that stand in toxic
texts far more often than chance allows) and joined with a short fixed one. Features of the whole
text are densities of both, closeness to words of the second person, capitals, punctuation, and
obfuscated spellings; each distinct word is looked at once, the text is then arithmetic on flags.
Spark's gradient-boosted trees learn from the features; their margins become probabilities by
isotonic regression over bins of the margin.

Scale: learning takes at most ``most_labels`` labelled rows (those with the smallest hashes of the
id), so what is broadcast and what the trees see is bounded; every text is scored. Texts are never
shuffled. The driver holds the ids of that sample, at most ``CANDIDATES`` stems and the trees.

Defined cases: null and empty texts have the features of the empty text and get a score; repeated
rows are scored alike; null labels are not learnt from, repeated labels count each; without any
label every score is 0.5, with one class its share; an empty table gives none.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import flat_texts
from shelfmark.session import materialise, stored

FEATURES = (
    "learnt_share", "learnt", "fixed_share", "fixed", "addressed_share", "addressed", "second_person",
    "capitals", "loud_words", "exclamations", "questions", "signs", "repeated_signs", "disguised_share",
    "disguised_hits", "log_words", "word_length",
)
#: Learning takes at most this many labelled rows.
MOST_LABELS = 200_000
#: Stems looked at by the driver, and kept in the lexicon.
CANDIDATES, STEMS = 4096, 512
#: A stem is kept from this log-likelihood ratio (one degree of freedom: p < 1e-6) and lift.
LEAST_RATIO, LEAST_LIFT, LEAST_TEXTS = 24.0, 10.0, 4
SHORTEST, LONGEST = 4, 10
NEAR_WORDS = 5
BINS = 1024
#: Distinct words a task remembers before it forgets all.
REMEMBERED = 400_000

#: Insults in four languages, as beginnings of words.
INSULTS = (
    "idiot moron stupid imbecil cretin loser scum worthless pathetic disgust trash clown dumb fool jerk "
    "bastard bitch whore slut asshole fuck shit crap douche retard pervert scumbag filth vermin parasit "
    "degenerat subhuman dumbass jackass wanker twat cunt hateful "
    "arschloch idioti dummkopf trottel schlampe hure wichser fotze missgeburt abschaum drecks scheiss scheiß "
    "verlierer volldepp vollidiot spast hurensohn "
    "connard connasse salaud salope putain merde abruti débile crétin enculé ordure pourriture minable bouffon "
    "gilipollas pendejo cabrón cabron puta mierda estúpid imbécil basura inútil asqueros maric zorra payaso").split()
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deinen deiner ihr euch euer sie tu te toi ton ta tes vous votre vos "
    "tú ti tus usted ustedes vosotros vuestro".split())
_PLAIN = str.maketrans("013457@$€!|", "oieastasei" + "l")
_INNER = re.compile(r"[\W\d_]")
_EDGES = re.compile(r"^(?:_|[^\w@$€])+|[\W_]+$")
LEARNT, FIXED, PERSON, LOUD, DISGUISED, HIT = 1, 2, 4, 8, 16, 32

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTERS = _UPPER.copy()
_LETTERS[97:123] = True
_LETTERS[128:] = True
_SIGNS = np.zeros(256, bool)
_SIGNS[33:48] = _SIGNS[58:65] = _SIGNS[91:97] = _SIGNS[123:127] = True


def plain_word(word: str) -> tuple[str, bool]:
    """The letters of a word in lower case, and whether they were disguised by signs or digits."""
    core = _EDGES.sub("", word).lower()
    if not core or core.isalpha():
        return core, False
    plain = _INNER.sub("", core.translate(_PLAIN))
    letters = sum(c.isalpha() for c in core)
    # a hyphen, an apostrophe or a number beside letters is ordinary spelling
    ordinary = letters < 2 or not core[0].isalpha() and letters < len(core) / 2 or re.fullmatch(r"[^\W\d_]+(?:[-'’./,:][^\W\d_]+)+|[^\W\d_]+\d+", core) is not None
    return plain, not ordinary


def stems_of(word: str) -> list[str]:
    """Beginnings of a plain word that a lexicon may hold."""
    return [word[:n] for n in range(SHORTEST, min(len(word), LONGEST) + 1)]


class Flags(dict):
    """Flags of words as they stand in a text, worked out once for each."""

    def __init__(self, learnt: frozenset[str], fixed: frozenset[str]):
        self.learnt, self.fixed = learnt, fixed

    def __missing__(self, word: str) -> int:
        plain, disguised = plain_word(word)
        stems = stems_of(plain)
        out = LEARNT * any(s in self.learnt for s in stems) + FIXED * any(s in self.fixed for s in stems)
        if disguised:
            out |= DISGUISED | HIT * (out > 0)
        if plain in SECOND_PERSON:
            out |= PERSON
        if len(plain) > 2 and word.isupper():
            out |= LOUD
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = out
        return out


def features(text: str, data: np.ndarray, flags: Flags) -> list[float]:
    """The features of one text, given also as bytes."""
    words = text.split()
    n, m = len(data), len(words)
    if not m:
        return [0.0] * len(FEATURES)
    kinds = np.fromiter((flags[w] for w in words), np.int64, m)
    counts = np.bincount(data, minlength=256)
    letters, signs = int(counts[_LETTERS].sum()), _SIGNS[data]
    hits = np.nonzero(kinds & (LEARNT | FIXED))[0]
    persons = np.nonzero(kinds & PERSON)[0]
    addressed = 0
    if len(hits) and len(persons):
        after = np.searchsorted(persons, hits)
        ahead = persons[np.minimum(after, len(persons) - 1)] - hits
        behind = hits - persons[np.maximum(after - 1, 0)]
        addressed = int(((np.abs(ahead) <= NEAR_WORDS) | (np.abs(behind) <= NEAR_WORDS)).sum())
    learnt, fixed, loud, disguised, hidden = (int((kinds & bit != 0).sum()) for bit in (LEARNT, FIXED, LOUD, DISGUISED, HIT))
    return [
        learnt / m, float(np.log1p(learnt)), fixed / m, float(np.log1p(fixed)), addressed / m, float(np.log1p(addressed)),
        len(persons) / m, counts[_UPPER].sum() / max(letters, 1), loud / m, counts[33] / n, counts[63] / n,
        signs.sum() / n, (signs[1:] & signs[:-1]).sum() / n, disguised / m, float(np.log1p(hidden)), float(np.log1p(m)), n / m,
    ]


def _lists(rows: list[list[float]], width: int) -> pa.Array:
    flat = np.array(rows, dtype=float).reshape(-1)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, width), pa.int32()), pa.array(flat))


def text_features(docs: DataFrame, lexicon: list[str], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, features`` of every whole text, row by row."""
    learnt, fixed = frozenset(lexicon), frozenset(INSULTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = Flags(learnt, fixed)
        for batch in batches:
            flat, offsets = flat_texts(batch.column(1))
            rows = [
                features(t.as_py() or "", flat[offsets[i] : offsets[i + 1]], flags) for i, t in enumerate(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(rows, len(FEATURES))], names=[id_col, "features"])

    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, features array<double>"
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learnable(labels: DataFrame, *, id_col: str, label_col: str, most: int) -> DataFrame:
    """``label_id, y`` of at most ``most`` labelled rows that are not held out: those with the
    smallest hashes. Bounded, so it may be broadcast."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.select(F.col(id_col).alias("label_id"), F.col(label_col).cast("double").alias("y"))
    return materialise(known.orderBy(F.xxhash64("label_id"), "label_id", "y").limit(most))


def learn_lexicon(texts: DataFrame, *, text_col: str = "text") -> list[str]:
    """Stems that mark toxic texts, out of ``texts`` with their label ``y``.

    Per stem the texts of either class that hold it are counted, first within tasks. Stems whose
    log-likelihood ratio and lift are large are taken, the strongest first, and at equal counts the
    longest; a stem under one taken before adds nothing and is left out.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        stems: dict[str, list[str]] = {}

        def flush() -> pa.RecordBatch:
            columns = [pa.array(list(held), pa.string()), *(pa.array([v[i] for v in held.values()], pa.int64()) for i in (0, 1))]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names=["stem", "toxic", "clean"])

        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1)):
                found: set[str] = set()
                for word in set((text.as_py() or "").split()):
                    if word not in stems:
                        if len(stems) > REMEMBERED:
                            stems.clear()
                        stems[word] = stems_of(plain_word(word)[0])
                    found.update(stems[word])
                side = 0 if y.as_py() > 0 else 1
                for stem in found:
                    held[stem][side] += 1
                if len(held) > REMEMBERED:
                    yield flush()
        held[""] = [0, 0]
        yield flush()

    sizes = texts.agg(F.coalesce(F.sum((F.col("y") > 0).cast("long")), F.lit(0)).alias("toxic"), F.count("y").alias("all")).first()
    nt, nc = sizes["toxic"], sizes["all"] - sizes["toxic"]
    if not nt or not nc:
        return []
    a, b, n = F.col("toxic"), F.col("clean"), float(nt + nc)

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    ratio = 2 * (
        part(a, (a + b) * nt / n) + part(b, (a + b) * nc / n)
        + part(nt - a, (n - a - b) * nt / n) + part(nc - b, (n - a - b) * nc / n))
    counted = texts.select(text_col, "y").mapInArrow(count, "stem string, toxic bigint, clean bigint")
    counted = counted.groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    strong = counted.where((a >= LEAST_TEXTS) & (a / nt >= LEAST_LIFT * (b + 0.5) / (nc + 1))).withColumn("ratio", F.round(ratio, 6))
    strong = strong.where(F.col("ratio") >= LEAST_RATIO)
    best = strong.orderBy(F.desc("ratio"), F.desc(F.length("stem")), "stem").limit(CANDIDATES).collect()
    taken: list[str] = []
    for row in best:
        if len(taken) < STEMS and not any(s in taken for s in stems_of(row["stem"])):
            taken.append(row["stem"])
    return taken


@dataclass
class Classifier:
    """What was learnt: stems, trees and calibration; ``share`` stands for all where a class is missing."""

    lexicon: list[str]
    share: float
    trees: GBTClassificationModel | None = None
    steps: IsotonicRegressionModel | None = None


def _margins(rows: DataFrame, trees: GBTClassificationModel) -> DataFrame:
    scored = trees.transform(rows.withColumn("__vector", array_to_vector("features")))
    return scored.withColumn("margin", vector_to_array("rawPrediction")[1]).drop(*trees_columns())


def trees_columns() -> list[str]:
    return ["__vector", "rawPrediction", "probability", "prediction"]


def fit(
    feature_rows: DataFrame, known: DataFrame, lexicon: list[str], *, id_col: str = "doc_id",
    trees: int = 30, depth: int = 3, step: float = 0.2, seed: int = 13,
) -> Classifier:
    """Boosted trees and their calibration from the rows of ``feature_rows`` in ``known``."""
    rows = stored(feature_rows.join(F.broadcast(known), F.col(id_col) == F.col("label_id")).select("features", "y").repartition(16))
    share = rows.agg(F.avg((F.col("y") > 0).cast("double")).alias("y")).first()["y"]
    if share is None or share in (0.0, 1.0):
        return Classifier(lexicon, 0.5 if share is None else share)
    label = (F.col("y") > 0).cast("double")
    learner = GBTClassifier(
        featuresCol="__vector", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=step, seed=seed, maxBins=64, minInstancesPerNode=3)
    model = learner.fit(rows.select(array_to_vector("features").alias("__vector"), label.alias("label")))
    # margins lie within the sum of the step sizes; a bin is one row of the calibration
    binned = _margins(rows, model).groupBy(F.floor(F.col("margin") * BINS / (2 * trees * step)).alias("bin"))
    bins = binned.agg(F.avg("margin").alias("margin"), F.avg(label).alias("label"), F.count("*").cast("double").alias("weight"))
    steps = IsotonicRegression(featuresCol="margin", labelCol="label", weightCol="weight").fit(bins)
    return Classifier(lexicon, share, model, steps)


def score_features(feature_rows: DataFrame, model: Classifier, *, id_col: str = "doc_id") -> DataFrame:
    """``id_col, score`` of each row."""
    if model.trees is None:
        return feature_rows.select(id_col, F.lit(model.share).alias("score"))
    scored = model.steps.transform(_margins(feature_rows, model.trees))
    return scored.select(id_col, F.greatest(F.least(F.col("prediction"), F.lit(1.0)), F.lit(0.0)).alias("score"))


def score_toxicity(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    most_labels: int = MOST_LABELS,
) -> DataFrame:
    """``id_col, held_out, score`` for every row of ``docs``, learnt from ``labels``."""
    known = learnable(labels, id_col=id_col, label_col=label_col, most=most_labels)
    texts = docs.select(id_col, text_col).join(F.broadcast(known), F.col(id_col) == F.col("label_id")).select(F.col(text_col), "y")
    lexicon = learn_lexicon(texts, text_col=text_col)
    rows = stored(text_features(docs, lexicon, id_col=id_col, text_col=text_col))
    model = fit(rows, known, lexicon, id_col=id_col)
    return score_features(rows, model, id_col=id_col).select(id_col, held_out(F.col(id_col)).alias("held_out"), "score")
