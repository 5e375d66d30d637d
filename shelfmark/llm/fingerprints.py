"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

The distinct non-empty lines of a text are hashed to 64 bits; each digest goes to one cell in
each of three parts of a table, and a cell holds a count, the XOR of its digests and the XOR of
their checks. Subtracting the tables of two versions leaves the digests that differ, and peeling
recovers them: a cell of count 1 or -1 whose check fits names a digest, which is taken out of its
other cells, until all are empty. If that fails, it is repeated larger: the digests are dealt to
as many tables as their number asks for, by halving, so the work stays close to it, and a table that
fails again is repeated with more cells; should even that fail, the few digests of that table are
compared directly. The number of recovered digests and the sizes give the likeness: shared over
all distinct paragraphs.

Only DataFrame functions are used. The next document is found without ordering all texts in one
task: ids are cut into ranges by quantiles, and the first document of a range is also given to
the range whose last document it follows.

Defined cases: null text is empty; two texts without paragraphs have likeness 1; rows that repeat
an id are ordered by a hash of their text; a null id comes after all others; the last document is
followed by the first, a single one by itself; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


PARTS = 3
#: Cells of a part in the fingerprint, and in the tables that are tried after it.
CELLS = 8
LARGER = (8, 24)
#: Digests of both versions that share one of the later tables, about.
DEALT = 8
ROUNDS = 16

#: Documents of a range, about, and ranges, at most.
RANGE_ROWS = 2000
MOST_RANGES = 1024


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def paragraphs(text: Column) -> Column:
    """The distinct digests of the non-empty lines, sorted."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(x) > 0)
    return F.array_sort(F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x))))


def _entry(k: Column, sign: Column, cells: Column) -> Column:
    """A digest with its check, its sign and its cell in each part."""
    return F.struct(
        k.alias("k"), F.xxhash64(k, F.lit(99)).alias("h"), sign.alias("s"),
        *[F.pmod(F.xxhash64(k, F.lit(j)), cells.cast("long")).cast("int").alias(f"i{j}") for j in range(PARTS)])


def _with(cell: Column, entries: Column, part: int, place: Column) -> Column:
    """A cell with those of ``entries`` added that belong to that place of the part."""
    mine = F.filter(entries, lambda e: e[f"i{part}"] == place)
    return F.aggregate(mine, cell, lambda c, e: F.struct(
        (c["c"] + e["s"]).alias("c"), c["k"].bitwiseXOR(e["k"]).alias("k"), c["h"].bitwiseXOR(e["h"]).alias("h")))


def _placed(empty: Column, entries: Column, part: int):
    return lambda i: _with(empty, entries, part, i)


def _cleared(entries: Column, part: int):
    return lambda c, i: _with(c, entries, part, i)


def table(keys: Column, cells: Column) -> Column:
    """The sketch of ``keys``: ``PARTS * cells`` cells, part by part."""
    empty = F.struct(F.lit(0).alias("c"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("h"))
    places = F.sequence(F.lit(0), (cells - 1).cast("int"))
    return bound(F.transform(keys, lambda k: _entry(k, F.lit(1), cells)), lambda entries: F.concat(
        *[F.transform(places, _placed(empty, entries, j)) for j in range(PARTS)]))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct(
        (x["c"] - y["c"]).alias("c"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["h"].bitwiseXOR(y["h"]).alias("h")))


def peel(difference: Column, cells: Column) -> Column:
    """The digests that differ, or null if cells are left over."""
    def pure(state: Column) -> Column:
        fit = F.filter(state["t"], lambda c: (F.abs(c["c"]) == 1) & (c["h"] == F.xxhash64(c["k"], F.lit(99))))
        return F.array_distinct(F.transform(fit, lambda c: F.struct(c["k"].alias("k"), c["c"].alias("c"))))

    def taken(found: Column) -> Column:
        return F.transform(found, lambda p: _entry(p["k"], -p["c"], cells))

    def cleared(t: Column, entries: Column) -> Column:
        return F.concat(*[
            F.transform(F.slice(t, j * cells + 1, cells), _cleared(entries, j)) for j in range(PARTS)])

    # each round: cells with the digests taken out that the round before named; then new pure cells
    def step(state: Column, _: Column) -> Column:
        left = F.struct(cleared(state["t"], state["p"]).alias("t"))
        return F.aggregate(F.array(left), F.struct(state["t"].alias("t"), state["p"].alias("p"), state["found"].alias("found")), lambda old, new: F.struct(
            new["t"].alias("t"), taken(pure(new)).alias("p"),
            F.concat(old["found"], F.transform(old["p"], lambda p: p["k"])).alias("found")))

    first = F.aggregate(
        F.array(F.struct(difference.alias("t"))),
        F.struct(difference.alias("t"), F.array().cast(_TAKEN).alias("p"), F.array().cast("array<bigint>").alias("found")),
        lambda old, new: F.struct(new["t"].alias("t"), taken(pure(new)).alias("p"), old["found"].alias("found")))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), first, lambda s, i: F.when(F.size(s["p"]) > 0, step(s, i)).otherwise(s))
    done = F.aggregate(F.array(end), F.lit(None).cast("array<bigint>"), lambda _, s: F.when(
        (F.size(s["p"]) == 0) & ~F.exists(s["t"], lambda c: (c["c"] != 0) | (c["k"] != 0) | (c["h"] != 0)), s["found"]))
    return done


_TAKEN = "array<struct<k:bigint,h:bigint,s:int,i0:int,i1:int,i2:int>>"


def likeness(keys_a: Column, keys_b: Column, table_a: Column, table_b: Column) -> Column:
    """Shared over all distinct paragraphs, from peeling, the given tables first."""
    both = F.size(keys_a) + F.size(keys_b)
    # halved again and again by a bit of the digest, until a table holds about DEALT of them
    halvings = F.greatest(F.ceil(F.log2(both / DEALT)), F.lit(1)).cast("int")

    def dealt(keys: Column) -> Column:
        def halved(tables: Column, bit: Column) -> Column:
            return F.flatten(F.transform(tables, lambda x: F.array(
                F.filter(x, lambda k: F.getbit(k, bit) == 0), F.filter(x, lambda k: F.getbit(k, bit) == 1))))

        return F.aggregate(F.sequence(F.lit(1), halvings), F.array(keys), halved)

    def differing(x: Column, y: Column) -> Column:
        tried = [F.array_size(peel(subtract(table(x, F.lit(n)), table(y, F.lit(n))), F.lit(n))) for n in LARGER]
        return F.coalesce(*tried, F.size(F.array_except(x, y)) + F.size(F.array_except(y, x)))

    each = F.zip_with(dealt(keys_a), dealt(keys_b), differing)
    retried = F.aggregate(each, F.lit(0), lambda n, x: n + x)
    differ = F.coalesce(F.array_size(peel(subtract(table_a, table_b), F.lit(CELLS))), retried)
    return F.when(both == 0, F.lit(1.0)).otherwise((both - differ) / (both + differ))


def fingerprint_text(keys: Column, cells: Column) -> Column:
    """The sketch as text: the number of paragraphs, then each cell."""
    return F.concat(F.size(keys).cast("string"), F.lit("|"), F.array_join(
        F.transform(cells, lambda c: F.concat_ws(".", c["c"].cast("string"), F.lower(F.hex(c["k"])), F.lower(F.hex(c["h"])))), ";"))


def with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, next_text``: each document with the next by descending id."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.withColumn("place", F.coalesce("doc_id", F.lit(-(1 << 63))))
    n = rows.count()
    ranges = max(1, min(MOST_RANGES, -(-n // RANGE_ROWS)))
    cuts = rows.agg(F.percentile_approx("place", [i / ranges for i in range(1, ranges)], 10000)).first()[0] if ranges > 1 and n else []
    cuts = sorted(set(cuts or []))
    # how many cuts are smaller, by halving
    steps = [1 << b for b in range(len(cuts).bit_length() - 1, -1, -1)]
    if cuts:
        held = F.array(*[F.lit(c) for c in cuts])
        part = F.aggregate(
            F.array(*[F.lit(s) for s in steps]), F.lit(0),
            lambda j, s: F.when((j + s <= len(cuts)) & (F.get(held, j + s - 1) < F.col("place")), j + s).otherwise(j))
    else:
        part = F.lit(0)
    rows = rows.withColumn("part", part)
    firsts = sorted((r["part"], r["first"]) for r in rows.groupBy("part").agg(F.max("place").alias("first")).collect())  # at most MOST_RANGES
    home = F.struct(F.col("part").alias("part"), F.lit(0).alias("guest"))
    if firsts:
        after = [p for p, _ in firsts[1:]] + [firsts[0][0]]
        visits = F.create_map(*[x for (_, f), p in zip(firsts, after) for x in (F.lit(f), F.lit(p))])
        target = F.element_at(visits, F.col("place"))
        places = F.when(target.isNotNull(), F.array(home, F.struct(target.alias("part"), F.lit(1).alias("guest")))).otherwise(F.array(home))
    else:
        places = F.array(home)
    dealt = rows.withColumn("at", F.explode(places))
    order = Window.partitionBy("at.part").orderBy("at.guest", F.desc("place"), F.xxhash64("text"))
    return dealt.select("doc_id", "text", F.lead("text").over(order).alias("next_text"), F.col("at.guest").alias("guest")).where("guest = 0").drop("guest")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``."""
    rows = with_next(docs, id_col=id_col, text_col=text_col)
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.expr("left(text, cast(n_chars - floor(n_chars / 2) as int))"), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.withColumn("edited", edited).select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        paragraphs(F.col("text")).alias("own"), paragraphs(F.col("edited")).alias("changed"), paragraphs(F.col("next_text")).alias("following"))
    rows = rows.select("*", *[table(F.col(c), F.lit(CELLS)).alias(f"{c}_table") for c in ("own", "changed", "following")])
    return rows.select(
        "doc_id", "n_chars", "edited_sha256",
        fingerprint_text(F.col("own"), F.col("own_table")).alias("fingerprint"),
        fingerprint_text(F.col("changed"), F.col("changed_table")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed"), F.col("own_table"), F.col("changed_table")).alias("near_edited"),
        likeness(F.col("own"), F.col("following"), F.col("own_table"), F.col("following_table")).alias("near_next"))
