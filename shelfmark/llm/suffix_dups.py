"""Remove bytes covered by a string of ``length`` bytes that also starts earlier.

The difference-cover algorithm for suffix arrays, to the depth that the question needs. A
difference cover D modulo v has, for any two positions, a shift under v that brings both into D.

1. *Sort sampled tuples.* At the positions in D (9 of 73) the strings of ``length - v + 1`` bytes
   are sorted by fingerprint and named equal or unique. Two equal strings of ``length`` bytes
   hold equal sampled strings at the common shift.
2. *Recurse on names.* Sampled positions whose names occur twice are sorted by their longer
   strings of ``length + v - 1`` bytes. One that stands earlier makes all windows that begin in
   its first v bytes repeats, which settles the inside of long passages from 9 of 73 positions.
   As only order up to ``length`` bytes is asked for, one level ends the recursion.
3. *Merge the rest.* The windows left, sampled or not, that begin within v bytes before a name
   that occurs twice, are sorted by fingerprint and adjacent equals compared: all but the first
   in document order are repeats. Bytes covered by repeats are removed.

Ranks by fingerprint stand in for alphabetical ranks, as only equality is asked.

Documents are laid out once, in order, as blocks of some megabytes in a bucketed table. What
moves afterwards is not a row for each byte: a block sends each slice of the fingerprint range a
sorted list of differences, and gets back one bit for each entry. A string that stands in every document is one
entry for each block, so no slice grows with a common string. Answers join the blocks by bucket,
without moving the text again. Names are 32 bits within a slice (a clash only adds work to
the later steps), longer strings 64 bits within a slice chosen by other bits.

Defined cases: null text is empty; a null id comes before all others; rows that repeat an id
stand in an order fixed when the blocks are written, and count as separate documents; texts of
any length are taken whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import CHUNK_BYTES, U64, Rolling, flat_texts, mix
from shelfmark.session import ensure_checkpoint_dir, stored

#: A perfect difference set: each difference modulo 73 occurs once.
PERIOD = 73
COVER = (1, 2, 4, 8, 16, 32, 37, 55, 64)

LENGTH = 100
BLOCK_BYTES = 8 << 20

_IN_COVER = np.zeros(PERIOD, bool)
_IN_COVER[list(COVER)] = True


def block_table(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: Column | None = None, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``block, ids, offsets, data, carried``: documents in order of id, several to a row; ``block``
    grows with the order, ``carried`` holds the string ``carry`` of each. In buckets of ``block``."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        ids, sizes, pieces, extra, held = [], [], [], [], 0

        def row() -> pa.RecordBatch:
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + seq]), pa.array([ids], pa.list_(pa.int64())), pa.array([offsets.tobytes()], pa.binary()), pa.array([b"".join(pieces)], pa.binary()), pa.array([extra], pa.list_(pa.string()))],
                names=["block", "ids", "offsets", "data", "carried"])

        for batch in batches:
            flat, at = flat_texts(batch.column(1))
            carried = batch.column(2).to_pylist()
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                size = int(at[i + 1] - at[i])
                if ids and held + size > block_bytes:
                    yield row()
                    seq, ids, sizes, pieces, extra, held = seq + 1, [], [], [], [], 0
                ids.append(doc_id)
                sizes.append(size)
                pieces.append(flat[at[i] : at[i + 1]].tobytes())
                extra.append(carried[i])
                held += size
        if ids:
            yield row()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), (F.lit(None) if carry is None else carry).cast("string").alias("carried"))
    ordered = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    rows = ordered.mapInArrow(run, "block long, ids array<long>, offsets binary, data binary, carried array<string>")
    ensure_checkpoint_dir(spark)
    name = f"blocks_{uuid.uuid4().hex}"
    folder = f"{spark.sparkContext.getCheckpointDir()}/tables/{name}"
    rows.write.option("path", folder).option("compression", "zstd").bucketBy(n, "block").saveAsTable(name)
    return spark.table(name)


def _pieces(n: int, length: int) -> Iterator[tuple[int, int]]:
    """Ranges of window starts, so that the bytes of each range fit one numpy pass."""
    for a in range(0, max(n - length + 1, 0), CHUNK_BYTES):
        yield a, min(a + CHUNK_BYTES, n - length + 1)


def _within(offsets: np.ndarray, length: int) -> np.ndarray:
    """Which bytes start a string of ``length`` that ends in its document."""
    ok = np.ones(int(offsets[-1]), bool)
    for a, b in zip(offsets[:-1], offsets[1:]):
        ok[max(a, b - length + 1) : b] = False
    return ok


def sampled(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the cover and the fingerprints of their strings of ``length - PERIOD + 1`` bytes."""
    short = length - PERIOD + 1
    place = np.arange(len(data), dtype=np.int32) - np.repeat(offsets[:-1], np.diff(offsets)).astype(np.int32)
    at = np.flatnonzero(_within(offsets, short) & _IN_COVER[place % PERIOD])
    names = np.empty(len(at), U64)
    for a, b in _pieces(len(data), short):
        i, j = np.searchsorted(at, (a, b))
        names[i:j] = mix(Rolling(data[a : b + short - 1], 2).windows(short)[at[i:j] - a])
    return at, names


def window_hashes(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent fingerprints of the windows at ``starts``: the value and the slice bits."""
    value, other = np.empty(len(starts), U64), np.empty(len(starts), U64)
    for a, b in _pieces(len(data), length):
        i, j = np.searchsorted(starts, (a, b))
        if j > i:
            for seed, out in ((3, value), (4, other)):
                out[i:j] = mix(Rolling(data[a : b + length - 1], seed).windows(length)[starts[i:j] - a])
    return value, other


def _slices(bits: np.ndarray, n: int) -> np.ndarray:
    return ((bits >> U64(40)) * U64(n) >> U64(24)).astype(np.int32)


def name_lists(names: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of the samples by slice and 32-bit name, those names, and the bounds of slices."""
    part = _slices(names, n)
    low = (names & U64(0xFFFFFFFF)).astype(np.uint32)
    order = np.argsort((part.astype(U64) << U64(32)) | low.astype(U64), kind="stable")
    return order, low[order], np.searchsorted(part[order], np.arange(n + 1))


def window_lists(value: np.ndarray, other: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of the windows by slice, value and position, the places in it where a new value
    begins, and the bounds of slices among those places."""
    part = _slices(other, n)
    order = np.lexsort((value, part))
    v, p = value[order], part[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (p[1:] != p[:-1])
    heads = np.flatnonzero(new)
    return order, heads, np.searchsorted(p[heads], np.arange(n + 1))


def _bits(rows: list[dict], n: int, total: int, bounds: np.ndarray) -> np.ndarray:
    out = np.zeros(total, bool)
    for r in rows:
        a, b = bounds[r["slice"]], bounds[r["slice"] + 1]
        out[a:b] = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=b - a).astype(bool)
    return out


def shared_samples(data: np.ndarray, offsets: np.ndarray, length: int, n: int, answers: list[dict]) -> np.ndarray:
    """Sampled positions whose names occur more than once."""
    at, names = sampled(data, offsets, length)
    order, _, bounds = name_lists(names, n)
    again = np.empty(len(at), bool)
    again[order] = _bits(answers, n, len(at), bounds)
    return at[again]


def long_samples(at: np.ndarray, offsets: np.ndarray, length: int) -> np.ndarray:
    """Those of the positions whose longer string ends in its document."""
    return at[_within(offsets, length + PERIOD - 1)[at]]


def windows_left(at: np.ndarray, settled: np.ndarray, offsets: np.ndarray, length: int) -> np.ndarray:
    """Starts of the windows that begin within the period before one of ``at`` and are not settled."""
    near = _runs(np.maximum(at - PERIOD + 1, 0), at + 1, int(offsets[-1]))
    return np.flatnonzero(_within(offsets, length) & near & ~settled)


def _runs(start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in one of the ranges."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, start, 1)
    np.add.at(edge, end, -1)
    return np.cumsum(edge[:-1]) > 0


def packed(values: np.ndarray) -> bytes:
    """Sorted values as differences, byte by byte: their upper bytes are runs of zeros."""
    steps = np.diff(values, prepend=values.dtype.type(0))
    return steps.view(np.uint8).reshape(len(values), -1).T.tobytes()


def unpacked(entries: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    steps = np.ascontiguousarray(np.frombuffer(entries, np.uint8).reshape(size, -1).T).view(kind).ravel()
    return np.cumsum(steps, dtype=kind)


def _block(table: pa.Table) -> tuple[list, np.ndarray, np.ndarray]:
    ids = table.column("ids")[0].as_py()
    return ids, np.frombuffer(table.column("data")[0].as_py(), np.uint8), np.frombuffer(table.column("offsets")[0].as_py(), np.int64)


def _sent(block: int, lists: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table({
        "slice": pa.array([s for s, _ in lists], pa.int32()), "block": pa.array([block] * len(lists), pa.int64()),
        "entries": pa.array([x for _, x in lists], pa.binary())})


def remove_repeats(
    docs: DataFrame, *, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", carry: Column | None = None,
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept, spans, carried`` for each row:
    ``kept`` the remaining bytes, ``spans`` the removed runs as (start, end), ``carried`` the
    string that ``carry`` gives for the row."""
    if length < PERIOD + 8:
        raise ValueError(f"length must be at least {PERIOD + 8}")
    blocks = block_table(docs, id_col=id_col, text_col=text_col, carry=carry)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def send_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                _, data, offsets = _block(pa.Table.from_batches([batch.slice(i, 1)]))
                _, low, bounds = name_lists(sampled(data, offsets, length)[1], n)
                lists = [(s, packed(low[a:b])) for s, (a, b) in enumerate(zip(bounds, bounds[1:])) if a < b]
                yield from _sent(batch.column(0)[i].as_py(), lists).to_batches()

    def answer_names(table: pa.Table) -> pa.Table:
        lists = [unpacked(x.as_py(), np.uint32) for x in table.column("entries")]
        every = np.sort(np.concatenate(lists))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        return _reply(table, 1, [_among(x, twice) for x in lists])

    def answer_strings(kind: int):
        def answer(table: pa.Table) -> pa.Table:
            lists = [unpacked(x.as_py(), U64) for x in table.column("entries")]
            rank = np.argsort(table.column("block").to_numpy(), kind="stable")
            every = np.concatenate([lists[i] for i in rank])
            earlier = np.ones(len(every), bool)
            earlier[np.unique(every, return_index=True)[1]] = False
            found = [None] * len(lists)
            for i, end in zip(rank, np.cumsum([len(lists[i]) for i in rank])):
                found[i] = earlier[end - len(lists[i]) : end]
            return _reply(table, kind, found)

        return answer

    def strings(data: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        value, other = window_hashes(data, starts, size)
        order, heads, bounds = window_lists(value, other, n)
        return value, order, heads, bounds

    def send_strings(block: int, data: np.ndarray, starts: np.ndarray, size: int) -> pa.Table:
        value, order, heads, bounds = strings(data, starts, size)
        firsts = value[order][heads]
        return _sent(block, [(s, packed(firsts[a:b])) for s, (a, b) in enumerate(zip(bounds, bounds[1:])) if a < b])

    def repeats(data: np.ndarray, starts: np.ndarray, size: int, answers: list[dict]) -> np.ndarray:
        """Those of ``starts`` whose string of ``size`` bytes starts earlier."""
        _, order, heads, bounds = strings(data, starts, size)
        repeat = np.ones(len(starts), bool)
        repeat[order[heads]] = _bits(answers, n, len(heads), bounds)
        return starts[repeat]

    def send_long(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _sent(0, [])
        _, data, offsets = _block(left)
        at = shared_samples(data, offsets, length, n, right.to_pylist())
        return send_strings(left.column("block")[0].as_py(), data, long_samples(at, offsets, length), length + PERIOD - 1)

    def settle(data: np.ndarray, offsets: np.ndarray, answers: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        """The windows settled as repeats, and the starts of those left."""
        at = shared_samples(data, offsets, length, n, [r for r in answers if r["kind"] == 1])
        found = repeats(data, long_samples(at, offsets, length), length + PERIOD - 1, [r for r in answers if r["kind"] == 2])
        settled = _runs(found, found + PERIOD, len(data))
        return settled, windows_left(at, settled, offsets, length)

    def send_windows(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _sent(0, [])
        _, data, offsets = _block(left)
        _, starts = settle(data, offsets, right.to_pylist())
        return send_strings(left.column("block")[0].as_py(), data, starts, length)

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, data, offsets = _block(left) if left.num_rows else ([], np.zeros(0, np.uint8), np.zeros(1, np.int64))
        answers = right.to_pylist()
        settled, starts = settle(data, offsets, answers)
        settled[repeats(data, starts, length, [r for r in answers if r["kind"] == 3])] = True
        found = np.flatnonzero(settled)
        gone = _runs(found, found + length, len(data))
        rows = [_cut_document(data[a:b], gone[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
        columns = list(zip(*rows)) if rows else [()] * 6
        carried = left.column("carried")[0].as_py() if left.num_rows else []
        return pa.table(
            [pa.array(ids, pa.int64()), *[pa.array(list(c), t) for c, t in zip(columns, _TYPES)], pa.array(carried, pa.string())],
            names=["doc_id", *_NAMES, "carried"])

    lists = "slice int, block long, entries binary"
    replies = "block long, slice int, kind int, bits binary"
    by_block = blocks.groupBy("block")
    answers = stored(blocks.select("block", "ids", "offsets", "data").mapInArrow(send_names, lists).groupBy("slice").applyInArrow(answer_names, replies))
    for kind, send in ((2, send_long), (3, send_windows)):
        sent = by_block.cogroup(answers.groupBy("block")).applyInArrow(send, lists)
        answers = answers.union(stored(sent.groupBy("slice").applyInArrow(answer_strings(kind), replies)))
    return by_block.cogroup(answers.groupBy("block")).applyInArrow(
        cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<start:long,end:long>>, carried string")


def _reply(table: pa.Table, kind: int, found: list[np.ndarray]) -> pa.Table:
    return pa.table({
        "block": table.column("block"), "slice": table.column("slice"), "kind": pa.array([kind] * len(found), pa.int32()),
        "bits": pa.array([np.packbits(x).tobytes() for x in found], pa.binary())})


_NAMES = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans")
_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))


def _among(values: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which sorted ``values`` occur in sorted ``held``."""
    if not len(held):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(held, values), len(held) - 1)
    return held[at] == values


def _cut_document(data: np.ndarray, gone: np.ndarray) -> tuple:
    turns = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    kept = data[~gone].tobytes()
    spans = [{"start": int(a), "end": int(b)} for a, b in zip(turns[::2], turns[1::2])]
    return len(data), int(gone.sum()), len(spans), hashlib.sha256(kept).hexdigest(), kept, spans


#: Without these formats timestamps travel as milliseconds.
_MICROSECONDS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def without_repeats(docs: DataFrame, *, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``docs`` with the remaining text of each row and its length in ``chars_col``, if there is such
    a column. Rows of which nothing is left go; bytes of a character that was cut become U+FFFD."""
    others = [c for c in docs.columns if c != text_col]
    schema = docs.select(*others).schema
    found = remove_repeats(docs, length=length, id_col=id_col, text_col=text_col, carry=F.to_json(F.struct(*others), {"ignoreNullFields": "false"} | _MICROSECONDS))
    found = found.where((F.octet_length("kept") > 0) | (F.col("n_bytes") == 0))
    row = F.from_json("carried", schema, _MICROSECONDS)
    text = F.make_valid_utf8(F.col("kept").cast("string"))
    out = found.select(row.alias("row"), text.alias("kept_text"))
    columns = {c: F.col(f"row.`{c}`") for c in others} | {text_col: F.col("kept_text")}
    if chars_col in others:
        columns[chars_col] = F.length("kept_text").cast(schema[chars_col].dataType)
    return out.select(*[columns[c].alias(c) for c in docs.columns])
