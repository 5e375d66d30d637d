"""Token counts by byte-pair merging over a linked list of symbols with a heap of pairs.

The vocabulary file gives pieces with scores. A text becomes symbols (its characters, spaces
written as U+2581, one such mark in front); the adjacent pair whose union has the best score is
merged, leftmost first among equals, until no pair is a piece. The count is the number of
symbols less the number of merges, plus, for symbols that are no piece, the bytes beyond the
first (byte fallback). No identifier is produced.

No piece holds U+2581 after another character, and characters of different families (letters,
points, signs, as the pieces show) never stand side by side in a piece, so no merge crosses
such a place. A text is counted run by run between them; a worker keeps the counts of the runs
it meets first in a table of bounded size.

Null and empty texts count 0 tokens; texts of any length and single words of any length are
counted whole (a word of n characters takes n log n steps); repeated rows are counted each.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"

#: Runs kept in a worker's table, and the longest run kept.
KEPT_RUNS = 600_000
KEPT_LENGTH = 48


def pieces_of(model: str) -> dict[str, float]:
    """Pieces that text may match, with their scores, from a vocabulary file."""
    from sentencepiece import SentencePieceProcessor

    held = SentencePieceProcessor(model_file=model)
    found = {}
    for i in range(held.vocab_size()):
        if not (held.is_control(i) or held.is_unknown(i) or held.is_byte(i) or held.is_unused(i)):
            found[held.id_to_piece(i)] = held.get_score(i)
    crossing = next((p for p in found if re.search(f"[^{MARK}]{MARK}", p)), None)
    if crossing is not None:
        raise ValueError(f"the piece {crossing!r} crosses a word boundary; runs can't be counted alone")
    return found


def run_families(pieces: dict[str, float]) -> list[list[str]]:
    """The characters of each family: two are of one if pieces hold them side by side."""
    family: dict[str, str] = {}

    def root(c: str) -> str:
        while family.setdefault(c, c) != c:
            family[c] = c = family[family[c]]
        return c

    for piece in pieces:
        for a, b in zip(piece, piece[1:]):
            if a != MARK and b != MARK:
                family[root(a)] = root(b)
    members: dict[str, list[str]] = {}
    for c in family:
        members.setdefault(root(c), []).append(c)
    joined = "".join(pieces)
    return [sorted(m) for m in members.values() if len(m) > 1 or m[0] * 2 in joined]


def run_pattern(pieces: dict[str, float]) -> re.Pattern:
    """Matches one run: marks, then characters of one family; a character without neighbours is a
    run alone."""
    classes = ["[" + "".join(map(re.escape, m)) + "]+" for m in run_families(pieces)]
    return re.compile(f"{MARK}*(?:{'|'.join([*sorted(classes, key=len, reverse=True), f'[^{MARK}]'])})|{MARK}+")


def count_run(run: str, rank: dict[str, float]) -> int:
    """Tokens of one run of symbols."""
    symbols: list[str | None] = list(run)
    n = len(symbols)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        pair = symbols[i] + symbols[i + 1]
        if pair in rank:
            heap.append((-rank[pair], i, pair))
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = after[i] if symbols[i] is not None else n
        if j >= n or symbols[i] + symbols[j] != pair:
            continue
        merges += 1
        symbols[i], symbols[j] = pair, None
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            right = pair + symbols[k]
            if right in rank:
                heapq.heappush(heap, (-rank[right], i, right))
        h = before[i]
        if h >= 0:
            left = symbols[h] + pair
            if left in rank:
                heapq.heappush(heap, (-rank[left], h, left))
    extra = sum(len(s.encode()) - 1 for s in symbols if s is not None and len(s) == 1 and s not in rank)
    return n - merges + extra


class Counts(dict):
    """Counts of runs, worked out on demand; holds a bounded number of short ones."""

    def __init__(self, model: str):
        super().__init__()
        self.rank = pieces_of(model)
        self.runs = run_pattern(self.rank).findall

    def __missing__(self, run: str) -> int:
        n = count_run(run, self.rank)
        if len(run) <= KEPT_LENGTH and len(self) < KEPT_RUNS:
            self[run] = n
        return n

    def of_text(self, text: str | None) -> int:
        if not text:
            return 0
        return sum(map(self.__getitem__, self.runs(MARK + text.replace(" ", MARK))))


@lru_cache(maxsize=2)
def counts_for(model: str) -> Counts:
    return Counts(model)


def count_tokens(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit`` for each row: UTF-8 length, tokens of the whole
    text, and whether they are more than ``limit``. Other columns are ignored."""
    id_type = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counts_for(model)
        for batch in batches:
            texts = batch.column(1)
            tokens = [counts.of_text(t.as_py()) for t in texts]
            n_bytes = [0 if x is None else x for x in pa.compute.binary_length(texts.cast(pa.large_binary())).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([t > limit for t in tokens], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    schema = f"`{id_col}` {id_type.simpleString()}, n_bytes long, n_tokens long, over_limit boolean"
    return docs.select(id_col, text_col).mapInArrow(run, schema)
