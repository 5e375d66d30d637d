"""Sampled segmentations of texts into pieces, distinct and with inclusion scores, and decoding.

A text is a lattice of the pieces of a vocabulary file; a path is a segmentation and its weight
the product of its pieces' probabilities, which fall with the piece's rank (Zipf), to the power
``sharpness``. The ``k`` paths with the largest Gumbel-perturbed log weights are a sample without
replacement. They are found by A-star search from the end of the text: a partial path stands for
all its completions, its perturbed value is the largest of theirs (the forward sum of the lattice
is the exact bound), and expanding it draws its children's values on condition that the largest
equals its own. So following the largest child completes a path without a step back, and its
siblings wait as candidates for the next path. Many texts are searched at once in numpy.

Each path comes with its log probability and its inclusion score
``log P(perturbed value > the k+1-th largest)``. All random numbers are hashes of (seed, row key,
place), so they depend on nothing else. No piece crosses runs (as in the token counts), so the
lattice of a text is a chain of small lattices, one for each distinct run.

Characters that are no piece are taken as their byte pieces. Decoding joins the pieces; it gives
the text back, but for U+2581, which stands for a space.

Defined cases: null and empty texts have one segmentation, without pieces; a text with fewer than
``k`` segmentations gives them all, with inclusion 0 (certain); rows that repeat a key and a text
draw alike; a null key draws as key 0, a key that is no whole number as its hash; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from shelfmark.llm.common import U64, mix, random_words, tidy
from shelfmark.llm.token_counts import MARK, pieces_of, run_families

#: Characters of the texts that are searched at once, about; a longer text goes alone.
GROUP_CHARS = 1 << 19
#: A task that has made lattices of more states than this goes on with the first quarter: frequent
#: runs are seen early.
MOST_STATES = 3 << 19


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


_PLACES = random_words(41, 64) | U64(1)

#: What the number of a draw is multiplied by.
_STEP = U64(0xD1B54A32D192ED03)

#: Size of the tables that say whether a string may begin a piece; false hits cost time only.
BEGUN_BITS = 18

#: The pieces of a length are found by so many high bits of their fingerprints.
BUCKET_BITS = 16

#: Kinds of characters besides the families: alone in a run, and the mark.
ALONE, MARKED = 0, 1


def fingerprints_of(strings: list[str], length: int) -> np.ndarray:
    """64-bit values of strings of ``length`` characters."""
    with np.errstate(over="ignore"):
        held = mix(codes_of("".join(strings)).astype(U64) + U64(1)).reshape(-1, length)
        return mix((held * _PLACES[:length]).sum(axis=1, dtype=U64))


class Vocabulary:
    """Pieces with log probabilities by rank, and byte pieces."""

    def __init__(self, model: str, sharpness: float = 1.0):
        from sentencepiece import SentencePieceProcessor

        held = SentencePieceProcessor(model_file=model)
        scores = pieces_of(model)
        families = run_families(scores)
        #: the kind of each character: ALONE, MARKED or the number of its family
        self.kind = np.full(0x110000, ALONE, np.min_scalar_type(len(families) + 2))
        for number, members in enumerate(families, 2):
            self.kind[codes_of("".join(members))] = number
        self.kind[ord(MARK)] = MARKED
        ranked = sorted(scores, key=lambda p: (-scores[p], held.piece_to_id(p)))
        total = math.log(sum(1 / (r + 3) for r in range(len(ranked))))
        self.log_p = {p: sharpness * (-math.log(r + 3) - total) for r, p in enumerate(ranked)}
        self.byte_p = sharpness * (-math.log(len(ranked) + 3) - total)
        self.byte_id = {b: held.piece_to_id(f"<0x{b:02X}>") for b in range(256)}
        self.longest = max(map(len, ranked))
        out = {held.piece_to_id(p): p.replace(MARK, " ").encode() for p in ranked} | {i: bytes([b]) for b, i in self.byte_id.items()}
        #: bytes of each identifier
        self.bytes = pa.array([out.get(i, b"") for i in range(max(out) + 1)], pa.large_binary())
        #: by length: sorted fingerprints of the pieces, where those with the same high bits begin,
        #: the most that have them, log probabilities and identifiers
        self.tables = []
        for length in range(1, self.longest + 1):
            held_pieces = [p for p in ranked if len(p) == length]
            hashes = fingerprints_of(held_pieces, length)
            order = np.argsort(hashes)
            first = np.searchsorted(hashes[order], np.arange(1 << BUCKET_BITS, dtype=U64) << U64(64 - BUCKET_BITS))
            most = int(np.diff(first, append=len(hashes)).max())
            self.tables.append((
                hashes[order], first.astype(np.int32), most, np.array([self.log_p[p] for p in held_pieces])[order], np.array([held.piece_to_id(p) for p in held_pieces], np.int64)[order]))
        #: by length: whether a longer piece may begin with a string, by the low bits of its fingerprint
        self.begun = []
        for length in range(1, self.longest + 1):
            may = np.zeros(1 << BEGUN_BITS, bool)
            heads = {p[:length] for p in ranked if len(p) > length}
            may[fingerprints_of(list(heads), length) & U64(len(may) - 1)] = True
            self.begun.append(may)

    def split(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The distinct runs in the order they appear, which of them each run of the texts is, and
        the n+1 offsets of the texts among these."""
        codes = codes_of("".join(MARK + t for t in texts if t))
        codes = np.where(codes == ord(" "), np.uint32(ord(MARK)), codes)
        bounds = np.cumsum([0, *(len(t) + 1 if t else 0 for t in texts)])
        kind = self.kind[codes]
        begins = np.ones(len(codes) + 1, bool)  # the last one is the end
        np.logical_and((kind[1:] != kind[:-1]) | (kind[1:] == ALONE), kind[:-1] != MARKED, out=begins[1:-1])
        begins[bounds] = True
        at = np.flatnonzero(begins)
        runs = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at * 4), pa.py_buffer(codes)]).dictionary_encode()
        _, offsets, data = runs.dictionary.buffers()
        offsets = np.frombuffer(offsets, np.int64)[: len(runs.dictionary) + 1] // 4 if len(runs.dictionary) else [0]
        spelled = data.to_pybytes().decode("utf-32-le", "surrogatepass") if data is not None else ""
        return [spelled[a:b] for a, b in pairwise(list(offsets))], runs.indices.to_numpy(), np.searchsorted(at, bounds)

    def decode(self, ids: np.ndarray) -> str:
        return self.decoded(ids, np.array([0, len(ids)]))[0]

    def decoded(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The text of each range of identifiers between two bounds."""
        if not len(ids):
            return [""] * (len(bounds) - 1)
        _, offsets, data = self.bytes.take(pa.array(ids)).buffers()
        ends = np.frombuffer(offsets, np.int64)[bounds].tolist()
        data = memoryview(data) if data is not None else b""
        return [str(data[a + (data[a : a + 1] == b" ") : b], "utf-8", "replace") for a, b in pairwise(ends)]


@lru_cache(maxsize=2)
def vocabulary_for(model: str, sharpness: float) -> Vocabulary:
    return Vocabulary(model, sharpness)


class Numbers(dict):
    """Numbers of runs in the order they appear."""

    def __missing__(self, run: str) -> int:
        self[run] = number = len(self)
        return number


class Lattices:
    """The lattices of the runs seen so far, each made once: a state for each place of a run, edges
    ordered by the state they end in (``low`` to ``high``), with start, log weight, the log sum of
    the paths through them, and their piece (a character that is no piece: its code, negative); and
    the log sums of the paths to each state."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.numbers = Numbers()
        self.room: dict[str, np.ndarray] = {}
        self.base = np.zeros(1, np.int64)
        self.low = self.high = self.start = self.piece = np.zeros(0, np.int32)
        self.weight = self.through = self.sums = np.zeros(0)

    def numbered(self, runs: list[str]) -> np.ndarray:
        """The numbers of the runs, whose lattices are then held."""
        known = len(self.numbers)
        found = np.fromiter(map(self.numbers.__getitem__, runs), np.int64, len(runs))
        if len(self.numbers) > known:
            self._add(list(islice(self.numbers, known, None)))
        return found

    def shorten(self, states: int) -> None:
        """Forget the runs after the first that have so many states together."""
        runs = int(np.searchsorted(self.base, states, "right")) - 1
        states = int(self.base[runs])
        edges = int(self.high[states - 1]) if states else 0
        self.numbers = Numbers(islice(self.numbers.items(), runs))
        self.base = self.base[: runs + 1]
        for name, size in (("low", states), ("high", states), ("sums", states), ("start", edges), ("piece", edges), ("weight", edges), ("through", edges)):
            setattr(self, name, getattr(self, name)[:size])

    def _add(self, runs: list[str]) -> None:
        vocabulary = self.vocabulary
        codes = codes_of("".join(runs))
        sizes = np.array([len(r) for r in runs], np.int64)
        ends = np.cumsum(sizes)
        base = np.concatenate([[0], np.cumsum(sizes + 1)]).astype(np.int64)
        of = np.repeat(np.arange(len(runs)), sizes)
        state = np.arange(len(codes)) + of  # the state before each character
        room = ends[of] - np.arange(len(codes)) if len(runs) else np.zeros(0, np.int64)
        n = int(base[-1])
        parts, counted = [], np.zeros(n, np.int32)
        # the starts that some piece of this length or more may fit, with the sums of their fingerprints
        with np.errstate(over="ignore"):
            held = mix(codes.astype(U64) + U64(1))
        begun, partial = np.arange(len(codes)), np.zeros(len(codes), U64)
        for length, (hashes, first, most, log_p, ids) in enumerate(vocabulary.tables, 1):
            if length > 1:
                go_on = np.flatnonzero((room[begun] >= length) & vocabulary.begun[length - 2][mine & U64((1 << BEGUN_BITS) - 1)])
                begun, partial = begun[go_on], partial[go_on]
            if not len(begun):
                break
            with np.errstate(over="ignore"):
                partial = partial + held[begun + (length - 1)] * _PLACES[length - 1]
            mine = mix(partial)
            if not len(hashes):
                continue
            at = begun
            slot = first[mine >> U64(64 - BUCKET_BITS)]
            for _ in range(most):
                slot = np.minimum(slot, len(hashes) - 1)
                slot += hashes[slot] < mine
            slot = np.minimum(slot, len(hashes) - 1)
            known = hashes[slot] == mine
            if length == 1:
                code = codes[at].astype(np.int64)
                n_bytes = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
                weight, piece = np.where(known, log_p[slot], vocabulary.byte_p * n_bytes), np.where(known, ids[slot], -code - 1)
            else:
                at, slot = at[known], slot[known]
                weight, piece = log_p[slot], ids[slot]
            start = state[at]
            stop = start + length
            # of one length, one edge at most ends in a state: it comes after the shorter ones there
            parts.append((start, stop, counted[stop], weight, piece))
            counted[stop] += 1
        high = np.cumsum(counted)
        low = high - counted
        start, weight, piece = (np.empty(int(counted.sum()), kind) for kind in (np.int64, np.float64, np.int32))
        for starts, stops, before, weights, pieces in parts:
            edge = low[stops] + before
            start[edge], weight[edge], piece[edge] = starts, weights, pieces
        sums = np.zeros(n)
        longest_first = np.argsort(-sizes, kind="stable")
        held = sizes[longest_first]
        for place in range(1, int(sizes.max(initial=0)) + 1):
            here = base[longest_first[: np.searchsorted(-held, -place, "right")]] + place
            counts = high[here] - low[here]
            begin = np.cumsum(counts) - counts
            group = np.repeat(np.arange(len(here)), counts)
            edge = low[here][group] + np.arange(len(group)) - begin[group]
            terms = sums[start[edge]] + weight[edge]
            top = np.maximum.reduceat(terms, begin)
            sums[here] = top + np.log(np.add.reduceat(np.exp(terms - top[group]), begin))
        states, edges = self.base[-1], len(self.start)
        for name, more in (
            ("base", base[1:] + states), ("low", low + edges), ("high", high + edges), ("start", start + states), ("piece", piece),
            ("weight", weight), ("through", sums[start] + weight), ("sums", sums),
        ):
            self._append(name, more)

    def _append(self, name: str, more: np.ndarray) -> None:
        """Add to an array in place; its room doubles when it is used up."""
        held, room = getattr(self, name), self.room.get(name)
        size = len(held) + len(more)
        if room is None or size > len(room):
            self.room[name] = room = np.empty(max(size, 2 * len(held)), held.dtype)
            room[: len(held)] = held
        room[len(held) : size] = more
        setattr(self, name, room[:size])


def smallest_of(values: np.ndarray, bounds: np.ndarray, rank: int) -> np.ndarray:
    """The ``rank``-th smallest value of each range between two bounds, infinite if it has fewer."""
    out, sizes = np.full(len(bounds) - 1, np.inf), np.diff(bounds)
    some = np.flatnonzero(sizes >= rank)
    held = values[np.repeat(sizes >= rank, sizes)]
    sizes = sizes[some]
    begin = np.cumsum(sizes) - sizes
    for left in range(rank if len(some) else 0, 0, -1):
        least = np.minimum.reduceat(held, begin)
        if left == 1:
            out[some] = least
        else:
            hit = np.flatnonzero(held == np.repeat(least, sizes))
            held[hit[np.unique(np.searchsorted(begin, hit, "right"), return_index=True)[1]]] = np.inf
    return out


class Search:
    """The search over a group of texts."""

    def __init__(self, lattices: Lattices, texts: list[str], keys: np.ndarray):
        vocabulary = lattices.vocabulary
        self.byte_id = np.array([vocabulary.byte_id[b] for b in range(256)], np.int64)
        runs, which, self.first = vocabulary.split(texts)
        self.run = lattices.numbered(runs)[which]
        for name in ("base", "low", "high", "start", "piece", "weight", "through", "sums"):
            setattr(self, name, getattr(lattices, name))
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.total = self.sums[self.base[self.run + 1] - 1] if len(self.run) else np.zeros(0)
        #: log sum of all runs of the text before this one
        before = np.cumsum(self.total) - self.total
        self.before = before - (before[self.first[self.text]] if len(before) else 0)
        self.whole = np.bincount(self.text, self.total, len(texts))
        self.place = np.arange(len(self.run)) - self.first[self.text]
        with np.errstate(over="ignore"):
            self.key = mix(keys.astype(np.int64).view(U64) + U64(0x51ED27))

    def pieces(self, path: np.ndarray) -> np.ndarray:
        """Identifiers of a path; characters that are no piece become their byte pieces."""
        return self.spelled(path, np.zeros(1, np.int64))[0]

    def spelled(self, path: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Identifiers of paths end to end, and where the bounds between the paths lie among them."""
        found = self.piece[path]
        unknown = np.flatnonzero(found < 0)
        if not len(unknown):
            return found, bounds
        codes, which = np.unique(found[unknown], return_inverse=True)
        in_bytes = [chr(-c - 1).encode("utf-8", "surrogatepass") for c in codes.tolist()]
        times = np.ones(len(found), np.int64)
        times[unknown] = np.array([len(x) for x in in_bytes])[which]
        out = np.repeat(found, times)
        out[out < 0] = self.byte_id[np.frombuffer(b"".join([in_bytes[i] for i in which.tolist()]), np.uint8)]
        return out, np.append(0, np.cumsum(times))[bounds]

    def _seeds(self, text: np.ndarray, place: np.ndarray, path: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix(self.key[text] + mix(place.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(path + 1)))

    def _seeds_of_runs(self, owner: np.ndarray, path: int) -> np.ndarray:
        """What the edges of runs draw by, less their numbers in all lattices times ``_STEP``: they
        are numbered within the run, from the first state's."""
        bottom = self.low[self.base[self.run[owner]]].astype(U64)
        return self._seeds(self.text[owner], self.place[owner], path) - bottom * _STEP

    @staticmethod
    def _gumbel(h: np.ndarray) -> np.ndarray:
        """A draw for each number, in place: these arrays are the largest of the search."""
        h ^= h >> U64(30)  # as common.mix
        h *= U64(0xBF58476D1CE4E5B9)
        h ^= h >> U64(27)
        h *= U64(0x94D049BB133111EB)
        h ^= h >> U64(31)
        h >>= U64(12)
        x = h.astype(np.float64)
        x += 0.5
        x /= float(1 << 52)
        for _ in range(2):
            np.log(x, out=x)
            np.negative(x, out=x)
        return x

    def roots(self) -> np.ndarray:
        """The perturbed value of each whole text: that of its first path."""
        n = len(self.whole)
        return self.whole + self._gumbel(self._seeds(np.arange(n), np.full(n, 1 << 40), 0))

    def complete(self, occurrence: np.ndarray, state: np.ndarray, value: np.ndarray, decided: np.ndarray, path: int, k: int) -> tuple:
        """Draw the rest of paths. ``occurrence, state``: runs to walk back through and where in
        their lattices; several runs of a text may be given, ``decided`` then counts only the
        weight after the last of them (by text). Returns where each run's chosen edges end, these
        edges from the start of the texts, and the siblings (occurrence, edge, perturbed value,
        step) that may be among a text's first ``k + 1``."""
        owner, at = occurrence, state
        inner = np.zeros(len(owner))
        own, drawn_of = np.zeros(len(self.run)), np.zeros(len(self.run), np.int64)
        seeds = self._seeds_of_runs(owner, path)
        steps = []
        while True:
            low = self.low[at]
            counts = self.high[at] - low
            # those with most edges first, so that those with a j-th edge are the first ones; a finished run has none
            most = int(counts.max(initial=0))
            if not most:
                break
            with_more = len(counts) - np.cumsum(np.bincount(counts))
            order = np.argsort((most - counts).astype(np.min_scalar_type(most)), kind="stable")[: with_more[0]]
            owner, low, inner, seeds = owner[order], low[order].astype(np.int64), inner[order], seeds[order]
            first = seeds + low.astype(U64) * _STEP
            top = self._gumbel(first.copy())
            top += self.through[low]
            second, taken, more = np.full(len(low), -np.inf), low.copy(), np.zeros(1, U64)
            for j, n in enumerate(with_more[1:most].tolist(), 1):
                drawn = self._gumbel(first[:n] + (more := more + _STEP))
                edge = low[:n] + j
                drawn += self.through[edge]
                np.copyto(taken[:n], edge, where=drawn > top[:n])
                np.maximum(second[:n], np.minimum(top[:n], drawn), out=second[:n])
                np.maximum(top[:n], drawn, out=top[:n])
            weight = self.weight[taken]
            steps.append((owner, low, top, second, inner, taken))
            own[owner] += weight
            drawn_of[owner] += 1
            inner = inner + weight
            at = self.start[taken]
        ends = np.cumsum(drawn_of)
        if not steps:
            return ends, np.zeros(0, np.int64), [np.zeros(0, np.int64)] * 4
        step = np.repeat(np.arange(len(steps)), [len(x[0]) for x in steps])
        owner, low, top, second, inner, taken = map(np.concatenate, zip(*steps))
        place = ends[owner] - 1 - step  # the last drawn comes first
        edges, ordered = np.empty(len(place), np.int64), np.empty(len(place))
        edges[place] = taken
        # weight decided after each run: what is drawn for the later runs of the same text
        running = np.cumsum(own)
        after = running[self.first[1:][self.text] - 1] - running
        least = value[self.text[owner]] - ((self.before + after + decided[self.text])[owner] + inner)
        # A sibling drawn at g takes -log(e^-goal + e^-g - e^-top), all shifted alike: the smaller the
        # difference e^-g - e^-top (here in units of e^-goal), the earlier it comes. The first of a
        # step is the second of its draws.
        with np.errstate(over="ignore", invalid="ignore"):
            behind = np.exp(least - second)
            behind -= np.exp(least - top)
            np.nan_to_num(behind, copy=False, nan=np.inf)
            ordered[place] = behind
            # those that k + 1 others of their text precede for certain are left out, with room for rounding
            reach = smallest_of(ordered, np.append(0, ends)[self.first], k + 1) * (1 + 1e-6) + 1e-9
        hold = np.flatnonzero(behind <= reach[self.text][owner])
        counts = self.high[np.searchsorted(self.low, low[hold].astype(np.int32), "right") - 1] - low[hold]
        of = np.repeat(hold, counts)
        edge = low[of] + np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
        other = np.flatnonzero(edge != taken[of])
        of, edge = of[other], edge[other]
        mine = owner[of]
        g = self.through[edge] + self._gumbel(self._seeds_of_runs(mine, path) + edge.astype(U64) * _STEP)
        goal = value[self.text[mine]]
        v = least[of] - g + np.log1p(-np.exp(np.minimum(g - top[of], -1e-12)))
        return ends, edges, [mine, edge, goal - np.maximum(v, 0) - np.log1p(np.exp(-np.abs(v))), step[of]]

    def paths(self, k: int) -> list[list[tuple[float, float, np.ndarray]]]:
        """For each text its paths in order: perturbed value, log weight, edges from the start of
        the text; and last, the value of the k+1-th (minus infinity if there is none)."""
        n = len(self.whole)
        value = self.roots()
        every = np.arange(len(self.run))
        *chosen, siblings = self.complete(every, self.base[self.run + 1] - 1, value, np.zeros(n), 0, k)
        found: list[list] = [[] for _ in range(n)]
        waiting: list[list] = [[] for _ in range(n)]
        self._settle(found, waiting, chosen, siblings, value, [None] * n, k)
        for path in range(1, k + 1):
            heads = [max(w, key=lambda x: x[0]) if w else None for w in waiting]
            for t, head in enumerate(heads):
                if head is None and len(found[t]) == path:
                    found[t].append((-math.inf, 0.0, None))
                elif head is not None:
                    waiting[t].remove(head)
            if path == k:
                for t, head in enumerate(heads):
                    if head is not None and len(found[t]) == k:
                        found[t].append((head[0], 0.0, None))
                break
            value = np.array([-math.inf if h is None else h[0] for h in heads])
            decided, occurrence, state = np.zeros(n), [], []
            for t, head in enumerate(heads):
                if head is not None:
                    _, at, edge, owner_edges = head
                    # the runs before this one are drawn anew; this one from the sibling's start
                    earlier = np.arange(self.first[t], at)
                    occurrence.append(np.append(earlier, at))
                    state.append(np.append(self.base[self.run[earlier] + 1] - 1, self.start[edge]))
                    decided[t] = self.weight[owner_edges].sum()
            if occurrence:
                *chosen, siblings = self.complete(np.concatenate(occurrence), np.concatenate(state), value, decided, path, k)
                self._settle(found, waiting, chosen, siblings, value, heads, k)
        return found

    def _settle(self, found: list, waiting: list, chosen: list, siblings: list, value: np.ndarray, heads: list, k: int) -> None:
        """Add the drawn paths, and the siblings that may still be among the first ``k + 1``."""
        ends, edges = chosen
        bounds = np.concatenate([[0], ends])
        path_of: list = [None] * len(self.whole)
        for t in range(len(self.whole)):
            if value[t] == -math.inf:
                continue
            tail = heads[t][3] if heads[t] is not None else np.zeros(0, np.int64)
            drawn = edges[bounds[self.first[t]] : bounds[self.first[t + 1]]]
            path_of[t] = (bounds[self.first[t]], drawn, tail)
            path = np.concatenate([drawn, tail]).astype(np.int64)
            found[t].append((float(value[t]), float(self.weight[path].sum()), path))
        at, edge, g, step = siblings
        if not len(at):
            return
        order = np.lexsort((-g, self.text[at]))
        texts = self.text[at][order]
        rank = np.arange(len(order)) - np.searchsorted(texts, texts)
        for i in order[rank <= k]:
            t = int(self.text[at[i]])
            begin, drawn, tail = path_of[t]
            # what stays of the path: all runs after this one, and this run's pieces after the branch
            b = int(ends[at[i]] - begin)
            kept = np.concatenate([[edge[i]], drawn[b - int(step[i]) : b], drawn[b:], tail]).astype(np.int64)
            waiting[t].append((float(g[i]), int(at[i]), int(edge[i]), kept))
        for t in set(texts.tolist()):
            waiting[t] = sorted(waiting[t], key=lambda x: -x[0])[: k + 1]


def sample_segmentations(
    docs: DataFrame, model: str, *, k: int = 2, sharpness: float = 1.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``doc_id, sample, ids, n_pieces, log_p, inclusion, decoded`` for each text and sample (from 1)."""
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_for(model, sharpness)
        lattices = Lattices(vocabulary)
        for batch in batches:
            texts = [x or "" for x in batch.column(2).to_pylist()]
            keys = batch.column(1).fill_null(0).to_numpy()
            ids = batch.column(0)
            ends = np.cumsum([len(t) for t in texts])
            a = 0
            while a < len(texts):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + GROUP_CHARS, "right")))
                if lattices.base[-1] > MOST_STATES:
                    lattices.shorten(MOST_STATES // 4)
                yield _group(lattices, ids[a:b], keys[a:b] * 1_000_003 + seed, texts[a:b], k)
                a = b

    id_type = docs.schema[id_col].dataType
    schema = f"doc_id {id_type.simpleString()}, sample int, ids array<int>, n_pieces long, log_p double, inclusion double, decoded string"
    # a number is its own key, any other id is hashed to one
    key = F.col(id_col).cast("long") if isinstance(id_type, IntegralType) else F.xxhash64(id_col)

    def _group(lattices: Lattices, names: pa.Array, keys: np.ndarray, texts: list[str], k: int) -> pa.RecordBatch:
        search = Search(lattices, texts, keys)
        out, walked = [], []
        for row, (found, whole) in enumerate(zip(search.paths(k), search.whole)):
            *paths, last = found if len(found) > 1 or found[0][2] is None else [*found, (-math.inf, 0.0, None)]
            for number, (_, weight, path) in enumerate([p for p in paths if p[2] is not None], 1):
                log_p = weight - float(whole)
                include = 0.0 if last[0] == -math.inf else math.log(-math.expm1(-math.exp(min(weight - last[0], 50.0))) or 5e-324)
                out.append((row, number, log_p, include))
                walked.append(path)
        rows, numbers, log_p, inclusion = zip(*out) if out else [()] * 4
        pieces, spans = search.spelled(np.concatenate([np.zeros(0, np.int64), *walked]), np.cumsum([0, *map(len, walked)]))
        columns = {
            "doc_id": names.take(pa.array(rows, pa.int64())), "sample": pa.array(numbers, pa.int32()),
            "ids": pa.ListArray.from_arrays(spans.astype(np.int32), pieces.astype(np.int32)), "n_pieces": pa.array(np.diff(spans)),
            "log_p": pa.array(log_p, pa.float64()), "inclusion": pa.array(inclusion, pa.float64()),
            "decoded": pa.array(lattices.vocabulary.decoded(pieces, spans), pa.string())}
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    key = F.when(F.col(id_col).isNull(), F.lit(0)).otherwise(key)
    return docs.select(F.col(id_col), key.alias("__key"), F.col(text_col)).mapInArrow(run, schema)


def digests(samples: DataFrame) -> DataFrame:
    """The samples without their long columns: hashes of the identifiers and of the decoded text."""
    return samples.select(
        "doc_id", "sample", "n_pieces", "log_p", "inclusion", F.xxhash64("ids").alias("ids_hash"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
