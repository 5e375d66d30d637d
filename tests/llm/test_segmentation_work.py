"""What a search of segmentations does for many occurrences of few runs, and that it is the plain search."""

import math

import numpy as np
import pytest

from shelfmark.llm import segmentations
from shelfmark.llm.settings import PIECES
from shelfmark.llm.token_counts import MARK, pieces_of, run_pattern

ODD = [
    "", " ", "  ", "a", "a  b", " a ", f"{MARK}", f"a{MARK}b {MARK} c", "\n\n x\ty", "\U0001f600\U0001f600 x", "中文字符没有空格" * 5, "x" * 40,
    "\x00\x01 �​", "%%%***   \n ", "éé", "of the\nof the", "",
]


def search(texts, sharpness=1.0):
    return segmentations.Search(segmentations.Lattices(segmentations.vocabulary_for(PIECES, sharpness)), texts, np.arange(len(texts)) * 7 + 1)


def test_only_distinct_runs_are_looked_up(monkeypatch):
    asked, numbered = [], segmentations.Lattices.numbered

    def counted(self, runs):
        asked.extend(run for held in runs for run in ([held] if isinstance(held, str) else held))
        return numbered(self, runs)

    monkeypatch.setattr(segmentations.Lattices, "numbered", counted)
    found = search(["of the " * 5000, "the end", ""])
    assert len(found.run) > 10_000 and len(asked) < 10


def test_texts_split_into_the_runs_of_the_pattern():
    vocabulary, findall = segmentations.vocabulary_for(PIECES, 1.0), run_pattern(pieces_of(PIECES)).findall
    for texts in (ODD, ODD[::-1], [""], [], ["a", ""], ["\ud800 x"]):
        runs, which, bounds = vocabulary.split(texts)
        assert len(runs) == len(set(runs))
        got = [[runs[i] for i in which[a:b]] for a, b in zip(bounds, bounds[1:])]
        assert got == [findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]


def plain(found, t, goal, tail, decided, at, state, path):
    """The rest of a path drawn edge by edge from run ``at`` of text ``t``, and all its siblings."""
    drawn, weight, siblings = [], decided, []
    for i in range(at, found.first[t] - 1, -1):
        base = int(found.base[found.run[i]])
        s, inner = (state if i == at and state is not None else int(found.base[found.run[i] + 1]) - 1), 0.0
        seed = found._seeds(np.array([t]), np.array([i - found.first[t]]), path)
        while s > base:
            edges = np.arange(found.low[s], found.high[s])
            with np.errstate(over="ignore"):
                h = seed + (edges - int(found.low[base])).astype(np.uint64) * segmentations._STEP
            g = found.through[edges] + found._gumbel(h)
            best = int(np.argmax(g))
            shift = found.before[i] + weight + inner
            for e, x in zip(edges, g):
                if e != edges[best]:
                    v = goal - shift - x + math.log1p(-math.exp(min(x - g[best], -1e-12)))
                    siblings.append((goal - max(v, 0) - math.log1p(math.exp(-abs(v))), i, int(e), [int(e), *drawn, *tail], weight + inner + found.weight[e]))
            inner += found.weight[edges[best]]
            drawn.insert(0, int(edges[best]))
            s = int(found.start[edges[best]])
        weight += inner
    return [*drawn, *tail], siblings


@pytest.mark.parametrize("k, sharpness", [(1, 1.0), (2, 1.0), (4, 0.3)])
def test_paths_are_those_of_the_plain_search(k, sharpness):
    texts = [*ODD, "Thinenat of the anoneati, ended. " * 4, "the of"]
    found = search(texts, sharpness)
    goals, got = found.roots(), found.paths(k)
    for t in range(len(texts)):
        path, waiting = plain(found, t, goals[t], [], 0.0, found.first[t + 1] - 1, None, 0)
        expected = [(goals[t], path)]
        for number in range(1, k + 1):
            if not waiting:
                break
            head = max(waiting)
            waiting.remove(head)
            value, at, edge, kept, weight = head
            if number == k:
                expected.append((value, None))
                break
            path, more = plain(found, t, value, kept, weight, at, int(found.start[edge]), number)
            expected.append((value, path))
            waiting += more
        for (value, weight, path), (goal, edges) in zip(got[t], expected):
            assert value == pytest.approx(goal, abs=1e-7)
            if path is not None:
                assert path.tolist() == edges and weight == pytest.approx(found.weight[edges].sum())
        assert len([p for p in got[t] if p[0] > -math.inf]) == len(expected)
