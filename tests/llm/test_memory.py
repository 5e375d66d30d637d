"""What tasks hold: memory of Python workers between tasks, lattices within a task."""

import re
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

from shelfmark.llm import segmentations
from shelfmark.llm.settings import PIECES

HELD = """
import re
import numpy as np
from shelfmark.llm import common

def mb():
    return int(re.search(r"VmRSS:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024

def run(batches):
    for batch in batches:
        held = [np.ones(2000) for _ in range(15000)]  # 240 MB in blocks that the heap holds
        pins.append(np.ones(2000))  # the heap can't shrink below this one
        yield batch

pins = []
at_first = mb()
assert list(common.tidy(run)([1, 2])) == [1, 2]
print(mb() - at_first)
"""


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
def test_tasks_give_freed_memory_back():
    root = Path(__file__).resolve().parents[2]
    out = subprocess.run([sys.executable, "-c", HELD], cwd=root, capture_output=True, text=True, check=True).stdout
    assert float(out) < 60


def test_all_near_duplicate_and_segmentation_tasks_are_tidy():
    for name in ("near_dups", "segmentations"):
        source = (Path(segmentations.__file__).parent / f"{name}.py").read_text()
        assert len(re.findall(r"@tidy\n    def run\(", source)) == len(re.findall(r"\bdef run\(", source)) > 0


def searched(lattices, texts):
    search = segmentations.Search(lattices, texts, np.arange(len(texts)))
    return [[(value, weight, None if path is None else search.pieces(path).tolist()) for value, weight, path in found] for found in search.paths(2)]


def test_lattices_are_shortened_and_not_made_anew():
    vocabulary = segmentations.vocabulary_for(PIECES, 1.0)
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("aehinorsté中"), rng.integers(1, 12))) for _ in range(400)]
    groups = [[" ".join(rng.choice(words[:100] if n == 0 else words, 60)) for _ in range(20)] + ["", "\U0001f600 x"] for n in range(4)]
    held = segmentations.Lattices(vocabulary)
    for n, texts in enumerate(groups):
        expected = searched(segmentations.Lattices(vocabulary), texts)
        assert searched(held, texts) == expected
        if n == 0:
            first = dict(held.numbers)
            states = int(held.base[-1])
        held.shorten(states)  # all of the first group stay, later ones go
        assert dict(held.numbers) == first and held.base[-1] == len(held.low) == len(held.sums) == states
        assert len(held.start) == len(held.through) == held.high[-1]
    held.shorten(0)
    assert not held.numbers and len(held.base) == 1 and not len(held.start)
    assert searched(held, groups[1]) == searched(segmentations.Lattices(vocabulary), groups[1])
