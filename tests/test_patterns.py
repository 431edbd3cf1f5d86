"""Many patterns over many texts against a plain model."""

import random
import re

import pytest

from parley.functions import patterns
from parley.functions.patterns import Patterns, like_segments


def marks(pattern):
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(("", pattern[i]))
        else:
            out.append((c, "") if c in "%_" else ("", c))
        i += 1
    return out


def fits(wanted, text):
    """Places a prefix of the pattern can end at, mark by mark."""
    at = {0}
    for kind, c in wanted:
        if kind == "%":
            at = set(range(min(at), len(text) + 1)) if at else at
        else:
            at = {x + 1 for x in at if x < len(text) and (kind == "_" or text[x] == c)}
    return len(text) in at


@pytest.mark.parametrize("seed", range(12))
def test_same_pairs_as_the_model(monkeypatch, seed):
    rng = random.Random(seed)
    monkeypatch.setattr(patterns, "_AT_ONCE", rng.choice([64, 1000, 1 << 21]))
    monkeypatch.setattr(patterns, "RUN", rng.choice([2, 4, 16]))
    letters = rng.choice(["ab", "abc ", "ab\u00e9\U0001f600 \n\0", "a", "abcdefgh"])
    text = lambda of, n: "".join(rng.choice(of) for _ in range(rng.randrange(n)))
    texts = [text(letters, rng.choice([3, 30, 60])) for _ in range(rng.randrange(1, 70))]
    wanted = [re.sub(r"\\([^%_\\])", r"\1", f"%{text(letters + '%_%' + chr(92), rng.choice([3, 9, 25]))}%") for _ in range(rng.randrange(1, 40))]
    found = [*zip(*(x.tolist() for x in Patterns([like_segments(p) for p in wanted]).find(texts)), strict=True)]
    assert len(found) == len(set(found))
    assert set(found) == {(i, j) for i, p in enumerate(wanted) for m in [marks(p)] for j, x in enumerate(texts) if fits(m, x)}


def test_pieces_that_stand_nowhere():
    assert [x.tolist() for x in Patterns([like_segments(p) for p in ("%q_q%", "%q%a%", "%" + "long" * 9 + "%")]).find(["abc", ""])] == [[], []]
