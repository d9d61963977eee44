import random
import re

import numpy as np
import pyarrow as pa
import pytest

from bazaar.llm._tokens import NONSPACE, WORD, Words, add_at, slices, windows
from bazaar.llm.suffix_dedup import minimisers

PATTERN = {NONSPACE: r"[^\x20\x09-\x0D]+", WORD: r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"}
LOWER = {i: i + 32 for i in range(65, 91)}


def some_texts():
    rng = random.Random(1)
    alphabet = "aAzZ09 \t\n.-_é漢🙂\x00\x1f\x85"
    return [None, "", " ", "a", "É é", *("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
                                         for _ in range(300))]


@pytest.mark.parametrize("kind", [NONSPACE, WORD])
@pytest.mark.parametrize("cut", [1, 100, 1 << 20])
def test_words_are_those_of_the_pattern(kind, cut):
    texts, words, seen, at_row = some_texts(), Words(kind), {}, 0
    for lo, hi, data, offs in slices(pa.array(texts), cut):
        assert lo == at_row
        at_row = hi
        h, at = words.hashes(data, offs)
        for k, text in enumerate(texts[lo:hi]):
            want = re.findall(PATTERN[kind], (text or "").translate(LOWER))
            got = h[at[k]:at[k + 1]].tolist()
            assert len(got) == len(want)
            for w, x in zip(want, got):
                assert seen.setdefault(w, x) == x
    assert at_row == len(texts)
    assert len(set(seen.values())) == len(seen)


def test_sliced_arrays_and_nulls():
    a = pa.array(["skip", None, "b c", "d"]).slice(1)
    (_, _, data, offs), = slices(a)
    assert np.diff(Words(NONSPACE).hashes(data, offs)[1]).tolist() == [0, 2, 1]


def test_windows_and_sums():
    h = np.arange(1, 12, dtype=np.uint64)
    at = np.array([0, 0, 3, 4, 11])
    w, wa = windows(h, at, 3)
    assert np.diff(wa).tolist() == [0, 1, 1, 5]
    assert len(set(w.tolist())) == 7
    again, _ = windows(h[4:], np.array([0, 7]), 3)
    assert again.tolist() == w[2:].tolist()
    assert add_at(h, at).tolist() == [0, 6, 4, 56]


def test_minimisers_cover_every_window():
    rng = np.random.default_rng(3)
    g = rng.integers(0, 50, 400).astype(np.uint64)
    at = np.array([0, 5, 5, 200, 400])
    m = minimisers(g, at, 10)
    for a, b in zip(at[:-1], at[1:]):
        for s in range(a, max(a, b - 9)):
            assert any(s <= p < s + 10 and g[p] == g[s:s + 10].min() for p in m)
    assert int(g[:5].argmin()) in m
    run = minimisers(np.tile(np.array([7, 3], np.uint64), 500), np.array([0, 1000]), 10)
    assert len(run) <= 130
