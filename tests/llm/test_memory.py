"""Memory that a Python worker takes for a run of texts."""

import tracemalloc

import numpy as np
import pyarrow as pa

from bazaar.llm._tokens import NONSPACE, RUN, Words, slices
from bazaar.llm.language_id import letter_codes, text_grams


def peak(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def texts():
    words = np.random.default_rng(3).integers(97, 123, (2000, 999)).astype(np.uint8)
    words[:, ::6] = 32
    return [bytes(w).decode() for w in words]


def test_language_grams_of_a_run():
    codes, column = letter_codes(), pa.array(texts())

    def run():
        for _, _, data, offs in slices(column):
            text_grams(codes, data, offs)
    assert peak(run) < 32 << 20  # 47 MiB with runs of 1 MB and the position of every letter


def test_words_of_a_run():
    column = pa.array(texts())

    def run():
        words = Words(NONSPACE)
        for _, _, data, offs in slices(column):
            words.hashes(data, offs)
    assert peak(run) < 24 << 20  # 36 MiB with runs of 1 MB


def test_runs_hold_whole_texts():
    column = pa.array(["a" * RUN, None, "b" * 10, "c" * (RUN + 5), "d"])
    assert [(lo, hi, len(data)) for lo, hi, data, _ in slices(column)] == [
        (0, 2, RUN), (2, 3, 10), (3, 4, RUN + 5), (4, 5, 1)]


def test_grams_of_short_and_empty_texts():
    column = ["ab", "", "c", "12", "de fgh", "é𝒳z"]
    codes = letter_codes()
    data = np.frombuffer("".join(column).encode(), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(t.encode()) for t in column])])
    key, at, some = text_grams(codes, data, offs)
    alone = [text_grams(codes, np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0] for t in column]
    assert some.tolist() == [True, False, True, False, True, True]
    for i, one in enumerate(alone):
        assert key[at[i]:at[i + 1]].tolist() == one.tolist()
    want = [ord("a"), ord("a") << 16 | ord("b"), ord("a") << 32 | ord("b") << 16]
    assert key[at[0]:at[1]].tolist() == want
