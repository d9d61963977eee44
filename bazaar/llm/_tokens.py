"""Words of Arrow text columns as 64-bit hashes: numpy over the UTF-8 bytes.

Both word patterns used here (``[^\\x20\\x09-\\x0D]+`` and
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``) are classes of ASCII bytes, so a word
is a run of bytes and no decoding is needed. A-Z are lower-cased first. The
hash is a polynomial modulo 2^64, taken from one running sum over the bytes,
then mixed; equal words always agree, and different ones agree with a chance
of about 2^-64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_INV = pow(_BASE, -1, 1 << 64)

#: Bytes of text that numpy takes at once: its temporary arrays are some tens of bytes for each.
RUN = 1 << 19

WORD = "word"          # digits, letters a-z (after lower-casing) and everything beyond ASCII
NONSPACE = "nonspace"  # anything but ASCII white space
LETTERS = "letters"    # letters a-z and everything beyond ASCII


def small_batches(spark) -> None:
    """Whole texts go to Python in Arrow batches of about 1,000 rows or 4 MB instead
    of 10,000 or 64 MB: buffers on both sides stay small beside an executor's memory.
    A session setting, because plans read it when they run; smaller ones stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1000),
                      ("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)):
        now = spark.conf.get(key)
        if not now.isdigit() or not 0 < int(now) <= most:  # other spellings ("64MB") are larger defaults
            spark.conf.set(key, str(most))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of uint64 (a copy; wraps modulo 2^64)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def slices(column: pa.Array, max_bytes: int = RUN):
    """Cut a string column into runs of whole texts of about ``max_bytes`` (one
    longer text is a run of its own): (first row, end row, bytes, offsets).
    NULL counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    buffers = column.buffers()
    offs = np.frombuffer(buffers[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + max_bytes, "right")) - 1)
        yield lo, hi, data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
        lo = hi


class Words:
    """Hashes words of one kind; keeps the tables of powers between calls.
    Without ``fold`` words that differ in case are different."""

    def __init__(self, kind: str, fold: bool = True):
        b = np.arange(256)
        low = np.where((b >= 65) & (b <= 90), b + 32, b).astype(np.uint8)
        self.lower = low if fold else b.astype(np.uint8)
        if kind == WORD:
            self.inside = ((low >= 48) & (low <= 57)) | ((low >= 97) & (low <= 122)) | (low >= 128)
        elif kind == LETTERS:
            self.inside = ((low >= 97) & (low <= 122)) | (low >= 128)
        else:
            self.inside = ~((b == 32) | ((b >= 9) & (b <= 13)))
        self.pw = self.inv = np.ones(1, U64)

    def _powers(self, n: int) -> None:
        if len(self.pw) < n:
            for name, base in (("pw", _BASE), ("inv", _INV)):
                a = np.full(max(n, RUN + 1), base, U64)
                a[0] = 1
                setattr(self, name, np.cumprod(a))

    def spans(self, data: np.ndarray, offs: np.ndarray):
        """(start, end) byte of every word and the words before each text."""
        n = len(data)
        if not n:
            z = np.zeros(0, np.int64)
            return z, z, np.zeros(len(offs), np.int64)
        inside = self.inside[data]
        cut = offs[(offs > 0) & (offs < n)]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        first[cut] = inside[cut]
        last[:-1] &= ~inside[1:]
        last[cut - 1] = inside[cut - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        return starts, ends, np.searchsorted(starts, offs)

    def hashes(self, data: np.ndarray, offs: np.ndarray):
        """Hash of every word, and the words before each text."""
        starts, ends, at = self.spans(data, offs)
        if not len(starts):
            return np.zeros(0, U64), at
        return self.of_spans(self.running(data), starts, ends), at

    def running(self, data: np.ndarray) -> np.ndarray:
        """Running sums over the bytes, from which the hash of any span follows."""
        self._powers(len(data) + 1)
        run = np.zeros(len(data) + 1, U64)
        np.cumsum((self.lower[data].astype(U64) + U64(1)) * self.pw[:len(data)], out=run[1:])
        return run

    def of_spans(self, run: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of the bytes from each start to its end."""
        h = (run[ends] - run[starts]) * self.inv[starts]
        return mix64(h + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def windows(h: np.ndarray, at: np.ndarray, size: int):
    """Hash of every run of ``size`` words inside one text (a shorter text that
    has words is one run), and the runs before each text."""
    n = np.diff(at)
    short = (n > 0) & (n < size)
    runs = np.where(short, 1, np.maximum(n - size + 1, 0))
    out_at = np.concatenate([[0], np.cumsum(runs)])
    if not out_at[-1]:
        return np.zeros(0, U64), out_at
    begin = np.arange(out_at[-1]) - np.repeat(out_at[:-1] - at[:-1], runs)
    length = np.repeat(np.minimum(n, size), runs)
    padded = np.concatenate([h, np.zeros(size, U64)])
    out = length.astype(U64) * U64(0xA0761D6478BD642F)
    for k in range(size):
        out = mix64(out + np.where(k < length, padded[begin + k], U64(0)))
    return out, out_at


def add_at(values: np.ndarray, at: np.ndarray, ufunc=np.add, empty=0) -> np.ndarray:
    """``ufunc`` over the values of each text; ``empty`` for a text without any."""
    n = np.diff(at)
    out = np.full(len(n), empty, values.dtype)
    full = n > 0
    if full.any():
        out[full] = ufunc.reduceat(values, at[:-1][full])
    return out
