"""Exact substring removal by a depth-limited radix sort (operator 6).

Repeated byte strings of ``SIZE`` bytes across documents.  The suffixes that
matter are sorted only through ``SIZE`` bytes, digit by digit:

* The first digit of a window is the ``DIGIT``-byte string of least hash in it
  (its anchor), so equal windows fall into one group and only one suffix in 18
  has to be dealt out.  Groups of one end here (``repeats``, steps 1 and 2), so
  no bytes are sent for them.
* Inside the groups that are left, passes over the windows' bytes, eight at a
  time and most significant first, sort and split the groups; groups of one end
  at each pass.  Groups that are left after ``SIZE`` bytes are exactly the
  repeated windows (``repeats.equal_windows``).

Anchors of a text are found in pieces of SEGMENT bytes that overlap by a
window, so memory doesn't grow with the text.

Null and empty texts, and those of fewer than SIZE bytes, lose nothing.  Rows
that repeat an id lose nothing to each other, as no id is smaller.  A null id
counts as smaller than all others.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .common import SEGMENT, _BYTES, _powers, lanes, mix, stored, window_argmin
from .repeats import Runs, finish, ordered_ids, repeated_spans

SIZE, DIGIT = 50, 16
_C1, _C2 = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _digits(buf: np.ndarray) -> np.ndarray:
    """Hash of the DIGIT bytes from each place on."""
    n, word = len(buf) - DIGIT + 1, lanes(buf)
    h = mix(word[:n] * _C1)
    for o in range(8, DIGIT, 8):
        h = (h ^ mix(word[o:o + n] + _C2)) * _C1
    return mix(h)


class _Bytes(Runs):
    def window_hash(self, runs, first):
        a = self.at[runs] + first
        return self.hash(a, a + SIZE)

    def windows(self, runs, first, count):
        a = self.at[runs] + first
        return [self.raw[i:j].tobytes() for i, j in zip(a.tolist(), (a + count + SIZE - 1).tolist(), strict=True)]


def anchors(raw: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> Runs:
    parts = []
    a, end = int(offsets[lo]), int(offsets[hi])
    while end - a >= SIZE:
        b = min(end, a + SEGMENT + SIZE - 1)
        buf = np.ascontiguousarray(raw[a:b])
        digit = _digits(buf)
        best = window_argmin(digit, SIZE - DIGIT + 1)  # one per window start
        p, inv = _powers(len(buf))
        cum = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_BYTES[buf] * p, out=cum[1:])
        starts = np.arange(len(best)) + a
        row = np.searchsorted(offsets[lo:hi + 1], starts, "right") - 1 + lo
        inside = starts + SIZE <= offsets[row + 1]
        first = inside.copy()
        first[1:] &= (best[1:] != best[:-1]) | (row[1:] != row[:-1]) | ~inside[:-1]
        at = np.flatnonzero(first)
        number = np.cumsum(first) - 1
        count = np.bincount(number[inside], minlength=len(at)) if len(at) else np.zeros(0, np.int64)
        until = at + count + SIZE - 1
        content = mix((cum[until] - cum[at]) * inv[at] + count.astype(np.uint64))
        parts.append((row[at], digit[best[at]], at + a - offsets[row[at]], count, content, at + a))
        a = b - SIZE + 1 if b < end else end
    if not parts:
        z = np.zeros(0, np.int64)
        parts = [(z, z.view(np.uint64), z, z, z.view(np.uint64), z)]
    row, key, start, count, content, at = (np.concatenate(x) for x in zip(*parts, strict=True))
    runs = _Bytes(row, key, start, count, content)
    runs.at, runs.raw = at, raw

    def span_hash(s, e):
        out = np.zeros(len(s), np.uint64)
        p, inv = _powers(SIZE)
        for k in range(SIZE):
            out += _BYTES[raw[s + k]] * p[k]
        return mix(out + np.uint64(1))

    runs.hash = span_hash
    return runs


def measure(text: np.ndarray, spans: list[tuple[int, int]]) -> tuple[int, int, int, bytes]:
    kept, at = [], 0
    for s, e in spans:
        kept.append(text[at:s].tobytes())
        at = e
    kept.append(text[at:].tobytes())
    data = b"".join(kept)
    return len(text), len(text) - len(data), len(spans), data


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_rows: int = 4_000) -> DataFrame:
    """Per row: its number (_row, or with more underscores), its other columns, n_bytes, n_removed, n_spans (maximal
    removed runs) and kept (the remaining bytes).  Anchors that occur
    ``hot_rows`` times or more are dealt window by window."""
    docs, number = ordered_ids(docs, id_col)
    docs, row = stored(docs)
    spans = repeated_spans(docs, row, anchors, SIZE, number, text_col, across=True, width=SIZE, step=1, hot_rows=hot_rows)
    return finish(docs, row, spans, measure, "n_bytes long, n_removed long, n_spans long, kept binary", text_col,
                  drop=() if number == id_col else (number,))
