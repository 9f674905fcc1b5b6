"""Exact removal of repeated word passages by recompression (operator 9).

Windows of ``SIZE`` consecutive words.  A document's words are compressed in
rounds: runs of one symbol become a symbol named by (symbol, length), then the
symbols are split into left and right ones by a hash of their names and each
(left, right) pair becomes a symbol named by the two.  Names are content hashes
with the round, so they are the same over all documents without a dictionary.

A symbol is the same in all occurrences of a passage if the words it was made
from, and those its rounds looked at beside it, lie inside; that stretch is
kept with each symbol (the edge of a document counts as unknown).  The anchor of
a window is the symbol of the highest round whose stretch lies inside the
window, of those the one of least name hash.  A single word always qualifies,
so every window has an anchor and equal windows have the same one: shared
symbols reveal every repeat.  ``repeats`` joins them and verifies the windows:
those of one anchor with one 64-bit hash of their 20 words are compared on the
words themselves, which travel with each run of windows.

Nulls, empty texts and texts of fewer than SIZE words lose nothing.  Rows that
repeat an id count as one document when places are compared; windows at the
same place of such rows are not earlier than each other, so both stay.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .common import WS_MASK, _powers, gram_hash, lanes, mix, row_counts, same_bytes, segments, stored, words
from .repeats import Runs, finish, ordered_ids, repeated_spans

SIZE, ROUNDS = 20, 2
#: Window starts handled at a time.
CHUNK = 1 << 19


def compress(name, s, e, ds, de, row, first, last, salt: int):
    """One round over symbols (sorted): (name, s, e, ds, de, row).  ds..de is
    the stretch a symbol depends on; first / last: the bounds of a row."""
    sides = np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))
    salt = np.uint64(salt)

    def beside():
        same = row[1:] == row[:-1]
        prev_ds = np.concatenate([ds[:1], np.where(same, ds[:-1], first[row[1:]] - 1)])
        next_de = np.concatenate([np.where(same, de[1:], last[row[:-1]] + 1), de[-1:]])
        prev_ds[:1], next_de[-1:] = first[row[:1]] - 1, last[row[-1:]] + 1
        return same, np.minimum(ds, prev_ds), np.maximum(de, next_de)

    # Runs: to know where one ends, both neighbours are looked at.
    same, low, high = beside()
    head = np.ones(len(name), bool)
    head[1:] = ~(same & (name[1:] == name[:-1]))
    at = np.flatnonzero(head)
    tail = np.append(at[1:], len(name)) - 1
    n = (tail - at + 1).astype(np.uint64)
    name, s, e, row = np.where(n > 1, mix(mix(name[at] + salt) + n), name[at]), s[at], e[tail], row[at]
    ds, de = low[at], high[tail]
    # Pairs: a left symbol looks at the next one, a right one at the one before.
    same, low, high = beside()
    right = (mix(name ^ sides) >> np.uint64(63)).astype(bool)
    join = np.zeros(len(name), bool)
    join[:-1] = same & ~right[:-1] & right[1:]
    ds, de = np.where(right, low, ds), np.where(right, de, high)
    head = np.ones(len(name), bool)
    head[1:] = ~join[:-1]
    at = np.flatnonzero(head)
    tail = np.append(at[1:], len(name)) - 1
    paired = join[at]
    name = np.where(paired, mix(mix(name[at] ^ salt) * np.uint64(3) + name[tail]), name[at])
    return name, s[at], e[tail], np.minimum(ds[at], ds[tail]), np.maximum(de[at], de[tail]), row[at]


def _least(order: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Place of the least of order[a:b] (the first of equals); b > a."""
    tables, size = [np.arange(len(order))], 1
    longest = int((b - a).max())
    while size * 2 <= longest:
        x, y = tables[-1][:-size], tables[-1][size:]
        tables.append(np.where(order[y] < order[x], y, x))
        size *= 2
    level = np.floor(np.log2(b - a)).astype(int)
    out = np.empty(len(a), np.int64)
    for k, t in enumerate(tables):
        m = np.flatnonzero(level == k)
        x, y = t[a[m]], t[b[m] - (1 << k)]
        out[m] = np.where(order[y] < order[x], y, x)
    return out


class _Words(Runs):
    """``text``: the words of the segment joined by one space, word i from
    ``begin[i]`` on."""

    def window_hash(self, runs, first):
        return self.hashes[self.at[runs] + first]

    def windows(self, runs, first, count):
        a = self.at[runs] + first
        return [self.text[i:j].tobytes() for i, j in zip(self.begin[a].tolist(), (self.begin[a + count + SIZE - 1] - 1).tolist(), strict=True)]


def joined(raw: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words s..e, a space after each, and where they begin there (and end)."""
    begin = np.concatenate([np.zeros(1, np.int64), np.cumsum(e - s + 1)])
    text = np.full(int(begin[-1]), 0x20, np.uint8)
    if len(s):
        inside = np.ones(len(text), bool)
        inside[begin[1:] - 1] = False
        buf = raw[s[0]:e[-1]]
        text[inside] = buf[WS_MASK[buf]]
    return text, begin.astype(np.int32) if begin[-1] < 1 << 31 else begin


def unit(h: np.ndarray) -> np.ndarray:
    """Hash of each window of consecutive words."""
    return gram_hash(h, SIZE)


def window_units(raw: np.ndarray, off: np.ndarray):
    """The windows of texts (words joined by one space) for ``equal_windows``: an
    8-byte hash each, and the comparison of their words."""
    parts = [words(raw, off, lo, hi, WS_MASK, fold=False) for lo, hi in segments(off)] or [words(raw, off, 0, 0, WS_MASK, fold=False)]
    row, s, e, h = (np.concatenate(x) for x in zip(*parts, strict=True))
    count = np.bincount(row, minlength=len(off) - 1)
    first = np.cumsum(count) - count
    at = np.flatnonzero(row[:len(h) - SIZE + 1] == row[SIZE - 1:])
    hashes, start = unit(h)[at].view(np.uint8), np.concatenate([np.zeros(1, np.int64), np.cumsum(count - SIZE + 1)])
    lane = lanes(np.concatenate([raw[:off[-1]], np.zeros(8, np.uint8)]))

    def bounds(i, j):
        a = first[i] + j
        return s[a], e[a + SIZE - 1]

    def whole(i, j):
        a, b = bounds(i, j)
        return raw[a:b].tobytes()

    def same(i, j, k, m):
        (a, b), (c, d) = bounds(i, j), bounds(k, m)
        out = b - a == d - c
        out[out] = same_bytes(lane, a[out], c[out], (b - a)[out])
        return out

    return hashes, start * 8, whole, same


def choose(h: np.ndarray, row: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window starts, anchor keys, anchors' numbers) of consecutive words h of
    rows 0..n_rows-1."""
    window = np.flatnonzero(row[:len(h) - SIZE + 1] == row[SIZE - 1:])
    key, chosen = np.zeros(len(window), np.uint64), np.full(len(window), -1, np.int64)
    last = np.cumsum(np.bincount(row, minlength=n_rows))
    first = np.concatenate([[0], last[:-1]])
    i = np.arange(len(h))
    levels = [(h, i, i + 1, i, i + 1, row)]
    for r in range(ROUNDS):
        levels.append(compress(*levels[-1], first, last, 2 * r + 1))
    p, inv = _powers(len(h) + 1)
    cum = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * p[:-1])])
    todo = np.arange(len(window))
    for level in range(ROUNDS, -1, -1):
        name, s, _, ds, de, _ = levels[level]
        at = window[todo]
        a, b = np.searchsorted(ds, at, "left"), np.searchsorted(de, at + SIZE, "right")
        good = b > a
        if good.any():
            best = _least(mix(name ^ np.uint64(0x5851F42D4C957F2D)), a[good], b[good])
            t, d0, d1 = todo[good], ds[best], de[best]
            stretch = mix((cum[d1] - cum[d0]) * inv[d0] + (d1 - d0).astype(np.uint64))
            key[t] = mix(stretch ^ (name[best] + (s[best] - d0).astype(np.uint64) + np.uint64(level)))
            chosen[t] = s[best] * (ROUNDS + 1) + level
            todo = todo[~good]
    return window, key, chosen


def anchors(raw: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> Runs:
    row, s, e, h = words(raw, offsets, lo, hi, WS_MASK, fold=False)
    hashes = gram_hash(h, SIZE)
    parts = []
    for a in range(0, len(hashes), CHUNK):  # pieces of a long text overlap by a window
        b = min(len(h), a + CHUNK + SIZE - 1)
        window, key, chosen = choose(h[a:b], row[a:b] - lo, hi - lo)
        new = np.ones(len(window), bool)
        new[1:] = (chosen[1:] != chosen[:-1]) | (window[1:] != window[:-1] + 1)
        at = np.flatnonzero(new)
        count = np.diff(np.append(at, len(window)))
        p, inv = _powers(b - a + 1)
        cum = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h[a:b] * p[:-1])])
        begin = window[at]
        content = mix((cum[begin + count - 1 + SIZE] - cum[begin]) * inv[begin] + count.astype(np.uint64))
        parts.append((key[at], begin + a, count, content))
    if not parts:
        z = np.zeros(0, np.int64)
        parts = [(z.view(np.uint64), z, z, z.view(np.uint64))]
    key, begin, count, content = (np.concatenate(x) for x in zip(*parts, strict=True))
    starts = np.cumsum(row_counts(row, lo, hi)) - row_counts(row, lo, hi)
    at_row = row[begin] if len(begin) else begin
    runs = _Words(at_row, key, begin - starts[at_row - lo], count, content)
    runs.at, runs.hashes = begin, hashes
    runs.text, runs.begin = joined(raw, s, e)
    return runs


def measure(text: np.ndarray, spans: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    _, s, e, _ = words(text, np.array([0, len(text)]), 0, 1, WS_MASK, False)
    keep = np.ones(len(s), bool)
    for a, b in spans:
        keep[a:b] = False
    data = text.tobytes()
    kept = b" ".join([data[i:j] for i, j in zip(s[keep].tolist(), e[keep].tolist(), strict=True)])
    return len(s), len(s) - int(keep.sum()), kept


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_rows: int = 4_000) -> DataFrame:
    """Per row: its number (_row, or with more underscores), its other columns, n_words, n_removed, kept (the words
    that stay, joined by one space, as UTF-8).  Anchors that occur ``hot_rows``
    times or more are dealt window by window."""
    docs, number = ordered_ids(docs, id_col)
    docs, row = stored(docs)
    spans = repeated_spans(docs, row, anchors, SIZE, number, text_col, across=False, width=8, step=8, hot_rows=hot_rows, units=window_units)
    return finish(docs, row, spans, measure, "n_words long, n_removed long, kept binary", text_col, drop=() if number == id_col else (number,))
