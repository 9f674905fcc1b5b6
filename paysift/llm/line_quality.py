"""Document quality from a linear-chain CRF over lines (operator 5).

Every line with text is labelled good or bad.  A line's features are shares of
its bytes and words (symbols, bars, capitals, repeated words, ...), together
with those of the lines before and after it; a 2 x 2 transition matrix links
neighbouring labels.  The labels table marks documents, so a training line has
its document's label.  A document's score is the mean over its lines, weighted
by length, of the forward-backward probability of "good".

Training: on a bounded sample (``max_docs``: the labelled documents of least id
hash, so it is the same at every run), on the driver, by gradient ascent.  Where ids
repeat, it reads at most twice as many rows, in the order of id and text.  It
is the only part that is bounded; scoring reads every line of every text.
Scoring is one pass without a shuffle; a document is scored in its own row.

Nulls, empty texts and texts of white space have no lines: their score is the
share of good documents in the sample.  Without labels all scores are 0.5.
Rows that repeat an id are scored each on their own; label rows that repeat an
id count as often as they are there, those without quality not at all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS_MASK, prepare, segments, text_buffers, words

_CLASSES = [b"#*$%&<>^~=+@", b"|", b"!?", bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100)), bytes(range(0x30, 0x3A)), b" \t", b".,;:"]
_CLASS_MASK = np.array([[b in c for b in range(256)] for c in _CLASSES])
N_OWN = 13
#: Bytes whose classes are counted at a time.
PIECE = 1 << 18
N_FEATURES = 3 * N_OWN + 3


def _class_counts(raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> list[np.ndarray]:
    """Bytes of each class in each line, a piece of the text at a time: a text's
    lines need no more memory for it than one piece does."""
    counts = np.zeros((len(_CLASSES), len(start)), np.int64)
    for p in range(int(start[0]), int(stop[-1]), PIECE):
        buf = raw[p:min(p + PIECE, int(stop[-1]))]
        lines = slice(int(np.searchsorted(stop, p, "right")), int(np.searchsorted(start, p + len(buf), "left")))
        a, b = np.clip(start[lines] - p, 0, len(buf)), np.clip(stop[lines] - p, 0, len(buf))
        for c, mask in enumerate(_CLASS_MASK):
            cum = np.concatenate([[0], np.cumsum(mask[buf], dtype=np.int64)])
            counts[c, lines] += cum[b] - cum[a]
    return list(counts)


def line_features(raw, offsets, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, length, features) of the lines with text of rows lo..hi-1."""
    a, b = int(offsets[lo]), int(offsets[hi])
    row, s, e, h = words(raw, offsets, lo, hi, WS_MASK, fold=False)
    if not len(row):
        return np.zeros(0, np.int64), np.zeros(0), np.zeros((0, N_FEATURES))
    breaks = np.unique(np.concatenate([np.flatnonzero(raw[a:b] == 10) + 1 + a, offsets[lo:hi]]))
    of_word = np.searchsorted(breaks, s, "right") - 1  # a word never spans lines
    used, line = np.unique(of_word, return_inverse=True)
    start = breaks[used]
    stop = np.append(breaks, b)[used + 1]
    stop -= (stop > start) & (raw[np.maximum(stop - 1, 0)] == 10)
    size, n = (stop - start).astype(float), np.bincount(line).astype(float)
    symbols, bars, bangs, upper, lower, digits, spaces, marks = _class_counts(raw, start, stop)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    order = np.lexsort((h, line))
    again = np.zeros(len(h), bool)
    again[1:] = (h[order][1:] == h[order][:-1]) & (line[order][1:] == line[order][:-1])
    # Lines equal to an earlier one of the text, by the sum of their words.
    weight = h * (np.arange(len(h)) - np.searchsorted(line, line) + 1).astype(np.uint64)
    content = np.add.reduceat(weight, np.flatnonzero(np.append(True, line[1:] != line[:-1])))
    rows = row[np.searchsorted(line, np.arange(len(used)))]
    by = np.lexsort((np.arange(len(used)), content, rows))
    dup = np.zeros(len(used), bool)
    dup[by[1:]] = (content[by][1:] == content[by][:-1]) & (rows[by][1:] == rows[by][:-1])
    own = np.stack([np.log1p(size) / 5, symbols / size, bars / size, bangs / size, upper / (upper + lower + 1), digits / size, spaces / size, marks / size,
                    np.minimum(size / n / 10, 5), np.bincount(line, same) / n, np.bincount(line[order], again) / n, dup.astype(float), np.minimum((symbols + bars + bangs) / n, 3)], 1)
    first, last = np.append(True, rows[1:] != rows[:-1]), np.append(rows[1:] != rows[:-1], True)
    before = np.vstack([np.zeros((1, N_OWN)), own[:-1]]) * ~first[:, None]
    after = np.vstack([own[1:], np.zeros((1, N_OWN))]) * ~last[:, None]
    return rows, size, np.hstack([own, before, after, first[:, None], last[:, None], np.ones((len(used), 1))])


def _lse(a, b):
    return np.logaddexp(a, b)


def forward_backward(unary: np.ndarray, counts: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) per line and the summed pair marginals (2 x 2) of chains of
    ``counts`` lines that follow each other; ``unary``: score of good."""
    counts = counts[counts > 0]
    starts = np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")
    starts, counts = starts[order], counts[order]
    s = np.stack([np.zeros(len(unary)), unary], 1)
    alpha, beta, pair = s.copy(), np.zeros_like(s), np.zeros((2, 2))
    longest = int(counts[0]) if len(counts) else 0
    live = np.searchsorted(-counts, -np.arange(1, longest + 1), "right")  # chains of more than t lines
    for t in range(1, longest):
        i = starts[:live[t]] + t
        p = alpha[i - 1]
        for y in (0, 1):
            alpha[i, y] += _lse(p[:, 0] + trans[0, y], p[:, 1] + trans[1, y])
    for t in range(longest - 1, 0, -1):
        i = starts[:live[t]] + t
        q = s[i] + beta[i]
        for x in (0, 1):
            beta[i - 1, x] = _lse(q[:, 0] + trans[x, 0], q[:, 1] + trans[x, 1])
    log_z = _lse(*(alpha + beta).T)
    inner = np.ones(len(unary), bool)
    inner[starts] = False
    i = np.flatnonzero(inner)
    for x in (0, 1):
        for y in (0, 1):
            pair[x, y] = np.exp(alpha[i - 1, x] + trans[x, y] + s[i, y] + beta[i, y] - log_z[i]).sum()
    return np.exp(alpha[:, 1] + beta[:, 1] - log_z), pair


def fit(texts: list[str], labels: list[int], steps: int = 150, rate: float = 0.1, ridge: float = 1e-3) -> dict:
    """Weights of the features (scaled) and transitions by Adam."""
    if not texts:
        return {"prior": 0.5, "w": None}
    raw, offsets = text_buffers(pa.array(texts, pa.string()))
    rows, _, x = (np.concatenate(p) for p in zip(*[line_features(raw, offsets, lo, hi) for lo, hi in segments(offsets)], strict=True))
    y, prior = np.array(labels, float), float(np.mean(labels))
    if not len(rows) or prior in (0.0, 1.0):
        return {"prior": prior, "w": None}
    mean, std = x.mean(0), x.std(0)
    mean[-1], std = 0, np.where(std > 1e-9, std, 1)
    x = (x - mean) / std
    counts = np.bincount(rows, minlength=len(texts))
    good = y[rows]
    inner = np.append(False, rows[1:] == rows[:-1])
    seen = np.zeros((2, 2))
    seen[0, 0], seen[1, 1] = (inner & (good == 0)).sum(), (inner & (good == 1)).sum()
    theta, m, v = np.zeros(x.shape[1] + 4), 0.0, 0.0
    for k in range(1, steps + 1):
        w, trans = theta[:-4], theta[-4:].reshape(2, 2)
        p, pair = forward_backward(x @ w, counts, trans)
        g = np.concatenate([x.T @ (good - p), (seen - pair).ravel()]) / len(rows) - ridge * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + rate * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.999 ** k)) + 1e-8)
    return {"prior": prior, "w": theta[:-4], "trans": theta[-4:].reshape(2, 2), "mean": mean, "std": std}


def score_rows(model: dict, raw, offsets, lo: int, hi: int) -> np.ndarray:
    out = np.full(hi - lo, model["prior"])
    if model["w"] is None:
        return out
    rows, size, x = line_features(raw, offsets, lo, hi)
    if len(rows):
        p, _ = forward_backward(((x - model["mean"]) / model["std"]) @ model["w"], np.bincount(rows - lo, minlength=hi - lo), model["trans"])
        total = np.bincount(rows - lo, size, hi - lo)
        some = total > 0
        out[some] = (np.bincount(rows - lo, size * p, hi - lo)[some] / total[some]).clip(0, 1)
    return out


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", max_docs: int = 4000) -> dict:
    """Fits on at most ``max_docs`` labelled documents that aren't held out."""
    chosen = (labels.where(~held_out(id_col) & F.col(label).isNotNull()).select(F.col(id_col), F.col(label).cast("int").alias("_good"))
              .orderBy(F.xxhash64(id_col), id_col).limit(max_docs))
    sample = docs.select(F.col(id_col), F.coalesce(text_col, F.lit("")).alias("_text")).join(F.broadcast(chosen), id_col).orderBy(id_col, "_text", "_good").limit(2 * max_docs).collect()
    return fit([r["_text"] for r in sample], [r["_good"] for r in sample])


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) per row."""
    prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            found = [score_rows(model, raw, offsets, lo, hi) for lo, hi in segments(offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([np.zeros(0), *found]))], [id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, score double")
