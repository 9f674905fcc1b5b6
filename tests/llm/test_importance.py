"""Importance resampling against plain Python, and its parts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from brute import lower
from paysift.llm import importance as I

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text, low=1, high=1):
    w = WORD.findall(lower(text or ""))
    return [" ".join(w[i:i + n]) for n in range(low, high + 1) for i in range(len(w) - n + 1)], len(w)


def plain(rows, items, percent=10, least=20, low=1, high=1, buckets=10_000):
    """[(id, n_features, weight, score, rank)]; ranks for distinct (score, id)."""
    at = lambda f: zlib.crc32(f.encode()) % buckets
    made = [features(t, low, high) for _, t in rows]
    s, t = Counter(at(f) for x, _ in made for f in x), Counter(at(f) for x in items for f in features(x, low, high)[0])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    out = []
    for (i, _), (x, n) in zip(rows, made, strict=True):
        weight = sum(gain(at(f)) for f in x) // len(x) if x else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    order = sorted((o for o in out if o[4] >= least), key=lambda o: (-o[3], o[0] is None, o[0] or 0))
    rank = {id(o): r for r, o in enumerate(order[:percent * len(order) // 100], 1)}
    return [(*o[:4], rank.get(id(o))) for o in out]


def got(df):
    return [(r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in df.collect()]


def corpus(seed, n):
    r = random.Random(seed)
    vocab = [f"{a}{b}" for a in ("ab", "Cd", "éx", "zz9", "long" * 9) for b in range(12)]
    return [(i, " ".join(r.choice(vocab) + r.choice(["", ",", "  ", "\n"]) for _ in range(r.randint(0, 60)))) for i in range(n)]


@pytest.mark.parametrize("low,high", [(1, 1), (1, 3), (2, 2)])
def test_against_plain_python(spark, low, high):
    rows = corpus(1, 300) + [(300, None), (301, ""), (302, " .,; ")]
    items = [t for _, t in corpus(2, 20)] + [None, ""]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    target = spark.createDataFrame([(t,) for t in items], "text string")
    want = plain(rows, items, low=low, high=high)
    assert sum(w[4] is not None for w in want) > 10
    assert sorted(got(I.resample(docs, target, low=low, high=high))) == sorted(want)


def test_odd_input(spark):
    rows = [(5, "word " * 30)] * 12 + [(None, "other " * 25), (7, None), (7, None)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, rank string, c int")
    target = spark.createDataFrame([("word",)], "text string")
    drawn = I.resample(docs, target, percent=50, carry=["rank", "c", "text"])
    assert drawn.columns == ["doc_id", "c", "text", *I.RESULT]
    out = drawn.collect()
    assert len(out) == 15 and sorted(r["rank"] for r in out if r["rank"]) == list(range(1, 7))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_features, r.weight, r.score) for r in out) == sorted(
        (w[0] is None, w[0] or 0, *w[1:4]) for w in plain(rows, ["word"], percent=50))
    assert [r["rank"] for r in out if r.doc_id == 7] == [None, None]
    assert I.resample(docs.limit(0), target).count() == 0
    assert sorted(got(I.resample(docs.where("doc_id = 7"), target.limit(0)))) == sorted(plain([(7, None)] * 2, []))


def test_long_text_in_stretches(spark, monkeypatch):
    rows = [(1, "".join(f"w{i % 50} " for i in range(2000))), (2, "x" * 5000 + " y z"), (3, " " * 3000 + "end")]
    raw = np.frombuffer("".join(t for _, t in rows).encode(), np.uint8)
    monkeypatch.setattr(I, "SEGMENT", 256)
    monkeypatch.setattr(I, "segments", lambda off: ((i, i + 1) for i in range(len(off) - 1)))
    off = np.cumsum([0, *[len(t) for _, t in rows]])
    assert len(list(I.stretches(raw, off))) > 20
    import pyarrow as pa
    for low, high in ((1, 1), (1, 3)):
        n, words = Counter(), Counter()
        total = np.zeros(10_000, int)
        for lo, _, t, row, w in I._tables(pa.array([t for _, t in rows]), low, high, 10_000):
            n[lo] += len(row)
            words[lo] += int(w[0])
            total += np.bincount(t.bucket, weights=t.count, minlength=10_000).astype(int)
        for i, (_, t) in enumerate(rows):
            assert (n[i], words[i]) == (len(features(t, low, high)[0]), features(t)[1])
        want = Counter(zlib.crc32(f.encode()) % 10_000 for _, t in rows for f in features(t, low, high)[0])
        assert {i: int(x) for i, x in enumerate(total) if x} == want


def _strings(seed):
    r = random.Random(seed)
    texts = [bytes(r.choices(range(97, 100), k=r.choice([1, 2, 3, 5, 8, 9, 17, 31, 32, 40]))) for _ in range(3000)]
    size = np.array([len(t) for t in texts])
    return texts, np.frombuffer(b"".join(texts) + b" " * 8, np.uint8), np.cumsum(size) - size, size


def test_keys_are_xxhash64():
    texts, buf, s, size = _strings(4)
    assert I.xxhash64(buf, I.lanes(buf), s, size).tolist() == [xxhash.xxh64_intdigest(t) for t in texts]


@pytest.mark.parametrize("hashes", [I.xxhash64, lambda buf, word, s, size: np.full(len(s), 2 ** 64 - 1, np.uint64), lambda buf, word, s, size: size.astype(np.uint64)])
def test_table_verifies_bytes_whatever_the_hash(hashes):
    """Equal keys of different strings get slots of their own."""
    texts, buf, s, size = _strings(5)
    texts, s, size = texts[:400], s[:400], size[:400]
    t = I.Table(buf, s, size, 97, hashes)
    by_slot = {}
    for x, at in zip(texts, t.slot.tolist(), strict=True):
        assert by_slot.setdefault(at, x) == x
        assert t.bucket[at] == zlib.crc32(x) % 97
    assert len(by_slot) == len(set(texts))
    assert {by_slot[a]: int(t.count[a]) for a in by_slot} == Counter(texts)
