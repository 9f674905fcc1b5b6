"""Digit passes, hot keys and texts longer than a piece."""

import hashlib
import random

import numpy as np
import pytest
from brute import passages, substring
from test_exact import corpus, order

from paysift.llm import passage_dedup, repeats, substring_dedup
from paysift.llm.common import SEGMENT
from paysift.llm.passage_dedup import remove_passages
from paysift.llm.substring_dedup import remove_repeats


@pytest.mark.parametrize("width,step", [(50, 1), (8, 8), (8, 1), (13, 1)])
@pytest.mark.parametrize("limit", [2, 40])
@pytest.mark.parametrize("kind", [0, 2])
def test_digit_passes_find_the_earliest_of_equal_windows(width, step, limit, kind):
    r = random.Random(width * step)
    keys, texts = [], []
    for key in range(30):
        some = [bytes(r.choices(b"ab", k=width + step * r.randint(0, 6))) for _ in range(3)]
        for _ in range(r.randint(1, limit)):
            keys.append(key)
            texts.append(r.choice(some))
    id0, at0 = (np.array([r.randint(-3, 3) for _ in keys], np.int64) for _ in range(2))
    content = np.array([(0, 1, hash(t))[kind] for t in texts])  # of one hash for all to a right one
    raw, off = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    got = set()
    for i, a, b, gid, gat in zip(*(x.tolist() for x in repeats.equal_windows(np.array(keys), content, id0, at0, raw, off, width, step)), strict=True):
        got |= {(i, j, gid, gat + j) for j in range(a, b)}
    # The windows of one text differ from each other, as they have one anchor; where a key has a
    # single text, nothing is compared, so here the place stands in for that.
    alone = {k: len({t for x, t in zip(keys, texts, strict=True) if x == k}) == 1 for k in keys}
    windows = [(i, j, (keys[i], t[j * step:j * step + width], alone[keys[i]] and j)) for i, t in enumerate(texts) for j in range((len(t) - width) // step + 1)]
    first = {}
    for i, j, w in windows:
        here = (int(id0[i]), int(at0[i]) + j)
        first[w] = min(first.get(w, here), here)
    assert got == {(i, j, *first[w]) for i, j, w in windows}


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    common = " ".join(r.choice("alpha beta gamma delta".split()) for _ in range(60))
    more = [(5000 + i, f"head {i} " + common + f" tail {i % 3} " + common[:150]) for i in range(60)]
    return corpus(9, 80) + more + [(6000 + i, "same line of words " * 12) for i in range(20)]


@pytest.mark.parametrize("hot_rows,windows", [(2, 64), (7, 1 << 19), (10 ** 9, 64)])
def test_hot_keys_and_small_groups_give_the_same(spark, rows, monkeypatch, hot_rows, windows):
    monkeypatch.setattr(repeats, "WINDOWS", windows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = remove_repeats(docs, hot_rows=hot_rows).collect()
    assert order((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, hashlib.sha256(x.kept).hexdigest()) for x in got) == order(substring(rows))
    got = remove_passages(docs, hot_rows=hot_rows).collect()
    assert order((x.doc_id, x.n_words, x.n_removed, hashlib.sha256(x.kept).hexdigest()) for x in got) == order(passages(rows))


def long_rows():
    """One text over SEGMENT bytes and CHUNK words, and parts of it around the places where it is cut."""
    r = random.Random(6)
    words = [f"{a}{b}" for a in "abcdefg" for b in "hijklmn"]
    text = " ".join(r.choice(words) for _ in range(passage_dedup.CHUNK + 2000))
    cut = 3 * passage_dedup.CHUNK
    assert len(text) > SEGMENT + 1000
    return [(1, text), (2, "x " + text[SEGMENT - 300:SEGMENT + 300]), (3, text[cut - 200:cut + 200] + " y"), (0, text[2 * SEGMENT // 3:2 * SEGMENT // 3 + 90]), (4, text[-100:])]


def test_text_longer_than_a_piece(spark):
    rows = long_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = remove_repeats(docs).collect()
    assert order((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, hashlib.sha256(x.kept).hexdigest()) for x in got) == order(substring(rows, substring_dedup.SIZE))
    got = remove_passages(docs).collect()
    assert order((x.doc_id, x.n_words, x.n_removed, hashlib.sha256(x.kept).hexdigest()) for x in got) == order(passages(rows, passage_dedup.SIZE))


@pytest.mark.parametrize("bits", [0, 2])
def test_windows_of_one_hash_are_told_apart_by_their_words(bits):
    """Units that are equal by chance (all of them, or of four values): the words decide."""
    r = random.Random(bits)
    words = ["".join(r.choices("abé", k=r.randint(1, 9))) for _ in range(12)]
    some = [" ".join(r.choice(words) for _ in range(passage_dedup.SIZE + r.randint(0, 5))) for _ in range(8)]
    texts = [r.choice(some) for _ in range(40)] + some[:1]
    keys, id0 = np.array(sorted(r.randint(0, 3) for _ in texts)), np.array([r.randint(-3, 3) for _ in texts])
    at0 = np.arange(len(texts)) * 100
    raw, off = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)])
    real, passage_dedup.unit = passage_dedup.unit, lambda h: passage_dedup.gram_hash(h, passage_dedup.SIZE) & np.uint64((1 << bits) - 1)
    try:
        units = passage_dedup.window_units(raw, off)
    finally:
        passage_dedup.unit = real
    got = set()
    for i, a, b, gid, gat in zip(*(x.tolist() for x in repeats.equal_windows(keys, np.zeros(len(texts), np.int64), id0, at0, raw, off, 8, 8, units)), strict=True):
        got |= {(i, j, gid, gat + j) for j in range(a, b)}
    alone = {k: len({t for x, t in zip(keys, texts, strict=True) if x == k}) == 1 for k in keys}
    windows = []
    for i, t in enumerate(texts):
        w = t.split(" ")
        windows += [(i, j, (keys[i], tuple(w[j:j + passage_dedup.SIZE]), alone[keys[i]] and j)) for j in range(len(w) - passage_dedup.SIZE + 1)]
    first = {}
    for i, j, w in windows:
        here = (int(id0[i]), int(at0[i]) + j)
        first[w] = min(first.get(w, here), here)
    assert got == {(i, j, *first[w]) for i, j, w in windows}


def test_string_ids_and_clashing_names(spark):
    """Ids of any type that can be sorted; the caller's columns stay, whatever their names."""
    same = "the quick brown fox jumps over the lazy dog while nine more words follow here to make the window long enough now " * 2
    rows = [("b", "x " + same), ("a", same), (None, same), ("c", "short"), ("a", same + "z"), ("é", None)]
    ranks = {x: n for n, x in enumerate(sorted({i for i, _ in rows if i is not None}, key=lambda x: x.encode()))}
    plain = [(None if i is None else ranks[i], t) for i, t in rows]
    schema = "doc_id string, text string, _row string, _text int, _h string, _spans string, _id string, _k int"
    docs = spark.createDataFrame([(i, t, "r", n, "h", "s", "i", n) for n, (i, t) in enumerate(rows)], schema).repartition(3)
    back = {v: k for k, v in ranks.items()}
    for got, want in ((remove_repeats(docs).collect(), substring(plain)), (remove_passages(docs).collect(), passages(plain))):
        assert [(x._row, x._h, x._spans, x._id) for x in got] == [("r", "h", "s", "i")] * len(rows)
        assert sorted(x._text for x in got) == sorted(x._k for x in got) == list(range(len(rows)))
        mine = order((x.doc_id, x.n_removed, hashlib.sha256(x.kept).hexdigest()) for x in got)
        assert mine == order((back.get(x[0]), x[2], x[-1]) for x in want)
