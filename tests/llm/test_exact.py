"""Operators against plain Python over a fixture with nulls, empty texts, ties,
repeated rows, copies, near copies and extra columns."""

import hashlib
import random
import tempfile

import pytest
from brute import contaminated, near, passages, substring

from paysift.llm.decontaminate import contamination, drop_contaminated
from paysift.llm.near_dedup import drop_near_duplicates, near_duplicates
from paysift.llm.passage_dedup import remove_passages
from paysift.llm.substring_dedup import remove_repeats

SCHEMA = "doc_id long, text string, _row string, kept string, n_removed string"


def corpus(seed=3, n=160):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(300)]
    sentence = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    shared, rows = [sentence(r.randint(12, 70)) for _ in range(6)], []
    for i in range(n):
        parts = [sentence(r.randint(0, 60))]
        for _ in range(r.randint(0, 2)):
            parts += [r.choice(shared), sentence(r.randint(0, 30))]
        rows.append((i * 3 % n, r.choice([" ", "\n", "  "]).join(parts)))
    base = sentence(120).split()
    for k in range(30):  # a chain and a star of near copies
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = r.choice(vocab)
        rows.append((1000 + k, " ".join(w)))
        base = w if k < 12 else base
    rows += [(2000, None), (2001, ""), (2002, " \n\t "), (2003, "one"), (2004, "One"), (2005, "a b c d"), (None, rows[0][1]), (2006, rows[0][1]),
             (2006, rows[0][1]), (2007, "a " * 100), (2008, "x " + "a " * 40), (2009, "a b " * 40), (2010, "\x00" * 120 + "z" * 60), (2011, "\x00" * 90),
             (2012, shared[0] + " " + shared[0]), (2013, "É" + shared[1].upper() + "!")]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "r", "h", "k") for i, t in rows], SCHEMA).repartition(5).persist()


@pytest.fixture(scope="module")
def stored(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "d")
    docs.write.parquet(path)
    return spark.read.parquet(path)


def order(x):
    return sorted(x, key=lambda r: tuple((v is not None, str(type(v)), v if v is not None else 0) for v in r))


def test_substring(stored, rows):
    got = remove_repeats(stored).collect()
    assert order((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, hashlib.sha256(x.kept).hexdigest()) for x in got) == order(substring(rows))


def test_passages(stored, rows):
    got = remove_passages(stored).collect()
    assert order((x.doc_id, x.n_words, x.n_removed, hashlib.sha256(x.kept).hexdigest()) for x in got) == order(passages(rows))


@pytest.mark.parametrize("percent,block", [(80, 2), (85, 512)])
def test_near(stored, rows, percent, block):
    got = near_duplicates(stored, percent, block=block).collect()
    assert order((x.doc_id, x.n_shingles, x.component_id) for x in got) == order(near(rows, percent))


def test_near_keeps_one(stored, rows):
    kept = drop_near_duplicates(stored, 80)
    assert kept.columns == stored.columns
    want = near(rows, 80)
    empty = sum(n == 0 for _, n, _ in want)
    groups = {c for _, n, c in want if n}
    assert kept.count() == empty + len(groups)


def test_contamination(spark, stored, rows):
    words = rows[5][1].split()
    items = [(1, " ".join(words[:11])), (2, " ".join(words[3:40])), (3, "one"), (3, "ONE!"), (4, ""), (5, None), (10, "a b c d"), (None, rows[7][1]),
             (11, " ".join(rows[9][1].split()[:9])), (12, rows[20][1].upper())]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = contamination(stored, bench)
    got = [(x.doc_id, x.n_words, x.n_hit, len(x["items"]), hashlib.sha256(",".join(x["items"]).encode()).hexdigest(), x.n_hit > 0) for x in found.collect()]
    want = contaminated(rows, items)
    assert order(got) == order(want)
    assert drop_contaminated(stored, bench).count() == sum(not x[5] for x in want)


def test_equal_items_and_a_common_word(spark):
    """Many items of one text, and a word that is an item by itself in every place of a document."""
    tail = "one two three four five six seven eight nine ten eleven twelve"
    items = [(i, "Word!") for i in range(40)] + [(100 + i, tail) for i in range(30)] + [(200, "x " + tail + " y"), (201, "one two three four five six")]
    rows = [(i, "word " * 300 + tail) for i in range(12)] + [(50, tail), (51, "word other " * 50), (52, "one two three four five"), (53, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    docs.write.mode("overwrite").parquet(path := tempfile.mkdtemp(prefix="run-common-") + "/d")
    found = contamination(spark.read.parquet(path), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = [(x.doc_id, x.n_words, x.n_hit, len(x["items"]), hashlib.sha256(",".join(x["items"]).encode()).hexdigest(), x.n_hit > 0) for x in found]
    assert order(got) == order(contaminated(rows, items))


def test_empty_tables(spark, stored):
    none = stored.limit(0)
    assert remove_repeats(none).count() == 0
    assert remove_passages(none).count() == 0
    assert near_duplicates(none).count() == 0
    bench = spark.createDataFrame([], "item_id long, text string")
    assert contamination(none, bench).count() == 0
    assert contamination(stored, bench).where("n_hit > 0").count() == 0
