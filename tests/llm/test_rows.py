"""Results don't depend on how the scans of the documents are split."""

import hashlib

import pytest
from brute import contaminated, near, passages, substring
from test_exact import corpus, order

from paysift.llm import decontaminate, near_dedup, repeats
from paysift.llm.decontaminate import drop_contaminated
from paysift.llm.near_dedup import drop_near_duplicates, near_duplicates
from paysift.llm.passage_dedup import remove_passages
from paysift.llm.substring_dedup import remove_repeats

SPLITS = "spark.sql.files.minPartitionNum"


@pytest.fixture(scope="module")
def rows():
    return corpus(11, 61)


@pytest.fixture
def docs(spark, rows, tmp_path, monkeypatch):
    """Files that are one partition until an operator has written a table, and
    five from then on."""
    path = str(tmp_path / "d")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(path)
    for module in (repeats, near_dedup, decontaminate):
        def save(df, name, real=module.save):
            out = real(df, name)
            spark.conf.set(SPLITS, "64")
            return out
        monkeypatch.setattr(module, "save", save)
    spark.conf.set(SPLITS, "1")
    yield spark.read.parquet(path)
    spark.conf.unset(SPLITS)


def last_read_as_one(df):
    df.sparkSession.conf.set(SPLITS, "1")
    return df.collect()


def test_substring(docs, rows):
    got = last_read_as_one(remove_repeats(docs))
    assert order((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, hashlib.sha256(x.kept).hexdigest()) for x in got) == order(substring(rows))


def test_passages(docs, rows):
    got = last_read_as_one(remove_passages(docs))
    assert order((x.doc_id, x.n_words, x.n_removed, hashlib.sha256(x.kept).hexdigest()) for x in got) == order(passages(rows))


def test_near(docs, rows):
    got = near_duplicates(docs, 80).collect()
    assert order((x.doc_id, x.n_shingles, x.component_id) for x in got) == order(near(rows, 80))


def test_near_keeps_one(docs, rows):
    kept, want = drop_near_duplicates(docs, 80).collect(), near(rows, 80)
    assert order((x.doc_id,) for x in kept) == order([(i,) for i, n, _ in want if not n] + [(c,) for c in {c for _, n, c in want if n}])


def test_contamination(spark, docs, rows):
    items = [(1, " ".join(rows[5][1].split()[:11])), (2, " ".join(rows[9][1].split()[:30])), (3, "one")]
    want = contaminated(rows, items)
    kept = last_read_as_one(drop_contaminated(docs, spark.createDataFrame(items, "item_id long, text string")))
    assert order((x.doc_id,) for x in kept) == order((x[0],) for x in want if not x[5])
