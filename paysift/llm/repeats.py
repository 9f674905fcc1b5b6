"""What the two exact substring operators share: from anchors to removed spans.

Every window of a document (a fixed number of bytes or words) has one anchor,
chosen by the content of the window alone, so equal windows have equal anchor
keys wherever they stand.  How anchors are chosen is the operators' own method.

1. Keys are counted over all documents (summed in the tasks first).  Keys that
   occur twice or more go into a bit filter of a fixed size.
2. The documents are read again.  Runs of windows whose anchor may repeat leave
   the scan as one row per distinct (key, content) and batch, with the list of
   their places: copies inside a batch are one row before the shuffle.
3. Rows are dealt and sorted by key.  Whole groups, some at a time, are split by
   the windows' bytes, eight at a time and most significant first; groups of one
   end at each pass, and what is left are the equal windows, compared on all
   their bytes, or words (``equal_windows``).  A window that is not the earliest of its
   group is a repeat.  Keys that occur ``hot_rows`` times or more (a second bit
   filter of a fixed size; a false hit only splits a key that needn't be) are
   dealt by window, not by key, so a passage in a third of all documents is
   spread over its distinct surroundings, and equal windows have met in the scan.
4. Spans go back to their documents, which are read a third time; only those
   with spans (by a filter of fixed size) are shuffled.

Rows are told apart by a number that is written with them (``stored``); all
three reads use the written table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import bit_filter, discard, in_filter, lanes, mix, prepare, same_bytes, save, segments, signed, span_hash, text_buffers

#: Stands for a null id in comparisons.
NULL_ID = -(1 << 63)
#: A span is one long: its start, and its length in so many low bits.
LENGTH = 20
#: Windows sorted at a time (whole groups, so one group may be larger).
WINDOWS = 1 << 19
#: Bytes of text taken for a window where windows are words.
TEXT_STEP = 16


def ordered_ids(docs: DataFrame, id_col: str) -> tuple[DataFrame, str]:
    """``docs`` and a column of whole numbers in the order of the ids: the ids
    themselves, or, of another type (strings, decimals), numbers of the sorted
    distinct ids, joined to the rows (each id dealt over 16 tasks)."""
    if isinstance(docs.schema[id_col].dataType, IntegralType):
        return docs, id_col
    prepare(docs.sparkSession)
    name = free_name("_id", docs.columns)
    ids = docs.select(F.col(id_col).alias("_v")).where("_v is not null").distinct()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbers = save(ids.repartitionByRange(parts, "_v").sortWithinPartitions("_v").select("_v", F.monotonically_increasing_id().alias(name)), "ordered_ids")
    key = free_name("_k", [*docs.columns, name])
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]), F.lit(16)).cast("int")
    dealt = (numbers.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(15))))
                    .select(F.struct("_v", "_s").alias(key), name))
    rows = docs.withColumn(key, F.struct(F.col(id_col).alias("_v"), salt.alias("_s")))
    return rows.join(dealt, key, "left").drop(key), name


def free_name(name: str, columns: list[str]) -> str:
    """``name``, with underscores added until none of ``columns`` has it."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


@dataclass
class Runs:
    """Runs of consecutive windows with one anchor, of one segment of rows."""

    row: np.ndarray       #: row of the batch
    key: np.ndarray       #: content hash of the anchor
    start: np.ndarray     #: first window's place in its document
    count: np.ndarray     #: number of windows
    content: np.ndarray   #: hash of all the windows cover

    def windows(self, runs, first, count) -> list[bytes]:
        """Bytes of ``count`` windows from the ``first`` of each run on."""
        raise NotImplementedError

    def window_hash(self, runs, first) -> np.ndarray:
        """Content hash of the ``first`` window of each run."""
        raise NotImplementedError

    def take(self, keep: np.ndarray) -> tuple:
        return self.row[keep], self.key[keep], self.start[keep], self.count[keep], self.content[keep]


def _keys(docs: DataFrame, anchors, text_col: str, across: bool) -> DataFrame:
    def scan(batches):
        for batch in batches:
            raw, offsets = text_buffers(batch.column(0))
            for lo, hi in segments(offsets):
                runs = anchors(raw, offsets, lo, hi)
                if across:  # once per document
                    order = np.lexsort((runs.key, runs.row))
                    k, r = runs.key[order], runs.row[order]
                    new = np.ones(len(k), bool)
                    new[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
                    keys, n = np.unique(k[new], return_counts=True)
                else:  # once per place of the anchor, whatever its runs
                    keys, n = np.unique(runs.key, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(keys)), pa.array(n)], ["h", "n"])

    return (docs.select(F.col(text_col)).mapInArrow(scan, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1"))


def _dense(new: np.ndarray) -> np.ndarray:
    return np.cumsum(new) - 1


def _heads(*columns: np.ndarray) -> np.ndarray:
    """First rows of runs of equal entries in sorted columns."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return new


def equal_windows(key, content, id0, at0, raw, off, width: int, step: int, units=None):
    """Rows of one key (sorted) are a group: (row, first window, last window + 1,
    id and shift of the earliest place) of each stretch of windows with one
    earliest place.  Window j of row i is the ``width`` bytes (8 at least) from
    j x ``step`` on in raw[off[i]:off[i + 1]]; it stands at at0[i] + j in document
    id0[i].  Rows of one text (found by ``content``, a hash, and compared) are
    looked at once.  A key with one text needs no passes: the windows of a text
    have one anchor, so they differ from each other.  ``units``: where windows
    are not bytes of the text itself, (their raw and off, content(i, j): bytes of
    the whole window j of row i, same(i, j, k, l): are windows equal); windows with
    equal units are then compared, and told apart where they differ."""
    size = np.diff(off)
    word = lanes(np.concatenate([raw[:off[-1]], np.zeros(8, np.uint8)]))
    order = np.lexsort((at0, id0, size, content, key))
    new = _heads(key[order], content[order], size[order])
    text, first = _dense(new), order[new]
    differ = ~same_bytes(word, off[order], off[first[text]], size[order])
    text[differ] = len(first) + np.arange(differ.sum())  # their hash is equal by chance: texts of their own
    of = np.empty(len(key), np.int64)  # each row's text
    of[order] = text
    head = np.concatenate([first, order[differ]])  # the earliest row of each text
    if units:
        raw, off, whole, same = units
        word = lanes(np.concatenate([raw[:off[-1]], np.zeros(8, np.uint8)]))
    n = (np.diff(off)[head] - width) // step + 1
    group = _dense(_heads(key))[head]
    some = np.bincount(group, minlength=1)[group] > 1
    several, one = np.flatnonzero(some), np.flatnonzero(~some)
    t = np.repeat(several, n[several])
    j = np.arange(len(t)) - np.repeat(np.cumsum(n[several]) - n[several], n[several])
    at = off[head[t]] + j * step
    left, g = np.arange(len(t)), group[t]
    for digit in [*range(0, width - 7, 8), *([width - 8] if width % 8 else [])]:
        lane = word[at[left] + digit]
        by = np.lexsort((lane, g))
        g, left = _dense(_heads(g[by], lane[by])), left[by]
        keep = np.bincount(g, minlength=1)[g] > 1
        left, g = left[keep], g[keep]
    gid, gat = id0[head[t]], at0[head[t]]
    by = np.lexsort(((gat + j)[left], gid[left], g))
    left, g = left[by], g[by]
    least = left[_heads(g)][_dense(_heads(g))] if len(g) else left
    if units and len(g):
        wrong = np.isin(g, g[~same(head[t[left]], j[left], head[t[least]], j[least])])
        if wrong.any():  # units equal by chance: by the windows themselves
            names: dict[tuple, int] = {}
            g[wrong] = [names.setdefault((x, whole(int(head[t[i]]), int(j[i]))), len(names)) + int(g[-1]) + 1
                        for x, i in zip(g[wrong].tolist(), left[wrong].tolist(), strict=True)]
            by = np.argsort(g, kind="stable")  # places stay in order
            left, g = left[by], g[by]
            least = left[_heads(g)][_dense(_heads(g))]
    gid[left], gat[left] = id0[head[t[least]]], at0[head[t[least]]] + j[least] - j[left]
    begin = np.flatnonzero(_heads(t, gid, gat))
    end = np.append(begin[1:], len(t))[:len(begin)] - 1
    join = lambda *x: np.concatenate(x).astype(np.int64)
    found = (join(t[begin], one), join(j[begin], np.zeros(len(one))), join(j[end] + 1, n[one]), join(gid[begin], id0[head[one]]), join(gat[begin], at0[head[one]]))
    # Every row has the stretches of its text.
    by = np.argsort(found[0], kind="stable")
    count = np.bincount(found[0], minlength=len(head))
    from_ = np.cumsum(count) - count
    row = np.repeat(np.arange(len(key)), count[of])
    pick = by[np.arange(len(row)) - np.repeat(np.cumsum(count[of]) - count[of], count[of]) + from_[of[row]]]
    return (row, *[x[pick] for x in found[1:]])


def repeated_spans(docs: DataFrame, row_col: str, anchors, size: int, id_col: str, text_col: str, across: bool, width: int,
                   step: int, filter_bits: int = 1 << 28, hot_bits: int = 1 << 24, hot_rows: int = 4_000, units=None) -> DataFrame:
    """(_row, span) of spans (see LENGTH) covered by a window of ``size`` that also
    starts earlier: in a document of a smaller id (``across``), or there or
    earlier in the same document.  Window j of ``Runs.windows`` is its ``width``
    bytes from j x ``step`` on; or ``units(raw, off)`` makes the units of these
    texts (see ``equal_windows``).  Null ids come before all others.  ``id_col``: a
    whole number (see ``ordered_ids``).  ``docs`` and ``row_col``: from ``stored``."""
    spark = prepare(docs.sparkSession)
    keys = save(_keys(docs, anchors, text_col, across), "repeated_keys")
    known = bit_filter(keys.select("h"), filter_bits)
    hot = bit_filter(keys.where(F.col("n") >= hot_rows).select("h"), hot_bits)
    discard(keys)

    def scan(batches) -> Iterator[pa.RecordBatch]:
        bitmap, frequent = known.value, hot.value
        for batch in batches:
            raw, offsets = text_buffers(batch.column(2))
            ids = batch.column(1).cast(pa.int64()).fill_null(NULL_ID).to_numpy()
            lines = batch.column(0).to_numpy()
            parts, texts = [], []
            for lo, hi in segments(offsets):
                runs = anchors(raw, offsets, lo, hi)
                keep = np.flatnonzero(in_filter(bitmap, runs.key))
                row, key, start, count, content = runs.take(keep)
                is_hot = in_filter(frequent, key)
                texts.append((runs, keep))
                src = np.arange(len(keep))
                first = np.zeros(len(keep), np.int64)
                if is_hot.any():  # one row per window, dealt by window
                    rep = np.where(is_hot, count, 1)
                    src = np.repeat(src, rep)
                    ends = np.cumsum(rep)
                    first = np.arange(len(src)) - np.repeat(ends - rep, rep)
                    first[~is_hot[src]] = 0
                    row, key, start, is_hot = row[src], key[src], start[src] + first, is_hot[src]
                    count = np.where(is_hot, 1, count[src])
                    single = runs.window_hash(keep[src[is_hot]], first[is_hot])
                    content = content[src]
                    content[is_hot] = single
                    key = key.copy()
                    key[is_hot] = mix(key[is_hot] ^ single)
                parts.append((row, key, start, count, content, np.full(len(src), len(texts) - 1), src, first))
            if not parts:
                continue
            row, key, start, count, content, seg, src, first = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((start, ids[row], content, count, key))
            row, key, start, count, content, seg, src, first = (x[order] for x in (row, key, start, count, content, seg, src, first))
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (content[1:] != content[:-1]) | (count[1:] != count[:-1])
            heads = np.flatnonzero(new)
            sizes = np.diff(np.append(heads, len(key)))
            text: list = [None] * len(heads)
            for i, (runs, keep) in enumerate(texts):
                mine = np.flatnonzero(seg[heads] == i)
                for j, t in zip(mine.tolist(), runs.windows(keep[src[heads[mine]]], first[heads[mine]], count[heads[mine]]), strict=True):
                    text[j] = t
            ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
            for a in range(0, len(heads), 100_000):
                b = min(a + 100_000, len(heads))
                m = slice(ends[a], ends[b])
                triples = np.stack((ids[row[m]], lines[row[m]], start[m]), 1).reshape(-1)
                places = pa.ListArray.from_arrays(pa.array(((ends[a:b + 1] - ends[a]) * 3).astype(np.int32)), pa.array(triples))
                yield pa.RecordBatch.from_arrays([pa.array(signed(key[heads[a:b]])), pa.array(text[a:b], pa.binary()), places], ["key", "text", "places"])

    def spans(batch) -> pa.RecordBatch:
        """Repeats of whole groups (sorted by key)."""
        key = batch.column(0).to_numpy()
        raw, off = text_buffers(batch.column(1))
        start = batch.column(2).offsets.to_numpy().astype(np.int64) // 3
        places = batch.column(2).values.to_numpy().reshape(-1, 3)
        id0, at0 = places[start[:-1], 0], places[start[:-1], 2]
        i, a, b, gid, gat = equal_windows(key, span_hash(raw, off[:-1], off[1:]), id0, at0, raw, off, width, step, units and units(raw, off))
        n = start[i + 1] - start[i]
        s = np.repeat(np.arange(len(i)), n)
        place = places[np.arange(len(s)) - np.repeat(np.cumsum(n) - n, n) + start[i][s]]
        later = place[:, 0] > gid[s]
        if not across:
            later |= (place[:, 0] == gid[s]) & (place[:, 2] > gat[s])
        s, place = s[later], place[later]
        return pa.RecordBatch.from_arrays([pa.array(place[:, 1]), pa.array((place[:, 2] + a[s]) << LENGTH | (b - a)[s] - 1 + size)], ["_row", "span"])

    def judge(batches) -> Iterator[pa.RecordBatch]:
        held, windows = [], 0
        for batch in batches:
            held.append(batch)
            windows += batch.column(1).nbytes // TEXT_STEP if units else (batch.column(1).nbytes - batch.num_rows * width) // step + batch.num_rows
            if windows < WINDOWS:
                continue
            batch = pa.concat_batches(held)
            key = batch.column(0).to_numpy()
            cut = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
            if cut:
                yield spans(pa.concat_batches([batch.slice(0, cut)]))
            held, windows = [pa.concat_batches([batch.slice(cut)])], 0
        if held:
            yield spans(pa.concat_batches(held))

    rows = docs.select(F.col(row_col).alias("_row"), F.col(id_col), F.col(text_col)).mapInArrow(
        scan, "key long, text binary, places array<long>")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(judge, "_row long, span long")


def finish(docs: DataFrame, row_col: str, spans: DataFrame, measure, schema: str, text_col: str, filter_bits: int = 1 << 24,
           drop: tuple[str, ...] = ()) -> DataFrame:
    """``measure(text bytes, merged spans) -> tuple`` (of ``schema``) per row of
    ``docs``, with its ``row_col`` and other columns but those of ``drop`` (one
    with the name of a result is replaced)."""
    spans = save(spans.groupBy("_row").agg(F.collect_list("span").alias("_spans")), "spans")
    known = bit_filter(spans.select(F.col("_row").alias("_r"), F.xxhash64("_row").alias("h")).select("h"), filter_bits)
    names = [x.split()[0] for x in schema.split(", ")]
    others = [c for c in docs.columns if c not in (text_col, row_col, *drop, *names)]
    text, h, found = (free_name(c, docs.columns) for c in ("_text", "_h", "_spans"))
    spans = spans.select(F.col("_row").alias(row_col), F.col("_spans").alias(found))
    base = docs.select(row_col, *others, F.col(text_col).alias(text)).withColumn(h, F.xxhash64(row_col))
    head = f"`{row_col}` long, " + "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in others)

    def out(batch, keep, spans_of):
        raw, off = text_buffers(batch.column(text))
        results = [measure(raw[off[i]:off[i + 1]], merged(spans_of(i))) for i in keep]
        cols = list(zip(*results, strict=True)) if results else [[] for _ in names]
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        types = [kinds[x.split()[1]] for x in schema.split(", ")]
        idx = pa.array(keep, pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(c).take(idx) for c in [row_col, *others]] + [pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                                          [row_col, *others, *names])

    def may(batch):
        return in_filter(known.value, batch.column(h).to_numpy().view(np.uint64))

    def clean(batches):
        for batch in batches:
            yield out(batch, np.flatnonzero(~may(batch)).tolist(), lambda i: [])

    def forward(batches):
        for batch in batches:
            yield batch.filter(pa.array(may(batch)))

    def cut(batches):
        for batch in batches:
            col = batch.column(found)
            yield out(batch, range(batch.num_rows), lambda i, col=col: [(x >> LENGTH, (x >> LENGTH) + (x & (1 << LENGTH) - 1)) for x in col[i].as_py() or []])

    untouched = base.mapInArrow(clean, head + schema)
    touched = base.mapInArrow(forward, base.schema).join(spans, row_col, "left").mapInArrow(cut, head + schema)
    return untouched.union(touched)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of sorted-out spans (those that touch are one)."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]
