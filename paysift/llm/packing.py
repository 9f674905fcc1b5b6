"""Best-fit packing by a length histogram (operator 3).

Documents become token ids plus an end id, are cut into pieces of at most
``capacity`` and packed into as few sequences as best-fit decreasing finds.
The plan is made over counts, not pieces: the histogram has at most
``capacity`` rows, whatever the corpus.  Pieces then take the planned slots by
joining on their rank within their length.

Ranks come from two levels: a row number inside (bucket, length) and the
summed counts of the earlier buckets, so a length that holds a third of all
pieces (full pieces, say) is spread over all buckets.

Null and empty texts are one end token.  Repeated rows are packed each on
their own; which of two equal rows takes which of their slots is free.
"""

from __future__ import annotations

import json
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, save, segments, span_hash, text_buffers, words

#: The tokenizer never merges across these four, so the chunks between them
#: are encoded once and remembered (by content hash).
SEPARATORS = np.ones(256, bool)
SEPARATORS[[0x20, 0x09, 0x0A, 0x0D]] = False
#: Chunks remembered by a Python worker, over all its tasks.
MEMORY = 4_000_000
#: The characters that stand for bytes in the vocabulary: printable Latin-1
#: ones for themselves, the others in order from U+0100 on.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARS = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
_TABLES: dict[str, "ChunkIds"] = {}
#: What the tokenizer file must do for the cuts above to be exact.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def check_tokenizer(spec: dict) -> None:
    """Raises where ``ChunkIds`` would not give the library's ids: it cuts texts
    at white space and sends lower-case words straight to the byte-level model."""
    normal, pre, model = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    steps, parts = normal.get("normalizers", []), pre.get("pretokenizers", [])
    space = [(x.get("pattern"), x.get("content")) for x in steps if x.get("type") == "Replace"]
    if [x.get("type") for x in steps] != NORMALIZERS or space != [({"Regex": r"\s+"}, " ")]:
        raise ValueError("this tokenizer's normalizer is not NFC, white space to one space, lower case")
    if [x.get("type") for x in parts] != ["Split", "ByteLevel"] or parts[0].get("pattern") != {"Regex": SPLIT} \
            or (parts[0].get("behavior"), parts[0].get("invert")) != ("Removed", True) \
            or parts[1].get("add_prefix_space") or parts[1].get("use_regex", True):
        raise ValueError("this tokenizer's words are not those that packing cuts texts into")
    if model.get("type") != "BPE" or model.get("dropout"):
        raise ValueError("this tokenizer's model is not a BPE model without dropout")
    if any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") or x.get("normalized") or set(x["content"]) & set(" \t\n\r") for x in spec.get("added_tokens", [])):
        raise ValueError("an added token of this tokenizer depends on the text around it")


class ChunkIds:
    """Ids of chunks by content hash: sorted hashes, and each one's slice of
    one flat id array.  A full table is dropped and filled anew."""

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        check_tokenizer(json.loads(self.tokenizer.to_str()))
        self.clear()

    def clear(self) -> None:
        self.hash = np.zeros(0, np.uint64)
        self.start = self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, "<u4")

    def encode(self, text: str) -> list[int]:
        low = text.lower()
        # A word of letters is one pre-token, so its bytes go to the model as
        # the characters that stand for them (a capital sigma's lower case
        # depends on its place).
        if low.isalpha() and "\u03a3" not in text and (text.isascii() or unicodedata.is_normalized("NFC", text)):
            return [t.id for t in self.tokenizer.model.tokenize(low if low.isascii() else low.encode().decode("latin-1").translate(BYTE_CHARS))]
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def lookup(self, hashes: np.ndarray, text_of) -> np.ndarray:
        """Table positions of chunks; ``text_of(i)``: the text of chunk i."""
        distinct, first, where = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hash) + len(distinct) > MEMORY:
            self.clear()
        at = np.searchsorted(self.hash, distinct)
        missing = np.flatnonzero(self.hash[np.minimum(at, len(self.hash) - 1)] != distinct if len(self.hash) else np.ones(len(distinct), bool))
        if len(missing):
            new = [self.encode(text_of(int(first[i]))) for i in missing]
            count = np.array([len(x) for x in new], np.int64)
            start = np.cumsum(count) - count + len(self.ids)
            self.ids = np.concatenate([self.ids, *[np.array(x, "<u4") for x in new]])
            put = at[missing]
            self.hash = np.insert(self.hash, put, distinct[missing])
            self.start, self.count = np.insert(self.start, put, start), np.insert(self.count, put, count)
            at = np.searchsorted(self.hash, distinct)
        return at[where]

    def token_ids(self, raw, offsets, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of rows lo..hi-1 one after another, and each row's count.
        A full stop or comma that ends a chunk after an ASCII letter is a
        token of its own, so it is looked up apart."""
        row, s, e, h = words(raw, offsets, lo, hi, SEPARATORS, fold=False)
        if not len(row):
            return np.zeros(0, "<u4"), np.zeros(hi - lo, np.int64)
        last, before = raw[e - 1], raw[np.maximum(e - 2, s)] | 0x20
        tail = ((last == 0x2E) | (last == 0x2C)) & (e - s > 1) & (before >= 0x61) & (before <= 0x7A)
        n = len(row)
        if tail.any():  # stems first, then the marks, in text order
            mark = np.flatnonzero(tail)
            e = e.copy()
            e[mark] -= 1
            stem = span_hash(raw, s, e)
            at_word = np.arange(n) + np.cumsum(tail) - tail
            total = n + len(mark)
            s2, e2, h2, r2 = np.empty(total, np.int64), np.empty(total, np.int64), np.empty(total, np.uint64), np.empty(total, np.int64)
            for out, word, rest in ((s2, s, e[mark]), (e2, e, e[mark] + 1), (r2, row, row[mark])):
                out[at_word] = word
                out[at_word[mark] + 1] = rest
            h2[at_word] = np.where(tail, stem, h)
            h2[at_word[mark] + 1] = last[mark].astype(np.uint64)
            row, s, e, h = r2, s2, e2, h2
        text = lambda i: raw[s[i]:e[i]].tobytes().decode()
        slot = self.lookup(h, text)
        count, start = self.count[slot], self.start[slot]
        ends = np.cumsum(count)
        flat = self.ids[np.repeat(start - (ends - count), count) + np.arange(ends[-1])]
        return flat, np.bincount(row - lo, weights=count, minlength=hi - lo).astype(np.int64)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32) per piece, written once."""
    prepare(docs.sparkSession)
    end = int(end_id).to_bytes(4, "little")

    def cut(batches):
        if tokenizer_path not in _TABLES:
            _TABLES[tokenizer_path] = ChunkIds(tokenizer_path)
        ids = _TABLES[tokenizer_path]
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            row, piece, start, length, crc = [], [], [], [], []
            for lo, hi in segments(offsets):
                flat, counts = ids.token_ids(raw, offsets, lo, hi)
                data, at = memoryview(flat.tobytes()), 0
                for r, n in enumerate(counts.tolist(), lo):
                    for p, begin in enumerate(range(0, n + 1, capacity)):
                        size = min(capacity, n + 1 - begin)
                        part = data[4 * (at + begin):4 * (at + min(n, begin + size))]
                        row.append(r)
                        piece.append(p)
                        start.append(begin)
                        length.append(size)
                        crc.append(zlib.crc32(end, zlib.crc32(part)) if begin + size > n else zlib.crc32(part))
                    at += n
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())], [id_col, "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col), F.col(text_col).alias("_text")).mapInArrow(
        cut, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long")
    return save(out, "pieces")


def best_fit_plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple], int]:
    """Best-fit decreasing over counts: ``(length, first rank, last rank + 1,
    per sequence, first sequence, offset)`` events and the number of sequences.
    An event gives ``per sequence`` pieces to each of a range of sequences
    with equal room.  Each length uses each room at most once, so the events
    are bounded by capacity^2 / 2 whatever the corpus."""
    room: dict[int, list[list[int]]] = {}  # free room -> sequence ranges [first, count]
    events, made = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        for free in sorted(f for f in room if f >= length):
            per = free // length
            ranges = room.pop(free)
            while ranges and left:
                first, count = ranges.pop()
                used = min(count, left // per)
                if used:
                    events.append((length, rank, rank + used * per, per, first, capacity - free))
                    rank, left = rank + used * per, left - used * per
                    room.setdefault(free - per * length, []).append([first, used])
                if count > used and left:  # fewer than per are left: one more sequence takes them
                    events.append((length, rank, rank + left, left, first + used, capacity - free))
                    room.setdefault(free - left * length, []).append([first + used, 1])
                    rank, left, used = rank + left, 0, used + 1
                if count > used:
                    ranges.append([first + used, count - used])
            if ranges:
                room.setdefault(free, []).extend(ranges)
            if not left:
                break
        if left:
            per = capacity // length
            full, part = divmod(left, per)
            if full:
                events.append((length, rank, rank + full * per, per, made, 0))
                room.setdefault(capacity - per * length, []).append([made, full])
                made += full
                rank += full * per
            if part:
                events.append((length, rank, rank + part, part, made, 0))
                room.setdefault(capacity - part * length, []).append([made, 1])
                made += 1
    return events, made


def assign(pieces_df: DataFrame, capacity: int = 2048, id_col: str = "doc_id", per_bucket: int = 100_000) -> DataFrame:
    """Adds sequence_id and offset to pieces (with ``length``)."""
    spark = pieces_df.sparkSession
    counts = pieces_df.groupBy("length").count().collect()  # at most capacity rows
    events, _ = best_fit_plan({r["length"]: r["count"] for r in counts}, capacity)
    plan = spark.sparkContext.broadcast(_plan_arrays(events))  # a bounded number of rows (see best_fit_plan)
    buckets = max(16, sum(r["count"] for r in counts) // per_bucket)
    rows = pieces_df.withColumn("_b", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (rows.groupBy("length", "_b").agg(F.count(F.lit(1)).alias("_n"))
               .select("length", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    inside = Window.partitionBy("length", "_b").orderBy(id_col, "piece")
    ranked = (rows.withColumn("_i", F.row_number().over(inside) - 1).join(offsets, ["length", "_b"])
              .select(*pieces_df.columns, F.col("length").cast("long").alias("_length"), (F.col("_before") + F.col("_i")).cast("long").alias("_rank")))

    def take(batches):
        for batch in batches:
            rank, length = batch.column("_rank").to_numpy(), batch.column("_length").to_numpy()
            sequence, offset = slots(plan.value, length, rank)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:-2], "sequence_id", "offset"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in pieces_df.schema.fields)
    return ranked.mapInArrow(take, kinds + "sequence_id long, offset long")


def _plan_arrays(events: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """The events by length and first rank as columns, and their first places
    when pieces are counted through by length, then rank."""
    plan = np.array(sorted(events) or [(0, 0, 0, 1, 0, 0)], np.int64)
    size = plan[:, 2] - plan[:, 1]
    return plan, np.cumsum(size) - size


def slots(plan: tuple[np.ndarray, np.ndarray], length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of the pieces of these lengths and ranks, each event
    found by bisection: the events of a length hold all its ranks in order."""
    events, first = plan
    place = first[np.searchsorted(events[:, 0], length)] + rank
    n, r0, _, per, s0, o0 = events[np.searchsorted(first, place, "right") - 1].T
    return s0 + (rank - r0) // per, o0 + (rank - r0) % per * n


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """One row per piece with its sequence and its place there."""
    return assign(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col), capacity, id_col)
