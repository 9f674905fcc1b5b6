"""Byte-level BPE encoding by a prefix-sharing trie, and decoding (operator 11).

A token sequence is the encoding of its bytes exactly if each two neighbours
are, so the encoding of a word is that of a shorter prefix and one more token,
its last one.  A task's distinct words (pre-tokens) go into a trie, walked depth
first: the last token of a node is the one token that ends there and may follow
the last token of the node where it begins.  Prefixes that words share are
encoded once, and a word's ids are read back from its node.  Children in byte
order make the walk the sorted order of the words, so only one path is held.

Two tokens are neighbours if no merge crosses their border: of the tokens that
the right edge of the first and the left edge of the second go through, no two
that exist at the same time may merge (``Vocabulary.follows``).  That needs a
vocabulary whose merges come after those of their parts; others raise an error.

Texts are cut before a space that a visible character follows, where no word
goes on, and a worker keeps the ids of the pieces it met, at most ``MEMORY`` of
them.  Nothing is shuffled or broadcast, a lost task is run again from its
input, and memory doesn't grow with a text but for its own ids.

``encode`` adds an ``ids`` column, ``decode`` turns such a column into text.
Nulls and empty texts have no ids and decode to the empty text.  Rows that
repeat an id, or a whole row, are encoded each on their own.  A column that has
the name of a result is replaced, all others stay.
"""

from __future__ import annotations

import gc
import json
import re
from itertools import accumulate, chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import list_of, prepare
from .packing import BYTE_CHARS

#: Pieces (text between cuts) and words a Python worker remembers, and how long
#: they may be.  An entry takes some 150 bytes, and an executor has a worker per core.
MEMORY, LONGEST = 400_000, 64
#: Token pairs remembered.
PAIRS = 320_000
#: Characters handled at a time.
PART = 1 << 20
#: Bytes of an Arrow batch (but for a longer row): a task holds some of them, in the
#: JVM and in its two workers.
BATCH, BATCH_KEY = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
#: How the byte-level pre-tokeniser splits a text into words (a fixed pattern).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CHAR_BYTES = {chr(BYTE_CHARS.get(b, b)): b for b in range(256)}
#: A space before white space or the end: no cut there.
_NO_CUT = re.compile(r" (?=\s|$)")
#: Below it the splitting pattern and Python agree on what a letter is.
_PLAIN = "\u0500"
_NEVER = 1 << 60
_MODELS: dict[str, "Vocabulary"] = {}
_BYTES: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _read(path: str) -> tuple[dict, dict[str, int], list[bytes]]:
    """(the file's model, its added tokens, the bytes of each id of the model)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec["model"], spec["pre_tokenizer"] or {}
    if (model["type"] != "BPE" or spec["normalizer"] or model.get("dropout") or model.get("ignore_merges") or (spec["decoder"] or {}).get("type") != "ByteLevel"
            or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True)
            or any(a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"] for a in spec["added_tokens"])):
        raise ValueError("not a plain byte-level BPE file")
    added = {a["content"]: a["id"] for a in spec["added_tokens"]}
    of_ids = [b""] * (1 + max([*model["vocab"].values(), *added.values()]))
    for token, i in model["vocab"].items():
        of_ids[i] = bytes(_CHAR_BYTES[c] for c in token)
    return model, added, of_ids


class Vocabulary:
    """A byte-level BPE file: its tokens as bytes, and which may follow which."""

    def __init__(self, path: str):
        import regex
        from tokenizers import pre_tokenizers
        model, self.added, self.bytes = _read(path)
        self.words = regex.compile(WORDS)
        self.library = pre_tokenizers.ByteLevel(add_prefix_space=False)  # the file's own, as checked
        self.split = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        ids = model["vocab"]
        self.merges: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        parts = self.parts
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            x, y, t = ids[a], ids[b], ids[a + b]
            if t in parts or any(p in parts and parts[p][2] >= rank for p in (x, y)) or any(len(self.bytes[p]) > 1 and p not in parts for p in (x, y)):
                raise ValueError("this vocabulary has merges that come before those of their parts")
            self.merges[x, y], parts[t] = rank, (x, y, rank)
        whole = [len(b) == 1 for b in self.bytes]
        for t, (x, y, rank) in parts.items():  # parts come first
            whole[t] = whole[x] and whole[y] and self._apart(x, y, rank)
        # Every ending of a token: its id if it is one that its own bytes give.
        self.endings: dict[bytes, int] = {}
        for t, ok in enumerate(whole):
            for i in range(len(self.bytes[t])):
                self.endings.setdefault(self.bytes[t][i:], -1)
            if ok:
                self.endings[self.bytes[t]] = t
        for text, i in self.added.items():
            self.bytes[i] = text.encode()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.of_words: dict[bytes, bytes] = {}
        self.of_pieces: dict[str, bytes] = {}

    def _apart(self, x: int, y: int, until: int = _NEVER) -> bool:
        """No merge of a rank under ``until`` crosses the border of x and y.  Of
        two equal merges the left one is made first."""
        merges, lefts = self.merges, self._edge(y, 0)
        return not any((m := merges.get((a, b), until)) < until and m < end_a and m <= end_b for a, end_a in self._edge(x, 1) for b, end_b in lefts)

    def _edge(self, t: int, side: int) -> list[tuple[int, int]]:
        """The tokens at the left (0) or right (1) edge of a token, from the whole one
        down to a byte, and the merge that ends each."""
        out, parts = [(t, _NEVER)], self.parts
        while part := parts.get(t):
            t = part[side]
            out.append((t, part[2]))
        return out

    def follows(self, x: int, y: int) -> bool:
        """Do the bytes of tokens x and y encode to just these two?"""
        found = self.pairs.get((x, y))
        if found is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            found = self.pairs[x, y] = self._apart(x, y)
        return found

    def walk(self, words: list[bytes]) -> list[list[int]]:
        """Ids of sorted distinct words, depth first through their trie.  Just
        one token may end at a node, so the likely ones are tried first."""
        endings, pairs, follows = self.endings, self.pairs, self.follows
        get = endings.get
        size = [len(b) for b in self.bytes]
        last: list[int] = []  # the last token of each prefix on the path
        before, out = b"", []
        for word in words:
            shared = 0
            for x, y in zip(before, word, strict=False):
                if x != y:
                    break
                shared += 1
            del last[shared:]
            # Where the last token of the prefix before begins: it may go on.
            tried = shared - size[last[-1]] if last else 0
            for end in range(shared + 1, len(word) + 1):
                t = get(word[tried:end], -1)
                if t >= 0:
                    if not tried:
                        last.append(t)
                        continue
                    ok = pairs.get((last[tried - 1], t))
                    if ok or (ok is None and follows(last[tried - 1], t)):
                        last.append(t)
                        continue
                # All others, from the shortest on.
                for begin in range(end - 1, -1, -1):
                    t = endings[word[begin:end]]
                    if t >= 0 and begin != tried:
                        if not begin:
                            break
                        ok = pairs.get((last[begin - 1], t))
                        if ok or (ok is None and follows(last[begin - 1], t)):
                            break
                tried = begin
                last.append(t)
            ids, end = [], len(word)
            while end:
                t = last[end - 1]
                ids.append(t)
                end -= size[t]
            out.append(ids[::-1])
            before = word
        return out

    def words_of(self, piece: str) -> list[bytes]:
        word = piece[1:] if piece[0] == " " else piece
        if word.isalpha() and (piece.isascii() or max(word) < _PLAIN):
            return [piece.encode()]
        if word[:-1].isalpha() and word[-1] in ".,;:!?" and (piece.isascii() or max(word) < _PLAIN):
            return [piece[:-1].encode(), word[-1].encode()]
        if piece.isascii():
            return [w.encode() for w in self.words.findall(piece)]
        return [bytes(map(_CHAR_BYTES.__getitem__, w)) for w, _ in self.library.pre_tokenize_str(piece)]

    def encode_pieces(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids (as little-endian 32-bit ones) of distinct pieces: the distinct
        new words of all of them are walked at once."""
        out = {p: np.array([i], "<i4").tobytes() for p, i in self.added.items() if p in pieces}
        words = {p: self.words_of(p) for p in pieces if p not in out}
        ids = self.of_words
        distinct = sorted({w for ws in words.values() for w in ws if w not in ids})
        if len(ids) + len(distinct) > MEMORY:
            ids = self.of_words = _kept(ids, chain.from_iterable(words.values()))
        walked = self.walk(distinct)
        every = np.fromiter(chain.from_iterable(walked), "<i4").tobytes()
        ends = list(accumulate([4 * len(x) for x in walked], initial=0))
        ids.update((w, every[lo:hi]) for w, lo, hi in zip(distinct, ends, ends[1:], strict=False))
        out.update((p, ids[ws[0]] if len(ws) == 1 else b"".join([ids[w] for w in ws])) for p, ws in words.items())
        for w in distinct:
            if len(w) > LONGEST:
                del ids[w]
        return out

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; ``texts`` together are about PART characters."""
        cut = [self.cuts(t) for t in texts]
        known = self.of_pieces
        found = [list(map(known.get, ps)) for ps in cut]
        new = self.encode_pieces({p for ps, ids in zip(cut, found, strict=True) if None in ids for p, x in zip(ps, ids, strict=True) if x is None})
        if len(known) + len(new) > MEMORY:
            known = self.of_pieces = _kept(known, chain.from_iterable(cut))
        known |= new
        out = [b"".join([known[p] if x is None else x for p, x in zip(ps, ids, strict=True)] if None in ids else ids) for ps, ids in zip(cut, found, strict=True)]
        for p in new:
            if len(p) > LONGEST:
                del known[p]
        return out

    def cuts(self, text: str) -> list[str]:
        """Pieces of a text; an added token is one of its own."""
        if any(x in text for x in self.added):
            return [x for i, p in enumerate(self.split.split(text)) for x in ([p] if i % 2 else pieces(p))]
        return pieces(text)


def pieces(text: str) -> list[str]:
    """``text`` cut before each space that visible text follows (a surrogate,
    which no text holds, marks the places)."""
    if not text:
        return []
    out = text.replace(" ", "\ud800 ").split("\ud800")
    if _NO_CUT.search(text):
        runs = [[out[0]]]
        for p in out[1:]:
            if len(p) == 1 or p[1].isspace():
                runs[-1].append(p)
            else:
                runs.append([p])
        out = ["".join(r) for r in runs]
    return out if out[0] else out[1:]


def slices(text: str, added) -> list[str]:
    """A long text in parts of about PART characters, cut where no word and no
    added token goes on."""
    out, at = [], 0
    margin = max([len(a) for a in added] + [1])
    while len(text) - at > PART:
        end = text.find(" ", at + PART)
        while end >= 0 and (end + 1 == len(text) or text[end + 1].isspace() or any(a in text[max(at, end - margin):end + margin] for a in added)):
            end = text.find(" ", end + 1)
        if end < 0:
            break
        out.append(text[at:end])
        at = end
    out.append(text[at:])
    return out


def _kept(known: dict, used) -> dict:
    """The younger half of what is known, and all that is in use."""
    return dict(islice(known.items(), len(known) // 2, None)) | {x: known[x] for x in used if x in known}


def vocabulary(path: str) -> Vocabulary:
    if path not in _MODELS:
        _MODELS[path] = Vocabulary(path)
    return _MODELS[path]


def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all tokens, where each begins, how many it has); a last one, for
    ids that the file lacks, has none.  Decoding needs no more of a file."""
    if path not in _BYTES:
        _, added, of_ids = _read(path)
        for text, i in added.items():
            of_ids[i] = text.encode()
        size = np.array([len(b) for b in of_ids] + [0])
        _BYTES[path] = np.frombuffer(b"".join(of_ids), np.uint8), np.cumsum(size) - size, size
    return _BYTES[path]


def _groups(column: pa.Array):
    """Index ranges of texts of about PART bytes together."""
    lo, total = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).tolist()):
        total += n
        if total >= PART:
            yield lo, i + 1
            lo, total = i + 1, 0
    if lo < len(column):
        yield lo, len(column)


def _with(df: DataFrame, name: str, kind: str, source: str, make) -> DataFrame:
    """``df`` with column ``name`` made from Arrow column ``source`` by
    ``make(column) -> [(rows, array)...]``, one output batch each."""
    prepare(df.sparkSession).conf.set(BATCH_KEY, str(BATCH))
    others = [c for c in df.columns if c.lower() != name.lower()]
    wanted = df.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{source}`").alias("\x00source"))
    schema = ", ".join(f"`{c}` {wanted.schema[c].dataType.simpleString()}" for c in others)

    def run(batches):
        for batch in batches:
            for lo, n, made in make(batch.column(len(others))):
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(lo, n) for i in range(len(others))] + [made], [*others, name])

    return wanted.mapInArrow(run, f"{schema}, `{name}` {kind}" if schema else f"`{name}` {kind}")


def encode(docs: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """``docs`` and ``ids array<int>``, the token ids of each text."""
    def make(column):
        model = vocabulary(tokenizer_path)
        for lo, hi in _groups(column):
            texts = [t or "" for t in column.slice(lo, hi - lo).to_pylist()]  # a group's alone
            gc.disable()  # many small objects, none in cycles
            try:
                found = model.encode_texts(texts) if hi - lo > 1 else [b"".join(model.encode_texts([s])[0] for s in slices(texts[0], model.added))]
            finally:
                gc.enable()
            yield lo, hi - lo, list_of(np.frombuffer(b"".join(found), "<i4"), np.array([len(x) // 4 for x in found]), pa.int32())

    return _with(docs, "ids", "array<int>", text_col, make)


def decode(df: DataFrame, tokenizer_path: str, ids_col: str = "ids") -> DataFrame:
    """``df`` and ``decoded string``: the text of its ``ids``, added tokens
    included.  Ids that the vocabulary lacks have no text; bytes that aren't
    UTF-8 become replacement characters."""
    def make(column):
        data, start, size = token_bytes(tokenizer_path)
        if column.null_count:
            column = pa.array([x or [] for x in column.to_pylist()], pa.list_(pa.int32()))
        off, step = column.offsets.to_numpy(), max(1, PART // 8)
        lo = 0
        while lo < len(column):
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + PART, "right")) - 1)
            texts = []
            for i in range(lo, hi):
                out = []
                for a in range(off[i], off[i + 1], step):
                    ids = column.values.slice(a, min(step, off[i + 1] - a)).fill_null(-1).to_numpy()
                    ids = np.where((ids >= 0) & (ids < len(size) - 1), ids, len(size) - 1)
                    n = size[ids]
                    ends = np.cumsum(n)
                    out.append(data[np.repeat(start[ids] - (ends - n), n) + np.arange(ends[-1] if len(n) else 0)].tobytes())
                texts.append(b"".join(out).decode("utf-8", "replace"))
            yield lo, hi - lo, pa.array(texts, pa.string())
            lo = hi

    return _with(df, "decoded", "string", ids_col, make)
