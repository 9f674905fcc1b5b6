r"""Chat formatting as a prefix tree (operator 1).

Conversations that share initial turns share their nodes: each distinct prefix
of turns is emitted once, in depth-first order, into one token stream (a token
is a code point of the formatted text).  Each node carries its place in the
stream, the position id of its first token (the length of its prefix, so a
branch goes on counting from its parent) and the intervals of the stream its
tokens attend to besides those before them in the node: its ancestors.

Template of a turn: ``<turn ROLE>\nTEXT</turn>\n``.  In texts and roles ``\``
and ``<`` (in roles also ``>``) get a ``\`` before them, so the control strings
never occur inside a text, and removing it gives the text back.  The loss mask
covers the TEXT of assistant turns.

Depth-first order without a driver-side tree: equal conversations are one row;
the rows are sorted by the hashes of their turns (range partitions, so one first
turn shared by a third of all rows is spread), which puts each subtree
together.  A node belongs to the first row that has it, and the nodes of a row
are consecutive, so places are a running sum over rows in two levels (rows
inside a partition, partitions).  A conversation is handled as one unit.

Null roles and texts are empty.  Turns are ordered by turn (nulls first), then
role and text; repeated rows are turns of their own.  Rows with a null conv_id
are one conversation.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, save

ASSISTANT = "assistant"
#: Rows of a node that one task of a join takes; nodes with more are dealt out.
HOT_ROWS = 20_000
_ESCAPE = re.compile(r"[\\<]")
_ESCAPE_ROLE = re.compile(r"[\\<>]")
_PLAIN = re.compile(r"\\(.)", re.S)
TURN = re.compile(r"<turn ([^\\<>]*(?:\\.[^\\<>]*)*)>\n([^\\<]*(?:\\.[^\\<]*)*)</turn>\n", re.S)


def render(role: str, text: str) -> tuple[str, int]:
    """A formatted turn and where its text starts."""
    head = f"<turn {_ESCAPE_ROLE.sub(lambda m: chr(92) + m[0], role)}>\n"
    return head + _ESCAPE.sub(lambda m: "\\" + m[0], text) + "</turn>\n", len(head)


def unescape(text: str) -> str:
    return _PLAIN.sub(r"\1", text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation; raises on anything else."""
    out, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if not m:
            raise ValueError(f"not a turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def _with_nodes(paths: DataFrame, nodes: DataFrame, by: str, hot_rows: int) -> DataFrame:
    """``paths`` joined with ``nodes`` on node.  A node of more than ``hot_rows``
    rows (a first turn that many conversations share) is sent to as many tasks
    as its rows need, which are dealt by ``by``."""
    parts = F.ceil(F.col("count") / F.lit(hot_rows)).cast("int").alias("_parts")
    hot = F.broadcast(paths.groupBy("node").count().where(F.col("count") > hot_rows).select("node", parts))  # <= rows / hot_rows rows
    salt = F.when(F.col("_parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(by), F.col("_parts")).cast("int"))
    dealt = F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
    left = paths.join(hot, "node", "left").withColumn("_salt", salt).drop("_parts")
    return left.join(nodes.join(hot, "node", "left").withColumn("_salt", dealt).drop("_parts"), ["node", "_salt"]).drop("_salt")


_INTERVALS = "array<struct<start:long,end:long>>"


def prefix_tree(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes: node, parent, depth, start, length, position (of the first token),
    attends (intervals), loss_start and loss_end (places, null without loss),
    text; paths: leaf, depth, node; members: conv_id, leaf (its last node)."""
    spark = prepare(conversations.sparkSession)
    kind = conversations.schema[conv_id].dataType.simpleString()
    units = conversations.groupBy(conv_id).agg(F.sort_array(F.collect_list(F.struct(
        F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")))).alias("turns"))

    def paths(batches):
        for batch in batches:
            leaves, keys = [], []
            for turns in batch.column(1).to_pylist():
                node, path = b"", []
                for t in turns:
                    r, x = t["role"].encode(), t["text"].encode()
                    node = hashlib.md5(b"%s%d:%s%s" % (node, len(r), r, x)).digest()
                    path.append(node[:8])
                leaves.append(node)
                keys.append(b"".join(path))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(leaves, pa.binary()), pa.array(keys, pa.binary()), batch.column(1)], [conv_id, "leaf", "path", "turns"])

    turns_type = units.schema["turns"].dataType.simpleString()
    placed = save(units.mapInArrow(paths, f"`{conv_id}` {kind}, leaf binary, path binary, turns {turns_type}"), "conversations")
    distinct = placed.groupBy("leaf").agg(F.first("path").alias("path"), F.first("turns").alias("turns"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = distinct.repartitionByRange(parts, "path").sortWithinPartitions("path")
    rows = save(ordered.select(F.monotonically_increasing_id().alias("row"), "leaf", "turns"), "ordered_conversations")

    def steps(batches):
        for batch in batches:
            out = []
            for row, leaf, turns in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                node, at = b"", 0
                for d, t in enumerate(turns):
                    r, x = t["role"].encode(), t["text"].encode()
                    parent, node = node, hashlib.md5(b"%s%d:%s%s" % (node, len(r), r, x)).digest()
                    size = len(render(t["role"], t["text"])[0])
                    out.append((row, leaf, d, parent, node, at, size))
                    at += size
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()], strict=True)],
                                             ["row", "leaf", "depth", "parent", "node", "position", "length"])

    path = save(rows.mapInArrow(steps, "row long, leaf binary, depth int, parent binary, node binary, position long, length long"), "paths")
    owned = path.groupBy("node").agg(F.min("row").alias("owner"), F.first("position").alias("position"), F.first("length").alias("length"))
    owned = save(owned, "nodes")
    # Places: a running sum over owners, in two levels.
    segment = owned.groupBy("owner").agg(F.sum("length").alias("size"), F.min("position").alias("from")).withColumn("part", F.shiftright("owner", 33))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    of_part = segment.groupBy("part").agg(F.sum("size").alias("size")).select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("owner").rowsBetween(Window.unboundedPreceding, -1)
    segment = (segment.withColumn("sum", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(F.broadcast(of_part), "part")  # a row per partition
               .select("owner", (F.col("base") + F.col("sum") - F.col("from")).alias("shift")))
    at = owned.join(segment, "owner").select("node", "owner", (F.col("shift") + F.col("position")).alias("start"))
    lines = _with_nodes(path, at, "row", hot_rows).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("depth", "parent", "node", "position", "length", "owner", "start"))).alias("nodes"))

    def emit(batches):
        for batch in batches:
            out = []
            for row, nodes, turns in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                seen: list[dict] = []
                for n, t in zip(nodes, turns, strict=True):
                    if n["owner"] == row:
                        formatted, head = render(t["role"], t["text"])
                        loss = t["role"] == ASSISTANT
                        end = n["start"] + len(formatted) - len("</turn>\n")
                        out.append((n["node"], n["parent"], n["depth"], n["start"], n["length"], n["position"], [dict(x) for x in seen],
                                    n["start"] + head if loss else None, end if loss else None, formatted))
                    if seen and seen[-1]["end"] == n["start"]:
                        seen[-1]["end"] += n["length"]
                    else:
                        seen.append({"start": n["start"], "end": n["start"] + n["length"]})
            cols = list(zip(*out, strict=True)) if out else [[]] * 10
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            types = [pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), span, pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types, strict=True)],
                                             ["node", "parent", "depth", "start", "length", "position", "attends", "loss_start", "loss_end", "text"])

    nodes = lines.join(rows.select("row", "turns"), "row").select("row", "nodes", "turns").mapInArrow(
        emit, f"node binary, parent binary, depth int, start long, length long, position long, attends {_INTERVALS}, loss_start long, loss_end long, text string")
    return save(nodes, "prefix_tree"), path.select("leaf", "depth", "node"), placed.select(conv_id, "leaf")


def read_back(nodes: DataFrame, paths: DataFrame, members: DataFrame, conv_id: str = "conv_id", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Per conversation, read from the tree alone: n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars (see the contract of operator 1)."""
    parts = F.sort_array(F.collect_list(F.struct("depth", "text", "start", "loss_start", "loss_end"))).alias("parts")
    whole = _with_nodes(paths, nodes.drop("depth"), "leaf", hot_rows).groupBy("leaf").agg(parts)

    def digest(batches):
        for batch in batches:
            out = []
            for parts in batch.column(1).to_pylist():
                formatted = "".join(p["text"] for p in parts)
                turns = parse(formatted)
                said = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                loss = "".join(unescape(p["text"][p["loss_start"] - p["start"]:p["loss_end"] - p["start"]]) for p in parts if p["loss_start"] is not None)
                out.append((len(turns), said, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(c, k) for c, k in zip(cols, types, strict=True)],
                                             ["leaf", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    digests = whole.mapInArrow(digest, "leaf binary, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return members.join(digests, "leaf").drop("leaf")
