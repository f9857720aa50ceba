"""Conversations as one prefix tree: turns that several conversations start with are formatted once.

A turn's node is named by a hash of all turns up to it. The tree is laid out depth first,
children by the smallest conversation below them, so a node and the chain of its first
children lie side by side. Every node gets its place in the layout, the positions of its tokens
along its own path, and the intervals of the layout that it may attend to: its ancestors
and itself. No conversation but the one being read is held, and of that one only a hash and
its branchings, so a conversation may have any number of turns; its digest needs them one
after another in one task.

Template: ``[INST] text [/INST]`` for the user, `` text </s>`` for the assistant, and
``<<SYS>>role``, a line end, ``text<</SYS>>`` for any other role. Control strings inside a text are
broken up by a backslash after their first character; backslashes are doubled.

Defined cases: NULL texts and roles are empty; turns go by (turn, role, text), NULLs first, so ties and
repeated rows have a fixed order and each counts; rows whose conv_id is NULL belong to no
conversation and are left out; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tuneprep.llm.token_ids import encoder
from tuneprep.storage import materialize

CONTROLS = ("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>")
ESCAPED = re.compile("|".join([re.escape(c) for c in CONTROLS] + [r"\\"]))
ESCAPE = re.compile(r"\\(.)", re.S)
USER, ASSISTANT = "user", "assistant"


def escape(text: str) -> str:
    """No control string is left, and :func:`unescape` gives the text back."""
    return ESCAPED.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return ESCAPE.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn as formatted text, and where the text under the loss mask starts and ends in it."""
    body = escape(text)
    if role == USER:
        return f"[INST] {body} [/INST]", 0, 0
    if role == ASSISTANT:
        return f" {body} </s>", 1, 1 + len(body)
    return f"<<SYS>>{escape(role).replace(chr(10), chr(92) + 'n')}\n{body}<</SYS>>", 0, 0


def parse_turn(formatted: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    if formatted.startswith("[INST] "):
        return USER, unescape(formatted[7:-8])
    if formatted.startswith("<<SYS>>"):
        role, _, text = formatted[7:-8].partition("\n")
        return unescape(role), unescape(text)
    return ASSISTANT, unescape(formatted[1:-5])


def _blocks(batches: Iterator[pa.RecordBatch], fold: Callable, schema: pa.Schema, rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """Run ``fold`` over the rows of a sorted partition and pack what it yields into batches."""
    out: list[tuple] = []
    source = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns], strict=True))
    for row in fold(source):
        out.append(row)
        if len(out) == rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


TURNS = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("node", pa.binary()), ("role", pa.string()), ("text", pa.string())])


def _name(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(conv_id, role, text) in order -> depth and node name: a hash over the conversation so far."""
    conversation, chain, depth = None, b"", 0
    for conv_id, role, text in rows:
        if conv_id != conversation:
            conversation, chain, depth = conv_id, b"", 0
        parts = [x.encode() for x in (role, text)]
        chain = hashlib.sha256(chain + b"".join(len(x).to_bytes(8, "big") + x for x in parts)).digest()[:16]
        yield conv_id, depth, chain, role, text
        depth += 1


STEP = pa.struct([("up", pa.int64()), ("owner", pa.int64())])
SEGMENT = pa.struct([("owner", pa.int64()), ("depth", pa.int64()), ("tokens", pa.int64())])
PLACED = pa.schema(
    [
        ("conv_id", pa.int64()), ("depth", pa.int64()), ("owner", pa.int64()), ("head", pa.int64()),
        ("path", pa.list_(STEP)), ("segments", pa.list_(SEGMENT)), ("position", pa.int64()),
        ("formatted", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64()),
        ("input_ids", pa.list_(pa.int32())), ("tokens", pa.int64()),
    ]
)


def _place(rows: Iterator[tuple], tokenizer: str) -> Iterator[tuple]:
    """Turns with their node's owner (its smallest conversation) -> layout key, ancestors, position, tokens.

    The layout key is the list of (minus depth, owner) at which the owner changes: depth-first
    order is the order of these lists, then of depth. The payload goes with the owner's row only.
    """
    import numpy as np

    encode = encoder(tokenizer)
    conversation, last = None, None
    for conv_id, depth, role, text, owner in rows:
        if conv_id != conversation:
            conversation, last, path, segments, position, inside = conv_id, None, [], [], 0, 0
        if owner != last:
            if last is not None:
                segments = [*segments, (last, head, inside)]
            path, last, head, inside = [*path, (-depth, owner)], owner, depth, 0
        formatted, loss_start, loss_end = format_turn(role, text)
        ids = np.frombuffer(encode.encode([formatted])[0], f"<u{encode.width}")
        own = owner == conv_id
        yield (
            conv_id, depth, owner, head, [{"up": u, "owner": o} for u, o in path] if own else None,
            [{"owner": o, "depth": d, "tokens": t} for o, d, t in segments] if own and depth == head else None,
            position, formatted if own else None, loss_start, loss_end, ids.astype(np.int32) if own else None, len(ids),
        )
        position += len(ids)
        inside += len(ids)


def build_tree(conversations: DataFrame, tokenizer: str) -> tuple[DataFrame, DataFrame]:
    """The laid-out nodes, and every turn's node.

    Nodes: owner and depth (their name), start, tokens, position (of the first token; the others
    follow), formatted, loss_start, loss_end, input_ids, intervals [(start, stop)]. Turns: conv_id,
    depth, owner.
    """
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text")}
    turns = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    turns = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").withColumns(text)
    named = materialize(
        turns.select("conv_id", "role", "text").mapInArrow(
            lambda b: _blocks(b, _name, TURNS), "conv_id long, depth long, node binary, role string, text string"
        ),
        "chat-turns",
    )
    shared = named.groupBy("node").agg(F.min("conv_id").alias("_owner"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    owned = named.join(shared.drop("_n"), "node", "left").select(
        "conv_id", "depth", "role", "text", F.coalesce("_owner", "conv_id").alias("owner")
    )
    placed = materialize(
        owned.repartition("conv_id")
        .sortWithinPartitions("conv_id", "depth")
        .mapInArrow(
            lambda b: _blocks(b, lambda rows: _place(rows, tokenizer), PLACED),
            "conv_id long, depth long, owner long, head long, path array<struct<up:long,owner:long>>, "
            "segments array<struct<owner:long,depth:long,tokens:long>>, position long, formatted string, "
            "loss_start long, loss_end long, input_ids array<int>, tokens long",
        ),
        "chat-placed",
    )
    layout = materialize(
        placed.where("conv_id = owner")
        .select("owner", "depth", "path", "tokens")
        .repartitionByRange("path", "depth")
        .sortWithinPartitions("path", "depth")
        .withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()}),
        "chat-layout",
    )
    # One row per partition, so the table of their starts is small.
    parts = layout.groupBy("part").agg(F.sum("tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        layout.withColumn("local", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
        .join(F.broadcast(parts), "part")
        .select("owner", "depth", (F.col("base") + F.col("local")).alias("start"))
    )
    starts = materialize(starts, "chat-starts")

    # What a chain's head sees above itself, then every node of that chain.
    heads = placed.where("conv_id = owner and depth = head").select("owner", "depth", "segments")
    above = (
        heads.select(F.col("owner").alias("to_owner"), F.col("depth").alias("to_depth"), F.inline("segments").alias("owner", "depth", "length"))
        .join(starts, ["owner", "depth"])
        .groupBy("to_owner", "to_depth")
        .agg(F.sort_array(F.collect_list(F.struct("start", (F.col("start") + F.col("length")).alias("stop")))).alias("above"))
    )
    head_starts = starts.select(F.col("owner"), F.col("depth").alias("head"), F.col("start").alias("head_start"))
    nodes = (
        placed.where("conv_id = owner")
        .drop("conv_id", "path", "segments")
        .join(starts, ["owner", "depth"])
        .join(head_starts, ["owner", "head"])
        .join(above.withColumnsRenamed({"to_owner": "owner", "to_depth": "head"}), ["owner", "head"], "left")
    )
    own = F.array(F.struct(F.col("head_start").alias("start"), (F.col("start") + F.col("tokens")).alias("stop")))
    intervals = F.when(F.col("above").isNull(), own).otherwise(F.concat("above", own))
    nodes = nodes.withColumn("intervals", intervals).drop("above", "head_start", "head")
    return materialize(nodes, "chat-nodes"), placed.select("conv_id", "depth", "owner")


DIGESTS = pa.schema(
    [
        ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
    ]
)


def _digest(rows: Iterator[tuple]) -> Iterator[tuple]:
    conversation = None
    for conv_id, formatted, loss_start, loss_end in rows:
        if conv_id != conversation:
            if conversation is not None:
                yield conversation, n, turns.hexdigest(), chars, loss.hexdigest(), length
            conversation, n, chars, length = conv_id, 0, 0, 0
            turns, loss = hashlib.sha256(), hashlib.sha256()
        turns.update("".join(f"{part}\n" for part in parse_turn(formatted)).encode())
        target = unescape(formatted[loss_start:loss_end])
        loss.update(target.encode())
        n, chars, length = n + 1, chars + len(target), length + len(formatted)
    if conversation is not None:
        yield conversation, n, turns.hexdigest(), chars, loss.hexdigest(), length


def read_tree(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """Per conversation, put together again from the tree: its turns and what the loss covers."""
    texts = turns.join(nodes.select("owner", "depth", "formatted", "loss_start", "loss_end"), ["owner", "depth"])
    ordered = texts.repartition("conv_id").sortWithinPartitions("conv_id", "depth")
    return ordered.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(
        lambda b: _blocks(b, _digest, DIGESTS),
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )
