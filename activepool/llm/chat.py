"""Chat formatting from reply trees.

Messages form trees (each names its parent). Root-to-leaf paths are enumerated by iterative self-joins
with doubled steps: after k rounds a leaf knows its ancestors up to 2^k - 1 steps away, and every message
its ancestor 2^k steps away, so a chain of n messages takes log2(n) rounds over narrow rows of ids. Branches
are ranked by the mean score of their messages, the best ones of each tree are chosen, and each is
formatted as one conversation. Texts join only the chosen paths.

A turn is written ``### <role>: <text></turn>`` and a line break. Inside roles and texts every backslash, ``#``
and ``<`` gets a backslash in front of it, so no text can hold a control string, and the escape is undone by
dropping one backslash before each such character.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from activepool.llm.common import bounded
from activepool.session import pinned

OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
_CONTROL = re.compile(r"[\\#<]")
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turns(turns: list[tuple[str, str]], learn_role: str = "assistant") -> tuple[str, list[int], list[int]]:
    """The conversation as one text, and the starts and ends of its loss mask in code points."""
    parts, starts, ends, at = [], [], [], 0
    for role, text in turns:
        head, body = OPEN + escape(role).replace(":", "\\:") + MIDDLE, escape(text)
        if role == learn_role:
            starts.append(at + len(head))
            ends.append(at + len(head) + len(body))
        parts += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), starts, ends


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""

    def upto(mark: str, at: int) -> int:
        """The next ``mark`` whose first character isn't escaped."""
        while True:
            at = formatted.index(mark, at)
            back = at
            while back and formatted[back - 1] == "\\":
                back -= 1
            if (at - back) % 2 == 0:
                return at
            at += 1

    turns, at = [], 0
    while at < len(formatted):
        middle = upto(MIDDLE, at + len(OPEN))
        end = upto(CLOSE, middle + len(MIDDLE))
        turns.append((unescape(formatted[at + len(OPEN) : middle]), unescape(formatted[middle + len(MIDDLE) : end])))
        at = end + len(CLOSE)
    return turns


def chain(rows: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """Messages (conv_id, node, parent, role, text, score) of conversations given as rows by turn.

    Rows of one turn follow each other by role and text; nulls come first.
    """
    picked = rows.select(*[F.col(f"`{c}`").alias(n) for c, n in ((conv_col, "conv_id"), (turn_col, "turn"), (role_col, "role"), (text_col, "text"))])
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    node = F.row_number().over(order).cast("long")
    return picked.select("conv_id", node.alias("node"), "role", "text", F.lit(0.0).alias("score")).select(
        "conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", "score"
    )


def paths(messages: DataFrame) -> DataFrame:
    """(conv_id, leaf, node, dist) for every leaf and each message on its way to the root.

    A message whose parent is missing is a root. Raises ValueError if parents run in a circle that a leaf
    hangs on; messages of a circle without a leaf are on no path.
    """
    nodes = pinned(messages.select("conv_id", "node", "parent").where("node IS NOT NULL").distinct(), "chat-nodes")
    up = nodes.alias("c").join(
        nodes.select(F.col("conv_id").alias("pc"), F.col("node").alias("pn")).alias("p"),
        F.col("c.conv_id").eqNullSafe(F.col("pc")) & (F.col("c.parent") == F.col("pn")),
    )
    up = pinned(up.select("conv_id", "node", F.col("pn").alias("far")).distinct(), "chat-up")
    inner = up.select(F.col("conv_id").alias("pc"), F.col("far").alias("pn")).distinct()
    leaves = nodes.join(inner, F.col("conv_id").eqNullSafe(F.col("pc")) & (F.col("node") == F.col("pn")), "left_anti")
    found = pinned(leaves.select("conv_id", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("dist")).distinct(), "chat-paths")
    step, most = 1, nodes.count()
    while up.limit(1).count():
        if step > most:
            raise ValueError("parents run in a circle")
        jump = up.select(F.col("conv_id").alias("jc"), F.col("node").alias("jn"), F.col("far").alias("jf"))
        same = F.col("conv_id").eqNullSafe(F.col("jc"))
        more = found.join(jump, same & (F.col("node") == F.col("jn"))).select("conv_id", "leaf", F.col("jf").alias("node"), (F.col("dist") + step).alias("dist"))
        found = pinned(found.union(more), "chat-paths")
        # Only messages that a path has reached need to go on.
        up = pinned(up.join(jump, same & (F.col("far") == F.col("jn"))).select("conv_id", "node", F.col("jf").alias("far")), "chat-up")
        step *= 2
    return found


def branches(messages: DataFrame, top: int | None = None) -> DataFrame:
    """(conv_id, leaf, rank, node, dist) of each tree's best paths: mean score down, then the smaller leaf.

    A message without a score counts 0; ``top`` None keeps every path.
    """
    found = paths(messages)
    scores = messages.select(F.col("conv_id").alias("sc"), F.col("node").alias("sn"), F.coalesce("score", F.lit(0.0)).alias("score"))
    same = F.col("conv_id").eqNullSafe(F.col("sc")) & (F.col("node") == F.col("sn"))
    means = found.join(scores, same).groupBy("conv_id", "leaf").agg(F.avg("score").alias("mean"))
    ranked = means.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("mean"), "leaf")))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    ranked = ranked.select(F.col("conv_id").alias("rc"), F.col("leaf").alias("rl"), "rank")
    return found.join(ranked, F.col("conv_id").eqNullSafe(F.col("rc")) & (F.col("leaf") == F.col("rl"))).select("conv_id", "leaf", "rank", "node", "dist")


def _formatted(learn_role: str):
    schema = pa.schema([("conv_id", pa.int64()), ("leaf", pa.int64()), ("rank", pa.int32()), ("formatted", pa.string()),
                        ("loss_starts", pa.list_(pa.int64())), ("loss_ends", pa.list_(pa.int64()))])

    def run(batches):
        for batch in bounded(batches, 4 << 20):
            made = [format_turns([(t["role"] or "", t["text"] or "") for t in turns.as_py()], learn_role) for turns in batch.column("turns")]
            text, starts, ends = (list(x) for x in zip(*made))
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("leaf"), batch.column("rank"), pa.array(text, pa.string()),
                 pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))], schema=schema)

    return run


def format_conversations(messages: DataFrame, top: int | None = 1, learn_role: str = "assistant") -> DataFrame:
    """(conv_id, leaf, rank, formatted, loss_starts, loss_ends): one row for each chosen path.

    ``messages`` has conv_id, node, parent, role, text, score. The loss mask covers the texts of
    ``learn_role``, in code points of ``formatted``; escapes inside belong to it.

    Edge cases: null roles and texts are empty; a tree of one message is one path; rows that repeat a node
    are one message (the least role and text); null conversation ids are one tree of their own; an empty
    table gives an empty one. A conversation is one row of the result and has to fit in a task.
    """
    one = messages.groupBy("conv_id", "node").agg(
        F.min(F.struct("parent", "role", "text", "score")).alias("m")
    ).select("conv_id", "node", "m.*")
    chosen = branches(one, top)
    texts = one.select(F.col("conv_id").alias("tc"), F.col("node").alias("tn"), "role", "text")
    turns = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("dist")).alias("at"), "role", "text"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    rows = (
        chosen.join(texts, F.col("conv_id").eqNullSafe(F.col("tc")) & (F.col("node") == F.col("tn")))
        .groupBy("conv_id", "leaf", "rank").agg(turns.alias("turns"))
    )
    return rows.mapInArrow(
        _formatted(learn_role),
        "conv_id long, leaf long, rank int, formatted string, loss_starts array<long>, loss_ends array<long>",
    )


def _read_back(batches):
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                        ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for batch in bounded(batches, 4 << 20):
        rows = []
        for r in batch.to_pylist():
            turns = parse_turns(r["formatted"])
            loss = "".join(unescape(r["formatted"][a:b]) for a, b in zip(r["loss_starts"], r["loss_ends"]))
            rows.append([r["conv_id"], len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(loss), sha(loss), len(r["formatted"])])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of turns and loss text, parsed from the formatted conversations alone."""
    return formatted.select("conv_id", "formatted", "loss_starts", "loss_ends").mapInArrow(
        _read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
