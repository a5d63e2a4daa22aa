"""Operator 9: reply trees to chat-formatted conversations.

Messages (tree, node, parent, role, text, score) form trees of replies. Self-joins that double their reach each time find every
message's ancestors 1, 2, 4, ... steps up, its depth and the sum of the scores on its path; so paths of length L take log2 L joins, and
each table has one row per message. A tree's leaves are ranked by the mean score of their path (ties: smaller node), the first
`branches` are taken, and the same tables, read from the longest step to the shortest, enumerate their root-to-leaf paths. Each path is
formatted as one conversation:

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n

In roles and texts, backslash becomes two, "<|" becomes "<\\|", and line ends in roles become "\\n"; so a control string can't stand
inside a text and all is undone by reading left to right. The loss mask holds the places of the assistant's texts (code points).

Defined results: null role or text counts as empty, null score as 0; the messages of a null tree are one tree of their own; a message whose parent is missing or itself is a root; messages on
or under a cycle have no root and are left out; a repeated (tree, node) keeps its smallest row; an empty table gives no conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


def linear(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn") -> DataFrame:
    """A table of turns as trees without branches: each turn answers the one before (ties by role and text)."""
    order = Window.partitionBy(conv_id).orderBy(turn, "role", "text")
    at = F.row_number().over(order).cast("long")
    return rows.select(F.col(conv_id).cast("long").alias("tree"), at.alias("node"), "role", "text", F.lit(0.0).alias("score")).withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1))


def paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, leaf, rank, depth, role, text) of the messages on the chosen paths; depth counts from the root, from 0."""
    cols = ["tree", "node", "parent", "role", "text", "score"]
    # the tree as a struct: a null one then equals itself in all joins
    one = messages.select(*cols).withColumn("tree", F.struct("tree")).groupBy("tree", "node").agg(F.min(F.struct("parent", "role", "text", "score")).alias("m")).select("tree", "node", "m.*")
    one = scratch.saved(one, "messages")
    known = one.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    score = F.coalesce("score", F.lit(0.0))
    up = one.join(known, ["tree", "parent"], "left").withColumn("up", F.when(F.col("known") & (F.col("parent") != F.col("node")), F.col("parent")))
    level = scratch.saved(up.select("tree", "node", "up", F.lit(1).cast("long").alias("steps"), score.alias("sum")), "level")
    largest = one.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    levels = [level]
    while levels[-1].where("up is not null").limit(1).count() and 1 << (len(levels) - 1) <= largest:
        far = levels[-1].select("tree", F.col("node").alias("up"), F.col("up").alias("far"), F.col("steps").alias("more"), F.col("sum").alias("plus"))
        j = levels[-1].join(far, ["tree", "up"], "left")
        # `steps` and `sum` cover the messages from this one up to, but without, `up`
        levels.append(scratch.saved(j.select("tree", "node", F.col("far").alias("up"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), (F.col("sum") + F.coalesce("plus", F.lit(0.0))).alias("sum")), "level"))
    rooted = levels[-1].where("up is null").select("tree", "node", F.col("steps").alias("length"), (F.col("sum") / F.col("steps")).alias("mean"))
    inner = level.where("up is not null").select("tree", F.col("up").alias("node")).distinct()
    leaves = rooted.join(inner, ["tree", "node"], "left_anti").withColumn("part", F.pmod(F.xxhash64("node"), F.lit(16)))
    best = [F.desc("mean"), F.asc("node")]
    # ranked in parts first, so that a tree of many leaves isn't sorted by one task
    leaves = leaves.withColumn("r", F.row_number().over(Window.partitionBy("tree", "part").orderBy(*best))).where(F.col("r") <= branches)
    leaves = leaves.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(*best))).where(F.col("rank") <= branches)
    found = scratch.saved(leaves.select("tree", F.col("node").alias("leaf"), "rank", "length", "node", F.lit(0).cast("long").alias("above")), "leaves")
    for k in range(len(levels) - 1, -1, -1):
        step = levels[k].where("up is not null").select("tree", "node", "up")
        higher = found.join(step, ["tree", "node"]).select("tree", "leaf", "rank", "length", F.col("up").alias("node"), (F.col("above") + (1 << k)).alias("above"))
        found = scratch.saved(found.unionByName(higher), "path")
    return found.join(one.select("tree", "node", "role", "text"), ["tree", "node"]).select("tree.tree", "leaf", "rank", (F.col("length") - 1 - F.col("above")).alias("depth"), "role", "text")


def format_paths(found: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(tree, leaf, rank, formatted, loss: array<struct<start, end>>)."""
    role = F.replace(escape(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit("\\n"))
    head = F.concat(F.lit(START), role, F.lit("\n"))
    turn = F.struct("depth", head.alias("head"), escape(F.coalesce("text", F.lit(""))).alias("body"), (F.coalesce("role", F.lit("")) == loss_role).alias("lost"))
    turns = found.groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END + "\n"))), "")
    tail = len(END) + 1
    kind = "array<struct<start:int,end:int>>"
    span = lambda a, t: F.struct((a["at"] + F.length(t["head"])).alias("start"), (a["at"] + F.length(t["head"]) + F.length(t["body"])).alias("end"))
    loss = F.aggregate("turns", F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("spans")), lambda a, t: F.struct(
        (a["at"] + F.length(t["head"]) + F.length(t["body"]) + tail).alias("at"), F.when(t["lost"], F.concat(a["spans"], F.array(span(a, t)))).otherwise(a["spans"]).alias("spans")
    ), lambda a: a["spans"])
    return turns.select("tree", "leaf", "rank", text.alias("formatted"), loss.alias("loss"))


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation; an error if it isn't one."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError(f"no turn starts at {at}")
        line = formatted.index("\n", at)
        stop = formatted.index(END + "\n", line)
        turns.append((unescape(formatted[at + len(START) : line]), unescape(formatted[line + 1 : stop])))
        at = stop + len(END) + 1
    return turns


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for tree, text, loss in zip(*(batch.column(c).to_pylist() for c in ("tree", "formatted", "loss")), strict=True):
            turns = parse(text)
            lost = "".join(unescape(text[s["start"] : s["end"]]) for s in loss)
            whole = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
            for column, value in zip(out, (tree, len(turns), whole, len(lost), hashlib.sha256(lost.encode()).hexdigest(), len(text)), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if "sha" in n else pa.int64()) for n, c in zip(names, out, strict=True)], names)


def digest(formatted: DataFrame) -> DataFrame:
    """What reading the formatted conversations back gives: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    scratch.ship(formatted.sparkSession)
    return formatted.select("tree", "formatted", "loss").mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def apply(messages: DataFrame, branches: int = 1) -> DataFrame:
    return format_paths(paths(messages, branches))
