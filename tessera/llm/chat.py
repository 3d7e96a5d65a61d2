"""Chat formatting of reply trees.

Messages point to their parents.  Ancestors at distances of powers of two come
from iterative self-joins, so depth and score sums of all nodes take as many
joins as the depth has bits.  A branch (root-to-leaf path) is ranked by the sum
of its messages' scores; the chosen branches are then walked back to their roots
by the same powers of two and formatted, one conversation each.

The template opens each turn by ``<|im_start|>role\\n`` and ends it by
``<|im_end|>\\n``.  Inside roles and texts, a backslash is doubled and put after
the first character of each control string, so none can occur there and
``unescape`` restores the original.

Defined cases: null role or text counts as empty; the messages of a null tree
(or conv_id) are one tree; a parent that is missing or in
another tree makes a root; messages on a cycle have no root and are left out;
ties between branches go to the smaller leaf id; message ids must be unique
within a tree (``from_turns`` makes them so: repeated turns follow each other,
ordered by role and text); an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

# Control strings of common chat templates.
CONTROL = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
_OPEN, _END = CONTROL[:2]


def escape(text: Column) -> Column:
    guarded = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(guarded, "(" + "|".join(f"(?<={re.escape(c[0])})(?={re.escape(c[1:])})" for c in CONTROL) + ")", r"\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def from_turns(rows: DataFrame) -> DataFrame:
    """Messages (tree, id, parent, role, text, score) of linear conversations (conv_id, turn, role, text)."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return rows.withColumn("id", F.row_number().over(order).cast("long")).select(
        F.col("conv_id").alias("tree"), "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score")
    )


def branches(messages: DataFrame, keep: int = 1) -> DataFrame:
    """(tree, branch, id, depth) of the ``keep`` best branches of each tree; ``branch`` is the leaf's id."""
    # Within a struct, null equals null in joins.
    base = messages.select(F.struct("tree").alias("tree"), "id", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    known = base.select("tree", F.col("id").alias("parent"), F.lit(True).alias("there"))
    nodes = durable(base.join(known, ["tree", "parent"], "left").select("tree", "id", F.when(F.col("there"), F.col("parent")).alias("up"), F.lit(1).cast("long").alias("depth"), "score"))
    leaves = nodes.join(nodes.select("tree", F.col("up").alias("id")).where("id is not null"), ["tree", "id"], "left_anti").select("tree", "id")
    jumps, waiting = [], nodes.where("up is not null").count()
    while waiting:
        jumps.append(nodes.select("tree", "id", "up").where("up is not null"))
        above = nodes.select("tree", F.col("id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"), F.col("score").alias("score2"))
        # What has reached its root moves no more.
        nodes = durable(
            nodes.where("up is null").unionByName(nodes.where("up is not null").join(above, ["tree", "up"], "left").select("tree", "id", F.col("up2").alias("up"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"), (F.col("score") + F.coalesce("score2", F.lit(0.0))).alias("score")))
        )
        still = nodes.where("up is not null").count()
        # Ever fewer nodes still point upwards; those on a cycle always do.
        if still == waiting:
            break
        waiting = still
    ends = leaves.join(nodes.where("up is null"), ["tree", "id"])
    best = ends.withColumn("place", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "id"))).where(F.col("place") <= keep)
    walk = durable(best.select("tree", F.col("id").alias("branch"), "id", "depth"))
    for k, j in enumerate(jumps):
        # All ancestors of this jump are 2**k above.
        above = walk.join(j, ["tree", "id"]).select("tree", "branch", F.col("up").alias("id"), (F.col("depth") - (1 << k)).alias("depth"))
        walk = durable(walk.unionByName(above))
    return walk.select("tree.tree", "branch", "id", "depth")


def format_branches(messages: DataFrame, keep: int = 1, trained: str = "assistant") -> DataFrame:
    """(tree, branch, n_turns, formatted, loss_spans): a conversation per chosen branch.

    ``loss_spans`` (start, length in code points of ``formatted``) cover the texts,
    as escaped, of role ``trained``.
    """
    empty = F.lit("")
    # Written once: what numbers the messages would otherwise be part of each plan, and plans take the driver's memory.
    messages = durable(messages.select("tree", "id", "parent", "role", "text", "score"))
    path = branches(messages, keep).withColumn("tree", F.struct("tree"))
    turns = path.join(messages.select(F.struct("tree").alias("tree"), "id", "role", "text"), ["tree", "id"]).select(
        "tree",
        "branch",
        F.struct(
            "depth",
            (F.coalesce("role", empty) == trained).alias("loss"),
            F.concat(F.lit(_OPEN), escape(F.coalesce("role", empty)), F.lit("\n")).alias("head"),
            escape(F.coalesce("text", empty)).alias("body"),
        ).alias("t"),
    )
    whole = turns.groupBy("tree", "branch").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    tail = F.lit(_END + "\n")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start: bigint, length: bigint>>").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        begin = state["at"] + F.length(t["head"])
        end = begin + F.length(t["body"])
        span = F.array(F.struct(begin.cast("long").alias("start"), F.length(t["body"]).cast("long").alias("length")))
        return F.struct((end + len(_END) + 1).cast("long").alias("at"), F.when(t["loss"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return whole.select(
        "tree.tree",
        "branch",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], tail)), "").alias("formatted"),
        F.aggregate("turns", start, step)["spans"].alias("loss_spans"),
    )


def read_back(formatted: Column) -> Column:
    """Array of (role, text) from a formatted conversation."""
    opened = F.split(formatted, re.escape(_OPEN), -1)
    bodies = F.slice(opened, 2, F.greatest(F.size(opened) - 1, F.lit(0)))

    def turn(t: Column) -> Column:
        inner = F.substring(t, F.lit(1), F.length(t) - len(_END) - 1)
        at = F.instr(inner, "\n")
        return F.struct(unescape(F.substring(inner, F.lit(1), at - 1)).alias("role"), unescape(F.substring(inner, at + 1, F.length(inner))).alias("text"))

    return F.transform(bodies, turn)


def masked(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped and joined."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"].cast("int") + 1, s["length"].cast("int")))), "")
