"""Reply trees to training conversations, in built-in expressions only.

Messages name the message they answer. Root-to-leaf paths are found by iterative self-joins on ids alone: every message
holds a pointer to an ancestor, and joining the pointers with themselves doubles their reach, so a chain of n messages
takes log2(n) rounds. Branches are ranked by their score; the chosen ones are walked back over the same pointers, and only
then are the texts joined, once, and written as one conversation for each path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.plans.session import settle

#: The template: marks before the role and after the text of a turn.
START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    r"""Text in which no control mark can occur: ``<|`` becomes ``<\|``, and ``<\|`` becomes ``<\\|``."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    """Undoes ``escape``."""
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    r"""A role ends at the end of its line, so backslashes and line feeds in it are marked as well."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    # an encoded role holds no line feed, so one stands for a pair of backslashes until the last step
    kept = F.replace(F.replace(unescape(role), F.lit("\\\\"), F.lit("\n")), F.lit("\\n"), F.lit("\\"))
    return F.translate(kept, "\n\\", "\\\n")


def turns_as_tree(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Messages (tree, node, parent, role, text, score) of plain conversations: each turn answers the one before.

    Rows of one conversation are ordered by turn, then role, then text; rows that repeat a turn follow each other. Null
    text is empty, a null role is empty, a null turn comes first. Rows without conversation id form one conversation.
    The turns of one conversation meet in one task, as they do in the one row that the conversation becomes.
    """
    rows = rows.select(
        F.col(conv_id).alias("tree"),
        F.col(turn).alias("_turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    node = F.row_number().over(Window.partitionBy("tree").orderBy("_turn", "role", "text")).cast("bigint")
    rows = rows.withColumn("node", node)
    return rows.select(
        "tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text",
        F.lit(0.0).alias("score"),
    )


def choose_paths(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """The chosen root-to-leaf paths: (tree, path, node, depth), path being its leaf and depth 0 at the root.

    messages: tree, node, parent, score. A message whose parent is missing is a root; one without an answer is a leaf. A
    path's score is the sum of its messages' scores (null as 0); the ``branches`` best of each tree are taken (None: all),
    ties going to the longer path and then to the smaller leaf. Messages in a ring of answers lead to no root and are
    left out. Of messages that repeat a node of a tree the first by parent and score counts.
    """
    once = Window.partitionBy("_k", "node").orderBy(F.col("parent").asc_nulls_first(), F.col("score").desc())
    key = F.coalesce(F.concat(F.lit("t"), F.col("tree").cast("string")), F.lit(""))
    base = messages.select(key.alias("_k"), "tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    base = base.withColumn("_i", F.row_number().over(once)).where("_i = 1").drop("_i")
    known = base.select("_k", F.col("node").alias("parent"), F.lit(True).alias("_known"))
    base = settle(
        base.join(known, ["_k", "parent"], "left")
        .withColumn("up", F.when(F.col("_known"), F.col("parent")))
        .select("_k", "tree", "node", "up", "score"),
        "messages",
    )
    most = base.groupBy("_k").count().agg(F.max("count")).first()[0] or 0
    # sums of the messages from a node up to, but without, the one that ``up`` names; who has no such one is at the root
    state = ["_k", "node", "up", "score", "steps"]
    now = base.withColumn("steps", F.lit(1).cast("bigint")).select(state)
    ended, jumps = now.where("up is null"), []
    while True:
        going = now.where("up is not null")
        if (1 << len(jumps)) > most or going.isEmpty():
            break
        jumps.append(going.select("_k", "node", "up"))
        far = ended.unionByName(going).select(
            "_k", F.col("node").alias("up"), F.col("up").alias("_up"), F.col("score").alias("_s"), F.col("steps").alias("_n")
        )
        now = settle(
            going.join(far, ["_k", "up"]).select(
                "_k", "node", F.col("_up").alias("up"), (F.col("score") + F.col("_s")).alias("score"),
                (F.col("steps") + F.col("_n")).alias("steps"),
            ),
            "jumps",
        )
        ended = ended.unionByName(now.where("up is null"))
    answered = base.where("up is not null").select("_k", F.col("up").alias("node")).distinct()
    leaves = ended.join(answered, ["_k", "node"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("_k").orderBy(F.desc("score"), F.desc("steps"), "node"))
    if branches is not None:
        leaves = leaves.withColumn("_r", rank).where(F.col("_r") <= branches)
    depth = ended.select("_k", "node", (F.col("steps") - 1).alias("depth"))
    chosen = leaves.select("_k", F.col("node").alias("path"), "node")
    # from each message on a path also the ones 2^i above it, the longest jumps first
    for jump in reversed(jumps):
        up = chosen.join(jump, ["_k", "node"]).select("_k", "path", F.col("up").alias("node"))
        chosen = settle(chosen.unionByName(up), "paths")
    names = base.select("_k", "tree", "node")
    return chosen.join(depth, ["_k", "node"]).join(names, ["_k", "node"]).select("tree", "path", "node", "depth")


def format_paths(messages: DataFrame, paths: DataFrame, learn: str = "assistant") -> DataFrame:
    """One row per path: tree, path, formatted text and spans, the parts under the loss mask.

    A turn is START, role, line feed, text, END. Role and text are escaped, so marks inside them are ordinary text and
    ``read_back`` restores them. spans: array of (start, length) in code points of ``formatted``, one for each text
    whose role is ``learn``, in order. A conversation must fit one row, as its result does.
    """
    head = F.concat(F.lit(START), _escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    turn = F.struct(
        "depth", head.alias("head"), body.alias("body"), (F.col("role") == learn).alias("learn"),
        F.length(head).alias("h"), F.length(body).alias("b"),
    )
    joined = paths.withColumnRenamed("tree", "_tree").join(
        messages.select("tree", "node", "role", "text"),
        [F.col("_tree").eqNullSafe(F.col("tree")), paths["node"] == messages["node"]],
    ).select("tree", "path", turn.alias("t"))
    grouped = joined.groupBy("tree", "path").agg(F.sort_array(F.collect_list("t")).alias("t"))
    gap = len(END)
    walked = F.aggregate(
        "t",
        F.struct(F.lit(0).cast("int").alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + x["h"] + x["b"] + gap).cast("int").alias("at"),
            F.when(
                x["learn"],
                F.concat(acc["spans"], F.array(F.struct((acc["at"] + x["h"]).alias("start"), x["b"].alias("length")))),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    formatted = F.array_join(F.transform("t", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "")
    return grouped.select("tree", "path", formatted.alias("formatted"), walked["spans"].alias("spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds turns (array of role, text) and learned (array of text under the mask), read from ``formatted`` and ``spans``."""
    parts = F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda x: x != "")
    inner = F.transform(parts, lambda x: F.substr(x, F.lit(len(START) + 1)))
    turns = F.transform(
        inner,
        lambda x: F.struct(
            _unescape_role(F.substring_index(x, "\n", 1)).alias("role"),
            unescape(F.substr(x, F.instr(x, F.lit("\n")) + 1)).alias("text"),
        ),
    )
    learned = F.transform("spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"])))
    return formatted.withColumns({"turns": turns, "learned": learned})


def format_conversations(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Plain conversations as reply trees of one branch, formatted: tree, path, formatted, spans."""
    messages = settle(turns_as_tree(rows, conv_id, turn), "turns")
    return format_paths(messages, choose_paths(messages))

