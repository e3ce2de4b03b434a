"""Chat formatting over reply trees, with DataFrame functions only.

Messages point at their parents. Self-joins double the distance of each pointer
until all reach a root, so a branch of depth d takes log2(d) joins; the same
pointers then enumerate the messages of the branches chosen. Branches of a
conversation are ranked by the sum of their messages' scores, then by depth and the
smallest leaf, and each of the best becomes one formatted conversation.

The template is `### role: text</turn>` and a newline a turn. In roles and texts
a backslash becomes \\b, `<` becomes \\l and `#` becomes \\h (in roles also `:`
becomes \\c), so no text can hold a control string, and reading back is exact.

Null roles, texts and scores count as empty and 0; a null conversation is one
like any other. A message whose parent is missing or null is a root. Messages
on a cycle reach no root and are in no branch. Of rows with the same conversation
and message id, the first by role and text stays. A conversation is one row, however long
its texts are. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.session import materialize

START, COLON, END = "### ", ": ", "</turn>\n"


def escape(c: Column, role: bool = False) -> Column:
    for plain, coded in (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"), *([(":", "\\c")] if role else [])):
        c = F.replace(c, F.lit(plain), F.lit(coded))
    return c


def unescape(c: Column) -> Column:
    for plain, coded in ((":", "\\c"), ("#", "\\h"), ("<", "\\l"), ("\\", "\\b")):
        c = F.replace(c, F.lit(coded), F.lit(plain))
    return c


def threads(rows: DataFrame, conv_col: str = "conv_id", order_col: str = "turn") -> DataFrame:
    """Messages of a plain table of turns: each replies to the turn before it."""
    at = Window.partitionBy(conv_col).orderBy(order_col, "role", "text")
    return rows.select(F.col(conv_col).alias("conv_id"), F.row_number().over(at).cast("long").alias("msg_id"), "role", "text").withColumn(
        "parent_id", F.when(F.col("msg_id") > 1, F.col("msg_id") - 1)
    ).withColumn("score", F.lit(0.0))


def on_message(left: str, right: str, column: str) -> Column:
    return F.col(f"{left}.conv_id").eqNullSafe(F.col(f"{right}.conv_id")) & (F.col(f"{left}.{column}") == F.col(f"{right}.msg_id"))


def pointers(nodes: DataFrame) -> list[DataFrame]:
    """For each power of two, where each message's pointer of that length leads (null above a root), and the score on the way."""
    known = nodes.alias("n").join(nodes.select("conv_id", "msg_id").alias("p"), on_message("n", "p", "parent_id"), "left")
    levels = [materialize(known.select("n.conv_id", "n.msg_id", F.col("p.msg_id").alias("up"), F.lit(1).cast("long").alias("steps"), F.col("n.score").alias("total")))]
    most = max(1, levels[0].count()).bit_length() + 1
    while len(levels) <= most and not levels[-1].filter("up is not null").isEmpty():
        a, b = levels[-1].filter("up is not null").alias("a"), levels[-1].alias("b")
        far = a.join(b, on_message("a", "b", "up")).select(
            "a.conv_id", "a.msg_id", "b.up", (F.col("a.steps") + F.col("b.steps")).alias("steps"), (F.col("a.total") + F.col("b.total")).alias("total")
        )
        levels.append(materialize(far.unionByName(levels[-1].filter("up is null"))))  # who has reached a root is done
    return levels


def branches(messages: DataFrame, top: int = 1) -> DataFrame:
    """conv_id, leaf, rank, msg_id, up_steps (0 at the leaf): the messages of each conversation's `top` best branches."""
    nodes = messages.select("conv_id", "msg_id", "parent_id", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    levels = pointers(nodes)
    inner = nodes.filter("parent_id is not null").select("conv_id", F.col("parent_id").alias("msg_id")).distinct().alias("p")
    done = levels[-1].filter("up is null").alias("n")
    leaves = done.join(inner, on_message("n", "p", "msg_id"), "left_anti")
    order = Window.partitionBy("conv_id").orderBy(F.desc("total"), F.desc("steps"), "msg_id")
    best = leaves.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    path = best.select("conv_id", F.col("msg_id").alias("leaf"), "rank", "msg_id", F.lit(0).cast("long").alias("up_steps"))
    for k, level in enumerate(levels):
        step = path.alias("a").join(level.filter("up is not null").alias("b"), on_message("a", "b", "msg_id"))
        path = path.unionByName(step.select("a.conv_id", "a.leaf", "a.rank", F.col("b.up").alias("msg_id"), (F.col("a.up_steps") + (1 << k)).alias("up_steps")))
        path = materialize(path)
    return path


def formatted(messages: DataFrame, loss_role: str = "assistant", top: int = 1) -> DataFrame:
    """conv_id, leaf, rank, formatted, loss (spans of code points: start, length) for each branch chosen."""
    first = Window.partitionBy("conv_id", "msg_id").orderBy("role", "text")
    unique = messages.withColumn("__n", F.row_number().over(first)).filter("__n = 1 and msg_id is not null")
    unique = materialize(unique.select("conv_id", "msg_id", "parent_id", "score", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))
    path = branches(unique, top).alias("a").join(unique.alias("b"), on_message("a", "b", "msg_id"))
    head = F.concat(F.lit(START), escape(F.col("b.role"), True), F.lit(COLON))
    turns = path.select("a.conv_id", "a.leaf", "a.rank", (-F.col("a.up_steps")).alias("at"), (F.col("b.role") == loss_role).alias("learn"), head.alias("head"), escape(F.col("b.text")).alias("body"))
    before = Window.partitionBy("conv_id", "leaf", "rank").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.length("head") + F.length("body") + len(END)
    turns = turns.withColumn("start", F.coalesce(F.sum(whole).over(before), F.lit(0)) + F.length("head"))
    made = turns.groupBy("conv_id", "leaf", "rank").agg(F.sort_array(F.collect_list(F.struct("at", "learn", "start", F.length("body").alias("length"), F.concat("head", "body", F.lit(END)).alias("said")))).alias("t"))
    return made.select(
        "conv_id", "leaf", "rank", F.array_join(F.transform("t", lambda x: x["said"]), "").alias("formatted"),
        F.transform(F.filter("t", lambda x: x["learn"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"))).alias("loss"),
    )


def turns_of(text: Column) -> Column:
    """The turns of a formatted conversation, as structs of role and text."""
    parts = F.filter(F.split(text, END, -1), lambda x: x != "")
    role = lambda x: F.substring_index(F.substr(x, F.lit(len(START) + 1)), COLON, 1)
    return F.transform(parts, lambda x: F.struct(unescape(role(x)).alias("role"), unescape(after(x)).alias("text")))


def after(x: Column) -> Column:
    """What stands behind the first colon."""
    return F.substr(x, F.instr(x, COLON) + len(COLON))


def masked(text: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substr(text, (s["start"] + 1).cast("int"), s["length"]))), "")
