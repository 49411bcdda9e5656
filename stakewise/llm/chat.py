"""Reply trees to training conversations: paths by iterative self-joins, branches ranked by score, one text per path.

Messages point to the message they answer. Pointer doubling finds every message's root and the score of the path up
to it in a logarithmic number of self-joins; the leaves of a tree are ranked by that score, and only the chosen
leaves are expanded to paths, with the same doubled pointers. Each path becomes one text:

    <|turn|>role<|text|>text<|end|>\\n ...

Control strings inside roles and texts get a backslash after their first character (one more where there are
some already), which is undone on reading, so no text can end a turn or open another. The loss mask is a list of
code-point spans: exactly the texts of the trained role.

Null roles and texts count as empty. A message whose parent is null or missing is a root. Messages on a loop, or
below one, hang from no root and are in no path. Message ids must be unique; equal scores go to the smaller leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stakewise.llm.common import stored

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
#: Strings that mark turns in this or other common templates: <|...|>, <s>, </s>, [INST], [/INST].
_CONTROL = r"(\||/?s>|/?INST\])"
ESCAPE, ESCAPED = r"(<|\[)(\\*)" + _CONTROL, r"$1$2\\$3"
UNESCAPE, UNESCAPED = r"(<|\[)(\\*)\\" + _CONTROL, "$1$2$3"
#: Code points of the blocks that a loss mask is read from.
BLOCK = 1024


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, ESCAPED)


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, UNESCAPED)


def pointers(messages: DataFrame) -> list[DataFrame]:
    """Doubled pointers of (node, parent, score): table k has ``up``, the ancestor 2^k steps away or null, and
    ``total``, the scores from the node to below it. The last has no pointers left, except of loops."""
    known = messages.select(F.col("node").alias("parent"))
    rooted = messages.filter("parent IS NOT NULL").join(known, "parent", "left_semi").select("node", "parent")
    first = messages.select("node", "score").join(rooted, "node", "left").select("node", F.col("parent").alias("up"), F.col("score").alias("total"))
    tables = [stored(first, "pointers")]
    most = tables[0].count().bit_length() + 1
    for _ in range(most):
        last = tables[-1]
        climbing = last.filter("up IS NOT NULL")
        if climbing.isEmpty():
            break
        above = last.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("total").alias("more"))
        onward = climbing.join(above, "up").select("node", F.col("up2").alias("up"), (F.col("total") + F.col("more")).alias("total"))
        tables.append(stored(onward.union(last.filter("up IS NULL")), "pointers"))
    return tables


def best_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, leaf, rank, node, back) of the ``branches`` best root-to-leaf paths of each tree of ``messages``
    (tree, node, parent, score); ``back`` counts steps from the leaf."""
    messages = messages.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    tables = pointers(messages)
    parents = messages.filter("parent IS NOT NULL").select(F.col("parent").alias("node")).distinct()
    leaves = messages.join(parents, "node", "left_anti").select("tree", "node")
    scored = leaves.join(tables[-1].filter("up IS NULL"), "node").select("tree", "node", "total")
    order = Window.partitionBy("tree").orderBy(F.desc("total"), "node")
    paths = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= branches).select("tree", F.col("node").alias("leaf"), "rank", "node", F.lit(0).cast("long").alias("back"))
    for k, table in enumerate(tables[:-1]):
        paths = stored(paths, "paths")
        further = paths.join(table.filter("up IS NOT NULL").select("node", "up"), "node").select("tree", "leaf", "rank", F.col("up").alias("node"), (F.col("back") + (1 << k)).alias("back"))
        paths = paths.union(further)
    return paths


def format_paths(messages: DataFrame, branches: int = 1, trained: str = "assistant") -> DataFrame:
    """One row per chosen path of ``messages`` (tree, node, parent, score, role, text): tree, leaf, rank, formatted,
    loss_spans.

    ``loss_spans`` are the code-point spans (start, length) of the trained role's texts in ``formatted``. Places come
    from running sums over a path's turns, so a path costs time in proportion to its length.
    """
    words = messages.select("node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = best_paths(messages, branches).join(words, "node")
    opening = F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(TEXT))
    rows = rows.select("tree", "leaf", "rank", "back", opening.alias("opening"), escaped(F.col("text")).alias("body"), (F.col("role") == trained).alias("trained"))
    before = Window.partitionBy("tree", "leaf", "rank").orderBy(F.desc("back")).rowsBetween(Window.unboundedPreceding, -1)
    passed = F.coalesce(F.sum(F.char_length(F.concat("opening", "body")) + len(END)).over(before), F.lit(0))
    span = F.struct((passed + F.char_length("opening")).cast("long").alias("start"), F.char_length("body").cast("long").alias("length"))
    placed = rows.select("tree", "leaf", "rank", passed.alias("at"), F.concat("opening", "body", F.lit(END)).alias("piece"), F.when(F.col("trained"), span).alias("span"))
    paths = placed.groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(F.struct("at", "piece", "span"))).alias("turns"))
    spans = F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull())
    return paths.select("tree", "leaf", "rank", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_turns(text: Column) -> Column:
    """The (role, text) array that ``formatted`` wrote."""
    parts = F.split(text, r"<\|end\|>\n")
    parts = F.slice(parts, 1, F.size(parts) - 1)

    def turn(part: Column) -> Column:
        halves = F.split(F.substr(part, F.lit(len(TURN) + 1)), r"<\|text\|>")
        return F.struct(unescaped(halves[0]).alias("role"), unescaped(halves[1]).alias("text"))

    return F.transform(parts, turn)


def read_loss(text: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped.

    The text is cut once into blocks of ``BLOCK`` code points. A span is taken out of the blocks it touches, so reading
    costs time in proportion to the text, not to the text times its spans.
    """
    cut = F.struct(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)).alias("blocks"), spans.alias("spans"))

    def covered(blocks: Column, span: Column) -> Column:
        first, last = F.floor(span["start"] / BLOCK), F.floor((span["start"] + span["length"] - 1) / BLOCK)
        touched = F.array_join(F.slice(blocks, (first + 1).cast("int"), F.greatest(last - first + 1, F.lit(0)).cast("int")), "")
        return F.substr(touched, (span["start"] - first * BLOCK + 1).cast("int"), span["length"].cast("int"))

    # The array of one binds the blocks to a variable; named twice as columns they would be cut again for each span.
    return F.transform(F.array(cut), lambda c: F.array_join(F.transform(c["spans"], lambda s: unescaped(covered(c["blocks"], s))), ""))[0]


def chained(conversations: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as trees in which each message answers the one before it.

    Equal turns are taken by role, then text.
    """
    named = conversations.select(F.col("conv_id").cast("long").alias("tree"), "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = stored(named.withColumn("node", F.monotonically_increasing_id()), "messages")
    order = Window.partitionBy("tree").orderBy("turn", "role", "text", "node")
    return stored(rows.select("tree", "node", F.lag("node").over(order).alias("parent"), F.lit(1.0).alias("score"), "role", "text"), "messages")
