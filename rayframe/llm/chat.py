"""Chat formatting of reply trees: jumps by iterative self-joins, branches ranked by score, turns marked reversibly.

Messages are rows (tree, message, parent, role, text, score); a message without a parent in its tree is a root. The
self-joins double their reach: round k finds each message's ancestor 2^k above it, so a tree of depth d takes log2(d)
rounds, and a branch is enumerated from its leaf by the binary digits of distances. Branches are scored and ranked
before any path is written out, and texts are joined to chosen paths only.

A turn is ``<turn role>text</turn>`` and a line end. Inside roles and texts a backslash becomes ``\\0``, the ``<`` of
``<turn`` or ``</turn`` becomes ``\\1``, and in roles ``>`` becomes ``\\2``; undone in the opposite order that is exact.

Defined results: a null text or role counts as empty, a null tree is a tree like any other. Rows repeated under one
message id count once; of different rows the one with the greatest score, then the least parent, role and text. A parent
that is not in the tree makes a root. A cycle of parents is cut above its least message, which becomes a root. Branches
rank by mean score over messages that have one (NaN: none), branches without any last, ties by greater depth, then
smaller leaf. An empty table gives no rows. A formatted conversation is one string and so at most 2 GB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, keep

END = "</turn>\n"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\0"))
    for mark in ("<turn", "</turn"):
        out = F.replace(out, F.lit(mark), F.lit("\\1" + mark[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\1"), F.lit("<")), F.lit("\\0"), F.lit("\\"))


def chain(rows: DataFrame) -> DataFrame:
    """Messages of linear conversations (conv_id, turn, role, text): each replies to the one before it.

    Turns follow by turn number, then role and text, nulls first; equal rows are turns of their own.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = rows.select(F.col("conv_id").alias("tree"), "turn", role.alias("role"), text.alias("text"))
    place = F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text")).cast("long")
    rows = rows.select("tree", place.alias("message"), "role", "text")
    return rows.select("tree", "message", F.when(F.col("message") > 1, F.col("message") - 1).alias("parent"), "role", "text", F.lit(None).cast("double").alias("score"))


def distinct_messages(messages: DataFrame) -> DataFrame:
    """One row a message of a tree; those without an id have no place in a tree and each stand alone as a root."""
    score = F.nanvl(F.col("score").cast("double"), F.lit(None).cast("double"))
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = messages.select("tree", "message", "parent", role.alias("role"), text.alias("text"), score.alias("score"))
    # min takes a null for less than any number: a flag and the negative put missing scores last.
    row = F.struct(F.col("score").isNull().alias("unscored"), (-F.col("score")).alias("minus"), "parent", "role", "text")
    one = rows.where("message IS NOT NULL").groupBy("tree", "message").agg(F.min(row).alias("x"))
    named = one.select("tree", "message", "x.parent", "x.role", "x.text", (-F.col("x.minus")).alias("score"))
    return named.unionByName(rows.where("message IS NULL").withColumn("parent", F.lit(None).cast(rows.schema["parent"].dataType)))


def _linked(nodes: DataFrame) -> DataFrame:
    """tree, message, ancestor (its parent), least, total, scored of every message whose parent is in its tree."""
    has = nodes.select(F.col("tree").alias("t"), F.col("message").alias("m"))
    rows = nodes.where("parent IS NOT NULL").select("tree", "message", "parent", "score")
    rows = rows.join(has, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("m")), "left_semi")
    return rows.select(
        "tree", "message", F.col("parent").alias("ancestor"), F.col("message").alias("least"),
        F.coalesce("score", F.lit(0.0)).alias("total"), F.col("score").isNotNull().cast("long").alias("scored"),
    )


def _at(left: DataFrame, jump: DataFrame, how: str = "left") -> DataFrame:
    """``left`` (tree, message, ...) with the jump of each row's message: ancestor, more_total, more_scored, more_least."""
    jump = jump.select(F.col("tree").alias("t"), F.col("message").alias("m"), "ancestor", F.col("total").alias("more_total"), F.col("scored").alias("more_scored"), F.col("least").alias("more_least"))
    return left.join(jump, F.col("tree").eqNullSafe(F.col("t")) & (F.col("message") == F.col("m")), how).drop("t", "m")


def jumps(nodes: DataFrame) -> list[DataFrame]:
    """For k = 0, 1, ...: each message's ancestor 2^k above it, with sums over the messages passed, itself included."""
    limit, edges = nodes.count(), keep(_linked(nodes), "reply-parents")
    while True:
        levels = [edges]
        while levels[-1].count():
            if 1 << (len(levels) - 1) >= limit:
                break
            last = levels[-1]
            near = last.select("tree", F.col("message").alias("from"), F.col("ancestor").alias("message"), "least", "total", "scored")
            twice = _at(near, last, "inner").select(
                "tree", F.col("from").alias("message"), "ancestor", F.least("least", "more_least").alias("least"),
                (F.col("total") + F.col("more_total")).alias("total"), (F.col("scored") + F.col("more_scored")).alias("scored"),
            )
            levels.append(keep(twice, "reply-jumps"))
        round_ = levels[-1]
        if not round_.count():
            discard(levels.pop())
            return levels
        # More steps than messages lead into cycles only, and what they lead to is all that is on cycles.
        on = round_.select(F.col("tree").alias("t"), F.col("ancestor").alias("m")).distinct()
        least = round_.where("message = least").join(on, F.col("tree").eqNullSafe(F.col("t")) & (F.col("message") == F.col("m")), "left_semi")
        least = least.select(F.col("tree").alias("t"), F.col("message").alias("m"))
        cut = keep(edges.join(least, F.col("tree").eqNullSafe(F.col("t")) & (F.col("message") == F.col("m")), "left_anti"), "reply-parents")
        discard(*levels)
        edges = cut


def branches(nodes: DataFrame, levels: list[DataFrame], top: int | None = None) -> DataFrame:
    """tree, leaf, score, depth, branch (rank from 1) of the best ``top`` branches of every tree; of all for None.

    Spark keeps ``top`` rows a tree within each task before it shuffles, so a tree of very many branches meets no
    single task; with None all branches of a tree are sorted together.
    """
    replied = (levels[0] if levels else nodes.limit(0).withColumn("ancestor", F.col("message"))).select(F.col("tree").alias("t"), F.col("ancestor").alias("m"))
    same = F.col("tree").eqNullSafe(F.col("t")) & (F.col("message") == F.col("m"))
    at = nodes.select("tree", "message").join(replied, same, "left_anti")
    at = at.select("tree", F.col("message").alias("leaf"), "message", F.lit(0.0).alias("total"), F.lit(0).cast("long").alias("scored"), F.lit(1).cast("long").alias("depth"))
    for k in reversed(range(len(levels))):
        found = F.col("ancestor").isNotNull()
        at = _at(at, levels[k]).select(
            "tree", "leaf", F.coalesce("ancestor", "message").alias("message"), (F.col("total") + F.coalesce("more_total", F.lit(0.0))).alias("total"),
            (F.col("scored") + F.coalesce("more_scored", F.lit(0))).alias("scored"), (F.col("depth") + F.when(found, 1 << k).otherwise(0)).alias("depth"),
        )
    roots = nodes.where("score IS NOT NULL").select(F.col("tree").alias("t"), F.col("message").alias("m"), F.col("score").alias("own"))
    at = at.join(roots, same, "left")
    total, scored = F.col("total") + F.coalesce("own", F.lit(0.0)), F.col("scored") + F.col("own").isNotNull().cast("long")
    at = at.select("tree", "leaf", F.when(scored > 0, total / scored).alias("score"), "depth")
    order = Window.partitionBy("tree").orderBy(F.col("score").desc_nulls_last(), F.col("depth").desc(), F.col("leaf").asc_nulls_last())
    at = at.withColumn("branch", F.row_number().over(order))
    return at if top is None else at.where(F.col("branch") <= top)


def paths(chosen: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """``chosen`` (tree, leaf, depth, branch, score) with a row for each message of the path, root at position 1."""
    at = chosen.select("*", F.col("leaf").alias("message"), F.lit(0).cast("long").alias("up"))
    columns = [*chosen.columns, "step.message", "step.up"]
    for k in reversed(range(len(levels))):
        here = F.struct("message", "up")
        there = F.struct(F.col("ancestor").alias("message"), (F.col("up") + (1 << k)).alias("up"))
        both = F.when(F.col("ancestor").isNull(), F.array(here)).otherwise(F.array(here, there))
        at = _at(at, levels[k]).select(*chosen.columns, F.explode(both).alias("step")).select(*columns)
    return at.withColumn("position", F.col("depth") - F.col("up")).drop("up")


def conversations(messages: DataFrame, top: int | None = 1, loss_role: str = "assistant", distinct: bool = False) -> DataFrame:
    """The best ``top`` branches of each tree, each formatted as one conversation.

    Returns tree, leaf, branch, score, n_turns, formatted and loss: the spans of ``formatted`` that hold texts of
    ``loss_role``, as (start, length) in code points and (byte_start, byte_length) in UTF-8.
    ``distinct``: message ids are known to be unique within trees, as those of ``chain`` are.
    """
    all_nodes = keep(messages if distinct else distinct_messages(messages), "reply-messages")
    nodes = all_nodes.where("message IS NOT NULL")
    levels = jumps(nodes)
    at = paths(branches(nodes, levels, top), levels)
    texts = nodes.select(F.col("tree").alias("t"), F.col("message").alias("m"), "role", "text")
    rows = at.join(texts, F.col("tree").eqNullSafe(F.col("t")) & (F.col("message") == F.col("m"))).select("tree", "leaf", "branch", "score", "position", "role", "text")
    found = _formatted(rows, loss_role)
    if not distinct:  # rows without an id are roots and leaves at once
        alone = all_nodes.where("message IS NULL").select("tree", "role", "text", F.lit(None).cast(nodes.schema["message"].dataType).alias("leaf"), "score")
        found = found.unionByName(_one(alone, loss_role))
    return found


def _marks(loss_role: str) -> list[Column]:
    head = F.concat(F.lit("<turn "), F.replace(escape(F.col("role")), F.lit(">"), F.lit("\\2")), F.lit(">"))
    return [head.alias("head"), escape(F.col("text")).alias("body"), F.col("role").eqNullSafe(F.lit(loss_role)).alias("bears")]


def _span(start, byte_start) -> Column:
    return F.struct(
        (start + F.length("head")).cast("long").alias("start"), F.length("body").cast("long").alias("length"),
        (byte_start + F.octet_length("head")).cast("long").alias("byte_start"), F.octet_length("body").cast("long").alias("byte_length"),
    )


def _formatted(rows: DataFrame, loss_role: str) -> DataFrame:
    rows = rows.select("tree", "leaf", "branch", "score", "position", *_marks(loss_role))
    before = Window.partitionBy("tree", "leaf").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    size = lambda of: F.coalesce(F.sum(of("head") + of("body") + len(END)).over(before), F.lit(0))
    turn = F.struct("position", F.concat("head", "body", F.lit(END)).alias("turn"), F.when(F.col("bears"), _span(F.col("chars"), F.col("bytes"))).alias("span"))
    rows = rows.select("*", size(F.length).alias("chars"), size(F.octet_length).alias("bytes")).select("tree", "leaf", "branch", "score", turn.alias("x"))
    # first(): branch and score are the same in all rows of a path.
    one = rows.groupBy("tree", "leaf").agg(F.first("branch").alias("branch"), F.first("score").alias("score"), F.sort_array(F.collect_list("x")).alias("turns"))
    spans = F.filter(F.transform("turns", lambda x: x["span"]), lambda s: s.isNotNull())
    return one.select("tree", "leaf", "branch", "score", F.size("turns").alias("n_turns"), F.array_join(F.transform("turns", lambda x: x["turn"]), "").alias("formatted"), spans.alias("loss"))


def _one(rows: DataFrame, loss_role: str) -> DataFrame:
    """The same for messages that each are a conversation."""
    rows = rows.select("tree", "leaf", "score", *_marks(loss_role))
    span = _span(F.lit(0), F.lit(0))
    loss = F.when(F.col("bears"), F.array(span)).otherwise(F.filter(F.array(span), lambda _: F.lit(False)))
    return rows.select("tree", "leaf", F.lit(1).alias("branch"), "score", F.lit(1).alias("n_turns"), F.concat("head", "body", F.lit(END)).alias("formatted"), loss.alias("loss"))


def read_turns(formatted: Column) -> Column:
    """(role, text) of each turn of a formatted conversation, in order."""
    pieces = F.split(formatted, END)

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, ">", 1)
        role = unescape(F.replace(F.substring(head, 7, 1 << 30), F.lit("\\2"), F.lit(">")))
        return F.struct(role.alias("role"), unescape(F.substring(piece, F.length(head) + 2, F.lit(1 << 30))).alias("text"))

    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)


def under_loss(formatted: Column, loss: Column) -> Column:
    """Texts under the loss mask, unescaped, joined without anything between. Spans are cut by bytes, in linear time."""
    cut = lambda b: F.transform(loss, lambda s: unescape(F.substring(b, (s["byte_start"] + 1).cast("int"), s["byte_length"].cast("int")).cast("string")))
    return F.array_join(F.element_at(F.transform(F.array(formatted.cast("binary")), cut), 1), "")


def format_table(rows: DataFrame) -> DataFrame:
    """All conversations of a table (conv_id, turn, role, text) and conversation -7, with digests of what reads back."""
    spark = rows.sparkSession
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
    out = conversations(chain(rows.select("conv_id", "turn", "role", "text").unionByName(probe)), distinct=True)
    out = out.select("tree", "formatted", read_turns(F.col("formatted")).alias("turns"), under_loss(F.col("formatted"), F.col("loss")).alias("under"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("under").cast("long").alias("loss_chars"), F.sha2("under", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql() -> str:
    mark = lambda c: f"replace(replace(replace({c}, '\\', '\\0'), '<turn', '\\1turn'), '</turn', '\\1/turn')"
    order = "ORDER BY turn NULLS FIRST, role, text"
    return f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
c AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' {order}) AS lines,
  coalesce(string_agg(text, '' {order}) FILTER (WHERE role = 'assistant'), '') AS under,
  sum(length('<turn ' || replace({mark('role')}, '>', '\\2') || '>' || {mark('text')} || '</turn>') + 1) AS chars FROM r GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(lines) AS turns_sha256, length(under) AS loss_chars, sha256(under) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM c"""


SQL = _sql()
