"""Reply trees as chat text: every root-to-leaf path is found, branches are ranked by score, and each chosen
path becomes one conversation with its loss mask. DataFrame functions only.

Paths are found by self-joins that double: after k rounds a message knows its ancestor 2^k steps up, how many
messages lie below it and what they score together, so a tree of depth d takes log2(d) rounds over rows of
five short columns. Texts are not moved until the branches are chosen, and then once for each message of a
chosen path. A chosen path's members come from the same rounds read backwards: the message 2^k steps up of
what is known already. Rounds are written as tables, so a lost executor costs a round's tasks.

The template of a turn is `### role`, a line with the text and a line `</turn>`. Inside texts and roles
a backslash, `###`, `</turn>` and, in roles, a line end become a backslash and one letter, so no text holds a
mark, and `plain` gives back what was there. Spans of the loss mask count code points and bytes of the
formatted text, end exclusive.

Defined results: null text, role: empty. A null tree is a tree of its own. Messages without an id take no part;
of several messages with one id in a tree the least by parent, role, text and score stays. A parent that the
tree has not makes a root. A message whose parents form a circle, or lead into one, takes no part. Null and
NaN scores count as 0. Equal branches: the longer first, then the smaller leaf id. An empty table gives no
rows; other columns, whatever their names, are ignored. A conversation is one row, so a chosen path must fit one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise

LEARN = ("assistant",)
#: Branches of a tree that become conversations.
BEST = 1
_OPEN, _END = "### ", "\n</turn>\n"
_MARKS = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\e"))
_ROLE_MARKS = (*_MARKS, ("\n", "\\n"))


def marked(text: Column, marks=_MARKS) -> Column:
    """The text with its control strings escaped; the backslash goes first."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for was, becomes in marks:
        out = F.replace(out, F.lit(was), F.lit(becomes))
    return out


def plain(text: Column, marks=_MARKS) -> Column:
    """What marked() was given; the backslash comes back last."""
    for was, becomes in reversed(marks):
        text = F.replace(text, F.lit(becomes), F.lit(was))
    return text


def messages_of(trees: DataFrame) -> DataFrame:
    """tree, id, parent, role, text, score with one row an id."""
    given = trees.where("id is not null").select("tree", "id", "parent", "role", "text", F.col("score").cast("double").alias("score"))
    least = given.groupBy("tree", "id").agg(F.min(F.struct("parent", "role", "text", "score")).alias("of"))
    return least.select("tree", "id", "of.*")


def conversation_messages(rows: DataFrame) -> DataFrame:
    """The same of conversations (conv_id, turn, role, text): a turn answers the one before it. Rows go by turn,
    then role and text, nulls first, and every row is a turn."""
    order = [F.asc_nulls_first(c) for c in ("turn", "role", "text")]
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)).cast("long")
    numbered = rows.select("conv_id", "role", "text", at.alias("id"))
    return numbered.select(F.col("conv_id").alias("tree"), "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text", F.lit(None).cast("double").alias("score"))


def _known(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """left joined to right(of_tree, at, ...) by tree and key; of_tree and at go."""
    on = left["tree"].eqNullSafe(right["of_tree"]) & (left[key] == right["at"])
    return left.join(right, on, how).drop("of_tree", "at")


def climb(messages: DataFrame) -> list[DataFrame]:
    """Rounds of (tree, id, up, n, s): in round k, up is the ancestor 2^k steps above (null: there is none), n and s
    count and score the messages from this one to below it. In the last round nobody has an up but those
    whose parents form a circle."""
    score = F.when(F.isnan("score"), 0.0).otherwise(F.coalesce("score", F.lit(0.0)))
    rows = messages.select("tree", "id", "parent", F.lit(1).cast("long").alias("n"), score.alias("s"))
    there = messages.select(F.col("tree").alias("of_tree"), F.col("id").alias("at"), F.col("id").alias("up"))
    held = _known(rows.where("parent is not null"), there, "parent", "left").unionByName(rows.where("parent is null"), allowMissingColumns=True)
    rounds = [materialise(held.select("tree", "id", "up", "n", "s"), "chat-climb")]
    total = rounds[0].count()
    while 1 << len(rounds) <= 2 * total and not (now := rounds[-1]).where("up is not null").isEmpty():
        above = now.select(F.col("tree").alias("of_tree"), F.col("id").alias("at"), F.col("up").alias("next"), F.col("n").alias("more"), F.col("s").alias("sum"))
        higher = _known(now.where("up is not null"), above, "up")
        higher = higher.select("tree", "id", F.col("next").alias("up"), (F.col("n") + F.col("more")).alias("n"), (F.col("s") + F.col("sum")).alias("s"))
        rounds.append(materialise(higher.unionByName(now.where("up is null")), "chat-climb"))
    return rounds


def branches(rounds: list[DataFrame], best: int | None = BEST) -> DataFrame:
    """tree, leaf, n, score (the mean of its messages), branch (rank from 1): the best of each tree, or all."""
    parents = rounds[0].where("up is not null").select(F.col("tree").alias("of_tree"), F.col("up").alias("at")).distinct()
    leaves = _known(rounds[-1].where("up is null"), parents, "id", "left_anti")
    scored = leaves.select("tree", F.col("id").alias("leaf"), "n", (F.col("s") / F.col("n")).alias("score"))
    order = Window.partitionBy("tree").orderBy(F.desc("score"), F.desc("n"), "leaf")
    ranked = scored.withColumn("branch", F.row_number().over(order))
    return ranked if best is None else ranked.where(F.col("branch") <= best)


def members(chosen: DataFrame, rounds: list[DataFrame]) -> DataFrame:
    """chosen with a row for each message of the path: id and position from 0 at the root."""
    rows = chosen.withColumns({"id": F.col("leaf"), "below": F.lit(0).cast("long")})
    for k in reversed(range(len(rounds))):
        above = rounds[k].where("up is not null").select(F.col("tree").alias("of_tree"), F.col("id").alias("at"), "up")
        both = F.array(F.struct("id", "below"), F.struct(F.col("up").alias("id"), (F.col("below") + (1 << k)).alias("below")))
        met = _known(rows, above, "id", "left").withColumn("of", F.explode(F.filter(both, lambda x: x["id"].isNotNull())))
        rows = met.select(*chosen.columns, "of.id", "of.below")
    return rows.withColumn("position", F.col("n") - 1 - F.col("below")).drop("below")


def format_paths(paths: DataFrame, messages: DataFrame, learn=LEARN) -> DataFrame:
    """tree, leaf, branch, score, n_turns, text, loss: array of (start, end, first_byte, bytes) of each text
    whose role is learnt."""
    said = messages.select(F.col("tree").alias("of_tree"), F.col("id").alias("at"), "role", "text")
    turns = _known(paths, said, "id").select(
        "tree", "leaf", "branch", "score", "position",
        F.concat(F.lit(_OPEN), marked(F.col("role"), _ROLE_MARKS), F.lit("\n")).alias("head"),
        marked(F.col("text")).alias("body"),
        F.coalesce(F.col("role").isin(*learn), F.lit(False)).alias("learnt"),
    )
    before = Window.partitionBy("tree", "leaf").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    sized = {}
    for name, size in (("chars", F.char_length), ("bytes", F.octet_length)):
        whole = (size("head") + size("body") + len(_END)).cast("long")
        sized[name] = F.coalesce(F.sum(whole).over(before), F.lit(0)) + size("head")
    laid = turns.withColumns(sized)
    span = F.struct(F.col("chars").alias("start"), (F.col("chars") + F.char_length("body")).alias("end"), F.col("bytes").alias("first_byte"), F.octet_length("body").alias("bytes"))
    piece = F.struct("position", F.concat("head", "body", F.lit(_END)).alias("piece"), F.when(F.col("learnt"), span).alias("span"))
    whole = laid.groupBy("tree", "leaf").agg(F.first("branch").alias("branch"), F.first("score").alias("score"), F.sort_array(F.collect_list(piece)).alias("of"))
    return whole.select(
        "tree", "leaf", "branch", "score", F.size("of").cast("long").alias("n_turns"),
        F.array_join(F.transform("of", lambda x: x["piece"]), "").alias("text"),
        F.filter(F.transform("of", lambda x: x["span"]), lambda x: x.isNotNull()).alias("loss"),
    )


def format_trees(messages: DataFrame, best: int | None = BEST, learn=LEARN) -> DataFrame:
    """The chosen branches of reply trees (tree, id, parent, role, text, score; one row an id, see messages_of) as
    conversations, written as a table."""
    held = materialise(messages, "chat-messages")
    rounds = climb(held)
    out = materialise(format_paths(members(branches(rounds, best), rounds), held, learn), "chat")
    discard(held, *rounds)
    return out


def turns_of(formatted: DataFrame) -> DataFrame:
    """formatted with `turns`, an array of (role, text) read from its text alone."""
    pieces = F.split("text", _END, -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece):
        head = F.substring_index(F.substr(piece, F.lit(len(_OPEN) + 1)), "\n", 1)
        body = F.substr(piece, F.char_length(head) + len(_OPEN) + 2)
        return F.struct(plain(head, _ROLE_MARKS).alias("role"), plain(body).alias("text"))

    return formatted.withColumn("turns", F.transform(pieces, turn))


def learnt_text(text: Column, loss: Column) -> Column:
    """All that lies under the loss mask, unescaped, nothing between. The bytes are taken once, not once a span."""
    cut = lambda raw: F.array_join(F.transform(loss, lambda x: plain(F.decode(F.substring(raw, x["first_byte"] + 1, x["bytes"]), "UTF-8"))), "")
    return F.transform(F.array(text.cast("binary")), cut)[0]


#: Added to the conversations of the query: both turns say what the template and its escapes look like.
PROBE_ID, PROBE = -7, "\\### Assistant: </turn> ok"


def digest(conversations: DataFrame) -> DataFrame:
    """What op11 returns, read back from the written conversations."""
    spark = conversations.sparkSession
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    probe = spark.range(2).select(F.lit(PROBE_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(PROBE).alias("text"))
    rows = conversations.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    read = turns_of(format_trees(conversation_messages(rows.unionByName(probe))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    out = read.select(F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), said.alias("said"), learnt_text(F.col("text"), F.col("loss")).alias("learnt"), F.char_length("text").cast("long").alias("formatted_chars"))
    return out.select("conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.char_length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), "formatted_chars")


ORACLE_SQL = r"""
WITH c AS (
    SELECT conv_id, turn, role, text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), t AS (
    SELECT conv_id, coalesce(role, '') AS said, coalesce(text, '') AS body,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n
    FROM c
), e AS (
    SELECT *, replace(replace(replace(body, '\', '\b'), '###', '\h'), '</turn>', '\e') AS inside,
           replace(replace(replace(replace(said, '\', '\b'), '###', '\h'), '</turn>', '\e'), chr(10), '\n') AS head
    FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(said || chr(10) || body || chr(10), '' ORDER BY n)) AS turns_sha256,
       CAST(coalesce(sum(length(body)) FILTER (WHERE said = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(body, '' ORDER BY n) FILTER (WHERE said = 'assistant'), '')) AS loss_sha256,
       CAST(sum(4 + length(head) + 1 + length(inside) + 9) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
