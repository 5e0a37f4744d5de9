"""Reply trees as conversations, against brute force over small trees, and the SQL of the query."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from fathomline.llm import chat

TREE = "tree long, id long, parent long, role string, text string, score double"
NASTY = ["\\", "\\\\###", "#####", "</turn>", "\n</turn>\n", "\\b\\h\\e\\n", "### user\n", "a\\", "é🙂</turn", "", None, "###</turn>\\###", chat.PROBE]


def plain_paths(rows, best):
    """(tree, path of ids) by walking down from every root."""
    by = {}
    for r in rows:
        if r[1] is not None:
            key = (r[0], r[1])
            old = by.get(key)
            order = lambda v: tuple((x is not None, x if x is not None else 0) for x in (v[2], v[3], v[4], v[5]))
            by[key] = r if old is None or order(r) < order(old) else old
    below, roots = {}, []
    for (tree, i), r in by.items():
        if r[2] is None or (tree, r[2]) not in by:
            roots.append((tree, i))
        else:
            below.setdefault((tree, r[2]), []).append(i)
    found = {}

    def walk(tree, path):
        children = below.get((tree, path[-1]), [])
        for c in children:
            walk(tree, [*path, c])
        if not children:
            scores = [by[tree, i][5] or 0.0 for i in path]
            found.setdefault(tree, []).append((-sum(scores) / len(path), -len(path), path[-1], path))

    for tree, i in roots:
        walk(tree, [i])
    return {(t, tuple(p[3])) for t, ps in found.items() for p in sorted(ps)[:best]}, by


def forest():
    rows = [(1, 1, None, "system", "root", 0.5), (1, 2, 1, "user", "a", 1.0), (1, 3, 1, "user", "b", 1.0), (1, 4, 2, "assistant", "deep", 0.0), (1, 5, 3, "assistant", "other", 0.25)]
    rows += [(2, i, i - 1 if i else None, "user" if i % 2 else "assistant", f"t{i}", None) for i in range(23)]
    rows += [(3, 1, 2, "user", "circle", 1.0), (3, 2, 1, "user", "circle", 1.0), (3, 3, 2, "user", "into it", 1.0), (3, 4, 4, "user", "self", 1.0)]
    rows += [(4, 7, 99, "assistant", "its parent is gone", 1.0), (4, 7, 99, "user", "same id", 1.0), (4, None, None, "user", "no id", 1.0)]
    rows += [(None, 1, None, "user", "null tree", None), (None, 2, 1, "assistant", None, None)]
    rows += [(5, i, (i - 1) // 2 if i else None, None, f"n{i}", float(i * 7 % 5)) for i in range(31)]
    rows += [(6, i, 0 if i else None, "assistant", "star", 1.0) for i in range(40)]
    return rows


@pytest.mark.parametrize("best", [1, 3, None])
def test_paths_equal_walks(spark, best):
    rows = forest()
    df = spark.createDataFrame(rows, TREE).withColumns({c: F.lit("clash") for c in ("up", "leaf", "branch", "n", "s", "text_", "turn", "position")})
    out = chat.turns_of(chat.format_trees(chat.messages_of(df), best)).collect()
    want, by = plain_paths(rows, best)
    texts = {(t, "".join(f"{by[t, i][3] or ''}\n{by[t, i][4] or ''}\n" for i in p)): p for t, p in want}
    got = {(r.tree, "".join(f"{t.role}\n{t.text}\n" for t in r.turns)) for r in out}
    assert got == set(texts)
    assert len(out) == len(want)
    if best is not None:
        assert all(1 <= r.branch <= best for r in out)


def test_marks_come_back_and_masks_hold_the_texts(spark):
    rows = [(1, i, i - 1 if i else None, "assistant" if i % 2 else t, t, None) for i, t in enumerate(NASTY)]
    out = chat.turns_of(chat.format_trees(spark.createDataFrame(rows, TREE))).withColumn("learnt", chat.learnt_text(F.col("text"), F.col("loss"))).first()
    assert [(t.role, t.text) for t in out.turns] == [(r[3] or "", r[4] or "") for r in rows]
    assert out.learnt == "".join(r[4] or "" for r in rows if r[3] == "assistant")
    assert out.text.count("</turn>") == len(rows) == out.n_turns
    raw = out.text.encode()
    for s in out.loss:
        assert out.text[s.start : s.end].encode() == raw[s.first_byte : s.first_byte + s.bytes]
    assert len(out.loss) == sum(r[3] == "assistant" for r in rows)


def test_long_chain_and_long_text(spark):
    rows = [(1, i, i - 1 if i else None, "user", "x" * (1_200_000 if i == 3 else i % 5), 0.0) for i in range(600)]
    out = chat.format_trees(spark.createDataFrame(rows, TREE)).select("n_turns", F.length("text").alias("n")).first()
    assert out.n_turns == 600 and out.n == sum(len("### user\n\n</turn>\n") + len(r[4]) for r in rows)


def test_empty(spark):
    none = spark.createDataFrame([], TREE)
    assert chat.format_trees(chat.messages_of(none)).count() == 0
    assert [r.conv_id for r in chat.digest(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect()] == [chat.PROBE_ID]


def test_query_equals_sql_on_odd_rows(spark):
    rows = [(c, None if k == 2 and c == 4 else k, "assistant" if k % 2 else "user", NASTY[(c + k) % len(NASTY)]) for c in range(8) for k in range(c)]
    rows += [(3, 1, "assistant", "again"), (3, 1, "assistant", "again"), (3, 1, None, None), (None, 0, "assistant", "no conversation"), (9, 0, "user", "x" * 300_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("id", "tree", "parent", "score", "n")})
    con = duckdb.connect()
    con.register("conversations", df.toPandas())
    con.execute("create table c2 as select cast(conv_id as bigint) conv_id, cast(turn as bigint) turn, role, text from conversations")
    want = con.execute(chat.ORACLE_SQL.replace("FROM conversations", "FROM c2")).fetchall()
    names = [d[0] for d in con.description]
    assert sorted(map(tuple, chat.digest(df).select(*names).collect()), key=str) == sorted(want, key=str)
    probe = next(r for r in want if r[0] == chat.PROBE_ID)
    text = chat.PROBE
    assert probe[1:5] == (2, hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest(), len(text), hashlib.sha256(text.encode()).hexdigest())


def test_plan_holds_no_python(spark):
    rows = spark.createDataFrame(forest(), TREE)
    held = chat.format_paths(chat.members(chat.branches(chat.climb(rows)), chat.climb(rows)), chat.messages_of(rows))
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
