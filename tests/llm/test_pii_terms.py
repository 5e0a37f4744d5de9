"""Terms that reveal: dense documents, copies and repeated rows, and letters whose lower case holds a mark."""

from fathomline.llm import pii

SCHEMA = "doc_id long, text string"


def hidden(spark, rows):
    """The words that are hidden, by document."""
    out, text = {}, dict(rows)
    for r in pii.digest(spark.createDataFrame(rows, SCHEMA)).collect():
        spans = [s.split(":") for s in r.spans.split(",") if s]
        out.setdefault(r.doc_id, set()).update(text[r.doc_id][int(a) : int(b)] for k, a, b in spans if k in ("generalise", "remove"))
    return out


def base(n=40):
    return [(100 + i, f"the plumber wrote about item{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyz'[i // 100]} from here today") for i in range(n)]


def test_repeated_rows_change_nothing(spark):
    rows = [(i, f"Zorblax wrote from joe@x.org about thing{'abcd'[i]}") for i in range(2)] + base()
    once = hidden(spark, rows)
    assert once[0] == {"Zorblax"} == once[1]
    assert hidden(spark, rows * 20) == once


def test_copies_under_other_ids_are_no_support(spark):
    text = "lorem ipsum dolor from joe@x.org about nothing"
    rows = [(i, text) for i in range(6)] + base()
    assert not any(hidden(spark, rows).values())
    rows.append((50, "Zorblax wrote from joe@x.org with a lorem"))
    got = hidden(spark, [*rows, (51, "Zorblax wrote to joe@x.org again")])
    assert got[50] == {"Zorblax", "lorem"} and got[51] == {"Zorblax"} and got[0] == {"lorem"} == got[5]


def test_marks_of_lower_case(spark):
    rows = [(i, f"xİstanbul Zorblax wrote from joe@x.org about thing{'abcd'[i]}") for i in range(2)] + base()
    assert hidden(spark, rows)[0] == {"xİstanbul", "Zorblax"}


def test_dense_documents(spark):
    """Two logs of thousands of addresses and words each: pairs of entity and word would be nine million a document."""
    word = lambda k: "".join("abcdefghij"[int(d)] for d in f"{k:05d}")
    log = lambda turn: " ".join(f"{word(k)} u{k}@x.org" for k in range(3000)) + f" turn{turn}"
    rows = [(1, log("one")), (2, log("two")), *base(340 - 40)]
    got = hidden(spark, rows)
    assert got[1] == got[2] == {word(k) for k in range(3000)}
    assert not any(v for k, v in got.items() if k > 2)
