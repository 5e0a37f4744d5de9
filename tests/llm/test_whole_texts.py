"""Operators on texts do the whole job: brute force over small tables."""

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from fathomline.llm import near_dedup, pii, secrets, tokens


def test_the_plan_follows_the_threshold():
    assert near_dedup.plan(85) == (25, 5, 76)
    for percent in (30, 50, 70, 80, 85, 90, 99, 100):
        bands, band, bits = near_dedup.plan(percent)
        assert (1 - (percent / 100) ** band) ** bands < 1e-6 and bits <= near_dedup.BITS
    r = np.random.default_rng(3)
    for percent in (50, 80):
        bands, band, bits = near_dedup.plan(percent)
        for _ in range(200):
            s = r.integers(0, 1 << 62, 300).astype(np.uint64)
            (a, x), (b, y) = near_dedup.signature(s[: 3 * percent], percent), near_dedup.signature(s, percent)
            assert set(a) & set(b) and np.bitwise_count(np.frombuffer(x, np.uint8) ^ np.frombuffer(y, np.uint8)).sum() <= bits


def test_the_pipeline_drops_near_copies_with_a_block_added(spark):
    text = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    rows = [(100 * at + i, text(i, n)) for i in range(8) for at, n in enumerate((500, 600, 700))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # 500 and 600 words are linked (496/596), 600 and 700 (596/696) too.
    assert sorted(r.doc_id for r in corpus_pipeline.keep_one_of_each(spark, docs, "").collect()) == list(range(8))


def test_pii_terms_are_judged_and_removed_all_over_the_document(spark):
    filler = " ".join(f"common{c}" for c in "abcdefghijklmnop")
    texts = [f"Zorblax wrote from joe@x.org {filler} then zorblax {filler} (Zorblax) and Quuxly Zorblax+1 ZorblaxJoe joe@x.orgé turn{k}" for k in range(3)]
    texts += [f"{filler} wrote then and item{i}" for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = pii.digest(docs).where("doc_id = 1").first().spans.split(",")
    removed = [texts[1][int(a) : int(b)] for k, a, b in (s.split(":") for s in spans) if k == "remove"]
    assert removed.count("Zorblax") == 3 and removed.count("zorblax") == 1 and {"Quuxly", "ZorblaxJoe"} <= set(removed)
    assert not {"wrote", "then", "and", "common"} & set(removed)
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert "orblax" not in clean[1] and "Quuxly" not in clean[1] and clean[10] == texts[10]


def test_pii_added_terms_equal_brute_force(spark):
    """Shares recomputed over all documents in plain Python, for entities and terms of many frequencies."""
    import math
    import re
    from collections import Counter, defaultdict

    r = random.Random(9)
    names = [f"name{c}" for c in "abcdefghijkl"]
    rows = []
    for i in range(160):
        words = [r.choice(names[: 3 + i % 9]) for _ in range(r.randint(1, 6))] + [f"filler{r.choice('xyzuvw')}"] * r.randint(0, 2)
        if i % 4 == 0:
            who = r.randint(0, 5)
            words += [f"user{who}@x.org", f"alias{'abcdef'[who]}"] + ([f"1.2.3.{who}"] if who % 2 else [])
        r.shuffle(words)
        rows.append((i, " ".join(words)))
    held, df, seen = {}, Counter(), {}
    for i, t in rows:
        found = {("email", m.lower()) for m in re.findall(r"[a-z0-9]+@[a-z.]+", t)} | {("ip", m) for m in re.findall(r"\b\d+\.\d+\.\d+\.\d+\b", t)}
        df.update({w for w in re.split("[^a-zA-Z]+", t.lower())})
        if found:
            held[i] = found
            seen[i] = {w.lower() for w in re.findall(r"(?<![\w.@])[a-z]+(?![\w@.])", re.sub(r"\S*[@\d]\S*", lambda m: "@" * len(m[0]) if "@" in m[0] or m[0].count(".") == 3 else m[0], t)) if len(w) >= 3}
    ne = Counter(e for es in held.values() for e in es)
    nb = Counter((e, w) for i, es in held.items() for e in es for w in seen[i])
    n, share = len(rows), defaultdict(float)
    for (e, w), k in nb.items():
        if k >= 2 and ne[e] >= 2:
            share[e, w] = math.log2(n * k / ne[e] / df[w]) / math.log2(n / ne[e])
    want = {(i, w) for i, es in held.items() for w in seen[i] if max(share[e, w] for e in es) >= 0.7}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    text = dict(rows)
    got = {(x.doc_id, text[x.doc_id][int(a) : int(b)].lower()) for x in pii.digest(docs).collect() for k, a, b in (s.split(":") for s in x.spans.split(",") if s) if k in ("generalise", "remove")}
    assert got == want and 10 < len(want)


def test_random_values_after_a_name_are_found(spark):
    r = random.Random(5)
    symbols = secrets.ALPHABETS["base64"][:62]
    forms = ("AWS_KEY={}", "AUTH={} next", "https://x.org/a?user=7&sig={}&n=1", "AWS_KEY={}==")
    rows, want = [], []
    for form in forms:
        for _ in range(60):
            value = "".join(r.choice(symbols) for _ in range(40))
            text = form.format(value)
            at, end = text.index(value), text.index(value) + 40 + 2 * text.endswith("==")
            want.append((form, f"random_base64:{at}:{end}"))
            rows.append((len(rows), text))
    rows.append((len(rows), "NAME=internationalization_of_the_thing"))
    got = {x.doc_id: x.spans.split(",") for x in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for form in forms:
        assert sum(w in got[i] for i, (f, w) in enumerate(want) if f == form) >= 50, form
    assert got[len(rows) - 1] == [""]


def test_added_tokens_in_a_text_have_their_ids():
    texts = ["a<|endoftext|>b", "<|startoftext|> one <|endoftext|>", "<|ENDOFTEXT|> x", "é <|endoftext|> ü", "<|endoftext|", "plain text"]
    for name, ends in (("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)):
        path = public_tokenizers.path(name)
        plain, mine = Tokenizer.from_file(path), tokens.Encoder(path, ends)
        assert [t for t in texts if np.frombuffer(mine.encode(t), "<u4").tolist() != plain.encode(t, add_special_tokens=False).ids] == []
        assert plain.token_to_id("<|endoftext|>") in np.frombuffer(mine.encode(texts[0]), "<u4")
