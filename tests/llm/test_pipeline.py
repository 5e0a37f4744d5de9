"""The pipeline's stages, each against what its decisions should be, and its packed result against the texts."""

import zlib

import public_tokenizers
import pytest

import corpus_pipeline
from fathomline.llm import tokens
from fathomline.llm.common import materialise

ITEM = "which of the seven northern rivers reaches the cold inland sea before the winter ice has closed its harbour"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    words = [f"w{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    text = lambda i: " ".join(words[(i * 37 + 11 * k * (i % 7 + 1) + k * k) % 100] for k in range(40))
    rows = []
    for i in range(240):
        t = text(i) + f" end{i} fin{i} last{i}"
        if i % 4 == 1:
            t = "you idiotic scumbag " + t
        if i == 100:
            t += " " + ITEM
        if i == 102:
            t += " write to jo.smith@example.org"
        rows.append((i, t, "en", "s", len(t)))
    rows += [(1000 + i, rows[i][1], "en", "s", rows[i][4]) for i in (0, 2, 4)] + [(2000, None, None, None, None), (2001, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 1)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(7, ITEM)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = corpus_pipeline.table(spark, folder, "documents")
    before = {r.doc_id: r for r in docs.collect()}
    ids, frames = {}, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = frames[name] = materialise(stage(spark, docs, folder), name)
        ids[name] = sorted(r.doc_id for r in docs.select("doc_id").distinct().collect())
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    clean = [i for i in before if not (i < 240 and i % 4 == 1)]
    assert ids["toxicity"] == sorted(clean)
    assert ids["near_dedup"] == sorted(i for i in clean if not 1000 <= i < 2000)
    assert ids["decontamination"] == sorted(set(ids["near_dedup"]) - {100})
    assert ids["pii"] == ids["packing"] == ids["decontamination"]
    after = {r.doc_id: r for r in frames["pii"].collect()}
    assert after[102].text == before[102].text.replace("jo.smith@example.org", "[email]") and after[102].n_chars == len(after[102].text)
    assert all(after[i].text == before[i].text for i in after if i != 102)
    encode = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"), False).by_library
    for r in frames["packing"].collect():
        data = encode(after[r.doc_id].text or "") + b"\0\0\0\0"
        assert zlib.crc32(data[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32


def test_run_equals_stages(spark, folder):
    assert corpus_pipeline.run(spark, folder).selectExpr("count(distinct doc_id)").first()[0] > 100
