"""The registered queries of this subpackage and, where SQL can express them, their DuckDB forms."""

from __future__ import annotations

import public_tokenizers

from . import chat, codes, decontaminate, kdtree, near_dedup, whitening
from .common import table
from .decontaminate import digest, find_contamination
from .langid import identify
from .near_dedup import digest as near_dedup_digest
from .packing import pack_documents
from .pii import digest as pii_digest
from .quality import score_quality
from .secrets import scan_secrets
from .toxicity import digest as toxicity_digest
from .wavelet import read_shards, write_shards


def op1_toxicity_crf(spark, sf_dir):
    return toxicity_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_secret_scan(spark, sf_dir):
    return scan_secrets(table(spark, sf_dir, "documents"))


def op3_pii_sanitisation(spark, sf_dir):
    return pii_digest(table(spark, sf_dir, "documents"))


def op4_kdtree_topk(spark, sf_dir):
    return kdtree.nearest(table(spark, sf_dir, "embeddings"))


def op5_best_fit_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_wavelet_token_output(spark, sf_dir):
    return read_shards(write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op7_minhash_near_dedup(spark, sf_dir):
    return near_dedup_digest(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark, sf_dir):
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_benchmark_decontamination(spark, sf_dir):
    return digest(find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))).drop("hit_offsets")


def op10_language_id(spark, sf_dir):
    return identify(table(spark, sf_dir, "documents"))


def op11_reply_tree_chat(spark, sf_dir):
    return chat.digest(table(spark, sf_dir, "conversations"))


def op12_heap_lloyd_codes(spark, sf_dir):
    return codes.digest(table(spark, sf_dir, "embeddings"))


def op13_compensated_whitening(spark, sf_dir):
    return whitening.digest(table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    return {f.__name__: f for f in (
        op1_toxicity_crf,
        op2_secret_scan,
        op3_pii_sanitisation,
        op4_kdtree_topk,
        op5_best_fit_packing,
        op6_wavelet_token_output,
        op7_minhash_near_dedup,
        op8_quality_classifier,
        op9_benchmark_decontamination,
        op10_language_id,
        op11_reply_tree_chat,
        op12_heap_lloyd_codes,
        op13_compensated_whitening,
    )}


def oracle_sql() -> dict:
    return {"op4_kdtree_topk": kdtree.ORACLE_SQL, "op7_minhash_near_dedup": near_dedup.ORACLE_SQL, "op9_benchmark_decontamination": decontaminate.ORACLE_SQL, "op11_reply_tree_chat": chat.ORACLE_SQL, "op12_heap_lloyd_codes": codes.ORACLE_SQL}
