"""A training corpus from raw documents: reject toxic ones, keep one of each group of near duplicates, drop
those that hold test questions, sanitise personal data, pack what is left into sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet in the shared
folder and reads again, so that a lost executor costs a stage's tasks and never an earlier stage. All but
the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers

from fathomline.llm import decontaminate, near_dedup, packing, pii, toxicity
from fathomline.llm.common import materialise, table


def reject_toxic(spark, docs, sf_dir):
    """Learns from labelled rows of the raw documents, and drops what the model calls toxic."""
    return toxicity.drop_toxic(docs, toxicity.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def keep_one_of_each(spark, docs, sf_dir):
    return near_dedup.drop_near_duplicates(docs, width=5, percent=80)


def drop_test_questions(spark, docs, sf_dir):
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def sanitise_personal_data(spark, docs, sf_dir):
    return pii.sanitise(docs)


def pack_sequences(spark, docs, sf_dir):
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", keep_one_of_each),
    ("decontamination", drop_test_questions),
    ("pii", sanitise_personal_data),
    ("packing", pack_sequences),
]

#: A trained model decides the first stage, so SQL cannot give the rows; tests hold them against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
