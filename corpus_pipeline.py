"""The corpus pipeline: toxicity, quality rules, near-dedup, secret scans, packing.

Each stage reads what its predecessor kept and writes its own result to the shared folder;
what a stage wrote on the way, and its input, go when its result is there.

Edge cases: a null text is empty: it is scored as one, has too few words for the quality rules
and leaves there; null languages and sources are groups of their own; rows with a null doc_id are scored
and judged by their text and stay in near-dedup; of rows that repeat a doc_id and its text
one stays; texts of any length are read whole, and packed as several
pieces; further columns of documents are carried up to packing, whatever their names; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import neardup, packing, quality, secrets, toxicity
from tessera.llm.bpe import tokenizer_path
from tessera.llm.common import cut, forget, recorded, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, tokenizer_path(secrets.VOCABULARY))


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", keep_good),
    ("minhash_near_dedup", keep_one),
    ("secret_scans", redact_secrets),
    ("packing", pack_batches),
]

# A trained classifier and a tokenizer have no SQL form; tests compare the rows of run
# with a plain version of the stages behind the classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with recorded() as made:
            before, docs = docs, cut(stage(spark, docs, sf_dir), name)
        forget(before, *(t for t in made if t is not docs))
    return STAGES[-1][1](spark, docs, sf_dir)
