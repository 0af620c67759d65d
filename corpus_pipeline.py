"""A cleaning pipeline over ``documents``: each stage works on all that the stage before it kept.

Defined cases, for all stages: a row is told by its doc_id and text, so rows with equal ids, or without an id, and
different texts are different documents; an empty table gives an empty result; null or clashing values in other columns
change nothing but for ``source`` (see ``secret``). All stages but the last return every column of their input, whatever
the names of further ones; the last returns doc_id and digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm import bpe, decontaminate, jaccard_join, secrets, toxicity
from tallyforge.llm.common import materialize, table
from tallyforge.llm.queries import tokenizer_path


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go: those with a score of 0.3 or more, a tie included. Null and empty texts get the score
    of the bias; repeated rows go or stay together. With an empty ``labels`` only the fixed word list counts."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one of the smallest id, then of the smallest text hash; a null
    id comes after all others. Repeated rows are one document. Texts without a word, null and empty ones too, all stay."""
    return jaccard_join.keep_one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go: 0.8 or more of its shingles, a tie included. Null and empty texts and an
    empty ``benchmark`` match nothing; repeated rows go or stay together."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking secrets are masked and ``n_chars`` counts the new text; no document goes. A null text stays null, a null
    ``source`` counts as one owner; each of several repeated rows is masked alike."""
    return secrets.mask_live(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each text; a null text counts as empty, and each of several repeated rows gives its own."""
    return bpe.encode_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("toxicity", toxic), ("jaccard_join", near_copies), ("decontamination", benchmark), ("secrets", secret), ("bpe", encode)]

#: Classifiers and connected components can't be said in SQL; tests compare each stage to a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
