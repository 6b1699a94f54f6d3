"""documents -> toxicity -> SimHash near-dedup -> PII surrogates -> source mix -> SentencePiece."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from notegrain.llm import pii, simhash, source_mix, toxicity
from notegrain.llm._common import checkpoint, table
from notegrain.llm.piece_bpe import model_bytes, piece_codec


def surrogate_key(spark: SparkSession) -> bytes:
    """The secret that spark.notegrain.pii.key holds; without one, the published key for tests, which hides nothing."""
    secret = spark.conf.get("spark.notegrain.pii.key", None)
    return secret.encode() if secret else pii.TEST_KEY


def toxic_documents_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; the classifier learns from the labels' training rows.

    Null and empty texts stay; repeated rows are judged alike; without labels of both kinds all stay; an empty table stays
    empty; further columns are carried along.
    """
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def one_of_each_group_stays(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays.

    Texts without words are one group; rows without id come after all others; of rows that repeat id and text one stays,
    chosen by a hash of all columns; an empty table stays empty; further columns are carried along.
    """
    return simhash.keep_one(docs)


def personal_data_replaced(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts become surrogates, and n_chars follows the text.

    Null texts stay null; repeated rows get the same surrogates; an empty table stays empty; further columns are carried along.
    """
    return pii.replace_in_rows(docs, surrogate_key(spark))


def sources_mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources come to their target weights.

    Null source is a source; texts without words count nothing and come along with their source's whole repetitions; rows
    that tie in their place are taken alike; an empty table stays empty; further columns are carried along.
    """
    return source_mix.repeat_rows(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids, with their digests.

    Null and empty texts have no ids; repeated rows give repeated results; an empty table stays empty.
    """
    return piece_codec(docs, model_bytes(), keep_ids=True)


STAGES = [
    ("toxicity", toxic_documents_go),
    ("simhash_near_dedup", one_of_each_group_stays),
    ("pii_surrogates", personal_data_replaced),
    ("source_mix", sources_mixed),
    ("sentencepiece", encoded),
]

#: SQL expresses neither the learnt classifier nor the components nor the surrogates; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after another, over the whole documents table; each one's rows are written before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = checkpoint(docs)
    return docs
