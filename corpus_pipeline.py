"""The corpus pipeline: five stages over `documents`, each written and read again.

quality      documents that the classifier rejects (score below 0.7) go
near_dedup   of documents linked by a similarity of 0.80 and more, one stays
decontaminate  documents that hold a ten-word window of a benchmark item go
mix          documents are drawn so that sources, languages and topics approach
             tempered shares; a class at or below its target stays whole
tokens       the rest is encoded into token files and described from them

Defined results: null and empty texts are scored as texts without a difference,
are linked with nothing, hold no window, weigh no tokens, and are encoded as the
end id alone; null languages and sources are classes of their own; texts of any
length go through whole; of repeated rows one stays, and rows without doc_id,
which nothing could be traced to, go in near_dedup; equal scores and draws are
treated alike; further columns stay, whatever their names, up to the last stage;
an empty table gives an empty result, and so does an empty stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontaminate, minhash, mixing, quality, token_files
from millrace.llm.common import give_back, stored, table
from millrace.llm.queries import END_ID, TOKENIZER


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    give_back()  # the texts that the driver has fitted on
    return quality.kept(docs, model)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.one_of_each(docs, percent=80)


def unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, exponent=0.7, rate=1.0)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_files.token_index(spark, token_files.write_tokens(docs, TOKENIZER, END_ID))


STAGES = [("quality", good), ("near_dedup", distinct), ("decontaminate", unleaked), ("mix", mix), ("tokens", tokens)]
#: zstandard sizes and tokenizer ids are not to be had in SQL; tests compare with brute force
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
