"""From raw documents to packed training sequences: five stages, each of one operator.

Every stage is (spark, docs, sf_dir) -> DataFrame. All but the last return the columns of ``documents``; each is
written as Parquet and read again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcframe.llm._common import materialize
from arcframe.llm.language import UNDETERMINED, identify_languages
from arcframe.llm.line_dedup import dedup_lines
from arcframe.llm.minhash import near_duplicates
from arcframe.llm.mixing import emit_mixture
from arcframe.llm.packing import encode_pieces, pack
from arcframe.llm.queries import WORD_BPE, documents, tokenizer_path
from arcframe.session import reach_workers

#: A text of which no language has half the words is rejected.
MIN_LANGUAGE_SHARE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in a language that the model knows stay; those without letters or a main language go."""
    tagged = identify_languages(docs)
    return tagged.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= MIN_LANGUAGE_SHARE)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated and nearly repeated lines go; a document goes if no line with a word is left of it."""
    cut = dedup_lines(docs).where("n_removed = 0 or n_removed < n_lines")
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def minhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return near_duplicates(docs).where("kept").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources takes them."""
    return emit_mixture(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 2048 tokens."""
    pieces = encode_pieces(docs, tokenizer_path(WORD_BPE), with_ids=False)
    return pack(pieces, order=["doc_id", "piece"], capacity=2048)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("minhash", minhash), ("mixing", mixing), ("packing", packing)]

#: Language models, SimHashes and tokenizers have no SQL form; the tests hold the stages against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``."""
    docs = documents(reach_workers(spark), sf_dir)
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
