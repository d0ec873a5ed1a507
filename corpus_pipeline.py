"""Training-data pipeline over ``documents``: each stage takes (spark, docs, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import mixing, packing, pii, simhash, toxicity
from ledgerline.llm.common import materialise, read_table, written_place


def whole_row(docs: DataFrame) -> Column:
    """All columns as one, so that those named like an operator's own stay as they are."""
    return F.struct(*docs.columns).alias("_row")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator does not reject; empty texts and documents without an id stay if they are clean.

    As in all stages, repeated rows and columns of any name pass through and no rows give no rows.
    """
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic")
    lexicon = toxicity.learn_lexicon(docs.select("doc_id", "text"), labels)
    scored = toxicity.score_texts(docs.select("text", whole_row(docs)), lexicon)
    return scored.where("score < 0.5").select("_row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by SimHash fingerprints of four-word shingles: that with the smallest id, null ids last.

    Texts without words have fingerprint zero and are one group; rows equal in id and text are one document.
    """
    return simhash.keep_one(docs)


def redact_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind in brackets; n_chars follows the text. Null and empty texts stay as they are."""
    clean = pii.redact(docs.select("doc_id", "text", whole_row(docs)))
    change = F.coalesce(F.length("text") - F.length("_row.text"), F.lit(0))
    own = {"text": F.col("text"), "n_chars": F.col("_row.n_chars") + change}
    return clean.select(*[own.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows written in the order of the mixture, by which the next stage numbers its sequences; none is dropped.

    A null source is a source of its own; null ids and repeated rows stay.
    """
    rows = docs.select("doc_id", "source", whole_row(docs))
    return mixing.in_order(mixing.mix(rows, MIX_WEIGHTS)).select("_row.*")


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens, numbered in the order in which the rows of ``docs`` were written.

    A null or empty text is one end token; repeated rows and null ids are packed each for itself.
    """
    return packing.pack(written_place(docs.select("doc_id", "text"), "place"), place="place")


MIX_WEIGHTS = {"src0": 8, "src1": 4, "src2": 4, "src3": 2}
STAGES = [
    ("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("private", redact_private), ("mix", mix_sources), ("pack", pack_windows),
]
ORACLE_SQL = None  # tokens, fingerprints and learnt weights have no SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
