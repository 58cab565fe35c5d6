"""The corpus pipeline: documents in, packed training sequences out.

Each stage reads all that the one before it kept and takes effect on the next; every stage's result is
written as Parquet and read again, so a lost executor costs no more than the stage it was in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logweir.llm import jaccard, mixing, packing, pii, quality, queries, storage

LEAST_QUALITY = 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    model = queries.quality_model(docs, queries.table(spark, sf_dir, "labels"))
    return quality.filter_quality(docs, model, LEAST_QUALITY)


def keep_one_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity of 0.8 or more."""
    return jaccard.keep_one_each(docs, words=5, over=4, under=5)


def pseudonymize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by pseudonyms of the same format."""
    return pii.pseudonymize(docs, queries.PII_KEY, kinds=None)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixing.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, each with its place in a sequence of 4096 tokens."""
    return packing.pack(docs, capacity=4096, end_id=1)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_one_each),
    ("PII pseudonyms", pseudonymize),
    ("source mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: SQL can't express the trained classifier and the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table; what a stage wrote on its way is deleted when its result is written.

    Each stage treats nulls, ties, repeated rows, long texts and empty tables as its operator says; an empty table goes
    through all of them and gives no pieces.  Columns besides those that a stage reads are carried along.
    """
    docs, last = queries.table(spark, sf_dir, "documents"), ""
    for _, stage in STAGES:
        before = [path for path in storage.written() if path != last]
        docs = storage.materialize(stage(spark, docs, sf_dir), "stage")
        last = storage.written()[-1]
        storage.discard_all(spark, [*before, last])
    return docs
