"""The corpus pipeline: language ID, near-duplicate removal, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all of docs, and returns a DataFrame; all but the last
return the columns of docs, which the next stage gets as reread from Parquet.  Each has the executors give back
the memory that what ran before it needed no longer than it ran.

* ``language_id`` learns from the labelled rows of docs that are not held out, and drops what it rejects.
* ``ngram_join`` keeps the first document of each group of near duplicates (five words, 0.8).
* ``mixing`` returns every document as often as its source's target says: not at all, once or twice.
* ``best_fit_packing`` returns the pieces of all documents with their places in sequences.

Defined results: columns besides doc_id, text, lang and source pass through every stage but the last as they are,
whatever their names; for nulls, empty and long texts, ties and repeated rows each operator's docstring holds; an
empty table passes every stage as an empty one.

SQL can express none of them whole (compression, rounding by hashes, tokenizers): ``ORACLE_SQL`` is None and
the stages are tested against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglathe.llm import language_id, mixing, ngram_join, packing
from loglathe.llm.common import Kept, packed, passing, settle, table, unpacked
from loglathe.llm.queries import tokenizer

ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    settle(spark)
    known = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))))
    rows = docs.select(packed(tuple(docs.columns)).alias("row"), "text")
    judged = language_id.predict(rows, known, carry=("row",))
    return judged.where(~F.col("rejected")).select(*unpacked(tuple(docs.columns), ()))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    settle(spark)
    return ngram_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    settle(spark)
    return mixing.apply_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    settle(spark)
    return packing.pack_documents(docs, tokenizer("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("language_id", identify_language),
    ("ngram_join", drop_near_duplicates),
    ("mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; what lies between them is written to the shared folder."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with passing():
            kept = Kept(stage(spark, docs, sf_dir), name).stay()
        if before:
            before.drop()
        docs, before = kept.df, kept
    return STAGES[-1][1](spark, docs, sf_dir)
