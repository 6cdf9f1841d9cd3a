"""The corpus pipeline: quality rules, SimHash near-dedup, suffix-array dedup, mixing, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm import mixing, quality, rindex, sentencepiece_scan, simhash
from sessionloom.llm.common import drop, materialize, read_table, temporary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the trees reject go.  The trees are fitted on the labels of sf_dir.

    Null and empty texts fail the base rules; repeated rows are judged alike; columns of other names, whatever they are, stay.
    Without labels the base rules alone decide; an empty table gives no rows."""
    return quality.kept_documents(docs, quality.train(docs, read_table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar texts (shingles of five words, similarity 0.8) the document with the smallest id stays.

    Texts without words, null ones too, are one group; of repeated rows one stays; a null id is the smallest only among nulls.
    An empty table gives no rows."""
    return simhash.one_of_each(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 50-byte strings that start in a document with a smaller id are cut out; n_chars follows the text.

    Null and short texts stay as they are; rows without an id lose nothing; a text that is cut throughout is empty.  An empty
    table gives no rows."""
    cut = rindex.without_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in cut.columns else cut


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, each as often as the mix takes it.

    A null source is a source of its own; texts without words are never taken; repeated rows are taken one by one.  An empty
    table gives no rows."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, n_chunks, decoded and ids of each row.

    Null and empty texts have no ids; repeated rows are encoded alike; other columns are not read.  An empty table gives no
    rows."""
    return sentencepiece_scan.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("repeats", repeats), ("mixture", mixture), ("tokens", tokens)]
#: SQL has neither the trees, the fingerprints nor the pieces; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written to the shared folder and reread.

    What a stage has written on its way goes when its result is written, and that goes when the next one's is."""
    docs, last = read_table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with temporary(spark) as made:
            docs, path = materialize(stage(spark, docs, sf_dir), name)
            made.remove(path)
        drop(spark, *last)
        last = [path]
    return STAGES[-1][1](spark, docs, sf_dir)
