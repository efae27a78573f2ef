"""From documents to token ids: quality rules, line dedup, near-dedup, mixing and byte-level BPE.

Every stage takes and returns rows with the columns of ``documents``, whatever
else these are called, in their order (the last one returns digests). Null
ids, sources and languages are values like any other. An empty table gives no
rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import bpe, lines, mixing, quality, simhash
from tallyforge.llm.common import settle
from tallyforge.llm.queries import token_digests, vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the line labels reject go.

    Null, empty and wordless texts have too few words and go. Repeated rows
    are judged alike; rows stay as they came.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.train(docs, labels))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier equal or alike line go; ``n_chars`` follows the text.

    No row goes: a document keeps its blank lines or an empty text. Rows of
    equal id and text are cut alike. Of alike lines the first stays, by id
    (nulls last), then by the hash of the text and the line's place.
    """
    cut = lines.dedup_lines(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one of smallest id.

    Texts without a word have one fingerprint, so one of them stays. Of rows
    that repeat an id and a text one stays.
    """
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as its source's target takes it, up to three times.

    Wordless documents belong to no share and go. Of equal rows as many are
    taken as their share gives. The draw depends on the rows alone.
    """
    return mixing.apply_mix(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, as digests of the ids and of what they decode to; copies come back alike."""
    ranks, pattern = vocabulary("byte_bpe_multi_50k.tiktoken")
    return token_digests(bpe.tokenize(docs, ranks, pattern, ["doc_id"]))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("source_mixing", mix_sources),
    ("byte_bpe", encode_texts),
]

#: SQL cannot express the trained labeller and the drawn mix. The tests hold stages against plain versions
#: on their own inputs: all pairs of fingerprints, targets shared out again, the ids of the tokenizer's own library.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents below ``sf_dir``; what a stage keeps is written before the next begins."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
