"""From raw documents to token ids: five stages over whole tables.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before it
kept, and all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoploom.llm import bpe, mixing, pii, simhash, toxicity
from shoploom.llm.storage import cut, read

TOKENIZER = "word_bpe_49k.json"
#: Rows in a file of the mix, about.
FILE_ROWS = 8192


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out the documents that the toxicity network rejects.

    Other columns pass through, whatever their names. A null or empty text is one
    empty window, a long one is read whole; equal texts, repeated or not, and rows of
    any doc_id, null too, have the same verdict. No rows give none.
    """
    network = toxicity.train(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return toxicity.score(docs, network).where("predicted = 0").select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of near copies, as it is: that of the smallest doc_id, null last.

    Null and empty texts, and those without words, are one group. Of repeated rows
    one stays; rows that share only a doc_id, or have none, are told apart by their
    texts. No rows give none.
    """
    return simhash.keep_one(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts <EMAIL>, <IP>, <CARD> and <PHONE> in place of what they name, in whole texts, and counts n_chars anew.

    A null text stays null, with a null n_chars; all rows stay, repeated ones too, and
    so do other columns.
    """
    found = pii.find(docs, mask="text")
    return found.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the rows in the order of the mix: through each file of about FILE_ROWS rows, and from file to file by their names.

    Rows that share a doc_id, or have none, stand together at its first place. A null
    source counts as the empty name. All rows and columns stay as they are; no rows
    give none.
    """
    slim = docs.select("doc_id", "source")
    placed = mixing.mix(slim).groupBy("doc_id").agg(F.min(F.struct("position", "slot")).alias("p"), F.count("*").alias("n")).select("doc_id", "p.*", "n")
    parts, files = mixing.parted(cut(placed), FILE_ROWS)
    rows = docs.select(F.struct("*").alias("row")).join(parts, F.col("row.doc_id").eqNullSafe(parts["doc_id"]))
    return rows.select("row", "position", "part").repartitionById(files, F.col("part")).sortWithinPartitions("position").select("row.*")


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and a digest of what they decode to, with doc_id, lang, source and n_chars.

    A null or empty text has no ids; texts are encoded whole, and each row stays,
    repeated ones too.
    """
    path = public_tokenizers.path(TOKENIZER)
    return bpe.round_trip(docs.select("doc_id", "lang", "source", "n_chars", "text"), path).select(
        "doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
    ("bpe", encode_tokens),
]

#: Neither a trained network nor tokenization is within SQL; tests/llm compares run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
