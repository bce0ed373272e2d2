"""A corpus pipeline of five stages over ``documents``; part of the corpus operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foreopen.llm import langid, line_dedup, mixing, pieces, simhash
from foreopen.llm.common import remove, shared_folder

REST = ("lang", "source", "n_chars")
COLUMNS = ("doc_id", "text", *REST)
#: A document stays if a language is this likely; short clean texts reach little more than an even chance.
LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; null, empty and letterless texts go."""
    model = langid.learn(docs)
    found = langid.identify(docs, model, carry=("text", *REST))
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that repeat over documents; n_chars follows the text. No document goes."""
    return line_dedup.dedup_lines(docs, carry=("lang", "source")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest id's; one without id where the whole group has none."""
    return simhash.one_of_each(docs.select(*COLUMNS)).select(*COLUMNS)


def weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice; documents without words likewise."""
    taken = mixing.mix(docs, carry=("text", "lang", "n_chars"))
    return taken.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each text, with their number: none for an empty text, null for a null one."""
    return pieces.encode(docs, carry=("source",)).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("langid", language), ("line_dedup", lines), ("simhash", near_copies), ("mixing", weights), ("pieces", encoded)]
#: The network, XXH64 and the vocabulary have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet under the shared folder and read again.

    What a stage wrote is deleted once the next one has been written.
    """
    base = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    out, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, out, sf_dir).write.parquet(path)
        out = spark.read.parquet(path)
        if last:
            remove(spark, last)
        last = path
    return out
