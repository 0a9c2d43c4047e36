"""The corpus pipeline: four stages over documents, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.llm import bagminhash, bpe, gru_lid, mixing
from noteloom.llm.common import discard, stash

#: Documents whose best language has less of the pooled probability are rejected, as are those without a letter.
LEAST_LANGUAGE = 0.4


#: Rows of a batch that goes to Python: texts may be long, and four stages share an executor's memory.
BATCH_ROWS = 1000


def _small_batches(spark: SparkSession) -> None:
    """For the write of a stage's result, which happens after its function returns."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; trained on those whose crc32(doc_id) mod 3 is not 1.

    Rows are judged one by one, repeated ones and those with a null id too; a null text, or one without a letter, goes.
    """
    _small_batches(spark)
    net = gru_lid.train(docs.where(gru_lid.remainder(F.col("doc_id"), 3) != 1))
    own = docs.select(F.struct(*docs.columns).alias("_d"), F.col("text").alias("_text"))
    found = gru_lid.identify(own, net, "_text").where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE))
    return found.select("_d.*")


#: Up to so many ids of documents that go, or that several rows share, are broadcast (8 bytes each); beyond, documents are shuffled.
BROADCAST_IDS = 4_000_000


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one with the smallest id.

    Of rows that share an id the smallest, column by column, stays. Documents with a null id belong to no class and stay.
    """
    found = bagminhash.near_duplicates(docs).where("doc_id is not null")
    marks = found.groupBy("doc_id").agg(F.max("kept").alias("_kept"), F.count("*").alias("_n")).where("not _kept or _n > 1").select("doc_id", "_kept")
    marks = stash(marks, "marks")
    discard(found)
    few = marks.count() <= BROADCAST_IDS
    marked = lambda which: F.broadcast(marks.where(which).select("doc_id")) if few else marks.where(which).select("doc_id")
    own = docs.select(F.col("doc_id"), F.struct(*docs.columns).alias("_row"))
    once = own.join(marked("_kept"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("_row").alias("_row"))
    return own.join(marked("true"), "doc_id", "left_anti").select("_row.*").unionByName(once.select("_row.*"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: not at all to three times, and whole.

    A null source is a source of its own; rows with a null id, or that share one, are documents like any other.
    """
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids_sha256, decoded_sha256 and the ids of every row, a null text being empty."""
    _small_batches(spark)
    keep = tuple(c for c in ("lang", "source") if c in docs.columns)
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True, keep=keep)


STAGES = [("language ID", language), ("near-duplicates", near_duplicates), ("mixing", mix), ("byte-level BPE", encode)]

#: No stage but mixing can be expressed in SQL: tests hold run() against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stash(stage(spark, docs, sf_dir), f"stage{k}")
        discard(before)
    return docs
