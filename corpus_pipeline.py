"""A corpus-cleaning pipeline out of the text operators.

``run`` applies STAGES to ``documents`` one after another; each stage's rows are written as Parquet in the
folder that all executors share and read again as the next one's input, and goes when the next stage is written.
All stages but the last return the columns of documents.

Defined results: a null, empty or letterless text is no language that is known, so its document goes in the first
stage. Rows that repeat count as one document: line dedup leaves all of them alike, and near-dedup keeps or drops all of
them; documents without id are kept by near-dedup. An empty table, or an empty benchmark, passes through. Columns
beside those of documents are kept up to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import bpe, decontam, langid, linededup, simhash
from gridloom.llm.common import delete, held_out, table, tables_until_done, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier knows; those that it rejects go."""
    return langid.filter_known(docs, langid.fit(docs.where(~held_out("doc_id", 4, 2))))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated runs of lines; a document of which nothing is left goes."""
    out = linededup.deduplicate(docs)
    cut = F.size("__removed") > 0
    out = out.where(~cut | F.coalesce(F.trim("__text") != "", F.lit(False)))
    n_chars = F.when(cut, F.length("__text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars"))
    return out.withColumns({"text": F.col("__text"), "n_chars": n_chars}).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of the least id."""
    return simhash.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's tokens, and the bytes that they decode to."""
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    out = bpe.encode_decode(docs, path, pattern)
    return out.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.octet_length("decoded").cast("long").alias("n_bytes"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language_id", language), ("line_dedup", lines), ("near_dedup", near_duplicates), ("decontamination", benchmark), ("byte_bpe", tokens)]

#: The stages hold trained models, fingerprints and a tokenizer, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with tables_until_done(spark) as made:
            docs = written(stage(spark, docs, sf_dir))
            path = made.pop()  # the stage's own table is the next one's input
        if before:
            delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
