"""The corpus pipeline: language, lines, near duplicates, benchmark passages, packed sequences."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursefold.llm.common import discard, quoted, recorded, scratch, table, unboxed, write
from coursefold.llm.decontamination import find_benchmark, judged
from coursefold.llm.language import identify
from coursefold.llm.lines import dedup_lines
from coursefold.llm.packing import pack
from coursefold.llm.simhash import one_of_each


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models can tell; the predicted one replaces ``lang``, if there is such a column.

    Null and letterless texts go, as do texts too unlike the language that they are nearest to. A null doc_id
    is judged like others; further columns keep their values whatever their names.
    """
    found = identify(docs, *docs.columns).where("not rejected")
    return found.select(*unboxed(docs, lang=F.col("lang_pred")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand earlier, equal or near; those left without any words go.

    Where lines went ``n_chars``, if there is such a column, is that of what is left. Rows with a null doc_id come last in
    the order; further columns keep their values.
    """
    left = dedup_lines(docs)
    dropped = F.col(left.columns[-1]) > 0
    left = left.where(~dropped | (F.btrim("text", F.lit(" \t\n\r\x0b\x0c")) != ""))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(dropped, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return left.select(*map(quoted, docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least doc_id, or without any if none has one.

    Texts without words, null and empty ones, are one group. Of repeated rows one stays; further columns keep their values.
    """
    return one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated: less than a twentieth of their words is in benchmark windows.

    A null doc_id changes nothing; further columns keep their values whatever their names.
    """
    hits = judged(find_benchmark(docs, table(spark, sf_dir, "benchmark"), keep=tuple(docs.columns)))
    return hits.where("not contaminated").select(*unboxed(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, as operator 1 returns them.

    Null and empty texts are one token, repeated rows are packed once each; columns besides doc_id and text are ignored.
    """
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("packed", packed)]

#: A trained model, a hash outside SQL and a tokenizer decide; tests compare with plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        path = f"{scratch(spark)}-{name}"
        with recorded() as written:
            write(stage(spark, docs, sf_dir), path)
        discard(spark, written + before)  # not read again once the stage's result is written
        docs, before = spark.read.parquet(path), [path]
    return docs
