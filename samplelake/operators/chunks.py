"""Greedy packing of paragraphs into chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplelake.functions.text import BLANK_LINE, WordCounter, chunk_array, word_count


def with_chunks(
    df: DataFrame,
    text: str = "text",
    min_words: int | None = 200,
    sep: str = BLANK_LINE,
    *,
    joiner: str = "\n\n",
    count_words: WordCounter = word_count,
    name: str = "chunks",
) -> DataFrame:
    """Add the chunks of each document as one array column. Row-local: nothing is shuffled."""
    return df.withColumn(name, chunk_array(F.col(text), min_words, sep, joiner, count_words))


def pack_chunks(
    df: DataFrame,
    text: str = "text",
    min_words: int | None = 200,
    sep: str = BLANK_LINE,
    *,
    key: str = "doc_id",
    joiner: str = "\n\n",
    count_words: WordCounter = word_count,
) -> DataFrame:
    """One row per chunk: ``key, chunk_no, text, n_words``; a chunk has more than ``min_words``
    words unless it is its document's last."""
    packed = with_chunks(
        df.select(key, text), text, min_words, sep, joiner=joiner, count_words=count_words, name="__chunks"
    )
    # An outer explode, since for a plain one the optimizer adds a filter on the array's size,
    # which would compute the chunks again.
    rows = packed.select(key, F.posexplode_outer("__chunks").alias("chunk_no", "__c"))
    return rows.filter("chunk_no IS NOT NULL").select(
        key, "chunk_no", F.col("__c.text").alias("text"), F.col("__c.n_words").alias("n_words")
    )
