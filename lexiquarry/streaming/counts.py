"""Token frequencies of a stream of documents, kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.tokenizers import WORDS, Tokenizer


def token_frequency_stream(docs: DataFrame, tokenizer: Tokenizer = WORDS) -> DataFrame:
    """(token, freq) over a streaming DataFrame of (doc_id, text); write it in complete or update mode."""
    return docs.select(F.explode(tokenizer.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("freq"))
