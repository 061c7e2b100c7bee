"""The token stream: vocabulary, ids, global positions and byte offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranges import with_prefix_sums
from .tokenizers import WORDS, Tokenizer

UNKNOWN = "<unk>"
DEFAULT_CAP = 2**19


def document_tokens(docs: DataFrame, tokenizer: Tokenizer = WORDS) -> DataFrame:
    """(doc_id, words) of a corpus (doc_id, text)."""
    return docs.select("doc_id", tokenizer.tokens(F.col("text")).alias("words"))


def token_rows(words: DataFrame) -> DataFrame:
    """(doc_id, tok_idx, token), one row a token."""
    return words.select("doc_id", F.posexplode("words").alias("tok_idx", "token"))


def vocabulary(rows: DataFrame, cap: int = DEFAULT_CAP) -> DataFrame:
    """(tok, token, freq): the cap - 1 most frequent words, ties by name, numbered from 0.

    The sort is a top-cap of partial counts; only the cap's words are numbered in one place.
    """
    return most_frequent(word_counts(rows), cap)


def word_counts(rows: DataFrame) -> DataFrame:
    """(token, freq) of all words."""
    return rows.groupBy("token").agg(F.count("*").alias("freq"))


def most_frequent(counts: DataFrame, cap: int) -> DataFrame:
    """The vocabulary of counted words."""
    top = counts.orderBy(F.desc("freq"), "token").limit(cap - 1)
    number = F.row_number().over(W.orderBy(F.desc("freq"), "token")) - 1
    return top.select(number.cast("int").alias("tok"), "token", "freq")


def named_vocabulary(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """(tok, token, freq) of the words that occur and have a vector (vec_id, word): ids are the vectors'. Of vectors
    with one name the first counts; a null name is none."""
    return named(word_counts(rows), vectors)


def named(counts: DataFrame, vectors: DataFrame) -> DataFrame:
    """The same of counted words."""
    ids = vectors.where(F.col("word").isNotNull()).groupBy(F.col("word").alias("token")).agg(F.min("vec_id").cast("int").alias("tok"))
    return counts.join(ids, "token").select("tok", "token", "freq")


def encode(rows: DataFrame, vocab: DataFrame, cap: int) -> DataFrame:
    """Adds tok; words out of the vocabulary get cap - 1. vocab has cap rows at most, so it is broadcast."""
    return rows.join(F.broadcast(vocab.select("token", "tok")), "token", "left").withColumn("tok", F.coalesce("tok", F.lit(cap - 1)))


def decode(rows: DataFrame, vocab: DataFrame) -> DataFrame:
    """Adds token; ids out of the vocabulary read <unk>."""
    return rows.join(F.broadcast(vocab.select("tok", "token")), "tok", "left").withColumn("token", F.coalesce("token", F.lit(UNKNOWN)))


def numbered(words: DataFrame) -> DataFrame:
    """Adds base: the position of each document's first token in the stream."""
    return with_prefix_sums(words.withColumn("n_tokens", F.size("words").cast("long")), "doc_id", {"base": "n_tokens"})


def token_stream(words: DataFrame, vocab: DataFrame, cap: int) -> DataFrame:
    """(pos, doc_id, tok_idx, tok): the whole corpus as one sequence of ids.

    Only documents' counts are summed up; tokens aren't moved for their positions.
    """
    rows = numbered(words).select("doc_id", "base", F.posexplode("words").alias("tok_idx", "token"))
    return encode(rows, vocab, cap).select((F.col("base") + F.col("tok_idx")).alias("pos"), "doc_id", "tok_idx", "tok")


def token_spans(docs: DataFrame, tokenizer: Tokenizer = WORDS) -> DataFrame:
    """(doc_id, tok_idx, token, byte_off): UTF-8 byte offsets in the document."""
    raw = docs.select("doc_id", F.posexplode(F.arrays_zip(tokenizer.gaps(F.col("text")).alias("gap"), tokenizer.raw_tokens(F.col("text")).alias("raw"))).alias("tok_idx", "s"))
    raw = raw.select("doc_id", "tok_idx", F.col("s.0").alias("gap") if "0" in raw.schema["s"].dataType.names else F.col("s.gap"), F.col("s.1").alias("raw") if "1" in raw.schema["s"].dataType.names else F.col("s.raw"))
    upto = W.partitionBy("doc_id").orderBy("tok_idx").rowsBetween(W.unboundedPreceding, W.currentRow)
    end = F.sum(F.octet_length("gap") + F.octet_length("raw")).over(upto)
    token = F.lower("raw") if tokenizer.lower else F.col("raw")
    return raw.select("doc_id", "tok_idx", token.alias("token"), (end - F.octet_length("raw")).cast("long").alias("byte_off"))


def encode_with_spans(docs: DataFrame, vocab: DataFrame, cap: int, tokenizer: Tokenizer = WORDS) -> DataFrame:
    """(doc_id, tok_idx, tok, byte_off)."""
    return encode(token_spans(docs, tokenizer), vocab, cap).select("doc_id", "tok_idx", "tok", "byte_off")


def token_frequency(stream: DataFrame) -> DataFrame:
    return stream.groupBy("tok").agg(F.count("*").alias("freq"))


def token_counts(words: DataFrame) -> DataFrame:
    return words.select("doc_id", F.size("words").cast("long").alias("n_tokens"))


def offset_deltas(spans: DataFrame, block: int = 256) -> DataFrame:
    """Adds delta: the offset less the one before, in blocks of `block` tokens; null at a block's start."""
    w = W.partitionBy("doc_id", F.floor(F.col("tok_idx") / block)).orderBy("tok_idx")
    return spans.withColumn("delta", F.col("byte_off") - F.lag("byte_off").over(w))
