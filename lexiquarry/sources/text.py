"""Text sources: documents, lines of files, JSON lines, samples and synthetic lines."""

from __future__ import annotations

import sys
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ranges import with_prefix_sums
from ..scratch import scratch

#: Bytes of standard input that the driver holds at once.
INPUT_BYTES = 4 << 20
# How far a bound on tokens lies over the sample's estimate, and what each new try adds.
SAFETY, SAFETY_STEP = 1.3, 0.05


def corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): documents in order of id are one stream of tokens and bytes, a newline between two."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(line_id, byte_start, text) of a file's lines, stripped on the right; the last line needs no newline.

    A split's lines are numbered within it, and the splits' totals (one row each) give the rest, so
    nothing is sorted or moved.
    """
    lines = spark.read.option("lineSep", "\n").text(path).withColumn("_at", F.monotonically_increasing_id())
    lines = lines.withColumn("_part", F.shiftright("_at", 33)).withColumn("_bytes", (F.octet_length("value") + 1).cast("long"))
    totals = lines.groupBy("_part").agg(F.count("*").alias("n"), F.sum("_bytes").alias("b")).collect()
    base, n, b = [], 0, 0
    for r in sorted(totals, key=lambda r: r["_part"]):
        base.append((r["_part"], n, b))
        n, b = n + r.n, b + r.b
    bases = F.broadcast(spark.createDataFrame(base, "_part long, _n long, _b long"))
    before = W.partitionBy("_part").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    joined = lines.join(bases, "_part").withColumn("byte_start", F.col("_b") + F.coalesce(F.sum("_bytes").over(before), F.lit(0)))
    return joined.select((F.col("_n") + F.col("_at") - F.shiftleft("_part", 33)).alias("line_id"), "byte_start", F.regexp_replace("value", r"\s+$", "").alias("text"))


def line_table(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, byte_start, text) of the lines of a corpus; byte_start counts from the first document."""
    sized = docs.withColumn("_size", (F.octet_length("text") + 1).cast("long"))
    based = with_prefix_sums(sized, "doc_id", {"_base": "_size"})
    lines = based.select("doc_id", "_base", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    before = W.partitionBy("doc_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    start = F.col("_base") + F.coalesce(F.sum(F.octet_length("text") + 1).over(before), F.lit(0))
    return lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"), start.cast("long").alias("byte_start"), "text")


def standard_input(spark: SparkSession, stream: BinaryIO | None = None) -> str:
    """The path of a copy of standard input in the shared folder, from which executors can read it by splits."""
    path = scratch(spark, "input")
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place)
    try:
        while piece := (stream or sys.stdin.buffer).read(INPUT_BYTES):
            out.write(bytearray(piece))
    finally:
        out.close()
    return path


def json_lines(df: DataFrame, json_col: str, key: str) -> DataFrame:
    """A column of JSON objects, or a file's lines of them, to the text under /key."""
    return df.withColumn("text", F.get_json_object(F.col(json_col), f"$.{key.lstrip('/')}"))


def read_json_lines(spark: SparkSession, path: str, key: str) -> DataFrame:
    return json_lines(spark.read.text(path), "value", key).select("text")


def query_list(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, phrase), one phrase a line."""
    return text_files(spark, path).where(F.length("text") > 0).select(F.col("line_id").alias("query_id"), F.col("text").alias("phrase"))


def random_chunks(docs: DataFrame, size: int, fraction: float, seed: int = 0) -> DataFrame:
    """Chunks of `size` characters of a sample of documents, never cutting a code point."""
    return docs.sample(fraction, seed).select("doc_id", F.expr(f"substring(text, 1 + cast(pmod(xxhash64(doc_id, {seed}), greatest(1, length(text) - {size} + 1)) as int), {size})").alias("chunk"))


def estimate_tokens(docs: DataFrame, tokenizer, fraction: float = 1.0, seed: int = 0) -> DataFrame:
    """One row: the number of tokens as a sample tells it; exact for fraction 1."""
    part = docs if fraction >= 1 else docs.sample(fraction, seed)
    return part.agg((F.coalesce(F.sum(F.size(tokenizer.tokens(F.col("text")))), F.lit(0)) / F.lit(min(1.0, fraction))).cast("long").alias("tokens"))


def token_bound(docs: DataFrame, tokenizer, fraction: float = 0.01, retries: int = 0, seed: int = 0) -> DataFrame:
    """One row: a bound on the tokens, from a sample's tokens a byte and the bytes of all texts, in one scan.

    Only the sample is tokenized. Each further try (`retries`) doubles what the bound adds to its first safety. With no
    byte in the sample it is the number of bytes; no documents give 0.
    """
    safety = SAFETY + SAFETY_STEP * (2**retries - 1)
    sized = docs.select("text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("b"), (F.rand(seed) < fraction).alias("s"))
    total, drawn = F.coalesce(F.sum("b"), F.lit(0)), F.sum(F.when(F.col("s"), F.col("b")))
    tokens = F.sum(F.when(F.col("s"), F.size(tokenizer.tokens(F.col("text")))))
    return sized.agg(F.coalesce(F.try_divide(F.lit(safety) * total * tokens, drawn), total).cast("long").alias("tokens"))


def synthetic_lines(spark: SparkSession, n: int, words: int, vocabulary: list[str], seed: int = 42) -> DataFrame:
    """(line_id, text): n lines of `words` words, each drawn by the first 32 bits of the md5 of line-place-seed."""
    arr = F.array(*[F.lit(w) for w in vocabulary])
    drawn = lambda i: F.conv(F.substring(F.md5(F.concat_ws("-", F.col("id"), i, F.lit(seed)).cast("binary")), 1, 8), 16, 10).cast("long")
    pick = lambda i: F.element_at(arr, (drawn(i) % len(vocabulary) + 1).cast("int"))
    return spark.range(n).select(F.col("id").alias("line_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(words)), pick), " ").alias("text"))
