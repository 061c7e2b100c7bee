"""Embedding tables: (vec_id, embedding), with a column `word` where the source names its vectors.

Read are Parquet tables, lines of a word and its numbers (.vec, .txt), and matrices (.npy, .safetensors) with
names from a JSON vocabulary or a tokenizer's file beside them. Matrices are read by the executors, in blocks of rows.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import l2_normalize
from ..plugins import Plugins
from ..session import ship
from .text import text_files

EMBEDDINGS = Plugins("embedding")

#: Rows of a matrix that a task reads at once.
BLOCK_ROWS = 4096
# Number types of a .safetensors file (BF16 is the upper half of a 32-bit float).
TENSOR_TYPES = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "BF16": "<u2"}
# Ends of the names that input embeddings have in published models.
TENSOR_NAMES = ("embed_tokens.weight", "word_embeddings.weight", "wte.weight", "tok_embeddings.weight")


def _read(spark: SparkSession, path: str) -> DataFrame:
    local = path.removeprefix("file://")
    if local.endswith((".vec", ".txt")):
        return word_lines(spark, path)
    if local.endswith(".npy"):
        return matrix_rows(spark, npy_matrix(local))
    if local.endswith(".safetensors"):
        return matrix_rows(spark, tensor_matrix(local))
    if os.path.exists(os.path.join(local, "embedding.npy")):
        return named(matrix_rows(spark, npy_matrix(os.path.join(local, "embedding.npy"))), json_vocabulary(spark, os.path.join(local, "vocab.json")))
    if os.path.exists(os.path.join(local, "model.safetensors")):
        return named(matrix_rows(spark, tensor_matrix(os.path.join(local, "model.safetensors"))), piece_names(spark, os.path.join(local, "tokenizer.json")))
    table = spark.read.parquet(path)
    return table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), *[c for c in table.columns if c == "word"])


def word_lines(spark: SparkSession, path: str) -> DataFrame:
    """(vec_id, embedding, word) of a text file, a word and its numbers a line, with or without a first line that
    gives rows and dimensions. A word may hold spaces: the last numbers of a line are the vector. Empty file: no rows."""
    first = [r.value for r in spark.read.option("lineSep", "\n").text(path).limit(1).collect()]
    fields = first[0].split() if first else []
    header = len(fields) == 2
    size = int(fields[1]) if header else max(len(fields) - 1, 0)
    parts = text_files(spark, path).where((F.col("line_id") >= int(header)) & (F.length("text") > 0))
    parts = parts.select((F.col("line_id") - int(header)).alias("vec_id"), F.split("text", " ").alias("p"))
    words = F.greatest(F.size("p") - size, F.lit(0))
    return parts.select("vec_id", F.slice("p", words + 1, F.lit(max(size, 1))).cast("array<double>").alias("embedding"), F.array_join(F.slice("p", F.lit(1), words), " ").alias("word"))


@dataclass(frozen=True)
class Matrix:
    """Rows of numbers in a file that every executor can read."""

    path: str
    kind: str
    rows: int
    columns: int
    offset: int
    halves: bool = False

    def read(self, start: int, stop: int) -> np.ndarray:
        found = np.memmap(self.path, self.kind, "r", self.offset, (self.rows, self.columns))[start:stop]
        if self.halves:
            return (found.astype(np.uint32) << 16).view(np.float32).astype(np.float64)
        return found.astype(np.float64)


def npy_matrix(path: str) -> Matrix:
    found = np.load(path, mmap_mode="r")
    if found.ndim != 2 or not found.flags.c_contiguous:
        raise ValueError(f"{path} holds no table of rows")
    return Matrix(os.path.abspath(path), found.dtype.str, found.shape[0], found.shape[1], found.offset)


def tensor_matrix(path: str, name: str | None = None) -> Matrix:
    """A tensor by its name, or the only one whose name is that of input embeddings."""
    with open(path, "rb") as f:
        length = int.from_bytes(f.read(8), "little")
        header = json.loads(f.read(length))
    names = [n for n in header if (n == name if name else n.endswith(TENSOR_NAMES))]
    if len(names) != 1:
        raise ValueError(f"{path} has {len(names)} tensors that may be the embeddings: {names}")
    tensor = header[names[0]]
    rows, columns = tensor["shape"]
    return Matrix(os.path.abspath(path), TENSOR_TYPES[tensor["dtype"]], rows, columns, 8 + length + tensor["data_offsets"][0], tensor["dtype"] == "BF16")


def matrix_rows(spark: SparkSession, matrix: Matrix) -> DataFrame:
    """(vec_id, embedding) of a matrix."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0).to_pylist():
                start, stop = block * BLOCK_ROWS, min((block + 1) * BLOCK_ROWS, matrix.rows)
                flat = pa.array(matrix.read(start, stop).reshape(-1))
                ends = pa.array(np.arange(stop - start + 1, dtype=np.int32) * matrix.columns)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(start, stop)), pa.ListArray.from_arrays(ends, flat)], ["vec_id", "embedding"])

    ship(spark)
    return spark.range(-(-matrix.rows // BLOCK_ROWS)).mapInArrow(rows, "vec_id long, embedding array<double>")


def json_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(vec_id, word) of a JSON object that gives each word its id."""
    words = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,long>")).alias("word", "vec_id"))
    return words.select("vec_id", "word")


def piece_names(spark: SparkSession, path: str) -> DataFrame:
    """(vec_id, word) of a tokenizer's pieces, named as `SubwordTokenizer` names them: by the text they cover.
    Pieces of white space and parts of characters have no name."""
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    texts = model.decode_batch([[i] for i in range(model.get_vocab_size())], skip_special_tokens=False)
    names = [(i, t.strip()) for i, t in enumerate(texts) if t.strip() and "\ufffd" not in t]
    return spark.createDataFrame(pa.table({"vec_id": pa.array([i for i, _ in names], pa.int64()), "word": pa.array([t for _, t in names], pa.string())}))


def named(vectors: DataFrame, names: DataFrame) -> DataFrame:
    """Adds word, null where a vector has no name; the first of a vector's names by order of text."""
    return vectors.join(names.groupBy("vec_id").agg(F.min("word").alias("word")), "vec_id", "left")


def with_unknown(vectors: DataFrame) -> DataFrame:
    """Adds a zero vector under the next id, for unknown words."""
    top = vectors.agg((F.max("vec_id") + 1).alias("vec_id"), F.max(F.size("embedding")).alias("d"))
    zero = top.where(F.col("vec_id").isNotNull()).select("vec_id", F.array_repeat(F.lit(0.0), F.col("d")).alias("embedding"))
    return vectors.unionByName(zero, allowMissingColumns=True)


@EMBEDDINGS.add("plain")
def plain(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path)


@EMBEDDINGS.add("gensim", "fasttext", "llama")
def zero_row(spark: SparkSession, path: str) -> DataFrame:
    return with_unknown(_read(spark, path))


@EMBEDDINGS.add("transformers")
def unit_length(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path).withColumn("embedding", l2_normalize("embedding"))


def gather(ids: DataFrame, vectors: DataFrame, id_col: str = "tok") -> DataFrame:
    """Rows of ids with their vectors."""
    return ids.join(vectors.withColumnRenamed("vec_id", id_col), id_col)
