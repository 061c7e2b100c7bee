"""Similar words, weighted moments of the embedding table, and whitened norms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import dot, edit_multiplier, l2_normalize, similarity
from ..session import ship

# Fixed values of the scoring: the norm of words that never occur, that of words that can't be
# edited, ids from which it holds, the rank of the word that sets the coefficient, and the norm cut.
NEVER, UNEDITABLE, FIRST_UNEDITABLE, RANK, NO_CUT = 1e20, 1e10, 50_000, 50, 1e9
EIGEN_FLOOR = 1e-11
LEAST_SIMILARITY = 0.20


def similarity_matrix(pattern: DataFrame, vectors: DataFrame) -> DataFrame:
    """(idx, tok, sim) of pattern (idx, embedding) against all vectors; a pattern has twelve rows at most."""
    p = pattern.select("idx", F.col("embedding").alias("_p"))
    return vectors.crossJoin(F.broadcast(p)).select("idx", F.col("vec_id").alias("tok"), similarity("_p", "embedding").alias("sim"))


def similar_words(pattern: DataFrame, vectors: DataFrame, floor: float, n_vocab: int) -> DataFrame:
    """Those with sim >= floor, without the last id, which stands for unknown words."""
    return similarity_matrix(pattern, vectors).where((F.col("sim") >= floor) & (F.col("tok") < n_vocab - 1))


def top_similar(sims: DataFrame, k: int) -> DataFrame:
    """The k most similar words of each position, ties by id."""
    rank = F.row_number().over(W.partitionBy("idx").orderBy(F.desc("sim"), "tok"))
    return sims.withColumn("rank", rank).where(F.col("rank") <= k)


def weighted_vectors(vectors: DataFrame, freq: DataFrame) -> DataFrame:
    """(tok, p, embedding): words that occur, with their share of all tokens."""
    both = vectors.join(freq.where("freq > 0").withColumnRenamed("tok", "vec_id"), "vec_id")
    total = both.agg(F.sum("freq").alias("total"))
    return both.crossJoin(F.broadcast(total)).select(F.col("vec_id").alias("tok"), (F.col("freq") / F.col("total")).alias("p"), "embedding")


def weighted_mean(weighted: DataFrame) -> DataFrame:
    """(i, mu)."""
    parts = weighted.select("p", F.posexplode("embedding").alias("i", "x"))
    return parts.groupBy("i").agg(F.sum(F.col("p") * F.col("x").cast("double")).alias("mu"))


def covariance(weighted: DataFrame) -> DataFrame:
    """(i, j, cov): sum of p (e - mu)(e - mu)'. Each task adds up its own D x D matrix of second moments."""
    ship(weighted.sparkSession)

    def moments(batches):
        acc = None
        for batch in batches:
            if not batch.num_rows:
                continue
            p = batch.column(0).to_numpy()
            e = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(p), -1).astype(np.float64)
            acc = (0 if acc is None else acc) + (e * p[:, None]).T @ e
        if acc is not None:
            d = len(acc)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(d), d).astype(np.int32)), pa.array(np.tile(np.arange(d), d).astype(np.int32)), pa.array(acc.reshape(-1))], names=["i", "j", "m"])

    second = weighted.select("p", F.col("embedding").cast("array<double>")).mapInArrow(moments, "i int, j int, m double").groupBy("i", "j").agg(F.sum("m").alias("m"))
    mu = weighted_mean(weighted)
    a, b = mu.select("i", F.col("mu").alias("a")), mu.select(F.col("i").alias("j"), F.col("mu").alias("b"))
    return second.join(F.broadcast(a), "i").join(F.broadcast(b), "j").select("i", "j", (F.col("m") - F.col("a") * F.col("b")).alias("cov"))


def whitened_norms(vectors: DataFrame, freq: DataFrame) -> DataFrame:
    """(tok, norm): (e - mu)' S^-1 (e - mu) under the token distribution; NEVER for words that don't occur.

    Only the D x D matrix comes to the driver. Without any occurring word all norms are NEVER.
    """
    w = weighted_vectors(vectors, freq)
    cov, mean = covariance(w).collect(), weighted_mean(w).collect()
    seen = freq.where("freq > 0").select(F.col("tok").alias("vec_id"), F.lit(True).alias("_seen"))
    base = vectors.join(seen, "vec_id", "left")
    if not cov:
        return base.select(F.col("vec_id").alias("tok"), F.lit(NEVER).alias("norm"))
    d = max(r.i for r in mean) + 1
    s, mu = np.zeros((d, d)), np.zeros(d)
    for r in cov:
        s[r.i, r.j] = r["cov"]
    for r in mean:
        mu[r.i] = r.mu
    values, axes = np.linalg.eigh((s + s.T) / 2)
    scaled = axes / np.sqrt(np.maximum(values, EIGEN_FLOOR))
    rows = F.array(*[F.array(*[F.lit(float(x)) for x in axis]) for axis in scaled.T])
    centred = F.zip_with(F.col("embedding"), F.array(*[F.lit(float(x)) for x in mu]), lambda x, m: x.cast("double") - m)
    norm = F.aggregate(rows, F.lit(0.0), lambda acc, axis: acc + F.pow(dot(axis, F.col("_c")), F.lit(2.0)))
    return base.withColumn("_c", centred).select(F.col("vec_id").alias("tok"), F.when(F.col("_seen"), norm).otherwise(NEVER).alias("norm"))


def editable(norms: DataFrame) -> DataFrame:
    """Norms as a search sees them."""
    return norms.withColumn("norm", F.when(F.col("tok") >= FIRST_UNEDITABLE, UNEDITABLE).otherwise(F.col("norm")))


def norm_cut(norms: DataFrame, n_vocab: int, rank: int = RANK) -> float:
    """Largest norm of a word that may be inserted: an order statistic of the first fiftieth of the ids."""
    head = n_vocab // 50
    at = rank * rank + 100
    if at >= head:
        return NO_CUT
    return float(norms.where(F.col("tok") < head).orderBy("norm").limit(at + 1).agg(F.max("norm")).first()[0])


def lowest_norms(norms: DataFrame, n_vocab: int, rank: int = RANK) -> tuple[list[float], float]:
    """(the lowest norms of words that may be inserted, rank + 1 of them; the norm cut)."""
    cut = norm_cut(norms, n_vocab, rank)
    low = norms.where((F.col("tok") < n_vocab - 1) & (F.col("norm") <= cut)).orderBy("norm").limit(rank + 1).collect()
    return [r.norm for r in low], cut


def coefficient_of(low: list[float], length: int, rank: int = RANK) -> float:
    """Where fewer words than needed are eligible, the last of them counts; 0 for none."""
    if not low:
        return 0.0
    at = next((i - 1 for i in range(1, min(rank, len(low))) if low[i] >= UNEDITABLE), min(rank, len(low) - 1))
    return low[at] * length / 5.0


def coefficient(norms: DataFrame, n_vocab: int, length: int, rank: int = RANK) -> tuple[float, float]:
    """(coefficient, norm cut)."""
    low, cut = lowest_norms(norms, n_vocab, rank)
    return coefficient_of(low, length, rank), cut


def insert_words(norms: DataFrame, n_vocab: int, coef: float, cut: float, floor: float) -> DataFrame:
    """(tok, mult) of words that may be inserted."""
    fit = norms.where((F.col("tok") < n_vocab - 1) & (F.col("norm") <= cut))
    return fit.select("tok", edit_multiplier("norm", coef).alias("mult")).where(F.col("mult") >= floor)


__all__ = ["l2_normalize", "similarity_matrix", "similar_words", "top_similar", "weighted_mean", "covariance", "whitened_norms", "editable", "norm_cut", "coefficient", "insert_words"]
