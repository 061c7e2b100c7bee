"""Twelve-token windows of the stream: distinct n-grams, counts, suffix order and lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import GRAM, trio_index
from .ranges import with_prefix_sums

T = [f"t{i}" for i in range(GRAM)]
#: Positions in a bucket of the window; each takes the first tokens of the next along.
BUCKET = 4096


def windows(stream: DataFrame, cap: int) -> DataFrame:
    """(pos, t0..t11) at every position; past the end stands cap - 1.

    Buckets of BUCKET positions, each with a copy of the eleven tokens after it, are independent, so
    windows run across documents with one shuffle of (pos, tok) and no skew.
    """
    bucket = F.floor(F.col("pos") / BUCKET).cast("long")
    both = F.when(F.col("pos") % BUCKET < GRAM - 1, F.array(bucket, bucket - 1)).otherwise(F.array(bucket))
    dealt = stream.select("pos", "tok", F.explode(both).alias("b")).where("b >= 0")
    w = W.partitionBy("b").orderBy("pos")
    leads = [F.coalesce(F.lead("tok", k).over(w), F.lit(cap - 1)).alias(T[k]) for k in range(1, GRAM)]
    return dealt.select("pos", "b", F.col("tok").alias("t0"), *leads).where(F.col("b") == bucket).select("pos", *T)


def distinct_grams(wins: DataFrame) -> DataFrame:
    """(t0..t11, cnt, first_pos)."""
    return wins.groupBy(*T).agg(F.count("*").alias("cnt"), F.min("pos").alias("first_pos"))


def short_grams(grams: DataFrame) -> DataFrame:
    """(t0, t1, t2, cnt): distinct triples, whose number the vocabulary bounds better than the text's length."""
    return grams.groupBy("t0", "t1", "t2").agg(F.sum("cnt").alias("cnt"))


def bigram_set(wins: DataFrame, below: int) -> DataFrame:
    """Distinct pairs of ids under `below`."""
    return wins.where((F.col("t0") < below) & (F.col("t1") < below)).select("t0", "t1").distinct()


def trigram_set(wins: DataFrame, below: int) -> DataFrame:
    """Distinct triples of ids with a sum under `below`, and their dense number."""
    s = F.col("t0") + F.col("t1") + F.col("t2")
    return wins.where(s < below).select("t0", "t1", "t2").distinct().withColumn("idx", trio_index("t0", "t1", "t2", below))


def suffix_ranks(wins: DataFrame) -> DataFrame:
    """(rank, pos): positions in order of (t0..t11, pos), from 0. Ranges are cut on the first three ids."""
    key = F.shiftleft(F.col("t0").cast("long"), 40) + F.shiftleft(F.col("t1").cast("long"), 20) + F.col("t2")
    keyed = wins.withColumn("_key", key).withColumn("_one", F.lit(1).cast("long"))
    return with_prefix_sums(keyed, "_key", {"rank": "_one"}, ties=(*T[3:], "pos")).drop("_key", "_one")


def sparse_index(ranks: DataFrame, every: int) -> DataFrame:
    """Every `every`-th row of the suffix order."""
    return ranks.where(F.col("rank") % every == 0)


def prefix_is(ids: list[int]) -> Column:
    """A predicate that Parquet can check against row-group bounds."""
    return reduce(lambda a, b: a & b, [F.col(T[i]) == int(t) for i, t in enumerate(ids)], F.lit(True))


def exact_count(grams: DataFrame, ids: list[int]) -> DataFrame:
    """One row: how often the sequence stands in the stream."""
    return grams.where(prefix_is(ids)).agg(F.coalesce(F.sum("cnt"), F.lit(0)).cast("long").alias("match_count"))


def exact_counts(grams: DataFrame, patterns: DataFrame) -> DataFrame:
    """(query_id, match_count) for patterns (query_id, ids) of 1 to 12 ids; 0 where there is none.

    Patterns meet the grams on their first two ids; those of one id meet its total.
    """
    p = patterns.select("query_id", "ids", F.size("ids").alias("n"), F.col("ids")[0].alias("t0"), F.try_element_at("ids", F.lit(2)).alias("t1"))
    longer = p.where("n >= 2").join(grams, ["t0", "t1"]).where(F.slice(F.array(*T), F.lit(1), F.col("n")) == F.col("ids")).groupBy("query_id").agg(F.sum("cnt").alias("m"))
    single = p.where("n = 1").join(grams.groupBy("t0").agg(F.sum("cnt").alias("m")), "t0").select("query_id", "m")
    return patterns.select("query_id").join(longer.unionByName(single), "query_id", "left").select("query_id", F.coalesce("m", F.lit(0)).cast("long").alias("match_count"))


def prefix_exists(grams: DataFrame, patterns: DataFrame, n: int) -> DataFrame:
    """Patterns (query_id, t0..t{n-1}) that start some gram."""
    return patterns.join(grams, T[:n], "left_semi")


def prefix_missing(grams: DataFrame, patterns: DataFrame, n: int) -> DataFrame:
    return patterns.join(grams, T[:n], "left_anti")


def continuations(grams: DataFrame, prefixes: DataFrame, n: int) -> DataFrame:
    """Next ids after prefixes of n ids, with counts."""
    return prefixes.join(grams, T[:n]).groupBy(*[c for c in prefixes.columns], F.col(T[n]).alias("next_tok")).agg(F.sum("cnt").alias("cnt"))


def pair_state(pairs: DataFrame, known: DataFrame, below: int) -> DataFrame:
    """Adds state: 0 if an id is out of the table's range, 1 absent, 2 present."""
    seen = pairs.join(known.select("t0", "t1").withColumn("_hit", F.lit(True)), ["t0", "t1"], "left")
    out = (F.col("t0") >= below) | (F.col("t1") >= below)
    return seen.withColumn("state", F.when(out, 0).when(F.col("_hit"), 2).otherwise(1)).drop("_hit")


def triple_state(triples: DataFrame, known: DataFrame, below: int) -> DataFrame:
    seen = triples.join(known.select("t0", "t1", "t2").withColumn("_hit", F.lit(True)), ["t0", "t1", "t2"], "left")
    out = F.col("t0") + F.col("t1") + F.col("t2") >= below
    return seen.withColumn("state", F.when(out, 0).when(F.col("_hit"), 2).otherwise(1)).drop("_hit")
