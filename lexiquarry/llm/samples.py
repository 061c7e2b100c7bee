"""Bounded, reproducible samples of labelled documents for fitting classifiers on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import unit_hash

#: A longer text gives one passage of so many characters, from a place that its id picks, to learn from.
PASSAGE = 65_536


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int, total: int) -> list[tuple[str, str]]:
    """(label, text) of about per_class ids of each label, and about total at most.

    docs has (id, text), labels (id, label). The ids whose hash lies below a bound are taken; the
    bound follows from the exact count of the label, so that the sample's size doesn't depend on
    the table's. Null labels and null texts are left out, as are ids with two labels; of an id's texts the
    smallest is taken. So the sample depends on the rows alone, not on their order or partitions.
    """
    known = labels.where("id is not null and label is not null").select("id", F.col("label").cast("string").alias("label"))
    counts = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    each = min(per_class, max(1, total // len(counts)))
    bound = F.element_at(F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(each / n))]), F.col("label"))
    place = unit_hash(F.col("id"), F.lit(41))
    picked = known.where(place < bound).select("id").distinct().orderBy(place, "id").limit(2 * each * len(counts)).collect()
    if not picked:
        return []
    spark = docs.sparkSession
    # the sample is bounded, so it is broadcast and no other row is shuffled
    ids = F.broadcast(spark.createDataFrame([(r.id,) for r in picked], "id long"))
    sure = known.join(ids, "id", "left_semi").groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").collect()
    if not sure:
        return []
    chosen = spark.createDataFrame([(r.id, r.label) for r in sure], "id long, label string")
    spare = F.length("text") - PASSAGE
    passage = F.when(spare > 0, F.substring(F.col("text"), (F.pmod(F.xxhash64("id"), spare + 1) + 1).cast("int"), F.lit(PASSAGE))).otherwise(F.col("text"))
    rows = docs.where("text is not null").join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min(passage).alias("text"))
    return [(r.label, r.text) for r in sorted(rows.collect(), key=lambda r: r.id)]
