"""Size-balanced sharding by sampled splitters. DataFrame functions only, no Python on the executors."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import crc32_text, cut, unit_hash

RANGES_PER_SHARD = 32
MAX_RANGES = 4096
ROWS_PER_RANGE = 200_000
DRAWS_PER_RANGE = 32
#: Equal texts with more than this share of a shard's bytes may be split among shards; all others stay together.
GROUP_SHARE = 0.01
_ROW_BITS = 23


def _rank(bounds: list[int], key: Column) -> Column:
    """How many of the sorted bounds are <= key: a coarse pass, then one block of it."""
    if not bounds:
        return F.lit(0)
    step = max(1, round(len(bounds) ** 0.5))
    arr = lambda xs: F.array(*[F.lit(x) for x in xs])
    if len(bounds) <= 32:
        return F.size(F.filter(arr(bounds), lambda b: b <= key))
    blocks = F.array(*[arr(bounds[i : i + step]) for i in range(0, len(bounds), step)])
    coarse = F.size(F.filter(arr(bounds[step::step]), lambda b: b <= key))
    return coarse * step + F.size(F.filter(F.element_at(blocks, coarse + 1), lambda b: b <= key))


def _splitters(keys: list[int], parts: int) -> list[int]:
    """Quantile boundaries: distinct, sorted, parts - 1 at most."""
    keys = sorted(keys)
    return sorted({keys[i * len(keys) // parts] for i in range(1, parts)}) if keys else []


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deals all rows into shards of near equal bytes.

    Keys are drawn with a probability that follows the row's size, quantiles of the drawn keys
    bound fine ranges, and a range that turns out overfull gets further splitters. The exact sums
    of the ranges then place every row. A key is the text's hash, so equal texts have one key, lie in one range and
    go to one shard. Only of a text whose rows have more than GROUP_SHARE of a shard's bytes (some hundreds of texts at
    most, whatever the table) do the rows have keys of their own, so that no range and no shard
    depends on one text, id or repeated row. Shards thus differ by one row or by GROUP_SHARE of a shard.

    Size is the UTF-8 bytes of the text plus 1. Null text has size 1 and the checksum of the empty
    text, and null texts are a group; null ids and repeated rows are rows like any other; an empty table gives no rows. Other
    columns are ignored. Returns id, size, text_crc32, law, shard, slot, grown_shard, range_id.
    """
    text = F.col(text_col).cast("string")
    low = (1 << _ROW_BITS) - 1
    base = cut(
        docs.select(
            F.col(id_col).alias("id"),
            (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
            crc32_text(text).alias("crc"),
            F.xxhash64(text).alias("h"),
            F.xxhash64(F.monotonically_increasing_id()).alias("row"),
        ),
        "shard-keys",
    )
    all_bytes = base.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    large = base.groupBy("h").agg(F.sum("size").alias("size"), F.count("*").alias("n")).where((F.col("size") > F.lit(GROUP_SHARE * all_bytes / shards)) & (F.col("n") > 1))
    hot = [r.h for r in large.select("h").collect()]  # shards / GROUP_SHARE texts at most
    own = F.when(F.col("h").isin(hot), F.col("row").bitwiseAND(F.lit(low))).otherwise(F.lit(0).cast("long")) if hot else F.lit(0).cast("long")
    rows = base.withColumn("key", F.col("h").bitwiseAND(F.lit(~low)).bitwiseOR(own))
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    n, total = int(n), max(1, int(total))
    ranges = max(RANGES_PER_SHARD * shards, min(MAX_RANGES, -(-n // ROWS_PER_RANGE)))
    weight = F.col("size") / F.lit(2.0 * total) + F.lit(1 / (2.0 * max(1, n)))
    draw = unit_hash(F.col("row"), F.lit(31))

    bounds = _splitters([r.key for r in rows.where(draw < weight * (ranges * DRAWS_PER_RANGE)).select("key").collect()], ranges)
    sums: dict[int, tuple[int, int]] = {}
    for again in range(4):
        sums = {r.r: (r.b, r.n) for r in rows.groupBy(_rank(bounds, F.col("key")).alias("r")).agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()}
        share = {r: b / (2 * total) + c / (2 * max(1, n)) for r, (b, c) in sums.items()}
        over = {r: s for r, s in share.items() if s > 2 / ranges and sums[r][1] > 1}
        if again == 3 or not over or len(bounds) >= 2 * MAX_RANGES:
            break
        # only the overfull ranges are drawn from again, at a higher rate
        within = _rank(bounds, F.col("key"))
        more = unit_hash(F.col("row"), F.lit(32 + again)) < weight * (ranges * DRAWS_PER_RANGE * 4)
        found: dict[int, list[int]] = {}
        for r in rows.where(within.isin(sorted(over)) & more).select("key").collect():
            found.setdefault(bisect_right(bounds, r.key), []).append(r.key)
        added = {b for r, keys in found.items() for b in _splitters(keys, min(64, int(share[r] * ranges) + 1))} - set(bounds)
        if not added:
            break
        bounds = sorted(added | set(bounds))

    base, acc = [], 0
    for r in range(len(bounds) + 1):
        base.append(acc)
        acc += sums.get(r, (0, 0))[0]
    base_of = F.element_at(F.array(*[F.lit(b) for b in base]), F.col("range_id") + 1)

    order = [F.col("key"), F.col("h"), F.col("id")]
    in_range = W.partitionBy("range_id").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    group = W.partitionBy("range_id", "h", "key")
    placed = (
        rows.withColumn("range_id", _rank(bounds, F.col("key")))
        .withColumn("before", F.sum("size").over(in_range) - F.col("size"))
        .withColumn("g_size", F.sum("size").over(group))
        .withColumn("g_start", F.min("before").over(group))
        .withColumn("mid2", 2 * F.col("g_start") + F.col("g_size"))
        .withColumn("shard", F.least(F.lit(shards - 1), F.floor((2 * base_of + F.col("mid2")) * F.lit(shards) / F.lit(2.0 * total))).cast("int"))
        .withColumn("nth", F.row_number().over(W.partitionBy("range_id", "shard").orderBy(*order)) - 1)
    )
    placed = cut(placed.select("id", "size", "crc", "range_id", "shard", "nth"), "shard-rows")

    # one row for each range and shard that meet: about as many as ranges
    first, seen = [], {}
    for r in sorted(placed.groupBy("shard", "range_id").count().collect(), key=lambda r: (r[0], r[1])):
        first.append((r[0], r[1], seen.get(r[0], 0)))
        seen[r[0]] = seen.get(r[0], 0) + r[2]
    firsts = docs.sparkSession.createDataFrame(first, "shard int, range_id int, first long")
    return placed.join(F.broadcast(firsts), ["shard", "range_id"]).select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("first") + F.col("nth")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "range_id",
    )
