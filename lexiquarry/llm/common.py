"""What the training-data operators share: tables, shared scratch folders, checksums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import cut, scratch, scratch_root
from ..session import bound_batches, ship

__all__ = ["cut", "scratch", "scratch_root", "table", "crc32_text", "fold", "unit_hash", "tokenizer_path"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc32_text(col: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes; null counts as empty."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))


def fold(id_col: Column, parts: int) -> Column:
    """crc32(id as text) mod parts."""
    return F.crc32(id_col.cast("string").cast("binary")) % F.lit(parts)


def unit_hash(*cols: Column) -> Column:
    """A reproducible number in [0, 1) from the columns."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary file lies on this machine and, at the same place, on the others."""
    import public_tokenizers

    return str(public_tokenizers.path(name))
