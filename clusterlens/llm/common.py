"""Steps that several operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A side of a join is broadcast only after its rows have been counted and found to fit this many bytes.
BROADCAST_BYTES = 64 * 1024 * 1024

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Any constant does: joining on `key ^ constant` makes Spark shuffle both sides anew.
_SPREAD = 0x5DEECE66D1234567


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    A local session without that setting gets a temporary folder; on a cluster it is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith(("local[", "local-cluster")) and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="clusterlens-"))
    return spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Write to the shared checkpoint folder and go on from there: survives lost executors, and is computed once."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def fits_broadcast(rows: int, row_bytes: int) -> bool:
    return rows * row_bytes <= BROADCAST_BYTES


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Texts of one byte per character take the fast path, which is the same there."""
    is_ascii = F.octet_length(text) == F.char_length(text)
    return F.when(is_ascii, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def fold(column: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a NULL id is in no fold."""
    return F.crc32(column.cast("string").cast("binary")) % folds


def spread_join(rows: DataFrame, keyed: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Join rows with possibly hot keys to a frame aggregated by the same BIGINT key.

    The join key is a one-to-one image of ``on``, so neither side can keep the partitioning of an earlier aggregation:
    both come straight from a shuffle, and adaptive execution can split a hot partition of ``rows``.
    """
    image = F.col(on).bitwiseXOR(F.lit(_SPREAD))
    right = keyed.withColumn("_image", image).drop(on)
    return rows.withColumn("_image", image).join(right, "_image", how).drop("_image")


def columns_of(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return df.select([F.col(f"`{n}`") for n in names])
